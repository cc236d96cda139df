"""Readers of files and of the web, and importers of transit data."""
