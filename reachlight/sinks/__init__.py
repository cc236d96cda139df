"""Tables, maps and notices that leave the engine."""
