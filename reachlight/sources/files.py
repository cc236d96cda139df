"""Readers of transit files: JSON arrays, directories of them, GTFS text files, OSM XML, stored graphs; configuration.

Every reader takes an explicit schema, so missing fields are null and unknown ones are not read. `_pos` keeps the input
order: files by name, then records.
"""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F


def in_order(df: DataFrame) -> DataFrame:
    """With _pos; rows of one file are read by one task, in order."""
    return df.withColumn("_file", F.col("_metadata.file_name")).withColumn("_pos", F.struct(F.col("_file"), F.monotonically_increasing_id().alias("row"))).drop("_file")


def json_array(spark, path: str, schema: str) -> DataFrame:
    """Objects of a JSON array (file, folder or pattern). Fields of mixed kinds are read as strings; see `text_or_first`."""
    return in_order(spark.read.schema(schema).option("multiLine", True).json(path))


def json_folder(spark, path: str, schema: str, skip: str) -> DataFrame:
    """JSON arrays of all *.json files of a folder whose lower-cased name does not match `skip`."""
    df = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").json(path)
    return in_order(df.where(~F.lower(F.col("_metadata.file_name")).rlike(skip)))


def text_or_first(x: Column) -> Column:
    """A field that is a string, or a list of strings: the string or the first of them; an empty list is null."""
    listed = F.from_json(x, "array<string>", {"mode": "PERMISSIVE"})
    return F.when(F.ltrim(x).startswith("["), F.try_element_at(listed, F.lit(1))).otherwise(x)


def exists(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def gtfs(spark, folder: str, name: str, columns: list[str], optional: bool = False) -> DataFrame:
    """Columns of folder/name.txt as strings (a byte order mark is skipped); columns the file lacks are null."""
    path, schema = f"{folder}/{name}.txt", ", ".join(f"`{c}` string" for c in columns)
    if optional and not exists(spark, path):
        return spark.createDataFrame([], schema + ", _pos struct<_file:string,row:long>")
    df = in_order(spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path))
    return df.select(*(F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns), "_pos")


NODE = "_id long, _lat double, _lon double"
WAY = "_id long, nd array<struct<_ref:long>>, tag array<struct<_k:string,_v:string>>"


def osm(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, x, y) and directed edges (u, v, osmid, highway) of the highways of an OSM XML file.

    Consecutive nodes of a way are joined both ways where the file holds both; nodes off highways are left out."""
    read = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    kind = F.try_element_at(F.filter("tag", lambda t: t["_k"] == "highway"), F.lit(1))["_v"]
    ways = read("way", WAY).select(F.col("_id").alias("osmid"), F.transform("nd", lambda n: n["_ref"]).alias("nd"), kind.alias("highway")).where("highway is not null")
    used = ways.select(F.explode("nd").alias("id")).distinct()
    nodes = read("node", NODE).selectExpr("_id as id", "_lon as x", "_lat as y").join(used, "id", "left_semi")
    pairs = ways.where(F.size("nd") > 1).select("osmid", "highway", F.explode(F.arrays_zip(F.slice("nd", 1, F.size("nd") - 1).alias("u"), F.slice("nd", 2, F.size("nd") - 1).alias("v"))).alias("e")).select("e.u", "e.v", "osmid", "highway")
    known = nodes.select("id")
    pairs = pairs.join(known.withColumnRenamed("id", "u"), "u", "left_semi").join(known.withColumnRenamed("id", "v"), "v", "left_semi").select("u", "v", "osmid", "highway")
    return nodes, pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"), "osmid", "highway"))


def within_box(nodes: DataFrame, edges: DataFrame, west: float, south: float, east: float, north: float, margin: float = 0.02) -> tuple[DataFrame, DataFrame]:
    """Whole ways that touch the box widened by margin degrees, with all their nodes."""
    inside = nodes.where(F.col("x").between(west - margin, east + margin) & F.col("y").between(south - margin, north + margin)).select("id")
    ends = edges.select("osmid", F.explode(F.array("u", "v")).alias("id"))
    kept = edges.join(ends.join(inside, "id", "left_semi").select("osmid").distinct(), "osmid", "left_semi")
    return nodes.join(kept.select(F.explode(F.array("u", "v")).alias("id")).distinct(), "id", "left_semi"), kept


def in_box(df: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """Rows with lat and lon inside the box."""
    return df.where(F.col("lon").between(west, east) & F.col("lat").between(south, north))


def first_graph(spark, *paths: str, build=None) -> tuple[DataFrame, DataFrame]:
    """nodes and edges of the first path that holds both tables; else build() is stored at the first path and read."""
    for p in paths:
        if exists(spark, f"{p}/nodes") and exists(spark, f"{p}/edges"):
            return spark.read.parquet(f"{p}/nodes"), spark.read.parquet(f"{p}/edges")
    if build is None:
        raise FileNotFoundError(f"no graph in {', '.join(paths)}")
    for name, df in zip(("nodes", "edges"), build()):
        df.write.mode("overwrite").parquet(f"{paths[0]}/{name}")
    return first_graph(spark, paths[0])


def merged_config(base: dict, over: dict) -> dict:
    """base with over laid on it; dictionaries merge at every depth, other values replace."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged_config(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def simple_yaml(text: str) -> dict:
    """Nested maps of scalars and lists of scalars, as configuration files hold: indentation, comments, quotes."""
    root: dict = {}
    stack: list = [(-1, root, None)]
    for raw in text.splitlines():
        line = raw if raw.count('"') or raw.count("'") else raw.split(" #")[0]
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        depth, body = len(line) - len(line.lstrip()), line.strip()
        while depth <= stack[-1][0] and not (body.startswith("- ") and depth == stack[-1][0]):
            stack.pop()
        _, at, (up, key) = (*stack[-1][:2], stack[-1][2] or (None, None))
        if body.startswith("- "):
            if not isinstance(up[key], list):
                up[key] = []
            up[key].append(scalar(body[2:]))
            continue
        name, _, value = body.partition(":")
        name = scalar(name)
        at[name] = scalar(value.strip()) if value.strip() else {}
        if not value.strip():
            stack.append((depth, at[name], (at, name)))
    return root


def scalar(x: str):
    x = x.strip()
    if len(x) > 1 and x[0] == x[-1] and x[0] in "\"'":
        return x[1:-1]
    if x.startswith("[") and x.endswith("]"):
        return [scalar(v) for v in x[1:-1].split(",") if v.strip()]
    for kind in (int, float):
        try:
            return kind(x)
        except ValueError:
            pass
    return {"true": True, "false": False, "null": None, "~": None, "": None}.get(x.lower(), x)


def load_config(spark, *paths: str) -> dict:
    """Configuration files in rising precedence, read through Spark; missing ones are skipped."""
    out: dict = {}
    for p in paths:
        try:
            text = "\n".join(r.value for r in spark.read.text(p, wholetext=True).collect())
        except AnalysisException:
            continue
        out = merged_config(out, simple_yaml(text))
    return out


def stem(path: str) -> str:
    return PurePosixPath(path).stem
