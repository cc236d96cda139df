"""Relational operators: insert-or-ignore, upsert, semi and anti loads, deltas between cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def first_wins(df: DataFrame, key: str | list[str], order: str) -> DataFrame:
    """Insert-or-ignore: the first row of each key; rows equal in order are told apart by their hash. A null key is a key."""
    keys = [key] if isinstance(key, str) else key
    by = Window.partitionBy(*keys).orderBy(order, F.xxhash64(*(F.col(f"`{f.name}`") for f in df.schema if "map<" not in f.dataType.simpleString())))
    return df.withColumn("__n", F.row_number().over(by)).where("__n = 1").drop("__n")


def upsert_last(df: DataFrame, key: str, order: str, keep: list[str], last: list[str]) -> DataFrame:
    """First value of `keep`, last value (nulls too) of `last` for each key."""
    return df.groupBy(key).agg(*(F.min_by(c, order).alias(c) for c in keep), *(F.max_by(c, order).alias(c) for c in last))


def only_known(df: DataFrame, *known: tuple[DataFrame, str]) -> DataFrame:
    for other, key in known:
        df = df.join(other.select(key).distinct(), key, "left_semi")
    return df


def insert_or_ignore(target: DataFrame, rows: DataFrame, key: str, order: str) -> DataFrame:
    """Target with those new rows whose keys it lacks."""
    return target.unionByName(first_wins(rows, key, order).join(target.select(key), key, "left_anti"), allowMissingColumns=True)


def snapshot_delta(old: DataFrame, new: DataFrame, key: str | list[str], value: str) -> DataFrame:
    """State of each key between two cycles: new, delisted, updated or same. A null value is a value like others."""
    keys = [key] if isinstance(key, str) else key
    o, n = old.select(*keys, F.col(value).alias("old_value"), F.lit(True).alias("__o")), new.select(*keys, F.col(value).alias("new_value"), F.lit(True).alias("__n"))
    state = F.expr("case when __o is null then 'new' when __n is null then 'delisted' when not old_value <=> new_value then 'updated' else 'same' end")
    return o.join(n, keys, "full").withColumn("state", state).drop("__o", "__n")


def changes(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the key's row before, null being a value; the first row of a key is none."""
    by = Window.partitionBy(key).orderBy(*order)
    rows = df.withColumn("previous", F.lag(value).over(by)).withColumn("__n", F.row_number().over(by))
    return rows.where(F.col("__n") > 1).where(~F.col("previous").eqNullSafe(F.col(value))).drop("__n")


def safety(found: DataFrame, active: DataFrame, group: str, threshold: float = 0.5) -> DataFrame:
    """Groups with fewer found rows than threshold times the active ones are suspicious; groups without active rows are not."""
    f, a = found.groupBy(group).agg(F.count("*").alias("found")), active.groupBy(group).agg(F.count("*").alias("active"))
    rows = a.join(f, group, "full").select(group, *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("active", "found")))
    return rows.withColumn("suspicious", F.col("found") < F.col("active") * threshold)


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """table, rows: how many rows each of them has."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.lit(name).alias("table"), F.count("*").alias("rows"))
        out = row if out is None else out.unionAll(row)
    return out


def chunked(df: DataFrame, size: int, *order: str) -> DataFrame:
    """Rows with the number of their chunk of `size`; chunks follow the order within each of a range of partitions."""
    ranged = df.repartitionByRange(*order)
    place = F.row_number().over(Window.partitionBy("__p").orderBy(*order)) - 1
    return ranged.withColumn("__p", F.spark_partition_id()).withColumn("chunk", F.struct(F.col("__p").alias("part"), F.floor(place / size).alias("n"))).drop("__p")


def latest(df: DataFrame, order: str, n: int = 1) -> DataFrame:
    """The n rows of the largest order."""
    return df.orderBy(F.desc(order)).limit(n)
