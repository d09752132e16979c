"""Sharding, balancing, sampling and splitting; orders come from md5 of id and seed, so runs agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded(key: Column | str, seed: int | str) -> Column:
    """A reproducible random order of rows."""
    return F.md5(F.concat_ws("|", F.col(key) if isinstance(key, str) else key, F.lit(str(seed))).cast("binary"))


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Globally shuffled rows: ranges of the seeded order, sorted inside; ``place`` is the order's key."""
    return df.withColumn("place", seeded(key, seed)).repartitionByRange("place").sortWithinPartitions("place")


def fraction(df: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """About a share of the rows, by the leading digits of the seeded order; no shuffle."""
    return df.where(F.conv(F.substring(seeded(key, seed), 1, 8), 16, 10).cast("double") / float(1 << 32) < share)


def split(df: DataFrame, key: str, seed: int, validation: float = 0.1) -> DataFrame:
    part = F.conv(F.substring(seeded(key, seed), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return df.withColumn("part", F.when(part < validation, "validation").otherwise("train"))


def quota(df: DataFrame, stratum: str, key: str, rows: int, seed: int) -> DataFrame:
    """``rows`` rows per stratum: small strata are gone through again, each epoch in a new order.

    Whole epochs need no order, so every row is copied ``rows // size`` times; only the last,
    partial epoch ranks rows. Ranks are taken within (stratum, range of the order) and ranges
    are added up, so a large stratum is spread over tasks.
    """
    sizes = df.groupBy(stratum).agg(F.count("*").alias("__size"))
    sized = df.join(sizes.hint("merge"), stratum)
    epochs = F.floor(F.lit(rows) / F.col("__size")).cast("int")
    whole = sized.where(epochs > 0).select(*df.columns, F.explode(F.sequence(F.lit(0), epochs - 1)).alias("epoch"))
    last = sized.withColumns({"epoch": epochs, "__order": F.md5(F.concat_ws("|", F.col(key), F.lit(str(seed)), epochs).cast("binary"))}).withColumn("__range", F.substring("__order", 1, 2))
    counts = last.groupBy(stratum, "__range").agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.sum("__n").over(Window.partitionBy(stratum).orderBy("__range")) - F.col("__n")).drop("__n")
    placed = last.join(before.hint("merge"), [stratum, "__range"]).withColumn("__r", F.row_number().over(Window.partitionBy(stratum, "__range").orderBy("__order")) + F.col("__before"))
    return whole.unionByName(placed.where(F.col("__r") <= F.lit(rows) - epochs * F.col("__size")).select(*df.columns, "epoch"))


def relabel(df: DataFrame, key: str, label: str, value: int, new: int, share: float, seed: int) -> DataFrame:
    """Give about a share of one class another label."""
    pick = F.conv(F.substring(seeded(key, seed), 1, 8), 16, 10).cast("double") / float(1 << 32) < share
    return df.withColumn(label, F.when((F.col(label) == value) & pick, new).otherwise(F.col(label)))


def hard_weight(wrong: Column, weight: float, epoch: int) -> Column:
    return F.lit(1.0) + F.when(wrong, F.lit(weight * (1 + min(epoch / 100, 2)))).otherwise(0.0)


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key: the one with the smallest order."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("__r")).select(*keys, "__r.*")


def write_shards(df: DataFrame, path: str, rows: int, by: str | None = None) -> None:
    """Files of at most so many rows, in folders by a column if given; a task's files commit as one."""
    writer = df.write.mode("errorifexists").option("maxRecordsPerFile", rows)
    (writer.partitionBy(by) if by else writer).parquet(path)


def write_described(df: DataFrame, path: str, index: str, x: str | None = None, **fields: str) -> DataFrame:
    """Write a data set below ``path`` and describe it in the same pass; returns the manifest, a row.

    Rows, configurations, index range, width and type of the vectors are counted while rows are written
    (``path/data``), so nothing is read twice; the row goes to ``path/manifest`` as JSON, with ``fields`` as given. The set of
    configurations is gathered, which are few.
    """
    from pyspark.sql import Observation

    seen = Observation()
    vectors = [F.max(F.size(x)).alias("dims")] if x else []
    counts = [F.count("*").alias("total_positions"), F.size(F.collect_set("config")).cast("long").alias("configs"), F.min(index).cast("long").alias("first_index"), F.max(index).cast("long").alias("last_index"), *vectors]
    df.observe(seen, *counts).write.mode("errorifexists").parquet(f"{path}/data")
    row = {**seen.get, **({"dtype": df.schema[x].dataType.simpleString()} if x else {}), **fields}
    kinds = {"total_positions": "long", "configs": "long", "first_index": "long", "last_index": "long", "dims": "int"}
    schema = ", ".join(f"{k} {kinds.get(k, 'string')}" for k in row)
    df.sparkSession.createDataFrame([tuple(row.values())], schema).coalesce(1).write.json(f"{path}/manifest")
    return df.sparkSession.read.schema(schema).json(f"{path}/manifest")


def resume(todo: DataFrame, path: str, key: str, work) -> DataFrame:
    """Do ``work`` for the keys that the table at ``path`` doesn't hold yet, append it, and return the whole table."""
    done = todo.sparkSession.read.parquet(path)
    work(todo.join(done.select(key).distinct().hint("merge"), key, "left_anti")).select(*done.columns).write.mode("append").parquet(path)
    return todo.sparkSession.read.schema(done.schema).parquet(path)
