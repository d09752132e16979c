"""Stream forms of shard pick-up, running totals, live metrics and deduplication.

What must outlive a micro-batch stands in tables named by batch number: batch n reads the state of n - 1
and overwrites that of n. A batch that runs again after a failure reads and writes the same,
so nothing counts twice, and a restart goes on from the checkpoint.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.types import StructType


def shards(spark: SparkSession, path: str, schema, files_per_trigger: int = 4) -> DataFrame:
    """New shard files as they appear."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def totals(stream: DataFrame, by: str) -> DataFrame:
    """Running row counts per configuration."""
    return stream.groupBy(by).agg(F.count("*").alias("n"))


def _version(path: str, number: int) -> str:
    return f"{path}/batch={number}"


def _state(spark: SparkSession, path: str, number: int, schema: StructType) -> DataFrame:
    """State after batch ``number``; nothing before the first batch."""
    return spark.read.schema(schema).parquet(_version(path, number)) if number >= 0 else spark.createDataFrame([], schema)


def merge_totals(changed: DataFrame, number: int, path: str, by: str) -> None:
    """Lay a batch's new totals over those of the batch before: totals replace totals, so a repeated batch changes nothing."""
    old, key = _state(changed.sparkSession, path, number - 1, changed.schema), F.col("__k").eqNullSafe(F.col(by))
    kept = old.join(changed.select(F.col(by).alias("__k")), key, "left_anti")
    kept.unionByName(changed).write.mode("overwrite").parquet(_version(path, number))


def live_totals(stream: DataFrame, by: str, path: str, checkpoint: str, *, trigger: dict | None = None) -> StreamingQuery:
    """Row counts per key of a stream, in update mode: a batch hands on only keys that it changed. Read by ``latest``."""
    writer = totals(stream, by).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True}))
    return writer.foreachBatch(lambda batch, number: merge_totals(batch.persist(), number, path, by) or batch.unpersist()).start()


def latest(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The state of the last batch below ``path``."""
    every = spark.read.schema(StructType([*schema.fields]).add("batch", "long")).parquet(path)
    last = every.agg(F.max("batch")).first()[0]
    return every.where(F.col("batch") == (-1 if last is None else last)).drop("batch")


class Progress(StreamingQueryListener):
    """What streams report of their batches, as a table: the last ``most`` batches."""

    SCHEMA = "id string, name string, batch long, rows long, milliseconds long, state_rows long, state_removed long, watermark string"

    def __init__(self, most: int = 10_000):
        self.rows: deque[tuple] = deque(maxlen=most)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        state = p.stateOperators
        self.rows.append((str(p.id), p.name, p.batchId, p.numInputRows, (p.durationMs or {}).get("triggerExecution"), sum(s.numRowsTotal for s in state), sum(s.numRowsRemoved for s in state), (p.eventTime or {}).get("watermark")))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rows), self.SCHEMA)


def live_log(lines: DataFrame, path: str, checkpoint: str, *, run: str, order: list[str], metrics: list[str], lead: str, trigger: dict | None = None) -> StreamingQuery:
    """Lines of running logs as they arrive, each with what changed since its run's line before.

    Adds ``delta_<metric>`` (0 for a run's first line), ``best`` (of ``lead`` so far) and ``better`` (above all before). A run's lines
    of one batch stand by ``order``, behind those of earlier batches. What a run has reached (last
    metrics, best, number of lines) is a row of the state; it enters the next batch's window as the run's first row, so there is
    no join and a run of any length spills like any sort. Read by ``log_lines``, states by ``latest`` with ``log_state``.
    """
    seen, state = lines.columns, log_state(lines, run, metrics)

    def save(batch: DataFrame, number: int) -> None:
        out = logged(batch, _state(batch.sparkSession, f"{path}/state", number - 1, state), run, order, metrics, lead)
        out.write.mode("overwrite").parquet(_version(f"{path}/lines", number))
        done = batch.sparkSession.read.schema(out.schema).parquet(_version(f"{path}/lines", number))
        advanced(done, _state(batch.sparkSession, f"{path}/state", number - 1, state), run, order, metrics).write.mode("overwrite").parquet(_version(f"{path}/state", number))

    return lines.select(seen).writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).foreachBatch(save).start()


def log_state(lines: DataFrame, run: str, metrics: list[str]) -> StructType:
    """run, lines, best, last_<metric>..."""
    out = StructType().add(run, lines.schema[run].dataType).add("lines", "long").add("best", "double")
    for m in metrics:
        out = out.add(f"last_{m}", "double")
    return out


def logged(batch: DataFrame, state: DataFrame, run: str, order: list[str], metrics: list[str], lead: str) -> DataFrame:
    """A batch's lines with deltas and bests, given what their runs had reached."""
    rows = batch.select("*", *[F.col(m).cast("double").alias(f"last_{m}") for m in metrics], F.lit(1).alias("__line"), F.col(lead).cast("double").alias("best"))
    seeds = state.select(run, *[f"last_{m}" for m in metrics], F.lit(0).alias("__line"), "best")
    w = Window.partitionBy(run).orderBy("__line", *order)
    past = F.max("best").over(w.rowsBetween(Window.unboundedPreceding, -1))
    deltas = {f"delta_{m}": F.coalesce(F.col(f"last_{m}") - F.lag(f"last_{m}").over(w), F.lit(0.0)) for m in metrics}
    seen = rows.unionByName(seeds, allowMissingColumns=True).withColumns({**deltas, "__past": past, "__best": F.max("best").over(w)})
    better = F.coalesce(F.col("best") > F.col("__past"), F.col("__past").isNull() & F.col("best").isNotNull())
    return seen.where("__line = 1").select(*batch.columns, *deltas, F.col("__best").alias("best"), better.alias("better"))


def advanced(done: DataFrame, state: DataFrame, run: str, order: list[str], metrics: list[str]) -> DataFrame:
    """What runs have reached after a batch's lines."""
    last = F.struct(*order)
    new = done.groupBy(run).agg(F.count("*").alias("lines"), F.max("best").alias("best"), *[F.max_by(F.col(m).cast("double"), last).alias(f"last_{m}") for m in metrics])
    both = state.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    return both.groupBy(run).agg(F.sum("lines").alias("lines"), F.max("best").alias("best"), *[F.max_by(f"last_{m}", "__new").alias(f"last_{m}") for m in metrics])


def log_lines(spark: SparkSession, path: str, schema: StructType, metrics: list[str]) -> DataFrame:
    """All lines that ``live_log`` has written; ``schema`` is that of its input."""
    out = StructType([*schema.fields])
    for m in metrics:
        out = out.add(f"delta_{m}", "double")
    return spark.read.schema(out.add("best", "double").add("better", "boolean")).parquet(f"{path}/lines")


def distinct_keys(stream: DataFrame, keys: list[str], time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """First row per key. With a time column, repeats that come within the delay of the first are dropped, and
    keys leave the state when the watermark (the latest time less the delay) has passed them; rows behind the watermark are dropped."""
    return stream.dropDuplicates(keys) if time is None else stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def in_slices(spark: SparkSession, rows: DataFrame, time: str, path: str, slices: int, then: Callable[[int], None]) -> None:
    """Write rows below ``path`` in slices of time, one after the other, and call ``then`` after each."""
    low, high = rows.agg(F.min(F.col(time).cast("timestamp").cast("double")), F.max(F.col(time).cast("timestamp").cast("double"))).first()
    step = ((high or 0) - (low or 0)) / slices + 1e-6
    number = F.coalesce(F.least(F.floor((F.col(time).cast("timestamp").cast("double") - F.lit(low or 0.0)) / step), F.lit(slices - 1)), F.lit(0))
    for k in range(slices):
        rows.where(number == k).write.mode("append").parquet(path)
        then(k)


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is there now, each batch to Parquet, and read the last state.

    In complete mode every batch holds the whole state, so it replaces the one before; in append
    mode each batch has a folder of its own, which a batch that runs again replaces.
    """
    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/batch={number}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(save).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path).select(*stream.columns)
