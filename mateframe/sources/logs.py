"""Text that trainers and engines leave behind, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def number(text: Column, pattern: str) -> Column:
    """The first number a pattern's group finds, null if it finds none."""
    return F.regexp_extract(text, pattern, 1).try_cast("double")


def training_log(lines: DataFrame, col: str = "value") -> DataFrame:
    """Epoch lines of a training log: epoch, train_loss, val_loss, val_acc, lr."""
    text = F.col(col)
    fields = {
        "epoch": number(text, r"Epoch (\d+)/"), "train_loss": number(text, r"Train Loss: ([0-9.eE+-]+)"), "val_loss": number(text, r"Val Loss: ([0-9.eE+-]+)"),
        "val_acc": number(text, r"Val Acc: ([0-9.]+)"), "lr": number(text, r"LR: ([0-9.eE+-]+)"),
    }
    return lines.where(text.contains("Epoch ")).select(*[v.alias(k) for k, v in fields.items()])


def metric_log(lines: DataFrame, col: str = "value") -> DataFrame:
    """``time | Epoch e | Batch b | Loss: x (d) | Acc: x (d) | MAE: x (d)`` lines: elapsed time in seconds and the numbers, beside all other columns."""
    text = F.col(col)
    clock = F.split(F.regexp_extract(text, r"^(\d+:\d+:\d+)", 1), ":")
    seconds = F.get(clock, F.lit(0)).try_cast("int") * 3600 + F.get(clock, F.lit(1)).try_cast("int") * 60 + F.get(clock, F.lit(2)).try_cast("int")
    fields = {"elapsed": seconds, "epoch": number(text, r"Epoch (\d+)"), "batch": number(text, r"Batch (\d+)"), "loss": number(text, r"Loss: ([0-9.-]+)"), "acc": number(text, r"Acc: ([0-9.-]+)"), "mae": number(text, r"MAE: ([0-9.-]+)")}
    rest = [c for c in lines.columns if c != col and c not in fields]
    return lines.where(text.contains("| Batch ")).select(*rest, *[v.alias(k) for k, v in fields.items()])


def engine_score(text: Column) -> Column:
    """Centipawns from engine output: the final evaluation, else a search score; mate is 10000."""
    final = F.round(number(text, r"Final evaluation\s+([+-]?[0-9.]+)") * 100).cast("int")
    mate = F.when(F.regexp_extract(text, r"score mate (-?)\d+", 0) != "", F.when(F.regexp_extract(text, r"score mate (-?)\d+", 1) == "-", -10000).otherwise(10000))
    cp = F.regexp_extract(text, r"score cp (-?\d+)", 1).try_cast("int")
    return F.coalesce(final, mate, cp)


def result_map(spark: SparkSession, path: str) -> DataFrame:
    """A JSON map of configurations to results: config, accuracy, cm, samples, timestamp."""
    kind = "map<string, struct<accuracy: double, cm: array<array<bigint>>, samples: bigint, timestamp: string>>"
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", kind)).alias("config", "r")).select("config", "r.*")


def evaluations(spark: SparkSession, path: str, bound: float = 50) -> DataFrame:
    """JSON lines of (fen, cp): board, turn, class by threshold, source ``eval``."""
    rows = spark.read.schema("fen string, cp double").json(path)
    score = F.when(F.col("cp") > bound, 2).when(F.col("cp") < -bound, 0).otherwise(1)
    parts = F.split("fen", " ")
    return rows.select(F.get(parts, F.lit(0)).alias("board"), F.when(F.get(parts, F.lit(1)) == "w", 1).otherwise(0).alias("turn"), score.alias("wdl_class"), F.col("cp").alias("eval"), F.lit("eval").alias("source"))


def configs_of_files(names: Column) -> Column:
    """Configuration in a shard's file name."""
    return F.regexp_extract(names, r"(K[QRBNP]*vK[QRBNP]*)", 1)
