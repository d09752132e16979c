"""Audits of predictions: each function takes a table of true and predicted values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def label_class(wdl: Column, rule: str = "sign") -> Column:
    """Class 0 loss, 1 draw, 2 win of a value from -2 to 2; five rules are in use.

    They agree on -2, 0 and 2 and differ on the cursed and blessed values in between.
    """
    return {
        "sign": F.signum(wdl.cast("double")).cast("int") + 1,
        "floor": (F.floor(wdl / 2) + 1).cast("int"),
        "exact": F.when(wdl == -2, 0).when(wdl == 2, 2).otherwise(1),
        "else_win": F.when(wdl == -2, 0).when(wdl == 0, 1).otherwise(2),
        "five": (wdl + 2).cast("int"),
    }[rule]


def label_arity(df: DataFrame, by: str, wdl: str) -> DataFrame:
    """Number of classes that each data set's labels ask for: five if any is cursed or blessed (1 or -1), else three."""
    odd = F.max(F.when(F.col(wdl).isin(-1, 1), 1).otherwise(0))
    return df.groupBy(by).agg(F.when(odd == 1, 5).otherwise(3).alias("arity"))


def mapped_class(wdl: Column, arity: Column) -> Column:
    """Class of a value by its data set's arity: -2, 0, 2 as 0, 1, 2, or -2 to 2 as 0 to 4; null for others."""
    three = F.when(wdl.isin(-2, 0, 2), (wdl / 2 + 1).cast("int"))
    return F.when(arity == 5, F.when(wdl.between(-2, 2), (wdl + 2).cast("int"))).otherwise(three)


def threshold_class(score: Column, bound: float) -> Column:
    return F.when(score > bound, 2).when(score < -bound, 0).otherwise(1)


def white_view(value: Column, turn: Column, classes: int = 3) -> Column:
    """Class of the side to move as White's, and back."""
    return F.when(turn == 0, classes - 1 - value).otherwise(value)


def distribution(df: DataFrame, col: str) -> DataFrame:
    """Rows and percent per class; the total runs over the few class rows only."""
    counts = df.groupBy(col).agg(F.count("*").alias("n"))
    return counts.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def class_weights(df: DataFrame, col: str) -> DataFrame:
    counts = df.groupBy(col).agg(F.count("*").alias("n"))
    every = Window.partitionBy()
    return counts.withColumn("weight", F.round(F.sum("n").over(every) / (F.count("*").over(every) * F.col("n")), 6))


def summary(df: DataFrame, col: str, by: str) -> DataFrame:
    """Least, greatest, mean and population deviation, per class and over all (null class)."""
    return df.rollup(by).agg(F.min(col).alias("lo"), F.max(col).alias("hi"), F.round(F.avg(col), 6).alias("mean"), F.round(F.stddev_pop(col), 6).alias("std"), F.count("*").alias("n"))


def per_class(df: DataFrame, true: str = "true", pred: str = "pred") -> DataFrame:
    hit = F.count_if(F.col(true) == F.col(pred))
    return df.groupBy(true).agg(hit.alias("correct"), F.count("*").alias("total"), F.round(hit / F.count("*"), 6).alias("accuracy"))


def confusion(df: DataFrame, classes: int, true: str = "true", pred: str = "pred") -> DataFrame:
    """One row per true class, one column per predicted one, zeros filled in; at most ``classes`` rows are joined."""
    rows = df.sparkSession.range(classes).select(F.col("id").cast("int").alias(true))
    counts = df.where(F.col(true).between(0, classes - 1)).groupBy(true).agg(*[F.count_if(F.col(pred) == k).alias(f"pred_{k}") for k in range(classes)])
    return rows.join(F.broadcast(counts), true, "left").fillna(0)


def accuracy(df: DataFrame, true: str = "true", pred: str = "pred") -> DataFrame:
    return df.agg(F.round(F.avg((F.col(true) == F.col(pred)).cast("double")), 6).alias("accuracy"), F.count("*").alias("n"))


def fatal(df: DataFrame, true: str = "true", pred: str = "pred") -> DataFrame:
    """A win called a loss, and the other way round."""
    lost, won = F.count_if((F.col(true) == 2) & (F.col(pred) == 0)), F.count_if((F.col(true) == 0) & (F.col(pred) == 2))
    return df.agg(lost.alias("win_as_loss"), won.alias("loss_as_win"), F.round((lost + won) / F.count("*"), 6).alias("rate"))


def mistakes(df: DataFrame, true: str = "true", pred: str = "pred") -> DataFrame:
    return df.where(F.col(true) != F.col(pred)).groupBy(true, pred).agg(F.count("*").alias("n"))


def micro_and_macro(df: DataFrame, by: str, hit: Column) -> DataFrame:
    """Accuracy per group, over all rows (``micro``) and as mean of the groups (``macro``)."""
    groups = df.groupBy(by).agg(F.sum(hit.cast("long")).alias("correct"), F.count("*").alias("total"))
    rows = groups.select(F.col(by).alias("config"), "correct", "total", F.round(F.col("correct") / F.col("total"), 6).alias("accuracy"))
    totals = groups.agg(F.sum("correct").alias("correct"), F.sum("total").alias("total"), F.avg(F.col("correct") / F.col("total")).alias("macro"))
    ends = totals.select(F.inline(F.array(
        F.struct(F.lit("micro").alias("config"), F.col("correct"), F.col("total"), F.round(F.col("correct") / F.col("total"), 6).alias("accuracy")),
        F.struct(F.lit("macro").alias("config"), F.col("correct"), F.col("total"), F.round("macro", 6).alias("accuracy")),
    )))
    return rows.unionByName(ends)


def compare_runs(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Two results side by side per key: old, new, change."""
    return a.select(key, F.col(value).alias("old")).join(b.select(key, F.col(value).alias("new")), key).withColumn("change", F.round(F.col("new") - F.col("old"), 6))


def break_even(df: DataFrame, wrong: Column, model_bytes: int, table_bytes: int, exception_bytes: int = 5) -> DataFrame:
    """Does a model with a table of its errors take less room than the table itself?"""
    errors = F.count_if(wrong)
    need = errors * exception_bytes + model_bytes
    return df.agg(errors.alias("errors"), need.alias("bytes"), F.round(F.lit(table_bytes) / need, 6).alias("compression"), F.round(1 - (table_bytes - model_bytes) / (F.count("*") * float(exception_bytes)), 6).alias("break_even"))


#: Rows that a product may have.
PRODUCT = 1 << 24


def product(a: DataFrame, b: DataFrame, most: int = PRODUCT) -> DataFrame:
    """All pairs of two small tables; both are counted first, and a product of over ``most`` rows is refused."""
    n, m = a.count(), b.count()
    if n * m > most:
        raise ValueError(f"{n} times {m} rows is over {most}")
    return a.crossJoin(F.broadcast(b)) if m <= n else F.broadcast(a).crossJoin(b)


def overlay(pred: DataFrame, exceptions: DataFrame, key: str, value: str) -> DataFrame:
    """Predictions with the stored exceptions laid over them."""
    return pred.join(exceptions.select(key, F.col(value).alias("__fix")), key, "left").withColumn(value, F.coalesce("__fix", value)).drop("__fix")


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, not in every place that names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def softmax(x: Column) -> Column:
    total = lambda e: F.aggregate(e, F.lit(0.0), lambda a, b: a + b)
    shares = lambda e: _bound(total(e), lambda t: F.transform(e, lambda v: v / t))
    return _bound(x, lambda y: _bound(F.array_max(y), lambda top: _bound(F.transform(y, lambda v: F.exp(v - top)), shares)))


def minimax(children: DataFrame, parent: str, value: str, maximise: bool) -> DataFrame:
    """One ply of backup: the best child's value per parent."""
    best = F.max(value) if maximise else F.min(value)
    return children.groupBy(parent).agg(best.alias(value))


def best_move(children: DataFrame, parent: str, move: str, wdl: Column, dtz: Column) -> DataFrame:
    """The move with the best bucket (beyond 0.3), then the shortest way, then the softer score."""
    bucket = F.when(wdl > 0.3, 1).when(wdl < -0.3, -1).otherwise(0)
    order = F.struct(bucket.alias("b"), F.when(bucket != 0, -dtz).otherwise(F.lit(0.0)).alias("d"), wdl.alias("w"), (-F.col(move)).alias("m"))
    return children.groupBy(parent).agg(F.max_by(F.col(move), order).alias(move), F.max(order)["b"].alias("bucket"))
