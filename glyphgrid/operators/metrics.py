"""Segmentation scores and losses over (logit or p, t) pixels, as sums of one aggregation and a projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import sigmoid

EPS = 1e-6


def supervised(t: Column, mask: Column | None = None, low: float = 0.4, high: float = 0.6) -> Column:
    """Pixels outside the ambiguous band, and under the mask."""
    out = (t < low) | (t > high)
    return out if mask is None else mask & out


def bce(logit: Column, t: Column) -> Column:
    """Binary cross-entropy from log odds, stable for large ones."""
    return F.greatest(logit, F.lit(0.0)) - logit * t + F.log1p(F.exp(-F.abs(logit)))


def f_beta(pixels: DataFrame, by: list[str], p: Column, t: Column, *, mask: Column | None = None, beta: float = 0.5, level: float = 0.4) -> DataFrame:
    """F-beta of p > level against t > 0.5 for each group; with `by` a batch, average the scores of the batches."""
    m = F.lit(True) if mask is None else mask
    yes, true = p > level, t > 0.5
    c = pixels.groupBy(*by).agg(F.count_if(yes & true & m).alias("tp"), F.count_if(yes & ~true & m).alias("fp"), F.count_if(~yes & true & m).alias("fn"))
    prec, rec = F.col("tp") / (F.col("tp") + F.col("fp") + EPS), F.col("tp") / (F.col("tp") + F.col("fn") + EPS)
    c = c.withColumns({"precision": prec, "recall": rec})
    score = (1 + beta**2) * F.col("precision") * F.col("recall") / (beta**2 * F.col("precision") + F.col("recall") + EPS)
    return c.withColumn("f_beta", score)


def mean_f_beta(scores: DataFrame, by: list[str]) -> DataFrame:
    """Mean of scores of batches, or of held-out segments."""
    return scores.groupBy(*by).agg(F.avg("f_beta").alias("f_beta"), F.count("*").alias("n")) if by else scores.agg(F.avg("f_beta").alias("f_beta"), F.count("*").alias("n"))


def masked_soft_loss(pixels: DataFrame, by: list[str], logit: Column, t: Column, mask: Column | None = None, *, focal: bool = False, alpha: float = 0.75, gamma: float = 2.0) -> DataFrame:
    """Half cross-entropy (or focal loss), half Dice, over supervised pixels; 0 without any."""
    m = supervised(t, mask)
    p = sigmoid(logit)
    term = bce(logit, t)
    if focal:
        p_t = p * t + (1 - p) * (1 - t)
        term = (alpha * t + (1 - alpha) * (1 - t)) * F.pow(1 - p_t, gamma) * term
    on = lambda c: F.sum(F.when(m, c).otherwise(0.0))
    s = pixels.groupBy(*by).agg(F.count_if(m).alias("n"), on(term).alias("term"), on(p * t).alias("inter"), (on(p) + on(t) + EPS).alias("denom"))
    dice = 1 - (2 * F.col("inter") + EPS) / F.col("denom")
    return s.select(*by, "n", F.when(F.col("n") == 0, 0.0).otherwise(0.5 * F.col("term") / F.col("n") + 0.5 * dice).alias("loss"))


def hard_loss(pixels: DataFrame, by: list[str], logit: Column, t: Column, smooth: float = 1.0) -> DataFrame:
    """Half mean cross-entropy, half smoothed Dice, over all pixels."""
    p = sigmoid(logit)
    s = pixels.groupBy(*by).agg(F.avg(bce(logit, t)).alias("term"), F.sum(p * t).alias("inter"), F.sum(p).alias("sp"), F.sum(t).alias("st"))
    return s.select(*by, (0.5 * F.col("term") + 0.5 * (1 - (2 * F.col("inter") + smooth) / (F.col("sp") + F.col("st") + smooth))).alias("loss"))


def set_iou(a: DataFrame, b: DataFrame, eps: float = 1e-8) -> DataFrame:
    """Intersection over union of two pixel sets of each segment, from one union of marked rows."""
    key = ["seg_id", "y", "x"]
    every = a.select(*key, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select(*key, F.lit(0).alias("a"), F.lit(1).alias("b")))
    px = every.groupBy(*key).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    s = px.groupBy("seg_id").agg(F.sum(F.col("a") * F.col("b")).alias("inter"), F.sum("a").alias("na"), F.sum("b").alias("nb"))
    return s.select("seg_id", "inter", (F.col("na") + F.col("nb") - F.col("inter")).alias("union_px"), (F.col("inter") / (F.col("na") + F.col("nb") - F.col("inter") + eps)).alias("iou"))


def best_so_far(history: DataFrame, order: str, score: str, by: list[str]) -> DataFrame:
    """Marks the rows whose score strictly exceeds all before."""
    before = F.max(score).over(W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    return history.withColumn("is_best", before.isNull() | (F.col(score) > before))


def best_and_last(history: DataFrame, order: str, score: str, by: list[str]) -> DataFrame:
    """The row of the best score (the first of equals) and the last row of each group."""
    best = F.max_by(F.col(order), F.struct(F.col(score), -F.col(order)))
    return history.groupBy(*by).agg(best.alias("best"), F.max(score).alias("best_score"), F.max(order).alias("last"))


def append_history(history: DataFrame, path: str) -> None:
    """Adds epochs to a history table."""
    history.write.mode("append").parquet(path)


def read_history(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)
