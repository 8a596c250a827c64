"""Price series: returns, trailing volatility, jump tests and the days they select."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METHODS = ("zscore", "lee_mykland")


def _by_date():
    return Window.partitionBy("asset").orderBy("date")


def _over(r: Column, sigma: Column) -> Column:
    """r / sigma; an infinite value over zero, null for zero over zero."""
    inf = F.when(r > 0, F.lit(float("inf"))).when(r < 0, F.lit(float("-inf")))
    return F.when(sigma == 0, inf).otherwise(r / sigma)


def log_returns(prices: DataFrame) -> DataFrame:
    """prices (asset, date, close) with ret, the log of the ratio to the day before; rows without a close are left out."""
    return prices.where("close is not null").withColumn("ret", F.ln(F.col("close") / F.lag("close").over(_by_date())))


def standardised(prices: DataFrame, window: int = 90, min_periods: int = 30) -> DataFrame:
    """ret, sigma (over the window that ends the day before) and z."""
    before = _by_date().rowsBetween(-window, -1)
    df = log_returns(prices).withColumn("sigma", F.when(F.count("ret").over(before) >= min_periods, F.stddev_samp("ret").over(before)))
    return df.withColumn("z", _over(F.col("ret"), F.col("sigma")))


def bipower(prices: DataFrame, k: int = 16) -> DataFrame:
    """ret and sigma from products of neighbouring absolute returns, over k - 2 of them that end the day before."""
    before = _by_date().rowsBetween(-(k - 2), -1)
    df = log_returns(prices)
    df = df.withColumn("_ap", F.abs("ret") * F.abs(F.lag("ret").over(_by_date())))
    sigma = F.when(F.count("_ap").over(before) == k - 2, F.sqrt(F.sum("_ap").over(before) / (k - 2)))
    return df.withColumn("sigma", sigma).drop("_ap")


def jump_test(prices: DataFrame, k: int = 16, alpha: float = 0.01) -> DataFrame:
    """ret, sigma, l, n_obs, threshold and is_jump by the Gumbel limit of the largest statistic.

    A series of fewer than two statistics has a null threshold and no jump. n_obs is one count per asset, joined back to its
    days: a hash aggregate instead of an unordered window that would hold a series at once.
    """
    df = bipower(prices, k).withColumn("l", _over(F.col("ret"), F.col("sigma")))
    n = df.groupBy("asset").agg(F.count("l").alias("n_obs"))
    c = math.sqrt(2 / math.pi)
    root = F.sqrt(2 * F.ln("n_obs"))
    centre = root / c - (math.log(math.pi) + F.ln(F.ln("n_obs"))) / (2 * c * root)
    beta = -math.log(-math.log(1 - alpha))
    threshold = F.when(F.col("n_obs") >= 2, centre + beta / (c * root))
    return df.join(n, "asset").withColumn("threshold", threshold).withColumn("is_jump", F.coalesce(F.abs("l") > F.col("threshold"), F.lit(False)))


def big_moves(prices: DataFrame, method: str = "zscore", z_threshold: float = 3.0, window: int = 90, k: int = 16, alpha: float = 0.01) -> DataFrame:
    """asset, date, score, direction and pct_move of the selected days; sort by score descending, then date, to read."""
    if method not in METHODS:
        raise ValueError(f"method is one of {METHODS}, not {method!r}")
    if method == "zscore":
        df = standardised(prices, window).withColumn("score", F.abs("z")).where(F.col("score") > z_threshold)
    else:
        df = jump_test(prices, k, alpha).withColumn("score", F.abs("l")).where("is_jump")
    up = F.when(F.col("ret") > 0, "up").otherwise("down")
    return df.select("asset", "date", "score", up.alias("direction"), ((F.exp("ret") - 1) * 100).alias("pct_move"))


def top_moves(moves: DataFrame, n: int = 25) -> DataFrame:
    """The n days of each asset with the highest score. A bounded rank: Spark keeps n rows a group before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("asset").orderBy(F.desc("score"), "date"))
    return moves.withColumn("rank", rank).where(F.col("rank") <= n)


def volatility_summary(prices: DataFrame, big: float = 0.02) -> DataFrame:
    r = log_returns(prices)
    return r.groupBy("asset").agg(
        (F.stddev_samp("ret") * 100).alias("daily_pct"),
        (F.stddev_samp("ret") * 100 * math.sqrt(252)).alias("yearly_pct"),
        ((F.exp(F.max(F.abs("ret"))) - 1) * 100).alias("largest_pct"),
        F.count_if(F.abs("ret") > big).alias("n_big"),
    )


def flagged_prices(moves: DataFrame, prices: DataFrame) -> DataFrame:
    """The close of each selected day."""
    return moves.join(prices.select("asset", "date", "close"), ["asset", "date"], "left")


def target_text(moves: DataFrame) -> DataFrame:
    """moves with target: what happened to the asset that day, in basis points."""
    bp = F.round(F.col("pct_move") * 100).cast("bigint").cast("string")
    return moves.withColumn("target", F.concat("asset", F.lit(" moved "), bp, F.lit(" bp on "), F.col("date").cast("string")))


def positional_ids(events: DataFrame, order: tuple[str, ...] = ("asset", "date")) -> DataFrame:
    """events with topic_id, their place from 0 in that order.

    Places are counted within assets, and the counts of the assets before are added, so no task holds all events.
    """
    first = order[0]
    before = F.sum("n").over(Window.orderBy(first).rowsBetween(Window.unboundedPreceding, -1))
    counts = events.groupBy(first).agg(F.count("*").alias("n")).withColumn("_before", F.coalesce(before, F.lit(0))).drop("n")
    place = F.row_number().over(Window.partitionBy(first).orderBy(*order[1:])) - 1
    return events.withColumn("_place", place).join(F.broadcast(counts), first).withColumn("topic_id", (F.col("_place") + F.col("_before")).cast("bigint")).drop("_place", "_before")
