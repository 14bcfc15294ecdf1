"""Decisions on tables: ensemble, stake, verdict, budget."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Verdict thresholds and names, re-entry share.
STRONG, WEAK = 0.5, 0.1
VERDICTS = ("Strong Buy", "Buy", "Strong Sell", "Sell", "Hold/Neutral")
REENTRY_SHARE = 0.9


def accuracy(df: DataFrame, label: str, prediction: str, key: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*key).agg(F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("accuracy"))


def ensemble(probabilities: Sequence[str]) -> Column:
    return sum((F.col(c) for c in probabilities), F.lit(0.0)) / len(probabilities)


def kelly(p: Column) -> Column:
    """Stake of an even bet: 2p - 1."""
    return 2 * p - 1


def ensemble_kelly(first: DataFrame, second: DataFrame, on: Sequence[str], p: str = "p") -> DataFrame:
    """Mean of two models' probabilities for the rows both have, and the stake."""
    both = first.select(*on, F.col(p).alias("p_first")).join(second.select(*on, F.col(p).alias("p_second")), list(on))
    both = both.withColumn("p_up", ensemble(["p_first", "p_second"]))
    return both.withColumn("kelly", kelly(F.col("p_up")))


def verdict(stake: Column) -> Column:
    buy_most, buy, sell_most, sell, hold = VERDICTS
    return (
        F.when(stake > STRONG, buy_most)
        .when(stake > WEAK, buy)
        .when(stake < -STRONG, sell_most)
        .when(stake < -WEAK, sell)
        .otherwise(hold)
    )


def latest(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row of each key: one aggregate with map-side combine."""
    row = F.max_by(F.struct(*[F.col(c) for c in df.columns]), F.struct(*order)).alias("r")
    return df.groupBy(*key).agg(row).select("r.*")


def stocks_report(scored: DataFrame, key: str = "ticker", order: str = "bar_ts") -> DataFrame:
    """Per key: recommendation, probability, current price, and a re-entry price when it says sell."""
    last = latest(scored, [key], [order])
    buy = F.col("prediction") == 1
    return last.select(
        key,
        F.when(buy, "Buy").otherwise("Sell").alias("recommendation"),
        F.col("probability"),
        F.col("close").alias("current_price"),
        F.when(~buy, F.col("close") * REENTRY_SHARE).alias("reentry_price"),
    )


def signal_points(bars: DataFrame, predictions: DataFrame, on: Sequence[str]) -> DataFrame:
    """Close price at the rows predicted up (buy) and down (sell)."""
    side = F.when(F.col("prediction") == 1, "buy").when(F.col("prediction") == 0, "sell")
    return (
        bars.join(predictions.select(*on, "prediction"), list(on))
        .select(*on, "close", side.alias("side"))
        .filter(F.col("side").isNotNull())
    )


def importance_rank(contributions: DataFrame, features: Sequence[str], k: int | None = None) -> DataFrame:
    """Mean absolute contribution per feature, largest first."""
    wide = contributions.agg(*[F.avg(F.abs(c)).alias(c) for c in features])
    long = wide.unpivot([], list(features), "feature", "importance")
    ranked = long.orderBy(F.desc("importance"), F.asc("feature"))
    return ranked.limit(k) if k else ranked


def budget_allocate(
    offers: DataFrame, key: Sequence[str], item: str, probability: str, price: str, budget: float = 100.0, k: int = 3
) -> DataFrame:
    """The ``k`` likeliest items per key, bought one after the other while the budget lasts.

    Shares are as many as the rest of the budget pays for, at least one; an
    item that would overrun the budget is passed over.  Only ``k`` rows per key
    are gathered, and the row limit works before the shuffle.
    """
    w = Window.partitionBy(*key).orderBy(F.desc_nulls_last(probability), F.asc(item))
    best = offers.withColumn("__rank", F.row_number().over(w)).filter(F.col("__rank") <= k)
    offer = F.struct(
        F.col("__rank").alias("rank"), F.col(item).alias("item"), F.col(probability).alias("probability"),
        F.col(price).cast("double").alias("price"),
    )
    lists = best.groupBy(*key).agg(F.sort_array(F.collect_list(offer)).alias("offers"))
    id_type = dict(offers.dtypes)[item]
    p_type = dict(offers.dtypes)[probability]
    kept = f"array<struct<item:{id_type},probability:{p_type},price:double,shares:bigint,cost:double>>"
    start = F.struct(F.lit(0.0).alias("spent"), F.array().cast(kept).alias("bought"))

    def buy(state: Column, o: Column) -> Column:
        rest = F.lit(float(budget)) - state["spent"]
        # whole shares as the exact remainder leaves them; a plain quotient may round up
        whole = F.round(F.try_divide(rest - F.try_mod(rest, o["price"]), o["price"]))
        shares = F.greatest(whole.cast("bigint"), F.lit(1).cast("bigint"))
        cost = shares * o["price"]
        one = F.struct(
            o["item"].alias("item"), o["probability"].alias("probability"), o["price"].alias("price"),
            shares.alias("shares"), cost.alias("cost"),
        )
        fits = state["spent"] + cost <= budget
        return F.struct(
            F.when(fits, state["spent"] + cost).otherwise(state["spent"]).alias("spent"),
            F.when(fits, F.concat(state["bought"], F.array(one))).otherwise(state["bought"]).cast(kept).alias("bought"),
        )

    done = lists.withColumn("__state", F.aggregate("offers", start, buy))
    return done.select(*key, F.inline("__state.bought")).withColumnRenamed("item", item)
