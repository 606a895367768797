"""Long series without a task that holds one: as-of joins and decaying averages by stretches of time, with what is carried from one to the next.

Each series is cut into stretches by a column that grows with time (a day, a month). Rows meet within a stretch; between stretches only one row of each is looked at.
``price_bands`` and ``range_breaches`` are of the specification only: the reference describes them and has no code for them.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Weight of the variance so far when a new return comes.
DECAY = 0.94
#: Quantiles of the normal distribution for bands of 80 and 95 percent.
BANDS = {"80": 1.2815515655446004, "95": 1.959963984540054}
#: Business days of a horizon.
HORIZONS = {"1w": 5, "1m": 21, "3m": 63, "6m": 126, "1y": 252}


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, stretch: Column, tie: str, values: list[str]) -> DataFrame:
    """Every row of ``left`` with ``values`` of the last row of ``right`` at or before it, of equal times that of the greatest ``tie``; nulls if there is none.

    stretch: a column expression of ``at`` that never falls with time. A stretch of a key is one group: choose it so that it fits a task.
    """
    kept = F.struct(at, tie, *[v for v in values if v not in (at, tie)])
    own = left.select(*left.columns, stretch.alias("_s"), F.lit(None).cast(right.select(kept.alias("r")).schema["r"].dataType).alias("_r"), F.lit(1).alias("_side"))
    other = right.filter(F.col(at).isNotNull()).select(*[F.col(c) if c in keys or c == at else F.lit(None).cast(t).alias(c) for c, t in left.dtypes], stretch.alias("_s"), kept.alias("_r"), F.lit(0).alias("_side"))
    before = Window.partitionBy(*keys, "_s").orderBy(at, "_side", F.col(f"_r.{tie}")).rowsBetween(Window.unboundedPreceding, 0)
    met = own.unionByName(other).withColumn("_r", F.last("_r", ignorenulls=True).over(before))
    # One row a stretch: its last one, and with that the last of all stretches before.
    ends = right.filter(F.col(at).isNotNull()).groupBy(*keys, stretch.alias("_s")).agg(F.max_by(kept, F.struct(at, tie)).alias("_last"))
    asked = left.select(*keys, stretch.alias("_s")).distinct()
    earlier = Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.join(asked, [*keys, "_s"], "full_outer").withColumn("_carried", F.last("_last", ignorenulls=True).over(earlier)).select(*keys, "_s", "_carried")
    rows = met.filter("_side = 1").join(carried, [*keys, "_s"], "left").withColumn("_r", F.coalesce("_r", "_carried"))
    return rows.select(*left.columns, *[F.col(f"_r.{v}").alias(v) for v in values])


def ewma_variance(closes: DataFrame, key: str, at: str, close: str, stretch: Column, decay: float = DECAY) -> DataFrame:
    """(key, at, close, variance) of every close after its series' first: v = decay v + (1 - decay) r², r being the logarithm of close over the one before, v starting with the first r².

    Within a stretch the rule is applied row by row from 0; a stretch of n rows that begins with v adds decay^n v, so stretches are linked by two numbers each.
    """
    cut = closes.filter((F.col(close) > 0) & F.col(at).isNotNull()).select(key, at, close, stretch.alias("_s"))
    ends = cut.groupBy(key, "_s").agg(F.max_by(close, at).alias("_end"))
    linked = ends.withColumn("_before", F.lag("_end").over(Window.partitionBy(key).orderBy("_s"))).drop("_end")  # a row a stretch
    order = Window.partitionBy(key, "_s").orderBy(at)
    returns = cut.join(linked, [key, "_s"]).withColumn("_p", F.coalesce(F.lag(close).over(order), "_before")).filter("_p is not null").withColumn("_r2", F.pow(F.log(F.col(close) / F.col("_p")), 2))
    # The series' first return starts the variance: it weighs as if all before it had been like it.
    first = returns.groupBy(key).agg(F.min_by("_r2", at).alias("_v0"))
    types = dict(closes.dtypes)

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(at, kind="stable")
        v, out = 0.0, []
        for r2 in pdf["_r2"]:
            v = decay * v + (1 - decay) * r2
            out.append(v)
        return pdf[[key, at, close, "_s"]].assign(_v=out, _n=range(1, len(out) + 1))

    kind = dict(cut.dtypes)["_s"]
    inner = returns.groupBy(key, "_s").applyInPandas(within, f"{key} {types[key]}, {at} {types[at]}, {close} {types[close]}, _s {kind}, _v double, _n long")
    sums = inner.groupBy(key, "_s").agg(F.max("_n").alias("n"), F.max_by("_v", "_n").alias("v"))
    chain = sums.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_s", "n", "v"))).alias("c")).join(first, key)  # as many as the series has stretches
    state = F.struct(F.col("_v0").alias("v"), F.array().cast("array<double>").alias("starts"))
    step = lambda s, x: F.struct((F.pow(F.lit(decay), x["n"]) * s["v"] + x["v"]).alias("v"), F.concat(s["starts"], F.array(s["v"])).alias("starts"))
    starts = chain.select(key, F.explode(F.arrays_zip(F.col("c._s").alias("s"), F.aggregate("c", state, step)["starts"].alias("start"))).alias("z")).select(key, F.col("z.s").alias("_s"), F.col("z.start").alias("_start"))
    return inner.join(starts, [key, "_s"]).select(key, at, close, (F.pow(F.lit(decay), F.col("_n")) * F.col("_start") + F.col("_v")).alias("variance"))


def price_bands(variances: DataFrame, close: str, horizon: str) -> DataFrame:
    """Rows of ``ewma_variance`` with the bands of 80 and 95 percent at a horizon of ``HORIZONS``: the close times e to the power of ±z σ √days."""
    spread = F.sqrt(F.col("variance") * HORIZONS[horizon])
    ends = {f"{side}_{name}": F.col(close) * F.exp(sign * z * spread) for name, z in BANDS.items() for side, sign in (("low", -1), ("high", 1))}
    return variances.withColumns(ends)


def range_breaches(checks: DataFrame) -> DataFrame:
    """Rows (…, at, deadline, low, high, spot) with ``verdict``: a deadline that has passed, or no price, can't be judged; a price within the range leaves the advice valid, one outside asks for it anew."""
    verdict = F.when((F.col("at") > F.col("deadline")) | F.col("spot").isNull(), "undecidable").when(F.col("spot").between(F.col("low"), F.col("high")), "valid").otherwise("recalculate")
    return checks.withColumn("verdict", verdict)
