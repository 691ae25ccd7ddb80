"""Exact percentiles of groups of any size, by counting ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.graph import cut

#: Parts into which a range is counted, and values of a range that are sorted as they are.
BINS, FEW = 1024, 1 << 15
#: Rounds after which a range is sorted whatever it holds; with BINS parts three or four do.
ROUNDS = 40
_RANGE = ["g", "lo", "hi"]


def _magnitude(v: Column) -> Column:
    """Grows with v as its logarithm does, on either side of zero."""
    return F.signum(v) * F.when(v == 0, 0.0).otherwise(F.log(F.abs(v)) + 745)  # the least positive double has a logarithm over -745


def _share(bins: int) -> Column:
    """Where v lies between lo and hi, from 0 to 1: by magnitudes in ranges of many, else by differences (of halves, which don't overflow)."""
    v, lo, hi = F.col("v"), F.col("lo"), F.col("hi")
    many = ((lo < 0) & (hi > 0)) | (F.greatest(F.abs(lo), F.abs(hi)) / bins > F.least(F.abs(lo), F.abs(hi)))
    between = lambda f: F.try_divide(f(v) - f(lo), f(hi) - f(lo))
    return F.when(many, between(_magnitude)).otherwise(between(lambda x: x / 2))


def _sorted(numbers: DataFrame, shares: dict[str, float]) -> DataFrame:
    """The percentiles of (g, v) where every group may be sorted as it is: nothing is counted, and one shuffle does."""
    every = W.partitionBy("g")
    ranked = numbers.withColumns({"k": F.row_number().over(every.orderBy("v")) - 1, "n": F.count("*").over(every)})

    def at(share: float) -> Column:
        r = F.lit(float(share)) * (F.col("n") - 1)
        pick = lambda rank: F.max(F.when(F.col("k") == rank, F.col("v")))
        return pick(F.floor(r)) + (pick(F.ceil(r)) - pick(F.floor(r))) * F.max(r - F.floor(r))

    return ranked.groupBy("g").agg(*(at(p).alias(n) for n, p in shares.items()))


def exact_percentiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float], bins: int = BINS, few: int = FEW) -> DataFrame:
    """keys and a column for each of shares (name: share from 0 to 1): percentiles of value, linear between neighbouring ranks.

    Null and NaN values don't count; a group without others has null percentiles. Null keys are keys like any other.

    Groups of `few` values or less are sorted as they are, whatever others there are. Of the rest there are at most a `few`-th of the rows, so a table
    of them is broadcast and their values are not shuffled.
    """
    group = F.struct(*(F.col(k).alias(f"k{n}") for n, k in enumerate(keys)))
    known = rows.select(group.alias("g"), F.col(value).cast("double").alias("v"))
    sizes = cut(known.groupBy("g").agg(F.count(F.when(~F.isnan("v"), F.col("v"))).alias("size")))
    large = sizes.where(F.col("size") > few).select("g")
    numbers = known.where("v is not null and not isnan(v)")
    out = sizes.where("size = 0").select("g", *(F.lit(None).cast("double").alias(n) for n in shares))
    if large.isEmpty():
        out = out.unionByName(_sorted(numbers, shares))
    else:
        out = out.unionByName(_sorted(numbers.join(F.broadcast(large), "g", "left_anti"), shares))
        out = out.unionByName(_counted(cut(numbers.join(F.broadcast(large), "g", "left_semi")), shares, bins, few))
    return out.select(*(F.col(f"g.k{n}").alias(k) for n, k in enumerate(keys)), *shares)


def _counted(numbers: DataFrame, shares: dict[str, float], bins: int, few: int) -> DataFrame:
    """The percentiles of (g, v) for few groups of many values.

    A rank is sought by its range of values: the range is cut into `bins` parts, which are counted (partial counts meet, not
    values), and the part that holds the rank is the next range, with the least and the greatest value in it. Once it holds `few` values or one value
    only, those are sorted. So no task sees a group's values together, and ranks are exact.
    """
    sizes = cut(numbers.groupBy("g").agg(F.count("v").alias("size"), F.min("v").alias("lo"), F.max("v").alias("hi")))
    ranks = F.array(*(F.struct(F.lit(n).alias("name"), (F.lit(float(p)) * (F.col("size") - 1)).alias("r")) for n, p in shares.items()))
    asked = cut(sizes.select("g", "size", "lo", "hi", F.explode(ranks).alias("a")).select("g", "size", "lo", "hi", "a.name", "a.r"))
    want = asked.select("g", "lo", "hi", F.lit(0).cast("long").alias("before"), "size", F.explode(F.array(F.floor("r"), F.ceil("r"))).alias("k")).distinct()
    done = None
    for number in range(ROUNDS + 1):
        want = cut(want)
        wide = (F.col("size") > few) & (F.col("lo") < F.col("hi")) & F.lit(number < ROUNDS)
        ready = want.where(~wide)
        done = ready if done is None else done.unionByName(ready)
        want = want.where(wide)
        if want.isEmpty():
            break
        ranges = want.select(*_RANGE).distinct()
        part = F.least(F.floor(F.coalesce(_share(bins), F.lit(0.0)) * bins), F.lit(bins - 1))
        counted = numbers.join(F.broadcast(ranges), "g").where(F.col("v").between(F.col("lo"), F.col("hi"))).groupBy(*_RANGE, part.alias("bin")).agg(F.count("*").alias("c"), F.min("v").alias("low"), F.max("v").alias("high"))
        upto = F.sum("c").over(W.partitionBy(*_RANGE).orderBy("bin"))
        found = want.join(counted.withColumn("upto", upto), _RANGE).where((F.col("k") >= F.col("before") + F.col("upto") - F.col("c")) & (F.col("k") < F.col("before") + F.col("upto")))
        want = found.select("g", F.col("low").alias("lo"), F.col("high").alias("hi"), (F.col("before") + F.col("upto") - F.col("c")).alias("before"), F.col("c").alias("size"), "k")
    done = cut(done)
    few_left = numbers.join(F.broadcast(done.where("lo < hi").select(*_RANGE, "before").distinct()), "g").where(F.col("v").between(F.col("lo"), F.col("hi")))
    place = F.row_number().over(W.partitionBy(*_RANGE).orderBy("v")) - 1 + F.col("before")
    sorted_ = few_left.withColumn("k", place).join(done.select(*_RANGE, "k").distinct(), [*_RANGE, "k"], "left_semi").select("g", "k", F.col("v").alias("x"))
    at = sorted_.unionByName(done.where("lo = hi").select("g", "k", F.col("lo").alias("x"))).groupBy("g", "k").agg(F.first("x").alias("x"))
    both = asked.select("g", "name", "r", F.floor("r").alias("k")).join(at.withColumnRenamed("x", "a"), ["g", "k"]).drop("k").withColumn("k", F.ceil("r")).join(at.withColumnRenamed("x", "b"), ["g", "k"])
    value_at = F.col("a") + (F.col("b") - F.col("a")) * (F.col("r") - F.floor("r"))
    return both.groupBy("g").agg(*(F.max(F.when(F.col("name") == n, value_at)).alias(n) for n in shares))
