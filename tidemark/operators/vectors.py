"""Vectors by age: tiers, quantised forms, and sweeps that move vectors to their tier."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from tidemark.functions.scalars import age_days, tier_for_age
from tidemark.functions.texts import quantize_binary, quantize_int8

TIERS = ("full", "half", "int8", "binary")


@F.pandas_udf(ArrayType(FloatType()))
def quantize_f16(vectors: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Single precision with the mantissa cut to the 10 bits of half precision."""
    for series in vectors:
        out = [None if v is None else (np.asarray(v, dtype=np.float32).view(np.uint32) & np.uint32(0xFFFFE000)).view(np.float32) for v in series]
        yield pd.Series(out, dtype=object)


def quantize_for_tier(vector: Column, tier: Column) -> Column:
    """struct<numbers, low, step, codes, signs>: what a vector is stored as in its tier; the other fields are null."""
    int8 = F.when(tier == "int8", quantize_int8(vector))
    numbers = F.when(tier == "full", vector.cast("array<float>")).when(tier == "half", quantize_f16(vector))
    return F.struct(numbers.alias("numbers"), int8["low"].alias("low"), int8["step"].alias("step"), int8["codes"].alias("codes"), F.when(tier == "binary", quantize_binary(vector)).alias("signs"))


def compression_sweep(vectors: DataFrame, now: Column, most: int) -> DataFrame:
    """The oldest `most` vectors that are due for a coarser tier than they are stored in, with what they become. most bounds the work of one run; the next goes on."""
    names = F.array(*map(F.lit, TIERS))
    due = vectors.withColumn("tier", tier_for_age(age_days(now, F.col("created_at"))))
    due = due.where(F.array_position(names, F.col("tier")) > F.array_position(names, F.col("stored"))).orderBy("created_at", "vec_id").limit(most)
    return due.withColumn("quantized", quantize_for_tier(F.col("vector"), F.col("tier")))
