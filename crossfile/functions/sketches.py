"""Sketches beside exact counts: states that are kept for each reading and merged over readings, in any order."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Registers of a count of distinct values, as a power of two; and k of a sketch of quantiles.
REGISTERS, K = 12, 200


def distinct_bound(registers: int = REGISTERS, sigmas: float = 3.0) -> float:
    """The relative error that an estimate of distinct values stays within, at so many standard deviations."""
    return sigmas * 1.04 / math.sqrt(2**registers)


def rank_bound(k: int = K, sigmas: float = 3.0) -> float:
    """The error in rank, as a share, that a quantile stays within."""
    return sigmas / 2 * 2.296 / k**0.9021


def states(rows: DataFrame, by: list[str], distinct: Column, value: Column) -> DataFrame:
    """by, names (state of the distinct values), sizes (state of a number's quantiles), n: what a reading keeps."""
    return rows.groupBy(*by).agg(F.hll_sketch_agg(distinct, F.lit(REGISTERS)).alias("names"), F.kll_sketch_agg_double(value.cast("double"), F.lit(K)).alias("sizes"), F.count(F.lit(1)).alias("n"))


def merged(kept: DataFrame, by: list[str]) -> DataFrame:
    """The states of several readings as one."""
    return kept.groupBy(*by).agg(F.hll_union_agg("names").alias("names"), F.kll_merge_agg_double("sizes").alias("sizes"), F.sum("n").alias("n"))


def estimates(kept: DataFrame, quantiles: tuple[float, ...] = (0.5, 0.9)) -> DataFrame:
    """The states read: how many distinct values, and the quantiles."""
    rest = [c for c in kept.columns if c not in ("names", "sizes")]
    return kept.select(*rest, F.hll_sketch_estimate("names").alias("distinct"), *[F.kll_sketch_get_quantile_double("sizes", F.lit(q)).alias(f"q{round(100 * q)}") for q in quantiles])
