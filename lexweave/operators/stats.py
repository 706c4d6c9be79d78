"""Bootstrap, multiple tests and latency summaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type


#: The modulus of hashed draws: 2 ** 31 - 1.
PRIME = 2147483647
#: The shares of a Poisson(1) weight of at most 0, 1, 2, ... 7.
POISSON = np.cumsum([np.exp(-1) / f for f in (1, 1, 2, 6, 24, 120, 720, 5040)])


def paired_difference_ci(base: np.ndarray, head: np.ndarray, n_resamples: int, seed: int, level: float = 0.95) -> tuple[float, float, float]:
    """Point, low and high of the mean difference, by the percentile bootstrap over resampled cases."""
    if len(base) != len(head) or not len(base):
        raise ValueError("base and head need the same number of cases, and one at least")
    if not 0 < level < 1 or n_resamples < 1:
        raise ValueError("level lies between 0 and 1, and there is at least one resample")
    d = np.asarray(head, dtype=float) - np.asarray(base, dtype=float)
    rng = np.random.default_rng(seed)
    means = np.empty(n_resamples)
    step = max(1, (1 << 22) // len(d))
    for at in range(0, n_resamples, step):
        m = min(step, n_resamples - at)
        means[at : at + m] = d[rng.integers(0, len(d), size=(m, len(d)))].mean(axis=1)
    low, high = np.quantile(means, [(1 - level) / 2, (1 + level) / 2])
    return float(d.mean()), float(low), float(high)


def bootstrap_ci(scores: DataFrame, n_resamples: int, seed: int, level: float = 0.95, by: str = "metric") -> DataFrame:
    """(``by``, point, low, high, n) from (``by``, case_id, base, head): the percentile bootstrap of the mean difference.

    Cases count by their difference: a difference that n cases have is drawn
    Poisson(n) times in each resample, from a generator of its own, so the result
    does not depend on partitioning and the work is differences by resamples, however
    many cases there are. A task adds up its differences; no task holds a set of cases.
    """
    values = scores.groupBy(by, (F.col("head").cast("double") - F.col("base").cast("double")).alias("d")).agg(F.count("*").alias("n"))
    values = values.select(by, "d", "n", F.xxhash64(by, "d", F.lit(seed)).alias("own"))
    kind = scores.schema[by].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}

        def told() -> pa.RecordBatch:
            names = list(sums)
            columns = [pa.array([m for m in names for _ in range(n_resamples)], to_arrow_type(kind)), pa.array(np.tile(np.arange(n_resamples, dtype=np.int32), len(names))), *(pa.array(np.concatenate([sums[m][k] for m in names] or [np.empty(0)])) for k in (0, 1))]
            return pa.RecordBatch.from_arrays(columns, names=[by, "r", "w", "s"])

        for b in batches:
            for m, d, n, own in zip(*(c.to_pylist() for c in b.columns)):
                drawn = np.random.default_rng(own & (2**64 - 1)).poisson(n, n_resamples).astype(float)
                if m not in sums and len(sums) >= 64:
                    yield told()
                    sums.clear()
                held = sums.setdefault(m, [np.zeros(n_resamples), np.zeros(n_resamples)])
                held[0] += drawn
                held[1] += drawn * d
        if sums:
            yield told()

    parts = values.mapInArrow(run, f"{by} {kind.simpleString()}, r int, w double, s double")
    means = parts.groupBy(by, "r").agg(F.sum("w").alias("w"), F.sum("s").alias("s")).where("w > 0").select(by, (F.col("s") / F.col("w")).alias("m"))
    return _intervals(scores, means, level, by)


def _intervals(scores: DataFrame, means: DataFrame, level: float, by: str) -> DataFrame:
    interval = means.groupBy(by).agg(F.percentile("m", (1 - level) / 2).alias("low"), F.percentile("m", (1 + level) / 2).alias("high"))
    point = scores.groupBy(by).agg(F.avg(F.col("head") - F.col("base")).alias("point"), F.count("*").alias("n"))
    return point.join(interval, by).select(by, "point", "low", "high", "n")


def bootstrap_ci_hashed(scores: DataFrame, n_resamples: int, seed: int, level: float = 0.95, by: str = "metric") -> DataFrame:
    """The same interval with hashed resampling, built-in functions only: no task holds a set of cases.

    Each case's weight in a resample is Poisson(1) by the hash of resample and
    case, so resamples are sums that are taken before the shuffle. A case is hashed
    once, by MD5; case and resample are mixed by squares modulo a prime, which any
    engine's 64-bit integers hold.
    """
    p = F.lit(PRIME)
    case = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("case_id").cast("string"))), 1, 7), 16, 10).cast("bigint")
    first = (F.col("c") * 48271 + F.col("r") * 69621) % p
    second = (first * first + F.col("r")) % p
    third = (second * second + F.col("c")) % p
    u = (third * third + first) % p / F.lit(float(PRIME))
    weight = sum((F.when(F.col("u") >= float(b), 1).otherwise(0) for b in POISSON[1:]), F.when(F.col("u") >= float(POISSON[0]), 1).otherwise(0))
    hashed = scores.select(by, "base", "head", case.alias("c"))
    drawn = hashed.withColumn("r", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(n_resamples).cast("bigint")))).withColumn("u", u).withColumn("w", weight)
    means = drawn.groupBy(by, "r").agg((F.sum(F.col("w") * (F.col("head") - F.col("base"))) / F.sum("w")).alias("m"))
    return _intervals(scores, means, level, by)


def regression_flag(intervals: DataFrame, higher_is_better: str | bool = True) -> DataFrame:
    """Adds regression: the whole interval lies on the bad side of 0."""
    good = F.lit(higher_is_better) if isinstance(higher_is_better, bool) else F.col(higher_is_better)
    return intervals.withColumn("regression", F.when(good, F.col("high") < 0).otherwise(F.col("low") > 0))


def holm(pvalues: DataFrame, alpha: float = 0.05, name: str = "metric", p: str = "p", family: str | None = None) -> DataFrame:
    """Adds rank, limit (alpha / (m - rank + 1)) and rejected, by Holm's step-down; ties go by name.

    A family is one group of one task: tests, not data.
    """
    keys = [family] if family else [F.lit(0)]
    order = Window.partitionBy(*keys).orderBy(p, name)
    ranked = pvalues.withColumn("rank", F.row_number().over(order)).withColumn("limit", F.lit(alpha) / (F.count("*").over(Window.partitionBy(*keys)) - F.col("rank") + 1))
    run = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranked.withColumn("rejected", F.min((F.col(p) <= F.col("limit")).cast("int")).over(run) == 1)


def p95(x: str):
    """An aggregate: the 95th percentile, linear between ranks; 0 of nothing."""
    return F.coalesce(F.percentile(x, 0.95), F.lit(0.0))


def bench_summary(latencies: DataFrame, dropped: int = 5, budgets: DataFrame | None = None) -> DataFrame:
    """(stage, p95, amber): the worst repetition's 95th percentile without each repetition's first requests.

    ``latencies``: repetition, request (its number), stage, ms; ``budgets``: stage, budget_ms.
    """
    order = Window.partitionBy("repetition", "stage").orderBy("request")
    kept = latencies.withColumn("_n", F.row_number().over(order)).where(F.col("_n") > dropped)
    worst = kept.groupBy("stage", "repetition").agg(p95("ms").alias("p95")).groupBy("stage").agg(F.max("p95").alias("p95"))
    if budgets is None:
        return worst
    return worst.join(budgets, "stage", "left").withColumn("amber", F.coalesce(F.col("p95") > F.col("budget_ms"), F.lit(False))).drop("budget_ms")
