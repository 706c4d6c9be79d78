"""Mixing sources to target weights by Pfair scheduling.

Each source's rows are dealt into blocks. With weight w (a share of the active
sources' total) the k-th block is released at slot floor((k - 1) / w) and due by
slot ceil(k / w). Slots are filled one by one with the released block that is due
first; on one resource with total weight 1 that meets every deadline, so at any
slot a source has less than one block more or less than its share. When a source
has given its last block, the others' weights are scaled up and a new phase
starts.

A phase's schedule repeats after as many slots as its integer weights add up to,
so the plan (one period for each phase, or less if the phase ends before) depends
on the weights and on each source's number of blocks only. Rows meet it by joins.
A plan of up to ``MAX_PLAN`` slots is sent to the tasks; a longer one is written
piece by piece and joined by shuffle.
"""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Callable, Iterator, Mapping
from functools import reduce
from itertools import islice

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

BLOCK_ROWS = 64
ROWS_PER_BUCKET = 256
#: Buckets whose sizes are summed up together.
BUCKETS_PER_GROUP = 1024
#: Slots of a plan that is sent to every task, at most, and of a piece of a longer one.
MAX_PLAN = 100_000


def period(weights: Mapping[str, int]) -> Iterator[tuple[str, int]]:
    """(source, k) for each slot of one period: earliest deadline first, ties to the smaller name."""
    total = sum(weights.values())
    waiting = [(0, s) for s in sorted(weights)]  # (release, source)
    ready: list[tuple[int, str, int]] = []
    given = dict.fromkeys(weights, 0)
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, s = heapq.heappop(waiting)
            k = given[s] + 1
            heapq.heappush(ready, (-(-k * total // weights[s]), s, k))
        _, s, k = heapq.heappop(ready)
        given[s] = k
        yield s, k
        if k < weights[s]:
            heapq.heappush(waiting, (k * total // weights[s], s))


def plan(weights: Mapping[str, int], blocks: Mapping[str, int], give: Callable[[list[tuple]], None] | None = None, most: int = MAX_PLAN) -> tuple[list[tuple], list[tuple]]:
    """Phases (source, phase, first block, blocks, weight, slots before, period) and their slots (source, phase, k, slot).

    No more than ``most`` slots are held: when there are as many, ``give`` takes them.
    """
    left = {s: n for s, n in blocks.items() if n > 0}
    first = dict.fromkeys(left, 0)
    phases, slots, before, number = [], [], 0, 0
    while left:
        divisor = math.gcd(*(weights[s] for s in left))
        own = {s: weights[s] // divisor for s in left}
        size = sum(own.values())
        took = dict.fromkeys(left, 0)
        place: dict[str, int] = {}  # where in a period each source's last block stands
        ended = 0
        for slot, (s, k) in enumerate(period(own)):
            slots.append((s, number, k - 1, slot))
            if give and len(slots) >= most:
                give(slots)
                slots = []
            took[s] = k
            if k == (left[s] - 1) % own[s] + 1:
                place[s] = slot
            if k == left[s]:
                ended = slot + 1  # the phase ends with the slot that takes a source's last block
                break
        if not ended:
            ended = min((n - 1) // own[s] * size + place[s] for s, n in left.items()) + 1
            whole, rest = divmod(ended, size)
            took = {s: whole * own[s] for s in left}
            for s, _ in islice(period(own), rest):
                took[s] += 1
        for s in list(left):
            phases.append((s, number, first[s], took[s], own[s], before, size))
            first[s] += took[s]
            left[s] -= took[s]
            if not left[s]:
                del left[s]
        before += ended
        number += 1
    return phases, slots


def mix_sources(docs: DataFrame, weights: Mapping[str, int], other_weight: int = 1, block_rows: int = BLOCK_ROWS, id_col: str = "doc_id", source_col: str = "source", rows_per_bucket: int = ROWS_PER_BUCKET, most: int = MAX_PLAN) -> DataFrame:
    """All rows and columns of ``docs``, with mix_source, block, slot and position (0-based, over all rows).

    ``weights`` are positive integers by source. Rows of any other source, and
    with a null source, form one more class with ``other_weight``. Within a source
    rows come in the order of buckets and MD5 of their id; equal rows (repeated, or with a
    null id) stand side by side in any order. No row is dropped: when a source
    ends, the others go on by their weights. An empty table gives an empty result.
    Columns of ``docs`` named like results are replaced.

    Positions inside a source come from bucket sizes: a source's rows are hashed
    into buckets of about ``rows_per_bucket``, the sizes are summed up over groups
    of buckets and inside them, and rows are numbered within their bucket. So no
    task holds a whole source, or all its buckets. Rows repeated under one id share
    a bucket.
    """
    spark = docs.sparkSession
    if any(w < 1 for w in [*weights.values(), other_weight]):
        raise ValueError("weights are positive integers")
    names = ["mix_source", "block", "slot", "position"]
    docs = docs.drop(*names)
    source = F.col(source_col).cast("string")
    # Classes carry a letter before their name, so that no source can be named like the class of others.
    kind = F.when(source.isin(list(weights)), F.concat(F.lit("s"), source)).otherwise(F.lit("o")) if weights else F.lit("o")
    own = {f"s{s}": w for s, w in weights.items()} | {"o": other_weight}
    sizes = {r.k: r["count"] for r in docs.groupBy(kind.alias("k")).count().collect()}  # one row for each class
    pieces: list[DataFrame] = []
    fields = "_k string, _phase int, _i bigint, _at bigint"
    written = lambda rows: _table(spark, [{"_k": s, "_phase": p, "_i": i, "_at": at} for s, p, i, at in rows], fields)
    phases, slots = plan(own, {k: -(-n // block_rows) for k, n in sizes.items()}, lambda rows: pieces.append(cut(written(rows))), most)

    buckets = F.element_at(F.create_map(*[F.lit(x) for k in own for x in (k, -(-sizes.get(k, 1) // rows_per_bucket))]), kind)
    drawn = F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, 15), 16, 10).cast("bigint")  # as any engine can draw
    rows = docs.withColumns({"_k": kind, "_h": drawn}).withColumn("_b", F.pmod("_h", buckets.cast("bigint")))
    counts = rows.groupBy("_k", "_b").count().withColumn("_g", F.floor(F.col("_b") / BUCKETS_PER_GROUP))
    groups = counts.groupBy("_k", "_g").agg(F.sum("count").alias("n"))
    groups = groups.select("_k", "_g", (F.sum("n").over(Window.partitionBy("_k").orderBy("_g")) - F.col("n")).alias("_start"))
    inner = F.sum("count").over(Window.partitionBy("_k", "_g").orderBy("_b")) - F.col("count")
    starts = counts.withColumn("_inner", inner).join(groups, ["_k", "_g"]).select("_k", "_b", (F.col("_start") + F.col("_inner")).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_k", "_b").orderBy("_h", F.col(id_col))) - 1
    rows = rows.withColumn("_in", inside).join(starts, ["_k", "_b"]).withColumn("_row", F.col("_start") + F.col("_in")).withColumn("_block", F.floor(F.col("_row") / block_rows))

    phase_rows, missing = [], 0
    ended = {s: (number, -sizes[s] % block_rows) for s, number, *_ in phases}  # the last phase of each class, and what its last block lacks
    for number in range(phases[-1][1] + 1 if phases else 0):
        phase_rows += [{"_k": s, "_phase": p, "_first": f, "_took": t, "_w": w, "_before": b, "_size": z, "_missing": missing} for s, p, f, t, w, b, z in phases if p == number and t]
        missing += sum(lack for p, lack in ended.values() if p == number)
    phase_table = _table(spark, phase_rows, "_k string, _phase int, _first bigint, _took bigint, _w bigint, _before bigint, _size bigint, _missing bigint")
    # There is a phase row for each class and phase, as many phases as classes; a slot table in one piece has ``most`` rows.
    slot_table = F.broadcast(written(slots)) if not pieces else reduce(DataFrame.unionByName, [*pieces, written(slots)])
    rows = rows.join(F.broadcast(phase_table), "_k").where((F.col("_block") >= F.col("_first")) & (F.col("_block") < F.col("_first") + F.col("_took")))
    turn = F.col("_block") - F.col("_first")
    rows = rows.withColumns({"_i": F.pmod(turn, "_w"), "_turn": F.floor(turn / F.col("_w"))}).join(slot_table, ["_k", "_phase", "_i"])
    slot = F.col("_before") + F.col("_turn") * F.col("_size") + F.col("_at")
    position = slot * block_rows - F.col("_missing") + F.col("_row") - F.col("_block") * block_rows
    return rows.select(*docs.columns, F.substring("_k", 2, 1 << 30).alias("mix_source") if weights else F.lit("").alias("mix_source"), F.col("_block").alias("block"), slot.alias("slot"), position.alias("position"))


def _table(spark, rows: list[dict], schema: str) -> DataFrame:
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))
