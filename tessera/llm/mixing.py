"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in an order given by a hash of doc_id, are cut into blocks of ``block_rows``. A source with
``share`` of ``total`` integer shares gets a release time floor((j - 1) * total / share) and a deadline
ceil(j * total / share) for its j-th block. Of the released blocks the one with the earliest deadline takes the next
slot. For unit blocks in one sequence this meets every deadline, so at every slot each source is less than one block
away from its target. Shares are the weights themselves, as exact fractions: nothing is rounded, so the deviation stays
below one block at every number of slots. One task makes the plan (a row for each block, so rows / ``block_rows``),
batch by batch, and holds the sources only; documents meet their blocks' rows in a join.
More than ``MAX_SOURCES`` sources are dealt into groups by a hash (and groups into groups, where they are as many): the
groups are scheduled by the same rule with the sums of their weights, and the places that a group gets go to its
sources by the same rule, each group in a task of its own. A source is then less than one block from its share of its
group and the group less than one block from its target: less than two blocks with groups, three with groups of groups.
A source that ends leaves its share to its group, and ``phase`` counts the ends in the source's groups: 0 is the
source's full target.

When a source has no block left, the rest go on with their own shares as the weights (a new phase); every document
gets a place, and ``phase`` 0 is the mixture at full target.

Ranks are found without sorting a source in one task: documents fall into buckets by the hash's leading bits, buckets
are counted and summed, and rows are numbered inside (source, bucket) only. A source with a third of all rows has as
many times more buckets' rows to spread. The plan is broadcast only if counted small.

Defined cases: null is a source of its own; sources without a weight get none of the weighted phases and follow at
the end, by their size; weights that aren't positive count as absent; rows that repeat take places of their own;
rows without an id are ordered by a hash of all their columns;
texts are not read; an empty table gives an empty result; columns named block, slot, position or phase are replaced.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice
from math import gcd, lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import broadcast_if_small, shared, workers_find_package

BLOCK_ROWS = 64
#: Sources that one task schedules; more are dealt into groups.
MAX_SOURCES = 2000
BUCKET_ROWS = 1024
MAX_BUCKETS = 1 << 20
#: Rows of the plan that a task gives out at once.
PLAN_ROWS = 1 << 16
#: Weights of the registered query: a source of n documents weighs n ** TEMPERATURE.
TEMPERATURE = 0.7


def exact_shares(weights: list[float]) -> list[int]:
    """The least integers in the very proportions of ``weights``; 0 for those that aren't positive."""
    exact = [Fraction(w) if w > 0 else Fraction(0) for w in weights]
    scale = lcm(*(x.denominator for x in exact))
    shares = [int(x * scale) for x in exact]
    return [s // (gcd(*shares) or 1) for s in shares]


def order(shares: list[int]) -> Iterator[int]:
    """The source of each slot, without end: earliest deadline first among released blocks."""
    total = sum(shares)
    waiting = [(0, i, 1) for i in range(len(shares))]  # release, source, block number
    ready: list[tuple[int, int, int]] = []  # deadline, source, block number
    slot = 0
    while True:
        while waiting and waiting[0][0] <= slot:
            _, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-j * total // shares[i]), i, j))
        _, i, j = heapq.heappop(ready)
        yield i
        heapq.heappush(waiting, (j * total // shares[i], i, j + 1))
        slot += 1


def period(shares: list[int]) -> list[int]:
    """The source of each slot of one period; all deviations are 0 at its end."""
    return list(islice(order(shares), sum(shares)))


def slots(blocks: list[int], shares: list[int]) -> Iterator[tuple[int, int, int]]:
    """source, block (its number in the source) and phase of each slot, until every block has one. A phase ends before
    the first slot whose source has no block left."""
    left, phase = list(blocks), 0
    while active := [i for i, n in enumerate(left) if n]:
        if any(shares[i] for i in active):  # sources without a weight wait until the others are through
            active = [i for i in active if shares[i]]
            weights = [shares[i] for i in active]
        else:
            weights = [left[i] for i in active]
        for k in order(weights):
            i = active[k]
            if not left[i]:
                break
            yield i, blocks[i] - left[i], phase
            left[i] -= 1
        phase += 1


def phases(blocks: list[int], shares: list[int]) -> list[dict]:
    """``slots`` summed up, for each phase and source with blocks in it: source, phase, first (block), count, start
    (slot), total (slots of the phase), share (blocks of the source in it) and places (their slots from the start)."""
    out: dict[tuple[int, int], dict] = {}
    start, length = {}, {}
    for slot, (i, block, phase) in enumerate(slots(blocks, shares)):
        place = slot - start.setdefault(phase, slot)
        length[phase] = place + 1
        out.setdefault((phase, i), {"source_no": i, "phase": phase, "first": block, "start": start[phase], "places": []})["places"].append(place)
    return [p | {"count": len(p["places"]), "share": len(p["places"]), "total": length[p["phase"]]} for p in out.values()]


def _scheduled(nodes: DataFrame) -> DataFrame:
    """_group, _key, _block, _slot (in the group's own sequence), _phase for every block of ``nodes`` (_group, _key,
    _blocks, _weight)."""
    kind = nodes.schema["_key"].dataType.simpleString()
    members = nodes.groupBy("_group").agg(F.sort_array(F.collect_list(F.struct("_key", "_blocks", "_weight"))).alias("members"))

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                group, held = b.column(0)[k].as_py(), b.column(1).slice(k, 1).flatten()
                keys, blocks, weights = (held.field(i) for i in range(3))
                slot, rows = 0, slots(blocks.to_pylist(), exact_shares(weights.to_pylist()))
                while part := list(islice(rows, PLAN_ROWS)):
                    at, block, phase = np.array(part, np.int64).T
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), group)), keys.take(pa.array(at)), pa.array(block), pa.array(np.arange(slot, slot + len(part))), pa.array(phase.astype(np.int32))], ["_group", "_key", "_block", "_slot", "_phase"])
                    slot += len(part)

    return members.mapInArrow(run, f"_group bigint, _key {kind}, _block bigint, _slot bigint, _phase int")


def _plan(sources: DataFrame, count: int, most: int) -> DataFrame:
    """_key, _block, _slot, _phase for every block of the ``count`` ``sources`` (_key, _blocks, _weight)."""
    nodes, plan, level = sources, None, 0
    while True:
        whole = count <= most
        groups = max(1, -(-2 * count // most))  # half full by the mean, so a hash fills none far beyond
        # a group's sources all have a weight or all have none
        group = F.lit(0) if whole else F.pmod(F.xxhash64(F.lit(level), "_key"), F.lit(groups)) * 2 + F.when(F.col("_weight") > 0, 1).otherwise(0)
        nodes = shared(nodes.withColumn("_group", group.cast("bigint")))
        within = shared(_scheduled(nodes))
        if plan is None:
            plan = within
        else:  # the group's sequence takes the slots of the group's blocks
            step = within.select(F.col("_group").alias("_up"), F.col("_key").alias("_node"), F.col("_block").alias("_place"), F.col("_slot").alias("_at"), F.col("_phase").alias("_more"))
            met = plan.join(step, (plan["_group"] == step["_node"]) & (plan["_slot"] == step["_place"]))
            plan = shared(met.select(F.col("_up").alias("_group"), "_key", "_block", F.col("_at").alias("_slot"), (F.col("_phase") + F.col("_more")).alias("_phase")))
        if whole:
            return plan.drop("_group")
        # weights are summed in one order, so that the sum is the same at every layout
        held = nodes.groupBy("_group").agg(F.sum("_blocks").alias("_blocks"), F.sort_array(F.collect_list("_weight")).alias("w"))
        nodes = shared(held.select(F.col("_group").alias("_key"), "_blocks", F.aggregate("w", F.lit(0.0), lambda x, y: x + y).alias("_weight")))
        count, level = nodes.count(), level + 1


def mix(docs: DataFrame, weights: dict | None = None, temperature: float = TEMPERATURE, block_rows: int = BLOCK_ROWS, seed: int = 0) -> DataFrame:
    """``docs`` (doc_id, source, any more columns) with block (its number in the source), slot, position (ascending
    through the whole mixture) and phase. ``weights``: target weight of each source; without it n ** ``temperature``."""
    spark = docs.sparkSession
    workers_find_package(spark)
    docs = docs.drop("block", "slot", "position", "phase")
    counted = docs.groupBy(F.col("source").alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    if weights is None:
        target = counted.withColumn("_weight", F.pow(F.col("_n").cast("double"), F.lit(float(temperature))))
    else:
        kind = docs.schema["source"].dataType.simpleString()
        given = spark.createDataFrame([(k, float(w)) for k, w in weights.items()], f"_given {kind}, _weight double")
        target = counted.join(given, counted["_key"].eqNullSafe(given["_given"]), "left").drop("_given")
    aims = F.when((F.col("_weight") > 0) & ~F.isnan("_weight"), F.col("_weight")).otherwise(F.lit(0.0))
    sources = shared(target.select("_key", "_n", F.ceil(F.col("_n") / block_rows).cast("bigint").alias("_blocks"), aims.alias("_weight")))
    shape = sources.agg(F.count(F.lit(1)).alias("sources"), F.sum("_n").alias("rows"), F.sum("_blocks").alias("blocks")).first()
    plan = _plan(sources.drop("_n"), shape.sources, MAX_SOURCES)

    buckets = 1
    while buckets < MAX_BUCKETS and (shape.rows or 0) > buckets * BUCKET_ROWS:
        buckets *= 2
    whole = [F.col(f"`{f.name}`") for f in docs.schema if not f.dataType.simpleString().count("map<")]
    hashed = F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit(seed), *whole)).otherwise(F.xxhash64(F.lit(seed), F.col("doc_id")))
    keyed = docs.withColumn("_order", hashed).withColumn("_bucket", F.pmod(F.shiftrightunsigned("_order", 32), F.lit(buckets)))
    # null equals null inside a struct, so the join below keeps to the window's partitions: texts shuffle once
    keyed = keyed.withColumn("_in", F.struct("source"))
    each = keyed.groupBy("_in", "_bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("_in").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = each.select(F.col("_in").alias("_s"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_in", "_bucket").orderBy("_order", "doc_id")
    ranked = keyed.withColumn("_rank", F.row_number().over(inside) - 1).join(offsets, (F.col("_in") == F.col("_s")) & (F.col("_bucket") == F.col("_b"))).withColumn("_rank", F.col("_rank") + F.col("_offset"))
    placed = ranked.withColumn("block", F.floor(F.col("_rank") / block_rows)).join(broadcast_if_small(plan, shape.blocks or 0), F.col("source").eqNullSafe(F.col("_key")) & (F.col("block") == F.col("_block")))
    return placed.select(*[F.col(f"`{c}`") for c in docs.columns], "block", F.col("_slot").alias("slot"), (F.col("_slot") * block_rows + F.col("_rank") % block_rows).alias("position"), F.col("_phase").alias("phase"))


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source"))
