"""Sharding by a minimax contiguous partition of atomic groups.

Rows with equal texts form one group that no shard may split.  Groups are put
in the order of their smallest id; shards are runs of that order.  The
smallest shard capacity for which a greedy walk needs no more than ``shards``
runs is found by binary search, exactly.

The walk never sees the groups themselves.  The order is cut into numeric
intervals; Spark sums each (bytes, rows, largest group), and the driver holds
at most ``BLOCKS`` intervals at a time.  A walk that treats intervals as
divisible gives a lower bound of the capacity, one that treats them as atoms
gives an upper bound; intervals in which a cut of either may fall are split
further in the next round, until both bounds meet.  Then the cuts lie between
intervals and are exact.  A few rounds do for any size, for each splits its
intervals many times over.

Among the cuts that respect the optimum, those nearest to equal shares are
taken, with groups larger than a share set apart: one huge group then doesn't
leave the other shards empty.

Null text counts as empty; rows with a null id belong to their text's group,
and a group without any id comes first.  Rows that share an id are counted
each.  Empty tables give empty results.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Intervals that the driver holds at most, about.
BLOCKS = 8192
OVERHEAD = 16


@dataclass(frozen=True)
class Block:
    """The groups whose key is in [low, high): their sizes' sum, number, maximum."""

    low: int
    high: int
    size: int
    groups: int
    largest: int

    @property
    def whole(self) -> bool:
        return self.groups <= 1 or self.high - self.low <= 1


def _prefix(blocks: list[Block]) -> list[int]:
    out = [0]
    for b in blocks:
        out.append(out[-1] + b.size)
    return out


def _walk(blocks: list[Block], at: list[int], capacity: int, fluid: bool) -> list[int]:
    """Greedy cut positions, in units of size; ``fluid``: intervals may be cut anywhere."""
    cuts, here, total = [], 0, at[-1]
    while here < total:
        reach = here + capacity
        k = bisect_right(at, reach) - 1
        if k < len(blocks) and fluid and not blocks[k].whole:
            there = reach
        else:
            there = at[k]
        if there <= here:
            return []  # a block larger than the capacity
        cuts.append(min(there, total))
        here = there
    return cuts


def _capacity(blocks: list[Block], at: list[int], shards: int, fluid: bool) -> int:
    low = max([-(-at[-1] // shards), *((b.largest if fluid else b.size) for b in blocks)])
    high = max(low, at[-1])
    while low < high:
        mid = (low + high) // 2
        cuts = _walk(blocks, at, mid, fluid)
        if cuts and len(cuts) <= shards:
            high = mid
        else:
            low = mid + 1
    return low


def _doubtful(blocks: list[Block], at: list[int], shards: int, low: int, high: int) -> set[int]:
    """Intervals in which a cut may fall for some capacity in [low, high], or that keep the bounds apart."""
    doubt = {i for i, b in enumerate(blocks) if b.size > low and not b.whole}
    first, last = 0, 0
    for _ in range(shards):
        first, last = first + low, last + high
        a = max(0, bisect_right(at, max(0, first)) - 1)
        # the lower walk can lose up to the largest interval at each cut
        b = min(len(blocks) - 1, bisect_left(at, min(last, at[-1])))
        doubt.update(i for i in range(max(0, a - 1), b + 1) if not blocks[i].whole)
        k = bisect_right(at, first) - 1
        first = at[k] if k < len(at) else at[-1]
        if first >= at[-1]:
            break
    return doubt


def _fair_cuts(blocks: list[Block], at: list[int], shards: int, capacity: int) -> list[int]:
    """Indices into ``at`` where shards end: each within capacity, as even as may be."""
    n = len(blocks)
    # need[i]: fewest shards for blocks i.. ; by greedy walks, since blocks are final now
    need = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        need[i] = 1 + need[bisect_right(at, at[i] + capacity) - 1]
    large = sorted(((b.size, i) for i, b in enumerate(blocks) if b.groups == 1), reverse=True)[:shards]
    ends, here = [], 0
    for k in range(shards):
        left = shards - k
        rest = at[n] - at[here]
        share, count = rest, left
        for size, i in large:  # groups above a fair share stand apart
            if i >= here and count > 1 and size * count > share:
                share, count = share - size, count - 1
        target = at[here] + -(-share // count)
        top = bisect_right(at, at[here] + capacity) - 1
        j = min(bisect_left(at, target), n)
        if j > here + 1 and at[j] - target > target - at[j - 1]:
            j -= 1
        j = min(max(j, here), top) if left > 1 else n
        while j < top and need[j] > left - 1:
            j += 1
        ends.append(j)
        here = j
    return ends


def _summed(groups: DataFrame, origin: int, width: int, blocks: list[tuple[int, int, int]]) -> list[Block]:
    """Sums over the intervals (low, high, step): [low, low+step), [low+step, ...).

    Each interval lies in one cell [origin + k * width, ...), which keys the join.
    """
    spark = groups.sparkSession
    plan = spark.createDataFrame([(*b, (b[0] - origin) // width) for b in blocks], "_sh_low long, _sh_high long, _sh_step long, _sh_cell long")
    lows = F.broadcast(plan)  # at most BLOCKS rows
    celled = groups.withColumn("_sh_cell", F.expr(f"(_sh_first - ({origin}L)) div {width}L"))
    inside = celled.join(lows, "_sh_cell").filter((F.col("_sh_first") >= F.col("_sh_low")) & (F.col("_sh_first") < F.col("_sh_high")))
    cell = F.expr("_sh_low + (_sh_first - _sh_low) div _sh_step * _sh_step")
    rows = inside.groupBy(cell.alias("low"), F.least(cell + F.col("_sh_step"), F.col("_sh_high")).alias("high")).agg(F.sum("_sh_bytes").alias("size"), F.count("*").alias("groups"), F.max("_sh_bytes").alias("largest")).collect()
    return [Block(int(r["low"]), int(r["high"]), int(r["size"]), int(r["groups"]), int(r["largest"])) for r in rows]


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[list[int], int]:
    """Keys at which shards 1, 2, ... begin, and the smallest feasible capacity.

    ``groups``: _sh_first (distinct keys) and _sh_bytes.
    """
    edge = groups.agg(F.min("_sh_first").alias("a"), F.max("_sh_first").alias("b")).first()
    if edge["a"] is None:
        return [], 0
    low, high = int(edge["a"]), int(edge["b"]) + 1
    width = max(1, -(-(high - low) // BLOCKS))
    blocks = _summed(groups, low, high - low, [(low, high, width)])
    while True:
        blocks.sort(key=lambda b: b.low)
        at = _prefix(blocks)
        under, over = _capacity(blocks, at, shards, True), _capacity(blocks, at, shards, False)
        doubt = _doubtful(blocks, at, shards, under, over) if under < over else set()
        if under < over and not doubt:  # what isn't settled yet is cut finer; blocks of one group each are exact
            doubt = {i for i, b in enumerate(blocks) if b.groups > 1}
        if not doubt:
            break
        each = max(2, BLOCKS // len(doubt))
        finer = _summed(groups, low, width, [(b.low, b.high, max(1, -(-(b.high - b.low) // each))) for b in (blocks[i] for i in sorted(doubt))])
        blocks = [b for i, b in enumerate(blocks) if i not in doubt] + finer
    starts = [b.low for b in blocks] + [high]
    return [starts[k] for k in _fair_cuts(blocks, at, shards, over)[:-1]], over


def assign_shards(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's size, text CRC, shard and gapless slot (order: group, id)."""
    if shards < 1:
        raise ValueError("shards must be positive")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("_sh_id"),
        (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("_sh_size"),
        F.crc32(text.cast("binary")).alias("_sh_crc"),
        F.sha2(text, 256).alias("_sh_sha"),
    )
    groups = rows.groupBy("_sh_sha").agg(F.min("_sh_id").alias("_sh_first"), F.sum("_sh_size").alias("_sh_bytes"))
    # A group without any id gets the key below all others; several such have different texts but one key, and stay together.
    groups = materialize(groups.withColumn("_sh_first", F.coalesce("_sh_first", F.lit(-(1 << 62)))), "shard-groups")
    sums = groups.groupBy("_sh_first").agg(F.sum("_sh_bytes").alias("_sh_bytes")) if groups.filter(F.col("_sh_first") == -(1 << 62)).limit(1).count() else groups
    begins, _ = minimax_cuts(sums, shards)
    # shard: how many of the 39 cuts lie at or before the group's key
    shard = F.lit(0)
    for key in begins:
        shard = shard + (F.col("_sh_first") >= F.lit(key)).cast("int")
    placed = rows.join(groups.select("_sh_sha", "_sh_first"), "_sh_sha").select("_sh_id", "_sh_size", "_sh_crc", "_sh_first", shard.cast("int").alias("_sh_shard"))
    ranged = materialize(
        placed.repartitionByRange("_sh_first", "_sh_id").sortWithinPartitions("_sh_first", "_sh_id").withColumn("_sh_at", F.monotonically_increasing_id()),
        "shard-order",
    )
    part = F.shiftright("_sh_at", 33)
    counts = [tuple(r) for r in ranged.groupBy(part.alias("p"), "_sh_shard").agg(F.min("_sh_at"), F.count("*")).collect()]
    base, offsets = {}, []
    for p, s, first, n in sorted(counts):
        offsets.append((p, s, base.get(s, 0) - first))
        base[s] = base.get(s, 0) + n
    # one row for each partition and shard that meet: partitions + shards rows at most
    shift = docs.sparkSession.createDataFrame(offsets, "_sh_p long, _sh_shard int, _sh_shift long")
    slotted = ranged.withColumn("_sh_p", part).join(F.broadcast(shift), ["_sh_p", "_sh_shard"])
    return slotted.select(
        F.col("_sh_id").alias(id_col),
        F.col("_sh_size").alias("size"),
        F.col("_sh_crc").cast("long").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("_sh_shard").alias("shard"),
        (F.col("_sh_at") + F.col("_sh_shift")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
