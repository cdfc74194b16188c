"""Shards of near equal bytes: a minimax contiguous partition of groups of equal texts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import stage

SHARDS = 16
#: Buckets of the key range that one job sums for the driver (a power of two); a bound, whatever the input's size.
BUCKETS = 1 << 14
#: Groups that the driver takes one by one at the last step.
SINGLES = 50_000
SPAN = 1 << 64


@dataclass
class Piece:
    """Groups whose keys lie in [lo, hi): their bytes, the largest group and how many they are."""

    lo: int
    hi: int
    size: int
    largest: int
    groups: int


def greedy(pieces: list[Piece], capacity: int, shards: int, anywhere: bool) -> list[int] | None:
    """Index of the piece in which each shard ends, filled in order as far as ``capacity`` allows; None if the shards don't suffice.

    A piece of several groups is cut where one likes if ``anywhere``, else not at all.
    """
    ends, room, left = [], capacity, shards - 1
    for i, p in enumerate(pieces):
        single = p.groups == 1 or not anywhere
        if (p.size if single else p.largest) > capacity:
            return None
        need = p.size
        while need > room:
            if not anywhere or p.groups == 1:
                ends.append(i - 1)
            else:
                need -= room
                ends.append(i)
            room, left = capacity, left - 1
            if left < 0:
                return None
        room -= need
    return ends


def smallest(pieces: list[Piece], shards: int, anywhere: bool) -> int:
    """The smallest capacity that is enough, by binary search."""
    total = sum(p.size for p in pieces)
    lo, hi = max(1, -(-total // shards)), max(1, total)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if greedy(pieces, mid, shards, anywhere) is not None else (mid + 1, hi)
    return lo


def _summed(groups: DataFrame, spans: list[tuple[int, int]], parts: int) -> list[Piece]:
    """The groups of each span, summed over ``parts`` slices of it (0: each group alone)."""
    step = {i: max(1, -(-(hi - lo) // parts)) if parts else 0 for i, (lo, hi) in enumerate(spans)}
    if spans == [(0, SPAN)]:
        rows = groups.withColumns({"i": F.lit(0), "lo": F.lit(-(SPAN // 2)), "step": F.lit(str(step[0]))})
    else:
        # a span lies in one bucket of the whole range, so rows meet it by an equal key
        shift = 64 - (BUCKETS.bit_length() - 1)
        data = [((lo - SPAN // 2) >> shift, lo - SPAN // 2, hi - 1 - SPAN // 2, i, str(step[i])) for i, (lo, hi) in enumerate(spans)]
        table = groups.sparkSession.createDataFrame(data, "bucket long, lo long, hi long, i int, step string").hint("broadcast")
        rows = groups.withColumn("bucket", F.shiftright("gkey", shift)).join(table, "bucket").filter(F.col("gkey").between(F.col("lo"), F.col("hi")))
    if not parts:
        return sorted((Piece(k := r["gkey"] + SPAN // 2, k + 1, r["size"], r["size"], 1) for r in rows.select("gkey", "size").collect()), key=lambda p: p.lo)
    at = F.floor((F.col("gkey").cast("decimal(20,0)") - F.col("lo").cast("decimal(20,0)")) / F.col("step").cast("decimal(20,0)")).cast("int")
    got = rows.groupBy("i", at.alias("at")).agg(F.sum("size").alias("size"), F.max("size").alias("largest"), F.count("*").alias("groups"), F.min("gkey").alias("k")).collect()
    out = []
    for r in got:
        lo = spans[r["i"]][0] + r["at"] * step[r["i"]]
        single = r["groups"] == 1
        k = r["k"] + SPAN // 2
        out.append(Piece(k if single else lo, k + 1 if single else min(lo + step[r["i"]], spans[r["i"]][1]), r["size"], r["largest"], r["groups"]))
    return sorted(out, key=lambda p: p.lo)


def cuts(groups: DataFrame, shards: int = SHARDS) -> tuple[int, list[int]]:
    """The minimax capacity over groups in key order, and the first key of each shard after the first (signed).

    ``groups``: gkey, size. The driver gets sums over a bounded number of key
    ranges. They bracket the capacity (ranges cut at will, or never) and so the
    ranges in which a cut can fall; only these are looked into more finely, until
    they hold single groups. The result is that of the search over all groups.
    """
    pieces = _summed(groups, [(0, SPAN)], BUCKETS)
    if not pieces:
        return 1, []
    while True:
        lo, hi = smallest(pieces, shards, True), smallest(pieces, shards, False)
        first, last = greedy(pieces, lo, shards, False), greedy(pieces, hi, shards, True)
        slow = first if first is not None else _prefix(pieces, lo, shards)
        open_ = set()
        for k in range(shards - 1):
            a = slow[k] if k < len(slow) else len(pieces) - 1
            b = last[k] if k < len(last) else len(pieces) - 1
            open_.update(i for i in range(max(0, a), min(len(pieces) - 1, b + 1) + 1) if pieces[i].groups > 1)
        if lo == hi or not open_:
            break
        spans = [(pieces[i].lo, pieces[i].hi) for i in sorted(open_)]
        few = sum(pieces[i].groups for i in open_) <= SINGLES
        finer = _summed(groups, spans, 0 if few else max(2, BUCKETS // len(spans)))
        pieces = sorted([p for i, p in enumerate(pieces) if i not in open_] + finer, key=lambda p: p.lo)
    capacity = smallest(pieces, shards, False)
    ends = greedy(pieces, capacity, shards, False)
    return capacity, [pieces[i + 1].lo - SPAN // 2 for i in ends]


def _prefix(pieces: list[Piece], capacity: int, shards: int) -> list[int]:
    """Where whole-piece shards of this capacity end, as far as they reach; a piece too large is a shard."""
    ends, room = [], capacity
    for i, p in enumerate(pieces):
        if p.size > room and i:
            ends.append(i - 1)
            room = capacity
        room -= p.size
    return ends[: shards - 1]


def shard_documents(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shards 0 to ``shards - 1`` of near equal bytes; equal texts stay together.

    A document's size is its text's UTF-8 bytes (null: none) plus 1. Groups are
    the texts with one 64-bit hash (a collision only joins two groups), in the
    order of the hash; they are atomic. Slots count each shard's rows from 0 in
    the order of (hash, doc_id). Rows are ranked by a range shuffle of (hash,
    doc_id) that splits large groups; per-partition counts, not rows, are
    brought together. Shards may stay empty if there are fewer groups. Rows that
    repeat are placed each; an empty table gives no rows; other columns, whatever
    their names, are not read.

    Returns doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null).
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = stage(
        docs.select(
            F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("gkey"),
        ),
        "shard-sizes",
    )
    groups = stage(base.groupBy("gkey").agg(F.sum("size").alias("size")), "shard-groups")
    _, first = cuts(groups, shards)
    shard = sum((F.when(F.col("gkey") >= F.lit(k), 1).otherwise(0) for k in first), F.lit(0)).cast("int")
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranked = stage(
        base.withColumn("shard", shard).repartitionByRange(parts, "gkey", "doc_id").sortWithinPartitions("gkey", "doc_id").withColumn("_at", F.monotonically_increasing_id()),
        "shard-ranks",
    )
    part = F.shiftright("_at", 33)
    runs = sorted(ranked.groupBy(part.alias("_p"), "shard").agg(F.min("_at").alias("lo"), F.count("*").alias("n")).collect(), key=lambda r: (r["shard"], r["_p"]))
    seen: dict[int, int] = {}
    offsets = []
    for r in runs:
        offsets.append((r["_p"], r["shard"], r["lo"] - seen.get(r["shard"], 0)))
        seen[r["shard"]] = seen.get(r["shard"], 0) + r["n"]
    table = docs.sparkSession.createDataFrame(offsets, "_p long, _shard int, _lo long").hint("broadcast")
    return ranked.join(table, (part == F.col("_p")) & (F.col("shard") == F.col("_shard"))).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_at") - F.col("_lo")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
