"""Packing token sequences by best-two-fit.

Only lengths decide how documents share sequences, and there are at most
`capacity` of them. So the plan is made from the histogram of lengths, whatever
the number of documents: fill a bin greedily with the longest document that
still fits, then replace the bin's smallest document by the two unpacked ones
that fit its expanded gap more tightly, and repeat that bin as often as the
counts allow. Documents then take the places of the plan by their rank among
those of their length.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_bounds, id_text, staged
from .vocabulary import loaded, read_spec

CAPACITY = 2048
END_ID = 0
#: Pieces of one length are ranked in groups, as a length may be very common: of FEW_ROWS up to LEAST_GROUPS, then of ROWS_A_GROUP.
FEW_ROWS, LEAST_GROUPS, ROWS_A_GROUP = 64, 64, 1 << 18


def plan(counts: np.ndarray) -> list[tuple[int, list[int]]]:
    """[(how many bins, lengths in each)] from counts[length]; len(counts) is the capacity + 1.

    Each step uses up some length as far as its bin needs it, so the number of
    steps depends on the number of lengths and not on the number of documents.
    """
    left, capacity, bins = counts.astype(np.int64).copy(), len(counts) - 1, []
    places = np.arange(capacity + 1)
    while left.any():
        own, gap = np.zeros_like(left), capacity
        floor = np.maximum.accumulate(np.where(left > 0, places, 0))
        while gap and (longest := int(floor[gap])):
            take = min(gap // longest, int(left[longest] - own[longest]))
            if take:
                own[longest] += take
                gap -= take * longest
            if own[longest] == left[longest] or take == 0:
                floor = np.maximum.accumulate(np.where(left > own, places, 0))
        smallest = int(np.flatnonzero(own)[0])
        if gap and (two := best_two(left - own, gap + smallest)) and sum(two) > smallest:
            own[smallest] -= 1
            for length in two:
                own[length] += 1
        used = np.flatnonzero(own)
        times = int((left[used] // own[used]).min())
        left -= times * own
        bins.append((times, np.repeat(used, own[used])[::-1].tolist()))
    return bins


def best_two(free: np.ndarray, room: int) -> tuple[int, int] | None:
    """The two free lengths with the largest sum of at most `room`."""
    top = min(room - 1, len(free) - 1)
    if top < 1:
        return None
    places = np.arange(len(free))
    floor = np.maximum.accumulate(np.where(free > 0, places, 0))
    first = places[1 : top + 1][free[1 : top + 1] > 0]
    second = floor[np.minimum(room - first, len(free) - 1)]
    # a length cannot pair with itself if there is but one of it
    alone = (second == first) & (free[first] < 2)
    second = np.where(alone, floor[np.maximum(second - 1, 0)], second)
    good = second > 0
    if not good.any():
        return None
    first, second = first[good], second[good]
    best = int(np.argmax(first + second))
    return int(first[best]), int(second[best])


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces: only what is longer than the capacity is cut, the first piece may be shorter."""
    first = n % capacity if n > capacity else n
    starts = [0] if first else []
    starts += range(first, n, capacity) if n > first or not first else []
    return [(s, min(first if s == 0 and first else capacity, n - s)) for s in starts]


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): every document's ids and end_id, cut where longer than the capacity.

    A null or empty text is the end_id alone. No shuffle.
    """
    arrow_bounds(docs.sparkSession)
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(path))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        vocabulary = loaded(spec.value)
        for b in batches:
            rows: list[list] = [[] for _ in names]
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                ids = np.append(vocabulary.encode(text), np.uint32(end_id)).astype("<u4")
                for k, (start, n) in enumerate(cut(len(ids), capacity)):
                    own = ids[start : start + n].tobytes()
                    for column, x in zip(rows, (doc_id, k, start, n, zlib.crc32(own), own)):
                        column.append(x)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(rows, kinds)], names)

    return id_text(docs).mapInArrow(run, schema)


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Places every piece: (doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset).

    Null and empty texts take one token (end_id). Rows that repeat a doc_id are
    packed each. An empty table gives no rows. Texts are tokenised once, into a
    staged table of pieces; what is collected is a histogram of at most
    `capacity` lengths, and one of the groups that the pieces of a length are
    ranked in, LEAST_GROUPS or one for each ROWS_A_GROUP pieces. The plan is broadcast.
    """
    cut_up = staged(pieces(docs, path, capacity, end_id, with_ids), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for row in cut_up.groupBy("length").count().collect():
        counts[row["length"]] = row["count"]
    groups = np.maximum(np.minimum(LEAST_GROUPS, 1 + counts // FEW_ROWS), -(-counts // ROWS_A_GROUP))
    common = [x for n in np.flatnonzero(groups > 1) for x in (F.lit(int(n)), F.lit(int(groups[n])))]
    of_length = F.coalesce(F.try_element_at(F.create_map(*common), F.col("length").cast("int")), F.lit(1)) if common else F.lit(1)
    group = F.pmod(F.xxhash64("doc_id", "piece"), of_length).cast("int")
    grouped = cut_up.withColumn("_group", group)
    # places of a length's groups side by side: how many pieces of the length are in the groups before
    first = np.cumsum(groups) - groups
    before = np.zeros(int(groups.sum()), np.int64)
    if common:
        for row in grouped.groupBy("length", "_group").count().collect():
            before[first[row["length"]] + row["_group"]] = row["count"]
        for n in range(capacity + 1):
            own = before[first[n] : first[n] + groups[n]]
            own[:] = np.cumsum(own) - own
    slots: dict[int, list[tuple[int, int, int]]] = {}
    taken, sequence = np.zeros(capacity + 1, np.int64), 0
    for times, lengths in plan(counts):
        offset = 0
        for length in lengths:
            slots.setdefault(length, []).append((int(taken[length]), sequence, offset))
            taken[length] += times
            offset += length
        sequence += times
    shared = docs.sparkSession.sparkContext.broadcast((before, first, {k: np.array(v, np.int64) for k, v in slots.items()}))

    ranked = grouped.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_group").orderBy("doc_id", "piece")).cast("long") - 1)
    kept = cut_up.columns
    schema = ", ".join(f"{c} {t}" for c, t in [*cut_up.dtypes, ("sequence_id", "bigint"), ("offset", "bigint")])

    def run(batches):
        before, first, slots = shared.value
        for b in batches:
            lengths, groups, ranks = (b.column(c).to_numpy() for c in ("length", "_group", "_rank"))
            slot = before[first[lengths] + groups] + ranks
            sequence, offset = np.zeros_like(slot), np.zeros_like(slot)
            for length in np.unique(lengths):
                own, table = lengths == length, slots[int(length)]
                at = np.searchsorted(table[:, 0], slot[own], side="right") - 1
                sequence[own], offset[own] = table[at, 1] + slot[own] - table[at, 0], table[at, 2]
            yield pa.record_batch([*(b.column(c) for c in kept), pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    return ranked.mapInArrow(run, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids) from pack(with_ids=True); a group is at most one sequence."""
    items = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return (
        packed.groupBy("sequence_id")
        .agg(F.sum("length").alias("n_tokens"), items.alias("_items"))
        .select("sequence_id", "n_tokens", F.aggregate("_items", F.expr("X''"), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
    )
