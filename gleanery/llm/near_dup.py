"""Near-duplicate detection by b-bit MinHash.

1. Every document's word shingles are hashed to a set of 64-bit numbers;
   `hashes` random functions give its minima. Documents with equal sets form a
   class, and only the class's smallest document goes on.
2. Minima are joined to band keys. Two documents of similarity 0.8 share one of
   32 bands of 4 minima but for a chance of 5e-8.
3. Of each minimum the low `bits` are kept and packed. For candidates, counting
   equal groups of bits estimates the similarity, corrected for groups that are
   equal by chance; a pair is given up only six standard deviations below the
   threshold.
4. The pairs left are decided on their full sets.

A bucket is never expanded into all its pairs. First its most central document
is compared with all others. What is then not one component is cut down to the
documents that can have a link (see Linker.that_may_link). Of each group of
these, those outside its largest component are put in blocks, and the group's
members are run past each block, exactly and without a row for each pair; so
each link between two components is found.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sizes import broadcast_if_small
from .common import arrow_bounds, id_text, salted_left_join, staged
from .components import components

HASHES, BANDS, BITS = 128, 32, 4
#: Standard deviations below the threshold at which an estimate gives a pair up.
MARGIN = 6
#: Up to so many documents whose sets are wanted are broadcast to the texts; more are joined by a shuffle.
WANTED_ROWS = 200_000
#: Documents of a block that members are compared with, and tasks that a block's members are dealt to.
BLOCK, SALTS = 128, 8
MAX_WORDS = 1_000_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MAX_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


_WORDS = WordHashes()


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted distinct hashes of the `width`-word shingles; of a shorter text the whole sequence is one.

    Words are runs of other characters than space, \\t, \\n, \\v, \\f and \\r, with A-Z in lower case.
    """
    words = text.encode("utf-8", "replace").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, n)
    size = min(n, width)
    h = w[: n - size + 1] * _ODD + np.uint64(size)
    for i in range(1, size):
        h = (h + w[i : n - size + 1 + i]) * _ODD
    return np.unique(mixed(h))


def permutations(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    pick = np.random.default_rng(20240229)
    high = np.iinfo(np.uint64).max
    return pick.integers(0, high, hashes, np.uint64, True) | np.uint64(1), pick.integers(0, high, hashes, np.uint64, True)


def minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray, step: int = 1024) -> np.ndarray:
    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), step):
        h = a[:, None] * shingles[None, i : i + step]
        h += b[:, None]
        np.minimum(low, h.min(axis=1), out=low)
    return mixed(low)


def signature(low: np.ndarray, bands: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (the band's number is part of the key) and packed low bits."""
    rows = low.reshape(bands, -1)
    key = np.arange(bands, dtype=np.uint64)
    for column in rows.T:
        key = mixed((key + column) * _ODD)
    per = 64 // bits
    groups = (low & np.uint64((1 << bits) - 1)).reshape(-1, per)
    packed = (groups << (np.arange(per, dtype=np.uint64) * np.uint64(bits))).sum(axis=1, dtype=np.uint64)
    return key.view(np.int64), packed.view(np.int64)


def lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)])
    values = np.concatenate(rows).view(np.int64) if rows else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int64()))


def digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, width: int, hashes: int = HASHES, bands: int = BANDS, bits: int = BITS) -> DataFrame:
    """(doc_id, row, n_shingles, digest of the set, band keys, packed low bits); row is the text's hash."""
    arrow_bounds(docs.sparkSession)

    def run(batches):
        a, b = permutations(hashes)
        none = np.empty(0, np.int64)
        for batch in batches:
            sets = [shingle_set(t, width) for t in batch.column("text").to_pylist()]
            own = [signature(minima(s, a, b), bands, bits) if len(s) else (none, none) for s in sets]
            yield pa.record_batch(
                [
                    batch.column("doc_id"),
                    batch.column("row"),
                    pa.array(list(map(len, sets)), pa.int64()),
                    pa.array(map(digest, sets), pa.binary()),
                    lists([k for k, _ in own]),
                    lists([p for _, p in own]),
                ],
                ["doc_id", "row", "n_shingles", "digest", "bands", "packed"],
            )

    return id_text(docs).withColumn("row", F.xxhash64("text")).mapInArrow(run, "doc_id long, row long, n_shingles long, digest binary, bands array<long>, packed array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(doc_id, shingles) of the wanted (doc_id, digest, node), with the node as doc_id; the digest tells rows with one doc_id apart."""
    arrow_bounds(docs.sparkSession)

    def run(batches):
        for batch in batches:
            sets = [shingle_set(t, width) for t in batch.column("text").to_pylist()]
            own = [i for i, (s, d) in enumerate(zip(sets, batch.column("digest").to_pylist())) if digest(s) == d]
            yield pa.record_batch([batch.column("node").take(pa.array(own, pa.int64())), lists([sets[i] for i in own])], ["doc_id", "shingles"])

    joined = id_text(docs).join(broadcast_if_small(wanted.select("doc_id", "digest", "node"), WANTED_ROWS), "doc_id").select("node", "text", "digest")
    return joined.mapInArrow(run, "doc_id long, shingles array<long>")


def estimate(a: Column, b: Column, hashes: int = HASHES, bits: int = BITS) -> Column:
    """Similarity from equal groups of bits: of unequal minima, one in 2 ** bits has equal low bits."""
    ones = sum(1 << i for i in range(0, 64, bits))
    mask = F.lit(ones - (1 << 64) if ones >= 1 << 63 else ones)
    unequal = F.lit(0)
    for i in range(hashes * bits // 64):
        x = a[i].bitwiseXOR(b[i])
        shift = bits // 2
        while shift:
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
            shift //= 2
        unequal = unequal + F.bit_count(x.bitwiseAND(mask))
    chance = 1 / (1 << bits)
    return ((F.lit(1.0) - unequal / F.lit(float(hashes))) - chance) / (1 - chance)


def least_estimate(threshold: float, hashes: int = HASHES, bits: int = BITS) -> float:
    chance = 1 / (1 << bits)
    equal = threshold + (1 - threshold) * chance
    return threshold - MARGIN * (equal * (1 - equal) / hashes) ** 0.5 / (1 - chance)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, hashes: int = HASHES, bands: int = BANDS, bits: int = BITS, rows: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of docs.

    Documents are linked where 100 * intersection >= percent * union of their
    shingle sets; component_id is the smallest doc_id reachable over links, and
    kept is doc_id = component_id. A null, empty or blank text has no shingles
    and is linked with nothing. Texts with fewer words than `width` are one
    shingle. Rows that repeat a doc_id each get a row; equal ones share all
    values. Different texts of one doc_id are linked each for itself; their
    components are apart even if component_id is the same for them. With `rows`
    there are two more columns: row, the text's hash, and group, which names the
    component (of a text without shingles, the doc_id and text). A text whose class has no doc_id but null is linked with nothing. An
    empty table gives no rows.

    Texts are read twice: for the signatures, and for the full sets of those
    documents that share a band with another class.
    """
    signed = staged(signatures(docs, width, hashes, bands, bits), "signatures")
    classes = staged(signed.filter("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("rep")), "classes")
    first = signed.join(classes, "digest").filter("doc_id = rep").select("doc_id", "digest", "packed", "bands")
    first = staged(first, "representatives")
    # only a table that repeats rows needs the costly steps of dropping them and of numbering what is left
    repeats = not first.groupBy("doc_id").count().filter("count > 1").isEmpty()
    if repeats:
        first = staged(first.dropDuplicates(["digest"]).withColumn("node", F.monotonically_increasing_id()), "representatives")
    else:
        first = first.withColumn("node", F.col("doc_id"))

    dealt = first.select(F.col("node").alias("doc_id"), F.explode("bands").alias("bucket"))
    shared = dealt.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    members = staged(dealt.join(shared, "bucket"), "members")
    wanted = first.join(members.select(F.col("doc_id").alias("node")).distinct(), "node", "left_semi")
    sets = full_sets(docs, wanted, width)
    sets = staged(sets.dropDuplicates(["doc_id"]) if repeats else sets, "sets")
    labels = Linker(members, staged(wanted.select(F.col("node").alias("doc_id"), "packed"), "packed"), sets, percent, hashes, bits).labels()
    if repeats:
        named = first.select("node", "digest", "doc_id").join(labels, "node", "left").select("digest", "doc_id", F.coalesce("root", "node").alias("_group"))
        smallest = named.groupBy("_group").agg(F.min("doc_id").alias("_root"))
        roots = staged(named.join(smallest, "_group").select("digest", "_root", "_group"), "roots")
    else:
        roots = classes.join(labels.select(F.col("node").alias("rep"), "root"), "rep", "left").select("digest", F.coalesce("root", "rep").alias("_root"))
        roots = roots.withColumn("_group", F.col("_root"))
    out = salted_left_join(signed.select("doc_id", "row", "n_shingles", "digest"), roots, ["digest"], F.col("doc_id"))
    component = F.coalesce("_root", "doc_id")
    found = ["doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")]
    if rows:
        blank = F.concat_ws(":", F.lit("blank"), F.col("doc_id").cast("string"), F.col("row").cast("string"))
        group = F.when(F.col("n_shingles") == 0, blank).otherwise(F.coalesce(F.col("_group").cast("string"), F.hex("digest")))
        found += ["row", group.alias("group")]
    return out.select(*found)


class Linker:
    """Finds all components among the members (bucket, doc_id, n) of shared buckets."""

    def __init__(self, members: DataFrame, packed: DataFrame, sets: DataFrame, percent: int, hashes: int, bits: int):
        self.members, self.packed, self.sets = members, packed, sets
        self.percent, self.hashes, self.bits = percent, hashes, bits
        self.links: DataFrame | None = None
        self.roots = members.sparkSession.createDataFrame([], "node long, root long")

    def labels(self) -> DataFrame:
        """(node, root) of all documents that have a link."""
        if self.members.isEmpty():
            return self.roots
        met = self.members.join(self.centres(), "bucket").filter("doc_id <> leader")
        self.add(self.confirmed(met.select("doc_id", "leader")))
        groups = self.groups(self.that_may_link())
        if not groups.isEmpty():
            self.add(staged(self.past_blocks(groups), "links"))
        return self.roots

    def add(self, found: DataFrame) -> None:
        if not found.isEmpty():
            self.links = found if self.links is None else self.links.union(found)
            self.roots = components(self.links)

    def centres(self) -> DataFrame:
        """(bucket, leader): of each bucket the document that shares the most buckets with the most others."""
        weight = self.members.groupBy("doc_id").agg(F.sum("n").alias("w"))
        best = F.max(F.struct("w", (-F.col("doc_id")).alias("i")))
        found = self.members.join(weight, "doc_id").groupBy("bucket").agg(best.alias("m"))
        return staged(found.select("bucket", (-F.col("m.i")).alias("leader")), "centres")

    def confirmed(self, met: DataFrame) -> DataFrame:
        """Links (u, v) among the pairs met: by estimate first, then on full sets. met has a row for each bucket of a pair."""
        one, other = met.columns
        pairs = met.select(F.least(one, other).alias("a"), F.greatest(one, other).alias("b")).distinct()
        near = pairs.join(self.packed.select(F.col("doc_id").alias("a"), F.col("packed").alias("pa")), "a")
        near = near.join(self.packed.select(F.col("doc_id").alias("b"), F.col("packed").alias("pb")), "b")
        least = least_estimate(self.percent / 100, self.hashes, self.bits)
        near = staged(near.filter(estimate(F.col("pa"), F.col("pb"), self.hashes, self.bits) >= least).select("a", "b"), "near")
        both = near.join(self.sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a")
        both = both.join(self.sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b")
        both = both.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("c"), (F.size("sa") + F.size("sb")).alias("n"))
        found = both.filter(F.col("c") * 100 >= (F.col("n") - F.col("c")) * self.percent)
        return staged(found.select(F.col("a").alias("u"), F.col("b").alias("v")), "links")

    def parted(self, members: DataFrame) -> DataFrame:
        """members with `part`, their component so far."""
        known = self.roots.select(F.col("node").alias("doc_id"), F.col("root").alias("_root"))
        return members.join(known, "doc_id", "left").withColumn("part", F.coalesce("_root", "doc_id")).drop("_root")

    @staticmethod
    def undecided(named: DataFrame, by: str) -> DataFrame:
        """(by, main): buckets or groups of several components, and the largest of these."""
        parts = named.groupBy(by, "part").count().groupBy(by)
        return parts.agg(F.max_by("part", F.struct("count", "part")).alias("main"), F.count("*").alias("n")).filter("n > 1").select(by, "main")

    def that_may_link(self) -> DataFrame:
        """(bucket, doc_id): members of undecided buckets that can have a link at all.

        A document's own shingles are those that no other such document has;
        they are in no intersection, so with too many of them it links with nothing.
        """
        named = staged(self.parted(self.members.select("bucket", "doc_id")), "named")
        left = named.join(self.undecided(named, "bucket").select("bucket"), "bucket", "left_semi").select("bucket", "doc_id")
        left = staged(left, "undecided")
        sets = self.sets.join(left.select("doc_id").distinct(), "doc_id", "left_semi")
        once = sets.select("doc_id", F.explode("shingles").alias("s")).groupBy("s").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
        own = once.filter("n = 1").groupBy("doc_id").agg(F.count("*").alias("own"))
        sized = sets.select("doc_id", F.size("shingles").alias("size")).join(own, "doc_id", "left")
        able = sized.filter(F.coalesce("own", F.lit(0)) * 100 <= F.col("size") * (100 - self.percent)).select("doc_id")
        return staged(left.join(able, "doc_id", "left_semi"), "may-link")

    def groups(self, left: DataFrame) -> DataFrame:
        """(group, doc_id, part, main): groups joined by shared buckets, of several components."""
        first = left.groupBy("bucket").agg(F.min("doc_id").alias("v"))
        edges = left.join(first, "bucket").filter("doc_id <> v").select(F.col("doc_id").alias("u"), "v")
        grouped = components(edges).select(F.col("node").alias("doc_id"), F.col("root").alias("group"))
        named = staged(self.parted(grouped), "named")
        return staged(named.join(self.undecided(named, "group"), "group").select("group", "doc_id", "part", "main"), "groups")

    def past_blocks(self, groups: DataFrame) -> DataFrame:
        """Links (u, v) between a group's documents outside its main component and all its others.

        The outside is dealt into blocks of about BLOCK documents. A task reads
        a block, then the group's members one after the other, which SALTS
        tasks share; it holds one block and one batch.
        """
        whole = groups.join(self.sets, "doc_id")
        outside = whole.filter("part <> main")
        blocks = groups.filter("part <> main").groupBy("group").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        dealt = outside.join(blocks, "group").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        one = dealt.select("group", "block", salts.alias("salt"), F.lit(0).alias("kind"), "doc_id", "part", "shingles")
        every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        other = whole.join(blocks, "group").select("group", every.alias("block"), F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(SALTS)).cast("int").alias("salt"), F.lit(1).alias("kind"), "doc_id", "part", "shingles")
        key = ["group", "block", "salt"]
        ordered = one.unionByName(other).repartition(*key).sortWithinPartitions(*key, "kind")
        percent = self.percent

        def run(batches):
            at, block = None, None
            for b in batches:
                found: list[tuple[int, int]] = []
                columns = [b.column(c).to_pylist() for c in (*key, "kind", "doc_id", "part")]
                ends = np.asarray(b.column("shingles").offsets)
                values = np.asarray(b.column("shingles").values).view(np.uint64)
                for i, (group, number, salt, kind, doc_id, part) in enumerate(zip(*columns)):
                    shingles = values[ends[i] : ends[i + 1]]
                    if at != (group, number, salt):
                        at, block = (group, number, salt), Block()
                    if kind == 0:
                        block.add(doc_id, part, shingles)
                    else:
                        found += [(doc_id, other) for other in block.links(part, shingles, percent)]
                yield pa.record_batch([pa.array([u for u, _ in found], pa.int64()), pa.array([v for _, v in found], pa.int64())], ["u", "v"])

        return ordered.mapInArrow(run, "u long, v long")


class Block:
    """Sets by document, and their inverted index from the first question on."""

    def __init__(self):
        self.ids: list[int] = []
        self.parts: list[int] = []
        self.sets: list[np.ndarray] = []
        self.shingles: np.ndarray | None = None

    def add(self, doc_id: int, part: int, shingles: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.parts.append(part)
        self.sets.append(shingles.copy())

    def links(self, part: int, shingles: np.ndarray, percent: int) -> list[int]:
        """Documents of other components that the set links with."""
        if not self.ids:
            return []
        if self.shingles is None:
            every = np.concatenate(self.sets)
            order = np.argsort(every, kind="stable")
            self.owners = np.repeat(np.arange(len(self.ids)), list(map(len, self.sets)))[order]
            self.shingles, starts = np.unique(every[order], return_index=True)
            self.starts = np.append(starts, len(every))
            self.sizes = np.array(list(map(len, self.sets)))
            self.part = np.array(self.parts)
        at = np.searchsorted(self.shingles, shingles)
        at = at[at < len(self.shingles)] if len(at) and at[-1] == len(self.shingles) else at
        at = at[self.shingles[at] == shingles[: len(at)]]
        counts = self.starts[at + 1] - self.starts[at]
        rows = np.repeat(self.starts[at] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum()) if len(at) else at
        common = np.bincount(self.owners[rows], minlength=len(self.ids))
        good = (100 * common >= percent * (self.sizes + len(shingles) - common)) & (self.part != part)
        return [self.ids[i] for i in np.flatnonzero(good)]
