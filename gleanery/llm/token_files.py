"""Token-id files by static range asymmetric numeral systems (rANS).

One frequency table, counted over all documents, is shared by all blocks. A
block holds whole documents and is coded alone: its ids are dealt over lanes,
each with its own rANS state, whose 32-bit words are interleaved in one stream
(all lanes step together, as vectors). Checkpoints inside a block hold the
lanes' states and the place in the stream, so that segments decode in parallel;
CRC-32 sums cover the block and each segment's ids.

Files are Parquet containers, so that any store that Spark reaches will do:
`frequencies` (token, frequency) and `blocks` (part, block, first_doc_id,
offset, n_tokens, n_docs, payload). A part holds a range of doc_ids in
ascending order; offset counts the ids before the block within its part.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_bounds, id_text, shared_dir, staged
from .vocabulary import loaded, read_spec

END_ID = 2
SCALE = 20
LOW = np.uint64(1 << 31)
WORD = np.uint64(32)
MAGIC = b"GRA1"
#: Stands for a null doc_id, which comes first in the order.
NO_ID = -(1 << 63)
#: Target of ids in a block (a longer document makes a longer block), most lanes, steps between checkpoints.
BLOCK_IDS, MOST_LANES, CHECKPOINT_STEPS = 1 << 17, 1024, 64
HEAD = struct.Struct("<4sHHIIIII")
BLOCKS = "part int, block int, first_doc_id long, offset long, n_tokens long, n_docs int, payload binary"


def quantised(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Frequencies with the sum 2 ** scale, at least 1 where a count is."""
    total, whole = int(counts.sum()), 1 << scale
    if not total:
        return np.zeros_like(counts)
    if np.count_nonzero(counts) > whole:
        raise ValueError("more distinct ids than the scale can hold")
    freq = np.where(counts > 0, np.maximum(1, np.round(counts * (whole / total)).astype(np.int64)), 0)
    order = np.argsort(-freq, kind="stable")
    while (off := whole - int(freq.sum())) != 0:
        if off > 0:
            freq[order[0]] += off
        else:
            spare = np.minimum(freq[order] - 1, np.maximum(freq[order] // 8, 1)).clip(0)
            cuts = np.minimum(spare, np.maximum(0, -off - (np.cumsum(spare) - spare)))
            freq[order] -= cuts
    return freq


class Tables:
    def __init__(self, freq: np.ndarray, scale: int = SCALE):
        self.scale = np.uint64(scale)
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(freq) - freq).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
        self.mask = np.uint64((1 << scale) - 1)
        self.crc = zlib.crc32(np.trim_zeros(freq, "b").astype("<i8").tobytes())


def lanes_for(n: int) -> int:
    k = 1
    while k < MOST_LANES and k * 128 < n:
        k *= 2
    return k


def encode_ids(ids: np.ndarray, t: Tables) -> bytes:
    """Checkpoints and the word stream of one block's ids."""
    n, k = len(ids), lanes_for(len(ids))
    steps = -(-n // k)
    x = np.full(k, LOW, np.uint64)
    limit = np.uint64((1 << 63) >> int(t.scale))
    words, points, emitted = [], [], 0
    for step in range(steps - 1, -1, -1):
        s = ids[step * k : (step + 1) * k]
        own = x[: len(s)]
        f = t.freq[s]
        full = own >= limit * f
        out = own[full].astype(np.uint32)
        words.append(out)
        emitted += len(out)
        own[full] >>= WORD
        q = own // f
        x[: len(s)] = (q << t.scale) + (own - q * f) + t.start[s]
        if step % CHECKPOINT_STEPS == 0:
            points.append((step, emitted, x.copy()))
    stream = np.concatenate(words[::-1]) if words else np.empty(0, np.uint32)
    head = [struct.pack("<III", k, len(points), len(stream))]
    for step, behind, states in reversed(points):
        until = min(n, (step + CHECKPOINT_STEPS) * k)
        crc = zlib.crc32(ids[step * k : until].astype("<u4").tobytes())
        head.append(struct.pack("<III", step, len(stream) - behind, crc) + states.astype("<u8").tobytes())
    return b"".join(head) + stream.astype("<u4").tobytes()


def segments(body: bytes) -> tuple[int, list[tuple[int, int, int, np.ndarray]], np.ndarray]:
    """Lanes, checkpoints (step, place in the stream, CRC of the ids, states) and the stream."""
    k, n_points, n_words = struct.unpack_from("<III", body)
    at, points = 12, []
    for _ in range(n_points):
        step, place, crc = struct.unpack_from("<III", body, at)
        points.append((step, place, crc, np.frombuffer(body, "<u8", k, at + 12).astype(np.uint64)))
        at += 12 + 8 * k
    return k, points, np.frombuffer(body, "<u4", n_words, at)


def decode_segment(body: bytes, n: int, which: int, t: Tables) -> np.ndarray:
    """The ids between checkpoint `which` and the next; needs nothing decoded before."""
    k, points, stream = segments(body)
    first, place, crc, states = points[which]
    x, until, out = states.copy(), min(n, (first + CHECKPOINT_STEPS) * k), []
    for step in range(first, -(-until // k)):
        m = min(k, n - step * k)
        own = x[:m]
        slot = own & t.mask
        s = t.symbol[slot]
        out.append(s)
        own = t.freq[s] * (own >> t.scale) + slot - t.start[s]
        low = own < LOW
        c = int(np.count_nonzero(low))
        own[low] = own[low] << WORD | stream[place : place + c].astype(np.uint64)
        place += c
        x[:m] = own
    ids = np.concatenate(out) if out else np.empty(0, np.uint32)
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("a segment's ids don't match its checksum")
    return ids


def encode_block(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, t: Tables) -> bytes:
    body = encode_ids(ids, t)
    lists = doc_ids.astype("<i8").tobytes() + lengths.astype("<u4").tobytes()
    head = HEAD.pack(MAGIC, int(t.scale), 0, len(doc_ids), len(ids), len(body), t.crc, zlib.crc32(body, zlib.crc32(lists)))
    return head + lists + body


def open_block(payload: bytes, t: Tables) -> tuple[np.ndarray, np.ndarray, int, bytes]:
    """doc_ids, lengths, number of ids and body, after the checks."""
    magic, scale, _, n_docs, n, n_body, table_crc, crc = HEAD.unpack_from(payload)
    lists, body = payload[HEAD.size : HEAD.size + 12 * n_docs], payload[HEAD.size + 12 * n_docs :]
    if magic != MAGIC or scale != int(t.scale) or table_crc != t.crc or len(body) != n_body or zlib.crc32(body, zlib.crc32(lists)) != crc:
        raise ValueError("not an intact block of this table")
    return np.frombuffer(lists, "<i8", n_docs), np.frombuffer(lists, "<u4", n_docs, 8 * n_docs), n, body


def decode_block(payload: bytes, t: Tables) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    doc_ids, lengths, n, body = open_block(payload, t)
    parts = [decode_segment(body, n, i, t) for i in range(len(segments(body)[1]))]
    return doc_ids, lengths, np.concatenate(parts) if parts else np.empty(0, np.uint32)


def raw_blocks(docs: DataFrame, path: str | None, end_id: int) -> DataFrame:
    """Tokenised documents in ascending doc_id order, as uncoded blocks: low bytes, then high bytes."""
    arrow_bounds(docs.sparkSession)
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(read_spec(path))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = id_text(docs).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    names = [x.split()[0] for x in BLOCKS.split(", ")]

    def run(batches):
        vocabulary, part, block, offset = loaded(spec.value), TaskContext.get().partitionId(), 0, 0
        ids, held, size = [], [], 0

        def row():
            n = sum(map(len, ids))
            planes = np.concatenate(ids).astype("<u4").view(np.uint8).reshape(-1, 4).T[: 2 if vocabulary.size <= 1 << 16 else 4]
            raw = struct.pack("<I", len(held)) + np.array(held, "<i8").tobytes() + np.array(list(map(len, ids)), "<u4").tobytes() + planes.tobytes()
            return pa.record_batch([pa.array([x], k) for x, k in zip((part, block, held[0], offset, n, len(held), raw), (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names)

        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                ids.append(np.append(vocabulary.encode(text), np.uint32(end_id)))
                held.append(NO_ID if doc_id is None else doc_id)
                size += len(ids[-1])
                if size >= BLOCK_IDS:
                    yield row()
                    block, offset, ids, held, size = block + 1, offset + size, [], [], 0
        if held:
            yield row()

    return ordered.mapInArrow(run, BLOCKS)


def unpack_raw(raw: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    (n_docs,) = struct.unpack_from("<I", raw)
    planes = np.frombuffer(raw, np.uint8, offset=4 + 12 * n_docs).reshape(-1, n)
    ids = np.zeros(n, np.uint32)
    for i, plane in enumerate(planes):
        ids |= plane.astype(np.uint32) << np.uint32(8 * i)
    return np.frombuffer(raw, "<i8", n_docs, 4), np.frombuffer(raw, "<u4", n_docs, 4 + 8 * n_docs), ids


def write(docs: DataFrame, out: str, path: str | None = None, end_id: int = END_ID) -> None:
    """Writes `docs` as token files in the folder `out`.

    Null and empty texts are end_id alone; rows that repeat a doc_id are all
    written, side by side, and null doc_ids first; an empty table gives empty files. Collected and
    broadcast is the frequency table alone, bounded by the vocabulary's size.
    """
    spark = docs.sparkSession
    size = loaded(read_spec(path)).size
    raw = staged(raw_blocks(docs, path, end_id), "raw-blocks")

    def count(batches):
        counts = np.zeros(size, np.int64)
        for b in batches:
            for n, payload in zip(b.column("n_tokens").to_pylist(), b.column("payload").to_pylist()):
                counts += np.bincount(unpack_raw(payload, n)[2], minlength=size)
        used = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(used.astype(np.int32)), pa.array(counts[used])], ["token", "n"])

    counts = np.zeros(size, np.int64)
    for row in raw.select("n_tokens", "payload").mapInArrow(count, "token int, n long").groupBy("token").agg(F.sum("n").alias("n")).collect():
        counts[row["token"]] = row["n"]
    freq = quantised(counts)
    shared = spark.sparkContext.broadcast(freq)

    def code(batches):
        t = Tables(shared.value)
        for b in batches:
            payloads = [encode_block(*unpack_raw(p, n), t) for n, p in zip(b.column("n_tokens").to_pylist(), b.column("payload").to_pylist())]
            at = b.schema.get_field_index("payload")
            yield pa.record_batch([pa.array(payloads, pa.binary()) if i == at else c for i, c in enumerate(b.columns)], b.schema.names)

    raw.mapInArrow(code, BLOCKS).write.option("compression", "uncompressed").parquet(f"{out}/blocks")
    used = [(int(i), int(freq[i])) for i in np.flatnonzero(freq)]
    spark.createDataFrame(used, "token int, frequency long").coalesce(1).write.parquet(f"{out}/frequencies")


def read(spark: SparkSession, out: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) from the files in `out`, blocks decoded in parallel.

    start counts the ids of all documents before this one. Collected is one row
    for each part, of which there are as many as shuffle partitions at writing.
    """
    arrow_bounds(spark)
    table = spark.read.schema("token int, frequency long").parquet(f"{out}/frequencies").collect()
    freq = np.zeros(1 + max((r["token"] for r in table), default=0), np.int64)
    for r in table:
        freq[r["token"]] = r["frequency"]
    blocks = spark.read.schema(BLOCKS).parquet(f"{out}/blocks")
    starts, total = {}, 0
    for r in blocks.groupBy("part").agg(F.min("first_doc_id").alias("first"), F.sum("n_tokens").alias("n")).orderBy("first").collect():
        starts[r["part"]] = total
        total += r["n"]
    shared = spark.sparkContext.broadcast((freq, starts))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        freq, starts = shared.value
        t = None
        for b in batches:
            for part, offset, payload in zip(*(b.column(c).to_pylist() for c in ("part", "offset", "payload"))):
                t = t or Tables(freq)
                doc_ids, lengths, ids = decode_block(payload, t)
                ends = np.cumsum(lengths.astype(np.int64))
                first = ends - lengths
                own = [ids[a:z].astype("<u4").tobytes() for a, z in zip(first, ends)]
                columns = [pa.array(doc_ids, mask=doc_ids == NO_ID), pa.array(first + (starts[part] + offset)), pa.array(lengths.astype(np.int64)), pa.array([zlib.crc32(x) for x in own], pa.int64())]
                yield pa.record_batch(columns + [pa.array(own, pa.binary())] * with_ids, names)

    return blocks.select("part", "offset", "payload").mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Writes to a new folder in the shared directory and reads that back."""
    out = f"{shared_dir(docs.sparkSession)}/token-files-{uuid.uuid4().hex}"
    write(docs, out, path, end_id)
    return read(docs.sparkSession, out, with_ids=False)
