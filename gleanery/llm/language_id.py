"""Language identification by language-bitmask n-gram filters.

A Bloom filter for each language would need a look-up for each. Here the
filters are bit-sliced: a slot holds one bit for each language, so the AND of
an n-gram's slots is the bitmask of all languages that contain it. Counting
those bits over a text's n-grams gives each language's hits; what a filter of
that fill answers by chance is taken off, and the most hits decide.

The filters hold each language's most frequent n-grams, counted over a bounded
sample of labelled documents (SAMPLE for each language, by hash of doc_id).
"""

from __future__ import annotations

import sys
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_bounds, carried
from .near_dup import mixed

#: Labelled documents of each language to learn from, and n-grams of each language to hold.
SAMPLE, TOP = 1000, 20_000
SIZES = (3, 4)
#: Parts of a language's n-grams that are ranked apart.
PARTS = 16
SLOTS, PROBES = 1 << 20, 2
#: Code points that are looked at at once; slices overlap, so that no n-gram is lost.
SLICE = 1 << 20
UNKNOWN = "und"

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _letters


def gram_codes(text: str):
    """Yields arrays of n-gram hashes: lower case, all but letters as spaces, one at either end; at least one letter in each."""
    lower = text.lower()
    for at in range(0, max(len(lower), 1), SLICE):
        own = lower[max(0, at - max(SIZES) + 1) if at else 0 : at + SLICE]
        points = np.frombuffer(f" {own} ".encode("utf-32-le", "replace"), np.uint32)
        is_letter = letters()[points]
        folded = np.where(is_letter, points, np.uint32(32)).astype(np.uint64)
        before = np.concatenate(([0], np.cumsum(is_letter)))
        for size in SIZES:
            n = len(points) - size + 1
            if n < 1:
                continue
            code = np.full(n, size, np.uint64)
            for i in range(size):
                code *= np.uint64(0x100000001B3)
                code += folded[i : n + i]
            code = code[before[size:] > before[:-size]]
            if len(code):
                yield mixed(code)


def slots(code: np.ndarray) -> list[np.ndarray]:
    return [(code >> np.uint64(32 * i // max(1, PROBES - 1))) & np.uint64(SLOTS - 1) for i in range(PROBES)]


class Filters:
    """languages (by falling number of documents) and {language: n-gram hashes}."""

    def __init__(self, languages: list[str], grams: dict[str, np.ndarray]):
        self.languages = languages
        width = max(1, -(-len(languages) // 8))
        self.table = np.zeros((SLOTS, width), np.uint8)
        for k, language in enumerate(languages):
            for s in slots(grams.get(language, np.empty(0, np.uint64))):
                self.table[s, k // 8] |= np.uint8(1 << k % 8)
        bits = [(self.table[:, k // 8] >> np.uint8(k % 8)) & 1 for k in range(len(languages))]
        self.chance = np.array([b.mean() ** PROBES for b in bits]) if bits else np.empty(0)

    def counts(self, text: str) -> tuple[np.ndarray, int]:
        """Hits of each language and the number of n-grams."""
        hits, n = np.zeros(len(self.languages)), 0
        for code in gram_codes(text):
            masks = None
            for s in slots(code):
                masks = self.table[s] if masks is None else masks & self.table[s]
            n += len(code)
            for k in range(len(self.languages)):
                hits[k] += np.count_nonzero(masks[:, k // 8] & np.uint8(1 << k % 8))
        return hits, n

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and its corrected share of the n-grams; ties go to the language with more documents."""
        if not text or not self.languages:
            return UNKNOWN, 0.0
        hits, n = self.counts(text)
        if not n:
            return UNKNOWN, 0.0
        true = np.clip((hits - n * self.chance) / (1 - self.chance), 0, n)
        best = int(np.argmax(true))
        return self.languages[best], float(min(1.0, true[best] / n))


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Filters:
    """Learns from rows with a lang whose crc32(doc_id) mod 4 is not 2.

    At most SAMPLE documents of each language are read (those of the smallest
    hash of doc_id), as whole texts; at most TOP n-grams of each come to the
    driver. Null texts count as empty.
    """
    arrow_bounds(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    labelled = base.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    sizes = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    languages = [r["lang"] for r in sizes]
    # the SAMPLE smallest hashes are below twice their expected place but for a chance of e ** (-SAMPLE / 8); the window settles which
    share = F.create_map(*(x for r in sizes for x in (F.lit(r["lang"]), F.lit(min(1.0, 2 * SAMPLE / r["count"]))))) if sizes else F.create_map()
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    drawn = labelled.select("doc_id", "lang").filter(place <= F.try_element_at(share, "lang")) if sizes else labelled.select("doc_id", "lang")
    order = Window.partitionBy("lang").orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)), "doc_id")
    sample = drawn.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= SAMPLE).select("doc_id", "lang").distinct()
    # at most SAMPLE rows for each language
    chosen = labelled.join(F.broadcast(sample), ["doc_id", "lang"], "left_semi").select("lang", "text")

    def count(batches):
        for b in batches:
            by: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                by.setdefault(lang, []).extend(gram_codes(text or ""))
            for lang, codes in by.items():
                if codes:
                    code, n = np.unique(np.concatenate(codes), return_counts=True)
                    yield pa.record_batch([pa.array([lang] * len(code)), pa.array(code.view(np.int64)), pa.array(n)], ["lang", "code", "n"])

    counted = chosen.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    # the best of a part of a language's n-grams first, so that no task ranks all of them
    part = F.pmod("code", F.lit(PARTS))
    rank = F.row_number().over(Window.partitionBy("lang", part).orderBy(F.desc("n"), "code"))
    counted = counted.withColumn("_r", rank).filter(F.col("_r") <= TOP).drop("_r")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    best = counted.withColumn("_r", rank).filter(F.col("_r") <= TOP).groupBy("lang").agg(F.collect_list("code").alias("codes"))
    grams = {r["lang"]: np.array(r["codes"], np.int64).view(np.uint64) for r in best.collect()}
    return Filters(languages, grams)


def identify(docs: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text", carry: bool = False, with_text: bool = False) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every whole text, one row for each row of docs.

    A text that is null or without a letter is `und` with the score 0; without
    learned languages all are. A null doc_id is never held out. Very long texts
    are looked at in overlapping slices. Rows that repeat a doc_id are judged
    each; of equal scores the language with more documents wins. An empty table
    gives no rows. Only doc_id and text are read; with `carry` all columns come
    along in the struct _given, and with `with_text` the text as the column text
    in place of its field there. No shuffle.
    """
    arrow_bounds(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches):
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            found = [shared.value.predict(t) for t in b.column("text").to_pylist()]
            columns = [
                pa.array([is_held_out(i) for i in ids], pa.bool_()),
                pa.array([x for x, _ in found], pa.string()),
                pa.array([x for _, x in found], pa.float64()),
            ]
            yield pa.record_batch([b.column("doc_id"), *columns, *map(b.column, more)], ["doc_id", "held_out", "lang_pred", "score", *more])

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *carried(docs, carry, [text_col] * with_text))
    more = [c for c in base.columns if c == "_given" or c == "text" and with_text]
    kinds = {"doc_id": T.LongType(), "held_out": T.BooleanType(), "lang_pred": T.StringType(), "score": T.DoubleType()}
    return base.mapInArrow(run, T.StructType([*(T.StructField(c, k) for c, k in kinds.items()), *(base.schema[c] for c in more)]))
