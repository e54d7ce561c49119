"""BPE encoding and decoding by prefix-sharing trie traversal.

In a BPE encoding every prefix of a word has its own encoding, and that
encoding is settled by its last token: the one vocabulary token that ends the
prefix and stands validly behind the last token of what precedes it. So a trie
over distinct words holds one last token in each node; words that share a
prefix share the nodes and the work. A word's ids are read by stepping back
from its node over the last tokens.

Two tokens stand validly side by side when no merge across their seam comes
before the merges that build them; that is remembered for each pair.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import arrow_bounds, id_text
from .vocabulary import SPLIT, Vocabulary, loaded, read_spec

#: A worker forgets its trie beyond so many nodes or words, and starts anew.
MAX_NODES = 1_000_000
#: Longer words go through a trie of their own.
MAX_WORD = 64


class TrieEncoder:
    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.ids = vocabulary.ids
        self.longest = max(map(len, self.ids))
        self.split = regex.compile(SPLIT)
        added = sorted(vocabulary.added, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, added)) + ")") if added else None
        self.packed_added = {k: np.uint32(v).astype("<u4").tobytes() for k, v in vocabulary.added.items()}
        #: token -> (left part, right part, rank of the merge)
        self.parts = {token: (*pair, rank) for pair, (rank, token) in vocabulary.pair_ranks.items()}
        self.size = list(map(len, vocabulary.bytes_of))
        self.packed = [np.uint32(i).astype("<u4").tobytes() for i in range(vocabulary.size)]
        self.valid: dict[int, bool] = {}
        #: tokens that are their own encoding: their two parts fit but for the merge itself
        self.whole = {t for t in self.ids.values() if self.merges_whole(t)}
        self.reset()

    def reset(self) -> None:
        #: node * 256 + byte -> child, and each node's last token; node 0 is the root.
        self.child: dict[int, int] = {}
        self.last: list[int] = [-1]
        self.words: dict[str, bytes] = {}
        if len(self.valid) > MAX_NODES:
            self.valid.clear()

    def merges_whole(self, token: int) -> bool:
        """Its two parts are whole, and no other merge across their seam comes first."""
        if token not in self.parts:
            return True
        left, right, rank = self.parts[token]
        ranks = self.vocabulary.pair_ranks
        for x, x_end in self.spine(left, 1):
            for y, y_end in self.spine(right, 0):
                merge = ranks.get((x, y))
                if merge is not None and (x, y) != (left, right) and merge[0] < min(x_end, rank) and merge[0] <= min(y_end, rank):
                    return False
        return self.merges_whole(left) and self.merges_whole(right)

    def spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens at one edge (0: left, 1: right) while this one is merged, and the rank that ends each."""
        found, end = [], float("inf")
        while True:
            found.append((token, end))
            parts = self.parts.get(token)
            if parts is None:
                return found
            end, token = parts[2], parts[side]

    def fits(self, left: int, right: int) -> bool:
        """No merge across the seam comes before the merges that build the two.

        Of three equal tokens in a row the first two merge, so at equal ranks
        the seam wins against the right token and loses against the left one.
        """
        key = left << 32 | right
        known = self.valid.get(key)
        if known is None:
            ranks, known = self.vocabulary.pair_ranks, True
            starts = self.spine(right, 0)
            for x, x_end in self.spine(left, 1):
                for y, y_end in starts:
                    merge = ranks.get((x, y))
                    if merge is not None and merge[0] < x_end and merge[0] <= y_end:
                        known = False
            self.valid[key] = known
        return known

    def last_token(self, data: bytes, end: int, states: list[int]) -> int:
        """Of the prefix data[:end]; states[i] is the last token of data[:i]. Just one fits."""
        get = self.ids.get
        for start in range(end - 1, max(0, end - self.longest) - 1, -1):
            token = get(data[start:end])
            if token is not None and (token in self.whole if not start else self.fits(states[start], token)):
                return token
        raise ValueError("a byte is missing in the vocabulary")

    def ids_of(self, states: list[int], at: int) -> bytes:
        """Steps back from a node over the last tokens."""
        found, size, packed = [], self.size, self.packed
        while at:
            token = states[at]
            found.append(packed[token])
            at -= size[token]
        found.reverse()
        return b"".join(found)

    def insert(self, words: list[str]) -> None:
        """Sorted words are a depth-first walk: states holds the path to the node.

        The inner loop is last_token() written out, as it takes most of the time.
        """
        child, last, known, ids, valid = self.child, self.last, self.words, self.ids, self.valid
        size, packed = self.size, self.packed
        path, states, before = [0], [-1], b""
        for data, word in sorted([(w.encode(), w) for w in words]):
            same = 0
            for x, y in zip(before, data):
                if x != y:
                    break
                same += 1
            del path[same + 1 :], states[same + 1 :]
            node = path[same]
            for end in range(same + 1, len(data) + 1):
                edge = node << 8 | data[end - 1]
                node = child.get(edge)
                if node is None:
                    start = end - 1
                    while start:
                        token = ids.get(data[start:end])
                        if token is not None:
                            fit = valid.get(states[start] << 32 | token)
                            if fit or fit is None and self.fits(states[start], token):
                                break
                        start -= 1
                    else:
                        token = ids[data[:end]]
                    node = child[edge] = len(last)
                    last.append(token)
                    states.append(token)
                else:
                    states.append(last[node])
                path.append(node)
            found, at = [], len(data)
            while at:
                token = states[at]
                found.append(packed[token])
                at -= size[token]
            found.reverse()
            known[word] = b"".join(found)
            before = data

    def long_word(self, word: str) -> bytes:
        data, states = word.encode(), [-1]
        for end in range(1, len(data) + 1):
            states.append(self.last_token(data, end, states))
        return self.ids_of(states, len(data))

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if len(self.last) > MAX_NODES or len(self.words) > MAX_NODES:
            self.reset()
        split = [self.pieces(t) for t in texts]
        words = set().union(*(p for own in split for p in own if isinstance(p, list))) - self.words.keys()
        long = {w for w in words if len(w) > MAX_WORD}
        self.insert(list(words - long))
        self.words.update((w, self.long_word(w)) for w in long)
        get = self.words.__getitem__
        out = [b"".join([p if isinstance(p, bytes) else b"".join(map(get, p)) for p in own]) for own in split]
        for w in long:
            del self.words[w]
        return out

    def pieces(self, text: str) -> list:
        """Lists of words, and the packed ids of added tokens between them."""
        if self.special is None or not self.special.search(text):
            return [self.split.findall(text)]
        return [self.packed_added[s] if i % 2 else self.split.findall(s) for i, s in enumerate(self.special.split(text))]

    def decode(self, packed: bytes) -> str:
        ids = np.frombuffer(packed, "<u4").tolist()
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_ENCODERS: dict[int, TrieEncoder] = {}


def encoder(spec: str) -> TrieEncoder:
    vocabulary = loaded(spec)
    if id(vocabulary) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[id(vocabulary)] = TrieEncoder(vocabulary)
    return _ENCODERS[id(vocabulary)]


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids binary): little-endian 32-bit token ids of every whole text.

    A null or empty text has no ids. Rows with equal doc_id are encoded each on
    its own. Columns besides doc_id and text are ignored. No shuffle; a worker
    holds one batch and a trie of at most MAX_NODES nodes plus one batch.
    """
    arrow_bounds(docs.sparkSession)
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(path))

    def run(batches):
        e = encoder(spec.value)
        for b in batches:
            ids = e.encode_batch(b.column("text").to_pylist())
            yield pa.record_batch([b.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return id_text(docs).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); invalid UTF-8 becomes U+FFFD, null ids an empty text."""
    arrow_bounds(encoded.sparkSession)
    spec = encoded.sparkSession.sparkContext.broadcast(read_spec(path))

    def run(batches):
        e = encoder(spec.value)
        for b in batches:
            texts = [e.decode(x or b"") for x in b.column("ids").to_pylist()]
            yield pa.record_batch([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per document: token count and SHA-256 of the packed ids and of the decoded text."""
    arrow_bounds(docs.sparkSession)
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(path))
    hexed = lambda x: hashlib.sha256(x).hexdigest()

    def run(batches):
        e = encoder(spec.value)
        for b in batches:
            ids = e.encode_batch(b.column("text").to_pylist())
            yield pa.record_batch(
                [
                    b.column("doc_id"),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array(map(hexed, ids), pa.string()),
                    pa.array([hexed(e.decode(x).encode()) for x in ids], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return id_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
