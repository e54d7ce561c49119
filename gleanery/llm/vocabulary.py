"""A byte-level BPE vocabulary, read from a public tokenizer's JSON file."""

from __future__ import annotations

import json
from functools import cached_property

import numpy as np

#: Fixed value: the usual split pattern of byte-level BPE.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
DEFAULT_FILE = "byte_bpe_50k.json"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_FILE)


def read_spec(path: str | None = None) -> str:
    with open(path or default_path(), encoding="utf-8") as f:
        return f.read()


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in such files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shifted = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(shifted)}


class Vocabulary:
    """Token bytes, merges and added tokens; ids must follow the merges' order."""

    def __init__(self, spec: str):
        raw = json.loads(spec)
        alphabet = byte_alphabet()
        self.added = {t["content"]: t["id"] for t in raw.get("added_tokens", [])}
        self.ids = {bytes(alphabet[c] for c in text): i for text, i in raw["model"]["vocab"].items() if text not in self.added}
        self.merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in raw["model"]["merges"]]
        self._alphabet = alphabet
        self.size = max([*self.ids.values(), *self.added.values()]) + 1
        self.bytes_of = [b""] * self.size
        for token, i in self.ids.items():
            self.bytes_of[i] = token
        for token, i in self.added.items():
            self.bytes_of[i] = token.encode()

    @cached_property
    def pair_ranks(self) -> dict[tuple[int, int], tuple[int, int]]:
        """(left id, right id) -> (rank of the merge, id of the merged token)."""
        alphabet, ids, found = self._alphabet, self.ids, {}
        for rank, (left, right) in enumerate(self.merges):
            a, b = bytes(alphabet[c] for c in left), bytes(alphabet[c] for c in right)
            found[ids[a], ids[b]] = (rank, ids[a + b])
        return found

    @cached_property
    def fast(self):
        """The same vocabulary for the tiktoken library, which gives equal ids."""
        import tiktoken

        merged = [self.ids[bytes(self._alphabet[c] for c in a + b)] for a, b in self.merges]
        if merged != sorted(merged) or any(len(self.bytes_of[i]) == 1 for i in merged):
            raise ValueError("token ids don't follow the order of the merges")
        return tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=self.ids, special_tokens=self.added)

    def encode(self, text: str) -> np.ndarray:
        """uint32 ids of the whole text; added tokens in it count as themselves."""
        return self.fast.encode_to_numpy(text, allowed_special="all")


_LOADED: dict[int, Vocabulary] = {}


def loaded(spec: str) -> Vocabulary:
    """One vocabulary for each worker process and file."""
    key = hash(spec)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Vocabulary(spec)
    return _LOADED[key]
