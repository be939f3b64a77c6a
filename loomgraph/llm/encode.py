"""Encoding with a byte-level BPE vocabulary: speculate and verify (problem 7).

For the distinct words of an Arrow batch, greedy longest match proposes tokens. A sequence of tokens is the BPE encoding of
its bytes exactly if every adjacent pair is: no merge across the boundary of the two ranks before the merges that made them.
That test runs over all distinct pairs of the batch at once in numpy arrays. Only words with a failing pair are merged by the
exact procedure. There is no shuffle: texts are read, encoded and written in one stage.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.spreading import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed value: the vocabulary's own rule of splitting texts into words, white space as Unicode defines it.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Words whose encodings a worker remembers at most; it starts anew when they are that many.
REMEMBERED = 300_000


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file: itself if printable, else the next code point from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters, ids = _byte_letters(), model["vocab"]
        as_bytes = lambda token: bytes(letters[c] for c in token)
        size = max(ids.values()) + 1
        self.size = size
        self.left = np.arange(size, dtype="int64")
        self.right = np.arange(size, dtype="int64")
        keys, made = [], []
        for merge in model["merges"]:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            i, j, k = ids[a], ids[b], ids[a + b]
            self.left[k], self.right[k] = i, j
            keys.append(i * size + j)
            made.append(k)
        order = np.argsort(keys)
        self.pair_keys, self.pair_made = np.asarray(keys, dtype="int64")[order], np.asarray(made, dtype="int64")[order]
        self.merged = dict(zip(keys, made, strict=True))
        self.byte_id = [0] * 256
        for token, i in ids.items():
            if len(token) == 1:
                self.byte_id[letters[token]] = i
        # a token that its own merges do not produce is never part of an encoding
        whole = np.flatnonzero(self.left != np.arange(size))
        sound = np.ones(size, dtype=bool)
        sound[whole] = self.compatible(self.left[whole], self.right[whole], whole)
        self.ids = {as_bytes(t): i for t, i in ids.items() if sound[i]}
        lengths: dict[bytes, set[int]] = {}
        for token in self.ids:
            lengths.setdefault(token[:2], set()).add(len(token))
        self.lengths = {k: sorted(v, reverse=True) for k, v in lengths.items()}
        self.known: dict[str, list[int]] = {}

    def _made(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_made[at], self.size)

    def compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | int | None = None) -> np.ndarray:
        """For each pair whether no merge across its boundary comes before the merges that made both tokens.

        Undoes the merges of the two tokens next to the boundary, the latest first, and looks for a merge of what then meets
        there with a lower rank than the one undone.
        """
        n = len(a)
        a, b = a.astype("int64").copy(), b.astype("int64").copy()
        limit = np.broadcast_to(np.int64(self.size) if limit is None else np.asarray(limit, dtype="int64"), (n,)).copy()
        good, todo = np.ones(n, dtype=bool), np.arange(n)
        while len(todo):
            x, y, bound = a[todo], b[todo], limit[todo]
            bad = self._made(x, y) < bound
            good[todo[bad]] = False
            todo, x, y = todo[~bad], x[~bad], y[~bad]
            whole_x, whole_y = self.right[x] == x, self.left[y] == y  # single bytes
            first = np.where(whole_y, ~whole_x, (x > y) & ~whole_x)
            a[todo] = np.where(first, self.right[x], x)
            b[todo] = np.where(first, y, self.left[y])
            limit[todo] = np.where(first, x, y + 1)
            todo = todo[~(whole_x & whole_y)]
        return good

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        out, at, n, ids = [], 0, len(word), self.ids
        while at < n:
            for length in self.lengths.get(word[at : at + 2], ()):
                if at + length <= n and (i := ids.get(word[at : at + length])) is not None:
                    break
            else:
                length, i = 1, self.byte_id[word[at]]
            out.append(i)
            at += length
        return out

    def merge(self, word: bytes) -> list[int]:
        """Exact merging, lowest rank first and leftmost among equals; n log n for words of any length."""
        ids: list[int] = [self.byte_id[b] for b in word]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(k, i, ids[i], ids[i + 1]) for i in range(n - 1) if (k := self.merged.get(ids[i] * self.size + ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            k, i, x, y = heapq.heappop(heap)
            j = after[i]
            if ids[i] != x or j >= n or ids[j] != y:
                continue
            ids[i], ids[j] = k, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for p in (before[i], i):
                q = after[p] if p >= 0 else n
                if p >= 0 and q < n and (m := self.merged.get(ids[p] * self.size + ids[q])) is not None:
                    heapq.heappush(heap, (m, p, ids[p], ids[q]))
        return [x for x in ids if x >= 0]

    def learn(self, words: list[str]) -> None:
        """Encodes words and remembers them."""
        if len(self.known) + len(words) > REMEMBERED:
            self.known.clear()
        raw = [w.encode("utf-8") for w in words]
        tokens = [[i] if (i := self.ids.get(w)) is not None else self.propose(w) for w in raw]
        sizes = np.fromiter(map(len, tokens), dtype="int64", count=len(tokens))
        flat = np.fromiter((t for row in tokens for t in row), dtype="int64", count=int(sizes.sum()))
        owner = np.repeat(np.arange(len(tokens)), sizes)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, at = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
        good = self.compatible(pairs // self.size, pairs % self.size)
        for w in np.unique(owner[inner[~good[at]]]):
            tokens[w] = self.merge(raw[w])
        self.known.update(zip(words, tokens, strict=True))


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


_word = regex.compile(WORD)


def encode_batch(texts: list[str | None], path: str = VOCABULARY) -> list[np.ndarray]:
    v = vocabulary(path)
    out, chunk, size = [], [], 0

    def flush() -> None:
        split = [_word.findall(t) for t in chunk]
        new = {w for words in split for w in words} - v.known.keys()
        if new:
            v.learn(list(new | {w for words in split for w in words}) if len(v.known) + len(new) > REMEMBERED else list(new))
        known = v.known
        out.extend(np.fromiter((i for w in words for i in known[w]), dtype="int32") for words in split)
        chunk.clear()

    for t in texts:
        chunk.append(t or "")
        size += len(chunk[-1])
        if size > 4_000_000:  # characters encoded at a time; bounds the worker's memory, not the texts
            flush()
            size = 0
    flush()
    return out


def encode(
    documents: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY, also: list[str] | None = None
) -> DataFrame:
    """``key``, the columns ``also`` and ids (array of int) of every row, without special tokens, whose strings are plain text.

    Null and empty texts give an empty list, blank ones the ids of their blanks. Whole texts of any length are encoded.
    Repeated rows stay as they are; an empty table gives an empty result; other columns are ignored.
    """

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        return pd.Series(encode_batch([t if isinstance(t, str) else None for t in texts], path))

    needed = list(dict.fromkeys([key, text, *(also or [])]))
    return spread(documents.select(*needed)).select(F.col(key), *(also or []), ids(F.col(text)).alias("ids"))
