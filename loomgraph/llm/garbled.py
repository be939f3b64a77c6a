"""Text that was decoded with the wrong character encoding (problem 9).

*Training.* Character trigrams (with bigram and unigram back-off) of the words of lines that hold non-ASCII characters are
counted over all clean records: each partition counts into hashed buckets, Spark adds them up. The model has ``2 ** BITS``
buckets whatever the corpus, which bounds what is broadcast. Nine tenths of the clean records train, one tenth validates.

*Scoring.* A line's score is the sum of its words'; every encode-decode chain is scored for every word that it changes. On the
side of the text as it stands no character costs more than ``FLOOR``: a letter that the clean records lack says little about an
encoding. On the side of the result characters cost in full, but for letters of one script that are UTF-8 throughout
(``NOVEL``): that a run is UTF-8 by accident is unlikely by itself. The chain and the stretch of words that gain most are
accepted beyond a margin, and the line is tried again, for text that was garbled twice or in several ways; each step makes the
text shorter or likelier, so there is an end. Chains accepted in a document need only ``AGAIN`` on its other lines, and a chain
that gains beyond the margin over all lines of a document is accepted where single lines are too short.

*Validation.* The margin is learned on the held-out records by decoys: the same chains with the upper half of the bytes
permuted, which can never be right. By the number of characters that a stretch changes, the margin is what at most one in
``1 / FALSE_SHARE`` lines exceeds under any decoy, and at least the logarithm of the number of chains.

Replacement characters and C1 controls are lost text and count by themselves. So do question marks in the place of letters, on
any line: two words of a line with marks between letters, one word that the clean records have with other letters in their
place, or a stretch of words made of marks alone. A piece of up to 12 characters that alone
stands in quotes in a sentence about encodings or tests is an example and left out of account.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce
from hashlib import blake2b
from itertools import groupby
from operator import and_, or_

import numpy as np
import pandas as pd
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.spreading import spread

BITS = 21
#: Least log-likelihood of a character as it stands; of a letter that is new to the model but was UTF-8.
FLOOR, NOVEL = float(np.log(1 / 500)), -10.5
#: Margin for a chain that another line of the document has shown; share of sound lines that may exceed the margin of others.
AGAIN, FALSE_SHARE = 1.0, 0.0005
#: Share of the text below which a context is rare.
RARE = 3e-5
#: Buckets of margins: up to so many non-ASCII characters in the stretch.
SIZES = [1, 2, 4, 8, 16, 1 << 30]

SINGLE = [
    "cp1252", "latin-1", "cp1250", "cp1251", "cp1253", "cp1254", "cp1257", "cp1258", "iso8859-2", "iso8859-5", "iso8859-7",
    "iso8859-15", "cp437", "cp850", "cp852", "cp866", "koi8-r", "mac_roman", "mac_cyrillic", "mac_latin2",
]
DOUBLE = ["cp932", "euc_jp", "gbk", "big5", "euc_kr"]
WIDE = ["utf-16-le", "utf-16-be"]

_run = re.compile(r"[^\x00-\x7f]+")
_lost = re.compile(r"[�\x80-\x84\x86-\x9f]")
#: A word of letters and question marks: where two stand in a line, the marks are lost letters.
_holes = regex.compile(r"(?<!\S)[^\w\s?]*\p{L}+(?:\?+\p{L}+)+[^\w\s]*(?!\S)")
#: Words between blanks that are letters, marks and punctuation only, so no code and no address.
_plain = regex.compile(r"(?<!\S)[\p{L}\p{M}?'’\-().,:;!\"«»“”]+(?!\S)")
_word = regex.compile(r"[\p{L}\p{M}?]+")
_letters = regex.compile(r"[\p{L}\p{M}]+")
_other = re.compile(r"[^\x00-\x7f]+|\?+")
#: Words of nothing but question marks, two or more, or one that is as long as two.
_blanked = regex.compile(r"(?<![^\s(\"'«“])(?:\?{2,}[.,:;!]*\s+\?{3,}|\?{3,}[.,:;!]*\s+\?{2,}|\?{6,})(?![\w?])")
#: Characters of two bytes of which one is zero, with the byte order mark before them.
_zeros = re.compile("(?:ÿþ)?(?:[^\x00]\x00){4,}|(?:þÿ)?(?:\x00[^\x00]){4,}")
#: Texts that can be affected at all: all that hold what ``_lost_letters`` looks for.
SUSPECT = r"[^\x01-\x7f]|\p{L}\?+\p{L}|(?:^|[^\p{L}?])\?+\p{L}|\p{L}\?+[^\p{L}]+\p{Ll}|\?{2,}"
_QUOTES = [('"', '"'), ("'", "'"), ("`", "`"), ("[“„]", "[”“]"), ("«", "»")]
_quote = re.compile("[\"'`“„«]")
#: What stands alone between quotes, which themselves stand at the edge of a word: short pieces, and longer ones.
_example, _quoted = (
    regex.compile("|".join(rf"(?<=(?:^|[\s(\[=:,]){o}){piece}(?={c}(?!\w))" for o, c in _QUOTES))
    for piece in (r"[^\s\"'`”“»]{1,6}", r"[^\n\"'`”“»]{1,12}")
)
_about = regex.compile(
    r"codec|encod|decod|charset|character set|code ?page|utf-?(?:8|16)|unicode|mojibake|latin-?1|iso-?8859|cp125\d|windows-125\d|shift.?jis|\bbytes?\b|"
    r"garbled|misread|diacritic|replacement character|errors=|codifica|kodier|zeichensatz|кодировк|文字化け|文字コード|mã hóa|bảng mã",
    regex.I,
)
#: Sentences about tests; in these the short pieces are examples.
_tests = regex.compile(r"\b(?:tests?|tested|fixtures?|assert\w*|on purpose|deliberately)\b", regex.I)
#: Stands for an example while its line is restored; no chain changes it.
MARK = "\x01"
_sentence = regex.compile(r"((?<=[.!?])\s+)")
#: What parts words: ASCII characters that no encoding has within a longer character.
_parting = re.compile(r"([\x00-\x2f\x3a-\x3f]+)")

#: Counters: of characters, of buckets of their bi- and trigrams, and of buckets of words.
N_CHARS = 0x110000
N_GRAMS = N_CHARS + (1 << BITS)
N_ALL = N_GRAMS + (1 << BITS)
#: Decoy chains permute the upper half of the bytes.
_SAME = bytes(range(256))
_DECOY = bytes([*range(128), *(128 + (b * 37 + 11) % 128 for b in range(128))])


def _table(codec: str) -> dict[str, int]:
    """Character to byte; bytes that the codec leaves open stand for C1 controls, as most decoders have it."""
    out = {}
    for b in range(128, 256):
        try:
            c = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            c = chr(b)
        out.setdefault(c, b)
    return out


_TABLES = {c: _table(c) for c in SINGLE}


_TO_BYTES = {codec: {ord(c): b for c, b in t.items()} for codec, t in _TABLES.items()}
_ALL = [*SINGLE, *DOUBLE]
_BIT = {codec: 1 << i for i, codec in enumerate(_ALL)}


@lru_cache(maxsize=200_000)
def _holders(char: str) -> int:
    """The codecs that have ``char``, as bits."""
    if char < "\x80":
        return (1 << len(_ALL)) - 1
    bits = sum(_BIT[codec] for codec in SINGLE if char in _TABLES[codec])
    for codec in DOUBLE:
        try:
            char.encode(codec)
            bits |= _BIT[codec]
        except UnicodeEncodeError:
            pass
    return bits


def _bytes(text: str, codec: str) -> bytes:
    """``text`` in ``codec``, which has all its characters."""
    return text.translate(_TO_BYTES[codec]).encode("latin-1") if codec in _TO_BYTES else text.encode(codec)


def _encoded(word: str, codec: str) -> list[tuple[str, bytes | None]]:
    """``word`` cut where characters that ``codec`` has meet such that it lacks, with the bytes of those that hold more than ASCII."""
    bit = _BIT[codec]
    pieces = [(bool(held), "".join(g)) for held, g in groupby(word, lambda c: _holders(c) & bit)]
    return [(x, _bytes(x, codec) if held and not x.isascii() else None) for held, x in pieces]


class Chains:
    """All encode-decode chains in the order of their names, or their decoys."""

    def __init__(self, permuted: bytes):
        self.permuted = permuted
        self.utf8 = [*SINGLE, *DOUBLE]
        maps: dict[tuple, tuple[str, str]] = {}
        back = {r: {b: c for c, b in _TABLES[r].items()} for r in SINGLE}
        for wrong in SINGLE:
            for right in SINGLE:
                m = {c: back[right][permuted[b]] for c, b in _TABLES[wrong].items() if permuted[b] in back[right]}
                if wrong != right and any(k != v for k, v in m.items()):
                    maps.setdefault(tuple(sorted(m.items())), (wrong, right))
        self.maps = [dict(m) for m in maps]
        self.others = [(w, DOUBLE) for w in SINGLE] + [(w, [r for r in [*DOUBLE, *SINGLE] if r != w]) for w in DOUBLE]
        self.names = [
            *(f"utf-8>{c}" for c in self.utf8), *(f"utf-8>{d} + utf-8>{c}" for c in self.utf8 for d in self.utf8),
            *(f"utf-8>{c}" for c in WIDE), *(f"{r}>{w}" for w, r in maps.values()), *(f"{r}>{w}" for w, rights in self.others for r in rights),
        ]
        self.n_utf8 = len(self.utf8) * (len(self.utf8) + 1)
        self._mapped: dict[str, np.ndarray] = {}
        self._factors = np.random.default_rng(1).integers(1, 1 << 62, 64, dtype="uint64") | np.uint64(1)

    def _read(self, raw: bytes, right: str) -> str | None:
        try:
            return raw.translate(self.permuted).decode(right)
        except UnicodeDecodeError:
            return None

    def _utf8(self, word: str) -> list[str]:
        """``word`` with each run of non-ASCII characters (each span that a double-byte codec has) read as UTF-8, by codec."""
        out = [word] * len(_ALL)
        runs = [(r, reduce(and_, map(_holders, r))) for r in _run.findall(word) if len(r) > 1]
        if runs:
            for k, codec in enumerate(SINGLE):
                new = {r: x for r, held in runs if held & _BIT[codec] and (x := self._read(_bytes(r, codec), "utf-8")) is not None}
                if new:
                    out[k] = _run.sub(lambda m, new=new: new.get(m[0], m[0]), word)
        for k, spans in enumerate(self._spans(word, DOUBLE), len(SINGLE)):
            if spans is not None:
                out[k] = self._joined(spans, "utf-8")
        return out

    def _spans(self, word: str, codecs: list[str]) -> Iterator[list[tuple[str, bytes | None]] | None]:
        """``_encoded`` by each codec, permuted; None where one has none of the word's characters beyond ASCII."""
        held = [_holders(c) for c in set(word) if c > "\x7f"]
        every, some = reduce(and_, held), reduce(or_, held)
        for codec in codecs:
            bit = _BIT[codec]
            if not some & bit:
                yield None
            else:
                spans = [(word, _bytes(word, codec))] if every & bit else _encoded(word, codec)
                yield [(x, raw and raw.translate(self.permuted)) for x, raw in spans]

    @staticmethod
    def _joined(spans: list[tuple[str, bytes | None]], right: str) -> str:
        out = []
        for x, raw in spans:
            if raw is not None:
                try:
                    x = raw.decode(right)
                except UnicodeDecodeError:
                    pass
            out.append(x)
        return out[0] if len(out) == 1 else "".join(out)

    def _deepest(self, word: str) -> list[str]:
        """``word`` read as UTF-8 by each codec as often as it changes."""
        out = self._utf8(word)
        for k, x in enumerate(out):
            while x != word and (y := self._utf8(x)[k]) != x:
                x = out[k] = y
        return out

    def _wide(self, word: str, codec: str) -> str:
        """``word`` with each run of two or more non-ASCII characters taken as pairs of bytes in UTF-8."""

        def read(m: re.Match) -> str:
            new = self._read(m[0].encode(codec, "surrogatepass"), "utf-8") if len(m[0]) > 1 else None
            return m[0] if new is None or not new.replace("\n", " ").isprintable() else new

        return _run.sub(read, word)

    def outputs(self, word: str) -> tuple[list[str], np.ndarray]:
        """What chains make of ``word``, once each, and for each chain the place of its result; -1 where it changes nothing."""
        place: dict[str, int] = {}
        which = np.full(len(self.names), -1, dtype="int16")
        once = self._utf8(word)
        n, deeper = len(once), {}
        for k, out in enumerate(once):
            if out != word:
                which[k] = place.setdefault(out, len(place))
                if out not in deeper:  # garbled again, the same way any number of times
                    ends = self._deepest(out)
                    deeper[out] = [-1 if x in (out, word) else place.setdefault(x, len(place)) for x in ends]
                which[n * (k + 1) : n * (k + 2)] = deeper[out]
        k = self.n_utf8
        for codec in WIDE:
            if (out := self._wide(word, codec)) != word:
                which[k] = place.setdefault(out, len(place))
            k += 1
        chars = sorted({c for c in word if c > "\x7f"})
        mapped = [self._vector(c) for c in chars]
        key = mapped[0].astype("uint64")
        for v in mapped[1:]:
            key = key * np.uint64(0x9E3779B97F4A7C15) + v
        _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        places = []
        for i in first:
            out = word.translate({ord(c): int(v[i]) for c, v in zip(chars, mapped, strict=True)})
            places.append(-1 if out == word else place.setdefault(out, len(place)))
        which[k : k + len(self.maps)] = np.array(places, dtype="int16")[inverse]
        k += len(self.maps)
        done: dict[tuple, int] = {}
        for (_, rights), spans in zip(self.others, self._spans(word, _ALL), strict=True):
            if spans is not None:
                raws = tuple([raw for _, raw in spans])
                for j, right in enumerate(rights):
                    if (at := done.get((raws, right))) is None:
                        out = self._joined(spans, right)
                        at = done[raws, right] = -1 if out == word else place.setdefault(out, len(place))
                    which[k + j] = at
            k += len(rights)
        return list(place), which

    def _vector(self, char: str) -> np.ndarray:
        """What each of ``maps`` makes of ``char``."""
        if char not in self._mapped:
            self._mapped[char] = np.array([ord(m.get(char, char)) for m in self.maps], dtype="uint32")
        return self._mapped[char]


@lru_cache(maxsize=4)
def chains(decoy: bool = False) -> Chains:
    return Chains(_DECOY if decoy else _SAME)


def _keys(points: np.ndarray) -> list[np.ndarray]:
    """Places of the character itself, and two buckets each of the bi- and trigram that end at each character."""
    p = points.astype("uint64")
    b = np.concatenate([np.zeros(1, dtype="uint64"), p[:-1]])
    a = np.concatenate([np.zeros(1, dtype="uint64"), b[:-1]])
    two = p + b * np.uint64(0x200003)
    three = two + a * np.uint64(0x40000C00009) + np.uint64(1 << 63)
    out = [points.astype("int64")]
    for x in (two, three):
        for factor in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
            h = x * np.uint64(factor)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS)
            out.append(h.astype("int64") + N_CHARS)
    return out


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def _framed(text: str) -> str:
    """``text`` with two marks before each of its words and one after it."""
    return "\x02\x02" + _parting.sub("\x03\x02\x02", text) + "\x03"


@lru_cache(maxsize=100_000)
def _word_keys(pattern: str) -> tuple[int, int]:
    """Two buckets of a word whose non-ASCII letters are question marks."""
    h = int.from_bytes(blake2b(pattern.encode(), digest_size=8).digest(), "little")
    return h & (1 << BITS) - 1, h >> 32 & (1 << BITS) - 1


def _bucket(utf8: bool, high: int) -> int:
    return (0 if utf8 else len(SIZES)) + next(i for i, n in enumerate(SIZES) if high <= n)


@lru_cache(maxsize=100_000)
def _script(char: str) -> str:
    return unicodedata.name(char, "?").split(" ")[0]


def _one_script(word: str) -> bool:
    return len({_script(c) for c in word if c.isalpha()}) <= 1


class Found:
    """What the chains make of one word: results, what each gains, and each chain's result."""

    __slots__ = ("best", "gains", "high", "outs", "which")

    def __init__(self, outs: list[str], gains: np.ndarray, which: np.ndarray, high: int):
        self.outs, self.gains, self.which, self.high = outs, np.append(gains, 0.0), which, high
        self.best = float(gains.max()) if len(gains) else 0.0

    def of_chains(self) -> np.ndarray:
        return self.gains[self.which]  # the last gain, 0, where a chain changes nothing


def _mixed(n: np.ndarray, of: np.ndarray, lower: np.ndarray, total: float) -> np.ndarray:
    """Probability of what was seen ``n`` times ``of`` so many, with the shorter context's in part.

    Contexts that hold less than ``RARE`` of the text count little at any size: garbled records among the clean ones make such.
    """
    part = 2.0 + 0.05 * of + RARE * total
    return (n + part * lower) / (of + part)


class Model:
    """Interpolated trigram model over hashed counts."""

    def __init__(self, counts: np.ndarray, total: float, margins: list[float] | None = None, decoy: bool = False):
        """``counts`` as of ``count_texts``, ``margins`` as of ``margins``."""
        self.counts, self.total = counts, max(total, 1.0)
        self.words = counts[N_GRAMS:]
        self.margins = margins or learned_margins({})
        self.chains = chains(decoy)
        self._found: dict[str, Found] = {}

    def knows(self, word: str) -> bool:
        """Whether clean records have ``word``, in which question marks stand for non-ASCII letters, twice or more."""
        return all(self.words[b] >= 2 for b in _word_keys(_other.sub("?", word.lower())))

    def margin(self, chain: int, high: int) -> float:
        """What a stretch with ``high`` non-ASCII characters must gain by the chain."""
        return self.margins[_bucket(chain < self.chains.n_utf8, high)]

    def logs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log-likelihood of every character of all framed ``texts``, the places where texts begin, and counts by themselves.

        An ASCII character after another costs ``FLOOR`` at most, since no chain makes one of it."""
        framed = [_framed(t) for t in texts]
        p = _points("".join(framed))
        places = [self.counts[k] for k in _keys(p)]
        n1, n2, n3 = places[0], np.minimum(places[1], places[2]), np.minimum(places[3], places[4])
        p1 = (n1 + 0.1) / (self.total + 0.1 * 20_000)
        p2 = _mixed(n2, np.concatenate([[self.total], n1[:-1]]), p1, self.total)
        p3 = _mixed(n3, np.concatenate([[self.total], n2[:-1]]), p2, self.total)
        logs = np.log(np.minimum(p3, 1.0))
        plain = p < 128
        plain[1:] &= plain[:-1]
        logs[plain] = np.maximum(logs[plain], FLOOR)
        logs[p == 2] = 0.0
        sizes = np.array([len(t) for t in framed])
        return logs, np.cumsum(sizes) - sizes, n1

    def scores(self, texts: list[str], floor: float = -np.inf) -> np.ndarray:
        logs, starts, _ = self.logs(texts)
        return np.add.reduceat(np.maximum(logs, floor), starts)

    def learn(self, words: Iterable[str]) -> None:
        """Scores every chain for those of ``words`` that were not seen before."""
        if len(self._found) > 50_000:
            self._found.clear()
        new = [w for w in dict.fromkeys(words) if w not in self._found]
        for i in range(0, len(new), 256):
            part = new[i : i + 256]
            made = [self.chains.outputs(w) for w in part]
            before = self.scores(part, FLOOR)
            flat = [x for outs, _ in made for x in outs]
            if flat:
                logs, starts, alone = self.logs(flat)
                sums = np.add.reduceat(logs, starts)
            j = 0
            for w, s, (outs, which) in zip(part, before, made, strict=True):
                gains = sums[j : j + len(outs)] - s if outs else np.zeros(0)
                for k in set(which[: self.chains.n_utf8].tolist()) - {-1}:
                    a = starts[j + k] + 2
                    fresh = np.flatnonzero(alone[a : a + len(outs[k])] == 0)
                    if len(fresh) and all(outs[k][f].isalpha() for f in fresh) and _one_script(outs[k]):
                        gains[k] += np.sum(np.maximum(logs[a + fresh], NOVEL) - logs[a + fresh])
                j += len(outs)
                self._found[w] = Found(outs, gains, which, sum(c > "\x7f" for c in w))

    def found(self, words: list[str]) -> list[Found]:
        if any(w not in self._found for w in words):
            self.learn(words)
            return [self._found[w] if w in self._found else self._again(w) for w in words]
        return [self._found[w] for w in words]

    def _again(self, word: str) -> Found:
        self.learn([word])
        return self._found[word]


def _stretch(gain: np.ndarray) -> range:
    """The consecutive words that gain most together."""
    best, at, total, start = 0.0, range(0), 0.0, 0
    for j, g in enumerate(gain):
        if total <= 0:
            total, start = 0.0, j
        total += g
        if total > best:
            best, at = total, range(start, j + 1)
    return at


def best_stretch(found: list[Found], first: int = 0, end: int | None = None) -> tuple[int, range, float]:
    """The chain (of those between ``first`` and ``end``), the words and the gain of the stretch that gains most."""
    rows = np.array([f.of_chains()[first:end] for f in found])
    total, best = np.zeros(rows.shape[1]), np.zeros(rows.shape[1])
    for row in rows:
        total = np.maximum(total, 0.0) + row
        best = np.maximum(best, total)
    k = int(np.argmax(best))  # the first of equals
    return first + k, _stretch(rows[:, k]), float(best[k])


def masked(line: str) -> tuple[str, list[str]]:
    """``line`` with ``MARK`` for each example, and the examples in their order."""
    taken: list[str] = []

    def blank(m: regex.Match) -> str:
        if m[0].isascii():
            return m[0]
        taken.append(m[0])
        return MARK

    if MARK in line or not _quote.search(line):
        return line, []

    def seen(sentence: str) -> str:
        if sentence.isascii():
            return sentence
        if _about.search(sentence):
            return _quoted.sub(blank, sentence)
        return _example.sub(blank, sentence) if _tests.search(sentence) else sentence

    return "".join(seen(x) for x in _sentence.split(line)), taken


def unmasked(line: str, taken: list[str]) -> str:
    parts = line.split(MARK)
    return "".join(x for pair in zip(parts, [*taken, ""], strict=True) for x in pair) if taken else line


def _cut(line: str) -> tuple[list[str], list[int]]:
    """The words of ``line`` and what parts them, and the places of its words that are not ASCII."""
    pieces = _parting.split(line)
    return pieces, [i for i, w in enumerate(pieces) if not w.isascii()]


def restore_line(line: str, model: Model, shown: set[str] = frozenset()) -> tuple[str, list[str]]:
    """The line restored and the chains that were undone, the last one applied first; none if it is sound.

    ``shown`` are chains that other lines of the document have shown; they need only ``AGAIN``.
    """
    undone: list[str] = []
    names = model.chains.names
    while not line.isascii():
        pieces, at = _cut(line)
        found = model.found([pieces[i] for i in at])
        if all(f.best <= 0 for f in found):
            break
        k, words, gain = best_stretch(found)
        need = AGAIN if names[k] in shown else model.margin(k, sum(found[j].high for j in words))
        if gain <= need:
            break
        for j in words:
            if (out := found[j].which[k]) >= 0:
                pieces[at[j]] = found[j].outs[out]
        line = "".join(pieces)
        if names[k] not in undone:
            undone.append(names[k])
    return line, undone


def _whole_text(lines: list[str], model: Model) -> str | None:
    """The chain that gains beyond the margin over all words of ``lines``, if there is one."""
    found = [f for line in lines for i in [_cut(line)] for f in model.found([i[0][j] for j in i[1]])]
    if all(f.best <= 0 for f in found):
        return None
    total = np.sum([f.of_chains() for f in found], axis=0)
    k = int(np.argmax(total))
    return model.chains.names[k] if total[k] > model.margin(k, sum(f.high for f in found)) else None


def _lost_letters(line: str, model: Model) -> bool:
    """Whether question marks stand in ``line`` where letters were."""
    if "?" not in line:
        return False
    if _about.search(line):
        line = _quoted.sub("", line)
    if len(_holes.findall(line)) > 1 or _blanked.search(line):
        return True
    ends = 0
    for token in _plain.finditer(line):
        if "?" not in token[0]:
            continue
        for w in _word.finditer(token[0]):
            inner = w[0].rstrip("?")
            if "?" in inner and len(inner) > 2 and not inner.isupper() and model.knows(inner):
                return True
            # a mark at the end of a word is a letter only where a sentence goes on, and where it does so twice
            goes_on = regex.match(r"\s+\p{Ll}", line[token.end() :]) and token.start() + w.end() == token.end()
            if goes_on and inner.isascii() and len(inner) > 1 and inner != w[0] and model.knows(w[0]):
                ends += 1
    return ends > 1


def _narrowed(text: str) -> tuple[str, list[str]]:
    """``text`` with stretches of two-byte characters that were read byte by byte put together; a zero is never sound text."""
    undone = []

    def read(m: re.Match) -> str:
        low = m[0].lstrip("ÿþ")[1:2] == "\x00"
        out = m[0].lstrip("ÿþ") if low else m[0].removeprefix("þÿ")
        undone.append(f"utf-16-{'le' if low else 'be'}>latin-1")
        try:
            return out.encode("latin-1").decode("utf-16-le" if low else "utf-16-be")
        except UnicodeError:
            return out.replace("\x00", "")

    return (_zeros.sub(read, text), list(dict.fromkeys(undone))) if "\x00" in text else (text, [])


def _line(line: str, model: Model, memory: dict) -> tuple[str, list[str], bool, bool]:
    """The line restored, chains undone, whether characters are lost after that, and whether marks of loss stood before."""
    if line not in memory:
        if len(memory) > 20_000:
            memory.clear()
        pieces, at = _cut(line)
        marks = _lost.search(line)
        if marks or any(f.best > 0 for f in model.found([pieces[i] for i in at])):
            seen, taken = masked(line)
            fixed, undone = restore_line(seen, model)
            memory[line] = (unmasked(fixed, taken) if undone else line, undone, bool(_lost.search(fixed)) or _lost_letters(fixed, model), bool(_lost.search(seen)))
        else:
            memory[line] = (line, [], _lost_letters(masked(line)[0], model) if "?" in line else False, False)
    return memory[line]


def inspect(text: str, model: Model, memory: dict) -> tuple[bool, str, list[str], bool]:
    """Whether ``text`` is affected, the text restored, the chains undone and whether characters are lost."""
    text, undone = _narrowed(text)
    lines = text.split("\n")
    high = [i for i, line in enumerate(lines) if not line.isascii()]
    lost = any(_lost_letters(line, model) for line in lines if "?" in line and line.isascii())
    results = {i: _line(lines[i], model, memory) for i in high}
    shown = {c for _, some, _, _ in results.values() for c in some}
    rest = [i for i in high if not results[i][1]]
    if not shown and len(rest) > 1 and (chain := _whole_text([masked(lines[i])[0] for i in rest], model)):
        shown = {chain}
    if shown:
        for i in rest:
            seen, taken = masked(lines[i])
            fixed, some = restore_line(seen, model, shown)
            if some:
                results[i] = (unmasked(fixed, taken), some, bool(_lost.search(fixed)) or _lost_letters(fixed, model), bool(_lost.search(seen)))
    for i, (fixed, some, still, marks) in results.items():
        lines[i] = fixed
        undone += [c for c in some if c not in undone]
        lost = lost or still or (marks and not some)
    return bool(undone) or lost, "\n".join(lines), undone, lost


@lru_cache(maxsize=200_000)
def _reads_as_utf8(run: str) -> bool:
    held = reduce(and_, map(_holders, run))
    for codec in ("cp1252", "latin-1", "cp1251", "cp437", "mac_roman", "cp1250"):
        if held & _BIT[codec]:
            try:
                _bytes(run, codec).decode("utf-8")
                return True
            except UnicodeDecodeError:
                pass
    return False


def _clean(text: str) -> bool:
    """No mark of lost text and no run that reads as UTF-8: good enough to learn from."""
    return not _lost.search(text) and not any(_reads_as_utf8(r) for r in set(_run.findall(text)) if len(r) > 1)


def _held_out(text: str) -> bool:
    return blake2b(text.encode("utf-8", "surrogatepass"), digest_size=2).digest()[0] % 10 == 0


def count_texts(texts: Iterable[str]) -> tuple[np.ndarray, int]:
    """What a model learns from ``texts``: counts of characters, then of words with non-ASCII letters, and the characters in all."""
    counts, total, words = np.zeros(N_ALL, dtype="int64"), 0, Counter()

    def add() -> int:
        if not words:
            return 0
        framed = [_framed(w) for w in words]
        n = np.repeat(np.fromiter(words.values(), dtype="int64"), [len(f) for f in framed])
        for keys in _keys(_points("".join(framed))):
            np.add.at(counts, keys, n)
        for w, m in words.items():
            if not w.isascii():
                for x in _letters.findall(w):
                    if not x.isascii() and len(p := _other.sub("?", x.lower())) > 1:
                        for b in set(_word_keys(p)):
                            counts[b + N_GRAMS] += m
        words.clear()
        return int(n.sum())

    for t in texts:
        if not t.isascii() and _clean(t):
            for line in t.split("\n"):
                if not line.isascii():
                    words.update(w for w in _parting.split(line)[::2] if w)
            if len(words) > 100_000:
                total += add()
    return counts, total + add()


def null_gains(texts: Iterable[str], model: Model) -> Counter:
    """Of the lines of ``texts``: (bucket of margins, half nats) of what the decoy chains of ``model`` gain; (-1, 0) counts all."""
    out, memory = Counter(), {}
    for t in texts:
        for line in t.split("\n"):
            if line.isascii():
                continue
            out[-1, 0] += 1
            if line not in memory:
                if len(memory) > 20_000:
                    memory.clear()
                pieces, at = _cut(line)
                found = model.found([pieces[i] for i in at])
                memory[line] = None
                if any(f.best > 0 for f in found):
                    memory[line] = [
                        (_bucket(part == 0, sum(found[j].high for j in words)), int(np.ceil(gain * 2)))
                        for part in (0, 1)
                        for _, words, gain in [best_stretch(found, *((0, model.chains.n_utf8), (model.chains.n_utf8, None))[part])]
                        if gain > 0
                    ]
            out.update(memory[line] or ())
    return out


def learned_margins(nulls: dict[tuple[int, int], int]) -> list[float]:
    """The least half nats that at most ``FALSE_SHARE`` of all lines exceed, by bucket, and at least the logarithm of the number
    of chains: each is as likely as any other before the text is seen."""
    allowed, least = FALSE_SHARE * nulls.get((-1, 0), 0), [float(np.log(n)) for n in (2 * len(_ALL), len(chains().names))]
    out = []
    for i in range(2 * len(SIZES)):
        tail, m = 0, 0
        for (_, g), n in sorted(((k, n) for k, n in nulls.items() if k[0] == i), reverse=True):
            tail += n
            if tail > allowed:
                m = g
                break
        out.append(max(least[i // len(SIZES)], m / 2))
    return out


_MODELS: dict[str, tuple[Model, dict]] = {}


def _of_worker(name: str, shared: Broadcast, decoy: bool) -> tuple[Model, dict]:
    """The model and the memory of lines that all tasks of a Python worker share; one model at a time."""
    if name not in _MODELS:
        _MODELS.clear()
        _MODELS[name] = Model(*shared.value, decoy=decoy), {}
    return _MODELS[name]


def train(documents: DataFrame, text: str = "text") -> Model:
    """Counts over all clean records, in ``2 * 2 ** BITS`` buckets, of which at most twice as many rows come to the driver (those
    that train and those held out), and margins validated on the held-out ones."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, held = [], []
        sums = [np.zeros(N_ALL, dtype="int64"), np.zeros(N_ALL, dtype="int64")]
        totals = [0, 0]
        for batch in batches:
            kept, held = [], []
            for t in batch["t"]:
                (held if _held_out(t) else kept).append(t)
            for part, texts in enumerate((kept, held)):
                counts, total = count_texts(texts)
                sums[part] += counts
                totals[part] += total
        for part in (0, 1):
            at = np.flatnonzero(sums[part])
            yield pd.DataFrame({"part": part, "bucket": np.append(at, -1), "n": np.append(sums[part][at], totals[part])})

    texts = spread(documents.select(F.col(text).alias("t")).where(F.col("t").rlike(r"[^\x00-\x7f]")))
    rows = texts.mapInPandas(count, "part int, bucket bigint, n bigint").groupBy("part", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts, totals = np.zeros((2, N_ALL), dtype="float64"), [0.0, 0.0]
    for part in (0, 1):
        of = rows[rows["part"] == part]
        real = of["bucket"] >= 0
        counts[part][of["bucket"][real]] = of["n"][real]
        totals[part] = float(of["n"][~real].sum())
    shared = documents.sparkSession.sparkContext.broadcast((counts[0].astype("float32"), totals[0]))

    name = uuid.uuid4().hex

    def validate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, seen = _of_worker(name, shared, True)[0], Counter()
        for batch in batches:
            seen.update(null_gains((t for t in batch["t"] if _held_out(t) and _clean(t)), model))
        yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["size", "gain", "n"])

    nulls = texts.mapInPandas(validate, "size int, gain int, n bigint").groupBy("size", "gain").agg(F.sum("n").alias("n")).collect()
    return Model(counts.sum(axis=0), sum(totals), learned_margins({(r["size"], r["gain"]): r["n"] for r in nulls}))


def garbled(documents: DataFrame, key: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """Affected documents: key, restored (the text as far as it can be had), chains (undone, comma-separated), lost.

    ``lost`` says that characters are gone for good. Null and empty texts are never affected. Repeated rows stay as
    they are; an empty table gives an empty result; other columns are ignored. Without ``model`` it is trained on
    ``documents``.
    """
    model = model or train(documents, text)
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast((model.counts.astype("float32"), model.total, model.margins))
    types = dict(documents.dtypes)

    name = uuid.uuid4().hex

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        learned, memory = _of_worker(name, shared, False)
        for batch in batches:
            rows = []
            for k, t in zip(batch["k"], batch["t"], strict=True):
                hit, fixed, undone, lost = inspect(t, learned, memory)
                if hit:
                    rows.append((k, fixed, ", ".join(undone), lost))
            yield pd.DataFrame(rows, columns=[key, "restored", "chains", "lost"])

    texts = spread(documents.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("t").rlike(SUSPECT)))
    return texts.mapInPandas(find, f"`{key}` {types[key]}, restored string, chains string, lost boolean")
