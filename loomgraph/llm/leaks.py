"""Evaluation passages leaking into training text, by template canonicalisation (problem 8).

Words are runs of letters and digits of any script, case ignored. A template word is the word itself, or a typed placeholder
if it is a number, a unit or a name (a part of the identifiers or of the capitalised words within sentences of the evaluation
set, or built of such parts). The type depends on the word alone, so equal windows always have equal templates. A placeholder
also says how far back the same word stood in the window: equal templates therefore mean that the words in the slots of one
window can be put for those of the other one to one. Windows of ``n`` template words of both sides are hashed and joined by
hash; equal slots are a leak as it stands, other slots a re-parameterised question.

The evaluation side is grouped by template. Its hashes are broadcast only if they are at most ``max_broadcast_rows``; a document
is then read once and only hashes of windows that match leave it. Otherwise all hashes leave it and the join shuffles.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.durable import Workspace
from loomgraph.functions.spreading import spread

#: Words that name units.
UNITS = frozenset(
    "ms us ns s sec secs second seconds min mins minute minutes h hour hours day days b kb mb gb tb kib mib gib byte bytes px hz khz "
    "mhz ghz percent usd eur".split()
)
#: Words of a window that must be no placeholders for a re-parameterised question: fewer say nothing about the question.
LEAST_WORDS = 7
#: Words whose type a task remembers at most.
REMEMBERED = 500_000

_word = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Runs of letters and digits. Upper and lower case in turn fold sharp s too."""
    return _word.findall(text.upper().lower())


def passages(cases: DataFrame) -> DataFrame:
    """case_id, text: question, reference answer and each reference context. Null ones are none."""
    texts = F.concat(F.array("question", "reference_answer"), F.coalesce("reference_contexts", F.array().cast("array<string>")))
    return cases.select(F.col("id").alias("case_id"), F.explode(texts).alias("text")).where(F.col("text").isNotNull())


def name_parts(texts: DataFrame, text: str = "text") -> frozenset[str]:
    """Parts (at capitals, underscores and dots) of the identifiers in ``texts``, and words capitalised within a sentence.

    They grow with the vocabulary of the evaluation set, never with the corpus.
    """
    identifier = r"\b(\w*\p{Ll}\p{Lu}\w*|\p{L}+(?:[_.]\p{L}+)+)\b|(?<=[\p{Ll},] )(\p{Lu}\p{Ll}+)\b"
    part = r"(\p{Lu}?\p{Ll}+|\p{Lu}+(?!\p{Ll}))"
    parts = (
        texts.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(identifier), 0)).alias("name"))
        .select(F.explode(F.regexp_extract_all("name", F.lit(part), 1)).alias("part"))
        .where(F.length("part") > 1).distinct()
    )
    return frozenset(w for r in parts.collect() for w in words(r["part"]))


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


class Templates:
    """Hashes of the windows of texts. Words and their types are remembered."""

    def __init__(self, parts: frozenset[str], n: int):
        self.parts, self.n = parts, n
        self.longest = max(map(len, parts), default=0)
        self.powers = np.random.default_rng(8).integers(0, 1 << 63, n, dtype="uint64") * np.uint64(2) + np.uint64(1)
        self.known: dict[str, tuple[int, int]] = {}

    def kind(self, word: str) -> str:
        """'' or the word's placeholder: N number, U unit, I name."""
        if any(c.isnumeric() for c in word):
            return "N"
        if word in UNITS:
            return "U"
        return "I" if word in self.parts or len(word) >= 8 and self._built(word) else ""

    def _built(self, word: str) -> bool:
        """Whether ``word`` is nothing but parts; every start is looked at once."""
        reached = {0}
        for end in range(2, len(word) + 1):
            if any(a in reached and word[a:end] in self.parts for a in range(max(0, end - self.longest), end - 1)):
                reached.add(end)
        return len(word) in reached

    def _word(self, word: str) -> tuple[int, int]:
        """What stands for the word in templates, and for the word itself if it is a placeholder, else 0."""
        if word not in self.known:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            kind = self.kind(word)
            self.known[word] = (_hash(f"\x01{kind}"), _hash(word) | 1) if kind else (_hash(word), 0)
        return self.known[word]

    def windows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each window of all ``texts``: the number of its text, hashes of its template and of its slots, and how many of its words
        are no placeholders. Texts lie one after another; windows over two of them are left out."""
        found = [words(t) for t in texts]
        ends = np.cumsum([len(w) for w in found])
        pairs = [self.known.get(w) or self._word(w) for ws in found for w in ws]
        count = len(pairs) - self.n + 1
        if count < 1:
            return (np.zeros(0, dtype="int64"),) * 4
        both = np.array(pairs, dtype="uint64")
        shown, slot = both[:, 0], both[:, 1]
        at = np.flatnonzero(slot)
        back = np.zeros(len(pairs), dtype="uint64")  # how far back the same slot stood, 0 if it did not
        order = at[np.argsort(slot[at], kind="stable")]
        same = slot[order[1:]] == slot[order[:-1]]
        back[order[1:][same]] = (order[1:] - order[:-1])[same]
        template, slots = np.zeros(count, dtype="uint64"), np.zeros(count, dtype="uint64")
        plain = np.zeros(count, dtype="int64")
        for j, p in enumerate(self.powers):
            here = slice(j, j + count)
            seen = np.where(back[here] <= j, back[here], 0)  # within the window
            template += (shown[here] ^ seen * np.uint64(0x9E3779B97F4A7C15)) * p
            slots += slot[here] * p
            plain += slot[here] == 0
        first = np.searchsorted(ends, np.arange(count), side="right")
        kept = np.arange(count) + self.n <= ends[first]
        return first[kept], template[kept].view("int64"), slots[kept].view("int64"), plain[kept]


@lru_cache(maxsize=2)
def _templates(parts: frozenset[str], n: int) -> Templates:
    """One for all tasks of a worker."""
    return Templates(parts, n)


def gold_windows(held: DataFrame, parts: frozenset[str], n: int) -> DataFrame:
    """Distinct windows of the evaluation side: template, slots, case_id, plain."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = _templates(parts, n)
        for batch in batches:
            if not len(batch):
                continue
            of, template, slots, plain = t.windows(batch["text"].tolist())
            yield pd.DataFrame({"template": template, "slots": slots, "case_id": batch["case_id"].to_numpy(dtype=object)[of], "plain": plain})

    return held.mapInPandas(run, "template bigint, slots bigint, case_id string, plain bigint").distinct()


def _matches(documents: DataFrame, key: str, text: str, parts: frozenset[str], n: int, gold: DataFrame, by: list[str], most: int) -> DataFrame:
    """doc_id, template, slots, windows of the corpus windows whose ``by`` (template, or template and slots) ``gold`` has."""
    spark = documents.sparkSession
    wanted = gold.select(*by).distinct()
    few = wanted.limit(most + 1).count() <= most
    shared = None
    if few:
        rows = wanted.toPandas()  # at most ``most`` pairs of numbers
        shared = spark.sparkContext.broadcast(np.sort(_joined([rows[c].to_numpy(dtype="int64") for c in by])))
    kind = dict(documents.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = _templates(parts, n)
        for batch in batches:
            keys = batch["k"].to_numpy()
            for at in range(0, len(batch), 256):  # so many texts at once
                of, template, slots, _ = t.windows(batch["t"].iloc[at : at + 256].tolist())
                if shared is not None and len(template):
                    mine, held = _joined([template, slots][: len(by)]), shared.value
                    hit = held[np.minimum(np.searchsorted(held, mine), len(held) - 1)] == mine if len(held) else np.zeros(len(mine), dtype=bool)
                    of, template, slots = of[hit], template[hit], slots[hit]
                if len(template):
                    rows = pd.DataFrame({"doc_id": of + at, "template": template, "slots": slots})
                    rows = rows.groupby(["doc_id", "template", "slots"], as_index=False).size().rename(columns={"size": "windows"})
                    yield rows.assign(doc_id=keys[rows["doc_id"].to_numpy()])

    texts = spread(documents.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("t").isNotNull()))
    return texts.mapInPandas(run, f"doc_id {kind}, template bigint, slots bigint, windows bigint")


def _joined(columns: list[np.ndarray]) -> np.ndarray:
    """One number of one or two; the join that follows compares the columns themselves."""
    return columns[0] if len(columns) == 1 else columns[0] ^ (columns[1] * np.int64(-0x61C8864680B583EB))


def _held(cases: DataFrame, n: int) -> tuple[DataFrame, frozenset[str]]:
    held = passages(cases.select("id", "question", "reference_answer", "reference_contexts")).distinct()
    parts = name_parts(held)
    return Workspace(cases.sparkSession, "evaluation").cut(gold_windows(held, parts, n), "windows"), parts


def leaks(
    documents: DataFrame, cases: DataFrame, key: str = "doc_id", text: str = "text", n: int = 12, max_broadcast_rows: int = 1_000_000
) -> DataFrame:
    """Distinct (doc_id, case_id): at least ``n`` consecutive words of a passage of the case stand in the text.

    Passages or texts that are null, or shorter than ``n`` words, leak nothing; empty tables give an empty result; repeated
    rows and passages count once; other columns are ignored.
    """
    gold, parts = _held(cases, n)
    found = _matches(documents, key, text, parts, n, gold, ["template", "slots"], max_broadcast_rows)
    pairs = gold.select("template", "slots", "case_id").distinct()
    return found.join(pairs, ["template", "slots"]).select("doc_id", "case_id").distinct()


def template_classes(gold: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(template, class_id) and (class_id, case_id): templates that the same cases have are one class."""
    sets = gold.where(F.col("plain") >= LEAST_WORDS).groupBy("template").agg(F.array_sort(F.collect_set("case_id")).alias("cases"))
    sets = sets.withColumn("class_id", F.xxhash64("cases"))
    return sets.select("template", "class_id"), sets.select("class_id", F.explode("cases").alias("case_id")).distinct()


def reparameterised(
    documents: DataFrame, cases: DataFrame, key: str = "doc_id", text: str = "text", n: int = 12, max_broadcast_rows: int = 1_000_000
) -> DataFrame:
    """Passages that stand in a text with other numbers, units or names: doc_id, class_id, windows.

    A window counts if its template is one of the evaluation side with ``LEAST_WORDS`` words of its own, while its slots are those
    of no case of that template. A class stands for all cases that share its templates (see ``classes``), so a template of many
    cases gives one row per document.
    """
    gold, parts = _held(cases, n)
    of_template = template_classes(gold)[0]
    found = _matches(documents, key, text, parts, n, gold.join(of_template, "template", "left_semi"), ["template"], max_broadcast_rows)
    other = found.join(gold.select("template", "slots").distinct(), ["template", "slots"], "left_anti")
    return other.join(of_template, "template").groupBy("doc_id", "class_id").agg(F.sum("windows").alias("windows"))


def classes(cases: DataFrame, n: int = 12) -> DataFrame:
    """The members of the classes of ``reparameterised``: class_id, case_id."""
    return template_classes(_held(cases, n)[0])[1]
