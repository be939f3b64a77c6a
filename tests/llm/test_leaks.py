import random

import regex

from loomgraph.llm.leaks import Templates, classes, leaks, reparameterised

CASES = "id string, difficulty string, question string, reference_answer string, source_files array<string>, reference_contexts array<string>, doc_id long"
DOCS = "doc_id long, text string, case_id string"
Q = "Why must CachedParser call fetch_query ahead of reserve_watcher whenever 17 stale edges of GROSSE Straße remain open in core.kernel?"
A = "Because EagerCursorBuilder stores only narrow references, resolve_cursor rebuilds one archive per lattice, hands it over and waits 30 ms."
C = "Phương thức được ghi đè trong lớp để giữ nguyên thứ tự của các phần tử trong mô-đun này mãi mãi."


def words(t):
    return regex.findall(r"[\p{L}\p{N}]+", t.upper().lower())


def brute(docs, cases, n=12):
    out = set()
    for d, text, *_ in docs:
        w = words(text or "")
        have = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        for c in cases:
            for p in [c[2], c[3], *(c[5] or [])]:
                v = words(p or "")
                if any(tuple(v[i : i + n]) in have for i in range(len(v) - n + 1)):
                    out.add((d, c[0]))
    return out


def data():
    rnd = random.Random(2)
    cases = [("g1", "x", Q, A, [], [C, None], 1), ("g2", "x", None, None, None, None, 1), ("g3", "x", "too short", A, [], [], 1), ("g4", "x", "Other " + C, None, [], [], None)]
    w = Q.split()
    docs = [(1, f"intro {Q} outro", "k"), (2, Q.upper(), None), (3, " -- ".join(w), None), (4, " ".join(w[:11]), None), (5, " ".join(w[3:15]), None), (6, None, None), (7, "", None), (8, "filler " * 30_000 + A, None), (9, C.lower(), None), (10, f"{A} {A}", None), (1, f"intro {Q} outro", "k")]
    for i in range(11, 60):
        p = rnd.choice([Q, A, C]).split()
        a = rnd.randrange(len(p))
        b = rnd.randrange(a, len(p)) + 1
        docs.append((i, "lead " + "\u00a0".join(p[a:b]) + " tail", None))
    return docs, cases


def test_against_brute_force(spark):
    docs, cases = data()
    d, c = spark.createDataFrame(docs, DOCS), spark.createDataFrame(cases, CASES)
    rows = [tuple(r) for r in leaks(d, c).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute(docs, cases)
    assert {tuple(r) for r in leaks(d, c, max_broadcast_rows=0).collect()} == set(rows)  # by shuffle


def test_other_slots_are_no_leak_but_a_reparameterised_question(spark):
    _, cases = data()
    other = Q.replace("CachedParser", "EagerBuilder").replace("17", "99").replace("fetch_query", "resolve_cursor")
    same_twice = A.replace("30 ms", "45 ms")
    docs = spark.createDataFrame([(1, other, None), (2, same_twice, None), (3, "nothing of the kind", None), (4, A, None)], DOCS)
    c = spark.createDataFrame(cases, CASES)
    assert (1, "g1") not in {tuple(r) for r in leaks(docs, c).collect()}
    for most in (1_000_000, 0):
        found = reparameterised(docs, c, max_broadcast_rows=most).join(classes(c), "class_id").select("doc_id", "case_id").distinct()
        assert {tuple(r) for r in found.collect()} == {(1, "g1"), (2, "g1"), (2, "g3")}


def test_planted_reparameterised_questions(spark):
    """Recall and precision over planted pairs: 150 cases, each asked again with other names and numbers, beside other texts."""
    rnd = random.Random(4)
    nouns, verbs = [f"{a}{b}" for a in ("Cached", "Eager", "Lazy", "Typed", "Wide") for b in ("Parser", "Cursor", "Ledger", "Router")], ["drops", "keeps", "copies", "merges", "hides", "splits", "skips"]
    common = "the old entries of each open batch before it can reach any later step of that same plan when no other worker has".split()

    def ask(i):
        r = random.Random(i)
        w = [r.choice(common) for _ in range(18)]
        return lambda a, b, k: f"Why does {a} {verbs[i % 7]} {' '.join(w[:9])} {k} rows while {b} {' '.join(w[9:])}?"

    pick = lambda: (*rnd.sample(nouns, 2), rnd.randrange(10, 99))
    cases, docs, truth = [], [], set()
    for i in range(150):
        q, own = ask(i), pick()
        cases.append((f"g{i}", "x", q(*own), None, [], [], 1))
        other = pick()
        while set(other) & set(own):
            other = pick()
        docs.append((i, f"note {i}: {q(*other)} and so on", None))
        truth.add((i, f"g{i}"))
        docs.append((1000 + i, f"note {i}: {ask(5000 + i)(*pick())} and so on", None))
    c, d = spark.createDataFrame(cases, CASES), spark.createDataFrame(docs, DOCS)
    got = {tuple(r) for r in reparameterised(d, c).join(classes(c), "class_id").select("doc_id", "case_id").distinct().collect()}
    assert len(got & truth) >= 0.9 * len(truth) and len(got & truth) >= 0.9 * len(got)


def test_types_of_words():
    t = Templates(frozenset({"eager", "cursor", "builder"}), 12)
    assert [t.kind(w) for w in ("eagercursorbuilder", "cursor", "eagercursors", "ms", "12", "v2", "word")] == ["I", "I", "", "U", "N", "N", ""]
    assert t.kind("eager" * 2000 + "x") == ""


def test_empty_tables(spark):
    docs, cases = data()
    d, c = spark.createDataFrame(docs, DOCS), spark.createDataFrame(cases, CASES)
    assert leaks(d.limit(0), c).count() == 0 and leaks(d, c.limit(0)).count() == 0
    assert reparameterised(d.limit(0), c).count() == 0 and reparameterised(d, c.limit(0)).count() == 0
