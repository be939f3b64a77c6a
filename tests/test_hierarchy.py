import random

import pytest

from loomgraph.operators.hierarchy import descendants, parent_links, preorder, resolve_hierarchy

LINKS = "child string, parent string, depth int, node_id string"


def brute(links):
    parent = {}
    for c, p, *_ in links:
        if c and p:
            parent[c] = min(p, parent.get(c, p))
    ids = {x for c, p, *_ in links if c and p for x in (c, p)}
    out = {}
    for x in ids:
        path, seen = [x], {x}
        while path[-1] in parent and parent[path[-1]] not in seen:
            path.append(parent[path[-1]])
            seen.add(path[-1])
        cyclic = path[-1] in parent
        out[x] = ("", -1, []) if cyclic else (path[-1], len(path) - 1, path[::-1])
    return out


def shapes():
    rnd = random.Random(7)
    chain = [(f"c{i}", f"c{i + 1}", None, None) for i in range(150)]
    star = [(f"s{i}", "hub", 1, "x") for i in range(200)]
    tree = [(f"t{i}", f"t{rnd.randrange(i)}", None, None) for i in range(1, 300)]
    cycle = [(f"y{i}", f"y{(i + 1) % 17}", None, None) for i in range(17)] + [("below", "y3", None, None), ("deeper", "below", None, None)]
    odd = [("self", "self", None, None), ("z", None, None, None), (None, "z", None, None), ("", "q", None, None), ("two", "b", None, None), ("two", "a", None, None), ("pair1", "pair2", None, None), ("pair2", "pair1", None, None)]
    return chain + star + tree + cycle + odd + chain[:20]


def test_against_brute_force(spark):
    links = shapes()
    rows = resolve_hierarchy(spark.createDataFrame(links, LINKS), with_path=True).collect()
    expected = brute(links)
    assert len(rows) == len(expected)
    assert {r.node_id: (r.root_id, r.depth, r.path) for r in rows} == expected


def test_without_path_and_descendants(spark):
    links = [x for x in shapes() if not (x[0] or "").startswith("c")]
    known = resolve_hierarchy(spark.createDataFrame(links, LINKS))
    assert {(r.node_id, r.root_id, r.depth) for r in known.collect()} == {(k, v[0], v[1]) for k, v in brute(links).items()}
    pairs = {(r.ancestor_id, r.node_id, r.distance) for r in descendants(resolve_hierarchy(spark.createDataFrame(links, LINKS), True)).collect()}
    assert pairs == {(a, k, v[1] - i) for k, v in brute(links).items() for i, a in enumerate(v[2][:-1])}


def test_long_chain_takes_few_rounds(spark):
    chain = spark.range(2000).selectExpr("concat('n', id) AS child", "concat('n', id + 1) AS parent")
    rows = resolve_hierarchy(chain, max_rounds=40).collect()
    assert max(r.depth for r in rows) == 2000 and {r.root_id for r in rows} == {"n2000"}


def test_empty(spark):
    assert resolve_hierarchy(spark.createDataFrame([], LINKS)).count() == 0
    assert descendants(resolve_hierarchy(spark.createDataFrame([], LINKS), True)).count() == 0


@pytest.mark.parametrize("rel,expected", [("DEFINES", ("b", "a")), ("WEAK_LINK", ("a", "b"))])
def test_direction(spark, rel, expected):
    edges = spark.createDataFrame([("a", rel, "b"), ("a", "CALLS", "x"), ("a", rel, ""), (None, rel, "b")], "src_id string, rel string, dst_id string")
    assert [tuple(r) for r in parent_links(edges).collect()] == [expected]


def test_sizes_and_ranges(spark):
    links = shapes()
    df = spark.createDataFrame(links, LINKS)
    expected = brute(links)
    below = {k: sum(k in v[2] for v in expected.values()) for k, v in expected.items()}
    known = resolve_hierarchy(df, with_size=True).collect()
    assert {r.node_id: r.size for r in known} == {k: below[k] if v[1] >= 0 else 0 for k, v in expected.items()}
    got = preorder(df).collect()
    assert {(r.node_id, r.root_id, r.depth) for r in got} == {(k, v[0], v[1]) for k, v in expected.items() if v[1] >= 0}
    by_root = {}
    for r in got:
        by_root.setdefault(r.root_id, []).append(r)
    for rows in by_root.values():
        assert sorted(r.first for r in rows) == list(range(len(rows)))
        for r in rows:
            assert {x.node_id for x in rows if r.first < x.first <= r.last} == {k for k, v in expected.items() if r.node_id in v[2] and k != r.node_id}
    assert preorder(spark.createDataFrame([], LINKS)).count() == 0
