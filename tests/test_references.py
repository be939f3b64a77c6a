import datetime as dt

from loomgraph.operators.references import decided, heavy_groups, live_intervals, orphan_references, orphan_report, per_key_and_period, references

EDGES = "edge_id long, src_id string, rel string, dst_id string, repository string, observed_at timestamp, loaded_at timestamp, status string"
NODES = "id string, loaded_at timestamp, deleted_at timestamp, endpoint string"


def day(n):
    return dt.datetime(2025, 1, 1) + dt.timedelta(days=n)


def brute(edges, nodes):
    out = set()
    for e in edges:
        for end, ref in (("src", e[1]), ("dst", e[3])):
            if not ref:
                continue
            at = e[6] or dt.datetime.max
            rows = [n for n in nodes if n[0] == ref]
            since = lambda n: n[1] or dt.datetime.min
            if any(since(n) <= at and (n[2] is None or n[2] > at) for n in rows):
                continue
            out.add((e[0], end, "missing" if not rows else "late" if any(since(n) > at for n in rows) else "deleted"))
    return out


def cases():
    nodes = [("a", day(0), None, "x"), ("b", day(0), day(5), "x"), ("b", day(8), None, "x"), ("c", day(20), None, "x"), ("d", day(1), day(2), None), (None, day(0), None, None), ("e", None, day(9), None), ("hot", day(3), day(60), None), ("hot", day(40), day(41), None)]
    nodes += [("hot", day(3), day(60), None)]
    edges = [(1, "a", "CALLS", "b", "r", day(1), day(6), "z"), (2, "b", "CALLS", "c", None, None, day(9), None), (3, "d", None, "", "r", day(1), day(3), None), (4, None, "USES", "nowhere", "r", day(1), day(1), None), (5, "e", "USES", "A", "r", day(1), None, None), (1, "a", "CALLS", "b", "r", day(1), day(6), "z")]
    edges += [(100 + i, "hot", "CALLS", "gone" if i % 3 else "hot", "r", day(i), day(i), None) for i in range(80)]
    return edges, nodes


def found(df):
    return {(r.edge_id, r.endpoint, r.status) for r in df.collect()}


def test_against_brute_force(spark):
    edges, nodes = cases()
    e, n = spark.createDataFrame(edges, EDGES), spark.createDataFrame(nodes, NODES)
    expected = brute(edges, nodes)
    assert found(orphan_references(e, n)) == expected
    assert found(orphan_references(e, n, max_broadcast_rows=5)) == expected  # groups by shuffle, live intervals by broadcast
    assert found(orphan_references(e, n, max_broadcast_rows=0)) == expected  # live intervals salted
    assert len(orphan_references(e, n).collect()) == len(expected)  # repeated edges count once


def test_heavy_groups_are_bounded(spark):
    edges, nodes = cases()
    groups = decided(per_key_and_period(references(spark.createDataFrame(edges, EDGES))), spark.createDataFrame(nodes, NODES))
    assert "hot" in {r.ref for r in heavy_groups(groups, 2).collect()}
    assert heavy_groups(groups, 2).count() <= 8
    assert {(r.ref, r.status) for r in groups.where("ref IN ('gone', 'a')").collect()} == {("gone", "missing"), ("a", "live")}


def test_intervals_merge(spark):
    _, nodes = cases()
    rows = live_intervals(spark.createDataFrame(nodes, NODES)).where("ref = 'hot'").collect()
    assert max(r.until for r in rows) == day(60)


def test_empty_tables(spark):
    edges, nodes = cases()
    none_e, none_n = spark.createDataFrame([], EDGES), spark.createDataFrame([], NODES)
    assert orphan_references(none_e, spark.createDataFrame(nodes, NODES)).count() == 0
    assert {s for _, _, s in found(orphan_references(spark.createDataFrame(edges, EDGES), none_n))} == {"missing"}
    assert orphan_report(none_e, none_n).count() == 0


def test_report_counts(spark):
    edges, nodes = cases()
    for most in (1_000_000, 5, 0):
        rows = orphan_report(spark.createDataFrame(edges, EDGES), spark.createDataFrame(nodes, NODES), max_broadcast_rows=most).collect()
        assert sum(r.missing + r.late + r.deleted for r in rows) == len(brute(edges, nodes))
    assert sum(r.missing + r.late + r.deleted for r in rows) == len(brute(edges, nodes))
    assert sum(r.refs for r in rows) == len({(e[0], end) for e in edges for end in (1, 3) if e[end]})
