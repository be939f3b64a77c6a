"""Rows of a Spark result against rows of an SQL result, whatever their order."""

from collections import Counter


def _key(value):
    return repr(round(value, 6) + 0.0) if isinstance(value, float) else str(value)


def same_rows(df, con, sql: str) -> None:
    columns = sorted(df.columns)
    mine = Counter(tuple(_key(r[c]) for c in columns) for r in df.collect())
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    theirs = Counter(tuple(_key(row[i]) for i in at) for row in result.fetchall())
    assert mine == theirs, (list((mine - theirs).items())[:3], list((theirs - mine).items())[:3])
