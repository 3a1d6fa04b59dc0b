from collections import Counter


def _norm(v):
    if isinstance(v, float):
        return round(v, 5) + 0.0
    return tuple(v) if isinstance(v, list) else v


def same_rows(df, cursor):
    """Equal columns and equal rows, whatever their order."""
    names = [d[0] for d in cursor.description]
    columns = sorted(df.columns)
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = Counter(tuple(_norm(r[i]) for i in at) for r in cursor.fetchall())
    got = Counter(tuple(map(_norm, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    assert got == want
