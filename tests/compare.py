"""Order-free comparison of a DataFrame with a DuckDB result."""

import math


def value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(value, v))
    return v


def rows_of(rows, names):
    order = sorted(names)
    return sorted((tuple(value(r[names.index(c)]) for c in order) for r in rows), key=repr)


def assert_same(df, con, sql):
    got = rows_of([tuple(r) for r in df.collect()], df.columns)
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = rows_of(cur.fetchall(), names)
    assert got == want
