import pytest

from seamline import catalog

from .compare import assert_same


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_duckdb(name, spark, data, duck):
    assert_same(catalog.queries()[name](spark, data), duck, catalog.oracle_sql()[name])


def test_every_query_is_checked():
    """Those without SQL have a test of their own here."""
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == {"stream_line_watch"}


def test_stream_line_watch(spark, data):
    """Against a plain reading of each conversation: lines with the pattern, equal ones in a row folded, by turn."""
    want, conversations = [], {}
    for r in sorted(spark.read.parquet(f"{data}/conversations.parquet").collect(), key=lambda r: (r.conv_id, r.turn)):
        at = conversations.get(r.conv_id, 0)
        rows = []
        for line in r.text.split("\n"):
            size = len(line.encode()) + 1
            if "The" in line:
                if rows and rows[-1][1] == line and rows[-1][3] == at:
                    rows[-1][2:] = [rows[-1][2] + 1, at + size]
                else:
                    rows.append([at, line, 1, at + size])
            at += size
        conversations[r.conv_id] = at
        want += [(str(r.conv_id), offset, line, n, 0, None) for offset, line, n, _ in rows]
    assert want and all(x[3] <= 50 for x in want)
    found = catalog.queries()["stream_line_watch"](spark, data).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["doc_id", "line_no", "col", "line"]
