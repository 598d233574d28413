import random
import re

import pytest
from pyspark.sql import functions as F

from seamline.functions import text as X
from seamline.plans import router, trigram
from seamline.sources import tables


def grams(s):
    s = s.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return {s[i : i + 3] for i in range(len(s) - 2)}


PATTERNS = [
    "abc", "abcd", "ab", "a.c", "abc|def", "(abc|def)ghi", "ab+c", "ab*cde", "[a-c]bcd", "x(abc)?y", "^abc$", "abc.*def",
    "(foo|bar)+baz", "a{3}", "a{2,5}b", "[ab][cd][ef]", "hello\\s+world", "(?:ab|cd)(?:ef|gh)", "\\bword\\b", "", "[^a]bc", "(a|b|)cde",
]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_query_holds_wherever_the_pattern_matches(pattern):
    rng = random.Random(pattern)
    q = trigram.plan(pattern)
    pieces = ["abc", "def", "ghi", "foo", "bar", "baz", "hello", " ", "world", "word", "a", "b", "c", "d", "e", "f", "cde", "bcd", "aaa"]
    for _ in range(3000):
        s = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 6)))
        if re.search(pattern, s):
            assert q.holds(grams(s)), (pattern, s, q)


def test_queries_say_something():
    assert trigram.plan("abcd").grams() == {"abc", "bcd"}
    assert trigram.plan("ab") == trigram.ALL
    assert trigram.plan("FOObar").grams() == {"foo", "oob", "oba", "bar"}
    assert trigram.plan("abc|def").kind == "or"
    assert trigram.plan("abc.*def").kind == "and"


@pytest.mark.parametrize("pattern", ["(?=a)b", "(?<!a)b", "(a)\\1", "a++"])
def test_unsupported_is_refused(pattern):
    with pytest.raises(ValueError):
        trigram.plan(pattern)


def test_simplification():
    a, b = trigram.Query("gram", "abc"), trigram.Query("gram", "bcd")
    assert trigram.conj(a, trigram.ALL) == a and trigram.conj(a, trigram.NONE) == trigram.NONE
    assert trigram.disj(a, trigram.ALL) == trigram.ALL and trigram.disj(a, trigram.NONE) == a
    assert trigram.conj(b, a, a) == trigram.conj(a, b)


def test_masks(spark):
    df = spark.createDataFrame([("FooX fooy foo",), ("ab",), ("É",)], "t string")
    rows = df.select(X.positions(F.col("t")).alias("p")).collect()
    assert {(r.trigram, r.next) for r in rows[0].p if r.trigram == "foo"} == {("foo", "x"), ("foo", "y"), ("foo", None)}
    assert rows[1].p == [] and rows[2].p == []
    bit = spark.createDataFrame([("x",), (None,)], "c string").select(X.next_bit(F.col("c")).alias("b")).collect()
    assert bit[0].b == 1 << (ord("x") * 31 & 7) and bit[1].b == 0


def test_shapes_and_lanes():
    assert router.classify("foo.*bar") == "regex"
    assert router.classify("2024-01-02T10:11 failed to open") == "log_excerpt"
    assert router.classify("src/lib/main.rs") == "path"
    assert router.classify("handle(x);") == "code_literal"
    assert router.classify("snake_case_name") == "identifier"
    assert router.classify("how are pages merged here") == "natural_language"
    assert router.classify("two words") == "short"
    assert router.lanes("natural_language") == [("exact", 0.0), ("lexical", 0.4), ("semantic", 0.6)]
    assert router.lanes("regex") == [("pattern", 0.0), ("lexical", 1.0)]
    assert router.lanes("short", semantic=False) == [("exact", 0.0), ("lexical", 0.8)]


def test_variants():
    got = router.variants("getUserName")
    assert got[:4] == ["get_user_name", "get-user-name", "GetUserName", "GET_USER_NAME"] and len(got) <= 6
    assert router.variants("") == []
    assert router.split_words("HTTPServer_v2") == ["HTTP", "Server", "v2"]


def test_scopes(spark):
    assert tables.roots_of("a/b a c a/b/d") == ["a", "c"]
    df = spark.createDataFrame([("a/x.py",), ("a/b/y.ts",), ("node_modules/z.js",), ("keep/z.log",), ("z.log",)], "p string")
    pick = lambda c: [r.p for r in df.where(c).collect()]
    assert pick(tables.globbed(F.col("p"), ["**/*.py"])) == ["a/x.py"]
    assert pick(tables.globbed(F.col("p"), [], ["a/**"])) == ["node_modules/z.js", "keep/z.log", "z.log"]
    assert pick(tables.ignored(F.col("p"), ["node_modules/", "*.log", "!keep/*.log"])) == ["node_modules/z.js", "z.log"]
    assert pick(tables.under(F.col("p"), ["a"])) == ["a/x.py", "a/b/y.ts"]


def test_generations(spark, tmp_path):
    root = str(tmp_path)
    a = tables.publish(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), root)
    b = tables.publish(spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), root)
    assert sorted(tuple(r) for r in tables.snapshot(spark, root).collect()) == [(2, "c"), (3, "d")]
    tables.compact(spark, root, [a, b], "k", 2)
    assert sorted(tuple(r) for r in tables.snapshot(spark, root).collect()) == [(1, "a"), (2, "c"), (3, "d")]


def test_fan_out(spark):
    def build(n):
        if n < 0:
            raise OSError("gone")
        return spark.range(n)

    rows, gaps = tables.fan_out({"a": 2, "b": -1, "c": 1}, build)
    assert rows.count() == 3 and gaps == [("b", "OSError")]


def test_fan_out_of_a_source_lost_on_the_way(spark, tmp_path):
    import shutil

    for name in ("a", "b"):
        spark.range(5).write.parquet(str(tmp_path / name))
    frames = {n: spark.read.parquet(str(tmp_path / n)) for n in ("a", "b")}
    shutil.rmtree(tmp_path / "b")
    rows, gaps = tables.fan_out(frames, lambda df: df)
    assert rows.count() == 5 and [n for n, _ in gaps] == ["b"]

    def broken(_):
        raise KeyError("a mistake")

    with pytest.raises(KeyError):
        tables.fan_out({"a": 1}, broken)
