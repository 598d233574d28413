import datetime as dt

import pytest
from pyspark.sql import functions as F

from seamline.functions import secrets, urls
from seamline.functions import text as X
from seamline.operators import compress, envelope, graph, grep, health, relational, search, vector
from seamline.sources import pages, tables


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_lexical_score(spark):
    d = docs(spark, "abcdef", "abcabc", "zz")
    p = d.select("doc_id", F.explode(X.trigrams(F.col("text"))).alias("trigram"))
    import math

    want = {0: 1 / (1 + math.log(4)), 1: 1 / (1 + math.log(3))}
    assert {r.doc_id: r.score for r in grep.lexical_scores(d, ["abc"]).collect()} == pytest.approx(want)


def test_indexed_grep_equals_plain(spark):
    d = docs(spark, "alpha beta\ngamma", "nothing", "beta\nalpha gamma beta", "")
    for p in ("alpha.*beta", "gam+a", "x|beta", "."):
        a = grep.indexed_grep(d, p).select("doc_id", "line_no")
        b = grep.grep(d, p).select("doc_id", "line_no")
        assert got(a) == got(b)


def test_conflicts(spark):
    d = docs(spark, "x\n<<<<<<<\na\n<<<<<<<\nb\n>>>>>>>\n>>>>>>>\n<<<<<<<\n>>>>>>>")
    assert got(grep.conflict_regions(X.lines(d, "doc_id"), "doc_id")) == [(0, 4, 6), (0, 8, 9)]


def test_exact_before_window_and_anchors(spark):
    d = docs(spark, "limit exceeds the {cap}-character cap now", "exceeds\nthe other\ncap of", "exceeds\n\n\n\ncap")
    e = search.exact_evidence(d, "exceeds the {cap}-character cap", ["exceeds", "cap"])
    assert got(e) == [(0, "verbatim", 1), (1, "window", None)]
    assert search.literal_runs("INFO opening [4821] failed safely") == ["opening", "failed safely"]
    a = search.anchored(docs(spark, "WARN opening [17] failed safely\nopening safely", "failed safely opening"), "INFO opening [4821] failed safely")
    assert got(a) == [(0, 1, 20)]


def test_fusion_admits_positions_inside_the_tier(spark):
    rows = [("a", 0, 1.0, "x", 1, 0.8), ("a", 500, 9.0, "y", 2, 0.2), ("b", 199, 2.0, "y", 2, 0.2), ("c", 250, 3.0, "x", 1, 0.8)]
    lane = spark.createDataFrame(rows, "doc_id string, pos int, raw double, lane string, lane_order int, weight double")
    f = {r.doc_id: r for r in search.fuse([lane]).collect()}
    assert f["a"].tier == 200 and f["a"].fusion_score == pytest.approx(0.8 / 61) and f["a"].best_lane == "y"
    assert f["b"].fusion_score == pytest.approx(0.2 / 260) and f["c"].tier == 400


def test_paging_is_checked(spark):
    with pytest.raises(ValueError):
        search.page(spark.range(1), [F.col("id")], -1)


def test_confidence(spark):
    kind = "rank int, exact string, fusion_score double"
    one = lambda *r: search.confidence(spark.createDataFrame(list(r), kind)).first().confidence
    assert one((1, "verbatim", None), (2, None, 0.5)) == "high"
    assert one((1, None, 1.0), (2, None, 0.99)) == "low"
    assert one((1, None, 1.0), (2, None, 0.5)) == "high"
    assert one((1, None, 1.0)) == "high"


def test_vectors(spark):
    import random

    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(16)]) for i in range(400)] + [(400, [0.0] * 16)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = [rng.gauss(0, 1) for _ in range(16)]
    assert got(vector.pruned_top_k(vector.quantise(v), q, 7)) == got(vector.top_k(v, q, 7))
    tail = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 1.0])], v.schema)
    assert [r.vec_id for r in vector.top_k(tail, [1.0, 0.0], 3).collect()] == [0, 1, 2]
    bad = spark.createDataFrame([(0, [1.0, float("nan")]), (1, [1.0])], v.schema)
    assert vector.top_k(bad, [1.0, 0.0], 3).count() == 0
    boost = tail.select(vector.cosine(F.col("embedding"), F.array(F.lit(1.0), F.lit(0.0)), F.col("vec_id") == 1).alias("s")).collect()
    assert [round(r.s, 6) for r in boost] == [1.0, 1.1, 0.0, 0.0]


@pytest.mark.parametrize("pattern,literal", [("b c", True), ("bcd", True), ("a.*d", False), ("b[cx] |zz+y", False), ("(ab|bc)c", False), ("x", True), ("B C", True), ("abca", True)])
def test_indexed_grep_equals_grep(spark, pattern, literal):
    import random

    rng = random.Random(41)
    d = docs(spark, *("".join(rng.choice("abcdxyzABC \n.") for _ in range(rng.randint(0, 60))) for _ in range(150)), "zzzy b c", "é b c", "")
    index = grep.publish_index(d)
    want = got(grep.grep(d, pattern, literal=literal).select("doc_id", "line_no", "line"))
    for ix in (None, index):
        assert got(grep.indexed_grep(d, pattern, literal=literal, index=ix).select("doc_id", "line_no", "line")) == want


def test_posting_lists_equal_plain_reading():
    """In windows of any size: line ends, texts' ends, other planes, nulls, undecodable bytes, repeated keys."""
    import random

    import pyarrow as pa

    from seamline.functions import postings

    rng = random.Random(5)
    texts = ["".join(rng.choice("abAB \n.é\U0001f600\0") for _ in range(rng.randint(0, 70))) for _ in range(60)] + ["", None, "\n\n", "ab\n", "abc"]
    keys = [f"k{i % 50}" for i in range(len(texts))]
    want = {}
    for k, t in zip(keys, texts):
        for line in (t or "").translate(str.maketrans(X.UPPER, X.LOWER)).split("\n"):
            for i in range(len(line) - 2):
                bit = 1 << (ord(line[i + 3]) * 31 & 7) if i + 3 < len(line) else 0
                want[line[i : i + 3], k] = want.get((line[i : i + 3], k), 0) | bit
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[a : a + 40]), pa.array(texts[a : a + 40])], ["k", "t"]) for a in (0, 40)]
    for piece, window in ((1 << 22, 1 << 22), (200, 1 << 22), (1 << 22, 7), (300, 1), (1 << 22, 64)):
        found = {}
        for b in postings.posting_lists(batches, piece, window):
            for r in b.to_pylist():
                for k, m in zip(r["keys"], r["masks"], strict=True):
                    found[r["trigram"], k] = found.get((r["trigram"], k), 0) | m
        assert found == want
    bad = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([b"abcd\xc3\nwxyz"]).view(pa.string())], ["k", "t"])
    assert {"abc", "bcd", "wxy", "xyz"} <= {r for b in postings.posting_lists([bad]) for r in b.column(0).to_pylist()}
    many = [chr(i) for i in range(0x100, 0xD800)] + [chr(i) for i in range(0x10000, 0x40000)]
    wide = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(["".join(many)] + ["abc"] * 999)], ["k", "t"])
    lists = [(t, n) for b in postings.posting_lists([wide]) for t, n in zip(b.column(0).to_pylist(), b.column(1).value_lengths().to_pylist())]
    assert {("".join(many[i : i + 3]), 1) for i in range(len(many) - 2)} == {g for g in lists if g[0] != "abc"}
    assert sum(n for t, n in lists if t == "abc") == 999


def test_index_of_a_long_text(spark):
    """The work grows with the text, not with its square; equal keys are one row."""
    import time

    long = " ".join(str(i * i) for i in range(40000))
    d = spark.createDataFrame([(1, long), (1, "abc\nabcz"), (2, "xyz")], "doc_id long, text string")
    began = time.time()
    index = grep.publish_index(d)
    assert got(index.where("trigram = 'abc'")) == [("abc", 1, 1 << (ord("z") * 31 & 7))]
    assert index.where("doc_id = 1").count() == len({long[i : i + 3] for i in range(len(long) - 2)} | {"abc", "bcz"})
    assert time.time() - began < 60


def test_few_candidates_leave_the_texts_where_they_are(spark):
    """The candidates' size counts, not that of the index they come from; a text of any length is searched."""
    long = " ".join(str(i * i) for i in range(40000)) + "\nThe needle"
    d = docs(spark, *(f"{i * 7919} {i * 104729} {i * i}" for i in range(2000)), long)
    index = grep.publish_index(d)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "16k")
    try:
        found = grep.indexed_grep(d, "[Tt]he needle", index=index).select("doc_id", "line_no", "line")
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    assert got(found) == [(2000, 2, "The needle")]


def test_masks_rule_documents_out(spark):
    """All trigrams are there, but never with the character that must follow."""
    d = docs(spark, "abc bcd", "abcd")
    index = grep.publish_index(d)
    q = grep.trigram.of_string("abcd")
    assert got(grep.index_candidates(index, q)) == [(0,), (1,)]
    assert got(grep.index_candidates(index, q, follows={"abc": "d"})) == [(1,)]


def test_graph(spark):
    e = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "a"), ("d", "d"), ("c", "e")], "src string, dst string")
    assert graph.shortest_path(e, "b", "c").first().path == ["b", "a", "c"]
    assert graph.shortest_path(e, "e", "a").count() == 0
    assert got(graph.callers(e, "c", 2)) == [("a", 1), ("b", 2)]
    assert got(graph.cycles(e)) == [("a", "a", 2), ("b", "a", 2), ("d", "d", 1)]
    n = spark.createDataFrame([(x,) for x in "abcdef"], "node string")
    assert got(graph.dead_nodes(n, e, n.where("node = 'b'"))) == [("d",), ("f",)]
    assert got(graph.call_tree(e, "b", 3)) == [(["b", "a", "c", "e"], 3), (["b", "a", "c"], 2), (["b", "a"], 1), (["b"], 0)]
    assert got(graph.trace_to(e, n.where("node = 'b'"), "e")) == [(["b", "a", "c", "e"],)]
    rows, totals = graph.impact(e, "e")
    assert rows.count() == 3 and totals.first().total_affected == 3 and totals.first().reason is None


def test_graph_of_many_levels(spark):
    """No walk stops before there is nothing new to reach."""
    e = spark.range(0, 130).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    n = spark.range(0, 133).withColumnRenamed("id", "node")
    assert got(graph.dead_nodes(n, e, n.where("node = 0"))) == [(131,), (132,)]


def test_cycles_equal_brute_force(spark):
    import random

    rng = random.Random(17)
    for size, many in ((9, 13), (14, 22)):
        pairs = [(rng.randrange(size), rng.randrange(size)) for _ in range(many)]
        far = {i: {i} for i in range(size)}
        for _ in range(size):
            for a, b in pairs:
                for i in far:
                    if a in far[i]:
                        far[i] |= {b}
        want = []
        for i in range(size):
            same = [j for j in range(size) if j in far[i] and i in far[j]]
            if len(same) > 1 or (i, i) in pairs:
                want.append((i, min(same), len(same)))
        want.sort(key=str)
        assert got(graph.cycles(spark.createDataFrame(pairs, "src int, dst int"))) == want
    ring = [(i, (i + 1) % 8) for i in range(8)]
    assert got(graph.cycles(spark.createDataFrame(ring, "src int, dst int"))) == sorted(((i, 0, 8) for i in range(8)), key=str)


def test_import_cycles(spark):
    rows = [("self", "self", "static"), ("d", "d", "dynamic"), ("a", "b", "static"), ("b", "a", "static"), ("t", "t", "type"), ("x", "y", "static"), ("y", "x", "dynamic")]
    found = graph.import_cycles(spark.createDataFrame(rows, "src string, dst string, kind string"))
    assert got(found) == [
        ("a", "a", 2, "static"), ("b", "a", 2, "static"), ("d", "d", 1, "dynamic-only"), ("self", "self", 1, "static"), ("x", "x", 2, "dynamic-only"), ("y", "x", 2, "dynamic-only"),
    ]


def test_call_sites(spark):
    calls = spark.createDataFrame(
        [("b", "a", "f1", 3, "a(1)", False), ("b", "a", "f1", 9, "a(2)", False), ("c", "b", "f2", 1, "b()", False), ("t", "a", "f3", 1, "a()", True), ("d", "c", "f4", 2, "c()", False)],
        "src string, dst string, file string, line int, expression string, is_test boolean",
    )
    sites, totals = graph.call_sites(calls, "a", 2)
    assert [(r[0], r[3], r[5], r[6]) for r in got(sites)] == [("b", 3, 1, "direct"), ("b", 9, 1, "direct"), ("c", 1, 2, "transitive")]
    assert got(totals) == [(2, 2, 3, 1)]
    assert got(graph.call_sites(calls, "a", 5, include_tests=True)[1]) == [(4, 4, 5, 0)]
    base = spark.createDataFrame([("x", "lib", "go"), ("y", "lib", "go"), ("z", "lib", "stop")], "file string, target_file string, target_name string")
    own = spark.createDataFrame([("y", "lib", "stop"), ("w", "lib", "go")], base.schema)
    assert got(graph.caller_files(base, own, "lib", "go")) == [("w",), ("x",)]
    names = spark.createDataFrame([("x", "go", "symbol"), ("y", "go", "reference"), ("y", "go", "reference")], "file string, name string, kind string")
    assert got(graph.files_with_name(names, "go")) == [("x",), ("y",)] and got(graph.files_with_name(names, "go", "reference")) == [("y",)]


def test_data_flow(spark):
    flows = [("a", "b", "assign"), ("b", "f.p", "call"), ("f.p", "f.q", "assign"), ("f.q", "g.p", "call"), ("a", "h.p", "unknown"), ("h.p", "f.q", "assign"), ("g.p", "a", "call")]
    start = spark.createDataFrame([("a", "a")], "origin string, node string")
    found = graph.data_flow(spark.createDataFrame(flows, "src string, dst string, kind string"), start, 2)
    assert got(found) == [
        ("a", "a", 0, False), ("a", "b", 0, False), ("a", "f.p", 1, False), ("a", "f.q", 1, False), ("a", "g.p", 2, False), ("a", "h.p", 1, True),
    ]


def test_braces_in_globs():
    import re

    assert re.match(tables.glob_pattern("app/**/{page,layout}.{ts,tsx}"), "app/x/y/page.tsx")
    assert not re.match(tables.glob_pattern("app/**/{page,layout}.{ts,tsx}"), "app/x/other.ts")
    assert re.match(tables.glob_pattern("a,b"), "a,b") and re.match(tables.glob_pattern("{x"), "{x")


def test_ranks_equal_sort(spark):
    rows = [(i, (i * 37) % 11 + (5000 if i % 3 else 0)) for i in range(50)]
    want = {k: n + 1 for n, (k, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}
    found = relational.global_rank(spark.createDataFrame(rows, "k int, v long"), "v", "k", 3)
    assert {r.k: r["rank"] for r in found.collect()} == want


def test_initialisers(spark):
    inits = spark.createDataFrame([("p", "i"), ("p", "j")], "package string, init string")
    calls = spark.createDataFrame([("p", "i"), ("p", "m")], "package string, caller string")
    pairs, counts = graph.initialiser_edges(inits, calls)
    assert pairs.count() == 3 and got(counts) == [("p", 3)]


def test_exports(spark):
    ex = spark.createDataFrame([("a", "x", False), ("a", "y", False), ("b", "z", False), ("c", "m", True), ("n", "q", False)], "file string, name string, is_entry boolean")
    im = spark.createDataFrame([("m", "r", "x", "named"), ("m", "n", "*", "namespace"), ("m", "b", "z", "type")], "file string, target string, name string, kind string")
    re_ = spark.createDataFrame([("r", "x", "a", "x")], "file string, name string, target string, target_name string")
    assert got(graph.export_verdicts(ex, im, re_)) == [
        ("a", "x", "used"), ("a", "y", "unused"), ("b", "z", "unused"), ("c", "m", "public_api"), ("n", "q", "uncertain"),
    ]


def test_folds(spark):
    rows = X.lines(docs(spark, "a\na\na\na\nb\nb", "x"), "doc_id")
    folded = compress.text_of(compress.fold_consecutive(rows, "doc_id"), "doc_id", ["start", "part"])
    assert got(folded) == [(0, "a\n... (3 more)\nb\nb"), (1, "x")]
    assert got(compress.generic(docs(spark, "\x1b[31mred\x1b[0m"))) == [(0, "red")]


def test_markers_and_lines(spark):
    d = docs(spark, "x TODO: fix FIXME\nno\nHACK it", "", "TODOS")
    assert got(health.marker_lines(d)) == [(0, 1, "TODO", "fix FIXME"), (0, 3, "HACK", "it")]
    assert [r.n for r in d.select(X.line_count(F.col("text")).alias("n")).collect()] == [3, 1, 1]


def test_python_reports():
    src = "import os\nclass A:\n    def f(self, x):\n        if x and os.path:\n            return [i for i in x if i]\n        def g():\n            for _ in x: h(1)\n"
    assert health.python_functions(src) == [("A.f", 3, 4), ("A.f.g", 6, 2)]
    assert health.python_functions("def (") == []
    assert ("A.f.g", "h", 7, "unresolved") in health.python_calls(src)


def test_relational(spark):
    a = spark.createDataFrame([(1, 10), (1, 20), (2, 5)], "k int, t int")
    b = spark.createDataFrame([(1, 12, "p"), (1, 10, "q"), (2, 9, "r")], "k int, t2 int, v string")
    assert got(relational.as_of(a, b, ["k"], "t", "t2").select("k", "t", "r_v")) == [(1, 10, "q"), (1, 20, "p"), (2, 5, None)]
    assert got(relational.within(a, b, ["k"], "t", "t2", 1, 5).select("k", "t", "t2")) == [(1, 10, 12), (2, 5, 9)]
    up = relational.upsert(a, spark.createDataFrame([(1, 1)], "k int, t int"), ["k"], "t")
    assert got(up) == [(1, 1), (2, 5)]


def test_envelope(spark):
    r = envelope.envelope(spark.range(30), 10, "Rows", causes=["cap", "depth"], narrow="path").first()
    assert (r.shown, r.total, r.reason, r.trailer) == (10, 30, "depth", "[10 of 30 Rows; path]")
    assert envelope.envelope(spark.range(3), 10, "Rows").first().trailer is None


def test_secrets(spark):
    import base64
    from urllib.parse import quote

    key = "s3cr3t/key+value-0123456789"
    for pre in ("", "a", "ab"):
        text = " ".join([key, base64.b64encode((pre + key + "zz").encode()).decode(), key.encode().hex().upper(), quote(key, safe="")])
        out = spark.createDataFrame([(text,)], "t string").select(secrets.scrub(F.col("t"), key, "k").alias("t")).first().t
        assert key not in out and key.encode().hex().upper() not in out and quote(key, safe="") not in out
        assert out.count("{{ck-secret:k}}") == 4
    found = spark.createDataFrame([("a {{ck-secret:db_1}} {{ck-secret:}} {{ck-secret:x}}",)], "t string").select(secrets.placeholders(F.col("t")).alias("p")).first().p
    assert found == ["db_1", "x"]


def test_urls(spark):
    df = spark.createDataFrame([("https://U@Ex.Org:80/a/b?q=1#f",), ("https://ex.org/a%2fb",), ("x",)], "u string")
    r = df.select(urls.host(F.col("u")).alias("h"), urls.path(F.col("u")).alias("p"), urls.covers("ex.org", "/a", F.col("u")).alias("c")).collect()
    assert [tuple(x) for x in r] == [("ex.org", "/a/b", True), ("ex.org", "/a%2fb", False), ("", "", False)]
    psl = F.array(F.lit("org"), F.lit("co.uk"))
    d = spark.createDataFrame([("a.b.co.uk",), ("org",), ("x.org",)], "h string").select(urls.registrable(F.col("h"), psl).alias("r")).collect()
    assert [x.r for x in d] == ["b.co.uk", None, "x.org"]


def test_page_references():
    html = '<base href="/b/"><base href="/c/"><img src=a.png srcset="x.png 1x, y.png 2x"><link rel="stylesheet" href="s.css"><style>@import "i.css"; p{background:url(u.png)}</style><p style="background:url(\'v.png\')"><!-- <img src=no> --><script>var x="<img src=no>"</script><img src="z&amp;1">'
    assert pages.html_references(html) == [
        ("/b/", "base"), ("a.png", "src"), ("x.png", "srcset"), ("y.png", "srcset"), ("s.css", "link"), ("i.css", "style"),
        ("u.png", "style"), ("v.png", "style"), ("z&1", "src"),
    ]
    assert pages.srcset_urls("a,b 1x,, data:x,y 2x") == ["a,b", "data:x,y"]


def test_issues(spark):
    doc = '{"number":3,"title":"t","body":"b","author":{"login":"u"},"comments":{"nodes":[{"body":"c","author":{"login":"v"}}]}}'
    rows = pages.issue_rows(spark.createDataFrame([(doc,), ("{",)], "doc string").where("doc like '%number%'"))
    assert got(rows.select("kind", "by", "body")) == [("comment", "v", "c"), ("issue", "u", "b")]


def test_stat_evidence(spark):
    df = spark.createDataFrame([(1, 1, 9_000_000_000, 1_000_000_000), (1, 2, 9_000_000_000, 1_000_000_000), (1, 1, 2_000_000_000, 1_000_000_000)], "size int, o_size int, checked_ns long, ctime_ns long")
    assert [r.u for r in df.select(health.unchanged(["size"]).alias("u")).collect()] == [True, False, False]


def test_grants(spark):
    g = spark.createDataFrame([("o", "s", 2, "admin", None), ("o", "s", 1, "admin", None)], "owner string, scope_ref string, epoch int, role string, ended_at long")
    s = spark.createDataFrame([("o", "s", 1), ("o", "s", 2)], "owner string, scope_ref string, epoch int")
    a = spark.createDataFrame([("o", "s", 2, "x")], "owner string, scope_ref string, epoch int, agent string")
    assert got(relational.batch_grants(g, s, a, ["admin"]).select("epoch", "agent")) == [(2, "x")]


def test_dates_stay_naive(spark):
    assert spark.createDataFrame([(dt.datetime(2024, 1, 1),)], "t timestamp").first().t == dt.datetime(2024, 1, 1)


def test_structural_search(spark):
    from seamline.operators import structural

    files = spark.createDataFrame([("a.py", "print(x, x)\nprint(x, y)\nlog(1, 2, 3)\nlog(4)"), ("b.py", "def ("), ("c.py", None)], "path string, text string")
    assert got(structural.search(files, "print($A, $A)")) == [("a.py", 1, 1, "print(x, x)", 1)]
    assert [r[1] for r in got(structural.search(files, "log($$$ARGS)"))] == [3, 4]
    assert [r[3] for r in got(structural.search(files, "log($A, $$$REST)"))] == ["log(1, 2, 3)", "log(4)"]


def test_imports(spark):
    from seamline.functions import imports

    rows = [
        ("src/a.ts", "typescript", 1, "import {x} from './b'"), ("src/a.ts", "typescript", 2, "import type {T} from '../t'"), ("m.py", "python", 1, "from os.path import join"),
        ("m.py", "python", 2, "import sys"), ("x.go", "go", 1, '  f "fmt"'), ("x.c", "c", 1, "#include <stdio.h>"), ("x.rs", "rust", 1, "pub use a::b;"), ("x.rs", "rust", 2, "let x"),
    ]
    found = imports.imports(spark.createDataFrame(rows, "path string, language string, line_no int, line string"))
    assert [(r[0], r[2], r[3]) for r in got(found)] == [
        ("m.py", "os.path", False), ("m.py", "sys", False), ("src/a.ts", "./b", False), ("src/a.ts", "../t", True), ("x.c", "stdio.h", False), ("x.go", "fmt", False), ("x.rs", "a::b", False),
    ]
    files = spark.createDataFrame([("src/b/index.ts",), ("src/b.js",), ("t.ts",)], "path string")
    assert {r.target: r.file for r in imports.resolve(found, files).collect()} == {"./b": "src/b.js", "../t": "t.ts"}


def test_dispatch_and_reuse(spark):
    calls = spark.createDataFrame([(1, "A", "f"), (2, None, "g"), (3, None, "f")], "call int, receiver_type string, method string")
    methods = spark.createDataFrame([("A.f", "A", "f"), ("B.f", "B", "f"), ("B.g", "B", "g")], "target string, type string, method string")
    assert got(graph.dispatch(calls, methods)) == [(1, "A.f", "type_match"), (2, "B.g", "name_match")]
    rec = spark.createDataFrame([("i", "k", "1"), ("i", "l", "2"), ("j", "k", "1")], "item string, key string, answer string")
    assert got(graph.reusable(rec, spark.createDataFrame([("k", "1"), ("l", "3")], "key string, answer string"))) == [("j",)]
    assert got(graph.invalidated(spark.createDataFrame([("l",)], "key string"), rec)) == [("i",)]
    est = spark.createDataFrame([("a", 1, 8), ("a", 2, 4)], "k string, o int, v int")
    assert got(graph.running_estimate(est, "k", "o", "v")) == [("a", 3)]
    none = []
    n = spark.createDataFrame(
        [
            ("g", "src/x.py", False, [("route", "app")]), ("h", "app/shop/[id]/page.tsx", True, none), ("i", "src/c.ts", False, [("Get", "@nestjs/common")]),
            ("j", "src/c.ts", False, [("Get", "other")]), ("k", "app/shop/page.css", True, none), ("l", "app/page.tsx", False, none),
        ],
        "node string, path string, exported boolean, decorators array<struct<name string, module string>>",
    )
    assert got(graph.framework_roots(n, ["next"])) == [("g", "decorator"), ("h", "route"), ("i", "decorator")]


def test_redirects_and_audit(spark):
    chains = spark.createDataFrame([(1, ["https://a.com/x", "https://b.com/", "https://a.com/x/y"])], "chain int, hops array<string>")
    assert [r[3] for r in got(secrets.redirect_verdicts(chains, [("a.com", "/x")]))] == [True, False, False]
    rec = spark.createDataFrame([("fine",), ("k0123456789abcdef!",)], "note string")
    assert secrets.audit_lines(rec, "k0123456789abcdef").count() == 1


def test_small_operators(spark, tmp_path):
    import base64
    import json

    import xxhash

    from seamline.plans import router

    d = docs(spark, "a &amp; b", "\u00e9", None)
    assert [r.x for r in d.select(X.html_decoded(F.col("text")).alias("x")).collect()] == ["a & b", "\u00e9", None]
    assert [r.x for r in d.select(X.xxhash32(F.col("text")).alias("x")).collect()] == [xxhash.xxh32_intdigest(b"a &amp; b"), xxhash.xxh32_intdigest("\u00e9".encode()), None]
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"abc": 257}
    (tmp_path / "ranks").write_bytes(b"\n".join(base64.b64encode(k) + b" %d" % v for k, v in ranks.items()))
    t = docs(spark, "abc ab x", "")
    assert [r.x for r in t.select(X.bpe_tokens(F.col("text"), str(tmp_path / "ranks"), r"\S+|\s+").alias("x")).collect()] == [5, 0]
    u = spark.createDataFrame([("http://a.com/x?y=1",), ("http://a.com",), ("http://a.com?q",), ("http://a.com/#f",)], "url string")
    assert [r.x for r in u.select(urls.request_target(F.col("url")).alias("x")).collect()] == ["/x?y=1", "/", "/?q", None]
    assert urls.within_limits({"a": ["/"]}) and not urls.within_limits({"a": ["/"] * 9}) and not urls.within_limits({str(i): ["/"] for i in range(5)}) and not urls.within_limits({})
    assert relational.exists_in_any([d.limit(0), d]) and not relational.exists_in_any([d.limit(0), d.limit(0)])
    rows = spark.createDataFrame([(1, "x,\"y", None), (2, None, [1, 2])], "a int, b string, c array<int>")
    tables.write_json_arrays(rows.coalesce(1), str(tmp_path / "json"))
    assert sorted(json.loads(r.value) for r in spark.read.text(str(tmp_path / "json")).collect()) == [[1, 'x,"y', None], [2, None, [1, 2]]]
    assert router.split_lanes({"lexical": True, "pattern_mention": True}) == ["lexical", "pattern_mention"]
    assert router.lanes_or_next("regex", {"semantic": True}) == [("semantic", 0.6)]
    assert router.lanes_or_next("identifier", {"lexical": True, "semantic": True, "exact": True}) == [("exact", 0.0), ("lexical", 0.8), ("semantic", 0.2)]
