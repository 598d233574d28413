"""The ten operators and the pipeline: DuckDB where SQL can express them, brute force, round trips and edge cases."""

import hashlib
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from seamline import llm
from seamline.llm import chat, decontaminate, fingerprint, html_extract, minhash, mixing, sharding, token_counts, toxicity, url_filter

from ..compare import assert_same

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def documents(spark, texts, sources=None, extra=False):
    data = [(i, t, "en", (sources or ["s"] * len(texts))[i], len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(data, DOC)
    return df.withColumns({"size": F.lit("x"), "items": F.lit(1), "k0": F.lit(2), "score": F.lit("y"), "a": F.lit(0)}) if extra else df


def odd_documents(spark):
    """Nulls, empties, a very long text, ties, repeated rows and clashing names."""
    texts = ["a b c d e f g", None, "", " \n\t ", "a b c d e f g", "word " * 50_000, "x", "x", "\\ <| é\u00a0日本 #!"]
    d = documents(spark, texts, ["s", None, "s", "t", "s", "t", None, "u", "u"], extra=True)
    return d.unionByName(d.where("doc_id in (0, 1)")).unionByName(d.where("doc_id = 6").withColumn("doc_id", F.lit(None).cast("long")))


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_equals_duckdb(name, spark, data, duck):
    assert_same(llm.queries()[name](spark, data), duck, llm.oracle_sql()[name])


# 1 ------------------------------------------------------------------------------------------------------------------


def best_split(word, trie):
    """Least tokens of the most probable segmentation, by plain search."""
    best = {0: (0.0, 0)}
    for i in range(1, len(word) + 1):
        nb = len(word[i - 1].encode())
        options = [(best[i - 1][0] + nb * trie.byte, best[i - 1][1] + nb)]
        options += [(best[j][0] + trie.pieces[word[j:i]], best[j][1] + 1) for j in range(i) if word[j:i] in trie.pieces]
        best[i] = max(options, key=lambda o: (o[0], -o[1]))
    return best[len(word)][1]


def test_token_counts_equal_brute_force(spark, data):
    pieces = token_counts.load_pieces()
    trie = token_counts.Trie(pieces)
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(40)
    got = {r.doc_id: r for r in token_counts.token_counts(docs.select("doc_id", "text"), pieces).collect()}
    for r in docs.collect():
        ws = token_counts.PRETOKEN.findall("▁" + r.text.replace(" ", "▁"))
        assert got[r.doc_id].n_pretokens == len(ws)
        assert got[r.doc_id].n_tokens == sum(best_split(w, trie) * c for w, c in Counter(ws).items())


def test_full_trie_changes_nothing():
    pieces = ["▁a", "b", "ab", "bc", "c", "▁ab"]
    small, large = token_counts.Trie(pieces, max_nodes=5), token_counts.Trie(pieces)
    for t in ("ab abc bca  cab", "é ab", "a" * 100, "abc " * 30):
        assert small.counts(t) == large.counts(t)


def test_token_counts_odd(spark):
    got = token_counts.token_counts(odd_documents(spark), ["▁a", "x"])
    assert got.count() == 12 and {r.n_tokens for r in got.where("text is null or text = ''").collect()} == {0}


def test_token_counts_empty(spark):
    assert token_counts.token_counts(documents(spark, ["a"]).limit(0), ["a"]).count() == 0


# 2 ------------------------------------------------------------------------------------------------------------------


def brute_hits(text, items, window=10):
    ws = decontaminate.words((text or "").encode())
    hit, found = set(), set()
    for i, t in items:
        w = decontaminate.words((t or "").encode())
        for g in range(max(1, len(w) - window + 1) if w else 0):
            gram = w[g : g + window]
            for s in range(len(ws) - len(gram) + 1):
                if ws[s : s + len(gram)] == gram:
                    hit |= set(range(s, s + len(gram)))
                    found.add(str(i))
    return len(ws), len(hit), sorted(found)


@pytest.mark.parametrize("block_bytes", [1 << 20, 100])
def test_phrases_equal_brute_force(spark, block_bytes):
    rng = random.Random(5)
    word = lambda: rng.choice("abcd")
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 2, 3, 9, 10, 12])))) for i in range(8)] + [(9, None), (3, "a b"), (None, "d d d")]
    texts = [" ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(40)] + [None, "", items[3][1] + ". " + items[4][1].upper()]
    got = decontaminate.find_items(
        documents(spark, texts, extra=True), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes
    ).collect()
    items = [("" if i is None else i, t) for i, t in items]
    for r in got:
        n, hit, found = brute_hits(r.text, items)
        assert (r.n_words, sum(s.end - s.start for s in r.spans), r.items) == (n, hit, found)


def test_proximity(spark):
    docs = documents(spark, ["x one two q three y", "one q q q two three", "three two one", "one two", "three"])
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    assert [r.doc_id for r in decontaminate.find_items(docs, bench, slop=1).where(F.size("spans") > 0).collect()] == [0]
    assert [r.doc_id for r in decontaminate.find_items(docs, bench).where(F.size("spans") > 0).collect()] == []
    assert decontaminate.find_items(docs, bench, slop=3).where(F.size("spans") > 0).count() == 2


def test_decontaminate_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_items(documents(spark, ["a b"]), none).first().spans == []
    assert decontaminate.find_items(documents(spark, ["a"]).limit(0), none).count() == 0


# 3 ------------------------------------------------------------------------------------------------------------------


def test_nodes_of_unseen_pages():
    x, y = html_extract.training_nodes(80, 4242)
    assert ((html_extract.model().log_odds(x) > 0) == (y > 0)).mean() > 0.98


def test_decoding_is_hierarchical_and_best():
    rng = random.Random(2)
    for _ in range(60):
        n = rng.randint(2, 9)
        page = html_extract.Page("")
        page.parent = [-1] + [rng.randrange(i) for i in range(1, n)]
        page.tag, page.groups, page.inside = ["div"] * n, [0] * n, [0] * n
        z = np.array([rng.gauss(0, 2) for _ in range(n)])
        keep = html_extract.Forest([page]).decode(z)

        def total(k):
            return sum(-np.log1p(np.exp(-z[i])) if k[i] else -np.log1p(np.exp(z[i])) for i in range(n))

        legal = [
            k for b in range(1 << (n - 1)) if all((k := [True] + [bool(b >> i & 1) for i in range(n - 1)])[page.parent[i]] or not k[i] for i in range(1, n))
        ]
        assert keep[0] and all(keep[page.parent[i]] or not keep[i] for i in range(1, n))
        assert total(keep) == pytest.approx(max(map(total, legal)))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><a href=/>Logo</a></header>
<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav><div class="cookie-notice"><p>We use cookies on this site.</p></div>
<article><h1>Big  news &amp; more</h1><p>First <b>bold</b>\n line.<p>Second &lt;one&gt;.<div class="ad">Buy now, cheap things.</div>
<ul><li>item one</li><li>item two</li></ul></article><aside><h3>Related</h3><a href=/x>Other story</a></aside>
<section id="comments"><p>Great post, I liked it.</p><p>Me too, very much.</p></section><form><p>Sign up</p><input></form><footer>&copy; 2024 All rights</footer></body></html>"""


def test_main_text():
    assert html_extract.main_text(PAGE, html_extract.model()) == "Big news & more\nFirst bold line.\nSecond <one>.\nitem one\nitem two"


@pytest.mark.parametrize("element", ["<math><mi>x</mi><mo>=</mo><mn>3</mn></math>", "<object data=a>kept words of it</object>", "<noscript>kept words of it</noscript>"])
def test_elements_within_an_article(element):
    page = PAGE.replace("Second &lt;one&gt;.", f"Second &lt;one&gt; {element} and more of this sentence, as it goes on.")
    inner = html_extract.main_text(page, html_extract.model())
    assert ("x=3" if "math" in element else "kept words of it") in inner and "and more of this sentence" in inner


def test_form_elements_within_an_article():
    page = PAGE.replace("Second &lt;one&gt;.", "Second one. <button>Press me</button> <select><option>pick</option></select> It goes on.")
    got = html_extract.main_text(page, html_extract.model())
    assert "Second one. It goes on." in " ".join(got.split()) and "Press" not in got and "pick" not in got


def test_raw_ends_in_capitals_after_long_letters():
    page = "<article><p>İstanbul has a page with some words, and they go on.</p><SCRIPT>var a;</SCRIPT><p>What follows is kept as well, of course.</p></article>"
    assert html_extract.main_text(page, html_extract.model()).endswith("What follows is kept as well, of course.")


def test_extract_odd(spark):
    long = "<article>" + "<p>Some words of a very long page, again and again.</p>" * 40_000 + "</article>"
    rows_ = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (3, "", ""), (None, "u", long)]
    pages = spark.createDataFrame(rows_, "page_id long, url string, html string").withColumns({"text": F.lit("x"), "n_chars": F.lit(1), "k0": F.lit(2)})
    got = html_extract.extract(pages).collect()
    assert len(got) == 5 and {r.text for r in got if r.page_id in (2, 3)} == {""}
    assert len({r.text for r in got if r.page_id == 1}) == 1
    assert next(r.text for r in got if r.page_id is None).count("\n") == 39_999
    assert html_extract.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("source", [None, "", "plain", "<", "<p", "<p>a<b", "</", "<!--", "<script>x", "<p a='", "<div>" * 3000, "<a " * 2000, "&#x110000; &nosuch; <p>a&amp"])
def test_broken_pages(source):
    assert isinstance(html_extract.main_text(source, html_extract.model()), str)


def test_extract_keeps_rows(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    got = llm.queries()["op3_extract"](spark, data)
    assert got.count() == pages.count()
    import html
    import re

    source = {r.page_id: r.html for r in pages.collect()}
    for r in got.collect():
        m = re.search(r"<article>(.*?)(</article>|$)", source[r.page_id], re.S)
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>?", "", q)).split()) for q in re.split(r"</?(?:p|h1)>", m[1] if m else "")]
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text)


# 4 ------------------------------------------------------------------------------------------------------------------


def test_url_rules(spark):
    urls = [
        "http://a.example.org/es/1", "https://EXAMPLE.org/es?x", "http://a.org/en/1", "http://b.example.org/en/12#t", "http://x.com/fr/1", "http://x.com/de/",
        "http://x.com/en", "http://notexample.org/es/", "http://com/fr/", None, "no scheme", "http://x.org?y", "x://", "http://x.com/fr",
    ]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit(1))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, labels).collect()}
    assert got == {
        0: ("a.example.org", "/es/1", "example.org/es/", "block"), 1: ("example.org", "/es", "org/", "allow"),
        2: ("a.org", "/en/1", "org/", "allow"), 3: ("b.example.org", "/en/12", "example.org/en/1", "block"), 4: ("x.com", "/fr/1", "com/fr/", "allow"),
        5: ("x.com", "/de/", "com/de/", "block"), 6: ("x.com", "/en", None, "allow"), 7: ("notexample.org", "/es/", "org/", "allow"),
        8: ("com", "/fr/", "com/fr/", "allow"), 9: ("", "", None, "allow"), 10: ("", "", None, "allow"), 11: ("x.org", "", None, "allow"),
        12: ("", "", None, "allow"), 13: ("x.com", "/fr", None, "allow"),
    }


def test_mined_rules(spark):
    rng = random.Random(1)
    pages, labels = [], []
    for i in range(600):
        bad = rng.random() < 0.3
        path = "/spam/offer" if bad and rng.random() < 0.8 else f"/{rng.choice(['news', 'offer', 'spam'] if rng.random() < 0.3 else ['news'])}"
        pages.append((i, f"http://h{i % 7}.net{path}/{i}"))
        labels.append((i, 0 if bad else 1, 0))
    p, lab = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    parts = url_filter.with_parts(p).collect()
    y = {i: q == 0 for i, q, _ in labels}
    got = url_filter.mine_rules(url_filter.with_parts(p), lab, 0.02, 0.7).collect()
    assert any(set(r.tokens) == {"p:spam", "p:offer"} for r in got)
    for r in got:
        held = [y[x.page_id] for x in parts if set(r.tokens) <= set(x.tokens)]
        assert np.mean(held) == pytest.approx(r.confidence) and r.confidence >= 0.7 and sum(held) / len(parts) >= 0.02
    verdict = {r.page_id: r.verdict for r in url_filter.judge(p, lab, min_support=0.02, min_confidence=0.7).collect()}
    for x in parts:
        assert verdict[x.page_id] == ("block" if any(set(r.tokens) <= set(x.tokens) for r in got) else "allow")


def brute_rules(parts, label, min_support, min_confidence, min_pages):
    """Rules of plain counting over (tokens, label) of labelled pages, by every combination that a page has."""
    import itertools

    pages = [(i, frozenset(t), y) for i, t, y in ((i, t, label[i]) for i, t in parts) if t]
    learnt = [p for p in pages if zlib.crc32(str(p[0]).encode()) % 4 != 3]
    checked = [p for p in pages if zlib.crc32(str(p[0]).encode()) % 4 == 3]
    least = max(min_pages, int(np.ceil(len(learnt) * min_support)))
    n = Counter(t for _, ts, _ in learnt for t in ts)
    place = {t: frozenset(j for j, (_, ts, _) in enumerate(learnt) if t in ts) for t in n if n[t] >= least}
    same = {}
    for t in sorted(place):
        same.setdefault(place[t], []).append(t)
    groups = [frozenset(g) for g in same.values()]
    sets = set()
    for _, ts, y in learnt:
        mine = [g for g in groups if g <= ts]
        if y:
            sets |= {frozenset().union(*c) for k in range(1, len(mine) + 1) for c in itertools.combinations(mine, k)}

    def count(pages, s):
        hit = [y for _, ts, y in pages if s <= ts]
        return len(hit), sum(hit)

    rules = {}
    for s in sets:
        a, bad = count(learnt, s)
        c, d = count(checked, s)
        e, f = count(pages, s)
        if bad >= least and bad >= min_confidence * a and c and d >= min_confidence * c and f >= max(min_pages, min_support * len(pages)) and f >= min_confidence * e:
            rules[s] = f / e
    return {s: c for s, c in rules.items() if not any(r < s and rules[r] >= c for r in rules)}


@pytest.mark.parametrize("settings", [{}, {"min_support": 0.003, "min_confidence": 0.3}])
def test_url_filter_equals_brute_force(spark, settings):
    """The query itself, with its own settings, on its whole table; and looser ones, by which there are many rules."""
    data = "/root/testdata/sf0.1"
    parts = url_filter.with_parts(spark.read.parquet(f"{data}/pages.parquet")).collect()
    lab = {r.doc_id: int(r.quality == 0 or r.toxic == 1) for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    import re

    known = [(int(m[0]), r.tokens) for r in parts if (m := re.search("[0-9]+", r.path)) and int(m[0]) in lab]
    used = {"min_support": url_filter.MIN_SUPPORT, "min_confidence": url_filter.MIN_CONFIDENCE} | settings
    rules = brute_rules(known, lab, used["min_support"], used["min_confidence"], url_filter.MIN_PAGES)
    assert bool(rules) == bool(settings)
    pages, labels = spark.read.parquet(f"{data}/pages.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    found = url_filter.judge(pages, labels, **settings) if settings else llm.queries()["op4_url_filter"](spark, data)
    got = {r.page_id: r for r in found.collect()}
    given = {r.page_id: r for r in url_filter.judge(pages, labels.limit(0)).collect()}
    for r in parts:
        hit = [s for s in rules if s <= set(r.tokens)]
        assert (got[r.page_id].evidence is not None) == bool(hit)
        if given[r.page_id].rule is None:
            assert got[r.page_id].verdict == ("block" if hit else "allow")
        else:
            assert got[r.page_id].verdict == given[r.page_id].verdict


def test_one_page_makes_no_rule(spark):
    pages = spark.createDataFrame([(i, f"http://h{i}.net/only{'abcdefghij'[i]}/{i}") for i in range(10)], "page_id long, url string")
    labels = spark.createDataFrame([(i, 0, 0) for i in range(10)], "doc_id long, quality int, toxic int")
    rules = url_filter.mine_rules(url_filter.with_parts(pages), labels, 0.01, 0.5).collect()
    assert not any(any(t.startswith(("h:h", "p:only")) for t in r.tokens) for r in rules)


def test_fixed_paths_are_one_item(spark):
    """A site's twenty words that always come together are one item, not a million combinations."""
    path = "/".join("abcdefghijklmnopqrst")
    pages = spark.createDataFrame([(i, f"http://x.net/{path}/{i}") for i in range(60)] + [(i, f"http://y.net/z/{i}") for i in range(60, 120)], "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i >= 60), 0) for i in range(120)], "doc_id long, quality int, toxic int")
    rules = url_filter.mine_rules(url_filter.with_parts(pages), labels).collect()
    assert len(rules) == 1 and len(rules[0].tokens) == 21 and rules[0].confidence == 1.0


def test_url_filter_odd(spark):
    long = "http://a.net/" + "w/" * 50_000 + "1"
    rows_ = [(1, long), (1, long), (None, "http://b.net/2"), (3, None), (4, "")]
    pages = spark.createDataFrame(rows_, "page_id long, url string").withColumns({"host": F.lit("x"), "tokens": F.lit(1), "verdict": F.lit(2)})
    labels = spark.createDataFrame([(i, 0, None) for i in range(5)] + [(None, None, 1)], "doc_id long, quality int, toxic int")
    got = url_filter.judge(pages, labels).collect()
    assert len(got) == 5 and {r.verdict for r in got if not r.host} == {"allow"}
    assert url_filter.judge(pages.limit(0), labels).count() == 0


# 5 ------------------------------------------------------------------------------------------------------------------


def test_targets_are_reshared(spark):
    s = spark.createDataFrame([("a", 10), ("b", 100), ("c", 1000), (None, 50)], "source string, source_size long")
    t = {r.source: r.target for r in mixing.targets(s, (5, 2, 1), 1.5, 2).collect()}
    # All shares are above 2 times the size but that of c, which takes what is left.
    assert t == {"a": 20.0, "b": 200.0, None: 100.0, "c": 1740.0 - 320.0}


def test_mix_odd(spark):
    got = mixing.mix(odd_documents(spark)).collect()
    assert sum(r.copies for r in got) == 12
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
    by = {}
    for r in got:
        by.setdefault(r.source, [0, r.target])[0] += r.taken * r.copies
    for total, target in by.values():
        assert abs(total - target) <= 3
    assert mixing.mix(odd_documents(spark).limit(0)).count() == 0
    assert rows(mixing.mix(odd_documents(spark), rows_per_bucket=1)) == rows(mixing.mix(odd_documents(spark)))


def test_repeat_cuts_at_words(spark):
    docs = documents(spark, [" ".join(f"w{i}-{j}" for j in range(i + 5)) + " \n" for i in range(30)], [f"s{i % 3}" for i in range(30)])
    taken = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    got = mixing.repeat(docs).groupBy("doc_id").agg(F.sum(mixing.word_count(F.col("text"))).alias("n"), F.max(F.length("text") - F.col("n_chars")).alias("z"))
    assert {r.doc_id: r.n for r in got.collect()} == {k: v for k, v in taken.items() if v}
    assert {r.z for r in got.collect()} <= {0}


# 6 ------------------------------------------------------------------------------------------------------------------


def shard_checks(got, texts, n=8):
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    for rs in by.values():
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
    for r in got:
        t = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(t) + 1, zlib.crc32(t), "bytes", None)
    return [sum(r.size for r in by.get(i, [])) for i in range(n)]


def test_shards(spark):
    rng = random.Random(4)
    texts = ["x" * rng.randint(0, 300) + str(i) for i in range(2000)] + ["copy"] * 900 + [None, "", "é"]
    got = sharding.shard(documents(spark, texts, extra=True)).collect()
    sums = shard_checks(got, texts)
    assert max(sums) - min(sums) <= 2 * 310
    few = documents(spark, [f"t{i % 40}" for i in range(400)])
    where = {}
    for r in sharding.shard(few).collect():
        where.setdefault(r.text_crc32, set()).add(r.shard)
    assert sum(len(v) > 1 for v in where.values()) <= 7
    assert sharding.shard(few.limit(0)).count() == 0
    assert sharding.shard(odd_documents(spark)).count() == 12


def test_shards_of_data(spark, data):
    d = spark.read.parquet(f"{data}/documents.parquet")
    texts = {r.doc_id: r.text for r in d.collect()}
    sums = shard_checks(llm.queries()["op6_shard"](spark, data).collect(), texts)
    assert max(sums) - min(sums) <= 2 * max(len((t or "").encode()) for t in texts.values())


# 7 ------------------------------------------------------------------------------------------------------------------


def python_vector(text):
    import re

    units = []
    for p in text.split("\n"):
        if p.strip(" "):
            parts = re.split(r"([ \t\n\x0b\f\r]+)", p.strip(" \t\n\x0b\f\r"))
            units += [p, *("".join(parts[i : i + 3]) for i in range(0, len(parts) - 2, 2))]
    vec = [0] * fingerprint.COUNTERS
    for u in units:
        for k in range(fingerprint.HASHES):
            seed = 42 if k == 0 else xxhash.xxh64_intdigest(struct.pack("<i", k), seed=42)
            h = xxhash.xxh64_intdigest(u.encode(), seed=seed)
            for lane in range(fingerprint.LANES):
                for i in range(fingerprint.LANE_BITS):
                    vec[lane * fingerprint.SUMS + k * fingerprint.LANE_BITS + i] += h >> (i + lane * fingerprint.LANE_BITS) & 1
    return len(units), vec


def python_likeness(a, b):
    (n, x), (m, y) = python_vector(a), python_vector(b)
    p, q = [2 * i - n for i in x], [2 * i - m for i in y]
    sq = sum(i * i + j * j for i, j in zip(p, q, strict=True))
    return min(1.0, max(0.0, 2 * sum(i * j for i, j in zip(p, q, strict=True)) / sq)) if sq else 1.0


@pytest.mark.parametrize("chunk", [fingerprint.CHUNK, 3])
def test_fingerprints_equal_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(fingerprint, "CHUNK", chunk)
    texts = ["a b c\nd e", "d e\na b c", "a b c", "", None, "one two  three four\n\n one", "é ü\nß", " \t x\ty ", "w" * 5000]
    got = {r.doc_id: r for r in fingerprint.fingerprints(documents(spark, texts), ["doc_id"]).collect()}
    for i, t in enumerate(texts):
        assert (got[i].units, list(got[i].vec)) == python_vector(t or "")
    assert got[0].vec == got[1].vec != got[2].vec


def test_paragraphs_in_and_out(spark):
    """Whatever is put in and taken out, the vector is that of the text that is left."""
    texts = ["a b c\nd e", "f g h", "d e\nf g h\na b c", "a b c"]
    a, b, both, rest = (F.array(*map(F.lit, python_vector(t)[1])) for t in texts)
    d = F.array(*map(F.lit, python_vector("d e")[1]))
    r = spark.range(1).select(fingerprint.put_in(a, b).alias("x"), both.alias("both"), fingerprint.take_out(a, d).alias("y"), rest.alias("rest")).first()
    assert r.x == r.both and r.y == r.rest


def test_fingerprints_of_many_equal_rows(spark):
    """So many that a sum over all copies would pass bit 63."""
    text = " ".join(f"w{i}" for i in range(200))
    long = " ".join(f"v{i % 700}" for i in range(4001))
    docs = spark.range(63_000).select(F.when(F.col("id") < 60_000, 1).otherwise(2).cast("long").alias("doc_id"), F.when(F.col("id") < 60_000, text).otherwise(F.lit(long)).alias("text"))
    got = fingerprint.fingerprints(docs.unionByName(documents(spark, [text]).select("doc_id", "text")), ["doc_id"]).collect()
    assert sorted((r.doc_id, r.copies) for r in got) == [(0, 1), (1, 60_000), (2, 3_000)]
    assert all((r.units, list(r.vec)) == python_vector(long if r.doc_id == 2 else text) for r in got)


def test_likeness_of_very_long_texts(spark):
    """More units than a lane of a packed sum can count: none carries into the next."""
    texts = ["a b " * 1_100_000, "c d " * 1_100_000, "a b " * 1_099_990 + "e f"]
    got = {r.doc_id: r for r in fingerprint.fingerprints(documents(spark, texts), ["doc_id"]).collect()}
    assert all(r.units > 1 << 21 for r in got.values())
    pairs = spark.createDataFrame([(got[i].vec, got[i].units, got[j].vec, got[j].units) for i, j in ((0, 1), (0, 2))], "a array<long>, n long, b array<long>, m long")
    unlike, like = (r.x for r in pairs.select(fingerprint.likeness(F.col("a"), F.col("n"), F.col("b"), F.col("m")).alias("x")).collect())
    assert unlike < 0.05 and like > 0.99


def test_near_copies_are_like(spark):
    """A word put in early does not shift what follows it."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(900)}" for _ in range(300)]
    texts = [" ".join(base), " ".join([*base[:3], "new", *base[3:]]), " ".join(f"u{rng.randrange(900)}" for _ in range(300))]
    got = {r.doc_id: r for r in fingerprint.compare_with_next(documents(spark, texts)).collect()}
    assert got[0].near_next > 0.95 and got[1].near_next < 0.3
    for i, t in enumerate(texts):
        after = texts[(i + 1) % 3]
        k = len(t) // 4
        assert got[i].near_next == pytest.approx(python_likeness(t, after)) and got[i].near_edited == pytest.approx(python_likeness(t, t[: len(t) - k] + after[:k]))


def test_edits(spark, data):
    d = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    ids = sorted(d)
    got = {r.doc_id: r for r in llm.queries()["op7_fingerprint"](spark, data).collect()}
    assert sorted(got) == ids
    near = far = 0
    for i, after in zip(ids, ids[1:] + ids[:1], strict=True):
        t, k = d[i], len(d[i]) // 4
        edited = t[: len(t) - k] + d[after][:k]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(t)
        if i % 25 == 0:
            for value, x in ((got[i].fingerprint, t), (got[i].edited_fingerprint, edited)):
                n, vec = python_vector(x)
                assert value == "".join(f"{z:08X}" for z in [n, *vec])
        near += got[i].near_edited > got[i].near_next
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        far += 1
    assert near / far > 0.9
    same = {}
    for i in ids:
        assert same.setdefault(d[i], got[i].fingerprint) == got[i].fingerprint


def test_fingerprint_odd(spark):
    got, order = fingerprint.with_edits(odd_documents(spark))
    assert got.count() == 12 and order.count() == 9
    assert fingerprint.with_edits(odd_documents(spark).limit(0))[0].count() == 0
    assert fingerprint.compare_with_next(odd_documents(spark).limit(0)).count() == 0
    whole = fingerprint.compare_with_next(odd_documents(spark)).collect()
    assert len(whole) == 12 and len({r.fingerprint for r in whole if r.n_chars == 0}) == 1
    assert {r.near_next for r in whole if r.doc_id is None} == {0.0}
    one = fingerprint.with_edits(documents(spark, ["abcdefgh"]))[0].first()
    assert one.edited == "abcdefab"
    sparse = spark.createDataFrame([(x, x) for x in (-(1 << 62), -5, 0, 3, 1 << 20, 1 << 40, (1 << 62) + 1)], "key long, first long")
    want = [x.key for x in sparse.collect()]
    assert {r.key: r.next for r in fingerprint.successors(sparse).collect()} == dict(zip(want, want[1:] + want[:1], strict=True))


# 8 ------------------------------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    texts = ["<|im_end|>\n<|im_start|>user\nhi", "a\\|b \\\\ <| <\\|", "", None, "\\", "line\nline", "<|lf|>", "é\u0000日"]
    data = [(c, t, r, x) for c in (1, None) for t, (r, x) in enumerate(zip(["user", "assistant", "a\nb<|\\", None] * 2, texts, strict=True))]
    data += [(1, 1, "assistant", "tie"), (1, 1, "assistant", "tie"), (2, None, "user", "no turn")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    seg = chat.render(chat.fold(chat.events_of(df)), 3)
    got = {}
    for r in chat.read_back(seg).orderBy(F.col("segment").asc_nulls_first()).collect():
        got.setdefault(r.conv_id, []).extend((t.role, t.text) for t in r.turns)
    want = {}
    for c, t, r, x in sorted(data, key=lambda z: (z[0] or 0, z[1] if z[1] is not None else -1, z[2] or "", z[3] or "")):
        want.setdefault(c, []).append((r or "", x or ""))
    assert got == want


def test_fold_of_events(spark):
    ev = [
        (1, 0, 1, 1, "message", "user", "hi"), (1, 1, 1, 2, "message", "assistant", ""), (1, 1, 1, 3, "delta", None, "he"), (1, 1, 1, 4, "delta", None, "llo"),
        (1, 2, 1, 5, "message", "user", "more"), (1, 1, 1, 6, "regenerate", "assistant", None), (1, 1, 1, 7, "delta", None, "new"), (1, 0, 1, 8, "edit", None, "hey"),
        (1, 70, 1, 4, "message", "user", "late"), (1, 3, 1, 9, "message", "user", "kept"), (2, 0, 1, 1, "message", "user", "x"), (2, 0, 1, 2, "delete", None, None),
        (2, 1, 1, 1, "odd", "user", "x"),
    ]
    random.Random(1).shuffle(ev)
    df = spark.createDataFrame(ev, "conv_id long, turn long, part int, seq long, kind string, role string, text string")
    got = sorted((r.conv_id, r.turn, r.role, r.text) for r in chat.fold(df).collect())
    assert got == [(1, 0, "user", "hey"), (1, 1, "assistant", "new"), (1, 3, "user", "kept")]


def test_regenerations_of_long_conversations(spark):
    """A regeneration drops later turns in its own block of turns and in all that follow, and no earlier ones."""
    ev = [(c, t, 1, t, "message", "user", f"m{t}") for c in (1, None) for t in range(100)]
    ev += [(1, 40, 1, 200, "regenerate", "assistant", "again"), (1, 90, 1, 300, "message", "user", "after"), (1, 70, 1, 150, "regenerate", "assistant", "old"), (1, None, 1, 400, "regenerate", "user", "first")]
    df = spark.createDataFrame(ev, "conv_id long, turn long, part int, seq long, kind string, role string, text string")
    got = {(r.conv_id, r.turn): r.text for r in chat.fold(df).collect()}
    assert sorted(t for c, t in got if c is None) == list(range(100))
    assert sorted(t for c, t in got if c == 1 and t is not None) == [*range(41), 90]
    assert got[1, 40] == "again" and got[1, 90] == "after" and got[1, None] == "first"


def test_chat_odd(spark):
    rows_ = [(1, 0, "user", "x" * 3_000_000), (1, 1, "assistant", None), (2, None, None, "")]
    df = spark.createDataFrame(rows_, "conv_id long, turn long, role string, text string").withColumns({"part": F.lit(7), "kind": F.lit("delete"), "segment": F.lit(1)})
    read = chat.read_back(chat.render(chat.fold(chat.events_of(df)))).collect()
    assert sorted((r.conv_id, len(r.turns), sum(len(t.text) for t in r.turns)) for r in read) == [(1, 2, 3_000_000), (2, 1, 0)]
    assert chat.render(chat.fold(chat.events_of(df.limit(0)))).count() == 0


# 9 ------------------------------------------------------------------------------------------------------------------


def random_vector(rng, terms, idf, most=6):
    """Term numbers and weights of a unit vector."""
    counts = {rng.randrange(terms): rng.randint(1, 4) for _ in range(rng.randint(1, most))}
    t, c = np.array(sorted(counts)), np.array([counts[i] for i in sorted(counts)], float)
    return t, toxicity.unit_vectors(np.zeros(len(t), int), t, c, idf, 1)


def queries_of(vectors):
    n = [len(t) for t, _ in vectors]
    return toxicity.Queries(len(n), np.repeat(np.arange(len(n)), n), np.concatenate([t for t, _ in vectors]).astype(int), np.concatenate([w for _, w in vectors]))


def model_of(examples, idf, ids, labels):
    flat = sorted((int(t), j, float(w)) for j, e in enumerate(examples) for t, w in zip(*e, strict=True))
    starts = np.searchsorted([t for t, _, _ in flat], np.arange(len(idf) + 1))
    return toxicity.Model({}, idf, ids, labels, starts, np.array([j for _, j, _ in flat]), np.array([w for _, _, w in flat]), 0.1)


@pytest.mark.parametrize("block,full", [(8, 0.0), (8, 0.2), (8, 1.0), (64, 0.1), (500, 0.1)])
def test_neighbours_equal_brute_force(block, full):
    rng = random.Random(8)
    idf = np.array([rng.uniform(1, 4) for _ in range(30)])
    examples = [random_vector(rng, 30, idf) for _ in range(300)]
    m = model_of(examples, idf, np.arange(300)[::-1], np.zeros(300))
    index = toxicity.Index(m, block, full)
    queries = [random_vector(rng, 30, idf) for _ in range(60)] + [(np.zeros(0), np.zeros(0))]
    for (ids, w), got in zip(queries, index.nearest(queries_of(queries), 15), strict=True):
        q = dict(zip(ids.tolist(), w.tolist(), strict=True))
        cos = [round(sum(q.get(int(t), 0) * x for t, x in zip(*e, strict=True)), 12) for e in examples]
        want = sorted((-c, int(m.ids[j]), j) for j, c in enumerate(cos) if c > 0)[:15]
        assert list(zip(*(x.tolist() for x in got), strict=True)) == [(-c, j) for c, _, j in want]
    assert index.opened <= index.pairs


def test_blocks_are_skipped():
    """Examples of two vocabularies: a query opens the blocks of its own only."""
    rng = random.Random(3)
    n, idf = 640, np.ones(200)
    examples = [(t + 100 * (j >= n // 2), w) for j in range(n) for t, w in [random_vector(rng, 100, idf, 12)]]
    index = toxicity.Index(model_of(examples, idf, np.arange(n), np.zeros(n)))
    index.nearest(queries_of(examples), 9)
    assert index.opened <= index.pairs / 2


def test_terms_of_texts():
    known = {t: i for i, t in enumerate(["a", "abc*", "abcd*", "abcde", "abc", "zz"])}
    count = toxicity.Terms(known)
    for texts in (["A abc abcde", None, "", "zz q abcdx zz"], ["abcde abcde"], [], [None]):
        want = []
        for i, t in enumerate(texts):
            bag = Counter(x for w in toxicity.words(t) for x in toxicity.features(w))
            want += sorted((i, known[x], c) for x, c in bag.items() if x in known)
        assert [tuple(map(int, r)) for r in zip(*count(texts), strict=True)] == want


def test_isotonic_is_least_squares():
    rng = np.random.default_rng(6)
    for _ in range(20):
        x, y, w = rng.integers(0, 9, 30) / 9, rng.integers(0, 2, 30).astype(float), rng.uniform(0.5, 3, 30)
        ends, rates = toxicity.isotonic(x, y, w)
        at = sorted(set(x))
        assert set(ends) <= set(at) and all(np.diff(ends) >= 0) and all(np.diff(rates) >= 0)
        # The rising fit at a place: the largest over starts of the least mean over ends.
        mean = lambda lo, hi: np.average(y[(x >= lo) & (x <= hi)], weights=w[(x >= lo) & (x <= hi)])
        for v in at:
            want = max(min(mean(lo, hi) for hi in at if hi >= v) for lo in at if lo <= v)
            assert np.interp(v, ends, rates) == pytest.approx(want)


def brute_scores(texts, m):
    """Score and evidence of each text by plain cosine with every example of the model, from counts made here."""
    import math

    def bag(t):
        got = Counter()
        for w in toxicity.words(t):
            got.update([w] + [w[:k] + "*" for k in (3, 4) if len(w) > k])
        return got

    bags = {i: bag(t) for i, t in texts.items()}
    known = {t for i in m.ids.tolist() for t in bags[i]}
    df = Counter(t for b in bags.values() for t in b if t in known)

    def unit(b):
        v = {t: (1 + math.log(c)) * (math.log((len(texts) + 1) / (df[t] + 1)) + 1) for t, c in b.items() if t in known}
        n = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / n for t, x in v.items()}

    label = dict(zip(m.ids.tolist(), m.labels.tolist(), strict=True))
    examples = {i: unit(bags[i]) for i in label}
    out = {}
    for i, b in bags.items():
        q = unit(b)
        near = sorted((-round(sum(x * e.get(t, 0.0) for t, x in q.items()), 10), j) for j, e in examples.items())[: m.k]
        near = [(-c, j) for c, j in near if c < 0]
        weight = [c / (1 - c + toxicity.NEAREST) for c, _ in near]
        v = sum(x * label[j] for x, (_, j) in zip(weight, near, strict=True)) / sum(weight) if near else None
        out[i] = (m.prior if v is None else float(np.interp(v, m.votes, m.rates)), near)
    return out


def test_toxicity_equals_brute_force(spark):
    """The query itself: all terms, all examples, exact cosine, votes and rates."""
    data = "/root/testdata/sf0.001"
    docs, lab = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    m = toxicity.fit(docs, lab)
    label = {r.doc_id: r.toxic for r in lab.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
    assert dict(zip(m.ids.tolist(), m.labels.tolist(), strict=True)) == label
    assert m.prior == pytest.approx(np.mean(list(label.values())))
    want = brute_scores({r.doc_id: r.text for r in docs.collect()}, m)
    got = llm.queries()["op9_toxicity"](spark, data).collect()
    assert len(got) == len(want)
    for r in got:
        value, near = want[r.doc_id]
        assert r.score == pytest.approx(value, abs=1e-6) and r.predicted == int(r.score >= 0.3)
        assert [e.cosine for e in r.evidence] == pytest.approx([c for c, _ in near[:5]], abs=1e-9)
        assert all(e.label == label[e.doc_id] for e in r.evidence)


def test_toxicity_held_out(spark):
    data = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in llm.queries()["op9_toxicity"](spark, data).collect()}
    lab = {r.doc_id: r.toxic for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    held = [(got[i].predicted, y) for i, y in lab.items() if got[i].held_out]
    assert np.mean([p == y for p, y in held]) > 0.9
    assert sum(p for p, y in held if y) >= 0.6 * sum(y for _, y in held)


def test_toxicity_of_few_labels(spark):
    """Few examples that share only a word's beginning are found by it; a copy of a clean example stays clean."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = [(i, " ".join(word() for _ in range(20)), 0) for i in range(60)]
    rows += [(100 + i, " ".join([*(word() for _ in range(18)), "zuqqel" + word(), "zuqqel" + word()]), 1) for i in range(12)]
    learnt = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    copy = next(t for _, t, y in learnt if not y)
    docs = spark.createDataFrame([r[:2] for r in rows] + [(500, f"zuqqel{word()} {word()}"), (501, copy + " x")], "doc_id long, text string")
    m = toxicity.fit(docs, spark.createDataFrame([(i, 0, y) for i, _, y in rows], "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r for r in toxicity.score(docs, m).collect()}
    assert got[500].score > 0.5 and got[501].score < 0.3 and got[501].evidence[0].cosine > 0.9


def test_toxicity_by_language(spark):
    data = "/root/testdata/sf0.1"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang").collect()}
    lab = {r.doc_id: r.toxic for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    held = [r for r in llm.queries()["op9_toxicity"](spark, data).drop("evidence").collect() if r.held_out]
    for x in ("de", "en", "es", "fr"):
        found = [r.predicted for r in held if lang[r.doc_id] == x and lab.get(r.doc_id) == 1]
        assert found and np.mean(found) > 0.7, x


def test_toxicity_odd(spark):
    """Odd rows with a real model; labels of unknown, null and repeated ids; no labels; one label only."""
    docs = odd_documents(spark)
    labels = [(i, 1, int(i in (4, 5))) for i in range(9)] + [(4, 1, 0), (None, 1, 1), (77, 1, 1), (0, None, None)]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    m = toxicity.fit(docs, lab)
    assert set(m.labels.tolist()) == {0.0, 1.0}
    got = toxicity.score(docs, m)
    assert set(got.columns) == {*docs.columns, "evidence"}
    rows_ = got.collect()
    assert len(rows_) == 12 and all(0 <= r.score <= 1 for r in rows_)
    assert {r.score for r in rows_ if not (r.text or "").strip()} == {m.prior}
    assert len({r.score for r in rows_ if r.text == "a b c d e f g"}) == 1
    assert toxicity.score(docs.limit(0), m).count() == 0
    none = toxicity.fit(docs, lab.limit(0))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.0}
    assert toxicity.fit(docs.limit(0), lab).terms == {}
    one = toxicity.fit(docs, lab.where("toxic = 1"))
    assert {r.score for r in toxicity.score(docs, one).collect()} == {1.0}


# 10 -----------------------------------------------------------------------------------------------------------------


def brute_components(texts):
    sets = {}
    for i, t in texts.items():
        ws = minhash._FOLD and (t or "").encode().translate(minhash._FOLD).split()
        if ws:
            sets[i] = {tuple(ws[j : j + min(5, len(ws))]) for j in range(max(1, len(ws) - 4))}
    up = {i: i for i in texts}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            c = len(sets[i] & sets[j])
            if 100 * c >= 75 * (len(sets[i]) + len(sets[j]) - c):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i: (len(sets.get(i, ())), top(i)) for i in texts}


def near_copies(seed, groups, per, words=60, vocabulary=5000):
    rng = random.Random(seed)
    out = []
    for _ in range(groups):
        base = [f"w{rng.randrange(vocabulary)}" for _ in range(rng.randint(8, words))]
        for _ in range(per):
            t = list(base)
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = f"n{rng.randrange(vocabulary)}"
            out.append(" ".join(t))
    return out


def test_near_duplicates_equal_brute_force(spark):
    texts = near_copies(3, 12, 6) + [None, "", "  ", "one", "ONE", "a b", "a b"] + ["same text of some words here"] * 20
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(documents(spark, texts, extra=True)).collect()}
    assert got == brute_components(dict(enumerate(texts)))


def test_crowded_buckets_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL_BUCKET", 4)
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = random.Random(9)
    shared = [f"s{i}" for i in range(60)]
    texts = []
    for k in range(60):
        texts.append(" ".join(shared + [f"x{k % 20}_{rng.randrange(4)}" for _ in range(rng.randint(20, 40))]))
    texts += near_copies(4, 2, 40, 50)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(documents(spark, texts)).collect()}
    assert got == brute_components(dict(enumerate(texts)))


def test_hot_bands_change_nothing(spark, monkeypatch):
    """Whether a band counts as hot or not, the links are the same."""
    texts = near_copies(3, 6, 12) + [" ".join(f"s{i}" for i in range(50)) + f" x{k} y{k}" for k in range(40)]
    want = brute_components(dict(enumerate(texts)))
    for most in (1, 10**9):
        monkeypatch.setattr(minhash, "HOT_BANDS", most)
        monkeypatch.setattr(minhash, "FILTER_BITS", 6 if most == 1 else 24)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(documents(spark, texts)).collect()}
        assert got == want


def test_recall_just_above_the_limit(spark):
    """2,000 pairs of a similarity from 0.75 to 0.8, no two pairs alike: every link is found."""
    rng = random.Random(29)
    texts, want = [], 0
    while want < 2000:
        base = [f"w{rng.randrange(100_000)}" for _ in range(rng.randint(60, 120))]
        other = list(base)
        for _ in range(rng.randint(1, 4)):
            other[rng.randrange(len(other))] = f"n{rng.randrange(100_000)}"
        a, b = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (base, other))
        if 0.75 <= len(a & b) / len(a | b) <= 0.8:
            texts += [" ".join(base), " ".join(other)]
            want += 1
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(documents(spark, texts)).collect()}
    assert sum(got[i] == got[i + 1] == i for i in range(0, len(texts), 2)) == want


def test_estimate_is_close():
    rng = np.random.RandomState(1)
    pool = rng.randint(0, 1 << 62, 4000).astype(np.uint64)
    for share in (0, 500, 1000, 1800):
        a, b = np.unique(pool[:2000]), np.unique(pool[2000 - share : 4000 - share])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        _, sig = minhash.signatures(minhash.minima([a, b]))
        d = sig[0].view(np.uint64) ^ sig[1].view(np.uint64)
        differ = int(np.bitwise_count((d | d >> np.uint64(1)) & np.uint64(0x5555555555555555)).sum())
        assert abs(minhash.estimate(differ) - true) < 0.16


@pytest.mark.parametrize("most", [0, 500_000])
def test_components(spark, monkeypatch, most):
    monkeypatch.setattr(minhash, "TASK_EDGES", most)
    chain = [(i, i + 1) for i in range(40)] + [(100, 50), (50, 60), (7, 7)]
    df = spark.createDataFrame(chain, "a long, b long")
    got = {r.node: r.component for r in minhash.components(df).collect()}
    assert minhash.components(df.limit(0)).count() == 0
    assert got == {i: 0 for i in range(41)} | {50: 50, 60: 50, 100: 50}


def test_repeated_ids_with_unlike_texts(spark):
    """One of the texts is compared, the same in every run, and all rows of the id share its component."""
    base = " ".join(f"w{i}" for i in range(40))
    rows_ = [(1, base), (1, "quite another text of some words"), (2, base + " more"), (1, base)]
    results = set()
    for n in (1, 3, 7):
        d = spark.createDataFrame(rows_[n % 4 :] + rows_[: n % 4], "doc_id long, text string").repartition(n)
        results.add(str(rows(minhash.near_duplicates(d))))
    assert len(results) == 1


def test_near_duplicates_odd(spark):
    got = minhash.near_duplicates(odd_documents(spark)).collect()
    assert len(got) == 12
    assert all(r.kept for r in got if r.doc_id in (1, 2, 3))
    assert [r.component_id for r in got if r.doc_id is None] == [6]
    assert minhash.near_duplicates(odd_documents(spark).limit(0)).count() == 0


# pipeline -----------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, data):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    tox = p.toxicity_stage(spark, docs, data).persist()
    left = {r.doc_id: r.text for r in tox.collect()}
    lab = {r.doc_id: r.toxic for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    assert tox.columns == docs.columns and set(left) <= set(texts)
    assert all(i in left for i, y in lab.items() if y == 0 and not zlib.crc32(str(i).encode()) % 4 == 2)
    near = p.near_duplicate_stage(spark, tox, data).persist()
    assert {r.doc_id for r in near.collect()} == {i for i, (_, c) in brute_components(left).items() if c == i}
    clean = p.decontamination_stage(spark, near, data).persist()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in near.collect() if not brute_hits(r.text, items)[1]}
    mixed = p.mixing_stage(spark, clean, data).persist()
    taken = {r.doc_id: r.taken for r in mixing.mix(clean).collect() if r.taken}
    n = mixed.groupBy("doc_id").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()
    assert {r.doc_id: r.n for r in n} == taken
    out = p.sharding_stage(spark, mixed, data)
    assert out.count() == mixed.count() and set(docs.columns) <= set(out.columns)
    for df in (tox, near, clean, mixed):
        df.unpersist()


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls, empties, repeated rows, copies without id, extra columns and an empty table go through every stage."""
    import corpus_pipeline as p

    spark.createDataFrame([(i, 1, int(i == 4)) for i in range(9)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "some words of a test that nobody has"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    odd = odd_documents(spark)
    odd = odd.unionByName(odd.where("doc_id = 0").withColumn("doc_id", F.lit(None).cast("long")))
    for docs in (odd, odd.limit(0)):
        for _, stage in p.STAGES:
            before, docs = docs, stage(spark, docs, str(tmp_path)).persist()
            assert docs.count() <= 2 * before.count()
        assert {r.shard for r in docs.collect()} <= set(range(8))
    near = p.near_duplicate_stage(spark, odd, str(tmp_path)).select("doc_id", "text").collect()
    assert sorted((r.doc_id, r.text) for r in near if (r.text or "").startswith("a b")) == [(0, "a b c d e f g")]
    # The two rows of x with an id are copies; the one without goes with them.
    assert [r.doc_id for r in near if r.text == "x"] == [6]


def test_pipeline_runs_whole(spark, data):
    assert llm.queries()["pipeline"](spark, data).count() > 0
