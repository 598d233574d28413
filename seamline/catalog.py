"""The queries of the library over the driver's tables, each with its DuckDB equivalent where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import secrets, urls
from .functions import text as X
from .operators import compress, envelope, graph, grep, health, relational, search, vector
from .plans import router, trigram
from .sources import pages as page_sources
from .sources import tables
from .sources.tables import table
from .streaming import watch as streaming

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


FOLD = f"'{X.UPPER}', '{X.LOWER}'"
LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1)::INTEGER AS line_no FROM documents)"

# --- pattern search -------------------------------------------------------------------------------------------------


@query(f"WITH {LINES} SELECT doc_id, line_no, instr(line, 'worthless')::INTEGER AS col, line FROM l WHERE contains(line, 'worthless')")
def grep_literal(spark, d):
    return grep.grep(table(spark, d, "documents"), "worthless", literal=True).withColumnRenamed("column", "col")


@query(f"WITH {LINES} SELECT doc_id, line_no, line FROM l WHERE regexp_matches(line, 'tok[a-z]+ = \"[0-9a-f]+|[Ll]icensed? under')")
def grep_regex(spark, d):
    return grep.indexed_grep(table(spark, d, "documents"), 'tok[a-z]+ = "[0-9a-f]+|[Ll]icensed? under').select("doc_id", "line_no", "line")


@query(f"WITH {LINES} SELECT doc_id, count(*) AS n_lines FROM l WHERE regexp_matches(line, '(idiot|moron|clown)') GROUP BY doc_id")
def grep_counts_by_doc(spark, d):
    return grep.counts(grep.grep(table(spark, d, "documents"), "(idiot|moron|clown)"))


@query(f"WITH {LINES} SELECT doc_id, line_no FROM l WHERE contains(translate(line, {FOLD}), 'the thing')")
def grep_ci(spark, d):
    return grep.grep(table(spark, d, "documents"), "THE Thing", literal=True, ignore_case=True).select("doc_id", "line_no")


@query(f"WITH {LINES}, m AS (SELECT doc_id, line_no FROM l WHERE contains(line, 'loser')) SELECT count(*) AS n_matches, count(DISTINCT doc_id) AS n_files FROM m")
def grep_totals(spark, d):
    m = grep.grep(table(spark, d, "documents"), "loser", literal=True)
    return m.agg(F.count(F.lit(1)).alias("n_matches"), F.count_distinct("doc_id").alias("n_files"))


@query("SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def grep_passages(spark, d):
    """Every benchmark text as a literal, each found by the rarest of its words; the texts are a stated query set."""
    docs, items = table(spark, d, "documents"), table(spark, d, "benchmark")
    word = r"[^\s]+"
    # Only words with white space on both sides inside the item stand alone in a document that holds it.
    terms = items.select("item_id", F.col("text").alias("item"), F.regexp_extract("text", r"(?s)^\S+\s+(.*)\s+\S+$", 1).alias("in"))
    terms = terms.select("item_id", "item", F.explode(F.array_distinct(F.regexp_extract_all("in", F.lit(word), F.lit(0)))).alias("w"))
    vocabulary = terms.select("w").distinct()
    postings = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(word), F.lit(0)))).alias("w")).join(vocabulary, "w", "left_semi")
    df = postings.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    rarest = terms.join(df, "w", "left").groupBy("item_id", "item").agg(F.min_by("w", F.struct(F.coalesce("n", F.lit(0)), "w")).alias("w"))
    pairs = postings.join(rarest, "w").select("doc_id", "item_id", "item").distinct()
    return pairs.join(docs.select("doc_id", "text"), "doc_id").where(F.contains("text", "item")).select("doc_id", "item_id")


WORDS = f"w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM documents)"
GRAMS = (
    f"g AS (SELECT doc_id, substr(translate(w, {FOLD}), i, 3) AS trigram, substr(translate(w, {FOLD}), i + 3, 1) AS nxt "
    "FROM w, unnest(range(1, greatest(length(w) - 1, 1))) AS t(i))"
)


def _postings(spark, d):
    return grep.word_postings(table(spark, d, "documents"))


@query(
    f"WITH {WORDS}, {GRAMS} SELECT doc_id, trigram, coalesce(bit_or(CASE WHEN nxt = '' THEN 0 ELSE (1 << ((ascii(nxt) * 31) % 8)) END), 0)::INTEGER AS mask "
    "FROM g GROUP BY doc_id, trigram"
)
def trigram_postings(spark, d):
    return _postings(spark, d)


@query(f"WITH {WORDS}, {GRAMS} SELECT trigram, count(DISTINCT doc_id) AS n_docs FROM g GROUP BY trigram")
def trigram_df(spark, d):
    return grep.frequencies(table(spark, d, "documents"))


@query(f"WITH {WORDS}, {GRAMS} SELECT doc_id FROM g WHERE trigram IN ('wor', 'ort', 'thl', 'les') GROUP BY doc_id HAVING count(DISTINCT trigram) = 4")
def trigram_candidates(spark, d):
    return grep.candidates(_postings(spark, d), ["wor", "ort", "thl", "les"])


@query(f"WITH {LINES} SELECT doc_id, line_no, line FROM l WHERE contains(line, 'The worthless') OR contains(line, 'the worthless')")
def grep_by_index(spark, d):
    """A pattern with a blank, by the postings of a published index, rarest first."""
    docs = table(spark, d, "documents")
    return grep.indexed_grep(docs, "[Tt]he worthless", index=grep.publish_index(docs)).select("doc_id", "line_no", "line")


@query(
    "WITH c AS (SELECT doc_id, unnest(string_split(translate(text, " + FOLD + "), chr(10))) AS line FROM documents), "
    "g AS (SELECT doc_id, substr(line, i, 3) AS trigram, substr(line, i + 3, 1) AS nxt FROM c, unnest(range(1, greatest(length(line) - 1, 1))) AS t(i)) "
    "SELECT trigram, count(DISTINCT doc_id) AS n_docs, count(DISTINCT CASE WHEN nxt != '' AND (ascii(nxt) * 31) % 8 = (ascii('s') * 31) % 8 THEN doc_id END) AS n_before FROM g WHERE trigram IN ('e w', '. t', 'les', 'th ') GROUP BY trigram"
)
def index_postings(spark, d):
    """Postings of some trigrams of the published index, blanks and signs among them, and a bit of their masks."""
    index = grep.publish_index(table(spark, d, "documents")).where(F.col("trigram").isin("e w", ". t", "les", "th "))
    before = F.col("mask").bitwiseAND(X.next_bit(F.lit("s"))) != 0
    return index.groupBy("trigram").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(before).alias("n_before"))


LEX = sorted(trigram.of_string("worthless").grams())
LEX_SQL = ", ".join(f"'{g}'" for g in LEX)


@query(
    f"WITH {WORDS}, {GRAMS}, n AS (SELECT doc_id, count(DISTINCT trigram) FILTER (trigram IN ({LEX_SQL})) AS hits, count(DISTINCT trigram) AS k FROM g GROUP BY doc_id) "
    "SELECT doc_id, round(hits / (1 + ln(k)), 9) AS score FROM n WHERE hits > 0 ORDER BY hits / (1 + ln(k)) DESC, doc_id LIMIT 20"
)
def lexical_score_topk(spark, d):
    s = grep.lexical_scores(table(spark, d, "documents"), LEX).orderBy(F.desc("score"), "doc_id").limit(20)
    return s.select("doc_id", F.round("score", 9).alias("score"))


@query(
    f"""WITH {LINES}, h AS (SELECT doc_id, line_no, max(CASE WHEN contains(line, 'The') THEN 1 ELSE 0 END) OVER w AS a,
    max(CASE WHEN contains(line, 'idiot') THEN 1 ELSE 0 END) OVER w AS b FROM l
    WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) SELECT doc_id, line_no FROM h WHERE a = 1 AND b = 1"""
)
def running_window_e2(spark, d):
    rows = X.lines(table(spark, d, "documents").where(F.contains("text", F.lit("idiot"))), "doc_id")
    return grep.token_windows(rows, "doc_id", ["The", "idiot"])


REGION = (
    "m AS (SELECT *, last_value(CASE WHEN starts_with(line, 'The') THEN line_no END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS start, "
    "last_value(CASE WHEN starts_with(line, 'For') THEN line_no END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS closed FROM l)"
)


@query(f"WITH {LINES}, {REGION} SELECT doc_id, start, line_no AS stop FROM m WHERE starts_with(line, 'For') AND start IS NOT NULL AND (closed IS NULL OR closed < start)")
def gap_islands_conflict(spark, d):
    return grep.conflict_regions(X.lines(table(spark, d, "documents"), "doc_id"), "doc_id", "The", "For")


# --- corpus health --------------------------------------------------------------------------------------------------

N_LINES = "(length(text) - length(replace(text, chr(10), '')) + 1)"


@query(f"SELECT lang, count(*) AS n_files, sum({N_LINES})::BIGINT AS n_lines, sum(length(text))::BIGINT AS n_chars FROM documents GROUP BY ROLLUP (lang)")
def line_metrics_by_lang(spark, d):
    return health.metrics(table(spark, d, "documents"))


@query(f"SELECT doc_id, {N_LINES}::INTEGER AS n_lines FROM documents ORDER BY 2 DESC, 1 LIMIT 20")
def top_docs_by_lines(spark, d):
    return health.largest(table(spark, d, "documents"))


@query(
    f"WITH {LINES}, m AS (SELECT *, regexp_extract(line, '\\b(Licensed|Released|token)\\b', 1) AS marker FROM l) SELECT doc_id, line_no, marker, "
    "substr(trim(regexp_replace(substr(line, instr(line, marker) + length(marker)), '^\\s*:?', '')), 1, 200) AS text FROM m WHERE marker != ''"
)
def marker_lines(spark, d):
    return health.marker_lines(table(spark, d, "documents"), ("Licensed", "Released", "token"))


RUNS = (
    "a AS (SELECT *, CASE WHEN line = lag(line) OVER (PARTITION BY doc_id ORDER BY line_no) THEN 0 ELSE 1 END AS new FROM l), "
    "r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM a), "
    "u AS (SELECT doc_id, run, count(*) AS n, min(line_no) AS start, first(line) AS line FROM r GROUP BY doc_id, run)"
)


@query(
    f"WITH {LINES}, {RUNS} SELECT doc_id, start, line, 0 AS part FROM u WHERE n >= 4 UNION ALL SELECT doc_id, start, '... (' || (n - 1) || ' more)', 1 FROM u WHERE n >= 4 "
    "UNION ALL SELECT doc_id, start, line, k::INTEGER FROM u, unnest(range(0, n)) AS t(k) WHERE n < 4"
)
def fold_consecutive_lines(spark, d):
    rows = X.lines(table(spark, d, "documents"), "doc_id")
    return compress.fold_consecutive(rows, "doc_id").select("doc_id", "start", "line", "part")


@query("SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark, d):
    return health.exact_duplicates(table(spark, d, "documents"))


@query(
    f"WITH {LINES}, n AS (SELECT doc_id, trim(regexp_replace(regexp_replace(translate(line, {FOLD}), '[0-9]+', '#', 'g'), '\\s+', ' ', 'g')) AS line FROM l) "
    "SELECT md5(line) AS line_digest, count(*) AS n_lines, count(DISTINCT doc_id) AS n_docs FROM n WHERE length(line) >= 20 GROUP BY line HAVING count(DISTINCT doc_id) > 1"
)
def duplicate_lines(spark, d):
    return health.duplicate_lines(table(spark, d, "documents"))


@query(
    f"WITH {LINES}, r AS (SELECT lang AS category, doc_id AS item, length(text) AS size FROM documents), k AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY size DESC, item)::INTEGER AS rank, count(*) OVER (PARTITION BY category) AS total FROM r) SELECT category, item, rank, total FROM k WHERE rank <= 5"
)
def category_details(spark, d):
    rows = table(spark, d, "documents").select(F.col("lang").alias("category"), F.col("doc_id").alias("item"), F.length("text").alias("size"))
    return health.per_category(rows, 5, [F.desc("size"), F.col("item")]).select("category", "item", "rank", "total")


@query("SELECT doc_id, 'unlabelled' AS reason FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def skipped_files(spark, d):
    return health.skipped(table(spark, d, "documents"), table(spark, d, "labels"), F.lit("unlabelled"))


@query(
    "WITH o AS (SELECT doc_id AS path, doc_id % 7 AS mtime, length(text) AS size, md5(text) AS hash FROM documents WHERE doc_id % 10 < 8), "
    "n AS (SELECT doc_id AS path, CASE WHEN doc_id % 3 = 0 THEN doc_id % 7 ELSE doc_id % 5 END AS mtime, length(text) AS size, CASE WHEN doc_id % 4 = 0 THEN md5(text || 'x') ELSE md5(text) END AS hash FROM documents WHERE doc_id % 10 > 1) "
    "SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted' WHEN o.mtime = n.mtime AND o.size = n.size THEN 'hot_fresh' WHEN o.hash = n.hash THEN 'content_fresh' ELSE 'stale' END AS verdict "
    "FROM o FULL JOIN n ON o.path = n.path"
)
def freshness_verdicts(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.length("text").alias("size"), "text")
    i = F.col("path")
    old = docs.where(i % 10 < 8).select("path", (i % 7).alias("mtime"), "size", F.md5("text").alias("hash"))
    new = docs.where(i % 10 > 1).select(
        "path", F.when(i % 3 == 0, i % 7).otherwise(i % 5).alias("mtime"), "size", F.when(i % 4 == 0, F.md5(F.concat("text", F.lit("x")))).otherwise(F.md5("text")).alias("hash")
    )
    return health.freshness(old, new)


@query("SELECT (SELECT count(*) FROM labels WHERE toxic = 1) AS toxic, (SELECT count(*) FROM labels WHERE quality = 0) AS low_quality, 'PARTIAL' AS state")
def health_digest(spark, d):
    labels = table(spark, d, "labels")
    return health.digest({"toxic": labels.where("toxic = 1"), "low_quality": labels.where("quality = 0"), "cycles": None})


# --- text functions -------------------------------------------------------------------------------------------------


@query(
    "SELECT doc_id, (regexp_replace(source, '[0-9]+', '#', 'g')) AS shape, ceil(strlen(text) / 3.5)::BIGINT AS tokens, "
    "CASE WHEN length(text) > 100 THEN substr(text, 1, 50) || '...<' || (length(text) - 100) || ' chars>...' || right(text, 50) ELSE text END AS cut FROM documents"
)
def text_scalars(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", X.mask_digits(F.col("source")).alias("shape"), X.approximate_tokens(F.col("text")).alias("tokens"), X.middle_truncate(F.col("text"), 100).alias("cut"))


@query(
    "SELECT lang, sum(ceil(strlen(text) / 3.5))::BIGINT AS total, round(avg(ceil(strlen(text) / 3.5)), 6) AS mean, median(ceil(strlen(text) / 3.5)) AS middle FROM documents GROUP BY lang"
)
def token_stats(spark, d):
    t = table(spark, d, "documents").select("lang", X.approximate_tokens(F.col("text")).alias("t"))
    return t.groupBy("lang").agg(F.sum("t").alias("total"), F.round(F.avg("t"), 6).alias("mean"), F.median("t").alias("middle"))


@query(
    "WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]{5,}')) AS name FROM documents), "
    "s AS (SELECT name, floor((greatest(length(name), 9) - levenshtein(name, 'worthless')) * 1000 / greatest(length(name), 9))::INTEGER AS similarity FROM w WHERE name != 'worthless') "
    "SELECT name, similarity FROM s WHERE similarity >= 500 ORDER BY similarity DESC, name LIMIT 5"
)
def nearest_words(spark, d):
    docs = table(spark, d, "documents")
    names = docs.select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]{5,}"), F.lit(0))).alias("name")).withColumn("declared", F.lit(False))
    return search.nearest_names(names, "worthless").select("name", "similarity")


@query(
    "SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, "
    "regexp_extract(url, '\\?([^#]*)', 1) AS query, regexp_extract(url, '#(.*)$', 1) AS fragment FROM pages"
)
def url_parts(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select(
        "page_id", urls.scheme(u).alias("scheme"), urls.host(u).alias("host"), urls.path(u).alias("path"), urls.query(u).alias("query"), urls.fragment(u).alias("fragment")
    )


@query(
    "SELECT page_id, (lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) = 'ththed.example.org' AND starts_with(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/en/')) AS covered FROM pages"
)
def url_rule_covers(spark, d):
    return table(spark, d, "pages").select("page_id", urls.covers("ththed.example.org", "/en", F.col("url")).alias("covered"))


@query("SELECT page_id, (generate_subscripts(h, 1) - 1)::INTEGER AS pos, unnest(h) AS href FROM (SELECT page_id, regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) AS h FROM pages)")
def page_links(spark, d):
    return table(spark, d, "pages").select("page_id", F.posexplode(page_sources.links(F.col("html"))).alias("pos", "href"))


#: Markup put before each page (# stands for the page's id), with the reference that it makes.
HEAD = (
    ('<base href="/b#/">', "/b#/", "base"),
    ('<link rel="Stylesheet" href="s#.css"><link rel="next" href="n#">', "s#.css", "link"),
    ('<img src="i#.png" srcset="a#.png 1x, c#.png 2x">', "i#.png", "src"),
    ("", "a#.png", "srcset"),
    ("", "c#.png", "srcset"),
    ('<p style="background: url(d#.png)">', "d#.png", "style"),
    ("<!-- <img src=x> --><style>/* url(y) */ q { background: url('e#.png') }</style>", "e#.png", "style"),
)


@query(
    "SELECT page_id, pos, replace(raw, '#', page_id::VARCHAR) AS raw, kind FROM pages, (VALUES "
    + ", ".join(f"({i}, '{raw}', '{kind}')" for i, (_, raw, kind) in enumerate(HEAD))
    + ") AS t(pos, raw, kind)"
)
def page_references(spark, d):
    """References of every page, with a head of its own before it, as the pages themselves hold nothing but links."""
    head = F.replace(F.lit("".join(x for x, _, _ in HEAD)), F.lit("#"), F.col("page_id").cast("string"))
    return page_sources.references(table(spark, d, "pages").select("page_id", F.concat(head, "html").alias("html")))


@query("SELECT doc_id, regexp_replace(text, '[0-9a-f]{40}', '<redacted>', 'g') AS text FROM documents WHERE regexp_matches(text, '[0-9a-f]{40}')")
def token_redaction(spark, d):
    docs = table(spark, d, "documents").where(F.col("text").rlike("[0-9a-f]{40}"))
    return docs.select("doc_id", secrets.redact_tokens(F.col("text")).alias("text"))


@query("SELECT event_type, (json_extract_string(props, '$.k'))::BIGINT AS k, count(*) AS n FROM events GROUP BY 1, 2")
def json_props(spark, d):
    e = table(spark, d, "events").select("event_type", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    return e.groupBy("event_type", "k").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, source FROM documents WHERE regexp_matches(source, '^src1[^/]*$') AND NOT regexp_matches(source, '^src1[0-3]$')")
def glob_scope(spark, d):
    return table(spark, d, "documents").where(tables.globbed(F.col("source"), ["src1*"], ["src1[0-3]"])).select("doc_id", "source")


@query("SELECT source || '/' || doc_id AS path FROM documents ORDER BY 1 LIMIT 100")
def glob_listing(spark, d):
    return table(spark, d, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path")).orderBy("path").limit(100)


@query("SELECT doc_id FROM documents WHERE source IN ('src3', 'src5')")
def path_scope(spark, d):
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"))
    return table(spark, d, "documents").where(tables.under(path, tables.roots_of("src3 src5 src3/1"))).select("doc_id")


@query("SELECT least(count(*), 1000000000) AS total, least(count(*), 10)::BIGINT AS shown, 'Rows' AS unit, 'cap' AS reason FROM documents")
def list_envelope(spark, d):
    return envelope.envelope(table(spark, d, "documents"), 10, "Rows").select("total", F.col("shown").cast("long").alias("shown"), "unit", "reason")


# --- ranked search --------------------------------------------------------------------------------------------------

LANES = (
    "a AS (SELECT c_custkey AS id, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) - 1 AS pos, c_acctbal AS raw, 'lexical' AS lane, 0.8 AS w, 1 AS o FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 600), "
    "s AS (SELECT o_custkey AS id, sum(o_totalprice) AS raw FROM orders GROUP BY 1), "
    "b AS (SELECT id, row_number() OVER (ORDER BY raw DESC, id) - 1 AS pos, raw, 'semantic' AS lane, 0.2 AS w, 2 AS o FROM s ORDER BY raw DESC, id LIMIT 600), "
    "u AS (SELECT * FROM a UNION ALL SELECT * FROM b), "
    "t AS (SELECT *, min(CASE WHEN pos < 200 THEN 200 WHEN pos < 400 THEN 400 WHEN pos < 800 THEN 800 WHEN pos < 1600 THEN 1600 ELSE 3200 END) OVER (PARTITION BY id) AS tier FROM u), "
    "f AS (SELECT id, tier, sum(CASE WHEN pos < tier THEN w / (60 + pos + 1) ELSE 0 END) AS fusion, max(raw) AS lane_score, arg_max(lane, (raw, -o)) AS best_lane, count(*) AS n_lanes FROM t GROUP BY id, tier)"
)


def _lanes(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("score"))
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.sum("o_totalprice").alias("score"))
    return [search.lane(c, "lexical", 1, 0.8, key="id", depth=600), search.lane(o, "semantic", 2, 0.2, key="id", depth=600)]


@query(f"WITH {LANES} SELECT id, tier::INTEGER AS tier, round(fusion::DOUBLE, 12) AS fusion_score FROM f")
def rrf_fusion(spark, d):
    f = search.fuse(_lanes(spark, d), key="id")
    return f.select("id", "tier", F.round("fusion_score", 12).alias("fusion_score"))


@query(f"WITH {LANES} SELECT id, round(lane_score, 4) AS lane_score, best_lane, n_lanes FROM f")
def lane_best(spark, d):
    return search.fuse(_lanes(spark, d), key="id").select("id", F.round("lane_score", 4).alias("lane_score"), "best_lane", "n_lanes")


@query(f"WITH {LANES} SELECT id, tier::INTEGER AS tier FROM f ORDER BY tier, fusion DESC, lane_score DESC, id LIMIT 20 OFFSET 195")
def block_page(spark, d):
    f = search.fuse(_lanes(spark, d), key="id").withColumns({"exact": F.lit(None).cast("string"), "exact_count": F.lit(None).cast("long")})
    return search.page(f, search.canonical_order("id"), 195, 20).select("id", "tier")


@query(
    f"WITH {LANES}, z AS (SELECT id, lane, pos, id % 5 = 0 AS data FROM u) SELECT id, lane, (row_number() OVER (PARTITION BY lane ORDER BY pos + CASE WHEN data THEN 20 ELSE 0 END, data, pos, id) - 1)::INTEGER AS new_pos FROM z"
)
def data_demotion(spark, d):
    a, b = _lanes(spark, d)
    return search.demote(a.unionByName(b), F.col("id") % 5 == 0, key="id").select("id", "lane", "new_pos")


@query(
    f"WITH {LANES}, k AS (SELECT fusion, row_number() OVER (ORDER BY fusion DESC, id) AS rank FROM f), p AS (SELECT fusion, lead(fusion) OVER (ORDER BY rank) AS nxt, rank FROM k) "
    "SELECT CASE WHEN (fusion - nxt) / fusion >= 0.05 THEN 'high' ELSE 'low' END AS confidence, round(((fusion - nxt) / fusion)::DOUBLE, 9) AS margin FROM p WHERE rank = 1"
)
def rank_margin(spark, d):
    f = search.fuse(_lanes(spark, d), key="id").orderBy(F.desc("fusion_score"), "id").limit(2)
    r = f.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("fusion_score"), "id"))).withColumn("exact", F.lit(None).cast("string"))
    return search.confidence(r).select("confidence", F.round("margin", 9).alias("margin"))


@query(
    "WITH e AS (SELECT doc_id, len(string_split(text, 'idiot')) - 1 AS n FROM documents WHERE contains(text, 'idiot')) SELECT doc_id, 'verbatim' AS exact, n::BIGINT AS exact_count FROM e"
)
def exact_lane(spark, d):
    return search.exact_evidence(table(spark, d, "documents"), "idiot", ["idiot"])


@query(
    "WITH k AS (SELECT doc_id, row_number() OVER (ORDER BY length(text) DESC, doc_id) AS rank, sha256(text) AS digest FROM documents), s AS (SELECT DISTINCT digest, (length(digest) + ascii(digest[1]))::DOUBLE AS score FROM k WHERE rank % 2 = 0) "
    "SELECT doc_id, rank::INTEGER AS rank, row_number() OVER (ORDER BY CASE WHEN rank <= 20 THEN 1 ELSE 0 END DESC, CASE WHEN rank <= 20 THEN coalesce(score, -1e300) END DESC, rank)::INTEGER AS new_rank FROM k LEFT JOIN s USING (digest) WHERE rank <= 40"
)
def rerank_head(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", F.length("text").alias("n")).orderBy(F.desc("n"), "doc_id").limit(40)
    head = docs.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "doc_id")))
    scores = head.where("rank % 2 = 0").select(F.sha2("text", 256).alias("digest")).distinct().withColumn("score", (F.length("digest") + F.ascii("digest")).cast("double"))
    return search.rerank(head, scores).select("doc_id", "rank", "new_rank")


@query(
    "WITH t AS (SELECT DISTINCT doc_id FROM labels), a AS (SELECT doc_id FROM documents WHERE lang = 'en'), b AS (SELECT doc_id FROM documents WHERE length(text) > 500) "
    "SELECT t.doc_id, CASE WHEN t.doc_id NOT IN (SELECT doc_id FROM a) THEN 'language' WHEN t.doc_id NOT IN (SELECT doc_id FROM b) THEN 'length' END AS lost_at FROM t"
)
def recall_audit(spark, d):
    docs = table(spark, d, "documents")
    stages = {"language": docs.where("lang = 'en'"), "length": docs.where(F.length("text") > 500)}
    return search.recall_audit(table(spark, d, "labels").select("doc_id").distinct(), stages)


@query(
    "WITH e AS (SELECT doc_id, starts_with(text, 'The') AS def, CASE WHEN doc_id % 3 = 0 THEN len(string_split(text, 'idiot')) - 1 END AS occ, CASE WHEN doc_id % 5 = 0 THEN length(source) END AS span, CASE WHEN doc_id % 2 = 0 THEN 3 END AS win FROM documents) "
    "SELECT doc_id, CASE WHEN def THEN 'definition' WHEN occ > 0 THEN 'verbatim' WHEN occ IS NOT NULL THEN NULL WHEN span IS NOT NULL THEN 'anchored' WHEN win IS NOT NULL THEN 'window' END AS kind, "
    "(CASE WHEN def THEN NULL WHEN occ > 0 THEN occ WHEN occ IS NOT NULL THEN NULL WHEN span IS NOT NULL THEN span ELSE win END)::BIGINT AS value FROM e"
)
def evidence_kinds(spark, d):
    """The descriptor of every document from several kinds of evidence."""
    i, text = F.col("doc_id"), F.col("text")
    occurrences = F.when(i % 3 == 0, F.size(F.split(text, "idiot")) - 1)
    e = search.evidence(F.startswith(text, F.lit("The")), occurrences, F.when(i % 5 == 0, F.length("source")), F.when(i % 2 == 0, F.lit(3)))
    return table(spark, d, "documents").select("doc_id", e.alias("e")).select("doc_id", "e.kind", "e.value")


@query(
    f"WITH {LINES}, m AS (SELECT doc_id, line_no, unnest(regexp_extract_all(line, '[A-Za-z_$][A-Za-z0-9_$]*')) AS name, 1 AS mention FROM l "
    "UNION ALL SELECT doc_id, line_no, unnest(regexp_extract_all(line, '([A-Za-z_$][A-Za-z0-9_$]*) =', 1)), 0 FROM l), "
    "f AS (SELECT name, min((mention, doc_id, line_no)) AS x FROM m WHERE length(name) >= 3 GROUP BY name) "
    "SELECT name, x[1] = 0 AS declared, x[2] AS doc_id, x[3] AS line_no FROM f"
)
def identifier_locations(spark, d):
    """Where each name of all documents is declared (left of an equals sign) or first named."""
    return search.identifiers(table(spark, d, "documents"), r"([A-Za-z_$][A-Za-z0-9_$]*) =")


#: Queries with the shape and lexical weight that they must have, written by hand.
SHAPES = (
    ("fn handle(x)", "code_literal", 0.9),
    ("return value;", "code_literal", 0.9),
    ("a,b", "code_literal", 0.9),
    ('"exact words here"', "code_literal", 0.9),
    ("ERROR 2024-01-02 10:11:12 failed", "log_excerpt", 0.9),
    ("warn pool is exhausted", "log_excerpt", 0.9),
    ("src/main.rs", "path", 0.9),
    ("packages/plugin/src/tools/semantic.ts", "path", 0.9),
    ("camelCase", "identifier", 0.8),
    ("subagent_type", "identifier", 0.8),
    ("getCurrentWorkingDirectory", "identifier", 0.8),
    ("how does paging work here", "natural_language", 0.4),
    ("attach the client, then the socket closes", "natural_language", 0.4),
    ("explain the authentication middleware flow", "natural_language", 0.4),
    ("foo.*bar", "regex", 1.0),
    ("^export", "regex", 1.0),
    ("[a-z]+", "regex", 1.0),
    ("two words", "short", 0.8),
)


@query("SELECT * FROM (VALUES " + ", ".join(f"('{q}', '{shape}', {w}::DOUBLE)" for q, shape, w in SHAPES) + ") AS t(query, shape, lexical)")
def query_shapes(spark, d):
    found = [(q, router.classify(q)) for q, _, _ in SHAPES]
    return spark.createDataFrame([(q, s, router.WEIGHTS[s][0]) for q, s in found], "query string, shape string, lexical double")


@query(
    "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY length(text) DESC, doc_id) AS rank FROM documents), j AS (SELECT rank, toxic FROM r JOIN labels USING (doc_id)) "
    "SELECT round(avg(CASE WHEN rank <= 100 THEN 1.0 ELSE 0.0 END), 9)::DOUBLE AS recall, round(avg(1.0 / rank), 12)::DOUBLE AS mrr, count(*) AS n FROM j WHERE toxic = 1"
)
def retrieval_quality(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.length("text").alias("n"))
    r = relational.global_rank(docs, "n", "doc_id")
    j = r.join(table(spark, d, "labels").where("toxic = 1"), "doc_id")
    return j.agg(F.round(F.avg((F.col("rank") <= 100).cast("double")), 9).alias("recall"), F.round(F.avg(1.0 / F.col("rank")), 12).alias("mrr"), F.count(F.lit(1)).alias("n"))


# --- vectors --------------------------------------------------------------------------------------------------------


def _query_vector(spark, d) -> list[float]:
    return [float(x) for x in table(spark, d, "embeddings").where("vec_id = 0").first()["embedding"]]


QV = "q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"
COS = "list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q)))"


@query(f"WITH {QV} SELECT vec_id, round({COS}, 6) AS score FROM e, q ORDER BY {COS} DESC, vec_id LIMIT 10")
def vector_cosine_topk(spark, d):
    return vector.top_k(table(spark, d, "embeddings"), _query_vector(spark, d), 10).select("vec_id", F.round("score", 6).alias("score"))


@query(f"WITH {QV} SELECT vec_id, round({COS}, 6) AS score FROM e, q ORDER BY {COS} DESC, vec_id LIMIT 10")
def vector_pruned_topk(spark, d):
    q = vector.publish(vector.quantise(table(spark, d, "embeddings")))
    return vector.pruned_top_k(q, _query_vector(spark, d), 10).select("vec_id", F.round("score", 6).alias("score"))


@query(f"WITH {QV} SELECT vec_id, round(sqrt(list_dot_product(v, v)), 6) AS norm FROM e")
def vector_norms(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(vector.norm(F.col("embedding")), 6).alias("norm"))


@query(f"WITH {QV} SELECT vec_id, true AS bounded FROM e")
def vector_int8_bounds(spark, d):
    qv = _query_vector(spark, d)
    b = vector.bounds(vector.quantise(table(spark, d, "embeddings")), qv)
    s = vector.cosine(F.col("embedding"), F.array(*map(F.lit, qv)))
    return b.select("vec_id", ((F.col("lower") <= s) & (s <= F.col("upper"))).alias("bounded"))


@query(f"WITH {QV}, k AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY {COS} DESC, vec_id)::INTEGER AS rank FROM e, q) SELECT label, vec_id, rank FROM k WHERE rank <= 3")
def vector_topk_by_label(spark, d):
    return vector.top_per_group(table(spark, d, "embeddings"), _query_vector(spark, d), "label", 3).select("label", "vec_id", "rank")


# --- relational -----------------------------------------------------------------------------------------------------


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_per_key(spark, d):
    return relational.latest(table(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query("SELECT o_custkey, o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM orders n WHERE n.o_custkey = o.o_custkey AND n.o_orderdate > o.o_orderdate)")
def newest_epoch_anti(spark, d):
    return relational.newest_epoch(table(spark, d, "orders"), ["o_custkey"], "o_orderdate").select("o_custkey", "o_orderkey")


@query(
    "WITH a AS (SELECT o_custkey AS k, 'order' AS kind FROM orders UNION ALL SELECT user_id, event_type FROM events) SELECT count(*) AS n_rows, count(DISTINCT k) AS n_keys, count(DISTINCT (k, kind)) AS n_pairs FROM a"
)
def activity_union_counts(spark, d):
    a = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.lit("order").alias("kind"))
    b = table(spark, d, "events").select(F.col("user_id").alias("k"), F.col("event_type").alias("kind"))
    return a.unionByName(b).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("k").alias("n_keys"), F.count_distinct(F.struct("k", "kind")).alias("n_pairs"))


@query("SELECT l_returnflag, l_linestatus, l_linenumber, min(l_shipdate) AS first_ship, count(*) AS n FROM lineitem GROUP BY ALL")
def stack_summary(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus", "l_linenumber").agg(F.min("l_shipdate").alias("first_ship"), F.count(F.lit(1)).alias("n"))


TURNS = "t AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INTEGER AS turn FROM events)"


def _turns(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("user_id", "event_id", "event_type", F.row_number().over(w).alias("turn"))


@query(
    f"WITH {TURNS} SELECT a.event_id AS rendered, b.event_id AS gone, b.turn - a.turn AS apart FROM t a JOIN t b ON a.user_id = b.user_id AND b.turn - a.turn BETWEEN 1 AND 5 WHERE a.event_type = 'view' AND b.event_type = 'purchase'"
)
def range_join_5(spark, d):
    t = _turns(spark, d)
    a = t.where("event_type = 'view'").select("user_id", F.col("event_id").alias("rendered"), F.col("turn").alias("a"))
    b = t.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("gone"), F.col("turn").alias("b"))
    return relational.within(a, b, ["user_id"], "a", "b", 1, 5).select("rendered", "gone", (F.col("b") - F.col("a")).alias("apart"))


@query(
    "SELECT e.event_id, p.event_id AS prior FROM (SELECT * FROM events WHERE event_type = 'purchase') e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') p ON e.user_id = p.user_id AND e.ts >= p.ts"
)
def as_of_join(spark, d):
    e = table(spark, d, "events")
    left = e.where("event_type = 'purchase'").select("user_id", "event_id", "ts")
    right = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("prior"), F.col("ts").alias("since"))
    return relational.as_of(left, right, ["user_id"], "ts", "since").select("event_id", F.col("r_prior").alias("prior"))


@query(
    "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderkey % 10 = 3) DESC, length(o_orderkey::VARCHAR) DESC, o_orderkey::VARCHAR DESC) AS rn FROM orders) WHERE rn = 1"
)
def asof_prefer_exact(spark, d):
    k = F.col("o_orderkey").cast("string")
    exact = F.when(F.col("o_orderkey") % 10 == 3, 0).otherwise(1)
    return relational.latest(table(spark, d, "orders"), ["o_custkey"], [exact.asc(), *relational.decimal_order(k)]).select("o_custkey", "o_orderkey")


@query(
    "WITH n AS (SELECT c_custkey, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey + 1000000, c_acctbal FROM customer WHERE c_custkey % 100 = 0) "
    "SELECT c_custkey, c_acctbal FROM n UNION ALL SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM n)"
)
def upsert_latest(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    new = c.where("c_custkey % 3 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1).unionByName(c.where("c_custkey % 100 = 0").withColumn("c_custkey", F.col("c_custkey") + 1000000))
    return relational.upsert(c, new, ["c_custkey"], "c_acctbal")


@query(
    "WITH s AS (SELECT user_id, event_id FROM events WHERE user_id % 2 = 0), n AS (SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id) SELECT * FROM s UNION ALL SELECT * FROM n WHERE user_id NOT IN (SELECT user_id FROM s)"
)
def insert_if_absent(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id")
    return relational.insert_if_absent(e.where("user_id % 2 = 0"), e, ["user_id"], [F.col("event_id")])


@query(
    "WITH g AS (SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-10' ORDER BY ts, event_id LIMIT 64) SELECT event_id FROM events WHERE event_id NOT IN (SELECT event_id FROM g)"
)
def ttl_sweep_oldest(spark, d):
    e = table(spark, d, "events").select("event_id", "ts")
    return relational.sweep(e, F.col("ts") < F.lit("2024-01-10").cast("timestamp_ntz"), [F.col("ts"), F.col("event_id")], ["event_id"]).select("event_id")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rn FROM events) WHERE rn <= 3")
def keep_newest_n(spark, d):
    return relational.keep_newest(table(spark, d, "events"), ["user_id"], [F.desc("ts"), F.col("event_id")], 3).select("user_id", "event_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey > 500 AND o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 100")
def keyset_batch(spark, d):
    return relational.keyset_batch(table(spark, d, "orders"), "o_orderkey", 500, 100, F.col("o_orderstatus") == "F").select("o_orderkey")


@query(
    "SELECT event_type, event_id, greatest(n - cap, 0)::BIGINT AS dropped FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn, count(*) OVER (PARTITION BY event_type) AS n, CASE event_type WHEN 'view' THEN 20 WHEN 'purchase' THEN 10 ELSE 50 END AS cap FROM events) WHERE rn <= cap"
)
def class_caps(spark, d):
    e = table(spark, d, "events").select("event_type", "event_id")
    return relational.class_caps(e, "event_type", [F.col("event_id")], {"view": 20, "purchase": 10}, 50).select("event_type", "event_id", F.col("dropped").cast("long").alias("dropped"))


@query(
    "WITH own AS (SELECT doc_id, 'own' AS origin FROM documents WHERE doc_id % 4 = 0) SELECT doc_id, 'base' AS origin FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM own) UNION ALL SELECT * FROM own"
)
def overlay_merge(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    return tables.overlay(docs.withColumn("origin", F.lit("base")), docs.where("doc_id % 4 = 0").withColumn("origin", F.lit("own")), "doc_id")


@query(
    "WITH a AS (SELECT lang, source FROM documents WHERE doc_id % 2 = 0), b AS (SELECT lang, source FROM documents WHERE doc_id % 3 = 0) SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'right' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)"
)
def symmetric_difference(spark, d):
    docs = table(spark, d, "documents")
    return relational.symmetric_difference(docs.where("doc_id % 2 = 0").select("lang", "source"), docs.where("doc_id % 3 = 0").select("lang", "source"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semi_in_subquery(spark, d):
    c = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").join(c, "o_custkey", "left_semi").select("o_orderkey")


@query("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
def anti_not_exists(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left_anti")


@query("SELECT doc_id, lang FROM documents WHERE lang NOT IN ('en', 'fr')")
def optional_filters(spark, d):
    lang, excluded = None, ["en", "fr"]
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return (docs if lang is None else docs.where(F.col("lang") == lang)).where(~F.col("lang").isin(*excluded))


@query("SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 2")
def top_groups(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source").limit(2)


@query("SELECT count(*) AS n, coalesce(sum(strlen(text)), 0)::BIGINT AS bytes FROM documents WHERE lang = 'xx'")
def blob_totals(spark, d):
    t = table(spark, d, "documents").where("lang = 'xx'")
    return t.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).cast("long").alias("bytes"))


# --- compression ----------------------------------------------------------------------------------------------------


@query(
    f"""WITH {LINES}, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS a, row_number() OVER (PARTITION BY doc_id ORDER BY line_no DESC) AS z,
    sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no DESC) AS b, count(*) OVER (PARTITION BY doc_id) AS n FROM l),
    t AS (SELECT *, (z <= 5 AND b <= 4096) AS tail FROM k), c AS (SELECT *, count(*) FILTER (tail) OVER (PARTITION BY doc_id) AS nt FROM t)
    SELECT doc_id, line_no, greatest(n - 10, 0)::BIGINT AS n_cut FROM c WHERE n <= 10 OR tail OR a <= 10 - nt"""
)
def head_tail_cut(spark, d):
    rows = X.lines(table(spark, d, "documents"), "doc_id")
    return compress.head_tail(rows, "doc_id", 10).select("doc_id", "line_no", F.col("n_cut").cast("long").alias("n_cut"))


@query(
    f"WITH {LINES}, k AS (SELECT *, sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no) AS b FROM l) SELECT doc_id, count(*) AS n FROM k WHERE b <= 1000 GROUP BY doc_id"
)
def byte_budget(spark, d):
    return compress.byte_budget(X.lines(table(spark, d, "documents"), "doc_id"), "doc_id", 1000).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"WITH {LINES}, s AS (SELECT doc_id, line_no, trim(regexp_replace(regexp_replace(line, '[0-9]+', '#', 'g'), '\\s+', ' ', 'g')) AS line FROM l), {RUNS.replace('FROM l)', 'FROM s)', 1)} SELECT doc_id, start, n, replace(line, '#', '*') AS shape FROM u WHERE n >= 8"
)
def fold_shape_runs(spark, d):
    return compress.fold_shapes(X.lines(table(spark, d, "documents"), "doc_id"), "doc_id").select("doc_id", "start", "n", "shape")


@query(
    f"WITH {LINES}, s AS (SELECT doc_id, line_no, CASE WHEN length(line) > 40 THEN left(line, 39) || '…' ELSE line END AS line FROM l WHERE NOT regexp_matches(line, '^The')), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS a FROM s), t AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS text FROM k WHERE a <= 3 GROUP BY doc_id) "
    "SELECT doc_id, CASE WHEN contains(d.text, 'Licensed under') THEN 'license text' ELSE coalesce(t.text, '') END AS text FROM documents d LEFT JOIN t USING (doc_id)"
)
def declarative_filter(spark, d):
    f = compress.Filter(strip=["^The"], truncate=40, max_lines=3, shortcircuit=[("Licensed under", "license text")])
    return compress.apply_filter(table(spark, d, "documents"), f)


# --- graph ----------------------------------------------------------------------------------------------------------

EDGES = (
    "pair AS (SELECT c_nationkey AS src, s_nationkey AS dst, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2), "
    "edges AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) AS rn FROM pair) WHERE rn <= 2)"
)


def trade_edges(spark, d):
    """Each customer nation's two largest supplier nations by lines."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.count(F.lit(1)).alias("c"))
    j = (
        li.join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    )
    n = j.groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).agg(F.sum("c").alias("n"))
    return graph._cut(relational.keep_newest(n, ["src"], [F.desc("n"), F.col("dst")], 2).select("src", "dst"))


def _target(edges) -> int:
    return edges.agg(F.min("dst")).first()[0]


@query(
    f"WITH RECURSIVE {EDGES}, r AS (SELECT (SELECT min(dst) FROM edges) AS node, 0 AS depth UNION SELECT e.src, r.depth + 1 FROM r JOIN edges e ON e.dst = r.node WHERE r.depth < 3) "
    "SELECT node, min(depth)::INTEGER AS depth FROM r WHERE node != (SELECT min(dst) FROM edges) GROUP BY node"
)
def callers_depth(spark, d):
    e = trade_edges(spark, d)
    return graph.callers(e, _target(e), 3)


PATHS = (
    "p AS (SELECT [(SELECT min(dst) FROM edges)] AS path UNION ALL SELECT list_append(p.path, e.dst) FROM p JOIN edges e ON e.src = p.path[len(p.path)] WHERE len(p.path) <= 4 AND NOT list_contains(p.path, e.dst))"
)


@query(f"WITH RECURSIVE {EDGES}, {PATHS} SELECT array_to_string(path, '>') AS path, (len(path) - 1)::INTEGER AS depth FROM p")
def call_tree_paths(spark, d):
    e = trade_edges(spark, d)
    return graph.call_tree(e, _target(e), 4).select(F.array_join(F.col("path").cast("array<string>"), ">").alias("path"), "depth")


@query(
    f"WITH RECURSIVE {EDGES}, p AS (SELECT [0] AS path UNION ALL SELECT list_append(p.path, e.dst) FROM p JOIN edges e ON e.src = p.path[len(p.path)] WHERE len(p.path) <= 8 AND NOT list_contains(p.path, e.dst)) "
    "SELECT array_to_string(path, '>') AS path FROM p WHERE path[len(path)] = (SELECT max(dst) FROM edges) ORDER BY len(path), path LIMIT 1"
)
def shortest_path(spark, d):
    e = trade_edges(spark, d)
    got = graph.shortest_path(e, 0, e.agg(F.max("dst")).first()[0], 8)
    return got.select(F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@query(
    f"WITH RECURSIVE {EDGES}, r AS (SELECT src AS origin, src AS node FROM edges UNION SELECT r.origin, e.dst FROM r JOIN edges e ON e.src = r.node) SELECT origin, count(*) AS n FROM r GROUP BY origin"
)
def reachable_roots(spark, d):
    e = trade_edges(spark, d)
    start = e.select(F.col("src").alias("origin"), F.col("src").alias("node")).distinct()
    return graph.reach(e, start).groupBy("origin").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"WITH RECURSIVE {EDGES}, r AS (SELECT 0 AS node UNION SELECT e.dst FROM r JOIN edges e ON e.src = r.node) SELECT n_nationkey AS node FROM nation WHERE n_nationkey NOT IN (SELECT node FROM r)"
)
def dead_nodes(spark, d):
    nodes = table(spark, d, "nation").select(F.col("n_nationkey").alias("node"))
    return graph.dead_nodes(nodes, trade_edges(spark, d), nodes.where("node = 0"))


@query(
    f"WITH RECURSIVE {EDGES}, r AS (SELECT src AS origin, dst AS node FROM edges UNION SELECT r.origin, e.dst FROM r JOIN edges e ON e.src = r.node), "
    "c AS (SELECT a.origin AS node, least(a.origin, min(a.node)) AS component FROM r a JOIN r b ON a.origin = b.node AND a.node = b.origin GROUP BY a.origin) SELECT node, component, count(*) OVER (PARTITION BY component) AS size FROM c"
)
def self_and_scc_cycles(spark, d):
    return graph.cycles(trade_edges(spark, d))


@query(
    f"WITH RECURSIVE {EDGES}, p AS (SELECT [(SELECT min(dst) FROM edges)] AS path UNION ALL SELECT list_prepend(e.src, p.path) FROM p JOIN edges e ON e.dst = p.path[1] WHERE len(p.path) <= 3 AND NOT list_contains(p.path, e.src)) "
    "SELECT array_to_string(path, '>') AS path FROM p WHERE len(path) > 1 AND path[1] NOT IN (SELECT dst FROM edges)"
)
def trace_to_roots(spark, d):
    e = trade_edges(spark, d)
    roots = e.select(F.col("src").alias("node")).distinct().join(e.select(F.col("dst").alias("node")).distinct(), "node", "left_anti")
    return graph.trace_to(e, roots, _target(e), 3).select(F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@query(f"WITH {EDGES} SELECT n_nationkey AS node, CASE WHEN n_nationkey = 0 THEN 'main' WHEN n_regionkey = 1 THEN 'test' WHEN n_regionkey = 2 THEN 'public_api' WHEN n_nationkey NOT IN (SELECT dst FROM edges WHERE src != dst) THEN 'no_caller_found' ELSE 'internal' END AS kind FROM nation")
def root_kinds(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("node"), (F.col("n_nationkey") == 0).alias("is_main"), (F.col("n_regionkey") == 1).alias("is_test"), (F.col("n_regionkey") == 2).alias("is_exported"))
    return graph.root_kinds(n, trade_edges(spark, d))


@query(f"WITH {EDGES} SELECT dst AS node, count(*) AS n_in FROM edges GROUP BY dst")
def in_degrees(spark, d):
    return graph.in_degrees(trade_edges(spark, d))


CALLS = "k AS (SELECT src, dst, n_regionkey AS file, src % 5 = 0 AS is_test FROM edges JOIN nation ON n_nationkey = src), g AS (SELECT min(dst) AS target FROM edges)"


def _calls(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("src"), F.col("n_regionkey").alias("file"))
    e = trade_edges(spark, d)
    calls = e.join(n, "src").select("src", "dst", "file", F.lit(1).alias("line"), F.lit("call").alias("expression"), (F.col("src") % 5 == 0).alias("is_test"))
    return calls, _target(e)


NEAR = (
    "r AS (SELECT target AS node, 1 AS depth FROM g UNION SELECT k.src, r.depth + 1 FROM r JOIN k ON k.dst = r.node AND NOT k.is_test WHERE r.depth < 3), "
    "near AS (SELECT node, min(depth)::INTEGER AS depth FROM r GROUP BY node), j AS (SELECT k.*, depth FROM k JOIN near ON k.dst = near.node)"
)


@query(f"WITH RECURSIVE {EDGES}, {CALLS}, {NEAR} SELECT src, dst, depth, CASE WHEN dst = (SELECT target FROM g) THEN 'direct' ELSE 'transitive' END AS relation FROM j WHERE NOT is_test")
def impact_sites(spark, d):
    return graph.call_sites(*_calls(spark, d), 3)[0].select("src", "dst", "depth", "relation")


@query(
    f"WITH RECURSIVE {EDGES}, {CALLS}, {NEAR} SELECT count(DISTINCT src) FILTER (NOT is_test AND src != (SELECT target FROM g)) AS total_affected, count(DISTINCT file) FILTER (NOT is_test) AS affected_files, "
    "count(*) FILTER (NOT is_test) AS sites, count(DISTINCT src) FILTER (is_test) AS hidden_tests FROM j"
)
def impact_totals(spark, d):
    return graph.call_sites(*_calls(spark, d), 3)[1]


KINDS = "i AS (SELECT src, dst, CASE (src + dst) % 3 WHEN 0 THEN 'type' WHEN 1 THEN 'static' ELSE 'dynamic' END AS kind FROM edges)"


@query(
    f"WITH RECURSIVE {EDGES}, {KINDS}, r AS (SELECT src AS o, dst AS n FROM i WHERE kind != 'type' UNION SELECT r.o, i.dst FROM r JOIN i ON i.src = r.n AND i.kind != 'type'), "
    "s AS (SELECT src AS o, dst AS n FROM i WHERE kind = 'static' UNION SELECT s.o, i.dst FROM s JOIN i ON i.src = s.n AND i.kind = 'static'), "
    "c AS (SELECT a.o AS node, least(a.o, min(a.n)) AS component FROM r a JOIN r b ON a.o = b.n AND a.n = b.o GROUP BY a.o), "
    "t AS (SELECT DISTINCT component FROM c JOIN s ON s.o = c.node AND s.n = c.node) "
    "SELECT node, component, count(*) OVER (PARTITION BY component) AS size, CASE WHEN component IN (SELECT component FROM t) THEN 'static' ELSE 'dynamic-only' END AS edge_kind FROM c"
)
def import_cycle_kinds(spark, d):
    n = (F.col("src") + F.col("dst")) % 3
    return graph.import_cycles(trade_edges(spark, d).withColumn("kind", F.when(n == 0, "type").when(n == 1, "static").otherwise("dynamic")))


@query(
    "WITH own AS (SELECT source AS file, lang AS target_file FROM documents WHERE doc_id % 50 = 0), c AS (SELECT source AS file, lang AS target_file FROM documents WHERE source NOT IN (SELECT file FROM own) UNION ALL SELECT * FROM own) "
    "SELECT DISTINCT file FROM c WHERE target_file = 'de'"
)
def callers_with_overlay(spark, d):
    calls = table(spark, d, "documents").select("doc_id", F.col("source").alias("file"), F.col("lang").alias("target_file"), F.lit("x").alias("target_name"))
    return graph.caller_files(calls.drop("doc_id"), calls.where("doc_id % 50 = 0").drop("doc_id"), "de", "x")


@query("SELECT DISTINCT doc_id AS file FROM documents WHERE list_contains(regexp_extract_all(text, '[A-Za-z]+'), 'idiot')")
def documents_with_name(spark, d):
    words = F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)))
    names = table(spark, d, "documents").select(F.col("doc_id").alias("file"), words.alias("name"), F.lit("reference").alias("kind"))
    return graph.files_with_name(names, "idiot")


@query(
    f"WITH {LINES}, n AS (SELECT doc_id, line_no, trim(regexp_replace(regexp_replace(translate(regexp_replace(line, '\"[^\"]*\"', '#', 'g'), {FOLD}), '[0-9]+', '#', 'g'), '\\s+', ' ', 'g')) AS line FROM l), "
    "r AS (SELECT doc_id, line || chr(10) || lead(line, 1) OVER w || chr(10) || lead(line, 2) OVER w AS run FROM n WHERE line != '' WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)) "
    "SELECT md5(run) AS digest, count(*) AS n, count(DISTINCT doc_id) AS n_docs, bool_or(contains(run, 'licensed')) AS suppressed FROM r WHERE run IS NOT NULL GROUP BY run HAVING count(*) > 1"
)
def duplicate_fragments(spark, d):
    return health.duplicate_fragments(table(spark, d, "documents"))


PENDING = (
    "done AS (SELECT user_id, max(event_id) AS through FROM events WHERE event_type = 'purchase' GROUP BY user_id), live AS (SELECT e.user_id, event_id FROM events e LEFT JOIN done USING (user_id) WHERE through IS NULL OR event_id > through), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM live)"
)


def _notices(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    return streaming.deliverable(e.drop("event_type"), e.where("event_type = 'purchase'"), ["user_id"], "event_id", 2)


@query(f"WITH {PENDING} SELECT user_id, event_id FROM k WHERE rn <= 2")
def pending_notices(spark, d):
    return _notices(spark, d)[0]


@query(f"WITH {PENDING} SELECT user_id, count(*) AS evicted, max(event_id) AS evicted_through FROM k WHERE rn > 2 GROUP BY user_id")
def eviction_gaps(spark, d):
    return _notices(spark, d)[1]


# --- streams as tables ----------------------------------------------------------------------------------------------


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def tumbling_counts(spark, d):
    c = streaming.counts(table(spark, d, "events"), "1 hour")
    return c.withColumn("total", F.round("total", 6))


@query(
    "SELECT time_bucket(INTERVAL '30 minutes', ts) - INTERVAL (30 * k) MINUTE AS start, event_type, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY 1, 2"
)
def sliding_counts(spark, d):
    return streaming.counts(table(spark, d, "events"), "1 hour", "30 minutes").drop("total")


@query(
    "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '6 hours' THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) "
    'SELECT user_id AS root, min(ts) AS start, max(ts) + INTERVAL \'6 hours\' AS "end", count(*) AS n FROM s GROUP BY user_id, k'
)
def session_gaps(spark, d):
    return streaming.debounced(table(spark, d, "events").withColumnRenamed("user_id", "root"), "6 hours")


@query(
    "WITH e AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) SELECT event_id, coalesce(event_type = prev, false) AS repeat FROM e"
)
def repeated_calls(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select(F.col("user_id").alias("session"), "event_id", F.col("event_type").alias("tool"), F.lit("{}").alias("args"), F.lit("").alias("output"), F.row_number().over(w).alias("seq"))
    return streaming.repeated_calls(e).select("event_id", "repeat")


@query()
def stream_line_watch(spark, d):
    """The watcher over conversations as byte streams, run as a stream to its end; results from a memory sink."""
    import uuid

    conv = table(spark, d, "conversations").select("conv_id", "turn", F.concat("text", F.lit("\n")).cast("binary").alias("data"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    size = F.octet_length("data").cast("long")
    end = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))
    chunks = conv.select(
        F.col("conv_id").cast("string").alias("stream"), (end - size).alias("offset"), "data", (F.col("turn") * 1000).alias("at_ms"), F.lead("turn").over(w).isNull().alias("last")
    )
    at = f"{tables.shared_folder(spark).rstrip('/')}/watch-{uuid.uuid4().hex}"
    chunks.write.parquet(f"{at}/in")
    stream = spark.readStream.schema(chunks.schema).parquet(f"{at}/in")
    run = (
        streaming.watch(stream, "The")
        .writeStream.format("parquet").option("checkpointLocation", f"{at}/state").option("path", f"{at}/out")
        .outputMode("append").trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return spark.read.schema(streaming.OUTPUT).parquet(f"{at}/out")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
