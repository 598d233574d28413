"""URL filters by association rules.

Pages whose path holds the id of a labelled document make baskets: the tokens of their url (the labels of its host, the
words of its path, the keys of its query), and an item that says whether the label is bad (low quality or toxic). Tokens that occur
in exactly the same baskets count as one, so that a site's fixed path is one item and not a power set. Spark's FP-growth
mines the frequent combinations on three quarters of the labelled documents; rules that lead to the bad item are kept by
support (a share, and never fewer than ``MIN_PAGES`` pages) and confidence, checked on the last quarter and counted anew
on all; a rule is dropped where a part of it says the same. Rules are matched by an inverted index: each stands in the
list of its rarest token, and a url looks up its tokens only.

Null urls and such without :// have empty parts and no tokens and are allowed. Repeated rows give repeated results; very
long urls are read whole. Only page_id and url are read, so other columns can't clash. Empty pages give an empty result;
without labels nothing is mined.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, pin, table

BAD = "label=bad"
MIN_SUPPORT = 0.004
MIN_CONFIDENCE = 0.6
MIN_PAGES = 5
MAX_BROADCAST_RULES = 20_000
# Fixed values of the contract: (host, path, verdict).
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def url_host(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    return ascii_lower(F.coalesce(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    return F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def with_parts(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url) with host, path and tokens; a url without :// has empty parts and no tokens."""
    words = F.expr(r"regexp_extract_all(path, '([A-Za-z_-]+)', 1)")
    paths = F.transform(words, lambda x: F.concat(F.lit("p:"), ascii_lower(x)))
    query = F.expr(r"regexp_extract_all(coalesce(url, ''), '[?&]([^=&#?]+)', 1)")
    keys = F.transform(query, lambda x: F.concat(F.lit("q:"), x))
    labels = F.transform(F.filter(F.split("host", r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x))
    return (
        pages.select("page_id", "url")
        .withColumn("host", url_host(F.col("url")))
        .withColumn("path", url_path(F.col("url")))
        .withColumn("tokens", F.array_distinct(F.concat(labels, paths, F.when(F.col("host") != "", keys).otherwise(F.array().cast("array<string>")))))
    )


def explicit_rule(rules=RULES) -> Column:
    """The longest rule that fits, as a struct (host, path, verdict), null if none; equal lengths: the first listed."""
    best = F.lit(None)
    for host, path, verdict in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit(f".{host}"))) & F.startswith(F.col("path"), F.lit(path))
        best = F.when(fits, F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def _held_out(doc_id: Column) -> Column:
    """A quarter of the labelled documents, on which rules are checked."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 3


def _together(baskets: DataFrame, least: int) -> DataFrame:
    """(token, rep, members): tokens of ``least`` baskets and more; those of exactly the same baskets share a rep.

    Each covers ``least`` baskets, so there are at most so many as the baskets hold tokens, divided by ``least``.
    """
    h = F.xxhash64("row").cast("decimal(38,0)")
    rows = baskets.select(F.explode("tokens").alias("token"), h.alias("h"))
    same = rows.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum("h").alias("s")).where(F.col("n") >= least)
    groups = same.groupBy("n", "s").agg(F.array_sort(F.collect_list("token")).alias("members"))
    return groups.select(F.explode("members").alias("token"), F.col("members")[0].alias("rep"), "members")


def _counted(rules: DataFrame, baskets: DataFrame, where: Column) -> DataFrame:
    """``rules`` (tokens) with pages and bad, the baskets that hold all of a rule's tokens, in all and with a bad label."""
    lists = rules.select("tokens", F.explode("tokens").alias("token"))
    hits = baskets.where(where).select("row", "bad", F.explode("tokens").alias("token")).join(lists, "token")
    whole = hits.groupBy("row", "tokens").agg(F.max("bad").alias("bad"), F.count(F.lit(1)).alias("k")).where(F.col("k") == F.size("tokens"))
    found = whole.groupBy("tokens").agg(F.count(F.lit(1)).alias("pages"), F.sum("bad").alias("bad"))
    return rules.join(found, "tokens", "left").na.fill(0, ["pages", "bad"])


def mine_rules(
    parts: DataFrame, labels: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_pages: int = MIN_PAGES
) -> DataFrame:
    """Rules (tokens, confidence, support) that lead to the bad label, none a superset of a rule at least as sure."""
    doc = F.expr("try_cast(regexp_extract(path, '([0-9]+)', 1) as bigint)")
    bad = labels.groupBy("doc_id").agg(F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")).alias("bad"))
    known = parts.withColumn("doc_id", doc).join(bad.where("bad is not null and doc_id is not null"), "doc_id")
    known = pin(known.where(F.size("tokens") > 0).select(F.monotonically_increasing_id().alias("row"), "doc_id", "tokens", "bad"))
    learnt = known.where(~_held_out(F.col("doc_id")))
    n, n_all = learnt.count(), known.count()
    least = max(min_pages, -(-n * min_support // 1))
    if n < least:
        return known.select("tokens", F.lit(0.0).alias("confidence"), F.lit(0.0).alias("support")).limit(0)
    groups = pin(_together(learnt, int(least)))
    reps = groups.agg(F.map_from_entries(F.collect_list(F.struct("token", "rep"))).alias("reps"))
    named = learnt.crossJoin(F.broadcast(reps)).withColumn("items", F.array_distinct(F.filter(F.transform("tokens", lambda t: F.col("reps")[t]), lambda t: t.isNotNull())))
    items = F.when(F.col("bad") == 1, F.concat("items", F.array(F.lit(BAD)))).otherwise(F.col("items"))
    baskets = pin(named.select(items.alias("items")).where(F.size("items") > 0))
    n_items = baskets.count()
    if n_items < least:
        return known.select("tokens", F.lit(0.0).alias("confidence"), F.lit(0.0).alias("support")).limit(0)
    model = FPGrowth(itemsCol="items", minSupport=least / n_items, minConfidence=min_confidence).fit(baskets)
    found = model.associationRules.where(F.array_contains("consequent", BAD)).select(F.array_sort("antecedent").alias("rule"))
    found = found.select("rule", F.explode("rule").alias("rep"))
    members = groups.select("rep", "members").distinct()
    whole = found.join(members, "rep").groupBy("rule").agg(F.array_sort(F.flatten(F.collect_list("members"))).alias("tokens"))
    rules = pin(whole.select("tokens").distinct())
    checked = _counted(rules, known, _held_out(F.col("doc_id"))).where(F.col("pages") > 0).where(F.col("bad") >= min_confidence * F.col("pages"))
    sure = _counted(pin(checked.select("tokens")), known, F.lit(True)).where(F.col("bad") >= F.greatest(F.lit(min_pages), F.lit(min_support * n_all)))
    found = pin(
        sure.where(F.col("bad") >= min_confidence * F.col("pages")).select(
            "tokens", (F.col("bad") / F.col("pages")).alias("confidence"), (F.col("bad") / F.lit(n_all)).alias("support")
        )
    )
    # A rule with a shorter rule inside it that is at least as sure says nothing new.
    one = found.select(F.explode("tokens").alias("token"), F.col("tokens").alias("small"), F.col("confidence").alias("c"))
    weaker = (
        found.withColumn("token", F.explode("tokens"))
        .join(one, "token")
        .where(
            (F.size("small") < F.size("tokens"))
            & (F.size(F.array_except("small", "tokens")) == 0)
            & (F.col("c") >= F.col("confidence"))
        )
        .select("tokens")
        .distinct()
    )
    return found.join(weaker, "tokens", "left_anti")


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, **settings) -> DataFrame:
    """(page_id, host, path, rule, verdict, evidence) for every page.

    verdict is that of the longest explicit rule, else block where a mined rule matches, else allow; evidence is the
    surest mined rule's tokens. Null urls and such without :// are allowed. Repeated rows give repeated results. Without
    labels nothing is mined.
    """
    parts = with_parts(pages)
    mined = mine_rules(parts, labels, **settings).persist()
    n = mined.limit(MAX_BROADCAST_RULES + 1).count()
    decided = parts.withColumn("given", explicit_rule(rules))
    if n == 0:
        hit = decided.withColumn("evidence", F.lit(None).cast("array<string>"))
    else:
        df = parts.select(F.explode("tokens").alias("token")).groupBy("token").count()
        rarest = (
            mined.withColumn("token", F.explode("tokens"))
            .join(df, "token")
            .groupBy("tokens", "confidence")
            .agg(F.min_by("token", F.struct("count", "token")).alias("token"))
        )
        lists = rarest.groupBy("token").agg(F.collect_list(F.struct(F.col("confidence").alias("sure"), "tokens")).alias("rules"))
        # One row a url: its rules are gathered from the lists of all its tokens.
        keyed = decided.select("url", "tokens").where(F.size("tokens") > 0).dropDuplicates(["url"])
        looked = keyed.withColumn("token", F.explode("tokens")).join(
            F.broadcast(lists) if n <= MAX_BROADCAST_RULES else lists, "token"
        )
        fits = F.filter("rules", lambda r: F.size(F.array_except(r["tokens"], F.col("tokens"))) == 0)
        best = (
            looked.select(F.col("url").alias("u"), F.array_max(fits).alias("best"))
            .where("best is not null")
            .groupBy("u")
            .agg(F.max("best").alias("best"))
        )
        hit = decided.join(best, F.col("url") == F.col("u"), "left").withColumn("evidence", F.col("best.tokens"))
    verdict = F.coalesce(F.col("given.verdict"), F.when(F.col("evidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return hit.select("page_id", "host", "path", F.col("given.rule").alias("rule"), verdict.alias("verdict"), "evidence")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
