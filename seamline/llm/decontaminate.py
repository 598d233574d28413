"""Benchmark decontamination by a distributed positional inverted index.

The index is split by document and stored: for a block of the test set, a table holds the postings of every training
text (its test terms, how often each occurs, and the positions by term), written to the shared folder. A task reads the
postings of a block of documents and answers all test windows on it, so no posting is shuffled and no term or document
can make one task large. A window's postings are taken from the rarest of its terms on; each list is shifted by the
term's offset and intersected with what is left. Proximity matches allow other words between, in the same order.

The test set goes to the tasks in blocks of bounded size. One block is held by the driver at a time: its matches are
written before the next one is read, and they are merged by row in the end.

A null or empty text has no words. Items of equal id count once, an item without words matches nothing, a null item_id
is reported as an empty string. An empty test set leaves every row without spans; an empty table gives an empty result.
Repeated rows get equal results; very long texts are one row of the index; columns of docs named like a result are
replaced by it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, UPPER, chunks, map_rows, table, written

WINDOW = 10
BLOCK_WORDS = 1_000_000
BENCHMARK_BLOCK_BYTES = 16 << 20
PIECE_BYTES = 16 << 20

_KEEP = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of digits, ASCII letters and non-ASCII characters."""
    return text.translate(_KEEP).split() if text else []


class Windows:
    """The test windows of a block of items: distinct word sequences, each with its items."""

    def __init__(self, items: list[tuple[object, bytes | None]], window: int = WINDOW):
        self.vocab: dict[bytes, int] = {}
        of: dict[tuple[int, ...], set] = {}
        for item, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab)) for w in words(text)]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                of.setdefault(tuple(ids[i : i + window]), set()).add(item)
        self.grams = list(of)
        self.items = list(of.values())
        self.by_length = {}
        for k in sorted({len(g) for g in self.grams}):
            at = [i for i, g in enumerate(self.grams) if len(g) == k]
            self.by_length[k] = (np.array(at), np.array([self.grams[i] for i in at], dtype=np.int64))


def postings_of(text: bytes | None, vocab: dict[bytes, int]) -> tuple[int, bytes, bytes, bytes]:
    """Words of a text, and its postings: sorted test terms, how often each occurs, and positions by term."""
    split = words(text)
    get = vocab.get
    ids = np.fromiter((get(w, -1) for w in split), dtype=np.int32, count=len(split))
    at = np.flatnonzero(ids >= 0)
    at = at[np.argsort(ids[at], kind="stable")]
    terms, counts = np.unique(ids[at], return_counts=True)
    return len(split), terms.astype("<i4").tobytes(), counts.astype("<i4").tobytes(), at.astype("<i4").tobytes()


class Postings:
    """Positional postings of one block of documents. A gap after each keeps windows within it."""

    def __init__(self, n_words: list[int], terms: list[bytes], counts: list[bytes], positions: list[bytes], n_terms: int):
        sizes = np.array(n_words, dtype=np.int64) + 1
        self.starts = np.cumsum(sizes) - sizes
        self.size = int(sizes.sum())
        join = lambda parts: np.frombuffer(b"".join(parts), "<i4").astype(np.int64)
        term = np.repeat(join(terms), join(counts))
        pos = join(positions) + np.repeat(self.starts, [len(p) // 4 for p in positions])
        self.counts = np.bincount(term, minlength=n_terms)
        # Documents come in order, so positions stay sorted within a term.
        self.positions = pos[np.argsort(term, kind="stable")]
        self.bounds = np.concatenate([[0], np.cumsum(self.counts)])

    def of(self, term: int) -> np.ndarray:
        return self.positions[self.bounds[term] : self.bounds[term + 1]]

    def phrase(self, gram: tuple[int, ...]) -> np.ndarray:
        """Start positions of the exact sequence, rarest terms first."""
        order = sorted(range(len(gram)), key=lambda k: self.counts[gram[k]])
        at = self.of(gram[order[0]]) - order[0]
        for k in order[1:]:
            if not len(at):
                break
            p, want = self.of(gram[k]), at + k
            i = np.searchsorted(p, want)
            i[i == len(p)] = 0
            at = at[p[i] == want]
        return at

    def near(self, gram: tuple[int, ...], slop: int) -> tuple[np.ndarray, np.ndarray]:
        """Start and end (exclusive) of the tightest spans with all terms in order and at most ``slop`` other words."""
        rare = min(range(len(gram)), key=lambda k: self.counts[gram[k]])
        first = last = self.of(gram[rare])
        ok = np.ones(len(first), dtype=bool)
        for k in range(rare + 1, len(gram)):
            p = self.of(gram[k])
            i = np.searchsorted(p, last, side="right")
            ok &= i < len(p)
            last = p[np.minimum(i, len(p) - 1)]
        for k in range(rare - 1, -1, -1):
            p = self.of(gram[k])
            i = np.searchsorted(p, first, side="left") - 1
            ok &= i >= 0
            first = p[np.maximum(i, 0)]
        same = np.searchsorted(self.starts, first, side="right") == np.searchsorted(self.starts, last, side="right")
        ok &= same & (last - first + 1 <= len(gram) + slop)
        return first[ok], last[ok] + 1

    def search(self, w: Windows, slop: int = 0):
        """(window, starts, ends) for every window with a match."""
        for _, (at, grams) in w.by_length.items():
            for i in at[(self.counts[grams] > 0).all(axis=1)]:
                gram = w.grams[i]
                if slop:
                    s, e = self.near(gram, slop)
                else:
                    s = self.phrase(gram)
                    e = s + len(gram)
                if len(s):
                    yield i, s, e


def _block(index: Postings, w: Windows, slop: int):
    """For each document: hit spans [start, end) and the items found."""
    edge = np.zeros(index.size + 1, dtype=np.int32)
    items: list[set] = [set() for _ in index.starts]
    for i, s, e in index.search(w, slop):
        np.add.at(edge, s, 1)
        np.add.at(edge, e, -1)
        for d in np.unique(np.searchsorted(index.starts, s, side="right") - 1):
            items[d] |= w.items[i]
    hit = np.cumsum(edge[:-1]) > 0
    turn = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    begin, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    spans: list[list[tuple[int, int]]] = [[] for _ in index.starts]
    for d, a, b in zip(np.searchsorted(index.starts, begin, side="right") - 1, begin, end, strict=True):
        spans[d].append((int(a - index.starts[d]), int(b - index.starts[d])))
    return spans, items


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def benchmark_blocks(benchmark: DataFrame, item: str, text: str, most: int):
    """How many blocks of about ``most`` bytes the test set has, and a function that collects one of them."""
    items = benchmark.select(F.col(item).alias("item"), F.col(text).cast("binary").alias("text"))
    total = items.agg(F.sum(F.coalesce(F.length("text"), F.lit(0)) + 64)).first()[0] or 0
    n = int(total // most) + 1

    def block(b: int) -> list[tuple[str, bytes | None]]:
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b)
        return [("" if r.item is None else str(r.item), bytes(r.text) if r.text is not None else None) for r in part.collect()]

    return n, block


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
ITEMS = T.ArrayType(T.StringType())


def _as_spans(spans: list[tuple[int, int]]) -> list[dict]:
    return [{"start": a, "end": b} for a, b in spans]


def store_postings(docs: DataFrame, vocab: dict[bytes, int], text: str, keep: list[str]) -> tuple[DataFrame, list[str]]:
    """The postings of every text as a written table with the columns ``keep``, and the names of its own columns."""
    mark = ""
    while {f"{c}{mark}" for c in ("words", "terms", "counts", "positions")} & set(keep):
        mark += "_"
    names = [f"{c}{mark}" for c in ("words", "terms", "counts", "positions")]

    def start():
        def f(text):
            return dict(zip(names, map(list, zip(*(postings_of(t, vocab) for t in text), strict=True)), strict=True))

        return f

    kinds = dict(zip(names, [T.LongType(), T.BinaryType(), T.BinaryType(), T.BinaryType()], strict=True))
    return written(map_rows(docs, {"text": text}, kinds, start, keep, as_bytes=True)), names


def search_postings(index: DataFrame, names: list[str], w: Windows, slop: int, keep: list[str]) -> DataFrame:
    """``keep`` of the stored rows with n_words, spans and items."""
    out = {"n_words": T.LongType(), "spans": SPANS, "items": ITEMS}

    def start():
        def f(words, terms, counts, positions):
            got = {k: [] for k in out} | {"n_words": words}
            for i, j in chunks(words, BLOCK_WORDS):
                block = Postings(words[i:j], terms[i:j], counts[i:j], positions[i:j], len(w.vocab))
                spans, items = _block(block, w, slop)
                got["spans"] += map(_as_spans, spans)
                got["items"] += map(sorted, items)
            return got

        return f

    args = dict(zip(("words", "terms", "counts", "positions"), map(F.col, names), strict=True))
    return map_rows(index, args, out, start, keep, piece_bytes=PIECE_BYTES)


def find_items(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    window: int = WINDOW,
    slop: int = 0,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    block_bytes: int = BENCHMARK_BLOCK_BYTES,
    keep: list[str] | None = None,
) -> DataFrame:
    """``docs`` (or ``keep`` of it) with n_words, spans (word ranges inside a window, merged) and items (sorted as strings).

    ``slop`` 0 finds exact phrases, more also windows whose words stand in order with up to so many others between.    """
    own = ["n_words", "spans", "items"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in own]
    n, block = benchmark_blocks(benchmark, item, item_text, block_bytes)
    if n == 1:
        w = Windows(block(0), window)
        index, names = store_postings(docs, w.vocab, text, keep)
        return search_postings(index, names, w, slop, keep)
    row = "row"
    while row in docs.columns:
        row += "_"
    base = written(docs.withColumn(row, F.monotonically_increasing_id()))
    found = None
    for b in range(n):
        w = Windows(block(b), window)
        index, names = store_postings(base, w.vocab, text, [row])
        part = search_postings(index, names, w, slop, [row])
        # A text's words are counted by every block; its matches come from those that have any.
        part = written(part if b == 0 else part.where(F.size("items") > 0))
        found = part if found is None else found.unionByName(part)
        del w

    def start():
        return lambda spans: {"spans": [_as_spans(_merged([(x["start"], x["end"]) for x in s])) for s in spans]}

    items = F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    rows = found.groupBy(row).agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), items)
    merged = map_rows(rows, {"spans": F.col("spans")}, {"spans": SPANS}, start)
    return base.select(*keep, row).join(merged, row).select(*keep, *own)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The text is not kept beside its postings.
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_items(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + (x["end"] - x["start"]))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


OP2_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
                  '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
             '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS k,
               array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' ') AS g
        FROM b, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS t(i) WHERE len(w) > 0),
gram AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
         FROM d, (SELECT DISTINCT k FROM win), unnest(range(1, len(w) - k + 2)) AS t(i)),
hit AS (SELECT doc_id, i, gram.k, item_id FROM gram JOIN win ON gram.k = win.k AND gram.g = win.g),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + k)) AS t(p) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s
        FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(its.s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

