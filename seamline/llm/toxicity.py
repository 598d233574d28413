"""Toxicity by the nearest labelled examples: exact TF-IDF cosine with a block-max inverted index.

The terms of a text are all its words and the first three and four letters of longer ones; none is chosen or left out.
At most ``max_examples`` labelled documents, half of each label where there are as many, are the examples, unit vectors of (1 + ln tf) idf, with
document frequencies counted over all documents. Alike examples share a block. For every term the index holds the
largest weight in each block, and its postings grouped by block. A query's upper bounds by block are summed first; the
two best blocks give the k-th cosine to beat, and only blocks whose bound reaches it are opened, so the neighbours are
exact. Terms that many examples have are kept as full rows in place of postings, which changes no result. Neighbours
vote by cosine over distance; the vote is made a probability by isotonic regression on the examples' own votes, each left out in turn
and weighted for the rows that its label has in all. Of a few numbers of neighbours, up to half
of the examples of the rarer label, that one is taken whose probabilities are best on examples that the regression has
not seen.

A null or empty text, and one that shares no term with any example, gets the rate of label 1. Very long texts are read
whole. Repeated rows get equal scores; extra columns pass through, and one named score or evidence is replaced. An
empty table gives an empty result. Without examples of both labels every score is the rate of label 1, 0 without labels.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_rows, one_thread, pieces, release, table, written

WORD = re.compile(r"[^\W\d_]+")
MAX_EXAMPLES = 3_000
BEGINNINGS = (3, 4)
#: Numbers of neighbours to choose from.
NEIGHBOURS = (9, 15, 31, 63)
EVIDENCE = 5
#: Added to a distance before it divides.
NEAREST = 0.05
BLOCK = 64
FULL_ROW_SHARE = 1 / 20
THRESHOLD = 0.3
BATCH = 32
#: Words whose terms a task remembers; beyond it the memory is emptied, which changes no result.
WORDS_KNOWN = 300_000


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def features(word: str) -> list[str]:
    """The word and its beginnings, which a star marks."""
    return [word, *(word[:k] + "*" for k in BEGINNINGS if k < len(word))]


class Words(dict):
    """Numbers of the words met so far, and the known terms of each as ranges of one list."""

    def __init__(self, known: dict[str, int]):
        self.known, self.terms, self.ends = known, array("q"), array("q", [0])

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        get, terms = self.known.get, self.terms
        i = get(word)
        if i is not None:
            terms.append(i)
        for k in BEGINNINGS:
            if k < len(word):
                i = get(word[:k] + "*")
                if i is not None:
                    terms.append(i)
        self.ends.append(len(terms))
        return n


class Terms:
    """Counts of known terms in texts."""

    def __init__(self, known: dict[str, int]):
        self.known, self.words = known, Words(known)

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, count), sorted by text and term."""
        if len(self.words) > WORDS_KNOWN:
            self.words = Words(self.known)
        bags = [Counter(words(t)) for t in texts]
        number = self.words.__getitem__
        word = np.fromiter(chain.from_iterable(map(number, b) for b in bags), dtype=np.int64)
        n = np.fromiter(chain.from_iterable(b.values() for b in bags), dtype=np.int64, count=len(word))
        text = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
        ends = np.frombuffer(self.words.ends, dtype=np.int64)
        at, of = spread(ends[word], ends[word + 1])
        del ends
        terms = np.frombuffer(self.words.terms, dtype=np.int64)[at] if len(at) else at
        key = terms + (text[of] << 40)
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        total = np.add.reduceat(n[of][order], first) if len(first) else first
        key = key[first]
        return key >> 40, key & ((1 << 40) - 1), total


def unit_vectors(text: np.ndarray, term: np.ndarray, tf: np.ndarray, idf: np.ndarray, n: int) -> np.ndarray:
    """Weights (1 + ln tf) idf, of length 1 for each of the n texts."""
    w = (1 + np.log(tf)) * idf[term]
    return w / np.sqrt(np.bincount(text, w * w, n))[text]


@dataclass
class Queries:
    """n unit vectors as (query, term, weight), sorted by query and term."""

    n: int
    q: np.ndarray
    t: np.ndarray
    w: np.ndarray


@dataclass
class Model:
    """Terms with idf; postings of the examples by term (starts, rows, weights), rows in the order of blocks."""

    terms: dict[str, int]
    idf: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    starts: np.ndarray
    rows: np.ndarray
    weights: np.ndarray
    prior: float
    votes: np.ndarray = field(default_factory=lambda: np.zeros(0))
    rates: np.ndarray = field(default_factory=lambda: np.zeros(0))
    k: int = NEIGHBOURS[0]

    def calibrated(self, vote: float) -> float:
        return float(np.interp(vote, self.votes, self.rates)) if len(self.votes) else vote


def spread(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges [start, end) in turn, and the range that each comes from."""
    n = ends - starts
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(len(of)) + (starts - np.cumsum(n) + n)[of], of


class Index:
    """Block-max inverted index of a model's examples."""

    def __init__(self, m: Model, block: int = BLOCK, full: float = FULL_ROW_SHARE):
        self.m, self.block, self.n = m, block, len(m.ids)
        self.blocks = b = max(1, -(-self.n // block))
        often = np.flatnonzero(np.diff(m.starts) > full * self.n)
        self.place = np.full(len(m.idf), -1)
        self.place[often] = np.arange(len(often))
        self.full = np.zeros((b, len(often), block))
        at, of = spread(m.starts[often], m.starts[often + 1])
        self.full[m.rows[at] // block, of, m.rows[at] % block] = m.weights[at]
        # Rounded up, so that a bound is never below what it bounds.
        self.full_max = np.ascontiguousarray(self.full.max(2).T) * (1 + 1e-12)
        # Other terms: groups of postings by term and block, each with its largest weight.
        term = np.repeat(np.arange(len(m.idf)), np.diff(m.starts))
        key = term * b + m.rows // block
        first = np.flatnonzero(np.diff(key, prepend=-1))
        self.group_block = m.rows[first] // block
        self.group_max = np.maximum.reduceat(m.weights, first) * (1 + 1e-12) if len(first) else np.zeros(0)
        self.group_at = np.append(first, len(key))
        self.group_of = np.searchsorted(key[first], np.arange(len(m.idf) + 1) * b)
        #: Pairs of a query and a block, and how many of them were opened.
        self.pairs = self.opened = 0

    def nearest(self, queries: Queries, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query, cosines and rows of the k nearest with a cosine above 0, nearest first, ties by id."""
        nq, b = queries.n, self.blocks
        q, t, w = queries.q, queries.t, queries.w
        dense = np.zeros((nq, len(self.full_max)))
        often = self.place[t] >= 0
        dense[q[often], self.place[t[often]]] = w[often]
        q, t, w = q[~often], t[~often], w[~often]
        group, of = spread(self.group_of[t], self.group_of[t + 1])
        q, w, in_block = q[of], w[of], self.group_block[group]
        bound = dense @ self.full_max
        bound += np.bincount(q * b + in_block, w * self.group_max[group], nq * b).reshape(nq, b)
        bound *= 1 + 1e-9
        score = np.zeros((nq, b * self.block))

        def take(pairs: np.ndarray) -> None:
            mine = pairs[q, in_block]
            at, of = spread(self.group_at[group[mine]], self.group_at[group[mine] + 1])
            cell = q[mine][of] * score.shape[1] + self.m.rows[at]
            score.ravel()[:] += np.bincount(cell, w[mine][of] * self.m.weights[at], score.size)
            for x in np.flatnonzero(pairs.any(0)):
                who = np.flatnonzero(pairs[:, x])
                score[who, x * self.block : (x + 1) * self.block] += dense[who] @ self.full[x]
            self.opened += int(pairs.sum())

        two = np.zeros((nq, b), dtype=bool)
        two[np.arange(nq)[:, None], np.argsort(-bound, axis=1, kind="stable")[:, :2]] = True
        two &= bound > 0
        take(two)
        least = np.maximum(np.partition(score, -k, axis=1)[:, -k] - 1e-9, 0) if k < score.shape[1] else np.zeros(nq)
        take((bound > 0) & (bound >= least[:, None]) & ~two)
        self.pairs += nq * b
        score = score[:, : self.n]
        least = np.maximum(np.partition(score, -k, axis=1)[:, -k] - 1e-9, 0) if k < self.n else np.zeros(nq)
        out = []
        for s, cut in zip(score, least, strict=True):
            rows = np.flatnonzero((s > 0) & (s >= cut))
            c = np.round(s[rows], 12)
            best = np.lexsort((self.m.ids[rows], -c))[:k]
            out.append((c[best], rows[best]))
        return out


def vote(cosines: np.ndarray, labels: np.ndarray) -> float:
    """Share of label 1 among the neighbours, weighted by cosine over distance, so that a copy decides."""
    w = cosines / (1 - cosines + NEAREST)
    return float(w @ labels / w.sum())


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rising function nearest to y (weighted squares), as the two ends of each of its flat parts."""
    places, of = np.unique(x, return_inverse=True)
    parts: list[tuple[float, float, float, float]] = []
    for at, sy, sw in zip(places, np.bincount(of, w * y), np.bincount(of, w), strict=True):
        lo = hi = at
        while parts and parts[-1][2] * sw >= sy * parts[-1][3]:
            before = parts.pop()
            lo, sy, sw = before[0], sy + before[2], sw + before[3]
        parts.append((lo, hi, sy, sw))
    ends = np.array([(lo, hi) for lo, hi, _, _ in parts]).ravel()
    return ends, np.repeat([sy / sw for _, _, sy, sw in parts], 2)


def _in_blocks(dense: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """An order of the rows in which alike ones stand together: halves by the first principal component, again and again."""
    out, todo = [], [np.arange(len(dense))]
    while todo:
        rows = todo.pop()
        if len(rows) <= block:
            out.append(rows)
            continue
        x = dense[rows] - dense[rows].mean(0)
        v = np.random.RandomState(len(rows)).normal(size=x.shape[1])
        for _ in range(8):
            v = x.T @ (x @ v)
            v /= np.linalg.norm(v) or 1.0
        order = rows[np.argsort(x @ v, kind="stable")]
        half = block * max(1, round(len(rows) / block / 2))
        todo += [order[half:], order[:half]]
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


def learnable(doc_id: Column) -> Column:
    """Rows that may be learnt from: crc32 of the id as text, modulo 4, is not 2."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2


@dataclass
class Examples:
    """The labelled examples: rate of label 1, ids, labels, (row, term, count), the terms, and the labelled rows that an
    example of each label stands for. Without terms nothing can be learnt."""

    prior: float
    ids: np.ndarray | None = None
    label: np.ndarray | None = None
    row: np.ndarray | None = None
    term: np.ndarray | None = None
    tf: np.ndarray | None = None
    terms: dict[str, int] = field(default_factory=dict)
    weight: dict[int, float] | None = None


def examples(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES) -> Examples:
    """At most ``max_examples`` labelled rows, chosen by a hash of the id: half of them of each label, or more of one
    where the other has fewer.

    Labels of repeated ids: toxic if any is. Where ``docs`` repeats an id, the row with the least hash of its text is
    the example. Rows without id or label teach nothing.
    """
    given = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .where(learnable(F.col("doc_id")))
        .groupBy(F.col("doc_id").alias("l_id"))
        .agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    )
    total = {r.toxic: r.n for r in given.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    prior = total.get(1, 0) / max(1, sum(total.values()))
    up = min(total.get(1, 0), max(max_examples // 2, max_examples - total.get(0, 0)))
    # At most max_examples ids, so they may be broadcast.
    some = [given.where(F.col("toxic") == y).orderBy(F.xxhash64("l_id"), "l_id").limit(n) for y, n in ((0, max_examples - up), (1, up))]
    sample = docs.select("doc_id", "text").join(F.broadcast(some[0].union(some[1])), F.col("doc_id") == F.col("l_id"))

    def start():
        def f(text):
            bags = []
            for t in text:
                bag: Counter = Counter()
                for w, c in Counter(words(t)).items():
                    for x in features(w):
                        bag[x] += c
                bags.append(bag)
            return {"terms": [list(g) for g in bags], "tfs": [list(g.values()) for g in bags]}

        return f

    kinds = {"terms": T.ArrayType(T.StringType()), "tfs": T.ArrayType(T.IntegerType())}
    args = {"text": F.col("text")}
    got = map_rows(sample.withColumn("h", F.xxhash64("text")), args, kinds, start, ["doc_id", "toxic", "h"]).toArrow()
    order = np.lexsort((got["h"].to_numpy(), got["doc_id"].to_numpy()))
    _, first = np.unique(got["doc_id"].to_numpy()[order], return_index=True)
    got = got.take(order[first]).combine_chunks()
    ids, label = got["doc_id"].to_numpy().astype(np.int64), got["toxic"].to_numpy().astype(np.float64)
    if not 0 < label.sum() < len(label):
        return Examples(prior)
    lists = got["terms"].combine_chunks()
    coded = lists.flatten().dictionary_encode()
    term, tf = coded.indices.to_numpy().copy(), got["tfs"].combine_chunks().flatten().to_numpy().copy()
    row = np.repeat(np.arange(len(ids), dtype=np.int32), np.diff(lists.offsets.to_numpy()))
    terms = {t: i for i, t in enumerate(coded.dictionary.to_pylist())}
    del got, lists, coded
    pa.default_memory_pool().release_unused()
    weight = {y: total.get(y, 0) / max(1, int((label == y).sum())) for y in (0, 1)}
    return Examples(prior, ids, label, row, term, tf, terms, weight)


def _terms_of(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, term) of encoded texts."""
    d = np.frombuffer(b"".join(parts), "<i4").astype(np.int64)
    sizes = np.array([len(x) // 4 for x in parts], dtype=np.int64)
    text = np.repeat(np.arange(len(parts)), sizes)
    total = np.cumsum(d)
    before = np.concatenate([[0], total])[np.cumsum(sizes) - sizes]
    return text, total - before[text]


def encoded(docs: DataFrame, terms: dict[str, int], keep: list[str]) -> tuple[DataFrame, tuple[str, str]]:
    """``keep`` of docs with two columns under free names: numbers of the known terms of each text, and their counts."""
    at = ("terms", "counts")
    while set(at) & set(keep):
        at = (at[0] + "_", at[1] + "_")

    def start():
        count = Terms(terms)

        def f(text):
            ids, counts = [], []
            for i in range(0, len(text), BATCH):
                part = text[i : i + BATCH]
                q, t, tf = count(part)
                ends = np.searchsorted(q, np.arange(len(part) + 1)).tolist()
                first = np.flatnonzero(np.diff(q, prepend=-1))
                # Differences from term to term are small numbers, which compress well.
                step, tf = np.diff(t, prepend=0).astype("<i4"), tf.astype("<i4")
                step[first] = t[first]
                ids += [step[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)]
                counts += [tf[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)]
            return {at[0]: ids, at[1]: counts}

        return f

    kinds = {at[0]: T.BinaryType(), at[1]: T.BinaryType()}
    return map_rows(docs, {"text": "text"}, kinds, start, keep), at


def finish(spark: SparkSession, e: Examples, frequencies: Callable[[], tuple[np.ndarray, int]], neighbours: tuple[int, ...] = NEIGHBOURS) -> Model:
    """The model of the examples; ``frequencies`` counts its terms in all rows."""
    if not e.terms:
        return Model({}, np.zeros(0), np.zeros(0, np.int64), np.zeros(0), np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0), e.prior)
    ids, label, row, term, terms = e.ids, e.label, e.row, e.term, e.terms
    df, n = frequencies()
    idf = np.log((n + 1) / (df + 1)) + 1
    w = unit_vectors(row, term, e.tf, idf, len(ids))
    often = np.bincount(term, minlength=len(terms)) > FULL_ROW_SHARE * len(ids)
    dense = np.zeros((len(ids), int(often.sum())))
    mine = often[term]
    dense[row[mine], (np.cumsum(often) - 1)[term[mine]]] = w[mine]
    order = _in_blocks(dense)
    del dense
    row = np.argsort(order).astype(np.int32)[row]
    by = np.lexsort((row, term))
    starts = np.searchsorted(term[by], np.arange(len(terms) + 1))
    m = Model(terms, idf, ids[order], label[order], starts, row[by], w[by], e.prior)
    del term, row, w, by
    calibrate(m, votes(spark, m, neighbours), e.weight)
    return m


def fit(
    docs: DataFrame, labels: DataFrame, *, max_examples: int = MAX_EXAMPLES, neighbours: tuple[int, ...] = NEIGHBOURS
) -> Model:
    """Learn from docs (doc_id, text) and labels (doc_id, toxic)."""
    e = examples(docs, labels, max_examples)
    terms = e.terms

    def terms_of():
        count = Terms(terms)
        return lambda texts: count(texts)[1]

    return finish(docs.sparkSession, e, lambda: document_frequencies(docs.select("text"), terms_of, len(terms)), neighbours)


def votes(spark: SparkSession, m: Model, neighbours: tuple[int, ...]) -> dict[int, np.ndarray]:
    """For each number of neighbours, the votes on the examples by the others (not a number: no neighbours). At most
    half of the examples of the rarer label are asked, but for the least number."""
    rarer = min((m.labels == 1).sum(), (m.labels == 0).sum())
    ks = [k for k in sorted(neighbours) if 2 * k <= rarer or k == min(neighbours)]

    def run(batches):
        one_thread()
        index = Index(m)
        row = np.argsort(m.rows, kind="stable")
        term = np.repeat(np.arange(len(m.idf)), np.diff(m.starts))[row]
        bounds = np.searchsorted(m.rows[row], np.arange(len(m.ids) + 1))
        for b in batches:
            for first in b.column(0).to_pylist():
                mine = np.arange(first, min(first + BATCH, len(m.ids)))
                at, q = spread(bounds[mine], bounds[mine + 1])
                found = index.nearest(Queries(len(mine), q, term[at], m.weights[row[at]]), ks[-1] + 1)
                near = [(c[j != i], m.labels[j[j != i]]) for i, (c, j) in zip(mine.tolist(), found, strict=True)]
                got = [pa.array([vote(c[:k], y[:k]) if len(c) else math.nan for c, y in near]) for k in ks]
                yield pa.RecordBatch.from_arrays([pa.array(mine), *got], names=["row", *(f"v{k}" for k in ks)])

    kind = T.StructType([T.StructField("row", T.LongType()), *(T.StructField(f"v{k}", T.DoubleType()) for k in ks)])
    got = spark.range(0, len(m.ids), BATCH).repartition("id").mapInArrow(run, kind).toArrow().sort_by("row")
    return {k: got[f"v{k}"].to_numpy() for k in ks}


def calibrate(m: Model, found: dict[int, np.ndarray], weight: dict[int, float]) -> None:
    """Sets the number of neighbours and the rates of label 1 that votes stand for."""
    have = ~np.isnan(next(iter(found.values())))
    if not have.any():
        return
    y = m.labels[have]
    w = np.where(y == 1, weight[1], weight[0])
    odd = np.argsort(np.argsort(m.ids[have])) % 2 == 1
    best = math.inf
    for k, x in found.items():
        x, loss = x[have], 0.0
        for part in (odd, ~odd):
            if part.any() and not part.all():
                guess = np.interp(x[~part], *isotonic(x[part], y[part], w[part]))
                loss += float((w[~part] * (guess - y[~part]) ** 2).sum())
        if loss < best:
            best, m.k = loss, k
            m.votes, m.rates = isotonic(x, y, w)


def document_frequencies(rows: DataFrame, terms_of: Callable[[], Callable[[list], np.ndarray]], n_terms: int) -> tuple[np.ndarray, int]:
    """In how many rows each of the terms occurs, and how many rows there are; a row for each term and task is summed.

    ``rows`` have one column; ``terms_of()`` makes a function of a list of it that gives the terms of each, in any order.
    """
    kind = T.StructType([T.StructField("term", T.IntegerType()), T.StructField("n", T.LongType())])

    def run(batches):
        seen, n, terms = np.zeros(n_terms, dtype=np.int64), 0, terms_of()
        for b in pieces(batches):
            for at in range(0, b.num_rows, BATCH):
                seen += np.bincount(terms(b.column(0).slice(at, BATCH).to_pylist()), minlength=n_terms)
            n += b.num_rows
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict(
            {"term": pa.array([-1, *some.tolist()], pa.int32()), "n": pa.array([n, *seen[some].tolist()], pa.int64())}
        )
        del terms
        release()

    got = rows.mapInArrow(run, kind).groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = got["term"].to_numpy(), got["n"].to_numpy()
    out = np.zeros(n_terms)
    out[term[term >= 0]] = n[term >= 0]
    return out, int(n[term < 0].sum())


def _judged(model: Model, evidence: int) -> Callable[[Queries], tuple[list, list]]:
    """A function of queries that gives scores and the nearest examples."""
    one_thread()
    index = Index(model)

    def f(queries: Queries) -> tuple[list, list]:
        scores, shown = [], []
        for c, j in index.nearest(queries, model.k):
            scores.append(model.calibrated(vote(c, model.labels[j])) if len(c) else model.prior)
            best = zip(model.ids[j[:evidence]].tolist(), c[:evidence].tolist(), model.labels[j[:evidence]].tolist(), strict=True)
            shown.append([{"doc_id": i, "cosine": x, "label": int(y)} for i, x, y in best])
        return scores, shown

    return f


def _scored(rows: DataFrame, args: dict, queries_of: Callable, model: Model, evidence: int, keep: list[str]) -> DataFrame:
    near = T.StructType(
        [T.StructField("doc_id", T.LongType()), T.StructField("cosine", T.DoubleType()), T.StructField("label", T.IntegerType())]
    )
    bare = replace(model, terms={})

    def start():
        judge, queries = _judged(bare, evidence), queries_of()

        def f(**given):
            n = len(next(iter(given.values())))
            out = {"score": [], "evidence": []}
            for i in range(0, n, BATCH):
                scores, shown = judge(queries(**{k: v[i : i + BATCH] for k, v in given.items()}))
                out["score"] += scores
                out["evidence"] += shown
            return out

        return f

    return map_rows(rows, args, {"score": T.DoubleType(), "evidence": T.ArrayType(near)}, start, keep)


def score(docs: DataFrame, model: Model, *, evidence: int = EVIDENCE, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with score (0 to 1) and evidence, the ``evidence`` nearest examples (doc_id, cosine, label)."""
    terms, idf = model.terms, model.idf

    def queries_of():
        count = Terms(terms)

        def f(text):
            q, t, tf = count(text)
            return Queries(len(text), q, t, unit_vectors(q, t, tf, idf, len(text)))

        return f

    return _scored(docs, {"text": "text"}, queries_of, model, evidence, docs.columns if keep is None else keep)


def learn_and_score(docs: DataFrame, labels: DataFrame, *, evidence: int = EVIDENCE, keep: list[str] | None = None) -> DataFrame:
    """As ``score`` with a model of these rows and labels. Texts are cut into terms once, for frequencies and search: a
    table of the terms is written, beside the columns ``keep``."""
    keep = docs.columns if keep is None else keep
    e = examples(docs, labels)
    rows, at = encoded(docs, e.terms, keep)
    rows = written(rows)
    n = len(e.terms)
    model = finish(docs.sparkSession, e, lambda: document_frequencies(rows.select(at[0]), lambda: lambda parts: _terms_of(parts)[1], n))
    idf = model.idf

    def queries_of():
        def f(terms, counts):
            q, t = _terms_of(terms)
            return Queries(len(terms), q, t, unit_vectors(q, t, np.frombuffer(b"".join(counts), "<i4"), idf, len(terms)))

        return f

    return _scored(rows, {"terms": F.col(at[0]), "counts": F.col(at[1])}, queries_of, model, evidence, keep)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return learn_and_score(docs, table(spark, sf_dir, "labels"), keep=["doc_id"]).select(
        "doc_id",
        (~learnable(F.col("doc_id"))).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        "evidence",
    )
