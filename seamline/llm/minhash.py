"""Near duplicates by b-bit MinHash.

Each document's distinct word shingles give 200 minima. Bands of five minima propose candidates; of every minimum two
low bits are kept and packed, and candidates are sieved by the similarity that equal bits suggest once chance equality
is taken out. What passes is confirmed on the full sets. Equal sets are one class from the start, so copies are never
paired. In a band's bucket every class is first compared with the least one, then those left over with the most alike of
some pivots. Only classes that are still in different components are then compared with each other; in large buckets
this is done in square blocks of bounded size, on the sets themselves, and a block gives no more links than join its
components. So no link is lost to a cap, and none is made by a group's square. Components are found by alternating star
contraction.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, map_rows, pin, table

SHINGLE = 5
PERCENT = 75
BANDS, ROWS = 40, 5
HASHES = BANDS * ROWS
BITS = 2
SLACK = 0.15
SMALL_BUCKET = 32
BLOCK = 1024
PIVOTS = 4
BLOCK_WORDS = 60_000
MAX_WORDS_KNOWN = 1_000_000
#: Up to so many links are joined by one task; a parameter of ``near_duplicates``.
TASK_EDGES = 500_000
#: At most so many bands count as hot, and only they are broadcast.
HOT_BANDS = 8192
FILTER_BITS = 24

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SEED = np.random.RandomState(20240229)
_A = (_SEED.randint(0, 1 << 31, HASHES, dtype=np.int64).astype(np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _SEED.randint(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
_P = np.uint64(0x9E3779B97F4A7C15)
SIG_WORDS = -(-HASHES * BITS // 64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(33))


class Shingler:
    """64-bit hashes of a text's distinct shingles, sorted."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, text: bytes | None) -> np.ndarray:
        split = text.translate(_FOLD).split() if text else []
        if not split:
            return np.zeros(0, dtype=np.uint64)
        if len(self.known) > MAX_WORDS_KNOWN:
            self.known.clear()
        known = self.known
        for w in split:
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, split), dtype=np.uint64, count=len(split))
        k = min(SHINGLE, len(h))
        out = np.full(len(h) - k + 1, k, dtype=np.uint64)
        for i in range(k):
            out = out * _P + h[i : len(h) - k + 1 + i]
        return np.unique(_mix(out))


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """HASHES x len(sets) minima of non-empty sets."""
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((HASHES, len(sets)), dtype=np.uint32)
    buf = np.empty_like(x)
    for i in range(HASHES):
        np.multiply(x, _A[i], out=buf)
        np.add(buf, _B[i], out=buf)
        out[i] = np.minimum.reduceat(buf, starts)
    return out


def signatures(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (len, BANDS) and packed low bits (len, SIG_WORDS), as signed longs."""
    n = m.shape[1]
    wide = m.astype(np.uint64)
    keys = np.empty((n, BANDS), dtype=np.uint64)
    for b in range(BANDS):
        h = np.full(n, b + 1, dtype=np.uint64)
        for r in range(ROWS):
            h = _mix(h * _P + wide[b * ROWS + r])
        keys[:, b] = h
    low = _mix(wide) & np.uint64((1 << BITS) - 1)
    packed = np.zeros((n, SIG_WORDS), dtype=np.uint64)
    for i in range(HASHES):
        packed[:, i * BITS // 64] |= low[i] << np.uint64(i * BITS % 64)
    return keys.view(np.int64), packed.view(np.int64)


def digests(items: np.ndarray) -> tuple[int, int]:
    """Two numbers that tell sets apart, as signed longs."""
    d1, d2 = np.add.reduce(items), np.add.reduce(_mix(items ^ _P))
    return int(d1.view(np.int64)), int(d2.view(np.int64))


def set_table(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, d1, d2, sig, bands); d1 and d2 tell sets apart; empty sets have null arrays."""
    out = {
        "n_shingles": T.LongType(),
        "d1": T.LongType(),
        "d2": T.LongType(),
        "sig": T.ArrayType(T.LongType()),
        "bands": T.ArrayType(T.LongType()),
    }

    def start():
        shingles = Shingler()

        def f(text):
            done: dict = {}
            order = list(dict.fromkeys(t for t in text if t))
            for i, j in chunks([len(t) // 5 for t in order], BLOCK_WORDS):
                part = [(t, s) for t in order[i:j] if len(s := shingles(t))]
                if not part:
                    continue
                keys, sig = signatures(minima([s for _, s in part]))
                for (t, s), k, g in zip(part, keys, sig, strict=True):
                    done[t] = (len(s), *digests(s), g, k)
            none = (0, 0, 0, None, None)
            got = [done.get(t, none) for t in text]
            return {name: [g[i] for g in got] for i, name in enumerate(out)}

        return f

    return map_rows(docs, {"text": "text"}, out, start, ["doc_id"], as_bytes=True)


def _differing_bits(a: str, b: str) -> Column:
    """How many of the packed minima differ."""
    low = F.lit(int.from_bytes(bytes([0x55] * 8), "big"))
    total = F.lit(0)
    for i in range(SIG_WORDS):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        total = total + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(low))
    return total


def estimate(differ):
    """Similarity from differing b-bit minima, corrected for equality by chance."""
    chance = 0.5**BITS
    return ((1 - differ / HASHES) - chance) / (1 - chance)


#: As many differing minima at most as the sieve lets pass.
MOST_DIFFER = int(HASHES * (1 - (0.5**BITS + (1 - 0.5**BITS) * (PERCENT / 100 - SLACK))))


def may_link(na: Column, nb: Column) -> Column:
    """Sizes that allow the wanted similarity."""
    return 100 * F.least(na, nb) >= PERCENT * F.greatest(na, nb)


def _filter_of(ids: DataFrame) -> np.ndarray:
    """A bit for every hash of the ids (i): 2**FILTER_BITS bits, whatever the number of ids."""
    h = F.xxhash64("i").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    words = ids.select(F.shiftright(h, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int")).alias("b"))
    got = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << FILTER_BITS - 6, dtype=np.int64)
    out[got["w"].to_numpy()] = got["b"].to_numpy()
    return out


def full_sets(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, items) with the sorted shingle hashes of the documents whose id is in ``ids`` (i).

    Texts are passed through a filter of bounded size first, so that only few others' sets are shuffled for the exact
    join. Where rows repeat an id, the set of the least digest is taken.
    """
    bits = _filter_of(ids)

    def start():
        shingles = Shingler()

        def f(text, h):
            h = np.array(h, dtype=np.int64) & ((1 << FILTER_BITS) - 1)
            may = bits[h >> 6] >> (h & 63) & 1
            sets = [shingles(t) if m else None for t, m in zip(text, may.tolist(), strict=True)]
            digest = [digests(x) if x is not None else (None, None) for x in sets]
            return {"items": [None if x is None else x.view(np.int64) for x in sets], "d1": [d for d, _ in digest], "d2": [d for _, d in digest]}

        return f

    args = {"text": "text", "h": F.xxhash64("doc_id")}
    out = {"items": T.ArrayType(T.LongType()), "d1": T.LongType(), "d2": T.LongType()}
    some = map_rows(docs, args, out, start, ["doc_id"], as_bytes=True).where("items is not null")
    kept = some.join(ids, F.col("doc_id") == F.col("i"), "left_semi")
    return kept.groupBy("doc_id").agg(F.min_by("items", F.struct("d1", "d2")).alias("items"))


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` whose full sets (doc_id, items) are similar enough."""
    a = sets.select(F.col("doc_id").alias("a"), F.col("items").alias("x"))
    b = sets.select(F.col("doc_id").alias("b"), F.col("items").alias("y"))
    both = pairs.select("a", "b").join(a, "a").join(b, "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(100 * common >= PERCENT * (F.size("x") + F.size("y") - common)).select("a", "b")


def _components_of_few(edges: DataFrame) -> DataFrame:
    """(node, component) of at most TASK_EDGES edges (a, b), by union-find in one task."""
    import pyarrow as pa

    def run(batches):
        up: dict[int, int] = {}

        def top(x):
            root = x
            while up[root] != root:
                root = up[root]
            while up[x] != root:
                up[x], x = root, up[x]
            return root

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                up.setdefault(a, a)
                up.setdefault(b, b)
                a, b = top(a), top(b)
                if a != b:
                    up[max(a, b)] = min(a, b)
        nodes = list(up)
        yield pa.RecordBatch.from_pydict(
            {"node": pa.array(nodes, pa.int64()), "component": pa.array([top(x) for x in nodes], pa.int64())}
        )

    return edges.select("a", "b").coalesce(1).mapInArrow(run, "node long, component long")


class Bands:
    """Joins on ``band`` in which no band makes one task large.

    Of all rows (band, id), hot bands hold more than one in HOT_BANDS, so there are fewer than HOT_BANDS of them: their
    few facts are broadcast, and the rows stay where they are. All other bands are shuffled as usual.
    """

    def __init__(self, sizes: DataFrame, rows: int):
        self.hot = sizes.where(F.col("n") > rows / HOT_BANDS).select(F.col("band").alias("hot"))

    def _split(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        few = F.broadcast(self.hot)
        return df.join(few, F.col("band") == F.col("hot"), "left_anti"), df.join(few, F.col("band") == F.col("hot"), "left_semi")

    def join(self, rows: DataFrame, facts: DataFrame) -> DataFrame:
        """``rows`` with the ``facts`` of their bands, one row a band."""
        rest, hot = self._split(rows)
        facts_rest, facts_hot = self._split(facts)
        return rest.join(facts_rest, "band").unionByName(hot.join(F.broadcast(facts_hot), "band"))


def components(edges: DataFrame, task_edges: int | None = None) -> DataFrame:
    """(node, component) with the least node of each connected component, for undirected edges (a, b).

    Large-star and small-star steps in turn (Kiveris et al., 2014) until nothing changes; each round is checkpointed.
    Up to ``task_edges`` edges (TASK_EDGES), counted first, are joined by one executor's task, with the same result.
    """

    def both_ways(e):
        return e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def large(e):
        n = both_ways(e)
        least = n.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        return n.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()

    def small(e):
        n = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = n.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        near = n.join(least, F.col("a") == F.col("u"))
        moved = near.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        return moved.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()

    e = pin(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if e.count() <= (TASK_EDGES if task_edges is None else task_edges):
        return _components_of_few(e)
    last = None
    while True:
        mark = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == last or mark[0] == 0:
            break
        last = mark
        e = pin(small(large(e)))
    leaves = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.union(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _blocked_links(many: DataFrame, sig: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) among the rows (band, id, comp) of large buckets that hold several components.

    Components that meet in such buckets form a cluster. Rows outside a cluster's largest component are compared with
    all of its rows, in blocks of BLOCK by BLOCK, which bounds what a task holds; as few are outside, each set moves
    about once. What the sieve lets pass is compared set by set, the likeliest first, and pairs that links of the same
    block have joined are skipped.
    """
    met = many.groupBy("band").agg(F.min("comp").alias("lo"))
    edges = many.join(met, "band").where("comp != lo").select(F.col("comp").alias("a"), F.col("lo").alias("b")).distinct()
    cluster = components(edges).select(F.col("node").alias("c"), F.col("component").alias("cluster"))
    ids = pin(many.select("id", "comp").distinct().join(cluster, F.col("comp") == F.col("c")).select("id", "comp", "cluster"))
    per = ids.groupBy("cluster", "comp").agg(F.count(F.lit(1)).alias("k"))
    sizes = per.groupBy("cluster").agg(F.sum("k").alias("n"), F.max(F.struct("k", "comp")).alias("top"))
    sizes = sizes.select(
        "cluster",
        F.col("top.comp").alias("main"),
        F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"),
        F.ceil((F.col("n") - F.col("top.k")) / BLOCK).cast("int").alias("few"),
    )
    items = sets.select(F.col("doc_id").alias("id"), "items")
    rows = ids.join(sizes, "cluster").join(sig.select("id", "sig"), "id").join(items, "id")
    h = F.xxhash64("id")
    as_right = F.transform(F.sequence(F.lit(0), F.col("few") - 1), lambda p: F.struct(p.alias("p"), F.pmod(h, F.col("parts")).cast("int").alias("q"), F.lit(False).alias("left")))
    own = F.pmod(h, F.col("few")).cast("int")
    as_left = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: F.struct(own.alias("p"), q.alias("q"), F.lit(True).alias("left")))
    at = F.when(F.col("comp") == F.col("main"), as_right).otherwise(F.concat(as_right, as_left))
    placed = rows.withColumn("at", F.explode(at)).select("cluster", "at.p", "at.q", "at.left", "id", "sig", "items", "comp")

    def compare(pdf):
        import pandas as pd

        x, y = pdf[pdf["left"]], pdf[~pdf["left"]]
        ix, iy, cx, cy = (z.to_numpy() for z in (x["id"], y["id"], x["comp"], y["comp"]))
        up: dict = {}

        def top(c):
            while up.get(c, c) != c:
                c = up[c]
            return c

        found = []
        if len(x) and len(y):
            sx, sy = (np.stack(z["sig"].to_numpy()).astype(np.int64).view(np.uint64) for z in (x, y))
            tx, ty = x["items"].to_numpy(), y["items"].to_numpy()
            nx, ny = (np.array([len(t) for t in z]) for z in (tx, ty))
            low = np.uint64(0x5555555555555555)
            for i in range(len(x)):
                at = np.flatnonzero((cy != cx[i]) & (100 * np.minimum(ny, nx[i]) >= PERCENT * np.maximum(ny, nx[i])))
                d = sy[at] ^ sx[i]
                differ = np.bitwise_count((d | d >> np.uint64(1)) & low).sum(axis=1)
                ok = differ <= MOST_DIFFER
                for j in at[ok][np.argsort(differ[ok], kind="stable")].tolist():
                    a, b = top(cx[i]), top(cy[j])
                    if a == b:
                        continue
                    common = len(np.intersect1d(tx[i], ty[j], assume_unique=True))
                    if 100 * common >= PERCENT * (nx[i] + ny[j] - common):
                        up[max(a, b)] = min(a, b)
                        found.append((min(ix[i], iy[j]), max(ix[i], iy[j])))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return placed.groupBy("cluster", "p", "q").applyInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame, *, task_edges: int | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs (doc_id, text).

    Rows that repeat a doc_id stand or fall together; where their texts differ, the one of the least digest is compared.
    A text without words, null or empty, has an empty set and is linked with nothing. A row without doc_id can't stand
    for others: it gets the component of its exact copies, if any. Very long texts are read whole. Extra columns are not
    read. An empty table gives an empty result. ``task_edges`` is that of ``components``.
    """
    docs = docs.select("doc_id", "text")
    sets = pin(set_table(docs))
    some = sets.where("n_shingles > 0")
    classes = pin(some.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep")))
    ids = classes.select(F.col("rep").alias("r"))
    one = F.min_by(F.struct(F.col("n_shingles").alias("size"), "sig", "bands"), F.struct("d1", "d2")).alias("x")
    chosen = some.join(ids, F.col("doc_id") == F.col("r"), "left_semi").groupBy(F.col("doc_id").alias("id")).agg(one)
    reps = pin(chosen.select("id", "x.size", "x.sig", "x.bands"))
    sig = reps.select("id", "size", "sig")
    bands = reps.select("id", F.explode("bands").alias("band"))
    shared = pin(bands.groupBy("band").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    on_band = Bands(shared, reps.count() * BANDS)
    crowded = pin(on_band.join(bands, shared).select("band", "id", "least", "n"))
    star = crowded.where("id != least").select(F.col("least").alias("a"), F.col("id").alias("b")).distinct()
    # The full sets of all classes that share a bucket, for every comparison to come.
    full = pin(full_sets(crowded.select(F.col("id").alias("i")).distinct(), docs))
    links = pin(confirm(_sieved(star, sig), full))
    found = pin(components(links, task_edges))
    left = pin(_open(crowded, found, on_band))
    if not left.isEmpty():
        # What is left over tries the pivots of its buckets that look most alike.
        pivot = left.groupBy("band").agg(F.min(F.struct(F.xxhash64("id", "band").alias("h"), "id", "comp")).alias("p"))
        tries = (
            on_band.join(left, pivot)
            .where("comp != p.comp")
            .select(F.least("id", "p.id").alias("a"), F.greatest("id", "p.id").alias("b"), F.col("id").alias("x"))
            .distinct()
        )
        best = Window.partitionBy("x").orderBy("differ", "a", "b")
        alike = _sieved(tries, sig).withColumn("k", F.row_number().over(best)).where(F.col("k") <= PIVOTS)
        links = pin(links.union(confirm(alike.select("a", "b").distinct(), full)))
        found = pin(components(links, task_edges))
        left = pin(_open(left.select("band", "id"), found, on_band))
    few = left.where(F.col("n") <= SMALL_BUCKET)
    x = few.select("band", F.col("id").alias("a"), F.col("comp").alias("ca"))
    y = few.select("band", F.col("id").alias("b"), F.col("comp").alias("cb"))
    pairs = x.join(y, "band").where("a < b and ca != cb").select("a", "b").distinct()
    # What the star round has already refused need not be looked at again.
    late = confirm(_sieved(pairs.join(star, ["a", "b"], "left_anti"), sig), full)
    many = pin(left.where(F.col("n") > SMALL_BUCKET))
    if not many.isEmpty():
        late = late.union(_blocked_links(many, sig, full))
    late = pin(late.distinct())
    if not late.isEmpty():
        found = components(links.union(late), task_edges)
    known = classes.join(found, F.col("rep") == F.col("node"), "left").select(
        F.col("d1").alias("c1"),
        F.col("d2").alias("c2"),
        F.col("n_shingles").alias("c3"),
        F.coalesce("component", "rep").alias("component"),
    )
    same = (F.col("d1") == F.col("c1")) & (F.col("d2") == F.col("c2")) & (F.col("n_shingles") == F.col("c3"))
    whole = sets.select("doc_id", "n_shingles", "d1", "d2").join(known, same, "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component"))
    return whole.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )


def _open(crowded: DataFrame, found: DataFrame, on_band: Bands) -> DataFrame:
    """(band, id, comp, n) of the buckets of ``crowded`` (band, id) in which more than one component is left."""
    comp = F.coalesce("component", "id")
    marked = crowded.join(found, F.col("id") == F.col("node"), "left").select("band", "id", comp.alias("comp"))
    several = (
        marked.groupBy("band")
        .agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("n"))
        .where("lo < hi")
        .select("band", "n")
    )
    return on_band.join(marked, several)


def _sieved(pairs: DataFrame, sig: DataFrame) -> DataFrame:
    """``pairs`` (a, b, ...) whose sizes and packed minima allow a link, with the minima that differ."""
    a = sig.select(F.col("id").alias("a"), F.col("size").alias("na"), F.col("sig").alias("sa"))
    b = sig.select(F.col("id").alias("b"), F.col("size").alias("nb"), F.col("sig").alias("sb"))
    measured = pairs.join(a, "a").join(b, "b").withColumn("differ", _differing_bits("sa", "sb"))
    alike = measured.where(may_link(F.col("na"), F.col("nb")) & (F.col("differ") <= MOST_DIFFER))
    return alike.select(*pairs.columns, "differ")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: Sets are joined as texts, for small tables only: the brute force that the operator is held against.
OP10_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                            'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS g
      FROM w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id
           GROUP BY x.doc_id, y.doc_id),
link AS (SELECT a, b FROM common JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b
         WHERE 100 * c >= 75 * (p.n + q.n - c)),
e AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
r AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen),
m AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d JOIN m ON m.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
