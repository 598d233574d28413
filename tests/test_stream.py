import random

from pyspark.sql import functions as F

from seamline.streaming import watch


def fed(chunks, pattern="ERROR"):
    w = watch.Watcher(pattern)
    for offset, data in chunks:
        w.feed(offset, data)
    return w


def test_lines_and_offsets():
    w = fed([(0, b"ERROR a\nok\nERROR b\nERROR c\n")])
    assert [(x[0], x[2]) for x in w.pending.lines] == [(0, "ERROR a"), (11, "ERROR b"), (19, "ERROR c")]


def test_line_across_chunks():
    w = fed([(40, b"ER"), (42, b"ROR a\n")])
    assert [(x[0], x[2]) for x in w.pending.lines] == [(40, "ERROR a")]


def test_cap_counts_source_lines():
    w = fed([(0, b"ERROR\n" * 53)])
    assert (w.pending.taken, w.pending.dropped, w.pending.first_dropped) == (50, 3, 300)
    assert [x[3] for x in w.pending.lines] == [50]


def test_fold_needs_contiguous_lines():
    w = fed([(0, b"ERROR a\nERROR a\nignore\nERROR a\n")])
    assert [x[3] for x in w.pending.lines] == [2, 1]


def test_rate_window_starts_at_first_delivery():
    w = watch.Watcher("E")
    at = 0
    for i in range(12):
        w.feed(at, b"E x\r\nb")
        at += 6
        assert w.take(5_000 + i) is not None
    w.feed(at, b"\nE\nE\n")
    assert w.take(64_999) is None
    b = w.take(64_999, final=True)
    assert not b.lines and b.dropped == 2 and b.first_dropped == 73
    w.feed(w.cursor, b"E\n")
    assert w.take(65_000).lines


def test_oversized_lines_are_counted():
    w = fed([(0, b"x" * 70_000), (70_000, b"ERROR\nERROR ok\n")])
    assert w.oversized == 1 and [x[2] for x in w.pending.lines] == ["ERROR ok"]


def test_every_chunking_gives_the_same():
    data = b"".join(random.Random(1).choice([b"ERROR x\n", b"fine\n", b"ERROR yy\n"]) for _ in range(40)) + b"ERROR end"
    want = None
    for seed in range(25):
        rng, at, chunks = random.Random(seed), 0, []
        while at < len(data):
            n = rng.randint(1, 30)
            chunks.append((at, data[at : at + n]))
            at += n
        w = fed(chunks)
        w.finish()
        want = want or w.pending.lines
        assert w.pending.lines == want


def test_state_survives():
    w = fed([(0, b"ERROR a\npart")])
    v = watch.Watcher.load(w.dump())
    v.feed(12, b" ERROR\n")
    assert [x[2] for x in v.pending.lines] == ["ERROR a", "part ERROR"] and v.replay_from() == 0


def test_batches_merge():
    a, b = fed([(0, b"ERROR\n" * 30)]).pending, fed([(180, b"ERROR\n" * 30)]).pending
    a.merge(b)
    assert (a.taken, a.dropped, a.first_dropped) == (50, 10, 300)
    assert [x[3] for x in a.lines] == [30, 20]
    a.merge(fed([(360, b"ERROR\n")]).pending)
    assert (a.taken, a.dropped, a.first_dropped) == (50, 11, 300)


def test_repeats(spark):
    rows = [("s", 1, "t", '{"a":1,"b":2}', "o"), ("s", 2, "t", '{"b":2,"a":1}', "o"), ("s", 3, "t", "{}", "o")]
    df = spark.createDataFrame(rows, "session string, seq int, tool string, args string, output string")
    assert [r.repeat for r in watch.repeated_calls(df).orderBy("seq").collect()] == [False, True, False]


def test_stream_equals_batch(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = watch.counts(s, "1 day").writeStream.format("memory").queryName("day").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    key = F.col("start").cast("string").alias("start")
    pick = lambda df: sorted(tuple(r) for r in df.select(key, "event_type", "n").collect())
    assert pick(spark.table("day")) == pick(watch.counts(events, "1 day"))
