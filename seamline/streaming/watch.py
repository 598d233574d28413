"""A line watcher on byte streams, as a state machine and as a Structured Streaming operator.

Chunks (offset, data) of a stream come in order; lines are put together across chunks, matched, capped, folded and
delivered at a bounded rate. The window of the rate starts at the first delivery after the last one expired.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values.
MAX_LINE, BATCH_LINES, RATE, WINDOW_MS = 64 * 1024, 50, 12, 60_000


@dataclass
class Batch:
    """Matches kept for one delivery: [offset, end, text, count], and what was dropped."""

    lines: list[list] = field(default_factory=list)
    taken: int = 0
    dropped: int = 0
    first_dropped: int | None = None

    def add(self, offset: int, end: int, text: str) -> None:
        if self.taken >= BATCH_LINES:
            self.drop(1, offset)
            return
        self.taken += 1
        last = self.lines[-1] if self.lines else None
        if last and last[1] == offset and last[2] == text:
            last[1], last[3] = end, last[3] + 1
        else:
            self.lines.append([offset, end, text, 1])

    def drop(self, n: int, offset: int | None) -> None:
        self.dropped += n
        if n and offset is not None and (self.first_dropped is None or offset < self.first_dropped):
            self.first_dropped = offset

    def merge(self, other: Batch) -> None:
        """Append a later batch under the same cap; of a folded row, as many lines as there is room for stay."""
        for offset, end, text, n in other.lines:
            keep = min(n, BATCH_LINES - self.taken)
            self.drop(n - keep, offset + keep * (end - offset) // n)
            if keep:
                self.taken += keep
                self.lines.append([offset, offset + keep * (end - offset) // n, text, keep])
        self.dropped += other.dropped
        if self.first_dropped is None:
            self.first_dropped = other.first_dropped


class Watcher:
    """One stream's state; ``feed`` and ``take`` are all that changes it."""

    def __init__(self, pattern: str, regex: bool = False):
        self.pattern, self.regex = pattern, regex
        self.partial, self.start, self.cursor, self.oversize = b"", 0, 0, False
        self.oversized = 0
        self.pending = Batch()
        self.window_start: int | None = None
        self.delivered = 0

    def _match(self, text: str) -> bool:
        return bool(re.search(self.pattern, text)) if self.regex else self.pattern in text

    def feed(self, offset: int, data: bytes) -> None:
        """Take a chunk; what lies before the cursor was seen already."""
        if offset < self.cursor:
            data, offset = data[self.cursor - offset :], self.cursor
        if not self.partial and not self.oversize:
            self.start = offset
        self.cursor = max(self.cursor, offset + len(data))
        at = 0
        while (i := data.find(b"\n", at)) >= 0:
            self._line(self.partial + data[at:i], offset + i + 1)
            self.partial, self.oversize, self.start, at = b"", False, offset + i + 1, i + 1
        if not self.oversize:
            self.partial += data[at:]
            if len(self.partial) > MAX_LINE:
                self.partial, self.oversize = b"", True

    def _line(self, raw: bytes, end: int) -> None:
        if self.oversize or len(raw) > MAX_LINE:
            self.oversized += 1
            return
        text = raw.decode("utf-8", "replace").removesuffix("\r")
        if self._match(text):
            self.pending.add(self.start, end, text)

    def finish(self) -> None:
        """The stream ended: what is left counts as a line."""
        if self.partial:
            self._line(self.partial, self.cursor)
        self.partial, self.start = b"", self.cursor

    def take(self, now_ms: int, final: bool = False) -> Batch | None:
        """A batch to deliver, if there is one and the rate allows; at the end, what can't be delivered is summed up."""
        if not self.pending.lines and not self.pending.dropped:
            return None
        if self.window_start is None or now_ms - self.window_start >= WINDOW_MS:
            self.window_start, self.delivered = now_ms, 0
        if self.delivered >= RATE:
            if not final:
                return None
            out = Batch()
            for offset, _, _, n in self.pending.lines:
                out.drop(n, offset)
            out.drop(self.pending.dropped, self.pending.first_dropped)
        else:
            self.delivered += 1
            out = self.pending
        self.pending = Batch()
        return out

    def replay_from(self) -> int:
        """Where to read again after a restart."""
        held = [self.cursor] + ([self.start] if self.partial else []) + [x[0] for x in self.pending.lines]
        return min(held + ([self.pending.first_dropped] if self.pending.first_dropped is not None else []))

    def dump(self) -> str:
        d = dict(self.__dict__)
        d["partial"] = self.partial.hex()
        d["pending"] = self.pending.__dict__
        return json.dumps(d)

    @classmethod
    def load(cls, state: str) -> Watcher:
        d = json.loads(state)
        w = cls(d["pattern"], d["regex"])
        d["partial"] = bytes.fromhex(d["partial"])
        d["pending"] = Batch(**d["pending"])
        w.__dict__.update(d)
        return w


OUTPUT = "stream string, offset long, text string, count int, dropped int, first_dropped long"


def watch(chunks: DataFrame, pattern: str, regex: bool = False) -> DataFrame:
    """Matches of a streaming DataFrame (stream, offset, data, at_ms, last): one state for each stream.

    A row of null text tells what a batch dropped. Chunks of a micro-batch are sorted by offset.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key, frames, state: GroupState):
        w = Watcher.load(state.get[0]) if state.exists else Watcher(pattern, regex)
        rows = pd.concat(list(frames)).sort_values("offset")
        out = []

        def emit(b: Batch | None):
            if b:
                out.extend((key[0], o, t, n, 0, None) for o, _, t, n in b.lines)
                if b.dropped:
                    out.append((key[0], None, None, 0, b.dropped, b.first_dropped))

        for r in rows.itertuples():
            w.feed(int(r.offset), bytes(r.data))
            if r.last:
                w.finish()
            emit(w.take(int(r.at_ms), bool(r.last)))
        state.update((w.dump(),))
        names = ["stream", "offset", "text", "count", "dropped", "first_dropped"]
        frame = pd.DataFrame(out, columns=names)
        frame["offset"] = frame["offset"].astype("Int64")
        frame["first_dropped"] = frame["first_dropped"].astype("Int64")
        yield frame

    return chunks.groupBy("stream").applyInPandasWithState(step, OUTPUT, "state string", "append", GroupStateTimeout.NoTimeout)


def _timed(events: DataFrame) -> DataFrame:
    """Watermarks of streams need timestamps with a zone; the session's is taken."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")) if events.isStreaming else events


def debounced(changes: DataFrame, quiet: str = "2 minutes", late: str = "10 minutes") -> DataFrame:
    """(root, start, end, n) of bursts of changes (root, ts) with a quiet time after them."""
    return (
        _timed(changes).withWatermark("ts", late)
        .groupBy("root", F.session_window("ts", quiet).alias("w"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("root", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
    )


def counts(events: DataFrame, size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total) in tumbling or sliding windows on ts; works on streams and tables alike."""
    return (
        _timed(events).withWatermark("ts", late)
        .groupBy(F.window("ts", size, slide or size).alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("start"), "event_type", "n", "total")
    )


def deliver(batch: DataFrame, folder: str, epoch: int) -> None:
    """foreachBatch sink that may run twice: each micro-batch overwrites its own folder."""
    batch.write.mode("overwrite").parquet(f"{folder}/epoch={epoch}")


def deliverable(pending: DataFrame, acknowledged: DataFrame, keys: list[str], version: str, most: int) -> tuple[DataFrame, DataFrame]:
    """(rows, gaps) to deliver from durable notices (keys, version, ...): those that no acknowledgement (keys, version)
    covers, the ``most`` newest of each; gaps count what was evicted and say through which version.

    An acknowledgement covers its version and all before, so a notice that is delivered twice is acknowledged once.
    """
    from pyspark.sql import Window

    done = acknowledged.groupBy(*[F.col(k).alias(f"a_{k}") for k in keys]).agg(F.max(version).alias("through"))
    same = [F.col(k) == F.col(f"a_{k}") for k in keys]
    live = pending.join(done, same, "left").where(F.col("through").isNull() | (F.col(version) > F.col("through"))).select(*pending.columns)
    newest = live.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(version)))).where(F.col("rn") <= most).drop("rn")
    kept = newest.groupBy(*[F.col(k).alias(f"k_{k}") for k in keys]).agg(F.min(version).alias("oldest"))
    gone = live.join(kept, [F.col(k) == F.col(f"k_{k}") for k in keys]).where(F.col(version) < F.col("oldest"))
    gaps = gone.groupBy(*keys).agg(F.count(F.lit(1)).alias("evicted"), F.max(version).alias("evicted_through"))
    return newest, gaps


def repeated_calls(calls: DataFrame, key: str = "session") -> DataFrame:
    """Calls (session, seq, tool, args, output) that repeat the one before: same tool, arguments in canonical order, and output."""
    from pyspark.sql import Window

    members = F.from_json("args", "map<string,string>")
    canonical = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(members))))
    w = Window.partitionBy(key).orderBy("seq")
    me = F.struct("tool", canonical.alias("args"), F.md5("output").alias("output"))
    return calls.withColumn("me", me).withColumn("repeat", F.coalesce(F.col("me") == F.lag("me").over(w), F.lit(False))).drop("me")
