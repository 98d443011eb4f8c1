"""Loci over streams: runs of events that touch, closed by a watermark.

Batch and stream share one rule: an event joins the open locus of its key when
it starts no later than ``gap`` after the locus ends. On a stream a locus is
emitted once the watermark passes its end; later events that would have joined
it are dropped by the engine's watermark rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_loci(events: DataFrame, key: str, ts: str, gap: str, watermark: str | None = None) -> DataFrame:
    """(key, start, end, events): sessions of events at most ``gap`` apart; works on batch and streaming tables."""
    rows = events.withWatermark(ts, watermark) if watermark else events
    return (rows.groupBy(F.session_window(ts, gap).alias("w"), F.col(key)).agg(F.count("*").alias("events"), F.min(ts).alias("start"), F.max(ts).alias("end"))
            .select(key, "start", "end", "events"))


def tumbling(events: DataFrame, key: str, ts: str, width: str, watermark: str | None = None) -> DataFrame:
    """(key, start, events): counts in fixed windows of time."""
    rows = events.withWatermark(ts, watermark) if watermark else events
    return rows.groupBy(F.window(ts, width).alias("w"), F.col(key)).agg(F.count("*").alias("events")).select(key, F.col("w.start").alias("start"), "events")


def stream_table(spark, path: str, schema: str, kind: str = "parquet") -> DataFrame:
    """A folder that files are added to, as a stream."""
    return spark.readStream.schema(schema).format(kind).load(path)


def open_loci(ranges: DataFrame, key: str = "chr", timeout_ms: int = 60_000) -> DataFrame:
    """(key, start, end, members) of a stream of ranges sorted by start within ``key``.

    State is one open locus a key; it is emitted when a range past its end
    comes, or when the key is silent for ``timeout_ms``.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(k, frames, state):
        import pandas as pd

        out = []
        if state.hasTimedOut:
            s, e, n = state.get
            state.remove()
            out.append((k[0], s, e, n))
        else:
            now = list(state.get) if state.exists else None
            rows = pd.concat(list(frames)).sort_values(["start", "end"])
            for s, e in zip(rows["start"].tolist(), rows["end"].tolist()):
                if now and s <= now[1]:
                    now = [min(now[0], s), max(now[1], e), now[2] + 1]
                else:
                    if now:
                        out.append((k[0], *now))
                    now = [s, e, 1]
            state.update(tuple(now))
            state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame(out, columns=[key, "start", "end", "members"])

    return ranges.select(key, "start", "end").groupBy(key).applyInPandasWithState(
        step, f"{key} string, start long, end long, members long", "s long, e long, n long", "append", GroupStateTimeout.ProcessingTimeTimeout)
