"""Event and session streams: an append log with sequence numbers, replay by topic, high-water marks, windows, state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestrata.functions.patterns import topic_matches
from lodestrata.operators.observations import above_mark, mentions

EVENT = T.StructType([T.StructField("seq", T.LongType()), T.StructField("topic", T.StringType()), T.StructField("event", T.StringType()), T.StructField("source", T.StringType()), T.StructField("data", T.StringType())])
SESSION = T.StructType([T.StructField("turn", T.IntegerType()), T.StructField("role", T.StringType()), T.StructField("ts_ms", T.LongType()), T.StructField("text", T.StringType())])


def replay(log: DataFrame, since: int, pattern: str, identity: str | None = None) -> DataFrame:
    """Events after `since` whose topic matches, except those of the subscriber itself, in order. Works on batch and stream."""
    df = log.filter((F.col("seq") > since) & topic_matches(F.col("topic"), pattern))
    df = df if identity is None else df.filter(F.col("source").isNull() | (F.col("source") != identity))
    return df if df.isStreaming else df.orderBy("seq")


def has_gap(log: DataFrame, since: int) -> bool:
    """Whether events between `since` and the oldest kept one are lost: 0 < since < first kept sequence number."""
    first = log.agg(F.min("seq")).first()[0]
    return first is not None and 0 < since < first


def keep_last(log: DataFrame, capacity: int = 10_000) -> DataFrame:
    """The newest `capacity` events of the log (the bound of the ring is its feature)."""
    last = log.agg(F.max("seq").alias("m"))
    return log.crossJoin(F.broadcast(last)).filter(F.col("seq") > F.col("m") - capacity).drop("m")  # one row


def read_sessions(spark: SparkSession, path: str, stream: bool = False, files_per_trigger: int = 100) -> DataFrame:
    """Session transcripts as JSON lines with a fixed schema; lines that don't parse have NULL fields and are left out."""
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_trigger) if stream else spark.read
    return reader.schema(SESSION).json(path).filter("ts_ms IS NOT NULL")


def observe(sessions: DataFrame) -> DataFrame:
    return sessions.select("turn", "role", "ts_ms", "text", mentions(F.col("text")).alias("mentions"))


def ingest(stream: DataFrame, out: str, marks: str, checkpoint: str) -> StreamingQuery:
    """Appends observations newer than the stored mark; older ones and equals are dropped for good, then the mark moves on.

    The mark is one value, written per batch; it isn't a delay-based watermark. Rows and mark of a batch lie under its
    number (column `batch`) and are overwritten if the batch is tried again, against the marks of earlier batches only,
    so a batch that failed between the two writes neither doubles nor loses rows.
    """

    def batch(df: DataFrame, epoch: int) -> None:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(marks)
        there = p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
        mark = spark.read.schema("mark long, batch long").parquet(marks).filter(F.col("batch") < epoch).agg(F.max("mark")).first()[0] if there else None
        fresh = above_mark(observe(df), "ts_ms", mark).persist()
        top = fresh.agg(F.max("ts_ms")).first()[0]
        if top is not None:
            fresh.write.mode("overwrite").parquet(f"{out}/batch={epoch}")
            spark.createDataFrame([(top,)], "mark long").write.mode("overwrite").parquet(f"{marks}/batch={epoch}")
        fresh.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, at: str, key: str, size: str, slide: str | None = None, lateness: str = "10 minutes") -> DataFrame:
    """Counts per event-time window and key; rows later than the watermark are dropped by the engine."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    return stream.withWatermark(at, lateness).groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", key, "n")


def co_change_rates(stream: DataFrame, alpha: float = 0.1) -> DataFrame:
    """(edge, n, rate) as a stream: a rate per edge that moves by alpha towards each hit (0 or 1), held as state by key.

    stream: edge STRING, seq LONG, hit DOUBLE. Within a batch rows are folded in order of seq.
    """
    out = T.StructType([T.StructField("edge", T.StringType()), T.StructField("n", T.LongType()), T.StructField("rate", T.DoubleType())])
    held = T.StructType([T.StructField("n", T.LongType()), T.StructField("rate", T.DoubleType())])

    def fold(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, rate = state.get if state.exists else (0, 0.0)
        rows = pd.concat(list(parts)).sort_values("seq")
        for h in rows["hit"]:
            rate = (1 - alpha) * rate + alpha * float(h)
            n += 1
        state.update((n, rate))
        yield pd.DataFrame({"edge": [key[0]], "n": [n], "rate": [rate]})

    return stream.groupBy("edge").applyInPandasWithState(fold, out, held, "update", GroupStateTimeout.NoTimeout)


def on_change(stream: DataFrame, passes: dict[str, tuple[tuple[str, ...], Callable[[DataFrame], None]]], checkpoint: str, every: str = "2 seconds") -> StreamingQuery:
    """Runs enrichment passes over each batch of changed files, in the order of what they depend on."""
    order = schedule({k: v[0] for k, v in passes.items()})

    def batch(df: DataFrame, epoch: int) -> None:
        df = df.persist()
        for name in order:
            passes[name][1](df)
        df.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def schedule(depends: dict[str, tuple[str, ...]]) -> list[str]:
    """Passes in an order in which each follows what it depends on, smaller names first; a cycle or unknown name raises."""
    left, out = {k: set(v) for k, v in depends.items()}, []
    unknown = {x for v in left.values() for x in v} - set(left)
    if unknown:
        raise ValueError(f"unknown passes: {sorted(unknown)}")
    while left:
        ready = sorted(k for k, v in left.items() if not v - set(out))
        if not ready:
            raise ValueError(f"passes depend on each other: {sorted(left)}")
        out.append(ready[0])
        del left[ready[0]]
    return out
