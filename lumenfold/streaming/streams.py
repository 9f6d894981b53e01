"""Structured Streaming forms of the append-only logs: late data, windows, sessions and keyed state."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType, TimestampNTZType

from lumenfold.functions import scheduler as S
from lumenfold.session import Scratch


def read_stream(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """A Parquet log as a stream, ``files`` files a batch; zone-less timestamps become instants, which watermarks need."""
    schema: StructType = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    s = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path + "*")
    return s.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema.fields if isinstance(f.dataType, TimestampNTZType)})


def deduplicated(stream: DataFrame, key: str, at: str, late: str = "1 day") -> DataFrame:
    """First arrival of each event id; state is dropped once the watermark has passed."""
    return stream.filter(F.col(at).isNotNull()).withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def windowed(stream: DataFrame, at: str, by: str, width: str = "1 day", late: str = "1 day") -> DataFrame:
    return stream.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), by).agg(F.count(F.lit(1)).alias("events")).select(F.col("w.start").alias("start"), by, "events")


def sessions(stream: DataFrame, user: str, at: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    return stream.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), user).agg(F.count(F.lit(1)).alias("events")).select(user, F.col("w.start").alias("started_at"), "events")


#: State of an item: stability, difficulty, time of the last review in seconds, reviews, lapses.
_STATE = "stability double, difficulty double, at double, reps long, lapses long"


def memory(stream: DataFrame, key: str, at: str, rating: str) -> DataFrame:
    """Memory state ``(key, stability, difficulty, reps, lapses)`` per item after every batch of its reviews.

    The state is kept by the engine, keyed by item; reviews of one batch are taken in order of time and id.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["at", "id"])
        s, d, last, reps, lapses = state.get if state.exists else (0.0, 0.0, 0.0, 0, 0)
        for t, g in zip(rows["at"], rows["g"].astype(int)):
            if reps:
                s, d, lapses = *S.advance(s, d, g, (t - last) // 86400), lapses + (g == 1)
            else:
                s, d = S.begin(g)
            last, reps = t, reps + 1
        state.update((float(s), float(d), float(last), int(reps), int(lapses)))
        yield pd.DataFrame({"key": [k[0]], "stability": [s], "difficulty": [d], "reps": [reps], "lapses": [lapses]})

    rows = stream.filter(F.col(rating).isNotNull() & F.col(at).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("key"), "id", F.unix_timestamp(at).cast("double").alias("at"), F.col(rating).cast("int").alias("g"))
    return rows.groupBy("key").applyInPandasWithState(step, "key long, stability double, difficulty double, reps long, lapses long", _STATE, "update", GroupStateTimeout.NoTimeout)


def redelivered(children: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Child rows as soon as their parent is there, whichever came first: a join of two streams, whose waiting rows are rows
    of the engine's state and not a list per key.  A parent counts once."""
    known = parents.select(F.col(parent_key).alias("_parent")).filter("_parent is not null").dropDuplicates(["_parent"])
    return children.filter(F.col(key).isNotNull()).join(known, F.col(key) == F.col("_parent")).drop("_parent")


def _run(stream: DataFrame, mode: str, sink: Callable[[DataFrame, int], None], state: str) -> None:
    stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def run_once(stream: DataFrame, mode: str, scratch: Scratch, keys: Sequence[str] = ()) -> DataFrame:
    """Processes what is there, stops and reads the result back from the shared folder.

    Each epoch is a partition that a retry overwrites, so nothing comes out twice.  ``complete`` reads the last epoch,
    ``update`` the last row of each of the ``keys``, ``append`` all epochs.
    """
    out = f"{scratch.base}/stream-out"

    def sink(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    _run(stream, mode, sink, f"{scratch.base}/stream-state")
    rows = scratch.spark.read.parquet(out)
    if mode == "complete":
        rows = rows.filter(F.col("epoch") == (rows.agg(F.max("epoch")).first()[0] or 0))
    elif mode == "update":
        own = [c for c in rows.columns if c not in keys and c != "epoch"]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*own), "epoch").alias("r")).select(*keys, "r.*")
    return rows.drop("epoch")


def split_late(stream: DataFrame, at: str, seconds: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Rows on time and rows that come more than ``seconds`` after the latest time of an earlier batch.

    A watermark drops such rows without a trace; here they go to a table of their own.  Null times are on time.
    """
    out = f"{scratch.base}/split"

    def sink(df: DataFrame, epoch: int) -> None:
        spark = df.sparkSession
        before = None
        if epoch:
            before = spark.read.parquet(f"{out}/seen").filter(F.col("epoch") < epoch).agg(F.max("m")).first()[0]
        late = F.lit(False) if before is None else F.coalesce(F.unix_timestamp(at) < before - seconds, F.lit(False))
        df.withColumn("late", late).write.mode("overwrite").parquet(f"{out}/rows/epoch={epoch}")
        df.agg(F.max(F.unix_timestamp(at)).alias("m")).write.mode("overwrite").parquet(f"{out}/seen/epoch={epoch}")

    _run(stream, "append", sink, f"{scratch.base}/split-state")
    rows = scratch.spark.read.parquet(f"{out}/rows").drop("epoch")
    return rows.filter("not late").drop("late"), rows.filter("late").drop("late")
