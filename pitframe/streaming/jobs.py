"""Structured Streaming jobs over ticks, raw records and ledgers.

Windows close: with a watermark of minutes, ``finished`` writes each window once, when no row can reach it any more, and rows that come
later are dropped. ``latest`` keeps the changing rows of a stream instead (update mode; a replayed batch overwrites itself).
What has been seen of a key (its first payload, its last action) is keyed state of the stream, checkpointed with it: a batch reads and
writes the states of its own keys, however long the history, and a restart goes on from the checkpoint with exactly one output a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.scratch import new_path, stored


def tick_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1) -> DataFrame:
    """The events table as a stream of ticks."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    e = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    side = F.when(F.col("event_type") == "purchase", "B").when(F.col("event_type") == "error", "S").otherwise("N")
    return e.select(F.lpad(F.col("user_id").cast("string"), 6, "0").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), (F.col("event_id") % 97 + 1).alias("hands"), side.alias("side"), "event_id")


def minute_bars(ticks: DataFrame, minutes: int, late: str = "10 minutes") -> DataFrame:
    order = F.struct("ts", "event_id")
    g = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", f"{minutes} minutes").alias("w"))
    b = g.agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("hands").cast("long").alias("volume"), F.count("*").alias("n"))
    return b.select("symbol", F.col("w.start").alias("start"), "open", "high", "low", "close", "volume", "n")


def running_vwap(ticks: DataFrame, late: str = "10 minutes") -> DataFrame:
    side = lambda s: F.coalesce(F.sum(F.when(F.col("side") == s, F.col("hands"))), F.lit(0)).cast("long")
    g = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", "1 day").alias("w"))
    v = g.agg(F.sum(F.col("price") * F.col("hands")).alias("turnover"), F.sum("hands").cast("long").alias("volume"), side("B").alias("buy"), side("S").alias("sell"), F.count("*").alias("n"))
    return v.select("symbol", F.to_date("w.start").alias("day"), (F.col("turnover") / F.col("volume")).alias("vwap"), "volume", "buy", "sell", "n")


def side_counts(ticks: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Buys and sells in sliding hours, each half hour."""
    g = ticks.withWatermark("ts", late).groupBy(F.window("ts", "1 hour", "30 minutes").alias("w"))
    return g.agg(F.count_if(F.col("side") == "B").alias("buys"), F.count_if(F.col("side") == "S").alias("sells"), F.count("*").alias("n")).select(F.col("w.start").alias("start"), "buys", "sells", "n")


def breadth(quotes: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Advancers, decliners and limit moves of quotes (ts, pct) in sliding hours, each half hour."""
    n = lambda c: F.count_if(c)
    p = F.col("pct")
    g = quotes.withWatermark("ts", late).groupBy(F.window("ts", "1 hour", "30 minutes").alias("w"))
    return g.agg(n(p >= 0).alias("up"), n(p < 0).alias("down"), n(p >= 9.8).alias("limit_up"), n(p <= -9.8).alias("limit_down"), F.count("*").alias("n")).select(F.col("w.start").alias("start"), "up", "down", "limit_up", "limit_down", "n")


def latest(stream: DataFrame, keys: list[str], name: str, mode: str = "update") -> DataFrame:
    """Run the stream over what is there now and return the newest row of each key."""
    spark = stream.sparkSession
    out, state = new_path(spark, name), new_path(spark, f"{name}-state")
    write = lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/batch_no={n}")
    stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    rest = [c for c in stream.columns if c not in keys]
    rows = spark.read.parquet(out).drop("batch_no")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")


def finished(stream: DataFrame, name: str, path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Run the stream over what is there now, each row appended once, and read what has come out so far; the same paths go on where they stopped."""
    spark = stream.sparkSession
    path, checkpoint = path or new_path(spark, name), checkpoint or new_path(spark, f"{name}-state")
    writer = stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def ingest_attempts(stream: DataFrame, key: list[str], hash_col: str, order: list[str]) -> DataFrame:
    """Every attempt with its outcome: the first payload of a key is ACCEPTED, the same one again DUPLICATE, another RAW_MUTATION_DETECTED.

    The accepted payload's hash is the state of the key. Attempts of one micro-batch go by ``order``; earlier batches come before."""
    names = stream.columns

    def step(of: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        known, outcomes = state.get[0] if state.exists else None, []
        for h in rows[hash_col]:
            outcomes.append("ACCEPTED" if known is None else "DUPLICATE" if h == known else "RAW_MUTATION_DETECTED")
            known = h if known is None else known
        state.update((known,))
        yield rows[names].assign(outcome=outcomes)

    return stream.groupBy(*key).applyInPandasWithState(step, T.StructType([*stream.schema, T.StructField("outcome", T.StringType())]), "hash string", "append", GroupStateTimeout.NoTimeout)


def late_revisions(stream: DataFrame, members: DataFrame) -> DataFrame:
    """Bars of the members (a static side) whose availability lies after their own day's decision, with the delay in hours."""
    decision = F.col("trade_date").cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(8))
    late = stream.filter(F.col("available_time") > decision).withColumn("hours", F.timestamp_diff("HOUR", decision, F.col("available_time")))
    return late.join(members.select("symbol").distinct(), "symbol", "left_semi")


def ledger_appends(stream: DataFrame, key: list[str], time: str, horizon: str) -> DataFrame:
    """The rows of a ledger that takes each key once: repeats that come within ``horizon`` of event time are dropped by the state store."""
    return stream.withWatermark(time, horizon).dropDuplicatesWithinWatermark(key)


def action_alerts(stream: DataFrame, *, time: str = "decision_time", tie: str = "record_id", idle_days: int = 120, late: str = "0 seconds", buckets: int = 256) -> DataFrame:
    """Rows (symbol, time, tie, action) whose action differs from the symbol's last one, with that and how often it has changed.

    The last action, its time and the number of changes of a symbol are kept with those of the other symbols of its bucket (a hash), so a batch makes
    one call a bucket and not one a symbol. A symbol that has been silent for more than ``idle_days`` starts anew; it leaves its bucket when the
    watermark passes that day, so only symbols that are alive hold state."""
    schema = T.StructType([*stream.select("symbol", time, tie, "action").schema, T.StructField("previous", T.StringType()), T.StructField("changes", T.LongType())])
    idle = idle_days * 86_400_000

    def step(of: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = pd.DataFrame(dict(zip(("symbol", "action", "changes", "at"), state.get))) if state.exists else None
        mark = state.getCurrentWatermarkMs()
        rows = None if state.hasTimedOut else pd.concat(list(frames), ignore_index=True)
        if rows is not None:
            rows["__ms"] = rows[time].to_numpy("datetime64[ns]").view("int64") // 1_000_000
            rows = rows.sort_values([time, tie], kind="stable")
            now = rows[["symbol", "action", "__ms"]].rename(columns={"__ms": "at"}).assign(changes=0)
            every = now if known is None else pd.concat([known, now], ignore_index=True)  # the state stands as a row before the new ones
            code, names = pd.factorize(every["symbol"], use_na_sentinel=False)
            order = np.argsort(code, kind="stable")
            code, action, at, new = code[order], every["action"].to_numpy(object)[order], every["at"].to_numpy("int64")[order], order >= len(every) - len(now)
            n = len(code)
            first = np.ones(n, bool)
            first[1:] = code[1:] != code[:-1]
            anew = first.copy()
            anew[1:] |= at[1:] - at[:-1] > idle
            none = pd.isna(action)
            before = np.r_[np.array([None], object), action[:-1]]
            before[anew | np.r_[True, none[:-1]]] = None
            changed = new & (pd.isna(before) | none | (before != action))
            # changes since the symbol last started: running sums less what they were there
            steps = np.where(new, changed, every["changes"].to_numpy("int64")[order])
            total, start = np.cumsum(steps), np.maximum.accumulate(np.where(anew, np.arange(n), 0))
            changes = total - total[start] + steps[start]
            last = np.r_[first[1:], True]
            known = pd.DataFrame({"symbol": every["symbol"].to_numpy(object)[order][last], "action": action[last], "changes": changes[last], "at": at[last]})
            if changed.any():
                out = rows.iloc[order[changed] - (len(every) - len(now))]
                yield out[["symbol", time, tie, "action"]].assign(previous=before[changed], changes=changes[changed])
        alive = known[known["at"] + idle + 1 > mark]
        if not len(alive):
            if state.exists:
                state.remove()
            return
        state.update(tuple(alive[c].tolist() for c in ("symbol", "action", "changes", "at")))
        state.setTimeoutTimestamp(max(int(alive["at"].min()) + idle + 1, mark + 1))

    rows = stream.select("symbol", time, tie, "action", F.pmod(F.xxhash64("symbol"), F.lit(buckets)).cast("int").alias("__bucket")).withWatermark(time, late)
    kept = "symbol array<string>, action array<string>, changes array<bigint>, at array<bigint>"
    return rows.groupBy("__bucket").applyInPandasWithState(step, schema, kept, "append", GroupStateTimeout.EventTimeTimeout)


def table_stream(df: DataFrame, name: str, files: int, order: str) -> DataFrame:
    """A table as a stream of ``files`` files, one a micro-batch, written one after another by ranges of ``order``: for replays of history."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    dealt = stored(df.repartitionByRange(files, order).withColumn("__file", F.spark_partition_id()), f"{name}-ranges")
    for k in range(files):  # a file's time is its place in the stream
        dealt.filter(F.col("__file") == k).drop("__file").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def replay(df: DataFrame, batch: str, name: str) -> DataFrame:
    """A table as a stream with one micro-batch for each value of ``batch`` (few whole numbers), in their order."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    dealt = stored(df, f"{name}-rows")
    for (k,) in dealt.select(batch).distinct().sort(batch).collect():
        dealt.filter(F.col(batch) == k).drop(batch).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.drop(batch).schema).option("maxFilesPerTrigger", 1).parquet(path)
