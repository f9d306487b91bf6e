"""Roll-ups over unbounded streams: the same expressions as in batch, with watermarks and keyed state.

What Spark's own stateful operators can say (windows, chained windows, latest values) uses them. Batches that a clock closes and rates
that end at the newest completion keep state of their own in ``transformWithStateInPandas``, with timers in event time. Rows of a key may arrive in any order within the
watermark's delay: they wait in list state until the watermark has passed them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..adapters import BASE, PERIODS, Domain

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LiveDomain(Domain):
    """Domain tables over base tables that are read as streams of files, ``files`` of them at most in a micro-batch."""

    def __init__(self, spark: SparkSession, folder: str, files: int | None = None):
        super().__init__(spark, folder)
        self.files = files

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            path = f"{self.folder}/{name}.parquet"
            schema = self.spark.read.parquet(path).schema
            reader = self.spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet")
            return (reader.option("maxFilesPerTrigger", self.files) if self.files else reader).parquet(f"{path}*")
        return super().__getattr__(name)


def replay(events: DataFrame, folder: str, parts: int = 4, spread: int = 8) -> tuple[LiveDomain, str]:
    """Events written as ``parts`` arrivals in order of time, every ``spread``-th row one arrival late, and a heartbeat at last; and the delay that loses none.

    The heartbeat has no user and lies so far ahead that the watermark passes every row.
    """
    spark, path = events.sparkSession, f"{folder}/events.parquet"
    low, high = (r := events.agg(F.unix_micros(F.min("ts").cast("timestamp")), F.unix_micros(F.max("ts").cast("timestamp"))).first())[0] or 0, r[1] or 0
    step = (high - low) // parts + 1
    part = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - low) / step) + F.when(F.pmod(F.hash("event_id"), F.lit(spread)) == 0, 1).otherwise(0)
    files = 1
    for i in range(parts + 1):
        events.where(F.least(part, F.lit(parts)) == i).write.mode("append").parquet(path)
        files = max(files, math.ceil(len(spark.read.parquet(path).inputFiles()) / (i + 1)))
    delay = 2 * (step // 1_000_000 + 1)
    last = events.sparkSession.range(1).select(F.lit(-1).cast("long").alias("event_id"), F.timestamp_micros(F.lit(high + 1000 * 1_000_000 * delay)).alias("ts"))
    heartbeat = last.select(*[(F.col(f.name) if f.name in last.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema])
    heartbeat.coalesce(1).write.mode("append").parquet(path)
    return LiveDomain(spark, folder, files), f"{delay} seconds"


def with_event_time(df: DataFrame, at: str, late: str) -> DataFrame:
    """Adds event_time from microseconds, and a watermark of ``late``, which bounds the state of the windows below."""
    return df.withColumn("event_time", F.timestamp_micros(F.col(at))).withWatermark("event_time", late)


def tumbling(df: DataFrame, keys: list[str], width: str, *aggregates) -> DataFrame:
    """One row per key and window of ``width``: start_us and the aggregates."""
    out = df.groupBy(*keys, F.window("event_time", width).alias("w")).agg(*aggregates)
    return out.select(*keys, F.unix_micros("w.start").alias("start_us"), *[c for c in out.columns if c not in (*keys, "w")])


def sliding(df: DataFrame, keys: list[str], width: str, slide: str, *aggregates) -> DataFrame:
    out = df.groupBy(*keys, F.window("event_time", width, slide).alias("w")).agg(*aggregates)
    return out.select(*keys, F.unix_micros("w.end").alias("end_us"), *[c for c in out.columns if c not in (*keys, "w")])


def second_records(requests: DataFrame, keys: list[str], at: str = "t0", tie: str = "event_id", second: int = 1_000_000) -> DataFrame:
    """Per key and second, once the watermark has passed it: w, n, and mean and population variance of the gaps between requests.

    A streaming aggregate has no ``lag``: a second's requests are its state, sorted when it closes.
    """
    times = F.transform(F.sort_array(F.collect_list(F.struct(at, tie))), lambda r: r[at])
    out = requests.groupBy(*keys, F.window("event_time", f"{second} microseconds").alias("w")).agg(times.alias("times"))
    before, after = F.slice("times", 1, F.size("times") - 1), F.slice("times", 2, F.size("times") - 1)
    gaps = F.filter(F.zip_with(before, after, lambda a, b: (b - a).cast("double")), lambda g: g >= 0)
    zero = F.lit(0.0)
    mean = lambda xs: F.when(F.size(xs) > 0, F.aggregate(xs, zero, lambda s, x: s + x) / F.size(xs)).otherwise(zero)
    out = out.select(*keys, "w", F.size("times").cast("long").alias("n"), gaps.alias("gaps")).withColumn("mean", mean(F.col("gaps")))
    return out.withColumn("variance", mean(F.transform("gaps", lambda g: (g - F.col("mean")) * (g - F.col("mean"))))).drop("gaps")


def combined_records(seconds: DataFrame, keys: list[str], second: int = 1_000_000) -> DataFrame:
    """One record per second from those of several receivers, chained on their windows: sum of counts, plain mean of what is not 0."""
    mean = lambda c: F.coalesce(F.avg(F.when(F.col(c) != 0, F.col(c))), F.lit(0.0)).alias(c)
    return seconds.groupBy(*keys, F.window(F.window_time("w"), f"{second} microseconds").alias("w")).agg(F.sum("n").alias("n"), mean("mean"), mean("variance"))


def period_records(seconds: DataFrame, keys: list[str], second: int = 1_000_000, periods: tuple[int, ...] = PERIODS) -> DataFrame:
    """For each second with requests: arrival_rate_{p}s and coeff_var_{p}s of the last p seconds, for every period at once.

    One sliding window of the longest period, chained on the seconds' windows, holds them all: a second counts for a period if it is young enough.
    """
    at = F.window_time("w").alias("at_")
    rows = seconds.select(*keys, "n", "mean", "variance", at, F.unix_micros("w.start").alias("us_"))
    rows = rows.select("*", F.window("at_", f"{max(periods) * second} microseconds", f"{second} microseconds").alias("v"))
    age = F.floor((F.unix_micros("v.end") - F.col("us_")) / second) - 1
    square = F.col("n") * (F.col("variance") + F.col("mean") * F.col("mean"))
    sums = [F.sum(F.when(age < p, x)).alias(f"{name}{p}_") for p in periods for name, x in (("n", F.col("n")), ("m", F.col("n") * F.col("mean")), ("q", square))]
    out = rows.groupBy(*keys, "v").agg(F.count_if(age == 0).alias("now_"), *sums).where("now_ > 0")
    columns = []
    for p in periods:
        mean = F.col(f"m{p}_") / F.col(f"n{p}_")
        spread = F.sqrt(F.greatest(F.col(f"q{p}_") / F.col(f"n{p}_") - mean * mean, F.lit(0.0)))
        columns += [F.ceil(F.col(f"n{p}_") / p).cast("long").alias(f"arrival_rate_{p}s"), F.when(mean > 0, spread / mean).otherwise(0.0).alias(f"coeff_var_{p}s")]
    return out.select(*keys, (F.floor(F.unix_micros("v.end") / second) - 1).cast("long").alias("second"), *columns)


def throughput(requests: DataFrame, key: str, at: str = "t11", second: int = 1_000_000, periods: tuple[int, ...] = PERIODS) -> DataFrame:
    """Completions of the last p seconds before a key's newest, per second, plus 1, told anew whenever the key has rows.

    State: the key's completions of the longest period, which is all that later rows can need.
    """
    kind, reach = requests.schema[key].dataType.simpleString(), max(periods) * second

    class Recent(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.recent = handle.getListState("recent", "t long")

        def handleInputRows(self, key_, rows, timerValues):  # noqa: N802, N803
            kept = np.array([t for (t,) in self.recent.get()], np.int64)
            for part in rows:
                kept = np.concatenate((kept, part[at].to_numpy(np.int64)))
                kept = kept[kept >= kept.max() - reach]
            self.recent.put([(int(t),) for t in kept])
            age = kept.max() - kept
            yield pd.DataFrame({key: [key_[0]], **{f"thrput_{p}s": [(age <= p * second).sum() / p + 1.0] for p in periods}})

        def close(self) -> None:
            pass

    schema = f"{key} {kind}, " + ", ".join(f"thrput_{p}s double" for p in periods)
    return requests.select(key, at).where(F.col(at).isNotNull()).groupBy(key).transformWithStateInPandas(Recent(), schema, "Update", "None")


def latest_rows(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The newest row's values per key (update mode); the state is one row a key."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("row_")).select(*keys, *[F.col(f"row_.{v}").alias(v) for v in values])


def smoothed(df: DataFrame, key: str, order: str, value: str, up: float = 0.2, down: float = 0.8) -> DataFrame:
    """Latest asymmetric exponential average per key; the state is one number. Rows of a micro-batch are taken in ``order``.

    A step shrinks what came before it by ``max(up, down)`` at least, so of a micro-batch only the last rows, as many as shrink it to 1e-24, are held.
    """
    most = max(up, down)
    if not 0 <= min(up, down) <= most < 1:
        raise ValueError("up and down must be at least 0 and below 1")
    needed = math.ceil(math.log(1e-24) / math.log(most)) + 1 if most > 0 else 1

    def step(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s, rows = state.get[0] if state.exists else None, None
        for part in parts:
            rows = part if rows is None else pd.concat([rows, part])
            rows = rows.sort_values(order, kind="stable").iloc[-needed:]
        for x in rows[value].astype(float):
            s = x if s is None else (s * up + x * (1 - up) if x > s else s * down + x * (1 - down))
        state.update((s,))
        yield pd.DataFrame({key: [name[0]], "smoothed": [s]})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, order, value).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, smoothed double", "s double", "update", GroupStateTimeout.NoTimeout)


def timed_batches(df: DataFrame, key: str, at: str, tie: str, size: int, wait: int, buckets: int = 512) -> DataFrame:
    """Batches closed at ``size`` items, or when the first has waited ``wait`` microseconds: start, n, closed_us and whether time ran out.

    Needs ``with_event_time``. Rows wait in list state until the watermark has passed them and are then taken in order of ``at`` (rows of one time, which ``tie``
    would order, fill a batch alike). A batch is closed by its last item, or by a timer: a key that goes quiet loses its batch as soon as the watermark shows
    that nothing can still join it. Nothing is kept of a closed batch.

    Every access to state is a call to another process, so the keys of a bucket share theirs: rows and open batches of all of them are held as Arrow bytes.
    Null keys have a bucket of their own.
    """

    def packed(keys, times) -> bytes:
        batch, sink = pa.record_batch({"k": keys, "t": times}), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as out:
            out.write_batch(batch)
        return sink.getvalue().to_pybytes()

    class Batcher(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.waiting = handle.getListState("waiting", "rows binary")
            self.open = handle.getValueState("open", "starts binary, fills binary")

        def handleInputRows(self, key_, rows, timerValues):  # noqa: N802, N803
            first, chunks = None, []
            for part in rows:
                times = part[at].to_numpy(np.int64)
                names = np.zeros(len(part), np.int64) if key_[0] < 0 else part[name].to_numpy()
                chunks.append((packed(pa.array(names), pa.array(times)),))
                first = int(times.min()) if first is None else min(first, int(times.min()))
            if first is not None:
                self.waiting.appendList(chunks)
                self.handle.registerTimer(-(-first // 1000))
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
            passed = 1000 * timerValues.getCurrentWatermarkInMs()
            rows = [pa.ipc.open_stream(data).read_all() for (data,) in self.waiting.get()]
            rows = pa.concat_tables(rows) if rows else pa.table({"k": pa.array([], pa.int64()), "t": pa.array([], pa.int64())})
            ready = pc.less_equal(rows["t"], passed)
            now_, later = rows.filter(ready).sort_by([("k", "ascending"), ("t", "ascending")]), rows.filter(pc.invert(ready))
            held = {}
            if self.open.exists():
                starts, fills = self.open.get()
                starts = pa.ipc.open_stream(starts).read_all()
                held = dict(zip(starts["k"].to_pylist(), zip(starts["t"].to_pylist(), np.frombuffer(fills, np.int64).tolist(), strict=True), strict=True))
            closed, last, start, fill = [], None, None, 0
            for k, now in zip(now_["k"].to_pylist(), now_["t"].to_pylist(), strict=True):
                if k != last:
                    if start is not None:
                        held[last] = start, fill
                    last, (start, fill) = k, held.pop(k, (None, 0))
                if start is not None and now - start > wait:
                    closed.append((k, start, fill, start + wait, True))
                    start = None
                if start is None:
                    start, fill = now, 0
                fill += 1
                if fill == size:
                    closed.append((k, start, fill, now, False))
                    start = None
            if start is not None:
                held[last] = start, fill
            over = [k for k, (start, _) in held.items() if start + wait <= passed]
            for k in over:
                start, fill = held.pop(k)
                closed.append((k, start, fill, start + wait, True))
            if held:
                starts = [start for start, _ in held.values()]
                self.open.update((packed(pa.array(list(held)), pa.array(starts)), np.array([fill for _, fill in held.values()], np.int64).tobytes()))
            else:
                self.open.clear()
            if now_.num_rows and not later.num_rows:
                self.waiting.clear()
            elif now_.num_rows:
                later = later.combine_chunks()
                self.waiting.put([(packed(later["k"].chunk(0), later["t"].chunk(0)),)])
            due = [start + wait for start, _ in held.values()] + ([pc.min(later["t"]).as_py()] if later.num_rows else [])
            if due:
                self.handle.registerTimer(-(-min(due) // 1000))
            if closed:
                out = pd.DataFrame(closed, columns=[name, "start", "n", "closed_us", "timed_out"])
                yield out.assign(**{name: None}) if key[0] < 0 else out

        def close(self) -> None:
            pass

    name, kind = key, df.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, start long, n long, closed_us long, timed_out boolean"
    filled = F.coalesce(F.col(key), F.lit("0").try_cast(kind)).alias(key)  # pandas would turn whole numbers beside nulls into floats
    bucket = F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(buckets))).cast("long").alias("bucket_")
    return df.select(bucket, filled, at, "event_time").groupBy("bucket_").transformWithStateInPandas(Batcher(), schema, "Append", "EventTime")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str) -> None:
    """Process what is there and stop. Every micro-batch is written with its number, replacing what an earlier try of it wrote."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch_id", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/batch_id_={number}")

    spark, setting = stream.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, _ROCKS)  # list state and timers need it, and state larger than memory does
    try:
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
        query.awaitTermination()
    finally:
        spark.conf.set(setting, before) if before else spark.conf.unset(setting)


def latest_state(path_df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Of the updates that the micro-batches wrote, the last of every key."""
    pick = F.max_by(F.struct(*values), "batch_id").alias("r_")
    return path_df.groupBy(*keys).agg(pick).select(*keys, *[F.col(f"r_.{v}").alias(v) for v in values])
