"""Structured Streaming forms of the jobs that are incremental folds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from gleanery import constants as K
from gleanery.operators.landing import land_items

#: Buckets of keys that preferences and mastery have state for, each as one value: a stream keeps the number
#: that it began with.
BUCKETS = 1024


def stream_land_items(raw: DataFrame, feeds: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Land new items of a stream in the Parquet table at `target`: each micro-batch inserts what is
    not there. A batch that runs again finds its own rows and inserts nothing twice. The table is
    partitioned by feed, so a batch reads the keys of its own feeds only."""
    schema = "guid string, link string, content string, pos long, feed_id string"
    spark = raw.sparkSession
    spark.createDataFrame([], schema).write.mode("append").partitionBy("feed_id").parquet(target)

    def land(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        touched = [r["feed_id"] for r in batch.select("feed_id").distinct().collect()]
        landed = batch.sparkSession.read.schema(schema).parquet(target).where(F.col("feed_id").isin(touched)).select("feed_id", "guid")
        land_items(batch, feeds, landed).write.mode("append").partitionBy("feed_id").parquet(target)
        batch.unpersist()

    return raw.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_first_copies(raw: DataFrame, late: str = "2 hours") -> DataFrame:
    """The first copy of each (feed_id, guid) of a stream with seen_at, in bounded state: a key is
    forgotten when the watermark (the newest seen_at less `late`) has passed its first copy by `late`,
    so copies inside that bound are dropped and one that comes later is a first copy again.
    stream_land_items is the exact form, which asks the table instead."""
    keyed = raw.withColumn("guid", F.coalesce("guid", "link", F.lit(""))).where("guid <> ''")
    return keyed.withWatermark("seen_at", late).dropDuplicatesWithinWatermark(["feed_id", "guid"])


class _Silence(StatefulProcessor):
    """Holds when a feed last succeeded (or else was made), and a timer for when that is `hours` ago. The
    timer fires if nothing has moved it by then: the feed is silent."""

    def __init__(self, hours: int):
        self.wait = hours * 3_600_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, failed boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        pdf = pd.concat(list(rows))
        pdf = pdf[pdf["kind"] != "tick"].sort_values("at")
        if not len(pdf):
            return
        at, failed = self.last.get() if self.last.exists() else (None, False)
        for kind, ts in zip(pdf["kind"], pdf["at"]):
            ms = int(pd.Timestamp(ts).timestamp() * 1000)
            if kind == "failed":
                failed = True
            elif kind == "fetched":
                at, failed = ms if at is None else max(at, ms), False
            elif at is None:  # made
                at = ms
        if at is not None:
            self.last.update((at, bool(failed)))
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(max(at + self.wait, timerValues.getCurrentWatermarkInMs() + 1))
        return
        yield

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        at, failed = self.last.get()
        yield pd.DataFrame([(key[0], pd.Timestamp(at, unit="ms"), bool(failed))], columns=["feed_id", "last_seen", "failed"])

    def close(self) -> None:
        pass


def stream_silent_feeds(log: DataFrame, hours: int = K.STALE_HOURS, late: str = "0 seconds") -> DataFrame:
    """(feed_id, last_seen, failed): feeds of a stream (feed_id, kind, at) that were not fetched for
    `hours`, once for each silence, when the event time gets there. kind: made (the feed is there),
    fetched, failed, or tick, which says nothing but what time it is. last_seen is the last success, or
    else when the feed was made; failed says whether an attempt since then failed. Needs the RocksDB
    state store; state is a row a feed."""
    return log.withWatermark("at", late).groupBy("feed_id").transformWithStateInPandas(
        _Silence(hours), outputStructType="feed_id string, last_seen timestamp, failed boolean", outputMode="Append", timeMode="EventTime"
    )


def _bucketed(df: DataFrame, *names: str) -> DataFrame:
    """With the bucket of rows by their key; keys that are long and can be null get a flag beside them, as pandas
    would make floats of them."""
    df = df.withColumn("bucket", F.pmod(F.xxhash64(*names), F.lit(BUCKETS)).cast("int"))
    for c in names:
        if dict(df.dtypes)[c] == "bigint":
            df = df.withColumn(f"no_{c}", F.col(c).isNull()).withColumn(c, F.coalesce(c, F.lit(0).cast("long")))
    return df


def _keys(pdf: pd.DataFrame, *names: str) -> list[tuple]:
    each = []
    for c in names:
        values = pdf[c].tolist()
        if f"no_{c}" in pdf and pdf[f"no_{c}"].any():
            values = [None if no else v for v, no in zip(values, pdf[f"no_{c}"])]
        each.append(values)
    return list(zip(*each))


class _Bucket(StatefulProcessor):
    """Holds the rows of a bucket's keys as one Arrow table of `schema`, so that a micro-batch asks the state
    store once for each bucket and not for each key."""

    schema: pa.Schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("rows", "rows binary")

    def load(self) -> dict[tuple, tuple]:
        """Values by key, which is of the first two columns."""
        if not self.state.exists():
            return {}
        columns = [c.to_pylist() for c in pa.ipc.open_stream(bytes(self.state.get()[0])).read_all().columns]
        return dict(zip(zip(*columns[:2]), zip(*columns[2:])))

    def store(self, rows: dict[tuple, tuple]) -> None:
        columns = [*zip(*rows), *zip(*rows.values())]
        table = pa.table([pa.array(c, f.type) for c, f in zip(columns, self.schema)], schema=self.schema)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, self.schema) as out:
            out.write_table(table)
        self.state.update((sink.getvalue().to_pybytes(),))

    def close(self) -> None:
        pass


class _LastAction(_Bucket):
    """Holds each article's last action and the keys it was counted under; a new judgement takes the old
    weight back and gives the new one, under the keys of its own time. What a micro-batch itself takes back again
    is not given."""

    schema = pa.schema([("tenant", pa.int64()), ("article_id", pa.int64()), ("weight", pa.float64()), ("keys", pa.list_(pa.string()))])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:  # noqa: N802
        pdf = pd.concat(list(rows)).sort_values(["created_at", "event_id"])
        held, new = self.load(), {}
        for k, action, keys in zip(_keys(pdf, "tenant", "article_id"), pdf["action"].tolist(), pdf["keys"].tolist()):
            new[k] = (K.FEEDBACK_WEIGHTS[action], keys)
        tenants, names, deltas = [], [], []
        for k, (weight, keys) in new.items():
            keys = [str(x) for x in keys]
            old, old_keys = held.get(k, (0.0, ()))
            tenants += [k[0]] * (len(old_keys) + len(keys))
            names += [*old_keys, *keys]
            deltas += [-old] * len(old_keys) + [weight] * len(keys)
            held[k] = (weight, keys)
        self.store(held)
        yield pd.DataFrame({"tenant": pd.Series(tenants, dtype=object), "pref_key": pd.Series(names, dtype=object), "delta": pd.Series(deltas, dtype=float)})


def stream_preferences(feedback: DataFrame) -> DataFrame:
    """(tenant, pref_key, delta) of a stream of judgements (tenant, article_id, action, created_at,
    event_id, keys): their sum by key is rebuild_preferences. Needs the RocksDB state store, which has a
    row for each of BUCKETS buckets of (tenant, article_id)."""
    rows = _bucketed(feedback.select("tenant", "article_id", "action", "created_at", "event_id", "keys"), "tenant", "article_id")
    return rows.groupBy("bucket").transformWithStateInPandas(
        _LastAction(), outputStructType="tenant long, pref_key string, delta double", outputMode="Append", timeMode="None"
    )


class _Mastery(_Bucket):
    """Holds each concept's mastery and number of attempts."""

    schema = pa.schema([("tenant", pa.int64()), ("concept_key", pa.string()), ("mastery", pa.float64()), ("attempts", pa.int64())])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:  # noqa: N802
        pdf = pd.concat(list(rows)).sort_values(["created_at", "attempt_id"])
        held, new = self.load(), {}
        for k, level, right in zip(_keys(pdf, "tenant", "concept_key"), pdf["difficulty"].tolist(), pdf["is_correct"].tolist()):
            m, n = new.get(k) or held.get(k) or (K.PRIOR_MASTERY, 0)
            up, down = K.ALPHAS.get(level, K.ALPHAS["medium"])
            new[k] = (min(1.0, max(0.0, m + (up if right else down) * ((1.0 if right else 0.0) - m))), n + 1)
        self.store(held | new)
        out = pd.DataFrame([(*k, *v) for k, v in new.items()], columns=["tenant", "concept_key", "mastery", "attempts"], dtype=object)
        yield out.astype({"mastery": float, "attempts": "int64"})


def stream_mastery(attempts: DataFrame) -> DataFrame:
    """Mastery of each (tenant, concept_key) after every micro-batch that has attempts at it. Attempts
    are in order inside a micro-batch; for late ones mastery_fold over the ledger is the repair. Needs the
    RocksDB state store, which has a row for each of BUCKETS buckets of (tenant, concept_key)."""
    rows = _bucketed(attempts.select("tenant", "concept_key", "difficulty", "is_correct", "created_at", "attempt_id"), "tenant", "concept_key")
    return rows.groupBy("bucket").transformWithStateInPandas(
        _Mastery(), outputStructType="tenant long, concept_key string, mastery double, attempts long", outputMode="Update", timeMode="None"
    )


def stream_source_activity(items: DataFrame, hours: int = K.STALE_HOURS, late: str = "2 hours") -> DataFrame:
    """Items per feed and window of `hours` of a stream (feed_id, published_at): a feed without a row
    for a window that has passed was silent."""
    return items.withWatermark("published_at", late).groupBy(F.window("published_at", f"{hours} hours"), "feed_id").agg(F.count("*").alias("items"))


def run_to_table(stream: DataFrame, target: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run a stream over what is available and write its rows to the Parquet table at `target`."""

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    query = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
