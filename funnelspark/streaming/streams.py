"""Streaming forms of the clickstream operators.

Stateless and windowed forms use Structured Streaming's own state. Forms that need the order of events
(running counts, cart credits) keep each key's state in the state store: rows wait there until the
watermark has passed them, so late rows within the delay are in order. Totals per user are a log of
changes that is merged when it is read.
"""

from __future__ import annotations

import datetime as dt
from contextlib import contextmanager
from itertools import groupby

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..functions import columns as C
from ..operators.labels import JOURNEY, activity_count, label_last_cart
from ..operators.ordered import running_count
from ..operators.score import score_rows
from ..schemas import EVENT_KEYS, EVENTS
from ..session import staging_path


def stream_events(
    spark: SparkSession, path: str, files_per_trigger: int | None = None, fmt: str = "parquet"
) -> DataFrame:
    """Event stream from a folder of files, or from Kafka where ``fmt`` is "kafka".

    For Kafka, ``path`` is "servers/topic" and values are JSON events.
    """
    if fmt == "kafka":
        servers, topic = path.rsplit("/", 1)
        source = (
            spark.readStream.format("kafka")
            .option("kafka.bootstrap.servers", servers)
            .option("subscribe", topic)
            .load()
        )
        return source.select(F.from_json(F.col("value").cast("string"), EVENTS).alias("e")).select("e.*")
    reader = spark.readStream.schema(EVENTS).format(fmt)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.load(path)


def stream_dedup(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """One event per key; state for a key is dropped once the watermark has passed it."""
    return events.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(EVENT_KEYS)


def stream_funnel(
    events: DataFrame, length: str = "1 day", slide: str | None = None, delay: str = "1 hour"
) -> DataFrame:
    """Views, carts and purchases per event-time window, tumbling or sliding."""
    kind = F.trim(F.lower("event_type"))
    frame = F.window("event_time", length, slide) if slide else F.window("event_time", length)
    return (
        events.withWatermark("event_time", delay)
        .groupBy(frame.alias("w"))
        .agg(
            F.count_if(kind == "view").alias("views"),
            F.count_if(kind == "cart").alias("carts"),
            F.count_if(kind == "purchase").alias("purchases"),
        )
        .select(
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            "views", "carts", "purchases",
        )
    )


def stream_session_windows(
    events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour"
) -> DataFrame:
    """Events per session and burst of activity (bursts end after the gap)."""
    return (
        events.withWatermark("event_time", delay)
        .groupBy("user_session", F.session_window("event_time", gap).alias("w"))
        .agg(F.count("*").alias("events"))
        .select(
            "user_session",
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            "events",
        )
    )


def stream_score(rows: DataFrame, threshold: float | None = None, model=None) -> DataFrame:
    """Score a stream of full feature rows with a fitted model or, without one, by the heuristic."""
    return score_rows(rows, threshold) if model is None else model.transform(rows)


def run_available(
    stream: DataFrame, out: str, mode: str = "append", name: str = "stream"
) -> None:
    """Process all available input to a Parquet folder and stop.

    In complete mode each micro-batch replaces the folder.
    """
    spark = stream.sparkSession
    writer = stream.writeStream.outputMode(mode).option(
        "checkpointLocation", staging_path(spark, f"{name}-progress")
    )
    if mode == "append":
        query = writer.format("parquet").trigger(availableNow=True).start(out)
    else:
        query = (
            writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out))
            .trigger(availableNow=True)
            .start()
        )
    query.awaitTermination()


def _folder(spark: SparkSession, path: str):
    """(file system, path) of a folder."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def _listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it is not there."""
    fs, folder = _folder(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []


def _names(spark: SparkSession, path: str) -> list[int]:
    """Names in a folder that are numbers."""
    return [int(n) for n in _listed(spark, path) if n.isdigit()]


def _numbered(spark: SparkSession, path: str, key: str) -> list[int]:
    """Numbers n of the folders ``key=n`` under a path, in ascending order."""
    return sorted(int(n.split("=")[1]) for n in _listed(spark, path) if n.startswith(f"{key}="))


def _bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files in a folder."""
    fs, folder = _folder(spark, path)
    return fs.getContentSummary(folder).getLength()


def _drop(spark: SparkSession, path: str) -> None:
    """Remove a superseded folder."""
    fs, folder = _folder(spark, path)
    fs.delete(folder, True)


# State lives in RocksDB on the executors; a micro-batch uploads what it changed, not the whole state.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def _state_store(spark: SparkSession):
    """Streams started inside keep their state in the store; the session's settings come back."""
    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _in_order(row) -> tuple:
    """Sort key with nulls first, as in a batch sort."""
    return tuple((v is not None, v) for v in row)


# Keys are dealt into so many buckets by a hash. A bucket is what the store groups, holds in order and has timers for, so
# a micro-batch makes a few calls to the store per bucket and not per key.
BUCKETS = 512
# Rows that one call puts into the store.
CALL_ROWS = 5000


class InOrder(StatefulProcessor):
    """Holds the rows of a bucket until the watermark has passed them, then hands them on per key in event order.

    Rows begin with their key, then come the columns of ``waiting_schema``: first their time in microseconds. What
    is remembered is a map from key to ``memory_schema``; only keys with rows that are final are looked up in it.
    Where memory ends, that of the bucket is gone through when its timer fires. Each bucket has at most one timer:
    for its first waiting row, or for the first end of what it remembers. Rows that come after the watermark
    has passed them are handed on at once as late ones.
    """

    key_schema = ""
    waiting_schema = ""
    memory_name = ""
    memory_schema = ""
    #: Whether what is remembered may be dropped some time.
    forgets = False

    def init(self, handle) -> None:
        self.handle = handle
        self.width = len(self.key_schema.split(","))
        self.waiting = handle.getListState("waiting", f"{self.key_schema}, {self.waiting_schema}")
        self.memory = handle.getMapState(self.memory_name, self.key_schema, self.memory_schema)

    def passed(self, key: tuple, rows: list[tuple]):
        """Result rows for rows of a key that are final, in order; updates what is remembered of the key."""
        raise NotImplementedError

    def late(self, key: tuple, row: tuple):
        """Result row for a late row."""
        raise NotImplementedError

    def end(self, value: tuple) -> int:
        """When, in microseconds, what is remembered may be dropped."""
        raise NotImplementedError

    def ended(self, key: tuple, value: tuple):
        """Result rows for what is dropped."""
        return []

    def _remind(self, first: int | None) -> None:
        """One timer, for the first waiting row or the end of a memory."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if first is not None:
            # One more millisecond: a timer fires when the watermark is past its time.
            self.handle.registerTimer(first // 1000 + 1)

    def _wait(self, rows: list[tuple]) -> None:
        for i in range(0, len(rows), CALL_ROWS):
            self.waiting.appendList(rows[i : i + CALL_ROWS])

    def handleInputRows(self, key, rows, timerValues):
        passed, width = timerValues.getCurrentWatermarkInMs() * 1000, self.width
        fresh, first = [], None
        for row in rows:
            row = tuple(row)[1:]
            at = row[width]
            if at is None or at <= passed:
                yield self.late(row[:width], row[width:])
                continue
            fresh.append(row)
            first = at if first is None else min(first, at)
            if len(fresh) == CALL_ROWS:
                self._wait(fresh)
                fresh = []
        self._wait(fresh)
        if first is not None:
            due = list(self.handle.listTimers())
            if not due or first // 1000 + 1 < min(due):
                self._remind(first)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed, width = timerValues.getCurrentWatermarkInMs() * 1000, self.width
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        final = sorted((r for r in held if r[width] <= passed), key=_in_order)
        rest = [r for r in held if r[width] > passed]
        for own, rows in groupby(final, key=lambda r: r[:width]):
            yield from self.passed(own, [r[width:] for r in rows])
        if final:
            self.waiting.clear()
            self._wait(rest)
        times = [r[width] for r in rest]
        if self.forgets:
            waits = {r[:width] for r in rest}
            for own, value in [(tuple(k), tuple(v)) for k, v in self.memory.iterator()]:
                end = self.end(value)
                if end < passed and own not in waits:
                    yield from self.ended(own, value)
                    self.memory.removeKey(own)
                else:
                    times.append(end)
        self._remind(min(times, default=None))

    def close(self) -> None:
        pass


class _Keyed:
    """Base of the forms that keep the state of each key in the state store.

    Results, late rows and dropped state go to one file sink, told apart by ``kind``. A finished job can be
    started again on the same folder, with new input or without: the store goes on where it was, and
    what a closing run takes as final is computed from a snapshot of the state, which it does not change.
    Keys share buckets, and a micro-batch reads and writes what waits in its own buckets and in those whose timers
    are due; of what is remembered, the keys with final rows. The rows of one bucket in a micro-batch are
    handled by one task, so a trigger should bound its input.
    """

    keys: list[str] = []
    out_schema = ""

    def __init__(self, spark: SparkSession, root: str, delay: dt.timedelta):
        self.spark, self.root, self.delay = spark, root, delay
        self.out, self.progress = f"{root}/out", f"{root}/progress"

    @property
    def last_batch(self) -> int:
        """The last micro-batch that was finished, -1 before the first."""
        return max(_names(self.spark, f"{self.progress}/commits"), default=-1)

    def prepare(self, events: DataFrame) -> DataFrame:
        """The keys, then the columns of a waiting row; its time as ``at`` in microseconds."""
        raise NotImplementedError

    def processor(self) -> InOrder:
        raise NotImplementedError

    def stream(self, events: DataFrame) -> DataFrame:
        """The stream of results. Its watermark is that of the events, which do not carry it further: late rows
        reach the processor instead of being dropped."""
        seconds = f"{self.delay.total_seconds()} seconds"
        rows = self.prepare(events.withWatermark("event_time", seconds))
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(BUCKETS)).alias("_bucket")
        grouped = rows.select(bucket, "*").groupBy("_bucket")
        return grouped.transformWithState(self.processor(), self.out_schema, "Append", "EventTime")

    def start(self, events: DataFrame) -> StreamingQuery:
        """Start over all available input."""
        writer = self.stream(events).writeStream.partitionBy("kind").option("checkpointLocation", self.progress)
        with _state_store(self.spark):
            return writer.format("parquet").trigger(availableNow=True).start(self.out)

    def state(self, name: str, listed: bool = False) -> DataFrame:
        """A state variable of all keys as of the last micro-batch: the keys and its fields."""
        reader = self.spark.read.format("statestore").option("stateVarName", name)
        found = reader.option("flattenCollectionTypes", "true").load(self.progress)
        return found.select("list_element.*") if listed else found.select("user_map_key.*", "user_map_value.*")

    def _written(self, kind: str) -> DataFrame:
        """Rows of a kind over all micro-batches."""
        schema = T.StructType.fromDDL(self.out_schema)
        if self.last_batch < 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.out).filter(F.col("kind") == kind)

    def closing(self) -> DataFrame:
        """Results of what still waits, after what the keys remember."""
        raise NotImplementedError

    def results(self) -> DataFrame:
        """Results of all micro-batches."""
        raise NotImplementedError

    def run(self, events: DataFrame) -> DataFrame:
        """Process all available input, then treat what still waits as final; all results."""
        self.start(events).awaitTermination()
        if self.last_batch < 0:
            return self.results()
        closing = self.closing()
        closing.write.mode("overwrite").parquet(f"{self.root}/closing")
        closed = self.spark.read.schema(closing.schema).parquet(f"{self.root}/closing")
        return self.results().unionByName(closed)


CREDITED = Row(*JOURNEY, "kind", "event_type", "at", "cart_at")
COUNTED = Row("user_session", "kind", "at", "event_type", "product_id", "user_id", "activity_count")


class _Credit(InOrder):
    """Remembers the last cart of a journey."""

    key_schema = "user_id bigint, product_id bigint, user_session string"
    waiting_schema = "at bigint, event_type string"
    memory_name, memory_schema = "cart", "at bigint"

    def __init__(self, limit: int | None):
        self.limit, self.forgets = limit, limit is not None

    def _row(self, key, kind, event_type, at, cart):
        return CREDITED(*key, kind, event_type, at, cart)

    def passed(self, key, rows):
        cart = fresh = instant = pending = None
        known = False
        # Carts of an instant are not earlier than its purchases.
        for at, event_type in rows:
            if at != instant:
                if pending is not None:
                    cart, known = pending, True
                instant, pending = at, None
            if event_type == "cart":
                fresh = pending = at
                continue
            if not known:
                # Only a purchase ahead of all new carts asks for the remembered one.
                before = self.memory.getValue(key)
                cart, known = None if before is None else before[0], True
            if cart is not None and (self.limit is None or at - cart <= self.limit):
                yield self._row(key, "result", event_type, at, cart)
        if fresh is not None:
            self.memory.updateValue(key, (fresh,))

    def late(self, key, row):
        return self._row(key, "late", row[1], row[0], None)

    def end(self, value):
        return value[0] + self.limit

    def ended(self, key, value):
        yield self._row(key, "expired", "cart", value[0], None)


class StreamCartLabel(_Keyed):
    """Credits of purchases to their last earlier cart, in event-time order.

    The state of a journey is its last cart and the carts and purchases the watermark has not passed. With a
    ``bound``, carts older than that at the watermark are dropped and later purchases are not credited;
    such carts go to ``expired()``, and the state holds the journeys of the bound only. Without one the
    credits are those of a batch run. (A join of the two streams would form all pairs of a journey.)
    """

    keys = JOURNEY
    out_schema = (
        "user_id bigint, product_id bigint, user_session string, kind string, event_type string, "
        "at bigint, cart_at bigint"
    )

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        delay: dt.timedelta = dt.timedelta(hours=1),
        bound: dt.timedelta | None = None,
    ):
        super().__init__(spark, root, delay)
        self.limit = None if bound is None else bound // dt.timedelta(microseconds=1)

    def prepare(self, events: DataFrame) -> DataFrame:
        named = events.filter(F.col("event_type").isin("cart", "purchase")).dropna(subset=JOURNEY)
        return named.select(*JOURNEY, F.unix_micros("event_time").alias("at"), "event_type")

    def processor(self) -> InOrder:
        return _Credit(self.limit)

    def _side(self, kind: str) -> DataFrame:
        return self._written(kind).select(*JOURNEY, "event_type", F.timestamp_micros("at").alias("event_time"))

    def late(self) -> DataFrame:
        """Rows that came too late and are in no result."""
        return self._side("late")

    def expired(self) -> DataFrame:
        """Last carts of journeys that were dropped because of the bound."""
        return self._side("expired")

    def results(self) -> DataFrame:
        return self._written("result").select(
            *JOURNEY, F.timestamp_micros("at").alias("purchase_time"), F.timestamp_micros("cart_at").alias("cart_time")
        )

    def closing(self) -> DataFrame:
        waits = self.state("waiting", listed=True).select(*JOURNEY, "event_type", "at")
        carts = self.state("cart").select(*JOURNEY, F.lit("cart").alias("event_type"), "at")
        rows = waits.unionByName(carts).withColumn("event_time", F.timestamp_micros("at")).drop("at")
        credits = label_last_cart(rows).drop("earlier_carts")
        if self.limit is None:
            return credits
        gap = F.unix_micros("purchase_time") - F.unix_micros("cart_time")
        return credits.filter(gap <= self.limit)


class _Count(InOrder):
    """Remembers the number of events of a session, and the last one's time."""

    key_schema = "user_session string"
    waiting_schema = "at bigint, event_type string, product_id bigint, user_id bigint"
    memory_name, memory_schema = "total", "n bigint, last bigint"

    def __init__(self, timeout: int | None):
        self.timeout, self.forgets = timeout, timeout is not None

    def passed(self, key, rows):
        n, last = self.memory.getValue(key) or (0, None)
        for row in rows:
            if self.timeout is not None and last is not None and row[0] - last > self.timeout:
                n = 0
            n, last = n + 1, row[0]
            yield COUNTED(*key, "result", *row, n)
        self.memory.updateValue(key, (n, last))

    def late(self, key, row):
        return COUNTED(*key, "late", *row, None)

    def end(self, value):
        return value[1] + self.timeout


class StreamActivityCount(_Keyed):
    """Running count of events per session, in event-time order.

    The state of a session is its count and the rows the watermark has not passed. With a ``timeout``, an event that
    comes longer after the one before it is number 1 again, and the counts of sessions idle for longer at the
    watermark are dropped. Without one the counts are those of a batch run and are kept for good.
    """

    keys = ["user_session"]
    out_schema = (
        "user_session string, kind string, at bigint, event_type string, product_id bigint, user_id bigint, "
        "activity_count bigint"
    )

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        delay: dt.timedelta = dt.timedelta(hours=1),
        timeout: dt.timedelta | None = None,
    ):
        super().__init__(spark, root, delay)
        self.timeout = None if timeout is None else timeout // dt.timedelta(microseconds=1)

    def prepare(self, events: DataFrame) -> DataFrame:
        return events.select(
            "user_session", F.unix_micros("event_time").alias("at"), "event_type", "product_id", "user_id"
        )

    def processor(self) -> InOrder:
        return _Count(self.timeout)

    @staticmethod
    def _timed(df: DataFrame) -> DataFrame:
        return df.withColumn("event_time", F.timestamp_micros("at")).drop("at", "kind")

    def late(self) -> DataFrame:
        """Rows that came too late and are in no result."""
        return self._timed(self._written("late")).drop("activity_count")

    def results(self) -> DataFrame:
        return self._timed(self._written("result"))

    def closing(self) -> DataFrame:
        waits = self._timed(self.state("waiting", listed=True))
        total = self.state("total").select(F.col("user_session").alias("_s"), F.col("n").alias("_n"), F.col("last").alias("_t"))
        same = F.col("user_session").eqNullSafe(F.col("_s"))
        if self.timeout is None:
            rows = activity_count(waits).join(total, same, "left")
            count = F.col("activity_count") + F.coalesce("_n", F.lit(0))
            return rows.withColumn("activity_count", count).drop("_s", "_n", "_t")
        # A burst is what lies between two long gaps; the first one goes on from the state.
        at = F.unix_micros("event_time")
        before = F.lag(at).over(Window.partitionBy("user_session").orderBy("event_time"))
        rows = waits.join(total, same, "left").withColumn("_was", F.coalesce(before, "_t"))
        rows = rows.withColumn("_new", F.coalesce(at - F.col("_was") > self.timeout, F.lit(False)).cast("int"))
        upto = Window.partitionBy("user_session").orderBy("event_time").rangeBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("_burst", F.sum("_new").over(upto))
        counted = running_count(
            rows, ["user_session", "_burst"], "event_time", ["event_type", "product_id", "user_id"], "activity_count"
        )
        count = F.col("activity_count") + F.when(F.col("_burst") == 0, F.coalesce("_n", F.lit(0))).otherwise(0)
        return counted.withColumn("activity_count", count).select(
            "user_session", "event_type", "product_id", "user_id", "activity_count", "event_time"
        )


class DeltaLog:
    """A keyed table of mergeable rows, appended to by every micro-batch and merged when it is read.

    A run holds the rows of the micro-batches from its first to its last. A batch writes a run of its own rows; while
    the run before is not ``factor`` times as large as the newest, both are merged into one. So a batch
    writes what it changed, and each row is written again only as often as sizes have grown by the
    factor. What a batch merges stays until the batch after it, so a batch can be run again.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, merge, factor: int = 4):
        self.spark, self.path, self.schema = spark, path, schema
        self.merge, self.factor = merge, factor

    def _path(self, run: tuple[int, int]) -> str:
        return f"{self.path}/run={run[0]}-{run[1]}"

    def _complete(self) -> list[tuple[int, int]]:
        """(first, last) of every finished run."""
        found = []
        for name in _listed(self.spark, self.path):
            if name.startswith("run=") and "_SUCCESS" in _listed(self.spark, f"{self.path}/{name}"):
                first, last = name[4:].split("-")
                found.append((int(first), int(last)))
        return found

    def runs(self, batch_id: int) -> list[tuple[int, int]]:
        """The fewest runs that hold the batches up to ``batch_id``, oldest first."""
        complete, out, last = self._complete(), [], batch_id
        while last >= 0:
            # Of the runs that end there, the one that reaches back furthest.
            first = min((a for a, b in complete if b == last), default=None)
            if first is not None:
                out.append((first, last))
            last = last - 1 if first is None else first - 1
        return out[::-1]

    def size(self, run: tuple[int, int]) -> int:
        """Bytes of a run."""
        return _bytes(self.spark, self._path(run))

    def read(self, runs: list[tuple[int, int]]) -> DataFrame:
        """Merged rows of runs."""
        if not runs:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(*[self._path(r) for r in runs])
        return rows if len(runs) == 1 else self.merge(rows)

    def after(self, batch_id: int) -> DataFrame:
        """The merged table as of the end of a batch."""
        return self.read(self.runs(batch_id))

    def append(self, rows: DataFrame, batch_id: int) -> None:
        """Add the rows of a batch (one per key), in place of those of an earlier try."""
        for run in self._complete():
            if run[1] >= batch_id:
                _drop(self.spark, self._path(run))
        rows.write.mode("overwrite").parquet(self._path((batch_id, batch_id)))
        runs = self.runs(batch_id)
        size, take = self.size(runs[-1]), 1
        while take < len(runs) and self.size(runs[-take - 1]) < self.factor * size:
            take += 1
            size += self.size(runs[-take])
        if take > 1:
            self.read(runs[-take:]).write.mode("overwrite").parquet(self._path((runs[-take][0], batch_id)))
        needed = {*self.runs(batch_id), *self.runs(batch_id - 1)}
        for run in self._complete():
            if run not in needed:
                _drop(self.spark, self._path(run))


class StreamUserFeatures:
    """Per-user totals as a log of additive changes; distinct counts are sketches."""

    schema = (
        "user_id bigint, user_total_events bigint, user_total_views bigint, "
        "user_total_carts bigint, user_total_purchases bigint, purchase_sum double, "
        "products binary, categories binary"
    )

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.log = DeltaLog(spark, f"{root}/log", self.schema, self.merged)

    @property
    def last_batch(self) -> int:
        """The last micro-batch that was finished, -1 before the first."""
        return max(_numbered(self.spark, f"{self.root}/done", "batch"), default=-1)

    @staticmethod
    def partial(events: DataFrame) -> DataFrame:
        """Totals of one micro-batch, with mergeable sketches."""

        def kind(name: str):
            return F.col("event_type") == name

        level1 = F.lower(F.coalesce(C.level1("category_code"), F.lit(C.UNKNOWN)))
        return events.groupBy("user_id").agg(
            F.count("*").alias("user_total_events"),
            F.count_if(kind("view")).alias("user_total_views"),
            F.count_if(kind("cart")).alias("user_total_carts"),
            F.count_if(kind("purchase")).alias("user_total_purchases"),
            F.coalesce(F.sum(F.when(kind("purchase"), F.col("price"))), F.lit(0.0)).alias("purchase_sum"),
            F.hll_sketch_agg("product_id").alias("products"),
            F.hll_sketch_agg(level1).alias("categories"),
        )

    @staticmethod
    def merged(rows: DataFrame) -> DataFrame:
        """One row per user from the partial totals of several batches."""
        totals = ["user_total_events", "user_total_views", "user_total_carts", "user_total_purchases", "purchase_sum"]
        return rows.groupBy("user_id").agg(
            *[F.sum(c).alias(c) for c in totals],
            F.hll_union_agg("products").alias("products"),
            F.hll_union_agg("categories").alias("categories"),
        )

    def step(self, events: DataFrame, batch_id: int) -> None:
        """Append the totals of the users of one micro-batch."""
        self.log.append(self.partial(events), batch_id)
        self.spark.range(1).write.mode("overwrite").parquet(f"{self.root}/done/batch={batch_id}")

    def features(self) -> DataFrame:
        """User features as of the last micro-batch."""
        rates = {
            "user_avg_purchase_price": C.guarded_rate("purchase_sum", "user_total_purchases"),
            "user_unique_products": F.hll_sketch_estimate("products"),
            "user_unique_categories": F.hll_sketch_estimate("categories"),
            "user_view_to_cart_rate": C.guarded_rate("user_total_carts", "user_total_views"),
            "user_cart_to_purchase_rate": C.guarded_rate("user_total_purchases", "user_total_carts"),
        }
        return self.log.after(self.last_batch).withColumns(rates).drop(
            "purchase_sum", "products", "categories"
        )

    def run(self, events: DataFrame) -> DataFrame:
        """Process all available input; the resulting features."""
        query = (
            events.writeStream.foreachBatch(self.step)
            .option("checkpointLocation", f"{self.root}/progress")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        return self.features()
