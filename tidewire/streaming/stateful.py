"""Streams with state of their own: clusters that hang on their head, memories that expire, rings of samples.

Each keeps a bounded state for a key in the state store, which is restored from the checkpoint,
and drops it by timers of event time; no table is rewritten.  Keys are dealt to BUCKETS, and the
state of a bucket's keys is one value of the store: a visit to it costs the same for one key as for
all of the bucket, so where a micro-batch brings very many keys they share it.  Micro-batches come
in the order of time; within one, a key's rows may have any order.  The session needs the RocksDB
state store (``use_state_store``).
"""
from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from itertools import groupby
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.dates import news_time

HOUR, MINUTE, DAY = 3_600_000_000, 60_000_000, 86_400_000_000  # microseconds
#: Hours of a cluster, of a remembered name, days of a remembered link, slots and minutes of a baseline.
CLUSTER_HOURS, NAME_HOURS, LINK_DAYS, SLOTS, THROTTLE_MINUTES = 48, 2, 30, 168, 55

#: Buckets of keys.  A bucket is read and written whole wherever a micro-batch has one of its keys; a stream's checkpoint holds
#: to the number that it began with.
BUCKETS = 1 << 12

#: How far the rows of later batches may lie back: what lies back farther is left out, so never none at all,
#: or a row of the very time of the last one would be lost.
LATE = "10 minutes"


def use_state_store(spark: SparkSession) -> None:
    """Let new streams of the session keep their state in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Bucket(StatefulProcessor):
    """Entries of a bucket's keys, which are dropped once the watermark has passed the time they are good for.

    Rows are (bucket, key, at, value, time), in any order.  An entry is a tuple of what ``entry``
    says, and begins with the time it was last good at.
    """

    entry: tuple[tuple[str, str], ...]

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        columns = ", ".join(f"{name} array<{kind}>" for name, kind in (("key", "string"), *self.entry))
        self.handle, self.held = handle, handle.getValueState("held", f"due long, {columns}")

    def advance(self, key: str, entry: tuple | None, rows: Iterator[tuple]) -> Iterator[Row | tuple]:
        """What the rows of a key give out, in the order of time and value, and last of all its entry as a plain tuple."""
        raise NotImplementedError

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        due, entries = self._read()
        for name, mine in groupby(sorted(r[1:4] for r in rows), lambda r: r[0]):
            for out in self.advance(name, entries.get(name), mine):
                if isinstance(out, Row):
                    yield out
                else:
                    entries[name] = out
        self._write(due, entries)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        due, entries = self._read()
        now = timerValues.getCurrentWatermarkInMs()
        left = {name: entry for name, entry in entries.items() if self._until(entry) > now}
        if left:
            self._write(None if due is not None and due <= now else due, left)
        elif entries:
            self.held.clear()
        return iter(())

    def close(self) -> None:
        pass

    def _until(self, entry: tuple) -> int:
        """The watermark, in milliseconds, from which an entry is good for nothing."""
        return (entry[0] + self.limit) // 1000 + 2

    def _read(self) -> tuple[int | None, dict[str, tuple]]:
        """When the bucket's timer is due, and its entries."""
        if not self.held.exists():
            return None, {}
        due, names, *columns = self.held.get()
        return due, dict(zip(names, zip(*columns)))

    def _write(self, due: int | None, entries: dict[str, tuple]) -> None:
        """Keep the entries.  A bucket has one timer, due when its first entry is, or earlier, where that has got newer since."""
        if due is None:
            due = min(map(self._until, entries.values()))
            self.handle.registerTimer(due)
        self.held.update((due, list(entries), *map(list, zip(*entries.values()))))


def _bucketed(rows: DataFrame, state: _Bucket, schema: str, late: str, buckets: int) -> DataFrame:
    """What a state gives out over rows (key, at, value, time)."""
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket")
    held = rows.select(bucket, "key", "at", "value", "time").withWatermark("time", late).groupBy("bucket")
    return held.transformWithState(state, schema, "Append", "EventTime")


_HEAD = Row("id", "head_id")


class _Heads(_Bucket):
    entry = (("at", "long"), ("id", "long"))

    def advance(self, key: str, entry: tuple | None, rows: Iterator[tuple]) -> Iterator[Row | tuple]:
        head = entry
        for _, at, id_ in rows:
            if head is None or at - head[0] > self.limit:
                head = (at, id_)
            yield _HEAD(id_, head[1])
        yield head


def cluster_heads(articles: DataFrame, hours: int = CLUSTER_HOURS, late: str = LATE, buckets: int = BUCKETS) -> DataFrame:
    """``stories.clusters`` of a stream of articles (id, title_signature, published_at, first_seen_at): (id, head_id).

    A signature's state is its open head, for ``hours`` after it.  An article without a time or
    a signature stands alone.
    """
    at = news_time("published_at", "first_seen_at").cast("timestamp")
    rows = articles.select(F.col("id").alias("value"), F.col("title_signature").alias("key"), at.alias("time"), F.unix_micros(at).alias("at"))
    known = "coalesce(key, '') <> '' and at is not null"
    found = _bucketed(rows.where(known), _Heads(hours * HOUR), "id long, head_id long", late, buckets)
    return found.unionByName(rows.where(f"not ({known})").select(F.col("value").alias("id"), F.col("value").alias("head_id")))


_SIGHTING = Row("key", "at", "known", "first", "n")


class _Memory(_Bucket):
    entry = (("last", "long"), ("first", "long"), ("n", "long"))

    def __init__(self, limit: int, closed: bool):
        super().__init__(limit)
        self.closed = closed

    def advance(self, key: str, entry: tuple | None, rows: Iterator[tuple]) -> Iterator[Row | tuple]:
        for _, at, n in rows:
            known = entry is not None and (at - entry[0] < self.limit or self.closed and at - entry[0] == self.limit)
            entry = (at, entry[1], entry[2] + n) if known else (at, at, n)
            yield _SIGHTING(key, at, known, entry[1], entry[2])
        yield entry


def _remembered(rows: DataFrame, limit: int, closed: bool, late: str, buckets: int) -> DataFrame:
    """Each sighting (key, time, n) with whether its key was seen within the limit before, since when, and how often since then."""
    at = F.col("time").cast("timestamp")
    rows = rows.where("key is not null and time is not null").select("key", at.alias("time"), F.unix_micros(at).alias("at"), F.col("n").alias("value"))
    found = _bucketed(rows, _Memory(limit, closed), "key string, at long, known boolean, first long, n long", late, buckets)
    moment = lambda c: F.expr(f"cast(timestamp_micros({c}) as timestamp_ntz)")
    return found.select("key", moment("at").alias("seen_at"), "known", moment("first").alias("first_seen_at"), "n")


def names_seen(names: DataFrame, hours: int = NAME_HOURS, late: str = LATE, buckets: int = BUCKETS) -> DataFrame:
    """Names of a stream of snapshots (name, seen_at), and whether each was in one at most ``hours`` before.

    Returns key, seen_at, known, first_seen_at and n (sightings since then).  A null name or time is left out.
    """
    return _remembered(names.select(F.col("name").alias("key"), F.col("seen_at").alias("time"), F.lit(1).cast("long").alias("n")), hours * HOUR, True, late, buckets)


def link_history(links: DataFrame, days: int = LINK_DAYS, late: str = LATE, buckets: int = BUCKETS) -> DataFrame:
    """The history of links (a, b, seen_at, n) of a stream: an entry not seen for ``days`` is forgotten and begins anew.

    Returns key (both ends in the order of letters, joined by a bar), seen_at, known,
    first_seen_at and n (the sum since then).  A null end, time or count is left out.
    """
    key = F.concat_ws("|", F.least("a", "b"), F.greatest("a", "b"))
    rows = links.where("a is not null and b is not null and n is not null")
    return _remembered(rows.select(key.alias("key"), F.col("seen_at").alias("time"), F.col("n").cast("long").alias("n")), days * DAY, False, late, buckets)


_SAMPLE = Row("key", "at", "slots", "total")


class _Ring(_Bucket):
    entry = (("at", "long"), ("ring", "array<long>"))

    def __init__(self, limit: int, slots: int, gap: int):
        super().__init__(limit)
        self.slots, self.gap = slots, gap

    def advance(self, key: str, entry: tuple | None, rows: Iterator[tuple]) -> Iterator[Row | tuple]:
        last, ring = entry or (None, ())
        ring = deque(ring, self.slots)
        total = sum(ring)
        for _, at, n in rows:
            if last is not None and at - last < self.gap:
                continue
            total += n - (ring[0] if len(ring) == self.slots else 0)
            ring.append(n)
            last = at
            yield _SAMPLE(key, at, len(ring), total)
        yield (last, list(ring))


def baselines(samples: DataFrame, slots: int = SLOTS, minutes: int = THROTTLE_MINUTES, days: int = 180, late: str = LATE, buckets: int = BUCKETS) -> DataFrame:
    """The baseline of each entity after each sample that counts, of a stream of samples (name, seen_at, mentions).

    A sample counts if the last one that did is ``minutes`` or more before it; the ring keeps the
    last ``slots``.  Returns key, seen_at, slots (samples in the ring) and rate, their mean.  An
    entity without a sample for ``days`` loses its ring.  A null name, time or count is left out;
    of samples of one moment the smallest counts.
    """
    at = F.col("seen_at").cast("timestamp")
    rows = samples.where("name is not null and seen_at is not null and mentions is not null")
    rows = rows.select(F.col("name").alias("key"), at.alias("time"), F.unix_micros(at).alias("at"), F.col("mentions").cast("long").alias("value"))
    found = _bucketed(rows, _Ring(days * DAY, slots, minutes * MINUTE), "key string, at long, slots int, total long", late, buckets)
    return found.select("key", F.expr("cast(timestamp_micros(at) as timestamp_ntz)").alias("seen_at"), "slots", (F.col("total") / F.col("slots")).alias("rate"))
