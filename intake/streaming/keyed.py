"""Streams with state per key that take events in any order within the watermark's delay, and end their state.

A key's events rest in a list until the watermark has passed them, and are then folded in order of time and id, so that the order of arrival doesn't matter. An event that
comes after that is not folded but given back with ``too_late``. Timers are in event time: a claim frees itself, and what has ended is forgotten ``FORGET`` later
(until then further events of the key are passed over, as the batch forms do). Rows without a key or kind only move the clock.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from intake.operators.attribution import GRACE, LATE_TAIL, WATCH_AFTER
from intake.operators.documents import LATER, MAX_FORMS, MAX_PAGES, UNCODED_SCHOOLS

MINUTE, DAY = 60 * 10**6, 86_400 * 10**6
#: A claim older than this goes back to the queue; tries before a page or file has failed; how long what has ended is remembered; how late events may come. Times in microseconds.
CLAIM, TRIES, FORGET, DELAY = 10 * MINUTE, 3, DAY, "2 hours"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """Chooses the state store that lists and timers need; to be called before such a stream starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def micros(gap: str) -> int:
    """A gap such as ``interval 10 minutes`` in microseconds."""
    number, unit = gap.removeprefix("interval ").split()
    return int(number) * {"second": 10**6, "minute": MINUTE, "hour": 60 * MINUTE, "day": DAY}[unit.rstrip("s")]


class InOrder(StatefulProcessor):
    """Buffers a key's rows (time in microseconds first) and hands those that the watermark has passed, in order, to ``fold``."""

    #: Schema of the rows, of what is kept between folds, and how many of the first columns give the order.
    rows: str
    memory: str
    order: int
    #: Schema of the rows given.
    out: str

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buffer = handle.getListState("buffer", self.rows)
        self.kept = handle.getValueState("kept", self.memory)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        passed, fresh = timerValues.getCurrentWatermarkInMs(), []
        for row in rows:
            values = tuple(row)[1:]
            if key[0] is None:
                continue
            if values[0] is None or values[0] // 1000 < passed:
                yield self.too_late(key[0], values)
            else:
                fresh.append(values)
        if fresh:
            self.buffer.appendList(fresh)
            self.handle.registerTimer(min(v[0] for v in fresh) // 1000 + 1)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        held = [tuple(r) for r in self.buffer.get()] if self.buffer.exists() else []
        due = sorted((r for r in held if r[0] // 1000 < passed), key=lambda r: r[: self.order])
        if due:
            rest = [r for r in held if r[0] // 1000 >= passed]
            if rest:
                self.buffer.put(rest)
                self.handle.registerTimer(min(r[0] for r in rest) // 1000 + 1)
            else:
                self.buffer.clear()
        old = tuple(self.kept.get()) if self.kept.exists() else None
        new, found, wake = self.fold(key[0], old, due, passed * 1000)
        if new is None:
            self.kept.clear()
        elif new != old:
            self.kept.update(new)
        if wake is not None:
            self.handle.registerTimer(wake // 1000 + 1)
        yield from found

    def row(self, *values: Any) -> Row:
        return Row(**dict(zip((c.split()[0] for c in self.out.split(", ")), values, strict=True)))

    def close(self) -> None:
        pass

    def fold(self, key: Any, kept: tuple | None, due: list[tuple], passed: int) -> tuple[tuple | None, list[Row], int | None]:
        """What is kept from now on (None: nothing), rows to give, and when to be called again at the latest."""
        raise NotImplementedError

    def too_late(self, key: Any, values: tuple) -> Row:
        raise NotImplementedError


def _run(events: DataFrame, clock: Column, delay: str, key: str, columns: list[Column], fold: InOrder, mode: str) -> DataFrame:
    """``events`` by key through a processor; the watermark is on a copy of the time, so that late rows reach it too."""
    timed = events.withColumn("_clock", clock.cast("timestamp")).withWatermark("_clock", delay)
    rows = timed.select(F.col(key), F.unix_micros("_clock").alias("us"), *columns)
    return rows.groupBy(key).transformWithState(fold, fold.out, mode, "EventTime")


_PLACED = "file_id long, folder_id int, created long, batch_id long, batch_school string, place string, tail_batch_id long, tail_school string, late string, too_late boolean"
_EVENT = pa.schema([("us", pa.int64()), ("id", pa.int64()), ("kind", pa.string()), ("school", pa.string())])
#: Keys that the files of a folder are dealt over, each of which has all its marks; rows of a piece of state or output.
SHARES, PIECE = 4, 1 << 16
NOTHING = -(1 << 63)


def _pack(rows: pa.Table) -> list[tuple[bytes]]:
    """Rows as pieces of bytes, for a list state."""
    return [(b.schema.serialize().to_pybytes() + b.serialize().to_pybytes(),) for b in rows.combine_chunks().to_batches(PIECE)]


def _unpack(pieces: Iterator[tuple]) -> pa.Table:
    return pa.Table.from_batches([b for (piece,) in pieces for b in pa.ipc.open_stream(bytes(piece))], _EVENT)


class _Attribution(StatefulProcessor):
    """As ``InOrder``, over whole batches: a folder's marks are folded in order, and its files find theirs by time. ``key``: folder ('' for none) and share.

    Keys and numbers come without nulls (``NOTHING``), which would make their whole batch floats.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buffer = handle.getListState("buffer", "rows binary")
        self.waiting = handle.getListState("waiting", "rows binary")
        self.kept = handle.getValueState("kept", "now_id long, now_school string, opened long, closed long, before_id long, before_school string, before_closed long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        if key[0] == "":
            return
        passed, pieces, least = timerValues.getCurrentWatermarkInMs(), [], None
        for frame in rows:
            some = pa.Table.from_pandas(frame[_EVENT.names], _EVENT, preserve_index=False)
            late = pc.less(some["us"], passed * 1000)
            gone, fresh = some.filter(late), some.filter(pc.invert(late))
            if key[1] != 0:  # a mark has a row in each share
                gone = gone.filter(pc.equal(gone["kind"], "file"))
            if gone.num_rows:
                yield self.rows(key[0], gone["us"], gone["id"], too_late=True)
            if fresh.num_rows:
                pieces += _pack(fresh)
                first = pc.min(fresh["us"]).as_py()
                least = first if least is None else min(least, first)
        if pieces:
            self.buffer.appendList(pieces)
            self.handle.registerTimer(least // 1000 + 1)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        held = _unpack(self.buffer.get()) if self.buffer.exists() else _EVENT.empty_table()
        due = pc.less(held["us"], passed * 1000)
        rest, held = held.filter(pc.invert(due)), held.filter(due)
        if not held.num_rows:
            return
        if rest.num_rows:
            self.buffer.put(_pack(rest))
            self.handle.registerTimer(pc.min(rest["us"]).as_py() // 1000 + 1)
        else:
            self.buffer.clear()
        now = tuple(self.kept.get()) if self.kept.exists() else None
        is_file = pc.fill_null(pc.equal(held["kind"], "file"), False)
        marks, files = held.filter(pc.is_in(held["kind"], pa.array(["start", "stop"]))), held.filter(is_file)
        if now is None and self.waiting.exists():
            files = pa.concat_tables([_unpack(self.waiting.get()), files])
        states, times = ([] if now is None else [now]), ([] if now is None else [NOTHING])
        for mark in marks.sort_by([("us", "ascending"), ("id", "ascending")]).to_pylist():
            at = mark["us"]
            if now is not None and now[3] is None:
                now = (*now[:3], at, *now[4:])
            if mark["kind"] == "start":
                now = (mark["id"], mark["school"], at, None, *((None, None, None) if now is None else (now[0], now[1], now[3])))
            if now is not None:
                states.append(now)
                times.append(at)
        if now is None:
            if files.num_rows:
                self.waiting.put(_pack(files))
            return
        if times[0] != NOTHING:  # files that came before the first batch belong to it as it opened
            self.waiting.clear()
        self.kept.update(now)
        yield from self.place(key[0], states, np.array(times), files)

    def place(self, folder: str, states: list[tuple], times: np.ndarray, files: pa.Table) -> Iterator[pd.DataFrame]:
        """Rows of files by the state of their folder at their time, or the first one."""
        of = {c: pa.array(v, t) for (c, t), v in zip((("id", pa.int64()), ("school", pa.string()), ("opened", pa.int64()), ("closed", pa.int64()), ("tail", pa.int64()), ("tail_school", pa.string()), ("tail_closed", pa.int64())), zip(*states))}
        other = pa.array([s[1] != s[5] for s in states])
        for start in range(0, files.num_rows, PIECE):
            some = files.slice(start, PIECE)
            at = some["us"].to_numpy()
            k = np.searchsorted(times, at, "right") - 1
            before, k = k < 0, pa.array(np.maximum(k, 0))
            closed, tail_closed = of["closed"].take(k), of["tail_closed"].take(k)
            after = pc.subtract(some["us"], closed)
            aside = pc.and_(pc.fill_null(pc.greater_equal(after, 0), False), pa.array(~before))
            late = pc.if_else(pc.less(after, micros(GRACE)), "grace", pc.if_else(pc.less(after, micros(WATCH_AFTER)), "leftover", "late"))
            tailed = pc.and_(pc.fill_null(pc.and_(pc.greater_equal(some["us"], of["opened"].take(k)), pc.less(some["us"], pc.add(tail_closed, micros(LATE_TAIL)))), False), other.take(k))
            tailed, taken = pc.and_(tailed, pc.invert(aside)), pc.invert(aside)
            unless = lambda test, values: pc.if_else(test, values, pa.scalar(None, values.type))
            yield self.rows(
                folder, some["us"], some["id"], unless(taken, of["id"].take(k)), unless(taken, of["school"].take(k)), pc.if_else(taken, "batch", "set_aside"),
                unless(tailed, of["tail"].take(k)), unless(tailed, of["tail_school"].take(k)), unless(aside, late),
            )

    def rows(self, folder: str, created, number, batch=None, school=None, place=None, tail=None, tail_school=None, late=None, too_late=False) -> pd.DataFrame:
        n = len(created)
        strings = lambda c: pd.Series([None] * n, dtype=object) if c is None else c.to_pandas().astype(object)
        numbers = lambda c: pd.Series([pd.NA] * n, dtype="Int64") if c is None else pc.if_else(pc.equal(c, NOTHING), pa.scalar(None, pa.int64()), c).to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)
        columns = (numbers(number), pd.Series([int(folder)] * n, dtype="Int32"), numbers(created), numbers(batch), strings(school), strings(place), numbers(tail), strings(tail_school), strings(late), pd.Series([too_late] * n))
        return pd.DataFrame(dict(zip((c.split()[0] for c in _PLACED.split(", ")), columns, strict=True)))

    def close(self) -> None:
        pass


def stream_attribution(events: DataFrame, delay: str = DELAY) -> DataFrame:
    """Files with their batch, the tail of the batch before, and how long after a stop they came (J8, J9 and late pages at once).

    Events: event_id, folder_id, ts, kind (start, stop, file), school, in any order within ``delay``. Later ones, files and marks, are given with ``too_late`` alone. State per folder and share: its last two
    batches, and the files that wait for its first, which are given when it opens.
    """
    timed = events.withColumn("_clock", F.col("ts").cast("timestamp")).withWatermark("_clock", delay)
    share = F.when(F.col("kind") == "file", F.array(F.pmod(F.xxhash64("event_id"), F.lit(SHARES)).cast("int"))).otherwise(F.sequence(F.lit(0), F.lit(SHARES - 1)))
    number = lambda c: F.coalesce(c, F.lit(NOTHING))
    folder = F.coalesce(F.col("folder_id").cast("string"), F.lit("")).alias("_folder")
    rows = timed.select(folder, F.explode(share).alias("_share"), number(F.unix_micros("_clock")).alias("us"), number(F.col("event_id")).alias("id"), "kind", "school")
    placed = rows.groupBy("_folder", "_share").transformWithStateInPandas(_Attribution(), _PLACED, "append", "EventTime")
    return placed.withColumn("created", F.timestamp_micros("created").cast("timestamp_ntz"))


class _Pages(InOrder):
    rows, order = "us long, id long, kind string", 2
    out = "page_id long, status string, tries int, as_of long, too_late boolean"
    memory = "status string, tries int, claimed long, ended long"

    def fold(self, key, kept, due, passed):
        status, tries, claimed, ended = kept or ("queued", 0, None, None)
        before = (status, tries)
        for at, _, kind in due:
            if ended is not None:
                continue
            if status == "reading" and at - claimed > CLAIM:
                status, claimed = "queued", None
            if kind == "claim" and status == "queued":
                status, claimed = "reading", at
            elif status == "reading" and kind in ("done", "fail", "outage"):
                tries += kind == "fail"
                status, claimed = "read" if kind == "done" else "failed" if tries >= TRIES else "queued", None
            ended = at if status in ("read", "failed") else None
        if status == "reading" and passed - claimed > CLAIM:
            status, claimed = "queued", None
        found = [self.row(key, status, tries, passed, False)] if (status, tries) != before or (kept is None and due) else []
        if ended is not None:
            return (None, found, None) if passed >= ended + FORGET else ((status, tries, None, ended), found, ended + FORGET)
        if (status, tries) == ("queued", 0):
            return None, found, None
        return (status, tries, claimed, None), found, None if claimed is None else claimed + CLAIM + 1000

    def too_late(self, key, values):
        return self.row(key, None, None, values[0], True)


def page_lifecycle(events: DataFrame, delay: str = DELAY) -> DataFrame:
    """(page_id, status, tries, as_of, too_late) of a page whenever it changes. Events: page_id, event_id, ts, kind (claim, done, fail, outage).

    A claim frees itself after ``CLAIM`` without another event. A page that was read or has failed leaves the state ``FORGET`` later, one that waits untried at once. ``as_of``: the
    watermark, in microseconds.
    """
    return _run(events, F.col("ts"), delay, "page_id", [F.col("event_id").alias("id"), F.col("kind")], _Pages(), "update")


def file_state(state: tuple, kind: str) -> tuple:
    """(state, pages_logged, attempts) of a file after an event: claim, page, logged, renamed, fail, outage. Done and parked are final."""
    now, logged, attempts = state
    if now in ("done", "parked") or (now is None and kind != "claim"):
        return state
    if now is None:
        return "reading", logged, attempts
    if kind == "fail":
        return "parked" if attempts + 1 >= TRIES else now, logged, attempts + 1
    after = {("reading", "logged"): "logged", ("logged", "renamed"): "done"}.get((now, kind), now)
    return after, logged + (kind == "page" and now == "reading"), attempts


class _Files(InOrder):
    rows, order = "us long, id long, kind string", 2
    out = "file_id long, state string, pages_logged int, attempts int, as_of long, too_late boolean"
    memory = "state string, pages_logged int, attempts int, ended long"

    def fold(self, key, kept, due, passed):
        before, ended = (kept[:3], kept[3]) if kept else ((None, 0, 0), None)
        state = before
        for at, _, kind in due:
            state = file_state(state, kind)
            ended = at if ended is None and state[0] in ("done", "parked") else ended
        found = [self.row(key, *state, passed, False)] if state != before else []
        if state[0] is None or (ended is not None and passed >= ended + FORGET):
            return None, found, None
        return (*state, ended), found, None if ended is None else ended + FORGET

    def too_late(self, key, values):
        return self.row(key, None, None, None, values[0], True)


def file_lifecycle(events: DataFrame, delay: str = DELAY) -> DataFrame:
    """(file_id, state, pages_logged, attempts, as_of, too_late) of a claimed file whenever it changes. Events: file_id, event_id, ts, kind.

    Reading goes on after ``pages_logged``; three failures park a file in any state but done; an outage counts for nothing. Done and parked files leave the state ``FORGET`` later.
    """
    return _run(events, F.col("ts"), delay, "file_id", [F.col("event_id").alias("id"), F.col("kind")], _Files(), "update")


class _Pairing(InOrder):
    rows, order = "us long, ns long, source_page long, page_id string, status string, student_id string, skip_reason string, school string, location string", 4
    out = "page_id string, auto_code string, too_late boolean"
    memory = "forms int, length int, school string, location string"

    def fold(self, key, kept, due, passed):
        forms, length, school, location = kept or (0, 0, None, None)
        found = []
        for _, _, _, page_id, status, student_id, skip_reason, *place in due:
            read = status == "read"
            if read and not student_id and skip_reason == "blank":
                continue
            if read and student_id:
                forms, length, (school, location) = forms + 1, 1, place
            elif read and skip_reason in LATER and 0 < length < MAX_PAGES and place == [school, location]:
                length += 1
            else:
                length = 0
            if length and forms <= MAX_FORMS:
                found.append(self.row(page_id, f"B0-{forms}", False))
        return (forms, length, school, location), found, None

    def too_late(self, key, values):
        return self.row(values[3], None, True)


def stream_pairing(pages: DataFrame, delay: str = DELAY) -> DataFrame:
    """(page_id, auto_code, too_late) of pages without a code, in scan order whatever the order of arrival within ``delay``. State per owner: the open form, three numbers and a place."""
    mine = F.coalesce(F.col("code"), F.lit("")) == ""
    listed = mine & F.upper(F.trim("school")).isin(*UNCODED_SCHOOLS)
    # rows of other schools have no key: they move the clock
    own = pages.withColumn("owner", F.when(listed, F.col("owner")))
    columns = [F.col("received_ns").cast("long").alias("ns"), F.col("source_page").cast("long"), *(F.col(c) for c in ("page_id", "status", "student_id", "skip_reason", "school", "location"))]
    return _run(own, F.timestamp_micros(F.floor(F.col("received_ns") / 1000).cast("long")), delay, "owner", columns, _Pairing(), "append")


class _Listing(InOrder):
    rows, order = "us long, look long, size long, mtime long", 2
    out = "name string, taken long, too_late boolean"
    memory = "seen long, look long, size long, mtime long, taken boolean"

    def __init__(self, once: bool):
        self.once = once

    def fold(self, key, kept, due, passed):
        seen, look, size, mtime, taken = kept or (None, None, None, None, False)
        found = []
        for at, *new in due:
            if not taken and None not in new and [look, size, mtime] == [new[0] - 1, *new[1:]]:
                taken = True
                found.append(self.row(key, new[0], False))
            seen, (look, size, mtime) = at, new
        if taken and self.once:
            return (None, None, None, None, True), found, None
        if seen is None or passed >= seen + FORGET:
            return None, found, None
        return (seen, look, size, mtime, taken), found, seen + FORGET

    def too_late(self, key, values):
        return self.row(key, values[1], True)


def stable_files(listings: DataFrame, delay: str = DELAY, once: bool = False) -> DataFrame:
    """(name, taken, too_late): a file is taken once, at the look that agrees with the one before on size and time; one that is gone before its second look never is.

    Listings: name, pass, ts, size, mtime. State per name: its last look, forgotten after ``FORGET`` without another (a file that was taken is renamed, so it isn't listed again).
    ``once``: names may come again however much later and are still taken once, so those taken stay in the state.
    """
    columns = [F.col("pass").cast("long").alias("look"), F.col("size").cast("long"), F.col("mtime").cast("long")]
    return _run(listings, F.col("ts"), delay, "name", columns, _Listing(once), "append")


class _Hosts(InOrder):
    rows, order = "us long", 1
    out = "host long, alive boolean, at long, too_late boolean"
    memory = "last long"

    def __init__(self, stale: int):
        self.stale = stale

    def fold(self, key, kept, due, passed):
        last, found = kept[0] if kept else None, []
        for (at,) in due:
            if last is not None and at - last >= self.stale:
                found.append(self.row(key, False, last + self.stale, False))
                last = None
            if last is None:
                found.append(self.row(key, True, at, False))
            last = at
        if last is not None and passed >= last + self.stale:
            found.append(self.row(key, False, last + self.stale, False))
            last = None
        return (None if last is None else (last,)), found, None if last is None else last + self.stale

    def too_late(self, key, values):
        return self.row(key, None, values[0], True)


def host_liveness(beats: DataFrame, stale: str = "45 seconds", delay: str = DELAY) -> DataFrame:
    """(host, alive, at, too_late) whenever a host comes alive or has been silent for ``stale``, which a timer tells without another beat. Beats: host, ts. State only of hosts that live."""
    found = _run(beats, F.col("ts"), delay, "host", [], _Hosts(micros(stale)), "append")
    return found.withColumn("at", F.timestamp_micros("at").cast("timestamp_ntz"))
