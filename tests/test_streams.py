"""Keyed streams: late and shuffled arrivals, timers, state that ends, and sinks that add nothing when a batch is run again."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from intake.operators import lookup
from intake.plans import streams
from intake.streaming import keyed
from intake.streaming import lifecycles as live

START = datetime(2024, 1, 1)
PAGE = "page_id long, event_id long, ts timestamp, kind string"


def at(minutes):
    return START + timedelta(minutes=minutes)


class Feed:
    """A stream of files put in one at a time; what it gives, and what its state holds after each."""

    def __init__(self, spark, tmp_path, schema, make, mode="append"):
        keyed.use_state_store(spark)
        self.spark, self.schema, self.path, self.given, self.state = spark, schema, str(tmp_path / "in"), [], []
        self.checkpoint = str(tmp_path / "checkpoint")
        self.make, self.mode = make, mode

    def put(self, *rows):
        """One micro-batch from the last checkpoint on: the rows it gives."""
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.path)
        found = []
        stream = self.make(live.read_events(self.spark, self.path, self.schema))
        writer = stream.writeStream.outputMode(self.mode).foreachBatch(lambda df, k: found.extend(tuple(r) for r in df.collect()))
        query = writer.option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        self.state = [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]
        return sorted(found, key=str)

    def held(self):
        """Rows of state that the last micro-batch left."""
        return self.state[-1]["numRowsTotal"]


def test_claims_free_themselves_and_ended_pages_leave_the_state(spark, tmp_path):
    feed = Feed(spark, tmp_path, PAGE, lambda e: keyed.page_lifecycle(e, "30 minutes"), "update")
    assert feed.put((1, 1, at(0), "claim"), (2, 2, at(1), "claim"), (3, 3, at(2), "fail")) == []
    # the clock passes the claims: page 2 ends, page 1's claim frees itself with no further event of its own
    got = feed.put((2, 4, at(5), "done"), (None, None, at(60), None))
    assert [(r[0], r[1], r[2]) for r in got] == [(1, "queued", 0), (2, "read", 0), (3, "queued", 0)]
    assert feed.held() >= 1
    # later events of an ended page change nothing; a day later it is forgotten
    assert feed.put((2, 5, at(70), "claim"), (None, None, at(200), None)) == []
    assert feed.put((None, None, at(2 * 24 * 60), None)) == []
    assert feed.held() == 0
    # what comes behind the watermark is given back, not folded
    assert [(r[0], r[1], r[4]) for r in feed.put((1, 6, at(3), "claim"))] == [(1, None, True)]


def test_three_failures_and_outages_over_restarts(spark, tmp_path):
    feed = Feed(spark, tmp_path, PAGE, lambda e: keyed.page_lifecycle(e, "10 minutes"), "update")
    found = []
    for k, (minute, kind) in enumerate([(0, "claim"), (1, "fail"), (2, "claim"), (3, "outage"), (4, "claim"), (5, "fail"), (6, "claim"), (7, "fail"), (8, "claim")]):
        found += feed.put((7, k, at(100 * minute), kind), (None, None, at(100 * minute + 5), None))
    found += feed.put((None, None, at(1000), None))
    # each claim is over ten minutes old when its failure comes, so none counts
    assert found and {r[2] for r in found} == {0}
    assert [r[1] for r in feed.put((7, 20, at(2000), "claim"), (7, 21, at(2001), "fail"), (7, 23, at(2003), "fail"), (7, 22, at(2002), "claim"), (7, 25, at(2005), "fail"), (7, 24, at(2004), "claim"), (None, None, at(2100), None))] == ["failed"]


FILE = "file_id long, event_id long, ts timestamp, kind string"


def test_parked_files_leave_the_state(spark, tmp_path):
    feed = Feed(spark, tmp_path, FILE, lambda e: keyed.file_lifecycle(e, "10 minutes"), "update")
    feed.put((1, 1, at(0), "claim"), (1, 3, at(2), "fail"), (1, 2, at(1), "page"), (2, 4, at(0), "page"))
    got = feed.put((1, 5, at(4), "fail"), (1, 4, at(3), "fail"), (3, 6, at(4), "claim"), (None, None, at(30), None))
    assert [r[:4] for r in got] == [(1, "parked", 1, 3), (3, "reading", 0, 0)]
    feed.put((None, None, at(3 * 24 * 60), None))
    assert feed.held() > 0  # file 3 is still read
    only = feed.held()
    feed.put((3, 7, at(3 * 24 * 60 + 1), "logged"), (3, 8, at(3 * 24 * 60 + 2), "renamed"), (None, None, at(5 * 24 * 60), None))
    assert feed.held() < only and feed.held() == 0


MARK = "event_id long, folder_id int, ts timestamp, kind string, school string"


def test_files_in_any_order_and_too_late(spark, tmp_path):
    feed = Feed(spark, tmp_path, MARK, lambda e: keyed.stream_attribution(e, "30 minutes"))
    # the file arrives before the mark that it belongs to, and a second batch takes over
    assert feed.put((5, 1, at(6), "file", None), (1, 1, at(1), "file", None), (2, 1, at(2), "start", "A")) == []
    got = feed.put((4, 1, at(5), "start", "B"), (3, 1, at(4), "file", None), (None, None, at(60), None, None))
    assert [(r[0], r[3], r[5], r[6]) for r in got] == [(1, 2, "batch", None), (3, 2, "batch", None), (5, 4, "batch", 2)]
    assert [(r[0], r[9]) for r in feed.put((6, 1, at(7), "file", None))] == [(6, True)]


def test_a_folder_goes_over_several_keys(spark, tmp_path):
    """Files of one folder are dealt out, each with all marks; files before the first batch wait for it in any of them, and a mark that is too late is given once."""
    feed = Feed(spark, tmp_path, MARK, lambda e: keyed.stream_attribution(e, "30 minutes"))
    big = 2**53 + 1  # no number goes through a float
    assert feed.put(*((big + k, 1, at(k), "file", None) for k in range(40)), (None, None, at(80), None, None)) == []
    assert feed.held() > 2
    feed.put((900, 1, at(85), "start", "A"), (901, 1, at(95), "stop", None), (902, 1, at(96), "file", None), (None, None, None, None, None), (None, None, at(300), None, None))
    got = feed.put((903, 1, at(10), "stop", None), (904, 2, at(290), "start", None), (905, 2, at(291), "file", None), (None, None, at(400), None, None))
    assert [(r[0], r[1], r[9]) for r in got if r[9]] == [(903, 1, True)]
    assert [(r[:2], r[3:]) for r in got if not r[9]] == [((905, 2), (904, None, "batch", None, None, None, False))]
    assert feed.held() > 0


def test_replay_writes_parts_as_several_files(spark, monkeypatch):
    """Each part is one micro-batch, also where it has several files; rows are those of plain loops, ties in time included."""
    monkeypatch.setattr(live, "FILE", 1)
    rng, runs = random.Random(4), []
    events = [(k, rng.randrange(2), at(rng.randrange(3000)), *rng.choice((("file", None),) * 8 + (("start", "A"), ("start", "B"), ("stop", None)))) for k in range(600)]
    plain = live.read_events
    monkeypatch.setattr(live, "read_events", lambda spark, path, schema, files=1: runs.append((path, files)) or plain(spark, path, schema, files))
    df = spark.createDataFrame(events, MARK)
    got = {r[0]: tuple(r)[3:9] for r in live.replay(df, "ts", keyed.stream_attribution, parts=3).where("not too_late").collect()}
    want = {}
    for folder in (0, 1):
        now, waiting = None, []
        for k, _, ts, kind, school in sorted((e for e in events if e[1] == folder), key=lambda e: (e[2], e[3] == "file", e[0])):
            if kind == "file" and now is None:
                waiting.append(k)
            elif kind == "file":
                number, own, opened, closed, tail, tail_school, tail_closed = now
                if closed is not None:
                    after = ts - closed
                    want[k] = (None, None, "set_aside", None, None, "grace" if after < timedelta(minutes=2) else "leftover" if after < timedelta(hours=6) else "late")
                else:
                    tailed = tail_closed is not None and ts < tail_closed + timedelta(minutes=10) and tail_school != own
                    want[k] = (number, own, "batch", tail if tailed else None, tail_school if tailed else None, None)
            else:
                if now is not None and now[3] is None:
                    now = (*now[:3], ts, *now[4:])
                if kind == "start":
                    now = (k, school, ts, None, *((None, None, None) if now is None else (now[0], now[1], now[3])))
                    want |= {w: (k, school, "batch", None, None, None) for w in waiting}
                    waiting = []
    assert got == want and len(want) > 300 and {v[2] for v in want.values()} == {"batch", "set_aside"}
    assert runs[-1][1] > 1 and len(spark.read.parquet(runs[-1][0]).inputFiles()) == 3 * runs[-1][1] + 1


def test_counts_of_a_replay_with_several_files(spark, tmp_path, monkeypatch):
    """Counts by batch, kept by micro-batch: parts of several files are still one each, so that no file is too late for its count."""
    monkeypatch.setattr(live, "FILE", 1)
    events = [(k, k % 2, at(3 * k), "start" if k % 50 < 2 else "file", "A") for k in range(600)]
    live.replay(spark.createDataFrame(events, MARK), "ts", keyed.stream_attribution, parts=3, sink=live.count_pages(str(tmp_path / "log")))
    assert {tuple(r) for r in live.page_counts(spark, str(tmp_path / "log")).collect()} == {(k, 24) for k in range(600) if k % 50 < 2}
    assert spark.read.parquet(str(tmp_path / "log")).select("batch").distinct().count() <= 5


def test_a_stream_is_written_by_all_cores(spark, monkeypatch):
    found = []
    monkeypatch.setattr(live, "read_events", lambda spark, path, schema, files: found.append((spark.read.parquet(path).inputFiles(), files)))
    streams.as_stream(spark, spark.range(0, 1000, 1, 4), "id", quarters=2)
    assert [(len(paths), files) for paths, files in found] == [(8, 4)]  # four cores


def test_pages_pair_in_scan_order(spark, tmp_path):
    schema = "page_id string, owner long, received_ns long, source_page int, school string, location string, status string, code string, student_id string, skip_reason string"
    page = lambda p, minute, student, reason, school="BOPEMS": (p, 1, int(at(minute).timestamp()) * 10**9, 1, school, "Pune", "read", None, student, reason)
    feed = Feed(spark, tmp_path, schema, lambda e: keyed.stream_pairing(e, "30 minutes"))
    assert feed.put(page("b", 2, "", "continuation"), page("d", 4, "", None)) == []
    got = feed.put(page("a", 1, "S1", ""), page("e", 5, "", "continuation"), page("c", 3, None, "declaration"), page("z", 90, "", "", "other"))
    assert got == [("a", "B0-1", False), ("b", "B0-1", False), ("c", "B0-1", False)]


def test_files_gone_before_the_second_look(spark, tmp_path):
    feed = Feed(spark, tmp_path, "name string, pass int, ts timestamp, size long, mtime long", lambda e: keyed.stable_files(e, "1 minute"))
    feed.put(("a", 1, at(1), 5, 1), ("gone", 1, at(1), 5, 1), ("grows", 1, at(1), 5, 1))
    got = feed.put(("a", 2, at(2), 5, 1), ("grows", 2, at(2), 6, 1), (None, None, at(10), None, None))
    assert got == [("a", 2, False)]
    got = feed.put(("grows", 3, at(11), 6, 1), ("gone", 3, at(11), 5, 1), ("a", 3, at(11), 5, 1), (None, None, at(20), None, None))
    assert got == [("grows", 3, False)]
    feed.put((None, None, at(3 * 24 * 60), None, None))
    assert feed.held() == 0


def test_names_listed_days_later_are_taken_once(spark, tmp_path):
    feed = Feed(spark, tmp_path, "name string, pass int, ts timestamp, size long, mtime long", lambda e: keyed.stable_files(e, "1 minute", once=True))
    assert feed.put(("a", 1, at(1), 5, 1), ("a", 2, at(2), 5, 1), ("gone", 2, at(2), 5, 1), (None, None, at(10), None, None)) == [("a", 2, False)]
    feed.put((None, None, at(3 * 24 * 60), None, None))
    late = 3 * 24 * 60 + 1
    assert feed.put(("a", late, at(late), 6, 1), ("a", late + 1, at(late + 1), 6, 1), ("gone", late, at(late), 5, 1), (None, None, at(late + 10), None, None)) == []


def test_replay_makes_its_rows_once_for_all_files(spark):
    made = spark.sparkContext.accumulator(0)

    def beat(k):
        made.add(1)
        return k % 3

    rows = spark.range(40).withColumn("host", F.udf(beat, "long")("id")).withColumn("ts", F.timestamp_micros(F.col("id") * 60 * 10**6)).select("host", "ts")
    assert live.replay(rows, "ts", keyed.host_liveness, parts=4).count() == 80
    assert made.value <= 80  # once to find the span of arrivals, once to keep them


def test_hosts_fall_silent_by_a_timer(spark, tmp_path):
    feed = Feed(spark, tmp_path, "host long, ts timestamp", lambda e: keyed.host_liveness(e, delay="1 minute"))
    feed.put((1, at(0)), (1, at(0.5)), (2, at(0.9)))
    got = feed.put((2, at(1.5)), (None, at(1.2)), (None, at(3)))
    assert [(r[0], r[1], (r[2] - START).total_seconds()) for r in got] == [(1, False, 75.0), (1, True, 0.0), (2, True, 54.0)]
    got = feed.put((None, at(9)))
    assert [(r[0], r[1], (r[2] - START).total_seconds()) for r in got] == [(2, False, 135.0)]
    assert feed.held() == 0


@pytest.mark.parametrize(("age", "state", "waits", "given"), [(119, "reading", True, "reading"), (121, "reading", False, "not_running"), (121, "idle", False, "idle"), (121, "idle", True, "not_running"), (119, "idle", True, "idle")])
def test_worker_rule(spark, age, state, waits, given):
    states = spark.createDataFrame([(1, at(0), "idle"), (1, at(1), state)], "host int, ts timestamp, state string")
    pages = spark.range(5 if waits else 0)
    now = F.lit(at(1) + timedelta(seconds=age))
    assert [r.state for r in live.worker_state(states, pages, now).collect()] == [given]


def test_watcher_rule(spark):
    beats = spark.createDataFrame([(1, at(0)), (2, at(0) + timedelta(seconds=1))], "host int, ts timestamp")
    assert {r.host: r.alive for r in live.watcher_alive(beats, F.lit(at(0) + timedelta(seconds=45))).collect()} == {1: False, 2: True}


def test_a_batch_run_again_adds_nothing(spark, tmp_path):
    log = str(tmp_path / "log")
    rows = spark.createDataFrame([(1, 7), (2, 7), (3, None)], "file_id int, batch_id long").withColumn("place", F.when(F.col("batch_id").isNotNull(), "batch"))
    count = live.count_pages(log)
    for k in (0, 1, 1, 0):
        count(rows, k)
        live.append_once(rows.select("file_id"), log, "other", k)
    assert [tuple(r) for r in live.page_counts(spark, log).collect()] == [(7, 4)]
    assert spark.read.parquet(f"{log}/query=other").count() == 6


def test_keys_built_beforehand_change_nothing(spark):
    roster = spark.createDataFrame([(i, f"{name}{date}", "N", school) for i, (name, date, school) in enumerate([("KELVOR", "120309", "A"), ("KELVOX", "120309", "A"), ("NORTAN", "140211", "B"), ("MIRABELLAN", "1402113355", "B"), ("ABC", "1402", "A")])], "person int, student_id string, student_name string, school_name string")
    asked = [(t, s, "", s) for t in ("KELV0R120309", "NORTAM140211", "NORTN140211", "MIRABELAN1402113355", "ABD1402", "MIRABELLAN140211335") for s in ("", "A", "B")]
    readings = spark.createDataFrame(asked, "token string, school string, location string, scope string")
    plain = sorted(map(tuple, lookup.constrained_repair(readings, roster).collect()))
    assert sorted(map(tuple, lookup.constrained_repair(readings, roster, lookup.fuzzy_keys(roster)).collect())) == plain and plain
