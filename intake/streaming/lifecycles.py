"""The polling loops as Structured Streaming queries; each gives what the batch form gives on the same input.

Times are naive India time in tables. Watermarks need zoned timestamps: set ``spark.sql.session.timeZone`` to UTC, and times are
cast for the watermark and back on output. Clocks are event times, so that replays give the same rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from intake.operators import lookup
from intake.shared import cut, shared_dir
from intake.streaming.keyed import CLAIM, TRIES, micros, use_state_store

#: The watermark of leftovers.
LEFTOVER = "6 hours"
#: Rows of a file of a replay at least, about, where a part has several.
FILE = 50_000


def read_events(spark: SparkSession, path: str, schema: T.StructType | str, files: int = 1) -> DataFrame:
    """A stream of Parquet files in order of their time, so many in a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def replay(df: DataFrame, clock: str, make: Callable[[DataFrame], DataFrame], mode: str = "append", parts: int = 6, jitter: int = 3600, after: int = 2 * 86400, sink: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """The rows that a stream gives over ``df`` as parts of equal spans of time, one a micro-batch, with a stop and a restart from its checkpoint in the middle.

    Rows arrive up to ``jitter`` seconds late. A part is one file, or several that one micro-batch takes if each has ``FILE`` rows. ``clock``: a timestamp, or nanoseconds as a number. The last file only moves the clock on by ``after`` seconds. As in
    ``run_to_end``, rows of ``update`` carry their batch; with a ``sink`` the micro-batches go there alone.
    """
    spark, number = df.sparkSession, dict(df.dtypes)[clock] not in ("timestamp", "timestamp_ntz")
    use_state_store(spark)
    folder = f"{shared_dir(spark)}/replay-{uuid.uuid4().hex}"
    seconds = F.col(clock) / 1e9 if number else F.unix_micros(F.col(clock).cast("timestamp")) / 1e6
    arrives = seconds + F.pmod(F.xxhash64(*df.columns), F.lit(max(1, jitter)))
    low, high, last = df.agg(F.min(arrives), F.max(arrives), F.max(clock)).first()
    if last is None:
        return spark.createDataFrame([], make(read_events(spark, folder, df.schema)).schema)
    part = F.least(F.lit(parts - 1), F.floor((arrives - low) / ((high - low) or 1) * parts))
    # made once and by all; a part is written by all too, as so many files, if none of them can be empty
    df = cut(df)
    counts, inputs = {r.part: r.n for r in df.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}, df.rdd.getNumPartitions()
    files = max(1, min(spark.sparkContext.defaultParallelism, min(counts.get(k, 0) for k in range(parts)) // max(inputs, FILE)))
    tick = F.lit(last) + F.lit(after * 10**9) if number else (F.lit(last) + F.make_interval(secs=F.lit(after))).cast(df.schema[clock].dataType)
    clocked = spark.range(1).select(*[(tick if f.name == clock else F.lit(None).cast(f.dataType)).alias(f.name) for f in df.schema.fields])
    found = None
    for leg in (range(parts // 2), range(parts // 2, parts + 1)):
        for k in leg:
            rows = clocked.coalesce(1) if k == parts else df.where(part == k)
            (rows.repartition(files) if k < parts and files > 1 else rows.coalesce(1)).write.mode("append").parquet(f"{folder}/in")
        found = run_to_end(make(read_events(spark, f"{folder}/in", df.schema, files)), mode, folder, sink)
    return found


def run_to_end(df: DataFrame, mode: str = "append", folder: str | None = None, sink: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Runs a stream over what is there, from where it was stopped in ``folder``, and gives all rows it wrote there. With ``update`` the last row of a batch stands for its keys."""
    folder = folder or f"{shared_dir(df.sparkSession)}/stream-{uuid.uuid4().hex}"
    if sink:
        writer = df.writeStream.outputMode(mode).foreachBatch(sink)
    elif mode == "append":
        writer = df.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out")
    else:
        writer = df.writeStream.outputMode(mode).foreachBatch(lambda rows, k: rows.withColumn("_batch", F.lit(k)).write.mode("overwrite").parquet(f"{folder}/out/part={k}"))
    writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    if sink:
        return df.sparkSession.createDataFrame([], df.schema)
    return df.sparkSession.read.schema(df.schema if mode == "append" else T.StructType([*df.schema.fields, T.StructField("_batch", T.IntegerType())])).parquet(f"{folder}/out" if mode == "append" else f"{folder}/out/*")


def dedup_arrivals(events: DataFrame, keys: list[str], within: str = "10 minutes") -> DataFrame:
    """Arrivals with equal keys within a time count once."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", within).dropDuplicatesWithinWatermark(keys)


def pages_per_day(events: DataFrame, late: str = LEFTOVER) -> DataFrame:
    """Arrivals per India day. Times are India time, so days are plain days of the (UTC) session."""
    windowed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", "1 day"))
    return windowed.agg(F.count("*").alias("pages")).select(F.col("window.start").cast("timestamp_ntz").alias("day"), "pages")


def liveness(beats: DataFrame, gap: str = "45 seconds") -> DataFrame:
    """Spans in which a host's heartbeats are never further apart than ``gap``."""
    spans = beats.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", gap).groupBy("host", F.session_window("ts", gap))
    return spans.agg(F.count("*").alias("beats"), F.max("ts").cast("timestamp_ntz").alias("last_beat")).select("host", F.col("session_window.start").cast("timestamp_ntz").alias("since"), "last_beat", "beats")


def page_lifecycle_batch(events: DataFrame, now: Column | None = None) -> DataFrame:
    """(page_id, status, tries) of every page from all its events, by a fold over them in order; with ``now``, claims that are too old by then have gone back to the queue."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    kind_of = "struct<status:string,tries:int,claimed:bigint>"

    def freed(s: Column, at: Column) -> Column:
        return F.when((s["status"] == "reading") & (at - s["claimed"] > CLAIM), "queued").otherwise(s["status"])

    def step(s: Column, e: Column) -> Column:
        status, kind = freed(s, e["us"]), e["kind"]
        tries = s["tries"] + F.when((status == "reading") & (kind == "fail"), 1).otherwise(0)
        over = F.when(kind == "done", "read").when((kind == "fail") & (tries >= TRIES), "failed").when(kind.isin("fail", "outage"), "queued").otherwise("reading")
        after = F.when(status == "reading", over).when((status == "queued") & (kind == "claim"), "reading").otherwise(status)
        claimed = F.when(after == "reading", F.when(status == "reading", s["claimed"]).otherwise(e["us"]))
        return F.when(s["status"].isin("read", "failed"), s).otherwise(F.struct(after.alias("status"), tries.alias("tries"), claimed.alias("claimed")).cast(kind_of))

    start = F.struct(F.lit("queued").alias("status"), F.lit(0).alias("tries"), F.lit(None).cast("long").alias("claimed")).cast(kind_of)
    rows = events.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct(us.alias("us"), "event_id", "kind"))).alias("_e"))
    found = rows.select("page_id", F.aggregate("_e", start, step).alias("_s"))
    status = F.col("_s.status") if now is None else freed(F.col("_s"), F.unix_micros(now.cast("timestamp")))
    return found.select("page_id", status.alias("status"), F.col("_s.tries").alias("tries"))


#: What a file is before its first event: state, pages logged, failures.
FILE_STATE = "struct<state:string,pages_logged:int,attempts:int>"


def file_lifecycle_batch(events: DataFrame) -> DataFrame:
    """The same from all events at once, by a fold over each file's events in order."""
    is_ = lambda s, *states: F.coalesce(s["state"].isin(*states), F.lit(False))

    def step(s: Column, e: Column) -> Column:
        kind = e["kind"]
        fails = s["attempts"] + F.when(s["state"].isNotNull() & (kind == "fail"), 1).otherwise(0)
        state = F.when(s["state"].isNull(), F.when(kind == "claim", "reading")).when(fails >= TRIES, "parked").when(is_(s, "reading") & (kind == "logged"), "logged").when(is_(s, "logged") & (kind == "renamed"), "done").otherwise(s["state"])
        pages = s["pages_logged"] + F.when(is_(s, "reading") & (kind == "page"), 1).otherwise(0)
        return F.when(is_(s, "done", "parked"), s).otherwise(F.struct(state.alias("state"), pages.alias("pages_logged"), fails.alias("attempts")).cast(FILE_STATE))

    start = F.struct(F.lit(None).cast("string").alias("state"), F.lit(0).alias("pages_logged"), F.lit(0).alias("attempts")).cast(FILE_STATE)
    rows = events.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "kind"))).alias("_e"))
    return rows.select("file_id", F.aggregate("_e", start, step).alias("_s")).select("file_id", "_s.*").where("state is not null")


def stable_files(listings: DataFrame) -> DataFrame:
    """Files of which two listings in a row agree on size and time; once per file. Listings: name, pass, size, mtime."""
    from pyspark.sql import Window

    order = Window.partitionBy("name").orderBy("pass")
    same = (F.lag("size").over(order) == F.col("size")) & (F.lag("mtime").over(order) == F.col("mtime")) & (F.lag("pass").over(order) == F.col("pass") - 1)
    return listings.withColumn("_same", same).where("_same").groupBy("name").agg(F.min("pass").alias("taken"))


def append_once(rows: DataFrame, folder: str, query: str, k: int) -> None:
    """Rows of a micro-batch in the log: a batch that is run again takes its own place, so that it adds nothing."""
    rows.write.mode("overwrite").parquet(f"{folder}/query={query}/batch={k}")


def stream_lookup(readings: DataFrame, roster: DataFrame, locations: DataFrame, log: str, query: str, checkpoint: str) -> None:
    """Each micro-batch of readings through the whole ladder against the static roster, as attempts appended once to the log.

    Readings without an identifier's shape are refused. The roster's fuzzy keys are built once for all batches.
    """
    built = lookup.fuzzy_keys(roster)

    def batch(rows: DataFrame, k: int) -> None:
        found = lookup.confirm(cut(rows), roster, locations, built)
        append_once(found.select("reading_id", "confirmed_student_id", "found_in_db", "student_id", "matched_via"), log, query, k)

    readings.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def count_pages(folder: str) -> Callable[[DataFrame, int], None]:
    """A sink that keeps how many pages each batch has; ``page_counts`` reads them. A micro-batch's counts are kept apart by its number, so that one run again counts once."""

    def batch(rows: DataFrame, k: int) -> None:
        append_once(rows.where("place = 'batch'").groupBy("batch_id").agg(F.count("*").alias("pages")), folder, "pages", k)

    return batch


def page_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of each batch so far."""
    return spark.read.schema("batch_id long, pages long").parquet(f"{folder}/query=pages/*").groupBy("batch_id").agg(F.sum("pages").alias("pages"))


def watcher_alive(beats: DataFrame, now: Column, stale: str = "45 seconds") -> DataFrame:
    """(host, last_seen, alive) as of ``now``: alive with a beat less than ``stale`` ago. Beats: host, ts."""
    last = beats.groupBy("host").agg(F.max("ts").alias("last_seen"))
    return last.withColumn("alive", F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_seen").cast("timestamp")) < micros(stale))


def worker_state(states: DataFrame, waiting: DataFrame, now: Column, stale: str = "120 seconds") -> DataFrame:
    """(host, state): what each worker last wrote (host, ts, state), or ``not_running`` if that is older than ``stale`` and it said it was busy, or pages wait (rows of ``waiting``)."""
    last = states.groupBy("host").agg(F.max_by(F.struct("ts", "state"), "ts").alias("l")).select("host", "l.*")
    pending = waiting.limit(1).select(F.lit(True).alias("_waits"))
    quiet = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp")) > micros(stale)
    gone = quiet & ((F.col("state") != "idle") | F.coalesce("_waits", F.lit(False)))
    return last.join(F.broadcast(pending), F.lit(True), "left").select("host", F.when(gone, "not_running").otherwise(F.col("state")).alias("state"))
