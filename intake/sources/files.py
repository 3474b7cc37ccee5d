"""Readers with fixed schemas, listings of arriving files, and writers of document trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intake.functions import text
from intake.shared import cut

SCHEMAS = {
    "roster": "student_id string, student_name string, school_name string, grade_name string, division_name string, academic_year string, gender string, status string, scanned_at timestamp_ntz",
    "scan_log": "id bigint, created_at timestamp_ntz, confirmed_student_id string, found_in_db boolean, matched_student_id string, student_name string, school_name string, source string, message string, link string, matched_via string, scan_school string, scan_location string, reviewed_at timestamp_ntz, reviewed_by string",
    "batches": "id bigint, folder_id string, owner_email string, school string, location string, opened_by string, opened_at timestamp_ntz, closed_at timestamp_ntz, pages_done int",
    "inbox_files": "file_id string, folder_id string, batch_id bigint, name string, state string, pages_logged int, new_name string, attempts int, last_error string, updated_at timestamp_ntz",
    "heartbeats": "id bigint, last_seen timestamp_ntz, host string",
    "employees": "work_email string, school_acronym string, designation string, location string",
}
PAGE_RESULT = "page_id string, code string, code_confidence double, code_raw string, student_id string, candidates array<string>, matched_student struct<student_id:string,student_name:string,school_name:string>, message string, blank boolean, skip_reason string, confidence double, read_at string"
# Extensions taken, and the first bytes of a TIFF file as hex.
EXTENSIONS = ("jpg", "jpeg", "png", "pdf", "bmp", "tif", "tiff", "webp")
TIFF = ("49492A00", "4D4D002A", "49492B00", "4D4D002B")


def read_table(spark: SparkSession, name: str, path: str, form: str = "parquet") -> DataFrame:
    """One of the stored tables with its schema; ``form`` is parquet, csv (with a header), json or orc."""
    reader = spark.read.schema(SCHEMAS[name]).format(form)
    return (reader.option("header", "true") if form == "csv" else reader).load(path)


def read_page_results(spark: SparkSession, path: str) -> DataFrame:
    """Page results kept as JSON: unknown keys are passed over, missing ones take their defaults."""
    rows = spark.read.schema(PAGE_RESULT).json(path)
    empty = {c: F.coalesce(c, F.lit("")) for c in ("student_id", "message", "skip_reason")}
    return rows.withColumns(empty | {"candidates": F.coalesce("candidates", F.array().cast("array<string>")), "blank": F.coalesce("blank", F.lit(False))})


def scan_files(files: DataFrame) -> DataFrame:
    """Of a ``binaryFile`` table the files of a taken type; a TIFF must begin as one."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    tiff = F.hex(F.substring("content", 1, 4)).isin(*TIFF)
    return files.where(ext.isin(*EXTENSIONS) & (~ext.isin("tif", "tiff") | tiff))


def list_new_pages(listing: DataFrame) -> DataFrame:
    """Inbox files to read, oldest first: images and PDFs with content, that no earlier pass has named."""
    kind = F.col("mime_type").startswith("image/") | (F.col("mime_type") == "application/pdf")
    return listing.where(kind & (F.col("size") > 0) & ~F.col("name").startswith("[")).orderBy("created_time", "id")


def latest_inbox_per_owner(folders: DataFrame) -> DataFrame:
    """Each owner's folder shared last; the owner is the first of the array, in lower case."""
    owner = F.lower(F.get("owners", F.lit(0))["emailAddress"])
    return folders.withColumn("owner", owner).where("owner is not null").groupBy("owner").agg(F.max_by("id", F.struct("shared_with_me_time", "id")).alias("folder_id"))


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def put_in_tree(rows: DataFrame, folder: str, parts: list[str], key: str) -> None:
    """Rows in a partitioned tree, by key: a row replaces the one of its key wherever that is, and all others stay.

    Only partitions that a key leaves or enters are written again: staged in the shared folder first, then swapped in by the commit of the dynamic overwrite. Those left empty are removed.
    """
    spark = rows.sparkSession
    rows = cut(rows)
    if not _exists(spark, folder):
        rows.repartition(*parts).write.mode("append").partitionBy(*parts).parquet(folder)
        return
    there = spark.read.schema(rows.schema).parquet(folder)
    keys = rows.select(key).distinct()
    left = there.select(key, *parts).join(keys, key).select(*parts)
    touched = cut(left.union(rows.select(*parts)).distinct())
    same = None
    for c in parts:
        one = there[c].eqNullSafe(touched[c])
        same = one if same is None else same & one
    stay = there.join(touched, same, "left_semi").join(keys, key, "left_anti")
    merged = cut(stay.select(*rows.columns).unionByName(rows))
    merged.repartition(*parts).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(folder)
    system = spark._jvm.org.apache.hadoop.fs
    for row in touched.exceptAll(merged.select(*parts).distinct()).collect():
        name = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
        place = system.Path("/".join([folder.rstrip("/"), *(name.getPartitionPathString(c, row[c]) for c in parts)]))
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def document_tree(documents: DataFrame) -> DataFrame:
    """Documents with the path of each and the cleaned names of the folders above it."""
    path = text.document_path(*(F.col(c) for c in ("school_name", "grade_name", "division_name", "student_name", "student_id", "code")))
    parts = {"school": text.safe_name("school_name", "Unknown school"), "grade": text.safe_name("grade_name", "Unknown grade"), "division": text.safe_name("division_name", "Unknown division")}
    return documents.withColumn("path", path).withColumns(parts)


def write_document_tree(documents: DataFrame, folder: str, key: str = "path") -> None:
    """Documents under school, grade and division, beside those of earlier calls. With the key of a document its old copy goes when its path changes; by path, one of the same path is replaced."""
    # names take far longer to make than to read, so that few large splits are dealt first
    dealt = documents.repartition(2 * documents.sparkSession.sparkContext.defaultParallelism)
    put_in_tree(document_tree(dealt), folder, ["school", "grade", "division"], key)


def settled_files(files: DataFrame, judged: DataFrame) -> DataFrame:
    """Files (file_id, owner, code, code_source) whose code is settled, with their batch's folder: typed, or of a document that needs nobody."""
    settled = judged.where("status not in ('needs_attention', 'waiting', 'failed')").select("owner", "code").distinct().withColumn("_ok", F.lit(True))
    routed = files.join(settled, ["owner", "code"], "left").where((F.col("code_source") == "typed") | F.col("_ok")).withColumn("folder", text.parse_batch_code("code")["folder"])
    return routed.where("folder is not null").drop("_ok")


def write_by_batch(files: DataFrame, judged: DataFrame, folder: str) -> None:
    """Settled files in a folder per batch; others stay where they are, and a corrected code moves its file."""
    put_in_tree(settled_files(files, judged), folder, ["folder"], "file_id")


def backup_before(df: DataFrame, columns: list[str], cutoff, folder: str) -> None:
    """The old values of rows that a correction of times will move, as JSON."""
    due = F.lit(False)
    for c in columns:
        due = due | (F.col(c) < cutoff)
    df.where(due).select("id", *columns).write.mode("overwrite").json(folder)
