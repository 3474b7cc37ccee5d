"""Pages into documents, and what state each document is in.

Pages: page_id, owner, received_ns, source_page, school, location, status, code, student_id, matched_student_id, skip_reason.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from intake.functions.text import as_id, parse_batch_code
from intake.operators import lookup
from intake.shared import cut, numbered

# Schools whose forms carry no code, reasons that mark later pages, and limits.
UNCODED_SCHOOLS, LATER, MAX_PAGES, MAX_FORMS = ("BOPEMS",), ("declaration", "continuation"), 3, 999
ORDER = ("received_ns", "source_page", "page_id")


def page_view(meta: DataFrame, results: DataFrame, overrides: DataFrame) -> DataFrame:
    """What is known of each page: what a person typed beats what was read, if it is a code or has an identifier's shape; an empty entry is none.

    ``needs_person``: the page failed, or was read without a code or an identifier (where ``status`` is given).
    """
    some = lambda c: F.when(c != "", c)
    typed = overrides.select("page_id", parse_batch_code("code")["code"].alias("_c"), some(as_id("student_id")).alias("_s"))
    joined = meta.join(results, "page_id", "left").join(typed, "page_id", "left")
    source = lambda o, r: F.when(F.col(o).isNotNull(), "typed").when(F.coalesce(F.col(r), F.lit("")) != "", "read").otherwise("none")
    view = joined.withColumns({"code_source": source("_c", "code"), "student_id_source": source("_s", "student_id"), "code": F.coalesce("_c", some(F.col("code"))), "student_id": F.coalesce("_s", "student_id", F.lit(""))}).drop("_c", "_s")
    if "status" not in view.columns:
        return view
    return view.withColumn("needs_person", (F.col("status") == "failed") | ((F.col("status") == "read") & (F.col("code").isNull() | (F.col("student_id") == ""))))


def open_pages(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """Pages in no confirmed document (page_ids: array)."""
    return pages.join(documents.select(F.explode("page_ids").alias("page_id")), "page_id", "left_anti")


def scan_order(pages: DataFrame) -> DataFrame:
    order = Window.partitionBy("owner").orderBy(*ORDER)
    return pages.withColumns({"position": F.row_number().over(order), "next_open": F.lead((F.col("status").isin("queued", "reading")) & F.col("code").isNull()).over(order)})


def pair_uncoded(pages: DataFrame) -> DataFrame:
    """Pages without a code at listed schools, that form documents by scan order, with their automatic code. Nulls and empty values are alike."""
    pages = pages.withColumns({c: F.coalesce(c, F.lit("")) for c in ("code", "status", "student_id", "skip_reason")})
    read, has_id = F.col("status") == "read", F.col("student_id") != ""
    rows = pages.where((F.col("code") == "") & F.upper(F.trim("school")).isin(*UNCODED_SCHOOLS)).where(~(read & ~has_id & (F.col("skip_reason") == "blank")))
    starter = read & has_id
    head = ~(read & ~has_id & F.col("skip_reason").isin(*LATER))
    order = Window.partitionBy("owner").orderBy(*ORDER)
    run = Window.partitionBy("owner", "_run").orderBy(*ORDER)
    runs = rows.withColumns({"_run": F.sum(head.cast("int")).over(order), "_starter": starter})
    marked = runs.withColumns({"_at": F.row_number().over(run), "_head": F.first(F.struct("_starter", "school", "location")).over(run)})
    other = ~(F.col("school").eqNullSafe(F.col("_head.school")) & F.col("location").eqNullSafe(F.col("_head.location")))
    joined = marked.withColumn("_bad", F.max(other).over(run)).where(F.col("_head._starter") & (F.col("_run") > 0) & (F.col("_at") <= MAX_PAGES) & ~F.col("_bad"))
    numbered = joined.withColumn("_n", F.dense_rank().over(Window.partitionBy("owner").orderBy("_run"))).where(F.col("_n") <= MAX_FORMS)
    return numbered.select("page_id", F.concat(F.lit("B0-"), F.col("_n").cast("string")).alias("auto_code"))


def with_codes(pages: DataFrame) -> DataFrame:
    """Pages in scan order, with the code of their document (null: unsorted)."""
    return scan_order(pages).join(pair_uncoded(pages), "page_id", "left").withColumn("doc_code", F.coalesce("code", "auto_code"))


def assemble(coded: DataFrame) -> DataFrame:
    part = F.struct("position", "page_id", "status", "student_id", "matched_student_id", "next_open", "school", "location")
    return coded.where("doc_code is not null").groupBy("owner", F.col("doc_code").alias("code")).agg(F.array_sort(F.collect_list(part)).alias("parts"))


def unsorted(coded: DataFrame) -> DataFrame:
    return coded.where("doc_code is null and status in ('read', 'failed')").select("owner", "page_id")


def document_ids(documents: DataFrame) -> DataFrame:
    """Distinct matched people and distinct readings of each document's parts."""
    ids = lambda f: F.array_sort(F.array_distinct(F.filter(F.transform("parts", lambda p: p[f]), lambda x: x.isNotNull() & (x != ""))))
    return documents.withColumns({"matched": ids("matched_student_id"), "read_ids": ids("student_id")})


def judge(documents: DataFrame, confirmed: DataFrame | None = None) -> DataFrame:
    """Status, reasons and person of each document. ``confirmed``: owner, code of documents already confirmed."""
    df = document_ids(documents)
    reused = F.lit(False)
    if confirmed is not None:
        df = df.join(confirmed.select("owner", "code", F.lit(True).alias("_done")).distinct(), ["owner", "code"], "left")
        reused = F.coalesce("_done", F.lit(False)) & ~F.col("code").startswith("B0-")
    conflict = (F.size("matched") > 1) | ((F.size("matched") == 0) & (F.size("read_ids") > 1))
    student = F.when(F.size("matched") == 1, F.col("matched")[0]).when((F.size("matched") == 0) & (F.size("read_ids") == 1), F.col("read_ids")[0]).otherwise("")
    reasons = F.filter(F.array(
        F.when(conflict, "conflict"), F.when(~conflict & (F.size("matched") == 0) & (F.size("read_ids") == 1), "no_match"),
        F.when((F.size("matched") == 0) & (F.size("read_ids") == 0), "no_id"), F.when(reused, "code_reused"),
    ), lambda x: x.isNotNull())
    unread = F.exists("parts", lambda p: p["status"].isin("queued", "reading")) | F.coalesce(F.element_at("parts", -1)["next_open"], F.lit(False))
    status = F.when(unread, "waiting").when(F.exists("parts", lambda p: p["status"] == "failed"), "failed").when(F.size("reasons") > 0, "needs_attention").otherwise("ready")
    return df.withColumns({"student": student, "reasons": reasons}).withColumn("status", status).withColumn("pages", F.size("parts"))


def flag_same_student(judged: DataFrame, confirmed: DataFrame | None = None) -> DataFrame:
    """Ready documents whose matched person is on another open or a confirmed document (owner, student) of the owner need attention."""
    one = F.when(F.size("matched") == 1, F.col("matched")[0])
    counted = judged.withColumn("_m", one)
    groups = counted.where("_m is not null").groupBy("owner", "_m").agg((F.count("*") - 1).alias("_others"))
    df = counted.join(groups, ["owner", "_m"], "left")
    done = F.lit(False)
    if confirmed is not None:
        df = df.join(confirmed.select("owner", F.col("student").alias("_m"), F.lit(True).alias("_was")).distinct(), ["owner", "_m"], "left")
        done = F.coalesce("_was", F.lit(False))
    held = (F.col("status") == "ready") & (F.coalesce(F.col("_others") > 0, F.lit(False)) | done)
    return df.withColumns({"reasons": F.when(held, F.array_append("reasons", "same_student")).otherwise(F.col("reasons")), "status": F.when(held, "needs_attention").otherwise(F.col("status"))}).drop("_m", "_others", "_was")


STATUSES = ("queued", "reading", "read", "failed")
DOCUMENT_STATUSES = ("waiting", "ready", "needs_attention", "confirmed", "uploaded", "failed")


def queue_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("owner").pivot("status", list(STATUSES)).count().fillna(0, list(STATUSES))


def batch_summary(judged: DataFrame) -> DataFrame:
    batch = F.regexp_extract("code", "^B([0-9]+)-", 1).cast("int")
    counts = [F.count(F.when(F.col("status") == s, 1)).alias(s) for s in DOCUMENT_STATUSES]
    grouped = judged.groupBy("owner", batch.alias("batch")).agg(F.count("*").alias("documents"), F.sum("pages").alias("pages"), *counts)
    return grouped.withColumn("label", F.when(F.col("batch") == 0, "No code").otherwise(F.concat(F.lit("B"), F.col("batch").cast("string"))))


def same_parts(shown: DataFrame, current: DataFrame) -> DataFrame:
    """Documents (owner, code) whose shown page ids (page_ids) are the current ones as a set."""
    now = current.select("owner", "code", F.array_sort(F.transform("parts", lambda p: p["page_id"])).alias("_now"))
    return shown.join(now, ["owner", "code"]).where(F.array_sort(F.array_distinct("page_ids")) == F.col("_now")).drop("_now")


def all_documents(open_: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Open and confirmed documents as one table; what one side lacks is null there."""
    return open_.unionByName(confirmed, allowMissingColumns=True)


def confirm_documents(shown: DataFrame, judged: DataFrame, roster: DataFrame, locations: DataFrame) -> DataFrame:
    """What becomes of each document that people confirm together. ``shown``: owner, code, student_id (as confirmed), page_ids; ``judged``: the open documents with parts and status.

    Outcomes in this order: gone (no such open document), waiting (a part is unread), changed (other pages than shown), not_an_id, not_found (in the document's
    school or city), confirmed with the person. Refused rows change nothing: only confirmed ones carry a person.
    """
    first = F.get("parts", F.lit(0))
    now = judged.select("owner", "code", "status", F.array_sort(F.transform("parts", lambda p: p["page_id"])).alias("_now"), first["school"].alias("scan_school"), first["location"].alias("scan_location"))
    asked = shown.select("owner", "code", as_id("student_id").alias("reading"), F.array_sort(F.array_distinct("page_ids")).alias("_shown")).join(now, ["owner", "code"], "left")
    refused = (
        F.when(F.col("status").isNull(), "gone").when(F.col("status") == "waiting", "waiting")
        .when((F.size("_shown") == 0) | (F.col("_shown") != F.col("_now")), "changed").when(F.col("reading") == "", "not_an_id")
    )
    marked = cut(asked.withColumn("_refused", refused).drop("status", "_now", "_shown"))
    found = lookup.find_student(marked.where("_refused is null"), roster, locations)
    looked = found.withColumn("outcome", F.when(F.col("matched_via").isNull(), "not_found").otherwise("confirmed"))
    kept = marked.where("_refused is not null").withColumn("outcome", F.col("_refused"))
    return looked.unionByName(kept, allowMissingColumns=True).select("owner", "code", "outcome", F.col("reading").alias("confirmed_student_id"), "person", "student_id", "matched_via")


def confirmed_documents(records: DataFrame, as_of, hours: int = 72) -> DataFrame:
    """Confirmed or uploaded (with its log row and link); finished ones stay for ``hours``, others for good."""
    done = F.col("uploaded") & F.col("log_id").isNotNull() & F.col("log_has_link")
    return records.withColumn("status", F.when(done, "uploaded").otherwise("confirmed")).where(~done | (F.col("confirmed_at") > as_of - F.make_interval(hours=F.lit(hours))))


#: Files of one name that are matched with the numbers they take in one go.
NAMES = 4096


def free_names(files: DataFrame, taken: DataFrame) -> DataFrame:
    """Names made unique per folder. Files: file_id, folder, name; taken: folder, name.

    The first file (by id) of a name keeps it unless it is taken; the others get the next free number of `` (2)``, `` (3)`` and so on, where names that are taken and names of other files
    are not free. The numbers come from the gaps between the used ones, so that neither a folder nor a name has to fit one task.
    """
    held = taken.select("folder", "name").union(files.select("folder", "name")).distinct()
    part = lambda k: F.regexp_extract("name", r"^(?s)(.*) \(([1-9][0-9]{0,8})\)(\.[^.]*)?$", k)
    used = held.select("folder", F.concat(part(1), part(3)).alias("name"), part(2).try_cast("long").alias("_n")).where("_n >= 2")
    first = taken.select(F.col("folder").alias("_f"), F.col("name").alias("_t")).distinct()
    ranked = numbered(files, ["folder", "name"], ["file_id"], "_k").join(first, F.col("folder").eqNullSafe(F.col("_f")) & (F.col("name") == F.col("_t")), "left")
    ranked = ranked.withColumn("_r", F.col("_k") - F.when(F.col("_t").isNull(), 1).otherwise(0)).drop("_k", "_f", "_t")
    needed = ranked.where("_r > 0").groupBy("folder", "name").agg(F.max("_r").alias("_most"))
    # numbers free below each used one; of used ones in a row the last counts
    gaps = numbered(used, ["folder", "name"], ["_n"], "_i").withColumn("_free", F.col("_n") - 1 - F.col("_i")).groupBy("folder", "name", "_free").agg(F.max("_i").alias("_skip"))
    gaps = numbered(gaps, ["folder", "name"], ["_free"], "_j")
    after = gaps.select(F.col("folder").alias("_f"), F.col("name").alias("_t"), (F.col("_j") - 1).alias("_before"), F.col("_free").alias("_next"))
    spans = gaps.join(after, F.col("folder").eqNullSafe(F.col("_f")) & (F.col("name") == F.col("_t")) & (F.col("_j") == F.col("_before")), "left").drop("_f", "_t")
    most = needed.select(F.col("folder").alias("_f"), F.col("name").alias("_t"), "_most")
    spans = spans.join(most, F.col("folder").eqNullSafe(F.col("_f")) & (F.col("name") == F.col("_t"))).withColumn("_to", F.least(F.coalesce("_next", "_most"), "_most")).where("_free < _to")
    spans = spans.select("_f", "_t", "_free", "_to", "_skip", F.explode(F.sequence(F.floor(F.col("_free") / NAMES), F.floor((F.col("_to") - 1) / NAMES))).alias("_b"))
    met = F.col("folder").eqNullSafe(F.col("_f")) & (F.col("name") == F.col("_t")) & (F.floor((F.col("_r") - 1) / NAMES) == F.col("_b")) & (F.col("_r") > F.col("_free")) & (F.col("_r") <= F.col("_to"))
    number = (F.col("_r") + 1 + F.coalesce("_skip", F.lit(0))).cast("string")
    stem, ext = F.regexp_extract("name", r"^(?s)(.*?)(\.[^.]*)?$", 1), F.regexp_extract("name", r"^(?s)(.*?)(\.[^.]*)?$", 2)
    named = F.when(F.col("_r") == 0, F.col("name")).otherwise(F.concat(stem, F.lit(" ("), number, F.lit(")"), ext))
    return ranked.join(spans, met, "left").withColumn("free_name", named).select(*files.columns, "free_name")
