"""The engine's queries over the given tables, one for each operator; results have scalar columns only."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import TriageOptions
from ..functions import columns as C
from ..functions.archive import zip_members
from ..operators import findings, scoring
from ..schemas import RESULT
from ..sinks import quarantine, reports
from ..sources import virtual
from ..sources.report import files_in, read_report
from ..sources.files import shared_folder
from ..streaming.changes import CHANGES, ChangeLog, changed, merged
from ..streaming.watch import Watcher
from .order import ranked
from .triage import explode_issues, file_columns, in_path_order, scan, scan_path, scan_relation

STRICT = TriageOptions(pdf_rules="strict", office_rules="strict", zip_rules="strict", image_rules="strict")
SMALL_FILES = 4000
ISSUE_FIELDS = ("code", "description", "evidence", "severity")


def _long(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def _detected(files: DataFrame, detector: findings.Detector, options: TriageOptions = TriageOptions()) -> DataFrame:
    """One row per distinct finding of a single detector."""
    if "members" not in files.columns:
        files = files.withColumn("members", F.array().cast("array<struct<name:string,stored_name:string>>"))
    found = files.select("path", F.explode_outer(F.array_distinct(detector(file_columns(options=options), options))).alias("i")).where("i is not null")
    return found.select("path", *(F.coalesce(F.col(f"i.{c}"), F.lit("")).alias(c) for c in ISSUE_FIELDS))


def fingerprint_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = C.file_name(F.col("path"))
    return virtual.documents(spark, sf_dir).select("path", C.sha256(F.col("content")).alias("sha256"), F.col("length").alias("size"), C.magic_type(F.col("content")).alias("magic_type"), C.suffix(name).alias("suffix"))


def is_text_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return virtual.documents(spark, sf_dir).select("path", C.is_text(F.col("content")).alias("is_text"))


def head_and_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.col("content")
    return virtual.documents(spark, sf_dir).select("path", F.hex(C.head(content, 16)).alias("head_hex"), F.hex(C.tail(content, 16)).alias("tail_hex"))


def size_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = scan_relation(virtual.documents(spark, sf_dir), TriageOptions(max_file_size=SMALL_FILES))
    return done.select("path", "size", "sha256", F.exists("issues", lambda i: i["code"] == "skipped_large").alias("skipped"))


def double_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detected(virtual.documents(spark, sf_dir), findings.double_extension).select("path", "description", "evidence")


def pe_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detected(virtual.documents(spark, sf_dir), findings.pe_header).select("path", "code", "description")


def pdf_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detected(virtual.documents(spark, sf_dir), findings.pdf_tokens).select("path", "description", "evidence")


def pdf_rules_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detected(virtual.documents(spark, sf_dir), findings.pdf_rules).select("path", "code", "description", "severity")


def pdf_rules_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detected(virtual.documents(spark, sf_dir), findings.pdf_rules, STRICT).select("path", "code", "description", "severity")


def url_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detected(virtual.documents(spark, sf_dir), findings.links).select("path", "code", "evidence")


def url_hosts_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detected(virtual.pages(spark, sf_dir), findings.links).select("path", "code", C.host(F.col("evidence")).alias("host")).distinct()


def zip_member_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detected(virtual.members(spark, sf_dir), findings.zip_contents).select("path", "code", "description", "evidence")


def zip_member_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detected(virtual.members(spark, sf_dir), findings.zip_rules).select("path", "code", "description", "severity")


def zip_member_rules_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detected(virtual.members(spark, sf_dir), findings.zip_rules, STRICT).select("path", "code", "description", "severity")


def office_rules_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = virtual.members(spark, sf_dir, ".docx")
    return _detected(files, lambda f, o: findings.joined(findings.office_macro(f, o), findings.office_rules(f, o))).select("path", "code", "description", "severity")


def office_macro_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detected(virtual.documents(spark, sf_dir), findings.office_macro).select("path", "code", "description")


def image_trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detected(virtual.images(spark, sf_dir), findings.image_trailing).select("path", "code", "description")


def image_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detected(virtual.images(spark, sf_dir), findings.image_rules, STRICT).select("path", "code", "description", "severity")


def marker_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detected(virtual.documents(spark, sf_dir), findings.marker_strings, TriageOptions(use_markers=True)).select("path", "code", "evidence")


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_relation(virtual.documents(spark, sf_dir))


def issues_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_issues(_results(spark, sf_dir)).select("path", *(F.coalesce(c, F.lit("")).alias(c) for c in ISSUE_FIELDS))


def weighted_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir).select("path", _long("score").alias("score"), F.array_join("reasons", ";").alias("reasons"))


def weighted_score_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sum by a join with the table of weights."""
    rows = explode_issues(_results(spark, sf_dir)).drop("weight").join(F.broadcast(scoring.weight_table(spark)), "code", "left")
    total = F.sum(F.coalesce("weight", F.lit(scoring.DEFAULT_WEIGHT)))
    return rows.groupBy("path").agg(_long(F.least(total, F.lit(scoring.CAP))).alias("score"))


def severity_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir).select("path", _long("score").alias("score"), "severity")


def severity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir).groupBy("severity").agg(F.count("*").alias("n_files"), _long(F.sum("score")).alias("total_score"), _long(F.max("score")).alias("max_score"))


def issue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of evidence lines that a report shows for a file: one at least."""
    return _results(spark, sf_dir).select("path", _long(F.greatest(F.size("issues"), F.lit(1))).alias("n_evidence"))


def exit_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.exit_code(_results(spark, sf_dir)).select(_long("exit_code").alias("exit_code"))


def path_sort_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each file in its folder, by path components: its place among all, from that of the folder's first file on."""
    files = ranked(virtual.documents(spark, sf_dir).select("path", F.substring_index("path", "/", 1).alias("folder")), C.path_order(F.col("path")), name="at")
    first = files.groupBy("folder").agg(F.min("at").alias("first"))
    return files.join(first, "folder").select("path", _long(F.col("at") - F.col("first") + 1).alias("place"))


def path_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each file among all files, by path components."""
    files = virtual.documents(spark, sf_dir).select("path").union(virtual.conversations(spark, sf_dir).select("path"))
    return ranked(files, C.path_order(F.col("path")))


def report_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report written by tasks as one document, and read back in splits: each file's place in it with what it says."""
    place = f"{shared_folder(spark)}/report-{uuid.uuid4().hex}.json"
    reports.save_json(in_path_order(_results(spark, sf_dir)), place)
    rows = read_report(spark, place).select("path", "sha256", "size", _long("score").alias("score"), "severity", _long(F.size("issues")).alias("n_issues"))
    return ranked(rows, C.path_order(F.col("path")))


def report_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a saved page that name a file, with their band and score."""
    place = f"{shared_folder(spark)}/page-{uuid.uuid4().hex}.html"
    reports.save_html(in_path_order(_results(spark, sf_dir)), place)
    line = F.regexp_extract
    parts = r'^<tbody><tr><th><span class="s\d">(\w+)</span><th>(\d+)<th>(.*)$'
    rows = spark.read.text(place).where(F.col("value").startswith("<tbody>"))
    return rows.select(line("value", parts, 3).alias("path"), line("value", parts, 1).alias("severity"), _long(line("value", parts, 2)).alias("score"))


def console_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.console_columns(_results(spark, sf_dir))


def console_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = reports.console_columns(_results(spark, sf_dir))
    return cells.agg(*(_long(F.max(F.length(c))).alias(f"{c}_width") for c in cells.columns))


def watch_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed between two listings: the latest event of each user, with and without the odd events."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat(F.lit("user_"), "user_id").alias("path"), "event_id", "ts")
    latest = lambda df: df.groupBy("path").agg(F.max("ts").alias("modificationTime"))
    out = changed(latest(events), latest(events.where("event_id % 2 = 0")))
    return out.select("path", F.date_format("modificationTime", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("changed_at"))


def targets_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [virtual.documents(spark, sf_dir), virtual.conversations(spark, sf_dir), virtual.documents(spark, sf_dir)]
    rows = [scan_relation(p).withColumn("target_idx", F.lit(k).cast("long")) for k, p in enumerate(parts)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).select("target_idx", "path", "sha256", _long("score").alias("score"))


def target_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths from one text: cut at semicolons, trimmed, empty ones left out."""
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.concat(F.lit(" "), "p_name", F.lit(";;"), "p_brand", F.lit(" ; ")).alias("raw"))
    return rows.select("p_partkey", F.explode(C.path_list(F.col("raw"))).alias("path"))


def json_issue(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = explode_issues(_results(spark, sf_dir)).where("code in ('double_extension', 'pe_header', 'pdf_javascript')")
    return found.select("path", F.to_json(F.struct(*ISSUE_FIELDS)).alias("issue"))


def scan_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, sf_dir).select(C.file_name(F.col("path")).alias("name"), "size", "sha256", "magic_type")


def triage_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir).select("path", "sha256", "size", "magic_type", _long(F.size("issues")).alias("n_issues"), _long("score").alias("score"), "severity")


def archive_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The directory of real ZIP files."""
    return virtual.archives(spark, sf_dir).select("path", F.posexplode(zip_members(F.col("content"))).alias("place", "m")).select("path", _long("place").alias("place"), "m.name")


def archives_scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings in real ZIP files."""
    return explode_issues(scan_relation(virtual.archives(spark, sf_dir), STRICT)).select("path", *(F.coalesce(c, F.lit("")).alias(c) for c in ISSUE_FIELDS))


def office_archives_scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the office rules in real documents."""
    return explode_issues(scan_relation(virtual.archives(spark, sf_dir, ".docx"))).where("code like 'office%'").select("path", "code", "description")


def error_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = scan_relation(virtual.unreadable(spark, sf_dir))
    return done.select("path", "sha256", "size", "magic_type", _long(F.when(F.col("error").isNotNull(), F.size("issues")).otherwise(0)).alias("n_issues"), "severity", F.coalesce("error", F.lit("")).alias("error"))


def error_exit_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.exit_code(scan_relation(virtual.unreadable(spark, sf_dir))).select(_long("exit_code").alias("exit_code"))


def empty_exit_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nothing to scan is no failure."""
    return scoring.exit_code(scan_relation(virtual.documents(spark, sf_dir).where("path = ''"))).select(_long("exit_code").alias("exit_code"))


def report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports read back, one row per file and finding."""
    files = virtual.reports(spark, sf_dir).select(F.explode(files_in(F.col("report"))).alias("f")).select("f.*")
    return files.select("path", "size", _long("score").alias("score"), F.col("issues")[0]["code"].alias("code"), F.coalesce(F.array_join("reasons", ";"), F.lit("none")).alias("reasons"))


def large_exif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images around the size from which embedded metadata is told, in strict mode."""
    images = virtual.sized(spark, sf_dir, ".jpg", "FFD8FF45786966", 5_000_001)
    return _detected(images, findings.image_rules, STRICT).select("path", "code", "description", "severity")


def url_size_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts around the size up to which links are looked for."""
    return _detected(virtual.sized(spark, sf_dir, ".txt", "687474703A2F2F612E622F63", 512_001), findings.links).select("path", "code", "evidence")


def markers_by_option(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the option for marker strings adds to a scan."""
    parts = [explode_issues(scan_relation(virtual.documents(spark, sf_dir), TriageOptions(use_markers=on))).where("code = 'marker_strings'").groupBy("evidence").agg(F.count("*").alias("n"), _long(F.sum("weight")).alias("points")) for on in (True, False)]
    return parts[0].unionByName(parts[1])


def rules_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings that stay when all rule sets are off."""
    off = TriageOptions(pdf_rules="off", office_rules="off", zip_rules="off", image_rules="off")
    files = virtual.documents(spark, sf_dir).unionByName(virtual.images(spark, sf_dir))
    return explode_issues(scan_relation(files, off)).groupBy("code").agg(F.count("*").alias("n"))


def watch_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state after two ticks: the newest time of every path, also of paths that are gone."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat(F.lit("user_"), "user_id").alias("path"), F.col("ts").alias("modificationTime"), "event_id")
    latest = lambda df: df.groupBy("path").agg(F.max("modificationTime").alias("modificationTime"))
    out = merged(latest(events.where("event_id % 3 = 0")), latest(events.where("event_id % 3 = 1")))
    return out.select("path", F.date_format("modificationTime", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("known_at"))


def _event_log(spark: SparkSession, sf_dir: str, ticks: int = 4) -> ChangeLog:
    """A log of as many listings: users as files, the time of the latest event so far as their time."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    log = ChangeLog(spark, f"{shared_folder(spark)}/events-{uuid.uuid4().hex}")
    for k in range(ticks):
        seen = events.where(F.col("event_id") % ticks <= k).groupBy(F.concat(F.lit("user_"), "user_id").alias("path"))
        log.record(seen.agg(F.max("ts").alias("modificationTime"), F.count("*").alias("length")))
    return log


def _changes(rows: DataFrame) -> DataFrame:
    return rows.select("path", F.date_format("modificationTime", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("changed_at"), "length", "generation")


def watch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the log knows of each path after four listings."""
    known = _event_log(spark, sf_dir).state()
    return known.select("path", F.date_format("modificationTime", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("known_at"), "generation")


def watch_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All changes of four listings, through the streaming source, in a first run of the query and a second one that goes on from its checkpoint."""
    log = _event_log(spark, sf_dir)
    out = f"{log.folder}/out"
    for _ in range(2):
        query = log.stream().writeStream.format("parquet").option("checkpointLocation", f"{log.folder}/checkpoint").option("path", out).trigger(availableNow=True).start()
        query.awaitTermination()
    return _changes(spark.read.schema(CHANGES).parquet(out))


def _below(folder: str) -> Column:
    """A path without the folder that it is in."""
    return F.substring_index("path", f"/{folder.rpartition('/')[2]}/", -1)


def watch_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What watch mode reports of real files: half of them, then the others and those that are written again."""
    files, work = virtual.documents(spark, sf_dir), f"{shared_folder(spark)}/watch-{uuid.uuid4().hex}"
    top, number = f"{work}/tree-{uuid.uuid4().hex}", F.regexp_extract("path", r"doc_(\d+)", 1).cast("long")
    watcher = Watcher(spark, top, f"{work}/store")
    for part in (number % 2 == 0, (number % 2 == 1) | (number % 10 == 0)):
        virtual.written(files.where(part), top)
        watcher.tick()
    rows = spark.read.schema(T.StructType([*RESULT, T.StructField("batch", T.LongType())])).json(f"{work}/store/results")
    return rows.select("batch", _below(top).alias("path"), "sha256", _long("score").alias("score"), "severity")


def quarantined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Real files of the two highest bands, moved, and what is left where they were."""
    work = f"{shared_folder(spark)}/moved-{uuid.uuid4().hex}"
    top = f"{work}/tree-{uuid.uuid4().hex}"
    virtual.written(virtual.documents(spark, sf_dir), top)
    moved = quarantine.quarantine_results(scan_path(spark, top, TriageOptions()), f"{work}/kept", ("High", "Suspicious"))
    gone = moved.where("error is null").select(_below(top).alias("path"), C.file_name(F.col("stored")).alias("stored"), "sha256")
    left = scan_path(spark, top, TriageOptions()).select(_below(top).alias("path"), F.lit("").alias("stored"), "sha256")
    return gone.union(left)


def genuine_replacement_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links with a U+FFFD of their own and with invalid bytes, which go."""
    own = virtual.pages(spark, sf_dir).select("path", "length", F.concat(F.encode(F.lit("http://a.b/x\ufffdy"), "UTF-8"), F.unhex(F.lit("C3")), F.encode(F.lit("\ufdd0 "), "UTF-8")).alias("link"))
    files = own.select("path", F.lit(5000).cast("long").alias("length"), F.concat(F.encode(F.repeat(F.lit(" "), 4096), "UTF-8"), "link").alias("content"))
    return _detected(files, findings.links).select("path", "code", "evidence")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        triage_full, fingerprint_docs, is_text_docs, head_and_tail, size_gate, double_extension, pe_header, pdf_tokens, pdf_rules_normal, pdf_rules_strict, url_extract, url_hosts_pages,
        zip_member_legacy, zip_member_rules, zip_member_rules_strict, office_rules_members, office_macro_docs, image_trailing, image_rules, marker_strings, issues_dedup, weighted_score, weighted_score_join,
        severity_bands, severity_summary, issue_counts, exit_code, path_sort_rank, path_rank, report_saved, report_page, console_rows, console_widths, watch_delta, targets_union, target_paths, json_issue, scan_tree,
        archive_members, archives_scanned, office_archives_scanned, error_rows, error_exit_code, empty_exit_code, report_files, large_exif, url_size_limit, markers_by_option, rules_off, watch_state, watch_log, watch_stream, watch_ticks, quarantined, genuine_replacement_characters,
    )}
