"""Command line: ``python -m sieveline scan|quarantine|report``."""

from __future__ import annotations

import argparse
import logging
import os
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from . import __version__
from .config import MODES, TriageOptions
from .operators import scoring
from .plans.triage import report_results, scan_targets
from .sinks import quarantine, reports
from .sources.files import exists, is_mounted
from .streaming.watch import Watcher

LOG = logging.getLogger("sieveline")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sieveline", description="Static content triage on Spark.")
    top.add_argument("--version", action="version", version=f"%(prog)s {__version__}")
    top.add_argument("--verbose", action="store_true")
    commands = top.add_subparsers(dest="command", required=True)
    scan = commands.add_parser("scan", help="scan files and folders")
    scan.add_argument("targets", nargs="*")
    scan.add_argument("--watch", help="scan this folder again and again")
    scan.add_argument("--watch-store", help="where watch mode keeps results and state (default: beside the folder)")
    scan.add_argument("--max-file-size", type=int, default=TriageOptions.max_file_size)
    scan.add_argument("--use-magic", action="store_true")
    scan.add_argument("--use-yara", "--use-markers", dest="use_markers", action="store_true")
    scan.add_argument("--threads", type=int, default=4, help="local worker threads, where no Spark master is set")
    scan.add_argument("--report-json", "--output", dest="report_json")
    scan.add_argument("--report-html")
    for kind in ("pdf", "office", "zip", "image"):
        scan.add_argument(f"--{kind}-rules", choices=MODES, default="normal")
    move = commands.add_parser("quarantine", help="move files into quarantine")
    move.add_argument("path", nargs="?", help="a file, or a folder whose files are moved")
    move.add_argument("--report", help="move the files of a JSON report instead")
    move.add_argument("--bands", nargs="+", default=list(quarantine.BANDS), help="severities of a report that are moved")
    move.add_argument("--dest", required=True)
    show = commands.add_parser("report", help="show a JSON report")
    show.add_argument("report")
    show.add_argument("--html", action="store_true")
    show.add_argument("--output")
    return top


def session(threads: int) -> SparkSession:
    builder = SparkSession.builder.appName("sieveline").config("spark.sql.session.timeZone", "UTC")
    return (builder if "SPARK_MASTER" in os.environ or SparkSession.getActiveSession() else builder.master(f"local[{max(threads, 1)}]")).getOrCreate()


def emit(results: DataFrame, report_json: str | None, report_html: str | None) -> int:
    """Write what is asked for; the exit code."""
    results = results.persist()
    try:
        if results.isEmpty():
            LOG.info("no files")
            return 0
        for line in reports.console_lines(results):
            print(line)
        for path, save in ((report_json, reports.save_json), (report_html, reports.save_html)):
            if path:
                save(results, os.path.abspath(path) if is_mounted(path) else path)
        return scoring.exit_code(results).first()[0]
    finally:
        results.unpersist()


def run_scan(args: argparse.Namespace) -> int:
    options = TriageOptions(args.max_file_size, args.use_magic, args.use_markers, args.pdf_rules, args.office_rules, args.zip_rules, args.image_rules)
    if args.watch:
        if not exists(session(args.threads), args.watch):
            raise SystemExit(f"{args.watch} does not exist")
        watcher = Watcher(session(args.threads), args.watch, args.watch_store or args.watch.rstrip("/") + ".watch", options, lambda r: emit(r, args.report_json, args.report_html))
        query = watcher.start()
        try:
            query.awaitTermination()
        except KeyboardInterrupt:
            query.stop()
        return watcher.exit_code
    if not args.targets:
        raise SystemExit("name at least one target")
    spark = session(args.threads)
    present = [t for t in args.targets if exists(spark, t)]
    for missing in (t for t in args.targets if t not in present):
        LOG.warning("%s does not exist", missing)
    return emit(scan_targets(spark, present, options), args.report_json, args.report_html) if present else 0


def run_report(args: argparse.Namespace) -> int:
    results = report_results(session(1), args.report)
    for line in reports.console_lines(results):
        print(line)
    if args.html:
        if not args.output:
            raise SystemExit("--html needs --output")
        reports.save_html(results, os.path.abspath(args.output) if is_mounted(args.output) else args.output)
    return 0


def run_quarantine(args: argparse.Namespace) -> int:
    if (args.path is None) == (args.report is None):
        raise SystemExit("name a path or a report")
    if args.report:
        code = 0
        for row in quarantine.quarantine_results(report_results(session(1), args.report), args.dest, args.bands).toLocalIterator():
            print(f"{row['path']}: {row['stored'] or row['error']}")
            code = scoring.EXIT_ERROR if row["error"] else code
        return code
    try:
        quarantine.quarantine(args.path, args.dest)
    except FileNotFoundError as e:
        raise SystemExit(f"{e} does not exist") from e
    return 0


def main(argv: Sequence[str] | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if args.verbose else logging.INFO, stream=sys.stderr)
    logging.getLogger("py4j").setLevel(logging.WARNING)
    if args.command == "scan":
        return run_scan(args)
    if args.command == "report":
        return run_report(args)
    return run_quarantine(args)
