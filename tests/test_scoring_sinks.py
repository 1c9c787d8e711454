"""Scores, exit codes, reports, quarantine, watch mode and the command line."""

import json
import stat

import pytest
from pyspark.sql import functions as F

from sieveline import scan
from sieveline.cli import main
from sieveline.functions import columns as C
from sieveline.operators import scoring
from sieveline.schemas import ISSUES, RESULT
from sieveline.sinks import quarantine, reports
from sieveline.sources.report import read_report


def scored(spark, codes):
    df = spark.createDataFrame([([(c, "", None, None) for c in codes],)], "issues " + ISSUES.simpleString())
    return tuple(df.select(scoring.score(F.col("issues")), scoring.reasons(F.col("issues"))).first())


def test_score(spark):
    assert scored(spark, ["exe_in_zip", "pdf_token", "url"]) == (65, ["exe_in_zip: +40", "pdf_token: +20", "url: +5"])
    assert scored(spark, []) == (0, []) and scored(spark, ["zzz"]) == (5, ["zzz: +5"]) and scored(spark, ["pe_header"] * 3)[0] == 100


def test_bands(spark):
    points = [(p,) for p in (0, 19, 20, 49, 50, 79, 80, 100)]
    got = [r[0] for r in spark.createDataFrame(points, "p int").select(scoring.severity(F.col("p"))).collect()]
    assert got == ["Safe", "Safe", "Caution", "Caution", "Suspicious", "Suspicious", "High", "High"]


@pytest.mark.parametrize(("rows", "code"), [([], 0), ([("Safe", None)], 0), ([("Safe", None), ("Caution", None)], 1), ([("Suspicious", None)], 1), ([("High", None)], 2), ([("High", None), ("Safe", "e")], 3), ([("Safe", "")], 0)])
def test_exit_code(spark, rows, code):
    assert scoring.exit_code(spark.createDataFrame(rows, "severity string, error string")).first()[0] == code


def test_names(spark):
    names = [".pdf", "x.", "a.b.EXE", "..exe", "a/b.c/d.Txt"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(C.suffix(C.file_name(F.col("n")))).collect()]
    assert got == ["", "", ".exe", ".exe", ".txt"]


def results(spark, issues):
    return spark.createDataFrame([("<a>", "00", 1, "pe", issues, 50, "Suspicious", ["r"], None)], RESULT)


def test_json_and_console(spark, tmp_path):
    rows = results(spark, [("pe_header", "d", None, None), ("x", "d", "e&", "high")])
    entry = next(reports.dicts(rows))
    assert "error" not in entry and entry["issues"] == [{"code": "pe_header", "description": "d"}, {"code": "x", "description": "d", "evidence": "e&", "severity": "high"}]
    assert list(entry) == ["path", "sha256", "size", "magic_type", "issues", "score", "severity", "reasons"]
    reports.write_json([entry], str(tmp_path / "r.json"))
    back = read_report(spark, str(tmp_path / "r.json"))
    assert back.schema == RESULT and back.collect() == rows.collect()
    assert list(reports.console_lines(rows)) == ["Path | Severity   | Score | Issues      ", "-----+------------+-------+-------------".replace("-----+", "-----+", 1), "<a>  | Suspicious | 50    | pe_header, x"]
    assert list(reports.console_lines(results(spark, []).limit(0)))[0] == "Path | Severity | Score | Issues"


def test_old_report(spark, tmp_path):
    (tmp_path / "old.json").write_text(json.dumps({"files": [{"path": "p", "score": 75, "severity": "Suspicious", "issues": [{"code": "c", "description": "d"}]}]}))
    row = read_report(spark, str(tmp_path / "old.json")).first()
    assert (row["score"], row["reasons"], row["issues"][0]["code"]) == (75, None, "c")
    (tmp_path / "none.json").write_text("{}")
    assert read_report(spark, str(tmp_path / "none.json")).count() == 0


def test_html():
    page = "".join(reports.html_parts(iter([{"path": '<a>"; rm x', "severity": "High", "score": 1, "issues": [{"code": "c", "description": "<d>", "evidence": "&", "severity": '"><b>'}]}, {"path": "p", "severity": "?", "error": "<e>"}])))
    assert "<a>" not in page and "&lt;d&gt;" in page and "nothing found" in page and "&lt;e&gt;" in page and '&quot;&gt;&lt;b&gt;' in page
    assert '<span class="s3">High</span> 1' in page and '<span class="s0">?</span> 1' in page and "quarantine &#x27;&lt;a&gt;&quot;; rm x&#x27;" in page
    assert "Files: none" in "".join(reports.html_parts([]))


def test_reports_are_streamed(tmp_path):
    def rows():
        yield {"path": "a"}
        yield {"path": "b"}

    reports.write_json(rows(), str(tmp_path / "r.json"))
    assert [f["path"] for f in json.loads((tmp_path / "r.json").read_text())["files"]] == ["a", "b"]
    reports.write_json([], str(tmp_path / "none.json"))
    assert json.loads((tmp_path / "none.json").read_text())["files"] == []


def test_quarantine(tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.txt").write_text("abc")
    q = str(tmp_path / "q")
    assert quarantine.quarantine(str(tmp_path / "in"), q) == [f"{q}/a.txt"] and not (tmp_path / "in" / "a.txt").exists()
    assert not (tmp_path / "q" / "a.txt").stat().st_mode & (stat.S_IWUSR | stat.S_IWGRP | stat.S_IWOTH)
    note = json.loads((tmp_path / "q" / "a.txt.meta.json").read_text())
    assert note["sha256"].startswith("ba7816bf") and note["original_path"].endswith("in/a.txt") and note["quarantined_at"].endswith("Z")
    (tmp_path / "in" / "a.txt").write_text("abcd")  # another file of this name does not replace the first
    (second,) = quarantine.quarantine(str(tmp_path / "in" / "a.txt"), q)
    assert second != f"{q}/a.txt" and second.endswith(".txt") and open(second).read() == "abcd" and (tmp_path / "q" / "a.txt").read_text() == "abc"
    assert not [n for n in (tmp_path / "q").iterdir() if n.name.startswith(".incoming")]
    with pytest.raises(FileNotFoundError):
        quarantine.quarantine(str(tmp_path / "no"), q)


def test_quarantine_of_results(spark, tmp_path):
    for name, content in (("bad.pdf.exe", b"MZ powershell"), ("good.txt", b"x"), ("docs/sample.pdf", b"%PDF-1.4 /OpenAction /JavaScript")):
        (tmp_path / "t" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / name).write_bytes(content)
    rows = scan(spark, str(tmp_path / "t")).persist()
    rows.count()
    moved = quarantine.quarantine_results(rows, str(tmp_path / "q"), ["High", "Suspicious"])
    first = {tuple(r) for r in moved.collect()}
    assert {r[0].rsplit("/", 1)[1] for r in first} == {"bad.pdf.exe", "sample.pdf"} and all(r[1] and r[3] is None for r in first)
    assert {tuple(r) for r in moved.collect()} == first and (tmp_path / "t" / "good.txt").exists()  # a task that runs again
    changed = spark.createDataFrame([(str(tmp_path / "t" / "good.txt"), "0" * 64, "High"), (str(tmp_path / "gone"), "1" * 64, "High")], "path string, sha256 string, severity string")
    again = {r["path"]: r for r in quarantine.quarantine_results(changed, str(tmp_path / "q")).collect()}
    assert "changed" in again[str(tmp_path / "t" / "good.txt")]["error"] and again[str(tmp_path / "gone")]["stored"] is None and (tmp_path / "t" / "good.txt").exists()


def test_cli(spark, tmp_path, capsys):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "essay.pdf.exe").write_bytes(b"MZ")
    out = tmp_path / "out" / "r.json"
    assert main(["scan", str(tmp_path / "t"), str(tmp_path / "missing"), "--report-json", str(out), "--report-html", str(tmp_path / "out" / "r.html")]) == 1
    assert "double_extension, pe_header" in capsys.readouterr().out and json.loads(out.read_text())["files"][0]["score"] == 65
    assert main(["report", str(out), "--html", "--output", str(tmp_path / "again.html")]) == 0 and (tmp_path / "again.html").exists()
    with pytest.raises(SystemExit):
        main(["report", str(out), "--html"])
    assert main(["scan", str(tmp_path / "missing")]) == 0
    assert main(["quarantine", str(tmp_path / "t"), "--dest", str(tmp_path / "q")]) == 0 and (tmp_path / "q" / "essay.pdf.exe").exists()


def test_cli_quarantines_a_report(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "essay.pdf.exe").write_bytes(b"MZ")
    assert main(["scan", str(tmp_path / "t"), "--report-json", str(tmp_path / "r.json")]) == 1
    assert main(["quarantine", "--report", str(tmp_path / "r.json"), "--bands", "Suspicious", "--dest", str(tmp_path / "q")]) == 0
    assert (tmp_path / "q" / "essay.pdf.exe").exists() and not (tmp_path / "t" / "essay.pdf.exe").exists()
    with pytest.raises(SystemExit):
        main(["quarantine", "--dest", str(tmp_path / "q")])


def test_mime_labels_are_optional(spark):
    from sieveline import TriageOptions, scan_relation

    df = spark.createDataFrame([("a.pdf", 4, bytearray(b"%PDF /JS"))], "path string, length long, content binary")
    row = scan_relation(df, TriageOptions(use_magic=True)).first()
    assert row["magic_type"] in ("pdf", "application/pdf", "text/plain") and [i["code"] for i in row["issues"]] == ["pdf_token", "pdf_javascript"]


def test_content_is_not_read_over_the_limit(spark, tmp_path):
    (tmp_path / "big").write_bytes(b"x" * 100)
    from sieveline import TriageOptions

    assert [i["code"] for i in scan(spark, str(tmp_path), TriageOptions(max_file_size=99)).first()["issues"]] == ["skipped_large"]
