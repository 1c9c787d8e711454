"""Findings, scores and bands of files, exactly."""

import io
import zipfile

import pytest

from sieveline import TriageOptions, explode_issues, scan, scan_relation, scan_targets
from sieveline.functions.archive import list_members

PNG = bytes.fromhex("89504E470D0A1A0A")
JPEG = bytes.fromhex("FFD8FF")
END = bytes.fromhex("FFD9")


def archive(*names: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n in names:
            z.writestr(n, b"x")
    return out.getvalue()


def results(spark, files, **options):
    df = spark.createDataFrame([(p, len(c), bytearray(c)) for p, c in files], "path string, length long, content binary")
    return {r["path"]: r for r in scan_relation(df, TriageOptions(**options)).collect()}


def codes(row):
    return [i["code"] for i in row["issues"]]


#: name, content, magic type, findings in order, score, band
FILES = [
    ("essay.pdf.exe", b"MZ", "pe", ["double_extension", "pe_header"], 65, "Suspicious"),
    ("test.pdf", b"%PDF-1.4 /JavaScript", "pdf", ["pdf_token", "pdf_javascript"], 55, "Suspicious"),
    ("doc.zip", archive("word/vbaProject.bin", "payload.exe"), "zip", ["zip_vba_project", "exe_in_zip", "zip_susp_executable"], 100, "High"),
    ("notes.txt", b"Visit http://xn--example.com for details", "unknown", ["url_suspicious"], 10, "Safe"),
    ("sample.pdf", b"%PDF-1.4 a /OpenAction b /JavaScript c", "pdf", ["pdf_token", "pdf_token", "pdf_auto_actions", "pdf_javascript"], 100, "High"),
    ("sample.zip", archive("homework.png.exe", "notes.txt"), "zip", ["exe_in_zip", "zip_double_extension", "zip_susp_executable", "zip_double_extension"], 100, "High"),
    ("sample.docx", archive("word/vbaProject.bin"), "zip", ["zip_vba_project", "office_macro_container", "office_vba_project"], 100, "High"),
    ("sample.png", PNG + b"...IEND" + b"x" * 20, "png", ["image_trailing_data", "png_appended_data"], 30, "Caution"),
    ("plain.txt", b"One harmless sentence.", "unknown", [], 0, "Safe"),
    ("small.png", PNG + b"dataIEND" + bytes.fromhex("AE426082"), "png", ["image_trailing_data"], 15, "Safe"),
    ("plain.docx", archive("word/document.xml"), "zip", [], 0, "Safe"),
    ("settings.docx", archive("word/settings.xml"), "zip", ["office_auto_actions_hint"], 15, "Safe"),
    ("not.zip", b"only text", "unknown", [], 0, "Safe"),
    ("lower.pdf", b"%PDF /javascript", "pdf", ["pdf_token"], 20, "Caution"),
    ("latin.pdf", bytes.fromhex("2F4ADF"), "unknown", [], 0, "Safe"),
    ("ok.jpg", JPEG + b"a" + END, "jpeg", [], 0, "Safe"),
    ("nul.jpg", JPEG + b"a" + END + b"\0\0", "jpeg", ["jpeg_appended_data"], 15, "Safe"),
    ("more.jpg", JPEG + b"a" + END + b"A", "jpeg", ["image_trailing_data", "jpeg_appended_data"], 30, "Caution"),
    ("slack8.png", PNG + b"IEND" + b"x" * 8, "png", ["image_trailing_data"], 15, "Safe"),
    ("slack9.png", PNG + b"IEND" + b"x" * 9, "png", ["image_trailing_data", "png_appended_data"], 30, "Caution"),
    ("old.docm", b"x", "unknown", ["office_macro_extension"], 30, "Caution"),
    ("empty.txt", b"", "unknown", [], 0, "Safe"),
]


DOUBLE = {"a.js.exe": 0, "a.v2.exe": 1, "a.exe": 0, "a.txt.js": 1, "a.gif.js": 0, ".pdf": 0, "x.": 0, "..exe": 0, "A.PDF.EXE": 1}
MEMBERS = [
    (["a.pdf.txt"], ["zip_double_extension"]), (["a.pdf.zip"], []), (["a.pdf"], []), (["x/a.jpg.exe"], ["exe_in_zip", "zip_double_extension", "zip_susp_executable", "zip_double_extension"]),
    (["a.jar"], ["zip_susp_executable"]), (["a.pif"], ["exe_in_zip"]), ([".exe"], ["exe_in_zip"]), (["A.EXE", "a.exe"], ["exe_in_zip", "exe_in_zip", "zip_susp_executable"]),
    (["n" * 180], []), (["n" * 181], ["zip_long_name"]), (["in.ZIP"], []), (["word/vbaProject.bin", "word/settings.xml"], ["zip_vba_project"]),
]
NUL_NAME = archive("abXcd.txt").replace(b"abXcd.txt", b"ab\0cd.txt")
LINKS = {
    "cut.txt": b"a" * 4095 + "é".encode() + b" http://a", "nul.txt": b"http://a\0", "limit.txt": b"http://a " + b"b" * (512_000 - 9), "over.txt": b"http://a " + b"b" * (512_000 - 8),
    "ip.txt": b"http://1.2.3.4/x", "port.txt": b"http://1.2.3.4:80/", "big.txt": b"http://999.1.1.1", "sub.txt": b"http://www.xn--a.b", "upper.txt": b"HTTP://a",
    "twice.txt": b"http://a http://a", "space.txt": "http://a\u00a0b http://c\u001cd".encode(), "broken.txt": b"x" * 4096 + b"\xff http://a\xff/b",
}


@pytest.fixture(scope="module")
def found(spark):
    """One scan for all cases with default options; each group has a folder."""
    files = [(f"files/{f[0]}", f[1]) for f in FILES] + [(f"double/{n}", b"x") for n in DOUBLE] + [(f"members/{k}.zip", archive(*names)) for k, (names, _) in enumerate(MEMBERS)]
    files += [(f"links/{n}", c) for n, c in LINKS.items()] + [("nul/a.zip", NUL_NAME), ("pdf/a.pdf", b"%PDF http://a")] + [(f"token/{at}.pdf", b" " * at + b"/EMBEDDEDFILE") for at in (4083, 4084, 4085, 4086)]
    return results(spark, files)


def test_files(found):
    for name, content, magic, expected, score, band in FILES:
        r = found[f"files/{name}"]
        assert (r["magic_type"], codes(r), r["score"], r["severity"], r["size"]) == (magic, expected, score, band, len(content)), name
        assert len(r["reasons"]) == len(expected) and r["error"] is None


def test_double_extension(found):
    for name, n in DOUBLE.items():
        assert codes(found[f"double/{name}"]) == ["double_extension"] * n, name


def test_members(spark, found):
    for k, (names, expected) in enumerate(MEMBERS):
        assert codes(found[f"members/{k}.zip"]) == expected, names
    assert codes(results(spark, [("a.zip", archive("in.ZIP"))], zip_rules="strict")["a.zip"]) == ["zip_nested_archive"]


def test_nul_in_member_name(found):
    assert list_members(NUL_NAME) == [("ab", "ab\0cd.txt")]
    assert codes(found["nul/a.zip"]) == ["zip_nul_byte"]


def test_links(found):
    got = {k: [(i["code"], i["evidence"]) for i in found[f"links/{k}"]["issues"]] for k in LINKS}
    assert got["cut.txt"] == got["nul.txt"] == got["over.txt"] == got["upper.txt"] == []
    assert got["limit.txt"] == got["twice.txt"] == [("url", "http://a")]
    assert [got[k][0][0] for k in ("ip.txt", "port.txt", "big.txt", "sub.txt")] == ["url_suspicious", "url", "url_suspicious", "url"]
    assert [e for _, e in got["space.txt"]] == ["http://a", "http://c"]
    assert got["broken.txt"] == [("url", "http://a/b")]


def test_modes(spark, found):
    assert codes(found["pdf/a.pdf"]) == ["url"]
    own = {"a.txt": "http://a/\ufffd\ufdd0\ufdd2".encode() + b"\xff" + "\ufdd0\ufdd1z".encode()}
    assert [i["evidence"] for i in results(spark, [*own.items()])["a.txt"]["issues"]] == []  # not text: invalid at the start
    late = b" " * 4096 + own["a.txt"]
    assert [i["evidence"] for i in results(spark, [("a.txt", late)])["a.txt"]["issues"]] == ["http://a/\ufffd\ufdd0\ufdd2\ufdd0\ufdd1z"]
    assert codes(results(spark, [("a.pdf", b"%PDF http://a")], pdf_rules="strict")["a.pdf"]) == ["url", "pdf_external_links"]
    everything = [("a.pdf", b"%PDF /JS"), ("b.png", PNG + b"IEND" + b"x" * 9), ("c.zip", archive("a.exe"))]
    got = results(spark, everything, pdf_rules="off", image_rules="off", zip_rules="off", office_rules="off")
    assert [codes(got[p]) for p, _ in everything] == [["pdf_token"], ["image_trailing_data"], ["exe_in_zip"]]


def test_token_over_any_boundary(found):
    for at in (4083, 4084, 4085, 4086):
        assert "pdf_token" in codes(found[f"token/{at}.pdf"])


def test_size_gate_and_markers(spark):
    got = results(spark, [("a", b"x" * 10), ("b", b"x" * 11)], max_file_size=10)
    assert codes(got["a"]) == [] and len(got["a"]["sha256"]) == 64
    b = got["b"]
    assert (codes(b), b["score"], b["severity"], b["reasons"], b["sha256"], b["magic_type"]) == (["skipped_large"], 0, "Safe", ["skipped_large"], "", "unknown")
    assert [i["evidence"] for i in results(spark, [("a", b"run powershell")], use_markers=True)["a"]["issues"]] == ["powershell"]
    with pytest.raises(ValueError, match="pdf_rules"):
        TriageOptions(pdf_rules="loud")


def test_tree(spark, tmp_path):
    for name in ("_u.exe", ".hid.txt", "a/b.txt", "a-b.txt", "z"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"MZ" if name == "_u.exe" else b"t")
    (tmp_path / "gone").symlink_to(tmp_path / "nowhere")
    rows = scan(spark, str(tmp_path)).collect()
    names = [r["path"][len(str(tmp_path)) + 1 :] for r in rows]
    assert names == sorted(names, key=lambda p: p.split("/")) and set(names) == {"_u.exe", ".hid.txt", "a/b.txt", "a-b.txt", "z", "gone"}
    gone = next(r for r in rows if r["path"].endswith("gone"))
    assert gone["error"] and gone["severity"] == "Safe" and gone["sha256"] == ""
    one = str(tmp_path / "z")
    assert [r["path"] for r in scan_targets(spark, [one, one]).collect()] == [one, one]
    assert scan(spark, str(tmp_path / "a" / "b.txt")).count() == 1
    (tmp_path / "none").mkdir()
    assert scan(spark, str(tmp_path / "none")).count() == 0 and scan_targets(spark, []).count() == 0
    plan = scan(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1  # files are read once
    assert explode_issues(scan(spark, str(tmp_path / "_u.exe"))).select("code", "weight").collect() == [("pe_header", 50)]


def test_null_contents_keep_their_row(spark):
    df = spark.createDataFrame([("a.txt", None, None), ("b.txt", 2, bytearray(b"hi")), ("c.txt", 9, bytearray(b"too large"))], "path string, length long, content binary")
    got = {r["path"]: r for r in scan_relation(df, TriageOptions(max_file_size=5)).collect()}
    assert sorted(got) == ["a.txt", "b.txt", "c.txt"]
    assert (got["a.txt"]["size"], got["a.txt"]["sha256"], codes(got["a.txt"]), got["a.txt"]["score"], got["a.txt"]["severity"]) == (None, None, [], 0, "Safe")


def test_an_archive_is_made_once(spark, sf_dir):
    """What names a content many times runs the step that makes it once; each archive is one row of a length that is its own."""
    import re

    from sieveline import scan_relation
    from sieveline.sources import virtual

    plan = scan_relation(virtual.archives(spark, sf_dir, ".docx"))._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"(\w+)InArrow|(\w+)EvalPython", plan) == [("", "Arrow"), ("Map", "")] and plan.count("pythonUDF0") and "pythonUDF1" not in plan
    rows = virtual.archives(spark, sf_dir).collect()
    named = {r["path"]: [m["name"] for m in r["members"]] for r in virtual.members(spark, sf_dir).collect()}
    assert {r["path"]: [a for a, _ in list_members(bytes(r["content"]))] for r in rows} == named and len(rows) == len(named)
    assert all(r["length"] == len(r["content"]) for r in rows)


def test_directories_are_held_one_at_a_time():
    """Listing a batch of archives takes the objects of one of them, not of all."""
    import tracemalloc

    import pyarrow as pa

    from sieveline.functions import archive as module

    content = archive(*(f"folder/member{k}.txt" for k in range(1000)))

    def peak(n: int) -> int:
        contents = pa.array([content] * n, pa.binary())
        tracemalloc.start()
        try:
            assert len(module._members(contents)) == n
            return tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    peak(1)
    assert peak(24) < 2 * peak(1)
    got = module._members(pa.array([content, None, b"x", NUL_NAME], pa.binary())).to_pylist()
    assert [len(g) for g in got] == [1000, 0, 0, 1] and got[3] == [{"name": "ab", "stored_name": "ab\0cd.txt"}]
    assert module._members(pa.array([], pa.binary())).type == pa.list_(module.MEMBER)
