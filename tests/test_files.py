"""Listing and reading files of a mounted folder and of another store, the log of changes, watch mode."""

import builtins
import hashlib
import io
import json
import os
import random
import subprocess
import sys
import time
import zipfile
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual, StringContains, StringStartsWith

from sieveline import TriageOptions, scan
from sieveline.operators import findings
from sieveline.plans import triage
from sieveline.schemas import FILE
from sieveline.sinks import quarantine
from sieveline.sources import facts, tree, virtual
from sieveline.sources.files import Mounted, files_of
from sieveline.streaming.changes import CHANGES, ChangeLog, committed, last_manifest
from sieveline.streaming.watch import Watcher

ROOT = Path(__file__).resolve().parents[1]
LIMIT = 60


@pytest.fixture
def folder(tmp_path):
    """Hidden names, folders in folders, a file over the limit, and one whose checksum is wrong for Hadoop's file systems."""
    top = tmp_path / "in"
    for i in range(3):
        (top / f"d{i}" / "x" / "y").mkdir(parents=True)
        for j in range(3):
            (top / f"d{i}" / "x" / f"f{j}.txt").write_text("a" * (10 * j))
        (top / f"d{i}" / "x" / "y" / "deep.exe").write_bytes(b"MZ")
    (top / ".hidden").write_text("h")
    (top / "_under").write_text("u")
    (top / ".folder").mkdir()
    (top / ".folder" / "q.pdf.exe").write_text("q")
    (top / "big").write_bytes(b"x" * (LIMIT + 1))
    (top / "bad.bin").write_bytes(b"z" * 50)
    return top


@pytest.fixture
def store(spark, folder):
    """The same folder by a scheme that only Hadoop knows, with a wrong checksum for one file."""
    (folder / ".bad.bin.crc").write_bytes(b"crc\0\0\0\2\0\1\2\3\4")
    name = f"s{abs(hash(str(folder))) % 10**8}"
    spark.sparkContext._jsc.hadoopConfiguration().set(f"fs.viewfs.mounttable.{name}.link./in", f"file://{folder}")
    return f"viewfs://{name}/in"


def names(rows, root):
    return {r["path"].removeprefix(str(root)).lstrip("/"): r for r in rows}


@pytest.mark.parametrize("at_once", [1, 2, 256])
def test_listing_level_by_level(spark, folder, at_once):
    want = {os.path.relpath(os.path.join(d, f), folder): os.path.getsize(os.path.join(d, f)) for d, _, found in os.walk(folder) for f in found}
    os.symlink("/nowhere", folder / "dangling")
    os.symlink(folder / "d0", folder / "linked")
    want["dangling"] = 0
    got = tree.list_files(spark, str(folder), at_once)
    assert got.columns == ["path", "modificationTime", "length"]
    assert {k: r["length"] for k, r in names(got.collect(), folder).items()} == want
    one = tree.list_files(spark, str(folder / "big")).collect()
    assert [(r["path"], r["length"]) for r in one] == [(str(folder / "big"), LIMIT + 1)]
    assert tree.list_files(spark, str(folder / "missing")).count() == 0


def test_store_reads_as_a_mounted_folder_does(spark, folder, store):
    mounted = names(tree.read_files(spark, str(folder), LIMIT).where("not endswith(path, '.crc')").collect(), folder)
    other = names(tree.read_files(spark, store, LIMIT).collect(), store)
    assert set(other) == set(mounted) and len(other) == 17
    bad = other.pop("bad.bin")
    assert bad["content"] is None and "hecksum" in bad["error"] and mounted.pop("bad.bin")["error"] is None
    for k, r in other.items():
        assert r["error"] is None and r["length"] == mounted[k]["length"] and r["content"] == mounted[k]["content"], k
        assert abs((r["modificationTime"] - mounted[k]["modificationTime"]).total_seconds()) < 0.01, k
    assert other["big"]["content"] is None and other[".folder/q.pdf.exe"]["content"] == b"q"
    found = {k: [i["code"] for i in r["issues"]] for k, r in names(scan(spark, store, TriageOptions(max_file_size=LIMIT)).collect(), store).items()}
    assert found["big"] == ["skipped_large"] and found["bad.bin"] == [] and found[".folder/q.pdf.exe"] == ["double_extension"] and found["d1/x/y/deep.exe"] == ["pe_header"]


def test_given_paths_are_read_and_nothing_else(spark, folder, store):
    for root in (str(folder), store):
        some = spark.createDataFrame([(f"{root}/.hidden", 1), (f"{root}/gone", 5), (f"{root}/big", LIMIT + 1)], "path string, length long")
        got = names(tree.read_listed(some, root, LIMIT).collect(), root)
        assert set(got) == {".hidden", "gone", "big"} and got[".hidden"]["content"] == b"h" and got["gone"]["error"] and got["big"]["content"] is None


def test_store_writes_and_removes(spark, store, tmp_path):
    for path in (f"{store}/new/a.json", str(tmp_path / "new" / "a.json")):
        files, place = files_of(spark, path)
        files.write(place, b"one")
        files.write(place, b"two" * 10)
        assert files.read(place) == b"two" * 10 and files.exists(place) and [e.path.rpartition("/")[2] for e in files.entries(place.rpartition("/")[0])] == ["a.json"]
        assert b"".join(files.blocks(place, 7)) == b"two" * 10
        files.remove(place.rpartition("/")[0])
        assert not files.exists(place)
        with pytest.raises(FileNotFoundError):
            files.read(place)


def test_filters_are_pushed(spark, folder):
    rows = tree.read_tree(spark, str(folder))
    some = rows.where(f"length <= 10 and startswith(path, '{folder}/d1') and modificationTime > timestamp'2020-01-01'")
    plan = spark._jvm.PythonSQLUtils.explainString(some._jdf.queryExecution(), "formatted")
    assert "LessThanOrEqual(length,10)" in plan and "StringStartsWith" in plan and "GreaterThan(modificationTime" in plan
    assert set(names(some.collect(), folder)) == {"d1/x/f0.txt", "d1/x/f1.txt", "d1/x/y/deep.exe"}
    assert rows.where("length > 10 and modificationTime < timestamp'2020-01-01'").count() == 0
    listed = tree.read_tree(spark, str(folder), columns=["path", "length"])
    assert listed.columns == ["path", "length"] and listed.where("length = 20 and contains(path, 'd2')").count() == 1
    with pytest.raises(Exception, match="no column"):
        spark.read.format("file_tree").schema("path string, other long").load(str(folder)).collect()


def test_listing_opens_nothing(folder, monkeypatch):
    """The reader itself, with opened files and listed folders counted."""
    opened, listed, plain, scanner = [], [], builtins.open, os.scandir
    monkeypatch.setattr(builtins, "open", lambda path, *a, **k: (opened.append(str(path)), plain(path, *a, **k))[1])
    monkeypatch.setattr(os, "scandir", lambda path: (listed.append(str(path)), scanner(path))[1])

    def read(columns, *filters):
        opened.clear()
        listed.clear()
        reader = tree.TreeReader({"path": str(folder), "maxfilesize": str(LIMIT)}, FILE.__class__([FILE[c] for c in columns]))
        left = list(reader.pushFilters(list(filters)))
        rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
        return len(left), {r["path"].removeprefix(f"{folder}/") for r in rows}

    assert read(["path", "length"])[0] == 0 and not opened
    left, got = read(FILE.names, LessThanOrEqual(("length",), 10), StringContains(("path",), "d"))
    assert left == 1 and len(opened) == len(got) == 12 and "big" not in got  # the limit holds beside the filter
    left, got = read(FILE.names, StringStartsWith(("path",), f"{folder}/d1/x/f"), GreaterThan(("length",), 5))
    assert left == 0 and got == {"d1/x/f1.txt", "d1/x/f2.txt"} and len(opened) == 2 and sorted(listed) == [str(folder), *(f"{folder}/d1{e}" for e in ("", "/x"))]
    left, got = read(["path"], In(("path",), (f"{folder}/big", f"{folder}/d2/x/f0.txt")), EqualTo(("path",), f"{folder}/big"))
    assert got == {"big"} and not opened and listed == [str(folder)]


def listing(spark, rows):
    return spark.createDataFrame(rows, "path string, seconds double, length long").select("path", F.timestamp_seconds("seconds").alias("modificationTime"), "length")


def size_of(folder, since):
    return sum(os.path.getsize(p) for d, _, found in os.walk(folder) for f in found if os.path.getmtime(p := os.path.join(d, f)) >= since)


def test_log_of_changes(spark, tmp_path):
    log = ChangeLog(spark, str(tmp_path / "log"))
    ticks = [
        ([("a", 1.0), ("b", 1.0)], {"a", "b"}), ([("a", 1.0), ("b", 1.0)], set()), ([("b", 2.0), ("c", 1.5)], {"b", "c"}), ([("a", 1.0), ("b", 2.0)], set()), ([("b", 1.0)], {"b"}), ([("b", 1.0)], set()), ([], set()), ([("d", None)], {"d"}), ([("d", None)], set()),
    ]
    generation, known = 0, {}
    for rows, want in ticks:
        assert log.record(listing(spark, [(p, t, 1) for p, t in rows])) == len(want)
        if want:
            generation += 1
            known |= {p: generation for p in want}
            assert {(r["path"], r["generation"]) for r in log.changes(generation).collect()} == {(p, generation) for p in want}
        assert {r["path"]: r["generation"] for r in log.state().collect()} == known
    assert {r["path"]: r["modificationTime"].timestamp() for r in log.state().where("modificationTime is not null").collect()} == {"a": 1.0, "b": 1.0, "c": 1.5}


def test_a_tick_writes_what_changed(spark, tmp_path):
    """10^5 known paths, then single changes: what is written does not grow with what is known."""
    log = ChangeLog(spark, str(tmp_path / "log"))
    base = spark.range(100_000).select(F.format_string("folder/file-%08d", "id").alias("path"), F.timestamp_seconds(F.lit(1000)).alias("modificationTime"), F.lit(1).cast("long").alias("length"))
    assert log.record(base) == 100_000
    whole = size_of(tmp_path, 0)
    for k in range(4):
        one = base.withColumn("modificationTime", F.when(F.col("path").endswith(f"{k:08d}"), F.timestamp_seconds(F.lit(2000 + k))).otherwise(F.when(F.substring("path", -8, 8).cast("int") < k, F.timestamp_seconds(F.lit(2000) + F.substring("path", -8, 8).cast("int"))).otherwise(F.col("modificationTime"))))
        began = time.time() - 0.01
        assert log.record(one) == 1
        assert size_of(tmp_path, began) < 20_000 < whole / 10
    runs = last_manifest(log.files, log.folder)["runs"]
    assert len(runs) <= 3 and sum(n for _, n in runs) == 100_004 and log.state().count() == 100_000


def test_torn_generation(spark, tmp_path, monkeypatch):
    """A writer that ends before its manifest leaves nothing behind that counts."""
    log = ChangeLog(spark, str(tmp_path / "log"))
    log.record(listing(spark, [("a", 1.0, 1)]))
    monkeypatch.setattr(log.files, "write", lambda *_: (_ for _ in ()).throw(OSError("the end")))
    with pytest.raises(OSError):
        log.record(listing(spark, [("a", 2.0, 1)]))
    again = ChangeLog(spark, str(tmp_path / "log"))
    assert [r["generation"] for r in again.state().collect()] == [1]
    assert again.record(listing(spark, [("a", 2.0, 1)])) == 1 and [r["generation"] for r in again.state().collect()] == [2]


@pytest.mark.parametrize("died", ["before", "after"])
def test_stream_restarts_anywhere(spark, tmp_path, died):
    """A query that dies before or after the sink's write, and before the commit, reads the same generations again."""
    log = ChangeLog(spark, str(tmp_path / "log"))
    out, seen = tmp_path / "out", []

    def run(fail=None):
        def sink(rows, batch):
            seen.append((batch, sorted(r["generation"] for r in rows.collect())))
            if fail == "before":
                raise RuntimeError("died")
            rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")
            if fail:
                raise RuntimeError("died")

        query = log.stream().writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        try:
            query.awaitTermination(120)
        except Exception as e:
            assert fail and "died" in str(e)

    log.record(listing(spark, [("a", 1.0, 1), ("b", 1.0, 1)]))
    run()
    log.record(listing(spark, [("a", 2.0, 1)]))
    log.record(listing(spark, [("c", 2.0, 1)]))
    run(died)
    log.record(listing(spark, [("d", 3.0, 1)]))  # listed while nothing runs
    run()
    run()
    assert seen[:3] == [(0, [1, 1]), (1, [2, 3]), (1, [2, 3])] and sorted(g for _, gs in seen[3:] for g in gs) == [4]
    rows = spark.read.schema(CHANGES).parquet(str(out)).collect()
    assert sorted((r["path"], r["generation"]) for r in rows) == [("a", 1), ("a", 2), ("b", 1), ("c", 3), ("d", 4)]
    log.record(listing(spark, [("e", 3.0, 1)]))
    kept = last_manifest(log.files, log.folder)["changes"]
    assert committed(log.files, log.folder) >= 3 and "1" not in kept and "5" in kept


def test_watch(spark, tmp_path):
    top = tmp_path / "tree"
    top.mkdir()
    (top / "a.exe").write_bytes(b"MZ")
    (top / "b.txt").write_text("b")
    results = str(tmp_path / "store" / "results")
    watcher = Watcher(spark, str(top), str(tmp_path / "store"))
    assert watcher.tick() == 2 and watcher.tick() == 0
    (top / "b.txt").write_text("http://a")
    (top / "c.txt").write_text("new")
    (top / "a.exe").unlink()

    def dies(_):
        raise RuntimeError("died")

    with pytest.raises(Exception, match="died"):  # after the results are written
        Watcher(spark, str(top), str(tmp_path / "store"), on_results=dies).tick()
    again = Watcher(spark, str(top), str(tmp_path / "store"))
    assert again.tick() == 0 and watcher.exit_code == 1  # nothing new, but the torn batch is scanned again
    rows = spark.read.json(results)
    assert sorted(r["path"].rsplit("/", 1)[1] for r in rows.collect()) == ["a.exe", "b.txt", "b.txt", "c.txt"] and rows.where("batch = 1").count() == 2
    query = again.start(0.5)
    try:
        (top / "c.txt").write_text("MZ changed")
        for _ in range(120):
            if spark.read.json(results).count() == 5:
                break
            time.sleep(0.5)
        assert query.isActive
    finally:
        query.stop()
    assert spark.read.json(results).count() == 5


def test_watch_of_a_store_opens_what_changed(spark, folder, store, tmp_path):
    watcher = Watcher(spark, store, str(tmp_path / "watch"), TriageOptions(max_file_size=LIMIT))
    assert watcher.tick() == 17 and watcher.exit_code == 3  # one file cannot be read
    (folder / ".hidden").write_bytes(b"MZ now")
    assert watcher.tick() == 1
    rows = spark.read.json(str(tmp_path / "watch" / "results"))
    assert [[i["code"] for i in r["issues"]] for r in rows.where("batch = 1").collect()] == [["pe_header"]]
    assert rows.where("path like '%big' and reasons[0] = 'skipped_large'").count() == 1


TOKENS = (b"/JavaScript", b"/js", b"/OpenAction", b"/Launch", b"/EmbeddedFile", b"/AA", b"/Filespec", b"http://", b"https://", b"IEND", b"Exif", b"powershell", b"This program cannot be run in DOS mode")


@pytest.mark.parametrize("block", [1, 7, 64, 4096])
def test_blocks_find_what_the_whole_has(spark, tmp_path, block):
    """Facts block by block are those of the whole content, wherever blocks end; so are results."""
    options = TriageOptions(pdf_rules="strict", image_rules="strict", use_markers=True)
    r = random.Random(block)
    contents = {"empty.pdf": b"", "http.pdf": b"x http://AA/JS https://a HTTP://b", "tail.png": bytes.fromhex("89504E470D0A1A0A") + b"IEND" + b"q" * 9000, "last.jpg": bytes.fromhex("FFD8FF") + b"Exif" + b"z" * 50 + bytes.fromhex("FFD9"), "a.txt": b"powershell http://a.b " + b"y" * 300}
    for k in range(12):
        body = bytearray(r.randbytes(r.choice((90, 300, 9000))))
        for _ in range(r.randint(0, 6)):
            t = r.choice(TOKENS)
            at = r.randrange(len(body) - len(t)) if r.random() < 0.5 else min(len(body) - len(t), max(0, r.randrange(1, 5) * block - r.randrange(len(t))))
            body[at : at + len(t)] = t
        contents[f"f{k}.{r.choice(('pdf', 'png', 'jpg', 'bin'))}"] = bytes(body)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/vbaProject.bin", b"x" * 500)
        z.writestr("a.pdf.exe", b"y")
    contents |= {"m.zip": out.getvalue(), "m.docx": out.getvalue(), "not.zip": b"PK\x03\x04 no"}
    for n, c in contents.items():
        (tmp_path / n).write_bytes(c)
    patterns = findings.search_patterns(options)
    rows = [facts.facts_row(Mounted(), str(tmp_path / n), 10**6, patterns, block) for n in contents]
    table = spark.createDataFrame([(n, len(c), bytearray(c)) for n, c in contents.items()], "path string, length long, content binary")
    whole = {x["path"]: x for x in triage.facts_of(table, options).collect()}
    for n, row in zip(contents, rows, strict=True):
        got, want = dict(zip(facts.ARROW.names, row, strict=True)), whole[n]
        for c in ("length", "error", "sha256", "head", "tail", "body"):
            assert got[c] == want[c], (n, c)
        assert sorted(got["hits"]) == sorted(want["hits"]), n
        assert [tuple(m.values()) for m in got["members"]] == [tuple(m) for m in want["members"]], n
    results = lambda df: {x["path"].rpartition("/")[2]: [tuple(i) for i in x["issues"]] for x in df.collect()}
    assert results(scan(spark, str(tmp_path), options)) == results(triage.scan_relation(table, options))


def test_three_gigabytes_in_bounded_memory(tmp_path):
    """A sparse file with tokens on borders of blocks, in a process of its own whose memory is limited."""
    path, size, block = tmp_path / "huge.pdf", 3 << 30, facts.BLOCK
    with open(path, "wb") as f:
        f.write(b"%PDF-1.4")
        for k, token in enumerate((b"/JavaScript", b"/OpenAction", b"/Launch", b"/EmbeddedFile", b"/AA"), 1):
            f.seek(k * 100 * block - k)
            f.write(token)
        f.seek(size - 4)
        f.write(b"/JS!")
    code = f"""
import resource, sys
sys.path.insert(0, {str(ROOT)!r})
from sieveline.config import TriageOptions
from sieveline.operators import findings
from sieveline.sources import facts
from sieveline.sources.files import Mounted
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
row = dict(zip(facts.ARROW.names, facts.facts_row(Mounted(), {str(path)!r}, 1 << 40, findings.search_patterns(TriageOptions())), strict=True))
assert row["error"] is None and row["length"] == {size} and row["body"] is None and row["tail"].endswith(b"/JS!")
assert row["hits"] == sorted(["/JavaScript", "/OpenAction", "/Launch", "/EmbeddedFile", "/AA", "/JS"]), row["hits"]
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) < 100_000  # KB


def test_one_search_a_content(spark, sf_dir):
    """The plan of a scan searches a content once: one regular expression over it for each kind of file, and the branches exclude each other."""
    plan = triage.scan_relation(virtual.documents(spark, sf_dir))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Contains(content") == 0 and plan.count("regexp_extract_all(decode(content") <= 3 and plan.count("Relation") == 1


def result_rows(spark, rows):
    return spark.createDataFrame(rows, "path string, sha256 string, severity string")


def sha(data):
    return hashlib.sha256(data).hexdigest()


@pytest.mark.parametrize("kind", ["mounted", "store"])
def test_quarantine_into_any_store(spark, folder, store, tmp_path, kind):
    """Files of one name from several folders, one name taken before, a changed file and a missing one."""
    root, dest = (str(folder), str(tmp_path / "q")) if kind == "mounted" else (store, f"{store}/q")
    files, place = files_of(spark, dest)
    files.write(f"{place}/big", b"another big")
    deep = [f"{root}/d{i}/x/y/deep.exe" for i in range(3)]
    rows = [(p, sha(b"MZ"), "High") for p in deep] + [(f"{root}/big", sha(b"x" * (LIMIT + 1)), "High"), (f"{root}/_under", sha(b"other"), "High"), (f"{root}/gone", sha(b""), "High"), (f"{root}/.hidden", sha(b"h"), "Safe")]
    got = {r["path"]: r for r in quarantine.quarantine_results(result_rows(spark, rows + rows[:1]), dest).collect()}
    assert len(got) == 6 and "changed" in got[f"{root}/_under"]["error"] and got[f"{root}/gone"]["error"] and files.exists(f"{root}/.hidden") and files.exists(f"{root}/_under")
    places = [got[p]["stored"] for p in (*deep, f"{root}/big")]
    assert len(set(places)) == 4 and sum(p.endswith("/deep.exe") for p in places) == 1 and not places[3].endswith("/big") and all(p.endswith(".exe") for p in places[:3])
    assert [files.read(p) for p in places] == [b"MZ"] * 3 + [b"x" * (LIMIT + 1)] and files.read(f"{place}/big") == b"another big"
    assert [json.loads(files.read(quarantine.note_of(p)))["original_path"] for p in places] == [*deep, f"{root}/big"]
    assert not any(files.exists(p) for p in (*deep, f"{root}/big")) and not any("incoming" in e.path for e in files.entries(place))
    assert quarantine.unfinished(spark, dest) == []


def test_attempts_of_one_move(tmp_path):
    """A second attempt, at any point of the first one, ends as the first."""
    source, place, files = str(tmp_path / "s" / "a.exe"), str(tmp_path / "q" / "a.exe"), Mounted()

    def attempt():
        quarantine.move(files, source, files, place, sha(b"MZ"))

    files.write(source, b"MZ")
    attempt()
    attempt()
    for left in ("note", "place", "incoming"):  # where the first attempt ended
        files.remove(str(tmp_path / "q"))
        files.write(source, b"MZ")
        files.write({"note": quarantine.note_of(place), "place": place, "incoming": f"{place}.incoming-1"}[left], b"MZ" if left == "place" else b"{}")
        attempt()
        assert files.read(place) == b"MZ" and not files.exists(source)
    with ThreadPoolExecutor(8) as pool:
        for _ in range(20):
            files.remove(str(tmp_path / "q"))
            files.write(source, b"MZ")
            list(pool.map(lambda _: attempt(), range(8)))
            assert files.read(place) == b"MZ" and not files.exists(source) and sorted(e.path for e in files.entries(str(tmp_path / "q"))) == [place, quarantine.note_of(place)]
    with pytest.raises(FileNotFoundError):
        quarantine.move(files, str(tmp_path / "none"), files, str(tmp_path / "q" / "none"), sha(b""))


def test_quarantine_resumes(spark, folder, tmp_path, monkeypatch):
    dest, path = str(tmp_path / "q"), str(folder / "d0" / "x" / "y" / "deep.exe")
    rows = result_rows(spark, [(path, sha(b"MZ"), "High")])
    carry_out = quarantine.carry_out
    monkeypatch.setattr(quarantine, "carry_out", lambda *_: (_ for _ in ()).throw(RuntimeError("the end")))
    with pytest.raises(RuntimeError):
        quarantine.quarantine_results(rows, dest)
    monkeypatch.setattr(quarantine, "carry_out", carry_out)
    assert os.path.exists(path) and len(quarantine.unfinished(spark, dest)) == 1
    (done,) = quarantine.resume(spark, dest)
    assert [r["stored"] for r in done.collect()] == [f"{dest}/deep.exe"] and not os.path.exists(path) and quarantine.resume(spark, dest) == []


def test_quarantine_deals_out_moves_and_reads_results_once(spark, tmp_path, monkeypatch):
    """A plan of one split is carried out by many tasks; results, which may be a scan, are taken once."""
    (tmp_path / "t").mkdir()
    for k in range(40):
        (tmp_path / "t" / f"{k}.exe").write_bytes(b"%d" % k)
    taken = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            taken.add(batch.num_rows)
            yield batch

    rows = result_rows(spark, [(str(tmp_path / "t" / f"{k}.exe"), sha(b"%d" % k), "High") for k in range(40)]).coalesce(1)
    monkeypatch.setattr(quarantine, "MOVES_A_TASK", 4, raising=False)
    moved = quarantine.quarantine_results(rows.mapInArrow(run, rows.schema), str(tmp_path / "q")).collect()
    assert taken.value == 40
    assert sorted(os.path.basename(r["stored"]) for r in moved if not r["error"]) == sorted(f"{k}.exe" for k in range(40)) and not os.listdir(tmp_path / "t")
    (work,) = (tmp_path / "q" / quarantine.INTENTS).iterdir()
    assert len(list((work / "plan").glob("part-*.parquet"))) == 1 and len(list((work / "done").glob("part-*.parquet"))) > 4
    assert sorted(p.name for p in work.iterdir()) == ["done", "plan"]
