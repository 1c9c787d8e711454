"""Documents written by tasks, reports read in splits, places in a total order."""

import json
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.functions import columns as C
from sieveline.plans.order import ranked
from sieveline.schemas import RESULT
from sieveline.sinks import document, reports
from sieveline.sources import report
from sieveline.sources.files import Mounted
from sieveline.sources.report import read_report


def rows_of(n, seed=0):
    r = random.Random(seed)
    text = lambda: "".join(r.choice(['"', "\\", "{", "}", "[", "]", ",", "a", "é", " ", "\n", "\\\\", '\\"']) for _ in range(r.randrange(12)))
    return [(f"f/{k:05d}{text()}", "00", k, "pe", [("c", text(), text(), "high")] * r.randrange(3), k % 100, r.choice(["Safe", "High"]), [text()], r.choice([None, text() + "x"])) for k in range(n)]


@pytest.mark.parametrize("n", [0, 1, 300])
def test_json_by_tasks_is_the_document(spark, tmp_path, n):
    rows = spark.createDataFrame(rows_of(n), RESULT).orderBy("size")
    path = str(tmp_path / "new" / "r.json")
    reports.save_json(rows, path)
    reports.write_json(reports.dicts(rows), str(tmp_path / "one.json"))
    body = lambda p: open(p).read().split('"files"')[1]
    assert json.loads(open(path).read())["files"] == json.loads(open(tmp_path / "one.json").read())["files"]
    assert not n or body(path) == body(tmp_path / "one.json")
    assert [p.name for p in (tmp_path / "new").iterdir()] == ["r.json"]
    reports.save_json(rows.limit(0), path)  # a document replaces the one before
    assert json.loads(open(path).read())["files"] == []


def test_html_by_tasks_is_the_page(spark, tmp_path):
    rows = spark.createDataFrame(rows_of(120), RESULT).orderBy("size")
    reports.save_html(rows, str(tmp_path / "r.html"))
    assert (tmp_path / "r.html").read_text() == "".join(reports.html_parts(reports.dicts(rows)))


def test_attempts_leave_nothing_in_the_document(tmp_path):
    """A part that is written twice, or half, is in the document once: as the attempt that was taken wrote it."""
    files, folder = Mounted(), str(tmp_path / "parts")

    def dies():
        yield {"k": 1}
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        document.write_part(files, folder, dies(), json.dumps, ",", str)
    first, again = (document.write_part(files, folder, iter([{"k": 1}, {"k": 2}]), json.dumps, ",", lambda r: str(r["k"] % 2)) for _ in range(2))
    other = document.write_part(files, folder, iter([{"k": 3}]), json.dumps, ",", str)
    assert first[0] != again[0] and first[1:] == again[1:] == (2, Counter({"1": 1, "0": 1})) and len(list((tmp_path / "parts").iterdir())) == 4
    place = document.join_parts(files, folder, "[", [again[0], other[0]], ",", "]")
    assert [r["k"] for r in json.loads(open(place).read())] == [1, 2, 3]


def test_a_failed_document_leaves_the_old_one(spark, tmp_path):
    path = tmp_path / "r.json"
    path.write_text("old")

    def render(row):
        raise ValueError("no")

    with pytest.raises(Exception, match="no"):
        document.write_document(spark.createDataFrame(rows_of(5), RESULT), str(path), "[", render, ",", lambda _: "]")
    assert path.read_text() == "old" and [p.name for p in tmp_path.iterdir()] == ["r.json"]


@pytest.mark.parametrize("split", [7, 64, 1000, 1 << 20])
@pytest.mark.parametrize("indent", [None, 2])
def test_report_in_splits(spark, tmp_path, split, indent):
    """Strings with quotes, escapes and brackets on every border of splits."""
    rows = rows_of(25 if split < 50 else 120, split)
    frame = spark.createDataFrame(rows, RESULT)
    text = json.dumps({"generated_at": '[{"\\', "files": list(reports.dicts(frame))}, indent=indent, ensure_ascii=bool(indent))
    (tmp_path / "r.json").write_text(text)
    assert read_report(spark, str(tmp_path / "r.json"), split).collect() == frame.collect()


def test_splits_agree_with_a_parser(tmp_path):
    """Depth and strings at each place, and elements, for splits of any size, by a plain loop."""
    r = random.Random(1)
    for case in range(60):
        found = [{"a": "".join(r.choice('"\\{}[]x,:') for _ in range(r.randrange(9))), "b": [{"c": [1, {"d": "\\"}]}]} for _ in range(r.randrange(6))]
        text = json.dumps({"x": {"y": "}"}, "files": found} if case % 2 else {"files": found}).encode()
        path = tmp_path / "r.json"
        path.write_bytes(text)
        inside, escaped, depth, states = False, False, 0, []
        for b in text:
            states.append((inside, depth))
            if inside:
                escaped, inside = (not escaped and b == 92), (b != 34 or escaped)
            elif b == 34:
                inside = True
            else:
                depth += (b in b"{[") - (b in b"}]")
        for split in (1, 2, 3, 5, 11, 40, 10_000):
            got, inside, depth = [], False, 0
            for begin in range(0, len(text), split):
                assert (inside, depth) == states[begin]
                end = min(begin + split, len(text))
                got += report.elements(Mounted(), str(path), begin, end, inside, depth, split)
                _, change, inside = report.steps(*report.taken(Mounted(), str(path), begin, end - begin), inside)
                depth += int(change.sum())
            assert [json.loads(e) for e in got] == found, (case, split)


def test_report_larger_than_a_split_takes_many_tasks(spark, tmp_path):
    rows = spark.range(30_000).select(F.concat(F.lit("p/"), "id").alias("path"), *(F.lit(None).cast(f.dataType).alias(f.name) if f.name not in ("size", "score") else F.col("id").cast(f.dataType).alias(f.name) for f in RESULT.fields[1:]))
    path = str(tmp_path / "r.json")
    reports.save_json(rows, path)
    got = read_report(spark, path, 100_000)
    assert got.count() == 30_000 and got.agg(F.sum("size"), F.countDistinct("path")).first()[:] == (sum(range(30_000)), 30_000)
    assert [r["path"] for r in got.take(3)] == ["p/0", "p/1", "p/2"] and os.path.getsize(path) > 15 * 100_000
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 and plan.count("Repartition") == 2  # splits are dealt out for both passes


def test_ranked(spark):
    r = np.random.default_rng(0)
    paths = ["/".join(r.choice(["a", "b", "a-b", "", "é", "A"], r.integers(1, 4))) for _ in range(500)] + ["hot/path"] * 300
    df = spark.createDataFrame(list(enumerate(paths)), "place long, path string").repartition(5)
    got = ranked(df.withColumnRenamed("place", "_at"), C.path_order(F.col("path"))).collect()
    assert [x["place"] for x in sorted(got, key=lambda x: x["place"])] == list(range(1, 801))
    assert [x["path"] for x in sorted(got, key=lambda x: x["place"])] == sorted(paths, key=lambda p: [c.encode() for c in p.split("/")])
    assert sorted(x["_at"] for x in got) == list(range(800))
    assert ranked(df.limit(0).select("path"), F.col("path")).count() == 0
    sizes = ranked(spark.range(4000).select(F.lit(7).alias("k")), F.col("k"))
    assert sizes.agg(F.min("place"), F.max("place"), F.countDistinct("place")).first()[:] == (1, 4000, 4000)
