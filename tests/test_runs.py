"""Metrics of runs, audits that resume, autosave, and blocks of any number."""

import json
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from recordloom.operators import audit as A
from recordloom.operators import chapters as C
from recordloom.operators import metrics
from recordloom.streaming.autosave import autosave


def test_meter_counts_without_another_pass(spark, tmp_path):
    passes = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            passes.add(len(b))
            yield b

    meter = metrics.Meter()
    rows = spark.range(1000, numPartitions=4).mapInPandas(run, "id long")
    meter.over(rows, most=F.max("id")).write.parquet(str(tmp_path / "out"))
    found = meter.progress(total=5000)
    assert meter.counts()["most"] == 999 and found.rows == 1000 and passes.value == 1000
    assert found.rows_per_second == pytest.approx(1000 / found.seconds) and found.seconds_left == pytest.approx(4000 / found.rows_per_second)
    assert metrics.progress(0, 0.0, 10).seconds_left is None and metrics.progress(20, 2.0, 10).seconds_left == 0


def test_stream_progress(spark, tmp_path):
    for i in range(3):
        spark.range(10).write.parquet(str(tmp_path / "in" / str(i)))
    query = spark.readStream.schema("id long").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in")).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert metrics.stream_progress(query, 90).rows == 30 and metrics.stream_progress(query, 90).rows_per_second > 0


def test_audit_resumes_where_it_broke_off(spark, tmp_path):
    asked = tmp_path / "asked"
    asked.mkdir()
    ledger = str(tmp_path / "ledger")

    def auditor(fails):
        folder = str(asked)

        def ask(pdf):
            import uuid

            pd.DataFrame({"name": pdf["name"]}).to_json(f"{folder}/{uuid.uuid4().hex}")
            if fails and pdf["name"].str.contains("bad").any():
                raise RuntimeError("service down")
            return pd.DataFrame({"content": pdf["content"], "severity": ["HIGH" if "x" in n else "SAFE" for n in pdf["name"]]})

        return ask

    names = [f"x{i}" for i in range(30)] + [f"y{i}" for i in range(30)] + ["bad x", "x1", "x1"]
    rows = spark.createDataFrame([(i, n, "" if i == 5 else "one", None) for i, n in enumerate(names)], "row_id long, name string, name_1 string, name_2 string")
    run = lambda fails: {r.row_id: r.severity for r in A.audit_with_ledger(rows, auditor(fails), ledger, ["name", "name_1"], "severity string", bucket=20, chunk=5, attempts=1, wait=0).collect()}
    said = lambda: [n for p in asked.iterdir() for n in json.loads(p.read_text())["name"].values()]
    first = run(True)
    assert 5 not in first and None in first.values() and first[60] is None
    answered = {names[i] for i, v in first.items() if v is not None}
    assert sum(v is not None for v in first.values()) > 40
    for p in asked.iterdir():
        p.unlink()
    second = run(False)
    assert second == {i: "HIGH" if "x" in n else "SAFE" for i, n in enumerate(names) if i != 5}
    assert not answered & set(said()) and len(said()) == len(set(said()))
    for p in asked.iterdir():
        p.unlink()
    assert run(True) == second and said() == []


def test_autosave_writes_the_last_edit_after_quiet(spark, tmp_path):
    source, out = tmp_path / "edits", str(tmp_path / "sessions")
    source.mkdir()

    def put(n, *edits):
        (source / f".{n}").write_text("\n".join(json.dumps(dict(zip(("session_id", "edit_seq", "state"), e, strict=True))) for e in edits))
        (source / f".{n}").rename(source / f"{n}.json")

    stream = lambda: spark.readStream.schema("session_id string, edit_seq long, state string").json(str(source))
    saved = lambda: {r.session_id: (r.edit_seq, r.state) for r in spark.read.schema("edit_seq long, state string, session_id string").parquet(out).collect()} if (tmp_path / "sessions").exists() else {}

    def wait(want):
        end = time.monotonic() + 60
        while time.monotonic() < end and saved() != want:
            time.sleep(0.5)
        assert saved() == want

    put(1, ("a", 1, "one"), ("a", 3, "three"), ("b", 1, "b"), (None, 1, "none"), ("a", 3, "three"))
    query = autosave(stream(), out, str(tmp_path / "c"), 1500)
    try:
        put(2, ("a", 2, "late"))
        wait({"a": (3, "three"), "b": (1, "b")})
        put(3, ("b", 2, "again"))
        time.sleep(1)
    finally:
        query.stop()
    query = autosave(stream(), out, str(tmp_path / "c"), 1500)  # goes on with the timers of its checkpoint
    try:
        wait({"a": (3, "three"), "b": (2, "again")})
    finally:
        query.stop()


@pytest.mark.parametrize(("block", "group"), [(10_000, 1000), (7, 2), (3, 1000), (1, 3)])
def test_chapters_by_blocks_in_two_levels(spark, block, group):
    kinds = ["M" if i % 17 == 3 else "N" if i % 5 == 1 else "" for i in range(200)]
    rows = spark.createDataFrame([(i * i + 1, k, f"t{i}") for i, k in enumerate(kinds)], "row_no long, kind string, t string").repartition(5)
    filled = {r.row_no: r.chapter for r in C.fill_chapters(rows, F.when(F.col("kind") == "M", F.col("t")), F.when(F.col("kind") == "N", F.col("t")), block=block, group=group).collect()}
    counted = {r.row_no: r.ordinal for r in C.running_count(rows, F.col("kind") == "N", block=block, group=group).collect()}
    major = minor = None
    n = 0
    for i, k in enumerate(kinds):
        if k == "M":
            major, minor = f"t{i}", None
        elif k == "N":
            minor, n = f"t{i}", n + 1
        assert filled[i * i + 1] == " > ".join(x for x in (major, minor) if x) and counted[i * i + 1] == n
