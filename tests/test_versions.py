"""Versioned tables, recoverable ingest, digests of files and bucketed streams."""

from __future__ import annotations

import hashlib
import os
import subprocess
import sys
import threading

import pytest
from pyspark.sql import functions as F

from lumenarc.functions.text import filled
from lumenarc.operators import fixity
from lumenarc.sources import digests, inventory
from lumenarc.sources.versions import Archive, ConflictError
from lumenarc.streaming import streams


@pytest.fixture
def archive(spark, tmp_path):
    found = Archive(spark, str(tmp_path / "archive"))
    rows = [(i, f"t{i}", f"b{i % 3}" if i % 7 else None) for i in range(60)]
    with found.change("first") as change:
        change.replace("images", spark.createDataFrame(rows, "id long, title string, import_id string"))
        change.replace("faces", spark.createDataFrame([(i, f"b{i % 3}") for i in range(30)], "face long, import_id string"))
        change.replace("journal", spark.createDataFrame([(f"b{i}", "completed") for i in range(3)], "id string, status string"), None)
    return found


def test_one_switch_for_all_tables(spark, archive):
    before = archive.snapshot()
    assert before.batches("images") == ["b0", "b1", "b2", "legacy"] and before.read("images").count() == 60 and before.read("images", ["legacy"]).where("import_id is not null").isEmpty()
    archive.rollback_batch("b1", ["images", "faces"], "journal")
    after = archive.snapshot()
    assert {t: after.read(t).count() for t in after.tables} == {"images": 60 - before.read("images", ["b1"]).count(), "faces": 20, "journal": 2}
    # no row of images moved, and the earlier reader still sees its own
    assert all(after.tables["images"]["parts"][b] == before.tables["images"]["parts"][b] for b in after.batches("images"))
    assert before.read("faces").count() == 30
    archive.restore(before.number)
    assert archive.snapshot().read("faces").count() == 30 and archive.history() == [(1, "first"), (2, "rollback b1"), (3, "restore 1")]


def test_appends_and_replaced_batches(spark, archive):
    with archive.change() as change:
        change.append("faces", spark.createDataFrame([(100, "b0"), (101, "new/ä=1")], "face int, import_id string"))
        change.replace_batches("images", spark.createDataFrame([(1, "only", "b2")], "id long, title string, import_id string"))
    now = archive.snapshot()
    assert now.read("faces", ["new/ä=1"]).collect() == [(101, "new/ä=1")] and now.read("faces", ["b0"]).count() == 11
    assert now.read("images", ["b2"]).collect() == [(1, "only", "b2")] and now.read("images", ["b0"]).count() > 1
    assert now.read("faces", []).isEmpty()


def test_errors_and_conflicts_switch_nothing(spark, archive):
    with pytest.raises(ZeroDivisionError), archive.change() as change:
        change.replace("faces", spark.createDataFrame([(1, "b0")], "face long, import_id string"))
        raise ZeroDivisionError
    assert archive.snapshot().number == 1
    first, second = archive.change("one"), archive.change("two")
    second.drop_batch("faces", "b0")
    assert second.commit() == 2
    first.drop_batch("faces", "b1")
    with pytest.raises(ConflictError):
        first.commit()
    assert archive.snapshot().batches("faces") == ["b1", "b2"] and not [n for n in archive.files.names(f"{archive.root}/manifests") if n.endswith(".tmp")]


def test_of_many_writers_one_wins_each_number(spark, archive):
    won, lost = [], []

    def write(k):
        change = archive.change(f"w{k}")
        change.drop_batch("faces", f"b{k % 3}")
        try:
            won.append(change.commit())
        except ConflictError:
            lost.append(k)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) + len(lost) == 8 and len(set(won)) == len(won) and archive.numbers() == list(range(1, 2 + len(won)))


KILLED = """
import os, sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from lumenarc.sources.versions import Archive
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
change = Archive(spark, {folder!r}).change("never")
change.replace("images", spark.createDataFrame([(1, "x", "b9")], "id long, title string, import_id string"))
change.drop_batch("faces", "b0")
os.kill(os.getpid(), 9)
"""


def test_a_killed_writer_leaves_the_old_state(spark, archive):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    ended = subprocess.run([sys.executable, "-c", KILLED.format(root=root, folder=archive.root)], capture_output=True, timeout=120)
    assert ended.returncode == -9
    now = archive.snapshot()
    assert now.number == 1 and now.read("images").count() == 60 and now.read("faces").count() == 30
    orphan = [f for f in archive.files.names(f"{archive.root}/data") if f.startswith("images")]
    assert len(orphan) == 2
    assert len(archive.forget(1)) == 1 and archive.snapshot().read("images").count() == 60


def test_large_batches_are_split(spark, tmp_path):
    rows = spark.range(40_000).selectExpr("id", "sha2(cast(id as string), 256) AS title", "CASE WHEN id < 39000 THEN 'hot' ELSE concat('b', id % 3) END AS import_id")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
    try:
        inventory.write_catalogue(rows, str(tmp_path / "c"))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = {f: len([x for x in os.listdir(tmp_path / "c" / f) if x.endswith(".parquet")]) for f in os.listdir(tmp_path / "c") if "=" in f}
    assert files["import_id=hot"] >= 4 and files["import_id=b1"] <= 2
    assert inventory.read_catalogue(spark, str(tmp_path / "c")).count() == 40_000


def _files(spark, n, empty=()):
    return spark.createDataFrame([(f"/a/f{i:03d}.tif", 0 if i in empty else 5, " " if i % 2 else f"side {i}", f"head {i}") for i in range(n)], "path string, size long, side string, head string")


def test_a_dead_run_is_completed_by_the_next(spark, tmp_path):
    archive = Archive(spark, str(tmp_path / "a"))
    fields = {"title": [F.col("side"), F.col("head")]}
    first = inventory.run_ingest(archive, _files(spark, 30, (3, 4)), "b0", "/a", fields=fields).first()
    assert (first.status, first.image_count, first.skipped_count, first.failed_count) == ("completed", 28, 0, 2)
    assert first.first_names == [f"f{i:03d}.tif" for i in range(22) if i not in (3, 4)] and first.failed_names == ["f003.tif", "f004.tif"]
    assert {r.title for r in archive.snapshot().read("images").where("file_name in ('f001.tif', 'f002.tif')").collect()} == {"head 1", "side 2"}
    inventory.start_run(archive, "b1")  # and then it dies
    assert archive.snapshot().read("journal").where("id = 'b1'").first().status == "running"
    last = inventory.run_ingest(archive, _files(spark, 50), "b2", "/a", fields=fields).first()
    assert (last.image_count, last.skipped_count, last.failed_count) == (22, 28, 0)
    states = {r.id: (r.status, r.note) for r in archive.snapshot().read("journal").collect()}
    assert states == {"b0": ("completed", None), "b1": ("failed", "interrupted"), "b2": ("completed", None)}
    again = inventory.run_ingest(archive, _files(spark, 50), "b1", "/a", fields=fields).first()
    assert (again.status, again.image_count, again.skipped_count) == ("completed", 0, 50) and archive.snapshot().read("images").count() == 50
    inventory.run_ingest(archive, _files(spark, 5), "b3", "/a", force=True, fields=fields)
    assert archive.snapshot().read("images").count() == 50 and archive.snapshot().read("images").where("import_id = 'b3'").count() == 5


def test_an_error_is_journalled(spark, tmp_path):
    archive = Archive(spark, str(tmp_path / "a"))
    bad = _files(spark, 3).withColumn("head", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        inventory.run_ingest(archive, bad, "b0", "/a", fields={"title": [filled(F.col("head"))]})
    row = archive.snapshot().read("journal").first()
    assert row.status == "failed" and "broken" in row.note and "images" not in archive.snapshot().tables


def test_digests_of_any_file(spark, tmp_path):
    (tmp_path / "d" / "sub").mkdir(parents=True)
    (tmp_path / "d" / "a.tif").write_bytes(b"a")
    (tmp_path / "d" / "sub" / "ü b.tif").write_bytes(b"b" * 100_000)
    (tmp_path / "d" / "empty").touch()
    with open(tmp_path / "d" / "large.tif", "wb") as file:
        file.truncate(3 << 30)
    os.symlink("/proc/self/mem", tmp_path / "d" / "unreadable.tif")
    seen = fixity.observed_files(spark, str(tmp_path / "d"), partitionBytes=1 << 20)
    assert seen.rdd.getNumPartitions() >= 2
    rows = {r.file_path.rpartition("/")[2]: r for r in seen.collect()}
    state = hashlib.sha256()
    for _ in range(3 << 7):
        state.update(bytes(8 << 20))
    assert rows["large.tif"].sha256 == state.hexdigest() and rows["large.tif"].size == 3 << 30
    assert rows["a.tif"].sha256 == hashlib.sha256(b"a").hexdigest() and rows["ü b.tif"].size == 100_000 and rows["empty"].sha256 == hashlib.sha256(b"").hexdigest()
    assert rows["unreadable.tif"].sha256 is None and rows["unreadable.tif"].error
    assert rows["a.tif"].file_path == f"file:{tmp_path}/d/a.tif"
    stored = spark.createDataFrame([(rows[n].file_path if n in rows else f"file:{tmp_path}/d/{n}", "x") for n in ("a.tif", "unreadable.tif", "missing.tif")], "file_path string, sha256 string")
    checked = {r.file_path.rpartition("/")[2]: (r.status, r.outcome) for r in fixity.fixity_verify(stored, seen, F.current_timestamp()).collect()}
    assert checked == {"a.tif": ("CORRUPTED", "corrupted"), "unreadable.tif": ("READ_ERROR", "corrupted"), "missing.tif": ("MISSING", "missing")}


def test_ranges_of_files(tmp_path):
    for i in range(25):
        (tmp_path / f"f{i:02d}").write_bytes(b"x" * (50 if i == 7 else 10))
    ranges = [r.files for r in digests.DigestReader({"path": str(tmp_path), "partitionBytes": "40", "partitionFiles": "3"}).partitions()]
    assert sorted(f for r in ranges for f in r) == [f for r in ranges for f in r] and sum(map(len, ranges)) == 25
    assert all(len(r) <= 3 and (sum(s for _, s in r) <= 40 or len(r) == 1) for r in ranges)
    (tmp_path / "none").mkdir()
    assert [r.files for r in digests.DigestReader({"path": str(tmp_path / "none")}).partitions()] == [[]]


def test_small_batches_read_few_buckets(spark, tmp_path):
    """Of a catalogue of 4,000 ids a batch of three files reads the files of three buckets at most."""
    for name, rows in (("in1", range(4000)), ("in2", (5, 9001, 9002))):
        spark.createDataFrame([(f"/a/{i}", 1) for i in rows], "path string, size long").write.parquet(str(tmp_path / name))
    catalogue = str(tmp_path / "catalogue")
    read = lambda name: spark.readStream.schema("path string, size long").parquet(str(tmp_path / name))
    streams.ingest_stream(read("in1"), catalogue, str(tmp_path / "c1"), "/a", buckets=64).awaitTermination()
    before = {f for f in os.listdir(catalogue) if "=" in f}
    assert len(before) == 64
    touched = [3, 9]
    plan = streams.known_ids(spark, catalogue, touched)
    assert len(plan.inputFiles()) >= 64  # the listing
    assert "PartitionFilters: [isnotnull(bucket" in plan._jdf.queryExecution().executedPlan().toString() or "bucket#" in plan._jdf.queryExecution().executedPlan().toString()
    assert {r.f.split("bucket=")[1].split("/")[0] for r in plan.select(F.input_file_name().alias("f")).distinct().collect()} == {"3", "9"}
    streams.ingest_stream(read("in2"), catalogue, str(tmp_path / "c2"), "/a", buckets=64).awaitTermination()
    assert spark.read.parquet(catalogue).count() == 4002
