"""Clustering, similarity joins, fixity, ingest, sidecars, retention and streams."""

from __future__ import annotations

import json

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenarc.operators import aggregates, catalogue, fixity, graph, search, similarity, windows
from lumenarc.operators.graph import connected_components
from lumenarc.operators.windows import row_numbers
from lumenarc.plans import q_search
from lumenarc.plans.queries import ORACLE, QUERIES
from lumenarc.sources import exports, inventory
from lumenarc.streaming import streams
from tests.oracle import rows


@pytest.fixture(scope="module")
def planted():
    """Two tight groups, a chain whose ends aren't near, isolated points; 300 rows."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 32))
    base[10:14] = base[10] + 0.05 * rng.normal(size=(4, 32))
    base[50:53] = base[50] + 0.05 * rng.normal(size=(3, 32))
    return base / np.linalg.norm(base, axis=1, keepdims=True)


def test_blocks_do_not_change_pairs(spark, planted):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(planted)], "id long, vector array<double>").repartition(7)
    s = np.round(planted @ planted.T, 6)
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(s >= 0.5), strict=True) if i < j}
    for block in (40, 4096):
        assert {(r.a, r.b) for r in similarity.similarity_join(df, 0.5, block).collect()} == want


@pytest.mark.parametrize("min_samples", [2, 3])
def test_dbscan(spark, planted, min_samples):
    s = np.round(planted @ planted.T, 6)
    near = (s >= 0.45) & ~np.eye(len(s), dtype=bool)
    core = near.sum(1) >= min_samples - 1
    label, n = np.full(len(s), -1), 0
    for i in range(len(s)):
        if core[i] and label[i] < 0:
            todo, label[i] = [i], n
            while todo:
                for j in np.flatnonzero(near[todo.pop()] & core & (label < 0)):
                    label[j] = n
                    todo.append(j)
            n += 1
    for i in np.flatnonzero(~core):
        if (near[i] & core).any():
            label[i] = label[np.flatnonzero(near[i] & core)[0]]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(planted)], "id long, vector array<double>")
    got = {r.id: r.cluster for r in similarity.cluster_vectors(df, 0.55, min_samples).collect()}
    assert [got[i] for i in range(len(s))] == label.tolist()


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 7), (200, 201), (5, 5)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 0, 200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


@pytest.mark.parametrize("last", [0, 500, None])
@pytest.mark.parametrize("kind", ["long", "string", "binary"])
def test_components_of_long_paths(spark, kind, last):
    """A path of 10,000 nodes, edges in both orders, and stars; by rounds alone, with a late finish, by one task."""
    name = {"long": lambda i: i, "string": lambda i: f"n{i:06d}", "binary": lambda i: i.to_bytes(3, "big")}[kind]
    edges = [(i, i + 1) if i % 2 else (i + 1, i) for i in range(9_999)] + [(20_000 + i, 20_000) for i in range(500)]
    for seed in (0, 1):
        order = np.random.default_rng(seed).permutation(len(edges)) if seed else np.arange(len(edges))
        rows = [(name(edges[k][0]), name(edges[k][1])) for k in order]
        df = spark.createDataFrame(rows, f"src {kind}, dst {kind}").repartition(7)
        got = {r.node: r.root for r in connected_components(df, last_edges=last).collect()}
        assert got == {name(i): name(0) for i in range(10_000)} | {name(20_000 + i): name(20_000) for i in range(500)}


def test_contraction_is_bounded(spark, monkeypatch):
    batches = [pa.RecordBatch.from_arrays([pa.array(range(k, k + 50)), pa.array(range(k + 1, k + 51))], ["src", "dst"]) for k in range(0, 1000, 50)]
    monkeypatch.setattr(graph, "HELD_EDGES", 120)
    out = list(graph._contract(False)(iter(batches)))
    assert len(out) > 3 and max(b.num_rows for b in out) < 200
    root = {x: x for x in range(1001)}
    for b in out:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            while root[x] != x:
                x = root[x]
            while root[y] != y:
                y = root[y]
            root[max(x, y)] = min(x, y)
    assert sum(root[x] == x for x in root) == 1


def clustered(n, width, seed):
    """Rows around 40 far centres, a third of them copies of one row."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, width))
    rows = centres[rng.integers(0, 40, n)] + 0.15 * rng.normal(size=(n, width))
    rows[: n // 3] = rows[0]
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


@pytest.mark.parametrize("threshold", [0.9, 0.3, -0.1, 1.0])
def test_pivots_lose_no_pair(spark, threshold):
    m = clustered(600, 16, 3)
    m[7] = 0
    s = np.round(m @ m.T, 6)
    want = {(int(i), int(j)): s[i, j] for i, j in zip(*np.nonzero(s >= threshold), strict=True) if i < j}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(9999, None)], "id long, vector array<double>").repartition(5)
    for pivots in (1, 13, 600):
        got = similarity.similarity_join(df, threshold, 100, pivots=pivots).collect()
        assert len(got) == len(want) and {(r.a, r.b): r.similarity for r in got} == pytest.approx(want, abs=1.1e-6)


def test_pivots_prune_and_hot_cells_are_split(spark):
    m = clustered(4000, 32, 4)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, vector array<double>")
    cells = similarity.in_cells(df, 0.9, similarity.choose_pivots(df, 64))
    rows = similarity.cell_statistics(cells).collect()
    assert sum(r.inner for r in rows) == 4000
    compared = sum(r.inner * (r.inner + 2 * r.guests) for r in rows)
    hot = max(r.inner for r in rows)
    assert compared - hot * hot < 0.1 * (4000 * 4000 - hot * hot)  # over 90 % of the pairs of other cells are never made
    tasks = similarity.similarity_join(df, 0.9, 500, pivots=64)
    sent = tasks._jdf.queryExecution().analyzed().toString()
    assert "FlatMapGroupsInArrow" in sent and tasks.count() == sum(1 for i, j in zip(*np.nonzero(np.triu(np.round(m @ m.T, 6) >= 0.9, 1)), strict=True))


def test_pairs_within_groups(spark):
    m = clustered(300, 8, 5)
    df = spark.createDataFrame([(i, i % 3, v.tolist()) for i, v in enumerate(m)], "id long, part int, vector array<double>")
    s = np.round(m @ m.T, 6)
    got = {(r.own, r.a, r.b) for r in similarity.similarity_join(df, 0.8, within="part").collect()}
    assert got == {(int(i) % 3, int(i), int(j)) for i, j in zip(*np.nonzero(s >= 0.8), strict=True) if i < j and i % 3 == j % 3}


def test_hash_join(spark):
    hashes = [(0, "0" * 16), (1, "0" * 16), (2, "0" * 15 + "3"), (3, "0" * 15 + "7"), (4, "000000000000007f"), (5, "00000000000000ff")]
    got = {(r.a, r.b): r.distance for r in similarity.hash_join(spark.createDataFrame(hashes, "id long, hash string"), 7).collect()}
    bits = {i: int(h, 16) for i, h in hashes}
    assert got == {(a, b): (bits[a] ^ bits[b]).bit_count() for a in bits for b in bits if a < b and (bits[a] ^ bits[b]).bit_count() <= 7}


def test_stacks(spark):
    near, far = [1.0, 0.0], [0.0, 1.0]
    hits = spark.createDataFrame([(1, 10, 1, near), (1, 11, 2, far), (1, 12, 3, [0.99, 0.05]), (2, 10, 1, far)], "query_id long, id long, rank int, vector array<double>")
    got = {(r.query_id, r.id): r.stack_of for r in similarity.stack_results(hits).collect()}
    assert got == {(1, 10): 10, (1, 11): 11, (1, 12): 10, (2, 10): 10}


def long_lists(seed=7, n=700):
    rng = np.random.default_rng(seed)
    m = clustered(n, 12, seed)
    # a chain in rank order: each is similar to the next one only
    angle = np.arange(120) * 0.3
    m[100:220] = 0
    m[100:220, 0], m[100:220, 1] = np.cos(angle), np.sin(angle)
    return [(q, int(i), int(r) + 1, m[i].tolist()) for q in (3, 4) for r, i in enumerate(rng.permutation(n) if q == 3 else range(n))]


@pytest.mark.parametrize("last", [0, 300, 500_000])
def test_long_lists_are_stacked_as_short_ones(spark, monkeypatch, last):
    hits = spark.createDataFrame(long_lists(), "query_id long, id long, rank int, vector array<double>").repartition(6)
    want = {(r.query_id, r.id): r.stack_of for r in similarity.stack_results(hits, 0.95, list_rows=10_000).collect()}
    monkeypatch.setattr(similarity, "settle_stacks", lambda edges, f=similarity.settle_stacks: f(edges, last, 80))
    got = similarity.stack_results(hits, 0.95, list_rows=100).collect()
    assert len(got) == 1400 and {(r.query_id, r.id): r.stack_of for r in got} == want
    assert all((r.similarity == 1.0) == (r.stack_of == r.id) or r.similarity >= 0.95 for r in got)


def test_stacks_that_stay_open_are_an_error(spark):
    edges = spark.createDataFrame([(1, i, i + 1, 1.0) for i in range(50)], "query_id long, early int, late int, similarity double")
    with pytest.raises(RuntimeError, match="still open"):
        similarity.settle_stacks(edges, 0, 3)
    assert {r.late for r in similarity.settle_stacks(edges).collect()} == set(range(1, 51, 2))


@pytest.mark.parametrize("distance", [3, 20, 40])
def test_hash_blocks_are_brute_force(spark, distance):
    rng = np.random.default_rng(distance)
    bits = [int(x) for x in rng.integers(0, 2**63, 400)] + [0, 0, 2**64 - 1, 2**64 - 2] + [7 << 60] * 150
    df = spark.createDataFrame([(i, f"{b:016x}") for i, b in enumerate(bits)] + [(9999, None)], "id long, hash string")
    want = {(a, b): (bits[a] ^ bits[b]).bit_count() for a in range(len(bits)) for b in range(a + 1, len(bits)) if (bits[a] ^ bits[b]).bit_count() <= distance}
    for block in (64, 16_384):
        got = similarity.hash_join_blocks(df, distance, block).collect()
        assert len(got) == len(want) and {(r.a, r.b): r.distance for r in got} == want
    assert similarity.hash_join_blocks(df.where("false"), distance).count() == 0


def test_long_distances_go_to_blocks(spark):
    """Bands of 18 would bring more pairs than there are, those of 8 a few in a hundred."""
    assert similarity.band_pairs(1.0, 18) > 1 > 0.1 > similarity.band_pairs(1.0, 8)
    df = spark.createDataFrame([(0, "0" * 16), (1, "f" * 16)], "id long, hash string")
    assert "FlatMapGroupsInArrow" in similarity.hash_join(df, 17)._jdf.queryExecution().toString()
    assert "FlatMapGroupsInArrow" not in similarity.hash_join(df, 7)._jdf.queryExecution().toString()


def test_full_buckets_of_bands_are_packed_blocks(spark):
    """Each pair comes once, by whatever way its bucket goes; no two hashes of a full bucket are joined row by row."""
    rng = np.random.default_rng(5)
    bits = [int(b) for b in rng.integers(0, 2**64, 60, dtype=np.uint64)] * 2 + [int("f" * 16, 16) - 3, 2**63, 0, 1, 3]
    df = spark.createDataFrame([(i, f"{b:016x}") for i, b in enumerate(bits)] + [(9999, None)], "id long, hash string")
    want = {(a, b): (bits[a] ^ bits[b]).bit_count() for a in range(len(bits)) for b in range(a + 1, len(bits)) if (bits[a] ^ bits[b]).bit_count() <= 16}
    for bucket, block in ((256, 16_384), (3, 16_384), (0, 4)):
        found = similarity.hash_join(df, 16, bands=17, block_rows=block, bucket_rows=bucket)
        got = found.collect()
        assert len(got) == len(want) and {(r.a, r.b): r.distance for r in got} == want
        assert ("FlatMapGroupsInArrow" in found._jdf.queryExecution().toString()) == (bucket < 256)


def test_grid_needs_no_driver(spark, monkeypatch):
    monkeypatch.setattr(type(spark.range(1)), "toPandas", lambda self: pytest.fail("rows at the driver"))
    v = spark.range(1000).selectExpr("id", "array(cos(id), sin(id), cos(3 * id)) AS vector")
    monkeypatch.setattr(similarity, "BROADCAST_BYTES", 100)
    got = similarity.vector_topk_batch(v, v.withColumnRenamed("id", "query_id"), 4).collect()
    m = np.array([[np.cos(i), np.sin(i), np.cos(3 * i)] for i in range(1000)])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(m @ m.T, 6)
    want = {(q, int(i), k + 1) for q in range(1000) for k, i in enumerate(np.lexsort((np.arange(1000), -s[q]))[:4])}
    assert {(r.query_id, r.id, r.rank) for r in got} == want


def test_hot_images_are_split(spark):
    """One image with 3,000 persons: each of its pairs of chunks is a row."""
    rows = [(1, f"p{k}") for k in range(3000)] + [(2, "p1"), (2, "p2"), (2, "p2"), (3, " "), (3, None), (4, "p9")]
    faces = spark.createDataFrame(rows, "image_id long, label string")
    got = aggregates.co_occurrence(faces)
    assert got.count() == 3000 * 2999 // 2 and {(r.a, r.b) for r in got.where("shared = 2").collect()} == {("p1", "p2")}
    chunks = aggregates.dealt_chunks(faces.where("trim(label) <> ''").select("image_id", F.col("label").alias("person")).distinct()).where("image_id = 1").groupBy("i", "j").count().collect()
    assert len(chunks) == 12 * 13 // 2 and max(r["count"] for r in chunks) < 700


@pytest.mark.parametrize("offset", [0, 990, 12_345, 19_990, 20_005, 50_000])
def test_deep_pages(spark, offset):
    df = spark.range(20_000).selectExpr("id", "id * 7919 % 1000 AS v", "concat('n', id % 13) AS name", "1 AS __no").repartition(9)
    order = [windows.Desc(F.col("v")), F.col("name"), windows.Desc(F.col("id"))]
    want = sorted(((i * 7919 % 1000, f"n{i % 13}", i) for i in range(20_000)), key=lambda r: (-r[0], r[1], -r[2]))
    got = windows.page(df, order, offset, 30, shallow=1000)
    assert got.columns == df.columns and [(r.v, r.name, r.id) for r in got.collect()] == want[offset : offset + 30]


def test_deep_pages_sort_few_rows(spark):
    df = spark.range(100_000).selectExpr("id", "id * 7919 % 100003 AS v")
    got = windows.page(df, [F.col("v")], 50_000, 20)
    assert len(got.collect()) == 20
    kept = got._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in kept and "Filter" in kept


def test_fixity_runs(spark, tmp_path):
    good, plain = tmp_path / "a.tif", tmp_path / "b.tif"
    good.write_bytes(b"good")
    plain.write_bytes(b"plain")
    import hashlib

    rows = [(f"file:{good}", hashlib.sha256(b"good").hexdigest(), None, None), (f"file:{plain}", None, None, None), (f"file:{tmp_path}/gone.tif", "00", None, None)]
    table = spark.createDataFrame(rows, "file_path string, sha256 string, fixity_status string, last_fixity_check timestamp")

    def run(table):
        seen = fixity.observed_files(spark, str(tmp_path)).withColumn("file_path", F.regexp_replace("file_path", "^file:/+", "file:/"))
        checks = fixity.fixity_verify(table, seen, F.current_timestamp())
        return {r.outcome: r.n for r in checks.groupBy("outcome").agg(F.count("*").alias("n")).collect()}, checks

    first, checks = run(table)
    assert first == {"intact": 1, "initialized": 1, "missing": 1}
    table = spark.createDataFrame(catalogue.update_fixity(table, checks, "file_path").collect(), table.schema)
    assert run(table)[0] == {"intact": 2, "missing": 1}
    good.write_bytes(b"g0od")
    last, checks = run(table)
    assert last == {"intact": 1, "corrupted": 1, "missing": 1} and fixity.fixity_alerts(checks).count() == 2


def test_inventory_and_sidecars(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for name in ("x.tif", "y.JPG", "z.png", "n.txt"):
        (tmp_path / "d" / name).write_bytes(b"1")
    (tmp_path / "d" / "x.json").write_text("{broken")
    (tmp_path / "d" / "x.tif.json").write_text(json.dumps({"title": "X2"}))
    (tmp_path / "d" / "y.json").write_text(json.dumps({"title": "Y"}))
    files = inventory.file_inventory(spark, str(tmp_path))
    assert [r.path.rsplit("/", 1)[1] for r in files.collect()] == ["x.tif", "y.JPG", "z.png"]
    same = F.regexp_replace("sidecar", "^file:/+", "file:/")
    sidecars = inventory.read_sidecars(spark, str(tmp_path), "title string").withColumn("sidecar", same)
    got = {r.path.rsplit("/", 1)[1]: r.title for r in inventory.attach_sidecars(files.withColumn("path", F.regexp_replace("path", "^file:/+", "file:/")), sidecars).collect()}
    assert got == {"x.tif": "X2", "y.JPG": "Y", "z.png": None}


def test_ingest_twice(spark):
    files = spark.createDataFrame([("/r/a.jpg", 3), ("/r/b.jpg", 0), ("/r/c.jpg", 4)], "path string, size long")
    rows, journal = inventory.ingest(files, spark.createDataFrame([], "id string"), "b1", "/r")
    assert rows.count() == 2 and journal.first()[1:4] == (2, 0, 1)
    again, journal = inventory.ingest(files, rows, "b2", "/r")
    assert again.count() == 0 and journal.first()[1:4] == (0, 2, 1)


def test_retention(spark):
    files = spark.createDataFrame([(f"f{k}", 1 << 20, 100 * k) for k in range(1, 6)], "path string, size long, mtime long")
    assert sorted(r.path for r in aggregates.retention_plan(files, 3 << 20).collect()) == ["f1", "f2", "f3"]
    assert aggregates.retention_plan(files, 6 << 20).count() == 0


def test_merge_chain(spark):
    faces = spark.createDataFrame([("f1", "A", "la"), ("f2", "B", "lb"), ("f3", "C", None), ("f4", "D", "ld")], "face_id string, cluster_id string, label string")
    moves = spark.createDataFrame([("A", "B"), ("B", "C")], "source string, target string")
    got = {r.face_id: (r.cluster_id, r.label) for r in catalogue.merge_clusters(faces, moves).collect()}
    assert got == {"f1": ("C", "la"), "f2": ("C", "la"), "f3": ("C", "la"), "f4": ("D", "ld")}


def test_row_numbers_over_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(9)
    assert [r.n for r in row_numbers(df, [F.col("k")], "n").orderBy("k").collect()] == list(range(1, 1001))


def test_export_names_collide(spark):
    items = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a_1"), (4, "a")], "pos int, stem string")
    names = [r.export_name for r in exports.export_names(items, "stem", "pos").orderBy("pos").collect()]
    assert len(set(names)) == 4 and names[0] == "a.xmp" and names[2] == "a_1.xmp"


def test_export_names_are_unique(spark):
    stems = ["a", "a", "a_1", "a_3", "a", "a_3", "a_1", "a", "a_1_1", "b", "a_01", "a"]
    items = spark.createDataFrame(list(enumerate(stems)), "pos int, stem string")
    names = [r.export_name for r in exports.export_names(items, "stem", "pos").orderBy("pos").collect()]
    assert len(set(names)) == len(stems)
    assert names == ["a.xmp", "a_2.xmp", "a_1.xmp", "a_3.xmp", "a_4.xmp", "a_3_1.xmp", "a_1_2.xmp", "a_5.xmp", "a_1_1.xmp", "b.xmp", "a_01.xmp", "a_6.xmp"]
    assert exports.export_names(items.where("false"), "stem", "pos").count() == 0


def test_the_last_of_repeated_edits_wins(spark):
    from lumenarc.operators import catalogue as C

    table = spark.createDataFrame([(1, "old", None), (2, "keep", "n")], "id int, name string, notes string")
    edits = spark.createDataFrame([(1, "first", 1, 1), (1, "last", 2, 0), (1, "middle", 1, 2), (3, "new", 1, 1), (3, "newer", 1, 2)], "id int, name string, ts int, seq int")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(C.upsert(table, edits, "id").select("id", "name")) == [(1, "last"), (2, "keep"), (3, "newer")]
    assert rows(C.upsert_authority(table.select("id", "name"), edits.select("id", "name"))) == [(1, "middle"), (2, "keep"), (3, "newer")]
    faces = spark.createDataFrame([("f1", "c1", "x", "KI_AUTO"), ("f2", "c1", None, "KI_AUTO"), ("f3", None, None, "KI_AUTO")], "face_id string, cluster_id string, label string, curation_status string")
    named = spark.createDataFrame([("c1", "A", 1), ("c1", "B", 2)], "cluster_id string, new_label string, ts int")
    assert sorted((r.face_id, r.label) for r in C.label_clusters(faces, named).collect()) == [("f1", "B"), ("f2", "B"), ("f3", None)]
    single = spark.createDataFrame([("f3", "A", 2), ("f3", "B", 1), ("f3", " ", 3)], "face_id string, new_label string, ts int")
    assert [r.label for r in C.label_faces(faces, single).where("face_id = 'f3'").collect()] == ["A"]
    states = spark.createDataFrame([("f1", "verified", 1), ("f1", "ki_auto", 2), ("f1", "odd", 3)], "face_id string, status string, ts int")
    assert sorted((r.face_id, r.curation_status) for r in C.set_curation(faces, states, "face_id").collect()) == [("f1", "KI_AUTO"), ("f2", "KI_AUTO"), ("f3", "KI_AUTO")]
    assert C.upsert(table, edits.where("false"), "id").count() == 2


def test_catalogue_keeps_batch_ids(spark, tmp_path):
    table = spark.createDataFrame([(1, "007"), (2, "007"), (3, "12"), (4, None)], "id int, import_id string")
    inventory.write_catalogue(table, str(tmp_path / "t"))
    assert sorted((r.id, r.import_id) for r in inventory.read_catalogue(spark, str(tmp_path / "t")).collect()) == [(1, "007"), (2, "007"), (3, "12"), (4, None)]


def test_best_terms_in_blocks(spark, monkeypatch):
    from lumenarc.operators import similarity

    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(i, rng.random(4).tolist()) for i in range(30)], "query_id long, vector array<double>")
    terms = spark.createDataFrame([(i, rng.random(4).tolist()) for i in range(9)], "id long, vector array<double>")
    got = lambda: sorted((r.query_id, r.id, r.score, r["rank"]) for r in similarity.best_for_rows(rows, terms, 3).collect())
    whole = got()
    unit = lambda df: {r[0]: np.array(r.vector) / np.linalg.norm(r.vector) for r in df.collect()}
    a, b = unit(rows), unit(terms)
    want = [(q, t, pytest.approx(float(a[q] @ b[t]), abs=2e-6), k + 1) for q in a for k, t in enumerate(sorted(b, key=lambda t: -a[q] @ b[t])[:3])]
    assert whole == sorted(want, key=lambda w: w[:2])
    monkeypatch.setattr(similarity, "BROADCAST_BYTES", 100)
    assert got() == whole
    assert similarity.best_for_rows(rows, terms.where("false"), 3).count() == 0


def test_ingest_stream(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "catalogue")
    schema = "path string, size long"
    for k in range(2):
        spark.createDataFrame([(f"/r/{i}.jpg", 1) for i in range(k, k + 3)], schema).write.mode("append").json(str(source))
        stream = spark.readStream.schema(schema).json(str(source))
        streams.ingest_stream(stream, out, str(tmp_path / "cp"), "/r").awaitTermination(60)
    got = [r.path for r in spark.read.parquet(out).collect()]
    assert sorted(got) == [f"/r/{i}.jpg" for i in range(4)]


def test_alert_stream(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "alerts")
    schema = "file_path string, status string, checked_at timestamp"
    for rows in ([("a", "MISSING", 1), ("a", "MISSING", 2), ("b", "OK", 3), ("c", "CORRUPTED", 4)], [("a", "MISSING", 5), ("d", "READ_ERROR", 6)]):
        spark.createDataFrame(rows, "file_path string, status string, at int").selectExpr("file_path", "status", "timestamp_seconds(at) checked_at").write.mode("append").json(str(source))
        alerts = streams.fixity_alert_stream(spark.readStream.schema(schema).json(str(source)))
        alerts.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(60)
    assert sorted(r.file_path for r in spark.read.parquet(out).collect()) == ["a", "c", "d"]


def _archive(spark):
    """Six images of two batches: 1 and 2 look alike, 3 is a verso with the word, 4 its recto, 5 is of another batch, 6 has neither vector nor face."""
    table = spark.createDataFrame([(f"/{i}", text, "b2" if i == 5 else "b1") for i, text in enumerate(["", "", "kelch", "", "kelch", None], 1)], "file_path string, title string, import_id string")
    near = [1.0, 0.1]
    images = spark.createDataFrame([("/1", [1.0, 0.0]), ("/2", near), ("/3", [0.0, 1.0]), ("/4", [-1.0, 0.0]), ("/5", [1.0, 0.0]), ("/6", None)], "file_path string, vector array<double>")
    faces = spark.createDataFrame([("/1", "Anna", "c1"), ("/4", None, "c2"), ("/5", "Anna", "c1")], "file_path string, label string, cluster_id string")
    clusters = spark.createDataFrame([("c2", "Berta", "kelch"), ("c3", None, "kelch")], "id string, name string, notes string")
    pairs = spark.createDataFrame([("/4", "/3")], "recto_path string, verso_path string")
    return faces, table, images, clusters, pairs


def test_search_legs_keep_to_the_batch(spark):
    faces, table, images, clusters, pairs = _archive(spark)
    find = lambda query, **more: {r.file_path: (round(r.score, 2), r.match_type, r.persons) for r in search.hybrid_search(faces, table, images, query, [1.0, 0.0], columns=("title",), where=F.col("import_id") == "b1", **more).collect()}
    plain = find("kelch")
    assert plain == {"/1": (1.0, "clip", []), "/2": (1.0, "clip", []), "/3": (0.9, "metadata", [])} and "/5" not in plain
    assert find("kelch", pairs=pairs)["/4"] == (0.89, "metadata", [])
    assert find("kelch", pairs=pairs, clusters=clusters)["/4"] == (0.98, "person", ["Berta"])
    assert find("BERTA", clusters=clusters)["/4"] == (1.0, "person", ["Berta"])


def test_search_stacks_before_paging(spark):
    faces, table, images, _, _ = _archive(spark)
    found = search.hybrid_search(faces, table, images, "kelch", [1.0, 0.0], columns=("title",), stack=0.92, limit=2).collect()
    assert [(r.file_path, r.stack_size) for r in found] == [("/5", 3), ("/3", 1)]
    alone = search.stacked(spark.createDataFrame([("/6", 0.5)], "file_path string, score double"), images, 0.9).collect()
    assert [(r.file_path, r.stack_size) for r in alone] == [("/6", 1)]
    assert search.stacked(spark.createDataFrame([], "file_path string, score double"), images, 0.9).isEmpty()


def test_batches(spark):
    schema = "id string, name string, folder_path string, started_at timestamp, status string, notes string, image_count long, face_count long, skipped_count long"
    empty = spark.createDataFrame([], schema)
    rows = spark.createDataFrame([(1, "b1"), (2, None), (3, "b1")], "id long, import_id string")
    seeded = catalogue.seed_journal(empty, rows, rows.limit(1)).collect()
    assert [(r.id, r.status, r.image_count, r.face_count, r.notes) for r in seeded] == [("batch_initial_legacy", "completed", 3, 1, None)]
    assert catalogue.seed_journal(empty, rows.limit(0), rows).isEmpty()
    journal = spark.createDataFrame([("b1", "x", "/", None, "running", None, 2, 0, 0), ("b2", "y", "/", None, "running", None, 0, 0, 0)], schema)
    assert catalogue.seed_journal(journal, rows, rows) is journal
    left, images, faces = catalogue.rollback_batch("b1", journal, rows, rows.limit(0))
    assert [r.id for r in left.collect()] == ["b2"] and [r.id for r in images.collect()] == [2] and faces.isEmpty()
    assert {r.id: r.name for r in catalogue.rename_batches(journal, spark.createDataFrame([("b1", " new "), ("b2", " "), ("b9", "z")], "id string, name string")).collect()} == {"b1": "new", "b2": "y"}


def test_facets_of_nothing(spark):
    assert aggregates.year_range(spark.createDataFrame([], "year int")).first() == (1860, 2026)
    nulls = spark.createDataFrame([(None, " ", None, None)], "creator string, signature string, import_id string, y int")
    assert [tuple(r) for r in aggregates.facet_values(nulls, F.col("y")).collect()] == [("batch", "legacy", 1)]


def repeated_pages(spark, tmp_path):
    """Addresses that repeat, also by scheme, of known and of new files."""
    urls = ["https://a.org/x.html", "http://a.org/x.html", "https://a.org/x.html", "https://b.org/y", "http://b.org/y", "https://b.org/", "https://a.org/x.html"]
    d = str(tmp_path / "tables")
    spark.createDataFrame([(k, u, "<p>" + "z" * k) for k, u in enumerate(urls)], "page_id long, url string, html string").coalesce(1).write.parquet(f"{d}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{d}/pages.parquet/*.parquet'")
    return d, con


def test_each_entry_of_an_inventory_is_a_file(spark, tmp_path):
    d, con = repeated_pages(spark, tmp_path)
    for name in ("ING_1_ingest_journal", "ING_1_ingest_rows"):
        df, want = QUERIES[name](spark, d), con.execute(ORACLE[name])
        columns = [c[0] for c in want.description]
        assert rows(df.collect(), df.columns) == rows(want.fetchall(), columns)


def test_each_entry_of_a_stream_is_a_file(spark, tmp_path):
    d, con = repeated_pages(spark, tmp_path)
    df, want = QUERIES["STR_1_ingest_stream"](spark, d), con.execute(ORACLE["STR_1_ingest_stream"])
    columns = [c[0] for c in want.description]
    assert rows(df.collect(), df.columns) == rows(want.fetchall(), columns)


def test_confidence_rounds_tenths_half_up(spark):
    scores = spark.createDataFrame([(1, 1, 0.2077, 1), (1, 2, 0.2076, 2), (2, 1, 0.2737, 1)], "query_id long, id long, score double, rank int")
    assert sorted(r.confidence for r in search.zero_shot_tags(scores, 5).collect()) == [28.8, 28.9, 61.9]


def test_best_rows_of_long_tables():
    """Strips after the first, equal scores (the earlier row wins), copies, and k beyond the table."""
    rng = np.random.default_rng(3)
    m = rng.normal(size=(6000, 8))
    m[3000:5200] = m[:2200]
    m[5200:5600] = m[0]
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    q = m[::13]
    want = np.argsort(-np.round(q @ m.T, 6), axis=1, kind="stable")
    for k in (1, 7, 700, 6001):
        for at, place, score in similarity._best(q, m, k):
            assert (place == want[at : at + len(place), :k]).all()
            assert (score == np.round(np.take_along_axis(q[at : at + len(place)] @ m.T, place, 1), 6)).all()


def test_stacks_with_a_table_of_vectors(spark):
    """Hits without vectors, lists in several rounds and cells; no pair of hits is kept."""
    hits = spark.createDataFrame([r[:3] for r in long_lists()], "query_id long, id long, rank int").repartition(6)
    whole = spark.createDataFrame(long_lists(), "query_id long, id long, rank int, vector array<double>")
    want = {(r.query_id, r.id): r.stack_of for r in similarity.stack_results(whole, 0.95, list_rows=10_000).collect()}
    table = whole.where("query_id = 3").select("id", "vector")
    for first in (1, 50):
        got = similarity.stack_results(hits, 0.95, first, table).collect()
        assert len(got) == 1400 and {(r.query_id, r.id): r.stack_of for r in got} == want


def stacked_by_hand(ids, m, queries, least, threshold):
    """(query_id, id, rank, stack_of) by the greedy rule, one hit after the other."""
    n = np.linalg.norm(m, axis=1, keepdims=True)
    m, out = m / np.where(n > 0, n, 1), set()
    for q in queries:
        s = np.round(m @ m[q], 6)
        hits = [i for i in np.lexsort((ids, -s)) if s[i] >= least]
        owner = {}
        for k, i in enumerate(hits):
            if i not in owner:
                owner[i] = i
                owner |= {j: i for j in hits[k + 1 :] if j not in owner and np.round(m[j] @ m[i], 6) >= threshold}
        out |= {(int(ids[q]), int(ids[i]), r + 1, int(ids[owner[i]])) for r, i in enumerate(hits)}
    return out


@pytest.mark.parametrize(("first", "rows", "band"), [(1, 100, 50), (7, 1000, 10**6), (40, 65_536, 200), (2048, 150, 10**6)])
def test_searches_are_stacked_by_the_greedy_rule(spark, monkeypatch, first, rows, band):
    """Rounds, blocks and bands of any size; equal scores and copies, a zero vector, null vectors."""
    ids, m = np.arange(700) * 3, np.array([r[3] for r in long_lists()[700:]])
    m[300:420] = m[30]
    m[650] = 0
    table = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, m, strict=True)] + [(5, None)], "id long, vector array<double>").repartition(5)
    asked = [0, 30, 110, 650]
    queries = table.where(F.col("id").isin([int(ids[q]) for q in asked] + [5])).withColumnRenamed("id", "query_id")
    monkeypatch.setattr(similarity, "BAND_HITS", band)
    got = similarity.stack_search(table, queries, 0.0, 0.95, first, rows).collect()
    want = stacked_by_hand(ids, m, asked, 0.0, 0.95)
    assert len(got) == len(want) > 1000 and {(r.query_id, r.id, r.rank, r.stack_of) for r in got} == want
    assert all(r.similarity == 1.0 if r.stack_of == r.id else r.similarity >= 0.95 for r in got)
    assert not similarity.stack_search(table, queries.where("query_id < 0"), 0.0, 0.95).collect()


@pytest.mark.parametrize("name", ["STK_1_stack_results", "STK_1_stacks_in_rounds"])
def test_hits_that_are_stacked_are_not_kept(spark, monkeypatch, name):
    """What is checkpointed are vectors and heads; hits, a hundredth of all pairs, filled the disk."""
    kept = []

    def counted(df, f=graph.checkpointed):
        out = f(df)
        kept.append(out.count())
        return out

    for module in (similarity, windows, q_search):
        if hasattr(module, "checkpointed"):
            monkeypatch.setattr(module, "checkpointed", counted)
    hits = QUERIES[name](spark, "/root/testdata/sf0.1").count()
    assert kept and sum(kept) < hits / 2


def test_strips_of_pairs_are_bounded(spark, planted, monkeypatch):
    """A strip of one row gives the same pairs."""
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(planted)], "id long, vector array<double>").repartition(3)
    want = sorted(tuple(r) for r in similarity.similarity_join(df, 0.5).collect())
    monkeypatch.setattr(similarity, "STRIP_PAIRS", 50)
    assert sorted(tuple(r) for r in similarity.similarity_join(df, 0.5).collect()) == want and len(want) >= 9


def test_merge_joins_faces_by_cluster_only(spark):
    """Faces without an end, nearly all, aren't joined by it: they would be one task's."""
    faces = spark.createDataFrame([(f"f{k}", f"c{k % 5}", f"L{k}") for k in range(20)], "face_id string, cluster_id string, label string")
    moves = spark.createDataFrame([("c1", "c2")], "source string, target string")
    out = catalogue.merge_clusters(faces, moves)
    assert sorted(out.where("cluster_id = 'c2'").select("face_id", "label").collect()) == sorted((f"f{k}", "L12") for k in range(20) if k % 5 in (1, 2))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_authorities_are_ranked_before_they_are_joined(spark):
    """An identifier that many records share doesn't bring them all to the join."""
    from lumenarc.operators import vocabulary

    table = spark.createDataFrame([(k, f"n{k}", "g", "11Q") for k in range(50)], "id long, canonical string, gnd string, iconclass string")
    asked = spark.createDataFrame([("11Q",), ("g",), ("g",), ("n7",), ("8",), ("none",)], "identifier string")
    found = vocabulary.authority_lookup(table, asked)
    assert sorted((r.identifier, r.id) for r in found.collect()) == [("11Q", 0), ("8", 8), ("g", 0), ("n7", 7)]
    plan = found._jdf.queryExecution().optimizedPlan().toString().split("\n")
    depth = lambda word: min(len(x) - len(x.lstrip(" :+-|")) for x in plan if word in x)
    assert depth("Join") < depth("WindowGroupLimit")


def test_row_numbers_are_given_after_one_shuffle(spark):
    """Rows aren't dealt out again to be numbered; ties, falling orders and nulls in place."""
    rows = [(k % 4 or None, k // 4 % 3 or None, k) for k in range(48)]
    df = spark.createDataFrame(rows, "a long, b long, k long").repartition(5)
    found = row_numbers(df, [F.col("a"), windows.Desc(F.col("b"))], "n", start=10, ties=[F.concat(F.lit("x"), F.format_string("%03d", "k"))])
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    want = sorted(rows, key=lambda r: (r[0] or 0, r[1] is None, -(r[1] or 0), r[2]))
    assert found.columns == ["a", "b", "k", "n"] and [tuple(r) for r in found.orderBy("n").collect()] == [(*r, 10 + i) for i, r in enumerate(want)]
