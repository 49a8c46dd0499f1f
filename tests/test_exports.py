"""Export documents: read in order of their files they are one well-formed document."""

from __future__ import annotations

import os
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from lumenarc.sources import exports

ITEMS = [(i, f"/a/{i} & \"x\".jpg", f"{i}.jpg", "" if i % 3 else f"<T> {i}", f"S;{i}" if i % 2 else None, "Ä & B" if i % 4 else None, "1928" if i % 5 else " ", ["P & Q", "<R>"] if i % 2 else [], "note ]]>" if i % 6 == 0 else None) for i in range(57)]


@pytest.fixture(scope="module")
def items(spark):
    df = spark.createDataFrame(ITEMS, "id long, file_path string, file_name string, title string, signature string, creator string, date string, persons array<string>, notes string").repartition(5)
    return exports.numbered(df, [F.col("id")])


def read(lines, path):
    """The document that the files are in order, and their number."""
    lines.sparkSession.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    exports.write_document(lines, path)
    lines.sparkSession.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted(f for f in os.listdir(path) if f.startswith("part-"))
    return ElementTree.fromstring("".join(open(os.path.join(path, f), encoding="utf-8").read() for f in files).encode()), len(files)


def test_ead(items, tmp_path):
    root, files = read(exports.ead_document(items, "A & \"Co\"", "<B>", "2024-01-31", "20240131_2"), str(tmp_path / "ead"))
    n = {"e": exports.EAD_NS}
    assert root.tag == f"{{{exports.EAD_NS}}}ead" and files > 1
    assert root.findtext("e:control/e:filedesc/e:titlestmt/e:titleproper", namespaces=n) == "Findbuch: <B>" and root.findtext("e:control/e:maintenanceagency/e:agencyname", namespaces=n) == 'A & "Co"'
    assert root.findtext("e:archdesc/e:scopecontent/e:p", namespaces=n).startswith("Verzeichnis von 57 ")
    found = root.findall("e:archdesc/e:dsc/e:c01", n)
    assert [c.get("id") for c in found] == [f"item_{k:04d}" for k in range(1, 58)]
    for c, (i, path, name, title, signature, creator, date, persons, notes) in zip(found, ITEMS, strict=True):
        assert c.findtext("e:did/e:unitid", namespaces=n) == (signature or f"POS-{i + 1:04d}") and c.findtext("e:did/e:unittitle", namespaces=n) == (title or name)
        assert c.find("e:did/e:daoset/e:dao", n).get("href") == path and c.findtext("e:did/e:unitdate", namespaces=n) == (date if date.strip() else None)
        assert [p.text for p in c.findall("e:controlaccess/e:persname", n)] == persons and c.findtext("e:did/e:origination/e:persname", namespaces=n) == creator
        assert c.findtext("e:scopecontent/e:p", namespaces=n) == notes


def test_lido(items, tmp_path):
    root, _ = read(exports.lido_document(items, "A & \"Co\"", "Rights <r>"), str(tmp_path / "lido"))
    n = {"l": exports.LIDO_NS}
    found = root.findall("l:lido", n)
    assert root.tag == f"{{{exports.LIDO_NS}}}lidoWrap" and len(found) == 57
    assert [r.findtext("l:lidoRecID", namespaces=n) for r in found] == [s or name for _, _, name, _, s, *_ in ITEMS]
    assert {r.findtext("l:administrativeMetadata/l:rightsWorkWrap/l:rightsSet/l:rightsType/l:term", namespaces=n) for r in found} == {"Rights <r>"}


def test_premis(spark, tmp_path):
    rows = [(f"/a/{i}&.jpg", f"{i}&.jpg", ("OK", "MISSING", None)[i % 3], f"{i:064x}" if i % 2 else None, i) for i in range(40)]
    df = spark.createDataFrame(rows, "file_path string, file_name string, fixity_status string, sha256 string, file_size long").withColumn("last_fixity_check", F.timestamp_seconds(F.lit(1_700_000_000)))
    root, _ = read(exports.premis_document(df, "A & Co", "agent <1>"), str(tmp_path / "premis"))
    p = f"{{{exports.PREMIS_NS}}}"
    tags = [c.tag for c in root]
    assert tags == [f"{p}object", f"{p}event"] * 40 + [f"{p}agent"]
    agent = root[-1]
    assert agent.findtext(f"{p}agentIdentifier/{p}agentIdentifierValue") == "agent <1>" and agent.findtext(f"{p}agentName").startswith("A & Co - ")
    assert {e.findtext(f"{p}linkingAgentIdentifier/{p}linkingAgentIdentifierValue") for e in root.findall(f"{p}event")} == {"agent <1>"}


def test_nothing_is_a_document_too(items, tmp_path):
    root, _ = read(exports.lido_document(items.where("false"), "A"), str(tmp_path / "none"))
    assert len(root) == 0


def test_records_of_one_path_are_in_order_and_made_after_numbering(spark):
    """Digests one of which begins the other, none, equal but for the size; no line is in what is shuffled and kept."""
    rows = [(path, "a.jpg", None, digest, size) for path in ("/a", None, "/b") for digest in ("ab", "abc", "ab0", None, "a&", " ", "ab<") for size in (12, 3, None)]
    df = spark.createDataFrame(rows, "file_path string, file_name string, fixity_status string, sha256 string, file_size long").withColumn("last_fixity_check", F.timestamp_seconds(F.lit(1_700_000_000))).repartition(7)
    found = exports.premis_document(df, "A")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert any("eventIdentifier" in x for x in plan.split("\n") if "Project" in x)
    want = sorted(((r.file_path is not None, r.file_path or "", r.xml.encode()) for r in exports.premis_records(df).collect()))
    got = sorted((r.place, r.line.encode()) for r in found.collect())
    assert [x[1] for x in got[1:-1]] == [x[2] for x in want] and [x[0] for x in got[1:-1]] == list(range(1, 64))


def test_six_decimals_are_those_of_printf(spark):
    values = [0.0, -0.0, 1 / 3, -2 / 3, 5e-7, 4.9e-7, -4e-7, -5e-7, 1.0000005, 0.1234565, 0.1234575, 12345678.1234565, 1e20, 1e33, 1e300, float("nan"), float("inf"), float("-inf"), None]
    df = spark.createDataFrame([(x,) for x in values], "x double").select("x", exports._six(F.col("x")).alias("got"), F.format_string("%.6f", "x").alias("want"))
    assert all(r.got == r.want for r in df.collect()) and df.where("got = '0.123457'").count() == 1


def test_regions_of_images_take_one_shuffle(spark):
    """Faces and their images are made where the lines of an order are."""
    from lumenarc.plans.queries import QUERIES

    found = QUERIES["SNK_5_xmp_records"](spark, "/root/testdata/sf0.001")
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
