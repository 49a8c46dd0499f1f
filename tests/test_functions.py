"""Literal rows for column functions, pairs, vocabulary and exports."""

from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from lumenarc.functions import images, keys, text, vectors
from lumenarc.operators import pairs, search, vocabulary
from lumenarc.operators.filters import match_facets
from lumenarc.sources import exports


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(("date", "path", "year"), [
    ("1928:05:14 12:00:00", "/a.jpg", 1928), ("2010-10-31", "/a.jpg", 2010), ("ca. 1895", "/a.jpg", 1895), (None, "/archive/1914_Kaiserreich/foto1.jpg", 1914),
    (None, "/archive/unbekannt/foto.jpg", None), ("119281", "/a.jpg", None), (None, "/1914/x_1999/foto_2001.jpg", 2001),
])
def test_years(spark, date, path, year):
    assert one(spark, text.year_of_item(F.lit(date).cast("string"), F.lit(path))) == year


def test_facet_year_is_leftmost(spark):
    assert one(spark, text.facet_year(F.lit(None).cast("string"), F.lit("/1914/x_1999/foto_2001.jpg"))) == 1914


def test_uuid5(spark):
    for name in ("a/b.jpg", "Größe/ü.tif", ""):
        assert one(spark, keys.uuid5_image(F.lit(name))) == str(uuid.uuid5(uuid.UUID(keys.ARCHIVE_NAMESPACE), name))


def test_ocr(spark):
    dirty = "In noftro Klofter trug der  Priefter\t ein Meffgewand \n\n Sacræ Scripturæ et Cœlum Meſſe "
    assert one(spark, text.clean_ocr_text(F.lit(dirty))) == "In noftro Kloster trug der Priester ein Messgewand\nSacrae Scripturae et Coelum Messe"


def test_ocr_patterns_are_tried_where_their_letters_are(spark):
    """Letters that are i or k without case, white space of all kinds, words beside each other: as with every pattern in turn, which is no part of the plan."""
    cases = ["PRİEFTER PRıEFTER KLOFTER Kloſters", "\t a \t\tb\t \r\n\r  \rFEFT feftlicher Feftes\t", "Erzbifchof Bifchof bifchöflicher BIFCHÖFLICH CHORGEFTÜHL", "Chriftus-Chrifto chriftlich Kruzifir Mifsa Eucharifties", "Feftakriftei Meffe Meffgewand ́Meffe Meffé", "", "nichts"]
    out = F.col("x")
    for old, new in text.OLD_LETTERS:
        out = F.replace(out, F.lit(old), F.lit(new))
    for pattern, right in text.OCR_TERMS:
        out = F.regexp_replace(out, f"(?iU){pattern}", right)
    lines = F.transform(F.split(out, r"\r\n|\n|\r"), lambda x: F.trim(F.regexp_replace(x, r"[ \t]+", " ")))
    df = spark.createDataFrame([(c,) for c in cases], "x string")
    found = df.select(text.clean_ocr_text(F.col("x")).alias("got"), F.array_join(F.filter(lines, lambda x: x != ""), "\n").alias("want"), "x")
    assert all(r.got == r.want for r in found.collect()) and found.where("got <> x").count() == 5
    plan = df.select(text.clean_ocr_text(F.col("x")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 2


def test_no_ocr_correction_makes_another_misread_word():
    """Both begin at a word's start, so the corrected letters would have to be the other word's."""
    for pattern, right in text.OCR_TERMS:
        word, other = text.bare_term(pattern), right.lower()
        assert pattern.startswith(r"\b") and len(word) == len(other)
        first = next(k for k in range(len(word)) if word[k] != other[k])
        assert not any(text.bare_term(p)[: first + 1] == other[: first + 1] for p, _ in text.OCR_TERMS)


def test_lists(spark):
    assert one(spark, text.decode_list(F.lit('["b", "a"]'))) == ["b", "a"]
    assert one(spark, text.decode_list(F.lit("b, ,a"))) == ["b", "a"]
    assert one(spark, text.decode_list(F.lit(None).cast("string"))) == []
    assert one(spark, text.normalise_keywords(F.lit("b, a,b,, "))) == ["a", "b"]


@pytest.mark.parametrize(("a", "b", "want"), [("0" * 16, "0" * 15 + "7", 3), ("f" * 16, "0" * 16, 64), ("", "0" * 16, None), ("zz", "0" * 16, None)])
def test_hamming(spark, a, b, want):
    assert one(spark, vectors.hamming64(F.lit(a), F.lit(b))) == want


@pytest.mark.parametrize(("score", "distance", "want"), [(0.5, 2, "EXACT_DUPLICATE"), (0.5, 7, "FORMAT_VARIANT"), (0.9, 30, "SERIES_VARIANT"), (0.99, None, "EXACT_DUPLICATE"), (0.95, None, "FORMAT_VARIANT"), (0.2, None, "RELATED")])
def test_classes(spark, score, distance, want):
    assert one(spark, vectors.classify_variant(F.lit(score), F.lit(distance).cast("int"))) == want


def test_vectors(spark):
    zero = F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, vectors.l2_normalise(zero)) == [0.0, 0.0]
    assert one(spark, vectors.cosine(zero, zero)) == 0.0
    assert one(spark, vectors.l2_normalise(F.array(F.lit(3.0), F.lit(4.0)))) == pytest.approx([0.6, 0.8])


def test_regions(spark):
    percent = F.struct(F.lit(20.0).alias("left"), F.lit(30.0).alias("top"), F.lit(10.0).alias("width"), F.lit(20.0).alias("height"))
    none = F.lit(None).cast("struct<left: double, top: double, width: double, height: double>")
    box = F.array(*(F.lit(x) for x in (100, 200, 300, 400)))
    assert tuple(one(spark, images.mwg_region(percent, box, F.lit(0), F.lit(0)))) == (0.25, 0.40, 0.10, 0.20)
    assert tuple(one(spark, images.mwg_region(none, box, F.lit(2000), F.lit(1000)))) == (0.10, 0.30, 0.10, 0.20)
    assert one(spark, images.mwg_region(none, box, F.lit(0), F.lit(0))) is None


@pytest.mark.parametrize(("r", "g", "b", "s", "want"), [(185, 140, 95, 120, "albumen"), (130, 130, 130, 0, "silver_gelatin"), (30, 80, 170, 200, "cyanotype")])
def test_carrier(spark, r, g, b, s, want):
    assert one(spark, images.carrier_type(F.lit(r), F.lit(g), F.lit(b), F.lit(s))) == want


def test_facets(spark):
    item = spark.createDataFrame([("1925-06-01", "Sig-1925-A", "Atelier Müller")], "date string, signature string, creator string")
    year = text.year_of_item(F.col("date"), F.lit(""))
    hits = lambda **k: match_facets(item, year, **k).count()
    assert [hits(year_from=1914, year_to=1939), hits(year_from=1930, year_to=1945), hits(signature="Sig-1925"), hits(signature="Sig-9999"), hits(creator="müller"), hits(creator="schmidt"), hits(epoch="weimar")] == [1, 0, 1, 0, 1, 0, 1]


def test_pairs(spark):
    names = ["foto_1928_r.jpg", "foto_1928_v.jpg", "dom_altar_recto.png", "x_vorderseite.tif", "x_rs.tif", "postkarte_042_a.webp", "postkarte_042_b.jpg", "urkunde_01.jpg", "urkunde_02.jpg", "landschaft.jpg"]
    files = spark.createDataFrame([(f"/d/{n}",) for n in names], "file_path string")
    got = {r.file_path[3:]: (r.role, r.companion and r.companion[3:]) for r in pairs.recto_verso_pairs(files).collect()}
    assert got == {
        "foto_1928_r.jpg": ("recto", "foto_1928_v.jpg"), "foto_1928_v.jpg": ("verso", "foto_1928_r.jpg"), "dom_altar_recto.png": ("recto", None), "x_vorderseite.tif": ("recto", "x_rs.tif"), "x_rs.tif": ("verso", "x_vorderseite.tif"),
        "postkarte_042_a.webp": ("recto", "postkarte_042_b.jpg"), "postkarte_042_b.jpg": ("verso", "postkarte_042_a.webp"), "urkunde_01.jpg": ("recto", "urkunde_02.jpg"), "urkunde_02.jpg": ("verso", "urkunde_01.jpg")}
    strict = {r.file_path[3:]: r.companion for r in pairs.recto_verso_pairs(files, strict_tags=True).collect()}
    assert strict["x_vorderseite.tif"] is None and strict["x_rs.tif"] == "/d/x_vorderseite.tif"


def test_vocabulary(spark):
    terms = spark.createDataFrame([(1, "Kasel", "Paramente", ["Messgewand"]), (2, "Chormantel", "Paramente", ["Pluviale"]), (3, "Monstranz", "Gerät", ["Ostensorium", "Messgewand"])], "position long, canonical string, category string, synonyms array<string>")
    asked = spark.createDataFrame([("Pluviale",), ("ein altes Ostensorium",), ("UnbekanntesWort999",), ("monstranzen",), ("Messgewand",)], "query string")
    got = {r.query: (r.canonical, r.tier) for r in vocabulary.expand_terms(asked, terms).collect()}
    assert got == {"Pluviale": ("Chormantel", 1), "ein altes Ostensorium": ("Monstranz", 2), "monstranzen": ("Monstranz", 3), "Messgewand": ("Monstranz", 1)}
    assert [r.canonical for r in vocabulary.autocomplete(terms, "Mess").collect()] == ["Kasel", "Monstranz"]
    assert vocabulary.autocomplete(terms, "M").count() == 0


def test_person_scores(spark):
    score = lambda name, q: one(spark, search.person_score(F.lit(name), q))
    assert [score("Pfarrer Mueller", "pfarrer mueller"), score("Pfarrer Mueller", "mueller"), score("Pfarrer Mueller", "herr mueller"), score("Huber", "mueller")] == [1.0, 0.98, 0.95, None]


def test_findbuch_file(spark, tmp_path):
    items = spark.createDataFrame([(1, "A-1954-042", "Bischofsweihe im Dom", "1954-06-12", None, ["Bischof Johann", "Weihbischof Karl"], None, "a.jpg", "/x/a.jpg"), (2, None, "", None, "C;D", [], 'n "q"', "", "/x/b.jpg")],
                                  "no long, signature string, title string, date string, creator string, persons array<string>, notes string, file_name string, file_path string")
    out = str(tmp_path / "csv")
    exports.write_findbuch(exports.findbuch_rows(items), out, "Sammlung", "Archiv", "01.01.2024 00:00:00")
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "csv").glob("part-*")))
    lines = data.decode("utf-8").split("\r\n")
    assert data[:3] == b"\xef\xbb\xbf" and lines[4] == "" and lines[6] == "1;A-1954-042;Bischofsweihe im Dom;1954-06-12;;Bischof Johann, Weihbischof Karl;;a.jpg;/x/a.jpg"
    assert lines[7] == '2;;Objekt 2;;"C;D";;"n ""q""";b.jpg;/x/b.jpg'


def test_ead_file(spark, tmp_path):
    items = spark.createDataFrame([(1, "A-1", "T <1>", None, "C", ["P1", "P2"], None, "a.jpg", "/x/a.jpg"), (2, None, None, "1928", None, [], "n", "b.jpg", "/x/b.jpg")],
                                  "no long, signature string, title string, date string, creator string, persons array<string>, notes string, file_name string, file_path string")
    exports.write_ead(exports.ead_items(items).coalesce(1), str(tmp_path / "ead"))
    from xml.etree import ElementTree

    c01 = ElementTree.parse(next((tmp_path / "ead").glob("part-*"))).getroot().findall("c01")
    assert [c.find("did/unitid").text for c in c01] == ["A-1", "POS-0002"] and c01[0].find("did/unittitle").text == "T <1>"
    assert [p.text for p in c01[0].findall("controlaccess/persname")] == ["P1", "P2"] and c01[1].find("controlaccess") is None
