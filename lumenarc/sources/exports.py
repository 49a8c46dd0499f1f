"""Finding aids and preservation records as text rows and files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenarc.functions.keys import base_name, uuid5
from lumenarc.functions.text import csv_field, filled, xml_escape
from lumenarc.operators.windows import row_numbers

# fixed values: column heads of the finding aid, notes of preservation events, MIME types
FINDING_AID_HEADS = ("Lfd. Nr.", "Archivsignatur", "Titel / Enthält-Vermerk", "Datierung", "Urheber / Fotograf", "Dargestellte Personen", "Archivalische Notizen", "Dateiname", "Dateipfad")
FIXITY_NOTES = {
    "OK": "Prüfsumme verifiziert. Bitstream ist unversehrt und intakt.",
    "CORRUPTED": "WARNUNG: Prüfsummen-Mismatch festgestellt. Bit-Rot oder Dateimanipulation erkannt!",
    "MISSING": "FEHLER: Datei existiert nicht mehr auf dem Primärspeicher.",
}
MIME_TYPES = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "tif": "image/tiff", "tiff": "image/tiff", "webp": "image/webp", "gif": "image/gif", "bmp": "image/bmp", "pdf": "application/pdf"}
# fixed values: labels and texts inside finding aids and museum records
SIGNATURE_LABEL, CREATOR_LABEL, SCAN_LABEL, UNTITLED = "Archivsignatur", "Fotograf / Urheber", "Digitalisat / Master-Scan", "Fotodokument"
WORK_TYPE, EVENT_TYPE, CREATOR_ROLE, RESOURCE_TYPE = "Fotografie", "Herstellung / Aufnahme", "Fotograf / Bildurheber", "Master-Digitalisat"
RIGHTS = "Gemeinfrei / Bildbestand im kirchlichen Archiv"
# fixed values: texts of preservation records
DIGEST_ORIGINATOR, CHECK_DETAIL = "Archiv-Fixity-Daemon", ("Kryptographische SHA-256 Bitstream-Validierung für ", " (Integritätsprüfung gegen Bit-Rot nach ISO 14721 OAIS)")
AGENT_NAME, AGENT_NOTE = "Fixity Preservation Daemon", "Autonomer Hintergrund-Prüfsummen- und Bitrot-Wächter (ISO 14721 OAIS)"
# fixed values: name spaces and schemas
XSI = "http://www.w3.org/2001/XMLSchema-instance"
EAD_NS, EAD_XSD = "http://ead3.archivists.org/schema/", "http://ead3.archivists.org/schema/ead3.xsd"
LIDO_NS, LIDO_XSD = "http://www.lido-schema.org", "http://www.lido-schema.org/schema/v1.1/lido-v1.1.xsd"
PREMIS_NS, PREMIS_XSD = "http://www.loc.gov/premis/v3", "https://www.loc.gov/standards/premis/premis.xsd"
DECLARATION = '<?xml version="1.0" encoding="UTF-8"?>'


def numbered(items: DataFrame, order: Sequence[Column]) -> DataFrame:
    """WIN-2: adds ``no``, the position from 1 over the whole table, without a single-partition window."""
    return row_numbers(items, order, "no")


def title_of(prefix: str) -> Column:
    return F.coalesce(filled(F.col("title")), filled(F.col("file_name")), F.concat(F.lit(f"{prefix} "), F.col("no").cast("string")))


def findbuch_rows(items: DataFrame) -> DataFrame:
    """SNK-1: (no, line) of numbered items: nine fields, semicolons, persons joined by commas."""
    name = F.coalesce(filled(F.col("file_name")), base_name(F.col("file_path")))
    fields = [F.col("no"), F.col("signature"), title_of("Objekt"), F.col("date"), F.col("creator"), F.array_join(F.coalesce("persons", F.array().cast("array<string>")), ", "), F.col("notes"), name, F.col("file_path")]
    return items.select("no", F.concat_ws(";", *(csv_field(f) for f in fields)).alias("line"))


def write_findbuch(rows: DataFrame, path: str, collection: str, archive: str, created: str) -> None:
    """SNK-1: one file per range of rows; the first starts with a byte order mark, four head lines, an empty line and the column heads."""
    spark = rows.sparkSession
    total = rows.count()
    head = ["﻿" + f"# FINDBUCH / BESTANDSÜBERSICHT: {collection}", f"# Institution: {archive}", f"# Erstellt am: {created}", f"# Anzahl Verzeichnungseinheiten: {total}", "", ";".join(FINDING_AID_HEADS)]
    top = spark.createDataFrame([(k - len(head), line) for k, line in enumerate(head)], "no long, line string")
    ordered = top.unionByName(rows).repartitionByRange("no").sortWithinPartitions("no")
    ordered.select("line").write.option("lineSep", "\r\n").text(path)


def ead_items(items: DataFrame) -> DataFrame:
    """SNK-2: one c01 structure per numbered item; _ fields are attributes."""
    text = lambda name, c: F.when(filled(c).isNotNull(), c).alias(name)
    dao = F.struct(F.lit("derived").alias("_daotype"), F.col("file_path").alias("_href"), F.struct(F.coalesce(filled(F.col("file_name")), base_name(F.col("file_path"))).alias("p")).alias("descriptivenote"))
    person = F.transform("persons", lambda p: F.struct(F.lit("dep").alias("_relator"), p.alias("_VALUE")))
    did = F.struct(
        F.struct(F.lit(SIGNATURE_LABEL).alias("_label"), F.coalesce(filled(F.col("signature")), F.format_string("POS-%04d", "no")).alias("_VALUE")).alias("unitid"),
        title_of(UNTITLED).alias("unittitle"), text("unitdate", F.col("date")),
        F.when(filled(F.col("creator")).isNotNull(), F.struct(F.lit(CREATOR_LABEL).alias("_label"), F.struct(F.lit("photographer").alias("_role"), F.col("creator").alias("_VALUE")).alias("persname"))).alias("origination"),
        F.struct(F.lit(SCAN_LABEL).alias("physfacet")).alias("physdesc"),
        F.when(filled(F.col("file_path")).isNotNull(), F.struct(dao.alias("dao"))).alias("daoset"))
    return items.select(
        F.lit("item").alias("_level"), F.format_string("item_%04d", "no").alias("_id"), did.alias("did"),
        F.when(filled(F.col("notes")).isNotNull(), F.struct(F.col("notes").alias("p"))).alias("scopecontent"),
        F.when(F.size("persons") > 0, F.struct(person.alias("persname"))).alias("controlaccess"))


def ead_texts(items: DataFrame) -> DataFrame:
    """SNK-2: (no, xml): one c01 element per numbered item, as text."""
    return items.select("no", _ead_text().alias("xml"))


def _ead_text() -> Column:
    given = lambda c: filled(c).isNotNull()
    some = lambda condition, element: F.coalesce(F.when(condition, element), F.lit(""))
    name = F.coalesce(filled(F.col("file_name")), base_name(F.col("file_path")))
    did = F.concat(
        _el("unitid", xml_escape(F.coalesce(filled(F.col("signature")), F.format_string("POS-%04d", "no"))), f'label="{SIGNATURE_LABEL}"'), _el("unittitle", xml_escape(title_of(UNTITLED))),
        some(given(F.col("date")), _el("unitdate", xml_escape(F.col("date")))),
        some(given(F.col("creator")), _el("origination", _el("persname", xml_escape(F.col("creator")), 'role="photographer"'), f'label="{CREATOR_LABEL}"')),
        _el("physdesc", _el("physfacet", F.lit(SCAN_LABEL))),
        some(given(F.col("file_path")), _el("daoset", F.concat(F.lit('<dao daotype="derived" href="'), xml_escape(F.col("file_path")), F.lit('">'), _el("descriptivenote", _el("p", xml_escape(name))), F.lit("</dao>")))))
    persons = F.array_join(F.transform(F.coalesce("persons", F.array().cast("array<string>")), lambda p: _el("persname", xml_escape(p), 'relator="dep"')), "")
    rest = F.concat(some(given(F.col("notes")), _el("scopecontent", _el("p", xml_escape(F.col("notes"))))), some(F.size("persons") > 0, _el("controlaccess", persons)))
    return F.concat(F.lit('<c01 level="item" id="'), F.format_string("item_%04d", "no"), F.lit('">'), _el("did", did), rest, F.lit("</c01>"))


def _quoted(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace('"', "&quot;")


# columns of which the records of documents are made
ITEM_COLUMNS = ("no", "file_path", "file_name", "title", "signature", "creator", "date", "persons", "notes")
CHECK_COLUMNS = ("file_path", "file_name", "file_size", "fixity_status", "last_fixity_check", "sha256")


def _around(items: DataFrame, line: Column, order: Sequence[Column], head: str, tail: str) -> DataFrame:
    """(place, line): the head at place 0, one record a line from 1 on by ``order`` and line, the tail behind the last.

    Items are sorted and numbered; the long lines are made of what is numbered, so that none is shuffled or kept.
    """
    lines = row_numbers(items, order, "place", ties=[line]).select("place", line.alias("line"))
    ends = items.sparkSession.createDataFrame([(0, head), ((1 << 62), tail)], "place long, line string")
    return ends.unionByName(lines)


def ead_document(items: DataFrame, archive: str, collection: str, created: str, record_id: str) -> DataFrame:
    """SNK-2: (place, line) of an EAD3 document around ead_texts(): control, archdesc and its description; ``created`` is a date (2024-01-31), ``record_id`` names the finding aid."""
    arch, title, made, ident = (_quoted(x) for x in (archive, collection, created, record_id))
    head = (
        f'{DECLARATION}<ead xmlns="{EAD_NS}" xmlns:xsi="{XSI}" xsi:schemaLocation="{EAD_NS} {EAD_XSD}"><control><recordid instanceurl="urn:archive:findbuch:{ident}">findbuch_{ident}</recordid>'
        f"<filedesc><titlestmt><titleproper>Findbuch: {title}</titleproper><author>{arch} (Elektronisch generiert)</author></titlestmt><publicationstmt><publisher>{arch}</publisher><date>{made}</date></publicationstmt></filedesc>"
        f'<maintenancestatus value="derived"></maintenancestatus><maintenanceagency><agencyname>{arch}</agencyname></maintenanceagency></control><archdesc level="collection"><did><unitid>BESTAND-{ident[:8]}</unitid><unittitle>{title}</unittitle>'
        f"<unitdate>{made}</unitdate><repository><corpname>{arch}</corpname></repository></did><scopecontent><p>Verzeichnis von {items.count()} digital erschlossenen Bilddokumenten und Master-Scans.</p></scopecontent>"
        '<dsc dsctype="combined">'
    )
    return _around(items.select(*ITEM_COLUMNS), _ead_text(), [F.col("no")], head, "</dsc></archdesc></ead>")


def lido_document(items: DataFrame, archive: str, rights: str = RIGHTS) -> DataFrame:
    """SNK-3: (place, line) of a lidoWrap around lido_records()."""
    return _around(items.select(*ITEM_COLUMNS), _lido_xml(archive, rights), [F.col("no")], f'{DECLARATION}<lido:lidoWrap xmlns:lido="{LIDO_NS}" xmlns:xsi="{XSI}" xsi:schemaLocation="{LIDO_NS} {LIDO_XSD}">', "</lido:lidoWrap>")


def premis_document(items: DataFrame, archive: str, agent: str = "archive-fixity-daemon") -> DataFrame:
    """SNK-4: (place, line) of a PREMIS document around premis_records(), which ends with the agent that checked."""
    p = "premis:"
    head = f'{DECLARATION}<premis:premis xmlns:premis="{PREMIS_NS}" xmlns:xsi="{XSI}" xsi:schemaLocation="{PREMIS_NS} {PREMIS_XSD}" version="3.0">'
    who = f"<{p}agent><{p}agentIdentifier><{p}agentIdentifierType>local-id</{p}agentIdentifierType><{p}agentIdentifierValue>{_quoted(agent)}</{p}agentIdentifierValue></{p}agentIdentifier>"
    who += f"<{p}agentName>{_quoted(archive)} - {AGENT_NAME}</{p}agentName><{p}agentType>software</{p}agentType><{p}agentNote>{AGENT_NOTE}</{p}agentNote></{p}agent>"
    # records of one path go on with the digest, those without one come last
    digest = F.concat(_text(F.col("sha256")), F.lit("<"))
    return _around(items.select(*CHECK_COLUMNS), _premis_xml(agent), [F.col("file_path"), digest.isNull(), digest], head, f"{who}</premis:premis>")


def write_document(lines: DataFrame, path: str) -> None:
    """Write (place, line) as text files: read in order of their names they are one document. Each task writes a range of places."""
    lines.repartitionByRange("place").sortWithinPartitions("place").select("line").write.text(path)


def write_ead(structures: DataFrame, path: str) -> None:
    """SNK-2: Spark's XML writer; each part is a dsc of c01 elements."""
    structures.write.format("xml").option("rowTag", "c01").option("rootTag", 'dsc dsctype="combined"').option("declaration", "version='1.0' encoding='UTF-8'").save(path)


def _el(tag: str, content: Column | None, attrs: str = "") -> Column:
    """An element with escaped text; nothing where the text is null."""
    open_tag = f"<{tag}{' ' + attrs if attrs else ''}>"
    return F.coalesce(F.concat(F.lit(open_tag), content, F.lit(f"</{tag}>")), F.lit(""))


def _text(c: Column) -> Column:
    return xml_escape(filled(c))


def lido_records(items: DataFrame, archive: str, rights: str = RIGHTS) -> DataFrame:
    """SNK-3: (no, xml): one lido:lido element per numbered item, with the rights of the collection."""
    return items.select("no", _lido_xml(archive, rights).alias("xml"))


def _lido_xml(archive: str, rights: str) -> Column:
    n = "lido:"
    actor = lambda name: _el(n + "actor", _el(n + "nameActorSet", _el(n + "appellationValue", name)))
    rec = F.coalesce(filled(F.col("signature")), filled(F.col("file_name")), F.format_string("obj_%04d", "no"))
    arch = _quoted(archive)
    given = filled(F.col("creator")).isNotNull()
    creator = F.when(given, _el(n + "eventActor", _el(n + "actorInRole", F.concat(actor(_text(F.col("creator"))), _el(n + "roleActor", _el(n + "term", F.lit(CREATOR_ROLE)))))))
    date = F.when(filled(F.col("date")).isNotNull(), _el(n + "eventDate", _el(n + "displayDate", _text(F.col("date")))))
    event = F.concat(_el(n + "eventType", _el(n + "term", F.lit(EVENT_TYPE))), F.coalesce(creator, F.lit("")), F.coalesce(date, F.lit("")))
    sets = F.array_join(F.transform("persons", lambda p: _el(n + "subjectSet", _el(n + "subject", _el(n + "subjectActor", actor(xml_escape(p)))))), "")
    subjects = F.coalesce(F.when(F.size("persons") > 0, _el(n + "objectRelationWrap", _el(n + "subjectWrap", sets))), F.lit(""))
    work = F.coalesce(F.when(filled(F.col("signature")).isNotNull(), _el(n + "workID", _text(F.col("signature")), f'lido:type="{SIGNATURE_LABEL}"')), F.lit(""))
    state = F.coalesce(F.when(filled(F.col("notes")).isNotNull(), _el(n + "displayStateEditionWrap", _el(n + "displayState", _text(F.col("notes"))))), F.lit(""))
    place = _el(n + "repositoryWrap", _el(n + "repositorySet", F.concat(_el(n + "repositoryName", _el(n + "legalBodyName", _el(n + "appellationValue", F.lit(arch)))), work)))
    title = _el(n + "titleWrap", _el(n + "titleSet", _el(n + "appellationValue", xml_escape(title_of(UNTITLED)))))
    kind = _el(n + "objectClassificationWrap", _el(n + "objectWorkTypeWrap", _el(n + "objectWorkType", _el(n + "term", F.lit(WORK_TYPE)))))
    described = _el(n + "descriptiveMetadata", F.concat(kind, _el(n + "objectIdentificationWrap", F.concat(title, place, state)), _el(n + "eventWrap", _el(n + "eventSet", _el(n + "event", event))), subjects), 'xml:lang="de"')
    rights = _el(n + "rightsWorkWrap", _el(n + "rightsSet", _el(n + "rightsType", _el(n + "term", xml_escape(F.lit(rights))))))
    link = xml_escape(F.coalesce(filled(F.col("file_path")), filled(F.col("file_name")), F.lit("")))
    resource = _el(n + "resourceWrap", _el(n + "resourceSet", _el(n + "resourceRepresentation", _el(n + "linkResource", link), f'lido:type="{RESOURCE_TYPE}"')))
    admin = _el(n + "administrativeMetadata", F.concat(rights, resource), 'xml:lang="de"')
    return _el(n + "lido", F.concat(_el(n + "lidoRecID", xml_escape(rec), f'lido:source="{arch}" lido:type="local"'), described, admin))


def mime_type(name: Column) -> Column:
    ext = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    out = F.when(F.lit(False), F.lit(""))
    for e, m in MIME_TYPES.items():
        out = out.when(ext == e, m)
    return out.otherwise("image/jpeg")


def fixity_note(status: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for s, note in FIXITY_NOTES.items():
        out = out.when(status == s, note)
    return out.otherwise(F.concat(F.lit("Status: "), status))


def premis_records(items: DataFrame, agent: str = "archive-fixity-daemon") -> DataFrame:
    """SNK-4: (file_path, xml): an object and its fixity check event; the event's id comes from path and time, so reruns agree."""
    return items.select("file_path", _premis_xml(agent).alias("xml"))


def _premis_xml(agent: str) -> Column:
    p = "premis:"
    name = F.coalesce(filled(F.col("file_name")), base_name(F.col("file_path")))
    status = F.coalesce(filled(F.col("fixity_status")), F.lit("OK"))
    when = F.date_format("last_fixity_check", "yyyy-MM-dd'T'HH:mm:ss")
    path = xml_escape(F.coalesce("file_path", F.lit("")))
    ident = _el(p + "objectIdentifier", F.concat(_el(p + "objectIdentifierType", F.lit("local-filepath")), _el(p + "objectIdentifierValue", path)))
    digest = F.coalesce(F.when(filled(F.col("sha256")).isNotNull(), _el(p + "fixity", F.concat(_el(p + "messageDigestAlgorithm", F.lit("SHA-256")), _el(p + "messageDigest", _text(F.col("sha256"))), _el(p + "messageDigestOriginator", F.lit(DIGEST_ORIGINATOR))))), F.lit(""))
    size = F.coalesce(F.when(F.col("file_size") > 0, _el(p + "size", F.col("file_size").cast("string"))), F.lit(""))
    form = _el(p + "format", _el(p + "formatDesignation", _el(p + "formatName", mime_type(name))))
    chars = _el(p + "objectCharacteristics", F.concat(_el(p + "compositionLevel", F.lit("0")), digest, size, form))
    place = _el(p + "storage", _el(p + "contentLocation", F.concat(_el(p + "contentLocationType", F.lit("filepath")), _el(p + "contentLocationValue", path))))
    obj = _el(p + "object", F.concat(ident, chars, _el(p + "originalName", xml_escape(name)), place), 'xsi:type="premis:file"')
    event_id = F.concat(F.lit("urn:uuid:"), uuid5(F.concat_ws("|", "file_path", when)))
    detail = F.concat(F.lit(CHECK_DETAIL[0]), name, F.lit(CHECK_DETAIL[1]))
    outcome = _el(p + "eventOutcomeInformation", F.concat(_el(p + "eventOutcome", xml_escape(status)), _el(p + "eventOutcomeDetail", _el(p + "eventOutcomeDetailNote", xml_escape(fixity_note(status))))))
    link = F.concat(
        _el(p + "linkingObjectIdentifier", F.concat(_el(p + "linkingObjectIdentifierType", F.lit("local-filepath")), _el(p + "linkingObjectIdentifierValue", path))),
        _el(p + "linkingAgentIdentifier", F.concat(_el(p + "linkingAgentIdentifierType", F.lit("local-id")), _el(p + "linkingAgentIdentifierValue", xml_escape(F.lit(agent))))))
    event = _el(p + "event", F.concat(
        _el(p + "eventIdentifier", F.concat(_el(p + "eventIdentifierType", F.lit("UUID")), _el(p + "eventIdentifierValue", event_id))),
        _el(p + "eventType", F.lit("fixity check")), _el(p + "eventDateTime", when), _el(p + "eventDetailInformation", xml_escape(detail)), outcome, link))
    return F.concat(obj, event)


def _six(x: Column) -> Column:
    """A number with six decimals as printf gives it; printf itself, which is slow, writes only what is no decimal number, or -0."""
    x = x.cast("double")
    return F.coalesce(F.when((x >= 5e-7) | (x <= -5e-7) | (x.cast("string") == "0.0"), x.try_cast("decimal(38,6)").cast("string")), F.format_string("%.6f", x))


def xmp_records(items: DataFrame) -> DataFrame:
    """SNK-5: (file_path, xml) with subjects = distinct persons, region names, keywords and iconclass, in this order; empty fields are left out.

    ``items`` has title, creator, date, persons, keywords, iconclass, regions (array of name and region as PRJ-8 makes it).
    """
    none = F.array().cast("array<string>")
    names = F.filter(F.transform(F.coalesce("regions", F.array().cast(items.schema["regions"].dataType)), lambda r: filled(r["name"])), lambda s: s.isNotNull())
    clean = lambda c: F.filter(F.transform(F.coalesce(c, none), filled), lambda s: s.isNotNull())
    icon = F.when(filled(F.col("iconclass")).isNotNull(), F.array(F.concat(F.lit("Iconclass: "), "iconclass"))).otherwise(none)
    # lists that are used several times are made once
    items = items.withColumn("__persons", F.array_distinct(F.concat(clean(F.col("persons")), names)))
    items = items.withColumn("__subjects", F.array_distinct(F.concat("__persons", clean(F.col("keywords")), icon)))
    persons, subjects = F.col("__persons"), F.col("__subjects")
    bag = lambda tag, xs: F.coalesce(F.when(F.size(xs) > 0, _el(tag, _el("rdf:Bag", F.array_join(F.transform(xs, lambda s: _el("rdf:li", xml_escape(s))), "")))), F.lit(""))
    area = lambda r: F.concat(F.lit("<mwg-rs:Area"), *(F.concat(F.lit(f' stArea:{k}="'), _six(r[k]), F.lit('"')) for k in "xywh"), F.lit(' stArea:unit="normalized"/>'))
    regions = F.filter(F.coalesce("regions", F.array().cast(items.schema["regions"].dataType)), lambda r: r["region"].isNotNull())
    faces = F.array_join(F.transform(regions, lambda r: _el("rdf:li", _el("rdf:Description", F.concat(area(r["region"]), _el("mwg-rs:Name", _text(r["name"])), F.lit("<mwg-rs:Type>Face</mwg-rs:Type>"))))), "")
    region_list = F.coalesce(F.when(F.size(regions) > 0, _el("mwg-rs:Regions", _el("mwg-rs:RegionList", _el("rdf:Bag", faces)))), F.lit(""))
    body = F.concat(_el("dc:title", _text(F.col("title"))), _el("dc:creator", _text(F.col("creator"))), _el("photoshop:DateCreated", _text(F.col("date"))), bag("dc:subject", subjects), bag("Iptc4xmpExt:PersonInImage", persons), region_list)
    return items.select("file_path", subjects.alias("subjects"), _el("rdf:Description", body).alias("xml"))


def export_names(items: DataFrame, stem: str, position: str) -> DataFrame:
    """SNK-6: stem.xmp, and stem_1.xmp, stem_2.xmp, ... for later items of one stem, without the numbers that make another stem's own name.

    So every name occurs once. The k-th later item takes k plus the numbers that are taken before; these come from a running count over both.
    """
    place = F.row_number().over(Window.partitionBy(stem).orderBy(position)) - 1
    named = items.withColumn("__k", place.cast("long"))
    own = named.where("__k = 0").select(F.col(stem).alias("__stem"))
    number = r"^(.*)_([1-9][0-9]{0,8})$"
    taken = own.where(F.col("__stem").rlike(number)).select(F.regexp_extract("__stem", number, 1).alias("__stem"), F.regexp_extract("__stem", number, 2).cast("long").alias("__k"))
    free_before = F.col("__k") - F.row_number().over(Window.partitionBy("__stem").orderBy("__k"))
    taken = taken.select("__stem", free_before.alias("__k"), F.lit(1).alias("__taken"))
    later = named.where("__k > 0").select(F.col(stem).alias("__stem"), "__k", F.lit(0).alias("__taken"))
    passed = F.sum("__taken").over(Window.partitionBy("__stem").orderBy("__k", "__taken").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    numbers = later.unionByName(taken).withColumn("__number", F.col("__k") + passed).where("__taken = 0").select("__stem", "__k", "__number")
    out = named.join(numbers, (F.col(stem) == F.col("__stem")) & (named["__k"] == numbers["__k"]), "left")
    name = F.when(F.col("__number").isNull(), F.concat(stem, F.lit(".xmp"))).otherwise(F.concat(stem, F.lit("_"), F.col("__number").cast("string"), F.lit(".xmp")))
    return out.select(*(named[c] for c in items.columns), name.alias("export_name"))
