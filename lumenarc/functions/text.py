"""Text columns: years, lists, clean-up and precedence of descriptive fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

YEAR = r"(?<!\d)(1[5-9]\d\d|20\d\d)(?!\d)"

# fixed values: spans of years, both ends inclusive; they overlap
EPOCHS = (("kaiserreich", 1860, 1914), ("weimar", 1914, 1939), ("nachkrieg", 1939, 1965), ("konzil", 1965, 1990), ("modern", 1990, 2030))

# fixed values: corrections of misread words, (pattern, correction); matched without case, corrected in the case given
OCR_TERMS = (
    (r"\bPriefter\b", "Priester"), (r"\bpriefterlich", "priesterlich"), (r"\bBifchof\b", "Bischof"), (r"\bbifchöflich", "bischöflich"),
    (r"\bErzbifchof\b", "Erzbischof"), (r"\bMeffgewand\b", "Messgewand"), (r"\bMeffe\b", "Messe"), (r"\bKlofter\b", "Kloster"),
    (r"\bklofter", "kloster"), (r"\bChorgeftühl\b", "Chorgestühl"), (r"\bSakriftei\b", "Sakristei"), (r"\bChrifto\b", "Christo"),
    (r"\bChriftus\b", "Christus"), (r"\bchriftlich", "christlich"), (r"\bMonftranz\b", "Monstranz"), (r"\bKruzifir\b", "Kruzifix"),
    (r"\bInftitut\b", "Institut"), (r"\bApoftel\b", "Apostel"), (r"\bfeftlich", "festlich"), (r"\bFeft\b", "Fest"),
    (r"\bEucharift", "Eucharist"), (r"\bMifsa\b", "Missa"),
)
# fixed values: letters of old print
OLD_LETTERS = (("ſ", "s"), ("æ", "ae"), ("Æ", "Ae"), ("œ", "oe"), ("Œ", "Oe"))


def filled(c: Column) -> Column:
    """Trimmed text, null where it is empty."""
    return F.nullif(F.trim(c), F.lit(""))


def first_filled(*columns: Column) -> Column:
    """PRJ-1: the first non-empty value, by precedence."""
    return F.coalesce(*(filled(c) for c in columns))


def consolidate(fields: dict[str, Sequence[Column]]) -> list[Column]:
    """PRJ-1: one column per field from its candidates, sidecar values first, then header tags."""
    return [first_filled(*candidates).alias(name) for name, candidates in fields.items()]


def normalise_keywords(text: Column) -> Column:
    """PRJ-2: comma text to a sorted list of distinct trimmed words."""
    words = F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda w: F.trim(w))
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: w != "")))


def merge_keywords(existing: Column, new: Column, carrier: Column | None = None) -> Column:
    """SET-2: the existing keywords, then new ones, then the carrier: each once, in this order; null lists and a null carrier add nothing."""
    none = F.array().cast("array<string>")
    parts = [F.coalesce(existing, none), F.coalesce(new, none)]
    if carrier is not None:
        parts.append(F.when(filled(carrier).isNotNull(), F.array(carrier)).otherwise(none))
    return F.array_distinct(F.filter(F.concat(*parts), lambda k: k.isNotNull()))


def decode_list(text: Column) -> Column:
    """PRJ-3: a JSON array, else comma text; nothing becomes an empty list."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda w: F.trim(w)), lambda w: w != "")
    as_json = F.from_json(F.when(F.trim(text).startswith("["), text), "array<string>")
    return F.coalesce(as_json, parts)


def year_in(text: Column) -> Column:
    return F.regexp_extract(F.coalesce(text, F.lit("")), YEAR, 1).try_cast("int")


def year_of_item(date: Column, path: Column) -> Column:
    """PRJ-4: a year of 1500-2099 in the date, else in the last part of the path that has one."""
    years = F.transform(F.reverse(F.split(F.coalesce(path, F.lit("")), "/")), year_in)
    return F.coalesce(year_in(date), F.get(F.filter(years, lambda y: y.isNotNull()), F.lit(0)))


def facet_year(date: Column, path: Column) -> Column:
    """PRJ-5: as year_of_item, but the leftmost year of the whole path."""
    return F.coalesce(year_in(date), year_in(path))


def clean_ocr_text(text: Column) -> Column:
    """PRJ-10: letters of old print, misread words, single blanks, trimmed lines, no empty lines."""
    out = F.coalesce(text, F.lit(""))
    for old, new in OLD_LETTERS:
        out = F.replace(out, F.lit(old), F.lit(new))
    # a pattern is tried only where its letters are in the text without case; no correction makes another misread word, so one look is enough
    terms = F.array(*(F.struct(F.lit(bare_term(p)).alias("word"), F.lit(f"(?iU){p}").alias("pattern"), F.lit(right).alias("right")) for p, right in OCR_TERMS))
    folded = lambda t: F.lower(F.replace(F.replace(t, F.lit("İ"), F.lit("i")), F.lit("ı"), F.lit("i")))
    both = F.transform(F.array(out), lambda t: F.struct(t.alias("text"), folded(t).alias("folded")))
    corrected = lambda b: F.aggregate(F.filter(terms, lambda t: F.contains(b["folded"], t["word"])), b["text"], lambda done, t: F.regexp_replace(done, t["pattern"], t["right"]))
    out = F.get(F.transform(both, corrected), F.lit(0))
    lines = F.transform(F.split(out, r"\r\n|\n|\r"), lambda x: F.trim(F.regexp_replace(x, r"[ \t]{2,}|\t", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def bare_term(pattern: str) -> str:
    """The letters of a pattern of ``OCR_TERMS``, in lower case."""
    return pattern.replace(r"\b", "").lower()


def word_count(text: Column) -> Column:
    """PRJ-11: words between white space."""
    return F.size(F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != ""))


def ocr_accepted(text: Column) -> Column:
    """PRJ-11: three words or fifteen characters are enough."""
    return (word_count(text) >= 3) | (F.length(text) >= 15)


def curation_default(status: Column, label: Column) -> Column:
    """PRJ-12: the status, else VERIFIED where there is a label, else KI_AUTO."""
    return F.coalesce(filled(status), F.when(filled(label).isNotNull(), F.lit("VERIFIED")).otherwise(F.lit("KI_AUTO")))


def matched_query(query: Column, fields: dict[str, Column], cut: dict[str, int], other: Column) -> Column:
    """PRJ-19: the first field that contains the query (without case), as "name: value", long values cut; else ``other``."""
    out = None
    for name, value in fields.items():
        shown = F.substring(value, 1, cut[name]) if name in cut else value
        text = F.concat(F.lit(f"{name}: "), shown)
        hit = F.contains(F.lower(value), F.lower(query))
        out = F.when(hit, text) if out is None else out.when(hit, text)
    return out.otherwise(other)


def xml_escape(c: Column) -> Column:
    """Escapes for XML text and attributes; characters that XML 1.0 forbids are dropped."""
    c = F.regexp_replace(c.cast("string"), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def csv_field(c: Column, delimiter: str = ";") -> Column:
    """A CSV field, quoted where it holds the delimiter, a quote or a line end."""
    c = F.coalesce(c.cast("string"), F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(c.rlike(f'[{delimiter}"\r\n]'), quoted).otherwise(c)
