"""Controlled vocabulary: expansion of queries, suggestions and authority search.

A vocabulary is (position, canonical, category, synonyms); it is small by nature (terms that people curate), so it is
broadcast by Spark's own size rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from lumenarc.operators.joins import best_by


def term_index(vocabulary: DataFrame) -> DataFrame:
    """(term, canonical, position, first_seen): each lower-case term once. Canonical beats synonym; among synonyms the last entry wins."""
    canonical = vocabulary.select(F.lower(F.trim("canonical")).alias("term"), "canonical", "position", F.lit(0).alias("kind"), F.lit(0).alias("place"))
    synonym = vocabulary.select("canonical", "position", F.posexplode("synonyms").alias("place", "synonym"))
    synonym = synonym.select(F.lower(F.trim("synonym")).alias("term"), "canonical", "position", F.lit(1).alias("kind"), (F.col("place") + 1).alias("place"))
    every = canonical.unionByName(synonym)
    order = F.struct(F.col("kind"), F.when(F.col("kind") == 0, F.col("position")).otherwise(-F.col("position")))
    return every.groupBy("term").agg(F.min_by("canonical", order).alias("canonical"), F.min_by("position", order).alias("position"), F.min(F.struct("position", "place")).alias("first_seen"))


def expand_terms(queries: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """JN-13: (query, canonical, matched_term, tier) of (query): the whole query, else its first word of three letters or more that is a term, else a term of four or more that holds or is held."""
    index = term_index(vocabulary)
    q = queries.select("query", F.lower(F.trim("query")).alias("q")).where("q <> ''").distinct()
    exact = q.join(index, F.col("q") == F.col("term")).select("query", "canonical", "term", F.lit(1).alias("tier"), F.lit(0).cast("long").alias("place"), F.lit(0).alias("place2"))
    words = q.select("query", F.posexplode(F.split("q", r"(?U)[^\w]+")).alias("at", "word")).where(F.length("word") >= 3)
    by_word = words.join(index, F.col("word") == F.col("term")).select("query", "canonical", "term", F.lit(2).alias("tier"), F.col("at").cast("long").alias("place"), F.lit(0).alias("place2"))
    known = exact.select("query").union(by_word.select("query")).distinct()
    rest = q.join(known, "query", "left_anti")
    longer = index.where(F.length("term") >= 4)
    # equi joins on letters that a match must share: the query holds the term's first four, or the term holds the query's first four (or all)
    grams = lambda c, n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - n + 1)), lambda k: F.substr(F.col(c), k, F.lit(n)))
    held = rest.withColumn("gram", F.explode(F.array_distinct(grams("q", 4)))).join(longer.withColumn("gram", F.substring("term", 1, 4)), "gram").where(F.contains(F.col("q"), F.col("term")))
    every = F.array_distinct(F.concat(*(grams("term", n) for n in (1, 2, 3, 4))))
    holds = rest.withColumn("gram", F.substring("q", 1, 4)).join(longer.withColumn("gram", F.explode(every)), "gram").where(F.contains(F.col("term"), F.col("q")))
    part = held.unionByName(holds).select("query", "canonical", "term", F.lit(3).alias("tier"), F.col("first_seen.position").cast("long").alias("place"), F.col("first_seen.place").alias("place2")).distinct()
    rank = F.row_number().over(Window.partitionBy("query").orderBy("tier", "place", "place2", "term"))
    best = exact.unionByName(by_word).unionByName(part).withColumn("r", rank).where("r = 1")
    return best.select("query", "canonical", F.col("term").alias("matched_term"), "tier")


def expansion_terms(canonical: Column, synonyms: Column) -> Column:
    """SET-3: sorted distinct canonical form and synonyms."""
    return F.array_sort(F.array_distinct(F.concat(F.array(canonical), F.coalesce(synonyms, F.array().cast("array<string>")))))


def expansion_of(query: str, vocabulary: DataFrame) -> list[str]:
    """JN-13 and SET-3 for one query: the terms of the entry that it names, in order; none if there is no such entry."""
    asked = vocabulary.select(F.lit(query).alias("query")).limit(1)
    found = expand_terms(asked, vocabulary).select("canonical").join(vocabulary, "canonical").select(expansion_terms(F.col("canonical"), F.col("synonyms")).alias("terms")).orderBy("terms").first()
    return list(found.terms) if found else []


def autocomplete(vocabulary: DataFrame, prefix: str, limit: int = 8) -> DataFrame:
    """TOP-8: terms by prefix of two letters or more: canonical ones in vocabulary order, then the first matching synonym of the other entries."""
    p = prefix.strip().lower()
    if len(p) < 2:
        return vocabulary.select(F.col("canonical").alias("term"), "canonical", F.lit(False).alias("is_synonym")).limit(0)
    starts = F.lower("canonical").startswith(p)
    first = F.get(F.filter("synonyms", lambda s: F.lower(s).startswith(p)), F.lit(0))
    term = F.when(starts, F.col("canonical")).otherwise(first)
    found = vocabulary.select(term.alias("term"), "canonical", (~starts).alias("is_synonym"), "position").where("term is not null")
    return found.orderBy("is_synonym", "position").limit(limit).select("term", "canonical", "is_synonym")


def authority_search(table: DataFrame, query: str, columns: tuple[str, ...], name: str, category: tuple[str, str] | None = None, limit: int = 50) -> DataFrame:
    """TOP-9: the query in any column, optionally of one category; rows whose name holds it first, then by name."""
    from lumenarc.operators.filters import contains

    hit = F.lit(False)
    for c in columns:
        hit = hit | contains(F.col(c), query)
    df = table.where(hit)
    if category:
        df = df.where(F.col(category[0]) == category[1])
    return df.orderBy(F.when(contains(F.col(name), query), 0).otherwise(1), name, "id").limit(limit)


def authority_lookup(table: DataFrame, asked: DataFrame, columns: tuple[str, ...] = ("id", "canonical", "gnd", "iconclass")) -> DataFrame:
    """TOP-9: for each ``identifier`` of ``asked`` the record that has it in one of ``columns``: the earlier column wins, then the less id; identifiers without a record are missing."""
    named = F.array_distinct(F.filter(F.array(*(F.struct(F.col(c).cast("string").alias("identifier"), F.lit(k).alias("rank")) for k, c in enumerate(columns))), lambda x: x["identifier"].isNotNull()))
    index = table.select(F.explode(named).alias("__n"), "*").select("__n.identifier", "__n.rank", *table.columns)
    # tasks pass on one record of an identifier before the shuffle, so that one that many records share is no task's
    best = best_by(index, ["identifier"], [F.col("rank"), F.col("id")]).drop("rank")
    return asked.select("identifier").distinct().join(best, "identifier")


def categories(vocabulary: DataFrame) -> DataFrame:
    """AGG-12: sorted distinct categories."""
    return vocabulary.select("category").distinct().orderBy("category")


def terms(vocabulary: DataFrame, category: str) -> DataFrame:
    """AGG-12: the terms of a category, without case, in vocabulary order."""
    return vocabulary.where(F.lower("category") == category.strip().lower()).orderBy("position")
