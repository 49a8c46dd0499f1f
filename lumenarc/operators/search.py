"""Ranked search over persons, descriptions and vectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenarc.functions.text import filled
from lumenarc.functions.vectors import blend_vector, classify_variant, cosine, doubles, hamming64
from lumenarc.operators.filters import contains
from lumenarc.operators.graph import checkpointed
from lumenarc.operators.joins import pixels
from lumenarc.operators.similarity import cluster_vectors, stack_results, vector_topk, vector_topk_batch
from lumenarc.operators.windows import Desc, page, row_numbers

# fixed values: scores of the kinds of hits
EXACT, PART, WORD = 1.0, 0.98, 0.95
DIRECT, EXPANDED = 0.90, 0.88


def person_score(label: Column, query: str) -> Column:
    """Exact name 1.0; one holds the other 0.98; a word of the query (two letters or more) is or is part of the name 0.95; else null."""
    q = query.strip().lower()
    name = F.lower(F.trim(label))
    words = [w for w in "".join(c if c.isalnum() or c == "_" else " " for c in q).split() if len(w) >= 2]
    some = reduce(lambda a, b: a | b, (F.contains(name, F.lit(w)) for w in words), F.lit(False))
    return F.when(name == q, EXACT).when(F.contains(name, F.lit(q)) | F.contains(F.lit(q), name), PART).when(some, WORD)


def person_hits(faces: DataFrame, query: str) -> DataFrame:
    """WIN-4: per image the best score and all matching labels."""
    hits = faces.where(filled(F.col("label")).isNotNull()).withColumn("score", person_score(F.col("label"), query)).where("score is not null")
    return hits.groupBy("file_path").agg(F.max("score").alias("score"), F.array_sort(F.collect_set("label")).alias("persons"))


def metadata_hits(table: DataFrame, query: str, expansion: list[str], columns: tuple[str, ...], per_term: int = 40) -> DataFrame:
    """WIN-6: hits of the query, then of at most five expansion terms in order, at most ``per_term`` rows each; one row per path, first term wins."""
    text = F.lower(F.concat_ws("\x01", *columns))
    terms = [query, *[t for t in sorted(expansion) if t.lower() != query.lower()][:5]]
    found = None
    for rank, term in enumerate(terms):
        rows = table.where(F.contains(text, F.lit(term.lower()))).select("file_path", F.lit(rank).alias("term_rank"), F.lit(term).alias("matched_query")).orderBy("file_path").limit(per_term)
        found = rows if found is None else found.unionByName(rows)
    first = found.withColumn("r", F.row_number().over(Window.partitionBy("file_path").orderBy("term_rank"))).where("r = 1")
    return first.select("file_path", F.when(F.col("term_rank") == 0, DIRECT).otherwise(EXPANDED).alias("score"), "matched_query")


def vector_hits(table: DataFrame, query: list[float], threshold: float, fetch: int) -> DataFrame:
    q = F.array(*(F.lit(float(x)) for x in query))
    scored = table.select("file_path", F.round(cosine(doubles(F.col("vector")), q), 6).alias("score"))
    return scored.where(F.col("score") >= threshold).orderBy(F.desc("score"), F.desc("file_path")).limit(fetch)


def fuse_hits(persons: DataFrame, metadata: DataFrame, vectors: DataFrame) -> DataFrame:
    """SET-1: one row per path: kind person before metadata before clip, the greatest score, persons united."""
    none = F.array().cast("array<string>")
    leg = lambda df, rank, kind, who: df.select("file_path", F.col("score").cast("double").alias("score"), F.lit(rank).alias("rank"), F.lit(kind).alias("match_type"), who.alias("persons"))
    every = leg(persons, 0, "person", F.col("persons")).unionByName(leg(metadata, 1, "metadata", none)).unionByName(leg(vectors, 2, "clip", none))
    return every.groupBy("file_path").agg(F.max("score").alias("score"), F.min_by("match_type", "rank").alias("match_type"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("persons")))).alias("persons"))


def cluster_hits(faces: DataFrame, clusters: DataFrame, query: str, exact: bool) -> DataFrame:
    """FLT-4 as a leg of a search: images with a face of a named cluster (id, name, notes) whose name or notes hold the query."""
    found = clusters.where(contains(F.col("name"), query) | contains(F.col("notes"), query)).select(F.col("id").alias("cluster_id"), filled(F.col("name")).alias("name")).where("name is not null")
    return faces.join(found, "cluster_id").groupBy("file_path").agg(F.lit(EXACT if exact else PART).alias("score"), F.array_sort(F.collect_set("name")).alias("persons"))


def recto_hits(metadata: DataFrame, pairs: DataFrame, persons: DataFrame) -> DataFrame:
    """JN-6 as a leg of a search: rectos (``pairs``: recto_path, verso_path) of versos that a text hit, a hundredth below them, unless they are hits themselves."""
    moved = metadata.join(pairs.select(F.col("verso_path").alias("file_path"), "recto_path").where("recto_path is not null"), "file_path")
    best = moved.groupBy(F.col("recto_path").alias("file_path")).agg(F.round(F.max("score") - 0.01, 2).alias("score"))
    return best.join(metadata.select("file_path"), "file_path", "left_anti").join(persons.select("file_path"), "file_path", "left_anti")


def stacked(hits: DataFrame, images: DataFrame, threshold: float) -> DataFrame:
    """STK-1 over all fused hits, by score, then path: one row per stack with ``stack_size``. Images without a vector stand alone."""
    numbered = checkpointed(row_numbers(hits, [Desc(F.col("score")), Desc(F.col("file_path"))], "rank"))
    seen = images.where("vector is not null").join(numbered.select("file_path"), "file_path", "left_semi").groupBy("file_path").agg(F.min("vector").alias("vector"))
    rows = numbered.select("file_path", "rank").join(seen, "file_path").select(F.lit(0).cast("long").alias("query_id"), F.col("rank").alias("id"), F.col("rank").cast("int").alias("rank"), "vector")
    placed = stack_results(checkpointed(rows), threshold)
    sizes = placed.groupBy(F.col("stack_of").alias("rank")).agg(F.count("*").alias("stack_size"))
    alone = numbered.join(seen.select("file_path"), "file_path", "left_anti").withColumn("stack_size", F.lit(1).cast("long"))
    return numbered.join(sizes, "rank").unionByName(alone).drop("rank")


def hybrid_search(faces: DataFrame, table: DataFrame, images: DataFrame, query: str, vector: list[float], expansion: list[str] = (), columns: tuple[str, ...] = ("title", "description"),
                  threshold: float = 0.20, offset: int = 0, limit: int = 50, where: Column | None = None, clusters: DataFrame | None = None, pairs: DataFrame | None = None,
                  prompt_vector: list[float] | None = None, stack: float | None = None, vector_fetch: int | None = None) -> DataFrame:
    """SRCH-1: person, cluster, metadata, verso and vector hits fused, stacked and paged, by score, then path, both descending.

    Facets (``where`` over ``table``) apply to every leg; a path that ``table`` lacks is no hit then. A query that equals the name of a face or
    cluster drops vector hits below 0.28. ``clusters`` (id, name, notes) adds the images of clusters that the query finds, ``pairs`` (recto_path,
    verso_path) the rectos of versos with a text hit, ``prompt_vector`` is blended into the query's by a quarter. With ``stack``, hits of that cosine or
    more become one row with a ``stack_size``; stacks are made of all hits. The best ``vector_fetch`` vector hits take part: three times the page's end and 80 at least where it isn't given, so they grow with the page.
    """
    if where is not None:
        allowed = table.where(where).select("file_path")
        faces, images, table = (df.join(allowed, "file_path", "left_semi") for df in (faces, images, table))
    persons = person_hits(faces, query)
    exact = not persons.where(F.col("score") == EXACT).isEmpty()
    if clusters is not None:
        exact = exact or not clusters.where(F.lower(F.trim("name")) == query.strip().lower()).isEmpty()
        persons = persons.unionByName(cluster_hits(faces, clusters, query, exact))
    metadata = metadata_hits(table, query, list(expansion), columns)
    if pairs is not None:
        backs = recto_hits(metadata, pairs, persons)
        if where is not None:
            backs = backs.join(allowed, "file_path", "left_semi")
        metadata = metadata.select("file_path", "score").unionByName(backs)
    if prompt_vector is not None:
        literal = lambda v: F.array(*(F.lit(float(x)) for x in v))
        vector = table.sparkSession.range(1).select(blend_vector(literal(vector), literal(prompt_vector))).first()[0]
    fetch = vector_fetch or max(80, 3 * (offset + limit))
    vectors = vector_hits(images, vector, max(threshold, 0.28) if exact else threshold, fetch)
    fused = fuse_hits(persons, metadata, vectors)
    if stack is not None:
        fused = stacked(fused, images, stack)
    return page(fused, [Desc(F.col("score")), Desc(F.col("file_path"))], offset, limit)


def similar_images(images: DataFrame, query_id, k: int = 12, threshold: float | None = None, stack: float | None = None, where: Column | None = None) -> DataFrame:
    """SRCH-2: the k images (id, score) that are most similar to an image of the table, itself included, by score, then id; with ``stack`` near copies of a better hit
    are one row with a ``stack_size``, and k counts stacks: then all hits from ``threshold`` on (0 where it isn't given) are stacked. No rows where the image or its vector isn't there."""
    asked = images.where((F.col("id") == F.lit(query_id)) & F.col("vector").isNotNull()).select(F.lit(0).cast("long").alias("query_id"), "vector")
    rest = images.where(where) if where is not None else images
    first = asked.first()
    if first is None:
        empty = images.select("id", F.lit(0.0).alias("score")).limit(0)
        return empty.withColumn("stack_size", F.lit(0).cast("long")) if stack is not None else empty
    if stack is None:
        return vector_topk(rest.where("vector is not null"), list(first.vector), k, threshold)
    q = F.array(*(F.lit(float(x)) for x in first.vector))
    scored = rest.where("vector is not null").select(F.col("id").cast("string").alias("file_path"), "id", F.round(cosine(doubles(F.col("vector")), q), 6).alias("score"))
    # equal scores: the less id first, as without stacks
    hits = scored.where(F.col("score") >= (threshold or 0.0))
    numbered = checkpointed(row_numbers(hits, [Desc(F.col("score")), F.col("id")], "rank"))
    rows = numbered.join(images.select("id", "vector"), "id").select(F.lit(0).cast("long").alias("query_id"), F.col("rank").alias("id"), F.col("rank").cast("int").alias("rank"), "vector")
    sizes = stack_results(checkpointed(rows), stack).groupBy(F.col("stack_of").alias("rank")).agg(F.count("*").alias("stack_size"))
    return numbered.join(sizes, "rank").orderBy("rank").limit(k).select("id", "score", "stack_size")


def hybrid_order(hits: DataFrame, limit: int) -> DataFrame:
    """TOP-3: hits (file_path, score) by score, then path, both descending."""
    return page(hits, [Desc(F.col("score")), Desc(F.col("file_path"))], 0, limit)


def find_variants(images: DataFrame, image_id, threshold: float = 0.88, limit: int = 25, shift: float = 0.0) -> DataFrame:
    """VAR-1: images (id, vector, hash, any others) that are similar to one of the table: all its columns but the vector, with score, distance (differing bits of the hashes, null where one has none) and kind (PRJ-14), best first.

    The image itself is left out, other rows with its file aren't told apart from it where ``file_path`` is the same. ``shift`` moves the limits of the kinds.
    """
    asked = images.where((F.col("id") == F.lit(image_id)) & F.col("vector").isNotNull())
    first = asked.first()
    if first is None:
        return images.drop("vector").select("*", F.lit(0.0).alias("score"), F.lit(0).alias("distance"), F.lit("").alias("kind")).limit(0)
    other = F.col("id") != F.lit(image_id)
    if "file_path" in images.columns:
        other = other & ~F.col("file_path").eqNullSafe(F.lit(first["file_path"]))
    found = vector_topk(images.where("vector is not null"), list(first["vector"]), limit, threshold, other)
    told = found.join(images.drop("vector"), "id")
    told = told.withColumn("distance", hamming64(F.col("hash"), F.lit(first["hash"]).cast("string")))
    return told.withColumn("kind", classify_variant(F.col("score"), F.col("distance"), shift)).select(*[c for c in images.columns if c != "vector"], "score", "distance", "kind").orderBy(F.desc("score"), "id")


def variant_groups(images: DataFrame, eps: float = 0.075, min_samples: int = 2, shown: int = 100) -> tuple[DataFrame, DataFrame]:
    """VAR-2: (members, statistics) of the groups of similar images (id, vector, width, height, any others).

    Members of the first ``shown`` groups (numbered by least core image) have group_id, count, place (from 1 by pixels, then id; place 1 is the representative) and the images' columns but the vector. Statistics: total_groups counts all
    groups, showing_groups those shown, total_stacked_images the images in these.
    """
    placed = checkpointed(cluster_vectors(images.where("vector is not null").select("id", "vector"), eps, min_samples).where("cluster >= 0"))
    sizes = placed.groupBy("cluster").agg(F.count("*").alias("count"))
    members = placed.where(F.col("cluster") < shown).join(sizes, "cluster").join(images.drop("vector"), "id")
    place = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc(pixels()), "id"))
    members = members.withColumns({"place": place, "group_id": F.concat(F.lit("group_"), F.col("cluster").cast("string"))})
    stats = sizes.agg(F.count("*").alias("total_groups"), F.count_if(F.col("cluster") < shown).alias("showing_groups"), F.coalesce(F.sum(F.when(F.col("cluster") < shown, F.col("count"))), F.lit(0)).alias("total_stacked_images"))
    return members.select("group_id", "count", "place", *[c for c in images.columns if c != "vector"]), stats


def best_face(faces: DataFrame) -> DataFrame:
    """WIN-7: the face (image_id, face_id) of each image that was detected surest; of equal ones that with the greatest id."""
    return faces.groupBy("image_id").agg(F.max_by("face_id", F.struct("det_score", "face_id")).alias("face_id"))


def search_faces(vectors: DataFrame, queries: DataFrame, faces: DataFrame, k: int, threshold: float | None = None) -> DataFrame:
    """SRCH-3: TOP-2 of images (id, vector) for uploads (query_id, vector), with the best face of each image found (null without faces)."""
    found = vector_topk_batch(vectors, queries, k, threshold)
    return found.join(best_face(faces).withColumnRenamed("image_id", "id"), "id", "left").select("query_id", "id", "score", "rank", "face_id")


def browse(table: DataFrame, year: Column, year_from: int | None, year_to: int | None, signature: str | None, limit: int, offset: int = 0) -> DataFrame:
    """TOP-5: an empty query with facets: by year (unknown last) and name if a range is set, else by name; nothing without a facet."""
    from lumenarc.operators.filters import match_facets

    if year_from is None and year_to is None and not signature:
        return table.limit(0)
    found = match_facets(table, year, year_from, year_to, signature).withColumns({"year": year, "score": F.lit(1.0)})
    order: list = [F.coalesce(F.col("year"), F.lit(9999)), F.lower("file_name"), "file_name"] if year_from is not None or year_to is not None else [F.lower("file_name"), "file_name"]
    return page(found, order, offset, limit)


def zero_shot_tags(scores: DataFrame, k: int, floor: float = 0.20, keep: int = 2) -> DataFrame:
    """TAG-1: of ranked (query_id = image, id = term, score, rank): the best k of 2k candidates, those below the floor only among the first ``keep``; confidence in per cent."""
    kept = scores.where((F.col("rank") <= 2 * k) & ((F.col("score") >= floor) | (F.col("rank") <= keep)) & (F.col("rank") <= k))
    # tenths are rounded as whole numbers: 28.85, which a double holds as 28.849999999999998, is 28.9
    confidence = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("score") - 0.15) / 0.20)) * 100 * 10) / 10
    return kept.withColumn("confidence", confidence)
