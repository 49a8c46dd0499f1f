"""Near-duplicate classes by DartMinHash signatures and a banded join.

A text is the multiset of its windows of five words. Every element owns a region of the plane (weight x rank); hashed
darts fall into it as a Poisson process, the same ones in every text, and each dart belongs to one of ``k`` coordinates.
A text keeps the darts below its weights, and of each coordinate the earliest (least rank). Two texts agree in a
coordinate with the probability of their weighted Jaccard similarity. The work for a text is its number of elements
plus k (ln k + 3) darts, not their product.

Texts that agree in all coordinates of some band are candidates. No bucket is expanded into its pairs: first every text is
compared with one hub, the least by hash among its buckets' members, and links are contracted to classes, which settles
families of copies. In buckets where several classes meet, the texts outside the largest class are dealt into blocks, and each block
is compared with chunks of the bucket inside a task, by intersection of the texts' 64-bit elements. So every candidate pair of different classes is compared and
none is dropped. A bucket of n texts in several classes sends its n rows once for every ``BLOCK`` texts outside the largest class, so families of
copies cost rows in proportion to their texts, and only buckets of many texts that share a band but aren't similar cost more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenarc.llm._store import broadcast_below, cut, join_around_hot, limit_batches
from lumenarc.llm._text import fixed_binary, flat, mix, sequence_digests, slices, span_hashes, windows, words
from lumenarc.operators.graph import connected_components

BROADCAST_ROWS = 250_000
#: Texts of a class from which its totals are broadcast to its rows.
HOT_ROWS = 1_000
#: Minor members in a block and members in a chunk that a task compares at once, and their elements (8 bytes each).
BLOCK, CHUNK = 1024, 2048
BLOCK_ITEMS, CHUNK_ITEMS = 1_000_000, 2_000_000
_U = np.uint64


def dart_signatures(elements: np.ndarray, weights: np.ndarray, sets: np.ndarray, n_sets: int, k: int) -> np.ndarray:
    """The least rank per coordinate, (n_sets, k); infinite for empty sets. ``sets`` is the row of each element.

    Region of an element: weight layers of height 1, the last one cut at the weight. In each layer darts come in
    order of rank, with exponential gaps of mean 1/k; hash(element, layer, number) gives gap, height and coordinate.
    """
    out = np.full((n_sets, k), np.inf)
    use = weights > 0
    elements, weights, sets = elements[use].astype(np.uint64), weights[use].astype(np.float64), sets[use]
    layers = np.ceil(weights).astype(np.int64)
    total = np.bincount(sets, weights, minlength=n_sets)
    owner = np.repeat(np.arange(len(elements)), layers)
    layer = np.arange(len(owner)) - np.repeat(np.cumsum(layers) - layers, layers)
    key = mix(elements[owner] + mix(layer.astype(np.uint64) + _U(1)))
    room, row = weights[owner] - layer, sets[owner]
    reach = (np.log(k) + 3) / np.maximum(total, 1e-300)
    todo = np.flatnonzero(total > 0)
    while len(todo):
        wanted = np.zeros(n_sets, bool)
        wanted[todo] = True
        at = np.flatnonzero(wanted[row])
        h, limit, r, space = key[at], reach[row[at]], np.zeros(len(at)), room[at]
        base = row[at] * k
        number = 0
        while len(h):
            number += 1
            dart = mix(h + _U((number * 0x9E3779B97F4A7C15) & (2**64 - 1)))
            r = r - np.log(((dart >> _U(12)).astype(np.float64) + 1) * 2.0**-52) / k
            near = r <= limit
            if not near.all():
                h, limit, r, space, base, dart = h[near], limit[near], r[near], space[near], base[near], dart[near]
            other = mix(dart)
            height = (other >> _U(12)).astype(np.float64) * 2.0**-52
            hit = height < space
            np.minimum.at(out.reshape(-1), base[hit] + (mix(other) % _U(k)).astype(np.int64)[hit], r[hit])
        todo = todo[np.isinf(out[todo]).any(axis=1)]
        reach[todo] *= 2
    return out


def multiset(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (element, row) with counts."""
    order = np.lexsort((hashes, rows))
    h, r = hashes[order], rows[order]
    first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (r[1:] != r[:-1])]) if len(h) else np.zeros(0, np.int64)
    return h[first], r[first], np.diff(np.r_[first, len(h)])


def shingles(raw: np.ndarray, offs: np.ndarray, width: int):
    """(hashes, rows) of all word windows, and a digest of each word sequence."""
    starts, ends, rows = words(raw, offs)
    h = span_hashes(raw, starts, ends)
    win, _, at = windows(h, rows, len(offs) - 1, width)
    return win, at, sequence_digests(h, rows, len(offs) - 1)


def _sketcher(width: int, bands: int, rows: int):
    k = bands * rows

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, offs in slices(batch, "text"):
                win, at, digest = shingles(raw, offs, width)
                elements, sets, weights = multiset(win, at)
                ranks = dart_signatures(elements, weights, sets, part.num_rows, k)
                bits = ranks.view(np.uint64).reshape(-1, bands, rows)
                band = np.zeros((part.num_rows, bands), np.uint64)
                for j in range(rows):
                    band = mix(band * _U(0xD6E8FEB86659FD93) + bits[:, :, j])
                size = np.bincount(at, minlength=part.num_rows)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (part.num_rows + 1) * bands, bands, dtype=np.int32)), pa.array(band.view(np.int64).reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column(0), fixed_binary(digest), pa.array(size.astype(np.int64)), lists], ["id", "node", "size", "bands"])

    return sketch


def _digester(width: int, text_col: str = "text"):
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, offs in slices(batch, text_col):
                _, _, seen = shingles(raw, offs, width)
                names = [*part.schema.names, "__near_node"]
                yield pa.RecordBatch.from_arrays([*part.columns, fixed_binary(seen)], names)

    return digest


def weighted_jaccard(a: tuple, b: tuple, n: int) -> np.ndarray:
    """Similarity of row i of ``a`` and of ``b``, each (hashes, rows)."""
    ha, ra, ca = multiset(*a)
    hb, rb, cb = multiset(*b)
    h, r, c = np.r_[ha, hb], np.r_[ra, rb], np.r_[ca, cb]
    order = np.lexsort((h, r))
    h, r, c = h[order], r[order], c[order]
    both = np.flatnonzero((h[1:] == h[:-1]) & (r[1:] == r[:-1])) if len(h) else np.zeros(0, np.int64)
    common = np.bincount(r[both], np.minimum(c[both], c[both + 1]), minlength=n)
    total = np.bincount(r, c, minlength=n) - common
    return np.where(total > 0, common / np.maximum(total, 1), 1.0)


def _verifier(width: int, threshold: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, offs in slices(batch, "text_a"):
                raw_b, offs_b = flat(part.column(part.schema.get_field_index("text_b")))
                wa, at, _ = shingles(raw, offs, width)
                wb, bt, _ = shingles(raw_b, offs_b, width)
                near = pa.array(weighted_jaccard((wa, at), (wb, bt), part.num_rows) >= threshold)
                yield pa.RecordBatch.from_arrays([c.filter(near) for c in part.columns[:2]], ["src", "dst"])

    return verify


def _itemiser(width: int):
    def itemise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, offs in slices(batch, "text"):
                win, at, _ = shingles(raw, offs, width)
                h, r, c = multiset(win, at)
                # the k-th occurrence of an element is an element of its own: then sets do for multisets
                owner = np.repeat(np.arange(len(h)), c)
                nth = np.arange(len(owner)) - np.repeat(np.cumsum(c) - c, c)
                item = mix(h[owner] + nth.astype(np.uint64) * _U(0x9E3779B97F4A7C15))
                ends = np.cumsum(np.bincount(r[owner], minlength=part.num_rows))[:-1]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in np.split(item, ends)], pa.binary())], ["node", "items"])

    return itemise


def similar_rows(left: list[np.ndarray], right: list[np.ndarray], threshold: float, hits: int = 4_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j) of item sets left[i] and right[j] with a Jaccard similarity of ``threshold`` or more."""
    items = np.concatenate(left)
    owner = np.repeat(np.arange(len(left)), [len(x) for x in left])
    order = np.argsort(items, kind="stable")
    items, owner = items[order], owner[order]
    size_l, out = np.array([len(x) for x in left]), []
    at = 0
    while at < len(right):
        to, load = at, 0
        while to < len(right) and (to == at or load < hits):
            load += len(right[to]) * len(left)
            to += 1
        asked = np.concatenate(right[at:to])
        who = np.repeat(np.arange(to - at), [len(x) for x in right[at:to]])
        low, high = np.searchsorted(items, asked, "left"), np.searchsorted(items, asked, "right")
        n = high - low
        where = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        common = np.bincount(np.repeat(who, n) * len(left) + owner[where], minlength=(to - at) * len(left)).reshape(to - at, len(left))
        union = np.array([len(x) for x in right[at:to]])[:, None] + size_l[None, :] - common
        j, i = np.nonzero(common >= threshold * union)
        out.append((i, j + at))
        at = to
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


def _matcher(threshold: float):
    def compare(minors: list[tuple], members: list[tuple]) -> Iterator[pa.RecordBatch]:
        if minors and members:
            i, j = similar_rows([m[1] for m in minors], [m[1] for m in members], threshold)
            # classes that links join; a link between classes that are joined already adds nothing
            joined: dict[bytes, bytes] = {}

            def top(root: bytes) -> bytes:
                while root in joined:
                    root = joined[root]
                return root

            found = []
            for a, b in zip(i.tolist(), j.tolist(), strict=True):
                x, y = top(minors[a][0]), top(members[b][0])
                if x != y:
                    joined[max(x, y)] = min(x, y)
                    found.append((max(x, y), min(x, y)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)], ["src", "dst"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, minors, members = None, [], []
        for batch in batches:
            c = {n: batch.column(k).to_pylist() for k, n in enumerate(batch.schema.names)}
            for now, minor, member, root, items in zip(zip(c["bucket"], c["block"], c["chunk"], strict=True), c["minor"], c["member"], c["root"], c["items"], strict=True):
                if now != key:
                    yield from compare(minors, members)
                    key, minors, members = now, [], []
                row = (root, np.frombuffer(items, np.uint64))
                if minor:
                    minors.append(row)
                if member:
                    members.append(row)
        yield from compare(minors, members)

    return match


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, width: int = 5,
                           bands: int = 32, rows: int = 6) -> DataFrame:
    """One row per document: (id, class_id, class_size, node, root).

    A class is a connected component of texts with a weighted Jaccard similarity of ``threshold`` or more over windows
    of ``width`` words ([^\\x20\\x09-\\x0D]+). class_id is its smallest document id (null if all are null), class_size
    its documents. Texts with equal word sequences are one node; a text of fewer than ``width`` words has one window, and
    texts without words (null, empty, blank) are one class. Repeated ids are separate rows. With 32 bands of 6 coordinates a pair at 0.8
    is missed with probability 6e-5, one at 0.9 with 1e-11. Ids may be of any type that has an order; an empty table gives an empty one; other columns aren't read.
    """
    spark = docs.sparkSession
    limit_batches(spark)
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = read.schema["id"].dataType.simpleString()
    seen = cut(read.mapInArrow(_sketcher(width, bands, rows), f"id {kind}, node binary, size long, bands array<long>"))
    nodes = seen.groupBy("node").agg(F.min("id").alias("least_id"), F.count("*").alias("copies"), F.max("size").alias("size"), F.min("bands").alias("bands"))
    nodes = cut(nodes)
    buckets = _buckets(nodes, threshold)
    roots = _components(read, nodes, buckets, threshold, width)
    named = nodes.select("node", "least_id", "copies").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = cut(named)
    sizes = named.groupBy("root").agg(F.min("least_id").alias("class_id"), F.sum("copies").alias("class_size"), F.count("*").alias("texts"))
    by_node = join_around_hot(named, sizes, "root", F.col("texts") >= HOT_ROWS, BROADCAST_ROWS).select("node", "root", "class_id", "class_size", "copies")
    each = join_around_hot(seen.select("id", "node"), by_node, "node", F.col("copies") >= HOT_ROWS, BROADCAST_ROWS)
    return each.select(F.col("id").alias(id_col), "class_id", "class_size", "node", "root")


def _buckets(nodes: DataFrame, threshold: float) -> DataFrame:
    """(bucket, node, size): members of every bucket with two or more texts, split by length.

    Similar texts have sizes within a factor of ``threshold``. A size class spans four such factors; a text enters its
    own class, and also the next one where a similar longer text may be in it.
    """
    unit = float(-4 * np.log(threshold))
    step, upper = (F.floor(F.log(F.col("size") / by) / unit).cast("long") for by in (F.lit(1.0), F.lit(threshold)))
    each = nodes.where("size > 0").select("node", "size", F.posexplode("bands").alias("band", "value"), F.array_distinct(F.array(step, upper)).alias("steps"))
    each = each.select("node", "size", F.explode("steps").alias("step"), "band", "value")
    each = each.select(F.xxhash64("band", "value", "step").alias("bucket"), "node", "size")
    many = each.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    return cut(each.join(many, "bucket", "left_semi"))


def _components(read: DataFrame, nodes: DataFrame, buckets: DataFrame, threshold: float, width: int) -> DataFrame:
    """(node, root) of all nodes that are linked to others."""
    hub = buckets.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("node").alias("pick"), F.col("node").alias("hub"), F.col("size").alias("hub_size"))).alias("h"))
    near = buckets.join(hub, "bucket").where(F.col("node") != F.col("h.hub")).where(_fits(F.col("size"), F.col("h.hub_size"), threshold))
    pairs = near.groupBy("node").agg(F.min("h").alias("h")).select(F.least("node", "h.hub").alias("src"), F.greatest("node", "h.hub").alias("dst"))
    pairs = cut(pairs.distinct())
    links = cut(_verified(read, nodes, pairs, threshold, width))
    roots = cut(connected_components(links))
    member = buckets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = member.groupBy("bucket", "root").agg(F.count("*").alias("n"), F.sum("size").alias("items"), F.min("node").alias("least"), F.max("node").alias("greatest"))
    open_ = classes.groupBy("bucket").agg(
        F.count("*").alias("classes"), F.sum("n").alias("n"), F.sum("items").alias("items"), F.max(F.struct("n", "root", "items")).alias("main"), F.min("least").alias("src"), F.max("greatest").alias("dst"))
    open_ = open_.where("classes > 1")
    settled = open_.where("n = 2").join(pairs, ["src", "dst"], "left_semi").select("bucket")
    open_ = open_.join(settled, "bucket", "left_anti").select(
        "bucket", F.col("main.root").alias("main"), F.ceil(F.greatest(F.col("n") / CHUNK, F.col("items") / CHUNK_ITEMS)).cast("int").alias("chunks"),
        F.ceil(F.greatest((F.col("n") - F.col("main.n")) / BLOCK, (F.col("items") - F.col("main.items")) / BLOCK_ITEMS)).cast("int").alias("blocks"))
    member = cut(member.join(open_, "bucket").select("bucket", "node", "root", F.col("root") != F.col("main"), "chunks", "blocks").toDF("bucket", "node", "root", "minor", "chunks", "blocks"))
    if member.isEmpty():
        return roots
    found = cut(_block_links(read, nodes, member, threshold, width))
    higher = connected_components(found).select(F.col("node").alias("root"), F.col("root").alias("higher"))
    every = buckets.select("node").distinct().join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return every.join(higher, "root", "left").select("node", F.coalesce("higher", "root").alias("root"))


def _fits(a, b, threshold: float):
    """Whether sizes allow the similarity."""
    return F.least(a, b) >= F.lit(threshold) * F.greatest(a, b)


def _block_links(read: DataFrame, nodes: DataFrame, member: DataFrame, threshold: float, width: int) -> DataFrame:
    """Links between classes (roots) that meet in a bucket, each block of minor members against each chunk of all members."""
    text = _texts(read, nodes, member.select("node").distinct(), width)
    items = cut(text.mapInArrow(_itemiser(width), "node binary, items binary"))
    place = lambda n: F.pmod(F.xxhash64("node", "bucket"), n).cast("int")
    # a minor member meets itself in one cell, to which one row goes for both
    placed = member.withColumns({"own_block": place(F.col("blocks")), "own_chunk": place(F.col("chunks"))})
    as_member = placed.withColumns({"block": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), "chunk": F.col("own_chunk"), "member": F.lit(True)}).withColumn("minor", F.col("minor") & (F.col("block") == F.col("own_block")))
    as_minor = placed.where("minor").withColumns({"chunk": F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)), "block": F.col("own_block"), "member": F.lit(False)}).where("chunk <> own_chunk")
    columns = ["bucket", "block", "chunk", "minor", "member", "node", "root"]
    dealt = as_member.select(*columns).unionByName(as_minor.select(*columns))
    dealt = dealt.join(items, "node").drop("node").repartition("bucket", "block", "chunk").sortWithinPartitions("bucket", "block", "chunk")
    return dealt.mapInArrow(_matcher(threshold), "src binary, dst binary").distinct()


def _texts(read: DataFrame, nodes: DataFrame, used: DataFrame, width: int) -> DataFrame:
    """(node, text): one document of each of the nodes."""
    chosen = cut(nodes.select("node", "least_id").join(used, "node", "left_semi"))
    ids = broadcast_below(chosen.select(F.col("least_id").alias("id")).distinct(), chosen.count(), BROADCAST_ROWS)
    text = read.join(ids, read["id"].eqNullSafe(ids["id"]), "left_semi").mapInArrow(_digester(width), f"id {read.schema['id'].dataType.simpleString()}, text string, __near_node binary")
    return text.select(F.col("__near_node").alias("node"), "text").dropDuplicates(["node"])


def _verified(read: DataFrame, nodes: DataFrame, pairs: DataFrame, threshold: float, width: int) -> DataFrame:
    """The pairs whose texts are similar."""
    text = cut(_texts(read, nodes, pairs.select(F.col("src").alias("node")).union(pairs.select("dst")).distinct(), width))
    one = pairs.join(text.withColumnsRenamed({"node": "src", "text": "text_a"}), "src")
    two = one.join(text.withColumnsRenamed({"node": "dst", "text": "text_b"}), "dst").select("src", "dst", "text_a", "text_b")
    return two.mapInArrow(_verifier(width, threshold), "src binary, dst binary")


def one_per_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each near-duplicate class: that with the smallest id. All columns stay.

    Rows with the id of their class and the same words as another such row tie; one of them stays. A class with null ids only keeps one.
    """
    width = options.get("width", 5)
    classes = cut(near_duplicate_classes(docs, id_col, text_col, **options))
    keeps = classes.where(F.col(id_col).eqNullSafe(F.col("class_id")))
    keeper = keeps.groupBy("root", "class_id").agg(F.min("node").alias("node"))
    keeper = cut(keeper.select(F.col("class_id").alias("__near_id"), F.col("node").alias("__near_keep")))
    goes = cut(classes.groupBy(id_col).agg(F.count("*").alias("n"), F.max(~F.col(id_col).eqNullSafe(F.col("class_id"))).alias("goes")).where("goes or n > 1").select(F.col(id_col).alias("__near_id")))
    n = goes.count()
    ids = broadcast_below(goes, n, BROADCAST_ROWS * 4)
    clean = docs.join(ids, F.col(id_col).eqNullSafe(F.col("__near_id")), "left_anti")
    # ids that occur more than once: told apart by their words
    twice = cut(classes.groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1").select(F.col(id_col).alias("__near_id")))
    if twice.isEmpty():
        return clean
    doubtful = docs.join(twice, F.col(id_col).eqNullSafe(F.col("__near_id")), "left_semi")
    inner = docs.schema
    spelled = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inner) + ", __near_node binary"
    told = doubtful.mapInArrow(_digester(width, text_col), spelled)
    same = F.col(id_col).eqNullSafe(F.col("__near_id")) & (F.col("__near_node") == F.col("__near_keep"))
    ties = told.join(keeper, same, "left_semi").dropDuplicates([id_col, "__near_node"])
    return clean.unionByName(ties.select(*docs.columns))
