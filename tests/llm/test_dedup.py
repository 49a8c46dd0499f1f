"""Exact and near duplicates against brute force, with awkward rows."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from lumenarc.llm import dart_minhash, exact_dedup

AWKWARD = [(1, None), (2, ""), (3, " \n\t\x0b\x0c\r"), (4, "a b"), (5, "ab"), (6, "a  b"), (6, "a  b"), (None, "a b c"), (None, "abc"), (7, "é x"), (8, "éx"), (9, "abc"), (10, "x" * 300_000), (11, "x" * 300_000 + " ")]


def brute_exact(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    out = []
    for norm, members in groups.items():
        members.sort()
        out += [(m[3], members[0][3], len(members), k == 0, hashlib.sha256(norm.encode()).hexdigest()) for k, m in enumerate(members)]
    return sorted(out, key=str)


@pytest.mark.parametrize("rows", [AWKWARD, [], [(i, "same text") for i in range(300)] + AWKWARD])
def test_exact_groups(docs, rows):
    got = exact_dedup.exact_groups(docs(rows), capacity=4).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_exact(rows)


def test_drop_copies(docs):
    df = docs(AWKWARD)
    got = exact_dedup.drop_copies(df)
    assert got.columns == df.columns
    kept = sorted((str(r[0]) for r in brute_exact(AWKWARD) if r[3]))
    assert sorted(str(r.doc_id) for r in got.collect()) == kept
    assert exact_dedup.drop_copies(docs([])).count() == 0


def test_bytes_decide(spark, docs, monkeypatch):
    """Keys that collide: texts are then told apart by their bytes."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: F.lit("00" * 32))
    rows = [(1, "aa"), (2, "bb"), (3, "a a"), (4, "cc"), (5, "bb")]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(docs(rows)).collect()}
    assert got == {1: (3, 2, False), 3: (3, 2, True), 2: (2, 2, True), 5: (2, 2, False), 4: (4, 1, True)}


def test_directory_splits_overfull_buckets(spark):
    # 1,000 keys of ten bits, a further 300 that share their first seven
    keys = spark.range(1000).selectExpr("shiftleft(id, 54) key").union(spark.range(300).selectExpr("shiftleft(cast(5 as bigint), 57) + id * 1000003"))
    slots, depth = exact_dedup.directory(keys, 100, 12)
    slots = slots.collect()
    assert depth == 12 and len({r.slot for r in slots}) == len(slots)
    bucket_of, depth_of = {r.slot: r.bucket for r in slots}, {r.bucket: r.depth for r in slots}
    held = Counter(bucket_of[(r.key % 2**64) >> 52] for r in keys.collect())
    assert sum(held.values()) == 1300
    assert all(n <= 100 or depth_of[b] == 12 for b, n in held.items()) and sum(n > 100 for n in held.values()) == 1
    # a bucket of depth d has 2 ** (12 - d) slots, and its parent was overfull
    assert all(n == 2 ** (12 - depth_of[b]) for b, n in Counter(bucket_of.values()).items()) and len(set(depth_of.values())) > 1
    for b, d in depth_of.items():
        prefix = b >> 6
        assert d == 0 or sum((r.key % 2**64) >> (65 - d) == prefix >> 1 for r in keys.collect()) > 100
    slots, depth = exact_dedup.directory(keys, 5000, 10)
    assert depth == 0 and [(r.slot, r.depth) for r in slots.collect()] == [(0, 0)]
    slots, depth = exact_dedup.directory(keys.where("false"), 5000, 10)
    assert depth == 0 and slots.count() == 0


def test_string_ids_and_no_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", 0)
    rows = [("b", "x y"), ("a", "xy"), ("c", "x y"), (None, "x y"), ("d", None)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(df, capacity=1).collect()}
    assert got == {"b": ("b", 4, True), "a": ("b", 4, False), "c": ("b", 4, False), None: ("b", 4, False), "d": ("d", 1, True)}
    assert sorted(r.doc_id for r in exact_dedup.drop_copies(df).collect()) == ["b", "d"]


def bag(text, width=5):
    w = (text or "").encode().split()
    return Counter(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else Counter()


def classes(rows, threshold=0.8):
    bags = [bag(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        union = sum((bags[i] | bags[j]).values())
        if (sum((bags[i] & bags[j]).values()) / union if union else 1.0) >= threshold:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return Counter(frozenset(Counter(str(rows[i][0]) for i in range(len(rows)) if find(i) == r).items()) for r in {find(i) for i in range(len(rows))})


def edited(text, seed, n):
    import random

    r, w = random.Random(seed), text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
    return " ".join(w)


def family(words):
    rows = [(i, words(120, i)) for i in range(40)]
    base = words(200, 999)
    rows += [(100 + k, edited(base, k, 4)) for k in range(60)]  # many are near each other, some aren't
    rows += [(200 + k, base) for k in range(20)]
    rows += [(300 + k, f"{words(50, 5)} {words(60, 1000 + k)}") for k in range(30)]  # a shared passage isn't enough
    return rows + [(400, None), (401, ""), (402, "one two"), (403, "one  two"), (404, "one two three"), (None, base), (405, words(3000, 5, 50)), (405, words(3000, 5, 50)), (406, words(30, 7) + " ja" * 300), (407, words(30, 7) + " ja" * 290)]


def test_classes_are_those_of_brute_force(docs, words):
    rows = family(words)
    got = dart_minhash.near_duplicate_classes(docs(rows)).collect()
    by_root = defaultdict(list)
    for r in got:
        by_root[bytes(r.root)].append(r)
    for members in by_root.values():
        ids = [m.doc_id for m in members if m.doc_id is not None]
        assert {m.class_size for m in members} == {len(members)} and {m.class_id for m in members} == {min(ids) if ids else None}
    assert Counter(frozenset(Counter(str(m.doc_id) for m in x).items()) for x in by_root.values()) == classes(rows)


def test_small_blocks_change_nothing(docs, words, monkeypatch):
    rows = family(words)
    monkeypatch.setattr(dart_minhash, "BLOCK", 3)
    monkeypatch.setattr(dart_minhash, "CHUNK", 7)
    by_root = defaultdict(Counter)
    for r in dart_minhash.near_duplicate_classes(docs(rows)).collect():
        by_root[bytes(r.root)][str(r.doc_id)] += 1
    assert Counter(frozenset(x.items()) for x in by_root.values()) == classes(rows)


def test_no_broadcasts_and_hot_classes_change_nothing(docs, words, monkeypatch):
    rows = family(words)
    monkeypatch.setattr(dart_minhash, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(dart_minhash, "HOT_ROWS", 5)
    by_root = defaultdict(Counter)
    for r in dart_minhash.near_duplicate_classes(docs(rows)).collect():
        by_root[bytes(r.root)][str(r.doc_id)] += 1
    assert Counter(frozenset(x.items()) for x in by_root.values()) == classes(rows)


def test_another_text_column(docs, words):
    df = docs(family(words)).withColumnsRenamed({"text": "body", "kept": "text"})
    got = dart_minhash.one_per_class(df, text_col="body")
    assert got.columns == df.columns and got.count() == dart_minhash.one_per_class(docs(family(words))).count()


def test_one_per_class(docs, words):
    rows = family(words)
    df = docs(rows)
    got = dart_minhash.one_per_class(df)
    assert got.columns == df.columns and got.count() == sum(classes(rows).values())
    assert dart_minhash.one_per_class(docs([])).count() == 0
    assert dart_minhash.near_duplicate_classes(docs([])).count() == 0


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(3)
    a = rng.gamma(1.0, 2.0, 300)
    b = np.where(rng.random(300) < 0.7, a, rng.gamma(1.0, 2.0, 300))
    e = np.arange(300, dtype=np.uint64)
    s = dart_minhash.dart_signatures(np.r_[e, e], np.r_[a, b], np.repeat([0, 1], 300), 2, 2048)
    assert np.isfinite(s).all()
    assert abs((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.05
    alone = dart_minhash.dart_signatures(e[:1], np.array([0.01]), np.array([1]), 2, 64)
    assert np.isinf(alone[0]).all() and np.isfinite(alone[1]).all()


def test_ids_of_other_types(docs, words):
    from pyspark.sql import functions as F

    rows = [r for r in family(words) if r[0] is not None]
    text = docs(rows).withColumn("doc_id", F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 5, "0")))
    plain = Counter((f"d{r.doc_id:05d}", f"d{r.class_id:05d}", r.class_size) for r in dart_minhash.near_duplicate_classes(docs(rows)).collect())
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in dart_minhash.near_duplicate_classes(text).collect()) == plain
    assert dart_minhash.one_per_class(text).count() == dart_minhash.one_per_class(docs(rows)).count()
