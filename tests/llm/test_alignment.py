"""Alignment of two tokenizers against a brute force over characters' bytes."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lumenarc.llm import alignment
from lumenarc.llm._tokens import token_bytes, tokenizer_path

A, B = tokenizer_path(), tokenizer_path("piece_bpe_32k.model")
LEFT, RIGHT = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
LEFT.encode_special_tokens = True
ROWS = [(1, None), (2, ""), (3, "hello <|endoftext|> <s> world"), (4, "The quick brown fox, unbelievably naïve."), (4, "The quick brown fox, unbelievably naïve."), (None, "ñ 日本語 😀\n\n  x"), (5, "word here " * 3000),
        (6, "a▁b"), (7, " "), (8, "<0x41> <unk> \t tab"), (9, "internationalisation of tokenisers " * 50)]


def tokens(text):
    """Ids and byte spans of both sides; none where either doesn't spell the text."""
    if not text:
        return [], []
    raw, out = (" " + text).encode(), []
    for ids, table in ((LEFT.encode(" " + text, add_special_tokens=False).ids, token_bytes(A)), (RIGHT.encode(text), token_bytes(B))):
        at, spans = 0, []
        for i in ids:
            spans.append((i, at, at + len(table[i])))
            at += len(table[i])
        if b"".join(table[i] for i in ids) != raw:
            return [], []
        out.append(spans)
    return tuple(out)


def brute(rows):
    each, count = [], Counter()
    for _, text in rows:
        a, b = tokens(text)
        links = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]] if len(a) < 2000 else _swept(a, b)
        ends = sorted({x[2] for x in a} & {y[2] for y in b})
        spelled, begin, grouped = [], 0, 0
        for end in ends:
            ga, gb = ([str(x[0]) for x in side if begin < x[2] <= end] for side in (a, b)) if len(a) < 2000 else _group(a, b, begin, end)
            spelled.append(f"{','.join(ga)}|{','.join(gb)}")
            grouped += len(ga) * len(gb)
            begin = end
        count.update(links)
        each.append((len(a), len(b), len(ends), links, hashlib.sha256(";".join(spelled).encode()).hexdigest() if a else "", grouped))
    top = Counter()
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    return [(i, na, nb, g, len(k), sum(count[p] == top[p[1]] for p in k), sum(count[p] for p in k), h, m) for (i, _), (na, nb, g, k, h, m) in zip(rows, each, strict=True)]


def _swept(a, b):
    out, j = [], 0
    for x in a:
        while b[j][2] <= x[1]:
            j += 1
        k = j
        while k < len(b) and b[k][1] < x[2]:
            out.append((x[0], b[k][0]))
            k += 1
    return out


def _group(a, b, begin, end):
    from bisect import bisect_right

    return tuple([str(x[0]) for x in side[bisect_right(side, begin, key=lambda y: y[2]) : bisect_right(side, end, key=lambda y: y[2])]] for side in (a, b))


@pytest.mark.parametrize("hot", [500_000, 0, 40])
def test_scores_are_brute_force(spark, docs, hot):
    found = alignment.alignment_scores(docs(ROWS), A, B, hot_pairs=hot)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_group_links"]
    assert all(t == "bigint" for n, t in found.dtypes if n != "groups_sha256")
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, brute(ROWS)))


def test_tables_that_give_nothing(spark, docs):
    assert alignment.alignment_scores(docs([]), A, B).count() == 0
    assert [tuple(r)[1:7] for r in alignment.alignment_scores(docs([(1, None), (2, "▁")]), A, B).collect()] == [(0,) * 6] * 2


def test_links_by_overlap_and_by_group(spark, docs):
    rows = [(4, ROWS[3][1]), (5, ROWS[5][1]), (6, None)]
    got = {(r.doc_id, r.a_at, r.b_at): (r.a_id, r.b_id, r.shared) for r in alignment.token_links(docs(rows), A, B).collect()}
    want = {}
    for i, text in rows:
        a, b = tokens(text)
        want |= {(i, p, q): (x[0], y[0], min(x[2], y[2]) - max(x[1], y[1])) for p, x in enumerate(a) for q, y in enumerate(b) if x[1] < y[2] and y[1] < x[2]}
    assert got == want
    grouped = alignment.token_links(docs(rows), A, B, "group")
    assert {(r.doc_id, r.a_at, r.b_at) for r in grouped.collect()} >= set(want) and grouped.count() == sum(x[-1] for x in brute(rows))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 6), max_size=5), max_size=7), st.lists(st.lists(st.integers(0, 4), max_size=5), min_size=7, max_size=7), st.integers(1, 9))
def test_row_products_are_matrix_products(left, right, budget):
    def csr(rows, width):
        return alignment.Csr(np.cumsum([0, *map(len, rows)]), np.array([x for r in rows for x in r], np.int64), width)

    def dense(rows, width):
        out = np.zeros((len(rows), width), np.int64)
        for i, r in enumerate(rows):
            for x in r:
                out[i, x] += 1
        return out

    a, b = csr(left, 7), csr(right, 5)
    got = np.zeros((len(left), 5), np.int64)
    for i, j, n in alignment.row_products(a, b, budget):
        got[i, j] += n
    assert (got == dense(left, 7) @ dense(right, 5)).all()
    assert (alignment.entries(a, b) == got.sum(axis=1)).all()
    t = b.transposed
    assert (dense([t.idx[t.ptr[i] : t.ptr[i + 1]].tolist() for i in range(5)], 7) == dense(right, 5).T).all()


def test_long_texts_are_cut_at_groups(monkeypatch):
    left, right = alignment.Vocabulary(A), alignment.Vocabulary(B)
    x = alignment.aligned(["one long text without an end " * 400, None, "short"], left, right)
    whole = [np.concatenate(c) for c in zip(*alignment.overlap_links(x), strict=True)]
    parts = list(alignment.strips(x, 100))
    assert len(parts) > 50 and sum(p[0].stop - p[0].start for p in parts) == len(x.a) and sum(p[1].stop - p[1].start for p in parts) == len(x.b)
    monkeypatch.setattr(alignment, "strips", lambda x, size=100, f=alignment.strips: f(x, 100))
    again = [np.concatenate(c) for c in zip(*alignment.overlap_links(x), strict=True)]
    assert all((p == q).all() for p, q in zip(whole, again, strict=True))
