"""Best-fit packing by bin completion.

Documents become pieces of at most ``capacity`` tokens. As a piece's length decides where it fits, packing works on
the histogram of lengths, which has at most ``capacity`` entries whatever the input. First a best-fit solution: the largest length
left is completed with the filling of least waste that a bounded depth-first search finds, as often as the histogram allows. Where that takes more sequences than the
lower bound, bin completion packs neighbourhoods of wasteful sequences anew: around the largest piece left it enumerates the undominated fillings, least waste first,
and prunes where waste exceeds what one sequence fewer leaves; best-fit solutions are the incumbents. The plan (a few thousand patterns) goes to the
tasks, which turn each piece's rank among the pieces of its length into its place.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenarc.llm._store import broadcast_below, cut, limit_batches
from lumenarc.llm._tokens import encoder

#: Nodes that the search for one filling of the best-fit solution may visit.
NODES = 3_000
#: Pieces that branch and bound packs anew at once, and steps of its enumeration in all; beyond them the incumbent stays.
SEARCH_PIECES, SEARCH_STEPS = 64, 1_000_000
#: Pieces of one length that one window ranks.
GROUP_ROWS = 20_000
BROADCAST_ROWS = 250_000


def best_filling(room: int, lengths: list[int], left: np.ndarray, nodes: int = NODES) -> list[int]:
    """Lengths (descending, repeats allowed up to ``left``) with the least waste in ``room``; ``lengths`` descending."""
    best: list[int] = []
    best_waste, budget = room, nodes
    if not room or not lengths:
        return best
    low = np.asarray(lengths[::-1])
    total = np.cumsum(low * left[low])[::-1]

    def first(size: int) -> int:
        """Index in ``lengths`` of the largest that is at most ``size``."""
        return len(lengths) - int(np.searchsorted(low, size, "right"))

    # depth first with a stack of its own, as a filling may have as many pieces as there is room: [index in lengths, space]
    filling: list[int] = []
    used: Counter = Counter()
    stack = [[first(room), room]]
    while stack:
        at, space = stack[-1]
        if at < len(lengths) and best_waste and budget > 0:
            size = lengths[at]
            if left[size] > used[size]:
                budget -= 1
                filling.append(size)
                used[size] += 1
                space -= size
                if space < best_waste:
                    best, best_waste = list(filling), space
                stack.append([max(at, first(space)), space])
                continue
        else:
            stack.pop()
            if not stack:
                break
            used[filling.pop()] -= 1
            at, space = stack[-1]
        at += 1
        # waste bound: all pieces of the lengths that are left can't beat the best filling
        stack[-1][0] = len(lengths) if at < len(lengths) and space - total[at] >= best_waste else at
    return best


class BudgetSpent(Exception):
    """The steps of a search are used up."""


def undominated_fillings(room: int, left: Counter, max_waste: int, budget: list[int]) -> list[tuple[int, list[int]]]:
    """(waste, lengths) of fillings of ``room`` from the lengths ``left``, least waste first.

    Left out are fillings that another one dominates: a length that isn't used takes the place of none, one or two used pieces that
    are shorter together (or as long, for two) and fits.
    """
    lengths = sorted((x for x in left if left[x] > 0 and x <= room), reverse=True)
    below = [0] * (len(lengths) + 1)
    for k in range(len(lengths) - 1, -1, -1):
        below[k] = below[k + 1] + lengths[k] * left[lengths[k]]
    out: list[tuple[int, list[int]]] = []

    def dominated(filling: list[int], waste: int) -> bool:
        used = Counter(filling)
        free = [x for x in lengths if left[x] > used[x]]
        sums = {0} | set(filling)
        pairs = {a + b for i, a in enumerate(filling) for b in filling[i + 1 :]}
        return any(any(s < x <= s + waste for s in sums) or any(s <= x <= s + waste for s in pairs) for x in free)

    def extend(at: int, space: int, filling: list[int]) -> None:
        budget[0] -= 1
        if budget[0] < 0:
            raise BudgetSpent
        if space - below[at] > max_waste:
            return
        if at == len(lengths):
            if not dominated(filling, space):
                out.append((space, filling))
            return
        size = lengths[at]
        for n in range(min(left[size], space // size), -1, -1):
            extend(at + 1, space - n * size, filling + [size] * n)

    extend(0, room, [])
    return sorted(out, key=lambda f: (f[0], [-x for x in f[1]]))


def complete_bins(pieces: Counter, capacity: int, target: int, budget: list[int]) -> list[list[int]] | None:
    """A packing of ``pieces`` (length: number) into at most ``target`` sequences; None if there is none or the steps in ``budget`` don't find it."""
    seen = set()

    def search(left: Counter, bins: int, spare: int) -> list[list[int]] | None:
        left = +left
        if not left:
            return []
        state = (tuple(sorted(left.items())), spare)
        if bins == 0 or spare < 0 or state in seen:
            return None
        largest = max(left)
        rest = left - Counter([largest])
        for waste, filling in undominated_fillings(capacity - largest, rest, spare, budget):
            found = search(rest - Counter(filling), bins - 1, spare - waste)
            if found is not None:
                return [[largest, *filling], *found]
        seen.add(state)
        return None

    try:
        return search(pieces, target, target * capacity - sum(x * n for x, n in pieces.items()))
    except BudgetSpent:
        return None


def _best_fit_plan(counts: np.ndarray, capacity: int, nodes: int) -> list[tuple[list[int], int]]:
    """Patterns of the first incumbent: the filling of least waste around the largest length left, as often as it can be used."""
    left = counts.astype(np.int64).copy()
    plan: list[tuple[list[int], int]] = []
    while True:
        lengths = np.flatnonzero(left)[::-1].tolist()
        if not lengths:
            return plan
        largest = lengths[0]
        left[largest] -= 1
        rest = [x for x in lengths if x <= capacity - largest and left[x]]
        pattern = [largest, *best_filling(capacity - largest, rest, left, nodes)]
        left[largest] += 1
        size, uses = np.unique(pattern, return_counts=True)
        times = int((left[size] // uses).min())
        left[size] -= uses * times
        plan.append((pattern, times))


def _neighbourhood(plan: list[tuple[list[int], int]], capacity: int, most: int, rng: random.Random | None) -> Counter:
    """How many sequences of each pattern to pack anew, of ``most`` pieces at most: those with most waste, then of fewest pieces; with ``rng`` a random
    draw, in which waste weighs, that ends where it holds the waste of a sequence and somewhat more."""
    waste = [capacity - sum(p) for p, _ in plan]
    if rng is None:
        order, enough = sorted(range(len(plan)), key=lambda k: (-waste[k], len(plan[k][0]))), float("inf")
    else:
        order, enough = sorted(range(len(plan)), key=lambda k: rng.random() ** (1 / (1 + waste[k])), reverse=True), capacity * rng.uniform(1.02, 1.6)
    taken, pieces, held = Counter(), 0, 0
    for k in order:
        size = len(plan[k][0])
        wanted = plan[k][1] if rng is None or not waste[k] else min(plan[k][1], -(-int(max(0.0, enough - held)) // waste[k]))
        n = min(wanted, (most - pieces) // size)
        if n > 0:
            taken[k] = n
            pieces += n * size
            held += n * waste[k]
        if held >= enough:
            break
    return taken


def pack_histogram(counts: np.ndarray, capacity: int, nodes: int = NODES, steps: int | None = SEARCH_STEPS, most: int | None = SEARCH_PIECES) -> list[tuple[list[int], int]]:
    """Patterns (lengths of one sequence, longest first) and how often each is used; together they use up ``counts``.

    Where the best-fit solution misses the lower bound, neighbourhoods of up to ``most`` pieces are packed into one sequence less by bin completion: first that of most waste, then random ones (of a fixed
    seed), each with a part of the steps, until the bound is met or the steps are spent. With ``steps`` and ``most`` None all pieces (900 at most, else ValueError) are one neighbourhood and the search ends with
    the optimum, however long it takes.
    """
    if most is None and counts.sum() > 900:
        raise ValueError(f"{int(counts.sum())} pieces are too many for an exact search")
    plan = _best_fit_plan(counts, capacity, nodes)
    least, left, rng, failed = lower_bound(counts, capacity), steps, random.Random(capacity), 0
    while sum(times for _, times in plan) > least and (left is None or left > 0):
        taken = _neighbourhood(plan, capacity, most or sum(len(p) * t for p, t in plan), rng if failed else None)
        pieces = Counter()
        for k, n in taken.items():
            pieces += Counter({x: m * n for x, m in Counter(plan[k][0]).items()})
        budget = [1 << 62 if left is None else min(left, max(steps // 25, 1000))]
        before = budget[0]
        # one sequence less needs its room in waste
        room = sum(n * (capacity - sum(plan[k][0])) for k, n in taken.items())
        better = complete_bins(pieces, capacity, taken.total() - 1, budget) if room >= capacity else None
        if left is not None:
            left -= max(before - max(budget[0], 0), 100)
        if better is None:
            if most is None:
                return plan
            failed += 1
            continue
        plan = [(p, times - taken[k]) for k, (p, times) in enumerate(plan) if times > taken[k]] + [(b, 1) for b in better]
        failed = 0
    return plan


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Sequences that any packing needs: by all tokens, and for each k by lengths over capacity - k (alone), over half (apart) and from k on (in the room that the latter leave)."""
    size = np.arange(capacity + 1)
    n, tokens = np.cumsum(counts), np.cumsum(size * counts)
    best = -(-int(tokens[-1]) // capacity)
    half = capacity // 2
    for k in range(half + 1):
        alone = int(n[-1] - n[capacity - k])
        apart, held = int(n[capacity - k] - n[half]), int(tokens[capacity - k] - tokens[half])
        small = int(tokens[half] - (tokens[k - 1] if k else 0))
        best = max(best, alone + apart + max(0, -(-(small - (apart * capacity - held)) // capacity)))
    return best


def _slots(plan: list[tuple[list[int], int]], capacity: int) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, uses in a sequence, offset), by rank."""
    out: dict[int, list] = {}
    rank, base = np.zeros(capacity + 1, np.int64), 0
    for pattern, times in plan:
        at = 0
        for size, uses in zip(*np.unique(pattern, return_counts=True), strict=True):
            out.setdefault(int(size), []).append((rank[size], base, uses, at))
            rank[size] += uses * times
            at += int(size) * int(uses)
        base += times
    return {k: np.asarray(v, np.int64) for k, v in out.items()}


def _cutter(tokenizer: str, capacity: int, end: int | None):
    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            rows: list[tuple] = []
            for k, value in enumerate(batch.column(1)):
                ids = encode(value.as_py() or "")
                if end is not None:
                    ids = np.append(ids, np.uint32(end))
                data, n = ids.astype("<u4").tobytes(), len(ids)
                first = n % capacity or min(n, capacity)
                for piece, start in enumerate([0, *range(first, n, capacity)]):
                    length = first if not piece else capacity
                    rows.append((k, piece, start, length, crc32(data[4 * start : 4 * (start + length)])))
            k, piece, start, length, crc = (np.asarray(x, np.int64) for x in zip(*rows, strict=True)) if rows else [np.zeros(0, np.int64)] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(k)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)], ["id", "piece", "start", "length", "ids_crc32"])

    return cut_up


def _placer(slots: dict[int, np.ndarray]):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = np.asarray(batch.column(3)), np.asarray(batch.column(5))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for size in np.unique(length):
                at = np.flatnonzero(length == size)
                table = slots[int(size)]
                row = table[np.searchsorted(table[:, 0], rank[at], "right") - 1]
                use = rank[at] - row[:, 0]
                sequence[at], offset[at] = row[:, 1] + use // row[:, 2], row[:, 3] + use % row[:, 2] * size
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return place


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end: int | None = 0, search_steps: int | None = SEARCH_STEPS, search_pieces: int | None = SEARCH_PIECES) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and then ``end``; null text counts as empty, so every document has a piece. Only documents of more
    than ``capacity`` ids are cut, into pieces of ``capacity`` of which the first may be shorter. Places in a sequence follow one another from 0.
    Repeated ids are separate documents; an empty table gives an empty one. Pieces of one length are ranked in salted
    groups whose number grows with the input, so a length that a third of all pieces share is no single task's.
    """
    limit_batches(docs.sparkSession)
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = read.schema["id"].dataType.simpleString()
    shape = f"id {kind}, piece int, start long, length long, ids_crc32 long"
    pieces = cut(read.mapInArrow(_cutter(tokenizer, capacity, end), shape))
    counts = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():  # at most `capacity` rows
        counts[row["length"]] = row["count"]
    slots = _slots(pack_histogram(counts, capacity, steps=search_steps, most=search_pieces), capacity)
    # salts of a length grow with its own pieces
    groups = docs.sparkSession.createDataFrame([(k, max(1, int(n) // GROUP_ROWS)) for k, n in enumerate(counts.tolist()) if n], "length long, groups int")
    salted = pieces.join(F.broadcast(groups), "length").withColumn("salt", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.col("groups"))).drop("groups")
    held = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut(held.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")))
    local = F.row_number().over(Window.partitionBy("length", "salt").orderBy("id", "piece", "ids_crc32")) - 1
    ranked = salted.withColumn("local", local).join(broadcast_below(offsets, offsets.count(), BROADCAST_ROWS), ["length", "salt"])
    ranked = ranked.select("id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("local")).alias("rank"))
    return ranked.mapInArrow(_placer(slots), f"{shape}, sequence_id long, offset long").withColumnRenamed("id", id_col)
