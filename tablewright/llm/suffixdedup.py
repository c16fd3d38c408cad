"""Repeated passages across documents by hash-compared suffix sorting.

A passage is ``span`` words in a row (parted by ASCII white space, compared by their bytes) that another document holds too; spans
that overlap or touch are reported as one. The work is dealt so that equal passages meet:

1. Of each window of ``span`` words one n-gram of ``gram`` words is chosen by least hash, a choice that depends on the
   window's words alone. Only n-grams chosen in two documents at least can lie in a repeated passage.
2. For each of those the words around it, as far as a window with it can reach, go to the n-gram's task; equal
   surroundings within a batch of input travel once.
3. A task sorts, for each n-gram, the suffixes that begin there, and the reversed words before it. The sort is a mergesort
   (all runs of a level at once, in numpy) that compares two suffixes by binary search for their longest common extension on
   prefix polynomial hashes. Words are numbered after their bytes were compared, and each common extension that the
   result rests on is compared number by number; on a collision the batch is sorted without hashes.
4. Neighbours in the two orders with enough in common on both sides share a window, which is in a passage if two
   documents hold it.

(id, first_word, end_word): words are counted from 0, end exclusive.

Results for odd input: null ids, null texts and texts of fewer than ``span`` words have no rows; repeats within one
document, or between rows that share an id, don't count, and spans of rows that share an id are reported together; an
empty table gives no rows. Ids are whole numbers; others raise ValueError. A text is held whole by one task, up to 268 million
words. Other columns aren't read.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textvec
from ._shared import byte_slices, col, trim_memory, written

_U = np.uint64
#: Bits of an n-gram's hash that choose it; the others break ties by place.
_PLACE_BITS = 28
#: Bytes of surroundings that are sorted together; numpy takes some twenty times as much meanwhile.
_BATCH = 3 << 20
#: Bytes of text that are cut in words together.
_STEP = 512 << 10


def anchors(h: np.ndarray, row: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Word index and n-gram hash of the chosen n-grams; h, row: hash and text of every word."""
    w = span - gram + 1
    m = len(h) - gram + 1
    if m < w:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    g = h[:m].copy()
    for i in range(1, gram):
        g = g * _U(0x100000001B3) + h[i : m + i]
    g = textvec.mix(g)
    key = (g >> _U(_PLACE_BITS) << _U(_PLACE_BITS)) | (np.arange(m, dtype=_U) & _U((1 << _PLACE_BITS) - 1))
    # least of every w in a row: the end of one block of w and the beginning of the next
    pad = -m % w
    blocks = np.concatenate([key, np.full(pad, ~_U(0))]).reshape(-1, w)
    head = np.minimum.accumulate(blocks, axis=1).ravel()
    tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = m - w + 1
    least = np.minimum(tail[:n], head[w - 1 : w - 1 + n])
    least = least[row[:n] == row[span - 1 : span - 1 + n]]
    # the place is known from its low bits, as long as a batch has fewer words than they count
    at = np.unique((least & _U((1 << _PLACE_BITS) - 1)).astype(np.int64))
    return at, g[at]


def _runs(size: np.ndarray, most: int = 500_000) -> Iterator[slice]:
    """Cut in slices of about ``most`` in all (one element at least)."""
    total, at = np.cumsum(size), 0
    while at < len(size):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, side="right")))
        yield slice(at, stop)
        at = stop


class Words:
    """Numbered words in a row with prefix polynomial hashes."""

    def __init__(self, ids: np.ndarray, salt: int = 0):
        self.ids = ids
        n = len(ids)
        self.up, self.down = textvec.powers(n + 1)
        self.sums = np.zeros(n + 1, _U)
        np.cumsum(textvec.mix(ids.astype(_U) + _U(1 + salt)) * self.up[:n], out=self.sums[1:])

    def same(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether n words from a and from b have equal hashes."""
        x = (self.sums[a + n] - self.sums[a]) * self.down[a]
        return x == (self.sums[b + n] - self.sums[b]) * self.down[b]

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the longest common extension of a and b, ``most`` at most, by binary search."""
        lo, hi = np.zeros(len(a), np.int64), most.astype(np.int64)
        while (lo < hi).any():
            mid = (lo + hi + 1) >> 1
            yes = self.same(a, b, mid)
            lo, hi = np.where(yes, mid, lo), np.where(yes, hi, mid - 1)
        return lo

    def before(self, a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 as suffix a (of na words) sorts before, with or after b."""
        most = np.minimum(na, nb)
        c = self.common(a, b, most)
        ended = c == most
        last = max(len(self.ids) - 1, 0)
        x, y = self.ids[np.minimum(a + c, last)], self.ids[np.minimum(b + c, last)]
        return np.where(ended, np.sign(na - nb), np.where(x < y, -1, 1))

    def verified(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> bool:
        """Whether n words from a and b are equal by number."""
        for s in _runs(n):
            size = n[s]
            step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            if not np.array_equal(self.ids[np.repeat(a[s], size) + step], self.ids[np.repeat(b[s], size) + step]):
                return False
        return True


def sort_suffixes(words: Words, start: np.ndarray, size: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Order of suffixes (start, size) within groups (ascending numbers), and common extension with the one before, 0 at
    the first of a group. Null if a hash collided."""
    n = len(start)
    order = np.arange(n)
    if not n:
        return order, order
    first = np.searchsorted(group, group)  # of the group
    count = np.searchsorted(group, group, side="right") - first
    width, most = 1, int(count.max())
    while width < most:
        slot = np.flatnonzero(count > width)  # slots, not elements: a group stays in its slots
        local = slot - first[slot]
        run = local // width
        base = first[slot] + (run ^ 1) * width
        end = first[slot] + count[slot]
        lo = np.minimum(base, end)
        hi = np.minimum(base + width, end)
        origin, right = lo.copy(), (run & 1).astype(bool)
        me = order[slot]
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            other, own = order[mid], me[live]
            d = words.before(start[other], size[other], start[own], size[own])
            less = (d < 0) | (d == 0) & right[live]  # ties keep their order
            lo[live] = np.where(less, mid + 1, lo[live])
            hi[live] = np.where(less, hi[live], mid)
            live = live[lo[live] < hi[live]]
        place = first[slot] + (run >> 1) * 2 * width + local % width + (lo - origin)
        new = order.copy()
        new[place] = me
        order = new
        width *= 2
    a, b = order[:-1], order[1:]
    joined = group[1:] == group[:-1]
    c = np.where(joined, words.common(start[a], start[b], np.where(joined, np.minimum(size[a], size[b]), 0)), 0)
    # neighbours that share c words by number and are in order make the whole order right
    if not words.verified(start[a], start[b], c) or (joined & (words.before(start[a], size[a], start[b], size[b]) > 0)).any():
        return None
    return order, np.concatenate([[0], c])


def plain_sort(ids: np.ndarray, start: np.ndarray, size: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``sort_suffixes``, without hashes."""
    texts = [tuple(ids[s : s + n].tolist()) for s, n in zip(start, size)]
    order = sorted(range(len(start)), key=lambda i: (group[i], texts[i]))
    c = [0] * len(order)
    for t in range(1, len(order)):
        i, j = order[t - 1], order[t]
        if group[i] == group[j]:
            x, y = texts[i], texts[j]
            c[t] = next((q for q, (u, v) in enumerate(zip(x, y)) if u != v), min(len(x), len(y)))
    return np.array(order, np.int64), np.array(c, np.int64)


def word_numbers(h: np.ndarray, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A number for every word, equal where the words' bytes are equal. h: hashes; s, e: bytes of each word in data."""
    u, first, number = np.unique(h, return_index=True, return_inverse=True)
    size = e - s
    lead = first[number]
    ok = size == size[lead]
    if ok.all():
        for run in _runs(size):
            n = size[run]
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            if not np.array_equal(data[np.repeat(s[run], n) + step], data[np.repeat(s[lead[run]], n) + step]):
                ok[0] = False
                break
    if not ok.all():  # two words with one hash
        raw, seen = data.tobytes(), {}
        number = np.array([seen.setdefault(raw[a:b], len(seen)) for a, b in zip(s, e)], np.int64)
    return number.astype(np.int64)


def shared_windows(group: np.ndarray, texts: pa.Array, left: np.ndarray, low: np.ndarray, high: np.ndarray, span: int, hashed: bool = True) -> list[tuple[int, int, int]]:
    """(i, l0, l1): of surroundings i the windows that begin l0..l1 words before its n-gram occur in two documents.

    group: number of the n-gram, ascending; texts: surroundings; left: words before the n-gram; low and high: least and
    greatest id among the documents that hold them."""
    h, row, s, e = textvec.words(texts, textvec.RAW, _STEP)
    data, off = textvec.buffers(texts)
    ids = word_numbers(h, data, s + off[row], e + off[row])
    n = len(texts)
    begin = np.searchsorted(row, np.arange(n + 1))
    del h, row, s, e, data, off
    start, right = begin[:-1] + left, begin[1:] - begin[:-1] - left
    total = len(ids)
    both = []
    for seq, st, sz in ((ids, start, right), (ids[::-1].copy(), total - start, left)):
        got = sort_suffixes(Words(seq), st, sz, group) if hashed else None
        both.append(got if got is not None else plain_sort(seq, st, sz, group))
    (ro, rc), (lo, lc) = both
    out: list[tuple[int, int, int]] = []
    open_from = np.full(n, -1, np.int64)
    for l in range(0, int(left.max(initial=0)) + 2):
        hit = np.zeros(n, bool)
        can = np.flatnonzero((left >= l) & (right >= span - l))
        if len(can) and l <= span:
            # classes of surroundings with enough words in common on a side; a group's first never joins the one before
            cr, cl = np.empty(n, np.int64), np.empty(n, np.int64)
            same_r = np.concatenate([[False], (group[1:] == group[:-1]) & (rc[1:] >= span - l)])
            same_l = np.concatenate([[False], (group[1:] == group[:-1]) & (lc[1:] >= l)])
            cr[ro], cl[lo] = np.cumsum(~same_r), np.cumsum(~same_l)
            key = cr[can] * (n + 1) + cl[can]
            o = np.argsort(key, kind="stable")
            k = key[o]
            cut = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
            lowest, highest = np.minimum.reduceat(low[can[o]], cut), np.maximum.reduceat(high[can[o]], cut)
            hit[can[o]] = np.repeat(lowest != highest, np.diff(np.append(cut, len(k))))
        for i in np.flatnonzero(~hit & (open_from >= 0)):
            out.append((int(i), int(open_from[i]), l - 1))
        open_from[~hit] = -1
        open_from[hit & (open_from < 0)] = l
    return out


def repeated_windows(batches: Iterable[pa.RecordBatch], span: int, most: int = _BATCH) -> Iterator[pa.RecordBatch]:
    """(k, first_word, end_word) of the windows that two documents hold, from surroundings (g, t, l, ks, at) in order of g.

    N-grams are sorted together until they have ``most`` bytes: memory goes with that or with the largest n-gram, not with the task."""
    held: dict[tuple[int, bytes], list] = {}
    last, size = None, 0
    for batch in batches:
        for part in byte_slices(batch, "t", most):
            for g, t, l, ks, at in zip(*(part.column(c).to_pylist() for c in ("g", "t", "l", "ks", "at"))):
                if g != last and size >= most:
                    yield from _found(held, span)
                    held, size = {}, 0
                last = g
                got = held.get((g, t))
                if got is None:
                    held[g, t] = [l, array("q", ks), array("q", at)]
                    size += len(t)
                else:
                    got[1].extend(ks)
                    got[2].extend(at)
                size += 16 * len(ks)
    yield from _found(held, span)


def _found(held: dict[tuple[int, bytes], list], span: int) -> Iterator[pa.RecordBatch]:
    if not held:
        return
    gs = np.array([v for v, _ in held], np.int64)
    group = np.cumsum(np.append(0, gs[1:] != gs[:-1]))
    values = list(held.values())
    left = np.array([v[0] for v in values], np.int64)
    low, high = (np.array([f(v[1]) for v in values], np.int64) for f in (min, max))
    ids, first, end = [], [], []
    for i, l0, l1 in shared_windows(group, pa.array([t for _, t in held], pa.binary()), left, low, high, span):
        _, ks, at = values[i]
        ids.append(np.array(ks, np.int64))
        a = np.array(at, np.int64)
        first.append(a - l1)
        end.append(a - l0 + span)
    if ids:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in (ids, first, end)], ["k", "first_word", "end_word"])


def repeated_passages(docs: DataFrame, span: int = 50, gram: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, first_word, end_word) of every passage of ``span`` words or more that another document holds too."""
    kind = docs.select(col(id_col)).schema[0].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint", "void"):
        raise ValueError(f"ids are whole numbers here; column {id_col} is {kind}")
    src = docs.select(col(id_col).cast("long").alias("k"), col(text_col).cast("string").alias("x")).where("k IS NOT NULL AND x IS NOT NULL")
    reach = span - gram  # words before an n-gram that a window with it may hold

    def choose(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim_memory()
        for batch in batches:
            for part in byte_slices(batch, "x"):
                h, row, _, _ = textvec.words(part.column("x"), textvec.RAW, _STEP)
                at, g = anchors(h, row, span, gram)
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), part.column("k").take(pa.array(row[at]))], ["g", "k"])

    chosen = written(src.mapInArrow(choose, "g long, k long").distinct(), "suffix-chosen")
    often = chosen.groupBy("g").agg(F.min("k").alias("a"), F.max("k").alias("b")).where("a <> b").select("g")
    wanted = chosen.join(often, "g").groupBy("k").agg(F.collect_list("g").alias("gs"))

    def surround(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim_memory()
        for batch in batches:
            for part in byte_slices(batch, "x"):
                x = part.column("x")
                h, row, s, e = textvec.words(x, textvec.RAW, _STEP)
                data, off = textvec.buffers(x)
                raw = memoryview(data.tobytes())
                at, g = anchors(h, row, span, gram)
                gs, of = part.column("gs").flatten().to_numpy(), part.column("gs").value_lengths().to_numpy()
                # the n-grams asked for, by row
                asked = np.unique(np.stack([np.repeat(np.arange(len(of)), of), gs]), axis=1) if len(gs) else np.zeros((2, 0), np.int64)
                mine = np.stack([row[at], g.view(np.int64)])
                keep = _in_pairs(mine, asked)
                at, g = at[keep], g[keep]
                begin = np.searchsorted(row, np.arange(len(x) + 1))
                lo = np.maximum(at - reach, begin[row[at]])
                hi = np.minimum(at + span, begin[row[at] + 1])
                base = off[row[at]]
                held: dict[tuple[int, bytes], list] = {}
                ks = part.column("k").to_numpy()
                for a, v, b0, b1, r, first in zip(at.tolist(), g.view(np.int64).tolist(), (base + s[lo]).tolist(), (base + e[hi - 1]).tolist(), row[at].tolist(), (at - lo).tolist()):
                    t = bytes(raw[b0:b1])
                    got = held.get((v, t))
                    if got is None:
                        held[v, t] = [first, [ks[r]], [a - begin[r]]]
                    else:
                        got[1].append(ks[r])
                        got[2].append(a - begin[r])
                yield pa.RecordBatch.from_arrays([
                    pa.array([v for v, _ in held], pa.int64()), pa.array([t for _, t in held], pa.binary()), pa.array([x[0] for x in held.values()], pa.int32()),
                    pa.array([x[1] for x in held.values()], pa.list_(pa.int64())), pa.array([x[2] for x in held.values()], pa.list_(pa.int32()))], ["g", "t", "l", "ks", "at"])

    met = src.join(wanted, "k").mapInArrow(surround, "g long, t binary, l int, ks array<long>, at array<int>").repartition("g").sortWithinPartitions("g")

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim_memory()
        yield from repeated_windows(batches, span)
        trim_memory()

    spans = met.mapInArrow(join, "k long, first_word long, end_word long")
    order = Window.partitionBy("k").orderBy("first_word", "end_word")
    reached = F.max("end_word").over(order.rowsBetween(Window.unboundedPreceding, -1))
    isle = F.sum(F.when(F.col("first_word") <= reached, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    # many windows of a span come from neighbouring n-grams: joined by document and island
    out = spans.distinct().withColumn("isle", isle).groupBy("k", "isle").agg(F.min("first_word").alias("first_word"), F.max("end_word").alias("end_word"))
    return out.select(F.col("k").alias(id_col), "first_word", "end_word")


def _in_pairs(mine: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Whether each column of ``mine`` is a column of ``asked``."""
    both = np.concatenate([mine, asked], axis=1)
    if not both.shape[1]:
        return np.zeros(0, bool)
    o = np.lexsort((both[1], both[0]))
    new = np.append(True, (both[:, o][:, 1:] != both[:, o][:, :-1]).any(axis=0))
    number = np.empty(len(o), np.int64)
    number[o] = np.cumsum(new)
    return np.isin(number[: mine.shape[1]], number[mine.shape[1] :])
