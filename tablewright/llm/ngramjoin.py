"""Exact self-join on n-gram Jaccard similarity: a prefix-tree join over one global order of n-grams.

1. Each document becomes its set of word n-grams (words lower case, ASCII punctuation dropped). Documents with equal sets
   are one set from here on, known by digest and size.
2. N-grams are dealt by hash to buckets, where all sets that hold one meet: its number of sets gives its place in the
   global order, rarest first, and n-grams of one set alone end here. Each n-gram gets a home, the least set that holds
   it, so that the n-grams of a group of near copies share a home. N-grams known to be in very many sets skip the
   buckets; each is its own home (a bounded broadcast names them, and decides places and homes alone, not the result).
3. Back at its set, the shared n-grams are put in order. Similarity t with any other set takes ceil(t |x|) of them; sets
   with fewer end here. Two sets of similarity t share t / (1 + t) (|x| + |y|) at least. So each may stay away from homes that
   have fewer than t / (1 + t) of its own n-grams together, and a home is left where both go; those with the fewest are left
   out. A set goes, with its n-grams, to the others, which for near copies is one or two however many n-grams they share with
   other texts.
4. At a home a trie stores the sets, commonest n-gram first, so that near copies share paths. One walk over the trie carries the
   overlap of all other sets with the path, and leaves a subtree where the lengths that remain on both sides can't reach t.
   A pair that meets at several homes counts at the least one. Links are counted and joined to classes there; pairs leave a
   home only where the caller asks for them.

A home of many sets is cut in blocks, and a task takes two blocks, so that memory is bounded; the links between sets that all
differ and are all similar are counted one by one, which takes time quadratic in such a group. Equal sets cost nothing more.

Results for odd input: null texts and texts without a word have no n-grams and are in no class; a text of fewer than n words
has one n-gram, of all its words; a text of any length is one set, held whole by one task; null ids are left out; rows that
repeat an id are documents of their own. An empty table gives no rows. Ids of any type that orders; other columns aren't
read (``one_of_each`` passes them through). N-grams are told apart by 40 bits of hash within a bucket.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec
from ._shared import byte_slices, col, discard, fresh, trim_memory, written

_EPS = 1e-9
#: Steps of the logarithm of an n-gram's number of sets in the global order, for each doubling; and the last place.
_STEPS, _LAST = 8, 255
_LOW40 = np.uint64((1 << 40) - 1)


def gram_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Each text's set of n-grams as 64-bit hashes, ascending."""
    h, row, _, _ = textvec.words(texts)
    g, row = textvec.grams(h, row, n)
    cut = np.searchsorted(row, np.arange(len(texts) + 1))
    for a, b in zip(cut, cut[1:]):
        yield np.unique(g[a:b])


def digest(s: np.ndarray) -> int:
    return int.from_bytes(blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def least_shared(size, t: float):
    """N-grams that a set of this size shares at least with any set of similarity t."""
    return np.ceil(t * np.asarray(size) - _EPS).astype(np.int64)


def spare(size, t: float):
    """N-grams that a set of this size can leave out of account: a pair of similarity t shares more than both together leave out."""
    return np.ceil(t / (1 + t) * np.asarray(size) - _EPS).astype(np.int64) - 1


def needed(a, b, t: float):
    """Least overlap at which sets of sizes a and b have similarity t."""
    return np.ceil(t / (1 + t) * (np.asarray(a) + np.asarray(b)) - _EPS)


def _spans(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Places start, start + 1 ... of each run, one run after another."""
    at = np.cumsum(count) - count
    return np.repeat(start - at, count) + np.arange(int(count.sum()))


class Trie:
    """Sets (ascending arrays of places in an order, 0 to ``universe``) as a trie. A node is a run of places that the sets
    ``order[lo:hi]`` all spell."""

    def __init__(self, sets: list[np.ndarray], universe: int):
        self.sets = sets
        self.length = np.array([len(s) for s in sets])
        spelled = [s.astype(">u4").tobytes() for s in sets]
        self.order = sorted(range(len(sets)), key=spelled.__getitem__)
        self.same = np.zeros(len(sets), np.int64)
        for i in range(1, len(sets)):
            a, b = sets[self.order[i - 1]], sets[self.order[i]]
            m = min(len(a), len(b))
            diff = a[:m] != b[:m]
            self.same[i] = diff.argmax() if diff.any() else m
        # of every place: the sets that hold it, and where in them
        flat = np.concatenate(sets)
        who = np.repeat(np.arange(len(sets)), self.length)
        o = np.argsort(flat, kind="stable")
        self.who, self.place = who[o], (np.arange(len(flat)) - np.repeat(np.cumsum(self.length) - self.length, self.length))[o]
        self.cut = np.searchsorted(flat[o], np.arange(universe + 1))

    def walk(self, sizes: np.ndarray, t: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(set, the others of similarity t, their overlaps). ``sizes``: of the whole sets, of which the trie may hold a part
        that includes all they share."""
        m = len(self.sets)
        stack = [(0, m, 0, np.zeros(m, np.int64), np.zeros(m, np.int64))]
        while stack:
            lo, hi, depth, shared, used = stack.pop()
            first = self.sets[self.order[lo]]
            end = int(self.same[lo + 1 : hi].min()) if hi - lo > 1 else len(first)
            if end > depth:
                run = first[depth:end]
                at = _spans(self.cut[run], self.cut[run + 1] - self.cut[run])
                who = self.who[at]
                shared = shared + np.bincount(who, minlength=m)
                used = used.copy()
                used[who] = self.place[at] + 1
            below = self.order[lo:hi]
            left = np.minimum(self.length - used, self.length[below].max() - end)
            fit = shared + left >= needed(sizes, sizes[below].min(), t)
            if hi - lo == 1:
                fit[below[0]] = False
            if not fit.any():
                continue
            at = lo
            while at < hi and self.length[self.order[at]] == end:
                i = self.order[at]
                hit = fit & (shared >= needed(sizes, sizes[i], t))
                hit[i] = False
                j = np.flatnonzero(hit)
                if len(j):
                    yield i, j, shared[j]
                at += 1
            while at < hi:
                stop = at + 1
                while stop < hi and self.same[stop] > end:
                    stop += 1
                stack.append((at, stop, end, shared, used))
                at = stop


def trie_join(sets: list[np.ndarray], t: float, sizes: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each set with the others of similarity t or more and its overlaps with them; elements in any one order, greatest commonest."""
    flat, inv = np.unique(np.concatenate(sets), return_inverse=True)
    cut = np.cumsum([0, *map(len, sets)])
    local = [np.sort(len(flat) - 1 - inv[a:b]) for a, b in zip(cut, cut[1:])]
    return Trie(local, len(flat)).walk(np.array([len(s) for s in sets]) if sizes is None else sizes, t)


def _rows(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)


def _packed(names: str, rows: list[tuple]) -> pa.RecordBatch:
    """Rows of a number and binaries."""
    columns = [*zip(*rows)] or [()] * len(names.split())
    return _rows(names.split(), pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:]))


def _joined(rows: list[dict], name: str, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(r[name] or b"", kind) for r in rows] or [np.zeros(0, kind)])


class _Dealer:
    """N-grams of sets, dealt to buckets in packed rows; a set that was dealt before isn't again."""

    NAMES = "b keys sizes counts lo hi"
    SCHEMA = "b int, keys binary, sizes binary, counts binary, lo binary, hi binary"

    def __init__(self, buckets: int, hot: np.ndarray, flush: int, remember: int):
        self.buckets, self.hot, self.flush_at, self.remember = buckets, hot, flush, remember
        self.seen: set[tuple[int, int]] = set()
        self.clear()

    def clear(self) -> None:
        self.keys, self.sets, self.held = [], [], 0

    def add(self, s: np.ndarray) -> bool:
        """Whether it is time to flush."""
        key = (digest(s), len(s))
        if key not in self.seen:
            if len(self.seen) >= self.remember:
                self.seen.clear()
            self.seen.add(key)
            self.keys.append(key[0]), self.sets.append(s)
            self.held += len(s)
        return self.held >= self.flush_at

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.sets:
            return
        keys, sizes = np.array(self.keys, np.int64), np.array([len(s) for s in self.sets], np.int32)
        flat, doc = np.concatenate(self.sets), np.repeat(np.arange(len(keys), dtype=np.int32), sizes)
        self.clear()
        out = []
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot["h"], flat), len(self.hot) - 1)
            known = self.hot["h"][at] == flat
            if known.any():
                b = (keys.view(np.uint64) % np.uint64(self.buckets)).astype(np.int32)[doc[known]]
                out += self._cut(b, doc[known], at[known], keys, sizes, True)
            flat, doc = flat[~known], doc[~known]
        b = ((flat >> np.uint64(32)) * np.uint64(self.buckets) >> np.uint64(32)).astype(np.int32)
        out += self._cut(b, doc, flat, keys, sizes, False)
        for a in range(0, len(out), 256):
            yield _packed(self.NAMES, out[a : a + 256])

    def _cut(self, b: np.ndarray, doc: np.ndarray, x: np.ndarray, keys: np.ndarray, sizes: np.ndarray, hot: bool) -> list[tuple]:
        o = np.argsort(b.astype(np.uint16) if self.buckets <= 65536 else b, kind="stable")  # sets stay in order within a bucket
        b, doc, x = b[o], doc[o], x[o]
        first = np.flatnonzero(np.append(True, b[1:] != b[:-1])) if len(b) else np.zeros(0, np.int64)
        rows = []
        for lo, hi in zip(first, [*first[1:], len(b)]):
            d, v = doc[lo:hi], x[lo:hi]
            start = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
            has = d[start]
            counts = np.diff(np.append(start, len(d))).astype(np.int32)
            rows.append((int(b[lo]), keys[has].tobytes(), sizes[has].tobytes(), counts.tobytes(), v.astype(np.uint32).tobytes(), None if hot else (v >> np.uint64(32)).astype(np.uint8).tobytes()))
        return rows


def _own_home(h: np.ndarray) -> np.ndarray:
    return (textvec.mix(h ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)


class _Bucket:
    """What one bucket says of its n-grams, sent back to the sets."""

    NAMES = "d b keys sizes counts step low mid homes"
    SCHEMA = "d int, b binary, keys binary, sizes binary, counts binary, step binary, low binary, mid binary, homes binary"

    def __init__(self, b: int, rows: list[dict], hot: np.ndarray, dests: int):
        self.dests = dests
        plain = [r for r in rows if r["hi"] is not None]
        known = [r for r in rows if r["hi"] is None]
        self.parts = [self._places(b, plain)]
        if known:
            keys, sizes, counts = (_joined(known, c, k) for c, k in (("keys", np.int64), ("sizes", np.int32), ("counts", np.int32)))
            _, first, inv = np.unique(np.rec.fromarrays([keys, sizes]), return_index=True, return_inverse=True)
            lead = np.zeros(len(keys), bool)
            lead[first] = True
            stays = np.repeat(lead, counts)
            rank = _joined(known, "lo", np.uint32)[stays]
            place = np.uint64(_LAST) << np.uint64(48) | rank.astype(np.uint64)
            self.parts.append((keys[first], sizes[first], np.repeat(inv, counts)[stays], place, _own_home(hot["h"][rank])))

    @staticmethod
    def _places(b: int, rows: list[dict]) -> tuple:
        """Keys and sizes of the sets, and of each n-gram that several hold: set, place in the global order, home."""
        keys, sizes, counts = (_joined(rows, c, k) for c, k in (("keys", np.int64), ("sizes", np.int32), ("counts", np.int32)))
        # equal sets come from several tasks; one counts
        o = np.lexsort((sizes, keys))
        new = np.append(True, (keys[o][1:] != keys[o][:-1]) | (sizes[o][1:] != sizes[o][:-1]))[: len(o)]
        own = np.full(len(keys), -1, np.int32)
        own[o[new]] = np.arange(int(new.sum()), dtype=np.int32)
        keys, sizes = keys[o[new]], sizes[o[new]]
        who = np.repeat(own, counts)
        bits = np.uint64(max(1, (len(keys) - 1).bit_length()))
        x = _joined(rows, "hi", np.uint8).astype(np.uint64)
        x <<= np.uint64(32)
        x |= _joined(rows, "lo", np.uint32)
        x <<= bits
        if (who < 0).any():
            x, who = x[who >= 0], who[who >= 0]
        x |= who.astype(np.uint64)
        x.sort()
        who = (x & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int32)
        x >>= bits
        start = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)
        number = np.diff(np.append(start, len(x)))
        home = np.minimum.reduceat((keys.view(np.uint64) >> np.uint64(32)).astype(np.uint32)[who], start) if len(x) else np.zeros(0, np.uint32)
        several = number > 1
        who = who[_spans(start[several], number[several])]
        number, home = number[several], home[several]
        step = np.minimum(_LAST - 1, (np.log2(number) * _STEPS).astype(np.uint64)) if len(number) else number.astype(np.uint64)
        place = step << np.uint64(48) | np.uint64(b) << np.uint64(24) | np.arange(len(number), dtype=np.uint64)
        return keys, sizes, who, np.repeat(place, number), np.repeat(home, number)

    def rows(self) -> Iterator[pa.RecordBatch]:
        out = []
        for keys, sizes, who, place, home in self.parts:
            dest = (keys.view(np.uint64) % np.uint64(self.dests)).astype(np.int64)
            o = np.lexsort((home, who, dest[who]))
            who, place, home = who[o], place[o], home[o]
            d = dest[who]
            first = np.flatnonzero(np.append(True, d[1:] != d[:-1])) if len(d) else np.zeros(0, np.int64)
            for lo, hi in zip(first, [*first[1:], len(d)]):
                w = who[lo:hi]
                start = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
                counts = np.diff(np.append(start, len(w))).astype(np.int32)
                p = place[lo:hi]
                planes = (p >> np.uint64(48)).astype(np.uint8), p.astype(np.uint16), (p >> np.uint64(16)).astype(np.uint8), home[lo:hi]
                b = (p[:1] >> np.uint64(24) & np.uint64(0xFFFFFF)).tobytes()
                out.append((int(d[lo]), b, keys[w[start]].tobytes(), sizes[w[start]].tobytes(), counts.tobytes(), *(x.tobytes() for x in planes)))
        for a in range(0, len(out), 256):
            yield _packed(self.NAMES, out[a : a + 256])


_MET = "home long, part long, key long, size int, toks binary, less binary, side int"


def _route(rows: list[dict], t: float, block: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sets with enough shared n-grams, one row for each home that they go to."""
    import zstandard

    z = zstandard.ZstdCompressor(level=1)
    keys, sizes, counts = (_joined(rows, c, k) for c, k in (("keys", np.int64), ("sizes", np.int32), ("counts", np.int32)))
    bucket = np.repeat(_joined(rows, "b", np.uint64), [len(r["step"]) for r in rows])
    step = _joined(rows, "step", np.uint8).astype(np.int64)
    place = step.astype(np.uint64) << np.uint64(48) | bucket << np.uint64(24) | _joined(rows, "mid", np.uint8).astype(np.uint64) << np.uint64(16) | _joined(rows, "low", np.uint16)
    home = _joined(rows, "homes", np.uint32)
    o = np.lexsort((sizes, keys))
    new = np.append(True, (keys[o][1:] != keys[o][:-1]) | (sizes[o][1:] != sizes[o][:-1]))[: len(o)]
    own = np.empty(len(keys), np.int64)
    own[o] = np.cumsum(new) - 1
    keys, sizes = keys[o[new]], sizes[o[new]]
    who = np.repeat(own, counts)
    k = (np.bincount(who, minlength=len(keys)) >= least_shared(sizes, t))[who]
    who, place, home, step = who[k], place[k], home[k].astype(np.int64), step[k]
    # n-grams in more sets than a block holds have their home apart by the step of their place, which gives the number of blocks
    number = 2.0 ** ((step + 1) / _STEPS)
    if len(hot):
        number = np.where(step == _LAST, hot["n"][np.where(step == _LAST, place & np.uint64(0xFFFFFFFF), 0).astype(np.int64)], number)
    blocks = np.ceil(np.maximum(number / block, 1)).astype(np.int64)
    home = np.where(blocks > 1, textvec.mix((home + (step << 32)).view(np.uint64)).view(np.int64) | np.int64(1 << 62), home)
    # homes of each set with the number of its n-grams there, the fewest first, as long as a pair can spare them
    o = np.lexsort((home, who))
    w, h = who[o], home[o]
    first = np.flatnonzero(np.append(True, (w[1:] != w[:-1]) | (h[1:] != h[:-1]))) if len(o) else np.zeros(0, np.int64)
    w, h, has, most = w[first], h[first], np.diff(np.append(first, len(o))), np.maximum.reduceat(blocks[o], first) if len(o) else blocks
    o = np.lexsort((h, has, w))
    before = np.concatenate([[0], np.cumsum(has[o])])
    spent = before[1:] - before[np.searchsorted(w[o], w[o])]
    goes = np.zeros(len(w), bool)
    goes[o] = spent > spare(sizes[w[o]], t)
    w, h, most = w[goes], h[goes], most[goes]  # by set and home
    o = np.lexsort((place, who))
    who, place = who[o], place[o]
    out = []
    lo, hi = np.searchsorted(who, w), np.searchsorted(who, w, side="right")
    begin = np.searchsorted(w, w)
    toks = b""
    for i in range(len(w)):
        if begin[i] == i:
            p = place[lo[i] : hi[i]]
            toks = z.compress((p >> np.uint64(32)).astype(np.uint32).tobytes() + p.astype(np.uint32).tobytes())
        n = int(most[i])
        mine = int(textvec.mix(keys[w[i] : w[i] + 1].view(np.uint64))[0] % np.uint64(n)) if n > 1 else 0
        for other in range(n):
            out.append((h[i], min(mine, other) << 32 | max(mine, other), keys[w[i]], sizes[w[i]], toks, h[begin[i] : i].tobytes(), mine))
            if len(out) >= 4096:
                yield _met(out)
                out = []
    yield _met(out)


def _met(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int32())
    return _rows(["home", "part", "key", "size", "toks", "less", "side"], *(pa.array(c, k) for c, k in zip([*zip(*out)] or [()] * 7, kinds)))


def _home_links(part: int, rows: list[tuple], t: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(set, its links that count at this home, overlaps) by place among the rows (key, size, toks, less, side)."""
    import zstandard

    z = zstandard.ZstdDecompressor()
    sets = []
    for r in rows:
        x = np.frombuffer(z.decompress(r[2]), np.uint32)
        sets.append(x[: len(x) // 2].astype(np.uint64) << np.uint64(32) | x[len(x) // 2 :].astype(np.uint64))
    sizes = np.array([r[1] for r in rows], np.int64)
    # sets of one block meet among themselves where both blocks are that one
    side = np.array([r[4] for r in rows]) if part >> 32 != part & 0xFFFFFFFF else None
    before: dict[int, list[int]] = {}
    for i, r in enumerate(rows):
        for h in np.frombuffer(r[3], np.int64).tolist():
            before.setdefault(h, []).append(i)
    earlier: dict[int, list[np.ndarray]] = {}
    for members in before.values():
        if len(members) > 1:
            at = np.array(members)
            for i in members:
                earlier.setdefault(i, []).append(at)
    for i, j, shared in trie_join(sets, t, sizes):
        keep = np.ones(len(j), bool)
        if side is not None:
            keep &= side[j] != side[i]
        if i in earlier:
            met = np.zeros(len(rows), bool)
            for at in earlier[i]:
                met[at] = True
            keep &= ~met[j]
        if keep.any():
            yield i, j[keep], shared[keep]


def _frequent(local: DataFrame, frequent: int, least: int) -> np.ndarray:
    """At most ``frequent`` n-grams that were counted ``least`` times or more, by hash, with their counts."""
    got = local.groupBy("g").agg(F.sum("n").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "g").limit(frequent).toArrow()
    out = np.zeros(len(got), [("h", "u8"), ("n", "f8")])
    out["h"], out["n"] = got["g"].to_numpy().view(np.uint64), got["n"].to_numpy()
    return np.sort(out, order="h")


class _Join:
    """The join's state: ``seen`` (k, x, g, size): each document with a hash of its text and its set's digest and size; ``met``:
    sets at homes."""

    def __init__(self, docs: DataFrame, t: float, n: int, bucket_grams: int, block: int, frequent: int, hot_least: int, id_col: str, text_col: str):
        spark = docs.sparkSession
        id_type = docs.select(col(id_col)).schema[0].dataType.simpleString()
        text = col(text_col).cast("string")
        src = docs.select(col(id_col).alias("k"), F.xxhash64(text).alias("h"), text.alias("x")).where("k IS NOT NULL AND x IS NOT NULL")

        def survey(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Digest and size of each set (n null), and n-grams that several sets of a run of texts have."""
            for batch in batches:
                for part in byte_slices(batch, "x", 8 << 20):
                    sets = list(gram_sets(part.column("x"), n))
                    has = np.array([len(s) > 0 for s in sets], bool)
                    sets = [s for s in sets if len(s)]
                    g, size = np.array([digest(s) for s in sets], np.int64), np.array([len(s) for s in sets], np.int32)
                    k = part.column("k").filter(pa.array(has))
                    yield _rows(["k", "h", "g", "n", "size"], k, part.column("h").filter(pa.array(has)), g, pa.nulls(len(g), pa.int64()), size)
                    different = [sets[i] for i in np.unique(g, return_index=True)[1]]
                    flat = np.sort(np.concatenate(different)) if different else np.zeros(0, np.uint64)
                    first = np.flatnonzero(np.append(True, flat[1:] != flat[:-1])) if len(flat) else np.zeros(0, np.int64)
                    count = np.diff(np.append(first, len(flat)))
                    many = count >= 5
                    m = int(many.sum())
                    yield _rows(["k", "h", "g", "n", "size"], pa.nulls(m, k.type), pa.nulls(m, pa.int64()), flat[first[many]].view(np.int64), count[many].astype(np.int64), pa.nulls(m, pa.int32()))

        all_seen = written(src.mapInArrow(survey, f"k {id_type}, h long, g long, n long, size int"), "ngram-survey")
        self.seen = all_seen.where("n IS NULL").select("k", "h", "g", "size")
        total = self.seen.agg(F.sum("size")).first()[0] or 0
        buckets = max(1, math.ceil(total / bucket_grams))
        hot = spark.sparkContext.broadcast(_frequent(all_seen.where("n IS NOT NULL").select("g", "n"), frequent, hot_least))

        def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            dealer = _Dealer(buckets, hot.value, 4_000_000, 1_000_000)
            trim_memory()
            for batch in batches:
                for part in byte_slices(batch, "x", 8 << 20):
                    for s in gram_sets(part.column("x"), n):
                        if len(s) and dealer.add(s):
                            yield from dealer.flush()
            yield from dealer.flush()

        def places(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trim_memory()
            held: dict[int, list[dict]] = {}  # one bucket, or few small ones
            for batch in batches:
                for r in batch.to_pylist():
                    held.setdefault(r["b"], []).append(r)
            while held:
                yield from _Bucket(*held.popitem(), hot.value, buckets).rows()

        def route(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trim_memory()
            yield from _route([r for batch in batches for r in batch.to_pylist()], t, block, hot.value)

        dealt = src.select("x").mapInArrow(deal, _Dealer.SCHEMA).repartitionById(buckets, "b")
        placed = dealt.mapInArrow(places, _Bucket.SCHEMA).repartitionById(buckets, "d")
        self.met = placed.mapInArrow(route, _MET).repartition("home", "part").sortWithinPartitions("home", "part", "key")
        self.t, self.id_col = t, id_col

    def at_homes(self, of, schema: str) -> DataFrame:
        """Rows that ``of(keys, sizes, links)`` makes at each home with several sets."""
        t = self.t

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trim_memory()
            last, rows = (0, 0), []

            def flush() -> Iterator[pa.RecordBatch]:
                if len(rows) > 1:
                    keys, sizes = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
                    yield from of(keys, sizes, _home_links(last[1], rows, t))

            for batch in batches:
                for home, part, *r in zip(*(batch.column(c).to_pylist() for c in ("home", "part", "key", "size", "toks", "less", "side"))):
                    if (home, part) != last:
                        yield from flush()
                        last, rows = (home, part), []
                    rows.append(r)
            yield from flush()

        return self.met.mapInArrow(run, schema)


def _linked(keys: np.ndarray, sizes: np.ndarray, links) -> Iterator[pa.RecordBatch]:
    """(key, links, root): sets with links at a home, their number, and the least set that links at this home lead to."""
    number, label = np.zeros(len(keys), np.int64), np.arange(len(keys))
    for i, j, _ in links:
        number[i] += len(j)
        all_of = np.unique(label[np.append(j, i)])
        if len(all_of) > 1:
            label[np.isin(label, all_of)] = all_of[0]
    at = np.flatnonzero(number)
    if len(at):
        o = at[np.lexsort((keys[at], label[at]))]  # the least key of each label comes first
        first = np.append(True, np.diff(label[o]) != 0)
        root = keys[o[first]][np.cumsum(first) - 1]
        yield _rows(["key", "links", "root"], keys[o], number[o], root)


def _pairs(t: float):
    def of(keys: np.ndarray, sizes: np.ndarray, links) -> Iterator[pa.RecordBatch]:
        for i, j, shared in links:
            k = keys[j] > keys[i]
            j, shared = j[k], shared[k]
            if len(j):
                yield _rows(["a", "b", "jaccard"], np.full(len(j), keys[i]), keys[j], shared / (sizes[i] + sizes[j] - shared))

    return of


def near_duplicates(docs: DataFrame, t: float = 0.5, n: int = 3, bucket_grams: int = 8_000_000, block: int = 4096, frequent: int = 1 << 20, hot_least: int = 50_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id, n_links, n_copies) of every document that has another of similarity t or more: the least id of those that
    links lead to, the number of different n-gram sets of similarity t, and the number of other documents with an equal set."""
    return _classes(docs, t, n, bucket_grams, block, frequent, hot_least, id_col, text_col).select(F.col("k").alias(id_col), "class_id", "n_links", "n_copies")


def _classes(docs: DataFrame, t: float, n: int, bucket_grams: int, block: int, frequent: int, hot_least: int, id_col: str, text_col: str) -> DataFrame:
    join = _Join(docs, t, n, bucket_grams, block, frequent, hot_least, id_col, text_col)
    near = written(join.at_homes(_linked, "key long, links long, root long"), "ngram-links")
    roots = components(near.where("key <> root").select(F.col("key").alias("id_a"), F.col("root").alias("id_b"))).select(F.col("id").alias("g"), "root")
    number = near.groupBy(F.col("key").alias("g")).agg(F.sum("links").alias("n_links"))
    sets = join.seen.groupBy("g", "size").agg(F.min("k").alias("first"), F.count(F.lit(1)).alias("copies"))
    sets = sets.join(number, "g", "left").join(roots, "g", "left").where("copies > 1 OR n_links IS NOT NULL")
    sets = written(sets.select("g", "size", "first", "copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("root", "g").alias("root")), "ngram-sets")
    least = sets.groupBy("root").agg(F.min("first").alias("class_id"))
    sets = sets.join(least, "root").select("g", "size", "class_id", "n_links", (F.col("copies") - 1).alias("n_copies"))
    return join.seen.join(sets, ["g", "size"]).select("k", "h", "class_id", "n_links", "n_copies")


def similar_pairs(docs: DataFrame, t: float = 0.5, n: int = 3, bucket_grams: int = 8_000_000, block: int = 4096, frequent: int = 1 << 20, hot_least: int = 50_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_a, id_b, jaccard), id_a < id_b: pairs of similarity t or more between the least ids of different sets, and each other
    id of a set with its least."""
    join = _Join(docs, t, n, bucket_grams, block, frequent, hot_least, id_col, text_col)
    first = join.seen.groupBy("g", "size").agg(F.min("k").alias("first"))
    a, b = (first.select(F.col("g").alias(c), F.col("first").alias("id_" + c)) for c in "ab")
    near = join.at_homes(_pairs(t), "a long, b long, jaccard double").join(a, "a").join(b, "b")
    near = near.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), "jaccard")
    equal = join.seen.join(first, ["g", "size"]).select(F.col("first").alias("id_a"), F.col("k").alias("id_b"), F.lit(1.0).alias("jaccard"))
    return near.unionByName(equal).where("id_a < id_b").groupBy("id_a", "id_b").agg(F.max("jaccard").alias("jaccard"))


def components(pairs: DataFrame, a: str = "id_a", b: str = "id_b") -> DataFrame:
    """(id, root): for every id in a pair, the least id that pairs lead to. Labels spread over edges and jump to their
    label's label until none changes; each round is written in the shared folder."""
    edges = pairs.select(F.col(a).alias("u"), F.col(b).alias("v"))
    edges = written(edges.union(edges.select("v", "u")).distinct(), "cc-edges")
    labels = written(edges.groupBy("u").agg(F.least("u", F.min("v")).alias("root")), "cc-labels")
    while True:
        heard = edges.join(labels.withColumnsRenamed({"u": "v", "root": "r"}), "v").groupBy("u").agg(F.min("r").alias("r"))
        step = labels.join(heard, "u").select("u", F.least("root", "r").alias("new"), F.col("root").alias("old"))
        jump = step.select(F.col("u").alias("new"), F.col("new").alias("far"))
        step = step.join(jump, "new", "left").select("u", F.least("new", F.coalesce("far", "new")).alias("root"), "old")
        step = written(step, "cc-labels")
        discard(labels)
        labels = step
        if not step.where("root <> old").limit(1).count():
            return labels.select(F.col("u").alias("id"), "root")
        labels = step.select("u", "root")
        labels.shared_path = step.shared_path


def one_of_each(docs: DataFrame, t: float = 0.5, n: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns, without those of a class that aren't its least id: one of each class stays. Documents
    in no class stay, those with null ids, null texts and texts without a word among them. A document is known by its id and a hash of its text."""
    gone = _classes(docs, t, n, 8_000_000, 4096, 1 << 20, 50_000, id_col, text_col).where("k <> class_id")
    k, h = fresh(docs, "gone_id"), fresh(docs, "gone_hash")
    gone = gone.select(F.col("k").alias(k), F.col("h").alias(h)).distinct()
    return docs.join(gone, (col(id_col) == F.col(k)) & (F.xxhash64(col(text_col).cast("string")) == F.col(h)), "left_anti")
