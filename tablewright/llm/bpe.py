"""Byte-level BPE by recursive DuckDB queries, one in-process database per Spark partition.

Encoding: pieces of the pre-tokeniser become token-position rows; a recursive query joins neighbouring rows with the
merge table and contracts, in each word, the leftmost pair of least rank until no pair can be merged. A word is contracted in
runs of 64 bytes, whose tokens are then joined: where two runs' tokens don't stand next to each other, those around the
border are contracted anew. So text without a blank takes memory and time in proportion to its length. Decoding: an
ordered aggregation lists a document's tokens, whose bytes are joined.

Results for odd input: a null text has null tokens and null decoded text, an empty text has an empty list and an empty
string; a text may be of any length, with or without blanks. Repeated rows are kept, each with its own result. Other columns of the input aren't read.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain
from operator import eq, methodcaller

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ._shared import byte_slices, col, tokenizer_file, trim_memory

#: Split of text before merges, as published with the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Blanks at which a text can't be cut: white space on both sides, or at the end behind other white space.
ODD = re.compile(r"\s \s|\s \Z").search
#: Entries of a partition's chunk cache at which it is emptied, and half of those of its piece cache; results don't depend on it.
CACHE_ENTRIES = 250_000
#: A piece is contracted in runs of so many bytes.
RUN = 64
#: Bytes in a recursive query, and its rounds; what isn't at its end after those goes on in another.
QUERY_BYTES, ROUNDS = 100_000, 64
#: Pieces that are contracted before the next ones are looked at.
PIECES = 10_000
#: Tokens in a decoding query; a text of more is put together from several.
DECODE_TOKENS = 1_000_000

_CONTRACT_SQL = f"""
WITH RECURSIVE s(i, g, t) AS (
  SELECT 0, g, t FROM tokens_in
  UNION ALL
  (WITH pairs AS (SELECT i, g, t, lead(t) OVER o AS nt, lead(g) OVER o AS ng FROM s WINDOW o AS (ORDER BY g)),
   fit AS (SELECT p.g, p.ng, m.n::BIGINT << 32 | (p.g & 4294967295) AS k
           FROM pairs p JOIN merges m ON p.t = m.l AND p.nt = m.r WHERE p.g >> 32 = p.ng >> 32 AND p.i < {ROUNDS}),
   least AS (SELECT g >> 32 AS w, min(k) AS k, arg_min(ng, k) AS ng FROM fit GROUP BY g >> 32)
   SELECT i + 1, s.g, CASE WHEN s.g & 4294967295 = k & 4294967295 THEN (k >> 32)::INT ELSE t END
   FROM s JOIN least ON s.g >> 32 = least.w WHERE s.g <> least.ng)
) SELECT i, g, t FROM s"""

_DECODE_SQL = "SELECT doc, list(t ORDER BY pos) AS t FROM doc_tokens GROUP BY doc"


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a vocabulary file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_table(ranks: dict[bytes, int]) -> pa.Table:
    """Tokens that can be merged, left and right, and what they become."""
    left, right, new = [], [], []
    for tok, i in ranks.items():
        for k in range(1, len(tok)):
            a, b = ranks.get(tok[:k]), ranks.get(tok[k:])
            if a is not None and b is not None:
                left.append(a), right.append(b), new.append(i)
    return pa.table({"l": pa.array(left, pa.int32()), "r": pa.array(right, pa.int32()), "n": pa.array(new, pa.int32())})


@lru_cache(maxsize=1)
def _vocabulary(path: str, changed: int, size: int) -> tuple[dict[bytes, int], pa.Table]:
    """Ranks and merges of a file as it was at a time; a Python worker makes them once for all its partitions."""
    ranks = load_ranks(path)
    return ranks, merge_table(ranks)


def load_vocabulary(path: str) -> tuple[dict[bytes, int], pa.Table]:
    """Ranks and merges of a vocabulary file as it is now."""
    at = os.stat(path)
    return _vocabulary(path, at.st_mtime_ns, at.st_size)


#: Flat tokens, or bytes of tokens; first place and number by entry.
_Table = tuple[np.ndarray, np.ndarray, np.ndarray]
_EMPTY: _Table = (np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64))


def _extend(table: _Table, flat: np.ndarray, size: np.ndarray) -> _Table:
    return np.concatenate([table[0], flat]), np.concatenate([table[1], len(table[0]) + np.cumsum(size) - size]), np.concatenate([table[2], size])


def _gather(table: _Table, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of the entries, one after another, and their number by entry."""
    size = table[2][ids]
    at = np.cumsum(size) - size
    return table[0][np.repeat(table[1][ids] - at, size) + np.arange(int(size.sum()))], size


def _sums(size: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of runs of n entries."""
    return np.diff(np.concatenate([[0], np.cumsum(size)])[np.cumsum(n)], prepend=0) if len(n) else n


class Codec:
    """Encoder and decoder of one partition. ``encode`` takes texts, ``decode`` a flat token array and lengths."""

    def __init__(self, ranks: dict[bytes, int], cache_entries: int = CACHE_ENTRIES, merges: pa.Table | None = None):
        import duckdb
        import regex

        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "256MB", "temp_directory": ""})
        self.con.register("loading", merge_table(ranks) if merges is None else merges)
        self.con.execute("CREATE TABLE merges AS SELECT * FROM loading")
        self.con.unregister("loading")
        self.byte_rank = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.bytes_of = {i: t for t, i in ranks.items()}
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        size[list(ranks.values())] = list(map(len, ranks))
        self.byte_table = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(len(size))), np.uint8), np.cumsum(size) - size, size
        self.stands: dict[tuple[int, int], bool] = {}
        self.find = regex.compile(PATTERN).findall
        self.cache_entries = cache_entries
        self._clear_chunks()
        self._clear_pieces()

    def _clear_chunks(self) -> None:
        self.firsts: dict[str, int] = {}
        self.chunks: dict[str, int] = {}
        self.chunk_table = _EMPTY

    def _clear_pieces(self) -> None:
        self.pieces: dict[str, int] = {}
        self.piece_table = _EMPTY

    def _contract(self, flat: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words of tokens, one after another, and their sizes, contracted until no pair of any can be merged."""
        ends = np.cumsum(size)
        where, order, tokens, more = [], [], [], []
        lo = 0
        while lo < len(size):
            base = ends[lo] - size[lo]
            hi = max(lo + 1, int(np.searchsorted(ends, base + QUERY_BYTES, side="right")))
            n = size[lo:hi]
            w = np.repeat(np.arange(hi - lo, dtype=np.int64), n)
            p = np.arange(len(w), dtype=np.int64) - np.repeat(np.cumsum(n) - n, n)
            self.con.register("tokens_in", pa.table({"g": w << 32 | p, "t": flat[base : ends[hi - 1]]}))
            got = self.con.sql(_CONTRACT_SQL).to_arrow_table()
            self.con.unregister("tokens_in")
            i, g, t = (got[c].to_numpy() for c in ("i", "g", "t"))
            w = g >> 32
            last = np.zeros(hi - lo, i.dtype)
            np.maximum.at(last, w, i)
            k = i == last[w]  # what is left after a word's last contraction
            where.append(lo + w[k]), order.append(g[k]), tokens.append(t[k].astype(np.int32))
            more.append(lo + np.flatnonzero(last == ROUNDS))
            lo = hi
        if not where:
            return flat, size
        at, place, flat = map(np.concatenate, (where, order, tokens))
        o = np.lexsort((place, at))
        flat, size, more = flat[o], np.bincount(at, minlength=len(size)), np.concatenate(more)
        if not len(more):
            return flat, size
        # the others are done; these go on from where they are
        mine = np.isin(np.arange(len(size)), more)
        part, n = self._contract(flat[np.repeat(mine, size)], size[more])
        done, kept = flat[np.repeat(~mine, size)], size.copy()
        kept[more] = n
        out = np.empty(int(kept.sum()), np.int32)
        of = np.repeat(mine, kept)
        out[of], out[~of] = part, done
        return out, kept

    def _words(self, words: list[np.ndarray]) -> list[np.ndarray]:
        flat, size = self._contract(np.concatenate(words) if words else self.byte_rank[:0], np.array([len(x) for x in words], np.int64))
        return np.split(flat, np.cumsum(size)[:-1]) if words else []

    def _stand(self, pairs: set[tuple[int, int]]) -> None:
        """Learn of each pair of tokens whether they stay as they are next to each other."""
        fresh = [p for p in pairs if p not in self.stands]
        words = self._words([self.byte_rank[np.frombuffer(self.bytes_of[a] + self.bytes_of[b], np.uint8)] for a, b in fresh])
        self.stands.update((p, tuple(x.tolist()) == p) for p, x in zip(fresh, words))

    def _stitch(self, parts: list[list[np.ndarray]]) -> list[np.ndarray]:
        """Tokens of texts whose consecutive runs have the tokens ``parts``. A list of tokens is that of its text if each two
        neighbours stay as they are when contracted alone: the first merge across a border would be made in the two as well.
        Where two runs meet otherwise, the tokens around are made anew, more and more of them until both ends stand."""
        while any(len(p) > 1 for p in parts):
            jobs = [(i, j) for i, p in enumerate(parts) for j in range(0, len(p) - 1, 2)]
            self._stand({(int(parts[i][j][-1]), int(parts[i][j + 1][0])) for i, j in jobs})
            done: dict[tuple[int, int], np.ndarray] = {}
            todo = []
            for i, j in jobs:
                a, b = parts[i][j], parts[i][j + 1]
                if self.stands[int(a[-1]), int(b[0])]:
                    done[i, j] = np.concatenate([a, b])
                else:
                    todo.append((i, j))
            around = 2
            while todo:
                raw = [np.concatenate([np.frombuffer(self.bytes_of[int(t)], np.uint8) for t in (*parts[i][j][-around:], *parts[i][j + 1][:around])]) for i, j in todo]
                mid = self._words([self.byte_rank[x] for x in raw])
                ends = []
                for (i, j), x in zip(todo, mid):
                    a, b = parts[i][j], parts[i][j + 1]
                    ends.append(([(int(a[-around - 1]), int(x[0]))] if len(a) > around else []) + ([(int(x[-1]), int(b[around]))] if len(b) > around else []))
                self._stand({p for e in ends for p in e})
                later = []
                for (i, j), x, e in zip(todo, mid, ends):
                    if all(self.stands[p] for p in e):
                        done[i, j] = np.concatenate([parts[i][j][:-around], x, parts[i][j + 1][around:]])
                    else:
                        later.append((i, j))
                todo, around = later, around * 2
            parts = [[done[i, j] if j + 1 < len(p) else p[j] for j in range(0, len(p), 2)] for i, p in enumerate(parts)]
        return [p[0] for p in parts]

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat tokens of the pieces and their number by piece, by the recursive queries, some pieces at a time."""
        done = [self._encode_some(pieces[a : a + PIECES]) for a in range(0, len(pieces), PIECES)]
        return (np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])) if done else (self.byte_rank[:0], np.zeros(0, np.int64))

    def _encode_some(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.stands) > self.cache_entries:
            self.stands.clear()
        words = [p.encode() for p in pieces]
        runs: dict[bytes, int] = {}
        long, cut = [], []
        for i, raw in enumerate(words):
            if len(raw) > RUN:
                long.append(i), cut.append([runs.setdefault(raw[a : a + RUN], len(pieces) + len(runs)) for a in range(0, len(raw), RUN)])
                words[i] = b""
        words += runs
        data = np.frombuffer(b"".join(words), np.uint8)
        flat, size = self._contract(self.byte_rank[data], np.fromiter(map(len, words), np.int64, len(words)))
        if not long:
            return flat, size
        made = flat, np.cumsum(size) - size, size
        whole = self._stitch([[_gather(made, np.array([r]))[0] for r in c] for c in cut])
        made = _extend(made, np.concatenate(whole), np.array([len(x) for x in whole], np.int64))
        ids = np.arange(len(pieces))
        ids[long] = len(words) + np.arange(len(long))
        return _gather(made, ids)

    def _split(self, chunks: list[str]) -> tuple[list[str], np.ndarray]:
        """Pieces of chunks that each follow a blank, one after another, and their number by chunk. No chunk holds a
        blank, so in one string of them all each piece with a blank begins a chunk; those with white space at an end
        are split by themselves."""
        plain = np.fromiter(map(eq, chunks, map(str.strip, chunks)), bool, len(chunks)) & np.fromiter(map(bool, chunks), bool, len(chunks))
        joined = self.find("".join([" " + c for c, k in zip(chunks, plain) if k]))
        begins = np.flatnonzero(np.fromiter(map(methodcaller("startswith", " "), joined), bool, len(joined)))
        n = np.zeros(len(chunks), np.int64)
        n[plain] = np.diff(np.append(begins, len(joined)))
        if plain.all():
            return joined, n
        out, at = [], 0
        for i, (c, k) in enumerate(zip(chunks, plain)):
            if k:
                out.append(joined[at : at + n[i]])
                at += n[i]
            else:
                out.append(self.find(" " + c))
                n[i] = len(out[-1])
        return list(chain.from_iterable(out)), n

    def _learn(self, firsts: list[str], chunks: list[str]) -> None:
        """Tokens of chunks not met before: those at the start of a text and those after a blank."""
        heads = [self.find(x) for x in firsts]
        tail, n_tail = self._split(chunks)
        pieces = [*chain.from_iterable(heads), *tail]
        fresh = [p for p in dict.fromkeys(pieces) if p not in self.pieces]
        self.piece_table = _extend(self.piece_table, *self.encode_pieces(fresh))
        self.pieces.update(zip(fresh, range(len(self.pieces), len(self.pieces) + len(fresh))))
        base = len(self.firsts) + len(self.chunks)
        self.firsts.update(zip(firsts, range(base, base + len(firsts))))
        self.chunks.update(zip(chunks, range(base + len(firsts), base + len(firsts) + len(chunks))))
        flat, size = _gather(self.piece_table, np.fromiter(map(self.pieces.__getitem__, pieces), np.int64, len(pieces)))
        n = np.concatenate([np.fromiter(map(len, heads), np.int64, len(heads)), n_tail])
        self.chunk_table = _extend(self.chunk_table, flat, _sums(size, n))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat tokens and their number by text. A text is cut at single blanks, where no piece can cross; texts with
        runs of white space that a cut would divide are split as a whole."""
        if len(self.firsts) + len(self.chunks) > self.cache_entries:
            self._clear_chunks()
        if len(self.pieces) > 2 * self.cache_entries:
            self._clear_pieces()
        odd = np.array([bool(x) and ODD(x) is not None for x in texts], bool)
        cut = pc.split_pattern(pa.array([None if k else x or None for x, k in zip(texts, odd)], pa.string()), " ")
        n = pc.fill_null(pc.list_value_length(cut), 0).to_numpy().astype(np.int64)
        n[odd] = 1
        begins = np.zeros(int(n.sum()), bool)
        begins[(np.cumsum(n) - n)[n > 0]] = True
        heads = [x if k else x.partition(" ")[0] for x, k in zip(texts, odd) if x]
        tails = cut.flatten().filter(pa.array(~np.delete(begins, (np.cumsum(n) - n)[odd]))).dictionary_encode()
        rest = tails.dictionary.to_numpy(zero_copy_only=False).tolist()
        firsts = [c for c in dict.fromkeys(heads) if c not in self.firsts]
        fresh = [c for c in rest if c not in self.chunks]
        if firsts or fresh:
            self._learn(firsts, fresh)
        ids = np.empty(len(begins), np.int64)
        ids[begins] = np.fromiter(map(self.firsts.__getitem__, heads), np.int64, len(heads))
        ids[~begins] = np.fromiter(map(self.chunks.__getitem__, rest), np.int64, len(rest))[tails.indices.to_numpy()]
        flat, size = _gather(self.chunk_table, ids)
        return flat, _sums(size, n)

    def decode(self, flat: np.ndarray, count: np.ndarray) -> list[str]:
        """Texts of token lists that lie one after another."""
        parts: list[list[bytes]] = [[] for _ in count]
        doc = np.repeat(np.arange(len(count), dtype=np.int32), count)
        for lo in range(0, len(flat), DECODE_TOKENS):
            t = flat[lo : lo + DECODE_TOKENS]
            self.con.register("doc_tokens", pa.table({"doc": doc[lo : lo + len(t)], "pos": np.arange(len(t), dtype=np.int32), "t": t}))
            got = self.con.sql(_DECODE_SQL).to_arrow_table()
            self.con.unregister("doc_tokens")
            for part in got.to_batches():
                data, size = _gather(self.byte_table, part["t"].flatten().to_numpy())
                ends = np.cumsum(_sums(size, pc.list_value_length(part["t"]).to_numpy()))
                for i, x in zip(part["doc"].to_pylist(), np.split(data, ends[:-1])):
                    parts[i].append(x.tobytes())
        return [b"".join(x).decode("utf-8", "replace") for x in parts]


def encode_decode(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, token_ids, n_tokens, decoded) of every row. ``vocabulary``: rank file, readable on every executor."""
    path = vocabulary or tokenizer_file()
    id_type = docs.select(col(id_col)).schema[0].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        trim_memory()
        for batch in batches:
            for part in byte_slices(batch, "x", 2 << 20):
                if codec is None:
                    ranks, merges = load_vocabulary(path)
                    codec = Codec(ranks, merges=merges)
                texts = part.column("x").to_pylist()
                flat, count = codec.encode(texts)
                decoded = codec.decode(flat, count)
                null = np.array([x is None for x in texts], bool)
                ends = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
                offsets = pa.array(ends, pa.int32(), mask=np.append(null, False))
                yield pa.RecordBatch.from_arrays(
                    [part.column("k"), pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32())), pa.array(count.astype(np.int32), pa.int32(), mask=null), pa.array([None if n else x for x, n in zip(decoded, null)], pa.string())],
                    ["k", "token_ids", "n_tokens", "decoded"],
                )

    out = docs.select(col(id_col).alias("k"), col(text_col).cast("string").alias("x")).mapInArrow(run, f"k {id_type}, token_ids array<int>, n_tokens int, decoded string")
    return out.withColumnRenamed("k", id_col)
