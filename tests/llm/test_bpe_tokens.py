import base64
import random

import numpy as np
import pytest

from tablewright.llm import bpe, tokencount
from tablewright.llm._shared import tokenizer_file

RANKS = bpe.load_ranks(tokenizer_file())
SCHEMA = "doc_id long, text string, token_ids int, decoded string, k string, x int"


def encoding():
    import tiktoken

    with open(tokenizer_file(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    rng = random.Random(4)
    texts = ["", " ", "  ", "a", "\n\n", "It's  two   blanks ", "\tx y", "日本語のテキスト", "naïve Straße 🙂🙂", "\0nul\0", "aaaa" * 400, "Ā Ġ", "x" * 3000, " lead", "trail ", "1234567 89"]
    texts += ["".join(rng.choice("ab é\n\t 日1.,'s") for _ in range(rng.randint(0, 200))) for _ in range(60)]
    return texts + [" ".join(texts) * 20]


def test_tokens_are_those_of_a_public_encoder(spark):
    rows = [(i, t) for i, t in enumerate(odd_texts())] + [(None, "no id"), (7, None), (3, "a"), (3, "a")]
    df = spark.createDataFrame([(i, t, 1, "d", "k", 2) for i, t in rows], SCHEMA).repartition(4)
    got = bpe.encode_decode(df).collect()
    assert len(got) == len(rows)
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    e = encoding()
    want = sorted([(i, t, None if t is None else e.encode_ordinary(t)) for i, t in rows], key=key)
    have = sorted([(r.doc_id, r.decoded, r.token_ids) for r in got], key=key)
    assert have == want
    assert all(r.n_tokens == (None if r.token_ids is None else len(r.token_ids)) for r in got)


def test_caches_do_not_change_results():
    small, large = bpe.Codec(RANKS, cache_entries=5), bpe.Codec(RANKS)
    for _ in range(2):
        for texts in (odd_texts()[:30], odd_texts()[30:], [None, ""]):
            for a, b in zip(small.encode(texts), large.encode(texts)):
                assert np.array_equal(a, b)


def test_pieces_outlast_chunks(monkeypatch):
    """Chunks that differ and are made of the same few pieces need no recursive query more when the chunk cache was emptied."""
    codec, asked, e = bpe.Codec(RANKS, cache_entries=20), [], encoding()
    own = codec.encode_pieces
    monkeypatch.setattr(codec, "encode_pieces", lambda pieces: asked.extend(pieces) or own(pieces))
    for sign in (".", ",", "!", "?") * 2:
        text = " ".join(f"word{sign}{n}" for n in range(30))
        flat, n = codec.encode([text])
        assert flat.tolist() == e.encode_ordinary(text) and codec.decode(flat, n) == [text]
    assert len(asked) == len(set(asked))


def test_texts_are_decoded_in_parts(monkeypatch):
    monkeypatch.setattr(bpe, "DECODE_TOKENS", 997)
    codec, texts = bpe.Codec(RANKS), odd_texts()
    assert codec.decode(*codec.encode(texts)) == texts


def test_a_vocabulary_is_prepared_once(tmp_path):
    """One worker's partitions share the merge table, unless the file has changed."""
    path = tmp_path / "ranks"
    lines = [base64.b64encode(bytes([i])) + b" %d\n" % i for i in range(256)]
    path.write_bytes(b"".join(lines))
    ranks, merges = bpe.load_vocabulary(str(path))
    assert bpe.load_vocabulary(str(path))[1] is merges and len(ranks) == 256 and merges.num_rows == 0
    path.write_bytes(b"".join(lines) + base64.b64encode(b"ab") + b" 300\n")
    ranks, merges = bpe.load_vocabulary(str(path))
    assert merges.to_pylist() == [{"l": 97, "r": 98, "n": 300}]
    # a rank that no token has is no gap for decoding
    flat, n = bpe.Codec(ranks, merges=merges).encode(["abc", None, "\0ab"])
    assert flat.tolist() == [300, 99, 0, 300] and n.tolist() == [2, 0, 2]
    assert bpe.Codec(ranks, merges=merges).decode(flat, n) == ["abc", "", "\0ab"]


def test_empty_table(spark):
    assert bpe.encode_decode(spark.createDataFrame([], SCHEMA)).count() == 0


def test_token_counts_and_cache(spark, tmp_path):
    texts = odd_texts()
    rows = [(i, t) for i, t in enumerate(texts)] + [(100, texts[5]), (100, texts[5]), (None, "x y"), (101, None), (5, "other"), (102, "a\r\nb "), (103, "a\nb")]
    df = spark.createDataFrame([(i, t, 1, "d", "k", 2) for i, t in rows], SCHEMA)
    cache, e = str(tmp_path / "cache"), encoding()

    def count(t):
        return None if t is None else len(e.encode_ordinary(t.replace("\r\n", "\n").replace("\r", "\n").strip(" \t\n")))

    key = lambda r: tuple((v is None, v or 0) for v in r)
    want = sorted(((i, count(t)) for i, t in rows), key=key)
    assert sorted((tuple(r) for r in tokencount.token_counts(df, cache=cache).collect()), key=key) == want
    n = spark.read.parquet(cache).count()
    assert n == len({tuple([t.replace("\r\n", "\n").strip(" \t\n")]) for _, t in rows if t is not None})
    # all hits: the same counts, nothing appended
    assert sorted((tuple(r) for r in tokencount.token_counts(df, cache=cache).collect()), key=key) == want
    assert spark.read.parquet(cache).count() == n
    # one miss more
    more = df.union(spark.createDataFrame([(200, "quite new", 1, "d", "k", 2)], SCHEMA))
    assert (200, count("quite new")) in {tuple(r) for r in tokencount.token_counts(more, cache=cache).collect()}
    assert spark.read.parquet(cache).count() == n + 1


def test_token_counts_of_nothing(spark):
    assert tokencount.token_counts(spark.createDataFrame([], SCHEMA)).count() == 0


LONG = {
    "letters": "".join(random.Random(1).choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60_000)),
    "one letter": "a" * 3_000_000,
    "signs": "".join(random.Random(2).choice("-=_*#") for _ in range(20_000)),
    "wide": "".join(random.Random(3).choice("日本語テキスト") for _ in range(9_000)),
    "two letters": "".join(random.Random(4).choice("ab") for _ in range(20_000)),
    "blanks": " " * 5001 + "\n" * 777 + "x",
} | {f"period {n}": ("abcdefgh"[:n] * 3000)[: 7000 + n] for n in (1, 2, 3, 5, 7)}


@pytest.mark.parametrize("name", LONG)
def test_unbroken_text(name):
    codec, text = bpe.Codec(RANKS), LONG[name]
    flat, n = codec.encode([text])
    assert flat.tolist() == encoding().encode_ordinary(text) and codec.decode(flat, n) == [text]


def test_runs_and_rounds_of_any_size(monkeypatch):
    """Short runs and queries that stop after few rounds end in the same tokens."""
    texts = ["", "a", "It's  two   blanks ", "日本語のテキスト", "aaaa" * 9, "unbelievable 1234567"]
    want = [encoding().encode_ordinary(t) for t in texts]
    for run, rounds in ((1, 64), (3, 2)):
        monkeypatch.setattr(bpe, "RUN", run)
        monkeypatch.setattr(bpe, "ROUNDS", rounds)
        monkeypatch.setattr(bpe, "_CONTRACT_SQL", bpe._CONTRACT_SQL.replace("p.i < 64", f"p.i < {rounds}"))
        flat, n = bpe.Codec(RANKS).encode(texts)
        assert [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])] == want
        monkeypatch.undo()
