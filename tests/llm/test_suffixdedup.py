import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tablewright.llm import suffixdedup


def split(x):
    return re.findall(r"[^ \t\n\r\f\v\x1c-\x1f]+", x)


def brute(rows, span):
    """(id, first, end) by looking at every window."""
    windows, texts = {}, {}
    for k, x in rows:
        if k is None or x is None:
            continue
        w = split(x)
        for i in range(len(w) - span + 1):
            windows.setdefault(tuple(w[i : i + span]), set()).add(k)
            texts.setdefault(k, set())
    for k, x in rows:
        if k is None or x is None:
            continue
        w = split(x)
        for i in range(len(w) - span + 1):
            if len(windows[tuple(w[i : i + span])]) > 1:
                texts[k].add((i, i + span))
    out = set()
    for k, spans in texts.items():
        a = b = None
        for s, e in sorted(spans):
            if a is None or s > b:
                if a is not None:
                    out.add((k, a, b))
                a, b = s, e
            else:
                b = max(b, e)
        if a is not None:
            out.add((k, a, b))
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocab = ["w%d" % i for i in range(30)] + ["ß", "日本", "a b"]
    shared = [[rng.choice(vocab) for _ in range(rng.randint(5, 60))] for _ in range(6)]
    rows = []
    for k in range(n):
        w = []
        for _ in range(rng.randint(0, 4)):
            w += [rng.choice(vocab) for _ in range(rng.randint(0, 30))]
            if rng.random() < 0.5:
                p = rng.choice(shared)
                a = rng.randint(0, len(p) // 2)
                w += p[a:]
        rows.append((k, rng.choice([" ", "\n", "  "]).join(w)))
    rows += [(n, None), (None, rows[0][1]), (n + 1, ""), (n + 2, "   "), rows[3], (rows[3][0], rows[4][1])]
    rows += [(n + 3, "x " * 200), (n + 4, "x " * 100), (n + 5, "y " * 90), (n + 6, " ".join(vocab * 400) + " " + rows[5][1])]
    return rows


@pytest.mark.parametrize("seed,span,gram", [(1, 12, 4), (2, 20, 10), (3, 8, 3)])
def test_passages_match_brute_force(spark, seed, span, gram):
    rows = corpus(seed)
    df = spark.createDataFrame([(k, x, "en", 1) for k, x in rows], "doc_id long, text string, isle string, g int")
    got = {tuple(r) for r in suffixdedup.repeated_passages(df, span=span, gram=gram).collect()}
    assert got == brute(rows, span)


def test_empty_table_and_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    out = suffixdedup.repeated_passages(df)
    assert out.columns == ["doc_id", "first_word", "end_word"] and out.count() == 0


def test_sort_matches_plain_sort():
    rng = np.random.default_rng(5)
    ids = rng.integers(0, 3, 400)
    start = np.sort(rng.integers(0, 390, 120))
    size = np.minimum(rng.integers(0, 30, 120), 400 - start)
    group = np.sort(rng.integers(0, 7, 120))
    order, c = suffixdedup.sort_suffixes(suffixdedup.Words(ids), start, size, group)
    plain, d = suffixdedup.plain_sort(ids, start, size, group)
    assert [tuple(ids[start[i] : start[i] + size[i]]) for i in order] == [tuple(ids[start[i] : start[i] + size[i]]) for i in plain]
    assert c.tolist() == d.tolist()


def test_hash_collision_is_noticed(monkeypatch):
    """With hashes that all agree the sort refuses, and windows still come out right."""
    rows = corpus(9, 20)
    texts = [x.encode() for _, x in rows if x and len(split(x)) > 12]
    args = (np.zeros(len(texts), np.int64), pa.array(texts, pa.binary()), np.full(len(texts), 5), np.arange(len(texts)), np.arange(len(texts)), 9)
    want = suffixdedup.shared_windows(*args, hashed=False)
    assert suffixdedup.shared_windows(*args) == want
    monkeypatch.setattr(suffixdedup.Words, "same", lambda self, a, b, n: np.ones(len(a), bool))
    assert suffixdedup.shared_windows(*args) == want


def test_words_with_one_hash_are_told_apart():
    data = np.frombuffer(b"aa bb aa", np.uint8)
    s, e = np.array([0, 3, 6]), np.array([2, 5, 8])
    assert suffixdedup.word_numbers(np.array([7, 7, 7], np.uint64), data, s, e).tolist() == [0, 1, 0]


def test_ids_are_whole_numbers(spark):
    with pytest.raises(ValueError, match="whole numbers"):
        suffixdedup.repeated_passages(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_join_memory_does_not_go_with_the_task():
    """Surroundings of 14 MB under 10,000 n-grams, of two documents each, that differ in their first word."""
    rng = np.random.default_rng(3)
    n = 10_000
    texts = []
    for w in rng.integers(10_000, 99_999, (n, 89)):
        tail = b" ".join(b"w%d" % x for x in w[1:])
        texts += [b"first %s" % tail, b"other %s" % tail]
    ids = [[k] for k in range(2 * n)]
    rows = pa.RecordBatch.from_arrays([
        pa.array(np.repeat(np.arange(n), 2)), pa.array(texts, pa.binary()), pa.array([40] * 2 * n, pa.int32()),
        pa.array(ids, pa.list_(pa.int64())), pa.array([[40]] * 2 * n, pa.list_(pa.int32()))], ["g", "t", "l", "ks", "at"])
    tracemalloc.start()
    try:
        got = [r for b in suffixdedup.repeated_windows([rows.slice(at, 2000) for at in range(0, 2 * n, 2000)], 50) for r in zip(*b.to_pydict().values())]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sorted(got) == [(k, 1, 89) for k in range(2 * n)]
    assert peak < 120e6
