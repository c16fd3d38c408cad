import math
import random

import numpy as np
import pytest

from tablewright.llm import toxicity, warc

SCHEMA = "doc_id long, text string, toxic int, k string, x string, p int"


def records(spark, raws):
    return spark.createDataFrame([(r, 1, "u") for r in raws], "record binary, seg int, uri string").repartition(3)


def result(df):
    return {r.record_id: (r.target_uri, r.n_segments, r.status, r.payload) for r in df.collect() if r.record_id}


def test_round_trip_in_any_order(spark):
    rng = random.Random(1)
    bodies = {f"<urn:x:{i}>": bytes(rng.choice(b"abc \n\xc3\xa9") for _ in range(n)) for i, n in enumerate([0, 1, 5, 99, 1000, 60000])}
    raws = [r for k, b in bodies.items() for r in warc.segment(k, "http://x/" + k, warc.http_message(b, 37), 100)]
    raws += raws[:20]  # equal segments that come twice
    rng.shuffle(raws)
    got = result(warc.reassemble(records(spark, raws), text=False))
    assert {k: v[3] for k, v in got.items()} == bodies and all(v[2] == "ok" and v[0] == "http://x/" + k for k, v in got.items())


def test_broken_records_have_a_status(spark):
    def parts(k, size=50):
        return list(warc.segment(f"<urn:{k}>", None, warc.http_message(b"x" * 300, 64), size))

    lost, swapped, wrong = parts("lost"), parts("conflict"), parts("length")
    del lost[1]
    other = swapped[1].replace(b"xxxx", b"yyyy", 1)
    wrong[-1] = wrong[-1].replace(b"Total-Length: ", b"Total-Length: 9")
    chunk = list(warc.segment("<urn:chunk>", None, b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\nzz\r\n", 1000))
    plain = list(warc.segment("<urn:plain>", None, b"just bytes", 4))
    raws = [*lost, *swapped, other, *wrong, *chunk, *plain, None, b"", b"junk", b"WARC/1.1\r\nContent-Length: 99\r\n\r\nshort", *parts("last")[:-1]]
    df = warc.reassemble(records(spark, raws))
    got = result(df)
    assert {k: v[2] for k, v in got.items()} == {"<urn:lost>": "missing segment", "<urn:conflict>": "conflict", "<urn:length>": "length mismatch", "<urn:chunk>": "bad chunk", "<urn:plain>": "ok", "<urn:last>": "missing segment"}
    assert got["<urn:plain>"][3] == "just bytes"
    assert [r.status for r in df.collect() if r.record_id is None] == ["malformed"] * 4
    assert all(v[3] is None for v in got.values() if v[2] != "ok")


def test_pages_with_nulls_and_no_rows(spark):
    schema = "page_id long, url string, html string, record string"
    df = spark.createDataFrame([(1, None, None, "r"), (2, "u", "", "r"), (3, "u", "é" * 20000, "r")], schema)
    got = result(warc.reassemble(warc.page_records(df)))
    assert {k: v[3] for k, v in got.items()} == {"<urn:page:1>": "", "<urn:page:2>": "", "<urn:page:3>": "é" * 20000}
    empty = spark.createDataFrame([], schema)
    assert warc.reassemble(warc.page_records(empty)).count() == 0


@pytest.mark.parametrize("body,want", [(b"0\r\n\r\n", b""), (b"3;x=1\r\nabc\r\n0\r\nT: v\r\n\r\n", b"abc"), (b"3\r\nab", None), (b"", None), (b"-1\r\n", None), (b"2\r\nabc\r\n0\r\n\r\n", None)])
def test_dechunk(body, want):
    assert warc.dechunk(body) == want


def test_pages_without_id_and_with_one_id(spark):
    rows = [(None, "u", "one"), (None, "v", "two"), (None, None, None), (7, "u", "same"), (7, "u", "same"), (8, "u", "this"), (8, "u", "that")]
    got = warc.reassemble(warc.page_records(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()
    assert sorted((r.payload or "") for r in got if "null-" in r.record_id) == ["", "one", "two"] and all(r.status == "ok" for r in got if "null-" in r.record_id)
    assert sorted((r.record_id, r.status, r.payload) for r in got if "null-" not in r.record_id) == [("<urn:page:7>", "ok", "same"), ("<urn:page:8>", "conflict", None)]


# toxicity


def corpus(n=600, seed=2):
    rng = random.Random(seed)
    calm, foul = ["word%s" % c for c in "abcdefghijklmnop"], ["vilegrub", "snarkhate", "filthmonger"]
    rows = []
    for i in range(n):
        bad = rng.random() < 0.12
        w = [rng.choice(calm) for _ in range(rng.randint(20, 60))]
        if bad:
            for _ in range(8):
                w[rng.randrange(len(w))] = rng.choice(foul)
        rows.append((i, " ".join(w), int(bad)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, y, "k", "x", 1) for i, t, y in rows], SCHEMA)


def test_held_out_accuracy(spark):
    rows = corpus()
    df = frame(spark, rows)
    labels = df.where("doc_id < 300").select("doc_id", "toxic")
    model = toxicity.fit(df.drop("toxic"), labels)
    assert 0.03 < model.prior < 0.3
    got = {r.doc_id: r.toxic for r in toxicity.score(df.drop("toxic"), model).collect()}
    held = [(y, got[i]) for i, _, y in rows if i >= 300]
    assert sum(bool(y) == g for y, g in held) / len(held) >= 0.97
    kept = toxicity.score(df, model, keep=True)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, g in got.items() if not g}


def test_odd_rows(spark):
    rows = corpus(200)
    model = toxicity.train([t for _, t, y in rows if y], [t for _, t, _ in rows])
    odd = [(None, "word"), (1, None), (2, ""), (3, rows[0][1]), (3, rows[0][1]), (4, ("worda " * 200_000) + "vilegrub")]
    got = toxicity.score(frame(spark, [(i, t, 0) for i, t in odd]), model).collect()
    assert len(got) == len(odd) and not any(r.toxic for r in got if r.doc_id in (None, 1, 2))
    assert len({r.score for r in got if r.doc_id == 3}) == 1
    empty = spark.createDataFrame([], SCHEMA)
    none = toxicity.fit(empty, empty.select("doc_id", "toxic"))
    assert toxicity.score(empty, none).count() == 0
    assert [(r.score, r.toxic) for r in toxicity.score(frame(spark, rows[:2]), none).collect()] == [(None, False)] * 2


def test_the_estimator_is_not_negative():
    """Where all of the unlabelled sample is positive the corrected risk can't go below zero and the fit stays finite."""
    texts = ["vilegrub snarkhate word%d" % (i % 7) for i in range(60)]
    m = toxicity.train(texts, texts + ["calm day %d" % i for i in range(400)])
    assert all(abs(w) < 1e3 for w in m.weights.values()) and m.scorer()(texts[0]) > m.scorer()("calm day 3")


def test_fit_is_that_of_the_texts_at_hand(spark):
    """The table's way to counts, rows and prior against plain Python on the same texts."""
    rows = corpus(300) + [(5, "zz later text", 0), (901, None, 0), (None, "vilegrub " * 9, 1)]
    df = frame(spark, rows)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows[:150]] + [(5000 + i, 1) for i in range(50)] + [(None, 1)], "doc_id long, toxic int")
    got = toxicity.fit(df.drop("toxic"), labels)
    texts = {}
    for i, t, _ in rows:
        if i is not None:
            texts[i] = min(texts.get(i, t), t or "") if t is not None else texts.get(i, "")
    by_id = sorted((str(i), t) for i, t in texts.items())
    toxic = {str(i) for i, _, y in rows[:150] if y}
    want = toxicity.train([t for i, t in by_id if i in toxic], [t for _, t in by_id], [t for _, t, _ in rows])
    assert got.weights.keys() == want.weights.keys() and abs(got.prior - want.prior) < 1e-12
    assert all(abs(got.weights[g] - w) < 1e-9 for g, w in want.weights.items()) and abs(got.bias - want.bias) < 1e-9


def plain_steps(xp, xu, prior, steps, rate=0.05, decay=1e-4):
    """The non-negative estimator and Adam, number by number."""
    d = len(xp[0])
    w, m, v = [0.0] * d + [-1.0], [0.0] * (d + 1), [0.0] * (d + 1)
    for t in range(1, steps + 1):
        z = lambda x: sum(a * b for a, b in zip(x, w)) + w[d]  # noqa: E731, B023
        sig = lambda s: 1 / (1 + math.exp(-s))
        slope = lambda xs, r: [sum(r(x) * (x[j] if j < d else 1) for x in xs) / len(xs) for j in range(d + 1)]  # noqa: E731, B023
        minus = sum(math.log(1 + math.exp(z(x))) for x in xu) / len(xu) - prior * sum(math.log(1 + math.exp(z(x))) for x in xp) / len(xp)
        back = [a - prior * b for a, b in zip(slope(xu, lambda x: sig(z(x))), slope(xp, lambda x: sig(z(x))))]  # noqa: B023
        plus = slope(xp, lambda x: sig(z(x)) - 1)  # noqa: B023
        g = [prior * a + b for a, b in zip(plus, back)] if minus >= 0 else [-b for b in back]
        g = [a + decay * b for a, b in zip(g[:d], w[:d])] + [g[d]]
        m = [0.9 * a + 0.1 * b for a, b in zip(m, g)]
        v = [0.999 * a + 0.001 * b * b for a, b in zip(v, g)]
        w = [a - rate * (b / (1 - 0.9**t)) / (math.sqrt(c / (1 - 0.999**t)) + 1e-8) for a, b, c in zip(w, m, v)]
        w = [max(a, 0.0) for a in w[:d]] + [w[d]]
    return w


@pytest.mark.parametrize("prior", [0.05, 0.3, 0.8])
def test_steps_match_plain_python(prior):
    rng = random.Random(1)
    xp = [[rng.random() * 2, rng.random(), float(rng.random() < 0.5)] for _ in range(12)]
    xu = [[rng.random(), rng.random(), float(rng.random() < 0.2)] for _ in range(25)]
    got = toxicity._descend(np.array(xp), np.array(xu), prior, 120)
    assert np.allclose(got, plain_steps(xp, xu, prior, 120), rtol=1e-9, atol=1e-9)
