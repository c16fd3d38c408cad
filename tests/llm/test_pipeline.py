"""Pipeline and its contract; skipped where corpus_pipeline.py is deleted."""

import importlib.util
import sys
from collections import Counter

import pytest

import __spark_entry__ as entry
from tablewright.llm import queries

pytestmark = pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline")
SF = "/root/testdata/sf0.001"


def test_stages_follow_one_another(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    n = docs.count()
    for i, (name, stage) in enumerate(p.STAGES):
        docs = p.written(stage(spark, docs, SF), f"test-{i}")
        m = docs.count()
        assert m <= n and m > 0, name
        n = m
        if i < len(p.STAGES) - 1:
            assert docs.columns == columns, name
    rows = docs.collect()
    kept = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.doc_id for r in rows} <= kept and all(r.n_tokens == len(r.token_ids) for r in rows)


def odd_docs(spark):
    foul = "vilegrub snarkhate filthmonger " * 6
    texts = [f"calm words number {i} " + " ".join(f"w{i * j % 97}" for j in range(12)) + "\nshared footer line" for i in range(240)]
    texts += [foul + f"and {i} more w{i}" for i in range(20)] + [texts[3], texts[3] + " tail", None, "", "  ", "\n\n", "x" * 300_000, "word " * 60_000]
    rows = [(i, t, "en", ("s", "t", None)[i % 3], len(t or ""), "k", 7, i) for i, t in enumerate(texts)] + [(None, texts[4], "en", "s", 3, "k", 7, 0), (5, texts[5], "en", "t", 3, "k", 7, 0), (5, texts[5], "en", "t", 3, "k", 7, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, k string, shard int, gone_id long").repartition(4)


def test_stages_match_brute_force(spark, tmp_path):
    """Each stage against plain Python on what the one before kept: odd rows, and columns with clashing names."""
    import corpus_pipeline as p
    from tests.llm import test_bpe_tokens as b
    from tests.llm import test_dedup_mix as m
    from tablewright.llm import mixing, toxicity

    spark.createDataFrame([(i, int(240 <= i < 260)) for i in range(0, 260, 2)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, sf = odd_docs(spark), str(tmp_path)
    stage = [lambda d, f=f: p.written(f(spark, d, sf), "odd") for _, f in p.STAGES]
    row = lambda r: tuple(r)
    have = docs.collect()

    out = stage[0](docs)
    assert out.columns == docs.columns
    texts = {}
    for r in have:
        if r.doc_id is not None:
            texts[r.doc_id] = min(texts.get(r.doc_id, r.text or ""), r.text or "")
    at_large = sorted((str(i), t) for i, t in texts.items())
    model = toxicity.train([t for i, t in at_large if 240 <= int(i) < 260 and int(i) % 2 == 0], [t for _, t in at_large], [r.text or "" for r in have])
    of = model.scorer()
    assert Counter(map(row, out.collect())) == Counter(row(r) for r in have if not of(r.text) > 0)
    assert {r.doc_id for r in out.collect()} >= set(range(240)) and len({r.doc_id for r in out.collect()} & set(range(240, 260))) < 5

    docs, have = out, out.collect()
    out = stage[1](docs)
    lines = [(r.doc_id, r.text, None) for r in have]
    keep = Counter()
    for r, (_, t, n, gone) in zip(have, m.brute_lines(lines)):
        if not gone:
            keep[row(r)] += 1
        elif any(map(m.trim, t.split("\n"))):
            keep[(r.doc_id, t, *row(r)[2:4], len(t), *row(r)[5:])] += 1
    assert out.columns == docs.columns and Counter(map(row, out.collect())) == keep

    docs, have = out, out.collect()
    out = stage[2](docs)
    gone = {(i, None) for i, c, _, _ in m.brute_classes([(r.doc_id, r.text, None) for r in have], 0.5) if i != c}
    assert out.columns == docs.columns and gone and Counter(map(row, out.collect())) == Counter(row(r) for r in have if (r.doc_id, None) not in gone)

    docs, have = out, out.collect()
    out = stage[3](docs)
    counts = Counter(s for _, s in {(r.doc_id, r.source or mixing._NULL) for r in have})
    quota = mixing.quotas(dict(counts), mixing.smoothed(dict(counts), mixing.POWER))
    assert out.columns == docs.columns and not Counter(map(row, out.collect())) - Counter(map(row, have))
    assert Counter(s for _, s in {(r.doc_id, r.source or mixing._NULL) for r in out.collect()}) == quota

    docs, have = out, out.collect()
    out, e = stage[4](docs).collect(), b.encoding()
    assert Counter((r.doc_id, r.decoded, None if r.token_ids is None else tuple(r.token_ids)) for r in out) == Counter((r.doc_id, r.text, None if r.text is None else tuple(e.encode_ordinary(r.text))) for r in have)


def test_nothing_in_nothing_out(spark, tmp_path):
    import corpus_pipeline as p

    docs = odd_docs(spark).limit(0)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0


def test_every_operator_is_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(q.startswith(f"op{i}_") for q in queries.QUERIES) for i in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)
    assert "tablewright.llm" in sys.modules
