import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tablewright.llm import linededup, mixing, ngramjoin

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k string, h1 int, shard int, id int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "k", 1, 9, 4) for i, t, s in rows], SCHEMA).repartition(3)


# lines


def trim(s):
    return s.translate(str.maketrans("\t\r\f\v", "    ")).strip(" ")


def brute_lines(rows):
    first = {}
    for i, t, _ in rows:
        for no, line in enumerate((t or "").split("\n")) if t is not None else ():
            k, at = trim(line), (i is not None, i or 0, no)
            if k and (k not in first or at < first[k]):
                first[k] = at
    out = []
    for i, t, _ in rows:
        if t is None:
            out.append((i, None, 0, 0))
            continue
        lines = t.split("\n")
        left = [x for no, x in enumerate(lines) if not trim(x) or first[trim(x)] == (i is not None, i or 0, no)]
        out.append((i, "\n".join(left), len(lines), len(lines) - len(left)))
    return out


def line_rows(seed=3, n=80):
    rng = random.Random(seed)
    pool = ["alpha", " beta ", "gamma\t", "", "  ", "日本", "delta x"]
    rows = [(i, "\n".join(rng.choice(pool + [f"own {i} {j}"]) for j in range(rng.randint(1, 6))), "s") for i in range(n)]
    return rows + [(None, "alpha\nnull id", "s"), (n, None, "s"), (n + 1, "", "s"), (2, rows[2][1], "s"), (n + 2, "beta\n" * 5000 + "last", None)]


key = lambda r: tuple((v is None, v if v is not None else 0) for v in r)


@pytest.mark.parametrize("batches,fanout", [(1, 2), (5, 2), (7, 3)])
def test_lines_match_brute_force(spark, batches, fanout):
    rows = line_rows()
    got = sorted((tuple(r) for r in linededup.line_dedup(frame(spark, rows), batches, fanout).collect()), key=key)
    assert got == sorted(brute_lines(rows), key=key)


def test_documents_keep_columns_and_repeaters_go(spark):
    rows = line_rows()
    df = frame(spark, rows)
    out = linededup.dedup_documents(df)
    assert out.columns == df.columns
    want = sorted((i, t) for i, t, n, gone in brute_lines(rows) if i is not None and t is not None and not (gone and not any(map(trim, t.split("\n")))))
    have = [r for r in out.collect() if r.doc_id is not None and r.text is not None]
    assert sorted((r.doc_id, r.text) for r in have) == want
    assert all(r.n_chars == len(r.text) for r in have)


def test_no_rows(spark):
    df = frame(spark, []) if False else spark.createDataFrame([], SCHEMA)
    assert linededup.line_dedup(df).count() == 0 and linededup.dedup_documents(df).count() == 0
    assert mixing.mix_sources(df.drop("shard")).count() == 0
    assert ngramjoin.similar_pairs(df).count() == 0 and ngramjoin.one_of_each(df).count() == 0 and ngramjoin.near_duplicates(df).count() == 0


# n-gram sets


def grams(text, n=3):
    w = "".join(c.lower() if "A" <= c <= "Z" else c if c.isalnum() or ord(c) > 127 else " " for c in text).split(" ")
    w = [x for x in w if x]
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute_pairs(rows, t):
    groups, found = {}, {}
    for i, x, _ in rows:
        if i is not None and x is not None and grams(x):
            groups.setdefault(grams(x), set()).add(i)
    reps = [(min(ids), g) for g, ids in groups.items()]
    for g, ids in groups.items():
        for j in sorted(ids)[1:]:
            found[min(ids), j] = 1.0
    for a in range(len(reps)):
        for b in range(a):
            (i, g), (j, h) = reps[a], reps[b]
            s = len(g & h) / len(g | h)
            if s >= t and i != j:
                k = (min(i, j), max(i, j))
                found[k] = max(found.get(k, 0), s)
    return {(a, b, round(s, 9)) for (a, b), s in found.items()}


def near_rows(seed=1, n=70):
    rng = random.Random(seed)
    vocab = ["w%d" % i for i in range(25)] + ["é", "Zed,"]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            w = rng.choice(rows)[1].split(" ")
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
        else:
            w = [rng.choice(vocab) for _ in range(rng.randint(1, 40))]
        rows.append((i, " ".join(w), "s"))
    return rows + [(None, rows[0][1], "s"), (n, None, "s"), (n + 1, "", "s"), (n + 2, "...", "s"), (n + 3, rows[1][1].upper(), "s"), (n + 4, "one", "s"), (n + 5, "One!", "s"), rows[2], (n + 6, " ".join(vocab * 800), "s")]


SMALL = [(1, 0.5, {}), (2, 0.7, {"bucket_grams": 100}), (3, 0.34, {"bucket_grams": 40, "block": 3}), (5, 0.5, {"bucket_grams": 60, "block": 2, "hot_least": 6, "frequent": 9})]


@pytest.mark.parametrize("seed,t,small", SMALL)
def test_pairs_match_brute_force(spark, seed, t, small):
    rows = near_rows(seed)
    got = {(r.id_a, r.id_b, round(r.jaccard, 9)) for r in ngramjoin.similar_pairs(frame(spark, rows), t=t, **small).collect()}
    assert got == brute_pairs(rows, t)


def brute_classes(rows, t):
    """(id, class, links, copies) of each row that has any; equal sets are one."""
    sets = {}
    for i, x, _ in rows:
        if i is not None and x is not None and grams(x):
            sets.setdefault(grams(x), []).append(i)
    known = list(sets)
    near = {a: [b for b in known if b is not a and len(a & b) / len(a | b) >= t] for a in known}
    out = []
    for a in known:
        reach, todo = {a}, [a]
        while todo:
            for b in near[todo.pop()]:
                if b not in reach:
                    reach.add(b)
                    todo.append(b)
        if near[a] or len(sets[a]) > 1:
            out += [(i, min(min(sets[b]) for b in reach), len(near[a]), len(sets[a]) - 1) for i in sets[a]]
    return sorted(out)


@pytest.mark.parametrize("seed,t,small", SMALL)
def test_classes_match_brute_force(spark, seed, t, small):
    rows = near_rows(seed)
    got = sorted(tuple(r) for r in ngramjoin.near_duplicates(frame(spark, rows), t=t, **small).collect())
    assert got == brute_classes(rows, t)


def test_string_ids_and_clashing_columns(spark):
    rows = near_rows(6, 30)
    df = frame(spark, rows).selectExpr("concat('d', lpad(doc_id, 4, '0')) AS doc_id", "text", "source AS g", "h1 AS gone_id", "shard AS gone_hash", "lang AS k", "source AS h")
    named = [(None if i is None else f"d{i:04d}", x, s) for i, x, s in rows]
    got = sorted(tuple(r) for r in ngramjoin.near_duplicates(df).collect())
    assert got == brute_classes(named, 0.5)
    out = ngramjoin.one_of_each(df)
    gone = {i for i, c, _, _ in got if i != c}
    assert out.columns == df.columns and Counter(r.doc_id for r in out.collect()) == Counter(i for i, _, _ in named if i not in gone)


def test_a_group_of_near_copies_is_counted_in_blocks(spark):
    rng = random.Random(8)
    base = ["v%d" % i for i in range(60)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(60)] = f"x{rng.randrange(5)}"
        rows.append((i, " ".join(w), "s"))
    rows += [(200 + i, rows[3][1], "s") for i in range(60)] + [(300, " ".join(base * 3000), "s"), (301, "a" * 3_000_000, "s")]
    got = sorted(tuple(r) for r in ngramjoin.near_duplicates(frame(spark, rows), block=16, bucket_grams=500).collect())
    assert got == brute_classes(rows, 0.5)


def test_one_of_each_group_stays(spark):
    rows = near_rows(4)
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b, _ in brute_pairs(rows, 0.5):
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    df = frame(spark, rows)
    out = ngramjoin.one_of_each(df)
    assert out.columns == df.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter(i for i, _, _ in rows if i is None or find(i) == i)


def test_trie_against_all_pairs():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 40, rng.integers(1, 30))).astype(np.uint64) for _ in range(60)]
    got = {(i, int(j)): int(n) for i, js, shared in ngramjoin.trie_join(sets, 0.5) for j, n in zip(js, shared)}
    want = {(i, j): len(np.intersect1d(sets[i], sets[j])) for i in range(60) for j in range(60) if i != j}
    assert got == {(i, j): n for (i, j), n in want.items() if n / (len(sets[i]) + len(sets[j]) - n) >= 0.5}
    assert list(ngramjoin.gram_sets(pa.array(["", None]), 3))[0].size == 0
    # of larger sets, of which the rest is in no other: a set that shares too little for its own size has a smaller partner
    for _ in range(200):
        sets = [np.unique(rng.integers(0, 14, rng.integers(6, 30))).astype(np.uint64) for _ in range(4)]
        sizes = np.array([len(x) + int(rng.integers(0, len(x) + 1)) for x in sets])
        got = {(i, int(j)) for i, js, _ in ngramjoin.trie_join(sets, 0.5, sizes) for j in js}
        n = {(i, j): len(np.intersect1d(sets[i], sets[j])) for i in range(4) for j in range(4) if i != j}
        assert got == {(i, j) for (i, j), c in n.items() if c / (sizes[i] + sizes[j] - c) >= 0.5}


# mixing


def test_mix_holds_quotas_and_shards(spark):
    rng = random.Random(0)
    rows = [(i, "t", rng.choice(["hot"] * 6 + ["a", "b", None])) for i in range(3000)] + [(None, "t", "a"), (5, "again", None), (5, "again", None)]
    df = frame(spark, rows).drop("shard")
    weights = {"hot": 0.5, "a": 0.3, "b": 0.2, "none such": 1.0}
    units = {(i, s) for i, _, s in rows}
    counts = Counter(s for _, s in units if s is not None)
    out = mixing.mix_sources(df, weights, shard_docs=200, block_docs=8).collect()
    got = Counter(s for s in {(r.doc_id, r.source) for r in out} for s in [s[1]])
    assert got == mixing.quotas(dict(counts), weights)
    total = sum(got.values())
    assert all(abs(got[s] / total - w) < 0.01 for s, w in weights.items() if s in counts)
    by = {}
    for r in out:
        by.setdefault(r.shard, {}).setdefault(r.position, set()).add((r.doc_id, r.source))
    assert all(sorted(p) == list(range(len(p))) and all(len(v) == 1 for v in p.values()) for p in by.values())
    assert mixing.mix_sources(df, weights, shard_docs=200, block_docs=8).count() == len(out)


@pytest.mark.parametrize("blocks,shards", [([5, 0, 17], 4), ([1], 3), ([100, 3, 9, 40], 7), ([2, 2], 1)])
def test_split_tree_sums(blocks, shards):
    source, block = np.repeat(np.arange(len(blocks)), blocks), np.concatenate([np.arange(b) for b in blocks])
    got = mixing.SplitTree(blocks, shards, 1).shard_of(source, block)
    t = np.zeros((shards, len(blocks)), int)
    np.add.at(t, (got, source), 1)
    assert t.sum(0).tolist() == blocks and t.sum(1).max() - t.sum(1).min() <= 1
    # each source's blocks lie in ranges; any part of them, asked for alone and with little memory, gives the same
    assert all((np.diff(got[source == s]) >= 0).all() for s in range(len(blocks)))
    o = np.random.default_rng(0).permutation(len(got))[: len(got) // 2]
    assert (mixing.SplitTree(blocks, shards, 1, remember=1).shard_of(source[o], block[o]) == got[o]).all()


def plain_tree(have, lo, hi, seed):
    """Blocks by shard of a plain recursion."""
    if hi - lo == 1:
        return [list(have)]
    mid, total = (lo + hi) // 2, sum(have)
    left = total // (hi - lo) * (mid - lo) + min(total % (hi - lo), mid - lo)
    rng = np.random.Generator(np.random.Philox(key=np.array([seed, lo << 32 | hi], np.uint64)))
    take = rng.multivariate_hypergeometric(have, left, method="marginals").tolist() if total else have
    return plain_tree(take, lo, mid, seed) + plain_tree([a - b for a, b in zip(have, take)], mid, hi, seed)


def test_mix_matches_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, "t", rng.choice(["hot"] * 7 + ["a", "b", None])) for i in range(700)] + [(None, "t", "a"), (5, "u", "a"), (5, "v", "a")]
    df = frame(spark, rows).drop("shard")
    got = Counter((r.doc_id, r.text, r.source, r.shard, r.position) for r in mixing.mix_sources(df, shard_docs=50, block_docs=4, seed=3).collect())
    null = mixing._NULL
    units = {(r.doc_id, r.s): (r.h, r.g) for r in df.selectExpr("doc_id", "coalesce(source, '\\0null') AS s").selectExpr("doc_id", "s", "xxhash64(3, doc_id, s) AS h", "xxhash64(4, xxhash64(3, doc_id, s)) AS g").collect()}
    counts = Counter(s for _, s in units)
    quota = mixing.quotas(dict(counts), mixing.smoothed(dict(counts), mixing.POWER))
    names, total = sorted(quota), sum(quota.values())
    shards = -(-total // 50)
    tree = plain_tree([-(-quota[s] // 4) for s in names], 0, shards, 3)
    place = {}
    for j, s in enumerate(names):
        mine = sorted((u for u in units if u[1] == s), key=lambda u: ((units[u][0] % 2**64) >> 1, units[u][0], u[0] is not None, u[0]))
        ends = np.cumsum([t[j] for t in tree])
        for r, u in enumerate(mine[: quota[s]]):
            place[u] = int(np.searchsorted(ends, r // 4, side="right"))
    want = Counter()
    for shard in range(shards):
        mine = sorted((u for u, p in place.items() if p == shard), key=lambda u: (units[u][1], units[u][0], u[1], u[0]))
        at = {u: n for n, u in enumerate(mine)}
        want.update((i, t, s, shard, at[i, s or null]) for i, t, s in rows if (i, s or null) in at)
    assert got == want


def test_columns_of_any_name_pass(spark):
    rows = [(i, f"line {i % 7}\nown {i}", "s") for i in range(30)]
    df = frame(spark, rows).selectExpr("concat('d', doc_id) AS doc_id", "text", "source", "h1 AS gone_id", "shard AS gone_lines", "lang AS _tw_k", "k", "shard", "id AS mix_k", "7 AS mix_shard")
    with pytest.raises(ValueError, match="shard"):
        mixing.mix_sources(df)
    out = mixing.mix_sources(df, shard_col="of", position_col="at")
    assert out.columns == [*df.columns, "of", "at"] and sorted(map(tuple, out.drop("of", "at").collect())) == sorted(map(tuple, df.collect()))
    out = linededup.dedup_documents(df)
    assert out.columns == df.columns and {(r.gone_id, r.gone_lines, r._tw_k, r.mix_shard) for r in out.collect()} == {(1, 9, "en", 7)}
    got = {r.doc_id: r.text for r in out.collect()}
    first = {}
    for d in sorted(f"d{i}" for i in range(30)):
        first.setdefault(int(d[1:]) % 7, d)
    assert got == {d: (f"line {int(d[1:]) % 7}\n" if first[int(d[1:]) % 7] == d else "") + f"own {d[1:]}" for d in got} and len(got) == 30


def test_rare_and_null_sources_dont_decide_for_all(spark):
    sizes = {"hot": 6000, "a": 200, "b": 200, "rare": 3}
    rows = [(s, i) for s, n in {**sizes, None: 2}.items() for i in range(n)]
    df = frame(spark, [(n, "t", s) for n, (s, _) in enumerate(rows)]).drop("shard")
    got = Counter(r.source for r in mixing.mix_sources(df, power=mixing.POWER).collect())
    assert got["rare"] == 3 and got[None] == 2 and got["a"] == got["b"] == 200 and got["hot"] >= 2000
    # a null source of any size, equal sources, one source, reviewers' sizes
    assert mixing.quotas({"a": 1000, "b": 1000, mixing._NULL: 5}, {"a": 0.4, "b": 0.4, mixing._NULL: 0.2}) == {"a": 1000, "b": 1000, mixing._NULL: 5}
    assert mixing.quotas({mixing._NULL: 7}, {mixing._NULL: 1.0}) == {mixing._NULL: 7} and mixing.quotas({"a": 7}, {"a": 2.0}) == {"a": 7}
    many = {"w": 10_000_000, "x": 500_000, "y": 200_000, "z": 1}
    target = mixing.smoothed(many, mixing.POWER)
    quota = mixing.quotas(many, target)
    assert quota["z"] == 1 and quota["y"] == 200_000 and quota["w"] > 3_000_000
    assert sum(max(0, target[s] / sum(target.values()) - n / sum(quota.values())) for s, n in quota.items()) < 0.011


def test_mix_stays_at_explicit_weights():
    quota = mixing.quotas({"a": 1000, "b": 100}, {"a": 0.5, "b": 0.5})
    assert quota["b"] == 100 and 100 <= quota["a"] <= 103
