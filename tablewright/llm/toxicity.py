"""Toxicity by non-negative positive-unlabelled learning.

Positives are documents confirmed toxic, the unlabelled sample is drawn from all documents. A numpy linear model over
letter n-grams and beginnings of words is trained by the non-negative estimator of the PU risk,

    pi * R_p^+(g) + max(0, R_u^-(g) - pi * R_p^-(g)),

whose class prior pi is estimated first, from the share of the two samples above each cut of a positive-against-unlabelled
score. Every document is then scored over its whole text.

Bounds (parameters): ``max_positive`` and ``max_unlabelled`` documents for training, chosen by hash of the id, and ``features``
n-grams; the class prior is estimated over all documents, by a pass that counts scores above each cut. The driver gets the
chosen n-grams and a row of their values for each training document, whatever the length of texts. Results for odd input:
null and empty texts score as a text without features and are never toxic, texts of any length are scored whole; a null id is
kept as null; labels without a document don't count, an id of several rows is trained on by its least text; repeated rows
score alike and ties in the choice of n-grams go by their letters; where no n-gram stands out among confirmed toxic documents, or there are no
documents, nothing is toxic and scores are null. Other columns of the input aren't read, and pass through with ``keep``.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import byte_slices, col, written

_SIZES, _STARTS = (4,), (4, 6, 8)


def plain(text: str) -> str:
    """Lower case, words parted by one blank, a blank in front."""
    return " " + " ".join(text.lower().split())


def word_grams(word: str) -> tuple[str, ...]:
    """Runs of 4 letters of a word, and its beginnings of 4, 6 and 8 letters behind a blank."""
    return tuple({word[i : i + n] for n in _SIZES for i in range(len(word) - n + 1)} | {" " + word[:n] for n in _STARTS if n <= len(word)})


def text_grams(text: str | None, memo: dict[str, tuple[str, ...]]) -> set[str]:
    """The n-grams of a text's words."""
    out: set[str] = set()
    for w in set((text or "").lower().split()):
        g = memo.get(w)
        if g is None:
            g = memo[w] = word_grams(w)
        out.update(g)
    return out


def _value(count: int) -> float:
    return math.log1p(count)


@dataclass
class Model:
    """Linear score ``bias + sum of weight * log(1 + count)`` over features; toxic above 0."""

    weights: dict[str, float]
    bias: float
    prior: float

    def scorer(self):
        """Score of a text, by one automaton over all features."""
        import ahocorasick

        if not self.weights:
            return lambda text: self.bias
        auto = ahocorasick.Automaton()
        for g, w in self.weights.items():
            auto.add_word(g, (g, w))
        auto.make_automaton()

        def of(text: str | None) -> float:
            hits = Counter(v for _, v in auto.iter(plain(text))) if text else {}
            return self.bias + sum(w * _value(n) for (_, w), n in hits.items())

        return of


def _matrix(texts: list[str], index: dict[str, int]) -> np.ndarray:
    import ahocorasick

    x = np.zeros((len(texts), len(index)), np.float32)
    auto = ahocorasick.Automaton()
    for g, i in index.items():
        auto.add_word(g, i)
    if index:
        auto.make_automaton()
        for row, t in zip(x, texts):
            for i, n in Counter(v for _, v in auto.iter(plain(t))).items():
                row[i] = _value(n)
    return x


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _descend(xp: np.ndarray, xu: np.ndarray, prior: float | None, steps: int, rate: float = 0.05, decay: float = 1e-4) -> np.ndarray:
    """Weights, the bias last, by Adam on the logistic loss. Without a prior: positives against unlabelled."""
    w, m, v = (np.zeros(xp.shape[1] + 1) for _ in range(3))
    w[-1] = -1

    def slope(x: np.ndarray, r: np.ndarray) -> np.ndarray:
        return np.append(r @ x, r.sum()) / len(x)

    for t in range(1, steps + 1):
        zp, zu = xp @ w[:-1] + w[-1], xu @ w[:-1] + w[-1]
        sp, su = _sigmoid(zp), _sigmoid(zu)
        if prior is None:
            g = slope(xp, sp - 1) + slope(xu, su)
        else:
            rest = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            back = slope(xu, su) - prior * slope(xp, sp)
            # below zero the negative part has been overfitted: step back up that part alone
            g = prior * slope(xp, sp - 1) + back if rest >= 0 else -back
        g[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w[:-1] = np.maximum(w[:-1], 0)  # features were chosen as signs of toxicity
    return w


def cuts_of(sp: np.ndarray) -> np.ndarray:
    return np.unique(np.quantile(sp, np.linspace(0.02, 0.8, 60)))


def estimate_prior(sp: np.ndarray, cuts: np.ndarray, above: np.ndarray, n: int) -> float:
    """Least ratio of shares above a cut, of all documents to positive ones, judged by its upper confidence bound. ``above``: of
    n documents, those with a score of each cut or more."""
    best, bound = 0.5, np.inf
    for cut, a in zip(cuts, above):
        p, u = (sp >= cut).mean(), a / n
        error = (np.sqrt(u * (1 - u) / n) + 1 / n) / p + u / p * np.sqrt((1 - p) / (p * len(sp)))
        if u / p + error < bound:
            best, bound = u / p, u / p + error
    return float(min(max(best, 1.0 / max(n, 2)), 0.9))


def choose(fp: Counter, fu: Counter, n_p: int, n_u: int, features: int, lift: float, evidence: float) -> list[str]:
    """N-grams that stand out in positive documents: several times as frequent as at large, by ``lift``, and how far above
    chance (Poisson tail, in nats), by ``evidence``."""
    gain = {}
    for g, n in fp.items():
        e = (fu[g] + 0.5) * n_p / n_u
        if n >= 3 and n > lift * e and (x := n * np.log(n / e) - (n - e)) > evidence:
            gain[g] = x
    return sorted(gain, key=lambda g: (-gain[g], g))[:features]


def learn(grams: list[str], xp: np.ndarray, xu: np.ndarray, steps: int, above) -> Model:
    """Fit a model to feature rows. ``above(model, cuts)``: (of all documents those with a score of each cut or more, their number)."""
    prior = 0.1
    if len(xp) >= 4 and len(xu) >= 4:  # the prior from positive rows that the score hasn't seen
        half = np.arange(len(xp)) % 2 == 0
        w = _descend(xp[half], xu[np.arange(len(xu)) % 2 == 0], None, steps // 4)
        sp = xp[~half] @ w[:-1] + w[-1]
        cuts = cuts_of(sp)
        prior = estimate_prior(sp, cuts, *above(Model(dict(zip(grams, map(float, w))), float(w[-1]), 0.0), cuts))
    w = _descend(xp, xu, prior, steps)
    return Model(dict(zip(grams, map(float, w))), float(w[-1]), prior)


_NONE = Model({}, -1.0, 0.0)


def train(positive: list[str], unlabelled: list[str], everything: list[str] | None = None, features: int = 512, steps: int = 800, lift: float = 2.5, evidence: float = 11.0) -> Model:
    """Fit a model to texts at hand; ``everything``: the corpus whose class prior counts, the unlabelled texts without it."""
    memo: dict[str, tuple[str, ...]] = {}
    fp, fu = Counter(), Counter()
    for texts, counts in ((positive, fp), (unlabelled, fu)):
        for t in texts:
            counts.update(text_grams(t, memo))
    grams = choose(fp, fu, len(positive), len(unlabelled), features, lift, evidence) if positive and unlabelled else []
    if not grams:
        return _NONE
    index = {g: i for i, g in enumerate(grams)}

    def above(model: Model, cuts: np.ndarray) -> tuple[np.ndarray, int]:
        of, texts = model.scorer(), unlabelled if everything is None else everything
        s = np.array([of(t) for t in texts])
        return np.array([(s >= c).sum() for c in cuts]), len(texts)

    return learn(grams, _matrix(positive, index), _matrix(unlabelled, index), steps, above)


def fit(docs: DataFrame, labels: DataFrame, max_positive: int = 2000, max_unlabelled: int = 4000, features: int = 512, steps: int = 800, lift: float = 2.5, evidence: float = 11.0, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic") -> Model:
    """Train on documents with label 1 and on documents at large, both bounded samples by hash of the id."""
    text = docs.select(col(id_col).alias("k"), col(text_col).cast("string").alias("x"))
    ids = text.select("k").where("k IS NOT NULL").distinct()
    order = [F.xxhash64("k", F.lit(7)), "k"]
    known = labels.where(col(toxic_col) == 1).select(col(id_col).alias("k"))
    chosen = ids.join(known, "k", "left_semi").orderBy(*order).limit(max_positive).withColumn("p", F.lit(1)).unionByName(
        ids.orderBy(*order).limit(max_unlabelled).withColumn("p", F.lit(0)))
    # at most max_positive + max_unlabelled ids: a bounded broadcast
    rows = text.join(F.broadcast(chosen), "k").groupBy("p", "k").agg(F.coalesce(F.min("x"), F.lit("")).alias("x"))
    rows = written(rows.select("p", F.col("k").cast("string").alias("k"), "x"), "toxic-sample")
    size = {r.p: r["count"] for r in rows.groupBy("p").count().collect()}
    if len(size) < 2:
        return _NONE

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, tuple[str, ...]] = {}
        for batch in batches:
            for part in byte_slices(batch, "x"):
                found = Counter()
                for p, x in zip(part.column("p").to_pylist(), part.column("x").to_pylist()):
                    found.update((g, p) for g in text_grams(x, memo))
                yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in found], pa.string()), pa.array([p for _, p in found], pa.int32()), pa.array(list(found.values()), pa.int64())], ["g", "p", "n"])

    e = (F.col("fu") + 0.5) * size[1] / size[0]
    n = F.col("fp")
    gain = n * F.log(n / e) - (n - e)
    counts = rows.mapInArrow(count, "g string, p int, n long").groupBy("g").agg(F.sum(F.when(F.col("p") == 1, F.col("n")).otherwise(0)).alias("fp"), F.sum(F.when(F.col("p") == 0, F.col("n")).otherwise(0)).alias("fu"))
    grams = counts.where((n >= 3) & (n > lift * e)).withColumn("gain", gain).where(F.col("gain") > evidence).orderBy(F.desc("gain"), "g").limit(features).collect()
    grams = [r.g for r in grams]
    if not grams:
        return _NONE
    index = {g: i for i, g in enumerate(grams)}

    def values(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "x"):
                x = _matrix(part.column("x").to_pylist(), index)
                yield pa.RecordBatch.from_arrays([part.column("p"), part.column("k"), pa.array([r.tobytes() for r in x], pa.binary())], ["p", "k", "v"])

    got = sorted(rows.mapInArrow(values, "p int, k string, v binary").collect(), key=lambda r: (r.p, r.k))  # a row a training document
    xp, xu = (np.array([np.frombuffer(r.v, np.float32) for r in got if r.p == p]) for p in (1, 0))

    def above(model: Model, cuts: np.ndarray) -> tuple[np.ndarray, int]:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of = model.scorer()
            for batch in batches:
                for part in byte_slices(batch, "x", 16 << 20):
                    s = np.sort([of(t) for t in part.column("x").to_pylist()])
                    n = len(s) - np.searchsorted(s, cuts)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(cuts))), pa.array(np.append(len(s), n))], ["i", "n"])

        found = {r.i: r.n for r in text.select("x").mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()}  # a row a cut
        return np.array([found.get(i, 0) for i in range(len(cuts))]), found.get(-1, 1)

    return learn(grams, xp, xu, steps, above)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """(id, score, toxic) of every row; with ``keep`` the rows themselves that aren't toxic, all columns as they are."""
    if not keep:
        source = docs.select(col(id_col).alias("k"), col(text_col).cast("string").alias("x"))
        id_type = source.schema[0].dataType.simpleString()
        text = "x"
    else:
        source, text = docs, text_col

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scorer()
        for batch in batches:
            for part in byte_slices(batch, text, 16 << 20):
                s = np.array([of(t) for t in part.column(text).to_pylist()], float)
                toxic = s > 0
                if keep:
                    yield part.filter(pa.array(~toxic))
                else:
                    none = np.full(len(s), not model.weights)
                    yield pa.RecordBatch.from_arrays([part.column("k"), pa.array(s, mask=none), pa.array(toxic)], ["k", "score", "toxic"])

    if keep:
        return source.mapInArrow(run, source.schema)
    return source.mapInArrow(run, f"k {id_type}, score double, toxic boolean").withColumnRenamed("k", id_col)
