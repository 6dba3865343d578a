"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled rows of quality 1 in the training folds;
unlabelled rows are drawn from all web text, whatever their label. The
class prior is estimated as the smallest ratio of unlabelled to positive
mass over regions that classifiers of other folds rank highest. Then a small
network minimises the non-negative unbiased risk
prior * E_P[loss(+)] + max(0, E_U[loss(-)] - prior * E_P[loss(-)]).
Its logits are moved so that ``THRESHOLD`` is the cut that tells the classes
apart best: with the prior, out-of-fold scores of positives and unlabelled
rows give the share of negatives above each cut, without one label 0.

Fitting uses bounded samples (``POSITIVES`` and ``UNLABELLED`` rows, drawn
by a hash of the id); scoring covers every row and whole texts. Labels of
quality 0 are never used. Labels, language, source and id are never inputs
of a score.

Defined cases: null and empty texts have the features of a text without
words. Very long texts are described whole, in time linear in their length;
rows go through a few at a time. Repeated rows and ids get equal scores.
Without any trusted positive every score is 0.5. A null id is in the fold of
the empty text. Of the input only the id and text columns are read, so other
columns may have any name.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm.sampling import first_by_hash, fold, labelled
from claimweave.llm.tables import in_workers, table

#: Most rows of each sample.
POSITIVES, UNLABELLED = 8_000, 12_000
#: Folds; fold 2 is held out.
FOLDS, HELD_OUT = 4, 2
#: Score from which a text is predicted to be good.
THRESHOLD = 0.7
HIDDEN, STEPS, BATCH = 24, 250, 512
#: Folds for the prior, and for the calibration.
PRIOR_FOLDS, CUT_FOLDS = 3, 2

_PUNCTUATION = [c for c in range(33, 127) if not chr(c).isalnum()]


def describe(text: str | None) -> list[float]:
    """Features of a whole text: shares of kinds of characters, and how words and lines repeat."""
    text = text or ""
    data = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    counts = np.bincount(data, minlength=256) / (len(data) + 1)
    words = text.split()
    n = len(words) + 1
    lines = text.split("\n")
    ends = [w[-1] for w in words]
    return [
        *np.sqrt(counts[_PUNCTUATION]),
        counts[48:58].sum(), counts[65:91].sum(), counts[97:123].sum(), counts[128:].sum(), counts[10], counts[32],
        sum(map(operator.eq, words, words[1:])) / n, len(set(words)) / n, len(set(lines)) / len(lines),
        sum(map(str.isupper, words)) / n, sum(map(str.isalpha, words)) / n, 1 - sum(map(str.isalnum, ends)) / n,
        np.log1p(len(words)) / 10, len(text) / n / 10, np.log1p(len(words) / len(lines)) / 10,
    ]


def features(texts: list[str | None]) -> np.ndarray:
    return np.array([describe(t) for t in texts], dtype=np.float32).reshape(len(texts), len(_PUNCTUATION) + 15)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Network:
    """One hidden layer over standardised features."""

    def __init__(self, x: np.ndarray, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = x.mean(0), x.std(0) + 1e-3
        self.parts = [rng.normal(0, 0.2, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.2, HIDDEN), np.zeros(1)]
        self.m = [np.zeros_like(p) for p in self.parts]
        self.v = [np.zeros_like(p) for p in self.parts]
        self.steps, self.decay, self.shift, self.prior = 0, 1e-4, 0.0, 0.5

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z = np.clip((x - self.mean) / self.spread, -8, 8)
        h = np.tanh(z @ self.parts[0] + self.parts[1])
        return z, h, h @ self.parts[2] + self.parts[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.forward(x)[2] + self.shift) if len(x) else np.zeros(0)

    def step(self, x: np.ndarray, slope: np.ndarray, rate: float) -> None:
        """Move against ``slope``, the risk's derivative by each row's logit."""
        z, h, _ = self.forward(x)
        back = np.outer(slope, self.parts[2]) * (1 - h * h)
        slopes = [z.T @ back + self.decay * self.parts[0], back.sum(0), h.T @ slope + self.decay * self.parts[2], np.array([slope.sum()])]
        self.steps += 1
        for i, g in enumerate(slopes):
            self.m[i] = 0.9 * self.m[i] + 0.1 * g
            self.v[i] = 0.999 * self.v[i] + 0.001 * g * g
            self.parts[i] = self.parts[i] - rate * (self.m[i] / (1 - 0.9**self.steps)) / (np.sqrt(self.v[i] / (1 - 0.999**self.steps)) + 1e-8)


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 3) -> Network:
    """Minimise the non-negative risk with the logistic loss, in minibatches."""
    net, rng = Network(unlabelled, seed), np.random.default_rng(seed)
    net.decay = max(1e-4, 2.0 / len(unlabelled))
    size = min(BATCH, len(unlabelled))
    for step in range(STEPS):
        rate = 0.01 * 0.05 ** (step / STEPS)
        u = unlabelled[rng.integers(0, len(unlabelled), size)]
        p = positive[rng.integers(0, len(positive), size)]
        fp, fu = net.forward(p)[2], net.forward(u)[2]
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        if negative >= 0:
            on_p = prior * (_sigmoid(fp) - 1) / len(p) - prior * _sigmoid(fp) / len(p)
            on_u = _sigmoid(fu) / len(u)
        else:  # the estimate of the negatives' risk overfits: undo it
            on_p, on_u = prior * _sigmoid(fp) / len(p), -_sigmoid(fu) / len(u)
        net.step(np.concatenate([p, u]), np.concatenate([on_p, on_u]), rate)
    return net


def discriminate(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 3) -> Network:
    """A classifier of positive against unlabelled rows, which ranks as one of the classes would."""
    net, rng = Network(unlabelled, seed), np.random.default_rng(seed)
    net.decay = max(1e-4, 2.0 / len(unlabelled))
    size = min(BATCH, len(unlabelled))
    for step in range(STEPS):
        p, u = positive[rng.integers(0, len(positive), size)], unlabelled[rng.integers(0, len(unlabelled), size)]
        slope = np.concatenate([_sigmoid(net.forward(p)[2]) - 1, _sigmoid(net.forward(u)[2])]) / (2 * size)
        net.step(np.concatenate([p, u]), slope, 0.01 * 0.05 ** (step / STEPS))
    return net


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, folds: int = PRIOR_FOLDS) -> float:
    """The largest share of unlabelled rows that positives can explain, by out-of-fold ranks among the fold's positives."""
    rank_p, rank_u = np.zeros(len(positive)), np.zeros(len(unlabelled))
    of_p, of_u = np.arange(len(positive)) % folds, np.arange(len(unlabelled)) % folds
    for k in range(folds):
        net = discriminate(positive[of_p != k], unlabelled[of_u != k])
        known = np.sort(net.score(positive[of_p == k]))
        for rank, of, rows in ((rank_p, of_p, positive), (rank_u, of_u, unlabelled)):
            rank[of == k] = np.searchsorted(known, net.score(rows[of == k]), "left") / max(len(known), 1)
    ratios = [(rank_u >= c).mean() / (rank_p >= c).mean() for c in np.linspace(0, 0.9, 91)]
    return float(np.clip(min(ratios), 0.02, 0.98))


def best_cut(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> float:
    """The logit above which most positives and fewest negatives lie, by out-of-fold logits of both samples."""
    above_p, above_u = np.zeros(len(positive)), np.zeros(len(unlabelled))
    for k in range(CUT_FOLDS):
        net = fit(np.delete(positive, np.s_[k::CUT_FOLDS], 0), np.delete(unlabelled, np.s_[k::CUT_FOLDS], 0), prior)
        above_p[k::CUT_FOLDS], above_u[k::CUT_FOLDS] = net.forward(positive[k::CUT_FOLDS])[2], net.forward(unlabelled[k::CUT_FOLDS])[2]
    cuts = np.unique(np.quantile(above_p, np.linspace(0, 0.5, 101)))
    caught = np.array([(above_p >= c).mean() for c in cuts])
    wrong = np.clip((np.array([(above_u >= c).mean() for c in cuts]) - prior * caught) / (1 - prior), 0, 1)
    best = np.flatnonzero(caught - wrong >= (caught - wrong).max() - 1e-9)
    return float(cuts[best[len(best) // 2]])


def _sampled_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = features(batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([row.tobytes() for row in x], pa.binary())], ["x"])


def _collect(texts: DataFrame) -> np.ndarray:
    rows = in_workers(texts, _sampled_features, "x binary").collect()
    return np.array([np.frombuffer(r["x"], np.float32) for r in rows], dtype=np.float32)


def calibrated(positive: np.ndarray, unlabelled: np.ndarray) -> Network:
    prior = estimate_prior(positive, unlabelled)
    net = fit(positive, unlabelled, prior)
    net.prior, net.shift = prior, float(np.log(THRESHOLD / (1 - THRESHOLD))) - best_cut(positive, unlabelled, prior)
    return net


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Network | None:
    is_train = fold(id_col, FOLDS) != HELD_OUT
    positive = _collect(labelled(docs, labels, "quality", 1, POSITIVES, is_train, id_col).select(text_col))
    ids = first_by_hash(docs.filter(is_train).select(id_col), UNLABELLED, id_col)
    unlabelled = _collect(docs.join(F.broadcast(ids.distinct()), id_col, "left_semi").select(text_col))
    if len(positive) < PRIOR_FOLDS or len(unlabelled) < PRIOR_FOLDS:
        return None
    return calibrated(positive, unlabelled)


def score(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score of every row; the network, of fixed size, is broadcast."""
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            scores = sent.value.score(features(texts)) if sent.value is not None else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores.astype(float))], [id_col, "score"])

    return in_workers(docs.select(id_col, text_col), run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, net).select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
