"""Toxicity: a counterfactual-regularised linear classifier.

A text's logit is linear in the rates of its words' features (whole word
and leading letters, hashed), so a word's share of the logit is one number
that a worker remembers, and scoring costs a look-up a word. Features are
kept whose share of toxic texts differs significantly from that of others.
Fitting minimises log loss, an L2 penalty and a counterfactual penalty: in a
sentence of each labelled text identity terms are swapped for others of
their kind (where a text has none, one is put in, and swapped and left out),
and the squared change of the logit is penalised, so that naming a group
neutrally scores as naming another or none.

Fitting uses a bounded sample (``POSITIVES``, ``NEGATIVES`` rows of the
training folds, whole texts, drawn by a hash of the id); scoring covers
every row. Labels, language, source and id are never inputs of a score.

Defined cases: a null or empty text has no words and gets the score of the
intercept. Very long texts are read whole, in time linear in their length.
Repeated rows get equal scores, and ties cannot arise. With no labelled row
of one class every score is that class's rate, or 0 with no label at all. A
null id is in the fold of the empty text. ``score`` reads the id and text
columns only and ``drop_toxic`` returns all columns as they are, so other
columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm.sampling import fold, labelled
from claimweave.llm.tables import in_workers, table

#: Most rows of each class to fit on.
POSITIVES, NEGATIVES = 2_000, 3_000
#: Folds; fold 0 is held out.
FOLDS = 5
BITS = 20
#: A text's rates are multiplied by this, after this many words are added to its length.
SCALE, SMOOTH = 50.0, 20.0
#: Leading letters of a word that are features.
PREFIXES = (3, 4, 5, 6, 7, 8)
#: Most features kept, in how many sampled texts each must be, and standard errors by which its shares of the classes must differ.
FEATURES, LEAST_TEXTS, LEAST_Z = 20_000, 3, 2.5
#: Weights of the L2 and the counterfactual penalties, and steps of a fit.
L2, COUNTERFACTUAL, STEPS = 2e-4, 1.0, 200
#: Words of a sentence in which terms are swapped.
SENTENCE = 30
#: Identity terms in four languages; within a row they are exchanged for each other.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "woman", "man"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "heterosexual"),
    ("immigrants", "natives", "refugees", "citizens"),
    ("deaf", "blind", "disabled", "elderly", "young"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("christen", "muslime", "juden", "buddhisten", "atheisten"),
    ("schwarze", "weiße", "asiatische", "afrikanische", "europäische"),
    ("schwul", "lesbisch", "bisexuell", "heterosexuell"),
    ("einwanderer", "einheimische", "flüchtlinge", "bürger"),
    ("gehörlose", "blinde", "behinderte", "ältere", "junge"),
    ("femmes", "hommes", "filles", "garçons"),
    ("chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "athées"),
    ("noirs", "blancs", "asiatiques", "africains", "européens"),
    ("homosexuels", "lesbiennes", "bisexuels", "hétérosexuels"),
    ("immigrés", "réfugiés", "citoyens", "étrangers"),
    ("sourds", "aveugles", "handicapés", "âgés", "jeunes"),
    ("mujeres", "hombres", "chicas", "chicos"),
    ("cristianos", "musulmanes", "judíos", "hindúes", "budistas", "ateos"),
    ("negros", "blancos", "asiáticos", "africanos", "europeos"),
    ("homosexuales", "lesbianas", "bisexuales", "heterosexuales"),
    ("inmigrantes", "refugiados", "ciudadanos", "extranjeros"),
    ("sordos", "ciegos", "discapacitados", "ancianos", "jóvenes"),
)
_STRIP = ".,;:!?\"'()[]{}<>*_-–—…«»"
_SWAP = {term: row[(i + 1) % len(row)] for row in IDENTITY_TERMS for i, term in enumerate(row)}
_TERMS = sorted(_SWAP)


class Model:
    """Weights of hashed features, and an intercept."""

    def __init__(self, weights: dict[int, float], bias: float):
        self.weights, self.bias = weights, bias
        self.digest = hashlib.sha256(repr((sorted(weights.items()), bias)).encode()).hexdigest()


@lru_cache(maxsize=50_000)
def features(word: str) -> tuple[int, ...]:
    """Hashed features of a word as it stands in a text."""
    word = word.strip(_STRIP).lower()
    if not word:
        return ()
    mask = (1 << BITS) - 1
    return (crc32(f"={word}".encode("utf-8", "replace")) & mask, *(crc32(f"{n}{word[:n]}".encode("utf-8", "replace")) & mask for n in PREFIXES if n < len(word)))


def rates(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(features in order, scaled rates) of a text's words."""
    found = np.array([f for w in words for f in features(w)], dtype=np.int64)
    at, times = np.unique(found, return_counts=True)
    return at.astype(np.int32), (times * (SCALE / (len(words) + SMOOTH))).astype(np.float32)


def swapped(words: list[str]) -> list[str] | None:
    """The words with each identity term exchanged for the next of its row; None if there is none."""
    out = [_SWAP.get(w.strip(_STRIP).lower(), w) for w in words]
    return out if out != words else None


def _difference(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    at, place = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
    return at.astype(np.int32), np.bincount(place, np.concatenate([a[1], -b[1]]), minlength=len(at)).astype(np.float32)


def counterfactuals(words: list[str]) -> list[tuple[list[str], list[str]]]:
    """Pairs of a sentence of the text that differ in identity terms alone: swapped where it has some, else put in."""
    if not words:
        return []
    draw = crc32(" ".join(words[:200]).encode("utf-8", "replace"))
    named = [i for i, w in enumerate(words) if w.strip(_STRIP).lower() in _SWAP]
    at = named[draw % len(named)] if named else draw % len(words)
    start = max(0, at - SENTENCE // 2)
    sentence = words[start : start + SENTENCE]
    if named:
        return [(sentence, swapped(sentence) or sentence)]
    term = _TERMS[(draw >> 8) % len(_TERMS)]
    put = lambda t: [*sentence[: at - start], t, *sentence[at - start :]]
    return [(put(term), put(_SWAP[term])), (put(term), sentence)]


def _sampled_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of each text, and the differences that swaps make, one after the other with their lengths."""
    for batch in batches:
        rows: list[tuple] = []
        for text in batch.column(0).to_pylist():
            words = (text or "").split()
            x = rates(words)
            d = [_difference(rates(a), rates(b)) for a, b in counterfactuals(words)]
            lengths = np.array([len(at) for at, _ in d], np.int32)
            rows.append((x[0].tobytes(), x[1].tobytes(), b"".join(at.tobytes() for at, _ in d), b"".join(r.tobytes() for _, r in d), lengths.tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.binary())] * 5, ["at", "rate", "swap_at", "swap_rate", "swaps"])


class _Rows:
    """Sparse rows; products with a vector and of a vector."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], width: int):
        self.at = np.concatenate([r[0] for r in rows]) if rows else np.zeros(0, np.int32)
        self.value = np.concatenate([r[1] for r in rows]) if rows else np.zeros(0, np.float32)
        self.row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows]) if rows else np.zeros(0, np.int64)
        self.n, self.width = len(rows), width

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * weights[self.at], minlength=self.n)

    def back(self, of_rows: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, self.value * of_rows[self.row], minlength=self.width)


def _telling(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> np.ndarray:
    """Features, in order, whose shares of the two classes differ significantly."""
    n1, n = labels.sum(), len(labels)
    df1 = np.bincount(np.concatenate([r[0] for r, y in zip(rows, labels, strict=True) if y == 1]), minlength=1 << BITS)
    df = df1 + np.bincount(np.concatenate([r[0] for r, y in zip(rows, labels, strict=True) if y != 1]), minlength=1 << BITS)
    share = (df + 1) / (n + 2)
    z = np.abs(df1 / n1 - (df - df1) / (n - n1)) / np.sqrt(share * (1 - share) * (1 / n1 + 1 / (n - n1)))
    found = np.flatnonzero((z >= LEAST_Z) & (df >= LEAST_TEXTS))
    return np.sort(found[np.argsort(-z[found], kind="stable")[:FEATURES]])


def _narrowed(rows: list[tuple[np.ndarray, np.ndarray]], place: np.ndarray, width: int) -> _Rows:
    return _Rows([(place[at][place[at] >= 0], rate[place[at] >= 0]) for at, rate in rows], width)


def _fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, swaps: list[tuple[np.ndarray, np.ndarray]], others: list[tuple[np.ndarray, np.ndarray]] = ()) -> tuple[Model, np.ndarray]:
    """The classifier, for which both classes weigh the same, and its logits of ``others``."""
    if not len(labels) or labels.min() == labels.max():
        bias = 8.0 if len(labels) and labels[0] else -8.0
        return Model({}, bias), np.full(len(others), bias)
    kept = _telling(rows, labels)
    place = np.full(1 << BITS, -1, dtype=np.int32)
    place[kept] = np.arange(len(kept))
    x, d = _narrowed(rows, place, len(kept)), _narrowed(swaps, place, len(kept))
    n1, n = labels.sum(), len(labels)
    of_row = np.where(labels == 1, 0.5 / n1, 0.5 / (n - n1))
    weights, bias = np.zeros(len(kept)), 0.0
    m = v = np.zeros(len(kept) + 1)
    for step in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(x.dot(weights) + bias, -30, 30)))
        error = of_row * (p - labels)
        slope = x.back(error) + L2 * weights
        if d.n:
            slope += 2 * COUNTERFACTUAL / d.n * d.back(d.dot(weights))
        g = np.append(slope, error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.08 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        weights, bias = weights - move[:-1], bias - move[-1]
    return Model(dict(zip(kept.tolist(), weights.tolist(), strict=True)), bias), _narrowed(others, place, len(kept)).dot(weights) + bias


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, swaps: list[tuple[np.ndarray, np.ndarray]], prior: float) -> Model:
    """The classifier of least error where a share ``prior`` of the rows has label 1.

    The intercept is moved to the cut that is best for out-of-fold logits.
    """
    model, _ = _fit(rows, labels, swaps)
    if not model.weights or min(labels.sum(), len(labels) - labels.sum()) < 4:
        return model
    logit = np.zeros(len(rows))
    part = np.arange(len(rows)) % 3
    for k in range(3):
        rest, own = np.flatnonzero(part != k), np.flatnonzero(part == k)
        logit[own] = _fit([rows[i] for i in rest], labels[rest], swaps, [rows[i] for i in own])[1]
    order = np.argsort(logit)
    weight = np.where(labels == 1, prior / labels.sum(), (1 - prior) / (len(labels) - labels.sum()))[order]
    missed = np.append(0, np.cumsum(weight * (labels[order] == 1)))  # below each cut
    wrong = missed + np.append(np.cumsum((weight * (labels[order] == 0))[::-1])[::-1], 0)
    # A cut parts unequal logits only.
    apart = np.append(True, np.append(np.diff(logit[order]) > 0, True))
    best = np.flatnonzero(apart & (wrong <= wrong[apart].min() + 1e-12))
    at = int(best[len(best) // 2])
    edges = np.concatenate([[logit.min() - 1], logit[order], [logit.max() + 1]])
    return Model(model.weights, model.bias - float(edges[at] + edges[at + 1]) / 2)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on a bounded sample of the training folds."""
    is_train = fold(id_col, FOLDS) != 0
    counts = {r["toxic"]: r["count"] for r in labels.filter(is_train & F.col("toxic").isin(0, 1)).groupBy("toxic").count().collect()}
    total = sum(counts.values())
    rows, y, swaps = [], [], []
    for value, most in ((1, POSITIVES), (0, NEGATIVES)):
        some = labelled(docs, labels, "toxic", value, most, is_train, id_col).select(text_col)
        for r in in_workers(some, _sampled_features, "at binary, rate binary, swap_at binary, swap_rate binary, swaps binary").collect():
            rows.append((np.frombuffer(r["at"], np.int32), np.frombuffer(r["rate"], np.float32)))
            y.append(value)
            ends = np.cumsum(np.frombuffer(r["swaps"], np.int32))[:-1]
            if r["swaps"]:
                swaps += zip(np.split(np.frombuffer(r["swap_at"], np.int32), ends), np.split(np.frombuffer(r["swap_rate"], np.float32), ends), strict=True)
    prior = min(max(counts.get(1, 0) / total, 1e-3), 1 - 1e-3) if total else 0.5
    return fit(rows, np.array(y, dtype=float), swaps, prior)


def counterfactual_gap(texts: list[str], model: Model) -> float:
    """The mean absolute change of a sentence's logit when its identity terms are swapped, put in or left out."""
    pairs = [p for t in texts for p in counterfactuals(t.split())]
    a, b = (logits([" ".join(p[i]) for p in pairs], model) for i in (0, 1))
    return float(np.abs(a - b).mean()) if pairs else 0.0


class Shares(dict):
    """What each word adds to the logit, bounded."""

    def __init__(self, weights: dict[int, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        out = sum(self.weights.get(f, 0.0) for f in features.__wrapped__(word))
        if len(self) >= 150_000:
            self.clear()
        if len(word) < 64:
            self[word] = out
        return out


#: The shares of the model that this worker used last, by the model's digest.
_last: dict[str, Shares] = {}


def logits(texts: list[str | None], model: Model) -> np.ndarray:
    if model.digest not in _last:
        _last.clear()
        _last[model.digest] = Shares(model.weights)
    share, out = _last[model.digest], []
    for text in texts:
        words = (text or "").split()
        out.append(sum(map(share.__getitem__, words)) * SCALE / (len(words) + SMOOTH) + model.bias)
    return np.array(out, dtype=float)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score of every row; the model, of bounded size, is broadcast."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = 1 / (1 + np.exp(-np.clip(logits(batch.column(1).to_pylist(), sent.value), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], [id_col, "score"])

    return in_workers(docs.select(id_col, text_col), run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, score double")


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is under one half."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(logits(batch.column(place).to_pylist(), sent.value) < 0))

    return in_workers(docs, run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", (fold("doc_id", FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
