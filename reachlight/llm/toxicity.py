"""Toxicity by weak supervision.

Voters are a lexicon in four languages, patterns, and word beginnings that training rows with label 1 have and others
lack. Each voter votes toxic or stays silent. A generative label model (EM over two hidden classes whose vote rates and
common covariance are estimated from the votes alone) weighs voters by accuracy and discounts correlated ones; labels
choose beginnings and calibrate, and are no votes. A logistic classifier is trained on the posteriors; fit and score
use one feature function on whole texts. Only rows whose crc32(doc_id) mod 5 is not 0 train. At most MOST_ROWS labelled
rows (smallest hash of doc_id first) are fitted: the one bounded sample. Null and empty texts score as texts without
hits; rows with a null doc_id are scored and never train; repeated rows repeat; extra columns are ignored. Without any
toxic labelled row the lexicon alone decides.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut, texts

#: Bound of the labelled sample.
MOST_ROWS = 8000
#: Insults that vote.
LEXICON = {
    "en": ["arsehole", "bastard", "bitch", "clown", "coward", "creep", "degenerate", "disgusting", "dumb", "fool", "garbage", "hate", "idiot", "imbecile", "jerk", "kill", "liar", "loser", "moron", "nasty", "pathetic", "pig", "scum", "stupid", "trash", "ugly", "vermin", "worthless"],
    "de": ["abschaum", "arschloch", "blödmann", "depp", "dreck", "dumm", "dummkopf", "ekelhaft", "hässlich", "idioten", "idiotisch", "lügner", "miststück", "schwachkopf", "schwein", "trottel", "verlierer", "versager", "wertlos"],
    "fr": ["abruti", "connard", "crétin", "dégoûtant", "imbécile", "inutile", "laid", "lâche", "merde", "minable", "ordure", "pathétique", "raclure", "salaud", "stupide", "vermine"],
    "es": ["asqueroso", "basura", "bastardo", "cobarde", "escoria", "estúpido", "feo", "idiota", "imbécil", "inútil", "mentiroso", "mierda", "patético", "payaso", "perdedor", "tonto"],
}
PATTERNS = [r"\byou (?:are|re) (?:a|an|so|such)\b", r"\bshut up\b", r"\bgo to hell\b", r"\bdu bist (?:ein|so)\b", r"\bhalt(?:'s| die) (?:maul|klappe)\b", r"\btu es (?:un|une|si)\b", r"\bferme[- ]la\b", r"\beres (?:un|una|tan)\b", r"\bcállate\b", r"!{3,}"]
WORDS = [w for lang in LEXICON.values() for w in lang]
STEMS, MOST_STEMS = range(4, 8), 400
#: A beginning votes if at least so many training rows with label 1 have it, and so much of its rows.
LEAST_ROWS, LEAST_SHARE = 4, 0.9
RIDGE = 0.02
#: Weight of a lexicon word before any data.
PRIOR = 2.0
words_of = re.compile(r"\w+").findall


def stems(words) -> set[str]:
    """Beginnings of the words, and whole words marked by a closing $."""
    return {w[:n] for w in words for n in STEMS if len(w) > n} | {w + "$" for w in words}


def chosen(counts) -> list[str]:
    """Voting beginnings from (stem, rows with label 1, other rows); of many the most frequent."""
    out = [(n, s) for s, n, m in counts if n >= LEAST_ROWS and n / (n + m) >= LEAST_SHARE]
    return [s for _, s in sorted(out, key=lambda x: (-x[0], x[1]))[:MOST_STEMS]]


def label_model(V: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Posterior of the hidden label for each row of votes: two classes with rates a and b and a common covariance."""
    n, k = V.shape
    post = np.where(V.sum(1) > 0, 0.9, 0.02)
    for _ in range(rounds):
        on, off = post.sum(), n - post.sum()
        a, b = (V.T @ post + 0.1) / (on + 1), (V.T @ (1 - post) + 0.01) / (off + 1)
        x, y = V - a, V - b
        cov = ((x * post[:, None]).T @ x + (y * (1 - post)[:, None]).T @ y) / n
        w = np.linalg.solve(cov + RIDGE * np.eye(k), a - b)
        z = np.clip(V @ w - (a + b) @ w / 2 + np.log(on / off), -30, 30)
        new = 1 / (1 + np.exp(-z))
        if np.abs(new - post).max() < 1e-6:
            return new
        post = new
    return post


def logistic(X: np.ndarray, target: np.ndarray, ridge: float, prior: np.ndarray | float = 0.0) -> tuple[np.ndarray, float]:
    """Weights, drawn towards prior, and bias by Newton steps; targets may be probabilities."""
    Z = np.column_stack([X, np.ones(len(X))])
    w, R = np.zeros(Z.shape[1]), ridge * np.eye(Z.shape[1])
    prior = np.append(np.broadcast_to(prior, X.shape[1]), 0.0)
    R[-1, -1] = 1e-6
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(Z @ w, -30, 30)))
        step = np.linalg.solve((Z * np.maximum(p * (1 - p), 1e-4)[:, None]).T @ Z + R, Z.T @ (target - p) - R @ (w - prior))
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


class Model:
    def __init__(self, beginnings: list[str]):
        self.lexicon = {w: k for k, w in enumerate(WORDS)}
        self.stems = {s: len(WORDS) + k for k, s in enumerate(beginnings)}
        self.n = len(WORDS) + len(beginnings) + len(PATTERNS)
        self.patterns = [(re.compile(p), self.n - len(PATTERNS) + k) for k, p in enumerate(PATTERNS)]
        self.weights, self.bias = np.zeros(self.n + 2), -2.0
        self.weights[: len(WORDS)] = 4.0
        #: Words that begin otherwise have no voter.
        self.heads = {s.rstrip("$")[: STEMS[0]] for s in (*WORDS, *beginnings)}

    def voters(self, w: str) -> list[int]:
        got = [self.lexicon[w]] if w in self.lexicon else []
        return got + [self.stems[s] for s in (*(w[:n] for n in STEMS if len(w) > n), w + "$") if s in self.stems]

    def features(self, text: str) -> np.ndarray:
        """Votes, log of the hits, and the share of words that hit."""
        low = text.lower()
        x, hits, counted = np.zeros(self.n + 2), 0, Counter(words_of(low))
        for w in [w for w in counted if w[: STEMS[0]] in self.heads]:
            if v := self.voters(w):
                hits += counted[w]
                x[v] = 1
        for p, k in self.patterns:
            x[k] = p.search(low) is not None
        x[self.n], x[self.n + 1] = np.log1p(hits), min(1.0, 20 * hits / max(counted.total(), 1))
        return x

    def fit(self, X: np.ndarray, y: np.ndarray) -> None:
        votes = X[:, : self.n]
        post = label_model(votes[:, votes.sum(0) >= 2])
        # What the sample cannot tell stays as the lexicon says.
        w, c = logistic(X, post, 1.0, np.concatenate([np.full(len(WORDS), PRIOR), np.zeros(X.shape[1] - len(WORDS))]))
        # Calibration: one slope and bias by the labels.
        z = X @ w + c
        slope, bias = logistic(z[:, None], (y * y.sum() + y) / (y.sum() + 2) + (1 - y) / (len(y) - y.sum() + 2), 1e-3)
        self.weights, self.bias = w * slope[0], c * slope[0] + bias

    def score(self, text: str) -> float:
        z = float(self.features(text) @ self.weights + self.bias)
        return float(1 / (1 + np.exp(-max(-30.0, min(30.0, z)))))


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text and toxic (0 or 1) of at most MOST_ROWS labelled training rows."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") > 0).cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").where(~held_out())
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_ROWS)
    return cut(texts(docs).join(F.broadcast(rows), "doc_id").select("text", "toxic"))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    rows = sample(docs, labels)

    def begin(batches):
        for b in batches:
            found = [(s, y) for t, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()) for s in stems(set(words_of(t.lower())))]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in found], pa.string()), pa.array([y for _, y in found], pa.int32())], names=["stem", "toxic"])

    counts = rows.mapInArrow(begin, "stem string, toxic int").groupBy("stem").agg(F.sum("toxic").alias("bad"), F.count("*").alias("all"))
    counts = counts.where(F.col("bad") >= LEAST_ROWS).where(F.col("bad") >= LEAST_SHARE * F.col("all")).orderBy(F.desc("bad"), "stem").limit(MOST_STEMS)
    model = Model(chosen((r.stem, r.bad, r["all"] - r.bad) for r in counts.collect()))

    def measure(batches):
        for b in batches:
            x = [model.features(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(x, pa.list_(pa.float32()))], names=["toxic", "x"])

    # At most MOST_ROWS rows of at most a few hundred features.
    got = rows.mapInArrow(measure, "toxic int, x array<float>").toArrow()
    y = got.column("toxic").to_numpy().astype(float)
    if y.any():
        model.fit(np.stack(got.column("x").to_pylist()).astype(float), y)
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([m.score(t) for t in b.column("text").to_pylist()], pa.float64())], names=["doc_id", "score"])

    return texts(docs).mapInArrow(run, "doc_id long, score double")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per document."""
    return scored(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that the classifier accepts (score below 0.5); all columns stay."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    @F.pandas_udf("boolean")
    def rejects(text):
        return text.map(lambda t: sent.value.score(t or "") >= 0.5)

    return docs.where(~rejects(F.coalesce("text", F.lit(""))))
