"""Toxicity (9): many weak voters, a generative label model, and a linear classifier on its posterior labels.

1. Voters. Labelled rows of the training part show which word stems go with
   the label; each of the strongest stems is a lexicon voter. Patterns vote
   too: several different hits, hits near each other in number, shouting,
   runs of exclamation marks, and a clean vote of texts without any hit.
2. Label model. Expectation maximisation finds, without labels, each voter's
   rates of its votes given either class. Voters that agree more often than
   the classes explain are correlated; each one's evidence is divided by the
   number of voters it repeats.
3. A logistic regression on hashed stems is trained on the posteriors and
   scores every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finlake.llm.base import crc_bucket, hash_fraction, slices

#: Hash buckets of stems.
BUCKETS = 1 << 18
#: Bytes of a word that make a stem; the whole word is one too.
STEMS = (4, 5, 6, 8)
#: Labelled training rows: the bound of the sample.
TRAIN_ROWS = 6_000
#: Lexicon voters, and stems the classifier weighs, at most.
VOTERS, FEATURES = 192, 1_024
#: A stem is a voter when it is so many times likelier in labelled texts.
LEAST_RATIO = 20.0
#: Share of the labelled texts that a voter's or feature's stem occurs in at least.
LEAST_SHARE = 0.02
#: Excess agreement from which two voters count as correlated.
CORRELATED = 0.2
#: Bytes worked on in one go; longer texts are summed up over several.
STEP = 1 << 20

_WORD = np.zeros(256, dtype=bool)
_WORD[97:123] = True
_WORD[128:] = True


def stems(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct stem buckets of a whole text, and its pattern figures: words, shouted words, exclamation runs."""
    found: list[np.ndarray] = []
    figures = np.zeros(3)
    raw = text.encode("utf-8", "surrogatepass")
    figures[1] = _shouted(text)
    figures[2] = text.count("!!")
    low = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8) if raw else np.empty(0, np.uint8)
    at = 0
    while at < len(low):
        end = min(len(low), at + STEP)
        while end < len(low) and _WORD[low[end]]:
            end += 1
        part = low[at:end]
        inside = np.zeros(len(part) + 2, dtype=bool)
        inside[1:-1] = _WORD[part]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, lens = edges[0::2], edges[1::2] - edges[0::2]
        figures[0] += len(starts)
        h = np.zeros(len(starts), dtype=np.uint32)
        for j in range(max(STEMS)):
            here = np.flatnonzero(lens > j)
            h[here] = (h[here] ^ part[starts[here] + j]) * np.uint32(0x01000193)
            if j + 1 in STEMS:
                full = h[lens > j]
                found.append((full ^ np.uint32(j)) * np.uint32(0x9E3779B1) >> np.uint32(14))
        found.append((h ^ lens.astype(np.uint32) << np.uint32(8)) * np.uint32(0x85EBCA6B) >> np.uint32(14))
        at = end
    return (np.unique(np.concatenate(found)) if found else np.empty(0, np.uint32)), figures


def _shouted(text: str) -> int:
    return sum(1 for w in text.split() if len(w) > 2 and w.isupper()) if not text.islower() else 0


def votes(buckets: np.ndarray, figures: np.ndarray, lexicon: np.ndarray) -> np.ndarray:
    """1, 0 or -1 (abstains) of each voter: the lexicon's stems, then the patterns."""
    hits = np.isin(lexicon, buckets, assume_unique=True)
    n = int(hits.sum())
    words, shouted, runs = figures
    patterns = [
        1 if n >= 2 else -1,
        1 if n >= 5 else -1,
        1 if n and n * 50 >= words else -1,
        1 if n and shouted * 4 >= words else -1,
        1 if n and runs else -1,
        0 if n == 0 else -1,
        0 if n == 0 and words >= 20 else -1,
    ]
    return np.concatenate([np.where(hits, 1, -1), patterns]).astype(np.int8)


@dataclass
class LabelModel:
    prior: float
    rates: np.ndarray        # voters x classes x votes (-1, 0, 1)
    shares: np.ndarray       # of each voter's evidence that is its own

    def posterior(self, v: np.ndarray) -> np.ndarray:
        at = v.astype(np.int64) + 1
        log = np.log(self.rates)
        voters = np.arange(len(self.rates))
        evidence = ((log[voters, 1, at] - log[voters, 0, at]) * self.shares).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(np.log(self.prior / (1 - self.prior)) + evidence, -30, 30)))


def fit_label_model(v: np.ndarray, prior: float, rounds: int = 15) -> LabelModel:
    """Rates and correlations of voters from their votes alone, given the share of the class."""
    prior = float(np.clip(prior, 1e-3, 1 - 1e-3))
    n, k = v.shape
    one_hot = np.stack([v == x for x in (-1, 0, 1)], axis=2).astype(np.float64)
    # Start: voters are better than chance.
    start = (v == 1).sum(axis=1) - 2.0 * (v == 0).sum(axis=1)
    p = np.where(start > 0, 0.9, 0.05)
    shares = np.ones(k)
    for step in range(rounds):
        rates = np.empty((k, 2, 3))
        for c, w in ((0, 1 - p), (1, p)):
            # An even vote in a thousand keeps unseen votes possible.
            rates[:, c] = (np.einsum("n,nkx->kx", w, one_hot) + 0.01) / (w.sum() + 0.03)
        if step == 2:
            shares = _own_shares(v, p)
        p = LabelModel(prior, rates, shares).posterior(v)
    return LabelModel(prior, rates, shares)


def _own_shares(v: np.ndarray, p: np.ndarray) -> np.ndarray:
    """One over the voters, itself included, that repeat a voter, by correlation of votes within the classes."""
    active = (v != -1).astype(np.float64)
    within = np.zeros((v.shape[1], v.shape[1]))
    for w in (p, 1 - p):
        if w.sum() < 1:
            continue
        x = active - (w @ active) / w.sum()
        cov = (x * w[:, None]).T @ x / w.sum()
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        within = np.maximum(within, cov / np.outer(sd, sd))
    np.fill_diagonal(within, 1)
    return 1 / np.where(within > CORRELATED, within, 0).sum(axis=1)


@dataclass
class ToxicityModel:
    lexicon: np.ndarray
    labels: LabelModel
    features: np.ndarray     # sorted buckets
    weights: np.ndarray
    bias: float

    def score(self, buckets: np.ndarray) -> float:
        at = np.searchsorted(self.features, buckets)
        at[at == len(self.features)] = 0
        hit = at[self.features[at] == buckets] if len(self.features) else at[:0]
        return float(1 / (1 + np.exp(-np.clip(self.weights[hit].sum() + self.bias, -30, 30))))


def fit(bags: list[np.ndarray], figures: np.ndarray, y: np.ndarray) -> ToxicityModel:
    """Voters from labels, label model from votes, classifier from posteriors."""
    n, positive = len(bags), max(1, int(y.sum()))
    flat = np.concatenate(bags).astype(np.int64) if n else np.empty(0, np.int64)
    owner = np.repeat(np.arange(n), [len(b) for b in bags])
    with_label = np.bincount(flat[y[owner] == 1], minlength=BUCKETS)
    without = np.bincount(flat, minlength=BUCKETS) - with_label
    # Three unseen clean texts with every stem: rare stems need clear evidence.
    ratio = (with_label + 0.5) / (positive + 1) / ((without + 3) / (n - positive + 1))
    strong = np.flatnonzero((with_label >= max(3, LEAST_SHARE * positive)) & (ratio >= LEAST_RATIO))
    strength = with_label[strong] * np.log(ratio[strong])
    lexicon = np.sort(strong[np.argsort(-strength, kind="stable")[:VOTERS]])
    v = np.stack([votes(b, f, lexicon) for b, f in zip(bags, figures)])
    model = fit_label_model(v, positive / n)
    q = model.posterior(v)
    # Stems whose presence tells most about the posterior.
    soft = np.bincount(flat, weights=q[owner], minlength=BUCKETS)
    every = np.bincount(flat, minlength=BUCKETS)
    lift = np.log((soft + 0.5) / (q.sum() + 1)) - np.log((every - soft + 3) / (n - q.sum() + 1))
    gain = np.where((soft >= max(3, LEAST_SHARE * q.sum())) & (lift > 1), soft * lift, 0)
    features = np.sort(np.argsort(-gain, kind="stable")[:FEATURES])
    features = features[gain[features] > 0]
    place = np.searchsorted(features, flat)
    place[place == len(features)] = 0
    kept = features[place] == flat if len(features) else np.zeros(len(flat), dtype=bool)
    rows, cols = owner[kept], place[kept]
    weights, bias = _logistic(rows, cols, q, n, len(features))
    return ToxicityModel(lexicon, model, features, weights, bias)


def _logistic(rows: np.ndarray, cols: np.ndarray, q: np.ndarray, n: int, k: int, rounds: int = 300,
              rate: float = 0.5, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Full-batch gradient descent with per-weight step sizes on soft labels and present features."""
    weights, bias = np.zeros(k), float(np.log((q.mean() + 1e-3) / (1 - q.mean() + 1e-3)))
    sums, sum_b = np.full(k, 1e-8), 1e-8
    for _ in range(rounds):
        z = np.bincount(rows, weights=weights[cols], minlength=n) + bias
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - q
        g = np.bincount(cols, weights=error[rows], minlength=k) / n + ridge * weights
        gb = error.mean()
        sums += g * g
        sum_b += gb * gb
        weights -= rate * g / np.sqrt(sums)
        bias -= 0.1 * rate * gb / np.sqrt(sum_b)
    return weights, float(bias)


def train(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic") -> ToxicityModel | None:
    """Model from at most ``TRAIN_ROWS`` labelled usable rows, chosen by a hash of the id; None without both classes.

    Null labels teach nothing; of several labels for an id the largest holds,
    of several texts the one with the smallest hash.
    The tasks send hashed stems, never texts.
    """
    known = labels.where(usable & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = known.groupBy(id_col).agg(F.max(label_col).cast("int").alias("_label"))
    total = known.count()
    if not total:
        return None
    at = hash_fraction(id_col, salt=9)
    chosen = known.where(at < F.lit(min(1.0, 2 * TRAIN_ROWS / total))).orderBy(at, id_col).limit(TRAIN_ROWS)
    # At most TRAIN_ROWS ids and labels, by the limit. An id teaches one text, however often it repeats.
    rows = docs.select(id_col, F.coalesce(text_col, F.lit("")).alias("_text")).join(F.broadcast(chosen), id_col)
    rows = rows.groupBy(id_col).agg(
        F.max("_label").alias("_label"), F.min_by("_text", F.struct(F.xxhash64("_text"), "_text")).alias("_text")).select("_label", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            made = [stems(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0).cast(pa.int32()),
                pa.array([b.astype(np.uint32).tobytes() for b, _ in made], pa.binary()),
                pa.array([f.tobytes() for _, f in made], pa.binary())], names=["label", "stems", "figures"])

    got = rows.mapInArrow(run, "label int, stems binary, figures binary").collect()
    got.sort(key=lambda r: (bytes(r[1]), r[0]))
    y = np.array([r[0] for r in got], dtype=np.int64).clip(0, 1)
    if len(y) < 2 or y.min() == y.max():
        return None
    return fit([np.frombuffer(r[1], np.uint32) for r in got], np.array([np.frombuffer(r[2]) for r in got]), y)


def predict(docs: DataFrame, model: ToxicityModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id and ``score`` in [0, 1].

    A null or empty text has no stem and gets the score of the bias alone, a
    table without a usable model 0 throughout. Null ids and repeated rows are
    kept; other columns are not read.
    """
    kind = dict(docs.dtypes)[id_col]
    broadcast = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES and VOTERS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = broadcast.value
        for batch in slices(batches):
            scores = [model.score(stems(t or "")[0]) if model else 0.0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, score double")


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose label is never learned from."""
    return F.coalesce(crc_bucket(id_col, 5) == 0, F.lit(False))
