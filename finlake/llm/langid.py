"""Language identification (2): averaged hashed subword embeddings and a linear softmax, with calibrated rejection.

A text is the average of the embeddings of its hashed subwords (2 to 4 bytes
of the lower-cased text, everything but letters a blank). Embeddings and
softmax are trained by stochastic gradient descent in numpy on a bounded,
documented sample of labelled rows. As the model is linear behind the average,
a prediction only sums one row per subword of the product of both matrices.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finlake.llm.base import crc_bucket, hash_fraction, slices

BUCKETS = 1 << 15
DIMENSIONS = 16
ORDERS = (2, 3, 4)
#: Training rows for each language: the bound of the sample, as many languages as there may be.
ROWS_PER_LANGUAGE = 300
EPOCHS, RATE, BATCH = 4, 20.0, 16
#: Share of calibration rows, and of right calibration rows that may fall below the rejection threshold.
CALIBRATION = 0.25
REJECT_RIGHT = 0.001
#: Bytes hashed in one go; longer texts are summed up over several.
STEP = 1 << 20
#: Subwords from which buckets are counted before the table is read.
DENSE = 1 << 13

_LETTER = regex.compile(r"\p{L}")
_CLEAN = np.full(256, 0x20, dtype=np.uint32)
_CLEAN[97:123] = np.arange(97, 123)
_CLEAN[128:] = np.arange(128, 256)


def has_letter(text: str) -> bool:
    return _LETTER.search(text) is not None


def subwords(text: str) -> Iterator[np.ndarray]:
    """Bucket numbers of a text's subwords, a bounded number at a time."""
    data = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "surrogatepass"), np.uint8)
    longest = max(ORDERS)
    for at in range(0, len(data), STEP):
        part = _CLEAN[data[at:at + STEP + longest - 1]]
        for order in ORDERS:
            n = min(STEP, len(part) - order + 1)
            if n <= 0:
                continue
            h = np.full(n, order, dtype=np.uint32)
            for j in range(order):
                h = (h ^ part[j:j + n]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
            keep = (part[:n] != 0x20) | (part[1:n + 1] != 0x20)
            yield ((h * np.uint32(0x9E3779B1)) >> np.uint32(17))[keep]


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their shares."""
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for part in subwords(text):
        counts += np.bincount(part, minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at.astype(np.uint16), (counts[at] / max(1, counts.sum())).astype(np.float32)


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray        # BUCKETS x languages: embeddings times softmax weights, over the temperature
    threshold: float

    def probabilities(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.languages)), 0
        for part in subwords(text):
            if len(part) > DENSE:
                total += np.bincount(part, minlength=BUCKETS) @ self.table
            else:
                total += self.table[part].sum(axis=0, dtype=np.float64)
            n += len(part)
        return _softmax(total / max(1, n))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: list[str], seed: int = 7) -> LanguageModel:
    """Train on three quarters of the bags, scale and set the threshold on the rest."""
    languages = sorted(set(labels))
    y = np.array([languages.index(x) for x in labels])
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held = order[:int(len(y) * CALIBRATION)] if len(y) >= 8 else order[:0]
    train = order[len(held):]
    # No bias, and embeddings start at zero: a text of unknown subwords has even odds, and is rejected.
    emb = np.zeros((BUCKETS, DIMENSIONS), dtype=np.float32)
    weights = rng.normal(0, 1 / np.sqrt(DIMENSIONS), (DIMENSIONS, len(languages))).astype(np.float32)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for at in range(0, len(train), BATCH):
            batch = train[at:at + BATCH]
            idx = np.concatenate([bags[i][0] for i in batch]).astype(np.int64)
            val = np.concatenate([bags[i][1] for i in batch])
            sizes = np.array([len(bags[i][0]) for i in batch])
            owner = np.repeat(np.arange(len(batch)), sizes)
            mean = np.zeros((len(batch), DIMENSIONS), dtype=np.float32)
            np.add.at(mean, owner, emb[idx] * val[:, None])
            error = _softmax(mean @ weights)
            error[np.arange(len(batch)), y[batch]] -= 1
            error /= len(batch)
            back = error @ weights.T
            weights -= rate * (mean.T @ error)
            np.add.at(emb, idx, -rate * back[owner] * val[:, None])
    table = emb @ weights
    held = held if len(held) else train
    logits = np.array([(table[bags[i][0].astype(np.int64)] * bags[i][1][:, None]).sum(axis=0) for i in held])
    temperatures = np.geomspace(0.1, 10, 60)
    losses = [-np.log(_softmax(logits / t)[np.arange(len(held)), y[held]] + 1e-12).mean() for t in temperatures]
    t = float(temperatures[int(np.argmin(losses))])
    p = _softmax(logits / t)
    right = np.sort(p.max(axis=1)[p.argmax(axis=1) == y[held]])
    # Between even odds and certainty at most; a right calibration row is hardly ever below.
    most = 0.5 + 0.5 / len(languages)
    threshold = min(most, float(right[int(REJECT_RIGHT * len(right))])) if len(right) else 0.0
    return LanguageModel(languages, (table / t).astype(np.float32), threshold)


def train(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang") -> LanguageModel | None:
    """Model from at most ``ROWS_PER_LANGUAGE`` usable labelled rows of each language; None without any.

    Every language is learned. Its rows are those with the smallest hashes of
    id and text, whatever the order of rows or how often an id repeats. The
    tasks send bags, never texts.
    """
    rows = docs.where(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    # One row a language, as the model has.
    counts = rows.groupBy(lang_col).count().collect()
    if not counts:
        return None
    # Twice the rows wanted, so that their order only has to be found among few.
    share = F.create_map(*[F.lit(v) for r in counts for v in (r[0], min(1.0, 2 * ROWS_PER_LANGUAGE / r["count"]))])
    chosen = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), hash_fraction(id_col, text_col).alias("at"))
    chosen = chosen.where(F.col("at") < share[F.col("lang")])
    first = Window.partitionBy("lang").orderBy("at", F.xxhash64("text"))
    chosen = chosen.withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= ROWS_PER_LANGUAGE).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            bags = [bag(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([i.tobytes() for i, _ in bags], pa.binary()),
                pa.array([v.tobytes() for _, v in bags], pa.binary())], names=["lang", "idx", "val"])

    sample = chosen.mapInArrow(run, "lang string, idx binary, val binary").collect()
    if not sample:
        return None
    sample.sort(key=lambda r: (r[0], bytes(r[1])))
    return fit([(np.frombuffer(r[1], np.uint16), np.frombuffer(r[2], np.float32)) for r in sample], [r[0] for r in sample])


def predict(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, ``lang_pred``, ``lang_score`` and ``lang_rejected`` in front of clashing ones.

    ``lang_pred`` is a learned language, ``und`` for a null text or one without
    a letter, or when nothing could be learned; these have score 0 and are
    rejected, as are texts whose calibrated probability is below the model's
    threshold. Every row is kept; columns of ``docs`` with these names are replaced.
    """
    made = ["lang_pred", "lang_score", "lang_rejected"]
    kept = docs.drop(*made)
    broadcast = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = broadcast.value
        for batch in slices(batches):
            pred, score, rejected = [], [], []
            for text in batch.column(text_col).to_pylist():
                if model is None or not text or not has_letter(text):
                    pred.append("und"), score.append(0.0), rejected.append(True)
                    continue
                p = model.probabilities(text)
                best = int(p.argmax())
                pred.append(model.languages[best]), score.append(float(p[best]))
                rejected.append(bool(p[best] < model.threshold))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                names=[*batch.schema.names, *made])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema),
                        "lang_pred string, lang_score double, lang_rejected boolean"])
    return kept.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are never learned from."""
    return F.coalesce(crc_bucket(id_col, 3) == 1, F.lit(False))
