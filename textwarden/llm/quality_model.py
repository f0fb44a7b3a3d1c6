"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network.

Units are word forms (lower-cased, hashed to FORMS buckets), word shapes (case, digits, symbols, length) and
gaps (how many words back the same form stands in the text, by powers of two; 0 where it is new).
Each unit has a fixed sparse index vector (SIGNS entries of 1 or -1, dealt by a hash); its context vector is the sum of its neighbours' index vectors
over all texts of the corpus, counted in one pass and added up without bringing partial tables to the
driver. A document is the frequency-weighted mean of its words' normalised context vectors. A numpy
network (one hidden layer) learns labels from at most ``sample`` labelled rows; part of these sets a
temperature, so that scores are calibrated probabilities.

Cases: null and empty texts pool to the zero vector and get the network's answer to it; rows with a null doc_id
are scored, never learnt from, and not held out; repeated label rows all count, null labels do not; repeated
documents are scored each; without a label of each kind every score is the smoothed share of label 1; extra
columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import stored
from .vectors import SCHEMA, summed, vector_rows
from .words import LOWER, SPACES, U, Words, crc32_mod5, groups, hash_ranges, lean, mix, segment

FORMS = 1 << 14
SHAPES = 1 << 10
GAPS = 16
UNITS = FORMS + SHAPES + GAPS
DIMS = 32
SIGNS = 4
FEATURES = 3 * DIMS + 1
SAMPLE = 20_000
THRESHOLD = 0.3

_UPPER, _LOWERS, _DIGIT, _OTHER = (np.zeros(256, bool) for _ in range(4))
_UPPER[0x41:0x5B] = True
_LOWERS[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_DIGIT[0x30:0x3A] = True
_OTHER[:] = ~(_UPPER | _LOWERS | _DIGIT)
_KIND = (_LOWERS * 1 + _DIGIT * 2 + _OTHER * 3).astype(np.int64)  # capitals 0


def _units(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(form, shape, gap) units of each word; w holds the texts as they are."""
    hashes = hash_ranges(LOWER[w.data], w.starts, w.ends)
    forms = (hashes % U(FORMS)).astype(np.int64)

    def any_of(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags[w.data], dtype=np.int64)))
        return (total[w.ends] > total[w.starts]).astype(np.int64)

    if not len(w.starts):
        return forms, forms, forms
    first, last = _KIND[w.data[w.starts]], _KIND[w.data[w.ends - 1]]
    length = np.minimum(w.ends - w.starts, 8) - 1
    shape = first | last << 2 | any_of(_OTHER) << 4 | any_of(_DIGIT) << 5 | any_of(_LOWERS) << 6 | length << 7
    own = mix(hashes + w.text_of.astype(U) * U(0x9E3779B97F4A7C15))
    by = np.argsort(own, kind="stable")
    back = np.zeros(len(by), np.int64)
    again = own[by][1:] == own[by][:-1]
    back[by[1:]] = np.where(again, np.diff(by), 0)
    gap = np.where(back > 0, np.minimum(1 + np.log2(np.maximum(back, 1)).astype(np.int64), GAPS - 1), 0)
    return forms, FORMS + shape, FORMS + SHAPES + gap


def _index(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(dimensions, signs) of the SIGNS entries of each unit's index vector; entries on one dimension add up."""
    h = mix(units[:, None].astype(U) * U(SIGNS) + np.arange(SIGNS, dtype=U) + U(0x5851F42D4C957F2D))
    return (h % U(DIMS)).astype(np.int64), np.where(h >> U(63), 1.0, -1.0)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(UNITS * (DIMS + 1))
    context, n = total[: UNITS * DIMS], total[UNITS * DIMS :]
    dims, signs = _index(np.arange(UNITS))
    for b in batches:
        for rows, data, offsets in groups(b.column(0)):
            w = segment(data, offsets, SPACES, rows)
            units, text_of = _units(w), w.text_of
            left = np.flatnonzero(text_of[1:] == text_of[:-1])
            for x, y in ((left, left + 1), (left + 1, left)):
                theirs = np.concatenate([t[y] for t in units])
                at, sign = dims[theirs].T, signs[theirs].T
                for mine in units:
                    own = np.tile(mine[x] * DIMS, len(units))
                    context += np.bincount((own + at).ravel(), sign.ravel(), UNITS * DIMS)
            for mine in units:
                n += np.bincount(mine, minlength=UNITS)
    yield vector_rows(total)


def word_vectors(texts: DataFrame) -> np.ndarray:
    """(UNITS, DIMS) weighted context vectors, counted over all rows of ``texts`` (one column)."""
    total = summed(texts.mapInArrow(lean(_contexts), SCHEMA), UNITS * (DIMS + 1))
    context, n = total[: UNITS * DIMS].reshape(UNITS, DIMS), total[UNITS * DIMS :]
    out = np.zeros((UNITS, DIMS))
    for part in (slice(0, FORMS), slice(FORMS, FORMS + SHAPES), slice(FORMS + SHAPES, UNITS)):
        c, k = context[part], n[part]
        if not k.sum():
            continue
        # What every context has in common tells nothing.
        c = c - k[:, None] * (c.sum(axis=0) / k.sum())
        length = np.sqrt((c * c).sum(axis=1))
        share = k / k.sum()
        weight = 1e-3 / (1e-3 + share) if part.start == 0 else np.ones(len(k))
        out[part] = np.where(length[:, None] > 0, c / np.maximum(length, 1e-9)[:, None], 0) * weight[:, None]
    return out


def features(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    """Stored rows: id, features (float32 binary). docs: id, text."""
    vectors = vectors.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, data, offsets in groups(b.column(1)):
                w = segment(data, offsets, SPACES, rows)
                n = len(w.counts)
                out = np.zeros((n, FEATURES), np.float32)
                full = np.flatnonzero(w.counts)
                if len(full):
                    for k, units in enumerate(_units(w)):
                        sums = np.add.reduceat(vectors[units], w.first[full], axis=0)
                        out[full, k * DIMS : (k + 1) * DIMS] = sums / w.counts[full, None]
                out[:, -1] = np.log1p(w.counts) / 10
                yield pa.record_batch([b.column(0).slice(rows.start, n), pa.array([x.tobytes() for x in out], pa.binary())], ["id", "features"])

    return stored(docs.mapInArrow(lean(run), "id long, features binary"), "features")


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, hidden: int = 32, steps: int = 1500, seed: int = 1) -> Network:
    """Adam on the log loss of four fifths of the rows; the rest sets the temperature."""
    r = np.random.default_rng(seed)
    width = x.shape[1]
    if len(np.unique(y)) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        return Network(np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))), 1.0)
    by = r.permutation(len(x))
    held, own = by[: len(x) // 5], by[len(x) // 5 :]
    mean, scale = x[own].mean(axis=0), x[own].std(axis=0) + 1e-6
    z = (x - mean) / scale
    p = [r.normal(0, width**-0.5, (width, hidden)), np.zeros(hidden), r.normal(0, hidden**-0.5, hidden), np.zeros(1)]
    moments = [(np.zeros_like(a), np.zeros_like(a)) for a in p]
    for step in range(1, steps + 1):
        pick = own if len(own) <= 512 else own[r.integers(0, len(own), 512)]
        h = np.tanh(z[pick] @ p[0] + p[1])
        d = (1 / (1 + np.exp(-(h @ p[2] + p[3][0]))) - y[pick]) / len(pick)
        back = d[:, None] * p[2] * (1 - h * h)
        slopes = [z[pick].T @ back + 1e-4 * p[0], back.sum(axis=0), h.T @ d + 1e-4 * p[2], np.array([d.sum()])]
        for a, g, (m, v) in zip(p, slopes, moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            a -= 0.005 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3][0]), 1.0)
    logits, target = net.logits(x[held]), y[held]
    loss = lambda t: np.logaddexp(0, np.where(target > 0, -logits, logits) / t).mean()
    net.temperature = float(min(np.geomspace(0.25, 8, 101), key=loss)) if len(held) else 1.0
    return net


def learn(rows: DataFrame, labels: DataFrame, train_on: Column, sample: int = SAMPLE) -> Network:
    """rows: id, features; labels: id, label. At most ``sample`` labelled rows are learnt from, picked by a hash of their ids."""
    known = rows.where(train_on).join(labels.where("label is not null and id is not null"), "id")
    n = known.count()
    if n > sample:
        # The least by a hash, out of about as many as are wanted: the same rows however the table is partitioned.
        known = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * 0.95 * sample / n)).orderBy(F.xxhash64("id"), "id", "label", "features").limit(sample)
    got = known.select("id", "label", "features").toArrow()
    x = np.frombuffer(b"".join(got.column("features").to_pylist()), np.float32).reshape(-1, FEATURES).astype(float)
    y = got.column("label").to_numpy().astype(float)
    by = np.lexsort((y, got.column("id").to_numpy()))
    return fit(x[by], y[by])


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    made = features(rows, word_vectors(rows.select("text")))
    held_out = crc32_mod5(F.col("id")) == 0
    net = learn(made, labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label}`").alias("label")), ~held_out, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.frombuffer(b"".join(b.column(1).to_pylist()), np.float32).reshape(-1, FEATURES)
            yield pa.record_batch([b.column(0), pa.array(net.scores(x.astype(float)))], ["id", "score"])

    scored = made.mapInArrow(lean(run), "id long, score double")
    return scored.select(F.col("id").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op2_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
