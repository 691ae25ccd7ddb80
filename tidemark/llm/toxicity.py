"""Toxicity by learning from confirmed toxic examples and unlabelled text.

A linear model over hashed words and beginnings of words is trained with the non-negative risk estimator
for positive and unlabelled data: pi * R_p(+1) + max(0, R_u(-1) - pi * R_p(-1)), pi being the class prior.
Weights and bias are what it learns. Features are scaled by how unevenly positive and unlabelled texts
hold them, and a text's features to length one. Scores of a linear model that is far larger than its
sample are too near the middle, so a slope and an offset are learned last, by the same risk, on scores of
sample texts from models that have not seen them. Labels of the negative class are used for the prior
alone, and no label of the held-out fold is read.

Training data are bounded samples of labelled rows (MAX_POSITIVE, MAX_UNLABELLED), the lowest in
the order of a hash of their ids. Scoring covers every whole text; the broadcast weights have a fixed
size. A null text counts as empty and scores by the bias. Rows are never merged; a row with a null id is
held out. Without positive or unlabelled rows to learn from, every text scores the prior. An empty table
gives an empty one. A column of the score's name is overwritten; drop_toxic takes a free name.
"""

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import _text
from tidemark.llm._tables import free_name

#: Bounds of the training samples, in rows.
MAX_POSITIVE = 4000
MAX_UNLABELLED = 12000
THRESHOLD = 0.7
BITS = 21
#: Gradient steps in all, however small the sample is, and unlabelled texts of each.
STEPS = 1200
BATCH = 128
PARTS = 3
RATE = 0.02
DECAY = 1e-5
#: One unlabelled text in so many is added as a text without words.
BLANK = 16
#: Texts of the sample that a feature must be in.
LEAST_TEXTS = 5
#: Bytes of the word beginnings that count as features beside whole words.
PREFIXES = (4, 5, 6)
FOLDS, HELD_OUT = 3, 1


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(True))


def _hashed(parts: _text.Words) -> np.ndarray:
    """Feature numbers, one row for whole words and one for each length of prefix; a column for each word."""
    ends = [parts.end, *(np.minimum(parts.start + n, parts.end) for n in PREFIXES)]
    return np.stack([(_text.ranges(parts.data, parts.start, end) >> np.uint64(64 - BITS)).astype(np.int64) for end in ends])


def _features(parts: _text.Words, use: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers of each text, text by text, and how many each has; of those in use only."""
    feature, doc = _hashed(parts), parts.doc().astype(np.int64)
    keys = [(doc[m] << BITS) | row[m] for row in feature for m in [slice(None) if use is None else use[row]]]
    key = np.unique(np.concatenate(keys))
    return key & ((1 << BITS) - 1), np.bincount(key >> BITS, minlength=len(parts.bounds) - 1)


def _letters(data: np.ndarray) -> np.ndarray:
    """Punctuation between words reads as space, so that a word counts as one however it is followed."""
    data = _text.LOWER[data]
    out = data.copy()
    out[np.isin(data, np.frombuffer(b".,;:!?\"'()[]{}", dtype=np.uint8))] = 32
    return out


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, offsets in _text.slices(batch, "text"):
            feature, size = _features(_text.words(_letters(data), offsets))
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array(feature.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column("toxic"), part.column("part"), lists], ["toxic", "part", "features"])


@dataclass
class Model:
    """Weights of scaled features and the squares of the scales, by feature number; the bias; and slope and offset of the calibration."""

    weights: np.ndarray
    squares: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    def logits(self, feature: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Of texts with so many features each."""
        doc = np.repeat(np.arange(len(size)), size)
        total, squares = (np.bincount(doc, w[feature], minlength=len(size)) for w in (self.weights, self.squares))
        return self.slope * (total / np.sqrt(np.maximum(squares, 1e-6)) + self.bias) + self.offset


class _Adam:
    def __init__(self, size: int, rate: float) -> None:
        self.m, self.v, self.t, self.rate = np.zeros(size), np.zeros(size), 0, rate

    def step(self, gradient: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m, self.v = 0.9 * self.m + 0.1 * gradient, 0.999 * self.v + 0.001 * gradient**2
        return self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def risk_slopes(z: np.ndarray, k: int, prior: float) -> np.ndarray:
    """The non-negative risk's derivative by each logit, with the logistic loss; the first k texts are positive, the others unlabelled."""
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    negative = np.mean(np.logaddexp(0, z[k:])) - prior * np.mean(np.logaddexp(0, z[:k]))
    if negative >= 0:
        return np.append(prior * (p[:k] - 1) / k - prior * p[:k] / k, p[k:] / (len(z) - k))
    # The negative part has gone below zero: only it is stepped, upwards.
    return np.append(prior * p[:k] / k, -p[k:] / (len(z) - k))


@dataclass
class Sample:
    """Texts to learn from: their distinct feature numbers, one text after another, and where each begins."""

    features: np.ndarray
    bounds: np.ndarray

    def counts(self, texts: np.ndarray) -> np.ndarray:
        """In how many of these texts each feature is."""
        mine = np.zeros(len(self.bounds) - 1, dtype=bool)
        mine[texts] = True
        mine, out = np.repeat(mine, np.diff(self.bounds)), np.zeros(1 << BITS, dtype=np.int64)
        for at in range(0, len(mine), 1 << 20):  # in steps, so that little is held twice
            out += np.bincount(self.features[at : at + (1 << 20)][mine[at : at + (1 << 20)]], minlength=1 << BITS)
        return out

    def each(self, flat: np.ndarray, texts: np.ndarray) -> np.ndarray:
        """The parts of an array beside features that belong to these texts."""
        return np.concatenate([flat[self.bounds[i] : self.bounds[i + 1]] for i in texts])


def nnpu_fit(sample: Sample, positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 7) -> Model:
    """A model by stochastic gradients (Adam) of the non-negative risk; positive and unlabelled number texts of the sample."""
    rng = np.random.default_rng(seed)
    n_p, n_u = len(positive), len(unlabelled)
    of_p, of_u = sample.counts(positive), sample.counts(unlabelled)
    use = of_p + of_u >= min(LEAST_TEXTS, max(1, n_p // 20))
    scale = np.where(use, np.abs(np.log((of_p + 1) / (n_p + 2)) - np.log((of_u + 1) / (n_u + 2))), 0).astype(np.float32)
    place = np.maximum(np.cumsum(use) - 1, 0).astype(np.int32)[sample.features]
    value = scale[sample.features]
    size = np.diff(sample.bounds)
    length = np.sqrt(np.maximum(np.add.reduceat(np.append(value * value, np.float32(0)), sample.bounds[:-1]) * (size > 0), 1e-6))
    w, b = np.zeros(max(1, int(use.sum()))), float(np.log(prior / (1 - prior)))
    adam_w, adam_b = _Adam(len(w), RATE), _Adam(1, RATE)
    steps = max(8, n_u // BATCH)
    for _ in range(-(-STEPS // steps)):
        order_p, order_u = rng.permutation(positive), rng.permutation(unlabelled)
        for pick_p, pick_u in zip(np.array_split(np.resize(order_p, max(n_p, steps)), steps), np.array_split(order_u, steps), strict=True):
            if not len(pick_u):
                continue
            pick = np.concatenate([pick_p, pick_u])
            doc = np.repeat(np.arange(len(pick)), size[pick])
            feature, values = sample.each(place, pick), sample.each(value, pick) / length[pick][doc]
            # Some unlabelled texts without a known word, so that these are told by the prior, not by what is between the classes.
            z = np.append(np.bincount(doc, w[feature] * values, minlength=len(pick)), np.zeros(-(-len(pick_u) // BLANK))) + b
            g = risk_slopes(z, len(pick_p), prior)
            w = w - adam_w.step(np.bincount(feature, g[doc] * values, minlength=len(w)) + DECAY * w)
            b -= float(adam_b.step(np.array([g.sum()]))[0])
    weights = np.zeros(1 << BITS, dtype=np.float32)
    weights[use] = w[: int(use.sum())] * scale[use]
    return Model(weights, scale**2, b)


def _calibrated(model: Model, sample: Sample, positive: np.ndarray, unlabelled: np.ndarray, part: np.ndarray, prior: float) -> Model:
    """The model with slope and offset that least the risk of logits of texts by models learned from the other parts; a text is in one part wherever it stands."""
    every = np.append(positive, unlabelled)
    z, blank = np.zeros(len(every)), []
    for n in range(PARTS):
        other = nnpu_fit(sample, positive[part[positive] != n], unlabelled[part[unlabelled] != n], prior)
        mine = np.flatnonzero(part[every] == n)
        for at in range(0, len(mine), 512):
            texts = every[mine[at : at + 512]]
            z[mine[at : at + 512]] = other.logits(sample.each(sample.features, texts), np.diff(sample.bounds)[texts])
        blank += [other.bias] * -(-int((part[unlabelled] == n).sum()) // BLANK)
    z = np.append(z, blank)
    line, adam = np.array([1.0, 0.0]), _Adam(2, 0.02)
    for _ in range(3000):
        g = risk_slopes(line[0] * z + line[1], len(positive), prior)
        line = line - adam.step(np.array([(g * z).sum(), g.sum()]))
    return replace(model, slope=float(max(line[0], 0.1)), offset=float(line[1]))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from docs (doc_id, text) and labels (doc_id, toxic), held-out fold aside."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    total = known.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("p")).first()
    prior = min(0.9, max(0.01, total["p"] / max(1, total["n"])))
    order = F.xxhash64("doc_id")
    sample = known.where("toxic = 1").orderBy(order, "doc_id").limit(MAX_POSITIVE)
    hidden = known.orderBy(F.xxhash64("doc_id", F.lit("unlabelled")), "doc_id").limit(MAX_UNLABELLED).withColumn("toxic", F.lit(0))
    picked = F.broadcast(sample.unionByName(hidden))  # MAX_POSITIVE + MAX_UNLABELLED ids at most
    texts = docs.select("doc_id", "text").join(picked, "doc_id").select("toxic", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(PARTS)).cast("int").alias("part"), "text")
    rows = texts.mapInArrow(_extract, "toxic int, part int, features array<int>").toArrow()
    toxic, part = (rows.column(c).to_numpy() for c in ("toxic", "part"))
    positive, unlabelled = (np.flatnonzero(toxic == n) for n in (1, 0))
    if not len(positive) or not len(unlabelled):
        none = np.zeros(1 << BITS, dtype=np.float32)
        return Model(none, none, float(np.log(prior / (1 - prior))))
    lists = rows.column("features").combine_chunks()
    sample = Sample(lists.flatten().to_numpy(), np.append(0, np.cumsum(lists.value_lengths().to_numpy())))
    model = nnpu_fit(sample, positive, unlabelled, prior)
    every = all(len(np.unique(part[g])) == PARTS for g in (positive, unlabelled))
    return _calibrated(model, sample, positive, unlabelled, part, prior) if every else model


def _score(model: Model, series: Iterator[pd.Series]) -> Iterator[pd.Series]:
    use = model.squares != 0
    for texts in series:
        out = [np.zeros(0)]
        batch = pa.RecordBatch.from_arrays([pa.array(texts, type=pa.string())], ["text"])
        for _, data, offsets in _text.slices(batch, "text"):
            z = model.logits(*_features(_text.words(_letters(data), offsets), use))
            out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
        yield pd.Series(np.concatenate(out))


def score_toxicity(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """docs with a score of each whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # twice 2**BITS floats

    @F.pandas_udf("double")
    def scored(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from _score(sent.value, series)

    return docs.withColumn(column, scored("text"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with its score."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    out = score_toxicity(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs that do not score as toxic, unchanged."""
    column = free_name(docs, "score_")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    return score_toxicity(docs, model, column).where(F.col(column) < THRESHOLD).select(*docs.columns)
