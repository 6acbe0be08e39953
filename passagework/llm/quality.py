"""Operator 9: quality classifier, an ordinal cumulative-link regression on graded ratings.

A document's score is a weighted sum of hashed text features, the same weights for all grades; ordered thresholds on it
give the probability of each grade or better. Features are which words a text has, and how common each kind of sign run
and of letter case is in it. Training takes a bounded sample of labelled rows; scoring reads every whole text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import beside, table
from .ngramjoin import _BLANK, _LOWER
from .pretokens import slice_hashes, text_runs

#: Hashed features, labelled rows that training takes at most, and how many standard errors the share of some grade
#: or better among the rows with a feature (weighted by its values) must be off that of all for it to get a weight.
BITS, SAMPLE, LEAST_Z = 18, 5000, 4.5
ROUNDS, RATE, DECAY = 200, 0.1, 3e-4
#: Toxic, poor, good: a document stays if the probability of the last is at least TAIL.
GRADES, TAIL = 3, 0.35
SCORES = ["expected_grade", "tail_probability"]

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_SIGN = ~_LETTER & ~_BLANK
_SIGN[48:58] = False
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0))
    return edge[::2], edge[1::2]


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature number, value), by row: 1 for each distinct word, the square root of its share for each sign run and letter case, and for words that repeat the one before."""
    raw = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    stops = np.cumsum([len(t) + 1 for t in texts])
    mask, size = (1 << BITS) - 1, len(texts)
    a, b = _runs(_LETTER[raw])
    word, owner = slice_hashes(_LOWER[raw], a, b) & np.uint64(mask), np.searchsorted(stops, a, side="right")
    words = np.unique(owner.astype(np.int64) << BITS | word.astype(np.int64))
    upper = np.concatenate([[0], np.cumsum(_UPPER[raw])])
    case = np.where((upper[b] - upper[a] == b - a) & (b - a > 1), 1, np.where(_UPPER[raw[a]], 2, 3)) if len(a) else np.zeros(0, np.int64)
    c, d = _runs(_SIGN[raw])
    sign, owner2 = (slice_hashes(raw, c, d) ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(mask), np.searchsorted(stops, c, side="right")
    kinds, times = np.unique(np.concatenate([owner.astype(np.int64) << BITS | case, owner2.astype(np.int64) << BITS | sign.astype(np.int64)]), return_counts=True)
    n = np.maximum(1, np.bincount(owner, minlength=size))
    again = np.zeros(len(word), bool)
    again[1:] = (word[1:] == word[:-1]) & (owner[1:] == owner[:-1])
    case, owner = np.concatenate([case, np.full(again.sum(), 4)]), np.concatenate([owner, owner[again]])
    keys = np.concatenate([words, kinds])
    values = np.concatenate([np.ones(len(words)), np.sqrt(np.minimum(1, times / n[kinds >> BITS]))])
    order = np.argsort(keys, kind="stable")
    return keys[order] >> BITS, keys[order] & mask, values[order]


def rows_of(docs: DataFrame, extra: str) -> DataFrame:
    """Features of texts as arrays, beside the columns named in extra."""

    def run(batches):
        for batch in batches:
            for first, texts in text_runs(batch.column(1)):
                row, number, value = features(texts)
                cuts = pa.array(np.searchsorted(row, np.arange(len(texts) + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(cuts, pa.array(number, pa.int64())), pa.ListArray.from_arrays(cuts, pa.array(value, pa.float64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), *lists], names=["grade", "number", "value"])

    return docs.select(F.col(extra).cast("int").alias("grade"), "text").mapInArrow(run, "grade int, number array<long>, value array<double>")


def graded(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, grade) of at most so many labelled rows, those of least hash: 0 toxic, 1 poor, 2 good. Rows without a rating are left out."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    rated = labels.select(F.col("doc_id").cast("long").alias("doc_id"), grade.alias("grade")).filter("doc_id is not null and grade is not null")
    return rated.orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(sample)


class Model:
    """Weights of hashed features and ordered thresholds."""

    def __init__(self, weights: np.ndarray, cuts: np.ndarray):
        self.weights, self.cuts = weights, cuts

    def tails(self, score: np.ndarray) -> np.ndarray:
        """Probability of each grade from 1 up, or better."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.cuts[None, :], -40, 40)))


def fit(rows: list, grades: int = GRADES, least_z: float = LEAST_Z, rounds: int = ROUNDS, rate: float = RATE, decay: float = DECAY) -> Model:
    """Maximum likelihood by Adam, with weight decay. Rows: (grade, numbers, values). Without rows of two grades nothing is rejected."""
    if len({r[0] for r in rows}) < 2:
        return Model(np.zeros(1 << BITS), np.full(grades - 1, -40.0))
    y = np.array([r[0] for r in rows])
    number, value = (np.concatenate([np.asarray(r[k]) for r in rows]) for k in (1, 2))
    number = number.astype(np.int64)
    row = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    mass, off = np.maximum(np.bincount(number, value**2, minlength=1 << BITS), 1e-9), np.zeros(1 << BITS)
    for k in range(1, grades):
        better = (y >= k).astype(float)
        if 0 < better.mean() < 1:
            pull = np.bincount(number, value * (better - better.mean())[row], minlength=1 << BITS)
            off = np.maximum(off, np.abs(pull) / (better.std() * np.sqrt(mass)))
    keep = (off >= least_z)[number]
    number, value, row = number[keep], value[keep], row[keep]
    used, number = np.unique(number, return_inverse=True)
    above = np.concatenate([[1], np.cumsum(np.bincount(y, minlength=grades)[::-1])[::-1][1:] / len(y), [0]])
    start = -np.log(np.clip(above[1:-1], 1e-3, 1 - 1e-3) / (1 - np.clip(above[1:-1], 1e-3, 1 - 1e-3)))
    w, cuts = np.zeros(len(used)), np.maximum.accumulate(start + 1e-3 * np.arange(grades - 1))
    weight = (len(y) / (grades * np.maximum(1, np.bincount(y, minlength=grades))))[y] ** 0.5  # rare grades count somewhat more
    state = [np.zeros(len(w) + grades - 1) for _ in range(2)]
    for t in range(1, rounds + 1):
        score = np.bincount(row, value * w[number], minlength=len(y))
        tail = np.column_stack([np.ones(len(y)), 1 / (1 + np.exp(-np.clip(score[:, None] - cuts, -40, 40))), np.zeros(len(y))])
        at = np.arange(len(y))
        p = np.maximum(tail[at, y] - tail[at, y + 1], 1e-9)
        slope = tail * (1 - tail)
        up, down = slope[at, y] / p * weight, slope[at, y + 1] / p * weight
        push = up - down  # of the log-likelihood by the score
        grad_w = -np.bincount(number, value * push[row], minlength=len(w)) / len(y) + decay * w
        grad_c = np.array([(np.where(y == k + 1, up, 0) - np.where(y == k, down, 0)).sum() for k in range(grades - 1)]) / len(y)
        g = np.concatenate([grad_w, grad_c])
        state[0] = 0.9 * state[0] + 0.1 * g
        state[1] = 0.999 * state[1] + 0.001 * g * g
        step = rate * (state[0] / (1 - 0.9**t)) / (np.sqrt(state[1] / (1 - 0.999**t)) + 1e-8)
        w, cuts = w - step[: len(w)], np.maximum.accumulate(cuts - step[len(w) :])
    weights = np.zeros(1 << BITS)
    weights[used] = w
    return Model(weights, cuts)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of the labelled documents. Of the rows of the sample's ids, equal ones once, at most sample of least hash reach
    the driver; the sample's ids and these hashes are broadcast. Rows without an id do not count."""
    chosen = F.broadcast(graded(labels, sample))
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, "doc_id").withColumn("h", F.xxhash64("doc_id", "grade", "text"))
    least = named.select("h").distinct().orderBy("h").limit(sample)
    some = named.join(F.broadcast(least), "h", "left_semi").dropDuplicates(["h"])
    return fit([tuple(r) for r in rows_of(some.select("grade", "text"), "grade").collect()])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs, and expected_grade and tail_probability (of the best grade), which replace columns of these names.

    Null text counts as empty, and has no features.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast((model.weights.astype(np.float64), model.cuts))

    def run(texts: pa.Array) -> pa.Array:
        own, done = Model(*held.value), [np.zeros((0, 2))]
        for _, some in text_runs(texts):
            row, number, value = features(some)
            tails = own.tails(np.bincount(row, value * own.weights[number], minlength=len(some)))
            done.append(np.column_stack([tails.sum(1), tails[:, -1]]))
        out = np.concatenate(done)
        return pa.StructArray.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], names=SCORES)

    score = F.arrow_udf(run, "expected_grade double, tail_probability double").asNondeterministic()  # else a filter on it runs it twice
    return beside(docs.drop(*SCORES), score=score("text")).select("row.*", "score.*")


def select(docs: DataFrame, labels: DataFrame, tail: float = TAIL, sample: int = SAMPLE) -> DataFrame:
    """The documents whose probability of the best grade is at least tail, with expected_grade and tail_probability.

    Empty and null texts have no features and are judged by the thresholds alone. Rows are independent; an empty table
    gives an empty result. Columns of docs that are called expected_grade or tail_probability are replaced.
    """
    return scored(docs, train(docs, labels, sample)).filter(F.col("tail_probability") >= tail)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the classifier keeps; null and empty texts are judged by the thresholds, long ones as a whole."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return select(docs, table(spark, sf_dir, "labels")).select("doc_id", "expected_grade", "tail_probability", F.lit(True).alias("kept"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps, with all their columns."""
    model = train(docs, table(spark, sf_dir, "labels"))
    return scored(beside(docs, text=F.col("text")), model).filter(F.col("tail_probability") >= TAIL).select("row.*")
