"""Quality classifier: hashed word n-grams, logistic regression, follow-the-regularised-leader."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.llm.common import pick, rest, sliced

#: Hash buckets (a power of two), labelled rows that training reads at most, and passes over them.
BUCKETS, TRAIN_ROWS, EPOCHS = 1 << 18, 6_000, 5
ALPHA, BETA, L1, L2 = 3.0, 1.0, 0.02, 0.01
KEEP = 0.7
_TOKENS = re.compile(r"\w+|[^\w\s]+").findall


class _Hashes(dict):
    """Token to 32-bit hash; the shape of a word (upper, title, lower) is a token of its own kind."""

    def __missing__(self, token: str) -> int:
        if len(self) > 250_000:
            self.clear()
        value = self[token] = zlib.crc32(token.encode("utf-8", "surrogatepass"))
        return value


_hashes = _Hashes()
#: Hash of every pair of equal words, so that stammering in unseen words is seen too.
_TWICE = np.uint64(zlib.crc32(b"twice"))


def features(text: str | None, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of the words and word pairs of a text, and their weights (unit length).

    Weights are log(1 + count), so a long text does not drown in its most frequent words.
    """
    words = np.array([_hashes[t] for t in _TOKENS(text or "")], np.uint64)
    if not len(words):
        return np.empty(0, np.int64), np.empty(0)
    mixed = (words[:-1] * np.uint64(0x9E3779B1) + words[1:] * np.uint64(0x85EBCA77)) >> np.uint64(7)
    mixed[words[:-1] == words[1:]] = _TWICE
    mask = np.uint64(buckets - 1)
    counts = np.bincount(np.concatenate([words & mask, mixed & mask]).astype(np.int64)) if len(words) > 20_000 else None
    if counts is None:
        at, n = np.unique(np.concatenate([words & mask, mixed & mask]).astype(np.int64), return_counts=True)
    else:
        at = np.nonzero(counts)[0]
        n = counts[at]
    weights = np.log1p(n)
    return at, weights / np.sqrt((weights * weights).sum())


def _sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-min(35.0, max(-35.0, x)))))


class Ftrl:
    """Per-coordinate FTRL-proximal for logistic loss; coordinates whose |z| stays under L1 are zero."""

    def __init__(self, buckets: int):
        self.z, self.n = np.zeros(buckets + 1), np.zeros(buckets + 1)  # the last one is the intercept

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        l1 = np.where(at == len(self.z) - 1, 0.0, L1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        at, x = np.append(at, len(self.z) - 1), np.append(x, 1.0)
        w = self.weights(at)
        gradient = (_sigmoid(float(w @ x)) - label) * x
        square = gradient * gradient
        self.z[at] += gradient - (np.sqrt(self.n[at] + square) - np.sqrt(self.n[at])) / ALPHA * w
        self.n[at] += square


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, buckets: int = BUCKETS) -> np.ndarray:
    """Weights (the intercept last) learned from at most ``train_rows`` labelled, not held out rows.

    The rows are those with the smallest hash of the doc_id: a fixed, unbiased sample, joined with the
    texts by a broadcast of at most ``train_rows`` ids. Features are extracted where the texts are;
    the sequential updates then run over the bounded sample in one task, in the order of the hash, and
    one row per used bucket comes to the driver. Without any labelled row all weights are zero.
    """
    marked = pick(labels, "doc_id", "quality").where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = marked.groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    rows = pick(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.xxhash64("doc_id").alias("turn"), "text", "quality")

    def extract(batches):
        for part in sliced(batches, chars="text"):
            found = [features(t.as_py(), buckets) for t in part.column("text")]
            yield pa.RecordBatch.from_arrays(
                [part.column("turn"), pa.array([at for at, _ in found], pa.list_(pa.int32())), pa.array([x for _, x in found], pa.list_(pa.float32())),
                 part.column("quality")], ["turn", "at", "x", "quality"])
        _hashes.clear()

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.assign(size=frame["at"].map(len)).sort_values(["turn", "size"], kind="stable")
        model = Ftrl(buckets)
        for _ in range(EPOCHS):
            for at, x, label in zip(frame["at"], frame["x"], frame["quality"]):
                model.learn(np.asarray(at, np.int64), np.asarray(x, np.float64), label)
        w = model.weights(np.arange(buckets + 1))
        used = np.nonzero(w)[0]
        return pd.DataFrame({"at": used.astype("int64"), "w": w[used]})

    sparse = rows.mapInArrow(extract, "turn long, at array<int>, x array<float>, quality int")
    learned = sparse.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(fit, "at long, w double").toPandas()
    weights = np.zeros(buckets + 1)
    weights[learned["at"].to_numpy()] = learned["w"].to_numpy()
    return weights


def score_quality(docs: DataFrame, labels: DataFrame, keep: float = KEEP, train_rows: int = TRAIN_ROWS,
                  passed: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``passed`` columns of docs with ``held_out, score, predicted``.

    Scores are the sigmoid of the sparse dot product of a text's features with the weights, which
    are broadcast (a fixed 2 MB). Only the text is an input. A null or empty text has the score of
    the intercept alone. Rows are scored one by one: repeated rows repeat, a null doc_id is not held
    out, and an empty table gives no rows. Labels other than 0 and 1 are not learned from; a doc_id
    labelled twice counts once, with its larger label.
    """
    weights = train(docs, labels, train_rows)
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float64))
    names = [f"c{i}" for i in range(len(passed))]
    scored_text = names[passed.index("text")] if "text" in passed else "scored_text"
    rows = pick(docs, *passed, *([] if "text" in passed else ["text"])).toDF(*dict.fromkeys([*names, scored_text]))

    def run(batches):
        w = shared.value
        for part in sliced(batches, chars=scored_text):
            scores = []
            for text in part.column(scored_text):
                at, x = features(text.as_py())
                scores.append(_sigmoid(float(w[at] @ x) + w[-1]))
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(scores, pa.float64())], [*names, "score"])
        _hashes.clear()  # an idle Python worker must not hold it while other stages run
        rest()

    schema = ", ".join(f"{n} {t}" for n, t in rows.select(*names).dtypes) + ", score double"
    scored = rows.mapInArrow(run, schema)
    out = scored.select(*[F.col(n).alias(p) for n, p in zip(names, passed)], "score")
    return out.select("*", held_out(F.col("doc_id")).alias("held_out"), (F.col("score") >= keep).cast("int").alias("predicted"))
