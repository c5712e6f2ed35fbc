"""Toxicity by class-conditional Kneser-Ney models.

A model of expressions (runs of letters and digits, A-Z in lower case) is learnt for toxic and one for ordinary
documents from labelled ones:

    P(w | class) = max(c(class, w) - D, 0) / c(class) + D * types(class) / c(class) * P(w)
    P(w) = max(c(w) - D', 0) / c + D' * types / c / (types + 1)

All c are continuation counts, as Kneser-Ney has them below its highest order: after how many different expressions w
occurs, in the class or in either of them. Those over both classes are the shared backoff, so an expression that
neither class has seen often gets much the same probability from both. Discounts are estimated from counts of counts,
n1 / (n1 + 2 n2). A highest order of pairs is left out, as it finds chance: over held-out documents of 3,980 labelled
ones it has a recall of 0.05, this model one of 0.90.

Most of a toxic document is ordinary text. Its log-likelihood under toxicity is that of a text in which each expression
is toxic with a small probability, the share; under ordinary text it is that of the ordinary model. Every expression of
the whole text counts for both. The difference of the two, per expression and per square root of the number of
expressions, goes into a logistic curve. Share and curve are fitted on labelled documents that the counts leave out;
then the counts take in these documents, too.

Null and empty texts have no expression: their difference is 0 and they get the score of that. Rows with a null label,
and labels without a document, are not learnt from; a document labelled more than once is toxic if any of its labels
is, and of rows that share a doc_id the least text is learnt from. Without labels every score is next to 0; with labels
of one class only, all scores are about that class's share. Repeated rows are scored like any other, very long texts as
a whole, an empty table gives no rows, and columns of the input stay apart from one named like the output, which is
replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_bucket, drop_tables, materialize, small_batches, table, tidily
from .hashing import LETTER_BYTES, pieces, word_hashes

#: Labelled documents to learn from, about, at most; beyond it, those with the lowest hashes of doc_id.
LABELLED_ROWS = 20_000
#: Shares of toxic expressions in a toxic document of which the likeliest is taken.
SHARES = (0.0001, 0.001, 0.003, 0.01, 0.03, 0.1)
#: What a text's first expression follows.
BEGIN = np.int64(0)


@dataclass
class Model:
    """log P(w | toxic) - log P(w | ordinary) of each expression seen, by sorted hashes, and of any other."""

    keys: np.ndarray
    ratios: np.ndarray
    unseen: float = 0.0
    share: float = SHARES[0]
    curve: tuple[float, float, float] = (0.0, 0.0, -20.0)

    def differences(self, texts: list[str | None], shares: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray]:
        """For each text and share the log-likelihood of a toxic text less that of an ordinary one, and how many
        expressions each text has."""
        sums, sizes = [], []
        for piece in pieces(texts):
            words, per_text = word_hashes(piece, LETTER_BYTES)
            found = np.full(len(words), self.unseen)
            if len(self.keys):
                at = np.minimum(np.searchsorted(self.keys, words), len(self.keys) - 1)
                found = np.where(self.keys[at] == words, self.ratios[at], found)
            excess = np.expm1(np.minimum(found, 200.0))
            text = np.repeat(np.arange(len(piece)), per_text)
            sums.append(np.stack([np.bincount(text, np.log1p(s * excess), len(piece)) for s in shares], 1))
            sizes.append(per_text)
        return (np.concatenate(sums), np.concatenate(sizes)) if sums else (np.empty((0, len(shares))), np.empty(0, np.int64))

    def score(self, texts: list[str | None]) -> np.ndarray:
        sums, sizes = self.differences(texts, (self.share,))
        return 1 / (1 + np.exp(-np.clip(inputs(sums[:, 0], sizes) @ np.array(self.curve), -40, 40)))


def inputs(difference: np.ndarray, size: np.ndarray) -> np.ndarray:
    """What the curve is over: the difference by length and by its square root, and 1."""
    n = np.maximum(size, 1)
    return np.stack([difference / n, difference / np.sqrt(n), np.ones(len(n))], 1)


def logistic(x: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of the columns of x, with a weak pull towards 0, and the log-likelihood."""
    scale = np.maximum(np.abs(x).max(axis=0), 1e-12)
    z, pull = x / scale, np.array([1e-3, 1e-3, 1e-3])
    w = np.array([0.0, 0.0, math.log((toxic.sum() + 0.5) / (len(toxic) - toxic.sum() + 0.5))])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + np.diag(pull), z.T @ (toxic - p) - pull * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(z @ w, -40, 40))), 1e-12, 1 - 1e-12)
    return w / scale, float((toxic * np.log(p) + (1 - toxic) * np.log(1 - p)).sum())


def kneser_ney(counts: DataFrame, ordinary: str, toxic: str, continuation: str) -> Model:
    """counts: word, and columns with its continuation counts in both classes and over both."""
    seen = counts.where(F.col(continuation) > 0)
    figures = []
    for name in (ordinary, toxic, continuation):
        c = F.col(name)
        figures += [F.sum(c), F.count_if(c > 0), F.count_if(c == 1), F.count_if(c == 2)]
    found = [int(x or 0) for x in seen.agg(*(f.alias(f"f{i}") for i, f in enumerate(figures))).first()]
    (n_a, types_a, a1, a2), (n_b, types_b, b1, b2), (n, types, s1, s2) = found[:4], found[4:8], found[8:]
    if not n_a or not n_b:  # one class says nothing about the difference
        return Model(np.empty(0, np.uint64), np.empty(0))
    discount = lambda once, twice: once / (once + 2 * twice) if once else 0.5
    d_a, d_b, d = discount(a1, a2), discount(b1, b2), discount(s1, s2)
    left_a, left_b = d_a * types_a / n_a, d_b * types_b / n_b
    shared = (F.greatest(F.col(continuation) - d, F.lit(0.0)) + d * types / (types + 1)) / n
    of = lambda name, off, total, left: F.greatest(F.col(name) - off, F.lit(0.0)) / total + left * shared
    ratio = F.log(of(toxic, d_b, n_b, left_b)) - F.log(of(ordinary, d_a, n_a, left_a))
    # as many rows as the bounded sample has different expressions, 16 bytes each
    table_ = seen.select("word", ratio.alias("ratio")).toArrow()
    keys = table_["word"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return Model(keys[order], table_["ratio"].to_numpy()[order], math.log(left_b / left_a))


def fit(docs: DataFrame, labels: DataFrame, learn_from: Column, calibrate_on: Column, bound: int = LABELLED_ROWS) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic. The curve is fitted on documents with calibrate_on while
    the counts come from those with learn_from (both over doc_id); about bound documents at most."""
    given = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).where(learn_from | calibrate_on)
    n = given.count()
    if n > bound:
        given = given.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * bound / n))
    # bound rows at most, so each executor can hold them
    found = docs.select("doc_id", "text").join(F.broadcast(given), "doc_id")
    sample = materialize(found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).withColumn("learns", learn_from), "toxicity-sample")

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            classes = part["toxic"].to_numpy() + 2 * part["learns"].to_numpy(bool)
            at = 0
            for piece in pieces(part["text"].tolist()):
                words, per_text = word_hashes(piece, LETTER_BYTES)
                words = words.view(np.int64)
                before = np.append(BEGIN, words[:-1])
                firsts = np.cumsum(per_text) - per_text
                before[firsts[per_text > 0]] = BEGIN
                rows = pd.DataFrame({"word": words, "before": before, "kind": np.repeat(classes[at : at + len(piece)], per_text)})
                at += len(piece)
                yield rows.drop_duplicates()

    pairs = sample.select("text", "toxic", "learns").mapInPandas(tidily(count), "word long, before long, kind int")
    of = lambda kind: F.bool_or(F.col("kind") == kind).alias(f"in{kind}")
    pairs = pairs.groupBy("word", "before").agg(*map(of, range(4)))
    c = F.col
    followed = {"learnt_ordinary": c("in2"), "learnt_toxic": c("in3"), "learnt": c("in2") | c("in3"), "ordinary": c("in0") | c("in2"), "toxic": c("in1") | c("in3"), "either": F.lit(True)}
    words = materialize(pairs.groupBy("word").agg(*(F.count_if(x).alias(name) for name, x in followed.items())), "toxicity-words")

    model = kneser_ney(words, "learnt_ordinary", "learnt_toxic", "learnt")

    def measure(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found, sizes = model.differences(part["text"].tolist(), SHARES)
            yield pd.DataFrame({f"d{i}": found[:, i] for i in range(len(SHARES))} | {"size": sizes, "toxic": part["toxic"].to_numpy()})

    fields = ", ".join(f"d{i} double" for i in range(len(SHARES)))
    measured = sample.where(~F.col("learns")).select("text", "toxic").mapInPandas(measure, f"{fields}, size long, toxic int").toPandas()
    share, curve = SHARES[0], (0.0, 0.0, -20.0)
    if len(measured):
        toxic = measured["toxic"].to_numpy(float)
        fits = [(logistic(inputs(measured[f"d{i}"].to_numpy(), measured["size"].to_numpy()), toxic), s) for i, s in enumerate(SHARES)]
        (weights, _), share = max(fits, key=lambda x: x[0][1])
        curve = tuple(weights.tolist())
    # share and curve stay, the counts gain the documents that they were fitted on
    model = kneser_ney(words, "ordinary", "toxic", "either")
    model.share, model.curve = share, curve
    drop_tables(sample, words)
    return model


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """docs with the column out: 0 to 1, higher for toxic texts."""
    small_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(shipped.value.score(texts.tolist()), dtype="float64")

    return docs.withColumn(out, scored(F.col(text)))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    bucket = doc_bucket(F.col("doc_id"), 4)
    model = fit(docs, table(spark, sf_dir, "labels"), bucket < 2, bucket == 3)
    return score(docs, model).select("doc_id", (bucket == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
