"""Quality classifier: regularised quadratic discriminant analysis over document statistics.

Each text gives a vector of transformed statistics; labels, language, source and id are no part of it.
For each class the counts, sums and sums of products of all labelled training rows are added up in one
aggregate, which gives mean and covariance; the covariance is shrunk towards the pooled one and its
diagonal.  The Cholesky factor of each is inverted once and kept, and a text's score is the logistic
function of the difference of the log densities plus that of the log priors.

Null and empty texts have the statistics of no words and are scored by them.  Labels other than 0 and
1, null ids and labels without a document are left out; repeated labels count as often as they occur.
A class without rows takes the pooled moments, so that the priors decide; without any labels every
score is 0.5.  An empty table gives an empty one.  Other columns of any name are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opalstream.llm.common import Tables
from opalstream.llm.quality_rules import text_stats

FEATURES = ("word_length", "symbols", "capitals", "marks", "repeats", "same_lines", "words", "distinct", "doubled", "digits", "line")


def text_features(text: str | None) -> list[float]:
    text = text or ""
    n, chars, _, _, _, x = text_stats(text)
    words = text.encode("utf-8", "surrogatepass").split()
    doubled = sum(a == b for a, b in zip(words, words[1:]))
    digits = sum(map(text.count, "0123456789"))
    return [
        x[0], x[1], x[2], math.sqrt(x[3]), math.sqrt(x[4]), math.sqrt(x[5]), math.log1p(n),
        len(set(words)) / max(n, 1) * math.log1p(n), math.sqrt(doubled / max(n, 1)), math.sqrt(digits / max(chars, 1)), math.log1p(n / (1 + text.count("\n"))),
    ]


def features(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def stats(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([text_features(t) for t in s], dtype=object)

    return stats(text)


@dataclass(frozen=True)
class Gaussian:
    log_prior: float
    mean: np.ndarray
    inverse: np.ndarray  # of the Cholesky factor
    log_det: float

    def log_density(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) @ self.inverse.T
        return self.log_prior - 0.5 * (self.log_det + np.square(z).sum(axis=1))


@dataclass(frozen=True)
class Model:
    classes: tuple[Gaussian, ...]  # of labels 0 and 1; none without labels

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.classes:
            return np.full(len(x), 0.5)
        d = self.classes[0].log_density(x) - self.classes[1].log_density(x)
        return 1 / (1 + np.exp(np.clip(d, -500, 500)))


def discriminant(sums: dict[int, tuple[int, np.ndarray, np.ndarray]], d: int, to_pooled: float = 0.1, to_diagonal: float = 0.1, ridge: float = 1e-4) -> Model:
    """sums by class: rows, sums, sums of products."""
    total = sum(n for n, _, _ in sums.values())
    if not total:
        return Model(())
    cov = {k: q / n - np.outer(s / n, s / n) for k, (n, s, q) in sums.items() if n}
    pooled = sum(sums[k][0] * c for k, c in cov.items()) / total
    middle = sum(s for _, s, _ in sums.values()) / total
    out = []
    for k in (0, 1):
        n, s, _ = sums.get(k, (0, None, None))
        c, mean = (cov[k], s / n) if n else (pooled, middle)
        weight = to_pooled + (1 - to_pooled) * d / (d + n)  # small classes lean on the pooled covariance more
        c = (1 - weight) * c + weight * pooled
        c = (1 - to_diagonal) * c + to_diagonal * np.diag(np.diag(c)) + ridge * np.eye(d)
        factor = np.linalg.cholesky(c)
        out.append(Gaussian(math.log((n + 1) / (total + 2)), mean, np.linalg.inv(factor), 2 * float(np.log(np.diag(factor)).sum())))
    return Model(tuple(out))


def fit(rows: DataFrame, d: int) -> Model:
    """rows (label, x): one aggregate, two rows to the driver."""
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    x = F.col("x")
    got = rows.groupBy("label").agg(F.count("*").alias("n"), F.array(*[F.sum(x[i]) for i in range(d)]).alias("s"), F.array(*[F.sum(x[i] * x[j]) for i, j in pairs]).alias("q")).collect()
    sums = {}
    for r in got:
        q = np.zeros((d, d))
        q[np.triu_indices(d)] = r["q"]
        sums[r["label"]] = (r["n"], np.array(r["s"]), np.triu(q) + np.triu(q, 1).T)
    return discriminant(sums, d)


def score(x: Column, model: Model) -> Column:
    @F.pandas_udf("double")
    def scores(s: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(s.to_list())) if len(s) else [], dtype="float64")

    return scores(x)


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns of op7; learns from labels of documents that aren't held out."""
    tables = Tables(docs.sparkSession, "classifier")
    rows = tables.write(docs.select(F.col("doc_id").cast("long").alias("doc_id"), features(F.col("text")).alias("x")), "features")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).filter("label in (0, 1)")
    model = fit(rows.filter(~held_out(F.col("doc_id"), 3, 1)).join(known, "doc_id").select("label", "x"), len(FEATURES))
    out = rows.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), score(F.col("x"), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
