"""Quality rules: document statistics, fixed base rules and robust multivariate outliers.

Each text gives counts and a vector of transformed statistics.  For every (language, source)
group the minimum-covariance-determinant estimate of the vectors' location and scatter is found by
concentration steps: keep the share SUPPORT of the rows with the smallest Mahalanobis distances, estimate
anew, repeat.  Three deterministic starts (median absolute deviations alone, with the correlations of
tanh scores, with those of spatial signs) take two steps each; the one of smallest determinant goes on until
its determinant falls no further, and the smallest met is kept; `settled` is false where it still fell after
MOST_STEPS steps.  A group's location and scatter are then drawn towards those of its language, as of
PRIOR_ROWS rows more, and a language's towards those of all, which in turn has so many rows of a wide fixed
scatter; these are of all rows that the groups' estimates rest on.  So a group of a few rows is judged by
its language mostly, a large one by itself, and nothing changes at any size at once; `own_weight` is the
group's own share.  A row is rejected if its squared distance exceeds the cutoff.

All rows count in every step; a step moves one row of sums per group and task, so a group that
holds a third of all rows costs no more than others.  Estimates are joined by key, broadcast only
if there are at most BROADCAST_GROUPS of them.

Null or empty texts count as no words and fail the base rule.  Null languages and sources are
values of their own.  Repeated rows are judged alike.  An empty table gives an empty one.  Other
columns of any name are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opalstream.llm.common import Tables

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\r\x0b\f"
FEATURES = ("word_length", "symbols", "capitals", "marks", "repeats", "same_lines")
#: Least standard deviation of each feature, so that one which is constant in most rows stays regular.
LEAST_SD = (0.06, 0.03, 0.06, 0.025, 0.06, 0.12)
SUPPORT, PRIOR_ROWS, BROADCAST_GROUPS = 0.75, 40, 20_000
#: The fixed scatter's standard deviations, in least ones.
WIDE = 4.0
STARTS, FIRST_STEPS, MOST_STEPS = 3, 2, 40
#: A log determinant that falls by less than this has settled: quantiles are found to a thousandth.
SETTLED = 1e-3
#: Share of clean rows beyond the cutoff if they were normal; far out, as real ones have longer tails.
TAIL = 1e-9
STATS = "n_words:long,word_chars:long,n_symbols:long,n_dup_lines:long,n_repeat_words:long,x:array<double>"


def chi2_quantile(p: float, d: int) -> float:
    """Wilson and Hilferty's approximation."""
    from statistics import NormalDist

    return d * (1 - 2 / (9 * d) + NormalDist().inv_cdf(p) * math.sqrt(2 / (9 * d))) ** 3


def repeated_words(words: list[bytes], k: int = 5) -> int:
    """Words in k-word windows that occur twice or more, the first included."""
    m = len(words) - k + 1
    if m < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    w = np.zeros(m, np.uint64)
    for i in range(k):
        w = (w ^ h[i : i + m]) * np.uint64(0x9E3779B97F4A7C15)
        w ^= w >> np.uint64(31)
    order = np.argsort(w, kind="stable")
    same = w[order[1:]] == w[order[:-1]]
    if not same.any():
        return 0
    hit = np.zeros(m, bool)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    cover = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(hit)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + k, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def text_stats(text: str | None) -> tuple:
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    seen, dup, lines = set(), 0, 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            lines += 1
            dup += line in seen
            seen.add(line)
    repeats = repeated_words(words)
    upper = sum(map(str.isupper, text)) if not text.islower() else 0
    letters = sum(map(str.isalpha, text))
    x = [
        math.log1p(chars / max(n, 1)),
        math.sqrt(symbols / max(chars, 1)),
        math.sqrt(upper / max(letters, 1)),
        max(chars - letters - symbols, 0) / max(chars, 1),
        repeats / max(n, 1),
        dup / max(lines, 1),
    ]
    return n, chars, symbols, dup, repeats, x


def statistics(text: Column) -> Column:
    @F.pandas_udf(STATS.replace(":", " "))
    def stats(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame([text_stats(t) for t in s], columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "x"])

    return stats.asNondeterministic()(text)  # else the optimizer copies it to each place where its result is used


def group_key(lang: Column, source: Column) -> Column:
    part = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-"))
    return F.concat_ws("\x01", part(lang), part(source))


def base_failed(s: str) -> Column:
    return (F.col(f"{s}.n_words") < 10) | (100 * F.col(f"{s}.n_repeat_words") > 20 * F.col(f"{s}.n_words"))


def _distance(d: int) -> Column:
    """Squared Mahalanobis distance of x from mean under precision, all arrays."""
    diff = [F.col("x")[i] - F.col("mean")[i] for i in range(d)]
    total = F.lit(0.0)
    for i in range(d):
        for j in range(i, d):
            total = total + diff[i] * diff[j] * F.col("precision")[i * d + j] * (1.0 if i == j else 2.0)
    return total


def _matrix(upper: np.ndarray, d: int) -> np.ndarray:
    out = np.zeros((d, d))
    out[np.triu_indices(d)] = upper
    return np.triu(out) + np.triu(out, 1).T


def regular(sd: np.ndarray, cor: np.ndarray, least_sd: np.ndarray) -> tuple[list[float], float]:
    """Precision (row by row) and log determinant of a scatter, kept away from singular."""
    wide = np.maximum(sd, least_sd)
    cov = (cor * 0.95 + 0.05 * np.eye(len(sd))) * np.outer(wide, wide)
    return np.linalg.inv(cov).ravel().tolist(), float(np.linalg.slogdet(cov)[1])


ESTIMATE = "k string, start int, n long, mean array<double>, precision array<double>, logdet double, s array<double>"


def _first(least_sd: tuple[float, ...]):
    """Medians, deviations and sums of products of scores to the starts."""
    d = len(least_sd)

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                sd, (tanh, sign) = np.array(r.sd, float), (_matrix(np.array(x, float), d) for x in (r.tanh, r.sign))
                for i, c in enumerate((np.eye(d), tanh, sign)):
                    own = np.sqrt(np.maximum(np.diag(c), 1e-300))
                    rows.append((r.k, i, int(r.n), list(r.mean), regular(sd, c / np.outer(own, own), np.array(least_sd))[0], math.inf, None))
            yield pd.DataFrame(rows, columns=["k", "start", "n", "mean", "precision", "logdet", "s"])

    return first


def _solve(least_sd: tuple[float, ...]):
    """Rows of sums to rows of estimates."""
    d = len(least_sd)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                mean, cov = moments(r.n, r.s, d)
                rows.append((r.k, r.start, int(r.n), mean.tolist(), *regular_scatter(cov, np.array(least_sd)), list(r.s)))
            yield pd.DataFrame(rows, columns=["k", "start", "n", "mean", "precision", "logdet", "s"])

    return solve


def moments(n: int, s, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance from the number of rows and the sums of values and products."""
    s = np.array(s, float)
    mean = s[:d] / n
    return mean, _matrix(s[d:] / n, d) - np.outer(mean, mean)


def regular_scatter(cov: np.ndarray, least_sd: np.ndarray) -> tuple[list[float], float]:
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-300))
    return regular(sd, cov / np.outer(sd, sd), least_sd)


def drawn(n: int, own: tuple[np.ndarray, np.ndarray], to: tuple[np.ndarray, np.ndarray], prior: int = PRIOR_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Location and scatter of n rows with those of `prior` more."""
    w = n / (n + prior)
    return w * own[0] + (1 - w) * to[0], w * own[1] + (1 - w) * to[1]


def _draw(least_sd: tuple[float, ...]):
    """Groups' sums with those of their language and of all (ln, ls, an, as) to the estimates that judge."""
    d, least = len(least_sd), np.array(least_sd)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                mean, cov = moments(r.an, r.a, d)
                every = drawn(r.an, (mean, cov), (mean, np.diag((WIDE * least) ** 2)))
                lang = drawn(r.ln, moments(r.ln, r.ls, d), every)
                mean, cov = drawn(r.n, moments(r.n, r.s, d), lang)
                rows.append((r.k, r.l, mean.tolist(), regular_scatter(cov, least)[0], r.n / (r.n + PRIOR_ROWS), bool(r.settled)))
            yield pd.DataFrame(rows, columns=["k", "l", "mean", "precision", "own_weight", "settled"])

    return draw


def _with(rows: DataFrame, table: DataFrame, on: str, how: str, groups: int) -> DataFrame:
    return rows.join(F.broadcast(table) if groups <= BROADCAST_GROUPS else table, on, how)


def _quantile(c: Column, p: float) -> Column:
    return F.percentile_approx(c, F.lit(p), F.lit(1000))


def _starts(of: DataFrame, tables: Tables, groups: int, least_sd: tuple[float, ...]) -> DataFrame:
    d = len(least_sd)
    mid = tables.write(of.groupBy("k").agg(F.count("*").alias("n"), F.array(*[_quantile(F.col("x")[i], 0.5) for i in range(d)]).alias("mean")), "medians")
    with_mid = _with(of, mid, "k", "inner", groups)
    mad = [F.greatest(F.lit(least_sd[i]), 1.4826 * _quantile(F.abs(F.col("x")[i] - F.col("mean")[i]), 0.5)) for i in range(d)]
    spread = tables.write(with_mid.groupBy("k").agg(F.first("n").alias("n"), F.first("mean").alias("mean"), F.array(*mad).alias("sd")), "deviations")
    z = [(F.col("x")[i] - F.col("mean")[i]) / F.col("sd")[i] for i in range(d)]
    size = F.greatest(F.lit(1e-9), F.sqrt(sum((v * v for v in z), F.lit(0.0))))
    scored = _with(of, spread, "k", "inner", groups).select("k", "n", "mean", "sd", F.array(*[F.tanh(v) for v in z]).alias("t"), F.array(*[v / size for v in z]).alias("u"))
    products = lambda c: F.array(*[F.sum(F.col(c)[i] * F.col(c)[j]) for i in range(d) for j in range(i, d)])
    sums = scored.groupBy("k").agg(F.first("n").alias("n"), F.first("mean").alias("mean"), F.first("sd").alias("sd"), products("t").alias("tanh"), products("u").alias("sign"))
    est = tables.write(sums.mapInPandas(_first(least_sd), ESTIMATE), "start")
    tables.drop(mid, spread)
    return est


def concentrate(of: DataFrame, est: DataFrame, tables: Tables, groups: int, least_sd: tuple[float, ...], name: str) -> DataFrame:
    """One step of each estimate: from its nearest rows."""
    d, by = len(least_sd), ["k", "start"]
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    near = _with(of, est.select(*by, "mean", "precision"), "k", "inner", groups).select(*by, "x", _distance(d).alias("dist"))
    cut = tables.write(near.groupBy(*by).agg(_quantile(F.col("dist"), SUPPORT).alias("cut")), f"cut{name}")
    sums = _with(near, cut, by, "inner", groups).filter(F.col("dist") <= F.col("cut")).groupBy(*by)
    sums = sums.agg(F.count("*").alias("n"), F.array(*[F.sum(F.col("x")[i]) for i in range(d)], *[F.sum(F.col("x")[i] * F.col("x")[j]) for i, j in pairs]).alias("s"))
    out = tables.write(sums.mapInPandas(_solve(least_sd), ESTIMATE), f"step{name}")
    tables.drop(cut)
    return out


def fit(rows: DataFrame, tables: Tables, least_sd=LEAST_SD) -> tuple[DataFrame, int]:
    """rows (g, l, x) to estimates (k, mean, precision, own_weight, settled, scale), one for each g, and their number."""
    of = tables.write(rows.select(F.col("g").alias("k"), "l", "x"), "vectors")
    langs = tables.write(of.groupBy("k").agg(F.first("l").alias("l")), "langs")
    groups = langs.count()
    of, vectors = of.select("k", "x"), of
    est = _starts(of, tables, groups, least_sd)
    for i in range(FIRST_STEPS):
        est, old = concentrate(of, est, tables, groups, least_sd, f"first{i}"), est
        tables.drop(old)
    order = F.struct("logdet", "start")
    lowest = tables.write(est.groupBy("k").agg(F.min_by(F.struct(*est.columns), order).alias("e")).select("e.*"), "lowest")
    tables.drop(est)
    done, open_ = [], lowest  # estimates that have settled, and those that may still fall
    for i in range(MOST_STEPS):
        new = concentrate(_with(of, open_.select("k"), "k", "left_semi", groups), open_, tables, groups, least_sd, str(i))
        both = _with(open_, new.select("k", F.struct(*new.columns).alias("new")), "k", "inner", groups)
        falls = F.col("new.logdet") < F.col("logdet") - SETTLED
        done.append(both.filter(~falls).select(*open_.columns))
        open_ = both.filter(falls).select("new.*")
        if open_.isEmpty():
            break
        open_ = tables.write(open_, f"open{i}")
    own = done[0]
    for x in done[1:]:
        own = own.unionByName(x)
    own = own.withColumn("settled", F.lit(True)).unionByName(open_.withColumn("settled", F.lit(False)))
    own = tables.write(_with(own.select("k", "n", "s", "settled"), langs, "k", "inner", groups), "own")
    d = len(least_sd)
    total = lambda c, n: F.array(*[F.sum(F.col(c)[i]) for i in range(n)])
    size = d + d * (d + 1) // 2
    lang = own.groupBy("l").agg(F.sum("n").alias("ln"), total("s", size).alias("ls"))
    every = own.agg(F.sum("n").alias("an"), total("s", size).alias("a"))  # one row
    drawn_ = _with(own, lang, "l", "inner", groups).crossJoin(F.broadcast(every)).mapInPandas(_draw(least_sd), "k string, l string, mean array<double>, precision array<double>, own_weight double, settled boolean")
    est = tables.write(drawn_, "drawn")
    # the scale that makes the median distance that of a chi-squared one, never below 1, drawn together in the same way
    near = tables.write(_with(of, est, "k", "inner", groups).select("k", "l", _distance(d).alias("dist")), "distances")
    middle = F.greatest(F.lit(1.0), _quantile(F.col("dist"), 0.5) / chi2_quantile(0.5, d))
    mine = near.groupBy("k").agg(F.first("l").alias("l"), middle.alias("m"), F.count("*").alias("n"))
    theirs, all_ = near.groupBy("l").agg(middle.alias("lm"), F.count("*").alias("ln")), near.agg(middle.alias("am"))
    w = lambda n: F.col(n) / (F.col(n) + PRIOR_ROWS)
    scales = _with(mine, theirs, "l", "inner", groups).crossJoin(F.broadcast(all_))  # one row
    scales = scales.select("k", (w("n") * F.col("m") + (1 - w("n")) * (w("ln") * F.col("lm") + (1 - w("ln")) * F.col("am"))).alias("scale"))
    out = tables.write(_with(est.drop("l"), scales, "k", "inner", groups), "estimates")
    tables.drop(vectors, langs, own, est, near)
    return out, groups


def judge(rows: DataFrame, est: DataFrame, groups: int, tail: float = TAIL) -> DataFrame:
    """rows (g, x, ...) with own_weight, settled, distance2 and outlier."""
    d = len(FEATURES)
    rows = _with(rows.withColumn("k", F.col("g")), est, "k", "left", groups)
    rows = rows.withColumn("distance2", _distance(d) / F.col("scale"))
    return rows.withColumn("outlier", F.coalesce(F.col("distance2") > chi2_quantile(1 - tail, d), F.lit(False)))


def _vectors(docs: DataFrame) -> DataFrame:
    key = group_key(F.col("lang"), F.col("source"))
    return docs.select("doc_id", key.alias("g"), F.substring_index(key, "\x01", 1).alias("l"), statistics(F.col("text")).alias("s"))


def quality_rules(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, the base counts, base_failed, kept, distance2, own_weight, settled."""
    tables = Tables(docs.sparkSession, "quality")
    rows = tables.write(_vectors(docs).select("doc_id", "g", "l", "s.*"), "stats")
    est, groups = fit(rows, tables)
    bad = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = judge(rows, est, groups).withColumn("base_failed", bad)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~F.col("outlier")).alias("kept"), "distance2", "own_weight", "settled")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns as they are, that pass the base rules and are no outliers."""
    tables = Tables(docs.sparkSession, "quality")
    rows = tables.write(_vectors(docs).select("g", "l", "s.x"), "stats")
    est, groups = fit(rows, tables)
    whole = docs.select(F.struct("*").alias("doc")).select(
        "doc", group_key(F.col("doc.lang"), F.col("doc.source")).alias("g"), statistics(F.col("doc.text")).alias("s")
    ).select("doc", "g", "s", "s.x")
    return judge(whole, est, groups).filter(~F.col("outlier") & ~base_failed("s")).select("doc.*")
