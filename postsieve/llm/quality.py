"""Quality rules: robust multivariate outliers by minimum covariance determinant (MCD).

Each text gets exact counts and, from them, a short vector of transformed statistics. For each language and source
the MCD location and scatter are estimated over all its texts. There are three starts: medians with quartile ranges, medians with the
covariance of spatial signs, and mean with covariance. From each, concentration steps
keep the most central three quarters and estimate again from exact sums over them, until the determinant falls no more; the start that ends with the
smallest determinant gives the estimate. A text is rejected when its squared Mahalanobis distance exceeds a cut-off.

Most texts have no symbols, repeated lines or repeated windows at all, so these statistics are constant over the core of a group and its scatter is singular. But a count says no more
than its resolution: what a single occurrence would change. The mean square of that over a group is added to the scatter's diagonal, in all steps: the estimate is the
minimum determinant of the regularised scatter. A long text, of which counts tell more, is judged by its own resolution where that is finer than the group's.

The vectors are whole numbers (1/1024 units), so all sums are exact and do not depend on the order of the rows. A step is one
aggregate over groups and distance bins, so no group is ever gathered in a task. Texts with equal vectors count once in the
estimates, so a group of copies cannot pull them to itself.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import exp, lgamma, log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window
from pyspark.sql.functions import pandas_udf

from .common import bounded_batches, hinted, packed, saved, unpacked

#: Symbols of the base rules, and the least words of a text.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: Transformed statistics, in this order.
FEATURES = ("word_length", "symbols", "dup_lines", "repeats", "capitals")
SCALE = 1024
#: Share of a group that the estimate rests on, the most concentration steps, what counts as a fall of the logarithm of a determinant, and the
#: fewest distinct vectors that make an estimate.
CORE, STEPS, LEAST_FALL, MIN_GROUP = 0.75, 25, 1e-3, 50
#: Squared distance that a text may have: the chi-squared quantile of 5 degrees of freedom with a tail of about 1e-8.
CUTOFF = 46.0
#: Words that a window found twice takes, and the difference of logarithms of determinants up to which the earlier start counts.
WINDOW_WORDS, TIE = 6, 1e-6
#: Groups (a language and a source) whose estimates may be broadcast: some 300 bytes each.
BROADCAST_GROUPS = 50_000

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_STATS = T.StructType([*(T.StructField(c, T.LongType()) for c in _COUNTS), T.StructField("x", T.ArrayType(T.LongType())), T.StructField("r", T.ArrayType(T.LongType()))])
_BLANK = " \t\n\r\x0b\x0c"
D = len(FEATURES)


def text_stats(text: str | None) -> tuple:
    """The fields of _STATS for one text: counts, transformed statistics and their resolutions (what one occurrence in a text of this size comes to). Null is an empty text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at ASCII white space only
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in _BLANK)
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    windows = list(zip(words, words[1:], words[2:]))  # noqa: B905
    repeats = 0
    if len(set(windows)) < len(windows):
        often, last = Counter(windows), -1
        for i, w in enumerate(windows):
            if often[w] > 1:
                repeats += i + 2 - max(last, i - 1)
                last = i + 2
    b = np.frombuffer(raw, np.uint8)
    capitals = int(((b >= 65) & (b <= 90)).sum())
    x = (chars / max(n, 1), 1000 * symbols / max(chars, 1), 100 * dup / max(len(lines), 1), 100 * repeats / max(n, 1), 100 * capitals / max(chars, 1))
    least = (1000 / max(chars, 1), 100 / max(len(lines), 1), 100 * WINDOW_WORDS / max(n, 1), 100 / max(chars, 1))
    r = (log(1 + (chars + 1) / max(n, 1)) - log(1 + chars / max(n, 1)), *(log(1 + v) for v in least))
    return n, chars, symbols, dup, repeats, [round(SCALE * log(1 + v)) for v in x], [max(1, round(SCALE * v)) for v in r]


@pandas_udf(_STATS)
def _stats(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([text_stats(t) for t in text], columns=_STATS.names)


#: Marked so that Spark works it out once for each row, and not again for a filter on what it gives.
stats = _stats.asNondeterministic()


def base_failed(s: Column) -> Column:
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def _cdf(x: float, d: int) -> float:
    """Chi-squared distribution function, by its series."""
    a, term, total, n = d / 2, 1.0, 1.0, 0
    while term > 1e-15 * total:
        n += 1
        term *= (x / 2) / (a + n)
        total += term
    return total * exp(a * log(x / 2) - x / 2 - lgamma(a + 1))


def consistency(core: float = CORE, d: int = D) -> float:
    """What makes the scatter of the central share of a normal distribution that of all of it."""
    lo, hi = 1e-6, 200.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _cdf(mid, d) < core else (lo, mid)
    return core / _cdf(lo, d + 2)


def group_key(language: Column, source: Column | None) -> Column:
    """A language and a source; null is a value of its own. Without a source, the pool of small groups of a language."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("~"))
    return F.concat(part(language), F.lit("\x1f"), part(source) if source is not None else F.lit("*"))


_PARAMS = "grp string, start int, center array<double>, inverse array<double>, log_det double, noise array<double>"
_UPPER = np.triu_indices(D)
#: Fraction bits of the products of spatial signs, which are summed as whole numbers.
_SIGN = 1 << 20


def _square(upper: list) -> np.ndarray:
    out = np.zeros((D, D))
    out[_UPPER] = np.array(upper, float)
    return out + np.triu(out, 1).T


def _params(rows: Iterator[tuple[str, int, np.ndarray, np.ndarray, np.ndarray]]) -> pd.DataFrame:
    """Centres (in transformed units) and inverse scatters, with the squared resolutions (noise) added."""
    out = []
    for grp, start, center, scatter, noise in rows:
        scatter = scatter + np.diag(noise)
        out.append((grp, start, center.tolist(), np.linalg.inv(scatter).ravel().tolist(), float(np.linalg.slogdet(scatter)[1]), noise.tolist()))
    return pd.DataFrame(out, columns=["grp", "start", "center", "inverse", "log_det", "noise"])


def _start(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Start 0: medians and quartile ranges."""
    for part in parts:
        spread = [(np.array(h) - np.array(lo)) / SCALE / 1.349 for lo, h in zip(part["low"], part["high"], strict=True)]
        noise = [np.array(q, float) / n / SCALE**2 for q, n in zip(part["squares"], part["n"], strict=True)]
        yield _params((g, 0, np.array(m, float) / SCALE, np.diag(s**2), q) for g, m, s, q in zip(part["grp"], part["middle"], spread, noise, strict=True))


def _more_starts(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Start 1: medians, and spatial signs of what is standardised by start 0. Start 2: mean and covariance."""
    for part in parts:
        rows = []
        for g, n, center, inverse, noise, s, p, signs in zip(*(part[c] for c in ("grp", "n", "center", "inverse", "noise", "sums", "products", "signs")), strict=True):
            spread = np.array(inverse).reshape(D, D).diagonal() ** -0.5
            rows.append((g, 1, np.array(center), np.outer(spread, spread) * _square(signs) * D / n / _SIGN, np.array(noise)))
            mean = np.array(s, float) / n
            rows.append((g, 2, mean / SCALE, (_square(p) / n - np.outer(mean, mean)) / SCALE**2, np.array(noise)))
        yield _params(rows)


def _estimate(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    factor = consistency()
    for part in parts:
        rows = []
        for g, start, n, noise, s, p in zip(*(part[c] for c in ("grp", "start", "n", "noise", "sums", "products")), strict=True):
            mean = np.array(s, float) / n
            rows.append((g, start, mean / SCALE, factor * (_square(p) / n - np.outer(mean, mean)) / SCALE**2, np.array(noise)))
        yield _params(rows)


@pandas_udf(T.DoubleType())
def own_distance(x: pd.Series, r: pd.Series, center: pd.Series, inverse: pd.Series, noise: pd.Series) -> pd.Series:
    """Squared distances of texts, each by its own resolution where it is finer than its group's. Null without an estimate."""
    out = pd.Series(np.nan, index=x.index, dtype=float)
    there = center.notna().to_numpy()
    if there.any():
        of = lambda c: np.stack(c[there].to_numpy()).astype(float)
        off, coarse = of(x) / SCALE - of(center), of(noise)
        fine = np.minimum((of(r) / SCALE) ** 2, coarse)
        scatter = np.linalg.inv(of(inverse).reshape(-1, D, D)) - np.einsum("ij,jk->ijk", coarse - fine, np.eye(D))
        out[there] = (off * np.linalg.solve(scatter, off[:, :, None])[:, :, 0]).sum(axis=1)
    return out


def squared_distance(x: Column, center: Column, inverse: Column) -> Column:
    off = [x[j] / SCALE - center[j] for j in range(D)]
    return sum((off[j] * off[k] * inverse[j * D + k] for j in range(D) for k in range(D)), F.lit(0.0))


def fit(vectors: DataFrame) -> tuple[DataFrame, int]:
    """MCD estimates (grp, center, inverse, noise) and their number, from ``vectors`` (language, source, x, r), one row for each text.

    Groups with fewer than MIN_GROUP distinct vectors are pooled within their language, and those pools, if
    still too small, over all languages. What is then too small has no estimate. No rows give no estimates.
    """
    distinct = saved(vectors.groupBy("language", "source", "x").agg(F.min("r").alias("r")), "quality-vectors")
    own = distinct.withColumn("grp", group_key(F.col("language"), F.col("source")))
    counts = saved(own.groupBy("grp", "language").agg(F.count("*").alias("n")), "quality-groups")
    pool = F.sum(F.when(F.col("n") < MIN_GROUP, F.col("n"))).over(Window.partitionBy("language"))
    place = F.when(F.col("n") >= MIN_GROUP, F.col("grp")).when(pool >= MIN_GROUP, group_key(F.col("language"), None)).otherwise(F.lit("*"))
    target = counts.select("grp", place.alias("to"))
    n_groups = counts.count()
    rows = saved(own.join(hinted(target, n_groups, BROADCAST_GROUPS), "grp").select(F.col("to").alias("grp"), "x", "r"), "quality-rows")
    enough = rows.groupBy("grp").agg(F.count("*").alias("total")).where(F.col("total") >= MIN_GROUP)

    x = F.col("x")
    at = lambda q: F.array(*[F.percentile(x[j], q) for j in range(D)])  # noqa: E731  exact: a value is one of a few thousand whole numbers
    squares = F.array(*[F.sum(F.col("r")[j] * F.col("r")[j]) for j in range(D)])
    first = rows.groupBy("grp").agg(at(0.25).alias("low"), at(0.5).alias("middle"), at(0.75).alias("high"), F.count("*").alias("n"), squares.alias("squares"))
    params = saved(first.join(enough, "grp", "left_semi").mapInPandas(_start, _PARAMS), "quality-params")
    pairs = [(j, k) for j in range(D) for k in range(j, D)]
    names = [f"s{j}" for j in range(D)] + [f"p{j}_{k}" for j, k in pairs]
    sums = [F.sum(x[j]).alias(f"s{j}") for j in range(D)] + [F.sum(x[j] * x[k]).alias(f"p{j}_{k}") for j, k in pairs]
    moments = [F.array(*names[:D]).alias("sums"), F.array(*names[D:]).alias("products")]

    off = F.array(*[(x[j] / SCALE - F.col("center")[j]) * F.sqrt(F.col("inverse")[j * D + j]) for j in range(D)])
    length = sum((F.col("off")[j] * F.col("off")[j] for j in range(D)), F.lit(0.0))
    signs = rows.join(hinted(params, n_groups, BROADCAST_GROUPS), "grp").withColumn("off", off).withColumn("length", length)
    product = lambda j, k: F.when(F.col("length") > 0, F.round(F.col("off")[j] * F.col("off")[k] / F.col("length") * _SIGN)).otherwise(0).cast("long")
    signs = signs.groupBy("grp").agg(F.count("*").alias("n"), *sums, *[F.sum(product(j, k)).alias(f"g{j}_{k}") for j, k in pairs])
    signs = signs.join(params.select("grp", "center", "inverse", "noise"), "grp").select("grp", "n", "center", "inverse", "noise", *moments, F.array(*[f"g{j}_{k}" for j, k in pairs]).alias("signs"))
    params = saved(params.unionByName(signs.mapInPandas(_more_starts, _PARAMS)).withColumn("log_det", F.lit(float("inf"))), "quality-params")

    for _ in range(STEPS):
        near = rows.join(hinted(params, 3 * n_groups, BROADCAST_GROUPS), "grp")
        # a bin of distances is 1/64 of a doubling of 1 + distance
        near = near.withColumn("bin", F.floor(64 * F.log2(1 + squared_distance(x, F.col("center"), F.col("inverse")))))
        bins = near.groupBy("grp", "start", "bin").agg(F.count("*").alias("n"), *sums)
        one = Window.partitionBy("grp", "start")
        before = F.coalesce(F.sum("n").over(one.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        core = bins.withColumn("core", before < CORE * F.sum("n").over(one)).where("core").groupBy("grp", "start").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names])
        noise = params.where("start = 0").select("grp", "noise")
        step = core.select("grp", "start", "n", *moments).join(hinted(noise, n_groups, BROADCAST_GROUPS), "grp").mapInPandas(_estimate, _PARAMS)
        was = params.select("grp", "start", *[F.col(c).alias(f"{c}_was") for c in ("center", "inverse", "log_det")])
        falls = F.col("log_det") < F.col("log_det_was") - LEAST_FALL
        params = saved(step.join(was, ["grp", "start"]).select("grp", "start", *[F.when(falls, F.col(c)).otherwise(F.col(f"{c}_was")).alias(c) for c in ("center", "inverse", "log_det")], "noise", falls.alias("fell")), "quality-params")
        if params.where("fell").isEmpty():
            break
    low = params.withColumn("low", F.min("log_det").over(Window.partitionBy("grp"))).where(F.col("log_det") <= F.col("low") + TIE)
    best = low.groupBy("grp").agg(F.min(F.struct("start", "center", "inverse", "noise", "log_det")).alias("best")).select(F.col("grp").alias("to"), "best.*")
    named = counts.select("grp").join(target, "grp").join(best, "to").select("grp", "center", "inverse", "noise", "log_det")
    return saved(named, "quality-estimates"), n_groups


def judged(docs: DataFrame, params: DataFrame, n_groups: int, language: str, source: str) -> DataFrame:
    """``docs``, which has a column stats, with base_failed, distance (null without an estimate) and kept."""
    rows = docs.withColumn("grp", group_key(F.col(language), F.col(source))).join(hinted(params, n_groups, BROADCAST_GROUPS), "grp", "left")
    rows = rows.withColumn("base_failed", base_failed(F.col("stats"))).withColumn("distance", own_distance("stats.x", "stats.r", "center", "inverse", "noise"))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= CUTOFF)).drop("grp", "center", "inverse", "noise", "log_det")


def quality_rules(docs: DataFrame, columns: list[str], language: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """For each row of ``docs``: ``columns``, stats (struct), base_failed, distance and kept. The text is read once; statistics are then kept as a table.

    A null or empty text has zero counts and fails the base rules. Null languages and sources are groups of their own.
    Repeated rows get equal verdicts. Columns with the new names are replaced. Estimates use the texts that pass the base rules, all of them. An empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(packed(docs, columns), F.col(language).alias("language_"), F.col(source).alias("source_"), stats(text).alias("stats"))
    rows = saved(rows, "quality-stats")
    passed = rows.where(~base_failed(F.col("stats")))
    params, n_groups = fit(passed.select(F.col("language_").alias("language"), F.col("source_").alias("source"), "stats.x", "stats.r"))
    made = ("stats", "base_failed", "distance", "kept")
    return judged(rows, params, n_groups, "language_", "source_").select(*unpacked(columns, made), *made)


def keep_good(docs: DataFrame, language: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the same columns. The text is read once; rows and statistics are then kept as a table."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(packed(docs), F.col(language).alias("language_"), F.col(source).alias("source_"), stats(text).alias("stats"))
    rows = saved(rows.where(~base_failed(F.col("stats"))), "quality-rows")
    params, n_groups = fit(rows.select(F.col("language_").alias("language"), F.col("source_").alias("source"), "stats.x", "stats.r"))
    return judged(rows, params, n_groups, "language_", "source_").where("kept").select(*unpacked(docs.columns))
