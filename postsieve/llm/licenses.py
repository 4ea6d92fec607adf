"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest directory above that has a license file.

Every line of a whole text, every run of up to WINDOW lines and every run of as many terms as a template has, across line ends, is a
candidate statement. Its TF-IDF vector is compared with those of the templates (statements, and whole license texts and notices), with
document frequencies of all terms over all files.

The frequencies are a table. A scan of the texts knows those of the terms of templates only, and takes the least possible weight for all other terms, so it
gives an upper bound of each cosine; runs whose bound reaches the threshold are kept with their other terms, which are then joined
to the table for the exact cosine. Only runs that hold a telling term are looked at: terms are telling
unless the other ones of some template could reach the threshold by themselves, so nothing that could match is passed over.
A title of a license text, whose terms follow each other, says which license a text names; that is no cosine and no grant. Only in a license file that states nothing else does it count.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log, sqrt

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from .common import bounded_batches, hinted, packed, saved, unpacked
from .license_texts import STATEMENTS, TEXTS, TITLES

#: Templates in order; of equally near ones the first counts.
TEMPLATES = STATEMENTS + TEXTS
#: The template that grants nothing; a title that stands beside it counts more.
RESERVED = "LicenseRef-all-rights-reserved"
THRESHOLD = 0.8
WINDOW = 3
#: Directories whose nearest licenses may be broadcast: some 200 bytes each.
BROADCAST_DIRS = 50_000
#: Rows of a table of terms that may be broadcast; beyond, it is joined by a shuffle.
BROADCAST_TERMS = 200_000
TERM = r"[0-9a-z]++(?:[.-][0-9a-z]++)*+"  # possessive: without a way back, long terms are no deeper recursion
_TERM = re.compile(TERM)
#: The least inverse document frequency that a term can have: that of one in all files.
LEAST_IDF = 1.0


def terms(text: str) -> list[str]:
    """Lower-cased runs of ASCII letters and digits, joined over single dots and hyphens."""
    return _TERM.findall(text.lower())


VOCABULARY = sorted({t for _, text in TEMPLATES for t in terms(text)})
_TITLES = [(name, f" {' '.join(terms(text))} ") for name, text in TITLES]


def document_frequencies(files: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, n) for all terms of all files, as a table: the number of files that hold the term."""
    each = files.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(TERM), 0))).alias("term"))
    return saved(each.groupBy("term").agg(F.count("*").alias("n")), "license-terms")


def idf(n_files: int, n: int) -> float:
    """The inverse document frequency of a term that n of the files hold."""
    return log((n_files + 1) / (n + 1)) + 1


class Scanner:
    """Runs of a text that may be near a template. Holds the weights of the terms of the templates only; all other terms have the least weight."""

    def __init__(self, n_files: int, frequency: dict[str, int], threshold: float = THRESHOLD):
        self.threshold = threshold
        self.idf = {t: idf(n_files, frequency.get(t, 0)) for t in VOCABULARY}
        self.unknown = LEAST_IDF
        self.names, self.vectors, self.lengths = [], [], [len(terms(text)) for _, text in TEMPLATES]
        for name, text in TEMPLATES:
            v = {t: c * self.idf[t] for t, c in Counter(terms(text)).items()}
            norm = sqrt(sum(x * x for x in v.values()))
            self.names.append(name)
            self.vectors.append({t: x / norm for t, x in v.items()})
        # the most common terms stay untold as long as no template could reach the threshold with them alone
        plain: set[str] = set()
        for t in sorted(VOCABULARY, key=lambda t: self.idf[t]):
            if any(sum(x * x for u, x in v.items() if u in plain or u == t) >= threshold**2 for v in self.vectors):
                break
            plain.add(t)
        self.telling = set(VOCABULARY) - plain
        self.index: dict[str, list[tuple[int, float]]] = {}
        for n, v in enumerate(self.vectors):
            for t, x in v.items():
                self.index.setdefault(t, []).append((n, x))

    def bounds(self, found: list[str]) -> list[tuple[int, float, float, Counter]]:
        """For each template that a run may be near: (template, dot product, squared length by known terms, the other terms)."""
        counts = Counter(found)
        dots, known, others = Counter(), 0.0, Counter()
        for t, c in counts.items():
            w = self.idf.get(t)
            if w is None:
                others[t] = c
                continue
            known += (c * w) ** 2
            for n, x in self.index.get(t, ()):
                dots[n] += c * w * x
        least = known + sum((c * self.unknown) ** 2 for c in others.values())
        return [(n, dot, known, others) for n, dot in sorted(dots.items()) if dot >= (self.threshold - 1e-6) * sqrt(least)]

    def line_runs(self, text: str) -> Iterator[list[str]]:
        """The terms of each run of lines that holds a telling term."""
        lines = [x for x in (terms(x) for x in text.split("\n")) if x]
        near = [i for i, x in enumerate(lines) if not self.telling.isdisjoint(x)]
        for a, b in sorted({(a, a + k) for i in near for k in range(1, WINDOW + 1) for a in range(max(0, i - k + 1), i + 1) if a + k <= len(lines)}):
            yield [t for x in lines[a:b] for t in x]

    def near(self, found: list[str], n: int) -> Iterator[int]:
        """First places of the runs of terms, of the length of template ``n``, that reach the threshold with it; those with a telling term of it are tried."""
        v, size = self.vectors[n], min(self.lengths[n], len(found))
        weight = lambda t: self.idf.get(t, self.unknown)
        done = -1
        counts, dot, norm = Counter(), 0.0, 0.0
        for i in (i for i, t in enumerate(found) if t in v and t in self.telling):
            for a in range(max(0, i - size + 1, done + 1), min(i, len(found) - size) + 1):
                if a == done + 1 and counts:
                    moves = ((found[a - 1], -1), (found[a + size - 1], 1))
                else:
                    counts, dot, norm = Counter(), 0.0, 0.0
                    moves = ((t, 1) for t in found[a : a + size])
                for t, step in moves:
                    w = weight(t)
                    norm += w * w * (1 + 2 * step * counts[t])
                    dot += step * w * v.get(t, 0.0)
                    counts[t] += step
                done = a
                if dot >= (self.threshold - 1e-6) * sqrt(max(norm, 0.0)):
                    yield a

    def runs(self, text: str | None) -> list[tuple[int, float, float, Counter]]:
        """``bounds`` of all runs of lines or terms. Once a run without other terms, whose cosine is thus exact, is found, only runs that may be nearer are kept."""
        kept: list[tuple[int, float, float, Counter]] = []
        best = 0.0

        def add(run: list[str], only: int | None = None) -> None:
            nonlocal best
            for n, dot, known, others in self.bounds(run):
                if only is None or n == only:
                    kept.append((n, dot, known, others))
                    if not others:
                        best = max(best, dot / sqrt(known))

        for run in self.line_runs(text or ""):
            add(run)
        found = terms(text or "")
        present = set(found)
        if not self.telling.isdisjoint(present) and best < 1 - 1e-9:
            for n, v in enumerate(self.vectors):
                # no run has a higher cosine than the template's share of the terms that the text has at all
                if sum(x * x for t, x in v.items() if t in present) < self.threshold**2 - 1e-6:
                    continue
                for a in self.near(found, n):
                    add(found[a : a + self.lengths[n]], n)
        bound = lambda r: r[1] / sqrt(r[2] + sum((c * self.unknown) ** 2 for c in r[3].values()))
        left = {(n, round(dot, 12), round(known, 12), tuple(sorted(others.items()))): (n, dot, known, others) for n, dot, known, others in kept if bound((n, dot, known, others)) >= best - 1e-6}
        return list(left.values())


def title_of(text: str | None) -> str | None:
    """The license whose title has its terms in a row in the text; the first one in the list."""
    found = terms(text or "")
    if {"license", "creative", "cc0"}.isdisjoint(found):
        return None
    joined = f" {' '.join(found)} "
    return next((name for name, title in _TITLES if title in joined), None)


_RUNS = "array<struct<template:int,dot:double,known:double,others:array<struct<term:string,n:int>>>>"


def _scanned(scanner: Scanner, text: Column) -> Column:
    """(title, runs) of a text."""
    other = T.StructType([T.StructField("term", T.StringType()), T.StructField("n", T.IntegerType())])
    run = T.StructType([T.StructField("template", T.IntegerType()), T.StructField("dot", T.DoubleType()), T.StructField("known", T.DoubleType()), T.StructField("others", T.ArrayType(other))])
    kind = T.StructType([T.StructField("title", T.StringType()), T.StructField("runs", T.ArrayType(run))])

    @pandas_udf(kind)
    def scan(texts: pd.Series) -> pd.DataFrame:
        rows = [(title_of(t), [{"template": n, "dot": dot, "known": known, "others": [{"term": x, "n": c} for x, c in others.items()]} for n, dot, known, others in scanner.runs(t)]) for t in texts]
        return pd.DataFrame(rows, columns=["title", "runs"])

    return scan(text)


def _nearest_templates(found: DataFrame, frequencies: DataFrame, n_files: int, threshold: float) -> DataFrame:
    """``found`` (row_no, scan_, ...) with cosine_ and template_ of the nearest run, both null where none reaches the threshold."""
    runs = found.where(F.size("scan_.runs") > 0).select("row_no", F.posexplode("scan_.runs").alias("run", "r"))
    others = runs.select("row_no", "run", F.explode("r.others").alias("o")).select("row_no", "run", F.col("o.term").alias("term"), F.col("o.n").alias("times"))
    weighed = others.join(hinted(frequencies, frequencies.count(), BROADCAST_TERMS), "term")
    weight = F.col("times") * (F.log(F.lit(n_files + 1.0) / (F.col("n") + 1)) + 1)
    lengths = weighed.groupBy("row_no", "run").agg(F.sum(weight * weight).alias("rest"))
    cosine = F.round(F.col("r.dot") / F.sqrt(F.col("r.known") + F.coalesce("rest", F.lit(0.0))), 6)
    exact = runs.join(lengths, ["row_no", "run"], "left").select("row_no", cosine.alias("cosine"), F.col("r.template").alias("template")).where(F.col("cosine") >= threshold)
    best = exact.groupBy("row_no").agg(F.min(F.struct((-F.col("cosine")).alias("less"), "template")).alias("best"))
    best = saved(best.select(F.col("row_no").alias("best_no"), (-F.col("best.less")).alias("cosine_"), F.col("best.template").alias("template_")), "license-best")
    return found.join(hinted(best, best.count(), BROADCAST_DIRS), F.col("row_no") == F.col("best_no"), "left").drop("best_no")


def scan_licenses(files: DataFrame, columns: list[str], path_col: str = "path", text_col: str = "text", file_names: str = r"(?i)^(licen[cs]e|copying|notice)(\..*)?$") -> DataFrame:
    """``columns`` of each row of ``files`` with path, license, cosine, origin (header, title, inherited or none), license_dir and named.

    A file with a statement of its own has that license, and the cosine of the statement. A license file without one, or with all rights reserved alone, has the license whose
    title it holds, and no cosine. Any other file takes the license of the nearest directory at or above its own which has a
    license file (a file by such a name with a license; the one with the highest cosine, titles last, then the first license by name). named is the license whose title
    a text holds, if only in passing. A null or
    empty text has no statement; a null path has no directory. Repeated rows get equal results. Columns named like the new ones
    are replaced. An empty table gives no rows.
    """
    bounded_batches(files.sparkSession)
    n_files, frequencies = files.count(), document_frequencies(files, text_col)
    known = {r.term: r.n for r in frequencies.where(F.col("term").isin(VOCABULARY)).collect()}
    found = files.select(packed(files, columns), F.col(path_col).alias("path"), _scanned(Scanner(n_files, known), F.col(text_col)).alias("scan_"))
    found = saved(found.withColumn("row_no", F.monotonically_increasing_id()), "license-runs")
    found = _nearest_templates(found, frequencies, n_files, THRESHOLD)
    stated = F.get(F.array(*[F.lit(name) for name, _ in TEMPLATES]), F.col("template_"))
    parts = F.split("path", "/")
    home = F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/")
    name = F.element_at(parts, -1)
    titled = F.coalesce(name.rlike(file_names), F.lit(False)) & F.col("scan_.title").isNotNull() & (stated.isNull() | (stated == RESERVED))
    found = found.select(
        "row_", "path", F.col("scan_.title").alias("named_"), titled.alias("titled_"), F.when(titled, F.col("scan_.title")).otherwise(stated).alias("license_"), F.when(~titled, F.col("cosine_")).alias("cosine_")
    )
    found = saved(found, "license-own")
    dirs = found.where(name.rlike(file_names) & F.col("license_").isNotNull()).groupBy(home.alias("dir"))
    dirs = dirs.agg(F.min(F.struct(F.coalesce(-F.col("cosine_"), F.lit(0.0)).alias("less"), "license_"))["license_"].alias("dir_license"))
    # directories are far fewer than files: each one, once, looks up all its ancestors
    homes = found.where("path is not null and license_ is null").select(home.alias("home")).distinct()
    steps = F.split("home", "/")
    above = homes.select("home", F.explode(F.transform(F.sequence(F.lit(0), F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))).alias("dir")).distinct()
    nearest = above.join(dirs, "dir").groupBy("home").agg(F.max_by(F.struct("dir", "dir_license"), F.when(F.col("dir") == "", -1).otherwise(F.length("dir"))).alias("from_"))
    # as a table of its own it is either small enough to be broadcast or a plain side of a join, in which Spark may split a hot directory
    nearest = saved(nearest, "license-nearest")
    out = found.join(hinted(nearest, nearest.count(), BROADCAST_DIRS), home == F.col("home"), "left")
    own = F.col("license_").isNotNull()
    return out.select(
        *unpacked(columns, ("path", "license", "cosine", "origin", "license_dir", "named")),
        "path",
        F.coalesce("license_", "from_.dir_license").alias("license"),
        F.col("cosine_").alias("cosine"),
        F.when(F.col("titled_"), "title").when(own, "header").when(F.col("from_").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(~own, F.col("from_.dir")).alias("license_dir"),
        F.col("named_").alias("named"),
    )
