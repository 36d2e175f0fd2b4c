"""Quality classifier: regularised quadratic discriminant analysis over document statistics.

`statistics` transforms counts of each text into FEATURES, `fit` gathers class means and covariances
as sums (a few hundred numbers, whatever the input), shrinks each covariance towards the pooled one
and towards its own diagonal, and keeps the inverse Cholesky factors; `score` turns the difference
of the two Mahalanobis log-densities into a probability, in plain columns.

Neither labels nor lang, source or doc_id enter a score. Rows whose crc32(doc_id as text) mod 5 is 0
are held out of the fit. Labels other than 0 and 1, and labels without a document, are left out; a
document with several label rows counts once for each.

Defined results: a text of any length is measured whole; a null or empty text is scored by its statistics, which are then 0; if the fit has
no two classes (an empty table), every score is the share of label 1, or 0.5 without labels; a null
doc_id is never held out; repeated rows are scored one by one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm.common import settle, table
from quillspan.llm.quality_rules import measure

FEATURES = ("length", "word_length", "symbols", "dup_lines", "repeats", "capitals", "shouts", "bars", "digits", "stops")
HOLD_OUT = 5
THRESHOLD = 0.3
#: Shares of the pooled covariance and of the own diagonal in each class covariance.
POOLED, DIAGONAL = 0.05, 0.1
#: Added to the diagonal: spread that a constant statistic is taken to have.
RIDGE = 1e-2


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and `features`, an array of doubles in the order of FEATURES."""
    raw = F.coalesce(F.col("text"), F.lit(""))
    found = lambda pattern: (F.length(raw) - F.length(F.regexp_replace(raw, pattern, ""))).cast("double")
    counted = docs.select("doc_id", "text").withColumns({"_c_shouts": found("[!?]+"), "_c_bars": found("[|]+"), "_c_digits": found("[0-9]+"), "_c_stops": found("[.,;:]+")})
    d = measure(counted)
    per = lambda x, y: 1000.0 * F.col(x) / F.greatest(F.col(y), F.lit(1))
    values = {
        "length": F.log1p(F.col("n_words")),
        "word_length": F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1)),
        "symbols": F.log1p(per("n_symbols", "word_chars")),
        "dup_lines": F.log1p(F.col("_q_dup_lines")),
        "repeats": F.log1p(per("n_repeat_words", "n_words")),
        "capitals": F.log1p(F.col("_q_capitals")),
        "shouts": F.log1p(per("_c_shouts", "word_chars")),
        "bars": F.log1p(per("_c_bars", "word_chars")),
        "digits": F.log1p(per("_c_digits", "word_chars")),
        "stops": F.log1p(per("_c_stops", "word_chars")),
    }
    return d.select("doc_id", F.array(*[values[f].cast("double") for f in FEATURES]).alias("features"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % HOLD_OUT == 0, F.lit(False))


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors and log-determinants of the classes 0 and 1, and the log prior odds."""

    means: list[list[float]]
    factors: list[list[list[float]]]
    log_dets: list[float]
    log_odds: float


def fit(labelled: DataFrame) -> Discriminant | float:
    """From rows of features and label. Without two classes: the share of label 1."""
    k = len(FEATURES)
    x = [F.get("features", F.lit(i)) for i in range(k)]
    sums = [F.sum(v).alias(f"s{i}") for i, v in enumerate(x)]
    products = [F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i in range(k) for j in range(i + 1)]
    rows = {r["label"]: r for r in labelled.where(F.col("label").isin(0, 1)).groupBy("label").agg(F.count("*").alias("n"), *sums, *products).collect()}
    if len(rows) < 2:
        return float(next(iter(rows))) if rows else 0.5
    means, covs, ns = [], [], []
    for label in (0, 1):
        r = rows[label]
        n = r["n"]
        mean = np.array([r[f"s{i}"] for i in range(k)]) / n
        second = np.array([[r[f"p{max(i, j)}_{min(i, j)}"] for j in range(k)] for i in range(k)]) / n
        means.append(mean)
        covs.append(second - np.outer(mean, mean))
        ns.append(n)
    pooled = (ns[0] * covs[0] + ns[1] * covs[1]) / sum(ns)
    factors, dets = [], []
    for c in covs:
        shrunk = (1 - POOLED - DIAGONAL) * c + POOLED * pooled + DIAGONAL * np.diag(np.diag(c)) + RIDGE * np.eye(k)
        lower = np.linalg.cholesky(shrunk)
        factors.append(np.linalg.inv(lower).tolist())
        dets.append(2 * float(np.log(np.diag(lower)).sum()))
    return Discriminant([m.tolist() for m in means], factors, dets, math.log(ns[1] / ns[0]))


def score(features: Column, model: Discriminant | float) -> Column:
    """Probability of label 1, from 0 to 1."""
    if not isinstance(model, Discriminant):
        return F.lit(float(model))

    def log_density(label: int) -> Column:
        gap = [F.get(features, F.lit(i)) - F.lit(m) for i, m in enumerate(model.means[label])]
        distance = F.lit(0.0)
        for i, row in enumerate(model.factors[label]):
            z = gap[0] * F.lit(row[0])
            for j in range(1, i + 1):
                z = z + gap[j] * F.lit(row[j])
            distance = distance + F.pow(z, F.lit(2.0))
        return F.lit(-0.5) * (distance + F.lit(model.log_dets[label]))

    odds = log_density(1) - log_density(0) + F.lit(model.log_odds)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.least(odds, F.lit(700.0)), F.lit(-700.0))))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of `docs`."""
    seen = settle(statistics(docs))
    known = labels.select(F.col("doc_id").alias("_l_doc_id"), F.col("quality").alias("label"))
    labelled = seen.join(known, seen["doc_id"] == known["_l_doc_id"]).where(~held_out(F.col("doc_id"))).select("features", "label")
    model = fit(labelled)
    out = seen.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("features"), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
