"""Quality classification by regularised quadratic discriminant analysis.

A text becomes a vector of transformed document statistics (lengths, shares of character classes,
repetition, word shape). Per class, mean and covariance come from sums over all labelled rows, taken in
each partition and added up; the covariance is shrunk towards the pooled one and a scaled
identity. A score is the difference of two Gaussian log densities: Mahalanobis distances by Cholesky
factors that are computed once and sent with the task, plus log determinants and log priors, through
a logistic curve whose slope and offset are fitted on the same rows' log-density differences.

Null and empty texts are scored like any other (their statistics are those of no words). Repeated rows
get equal scores. If a class has fewer than two labelled rows (no covariance), all scores are that of the
other: 0 or 1, and 0.5 if no row is labelled. Labelled rows that are all alike leave a covariance of zero,
whose ridge has an absolute floor: their score is then the share of the classes. Columns of ``docs`` and
``labels`` other than the named ones are never read; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bibliodyne.llm.langid import held_out
from bibliodyne.session import materialize, packed

WORD = regex.compile(r"\p{L}[\p{L}\p{M}'’]*")
STATS = (
    "log_words", "log_chars", "word_length", "word_length_sd", "letters", "digits", "upper", "symbols", "punctuation", "spaces", "distinct_words",
    "top_word", "repeated_next", "repeated_lines", "line_words", "bars", "marks", "upper_words", "capital_words", "sentence_ends", "distinct_pairs",
)
#: Upper-case letters among the first code points; the alphabets beyond have one case.
UPPER = np.array([chr(i).isupper() for i in range(0x2C00)])
#: Character classes over code points, the last entry standing for all beyond.
KINDS = np.zeros(0x2C01, dtype=np.uint8)
KINDS[: len(UPPER)][UPPER] = 1
for _kind, _chars in ((2, "0123456789"), (3, ".,;:!?'\"()-’"), (4, "#$%&*")):
    KINDS[[ord(c) for c in _chars]] = _kind

#: Floor of the mean variance that the ridge is taken from.
LEAST_SCALE = 1e-4


def logit(x: float) -> float:
    return float(np.log((x + 0.01) / (1.01 - x)))


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of a whole text, in the order of ``STATS``."""
    text = text or ""
    n = max(1, len(text))
    tokens = text.split()
    words = WORD.findall(text)
    nt, nw = max(1, len(tokens)), max(1, len(words))
    lengths = np.fromiter(map(len, words), dtype=np.float64, count=len(words)) if words else np.zeros(1)
    points = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4"), len(UPPER))
    _, upper, digits, punctuation, marks = np.bincount(KINDS[points], minlength=5).tolist()
    letters, spaces, marks = int(lengths.sum()), len(text) - sum(map(len, tokens)), marks + text.count("!")
    symbols = max(0, len(text) - letters - digits - spaces - punctuation)
    lines = [x for x in text.split("\n") if x.strip()]
    counts, pairs = Counter(tokens), zip(tokens, tokens[1:], strict=False)
    ends = sum(map(text.count, ".!?"))
    return [
        np.log1p(len(tokens)), np.log1p(len(text)), np.log1p(lengths.mean()), np.log1p(lengths.std()),
        logit(min(1.0, letters / n)), logit(min(1.0, digits / n)), logit(upper / n), logit(symbols / n), logit(punctuation / n), logit(spaces / n),
        logit(len(counts) / nt), logit(max(counts.values(), default=0) / nt),
        logit(sum(map(eq, tokens, tokens[1:])) / nt),
        logit(1 - len(set(lines)) / max(1, len(lines))), np.log1p(len(tokens) / max(1, len(lines))),
        logit(text.count("|") / nt if text.count("|") < nt else 1.0), logit(min(1.0, marks / n)),
        logit(sum(map(str.isupper, words)) / nw), logit(sum(w[0].isupper() for w in words) / nw),
        logit(min(1.0, ends / nt)), logit(len(set(pairs)) / nt),
    ]


def _stacked(texts: pd.Series) -> np.ndarray:
    return np.array([statistics(t) for t in texts], dtype=np.float64).reshape(-1, len(STATS))


class Discriminant:
    """Means, Cholesky factors, log determinants and priors of both classes, and the final curve."""

    def __init__(self, n: np.ndarray, sums: np.ndarray, squares: np.ndarray, shrink: float = 0.15, ridge: float = 0.02) -> None:
        self.n, d = n, len(STATS)
        self.usable = bool((n >= 2).all())
        if not self.usable:
            return
        self.mean = sums / n[:, None]
        covariance = [squares[c] / n[c] - np.outer(self.mean[c], self.mean[c]) for c in (0, 1)]
        pooled = (n[0] * covariance[0] + n[1] * covariance[1]) / n.sum()
        scale = max(float(np.trace(pooled)) / d, LEAST_SCALE)
        # The fewer rows a class has, the more of the pooled covariance it takes.
        weight = [min(1.0, shrink + d / (d + n[c])) for c in (0, 1)]
        kept = [(1 - weight[c]) * covariance[c] + weight[c] * pooled + ridge * scale * np.eye(d) for c in (0, 1)]
        self.factor = [np.linalg.inv(np.linalg.cholesky(k)) for k in kept]
        self.log_det = [-2 * float(np.log(np.diag(f)).sum()) for f in self.factor]
        self.slope, self.offset = 1.0, float(np.log(n[1] / n[0]))

    def difference(self, x: np.ndarray) -> np.ndarray:
        """log density of class 1 minus that of class 0."""
        log = [-0.5 * (((x - self.mean[c]) @ self.factor[c].T) ** 2).sum(axis=1) - 0.5 * self.log_det[c] for c in (0, 1)]
        return log[1] - log[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.usable:
            total = self.n.sum()
            return np.full(len(x), 0.5 if not total else float(self.n[1] / total > 0.5))
        return 1 / (1 + np.exp(-np.clip(self.slope * self.difference(x) + self.offset, -500, 500)))


def statistics_of(text: Column) -> Column:
    """The statistics of a text column, as an array of double."""

    @F.pandas_udf("array<double>")
    def stats(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(_stacked(texts)), dtype=object)

    return stats(text)


def labelled(seen: DataFrame, labels: DataFrame) -> DataFrame:
    """(quality, x) of all rows to learn from; only statistics are shuffled, not texts."""
    marked = labels.select(F.col("doc_id").alias("_d"), "quality").filter(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"), 4, 2))
    return seen.join(marked, F.col("doc_id") == F.col("_d")).select("quality", "x")


def _partial_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    d = len(STATS)
    total = np.zeros((2, 1 + d + d * d))
    for rows in batches:
        if not len(rows):
            continue
        x, y = np.stack(rows.x.to_numpy()), rows.quality.to_numpy()
        for c in (0, 1):
            xc = x[y == c]
            total[c] += np.concatenate([[len(xc)], xc.sum(axis=0), (xc.T @ xc).ravel()])
    for c in (0, 1):
        if total[c, 0]:
            yield pd.DataFrame({"quality": [c], "v": [total[c]]})


def fit(statistics_table: DataFrame, labels: DataFrame, bins: int = 400) -> Discriminant:
    """Learn from all labelled rows (doc_id, x) outside the held-out fold; only sums reach the driver."""
    seen = materialize(labelled(statistics_table, labels), "quality")
    d = len(STATS)
    parts = seen.mapInPandas(_partial_sums, "quality int, v array<double>")
    added = parts.select("quality", F.posexplode("v").alias("i", "v")).groupBy("quality", "i").agg(F.sum("v").alias("v")).collect()
    total = np.zeros((2, 1 + d + d * d))
    for r in added:
        total[r.quality, r.i] = r.v
    model = Discriminant(total[:, 0], total[:, 1 : 1 + d], total[:, 1 + d :].reshape(2, d, d))
    if model.usable:
        _fit_curve(model, seen, bins)
    return model


def _fit_curve(model: Discriminant, seen: DataFrame, bins: int) -> None:
    """Slope and offset of the score from a histogram of log-density differences (Newton steps)."""

    @F.pandas_udf("int")
    def binned(x: pd.Series) -> pd.Series:
        z = model.difference(np.stack(x.to_numpy())) if len(x) else np.zeros(0)
        return pd.Series(np.clip(np.round(np.sign(z) * np.log1p(np.abs(z)) * bins / 20), -bins, bins).astype("int32"))

    rows = seen.groupBy(binned(F.col("x")).alias("b")).agg(F.sum("quality").alias("ones"), F.count("*").alias("n")).collect()
    u = np.array([r.b for r in rows]) * 20 / bins
    z, ones, n = np.sign(u) * np.expm1(np.abs(u)), np.array([float(r.ones) for r in rows]), np.array([float(r.n) for r in rows])
    z = np.clip(z, -60, 60)
    a, b = 0.5, model.offset
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -35, 35)))
        g = np.array([((ones - n * p) * z).sum() - 1e-3 * a, (ones - n * p).sum() - 1e-3 * b])
        v = n * p * (1 - p)
        h = np.array([[(v * z * z).sum() + 1e-3, (v * z).sum()], [(v * z).sum(), v.sum() + 1e-3]])
        step = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-9:
            break
    model.slope, model.offset = max(a, 1e-3), b


def scores(spark: SparkSession, model: Discriminant, x: Column) -> Column:
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series(shared.value.score(np.stack(rows.to_numpy()) if len(rows) else np.zeros((0, len(STATS)))))

    return scored(x)


def quality_table(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (needs doc_id, text)."""
    seen = materialize(docs.select("doc_id", statistics_of(F.col("text")).alias("x")), "quality-statistics")
    scored = seen.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), scores(docs.sparkSession, fit(seen, labels), F.col("x")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``docs`` without rows that score below the threshold."""
    model = fit(docs.select("doc_id", statistics_of(F.col("text")).alias("x")), labels)
    scored = packed(docs, "text").withColumn("score", scores(docs.sparkSession, model, statistics_of(F.col("text"))))
    return scored.filter(F.col("score") >= threshold).select("_row.*")
