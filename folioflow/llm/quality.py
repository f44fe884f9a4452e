"""Operator 8, quality rules: fixed base rules and robust multivariate outliers.

Each document gets a vector of transformed text statistics. Per language and source, per language and over all rows the
minimum covariance determinant is estimated over the documents that pass the base rules: from coordinate-wise medians and
deviations, concentration steps keep the ``SHARE`` of rows nearest to the estimate and estimate anew, until the
determinant falls no more. Every step is one pass of sums over the small table of vectors, pre-aggregated per task, so a
source with a third of all rows costs no more than its rows; groups that have settled take no part in further steps.

Every document is judged by its own language and source, whose estimate is drawn towards that of the language with the
weight of ``PRIOR`` rows, and that of the language likewise towards all rows. So a source of a few rows is judged almost
by its language and a large one by itself, without a size at which one rule gives way to another. Documents whose
squared Mahalanobis distance exceeds ``CUT`` are rejected.

Text statistics are often constant (no symbols at all), which would make any covariance singular: each variance gets the
square of a floor, the difference in that statistic that never matters by itself.

Cases: a null text has no words and fails the base rules; null language or source is a group of its own; repeated rows
count each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_SEPARATORS, byte_texts, discard, fresh, keyed_rows, materialize, read_documents, row_key

# Fixed values of the contract.
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS, MOST_REPEATED = 50, 50

#: Statistics of the vector and the floor of each one's deviation.
FEATURES = {"f_word": 0.06, "f_symbol": 0.04, "f_repeat": 0.05, "f_upper": 0.04, "f_stop": 0.05}
SHARE = 0.75
#: Rows that the estimate one level up counts for.
PRIOR = 60
#: A group has settled when a step lowers the logarithm of its determinant by no more than this.
SETTLED = 1e-3
#: Quantiles are right to one in so many ranks; what a task passes on for a group grows with it.
PRECISION = 1_000
#: The group of all rows.
ALL_ROWS = "\x03"
#: Groups whose estimates are broadcast; of more, they are joined by shuffle.
FEW_GROUPS = 50_000
#: Squared distance beyond which a document is rejected; chi-squared with five degrees of freedom, what normal vectors would
#: have, exceeds it once in 70 million, so what is rejected is no tail of the ordinary but of another kind.
CUT = 45.0
#: Median of chi-squared with five degrees of freedom, to which distances are scaled.
MEDIAN5 = 4.3515

_CONTINUATION = bytes(range(0x80, 0xC0))
_SMALL = b"abcdefghijklmnopqrstuvwxyz"
_NOT_UPPER = bytes(c for c in range(256) if not 65 <= c <= 90)
_NOT_SMALL = bytes(c for c in range(256) if c not in _SMALL)

STATISTICS = (
    "k_id bigint, k_text bigint, doc_id bigint, lang string, source string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
    "n_repeat_words bigint, f_word double, f_symbol double, f_repeat double, f_upper double, f_stop double"
)


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more."""
    triples = list(zip(words, words[1:], words[2:]))
    if len(set(triples)) == len(triples):
        return 0
    n = Counter(triples)
    hit = np.zeros(len(words), dtype=bool)
    at = np.flatnonzero(np.fromiter((n[t] > 1 for t in triples), dtype=bool, count=len(triples)))
    hit[at] = hit[at + 1] = hit[at + 2] = True
    return int(hit.sum())


def statistics(text: bytes) -> tuple:
    words = text.split()
    n = len(words)
    chars = len(text.translate(None, WORD_SEPARATORS + _CONTINUATION))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    seen, dup = set(), 0
    for line in text.split(b"\n"):
        if line.strip(WORD_SEPARATORS):
            dup += line in seen
            seen.add(line)
    repeat = repeated_words(words)
    upper, small = len(text.translate(None, _NOT_UPPER)), len(text.translate(None, _NOT_SMALL))
    marks = len(text) - len(text.translate(None, b"!?.,;:"))
    vector = (np.log((chars + 1) / (n + 1)), np.sqrt(symbols / (chars + 1)), repeat / (n + 1), np.sqrt(upper / (upper + small + 1)), np.sqrt(marks / (chars + 1)))
    return (n, chars, symbols, dup, repeat, *map(float, vector))


def text_statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """A row per document (:data:`STATISTICS`); exact counts and the transformed vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in STATISTICS.split(", ")]
        kinds = [pa.int64()] * 5 + [pa.float64()] * 5
        for batch in batches:
            found = [statistics(t) for t in byte_texts(batch.column(5))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *(pa.array(x, k) for x, k in zip(zip(*found) if found else [[]] * 10, kinds))], names=names)

    rows = docs.select(*row_key(id_col, text_col), F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, STATISTICS)


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def _distance(names: list[str]) -> Column:
    """Squared distance from the columns m_i and p_i_j of an estimate."""
    terms = [F.col(f"p_{i}_{j}") * (F.col(a) - F.col(f"m_{i}")) * (F.col(b) - F.col(f"m_{j}")) * (1 if i == j else 2) for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]
    return sum(terms[1:], terms[0])


def _columns(d: int) -> tuple[list[str], list[str]]:
    """Names of an estimate's means and of the upper triangle of its covariance."""
    return [f"m_{i}" for i in range(d)], [f"v_{i}_{j}" for i in range(d) for j in range(i, d)]


def _matrices(pdf, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and covariances of the rows of an estimate."""
    means, values = _columns(d)
    cov = np.zeros((len(pdf), d, d))
    for name in values:
        i, j = map(int, name.split("_")[1:])
        cov[:, i, j] = cov[:, j, i] = pdf[name].to_numpy()
    return pdf[means].to_numpy(dtype=float).reshape(len(pdf), d), cov


def _inverted(pdf, mean: np.ndarray, cov: np.ndarray):
    """``pdf`` with means, covariances, precisions and log-determinants."""
    d = mean.shape[1]
    precision, out = np.linalg.inv(cov), pdf.copy()
    out["logdet"] = np.linalg.slogdet(cov)[1]
    for i in range(d):
        out[f"m_{i}"] = mean[:, i]
        for j in range(i, d):
            out[f"v_{i}_{j}"], out[f"p_{i}_{j}"] = cov[:, i, j], precision[:, i, j]
    return out


def _schema(d: int) -> str:
    means, values = _columns(d)
    return "grp string, n bigint, logdet double, " + ", ".join(f"{c} double" for c in [*means, *values, *(v.replace("v", "p") for v in values)])


def _estimated(sums: DataFrame, floors: list[float]) -> DataFrame:
    """Estimates of rows (grp, n, c_i, e_i, e_i_j): first and second moments around ``c_i``."""
    d = len(floors)
    names = [f.split()[0] for f in _schema(d).split(", ")]

    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            mean = pdf[[f"e_{i}" for i in range(d)]].to_numpy(dtype=float).reshape(len(pdf), d)
            cov = np.zeros((len(pdf), d, d))
            for i in range(d):
                for j in range(i, d):
                    cov[:, i, j] = cov[:, j, i] = pdf[f"e_{i}_{j}"].to_numpy() - mean[:, i] * mean[:, j]
            cov[:, np.arange(d), np.arange(d)] = np.maximum(cov[:, np.arange(d), np.arange(d)], 0) + np.array(floors) ** 2
            yield _inverted(pdf[["grp", "n"]], mean + pdf[[f"c_{i}" for i in range(d)]].to_numpy(dtype=float).reshape(len(pdf), d), cov)[names]

    return sums.mapInPandas(run, _schema(d))


def _drawn(pairs: DataFrame, d: int, prior: int) -> DataFrame:
    """Estimates of rows of two estimates, the second one's columns with a ``u`` before: each drawn towards the second."""
    names = [f.split()[0] for f in _schema(d).split(", ")]

    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            mean, cov = _matrices(pdf, d)
            up_mean, up_cov = _matrices(pdf[[c for c in pdf.columns if c.startswith("u")]].rename(columns=lambda c: c[1:]), d)
            w = (pdf["n"].to_numpy() / (pdf["n"].to_numpy() + prior))[:, None]
            yield _inverted(pdf[["grp", "n"]], w * mean + (1 - w) * up_mean, w[:, :, None] * cov + (1 - w)[:, :, None] * up_cov)[names]

    return pairs.mapInPandas(run, _schema(d))


def _small(groups: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Broadcasts a table of a row (some 200 bytes) for each group if there are no more than ``FEW_GROUPS``."""
    few = groups.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS
    return F.broadcast if few else lambda df: df


def robust_estimates(vectors: DataFrame, features: dict[str, float] = FEATURES, share: float = SHARE) -> DataFrame:
    """MCD location, covariance and precision (:func:`_schema`; ``n`` is of all rows) for every ``grp`` of ``vectors``."""
    names, floors = list(features), list(features.values())
    d = len(names)
    groups = materialize(vectors.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), *[F.percentile_approx(c, 0.5, PRECISION).alias(f"c_{i}") for i, c in enumerate(names)]), "mcd")
    small = _small(groups)
    spread = vectors.join(small(groups), "grp").groupBy("grp").agg(
        *[F.first(f"c_{i}").alias(f"m_{i}") for i in range(d)], *[F.percentile_approx(F.abs(F.col(c) - F.col(f"c_{i}")), 0.5, PRECISION).alias(f"s_{i}") for i, c in enumerate(names)]
    )
    zero = [F.lit(0.0).alias(f"p_{i}_{j}") for i in range(d) for j in range(i + 1, d)]
    start = spread.select("grp", F.lit(float("inf")).alias("logdet"), *[f"m_{i}" for i in range(d)], *[(1 / (F.pow(1.4826 * F.col(f"s_{i}"), 2) + floors[i] ** 2)).alias(f"p_{i}_{i}") for i in range(d)], *zero)
    estimate, settled = materialize(start, "mcd"), None
    while True:
        placed = vectors.join(small(estimate), "grp").withColumn("d2", _distance(names)).select("grp", "d2", *names, *[F.col(f"m_{i}").alias(f"c_{i}") for i in range(d)])
        near = placed.groupBy("grp").agg(F.percentile_approx("d2", share, PRECISION).alias("most"))
        kept = placed.join(small(near), "grp").where("d2 <= most")
        x = [F.col(c) - F.col(f"c_{i}") for i, c in enumerate(names)]
        sums = kept.groupBy("grp").agg(
            F.count(F.lit(1)).alias("n"), *[F.first(f"c_{i}").alias(f"c_{i}") for i in range(d)], *[F.avg(x[i]).alias(f"e_{i}") for i in range(d)],
            *[F.avg(x[i] * x[j]).alias(f"e_{i}_{j}") for i in range(d) for j in range(i, d)],
        )
        last = estimate.select("grp", F.col("logdet").alias("last"))
        step = materialize(_estimated(sums, floors).join(small(last), "grp").withColumn("settled", F.col("logdet") > F.col("last") - SETTLED), "mcd")
        discard(estimate)
        done = step.where("settled").drop("settled", "last")
        settled = done if settled is None else settled.unionByName(done)
        # Determinants are bounded from below by the floors, so each group settles.
        estimate = step.where("not settled").drop("settled", "last")
        if estimate.isEmpty():
            break
    # Covariances are scaled so that the median distance is that of a normal sample, never below what the floors make of them.
    found = materialize(settled, "mcd")
    scale = vectors.join(small(found), "grp").withColumn("d2", _distance(names)).groupBy("grp").agg(F.greatest(F.percentile_approx("d2", 0.5, PRECISION) / MEDIAN5, F.lit(1.0)).alias("scale"))
    means, values = _columns(d)
    scaled = [(F.col(v) * F.col("scale")).alias(v) for v in values] + [(F.col(v.replace("v", "p")) / F.col("scale")).alias(v.replace("v", "p")) for v in values]
    full = found.drop("n").join(scale, "grp").join(groups.select("grp", "n"), "grp")
    return materialize(full.select("grp", "n", (F.col("logdet") + d * F.log("scale")).alias("logdet"), *means, *scaled), "mcd")


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", cut: float = CUT, prior: int = PRIOR) -> DataFrame:
    """A row per document: statistics, ``base_failed``, ``distance`` (null where the base rules failed) and ``kept``."""
    rows = materialize(text_statistics(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, source_col=source_col).withColumn("base_failed", base_failed()), "quality")
    # The last characters keep the groups of the three levels apart, whatever the names are.
    language = F.concat(F.coalesce(F.col("lang"), F.lit("\x00")), F.lit("\x02"))
    own = F.concat(F.coalesce(F.col("lang"), F.lit("\x00")), F.lit("\x01"), F.coalesce(F.col("source"), F.lit("\x00")), F.lit("\x01"))
    grouped = rows.withColumn("grp", own)
    passed = rows.where(~F.col("base_failed"))
    vectors = passed.select(F.explode(F.array(own, language, F.lit(ALL_ROWS))).alias("grp"), *FEATURES)
    d = len(FEATURES)
    estimates = robust_estimates(vectors)
    small = _small(estimates)
    # An estimate as the one that others are drawn towards.
    up = lambda df: df.select(F.col("grp").alias("ugrp"), *(F.col(c).alias(f"u{c}") for c in sum(_columns(d), [])))
    levels = materialize(passed.select(own.alias("own"), language.alias("language")).distinct(), "quality-levels")
    tops = materialize(levels.select("language").distinct().withColumn("ugrp", F.lit(ALL_ROWS)), "quality-levels")
    languages = estimates.join(small(tops), F.col("grp") == F.col("language")).drop("language").join(small(up(estimates)), "ugrp")
    languages = materialize(_drawn(languages, d, prior), "mcd")
    paired = estimates.join(small(levels), F.col("grp") == F.col("own")).join(small(up(languages)), F.col("language") == F.col("ugrp"))
    drawn = materialize(_drawn(paired.drop("own", "language"), d, prior), "mcd")
    judged = grouped.join(small(drawn.drop("n", "logdet", *_columns(d)[1])), "grp", "left").withColumn("distance", F.when(~F.col("base_failed"), _distance(list(FEATURES))))
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cut)
    return judged.select(*rows.columns, "grp", "distance", kept.alias("kept"))


def keep_good(docs: DataFrame, **columns: str) -> DataFrame:
    """``docs`` without the rows that :func:`judge` rejects."""
    lang_col, source_col = columns.get("lang_col", "lang"), columns.get("source_col", "source")
    keyed, (k_id, k_text) = keyed_rows(docs, columns.get("id_col", "doc_id"), columns.get("text_col", "text"))
    lang, source = fresh(keyed.columns, "lang"), fresh(keyed.columns, "source")
    bad = judge(docs, **columns).where(~F.col("kept")).select(F.col("k_id").alias(k_id), F.col("k_text").alias(k_text), F.col("lang").alias(lang), F.col("source").alias(source)).distinct()
    left, right = keyed.alias("l"), bad.hint("shuffle_hash").alias("r")
    same = (F.col(f"l.{k_id}") == F.col(f"r.{k_id}")) & (F.col(f"l.{k_text}") == F.col(f"r.{k_text}"))
    same &= F.col(f"l.{lang_col}").cast("string").eqNullSafe(F.col(f"r.{lang}")) & F.col(f"l.{source_col}").cast("string").eqNullSafe(F.col(f"r.{source}"))
    return left.join(right, same, "left_anti").select(*docs.columns)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(read_documents(spark, sf_dir))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
