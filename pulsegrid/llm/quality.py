"""Host-level quality rules with an empirical-Bayes prior.

Each document earns failure points by a few rules about its words, symbols and
lines. Failures are counted by host, the hosts' rates are shrunk towards all
hosts' by a beta prior fitted by moments, and the verdict on the host goes back
to its documents: on a bad host one point is enough to be rejected, elsewhere
it takes two. A document without a point is never rejected for its host. A host
is bad if its posterior rate, less SURE standard deviations, is above the rate
that has ODDS times the odds of all hosts'. Where the hosts' rates differ by no
more than chance would have it, the prior is a single rate and no host is bad.

One host may hold a third of all rows: failures are summed before they are
shuffled, and the join with the hosts' table is left to Spark, which broadcasts
it only if its files are small and splits skewed partitions otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ._common import mix64, staged, words

WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: A host is bad if its odds of failing are surely this many times those of all hosts.
ODDS, SURE = 2.0, 2.0
#: Least weight of the prior, in documents.
PRIOR_WEIGHT = 1.0

FEATURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
_FACTORS = mix64(np.arange(1, WINDOW + 1, dtype=np.uint64)) | np.uint64(1)


def repeated_words(ws: list[str]) -> int:
    """Words in windows of WINDOW words that occur twice or more in the list."""
    n = len(ws) - WINDOW + 1
    if n < 2:
        return 0
    codes: dict[str, int] = {}
    ids = np.fromiter((codes.setdefault(w, len(codes)) for w in ws), np.uint64, len(ws))
    if len(codes) == len(ws):
        return 0
    ids = mix64(ids)
    h = np.zeros(n, np.uint64)
    for j, f in enumerate(_FACTORS):
        h += mix64(ids[j : j + n] * f) if j else ids[:n]
    s = np.sort(h)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return 0
    hit = np.isin(h, twice)
    cover = np.zeros(len(ws) + 1, np.int64)
    cover[:n] += hit
    cover[WINDOW:] -= hit
    return int((np.cumsum(cover) > 0).sum())


def features_of(text: str | None) -> tuple[int, ...]:
    """The counts that FEATURES names; a null text counts as empty."""
    text = text or ""
    ws = words(text)
    seen: set[str] = set()
    lines = again = 0
    for line in text.split("\n"):
        if line.strip(" \t\n\v\f\r"):
            lines += 1
            again += line in seen
            seen.add(line)
    return len(ws), sum(map(len, ws)), sum(map(text.count, SYMBOLS)), lines, again, repeated_words(ws)


def with_features(docs: DataFrame, host: str | None = "source", carry: list[str] | None = None) -> DataFrame:
    """``row`` (all columns of the table, or those named), ``host``, and a column for each feature."""
    text = F.col("text").cast("string")
    name = F.col(host).cast("string") if host and host in docs.columns else F.lit(None).cast("string")
    row = [F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)] or [F.lit(True).alias("none")]
    given = docs.select(F.struct(*row).alias("row"), name.alias("host"), text.alias("text"))
    out = T.StructType([f for f in given.schema if f.name != "text"] + [T.StructField(f, T.LongType()) for f in FEATURES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # few texts at a time become Python strings
            got = [features_of(t) for at in range(0, b.num_rows, 256) for t in b.column(2).slice(at, 256).to_pylist()]
            got = np.array(got, np.int64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(got[:, i]) for i in range(len(FEATURES)))], names=["row", "host", *FEATURES])

    return given.mapInArrow(run, out)


def base_failed() -> Column:
    """Too short, or too much of it repeated."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def points() -> Column:
    """Failure points: symbols per word, repeated lines, length of words; each 0, 1 or 2."""
    n, s, lines, again, chars = (F.col(c) for c in ("n_words", "n_symbols", "n_lines", "n_dup_lines", "word_chars"))
    grade = lambda one, two: F.when(two, 2).when(one, 1).otherwise(0)
    return (
        grade(20 * s > n, 10 * s > n)
        + grade(10 * again > 3 * lines, 2 * again > lines)
        + grade((chars < 2 * n) | (chars > 12 * n), (chars > 20 * n))
    )


def host_rates(features: DataFrame) -> DataFrame:
    """host, n_docs, n_failed, rate (shrunk), sure (its lower bound) and bad, one row for each host; null is a host of its own."""
    hosts = features.groupBy("host").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum((base_failed() | (points() > 0)).cast("long")).alias("n_failed")
    )
    hosts = staged(hosts, "hosts")
    raw = F.col("n_failed") / F.col("n_docs")
    prior = hosts.agg(
        (F.sum("n_failed") / F.sum("n_docs")).alias("m"), F.var_pop(raw).alias("v"), F.avg(1.0 / F.col("n_docs")).alias("noise")
    )
    m = F.col("m")
    between = F.col("v") - m * (1 - m) * F.col("noise")
    # without a difference between hosts the weight is null: their rates are one
    weight = F.when(between > 0, F.greatest(m * (1 - m) / between - 1, F.lit(PRIOR_WEIGHT)))
    prior = prior.select(m.alias("m"), weight.alias("w"))
    w, mean = prior.select("w").scalar(), prior.select("m").scalar()
    a, n = F.col("n_failed") + mean * w, F.col("n_docs") + w
    rated = hosts.withColumn("rate", F.coalesce(a / n, mean)).withColumn("sure", F.coalesce(a / n - SURE * F.sqrt(a / n * (1 - a / n) / (n + 1)), F.lit(0.0)))
    return staged(rated.withColumn("bad", F.col("sure") > ODDS * mean / (1 + (ODDS - 1) * mean)), "host-rates")


def verdicts(docs: DataFrame, host: str | None = "source", carry: list[str] | None = None) -> DataFrame:
    """``row``, the features, ``base_failed``, ``points``, the host's ``rate`` and ``bad``, and ``kept``.

    ``row`` holds all columns of the table, or those that ``carry`` names. The
    features of narrow rows, without the text, are written once and read again;
    of whole rows they are worked out again, since a second copy of all texts
    would cost more. Null and empty texts have no words and fail; a null host is
    a group of its own; repeated rows are judged alike and all stay; a table
    without the host column is one host; an empty table gives an empty result;
    a text's length is not limited. Columns of any other name travel in ``row``
    untouched.
    """
    narrow = carry is not None and "text" not in carry
    if narrow:
        featured = staged(with_features(docs, host, carry), "features")
        hosts = host_rates(featured)
    else:
        hosts = host_rates(with_features(docs, host, []))
        featured = with_features(docs, host, carry)
    judged = featured.join(hosts.select(F.col("host").alias("h"), "rate", "bad"), F.col("host").eqNullSafe(F.col("h")), "left").drop("h")
    judged = judged.withColumn("base_failed", base_failed()).withColumn("points", points())
    limit = F.when(F.coalesce(F.col("bad"), F.lit(False)), 1).otherwise(2)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("points") < limit))


#: The same in DuckDB's SQL, over the documents table.
SQL = r"""
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
lines AS (SELECT doc_id, i, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines GROUP BY doc_id),
win AS (SELECT doc_id, i, ws[i:i+7] AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM d)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT k) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 8)) AS k FROM rep) GROUP BY doc_id),
f AS (SELECT d.doc_id, host, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id)),
p AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  CASE WHEN 10 * n_symbols > n_words THEN 2 WHEN 20 * n_symbols > n_words THEN 1 ELSE 0 END
  + CASE WHEN 2 * n_dup_lines > n_lines THEN 2 WHEN 10 * n_dup_lines > 3 * n_lines THEN 1 ELSE 0 END
  + CASE WHEN word_chars > 20 * n_words THEN 2 WHEN word_chars < 2 * n_words OR word_chars > 12 * n_words THEN 1 ELSE 0 END AS points FROM f),
hosts AS (SELECT host, count(*) AS n, sum(CASE WHEN base_failed OR points > 0 THEN 1 ELSE 0 END) AS k FROM p GROUP BY host),
mom AS (SELECT sum(k) / sum(n)::DOUBLE AS m, var_pop(k / n::DOUBLE) AS v, avg(1.0::DOUBLE / n) AS noise FROM hosts),
prior AS (SELECT m, CASE WHEN v - m * (1 - m) * noise > 0 THEN greatest(m * (1 - m) / (v - m * (1 - m) * noise) - 1, 1.0) END AS w FROM mom),
post AS (SELECT host, m, n + w AS s, (k + m * w) / (n + w) AS r FROM hosts, prior),
rated AS (SELECT host, coalesce(r - 2.0 * sqrt(r * (1 - r) / (s + 1)), 0.0) > 2.0 * m / (1 + (2.0 - 1) * m) AS bad FROM post)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed AND points < CASE WHEN bad THEN 1 ELSE 2 END) AS kept
FROM p LEFT JOIN rated ON p.host IS NOT DISTINCT FROM rated.host
"""
