"""Line-first cleaning: lines are judged first, failing ones go, and a document that loses too much goes with them."""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeload.llm.common import small_batches, table, word_blocks

BLANKS = " \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"
SEPARATORS = "|»›•·"
#: Phrases of page furniture; a line with one of them is no prose.
BOILERPLATE = (
    "all rights reserved",
    "cookie policy",
    "enable javascript",
    "lorem ipsum",
    "privacy policy",
    "terms of service",
    "terms of use",
    "use of cookies",
    "uses cookies",
)
_BOILERPLATE = re.compile("|".join(BOILERPLATE))
#: A document fails with fewer words, a larger share of repeated words, or a larger share of words lost with its lines.
MIN_WORDS, MAX_REPEAT, MAX_LOSS = 10, 20, 30
WINDOW = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lost_words")
STATS = T.StructType([T.StructField(n, T.LongType()) for n in COUNTS])
CLEANED = T.StructType([*STATS.fields, T.StructField("clean", T.StringType())])


def line_fails(line: str) -> bool:
    """Whether a line that has a word breaks a rule.

    Punctuation: as many symbols or runs of two or more exclamation marks as words (three at least), or fewer than half its
    characters are letters or digits. Navigation: three or more separators, one for every three words at least.
    Boilerplate: one of the phrases.
    """
    n = len(line.encode().split())
    symbols = sum(map(line.count, SYMBOLS)) // 2 + line.count("!!")
    if symbols >= 3 and symbols >= n:
        return True
    separators = sum(map(line.count, SEPARATORS))
    if separators >= 3 and 3 * separators >= n:
        return True
    marks = sum(map(line.count, BLANKS))
    if 2 * sum(map(str.isalnum, line)) < len(line) - marks:
        return True
    return bool(_BOILERPLATE.search(line.lower()))


def repeated_words(blocks: Iterable[list[bytes]], n: int = WINDOW) -> int:
    """Words that lie in a run of ``n`` words which the text holds twice or more. Exact: runs are numbered, not hashed."""
    numbers: dict[bytes, int] = {}
    ids = np.concatenate([np.empty(0, "i8"), *(_numbered(block, numbers) for block in blocks)])
    if len(ids) <= n:
        return 0
    runs, width = ids, 1
    while width < n:  # runs of 2w words out of two of w, the last step by fewer
        step = min(width, n - width)
        size = len(ids) - width - step + 1
        runs = np.unique(runs[:size] * len(ids) + runs[step : step + size], return_inverse=True)[1].astype("i8")
        width += step
    twice = np.bincount(runs)[runs] > 1
    if not twice.any():
        return 0
    covered = np.zeros(len(ids) + 1, "i8")
    np.add.at(covered, np.flatnonzero(twice), 1)
    np.add.at(covered, np.flatnonzero(twice) + n, -1)
    return int((np.cumsum(covered[:-1]) > 0).sum())


def _numbered(block: list[bytes], numbers: dict[bytes, int]) -> np.ndarray:
    return np.fromiter((numbers.setdefault(w, len(numbers)) for w in block), "i8", len(block))


def measure(text: str) -> tuple[int, int, int, int, int, int, str]:
    """The counts of a text, the words its failing lines hold, and the text without those lines."""
    words, kept, seen, repeated, lost = 0, [], set(), 0, 0
    for line in text.split("\n"):
        if not line.strip(BLANKS):
            kept.append(line)
            continue
        n = len(line.encode().split())
        words += n
        repeated += line in seen
        seen.add(line)
        if line_fails(line):
            lost += n
        else:
            kept.append(line)
    return (
        words,
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        repeated,
        repeated_words(word_blocks(text.encode())),
        lost,
        "\n".join(kept),
    )


@F.pandas_udf(CLEANED)
def _measured(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure(t or "") for t in texts], columns=[*COUNTS, "clean"])


@F.pandas_udf(STATS)
def _counted(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure(t or "")[:-1] for t in texts], columns=COUNTS)


BASE_FAILED = f"q.n_words < {MIN_WORDS} OR 100 * q.n_repeat_words > {MAX_REPEAT} * q.n_words"
KEPT = f"NOT ({BASE_FAILED}) AND 100 * q.n_lost_words <= {MAX_LOSS} * q.n_words"


def quality_stats(documents: DataFrame) -> DataFrame:
    """Per row: doc_id, the counts, base_failed and kept. A null text has no words and fails; rows are judged alone."""
    small_batches(documents.sparkSession)
    judged = documents.select("doc_id", _counted("text").alias("q"))
    return judged.select("doc_id", "q.*", F.expr(BASE_FAILED).alias("base_failed"), F.expr(KEPT).alias("kept"))


def clean_documents(documents: DataFrame) -> DataFrame:
    """The rows that pass, with their failing lines taken out of ``text`` (and ``n_chars`` set anew where there is one).

    Every column is kept, whatever its name. Repeated rows are judged alike; an empty table gives an empty table.
    """
    small_batches(documents.sparkSession)
    names = documents.columns
    judged = documents.select(F.struct(*(F.col(f"`{n}`") for n in names)).alias("d"), _measured("text").alias("q"))
    changed = {"text": F.col("q.clean"), "n_chars": F.length("q.clean").cast("long")}
    return judged.where(KEPT).select(*(changed.get(n, F.col(f"d.`{n}`")).alias(n) for n in names))


def op3_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality_stats(table(spark, sf, "documents"))


SQL3 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
parts AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM d),
l AS (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS nr FROM parts),
m AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
    (length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g'))) // 2
        + (length(line) - length(replace(line, '!!', ''))) // 2 AS symbols,
    length(line) - length(regexp_replace(line, '[|»›•·]', '', 'g')) AS seps,
    length(line) - length(regexp_replace(line, '[\p{L}\p{N}]', '', 'g')) AS plain,
    length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars FROM l),
j AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY nr) AS nth,
    (symbols >= 3 AND symbols >= n) OR (seps >= 3 AND 3 * seps >= n) OR 2 * plain < chars OR regexp_matches(lower(line),
        'all rights reserved|cookie policy|enable javascript|lorem ipsum|privacy policy|terms of service|terms of use|'
        || 'use of cookies|uses cookies') AS fails FROM m WHERE n > 0),
lines AS (SELECT doc_id, sum(CASE WHEN nth > 1 THEN 1 ELSE 0 END) AS dups, sum(CASE WHEN fails THEN n ELSE 0 END) AS lost
    FROM j GROUP BY doc_id),
p AS (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS pos FROM w),
g AS (SELECT doc_id, pos, array_to_string(words[pos:pos + 4], ' ') AS gram, len(words) AS n FROM p),
r AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, gram) AS k FROM g WHERE pos + 4 <= n),
c AS (SELECT doc_id, count(DISTINCT spot) AS covered
    FROM (SELECT doc_id, unnest(range(pos, pos + 5)) AS spot FROM r WHERE k > 1) GROUP BY doc_id),
q AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dups, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(lost, 0) AS BIGINT) AS n_lost_words
    FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN c USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * n_lost_words <= 30 * n_words AS kept FROM q
"""
