"""Substring deduplication by sliding spans of consecutive sentences.

Every sentence starts a span: the shortest run of sentences from it on that has ``SENTENCES`` sentences and ``WORDS`` words,
or ``LONG`` words in fewer sentences. With ``both`` every sentence ends one, too: the shortest such run up to it. Then each
sentence of a repeated run of that size is in a repeated span, and the run goes whole; the query asks for that. Spans are
hashed and met over the whole corpus. A sentence covered by a repeated span goes, unless the span is the first of its kind
by doc_id and place. A removed sentence is always still found at an earlier place, so no content is lost.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeload.llm.common import small_batches, table, text_tag
from lakeload.workspace import stage

SENTENCES, WORDS, LONG = 3, 16, 40
#: Where a sentence ends, with the blanks after it: end marks before a blank, or a line's end.
_END = re.compile(r"[.!?…]+[\"'”’)\]]*\s+|[。！？]+\s*|\s*\n\s*")


def sentences(text: str) -> list[str]:
    """The text in sentences; joined they give the text."""
    ends = [m.end() for m in _END.finditer(text)]
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    return [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _shortest(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the shortest spans from each sentence on, of the numbers of words; runs that never get there have none."""
    upto = np.concatenate([[0], np.cumsum(words)])
    several = np.maximum(np.searchsorted(upto, upto[:-1] + WORDS), np.arange(len(words)) + SENTENCES)
    ends = np.minimum(several, np.searchsorted(upto, upto[:-1] + LONG))
    ends = ends[ends <= len(words)]
    return np.arange(len(ends)), ends


def spans(parts: list[str], both: bool) -> list[tuple[int, int]]:
    """Of each span its first sentence and the number of the sentence after it, in order."""
    words = np.fromiter((len(p.split()) for p in parts), "i8", len(parts))
    starts, ends = _shortest(words)
    found = list(zip(starts.tolist(), ends.tolist(), strict=True))
    if both:
        starts, ends = (len(parts) - at for at in _shortest(words[::-1]))  # counted from the end
        found = sorted({*found, *zip(ends.tolist(), starts.tolist(), strict=True)})
    return found


def hashed_spans(text: str | None, both: bool) -> np.ndarray:
    """XXH64 of the words of every span in lower case, as signed longs."""
    parts = sentences(text or "")
    plain = [" ".join(p.lower().split()) for p in parts]
    found = (xxhash.xxh64_intdigest(" ".join(plain[i:e])) for i, e in spans(parts, both))
    return np.fromiter(found, "u8").view("i8")


CLEAN = T.StructType(
    [
        T.StructField("clean", T.StringType()),
        T.StructField("n_sentences", T.LongType()),
        T.StructField("n_removed", T.LongType()),
    ]
)


def _spans(both: bool):
    @F.pandas_udf(T.ArrayType(T.LongType()))
    def hashes(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: hashed_spans(t, both))

    return hashes


def without_spans(text: str | None, repeated: Iterable[int], both: bool) -> tuple[str | None, int, int]:
    """The text without the sentences of the spans numbered in ``repeated``; its sentences and how many of them went."""
    parts = sentences(text or "")
    gone = np.zeros(len(parts), bool)
    all_spans = spans(parts, both) if len(repeated) else ()
    for i in repeated:
        gone[slice(*all_spans[i])] = True
    if not gone.any():
        return text, len(parts), 0
    left = "".join(p for p, g in zip(parts, gone, strict=True) if not g)
    return left.rstrip(), len(parts), int(gone.sum())


def _without(both: bool):
    @F.pandas_udf(CLEAN)
    def cleaned(texts: pd.Series, repeated: pd.Series) -> pd.DataFrame:
        rows = [without_spans(t, () if r is None else r, both) for t, r in zip(texts, repeated, strict=True)]
        return pd.DataFrame(rows, columns=CLEAN.names)

    return cleaned


def repeated_spans(documents: DataFrame, both: bool = False) -> DataFrame:
    """(doc_id, tag, repeated), the numbers of their spans, of the rows that hold a repeated span which isn't the first of its kind.

    Only hashes and places are shuffled. Spans are counted with map-side sums; a span that very many documents share is one
    row on one side of the join, and the other side is split.
    """
    small_batches(documents.sparkSession)
    found = documents.select("doc_id", text_tag("text").alias("tag"), F.posexplode(_spans(both)("text")).alias("pos", "h"))
    found = stage(found, "spans")
    known = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "tag", "pos")
    shared = found.groupBy("h").agg(F.count("*").alias("n"), F.min(known).alias("first")).where("n > 1")
    shared = stage(shared.select("h", "first"), "span-firsts")  # a join on top of its own grouping can't be split
    later = found.join(shared, "h").where(
        "NOT (doc_id <=> first.doc_id AND tag = first.tag AND pos = first.pos)"
    )
    return later.groupBy("doc_id", "tag").agg(F.collect_set("pos").alias("repeated"))  # at most twice a text's sentences


def without_repeats(documents: DataFrame, both: bool = False) -> DataFrame:
    """(d, clean, n_sentences, n_removed): each row as a struct, and its text without repeated spans."""
    later = stage(repeated_spans(documents, both), "span-repeats").alias("j")
    named = documents.select(F.struct(*(F.col(f"`{n}`") for n in documents.columns)).alias("d"), F.col("doc_id").alias("id"))
    named = named.select("d", "id", text_tag(F.col("d.text")).alias("of")).alias("n")
    joined = named.join(later, F.expr("n.of = j.tag AND n.id <=> j.doc_id"), "left")
    return joined.select("d", _without(both)(F.col("d.text"), F.col("j.repeated")).alias("q")).select("d", "q.*")


def drop_repeats(documents: DataFrame, both: bool = False) -> DataFrame:
    """``documents`` with repeated runs taken out of ``text`` (``n_chars`` set anew); a text left without words goes.

    A text that had no word to begin with stays. Equal rows are one document and share one result; a null doc_id comes last
    in the order that tells the first span. All columns are kept, whatever their names.
    """
    changed = {"text": F.col("clean"), "n_chars": F.length("clean").cast("long")}
    left = without_repeats(documents, both).where("n_removed = 0 OR clean <> ''")
    return left.select(*(changed.get(n, F.col(f"d.`{n}`")).alias(n) for n in documents.columns))


def op8_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    cleaned = without_repeats(table(spark, sf, "documents").select("doc_id", "text"), both=True)
    return cleaned.select("d.doc_id", F.col("clean").alias("text"), "n_sentences", "n_removed")
