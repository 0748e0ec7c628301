"""Word-first language identification: known words by log frequency, unseen ones by ever shorter character runs.

The model holds, per language, the log frequency of its frequent words and of its frequent character runs of one to five
letters. A word of the model is scored as a word. Any other is scored by its runs of five letters that the model knows, or
without any by those of four, and so on. The language with the largest sum wins.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeload.llm.common import small_batches, table
from lakeload.workspace import stage

LETTERS = re.compile(r"[^\W\d_]+")
LONGEST = 5
#: Bounds of the model: documents it is fitted on, entries in all, letters of an entry; and of a worker's cache of words.
SAMPLE_DOCUMENTS, MODEL_ENTRIES, ENTRY_CHARS, CACHE_WORDS = 20_000, 200_000, 32, 200_000
#: Values that a hash is reduced to when a share of rows is drawn by it: fine enough for any number of rows.
HASHES = 1 << 53
UNKNOWN = "und"
FOLDS, HELD_OUT = 4, 2


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def runs(word: str, n: int) -> list[str]:
    """The runs of ``n`` characters of a word; its ends count as one character each for runs of two or more."""
    if n == 1:
        return list(word)
    marked = f"<{word}>"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


GRAMS = T.StructType(
    [
        T.StructField("lang", T.StringType()),
        T.StructField("kind", T.IntegerType()),
        T.StructField("gram", T.StringType()),
        T.StructField("n", T.LongType()),
    ]
)


def _count_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for lang, texts in batch.groupby("lang")["text"]:
            words = Counter()
            for text in texts:
                words.update(LETTERS.findall(text.lower()))
            grams: dict[tuple[int, str], int] = {}
            for word, k in words.items():
                if len(word) <= ENTRY_CHARS:
                    grams[0, word] = k
                for n in range(1, LONGEST + 1):
                    for g in runs(word, n):
                        grams[n, g] = grams.get((n, g), 0) + k
            rows = [(lang, kind, gram, k) for (kind, gram), k in grams.items()]
            yield pd.DataFrame(rows, columns=["lang", "kind", "gram", "n"])


def level(sizes: list[int], total: int) -> float:
    """The largest number of rows for each language, of which none has more than it has, that add up to ``total``."""
    left = sorted(sizes)
    while left and left[0] <= total / len(left):
        total -= left.pop(0)
    return total / len(left) if left else float("inf")


def draw(labelled: DataFrame, sample: int) -> DataFrame:
    """Some ``sample`` rows, drawn by hash of the doc_id and alike from every language; all rows of the rare ones."""
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    most = level(list(sizes.values()), sample)
    shares = [(lang, int(min(1.0, most / n) * HASHES)) for lang, n in sizes.items()]
    shares = labelled.sparkSession.createDataFrame(shares, "lang string, share long")
    place = F.xxhash64("doc_id", F.lit(7)).bitwiseAND(F.lit(HASHES - 1))
    return labelled.join(shares, "lang").where(place < F.col("share")).select("text", "lang")


def learn(labelled: DataFrame, sample: int = SAMPLE_DOCUMENTS, entries: int = MODEL_ENTRIES) -> tuple[list[str], dict]:
    """The languages and, by (kind, gram), the log frequency in each: kind 0 for words, else the length of the run.

    ``labelled`` has doc_id, text and lang without nulls. Of more than ``sample`` rows so many are drawn, by language, and
    of the grams the most frequent of each language and kind are kept, so that the model has ``entries`` entries at most.
    Where grams of one count don't all fit none of them is kept, unless nothing else would be: then a share, by hash.
    """
    labelled = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang")
    drawn = stage(draw(labelled, sample).mapInPandas(_count_grams, GRAMS), "gram-counts")
    counts = drawn.groupBy("lang", "kind", "gram").agg(F.sum("n").alias("n"))
    counts = stage(counts, "language-grams")
    langs = counts.select("lang").distinct().count()
    if not langs:
        return [], {}
    most = max(1, entries // (langs * (LONGEST + 1)))
    # few different counts stand for very many grams, so nothing is ranked gram by gram
    alike = counts.groupBy("lang", "kind", "n").agg(F.count("*").alias("grams"))
    down = Window.partitionBy("lang", "kind").orderBy(F.col("n").desc())
    summed = alike.withColumn("upto", F.sum("grams").over(down))
    fits = F.col("upto") <= most
    cuts = summed.groupBy("lang", "kind").agg(
        F.sum(F.col("n") * F.col("grams")).alias("all"),
        F.min(F.when(fits, F.col("n"))).alias("cut"),
        F.max("n").alias("top"),
        F.min("upto").alias("first"),
    )
    share = (F.lit(most / 2 * HASHES) / F.col("first")).cast("long")
    drawn_by_hash = F.xxhash64("gram").bitwiseAND(F.lit(HASHES - 1)) < F.greatest(share, F.lit(1))
    kept = (F.col("n") >= F.col("cut")) | (F.col("cut").isNull() & (F.col("n") == F.col("top")) & drawn_by_hash)
    found = counts.join(cuts, ["lang", "kind"]).where(kept).select("lang", "kind", "gram", "n", "all").collect()
    names = sorted({r.lang for r in found}, key=lambda x: [*map(ord, x)])
    place = {name: i for i, name in enumerate(names)}
    sums = {(r.lang, r.kind): r["all"] for r in found}
    floors = [np.array([-np.log(sums.get((x, kind), 1) + 2.0) for x in names]) for kind in range(LONGEST + 1)]
    model: dict[tuple[int, str], np.ndarray] = {}
    for r in found:
        row = model.get((r.kind, r.gram))
        if row is None:
            row = model[r.kind, r.gram] = floors[r.kind].copy()
        row[place[r.lang]] = np.log(r.n + 1.0) - np.log(r["all"] + 2.0)
    return names, {key: row.astype("f4") for key, row in model.items()}


class Scorer(dict):
    """Place of a word's scores in a table that grows as words are met, up to a bound."""

    def __init__(self, names: list[str], model: dict):
        self.names = names
        self.known: list[dict[str, np.ndarray]] = [{} for _ in range(LONGEST + 1)]
        for (kind, gram), row in model.items():
            self.known[kind][gram] = row
        self.nothing = np.zeros(len(names), "f4")
        self.table = np.zeros((1024, len(names)), "f4")

    def word(self, word: str) -> np.ndarray:
        found = self.known[0].get(word)
        if found is not None:
            return found
        for n in range(LONGEST, 0, -1):
            get = self.known[n].get
            rows = [row for g in runs(word, n) if (row := get(g)) is not None]
            if rows:
                return sum(rows) / len(rows)
        return self.nothing

    def __missing__(self, word: str) -> int:
        place = len(self)
        if place == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[place] = self.word(word)
        self[word] = place
        return place

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language with the largest sum over all words, and its share of the likelihood of all languages."""
        words = Counter(LETTERS.findall(text.lower())) if text else {}
        if not words or not self.names:
            return UNKNOWN, 0.0
        if len(self) > CACHE_WORDS:
            self.clear()
        places = [self[w] for w in words]
        total = np.array(list(words.values()), "f8") @ self.table[places]
        odds = np.exp(total - total.max())
        best = int(total.argmax())  # of equal ones the first by code point
        return self.names[best], float(odds[best] / odds.sum())


@lru_cache(maxsize=1)
def _scorer(key: int, shared) -> Scorer:
    return Scorer(*shared.value)


def predictor(spark: SparkSession, names: list[str], model: dict):
    """A function of a text column: struct of lang_pred and score. The model it sends to the tasks has bounded size."""
    shared = spark.sparkContext.broadcast((names, model))
    key = id(shared)

    @F.pandas_udf(
        T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    )
    def predict(texts: pd.Series) -> pd.DataFrame:
        scorer = _scorer(key, shared)
        return pd.DataFrame([scorer.predict(t) for t in texts], columns=["lang_pred", "score"])

    return predict


def identify(documents: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) per row, learnt from the rows that are not held out and have a lang.

    The fold is crc32 of the doc_id's text modulo 4; 2 is held out. A null doc_id is in no fold: not learnt from, not held
    out. ``und`` with score 0 is the answer for a null text, one without a letter, or if nothing could be learnt.
    """
    small_batches(documents.sparkSession)
    learnable = documents.where(fold(F.col("doc_id")) != HELD_OUT).select("doc_id", "text", "lang")
    names, model = learn(learnable)
    predict = predictor(documents.sparkSession, names, model)
    held = F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out")
    return documents.select("doc_id", held, predict("text").alias("p")).select(
        "doc_id", "held_out", "p.lang_pred", "p.score"
    )


def op9_language_id(spark: SparkSession, sf: str) -> DataFrame:
    return identify(table(spark, sf, "documents"))
