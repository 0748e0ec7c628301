"""Toxicity: logistic regression over hashed word n-grams and skip-grams, fitted by FTRL-proximal.

Every coordinate has its own learning rate, by the sum of its squared gradients, and an L1 threshold that holds all but the
telling ones at exactly zero, so the fitted weights are a short list that each task gets whole. The learner runs over blocks
of documents at once: each block is passed through document by document from the same state, and the states are mixed
coordinate by coordinate over the blocks that touched it.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby, islice
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeload.llm.common import small_batches, table
from lakeload.workspace import new_folder

LETTERS = re.compile(r"[^\W\d_]+")
#: Sizes of the two hash spaces: single words, and all longer features together.
WORD_BITS, GRAM_BITS = 20, 18
WORDS_SPACE, SPACE = 1 << WORD_BITS, (1 << WORD_BITS) + (1 << GRAM_BITS)
#: Bounds of the fit: documents of each class that it learns from, documents of a block, passes over them.
SAMPLE_DOCUMENTS, BLOCK_DOCUMENTS, PASSES = 8_000, 1_024, 5
#: Learning rate, smoothing, L1 and L2; features of several words are many, so their L1 is higher.
ALPHA, BETA, L1, GRAM_L1, L2 = 2.0, 1.0, 8.0, 48.0, 1.0
HEAVIEST = 16.0
#: Place of the intercept, behind all features.
INTERCEPT = SPACE
FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
CACHE_WORDS, WORDS_AT_ONCE = 200_000, 1 << 16
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63], "u8")


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


class WordHashes(dict):
    """64-bit hashes of words, kept by the worker up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        made = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return made


HASHES = WordHashes()


def _pairs(h: np.ndarray, distance: int) -> np.ndarray:
    """Places of the pairs of words that lie ``distance`` apart."""
    n = max(0, len(h) - distance)
    mixed = h[:n] * MULTIPLIERS[0] + h[distance:] * MULTIPLIERS[1] + np.uint64(distance) * MULTIPLIERS[2 : 3]
    mixed = (mixed ^ (mixed >> np.uint64(29))) * MULTIPLIERS[3]
    return (mixed >> np.uint64(64 - GRAM_BITS)) + np.uint64(WORDS_SPACE)


def features(text: str | None) -> np.ndarray:
    """The distinct places of a text's words (runs of letters in lower case), of its pairs of neighbours, and of its pairs with
    one or two words between them. A long text is passed through in pieces; each repeats the last words of the one before.
    """
    found = (m[0] for m in LETTERS.finditer(text.lower())) if text else iter(())
    carried, places = np.empty(0, "u8"), np.empty(0, "i4")
    while words := list(islice(found, WORDS_AT_ONCE)):
        h = np.fromiter(map(HASHES.__getitem__, words), "u8", len(words))
        h = np.concatenate([carried, h])
        new = np.concatenate([h >> np.uint64(64 - WORD_BITS), *(_pairs(h, k) for k in (1, 2, 3))]).astype("i4")
        places = np.unique(np.concatenate([places, new]) if len(places) else new)
        carried = h[-3:]
    return places


def weights(z: np.ndarray, n: np.ndarray, l1: np.ndarray) -> np.ndarray:
    """The weights that a state stands for: zero wherever the sum of gradients stays within L1."""
    w = -(z - np.copysign(l1, z)) / ((BETA + np.sqrt(n)) / ALPHA + L2)
    return np.where(np.abs(z) <= l1, 0.0, w)


def penalties() -> np.ndarray:
    return np.repeat([L1, GRAM_L1, 0.0], [WORDS_SPACE, SPACE - WORDS_SPACE, 1])


def sigmoid(x: float) -> float:
    return float(1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0))))


def learn_block(z: np.ndarray, n: np.ndarray, documents: Iterator[tuple[np.ndarray, int, float]]) -> None:
    """FTRL-proximal, document by document; changes ``z`` and ``n``. A document is its places, label and weight."""
    l1 = penalties()
    for places, label, heft in documents:
        x = np.append(places, INTERCEPT)
        zx, nx = z[x], n[x]
        w = weights(zx, nx, l1[x])
        gradient = (sigmoid(w.sum()) - label) * heft
        grown = nx + gradient * gradient
        z[x] = zx + gradient - (np.sqrt(grown) - np.sqrt(nx)) / ALPHA * w
        n[x] = grown


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):  # one at a time: the places of a text can be as large as the text
            text = batch.column("text")[row].as_py()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("label").slice(row, 1),
                    batch.column("place").slice(row, 1),
                    pa.array([features(text).tobytes()], pa.binary()),
                ],
                ["label", "place", "features"],
            )


def _pass(shared, heft: float):
    """Runs over the rows of each block from the shared state and returns by how much the state changed."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            columns = batch.column("features"), batch.column("label").to_pylist(), batch.column("block").to_pylist()
            for places, label, block in zip(*columns, strict=True):
                yield np.frombuffer(places.as_buffer(), "i4"), label, heft if label else 1.0, block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = shared.value
        for block, rows in groupby(documents(batches), key=itemgetter(3)):
            z, n = state.astype("f8")
            learn_block(z, n, (row[:3] for row in rows))
            touched = np.flatnonzero(n > state[1])
            change = (np.stack([z[touched], n[touched]]) - state[:, touched]).astype("f4")
            made = {"block": pa.array([block], pa.int32()), "places": [touched.astype("i4").tobytes()]}
            yield pa.RecordBatch.from_pydict(made | {"change": [change.tobytes()]})

    return run


def mix(state: np.ndarray, changes: list[tuple[bytes, bytes]]) -> np.ndarray:
    """The state after a pass: each coordinate changed by the mean over the blocks that touched it. A block tells the places
    that it touched and by how much each row of the state changed there."""
    total, touched = np.zeros(state.shape), np.zeros(state.shape[1])
    for places, change in changes:
        places = np.frombuffer(places, "i4")
        total[:, places] += np.frombuffer(change, "f4").reshape(2, -1)
        touched[places] += 1
    return (state + total / np.maximum(touched, 1)).astype("f4")


def learnable_labels(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, label) of the labelled documents outside the held-out fold; where labels of a doc_id differ it has none."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    one = known.groupBy("doc_id").agg(F.min("toxic").alias("label"), F.max("toxic").alias("other"))
    return one.where("label = other").where(fold(F.col("doc_id")) != HELD_OUT).select("doc_id", "label")


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCUMENTS) -> tuple[np.ndarray, np.ndarray, float]:
    """Fitted weights as places, their weights (none is zero), and the intercept.

    ``documents`` has doc_id and text, ``labels`` doc_id and toxic. Learnt from is a share of each class drawn by hash, about
    ``sample`` documents at most; of rows with one doc_id the one with the least text. The rarer class weighs as much as the
    other in all, at most HEAVIEST times a document, so a score of one half doesn't mean a probability of one half. Without a
    label the weights are none and the intercept is 0.
    """
    spark = documents.sparkSession
    small_batches(spark)
    known = learnable_labels(documents, labels)
    sizes = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    none = np.empty(0, "i4"), np.empty(0, "f4"), 0.0
    if not sizes:
        return none
    share = F.lit(0)
    for label, n in sizes.items():
        share = F.when(F.col("label") == label, int(min(1.0, sample / n) * 1_000_000)).otherwise(share)
    drawn = known.where(F.expr("pmod(xxhash64(doc_id, 11), 1000000)") < share)
    taken = sum(min(sample, n) for n in sizes.values())
    blocks = -(-taken // BLOCK_DOCUMENTS)
    picked = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    picked = picked.join(F.broadcast(drawn), "doc_id")  # about 2 * sample rows of two numbers at most
    picked = picked.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    place = F.xxhash64("doc_id", F.lit(13))
    made = picked.select("label", place.alias("place"), "text").mapInArrow(
        _featurise, "label int, place long, features binary"
    )
    folder = new_folder(spark, "toxicity-features")
    block = F.expr(f"CAST(pmod(place, {blocks}) AS INT)").alias("block")
    dealt = made.select("*", block).repartition(blocks, "block").sortWithinPartitions("block", "place")
    dealt.write.partitionBy("block").parquet(folder)
    staged = spark.read.schema("label int, place long, features binary, block int").parquet(folder)
    met = {r.label: r.n for r in staged.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not met:
        return none
    heft = min(HEAVIEST, max(1.0, met.get(0, 0) / max(met.get(1, 0), 1)))
    state = np.zeros((2, SPACE + 1), "f4")
    for _ in range(PASSES):
        shared = spark.sparkContext.broadcast(state)
        # one row for each block: at most 2 * sample / BLOCK_DOCUMENTS + 1 parts of a state of fixed size
        changes = staged.mapInArrow(_pass(shared, heft), "block int, places binary, change binary").collect()
        changes.sort(key=lambda r: r.block)
        state = mix(state, [(r.places, r.change) for r in changes])
        del changes
        shared.destroy()
    w = weights(*state.astype("f8"), penalties())
    places = np.flatnonzero(w[:SPACE]).astype("i4")
    return places, w[places].astype("f4"), float(w[INTERCEPT])


@lru_cache(maxsize=1)
def _dense(key: str, shared) -> tuple[np.ndarray, float]:
    places, values, intercept = shared.value
    dense = np.zeros(SPACE, "f4")
    dense[places] = values
    return dense, intercept


def scorer(spark: SparkSession, model: tuple[np.ndarray, np.ndarray, float]):
    """A function of a text column: its score. What it sends to the tasks is the short list of weights."""
    shared = spark.sparkContext.broadcast(model)
    key = uuid.uuid4().hex

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        dense, intercept = _dense(key, shared)
        return pd.Series([sigmoid(dense[features(t)].sum(dtype="f8") + intercept) for t in texts], dtype="f8")

    return score


def judge(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``documents``, learnt from ``labels`` of the rows not held out.

    The fold is crc32 of the doc_id's text modulo 3; 1 is held out. A null doc_id is in no fold: not learnt from, not held
    out. A null or empty text, or one without a letter, has the score of the intercept alone. Without labels every score is
    0.5. Repeated rows have equal scores; other columns are left out.
    """
    score = scorer(documents.sparkSession, fit(documents, labels))
    held = F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out")
    scored = documents.select("doc_id", held, score("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op11_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return judge(table(spark, sf, "documents"), table(spark, sf, "labels"))
