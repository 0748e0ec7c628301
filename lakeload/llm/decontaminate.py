"""Benchmark decontamination by latent semantic retrieval.

Texts are cut into overlapping passages of words, weighted by TF-IDF over the terms of the benchmark, and projected on the
leading right singular vectors of a passage matrix, found by a randomised SVD whose products are summed up over tasks. A
passage with a large cosine to a benchmark item is a candidate. Candidates are settled by the longest common subsequence of
words, and doubtful ones, such as paraphrases, by whether the answer (the item's last sentence) is there too. An item of
more than LONG_ITEM words is searched in overlapping pieces, each settled by its own length, so that a passage copied from
a long item is found although it is a small share of the whole.

All passages of all texts are searched, in one pass without a shuffle. The singular vectors are an index: they are fitted on
the items and on all passages of all documents. Document frequencies are counted over all documents too. Both read the terms
of the texts, which are hashed and staged once.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeload.llm.common import small_batches, table, text_tag
from lakeload.workspace import stage

#: A passage is two blocks of words; passages overlap by one block.
BLOCK = 32
#: Hashed terms; singular vectors beyond one for each item, and more that help to find them; rounds of refinement.
TERMS, RANK, SPARE, ROUNDS = 1 << 17, 56, 8, 1
#: Tasks of a product of the SVD for each core, for each task has a sum of its own; numbers of a sum that are sent at once;
#: passages that are multiplied at once.
FIT_TASKS, PART, STRETCH = 4, 1 << 14, 16
#: Terms in a larger share of the documents weigh nothing, unless an item would have fewer terms left; least cosine of a
#: candidate.
COMMON, LEAST_TERMS, COSINE = 0.3, 8, 0.08
#: Share of an item's words in order that settles it; the share that leaves it to the answer; the answer's own share.
SURE, DOUBTFUL, ANSWERED = 0.7, 0.5, 0.9
ANSWER_WORDS = 3
#: Items of more words are cut into pieces of PIECE words, one from each BLOCK words on.
LONG_ITEM, PIECE = 4 * BLOCK, 2 * BLOCK
#: Items fetched at once; pieces and words of one index, and indexes searched in one pass: an index is at most INDEX_WORDS
#: times INDEXED numbers, a product of the SVD at most INDEX_WORDS times some more. Words handled at once.
ITEMS, INDEXED, INDEX_WORDS, INDEXES, WORDS_AT_ONCE = 2000, 400, 16_000, 4, 200_000
SEED = 7

_MARKS = bytes(b if chr(b).isalnum() or b >= 128 else 32 for b in range(256))
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|\n+")


def words_of(text: str | None) -> list[bytes]:
    """Words in lower case, without punctuation."""
    return (text or "").lower().encode().translate(_MARKS).split()


def terms_of(words: list[bytes]) -> np.ndarray:
    """Numbers of the words' terms, a hash of each."""
    return (np.fromiter(map(zlib.crc32, words), "u4", len(words)) & (TERMS - 1)).astype("i4")


def common_words(mine: dict[bytes, int], size: int, words: list[bytes]) -> int:
    """Length of the longest common subsequence of the item with bit masks ``mine`` and the words, bit by bit at once."""
    full = (1 << size) - 1
    row = full
    for word in words:
        if mask := mine.get(word):
            hit = row & mask
            row = ((row + hit) | (row - hit)) & full
    return size - row.bit_count()


def _masks(words: list[bytes]) -> dict[bytes, int]:
    masks: dict[bytes, int] = {}
    for i, word in enumerate(words):
        masks[word] = masks.get(word, 0) | 1 << i
    return masks


@dataclass
class Item:
    """A benchmark item, or a piece of a long one; the pieces of an item share its ``number``."""

    item_id: int | None
    words: list[bytes]
    answer: list[bytes]
    number: int = 0

    def __post_init__(self):
        self.masks, self.answer_masks = _masks(self.words), _masks(self.answer)

    def settle(self, words: list[bytes]) -> tuple[float, float, bool]:
        """Share of the item's and of its answer's words that the passage has in order; whether it holds the item."""
        overlap = common_words(self.masks, len(self.words), words) / len(self.words)
        if overlap < DOUBTFUL:
            return overlap, 0.0, False
        answered = common_words(self.answer_masks, len(self.answer), words) / max(1, len(self.answer))
        paraphrase = len(self.answer) >= ANSWER_WORDS and answered >= ANSWERED
        return overlap, answered, overlap >= SURE or paraphrase


def item_of(item_id: int | None, text: str | None) -> Item | None:
    words = words_of(text)
    if not words:
        return None
    parts = [w for w in map(words_of, _SENTENCE.split(text)) if len(w) >= ANSWER_WORDS]
    return Item(item_id, words, parts[-1] if len(parts) > 1 else [])


def pieces(item: Item) -> list[Item]:
    """The item itself, or overlapping pieces of a long one; the last piece ends where the item does.

    Every run of PIECE + BLOCK - 1 words of the item holds a piece. Only the piece that ends the item has its answer.
    """
    if len(item.words) <= LONG_ITEM:
        return [item]
    last = len(item.words) - PIECE
    starts = [*range(0, last, BLOCK), last]
    return [
        Item(item.item_id, item.words[i : i + PIECE], item.answer if i == last else [], item.number) for i in starts
    ]


def grouped(items: list[Item]) -> list[list[Item]]:
    """The items, or their pieces, in groups for one index each."""
    groups: list[list[Item]] = []
    words = 0
    for piece in (p for item in items for p in pieces(item)):
        words += len(piece.words)
        if not groups or len(groups[-1]) == INDEXED or words > INDEX_WORDS:
            groups.append([])
            words = len(piece.words)
        groups[-1].append(piece)
    return groups


# Weights ---------------------------------------------------------------------------------------------------------------

HASHED = T.StructType([T.StructField("terms", T.BinaryType())])
FREQUENCY = T.StructType([T.StructField("term", T.IntegerType()), T.StructField("n", T.LongType())])


def _hash_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"terms": [terms_of(words_of(text)).tobytes() for text in batch["text"]]})


def hashed_texts(documents: DataFrame) -> DataFrame:
    """The terms of each document, staged: all documents are read several times by them."""
    return stage(documents.select("text").mapInPandas(_hash_texts, HASHED), "hashed-texts")


def _count_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen = np.zeros(TERMS, "i8")
    for batch in batches:
        for terms in batch["terms"]:
            seen[np.frombuffer(terms, "i4")] += 1  # once for a term, however often it is named
    found = np.flatnonzero(seen)
    yield pd.DataFrame({"term": found.astype("i4"), "n": seen[found]})


def inverse_frequencies(hashed: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Weight of each hashed term from its number of documents, over all documents, and which terms are common."""
    rows = max(hashed.count(), 1)
    found = hashed.mapInPandas(_count_terms, FREQUENCY).groupBy("term").agg(F.sum("n").alias("n"))
    known = found.toArrow()  # at most TERMS rows
    counts = np.zeros(TERMS, "f8")
    counts[known["term"].to_numpy()] = known["n"].to_numpy()
    return np.log1p(rows / np.maximum(counts, 1.0)).astype("f4"), counts > COMMON * rows


def item_weights(own: list[np.ndarray], weights: np.ndarray, common: np.ndarray) -> np.ndarray:
    """``weights`` without common terms, but for those of items that are made of them, such as one found everywhere."""
    out = np.where(common, 0, weights).astype("f4")
    for terms in own:
        if np.count_nonzero(out[np.unique(terms)]) < LEAST_TERMS:
            out[terms] = weights[terms]
    return out


@dataclass
class Passages:
    """Passages of several texts: rows of a sparse matrix over the benchmark's terms, and their full norms."""

    text: np.ndarray  # of a passage: the text it is from, by number
    block: np.ndarray  # and its first block
    row: np.ndarray  # of an entry: its passage
    column: np.ndarray
    value: np.ndarray
    norm: np.ndarray


def passages(texts: list[np.ndarray], weights: np.ndarray, column: np.ndarray) -> Passages:
    """``texts``: term numbers. ``column``: of each term its place among the benchmark's terms, or -1."""
    sizes = np.array([len(t) for t in texts], "i8")
    blocks = -(-sizes // BLOCK)
    count = np.maximum(blocks - 1, np.minimum(blocks, 1))  # passages of a text
    first = np.concatenate([[0], np.cumsum(count)])
    term = np.concatenate(texts) if texts else np.empty(0, "i4")
    heavy = np.flatnonzero(weights[term] > 0)
    term, owner = term[heavy], np.repeat(np.arange(len(texts)), sizes)[heavy]
    block = (heavy - (np.cumsum(sizes) - sizes)[owner]) // BLOCK
    # each block is the second half of the passage before it and the first half of its own
    late, early = block >= 1, block < count[owner]
    kind = np.dtype("i4" if (first[-1] + 1) * TERMS <= 1 << 31 else "i8")  # the shorter, the sooner sorted
    key = ((first[owner] + block) * TERMS).astype(kind) + term.astype(kind)
    key, times = np.unique(np.concatenate([key[late] - kind.type(TERMS), key[early]]), return_counts=True)
    row, term = (key // TERMS).astype("i8"), key % TERMS
    value = ((1 + np.log(times)) * weights[term]).astype("f4")
    norm = np.sqrt(np.bincount(row, value.astype("f8") ** 2, minlength=int(first[-1])))
    mine = column[term] >= 0
    number = np.arange(int(first[-1])) - np.repeat(first[:-1], count)
    return Passages(
        np.repeat(np.arange(len(texts)), count), number, row[mine], column[term[mine]], value[mine], norm
    )


def _stretches(p: Passages) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """STRETCH passages at a time that have an entry: the number of the first, their columns, and a dense matrix of both.

    Passages next to each other share most of their terms, so the rows that a product needs are fetched once for all.
    """
    if not len(p.row):
        return
    new = np.concatenate([[True], p.row[1:] != p.row[:-1]])
    place, starts = np.cumsum(new) - 1, np.flatnonzero(new)
    seen = np.zeros(int(p.column.max()) + 1, bool)
    at = np.empty(len(seen), "i8")
    for n, (lo, hi) in enumerate(pairwise([*starts[::STRETCH].tolist(), len(p.row)])):
        first, column = n * STRETCH, p.column[lo:hi]
        seen[column] = True
        own = np.flatnonzero(seen)
        seen[own] = False
        at[own] = np.arange(len(own))
        dense = np.zeros((min(STRETCH, len(starts) - first), len(own)), "f4")
        dense[place[lo:hi] - first, at[column]] = p.value[lo:hi]
        yield first, own, dense


def _times(p: Passages, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The passages that have an entry, and their product with ``matrix``."""
    rows = p.row[np.flatnonzero(np.diff(p.row, prepend=-1))]
    out = np.empty((len(rows), matrix.shape[1]), "f4")
    for first, own, dense in _stretches(p):
        np.dot(dense, matrix[own], out=out[first : first + len(dense)])
    return rows, out


def _times_transposed(p: Passages, rows: np.ndarray, product: np.ndarray, size: int) -> np.ndarray:
    """Transposed passages times ``product``, whose rows belong to the passages ``rows``."""
    out = np.zeros((size, product.shape[1]), "f4")
    for first, own, dense in _stretches(p):
        out[own] += dense.T @ product[first : first + len(dense)]
    return out


# Index -----------------------------------------------------------------------------------------------------------------


@dataclass
class Index:
    weights: np.ndarray
    column: np.ndarray  # of each term its row in ``shares``, or -1
    shares: np.ndarray  # singular vectors times the items' latent vectors, which are divided by the items' full norms
    items: list[Item]

    def project(self, texts: list[np.ndarray]) -> tuple[Passages, np.ndarray, np.ndarray]:
        """Passages, those that have a term of the benchmark, and their cosines to the items.

        A passage's latent vector times those of the items is its row times ``shares``: one product instead of two.
        """
        p = passages(texts, self.weights, self.column)
        rows, scores = _times(p, self.shares)
        return p, rows, scores / np.maximum(p.norm[rows], 1e-9)[:, None]


SUMS = T.StructType(
    [
        T.StructField("part", T.IntegerType()),
        T.StructField("total", T.BinaryType()),
        T.StructField("energy", T.DoubleType()),
    ]
)


def _sketch_task(shared, size: int):
    """Of each task's passages M and the matrix Q: the sum of M'MQ, or of (MQ)'(MQ), part by part, and of the squares of M."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, column, q, last = shared.value
        total, energy = np.zeros((q.shape[1] if last else size, q.shape[1])), 0.0
        for group in _at_once(np.frombuffer(terms, "i4") for batch in batches for terms in batch["terms"]):
            p = passages(group, weights, column)
            total += _sketch(p, q, size, last)
            energy += float((p.value.astype("f8") ** 2).sum())
        if energy:
            numbers = total.astype("f4").ravel()
            parts = [numbers[i : i + PART].tobytes() for i in range(0, len(numbers), PART)]
            energies = [energy] + [0.0] * (len(parts) - 1)
            yield pd.DataFrame({"part": range(len(parts)), "total": parts, "energy": energies})

    return run


def _add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    totals: dict[int, np.ndarray] = {}
    energies: dict[int, float] = {}
    for batch in batches:
        for part, total, energy in zip(batch["part"], batch["total"], batch["energy"], strict=True):
            totals[part] = totals.get(part, 0.0) + np.frombuffer(total, "f4").astype("f8")
            energies[part] = energies.get(part, 0.0) + energy
    if totals:
        sums = [t.astype("f4").tobytes() for t in totals.values()]
        yield pd.DataFrame({"part": list(totals), "total": sums, "energy": list(energies.values())})


def _sketch(p: Passages, q: np.ndarray, size: int, last: bool) -> np.ndarray:
    rows, product = _times(p, q)
    return product.T @ product if last else _times_transposed(p, rows, product, size)


def fit_index(hashed: DataFrame, items: list[Item], weights: np.ndarray, common: np.ndarray) -> Index:
    """Randomised SVD of the items and of all passages of all documents, whose terms are ``hashed``.

    The items count as much as all documents, so that the singular vectors keep the directions that retrieval needs.
    """
    spark = hashed.sparkSession
    own = [terms_of(item.words) for item in items]
    weights = item_weights(own, weights, common)
    used = np.unique(np.concatenate(own)) if own else np.empty(0, "i4")
    used = used[weights[used] > 0]
    column = np.full(TERMS, -1, "i4")
    column[used] = np.arange(len(used))
    entries = _whole(own, weights, column)
    rank = min(len(items) + RANK, len(used))
    width = min(rank + SPARE, len(used))
    if not width:
        return Index(weights, column, np.zeros((0, len(items)), "f4"), items)
    own_weights = np.where(column >= 0, weights, 0).astype("f4")  # the products need no other terms
    dealt = hashed.coalesce(FIT_TASKS * spark.sparkContext.defaultParallelism)

    def summed(q: np.ndarray, last: bool) -> np.ndarray:
        q = q.astype("f4")
        shared = spark.sparkContext.broadcast((own_weights, column, q, last))
        sums = dealt.mapInPandas(_sketch_task(shared, len(used)), SUMS)
        parts = sums.repartition("part").mapInPandas(_add_up, SUMS).collect()  # one sum, whatever the number of tasks
        shared.destroy()
        total = np.zeros((width if last else len(used), width))
        for r in parts:
            at = r["part"] * PART
            total.flat[at : at + PART] = np.frombuffer(r["total"], "f4")
        mine = float((entries.value.astype("f8") ** 2).sum())
        return total + max(1.0, sum(r["energy"] for r in parts) / mine) * _sketch(entries, q, len(used), last)

    q = np.linalg.qr(np.random.default_rng(SEED).standard_normal((len(used), width)))[0]
    for _ in range(ROUNDS):
        q = np.linalg.qr(summed(q, False))[0]
    values, vectors = np.linalg.eigh(summed(q, True))
    basis = (q @ vectors[:, np.argsort(values)[::-1][:rank]]).astype("f4")
    latent = np.zeros((len(items), rank), "f4")
    rows, product = _times(entries, basis)
    latent[rows] = product
    return Index(weights, column, basis @ (latent / entries.norm[:, None].astype("f4")).T, items)


def _whole(texts: list[np.ndarray], weights: np.ndarray, column: np.ndarray) -> Passages:
    """Each text as one row, whatever its length; all its terms are the benchmark's, or weigh nothing."""
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    key, times = np.unique(owner * TERMS + (np.concatenate(texts) if texts else 0), return_counts=True)
    row, term = key // TERMS, key % TERMS
    heavy = weights[term] > 0
    row, term, times = row[heavy], term[heavy], times[heavy]
    value = ((1 + np.log(times)) * weights[term]).astype("f4")
    norm = np.sqrt(np.bincount(row, value.astype("f8") ** 2, minlength=len(texts)))
    return Passages(np.arange(len(texts)), np.zeros(len(texts), "i8"), row, column[term], value, np.maximum(norm, 1e-9))


# Search ----------------------------------------------------------------------------------------------------------------

MATCH = T.StructType(
    [
        T.StructField("item_id", T.LongType()),
        T.StructField("at", T.LongType()),
        T.StructField("cosine", T.DoubleType()),
        T.StructField("overlap", T.DoubleType()),
        T.StructField("answered", T.DoubleType()),
    ]
)


def _at_once(texts: Iterable[Sequence]) -> Iterator[list]:
    """Texts in groups of at most WORDS_AT_ONCE words, or of one text."""
    group: list = []
    size = 0
    for text in texts:
        if group and size + len(text) > WORDS_AT_ONCE:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group


def search(indexes: list[Index], texts: list[str | None], cosine: float = COSINE) -> Iterator[list[tuple]]:
    """Of each text the items it holds, with the passage that holds most of each. Several texts are handled at once."""
    for group in _at_once(map(words_of, texts)):
        yield from _search_group(indexes, group, cosine)


def _search_group(indexes: list[Index], group: list[list[bytes]], cosine: float) -> Iterator[list[tuple]]:
    best: list[dict[int, tuple]] = [{} for _ in group]
    terms = [terms_of(w) for w in group]
    for index in indexes:
        if not len(index.shares):
            continue
        p, rows, scores = index.project(terms)
        for row, i in zip(*np.nonzero(scores >= cosine), strict=True):
            passage, item = rows[row], index.items[i]
            text, start = int(p.text[passage]), int(p.block[passage]) * BLOCK
            more = max(BLOCK, len(item.words))  # the item may begin or end outside the passage that shows it
            overlap, answered, held = item.settle(group[text][max(0, start - more) : start + 2 * BLOCK + more])
            if held and overlap > best[text].get(item.number, (0, 0, 0.0, -1.0))[3]:
                best[text][item.number] = (item.item_id, start, float(scores[row, i]), overlap, answered)
    for found in best:
        yield [found[i] for i in sorted(found)]


@lru_cache(maxsize=1)
def _indexes(key: int, shared) -> list[Index]:
    return shared.value


def _searcher(spark: SparkSession, indexes: list[Index]):
    shared = spark.sparkContext.broadcast(indexes)
    key = id(shared)

    @F.pandas_udf(T.ArrayType(MATCH))
    def found(texts: pd.Series) -> pd.Series:
        rows = search(_indexes(key, shared), list(texts))
        return pd.Series([[dict(zip(MATCH.names, m, strict=True)) for m in r] for r in rows], dtype="object")

    return found


def searchers(documents: DataFrame, benchmark: DataFrame) -> Iterator:
    """A function of a text column for each INDEXES indexes of the benchmark, so that no broadcast grows with it."""
    small_batches(documents.sparkSession)
    hashed = hashed_texts(documents)
    weights, common = inverse_frequencies(hashed)
    chunks = benchmark.count() // ITEMS + 1
    for chunk in range(chunks):
        mine = benchmark.where(F.expr(f"pmod(xxhash64(item_id, text), {chunks}) = {chunk}")).select("item_id", "text")
        items = [x for r in mine.collect() if (x := item_of(r["item_id"], r["text"]))]
        for number, item in enumerate(items):
            item.number = number
        groups = grouped(items)
        passes = [groups[i : i + INDEXES] for i in range(0, len(groups), INDEXES)]
        for some in passes or [[]]:
            yield _searcher(documents.sparkSession, [fit_index(hashed, g, weights, common) for g in some])


def matches(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, tag, item_id, at, cosine, overlap, answered) for every document that holds a benchmark item.

    ``benchmark``: item_id, text. Indexes are taken INDEXES at a time, each time with one pass over the documents; items
    without a word hold nothing, equal items are each reported. Texts without a word match nothing. Repeated rows match
    alike. ``at`` is the first word of the passage, from 0. Of a long item the piece with the largest share is reported; one
    whose pieces fall into two passes may be reported once for each.
    """
    out = None
    for found in searchers(documents, benchmark):
        named = documents.select("doc_id", text_tag("text").alias("tag"), F.explode(found("text")).alias("m"))
        part = named.select("doc_id", "tag", "m.*")
        out = part if out is None else out.unionAll(part)
    return out


def drop_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``documents`` without those that hold a benchmark item; every column as it was, whatever its name."""
    left = documents
    for found in searchers(documents, benchmark):
        left = left.where(F.size(found(F.col("text"))) == 0)
    return left


def op5_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return matches(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
