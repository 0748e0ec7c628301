"""Token counts as a tokenizer library gives them, without a shuffle of words.

Tier one is a compact table of frequent pre-tokens and their lengths in tokens, made on the driver and broadcast; tier two
is a cache in each Python worker that encodes what the table lacks. Both hold lengths that the library itself computed, so
the counts are the library's own.
"""

from __future__ import annotations

import json
import os
from collections import Counter
from collections.abc import Iterable
from functools import lru_cache
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeload.llm.common import small_batches, table

#: Bounds of tier one: entries, characters of one entry, and the rows and partitions looked at to find frequent ones.
TABLE_ENTRIES, ENTRY_CHARS, SAMPLE_PARTITIONS, SAMPLE_ROWS, SAMPLE_CHARS = 32_768, 48, 16, 256, 1 << 16
#: Entries that a worker's cache holds at most, then it starts anew.
CACHE_ENTRIES = 300_000
LIMIT = 2048
#: Beyond this character the classes of two regular-expression libraries may differ; such texts go to the library whole.
SAFE = "ɏ"


class Counting(dict):
    """Length in tokens of a pre-token; asks the library for one it lacks and keeps the answer."""

    def __init__(self, tokenizer, known: dict[str, int]):
        super().__init__(known)
        self.tokenizer, self.known = tokenizer, known

    def __missing__(self, piece: str) -> int:
        n = len(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        if len(piece) <= ENTRY_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
                self.update(self.known)
            self[piece] = n
        return n


class Counter49k:
    """Counts the tokens of a text by a word-level BPE file whose pre-tokens are matches of one pattern."""

    def __init__(self, path: str, known: dict[str, int]):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.cut = regex.compile("|".join(map(regex.escape, self.special)))
        self.pieces = regex.compile(split["pattern"]["Regex"])
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.normal = self.tokenizer.normalizer.normalize_str
        self.lengths = Counting(self.tokenizer, known)

    def split(self, text: str) -> list[str]:
        return self.pieces.findall(self.normal(text))

    def count(self, text: str) -> int:
        n = 0
        if any(s in text for s in self.special):
            n, parts = len(self.cut.findall(text)), self.cut.split(text)
        else:
            parts = [text]
        for part in parts:
            if part.isascii() or max(part) <= SAFE:
                n += sum(map(self.lengths.__getitem__, self.split(part)))
            else:
                n += len(self.tokenizer.encode(part, add_special_tokens=False).ids)
        return n


@lru_cache(maxsize=1)
def _counter(path: str, table_id: int, shared) -> Counter49k:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Counter49k(path, shared.value if shared is not None else {})


def frequent_pieces(documents: DataFrame, path: str, text: str = "text") -> list[str]:
    """The most frequent pre-tokens of a bounded look at the texts: some rows of some partitions, each counted in its task.

    It only decides what is answered by table instead of cache; no count depends on it.
    """
    rows = documents.select(text).rdd
    n = rows.getNumPartitions()
    if not n:
        return []
    chosen = sorted({i * n // min(n, SAMPLE_PARTITIONS) for i in range(min(n, SAMPLE_PARTITIONS))})

    def look(part: Iterable) -> list[Counter]:
        counter = _counter(path, 0, None)
        found: Counter = Counter()
        for (value,) in islice(part, SAMPLE_ROWS):
            found.update(p for p in counter.split((value or "")[:SAMPLE_CHARS]) if len(p) <= ENTRY_CHARS)
        return [Counter(dict(found.most_common(TABLE_ENTRIES)))]

    total: Counter = Counter()
    for part in documents.sparkSession.sparkContext.runJob(rows, look, chosen):
        total.update(part)
    return [p for p, k in total.most_common(TABLE_ENTRIES) if k > 1]


def length_table(path: str, pieces: list[str]) -> dict[str, int]:
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return {p: len(tokenizer.encode(p, add_special_tokens=False).ids) for p in pieces[:TABLE_ENTRIES]}


def token_count(path: str, shared=None) -> Column:
    """A function of a text column: its tokens, without begin, end or added special tokens; null counts as empty."""
    key = id(shared)

    @F.pandas_udf(T.LongType())
    def count(texts: pd.Series) -> pd.Series:
        counter = _counter(path, key, shared)
        return texts.map(lambda t: counter.count(t) if t else 0).astype("int64")

    return count


def count_tokens(documents: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """``documents`` with n_bytes, n_tokens and over_limit (more than ``limit`` tokens).

    Null and empty texts have 0 bytes and tokens. Every row is counted for itself; repeated rows count alike. Strings of
    special tokens inside a text count as the library counts them by default. Columns of these names are replaced.
    """
    small_batches(documents.sparkSession)
    pieces = frequent_pieces(documents, path)
    shared = documents.sparkSession.sparkContext.broadcast(length_table(path, pieces))
    counted = documents.withColumns(
        {
            "n_bytes": F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"),
            "n_tokens": token_count(path, shared)(F.col("text")),
        }
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op2_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    documents = table(spark, sf, "documents").select("doc_id", "text")
    counted = count_tokens(documents, public_tokenizers.path("word_bpe_49k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")
