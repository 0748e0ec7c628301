"""SimHash fingerprints, their links through shared blocks, and the groups that the links make.

Pigeonhole: fingerprints that differ in at most ``d`` bits agree in two of ``d + 2`` blocks of bits, so equal pairs of blocks
are all the candidates. Fingerprints that share a pair of blocks with few others are joined and their Hamming distance
checked. Where very many share one, each of them is spread to the 65 values within one bit of it instead: two fingerprints
are within two bits of each other if and only if they meet at such a value, and at most 65 can meet at one. So no pair is
lost, no group is gathered, and the rows grow with the number of fingerprints.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeload.llm.common import components, shingle_blocks, small_batches, table, text_tag
from lakeload.workspace import stage

SEED, BITS = 42, 64
#: Fingerprints in one block above which they meet by neighbouring values, not by pairs.
CROWD = 32
#: For documents: shingle length, similarity, words of a long fingerprint and shingles that make one of them.
SHINGLE, SIMILARITY, PARTS, PART_SHINGLES = 5, 0.8, 16, 5


def shingle_hashes(text: str | None, n: int) -> np.ndarray:
    """XXH64 of every run of ``n`` words of the text, A-Z in lower case, repeats included."""
    found = [np.empty(0, "u8")]
    for block in shingle_blocks((text or "").encode().lower(), n):  # lower() of bytes changes A-Z only
        found.append(np.fromiter(map(xxhash.xxh64_intdigest, block, repeat(SEED)), "u8", len(block)))
    return np.concatenate(found)


def majority(hashes: np.ndarray) -> int:
    """A bit is set where it is set in over half the hashes; no hash gives zero. As a signed long."""
    ones = np.zeros(BITS, "i8")
    for i in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[i : i + (1 << 16)]).view("u1").reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype="i8")
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("i8")[0])


def fingerprint(n: int):
    """A function of a text column: its SimHash over runs of ``n`` words, as a long."""

    @F.pandas_udf(T.LongType())
    def simhash(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: majority(shingle_hashes(t, n))).astype("int64")

    return simhash


def _masks(distance: int) -> list[int]:
    """Every choice of two of ``distance + 2`` blocks of bits, as a signed mask."""
    edges = [BITS * i // (distance + 2) for i in range(distance + 3)]
    blocks = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:], strict=False)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in (a | b for a, b in combinations(blocks, 2))]


def fingerprint_links(prints: DataFrame, distance: int = 2, crowd: int = CROWD) -> DataFrame:
    """(src, dst) over the distinct ``fp`` of ``prints``: links that join all fingerprints at ``distance`` or fewer bits.

    ``distance`` is 0 to 2. Crowded blocks give a star of links for each meeting value, the others a link for each pair, so
    links connect the same fingerprints as all close pairs would.
    """
    if distance not in (0, 1, 2):
        raise ValueError("a distance of 0, 1 or 2 bits")
    cut = [(i, F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(_masks(distance))]
    cut = F.array(*(F.struct(F.lit(i).alias("t"), block.alias("block")) for i, block in cut))
    keyed = prints.select("fp", F.explode(cut).alias("b")).select("fp", "b.t", "b.block")
    shared = keyed.groupBy("t", "block").agg(F.count("*").alias("n")).where("n > 1")
    # staged, for a join on top of its own grouping can't be split
    met = stage(keyed.join(stage(shared, "simhash-shared"), ["t", "block"]), "simhash-blocks")
    few = met.where(F.col("n") <= crowd)
    pairs = few.select("t", "block", F.col("fp").alias("src")).join(
        few.select("t", "block", F.col("fp").alias("dst")), ["t", "block"]
    )
    pairs = pairs.where("src < dst").select("src", "dst")
    many = met.where(F.col("n") > crowd).select("fp").distinct()
    near = F.expr(f"concat(array(fp), transform(sequence(0, {BITS - 1}), i -> fp ^ shiftleft(1L, i)))")
    spread = many.select("fp", F.explode(near).alias("value"))
    meeting = spread.groupBy("value").agg(F.collect_list("fp").alias("fps")).where("size(fps) > 1")  # at most 65
    hub = F.when(F.array_contains("fps", F.col("value")), F.col("value")).otherwise(F.array_min("fps"))
    stars = meeting.select(hub.alias("src"), F.explode("fps").alias("dst")).where("src <> dst")
    close = f"bit_count(src ^ dst) <= {distance}"
    return pairs.where(close).unionAll(stars.where(close)).distinct()


def linked_documents(documents: DataFrame, n: int, distance: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row: the SimHash over runs of ``n`` words and the least doc_id linked to it.

    Equal fingerprints are linked. Texts without a word, null included, have fingerprint zero and are linked like others.
    Rows are neither merged nor dropped; a component without any doc_id has none.
    """
    small_batches(documents.sparkSession)
    prints = stage(documents.select("doc_id", fingerprint(n)("text").alias("fp")), "simhash-prints")
    distinct = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    roots = components(fingerprint_links(distinct, distance), "simhash-components")
    placed = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    placed = stage(placed.select("fp", "first", F.coalesce("root", "fp").alias("root")), "simhash-placed")
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = placed.join(least, "root").select("fp", "component_id")
    text = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return prints.join(named, "fp").select("doc_id", text.alias("fingerprint"), "component_id")


def op6_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return linked_documents(table(spark, sf, "documents"), 3)


# Near-duplicate documents: five-word shingles, similarity 0.8 or more ---------------------------------------------------


def part_prints(distinct: np.ndarray) -> list[int | None]:
    """A fingerprint of PARTS words: the shingles are dealt into parts by hash, and a word is the SimHash of the least few
    of a part. Texts of similarity ``s`` agree in a given word with probability of about ``s ** PART_SHINGLES``.
    """
    if not len(distinct):
        return [0]  # texts without a word meet in one block
    parts = distinct & np.uint64(PARTS - 1)
    mine = (distinct[parts == p][:PART_SHINGLES] for p in range(PARTS))
    return [majority(h) if len(h) else None for h in mine]


@F.pandas_udf(T.StructType([T.StructField("n", T.LongType()), T.StructField("words", T.ArrayType(T.LongType()))]))
def _long_print(texts: pd.Series) -> pd.DataFrame:
    rows = [(len(h), part_prints(h)) for h in (np.unique(shingle_hashes(t, SHINGLE)) for t in texts)]
    return pd.DataFrame(rows, columns=["n", "words"])


@F.pandas_udf(T.ArrayType(T.LongType()))
def _shingle_set(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: np.unique(shingle_hashes(t, SHINGLE).view("i8")))


def shared_blocks(members: DataFrame) -> DataFrame:
    """``members`` (id, n, t, word) whose block holds other texts too, with ``m``, the texts in it."""
    shared = members.groupBy("t", "word").agg(F.count("*").alias("m")).where("m > 1")
    # staged, for a join on top of its own grouping can't be split
    return stage(members.join(stage(shared, "near-shared"), ["t", "word"]), "near-blocks")


def candidate_pairs(met: DataFrame) -> DataFrame:
    """(src, dst) to compare, of ``met`` (id, n, t, word, m) from ``shared_blocks``: texts that share a block and are of like length.

    In a block of few texts all are compared with each other. In a crowded one each is compared with two leaders: the text
    that meets most others over all its blocks, which is the original of a family of copies, and the least id. So a block
    with very many texts gives two rows per text, never all pairs; ``crowd_pairs`` gives the rest of it.
    """
    few = met.where(F.col("m") <= CROWD)
    pairs = few.select("t", "word", "id", "n").join(
        few.select("t", "word", F.struct("id", "n").alias("lead")), ["t", "word"]
    )
    known = met.groupBy("id").agg(F.sum("m").alias("known"))
    leads = met.where(F.col("m") > CROWD).join(known, "id").groupBy("t", "word")
    leads = leads.agg(F.max(F.struct("known", "id", "n")).alias("a"), F.min(F.struct("id", "n")).alias("b"))
    leads = leads.select("t", "word", F.explode(F.array(F.struct("a.id", "a.n"), F.col("b"))).alias("lead"))
    led = met.where(F.col("m") > CROWD).join(stage(leads, "near-leads"), ["t", "word"])
    like = f"id <> lead.id AND least(n, lead.n) >= {SIMILARITY} * greatest(n, lead.n)"
    both = pairs.where("id < lead.id").select("id", "n", "lead").unionAll(led.select("id", "n", "lead")).where(like)
    return both.select(F.least("id", "lead.id").alias("src"), F.greatest("id", "lead.id").alias("dst")).distinct()


def alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``pairs`` (src, dst) whose ``sets`` (tag, s) have the similarity."""
    both = pairs.join(sets.select(F.col("tag").alias("src"), F.col("s").alias("a")), "src")
    both = both.join(sets.select(F.col("tag").alias("dst"), F.col("s").alias("b")), "dst")
    inter = F.size(F.array_intersect("a", "b"))
    return both.where(inter >= SIMILARITY * (F.size("a") + F.size("b") - inter)).select("src", "dst")


def unsettled(met: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, root) of the texts of crowded blocks whose members are in several groups of ``roots`` (node, root) so far."""
    placed = met.where(F.col("m") > CROWD).join(roots.withColumnRenamed("node", "id"), "id", "left")
    placed = stage(placed.select("t", "word", "id", F.coalesce("root", "id").alias("root")), "near-crowds")
    apart = placed.groupBy("t", "word").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
    return placed.join(stage(apart, "near-apart"), ["t", "word"], "left_semi").select("id", "root").distinct()


def crowd_pairs(crowd: DataFrame, sets: DataFrame) -> DataFrame:
    """(src, dst) to compare, of ``crowd`` (id, root): every pair of different roots that can have the similarity.

    Prefix filter: the shingles of each set (tag, s) are put in one order, rarest in the crowd first. If two sets are
    similar, then at their first common shingle enough is left of both to make up their least overlap, so it lies in the first
    ninth of the smaller and the first fifth of the larger one. What a crowd shares, a template say, comes last; a shingle of
    it is among the first of few texts, or of texts that are similar. Texts of a block's largest group are only compared
    with those outside it.
    """
    overlap = SIMILARITY / (1 + SIMILARITY)
    listed = sets.join(crowd.withColumnRenamed("id", "tag"), "tag")
    listed = listed.select(F.col("tag").alias("id"), "root", F.size("s").alias("n"), F.explode("s").alias("h"))
    listed = stage(listed, "crowd-shingles")
    often = stage(listed.groupBy("h").agg(F.count("*").alias("f")), "crowd-often")
    place = F.row_number().over(Window.partitionBy("id").orderBy("f", "h")) - 1
    first = listed.join(often, "h").withColumn("left", F.col("n") - place)
    first = stage(first.where(f"f > 1 AND left >= {SIMILARITY} * n - 1e-6").drop("f"), "crowd-firsts")
    held = stage(first.groupBy("h", "root").agg(F.count("*").alias("k")), "crowd-held")
    held = held.groupBy("h").agg(F.max(F.struct("k", "root")).alias("most"), F.count("*").alias("roots"))
    held = stage(held.where("roots > 1").select("h", F.col("most.root").alias("most")), "crowd-most")
    first = stage(first.join(held, "h").withColumn("out", F.expr("root <> most")).drop("most"), "crowd-blocks")
    small = first.where(f"left >= {2 * overlap} * n - 1e-6").alias("a")
    large = first.alias("b")
    can = F.expr(
        f"a.h = b.h AND a.root <> b.root AND a.n <= b.n AND least(a.left, b.left) >= {overlap} * (a.n + b.n) - 1e-6"
    )
    both = small.where("a.out").join(large, can).unionAll(small.where("NOT a.out").join(large.where("b.out"), can))
    return both.select(F.least("a.id", "b.id").alias("src"), F.greatest("a.id", "b.id").alias("dst")).distinct()


def near_groups(members: DataFrame, sets_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, root) of the texts that are similar to another one, of ``members`` (id, n, t, word).

    ``sets_of`` gives the shingle sets (tag, s) of texts (tag). Pairs of candidates are linked first. Crowded blocks that are in
    several groups then are searched for the links between these.
    """
    met = shared_blocks(members)
    pairs = stage(candidate_pairs(met), "near-pairs")
    asked = pairs.select(F.explode(F.array("src", "dst")).alias("tag"))
    crowded = met.where(F.col("m") > CROWD).select(F.col("id").alias("tag"))
    sets = stage(sets_of(asked.unionAll(crowded).distinct()), "near-sets")
    roots = stage(components(alike(pairs, sets), "near-components"), "near-roots")
    crowd = stage(unsettled(met, roots), "near-unsettled")
    if crowd.isEmpty():
        return roots
    more = alike(stage(crowd_pairs(crowd, sets), "crowd-pairs"), sets)
    more = more.join(crowd.select(F.col("id").alias("src"), F.col("root").alias("a")), "src")
    more = more.join(crowd.select(F.col("id").alias("dst"), F.col("root").alias("b")), "dst")
    joined = components(more.select(F.col("a").alias("src"), F.col("b").alias("dst")), "crowd-components")
    joined = stage(joined.select(F.col("node").alias("root"), F.col("root").alias("to")), "crowd-roots")
    nodes = roots.unionAll(crowd.join(roots, F.col("id") == F.col("node"), "left_anti"))
    return nodes.join(joined, "root", "left").select("node", F.coalesce("to", "root").alias("root"))


def near_duplicates(documents: DataFrame) -> DataFrame:
    """(doc_id, tag, keep, copies) per distinct row: whether it is the document of its group that stays.

    Documents are linked if the sets of their five-word shingles have a Jaccard similarity of 0.8 or more, which is checked
    exactly on every candidate, in crowded blocks too; groups are connected components. Equal texts are one text. The least doc_id stays. Texts
    without a word form one group.
    """
    small_batches(documents.sparkSession)
    rows = documents.select("doc_id", text_tag("text").alias("tag"), _long_print("text").alias("p"))
    rows = stage(rows.select("doc_id", "tag", "p.n", "p.words"), "near-prints")
    texts = rows.groupBy("tag").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.first("words").alias("words"))
    texts = stage(texts, "near-texts")
    members = texts.select(F.col("tag").alias("id"), "n", F.posexplode("words").alias("t", "word")).where("word IS NOT NULL")

    def sets_of(asked: DataFrame) -> DataFrame:
        first = texts.join(asked, "tag", "left_semi").select("tag", F.col("doc_id").alias("first"))
        whole = documents.select("doc_id", "text", text_tag("text").alias("tag")).alias("d")
        whole = whole.join(first.alias("a"), F.expr("d.tag = a.tag AND d.doc_id <=> a.first"), "left_semi")
        return whole.select("tag", _shingle_set("text").alias("s")).dropDuplicates(["tag"])

    roots = near_groups(members, sets_of)
    placed = texts.select("tag", "doc_id").join(roots.withColumnRenamed("node", "tag"), "tag", "left")
    placed = stage(placed.select("tag", "doc_id", F.coalesce("root", "tag").alias("root")), "near-placed")
    best = placed.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "tag")).alias("b"))
    stays = best.select(F.col("b.tag").alias("tag"), F.col("b.doc_id").alias("kept"))
    judged = rows.groupBy("doc_id", "tag").agg(F.count("*").alias("copies")).alias("r")
    judged = judged.join(stays.alias("s"), F.expr("r.tag = s.tag AND r.doc_id <=> s.kept"), "left")
    return judged.select("r.doc_id", "r.tag", F.col("s.tag").isNotNull().alias("keep"), "copies")


def drop_near_duplicates(documents: DataFrame) -> DataFrame:
    """``documents`` with one row of each group of near-duplicates, all columns as they were, whatever their names.

    Of rows equal in doc_id and text one stays; a null doc_id goes last. An empty table gives an empty table.
    """
    judged = stage(near_duplicates(documents), "near-judged")
    named = documents.select(F.struct(*(F.col(f"`{n}`") for n in documents.columns)).alias("d"), F.col("doc_id").alias("id"))
    named = named.select("d", "id", text_tag(F.col("d.text")).alias("of")).alias("n")
    on = F.expr("n.of = j.tag AND n.id <=> j.doc_id")
    kept = named.join(judged.where("NOT keep").alias("j"), on, "left_anti").alias("n")
    twice = judged.where("keep AND copies > 1").alias("j")
    one = kept.join(twice, on, "left_semi").dropDuplicates(["id", "of"])
    return kept.join(twice, on, "left_anti").unionAll(one).select("d.*")
