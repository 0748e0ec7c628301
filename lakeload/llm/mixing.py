"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Each source's documents are shuffled by a hash and laid end to end; every ``block`` words are one block, and further passes
go on where the last one ended. A schedule of slots names a source for each block: slot ``i`` is the point ``i * phi mod 1``
mapped through the cumulative targets. Slots are ranked per source, and the k-th slot of a source is its k-th block.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeload.llm.common import WORD_BYTES, small_batches, table, text_tag
from lakeload.workspace import stage

WEIGHTS = 3
MAX_PASSES = 3
BLOCK_WORDS = 4096
SEED = 20_24
#: Documents whose places are added up by one task, and slots that one task ranks.
RUN_ROWS, RUN_SLOTS = 512, 1 << 14
#: Points are whole numbers below 2**31: multiples of an odd number next to 2**31 / phi, which never overflow a long.
POINTS, STEP, CELL_BITS = 1 << 31, 1_327_217_885, 21
BLANKS = r"' \t\n\r\u000B\u000C'"


def word_count(text: str = "text") -> F.Column:
    """Words of a text; null has none."""
    trimmed = f"btrim({text}, {BLANKS})"
    return F.expr(rf"CAST(IF({trimmed} IS NULL OR {trimmed} = '', 0, size(split({trimmed}, '[ \\t-\\r]+'))) AS LONG)")


def source_targets(sized: DataFrame) -> DataFrame:
    """(source, sid, source_size, target) per source of ``sized`` (source, size).

    Sources by code point, null last, weigh 1 to WEIGHTS in turn and share all words; a target stops at MAX_PASSES times its
    source, and what it can't take goes to the others by weight. One row per source, so the windows are small.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = sizes.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    named = named.withColumns(
        {"weight": 1 + F.col("sid") % WEIGHTS, "most": (MAX_PASSES * F.col("source_size")).cast("double")}
    )
    every = Window.partitionBy()
    by_room = Window.orderBy(F.col("most") / F.col("weight"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    total, weights = F.sum("source_size").over(every), F.sum("weight").over(every)
    left = total - F.coalesce(F.sum("most").over(by_room), F.lit(0.0))
    rest = weights - F.coalesce(F.sum("weight").over(by_room), F.lit(0))
    named = named.withColumn("full", F.col("most") / F.col("weight") < left / rest)
    level = (total - F.sum(F.when(F.col("full"), F.col("most")).otherwise(0.0)).over(every)) / F.greatest(
        F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(every), F.lit(1)
    )
    target = F.when(F.col("full"), F.col("most")).otherwise(F.least("most", level * F.col("weight")))
    return named.select("source", "sid", "source_size", target.alias("target"))


def schedule(targets: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """(slot, sid, k): the source of every slot and the slot's rank among that source's slots.

    The points give each source its share up to a few slots. Slots of a source beyond its target fall away; those still
    missing are added at the end, so that every source has exactly the blocks of its target.
    """
    spark = targets.sparkSession
    take = F.round("target").cast("long")
    need = targets.select("sid", "target", F.ceil(take / block).cast("long").alias("need"))
    n, sources, total = need.agg(F.sum("need"), F.max("sid") + 1, F.sum("target")).first()
    n, sources, total = n or 0, sources or 0, total or 1.0
    in_turn = Window.orderBy("sid")
    upto = F.floor(F.sum("target").over(in_turn) / total * POINTS)
    bound = need.withColumn("hi", F.when(F.col("sid") == sources - 1, POINTS).otherwise(upto).cast("long"))
    bound = bound.withColumn("lo", F.coalesce(F.lag("hi").over(in_turn), F.lit(0))).where("hi > lo")
    cells = F.sequence(F.shiftright("lo", CELL_BITS), F.shiftright(F.col("hi") - 1, CELL_BITS))
    bound = bound.withColumn("cell", F.explode(cells))
    slots = spark.range(n).withColumn("x", F.col("id") % POINTS * STEP % POINTS)
    slots = slots.withColumn("cell", F.shiftright("x", CELL_BITS)).join(bound, "cell").where("x >= lo AND x < hi")
    slots = slots.select("sid", F.col("id").alias("slot"), F.floor(F.col("id") / RUN_SLOTS).alias("run"), "need")
    slots = stage(slots, "mix-slots")
    runs = slots.groupBy("sid", "run").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("sid").orderBy("run")) - F.col("n")
    inside = F.row_number().over(Window.partitionBy("sid", "run").orderBy("slot")) - 1
    ranked = slots.withColumn("nth", inside).join(runs.select("sid", "run", before.alias("before")), ["sid", "run"])
    ranked = ranked.withColumn("k", F.col("nth") + F.col("before")).where("k < need").select("slot", "sid", "k")
    had = need.join(slots.groupBy("sid").agg(F.count("*").alias("had")), "sid", "left")
    had = had.withColumn("had", F.coalesce("had", F.lit(0))).where("had < need")
    more = had.select("sid", "had", F.explode(F.sequence("had", F.col("need") - 1)).alias("k"))
    return ranked.unionAll(more.select((n + (F.col("k") - F.col("had")) * sources + F.col("sid")).alias("slot"), "sid", "k"))


def laid_out(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """``sized`` with sid, source_size, target and ``start``, the words before it in its source's shuffled order.

    A source is cut into runs by hash, each added up by itself; one number per run carries the sum on, so that a source
    with a third of all rows needs no single task. Documents without words have no start.
    """
    placed = sized.join(targets, sized["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    rows = sized.groupBy().agg(F.count("*")).first()[0]
    drawn = F.xxhash64("doc_id", "tag", F.lit(SEED))
    placed = placed.withColumn("draw", drawn)
    placed = placed.withColumn("run", F.expr(f"pmod(draw, {rows // RUN_ROWS + 1})"))
    runs = placed.groupBy("sid", "run").agg(F.sum("size").alias("n"))
    before = F.sum("n").over(Window.partitionBy("sid").orderBy("run")) - F.col("n")
    runs = runs.select("sid", "run", before.alias("before"))
    inside = Window.partitionBy("sid", "run").orderBy("draw", "doc_id", "size")
    own = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = placed.withColumn("own", own).join(runs, ["sid", "run"])
    return placed.withColumn("start", F.when(F.col("size") > 0, F.col("own") + F.col("before"))).drop(
        "own", "before", "run", "draw"
    )


def pieces(placed: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """A row per part of a document that lies in one block: k, at (its place in the source), pass, first_word, n_words.

    A document meets at most one block per ``block`` words and pass. Parts that cut a text are made here, before any
    shuffle.
    """
    take = F.round("target").cast("long")
    turns = placed.where("size > 0").withColumn("take", take)
    turns = turns.where("start < take").withColumn(
        "pass", F.explode(F.expr("sequence(0, CAST((take - 1 - start) DIV source_size AS INT))"))
    )
    turns = turns.withColumn("from", F.col("start") + F.col("pass") * F.col("source_size"))
    turns = turns.withColumn("upto", F.least(F.col("from") + F.col("size"), F.col("take")))
    cut = turns.withColumn("k", F.explode(F.expr(f"sequence(from DIV {block}, (upto - 1) DIV {block})")))
    cut = cut.withColumn("at", F.greatest("from", F.col("k") * block))
    return cut.withColumns(
        {
            "first_word": F.col("at") - F.col("from"),
            "n_words": F.least(F.col("upto"), (F.col("k") + 1) * block) - F.col("at"),
        }
    ).drop("from", "upto", "take")


def measured(documents: DataFrame) -> DataFrame:
    """What mixing needs to know of a document."""
    return documents.select("doc_id", "source", word_count().alias("size"), text_tag("text").alias("tag"))


def cut_words(text: str, firsts: list[int], counts: list[int]) -> list[str]:
    """The runs of words of a text that begin at ``firsts``, with the blanks after them; the text is gone through once."""
    data = text.encode("utf-8", "surrogatepass")
    wanted = sorted({*firsts, *(f + n for f, n in zip(firsts, counts, strict=True))})
    starts, open_ones = {}, iter(wanted)
    word = next(open_ones, None)
    for place, found in enumerate(WORD_BYTES.finditer(data)):
        if place == word:
            starts[place] = found.start()
            if (word := next(open_ones, None)) is None:
                break
    ends = (starts.get(f + n, len(data)) for f, n in zip(firsts, counts, strict=True))
    return [data[starts[f] : end].decode("utf-8", "surrogatepass") for f, end in zip(firsts, ends, strict=True)]


def _cutter():
    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series, firsts: pd.Series, counts: pd.Series) -> pd.Series:
        return pd.Series([cut_words(t, list(f), list(n)) for t, f, n in zip(texts, firsts, counts, strict=True)])

    return cut


def mix(documents: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """The mixture itself: slot, at, pass, source, doc_id, first_word, n_words and the words with the blanks after them.

    Order by slot and at to read it. Columns of the documents besides these are left out. Null or empty texts hold no word
    and are in no block; a null source is a source of its own; equal rows are separate stock; an empty table gives no slot.
    Everything is laid out on sizes alone; then each text meets its own cuts, all of which are made in one pass over it, so
    the time that a text takes grows with its length, and texts that no cut divides aren't looked into at all.
    """
    small_batches(documents.sparkSession)
    sized = stage(measured(documents), "mix-sizes")
    targets = stage(source_targets(sized), "mix-targets")
    cut = schedule(targets, block).join(pieces(laid_out(sized, targets), block), ["sid", "k"])
    part = F.struct("slot", "at", "pass", "first_word", "n_words").alias("part")
    cut = stage(cut.select("sid", "start", "source", "doc_id", "tag", "size", part), "mix-pieces")
    rows = cut.groupBy("sid", "start", "source", "doc_id", "tag", "size").agg(F.collect_list("part").alias("parts"))
    texts = documents.select("doc_id", text_tag("text").alias("tag"), "text")
    texts = texts.groupBy("doc_id", "tag").agg(F.first("text").alias("text"))
    texts = stage(texts, "mix-texts")  # equal rows have one text; a join on top of its own grouping can't be split
    same = F.expr("r.doc_id <=> t.doc_id AND r.tag = t.tag")
    met = rows.alias("r").join(texts.alias("t"), same).select("r.source", "r.doc_id", "r.size", "r.parts", "t.text")
    met = stage(met, "mix-cuts")
    undivided = F.forall("parts", lambda p: (p["first_word"] == 0) & (p["n_words"] == F.col("size")))
    names = ["slot", "at", "pass", "source", "doc_id", "first_word", "n_words", "text"]
    whole = met.where(undivided).select("source", "doc_id", F.explode("parts").alias("p"), "text")
    made = met.where(~undivided).select(
        "source", "doc_id", "parts", _cutter()("text", "parts.first_word", "parts.n_words").alias("texts")
    )
    made = made.select("source", "doc_id", F.explode(F.arrays_zip("parts", "texts")).alias("z"))
    made = made.select("source", "doc_id", F.col("z.parts").alias("p"), F.col("z.texts").alias("text"))
    return whole.unionAll(made).select("source", "doc_id", "p.*", "text").select(*names)


def mix_counts(documents: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """Per row of ``documents``: doc_id, size, source_size, target and the words the mixture takes of it."""
    sized = stage(measured(documents), "mix-sizes")
    targets = stage(source_targets(sized), "mix-targets")
    placed = stage(laid_out(sized, targets), "mix-places")
    taken = schedule(targets, block).join(pieces(placed, block).select("sid", "k", "start", "n_words"), ["sid", "k"])
    taken = taken.groupBy("sid", "start").agg(F.sum("n_words").alias("taken"))
    counted = placed.join(taken, ["sid", "start"], "left")
    return counted.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def op1_source_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mix_counts(table(spark, sf, "documents"))
