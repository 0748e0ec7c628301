"""Spans against brute force, and the promise that nothing is lost."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from lakeload.llm import substring as sub

TYPE = "doc_id long, text string"


def plain(text):
    return " ".join(text.lower().split())


def runs(parts):
    """All spans of a text, by the definition."""
    for i in range(len(parts)):
        for e in range(i + 1, len(parts) + 1):
            n = sum(len(p.split()) for p in parts[i:e])
            if (e - i >= sub.SENTENCES and n >= sub.WORDS) or n >= sub.LONG:
                yield i, e
                break


def both_ways(parts):
    """The shortest span from each sentence on, and the shortest up to each sentence."""
    yield from runs(parts)
    sizes = [len(p.split()) for p in parts]
    for e in range(1, len(parts) + 1):
        n = 0
        for i in range(e - 1, -1, -1):
            n += sizes[i]
            if (e - i >= sub.SENTENCES and n >= sub.WORDS) or n >= sub.LONG:
                yield i, e
                break


def brute_force(rows, runs=runs):
    """Sentences left of each distinct (doc_id, text)."""
    rows = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, sub.xxhash.xxh64_intdigest(r[1] or "")))
    seen, gone = {}, defaultdict(set)
    for row in rows:
        parts = sub.sentences(row[1] or "")
        for i, e in runs(parts):
            key = plain(" ".join(parts[i:e]))
            if seen.setdefault(key, (row, i)) != (row, i):
                gone[row].update(range(i, e))
    return {row: [p for k, p in enumerate(sub.sentences(row[1] or "")) if k not in gone[row]] for row in rows}


def corpus():
    draw = random.Random(4)
    sentence = lambda: " ".join(f"w{draw.randrange(3000)}" for _ in range(draw.choice([1, 3, 6, 9, 25, 45]))).capitalize() + draw.choice([".", "!", "?\n", "。", "\n"])
    passages = [[sentence() for _ in range(draw.randrange(2, 9))] for _ in range(12)]
    rows = []
    for i in range(150):
        parts = [sentence() for _ in range(draw.randrange(6))]
        for p in draw.sample(passages, draw.randrange(3)):
            at = draw.randrange(len(parts) + 1)
            parts[at:at] = p
        rows.append((i, " ".join(parts)))
    return rows


def test_cleaned_texts_equal_brute_force(spark):
    rows = corpus()
    rows += [rows[3], (None, "x"), (200, None), (201, ""), (202, "A b.\n" * 60), (203, rows[5][1].upper())]
    expected = brute_force(rows)
    got = sub.without_repeats(spark.createDataFrame(rows, TYPE)).collect()
    assert len(got) == len(rows)
    for r in got:
        left = expected[r.d.doc_id, r.d.text]
        assert plain(r.clean or "") == plain("".join(left)), r.d
        assert r.n_sentences - r.n_removed == len(left)
    assert sum(r.n_removed > 0 for r in got) > 30


def test_every_removed_sentence_is_kept_at_an_earlier_place():
    rows = corpus()
    left = brute_force(rows)
    kept = {plain(p) for parts in left.values() for p in parts}
    assert {plain(p) for _, t in rows for p in sub.sentences(t)} <= kept


def test_sentences_join_to_the_text():
    for _, text in [*corpus(), (0, "  . a\n\n\nb! c?\" d 3.5 e.g. f…"), (0, "\n"), (0, "")]:
        assert "".join(sub.sentences(text)) == text


def test_columns_nulls_and_texts_left_empty(spark):
    passage = "One two three four five six. Seven eight nine ten eleven twelve. Thirteen fourteen fifteen sixteen."
    rows = [(2, passage, 9, "a"), (1, "Before it. " + passage + " After it.", 9, "b"), (3, None, 9, "c"), (4, "", 9, None), (None, passage, 9, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, clean string")
    got = sub.drop_repeats(df)
    assert got.columns == df.columns
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(
        [(1, rows[1][1], len(rows[1][1]), "b"), (3, None, None, "c"), (4, "", 0, None)], key=repr
    )
    assert sub.drop_repeats(df.limit(0)).count() == 0


def test_a_span_in_very_many_documents_goes_from_all_but_the_first(spark):
    passage = " ".join(f"Common words number {i} here and there." for i in range(9))
    rows = [(i, f"Own words {i}.\n{passage}\nMore words {i}.") for i in range(400)]
    got = {r.d.doc_id: r.clean for r in sub.without_repeats(spark.createDataFrame(rows, TYPE)).collect()}
    assert got[0] == rows[0][1]
    assert all(plain(got[i]) == f"own words {i}. more words {i}." for i in range(1, 400))


def whole_runs(rows):
    """Sentences left if every repeated run of the size goes, however long, but for its first place."""
    rows = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, sub.xxhash.xxh64_intdigest(r[1] or "")))
    seen, gone = {}, defaultdict(set)
    for row in rows:
        parts = sub.sentences(row[1] or "")
        n = [len(p.split()) for p in parts]
        for i in range(len(parts)):
            for e in range(i + 1, len(parts) + 1):
                if (e - i >= sub.SENTENCES and sum(n[i:e]) >= sub.WORDS) or sum(n[i:e]) >= sub.LONG:
                    if seen.setdefault(plain(" ".join(parts[i:e])), (row, i)) != (row, i):
                        gone[row].update(range(i, e))
    return {row: plain("".join(p for k, p in enumerate(sub.sentences(row[1] or "")) if k not in gone[row])) for row in rows}


def test_repeated_runs_go_whole(spark):
    rows = corpus() + [(202, "A b.\n" * 60), (None, "x"), (203, None)]
    sized = lambda k, n: f"{' '.join(f'p{k}.{n}.{i}' for i in range(n))}. "
    for k, sizes in enumerate([(43, 8, 16), (40, 19, 2), (50, 3, 3, 3), (2, 1, 45, 1), (8, 43)]):
        passage = "".join(sized(k, n) for n in sizes)
        rows += [(300 + 2 * k, passage + "Own end."), (301 + 2 * k, f"Own {k}. " + passage + "Other end.")]
    expected = whole_runs(rows)
    assert [expected[r] for r in rows[-9::2]] == [f"own {k}. other end." for k in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    folder = str(spark.conf.get("spark.checkpoint.dir")) + "/whole-runs"
    df.write.parquet(f"{folder}/documents.parquet")
    got = {r.doc_id: plain(r.text or "") for r in sub.op8_substring_dedup(spark, folder).collect()}
    assert got == {i: t for (i, _), t in expected.items()}
    df = df.withColumn("n_chars", F.length("text").cast("long"))
    got = {r.doc_id: plain(r.text or "") for r in sub.drop_repeats(df, both=True).collect()}
    assert got == {i: t for (i, text), t in expected.items() if t or not plain(text or "")}
