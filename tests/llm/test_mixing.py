"""Targets against the rule carried out step by step, the mixture against what it must add up to."""

import random
from collections import Counter, defaultdict

import pytest

from lakeload.llm import mixing as m

TYPE = "doc_id long, source string, text string"


def stepwise(sizes):
    """Targets by source: weights 1, 2, 3 in turn, stopping at three times the source, the excess shared anew."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [*map(ord, s)]) + [None] * (None in sizes)
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3.0 * sizes[s] for s in over}


def corpus(seed, n=300):
    draw = random.Random(seed)
    sources = ["b", "a", "ä", "Z", None, "tiny", "z😀", "y￿"]
    rows = []
    for i in range(n):
        source = draw.choices(sources, [60, 10, 5, 5, 5, 1, 2, 2])[0]
        rows.append((i, source, " ".join(f"w{i}.{j}" for j in range(draw.choice([0, 3, 10, 30, 400]))) if i % 17 else None))
    return rows + rows[1:4] + [(None, "a", "x y z")] * 2


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_and_words_taken(spark, seed, monkeypatch):
    monkeypatch.setattr(m, "RUN_ROWS", 16)
    monkeypatch.setattr(m, "RUN_SLOTS", 8)
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], TYPE + ", size int, taken int").repartition(7)
    got = m.mix_counts(df, block=64).collect()
    size = lambda t: len((t or "").split())
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, size(t)) for i, _, t in rows)
    sizes = Counter()
    for _, s, t in rows:
        sizes[s] += size(t)
    targets = stepwise(sizes)
    where = {i: s for i, s, _ in rows}
    taken = Counter()
    for r in got:
        s = where[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(targets[s]) and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    assert all(taken[s] == round(targets[s]) for s in sizes)
    assert sum(targets.values()) == pytest.approx(sum(sizes.values()))
    again = m.mix_counts(df.repartition(3), block=64).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_mixture_is_made_of_whole_blocks_in_schedule_order(spark, monkeypatch):
    monkeypatch.setattr(m, "RUN_SLOTS", 8)
    rows = [r for r in corpus(3) if r[0] is not None][:300]
    rows = list({r[0]: r for r in rows}.values())
    got = m.mix(spark.createDataFrame(rows, TYPE), block=64).collect()
    text = {i: t for i, _, t in rows}
    slots = defaultdict(list)
    for r in got:
        words = text[r.doc_id].split()
        assert r.text.split() == words[r.first_word : r.first_word + r.n_words]
        slots[r.slot].append(r)
    assert sorted(slots) == sorted(set(slots))
    partial = Counter()
    for parts in slots.values():
        assert len({r.source for r in parts}) == 1
        parts.sort(key=lambda r: r["at"])
        assert all(a["at"] + a.n_words == b["at"] for a, b in zip(parts, parts[1:], strict=False))
        n = sum(r.n_words for r in parts)
        assert n <= 64
        partial[parts[0].source] += n < 64
    assert max(partial.values()) <= 1  # all blocks but a source's last are equal
    counts = {r.doc_id: r.taken for r in m.mix_counts(spark.createDataFrame(rows, TYPE), block=64).collect()}
    taken = Counter()
    for r in got:
        taken[r.doc_id] += r.n_words
    assert {i: n for i, n in counts.items() if n} == dict(taken)


def test_schedule_keeps_every_stretch_near_its_shares(spark):
    targets = spark.createDataFrame([(0, 6400.0), (1, 12800.0), (2, 44800.0), (3, 0.0)], "sid int, target double")
    slots = {r.slot: r.sid for r in m.schedule(targets, 64).collect()}
    order = [slots[k] for k in sorted(slots)]
    assert Counter(order) == {0: 100, 1: 200, 2: 700}
    for start in range(0, 900, 50):
        seen = Counter(order[start : start + 100])
        assert abs(seen[0] - 10) <= 3 and abs(seen[1] - 20) <= 3 and abs(seen[2] - 70) <= 4


def test_nothing_to_mix(spark):
    empty = spark.createDataFrame([], TYPE)
    assert m.mix(empty).count() == 0 and m.mix_counts(empty).count() == 0
    wordless = spark.createDataFrame([(1, "a", None), (2, None, " \n")], TYPE)
    assert m.mix(wordless).count() == 0
    assert [tuple(r)[1:] for r in m.mix_counts(wordless).collect()] == [(0, 0, 0.0, 0)] * 2


def test_word_count_of_odd_blanks(spark):
    from pyspark.sql import functions as F

    texts = [None, "", " ", "a", "\x0ba\x0cb\r\n c\t", "a\xa0b", "a\x1cb c", "\x85"]
    expected = [len((t or "").encode().split()) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", m.word_count().alias("n"))
    assert [r.n for r in df.orderBy(F.col("i")).collect()] == expected


def test_word_count_of_form_feeds_and_the_letter_f(spark):
    texts = ["f", "f a b", "a b ff", "a b\x0c", "\x0ca b", "\x0c", "\x0cf\x0c", "\x0b\x0c a f \x0c\n"]
    expected = [len(t.encode().split()) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", m.word_count().alias("n"))
    assert [r.n for r in df.orderBy("i").collect()] == expected


def test_very_long_texts_are_cut_in_one_pass(spark):
    """Half a million words in one text, cut at every block: linear, and word for word."""
    long = "\n ".join(f"w{i}" for i in range(500_000))
    df = spark.createDataFrame([(1, "a", long), (2, "a", "x y"), (2, "a", "x y"), (3, "b", long[:4000])], TYPE)
    got = m.mix(df, block=512).collect()
    words = long.split()
    for r in got:
        if r.doc_id == 1:
            assert r.text.split() == words[r.first_word : r.first_word + r.n_words]
    assert sum(r.doc_id == 2 and r.n_words == 2 for r in got) % 2 == 0


def test_cuts_keep_the_blanks_after_words():
    text = "  one two\n\nthree \x1cé four "
    assert m.cut_words(text, [1, 0, 3], [2, 1, 2]) == ["two\n\nthree ", "one ", "\x1cé four "]
    assert m.cut_words(text, [], []) == []
