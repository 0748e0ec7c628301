"""Fingerprints and groups against plain ones on the given documents and on small fixtures."""

import random
import re
from pathlib import Path

import pytest
import xxhash

from lakeload.llm import simhash as s
from .test_common import union

DATA = Path("/root/testdata/sf0.001")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def plain_fingerprint(text, n=3):
    words = WORD.findall(lower(text))
    runs = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_every_given_document(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    prints = {i: plain_fingerprint(t) for i, t in docs.items()}
    root = union((a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2)
    got = s.op6_simhash(spark, str(DATA)).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {
        i: (f"{p:016x}", root.get(i, i)) for i, p in prints.items()
    }
    assert len(got) == len(docs)


def test_odd_documents(spark):
    long = "word " * 70_000 + "end"
    texts = [None, "", " \n", "One", "ONE", "one two", "É é", "a b c d", "A B c d", long]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "a b c d", "x"), (3, "One", "x"), (20, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = s.linked_documents(df, 3).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.fingerprint, r.component_id))
    assert by[0] == by[1] == by[2] == by[20] == [("0" * 16, 0)]
    assert by[3] == [(f"{plain_fingerprint('one'):016x}", 3)] * 2 and by[4] == by[3][:1]
    assert by[None] == by[7] == by[8] and by[7][0][1] == 7
    assert by[9][0][0] == f"{plain_fingerprint(long):016x}"
    assert s.linked_documents(df.limit(0), 3).count() == 0
    assert s.linked_documents(df.where("doc_id IS NULL"), 3).first().component_id is None


@pytest.mark.parametrize("distance", [0, 1, 2])
@pytest.mark.parametrize("crowd", [0, 3, 1000])
def test_links_connect_what_all_close_pairs_connect(spark, distance, crowd):
    draw = random.Random(distance)
    prints = {0, (1 << 64) - 1}
    for _ in range(6):
        base = draw.getrandbits(64)
        for _ in range(25):
            near = base
            for _ in range(draw.randrange(5)):
                near ^= 1 << draw.randrange(64)
            prints.add(near)
            base = near if draw.random() < 0.3 else base
    prints = [signed(p) for p in prints]
    close = [(a, b) for a in prints for b in prints if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= distance]
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    links = [(r.src, r.dst) for r in s.fingerprint_links(df, distance, crowd).collect()]
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= distance for a, b in links)
    assert union(links) == union(close)


def test_masks_cover_all_bits_twice():
    for distance in range(3):
        masks = s._masks(distance)
        assert len(masks) == (distance + 2) * (distance + 1) // 2
        for b in range(64):
            assert sum(m >> b & 1 for m in masks) == distance + 1


def shingles(text):
    words = WORD.findall(lower(text))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def similar(a, b):
    return 1.0 if not a | b else len(a & b) / len(a | b)


def edited(words, draw, n):
    words = list(words)
    for _ in range(n):
        words[draw.randrange(len(words))] = f"new{draw.randrange(10**6)}"
    return words


@pytest.fixture(scope="module")
def family():
    """Documents with exact copies, near copies of several sizes, and unrelated ones that share half their words."""
    draw = random.Random(11)
    word = lambda: f"w{draw.randrange(4000)}"
    rows, shared = [], [word() for _ in range(60)]
    for _ in range(25):
        words = [word() for _ in range(draw.choice([40, 150, 600]))]
        rows.append(" ".join(words))
        rows += [" ".join(words).upper(), " ".join(words)]
        rows += [" ".join(edited(words, draw, max(1, len(words) // 70))) for _ in range(4)]
    rows += [" ".join(shared + [word() for _ in range(60)]) for _ in range(60)]
    draw.shuffle(rows)
    return list(enumerate(rows))


def test_near_duplicates_equal_brute_force(spark, family):
    sets = {i: shingles(t) for i, t in family}
    root = union((a, b) for a in sets for b in sets if a < b and similar(sets[a], sets[b]) >= 0.8)
    expected = {i for i in sets if root.get(i, i) == i}
    df = spark.createDataFrame([(i, t, "k") for i, t in family], "doc_id long, text string, d string")
    got = s.drop_near_duplicates(df)
    assert got.columns == df.columns
    assert {r.doc_id for r in got.collect()} == expected


def templated(draw, name, template, common, own, pairs):
    """Pairs that share the template and ``common`` words and differ in ``own`` words; other texts share the template only."""
    word = lambda: f"{name}{draw.randrange(10**9)}"
    head = [word() for _ in range(template)]
    for _ in range(pairs):
        both = head + [word() for _ in range(common)]
        yield from (" ".join(both + [word() for _ in range(own)]) for _ in range(2))


def test_near_pairs_under_a_shared_template(spark):
    draw = random.Random(5)
    families = [(80, 9, 10, 200), (304, 60, 45, 60), (92, 4, 11, 60), (94, 0, 11, 40)]
    texts = [t for i, f in enumerate(families) for t in templated(draw, "abcd"[i], *f)]
    base = [f"e{draw.randrange(10**9)}" for _ in range(150)]
    texts += [" ".join(edited(base, draw, draw.randrange(1, 8))) for _ in range(120)]
    draw.shuffle(texts)
    sets = dict(enumerate(map(shingles, texts)))
    root = union((a, b) for a in sets for b in sets if a < b and similar(sets[a], sets[b]) >= 0.8)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id for r in s.drop_near_duplicates(df).select("doc_id").collect()}
    assert got == {i for i in sets if root.get(i, i) == i}


def test_near_duplicates_of_the_given_documents(spark):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    sets = {r.doc_id: shingles(r.text) for r in df.collect()}
    root = union((a, b) for a in sets for b in sets if a < b and similar(sets[a], sets[b]) >= 0.8)
    got = s.drop_near_duplicates(df)
    assert got.columns == df.columns
    assert {r.doc_id for r in got.collect()} == {i for i in sets if root.get(i, i) == i}


def test_nulls_repeats_and_wordless_texts(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(5, text), (5, text), (3, text.upper()), (None, text), (7, None), (8, ""), (9, " \t"), (None, None), (1, "short"), (2, "Short"), (4, "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.text) for r in s.drop_near_duplicates(df).collect())
    assert got == [(1, "short"), (3, text.upper()), (4, "other"), (7, None)]
    only = spark.createDataFrame([(5, text), (5, text), (5, text)], "doc_id long, text string")
    assert s.drop_near_duplicates(only).count() == 1
    assert s.drop_near_duplicates(df.limit(0)).count() == 0
    nobody = spark.createDataFrame([(None, text), (None, text), (None, text + " x")], "doc_id long, text string")
    assert s.drop_near_duplicates(nobody).count() == 1
