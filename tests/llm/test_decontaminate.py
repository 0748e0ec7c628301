"""The search against brute force over all passages, its parts against plain linear algebra."""

import random
from pathlib import Path

import numpy as np
import pytest

from lakeload.llm import decontaminate as d

DATA = Path("/root/testdata/sf0.001")


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            row[j], before = (before + 1 if x == y else max(row[j], row[j - 1])), row[j]
    return row[-1]


def test_common_words_is_the_longest_common_subsequence():
    draw = random.Random(2)
    for _ in range(200):
        a, b = ([bytes([draw.randrange(97, 102)]) for _ in range(draw.randrange(1, 90))] for _ in range(2))
        assert d.common_words(d._masks(a), len(a), b) == lcs(a, b)


def test_passages_and_products_equal_dense_ones():
    draw = np.random.default_rng(1)
    texts = [draw.integers(0, 50, n).astype("i4") for n in (0, 1, 31, 32, 33, 64, 65, 200)]
    weights = np.zeros(d.TERMS, "f4")
    weights[:50] = draw.random(50)
    weights[7] = 0
    column = np.full(d.TERMS, -1, "i4")
    column[10:30] = np.arange(20)
    p = d.passages(texts, weights, column)
    dense, where = [], []
    for n, t in enumerate(texts):
        blocks = -(-len(t) // d.BLOCK)
        for b in range(max(blocks - 1, min(blocks, 1))):
            part = t[b * d.BLOCK : (b + 2) * d.BLOCK]
            times = np.bincount(part, minlength=50)
            dense.append(np.where(times > 0, 1 + np.log(np.maximum(times, 1)), 0) * weights[:50])
            where.append((n, b))
    dense = np.array(dense)
    assert list(zip(p.text, p.block, strict=True)) == where
    assert p.norm == pytest.approx(np.linalg.norm(dense, axis=1), rel=1e-5)
    q = draw.standard_normal((20, 5)).astype("f4")
    rows, product = d._times(p, q)
    full = np.zeros((len(dense), 5))
    full[rows] = product
    assert full == pytest.approx(dense[:, 10:30] @ q, rel=1e-4, abs=1e-5)
    back = d._times_transposed(p, rows, product, 20)
    assert back == pytest.approx(dense[:, 10:30].T @ full, rel=1e-4, abs=1e-4)


def brute_force(documents, benchmark):
    """Every item against every stretch of every text that the search could look at."""
    items = [x for i, t in benchmark if (x := d.item_of(i, t))]
    found = set()
    for doc_id, text in documents:
        words = d.words_of(text)
        blocks = -(-len(words) // d.BLOCK)
        for item in items:
            more = max(d.BLOCK, len(item.words))
            for b in range(max(blocks - 1, min(blocks, 1))):
                start = b * d.BLOCK
                if item.settle(words[max(0, start - more) : start + 2 * d.BLOCK + more])[2]:
                    found.add((doc_id, item.item_id))
    return found


def test_recall_and_precision_on_given_documents(spark):
    documents, benchmark = (spark.read.parquet(f"{DATA}/{n}.parquet") for n in ("documents", "benchmark"))
    expected = brute_force([(r.doc_id, r.text) for r in documents.collect()], [tuple(r) for r in benchmark.collect()])
    got = {(r.doc_id, r.item_id) for r in d.matches(documents, benchmark).collect()}
    assert got <= expected and len(got) >= 0.9 * len(expected) > 0


@pytest.fixture(scope="module")
def planted():
    """Items of several lengths, each planted exactly, edited, and rewritten but for its answer; and clean texts."""
    draw = random.Random(8)
    often = [f"c{i}" for i in range(30)]
    word = lambda: draw.choice(often) if draw.random() < 0.4 else f"w{draw.randrange(3000)}"
    text = lambda n: " ".join(word() for _ in range(n))
    benchmark = [(i, f"{text(draw.choice([12, 30, 60])).capitalize()}? {text(6).capitalize()}.") for i in range(40)]
    documents, expected = [], set()
    for i, item in benchmark:
        words = item.split()
        few = [w if draw.random() > 0.15 else "changed" for w in words]
        body, answer = words[:-6], words[-6:]
        half = [w if k % 5 < 3 else "other" for k, w in enumerate(body)] + answer
        for n, version in enumerate((words, few, [w.upper() for w in words], half)):
            documents.append((4 * i + n, f"{text(draw.randrange(200))} {' '.join(version)} {text(draw.randrange(200))}"))
            expected.add((4 * i + n, i))
    clean = [(1000 + i, text(300)) for i in range(60)]
    return documents, benchmark, expected, clean


def test_planted_items_are_found_and_clean_texts_left(spark, planted):
    documents, benchmark, expected, clean = planted
    docs = spark.createDataFrame([(i, t, "x") for i, t in documents + clean], "doc_id long, text string, at string")
    items = spark.createDataFrame([(*b, 1) for b in benchmark], "item_id long, text string, doc_id long")
    rows = d.matches(docs, items).collect()
    got = {(r.doc_id, r.item_id) for r in rows}
    assert len(got & expected) >= 0.95 * len(expected)
    assert not {i for i, _ in got} & {i for i, _ in clean}
    left = d.drop_contaminated(docs, items)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {i for i, _ in documents + clean} - {i for i, _ in got}


def test_several_passes_and_indexes_find_the_same(spark, planted, monkeypatch):
    documents, benchmark, _, clean = planted
    docs = spark.createDataFrame(documents + clean, "doc_id long, text string")
    items = spark.createDataFrame(benchmark, "item_id long, text string")
    once = {(r.doc_id, r.item_id) for r in d.matches(docs, items).collect()}
    monkeypatch.setattr(d, "ITEMS", 25)
    monkeypatch.setattr(d, "INDEXED", 10)
    monkeypatch.setattr(d, "WORDS_AT_ONCE", 500)
    again = {(r.doc_id, r.item_id) for r in d.matches(docs, items).collect()}
    assert len(once ^ again) <= 0.02 * len(once)


def test_nulls_empty_tables_and_long_texts(spark):
    item = "the quick brown fox jumps over the lazy dog while seven grey geese fly south"
    rows = [(1, None), (2, ""), (3, "..."), (None, f"x {item} y"), (4, f"x {item} y"), (4, f"x {item} y"), (5, "word " * 30_000 + item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (8, None), (9, ""), (None, item)], "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id) for r in d.matches(docs, items).collect()), key=repr)
    assert got == sorted([(i, k) for i in (None, 4, 4, 5) for k in (7, None)], key=repr)
    assert {r.doc_id for r in d.drop_contaminated(docs, items).collect()} == {1, 2, 3}
    assert d.matches(docs, items.limit(0)).count() == 0 and d.matches(docs.limit(0), items).count() == 0
    assert d.drop_contaminated(docs, items.limit(0)).count() == len(rows)


def test_a_passage_of_a_long_item_is_found(spark):
    draw = random.Random(3)
    text = lambda n: " ".join(f"w{draw.randrange(4000)}" for _ in range(n))
    long, short = text(600).split(), text(40)
    rows = [(i, f"{text(70)} {' '.join(long[at : at + 100])} {text(90)}") for i, at in enumerate((0, 17, 250, 333, 500))]
    rows += [(10, " ".join(long)), (11, f"{text(50)} {short}")] + [(100 + i, text(300)) for i in range(20)]
    rows += [(200, f"{text(80)} {' '.join(long[300:330])} {text(80)}")]  # a share of every piece that settles nothing
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(long)), (2, short)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in d.matches(docs, items).collect()}
    assert got == {(i, 1) for i in (0, 1, 2, 3, 4, 10)} | {(11, 2)}
    assert {r.doc_id for r in d.drop_contaminated(docs, items).collect()} == {200} | {100 + i for i in range(20)}


def test_pieces_cover_every_run_of_a_long_item_and_groups_are_bounded():
    for n in (1, d.LONG_ITEM, d.LONG_ITEM + 1, 600, 617):
        item = d.Item(1, [b"w%d" % i for i in range(n)], [b"a"], 5)
        cut = d.pieces(item)
        assert all(p.number == 5 for p in cut) and cut[-1].words[-1] == item.words[-1] and cut[-1].answer == [b"a"]
        if n <= d.LONG_ITEM:
            assert cut == [item]
            continue
        starts = [int(p.words[0][1:]) for p in cut]
        for at in range(n - d.PIECE - d.BLOCK + 2):
            assert any(at <= s and s + d.PIECE <= at + d.PIECE + d.BLOCK - 1 for s in starts)
    groups = d.grouped([d.Item(i, [b"w"] * 5000, []) for i in range(30)])
    assert all(len(g) <= d.INDEXED and sum(len(p.words) for p in g) <= d.INDEX_WORDS for g in groups)


def test_the_index_is_fitted_on_every_document(spark, monkeypatch):
    """Beside the same steps in plain matrices over the passages of all of them: 2,500, some without a word."""
    draw = random.Random(5)
    text = lambda n, of: " ".join(f"w{int(of * draw.random() ** 2)}" for _ in range(n))
    benchmark = [(i, text(30, 900)) for i in range(70)]
    documents = [(i, text(draw.randrange(150), 900)) for i in range(2497)] + [(None, None), (1, ""), (1, text(2000, 900))]
    docs = spark.createDataFrame(documents, "doc_id long, text string")
    items = spark.createDataFrame(benchmark, "item_id long, text string")
    monkeypatch.setattr(d, "_searcher", lambda spark, indexes: indexes)
    ((index,),) = d.searchers(docs, items)

    def dense(p, rows):
        out = np.zeros((rows, int(index.column.max()) + 1))
        out[p.row, p.column] = p.value
        return out

    terms = [d.terms_of(d.words_of(t)) for _, t in documents]
    counts = np.zeros(d.TERMS, "i8")
    for t in terms:
        counts[t] += 1
    weighed = index.weights > 0
    assert index.weights[weighed] == pytest.approx(np.log1p(2500 / np.maximum(counts, 1))[weighed], rel=1e-5)
    p = d.passages(terms, index.weights, index.column)
    own = d._whole([d.terms_of(x.words) for x in index.items], index.weights, index.column)
    m, x = dense(p, len(p.norm)), dense(own, len(index.items))
    squares = m.T @ m + max(1.0, (m**2).sum() / (x**2).sum()) * x.T @ x
    rank = len(index.items) + d.RANK
    assert rank + d.SPARE < len(squares)
    start = np.random.default_rng(d.SEED).standard_normal((len(squares), rank + d.SPARE))
    q = np.linalg.qr(squares @ np.linalg.qr(start)[0])[0]
    values, vectors = np.linalg.eigh(q.T @ squares @ q)
    basis = q @ vectors[:, np.argsort(values)[::-1][:rank]]
    assert index.shares == pytest.approx(basis @ (x @ basis / own.norm[:, None]).T, abs=1e-3)


def test_texts_handled_at_once_are_whole_and_bounded():
    for sizes in ([], [0], [d.WORDS_AT_ONCE + 1], [3, d.WORDS_AT_ONCE, 0, 1, 7], [d.WORDS_AT_ONCE // 2] * 5):
        texts = [bytes(n) for n in sizes]
        groups = list(d._at_once(texts))
        assert [t for g in groups for t in g] == texts
        assert all(len(g) == 1 or sum(map(len, g)) <= d.WORDS_AT_ONCE for g in groups)


def test_many_passages_at_once_are_those_of_few():
    draw = np.random.default_rng(4)
    weights, column = draw.random(d.TERMS).astype("f4"), np.arange(d.TERMS)
    few = [draw.integers(0, d.TERMS, n).astype("i4") for n in (3, 40, 200)]
    many = ((1 << 31) // d.TERMS) // 3 + 1  # more passages than short keys have room for
    one, all_ = d.passages(few, weights, column), d.passages(few * many, weights, column)
    rows, entries = len(one.norm), len(one.row)
    assert rows * many * d.TERMS > 1 << 31
    assert (all_.norm.reshape(many, rows) == one.norm).all()
    assert (all_.value.reshape(many, entries) == one.value).all()
    assert (all_.column.reshape(many, entries) == one.column).all()
    assert (all_.row.reshape(many, entries) == one.row + rows * np.arange(many)[:, None]).all()
