"""Toxicity scores: held-out accuracy, and the learner against a plain one."""

import math
import zlib

import numpy as np
import pytest

from lakeload.llm import toxicity as tx

WORDS = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(400)]


def corpus(n=900, seed=1):
    """Documents of common words; the toxic ones hold a bad word or a bad pair of harmless words."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        words = list(rng.choice(WORDS, 40))
        toxic = i % 4 == 0
        if toxic:
            words.insert(int(rng.integers(40)), ("scoundrel", "Knave!", "you there rat")[i // 4 % 3])
        elif i % 4 == 1:
            words.insert(int(rng.integers(40)), ("you", "rat")[i // 4 % 2])
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def tables(spark, rows, extra=()):
    documents = spark.createDataFrame(
        [(i, t, "x", 1.0) for i, t, _ in rows] + list(extra), "doc_id bigint, text string, score string, label double"
    )
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in rows], "doc_id bigint, toxic int, text int")
    return documents, labels


def test_held_out_documents_are_told_apart(spark):
    rows = corpus()
    odd = [(None, "scoundrel knave", "x", 1.0), (5000, None, "x", 1.0), (5001, "", "x", 1.0), (5002, "42 !", "x", 1.0)]
    got = {r.doc_id: r for r in tx.judge(*tables(spark, rows, odd)).collect()}
    assert len(got) == len(rows) + 4
    held = [(got[i], y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(r.held_out for r, _ in held) and 200 < len(held) < 400
    assert np.mean([r.predicted == y for r, y in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    assert not got[None].held_out and got[None].predicted == 1
    assert got[5000].score == got[5001].score == got[5002].score < 0.7


def test_labels_of_held_out_rows_are_not_learnt(spark):
    rows = corpus(300)
    documents, labels = tables(spark, rows)
    other, changed = tables(spark, [(i, t, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, t, y in rows])
    first, second = (tx.fit(d, l) for d, l in ((documents, labels), (other, changed)))
    assert (first[0] == second[0]).all() and np.allclose(first[1], second[1], atol=1e-6)


def test_labels_that_disagree_or_mean_nothing(spark):
    documents = spark.createDataFrame([(i, "a b") for i in range(9)], "doc_id bigint, text string")
    labels = spark.createDataFrame(
        [(0, 1), (0, 0), (2, None), (3, 7), (4, 1), (4, 1), (None, 1)], "doc_id bigint, toxic int"
    )
    learnt = {r.doc_id for r in tx.learnable_labels(documents, labels).collect()}
    assert learnt <= {4}


def test_without_labels_every_score_is_a_half(spark):
    documents, labels = tables(spark, corpus(6))
    got = tx.judge(documents, labels.limit(0)).collect()
    assert [r.score for r in got] == [0.5] * 6 and {r.predicted for r in got} == {0}
    assert tx.judge(documents.limit(0), labels).collect() == []


def test_one_class_and_repeated_rows(spark):
    rows = [(i, "same words here", 0) for i in range(12)]
    documents, labels = tables(spark, rows + rows)
    got = tx.judge(documents, labels).collect()
    assert len(got) == 24 and len({r.score for r in got}) == 1 and got[0].predicted == 0


def test_sample_bounds_each_class(spark):
    documents, labels = tables(spark, corpus(600))
    places, values, _ = tx.fit(documents, labels, sample=60)
    assert len(places) == len(values) and (values != 0).all()


def test_features_are_words_and_near_pairs():
    one, two = tx.features("Alpha beta."), tx.features("alpha BETA")
    assert (one == two).all() and len(one) == 3  # two words and their pair
    assert len(tx.features("a b c d")) == 4 + 3 + 2 + 1
    assert len(tx.features("a b c d a b c d a b c d")) == 4 * 4  # each word before each other one and before itself
    assert not len(tx.features(None)) and not len(tx.features("12 !"))
    assert set(tx.features("a b")) & set(tx.features("b a")) == set(tx.features("a")) | set(tx.features("b"))
    assert (tx.features("a b a b a b") == np.unique(tx.features("a b a b a b"))).all()


def test_long_texts_are_whole_whatever_the_pieces(monkeypatch):
    rng = np.random.default_rng(2)
    text = " ".join(rng.choice(WORDS, 5000))
    whole = tx.features(text)
    monkeypatch.setattr(tx, "WORDS_AT_ONCE", 7)
    assert (tx.features(text) == whole).all()


def test_learner_equals_a_plain_one():
    rng = np.random.default_rng(3)
    documents = [(np.unique(rng.integers(0, 50, 8)).astype("i4"), int(rng.integers(2)), 1.0 + rng.integers(3)) for _ in range(200)]
    z, n = np.zeros(tx.SPACE + 1), np.zeros(tx.SPACE + 1)
    tx.learn_block(z, n, iter(documents))
    zs, ns = {}, {}
    for places, label, heft in documents:
        w = {}
        for i in [*places.tolist(), tx.INTERCEPT]:
            l1 = 0.0 if i == tx.INTERCEPT else tx.L1
            zi = zs.get(i, 0.0)
            free = abs(zi) > l1
            w[i] = -(zi - math.copysign(l1, zi)) / ((tx.BETA + math.sqrt(ns.get(i, 0.0))) / tx.ALPHA + tx.L2) if free else 0.0
        g = (1 / (1 + math.exp(-sum(w.values()))) - label) * heft
        for i in w:
            before = ns.get(i, 0.0)
            ns[i] = before + g * g
            zs[i] = zs.get(i, 0.0) + g - (math.sqrt(ns[i]) - math.sqrt(before)) / tx.ALPHA * w[i]
    for i in zs:
        assert z[i] == pytest.approx(zs[i], abs=1e-9) and n[i] == pytest.approx(ns[i], abs=1e-9)


def test_mixing_takes_the_mean_over_blocks_that_touched_a_coordinate():
    def told(places, change):
        return np.array(places, "i4").tobytes(), np.array(change, "f4").tobytes()

    changes = [told([0, 1], [[2, 4], [1, 1]]), told([0], [[4], [3]])]
    assert tx.mix(np.zeros((2, 3), "f4"), changes).tolist() == [[3, 4, 0], [2, 1, 0]]
