"""Held-out accuracy, and the cases that must have a defined answer."""

import zlib
from pathlib import Path

import numpy as np
import pytest

from lakeload.llm import language as lang

DATA = Path("/root/testdata/sf0.01")
TYPE = "doc_id long, text string, lang string"


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
def test_held_out_accuracy(spark):
    truth = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = lang.op9_language_id(spark, str(DATA)).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id].lang for r in held]) >= 0.97
    names = {r.lang for r in truth.values()}
    assert all(r.lang_pred in names | {"und"} for r in got)


def docs():
    words = {"aa": "kala maja puu tee", "bb": "strix wolf brom gurt"}
    rows = [(i, " ".join([words[x]] * (1 + i % 3)), x) for i in range(40) for x in words]
    return [(2 * k + i % 2, t, x) for k, (i, t, x) in enumerate(rows)]


def test_unseen_words_odd_texts_and_columns(spark):
    extra = [(1000, "kalaga majas", None), (1001, "wolfen brom", None), (1002, None, "aa"), (1003, "12 !?", "aa"), (1004, "", None),
             (None, "kala", "aa"), (None, "kala", "aa"), (1005, "KALA Puu " * 3000, None), (1006, "日本語", None)]
    df = spark.createDataFrame([(*r, 1, 2.0) for r in docs() + extra], TYPE + ", score int, held_out double")
    got = {}
    for r in lang.identify(df).collect():
        got.setdefault(r.doc_id, []).append((r.held_out, r.lang_pred, r.score))
    assert got[1000][0][1] == "aa" and got[1001][0][1] == "bb" and got[1005][0][1] == "aa"
    assert all(got[i][0][1:] == ("und", 0.0) for i in (1002, 1003, 1004))
    assert got[None][0] == got[None][1] and got[None][0][:2] == (False, "aa")
    assert got[1006][0][1] in ("aa", "bb") and 0 <= got[1006][0][2] <= 1
    assert lang.identify(df.limit(0)).count() == 0


def test_held_out_rows_teach_nothing(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2]
    other = [i for i in range(200) if i not in held]
    rows = [(i, "kala maja", "aa") for i in other[:50]] + [(i, "wolf brom", "bb") for i in held]
    assert {r.lang_pred for r in lang.identify(spark.createDataFrame(rows, TYPE)).collect()} == {"aa"}
    nothing = spark.createDataFrame([(i, "wolf brom", "bb") for i in held] + [(other[0], "wolf", None)], TYPE)
    assert {(r.lang_pred, r.score) for r in lang.identify(nothing).collect()} == {("und", 0.0)}


def test_words_first_then_ever_shorter_runs():
    row = lambda *x: np.array(x, "f4")
    model = {(0, "abc"): row(-1, -2), (5, "<abcd"): row(-3, -4), (3, "xyz"): row(-5, -6), (1, "q"): row(-7, -8)}
    scorer = lang.Scorer(["a", "b"], model)
    assert scorer.word("abc").tolist() == [-1, -2]
    assert scorer.word("abcdxyz").tolist() == [-3, -4]  # the longest known runs alone
    assert scorer.word("wxyzw").tolist() == [-5, -6] and scorer.word("qqr").tolist() == [-7, -8]
    assert scorer.word("mmm").tolist() == [0, 0]


def test_model_is_bounded(spark):
    rows = spark.createDataFrame(docs(), TYPE)
    names, model = lang.learn(rows, entries=60)
    assert names == ["aa", "bb"] and len(model) <= 60
    assert lang.learn(rows, sample=10)[0] in ([], ["aa"], ["bb"], ["aa", "bb"])


def test_every_language_is_drawn_however_rare(spark):
    assert lang.level([10, 1000, 1000], 210) == 100 and lang.level([3, 4], 10) == float("inf") and lang.level([], 5) == float("inf")
    rows = [(i, "kala maja", "aa") for i in range(3000)] + [(i, "wolf brom", "bb") for i in range(3000, 6000)]
    rows += [(9000 + i, "ili oko zub", "cc") for i in range(3)]
    df = spark.createDataFrame(rows, TYPE)
    drawn = {r["lang"]: r["count"] for r in lang.draw(df, 203).groupBy("lang").count().collect()}
    assert drawn["cc"] == 3 and 60 <= drawn["aa"] <= 145 and 60 <= drawn["bb"] <= 145
    assert lang.draw(df, 10_000).count() == len(rows)
    assert lang.learn(df, sample=203)[0] == ["aa", "bb", "cc"]


def plain_predictions(df):
    """The same method over plain lists: every labelled document learnt, every word scored by itself."""
    import re
    from collections import Counter

    counts = {}
    for r in df:
        if r.lang is None or r.text is None or r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 4 == 2:
            continue
        for word in re.findall(r"[^\W\d_]+", r.text.lower()):
            grams = [(0, word)] if len(word) <= 32 else []
            grams += [(1, c) for c in word]
            grams += [(n, f"<{word}>"[i : i + n]) for n in range(2, 6) for i in range(len(word) + 3 - n)]
            for kind, gram in grams:
                counts.setdefault((r.lang, kind), Counter())[gram] += 1
    names = sorted({x for x, _ in counts})
    totals = {key: sum(c.values()) for key, c in counts.items()}

    def log(kind, gram):
        if not any(gram in counts.get((x, kind), ()) for x in names):
            return None
        return [np.log(counts[x, kind][gram] + 1.0) - np.log(totals[x, kind] + 2.0) if gram in counts.get((x, kind), ())
                else -np.log(totals.get((x, kind), 1) + 2.0) for x in names]

    def word_score(word):
        if (whole := log(0, word)) is not None:
            return np.array(whole)
        for n in range(5, 0, -1):
            pieces = list(word) if n == 1 else [f"<{word}>"[i : i + n] for i in range(len(word) + 3 - n)]
            known = [p for p in (log(n, piece) for piece in pieces) if p is not None]
            if known:
                return np.mean(known, axis=0)
        return np.zeros(len(names))

    for r in df:
        words = re.findall(r"[^\W\d_]+", r.text.lower()) if r.text else []
        if not words or not names:
            yield r.doc_id, "und", 0.0
            continue
        total = sum(word_score(w) for w in words)
        odds = np.exp(total - total.max())
        yield r.doc_id, names[int(total.argmax())], float(odds.max() / odds.sum())


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
def test_every_prediction_equals_a_plain_model(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(100)
    rows = df.collect()
    df = spark.createDataFrame(rows, df.schema)
    monkeypatch.setattr(lang, "learn", lambda labelled, learn=lang.learn: learn(labelled, entries=10**9))
    got = {r.doc_id: (r.lang_pred, r.score) for r in lang.identify(df).collect()}
    for doc_id, name, score in plain_predictions(rows):
        assert got[doc_id][0] == name and abs(got[doc_id][1] - score) < 1e-3, doc_id
