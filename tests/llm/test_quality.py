"""Counts against plain counting, and the cases a rule must settle."""

import random
import re

import pytest

from lakeload.llm import quality as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plainly(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 5)}
    lost = sum(len(WORD.findall(x)) for x in lines if q.line_fails(x))
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
        sum(x in lines[:i] for i, x in enumerate(lines)), len(covered), lost,
    )


def texts():
    draw = random.Random(3)
    pick = ["a", "b", "A", "ü#", "x|", "!!", ".", " ", "\x1c"]
    blank = [" ", "  ", "\n", "\n\n", "\t", "\r\n", "\x0b", "\x0c"]
    made = ["".join(draw.choice(pick) + draw.choice(blank) for _ in range(draw.randrange(40))) for _ in range(200)]
    return ["", " ", "\n", "a a a a a a", "a b c d e a b c d e", "a b c d e f a b c d e", *made]


@pytest.mark.parametrize("text", texts())
def test_counts_equal_plain_ones(text):
    assert q.measure(text)[:-1] == plainly(text)


def test_long_texts_in_pieces(monkeypatch):
    import lakeload.llm.common as common

    text = " ".join("abcdefg"[i * i % 7] for i in range(500))
    whole = q.measure(text)
    monkeypatch.setattr(common, "LONG_TEXT", 10)
    monkeypatch.setattr(common, "WORDS_AT_ONCE", 64)
    assert q.measure(text) == whole


@pytest.mark.parametrize(
    ("line", "fails"),
    [("Home | News | Sports | Contact", True), ("All Rights Reserved.", True), ("BUY!! NOW!! FREE!!", True), ("*** ### $$$", True),
     ("A plain sentence, with marks; and an end.", False), ("Title without end", False), ("a | b", False), ("50 % of 100 $", False),
     ("日本語の文章です。", False), ("We talk about privacy and cookies.", False), ("1.2.3 - 4.5", False)],
)
def test_line_rules(line, fails):
    assert q.line_fails(line) is fails


MENU = "".join(f"Home{i} | News{i} | Sports{i} | About{i}\n" for i in range(9))
PROSE = "One plain sentence follows another here.\nNothing in these lines is odd at all, they only go on.\n"


def test_documents_are_cleaned_and_rejected(spark):
    rows = [
        (1, PROSE + "Home | News | Sports | About", 1, "x"), (2, MENU + PROSE, 1, "x"),
        (3, "too short", 1, "x"), (4, None, 1, "x"), (5, "", 1, "x"), (None, PROSE, 1, "x"), (6, PROSE, 1, None), (6, PROSE, 1, None),
        (7, "again and again it says. " * 20, 1, "x"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, q string")
    kept = q.clean_documents(df)
    assert kept.columns == df.columns
    got = sorted(((r.doc_id, r.text, r.n_chars, r.q) for r in kept.collect()), key=repr)
    whole, size = PROSE, len(PROSE)
    expected = [(1, whole[:-1], size - 1, "x"), (None, whole, size, "x"), (6, whole, size, None), (6, whole, size, None)]
    assert got == sorted(expected, key=repr)
    stats = q.quality_stats(df).collect()
    assert len(stats) == len(rows)
    assert {r.doc_id for r in stats if r.base_failed} == {3, 4, 5, 7}
    assert {r.doc_id for r in stats if not r.kept} == {2, 3, 4, 5, 7}
    assert q.clean_documents(df.limit(0)).count() == 0 and q.quality_stats(df.limit(0)).count() == 0
