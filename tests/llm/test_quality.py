"""Line-first cleaning against plain Python."""

import re

import cases
import pytest
from pyspark.sql import functions as F

from seqrec.llm import quality


def brute(text, window=5):
    text = text or ""
    w = cases.words(text)
    windows = [tuple(w[i:i + window]) for i in range(len(w) - window + 1)]
    inside = {j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(i, i + window)} if len(windows) < 3000 else None
    if inside is None:
        first, inside = {}, set()
        for i, x in enumerate(windows):
            first.setdefault(x, []).append(i)
        for places in first.values():
            if len(places) > 1:
                inside |= {j for i in places for j in range(i, i + window)}
    full = [x for x in text.split("\n") if cases.words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(full) - len(set(full)), len(inside)


def judged(spark, rows):
    return quality.clean(cases.frame(spark, rows)).collect()


def test_counts_equal_brute_force(spark):
    rows = cases.awkward() + [(20, "a b c d e f a b c d e g\n\nx # * & < y\nx # * & < y\n x"), (21, "a b c d a b c d a b c d a b c d"),
                              (22, " lead\x0b\x0cand\rtrail \n"), (23, "\n".join(["same line here"] * 4))]
    for r in judged(spark, rows):
        got = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert got == brute(r["text"]), r["text"][:50]
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


CLEAN = cases.prose(1, 30)


@pytest.mark.parametrize("line, rule", [
    ("Home", "navigation"), ("news | sport | weather | about", "navigation"), ("Copyright 2020 by us, all of it", "boilerplate"), ("All rights reserved.", "boilerplate"),
    ("buy&&& now%%% cheap*** pills$$$", "symbols"), ("THIS!! IS!! SO!! LOUD!! NOW", "shouting"), ("word " * 14, "punctuation"),
    ("A plain sentence, with a stop.", None), ("A Heading Without One", None), ("", None), (" \t", None), ("Tom & Jerry went home.", None), ("a | b", None)])
def test_line_rules(spark, line, rule):
    got = spark.createDataFrame([(line,)], "x string").select(quality.failing_rule(F.col("x")).alias("r")).first()["r"]
    assert got == rule


def test_verdicts(spark):
    nav = "news | sport | weather | about | more | yet"
    rows = [(1, CLEAN), (2, CLEAN + "\n" + nav), (3, "\n".join([f"{nav} {k}" for k in range(30)] + [cases.prose(2, 12)])), (4, CLEAN + "\nAll rights reserved.")]
    got = {r["doc_id"]: r for r in judged(spark, rows)}
    assert [got[k]["kept"] for k in (1, 2, 3, 4)] == [True, True, False, True]
    assert got[2]["clean_text"] == CLEAN and got[4]["clean_text"] == CLEAN and got[1]["clean_text"] == CLEAN


def test_empty_table(spark):
    assert quality.clean(cases.frame(spark, [])).count() == 0
