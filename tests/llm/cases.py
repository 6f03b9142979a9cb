"""Awkward documents that every operator takes, and plain-Python pieces shared by the tests."""

import re

SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, score double, kept boolean, label int, "
          "n_words bigint, rate double, spans string, word string, node bigint, blob string, features double, domain string, lang_pred string")

WORDS = "the quick brown fox jumps over a lazy dog while seven wizards brew potent tea near old stone bridges every cold winter morning".split()


def prose(seed, n, stop=9):
    import random
    rng = random.Random(seed)
    out = []
    for k in range(n):
        out.append(rng.choice(WORDS) + str(rng.randrange(40)) + ("." if k % stop == stop - 1 else ""))
    return " ".join(out)


def awkward():
    """doc_id, text of rows with nulls, empties, ties, repeats and a long text."""
    base = prose(1, 60)
    return [
        (1, base), (2, base), (2, base), (3, base.upper()), (4, None), (5, ""), (6, " \n\t "), (7, "word"), (8, "word"), (9, "...!! 123 --"),
        (10, prose(2, 30_000)), (11, base + " " + prose(3, 6)), (12, prose(4, 50)), (None, prose(5, 40)), (None, None), (13, "é ü 日本語 \U0001f600 x"),
        (14, "a " * 500), (15, prose(6, 30) + "\n" + prose(6, 30) + "\n" + prose(6, 30)),
    ]


def frame(spark, rows):
    """The rows as documents with further columns whose names clash with those that operators make."""
    full = [(i, t, "en" if k % 5 else None, "src0" if k % 3 else None, None if t is None else len(t), 0.5, True, k % 2, 1, 2.0, "x", "w", 3, "b", 0.1, "d", "zz") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text)


def shingles(text, width=5):
    """Set of the word shingles of a text."""
    w = [lower(x) for x in words(text)]
    if not w:
        return set()
    return {tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))}


def classes(ids, linked):
    """Smallest member of each id's component."""
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}
