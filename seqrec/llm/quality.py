"""Line-first cleaning: rules judge every line, failing lines go, and a text that loses too much of itself is rejected.

DataFrame functions only.  Words are runs of characters other than 0x20 and 0x09-0x0D, lines are split at \\n.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
#: Marks that part the entries of a menu, standing alone.
SEPARATOR = r"(?:^|[\x20\x09-\x0D])[|»›•·/>:~-]{1,2}(?=[\x20\x09-\x0D]|$)"
STOP = r"[.!?…:;,。！？]"
#: Entries that make up a menu line on their own.
MENU = r"(?i)^[\x20\x09-\x0D]*(?:home|menu|login|log in|sign in|sign up|register|next|previous|back to top|skip to content|search|contact us|about us|sitemap|share|print|read more)[\x20\x09-\x0D.!|»›]*$"
BOILERPLATE = (r"(?i)all rights reserved|licensed under the|copyright (?:\(c\)|©|[0-9]{4})|terms of (?:use|service)|privacy policy|cookie (?:policy|settings)"
               r"|(?:enable|requires?) javascript|subscribe to our newsletter|click here to")


@dataclass(frozen=True)
class LineRules:
    """Limits of the line rules; a share is per word of the line."""

    separators: float = 0.2
    symbols: float = 0.5
    shouts: float = 0.5
    rule_words: int = 4
    stopless_words: int = 12


def _count(text: Column, pattern: str) -> Column:
    return F.size(F.split(text, pattern, -1)) - 1


def words_of(text: Column) -> Column:
    """The words of a text as an array."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def failing_rule(line: Column, rules: LineRules = LineRules()) -> Column:
    """Name of the first rule that a line fails, null if it passes or holds no word.

    navigation: separators stand between its words, or it is a menu entry; boilerplate: a phrase of licences, cookies and
    the like; symbols: too many of # * $ % & | < >; shouting: most words end in a run of !; punctuation: a long line
    without a single punctuation mark.
    """
    words = _count(F.trim(F.regexp_replace(line, SPACE, " ")), " ") + 1
    long = words >= rules.rule_words
    return F.when(~line.rlike(WORD), F.lit(None).cast("string")).when(
        (line.rlike(SEPARATOR) & (_count(line, SEPARATOR) >= rules.separators * words) & (_count(line, SEPARATOR) >= 2)) | line.rlike(MENU), "navigation").when(
        line.rlike(BOILERPLATE), "boilerplate").when(
        long & line.rlike(SYMBOLS) & (_count(line, SYMBOLS) >= rules.symbols * words), "symbols").when(
        long & line.rlike("!!") & (_count(line, "!!+") >= rules.shouts * words), "shouting").when(
        ~line.rlike(STOP) & (words >= rules.stopless_words), "punctuation")


def repeated_words(words: str, width: int) -> list[tuple[str, Column]]:
    """Steps (column name, expression) that end in `n_repeat_words`, each reading the one before.

    Windows are hashed, sorted with their places and compared with their neighbours, so that a text of n words takes n log n.
    """
    n = F.size(words)
    return [
        ("_windows", F.when(n >= width, F.transform(F.sequence(F.lit(1), F.greatest(n - (width - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, width)))).otherwise(F.array().cast("array<bigint>"))),
        ("_sorted", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))),
        ("_again", F.filter("_sorted", lambda x, k: F.coalesce(F.get("_sorted", k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("_sorted", k + 1)["h"] == x["h"], F.lit(False)))),
        ("_places", F.sort_array(F.transform("_again", lambda x: x["i"]))),
        ("n_repeat_words", F.aggregate(F.transform("_places", lambda p, k: F.least(F.lit(width), F.coalesce(F.get("_places", k + 1) - p, F.lit(width)))), F.lit(0).cast("bigint"), lambda a, x: a + x)),
    ]


def clean(docs: DataFrame, text_col: str = "text", rules: LineRules = LineRules(), window: int = 5, least_words: int = 10,
          most_repeated: float = 0.2, least_left: float = 0.5) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (bigint), base_failed, kept (boolean), n_words_left and clean_text.

    A text fails at once with fewer than `least_words` words or more than `most_repeated` of them in repeated windows.  Otherwise
    lines that fail a rule are removed (clean_text is what remains), and it is kept if at least
    `least_left` of its words and `least_words` of them remain.  A null or empty text has no words and fails.  Existing columns of
    these names are replaced.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_words_left", "clean_text"]
    rest = [c for c in docs.columns if c not in made]
    steps = [
        ("_text", F.coalesce(F.col(text_col).cast("string"), F.lit(""))),
        ("_words", words_of(F.col("_text"))),
        *repeated_words("_words", window),
        ("n_words", F.size("_words").cast("bigint")),
        ("word_chars", F.length(F.array_join("_words", "")).cast("bigint")),
        ("n_symbols", (F.size(F.split("_text", SYMBOLS, -1)) - 1).cast("bigint")),
        ("_lines", F.split("_text", "\n", -1)),
        ("_full", F.filter("_lines", lambda x: x.rlike(WORD))),
        ("n_dup_lines", (F.size("_full") - F.size(F.array_distinct("_full"))).cast("bigint")),
        ("_good", F.filter("_lines", lambda x: failing_rule(x, rules).isNull())),
        ("clean_text", F.array_join("_good", "\n")),
        ("n_words_left", F.when(F.size("_good") == F.size("_lines"), F.col("n_words")).otherwise(F.size(words_of(F.col("clean_text")))).cast("bigint")),
        ("base_failed", (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > 100 * most_repeated * F.col("n_words"))),
        ("kept", ~F.col("base_failed") & (F.col("n_words_left") >= least_left * F.col("n_words")) & (F.col("n_words_left") >= least_words)),
    ]
    out = docs.select(*rest)
    for name, value in steps:
        out = out.withColumn(name, value)
    return out.select(*rest, *made)
