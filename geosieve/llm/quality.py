"""Quality rules, line first: lines that break a rule go, then documents that lose too much text.

Only DataFrame functions are used. A line breaks a rule if it

* has several words but no sentence punctuation at all (``punctuation``),
* is a menu: several separators such as ``|``, or only a usual link name (``navigation``),
* is a short line with a usual boilerplate phrase (``boilerplate``),
* is full of symbols, has no lower-case letter, or is one word over and over (``symbols``, ``capitals``, ``repeats``).

A null text has no words, no lines and fails. Very long texts are judged whole, as arrays of their lines; repeated rows are
judged each, no rows give no rows. Columns of the input other than the key and the text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geosieve.llm.common import SPACE

WORD_GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
SEPARATORS = "|»›•·"
PUNCTUATION = ".!?;:,…。！？"
LINK_NAMES = ("home|menu|login|log in|sign in|sign up|register|search|contact|contact us|about|about us|next|previous|"
              "back|share|print|comments|read more|help|faq|sitemap")
BOILERPLATE = ("all rights reserved|privacy policy|terms of (use|service)|cookie|javascript|lorem ipsum|"
               "click here|subscribe to|newsletter|copyright ©")
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MAX_LOST_PERCENT = 50
WINDOW = 5


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def words_of(text: Column) -> Column:
    bare = F.trim(text, F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WORD_GAP))


def line_fails(line: Column) -> Column:
    """Whether a line with words breaks a rule; lines without a word never do."""
    # a gap after a trimmed line's words is a word's end, so this counts words without making an array
    bare = F.trim(line, F.lit(SPACE))
    n_words = F.size(F.split(bare, WORD_GAP))
    size = F.length(line)
    several = n_words >= 4
    punctuation = several & (_count(line, PUNCTUATION) == 0)
    navigation = (_count(line, SEPARATORS) >= 3) | bare.rlike(f"(?i)^({LINK_NAMES})$")
    boilerplate = (size <= 200) & line.rlike(f"(?i)({BOILERPLATE})")
    symbols = _count(line, SYMBOLS) * 10 >= size
    capitals = several & (F.lower(line) != line) & (F.upper(line) == line)
    repeats = (n_words >= 10) & (F.size(F.array_distinct(F.split(bare, WORD_GAP))) * 4 <= n_words)
    return (bare != "") & (navigation | symbols | punctuation | boilerplate | capitals | repeats)


def _windows(words: Column, hashes: Column, n: Column) -> tuple[Column, Column]:
    """Hashes of the windows, and the windows themselves, sorted.

    Hashes tell texts without repeats apart; only for the others the windows themselves are sorted and compared.
    """
    starts = F.sequence(F.lit(0), n - WINDOW)
    hashed = F.transform(starts, lambda i: F.xxhash64(*[hashes[i + k] for k in range(WINDOW)]))
    whole = F.sort_array(F.transform(starts, lambda i: F.struct(
        F.array_join(F.slice(words, i + 1, WINDOW), " ").alias("w"), i.alias("i"))))
    return F.when(n >= WINDOW, hashed).alias("_hashed"), whole


def quality_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", max_lost_percent: int = MAX_LOST_PERCENT
                  ) -> DataFrame:
    """One row per row of ``docs``: the key, counts, the cleaned text, and the verdict.

    Columns: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_removed_lines, n_lost_chars,
    base_failed, kept, cleaned. A null text counts as an empty one and fails.
    """
    c = F.col
    rows = docs.select(c(key), F.coalesce(c(text), F.lit("")).alias("_text"))
    rows = rows.select(key, "_text", words_of(c("_text")).alias("_words"),
                       F.split(c("_text"), "\n", -1).alias("_lines"))
    rows = rows.select(
        key, "_text", "_words", "_lines", F.size("_words").cast("long").alias("n_words"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
        F.filter("_lines", lambda x: F.trim(x, F.lit(SPACE)) != "").alias("_full"),
        F.filter("_lines", lambda x: ~line_fails(x)).alias("_good"))
    n = c("n_words").cast("int")
    hashed, whole = _windows(c("_words"), c("_hashes"), n)
    rows = rows.select(
        key, "_text", "_words", "n_words", hashed,
        F.length(F.translate("_text", SPACE, "")).cast("long").alias("word_chars"),
        _count(c("_text"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("_full") - F.size(F.array_distinct("_full"))).cast("long").alias("n_dup_lines"),
        F.size("_full").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size("_good")).cast("long").alias("n_removed_lines"),
        F.array_join("_good", "\n").alias("cleaned"))
    rows = rows.withColumn("_sorted", F.when(
        (n >= WINDOW) & (F.size(F.array_distinct("_hashed")) < F.size("_hashed")), whole))
    s = c("_sorted")
    again = F.sort_array(F.transform(F.filter(
        s, lambda x, j: F.get(s, j - 1)["w"].eqNullSafe(x["w"]) | F.get(s, j + 1)["w"].eqNullSafe(x["w"])),
        lambda x: x["i"]))
    rows = rows.withColumn("_again", again)
    a = c("_again")
    # each repeated window adds what the next one does not cover
    covered = F.aggregate(
        F.transform(a, lambda i, j: F.least(F.lit(WINDOW), F.coalesce(F.get(a, j + 1) - i, F.lit(WINDOW)))),
        F.lit(0), lambda x, y: x + y)
    rows = rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    lost = c("word_chars") - F.length(F.translate("cleaned", SPACE, ""))
    rows = rows.withColumn("n_lost_chars", lost.cast("long")).withColumn(
        "base_failed", (c("n_words") < MIN_WORDS) | (c("n_repeat_words") * 100 > c("n_words") * MAX_REPEAT_PERCENT))
    return rows.select(
        key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_removed_lines",
        "n_lost_chars", "base_failed",
        (~c("base_failed") & (c("n_lost_chars") * 100 <= c("word_chars") * max_lost_percent)).alias("kept"), "cleaned")
