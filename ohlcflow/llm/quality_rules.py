"""Quality rules as a short-circuit cascade (DataFrame functions only).

A document is kept if no rule rejects it.  Which rule is tried first changes the
work, never the verdict, so the order is chosen from data: on a bounded sample every
rule's rejection rate and mean cost (characters or words it has to touch) are
measured, and rules are tried by rejection per cost.  The chain is one CASE
expression, so what a later rule needs is not computed for a document that an
earlier rule has rejected.

Defined results: null or empty text has no words and fails the base rules; text
without a line end is one line; words are compared by value, 3-word windows by a
64-bit hash.  Repeated rows are judged one by one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ohlcflow.llm.common import SPACE_CLASS

#: Rows of the sample on which cost and selectivity are estimated (it only orders the rules).
SAMPLE_ROWS = 2000

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE_CLASS + "+"), lambda w: w != "")


def word_lines(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def characters_of(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are among ``chars``."""
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def windows(words: Column) -> Column:
    """(hash, position) of every 3-word window, in order of hash and position."""
    n = F.size(words)
    at = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    return F.sort_array(F.transform(at, lambda i: F.struct(
        F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("p"))))


def repeated_starts(sorted_windows: Column) -> Column:
    """Ascending starts of the windows whose hash stands beside an equal one."""
    w = sorted_windows
    hit = F.filter(w, lambda x, i: (F.get(w, i - 1)["h"] == x["h"]) | (F.get(w, i + 1)["h"] == x["h"]))
    return F.sort_array(F.transform(hit, lambda x: x["p"]))


def covered_words(starts: Column) -> Column:
    """Words covered by 3-word windows at ascending ``starts``."""
    zero = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(
        starts, zero,
        lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n")),
        lambda acc: acc["n"])


def measure(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and the counts the rules are stated in.

    Arrays are columns of their own steps, each computed once from the one before."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("words", words_of(F.col("text"))).withColumn("lines", word_lines(F.col("text")))
    d = d.withColumn("windows", windows(F.col("words")))
    d = d.withColumn("starts", repeated_starts(F.col("windows")))
    return d.select(
        "doc_id", "text",
        F.size("words").cast("long").alias("n_words"),
        (F.length("text") - F.length(F.translate("text", " \t\n\x0b\x0c\r", ""))).alias("n_space"),
        characters_of(F.col("text"), SYMBOLS).alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered_words(F.col("starts")).alias("n_repeat_words"),
    ).withColumn("word_chars", (F.length("text") - F.col("n_space")).cast("long")).drop("n_space")


@dataclass(frozen=True)
class Rule:
    """``reject`` and ``cost`` (units of text touched) over the columns of ``measure``."""

    name: str
    reject: Callable[[], Column]
    cost: Callable[[], Column]


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)


#: The rules beside the base: shares and means, so they hold for short and long texts alike.
RULES = (
    Rule("symbol_share", lambda: F.col("n_symbols") * 10 > F.col("word_chars"), lambda: F.lit(1)),
    Rule("word_length", lambda: (F.col("word_chars") < F.col("n_words") * 2)
         | (F.col("word_chars") > F.col("n_words") * 20), lambda: F.lit(1)),
    Rule("line_copies", lambda: F.col("n_dup_lines") * 10 > F.col("n_lines") * 3, lambda: F.lit(1)),
    Rule("capitals", lambda: F.length(F.regexp_replace("text", "[^A-Z]", "")) * 2 > F.col("word_chars"),
         lambda: F.length("text")),
    Rule("no_letters", lambda: F.length(F.regexp_replace("text", r"\P{L}", "")) * 2 < F.col("word_chars"),
         lambda: F.length("text") * 2),
    Rule("exclamations", lambda: characters_of(F.col("text"), "!") * 10 > F.col("word_chars"),
         lambda: F.length("text")),
)


def order_rules(measured: DataFrame, rules=RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules by rejection per cost on a sample of about ``sample_rows`` rows, chosen by a hash of the id
    (so the order of the rows does not matter).  Only two means a rule reach the driver."""
    share = sample_rows / max(measured.count(), 1)  # of Parquet: from the files' footers
    chosen = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(min(share, 1.0) * (1 << 20))
    mean = lambda c: F.coalesce(F.avg(c.cast("double")), F.lit(0.0))
    means = measured.filter(chosen).agg(*[mean(r.reject()).alias(f"reject_{r.name}") for r in rules],
                                        *[mean(r.cost()).alias(f"cost_{r.name}") for r in rules]).first()
    score = {r.name: means[f"reject_{r.name}"] / max(means[f"cost_{r.name}"], 1.0) for r in rules}
    return sorted(rules, key=lambda r: (-score[r.name], r.name))


def cascade(measured: DataFrame, rules: list[Rule]) -> DataFrame:
    """Add ``base_failed``, ``failed_rule`` (null if none) and ``kept``; the base comes first."""
    chain = F.when(F.col("base_failed"), F.lit("base"))
    for r in rules:
        chain = chain.when(r.reject(), F.lit(r.name))
    out = measured.withColumn("base_failed", base_failed()).withColumn("failed_rule", chain)
    return out.withColumn("kept", F.col("failed_rule").isNull())


def judge(docs: DataFrame, rules=RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Counts, ``base_failed``, ``failed_rule`` and ``kept`` for every document."""
    measured = measure(docs)
    return cascade(measured, order_rules(measured, rules, sample_rows))
