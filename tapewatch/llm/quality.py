"""Quality rules as a short-circuit cascade, in built-in functions only.

Each rule is a predicate of the text alone.  ``order_rules`` measures on a sample of
documents what a rule costs and how much it rejects, and puts the rules with the most
rejection per cost first.  ``first_failure`` is one conditional expression in that order:
a document that a rule rejects never reaches the rules after it.  The order decides only
what is computed and which failing rule gets named; which documents pass doesn't depend on it.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F

from tapewatch.llm.columns import WORD_CHARACTER, Carried, bind, pick, words

# Fixed values of the contract.
MIN_WORDS = 10
WINDOW = 5
MAX_REPEATED_PERCENT = 20
SYMBOLS = r"[#*$%&|<>]"

# Documents in the sample that orders the rules.
SAMPLE_ROWS = 256


def repeat_words(w: Column) -> Column:
    """Words in windows of five words that occur twice or more in the array ``w``.

    Windows are compared by 64-bit hash.  Texts whose hashes all differ, most of them,
    need no sort.  For the others the hashes are sorted with their places; each place of
    a repeated window covers five words, less what the next such place covers.
    """
    hashes = F.transform(
        F.sequence(F.lit(0), F.size(w) - WINDOW),
        lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW))))

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        places = bind(placed, lambda p: F.sort_array(F.transform(
            F.filter(p, lambda x, k: F.coalesce(x["h"] == F.get(p, k + 1)["h"], F.lit(False))
                     | F.when(k > 0, x["h"] == F.get(p, k - 1)["h"]).otherwise(False)),
            lambda x: x["i"])))
        return bind(places, lambda at: F.aggregate(
            F.transform(at, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - x, F.lit(WINDOW)))),
            F.lit(0).cast("long"), lambda total, x: total + x))

    counted = bind(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long"))
                   .otherwise(covered(h)))
    return F.when(F.size(w) > WINDOW, counted).otherwise(F.lit(0).cast("long"))


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: line.rlike(WORD_CHARACTER))


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return bind(lines_with_words(text), lambda lines: F.size(lines) - F.size(F.array_distinct(lines)))


def symbols(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(SYMBOLS))


@dataclass(frozen=True)
class Rule:
    """``fails``: from the text column to a boolean that is true for texts to reject."""

    name: str
    fails: Callable[[Column], Column]
    rejected: float = 0.0
    seconds: float = 1.0

    @property
    def worth(self) -> float:
        return self.rejected / max(self.seconds, 1e-6)


def _few(text: Column) -> Column:
    return F.size(words(text)) < MIN_WORDS


def _repeats(text: Column) -> Column:
    return bind(words(text), lambda w: repeat_words(w) * 100 > F.size(w) * MAX_REPEATED_PERCENT)


def _symbols(text: Column) -> Column:
    return symbols(text) * 10 > F.size(words(text))


def _lines(text: Column) -> Column:
    return bind(lines_with_words(text), lambda x: (F.size(x) - F.size(F.array_distinct(x))) * 2 > F.size(x))


def _wordless(text: Column) -> Column:
    return bind(words(text), lambda w: F.size(F.filter(w, lambda x: x.rlike(r"\p{L}"))) * 10 < F.size(w) * 7)


def _shouting(text: Column) -> Column:
    """Over half of the letters that have both cases are capitals."""
    t = F.coalesce(text, F.lit(""))
    return F.regexp_count(t, F.lit(r"\p{Lu}")) > F.regexp_count(t, F.lit(r"\p{Ll}"))


def _word_length(text: Column) -> Column:
    return bind(words(text), lambda w: (F.length(F.array_join(w, "")) > F.size(w) * 15)
                | (F.length(F.array_join(w, "")) < F.size(w) * 2))


BASE = (Rule("few_words", _few), Rule("repeated_windows", _repeats))
RULES = (
    *BASE,
    Rule("symbols", _symbols),
    Rule("repeated_lines", _lines),
    Rule("words_without_letters", _wordless),
    Rule("capitals", _shouting),
    Rule("word_length", _word_length),
)


def order_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text",
                sample_rows: int = SAMPLE_ROWS) -> tuple[Rule, ...]:
    """The rules with their share of rejected documents and seconds on a sample, best first.

    The sample is the first ``sample_rows`` documents that Spark returns, a bound that doesn't
    grow with the table; only its digest, never a verdict, depends on it.  An empty table
    leaves the rules as they are.
    """
    spark = docs.sparkSession
    drawn = pick(docs, text=text).limit(sample_rows).collect()
    if not drawn:
        return rules
    sample = spark.createDataFrame(drawn, "text string").coalesce(1)
    column, measured = F.col("text"), []
    for rule in rules:
        begun = time.perf_counter()
        failed = sample.select(F.count_if(rule.fails(column))).head()[0]
        measured.append(replace(rule, rejected=failed / len(drawn), seconds=time.perf_counter() - begun))
    return tuple(sorted(measured, key=lambda r: -r.worth))


def first_failure(text: Column, rules: tuple[Rule, ...]) -> Column:
    """Name of the first rule that rejects the text, null if none does; later rules don't run."""
    verdict = F.lit(None).cast("string")
    for rule in reversed(rules):
        verdict = F.when(rule.fails(text), F.lit(rule.name)).otherwise(verdict)
    return verdict


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The documents that pass every rule, with all their columns, repeated rows included.

    A null or empty text has no words and goes.  No shuffle.
    """
    all_columns = Carried(docs)
    ordered = order_rules(docs, rules, text)
    return all_columns.back(all_columns.df.where(first_failure(all_columns[text], ordered).isNull()))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts and verdict for each row; columns doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, failed_rule.

    A null text counts as empty.  Ids may be null or repeat; each row gets its own verdict.
    The counts of the base rules are needed in full here; the further rules run in their
    measured order, and only for documents that pass the base.
    """
    extra = order_rules(docs, tuple(r for r in rules if r not in BASE), text)
    w = F.col("w")
    counted = (
        pick(docs, doc_id=doc_id, text=text)
        .select("doc_id", "text", words(F.col("text")).alias("w"))
        .select(
            "doc_id", "text",
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            symbols(F.col("text")).cast("long").alias("n_symbols"),
            duplicate_lines(F.col("text")).cast("long").alias("n_dup_lines"),
            repeat_words(w).alias("n_repeat_words"))
    )
    failed = (F.col("n_words") < MIN_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED_PERCENT)
    base = F.when(F.col("n_words") < MIN_WORDS, F.lit(BASE[0].name)).otherwise(F.lit(BASE[1].name))
    return (
        counted.withColumn("base_failed", failed)
        .withColumn("failed_rule", F.when(F.col("base_failed"), base).otherwise(first_failure(F.col("text"), extra)))
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                F.col("failed_rule").isNull().alias("kept"), "failed_rule")
    )
