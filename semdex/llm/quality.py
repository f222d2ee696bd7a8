"""Quality rules as a short-circuit cascade.

Each rule rejects on a cheap or dear measure of the text. On a sample, it is counted which rules each
text fails and timed what each rule costs; the rules then run in falling order of rejections per cost
among what the rules before have passed, each only there (branches of one CASE). The order changes the time a
text takes, never the verdict, which is that no rule rejects.

Everything is a Spark expression. A text's words are split once; repeated windows are found by
sorting 64-bit hashes of the windows within the row, so no row is multiplied and nothing is shuffled.

Defined results: a null or empty text has no words, fails the base rule and is not kept; a text below
five words has no window; equal rows are judged alike; an empty table gives an empty result; columns
other than doc_id and text are not read.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SEPARATOR_CLASS, materialize

#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
SEPARATORS = " \t\n\x0b\f\r"
WINDOW = 5
#: Rows of the sample on which costs and selectivities are estimated, about.
SAMPLE_ROWS = 4000
#: A rule's least cost on the sample; what is below can't be told from noise.
LEAST_SECONDS = 1 / 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def measures(text: Column) -> dict[str, Column]:
    """Base measures that need the text alone."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "_words": F.array_remove(F.split(text, SEPARATOR_CLASS + "+"), ""),
        "word_chars": F.char_length(F.translate(text, SEPARATORS, "")).cast("long"),
        "n_symbols": (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    }


def window_hashes(words: Column) -> Column:
    """A hash of each run of five words, in order; none for fewer words."""
    each = F.transform(words, lambda x: F.xxhash64(x))
    last = F.size(words) - WINDOW
    hashes = let(each, lambda h: F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])))
    return F.when(last >= 0, hashes).otherwise(F.array().cast("array<bigint>"))


def repeated_words(windows: Column) -> Column:
    """Number of words in windows that stand in the text twice or more."""

    def covered(w: Column) -> Column:
        tagged = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(tagged, lambda s: F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"])))
        places = F.sort_array(F.transform(twice, lambda x: x["i"]))
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
        step = lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"))
        return F.aggregate(places, start, step, lambda a: a["n"])

    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(let(windows, covered))


@dataclass(frozen=True)
class Rule:
    """``fails`` is true (never null) for a text to reject; it may use the base measures and _words."""

    name: str
    fails: Column


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def default_rules() -> list[Rule]:
    n, words = F.col("n_words"), F.col("_words")
    share = lambda test: F.size(F.filter(words, test))
    return [
        Rule("symbols", 10 * F.col("n_symbols") > n),
        Rule("word_length", (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 25 * n)),
        Rule("duplicate_lines", F.coalesce(10 * F.col("n_dup_lines") > 3 * F.size(F.split(F.col("text"), "\n")), F.lit(False))),
        Rule("capitals", 10 * share(lambda w: (F.char_length(w) > 1) & (w == F.upper(w)) & (w != F.lower(w))) > 5 * n),
        Rule("letters", 10 * share(lambda w: w.rlike(r"\p{L}")) < 6 * n),
        Rule("exclamations", 10 * share(lambda w: w.endswith("!!")) > 3 * n),
    ]


def with_base(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` with n_words, the four base measures, base_failed and _words."""
    found = measures(F.col("text"))
    rows = docs.withColumns(found)
    rows = rows.withColumns({"n_words": F.size("_words").cast("long"), "_windows": window_hashes(F.col("_words"))})
    return rows.withColumn("n_repeat_words", repeated_words(F.col("_windows"))).withColumn("base_failed", base_failed()).drop("_windows")


def order_rules(docs: DataFrame, rules: Sequence[Rule], sample_rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """(rule, rejected share, seconds on the sample) in the order in which the cascade runs them.

    The sample is an even choice by a hash of the id, about ``sample_rows`` large. A rule's cost is the
    least time of three that it takes on the sample, beyond what a trivial test takes; costs count in
    powers of two, so that noise doesn't change the order. Next comes the rule that rejects most, for
    its cost, of what those before it have passed; its share is of that.
    """
    rows = docs.select("doc_id").count()
    if not rows:
        return [(r, 0.0, 0.0) for r in rules]
    few = docs.select("doc_id", "text").filter(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) < int(1_000_000 * min(1.0, sample_rows / rows)))
    few = materialize(with_base(few), "sample")

    def seconds(test: Column) -> float:
        took = []
        for _ in range(3):
            began = time.perf_counter()
            few.agg(F.count_if(test)).collect()
            took.append(time.perf_counter() - began)
        return min(took)

    # how many texts fail which rules: 2 ** rules rows at most, and no more than the sample has
    fails = few.groupBy(*[r.fails.alias(f"_{i}") for i, r in enumerate(rules)]).agg(F.count(F.lit(1)).alias("_n")).collect()
    trivial = seconds(F.col("n_words") < 0)
    cost = [max(LEAST_SECONDS, seconds(r.fails) - trivial) for r in rules]
    left, out = list(range(len(rules))), []
    while left:
        total = sum(x[-1] for x in fails)
        rejected = {i: sum(x[-1] for x in fails if x[i]) for i in left}
        best = min(left, key=lambda i: (-rejected[i] / 2.0 ** round(math.log2(cost[i])), rules[i].name))  # noqa: B023
        out.append((rules[best], rejected[best] / max(1, total), cost[best]))
        fails = [x for x in fails if not x[best]]
        left.remove(best)
    return out


def judge(docs: DataFrame, rules: Sequence[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The columns of ``docs``, the base measures, base_failed, rejected_by (a rule's name or null) and kept."""
    order = order_rules(docs, default_rules() if rules is None else rules, sample_rows)
    verdict = F.when(F.col("base_failed"), F.lit("base"))
    for rule, _, _ in order:
        verdict = verdict.when(rule.fails, F.lit(rule.name))
    rows = with_base(docs).withColumn("rejected_by", verdict)
    return rows.withColumn("kept", F.col("rejected_by").isNull()).drop("_words")
