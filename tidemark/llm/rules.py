"""Quality rules as a short-circuit cascade.

Each rule is a cheap or dear column test that rejects a text. On a sample the share
that a rule rejects and the time it takes are measured; the cascade then asks the
rules in order of rejection per cost and stops at the first that rejects, so most
bad texts never reach the dear tests. The order changes the work, never the verdict.

Everything is column expressions: no Python runs in tasks and nothing is shuffled.
Windows of three words are compared by 64-bit hashes of their words.

Defined results: a null text counts as empty (no words); document ids are carried as
they are, null or repeated, one row out for each row in; an empty table gives an
empty result; further columns of the input are not read.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.once import evaluate_once

# The separators of words and the marks that count as symbols.
SEPARATORS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"

MIN_WORDS = 50
#: Documents that the costs are measured on, and the longest that may be among them. Only
#: the order of the rules depends on them; they reach the driver, so their size is bounded.
SAMPLE_ROWS = 1_000
SAMPLE_CHARS = 20_000


@dataclass(frozen=True)
class Rule:
    """Rejects a text where `bad` holds; reads the columns that `measure` gives and `text`."""

    name: str
    bad: Column


def _share(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1))


def _kept_chars(keep: str) -> Column:
    """Number of characters matching a class."""
    return F.length(F.regexp_replace("text", f"[^{keep}]", ""))


def production_rules() -> list[Rule]:
    n, text = F.col("n_words"), F.col("text")
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    words = F.array_remove(F.split(text, r"[ \t-\r]+"), "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^ \t-\r]"))
    return [
        Rule("word_length", ~_share(F.col("word_chars"), n).between(3, 10)),
        Rule("symbols", _share(F.col("n_symbols"), n) > 0.1),
        Rule("repeated_lines", _share(F.col("n_dup_lines"), F.size(lines)) > 0.34),
        Rule("repeated_words", _share(F.col("n_repeat_words"), n) > 0.3),
        Rule("shouting", _share(_kept_chars(r"\p{Lu}"), letters) > 0.4),
        Rule("exclamation", _share(_kept_chars("!"), n) > 0.2),
        Rule("letters", _share(F.size(F.filter(words, lambda w: w.rlike(r"\p{L}"))), n) < 0.7),
        Rule("line_ends", _share(F.size(F.filter(lines, lambda s: s.rlike(r"[.!?:;…]['\")»\]]*[ \t-\r]*\z"))), F.size(lines)) < 0.12),
    ]


def measure(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    rows = evaluate_once(rows.withColumn("words", F.array_remove(F.split("text", r"[ \t-\r]+"), "")))
    rows = rows.withColumn("n_words", F.size("words").cast("long"))

    windows = F.when(
        F.col("n_words") >= 4,
        F.transform(
            F.sequence(F.lit(0), F.size("words") - 3),
            lambda i: F.xxhash64(
                F.get(F.col("words"), i), F.get(F.col("words"), i + 1), F.get(F.col("words"), i + 2)
            ),
        ),
    ).otherwise(F.array().cast("array<long>"))
    rows = evaluate_once(rows.select("doc_id", "text", "n_words", windows.alias("windows")))

    # Sorted by hash, a window found twice stands beside its equal.
    placed = F.when(
        F.size(F.array_distinct("windows")) < F.size("windows"),
        F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("at")))),
    )
    rows = evaluate_once(rows.select("doc_id", "text", "n_words", placed.alias("placed")))
    twins = F.zip_with(
        F.slice("placed", 1, F.size("placed") - 1),
        F.slice("placed", 2, F.size("placed") - 1),
        lambda a, b: F.when(a["h"] == b["h"], F.array(a["at"], b["at"])),
    )
    starts = F.sort_array(F.array_distinct(F.flatten(F.array_compact(twins))))
    rows = evaluate_once(rows.select("doc_id", "text", "n_words", starts.alias("starts")))
    # A window covers three words, or as many as lie before the next window.
    covered = F.aggregate(
        F.zip_with("starts", F.slice("starts", 2, F.size("starts")), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3)))),
        F.lit(0).cast("long"),
        lambda total, n: total + n,
    )
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^ \t-\r]"))
    rows = evaluate_once(
        rows.select(
            "doc_id",
            "text",
            "n_words",
            F.length(F.translate("text", SEPARATORS, "")).cast("long").alias("word_chars"),
            (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
            lines.alias("lines"),
            F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        )
    )
    dups = F.size("lines") - F.size(F.array_distinct("lines"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.select(
        "doc_id",
        "text",
        "n_words",
        "word_chars",
        "n_symbols",
        dups.cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        failed.alias("base_failed"),
    )


def sample_documents(docs: DataFrame, rows: int) -> DataFrame:
    """The first documents of a bounded length, read from as few partitions as hold them."""
    short = docs.filter(F.length("text") <= SAMPLE_CHARS).limit(rows).collect()
    return docs.sparkSession.createDataFrame(short, docs.schema)


def rule_order(measured: DataFrame, rules: list[Rule]) -> list[tuple[Rule, float, float]]:
    """Rules with their share of rejections and seconds on a sample, best first.

    `measured` is what `measure` gives for the sample. Ties keep the given order.
    """
    sample = measured.cache()
    try:
        total = max(sample.count(), 1)
        shares = sample.select([F.count_if(rule.bad).alias(rule.name) for rule in rules]).first()
        timed = []
        for rule in rules:
            began = time.perf_counter()
            sample.select(F.count_if(rule.bad)).first()
            timed.append((rule, shares[rule.name] / total, time.perf_counter() - began))
    finally:
        sample.unpersist()
    return sorted(timed, key=lambda r: -r[1] / max(r[2], 1e-6))


def verdict(rules: list[Rule]) -> Column:
    """Name of the first rule that rejects, or null; later rules are not evaluated."""
    chain = F.when(F.col("base_failed"), F.lit("base"))
    for rule in rules:
        chain = chain.when(rule.bad, F.lit(rule.name))
    return chain


def judge_documents(
    docs: DataFrame,
    rules: list[Rule] | None = None,
    *,
    sample_rows: int = SAMPLE_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """What `measure` gives, the rejecting rule (null if none) and `kept`."""
    rules = production_rules() if rules is None else rules
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    order = rule_order(measure(sample_documents(docs, sample_rows)), rules)
    measured = measure(docs)
    judged = measured.withColumn("rejected_by", verdict([rule for rule, _, _ in order]))
    return judged.withColumn("kept", F.col("rejected_by").isNull())
