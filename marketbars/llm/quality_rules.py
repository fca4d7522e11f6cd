"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Cases: null or empty text has no words and fails the base rule; an empty table gives an empty result; repeated rows
and repeated ids each get their own row; columns of the input other than doc_id and text are not looked at, so
clashing names do no harm. A text is measured whole, however long.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS

SYMBOLS = "#*$%&|<>"
ENDS = ".,;:!?"

#: Frequent function words of English, German, Spanish and French.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "have", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with",
    "auf", "das", "dem", "den", "der", "die", "ein", "eine", "für", "im", "ist", "mit", "nicht", "sich", "und", "von", "zu",
    "con", "de", "del", "el", "en", "es", "la", "las", "los", "no", "para", "por", "que", "se", "un", "una", "y",
    "au", "avec", "dans", "des", "du", "elle", "est", "et", "il", "le", "les", "par", "pas", "pour", "qui", "sur", "une",
)


class Rule(NamedTuple):
    """Fails a text of at least `from_words` words whose metric is under `least` or over `most`."""

    name: str
    metric: str
    least: float | None = None
    most: float | None = None
    from_words: int = 0


#: The threshold table. The metrics are columns of measure().
RULES = (
    Rule("too_few_words", "n_words", least=10),
    Rule("repeated_words", "repeat_word_ratio", most=0.20),
    Rule("word_length", "mean_word_chars", least=2.5, most=12),
    Rule("symbols", "symbol_ratio", most=0.10),
    Rule("stop_words", "stop_word_ratio", least=0.02, from_words=30),
    Rule("duplicate_lines", "dup_line_ratio", most=0.30, from_words=100),
    Rule("bullets", "bullet_ratio", most=0.90),
    Rule("ellipses", "ellipsis_ratio", most=0.30),
)
BASE = ("too_few_words", "repeated_words")
WINDOW = 5


def _bind(value: Column, body) -> Column:
    """body(value), with value computed once although body uses it many times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated(words: Column, n: Column) -> Column:
    """Words that lie in a window of five which occurs twice or more. Hashes rule out most texts; the rest compare strings."""
    at = F.sequence(F.lit(0), n - WINDOW)
    hashes = F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))
    windows = F.array_sort(F.transform(at, lambda i: F.struct(F.concat_ws(" ", F.slice(words, i + 1, WINDOW)).alias("w"), i.alias("i"))))

    def starts(s: Column) -> Column:
        same = F.filter(F.sequence(F.lit(1), n - WINDOW), lambda j: F.get(s, j)["w"] == F.get(s, j - 1)["w"])
        return F.array_sort(F.array_distinct(F.flatten(F.transform(same, lambda j: F.array(F.get(s, j)["i"], F.get(s, j - 1)["i"])))))

    covered = F.aggregate(
        _bind(windows, starts),
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
        lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(WINDOW), i - s["last"])).alias("n")),
        lambda s: s["n"],
    )
    plain = _bind(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h))
    return F.when(n <= WINDOW, 0).when(plain, 0).otherwise(covered)


def measure(docs: DataFrame, stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """doc_id and the counts and ratios that rules may name."""
    text = F.coalesce("text", F.lit(""))
    df = docs.select("doc_id", text.alias("t"), F.btrim(text, F.lit(BLANKS)).alias("b"))
    df = df.select("doc_id", "t", F.when(F.col("b") == "", F.array().cast("array<string>")).otherwise(F.split("b", r"[ \t\n\x0B\f\r]+")).alias("words"),
                   F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "").alias("lines"))
    count = lambda c: c.cast("long")
    words, lines, n = F.col("words"), F.col("lines"), F.size("words")
    df = df.select(
        "doc_id",
        count(n).alias("n_words"),
        count(F.length(F.translate("t", BLANKS, ""))).alias("word_chars"),
        count(F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).alias("n_symbols"),
        count(F.size("lines")).alias("n_lines"),
        count(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        count(_repeated(words, n)).alias("n_repeat_words"),
        count(F.size(F.filter(words, lambda w: F.lower(F.rtrim(w, F.lit(ENDS))).isin(*stop_words)))).alias("n_stop_words"),
        count(F.size(F.filter(lines, lambda x: F.ltrim(x).rlike("^[-*•]")))).alias("n_bullets"),
        count(F.size(F.filter(lines, lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…")))).alias("n_ellipses"),
    )
    ratio = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    return df.select(
        "*",
        ratio("word_chars", "n_words").alias("mean_word_chars"),
        ratio("n_symbols", "n_words").alias("symbol_ratio"),
        ratio("n_stop_words", "n_words").alias("stop_word_ratio"),
        ratio("n_repeat_words", "n_words").alias("repeat_word_ratio"),
        ratio("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        ratio("n_bullets", "n_lines").alias("bullet_ratio"),
        ratio("n_ellipses", "n_lines").alias("ellipsis_ratio"),
    )


def _fails(r: Rule) -> Column:
    # the base ratio in whole numbers, so that 20 % itself is no matter of rounding
    if r.metric == "repeat_word_ratio":
        out = 100 * F.col("n_repeat_words") > round(100 * r.most) * F.col("n_words")
    else:
        m = F.col(r.metric)
        sides = [m < r.least] * (r.least is not None) + [m > r.most] * (r.most is not None)
        out = sides[0] if len(sides) == 1 else sides[0] | sides[1]
    return out & (F.col("n_words") >= r.from_words) if r.from_words else out


def judge(measured: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Adds base_failed, kept and failed_rules (names, in the table's order)."""
    base = F.lit(False)
    for r in rules:
        base = base | _fails(r) if r.name in BASE else base
    failed = F.filter(F.array(*[F.when(_fails(r), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())
    return measured.select("*", base.alias("base_failed"), failed.alias("failed_rules")).select("*", (F.size("failed_rules") == 0).alias("kept"))


def quality_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """One row per document: all metrics, base_failed, failed_rules and kept."""
    return judge(measure(docs, stop_words), rules)


def passing(docs: DataFrame, rules: Sequence[Rule] = RULES, stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """The rows of docs, all columns, whose text no rule fails. The text rides along, so nothing is joined."""
    names = docs.columns
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc_id"), "text")
    # a filter on kept would be pushed below the projections and compute every metric again for each use
    some = judge(measure(whole, stop_words), rules).select(F.explode_outer(F.array(F.when(F.col("kept"), F.col("doc_id")))).alias("d"))
    return some.where("d IS NOT NULL").select("d.*")


def op7(docs: DataFrame) -> DataFrame:
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
