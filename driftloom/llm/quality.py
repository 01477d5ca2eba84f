"""Quality rules: a threshold table compiled into one projection of built-in functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.llm.common import SPACE, free_name, let, text_of, words_of

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on", "not", "are", "this", "or", "from", "an", "at",
    "der", "die", "das", "und", "den", "von", "zu", "mit", "ist", "ein", "eine", "nicht", "des", "auf", "im",
    "le", "la", "les", "et", "un", "une", "que", "est", "pour", "qui", "dans", "du", "ou", "pas",
    "el", "los", "las", "y", "en", "por", "con", "su", "no", "se", "lo", "del", "una", "de",
)


@dataclass(frozen=True)
class Rule:
    """A document breaks the rule if its metric lies outside [low, high]; the rule holds from min_words words on."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None
    min_words: int = 0


#: The production thresholds.
RULES = (
    Rule("word_length", "mean_word_length", 2, 20),
    Rule("symbols", "symbol_ratio", None, 0.1),
    Rule("exclamations", "exclamation_ratio", None, 0.3),
    Rule("capitals", "capital_ratio", None, 0.6),
    Rule("stop_words", "stop_word_ratio", 0.01, None, 100),
    Rule("duplicate_lines", "duplicate_line_ratio", None, 0.5, 20),
    Rule("ellipses", "ellipsis_line_ratio", None, 0.6, 20),
)


def _repeat_words(words: Column, window: int) -> Column:
    """Words that lie in a window of so many words found twice or more in the text."""

    def covered(hashes: Column) -> Column:
        order = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts_of(found: Column) -> Column:
            same = lambda j, e: F.coalesce(F.get(found, j)["h"] == e["h"], F.lit(False))
            return F.array_sort(F.transform(F.filter(found, lambda e, j: same(j - 1, e) | same(j + 1, e)), lambda e: e["i"]))

        def total(starts: Column) -> Column:
            widths = F.transform(starts, lambda s, j: F.least(F.lit(window), F.coalesce(F.get(starts, j + 1) - s, F.lit(window))))
            return F.aggregate(widths, F.lit(0).cast("long"), lambda a, x: a + x)

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(let(order, starts_of), total))

    def counted(own: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(own) - window)
        hashes = F.transform(at, lambda i: F.xxhash64(*[F.get(own, i + k) for k in range(window)]))
        return F.when(F.size(own) > window, let(hashes, covered)).otherwise(F.lit(0).cast("long"))

    return counted(words)


def quality_metrics(docs: DataFrame, text_col: str = "text", window: int = 5) -> DataFrame:
    """docs with a struct column `quality` of counts and ratios of every whole text.

    A null text has no words, as an empty one. Ratios over no words, letters or lines are 0. Other columns pass through; an
    existing column `quality` is replaced.
    """
    return docs.withColumn("quality", _measured(text_of(text_col), window))


def _measured(text: Column, window: int) -> Column:
    return let(words_of(text), lambda words: let(F.split(text, "\n"), lambda lines: _metrics(text, words, lines, window)))


def _metrics(text: Column, words: Column, lines: Column, window: int) -> Column:
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("long")
    size = lambda array: F.size(array).cast("long")
    full_lines = F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counts = F.struct(
        size(words).alias("n_words"),
        (F.char_length(text) - count(SPACE)).cast("long").alias("word_chars"),
        count("[#*$%&|<>]").alias("n_symbols"),
        let(full_lines, lambda x: size(x) - size(F.array_distinct(x))).alias("n_dup_lines"),
        _repeat_words(words, window).alias("n_repeat_words"),
        size(full_lines).alias("n_lines"),
        size(F.filter(words, lambda w: F.lower(w).isin(*STOP_WORDS))).alias("n_stop_words"),
        count("!").alias("n_exclamations"),
        count("[A-Z]").alias("n_capitals"),
        count("[a-z]").alias("n_small_letters"),
        size(F.filter(lines, lambda x: x.rlike(r"(?:\.\.\.|\x{2026})[\x20\x09-\x0D]*$"))).alias("n_ellipsis_lines"),
    )

    def with_ratios(c: Column) -> Column:
        share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
        return F.struct(
            *[c[n].alias(n) for n in names],
            share(c["word_chars"], c["n_words"]).alias("mean_word_length"),
            share(c["n_symbols"], c["n_words"]).alias("symbol_ratio"),
            share(c["n_exclamations"], c["n_words"]).alias("exclamation_ratio"),
            share(c["n_capitals"], c["n_capitals"] + c["n_small_letters"]).alias("capital_ratio"),
            share(c["n_stop_words"], c["n_words"]).alias("stop_word_ratio"),
            share(c["n_dup_lines"], c["n_lines"]).alias("duplicate_line_ratio"),
            share(c["n_ellipsis_lines"], c["n_lines"]).alias("ellipsis_line_ratio"),
        )

    return let(counts, with_ratios)


def compile_rules(rules: tuple[Rule, ...], metrics: Column) -> Column:
    """The array of the names of the broken rules, as one expression."""

    def broken(rule: Rule) -> Column:
        x = metrics[rule.metric]
        tests = [t for t in (None if rule.low is None else x < rule.low, None if rule.high is None else x > rule.high) if t is not None]
        return (metrics["n_words"] >= rule.min_words) & (tests[0] if len(tests) == 1 else tests[0] | tests[1])

    return F.array_compact(F.array(*[F.when(broken(r), F.lit(r.name)) for r in rules]))


def verdict(text: Column, rules: tuple[Rule, ...] = RULES, min_words: int = 10, repeat_percent: int = 20, window: int = 5) -> Column:
    """A struct (quality, base_failed, broken_rules, kept) of a text, as one expression that counts it once.

    Whatever names a field of it, a filter among them, copies this expression once and not the counts of every rule.
    """

    def ruled(q: Column) -> Column:
        failed = (q["n_words"] < min_words) | (100 * q["n_repeat_words"] > repeat_percent * q["n_words"])
        whole = F.struct(q.alias("quality"), failed.alias("base_failed"), compile_rules(rules, q).alias("broken_rules"))
        return let(whole, lambda w: F.struct(*[w[c].alias(c) for c in ("quality", "base_failed", "broken_rules")], (~w["base_failed"] & (F.size(w["broken_rules"]) == 0)).alias("kept")))

    return let(_measured(text, window), ruled)


def judge(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, min_words: int = 10, repeat_percent: int = 20) -> DataFrame:
    """docs with `quality` (counts and ratios), `base_failed`, `broken_rules` and `kept`.

    base_failed: fewer than min_words words, or more than repeat_percent of them in repeated windows. kept: neither that nor a
    broken rule. Nulls are texts without words and fail; repeated rows get equal verdicts; other columns pass through, earlier
    ones of these four names are replaced. No shuffle and no user function: one scan, one projection, and under a filter on
    `kept` one evaluation of the verdict.
    """
    whole = free_name("verdict_", docs)
    out = docs.withColumn(whole, verdict(text_of(text_col), rules, min_words, repeat_percent))
    return out.withColumns({c: F.col(f"{whole}.{c}") for c in ("quality", "base_failed", "broken_rules", "kept")}).drop(whole)
