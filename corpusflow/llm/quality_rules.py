"""Quality rules: a threshold table compiled into one projection of built-in functions.

Nulls and empty texts have no words and fail the base rule. Extra columns of
the input are ignored; repeated rows are judged one by one. Rows never meet,
so nothing is shuffled and a key that holds a third of the rows costs nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import WORD

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the", "and", "of", "to", "in", "a", "is", "that", "for", "it", "was", "on", "with", "as", "are", "be", "this", "by", "from", "an", "or", "he",
    "de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par", "sur", "pas", "au", "avec",
    "der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine",
    "el", "y", "los", "se", "del", "las", "con", "una", "su", "al", "lo", "como", "para", "no",
)


@dataclass(frozen=True)
class Rule:
    """A metric's allowed range, ends included. ``min_words``: texts below are not judged by it."""

    metric: str
    low: float | None = None
    high: float | None = None
    min_words: int = 0


#: The verdict's threshold table. Metrics are those that ``measure`` returns.
RULES = (
    Rule("mean_word_chars", 2.0, 14.0),
    Rule("symbol_ratio", None, 0.06),
    Rule("stop_ratio", 0.03, None, min_words=30),
    Rule("dup_line_ratio", None, 0.5),
    Rule("short_line_ratio", None, 0.9, min_words=200),
)

_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs``' doc_id and text with the counts of the contract and the ratios of ``RULES``."""
    e = F.expr
    stops = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    return (
        docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("_t"))
        .select("doc_id", "_t", F.regexp_extract_all("_t", F.lit(WORD), F.lit(0)).alias("_w"), F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(WORD)).alias("_l"))
        .withColumn("n_words", F.size("_w").cast("long"))
        .withColumn("_h", e("CASE WHEN size(_w) >= 5 THEN transform(sequence(0, size(_w) - 5), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2], _w[i + 3], _w[i + 4])) END"))
        # only texts in which a window comes back sort their windows
        .withColumn("_s", e("CASE WHEN size(array_distinct(_h)) < size(_h) THEN sort_array(transform(_h, (x, i) -> struct(x AS x, i AS i))) END"))
        .withColumn("_p", e("sort_array(transform(filter(_s, (s, i) -> (i > 0 AND _s[greatest(i - 1, 0)].x = s.x) OR (i < size(_s) - 1 AND _s[least(i + 1, size(_s) - 1)].x = s.x)), s -> s.i))"))
        .select(
            "doc_id",
            "n_words",
            F.length(F.translate("_t", " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
            (F.length("_t") - F.length(F.translate("_t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
            (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
            e("coalesce(aggregate(transform(_p, (p, k) -> CASE WHEN k < size(_p) - 1 THEN least(5, _p[least(k + 1, size(_p) - 1)] - p) ELSE 5 END), 0L, (a, x) -> a + x), 0L)").alias("n_repeat_words"),
            F.size("_l").alias("_lines"),
            e(f"size(filter(_w, w -> lower(w) IN ({stops})))").alias("_stop"),
            e("size(filter(_l, x -> char_length(x) < 20))").alias("_short"),
        )
        .select(
            "doc_id",
            *_COUNTS,
            e("word_chars / nullif(n_words, 0)").alias("mean_word_chars"),
            e("n_symbols / nullif(word_chars, 0)").alias("symbol_ratio"),
            e("_stop / nullif(n_words, 0)").alias("stop_ratio"),
            e("n_dup_lines / nullif(_lines, 0)").alias("dup_line_ratio"),
            e("_short / nullif(_lines, 0)").alias("short_line_ratio"),
        )
    )


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """One boolean expression that is true where a text is within every range."""
    ok = F.lit(True)
    for r in rules:
        m = F.col(r.metric)
        within = F.lit(True)
        if r.low is not None:
            within &= m >= F.lit(r.low)
        if r.high is not None:
            within &= m <= F.lit(r.high)
        ok &= F.coalesce(within, F.lit(False)) | (F.col("n_words") < F.lit(r.min_words))
    return ok


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """doc_id, the counts, base_failed and kept of every row, judged on its whole text."""
    failed = F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words")
    return measure(docs, text).select("doc_id", *_COUNTS, failed.alias("base_failed"), (~failed & compile_rules(rules)).alias("kept"), "symbol_ratio", "stop_ratio", "mean_word_chars")


def oracle() -> str:
    """DuckDB SQL for the contract's columns and the verdict of ``RULES``."""
    stops = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    cond = []
    for r in RULES:
        parts = [f"{r.metric} >= {r.low}"] * (r.low is not None) + [f"{r.metric} <= {r.high}"] * (r.high is not None)
        cond.append(f"(coalesce({' AND '.join(parts)}, false) OR n_words < {r.min_words})")
    return rf"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
    g AS (SELECT doc_id, i, w[i:i + 4] AS g FROM w, range(1, len(w) - 3) r(i)),
    r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
    c AS (SELECT doc_id, sum(least(5, coalesce(n - i, 5)))::BIGINT AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM r) GROUP BY doc_id),
    m AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
      (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
      len(l) AS lines, len(list_filter(w, lambda x: lower(x) IN ({stops}))) AS stop, len(list_filter(l, lambda x: length(x) < 20)) AS short
      FROM w LEFT JOIN c ON c.doc_id = w.doc_id),
    q AS (SELECT *, word_chars / nullif(n_words, 0) AS mean_word_chars, n_symbols / nullif(word_chars, 0) AS symbol_ratio, stop / nullif(n_words, 0) AS stop_ratio,
      n_dup_lines / nullif(lines, 0) AS dup_line_ratio, short / nullif(lines, 0) AS short_line_ratio, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND {' AND '.join(cond)}) AS kept FROM q
    """
