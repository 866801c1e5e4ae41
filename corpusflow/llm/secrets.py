"""Secret scans: fixed patterns, and Markov models of characters for what they miss. Built-in functions only.

Two first-order character models, of random strings and of ordinary
identifiers, are trained from labelled samples; a long token with letters and
digits is a secret where the log-likelihood ratio of the two is high enough.
The table of transitions is bounded by the alphabet (67 x 67 numbers), so it
travels as a literal of the plan; a scan is one projection and shuffles
nothing, whatever the keys. Positions are code points, ends exclusive.

Null texts count as empty, and have no spans; repeated rows get the same
answer; an empty table gives no rows; extra columns are ignored. Without
labelled samples the models are even and add no span.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm.common import sampled

#: The base patterns, in the order of ties.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LIKELY = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"


@dataclass(frozen=True)
class Settings:
    #: documents that samples are taken from at most
    sample: int = 4000
    #: random strings drawn for each alphabet
    drawn: int = 400
    seed: int = 11
    min_chars: int = 20
    #: least log-likelihood ratio in all, and for each transition
    least: float = 12.0
    least_mean: float = 0.35


def _transitions(token: str) -> str:
    """SQL: numbers of a token's transitions in a flattened table; characters outside the alphabet count as 0."""
    n = len(ALPHABET) + 1
    return f"transform(sequence(1, greatest(length({token}) - 1, 1)), i -> instr('{ALPHABET}', substr({token}, i, 1)) * {n} + instr('{ALPHABET}', substr({token}, i + 1, 1)))"


def random_strings(spark: SparkSession, s: Settings = Settings()) -> DataFrame:
    """(value, label 1): strings drawn evenly from the alphabets that keys are written in."""
    alphabets = F.explode(F.array(*(F.lit(a) for a in ("0123456789abcdef", ALPHABET[:26] + "0123456789", ALPHABET[:62], ALPHABET[:64]))))
    chars = f"array_join(transform(sequence(1, 40), i -> substr(a, 1 + cast(pmod(xxhash64(id, a, i, {s.seed}), length(a)) AS int), 1)), '')"
    return spark.range(s.drawn).withColumn("a", alphabets).select(F.expr(chars).alias("value"), F.lit(1).alias("label"))


def corpus_samples(docs: DataFrame, s: Settings = Settings(), text: str = "text") -> DataFrame:
    """(value, label): long values that any base pattern finds are random strings, words without digits ordinary identifiers (as written, and in capitals)."""
    some = sampled(docs.select("doc_id", text), docs, s.sample, text=text)
    every = [(r"\b(?=[0-9a-f]*[0-9])[0-9a-f]{24,}\b", 0), (ACCESS, 0), (ASSIGN, 2)]
    values = F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(g)) for p, g in every))
    # short values of assignments are often words
    found = some.select(F.explode(values).alias("value")).where(f"length(value) >= {s.min_chars} AND value RLIKE '[0-9]' AND value RLIKE '[A-Za-z]'").withColumn("label", F.lit(1))
    words = some.select(F.explode(F.regexp_extract_all(text, F.lit(r"\b[A-Za-z_]{4,}\b"), F.lit(0))).alias("value")).distinct()
    return found.unionByName(words.select(F.explode(F.array("value", F.upper("value"))).alias("value"), F.lit(0).alias("label")))


def train(samples: DataFrame) -> list[float]:
    """Log ratio of each transition's likelihood under the two models, with add-one smoothing; flattened."""
    n = len(ALPHABET) + 1
    rows = samples.where("length(value) > 1").select("label", F.explode(F.expr(_transitions("value"))).alias("t")).groupBy("label", "t").count().collect()
    count = [[1.0] * (n * n) for _ in range(2)]
    for r in rows:
        count[r.label][r.t] += r["count"]
    total = [[sum(c[a * n : a * n + n]) for a in range(n)] for c in count]
    if not rows:
        return [0.0] * (n * n)
    return [round(math.log(count[1][k] / total[1][k // n]) - math.log(count[0][k] / total[0][k // n]), 4) for k in range(n * n)]


def _found(text: str, pattern: str, kind: int, likely: str, good: str) -> Column:
    """Spans (s, k, e) of a pattern's leftmost matches, from the lengths of matches and of what lies between.

    ``likely``: a pattern that every text with a good match has; ``good``: a
    condition on x.`1`, the match, and x.`2`, its second group if any."""
    q = pattern.replace("\\", "\\\\").replace("'", "\\'")
    lq = likely.replace("\\", "\\\\").replace("'", "\\'")
    v = 2 if kind == 0 else 0
    none = "cast(array() AS array<struct<s:int,k:int,e:int>>)"
    return F.expr(
        f"""CASE WHEN {text} RLIKE '{lq}' THEN
        aggregate(arrays_zip(split({text}, '{q}', -1), regexp_extract_all({text}, '{q}', 0), regexp_extract_all({text}, '{q}', {v})),
          named_struct('p', 0, 'o', {none}),
          (a, x) -> named_struct('p', a.p + length(x.`0`) + coalesce(length(x.`1`), 0),
             'o', CASE WHEN x.`1` IS NOT NULL AND ({good}) THEN concat(a.o, array(named_struct('s', a.p + length(x.`0`), 'k', {kind}, 'e', a.p + length(x.`0`) + length(x.`1`)))) ELSE a.o END),
          a -> a.o) ELSE {none} END"""
    )


def scan(docs: DataFrame, table: list[float], s: Settings = Settings(), text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans, all spans as a string, ``keep`` and the column ``found`` of spans (s, k, e)."""
    t = "_t"
    token = rf"[A-Za-z0-9+/_=-]{{{s.min_chars},}}"
    llr = f"aggregate({_transitions('x.`1`')}, 0D, (b, j) -> b + _llr[j])"
    odd = f"x.`1` RLIKE '[0-9]' AND x.`1` RLIKE '[A-Za-z]' AND {llr} >= {s.least} AND {llr} >= {s.least_mean} * (length(x.`1`) - 1)"
    d = docs.select("doc_id", *keep, F.coalesce(F.col(text), F.lit("")).alias(t)).withColumn("_llr", F.split(F.lit(",".join(map(str, table))), ",").cast("array<double>"))
    d = d.select(
        "doc_id", *keep,
        _found(t, ASSIGN, 0, ASSIGN_LIKELY, "length(x.`2`) >= 6").alias("_a"),
        _found(t, ACCESS, 1, "AKIA[A-Z0-9]{16,}", "length(x.`1`) >= 20").alias("_c"),
        _found(t, HEX, 2, "[0-9a-f]{24,}", "length(x.`1`) >= 24").alias("_h"),
        _found(t, token, 3, token, odd).alias("_m"),
    )
    base = F.sort_array(F.concat("_a", "_c", "_h"))
    d = d.withColumn("_b", base)
    # a span of the models counts where no base span meets it
    d = d.withColumn("found", F.expr("sort_array(concat(_b, filter(_m, x -> NOT exists(_b, y -> y.s < x.e AND x.s < y.e))))"))
    names = "array('" + "', '".join(KINDS) + "')"
    said = "array_join(transform({}, x -> concat_ws(':', " + names + "[x.k], x.s, x.e)), ',')"
    return d.select("doc_id", *keep, F.size("_a").cast("long").alias("n_assign"), F.size("_c").cast("long").alias("n_access"), F.size("_h").cast("long").alias("n_hex"), F.sha2(F.expr(said.format("_b")), 256).alias("base_sha256"), F.expr(said.format("found")).alias("spans"), "found")


def redacted(text: str = "text", found: str = "found", mark: str = "[SECRET]") -> Column:
    """The text with each run of overlapping spans replaced by ``mark``; null stays null."""
    return F.expr(
        f"""CASE WHEN size({found}) = 0 THEN {text} ELSE
        aggregate({found}, named_struct('p', 0, 'o', ''),
          (a, x) -> CASE WHEN x.s >= a.p AND NOT (a.p > 0 AND x.s = a.p) THEN named_struct('p', x.e, 'o', concat(a.o, substr({text}, a.p + 1, x.s - a.p), '{mark}'))
            ELSE named_struct('p', greatest(a.p, x.e), 'o', CASE WHEN a.p = 0 THEN '{mark}' ELSE a.o END) END,
          a -> concat(a.o, substr({text}, a.p + 1))) END"""
    )
