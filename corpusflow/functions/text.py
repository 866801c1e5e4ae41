"""Column functions over text; all stay in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that are no terms.
STOPWORDS = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with",
    "by", "from", "as", "is", "was", "are", "were", "be", "been", "being", "have",
    "has", "had", "do", "does", "did", "will", "would", "could", "should", "may",
    "might", "this", "that", "these", "those", "it", "its", "i", "we", "you", "he",
    "she", "they", "their", "our", "us", "not", "no", "so", "if", "than", "then",
)
#: Headings of reference lists.
REF_HEADINGS = ("references", "bibliography", "works cited", "literature cited", "citations")

#: Months by their first letters, and years that count as dates.
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec "
YEAR = r"(?:1[6-9]|20)\d\d"
#: Fixed value: names that are chemical formulas.
_FORMULA = r"^(?=.*\d)(?:[A-Z][a-z]?\d*|[()\[\]·.+\-]|\d)+$"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokens(text: Column | str) -> Column:
    """Terms of a text: runs of a-z in lower case, over two letters, no stop words. Null gives no terms."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(_c(text), F.lit(""))), F.lit("[a-z]+"), F.lit(0)), lambda t: (F.length(t) > 2) & ~t.isin(*STOPWORDS))


def word_count(text: Column | str) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(r"\S+"), F.lit(0)))


def norm_heading(text: Column | str) -> Column:
    """Lower case without leading numbering and trailing punctuation."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.lower(F.coalesce(_c(text), F.lit("")))), r"^[\divxlc]+[.)]?\s+", ""), r"[\s.:]+$", "")


def is_reference_heading(text: Column | str) -> Column:
    return norm_heading(text).isin(*REF_HEADINGS)


def norm_title(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(_c(text), F.lit(""))), "[^a-z0-9]+", " "))


def norm_doi(text: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(_c(text))), r"^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)", ""), r"\.+$", "")


def find_doi(text: Column | str, head: int = 5000) -> Column:
    """The first DOI within the head of a text, without trailing punctuation; null if there is none."""
    found = F.regexp_extract(F.substring(_c(text), 1, head), r"\b10\.\d{4,9}/[-._;()/:a-zA-Z0-9]+", 0)
    return F.nullif(F.regexp_replace(found, r"[.,;:)]+$", ""), F.lit(""))


def surname(author: Column | str) -> Column:
    """The last word of two letters or more, of what stands before a comma if there is one, in lower case; null without any."""
    before = F.split_part(F.lower(_c(author)), F.lit(","), F.lit(1))
    return F.try_element_at(F.regexp_extract_all(before, F.lit(r"[a-zà-öø-ÿ'\-]{2,}"), F.lit(0)), F.lit(-1))


def index_tokens(title: Column | str) -> Column:
    """Informative tokens of a title, all of its tokens if none is."""
    all_ = F.filter(F.split(norm_title(title), " "), lambda t: t != "")
    some = F.filter(all_, lambda t: (F.length(t) > 2) & ~t.isin(*STOPWORDS))
    return F.when(F.size(some) > 0, some).otherwise(all_)


def titles_match(a: Column | str, b: Column | str, least: int = 15) -> Column:
    """Equal normalised titles, or one within the other if the inner one is long enough."""
    x, y = norm_title(a), norm_title(b)
    return (x != "") & (y != "") & ((x == y) | (y.contains(x) & (F.length(x) >= least)) | (x.contains(y) & (F.length(y) >= least)))


def resolution_key(entity: Column | str) -> Column:
    """The key that names of one entity share; case folds only in long names that are no formula."""
    name = F.trim(_c(entity))
    key = F.regexp_replace(F.regexp_replace(name, r"[\s\-_]+", ""), r"[^\p{L}\p{N}_]", "")
    return F.when((F.length(name) > 4) & ~name.rlike(_FORMULA), F.lower(key)).otherwise(key)


def is_acronym(text: Column | str) -> Column:
    return (F.length(_c(text)) >= 2) & (F.length(F.regexp_replace(_c(text), r"[^\p{Lu}]", "")) >= 2)


def is_inverse_voice(predicate: Column | str) -> Column:
    return F.trim(_c(predicate)).rlike(r"\bby$")


def norm_entity(text: Column | str) -> Column:
    return F.lower(F.trim(F.regexp_replace(_c(text), r"\s+", " ")))


def normalize_doc_name(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(_c(text)), r"\.pdf$", ""), r"[_\s]+", " "))


def strip_nul(text: Column | str) -> Column:
    return F.replace(_c(text), F.lit("\0"), F.lit(""))


def strip_jats(text: Column | str) -> Column:
    """Tags out, white space collapsed, a leading "abstract" dropped."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace(_c(text), r"<[^>]+>", " "), r"\s+", " ")), r"(?i)^abstract[\s:.]*", "")


def spaceless(text: Column | str) -> Column:
    return F.array_join(tokens(text), "")


def latest_date(text: Column | str, year: int, month: int, head: int = 3000) -> Column:
    """The latest (year, month) named in the head of a text that is not after the given one; a known month beats none.

    A month is known by the first three letters of a word before the year, or
    by its number in year-month form; years are 1600 to 2099.
    """
    t = F.substring(F.lower(F.coalesce(_c(text), F.lit(""))), 1, head)
    # 0 for a word that begins no month; the month's place in the string gives its number
    number = lambda word: F.floor((F.instr(F.lit(MONTHS), F.concat(F.substring(word, 1, 3), F.lit(" "))) + 3) / 4).cast("int")
    named = F.transform(F.regexp_extract_all(t, F.lit(rf"\b[a-z]{{3,9}}\.?\s+(?:\d{{1,2}}(?:st|nd|rd|th)?,?\s+)?{YEAR}\b"), F.lit(0)), lambda m: F.struct(F.right(m, F.lit(4)).cast("int").alias("y"), number(m).alias("m")))
    named = F.filter(named, lambda d: d["m"] > 0)
    iso = F.transform(F.regexp_extract_all(t, F.lit(rf"\b{YEAR}-(?:0[1-9]|1[0-2])\b"), F.lit(0)), lambda m: F.struct(F.substring(m, 1, 4).cast("int").alias("y"), F.substring(m, 6, 2).cast("int").alias("m")))
    bare = F.transform(F.regexp_extract_all(t, F.lit(rf"\b{YEAR}\b"), F.lit(0)), lambda m: F.struct(m.cast("int").alias("y"), F.lit(0).alias("m")))
    fit = F.filter(F.concat(named, iso, bare), lambda d: (d["y"] < year) | ((d["y"] == year) & (d["m"] <= month)))
    return F.array_max(fit)


def numbers(text: Column | str) -> Column:
    """Distinct numbers of a text, dotted ones whole."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(r"\d+(?:\.\d+)+|\d+"), F.lit(0)))


def normalize_citations(reply: Column | str, sources: int) -> Column:
    """``[n1]``, ``[source 1]`` and ``[1](url)`` become ``[1]``; numbers out of range go where a valid one stays."""
    t = F.regexp_replace(_c(reply), r"(?i)\[(?:n|source\s+)(\d+)\]", "[$1]")
    t = F.regexp_replace(t, r"\[(\d+(?:\s*,\s*\d+)*)\]\([^)]*\)", "[$1]")
    parts = F.split(t, r"(?=\[\d+(?:\s*,\s*\d+)*\])|(?<=\])")

    def fix(p: Column) -> Column:
        nums = F.regexp_extract_all(p, F.lit(r"\d+"), F.lit(0))
        good = F.filter(nums, lambda n: (n.cast("int") >= 1) & (n.cast("int") <= sources))
        return F.when(p.rlike(r"^\[\d+(?:\s*,\s*\d+)*\]$") & (F.size(good) > 0), F.concat(F.lit("["), F.array_join(good, ", "), F.lit("]"))).otherwise(p)

    return F.array_join(F.transform(parts, fix), "")


def _accents() -> tuple[str, str]:
    """Letters with marks up to U+024F and U+1E00 to U+1EFF, and the letters that they decompose to."""
    pairs = [(chr(c), d[0]) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if len(d := unicodedata.normalize("NFKD", chr(c))) > 1 and d[0].isascii() and all(unicodedata.combining(x) for x in d[1:])]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


#: Joined letters and what they stand for.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "ĳ": "ij", "…": "...", "²": "2", "³": "3", "¹": "1"}


def unaccented(text: Column | str) -> Column:
    """Lower case, letters without marks, ligatures taken apart."""
    t = F.lower(F.coalesce(_c(text), F.lit("")))
    for joined, plain in LIGATURES.items():
        t = F.replace(t, F.lit(joined), F.lit(plain))
    return F.regexp_replace(F.translate(t, *_accents()), r"[̀-ͯ]", "")


def _runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("[a-z0-9]+"), F.lit(0))


def norm_words(text: Column | str) -> Column:
    """Words of letters a-z and digits, without case and marks."""
    return _runs(unaccented(text))


def keyword_tokens(text: Column | str) -> Column:
    """Distinct words of three letters or more without a last s; a letter with a mark ends its word."""
    apart = F.regexp_replace(F.lower(F.coalesce(_c(text), F.lit(""))), r"([^\x00-\x7f])", "$1 ")
    words = F.filter(_runs(unaccented(apart)), lambda w: F.length(w) >= 3)
    return F.array_distinct(F.transform(words, lambda w: F.when(w.endswith("s"), F.left(w, F.length(w) - 1)).otherwise(w)))


def viewer_sentences(text: Column | str, least: int = 25) -> Column:
    """Sentences of ``least`` characters or more, ended by . ! ? before a capital, a digit or an opening."""
    parts = F.split(F.coalesce(_c(text), F.lit("")), r"""(?<=[.!?])\s+(?=[A-Z0-9("'\[])""")
    return F.filter(F.transform(parts, F.trim), lambda s: F.length(s) >= least)


#: Fixed value: how sentences begin that are no titles.
NOT_TITLE = r"(?i)^(?:provided proper attribution|permission to reproduce|all rights reserved|published by|journal of|proceedings of|transactions on|vol\.|volume\s+\d|issue\s+\d|doi:|arxiv:)"


def clean_title(title: Column | str) -> Column:
    """A title without the boilerplate sentences that it begins with; null if nothing is left."""
    parts = F.split(F.trim(_c(title)), r"(?<=[.!?])\s+")
    flags = F.transform(parts, lambda s: (~s.rlike(NOT_TITLE)).cast("int"))
    first = F.array_position(flags, 1)
    left = F.when(first > 0, F.array_join(F.slice(parts, first.cast("int"), F.size(parts)), " "))
    return F.nullif(F.trim(left), F.lit(""))


def meta_text(title: Column | str, abstract: Column | str, text: Column | str, words: int = 200) -> Column:
    """Title and abstract on lines of their own; the first words of the text if both are blank."""
    said = F.array_join(F.filter(F.array(F.nullif(F.trim(_c(title)), F.lit("")), F.nullif(F.trim(_c(abstract)), F.lit(""))), lambda x: x.isNotNull()), "\n")
    head = F.array_join(F.slice(F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(r"\S+"), F.lit(0)), 1, words), " ")
    return F.when(said != "", said).otherwise(head)


def clean_body(text: Column | str, prefix: Column | str) -> Column:
    """A chunk's own text, behind its prefix of so many characters."""
    return F.trim(F.substring(_c(text), F.coalesce(_c(prefix), F.lit(0)) + 1, F.length(_c(text))))


def chunk_title(text: Column | str, prefix: Column | str, filename: Column | str) -> Column:
    """The title in a chunk's prefix, before the dash; the file's name without one."""
    head = F.substring(_c(text), F.lit(1), F.coalesce(_c(prefix), F.lit(0)))
    return F.coalesce(F.nullif(F.trim(F.split_part(head, F.lit(" — "), F.lit(1))), F.lit("")), _c(filename))


def graph_markers(reply: Column | str, facts: Column | str) -> Column:
    """Spellings of the graph's marker become [G]; without facts they go."""
    t = F.regexp_replace(_c(reply), r"\[\s*(?:G|g|graph|Graph|KG|kg)\s*\]", "[G]")
    return F.when(_c(facts) > 0, t).otherwise(F.replace(t, F.lit("[G]"), F.lit("")))


def fill_template(template: Column | str, **values: Column | str) -> Column:
    """Each named ``{key}`` replaced; other braces stay. Values are not searched for keys."""
    keys = "|".join(values)
    parts = F.split(_c(template), rf"(?=\{{(?:{keys})\}})|(?<=\{{(?:{keys})\}})")
    by = F.create_map(*[x for k, v in values.items() for x in (F.lit("{" + k + "}"), _c(v).cast("string"))])
    return F.array_join(F.transform(parts, lambda p: F.coalesce(by[p], p)), "")


def auto_label(question: Column | str, most: int = 60) -> Column:
    return F.substring(F.trim(_c(question)), 1, most)


def cited_numbers(reply: Column | str, flagged: bool = False) -> Column:
    """Distinct numbers of ``[1, 2]``, or of flagged ``[3!]``, sorted."""
    marks = F.regexp_extract_all(F.coalesce(_c(reply), F.lit("")), F.lit(r"\[\s*(\d+(?:\s*,\s*\d+)*)\s*" + ("!" if flagged else "") + r"\s*\]"), F.lit(1))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(marks, lambda m: F.transform(F.split(m, r"\s*,\s*"), lambda n: n.cast("int"))))))


def first_filled(*columns: Column | str) -> Column:
    """The first of the given strings that is not blank, or null."""
    return F.coalesce(*(F.when(F.trim(_c(c)) != "", _c(c)) for c in columns))


def partial_date(year: Column | str, month: Column | str, now_year: int, now_month: int) -> Column:
    """(year, month) of date parts; null if it lies in the future, the month null if it is none."""
    y, m = _c(year).cast("int"), _c(month).cast("int")
    good = F.when(m.between(1, 12), m)
    ahead = (y > now_year) | ((y == now_year) & F.coalesce(good > now_month, F.lit(False)))
    return F.when(y.isNotNull() & ~ahead, F.struct(y.alias("year"), good.alias("month")))


def page_span(first: tuple[Column, Column], second: tuple[Column, Column]) -> Column:
    """The span over two spans of pages; an unknown one does not count."""
    lo, hi = F.least(first[0], second[0]), F.greatest(first[1], second[1])
    return F.when(lo.isNotNull() & hi.isNotNull(), F.struct(lo.alias("first"), hi.alias("last")))


def title_cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two titles' counts of words."""
    x, y = (F.filter(F.split(norm_title(v), " "), lambda w: w != "") for v in (a, b))
    count = lambda words, w: F.size(F.filter(words, lambda v: v == w))
    total = lambda words, f: F.aggregate(F.transform(F.array_distinct(words), f), F.lit(0), lambda s, v: s + v)
    both = total(x, lambda w: count(x, w) * count(y, w))
    size = F.sqrt(total(x, lambda w: count(x, w) * count(x, w)).cast("double")) * F.sqrt(total(y, lambda w: count(y, w) * count(y, w)).cast("double"))
    return F.when(size > 0, both / size).otherwise(F.lit(0.0))


#: A complete innermost element of a JSON list: strings may hold brackets.
_ELEMENT = r"""[\[{](?!\s*[\]}])(?:[^\[\]{}"]|"(?:[^"\\]|\\.)*")*[\]}]"""


def parse_triples(reply: Column | str) -> Column:
    """(kept, dropped, failed) of a model's list of triples.

    Every complete ``["s", "p", "o"]`` or ``{"subject": …, "predicate": …,
    "object": …}`` counts, whatever surrounds it: fences, prose, commas or an
    end that was cut off. Elements that are no triple of three texts are counted
    as dropped; without any triple the parse has failed.
    """
    every = F.regexp_extract_all(F.coalesce(_c(reply), F.lit("")), F.lit(_ELEMENT), F.lit(0))

    def read(e: Column) -> Column:
        # values stay JSON, so that a list or a number is not taken for a text
        got = F.when(e.startswith("["), F.from_json(e, "array<string>")).otherwise(F.array(*(F.get_json_object(e, f"$.{k}") for k in ("subject", "predicate", "object"))))
        texts = F.regexp_count(e, F.lit(r'"(?:[^"\\]|\\.)*"')) == F.when(e.startswith("["), 3).otherwise(6)
        good = texts & (F.size(got) == 3) & F.coalesce(F.forall(got, lambda v: F.trim(v) != ""), F.lit(False))
        return F.when(good, F.struct(got[0].alias("s"), got[1].alias("p"), got[2].alias("o")))

    triples = F.transform(every, read)
    kept = F.filter(triples, lambda t: t.isNotNull())
    return F.struct(kept.alias("kept"), (F.size(every) - F.size(kept)).alias("dropped"), (F.size(kept) == 0).alias("failed"))


def parse_query(reply: Column | str, question: Column | str) -> Column:
    """(keywords, confidence) of a model's JSON reply in or out of fences; the question's terms with confidence 0 if it cannot be read."""
    raw = F.trim(F.regexp_replace(F.coalesce(_c(reply), F.lit("")), r"(?m)^```(?:json)?\s*|\s*```$", ""))
    got = F.from_json(raw, "struct<keywords: array<string>, confidence: double>")
    read = F.size(got["keywords"]) > 0
    words = F.when(read, got["keywords"]).otherwise(F.array_distinct(tokens(question)))
    sure = F.when(read, F.greatest(F.least(F.coalesce(got["confidence"], F.lit(0.0)), F.lit(1.0)), F.lit(0.0))).otherwise(F.lit(0.0))
    return F.struct(words.alias("keywords"), sure.alias("confidence"))
