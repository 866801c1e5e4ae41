"""Sections, tables and metadata of documents in HTML or Markdown; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions import text as T
from corpusflow.sources.ingest import strip_tags

#: Headings that are no titles.
NO_TITLES = (
    "abstract", "introduction", "background", "methods", "results", "discussion", "conclusion", "conclusions", "references", "bibliography", "acknowledgements", "acknowledgments",
    "appendix", "supplementary", "related work", "future work", "limitations", "keywords", "overview", "summary", "notation", "funding", "license", "orcid",
)
_HTML_HEADING = r"(?is)<h[1-6]\b[^>]*>"
_MARK_HEADING = r"(?m)^#{1,6}[ \t]+"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def html_sections(html: Column | str) -> Column:
    """Array of (heading, text): what stands before the first heading, and each heading with what follows it; empty ones go."""
    body = F.regexp_replace(F.coalesce(_c(html), F.lit("")), r"(?is)<head\b.*?</head>|<(script|style)\b.*?</(?:script|style)>|<!--.*?-->", " ")
    parts = F.split(body, f"(?={_HTML_HEADING})")

    def read(p: Column) -> Column:
        head = F.regexp_extract(p, r"(?is)^<h[1-6]\b[^>]*>(.*?)</h[1-6]\s*>", 1)
        rest = F.regexp_replace(p, r"(?is)^<h[1-6]\b[^>]*>.*?</h[1-6]\s*>", "")
        return F.struct(strip_tags(head).alias("heading"), strip_tags(rest).alias("text"))

    return F.filter(F.transform(parts, read), lambda s: (s["heading"] != "") | (s["text"] != ""))


def markdown_sections(text: Column | str) -> Column:
    """The same of lines that begin with #."""
    parts = F.split(F.coalesce(_c(text), F.lit("")), f"(?={_MARK_HEADING})")
    flat = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))

    def read(p: Column) -> Column:
        has = p.rlike(rf"\A{_MARK_HEADING}")
        head = F.when(has, F.regexp_replace(F.split_part(p, F.lit("\n"), F.lit(1)), r"^#{1,6}[ \t]+", "")).otherwise(F.lit(""))
        rest = F.when(has, F.substr(p, F.length(F.split_part(p, F.lit("\n"), F.lit(1))) + 1)).otherwise(p)
        return F.struct(flat(head).alias("heading"), flat(rest).alias("text"))

    return F.filter(F.transform(parts, read), lambda s: (s["heading"] != "") | (s["text"] != ""))


def tables(html: Column | str) -> Column:
    """Array of a page's tables as lines of cells between bars."""
    found = F.regexp_extract_all(F.coalesce(_c(html), F.lit("")), F.lit(r"(?is)<table\b[^>]*>.*?</table\s*>"), F.lit(0))

    def line(row: Column) -> Column:
        cells = F.regexp_extract_all(row, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]\s*>"), F.lit(1))
        return F.concat(F.lit("| "), F.array_join(F.transform(cells, strip_tags), " | "), F.lit(" |"))

    rows = lambda t: F.regexp_extract_all(t, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr\s*>"), F.lit(1))
    return F.transform(found, lambda t: F.array_join(F.transform(rows(t), line), "\n"))


def metadata(sections: Column | str, head: int = 7) -> Column:
    """(title, abstract): the first heading of the first sections that can be a title, and the text of the first one headed abstract."""
    s = _c(sections)
    fits = lambda h: (F.trim(h) != "") & ~F.lower(F.trim(h)).isin(*NO_TITLES) & ~F.trim(h).rlike(T.NOT_TITLE)
    title = F.get(F.filter(F.slice(s, 1, head), lambda x: fits(x["heading"])), F.lit(0))["heading"]
    said = F.get(F.filter(s, lambda x: F.lower(F.trim(x["heading"])).startswith("abstract")), F.lit(0))["text"]
    return F.struct(F.trim(title).alias("title"), F.nullif(F.trim(said), F.lit("")).alias("abstract"))


def without_nul(df: DataFrame) -> DataFrame:
    """Rows without the NUL character in any text, at any depth."""
    from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

    def clean(x: Column, kind: DataType) -> Column:
        if isinstance(kind, StringType):
            return T.strip_nul(x)
        if isinstance(kind, ArrayType):
            return F.transform(x, lambda v: clean(v, kind.elementType))
        if isinstance(kind, MapType):
            return F.transform_values(F.transform_keys(x, lambda k, _: clean(k, kind.keyType)), lambda _, v: clean(v, kind.valueType))
        if isinstance(kind, StructType):
            return F.when(x.isNotNull(), F.struct(*(clean(x[f.name], f.dataType).alias(f.name) for f in kind.fields)))
        return x

    return df.select(*(clean(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields))
