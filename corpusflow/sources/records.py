"""Records of documents: listing, lookup, metadata from services, JSON lists, exports and write-backs."""

from __future__ import annotations

import os
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.functions import text as T


def list_documents(docs: DataFrame, status: str | None = None) -> DataFrame:
    """Documents, the newest first, of one status if it is given."""
    d = docs if status is None else docs.where(F.col("status") == status)
    return d.orderBy(F.desc("uploaded_at"), "doc_id")


def lookup(chunks: DataFrame, chunk_id: str) -> DataFrame:
    """The chunk of an id, as one row; a KeyError without one."""
    got = chunks.where(F.col("chunk_id") == chunk_id).limit(1)
    if got.isEmpty():
        raise KeyError(chunk_id)
    return got


def owned(rows: DataFrame, owner: str) -> DataFrame:
    """Rows of an owner; those of others are as good as absent."""
    return rows.where(F.col("owner_id") == owner)


def distinct_in_order(df: DataFrame, value: str, ordinal: str) -> DataFrame:
    """(value, ordinal): each value once, where it stands first."""
    return df.groupBy(value).agg(F.min(ordinal).alias(ordinal))


def tei_header(xml: Column | str) -> Column:
    """(title, authors, abstract, year) of a header in TEI, whatever its namespace."""
    x = F.col(xml) if isinstance(xml, str) else xml
    at = lambda *names: "".join(f"/*[local-name()='{n}']" for n in names)
    one = lambda path: F.nullif(F.trim(F.xpath_string(x, F.lit(path))), F.lit(""))
    people = "//*[local-name()='sourceDesc']//*[local-name()='author']" + at("persName")
    return F.struct(
        one("//*[local-name()='titleStmt']" + at("title")).alias("title"),
        F.array_distinct(F.zip_with(F.xpath(x, F.lit(people + at("forename") + "[1]/text()")), F.xpath(x, F.lit(people + at("surname") + "/text()")), lambda a, b: F.trim(F.concat_ws(" ", a, b)))).alias("authors"),
        one("//*[local-name()='profileDesc']" + at("abstract")).alias("abstract"),
        F.regexp_extract(F.xpath_string(x, F.lit("//*[local-name()='publicationStmt']/*[local-name()='date']/@when")), r"^(\d{4})", 1).try_cast("int").alias("year"),
    )


def tei_references(docs: DataFrame, xml: str = "xml") -> DataFrame:
    """(doc_id, ref, title, authors): references of TEI; the title of the analytic part, else of the monograph."""
    path = "//*[local-name()='listBibl']/*[local-name()='biblStruct']"
    count = F.xpath_int(xml, F.lit(f"count({path})"))
    each = docs.select("doc_id", xml, F.explode(F.when(count > 0, F.sequence(F.lit(1), count))).alias("ref"))
    # the path of XPath functions is a constant, so parts of a reference are taken from its own piece of text
    piece = F.regexp_extract_all(F.regexp_extract(xml, r"(?s)<(?:\w+:)?listBibl\b.*</(?:\w+:)?listBibl>", 0), F.lit(r"(?s)<(?:\w+:)?biblStruct\b.*?</(?:\w+:)?biblStruct>"), F.lit(0))[F.col("ref") - 1]
    local = F.regexp_replace(F.regexp_replace(piece, r"<(/?)\w+:(\w)", "<$1$2"), r"\s(?:xml|xmlns)(?::\w+)?=\"[^\"]*\"", "")
    title = lambda part: F.nullif(F.trim(F.xpath_string("_x", F.lit(f"/biblStruct/{part}/title"))), F.lit(""))
    names = F.zip_with(F.xpath("_x", F.lit("//author/persName/forename[1]/text()")), F.xpath("_x", F.lit("//author/persName/surname/text()")), lambda a, b: F.trim(F.concat_ws(" ", a, b)))
    return each.withColumn("_x", local).select("doc_id", F.col("ref").cast("int").alias("ref"), F.coalesce(title("analytic"), title("monogr")).alias("title"), F.array_distinct(names).alias("authors"))


CROSSREF = "struct<message: struct<DOI: string, title: array<string>, author: array<struct<given: string, family: string>>, abstract: string, issued: struct<`date-parts`: array<array<int>>>, `is-referenced-by-count`: int>>"


def crossref_works(replies: DataFrame, now_year: int, now_month: int) -> DataFrame:
    """(doi, title, authors, abstract, created, cited_by) of replies (doi, reply); a null reply is a known miss and gives a row of nulls."""
    m = F.from_json("reply", CROSSREF)["message"]
    parts = m["issued"]["date-parts"][0]
    people = F.filter(F.transform(m["author"], lambda a: F.trim(F.concat_ws(" ", a["given"], a["family"]))), lambda a: a != "")
    return replies.select(
        T.norm_doi("doi").alias("doi"),
        F.nullif(F.trim(m["title"][0]), F.lit("")).alias("title"),
        F.when(F.size(people) > 0, people).alias("authors"),
        F.nullif(T.strip_jats(m["abstract"]), F.lit("")).alias("abstract"),
        T.partial_date(F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), now_year, now_month).alias("created"),
        m["is-referenced-by-count"].alias("cited_by"),
    )


def unknown_dois(docs: DataFrame, cache: DataFrame) -> DataFrame:
    """(doi,) that the cache (doi, …) has no row of, not even a miss."""
    return docs.select(T.norm_doi("doi").alias("doi")).where("doi IS NOT NULL AND doi <> ''").distinct().join(cache.select("doi"), "doi", "left_anti")


def enrich(docs: DataFrame, works: DataFrame, fields: tuple[str, ...] = ("title", "authors", "abstract", "created", "cited_by")) -> DataFrame:
    """Documents with the fields of the work of their DOI, where that has them."""
    w = works.select(F.col("doi").alias("_doi"), *(F.col(f).alias(f"_{f}") for f in fields)).dropDuplicates(["_doi"])
    out = docs.join(w, T.norm_doi("doi") == F.col("_doi"), "left")
    kinds = dict(works.dtypes)
    for f in fields:
        filled = F.when(F.size(f"_{f}") > 0, F.col(f"_{f}")) if kinds[f].startswith("array") else T.first_filled(f"_{f}") if kinds[f] == "string" else F.col(f"_{f}")
        out = out.withColumn(f, F.coalesce(filled, F.col(f)))
    return out.drop("_doi", *(f"_{f}" for f in fields))


def fallback(df: DataFrame, fields: dict[str, list[str]]) -> DataFrame:
    """Each field from the first of its columns that is not blank."""
    return df.withColumns({f: T.first_filled(*cols) for f, cols in fields.items()})


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON list; none where the file is absent, and none of what is malformed."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)


def abbreviations(spark: SparkSession, path: str) -> DataFrame:
    """(short, long, n) of stated definitions."""
    return read_json(spark, path, "short string, long string, n long")


def models(spark: SparkSession, path: str) -> DataFrame:
    """(id, context, local) of the models at hand."""
    return read_json(spark, path, "id string, context int, local boolean").where("id IS NOT NULL")


def labels(chunks: DataFrame, categories: DataFrame) -> DataFrame:
    """Chunks with ``category``: the first three keywords of their document's cluster, or its number; categories (cluster, keywords, doc_ids)."""
    of = categories.select(F.explode("doc_ids").alias("doc_id"), F.coalesce(F.nullif(F.array_join(F.slice("keywords", 1, 3), ", "), F.lit("")), F.concat(F.lit("cluster "), F.col("cluster").cast("string"))).alias("category"))
    return chunks.drop("category").join(of, "doc_id", "left")


def export(df: DataFrame, path: str, vectors: bool = True, columns: tuple[str, ...] = ("embedding", "vec")) -> None:
    """Writes a table; without vectors their columns are not even read."""
    publish(df if vectors else df.drop(*columns), path)


def publish(df: DataFrame, path: str, tries: int = 3) -> None:
    """Replaces a table as a whole: written beside, then renamed, so that a reader sees the old or the new one."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    side = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    df.write.parquet(side)
    new, old, at = (jvm.org.apache.hadoop.fs.Path(p) for p in (side, side + "-old", path))
    fs = at.getFileSystem(conf)
    for k in range(tries):
        moved = not fs.exists(at) or fs.rename(at, old)
        if moved and fs.rename(new, at):
            fs.delete(old, True)
            return
        if moved and fs.exists(old):
            fs.rename(old, at)
        time.sleep(0.1 * 2**k)
    raise OSError(f"could not publish {path}")


def append_log(rows: DataFrame, path: str) -> None:
    """Appends (chat_id, prompt, context, reply, at) to the log of chats, a JSON line each."""
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("append").text(path)


def render_graph(triples: DataFrame, path: str, most: int = 5000) -> None:
    """A page with a drawing's data of the graph: at most so many relations, as a person can look at no more."""
    from html import escape

    rows = triples.select("s", "p", "o").distinct().orderBy("s", "p", "o").limit(most).collect()
    body = "".join(f"<tr><td>{escape(r.s)}</td><td>{escape(r.p)}</td><td>{escape(r.o)}</td></tr>" for r in rows)
    side = f"{path}.{uuid.uuid4().hex}"
    with open(side, "w", encoding="utf-8") as f:
        f.write(f"<!doctype html><meta charset=utf-8><title>Graph</title><table>{body}</table>")
    os.replace(side, path)


def rechunk(docs: DataFrame, chunks: DataFrame, make) -> DataFrame:
    """The chunk store after documents changed: stale ones cut anew by ``make``, other chunks kept, chunks of blank documents gone.

    docs (doc_id, text, extracted_at), chunks (doc_id, …, ingested_at).
    """
    from corpusflow.sources.ingest import stale

    again = docs.join(stale(docs, chunks), "doc_id", "left_semi")
    kept = chunks.join(again.select("doc_id"), "doc_id", "left_anti")
    fresh = make(again.where(F.trim(F.coalesce("text", F.lit(""))) != "")).withColumn("ingested_at", F.current_timestamp())
    return kept.unionByName(fresh, allowMissingColumns=True)
