"""Papers from JSON lines, TEI, PDF files and services that a caller plugs in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as X
from ..shared import staged

FIELDS = ("title", "abstract", "text", "doi")
SCHEMA = ", ".join(f"{f} string" for f in FIELDS)


def read_json_lines(spark: SparkSession, path: str, schema: str = SCHEMA) -> tuple[DataFrame, DataFrame]:
    """The rows of all lines that are JSON objects, and the lines that aren't; blank lines count for neither."""
    lines = spark.read.text(path).where(X.strip(F.col("value"), True) != "")
    parsed = lines.select("value", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("j"))
    ok = F.col("j").isNotNull() & F.col("j._bad").isNull()
    return parsed.where(ok).select("j.*").drop("_bad"), parsed.where(~F.coalesce(ok, F.lit(False))).select("value")


def with_defaults(df: DataFrame) -> DataFrame:
    """Missing fields are empty; an empty text is the abstract and the title; rows are numbered where they have no doc_id.

    Equal papers have numbers of their own. A number is the row's place in its partition, so
    what is used more than once has to be written first, as ``load`` does.
    """
    have = {f: F.coalesce(F.col(f).cast("string"), F.lit("")) if f in df.columns else F.lit("") for f in FIELDS}
    text = F.when(have["text"] == "", X.strip(F.concat_ws(" ", have["abstract"], have["title"]))).otherwise(have["text"])
    key = F.col("doc_id") if "doc_id" in df.columns else F.monotonically_increasing_id()
    return df.select(key.alias("doc_id"), have["title"].alias("title"), have["abstract"].alias("abstract"), text.alias("text"), have["doi"].alias("doi"))


def tei_fields(xml: Column) -> Column:
    """STRUCT<title, abstract, text, doi> by plain search, as the input needn't be well-formed."""
    body = lambda tag: X.strip_tags(F.regexp_extract(xml, rf"(?s)<{tag}[^>]*>(.*?)</{tag}>", 1))
    return F.struct(X.strip(F.regexp_extract(xml, r"(?s)<title>(.*?)</title>", 1)).alias("title"), body("abstract").alias("abstract"), body("body").alias("text"), X.strip(F.regexp_extract(xml, r'(?s)idno type="DOI"[^>]*>(.*?)</idno>', 1)).alias("doi"))


def _pdfminer(content: bytes) -> str:
    try:
        import io

        from pdfminer.high_level import extract_text
    except ImportError:
        return ""
    try:
        return extract_text(io.BytesIO(content)) or ""
    except Exception:  # noqa: BLE001 - a broken file has no text
        return ""


def read_pdfs(spark: SparkSession, folder: str, tei_service: Callable[[bytes], str | None] | None = None, to_text: Callable[[bytes], str] = _pdfminer) -> DataFrame:
    """One row for each PDF file: by the service where it gives TEI, else by ``to_text`` with the file's name as title."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            tei = [tei_service(bytes(c)) if tei_service else None for c in pdf["content"]]
            tei = [t if t and "<TEI" in t else None for t in tei]
            yield pd.DataFrame({"path": pdf["path"], "tei": tei, "plain": [to_text(bytes(c)) if t is None else "" for t, c in zip(tei, pdf["content"])]})

    got = files.mapInPandas(run, "path string, tei string, plain string")
    x, stem = tei_fields(F.col("tei")), F.regexp_extract("path", r"([^/]*)\.pdf$", 1)
    own = F.struct(stem.alias("title"), F.lit("").alias("abstract"), F.col("plain").alias("text"), F.lit("").alias("doi"))
    return got.select("path", F.when(F.col("tei").isNotNull(), x).otherwise(own).alias("x")).orderBy("path").select("x.*")


def load(spark: SparkSession, path: str, **pdf) -> DataFrame:
    """Papers of a ``.jsonl`` file or of a folder of PDF files, written to the shared folder."""
    papers = read_json_lines(spark, path)[0] if path.lower().endswith(".jsonl") else read_pdfs(spark, path, **pdf)
    return staged(with_defaults(papers), "papers")


def lookup(keys: DataFrame, provider: Callable[[str, str], str | None]) -> DataFrame:
    """(key, openalex): what the provider says as JSON about each distinct (doi, title), asked once each."""
    distinct = keys.select(S.identifier(F.col("doi"), F.col("title")).alias("key"), "doi", "title").where("key <> ''").groupBy("key").agg(F.first("doi").alias("doi"), F.first("title").alias("title"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"key": pdf["key"], "work": [provider(d, t) for d, t in zip(pdf["doi"], pdf["title"])]})

    return distinct.mapInPandas(run, "key string, work string").select("key", S.openalex(F.col("work")).alias("openalex"))


def enrich(docs: DataFrame, works: DataFrame | None = None, embedder: Callable[[list[str]], list[list[float]]] | None = None, entities: Callable[[str], list[tuple[str, str]]] | None = None, entity_text: Column | None = None, entity_chars: int | None = None, most_entities: int | None = None) -> DataFrame:
    """``docs`` with openalex, embedding and entities; what isn't plugged in is NULL or empty.

    Entities are looked for in the whole of ``entity_text``, unless the caller gives a number
    of characters that are read or of entities that are kept.
    """
    out = docs
    if works is None:
        out = out.withColumn("openalex", S.openalex(F.lit(None).cast("string")))
    else:
        out = out.withColumn("key", S.identifier(F.col("doi"), F.col("title"))).join(works, "key", "left").drop("key")
    if embedder is None:
        out = out.withColumn("embedding", F.array().cast("array<double>"))
    else:
        @F.pandas_udf("array<double>")
        def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in batches:
                yield pd.Series(embedder(s.tolist()))

        out = out.withColumn("embedding", embed(S.summary_text(F.col("title"), F.col("abstract"))))
    kind = "array<struct<text:string,label:string>>"
    if entities is None:
        return out.withColumn("entities", F.array().cast(kind))

    @F.pandas_udf(kind)
    def find(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [{"text": a, "label": b} for a, b in entities(t or "")[:most_entities]])

    read = F.col("text") if entity_text is None else entity_text
    return out.withColumn("entities", find(F.substring(read, 1, entity_chars) if entity_chars else read))
