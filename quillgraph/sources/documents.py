"""Document sources: sections from page tables, files, exposition text."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import strip
from .pdf import pdf_text

#: Shortest section kept, pages of a block, deepest entry used, mean length under which text is sparse.
LEAST_CHARS, BLOCK_PAGES, DEEPEST, SPARSE = 80, 8, 2, 200


def _joined(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Pages of a section in order, one text; short sections dropped."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda p: p["text"]), "\n")
    return pages.groupBy(*keys).agg(text.alias("text")).where(F.length(strip(F.col("text"))) >= LEAST_CHARS)


def sections_from_toc(pages: DataFrame, toc: DataFrame) -> DataFrame:
    """(doc_id, section_no, title, text) for pages (doc_id, page_no from 0, text) and toc
    (doc_id, entry_no, level, title, page_no from 1).

    An entry covers the pages from its own to the one before the next entry's; the last
    runs to the end.  Pages before the first entry are lost, and of two entries on one
    page the first is empty.  The page meets its entry by an equi-join on the document.
    """
    w = Window.partitionBy("doc_id").orderBy("entry_no")
    spans = toc.where(F.col("level") <= DEEPEST).select(
        "doc_id", F.col("entry_no").alias("section_no"), "title", (F.col("page_no") - 1).alias("lo"),
        (F.lead("page_no").over(w) - 1).alias("hi"),
    )
    met = pages.join(spans, "doc_id").where((F.col("page_no") >= F.col("lo")) & (F.col("hi").isNull() | (F.col("page_no") < F.col("hi"))))
    return _joined(met, ["doc_id", "section_no", "title"]).select("doc_id", "section_no", "title", "text")


def sections_from_blocks(pages: DataFrame, size: int = BLOCK_PAGES) -> DataFrame:
    """Documents without entries: blocks of ``size`` pages named pages_{first}_{last}, counted from 1."""
    block = F.floor(F.col("page_no") / size)
    last = F.max("page_no").over(Window.partitionBy("doc_id"))
    named = pages.withColumn("last", last).select(
        "doc_id", "page_no", "text", block.alias("section_no"),
        F.concat(F.lit("pages_"), block * size + 1, F.lit("_"), F.least(block * size + size, F.col("last") + 1)).alias("title"),
    )
    return _joined(named, ["doc_id", "section_no", "title"]).select("doc_id", F.col("section_no").cast("int").alias("section_no"), "title", "text")


def sparse_flag(sections: DataFrame) -> DataFrame:
    return sections.groupBy("doc_id").agg((F.avg(F.length("text")) < SPARSE).alias("is_sparse"))


def docx_text(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        xml = z.read("word/document.xml").decode("utf-8")
    paragraphs = re.findall(r"<w:p[ >].*?</w:p>", xml, re.DOTALL)
    plain = ["".join(re.findall(r"<w:t(?: [^>]*)?>(.*?)</w:t>", p, re.DOTALL)) for p in paragraphs]
    return "\n".join(p.replace("&lt;", "<").replace("&gt;", ">").replace("&amp;", "&") for p in plain)


def decode(data: bytes) -> str:
    """UTF-8 or UTF-16 by mark, then UTF-8, then Latin-1 with replacement."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data.decode("utf-16", "replace")
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        return data.decode("latin-1", "replace")


def read_files(spark: SparkSession, path: str, parsers: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """(path, text) of files: text, DOCX, PDF, and by ``parsers`` (suffix -> function of bytes) others."""
    known = {"docx": docx_text, "pdf": pdf_text} | (parsers or {})

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({"path": p.path, "text": [known.get(n.rsplit(".", 1)[-1].lower(), decode)(bytes(c)) for n, c in zip(p.path, p.content, strict=True)]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, text string")


def read_json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Rows of JSON lines; with a schema no pass is needed to find one, and a broken line raises an error."""
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text), one row per file, JVM-side."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def parse_metrics(df: DataFrame, text_col: str = "text", prefixes: list[str] | None = None) -> DataFrame:
    """Exposition lines ``name{a="x",b="y"} value``: all other columns, name, labels map, value.

    Comments, blank lines and lines without a number are skipped; ``prefixes`` keeps names.
    """
    line = r'^([A-Za-z_:][A-Za-z0-9_:]*)(?:\{(.*)\})?\s+([-+]?(?:[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?|NaN|Inf))'
    keep = [c for c in df.columns if c != text_col]
    rows = df.select(*keep, F.explode(F.split(text_col, "\n")).alias("line")).where(F.col("line").rlike(line))
    pairs = F.regexp_extract_all(F.regexp_extract("line", line, 2), F.lit(r'([A-Za-z_][A-Za-z0-9_]*="[^"]*")'), F.lit(1))
    entry: Callable[[Column], Column] = lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.regexp_extract(p, r'"([^"]*)"', 1).alias("v"))
    out = rows.select(
        *keep, F.regexp_extract("line", line, 1).alias("name"),
        F.map_from_entries(F.array_sort(F.transform(pairs, entry))).alias("labels"),
        F.regexp_extract("line", line, 3).cast("double").alias("value"),
    )
    if prefixes:
        out = out.where(F.col("name").rlike("^(" + "|".join(re.escape(p) for p in prefixes) + ")"))
    return out
