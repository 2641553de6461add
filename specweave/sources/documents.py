"""Specification documents: finding, extracting, counting and cleaning them."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specweave.functions.text import token_estimate
from specweave.sources.pdf import pdf_pages

SUFFIXES = (".pdf", ".docx", ".txt", ".jsonl")
Extractor = Callable[[bytes], list[str]]


def resolve_inputs(spark: SparkSession, paths: str | list[str]) -> list[str]:
    """Sorted files of the given files and folders (not below them); missing, empty or other inputs are errors."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    out = []
    for name in [paths] if isinstance(paths, str) else paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        fs = path.getFileSystem(conf)
        if not fs.exists(path):
            raise FileNotFoundError(name)
        if fs.getFileStatus(path).isDirectory():
            own = [str(s.getPath()) for s in fs.listStatus(path) if not s.isDirectory() and str(s.getPath()).lower().endswith(SUFFIXES)]
            if not own:
                raise ValueError(f"no documents in {name}")
            out += own
        elif name.lower().endswith(SUFFIXES):
            out.append(str(fs.getFileStatus(path).getPath()))
        else:
            raise ValueError(f"not a document: {name}")
    return sorted(out)


def docx_pages(data: bytes) -> list[str]:
    """One page with the paragraphs of a word-processor file, a line each."""
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    return ["\n".join("".join(t.text or "" for t in p.iter(f"{space}t")) for p in root.iter(f"{space}p"))]


def text_pages(data: bytes) -> list[str]:
    """Pages of plain text, divided by form feeds."""
    return data.decode("utf-8", "replace").split("\f")


def jsonl_pages(data: bytes) -> list[str]:
    return [json_text(json.loads(line)) for line in data.decode("utf-8", "replace").splitlines() if line.strip()]


EXTRACTORS: dict[str, Extractor] = {".pdf": pdf_pages, ".txt": text_pages, ".docx": docx_pages, ".jsonl": jsonl_pages}


def read_documents(spark: SparkSession, paths: str | list[str], extractors: dict[str, Extractor] | None = None) -> DataFrame:
    """(doc_id, path, size, page, text), a row a page. extractors: others by suffix, such as ``{".pdf": bytes -> pages}`` for PDF files with fonts of their own."""
    use = EXTRACTORS | (extractors or {})
    files = resolve_inputs(spark, paths)
    lacking = sorted({f[f.rindex(".") :].lower() for f in files} - set(use))
    if lacking:
        raise ValueError(f"no extractor for {', '.join(lacking)}")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(p, n, i + 1, t) for p, n, c in zip(frame["path"], frame["length"], frame["content"], strict=True) for i, t in enumerate(use[p[p.rindex(".") :].lower()](bytes(c)))]
            yield pd.DataFrame(rows, columns=["path", "size", "page", "text"])

    pages = spark.read.format("binaryFile").load(files).select("path", "length", "content").mapInPandas(run, "path string, size long, page int, text string")
    return pages.select(F.regexp_extract("path", r"([^/]+)\.[^./]*$", 1).alias("doc_id"), "path", "size", "page", "text")


def whole_documents(pages: DataFrame) -> DataFrame:
    """(doc_id, text): the pages of each document in order, between blank lines."""
    ordered = F.array_sort(F.collect_list(F.struct("page", "text")))
    return pages.groupBy("doc_id").agg(F.trim(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n\n")).alias("text"))


def page_statistics(pages: DataFrame) -> DataFrame:
    """One row (num_pages, num_tokens, file_size, num_files)."""
    files = pages.groupBy("path").agg(F.max("size").alias("size")).agg(F.coalesce(F.sum("size"), F.lit(0)).alias("file_size"), F.count("*").alias("num_files"))
    return pages.agg(F.count("*").alias("num_pages"), F.coalesce(F.sum(token_estimate(F.col("text"))), F.lit(0)).alias("num_tokens")).crossJoin(files)


def document_statistics(pages: DataFrame, paged: bool = True) -> DataFrame:
    """(doc_id, pages, size_mb, words, tokens); formats without pages have 0."""
    words = F.regexp_count("text", F.lit(r"[\p{L}\p{N}_]+"))
    return pages.groupBy("doc_id").agg((F.count("*") if paged else F.lit(0)).cast("long").alias("pages"), (F.max("size") / 1048576).alias("size_mb"), F.sum(words).cast("long").alias("words"), F.sum(token_estimate(F.col("text"))).alias("tokens"))


def jsonl_statistics(rows: DataFrame, size: int) -> DataFrame:
    """One row (pages, size_mb): lines that have a page."""
    return rows.agg(F.count_if(F.col("page").isNotNull()).alias("pages")).withColumn("size_mb", F.lit(size / 1048576))


def clean_table(latex: Column) -> Column:
    """The body of a LaTeX array on one line, cells divided by bars."""
    t = F.regexp_replace(latex, r"\\text\{([^}]*)\}", "$1")
    t = F.replace(F.replace(t, F.lit("\\\\"), F.lit("\n")), F.lit("&"), F.lit(" | "))
    t = F.regexp_replace(F.regexp_replace(t, r"\\[a-zA-Z]+", ""), r"\^(\{2\}|\{2|2\}|2)", "²")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def strip_markup(text: Column) -> Column:
    """Without tags and LaTeX commands."""
    t = F.regexp_replace(F.regexp_replace(text, r"<[^>]+>", ""), r"\\[a-zA-Z]+(\{[^}]*\})?", "")
    return F.trim(F.replace(t, F.lit("\\n"), F.lit("\n")))


TABLE_MARK = "Table 1: Pinout description"


def jsonl_text(rows: DataFrame) -> DataFrame:
    """``rows(out, raw_out)`` with ``text``: out unless blank; a marked table cleaned; else raw_out without markup."""
    table = F.when(F.contains("raw_out", F.lit(TABLE_MARK)), F.concat_ws("\n\n", F.lit(TABLE_MARK), F.nullif(clean_table(F.regexp_extract("raw_out", r"(?s)\\begin\{array\}(.*?)\\end\{array\}", 1)), F.lit(""))))
    rest = F.when(F.coalesce("out", F.lit("")) == "", F.nullif(strip_markup(F.col("raw_out")), F.lit("")))
    return rows.withColumn("text", F.concat_ws("\n\n", F.when(F.trim("out") != "", F.col("out")), F.coalesce(table, rest)))


def json_text(row: dict) -> str:
    """The same for one parsed line, for the page reader."""
    parts = [row["out"]] if (row.get("out") or "").strip() else []
    raw = row.get("raw_out") or ""
    if TABLE_MARK in raw:
        parts.append(TABLE_MARK)
    elif not row.get("out"):
        parts.append(re.sub(r"\\[a-zA-Z]+(\{[^}]*\})?", "", re.sub(r"<[^>]+>", "", raw)).replace("\\n", "\n").strip())
    return "\n\n".join(p for p in parts if p)
