"""File sources: raw document files, pluggable page extractors, JSON readers.

Raw files are read with the ``binaryFile`` source (one row per file: path, length, content).
Text extraction is a pluggable function run per partition through ``mapInPandas``: bytes in,
page rows out. Two extractors ship: plain text (lines per page) and HTML (visible text).
No PDF decoder is installed here; one plugs in through the same hook.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAGE_ROWS = T.StructType([
    T.StructField("source_id", T.StringType()),
    T.StructField("page_number", T.IntegerType()),
    T.StructField("text", T.StringType()),
    T.StructField("error", T.StringType()),
])

Extractor = Callable[[str], list[str]]


def scan_files(spark: SparkSession, directory: str, glob: str = "*") -> DataFrame:
    """``binaryFile`` scan with the content; empty files are flagged (``status``)."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(directory)
    return df.select(
        "path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", "modificationTime", "content",
        F.when(F.col("length") > 0, F.lit("ok")).otherwise(F.lit("empty file")).alias("status"),
    )


_SCRIPT = re.compile(r"<(script|style)\b.*?</\1\s*>", re.S | re.I)
_BREAK = re.compile(r"<\s*(br|/p|/div|/li|/h[1-6]|/tr|/title)\b[^>]*>", re.I)
_TAG = re.compile(r"<[^>]+>")


def html_text(raw: str) -> str:
    """Visible text of an HTML page: scripts/styles dropped, block ends become new lines."""
    s = _SCRIPT.sub(" ", raw)
    s = _BREAK.sub("\n", s)
    s = _TAG.sub(" ", s)
    s = _html.unescape(s)
    lines = [" ".join(line.split()) for line in s.split("\n")]
    return "\n".join(line for line in lines if line)


def lines_extractor(lines_per_page: int = 5) -> Extractor:
    def extract(text: str) -> list[str]:
        lines = text.split("\n")
        return ["\n".join(lines[i:i + lines_per_page]) for i in range(0, max(len(lines), 1), lines_per_page)]
    return extract


def html_extractor(lines_per_page: int = 5) -> Extractor:
    inner = lines_extractor(lines_per_page)
    return lambda raw: inner(html_text(raw))


def extract_pages(files: DataFrame, id_col: str, content_col: str,
                  extractor: Extractor | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Run an extractor over every file (per partition, Arrow batches); one row per page.

    A file that fails to decode yields one row with ``error`` set, the rest go on. The file
    columns ``keep`` come back on each of its pages.
    """
    kept = files.select(*keep).schema
    ex = extractor or html_extractor()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out_id, out_no, out_text, out_err, out_row = [], [], [], [], []
            for row, (sid, content) in enumerate(zip(pdf[id_col], pdf[content_col])):
                try:
                    raw = content.decode("utf-8") if isinstance(content, (bytes, bytearray)) else str(content)
                    pages = ex(raw)
                    for i, t in enumerate(pages, start=1):
                        out_id.append(str(sid)), out_no.append(i), out_text.append(t), out_err.append(None), out_row.append(row)
                except Exception as e:  # noqa: BLE001
                    out_id.append(str(sid)), out_no.append(None), out_text.append(None), out_err.append(repr(e)), out_row.append(row)
            out = {"source_id": out_id, "page_number": pd.array(out_no, dtype="Int32"), "text": out_text, "error": out_err}
            yield pd.DataFrame(out | {c: pdf[c].iloc[out_row].to_numpy() for c in keep})

    return files.select(id_col, content_col, *[c for c in keep if c not in (id_col, content_col)]).mapInPandas(
        run, T.StructType(PAGE_ROWS.fields + kept.fields))


def pages_function(extractor: Extractor | None = None):
    """The extractor as a table function ``(content) -> (page_number, text, error)``: one row a page, or one row with the
    error of a file it fails on (null content gives no row). Arguments and rows travel in Arrow batches."""
    ex = extractor or html_extractor()

    class Pages:
        def eval(self, content):
            if content is None:
                return
            try:
                raw = content.decode("utf-8") if isinstance(content, (bytes, bytearray)) else str(content)
                pages = list(ex(raw))
            except Exception as e:  # noqa: BLE001
                yield None, None, repr(e)
                return
            for i, t in enumerate(pages, start=1):
                yield i, t, None

    return F.udtf(Pages, returnType="page_number int, text string, error string", useArrow=True)


def register_pages_function(spark: SparkSession, name: str = "html_pages", extractor: Extractor | None = None) -> None:
    """Makes the extractor known to SQL: ``SELECT f.name, p.* FROM files f, LATERAL html_pages(f.content) p``."""
    spark.udtf.register(name, pages_function(extractor))


def extract_pages_lateral(files: DataFrame, id_col: str, content_col: str, extractor: Extractor | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """:func:`extract_pages` by a lateral join with the table function."""
    p = pages_function(extractor)(F.col(content_col).outer())
    return files.lateralJoin(p).select(F.col(id_col).cast("string").alias("source_id"), "page_number", "text", "error", *keep)


def extract_html_pages(pages_table: DataFrame) -> DataFrame:
    """``pages(page_id, url, html)`` -> page rows of visible text, collection named from the url."""
    from folio.functions.text import collection_name
    named = pages_table.select(F.col("page_id").cast("string").alias("sid"), "html", collection_name(F.col("url")).alias("collection"))
    return extract_pages(named, "sid", "html", keep=("collection",))


def read_json_results(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False) -> DataFrame:
    """Saved result JSON with a known schema (JSON lines, or one document per file with
    ``multi_line``); a missing path gives an empty frame instead of an error."""
    from folio.operators.chunks import path_exists
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)
