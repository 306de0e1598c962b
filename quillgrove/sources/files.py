"""Scans and sinks: tables as CSV, JSON, text and binary files, vector stores, private corpora, graphs."""

from __future__ import annotations

import importlib.util
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ABSTRACTS = "grant_id string, title string, abstract string, year int, institute string, institution string, abstract_length int, word_count int, fqhc_keyword_count int, has_fqhc_terms boolean"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir, or of setCheckpointDir; in a temporary one only on a local master without either."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quillgrove-"))
    path = f"{sc._jsc.sc().getCheckpointDir().get().rstrip('/')}/{name}-{uuid.uuid4().hex}"
    sc._quillgrove_scratch = [*getattr(sc, "_quillgrove_scratch", []), path]
    return path


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def clean(spark: SparkSession) -> int:
    """Deletes what this session wrote between steps, and says how many; for when the results were consumed."""
    sc = spark.sparkContext
    paths, sc._quillgrove_scratch = getattr(sc, "_quillgrove_scratch", []), []
    for path in paths:
        remove(spark, path)
    return len(paths)


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once in the shared folder and read again; a lost executor costs nothing of it."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


#: Two noncharacters, as null in CSV that must keep empty texts apart from it.
NULL = "\ufdd0\ufdd1"


def read_csv(spark: SparkSession, path: str, schema: str | StructType = ABSTRACTS, null: str = "") -> DataFrame:
    """CSV with a header, quotes doubled and lines inside quotes; columns by the schema, never inferred.

    Fields without anything are null, and those that are ``null``; by default so are empty quotes.
    """
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"', nullValue=null)


def write_csv(df: DataFrame, path: str, null: str = "") -> None:
    """CSV as ``read_csv`` takes it, white space at either end of a text kept; null is written as ``null``."""
    df.write.csv(path, header=True, quote='"', escape='"', quoteAll=True, nullValue=null, emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def read_json(spark: SparkSession, path: str, schema: str | StructType, one_document: bool = False) -> DataFrame:
    """JSON lines, or files that are one document each."""
    return spark.read.schema(schema).json(path, multiLine=one_document)


def read_texts(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """(path, text) of whole text files, in all folders below."""
    return spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def listing(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, name, size, modified) of files in all folders below; their contents aren't read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return f.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


Extractor = Callable[[bytes], list[str]]


def read_documents(spark: SparkSession, path: str, extract: Extractor, fallback: Extractor | None = None, least: int = 100, pattern: str = "*.pdf") -> DataFrame:
    """(path, text, page_count, extraction_method, warning) of binary documents.

    ``extract`` gives the pages of a file; where they have fewer than ``least`` characters a page, or
    it fails, the fallback is tried. No PDF library is part of this package: pass one's function.
    """

    def pages(f: Extractor, content: bytes) -> tuple[list[str] | None, str | None]:
        try:
            return f(content), None
        except Exception as e:  # a broken file is a row with a warning, not a failed job
            return None, f"{type(e).__name__}: {e}"

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, content in zip(b["path"], b["content"]):
                got, warning = pages(extract, content)
                method = "primary"
                if fallback and (not got or sum(map(len, got)) < least * len(got)):
                    again, more = pages(fallback, content)
                    if again and sum(map(len, again)) > sum(map(len, got or [])):
                        got, method = again, "fallback"
                    warning = warning or more
                rows.append((p, "\n\n".join(got or []), len(got or []), method if got else "failed", warning))
            yield pd.DataFrame(rows, columns=["path", "text", "page_count", "extraction_method", "warning"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", "content").mapInPandas(scan, "path string, text string, page_count int, extraction_method string, warning string")


def pdf_extractors() -> tuple[Extractor, Extractor | None]:
    """Functions for ``read_documents`` from the PDF libraries that are installed: one that keeps the layout first, then others.

    None of them is part of this package; without any this is an error.
    """

    def plumber(content: bytes) -> list[str]:
        import io

        import pdfplumber

        with pdfplumber.open(io.BytesIO(content)) as pdf:
            return [page.extract_text(layout=True) or "" for page in pdf.pages]

    def mupdf(content: bytes) -> list[str]:
        import fitz

        with fitz.open(stream=content, filetype="pdf") as pdf:
            return [page.get_text() for page in pdf]

    def pure(content: bytes) -> list[str]:
        import io

        import pypdf

        return [page.extract_text() or "" for page in pypdf.PdfReader(io.BytesIO(content)).pages]

    there = [f for name, f in (("pdfplumber", plumber), ("fitz", mupdf), ("pypdf", pure)) if importlib.util.find_spec(name)]
    if not there:
        raise ModuleNotFoundError("install pdfplumber, pymupdf or pypdf on the workers, or pass an extractor of your own")
    return there[0], there[1] if len(there) > 1 else None


def replace(df: DataFrame, path: str, at: str | None = None) -> str | None:
    """df as the table at path; what stood there is kept beside it, and the name of that backup returned.

    The new rows are written first, so that they may come from the table itself and a failure leaves
    it as it is; then two renames swap them. ``at`` names the backup, the time by default.
    """
    spark = df.sparkSession
    path = path.rstrip("/")
    new, backup = f"{path}-new-{uuid.uuid4().hex}", f"{path}-backup-{at or datetime.now().strftime('%Y%m%d_%H%M%S_%f')}"
    df.write.parquet(new)
    old_, new_, backup_ = (spark._jvm.org.apache.hadoop.fs.Path(x) for x in (path, new, backup))
    fs = old_.getFileSystem(spark._jsc.hadoopConfiguration())
    there = fs.exists(old_)
    if there and (fs.exists(backup_) or not fs.rename(old_, backup_)):
        raise FileExistsError(backup)
    if not fs.rename(new_, old_):
        raise OSError(f"{new} can't be moved to {path}")
    return backup if there else None


def save_chunks(chunks: DataFrame, path: str) -> None:
    """Chunks with their vectors, once."""
    chunks.write.mode("overwrite").parquet(path)


def load_chunks(spark: SparkSession, path: str, expected: int | None = None) -> DataFrame:
    """Chunks as saved; an error if their number isn't the expected one."""
    d = spark.read.parquet(path)
    if expected is not None and (n := d.count()) != expected:
        raise ValueError(f"{path} has {n} chunks, expected {expected}")
    return d


class Store:
    """Named collections as tables of one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):  # noqa: ANN202
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self, name: str):  # noqa: ANN202
        return self._path(name).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        return self._fs(name).exists(self._path(name))

    def create(self, name: str, rows: DataFrame) -> bool:
        """Makes a collection of rows; False, and nothing is done, if there is one."""
        if self.exists(name):
            return False
        rows.write.parquet(f"{self.root}/{name}")
        return True

    def append(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        self._fs(name).delete(self._path(name), True)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    def count(self, name: str) -> int:
        return self.read(name).count() if self.exists(name) else 0


def append_private(chunks: DataFrame, path: str, user: str) -> None:
    """Adds a user's chunks; partitions keep users apart, and reading one prunes the others."""
    rows = chunks.withColumns({"corpus_type": F.lit("private"), "user_id": F.lit(user)})
    rows.write.mode("append").partitionBy("corpus_type", "user_id").parquet(path)


def read_private(spark: SparkSession, path: str, user: str) -> DataFrame:
    return spark.read.parquet(path).where((F.col("corpus_type") == "private") & (F.col("user_id") == user))


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes, edges and one row about them."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")
    spark = nodes.sparkSession
    n, m = (spark.read.parquet(f"{path}/{x}").count() for x in ("nodes", "edges"))
    spark.createDataFrame([(n, m)], "n_nodes long, n_edges long").withColumn("saved_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{path}/meta")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{path}/{x}") for x in ("nodes", "edges", "meta"))
