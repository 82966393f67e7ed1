"""CSV files before they are read: admission, encoding, dialect, header, fingerprint.

Each task opens its own files and reads them piece by piece to the end, for the encoding and for NUL bytes; a
file is never held whole, so its size does not matter.
"""

from __future__ import annotations

import codecs
import csv
import hashlib
import io
import re
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.session import ship, small_frame

# Bytes that the dialect is told from, delimiters considered, byte-order marks.
HEAD_BYTES, PIECE_BYTES = 65_536, 1 << 20
DELIMITERS = ",;\t|"
UTF8_MARK, UTF16_MARKS = b"\xef\xbb\xbf", (b"\xff\xfe", b"\xfe\xff")


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Rows (path, length, modified); the content column is not read.

    A scan leaves empty files out, so the names come from the file index and the scan adds the rest.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    names = small_frame(spark, [(re.sub("^file:/+", "file:/", unquote(f)),) for f in files.inputFiles()], "path string")
    facts = files.select("path", "length", F.date_format("modificationTime", "yyyy-MM-dd HH:mm:ss").alias("modified"))
    return names.join(facts, "path", "left").select("path", F.coalesce("length", F.lit(0)).alias("length"), "modified")


def open_stream(uri: str):
    """Open a file of any file system pyarrow knows."""
    from pyarrow import fs

    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem().open_input_stream(re.sub("^file:/*", "/", uri))
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_stream(path)


class Encodings:
    """Fed with all pieces of a file: by mark, else the first of utf-8 and cp1252 that decodes it, else latin-1."""

    def __init__(self, head: bytes):
        self.marked = "utf-8-sig" if head.startswith(UTF8_MARK) else "utf-16" if head.startswith(UTF16_MARKS) else None
        self.left = {name: codecs.getincrementaldecoder(name)() for name in ("utf-8", "cp1252")}

    def feed(self, piece: bytes, final: bool = False) -> None:
        for name in list(self.left):
            try:
                self.left[name].decode(piece, final=final)
            except UnicodeDecodeError:
                del self.left[name]

    @property
    def name(self) -> str:
        return self.marked or next(iter(self.left), "latin-1")


def guess_dialect(text: str) -> tuple[str, str]:
    """Delimiter and quote; a one-column file has none to find and gets a comma."""
    try:
        found = csv.Sniffer().sniff(text, delimiters=DELIMITERS)
        return found.delimiter, found.quotechar or '"'
    except csv.Error:
        return ",", '"'


def describe(stream) -> dict:
    """Encoding, dialect and header of an open file. The head grows until it holds a whole first line."""
    head = stream.read(HEAD_BYTES)
    piece = head
    encodings, nul, first = Encodings(head), False, b"\n" not in head
    while piece:
        encodings.feed(piece)
        nul = nul or b"\x00" in piece
        piece = stream.read(PIECE_BYTES)
        if first and piece:
            head, first = head + piece, b"\n" not in piece
    encodings.feed(b"", final=True)
    text = codecs.getincrementaldecoder(encodings.name)(errors="strict").decode(head, final=False)
    delimiter, quote = guess_dialect(text[:HEAD_BYTES]) if text.strip() else (",", '"')
    header = next(csv.reader(io.StringIO(text), delimiter=delimiter, quotechar=quote), [])
    return {
        "nul": nul, "marked": head.startswith(UTF16_MARKS), "encoding": encodings.name,
        "delimiter": delimiter, "quotechar": quote, "header": header, "blank": not text.strip(),
    }


INSPECTED = ("path string, length bigint, modified string, nul boolean, marked boolean, encoding string, "
             "delimiter string, quotechar string, header array<string>, blank boolean")


def inspect_files(files: DataFrame) -> DataFrame:
    """Encoding, dialect and header of each listed file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, length, modified in pdf.itertuples(index=False):
                with open_stream(path) as stream:
                    rows.append({"path": path, "length": length, "modified": modified, **describe(stream)})
            yield pd.DataFrame(rows, columns=[c.strip().split(" ")[0] for c in INSPECTED.split(", ")])

    ship(files.sparkSession)
    return files.mapInPandas(run, INSPECTED)


def file_admission(inspected: DataFrame) -> DataFrame:
    """Is each file a readable CSV: named .csv, not empty, no NUL bytes unless marked as UTF-16."""
    name = F.element_at(F.split("path", "/"), -1)
    reason = (
        F.when(~F.lower("path").endswith(".csv"), "not a .csv file").when(F.col("length") == 0, "empty file")
        .when(F.col("nul") & ~F.col("marked"), "binary content").when(F.col("blank"), "no readable text")
    )
    return inspected.select(name.alias("file"), "length", reason.isNull().alias("admitted"), reason.alias("reason"))


def header_audit(inspected: DataFrame) -> DataFrame:
    """Blank and repeated (ignoring case) column names per file."""
    name = F.element_at(F.split("path", "/"), -1)
    cols = inspected.select(name.alias("file"), F.posexplode("header").alias("place", "raw"))
    low = F.lower(F.trim("raw"))
    return cols.groupBy("file", low.alias("name")).agg(F.count("*").alias("times"), F.min("place").alias("first_place")).select(
        "file", "name", "times", "first_place",
        F.when(F.col("name") == "", "blank").when(F.col("times") > 1, "duplicate").otherwise("ok").alias("finding"))


def dialect_report(inspected: DataFrame) -> DataFrame:
    return inspected.select(F.element_at(F.split("path", "/"), -1).alias("file"), "encoding", "delimiter", "quotechar", F.size("header").alias("columns"))


def file_fingerprint(files: DataFrame) -> DataFrame:
    """SHA-256 of each file, read in pieces."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sums = []
            for path in pdf["path"]:
                digest = hashlib.sha256()
                with open_stream(path) as stream:
                    while piece := stream.read(1 << 20):
                        digest.update(piece)
                sums.append(digest.hexdigest())
            yield pdf.assign(sha256=sums)[["path", "length", "sha256"]]

    ship(files.sparkSession)
    return files.select("path", "length").mapInPandas(run, "path string, length bigint, sha256 string")
