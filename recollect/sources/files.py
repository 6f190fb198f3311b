"""Files in and out: JSON lines with their several rules, folders of text, payloads in base64, banks as tables."""

from __future__ import annotations

import re
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions.text import collapsed


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines are passed over, an absent file is empty, a broken line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path) if exists(spark, path) else spark.createDataFrame([], schema)


def read_lenient(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; broken ones are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_commented(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with # comments; a line that doesn't parse is an error."""
    lines = spark.read.text(path).where("trim(value) <> '' AND NOT startswith(trim(value), '#')")
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def write_records(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def latest(history: DataFrame, ts: str, n: int = 200) -> DataFrame:
    """The n newest records, newest first."""
    return history.orderBy(F.col(ts).desc()).limit(n)


def last_lines(spark: SparkSession, path: str, schema: str, n: int = 200) -> DataFrame:
    """The last n good records of a JSON lines file in the order of its lines; broken lines are dropped before the cut."""
    lines = spark.read.text(path).select("value", F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")).alias("at"))
    parsed = lines.select("at", F.from_json("value", schema + ", _broken string", {"columnNameOfCorruptRecord": "_broken"}).alias("r")).where("r IS NOT NULL AND r._broken IS NULL")
    return parsed.orderBy(F.col("at").desc()).limit(n).orderBy("at").select("r.*").drop("_broken")


def text_folder(spark: SparkSession, folder: str, min_chars: int, max_chars: int) -> DataFrame:
    """path, pos, text: paragraphs of the folder's .md and .txt files within the length band (both ends count), without code fences, the first of equal ones."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.{md,txt}").text(folder).select(F.col("_metadata.file_path").alias("path"), "value")
    p = files.select("path", F.posexplode(F.split("value", r"\n\s*\n")).alias("pos", "raw")).select("path", "pos", collapsed(F.col("raw")).alias("text"))
    p = p.where(F.length("text").between(min_chars, max_chars) & ~F.contains("text", F.lit("```")))
    first = p.groupBy("text").agg(F.min(F.struct("path", "pos")).alias("f"))
    return p.join(first, "text").where((F.col("path") == F.col("f.path")) & (F.col("pos") == F.col("f.pos"))).select("path", "pos", "text")


def markdown_sections(text: Column) -> Column:
    """Structs (heading, body) of a text's sections, which begin at lines with #; what stands before the first has no heading."""
    parts = F.split(F.concat(F.lit("\n"), text), r"\n(?=#{1,6} )")
    split = F.transform(parts, lambda p: F.struct(F.trim(F.regexp_extract(p, r"^#{1,6} ([^\n]*)", 1)).alias("heading"), F.btrim(F.regexp_replace(p, r"^#{1,6} [^\n]*\n?", ""), F.lit(" \t\r\n")).alias("body")))
    return F.filter(split, lambda s: s["body"] != "")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def from_base64(payload: Column) -> Column:
    """The text of a base64 payload; null where it is none."""
    return F.decode(F.try_to_binary(payload, F.lit("base64")), "utf-8")


_PDF_STRING = re.compile(rb"\(((?:\\.|[^\\()])*)\)|<([0-9A-Fa-f\s]+)>|(-?[0-9.]+)|(T\*|Td|TD|Tm|')", re.S)
_PDF_ESCAPE = re.compile(rb"\\([0-7]{1,3}|.)", re.S)
# What a character after a backslash stands for in a PDF string.
_PDF_CHARACTERS = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _pdf_line(block: bytes) -> str:
    """The strings of a text block: literal and hexadecimal ones; a wide gap or a move to another line is a space."""
    unescaped = lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else _PDF_CHARACTERS.get(m[1], m[1])
    parts: list[bytes] = []
    for literal, digits, gap, move in _PDF_STRING.findall(block):
        if digits:
            code = bytes.fromhex((h := re.sub(rb"\s", b"", digits).decode()) + "0" * (len(h) % 2))
            parts.append(code.decode("utf-16-be", "ignore").encode("latin-1", "ignore") if len(code) > 1 and not any(code[::2]) else code)
        elif literal:
            parts.append(_PDF_ESCAPE.sub(unescaped, literal))
        elif parts and not parts[-1].endswith(b" ") and (move or float(gap.strip(b".") or 0) < -180):
            parts.append(b" ")
    return b"".join(parts).decode("latin-1").rstrip(" ")


def pdf_content(data: bytes, most: int = 20_000_000) -> tuple[str, str | None]:
    """The text of a PDF's content streams, plain or deflated, and a warning (None: all was read). Each stream is inflated up to `most` bytes; a longer one is cut there, and the warning says so."""
    out: list[str] = []
    cut = 0
    for m in re.finditer(rb"stream\r?\n(.*?)\r?\nendstream", data, re.S):
        body = m[1]
        try:
            inflater = zlib.decompressobj()
            body = inflater.decompress(body, most)
            cut += bool(inflater.unconsumed_tail)
        except zlib.error:
            pass
        out += [_pdf_line(block) for block in re.findall(rb"BT(.*?)ET", body, re.S)]
    return "\n".join(x for x in out if x.strip()), f"{cut} streams were cut at {most} bytes" if cut else None


def pdf_text(data: bytes, most: int = 20_000_000) -> str:
    return pdf_content(data, most)[0]


def extracted(files: DataFrame) -> DataFrame:
    """files: path, content (as of the source binaryFile). path, kind, text and warning: by suffix; other kinds have no text."""

    @F.pandas_udf("text string, warning string")
    def pdf_columns(data: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None) if x is None else pdf_content(bytes(x)) for x in data], columns=["text", "warning"])

    kind, none = suffix(F.col("path")), F.lit(None).cast("string").alias("warning")
    plain = kind.isin(".txt", ".md", ".csv", ".json", ".html")
    a = files.where(plain).select("path", kind.alias("kind"), F.decode("content", "utf-8").alias("text"), none)
    b = files.where(kind == ".pdf").select("path", kind.alias("kind"), pdf_columns(F.col("content")).alias("p")).select("path", "kind", "p.text", "p.warning")
    c = files.where(~plain & (kind != ".pdf")).select("path", kind.alias("kind"), F.lit(None).cast("string").alias("text"), none)
    return a.unionByName(b).unionByName(c)


class Bank:
    """A memory bank as a folder of parquet tables: cells, texts, edges and meta."""

    SCHEMAS = {
        "cells": "cell_id long, label string, weight array<float>, theta double, kind string, created_at double",
        "texts": "cell_id long, text string",
        "edges": "bound_cell_id long, source_cell_id long",
        "meta": "key string, value string, ts double",
    }

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        return self.spark.read.schema(self.SCHEMAS[name]).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], self.SCHEMAS[name])

    def append(self, name: str, rows: DataFrame) -> None:
        rows.select(*[c.split()[0] for c in self.SCHEMAS[name].split(", ")]).write.mode("append").parquet(f"{self.folder}/{name}")

    def count(self) -> int:
        return self.table("cells").count()

    def cell(self, cell_id: int) -> DataFrame:
        sources = self.table("edges").where(F.col("bound_cell_id") == cell_id).agg(F.array_sort(F.collect_list("source_cell_id")).alias("sources"))
        return self.table("cells").where(F.col("cell_id") == cell_id).join(self.table("texts"), "cell_id", "left").join(F.broadcast(sources))

    def page(self, limit: int, offset: int = 0, kind: str | None = None) -> DataFrame:
        cells = self.table("cells")
        return (cells if kind is None else cells.where(F.col("kind") == kind)).orderBy("cell_id").offset(offset).limit(limit)

    def put(self, key: str, value: Column, ts: float) -> None:
        self.append("meta", self.spark.range(1).select(F.lit(key).alias("key"), F.to_json(F.struct(value.alias("v"))).alias("value"), F.lit(ts).alias("ts")))

    def get(self, key: str, kind: str, default=None):
        """The latest value of a key, parsed as the SQL type `kind`."""
        row = self.table("meta").where(F.col("key") == key).agg(F.max_by("value", "ts").alias("v")).select(F.from_json("v", f"v {kind}")["v"].alias("v")).first()
        return default if row["v"] is None else row["v"]

    def info(self) -> DataFrame:
        cells = self.table("cells")
        return cells.agg(F.count(F.lit(1)).alias("n_cells"), F.count_if(F.col("kind") == "bound").alias("n_bound"), F.max(F.size("weight")).alias("dim"), F.max("cell_id").alias("last_id"))
