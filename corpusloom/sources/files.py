"""Scans of source trees and document folders, as DataFrames of files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom import schema
from corpusloom.sources import java, sections

# Folders whose files are no sources; where tests lie; suffixes of documents; our own output.
SKIPPED = ("/target/", "/build/", "/.git/", "/generated-sources/")
TESTS = "/src/test/"
DOCUMENTS = r"(?i)\.(html?|docx|pdf)$"
OWN = ".corpusloom"


def _files(spark: SparkSession, root: str, below: str | None, glob: str | None) -> DataFrame:
    """path relative to root, content of all files."""
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    full = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/")
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    found = reader.load(f"{full}/{below}" if below else full)
    plain = lambda c: F.regexp_replace(F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), "^[a-z]+:/+", "/")
    at = F.lit(full.split(":", 1)[-1])
    length = F.length(F.regexp_replace(at, "^/+", "/"))
    return found.select(F.substr(plain(F.col("path")), length + 2).alias("path"), "content")


def java_files(spark: SparkSession, root: str, subpath: str | None = None, include_tests: bool = False) -> DataFrame:
    """path, content of *.java below root (or its subpath; paths stay relative to root). The relative path decides what is skipped."""
    files = _files(spark, root, subpath, "*.java")
    at = F.concat(F.lit("/"), "path")
    for part in SKIPPED + (() if include_tests else (TESTS,)):
        files = files.where(F.instr(at, part) == 0)
    return files


def document_files(spark: SparkSession, root: str) -> DataFrame:
    """path, content of documents by suffix, without lock files and our own output."""
    files = _files(spark, root, None, None)
    name = F.regexp_replace("path", "^.*/", "")
    return files.where(F.col("path").rlike(DOCUMENTS) & ~name.startswith("~$") & (F.instr(F.concat(F.lit("/"), "path"), f"/{OWN}/") == 0))


def readable(files: DataFrame) -> DataFrame:
    """path, text of the files that are UTF-8."""
    return files.select("path", F.expr("try_validate_utf8(cast(content as string))").alias("text")).where("text IS NOT NULL")


JAVA = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("fragments", T.ArrayType(schema.JAVA_FRAGMENT)), T.StructField("edges", T.ArrayType(schema.JAVA_EDGE)),
    T.StructField("fields", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
])


def parsed_java(files: DataFrame) -> DataFrame:
    """path, fragments, edges, fields of each readable file; a file is scanned once."""

    def run(batches):
        for pdf in batches:
            rows = []
            for path, text in pdf.itertuples(index=False, name=None):
                found = java.scan(text)
                rows.append((path, java.fragments(text, found), java.edges(text, found), found.fields))
            yield pd.DataFrame(rows, columns=["path", "fragments", "edges", "fields"])

    return readable(files).mapInPandas(run, JAVA)


PARSED = T.StructType([T.StructField("path", T.StringType()), T.StructField("sections", T.ArrayType(schema.SECTION)), T.StructField("markdown", T.StringType()), T.StructField("error", T.StringType())])


def parsed_documents(files: DataFrame, max_chars: int = sections.MAX_CHARS) -> DataFrame:
    """path, sections, the archived markdown of binary formats, and an error instead of sections; no file ends the run."""

    def run(batches):
        for pdf in batches:
            rows = []
            for path, content in pdf.itertuples(index=False, name=None):
                found, md, error = sections.parse_document(path, bytes(content), max_chars)
                rows.append((path, None if found is None else [s.row() for s in found], md, error))
            yield pd.DataFrame(rows, columns=PARSED.names)

    return files.mapInPandas(run, PARSED)

