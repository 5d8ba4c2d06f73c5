"""Documents that keep arriving: a stream of files, each micro-batch ingested like a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.plans.engine import Engine, checkpointed
from corpusloom.sources import files as S

FILES = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])


def document_stream(engine: Engine, docs_path: str) -> DataFrame:
    """path, content of documents below a folder, as they arrive."""
    found = engine.spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True).load(docs_path)
    return found.where(F.col("path").rlike(S.DOCUMENTS)).select(F.regexp_replace("path", "^[a-z]+:/+", "/").alias("path"), "content")


def ingest_stream(engine: Engine, docs_path: str, repo: str, checkpoint: str):
    """Starts the stream. A batch that is run again changes nothing: fragments are upserted by key and hash."""

    def batch(df: DataFrame, _: int) -> None:
        root = docs_path.rstrip("/") + "/"
        local = df.select(F.when(F.startswith("path", F.lit(root)), F.substr("path", F.lit(len(root) + 1))).otherwise(F.col("path")).alias("path"), "content")
        engine.ingest_parsed(checkpointed(S.parsed_documents(local, engine.settings.max_chars)), repo)

    return document_stream(engine, docs_path).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
