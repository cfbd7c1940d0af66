"""Token ids as Parquet list columns, in ascending doc_id order.

Files hold (doc_id, n_tokens, ids): ids dictionary-encoded, the plain columns
delta-encoded, with bounded row groups and pages. A page index lets a reader
take some documents' ids, or the counts alone, without the rest of a file.
A document's place in the corpus (``start``) follows from the files' totals.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from .common import materialize, new_path, small_batches
from .tokens import encoder, tokenizer_path

END_ID = 2
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 1000
#: Text bytes of a file, and what a row counts beside its text.
FILE_BYTES, ROW_BYTES = 16 << 20, 64
SCHEMA = "doc_id long, n_tokens long, ids array<int>"


def _encode(tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer_path(tokenizer)), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            packed = [b + end for b in enc.encode_batch([t or "" for t in batch.column("text").to_pylist()])]
            counts = np.array([len(b) // 4 for b in packed], dtype=np.int64)
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), dtype="<u4").astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts), ids], ["doc_id", "n_tokens", "ids"])

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str = "byte_bpe_50k.json", end_id: int = END_ID, file_bytes: int | None = None) -> None:
    """Encode every whole text of ``docs`` (doc_id, text) and write the files.

    A null or empty text is the end id alone. Rows with a null doc_id come
    first; repeated doc_ids stay as rows, in the order of a hash of their texts,
    and may go on in the next file. Files are contiguous ranges in that order,
    of some ``file_bytes`` of text each (FILE_BYTES unless given; a task writes a
    file row by row, so that larger ones cost no memory); one document's ids, however many, are never split over
    files. Other columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    weight = slim.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES)).first()[0] or 0
    files = max(1, math.ceil(weight / (file_bytes or FILE_BYTES)))
    slim = slim.withColumn("h", F.xxhash64("text"))
    dealt = slim.repartitionByRange(files, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").drop("h")
    (
        dealt.mapInArrow(_encode(tokenizer, end_id), SCHEMA)
        .write.option("compression", "zstd")
        # The session may limit the rows of a file; here a range is a file.
        .option("maxRecordsPerFile", 0)
        .option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.block.size", ROW_GROUP_BYTES)
        .option("parquet.page.size", PAGE_BYTES)
        .option("parquet.page.row.count.limit", PAGE_ROWS)
        .option("parquet.enable.dictionary", "true")
        .option("parquet.enable.dictionary#doc_id", "false")
        .option("parquet.enable.dictionary#n_tokens", "false")
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """The files' rows, of doc_ids ``low`` to ``high`` if given; row groups and
    pages without them aren't read, and neither are columns not asked for."""
    out = spark.read.schema(SCHEMA).parquet(path)
    if low is not None:
        out = out.where(F.col("doc_id") >= low)
    return out if high is None else out.where(F.col("doc_id") <= high)


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        values, offsets = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), ids.offsets.to_numpy()
        crcs = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        counts = pa.array(np.diff(offsets).astype(np.int64))
        names = ["file", "row", "doc_id"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in names), counts, pa.array(crcs, pa.int64())], [*names, "n_tokens", "ids_crc32"]
        )


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """Of each document in the files: doc_id, start (ids of all documents before
    it), n_tokens and ids_crc32, from the ids as they are read back."""
    small_batches(spark)
    rows = read_tokens(spark, path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), "doc_id", "ids"
    )
    rows = materialize(
        rows.mapInArrow(_checksums, "file string, row long, doc_id long, n_tokens long, ids_crc32 long"), "token-index"
    )
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    # One row a file: files are numbered in the order of their ranges, and of the parts a range was cut into.
    number = F.struct(*[F.regexp_extract("file", "part-([0-9]+)-[^/]*?(?:-c([0-9]+))?[.][^/]*$", i).try_cast("long") for i in (1, 2)])
    earlier = Window.orderBy(number).rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return rows.join(files, "file").select(
        "doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )


def op8_token_files(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return token_index(spark, path)
