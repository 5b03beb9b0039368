"""Token ids in ORC files: integer run-length encoding, row indexes and Bloom filters on document ids.

``write`` orders documents by id (null first; equal ids by a hash of their texts), deals ranges of ids to tasks of about
``text_bytes`` each, and encodes where the file is written, so that texts are shuffled, which are smaller than ids. A
row has up to ``row_ids`` ids of one document, where the document begins in its file and how many ids it has; very long
documents take several rows, so neither writers nor readers hold more than a batch of bounded rows. Stripes are read in
parallel, and a search for documents reads only files whose range of ids, stripes whose index and rows whose Bloom
filter allow them. What the files hold is told by a small table beside them (``_files``): one row a file, at most
``most_files``, with its range of ids and the number of ids in all files before it.

Null texts count as empty, and an empty text has one id, the end mark. Very long texts are encoded whole. Repeated rows
are separate documents, next to each other. Other columns are not read. An empty table gives files without rows.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corrob.llm import tokens
from corrob.llm.common import slices, utf8

END_ID = 0
#: Rows that a worker hands on at once: 4 MB of ids.
HANDED_ROWS = 256


@dataclass(frozen=True)
class FileParams:
    """row_ids: ids a row at most; text_bytes: of a file's texts, about; most_files: beyond which files grow instead;
    stripe_bytes and stride: of the ORC writer; false_hits: share of row groups that the Bloom filter lets pass wrongly."""

    row_ids: int = 4096
    text_bytes: int = 128 << 20
    most_files: int = 50_000
    stripe_bytes: int = 32 << 20
    stride: int = 1000
    false_hits: float = 0.01


def rows_of(docs: DataFrame, tokenizer: str, p: FileParams = FileParams()) -> DataFrame:
    """``doc_id, at, part, n_tokens, ids`` of documents (``doc_id``, ``text`` in UTF-8), in their order, partition by partition."""
    import numpy as np

    names = ["doc_id", "at", "part", "n_tokens", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, at = tokens.encoder(tokenizer), END_ID.to_bytes(4, "little"), 0
        for b in slices(batches, 1):
            ids = [encode(t.decode("utf-8", "replace")) + end if t else end for t in b.column(1).to_pylist()]
            n = np.array([len(x) // 4 for x in ids], np.int64)
            rows = -(-n // p.row_ids)
            doc = np.repeat(np.arange(len(n)), rows)
            part = np.arange(len(doc)) - np.repeat(np.cumsum(rows) - rows, rows)
            size = np.minimum(p.row_ids, n[doc] - part * p.row_ids)
            first = at + np.cumsum(n) - n
            at += int(n.sum())
            values = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(values))
            out = pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc)), pa.array(first[doc]), pa.array(part.astype(np.int32)), pa.array(n[doc]), lists], names=names)
            for k in range(0, out.num_rows, HANDED_ROWS):
                yield out.slice(k, HANDED_ROWS)

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, at long, part int, n_tokens long, ids array<int>")


def write(docs: DataFrame, path: str, tokenizer: str, p: FileParams = FileParams()) -> None:
    """The ids of ``docs`` as ORC files at ``path``, in ascending order of doc_id, and the table ``_files``."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = min(p.most_files, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // p.text_bytes)))
    keyed = docs.select("doc_id", utf8("text").alias("text"), F.xxhash64("text").alias("tie"))
    dealt = keyed.repartitionByRange(files, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    (
        rows_of(dealt, tokenizer, p).write.format("orc").option("compression", "zstd").option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", p.false_hits)
        .option("orc.create.index", "true").option("orc.row.index.stride", p.stride).option("orc.stripe.size", p.stripe_bytes).save(path)
    )
    # Ranges of a file and its number of ids: columns of the files' first rows. At most ``most_files`` rows are summed up in one task.
    found = spark.read.orc(path).where("part = 0").groupBy(F.col("_metadata.file_name").alias("file"))
    found = found.agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.bool_or(F.isnull("doc_id")).alias("nulls"), F.count(F.lit(1)).alias("docs"), F.max(F.col("at") + F.col("n_tokens")).alias("ids"))
    number = F.regexp_extract("file", r"part-(\d+)", 1).cast("long")
    before = Window.orderBy(number).rowsBetween(Window.unboundedPreceding, -1)
    found.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0))).coalesce(1).write.parquet(f"{path}/_files")


def files(spark: SparkSession, path: str) -> DataFrame:
    """file, least and most doc_id, nulls (whether it has documents without id), docs, ids, start: what ``write`` told of its files."""
    return spark.read.parquet(f"{path}/_files")


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), part, n_tokens, ids: the rows of the files."""
    rows = spark.read.orc(path).select("doc_id", "at", "part", "n_tokens", "ids", F.col("_metadata.file_name").alias("file"))
    # One row a file: ``most_files`` at most.
    rows = rows.join(F.broadcast(files(spark, path).select("file", F.col("start").alias("before"))), "file")
    return rows.select("doc_id", (F.col("before") + F.col("at")).alias("start"), "part", "n_tokens", "ids")


def lookup(spark: SparkSession, path: str, ids: list) -> DataFrame:
    """doc_id, start, n_tokens, ids (whole) of the documents with one of ``ids``; reads only what may have them."""
    known = files(spark, path)
    wanted = [r["file"] for r in known.where(F.exists(F.array(*map(F.lit, ids)), lambda i: i.between(F.col("least"), F.col("most")))).select("file").collect()]
    if not wanted:
        return read(spark, path).limit(0).drop("part")
    rows = spark.read.orc([f"{path}/{f}" for f in wanted]).where(F.col("doc_id").isin(ids))
    rows = rows.withColumn("file", F.col("_metadata.file_name")).join(F.broadcast(known.select("file", F.col("start").alias("before"))), "file")
    # A group is one document, which is asked for whole.
    grouped = rows.groupBy("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens").agg(F.sort_array(F.collect_list(F.struct("part", "ids"))).alias("parts"))
    return grouped.select("doc_id", "start", "n_tokens", F.flatten(F.transform("parts", lambda x: x["ids"])).alias("ids"))


def _times(a: int, b: int) -> int:
    """The product of two polynomials over bits modulo that of CRC-32; the highest bit is the coefficient of 1."""
    out = 0
    while a:
        if a >> 31:
            out ^= b
        a = a << 1 & 0xFFFFFFFF
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


@functools.lru_cache(maxsize=10_000)
def _shift(n: int) -> int:
    """x^(8·n): what a CRC is multiplied with when ``n`` bytes follow."""
    out, square = 1 << 31, 1 << 23  # 1 and x^8
    while n:
        if n & 1:
            out = _times(out, square)
        square, n = _times(square, square), n >> 1
    return out


def joined_crc(parts: list[tuple[int, int]]) -> int:
    """The CRC-32 of byte strings one after another, from (CRC, length) of each."""
    out = 0
    for crc, n in parts:
        out = _times(_shift(n), out) ^ crc
    return out


def digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document in the files at ``path``."""
    import numpy as np

    rows = read(spark, path)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(4)
            at, values = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<u4")
            crc = [zlib.crc32(values[s:e].tobytes()) for s, e in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(crc, pa.int64()), pa.array(4 * np.diff(at), pa.int64())], names=["doc_id", "start", "part", "n_tokens", "crc", "bytes"])

    parts = rows.mapInArrow(run, f"doc_id {kind}, start long, part int, n_tokens long, crc long, bytes long")

    @F.pandas_udf("long")
    def joined(groups: pd.Series) -> pd.Series:
        return pd.Series([None if g is None else joined_crc([(r["crc"], r["bytes"]) for r in g]) for g in groups], dtype="Int64")

    one = parts.groupBy("start").agg(F.first("doc_id").alias("doc_id"), F.first("n_tokens").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("part", "crc", "bytes"))).alias("parts"))
    several = F.when(F.size("parts") > 1, F.col("parts"))
    return one.select("doc_id", "start", "n_tokens", F.coalesce(joined(several), F.col("parts")[0]["crc"]).alias("ids_crc32"))
