"""Token-id files: whole texts as Simple-8b coded ids in ascending order of document.

The table is range-sorted by ``doc_id``, each partition is a shard of the file, and a shard is
a run of self-contained pages (:mod:`simple8b`). A page carries its number of ids and the ids
before it in its shard, so that a reader finds every document's place in the whole file from
the shards' totals alone.

Null texts are empty: their document holds the end id alone. Null ``doc_id`` come first, rows
of equal ``doc_id`` are kept and ordered by text. An empty table gives an empty file. Columns
other than ``doc_id`` and ``text`` are ignored. A page ends after ``PAGE_IDS`` ids, but never
inside a document.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import simple8b
from .tokenizing import END_ID, default_path, encoder
from .workspace import stash, table

PAGE_IDS = 1 << 20


def write_token_pages(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Pages of the file: shard, page, n_ids, first (ids before the page in its shard), payload."""

    def encode(batches):
        from pyspark import TaskContext

        shard, page, before = TaskContext.get().partitionId(), 0, 0
        held, lengths, keys, size = [], [], [], 0

        def flush():
            nonlocal held, lengths, keys, size, page, before
            payload = simple8b.write_page(np.concatenate(held), np.concatenate(lengths), keys)
            row = {"shard": [shard], "page": [page], "n_ids": [size], "first": [before], "payload": [payload]}
            page, before = page + 1, before + size
            held, lengths, keys, size = [], [], [], 0
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("shard", pa.int32()), ("page", pa.int32()), ("n_ids", pa.int64()), ("first", pa.int64()), ("payload", pa.binary())]))

        for batch in batches:
            ids_of, at = batch.column("doc_id").to_pylist(), 0
            for ids, n in encoder(tokenizer, end_id).encode(batch.column("text")):
                held.append(ids)
                lengths.append(n)
                keys += ids_of[at : at + len(n)]
                at, size = at + len(n), size + len(ids)
                if size >= PAGE_IDS:
                    yield flush()
        if keys:
            yield flush()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return stash(ordered.mapInArrow(encode, "shard int, page int, n_ids long, first long, payload binary"), "token-pages")


def read_token_pages(pages: DataFrame) -> DataFrame:
    """One row for each document of the file: doc_id, start, n_tokens, ids_crc32."""
    total = pages.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    # a row for each shard: as many as shuffle partitions
    before = total.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))
    placed = pages.join(F.broadcast(before), "shard").select((F.col("shard_start") + F.col("first")).alias("start"), "payload")

    def decode(batches):
        for batch in batches:
            for start, page in zip(batch.column("start").to_pylist(), batch.column("payload"), strict=True):
                ids, n, keys = simple8b.read_page(page.as_py())
                to = np.cumsum(n)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (b - k) : 4 * b]) for b, k in zip(to.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(start + to - n), pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op1_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_pages(write_token_pages(table(spark, sf_dir, "documents"), default_path()))
