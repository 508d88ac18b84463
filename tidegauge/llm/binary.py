"""Token-id files: ids bit-packed at the fixed width the vocabulary needs, with offsets for random access.

A data set of files is a folder of Parquet files. Its rows are blocks, in file order:

| column | content |
|---|---|
| `file`, `block` | number of the file (ascending with the document ids) and of the block in it |
| `first` | ids in the same file before the block |
| `width`, `n_ids` | bits of each id, ids in the block |
| `doc_id`, `ends` | its documents and where each ends in the block |
| `payload` | the ids, `width` bits each, least significant bit first |

A block holds whole documents and is closed once it has `block_ids` ids, so one document is never spread over
blocks and a task needs memory for one block plus its longest document. Id number `p` of a block starts at bit
`p * width`: any range is read without the rest.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidegauge.llm.common import prepare, tables
from tidegauge.llm.encoding import ID, encoder
from tidegauge.session import fresh_path

END_ID = 0
BLOCK_IDS = 1 << 16
BLOCKS = ("file int, block int, first long, width int, n_ids int, doc_id array<long>, ends array<int>, payload binary")


def id_width(vocab_size: int) -> int:
    """Bits the largest id of a vocabulary needs, at least one."""
    return max(1, (vocab_size - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids as a bit string of `width` bits each; the last byte is filled with zeros."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = np.unpackbits(ids.astype(ID).view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    return np.packbits(bits.reshape(-1), bitorder="little").tobytes()


def unpack(payload: bytes, width: int, start: int, stop: int) -> np.ndarray:
    """Ids `start` to `stop` of a payload, touching only their bytes."""
    if width in (8, 16, 32):
        size = width // 8
        return np.frombuffer(payload, f"<u{size}", stop - start, start * size).astype(ID)
    low = start * width
    part = np.frombuffer(payload, np.uint8)[low // 8:(stop * width + 7) // 8]
    bits = np.unpackbits(part, bitorder="little")[low % 8:low % 8 + (stop - start) * width].reshape(-1, width)
    wide = np.zeros((stop - start, 32), np.uint8)
    wide[:, :width] = bits
    return np.packbits(wide, axis=1, bitorder="little").reshape(-1, 4).view(ID).reshape(-1)


def _block_rows(batches: Iterator[pa.RecordBatch], path: str, block_ids: int, schema: pa.Schema):
    enc = encoder(path)
    width, file, block, first = id_width(enc.vocab_size), TaskContext.get().partitionId(), 0, 0
    doc_ids, ends, parts, size = [], [], [], 0

    def close():
        nonlocal block, first, doc_ids, ends, parts, size
        payload = pack(np.frombuffer(b"".join(parts), ID), width)
        row = [[file], [block], [first], [width], [size], [doc_ids], [ends], [payload]]
        out = pa.record_batch([pa.array(v, t.type) for v, t in zip(row, schema)], schema=schema)
        block, first, doc_ids, ends, parts, size = block + 1, first + size, [], [], [], 0
        return out

    end = np.array([END_ID], ID).tobytes()
    for batch in tables(batches):
        texts = [t or "" for t in batch.column("text").to_pylist()]
        ids_of = batch.column("doc_id").to_pylist()
        for doc_id, ids in zip(ids_of, enc.encoded(texts)):
            parts.append(ids + end)
            size += len(parts[-1]) // 4
            doc_ids.append(doc_id)
            ends.append(size)
            if size >= block_ids:
                yield close()
    if doc_ids:
        yield close()


def write_ids(docs: DataFrame, tokenizer: str, path: str, block_ids: int = BLOCK_IDS) -> None:
    """Encodes the `text` of every document, ends each with id 0 and writes the blocks in ascending `doc_id` order.

    Null texts are empty (only the end id); documents without an id come first; rows that share an id are all kept,
    ordered by the checksum of their text. Other columns are ignored. An empty table writes no block.
    """
    ordered = (
        docs.select("doc_id", "text", F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("tie"))
        .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    )
    kinds = {"file": pa.int32(), "block": pa.int32(), "first": pa.int64(), "width": pa.int32(), "n_ids": pa.int32(),
             "doc_id": pa.list_(pa.int64()), "ends": pa.list_(pa.int32()), "payload": pa.binary()}
    schema = pa.schema(list(kinds.items()))
    ordered.mapInArrow(lambda it: _block_rows(it, tokenizer, block_ids, schema), BLOCKS).write.parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with `before`, the ids of all files before theirs (one row per file is summed up)."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    sizes = blocks.groupBy("file").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return blocks.join(before, "file")


def _document_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in tables(batches):
        doc_id, start, n, crc = [], [], [], []
        for row in batch.to_pylist():
            low = 0
            for doc, end in zip(row["doc_id"], row["ends"]):
                doc_id.append(doc)
                start.append(row["before"] + row["first"] + low)
                n.append(end - low)
                crc.append(zlib.crc32(unpack(row["payload"], row["width"], low, end).tobytes()))
                low = end
        yield pa.record_batch({"doc_id": pa.array(doc_id, pa.int64()), "start": pa.array(start, pa.int64()),
                               "n_tokens": pa.array(n, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: `doc_id`, `start`, `n_tokens` (with the end id) and the checksum of its ids."""
    rows = read_blocks(spark, path).select("before", "first", "width", "doc_id", "ends", "payload")
    return rows.mapInArrow(_document_rows, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_range(spark: SparkSession, path: str, start: int, stop: int) -> np.ndarray:
    """Random access: ids number `start` to `stop` of the whole data set; only blocks that hold some are read."""
    at = F.col("before") + F.col("first")
    hits = read_blocks(spark, path).where((at < stop) & (at + F.col("n_ids") > start))
    parts = [
        unpack(r["payload"], r["width"], max(0, start - r["at"]), min(r["n_ids"], stop - r["at"]))
        for r in hits.select(at.alias("at"), "width", "n_ids", "payload").orderBy("at").collect()
    ]
    return np.concatenate(parts) if parts else np.zeros(0, ID)


def token_files(docs: DataFrame, tokenizer: str, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Writes the files of `docs` to the shared folder and returns their documents as read back."""
    spark = docs.sparkSession
    prepare(spark)
    path = fresh_path(spark, "token-ids")
    write_ids(docs, tokenizer, path, block_ids)
    return read_documents(spark, path)
