"""Token ids in a column-planed file format: write in order, index, read back.

The ids of all documents form one stream, cut into blocks of a fixed number of ids. A block is
transposed into byte planes (or bit planes), each compressed by zstandard, and written as one
row of a Parquet table together with its part of the index: the documents that begin in it,
their lengths, and where the document that runs on from earlier blocks began. Rows stand in
files in document order; Spark's writer commits them, so a lost task leaves nothing half done.

Null texts count as empty. Null ids come first. Rows with the same id stand side by side, ordered
by a hash of their text. An empty table makes an empty file set.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinfold.llm.bpe_units import encoder
from kinfold.llm.common import small_batches, text_slices

BLOCK = 65_536
CHUNKS = "part int, chunk long, first long, n_ids int, begun long, lead long, doc_ids array<long>, doc_lengths array<long>, planes array<binary>"
PIECES = "part int, start long, doc_id long, n_tokens long, ids_crc32 long, chunk long, ids binary"


def to_planes(ids: np.ndarray, kind: str = "byte", level: int = 3) -> list[bytes]:
    """Compressed planes of unsigned 32-bit ids: 4 byte planes, or 32 bit planes."""
    import zstandard

    rows = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    planes = rows.T if kind == "byte" else np.packbits(np.unpackbits(rows, axis=1, bitorder="little").T, axis=1)
    pack = zstandard.ZstdCompressor(level=level)
    return [pack.compress(np.ascontiguousarray(p).tobytes()) for p in planes]


def from_planes(planes: list[bytes], count: int) -> np.ndarray:
    """The ids of a block; the number of planes tells their kind."""
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    size = count if len(planes) == 4 else -(-count // 8)
    rows = np.stack([np.frombuffer(unpack.decompress(p, max_output_size=max(1, size)), np.uint8) for p in planes])
    if len(planes) == 32:
        rows = np.packbits(np.unpackbits(rows, axis=1, count=count).T, axis=1, bitorder="little").T
    return np.ascontiguousarray(rows.T).reshape(-1).view("<u4")


def chunk_table(docs: DataFrame, tokenizer: str, end_id: int = 2, block: int = BLOCK, kind: str = "byte", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of the file format, dealt into ranges of document ids."""
    end = end_id.to_bytes(4, "little")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encode = TaskContext.get().partitionId(), encoder(tokenizer)
        waiting, chunk, first, begun = bytearray(), 0, 0, None
        opened: list[tuple[int, int, int]] = []  # documents that begin in what is waiting: place, id, length

        def emit(size: int) -> pa.RecordBatch:
            nonlocal chunk, first, begun, opened
            ids, here = np.frombuffer(bytes(waiting[: 4 * size]), "<u4"), [x for x in opened if x[0] < first + size]
            lead = (here[0][0] - first if here else size) if begun is not None else 0
            row = [part, chunk, first, size, begun if lead else None, lead, [x[1] for x in here], [x[2] for x in here], to_planes(ids, kind)]
            del waiting[: 4 * size]
            last = here[-1] if here else None
            if last:
                begun = last[0]
            opened, chunk, first = opened[len(here):], chunk + 1, first + size
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=[c.split()[0] for c in CHUNKS.split(", ")])

        place = 0
        for batch in text_slices(batches, 4_000_000):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text) + end
                opened.append((place, doc, len(ids) // 4))
                place += len(ids) // 4
                waiting += ids
                while len(waiting) >= 4 * block:
                    yield emit(block)
        if waiting:
            yield emit(len(waiting) // 4)

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("_h"))
    order = rows.repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h")
    return order.select("doc_id", "text").mapInArrow(write, CHUNKS)


def write_ids(docs: DataFrame, path: str, tokenizer: str, **options) -> None:
    """Encode and write; planes are compressed already, so the container isn't."""
    chunk_table(docs, tokenizer, **options).write.option("compression", "none").parquet(path)


def read_documents(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Documents from the files: ``doc_id, start, n_tokens, ids_crc32`` and, if asked for, ``ids``.

    Every block is read alone. Documents inside one block are done there; those that cross
    blocks leave pieces, joined by the place where they began.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for r in batch.to_pylist():
                raw, at = from_planes(r["planes"], r["n_ids"]).tobytes(), r["first"]
                end = at + r["n_ids"]
                if r["begun"] is not None:
                    rows.append((r["part"], r["begun"], None, None, None, r["chunk"], raw[: 4 * r["lead"]]))
                    at += r["lead"]
                for doc, size in zip(r["doc_ids"], r["doc_lengths"], strict=True):
                    own = raw[4 * (at - r["first"]): 4 * (at + size - r["first"])]
                    whole = at + size <= end
                    rows.append((r["part"], at, doc, size, zlib.crc32(own) if whole else None, r["chunk"], own if with_ids or not whole else None))
                    at += size
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in PIECES.split(", ")])

    table = spark.read.schema(CHUNKS).parquet(path)
    small_batches(spark, 100)
    found = table.mapInArrow(read, PIECES)
    pieces = F.array_sort(F.collect_list(F.when(F.col("ids").isNotNull(), F.struct("chunk", "ids"))))  # of documents that cross blocks
    docs = found.groupBy("part", "start").agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.max("ids_crc32").alias("_crc"), pieces.alias("_pieces"))
    joined = F.aggregate("_pieces", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    sizes = spark.read.schema(CHUNKS).parquet(path).groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # one row a file part
    out = docs.join(base, "part").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", F.coalesce("_crc", F.crc32(joined)).alias("ids_crc32"), *([joined.alias("ids")] if with_ids else []))
    return out
