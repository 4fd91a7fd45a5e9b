"""Best-fit packing of documents into token sequences, planned on the histogram of lengths.

A document is its ids and one end id; one longer than the capacity is cut into full pieces,
the first of which may be shorter. The plan needs only how many pieces there are of each
length (at most ``capacity`` numbers): longest first, the pieces of a length go to the fullest
open sequences that still hold them. A plan row says where a run of ranks within a length
goes; pieces find their rows by joining on length and rank.

Null and empty texts are one end id. Null ids and repeated rows are kept, each with a place of
its own. An empty table gives no rows. Columns besides id and text are not carried.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinfold.llm.bpe_units import encoder
from kinfold.llm.common import shuffle_partitions, small_batches, stage, text_slices

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
MAX_PLAN = 2_000_000


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """The pieces of every document; ``with_ids`` adds their ids (binary, little-endian unsigned 32-bit)."""
    end, step = end_id.to_bytes(4, "little"), 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in text_slices(batches, 4_000_000):
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text) + end
                first = (len(ids) - 1) % step + 1
                for piece, at in enumerate([0, *range(first, len(ids), step)]):
                    part = ids[at : first if piece == 0 else at + step]
                    rows.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part)) + ((part,) if with_ids else ()))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    small_batches(docs.sparkSession)
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(cut, PIECES + (", ids binary" if with_ids else ""))


def plan_sequences(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit over counts: rows (length, first rank, end rank, first sequence, pieces a sequence, offset).

    The piece of rank k in [first, end) goes to sequence ``first sequence + (k - first) // pieces``
    at ``offset + (k - first) % pieces * length``.
    """
    spaces: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # room -> runs (first sequence, how many)
    rows, opened = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        for room in range(length, capacity + 1):
            if not left:
                break
            runs, fit = spaces[room], room // length
            while runs and left:
                at, many = runs.pop()
                for pieces, used in ((fit, min(many, left // fit)), (left % fit if left < fit * many else 0, 1)):
                    if pieces and used and many and left >= pieces * used:
                        rows.append((length, rank, rank + pieces * used, at, pieces, capacity - room))
                        spaces[room - pieces * length].append((at, used))
                        rank, left, at, many = rank + pieces * used, left - pieces * used, at + used, many - used
                if many:
                    runs.append((at, many))
                    if left:
                        continue
        if left:
            fit = capacity // length
            for pieces, used in ((fit, left // fit), (left % fit, 1)):
                if pieces and used:
                    rows.append((length, rank, rank + pieces * used, opened, pieces, 0))
                    spaces[capacity - pieces * length].append((opened, used))
                    rank, left, opened = rank + pieces * used, left - pieces * used, opened + used
    return rows


def rank_in_length(pieces: DataFrame, counts: dict[int, int]) -> DataFrame:
    """Rank (from 0) of each piece within its length.

    A length is dealt out over blocks of about a quarter of a partition's rows, ranked there and
    based on the sizes of the blocks before; no length needs to fit in a task. Rows are dealt by
    their place in the staged table, so copies of a row are dealt as well.
    """
    spark = pieces.sparkSession
    block = max(1, sum(counts.values()) // (4 * shuffle_partitions(spark)))
    blocks = spark.createDataFrame([(n, -(-c // block)) for n, c in counts.items()], "length long, blocks int")  # at most capacity rows
    place = F.xxhash64("_metadata.file_path", "_metadata.row_index")
    dealt = pieces.select("*", place.alias("_place"), F.col("_metadata.row_index").alias("_row")).join(F.broadcast(blocks), "length").withColumn("_block", F.pmod("_place", "blocks")).drop("blocks")
    sizes = dealt.groupBy("length", "_block").agg(F.count("*").alias("n"))  # at most capacity + 4 x partitions rows
    before = Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("length", "_block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "_block").orderBy("_place", "_row", "doc_id", "piece")
    ranked = dealt.withColumn("_own", F.row_number().over(own) - 1)
    return ranked.join(base, ["length", "_block"]).withColumn("rank", F.col("base") + F.col("_own")).drop("base", "_own", "_place", "_row", "_block")


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """``pieces`` (any columns, with ``doc_id``, ``piece`` and ``length``) with ``sequence_id`` and ``offset``."""
    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset", "rank")]
    table = stage(pieces.select(*kept), "pieces")
    counts = {r["length"]: r["n"] for r in table.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    plan = plan_sequences(counts, capacity)
    if len(plan) > MAX_PLAN:
        raise ValueError(f"the plan has {len(plan)} rows")
    slots = table.sparkSession.createDataFrame(plan, "length long, first long, end long, sequence long, pieces long, at long")
    ranked = rank_in_length(table, counts)
    at = F.col("rank") - F.col("first")
    found = ranked.join(F.broadcast(slots), "length").filter((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end")))
    return found.select(*kept, (F.col("sequence") + F.floor(at / F.col("pieces"))).alias("sequence_id"), (F.col("at") + at % F.col("pieces") * F.col("length")).alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, **columns) -> DataFrame:
    """Cut and pack a table of documents."""
    return pack(cut_pieces(docs, tokenizer, capacity, end_id, **columns), capacity)
