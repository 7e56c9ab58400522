"""Token ids written to grammar-compressed files in the order of the documents' ids, and read back.

Documents are dealt by ranges of their id and sorted, so a file's place among the others follows from its range. A row of
the table of files is one block (see repair.py) with its documents' ids; Spark's writer commits it, on any store.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataflow.llm.common import materialize

#: Ids after which a block is closed (a document is never split), and the id that ends each document.
BLOCK_IDS, END = 1 << 20, 0

_FILES = "part int, block int, part_start long, n_ids long, doc_ids array<long>, payload binary"


def write_token_files(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", name: str = "token-files"
) -> DataFrame:
    """The table of files of docs, written to the shared folder.

    Every text (null: empty) is encoded whole, END follows it. Rows come in ascending id order, null first, equal ids in
    text order. An empty table gives no file. Other columns are not looked at.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from strataflow.llm.pretokens import encoder
        from strataflow.llm.repair import compress

        enc = encoder(tokenizer)
        base = enc.tokenizer.get_vocab_size(with_added_tokens=True)
        part, end = TaskContext.get().partitionId(), np.array([END], "<u4").tobytes()
        ids: list[int | None] = []
        raw: list[bytes] = []
        size = block = start = 0

        def close() -> pa.RecordBatch:
            nonlocal size, block, start
            lengths = np.array([len(x) // 4 for x in raw])
            payload = compress(np.frombuffer(b"".join(raw), "<u4"), lengths, base)
            n = int(lengths.sum())
            row = pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([block], pa.int32()),
                    pa.array([start], pa.int64()),
                    pa.array([n], pa.int64()),
                    pa.array([list(ids)], pa.list_(pa.int64())),
                    pa.array([payload], pa.binary()),
                ],
                names=["part", "block", "part_start", "n_ids", "doc_ids", "payload"],
            )
            block, start, size = block + 1, start + n, 0
            ids.clear()
            raw.clear()
            return row

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(doc_id)
                raw.append(enc.ids(text or "") + end)
                size += len(raw[-1]) // 4
                if size >= BLOCK_IDS:
                    yield close()
        if ids:
            yield close()

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    dealt = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return materialize(dealt.mapInArrow(blocks, _FILES), name)


def read_token_files(files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of each document, from the files."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from strataflow.llm.repair import Block

        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row["payload"])
                ids, starts = block.all_ids().astype("<u4"), block.starts
                bounds = starts.tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(starts[:-1] + row["part_start"] + row["before"], pa.int64()),
                        pa.array(np.diff(starts), pa.int64()),
                        pa.array([zlib.crc32(ids[a:b]) for a, b in zip(bounds, bounds[1:])], pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    # One row for each range of ids, so one task may sum them up.
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n_part"))
    before = parts.select(
        "part",
        F.coalesce(F.sum("n_part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        .cast("long")
        .alias("before"),
    )
    found = files.join(materialize(before, "token-parts"), "part").select("part_start", "before", "doc_ids", "payload")
    return found.mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_report(docs: DataFrame, tokenizer: str) -> DataFrame:
    return read_token_files(write_token_files(docs, tokenizer))
