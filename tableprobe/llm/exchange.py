"""Blocks of documents that learn what other blocks hold.

Several operators ask, for millions of 64-bit names per block of documents (windows of bytes,
n-grams), how often or where a name occurs in the whole corpus. One row per name would
shuffle 20 to 30 bytes each. Here a block sends its distinct names sorted and packed, one small
binary row per bucket of the name space; a bucket answers each block with one small row. Names
cost 3 to 6 bytes, a name in every document costs one entry per block, and the number
of buckets grows with the input so that a bucket stays a few megabytes.
"""

from __future__ import annotations

import io
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from tableprobe.llm.common import buffers, saved, tidy

#: Bytes of text in a block, and names in a bucket. A document is never cut.
BLOCK_BYTES, BUCKET_NAMES = 2 << 20, 1 << 20

BLOCK_SCHEMA = "block long, n_docs long, n_bytes long, payload binary"


def pack_rows(batches: list[pa.RecordBatch]) -> bytes:
    sink = io.BytesIO()
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    with pa.ipc.new_stream(sink, batches[0].schema, options=options) as out:
        for batch in batches:
            out.write_batch(batch)
    return sink.getvalue()


def unpack_rows(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all().combine_chunks()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of about BLOCK_BYTES of the column `text`, numbered in the order of the rows."""
    base, count = TaskContext.get().partitionId() << 32, 0
    held: list[pa.RecordBatch] = []
    size = 0

    def block():
        rows = sum(b.num_rows for b in held)
        return pa.RecordBatch.from_pydict(
            {"block": [base + count], "n_docs": [rows], "n_bytes": [size], "payload": [pack_rows(held)]},
            schema=pa.schema([("block", pa.int64()), ("n_docs", pa.int64()), ("n_bytes", pa.int64()), ("payload", pa.binary())]),
        )

    for batch in batches:
        sizes = np.diff(buffers(batch.column("text"))[1])
        start = 0
        while start < batch.num_rows:
            total = np.cumsum(sizes[start:])
            take = max(1, int(np.searchsorted(total, BLOCK_BYTES - size, side="right")))
            if held and total[0] + size > BLOCK_BYTES:
                take = 0
            if take:
                held.append(batch.slice(start, take))
                size += int(total[take - 1])
                start += take
            if size >= BLOCK_BYTES or (start < batch.num_rows and held):
                yield block()
                count, held, size = count + 1, [], 0
    if held:
        yield block()


def make_blocks(rows: DataFrame, label: str) -> DataFrame:
    """`rows` (with a binary column `text`) as blocks in the shared folder.

    Rows keep their order, so that of a range-sorted frame gives block numbers in the same order.
    """
    return saved(rows.mapInArrow(tidy(_cut), BLOCK_SCHEMA), label)


# names on the wire -----------------------------------------------------------------------


def pack_names(names: np.ndarray) -> bytes:
    """Sorted distinct 64-bit numbers: differences of their high parts, and their low bytes as they are."""
    n = len(names)
    gap = max(1.0, float(names[-1] - names[0]) / n)
    low = min(7, max(0, math.ceil((math.log2(gap) - 6) / 8)))
    high = names >> np.uint64(8 * low)
    step = np.diff(high)
    big = step >= np.uint64(255)
    head = np.array([n, low, int(big.sum())], np.int64).tobytes() + high[:1].tobytes()
    lows = np.ascontiguousarray(names).view(np.uint8).reshape(n, 8)[:, :low].tobytes()
    return head + np.where(big, 255, step).astype(np.uint8).tobytes() + step[big].tobytes() + lows


def unpack_names(blob: bytes) -> np.ndarray:
    n, low, bigs = (int(x) for x in np.frombuffer(blob, np.int64, 3))
    at = 32
    step = np.frombuffer(blob, np.uint8, n - 1, at).astype(np.uint64)
    at += n - 1
    step[step == 255] = np.frombuffer(blob, np.uint64, bigs, at)
    at += 8 * bigs
    high = np.empty(n, np.uint64)
    high[0] = np.frombuffer(blob, np.uint64, 1, 24)[0]
    high[1:] = step
    out = np.zeros((n, 8), np.uint8)
    out[:, :low] = np.frombuffer(blob, np.uint8, n * low, at).reshape(n, low)
    return (np.cumsum(high, dtype=np.uint64) << np.uint64(8 * low)) | out.view(np.uint64).ravel()


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts as bytes, with the few of 255 and more behind them."""
    big = counts >= 255
    return np.where(big, 255, counts).astype(np.uint8).tobytes() + counts[big].astype(np.int64).tobytes()


def unpack_counts(blob: bytes, n: int) -> np.ndarray:
    counts = np.frombuffer(blob, np.uint8, n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(blob, np.int64, -1, n)
    return counts


# the exchange ----------------------------------------------------------------------------

#: What a block makes of its rows and the answers so far: by channel, its sorted distinct names and, if counted, their counts.
Send = Callable[[pa.Table, dict[int, "Answer"]], dict[int, tuple[np.ndarray, np.ndarray | None]]]

#: The block number of what a bucket tells about all its names.
EVERYONE = -1

_SENT = "bucket int, channel int, block long, names binary, counts binary"
_REPLY = "block long, channel int, bucket int, reply binary"


class Answer:
    """What the buckets replied to one block on one channel, in the order of its sorted names."""

    def __init__(self, replies: list[dict]):
        self._replies = [x["reply"] for x in sorted(replies, key=lambda x: x["bucket"])]

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """For each name: whether another block has it, and whether an earlier block has it."""
        parts = [np.zeros((2, 0), bool)]
        for blob in self._replies:
            n = int(np.frombuffer(blob, np.int64, 1)[0])
            parts.append(np.unpackbits(np.frombuffer(blob, np.uint8, -1, 8).reshape(2, -1), axis=1)[:, :n].astype(bool))
        both = np.concatenate(parts, axis=1)
        return both[0], both[1]

    def totals(self) -> tuple[np.ndarray, np.ndarray]:
        """For each name: whether another block has it, and its count over all blocks."""
        many, parts = [np.zeros(0, bool)], [np.zeros(0, np.int64)]
        for blob in self._replies:
            n = int(np.frombuffer(blob, np.int64, 1)[0])
            at = 8 + -(-n // 8)
            many.append(np.unpackbits(np.frombuffer(blob[8:at], np.uint8))[:n].astype(bool))
            parts.append(unpack_counts(blob[at:], n))
        return np.concatenate(many), np.concatenate(parts)


def answers_of(replies) -> dict[int, Answer]:
    channels: dict[int, list[dict]] = {}
    for x in replies or []:
        channels.setdefault(x["channel"], []).append(x)
    return {channel: Answer(own) for channel, own in channels.items()}


def _sender(send: Send, buckets: int):
    edges = np.array([-(-(b << 32) // buckets) << 32 for b in range(1, buckets)], np.uint64)
    fields = pa.schema(
        [("bucket", pa.int32()), ("channel", pa.int32()), ("block", pa.int64()), ("names", pa.binary()), ("counts", pa.binary())]
    )

    def run(batches):
        for block, table, replies in blocks_in(batches):
            rows: dict[str, list] = {name: [] for name in fields.names}
            for channel, (names, counts) in send(table, replies).items():
                cuts = np.concatenate([[0], np.searchsorted(names, edges), [len(names)]])
                for bucket in np.flatnonzero(np.diff(cuts)):
                    part = slice(cuts[bucket], cuts[bucket + 1])
                    packed = None if counts is None else pack_counts(counts[part])
                    for name, value in zip(fields.names, (int(bucket), channel, block, pack_names(names[part]), packed)):
                        rows[name].append(value)
            yield pa.RecordBatch.from_pydict(rows, schema=fields)

    return run


def _answer(table: pa.Table) -> pa.Table:
    """Of one bucket: to every block, where its names are or how often they occur."""
    table = table.sort_by("block")
    blobs = table.column("names").to_pylist()
    counts = table.column("counts").to_pylist()
    names = [unpack_names(blob) for blob in blobs]
    cuts = np.cumsum([0, *(len(x) for x in names)])
    every = np.concatenate(names)
    order = np.argsort(every, kind="stable")
    ranked = every[order]
    first = np.ones(len(ranked), bool)
    first[1:] = ranked[1:] != ranked[:-1]
    group = np.cumsum(first) - 1
    replies, to = [], table.column("block").to_pylist()
    many, earlier = np.empty(len(every), bool), np.empty(len(every), bool)
    many[order] = np.bincount(group)[group] > 1
    if counts[0] is None:
        earlier[order] = ~first
        for a, b in zip(cuts[:-1], cuts[1:]):
            replies.append(np.int64(b - a).tobytes() + np.packbits(np.stack([many[a:b], earlier[a:b]]), axis=1).tobytes())
    else:
        own = np.concatenate([unpack_counts(blob, len(x)) for blob, x in zip(counts, names)])
        sums = np.add.reduceat(own[order], np.flatnonzero(first))
        total = np.empty(len(every), np.int64)
        total[order] = sums[group]
        for a, b in zip(cuts[:-1], cuts[1:]):
            replies.append(np.int64(b - a).tobytes() + np.packbits(many[a:b]).tobytes() + pack_counts(total[a:b]))
        # and to everyone: the names counted at least once, and the sum of the counts
        to.append(EVERYONE)
        replies.append(np.array([np.count_nonzero(sums), sums.sum()], ">i8").tobytes())
    channel, bucket = table.column("channel")[0].as_py(), table.column("bucket")[0].as_py()
    return pa.table(
        {
            "block": pa.array(to, pa.int64()),
            "channel": pa.array([channel] * len(to), pa.int32()),
            "bucket": pa.array([bucket] * len(to), pa.int32()),
            "reply": pa.array(replies, pa.binary()),
        }
    )


def blocks_in(batches: Iterator[pa.RecordBatch]):
    """Block number, rows and answers of each row of a frame of blocks."""
    for batch in batches:
        replies = batch.column("replies").to_pylist() if "replies" in batch.schema.names else [None] * batch.num_rows
        for i, reply in enumerate(replies):
            yield batch.column("block")[i].as_py(), unpack_rows(batch.column("payload")[i].as_py()), answers_of(reply)


def exchange(blocks: DataFrame, send: Send, names: int, label: str) -> DataFrame:
    """The replies to what `send` makes of every block; `names`: about how many there are, from counts."""
    buckets = max(1, math.ceil(names / BUCKET_NAMES))
    sent = blocks.mapInArrow(tidy(_sender(send, buckets)), _SENT)
    return saved(sent.groupBy("bucket", "channel").applyInArrow(_answer, _REPLY), label)


def with_replies(blocks: DataFrame, *replies: DataFrame) -> DataFrame:
    """The blocks with all replies to them."""
    every = replies[0]
    for more in replies[1:]:
        every = every.unionByName(more)
    own = every.groupBy("block").agg(F.collect_list(F.struct("channel", "bucket", "reply")).alias("replies"))
    return blocks.select("block", "payload").join(own, "block", "left")


def name_totals(replies: DataFrame, channel: int) -> tuple[int, int]:
    """Of a counted channel: how many names were counted at least once, and the sum of all counts."""
    told = replies.where((F.col("block") == EVERYONE) & (F.col("channel") == channel)).select(
        *(F.conv(F.hex(F.expr(f"substring(reply, {at}, 8)")), 16, 10).cast("long").alias(n) for n, at in (("d", 1), ("s", 9)))
    )
    row = told.agg(F.coalesce(F.sum("d"), F.lit(0)).alias("d"), F.coalesce(F.sum("s"), F.lit(0)).alias("s")).first()
    return row.d, row.s


def empty_like(schema: T.StructType) -> pa.Schema:
    """The Arrow schema that Spark wants back for a schema."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
