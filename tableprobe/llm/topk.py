"""Exact nearest binary codes by incremental multi-index hashing.

A vector's code has one bit per dimension, set where the value is at least 0 (null and NaN: not set). Codes are cut into
segments of 16 bits, each with an index from its value to the codes that have it. For a query, the segments are searched
at radius 0, then 1, and so on. Once j segments are searched at radius r, every code within distance
m * r + j - 1 of the query has been seen (m segments; otherwise each segment would differ by more than it
was searched), so the search ends as soon as the k-th best verified distance is no larger than that.

Ties are broken by the smaller id. A row without an id, or with a null or empty vector, neither asks nor answers. Vectors of
different lengths (rounded up to 16 dimensions) are not compared. Repeated ids are separate rows: each asks and
each is an answer, and the k best of all answers under one id are returned.

Scale: codes (8 bytes for 64 dimensions) are dealt into shards of about `SHARD` rows, each of which is indexed once per block of
queries; blocks of queries meet shards, each returns k rows per query, and the best k of these are
ranked per query. Vectors themselves are read once and not shuffled.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tableprobe.llm.common import prepare, saved

SHARD, QUERIES = 1 << 18, 4096
_SEGMENT = 16
_VALUES = np.arange(1 << _SEGMENT, dtype=np.uint16)
_MASKS = [_VALUES[np.bitwise_count(_VALUES) == r] for r in range(_SEGMENT + 1)]


def _encode(batches):
    schema = pa.schema([("id", pa.int64()), ("asks", pa.bool_()), ("code", pa.binary())])
    for batch in batches:
        codes = []
        for v in batch.column("v"):
            if not v.is_valid:
                codes.append(None)
                continue
            values = np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64)
            bits = np.packbits(values >= 0)
            codes.append(bits.tobytes() + bytes(-len(bits) % 2))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("asks"), pa.array(codes, pa.binary())], schema=schema)


def _pack(table: pa.Table) -> pa.Table:
    """One row for one group of codes."""
    table = table.sort_by("id")
    codes = b"".join(table.column("code").to_pylist())
    return pa.table(
        {
            "group": table.column("group").slice(0, 1),
            "width": table.column("width").slice(0, 1),
            "ids": pa.array([table.column("id").to_numpy().tobytes()], pa.binary()),
            "codes": pa.array([codes], pa.binary()),
        }
    )


class Index:
    """The codes of one shard, found by their segments."""

    def __init__(self, ids: np.ndarray, codes: np.ndarray):
        self.ids, self.codes = ids, codes
        self.segments = codes.shape[1]
        self.order, self.starts = [], []
        for s in range(self.segments):
            order = np.argsort(codes[:, s], kind="stable")
            self.order.append(order)
            self.starts.append(np.concatenate([[0], np.cumsum(np.bincount(codes[:, s], minlength=1 << _SEGMENT))]))
        self._seen = np.zeros(len(ids), bool)

    def nearest(self, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and distances of the k nearest codes, nearest first, ties by id (rows are sorted by id)."""
        found, distances, total = [], [], 0
        done = False
        for radius in range(_SEGMENT + 1):
            for s in range(self.segments):
                keys = (_MASKS[radius] ^ query[s]).astype(np.int64)
                at, upto = self.starts[s][keys], self.starts[s][keys + 1]
                some = upto > at
                at, size = at[some], upto[some] - at[some]
                if len(at):
                    place = np.repeat(at - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
                    rows = self.order[s][place]
                    rows = rows[~self._seen[rows]]
                    if len(rows):
                        self._seen[rows] = True
                        found.append(rows)
                        distances.append(np.bitwise_count(self.codes[rows] ^ query).sum(axis=1))
                        total += len(rows)
                covered = self.segments * radius + s
                if total >= min(k, len(self.ids)):
                    best = np.concatenate(distances)
                    if total == len(self.ids) or np.partition(best, k - 1)[k - 1] <= covered:
                        done = True
                        break
            if done:
                break
        rows = np.concatenate(found) if found else np.zeros(0, np.int64)
        best = np.concatenate(distances) if found else np.zeros(0, np.int64)
        self._seen[rows] = False
        order = np.lexsort((rows, best))[:k]
        return rows[order], best[order]


def _search(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("neighbor_id", pa.int64()), ("distance", pa.int64())])

    def run(batches):
        last, index = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if last != (row["group"], row["width"]):
                    last = (row["group"], row["width"])
                    codes = np.frombuffer(row["codes"], np.uint16).reshape(-1, row["width"] // 2)
                    index = Index(np.frombuffer(row["ids"], np.int64), codes)
                asks = np.frombuffer(row["q_codes"], np.uint16).reshape(-1, row["width"] // 2)
                out = [[], [], []]
                for id_, code in zip(np.frombuffer(row["q_ids"], np.int64), asks):
                    rows, distances = index.nearest(code, k)
                    out[0].append(np.full(len(rows), id_))
                    out[1].append(index.ids[rows])
                    out[2].append(distances)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in out], schema=schema)

    return run


def nearest_codes(vectors: DataFrame, asks: Column, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """The `k` nearest rows, itself included, of every row for which `asks` holds: query_id, neighbor_id, distance, rank."""
    spark = prepare(vectors.sparkSession)
    rows = vectors.select(
        vectors[f"`{id_column}`"].cast("long").alias("id"),
        F.coalesce(asks, F.lit(False)).alias("asks"),
        vectors[f"`{vector_column}`"].alias("v"),
    ).where("id IS NOT NULL")
    codes = rows.mapInArrow(_encode, "id long, asks boolean, code binary").where("code IS NOT NULL AND length(code) > 0")
    codes = saved(codes.withColumn("width", F.length("code")), "codes")
    n = codes.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("asks").cast("long")), F.lit(0)).alias("q")).first()
    shards, blocks = max(1, math.ceil(n.n / SHARD)), max(1, math.ceil(n.q / QUERIES))
    packed = "group int, width int, ids binary, codes binary"

    def dealt(some: DataFrame, groups: int) -> DataFrame:
        group = F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("group")
        return some.select(group, "width", "id", "code").groupBy("group", "width").applyInArrow(_pack, packed)

    shard = dealt(codes, shards)
    block = dealt(codes.where("asks"), blocks).select(F.col("ids").alias("q_ids"), F.col("codes").alias("q_codes"), "width")
    # every block of queries goes to every shard of its width
    block = block.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    met = shard.join(block, ["group", "width"]).repartition(shards * blocks, "group", "width", "q_ids")
    best = met.mapInArrow(_search(k), "query_id long, neighbor_id long, distance long")
    order = Window.partitionBy("query_id").orderBy("distance", "neighbor_id")
    return best.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)
