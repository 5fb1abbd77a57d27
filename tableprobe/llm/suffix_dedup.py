"""Removal of byte strings that occurred before, by a difference cover of suffixes.

The suffixes of all documents would be sorted by their first ``size`` bytes and each compared with
the one before it: equal prefixes are a repeat. Only equality up to ``size`` bytes matters, so the
difference-cover algorithm is run to that depth and on names only:

1. *Sample.* Positions whose offset lies in a difference cover D modulo v. Any two places i and j of
   equal strings have a d < v with i + d and j + d both sampled, so two equal strings of ``size`` bytes
   hold equal sampled tuples of ``size - v + 1`` bytes. (With v = 3 and tuples of 3 this is the sampling
   of the textbook algorithm; v = 57 samples 8 of 57 positions.)
2. *Name and sort.* Sampled tuples get 64-bit names, are sorted bucket by bucket of the name space, and
   adjacent equal names are found. A name that occurs once in the corpus settles its suffix.
3. *Recurse* only on positions within v - 1 before a repeated name: they get the name of their whole
   ``size``-byte prefix. Prefixes are bounded, so one level of recursion is enough.
4. *Merge the remaining suffixes* (sampled or not) in the same way and compare neighbours: of equal
   prefixes, all but the first in corpus order are repeats.

Documents that equal an earlier one as a whole are recognised in step 2 and skip the rest.

Order and cases: documents are ordered by id; a null id comes first; rows with equal ids are
separate documents, ordered by text. Null and empty texts, and texts shorter than ``size``, lose
nothing. Matches never cross documents. Names are 64-bit hashes: n candidate windows agree by chance
with probability n * n / 2**65. The names of step 2 may be shorter, a chance agreement there only adds a candidate.

Scale: documents travel once (sorted by id, in blocks of 2 MB); each sampled name costs 3 to
5 bytes and each candidate 6; buckets grow in number, not in size, and a string that is in every document is one name
per block. Every step is saved in the shared folder.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tableprobe.llm.common import Spans, buffers, prepare, tidy
from tableprobe.llm.exchange import Answer, blocks_in, empty_like, exchange, make_blocks, with_replies

#: Perfect difference sets, by modulus.
COVERS = {
    1: (0,),
    3: (0, 1),
    7: (0, 1, 3),
    13: (0, 1, 3, 9),
    21: (0, 1, 4, 14, 16),
    31: (0, 1, 3, 8, 12, 18),
    57: (0, 1, 3, 13, 32, 36, 43, 52),
}

SAMPLES, DOCUMENTS, WINDOWS = 0, 1, 2


def cover_of(size: int) -> int:
    """The largest modulus that leaves tuples of at least 40 % of the size."""
    return max(v for v in COVERS if v == 1 or v <= 0.6 * size)


class _Block:
    """The names of one block, and what answers say about them."""

    def __init__(self, table: pa.Table, size: int, bits: int):
        self.size, self.v = size, cover_of(size)
        self.data, self.offsets = buffers(table.column("text"))
        self.lengths = np.diff(self.offsets)
        self.spans = Spans(self.data)
        n = len(self.data)
        # positions in a text fit 32 bits, as its bytes fit one Arrow value
        local = (np.arange(n) - np.repeat(self.offsets[:-1], self.lengths)).astype(np.int32)
        self.left = np.repeat(self.lengths.astype(np.int32), self.lengths) - local
        tuple_size = size - self.v + 1
        in_cover = np.zeros(self.v, bool)
        in_cover[list(COVERS[self.v])] = True
        self.at = np.flatnonzero(in_cover[local % np.int32(self.v)] & (self.left >= tuple_size))
        names = self.spans.hash(self.at, self.at + tuple_size)
        self.samples = (names >> np.uint64(64 - bits)) << np.uint64(64 - bits)
        self.long = np.flatnonzero(self.lengths >= size)
        self.whole = self.spans.hash(self.offsets[self.long], self.offsets[self.long + 1])

    def first_round(self):
        return {SAMPLES: (np.unique(self.samples), None), DOCUMENTS: (np.unique(self.whole), None)}

    def _copies(self, answers: dict[int, Answer]) -> np.ndarray:
        """Rows that equal an earlier document."""
        out = np.zeros(len(self.lengths), bool)
        if len(self.long):
            _, first, inverse = np.unique(self.whole, return_index=True, return_inverse=True)
            _, earlier = answers[DOCUMENTS].places()
            out[self.long] = earlier[inverse] | (np.arange(len(self.long)) != first[inverse])
        return out

    def candidates(self, answers: dict[int, Answer]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Copies of documents, starts of windows that may be repeats, and the names of the windows."""
        copies = self._copies(answers)
        n = len(self.data)
        repeated = np.zeros(n + self.v + 1, np.int32)
        if len(self.at):
            _, inverse, counts = np.unique(self.samples, return_inverse=True, return_counts=True)
            many, _ = answers[SAMPLES].places()
            repeated[self.at + 1] = (many | (counts > 1))[inverse]
        upto = np.cumsum(repeated)
        near = upto[self.v : self.v + n] > upto[:n]
        starts = np.flatnonzero(near & (self.left >= self.size) & ~np.repeat(copies, self.lengths))
        return copies, starts, self.spans.hash(starts, starts + self.size)

    def second_round(self, answers: dict[int, Answer]):
        return {WINDOWS: (np.unique(self.candidates(answers)[2]), None)}

    def removed(self, answers: dict[int, Answer]) -> np.ndarray:
        """Which bytes go."""
        copies, starts, names = self.candidates(answers)
        edge = np.zeros(len(self.data) + 1, np.int32)
        if len(starts):
            _, first, inverse = np.unique(names, return_index=True, return_inverse=True)
            _, earlier = answers[WINDOWS].places()
            starts = starts[earlier[inverse] | (np.arange(len(starts)) != first[inverse])]
            edge[starts] += 1
            edge[starts + self.size] -= 1
        return (np.cumsum(edge[:-1]) > 0) | np.repeat(copies, self.lengths)


RESULT = T.StructType(
    [
        T.StructField("kept", T.BinaryType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("removed", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    ]
)


def _finish(size: int, bits: int, whole_characters: bool, schema: pa.Schema):
    def run(batches):
        for _, table, answers in blocks_in(batches):
            block = _Block(table, size, bits)
            gone = block.removed(answers)
            offsets, lengths = block.offsets, block.lengths
            kept_upto = np.concatenate([[0], np.cumsum(~gone)])
            kept_at = kept_upto[offsets]
            # runs of removed bytes; a run ends with its document
            row = np.repeat(np.arange(len(lengths)), lengths)
            new = gone.copy()
            new[1:] &= ~gone[:-1] | (row[1:] != row[:-1])
            last = gone.copy()
            last[:-1] &= ~gone[1:] | (row[1:] != row[:-1])
            begin, end = np.flatnonzero(new), np.flatnonzero(last) + 1
            runs_at = np.searchsorted(begin, offsets)
            base = np.repeat(offsets[:-1], np.diff(runs_at))
            kept = pa.Array.from_buffers(
                pa.binary(), len(lengths), [None, pa.py_buffer(kept_at.astype(np.int32)), pa.py_buffer(block.data[~gone])]
            )
            if whole_characters:
                kept = pa.array([x.decode("utf-8", "ignore").encode() for x in kept.to_pylist()], pa.binary())
            runs = pa.ListArray.from_arrays(
                pa.array(runs_at.astype(np.int32)),
                pa.StructArray.from_arrays([pa.array(begin - base), pa.array(end - base)], names=["start", "end"]),
            )
            columns = [table.column(i).combine_chunks() for i in range(table.num_columns - 1)]
            columns += [kept, pa.array(lengths), pa.array(lengths - np.diff(kept_at)), runs]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def remove_repeats(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = 100, whole_characters: bool = False
) -> DataFrame:
    """Every row of `docs` with what is left of its text.

    Returns the struct column `row` (the input columns without the text) and `kept` (the remaining bytes),
    `n_bytes`, `n_removed` and `removed` (the removed runs, as byte offsets in the input).
    With `whole_characters`, `kept` also loses what is left of a UTF-8 character that was cut.
    """
    spark = prepare(docs.sparkSession)
    carried = [c for c in docs.columns if c != text_column]
    rows = docs.select(
        F.struct(*[docs[f"`{c}`"] for c in carried]).alias("row"),
        docs[f"`{id_column}`"].alias("id"),
        docs[f"`{text_column}`"].cast("binary").alias("text"),
    )
    ordered = rows.repartitionByRange("id").sortWithinPartitions("id", "text").select("row", "text")
    blocks = make_blocks(ordered, "suffix-blocks")
    total = blocks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n")).first().n
    v = cover_of(size)
    samples = total * len(COVERS[v]) // v
    # 2**14 times as many names as samples: one candidate in 16,384 is there by chance
    bits = min(64, 14 + max(1, math.ceil(math.log2(samples + 2))))

    def first(table, _):
        return _Block(table, size, bits).first_round()

    def second(table, answers):
        return _Block(table, size, bits).second_round(answers)

    tuples = exchange(blocks, first, samples, "suffix-names")
    windows = exchange(with_replies(blocks, tuples), second, total // 3, "suffix-windows")
    schema = T.StructType([rows.schema["row"], *RESULT.fields])
    joined = with_replies(blocks, tuples, windows)
    return joined.mapInArrow(tidy(_finish(size, bits, whole_characters, empty_like(schema))), schema)
