"""Scores of texts under an n-gram language model with deleted interpolation.

Tokens are the words of a text (A-Z lower-cased, between ASCII white space) and one end. With f_k the maximum-likelihood
estimate from the counts of k-grams in all training rows,

    P_k(w | h) = l_k(b) * f_k(w | h) + (1 - l_k(b)) * P_(k-1)(w | h'),   P_0 = 1 / (V + 1)

where b is the bucket (power of two) of the frequency of the context h; a context never seen passes the weight on.
The probabilities of the V known tokens and one unknown sum to 1 in every context.

*Counts* are of all training rows, by exchange of n-gram names between blocks of documents (`exchange`): an n-gram is
only asked for if both (n-1)-grams in it occur in another block, otherwise its count is known in its own block.

*Weights* come from held-out counts: every training row is scored with its own counts deleted from all
counts, which makes it held out without a second model. What decides a token's probability is summed
up as cells (bucket and estimate to half an octave, per order) over all training tokens; the cells, whose number does not
grow with the input, go to the driver, where expectation-maximisation finds the weights.

Cases: a null text counts as empty, it has the end token only. Rows that are not training rows are scored with full
counts; so are training rows. Without training rows every token has probability 1 / (V + 1) = 1. Repeated rows count repeatedly.
N-gram names are 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tableprobe.llm.common import Words, mix, prepare
from tableprobe.llm.exchange import Answer, blocks_in, empty_like, exchange, make_blocks, name_totals, with_replies

_END, _START = np.uint64(0x3C2F733E00000001), np.uint64(0x3C733E0000000001)
_FACTOR = np.uint64(0xD1342543DE82EF95)
_EM_ROUNDS = 60
#: Cells: 5 bits for the bucket of a context, 6 for the estimate, per order.
_BITS = 11


class _Block:
    """The tokens of one block and the counts of the n-grams that end in them."""

    def __init__(self, table: pa.Table):
        words = Words(table.column("text").combine_chunks() if isinstance(table.column("text"), pa.ChunkedArray) else table.column("text"))
        rows = len(words.first) - 1
        self.size = np.diff(words.first) + 1
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        self.row = np.repeat(np.arange(rows), self.size)
        self.tokens = np.empty(self.start[-1], np.uint64)
        ends = np.zeros(len(self.tokens), bool)
        ends[self.start[1:] - 1] = True
        self.tokens[~ends], self.tokens[ends] = words.hashes, _END
        self.train = np.asarray(table.column("train").to_numpy(), bool)
        self.trained = self.train[self.row]

    def shift(self, values: np.ndarray, at_start) -> np.ndarray:
        """The value of the token before; at the start of a row, the one given."""
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[self.start[:-1]] = at_start
        return out

    def grams(self, order: int, answers: dict[int, Answer], asking: bool = False):
        """For k = 1 to `order`, per token: the total count of its k-gram, and what its own row has of it.

        When `asking`, the names to ask for and their own counts in place of the last."""
        name, shared = self.tokens, np.ones(len(self.tokens), bool)
        for k in range(1, order + 1):
            if k > 1:
                context = self.shift(name, mix(np.array([_START + np.uint64(k)]))[0])
                name = mix(context * _FACTOR + self.tokens)
                shared = shared & self.shift(shared, True)
            distinct, inverse = np.unique(name, return_inverse=True)
            own = np.bincount(inverse, self.trained, len(distinct)).astype(np.int64)
            asked = np.zeros(len(distinct), bool)
            asked[inverse[shared]] = True
            if asking and k == order:
                yield distinct[asked], own[asked]
                return
            many, total = np.zeros(len(distinct), bool), own.copy()
            if k in answers:
                many[asked], total[asked] = answers[k].totals()
            shared = many[inverse]
            # occurrences within the row
            pair = mix(name + _FACTOR * (self.row.astype(np.uint64) + np.uint64(1)))
            _, of_row, in_row = np.unique(pair, return_inverse=True, return_counts=True)
            yield total[inverse], np.where(self.trained, in_row[of_row], 0)

    def estimates(self, order: int, answers, tokens: int, documents: int, delete: bool):
        """For each order: the count of the context and the estimate f, with the row's own counts deleted or not."""
        above = np.full(len(self.tokens), tokens, np.int64)
        if delete:
            above = above - np.where(self.trained, self.size[self.row], 0)
        for count, in_row in self.grams(order, answers):
            count = count - in_row if delete else count
            with np.errstate(divide="ignore", invalid="ignore"):
                yield above, np.where(above > 0, count / above, 0.0), count
            above = self.shift(count, 0)
            above[self.start[:-1]] = documents - (self.train.astype(np.int64) if delete else 0)


def _bucket(count: np.ndarray) -> np.ndarray:
    """0 for no occurrence, else 1 + the power of two below, at most 31."""
    return np.where(count > 0, np.minimum(31, 1 + np.log2(np.maximum(count, 1)).astype(np.int64)), 0)


def _cells(order: int, tokens: int, documents: int):
    schema = pa.schema([("cell", pa.int64()), ("n", pa.int64())])

    def run(batches):
        for _, table, answers in blocks_in(batches):
            block = _Block(table)
            cell = np.zeros(len(block.tokens), np.int64)
            for above, f, _ in block.estimates(order, answers, tokens, documents, True):
                with np.errstate(divide="ignore"):
                    level = np.where(f > 0, 1 + np.clip(np.round(-2 * np.log2(f)), 0, 62), 0).astype(np.int64)
                cell = (cell << _BITS) | (_bucket(above) << 6) | level
            cells, n = np.unique(cell[block.trained], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(n.astype(np.int64))], schema=schema)

    return run


def fit_weights(cells: np.ndarray, n: np.ndarray, order: int, unknown: float) -> np.ndarray:
    """Weights l[k, bucket] by expectation-maximisation over cells and how often they occur."""
    part = np.stack([(cells >> (_BITS * (order - 1 - k))) & ((1 << _BITS) - 1) for k in range(order)])
    bucket, level = part >> 6, part & 63
    f = np.where(level > 0, 2.0 ** (-(level - 1) / 2), 0.0)
    weights = np.full((order, 32), 0.5)
    weights[:, 0] = 0.0
    for _ in range(_EM_ROUNDS):
        # lower[k]: the probability by orders up to k
        lower = [np.full(len(n), unknown)]
        own = []
        for k in range(order):
            w = weights[k, bucket[k]]
            own.append(w * f[k])
            lower.append(own[k] + (1 - w) * lower[k])
        reach = n / lower[order]
        for k in reversed(range(order)):
            w = weights[k, bucket[k]]
            used, passed = reach * own[k], reach * (1 - w) * lower[k]
            used, passed = np.bincount(bucket[k], used, 32), np.bincount(bucket[k], passed, 32)
            reach = reach * (1 - w)
            weights[k] = (used + 0.5) / (used + passed + 1)
        weights[:, 0] = 0.0
    return weights


_RESULT = "n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scorer(order: int, tokens: int, vocabulary: int, documents: int, weights: np.ndarray, schema: pa.Schema):
    def run(batches):
        for _, table, answers in blocks_in(batches):
            block = _Block(table)
            p = np.full(len(block.tokens), 1.0 / (vocabulary + 1))
            for k, (above, f, count) in enumerate(block.estimates(order, answers, tokens, documents, False)):
                if k == 0:
                    known = count > 0
                    base = np.log10((count + 0.1) / (tokens + 0.1 * (vocabulary + 1)))
                w = weights[k, _bucket(above)]
                p = w * f + (1 - w) * p
            at = block.start[:-1]
            columns = [
                table.column("row").combine_chunks(),
                block.size,
                np.add.reduceat(known.astype(np.int64), at),
                np.full(len(at), tokens, np.int64),
                np.add.reduceat(base, at),
                np.add.reduceat(np.log10(p), at),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c).cast(f.type) if isinstance(c, np.ndarray) else c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def score_texts(docs: DataFrame, train: Column, text_column: str = "text", order: int = 2) -> DataFrame:
    """Every row of `docs` with its scores; `train` says which rows the model learns from (null: not).

    Returns the struct column `row` (the input columns without the text), `n_tokens`, `n_known` (tokens seen in training),
    `train_tokens`, `base_score` (log10 of an add-0.1 unigram model) and `score` (log10 of this model).
    """
    spark = prepare(docs.sparkSession)
    carried = [c for c in docs.columns if c != text_column]
    rows = docs.select(
        F.struct(*[docs[f"`{c}`"] for c in carried]).alias("row"),
        F.coalesce(train, F.lit(False)).alias("train"),
        docs[f"`{text_column}`"].cast("binary").alias("text"),
    )
    blocks = make_blocks(rows, "lm-blocks")
    totals = blocks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("bytes")).first()
    replies: list[DataFrame] = []
    for k in range(1, order + 1):

        def send(table, answers, k=k):
            *_, asked = _Block(table).grams(k, answers, asking=True)
            return {k: asked}

        source = with_replies(blocks, *replies) if replies else blocks
        replies.append(exchange(source, send, totals.bytes // (40 if k == 1 else 10), f"lm-{k}-grams"))
        if k == 1:
            vocabulary, tokens = name_totals(replies[0], 1)
    documents = docs.where(train).count()
    answered = with_replies(blocks, *replies)
    cells = answered.mapInArrow(_cells(order, tokens, documents), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    cells = cells.toPandas()
    weights = fit_weights(cells["cell"].to_numpy(np.int64), cells["n"].to_numpy(np.float64), order, 1.0 / (vocabulary + 1))
    schema = T.StructType([rows.schema["row"], *T.StructType.fromDDL(_RESULT).fields])
    return answered.mapInArrow(_scorer(order, tokens, vocabulary, documents, weights, empty_like(schema)), schema)
