"""Byte-level BPE encoding and decoding as a reduction over a tree.

Encodings form a monoid: the encodings of two halves are joined into that of the whole by encoding a window around
the seam anew, wider and wider, until the tokens outside it provably stay. Two proofs are used:

* *In a text*, a match of the pattern starts at every space between two characters that are not white space, whatever
  stands elsewhere. A window from such a space left of the seam to one right of it leaves all tokens outside as they are;
  it grows until it has both.
* *In the bytes of one long match*, a sequence of tokens is the encoding of its bytes exactly if every two neighbours a, b
  are, that is if the bytes of a and b together encode to [a, b]. (Take the first merge across any seam of the
  whole; all merges before it lie inside tokens, so the two neighbours alone would come to the same merge.) Inside the
  halves and the window neighbours agree already; the window grows until its two seams do.

Leaves, of at most four thousand characters, are encoded by the tokenizer library.

Cases: a null text counts as empty and has no ids; so has an empty one. Text that is not UTF-8 is read with replacement characters.
Long texts and long runs without a space cost n log n. Decoding gives bytes; an id outside the vocabulary, or a null
id, makes the result null, as do null ids.
"""

from __future__ import annotations

import base64
import heapq
import itertools

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, SparkSession, functions as F

#: Characters of a text, and bytes of one match, that are encoded at once; more are encoded in halves.
LEAF_TEXT, LEAF_BYTES = 4096, 1024
#: Characters on each side of a seam that are tried first, and checked pairs that a worker remembers.
SEAM, MEMORY = 32, 200_000
_LONG_MERGE = 96


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file: a base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


#: A space between two other characters than white space, which starts a match.
_CERTAIN = regex.compile(r"[^\s\x1c-\x1f] [^\s\x1c-\x1f]")


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self._leaf = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._matches = regex.compile(pattern).findall
        self._pairs: dict[tuple[int, int], bool] = {}

    # bytes -------------------------------------------------------------------------------

    def merge(self, data: bytes) -> list[int]:
        """The encoding by merging the lowest-ranked neighbours, leftmost first."""
        if len(data) > _LONG_MERGE:
            return self._merge_long(data)
        rank = self.ranks.get
        parts = [data[i : i + 1] for i in range(len(data))]
        far = len(self.ranks) + 1
        costs = [rank(data[i : i + 2], far) for i in range(len(data) - 1)]
        while costs:
            least = min(costs)
            if least == far:
                break
            i = costs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del costs[i]
            if i < len(costs):
                costs[i] = rank(parts[i] + parts[i + 1], far)
            if i:
                costs[i - 1] = rank(parts[i - 1] + parts[i], far)
        ranks = self.ranks
        return [ranks[x] for x in parts]

    def _merge_long(self, data: bytes) -> list[int]:
        """The same with a heap."""
        n = len(data)
        rank, end, before = self.ranks.get, list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(i):
            if end[i] < n:
                stop = end[end[i]]
                r = rank(data[i:stop])
                if r is not None:
                    heapq.heappush(heap, (r, i, end[i], stop))

        for i in range(n - 1):
            offer(i)
        alive = [True] * n
        while heap:
            _, i, mid, stop = heapq.heappop(heap)
            if not alive[i] or end[i] != mid or mid >= n or not alive[mid] or end[mid] != stop:
                continue
            alive[mid] = False
            end[i] = stop
            if stop < n:
                before[stop] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        out, i = [], 0
        while i < n:
            out.append(self.ranks[data[i : end[i]]])
            i = end[i]
        return out

    def stays(self, a: int, b: int) -> bool:
        """Whether two neighbouring tokens are the encoding of their bytes."""
        known = self._pairs.get((a, b))
        if known is None:
            if len(self._pairs) >= MEMORY:
                self._pairs.clear()
            known = self._pairs[a, b] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the bytes of two encodings together."""
        if not left or not right:
            return left or right
        if self.stays(left[-1], right[0]):
            return left + right
        reach = 1
        while True:
            i, j = max(0, len(left) - reach), min(len(right), reach)
            window = self.merge(b"".join(self.bytes_of[t] for t in (*left[i:], *right[:j])))
            if (i == 0 or self.stays(left[i - 1], window[0])) and (j == len(right) or self.stays(window[-1], right[j])):
                return left[:i] + window + right[j:]
            reach *= 2

    def encode_bytes(self, data: bytes) -> list[int]:
        if len(data) <= LEAF_BYTES:
            return self.merge(data)
        half = len(data) // 2
        return self.join(self.encode_bytes(data[:half]), self.encode_bytes(data[half:]))

    # texts -------------------------------------------------------------------------------

    def _run(self, text: str) -> list[int]:
        """The ids of a text that no seam divides."""
        if len(text) <= min(LEAF_TEXT, LEAF_BYTES):
            return self._leaf(text)
        ids: list[int] = []
        for match in self._matches(text):
            data = match.encode()
            rank = self.ranks.get(data)
            ids += self.encode_bytes(data) if rank is None else [rank]
        return ids

    def _tokens_in(self, ids, length: int) -> int:
        """How many of the tokens make up so many bytes."""
        count = 0
        for i in ids:
            if length <= 0:
                break
            length -= len(self.bytes_of[i])
            count += 1
        return count

    def encode(self, text: str) -> list[int]:
        """The ids of a text."""
        if len(text) <= LEAF_TEXT:
            return self._leaf(text)
        half = len(text) // 2
        reach = SEAM
        while True:
            start, end = max(0, half - reach), min(len(text), half + reach)
            left = _CERTAIN.search(text, start, half)
            left = left.start() + 1 if left and start else 0
            right = _CERTAIN.search(text, half, end)
            right = right.start() + 1 if right else len(text)
            if (left or start == 0) and (right < len(text) or end == len(text)):
                break
            reach *= 2
        if left == 0 and right == len(text):
            return self._run(text)
        before, after = self.encode(text[:half]), self.encode(text[half:])
        drop = self._tokens_in(reversed(before), len(text[left:half].encode()))
        skip = self._tokens_in(after, len(text[half:right].encode()))
        return before[: len(before) - drop] + self.encode(text[left:right]) + after[skip:]

    def decode(self, ids) -> bytes | None:
        if len(ids) > 1024:
            half = len(ids) // 2
            left, right = self.decode(ids[:half]), self.decode(ids[half:])
            return None if left is None or right is None else left + right
        try:
            return b"".join([self.bytes_of[i] for i in ids])
        except KeyError:
            return None


_ENCODERS: dict = {}


class Tokenizer:
    """Columns that encode and decode by one vocabulary, which travels once to every executor."""

    def __init__(self, spark: SparkSession, ranks_path: str, pattern: str):
        ranks = read_ranks(ranks_path)
        self._key = (ranks_path, len(ranks), pattern)
        self._shared = spark.sparkContext.broadcast((ranks, pattern))

    def _encoder(self):
        # the key tells workers that outlive one query which vocabulary they hold
        shared, key = self._shared, self._key

        def current() -> Encoder:
            if key not in _ENCODERS:
                _ENCODERS.clear()
                _ENCODERS[key] = Encoder(*shared.value)
            return _ENCODERS[key]

        return current

    def encode(self, text: Column | str) -> Column:
        """The ids of a text column, as array<int>."""
        current = self._encoder()

        @F.arrow_udf("array<int>")
        def encoded(texts: pa.Array) -> pa.Array:
            encoder = current()
            ids = [encoder.encode(t.decode("utf-8", "replace")) if t else [] for t in texts.cast(pa.binary()).to_pylist()]
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = np.fromiter(itertools.chain.from_iterable(ids), np.int32, int(ends[-1]))
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))

        return encoded(text)

    def decode(self, ids: Column | str) -> Column:
        """The bytes of an array<int> column of ids."""
        current = self._encoder()

        @F.arrow_udf("binary")
        def decoded(lists: pa.Array) -> pa.Array:
            encoder = current()
            if lists.null_count or lists.flatten().null_count:
                rows = lists.to_pylist()
            else:
                flat, ends = lists.flatten().to_numpy().tolist(), np.asarray(lists.offsets)
                rows = [flat[a:b] for a, b in zip(ends[:-1] - ends[0], ends[1:] - ends[0])]
            return pa.array([None if x is None else encoder.decode(x) for x in rows], pa.binary())

        return decoded(ids)
