"""Quality rules with compression bands.

A text is compressed with zstandard as a whole and in fixed chunks of 1024 bytes. Its ratios (bytes over
compressed bytes) must lie in a band for its length: above it the text repeats itself, below it is not
language (keys, encoded data, random letters). Of the chunks, of at least half the chunk size, no more than half may lie outside theirs.
Base rules come first: enough words, and not too many words in repeated windows of eight.

Measures, over the words `[^\\x20\\x09-\\x0D]+` of the whole text: see `FIELDS`.

Cases: null and empty texts have no words, all measures are 0, the ratios null, and they fail the base rules. Texts too short for
a band's first length have no band. Long texts are compressed as a whole. Equal rows get equal results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, functions as F

from tableprobe.llm.common import SPACES, mix

LEVEL, CHUNK = 3, 1024
#: From so many bytes on: least and largest ratio of the whole text.
WHOLE = ((0, 0.0, 2.5), (128, 1.0, 3.0), (512, 1.2, 4.0), (1024, 1.3, 5.0), (4096, 1.4, 6.0), (16384, 1.5, 8.0), (65536, 1.5, 10.0))
#: Least and largest ratio of a chunk, and the share of chunks that may lie outside.
CHUNKS, OUTSIDE = (1.2, 4.0), 0.5
WINDOW, MIN_WORDS, MAX_REPEATED = 8, 20, 30

FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "reason string, ratio double, n_chunks long, n_chunks_outside long"
)

_KINDS = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "double": pa.float64()}
_ARROW = pa.schema([(f.split()[0], _KINDS[f.split()[1]]) for f in FIELDS.split(", ")])

_SYMBOLS = b"#*$%&|<>"


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words that lie in a window of `size` words which occurs at least twice."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint64, len(words))
    names = np.zeros(n, np.uint64)
    for j in range(size):
        names = mix(names + ids[j : j + n] + np.uint64(j + 1))
    order = np.argsort(names, kind="stable")
    same = names[order[1:]] == names[order[:-1]]
    if not same.any():
        return 0
    left, right = order[:-1][same], order[1:][same]
    # the names only propose: windows are compared word by word
    equal = np.all(np.stack([ids[left + j] == ids[right + j] for j in range(size)]), axis=0)
    edge = np.zeros(len(words) + 1, np.int64)
    for side in (left[equal], right[equal]):
        np.add.at(edge, side, 1)
        np.add.at(edge, side + size, -1)
    return int(np.count_nonzero(np.cumsum(edge[:-1]) > 0))


def measure(data: bytes, compress) -> tuple:
    words = data.split()
    word_bytes = data.translate(None, SPACES)
    word_chars = len(word_bytes) if word_bytes.isascii() else len(word_bytes.decode("utf-8", "replace"))
    symbols = len(data) - len(data.translate(None, _SYMBOLS))
    seen: set[bytes] = set()
    repeats = 0
    for line in data.split(b"\n"):
        if line in seen:
            repeats += 1
        elif line.strip(SPACES):
            seen.add(line)
    in_repeats = repeated_words(words)
    failed = len(words) < MIN_WORDS or 100 * in_repeats > MAX_REPEATED * len(words)
    if not data:
        return 0, 0, 0, 0, 0, True, False, "base", None, 0, 0
    ratio = len(data) / len(compress(data))
    low, high = next((lo, hi) for least, lo, hi in reversed(WHOLE) if len(data) >= least)
    pieces = [data[i : i + CHUNK] for i in range(0, len(data), CHUNK)]
    pieces = [p for p in pieces if 2 * len(p) >= CHUNK]
    outside = 0
    for piece in pieces:
        r = len(piece) / len(compress(piece))
        outside += not CHUNKS[0] <= r <= CHUNKS[1]
    reason = None
    if failed:
        reason = "base"
    elif ratio > high:
        reason = "repetitive"
    elif ratio < low:
        reason = "incompressible"
    elif outside > OUTSIDE * len(pieces):
        reason = "chunks"
    return len(words), word_chars, symbols, repeats, in_repeats, failed, reason is None, reason, ratio, len(pieces), outside


def _measured(texts: pa.Array) -> pa.Array:
    compress = zstandard.ZstdCompressor(level=LEVEL).compress
    rows = [measure(t or b"", compress) for t in texts.cast(pa.binary()).to_pylist()]
    columns = list(zip(*rows)) or [()] * len(_ARROW)
    return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], fields=list(_ARROW))


def quality(text: Column | str) -> Column:
    """The measures and the verdict of a text column as one struct; `reason` says why a text is not kept."""
    return F.arrow_udf(_measured, FIELDS)(text)
