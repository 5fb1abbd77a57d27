"""Language of texts as a mixture of languages.

*Model.* Byte trigrams (A-Z lower-cased, digits and ASCII punctuation as spaces) are counted per language over all labelled
training rows, hashed to 2**16 bins and smoothed. It has one row of bins per language, however large the corpus.

*Inference.* A text is a sequence of windows of 48 trigrams, each written in one language. Expectation-maximisation
estimates the text's proportions of all languages. Then nested sets of its most probable languages (one, two, ... up to
`MOST`) are fitted again, and the set with the best penalised likelihood (half the log of the number of
windows for every language after the first, times `PENALTY`) is taken. The prediction is its largest proportion, which is also the score.

Cases: null texts and texts without a letter are `und` with score 0; so is every text if there are no labelled training rows.
A text of one or two bytes with a letter has no trigram: it gets the first language, with even odds. Ties of proportions
go to the language that sorts first. All windows of a text count, however long it is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tableprobe.llm.common import buffers, prepare

BINS, WINDOW, MOST, PENALTY = 1 << 16, 48, 4, 4.0
#: More languages than this are refused: the model has one row of bins for each.
MAX_LANGUAGES = 500
_FIRST_ROUNDS, _NEXT_ROUNDS = 12, 6

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def _trigrams(data: np.ndarray) -> np.ndarray:
    """The bin of the trigram that starts at each byte but the last two."""
    folded = _FOLD[data].astype(np.uint32)
    code = (folded[:-2] << np.uint32(16)) | (folded[1:-1] << np.uint32(8)) | folded[2:]
    return (code * np.uint32(0x9E3779B1)) >> np.uint32(16)


def _counter(languages: list[str]):
    """Per task, the bins that its texts have in each language."""
    schema = pa.schema([("lang", pa.int32()), ("bin", pa.int32()), ("n", pa.int64())])

    def run(batches):
        counts = np.zeros((len(languages), BINS), np.int64)
        number = {lang: i for i, lang in enumerate(languages)}
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for lang, a, b in zip(batch.column("lang").to_pylist(), offsets[:-1], offsets[1:]):
                if b - a > 2:
                    counts[number[lang]] += np.bincount(_trigrams(data[a:b]), minlength=BINS)
        lang, place = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(lang.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(counts[lang, place])], schema=schema
        )

    return run


def train_languages(rows: DataFrame, text_column: str = "text", lang_column: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order, and the log probability of every bin in each, from all rows with a language."""
    prepare(rows.sparkSession)
    rows = rows.select(rows[f"`{text_column}`"].cast("binary").alias("text"), rows[f"`{lang_column}`"].alias("lang")).where("lang IS NOT NULL")
    languages = sorted(r.lang for r in rows.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    counts = np.zeros((len(languages), BINS))
    if languages:
        found = rows.mapInArrow(_counter(languages), "lang int, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas()
        counts[found["lang"], found["bin"]] = found["n"]
    smooth = counts + 0.5
    return languages, np.log(smooth / smooth.sum(axis=1, keepdims=True)).astype(np.float32)


def _fit(likelihood: np.ndarray, owner: np.ndarray, starts: np.ndarray, share: np.ndarray, rounds: int):
    """Proportions by expectation-maximisation, and the log likelihood (less the windows' maxima) under them."""
    size = np.diff(np.append(starts, len(owner)))[:, None]
    for _ in range(rounds):
        joint = likelihood * share[owner]
        joint /= joint.sum(axis=1, keepdims=True) + 1e-300
        share = np.add.reduceat(joint, starts, axis=0) / size
    return share, np.add.reduceat(np.log((likelihood * share[owner]).sum(axis=1) + 1e-300), starts)


def mixtures(texts: pa.Array, model: np.ndarray) -> np.ndarray:
    """Proportions of the languages (rows of `model`) in each text, over the best set; zeros for texts under three bytes."""
    data, offsets = buffers(texts)
    lengths = np.diff(offsets)
    out = np.zeros((len(lengths), len(model)))
    rows = np.flatnonzero(lengths > 2)
    if len(rows) == 0:
        return out
    bins = _trigrams(data)
    pieces = -(-(lengths[rows] - 2) // WINDOW)
    starts = np.concatenate([[0], np.cumsum(pieces)[:-1]])
    owner = np.repeat(np.arange(len(rows)), pieces)
    begin = offsets[rows][owner] + (np.arange(len(owner)) - starts[owner]) * WINDOW
    end = np.minimum(begin + WINDOW, offsets[rows][owner] + lengths[rows][owner] - 2)
    edges = np.empty(2 * len(begin), np.int64)
    edges[0::2], edges[1::2] = begin, end
    log = np.empty((len(owner), len(model)))
    for i, row in enumerate(model):
        # a window's sum; the odd pieces are the gaps between windows
        values = np.append(row[bins], np.float32(0))
        log[:, i] = np.add.reduceat(values, edges)[0::2]
    likelihood = np.exp(log - log.max(axis=1, keepdims=True))
    share, _ = _fit(likelihood, owner, starts, np.full((len(rows), len(model)), 1 / len(model)), _FIRST_ROUNDS)
    order = np.argsort(-share, axis=1, kind="stable")
    best, best_value = None, None
    for k in range(1, min(MOST, len(model)) + 1):
        mask = np.zeros_like(share)
        np.put_along_axis(mask, order[:, :k], 1.0, axis=1)
        first = (share + 1e-6) * mask
        fitted, value = _fit(likelihood, owner, starts, first / first.sum(axis=1, keepdims=True), _NEXT_ROUNDS if k > 1 else 0)
        value = value - PENALTY * (k - 1) * 0.5 * np.log(pieces + 1)
        if best is None:
            best, best_value = fitted, value
        else:
            better = value > best_value
            best[better], best_value[better] = fitted[better], value[better]
    out[rows] = best
    return out


def _has_letter(data: bytes | None) -> bool:
    return bool(data) and any(c.isalpha() for c in data.decode("utf-8", "replace"))


def language(text: Column | str, languages: list[str], model: np.ndarray, spark) -> Column:
    """Struct `lang`, `score` and `shares` (proportion per language of the chosen set) of a text column.

    The model travels once to every executor; its size is bounded by the number of languages.
    """
    shared = spark.sparkContext.broadcast((languages, model))

    @F.arrow_udf("lang string, score double, shares map<string,double>")
    def identified(texts: pa.Array) -> pa.Array:
        names, rows = shared.value
        raw = texts.cast(pa.binary())
        letters = [_has_letter(t) for t in raw.to_pylist()]
        share = mixtures(raw, rows) if names else np.zeros((len(letters), 0))
        langs, scores, maps = [], [], []
        for known, p in zip(letters, share):
            if not known or not p.any():
                if known and names:
                    langs.append(names[0])
                    scores.append(1 / len(names))
                else:
                    langs.append("und")
                    scores.append(0.0)
                maps.append([])
                continue
            best = int(np.argmax(p))
            langs.append(names[best])
            scores.append(min(1.0, float(p[best])))
            maps.append([(names[i], float(p[i])) for i in np.flatnonzero(p > 0)])
        kind = pa.map_(pa.string(), pa.float64())
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(maps, kind)], names=["lang", "score", "shares"])

    return identified(text)
