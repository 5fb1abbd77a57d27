"""A convolutional text classifier for toxic documents.

Every word is the sum of three hashed embeddings (the word, its first and its last five bytes). Filters over one, two and three words
(zero-padded at the end of the text) are rectified and max-pooled over the whole text, and a linear layer makes the score. It is
trained in numpy with Adam; gradients flow through the pooled positions only. The first dimension of the embeddings starts at the log odds
of their bucket. The language of a text is guessed from its words; the threshold of each language is the one with the best F1 on
all labelled rows not trained on, and scores are shifted so that it lies at 0.5.

*Sample.* Only the weights come from a sample: at most `POSITIVES` toxic and `NEGATIVES` other labelled ids, those with the smallest
hashes, of texts up to `LONGEST` bytes, without every fifth id, until the texts of either kind fill half of `SAMPLE_BYTES`; of several rows with one id one is taken. That
bounds what reaches the driver, whatever repeats. The words of the languages come from whole texts of all rows that may be learned from and have a
language, the thresholds from those of all labelled rows that were not sampled, counted by Spark into buckets and score bins by language and label. Every
row that may be learned from is scored once, and its id, language and score bin meet the labels: no text is shuffled.
Every language has a threshold of its own; the bins of all languages are added to its bins with the weight of `PRIOR` toxic rows, so that a few
rows alone don't decide. Scoring covers every text as a whole.

Cases: null and empty texts have no words; their score is 0. Labels that are null are not used; of several labels of one
row the largest counts. Without labelled rows of both kinds every score is the share of toxic ones among them (0 without any). Rows
without a language are trained on, but tell nothing of languages.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tableprobe.llm.common import Words, buffers, pieces, prepare, release, saved, tidy

POSITIVES, NEGATIVES, LONGEST, SAMPLE_BYTES = 2500, 5500, 200_000, 64_000_000
BUCKETS, SIZE, AFFIX = 1 << 15, 8, 5
WIDTHS, FILTERS = (1, 2, 3), 8
#: Steps of training, whatever the size of the sample.
STEPS, BATCH, RATE = 600, 64, 0.01
#: Every fifth row is never trained on.
HELD = 5
#: So many toxic rows of all languages count for each language's threshold.
PRIOR = 5
#: Scores are counted in bins from -RANGE to RANGE, BINS to one.
RANGE, BINS = 40, 64


@dataclass
class Model:
    constant: float | None = None
    embeddings: np.ndarray | None = None  # (3, BUCKETS, SIZE)
    filters: list[np.ndarray] | None = None  # per width (width, SIZE, FILTERS)
    biases: list[np.ndarray] | None = None
    out: np.ndarray | None = None
    out_bias: float = 0.0
    languages: list[str] | None = None
    language_words: np.ndarray | None = None  # (languages, BUCKETS)
    thresholds: np.ndarray | None = None  # one more than languages: the last is for all


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Three buckets per word, and the first word of every text."""
    words = Words(texts)
    head, tail = words.affixes(AFFIX)
    shift = np.uint64(64 - 15)
    return np.stack([(h >> shift).astype(np.int32) for h in (words.hashes, head, tail)]), words.first


def _convolve(model: Model, words: np.ndarray, first: np.ndarray):
    """Embedded words, and for each width the rectified filters at every word."""
    e = model.embeddings
    x = e[0][words[0]]
    x += e[1][words[1]]
    x += e[2][words[2]]
    # words that follow in the same text
    follow = np.repeat(first[1:], np.diff(first)) - np.arange(len(x)) - 1
    outs = []
    for filters, bias in zip(model.filters, model.biases):
        y = x @ filters[0]
        for j in range(1, min(len(filters), len(x))):
            step = x[j:] @ filters[j]
            step[follow[:-j] < j] = 0
            y[:-j] += step
        y += bias
        np.maximum(y, 0, out=y)
        outs.append(y)
    return x, outs


def _pool(outs: list[np.ndarray], first: np.ndarray) -> np.ndarray:
    some = np.flatnonzero(np.diff(first) > 0)
    pooled = np.zeros((len(first) - 1, FILTERS * len(outs)), np.float32)
    for k, y in enumerate(outs):
        if len(some):
            pooled[some, k * FILTERS : (k + 1) * FILTERS] = np.maximum.reduceat(y, first[some], axis=0)
    return pooled


def logits(model: Model, words: np.ndarray, first: np.ndarray) -> np.ndarray:
    _, outs = _convolve(model, words, first)
    return _pool(outs, first) @ model.out + model.out_bias


def guess_languages(model: Model, words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The number of each text's language; that of `all` without words or languages."""
    rows = len(first) - 1
    guess = np.full(rows, len(model.languages))
    some = np.flatnonzero(np.diff(first) > 0)
    if len(model.languages) and len(some):
        sums = np.stack([np.add.reduceat(row[words[0]], first[some]) for row in model.language_words])
        guess[some] = np.argmax(sums, axis=0)
    return guess


def predict(model: Model, texts: pa.Array) -> np.ndarray:
    """The score of every text, with its language's threshold at 0.5."""
    if model.constant is not None:
        return np.full(len(texts), model.constant)
    scores = np.zeros(len(texts))
    for at, some in pieces(texts):
        words, first = features(some)
        margin = logits(model, words, first).astype(np.float64) - model.thresholds[guess_languages(model, words, first)]
        scores[at : at + len(some)] = np.where(np.diff(first) > 0, 1 / (1 + np.exp(-np.clip(margin, -40, 40))), 0.0)
    return scores


class _Adam:
    def __init__(self, values: list[np.ndarray]):
        self.values, self.m, self.v, self.t = values, [np.zeros_like(x) for x in values], [np.zeros_like(x) for x in values], 0

    def step(self, grads: list[np.ndarray]):
        self.t += 1
        for x, m, v, g in zip(self.values, self.m, self.v, grads):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x -= RATE * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


def _slice(words, first, rows):
    """The words of some rows, end to end."""
    place = np.concatenate([np.arange(first[r], first[r + 1]) for r in rows]) if len(rows) else np.zeros(0, np.int64)
    return words[:, place], np.concatenate([[0], np.cumsum(first[rows + 1] - first[rows])])


def _featured(batches):
    """Rows of the sample with the buckets of their words in place of the text, as 16-bit numbers."""
    for batch in batches:
        words, first = features(batch.column("text"))
        short = words.T.astype(np.uint16)
        own = pa.array([short[a:b].tobytes() for a, b in zip(first[:-1], first[1:])], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("label"), own], names=["label", "words"])


def fit(words: np.ndarray, first: np.ndarray, labels: np.ndarray) -> Model:
    """The weights of a model of rows with these features, without languages and thresholds. There are rows of both labels."""
    random = np.random.default_rng(5)
    train = np.arange(len(labels))
    # log odds of a bucket over the rows it occurs in
    embeddings = random.normal(0, 0.05, (3, BUCKETS, SIZE)).astype(np.float32)
    seen = np.zeros((2, 3, BUCKETS))
    for r in train:
        for k in range(3):
            seen[int(labels[r]), k, np.unique(words[k, first[r] : first[r + 1]])] += 1
    count = np.array([(labels[train] == 0).sum(), (labels[train] == 1).sum()])
    odds = np.log((seen[1] + 0.5) / (count[1] + 1)) - np.log((seen[0] + 0.5) / (count[0] + 1))
    sure = (seen.sum(axis=0) >= 3) & (np.abs(odds) > 1)
    embeddings[:, :, 0] = np.where(sure, odds / 3, 0)
    model = Model(
        embeddings=embeddings,
        filters=[random.normal(0, 0.3, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS],
        biases=[np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        out=random.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32),
    )
    for f in model.filters:
        f[0, 0, : FILTERS // 2] = 1.0
    dense = _Adam([*model.filters, *model.biases, model.out])
    bias_state = _Adam([np.zeros(1, np.float32)])
    second = np.zeros((3, BUCKETS, SIZE), np.float32)
    for _ in range(math.ceil(STEPS * BATCH / len(train))):
        order = random.permutation(train)
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            w, f = _slice(words, first, some)
            x, outs = _convolve(model, w, f)
            pooled = _pool(outs, f)
            score = pooled @ model.out + bias_state.values[0]
            error = ((1 / (1 + np.exp(-np.clip(score, -40, 40)))) - labels[some]).astype(np.float32) / len(some)
            back = error[:, None] * model.out[None, :] * (pooled > 0)
            grad_filters = [np.zeros_like(v) for v in model.filters]
            grad_biases = [np.zeros_like(v) for v in model.biases]
            touched, pulls = [], []
            for k, y in enumerate(outs):
                g = back[:, k * FILTERS : (k + 1) * FILTERS]
                grad_biases[k] = g.sum(axis=0)
                for d in np.flatnonzero(np.diff(f) > 0):
                    best = f[d] + np.argmax(y[f[d] : f[d + 1]], axis=0)
                    for j in range(WIDTHS[k]):
                        inside = best + j < f[d + 1]
                        if inside.any():
                            where, cols = best[inside] + j, np.flatnonzero(inside)
                            grad_filters[k][j][:, cols] += x[where].T * g[d, cols]
                            touched.append(where)
                            pulls.append(model.filters[k][j][:, cols].T * g[d, cols][:, None])
            if touched:
                where, pull = np.concatenate(touched), np.concatenate(pulls)
                for k in range(3):
                    bucket, inverse = np.unique(w[k][where], return_inverse=True)
                    total = np.zeros((len(bucket), SIZE), np.float32)
                    np.add.at(total, inverse, pull)
                    second[k][bucket] += total * total
                    model.embeddings[k][bucket] -= RATE * total / (np.sqrt(second[k][bucket]) + 1e-6)
            dense.step([*grad_filters, *grad_biases, pooled.T @ error])
            bias_state.step([np.array([error.sum()], np.float32)])
    model.out_bias = float(bias_state.values[0][0])
    return model


def _set_languages(model: Model, known: list[str], counts: np.ndarray):
    """Languages by how often their texts have the words of each bucket."""
    smooth = counts + 0.1
    model.languages = known
    model.language_words = np.log(smooth / smooth.sum(axis=1, keepdims=True)).astype(np.float32)


def _bin(score: np.ndarray) -> np.ndarray:
    return np.clip(np.floor((score.astype(np.float64) + RANGE) * BINS), 0, 2 * RANGE * BINS - 1).astype(np.int64)


def _set_thresholds(model: Model, bins: np.ndarray, weight_of_negatives: float):
    """Thresholds from counts by (guessed language, label, bin)."""
    bins = bins * np.array([weight_of_negatives, 1.0])[None, :, None]
    every = bins.sum(axis=0)
    prior = every * (PRIOR / max(1, every[1].sum()))
    model.thresholds = np.array([_threshold(own + prior) for own in bins[:-1]] + [_threshold(every)])


def _threshold(bins: np.ndarray) -> float:
    """The score that separates best by F1, in the middle between the last bin above and the first below."""
    used = np.flatnonzero(bins.sum(axis=0))[::-1]
    if not len(used):
        return 0.0
    hits, wrong = np.cumsum(bins[1][used]), np.cumsum(bins[0][used])
    best = int(np.argmax(2 * hits / np.maximum(hits + wrong + hits[-1], 1e-12)))
    low = used[best] if best + 1 == len(used) else (used[best] + used[best + 1] + 1) / 2
    return float(low / BINS - RANGE)


def _word_counts(batches):
    """How often each bucket occurs in the texts of a language, per task."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for at, some in pieces(batch.column("text")):
            words = Words(some)
            buckets = (words.hashes >> np.uint64(64 - 15)).astype(np.int32)
            for row in range(len(some)):
                lang = langs[at + row]
                if lang not in counts:
                    counts[lang] = np.zeros(BUCKETS, np.int64)
                np.add.at(counts[lang], buckets[words.first[row] : words.first[row + 1]], 1)
    for lang, own in counts.items():
        some = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(own[some])], names=["lang", "bucket", "n"])


def _binner(shared):
    def run(batches):
        for batch in batches:
            model = shared.value
            for at, texts in pieces(batch.column("text")):
                words, first = features(texts)
                some = pa.array(np.diff(first) > 0)  # without words the score is 0 whatever the threshold
                where = (guess_languages(model, words, first), _bin(logits(model, words, first)))
                columns = [batch.column("id").slice(at, len(texts)), *(pa.array(x.astype(np.int32)) for x in where)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "guess", "bin"]).filter(some)

    return run


def _sampled(own: DataFrame, by_hash: Column) -> list:
    """The ids the weights are learned from, with their labels."""
    chosen = []
    for label, most in ((1, POSITIVES), (0, NEGATIVES)):
        size = 0
        for r in own.where(F.col("label") == label).orderBy(by_hash, "id").limit(most).collect():
            size += r.bytes
            if size > SAMPLE_BYTES // 2:
                break
            chosen.append((r.id, label))
    return chosen


def train_toxicity(docs: DataFrame, labels: DataFrame, train: Column, id_column="doc_id", text_column="text", lang_column="lang", label_column="toxic") -> Model:
    """A model of the labelled rows of `docs`; `train`: over the id column of both tables, which may be learned from."""
    spark = prepare(docs.sparkSession)
    own = labels.where(train).where(labels[f"`{label_column}`"].isNotNull() & labels[f"`{id_column}`"].isNotNull())
    own = own.groupBy(own[f"`{id_column}`"].alias("id")).agg(F.max(own[f"`{label_column}`"]).cast("int").alias("label"))
    learned = docs.where(train)
    rows = learned.select(
        learned[f"`{id_column}`"].alias("id"),
        learned[f"`{text_column}`"].cast("binary").alias("text"),
        (learned[f"`{lang_column}`"] if lang_column in docs.columns else F.lit(None)).cast("string").alias("lang"),
    )
    length = F.coalesce(F.octet_length("text"), F.lit(0))
    # ids of rows that exist, so that the sample is full whatever `docs` holds; the longest row of an id counts
    own = own.where("label IN (0, 1)").join(rows.groupBy("id").agg(F.max(length).alias("bytes")), "id")
    own = own.withColumns({"short": F.col("bytes") <= LONGEST, "held": F.pmod(F.xxhash64("id", F.lit("held")), F.lit(HELD)) == 0})
    own = saved(own, "labelled")
    totals = {(r.label, r.short, r.held): r.n for r in own.groupBy("label", "short", "held").agg(F.count("*").alias("n")).collect()}

    def both(of) -> bool:
        return all(any(label == k[0] and of(k) for k in totals) for label in (0, 1))

    total = [sum(n for k, n in totals.items() if k[0] == label) for label in (0, 1)]
    if not both(lambda k: k[1]):
        return Model(constant=total[1] / max(1, sum(total)))
    usable = own.where("short AND NOT held") if both(lambda k: k[1] and not k[2]) else own.where("short")
    chosen = _sampled(usable, F.xxhash64("id"))
    ids = spark.createDataFrame(chosen, T.StructType([own.schema["id"], own.schema["label"]]))
    # at most POSITIVES + NEGATIVES ids, and one row of each
    sample = rows.join(F.broadcast(ids), "id").groupBy("id", "label").agg(F.min_by("text", F.xxhash64("text", "lang")).alias("text"))
    sample = sample.select("label", "text").mapInArrow(tidy(_featured), "label int, words binary")
    sample = sample.toArrow().sort_by([("label", "ascending"), ("words", "ascending")]).combine_chunks()
    words, first = buffers(sample.column("words"))
    words, first = np.ascontiguousarray(words.view(np.uint16).reshape(-1, 3).T).astype(np.int32), first // 6
    model = fit(words, first, sample.column("label").to_numpy().astype(np.int64))

    # languages from all rows that have one, thresholds from all labelled ones that were not fitted on
    counted = rows.where("lang IS NOT NULL").select("lang", "text").mapInArrow(tidy(_word_counts), "lang string, bucket int, n long")
    counted = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = counted.column("lang").to_pylist()
    known = sorted(set(langs))
    place = {lang: i for i, lang in enumerate(known)}
    counts = np.zeros((len(known), BUCKETS))
    counts[[place[lang] for lang in langs], counted.column("bucket").to_numpy()] = counted.column("n").to_numpy()
    _set_languages(model, known, counts)
    model.thresholds = np.zeros(len(known) + 1)
    left = [total[label] - sum(c[1] == label for c in chosen) for label in (0, 1)]
    if min(left):
        own = own.join(F.broadcast(ids.select("id")), "id", "left_anti")
    else:
        left = total
    bins = np.zeros((len(known) + 1, 2, 2 * RANGE * BINS))
    schema = T.StructType([rows.schema["id"], *T.StructType.fromDDL("guess int, bin int").fields])
    binned = rows.where("id IS NOT NULL").select("id", "text").mapInArrow(tidy(_binner(spark.sparkContext.broadcast(model))), schema)
    for r in binned.join(own.select("id", "label"), "id").groupBy("guess", "label", "bin").agg(F.count("*").alias("n")).collect():
        bins[r.guess, r.label, r.bin] = r.n
    _set_thresholds(model, bins, (total[0] / left[0]) / (total[1] / left[1]))
    return model


def toxicity(text: Column | str, model: Model, spark) -> Column:
    """The score of a text column, from 0 to 1; toxic from 0.5 on. The model is of fixed size and travels once to every executor."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        scores = pa.array(predict(shared.value, texts.cast(pa.binary())), pa.float64())
        release()
        return scores

    return scored(text)
