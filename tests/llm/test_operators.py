"""Every operator against a brute-force version, and on nulls, empties, ties, repeats and clashing columns."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import zstandard
from pyspark.sql import functions as F

from tableprobe.llm import bpe, common, exchange, langid, lm, mixing, near_dup, quality, queries, suffix_dedup, topk, toxicity, url_filter
from tableprobe.llm.common import prepare

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Columns named like internal ones must not get in the way.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, key string, row string, block int, size string, replies int"


def words_of(text):
    return (text or "").encode().translate(LOWER).split()


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(3)
    vocabulary = ["".join(rnd.choice("abcdeéß") for _ in range(rnd.randint(2, 8))) for _ in range(300)]
    base = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(30, 200))) for _ in range(25)]
    passage = " ".join(rnd.choice(vocabulary) for _ in range(60))
    out = list(base)
    for text in base[:12]:
        for _ in range(3):
            w = text.split()
            for _ in range(rnd.randint(0, 6)):
                w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
            out.append(" ".join(w))
    out += [base[0].upper().replace("É", "é"), base[1], base[1], passage, base[2] + " " + passage, base[3] + "\n" + passage, "x" * 5000]
    out += [None, "", " \n\t", "one two", "one two", "ONE  two", "one two three four", "aaaa " * 100, "日本語 " * 80, "\x0b\x0c\r a\u00a0b"]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    prepare(spark)
    rows = [(i, t, ["en", "de", None][i % 3], ["b", "a", None, "é"][i % 4], len(t or ""), "n", "k", "r", i, "s", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture()
def small_blocks(monkeypatch):
    monkeypatch.setattr(exchange, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(exchange, "BUCKET_NAMES", 500)


# names on the wire ------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 1000])
@pytest.mark.parametrize("shift", [0, 20, 45])
def test_names_survive_packing(n, shift):
    names = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64) >> np.uint64(shift))
    assert (exchange.unpack_names(exchange.pack_names(names)) == names).all()
    counts = np.arange(n, dtype=np.int64) * 3
    assert (exchange.unpack_counts(exchange.pack_counts(counts), n) == counts).all()


# top-k ------------------------------------------------------------------------------------


def test_nearest_codes_are_exact(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 100)
    monkeypatch.setattr(topk, "QUERIES", 10)
    rnd = np.random.default_rng(1)
    centres = rnd.normal(size=(5, 48))
    vectors = [(i, [float(x) for x in centres[i % 5] + rnd.normal(size=48) * 0.5]) for i in range(300)]
    vectors += [(301, None), (None, vectors[0][1]), (20, vectors[7][1]), (302, [float("nan")] * 48)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    found = topk.nearest_codes(df, F.col("vec_id") % 20 == 0, k=7).collect()
    codes = [(i, np.array(v, np.float32) >= 0) for i, v in vectors if i is not None and v is not None]
    want = []
    by_query = collections.defaultdict(list)
    for q, c in codes:
        if q % 20 == 0:
            by_query[q] += sorted(((int((c != o).sum()), i) for i, o in codes))[:7]
    for q, best in by_query.items():
        want += [(q, i, d, k + 1) for k, (d, i) in enumerate(sorted(best)[:7])]
    assert sorted((r.query_id, r.neighbor_id, r.distance, r.rank) for r in found) == sorted(want)


def test_nearest_codes_of_nothing(spark):
    assert topk.nearest_codes(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0


# byte-level BPE ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def encoders():
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    own = bpe.Encoder(ranks, public_tokenizers.PATTERN)
    return own, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_tree_encoding_equals_the_library(encoders, monkeypatch):
    own, library = encoders
    monkeypatch.setattr(bpe, "LEAF_TEXT", 6)
    monkeypatch.setattr(bpe, "LEAF_BYTES", 5)
    monkeypatch.setattr(bpe, "SEAM", 2)
    rnd = random.Random(1)
    parts = [" ", "  ", "\n", "\t", "a", "the", "ing", "é", "ß", "1", "23", "'re", "'s", "'", "!", "...", "\u00a0", "\x1c", "\x85", "日本", "🙂", "aaaa", "\r\n"]
    for _ in range(3000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40)))
        ids = own.encode(text)
        assert ids == library.encode_ordinary(text), text
        assert own.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["a" * 20000, "ab" * 9000, " " * 3000 + "x", "日本語" * 3000, "é" * 3000])
def test_long_runs(encoders, text):
    own, library = encoders
    assert own.encode(text) == library.encode_ordinary(text)


def test_every_token_is_its_own_encoding(encoders):
    own, _ = encoders
    assert all(own.merge(token) == [rank] for token, rank in own.ranks.items())


def test_bpe_columns(spark, docs, texts, empty, encoders):
    own = queries.tokenizer(spark)
    coded = docs.select("doc_id", own.encode("text").alias("ids")).select("doc_id", "ids", own.decode("ids").alias("d"))
    for r in coded.collect():
        text = texts[r.doc_id] or ""
        assert (r.ids, bytes(r.d)) == (encoders[1].encode_ordinary(text), text.encode())
    assert empty.select(own.encode("text")).count() == 0
    odd = spark.createDataFrame([([1, 99999999],), (None,), ([],), ([None],)], "ids array<int>").select(own.decode("ids").alias("d"))
    assert [r.d if r.d is None else bytes(r.d) for r in odd.collect()] == [None, None, b"", None]


# language ----------------------------------------------------------------------------------


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    told = queries.QUERIES["op3_language_mixture"](spark, "/root/testdata/sf0.01").join(docs, "doc_id")
    held = told.where("held_out")
    assert held.where("lang = lang_pred").count() / held.count() > 0.95
    assert told.where("score < 0 OR score > 1").count() == 0


def test_language_of_mixtures_and_odd_texts(spark, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    names, model = langid.train_languages(docs)
    some = {lang: " ".join(r.text for r in docs.where(F.col("lang") == lang).orderBy("doc_id").limit(5).collect())[:3000] for lang in ("en", "de")}
    rows = [(0, some["en"] + " " + some["de"]), (1, None), (2, ""), (3, "12 34 !"), (4, "a"), (5, some["de"] * 20)]
    df = spark.createDataFrame(rows, "id int, text string")
    got = {r.id: r.p for r in df.select("id", langid.language(F.col("text"), names, model, spark).alias("p")).collect()}
    assert {"en", "de"} <= set(got[0].shares) and abs(got[0].shares["en"] - 0.5) < 0.1
    assert [got[i].lang for i in (1, 2, 3)] == ["und"] * 3 and got[1].score == 0.0
    assert got[4].lang in names and got[5].lang == "de"
    none, blank = langid.train_languages(empty)
    assert df.select(langid.language(F.col("text"), none, blank, spark).lang.alias("l")).where("l <> 'und'").count() == 0


# toxicity ----------------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    scored = queries.QUERIES["op4_toxicity_cnn"](spark, "/root/testdata/sf0.1")
    labelled = scored.join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").toPandas()
    hit = ((labelled.predicted == 1) & (labelled.toxic == 1)).sum()
    # a fifth to a quarter of the toxic labels of this table stand on texts without any toxic word
    assert hit / (labelled.toxic == 1).sum() > 0.65 and hit / (labelled.predicted == 1).sum() > 0.9
    assert labelled.score.between(0, 1).all()


def test_toxicity_without_both_kinds(spark, docs, empty):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.train_toxicity(docs, labels, F.lit(True)).constant == 0.0
    ones = spark.createDataFrame([(0, 1), (1, 1), (None, 0), (2, None)], "doc_id long, toxic int")
    assert toxicity.train_toxicity(docs, ones, F.lit(True)).constant == 1.0
    assert toxicity.train_toxicity(empty, ones, F.lit(True)).constant == 0.0


def test_toxicity_of_odd_texts(spark):
    rows = [(i, "you idiot " + "word " * 30 if i % 2 else "some word " * 20, "en" if i % 2 else None) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = toxicity.train_toxicity(docs, docs.select("doc_id", (F.col("doc_id") % 2).alias("toxic")), F.lit(True))
    scores = toxicity.predict(model, pa.array([None, "", "some word", "an idiot", "word " * 50000 + "idiot"]))
    assert (scores[:2] == 0).all() and (scores[:3] < 0.5).all() and (scores[3:] >= 0.5).all()


def test_thresholds_cover_all_labelled_rows(spark, monkeypatch):
    """A few rows are fitted on; all others, long ones too, make a threshold for every language."""
    monkeypatch.setattr(toxicity, "POSITIVES", 60)
    monkeypatch.setattr(toxicity, "NEGATIVES", 60)
    monkeypatch.setattr(toxicity, "LONGEST", 500)
    seen = []
    known = toxicity._threshold
    monkeypatch.setattr(toxicity, "_threshold", lambda *a: seen.append(np.asarray(a[0])) or known(*a))
    words = {"en": "the cat", "xx": "ba bo", "yy": "zu zi"}
    rows = [(i, f"{words[lang]} {'idiot ' if i % 4 == 0 else 'nice '}" * (3 if i % 8 < 4 else 40), lang) for i in range(600) for lang in ["en" if i < 540 else "xx" if i < 580 else "yy"]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)], "doc_id long, toxic int")
    model = toxicity.train_toxicity(docs, labels, F.lit(True))
    assert model.languages == ["en", "xx", "yy"]
    assert len(seen) == 4 and seen[-1][1].sum() == 90  # 150 toxic rows, 60 fitted on
    scores = toxicity.predict(model, pa.array([t for _, t, _ in rows]))
    assert ((scores >= 0.5) == (np.arange(600) % 4 == 0)).mean() > 0.97


def test_repeated_ids_do_not_widen_the_sample(spark, monkeypatch):
    """Ten ids stand for two thousand rows; one row of each reaches the driver, and ids may be text."""
    monkeypatch.setattr(toxicity, "POSITIVES", 5)
    monkeypatch.setattr(toxicity, "NEGATIVES", 5)
    seen = []
    known = toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda *a: seen.append(len(a[2])) or known(*a))
    rows = [(f"d{i % 20}", "you idiot" if i % 2 else "some word", "en") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, lang string")
    labels = docs.select("doc_id", F.col("text").contains("idiot").cast("int").alias("toxic"))
    model = toxicity.train_toxicity(docs, labels, F.lit(True))
    assert seen == [10]
    assert (toxicity.predict(model, pa.array(["you idiot", "some word"])) >= 0.5).tolist() == [True, False]


def test_the_sample_is_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 4000)
    seen = []
    known = toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda *a: seen.append(len(a[2])) or known(*a))
    docs = spark.createDataFrame([(i, ("idiot " if i % 2 else "words ") * 50) for i in range(100)], "doc_id long, text string")
    toxicity.train_toxicity(docs, docs.select("doc_id", (F.col("doc_id") % 2).alias("toxic")), F.lit(True))
    assert seen == [12]  # 2,000 bytes of either kind hold six texts of 300


def test_thresholds_are_those_of_scored_rows(spark, monkeypatch):
    """Thresholds against a search over the stored scores of all labelled rows."""
    monkeypatch.setattr(toxicity, "POSITIVES", 40)
    monkeypatch.setattr(toxicity, "NEGATIVES", 40)
    monkeypatch.setattr(toxicity, "PRIOR", 0)
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choice(["idiot", "ugly"] if i % 3 == 0 and rnd.random() < 0.5 else ["good", "word", "ugly"]) for _ in range(rnd.randint(1, 6))), "en") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(400)], "doc_id long, toxic int")
    fitted = []
    known = toxicity._sampled
    monkeypatch.setattr(toxicity, "_sampled", lambda *a: fitted.extend(known(*a)) or fitted)
    model = toxicity.train_toxicity(docs, labels, F.lit(True))
    left = [(t, int(i % 3 == 0)) for i, t, _ in rows if i not in {f[0] for f in fitted}]
    words, first = toxicity.features(pa.array([t for t, _ in left]))
    score, label = toxicity.logits(model, words, first), np.array([y for _, y in left])
    total = [sum(i % 3 != 0 for i in range(400)), sum(i % 3 == 0 for i in range(400))]
    weight = np.where(label == 1, 1.0, (total[0] / (label == 0).sum()) / (total[1] / (label == 1).sum()))

    def f1(t):
        above = toxicity._bin(score) / toxicity.BINS - toxicity.RANGE >= t
        return 2 * weight[above & (label == 1)].sum() / max(weight[above].sum() + weight[label == 1].sum(), 1e-9)

    best = max(f1(t) for t in np.unique(toxicity._bin(score)) / toxicity.BINS - toxicity.RANGE)
    assert f1(model.thresholds[0]) == pytest.approx(best)


def test_scores_do_not_depend_on_the_pieces():
    rnd = np.random.default_rng(2)
    texts = pa.array(["a b c " * int(n) if n else None for n in rnd.integers(0, 50, 40)])
    found = list(common.pieces(texts.cast(pa.binary()), 100))
    assert [at for at, _ in found] == np.cumsum([0, *(len(s) for _, s in found)])[:-1].tolist() and pa.concat_arrays([s for _, s in found]) == texts.cast(pa.binary())
    assert list(common.pieces(pa.array([], pa.binary()))) == []


def test_filters_stay_within_texts():
    random_ = np.random.default_rng(2)
    model = toxicity.Model(
        embeddings=random_.normal(size=(3, toxicity.BUCKETS, toxicity.SIZE)).astype(np.float32),
        filters=[random_.normal(size=(w, toxicity.SIZE, toxicity.FILTERS)).astype(np.float32) for w in toxicity.WIDTHS],
        biases=[random_.normal(size=toxicity.FILTERS).astype(np.float32) for _ in toxicity.WIDTHS],
        out=random_.normal(size=toxicity.FILTERS * len(toxicity.WIDTHS)).astype(np.float32),
    )
    texts = ["a b c d", "e", None, "f g", "h i j"]
    together = toxicity.logits(model, *toxicity.features(pa.array(texts)))
    alone = [toxicity.logits(model, *toxicity.features(pa.array([t], pa.string())))[0] for t in texts]
    assert np.allclose(together, alone, atol=1e-4)


# urls --------------------------------------------------------------------------------------


def test_url_rules_and_reputation(spark):
    urls = ["http://A.Example.org/es/1", "https://example.org/en/12?x#y", "http://x.org", "ftp://shop.com/de/", "http://notexample.com/fr/a", None, "nothing", "://q/p://z", "http://bad.net/1"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(100 + i, "http://bad.net/x") for i in range(60)], "page_id int, url string")
    outcome = F.when(F.col("url").contains("bad.net/x"), 1).when(F.col("page_id").isin(0, 1, 2), 0)
    got = {r.row.page_id: r for r in url_filter.judge_urls(df, outcome, queries.URL_RULES).collect()}
    assert len(got) == df.count()
    assert (got[0].url_parts.host, got[0].url_parts.path, got[0].judged.rule, got[0].judged.verdict) == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert got[1].judged.rule == "example.org/en/1" and got[1].url_parts.path == "/en/12"
    assert (got[2].url_parts.path, got[2].judged.rule, got[2].judged.verdict) == ("", None, "allow")
    assert (got[3].judged.rule, got[4].judged.rule) == ("com/de/", "com/fr/")
    assert all((got[i].url_parts.host, got[i].url_parts.path) == ("", "") for i in (5, 6))
    assert (got[7].url_parts.host, got[7].url_parts.path) == ("q", "/p://z")
    assert got[8].judged.verdict == "block" and got[8].judged.rate > 0.9
    assert url_filter.judge_urls(df.limit(0), outcome, queries.URL_RULES).count() == 0


# mixing ------------------------------------------------------------------------------------


def brute_targets(totals, most=3.0):
    """Share by weight; whoever is above the limit stops there and the rest is shared again."""
    order = sorted(totals, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(totals.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if level * weight[s] > most * totals[s]}
        if not above:
            target.update({s: level * weight[s] for s in open_})
            break
        for s in above:
            target[s] = most * totals[s]
            left -= target[s]
        open_ -= above
    return target


def test_mix_meets_targets(spark, docs, texts, monkeypatch):
    monkeypatch.setattr(mixing, "_BIN", 3)
    weights = spark.createDataFrame([(i, float(i % 4)) for i in range(40)] + [(41, None)], "id long, weight double")
    first = mixing.mix_sources(docs, weights).collect()
    assert sorted(first, key=lambda r: r.doc_id) == sorted(mixing.mix_sources(docs.repartition(3), weights).collect(), key=lambda r: r.doc_id)
    totals = collections.Counter()
    for r in first:
        assert r.size == len((texts[r.doc_id] or "").encode().split())
        totals[r.source] += r.size
    want = brute_targets(totals)
    taken = collections.Counter()
    for r in first:
        assert r.source_size == totals[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-9)
        assert r.taken == r.epochs * r.size <= 3 * r.size
        taken[r.source] += r.taken
    largest = max(r.size for r in first)
    assert all(abs(taken[s] - want[s]) <= largest / 2 + 1 for s in totals)
    for s in totals:
        epochs = {r.epochs for r in first if r.source == s and r.size}
        assert max(epochs) - min(epochs) <= 1


def test_mix_of_nothing(empty):
    assert mixing.mix_sources(empty).count() == 0


# suffixes ----------------------------------------------------------------------------------


def brute_repeats(rows, size):
    seen, out = set(), {}
    for i, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - size + 1):
            window = data[k : k + size]
            if window in seen:
                gone[k : k + size] = b"\1" * size
            seen.add(window)
        out[i] = data, bytes(gone)
    return out


@pytest.mark.parametrize("size", [100, 20, 3, 1])
def test_repeats_are_removed(docs, texts, size, small_blocks):
    assert all({(a - b) % v for a in d for b in d} == set(range(v)) for v, d in suffix_dedup.COVERS.items())
    want = brute_repeats(list(enumerate(texts)), size)
    found = suffix_dedup.remove_repeats(docs, size=size).collect()
    assert len(found) == len(texts)
    for r in found:
        data, gone = want[r.row.doc_id]
        assert bytes(r.kept) == bytes(x for x, g in zip(data, gone) if not g)
        assert (r.n_bytes, r.n_removed) == (len(data), sum(gone)) and r.row.node == "n"
        runs = [(x.start, x.end) for x in r.removed]
        assert bytes(any(a <= i < b for a, b in runs) for i in range(len(data))) == gone
        assert all(b < c for (_, b), (c, _) in zip(runs, runs[1:]))


def test_repeated_and_null_ids(spark, small_blocks):
    rnd = random.Random(9)
    text = "".join(rnd.choice("abcdef ") for _ in range(300))
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (0, None)], "doc_id long, text string")
    got = sorted((r.row.doc_id is not None, r.row.doc_id or 0, r.n_removed) for r in suffix_dedup.remove_repeats(df).collect())
    assert got == [(False, 0, 0), (True, 0, 0), (True, 1, 300), (True, 1, 300)]


def test_no_documents_to_cut(empty):
    assert suffix_dedup.remove_repeats(empty).count() == 0


# quality -----------------------------------------------------------------------------------


def test_quality_measures(spark, docs, texts, empty):
    lines = "a b\na b\n\n\nc\n a b\na b\n"
    extra = spark.createDataFrame([(1000, lines), (1001, "#*$ %&|<> " * 30), (1002, hashlib.sha512(b"x").hexdigest() * 1)], "doc_id long, text string")
    all_texts = dict(enumerate(texts)) | {1000: lines, 1001: "#*$ %&|<> " * 30, 1002: hashlib.sha512(b"x").hexdigest()}
    got = docs.select("doc_id", "text").unionByName(extra).select("doc_id", quality.quality("text").alias("q")).collect()
    for r in got:
        text = all_texts[r.doc_id] or ""
        data, q = text.encode(), r.q
        words = data.split()
        windows = collections.defaultdict(list)
        for i in range(len(words) - 7):
            windows[tuple(words[i : i + 8])].append(i)
        covered = {i + j for at in windows.values() if len(at) > 1 for i in at for j in range(8)}
        seen, repeats = set(), 0
        for line in data.split(b"\n"):
            if line.split():
                repeats += line in seen
                seen.add(line)
        assert q.n_words == len(words) and q.word_chars == sum(len(w.decode()) for w in words)
        assert q.n_symbols == sum(text.count(c) for c in "#*$%&|<>")
        assert (q.n_dup_lines, q.n_repeat_words) == (repeats, len(covered))
        failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
        assert q.base_failed == failed and not (failed and q.kept)
        if data:
            assert math.isclose(q.ratio, len(data) / len(zstandard.ZstdCompressor(level=3).compress(data)))
    assert empty.select(quality.quality("text")).count() == 0


def test_bands():
    rnd = random.Random(4)
    compress = zstandard.ZstdCompressor(level=3).compress
    vocabulary = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 9))) for _ in range(2000)]
    clean = " ".join(rnd.choice(vocabulary) for _ in range(1500)).encode()
    noise = " ".join("".join(chr(rnd.randint(33, 0x2FF)) for _ in range(9)) for _ in range(500)).encode()
    repetitive = b" ".join(b"a%d the same words but one" % i for i in range(2000))
    assert [quality.measure(x, compress)[7] for x in (clean, noise, repetitive)] == [None, "incompressible", "repetitive"]


# near duplicates ----------------------------------------------------------------------------


def brute_components(rows, percent=75):
    sets = {}
    for i, text in rows:
        w = words_of(text)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = top(a), top(b)
                    up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in sets}


@pytest.mark.parametrize("small", [64, 3])
def test_near_duplicates(docs, texts, small, monkeypatch):
    """With 3 classes to a node, groups are large nodes and go through all branches."""
    monkeypatch.setattr(near_dup, "SMALL", small)
    want = brute_components(list(enumerate(texts)))
    for r in near_dup.near_duplicates(docs).collect():
        assert (r.n_shingles, r.component_id) == want[r.doc_id], r
        assert r.kept == (r.doc_id == r.component_id)


def test_near_duplicates_of_odd_rows(spark, empty):
    assert near_dup.near_duplicates(empty).count() == 0
    rows = [(3, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (1, "A B C D E F"), (2, None), (4, "")]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [
        (False, 1, 1, True), (False, 2, 2, True), (False, 3, 1, False), (False, 3, 1, False), (False, 4, 4, True), (True, 0, 0, True)
    ]


@pytest.mark.parametrize("whole", [512, 80])
def test_near_duplicates_among_shared_boilerplate(spark, monkeypatch, whole):
    """Texts that share 0.70 of their shingles are not linked, and hide pairs of 0.78; exhaustively, and by branching on."""
    monkeypatch.setattr(near_dup, "WHOLE", whole, raising=False)
    prepare(spark)
    shared = " ".join(f"s{j}" for j in range(204))

    def text(i):
        own, both = (f"p{i}", f"q{i // 2}") if i < 80 else (f"p{i}", f"r{i}")
        return " ".join([shared, *(f"{both}x{j}" for j in range(15)), *(f"{own}x{j}" for j in range(27))])

    rows = [(i, text(i)) for i in range(400)]
    shingles = [set(zip(*(t.split()[k:] for k in range(5)))) for _, t in rows]
    jaccard = lambda a, b: len(a & b) / len(a | b)
    assert jaccard(shingles[0], shingles[2]) < 0.72 and 0.76 < jaccard(shingles[0], shingles[1]) < 0.8
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    wrong = [r.doc_id for r in got if r.component_id != (r.doc_id // 2 * 2 if r.doc_id < 80 else r.doc_id)]
    assert wrong == []


def framed(n, pairs):
    """Texts that share 0.70 of their shingles; the first `pairs` pairs share 0.78."""
    shared = " ".join(f"s{j}" for j in range(204))

    def text(i):
        own, both = (f"p{i}", f"q{i // 2}") if i < 2 * pairs else (f"p{i}", f"r{i}")
        return " ".join([shared, *(f"{both}x{j}" for j in range(15)), *(f"{own}x{j}" for j in range(27))])

    return [(i, text(i)) for i in range(n)]


def test_alike_texts_grow_in_line(spark, monkeypatch):
    """Four times the unlinked texts of one frame make some four times the rows of every step, not sixteen times; and no planted pair is missed."""
    prepare(spark)
    known = near_dup.saved
    totals = {}
    for n in (300, 600, 1200):
        rows = collections.Counter()

        def counted(df, label):
            out = known(df, label)
            rows[label] += out.count()
            return out

        monkeypatch.setattr(near_dup, "saved", counted)
        got = near_dup.near_duplicates(spark.createDataFrame(framed(n, 40), "doc_id long, text string").repartition(4)).collect()
        assert [r.doc_id for r in got if r.component_id != (r.doc_id // 2 * 2 if r.doc_id < 80 else r.doc_id)] == []
        totals[n] = sum(rows.values())
    assert totals[1200] < 6 * totals[300] and totals[1200] < 2.6 * totals[600]


@pytest.mark.parametrize("names", [1 << 20, 9000])
def test_recall_in_a_large_family(spark, monkeypatch, names):
    """A chain of edits: 700 classes of one family, linked and unlinked ones, against all pairs; also where groups are cut by their shingles."""
    monkeypatch.setattr(near_dup, "NAMES", names)
    prepare(spark)
    rnd = random.Random(8)
    frame = [f"w{j}" for j in range(150)]
    rows = []
    for i in range(700):
        words = list(frame)
        for _ in range(rnd.choice([1, 3, 5, 7, 9, 12])):
            words[rnd.randrange(150)] = f"v{rnd.randrange(10_000)}"
        rows.append((i, " ".join(words)))
    want = brute_components(rows)
    assert 2 < len({top for _, top in want.values()}) < 690
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sum(r.component_id != want[r.doc_id][1] for r in got) == 0


def test_names_in_common(monkeypatch):
    monkeypatch.setattr(near_dup, "_COLUMNS", 3)
    monkeypatch.setattr(near_dup, "_ROWS", 2)
    rnd = np.random.default_rng(3)
    sets = [np.unique(rnd.integers(0, 40, n).astype(np.uint64)) for n in (1, 5, 20, 60, 3, 200)]
    found = list(near_dup._in_common(sets, np.array([4, 0, 3])))
    assert [part.tolist() for part, _ in found] == [[4, 0], [3]]
    got = np.concatenate([common for _, common in found])
    assert got.tolist() == [[len(np.intersect1d(sets[i], x)) for x in sets] for i in (4, 0, 3)]


# language model -----------------------------------------------------------------------------


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores(docs, texts, order, small_blocks, monkeypatch):
    weights = {}
    fit = lm.fit_weights
    monkeypatch.setattr(lm, "fit_weights", lambda *a: weights.setdefault("w", fit(*a)))
    found = lm.score_texts(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0, order=order).collect()
    tokens = {i: [*words_of(t), None] for i, t in enumerate(texts)}
    counts, contexts = collections.Counter(), collections.Counter()
    for i, t in tokens.items():
        if zlib.crc32(str(i).encode()) % 10:
            t = ["<s>"] * (order - 1) + t
            for at in range(order - 1, len(t)):
                for k in range(1, order + 1):
                    counts[tuple(t[at - k + 1 : at + 1])] += 1
                    contexts[tuple(t[at - k + 1 : at])] += 1
    n, v = contexts[()], sum(len(g) == 1 for g in counts)
    assert len(found) == len(texts)
    for r in found:
        t = ["<s>"] * (order - 1) + tokens[r.row.doc_id]
        base = score = 0.0
        for at in range(order - 1, len(t)):
            base += math.log10((counts[(t[at],)] + 0.1) / (n + 0.1 * (v + 1)))
            p = 1 / (v + 1)
            for k in range(1, order + 1):
                above = contexts[tuple(t[at - k + 1 : at])]
                w = weights["w"][k - 1][min(31, 1 + int(math.log2(above))) if above else 0]
                p = w * (counts[tuple(t[at - k + 1 : at + 1])] / above if above else 0) + (1 - w) * p
            score += math.log10(p)
        assert (r.n_tokens, r.train_tokens) == (len(tokens[r.row.doc_id]), n)
        assert r.n_known == sum(counts[(w,)] > 0 for w in tokens[r.row.doc_id])
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-9)


def test_weights_are_those_of_the_data():
    """Cells drawn from a known mixture give its weight back."""
    # estimates of 1/2 and 1/1024 for orders 2 and 1; unknown 0
    cells = np.array([(5 << 6 | 21) << 11 | (3 << 6 | 3), (5 << 6 | 21) << 11 | (3 << 6 | 0)])
    weights = lm.fit_weights(cells, np.array([300_000.0, 700_000.0]), 2, 1e-12)
    assert abs(weights[1, 3] - 0.3) < 0.01 and weights[1, 0] == 0


def test_scores_without_training_rows(docs, empty, small_blocks):
    assert all(r.score == 0 and r.n_known == 0 for r in lm.score_texts(docs, F.lit(False)).collect())
    assert lm.score_texts(empty, F.lit(True)).count() == 0
