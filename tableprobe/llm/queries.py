"""The queries of this folder's operators over the tables of `sf_dir`, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tableprobe.llm import bpe, langid, lm, merkle, mixing, near_dup, pii, quality, suffix_dedup, topk, toxicity, url_filter, variants
from tableprobe.llm.common import prepare

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = lambda spark, sf_dir: function(prepare(spark), sf_dir)
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return register


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(of: int):
    """The remainder of crc32(doc_id as text); null without an id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % of


@_query(
    """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x >= 0) AS bits FROM embeddings),
    pairs AS (SELECT q.vec_id AS query_id, e.vec_id AS neighbor_id,
        CAST(list_sum(list_transform(range(1, len(e.bits) + 1), lambda i: CAST(e.bits[i] <> q.bits[i] AS INT))) AS BIGINT) AS distance
      FROM e, e AS q WHERE q.vec_id % 20 = 0),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM pairs)
    SELECT * FROM ranked WHERE rank <= 10"""
)
def op1_exact_topk(spark, d):
    vectors = _read(spark, d, "embeddings")
    return topk.nearest_codes(vectors, F.col("vec_id") % 20 == 0, k=10)


def tokenizer(spark: SparkSession, ranks: str = "byte_bpe_50k.tiktoken") -> bpe.Tokenizer:
    return bpe.Tokenizer(spark, public_tokenizers.path(ranks), public_tokenizers.PATTERN)


def digests(ids) -> list:
    return [F.size(ids).cast("long").alias("n_tokens"), F.sha2(F.array_join(ids.cast("array<string>"), " "), 256).alias("ids_sha256")]


@_query()
def op2_byte_bpe(spark, d):
    own = tokenizer(spark)
    coded = _read(spark, d, "documents").select("doc_id", own.encode("text").alias("ids"))
    coded = coded.select("doc_id", "ids", own.decode("ids").alias("decoded"))
    return coded.select("doc_id", *digests(F.col("ids")), F.sha2("decoded", 256).alias("decoded_sha256"))


@_query()
def op3_language_mixture(spark, d):
    docs = _read(spark, d, "documents")
    languages, model = langid.train_languages(docs.where(fold(4) != 2))
    told = docs.select("doc_id", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"), langid.language(F.col("text"), languages, model, spark).alias("told"))
    return told.select("doc_id", "held_out", F.col("told.lang").alias("lang_pred"), F.col("told.score").alias("score"))


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    return toxicity.train_toxicity(docs, labels, fold(5) != 0)


@_query()
def op4_toxicity_cnn(spark, d):
    docs = _read(spark, d, "documents")
    model = toxicity_model(docs, _read(spark, d, "labels"))
    scored = docs.select("doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), toxicity.toxicity(F.col("text"), model, spark).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


#: The rules, as (verdict, host, path).
URL_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

_LEVEL = """{name}_m AS (SELECT CASE WHEN count(*) < 2 OR any_value(rate) IN (0, 1) THEN 10.0 ELSE 1 / least(greatest(
      ((sum(CAST(k AS DOUBLE) * k / n) - sum(n) * any_value(rate) * any_value(rate)) - (count(*) - 1) * any_value(rate) * (1 - any_value(rate)))
      / (any_value(rate) * (1 - any_value(rate)) * (sum(n) - sum(CAST(n AS DOUBLE) * n) / sum(n) - (count(*) - 1))), 0.001), 0.999) - 1 END AS m
    FROM {name}, whole)"""


@_query(
    f"""WITH parts AS (SELECT page_id,
        translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
    rules(outcome, rh, rp) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
        ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
    fit AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(outcome, length(rh || rp)) AS outcome
      FROM parts, rules WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id),
    p AS (SELECT parts.*, rule, outcome FROM parts LEFT JOIN fit USING (page_id)),
    hosts AS (SELECT host, count(*) AS n, sum(CASE WHEN outcome = 'block' THEN 1 ELSE 0 END) AS k,
        array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS domain, string_split(host, '.')[-1] AS suffix
      FROM p WHERE outcome IS NOT NULL GROUP BY host),
    domains AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY ALL),
    suffixes AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM domains GROUP BY ALL),
    whole AS (SELECT coalesce(sum(k) / sum(n), 0.0) AS rate FROM suffixes),
    {_LEVEL.format(name="suffixes")}, {_LEVEL.format(name="domains")}, {_LEVEL.format(name="hosts")},
    s AS (SELECT suffix, (m * rate + k) / (m + n) AS r FROM suffixes, suffixes_m, whole),
    dd AS (SELECT domain, (m * s.r + k) / (m + n) AS r FROM domains JOIN s USING (suffix), domains_m),
    seen AS (SELECT DISTINCT host, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS domain,
        string_split(host, '.')[-1] AS suffix FROM p),
    h AS (SELECT seen.host, coalesce(hosts.n, 0) AS n, hosts_m.m AS m,
        (hosts_m.m * coalesce(dd.r, s.r, rate) + coalesce(hosts.k, 0)) / (hosts_m.m + coalesce(hosts.n, 0)) AS r
      FROM seen LEFT JOIN hosts USING (host) LEFT JOIN dd ON seen.domain = dd.domain LEFT JOIN s ON seen.suffix = s.suffix, hosts_m, whole)
    SELECT page_id, host, path, rule, coalesce(outcome,
      CASE WHEN r - 1.645 * sqrt(r * (1 - r) / (m + n + 1)) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
    FROM p JOIN h USING (host)"""
)
def op5_host_reputation(spark, d):
    pages = _read(spark, d, "pages").select("page_id", "url")
    # the rules' own verdicts are the labelled outcomes
    _, told = url_filter.rule_for(url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url")), URL_RULES)
    outcome = F.when(told == "block", 1).when(told == "allow", 0)
    judged = url_filter.judge_urls(pages, outcome, URL_RULES)
    return judged.select("row.page_id", "url_parts.host", "url_parts.path", "judged.rule", "judged.verdict")


def quality_weights(labels: DataFrame) -> DataFrame:
    """Labelled quality as sampling weights: 2 for good, 0.5 for poor, the mean in between."""
    return labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg((0.5 + 1.5 * F.avg("quality")).alias("weight"))


@_query(
    r"""WITH q AS (SELECT doc_id, 0.5 + 1.5 * avg(quality) AS weight FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
    r AS (SELECT d.doc_id, source, coalesce(length(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
        -ln((CAST(CAST('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0)
          / CASE WHEN weight > 0 THEN least(greatest(weight, 0.1), 10.0) ELSE 1.0 END AS key
      FROM documents d LEFT JOIN q ON d.doc_id = q.doc_id),
    s AS (SELECT source, sum(size) AS total, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
      FROM r GROUP BY source),
    l AS (SELECT *, ((SELECT sum(total) FROM s) - coalesce(sum(3.0 * total) OVER (ORDER BY 3.0 * total / weight, source NULLS LAST
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
        / sum(weight) OVER (ORDER BY 3.0 * total / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s),
    t AS (SELECT source, total, least(3.0 * total, (SELECT max(level) FROM l) * weight) AS target FROM l),
    e AS (SELECT *, CASE WHEN total > 0 THEN floor(target / total + 1e-9) ELSE 0 END AS epochs FROM t),
    b AS (SELECT r.doc_id, size, total, target, epochs, greatest(target - epochs * total, 0.0) AS rest,
        coalesce(sum(size) OVER (PARTITION BY r.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM r JOIN e ON r.source IS NOT DISTINCT FROM e.source)
    SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(total AS BIGINT) AS source_size, CAST(target AS DOUBLE) AS target,
      CAST(CASE WHEN size = 0 THEN 0 ELSE size * (epochs + CASE WHEN before < rest AND (before + size <= rest
        OR before + size - rest < rest - before) THEN 1 ELSE 0 END) END AS BIGINT) AS taken FROM b"""
)
def op6_source_mix(spark, d):
    mixed = mixing.mix_sources(_read(spark, d, "documents"), quality_weights(_read(spark, d, "labels")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@_query()
def op7_suffix_dedup(spark, d):
    cut = suffix_dedup.remove_repeats(_read(spark, d, "documents").select("doc_id", "text"))
    return cut.select("row.doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@_query()
def op8_compression_bands(spark, d):
    measured = _read(spark, d, "documents").select("doc_id", quality.quality("text").alias("q"))
    return measured.select("doc_id", "q.*")


@_query(
    r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS words FROM documents),
    sh AS (SELECT DISTINCT doc_id, words[i:i + 4] AS shingle FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i
        FROM w WHERE len(words) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
    links AS (SELECT x.a, x.b FROM (SELECT s.doc_id AS a, t.doc_id AS b, count(*) AS c FROM sh s JOIN sh t ON s.shingle = t.shingle AND s.doc_id <> t.doc_id
        GROUP BY ALL) x JOIN n na ON na.doc_id = x.a JOIN n nb ON nb.doc_id = x.b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
    reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) AS component_id,
      d.doc_id <= coalesce(m.b, d.doc_id) AS kept
    FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS b FROM reach GROUP BY a) m USING (doc_id)"""
)
def op9_chosen_path(spark, d):
    return near_dup.near_duplicates(_read(spark, d, "documents"))


@_query()
def op10_deleted_interpolation(spark, d):
    docs = _read(spark, d, "documents").select("doc_id", "text")
    scored = lm.score_texts(docs, fold(10) != 0)
    held_out = F.coalesce(F.crc32(F.col("row.doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False)).alias("held_out")
    return scored.select("row.doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score")


#: The unsigned crc32 of a list of bytes, by the table of its polynomial (256 entries, made from the rule).
_CRC32 = """crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
      lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS crc_table)"""


def _crc32(byte_list: str) -> str:
    return f"""xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {byte_list}),
      lambda c, b: xor(c >> 8, crc_table[1 + (xor(c, b) & 255)])))"""


def _row_hash(*columns: str) -> str:
    parts = [f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in columns]
    return f"sha256({' || '.join(parts)})"


@_query(
    f"""WITH RECURSIVE {_CRC32},
    d AS (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || source, '-') AS g, {_row_hash("doc_id", "source", "lang", "n_chars", "text")} AS leaf,
        CASE WHEN {_crc32("list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))")} % 2 = 0
          THEN {_row_hash("doc_id", "source", "lang", "n_chars", "replace(text, chr(10), '')")} END AS altered FROM documents, crc),
    placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM d),
    up AS (SELECT 0 AS level, g, i, n, leaf AS hash FROM placed
      UNION ALL SELECT level + 1, g, i // 3, (n + 2) // 3, sha256(string_agg(hash, '' ORDER BY i)) FROM up WHERE n > 1 GROUP BY level, g, i // 3, n),
    tops AS (SELECT g, hash AS subroot, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM up WHERE n = 1),
    high AS (SELECT 0 AS level, '' AS g, i, n, subroot AS hash FROM tops
      UNION ALL SELECT level + 1, g, i // 3, (n + 2) // 3, sha256(string_agg(hash, '' ORDER BY i)) FROM high WHERE n > 1 GROUP BY level, g, i // 3, n),
    levels AS (SELECT g, max(level) AS depth FROM up GROUP BY g),
    steps AS (
      SELECT r, up.level, hash, i AS at FROM (SELECT r, g, i AS place, n AS leaves FROM placed) p JOIN up USING (g) WHERE up.i // 3 = p.place // CAST(3 ** (level + 1) AS BIGINT) AND n > 1
      UNION ALL SELECT r, depth + high.level, hash, high.i FROM placed p JOIN tops t USING (g) JOIN levels USING (g) JOIN high ON high.i // 3 = t.i // CAST(3 ** (high.level + 1) AS BIGINT) AND high.n > 1),
    own AS (
      SELECT r, up.level, up.i AS at FROM placed p JOIN up USING (g) WHERE up.i = p.i // CAST(3 ** level AS BIGINT) AND up.n > 1
      UNION ALL SELECT r, depth + high.level, high.i FROM placed p JOIN tops t USING (g) JOIN levels USING (g) JOIN high ON high.i = t.i // CAST(3 ** high.level AS BIGINT) AND high.n > 1),
    sides AS (SELECT r, level, coalesce(string_agg(hash, '' ORDER BY steps.at) FILTER (steps.at < own.at), '') AS l,
        coalesce(string_agg(hash, '' ORDER BY steps.at) FILTER (steps.at > own.at), '') AS x FROM steps JOIN own USING (r, level) GROUP BY r, level),
    proofs AS (SELECT r, sha256(string_agg(l || x, '' ORDER BY level)) AS proof, max(level) AS last FROM sides GROUP BY r),
    folded AS (SELECT r, 0 AS level, coalesce(altered, leaf) AS hash FROM d
      UNION ALL SELECT r, level + 1, sha256(l || hash || x) FROM folded JOIN sides USING (r, level)),
    ends AS (SELECT r, arg_max(hash, level) AS folded_root FROM folded GROUP BY r)
    SELECT doc_id, leaf, subroot, (SELECT hash FROM high WHERE n = 1) AS root, coalesce(proof, sha256('')) AS proof_sha256, folded_root,
      folded_root = (SELECT hash FROM high WHERE n = 1) AS verified FROM placed JOIN tops USING (g) JOIN ends USING (r) LEFT JOIN proofs USING (r)"""
)
def op11_merkle_manifest(spark, d):
    docs = _read(spark, d, "documents")
    odd_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0

    def leaf(text):
        return merkle.row_hash(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)

    cut = F.when(odd_out, leaf(F.replace("text", F.lit("\n"), F.lit(""))))
    rows = docs.select("doc_id", "source", leaf(F.col("text")).alias("whole"), cut.alias("tampered"))
    made = merkle.manifest(rows, F.col("source"), [F.col("doc_id")], F.col("whole"))
    proven = made.select(
        "row.doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(merkle.proof_text(F.col("path")), 256).alias("proof_sha256"),
        merkle.fold(F.coalesce("row.tampered", "leaf"), F.col("path")).alias("folded_root"),
    )
    return proven.withColumn("verified", F.col("folded_root") == F.col("root"))


_BYTES = """flatten(list_transform(string_split({}, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)]
      ELSE [CAST(192 + (unicode(x) >> 6) AS BIGINT), CAST(128 + (unicode(x) & 63) AS BIGINT)] END))"""


@_query(
    rf"""WITH RECURSIVE {_CRC32},
    runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run
      FROM documents),
    hashed AS (SELECT run, {_crc32(_BYTES.format("(CAST(doc_id AS VARCHAR) || ':' || run)"))} AS h FROM runs, crc WHERE length(run) >= 7),
    kept AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed),
    w AS (SELECT word, count(*) AS n FROM kept WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
    spread AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
    masks AS (SELECT word, n, substr(word, 1, i - 1) || '_' || substr(word, i + 1) AS k, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM spread),
    pairs AS (SELECT a.word, b.word AS other, b.n FROM masks a JOIN masks b ON a.k = b.k AND a.word <> b.word
      UNION SELECT m.word, w.word, w.n FROM masks m JOIN w ON m.less = w.word
      UNION SELECT w.word, m.word, m.n FROM masks m JOIN w ON m.less = w.word),
    best AS (SELECT word, count(*) AS n_near, max(n) AS most FROM pairs GROUP BY word),
    tied AS (SELECT p.word, min(other) AS other FROM pairs p JOIN best b ON p.word = b.word AND p.n = b.most GROUP BY p.word),
    formed AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 10 * w.n THEN other END AS form, CASE WHEN most >= 10 * w.n THEN most END AS form_n
      FROM w LEFT JOIN best USING (word) LEFT JOIN tied USING (word)),
    chain(word, root, step) AS (SELECT word, form, 1 FROM formed WHERE form IS NOT NULL
      UNION ALL SELECT c.word, f.form, step + 1 FROM chain c JOIN formed f ON c.root = f.word WHERE f.form IS NOT NULL),
    ends AS (SELECT word, arg_max(root, step) AS root FROM chain GROUP BY word)
    SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM formed LEFT JOIN ends USING (word)"""
)
def op12_spelling_variants(spark, d):
    docs = _read(spark, d, "documents")
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lowered = F.translate("text", capitals, capitals.lower())
    # shorter runs give no words of seven letters
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(lowered, F.lit("([a-zÀ-ÿ]{7,})"))).alias("run"))
    h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run")).cast("binary"))
    place = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.col("run").substr(F.lit(1), place), F.col("run").substr(place + 2, F.length("run")))
    words = runs.withColumn("h", h).select(F.when(F.col("h") % 31 == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= 7)
    counted = words.groupBy("word").agg(F.count("*").alias("n")).where("n >= 2")
    return variants.spelling_variants(counted, ratio=10).select("word", "form", "root", "n", "n_near", "form_n")


@_query()
def op13_personal_data(spark, d):
    found = pii.find_personal_data(_read(spark, d, "documents").select("doc_id", "text"))
    counts = [pii.number_of(F.col("base"), kind).alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("row.doc_id", *counts, F.sha2(pii.span_text(F.col("base")), 256).alias("base_sha256"), pii.span_text(F.col("spans")).alias("spans"))
