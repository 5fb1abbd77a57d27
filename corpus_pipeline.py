"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last return the columns of
documents, whatever they are; only doc_id, text, source and lang have a meaning here, `n_chars`, if there, follows the text. Nulls and
repeated rows are handled as the operators say; empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tableprobe.llm import mixing, near_dup, queries, suffix_dedup, toxicity
from tableprobe.llm.common import prepare, saved


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.5."""
    prepare(spark)
    model = queries.toxicity_model(docs, _labels(spark, sf_dir))
    return docs.where(toxicity.toxicity(docs["text"], model, spark) < 0.5)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that with the smallest id; of rows with one id, one. Rows without an id stay."""
    prepare(spark)
    dropped = near_dup.near_duplicates(docs).where("NOT kept").select(F.col("doc_id").alias("dropped")).distinct()
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")
    named = docs.where("doc_id IS NOT NULL").select(row, docs["doc_id"].alias("id"))
    kept = named.join(dropped, named["id"] == dropped["dropped"], "left_anti").dropDuplicates(["id"])
    return kept.select("row").unionByName(docs.where("doc_id IS NULL").select(row)).select("row.*")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the byte strings of 100 and more that occurred before; a character cut in two goes as a whole."""
    prepare(spark)
    was_null = "text_was_null"
    while was_null in docs.columns:
        was_null += "_"
    cut = suffix_dedup.remove_repeats(docs.withColumn(was_null, docs["text"].isNull()), whole_characters=True)
    text = F.when(~F.col(f"row.{was_null}"), F.col("kept").cast("string"))
    columns = {c: F.col(f"row.`{c}`") for c in docs.columns if c != "text"} | {"text": text}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("n_removed") == 0, columns["n_chars"]).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType)
    return cut.select(*[columns[c].alias(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it.

    Rows equal in id, source and size share what the mix takes of them, rounded up.
    """
    prepare(spark)
    mixed = mixing.mix_sources(docs, queries.quality_weights(_labels(spark, sf_dir))).where("epochs > 0")
    times = mixed.groupBy("doc_id", "source", "size").agg(F.sum("epochs").alias("epochs"))
    times = times.select(F.col("doc_id").alias("i"), F.col("source").alias("s"), F.col("size").alias("z"), "epochs")
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")
    rows = docs.select(row, docs["doc_id"].alias("id"), docs["source"].alias("source"), mixing.size_of(docs["text"]).alias("size"))
    alike = saved(rows.select("id", "source", "size"), "mix-alike").groupBy("id", "source", "size").agg(F.count("*").alias("n"))
    alike = alike.select(F.col("id").alias("i"), F.col("source").alias("s"), F.col("size").alias("z"), "n")
    same = F.col("i").eqNullSafe(F.col("id")) & F.col("s").eqNullSafe(F.col("source")) & (F.col("z") == F.col("size"))
    times = times.join(alike.select(F.col("i").alias("id"), F.col("s").alias("source"), F.col("z").alias("size"), "n"), same)
    times = times.select("i", "s", "z", F.ceil(F.col("epochs") / F.col("n")).cast("int").alias("epochs"))
    found = rows.join(times, same)
    return found.select("row", F.explode(F.array_repeat(F.lit(1), F.col("epochs")))).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text, and the digests of the ids and of what they decode to."""
    own = queries.tokenizer(prepare(spark))
    coded = docs.select("doc_id", own.encode("text").alias("ids"))
    coded = coded.select("doc_id", "ids", own.decode("ids").alias("decoded"))
    return coded.select("doc_id", *queries.digests(F.col("ids")), F.sha2("decoded", 256).alias("decoded_sha256"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", keep_one_of_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("mix", mix),
    ("bpe", encode),
]

#: The classifier, the compression of names and the merges cannot be put into SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents, each written as Parquet and read again."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
