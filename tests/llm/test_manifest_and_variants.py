"""Merkle manifests and spelling variants against brute force, and on nulls, empties, ties, repeats and clashing columns."""

import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tableprobe.llm import merkle, queries, variants
from tableprobe.llm.common import prepare

ALPHABET = [*"abcdefghijklmnopqrstuvwxyz", *map(chr, range(0xC0, 0x100))]


def sha(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def tree(hashes, arity):
    """The root of some hashes, and per hash the (left, right) siblings of each step."""
    proofs = [[] for _ in hashes]
    nodes = [(h, [i]) for i, h in enumerate(hashes)]
    while len(nodes) > 1:
        above = []
        for at in range(0, len(nodes), arity):
            run = nodes[at : at + arity]
            for k, (_, below) in enumerate(run):
                for i in below:
                    proofs[i].append(("".join(h for h, _ in run[:k]), "".join(h for h, _ in run[k + 1 :])))
            above.append((sha(*[h for h, _ in run]), [i for _, below in run for i in below]))
        nodes = above
    return (nodes[0][0] if nodes else None), proofs


def expected_manifest(rows, arity):
    """(id, leaf) -> sorted (subroot, root, proof) of rows (id, group)."""
    groups = collections.defaultdict(list)
    for i, group in rows:
        groups[group].append((i, sha("-" if i is None else f"{len(str(i))}:{i}")))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    inner = {g: tree([h for _, h in sorted(groups[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))], arity) for g in groups}
    root, outer = tree([inner[g][0] for g in order], arity)
    out = []
    for at, g in enumerate(order):
        for (i, leaf), steps in zip(sorted(groups[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1])), inner[g][1]):
            out.append((i, leaf, inner[g][0], root, steps + outer[at]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("arity", [2, 3, 4])
def test_manifest_is_that_of_the_trees(spark, monkeypatch, arity):
    monkeypatch.setattr(merkle, "RANGE_ROWS", 7)
    rnd = random.Random(arity)
    rows = [(rnd.choice([None, *range(60)]), rnd.choice(["a", "a", "a", "b", None, "", "é", "Z"])) for _ in range(90)] + [(5, "alone")]
    # columns named like those of the operator
    df = spark.createDataFrame([(i, g, "x", 1, "y", 2.0) for i, g in rows], "id long, source string, g string, i int, hash string, tie double").repartition(4)
    made = merkle.manifest(df, F.col("source"), [F.col("id")], merkle.row_hash(F.col("id")), arity)
    folded = made.withColumn("folded", merkle.fold(F.col("leaf"), F.col("path")))
    got = folded.collect()
    assert all(r.folded == r.root for r in got) and got[0].row.g == "x"
    assert sorted(((r.row.id, r.leaf, r.subroot, r.root, [(s.left, s.right) for s in r.path]) for r in got), key=repr) == expected_manifest(rows, arity)


def test_plan_of_a_manifest_does_not_grow_with_its_levels(spark):
    plans = []
    for rows in (30, 3000):
        made = merkle.manifest(spark.range(rows), F.lit("g"), [F.col("id")], merkle.row_hash(F.col("id")))
        plans.append(made._jdf.queryExecution().optimizedPlan().toString())
    assert plans[0].count("Join ") == plans[1].count("Join ") and plans[0].count("Union") == plans[1].count("Union")


def test_manifests_of_no_and_of_one_row(spark):
    df = spark.createDataFrame([], "id long, source string")
    assert merkle.manifest(df, F.col("source"), [F.col("id")], merkle.row_hash(F.col("id"))).collect() == []
    one = merkle.manifest(spark.range(1).withColumn("source", F.lit("s")), F.col("source"), [F.col("id")], merkle.row_hash(F.col("id"))).first()
    assert one.leaf == one.subroot == one.root == sha("1:0") and one.path == []


def test_a_changed_leaf_or_path_shows(spark):
    made = merkle.manifest(spark.range(50), F.lit("g"), [F.col("id")], merkle.row_hash(F.col("id")))
    changed = made.select("root", merkle.fold(merkle.row_hash(F.col("row.id") + 1), F.col("path")).alias("leaf"), merkle.fold(F.col("leaf"), F.reverse("path")).alias("path"))
    assert changed.where("root = leaf OR root = path").count() == 0


def test_hashes_of_rows(spark):
    row = spark.sql("SELECT CAST(NULL AS STRING) a, '' b, 'é\n' c, 12 d").select(merkle.row_hash(*map(F.col, "abcd")).alias("h")).first()
    assert row.h == sha("-", "0:", "3:é\n", "2:12")


def test_manifest_query_finds_tampered_rows(spark, tmp_path):
    rows = [(i, f"line\n{i}" if i % 3 else "no line", None if i % 5 else "s", "x", i) for i in range(40)] + [(None, "a\nb", "s", None, None), (7, None, "s", "", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    import zlib

    found = queries.QUERIES["op11_merkle_manifest"](spark, str(tmp_path)).collect()
    assert len(found) == len(rows)
    expected = collections.Counter((i, i is None or zlib.crc32(str(i).encode()) % 2 == 1 or "\n" not in (t or "")) for i, t, *_ in rows)
    assert collections.Counter((r.doc_id, r.verified) for r in found) == expected


# variants ---------------------------------------------------------------------------------


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) == len(a):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def expected_variants(counts, ratio):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= ratio * counts[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, counts[w], len(near[w]), form[w] or "", form[w] and counts[form[w]] or 0, root(w)) for w in counts)


def vocabulary(seed, size, letters, lengths):
    rnd = random.Random(seed)
    words = {"".join(rnd.choice(letters) for _ in range(rnd.choice(lengths))) for _ in range(size)}
    for w in list(words)[: size // 2]:
        at = rnd.randrange(len(w) + 1)
        words.add(rnd.choice([w[:at] + rnd.choice(letters) + w[at:], w[:at] + w[at + 1 :], w[:at] + rnd.choice(letters) + w[at + 1 :]]))
    words.discard("")
    return {w: rnd.choice([1, 2, 3, 20, 25, 300, 5000]) for w in sorted(words)}


CASES = [("abc", [1, 2, 3, 4]), ("abcdeß", [4, 5, 6]), (ALPHABET, [3, 7]), ("ab", [6, 7])]


@pytest.mark.parametrize("letters, lengths", CASES)
@pytest.mark.parametrize("node, groups", [(50_000, 24), (3, 24), (3, 4), (1, 3)])
def test_variants_are_those_of_all_pairs(spark, monkeypatch, letters, lengths, node, groups):
    prepare(spark)
    monkeypatch.setattr(variants, "NODE_WORDS", node)
    monkeypatch.setattr(variants, "GROUPS", groups)
    monkeypatch.setattr(variants, "NODE_SEARCHES", 5 if node == 3 else 200_000)
    counts = vocabulary(len(letters) + node, 40 if node == 1 else 120, letters, lengths)
    df = spark.createDataFrame([(w, n, "x", 1) for w, n in counts.items()], "word string, n long, node string, state int")
    got = variants.spelling_variants(df, 10).collect()
    assert sorted((r.word, r.n, r.n_near, r.form or "", r.form_n or 0, r.root) for r in got) == expected_variants(counts, 10)


def test_blocks_of_searches_and_pairs(spark, monkeypatch):
    monkeypatch.setattr(variants, "BLOCK", 7)
    monkeypatch.setattr(variants, "PAIRS", 5)
    counts = vocabulary(1, 300, "abcd", [3, 4, 5])
    got = variants.spelling_variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()
    assert sorted((r.word, r.n, r.n_near, r.form or "", r.form_n or 0, r.root) for r in got) == expected_variants(counts, 10)


def test_words_of_odd_tables(spark):
    empty = spark.createDataFrame([], "word string, n long")
    assert variants.spelling_variants(empty).collect() == []
    rows = [("abcdefgh", 40), ("abcdefgh", 60), ("abcdefgi", 10), ("abcdefgi", None), (None, 5), ("x" * 20000, 3), ("x" * 20001, 30), ("aaaaaaa", 3), ("aaaaaaaa", 30)]
    got = {r.word: r for r in variants.spelling_variants(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert len(got) == 6
    assert (got["abcdefgi"].form, got["abcdefgh"].n, got["aaaaaaa"].form) == ("abcdefgh", 100, "aaaaaaaa")
    assert got["x" * 20000].form == "x" * 20001
    with pytest.raises(ValueError, match="U"):
        variants.spelling_variants(spark.createDataFrame([("日本", 3)], "word string, n long"))


def test_chains_end_at_the_last_form(spark):
    words = ["aaaaaaa", "aaaaaab", "aaaaabb", "aaaabbb", "aaabbbb", "aabbbbb"]
    counts = {w: 10**k for k, w in enumerate(words)}
    got = {r.word: r for r in variants.spelling_variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    assert {r.root for r in got.values()} == {words[-1]} and got[words[0]].form == words[1]


def test_variant_query_reads_runs_of_letters(spark, tmp_path):
    rows = [(i, "Wörterbuch WÖRTERBUCH, x1wörterbuch2 Éclair-éclairs éclairs éclairs kleine", "n") for i in range(80)] + [(None, "éclairs", "n"), (3, None, "n"), (4, "", "n")]
    spark.createDataFrame(rows, "doc_id long, text string, word string").write.parquet(f"{tmp_path}/documents.parquet")
    import re
    import zlib

    counts = collections.Counter()
    for i, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode()) if i is not None else 1
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    got = queries.QUERIES["op12_spelling_variants"](spark, str(tmp_path)).collect()
    assert sorted((r.word, r.n, r.n_near, r.form or "", r.form_n or 0, r.root) for r in got) == expected_variants(counts, 10)
