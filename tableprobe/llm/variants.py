"""Groups of spelling variants: words one inserted, deleted or replaced letter apart, found in a frequency-vector trie.

A word is described by how many letters of each letter group it has. The trie arranges all words by these counts, one group a level, after a
first level for the length; below them come the counts within the first half of the letters. One edit changes the counts of a word by one surplus and one
deficit at most, so the search descends with a budget of one each. To meet each pair once, it goes from a word to longer ones, which spend the surplus
only, and to words as long that spend the surplus before the deficit; words with equal counts are met from the smaller one. Words of the leaves that are
reached are verified letter by letter. The letter groups follow the letters' frequency in the vocabulary: frequent ones are groups of their own.

The trie is laid out over the cluster. Nodes with more than `NODE_WORDS` words are expanded by Spark, a level at a time: words move to the child with
their count, searches to the up to three children in reach. A smaller node is searched by one task, depth first over blocks of searches;
where many searches meet in a node they are dealt over several tasks, with the node's words beside each. Words that the whole trie can't part, more than `NODE_WORDS` of
them, are verified by equijoins on words with one letter masked or left out. Neither a node nor its pairs are ever gathered: a task hands on one row per word, with the number of near words
it met and the best of them.

Defined cases. Null words are left out; repeated rows of one word add their counts up. An empty table gives no rows. Columns besides `word` and `n` are ignored, so their names can't clash. Words
are of any length and of the letters U+0000 to U+00FF, of one byte in Latin-1; others are refused. A tie of two near words goes to the smaller one in code-point order.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tableprobe.llm.common import buffers, prepare, saved

#: Words of a node that one task searches, and searches that it runs over them.
NODE_WORDS, NODE_SEARCHES = 50_000, 200_000
#: Letter groups; the last has all letters that are not frequent.
GROUPS = 24
#: Searches that descend together, and pairs that are verified together.
BLOCK, PAIRS = 16_384, 500_000

_MET = "code binary, near long, best_n long, best binary"


def spelling_variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """`word, n, n_near, form, form_n, root` for every word of `words` (`word`, `n`).

    `n_near` is the number of words one edit away. `form` is the most frequent of them if it is at least `ratio` times as frequent, and
    `root` the last word when forms are followed.
    """
    prepare(words.sparkSession)
    if ratio < 2:
        raise ValueError("a form is more frequent than its variants")
    counted = words.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").cast("long").alias("n"))
    counted = saved(counted, "variant-words")
    met = near_words(counted).groupBy("code").agg(
        F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("best")
    )
    met = met.select(F.decode("code", "ISO-8859-1").alias("word"), "n_near", (-F.col("best.n")).alias("best_n"), F.decode("best.word", "ISO-8859-1").alias("best"))
    whole = counted.join(met, "word", "left")
    enough = F.col("best_n") >= ratio * F.col("n")
    whole = whole.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("best")).alias("form"),
        F.when(enough, F.col("best_n")).alias("form_n"),
    )
    whole = saved(whole, "variant-forms")
    return whole.join(_roots(whole, ratio), "word", "left").withColumn("root", F.coalesce("root", "word"))


def _roots(whole: DataFrame, ratio: int) -> DataFrame:
    """`word, root` of the words with a form. Each step of a chain multiplies the count, so chains are short and a few doublings reach their ends."""
    most = whole.agg(F.max("n")).first()[0] or 1
    steps = max(1, math.ceil(math.log(most, ratio)))
    ways = whole.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(steps.bit_length()):
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        # many variants may share a form; the join splits such a key, as the right side has each word once
        ways = saved(ways.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "variant-roots")
    return ways


# the trie --------------------------------------------------------------------------------


def letter_groups(words: DataFrame) -> list[str]:
    """Letters from the most frequent in the vocabulary on, one each, and in the last group all others."""
    letters = words.select(F.explode(F.split("word", "")).alias("letter")).where("letter <> ''").groupBy("letter").count()
    # an alphabet's worth of rows
    ranked = [r.letter for r in sorted(letters.collect(), key=lambda r: (-r["count"], r.letter))]
    if any(ord(letter) > 255 for letter in ranked):
        raise ValueError("words have to be of letters up to U+00FF")
    return [g for g in [*ranked[: GROUPS - 1], "".join(ranked[GROUPS - 1 :])] if g]


def _count(level: int, groups: list[str]) -> Column:
    """Letters of the level's group in `word`, or in its first half, where the half is that of words of `length` letters."""
    text = F.col("word") if level < len(groups) else F.col("word").substr(F.lit(1), F.floor(F.col("length") / 2).cast("int"))
    return F.length(text) - F.length(F.translate(text, groups[level % len(groups)], ""))


def _reach(level: int, groups: list[str]) -> Column:
    """The counts of the level that a search may descend to, each with the state it then has.

    In the first part of the trie the state is 0, then 1 with the surplus spent, then 2 with the deficit spent too; in the second part
    it is the sum of 1 and 2 for the surplus and the deficit.
    """
    count, state = _count(level, groups), F.col("state")
    if level < len(groups):
        more, less = state == 0, (state == 1) & (F.col("longer") == 0)
        after_less = F.lit(2)
    else:
        more, less = state.bitwiseAND(F.lit(1)) == 0, state < 2
        after_less = state + 2
    ways = [
        F.struct(count.alias("count"), state.alias("state")),
        F.when(more, F.struct((count + 1).alias("count"), (state + 1).alias("state"))),
        F.when(less & (count > 0), F.struct((count - 1).alias("count"), after_less.cast("int").alias("state"))),
    ]
    return F.explode(F.filter(F.array(*ways), lambda way: way.isNotNull()))


def near_words(words: DataFrame) -> DataFrame:
    """`code, near, best_n, best`: per word and task, in Latin-1, the near words met there, their number and the most frequent one."""
    groups = letter_groups(words)
    levels = 2 * len(groups)
    placed = words.withColumn("length", F.length("word"))
    targets = placed.withColumn("node", F.col("length").cast("string"))
    searches = placed.select("word", "n", F.explode(F.array(F.struct("length", F.lit(0).alias("longer")), F.struct((F.col("length") + 1).alias("length"), F.lit(1).alias("longer")))).alias("to"))
    searches = searches.select("word", "n", "to.*", F.col("to.length").cast("string").alias("node"), F.lit(0).alias("state"))
    light_targets, light_searches, large = [], [], None
    for level in range(levels + 1):
        if level == len(groups):  # the counts of the whole word have to differ by the edit, and those of the half start anew
            searches = searches.where("(longer = 1 AND state = 1) OR (longer = 0 AND state <> 1)").withColumn("state", F.when((F.col("longer") == 0) & (F.col("state") == 0), 0).otherwise(4))
            searches = searches.withColumn("equal", F.col("state") == 0).withColumn("state", F.lit(0))
        elif level < len(groups):
            searches = searches.withColumn("equal", F.lit(False))
        sizes = saved(targets.groupBy("node").agg(F.count("*").alias("words")), "variant-nodes")
        small, heavy = sizes.where(F.col("words") <= NODE_WORDS).select("node"), sizes.where(F.col("words") > NODE_WORDS).select("node")
        light_targets.append(targets.join(small, "node").select("node", "word", "n", "length"))
        light_searches.append(searches.join(small, "node").select("node", "word", "n", "length", "longer", "state", "equal"))
        if heavy.isEmpty():
            break
        if level == levels:
            large = (targets.join(heavy, "node"), searches.join(heavy, "node"))
            break
        child = F.concat("node", F.lit("."), F.col("count").cast("string"))
        targets = targets.join(heavy, "node").withColumn("count", _count(level, groups))
        targets = saved(targets.select("word", "n", "length", child.alias("node")), "variant-targets")
        searches = searches.join(heavy, "node").withColumn("way", _reach(level, groups))
        searches = searches.withColumns({"count": F.col("way.count"), "state": F.col("way.state")})
        searches = saved(searches.select("word", "n", "length", "longer", child.alias("node"), "state", "equal"), "variant-searches")
    targets, searches = (reduce(DataFrame.unionByName, parts) for parts in (light_targets, light_searches))
    # searches of a node are dealt over as many tasks as they need
    tasks = searches.groupBy("node").agg(F.ceil(F.count("*") / NODE_SEARCHES).cast("int").alias("tasks"))
    beside = targets.join(tasks, "node").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)))
    dealt = searches.join(tasks, "node").withColumn("block", F.pmod(F.xxhash64("word"), F.col("tasks")).cast("int"))
    code = F.encode("word", "ISO-8859-1").alias("code")
    both = beside.select("node", "block", code, "n", F.lit(-1).alias("longer"), F.lit(0).alias("state"), F.lit(False).alias("equal"))
    both = both.unionByName(dealt.select("node", "block", code, "n", "longer", "state", "equal"))
    met = both.groupBy("node", "block").applyInArrow(_searcher(groups), _MET)
    return met if large is None else met.unionByName(_masked_pairs(*large))


def _masked_pairs(targets: DataFrame, searches: DataFrame) -> DataFrame:
    """What `near_words` gives, for the words of leaves that are too large for a task.

    Words that differ in one letter are equal with it masked; at most an alphabet's worth of them share a mask. A word is equal to a
    longer one without the letter it lacks, the first where that letter is repeated.
    """
    word, at = F.col("word"), F.col("at")
    each = F.explode(F.sequence(F.lit(1), F.length("word"))).alias("at")
    before = word.substr(F.lit(1), at - 1)
    after = word.substr(at + 1, F.length("word"))
    spread = targets.select("node", "word", "n", each)
    masked = spread.select("node", F.concat(before, F.lit("\0"), after).alias("key"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    first_of_run = word.substr(at, F.lit(1)) != word.substr(at - 1, F.lit(1))
    shorter = spread.where((at == 1) | first_of_run).select("node", F.concat(before, after).alias("key"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    alike = searches.where("longer = 0").select("node", "word", "n", "equal", each).withColumn("key", F.concat(before, F.lit("\0"), after))
    pairs = alike.join(masked, ["node", "key"]).where("word <> other AND (NOT equal OR word < other)")
    longer = searches.where("longer = 1").select("node", "word", "n", F.col("word").alias("key")).join(shorter, ["node", "key"])
    pairs = pairs.select("word", "n", "other", "other_n").unionByName(longer.select("word", "n", "other", "other_n"))
    ends = pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    best = F.min(F.struct((-F.col("other_n")).alias("n"), F.encode("other", "ISO-8859-1").alias("word")))
    met = ends.groupBy("word").agg(F.count("*").alias("near"), best.alias("best"))
    return met.select(F.encode("word", "ISO-8859-1").alias("code"), "near", (-F.col("best.n")).alias("best_n"), F.col("best.word").alias("best"))


# one node, in a task ----------------------------------------------------------------------


def _letters(column: pa.ChunkedArray) -> np.ndarray:
    """Words of one length as rows of bytes."""
    raw, where = buffers(column)
    return raw.reshape(len(column), -1) if len(column) and len(raw) else np.zeros((len(column), 0), np.uint8)


def _counts(letters: np.ndarray, group_of: np.ndarray, groups: int, half: int) -> np.ndarray:
    """The counts of all levels, a row per word."""
    of = group_of[letters]
    out = np.empty((len(letters), 2 * groups), np.int64)
    for g in range(groups):
        hit = of == g
        out[:, g] = hit.sum(1)
        out[:, groups + g] = hit[:, :half].sum(1)
    return out


class _Trie:
    """The words of a node arranged by the levels from `first` on; a node is a number on its level, and a child is found by (node, count)."""

    def __init__(self, counts: np.ndarray, first: int):
        self.first, self.levels = first, counts.shape[1]
        self.span = int(counts.max(initial=0)) + 2
        at = np.zeros(len(counts), np.int64)
        self.children = []
        for level in range(first, self.levels):
            keys, at = np.unique(at * self.span + counts[:, level], return_inverse=True)
            self.children.append(keys)
        self.words = np.argsort(at, kind="stable")
        self.starts = np.searchsorted(at[self.words], np.arange(at.max(initial=-1) + 2))

    def child(self, level: int, node: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The child with the count, or -1."""
        keys = self.children[level - self.first]
        wanted = node * self.span + count
        place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where((keys[place] == wanted) & (count >= 0) & (count < self.span), place, -1)

    def descend(self, counts: np.ndarray, longer: bool, state: np.ndarray, equal: np.ndarray, groups: int) -> tuple:
        """(search, word, equal) of all words in reach of the searches with these counts."""
        search, node = np.arange(len(counts)), np.zeros(len(counts), np.int64)
        for level in range(self.first, self.levels):
            if level == groups and self.first < groups:
                fit = state == 1 if longer else state != 1
                search, node, equal = search[fit], node[fit], (state[fit] == 0) & (not longer)
                state = np.zeros(len(search), np.int64)
            count = counts[search, level]
            if level < groups:
                more, less = state == 0, (state == 1) & (not longer)
            else:
                more, less = (state & 1) == 0, state < 2
            ways = [
                (search, node, count, state, equal),
                (search[more], node[more], count[more] + 1, state[more] + 1, equal[more]),
                (search[less], node[less], count[less] - 1, np.full(less.sum(), 2) if level < groups else state[less] + 2, equal[less]),
            ]
            search, node, count, state, equal = (np.concatenate(parts) for parts in zip(*ways))
            node = self.child(level, node, count)
            there = node >= 0
            search, node, state, equal = search[there], node[there], state[there], equal[there]
        sizes = self.starts[node + 1] - self.starts[node]
        which = np.repeat(np.arange(len(node)), sizes)
        inside = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return search[which], self.words[self.starts[node[which]] + inside], equal[which]


def _one_edit(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Whether rows of the same length differ in one letter, or the second has one letter more that the first lacks."""
    if short.shape[1] == long.shape[1]:
        return (short != long).sum(1) == 1
    ahead = np.cumprod(short == long[:, :-1], axis=1).sum(1)
    behind = np.cumprod((short == long[:, 1:])[:, ::-1], axis=1).sum(1)
    return ahead + behind >= short.shape[1]


def _searcher(groups: list[str]):
    """The function that searches one node: its words are rows with `longer` = -1, all others are searches."""
    number = len(groups)
    group_of = np.full(256, number, np.int64)
    for g, letters in enumerate(groups):
        group_of[np.frombuffer(letters.encode("latin-1"), np.uint8)] = g

    def search(key: tuple, table: pa.Table) -> pa.Table:
        first = str(key[0].as_py()).count(".")
        longer = table["longer"].to_numpy()
        words = table.filter(pa.array(longer < 0))
        letters = _letters(words["code"])
        size = letters.shape[1]
        trie = _Trie(_counts(letters, group_of, number, size // 2), first)
        own_n = words["n"].to_numpy()
        ends = []
        for kind in (0, 1):
            asked = table.filter(pa.array(longer == kind))
            if not len(asked) or not len(words):
                continue
            codes, asked_n = _letters(asked["code"]), asked["n"].to_numpy()
            state, equal = asked["state"].to_numpy().astype(np.int64), asked["equal"].to_numpy(zero_copy_only=False)
            # (word, its n, other word, its n) by row numbers: searches first, then the words of the node
            found = []
            for low in range(0, len(asked), BLOCK):
                part = slice(low, low + BLOCK)
                counts = _counts(codes[part], group_of, number, size // 2)
                who, whom, same = trie.descend(counts, kind == 1, state[part], equal[part], number)
                for at in range(0, len(who), PAIRS):
                    a, b, e = who[at : at + PAIRS] + low, whom[at : at + PAIRS], same[at : at + PAIRS]
                    near = _one_edit(codes[a], letters[b])
                    a, b, e = a[near], b[near], e[near]
                    if kind == 0:
                        # words with equal counts meet twice
                        differ = np.argmax(codes[a] != letters[b], axis=1) if len(a) else np.zeros(0, np.int64)
                        kept = ~e | (codes[a, differ] < letters[b, differ])
                        a, b = a[kept], b[kept]
                    found.append((a, b))
            if found:
                a, b = (np.concatenate(side) for side in zip(*found))
                ends.append(_best(asked["code"], a, words["code"], own_n, b))
                ends.append(_best(words["code"], b, asked["code"], asked_n, a))
        return pa.concat_tables(ends) if ends else _EMPTY

    return search


def _best(words: pa.ChunkedArray, word: np.ndarray, others: pa.ChunkedArray, n: np.ndarray, other: np.ndarray) -> pa.Table:
    """A row per word with a near one: their number, and the most frequent, or the smallest of these."""
    if not len(word):
        return _EMPTY
    raw = _letters(others)
    rank = np.empty(len(others), np.int64)
    rank[np.lexsort(raw.T[::-1])] = np.arange(len(others))
    order = np.lexsort((rank[other], -n[other], word))
    word, other = word[order], other[order]
    start = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    near = np.diff(np.append(start, len(word)))
    return pa.table(
        {"code": words.take(pa.array(word[start])), "near": near.astype(np.int64), "best_n": n[other[start]], "best": others.take(pa.array(other[start]))}
    ).cast(_EMPTY.schema)


_EMPTY = pa.table({"code": pa.array([], pa.binary()), "near": pa.array([], pa.int64()), "best_n": pa.array([], pa.int64()), "best": pa.array([], pa.binary())})
