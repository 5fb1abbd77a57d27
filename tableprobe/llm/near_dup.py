"""Groups of near-duplicate documents, by a chosen-path set similarity join.

A document's set holds its distinct shingles of `size` words (lower-cased A-Z, words between ASCII white space);
with fewer words, the whole sequence is its one shingle. Two documents are linked if the Jaccard similarity of their
sets is at least `percent` / 100; linked documents form a component.

1. Equal sets are one class, whatever the number of copies; from here on there is one row per class.
2. Each class has 128 minwise values. In each of `trees` independent trees, a class goes down from a node to the
   children named by the values at one or two positions (4/3 on average, so that a pair at the threshold keeps one common
   child on average). Positions depend on the node alone: classes with the same values take the same path.
   Nodes of one class end; small nodes (up to 64 classes) are compared exhaustively; large ones branch on.
3. A large node that hardly shrinks mostly holds classes that are alike. It is first cut at random into small nodes, each
   with about 16 classes common to all parts of the node, and these are compared exhaustively; see 6 for what that misses.
4. Within a small node the agreement of the minwise values is computed for all pairs. Pairs under 0.58 are dropped (a pair at
   0.75 falls there with probability 5e-6). Of the others a spanning forest by descending agreement is
   confirmed on the full sets, and its components are found.
5. Small nodes whose classes are not all in one component by then are taken up again, and so are the cut nodes, as being alike is no
   link (texts with much in common can all stay below the threshold). A node of up to `WHOLE` classes and `NAMES` shingles is one
   group. Of a larger one that is all but 32 classes one component, these meet every part of the others; other larger ones branch on, and
   those with too many shingles, or at the end of the tree, are cut so that every part meets every other.
6. Of each group, the classes that agree to 0.58 or more with one of another component send their full sets there, once. The
   task counts what the classes outside the largest component have in common with every other one, and hands on a spanning forest
   of the links it finds. So a group hands on fewer links than it has classes, however many pairs it compares.

Recall: a pair at 0.75 survives two levels of a tree with probability 0.69 and four with 0.53; eight trees miss it with
probability 1e-4 and 2e-3. From there all paths are doubled at the depths `DOUBLED`, so that it is missed with at most 7e-3 at any
depth (without, 0.12 at depth 16); pairs above are found more often. Links found are exact (64-bit shingle names).

Cases: null texts and texts without words have the empty set and are linked with nothing. Rows with one
doc_id count as one document: they share a component. A row without a doc_id has a null component and is
kept. Repeated rows are copies.

Scale: what is shuffled is 300 bytes per document, 16 to 30 bytes per node entry, and full sets only of candidates, once for each
pair of the forest and each open group.
Copies are collapsed before; no step gathers a node, class or component; all steps are saved.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tableprobe.llm.common import Words, mix, prepare, saved, shingles, tidy
from tableprobe.llm.components import connected_components

HASHES = 128
SMALL = 64
#: Pairs that agree less are not confirmed.
CUT = 0.58
#: A child with more than this share of its node does not count as smaller.
SHRINK = 0.7
COMMON = 16
#: An open node of up to so many classes and shingles is one group; its classes are compared exhaustively on their full sets.
WHOLE, NAMES = 2048, 1 << 19
#: Shingles, and classes, that are counted together.
_COLUMNS, _ROWS = 2048, 512
#: Depths at which the paths are doubled, so that recall does not fall with the depth.
DOUBLED = (4, 6, 9, 13, 18, 24, 32, 40)
_DEEPEST = 64

_random = np.random.default_rng(7)
_FLIP = _random.integers(0, 1 << 32, (HASHES, 1), dtype=np.uint32)
_FACTOR = _random.integers(0, 1 << 31, (HASHES, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def minwise(names: np.ndarray) -> np.ndarray:
    """16 bits of each minwise value of a non-empty set of 64-bit names."""
    short = (names >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), 4096):
        np.minimum(least, (((short[at : at + 4096][None, :] ^ _FLIP)) * _FACTOR).min(axis=1), out=least)
    return mix(least.astype(np.uint64)).astype(np.uint16)


def sets_of(text: pa.Array, size: int):
    """The sorted distinct shingles of each text."""
    words = Words(text)
    for a, b in zip(words.first[:-1], words.first[1:]):
        yield np.unique(shingles(words.hashes[a:b], size))


def _key(names: np.ndarray) -> bytes:
    return hashlib.blake2b(names.tobytes(), digest_size=16).digest()


_SKETCH = "n_shingles long, key binary, sketch binary"


def _sketcher(size: int, schema: pa.Schema):
    def run(batches):
        for batch in batches:
            counts, keys, sketches = [], [], []
            for names in sets_of(batch.column("text"), size):
                counts.append(len(names))
                keys.append(_key(names) if len(names) else None)
                sketches.append(minwise(names).tobytes() if len(names) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(sketches, pa.binary())],
                schema=schema,
            )

    return run


def _values(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), HASHES)


def _children(node: np.ndarray, row: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The children that entries (node, row) go to."""
    draw = mix(node ^ np.uint64(0xA5A5F00D5EED1234))
    one = draw % np.uint64(HASHES)
    two = (one + np.uint64(1) + (draw >> np.uint64(20)) % np.uint64(HASHES - 1)) % np.uint64(HASHES)
    twice = np.flatnonzero((draw >> np.uint64(40)) % np.uint64(3) == 0)

    def child(node, row, at):
        return mix(node * np.uint64(0x9E3779B97F4A7C15) + (at << np.uint64(16)) + values[row, at.astype(np.int64)])

    return (
        np.concatenate([child(node, row, one), child(node[twice], row[twice], two[twice])]),
        np.concatenate([row, row[twice]]),
    )


_ENTRY = "node long, key binary"
_ENTRIES = pa.schema([("node", pa.int64()), ("key", pa.binary())])


def _planter(trees: int, levels: int):
    def run(batches):
        for batch in batches:
            values = _values(batch.column("sketch"))
            rows = np.arange(len(values))
            for tree in range(trees):
                node, row = np.full(len(rows), mix(np.array([tree + 1], np.uint64))[0]), rows
                for _ in range(levels):
                    node, row = _children(node, row, values)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node.view(np.int64)), batch.column("key").take(pa.array(row))], schema=_ENTRIES
                )

    return run


_DEEPER = "node long, key binary, above long"


def _deepen(batches):
    """One level more for the entries of large nodes."""
    schema = pa.schema([*_ENTRIES, ("above", pa.int64())])
    for batch in batches:
        values = _values(batch.column("sketch"))
        node = np.asarray(batch.column("node")).view(np.uint64)
        node, row = _children(node, np.arange(len(values)), values)
        take = pa.array(row)
        yield pa.RecordBatch.from_arrays(
            [pa.array(node.view(np.int64)), batch.column("key").take(take), batch.column("n").take(take)], schema=schema
        )


_PAIR = "a binary, b binary"
_PAIRS = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def _forest(keys: list[bytes], agree: np.ndarray) -> list[tuple]:
    """A spanning forest of the pairs that agree, strongest first."""
    left, right = np.nonzero(np.triu(agree >= CUT, 1))
    above, out = list(range(len(keys))), []

    def top(x):
        while above[x] != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    for k in np.lexsort((right, left, -agree[left, right])):
        a, b = top(int(left[k])), top(int(right[k]))
        if a != b:
            above[max(a, b)] = min(a, b)
            out.append((keys[left[k]], keys[right[k]]))
    return out


def _compare(keys: list[bytes], values: np.ndarray) -> list[tuple]:
    """The pairs of one small node that are to be confirmed."""
    order = sorted(range(len(keys)), key=lambda i: keys[i])
    order = [i for k, i in enumerate(order) if k == 0 or keys[i] != keys[order[k - 1]]]
    if len(order) < 2:
        return []
    keys, values = [keys[i] for i in order], values[order]
    return _forest(keys, np.stack([(values == one).mean(axis=1) for one in values]))


def _groups(batches):
    """The rows of one node after another; they come sorted by node."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        node = np.asarray(batch.column("node"))
        cuts = np.concatenate([[0], np.flatnonzero(node[1:] != node[:-1]) + 1, [len(node)]])
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == b:
                continue
            if held and node[a] != last:
                yield held
                held = []
            held.append(batch.slice(a, b - a))
            last = node[a]
    if held:
        yield held


def _column(group: list[pa.RecordBatch], name: str) -> list:
    return [value for batch in group for value in batch.column(name).to_pylist()]


def _sketches(group: list[pa.RecordBatch]) -> np.ndarray:
    return np.concatenate([_values(batch.column("sketch")) for batch in group])


def _pairs(batches):
    """Pairs of small nodes."""
    out: list[tuple] = []
    for group in _groups(batches):
        out += _compare(_column(group, "key"), _sketches(group))
        if len(out) >= 10_000:
            yield _batch(out)
            out = []
    yield _batch(out)


def _batch(pairs: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.binary()) for i in (0, 1)], schema=_PAIRS)


def _outside(roots: list) -> tuple[np.ndarray, np.ndarray]:
    """The components of the classes as numbers, and which classes are not in the largest."""
    _, number, count = np.unique(np.array(roots, dtype=object).astype(str), return_inverse=True, return_counts=True)
    return number, np.flatnonzero(number != np.argmax(count))


def _suspects(batches):
    """Entries (node, key) of the classes that agree with one of another component of their group."""
    for group in _groups(batches):
        number, others = _outside(_column(group, "root"))
        values = _sketches(group)
        met = np.zeros(len(number), bool)
        for i in others:
            alike = ((values == values[i]).mean(axis=1) >= CUT) & (number != number[i])
            if alike.any():
                met |= alike
                met[i] = True
        if met.any():
            keys = [key for key, is_met in zip(_column(group, "key"), met) if is_met]
            node = group[0].column("node")[0].as_py()
            yield pa.RecordBatch.from_arrays([pa.array([node] * len(keys), pa.int64()), pa.array(keys, pa.binary())], schema=_ENTRIES)


def _in_common(sets: list[np.ndarray], rows: np.ndarray):
    """Some of `rows` after others, and how many names each of them shares with each set."""
    names = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), [len(x) for x in sets])
    order = np.argsort(names, kind="stable")
    names, owner = names[order], owner[order]
    # names that occur once are shared by none
    starts = np.append(True, names[1:] != names[:-1])
    shared = ~starts | ~np.append(starts[1:], True)
    column, owner = (np.cumsum(starts & shared) - 1)[shared], owner[shared]
    del names, order, starts, shared
    width = int(column[-1]) + 1 if len(column) else 0
    for first in range(0, len(rows), _ROWS):
        part = rows[first : first + _ROWS]
        out = np.zeros((len(part), len(sets)), np.int32)
        for at in range(0, width, _COLUMNS):
            low, high = np.searchsorted(column, [at, at + _COLUMNS])
            has = np.zeros((len(sets), min(_COLUMNS, width - at)), np.float32)
            has[owner[low:high], column[low:high] - at] = 1
            out += (has[part] @ has.T).astype(np.int32)
        yield part, out


def _linker(percent: int, schema: pa.Schema):
    """Links (u, v) of a group that join its components, from the full sets."""

    def run(batches):
        for group in _groups(batches):
            number, others = _outside(_column(group, "root"))
            sets = [np.frombuffer(names.as_buffer(), np.uint64) for batch in group for names in batch.column("names")]
            if not len(others):
                continue
            size = np.array([len(x) for x in sets])
            found = []
            for part, common in _in_common(sets, others):
                # the least that two sets of these sizes have to share
                least = -(-percent * (size[part][:, None] + size[None, :]) // (100 + percent))
                row, other = np.nonzero((common >= least) & (number[part][:, None] != number[None, :]))
                found.append((part[row], other))
            left, right = (np.concatenate(side) for side in zip(*found))
            # one link between any two components
            _, one = np.unique(np.minimum(number[left], number[right]) * len(number) + np.maximum(number[left], number[right]), return_index=True)
            reps = pa.concat_arrays([batch.column("rep") for batch in group])
            ends = [reps.take(pa.array(side[one])) for side in (left, right)]
            yield pa.RecordBatch.from_arrays(ends, schema=schema)

    return run


def _setter(size: int):
    schema = pa.schema([("key", pa.binary()), ("names", pa.binary())])

    def run(batches):
        for batch in batches:
            wanted = batch.column("key").to_pylist()
            keys, sets = [], []
            for key, names in zip(wanted, sets_of(batch.column("text"), size)):
                if len(names) and _key(names) == key:
                    keys.append(key)
                    sets.append(names.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], schema=schema)

    return run


def _confirmer(percent: int):
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("of_a"), batch.column("of_b")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    keep.append(False)
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _branched(entries: DataFrame, classes: DataFrame, depth: int) -> DataFrame:
    """Entries (node, key, n, above) one level below entries (node, key, n) of that depth."""
    if depth in DOUBLED:
        entries = entries.select(F.explode(F.array("node", F.xxhash64("node", F.lit("again")))).alias("node"), "key", "n")
    entries = entries.join(classes.select("key", "sketch"), "key").select("node", "key", "n", "sketch")
    return saved(entries.mapInArrow(tidy(_deepen), _DEEPER), "nodes")


def _union(frames: list[DataFrame]) -> DataFrame:
    every = frames[0]
    for more in frames[1:]:
        every = every.unionByName(more)
    return every


def _leaves(classes: DataFrame, trees: int) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Entries (node, key) of all small nodes, of the parts of dense ones, and of the dense ones; and the depth reached."""
    entries = saved(classes.select("key", "sketch").mapInArrow(tidy(_planter(trees, 2)), _ENTRY), "nodes")
    entries = entries.withColumn("above", F.lit(None).cast("long"))
    leaves, cut, pieces = [], [], []
    for depth in range(2, _DEEPEST):
        counts = entries.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
        sized = saved(entries.join(counts, "node"), "nodes")
        large = sized.where(F.col("n") > SMALL)
        leaves.append(sized.where(F.col("n") <= SMALL).select("node", "key"))
        dense = large.where((F.col("n") > SHRINK * F.col("above")) | F.lit(depth == _DEEPEST - 1))
        cut.append(dense.select("node", "key"))
        parts = F.ceil(F.col("n") * 2 / SMALL)

        # random parts, and about COMMON entries of the node in each of them
        pieces.append(dense.select(_part("part", F.pmod(F.xxhash64("key", "node"), parts)), "key"))
        common = dense.where(F.pmod(F.xxhash64("node", "key", F.lit("common")), F.col("n")) < COMMON)
        pieces.append(common.select("node", "key", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part")).select(_part("part", F.col("part")), "key"))
        going = large.where(~F.coalesce(F.col("n") > SHRINK * F.col("above"), F.lit(False)))
        if depth == _DEEPEST - 1 or going.limit(1).count() == 0:
            break
        entries = _branched(going.select("node", "key", "n"), classes, depth)
    return _union(leaves), _union(pieces), _union(cut), depth


def _part(label: str, *of) -> Column:
    return F.xxhash64("node", *of, F.lit(label)).alias("node")


def _open(entries: DataFrame, ids: DataFrame) -> DataFrame:
    """Entries of nodes with several components; `others` of the `n` are not in the largest, `top`; all have `names` shingles."""
    rooted = entries.select("node", "key").join(ids.select("key", "root", "size"), "key")
    counts = rooted.groupBy("node", "root").agg(F.count("*").alias("c"), F.sum("size").alias("names"))
    nodes = counts.groupBy("node").agg(F.sum("c").alias("n"), F.sum("names").alias("names"), F.max(F.struct("c", "root")).alias("most")).where("n > most.c")
    return rooted.join(nodes, "node").select("node", "key", "root", "n", "names", F.col("most.root").alias("top"), (F.col("n") - F.col("most.c")).alias("others"))


def _meetings(small: DataFrame, cut: DataFrame, ids: DataFrame, classes: DataFrame, depth: int) -> DataFrame:
    """Entries (node, key) of groups that hold the pairs of different components of small nodes and of cut ones."""
    groups, entries = [], small.unionByName(cut)
    while True:
        sized = saved(_open(entries, ids), "nodes")
        fits = (F.col("n") <= WHOLE) & (F.col("names") <= NAMES)
        groups.append(sized.where(fits).select("node", "key"))
        large = sized.where(~fits)
        if large.isEmpty():
            return _union(groups)
        parts = F.ceil(F.greatest(F.col("n") * 2 / WHOLE, F.col("names") * 2 / NAMES))
        own = F.pmod(F.xxhash64("key", "node", F.lit("own")), parts)
        every_part = F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part")
        # all but few are one component: these few meet every other class
        few = F.col("others") <= SMALL // 2
        groups.append(large.where(few & (F.col("root") == F.col("top"))).select(_part("few", own), "key"))
        groups.append(large.where(few & (F.col("root") != F.col("top"))).select("node", "key", every_part).select(_part("few", F.col("part")), "key"))
        # few classes with many shingles (or at the end): every part meets every other
        last = depth >= _DEEPEST
        whole = ~few & ((F.col("n") <= WHOLE) | F.lit(last))
        met = large.where(whole).select("node", "key", own.alias("own"), every_part).where("own <> part")
        groups.append(met.select(_part("met", F.least("own", "part"), F.greatest("own", "part")), "key"))
        going = large.where(~few & ~whole)
        if last or going.isEmpty():
            return _union(groups)
        entries = _branched(going.select("node", "key", "n"), classes, depth)
        depth += 1


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = 5, percent: int = 75, trees: int = 8
) -> DataFrame:
    """`doc_id`, `n_shingles`, `component_id` (the smallest id reachable) and `kept` of every row of `docs`."""
    spark = prepare(docs.sparkSession)
    rows = docs.select(docs[f"`{id_column}`"].alias("doc_id"), docs[f"`{text_column}`"].cast("binary").alias("text"))
    from tableprobe.llm.exchange import empty_like

    schema = T.StructType([rows.schema["doc_id"], *T.StructType.fromDDL(_SKETCH).fields])
    sketches = saved(rows.mapInArrow(tidy(_sketcher(size, empty_like(schema))), schema), "sketches")
    classes = sketches.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("key")
    classes = saved(classes.agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch"), F.first("n_shingles").alias("size")), "classes")
    leaves, parts, cut, depth = _leaves(classes, trees)
    leaves, parts, cut = saved(leaves, "leaves"), saved(parts, "parts"), saved(cut, "dense")

    def by_node(entries: DataFrame) -> DataFrame:
        return entries.repartition("node").sortWithinPartitions("node")

    members = leaves.unionByName(parts).join(classes.select("key", "sketch"), "key")
    pairs = saved(by_node(members).mapInArrow(tidy(_pairs), _PAIR).distinct(), "pairs")

    def sets_for(keys: DataFrame) -> DataFrame:
        wanted = keys.distinct().join(classes.select("key", "rep"), "key").select("key", F.col("rep").alias("doc_id"))
        found = rows.join(wanted, "doc_id").select("key", "text").mapInArrow(tidy(_setter(size)), "key binary, names binary")
        return saved(found.dropDuplicates(["key"]), "sets")

    sets = sets_for(pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))))
    sided = pairs.join(sets.select(F.col("key").alias("a"), F.col("names").alias("of_a")), "a")
    sided = sided.join(sets.select(F.col("key").alias("b"), F.col("names").alias("of_b")), "b").select("a", "b", "of_a", "of_b")
    links = sided.mapInArrow(tidy(_confirmer(percent)), _PAIR)
    reps = classes.select("key", "rep")
    links = links.join(reps.select(F.col("key").alias("a"), F.col("rep").alias("u")), "a").join(reps.select(F.col("key").alias("b"), F.col("rep").alias("v")), "b")
    links = saved(links.select("u", "v"), "links")
    roots = connected_components(links)
    ids = classes.join(roots, F.col("rep") == F.col("node"), "left").select("key", "rep", "sketch", "size", F.coalesce("root", "rep").alias("root"))
    ids = saved(ids, "roots")

    open_groups = _meetings(leaves, cut, ids, classes, depth).distinct()
    suspects = by_node(open_groups.join(ids.select("key", "root", "sketch"), "key")).mapInArrow(tidy(_suspects), _ENTRY)
    suspects = saved(suspects, "suspects")
    if not suspects.isEmpty():
        full = sets.unionByName(sets_for(suspects.select("key").join(sets.select("key"), "key", "left_anti")))
        met = suspects.join(ids.select("key", "root", "rep"), "key").join(full, "key")
        link = T.StructType([T.StructField(name, classes.schema["rep"].dataType) for name in ("u", "v")])
        more = by_node(met.select("node", "root", "rep", "names")).mapInArrow(tidy(_linker(percent, empty_like(link))), link)
        roots = connected_components(links.unionByName(saved(more, "links")))
    found = sketches.select("doc_id", "n_shingles", "key").join(classes.select("key", "rep"), "key", "left")
    found = found.join(roots, F.col("rep") == F.col("node"), "left")
    component = F.coalesce("root", "rep", "doc_id")
    return found.select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), component).alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )
