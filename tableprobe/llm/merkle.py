"""Merkle manifest of a table: a hash tree for every group of rows, one tree over the groups, and a proof for each row.

Every level is a table of nodes (group, position, hash). A node meets its siblings by equijoins on their computed positions: the position
with its last bit flipped in a binary tree, one join per slot offset otherwise; the nodes in slot zero then emit the parents. The number of nodes
of each group on each level follows from that of its leaves, so nothing is counted on the way up and no run of nodes is gathered. Proofs are
handed down from the root, one join on (group, position of the parent) a level.

Leaves are numbered without a window over a group: rows are dealt by ranges of (group, order, leaf), numbered inside their range, and the sizes of
the ranges, one row each, are summed up. So a group with a third of all rows is many ranges. Equal rows are told apart by a stored random
number, which evens out their ranges; whichever of them gets which place, the rows that come out are the same.

Defined cases. Nulls: a null group is a group of its own, before all others; a null order value comes first in its group; a null field of
`row_hash` is `-`. An empty text has length 0 and is no null. Repeated rows are leaves each. An empty table gives an empty manifest. A group of one leaf has that
leaf as its subroot; a run of one node in a longer level is hashed like any other. All columns of the table are
kept in the struct `row`, so their names can't clash. Texts are read once, whole, and only their hashes are shuffled where `row` leaves them out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tableprobe.llm.common import prepare, saved

#: Rows of a range in which leaves are numbered by one task.
RANGE_ROWS = 100_000

#: One step of a proof: the hashes of the siblings before and after the node, end to end.
STEP = "struct<left: string, right: string>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of texts, end to end."""
    return F.sha2(F.concat(*parts), 256)


def row_hash(*columns: Column) -> Column:
    """The hash of a row: for each value `-` if null, else its length in bytes, `:` and the value as text."""
    texts = [c.cast("string") for c in columns]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def proof_text(path: Column) -> Column:
    """The siblings of a proof, level by level and left to right."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), "")


def fold(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and its proof."""
    return F.aggregate(path, leaf, lambda node, step: digest(step["left"], node, step["right"]))


def manifest(rows: DataFrame, group: Column, order: Sequence[Column], leaf: Column, arity: int = 3) -> DataFrame:
    """Every row as the struct `row`, with `leaf`, `subroot`, `root` and `path`, the steps of its proof from the leaf to the root.

    `leaf` is the hash of a row; leaves of a group ascend by `order`, groups by their text in bytes. `arity` consecutive nodes have one parent.
    """
    if arity < 2:
        raise ValueError("a node has two children or more")
    prepare(rows.sparkSession)
    kept = F.struct(*[rows[f"`{c}`"] for c in rows.columns]).alias("row")
    # the mark before the text keeps null apart, and first
    name = F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit("-")).alias("g")
    leaves = saved(rows.select(kept, name, F.struct(*order).alias("place"), leaf.alias("hash"), F.rand(7).alias("tie")), "merkle-leaves")
    levels, tops = _grow(_numbered(leaves), arity)
    over = tops.withColumns({"place": F.struct("g"), "tie": F.lit(0.0), "row": F.struct("g"), "g": F.lit("")})
    high, roots = _grow(_numbered(saved(over, "merkle-subroots")), arity)
    root = roots.first()  # one group, so one row at most
    ways = _ways(high, roots.select("g", F.array().cast(f"array<{STEP}>").alias("path"), F.col("hash").alias("subroot")))
    ways = ways.select(F.col("row.g").alias("g"), "path", F.col("leaf").alias("subroot"))
    out = _ways(levels, saved(ways, "merkle-ways"))
    return out.select("row", "leaf", "subroot", F.lit(root.hash if root else None).cast("string").alias("root"), "path")


def _numbered(leaves: DataFrame) -> DataFrame:
    """Leaves with their position `i` in the group, from 0, and the size `n` of the group."""
    count = leaves.count()
    keys = ["g", "place", "hash", "tie"]
    parts = -(-count // RANGE_ROWS)
    # an explicit number of ranges is kept as it is, so that ids rise with the order
    dealt = leaves.repartitionByRange(max(parts, 1), *keys).sortWithinPartitions(*keys)
    dealt = dealt.select("row", "g", "hash", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("seq"))
    dealt = saved(dealt, "merkle-dealt")
    sizes = dealt.groupBy("g", "part").agg(F.count("*").alias("rows"), F.min("seq").alias("first"))
    # a group has a row per range here, not per leaf
    ahead = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("g")
    starts = sizes.select(
        "g", "part", (F.coalesce(F.sum("rows").over(ahead), F.lit(0)) - F.col("first")).alias("start"), F.sum("rows").over(whole).alias("n")
    )
    return dealt.join(starts, ["g", "part"]).select("g", (F.col("seq") + F.col("start")).alias("i"), "n", "hash", "row")


def _siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """Nodes with the hashes of their siblings, joined up to `left` and `right`, and the position `up` of their parent."""
    up = F.floor(F.col("i") / arity)
    slot = F.col("i") - up * arity
    out = nodes.withColumns({"up": up, "slot": slot})
    if arity == 2:
        places = [F.col("i").bitwiseXOR(F.lit(1).cast("long"))]
    else:
        places = [up * arity + (slot + shift) % arity for shift in range(1, arity)]
    other = nodes.select(F.col("g").alias("sg"), F.col("i").alias("si"), F.col("hash").alias("sh"))
    for k, place in enumerate(places):
        out = out.withColumn("at", place)
        out = out.join(other, (F.col("g") == F.col("sg")) & (F.col("at") == F.col("si")), "left")
        out = out.withColumns({f"at{k}": F.col("at"), f"hash{k}": F.col("sh")}).drop("sg", "si", "sh", "at")
    met = F.array(*[F.struct(F.col(f"at{k}").alias("at"), F.col(f"hash{k}").alias("hash")) for k in range(len(places))])
    # slots past the end of the last run have no node
    met = F.array_sort(F.filter(met, lambda s: s["hash"].isNotNull()))

    def side(keep) -> Column:
        return F.array_join(F.transform(F.filter(met, keep), lambda s: s["hash"]), "")

    step = F.struct(side(lambda s: s["at"] < F.col("i")).alias("left"), side(lambda s: s["at"] > F.col("i")).alias("right")).alias("step")
    payload = ["row"] if "row" in nodes.columns else []
    return out.select("g", "i", "n", "hash", "up", "slot", step, *payload)


def _grow(nodes: DataFrame, arity: int) -> tuple[list[tuple[DataFrame, DataFrame]], DataFrame]:
    """Per level the nodes that have a parent, with their step, and the last nodes of groups that end there; and all last nodes."""
    largest = nodes.agg(F.max("n").alias("n")).first().n or 0
    levels = []
    tops = None
    while True:
        ended = nodes.where("n = 1")
        top = ended.select("g", "hash")
        tops = top if tops is None else tops.unionByName(top)
        if largest <= 1:
            levels.append((None, ended))
            return levels, saved(tops, "merkle-tops")
        met = saved(_siblings(nodes.where("n > 1"), arity), "merkle-level")
        levels.append((met, ended))
        above = F.floor((F.col("n") + (arity - 1)) / arity).alias("n")
        nodes = met.where("slot = 0").select("g", F.col("up").alias("i"), above, digest(F.col("hash"), F.col("step.right")).alias("hash"))
        largest = -(-largest // arity)


def _ways(levels: list[tuple[DataFrame, DataFrame]], tops: DataFrame) -> DataFrame:
    """Leaves with `row`, `leaf`, the steps of their `path` to the root, and their group's `subroot`."""
    known = None
    for depth, (met, ended) in reversed(list(enumerate(levels))):
        carried = ["row", F.col("hash").alias("leaf")] if depth == 0 else []
        here = ended.join(tops, "g").select("g", "i", "path", "subroot", *carried)
        if met is not None:
            above = known.select(F.col("g").alias("ug"), F.col("i").alias("ui"), F.col("path").alias("rest"), "subroot")
            joined = met.join(above, (F.col("g") == F.col("ug")) & (F.col("up") == F.col("ui")))
            here = here.unionByName(joined.select("g", "i", F.concat(F.array("step"), "rest").alias("path"), "subroot", *carried))
        # a plan over all levels would hold the broadcasts of all of them in the driver at once
        known = saved(here, "merkle-paths") if depth else here
    return known
