"""Merkle manifest of a table: one tree per group of rows, and one tree over the groups' roots.

Leaves get their places by a range sort of narrow rows and the running sizes of its partitions. A level then is a window over blocks of places: lead and lag at
fixed offsets 1 to 7, masked by a node's slot in its run of eight and by the run's length, are its siblings; the first child of a run hashes the parent. Blocks
are cut at multiples of eight, so no run crosses one and a group with any share of the rows is spread over its blocks. Paths come down from the root by joins on the run,
one row per eight nodes; no task and not the driver holds a group.

Rows. Null columns have their own mark. Leaves of one group ascend by id, null first; rows of one id ascend by leaf, so repeated rows, which have equal leaves,
may stand in any order. Every row is a leaf. An empty table has no row and no root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askloom.llm.common import partitions, store

FAN = 8
BLOCK = FAN ** 3
"""Places of one window; a multiple of FAN."""
PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` if null, else length in UTF-8 bytes, colon, value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def place(nodes: DataFrame) -> DataFrame:
    """Adds ``pos`` (from 0, by ``ord``) and ``total`` within ``grp``; ``ord`` may repeat only in rows that are alike.

    The rows are range-sorted by (grp, ord, tie) and stored with their number in the sort; sizes of (partition, group) are summed up in order. There are at most as many
    sizes as partitions and groups together. ``tie`` parts rows that repeat, so these are no hot key.
    """
    keys = ["grp", "ord", "tie"]
    ranged = nodes.repartitionByRange(partitions(nodes.sparkSession), *keys).sortWithinPartitions(*keys)
    numbered = store(ranged.drop("ord", "tie").withColumn("seq", F.monotonically_increasing_id()), "merkle-sorted")
    numbered = numbered.withColumn("sorted_in", F.shiftright("seq", 33))
    sizes = numbered.groupBy("grp", "sorted_in").agg(F.count(F.lit(1)).alias("size"), F.min("seq").alias("first"))
    group = Window.partitionBy("grp")
    before = F.coalesce(F.sum("size").over(group.orderBy("sorted_in").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("grp", "sorted_in", (before - F.col("first")).alias("shift"), F.sum("size").over(group).alias("total"))
    return numbered.join(starts, ["grp", "sorted_in"]).withColumn("pos", F.col("seq") + F.col("shift")).drop("seq", "sorted_in", "shift")


def with_siblings(nodes: DataFrame) -> DataFrame:
    """Adds ``left`` and ``right``: the digests of the other nodes of a node's run, before and after it, in order."""
    window = Window.partitionBy("grp", F.floor(F.col("pos") / BLOCK)).orderBy("pos")
    slot = F.col("pos") % FAN
    length = F.least(F.lit(FAN), F.col("total") - F.col("pos") + slot)
    left = [F.when(slot >= k, F.lag("node", k).over(window)).otherwise("") for k in range(FAN - 1, 0, -1)]
    right = [F.when(slot + k < length, F.lead("node", k).over(window)).otherwise("") for k in range(1, FAN)]
    return nodes.withColumns({"left": F.concat(*left), "right": F.concat(*right)})


def grow(nodes: DataFrame) -> list[DataFrame]:
    """The levels of all groups' trees, leaves first: (grp, pos, total, node, left, right). The node of a group whose ``total`` is 1 is its top."""
    largest = nodes.agg(F.max("total")).first()[0] or 0
    levels = [with_siblings(nodes)]
    while largest > 1:
        firsts = levels[-1].filter((F.col("total") > 1) & (F.col("pos") % FAN == 0))
        parents = firsts.select("grp", (F.col("pos") / FAN).cast("long").alias("pos"), F.ceil(F.col("total") / FAN).alias("total"), digest(F.col("node"), F.col("right")).alias("node"))
        levels.append(store(with_siblings(parents), f"merkle-level-{len(levels)}"))
        largest = -(-largest // FAN)
    return levels


def tops(nodes: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(grp, top, depth): the root of every group's tree and the level it stands on."""
    found = nodes.filter("total = 1").select("grp", F.col("node").alias("top"), F.lit(0).alias("depth"))
    for depth, level in enumerate(levels[1:], 1):
        found = found.unionByName(level.filter("total = 1").select("grp", F.col("node").alias("top"), F.lit(depth).alias("depth")))
    return found


def paths(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """The leaves with ``path``, the siblings from the leaf's run up to the top of its group and on as ``above`` (grp, top, depth, path) says, and ``top``."""
    def ended(depth: int) -> DataFrame:
        return above.filter(F.col("depth") == depth).select("grp", F.lit(0).cast("long").alias("run"), "path", "top")

    up = None
    for depth, level in reversed(list(enumerate(levels))):
        up = ended(depth) if up is None else up.unionByName(ended(depth))
        own = F.when(F.col("total") > 1, F.array(F.struct("left", "right"))).otherwise(F.array().cast(PATH))
        met = level.withColumn("run", (F.col("pos") / FAN).cast("long")).join(up, ["grp", "run"]).withColumn("path", F.concat(own, "path"))
        up = met.select("grp", F.col("pos").alias("run"), "path", "top") if depth else met.drop("run")
    return up


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.aggregate(path, leaf, lambda node, step: digest(step["left"], node, step["right"]))


def tampered(doc_id: Column, text: Column) -> Column:
    """The text with A-Z in lower case where the CRC-32 of the decimal id is divisible by three, else the text; null ids are never tampered with."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.crc32(doc_id.cast("string")) % 3 == 0, F.translate(text, upper, upper.lower())).otherwise(text)


def manifest(documents: DataFrame) -> DataFrame:
    """Per row of ``documents``: doc_id, leaf, subroot (of its lang), root, proof_sha256, folded_root of the tampered row, verified."""
    def leaf(text: Column) -> Column:
        return digest(*[field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], field(text))

    changed = tampered(F.col("doc_id"), F.col("text"))
    leaves = store(documents.select(
        F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")).alias("grp"), "doc_id", leaf(F.col("text")).alias("node"),
        F.when(changed != F.col("text"), leaf(changed)).alias("other"), F.monotonically_increasing_id().alias("tie")), "merkle-leaves")
    nodes = place(leaves.withColumn("ord", F.struct("doc_id", "node")))
    levels = grow(nodes)
    subroots = store(tops(nodes, levels), "merkle-subroots")
    roots = place(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("ord"), F.col("top").alias("node"), F.col("grp").alias("tie"), F.col("grp").alias("lang"), F.col("depth").alias("below")))
    upper = grow(roots)
    whole = store(tops(roots, upper), "merkle-root")
    root = whole.first()
    above = store(paths(upper, whole.withColumn("path", F.array().cast(PATH))).select(
        F.col("lang").alias("grp"), F.col("node").alias("top"), F.col("below").alias("depth"), "path"), "merkle-above")
    proofs = paths(levels, above)
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    return proofs.select(
        "doc_id", F.col("node").alias("leaf"), F.col("top").alias("subroot"), F.lit(root["top"] if root else None).cast("string").alias("root"),
        F.sha2(siblings, 256).alias("proof_sha256"), fold(F.coalesce("other", "node"), F.col("path")).alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))
