"""A trie of conversations' shared beginnings, by prefix-doubling names.

A block of 2^k turns that starts at a multiple of 2^k has a dense name, that of the
pair of its halves' names; so a round of names costs one grouping and one join, and
there are as many rounds as the longest conversation's length has bits.  The first d
turns are the blocks of d's binary digits, largest first: their names are composed
in rounds from the highest digit down, each prefix from a shorter one and one block.
Equal beginnings, and only they, get one name, and a name is a node.

No round holds a conversation, a node or a level in one task: names that very many
rows share meet their rows by broadcast (of them there are few), sums up a
conversation's path are taken in blocks of turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.hot import indexed, lookup, ordered, ranked
from .scratch import Scratch
from .words import trimmed

#: Turns of a block of a conversation when sums up its path are taken; ids of a block when ends are hashed.
BLOCK, ENDS = 1024, 512


def positions(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv, pos, digest, chars) of every turn, numbered from 0 in its conversation by turn, null first.

    Null roles and texts are empty.  Turns of one number follow by the digest of
    role and text.  Rows without a conversation go.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    # The length of the role keeps the two apart.
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.char_length(text).cast("long").alias("chars"))
    placed, groups = ranked(rows, ["conv"], [F.col("turn").asc_nulls_first(), "digest"], scratch, "placed")
    groups = scratch.write(groups, "groups")
    total = groups.agg(F.sum("n")).first()[0] or 0
    return lookup(placed, groups, ["conv"], "n", total).select("conv", (F.col("at") - F.col("first")).alias("pos"), "digest", "chars")


def rebuilt(turns: DataFrame, scratch: Scratch, share: int = 6, family: int = 100) -> tuple[DataFrame, DataFrame]:
    """(turns by position, all conversations) after each takes the first h turns of its family's first conversation.

    h is the conversation's crc32 modulo ``share``; its own turns after its first h follow.
    """
    own = scratch.write(positions(turns, scratch), "own")
    sizes = own.groupBy("conv").agg(F.count("*").alias("n"))
    head = (F.crc32(F.col("conv").cast("string").cast("binary")) % share).alias("h")
    convs = sizes.select("conv", "n", head, (F.col("conv") - F.col("conv") % family).alias("base"))
    first = sizes.select(F.col("conv").alias("base"), F.least("n", F.lit(share - 1)).alias("have"))
    convs = convs.join(first, "base", "left").withColumn("taken", F.least("h", F.coalesce("have", F.lit(0))))
    convs = scratch.write(convs.select("conv", "n", "base", "h", "taken"), "convs")
    lead = convs.where("taken > 0").join(own.where(F.col("pos") < share - 1).withColumnRenamed("conv", "base"), "base").where("pos < taken").select("conv", "pos", "digest", "chars")
    total = convs.agg(F.sum("n")).first()[0] or 0
    rest = lookup(own, convs.select("conv", "h", "taken", "n"), ["conv"], "n", total).where("pos >= h").select("conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "digest", "chars")
    return scratch.write(lead.unionByName(rest), "turns"), convs.select("conv")


def _named(rows: DataFrame, keys: list[str], name: str, scratch: Scratch, label: str, start: int) -> tuple[DataFrame, int]:
    """``rows`` (written) with a dense name, above ``start``, for each different value of the keys; and the largest name."""
    groups = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    groups = indexed(groups, scratch, f"{label}-names", "_at").withColumn("_at", F.col("_at") + start + 1).withColumnRenamed("_at", name)
    n, total = groups.agg(F.max(name), F.sum("_n")).first()
    return lookup(rows, groups, keys, "_n", total or 0), n or start


def prefix_names(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv, depth, node) for each first 1, 2, ... turns of each conversation; nodes of equal beginnings are equal, and above 0."""
    longest = (turns.agg(F.max("pos")).first()[0] or 0) + 1
    levels = longest.bit_length()
    # Blocks of 2^k turns: (conv, i, name), i their start in blocks.
    first, top = _named(turns.select("conv", F.col("pos").alias("i"), "digest"), ["digest"], "name", scratch, "b0", 0)
    blocks = [scratch.write(first.select("conv", "i", "name"), "b0")]
    for k in range(1, levels):
        half = F.col("i").bitwiseAND(1)
        # Two rows at most, a bounded group; an odd block at the end has no partner.
        pair = blocks[-1].groupBy("conv", F.shiftright("i", 1).alias("i")).agg(F.max(F.when(half == 0, F.col("name"))).alias("a"), F.max(F.when(half == 1, F.col("name"))).alias("b"))
        pair = scratch.write(pair.where("b is not null"), f"p{k}")
        named, top = _named(pair, ["a", "b"], "name", scratch, f"b{k}", top)
        blocks.append(scratch.write(named.select("conv", "i", "name"), f"b{k}"))
    # Prefixes of d turns, d a multiple of 2^k, from those of d - 2^k and the block there.
    done = None
    for k in range(levels - 1, -1, -1):
        odd = blocks[k].where(F.col("i").bitwiseAND(1) == 0).select("conv", (F.col("i") * (1 << k)).alias("from"), F.col("name").alias("b"))
        start = odd.where("from = 0").withColumn("a", F.lit(0).cast("long"))
        if done is not None:
            longer = odd.where("from > 0").join(done.select("conv", F.col("depth").alias("from"), F.col("node").alias("a")), ["conv", "from"])
            start = start.unionByName(longer)
        pair = scratch.write(start.select("conv", (F.col("from") + (1 << k)).alias("depth"), "a", "b"), f"q{k}")
        # A block's name tells its length, a prefix's name its depth: the pair tells both.
        named, top = _named(pair, ["a", "b"], "node", scratch, f"n{k}", top)
        new = scratch.write(named.select("conv", "depth", "node"), f"n{k}")
        done = new if done is None else done.unionByName(new)
    return done


def _joined_hash(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's parts, which follow one another, with commas between them; no part is kept."""
    now, state = None, None
    for batch in rows:
        for node, part in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if node != now:
                if now is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([state.hexdigest()])], ["node", "ends"])
                now, state = node, hashlib.sha256()
            else:
                state.update(b",")
            state.update(part.encode())
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([state.hexdigest()])], ["node", "ends"])


def _ends(ends: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, ends): the digest of the ids of the conversations that end at a node, in order."""
    placed = ordered(ends, ["node", "conv"], scratch, "ends")
    parts = placed.groupBy("node", F.expr(f"at div {ENDS}").alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))
    parts = scratch.write(parts, "parts")
    many = parts.groupBy("node").count().where("count > 1").select("node")
    # A hash is taken from front to back; what one task must read of a node is its parts, one after the other.
    long = parts.join(many, "node", "left_semi").repartition("node").sortWithinPartitions("node", "part").select("node", "ids")
    long = long.mapInArrow(trimmed(_joined_hash), "node long, ends string")
    return parts.join(many, "node", "left_anti").select("node", F.sha2("ids", 256).alias("ends")).unionByName(long)


def prefix_trie(turns: DataFrame, convs: DataFrame, scratch: Scratch) -> DataFrame:
    """The nodes of the trie of ``turns`` (conv, pos, digest, chars), of all ``convs`` (conv), also those without turns.

    conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs,
    n_children, n_leaves (childless nodes at or below), saved_tokens (over the nodes at
    or below, members but one times code points of the last text), ends_sha256.

    Conversations that are equal share all nodes.  Empty texts are turns like others.
    Without conversations there is no node.
    """
    path = prefix_names(turns, scratch).withColumnRenamed("depth", "d")
    chars = turns.select("conv", (F.col("pos") + 1).alias("d"), "chars")
    root = convs.select("conv", F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("node"), F.lit(0).cast("long").alias("chars"))
    path = scratch.write(path.join(chars, ["conv", "d"]).select("conv", "d", "node", "chars").unionByName(root), "path")
    nodes = scratch.write(path.groupBy("node").agg(F.min("conv").alias("conv"), F.max("d").alias("d"), F.count("*").alias("n"), F.max("chars").alias("chars")), "nodes")
    # The parent lies a turn before in the smallest member.
    up = nodes.where("d > 0").select("node", "conv", (F.col("d") - 1).alias("d")).join(path.select("conv", "d", F.col("node").alias("parent")), ["conv", "d"])
    up = scratch.write(up.select("node", "parent"), "up")
    kids = scratch.write(up.groupBy("parent").agg(F.count("*").alias("kids")).join(nodes.select(F.col("node").alias("parent"), F.col("conv").alias("parent_conv_id")), "parent"), "kids")
    n_up = kids.agg(F.sum("kids")).first()[0] or 0
    above = lookup(up, kids, ["parent"], "kids", n_up).select("node", "parent_conv_id")

    # What a node adds is laid on its smallest member's turn: sums from a turn to the end of each
    # conversation, added up over a node's members, are then sums over its subtree.
    own = nodes.join(kids.select(F.col("parent").alias("node"), "kids"), "node", "left").select("node", "conv", "d", ((F.col("n") - 1) * F.col("chars")).alias("saves"), F.col("kids").isNull().cast("long").alias("leaf"))
    laid = path.join(own.drop("node"), ["conv", "d"], "left").fillna(0, ["saves", "leaf"]).withColumn("part", F.expr(f"d div {BLOCK}"))
    laid = scratch.write(laid.select("conv", "d", "node", "part", "saves", "leaf"), "laid")
    back = W.partitionBy("conv").orderBy(F.desc("part")).rowsBetween(W.unboundedPreceding, -1)
    later = laid.groupBy("conv", "part").agg(F.sum("saves").alias("s"), F.sum("leaf").alias("l"))
    later = later.select("conv", "part", F.coalesce(F.sum("s").over(back), F.lit(0)).alias("later_s"), F.coalesce(F.sum("l").over(back), F.lit(0)).alias("later_l"))
    within = W.partitionBy("conv", "part").orderBy(F.desc("d"))
    sums = laid.select("conv", "part", "node", F.sum("saves").over(within).alias("s"), F.sum("leaf").over(within).alias("l")).join(later, ["conv", "part"])
    sums = sums.groupBy("node").agg(F.sum(F.col("s") + F.col("later_s")).alias("saved_tokens"), F.sum(F.col("l") + F.col("later_l")).alias("n_leaves"))

    last = path.groupBy("conv").agg(F.max("d").alias("d"))
    ends = _ends(path.join(last, ["conv", "d"]).select("node", "conv"), scratch)
    out = nodes.join(sums, "node").join(above, "node", "left").join(kids.select(F.col("parent").alias("node"), "kids"), "node", "left").join(ends, "node", "left")
    return out.select(
        F.col("conv").alias("conv_id"), F.col("d").alias("depth"), "parent_conv_id", F.col("n").alias("n_convs"), F.coalesce("kids", F.lit(0)).cast("long").alias("n_children"), "n_leaves",
        "saved_tokens", F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """``prefix_trie`` of a table conv_id, turn, role, text as it stands; other columns don't matter."""
    scratch = Scratch(conversations.sparkSession, "trie")
    own = scratch.write(positions(conversations, scratch), "own")
    return prefix_trie(own, own.select("conv").distinct(), scratch)
