"""Prefix trie of conversations by SQL ROLLUP over positional turn ids.

A conversation's turns become ids (a digest of role and text).  The turns at depths
``WIDTH * b`` to ``WIDTH * b + WIDTH - 1`` are the columns t0, t1, ... of its row in block b
(t0 of block 0 is the textless root), and one statement

    GROUP BY block, prior, t0, ROLLUP (t1, ..., t7)

aggregates all prefixes of all lengths together; grouping_id tells the depth.  ``prior``
stands for the turns in all blocks before, so (block, prior, t0) is the node where the block
goes on.  It is a digest of digests, taken in groups of ``FAN`` blocks level by level, so it
needs a logarithmic number of steps and no task reads a whole conversation.

The rollup runs twice.  The first gives each prefix its owner, its smallest member.  A
conversation owns its nodes from some depth on: there it leaves the nodes of smaller ones.
With that depth, sums over subtrees are sums over members, which the second rollup takes:
a leaf counts for its owner, and bytes of a member count until it leaves.

Edge cases: turns are ordered by turn, null first, ties by role, then by digest; null role
or text is empty; rows without a conv_id belong to no conversation and are left out;
repeated rows are turns of their own; very long texts are only digested and measured;
an empty table has no nodes; other columns are not read.  One conversation or one prefix may
hold any share of the rows: positions are numbered in range parts, joins carry the number
of a stretch of the conversation, and all else is aggregates with partial sums.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismlake.llm.common import discard, materialize, text_or_empty
from prismlake.llm.conversations import crc32_mod, ordered_digest, sorted_parts

WIDTH = 8                  # depths in a block
FAN = 64                   # blocks digested together
STRETCH = 1 << 15          # turns of one conversation that meet its own row in one task
HEADS = 9                  # a rebuilt conversation takes up to HEADS - 1 turns of its base
FAMILY = 5                 # conversations that share a base

START = F.lit(bytearray(16))


@dataclass
class Trie:
    """``nodes``: one row per node.  ``ends``: (conv_id, depth, member) for each conversation
    that ends at the node (conv_id, depth)."""
    nodes: DataFrame
    ends: DataFrame


def _digest(*parts: Column) -> Column:
    return F.unhex(F.md5(F.concat(*parts)))


def _turns(convs: DataFrame) -> DataFrame:
    """Turns in order: conv_id, pos (from 0), tid, bytes, before (bytes of the turns before)."""
    role, text = text_or_empty("role").cast("binary"), text_or_empty("text").cast("binary")
    tid = _digest(F.concat(F.octet_length(role).cast("string").cast("binary"), F.lit(bytearray(b":")), role, text))
    rows = convs.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", text_or_empty("role").alias("role"), tid.alias("tid"),
                                                            F.octet_length(text).cast("long").alias("bytes"))
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("tid").asc()]
    parts = sorted_parts(rows, "conv_id", order)
    earlier = Window.partitionBy("conv_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = (parts.groupBy("conv_id", "_part").agg(F.count(F.lit(1)).alias("_n"), F.sum("bytes").alias("_b"))
             .select("conv_id", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_first"),
                     F.coalesce(F.sum("_b").over(earlier), F.lit(0)).alias("_before")))
    inside = Window.partitionBy("conv_id", "_part").orderBy("_i")
    numbered = parts.select("conv_id", "_part", "tid", "bytes", (F.row_number().over(inside) - 1).alias("_i"),
                            (F.sum("bytes").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("bytes")).alias("_s"))
    turns = materialize(numbered.join(first, ["conv_id", "_part"]).select(
        "conv_id", (F.col("_first") + F.col("_i")).alias("pos"), "tid", "bytes", (F.col("_before") + F.col("_s")).alias("before")))
    discard(parts)
    return turns


def _rebuild(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, length, total bytes) and their rebuilt turns (conv_id, length,
    depth, tid, before), the root of each as depth 0."""
    item = F.struct("pos", "tid", "bytes", "before")
    own = turns.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("own_bytes"),
        F.sort_array(F.collect_list(F.when(F.col("pos") < HEADS - 1, item))).alias("head"))
    base = own.select(F.col("conv_id").alias("base_id"), F.col("head").alias("base_head"))
    h = crc32_mod(F.col("conv_id").cast("string"), HEADS)
    convs = (own.withColumn("h", h).withColumn("base_id", F.col("conv_id") - F.col("conv_id") % FAMILY).join(base, "base_id", "left")
             .withColumn("taken", F.slice(F.coalesce("base_head", F.slice("head", 1, 0)), F.lit(1), F.col("h")))
             .withColumn("skipped", F.slice("head", F.lit(1), F.col("h"))))
    total = lambda items: F.aggregate(items, F.lit(0).cast("long"), lambda acc, x: acc + x["bytes"])
    convs = materialize(convs.select(
        "conv_id", "h", "taken", F.size("taken").alias("from_base"), total("taken").alias("base_bytes"), total("skipped").alias("skipped_bytes"),
        (F.size("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("long").alias("length"),
        (total("taken") + F.col("own_bytes") - total("skipped")).alias("total"), "n"))
    root = convs.select("conv_id", "length", F.lit(0).cast("long").alias("depth"), F.lit(bytearray()).alias("tid"), F.lit(0).cast("long").alias("before"))
    heads = convs.select("conv_id", "length", F.explode("taken").alias("x")).select(
        "conv_id", "length", (F.col("x.pos") + 1).alias("depth"), "x.tid", "x.before")
    stretches = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / STRETCH))).alias("stretch")
    rest = (turns.withColumn("stretch", F.floor(F.col("pos") / STRETCH))
            .join(convs.select("conv_id", "h", "from_base", "base_bytes", "skipped_bytes", "length", stretches), ["conv_id", "stretch"])
            .where(F.col("pos") >= F.col("h"))
            .select("conv_id", "length", (F.col("pos") - F.col("h") + F.col("from_base") + 1).alias("depth"), "tid",
                    (F.col("before") - F.col("skipped_bytes") + F.col("base_bytes")).alias("before")))
    return convs.select("conv_id", "length", "total"), root.unionByName(heads).unionByName(rest)


def _prior_keys(ids: DataFrame) -> DataFrame:
    """For (conv_id, i, id) with i = 0, 1, ...: (conv_id, i, key), a digest of the ids up to
    i, that one included."""
    groups = materialize(ids.groupBy("conv_id", F.floor(F.col("i") / FAN).alias("g")).agg(F.sort_array(F.collect_list(F.struct("i", "id"))).alias("xs")))
    joined = lambda xs: F.aggregate(xs, F.lit(bytearray()), lambda acc, x: F.concat(acc, x["id"]))
    if groups.where("g > 0").isEmpty():
        placed = groups.withColumn("before", START)
    else:
        above = _prior_keys(groups.select("conv_id", F.col("g").alias("i"), _digest(joined("xs")).alias("id")))
        placed = (groups.join(above.select("conv_id", (F.col("i") + 1).alias("g"), F.col("key").alias("before")), ["conv_id", "g"], "left")
                  .withColumn("before", F.coalesce("before", START)))
    numbers = F.sequence(F.lit(1), F.size("xs"))
    keys = F.transform(numbers, lambda k: F.struct(
        F.element_at("xs", k)["i"].alias("i"), _digest(F.col("before"), joined(F.slice("xs", F.lit(1), k))).alias("key")))
    return placed.select("conv_id", F.explode(keys).alias("x")).select("conv_id", "x.i", "x.key")


def _blocks(rebuilt: DataFrame) -> DataFrame:
    """One row per conversation and block: conv_id, length, block, prior, t0 .., q (the bytes
    before each of these turns)."""
    slots = rebuilt.withColumn("block", F.floor(F.col("depth") / WIDTH)).groupBy("conv_id", "length", "block").agg(
        F.sort_array(F.collect_list(F.struct("depth", "tid", "before"))).alias("xs"))        # at most WIDTH turns
    wide = materialize(slots.select("conv_id", "length", "block", *(F.get("xs", F.lit(j))["tid"].alias(f"t{j}") for j in range(WIDTH)),
                                    F.transform("xs", lambda x: x["before"]).alias("q")))
    full = wide.where((F.col("length") >= WIDTH) & (F.col("block") < F.floor(F.col("length") / WIDTH)))
    ids = full.select("conv_id", F.col("block").alias("i"), _digest(*(F.col(f"t{j}") for j in range(WIDTH))).alias("id"))
    keys = _prior_keys(ids).select("conv_id", (F.col("i") + 1).alias("block"), F.col("key").alias("prior"))
    later = wide.where("block > 0").join(keys, ["conv_id", "block"])
    return materialize(wide.where("block = 0").withColumn("prior", START).unionByName(later))


_SLOT = f"({WIDTH - 1} - bit_count(grouping_id()))"
_ROLLUP = f"GROUP BY block, prior, t0, ROLLUP ({', '.join(f't{j}' for j in range(1, WIDTH))})"
# A prefix that a shorter conversation has no turn for is no node.
_HAVING = "HAVING " + " OR ".join([f"{_SLOT} = 0"] + [f"({_SLOT} = {j} AND t{j} IS NOT NULL)" for j in range(1, WIDTH)])


def _owners(blocks: DataFrame) -> DataFrame:
    """For each conversation that owns nodes: the depth of the first, the bytes before it,
    and whether its last node is a leaf."""
    prefixes = blocks.sparkSession.sql(f"""
        SELECT min(conv_id) AS conv_id, {WIDTH} * block + {_SLOT} AS depth, max(get(q, {_SLOT})) AS before,
               count(*) = count_if(length = {WIDTH} * block + {_SLOT}) AS leaf
        FROM {{blocks}} {_ROLLUP} {_HAVING}""", blocks=blocks)
    return prefixes.groupBy("conv_id").agg(F.min("depth").alias("first"), F.min("before").alias("apart"),
                                           F.max(F.col("leaf").cast("long")).alias("leaf"))


def _node_key(slot: Column) -> Column:
    """Key of the prefix that ends at ``slot`` of a block row."""
    turns = [F.coalesce(F.when(F.lit(j) <= slot, F.col(f"t{j}")), F.lit(bytearray())) for j in range(WIDTH)]
    return _digest(F.concat_ws(":", F.lit(""), F.col("block"), slot).cast("binary"), F.col("prior"), *turns)


def prefix_trie(convs: DataFrame) -> Trie:
    """The trie of the rebuilt conversations.  Nodes: conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, n_ends."""
    turns = _turns(convs)
    table, rebuilt = _rebuild(turns)
    blocks = _blocks(rebuilt)
    table = materialize(table.join(_owners(blocks), "conv_id", "left").select(
        "conv_id", "length", F.coalesce("first", F.col("length") + 1).alias("first"), F.coalesce("apart", "total").alias("apart"),
        F.coalesce("leaf", F.lit(0).cast("long")).alias("leaf")))
    stretches = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("length") / STRETCH))).alias("stretch")
    known = (blocks.drop("length").withColumn("stretch", F.floor(F.col("block") * WIDTH / STRETCH))
             .join(table.select("*", stretches), ["conv_id", "stretch"]))
    nodes = materialize(blocks.sparkSession.sql(f"""
        SELECT block, prior, {', '.join(f't{j}' for j in range(WIDTH))}, {_SLOT} AS slot, {WIDTH} * block + {_SLOT} AS depth,
               min(conv_id) AS conv_id, count(*) AS n_convs, sum(leaf) AS n_leaves, min(first) AS first,
               sum(greatest(apart - get(q, {_SLOT}), 0L)) AS saved_tokens, count_if(length = {WIDTH} * block + {_SLOT}) AS n_ends
        FROM {{known}} {_ROLLUP} {_HAVING}""", known=known)
        .withColumn("key", _node_key(F.col("slot"))).select("key", "conv_id", "depth", "n_convs", "n_leaves", "first", "saved_tokens", "n_ends"))
    # the deepest node on a conversation's path that it does not own: its last node, or the parent of its first
    asked = (known.where((F.col("first") > 0) & (F.col("block") == F.floor((F.col("first") - 1) / WIDTH)))
             .select("conv_id", "first", "length", _node_key(((F.col("first") - 1) % WIDTH).cast("int")).alias("key")))
    joined = materialize(asked.join(nodes.select("key", F.col("conv_id").alias("owner")), "key").select("conv_id", "first", "length", "owner"))
    parents = joined.where(F.col("first") <= F.col("length")).select("conv_id", F.col("first").alias("depth"), "owner")
    # below its first node, a conversation owns the parents of its nodes
    linked = materialize(nodes.drop("key").join(parents, ["conv_id", "depth"], "left").withColumn(
        "parent_conv_id", F.when(F.col("depth") == 0, F.lit(None)).when(F.col("depth") == F.col("first"), F.col("owner")).otherwise(F.col("conv_id"))))
    children = (linked.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"))
                .agg(F.count(F.lit(1)).alias("n_children")))
    out = linked.join(children, ["conv_id", "depth"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), "n_leaves",
        "saved_tokens", "n_ends")
    owned = table.where(F.col("first") <= F.col("length")).select("conv_id", F.col("length").alias("depth"), F.col("conv_id").alias("member"))
    others = joined.where(F.col("first") > F.col("length")).select(F.col("owner").alias("conv_id"), F.col("length").alias("depth"),
                                                                  F.col("conv_id").alias("member"))
    discard(turns, blocks)
    return Trie(out, owned.unionByName(others))


def with_end_digests(trie: Trie) -> DataFrame:
    """``nodes`` with ``ends_sha256``: digest of the decimal ids of the conversations that
    end there, ascending, joined by commas."""
    keys = ["conv_id", "depth"]
    ends = trie.ends.withColumn("text", F.col("member").cast("string"))
    digests = ordered_digest(ends, keys, ["member"], "text", ",")
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return trie.nodes.join(digests, keys, "left").withColumn("ends_sha256", F.coalesce("sha256", empty)).drop("sha256", "n_ends")
