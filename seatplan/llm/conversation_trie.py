"""Conversation prefix trie: every distinct opening of a set of conversations, with subtree totals.

A conversation is an ordered list of turns (role, text).  Each distinct
sequence of first ``d`` turns is a node of depth ``d``; the root has no turn.
A node is known by 192 bits: the XOR of hashes of its turns and their places.
As the XOR of a prefix is a prefix scan, a conversation of any length is
hashed in blocks; nodes are then numbered, and known by (smallest member,
depth) outside.

Subtree totals come from parallel tree contraction.  A round *rakes* all
leaves (each adds what it has gathered to its parent) and *compresses* unary
chains: a node with one child, picked by a coin where its parent is not picked
too, is spliced out, and the edge of its child takes over what it had.  The
number of nodes falls by a constant share in each round, whatever the tree's
shape.  When the root alone is left, the rounds are undone in reverse: a
spliced node's total is its child's plus what was noted.  Every join of a round
is on keys that are unique on both sides; sums per parent are combined before
the shuffle.  Rounds are checkpointed.

Defined results: turns are ordered by number (null first), then role, then
text; null role or text is empty; repeated rows are turns of their own; rows
with a null ``conv_id`` belong to no conversation and are left out; a
conversation without turns is a member of the root; an empty table gives an
empty result, without a root; other columns are ignored; long texts and
conversations of any length are taken whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seatplan.plans.lineage import materialize
from seatplan.plans.numbering import row_numbers

#: Turns whose prefix hashes are scanned at once.
BLOCK = 1024
#: Members of one node whose ids are joined to one string at once.
ID_RANGE = 4096
#: Parts in which the children of one node look up their parent's name.
SALTS = 256
LANES = ["h1", "h2", "h3"]


def turn_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, points, h1, h2, h3) of every turn: its place from 0,
    the code points of its text, hashes of (role, text)."""
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")}
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                 text["role"], text["text"]).filter("conv_id IS NOT NULL")
    lanes = [F.xxhash64(F.lit(i), F.length("role"), "role", "text").alias(h) for i, h in enumerate(LANES)]
    keep = [F.length("text").cast("long").alias("points"), *lanes]
    placed = row_numbers(turns, ["turn", "role", "text"], "place", ["conv_id"], keep)
    return placed.withColumn("place", F.col("place") - 1)


def spliced_turns(turns: DataFrame, first: Column, group: int) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first ``first`` (a column of ``conv_id``) turns are
    those of the conversation that opens its group of ``group`` ids.

    Returns the conversation ids, and the turns with their new places.
    """
    ids = materialize(turns.select("conv_id").distinct().withColumn("_h", first.cast("long")))
    base = F.col("conv_id") - F.col("conv_id") % group
    most = ids.agg(F.max("_h")).first()[0] or 0
    # At most ``most`` rows of a group's first conversation, each for at most ``group`` conversations.
    openings = turns.filter((F.col("conv_id") % group == 0) & (F.col("place") < most)).withColumnRenamed("conv_id", "_base")
    shared = (ids.withColumn("_base", base).join(openings.hint("merge"), "_base").filter("place < _h")
              .select("conv_id", "place", "points", *LANES))
    taken = shared.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_taken"))
    # One row per conversation, checkpointed, so that the join can split a conversation of very many turns.
    moved = materialize(ids.join(taken.hint("merge"), "conv_id", "left")
                        .select("conv_id", "_h", (F.coalesce("_taken", F.lit(0)) - F.col("_h")).alias("_move")))
    own = (turns.join(moved.hint("merge"), "conv_id").filter("place >= _h")
           .select("conv_id", (F.col("place") + F.col("_move")).alias("place"), "points", *LANES))
    return ids.select("conv_id"), shared.unionByName(own)


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, points, h1..h3, p1..p3) per turn: the hash of the
    prefix that ends with it and that of the prefix before it."""
    block = F.floor(F.col("place") / BLOCK)
    one = [F.xxhash64("place", h).alias(h) for h in LANES]
    rows = turns.select("conv_id", "place", "points", block.alias("_block"), *one)
    upto = Window.partitionBy("conv_id", "_block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    # Blocks before the first of a conversation: one row per block, none for most conversations.
    sums = (rows.groupBy("conv_id", "_block").agg(*[F.bit_xor(h).alias(h) for h in LANES])
            .withColumn("_many", F.max("_block").over(Window.partitionBy("conv_id"))).filter("_many > 0"))
    before = Window.partitionBy("conv_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("conv_id", "_block", *[F.coalesce(F.bit_xor(h).over(before), F.lit(0)).alias(f"_{h}")
                                                 for h in LANES])
    scanned = rows.select("conv_id", "place", "points", "_block", *[h for h in LANES],
                          *[F.bit_xor(h).over(upto).alias(f"s_{h}") for h in LANES])
    joined = scanned.join(carried.hint("merge"), ["conv_id", "_block"], "left")
    whole = {h: F.col(f"s_{h}").bitwiseXOR(F.coalesce(f"_{h}", F.lit(0))) for h in LANES}
    return joined.select("conv_id", (F.col("place") + 1).alias("depth"), "points",
                         *[whole[h].alias(h) for h in LANES],
                         *[whole[h].bitwiseXOR(F.col(h)).alias(f"p{i + 1}") for i, h in enumerate(LANES)])


def _joined_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h1, h2, h3, depth, range, part) sorted so to one SHA-256 of a node's parts, joined by commas."""
    key, digest = None, None

    def result() -> pa.RecordBatch:
        return pa.record_batch({**{n: pa.array([v], pa.int64()) for n, v in zip((*LANES, "depth"), key)},
                                "ends_sha256": pa.array([digest.hexdigest()])})

    for batch in batches:
        for *node, _, part in zip(*(c.to_pylist() for c in batch.columns)):
            if node != key:
                if key is not None:
                    yield result()
                key, digest = node, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(part.encode())
    if key is not None:
        yield result()


def _ends(ends: DataFrame) -> DataFrame:
    """Per node the SHA-256 of the ids of conversations that end there.

    Ids are joined by range first; only nodes with ids in several ranges go on
    to a task that streams their strings through one digest.
    """
    node = [*LANES, "depth"]
    parts = materialize(
        ends.withColumn("_range", F.floor(F.col("conv_id") / ID_RANGE)).groupBy(*node, "_range")
        .agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("part")))
    number = parts.groupBy(*node).agg(F.count(F.lit(1)).alias("_n"))
    several = number.filter("_n > 1").drop("_n")
    alone = (parts.join(several, node, "left_anti")
             .select(*node, F.sha2("part", 256).alias("ends_sha256")))
    streamed = (parts.join(several, node).select(*node, "_range", "part")
                .repartition(*node).sortWithinPartitions(*node, "_range")
                .mapInArrow(_joined_hashes, ", ".join(f"{c} long" for c in node) + ", ends_sha256 string"))
    return alone.unionByName(streamed)


def trie_nodes(ids: DataFrame, turns: DataFrame) -> DataFrame:
    """(id, parent, conv_id, depth, parent_conv_id, n_convs, points, ends_sha256) of every node.

    ``ids`` are all conversations, ``turns`` their rows (conv_id, place, points, hashes).
    """
    rows = materialize(prefixes(turns))
    lengths = rows.groupBy("conv_id").agg(F.max("depth").alias("depth"))
    last = rows.join(lengths.hint("merge"), ["conv_id", "depth"]).select("conv_id", *LANES, "depth")
    zero = [F.lit(0).cast("long").alias(h) for h in LANES]
    turnless = ids.join(lengths.hint("merge"), "conv_id", "left_anti").select(
        "conv_id", *zero, F.lit(0).cast("long").alias("depth"))
    ends = _ends(last.unionByName(turnless))
    parents = [f"p{i + 1}" for i in range(len(LANES))]
    nodes = rows.groupBy(*LANES, "depth").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.first("points").alias("points"),
        *[F.first(p).alias(p) for p in parents])
    root = (ids.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
            .select(*zero, F.lit(0).cast("long").alias("depth"), "conv_id", "n_convs", F.lit(0).cast("long").alias("points"),
                    *[F.lit(None).cast("long").alias(p) for p in parents]))
    salted = nodes.unionByName(root).withColumn("salt", F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)))
    nodes = materialize(row_numbers(salted, ["depth", "conv_id"], "id"))
    # A node may have very many children, so they look up their parent in up to SALTS parts:
    # the parts that occur go to the parent first, then the answers go to the parts.
    asked = nodes.filter("depth > 0").groupBy(*parents, "depth", "salt").agg(F.count(F.lit(1)).alias("_n"))
    names = nodes.select(*[F.col(h).alias(p) for h, p in zip(LANES, parents)], (F.col("depth") + 1).alias("depth"),
                         F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    answers = asked.join(names.hint("merge"), [*parents, "depth"]).select(
        *parents, "depth", "salt", "parent", "parent_conv_id")
    return (nodes.join(answers.hint("merge"), [*parents, "depth", "salt"], "left")
            .join(ends.hint("merge"), [*LANES, "depth"], "left")
            .select("id", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "points",
                    F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")))


def subtree_totals(tree: DataFrame, values: list[str]) -> DataFrame:
    """(id, n_children, n_leaves, and of each value the sum over the node's subtree) by rake and compress.

    ``tree`` has long columns ``id``, ``parent`` (null at the root) and
    ``values``; it must not change between reads.  Joins are merge joins on
    unique keys: no side is small at scale, so none is broadcast.
    """
    sums = ["n_leaves", *values]
    acc = [f"a_{v}" for v in sums]      # gathered at the node so far
    edge = [f"e_{v}" for v in sums]     # added to the node's total on the way to its parent
    note = [f"t_{v}" for v in sums]     # of the spliced node: its total less its child's
    children = tree.groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("n_children"))
    zero = F.lit(0).cast("long")
    first = materialize(tree.join(children.hint("merge"), "id", "left").select(
        "id", "parent", F.col("n_children").isNull().cast("long").alias(acc[0]),
        *[F.col(v).alias(a) for v, a in zip(values, acc[1:])], *[zero.alias(e) for e in edge],
        F.coalesce("n_children", zero).alias("n_children")))
    live = first
    rounds: list[tuple[DataFrame, DataFrame]] = []
    while not live.isEmpty():
        leaf = F.col("n_children") == 0
        # One grouping: what leaves give to their parent, and which other children it has left.
        given = live.groupBy(F.col("parent").alias("id")).agg(
            *[F.sum(F.when(leaf, F.col(a) + F.col(e))).alias(f"g{a}") for a, e in zip(acc, edge)],
            F.count(F.when(~leaf, 1)).alias("_left"), F.min(F.when(~leaf, F.col("id"))).alias("_child"))
        coin = F.pmod(F.xxhash64("id", F.lit(len(rounds))), F.lit(2)) == 1
        inner = materialize(live.filter(~leaf).join(given.hint("merge"), "id").select(
            "id", "parent", *[(F.col(a) + F.coalesce(f"g{a}", zero)).alias(a) for a in acc], *edge,
            F.col("_left").alias("n_children"), "_child",
            ((F.col("_left") == 1) & F.col("parent").isNotNull() & coin).alias("_heads")))
        heads = inner.filter("_heads")
        # A node whose parent is picked too waits: the parent knows its only child.
        picked = heads.join(heads.select(F.col("_child").alias("id")).hint("merge"), "id", "left_anti")
        # Word to the picked node itself (it goes) and to its child (it takes over).
        word = picked.select(
            F.explode(F.array(F.col("id"), F.col("_child"))).alias("id"), F.col("id").alias("_gone"),
            F.col("parent").alias("_above"), *[F.col(c).alias(f"u{c}") for c in (*acc, *edge)])
        over = F.col("_gone").isNotNull()
        after = materialize(inner.join(word.hint("merge"), "id", "left").filter(~over | (F.col("_gone") != F.col("id"))).select(
            "id", F.when(over, F.col("_above")).otherwise(F.col("parent")).alias("parent"), *acc,
            *[F.when(over, F.col(e) + F.col(f"u{a}") + F.col(f"u{e}")).otherwise(F.col(e)).alias(e)
              for a, e in zip(acc, edge)], "n_children", "_gone",
            *[(F.col(e) + F.col(f"u{a}")).alias(t) for a, e, t in zip(acc, edge, note)]))
        rounds.append((live.filter(leaf).select("id", *acc), after.filter(over).select("_gone", "id", *note)))
        live = after.drop("_gone", *note)
    totals = first.select("id", *acc)  # of an empty tree
    for i, (raked, noted) in enumerate(reversed(rounds)):
        if i == 0:  # the root alone
            totals = raked
            continue
        undone = noted.join(totals.hint("merge"), "id").select(
            F.col("_gone").alias("id"), *[(F.col(a) + F.col(t)).alias(a) for a, t in zip(acc, note)])
        totals = materialize(totals.unionByName(undone).unionByName(raked))
    return (totals.join(first.select("id", "n_children").hint("merge"), "id")
            .select("id", "n_children", *[F.col(a).alias(v) for a, v in zip(acc, sums)]))


def prefix_trie(conversations: DataFrame, first: Column | None = None, group: int = 100) -> DataFrame:
    """Nodes of the trie: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``first`` is how many turns a conversation takes from the one that opens
    its group of ``group`` ids (by default none are taken).  ``saved_tokens``
    sums, over a node's subtree, (n_convs - 1) times the code points of a
    node's last text.
    """
    turns = materialize(turn_rows(conversations))
    if first is None:
        ids = materialize(turns.select("conv_id").distinct())
    else:
        ids, turns = spliced_turns(turns, first, group)
    nodes = materialize(trie_nodes(ids, turns))
    tree = nodes.select("id", "parent", ((F.col("n_convs") - 1) * F.col("points")).alias("saved_tokens"))
    totals = subtree_totals(tree, ["saved_tokens"])
    return (nodes.join(totals.hint("merge"), "id")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                    "ends_sha256"))


def opening_turns() -> Column:
    """How many turns a conversation of the registered query takes over: 0 to 5, by its id's CRC."""
    return F.crc32(F.col("conv_id").cast("string")) % 6
