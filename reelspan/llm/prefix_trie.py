"""The prefix trie of conversations, from partial tries that tasks build and merge.

Conversations are rebuilt first: those of a block of a hundred ids share the beginning of the block's first one.
A node is a distinct sequence of first turns. Its key is made of two 64-bit values that xor a hash of each
turn with its place, so keys run along a conversation by a prefix scan, in as many tasks as it has stretches.
Each partition combines its prefixes into a partial trie; tables of partial tries are merged by key in rounds of
bounded fan-in. Lists of the conversations that end at a node stay sorted runs, hashed as they stream.

Sums over subtrees: each node is labelled with the least pseudo-random priority among its members. Equal
labels form vertical paths, and from any node up to the root the label changes about log(members) times at most. Sums go up
from path to path in that many rounds, whatever the depth of the trie, and along a path by a prefix scan.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelspan.llm.common import Scratch, map_arrow
from reelspan.operators.scan import Fold, dense, running

#: Conversations of a block, most turns that they share, and partial tries that one round merges into one.
BLOCK, SHARED, FAN_IN = 100, 6, 64
#: Prefixes that a task holds before it combines them, nodes of a partial trie, bytes of a piece of an end list.
HELD_PREFIXES, PARTIAL_NODES, PIECE_BYTES = 1 << 17, 1 << 20, 1 << 20
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()
PARTIAL = "a long, b long, depth long, up_a long, up_b long, n long, n_convs long, conv_id long, label long, part long"
DIGEST = "a long, b long, sha256 string, part long, seq long, text binary"


def mixed(a: Column | str, b: Column | str, place: Column | str) -> tuple[Column, Column]:
    """Both halves of a turn's share in the keys of the nodes at and below it."""
    return F.xxhash64(a, F.lit(11), place), F.xxhash64(b, F.lit(23), place)


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, a, b, n): turns in order, with hashes of role and text and the code points of the text.
    Rows without a conversation's id go; turns without a number come first; equal turn numbers are ordered by
    their hashes."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    hashed = turns.select("conv_id", "turn", F.xxhash64(F.lit(1), "role", "text").alias("a"), F.xxhash64(F.lit(2), "role", "text").alias("b"), F.length("text").cast("long").alias("n"))
    return running(hashed, ["conv_id"], ["turn", "a", "b"], dense("turn"), {"pos": Fold("count", F.lit(1), own=False)}).drop("turn")


def rebuilt_prefixes(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b, depth, up_a, up_b, n, conv_id, ends): every prefix of every rebuilt conversation, from the empty
    one; ``turns`` as ``ordered_turns`` gives them."""
    ma, mb = mixed("a", "b", "pos")
    first = turns.where(f"conv_id % {BLOCK} = 0 and pos < {SHARED - 1}").select(F.col("conv_id").alias("base"), "pos", ma.alias("ma"), mb.alias("mb"), "n")
    order = W.partitionBy("base").orderBy("pos")  # at most five rows
    keyed = first.select("base", "pos", F.bit_xor("ma").over(order).alias("a"), F.bit_xor("mb").over(order).alias("b"), "n")
    head = keyed.groupBy("base").agg(F.array_sort(F.collect_list(F.struct("pos", "a", "b", "n"))).alias("head"))
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("own")).withColumn("base", F.col("conv_id") - F.col("conv_id") % BLOCK).withColumn("h", (F.crc32(F.col("conv_id").cast("string")) % SHARED).cast("int"))
    none = F.array().cast("array<struct<pos:long,a:long,b:long,n:long>>")
    block = convs.join(head, "base", "left").withColumn("head", F.coalesce(F.slice("head", F.lit(1), F.col("h")), none)).withColumn("take", F.size("head"))
    total = F.col("take") + F.greatest(F.col("own") - F.col("h"), F.lit(0))
    block = scratch.keep(block.select("conv_id", "h", "take", "head", total.cast("long").alias("total")), "blocks")

    at = lambda i, f, zero: F.when(i == 0, zero).otherwise(F.get("head", i - 1)[f])
    d = F.col("d")
    shared = block.select("conv_id", "head", "total", F.explode(F.sequence(F.lit(0), "take")).alias("d")).select(
        at(d, "a", F.lit(0)).alias("a"), at(d, "b", F.lit(0)).alias("b"), d.cast("long").alias("depth"),
        F.when(d > 0, at(d - 1, "a", F.lit(0))).alias("up_a"), F.when(d > 0, at(d - 1, "b", F.lit(0))).alias("up_b"), at(d, "n", F.lit(0)).alias("n"), "conv_id", (d == F.col("total")).alias("ends"),
    )

    last = lambda f: F.when(F.col("take") > 0, F.get("head", F.col("take") - 1)[f]).otherwise(F.lit(0)).alias(f"base_{f}")
    own = turns.join(block.select("conv_id", "h", "take", "total", last("a"), last("b")), "conv_id").where("pos >= h")  # Spark may split a long conversation
    own = own.withColumn("depth", F.col("pos") - F.col("h") + F.col("take") + 1)
    ma, mb = mixed("a", "b", F.col("depth") - 1)
    own = own.select("conv_id", "depth", "n", "base_a", "base_b", (F.col("depth") == F.col("total")).alias("ends"), ma.alias("ma"), mb.alias("mb"))
    own = running(own, ["conv_id"], ["depth"], dense("depth"), {"run_a": Fold("bit_xor", F.col("ma")), "run_b": Fold("bit_xor", F.col("mb"))})
    a, b = F.col("base_a").bitwiseXOR(F.col("run_a")), F.col("base_b").bitwiseXOR(F.col("run_b"))
    own = own.select(a.alias("a"), b.alias("b"), "depth", a.bitwiseXOR(F.col("ma")).alias("up_a"), b.bitwiseXOR(F.col("mb")).alias("up_b"), "n", "conv_id", "ends")
    return shared.unionByName(own)


def combined(rows: np.ndarray) -> np.ndarray:
    """Node rows with equal keys as one: members add up, the smallest member and the least label stay."""
    rows = rows[np.lexsort((rows["b"], rows["a"]))]
    first = np.flatnonzero(np.r_[True, (rows["a"][1:] != rows["a"][:-1]) | (rows["b"][1:] != rows["b"][:-1])])
    out = rows[first]
    out["n_convs"] = np.add.reduceat(rows["n_convs"], first)
    out["conv_id"] = np.minimum.reduceat(rows["conv_id"], first)
    out["label"] = np.minimum.reduceat(rows["label"], first)
    return out


_NODE = np.dtype([(c.split()[0], np.int64) for c in PARTIAL.split(", ")[:-1]])


def partial_tries(prefixes: DataFrame) -> DataFrame:
    """The node tables of the partitions, each combined as far as a bounded table reaches. The root's parent is
    written as the root itself."""

    def run(batches):
        part, held, waiting, size = TaskContext.get().partitionId(), np.empty(0, _NODE), [], 0

        def emit(rows):
            for i in range(0, len(rows), 1 << 16):
                piece = rows[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(piece[f]) for f in _NODE.names] + [pa.array(np.full(len(piece), part, np.int64))], names=[*_NODE.names, "part"])

        for batch in batches:
            rows = np.empty(batch.num_rows, _NODE)
            for f in ("a", "b", "depth", "up_a", "up_b", "n", "conv_id", "label"):
                rows[f] = batch.column(f).to_numpy()
            rows["n_convs"] = 1
            waiting.append(rows)
            size += len(rows)
            if size >= HELD_PREFIXES:
                held, waiting, size = combined(np.concatenate([held, *waiting])), [], 0
                if len(held) > PARTIAL_NODES:
                    yield from emit(held)
                    held = np.empty(0, _NODE)
        if size or len(held):
            yield from emit(combined(np.concatenate([held, *waiting])))

    rooted = prefixes.withColumn("up_a", F.coalesce("up_a", F.lit(0))).withColumn("up_b", F.coalesce("up_b", F.lit(0))).withColumn("label", F.xxhash64("conv_id"))
    return map_arrow(rooted.select("a", "b", "depth", "up_a", "up_b", "n", "conv_id", "label"), run, PARTIAL)


def merged_tries(partial: DataFrame, scratch: Scratch, fan_in: int = FAN_IN) -> DataFrame:
    """Merges partial tries by key in rounds, ``fan_in`` partitions into one each, until one table is left."""
    last = partial.agg(F.max("part")).first()[0]
    parts, turn = (last or 0) + 1, 0
    sums = [*[F.max(c).alias(c) for c in ("depth", "up_a", "up_b", "n")], F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("label").alias("label")]
    while True:
        parts, turn = -(-parts // fan_in), turn + 1
        group = [F.floor(F.col("part") / fan_in).cast("long").alias("part")] if parts > 1 else []
        partial = scratch.keep(partial.groupBy("a", "b", *group).agg(*sums), f"nodes-{turn}")
        if turn > 1:
            scratch.drop(f"nodes-{turn - 1}")
        if parts == 1:
            return partial


def end_digests(ends: DataFrame) -> DataFrame:
    """(a, b, ends_sha256) for (a, b, conv_id): the hash of each node's ids, in order, joined by commas. Ids are
    sorted across tasks; a node whose ids lie in one task is hashed there, the others are put together from pieces of
    bounded size, one after the other, as the hash demands."""

    def run(batches):
        part, seq, out = TaskContext.get().partitionId(), 0, []
        key, text, held, whole, first = None, [], 0, True, True

        def piece():
            nonlocal seq
            seq += 1
            return (*key, None, part, seq, ",".join(text).encode())

        def closed(at_edge):
            return piece() if at_edge or first or not whole else (*key, hashlib.sha256(",".join(text).encode()).hexdigest(), None, None, None)

        for batch in batches:
            for a, b, conv in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if key != (a, b):
                    if key is not None:
                        out.append(closed(False))
                        first = False
                    key, text, whole, held = (a, b), [], True, 0
                text.append(str(conv))
                held += len(text[-1]) + 1
                if held >= PIECE_BYTES:
                    out.append(piece())
                    text, whole, held = [], False, 0
            yield rows(out)
            out = []
        if key is not None and (text or whole):
            yield rows([closed(True)])

    def rows(found):
        columns = zip(*found, strict=True) if found else [[]] * 6
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=[c.split()[0] for c in DIGEST.split(", ")])

    def join(batches):
        key, state, out = None, None, []
        for batch in batches:
            for a, b, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if key == (a, b):
                    if text:
                        state.update(b"," + text)
                else:
                    if key is not None:
                        out.append((*key, state.hexdigest(), None, None, None))
                    key, state = (a, b), hashlib.sha256(text)
            yield rows(out)
            out = []
        if key is not None:
            yield rows([(*key, state.hexdigest(), None, None, None)])

    order = ["a", "b", "conv_id"]
    found = map_arrow(ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order), run, DIGEST)
    scratch = Scratch(ends.sparkSession, "end-lists")
    found = scratch.keep(found, "digests")
    pieces = found.where("sha256 is null").repartition("a", "b").sortWithinPartitions("a", "b", "part", "seq").select("a", "b", "text")
    return found.where("sha256 is not null").select("a", "b", F.col("sha256").alias("ends_sha256")).unionByName(map_arrow(pieces, join, DIGEST).select("a", "b", F.col("sha256").alias("ends_sha256")))


def subtree_sums(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(label, depth, n_leaves, saved) of each node of ``nodes`` (label, depth, up_label, leaf, worth): the sums of
    ``leaf`` and ``worth`` over its subtree. Paths of equal labels hand their sums on from one to the next above."""
    tops = scratch.keep(nodes.where("up_label is null or up_label <> label").select("label", "up_label", (F.col("depth") - 1).alias("at")), "tops")
    sums = [F.sum("leaf").alias("leaf"), F.sum("worth").alias("worth")]
    moving, gifts, turn = nodes.groupBy("label").agg(*sums), [], 0
    while True:
        turn += 1
        given = moving.join(tops.where("up_label is not null"), "label").groupBy("up_label", "at").agg(*sums)
        given = scratch.keep(given.withColumnsRenamed({"up_label": "label", "at": "depth"}), f"gifts-{turn}")
        if given.isEmpty():
            break
        gifts.append(given)
        moving = given.groupBy("label").agg(*sums)
    summed = nodes.select("label", "depth", "leaf", "worth")
    for given in gifts:
        summed = summed.unionByName(given)
    merged = summed.groupBy("label", "depth").agg(*sums)
    return running(merged, ["label"], ["depth"], dense("depth"), {"n_leaves": Fold("sum", F.col("leaf"), backward=True), "saved": Fold("sum", F.col("worth"), backward=True)}).select("label", "depth", "n_leaves", "saved")


def trie(conversations: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations: conv_id (smallest member), depth,
    parent_conv_id (null at the root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Conversation c begins with the first h turns of conversation c - c % 100, h being crc32 of c's digits modulo 6, and goes
    on with its own turns after its first h. Null roles and texts are empty; rows without conv_id go; turns without a
    number come first and equal numbers have a fixed order of their own; repeated rows are turns of their own; other
    columns are not read; no conversation gives no rows, not even a root. A conversation without turns is a member of the root
    and ends there.
    """
    scratch = Scratch(conversations.sparkSession, "trie")
    turns = scratch.keep(ordered_turns(conversations), "turns")
    prefixes = scratch.keep(rebuilt_prefixes(turns, scratch), "prefixes")
    partial = scratch.keep(partial_tries(prefixes), "partial")
    nodes = merged_tries(partial, scratch, fan_in)
    scratch.drop("partial", "turns", "blocks")
    parents = nodes.select(F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("parent_conv_id"), F.col("label").alias("up_label"))
    below = nodes.where("depth > 0")
    counts = below.groupBy(F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(F.count("*").alias("n_children"))
    linked = below.join(parents, ["up_a", "up_b"]).unionByName(nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")).withColumn("up_label", F.lit(None).cast("long")))
    linked = scratch.keep(linked.join(counts, ["a", "b"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))).drop("up_a", "up_b"), "linked")
    worth = ((F.col("n_convs") - 1) * F.col("n")).alias("worth")
    sums = subtree_sums(linked.select("label", "depth", "up_label", (F.col("n_children") == 0).cast("long").alias("leaf"), worth), scratch)
    digests = end_digests(prefixes.where("ends"))
    out = linked.join(sums, ["label", "depth"]).join(digests, ["a", "b"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"))
