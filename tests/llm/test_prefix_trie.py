"""The prefix trie of conversations against a trie built node by node."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from reelspan.llm import prefix_trie
from reelspan.llm.common import Scratch

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
CLASH = "pos string, a string, b string, depth string, label string, part string, n_convs string"


def brute(rows):
    """rows: (conv_id, turn, role, text); the nodes of the trie, built one prefix at a time."""
    own = {}
    for conv, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own.setdefault(conv, []).append((role or "", text or ""))
    members, ends = {}, {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 6
        base = conv - (conv % 100 if conv >= 0 else -(-conv % 100))
        whole = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(whole) + 1):
            members.setdefault(whole[:d], []).append(conv)
        ends.setdefault(whole, []).append(conv)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        leaves[node] = sum(leaves[c] for c in below) if below else 1
        saved[node] = (len(members[node]) - 1) * (len(node[-1][1]) if node else 0) + sum(saved[c] for c in below)
    out = []
    for node, convs in members.items():
        digest = hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest()
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children.get(node, [])), leaves[node], saved[node], digest))
    return sorted(out, key=lambda r: r[:2])


def nodes(df, **options):
    return sorted((tuple(r[c] for c in COLUMNS) for r in prefix_trie.trie(df, **options).collect()), key=lambda r: r[:2])


def table(spark, rows):
    return spark.createDataFrame([(*r, *"???????") for r in rows], f"conv_id long, turn long, role string, text string, {CLASH}")


def test_whole_table_equals_brute_force(spark, small):
    df = spark.read.parquet(f"{small}/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert nodes(df) == brute(rows)


@pytest.mark.parametrize("seed, fan_in, parts", [(1, 64, 1), (2, 2, 9), (3, 3, 30)])
def test_random_conversations(spark, seed, fan_in, parts):
    """Many copies, nested prefixes, missing first conversations, conversations shorter than what is left out."""
    rng, rows = random.Random(seed), []
    for conv in rng.sample(range(-150, 900), 300):
        if conv % 100 == 0 and rng.random() < 0.3:
            continue
        for turn in range(rng.choice([1, 1, 2, 3, 5, 6, 7, 12])):
            rows.append((conv, turn * 3, rng.choice(["user", None]) if turn % 2 else "user", rng.choice(["", None, "ä", "yes", "yes 😀"]) if turn else "same"))
    rng.shuffle(rows)
    assert nodes(table(spark, rows).repartition(parts), fan_in=fan_in) == brute(rows)


def test_odd_rows(spark):
    """Nulls, empty and long texts, turns without numbers, repeated rows, ties, an empty table."""
    rows = [(None, 1, "user", "lost"), (100, None, None, None), (100, None, None, None), (101, 2, "user", "x" * 300_000), (101, None, "", ""), (102, 0, "user", None), (107, 1, "user", "b"), (107, 1, "user", "b"), (300, 5, "user", "alone")]
    assert nodes(table(spark, rows)) == brute(rows)
    assert nodes(table(spark, [])) == []
    tied = [(400, 1, "user", t) for t in ("b", "a", "c")]
    assert nodes(table(spark, tied)) == nodes(table(spark, tied[::-1]))


def test_deep_copies(spark):
    """Conversations that each go one turn further than the one before: as many paths as turns."""
    nested = [(1000 + c, t, "user", f"step {t}") for c in range(0, 60) for t in range(c + 1)]
    assert nodes(table(spark, nested)) == brute(nested)


def test_one_conversation_of_many_stretches(spark):
    """A copy that stops after 150,000 of 200,000 turns: keys, members and sums run across stretches."""
    turns = spark.range(200_000).select(F.lit(900).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.concat(F.lit("turn "), F.col("id")).alias("text"))
    copy = turns.where("turn < 150000").withColumn("conv_id", F.lit(1000))
    found = prefix_trie.trie(turns.union(copy)).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
    lengths = [0] + [len(f"turn {t}") for t in range(150_000)]
    left = sum(lengths)
    by_depth = {r["depth"]: r for r in found.collect()}
    assert sorted(by_depth) == list(range(200_001))
    for d in range(200_001):
        if d <= 150_000:
            left -= lengths[d]
        saved = left + lengths[d] if d <= 150_000 else 0
        assert tuple(by_depth[d]) == (900, d, 900 if d else None, 2 if d <= 150_000 else 1, 1 if d < 200_000 else 0, 1, saved)


def test_end_lists_across_tasks_and_pieces(spark, monkeypatch):
    """Lists that one task, several tasks and several pieces hold are hashed alike."""
    monkeypatch.setattr(prefix_trie, "PIECE_BYTES", 64)
    ids = {(1, 1): list(range(0, 4000, 3)), (1, 2): [5], (2, -3): [7, 8], (-9, 4): list(range(10))}
    rows = [(a, b, c) for (a, b), convs in ids.items() for c in convs]
    random.Random(3).shuffle(rows)
    got = prefix_trie.end_digests(spark.createDataFrame(rows, "a long, b long, conv_id long").repartition(7)).collect()
    assert {(r["a"], r["b"]): r["ends_sha256"] for r in got} == {k: hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for k, v in ids.items()} and len(got) == 4


def test_partial_tries_merge_to_the_same_nodes(spark, small, monkeypatch):
    """However many partitions, partial tables and rounds there are."""
    turns = prefix_trie.ordered_turns(spark.read.parquet(f"{small}/conversations.parquet"))
    scratch = Scratch(spark, "trie-test")
    prefixes = scratch.keep(prefix_trie.rebuilt_prefixes(turns, scratch), "prefixes")
    one = prefixes.coalesce(1)
    want = sorted(map(tuple, prefixes.groupBy("a", "b").agg(F.count("*"), F.min("conv_id")).collect()))
    for parts, fan_in, held in ((one, 64, 1 << 17), (prefixes.repartition(20), 2, 50), (prefixes.repartition(20), 64, 50)):
        monkeypatch.setattr(prefix_trie, "HELD_PREFIXES", held)
        monkeypatch.setattr(prefix_trie, "PARTIAL_NODES", 2 * held)
        tables = scratch.keep(prefix_trie.partial_tries(parts), f"partial-{fan_in}-{held}")
        got = prefix_trie.merged_tries(tables, Scratch(spark, "trie-test"), fan_in)
        assert sorted((r["a"], r["b"], r["n_convs"], r["conv_id"]) for r in got.collect()) == want
