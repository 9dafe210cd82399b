"""N-gram Jaccard join with adaptive multi-match prefixes.

The tokens of a document are its distinct word n-grams, in one global order in which frequent ones
come last. If two sets are similar enough, their first k common tokens lie in the first
``size - ceil(threshold * size) + k`` tokens of either. Each document chooses its own k by the cost
that its prefix tokens promise: the likelier they are to meet others by chance, the longer the
prefix grows and the more of it must be shared before a pair is verified; sizes that leave little
room outside the prefixes ask for more still.

Documents with equal sets are one class before any join. Tokens that few classes share give pairs,
which are counted and verified. Tokens that many share never do: their classes are compared with
one leader, and only classes that stay unlinked are compared with the rest, in blocks of bounded
size. Nothing is capped: every pair that could link is verified or joined through others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspan.llm.common import Scratch, frequent, keyed_text, map_arrow, raw_texts, slices
from reelspan.llm.components import components
from reelspan.llm.shingling import shingle_sets
from reelspan.llm.sieve import sieve_of

#: Percent of the union that the intersection must reach; words of an n-gram.
PERCENT, WORDS = 85, 4
#: Tokens whose frequency is known everywhere (a bounded broadcast); others count as rare.
KNOWN_TOKENS = 200_000
#: Shared tokens that a prefix may ask for. For the cost of a prefix: how often a token of unknown
#: frequency meets another document by chance, and how much rarer each further meeting is.
MOST_MATCHES, CHANCE, FURTHER = 8, 0.05, 0.3
#: Classes that share a token up to which they give pairs; more are compared in blocks.
PAIR_LIMIT = 16
#: Tokens of either side of a block, and what a set counts at least there, so that a block of short
#: sets is bounded in documents too; sets and tokens of a tile of it.
BLOCK_TOKENS, LEAST_LOAD, TILE, STRETCH = 1 << 17, 64, 512, 4096
#: Postings of one token that meet their leader in one task; the part of a block that the members have
#: which are compared with their leader alone.
SHARE_ROWS, STAR_SHARE = 1024, 8
_CHUNK = 1 << 20


def token_counts(docs: DataFrame, words: int) -> DataFrame:
    """(token, n) of tokens that are frequent somewhere; counts of stretches of the input, so a
    hint on order and cost, on which no result depends."""

    def run(batches):
        held, size = [], 0

        def flush():
            tokens, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= 3
            return pa.RecordBatch.from_arrays([pa.array(tokens[often]), pa.array(n[often])], names=["token", "n"])

        for batch in batches:
            for piece in slices(batch):
                sets = shingle_sets(raw_texts(piece.column(1)), words)
                held += sets
                size += sum(map(len, sets))
                if size > _CHUNK:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return map_arrow(docs, run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


class Order:
    """The global order of tokens: unknown ones by hash, then known ones by count."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        order = np.argsort(tokens)
        self.tokens, self.counts = tokens[order], counts[order]

    def with_counts(self, tokens: np.ndarray, counts: np.ndarray) -> Order:
        """The order that knows more tokens; a token has the larger of its counts."""
        every = np.concatenate([self.tokens, tokens])
        found, first = np.unique(every, return_inverse=True)
        most = np.zeros(len(found), dtype=np.int64)
        np.maximum.at(most, first, np.concatenate([self.counts, counts]).astype(np.int64))
        return Order(found, most)

    def prefix(self, tokens: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, int, int]:
        """The prefix of a set, how many of its tokens must be shared, and how many are known."""
        size = len(tokens)
        count = np.zeros(size)
        if len(self.tokens):
            at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
            known = self.tokens[at] == tokens
            count[known] = self.counts[at[known]]
        order = np.lexsort((tokens, count))
        must = -(-percent * size // 100)
        cost = np.cumsum(count[order])
        best, matches = math.inf, 1
        for k in range(1, min(MOST_MATCHES, must) + 1):  # reading a posting costs 1, verifying a pair the set
            length = size - must + k
            read = length + cost[length - 1]
            total = read + size * (cost[length - 1] / k + CHANCE * length * FURTHER ** (k - 1))
            if total < best - 1e-9:
                best, matches = total, k
        chosen = order[: size - must + matches]
        return tokens[chosen], matches, int((count[chosen] > 0).sum())


def signatures(docs: DataFrame, shared, words: int, percent: int) -> DataFrame:
    """uid (of the row, once the table is written), doc_id, n_shingles, set_key (128 bits of the whole
    set, null for an empty one) and the prefix of each document; ``shared`` is the broadcast order."""

    def run(batches):
        order, uid = shared.value, TaskContext.get().partitionId() << 33
        for batch in batches:
            for piece in slices(batch):
                sizes, keys, prefixes, matches, known = [], [], [], [], []
                for tokens in shingle_sets(raw_texts(piece.column(1)), words):
                    sizes.append(len(tokens))
                    keys.append(xxhash.xxh3_128_digest(tokens.tobytes()) if len(tokens) else None)
                    p, m, k = order.prefix(tokens, percent) if len(tokens) else (tokens, 0, 0)
                    prefixes.append(p)
                    matches.append(m)
                    known.append(k)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(uid, uid + len(sizes))), piece.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(matches, pa.int32()), pa.array(known, pa.int32())], names=["uid", "doc_id", "n_shingles", "set_key", "prefix", "matches", "known"])
                uid += len(sizes)

    return map_arrow(docs, run, "uid long, doc_id long, n_shingles long, set_key binary, prefix array<long>, matches int, known int")


def prefixes(docs: DataFrame, order: Order, words: int, percent: int, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """doc_id, n_shingles and set_key of all documents; set_key, doc (the smallest id) and size of each
    distinct set; these with their prefixes; and the prefix tokens that several of them share with their number.

    Only ids and sizes are aggregated, so copies of a text are one row of a task before they move;
    prefixes stay where they are, but for those of rows that may be copies."""
    shared = docs.sparkSession.sparkContext.broadcast(order)
    signed = scratch.keep(signatures(docs, shared, words, percent), f"{name}/signatures")
    shared.destroy()
    names = signed.where("set_key is not null and doc_id is not null").groupBy("set_key")
    names = scratch.keep(names.agg(F.min("doc_id").alias("doc"), F.min_by("uid", "doc_id").alias("uid"), F.max("n_shingles").alias("size"), F.count("*").alias("copies")), f"{name}/names")
    # copies to drop; only rows that a sieve of them lets through have to be looked up
    first = names.where("copies > 1").select("set_key", F.col("uid").alias("first"))
    copies = scratch.keep(signed.where("doc_id is not null").select("uid", "set_key").join(first.hint("merge"), "set_key").where("uid <> first").select("uid"), f"{name}/copies")
    sieve = docs.sparkSession.sparkContext.broadcast(sieve_of(copies))

    def sifted(batches):
        for batch in batches:
            yield batch.append_column("copy", pa.array(sieve.value.passes(batch.column(0).to_numpy())))

    columns = ("doc", "size", "matches", "known", "prefix")
    picked = signed.where("set_key is not null and doc_id is not null").select("uid", F.col("doc_id").alias("doc"), F.col("n_shingles").alias("size"), "matches", "known", "prefix")
    picked = map_arrow(picked, sifted, "uid long, doc long, size long, matches int, known int, prefix array<long>, copy boolean")
    classes = picked.where("not copy").select(*columns).unionByName(picked.where("copy").join(copies.hint("merge"), "uid", "left_anti").select(*columns))
    classes, keys = scratch.keep(classes, f"{name}/classes"), scratch.keep(signed.select("doc_id", "n_shingles", "set_key"), f"{name}/keys")
    sieve.destroy()
    scratch.drop(f"{name}/signatures", f"{name}/copies")
    many = classes.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    return keys, names, classes, scratch.keep(many, f"{name}/many")


def sets_of(docs: DataFrame, shared, words: int) -> DataFrame:
    """(doc, tokens) of the documents whose ids pass the broadcast sieve ``shared``: all wanted ones and
    few others, so that few sets move that no join wants."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for piece in slices(batch.filter(pa.array(shared.value.passes(ids)))) if len(ids) else ():
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(shingle_sets(raw_texts(piece.column(1)), words), pa.list_(pa.int64()))], names=["doc", "tokens"])

    return map_arrow(docs.where("doc_id is not null"), run, "doc long, tokens array<long>")


def postings_of(classes: DataFrame, shared) -> DataFrame:
    """(token, doc, size, matches, known) of the prefix tokens that pass the broadcast sieve ``shared``."""

    def run(batches):
        for batch in batches:
            prefixes = batch.column("prefix")
            tokens = prefixes.flatten()
            kept = np.flatnonzero(shared.value.passes(tokens.to_numpy()))
            lengths = np.diff(prefixes.offsets.to_numpy())
            row = pa.array(np.repeat(np.arange(batch.num_rows), lengths)[kept])
            yield pa.RecordBatch.from_arrays([tokens.take(pa.array(kept)), *(batch.column(c).take(row) for c in ("doc", "size", "matches", "known"))], names=["token", "doc", "size", "matches", "known"])

    return map_arrow(classes.select("prefix", "doc", "size", "matches", "known"), run, "token long, doc long, size long, matches int, known int")


def grid_of(sets: list[np.ndarray], tokens: np.ndarray) -> np.ndarray:
    """Which of ``tokens`` each set holds, as 0 and 1."""
    grid = np.zeros((len(sets), len(tokens)), dtype=np.float32)
    for i, s in enumerate(sets):
        at = np.searchsorted(tokens, s)
        at[at == len(tokens)] = 0
        grid[i, at[tokens[at] == s]] = 1
    return grid


def linked(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> Iterator[tuple[int, int]]:
    """The pairs (place in left, place in right) of two lists of sorted distinct arrays that are similar
    enough. Tile by tile: TILE sets of either side and STRETCH tokens at a time."""
    for top in range(0, len(left), TILE):
        a = left[top : top + TILE]
        mine, sizes = np.unique(np.concatenate(a)), np.array([len(x) for x in a])
        for side in range(0, len(right), TILE):
            b = right[side : side + TILE]
            shared = np.intersect1d(mine, np.unique(np.concatenate(b)), assume_unique=True)
            n = np.zeros((len(a), len(b)), dtype=np.int64)
            for low in range(0, len(shared), STRETCH):
                part = shared[low : low + STRETCH]
                n += (grid_of(a, part) @ grid_of(b, part).T).astype(np.int64)
            union = sizes[:, None] + np.array([len(x) for x in b])[None, :] - n
            for i, j in zip(*(x.tolist() for x in np.nonzero(100 * n >= percent * union)), strict=True):
                yield top + i, side + j


def block_links(blocks: DataFrame, percent: int) -> DataFrame:
    """Links within blocks: rows (g1, g2, g3, side, doc, tokens); every document of side 0 is
    compared with every one of side 1, those of side 2 with each other. What comes out connects the
    same documents as all links of the block do: each with the first one of its group."""

    def compare(data: pa.Table) -> pa.Table:
        side = data.column("side").to_numpy()
        docs = data.column("doc").to_numpy()
        lists = data.column("tokens").combine_chunks()
        values, ends = lists.flatten().to_numpy(), np.cumsum(pc.list_value_length(lists).to_numpy())
        sets = np.split(values, ends[:-1])
        a, b = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        above = np.arange(len(docs))

        def root(i: int) -> int:
            while above[i] != i:
                above[i] = i = above[above[i]]
            return i

        if len(a) and len(b):
            for i, j in linked([sets[i] for i in a], [sets[i] for i in b], percent):
                x, y = root(a[i]), root(b[j])
                above[max(x, y)] = min(x, y)
        first = np.array([root(i) for i in range(len(docs))], dtype=np.int64)
        out = pa.table({"u": pa.array(docs, pa.int64()), "v": pa.array(docs[first], pa.int64())})
        return out.filter(pc.not_equal(out.column("u"), out.column("v")))

    return blocks.groupBy("g1", "g2", "g3").applyInArrow(compare, "u long, v long")


def join(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT, pair_limit: int = PAIR_LIMIT, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row for each row of ``df``: key, n_shingles, component_id (the smallest key that links
    reach, itself included). Two rows link when the intersection of their shingle sets is at least
    ``percent`` of the union; equal sets always link.

    A null or empty text has no shingles and links with nothing. Rows that share a key are one
    document: a link of either holds for both. A row with a null key gets the component of the rows
    with an equal set, null if there is none with a key. Other columns are not read.
    """
    return components_of(df, key, text, words, percent, pair_limit, block_tokens, Scratch(df.sparkSession, "ngram-join"))


def components_of(df: DataFrame, key: str, text: str, words: int, percent: int, pair_limit: int, block_tokens: int, scratch: Scratch) -> DataFrame:
    """``join`` with its tables in ``scratch``; those that the result reads stay, all others go."""
    broadcast = df.sparkSession.sparkContext.broadcast
    docs = keyed_text(df, key, text).toDF("doc_id", "text")
    known = frequent(scratch.keep(token_counts(docs, words), "known"), KNOWN_TOKENS).toArrow()
    order = Order(known.column("token").to_numpy(), known.column("n").to_numpy())
    keys, names, classes, many = prefixes(docs, order, words, percent, scratch, "first")
    crowded = frequent(many.where(F.col("n") > pair_limit), KNOWN_TOKENS).toArrow()
    if crowded.num_rows:  # tokens that many prefixes share go later in the order, and the prefixes are taken anew
        order = order.with_counts(crowded.column("token").to_numpy(), crowded.column("n").to_numpy())
        scratch.drop("first")
        keys, names, classes, many = prefixes(docs, order, words, percent, scratch, "second")
    sieve = broadcast(sieve_of(many.select("token")))
    shared = scratch.keep(postings_of(classes, sieve).join(many.hint("merge"), "token"), "shared")
    sieve.destroy()
    scratch.drop("known", *(f"{k}/{t}" for k in ("first", "second") for t in ("classes", "many")))

    fits = lambda a, b: F.col(a) * 100 >= F.col(b) * percent
    few = shared.where(F.col("n") <= pair_limit).select("token", "doc", "size", "matches")
    other = few.toDF("token", "doc2", "size2", "matches2")
    pairs = few.join(other.hint("merge"), "token").where((F.col("doc") < F.col("doc2")) & fits("size", "size2") & fits("size2", "size"))
    pairs = pairs.groupBy("doc", "doc2").agg(F.count("*").alias("hits"), *(F.first(c).alias(c) for c in ("size", "size2", "matches", "matches2")))
    # what the prefixes leave out bounds the rest of the overlap, so the sizes may ask for more hits
    beyond = lambda n, k: F.ceil(F.col(n) * percent / 100) - F.col(k)
    whole = F.ceil((F.col("size") + F.col("size2")) * percent / (100 + percent))
    need = F.greatest(F.least("matches", "matches2"), whole - F.greatest(beyond("size", "matches"), beyond("size2", "matches2")))
    pairs = scratch.keep(pairs.where(F.col("hits") >= need).select("doc", "doc2"), "pairs")
    # the postings of a token that many share meet its leader in shares of bounded size
    often = shared.where(F.col("n") > pair_limit)
    shares = F.ceil(F.col("n") / SHARE_ROWS).cast("long")
    lead = often.groupBy("token").agg(F.max("n").alias("n"), F.max_by(F.col("doc"), F.col("known") * F.lit(1 << 40) + F.hash("doc")).alias("leader"))
    lead = scratch.keep(lead.select("token", "leader", F.explode(F.sequence(F.lit(0).cast("long"), shares - 1)).alias("share")), "lead")
    often = often.withColumn("share", F.pmod(F.xxhash64("doc"), shares))
    stars = scratch.keep(often.join(lead.hint("merge"), ["token", "share"]).select("leader", "doc", "size").distinct(), "stars")
    sized = names.groupBy("doc").agg(F.max("size").alias("size"))
    scratch.drop("shared", "lead")

    zero = F.lit(0).cast("long")
    chunk = lambda c, n: F.pmod(F.xxhash64(c), F.col(n))
    load = lambda c: F.sum(F.greatest(c, F.lit(LEAST_LOAD)))
    blocks = lambda n: F.ceil(n / F.lit(block_tokens)).cast("long")
    # pairs: what they connect is one block where a task can hold it, so each set moves once
    zones = scratch.keep(components(pairs, scratch, "doc", "doc2", "zone").toDF("doc", "zone").join(sized, "doc"), "zones")
    loads = scratch.keep(zones.groupBy("zone").agg(blocks(load("size")).alias("k")), "loads")
    whole = zones.join(loads.where("k = 1"), "zone").select(F.col("zone").alias("g1"), zero.alias("g2"), F.lit(2).alias("side"), "doc")
    # else the smaller document of each pair meets its partners, in chunks
    loose = pairs.join(zones.join(loads.where("k > 1"), "zone").select("doc"), "doc")
    loose = scratch.keep(loose.join(sized.toDF("doc2", "size2"), "doc2"), "loose")
    ahead = scratch.keep(loose.groupBy("doc").agg(blocks(load("size2")).alias("k")), "ahead")
    right = loose.join(ahead, "doc").select(F.col("doc").alias("g1"), (chunk("doc2", "k") + 1).alias("g2"), F.lit(1).alias("side"), F.col("doc2").alias("doc"))
    left = ahead.select(F.col("doc").alias("g1"), F.explode(F.sequence(zero + 1, F.col("k"))).alias("g2"), F.lit(0).alias("side"), "doc")
    # stars: the leader against its members
    crowd = scratch.keep(stars.groupBy("leader").agg(F.ceil(load("size") / F.lit(max(1, block_tokens // STAR_SHARE))).cast("long").alias("k")), "crowd")
    members = stars.where("doc <> leader").join(crowd, "leader").select(F.col("leader").alias("g1"), (-1 - chunk("doc", "k")).alias("g2"), F.lit(1).alias("side"), "doc")
    leaders = crowd.select(F.col("leader").alias("g1"), F.explode(F.sequence(zero + 1, F.col("k"))).alias("g2"), F.lit(0).alias("side"), F.col("leader").alias("doc")).withColumn("g2", -F.col("g2"))
    placed = scratch.keep(whole.unionByName(left).unionByName(right).unionByName(members).unionByName(leaders).withColumn("g3", zero), "placed")
    scratch.drop("pairs", "zones", "loads", "loose", "ahead", "crowd")

    def compared(placed: DataFrame, name: str) -> DataFrame:
        sieve = broadcast(sieve_of(placed.select("doc").distinct()))
        out = scratch.keep(block_links(sets_of(docs, sieve, words).join(placed.hint("merge"), "doc"), percent), name)
        sieve.destroy()
        return out

    links = compared(placed, "links")
    found = components(links, scratch, "u", "v", "first-found")

    # members that no link ties to their leader, against all members of its star, in blocks
    part = stars.join(found.toDF("doc", "mine"), "doc", "left").join(found.toDF("leader", "theirs"), "leader", "left")
    part = scratch.keep(part.select("leader", "doc", "size", (F.coalesce("mine", "doc") != F.coalesce("theirs", "leader")).alias("apart")), "apart")
    loads = part.groupBy("leader").agg(blocks(load("size")).alias("k"), blocks(F.sum(F.when(F.col("apart"), F.greatest("size", F.lit(LEAST_LOAD))))).alias("r")).where("r > 0")
    loads = scratch.keep(loads, "apart-loads")
    spread = part.join(loads, "leader")
    alone = spread.where("apart").select(F.col("leader").alias("g1"), F.explode(F.sequence(zero, F.col("k") - 1)).alias("g2"), chunk("doc", "r").alias("g3"), F.lit(0).alias("side"), "doc")
    rest = spread.select(F.col("leader").alias("g1"), chunk("doc", "k").alias("g2"), F.explode(F.sequence(zero, F.col("r") - 1)).alias("g3"), F.lit(1).alias("side"), "doc")
    placed = scratch.keep(alone.unionByName(rest), "placed-apart")
    if placed.limit(1).count():
        more = compared(placed, "more-links")
        found = components(links.unionByName(more), scratch, "u", "v", "second-found")
        scratch.drop("first-found")
    scratch.drop("stars", "placed", "links", "apart", "apart-loads", "placed-apart", "more-links")

    named = names.select("set_key", "doc").join(found.toDF("doc", "component_id"), "doc", "left").select("set_key", F.coalesce("component_id", "doc").alias("component_id"))
    named = scratch.keep(named, "named")  # a table of its own, so that Spark can split the copies of a text among tasks
    scratch.drop("first-found", "second-found", *(f"{k}/names" for k in ("first", "second")))
    worded = keys.where("set_key is not null").join(named.hint("merge"), "set_key", "left").select("doc_id", "n_shingles", "component_id")
    empty = keys.where("set_key is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"))
    return worded.unionByName(empty).select(F.col("doc_id").alias(key), "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


#: Rows that leave up to which their keys are broadcast (8 MB); more are joined by key.
BROADCAST_KEYS = 1_000_000


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``df``, all columns, without those whose component has a smaller key. Rows that
    share a key stay or go together; rows without a key stay."""
    scratch, inner = Scratch(df.sparkSession, "one-of-each"), Scratch(df.sparkSession, "ngram-join")
    extra = scratch.keep(components_of(df, key, text, words, percent, PAIR_LIMIT, BLOCK_TOKENS, inner).where(f"component_id <> {key}").select(key).distinct(), "extra")
    inner.drop()
    return df.join(F.broadcast(extra) if extra.count() <= BROADCAST_KEYS else extra.hint("merge"), key, "left_anti")
