"""Language-model scoring with Brown class bigrams.

Exchange clustering assigns words to classes. The most frequent words move to the class in which the
class bigrams of the training text are likeliest, until that gains nothing more. Two distributed passes then give
every further word of the training text the class of highest likelihood from its own bigram counts
against these classes. A text is scored by class transitions and by the emission of each word from
its class, both smoothed; what discounting frees is left to unseen words, by a spelling model.

Counts cover the whole training text. Frequent words, a bounded set, are resolved where the text is
read; the rest is joined with the table of words, so nothing that grows with the vocabulary is sent
to every task. A frequent word is a history by its class, all others are one history together.
"""

from __future__ import annotations

from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspan.llm.common import Scratch, frequent, map_arrow, raw_texts, slices
from reelspan.llm.quality import remainder

#: Words resolved where the text is read (a bounded broadcast); words that are exchanged until none
#: moves; classes. Class 0 is the end of a text alone; the number CLASSES stands for what has no class.
HOT_WORDS, OWN_WORDS, CLASSES = 200_000, 1536, 48
#: Distinct counts or words that a task holds before it passes them on; words of one partition.
CELLS_HELD, COUNT_ENTRIES, PARTITION_WORDS = 1_000_000, 400_000, 200_000
#: The weight of a class's overall frequency in its transition probabilities; the share of n log n (n
#: bigrams) that a sweep must gain for another to follow.
PRIOR, SETTLED = 20.0, 1e-6
END = b""


def tokens_of(body: bytes) -> list[bytes]:
    """Words in lower-case ASCII, parted by ASCII white space; the end is counted apart."""
    return body.lower().split()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts, with the end as the empty word."""

    def run(batches):
        counts: Counter = Counter()

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for piece in slices(batch):
                for body in raw_texts(piece.column(1)):
                    counts.update(tokens_of(body))
                    counts[END] += 1
                if len(counts) > COUNT_ENTRIES:
                    yield flush()
                    counts.clear()
        yield flush()

    return map_arrow(docs, run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def numbered(piece: pa.RecordBatch, number: dict, rest: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all tokens of a piece, text after text, -1 for a word without one, with an end
    (0) before and after each text; and the place of each text's last end. Words without a number
    are added to ``rest``."""
    get, flat, ends = number.get, [0], []
    for body in raw_texts(piece.column(1)):
        tokens = tokens_of(body)
        flat.extend(map(get, tokens, repeat(-1)))
        if rest is not None:
            rest.extend([w for w in tokens if w not in number])
        ends.append(len(flat))
        flat.append(0)
    return np.array(flat, dtype=np.int64), np.array(ends, dtype=np.int64)


def numbers(words: list[bytes]) -> dict[bytes, int]:
    """The number of each word: its place."""
    return {w: i for i, w in enumerate(words)}


def own_bigrams(docs: DataFrame, own: list[bytes]) -> np.ndarray:
    """How often each of ``own`` (the end first) follows each; all other words are one symbol after
    them. At most (OWN_WORDS + 2) squared cells, whatever the input."""
    shared = docs.sparkSession.sparkContext.broadcast(own)
    size = len(own) + 1

    def run(batches):
        number, out = numbers(shared.value), np.zeros(size * size, dtype=np.int64)
        for batch in batches:
            for piece in slices(batch):
                ids, _ = numbered(piece, number)
                ids[ids < 0] = size - 1
                out += np.bincount(ids[:-1] * size + ids[1:], minlength=size * size)
        used = np.flatnonzero(out)
        for i in range(0, len(used), 100_000):
            part = used[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(out[part])], names=["code", "n"])

    found = map_arrow(docs, run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    shared.destroy()
    out = np.zeros(size * size)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return out.reshape(size, size)


def f(x: np.ndarray) -> np.ndarray:
    """x log x of counts."""
    return x * np.log(np.maximum(x, 1.0))


def gains(grid: np.ndarray, row: np.ndarray, column: np.ndarray, self_n: float) -> np.ndarray:
    """What joining each class adds to the likelihood, for a symbol that is in none: ``row`` and
    ``column`` count the classes after and before it, ``self_n`` how often it follows itself."""
    base = f(grid)
    by_row, by_column = f(grid + row[None, :]) - base, f(grid + column[:, None]) - base
    diagonal = np.diag(grid)
    gain = by_row.sum(1) - np.diag(by_row) + by_column.sum(0) - np.diag(by_column) + f(diagonal + row + column + self_n) - f(diagonal)
    out, into = grid.sum(1) + column, grid.sum(0) + row  # whichever class it joins, it stands before and after these
    gain -= f(out + row.sum() + self_n) - f(out) + f(into + column.sum() + self_n) - f(into)
    gain[0] = -np.inf
    return gain


def tolerance(total: float) -> float:
    """Gains below this are rounding at so many bigrams."""
    return 1e-9 + 1e-12 * total * np.log(max(total, 1.0))


def exchange(bigrams: np.ndarray, classes: int = CLASSES, rest: bool = False) -> np.ndarray:
    """The class of each symbol by exchange clustering; the end (symbol 0) is class 0 alone. With
    ``rest`` the last symbol stands for all other words and stays alone in one class more.

    Starts from a deal by frequency; in each sweep symbols in order of frequency move to the class
    with the highest likelihood of the class bigrams, until none moves or all moves of a sweep together
    gain less than SETTLED. Ties keep the lowest class, so the result depends on the counts alone."""
    size, every = len(bigrams), classes + rest
    weight = bigrams.sum(0) + bigrams.sum(1)
    order = [s for s in np.argsort(-weight, kind="stable").tolist() if 0 < s < size - rest]
    cls = np.zeros(size, dtype=np.int64)
    for rank, s in enumerate(order):
        cls[s] = 1 + rank % (classes - 1)
    if rest:
        cls[-1] = classes
    one = np.zeros((size, every))
    one[np.arange(size), cls] = 1
    grid = one.T @ bigrams @ one
    least = tolerance(float(bigrams.sum()))
    while True:
        moved, gained = 0, 0.0
        for s in order:
            if not weight[s]:
                continue
            own = cls[s]
            row, column, self_n = np.bincount(cls, weights=bigrams[s], minlength=every), np.bincount(cls, weights=bigrams[:, s], minlength=every), bigrams[s, s]
            row[own] -= self_n
            column[own] -= self_n
            grid[own] -= row
            grid[:, own] -= column
            grid[own, own] -= self_n
            gain = gains(grid, row, column, self_n)[:classes]
            best = int(gain.argmax())
            if gain[best] <= gain[own] + least:
                best = own
            moved += best != own
            gained += gain[best] - gain[own]
            cls[s] = best
            grid[best] += row
            grid[:, best] += column
            grid[best, best] += self_n
        if not moved or gained < SETTLED * f(bigrams.sum()):
            return cls


class Judge:
    """The likeliest class of words, from class bigrams among classes and the rest."""

    def __init__(self, grid: np.ndarray):
        overall = (grid.sum(0) + 1) / (grid.sum() + len(grid))
        move = np.log((grid + PRIOR * overall[None, :]) / (grid.sum(1, keepdims=True) + PRIOR))
        classes = len(grid) - 1
        self.after, self.before = move[:, 1:classes], move[1:classes].T
        self.size = np.log(grid.sum(0)[1:classes] + 1)

    def classes(self, cells: np.ndarray) -> np.ndarray:
        """For each row (counts by what is before, then by what follows): the class that makes these
        bigrams likeliest, with the word's share of it. Ties take the lowest class."""
        half = cells.shape[1] // 2
        before, after = cells[:, :half], cells[:, half:]
        score = before @ self.after + after @ self.before - before.sum(1, keepdims=True) * self.size[None, :]
        return 1 + np.round(score, 6).argmax(1)


class Cells:
    """Counts by (word, neighbour) that are added up and passed on as one row of a word."""

    def __init__(self, width: int):
        self.width, self.codes, self.n, self.held = width, [], [], 0

    def add(self, codes: np.ndarray, n: np.ndarray | None = None) -> bool:
        """Whether so much is held now that it should be taken."""
        if n is None:
            codes, n = np.unique(codes, return_counts=True)
        self.codes.append(codes)
        self.n.append(n)
        self.held += len(codes)
        if self.held <= CELLS_HELD:
            return False
        self.settle()
        return self.held > CELLS_HELD // 2

    def settle(self) -> tuple[np.ndarray, np.ndarray]:
        """The sums so far, by code."""
        if not self.codes:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        codes, place = np.unique(np.concatenate(self.codes), return_inverse=True)
        n = np.bincount(place, weights=np.concatenate(self.n), minlength=len(codes)).astype(np.int64)
        self.codes, self.n, self.held = [codes], [n], len(codes)
        return codes, n

    def take(self):
        """(word numbers, cells, counts) of what is held, lists as Arrow arrays; then nothing is."""
        codes, n = self.settle()
        self.codes, self.n, self.held = [], [], 0
        words, starts = np.unique(codes // self.width, return_index=True)
        ends = [*starts.tolist(), len(codes)]
        for i in range(0, len(words), 50_000):
            part = words[i : i + 50_000]
            low, high = ends[i], ends[i + len(part)]
            offsets = pa.array(np.array(ends[i : i + len(part) + 1]) - low, pa.int32())
            yield part, pa.ListArray.from_arrays(offsets, pa.array((codes[low:high] % self.width).astype(np.int16))), pa.ListArray.from_arrays(offsets, pa.array(n[low:high]))

    def rows(self):
        """(word numbers, dense counts) of what is held, some thousand words at a time."""
        codes, n = self.settle()
        words, starts = np.unique(codes // self.width, return_index=True)
        ends = [*starts.tolist(), len(codes)]
        for i in range(0, len(words), 4096):
            part = words[i : i + 4096]
            low, high = ends[i], ends[i + len(part)]
            dense = np.zeros((len(part), self.width))
            dense[np.searchsorted(part, codes[low:high] // self.width), codes[low:high] % self.width] = n[low:high]
            yield part, dense


def listed(batch: pa.RecordBatch, numbers_: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes, counts) of rows whose columns 1 and 2 list cells and counts."""
    cells = batch.column(1)
    owner = np.repeat(numbers_, np.diff(cells.offsets.to_numpy()))
    return owner * width + cells.flatten().to_numpy(), batch.column(2).flatten().to_numpy()


def hot_classes(docs: DataFrame, hot: list[bytes], cls: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """The classes of ``hot``: those of the first words (``cls``, the end first), and for each further
    word the likeliest one from its neighbours among them."""
    first, classes, width = len(cls), len(grid) - 1, 2 * len(grid)
    shared = docs.sparkSession.sparkContext.broadcast((hot, np.concatenate([cls, np.full(len(hot) - first + 1, classes)]), Judge(grid)))

    def count(batches):
        hot, state, _ = shared.value
        number, cells = numbers(hot), Cells(width)
        pack = lambda: (pa.RecordBatch.from_arrays([pa.array(w), c, n], names=["id", "cells", "n"]) for w, c, n in cells.take())
        for batch in batches:
            for piece in slices(batch):
                ids, _ = numbered(piece, number)
                states = state[ids]
                at = np.flatnonzero(ids >= first)
                base = ids[at] * width
                if cells.add(np.concatenate([base + states[at - 1], base + len(grid) + states[at + 1]])):
                    yield from pack()
        yield from pack()

    def choose(batches):
        cells, judge = Cells(width), shared.value[2]
        for batch in batches:
            cells.add(*listed(batch, batch.column(0).to_numpy(), width))
        for words, dense in cells.rows():
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(judge.classes(dense).astype(np.int32))], names=["id", "cls"])

    found = map_arrow(map_arrow(docs, count, "id long, cells array<smallint>, n array<long>").repartition("id"), choose, "id long, cls int").toArrow()
    shared.destroy()
    out = np.concatenate([cls, np.ones(len(hot) - first, dtype=np.int64)])
    out[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return out


def further_words(docs: DataFrame, hot: list[bytes], cls: np.ndarray, grid: np.ndarray, parts: int, scratch: Scratch) -> tuple[DataFrame, np.ndarray]:
    """(word, n, cls) of all words of the texts that are not ``hot``, each in its likeliest class; and
    how often each class follows each class of ``hot`` words and, last, all others."""
    classes, width = len(grid) - 1, 2 * len(grid)
    shared = docs.sparkSession.sparkContext.broadcast((hot, np.append(cls, classes), Judge(grid)))
    square = len(grid) ** 2

    def count(batches):
        hot, state, _ = shared.value
        number, cells, names, moves = numbers(hot), Cells(width), {}, np.zeros(square, dtype=np.int64)

        def pack():
            known = list(names)
            for w, c, n in cells.take():
                yield pa.RecordBatch.from_arrays([pa.array([known[i] for i in w.tolist()], pa.binary()), c, n], names=["word", "cells", "n"])
            names.clear()

        for batch in batches:
            for piece in slices(batch):
                rest: list[bytes] = []
                ids, _ = numbered(piece, number, rest)
                states = state[ids]
                moves += np.bincount(states[:-1] * len(grid) + states[1:], minlength=square)
                at = np.flatnonzero(ids < 0)
                base = np.array([names.setdefault(w, len(names)) for w in rest], dtype=np.int64) * width
                if cells.add(np.concatenate([base + states[at - 1], base + len(grid) + states[at + 1]])) or len(names) > COUNT_ENTRIES:
                    yield from pack()
        yield from pack()
        used = np.flatnonzero(moves)
        mark = b" %d" % TaskContext.get().partitionId()  # a blank begins no word
        yield pa.RecordBatch.from_arrays([pa.array([mark], pa.binary()), pa.array([used.astype(np.int16)], pa.list_(pa.int16())), pa.array([moves[used]], pa.list_(pa.int64()))], names=["word", "cells", "n"])

    def choose(batches):
        cells, names, judge, moves = Cells(width), {}, shared.value[2], np.zeros(square, dtype=np.int64)
        types = [pa.binary(), pa.int64(), pa.int32(), pa.list_(pa.int64())]
        out = lambda columns: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["word", "n", "cls", "moves"])
        for batch in batches:
            marked = pa.array([w[:1] == b" " for w in batch.column(0).to_pylist()], pa.bool_())
            own, whole = batch.filter(pc.invert(marked)), batch.filter(marked)
            cells.add(*listed(own, np.array([names.setdefault(w, len(names)) for w in own.column(0).to_pylist()], dtype=np.int64), width))
            np.add.at(moves, whole.column(1).flatten().to_numpy(), whole.column(2).flatten().to_numpy())
        known, grid = list(names), moves.reshape(classes + 1, classes + 1)
        for words, dense in cells.rows():
            best, before = judge.classes(dense), dense[:, : classes + 1].astype(np.int64)
            np.add.at(grid.T, best, before)
            grid[:, classes] -= before.sum(0)  # they have a class now
            yield out([[known[i] for i in words.tolist()], before.sum(1), best, [None] * len(best)])
        yield out([[None], [0], [0], [moves]])

    counted = map_arrow(docs, count, "word binary, cells array<smallint>, n array<long>").repartition(parts, "word")
    table = scratch.keep(map_arrow(counted, choose, "word binary, n long, cls int, moves array<long>"), "words")
    shared.destroy()

    def summed(batches):
        moves = np.zeros(square, dtype=np.int64)
        for batch in batches:
            moves += batch.column(0).flatten().to_numpy().reshape(-1, square).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % 16], pa.int32()), pa.array([moves], pa.list_(pa.int64()))], names=["part", "moves"])

    def together(data: pa.Table) -> pa.Table:
        moves = data.column("moves").combine_chunks().flatten().to_numpy().reshape(-1, square).sum(0)
        return pa.table({"moves": pa.array([moves], pa.list_(pa.int64()))})

    shares = map_arrow(table.where("word is null").select("moves"), summed, "part int, moves array<long>")
    moves = np.zeros(square)
    for r in shares.groupBy("part").applyInArrow(together, "moves array<long>").collect():  # 16 at most
        moves += r["moves"]
    return table.where("word is not null").select("word", "n", "cls"), moves.reshape(classes + 1, classes + 1)[:, :classes]


class Model:
    """Class transitions and emission constants, from counts."""

    def __init__(self, moves: np.ndarray, totals: np.ndarray):
        """``moves``: how often each class follows each history; ``totals``: for each class its tokens,
        its words, those seen once and those seen twice."""
        classes = moves.shape[1]
        overall = (moves.sum(0) + 1) / (moves.sum() + classes)
        self.follow = np.log10((moves + PRIOR * overall[None, :]) / (moves.sum(1, keepdims=True) + PRIOR))
        n, v, once, twice = totals.T
        self.n = np.maximum(n, 1.0)
        self.discount = np.where(v > 0, (once + 0.5) / (once + 2 * twice + 1), 0.0)
        self.discount[0] = 0.0  # the end is all of its class
        held_back = np.where(n > 0, self.discount * v / self.n, 1.0)
        #: log10 of the probability that an unseen word follows each history, whatever its class.
        self.unseen = np.log10(np.maximum((10**self.follow) @ held_back, 1e-12))

    def emission(self, counts: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """log10 of the probability of seen words of these counts in their classes. After any history
        all seen words and the one symbol for unseen words sum to one."""
        return np.log10(np.maximum(counts - self.discount[classes], 1e-12) / self.n[classes])


def score(df: DataFrame, key: str = "doc_id", text: str = "text", hot_words: int = HOT_WORDS, own_words: int = OWN_WORDS) -> DataFrame:
    """One row for each row of ``df``: key, held_out, n_tokens, n_known, train_tokens, base_score,
    score (log10 probabilities of the text) and perplexity (10 to -score / n_tokens).

    Learns from rows whose crc32(key as text) mod 7 is not 2; a row with a null key is neither held
    out nor learned from. A null text counts as empty: one token, the end. Repeated rows count
    each. Without training rows the base is log10(1) and the model knows nothing. Other columns are
    not read.

    Plan: a pass counts words (map-side, then by word), one counts bigrams of the most frequent
    ones, two give classes to all others, one scores. Rare words of a text go through an equi-join
    with the table of words; frequent ones never do.
    """
    spark, scratch = df.sparkSession, Scratch(df.sparkSession, "class-lm")
    docs = df.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    training = docs.where(remainder("key", 7) != 2)
    counts = scratch.keep(word_counts(training), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    found = frequent(counts.where(F.length("word") > 0), hot_words).toArrow()
    ends = counts.where(F.length("word") == 0).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    ranked = sorted(zip(found.column("word").to_pylist(), found.column("n").to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))
    hot, hot_n = [END, *(w for w, _ in ranked)], np.array([ends, *(n for _, n in ranked)], dtype=np.float64)
    scratch.drop("counts")

    own = hot[: 1 + own_words]
    bigrams = own_bigrams(training, own)
    cls = exchange(bigrams, CLASSES, rest=True)
    one = np.zeros((len(cls), CLASSES + 1))
    one[np.arange(len(cls)), cls] = 1
    grid = one.T @ bigrams @ one
    cls = hot_classes(training, hot, cls[:-1], grid)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(distinct - len(hot)) // PARTITION_WORDS))
    words, moves = further_words(training, hot, cls, grid, parts, scratch)

    totals = np.zeros((CLASSES, 4))
    np.add.at(totals, cls, np.stack([hot_n, hot_n > 0, hot_n == 1, hot_n == 2], axis=1))
    for r in words.groupBy("cls").agg(F.sum("n"), F.count("*"), F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).collect():
        totals[r[0]] += r[1:]
    model, divisor = Model(moves, totals), float(total + distinct + 1)
    shared = spark.sparkContext.broadcast((hot, hot_n, cls, model))

    def run(batches):
        hot, hot_n, cls, model = shared.value
        number, state = numbers(hot), np.append(cls, CLASSES)
        emit, base, seen = model.emission(hot_n, cls), np.log10((hot_n + 1) / divisor), hot_n > 0
        uid = TaskContext.get().partitionId() << 33
        types = [pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        for batch in batches:
            for piece in slices(batch):
                rest: list[bytes] = []
                ids, ends = numbered(piece, number, rest)
                states, known = state[ids], (ids >= 0)[1:]
                after = np.where(known, ids[1:], 0)
                starts = np.r_[0, ends[:-1]]
                per_text = lambda x: np.add.reduceat(np.where(known, x, 0), starts)  # noqa: E731, B023
                moved = model.follow[states[:-1], np.minimum(states[1:], CLASSES - 1)]
                n, uids = len(ends), np.arange(uid, uid + len(ends))
                uid += n
                whole = [uids, [b" %d" % u for u in uids.tolist()], [None] * n, [1] * n, piece.column(0), ends - starts, per_text(seen[after]), per_text(base[after]), per_text(moved + emit[after])]
                at = np.flatnonzero(ids < 0)
                owner = np.searchsorted(ends, at)
                tail = Counter(zip(owner.tolist(), rest, states[at - 1].tolist(), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(whole, types, strict=True)], names=NAMES)
                if tail:
                    none = [None] * len(tail)
                    rows = [uids[[o for o, _, _ in tail]], [w for _, w, _ in tail], [g for _, _, g in tail], list(tail.values()), none, none, none, none, none]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names=NAMES)

    parts = map_arrow(docs, run, "uid long, word binary, history int, times long, key long, tokens long, known long, base double, model double")
    joined = parts.join(words.hint("shuffle_hash"), "word", "left").withColumn("cls", F.coalesce("cls", F.lit(CLASSES)))
    constants = [(g, c, float(model.follow[g, c]), float(model.discount[c]), float(model.n[c])) for g in range(CLASSES + 1) for c in range(CLASSES)]
    constants += [(g, CLASSES, float(x), 0.0, 1.0) for g, x in enumerate(model.unseen)]
    joined = joined.join(F.broadcast(spark.createDataFrame(constants, "history int, cls int, move double, discount double, size double")), ["history", "cls"], "left")
    n, whole = F.coalesce("n", F.lit(0)), F.col("tokens").isNotNull()  # a row of a text as a whole has a word that no text can have
    emission = F.when(n > 0, F.log10((n - F.col("discount")) / F.col("size"))).otherwise(0.0)
    summed = joined.groupBy("uid").agg(
        F.max("key").alias(key), F.max("tokens").alias("n_tokens"),
        F.sum(F.when(whole, F.col("known")).when(n > 0, F.col("times")).otherwise(F.lit(0))).cast("long").alias("n_known"),
        F.sum(F.when(whole, F.col("base")).otherwise(F.col("times") * F.log10((n + 1) / F.lit(divisor)))).alias("base_score"),
        F.sum(F.when(whole, F.col("model")).otherwise(F.col("times") * (F.col("move") + emission))).alias("score"),
    )
    return summed.select(key, F.coalesce(remainder(key, 7) == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


NAMES = ["uid", "word", "history", "times", "key", "tokens", "known", "base", "model"]
