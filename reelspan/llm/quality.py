"""Quality classifier: a sparse ensemble of rules over text statistics.

Boosted shallow trees are grown on the statistics of a bounded sample of labelled documents. Each
path from a root to a node is a conjunctive rule; a logistic regression with an L1 penalty keeps
few of them. The kept rules become one Spark column expression, which scores the statistics of all
documents inside the JVM.
"""

from __future__ import annotations

import operator
import string
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelspan.llm.common import keyed_text, map_arrow, map_batches, raw_texts, slices

#: Labelled rows that a model is fitted on at most, those of the smallest hash of their id: this
#: many (id, label) pairs and rows of statistics come to the driver.
SAMPLE_ROWS = 20_000
TREES, DEPTH, BINS, SHRINK, LEAST_ROWS = 40, 3, 48, 0.3, 15
PENALTY, STEPS = 0.003, 400
#: A document is kept from this score on.
KEEP = 0.7

STATS = ("n_bytes", "n_words", "mean_word", "longest_word", "distinct_words", "repeated_next", "upper_letters", "shouted_words", "digits", "symbols", "bangs", "bars", "marked_words", "repeated_lines", "words_a_line", "packed")
_UPPER, _LETTERS = string.ascii_uppercase.encode(), string.ascii_letters.encode()
_SYMBOLS = b"#$%&*+/<=>@[\\]^_{|}~"


def text_stats(body: bytes) -> tuple[float, ...]:
    """The statistics of a text, in the order of STATS; all 0 for an empty one."""
    words = body.split()
    if not words:
        return (float(len(body)), *[0.0] * (len(STATS) - 1))
    n, size = len(words), len(body)
    lengths = list(map(len, words))
    lines = [x for x in body.split(b"\n") if x.strip()]
    upper = size - len(body.translate(None, _UPPER))
    letters = size - len(body.translate(None, _LETTERS))
    marked = sum(1 for w in words if w[-1] in _SYMBOLS or w.endswith(b"!!"))
    return (
        float(size), float(n), sum(lengths) / n, float(max(lengths)), len(set(words)) / n,
        sum(map(operator.eq, words, words[1:])) / n, upper / max(letters, 1), sum(map(bytes.isupper, words)) / n,
        (size - len(body.translate(None, b"0123456789"))) / size, (size - len(body.translate(None, _SYMBOLS))) / size,
        body.count(b"!") / size, body.count(b"|") / size, marked / n, 1 - len(set(lines)) / len(lines), n / len(lines),
        len(zlib.compress(body, 1)) / size,
    )


def with_stats(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key and the statistics of each row; nothing else of ``df``."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = np.array([text_stats(b) for b in raw_texts(batch.column(1))], dtype=np.float64)
            return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(rows[:, i]) for i in range(len(STATS)))], names=[key, *STATS])

        return work

    return map_batches(keyed_text(df, key, text), make, f"{key} long, " + ", ".join(f"{s} double" for s in STATS))


HELD = "quality_stats__"


def beside_stats(df: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``df`` and one more, HELD: a struct of the statistics."""
    place = df.columns.index(text)
    schema = T.StructType([*df.schema.fields, T.StructField(HELD, T.StructType([T.StructField(s, T.DoubleType()) for s in STATS]))])

    def run(batches):
        for batch in batches:
            for piece in slices(batch, place):
                rows = np.array([text_stats(b or b"") for b in raw_texts(piece.column(place))], dtype=np.float64)
                held = pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(len(STATS))], names=list(STATS))
                yield pa.RecordBatch.from_arrays([*piece.columns, held], names=[*piece.schema.names, HELD])

    return map_arrow(df, run, schema)


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, is at most, value) conditions and its weight."""

    conditions: tuple[tuple[str, bool, float], ...]
    weight: float = 0.0

    def holds(self, x: np.ndarray) -> np.ndarray:
        """Which rows of a matrix of statistics it holds for."""
        out = np.ones(len(x), dtype=bool)
        for name, below, value in self.conditions:
            column = x[:, STATS.index(name)]
            out &= column <= value if below else column > value
        return out

    def column(self, prefix: str = "") -> Column:
        """The rule as a Spark condition; ``prefix`` goes before the names of the statistics."""
        return F.expr(" and ".join(f"{prefix}{name} {'<=' if below else '>'} {value!r}D" for name, below, value in self.conditions))


@dataclass(frozen=True)
class RuleModel:
    """Rules with weights, and an intercept."""

    intercept: float
    rules: tuple[Rule, ...]

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1, from statistics."""
        z = np.full(len(x), self.intercept)
        for rule in self.rules:
            z += rule.weight * rule.holds(x)
        return 1 / (1 + np.exp(-z))

    def column(self, prefix: str = "") -> Column:
        """The same as a Spark column over the statistics."""
        z = F.lit(self.intercept)
        for rule in self.rules:
            z = z + F.when(rule.column(prefix), F.lit(rule.weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def grow(x: np.ndarray, binned: np.ndarray, edges: list[np.ndarray], residual: np.ndarray, rows: np.ndarray, path: tuple, depth: int, found: set, out: np.ndarray) -> None:
    """Grows a regression tree by histogram splits; adds each node's path to ``found`` and the
    leaves' means to ``out``."""
    if path:
        found.add(path)
    best = None
    if depth and len(rows) >= 2 * LEAST_ROWS:
        total, count = residual[rows].sum(), len(rows)
        for f in range(x.shape[1]):
            sums = np.bincount(binned[rows, f], weights=residual[rows], minlength=BINS + 1).cumsum()[:-1]
            counts = np.bincount(binned[rows, f], minlength=BINS + 1).cumsum()[:-1]
            fit = (counts >= LEAST_ROWS) & (count - counts >= LEAST_ROWS)
            if not fit.any():
                continue
            gain = np.where(fit, sums**2 / np.maximum(counts, 1) + (total - sums) ** 2 / np.maximum(count - counts, 1), -np.inf)
            k = int(gain.argmax())
            if best is None or gain[k] > best[0] + 1e-12:
                best = (gain[k], f, k)
        if best and best[0] <= total**2 / count + 1e-9:
            best = None
    if best is None:
        out[rows] = residual[rows].mean()
        return
    _, f, k = best
    value = float(edges[f][k]) if k < len(edges[f]) else float(edges[f][-1])
    left = binned[rows, f] <= k
    grow(x, binned, edges, residual, rows[left], (*path, (STATS[f], True, value)), depth - 1, found, out)
    grow(x, binned, edges, residual, rows[~left], (*path, (STATS[f], False, value)), depth - 1, found, out)


def fit(x: np.ndarray, y: np.ndarray) -> RuleModel:
    """Fits a sparse rule model; with no rows or one label only, a constant one."""
    if not len(y) or y.min() == y.max():
        p = float((y.sum() + 1) / (len(y) + 1)) if len(y) else 1.0
        return RuleModel(float(np.log(max(p, 1e-6) / max(1 - p, 1e-6))), ())
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    paths: set = set()
    z = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    for _ in range(TREES):
        step = np.zeros(len(y))
        p = 1 / (1 + np.exp(-z))
        grow(x, binned, edges, y - p, np.arange(len(y)), (), DEPTH, paths, step)
        z += SHRINK * step / max(0.05, float((p * (1 - p)).mean())) if np.abs(step).max() > 1e-9 else 0
    rules, seen = [], set()
    for path in sorted(paths, key=lambda p: (len(p), p)):
        held = Rule(path).holds(x)
        mark = held.tobytes()
        if 0 < held.sum() < len(y) and mark not in seen:
            seen |= {mark, (~held).tobytes()}
            rules.append((Rule(path), held))
    if not rules:
        return RuleModel(float(z.mean()), ())
    design = np.stack([h for _, h in rules], axis=1).astype(np.float64)
    scale = np.maximum(design.std(0), 0.05)
    weights, intercept = lasso(design / scale, y)
    kept = [Rule(r.conditions, float(w)) for (r, _), w in zip(rules, weights / scale, strict=True) if abs(w) > 1e-6]
    return RuleModel(float(intercept), tuple(kept))


def lasso(a: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """L1-penalised logistic regression by accelerated proximal gradient; the intercept is free."""
    a = np.c_[a, np.ones(len(a))]
    vector = np.ones(a.shape[1])
    for _ in range(20):
        vector = a.T @ (a @ vector)
        vector /= np.linalg.norm(vector)
    step = 4 * len(y) / float(np.linalg.norm(a.T @ (a @ vector)))
    w = np.zeros(a.shape[1])
    w[-1] = np.log(y.mean() / (1 - y.mean()))
    ahead, t = w.copy(), 1.0
    for _ in range(STEPS):
        g = a.T @ (1 / (1 + np.exp(-(a @ ahead))) - y) / len(y)
        new = ahead - step * g
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * PENALTY, 0)
        grown = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / grown * (new - w), new, grown
    return w[:-1], float(w[-1])


def remainder(key: str, divisor: int) -> Column:
    """crc32 of the key as text, modulo ``divisor``."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % divisor


def train(df: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", text: str = "text", rows: int = SAMPLE_ROWS) -> RuleModel:
    """Fits on at most ``rows`` labelled documents whose crc32(key) mod 4 is not 2."""
    usable = labels.select(F.col(key).cast("long").alias(key), F.col(label).cast("double").alias("label")).where((remainder(key, 4) != 2) & F.col("label").isNotNull())
    chosen = usable.orderBy(F.xxhash64(key), key, "label").limit(rows).collect()
    if not chosen:
        return fit(np.zeros((0, len(STATS))), np.zeros(0))
    ids = df.sparkSession.createDataFrame([(r[key], r["label"]) for r in chosen], f"{key} long, label double")
    pairs = keyed_text(df, key, text).join(F.broadcast(ids.select(key).distinct()), key, "left_semi")  # bounded by ``rows``
    one = with_stats(pairs, key).groupBy(key).agg(F.min(F.struct(*STATS)).alias("s"))  # of rows that share an id one counts
    stats = one.join(F.broadcast(ids), key).select("label", "s.*")
    table = np.array(sorted(list(r) for r in stats.collect()), dtype=np.float64).reshape(-1, 1 + len(STATS))
    return fit(table[:, 1:], (table[:, 0] >= 0.5).astype(np.float64))


def score(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", model: RuleModel | None = None) -> DataFrame:
    """One row for each row of ``df``: key, held_out (crc32(key) mod 4 is 2), score, predicted.

    Only the text enters the score. A null or empty text has the statistics of an empty one and is
    scored too; a null key stays null and is not held out; repeated rows give repeated rows; without
    usable labels every score is that of the prior. Rows of ``labels`` with a null label are left
    out. No shuffle of texts; two passes over ``df``, the first for the sampled rows alone.
    """
    model = model or train(df, labels, key, text=text)
    scored = with_stats(df, key, text).withColumn("score", model.column())
    return scored.select(key, F.coalesce(remainder(key, 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= KEEP).cast("int").alias("predicted"))


def keep_good(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", model: RuleModel | None = None) -> DataFrame:
    """The rows of ``df``, all columns, whose score is at least KEEP."""
    model = model or train(df, labels, key, text=text)
    return beside_stats(df, text).where(model.column(f"{HELD}.") >= KEEP).drop(HELD)
