"""Quality by weak labels: overlapping heuristics, their accuracies by expectation-maximisation, a hashed linear scorer.

Each heuristic votes good, bad or nothing on a text. How often each is right is
estimated over the whole corpus from how the votes agree (the votes are few, so
the corpus is summed up by its vote patterns). The posterior labels of a bounded
sample train a logistic scorer on hashed word shapes, which scores every text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 12
#: Documents of each posterior class that train the scorer at most: the least hashes of id and text size.
SAMPLE_PER_CLASS = 2000
THRESHOLD = 0.5
#: Heuristics are written to spare good texts: a labeller is taken to condemn at most this share of those it votes on (1: no bound).
FALSE_ALARM = 0.01

# Frequent function words of the languages looked for.
FUNCTION_WORDS = frozenset(
    "the of and to in is it that was for on are as with be at by this from or an not "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als "
    "de la le et les des en un du une que est pour qui dans par sur pas plus au "
    "el los las y del se por con una para su al lo como más".split())
# End of fixed values.

_SYMBOL = re.compile(r"[#$%&*|<>{}\[\]=~^_\\@+]")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_LOWER = re.compile(r"[a-zß-öø-ÿ]")
_DECORATED = re.compile(r"[^\w\s]{2,}(?=\s|$)")
_RUN_LOWER = re.compile(r"[^\W\d_A-ZÀ-ÖØ-Þ]+")
_RUN_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]+")
_RUN_DIGIT = re.compile(r"\d+")

LABELLERS = ("symbols", "upper", "repeats", "variety", "lines", "sentences", "function", "decorated", "bare", "length", "size")


def _vote(bad: bool, good: bool) -> int:
    return -1 if bad else int(good)


def votes(text: str | None) -> tuple[int, ...]:
    """-1 (bad), 0 (none) or 1 (good) of each labeller. An empty text has one vote, against it."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return (0,) * (len(LABELLERS) - 1) + (-1,)
    chars = max(1, len(text))
    symbols = len(_SYMBOL.findall(text)) / chars
    upper = len(_UPPER.findall(text))
    letters = max(1, upper + len(_LOWER.findall(text)))
    again = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
    variety = len(set(words)) / n
    lines = [x for x in text.split("\n") if x]
    same = 1 - len(set(lines)) / max(1, len(lines))
    ends = len(re.findall(r"[.!?](?=\s|$)", text)) / n
    function = sum(w.strip(".,;:!?").lower() in FUNCTION_WORDS for w in words) / n
    decorated = len(_DECORATED.findall(text)) / n
    bare = sum(not any(map(str.isalnum, w)) for w in words if len(w) <= 3) / n
    mean = sum(map(len, words)) / n
    long = n >= 30
    return (
        _vote(symbols > 0.04, symbols < 0.01),
        _vote(upper / letters > 0.5 and letters > 20, upper / letters < 0.2),
        _vote(again > 0.15 and long, again < 0.03),
        _vote(variety < 0.12 and long, variety > 0.35),
        _vote(same > 0.4 and len(lines) >= 4, same < 0.1 and len(lines) >= 3),
        _vote((ends < 0.004 or ends > 0.6) and long, 0.02 < ends < 0.3),
        _vote(function < 0.01 and long, function > 0.12),
        _vote(decorated > 0.3 and n >= 10, decorated < 0.05),
        _vote(bare > 0.08 and n >= 10, bare < 0.02),
        _vote(mean > 16 or mean < 1.8, 3 <= mean <= 10),
        int(n >= 50),
    )


@dataclass
class LabelModel:
    """``prior`` of good; ``chance[class, labeller, vote + 1]`` among votes cast; posterior by vote pattern."""

    prior: float
    chance: np.ndarray
    posterior: dict[str, float]


def estimate(counts: dict[str, int], rounds: int = 200, false_alarm: float = FALSE_ALARM) -> LabelModel:
    """Expectation-maximisation over vote patterns ("+", "-", "." for each labeller) and their numbers.

    Starts from the balance of votes; a pattern without votes keeps the prior.
    ``false_alarm`` bounds how often a labeller may be wrong on good texts: without
    it, a kind of bad text that only one labeller knows can be taken for good.
    """
    patterns = sorted(counts)
    k = len(LABELLERS)
    if not patterns:
        return LabelModel(0.5, np.ones((2, k, 3)), {})
    v = np.array([["-.+".index(c) for c in p] for p in patterns])
    n = np.array([counts[p] for p in patterns], dtype=float)
    onehot = np.eye(3)[v]
    balance = (v == 2).sum(1) - 2.5 * (v == 0).sum(1)
    q = 1 / (1 + np.exp(-np.clip(balance, -20, 20)))
    chance = np.ones((2, k, 3))
    prior = 0.5
    for _ in range(rounds):
        w = np.stack([n * (1 - q), n * q])
        prior = float((w[1].sum() + 1) / (n.sum() + 2))
        # a labeller that says nothing tells nothing: only votes cast are modelled
        chance = np.einsum("cp,pkv->ckv", w, onehot) * [1, 0, 1] + 0.5
        chance /= chance[:, :, [0]] + chance[:, :, [2]]
        chance[1, :, 0] = np.minimum(chance[1, :, 0], false_alarm)
        chance[1, :, 2] = 1 - chance[1, :, 0]
        chance[:, :, 1] = 1.0
        logit = np.log(prior / (1 - prior)) + np.einsum("pkv,kv->p", onehot, np.log(chance[1] / chance[0]))
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        done = np.abs(new - q).max() < 1e-10
        q = new
        if done:
            break
    return LabelModel(prior, chance, dict(zip(patterns, q.tolist(), strict=True)))


@lru_cache(maxsize=1 << 17)
def _slot(feature: str) -> int:
    return xxhash.xxh3_64_intdigest(feature.encode("utf-8", "replace")) % (1 << BITS)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of the hashed shapes of words and of neighbours, and of how varied the words are."""
    text = text or ""
    words = text.split()
    if not words:
        return np.array([_slot("empty")]), np.array([1.0])
    shape = _RUN_DIGIT.sub("0", _RUN_UPPER.sub("A", _RUN_LOWER.sub("a", text))).split()
    if len(shape) != len(words):
        shape = ["?"] * len(words)
    n = len(words)
    one = Counter(shape)
    two = Counter(zip(shape, shape[1:], strict=False))
    again = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
    slots: dict[int, float] = {}
    for s, c in one.items():
        k = _slot("1" + s)
        slots[k] = slots.get(k, 0.0) + c / n
    for (a, b), c in two.items():
        k = _slot(f"2{a} {b}")
        slots[k] = slots.get(k, 0.0) + c / n
    k = _slot("again")
    slots[k] = slots.get(k, 0.0) + again
    at = np.fromiter(slots, dtype=np.int64, count=len(slots))
    return at, np.sqrt(np.fromiter(slots.values(), dtype=np.float64, count=len(slots)))


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        at, x = features(text)
        return float(1 / (1 + np.exp(-np.clip(self.weights[at] @ x + self.bias, -30, 30))))


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, steps: int = 400, ridge: float = 1e-4) -> Scorer:
    """Logistic regression on soft labels by accelerated gradient steps; both classes weigh alike."""
    size = 1 << BITS
    x = np.zeros((len(rows), size + 1), dtype=np.float32)
    for i, (at, v) in enumerate(rows):
        x[i, at] = v
    x[:, -1] = 1
    good = target.sum()
    if not len(rows) or good < 1 or good > len(target) - 1:
        rate = (good + 1) / (len(target) + 2)
        return Scorer(np.zeros(size), float(np.log(rate / (1 - rate))))
    weight = np.where(target >= 0.5, 0.5 / max(1, (target >= 0.5).sum()), 0.5 / max(1, (target < 0.5).sum()))
    w = np.zeros(size + 1, dtype=np.float32)
    ahead = w.copy()
    rate = 4.0 / float((x**2).sum(1).max())
    for i in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead, -30, 30)))
        new = ahead - np.float32(rate) * (x.T @ (weight * (p - target)).astype(np.float32) + np.float32(ridge) * ahead)
        ahead = new + np.float32(i / (i + 3)) * (new - w)
        w = new
    return Scorer(w[:-1].astype(np.float64), float(w[-1]))


def _patterns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            p = ["".join("-.+"[v + 1] for v in votes(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(p)], ["id", "draw", "pattern"])

    draw = F.xxhash64(F.col(id_col), F.col(text_col))
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"), draw.alias("draw")).mapInArrow(
        batches, "id long, draw long, pattern string")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE_PER_CLASS) -> tuple[LabelModel, Scorer]:
    """Labeller accuracies from all documents, and a scorer from at most twice ``sample`` of them.

    There are at most three to the number of labellers patterns, whatever the
    corpus; they are all that is collected besides the sample.
    """
    from .common import settle

    seen = settle(_patterns(docs, id_col, text_col))
    counts = {r["pattern"]: r["n"] for r in seen.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()}
    model = estimate(counts)
    bad = [p for p, q in model.posterior.items() if q < 0.5]
    draws = {}
    for good, part in ((1, seen.filter(~F.col("pattern").isin(bad))), (0, seen.filter(F.col("pattern").isin(bad)))):
        for r in part.select("draw", "pattern").orderBy("draw").limit(sample).collect():
            draws.setdefault(r["draw"], r["pattern"])
    spark = docs.sparkSession
    few = spark.createDataFrame([(d, p) for d, p in sorted(draws.items())], "_draw long, _pattern string")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            f = [features(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array([x[0] for x in f], pa.list_(pa.int64())), pa.array([x[1] for x in f], pa.list_(pa.float64()))],
                ["draw", "pattern", "at", "value"])

    draw = F.xxhash64(F.col(id_col), F.col(text_col))
    # at most twice ``sample`` rows: this side is small by construction
    rows = (docs.select(draw.alias("_draw"), F.col(text_col).cast("string").alias("t")).join(F.broadcast(few), "_draw").select("_draw", "t", "_pattern")
            .mapInArrow(batches, "draw long, pattern string, at array<long>, value array<double>").dropDuplicates(["draw"]).collect())
    rows = sorted(rows, key=lambda r: r["draw"])
    target = np.array([model.posterior[r["pattern"]] for r in rows])
    return model, fit_scorer([(np.array(r["at"]), np.array(r["value"])) for r in rows], target)


def score(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``score`` (0 to 1, higher: better) and ``accepted`` of each row, without a shuffle.

    Null and empty texts have the score of no words at all and aren't accepted;
    repeated rows score alike; null ids stay null; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in it:
            texts = b.column(1).to_pylist()
            s = np.array([m.score(t) for t in texts], dtype=np.float64)
            full = np.array([bool(t and t.strip()) for t in texts], dtype=bool)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= threshold) & full)], ["doc_id", "score", "accepted"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(
        batches, "doc_id long, score double, accepted boolean")


def keep_accepted(docs: DataFrame, scorer: Scorer, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` (all columns) whose text is accepted.

    Null and empty texts go; repeated rows stay or go together; texts of any
    length are read whole; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    where = docs.columns.index(text_col)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in it:
            yield b.filter(pa.array([bool(t and t.strip()) and m.score(t) >= threshold for t in b.column(where).to_pylist()], pa.bool_()))

    return docs.mapInArrow(batches, docs.schema)
