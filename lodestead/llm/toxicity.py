"""Toxicity by a subsequence string kernel machine on Nystroem landmarks.

The kernel of two strings sums, over every sequence of four characters that both
contain with or without gaps, the decay raised to the two spans; it is
normalised by the strings' own kernels, so a stretched insult ("i-d-i-o-t",
"idxiot") stays close to the insult. Landmarks span a small feature space
(Nystroem), in which a linear support vector machine is trained. Its decision
is linear in the kernel values of the landmarks, so it folds into one table over
four-character sequences, and a unit of text is scored by summing that table
over the unit's sequences.

A document is a bag of units: words, and runs of single characters that spell a
word. Labels belong to documents, not to sentences, so a sentence counts through
its words. In a toxic document at least one unit is to blame. Training picks
blamed units by how their documents are labelled, fits, picks anew where none
was found, and learns the clean units that the machine took for insults. The
worst different units of a text are judged together by a logistic scale.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORDER = 4
DECAY = 0.6
#: Longest unit, with its two end marks; longer ones are scored in windows of this width.
WIDTH = 16
#: Letters: a-z, then other letters folded into the rest; 0 is a gap, 1 an end mark.
LETTERS = 48
THRESHOLD = 0.7
#: Labelled documents of each class that train at most: the least hashes of their ids.
SAMPLE_PER_CLASS = 2000
LANDMARKS = 320
#: Blamed and blameless units that are candidates for landmarks and training at most.
CANDIDATES, OTHERS = 3000, 3000
#: Blamed units that are also learned in disguise, and what makes blame sure, in nats.
DISGUISED, SURE, LIKELY = 40, 5.0, 4.0
#: Probability in the sample from which a text is called toxic: there its score is ``THRESHOLD``.
CALLED = 0.6
#: Log of how many times likelier a blamed unit is in toxic documents, at least.
ENRICHED = 2.0
#: Rounds of picking anew; how many clean units, seen how often at least, are learned in each because the machine takes them for insults.
MININGS, HARD, HARD_SEEN, MINED = 1, 100, 3, -0.5
#: Different units of a text that are judged together, and the decision at which one of them says nothing.
TOP, WEAK = 3, -0.5
_SPELLED = re.compile(r"(?<!\S)\S(?:[ \t]\S){3,}(?!\S)")
_LEET = str.maketrans("01345$@!", "oieassai")


def codes_of(units: list[str], width: int = WIDTH) -> np.ndarray:
    """Letter codes of units, padded with gaps: end mark, letters, end mark."""
    out = np.zeros((len(units), width), dtype=np.int32)
    points = np.array([u.ljust(width - 2, " ")[: width - 2] for u in units], dtype=f"<U{width - 2}")
    if not len(units):
        return out
    points = points.view(np.uint32).reshape(len(units), width - 2).astype(np.int64)
    small = np.where((points >= 97) & (points <= 122), points - 95, 0)
    other = (points >= 0xDF) & (points != 0xF7)
    small = np.where(other, 28 + (points * 7) % (LETTERS - 28), small)
    length = np.array([min(len(u), width - 2) for u in units])
    out[:, 0] = 1
    out[:, 1:-1] = small
    out[np.arange(len(units)), length + 1] = 1
    return out


def _plan(width: int) -> tuple[np.ndarray, np.ndarray]:
    places = np.array(list(combinations(range(width), ORDER)), dtype=np.int64).reshape(-1, ORDER)
    return places, DECAY ** (places[:, -1] - places[:, 0] + 1).astype(np.float64)


def _sequences(codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each choice of places: the sequence's code in every unit, whether all four are letters, and its weight."""
    for p, weight in zip(*_plan(codes.shape[1]), strict=True):
        a = codes[:, p]
        ok = (a > 0).all(axis=1)
        yield ((a[:, 0] * LETTERS + a[:, 1]) * LETTERS + a[:, 2]) * LETTERS + a[:, 3], ok, weight


def sparse_rows(codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each unit as (sorted sequence codes, weights), scaled to length one."""
    places, weight = _plan(codes.shape[1])
    out = []
    for row in codes:
        a = row[places]
        ok = (a > 0).all(axis=1)
        key = ((a[ok, 0] * LETTERS + a[ok, 1]) * LETTERS + a[ok, 2]) * LETTERS + a[ok, 3]
        k, inverse = np.unique(key, return_inverse=True)
        w = np.bincount(inverse, weight[ok], minlength=len(k))
        norm = np.sqrt((w**2).sum())
        out.append((k, w / norm if norm else w))
    return out


def self_kernel(codes: np.ndarray) -> np.ndarray:
    """The kernel of each unit with itself, by dynamic programming over prefixes."""
    n, width = codes.shape
    letter = codes > 0
    steps = np.arange(width)
    after = np.where(steps[None, :] > steps[:, None], DECAY ** (steps[None, :] - steps[:, None]), 0.0)
    same = (codes[:, :, None] == codes[:, None, :]) & letter[:, :, None] & letter[:, None, :]
    level = same * DECAY**2
    for _ in range(ORDER - 1):
        # a step from one place to a later one lengthens the span by their distance
        level = same * (after.T @ level @ after)
    return level.sum(axis=(1, 2))


@dataclass
class Model:
    """``table``: weight of each sequence; ``bias``; ``joint``: logistic scale of the worst units, its shift last; ``landmarks`` and their weights."""

    table: np.ndarray
    bias: float
    joint: tuple[float, ...]
    landmarks: tuple[tuple[str, float], ...] = ()

    def decide(self, units: list[str]) -> np.ndarray:
        """Decision of each unit: its kernel values with the landmarks, weighted, less the bias."""
        out = np.full(len(units), -self.bias)
        length = np.array([min(len(u) + 2, WIDTH) for u in units])
        for width in np.unique(length):
            if width < ORDER:
                continue
            at = np.flatnonzero(length == width)
            for i in range(0, len(at), 8_000):
                part = at[i:i + 8_000]
                codes = codes_of([units[k] for k in part], int(width))
                raw = np.zeros(len(part))
                for key, ok, weight in _sequences(codes):
                    raw += self.table[key] * (ok * weight)
                some = np.flatnonzero(raw)
                if len(some):
                    out[part[some]] += raw[some] / np.sqrt(np.maximum(self_kernel(codes[some]), 1e-300))
        return out

    def worst(self, text_no: np.ndarray, unit_no: np.ndarray, decided: np.ndarray, n: int) -> np.ndarray:
        """The decisions of the ``TOP`` worst different units of each of ``n`` texts; a text without units has none but the bias."""
        out = np.full((n, TOP), WEAK)
        first = np.full(n, -np.inf)
        np.maximum.at(first, text_no, decided[unit_no])
        some = decided[unit_no] > WEAK
        pair = np.unique(text_no[some] * len(decided) + unit_no[some])
        text, value = pair // max(1, len(decided)), decided[pair % max(1, len(decided))]
        order = np.lexsort((-value, text))
        text, value = text[order], value[order]
        place = np.arange(len(text)) - np.searchsorted(text, text)
        few = place < TOP
        out[text[few], place[few]] = value[few]
        out[:, 0] = np.where(np.isfinite(first), first, -self.bias)
        return out

    def score(self, worst: np.ndarray) -> np.ndarray:
        """0 to 1 by the worst units together; ``THRESHOLD`` where a text like those of the sample is toxic with probability ``CALLED``."""
        together = worst @ np.array(self.joint[:-1]) + self.joint[-1]
        return 1.0 / (1.0 + np.exp(-np.clip(together, -700, 700)))


def _constant(logit: float) -> Model:
    """A model that scores every text alike."""
    return Model(np.zeros(LETTERS**ORDER), 0.0, (0.0,) * TOP + (logit,))


def _edge_strip(units: pa.Array) -> pa.Array:
    return pc.utf8_trim(units, characters=".,;:!?\"'()[]{}<>|*#&%^~_=+/\\`“”‘’«»…-")


def unit_lists(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(text number, unit number) of every unit of every text, and the distinct units.

    A unit is a lower-case word without marks at its ends and with look-alike
    digits read as letters, in windows if long; or a run of four or more
    single characters.
    """
    texts = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    lists = pc.utf8_split_whitespace(texts)
    flat = pc.dictionary_encode(lists.flatten())
    of = np.repeat(np.arange(len(texts)), np.diff(np.asarray(lists.offsets)))
    codes = np.asarray(flat.indices)
    names: dict[str, int] = {}
    words = _edge_strip(flat.dictionary).to_pylist()
    parts: list[list[int]] = []
    for w in words:
        w = w.translate(_LEET)
        span = WIDTH - 2
        cut = [w] if len(w) <= span else [w[i:i + span] for i in range(0, len(w) - span // 2, span // 2)]
        parts.append([names.setdefault(c, len(names)) for c in cut if len(c) >= 2])
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else sizes
    pieces = np.array([x for p in parts for x in p], dtype=np.int64)
    n = sizes[codes] if len(codes) else np.zeros(0, np.int64)
    text_no = np.repeat(of, n)
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    unit_no = pieces[np.repeat(starts[codes], n) + inner] if len(pieces) else np.zeros(0, np.int64)
    extra_text, extra_unit = [], []
    for i in np.flatnonzero(np.asarray(pc.match_substring_regex(texts, r"(?:^|\s)\S[ \t]\S[ \t]\S[ \t]\S(?:\s|$)"))):
        for m in _SPELLED.finditer(texts[int(i)].as_py()):
            run = m.group().replace(" ", "").replace("\t", "").translate(_LEET)
            for k in range(0, max(1, len(run) - 6), 6):
                extra_text.append(i)
                extra_unit.append(names.setdefault(run[k:k + WIDTH - 2], len(names)))
    return (np.concatenate([text_no, np.array(extra_text, dtype=np.int64)]),
            np.concatenate([unit_no, np.array(extra_unit, dtype=np.int64)]), list(names))


def _kernel(rows: list, marks: list) -> np.ndarray:
    """Kernel values of each row with each landmark; no row is empty."""
    keys, weights = np.concatenate([k for k, _ in rows]), np.concatenate([w for _, w in rows])
    starts = np.concatenate([[0], np.cumsum([len(k) for k, _ in rows])[:-1]])
    table = np.zeros(LETTERS**ORDER)
    out = np.zeros((len(rows), len(marks)))
    for j, (k, w) in enumerate(marks):
        table[k] = w
        out[:, j] = np.add.reduceat(table[keys] * weights, starts)
        table[k] = 0
    return out


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 30.0, steps: int = 400) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by Newton steps on the active rows."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-3
    for _ in range(steps):
        active = y * (x1 @ w) < 1
        xa, ya, wa = x1[active], y[active], weight[active] * c
        new = np.linalg.solve(ridge + (xa * wa[:, None]).T @ xa, (xa * wa[:, None]).T @ ya)
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w[:-1], -w[-1]


def _divergence(p: float, q: float) -> float:
    """Bernoulli divergence of a share ``p`` from the rate ``q``."""
    return (p * np.log(p / q) if p else 0.0) + ((1 - p) * np.log((1 - p) / (1 - q)) if p < 1 else 0.0)


def disguises(unit: str) -> list[str]:
    """The unit as it is written to slip through: letters put in, doubled, hidden, or hung on."""
    out = [unit + "s", "x" + unit, "xx" + unit + "xx", unit + "er", "".join(c + "-" for c in unit)[:-1]]
    for i in range(1, len(unit)):
        out += [unit[:i] + c + unit[i:] for c in ("x", "-", unit[i])]
        out.append(unit[:i] + "*" + unit[i + 1:])
    return [u[: WIDTH - 2] for u in out]


def _unlike(bags: list[list[str]], toxic: list[int]) -> list[int]:
    """Documents without near copies of earlier ones of their class, whose words would be blamed as often as the insult.

    Copies share the least hash of their longer units under one of three seeds.
    """
    seen: set[tuple[int, int, int]] = set()
    out = []
    for i, (bag, t) in enumerate(zip(bags, toxic, strict=True)):
        long = [hash_of(u) for u in bag if len(u) >= 6]
        marks = {(t, k, min((h * m) % (1 << 64) for h in long)) for k, m in enumerate((1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))} if long else set()
        if not marks & seen:
            out.append(i)
        seen |= marks
    return out


class _Known:
    """Sparse rows of units and their kernel values, kept from round to round."""

    def __init__(self) -> None:
        self.rows: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self.columns: dict[str, dict[str, float]] = {}

    def kernel(self, units: list[str], marks: list[str]) -> np.ndarray:
        out = np.zeros((len(units), len(marks)))
        for j, m in enumerate(marks):
            have = self.columns.setdefault(m, {})
            missing = [u for u in units if u not in have]
            if missing:
                have.update(zip(missing, _kernel([self.rows[u] for u in missing], [self.rows[m]])[:, 0].tolist(), strict=True))
            out[:, j] = [have[u] for u in units]
        return out


def _fit_units(pos: list[str], neg: list[str], hidden: list[str], blamed: dict[str, int], seen: dict[str, int], marks_of: list[str], rounds: int,
               known: _Known) -> Model:
    """The machine for these units on these landmarks, folded into a table; units weigh by the log of their documents."""
    units = pos + neg + hidden
    new_units = [u for u in units if u not in known.rows]
    known.rows.update(zip(new_units, sparse_rows(codes_of(new_units)), strict=True))
    k = known.kernel(units, marks_of)
    index = {u: i for i, u in enumerate(units)}
    own = k[[index[u] for u in marks_of]]
    value, vector = np.linalg.eigh((own + own.T) / 2)
    keep = value > 1e-6
    root = vector[:, keep] / np.sqrt(value[keep])
    x = k @ root
    y = np.array([1.0] * len(pos) + [-1.0] * len(neg) + [1.0] * len(hidden))
    size = np.array([1.0 + np.log(blamed[u]) for u in pos] + [1.0 + np.log(max(1, seen[u])) for u in neg] + [0.5] * len(hidden))
    for _ in range(rounds):
        w, bias = _svm(x, y, size)
        # a blamed unit that the machine itself takes for clean was blamed by chance
        keep_rows = (y < 0) | (x @ w - bias >= -0.25)
        if keep_rows.all() or not (y[keep_rows] > 0).any():
            break
        x, y, size = x[keep_rows], y[keep_rows], size[keep_rows]
    table = np.zeros(LETTERS**ORDER)
    alpha = root @ w
    for a, (key, value_) in zip(alpha, (known.rows[u] for u in marks_of), strict=True):
        table[key] += a * value_
    return Model(table, float(bias), (1.0,) * TOP + (0.0,), tuple(zip(marks_of, alpha.tolist(), strict=True)))


def train(bags: list[list[str]], toxic: list[int], landmarks: int = LANDMARKS, rounds: int = 4) -> Model:
    """A model from bags of distinct units and their labels; deterministic."""
    fresh = _unlike(bags, toxic)
    bags, toxic = [bags[i] for i in fresh], [toxic[i] for i in fresh]
    positive, negative = sum(toxic), len(toxic) - sum(toxic)
    if not positive or not negative:
        rate = (positive + 0.5) / (len(toxic) + 1)
        return _constant(float(np.log(rate / (1 - rate))))
    df: dict[str, list[int]] = {}
    for bag, t in zip(bags, toxic, strict=True):
        for u in bag:
            df.setdefault(u, [0, 0])[t] += 1
    odds = {u: np.log((b + 0.25) / (positive + 0.5)) - np.log((a + 0.25) / (negative + 0.5)) for u, (a, b) in df.items()}
    blamed = [max(((odds[u], u) for u in bag if len(u) >= 3), default=(0.0, "")) for bag, t in zip(bags, toxic, strict=True) if t]
    rate = positive / (positive + negative)

    def likely(u: str, least: float) -> bool:
        a, b = df[u]
        return odds[u] > ENRICHED and b / (a + b) > rate and (a + b) * _divergence(b / (a + b), rate) > least

    blamed += [(odds[u], u) for u in df if len(u) >= 3 and likely(u, SURE)]
    weight: dict[str, int] = {}
    for _, u in blamed:
        if u and likely(u, LIKELY):
            weight[u] = weight.get(u, 0) + 1
    pos = sorted(weight, key=lambda u: (-weight[u], u))[:CANDIDATES]
    clean = sorted((u for u, (a, b) in df.items() if a and len(u) >= 3), key=lambda u: (hash_of(u), u))
    common = sorted((u for u, (a, b) in df.items() if a), key=lambda u: (-df[u][0], u))[: OTHERS // 3]
    neg = list(dict.fromkeys(common + clean))[:OTHERS]
    neg = [u for u in neg if u not in weight]
    if not pos or not neg:
        return train([], [], landmarks) if not bags else _constant(float(np.log((positive + .5) / (negative + .5))))
    hidden = sorted({d for u in pos[:DISGUISED] if len(u) >= 4 for d in disguises(u) if d not in df}, key=lambda u: (hash_of(u), u))
    marks_of = pos[: landmarks // 2] + hidden[: landmarks * 3 // 10]
    marks_of += [u for u in neg if len(u) >= 4][: landmarks - len(marks_of)]
    every = list(df)
    number = {u: i for i, u in enumerate(every)}
    known = _Known()
    for mining in range(MININGS + 1):
        model = _fit_units(pos, neg, hidden, weight, {u: df[u][0] for u in neg}, marks_of, rounds, known)
        decided = model.decide(every)
        if mining == MININGS:
            break
        # clean units that the machine takes for insults are learned, and get landmarks of their own
        taken = set(pos) | set(neg)
        wrong = [u for u in every if u not in taken and decided[number[u]] > MINED and df[u][0] >= HARD_SEEN and df[u][1] <= rate * sum(df[u])]
        wrong = sorted(wrong, key=lambda u: (-decided[number[u]], u))[:HARD]
        close = sorted((u for u in neg if decided[number[u]] > MINED and df[u][0] >= HARD_SEEN), key=lambda u: (-decided[number[u]], u))[:HARD]
        # toxic documents without a blamed unit blame the one that decides highest
        fresh_pos = []
        for bag, t in zip(bags, toxic, strict=True):
            if t and not any(u in weight for u in bag):
                best = max(((decided[number[u]], u) for u in bag if u not in taken and len(u) >= 3 and df[u][1] > rate * sum(df[u])), default=(0.0, ""))
                if best[0] > 0:
                    fresh_pos.append(best[1])
        for u in fresh_pos:
            weight[u] = weight.get(u, 0) + 1
        fresh_pos = sorted(set(fresh_pos) - taken)
        if not wrong and not close and not fresh_pos:
            break
        pos, neg = pos + fresh_pos, neg + wrong
        marks_of = list(dict.fromkeys(marks_of + close + wrong + fresh_pos))[: landmarks + HARD * (mining + 1)]
    text_no = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    unit_no = np.array([number[u] for bag in bags for u in bag], dtype=np.int64)
    worst, told = model.worst(text_no, unit_no, decided, len(bags)), np.array(toxic, dtype=float)
    # toxic documents in which nothing is found say nothing about the scale of what is
    found = (told == 0) | (worst[:, 0] > WEAK)
    *scale, shift = _platt(worst[found], told[found])
    model.joint = (*scale, float(shift + np.log(THRESHOLD / (1 - THRESHOLD)) - np.log(CALLED / (1 - CALLED))))
    return model


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Logistic scale of decisions (columns of ``z``), by Newton steps on smoothed targets; no weight is negative."""
    p, n = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (p + 1) / (p + 2), 1 / (n + 2))
    x = np.hstack([z, np.ones((len(z), 1))])
    ridge = np.array([1e-3] * z.shape[1] + [0.0])
    w = np.array([1.0] * z.shape[1] + [0.0])
    for _ in range(200):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (q * (1 - q) + 1e-6)[:, None]).T @ x + 1e-3 * np.eye(len(w)), x.T @ (q - t) + ridge * w)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return (*(float(max(v, 0.0)) for v in w[:-1]), float(w[-1]))


def hash_of(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace"))


def held_out(id_col: str):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", sample: int = SAMPLE_PER_CLASS, landmarks: int = LANDMARKS) -> Model:
    """Train on a bounded sample: at most ``sample`` labelled, not held-out documents of each class.

    Null labels teach nothing; of several labels of a document the highest counts.
    """
    told = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col)).groupBy(
        F.col(id_col).cast("long").alias("_id")).agg((F.max(label_col) > 0).cast("int").alias("_toxic"))
    order = F.xxhash64("_id")
    some = told.filter("_toxic = 1").orderBy(order, "_id").limit(sample).union(
        told.filter("_toxic = 0").orderBy(order, "_id").limit(sample))
    ids = some.orderBy("_id").collect()
    spark = docs.sparkSession
    if not ids:
        return _constant(0.0)
    few = spark.createDataFrame([(r[0], r[1]) for r in ids], "_id long, _toxic int")

    def bags(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            text_no, unit_no, names = unit_lists(b.column(1))
            out: list[list[str]] = [[] for _ in range(len(b))]
            for t, u in np.unique(np.stack([text_no, unit_no], axis=1), axis=0) if len(text_no) else ():
                out[t].append(names[u])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([sorted(x) for x in out], pa.list_(pa.string()))], ["id", "toxic", "units"])

    # at most twice ``sample`` ids: this side is small by construction
    rows = (docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("t"))
            .join(F.broadcast(few), "_id").select("_id", "t", "_toxic")
            .mapInArrow(bags, "id long, toxic int, units array<string>").toPandas())
    rows["key"] = rows["units"].map(lambda u: hash_of("\n".join(u)))
    rows = rows.sort_values(["id", "key"]).drop_duplicates(["id", "key"])
    return train([list(u) for u in rows["units"]], [int(t) for t in rows["toxic"]], landmarks)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` of each row, without a shuffle.

    A text scores by its ``TOP`` worst different units together; null and empty texts score as no unit at all; rows without an id aren't held out; repeated rows score alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        known: dict[str, float] = {}
        for b in it:
            s = np.zeros(len(b))
            size = np.asarray(pc.fill_null(pc.binary_length(b.column(1)), 0)).astype(np.int64)
            part = np.cumsum(size) // (1 << 23)
            for p in np.unique(part):
                at = np.flatnonzero(part == p)
                text_no, unit_no, names = unit_lists(b.column(1).slice(int(at[0]), len(at)))
                new = [u for u in names if u not in known]
                if len(known) > 400_000:
                    known.clear()
                    new = names
                known.update(zip(new, m.decide(new).tolist(), strict=True))
                values = np.array([known[u] for u in names], dtype=np.float64)
                s[at] = m.score(m.worst(text_no, unit_no, values, len(at)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                                             ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t"), held_out(id_col).alias("held_out"))
    return rows.mapInArrow(batches, "doc_id long, held_out boolean, score double, predicted int")
