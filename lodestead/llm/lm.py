"""Language-model scoring by a weighted backoff automaton over word n-grams.

A history of up to ``order`` - 1 tokens is a state if it was seen ``LEAST_HISTORY``
times in training (one token: once; the start of a text is a history too). From a
state leads an arc for each token seen after its history, and a failure arc to
the state of the history without its first token, at last to the root, where
every token has an arc. The weights are log10 of smoothed probabilities:

    p(w) = (c(w) + 1) / (N + V + 1)
    p(w | h) = (c(h w) + m p(w | h')) / (c(h) + m),   m = c(h) ** HEAPS, h' = h without its first token

so a failure arc weighs log10(m / (c(h) + m)), and the probabilities of each
state sum to one. A text is read once from left to right: a token takes an arc of
the carried state, or follows failure arcs until one is found; the arc leads to
the longest state that ends in it.

Counts come from the whole corpus. Documents are dealt into batches of bounded
text. A batch asks for each distinct n-gram that it needs once, by 64-bit digest,
with its own training count; n-grams of three tokens or more only where their
history is a state, so in a round of their own. The questions of a batch to one
share of the digests are one row (rows of single n-grams would take twice the
room). Shares add up and answer. So a word in every document costs one entry per
batch, and corpus totals are one row that is joined to the answers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, small

ORDER = 3
HEAPS = 0.95
LEAST_HISTORY = 2
#: Characters of text in a batch, and the least number of batches.
BATCH_CHARS = 1 << 23
LEAST_BATCHES = 96
#: Tokens of a text that are read in one go; the next segment begins in the state that the tokens before it lead to.
SEGMENT = 512
_END = np.uint64(xxhash.xxh3_64_intdigest(b""))
_START = np.uint64(xxhash.xxh3_64_intdigest(b" start"))
_MIX = np.uint64(0xD6E8FEB86659FD93)


def digests(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token digests of all texts one after the other, each closed by the end, and where each text begins (n + 1).

    A-Z are lower-cased; a null text is the end alone. A word is 64 bits, so two
    among a billion share a digest with a chance of some hundredths.
    """
    low = pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    lists = pc.split_pattern_regex(low, r"[\x20\x09-\x0D]+")
    flat = pc.dictionary_encode(lists.flatten())
    words = flat.dictionary.to_pylist()
    keys = np.array([xxhash.xxh3_64_intdigest(w.encode("utf-8", "replace")) for w in words], dtype=np.uint64)
    full = np.array([bool(w) for w in words], dtype=bool)
    codes = np.asarray(flat.indices)
    of = np.repeat(np.arange(len(texts)), np.diff(np.asarray(lists.offsets)))
    if len(codes):
        keep = full[codes]
        codes, of = codes[keep], of[keep]
    size = np.bincount(of, minlength=len(texts))
    begin = np.concatenate([[0], np.cumsum(size + 1)])
    out = np.full(int(begin[-1]), _END, dtype=np.uint64)
    out[np.arange(len(of)) + of] = keys[codes] if len(codes) else keys[:0]
    return out, begin


@dataclass
class Level:
    """N-grams of one length: the positions they end at, the distinct digests, which one each position has."""

    at: np.ndarray
    distinct: np.ndarray
    which: np.ndarray


def levels(tokens: np.ndarray, begin: np.ndarray, known: list[np.ndarray], upto: int) -> Iterator[Level]:
    """The n-grams that matter, by length up to ``upto``; ``known`` has the counts of the shorter ones' distinct digests.

    All tokens and pairs matter (the first token's pair is with the start); a
    longer one does where its history was seen ``LEAST_HISTORY`` times.
    """
    first = np.zeros(len(tokens), dtype=bool)
    first[begin[:-1]] = True
    gram, seen = tokens, np.zeros(len(tokens), dtype=np.int64)
    for n in range(1, upto + 1):
        if n == 1:
            at = np.arange(len(tokens))
        else:
            history = np.concatenate([[_START], gram[:-1]])
            if n == 2:
                history[first], at = _START, np.arange(len(tokens))
            else:
                before = np.concatenate([[0], seen[:-1]])
                at = np.flatnonzero(~first & (before >= LEAST_HISTORY))
            mixed = (history ^ (history >> np.uint64(31))) * _MIX + tokens + np.uint64(n)
            gram = (mixed ^ (mixed >> np.uint64(32))) * _MIX
        distinct, which = np.unique(gram[at], return_inverse=True)
        yield Level(at, distinct, which)
        seen = np.zeros(len(tokens), dtype=np.int64)
        if n < upto and n >= 2:
            seen[at] = known[n - 1][which]


class Automaton:
    """States and arcs that the texts of a batch can reach.

    State 0 is the root. ``keys`` (state, word) are the sorted arcs of the other
    states; at the root, word ``w`` has the arc ``root[w]``.
    """

    def __init__(self, tokens: np.ndarray, begin: np.ndarray, parts: list[Level], counts: list[np.ndarray], n_all: int, n_distinct: int, heaps: float):
        word = self.word = parts[0].which
        n_words, order = len(parts[0].distinct), len(parts)
        first = np.zeros(len(tokens), dtype=bool)
        first[begin[:-1]] = True
        p = (counts[0] + 1.0) / (n_all + n_distinct + 1.0)
        self.n_words, self.root = n_words, np.log10(p)
        self.root_next = np.where(counts[0] > 0, 1 + np.arange(n_words), 0)
        self.start = 1 + n_words
        # a text is left as often as it is begun, so the start was seen as often as the end
        size = np.concatenate([[0], counts[0], [counts[0][word[-1]] if len(word) else 0]]).astype(np.float64)
        failure = [np.zeros(self.start + 1, dtype=np.int64)]
        state = self.root_next[word]
        deepest = state
        keys, nexts, weights = [], [], []
        for n in range(2, order + 1):
            part, count = parts[n - 1], counts[n - 1]
            rep = np.zeros(len(part.distinct), dtype=np.int64)
            rep[part.which] = part.at
            source = np.where(first[rep], self.start, state[rep - 1])
            mass = np.maximum(size[source], 1.0) ** heaps
            lower = p[parts[n - 2].which[rep]] if n == 2 else p[_which(parts[n - 2], rep)]
            p = (count + mass * lower) / (size[source] + mass)
            own = np.zeros(len(tokens), dtype=np.int64)
            if n < order:
                kept = np.flatnonzero(count >= LEAST_HISTORY)
                number = np.zeros(len(count), dtype=np.int64)
                number[kept] = len(size) + np.arange(len(kept))
                failure.append(state[rep[kept]])
                size = np.concatenate([size, count[kept]])
                own[part.at] = number[part.which]
            deepest = np.where(own > 0, own, deepest)
            arcs = np.flatnonzero(count > 0)
            keys.append(source[arcs] * n_words + word[rep[arcs]])
            nexts.append(deepest[rep[arcs]])
            weights.append(np.log10(p[arcs]))
            state = own
        every = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        order_of = np.argsort(every, kind="stable")
        self.keys = every[order_of]
        self.next = np.concatenate(nexts)[order_of] if keys else every
        self.weight = np.concatenate(weights)[order_of] if keys else np.zeros(0)
        mass = np.maximum(size, 1.0) ** heaps
        self.failure, self.failure_weight = np.concatenate(failure), np.where(size > 0, np.log10(mass / (size + mass)), 0.0)

    def step(self, states: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each state goes on its word, and the weights of the failure arcs and the arc on the way."""
        out, total = np.zeros(len(states), dtype=np.int64), np.zeros(len(states))
        left, at = np.arange(len(states)), states
        while len(left):
            w = words[left]
            key = at * self.n_words + w
            where = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
            found = (at > 0) & (self.keys[where] == key) if len(self.keys) else np.zeros(len(at), dtype=bool)
            root = at == 0
            out[left[found]], out[left[root]] = self.next[where[found]], self.root_next[w[root]]
            total[left[found]] += self.weight[where[found]]
            total[left[root]] += self.root[w[root]]
            on = ~found & ~root
            total[left[on]] += self.failure_weight[at[on]]
            left, at = left[on], self.failure[at[on]]
        return out, total

    def read(self, begin: np.ndarray, order: int, segment: int = SEGMENT) -> np.ndarray:
        """Log-probability of each text, all read side by side in segments."""
        size = np.diff(begin)
        n = -(-size // segment)
        text = np.repeat(np.arange(len(size)), n)
        part = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        low = begin[text] + part * segment
        high = np.minimum(begin[text + 1], low + segment)
        # what comes before a segment decides its state: a text's start, or the last tokens before it
        warm = np.minimum(part * segment, order - 1)
        state = np.where(part == 0, self.start, 0)
        longest = np.argsort(low - high - warm, kind="stable")
        low, high, warm, state, text = low[longest] - warm[longest], high[longest], warm[longest], state[longest], text[longest]
        length = high - low
        total = np.zeros(len(low))
        for t in range(int(length.max(initial=0))):
            live = np.searchsorted(-length, -t, "left")
            state[:live], gain = self.step(state[:live], self.word[low[:live] + t])
            total[:live] += np.where(t >= warm[:live], gain, 0.0)
        return np.bincount(text, total, minlength=len(size))


def _which(part: Level, at: np.ndarray) -> np.ndarray:
    return part.which[np.searchsorted(part.at, at)]


def _bounds(keys: np.ndarray, shares: int) -> np.ndarray:
    """Where each share of the range of digests begins among sorted ``keys``."""
    share = ((keys >> np.uint64(40)) * np.uint64(shares)) >> np.uint64(24)
    return np.searchsorted(share, np.arange(shares + 1, dtype=np.uint64))


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted distinct keys as the first and the steps, byte by byte of equal weight, compressed: the upper bytes are few values."""
    steps = np.ascontiguousarray(np.diff(keys).view(np.uint8).reshape(-1, 8).T)
    return np.array([len(keys)], dtype=np.int64).tobytes() + keys[:1].tobytes() + pa.compress(steps.tobytes(), codec="zstd", asbytes=True)


def unpack_keys(blob: bytes) -> np.ndarray:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    planes = np.frombuffer(pa.decompress(blob[16:], decompressed_size=8 * (n - 1), codec="zstd", asbytes=True), np.uint8).reshape(8, n - 1)
    steps = np.ascontiguousarray(planes.T).view(np.uint64).ravel()
    return np.cumsum(np.concatenate([np.frombuffer(blob, np.uint64, 1, 8), steps]), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts as compressed bytes, those of 255 or more in full after them."""
    small = pa.compress(np.minimum(counts, 255).astype(np.uint8).tobytes(), codec="zstd", asbytes=True)
    return np.array([len(counts), len(small)], dtype=np.int64).tobytes() + small + counts[counts >= 255].astype(np.int64).tobytes()


def unpack_counts(blob: bytes) -> np.ndarray:
    n, size = (int(x) for x in np.frombuffer(blob, np.int64, 2))
    out = np.frombuffer(pa.decompress(blob[16:16 + size], decompressed_size=n, codec="zstd", asbytes=True), np.uint8).astype(np.int64)
    out[out == 255] = np.frombuffer(blob, np.int64, offset=16 + size)
    return out


_DOC = pa.schema([("id", pa.int64()), ("t", pa.large_string()), ("trained", pa.bool_()), ("times", pa.int64())])
_ASK = "share int, batch int, length int, keys binary, counts binary"
_ANSWER = "batch int, share int, length int, counts binary"
_TOTALS = "n_all long, n_distinct long"
_SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                     ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _packed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that go to one batch together, compressed: texts move two thirds as heavy as one by one."""
    for rows in it:
        to = np.asarray(rows.column("batch"))
        docs = pa.Table.from_batches([rows]).select(_DOC.names).cast(_DOC)
        for k in np.unique(to):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, _DOC, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(docs.take(pa.array(np.flatnonzero(to == k))))
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["batch", "docs"])


def _unpacked(table: pa.Table) -> pa.Table:
    parts = [pa.ipc.open_stream(b).read_all() for b in table.column("docs").to_pylist()] if len(table) else []
    return pa.concat_tables(parts).combine_chunks() if parts else _DOC.empty_table()


def _schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


def _trained(id_col: str):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(7)) != 2, F.lit(True))


def _ask(packed: pa.Table, known: list[np.ndarray], lengths: tuple[int, ...], shares: int) -> pa.Table:
    """One row for each share of the digests that the batch needs, with its own training counts."""
    out: dict[str, list] = {f.name: [] for f in _schema(_ASK)}
    if not len(packed):
        return pa.table(out, schema=_schema(_ASK))
    docs, batch = _unpacked(packed), packed.column("batch")[0].as_py()
    tokens, begin = digests(docs.column("t").combine_chunks())
    trained = np.repeat(np.asarray(docs.column("trained")) * np.asarray(docs.column("times")), np.diff(begin))
    for n, part in enumerate(levels(tokens, begin, known, max(lengths)), 1):
        if n not in lengths:
            continue
        counts = np.bincount(part.which, weights=trained[part.at], minlength=len(part.distinct)).astype(np.int64)
        bound = _bounds(part.distinct, shares)
        for s in range(shares):
            if bound[s + 1] > bound[s]:
                cut = slice(bound[s], bound[s + 1])
                for c, v in zip(out, (s, batch, n, pack_keys(part.distinct[cut]), pack_counts(counts[cut])), strict=True):
                    out[c].append(v)
    return pa.table(out, schema=_schema(_ASK))


def _merged(table: pa.Table, length: int) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """(batch, number of digests) of each question, which digest each one is, and the totals."""
    of = zip(*(table.column(c).to_pylist() for c in ("length", "batch", "keys", "counts")), strict=True)
    rows = [(b, unpack_keys(k), unpack_counts(c)) for n, b, k, c in of if n == length]
    if not rows:
        return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    distinct, which = np.unique(np.concatenate([k for _, k, _ in rows]), return_inverse=True)
    total = np.bincount(which, weights=np.concatenate([c for _, _, c in rows]), minlength=len(distinct)).astype(np.int64)
    return [(b, len(k)) for b, k, _ in rows], which, total


def _answer(table: pa.Table) -> pa.Table:
    """The corpus counts to each question of a share, in its order."""
    out: dict[str, list] = {f.name: [] for f in _schema(_ANSWER)}
    share = table.column("share")[0].as_py()
    for n in sorted(set(table.column("length").to_pylist())):
        asked, which, total = _merged(table, n)
        at = 0
        for batch, size in asked:
            for c, v in zip(out, (batch, share, n, pack_counts(total[which[at:at + size]])), strict=True):
                out[c].append(v)
            at += size
    return pa.table(out, schema=_schema(_ANSWER))


def _totals(table: pa.Table) -> pa.Table:
    """Training tokens, and how many different ones, of a share."""
    total = _merged(table, 1)[2]
    return pa.table({"n_all": [int(total.sum())], "n_distinct": [int((total > 0).sum())]}, schema=_schema(_TOTALS))


def _known(answers: pa.Table) -> list[np.ndarray]:
    """Counts of the distinct digests of each length, in order: shares are ranges of digests."""
    told: dict[int, list] = {}
    for n, share, counts in zip(*(answers.column(c).to_pylist() for c in ("length", "share", "counts")), strict=True):
        told.setdefault(n, []).append((share, counts))
    return [np.concatenate([unpack_counts(c) for _, c in sorted(told[n])]) if n in told else np.zeros(0, np.int64)
            for n in range(1, max(told, default=0) + 1)]


def _walk(packed: pa.Table, answers: pa.Table, order: int, heaps: float) -> pa.Table:
    """Build what the batch can reach of the automaton and read its texts."""
    if not len(packed):
        return _SCORES.empty_table()
    docs = _unpacked(packed)
    tokens, begin = digests(docs.column("t").combine_chunks())
    counts = _known(answers)
    counts += [np.zeros(0, np.int64)] * (order - len(counts))
    n_all, n_distinct = (pc.max(answers.column(c)).as_py() for c in ("n_all", "n_distinct"))
    automaton = Automaton(tokens, begin, list(levels(tokens, begin, counts, order)), counts, n_all, n_distinct, heaps)
    word, at = automaton.word, begin[:-1]
    out = pa.table({
        "doc_id": docs.column("id"), "held_out": pc.invert(docs.column("trained")),
        "n_tokens": pa.array(np.diff(begin).astype(np.int64)),
        "n_known": pa.array(np.add.reduceat((counts[0][word] > 0).astype(np.int64), at)),
        "train_tokens": pa.array(np.full(len(at), n_all, dtype=np.int64)),
        "base_score": pa.array(np.add.reduceat(automaton.root[word], at)),
        "score": pa.array(automaton.read(begin, order))}, schema=_SCORES)
    return out.take(pa.array(np.repeat(np.arange(len(at)), np.asarray(docs.column("times")))))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, heaps: float = HEAPS,
          batch_chars: int = BATCH_CHARS, least_batches: int = LEAST_BATCHES) -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` of each row.

    Rows whose crc32 of the id as text leaves 2 by 7 are held out. Null and empty
    texts are the end token alone; rows without an id train; repeated rows count
    each time and are returned each, those that would crowd a batch after being
    read once; an empty table gives no
    rows; with no training text every token has the probability of an unknown
    one. Texts of any length are read whole. ``order``: the longest n-gram, 2 at least.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("t"), _trained(id_col).alias("trained"))
    known = settle(rows.groupBy("id", "th").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("t").cast("long")).alias("chars")))
    chars = known.agg(F.coalesce(F.sum("chars"), F.lit(0))).first()[0]
    batches = max(least_batches, -(-chars // batch_chars))
    # so many repeats of one row that they would crowd a batch: eight times the batches at most, each read once
    crowds = small(known.filter((F.col("n") > 1) & (F.col("chars") > batch_chars // 8)).select(F.col("id").alias("_id"), F.col("th").alias("_th")))
    crowd = F.col("id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th"))
    one_by_one = rows.join(crowds, crowd, "left_anti").withColumn("times", F.lit(1).cast("long"))
    together = rows.join(crowds, crowd, "left_semi").groupBy("id", "th", "trained").agg(F.first("t").alias("t"), F.count(F.lit(1)).alias("times"))
    deal = F.pmod(F.xxhash64("id", "th"), F.lit(batches)).cast("int")
    held = one_by_one.unionByName(together).select("id", "t", "trained", "times", deal.alias("batch")).mapInArrow(
        _packed, "batch int, docs binary").repartition(batches, "batch")

    def first(table: pa.Table) -> pa.Table:
        return _ask(table, [], (1, 2), batches)

    asked = held.groupBy("batch").applyInArrow(first, _ASK)
    totals = asked.groupBy("share").applyInArrow(_totals, _TOTALS).agg(
        F.coalesce(F.sum("n_all"), F.lit(0)).alias("n_all"), F.coalesce(F.sum("n_distinct"), F.lit(0)).alias("n_distinct")).withColumn("one", F.lit(1))
    # one row
    answers = asked.groupBy("share").applyInArrow(_answer, _ANSWER).withColumn("one", F.lit(1)).join(F.broadcast(totals), "one").drop("one")
    answers = answers.repartition(batches, "batch")

    def longer(n: int):
        def further(table: pa.Table, told: pa.Table) -> pa.Table:
            return _ask(table, _known(told), (n,), batches)

        return further

    for n in range(3, order + 1):
        more = held.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(longer(n), _ASK).groupBy("share").applyInArrow(_answer, _ANSWER)
        answers = answers.unionByName(more, allowMissingColumns=True)

    def walk(table: pa.Table, told: pa.Table) -> pa.Table:
        return _walk(table, told, order, heaps)

    return held.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(
        walk, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
