"""Two tokenizers' encodings of the same texts, aligned, with corpus counts of the pairs that end together.

Both tokenizers begin a token at a lone blank between two words, whatever stands
around it (see ``cut_units``), so a text is aligned unit by unit and a worker
encodes and aligns each different unit once while it remembers it.

1. A first pass aligns the texts; each task keeps its different pairs and their
   numbers. The different pairs of all tasks become the keys of a minimal perfect
   hash (Limasset, Rizk, Chikhi, Peterlongo 2017), built in ``SHARDS`` tasks and
   stored with the keys, so a stranger is told from a key.
2. What each task counted becomes a dense vector indexed by the hash; slices of
   the vectors are summed in a tree of ``FAN`` branches.
3. A second pass aligns the texts again and looks their pairs up.

Tokens that end together are a token and a suffix of it, so there are no more
pairs than the bytes of both vocabularies (``pair_bound``: about a million),
however large the corpus is. That bounds the hash and the vectors, the only
things that pass through the driver.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

SHARDS = 16
FAN = 64
#: Slots of a vector that travel as one row.
SLICE = 1 << 14
#: Bits a key of each level of the hash.
GAMMA = 2.0
#: Different units, and their characters, that a worker remembers.
UNITS, UNIT_CHARS = 400_000, 16 << 20
#: Characters of texts that are aligned at once.
_POOL = 1 << 22
_LOOSE = re.compile("[\\s᠎﻿]\x20|^\x20|\x20$")
#: New units that are encoded as one text.
_BLOCK = 2048
_BLANKS = frozenset(chr(c) for c in range(0x10000) if chr(c).isspace()) | set("᠎﻿")


def cut_units(text: str) -> list[str]:
    """``text`` cut at blanks (0x20) where both tokenizers begin a token.

    The pre-token rule of the first looks forward only, and a token of it that
    follows a non-blank begins at a blank; pieces of the second hold a blank
    after anything else nowhere. So a blank after a non-blank is a boundary. It
    is taken unless the text ends there or another blank follows, so no unit is
    empty but that of an empty text.
    """
    words = text.split(" ")
    if not _LOOSE.search(text):
        return words
    out = [words[0]]
    for w in words[1:]:
        if w and out[-1] and out[-1][-1] not in _BLANKS:
            out.append(w)
        else:
            out[-1] = f"{out[-1]} {w}"
    return out


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class Pair:
    """Both tokenizers, the bytes of their tokens, and what is known of units: their numbers, sizes, pairs and groups."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        letter = byte_letters()
        tokens = {i: t for t, i in self.a.get_vocab(with_added_tokens=False).items()}
        self.bytes_a = [bytes(letter[c] for c in tokens.get(i, "")) for i in range(max(tokens) + 1)]
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode("utf-8")
                        for i, p in enumerate(self.b.id_to_piece(list(range(self.b.get_piece_size()))))]
        self.size_a, self.size_b = (np.array([len(x) for x in table], dtype=np.int64) for table in (self.bytes_a, self.bytes_b))
        # an id as text, with what follows it inside a group and at its end
        self.text_a, self.last_a = (np.array([f"{i}{end}" for i in range(len(self.bytes_a))], dtype=object) for end in ",|")
        self.text_b, self.last_b = (np.array([f"{i}{end}" for i in range(len(self.bytes_b))], dtype=object) for end in ",;")
        self.written = False
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.chars = 0
        self.sizes = np.zeros((0, 4), dtype=np.int64)
        self.groups: list[str] = []
        self.pairs, self.pairs_at = np.zeros(0, dtype=np.uint64), np.zeros(1, dtype=np.int64)

    def writing(self, written: bool) -> Pair:
        """Whether groups are wanted as text from now on."""
        if self.written != written:
            self.written = written
            self.forget()
        return self

    def _encode(self, units: list[str], firm: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of both sides in a row, how many each unit has, and whether their bytes are the unit's (no tokens otherwise).

        Units that are ``firm``, without a blank at their edges, are encoded as
        one text, as both sides cut it between them. Where that text's bytes
        don't come back, and for other units, each is encoded by itself.
        """
        raw = [(" " + u).encode("utf-8", "replace") for u in units]
        whole = b"".join(raw)
        if firm:
            text = " ".join(units)
            flat = [np.array(x, dtype=np.int64) for x in (self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, self.b.encode(text, num_threads=1))]
            if all(b"".join([table[i] for i in x.tolist()]) == whole for table, x in zip((self.bytes_a, self.bytes_b), flat, strict=True)):
                ends = np.cumsum([len(r) for r in raw])
                n = [np.diff(np.searchsorted(np.cumsum(size[x]), ends, "right"), prepend=0) for size, x in zip((self.size_a, self.size_b), flat, strict=True)]
                return flat[0], n[0], flat[1], n[1], np.ones(len(units), dtype=bool)
        a = [e.ids for e in self.a.encode_batch_fast([" " + u for u in units], add_special_tokens=False)]
        b = self.b.encode(units, num_threads=1)
        same = np.array([b"".join([self.bytes_a[i] for i in x]) == r == b"".join([self.bytes_b[i] for i in y]) for x, y, r in zip(a, b, raw, strict=True)], dtype=bool)
        a, b = ([x if k else [] for x, k in zip(y, same.tolist(), strict=True)] for y in (a, b))
        return (*(np.fromiter(f, np.int64) for f in (chain.from_iterable(a), map(len, a), chain.from_iterable(b), map(len, b))), same)

    def learn(self, units: list[str]) -> None:
        """Encode and align different new units, all at once."""
        loose = [u for u in units if u[:1] == " " or u[-1] in _BLANKS]
        parts = [(loose, False), (list(set(units) - set(loose)) if loose else units, True)]
        units = parts[0][0] + parts[1][0]
        blocks = [self._encode(part[i:i + _BLOCK], firm) for part, firm in parts for i in range(0, len(part), _BLOCK)]
        flat_a, n_a, flat_b, n_b, same = (np.concatenate(x) for x in zip(*blocks, strict=True))
        # both sides have the same bytes, so their ends can be compared along all units at once
        end_a, end_b = np.cumsum(self.size_a[flat_a]), np.cumsum(self.size_b[flat_b])
        at_b = np.searchsorted(end_b, end_a)
        last_a = np.flatnonzero(end_b[at_b] == end_a)
        last_b = at_b[last_a]
        links = np.bincount(np.repeat(np.arange(len(units)), n_a)[last_a], minlength=len(units))
        self.pairs = np.append(self.pairs, flat_a[last_a].astype(np.uint64) << np.uint64(32) | flat_b[last_b].astype(np.uint64))
        self.pairs_at = np.append(self.pairs_at, self.pairs_at[-1] + np.cumsum(links))
        if self.written:
            in_a, in_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
            begin = np.cumsum(in_a + in_b) - in_a - in_b
            words = np.empty(len(flat_a) + len(flat_b), dtype=object)
            for flat, last, size, start, text, final in ((flat_a, last_a, in_a, begin, self.text_a, self.last_a), (flat_b, last_b, in_b, begin + in_a, self.text_b, self.last_b)):
                written = text[flat]
                written[last] = final[flat[last]]
                words[np.arange(len(flat)) + np.repeat(start - (last - size + 1), size)] = written
            flat_words, ends = words.tolist(), np.cumsum(n_a + n_b).tolist()
            self.groups += ["".join(flat_words[i:j]) for i, j in zip([0, *ends[:-1]], ends, strict=True)]
        first = len(self.sizes)
        self.sizes = np.concatenate([self.sizes, np.stack([n_a, n_b, links, ~same], axis=1)])
        self.number |= dict(zip(units, range(first, first + len(units)), strict=True))
        self.chars += sum(map(len, units))

    def numbers(self, units: list[str]) -> np.ndarray:
        """The number of each unit; forgets all others first where it remembers too many, so numbers last until the next call."""
        if len(self.number) > UNITS or self.chars > UNIT_CHARS:
            self.forget()
        new = list(set(units) - self.number.keys())
        if new:
            self.learn(new)
        return np.fromiter(map(self.number.__getitem__, units), dtype=np.int64, count=len(units))

    def pairs_of(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of some units in a row, and how many each has."""
        n = self.pairs_at[units + 1] - self.pairs_at[units]
        first = np.cumsum(n) - n
        return self.pairs[np.arange(n.sum()) + np.repeat(self.pairs_at[units] - first, n)], n


@lru_cache(maxsize=2)
def load_pair(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


def pair_bound(pair: Pair) -> int:
    """No more pairs can end together: each suffix of a token is a token of the other side at most as often as that side repeats its bytes."""
    def most(table: list[bytes]) -> int:
        return int(np.unique(np.array([hash(t) for t in table]), return_counts=True)[1].max())

    return sum(map(len, pair.bytes_a)) * most([t for t in pair.bytes_b if t]) + sum(map(len, pair.bytes_b)) * most([t for t in pair.bytes_a if t])


def _aligned(texts: list[str | None], pair: Pair) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of some texts at a time: their places, where each one's units begin, and the units' numbers; texts without tokens are left out."""
    at, starts, units, held = [], [], [], 0

    def out() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        numbers = pair.numbers(units)
        bad = np.add.reduceat(pair.sizes[numbers, 3], starts) > 0
        size = np.diff(np.append(starts, len(numbers)))
        keep = numbers[np.repeat(~bad, size)]
        size = size[~bad]
        if len(size):
            yield np.array(at)[~bad], np.append(0, np.cumsum(size)[:-1]), keep

    for k, t in enumerate(texts):
        if not t:
            continue
        at.append(k)
        starts.append(len(units))
        units += cut_units(t)
        held += len(t)
        if held >= _POOL:
            yield from out()
            at, starts, units, held = [], [], [], 0
    if at:
        yield from out()


def _mix(keys: np.ndarray, level: int) -> np.ndarray:
    """A different 64-bit mixing of ``keys`` for each level (splitmix64)."""
    x = keys + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Numbers different keys 0 to n - 1; a key that it wasn't made of gets -1."""

    def __init__(self, levels: list[np.ndarray], keys: np.ndarray):
        self.levels, self.keys = levels, keys
        self.ranks, base = [], 0
        for bits in levels:
            self.ranks.append(base + np.cumsum(bits) - 1)
            base += int(bits.sum())

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """Keys that meet no other at a level are placed there, the rest go to the next."""
        levels, left = [], keys
        while len(left):
            size = max(64, int(GAMMA * len(left)))
            at = (_mix(left, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size)[at] == 1
            bits = np.zeros(size, dtype=bool)
            bits[at[alone]] = True
            levels.append(bits)
            left = left[~alone]
        made = cls(levels, np.zeros(len(keys), dtype=np.uint64))
        made.keys[made._places(keys)] = keys
        return made

    def _places(self, keys: np.ndarray) -> np.ndarray:
        out, open_ = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            at = (_mix(keys[open_], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[open_[hit]] = ranks[at[hit]]
            open_ = open_[~hit]
        return out

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), -1, dtype=np.int64)
        at = self._places(keys)
        return np.where((at >= 0) & (self.keys[at] == keys), at, -1)

    def packed(self) -> dict:
        return {"sizes": [len(b) for b in self.levels], "bits": np.packbits(np.concatenate([*self.levels, np.zeros(0, bool)])).tobytes(), "keys": self.keys.tobytes()}

    @classmethod
    def unpacked(cls, row) -> PerfectHash:
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8)).astype(bool)[:sum(row["sizes"])]
        cuts = np.cumsum(row["sizes"])[:-1]
        return cls(np.split(bits, cuts) if row["sizes"] else [], np.frombuffer(row["keys"], np.uint64))


def shard_of(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys, 63) % np.uint64(SHARDS)).astype(np.int64)


class ShardedHash:
    """One perfect hash a shard; indexes of a shard follow those of the ones before."""

    def __init__(self, shards: dict[int, PerfectHash]):
        self.shards = shards
        sizes = [len(shards[s].keys) if s in shards else 0 for s in range(SHARDS)]
        self.first = np.append(0, np.cumsum(sizes))
        self.n = int(self.first[-1])

    def keys(self) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint64), *[self.shards[s].keys for s in sorted(self.shards)]])

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        out, shard = np.full(len(keys), -1, dtype=np.int64), shard_of(keys)
        for s, h in self.shards.items():
            mine = np.flatnonzero(shard == s)
            at = h.lookup(keys[mine])
            out[mine] = np.where(at >= 0, at + self.first[s], -1)
        return out


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t"))


def _pack(v: np.ndarray) -> bytes:
    return pa.compress(v.tobytes(), codec="zstd", asbytes=True)


def _unpack(b: bytes, n: int, kind: type = np.int64) -> np.ndarray:
    return np.frombuffer(pa.decompress(b, decompressed_size=8 * n, codec="zstd", asbytes=True), kind)


def tally(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The first pass: one row a task, its different pairs (``keys``) and how often it links them (``times``), packed."""
    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = load_pair(path_a, path_b).writing(False)
        keys, times = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for b in it:
            for _, _, numbers in _aligned(b.column(0).to_pylist(), pair):
                unit, often = np.unique(numbers, return_counts=True)
                pairs, n = pair.pairs_of(unit)
                keys, at = np.unique(np.append(keys, pairs), return_inverse=True)
                every, times = np.append(times, np.repeat(often, n)), np.zeros(len(keys), np.int64)
                np.add.at(times, at, every)
        if len(keys):
            yield pa.RecordBatch.from_arrays([pa.array([len(keys)]), pa.array([_pack(keys)], pa.binary()), pa.array([_pack(times)], pa.binary())], ["n", "keys", "times"])

    return settle(_texts(docs, id_col, text_col).select("t").mapInArrow(count, "n long, keys binary, times binary"))


def hash_pairs(tallies: DataFrame) -> ShardedHash:
    """The minimal perfect hash of the different pairs of all tasks."""
    def spread(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for n, keys in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = _unpack(keys, n, np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(shard_of(found))], ["pair", "shard"])

    def build(table: pa.Table) -> pa.Table:
        keys = np.sort(table.column("pair").to_numpy()).view(np.uint64)
        return pa.Table.from_pylist([{"shard": table.column("shard")[0].as_py(), **PerfectHash.build(keys).packed()}],
                                    schema=pa.schema([("shard", pa.int64()), ("sizes", pa.list_(pa.int64())), ("bits", pa.binary()), ("keys", pa.binary())]))

    pairs = tallies.select("n", "keys").mapInArrow(spread, "pair long, shard long").distinct()
    rows = pairs.groupBy("shard").applyInArrow(build, "shard long, sizes array<long>, bits binary, keys binary").collect()
    return ShardedHash({r["shard"]: PerfectHash.unpacked(r) for r in rows})


def sum_vectors(tallies: DataFrame, hashed: ShardedHash) -> np.ndarray:
    """How many links of all texts hold each pair, by its index: a dense vector a task, summed in a tree, slice by slice."""
    sent = tallies.sparkSession.sparkContext.broadcast(hashed)

    def vectors(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        total = np.zeros(known.n, dtype=np.int64)
        for b in it:
            for n, keys, times in zip(*(c.to_pylist() for c in b.columns), strict=True):
                total[known.lookup(_unpack(keys, n, np.uint64))] += _unpack(times, n)
        for k in range(-(-len(total) // SLICE)):
            v = total[k * SLICE:(k + 1) * SLICE]
            if v.any():
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([len(v)]), pa.array([_pack(v)], pa.binary())], ["slice", "n", "v"])

    def add(key: tuple, table: pa.Table) -> pa.Table:
        n, out = table.column("n")[0].as_py(), 0
        for v in table.column("v"):
            out = out + _unpack(v.as_py(), n)
        return pa.table([pa.array([key[0].as_py()]), pa.array([n]), pa.array([_pack(out)], pa.binary()), pa.array([key[1].as_py()], pa.int32())], names=["slice", "n", "v", "branch"])

    width = max(1, tallies.rdd.getNumPartitions())
    summed = tallies.select("n", "keys", "times").mapInArrow(vectors, "slice long, n long, v binary").withColumn("branch", F.spark_partition_id())
    while True:
        width = -(-width // FAN)
        summed = summed.withColumn("branch", F.pmod("branch", F.lit(width))).groupBy("slice", "branch").applyInArrow(add, "slice long, n long, v binary, branch int")
        if width == 1:
            break
    total = np.zeros(hashed.n, dtype=np.int64)
    for r in summed.collect():
        total[r["slice"] * SLICE:r["slice"] * SLICE + r["n"]] = _unpack(bytes(r["v"]), r["n"])
    return total


def align_documents(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False) -> DataFrame:
    """``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256`` of each row.

    ``path_a``: a byte-level vocabulary of tokenizers, ``path_b``: a model of
    sentencepiece that marks blanks and falls back to bytes; both there on every
    executor. A link joins the tokens that end a group; its count is how often
    the corpus links them; it is best if no other first token is linked to its
    second more often. ``with_groups`` adds the ``groups`` themselves.
    Texts that are null, empty, or that either side's bytes don't give back have
    no tokens: zeros, and no digest. Null ids stay null; repeated rows count each;
    texts of any length are aligned whole; an empty table gives no rows; further
    columns aren't read.
    """
    spark = docs.sparkSession
    tallies = tally(docs, path_a, path_b, id_col, text_col)
    hashed = hash_pairs(tallies)
    counts = sum_vectors(tallies, hashed)
    second = (hashed.keys() & np.uint64(0xFFFFFFFF)).astype(np.int64)
    most = np.zeros(int(second.max()) + 1 if len(second) else 0, dtype=np.int64)
    np.maximum.at(most, second, counts)
    sent = spark.sparkContext.broadcast((hashed, counts, counts == most[second]))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *(["groups"] if with_groups else [])]

    def look(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, (known, often, best) = load_pair(path_a, path_b).writing(True), sent.value
        for b in it:
            out, texts, digests = np.zeros((b.num_rows, 5), dtype=np.int64), [""] * b.num_rows, [""] * b.num_rows
            for at, starts, numbers in _aligned(b.column(1).to_pylist(), pair):
                unit, which = np.unique(numbers, return_inverse=True)
                pairs, n = pair.pairs_of(unit)
                index, cuts = known.lookup(pairs), np.cumsum(n) - n
                told = np.stack([np.add.reduceat(best[index].astype(np.int64), cuts), np.add.reduceat(often[index], cuts)], axis=1)
                out[at, :3] = np.add.reduceat(pair.sizes[numbers, :3], starts, axis=0)
                out[at, 3:] = np.add.reduceat(told[which], starts, axis=0)
                written, ends = [pair.groups[k] for k in numbers.tolist()], np.append(starts[1:], len(numbers)).tolist()
                for k, i, j in zip(at.tolist(), starts.tolist(), ends, strict=True):
                    groups = "".join(written[i:j])[:-1]
                    digests[k] = hashlib.sha256(groups.encode()).hexdigest()
                    if with_groups:
                        texts[k] = groups
            columns = [out[:, 0], out[:, 1], out[:, 2], out[:, 2], out[:, 3], out[:, 4]]
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, columns), pa.array(digests, pa.string()), *([pa.array(texts, pa.string())] if with_groups else [])], names)

    return _texts(docs, id_col, text_col).mapInArrow(look, ", ".join(f"{n} {'string' if n.startswith('groups') else 'long'}" for n in names))
