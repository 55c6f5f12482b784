"""Token counts of whole texts, huge ones by overlapping chunks.

A huge text is encoded in chunks that overlap their successor. The tokenizer's
pre-token rule looks only forward, and merges never cross a pre-token, so once
two encodings both begin a pre-token at the same character, they agree from
there on until one of them runs out of text. Such a common start is a proven
stable boundary if the left chunk saw at least the whole next pre-token; the
chunks are spliced there. Where an overlap has none (one endless word, one run
of blanks) it is doubled, at last to the end of the text.

Shorter texts are cut at the boundaries that the same rule proves without any
encoding: a single blank between two non-blanks always begins a pre-token. The
cut pieces repeat, so each batch encodes every distinct piece once. Texts with
other blanks than that are encoded whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 16
OVERLAP = 1 << 9
LIMIT = 1024
#: Characters of the texts whose pieces are pooled at once.
_POOL = 1 << 22
#: A blank that isn't a lone 0x20 between two non-blanks, but for line ends and
#: the like inside a piece, which stay there: they touch no 0x20.
_IRREGULAR = re.compile(r"\s\x20|\x20\s|^\x20|\x20$|[\x1c-\x1f\x85﻿᠎]")


@lru_cache(maxsize=4)
def load_tokenizer(path: str):
    """The tokenizer of a vocabulary file, as its library loads it."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def _starts(encoding, base: int) -> dict[int, int]:
    """Character offset of each pre-token's first token: tokens before it."""
    out, last = {}, object()
    for i, (word, (at, _)) in enumerate(zip(encoding.word_ids, encoding.offsets, strict=True)):
        if word != last or word is None:
            out[base + at] = i
            last = word
    return out


def count_spliced(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of ``text`` from overlapping chunks; equal to encoding it whole.

    Cuts are trusted only where both sides begin a pre-token at least one
    pre-token away from the ends; no chunk ends inside a special token's string.
    """
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]

    def encode(a: int, b: int):
        return tokenizer.encode(text[a:b], add_special_tokens=False)

    def outside(at: int, forward: bool) -> int:
        for s in special:
            i = text.find(s, max(0, at - len(s) + 1), at + len(s) - 1)
            if 0 <= i < at < i + len(s):
                return i + len(s) * forward
        return at

    total, left_at, n = 0, 0, len(text)
    left_end = outside(min(n, chunk + overlap), True)
    left, skip = encode(0, left_end), 0
    while left_end < n:
        wide = overlap
        while True:
            right_at = max(left_at, outside(left_end - wide, False)) if left_end - wide > left_at else left_at
            right_end = outside(min(n, right_at + chunk + wide), True)
            right = encode(right_at, right_end)
            a, b = _starts(left, left_at), _starts(right, right_at)
            sure = sorted(a)[-3:][0] if len(a) > 3 else -1
            first = sorted(b)[2:3]
            common = [x for x in a if first and first[0] <= x <= sure and x in b and a[x] > skip]
            if common:
                cut = min(common)
                total += a[cut] - skip
                left, left_at, left_end, skip = right, right_at, right_end, b[cut]
                break
            # no stable boundary in the overlap: let the left chunk see more, and look back further
            wide *= 2
            left_end = outside(min(n, left_end + wide), True)
            left = encode(left_at, left_end)
            if left_end == n:
                break
    return total + len(left) - skip


def _pieces(texts: list[str], tokenizer) -> np.ndarray:
    """Tokens of regular texts: those of their pieces, each distinct one encoded once."""
    lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
    at = np.asarray(lists.offsets)[: len(texts)].astype(np.int64)
    flat = lists.flatten()
    head = np.zeros(len(flat), dtype=bool)
    head[at] = True
    coded = pc.dictionary_encode(flat)
    words = coded.dictionary.to_pylist()
    codes = np.asarray(coded.indices)
    counts = np.zeros(len(flat), dtype=np.int64)
    for mask, lead in ((~head, " "), (head, "")):
        used = np.unique(codes[mask])
        size = np.zeros(len(words), dtype=np.int64)
        for i in range(0, len(used), 4096):
            part = used[i:i + 4096]
            size[part] = [len(e) for e in tokenizer.encode_batch_fast([lead + words[k] for k in part], add_special_tokens=False)]
        counts[mask] = size[codes[mask]]
    return np.add.reduceat(counts, at)


def count_batch(texts: list[str], tokenizer, chunk: int = CHUNK, overlap: int = OVERLAP) -> np.ndarray:
    out = np.zeros(len(texts), dtype=np.int64)
    pool, held = [], 0

    def flush() -> None:
        nonlocal held
        if pool:
            out[pool] = _pieces([texts[i] for i in pool], tokenizer)
        pool.clear()
        held = 0

    for i, t in enumerate(texts):
        if not t:
            continue
        if len(t) > chunk // 2:
            out[i] = count_spliced(tokenizer, t, chunk, overlap)
        elif _IRREGULAR.search(t):
            out[i] = len(tokenizer.encode(t, add_special_tokens=False))
        else:
            pool.append(i)
            held += len(t)
            if held >= _POOL:
                flush()
    flush()
    return out


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens``, ``over_limit`` of each row, in one pass without a shuffle.

    ``vocabulary``: the path of a tokenizers .json, there on every executor.
    Null and empty texts have no bytes and no tokens; null ids stay null;
    repeated rows are counted each; an empty table gives no rows.
    """
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load_tokenizer(vocabulary)
        for b in it:
            texts = b.column(1).to_pylist()
            n_bytes = pa.array([len(t.encode("utf-8", "replace")) if t else 0 for t in texts], pa.int64())
            n = count_batch(texts, tokenizer, chunk, overlap)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), n_bytes, pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(
        batches, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
