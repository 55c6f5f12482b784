"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed slots, so a question asked again with
other values has the same template. A value may be many words ("one hundred and
five", "half past nine", "2 million", "John Smith"): a run of them is one slot,
whose value is the whole run. Windows of template tokens are hashed and
joined between documents and benchmark; matches on one diagonal are gathered,
and the values that fill the slots must map one to one: the same benchmark value
always to the same document value, different ones to different ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle, small

WINDOW = 8
#: Items of fewer tokens are looked for as whole texts only: inside others they say too little.
SHORTEST = 5
#: A leak covers this share of an item's template, or a run of two windows.
COVERAGE = 0.5
#: Window hashes of the benchmark that are sent to the executors at most (8 bytes each).
BROADCAST_HASHES = 1 << 21
#: Texts whose tokens are held at a time.
_SLICE = 2000

# Words that fill slots.
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
    "eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen "
    "half third quarter twice thrice".split())
UNIT_WORDS = frozenset(
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ounce ounces pound "
    "pounds ton tons ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days "
    "week weeks month months year years dollar dollars cent cents euro euros percent mph kph meter meters metre metres "
    "kilometer kilometers centimeter centimeters degrees celsius fahrenheit watts volts joules hertz".split())
SCALE_WORDS = frozenset("hundred thousand million billion dozen".split())
#: Words that one value has at most; a longer run of names or numbers is a list of them.
LONGEST_NAME, LONGEST_NUMBER = 4, 8
#: Words inside a number, and whether only a scale word may stand before them.
JOINTS = {"and": True, "past": False, "point": False}
GIVEN_NAMES = frozenset(
    "alice bob carol david emma frank grace henry ivan jack james jane john julia kate kevin laura linda lucy maria mark "
    "mary mike natalia nina oliver paul peter rachel robert sam sarah susan thomas tim tom tina weng william".split())
# End of fixed values.

_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d,.:/]*(?:st|nd|rd|th|%)?")
_EDGE = " \t.,;:!?\"'()[]{}<>|*#&%$^~_=+-/\\`“”‘’«»…"
_STOPS = (",", ";", ".", "!", "?", ":", ")", "]")
_LITERAL, _NUM, _UNIT, _NAME = 0, 1, 2, 3
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _spelled(word: str) -> bool:
    """Whether a lower-case word is a number, as "seven" or "twenty-two"."""
    return all(w in NUMBER_WORDS for w in word.split("-"))


def _token(word: str) -> tuple[str, int, bool, bool]:
    """(canonical word, slot type, capitalised, ends a sentence) of one raw word."""
    bare = word.strip(_EDGE)
    low = bare.lower()
    ends = word.rstrip("\"')]”’")[-1:] in (".", "!", "?", ":")
    numeric = word.strip("\"'()[]{}.,;:!?*#&")
    if numeric and _NUMBER.fullmatch(numeric) or _spelled(low):
        return (numeric if numeric[:1].isdigit() else low), _NUM, False, ends
    if low in UNIT_WORDS:
        return low, _UNIT, False, ends
    if low in GIVEN_NAMES and bare[:1].isupper():
        return low, _NAME, False, ends
    return low, _LITERAL, bare[:1].isupper() and any(c.islower() for c in bare), ends


def _runs(of: np.ndarray, kind: np.ndarray, codes: np.ndarray, words: list[str], stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens go on with the value that the one before them began, and the kinds with joints of numbers as numbers.

    Number words in a row, a number before a scale word, names in a row; never
    over a punctuation mark, and never more words than a value has. "and" after a scale word, "past" and "point" between
    numbers belong to the number.
    """
    low = np.array([_spelled(w) for w in words], dtype=bool)[codes]
    scale = np.array([w in SCALE_WORDS for w in words], dtype=bool)[codes]
    near = np.zeros(len(of), dtype=bool)
    near[1:] = (of[1:] == of[:-1]) & ~stops[:-1]
    number, kind, joint = kind == _NUM, kind.copy(), np.zeros(len(of), dtype=bool)
    for word, after_scale in JOINTS.items():
        at = np.flatnonzero(np.array([w == word for w in words], dtype=bool)[codes])
        at = at[(at > 0) & (at < len(of) - 1)]
        at = at[near[at] & near[at + 1] & (scale if after_scale else low)[at - 1] & number[at + 1]]
        joint[at] = True
    kind[joint] = _NUM
    goes = np.zeros(len(of), dtype=bool)
    goes[1:] = near[1:] & (((kind[1:] == _NAME) & (kind[:-1] == _NAME)) | (number[1:] & number[:-1] & ((low[1:] & low[:-1]) | scale[1:])) | joint[1:] | joint[:-1])
    head = np.flatnonzero(~goes)
    size = np.diff(np.append(head, len(of)))
    long = np.repeat(size > np.where(kind[head] == _NAME, LONGEST_NAME, LONGEST_NUMBER), size)
    return goes & ~long, np.where(joint & long, _LITERAL, kind)


def template_tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Per token of all texts: text number, template hash, hash of the value, slot type, code of the canonical value; and the values.

    A token is a word, or a run of words that is one value.
    """
    lists = pc.split_pattern_regex(pc.fill_null(texts.cast(pa.large_string()), ""), r"[\x20\x09-\x0D]+")
    flat = lists.flatten()
    of = np.repeat(np.arange(len(texts)), np.diff(np.asarray(lists.offsets)))
    coded = pc.dictionary_encode(flat)
    codes = np.asarray(coded.indices).astype(np.int64)
    raw = coded.dictionary.to_pylist()
    seen = [_token(w) for w in raw]
    kind = np.array([s[1] for s in seen], dtype=np.int8)[codes] if seen else np.zeros(0, np.int8)
    capital = np.array([s[2] for s in seen], dtype=bool)[codes] if seen else np.zeros(0, bool)
    ends = np.array([s[3] for s in seen], dtype=bool)[codes] if seen else np.zeros(0, bool)
    full = np.array([bool(s[0]) for s in seen], dtype=bool)[codes] if seen else np.zeros(0, bool)
    stops = np.array([w.endswith(_STOPS) for w in raw], dtype=bool)[codes] if seen else np.zeros(0, bool)
    of, codes, kind, capital, ends, stops = of[full], codes[full], kind[full], capital[full], ends[full], stops[full]
    fresh = np.ones(len(of), dtype=bool)
    fresh[1:] = (of[1:] != of[:-1]) | ends[:-1]
    kind = np.where((kind == _LITERAL) & capital & ~fresh, _NAME, kind)
    words = [s[0] for s in seen]
    if seen:
        goes, kind = _runs(of, kind, codes, words, stops)
        heads = np.flatnonzero(~goes)
        size = np.diff(np.append(heads, len(of)))
        run_codes = codes[heads]
        number: dict[str, int] = {}
        for k in np.flatnonzero(size > 1).tolist():
            value = " ".join([words[c] for c in codes[heads[k]:heads[k] + size[k]].tolist()])
            run_codes[k] = number.setdefault(value, len(words) + len(number))
        of, kind, codes = of[heads], kind[heads], run_codes
        words = words + list(number)
    plain = np.array([xxhash.xxh3_64_intdigest(w.encode("utf-8", "replace")) for w in words], dtype=np.uint64)
    slots = np.array([0] + [xxhash.xxh3_64_intdigest(b"<slot>", seed=k) for k in (_NUM, _UNIT, _NAME)], dtype=np.uint64)
    exact = plain[codes] if words else np.zeros(0, np.uint64)
    return of, np.where(kind == _LITERAL, exact, slots[kind]), exact, kind, codes, words


def windows(of: np.ndarray, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the windows of ``size`` tokens in one text."""
    n = len(of) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        total = (total ^ (total >> np.uint64(29))) * _MULTIPLIER + hashes[k:k + n]
    at = np.flatnonzero(of[:n] == of[size - 1:])
    return at, total[at]


_ROW = "id long, th long, pos int, size int, h long, way byte, slots array<struct<p:int,v:string>>"
#: Ways to hash a window: by its template, or its words as they are.
_TEMPLATE, _EXACT = 0, 1


def window_rows(df: DataFrame, id_col: str, text_col: str, sizes: list[int], wanted: np.ndarray | None) -> DataFrame:
    """Windows of each text: ``id``, ``th`` (hash of the text), ``pos`` (token), ``size``, ``h``, ``way``, ``slots`` (token, kind:value).

    A window with slots is also hashed as it is. One of more slots than literals
    says too little as a template, and only its words are hashed; so are windows
    of fewer than ``SHORTEST`` tokens, which only texts of just so many have.
    ``wanted``: sorted hashes; windows of other hashes are left out (None: all stay).
    """
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (big.slice(i, _SLICE) for big in it for i in range(0, len(big), _SLICE)):
            of, hashes, exact, kind, codes, words = template_tokens(b.column(2))
            begin = np.searchsorted(of, np.arange(len(b)))
            n_tokens = np.bincount(of, minlength=len(b))
            slots_to = np.zeros(len(kind) + 1, dtype=np.int32)
            np.cumsum(kind != _LITERAL, out=slots_to[1:])
            for size in sizes:
                for way, values in ((_TEMPLATE, hashes), (_EXACT, exact)):
                    at, h = windows(of, values, size)
                    n = slots_to[at + size] - slots_to[at]
                    if size < SHORTEST:
                        hit = (n_tokens[of[at]] == size) & (way == _EXACT)
                    else:
                        hit = n > 0 if way == _EXACT else 2 * n <= size
                    if wanted is not None and len(wanted):
                        where = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
                        hit &= wanted[where] == h
                    elif wanted is not None:
                        hit[:] = False
                    at, h = at[hit], h[hit]
                    for i in range(0, len(at), 50_000):
                        a = at[i:i + 50_000]
                        first = begin[of[a]]
                        slots = [[(k - f, f"{kind[k]}:{words[codes[k]]}") for k in range(x, x + size) if kind[k]] for x, f in zip(a.tolist(), first.tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays(
                            [b.column(0).take(pa.array(of[a])), b.column(1).take(pa.array(of[a])), pa.array((a - first).astype(np.int32)),
                             pa.array(np.full(len(a), size, np.int32)), pa.array(h[i:i + 50_000].view(np.int64)), pa.array(np.full(len(a), way, np.int8)),
                             pa.array([[{"p": k, "v": v} for k, v in x] for x in slots], pa.list_(pa.struct([("p", pa.int32()), ("v", pa.string())])))],
                            ["id", "th", "pos", "size", "h", "way", "slots"])

    text = F.col(text_col).cast("string")
    return df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("t")).mapInArrow(batches, _ROW)


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """One row per wording, and one per item (``item``, ``template``). Of a wording: ``template``, ``wording`` (keys), ``item`` (least id of the template), ``t``, ``n_tokens``, ``slots``, ``pattern``.

    ``slots`` are (token, kind:value); ``pattern`` numbers the values in order,
    so items whose slots are equal and unequal alike have the same.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            of, hashes, exact, kind, codes, words = template_tokens(b.column(1))
            n = np.bincount(of, minlength=len(b))
            ends = np.cumsum(n)
            keys, own, slots, pattern = [], [], [], []
            for e, k in zip(ends.tolist(), n.tolist(), strict=True):
                keys.append(xxhash.xxh3_128_hexdigest(hashes[e - k:e].tobytes()))
                own.append(xxhash.xxh3_64_intdigest(hashes[e - k:e].tobytes() + exact[e - k:e].tobytes()))
                at = [x for x in range(e - k, e) if kind[x]]
                values = [f"{kind[x]}:{words[codes[x]]}" for x in at]
                number = {v: i for i, v in enumerate(dict.fromkeys(values))}
                slots.append([{"p": x - e + k, "v": v} for x, v in zip(at, values, strict=True)])
                pattern.append([number[v] for v in values])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(keys, pa.string()), pa.array(np.array(own, dtype=np.uint64).view(np.int64)), pa.array(n.astype(np.int64)),
                 pa.array(slots, pa.list_(pa.struct([("p", pa.int32()), ("v", pa.string())]))), pa.array(pattern, pa.list_(pa.int32()))],
                ["item", "t", "template", "wording", "n_tokens", "slots", "pattern"])

    each = (benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("t"))
            .mapInArrow(batches, "item long, t string, template string, wording long, n_tokens long, slots array<struct<p:int,v:string>>, pattern array<int>")
            .filter(F.col("n_tokens") > 0))
    each = settle(each)
    wordings = each.groupBy("template", "wording").agg(F.min(F.struct("item", "t", "n_tokens", "slots", "pattern")).alias("x"), F.min("item").alias("least"))
    least = wordings.groupBy("template").agg(F.min("least").alias("named"))
    named = wordings.join(least, "template").select("template", "wording", F.col("named").alias("item"), "x.t", "x.n_tokens", "x.slots", "x.pattern")
    return named, each.select("item", "template")


def _covered(at: Column, size: Column) -> Column:
    """Tokens under windows of ``size`` that begin ``at`` (sorted), and the longest run of them."""
    return F.aggregate(
        at, F.struct(F.lit(-1_000_000).alias("last"), F.lit(0).alias("covered"), F.lit(0).alias("run"), F.lit(0).alias("longest")),
        lambda s, p: F.struct(
            p.alias("last"), (s["covered"] + F.least(size, p - s["last"])).alias("covered"),
            F.when(p == s["last"] + 1, s["run"] + 1).otherwise(size).alias("run"),
            F.greatest(s["longest"], F.when(p == s["last"] + 1, s["run"] + 1).otherwise(size)).alias("longest")))


def _one_to_one(pairs: Column) -> Column:
    return (F.size(pairs) == F.size(F.array_distinct(pairs["b"]))) & (F.size(pairs) == F.size(F.array_distinct(pairs["d"])))


def item_classes(benchmark: DataFrame, item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``item_id``, ``class_id`` of each benchmark item: the least id of its template, under which ``leaks`` tells of it.

    Items without tokens are in no class; repeated rows come once; items without
    an id have a null ``item_id``.
    """
    wordings, each = _items(benchmark, item_col, item_text_col)
    named = wordings.select("template", F.col("item").alias("class_id")).distinct()
    return each.join(named, "template").select(F.col("item").alias("item_id"), "class_id").distinct()


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, coverage: float = COVERAGE,
          broadcast_hashes: int = BROADCAST_HASHES) -> DataFrame:
    """``doc_id``, ``item_id``, ``matched`` (template tokens), ``item_tokens``: documents that hold a benchmark item.

    Items of one template are one class, named by its least id (``item_classes``
    tells the members), and its template windows are joined once. A document
    holds an item of the class if the values map one to one from the slots of
    any of its items (each pattern of equal and unequal slots is tried once),
    together with that item's windows of many slots, which must be there
    verbatim; or if enough of an item is there verbatim, whatever stands around
    it. Items of fewer tokens than a window are one window; those under
    ``SHORTEST`` tokens are looked for as whole texts. The
    benchmark's window hashes go to the executors while there are at most
    ``broadcast_hashes``; beyond, all document windows take part in the join.
    Null and empty texts have no windows; empty tables give no rows; a document
    is known by id and text, so rows of one id and unlike texts are read apart;
    repeated rows count once; rows without an id are told under a null id.
    """
    found = _leaking(docs, benchmark, id_col, text_col, item_col, item_text_col, window, coverage, broadcast_hashes)
    return found.groupBy(F.col("id").alias("doc_id"), F.col("item").alias("item_id")).agg(
        F.max("matched").cast("long").alias("matched"), F.max("n_tokens").alias("item_tokens"))


def _leaking(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, window: int,
             coverage: float, broadcast_hashes: int) -> DataFrame:
    """``id``, ``th``, ``item``, ``matched``, ``n_tokens``: what of which document holds which class."""
    items = settle(_items(benchmark, item_col, item_text_col)[0])
    rows = window_rows(items, "wording", "t", list(range(1, window + 1)), None).drop("th").join(
        items.select("template", "wording", "n_tokens"), F.col("id") == F.col("wording"))
    rows = rows.filter(F.col("size") == F.least(F.lit(window), F.col("n_tokens"))).select(
        "template", F.when(F.col("way") == _EXACT, F.col("wording")).alias("wording"), F.col("pos").alias("b_pos"), F.col("size").alias("b_size"),
        F.col("h").alias("b_h"), F.size("slots").alias("n_slots"), F.col("slots.p").alias("b_at")).distinct()
    rows = settle(rows)
    used = sorted(r["b_size"] for r in rows.select("b_size").distinct().collect())
    distinct = rows.select("b_h").distinct()
    few = distinct.limit(broadcast_hashes + 1).collect()
    wanted = None
    if len(few) <= broadcast_hashes:
        wanted = np.sort(np.array([r[0] for r in few], dtype=np.int64).view(np.uint64))
    found = window_rows(docs, id_col, text_col, used or [window], wanted)
    joined = found.join(rows, (F.col("h") == F.col("b_h")) & (F.col("size") == F.col("b_size")))
    many = 2 * F.col("n_slots") > F.col("size")
    # a document's slots where the template has words have no place in it
    values = F.filter(F.arrays_zip(F.col("b_at").alias("p"), F.col("slots.v").alias("v")), lambda x: x["p"].isNotNull())
    # one row per alignment of a document on a template (no wording), and on a wording's verbatim windows
    aligned = settle(joined.groupBy("id", "th", "template", "wording", (F.col("pos") - F.col("b_pos")).alias("shift"), "size").agg(
        F.array_sort(F.collect_set("b_pos")).alias("at"),
        F.array_sort(F.collect_set(F.when(F.col("n_slots") == 0, F.col("b_pos")))).alias("plain"),
        F.array_sort(F.collect_set(F.when(many, F.col("b_pos")))).alias("many"),
        F.array_distinct(F.flatten(F.collect_set(F.when(F.col("wording").isNull(), values)))).alias("values")))
    enough = (F.col("r.covered") >= F.col("n_tokens") * coverage) | (F.col("r.longest") >= 2 * window)
    number = F.map_from_arrays(F.col("slots.p"), F.col("pattern"))
    pairs = F.transform("values", lambda x: F.struct(F.element_at(number, x["p"]).alias("b"), x["v"].alias("d")))

    by_template = aligned.filter(F.col("wording").isNull()).drop("wording")
    patterns = items.select("template", "item", "n_tokens", F.col("slots.p").alias("p"), "pattern").distinct()
    as_template = by_template.join(patterns, "template").withColumn("r", _covered(F.col("at"), F.col("size"))).filter(enough)
    as_template = as_template.withColumn("slots", F.arrays_zip("p")).withColumn("pairs", F.array_distinct(pairs)).filter(_one_to_one(F.col("pairs")))

    under = by_template.select(F.col("id").alias("t_id"), F.col("th").alias("t_th"), F.col("template").alias("t_template"), F.col("shift").alias("t_shift"), F.col("size").alias("t_size"),
                               F.col("at").alias("t_at"), F.col("plain").alias("t_plain"), F.col("values").alias("t_values"))
    by_wording = aligned.filter(F.col("wording").isNotNull()).drop("plain", "values").join(
        items.select(F.col("template").alias("i_template"), F.col("wording").alias("i_wording"), "item", "n_tokens", "slots", "pattern"),
        (F.col("template") == F.col("i_template")) & (F.col("wording") == F.col("i_wording")))
    none = F.array().cast("array<int>")
    by_wording = by_wording.join(
        under, F.col("id").eqNullSafe(F.col("t_id")) & (F.col("th") == F.col("t_th")) & (F.col("template") == F.col("t_template")) & (F.col("shift") == F.col("t_shift")) & (F.col("size") == F.col("t_size")), "left"
    ).withColumn("values", F.coalesce("t_values", F.array().cast("array<struct<p:int,v:string>>")))
    verbatim = by_wording.withColumn("r", _covered(F.array_sort(F.array_union("at", F.coalesce("t_plain", none))), F.col("size"))).filter(enough)
    inside = F.filter("slots", lambda x: F.exists("many", lambda b: (b <= x["p"]) & (x["p"] < b + F.col("size"))))
    own = F.transform(inside, lambda x: F.struct(F.element_at(number, x["p"]).alias("b"), x["v"].alias("d")))
    mixed = by_wording.filter(F.size("many") > 0).withColumn(
        "r", _covered(F.array_sort(F.array_union("many", F.coalesce("t_at", none))), F.col("size"))).filter(enough)
    mixed = mixed.withColumn("pairs", F.array_union(pairs, own)).filter(_one_to_one(F.col("pairs")))
    parts = [x.select("id", "th", "item", F.col("r.covered").alias("matched"), "n_tokens") for x in (as_template, verbatim, mixed)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def drop_leaking(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` (all columns) that hold no benchmark item.

    Only rows of a leaking id and text go, so other texts of the same id, or
    without an id, stay; null and empty texts stay; repeated rows go or stay
    together. The list of leaking rows is sent to the texts while it is small;
    beyond that they meet by hash.
    """
    found = _leaking(docs, benchmark, id_col, text_col, "item_id", "text", WINDOW, COVERAGE, BROADCAST_HASHES)
    bad = small(found.select(F.col("id").alias("__leaking_id"), F.col("th").alias("__leaking_th")).distinct())
    same = (F.xxhash64(F.col(text_col).cast("string")) == F.col("__leaking_th")) & F.col(id_col).cast("long").eqNullSafe(F.col("__leaking_id"))
    return docs.join(bad, same, "left_anti")
