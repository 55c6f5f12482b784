"""Each operator against a brute-force version or held-out accuracy."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestead.llm import decontaminate, embeddings, linededup, lm, mixing, pii, quality, simhash, tokens, toxicity
from lodestead.llm.common import components

SYLLABLES = "ba de fi go lu ma ne pi ro su ta ve wi zo ka".split()


def _text(rnd, n):
    out = ["".join(rnd.choice(SYLLABLES) for _ in range(rnd.randint(1, 3))) for _ in range(n)]
    for i in range(7, n, 9):
        out[i] += "."
    return " ".join(out)


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(5)
    rows = [(i, _text(rnd, rnd.randint(3, 120))) for i in range(300)]
    for i in range(300, 360):
        words = rows[i - 300][1].split()
        if i % 3:
            words[rnd.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words)))
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame([(i, t, f"s{i % 5}" if i % 7 else None) for i, t in corpus], "doc_id bigint, text string, source string").repartition(5).cache()


def _lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def _components(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_components(spark):
    rnd = random.Random(1)
    pairs = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(140)] + [(i, i + 1) for i in range(100, 180)] + [(5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "u bigint, v bigint")).collect()}
    want = _components(200, pairs)
    assert all(got.get(i, i) == want[i] for i in range(200))


def test_simhash(docs, corpus):
    def fingerprint(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", _lower(t))
        grams = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0

    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_groups(docs).collect()}
    fp = [fingerprint(t) for _, t in corpus]
    pairs = [(a, b) for a in range(len(fp)) for b in range(a) if (fp[a] ^ fp[b]).bit_count() <= 2]
    want = _components(len(fp), pairs)
    assert got == {i: (f"{fp[i]:016x}", want[i]) for i in range(len(fp))}


def test_grid_finds_every_pair(spark):
    rnd = random.Random(3)
    base = [rnd.getrandbits(64) for _ in range(40)]
    some = {b ^ sum(1 << k for k in rnd.sample(range(64), rnd.randint(0, 3))) for b in base for _ in range(6)} | {0, (1 << 64) - 1, 1, 3}
    signed = [x - (1 << 64) if x >> 63 else x for x in some]
    got = {(r.u, r.v) for r in simhash.grid_links(spark.createDataFrame([(x,) for x in signed], "fp bigint")).collect()}
    mask = (1 << 64) - 1
    want = {(min(a, b), max(a, b)) for a in signed for b in signed if a != b and ((a ^ b) & mask).bit_count() <= 2}
    assert got == want


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((1500, 24))
    x[1000:1400] = x[:400] + 0.18 * rng.standard_normal((400, 24))
    x[1400:] = x[7] + 0.05 * rng.standard_normal((100, 24))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_groups(frame, cell=100, tile=64, tile_right=90).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = np.argwhere(np.triu(u @ u.T >= 0.95, 1))
    degree = np.bincount(near.ravel(), minlength=len(x))
    found = sum(n for n, _ in got.values())
    assert found >= 0.99 * degree.sum() and all(got[i][0] <= degree[i] for i in got)
    want = _components(len(x), near.tolist())
    assert np.mean([got[i][1] == want[i] for i in got]) > 0.99


def test_planted_neighbours_are_found(spark):
    rng = np.random.default_rng(11)
    n, dim = 20_000, 32
    x = rng.standard_normal((n, dim)).astype(np.float32)
    x[15_000:18_000] = x[:3_000] + 0.2 * rng.standard_normal((3_000, dim)).astype(np.float32)
    x[18_000:19_000] = x[5] + 0.1 * rng.standard_normal((1_000, dim)).astype(np.float32)
    x[19_000:] = x[6]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_groups(frame).collect()}
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    degree, pairs = np.zeros(n, dtype=np.int64), []
    for a in range(0, n, 2_000):
        i, j = np.nonzero(u[a:a + 2_000] @ u.T >= 0.95)
        i += a
        degree += np.bincount(i[i != j], minlength=n)
        pairs.append(np.stack([i, j], axis=1)[(i < j) & (i < 19_000)])
    assert degree.sum() > 500_000 and all(got[k][0] <= degree[k] for k in got)
    assert sum(c for c, _ in got.values()) >= 0.99 * degree.sum()
    want = _components(n, [*np.concatenate(pairs).tolist(), *[(k, k + 1) for k in range(19_000, n - 1)]])
    assert np.mean([got[k][1] == want[k] for k in got]) > 0.99


def test_tokens_equal_the_library():
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    t = tokens.load_tokenizer(path)
    rnd = random.Random(0)
    odd = ["", "a" * 3000, "  x  y " * 300, " " * 2000, "\n\n\n a" * 400, "<|endoftext|>" * 200, "don't we'll " * 200, "日本語 テキスト " * 100, "a b " * 90]
    odd += ["".join(rnd.choice(["a", "b", " ", "  ", "\n", "1", "!", "é", "'s", "<|endoftext|>", "日"]) for _ in range(900)) for _ in range(60)]
    whole = [len(t.encode(x, add_special_tokens=False)) for x in odd]
    assert tokens.count_batch(odd, t).tolist() == whole
    for chunk, overlap in ((64, 16), (200, 8)):
        assert [tokens.count_spliced(t, x, chunk, overlap) for x in odd] == whole


def _model_reference(corpus, order):
    """Scores by dictionaries of counts and the recursion of the smoothing, text by text."""
    seq = {i: re.findall(r"[^\x20\x09-\x0D]+", _lower(t)) + [None] for i, t in corpus}
    train = {i for i in seq if zlib.crc32(str(i).encode()) % 7 != 2}
    count = Counter()
    for i in train:
        x = ["<s>", *seq[i]]
        count.update(tuple(x[a:a + n]) for n in range(1, order + 1) for a in range(len(x) - n + 1))
    n, v = sum(len(seq[i]) for i in train), len({k for k in count if len(k) == 1 and k != ("<s>",)})

    def p(h, w):
        if not h:
            return (count[w,] + 1) / (n + v + 1)
        c = count[h]
        if c < (1 if len(h) == 1 else lm.LEAST_HISTORY):
            return p(h[1:], w)
        m = c ** lm.HEAPS
        return (count[(*h, w)] + m * p(h[1:], w)) / (c + m)

    out = {}
    for i, words in seq.items():
        x = ["<s>", *words]
        base = sum(math.log10(p((), w)) for w in words)
        score = sum(math.log10(p(tuple(x[max(0, k - order + 1):k]), x[k])) for k in range(1, len(x)))
        out[i] = (base, score, (len(words), sum(count[w,] > 0 for w in words), n, i not in train))
    return out


@pytest.mark.parametrize("order, batches", [(3, 7), (2, 3), (4, 1), (3, 40)])
def test_language_model(spark, docs, corpus, order, batches):
    want = _model_reference(corpus, order)
    rows = lm.score(docs, order=order, least_batches=batches).collect()
    assert len(rows) == len(corpus)
    for r in rows:
        base, score, rest = want[r.doc_id]
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-9)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == rest


def test_language_model_reads_crowds_once(spark, corpus):
    rows = [*corpus[:40], *[corpus[3]] * 30, *[(None, "")] * 5, *[(None, corpus[5][1])] * 30]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    columns = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    few, many = ([tuple(round(x, 6) if isinstance(x, float) else str(x) for x in r) for r in lm.score(frame, least_batches=5, batch_chars=c).select(columns).collect()]
                 for c in (1 << 24, 4000))
    assert len(few) == len(rows) and sorted(map(str, few)) == sorted(map(str, many))


def test_segments_carry_the_state(corpus):
    texts = pa.array([t for _, t in corpus])
    tokens, begin = lm.digests(texts)
    counts = []
    for n in (1, 2, 3):
        part = list(lm.levels(tokens, begin, counts, n))[-1]
        counts.append(np.bincount(part.which, minlength=len(part.distinct)))
    auto = lm.Automaton(tokens, begin, list(lm.levels(tokens, begin, counts, 3)), counts, len(tokens), len(counts[0]), lm.HEAPS)
    whole = auto.read(begin, 3, segment=1 << 30)
    for size in (2, 3, 10, 64):
        assert auto.read(begin, 3, segment=size) == pytest.approx(whole, rel=1e-12)
    # every state's probabilities sum to one, those of unknown words included
    n_words = auto.n_words
    for s in [0, auto.start, *range(1, len(auto.failure), 97)]:
        _, weight = auto.step(np.full(n_words, s), np.arange(n_words))
        unknown, at = 0.0, s
        while at:
            unknown, at = unknown + auto.failure_weight[at], auto.failure[at]
        total = (10.0**weight).sum() + 10.0**unknown / (len(tokens) + n_words + 1)
        assert total == pytest.approx(1.0, abs=1e-9)


def test_mixing_targets_and_quotas(docs, corpus):
    rows = mixing.mix(docs, block=16).withColumnRenamed("doc_id", "i").collect()
    assert rows == mixing.mix(docs, block=16).withColumnRenamed("doc_id", "i").collect() or sorted(rows) == sorted(mixing.mix(docs, block=16).collect())
    source = {i: (f"s{i % 5}" if i % 7 else None) for i, _ in corpus}
    size = {i: len(t.split()) for i, t in corpus}
    total = Counter()
    for i in size:
        total[source[i]] += size[i]
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, capped, left, open_ = {}, set(), float(sum(total.values())), set(order)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * total[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * total[s]
            left -= target[s]
        open_ -= over
    taken = Counter()
    for r in rows:
        assert r.size == size[r.i] and r.source_size == total[source[r.i]] and r.taken <= 3 * r.size
        assert r.target == pytest.approx(target[source[r.i]])
        taken[source[r.i]] += r.taken
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] + 32 for s in order)


def test_apportionment(spark):
    rnd = random.Random(4)
    parties = [("p%02d" % k, float(rnd.randint(1, 1000) ** 2)) for k in range(30)]
    frame = spark.createDataFrame(parties, "name string, votes double")
    for seats in (0, 1, 29, 400):
        got = {r.name: r.seats for r in mixing.apportion(frame, "votes", F.lit(seats).cast("long"), [], ["name"], "seats").collect()}
        want = Counter()
        for _ in range(seats):
            want[max(parties, key=lambda p: (p[1] / (2 * want[p[0]] + 1), [-ord(c) for c in p[0]]))[0]] += 1
        assert got == {n: want[n] for n, _ in parties}


def test_line_dedup(spark, docs, corpus):
    rnd = random.Random(99)
    passage = ". ".join(_text(rnd, 9).replace(".", "") for _ in range(8)) + "."
    rows = corpus + [(1000, "Opening words come first in here. " + passage), (1001, passage + " And an end that nobody else has got.")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r for r in linededup.dedup_units(frame).collect()}
    seen, want = set(), {}
    for i, t in sorted(rows):
        want[i] = []
        for a, z, d in linededup.units(t):
            if d in seen:
                want[i].append((a, z))
            seen.add(d)
        joined = []
        for a, z in sorted(want[i]):
            if joined and a < joined[-1][1]:
                joined[-1] = (joined[-1][0], max(z, joined[-1][1]))
            else:
                joined.append((a, z))
        want[i] = joined
    assert {i: got[i].removed for i in got} == {i: ",".join(f"{a}:{z}" for a, z in s) for i, s in want.items()}
    assert got[1001].removed_chars > 0.9 * len(passage) and got[1000].removed == ""
    cut = {r.doc_id: r.text for r in linededup.remove_units(frame).collect()}
    for i, t in rows:
        keep, at = "", 0
        for a, z in want[i]:
            keep, at = keep + t[at:a], z
        assert cut[i] == keep + t[at:]


def test_line_dedup_behind_short_sentences(spark):
    rnd = random.Random(98)
    single, first, second = (_text(rnd, n).replace(".", "") + "." for n in (60, 20, 20))
    passage = f"{first} Mind it. {second} So be it."
    rows = [(1, f"Of. {single} Ends so."), (2, f"Read more. {single} Other end."), (3, f"Sten. {passage} Bye."), (4, f"Well now. {passage} Go."),
            (5, f"Our words come before and {passage} But these come after it all.")]
    got = {r.doc_id: r for r in linededup.dedup_units(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    pieces = {i: [t[int(a):int(z)] for a, z in (x.split(":") for x in got[i].removed.split(",") if x)] for i, t in rows}
    assert pieces[1] == pieces[3] == [] and pieces[2] == [single]
    assert pieces[4] == [first, "Mind it.", second, "So be it."]
    # its first sentence is part of another here
    assert pieces[5] == ["Mind it.", second, "So be it."]


def test_line_dedup_against_plain_sets(spark):
    rnd = random.Random(97)
    pool = [" ".join(_text(rnd, rnd.randint(5, 12)).replace(".", "").split()) + "." for _ in range(40)]
    rows = []
    for i in range(80):
        lines = [" ".join(rnd.choice(pool) if rnd.random() < 0.4 else _text(rnd, 7).replace(".", "") + "!" for _ in range(rnd.randint(1, 3))) for _ in range(rnd.randint(1, 4))]
        rows.append((i, "\n".join(lines + [pool[0]])))
    seen, want = set(), {}
    for i, t in rows:
        marks = [False] * len(t)
        at = 0
        for line in t.split("\n"):
            inner = [(m.start() + at, m.end() + at) for m in re.finditer(r"[^.!]+[.!]", line)]
            inner = [(a + (t[a] == " "), z) for a, z in inner]
            for a, z in [(at, at + len(line)), *inner] if len(inner) > 1 else inner:
                key = t[a:z].lower().strip(".!")
                if key in seen:
                    marks[a:z] = [True] * (z - a)
                seen.add(key)
            at += len(line) + 1
        want[i] = marks
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    for shares in (linededup.HOT_SHARES, 3):
        spans = {r.id: r.spans for r in linededup.repeated_units(frame, hot_shares=shares).collect()}
        for i, t in rows:
            marks = [False] * len(t)
            for a, z in spans.get(i, ()):
                marks[a:z] = [True] * (z - a)
            assert marks == want[i]


def test_line_dedup_of_one_id(spark):
    first, second = "These words come again in another text here.", "Nobody else has got this sentence at all."
    rows = [(None, first), (None, second), (1, first + "\nShort."), (2, second.upper() + " " + first), (2, "Yet another text of the same id stands here.")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    cut = sorted((str(r.doc_id), r.text) for r in linededup.remove_units(frame).collect())
    assert cut == sorted([("None", ""), ("None", ""), ("1", rows[2][1]), ("2", second.upper() + " "), ("2", rows[4][1])])


PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def _plain(t):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m.group())
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
            if (k == 1 and any(int(x) > 255 for x in m.group().split("."))) or (k == 2 and not (12 <= len(d) <= 19 and luhn)) or (k == 3 and not 9 <= len(d) <= 15):
                continue
            out.append((m.start(), m.end(), k))
    return sorted(out, key=lambda x: (x[0], x[2]))


def test_plain_identifiers():
    rnd = random.Random(2)
    for _ in range(4000):
        t = "".join(rnd.choice(["a", "b", "@", ".", "+", "1", "2", "-", " ", "(", "x_", "4111 1111 1111 1111", "10.2.3.4", "+1 555 123 4567"]) for _ in range(25))
        assert pii.find_all(t)[0] == _plain(t)


@pytest.mark.parametrize("text, kind, found", [
    ("mail john dot doe at example dot com now", "email", "john dot doe at example dot com"), ("x jane[at]mail.example.com", "email", "jane[at]mail.example.com"),
    ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"), ("card ４１１１ １１１１ １１１１ １１１１", "card", "４１１１ １１１１ １１１１ １１１１"),
    ("call +one five five five one two three four five six seven", "phone", "+one five five five one two three four five six seven"),
    ("x ann @ mail . example . com y", "email", "ann @ mail . example . com"), ("host 79[.]197[.]74[.]40 up", "ip", "79[.]197[.]74[.]40"),
    ("x ann.7&#64;mail3&#46;example.com y", "email", "ann.7&#64;mail3&#46;example.com"), ("ann dot 78 at mail3 dot example dot com", "email", "ann dot 78 at mail3 dot example dot com"),
    ("tel +1 (three one nine) five five five-five one three two", "phone", "+1 (three one nine) five five five-five one three two"),
    ("card 4111 1111 one one one one 1111 ok", "card", "4111 1111 one one one one 1111"),
    ("at one nine two dot one six eight dot one dot one", "ip", "one nine two dot one six eight dot one dot one"), ("é x​@​ex.org", "email", "x​@​ex.org")])
def test_disguises(text, kind, found):
    spans = pii.find_all(text)[1]
    assert [(pii.KINDS[k], text[a:z]) for a, z, k in spans] == [(kind, found)]
    assert pii.redact_text(text) == text.replace(found, f"[{kind.upper()}]")


@pytest.mark.parametrize("text", ["He was at home. Then we met at noon, dot by dot.", "one of two or three", "Look at that.com", "a 1l2 b", "",
    "He looked at example.org today", "Let us meet at python.org tomorrow", "We stayed at booking.com for a week", "she works at ibm.com now", "Look at this. At last."])
def test_clean_texts_stay(text):
    assert pii.find_all(text) == ([], [])
    assert pii.redact_text(text) == text


@pytest.mark.parametrize("text, found", [
    ("mail me: jane at example.org", "jane at example.org"), ("jane.doe at example.org wrote", "jane.doe at example.org"), ("so jane at example dot org wrote", "jane at example dot org"),
    ("x " + "a" * 170 + " at example.org, contact me", None), ("contact " + "a" * 170 + " at example.org.", "a" * 170 + " at example.org"),
    ("jane [at] " + "sub dot " * 60 + "example dot org end", "jane [at] " + "sub dot " * 60 + "example dot org"),
    ("e-mail " + "jane dot " * 60 + "doe at example dot org", "jane dot " * 60 + "doe at example dot org")])
def test_spoken_addresses(text, found):
    spans = [text[a:z] for a, z, _ in pii.find_all(text)[1]]
    assert spans == ([found] if found else [])


@pytest.mark.parametrize("text, whole, part", [
    ("x jоhn@example.com y", "jоhn@example.com", "hn@example.com"), ("x john․doe@ex.org y", "john․doe@ex.org", "doe@ex.org"),
    ("x ann@mail.exаmple.com y", "ann@mail.exаmple.com", "ann@mail.ex")])
def test_disguises_around_plain_parts(text, whole, part):
    plain, every = pii.find_all(text)
    assert [text[a:z] for a, z, _ in plain] == [part] and {text[a:z] for a, z, _ in every} == {whole, part}
    assert pii.redact_text(text) == "x [EMAIL] y"


def test_pii_rows(spark):
    t = "ann@ex.org 10.2.3.4"
    r = pii.find_pii(spark.createDataFrame([(1, t), (2, None)], "doc_id bigint, text string")).orderBy("doc_id").collect()
    assert r[0].spans == "email:0:10,ip:11:19" and r[0].base_sha256 == hashlib.sha256(r[0].spans.encode()).hexdigest() and (r[0].n_email, r[0].n_ip) == (1, 1)
    assert r[1].spans == "" and r[1].base_sha256 == hashlib.sha256(b"").hexdigest()


def test_decontamination(spark):
    item = "Alice bought 5 apples and 7 pears for 12 dollars at the market, then gave 5 apples to Bob before going home."
    same = "Zoe bought 3 apples and 9 pears for 20 dollars at the market, then gave 3 apples to Yan before going home."
    other = "Zoe bought 3 apples and 9 pears for 20 dollars at the market, then gave 4 apples to Yan before going home."
    rows = [(1, "Some words. " + item), (2, f"intro {same} outro"), (3, f"intro {other} outro"), (4, "nothing of the kind is to be found in this text at all, not even numbers")]
    bench = spark.createDataFrame([(7, item), (8, item.replace("12", "13"))], "item_id bigint, text string")
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    for hashes in (1 << 20, 0):
        got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(frame, bench, broadcast_hashes=hashes).collect()}
        assert {(1, 7), (2, 7)} <= got and not {d for d, _ in got} & {4}
    assert {r.doc_id for r in decontaminate.drop_leaking(frame, bench).collect()} >= {4}


def test_every_item_of_a_template_is_found(spark):
    item = "At the small market by the river Tom has {} apples and {} pears in a basket made of straw."
    names = "Alice Bob Carol David Emma Frank Grace Henry Ivan Jack James Jane"
    listed = "The list for today reads {} and that is all of it."
    other = " ".join(reversed(names.split()))
    bench = [(1, item.format(3, 3)), (2, item.format(3, 5)), (3, listed.format(names)), (4, listed.format(other))]
    mixed = "by the river Tom has 8 apples and 9 pears in a basket made of wood"
    held = item.format(4, 4).replace("apples and 4 pears", "apples and 6 plums")
    rows = [(1, "x " + item.format(3, 3)), (2, "x " + item.format(3, 5)), (3, "x " + item.format(7, 9)), (4, f"So the clerk said: {other}, then left."),
            (5, "x " + names), (6, mixed), (7, "x " + held)]
    bench, frame = spark.createDataFrame(bench, "item_id bigint, text string"), spark.createDataFrame(rows, "doc_id bigint, text string")
    for hashes in (1 << 20, 0):
        got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(frame, bench, broadcast_hashes=hashes).collect()}
        assert got >= {(1, 1), (2, 1), (3, 1), (4, 3), (5, 3), (6, 1)}
    # neither item has this pattern, but more than half of it is there word for word
    long = item.format(3, 5) + " He sold {} of them to Bob and then {} more of them to Carol later that day."
    bench = spark.createDataFrame([(1, long.format(2, 2)), (2, long.format(2, 4))], "item_id bigint, text string")
    frame = spark.createDataFrame([(1, long.format(2, 3).replace("3 more", "5 more")), (2, long.format(5, 3))], "doc_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(frame, bench).collect()} >= {(1, 1), (2, 1)}


def _leak_reference(text, items, window=8, coverage=0.5):
    """Items that a text holds, each by itself: all shifts, all windows."""
    def canon(t):
        raw = [w.strip(".,") for w in t.split()]
        return [("<n>" if w.isdigit() else w.lower(), w) for w in raw]

    doc, out = canon(text), set()
    for i, item in items:
        b = canon(item)
        size = min(window, len(b))
        for shift in range(-len(b), len(doc)):
            hit = [p for p in range(len(b) - size + 1) if 0 <= p + shift <= len(doc) - size and all(doc[p + shift + k][0] == b[p + k][0] for k in range(size))]
            same = [p for p in hit if all(doc[p + shift + k][1].lower() == b[p + k][1].lower() for k in range(size))]

            def enough(at, size=size, b=b):
                cover = {p + k for p in at for k in range(size)}
                run = best = 0
                for k in range(len(b)):
                    run = run + 1 if k in cover and (k - 1 in cover) else int(k in cover)
                    best = max(best, run)
                return len(cover) >= coverage * len(b) or any(all(p + j in at for j in range(window + 1)) for p in at)

            slots = {p + k for p in hit for k in range(size) if b[p + k][0] == "<n>"}
            pairs = {(b[k][1], doc[k + shift][1]) for k in slots}
            if hit and (enough(hit) and len(pairs) == len({x for x, _ in pairs}) == len({y for _, y in pairs}) or same and enough(same)):
                out.add(i)
    return out


def test_decontamination_against_all_windows(spark):
    rnd = random.Random(31)
    words = [w for w in {_text(rnd, 1) for _ in range(400)} if w.isalpha()]

    def template(n):
        out = [rnd.choice(words) for _ in range(n)]
        for k in range(4, n, 6):
            out[k] = "{}"
        return " ".join(out)

    items = []
    for _ in range(9):
        t = template(rnd.choice([6, 7, 12, 20, 30]))
        for _ in range(3):
            items.append((len(items) + 1, t.format(*[rnd.randint(2, 5) for _ in range(9)])))
    rows = []
    for d in range(160):
        t = items[rnd.randrange(len(items))][1].split()
        kind = d % 4
        if kind == 1:
            swap = dict(zip("2345", rnd.sample("6789", 4), strict=True))
            t = [swap.get(w, w) for w in t]
        elif kind == 2:
            t = [str(rnd.randint(2, 9)) if w.isdigit() else w for w in t]
        elif kind == 3:
            cut = rnd.randrange(len(t))
            t = t[cut:] if rnd.random() < 0.5 else t[:cut]
        around = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 12))) for _ in range(2)]
        rows.append((d % 120 if d % 9 else None, " ".join([around[0], *t, around[1]]).strip()))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    classes = {r.item_id: r.class_id for r in decontaminate.item_classes(bench).collect()}
    assert classes == {i: i - (i - 1) % 3 for i, _ in items}
    held = [{classes[i] for i in _leak_reference(t, items)} for _, t in rows]
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(frame, bench).collect()}
    assert got == {(i, c) for (i, _), found in zip(rows, held, strict=True) for c in found}
    assert 0.3 < np.mean([bool(h) for h in held]) < 0.95
    kept = sorted((str(r.doc_id), r.text) for r in decontaminate.drop_leaking(frame, bench).collect())
    assert kept == sorted((str(i), t) for (i, t), h in zip(rows, held, strict=True) if not h)


def test_short_items_are_whole_texts(spark):
    bench = spark.createDataFrame([(1, "What is 5?"), (2, "Spell cat")], "item_id bigint, text string")
    frame = spark.createDataFrame([(1, "what is 5"), (2, "what is 7"), (3, "Do spell cat"), (4, "SPELL  cat.")], "doc_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(frame, bench).collect()} == {(1, 1), (4, 2)}


def _junk(rnd, t):
    kind = rnd.randrange(4)
    words = t.split()
    return (" ".join(w.upper() + "!!" for w in words), " | ".join(words), " ".join(w + rnd.choice(["###", "%%%", "$$$"]) for w in words),
            " ".join(w for w in words[:8] for _ in range(20)))[kind]


def test_quality(spark):
    rnd = random.Random(8)
    rows = []
    for i in range(600):
        t = "The " + _text(rnd, rnd.randint(30, 90)).replace(" ba", " of the").replace(" de", " and")
        rows.append((i, t if i % 6 else _junk(rnd, t)))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    model, scorer = quality.fit(frame, sample=300)
    got = {r.doc_id: r.accepted for r in quality.score(frame, scorer).collect()}
    assert sum(got[i] for i in range(600) if i % 6) >= 498 and sum(got[i] for i in range(0, 600, 6)) <= 2
    assert 0.7 < model.prior < 0.95
    assert {r.doc_id for r in quality.keep_accepted(frame, scorer).collect()} == {i for i, a in got.items() if a}


def test_votes_are_estimated():
    good, bad = "+" * 11, "-" * 6 + "+" * 5
    m = quality.estimate({good: 900, bad: 100, "." * 11: 10})
    assert m.posterior[good] > 0.99 and m.posterior[bad] < 0.01 and 0.5 < m.posterior["." * 11] < 1


def test_estimation_document_by_document():
    rnd = random.Random(12)
    k = len(quality.LABELLERS)
    docs = []
    for _ in range(1500):
        good = rnd.random() < 0.8
        docs.append("".join("." if rnd.random() < 0.3 else "+-"[(rnd.random() < (0.05 if good else 0.6 + 0.03 * j))] for j in range(k)))
    model = quality.estimate(Counter(docs), rounds=60, false_alarm=1.0)
    q = [1 / (1 + math.exp(-max(-20, min(20, d.count("+") - 2.5 * d.count("-"))))) for d in docs]
    for _ in range(60):
        prior = (sum(q) + 1) / (len(docs) + 2)
        bad_vote = []
        for j in range(k):
            of = []
            for weight in ([1 - x for x in q], q):
                plus, minus = (0.5 + sum(w for w, d in zip(weight, docs, strict=True) if d[j] == c) for c in "+-")
                of.append(minus / (plus + minus))
            bad_vote.append(of)
        new = []
        for d in docs:
            odds = math.log(prior / (1 - prior))
            for c, (b, g) in zip(d, bad_vote, strict=True):
                odds += math.log(g / b) if c == "-" else math.log((1 - g) / (1 - b)) if c == "+" else 0.0
            new.append(1 / (1 + math.exp(-odds)))
        q = new
    assert max(abs(model.posterior[d] - x) for d, x in zip(docs, q, strict=True)) < 1e-6
    # what was drawn comes out: how often each labeller condemns bad texts
    assert all(abs(bad_vote[j][0] - (0.6 + 0.03 * j)) < 0.12 and bad_vote[j][1] < 0.1 for j in range(k))


def test_scorer_word_by_word(spark):
    rnd = random.Random(13)
    texts = [_text(rnd, rnd.randint(5, 40)) if i % 3 else " ".join(x.upper() + "!!" for x in _text(rnd, 20).split()) for i in range(90)]
    target = np.array([0.95 if i % 3 else 0.05 for i in range(90)])
    size = 1 << quality.BITS

    def dense(t):
        out, words = [0.0] * size, t.split()
        shape = [re.sub(r"\d+", "0", re.sub("[A-Z]+", "A", re.sub("[a-z]+", "a", w))) for w in words]
        for kind, values in (("1", shape), ("2", [f"{a} {b}" for a, b in zip(shape, shape[1:], strict=False)])):
            for v in values:
                out[xxhash.xxh3_64_intdigest((kind + v).encode()) % size] += 1 / len(words)
        out[xxhash.xxh3_64_intdigest(b"again") % size] += sum(a == b for a, b in zip(words, words[1:], strict=False)) / len(words)
        return np.sqrt(out)

    x = np.array([dense(t) for t in texts])
    scorer = quality.fit_scorer([quality.features(t) for t in texts], target, steps=3000)
    p = 1 / (1 + np.exp(-(x @ scorer.weights + scorer.bias)))
    weight = np.where(target >= 0.5, 0.5 / (target >= 0.5).sum(), 0.5 / (target < 0.5).sum())
    assert np.abs(x.T @ (weight * (p - target)) + 1e-4 * scorer.weights).max() < 1e-4
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.score for r in quality.score(frame, scorer).collect()}
    assert all(got[i] == pytest.approx(p[i], abs=1e-6) for i in got)


def test_own_kernel():
    for unit in ("idiot", "i-d-i-o-t", "banana", "abab"):
        codes = toxicity.codes_of([unit], len(unit) + 2)
        sums: Counter = Counter()
        for key, ok, weight in toxicity._sequences(codes):
            if ok[0]:
                sums[int(key[0])] += weight
        assert toxicity.self_kernel(codes)[0] == pytest.approx(sum(v * v for v in sums.values()))


def test_toxicity_held_out(spark):
    rnd = random.Random(6)
    insults = ["grumbolt", "snarfling", "twitwaddle", "blorkface"]
    rows, labels = [], []
    for i in range(900):
        words = _text(rnd, 40).split()
        bad = i % 4 == 0
        if bad:
            for _ in range(2):
                words.insert(rnd.randrange(len(words)), rnd.choice(insults))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    rows += [(2000, "ba de g-r-u-m-b-o-l-t fi"), (2001, "ba de snarffling fi go"), (2002, "b l o r k f a c e lu ma"), (2003, "ba de fi go lu"), (2004, "")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    told = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score(frame, toxicity.fit(frame, told)).collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert {i for i in got if got[i].held_out and i < 900} == set(held)
    assert np.mean([got[i].predicted == (i % 4 == 0) for i in held]) > 0.98
    assert [got[i].predicted for i in range(2000, 2005)] == [1, 1, 1, 0, 0]
    assert all(0 <= r.score <= 1 for r in got.values())


def test_decisions_are_kernel_values(spark):
    rnd = random.Random(16)
    bags, toxic = [], []
    for i in range(300):
        words = set(_text(rnd, 25).replace(".", "").split())
        bags.append(sorted(words | ({"grumbolt", "snarfling"} if i % 4 == 0 else set())))
        toxic.append(int(i % 4 == 0))
    model = toxicity.train(bags, toxic, landmarks=40)

    def profile(unit):
        marked, out = f"^{unit}$".replace("$", "^"), Counter()
        # marks are gaps
        for p in combinations([k for k, c in enumerate(marked) if c.isalpha() or k in (0, len(marked) - 1)], toxicity.ORDER):
            out["".join(marked[k] for k in p)] += toxicity.DECAY ** (p[-1] - p[0] + 1)
        return out

    def kernel(a, b):
        return sum(v * b[k] for k, v in a.items()) / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))

    marks = [(profile(u), w) for u, w in model.landmarks]
    units = ["grumbolt", "grumboltx", "gr-umbolt", "banana", "fide", "ab", *bags[0][:6]]
    want = [sum(w * kernel(profile(u), m) for m, w in marks) - model.bias for u in units]
    assert model.decide(units) == pytest.approx(want, abs=1e-8)
    worst = model.worst(np.array([0, 0, 0, 1]), np.array([0, 3, 0, 3]), model.decide(units), 3)
    assert worst[0, :2].tolist() == [want[0], max(want[3], toxicity.WEAK)] or worst[0, 0] == pytest.approx(want[0])
    assert worst[2, 0] == -model.bias and (worst[:, 2] == toxicity.WEAK).all()


def test_fit_without_labels(spark, docs):
    empty = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, empty)).count() == docs.count()


def test_unit_lists_cover_texts():
    text_no, unit_no, names = toxicity.unit_lists(pa.array(["Ab, cd!", None, "x" * 40]))
    assert {names[u] for t, u in zip(text_no, unit_no, strict=True) if t == 0} == {"ab", "cd"} and 1 not in text_no
