"""Personal data, also behind disguises, with spans in the source text.

Plain identifiers are found in the text as it is. Around signs of a disguise, a
chain of transducers rewrites the text and remembers for each character written
which source characters it came from: look-alike and wide characters to ASCII,
invisible ones to nothing, spelled digits to digits, spelled or bracketed "at"
and "dot" to their marks. The same detectors run over what was written, and
their spans are mapped back.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Characters looked at before and after a sign of disguise at first; more where something is found near the end of them.
_AROUND = 160

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

# Look-alikes of Latin letters, by code point, words that announce an address, and common last labels of domains.
LOOKALIKES = dict(zip(
    "АВЕЅІЈКМНОРСТУХаеѕіјорсухһԁԛԝⅼ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαικνορυ" "․‐‑‒–−＿",
    "ABESIJKMHOPCTYXaesijopcyxhdqwl" "ABEZHIKMNOPTYXaiknopu" ".-----_", strict=True))
CUES = ("e-mail", "email", "mail", "contact", "contacts", "write", "address", "reach", "send", "schreib", "schreibe", "schreiben", "kontakt", "correo", "courriel", "contacto", "contacter", "écrire", "écrivez", "escribe", "escriba")
#: Between such a word and the address.
CONNECTORS = ("me", "us", "him", "her", "them", "it", "this", "all", "is", "are", "to", "at", "via", "under", "on", "my", "our", "your", "their", "address", "e-mail", "email", "mail", "id",
              "an", "unter", "ist", "mir", "uns", "mich", "es", "à", "a", "al", "est", "moi", "nous", "sur", "directly", "please", "now")
#: The last of these words, directly before the address.
LEADING = ("at", "to", "is", "are", "via", "under", "an", "unter", "ist", "est", "es", "à", "a", "al", "sur", "address", "e-mail", "email", "id")
#: Such words that an address may follow without a connecting word, and words before them that make them nouns ("her mail server").
ASKING = ("e-mail", "email", "mail", "contact")
OWNERS = ("the", "a", "an", "this", "that", "my", "our", "your", "his", "her", "their", "its", "no", "any", "some", "first", "new")
#: Words before "at" in prose that aren't taken for the local part of an address; of verbs the regular forms are made.
_VERBS = """look work live stay arrive order book shop read start end stop point aim laugh smile stare shout publish list post visit join call happen stand play
    learn wait click gather register appear park walk talk listen""".split()
PROSE = frozenset("""
    i you he she it we they me us him her them this that these those who which what one ones others address addresses server person someone somebody anyone anybody everyone everybody
    nobody nothing something anything everything people folks friends customers users clients visitors readers students
    am is are was were be been being have has had do does did done not only even just still now then here there today tomorrow yesterday later soon again
    once twice often noon midnight dawn dusk night morning evening lunch dinner home school all least last first best and or but as
    met meeting meet find found see saw seen buy bought sell sold began held sat slept ate run ran made taught
    available online free sale good angry right left based signed up down out off over in on for with page site website blog story article file version code docs
    news product products prices jobs office hotel room tickets download""".split()) | frozenset(
    form for v in _VERBS for form in (v, v + "s", v.removesuffix("e") + "ed", v.removesuffix("e") + "ing"))
#: Last parts of file names.
FILE_ENDS = frozenset("txt md pdf exe js py zip gz tar html htm json csv xml doc docx xls xlsx ppt png jpg jpeg gif svg mp3 mp4 java cpp yml yaml sh iso dll jar css".split())
LAST_LABELS = frozenset("com org net edu gov mil int info biz name io co ai app dev me tv us uk de fr es it nl eu ca au in br jp ru pl se ch at be".split())
DIGIT_WORDS = {w: str(i) for i, w in enumerate("zero one two three four five six seven eight nine".split())} | {"oh": "0"}
# End of fixed values.

_INVISIBLE = frozenset("­​‌‍‎‏⁠⁡⁢⁣﻿")
_STRANGE = re.compile("[­Ͱ-ϿЀ-ԯ٠-٩۰-۹०-९​-‏‐-–․⁠-⁣"
                      "⁰-₟Ⅰ-ⅿ−①-⓿﻿﹐-﹫！-～\U0001d400-\U0001d7ff]")
_SPELLED = re.compile(r"\b(?:zero|one|two|three|four|five|six|seven|eight|nine)\b[\s.-]*\b(?:zero|oh|one|two|three|four|five|six|seven|eight|nine|dot|point|\d)", re.I)
_HINTS = ("dot", "@", " at ", "at)", "at]", "at}", "at>", "_at_", "-at-", "(a)", "[a]", "[.]", "(.)", "{.}", "&#", "&commat;", "&period;")
_MARKED = re.compile(r"&#(?:64|46|x40|x2e);|&commat;|&period;|[(\[{<]\s*(?:at|dot|a|d|@|\.)\s*[)\]}>]|[_-](?:at|dot)[_-]|\bat\b(?=\s+[A-Za-z0-9-]+(?:\.|\s+dot\b))|\bdot\b|\s@\s?\w|\w@\s", re.I)
_MIXED = re.compile(r"[0-9][OolI](?=[0-9])")
_AT = re.compile(r"&#(?:64|x40);|&commat;|\s*[(\[{<]\s*(?:at|a|@)\s*[)\]}>]\s*|[_-]at[_-]|\s+at\s+|\s*@\s*", re.I)
_LATER_AT = re.compile(_AT.pattern.replace(r"\s+at\s+", r"\s+at\s+(?!\S+\s+at\s+[A-Za-z0-9-]+\.[A-Za-z0-9])"), re.I)
_DOT = re.compile(r"&#(?:46|x2e);|&period;|\s+\.\s+|\s*[(\[{<]\s*(?:dot|d|\.)\s*[)\]}>]\s*|[_-]dot[_-]|\s+(?:dot|point)\s+", re.I)
_DIGITS = re.compile(r"\b(?:zero|oh|one|two|three|four|five|six|seven|eight|nine)\b", re.I)
_PLUS = re.compile(r"\bplus\s+(?=\d)", re.I)


def _luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(c), 10)) for c in even)) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            done = m.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def find_plain(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the plain identifiers, leftmost and non-overlapping for each kind."""
    out = []
    if "@" in text:
        out += [(a, z, 0) for a, z in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m.group().split(".")):
            out.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _NOT_DIGIT.sub("", m.group())
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                out.append((m.start(), m.end(), 3))
    return sorted(out)


@lru_cache(maxsize=1 << 16)
def _latin(c: str) -> str:
    if c < "\x80":
        return c
    if c in _INVISIBLE:
        return ""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    digit = unicodedata.decimal(c, None)
    if digit is not None:
        return str(digit)
    plain = unicodedata.normalize("NFKC", c)
    return plain if plain.isascii() and _STRANGE.match(c) else c


class _Tape:
    """Text with the source start and end of each of its characters."""

    def __init__(self, text: str, start: array, end: array):
        self.text, self.start, self.end = text, start, end

    def letters(self) -> _Tape:
        if self.text.isascii():
            return self
        text, start, end = [], array("q"), array("q")
        for i, c in enumerate(self.text):
            for x in _latin(c):
                text.append(x)
                start.append(self.start[i])
                end.append(self.end[i])
        return _Tape("".join(text), start, end)

    def rewrite(self, rule: re.Pattern, to) -> _Tape:
        """Each match of ``rule`` becomes ``to(match)`` (None: stays), which stands for the whole of it."""
        text, start, end, at = [], array("q"), array("q"), 0
        for m in rule.finditer(self.text):
            new = to(m)
            if new is None:
                continue
            text.append(self.text[at:m.start()])
            start += self.start[at:m.start()]
            end += self.end[at:m.start()]
            text.append(new)
            if new:
                start += array("q", [self.start[m.start()]]) * len(new)
                end += array("q", [self.end[m.end() - 1]]) * len(new)
            at = m.end()
        text.append(self.text[at:])
        return _Tape("".join(text), start + self.start[at:], end + self.end[at:])


_BETWEEN = re.compile(r"(?<=\d)[\s-]+(?=\d)")
_ADDRESS = re.compile(r"([A-Za-z0-9._%+-]+)(@)([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)")


def _normalised(text: str, at: int) -> Iterator[_Tape]:
    """What the transducers write for a stretch of source text that begins at ``at``."""
    plain = _Tape(text, array("q", range(at, at + len(text))), array("q", range(at + 1, at + len(text) + 1))).letters()
    yield plain
    if _MIXED.search(plain.text):
        yield plain.rewrite(re.compile(r"(?<=[0-9])[OolI](?=[0-9])"), lambda m: "0" if m.group() in "Oo" else "1")
    digits = plain.rewrite(_DIGITS, lambda m: DIGIT_WORDS[m.group().lower()])
    if digits.text != plain.text or _PLUS.search(plain.text):
        joined = digits.rewrite(_PLUS, lambda _: "+").rewrite(_DOT, lambda _: ".")
        yield joined.rewrite(_BETWEEN, lambda _: "")
    dots = plain.rewrite(_DOT, lambda _: ".")
    marked = dots.rewrite(_AT, lambda _: "@")
    if marked.text != plain.text:
        yield marked
        later = dots.rewrite(_LATER_AT, lambda _: "@")  # of "reach me at ann.lee at mail.example", the second
        if later.text != marked.text:
            yield later


def find_disguised(text: str, plain: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, kind number) in ``text`` of identifiers that only show after rewriting."""
    signs = [m.span() for m in _STRANGE.finditer(text)] if not text.isascii() else []
    low = text.lower()
    if any(w in low for w in DIGIT_WORDS if w != "oh"):
        signs += [m.span() for m in _SPELLED.finditer(text)]
    if any(x in low for x in _HINTS):
        signs += [m.span() for m in _MARKED.finditer(text)]
    signs += [m.span() for m in _MIXED.finditer(text)]
    if "plus" in low:
        signs += [m.span() for m in _PLUS.finditer(text)]
    if not signs:
        return []
    found: set[tuple[int, int, int]] = set()
    for a, z in _stretches(text, signs):
        while True:
            here = _found_in(text, a, z)
            # what begins or ends near the edge may go on beyond it
            wider_a = a and any(s < a + _AROUND // 2 for s, _, _ in here)
            wider_z = z < len(text) and any(e > z - _AROUND // 2 for _, e, _ in here)
            if not wider_a and not wider_z:
                break
            a, z = _whole_words(text, a - (z - a) * wider_a, z + (z - a) * wider_z)
        found |= here
    out: list[tuple[int, int, int]] = []
    for start, end, kind in sorted(found, key=lambda x: (x[2], x[0], -x[1])):
        clash = any(s <= start and end <= e and k == kind for s, e, k in plain) or any(start < e and s < end and k == kind for s, e, k in out)
        if not clash:
            out.append((start, end, kind))
    return out


def _whole_words(text: str, a: int, z: int) -> tuple[int, int]:
    """The stretch, grown to blanks on either side, so no word is cut however long it is."""
    a, z = max(0, a), min(len(text), z)
    while a and not text[a - 1].isspace():
        a -= 1
    while z < len(text) and not text[z].isspace():
        z += 1
    return a, z


def _stretches(text: str, signs: list[tuple[int, int]]) -> list[list[int]]:
    """The surroundings of the signs, joined where they meet."""
    out: list[list[int]] = []
    for a, z in sorted(signs):
        if out and z + _AROUND <= out[-1][1]:
            continue
        a, z = _whole_words(text, a - _AROUND, z + _AROUND)
        if out and a <= out[-1][1]:
            out[-1][1] = max(z, out[-1][1])
        else:
            out.append([a, z])
    return out


def _found_in(text: str, a: int, z: int) -> set[tuple[int, int, int]]:
    """Identifiers that rewriting the stretch from ``a`` to ``z`` shows and the text as it is doesn't."""
    found = set()
    for tape in _normalised(text[a:z], a):
        for s, e, kind in find_plain(tape.text):
            start, end = tape.start[s], tape.end[e - 1]
            written = tape.text[s:e]
            if text[start:end] == written:
                continue
            if kind == 0 and _spread(text[start:end]) and not _address_like(text, start, end, written):
                continue
            found.add((start, end, kind))
    return found


def _spread(source: str) -> bool:
    return any(c.isspace() for c in source) or bool(_DASHED.search(source))


_BRACKETED = re.compile(r"[(\[{<]\s*(?:at|a|@)\s*[)\]}>]", re.I)
_DASHED = re.compile(r"[_-]at[_-]", re.I)
_CUED = re.compile(rf"(?<!\w)(?:{'|'.join(CUES)})(?:[\s,;-]+(?:{'|'.join(CONNECTORS)}))*(?:\s*[:>(]|[\s,;-]+(?:{'|'.join(LEADING)})[\s:])[\s\"'(]*$", re.I)
_ASKED = re.compile(rf"(?:(?<!\w)(?:{'|'.join(OWNERS)})\s+)?(?<!\w)(?:{'|'.join(ASKING)})\s+$", re.I)
_JOINED_NAMES = re.compile(r"[A-Za-z][A-Za-z0-9]*[._+%](?:[A-Za-z0-9]+[._+%])*[A-Za-z0-9]+")
#: A cue and what connects it to an address are looked for in so many characters before it.
_CUE_WITHIN = 60


def _address_like(text: str, start: int, end: int, written: str) -> bool:
    """Whether an address with a spelled "at" or blanks in it is believed.

    A bracketed "at" is enough. Otherwise the last label must be a usual one.
    An "@" between blanks is then enough too. A bare "at" needs a local part
    that isn't a word of prose before "at", and a second sign: a spelled or
    spaced dot, names joined by a mark in the local part, or a word that
    announces an address before, with connecting words between ("write to", "my
    address is"); "mail" and "contact" need none, unless they are nouns. Prose ("we mail it at example.org", "version2 at example.org", "at
    10 at example.org") has none of them.
    """
    source = text[start:end]
    if _BRACKETED.search(source):
        return True
    local, _, domain = written.partition("@")
    if domain.rpartition(".")[2].lower() not in LAST_LABELS:
        return False
    if "@" in source:
        return True
    name = local.lower().strip("-_%+")
    if name in PROSE or local.endswith("."):
        return False
    if _DASHED.search(source):
        return not name.startswith("www.") and text[max(0, start - 1):start] != "/"
    if _DOT.search(source):
        return True
    if _JOINED_NAMES.fullmatch(local) and name.rpartition(".")[2] not in FILE_ENDS:
        return True
    long_enough = not name.isdigit() or len(name) > 4
    before = text[max(0, start - _CUE_WITHIN):start]
    asked = _ASKED.search(before)
    return long_enough and (bool(_CUED.search(before)) or bool(asked) and asked.group().lower().split()[0] in ASKING)


def find_all(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The plain spans, and all spans, by start and then kind."""
    text = text or ""
    plain = find_plain(text)
    plain.sort(key=lambda x: (x[0], x[2], x[1]))
    every = sorted(plain + find_disguised(text, plain), key=lambda x: (x[0], x[2], x[1]))
    return plain, every


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{z}" for a, z, k in spans)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_email``, ``n_ip``, ``n_card``, ``n_phone``, ``base_sha256``, ``spans`` of each row, without a shuffle.

    The numbers and ``spans`` are of all spans, plain and disguised; the digest
    is of the plain ones, which all stay. A disguised span is added beside them
    unless a plain one of its kind covers it.
    A text is read in stretches around the signs of a disguise, up to blanks on
    both sides; of a text without blanks the whole is one stretch, for which a
    task holds some 16 bytes a character in each of up to six tapes.
    Null and empty texts have none; null ids stay null; repeated rows are
    returned each; an empty table gives no rows.
    """
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            counts: list[list[int]] = [[], [], [], []]
            digest, spans = [], []
            for t in b.column(1).to_pylist():
                plain, every = find_all(t)
                for k in range(4):
                    counts[k].append(sum(x[2] == k for x in every))
                digest.append(hashlib.sha256(_written(plain).encode()).hexdigest())
                spans.append(_written(every))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(digest, pa.string()), pa.array(spans, pa.string())],
                ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(
        batches, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact_text(text: str | None) -> str | None:
    """The text with each span replaced by its kind in brackets; overlapping spans become one."""
    if not text:
        return text
    spans = find_all(text)[1]
    if not spans:
        return text
    out, at, i = [], 0, 0
    while i < len(spans):
        a, z, k = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < z:
            z = max(z, spans[i][1])
            i += 1
        out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = z
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` (all columns) with personal data replaced in the text; ``n_chars``, where there is one, follows.

    Null and empty texts stay; repeated rows stay repeated; memory is as for ``find_pii``.
    """
    names = docs.columns
    where = names.index(text_col)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            new = pa.array([redact_text(t) for t in b.column(where).to_pylist()], b.schema.field(where).type)
            yield b.set_column(where, b.schema.field(where), new)

    out = docs.mapInArrow(batches, docs.schema)
    if "n_chars" in names:
        size = F.coalesce(F.length(text_col), F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col(text_col).isNull(), F.col("n_chars")).otherwise(size)).select(names)
    return out
