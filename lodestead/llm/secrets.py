"""Secrets in texts: plain patterns, and weak candidates that the rest of a credential stands beside.

One pass finds the plain spans of each text, and its parts of credentials:
identifiers (access keys, users, clients), secrets (named ones, and bare strings
of many kinds of characters) and endpoints (addresses, hosts). A scope is a
paragraph. Parts of one scope are joined as intervals, by bins of ``REACH``
characters; a weak candidate is reported where what completes it lies within
``REACH``:

* a secret of a telling name (pass, secret, auth ...): an identifier or an endpoint,
* one that is only called a key: an identifier,
* a bare string: an access key, or both an identifier and an endpoint,
* an identifier: a plainly assigned or a named secret.

Only texts that hold a weak candidate and something to complete it reach the
join, each different text once, without its characters.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle, small

KINDS = ("assign", "access", "hex", "linked")
#: Characters between two parts of one credential, at most.
REACH = 400

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_PARAGRAPH = re.compile(r"\n[\x20\t\r]*\n")
_PAIR = re.compile(r"""(?<![A-Za-z0-9_.-])([A-Za-z][A-Za-z0-9_.-]{0,60})["']?(?:\x20*(?:=>|:=|[:=])\x20*|\x20is\x20)["']?([^\s"',;<>{}()\[\]|]+)""")
_URL = re.compile(r"""[A-Za-z][A-Za-z0-9+.-]{1,20}://(?:([^\s:/@"'<>]+):([^\s/@"'<>]+)@)?[^\s"'<>]+""")
_BARE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")

# What names of parts end in or hold, separators left out.
ID_NAMES = ("accesskeyid", "keyid", "accesskey", "clientid", "appid", "tenantid", "accountid", "accountname", "account", "username", "userid", "user", "login", "uid")
SECRET_NAMES = ("pass", "pwd", "secret", "token", "cred", "auth")
HOST_NAMES = ("host", "hostname", "endpoint", "server", "url", "uri", "dsn", "bucket", "domain")
# End of fixed values.
_SEPARATOR = re.compile(r"[_.-]")
_PART = "struct<role:string,grade:string,scope:int,start:bigint,end:bigint>"


def find_plain(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the plain patterns, by start and then kind."""
    out, low = [], text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        out += [(*m.span(), 0) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(*m.span(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(*m.span(), 2) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], x[2]))


def _secret_like(value: str) -> bool:
    """Whether a value can be a secret: six characters, and not a mere word or number."""
    kinds = (any(c.isdigit() for c in value), any(c.islower() for c in value), any(c.isupper() for c in value[1:]), not value.isalnum())
    return len(value) >= 6 and sum(kinds) >= 2


def _bare_like(value: str) -> bool:
    """Whether an unnamed string can be a secret: letters of both cases and digits, few of them alike."""
    return (any(c.isdigit() for c in value) and any(c.islower() for c in value) and any(c.isupper() for c in value)
            and len(set(value)) * 2 >= min(len(value), 40))


def _role(name: str) -> tuple[str, str] | None:
    bare = _SEPARATOR.sub("", name).lower()
    if bare.endswith(ID_NAMES) and not any(k in bare for k in SECRET_NAMES):
        return "id", "weak"
    if any(k in bare for k in SECRET_NAMES):
        return "secret", "named"
    if bare.endswith("key"):
        return "secret", "key"
    return ("endpoint", "weak") if bare.endswith(HOST_NAMES) else None


def find_parts(text: str, plain: list[tuple[int, int, int]]) -> list[dict]:
    """The parts of credentials in a text; none where no weak candidate has anything to complete it."""
    known = [(a, z, "secret" if k != 1 else "id", "strong") for a, z, k in plain]
    starts, ends = [x[0] for x in known], list(accumulate((x[1] for x in known), max))

    def covered(a: int, z: int) -> bool:
        i = bisect(starts, a)
        return i > 0 and ends[i - 1] >= z

    weak: list[tuple] = []
    for m in _URL.finditer(text):
        weak.append((*m.span(), "endpoint", "weak"))
        if m.group(2):
            weak += [(*m.span(1), "id", "weak"), (*m.span(2), "secret", "named")]
    for m in _PAIR.finditer(text):
        role, value = _role(m.group(1)), m.group(2).rstrip(".")
        a, z = m.start(2), m.start(2) + len(value)
        if role is None or covered(a, z) or "://" in value or (role[0] == "secret" and not _secret_like(value)) or len(value) < 2:
            continue
        weak.append((m.start(), z, *role))
    weak.sort()
    firsts, lasts = [x[0] for x in weak], list(accumulate((x[1] for x in weak), max))
    for m in _BARE.finditer(text):
        i = bisect(firsts, m.start())
        if _bare_like(m.group()) and not covered(*m.span()) and not (i and lasts[i - 1] > m.start()):
            weak.append((*m.span(), "secret", "bare"))
    every = sorted(known + weak)
    roles = {r for *_, r, _ in every}
    if not any(r != "endpoint" for *_, r, _ in weak) or len(roles) < 2:
        return []
    cuts = [m.start() for m in _PARAGRAPH.finditer(text)]
    return [{"role": r, "grade": g, "scope": bisect(cuts, a), "start": a, "end": z} for a, z, r, g in every]


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{z}" for a, z, k in spans)


def _scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        rows = []
        for t in b.column(1).to_pylist():
            text = t or ""
            plain = find_plain(text)
            parts = find_parts(text, plain)
            rows.append((hashlib.sha256(_written(plain).encode()).hexdigest(), [{"start": a, "kind": k, "end": z} for a, z, k in plain],
                         hashlib.sha256(text.encode("utf-8", "replace")).hexdigest() if parts else None, parts))
        digest, plain, key, parts = zip(*rows, strict=True) if rows else ([], [], [], [])
        part = pa.struct([("role", pa.string()), ("grade", pa.string()), ("scope", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
        span = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digest, pa.string()), pa.array(plain, pa.list_(span)), pa.array(key, pa.string()), pa.array(parts, pa.list_(part))],
                                         ["doc_id", "base_sha256", "plain", "key", "parts"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``base_sha256``, ``plain`` spans, and where there is something to link ``key`` (the text's digest) and ``parts``."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(
        _scan, f"doc_id long, base_sha256 string, plain array<struct<start:bigint,kind:int,end:bigint>>, key string, parts array<{_PART}>")


def link_parts(scanned: DataFrame, reach: int = REACH) -> DataFrame:
    """``key``, ``role``, ``grade``, ``start``, ``end`` of the weak candidates that other parts complete, with what they are completed by.

    An interval join within a scope: a candidate asks the bins that ``reach``
    lets it touch, every part lies in the bins that it covers.
    """
    texts = scanned.filter("key is not null").groupBy("key").agg(F.any_value("parts").alias("parts"))
    parts = settle(texts.select("key", F.explode("parts").alias("p")).select("key", "p.*"))

    def bins(first: Column, last: Column) -> Column:
        return F.explode(F.sequence(F.floor(first / reach), F.floor(last / reach)))

    asks = parts.filter("grade <> 'strong' and role <> 'endpoint'").withColumn("bin", bins(F.col("start") - reach, F.col("end") + reach))
    other = parts.select("key", "scope", F.col("role").alias("by"), F.col("grade").alias("by_grade"), F.col("start").alias("from"), F.col("end").alias("to")).withColumn(
        "bin", bins(F.col("from"), F.col("to")))
    met = asks.join(other, ["key", "scope", "bin"]).filter((F.col("role") != F.col("by")) & (F.greatest(F.col("start") - F.col("to"), F.col("from") - F.col("end")) <= reach))
    strong = F.col("by_grade") == "strong"
    told = met.groupBy("key", "role", "grade", "start", "end").agg(
        F.max((F.col("by") == "id") & strong).alias("access"), F.max(F.col("by") == "id").alias("id"), F.max(F.col("by") == "endpoint").alias("endpoint"),
        F.max((F.col("by") == "secret") & F.col("by_grade").isin("strong", "named")).alias("secret"))
    enough = (F.when(F.col("role") == "id", F.col("secret")).when(F.col("grade") == "named", F.col("id") | F.col("endpoint"))
              .when(F.col("grade") == "key", F.col("id")).otherwise(F.col("access") | (F.col("id") & F.col("endpoint"))))
    return told.filter(enough)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """``doc_id``, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256``, ``spans``, ``n_linked`` of each row.

    The first three numbers and the digest are of the plain spans, which all
    stay; linked candidates come beside them as spans of kind ``linked``.
    Null and empty texts have none; null ids stay null; repeated rows are
    returned each, equal texts alike; texts of any length are read whole; an
    empty table gives no rows; further columns aren't read.
    """
    scanned = settle(scan(docs, id_col, text_col))
    linked = link_parts(scanned, reach).groupBy("key").agg(F.collect_set(F.struct("start", F.lit(KINDS.index("linked")).alias("kind"), "end")).alias("linked"))
    x = scanned.drop("parts").join(small(linked), "key", "left")
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    names = F.array(*map(F.lit, KINDS))
    x = x.withColumn("every", F.array_sort(F.concat("plain", F.coalesce("linked", none))))

    def of(kind: int) -> Column:
        return F.size(F.filter("every", lambda s: s["kind"] == kind)).cast("long")

    count = [of(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    spans = F.array_join(F.transform("every", lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    return x.select("doc_id", *count[:3], "base_sha256", spans.alias("spans"), count[3])
