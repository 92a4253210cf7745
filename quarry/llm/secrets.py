"""Secret scan with multipart credential linking.

Certain findings, always reported (leftmost, non-overlapping, per kind):
  assign  a password, secret, token or API key name, an assignment and a value of 6 characters or more
  access  an access key identifier of 20 characters or more
  hex     a run of 24 or more lower-case hexadecimal digits

Weak candidates say little alone: an identifier (a user, client, account or key id assignment), a
secret (a value under a weak name such as pwd, key or auth, or a mixed token of 20 characters or
more) and an endpoint (a URL, a host:port, a bucket or host assignment).  Names may have a prefix that
ends with an underscore, a hyphen or a change to upper case (DB_USER, dbUser; not PGUSER or monkey);
spans begin at the name, as those of certain findings do.

Parts are linked by an interval join within scopes (stretches of text between blank lines): each
part, widened by ``reach`` code points on both sides, meets the parts beside it.  A weak candidate is
reported only if it meets a complementary part: a secret an identifier or endpoint, and an
identifier or endpoint a secret.  Parts that overlap say the same thing and do not complement each
other.  Certain findings are parts too: access is an identifier, assign a secret, and hex a secret for
identifiers only, as digests beside addresses are common in plain text.

Defined results: null text counts as empty; empty texts have no findings; findings of equal start
come in the order of KINDS; repeated rows get equal results; an empty table gives an empty result.
Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quarry.plans.columns import fresh, map_in_arrow, named
from quarry.plans.scratch import ship

KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
CERTAIN = KINDS[:3]
_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # a maximal run, so shorter matches drop out
_HEX = re.compile(r"[0-9a-f]{24,}")
#: A weak name begins a word, follows an underscore (DB_USER) or is a capitalised part of one (dbUser).
_BEGIN = r"(?:(?<![A-Za-z0-9])|(?-i:(?<=[a-z0-9])(?=[A-Z])))"
_IDENTIFIER = re.compile(
    _BEGIN
    + r"""(?:user(?:name)?|login|client_?id|account(?:_?id)?|(?<!secret)(?<!secret_)access_?key|access_?key_?id|key_?id|tenant(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}""",
    re.I | re.A,
)
_WEAK_SECRET = re.compile(
    _BEGIN
    + r"""(?:pwd|pass|auth|credential|private_?key|secret_?access_?key|(?<!access)(?<!access_)key|sig(?:nature)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}""",
    re.I | re.A,
)
_MIXED = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
_ENDPOINT = re.compile(
    r"""(?<![A-Za-z0-9])(?:[a-z][a-z0-9+.-]{1,15}://[^\s"'<>]+|(?:\d{1,3}\.){3}\d{1,3}:\d{2,5})|"""
    + _BEGIN
    + r"""(?:host|endpoint|server|bucket|url)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._:/-]{3,}""",
    re.I | re.A,
)
_SCOPE = re.compile(r"\n[ \t\r]*\n")
#: What complements what.
_MEETS = {"identifier": ("secret", "assign", "hex"), "endpoint": ("secret", "assign"), "secret": ("identifier", "access", "endpoint")}


def _certain(text: str) -> list[tuple[str, int, int]]:
    found = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return found


def _mixed(token: str) -> bool:
    return any(c.isdigit() for c in token) and any(c.islower() for c in token) and any(c.isupper() for c in token)


def _weak(text: str) -> list[tuple[str, int, int]]:
    found = [("identifier", *m.span()) for m in _IDENTIFIER.finditer(text)]
    found += [("secret", *m.span()) for m in _WEAK_SECRET.finditer(text)]
    found += [("secret", *m.span()) for m in _MIXED.finditer(text) if _mixed(m.group())]
    found += [("endpoint", *m.span()) for m in _ENDPOINT.finditer(text)]
    return found


def _linked(weak: list[tuple[str, int, int]], certain: list[tuple[str, int, int]], cuts: list[int], reach: int) -> list[tuple[str, int, int]]:
    """The weak candidates with a complementary part beside them; the join is by sorted ends, in n log n."""
    starts: dict[tuple[str, int], list[int]] = {}
    ends: dict[tuple[str, int], list[int]] = {}
    for kind, a, b in [*certain, *weak]:
        scope = bisect_right(cuts, a)
        starts.setdefault((kind, scope), []).append(a)
        ends.setdefault((kind, scope), []).append(b)
    for side in (starts, ends):
        for places in side.values():
            places.sort()

    def meets(kind: str, scope: int, a: int, b: int) -> bool:
        after, before = starts.get((kind, scope), ()), ends.get((kind, scope), ())
        i, j = bisect_left(after, b), bisect_right(before, a)
        return i < len(after) and after[i] - b <= reach or j > 0 and a - before[j - 1] <= reach

    return [p for p in weak if any(meets(k, bisect_right(cuts, p[1]), p[1], p[2]) for k in _MEETS[p[0]])]


def _apart(parts: list[tuple[str, int, int]], taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The parts that overlap none of the taken ones."""
    solid: list[list[int]] = []
    for _, a, b in sorted(taken, key=lambda p: p[1]):
        if solid and a <= solid[-1][1]:
            solid[-1][1] = max(solid[-1][1], b)
        else:
            solid.append([a, b])
    begin = [a for a, _ in solid]
    before = [bisect_left(begin, b) - 1 for _, _, b in parts]  # the last one that begins before a part ends
    return [p for p, k in zip(parts, before) if k < 0 or solid[k][1] <= p[1]]


def scan(text: str | None, reach: int = 160) -> tuple[list, list]:
    """(certain findings, all findings) as (kind, start, end), by start and then kind."""
    text = text or ""
    order = lambda p: (p[1], KINDS.index(p[0]), p[2])
    certain = sorted(_certain(text), key=order)
    weak = _weak(text) if (":" in text or "=" in text or certain) else []
    if not weak:
        return certain, certain
    cuts = [m.start() for m in _SCOPE.finditer(text)]
    extra = set(_apart(_linked(weak, certain, cuts, reach), certain))
    return certain, sorted([*certain, *extra], key=order)


def find_secrets(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, reach: int = 160) -> DataFrame:
    """docs' columns in ``keep`` (all, if None) with ``certain`` and ``findings``: arrays of (kind, start, end)."""
    ship(docs.sparkSession)
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("certain", "findings")]
    source = fresh("_text", names)
    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    schema = T.StructType([*[docs.schema[c] for c in names], T.StructField("certain", span), T.StructField("findings", span)])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for batch in batches:
            got = [scan(t, reach) for t in batch.column(source).to_pylist()]
            cols = [pa.array([[dict(zip(("kind", "start", "end"), p)) for p in g[i]] for g in got], arrow) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *cols], names=schema.names)

    return map_in_arrow(docs.select(*[named(docs, c) for c in names], named(docs, text_col).alias(source)), run, schema)
