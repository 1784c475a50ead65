"""Credentials in texts, and links between the parts of credentials that come in several pieces.

Strong findings stand alone. Weak candidates (long mixed-class strings, addresses of services) are
only reported where complementary parts meet: per text, intervals of reach around the parts of one
scope are joined to the parts they cover, by a sorted sweep. Texts never leave their task.
"""

import hashlib
import re
from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import map_rows

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs of 24 and more: what is left of [0-9a-f]+ once shorter ones are dropped
WEAK_SECRET = re.compile(r"[A-Za-z0-9/+_-]{32,}={0,2}")
ENDPOINT = re.compile(r"""[a-z][a-z0-9+.-]{1,15}://[^\s"'<>]{4,}""")
NAMED = re.compile(r"""(?:(?:client|app|application|account|tenant|user|access_?key)[_-]?(?:id|name)?|login)["']?\x20*[:=]"""
                   r"""\x20*["']?[A-Za-z0-9._@+-]{3,}""", re.I | re.A)
TEMPORARY = re.compile(r"(?:ASIA|AIDA|AROA)[A-Z0-9]{16,}")
SCOPE_END = re.compile(r"\n[ \t\r]*\n")
KINDS = ("assign", "access", "hex", "secret", "endpoint", "identifier")
MARK = "[REDACTED]"
REACH = 400

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def _near(kinds: list[list[Span]], span: Span, scopes: list[int], reach: int, apart: bool = False) -> bool:
    """Whether a part lies within `reach` of `span`, in its scope and, if `apart`, outside it. Spans of one kind are disjoint and in order."""
    scope = bisect_left(scopes, span[1])
    for parts in kinds:
        at = bisect_left(parts, span[1] - reach, key=lambda x: x[2])
        while at < len(parts) and parts[at][1] <= span[2] + reach:
            outside = not apart or parts[at][2] <= span[1] or parts[at][1] >= span[2]
            if outside and bisect_left(scopes, parts[at][1]) == scope:
                return True
            at += 1
    return False


def _mixed(value: str) -> bool:
    return any(c.isdigit() for c in value) and any(c.islower() for c in value) and any(c.isupper() for c in value)


def linked_spans(text: str, base: list[Span], reach: int = REACH) -> list[Span]:
    """Weak candidates beside the parts that complete them.

    A mixed-class string needs an identifier in reach (of an access key, client, account or user), an identifier
    that is no access key needs a secret (assigned, hexadecimal or a mixed-class string), an address needs a
    secret or identifier that is reported and not a part of the address. Scopes are paragraphs. A mixed-class string beside an
    address alone is not reported: names of files, commits and pages look alike, and neither part says that it is a credential.
    """
    names = [("identifier", m.start(), m.end()) for m in TEMPORARY.finditer(text)]
    if ":" in text or "=" in text:
        names = sorted(names + [("identifier", m.start(), m.end()) for m in NAMED.finditer(text)
                                if not _near([names], ("", m.start() + 1, m.end() - 1), [], 0)], key=lambda s: s[1])
    if not base and not names:
        return []  # every rule needs one of them
    assigned, access, hexes = ([s for s in base if s[0] == k] for k in KINDS[:3])
    names = [s for s in names if not _near([assigned, access, hexes], ("", s[1] + 1, s[2] - 1), [], 0)]
    scopes = [m.start() for m in SCOPE_END.finditer(text)]
    weak = [("secret", m.start(), m.end()) for m in WEAK_SECRET.finditer(text)
            if _mixed(m[0]) and not _near([assigned, access, hexes, names], ("", m.start() + 1, m.end() - 1), [], 0)]
    weak = [s for s in weak if _near([access, names], s, scopes, reach)]
    names = [s for s in names if _near([assigned, hexes, weak], s, scopes, reach)]
    strong = [assigned, access, hexes, weak, names]

    places = [("endpoint", m.start(), m.end()) for m in ENDPOINT.finditer(text)]
    return weak + names + [s for s in places if _near(strong, s, scopes, reach, apart=True)]


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in ordered(spans))


def redacted(text: str, spans: list[Span], mark: str = MARK) -> str:
    out, at = [], 0
    for _, start, end in sorted(spans, key=lambda s: s[1]):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, id: str = "doc_id", text: str = "text", reach: int = REACH) -> DataFrame:
    """Per row of `docs`: id, counts of strong kinds, `base` and `spans` as kind:start:end texts, and `clean_text`.

    Offsets are code points of the whole text. Null and empty texts have no spans; a null text stays
    null. Repeated rows are scanned one by one.
    """
    def work(columns):
        rows = []
        for key, value in zip(*columns):
            base = base_spans(value or "")
            spans = base + linked_spans(value or "", base, reach)
            counts = [sum(s[0] == k for s in base) for k in KINDS[:3]]
            rows.append((key, *counts, joined(base), joined(spans), redacted(value, spans) if spans else value))
        return list(map(list, zip(*rows)))

    kind = docs.schema[id].dataType.simpleString()
    named = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    return map_rows(named, ["doc_id", "text"], f"doc_id {kind}, n_assign long, n_access long, n_hex long, "
                    "base string, spans string, clean_text string", work)


def redact(docs: DataFrame, text: str = "text", reach: int = REACH) -> DataFrame:
    """`docs` with each span of `text` replaced by MARK; texts without spans are untouched. Memory: one Arrow batch of texts."""
    @F.pandas_udf("string")
    def clean(values):
        def one(value):
            base = base_spans(value or "")
            spans = base + linked_spans(value or "", base, reach)
            return redacted(value, spans) if spans else value
        return values.map(one, na_action="ignore")

    return docs.withColumn(text, clean(text))


def digest(base: str) -> str:
    return hashlib.sha256(base.encode()).hexdigest()
