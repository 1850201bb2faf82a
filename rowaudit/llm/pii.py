"""Personal data in texts: an Aho-Corasick automaton finds anchors, small parsers expand and validate what lies around them."""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words

#: Kinds in the order of every listing: the four base kinds, then what the cues add.
BASE = ("email", "ip", "card", "phone")
ADDED = ("url", "masked_email", "iban", "account", "ipv6")
KINDS = BASE + ADDED
#: Words that announce an identifier (fixed values), in lower case; A-Z in texts match as well.
ACCOUNT_CUES = ("account", "acct", "routing", "ssn", "passport", "konto", "cuenta", "compte", "tax id", "member id")
AT_CUES = ("(at)", "[at]", "{at}")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_URL_REST = re.compile(r"[^\s<>\"'`|\\^{}\[\]]+")
_MASKED_HOST = re.compile(r"\s?([A-Za-z0-9-]+)((?:\s?(?:\.|\((?i:dot)\)|\[(?i:dot)\]|\{(?i:dot)\})\s?[A-Za-z0-9-]+)+)")
_IBAN = re.compile(r"[A-Za-z]{2}[0-9]{2}(?: ?[A-Za-z0-9]{2,4}){3,8}")
_NUMBER = re.compile(r"(?:\s?(?:number|no\.?|nr\.?|#|:|=|is))*\s?([A-Za-z]{0,2}[0-9](?:[ -]?[0-9]){5,19})(?![0-9A-Za-z])", re.I)
_IPV6 = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_SCHEME = _LETTERS | frozenset("0123456789+.-")
_LOCAL = _LETTERS | frozenset("0123456789._%+-")


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    cues = {"@": "@", "+": "+", "://": "/"} | {c: "0" for c in "0123456789"} | {c: "a" for c in AT_CUES}
    cues |= {c: kind for kind, names in (("i", ("iban",)), ("n", ACCOUNT_CUES)) for c in names}
    for cue, kind in cues.items():
        found.add_word(cue, (kind, len(cue)))
    found.make_automaton()
    return found


_ANCHORS: list[ahocorasick.Automaton] = []


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k & 1:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _lowered(text: str) -> str:
    """A-Z in lower case and nothing else, so places stay the same."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def _run_start(text: str, at: int, least: int, of: frozenset[str]) -> int:
    while at > least and text[at - 1] in of:
        at -= 1
    return at


def _iban_ok(s: str) -> bool:
    s = s.replace(" ", "").upper()
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def find(text: str) -> list[tuple[str, int, int]]:
    """Spans ``(kind, start, end)`` in code points, end exclusive, by kind as in ``KINDS``, then start.

    Base kinds are exactly the leftmost matches that don't overlap, of their patterns, that pass their checks; a match
    that fails is dropped and the search goes on behind it. Added kinds: URLs, addresses masked as ``name (at) host``,
    IBANs (checked modulo 97) and numbers that a cue announces, and IPv6 addresses."""
    if not _ANCHORS:
        _ANCHORS.append(_automaton())
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    behind = dict.fromkeys(KINDS, 0)
    last_digit = -2

    def expand(kind: str, pattern: re.Pattern, at: int, ok) -> None:
        if at >= behind[kind] and (m := pattern.match(text, at)):
            behind[kind] = m.end()
            if ok(m):
                found[kind].append((at, m.end()))

    for end, (cue, size) in _ANCHORS[0].iter(_lowered(text)):
        start = end - size + 1
        if cue == "0":
            if start != last_digit + 1:  # the first digit of a run
                expand("ip", _IP, start, lambda m: all(len(p) <= 3 or not p[:-3].strip("0") for p in m[0].split(".")) and all(int(p[-3:]) <= 255 for p in m[0].split(".")))
                expand("card", _CARD, start, lambda m: 16 <= len(d := _digits(m[0])) <= 19 and _luhn(d))
            last_digit = start
        elif cue == "@":
            first = _run_start(text, start, behind["email"], _LOCAL)
            if first < start and (m := _DOMAIN.match(text, start + 1)):
                found["email"].append((first, m.end()))
                behind["email"] = m.end()
        elif cue == "+":
            expand("phone", _PHONE, start, lambda m: 8 <= len(_digits(m[0])) <= 15)
        elif cue == "/":
            first = _run_start(text, start, behind["url"], _SCHEME)
            while first < start and text[first] not in _LETTERS:
                first += 1
            rest = _URL_REST.match(text, end + 1)
            if first < start and rest:
                stop = rest.end()
                while stop > rest.start() + 1 and text[stop - 1] in ".,;:!?)":
                    stop -= 1
                found["url"].append((first, stop))
                behind["url"] = rest.end()
        elif cue == "a":
            stop = start - 1 if start and text[start - 1] == " " else start
            first = _run_start(text, stop, behind["masked_email"], _LOCAL)
            if first < stop and (m := _MASKED_HOST.match(text, end + 1)):
                found["masked_email"].append((first, m.end()))
                behind["masked_email"] = m.end()
        elif cue == "i":
            if (m := re.compile(r"[\s:=#]{0,3}").match(text, end + 1)) and (n := _IBAN.match(text, m.end())) and n.start() >= behind["iban"]:
                stop = n.end()
                while stop > n.start() + 14 and not _iban_ok(text[n.start() : stop]):
                    stop -= 1
                if _iban_ok(text[n.start() : stop]):
                    found["iban"].append((n.start(), stop))
                    behind["iban"] = stop
        elif cue == "n" and (m := _NUMBER.match(text, end + 1)) and m.start(1) >= behind["account"]:
            found["account"].append(m.span(1))
            behind["account"] = m.end(1)
    if last_digit >= 0 and ":" in text:
        found["ipv6"] = [m.span() for m in _IPV6.finditer(text)]
    return [(k, a, b) for k in KINDS for a, b in found[k]]


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; of spans that overlap, the one that starts first, the longer
    if they start together, and then what is left of the others. No character of any span stays."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if b > at:
            out += [text[at:a], f"[{kind.upper()}]"]  # nothing lies between spans that overlap
            at = b
    return "".join([*out, text[at:]])


def _listed(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, a count for each base kind, ``base_sha256`` and ``spans``. A null or empty text has no spans.

    Work is local to a row, so nothing is shuffled; null ids, repeated rows and very long texts need no care (texts go through
    a task in parts of a bounded size). Other columns are not read. An empty table gives an empty result."""

    def scanned(batches):
        for b in words.slices(batches):
            every = [find(t) if t else [] for t in b.column("text").to_pylist()]
            counts = {f"n_{k}": pa.array([sum(s[0] == k for s in spans) for spans in every], pa.int64()) for k in BASE}
            base = pa.array([hashlib.sha256(_listed(s for s in spans if s[0] in BASE).encode()).hexdigest() for spans in every], pa.string())
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), **counts, "base_sha256": base, "spans": pa.array([_listed(s) for s in every], pa.string())})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(scanned, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with each span of personal data replaced by its kind; all other columns as they are, whatever their names.
    A null text stays null, an empty one empty; an empty table gives an empty one."""
    at = docs.columns.index(text_col)

    def cleaned(batches):
        for b in words.slices(batches, text_col):
            text = pa.array([redact(t, find(t)) if t else t for t in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([text if i == at else c for i, c in enumerate(b.columns)], names=b.schema.names)

    return docs.mapInArrow(cleaned, docs.schema)
