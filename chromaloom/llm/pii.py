"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass: at-signs, plus signs and
digits, "://" and identifier cues. From each anchor a deterministic parser
expands to the boundaries of the value and validates it. All parsers are linear
in the text, whatever it holds.

Kinds of the base set (fixed patterns, leftmost and non-overlapping by kind):
email, ip, card, phone. The cues add: login (a URL with user information), iban
(after "iban", check digits hold), ssn (after "ssn") and account (a number after
"account", "acct" or "a/c").
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from chromaloom.llm.common import id_and_text, schema_with, table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "login", "iban", "ssn", "account")
CUES = {"iban": "iban", "ssn": "ssn", "social security": "ssn", "account": "account", "acct": "account", "a/c": "account"}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_NUMERIC = frozenset("0123456789 .+()-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_RUN = re.compile(r"[0-9 .+()-]*")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_URL_REST = re.compile(r"[^\s<>\"'`]+")
_AUTHORITY = re.compile(r"[^\s<>\"'`/?#]+")
_AFTER_CUE = re.compile(r"(?:\s?(?:no|nr|number|num)\b\.?)?[\s:#=]{0,4}", re.I)
_IBAN = re.compile(r"[A-Za-z]{2}[0-9]{2}(?: ?[A-Za-z0-9]){11,30}")
_SSN = re.compile(r"([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_ACCOUNT = re.compile(r"[0-9](?:[ -]?[0-9]){5,16}(?![0-9])")


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for c in "0123456789":
        found.add_word(c, ("digit", 1))
    found.add_word("+", ("digit", 1))
    found.add_word("@", ("at", 1))
    found.add_word("://", ("scheme", 3))
    for cue, kind in CUES.items():
        found.add_word(cue, (kind, len(cue)))
    found.make_automaton()
    return found


_ANCHORS = _automaton()


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _numbers(text: str, lo: int, hi: int) -> Iterator[tuple[str, int, int]]:
    """Base kinds in a maximal run of the characters that any of them holds."""
    for run in _DOTTED.finditer(text, lo, hi):
        if (run.end() - run.start()) < 7:
            continue
        at, parts = run.start(), run.group().split(".")
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in four)):
                yield "ip", at, end
            at = end + 1
    for m in _CARD.finditer(text, lo, hi):
        if 12 <= m.end() - m.start() and 12 <= len(d := _only_digits(m.group())) <= 19 and luhn(d):
            yield "card", *m.span()
    if "+" in text[lo:hi]:
        for m in _PHONE.finditer(text, lo, hi):
            if 9 <= len(_only_digits(m.group())) <= 15:
                yield "phone", *m.span()


def _iban_end(text: str, at: int, end: int) -> int:
    """The longest end whose check digits hold (letters count 10 to 35, country
    and check digits come last, the rest by 97 is 1), or 0."""
    head = int(f"{int(text[at], 36)}{int(text[at + 1], 36)}{text[at + 2 : at + 4]}")
    rest = n = best = 0
    for i in range(at + 4, end):
        if text[i] != " ":
            value = int(text[i], 36)
            rest = (rest * (100 if value > 9 else 10) + value) % 97
            n += 1
            if n >= 11 and (rest * 1_000_000 + head) % 97 == 1:
                best = i + 1
    return best


def _after_cue(kind: str, text: str, at: int) -> tuple[str, int, int] | None:
    at = _AFTER_CUE.match(text, at).end()
    if kind == "ssn" and (m := _SSN.match(text, at)) and m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000":
        return "ssn", *m.span()
    if kind == "account" and (m := _ACCOUNT.match(text, at)):
        return "account", *m.span()
    if kind == "iban" and (m := _IBAN.match(text, at)):
        if end := _iban_end(text, at, m.end()):
            return "iban", at, end
    return None


def _login(text: str, at: int) -> tuple[str, int, int] | None:
    """A URL that carries user information, around the "://" at ``at``. The
    authority ends before the next "://", so that a text is read once in all;
    what follows a valid one is read up to the span's end, where the next begins."""
    start = at
    while start > 0 and at - start < 32 and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "+.-")):
        start -= 1
    authority = _AUTHORITY.match(text, at + 3)
    if start == at or authority is None:
        return None
    user, sign, host = authority.group().rpartition("@")
    if not (user and sign and host.strip(".,;:!)")):
        return None
    return "login", start, at + 3 + len(_URL_REST.match(text, at + 3).group().rstrip(".,;:!)"))


def _lower(text: str) -> str:
    """A-Z and other letters in lower case, every character at its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(x := c.lower()) != 1 else x for c in text)


def spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start, then kind in the order of KINDS."""
    found: list[tuple[str, int, int]] = []
    mail_end = run_end = 0
    cue_end = dict.fromkeys(KINDS, 0)
    for last, (kind, n) in _ANCHORS.iter(_lower(text)):
        at = last + 1 - n
        if kind == "digit":
            if at < run_end:
                continue
            lo = at
            while lo > run_end and text[lo - 1] in _NUMERIC:
                lo -= 1
            run_end = _RUN.match(text, at).end()
            found.extend(_numbers(text, lo, run_end))
        elif kind == "at":
            if at < mail_end:
                continue
            start = at
            while start > mail_end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                mail_end = m.end()
                found.append(("email", start, mail_end))
        elif kind != "scheme" or at >= cue_end["login"]:
            span = _login(text, at) if kind == "scheme" else _after_cue(kind, text, last + 1)
            if span and span[1] >= cue_end[span[0]]:
                found.append(span)
                cue_end[span[0]] = span[2]
    order = {k: i for i, k in enumerate(KINDS)}
    return [(s, e, k) for s, _, e, k in sorted((s, order[k], e, k) for k, s, e in found)]


def _joined(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in found)


def _scan() -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
        for batch in batches:
            made = [[{"start": s, "end": e, "kind": k} for s, e, k in spans(t.as_py())] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, part)], names=["doc_id", "spans"])

    return run


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id and spans: array of (start, end, kind) in code points, end exclusive.

    A null text is empty and has no spans; a null doc_id stays null; repeated
    rows return as often; an empty table gives an empty result; further columns
    are not read. Texts of any length are scanned whole in linear time.
    """
    schema = schema_with(docs.select("doc_id"), "spans array<struct<start:int,end:int,kind:string>>")
    return id_and_text(docs).mapInArrow(_scan(), schema)


def redact(text: str) -> str:
    """The text with each span replaced by its kind in brackets; of spans that
    overlap the first and longest counts."""
    out, at = [], 0
    for s, e, k in sorted(spans(text), key=lambda x: (x[0], -x[1])):
        if s >= at:
            out += [text[at:s], f"[{k}]"]
            at = e
    return "".join([*out, text[at:]])


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    found = find_pii(table(spark, sf_dir, "documents"))
    joined = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    of = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    return found.select("doc_id", *map(of, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def base_by_regex(text: str) -> str:
    """The base spans by the plain patterns; what tests compare with."""
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    found = []
    for i, (kind, p) in enumerate(patterns.items()):
        for m in re.finditer(p, text):
            d = _only_digits(m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (12 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            found.append((m.start(), i, m.end(), kind))
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(found))


def digest(joined: str) -> str:
    return hashlib.sha256(joined.encode()).hexdigest()
