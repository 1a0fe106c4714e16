"""Personal data by anchor expansion.

One Aho-Corasick automaton finds anchors in a whole text: at-signs, schemes,
digits joined by a dot or a separator, a plus before a digit, and identifier
cues, schemes and cues in any case. From each anchor a local parser expands to the boundaries of an email,
address, card, phone, account or secret and validates it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes as B
from ._dist import prepare

#: Base kinds in the order of their spans; the method's own come after them.
BASE = ("email", "ip", "card", "phone")
OWN = ("account", "secret", "url")
#: Cues that announce an account or a secret, in any case of A-Z.
ACCOUNT_CUES = ("account", "acct", "iban", "passport", "ssn", "social security", "tax id", "customer id", "user id", "driver license")
SECRET_CUES = ("token", "api_key", "apikey", "api key", "password", "passwd", "secret", "private_key", "access_key")
SCHEMES = ("http", "https", "ftp", "ssh", "mailto", "postgres", "mysql", "redis", "mongodb")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LINK = re.compile(r"[^\s<>\"'`|]+")
_ACCOUNT = re.compile(r"(?:\s++(?ai:number|no|num|id))?\.?\s*+[:=#]?\s*+([A-Za-z0-9][A-Za-z0-9-]{4,33})(?![A-Za-z0-9])")
_SECRET = re.compile(r"\s*[:=]\s*[\"']?([A-Za-z0-9_\-./+]{8,})")


@cache
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    a.add_word("@", ("@", 0))
    for x in "0123456789":
        a.add_word(f"+{x}", ("+", 1))
        for y in "0123456789":
            a.add_word(f"{x}.{y}", (".", 2))
            a.add_word(f"{x}{y}", ("d", 1))
            a.add_word(f"{x} {y}", ("d", 2))
            a.add_word(f"{x}-{y}", ("d", 2))
    for kind, cues in (("a", ACCOUNT_CUES), ("s", SECRET_CUES)):
        for c in cues:
            a.add_word(c, (kind, len(c) - 1))
    for s in SCHEMES:
        a.add_word(f"{s}:", (":", len(s)))
    a.make_automaton()
    return a


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _lowered(text: str) -> str:
    """A-Z in lower case and nothing else changed, so that places are the same."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind, in code points, end exclusive, by start."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in BASE + OWN}
    mail_end = dots_end = card_end = link_end = account_end = secret_end = 0
    run_end = stop = 0  # of the run of a link's characters, with and without marks at its end
    sign = -1  # the next at-sign, once looked for
    lower = _lowered(text)
    for last, (kind, back) in _automaton().iter(lower):
        at = last - back
        if kind == "d":
            if last < card_end:
                continue
            m = _DIGITS.match(text, at)
            card_end = m.end()
            digits = [c for c in m[0] if c not in " -"]
            if 16 <= len(digits) <= 19 and _luhn("".join(digits)):
                out["card"].append(m.span())
        elif kind == "@":
            i = at
            while i > mail_end and text[i - 1] in _LOCAL:
                i -= 1
            if i < at and (m := _DOMAIN.match(text, at + 1)):
                out["email"].append((i, m.end()))
                mail_end = m.end()
        elif kind == ".":
            if last < dots_end:
                continue
            i = at
            while i > dots_end and "0" <= text[i - 1] <= "9":
                i -= 1
            m = _DOTTED.match(text, i)
            dots_end = m.end()
            parts = m[0].split(".")
            for k in range(0, len(parts) - 3, 4):
                long = len(".".join(parts[k : k + 4]))
                if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in parts[k : k + 4]):
                    out["ip"].append((i, i + long))
                i += long + 1
        elif kind == "+":
            m = _PHONE.match(text, at)
            if m and 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out["phone"].append(m.span())
        elif kind == ":":
            mail = lower[at:last] == "mailto"
            if at < link_end or (at and text[at - 1].isalnum()) or not (mail or text.startswith("//", last + 1)):
                continue
            if last + 1 >= run_end:  # else still inside the same run
                m = _LINK.match(text, last + 1)
                run_end = stop = m.end() if m else last + 1
                while stop > last + 1 and text[stop - 1] in ".,;:!?)]}":
                    stop -= 1
            if mail and sign <= last:
                sign = text.find("@", last + 1)
                sign = len(text) if sign < 0 else sign
            if sign < stop if mail else stop - last > 5:
                link_end = stop
                out["url"].append((at, link_end))
        elif kind == "a":
            if at >= account_end and not (at and text[at - 1].isalnum()) and (m := _ACCOUNT.match(text, last + 1)) and sum("0" <= c <= "9" for c in m[1]) >= 4:
                out["account"].append(m.span(1))
                account_end = m.end()
        elif at >= secret_end and not (at and text[at - 1].isalnum()) and (m := _SECRET.match(text, last + 1)) and any("0" <= c <= "9" for c in m[1]):
            out["secret"].append(m.span(1))
            secret_end = m.end()
    return out


def _joined(found: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{z}" for k in kinds for a, z in found[k])


def redacted(text: str, found: dict[str, list[tuple[int, int]]]) -> str:
    """The text with each span replaced by its kind; overlapping spans become one, of the earliest."""
    out, at = [], 0
    for a, z, k in sorted((a, z, k) for k, v in found.items() for a, z in v):
        if a >= at:
            out += [text[at:a], f"[{k.upper()}]"]
        at = max(at, z)
    return "".join(out) + text[at:]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", redact: bool = False) -> DataFrame:
    """Per document: its id, the spans of every kind, counts and a digest of the base kinds.

    With redact also the text with its spans replaced. A null or empty text has
    no spans; repeated rows each get a row; other columns aren't read. A text is
    whole in memory; its cost grows in proportion to its length.
    """
    prepare(docs.sparkSession)
    names = ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"] + ["text"] * redact

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _ in B.slices(batches, "text"):
            texts = [x or "" for x in part.column(1).to_pylist()]
            found = [spans(x) for x in texts]
            rows = [part.column(0), *(pa.array([len(f[k]) for f in found], pa.int64()) for k in BASE), pa.array([hashlib.sha256(_joined(f, BASE).encode()).hexdigest() for f in found], pa.string()), pa.array([_joined(f, BASE + OWN) for f in found], pa.string())]
            if redact:
                rows.append(pa.array([redacted(x, f) for x, f in zip(texts, found, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(rows, names)

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, {', '.join(f'n_{k} long' for k in BASE)}, base_sha256 string, spans string" + ", text string" * redact)
