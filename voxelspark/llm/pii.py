"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass: at-signs, scheme separators, the
first digits of numbers and cues such as "IBAN" or "password". At each anchor a small
deterministic parser expands to both sides and validates what it has: boundaries,
number ranges, check digits. Anchors of one kind come in text order and a parser never
looks behind the end of its last match, so each kind's spans are leftmost and don't
overlap; a match that fails its check is dropped whole.

Kinds, in the order of the output: email, ip, card and phone as plain patterns define
them; then mail (addresses with letters outside ASCII), login (user and password in a
URL), iban, account (a number after a cue) and secret (a value after a cue).

Null and empty texts have no spans. Positions are code points, ends exclusive. Texts are
read whole, a span has no longest length but where its kind has one, and the time taken
grows with the text. Each row, also a repeated one or one of a null id, is read by itself;
further columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "mail", "login", "iban", "account", "secret")

# Cues, in lower case.
ACCOUNT_CUES = ("account number", "account no", "account", "acct", "passport", "ssn", "social security number", "tax id")
SECRET_CUES = ("token", "secret", "password", "passwd", "api_key", "api key", "apikey", "access_key", "private_key")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
_dotted = re.compile(r"[0-9]+(?:\.[0-9]+)*").match
_digits = re.compile(r"[0-9](?:[ -]?[0-9])+").match
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]").match
_wide_domain = re.compile(r"\w[\w-]*(?:\.\w[\w-]*)*\.\w{2,}").match
_host = re.compile(r"[A-Za-z0-9.-]+").match
_iban = re.compile(r"[\s:#=]{0,4}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})").match
_account = re.compile(r"(?:\s*(?i:numbers?|no\.?|nr\.?|id))?\s*[:#=]?\s*([0-9A-Z](?:-?[0-9A-Z]){4,19})(?![\w-])").match
_secret = re.compile(r"\s*[:=]\s*[\"']?([A-Za-z0-9_+/.=-]{12,})").match


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def iban_ok(code: str) -> bool:
    code = code.replace(" ", "")
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def automaton():
    """Anchors with the kind they start and their length."""
    import ahocorasick

    found = ahocorasick.Automaton()
    digits = "0123456789"
    anchors = {"@": "at", "://": "scheme", **{"+" + d: "phone" for d in digits}, **{f"{a}.{b}": "ip" for a in digits for b in digits}}
    anchors |= {a + gap + b: "card" for a in digits for gap in ("", " ", "-") for b in digits}
    for kind, cues in (("iban", ("iban",)), ("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
        anchors |= {form: kind for cue in cues for form in (cue, cue.capitalize(), cue.title(), cue.upper())}
    for anchor, kind in anchors.items():
        found.add_word(anchor, (kind, len(anchor)))
    found.make_automaton()
    return found


class Finder:
    """Finds spans in texts; one per task."""

    def __init__(self):
        self.anchors = automaton()

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        out: dict[str, list[tuple[str, int, int]]] = {k: [] for k in KINDS}
        done = dict.fromkeys((*KINDS, "ip_chain"), 0)

        def add(kind: str, start: int, end: int) -> None:
            out[kind].append((kind, start, end))

        for last, (kind, n) in self.anchors.iter(text):
            at = last - n + 1
            if kind == "card":
                if at >= done["card"]:
                    m = _digits(text, at)
                    done["card"] = m.end()
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 13 <= len(digits) <= 19 and luhn(digits):
                        add("card", at, m.end())
            elif kind == "ip":
                if at >= done["ip"]:
                    self._ip(text, at, done, add)
            elif kind == "at":
                self._mail(text, at, done, add)
            elif kind == "phone":
                if at >= done["phone"] and (m := _phone(text, at)):
                    done["phone"] = m.end()
                    if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                        add("phone", at, m.end())
            elif kind == "scheme":
                self._login(text, at + n, done, add)
            elif at >= done[kind] and not (at and (text[at - 1].isalnum() or text[at - 1] == "_")) or kind == "secret" and at >= done[kind]:
                self._cued(kind, text, at + n, done, add)
        return [s for k in KINDS for s in out[k]]

    @staticmethod
    def _ip(text: str, at: int, done: dict, add) -> None:
        """``at`` is the digit before the first dot of a chain of dotted numbers."""
        start = at
        while start > done["ip"] and "0" <= text[start - 1] <= "9":
            start -= 1
        m = _dotted(text, start)
        done["ip"] = m.end()
        place, parts = start, m[0].split(".")
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = place + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                add("ip", place, end)
            place = end + 1

    @staticmethod
    def _mail(text: str, at: int, done: dict, add) -> None:
        start, low = at, done["email"]
        while start > low and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := _domain(text, at + 1)):
            done["email"] = m.end()
            add("email", start, m.end())
            return
        start, low = at, max(low, done["mail"])
        while start > low and (text[start - 1].isalnum() or text[start - 1] in LOCAL):
            start -= 1
        while start < at and text[start] in ".%+-":
            start += 1
        m = _wide_domain(text, at + 1)
        if start < at and m and not (text[start:at] + m[0]).isascii():
            done["mail"] = m.end()
            add("mail", start, m.end())

    @staticmethod
    def _login(text: str, at: int, done: dict, add) -> None:
        """User and password between a scheme and the at-sign before a host."""
        end = at
        while end < len(text) and not text[end].isspace() and text[end] not in "/@\"'<>":
            end += 1
        if at >= done["login"] and end < len(text) and text[end] == "@" and ":" in text[at:end] and _host(text, end + 1):
            done["login"] = end
            add("login", at, end)

    @staticmethod
    def _cued(kind: str, text: str, at: int, done: dict, add) -> None:
        m = {"iban": _iban, "account": _account, "secret": _secret}[kind](text, at)
        if not m:
            return
        value, start, end = m[1], m.start(1), m.end(1)
        if kind == "iban":
            # The longest beginning, whole groups, that passes its check.
            while value and not iban_ok(value):
                value = value[: value.rfind(" ")] if " " in value else ""
            end = start + len(value)
            if not value:
                return
        elif kind == "account" and sum(map(str.isdigit, value)) < 5 or kind == "secret" and not (any(map(str.isdigit, value)) and any(map(str.isalpha, value))):
            return
        done[kind] = end
        add(kind, start, end)


SPANS = "array<struct<kind: string, start: int, end: int>>"


def find(text: Column) -> Column:
    """The spans of each whole text, by kind and start."""

    @F.arrow_udf(SPANS)
    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Finder()
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for a in it:
            yield pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in own.spans(x or "")] for x in a.to_pylist()], kind)

    return run(text)


def redact(text: Column) -> Column:
    """Each text with its spans replaced by their kind, as in ``<EMAIL>``; of spans that
    overlap, one mark stays, the first's. A null text stays null; invalid UTF-8 is replaced."""

    @F.arrow_udf("string")
    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Finder()
        for a in it:
            yield pa.array([x if x is None else marked(x, own.spans(x)) for x in a.to_pylist()], pa.string())

    return run(F.make_valid_utf8(text))


def marked(text: str, spans: list[tuple[str, int, int]]) -> str:
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of every document, their counts and a digest of the base kinds."""
    common.workers_import(spark)
    found = common.table(spark, sf_dir, "documents").select("doc_id", find(common.as_text(F.col("text"))).alias("found"))
    of = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    count = [of(k).alias(f"n_{k}") for k in BASE]
    base = F.filter("found", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *count, F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))
