"""PII: anchor expansion.

One Aho-Corasick automaton finds the anchors of a text in one pass: at-signs, plus signs, digits,
schemes and identifier cues, these in any mix of cases. At each anchor a deterministic local parser expands to the left and
right as far as its own characters go and validates what it found; no pattern is run over the text.

Kinds: ``email``, ``ip``, ``card``, ``phone`` are the base kinds, found leftmost and without overlap
within a kind. The method adds ``iban`` (an IBAN cue, then an account number that passes mod 97),
``account`` (an account cue, then 6 to 17 digits in groups), ``ssn`` (a cue, then ddd-dd-dddd) and
``url`` (a scheme with user:password@host, the address up to the end of the host).

Spans count code points, end exclusive. Null or empty text: no spans. Null doc_id: kept as null.
Repeated rows: each gets the same result. Empty table: no rows. Other columns are ignored by
``found`` and kept by ``redacted``.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "account", "ssn", "url")
#: Cues before an identifier, in lower case, and the kind each one opens.
CUES = {
    "iban": "iban", "account number": "account", "account no": "account", "acct": "account",
    "kontonummer": "account", "numéro de compte": "account", "número de cuenta": "account",
    "ssn": "ssn", "social security": "ssn",
}
SCHEMES = ("://",)

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_LABEL = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_IBAN = re.compile(r"[\s:#.-]{0,5}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){10,30})(?![A-Za-z0-9])")
_ACCOUNT = re.compile(r"(?:\s*(?i:number|no|nr)\b)?[\s:#.]{0,5}([0-9](?:[ -]?[0-9]){5,16})(?![0-9])")
_SSN = re.compile(r"(?:\s*(?i:number|no)\b)?[\s:#.]{0,5}([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9])")
_SCHEME = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+.-")
_USERINFO = re.compile(r"://([^\s/?#@:]+:[^\s/?#@]+)@([A-Za-z0-9.-]+)")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def folded(text: str) -> str:
    """The text in lower case, character by character, so that places stay the same."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


_AUTOMATON = None


def automaton():
    """Built once per Python worker. Values are the anchor's kind and length."""
    global _AUTOMATON
    if _AUTOMATON is None:
        import ahocorasick

        a = ahocorasick.Automaton()
        for c in "0123456789":
            a.add_word(c, ("digit", 1))
        for word, kind in {"@": "at", "+": "plus", **dict.fromkeys(SCHEMES, "scheme")}.items():
            a.add_word(word, (kind, len(word)))
        for cue, kind in CUES.items():
            a.add_word(cue, (kind, len(cue)))
        a.make_automaton()
        _AUTOMATON = a
    return _AUTOMATON


def spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind in a text, by start."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    after = dict.fromkeys(("email", "ip", "card", "phone", *KINDS[4:]), 0)  # where a kind may begin again
    for last, (anchor, length) in automaton().iter(folded(text)):
        at = last - length + 1
        if anchor == "digit":
            if at >= after["ip"]:
                # a run of digits is looked at once, from its first digit
                if m := _IP.match(text, at):
                    if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
                        out["ip"].append(m.span())
                    after["ip"] = m.end()
                else:
                    after["ip"] = _DIGITS.match(text, at).end()
            if at >= after["card"]:
                if m := _CARD.match(text, at):
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        out["card"].append(m.span())
                    after["card"] = m.end()
                else:
                    after["card"] = at + 1
        elif anchor == "plus":
            if at >= after["phone"] and (m := _PHONE.match(text, at)):
                if 8 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    out["phone"].append(m.span())
                after["phone"] = m.end()
        elif anchor == "at":
            start = at
            while start > after["email"] and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _LABEL.match(text, at + 1)):
                out["email"].append((start, m.end()))
                after["email"] = m.end()
        elif anchor == "scheme":
            start = at
            while start > after["url"] and text[start - 1] in _SCHEME:
                start -= 1
            if start < at and (m := _USERINFO.match(text, at)):
                out["url"].append((start, m.end()))
                after["url"] = m.end()
        else:
            before = text[at - 1 : at]
            pattern = {"iban": _IBAN, "account": _ACCOUNT, "ssn": _SSN}[anchor]
            if not before.isalnum() and (m := pattern.match(text, at + length)) and m.start(1) >= after[anchor]:
                if anchor != "iban" or mod97(m[1].replace(" ", "")):
                    out[anchor].append(m.span(1))
                    after[anchor] = m.end(1)
    return out


def listed(found: dict, kinds) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in found[k])


def found(docs: DataFrame) -> DataFrame:
    """Counts and spans of every document."""

    def run(batches):
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                got = spans(text or "")
                base = hashlib.sha256(listed(got, BASE_KINDS).encode()).hexdigest()
                rows.append((doc_id, *(len(got[k]) for k in BASE_KINDS), base, listed(got, KINDS)))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])

    schema = "doc_id string, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    rows = docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(run, schema)
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))


def redact(text: str) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans become one, named
    after the span that begins first (the longer one, if two do)."""
    every = sorted((a, -b, k) for k, x in spans(text).items() for a, b in x)
    out, at = [], 0
    for a, b, kind in every:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, -b)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with redacted texts and, where there is such a column, n_chars of the new text."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None else redact(t))

    out = docs.withColumn("text", clean("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op8_pii(spark, sf_dir: str) -> DataFrame:
    return found(spark.read.parquet(f"{sf_dir}/documents.parquet"))
