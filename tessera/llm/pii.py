"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, schemes, plus signs, digits and identifier cues.
At each anchor a local parser expands to both sides, finds the boundaries and validates what it found.
Email, ip, card and phone spans are those of their patterns read leftmost and without overlap; a match that
fails its validation is dropped and its characters are not tried again. The method adds: url (scheme or
www anchor), iban (country and check digits, mod 97), account (a cue, then an identifier with four digits at
least) and secret (a cue, an equals sign or colon, then a value with a digit, eight characters at least).

Null texts count as empty: no spans. Positions are code points, ends exclusive. Whole texts are read,
whatever their length, in time linear in it: no parser reads a stretch again for each anchor in it. Spans of
different kinds that start together come in the order of the kinds. Repeated rows each give a row; a null id stays
null; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import sha256_hex

BASE = ("email", "ip", "card", "phone")
ADDED = ("url", "iban", "account", "secret")
ORDER = {kind: i for i, kind in enumerate(BASE + ADDED)}
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

ACCOUNT_CUES = ("account", "acct", "konto", "compte", "cuenta", "passport", "ssn")
SECRET_CUES = ("password", "passwd", "token", "secret", "api_key", "apikey")

LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SCHEME_NAME = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+.-")
URL_REST = re.compile(r"[^\s<>\"'`|\\^{}]+")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
#: Runs of white space are taken whole (possessive), so a cue before a long run costs its length once.
ACCOUNT = re.compile(r"\s*+(?:(?:no\.?|nr\.?|number|#)\s*+)?(?:[:=#]\s*+)?([A-Z0-9][A-Z0-9-]{5,33})\b", re.I)
SECRET = re.compile(r"[\"']?\s*+[=:]\s*+[\"']?([A-Za-z0-9+/_.~-]{8,})")
NON_DIGIT = re.compile(r"[^0-9]+")


def automaton() -> ahocorasick.Automaton:
    """Anchors -> kind. Cues are listed in lower, upper and title case, so the text needn't be folded."""
    found = ahocorasick.Automaton()
    for x in "0123456789":
        found.add_word(x, ("digit", 1))
    found.add_word("@", ("at", 1))
    found.add_word("+", ("plus", 1))
    found.add_word("://", ("scheme", 3))
    found.add_word("www.", ("www", 4))
    for kind, cues in (("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
        for cue in cues:
            for form in {cue, cue.upper(), cue.title()}:
                found.add_word(form, (kind, len(form)))
    found.make_automaton()
    return found


def _byte(digits: str) -> bool:
    """Whether a decimal number is at most 255, whatever zeros lead it."""
    plain = digits.lstrip("0")
    return len(plain) < 3 or len(plain) == 3 and plain <= "255"


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


#: Letters count as two digits.
VALUES = {c: (int(c, 36), 10 if c.isdigit() else 100) for c in "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def iban_end(found: str) -> int:
    """Where the longest of its leading words that make a valid number end; 0 if none do. Words may follow a number after a
    space. One pass: the remainder by 97 goes on from word to word."""
    head = int("".join(str(VALUES[c][0]) for c in found[:4]))
    rest, n, best = 0, 4, 0
    for at, c in enumerate(found[4:] + " ", 4):
        if c != " ":
            value, scale = VALUES[c]
            rest = (rest * scale + value) % 97
            n += 1
        elif 15 <= n <= 34 and (rest * 1_000_000 + head) % 97 == 1:
            best = at
    return best


def scan(text: str, anchors: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every span, by start and then by kind as listed."""
    spans: list[tuple[int, int, str]] = []
    done = dict.fromkeys(ORDER, 0)  # per kind: characters before this are used up

    def add(kind: str, start: int, end: int, valid: bool = True) -> None:
        done[kind] = end
        if valid:
            spans.append((start, end, kind))

    for last, (kind, size) in anchors.iter(text):
        at = last - size + 1
        if kind == "digit":
            begins = at == 0 or not ("0" <= text[at - 1] <= "9")
            if at >= done["ip"] and (begins or at == done["ip"]) and (m := IP.match(text, at)):
                add("ip", at, m.end(), all(map(_byte, m.group().split("."))))
            if at >= done["card"] and (m := CARD.match(text, at)):
                digits = NON_DIGIT.sub("", m.group())
                add("card", at, m.end(), 12 <= len(digits) <= 19 and luhn(digits))
            if begins and at >= 2 and at - 2 >= done["iban"] and text[at - 2 : at].isalpha() and (m := IBAN.match(text, at - 2)) and not text[at - 3 : at - 2].isalnum():
                if end := iban_end(m.group()):
                    add("iban", at - 2, at - 2 + end)
        elif kind == "at":
            start = at
            while start > done["email"] and text[start - 1] in LOCAL_PART:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                add("email", start, m.end())
        elif kind == "plus":
            if at >= done["phone"] and (m := PHONE.match(text, at)):
                add("phone", at, m.end(), 9 <= len(NON_DIGIT.sub("", m.group())) <= 15)
        elif kind in ("scheme", "www"):
            if at < done["url"]:
                continue
            start = at
            while kind == "scheme" and start > done["url"] and text[start - 1] in SCHEME_NAME:
                start -= 1
            if (start < at or kind == "www") and (m := URL_REST.match(text, last + 1)):
                end = last + 1 + len(m.group().rstrip(".,;:!?)]"))
                if end > last + 1:
                    add("url", start, end)
        elif at >= done[kind] and (m := (ACCOUNT if kind == "account" else SECRET).match(text, last + 1)):
            value = m.group(1)
            if sum(c.isdigit() for c in value) >= (4 if kind == "account" else 1):
                add(kind, m.start(1), m.end(1))
    spans.sort(key=lambda x: (x[0], ORDER[x[2]]))
    return spans


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, counts by base kind, base_sha256 (digest of the base spans), spans (all of them)."""

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for batch in stream:
            counts: dict[str, list[int]] = {kind: [] for kind in BASE}
            digests, all_spans = [], []
            for x in batch.column(1):
                spans = scan(x.as_py(), anchors)
                base = [s for s in spans if s[2] in BASE]
                for kind in BASE:
                    counts[kind].append(sum(s[2] == kind for s in base))
                digests.append(sha256_hex(_joined(base).encode()))
                all_spans.append(_joined(spans))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(counts[k], pa.int64()) for k in BASE), pa.array(digests, pa.string()), pa.array(all_spans, pa.string())],
                names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"],
            )

    return docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(batches, SCHEMA)
