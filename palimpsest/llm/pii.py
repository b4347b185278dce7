"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Every span has a score: its kind's own, more with a word of that kind near it, less with a word that
speaks against it (a version number is no address). Four kinds are always spans once they pass
their own test (email, ip, card, phone), and the score says how sure each is. Three more kinds are spans
only from the score ACCEPTED on: an IBAN (length of its country, mod-97 checksum), a telephone number
without a leading +, and a secret (a long value of letters and digits). The last two don't reach it
without a word like "phone" or "token" near them. All positions are code points, ends are exclusive.
All scans are linear in the text.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import released, with_struct

KINDS = ("email", "ip", "card", "phone", "iban", "local_phone", "secret")
BASE = KINDS[:4]
LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match can only begin where a run of digits does: what follows the run is the same from any of its digits.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Za-z]{2}[0-9]{2}(?=\x20?[A-Za-z0-9])")
LOCAL_PHONE = re.compile(r"(?<![+0-9A-Za-z.])\(?[0-9]{2,5}\)?(?:[\x20.-]\(?[0-9]{2,5}\)?){2,4}(?![0-9A-Za-z])")
SECRET = re.compile(r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/-]*[0-9])[A-Za-z0-9_+/-]{20,}={0,2}(?![A-Za-z0-9_+/=-])")
# IBAN lengths by country (ISO 13616).
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22,
    "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28,
    "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27,
    "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24,
    "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
#: Score of a span by itself, what words of its kind nearby add, words against it take away, and the score from which it counts.
SCORES = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.8, "iban": 0.9, "local_phone": 0.3, "secret": 0.3}
CONTEXT_BONUS, CONTEXT_MALUS, ACCEPTED, CONTEXT_CHARS = 0.35, 0.35, 0.6, 48
CONTEXT = {
    "email": re.compile(r"\b(?:e-?mail|mail|contact|correo|courriel)\b", re.I),
    "ip": re.compile(r"\b(?:ip|address|host|server|adresse|direcci[oó]n)\b", re.I),
    "card": re.compile(r"\b(?:card|visa|mastercard|amex|credit|karte|carte|tarjeta)\b", re.I),
    "phone": re.compile(r"\b(?:phone|tel|telephone|mobile|call|fax|telefon|tel[eé]fono|t[eé]l)\b", re.I),
    "iban": re.compile(r"\b(?:iban|account|bank|konto|compte|cuenta)\b", re.I),
    "secret": re.compile(r"(?:\b|_)(?:token|password|passwd|secret|api[_-]?key|access[_-]?key|credential|passwort|contrase[nñ]a)\b", re.I),
}
CONTEXT["local_phone"] = CONTEXT["phone"]
AGAINST = {
    "ip": re.compile(r"\b(?:version|release|section|chapter|build|v)\b", re.I),
    "card": re.compile(r"\b(?:isbn|order|invoice|serial|tracking|part)\b", re.I),
    "local_phone": re.compile(r"\b(?:isbn|order|invoice|serial|date|version|pages?)\b", re.I),
    "secret": re.compile(r"\b(?:commit|checksum|sha1|sha256|md5|hash|uuid|revision)\b", re.I),
}


def digits_of(text: str) -> str:
    """The ASCII digits of a text."""
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    """Every second digit from the right doubled, digits summed: a multiple of ten."""
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """First four characters moved to the end, letters as 10 to 35: remainder 1 by 97."""
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses: from each @ back over the local part, then the domain."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL_PART:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def find_base(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end) of the four certain kinds, in no order."""
    out = [(a, 0, b) for a, b in emails(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(_byte(p) for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if 12 <= len(m[0]) and 12 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return out


def _byte(part: str) -> bool:
    """Whether a run of digits, however long, is at most 255."""
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def score(text: str, kind: str, start: int, end: int) -> float:
    """Score of a span from 0 to 1: its kind's own, changed by words of that kind or against it near the span."""
    near = text[max(0, start - CONTEXT_CHARS) : start] + " " + text[end : end + CONTEXT_CHARS]
    made = SCORES[kind] + CONTEXT_BONUS * bool(CONTEXT[kind].search(near))
    if kind in AGAINST:
        made -= CONTEXT_MALUS * bool(AGAINST[kind].search(near))
    return round(min(1.0, max(0.0, made)), 2)


def ibans(text: str) -> list[tuple[int, int]]:
    """Account numbers of their country's length, in any case, in runs that single blanks may part, with the right checksum."""
    out, end = [], 0
    for m in IBAN.finditer(text):
        wanted = IBAN_LENGTHS.get(m[0][:2].upper())
        if wanted is None or m.start() < end:
            continue
        at, found = m.start(), []
        while len(found) < wanted and at < len(text):
            if text[at].isascii() and text[at].isalnum():
                found.append(text[at].upper())
            elif text[at] != " " or text[at - 1] == " ":
                break
            at += 1
        if len(found) == wanted and not (text[at : at + 1].isascii() and text[at : at + 1].isalnum()) and mod97("".join(found)):
            end = at
            out.append((m.start(), at))
    return out


def find_more(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of the kinds that need a score of ACCEPTED, where no certain span lies."""
    found = [(a, 4, b) for a, b in ibans(text)]
    found += [(m.start(), 5, m.end()) for m in LOCAL_PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    found += [(m.start(), 6, m.end()) for m in SECRET.finditer(text) if any(c.isalpha() for c in m[0])]
    if not found:
        return []
    # Starts of the certain spans and the furthest end up to each, so that one search tells whether any overlaps.
    starts, ends, last = [], [], 0
    for a, _, b in sorted(base):
        last = max(last, b)
        starts.append(a)
        ends.append(last)
    free = []
    for a, k, b in found:
        n = bisect_left(starts, b)
        if not n or ends[n - 1] <= a:
            free.append((a, k, b))
    return [(a, k, b) for a, k, b in free if score(text, KINDS[k], a, b) >= ACCEPTED]


def spans_of(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Certain spans and all spans, each by start, then kind."""
    text = text or ""
    base = sorted(find_base(text))
    return base, sorted(base + find_more(text, base))


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by <KIND> of its first."""
    out, end = [], 0
    for a, k, b in spans:
        if a >= end:
            out += [text[end:a], f"<{KINDS[k].upper()}>"]
        end = max(end, b)
    return "".join([*out, text[end:]])


FIELDS = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "scores"]
TYPE = "struct<n_email:bigint,n_ip:bigint,n_card:bigint,n_phone:bigint,base_sha256:string,spans:string,scores:string>"


def detect(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df (or its columns in keep) with counts of the certain kinds, their digest, all spans and their scores in the same order.

    A null text counts as empty: no spans, the digest of ''. Columns of these names are replaced.
    Whole texts are read; repeated rows give repeated results.
    """

    @F.arrow_udf(TYPE)
    def found(texts: pa.Array) -> pa.Array:
        counts, shas, spans, scores = [], [], [], []
        for t in texts:
            value = t.as_py() or ""
            base, every = spans_of(value)
            counts.append([sum(k == n for _, k, _ in base) for n in range(4)])
            shas.append(hashlib.sha256(written(base).encode()).hexdigest())
            spans.append(written(every))
            scores.append(",".join(f"{score(value, KINDS[k], a, b):.2f}" for a, k, b in every))
        released()
        columns = [pa.array([c[n] for c in counts], pa.int64()) for n in range(4)]
        return pa.StructArray.from_arrays([*columns, *(pa.array(c, pa.string()) for c in (shas, spans, scores))], FIELDS)

    return with_struct(df, found(F.col(f"`{text}`")), FIELDS, keep)


def mask(df: DataFrame, text: str = "text") -> DataFrame:
    """df with every span of the text replaced by its kind in angle brackets; null texts stay null."""

    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        made = pa.array([None if (x := t.as_py()) is None else masked(x, spans_of(x)[1]) for t in texts], pa.string())
        released()
        return made

    return df.withColumn(text, clean(F.col(f"`{text}`")))
