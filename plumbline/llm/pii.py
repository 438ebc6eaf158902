"""Personal data: patterns propose, checksums confirm, context adjusts the score.

Base kinds (email, ip, card, phone) are taken as their patterns and checks
say, always. The method adds kinds that a pattern alone would overstate: their
score starts low, and a checksum (mod 97 for an account number) or a word of
context nearby must lift it to ``least_score``.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.bpe import batches_of_text
from plumbline.llm.rows import map_batches, release_memory, texts

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "national_id", "local_phone")
RANK = {k: i for i, k in enumerate(KINDS)}

LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A match can only start where a run of digits starts: from inside it, it would go on alike.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]{4}){2,7}(?:[\x20]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
NATIONAL_ID = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
LOCAL_PHONE = re.compile(r"(?<![0-9+.-])\(?[0-9]{2,4}\)?[\x20./-][0-9]{3,4}[\x20./-][0-9]{3,4}(?![0-9.-])")
DIGITS = re.compile("[0-9]")
#: Letters and digits of an account number, by country.
IBAN_LENGTHS = {
    country: length
    for length, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
        28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}

#: Words near a span that speak for its kind.
CONTEXT = {
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "national_id": ("ssn", "social security", "national id", "tax id"),
    "local_phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono"),
    "email": ("mail", "contact", "@"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
}
#: Score by pattern alone, and what a passed checksum and a context word add.
START = {"email": 0.9, "ip": 0.6, "card": 0.4, "phone": 0.6, "iban": 0.3, "national_id": 0.3, "local_phone": 0.3}
CHECKED, NEARBY = 0.5, 0.3
CONTEXT_CHARS = 40
#: Texts that a task masks before their memory is given back.
MASKED_ROWS = 256
LEAST_SCORE = 0.6

Span = tuple[int, int, str, float]


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def mod97(account: str) -> bool:
    turned = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def accounts(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers: to the length of their country, if words that follow are in the match, or else the whole match."""
    m = IBAN.search(text)
    while m:
        found = m[0].replace(" ", "")
        length = IBAN_LENGTHS.get(found[:2], len(found))
        # Matches are short, so that searching them again takes linear time.
        at = m.start() + 1
        end, left = m.start(), length
        while left and end < m.end():
            left -= text[end] != " "
            end += 1
        for end, account in ((end, found[:length]), (m.end(), found)):
            if (end == m.end() or text[end] == " ") and mod97(account):
                yield m.start(), end
                at = end
                break
        m = IBAN.search(text, at)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the local part, an @ and the domain: from each @ to both sides, in linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        left = at
        while left > done and text[left - 1] in LOCAL_CHARS:
            left -= 1
        if left < at and (domain := DOMAIN.match(text, at + 1)):
            yield left, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """The four base kinds, by start, then kind; code points, end exclusive."""
    found = [(a, b, "email") for a, b in emails(text)]
    for m in IP.finditer(text):
        parts = m[0].split(".")
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in parts):
            found.append((*m.span(), "ip"))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = "".join(DIGITS.findall(m[0]))
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((*m.span(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(DIGITS.findall(m[0])) <= 15:
                found.append((*m.span(), "phone"))
    return sorted(found, key=lambda s: (s[0], RANK[s[2]], s[1]))


def scored_spans(text: str, least_score: float = LEAST_SCORE) -> list[Span]:
    """Base spans with their scores, and added spans that reach ``least_score`` and overlap no base span."""
    spans = [(a, b, kind, _score(text, a, b, kind, kind == "card")) for a, b, kind in base_spans(text)]
    starts, ends = _covered(spans)
    extra = []
    matches = ((kind, (m.span() for m in pattern.finditer(text))) for kind, pattern in (("national_id", NATIONAL_ID), ("local_phone", LOCAL_PHONE)))
    for kind, places in (("iban", accounts(text)), *matches):
        for a, b in places:
            score = _score(text, a, b, kind, kind == "iban")
            if score >= least_score:
                # What is taken lies apart and in order: only the last one that starts before the span's end can overlap it.
                place = bisect.bisect_left(starts, b)
                if not place or ends[place - 1] <= a:
                    extra.append((a, b, kind, score))
                    starts.insert(place, a)
                    ends.insert(place, b)
    return sorted(spans + extra, key=lambda s: (s[0], RANK[s[2]], s[1]))


def _covered(spans: list[Span]) -> tuple[list[int], list[int]]:
    """Starts and ends of the ranges that spans in order of start cover, apart from each other."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b, _, _ in spans:
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def _score(text: str, start: int, end: int, kind: str, checked: bool) -> float:
    near = (text[max(0, start - CONTEXT_CHARS) : start] + " " + text[end : end + CONTEXT_CHARS]).lower()
    return min(1.0, START[kind] + CHECKED * checked + NEARBY * any(re.search(rf"\b{re.escape(w)}", near) for w in CONTEXT[kind] if w in near))


def joined(spans: list[tuple]) -> str:
    return ",".join(f"{s[2]}:{s[0]}:{s[1]}" for s in spans)


def find_personal_data(docs: DataFrame, least_score: float = LEAST_SCORE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<start, end, kind, score>>) of every row; null and empty texts have none. Repeated rows are searched each."""

    def make():
        def step(batch):
            for ids, values in batches_of_text(batch):
                yield {
                    "doc_id": pa.array(ids, pa.int64()),
                    "spans": pa.array(
                        [[{"start": a, "end": b, "kind": k, "score": s} for a, b, k, s in scored_spans(t, least_score)] for t in values],
                        pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("score", pa.float64())])),
                    ),
                }

        return step

    return map_batches(texts(docs, id_col, text_col), make, "doc_id long, spans array<struct<start:long,end:long,kind:string,score:double>>")


def span_digest(found: DataFrame) -> DataFrame:
    """Counts and digests of ``find_personal_data``."""

    def text_of(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count_of(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(
        "doc_id",
        *(count_of(k).alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(text_of(base), 256).alias("base_sha256"),
        text_of(F.col("spans")).alias("spans"),
    )


def mask(text: str, least_score: float = LEAST_SCORE) -> str:
    """``text`` with each span replaced by its kind in brackets; of overlapping spans the first names the place."""
    out, done = [], 0
    for start, end, kind, _ in scored_spans(text, least_score):
        if start >= done:
            out += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join(out) + text[done:]


def masked(docs: DataFrame, least_score: float = LEAST_SCORE, text_col: str = "text") -> DataFrame:
    """``docs`` with masked texts and all columns kept; null texts stay null. ``n_chars``, where there is one, follows the text."""

    @F.arrow_udf("string")
    def masker(column: pa.Array) -> pa.Array:
        parts = [
            pa.array([None if t is None else mask(t, least_score) for t in column.slice(at, MASKED_ROWS).to_pylist()], pa.string())
            for at in range(0, len(column), MASKED_ROWS)
        ]
        release_memory()
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    out = docs.withColumn(text_col, masker(F.col(text_col)))
    return out.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
