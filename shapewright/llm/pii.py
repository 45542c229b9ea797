"""Personal data: patterns propose spans, checksums confirm them, context words adjust their scores.

Patterns are possessive or start from a rare character, so that a long run of digits or letters costs linear time. Cards must pass
Luhn, IBANs mod 97, ip parts must be at most 255. A span of a kind whose pattern and checksum decide alone is kept whatever its
context; kinds that are ambiguous by themselves (IBAN in lower case, national numbers, secrets) need words nearby to reach the threshold.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import append_columns, place_of

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")
BASE = KINDS[:4]
THRESHOLD = 0.5
WINDOW = 48
"""Characters before and after a span that are searched for context words."""
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3, "secret": 0.3}
CONTEXT = {
    "email": "mail contact correo kontakt courriel",
    "ip": "ip address host server adresse",
    "card": "card visa credit mastercard karte carte tarjeta",
    "phone": "phone call tel mobile fax telefon téléphone teléfono",
    "iban": "iban account bank konto compte cuenta",
    "ssn": "ssn social security",
    "secret": "token key secret password api bearer",
}
LOWER_IBAN = 0.3
BONUS = 0.3

LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN_HEAD = re.compile(r"(?<![^\W_])[A-Za-z]{2}[0-9]{2}(?= ?[A-Za-z0-9]{4})")
IBAN_REST = re.compile(r" ?[A-Za-z0-9]")
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
SECRET = re.compile(r"(?<![0-9A-Za-z])[0-9A-Fa-f]{40}(?![0-9A-Za-z])")
DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def mod97(iban: str) -> bool:
    rest = 0
    for c in iban[4:] + iban[:4]:
        rest = (rest * (100 if c.isalpha() else 10) + int(c, 36)) % 97
    return rest == 1


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`, found from their @."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in LOCAL:
            begin -= 1
        if begin < at and (m := DOMAIN.match(text, at + 1)):
            yield begin, m.end()
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", done)


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """The longest run from each head of 15 to 34 letters and digits, single blanks between them, that ends with a word and passes mod 97.

    A run in capitals is confirmed by its checksum; one with lower-case letters passes too and is left to its context.
    """
    done = 0
    for head in IBAN_HEAD.finditer(text):
        if head.start() < done:
            continue
        ends, at, kept = [], head.end(), head[0]
        while len(kept) < 34 and (m := IBAN_REST.match(text, at)):
            at, kept = m.end(), kept + m[0][-1]
            if len(kept) >= 15 and (at == len(text) or not text[at].isalnum()):
                ends.append((at, kept))
        for end, iban in reversed(ends):
            if mod97(iban.upper()):
                yield head.start(), end
                done = end
                break


def proposals(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans that pass their kind's own test."""
    if "@" in text:
        yield from (("email", *x) for x in emails(text))
    if not DIGIT.search(text):
        return
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            yield "ip", *m.span()
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            yield "card", *m.span()
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(digits_of(m[0])) <= 15:
                yield "phone", *m.span()
    yield from (("iban", *x) for x in ibans(text))
    if "-" in text:
        yield from (("ssn", *m.span()) for m in SSN.finditer(text))
    for m in SECRET.finditer(text):
        if DIGIT.search(m[0]) and not m[0].isdigit():
            yield "secret", *m.span()


WORDS = {k: re.compile(r"(?<![^\W\d_])(?:" + "|".join(v.split()) + r")(?![^\W\d_])", re.I) for k, v in CONTEXT.items()}


def score(kind: str, text: str, begin: int, end: int) -> float:
    """The kind's prior and a bonus for a context word nearby; an IBAN with lower-case letters starts from LOWER_IBAN."""
    prior = LOWER_IBAN if kind == "iban" and not text[begin:end].isupper() else PRIOR[kind]
    near = WORDS[kind].search(text[max(0, begin - WINDOW) : begin]) or WORDS[kind].search(text[end : end + WINDOW])
    return min(1.0, prior + (BONUS if near else 0.0))


def find(text: str | None, threshold: float = THRESHOLD) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) in code points by start, then kind as in KINDS; a span of a further kind inside a base one goes."""
    if not text:
        return []
    found = sorted({(b, KINDS.index(k), e) for k, b, e in proposals(text)})
    scored = [(KINDS[k], b, e, score(KINDS[k], text, b, e)) for b, k, e in found]
    base = [x for x in scored if x[0] in BASE]
    begins, reach = [x[1] for x in base], list(accumulate((x[2] for x in base), max, initial=-1))
    return [x for x in scored if x[0] in BASE or x[3] >= threshold and reach[bisect_left(begins, x[2])] <= x[1]]


def redact(text: str | None, spans: list[tuple[str, int, int, float]]) -> str | None:
    """Each span, or run of overlapping spans, becomes the first one's kind in angle brackets."""
    out, done, end = [], 0, 0
    for kind, b, e, _ in spans:
        if b >= end:
            out += [text[end:b], f"<{kind.upper()}>"]
        end = max(end, e)
    return text if not spans else "".join(out) + text[end:]


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())])
SPAN_ARROW = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])


def find_pii(df: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """df with pii, an array of (kind, start, end, score), and redacted, the text with each span replaced by its kind.

    A null text has no spans and stays null; an empty one stays empty. Rows stay as they are, repeats included; columns named pii
    or redacted are replaced, all others pass through. No row is moved.
    """

    def make() -> Callable[[list], list[pa.Array]]:
        def step(texts: list) -> list[pa.Array]:
            spans = [find(t, threshold) for t in texts]
            rows = [[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in x] for x in spans]
            return [pa.array(rows, pa.list_(SPAN_ARROW)), pa.array([redact(t, x) for t, x in zip(texts, spans, strict=True)], pa.string())]

        return step

    return append_columns(df, text, make, [T.StructField("pii", T.ArrayType(SPAN)), T.StructField("redacted", T.StringType())])


def redact_documents(df: DataFrame, text: str = "text", size: str = "n_chars") -> DataFrame:
    """df with every text redacted, the same columns in the same order; the column size, where there is one, counts the new characters."""
    names, own = df.columns, f"c{place_of(df, text)}"
    out = find_pii(df.toDF(*[f"c{i}" for i in range(len(names))]), own)
    counted = lambda i, c: F.when(F.col("redacted").isNull(), F.col(f"c{i}")).otherwise(F.length("redacted").cast(df.schema.fields[i].dataType)).alias(f"c{i}") if c == size else F.col(f"c{i}")
    return out.select(*[F.col("redacted").alias(own) if f"c{i}" == own else counted(i, c) for i, c in enumerate(names)]).toDF(*names)


def pii_digests(docs: DataFrame) -> DataFrame:
    """op9: counts and digests of the spans of all documents."""
    out = find_pii(docs.select("doc_id", "text"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *map(count, BASE), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"))
