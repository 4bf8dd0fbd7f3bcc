"""Personal data by anchor expansion."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.llm.common import digest_rows, documents

#: Kinds in the order of the output; the first four are the base ones.
KINDS = ("email", "ip", "card", "phone", "login", "account")
BASE = KINDS[:4]

#: Words that announce an identifier, in any case.
CUES = ("account", "acct", "iban", "ssn", "passport", "konto", "cuenta", "compte", "licence no", "license no", "customer no", "tax id")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
RUN = re.compile(r"[0-9]+\Z")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*\Z")
USERINFO = re.compile(r"[A-Za-z0-9._~%!$&'()*+,;=-]++(?::[A-Za-z0-9._~%!$&'()*+,;=:-]*+)?@")
FILLER = re.compile(r"(?:[\x20.:#=-]|no\b|nr\b|number\b|code\b){0,12}", re.ASCII | re.IGNORECASE)
NUMBER = re.compile(r"[A-Za-z]{0,4}[0-9][0-9A-Za-z]*(?:[\x20-][0-9A-Za-z]*[0-9][0-9A-Za-z]*)*", re.ASCII)
#: Letters and digits of an account number at most, and what they and the single separators between them take.
LONGEST, REACH = 34, 72
GROUP = re.compile(r"[0-9A-Za-z]+")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,}\Z")


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word, what in [("@", "at"), ("://", "scheme"), ("+", "plus"), *((f".{d}", "dot") for d in range(10))]:
        found.add_word(word, (what, len(word)))
    for cue in CUES:
        found.add_word(cue, ("cue", len(cue)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def iban(text: str) -> bool:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def email_at(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """Expands an at-sign: left over local characters down to `floor` (the last match's end), right over a domain."""
    start = at
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    domain = DOMAIN.match(text, at + 1) if start < at else None
    return (start, domain.end()) if domain else None


def account_at(text: str, end: int) -> tuple[int, int] | None:
    """Expands an identifier cue to the number that follows it: 5 to 34 letters and digits with 5 digits or more;
    what looks like an IBAN must pass its check. Of the groups that follow, as many count as make a number; where all of
    them look like an IBAN that is printed in fours, no fewer make a plain number."""
    start = FILLER.match(text, end).end()
    m = NUMBER.match(text, start, start + REACH)  # a group that is cut there has too many characters anyway
    if not m:
        return None
    choices, plain, sizes = [], "", []
    for group in GROUP.finditer(text, start, m.end()):
        plain += group[0].upper()
        if len(plain) > LONGEST:
            break
        sizes.append(len(group[0]))
        choices.append((plain, group.end()))
    choices = [(c, stop) for c, stop in choices if len(c) >= 5 and sum(x.isdigit() for x in c) >= 5]
    fours = bool(choices and sizes[:2] == [4, 4] and IBAN.match(choices[-1][0]))
    for plain, stop in reversed(choices):
        if iban(plain) if IBAN.match(plain) else not fours:
            return start, stop
    return None


def address_at(text: str, dot: int, floor: int) -> tuple[int, int] | None:
    """Expands a dot between digits: left over the digits before it, not below `floor`, right over three more parts."""
    head = RUN.search(text, max(floor, dot - 32), dot)
    if not head:
        return None
    start = head.start()
    while start > floor and text[start - 1].isascii() and text[start - 1].isdigit():
        start -= 1
    m = IP.match(text, start)
    return m.span() if m else None


def folded(text: str) -> str:
    """The text in lower case, character by character: one letter alone would become two."""
    return text.replace("\u0130", "\u0131").lower()


def find(text: str, anchors: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """(kind's place, start, end) of all spans, in code points, by kind and start."""
    spans: list[tuple[int, int, int]] = []
    email_end = phone_end = address_end = 0
    for last, (what, length) in anchors.iter(folded(text)):
        if what == "at":
            if found := email_at(text, last, email_end):
                email_end = found[1]
                spans.append((0, *found))
        elif what == "plus":
            if last >= phone_end and (m := PHONE.match(text, last)):
                phone_end = m.end()
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    spans.append((3, *m.span()))
        elif what == "dot":
            if last > address_end and (found := address_at(text, last - 1, address_end)):
                address_end = found[1]
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text[slice(*found)].split(".")):
                    spans.append((1, *found))
        elif what == "scheme":
            head = last + 1 - length
            if SCHEME.search(text, max(0, head - 32), head) and (m := USERINFO.match(text, last + 1)):
                spans.append((4, m.start(), m.end() - 1))
        elif found := account_at(text, last + 1):
            spans.append((5, *found))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            spans.append((2, *m.span()))
    base = {s[1:] for s in spans if s[0] < len(BASE)}
    return sorted({s for s in spans if s[0] < len(BASE) or s[1:] not in base})


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    anchors = automaton()
    for ids, texts in digest_rows(batches, ["id", "text"]):
        found = [find(t or "", anchors) for t in texts]
        yield pa.RecordBatch.from_pydict(
            {"id": pa.array(ids, pa.int64()), "spans": pa.array([[{"kind": KINDS[k], "start": a, "end": b} for k, a, b in s] for s in found], SPANS)}
        )


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and `spans`, an array of (kind, start, end) in code points, end exclusive, by kind and start.

    One automaton finds at-signs, schemes, plus signs, dots before digits and identifier cues in a single pass; local
    parsers expand each anchor to the whole email, phone, address, login (of a URL) or account number and validate it;
    the anchors of cards are digits, for which no automaton is needed. Rows are independent, nothing is shuffled. A null or empty text has no spans; repeated rows give
    repeated results; an empty table gives an empty result; other columns are ignored.
    """
    pairs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = pairs.mapInArrow(scan, "id long, spans array<struct<kind string, start long, end long>>")
    return found.withColumnRenamed("id", "doc_id")


def redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    anchors = automaton()
    for batch in batches:
        at = batch.schema.get_field_index("text")
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            texts = [t and redacted(t, find(t, anchors)) for t in part.column(at).to_pylist()]
            yield part.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Each span, the longest where several overlap, becomes <KIND>."""
    out, at = [], 0
    for start, end, kind in sorted((a, b, k) for k, a, b in spans):
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact_pii(docs: DataFrame) -> DataFrame:
    """The rows with personal data in `text` replaced by <KIND>; all columns stay. Null and empty texts stay as they are,
    repeated rows give repeated results, an empty table an empty one."""
    return docs.mapInArrow(redact, docs.schema)


def op2_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    of = lambda k: F.filter(spans, lambda s: s["kind"] == k)
    joined = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE))
    return find_pii(documents(spark, sf_dir)).select(
        "doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans")
    )
