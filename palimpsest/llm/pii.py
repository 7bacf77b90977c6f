"""Personal data in texts: plain identifiers, and disguised ones found after normalisation.

Base spans are leftmost, non-overlapping matches of four patterns in the text as
it is; matches that fail their kind's test are dropped without another try.

Disguised spans come from a chain of transducers.  Each rewrites a text and maps
every character of its output to a stretch of its input: (1) homoglyphs, full
width forms and other digits to ASCII, invisible characters to nothing; (2) runs
of spelled digits to digits; (3) "at" and "dot" between names, bare or in
brackets, to "@" and ".".  In a second chain, step (2) makes dotted addresses of
four groups of digits or spelled digits with disguised or plain dots between
them, so that a run's dots are separators in one chain and part of an address in
the other.  The same patterns run on the last outputs, and their spans are mapped
back through the chains.  A disguised span is added unless it lies
within a base span of its kind, so one that extends a base span stands beside it;
base spans stay as they are.

Spans count code points of the source, end exclusive.  A null text is empty and
has no spans.  Rows are handled one by one, whatever their ids, so repeated rows and
null ids come out as they come in.  Very long texts are searched whole.  Spans that
start together are in the order of their kinds.  An empty table gives an empty
result.  ``find`` leaves extra columns out at the scan, whatever their names, and
``mask`` keeps them.
"""

from __future__ import annotations

import functools
import hashlib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame

from palimpsest.llm.bytewords import chunked
from palimpsest.llm.common import bounded_batches, only

KINDS = ("email", "ip", "card", "phone")

# Letters of other scripts that look like ASCII letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɡ": "g", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "․": ".", "。": ".", "｡": ".", "﹒": ".", "﹫": "@",
}
# Characters without width.
INVISIBLE = "\u00ad\u200b\u200c\u200d\u200e\u200f\u2060\ufeff"
# Names of the digits.
DIGITS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can't start within a run of digits: the run's start would have matched as well.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

_NAME = "(?:" + "|".join(DIGITS) + ")"
_SPELLED = re.compile(rf"(?<![A-Za-z0-9])(?:{_NAME}|[0-9]+)(?:[ ,.()-]{{1,4}}(?:{_NAME}|[0-9]+)(?![A-Za-z]))+", re.I)
#: Digits of a run that are worth rewriting; the patterns ask for their kinds' totals, which may go on beside the run.
_LEAST_DIGITS = 7
_WIDE = re.compile("[^\x00-\x7f]")
_WORD = re.compile(_NAME, re.I)
_AT = r"(?:\s*[\[({<]\s*(?:at|@)\s*[\])}>]\s*|\s+at\s+)"
_DOT = r"(?:\s*[\[({<]\s*(?:dot|\.)\s*[\])}>]\s*|\s+dot\s+|\.)"
_ONE = rf"(?:{_NAME}(?![A-Za-z])|[0-9](?![0-9A-Za-z]))"
_GROUP = rf"(?:[0-9]+(?![A-Za-z])|{_ONE}(?:[ ,-]{{1,3}}{_ONE}){{0,2}})"
_OCTETS = re.compile(rf"(?<![A-Za-z0-9]){_GROUP}(?:{_DOT}{_GROUP}){{3}}", re.I)
_OCTET_PART = re.compile(rf"(?P<dot>{_DOT})|(?P<name>{_NAME})|(?P<gap>[ ,-]+)|[0-9]+", re.I)
_ADDRESS = re.compile(rf"[A-Za-z0-9_%+-]+(?:{_DOT}[A-Za-z0-9_%+-]+)*(?:{_AT}|@)[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+", re.I)
_AT_ONE, _DOT_ONE = re.compile(_AT, re.I), re.compile(r"\s*[\[({<]\s*(?:dot|\.)\s*[\])}>]\s*|\s+dot\s+", re.I)
_BRACKET = re.compile(r"[\[({<]\s*(?:at|dot|@|\.)\s*[\])}>]", re.I)
_BARE_DOT = re.compile(r"\sdot\s", re.I)


@functools.lru_cache(1 << 16)
def _ascii(c: str) -> str | None:
    """What a character becomes, or None if it stays as it is."""
    if c in INVISIBLE:
        return ""
    if c in HOMOGLYPHS:
        return HOMOGLYPHS[c]
    plain = unicodedata.normalize("NFKC", c)
    if len(plain) == 1 and "!" <= plain <= "~":
        return plain
    digit = unicodedata.digit(c, None)
    return None if digit is None else str(digit)


#: Characters of two bytes below U+0250 that are rewritten, by their code points; all from there on might be.
_LOW_ODD = np.array([0x80 <= i and _ascii(chr(i)) is not None for i in range(0x250)])


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            last = m.end()
        at = text.find("@", m.end() if m else at + 1)


def identifiers(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of plain identifiers, sorted."""
    found = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and _luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append((m.start(), 1, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((m.start(), 3, m.end()))
    found.sort()
    return found


class Tape:
    """A rewritten text; character i stands for source[start[i]:end[i]]."""

    def __init__(self, text: str, start: list[int], end: list[int]):
        self.text, self.start, self.end = text, start, end

    @classmethod
    def of(cls, text: str) -> Tape:
        return cls(text, list(range(len(text))), list(range(1, len(text) + 1)))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Tape:
        """Replaces disjoint stretches, in order; each new character stands for the whole stretch."""
        text, start, end, low = [], [], [], 0
        for a, b, new in edits:
            text += [self.text[low:a], new]
            start += self.start[low:a] + [self.start[a]] * len(new)
            end += self.end[low:a] + [self.end[b - 1]] * len(new)
            low = b
        return Tape("".join([*text, self.text[low:]]), start + self.start[low:], end + self.end[low:])

    def characters(self) -> Tape:
        """The first transducer: look-alikes to ASCII."""
        edits = [(m.start(), m.end(), new) for m in _WIDE.finditer(self.text) if (new := _ascii(m[0])) is not None]
        return self.rewrite(edits) if edits else self

    def digits(self) -> Tape:
        """The second transducer: runs of spelled digits, one name at least, to digits."""
        edits = []
        for m, names in _spelled(self.text):
            edits += [(n.start(), n.end(), DIGITS[n[0].lower()]) for n in names]
            gaps = re.compile(r"(?<=[a-z0-9])[ ,.()-]+(?=[a-z0-9])", re.I)
            edits += [(g.start(), g.end(), "") for g in gaps.finditer(self.text, m.start(), m.end())]
        return self.rewrite(sorted(edits))

    def octets(self) -> Tape:
        """The second transducer of the second chain: four groups of digits or spelled digits to a dotted address."""
        edits = []
        for m in _OCTETS.finditer(self.text):
            parts = list(_OCTET_PART.finditer(self.text, m.start(), m.end()))
            if not any(part["name"] or (part["dot"] and part["dot"] != ".") for part in parts):
                continue  # digits and dots alone are no disguise
            for part in parts:
                new = "." if part["dot"] else DIGITS[part["name"].lower()] if part["name"] else "" if part["gap"] else part[0]
                if new != part[0]:
                    edits.append((part.start(), part.end(), new))
        return self.rewrite(edits)

    def marks(self) -> Tape:
        """The third transducer: "at" and "dot" within an address; a bare "at" needs a disguised dot beside it."""
        edits = []
        for m in _ADDRESS.finditer(self.text):
            at = next(_AT_ONE.finditer(self.text, m.start(), m.end()), None)
            dots = [(d.start(), d.end(), ".") for d in _DOT_ONE.finditer(self.text, m.start(), m.end()) if not at or d.end() <= at.start() or d.start() >= at.end()]
            if at and not dots and at[0].strip().lower() == "at":
                continue
            edits += [(at.start(), at.end(), "@")] if at else []
            edits += dots
        return self.rewrite(sorted(edits))


def _spelled(text: str) -> Iterator[tuple[re.Match, list[re.Match]]]:
    """Runs of digits and names of digits with at least one name, and the names."""
    for m in _SPELLED.finditer(text):
        names = list(_WORD.finditer(text, m.start(), m.end()))
        if names and len(names) + sum(c.isdigit() for c in m[0]) >= _LEAST_DIGITS:
            yield m, names


def suspicious(text: str, odd: bool) -> bool:
    """Whether a transducer changes the text, or might: without odd characters, only a disguised dot, a bracket or spelled digits do."""
    if odd:
        return True
    low = text.lower()
    if "dot" in low and _BARE_DOT.search(text):
        return True
    if any(b in text for b in "[({<") and _BRACKET.search(text):
        return True
    return any(n in low for n in DIGITS) and (next(_spelled(text), None) is not None or _OCTETS.search(text) is not None)


def disguised(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Further spans, from the normalised text, that lie within no base span of their kind."""
    plain = Tape.of(text).characters()
    first, second = plain.digits().marks(), plain.octets().marks()
    found = []
    for tape in [first] if first.text == second.text else [first, second]:
        if tape.text == text:
            continue
        for a, kind, b in identifiers(tape.text):
            start, end = tape.start[a], tape.end[b - 1]
            if not any(k == kind and s <= start and end <= e for s, k, e in base):
                found.append((start, kind, end))
    return sorted(set(found))


def _digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, list[str], list[bool]]]:
    """Rows, texts, and whether a text has characters that might be look-alikes."""
    for row, end, data, offsets in chunked(batch.column(column)):
        odd = np.zeros(end - row, bool)
        filled = np.flatnonzero(np.diff(offsets))
        if len(filled):
            strange = data >= 0xC9
            two = np.flatnonzero((data >= 0xC2) & (data < 0xC9))
            strange[two] = _LOW_ODD[(data[two] & 0x1F).astype(np.int64) << 6 | data[np.minimum(two + 1, len(data) - 1)] & 0x3F]
            odd[filled] = np.logical_or.reduceat(strange, offsets[filled])
        yield row, end, ["" if t is None else t for t in batch.column(column).slice(row, end - row).to_pylist()], odd.tolist()


def _finder(digests: bool):
    def run(batches):
        for batch in batches:
            for row, end, texts, odd in _texts(batch, 1):
                base, every = [], []
                for text, o in zip(texts, odd, strict=True):
                    plain = identifiers(text)
                    more = disguised(text, plain) if suspicious(text, o) else []
                    base.append(plain)
                    every.append(sorted(plain + more) if more else plain)
                columns, names = [batch.column(0).slice(row, end - row)], ["doc_id"]
                if digests:
                    columns += [pa.array([sum(k == kind for _, k, _ in spans) for spans in base], pa.int64()) for kind in range(4)]
                    columns += [pa.array([hashlib.sha256(_digest(spans).encode()).hexdigest() for spans in base], pa.string()), pa.array(list(map(_digest, every)), pa.string())]
                    names += ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
                else:
                    kept = [[{"kind": KINDS[k], "start": a, "end": b, "disguised": (a, k, b) not in plain} for a, k, b in spans] for spans, plain in zip(every, base, strict=True)]
                    columns.append(pa.array(kept, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("disguised", pa.bool_())]))))
                    names.append("spans")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def find(docs: DataFrame, digests: bool = False) -> DataFrame:
    """(doc_id, spans) of every row of ``docs``: array of (kind, start, end, disguised), by start, then kind.

    With ``digests``: (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans),
    counts and digest of base spans, and all spans as kind:start:end joined by commas.
    """
    kind = "doc_id bigint, " + ("n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string" if digests else "spans array<struct<kind:string,start:bigint,end:bigint,disguised:boolean>>")
    return only(docs, doc_id="bigint", text="string").mapInArrow(_finder(digests), kind)


def masked(text: str, odd: bool = True) -> str:
    """The text with every span replaced by its kind in angle brackets; of overlapping spans the first, then longest, wins."""
    spans = identifiers(text)
    if suspicious(text, odd):
        spans = spans + disguised(text, spans)
    if not spans:
        return text
    out, low = [], 0
    for a, k, b in sorted(spans, key=lambda s: (s[0], -s[2], s[1])):
        if a >= low:
            out += [text[low:a], f"<{KINDS[k].upper()}>"]
        low = max(low, b)
    return "".join([*out, text[low:]])


def mask(docs: DataFrame, column: str = "text") -> DataFrame:
    """``docs`` with personal data in ``column`` masked; other columns, and nulls, stay as they are."""
    bounded_batches(docs.sparkSession)
    place = docs.columns.index(column)
    text = docs.schema[column].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for row, end, texts, odd in _texts(batch, place):
                new = pa.array([masked(t, o) for t, o in zip(texts, odd, strict=True)], pa.string())
                own = batch.slice(row, end - row)
                nulls = own.column(place).is_null()
                new = pa.compute.if_else(nulls, pa.scalar(None, pa.string()), new).cast(own.column(place).type)
                yield pa.RecordBatch.from_arrays([new if i == place else own.column(i) for i in range(own.num_columns)], schema=own.schema)

    if text != "string":
        raise TypeError(f"{column} is {text}, not string")
    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"), digests=True)


def base_query(spark, sf_dir: str) -> DataFrame:
    """The base spans' counts and digest, without those that the transducers add."""
    return query(spark, sf_dir).drop("spans")


#: Base spans in DuckDB; a match starts behind the lengths of all stretches between matches, and of the matches, before it.
BASE_ORACLE = """
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
k(kind, nr, p) as (values
  ('email', 0, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+'),
  ('ip', 1, '[0-9]+(?:\\.[0-9]+)(?:\\.[0-9]+)(?:\\.[0-9]+)'),
  ('card', 2, '[0-9](?:[ -]?[0-9])+'),
  ('phone', 3, '\\+[0-9][ ().0-9-]+[0-9]')),
m as (select r, kind, nr, regexp_extract_all(text, p) as found, string_split_regex(text, p) as rest from d, k),
s as (
  select r, kind, nr, found[i] as t, regexp_replace(found[i], '[^0-9]', '', 'g') as n,
         cast(list_sum(list_transform(rest[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) as bigint) as a
  from m, unnest(range(1, len(found) + 1)) as u(i)),
good as (
  select r, kind, nr, a, a + length(t) as b from s
  where case kind
    when 'email' then true
    when 'ip' then list_bool_and(list_transform(string_split(t, '.'), lambda x: coalesce(try_cast(x as hugeint) <= 255, false)))
    when 'card' then length(n) between 14 and 19 and list_sum(list_transform(range(1, length(n) + 1), lambda j:
      cast(substr(n, length(n) - j + 1, 1) as int) * (1 + (j - 1) % 2) - case when cast(substr(n, length(n) - j + 1, 1) as int) * (1 + (j - 1) % 2) > 9 then 9 else 0 end)) % 10 = 0
    else length(n) between 10 and 15 end),
c as (
  select r, count(*) filter (nr = 0) as n_email, count(*) filter (nr = 1) as n_ip, count(*) filter (nr = 2) as n_card, count(*) filter (nr = 3) as n_phone,
         string_agg(kind || ':' || a || ':' || b, ',' order by a, nr) as spans from good group by r)
select doc_id, coalesce(n_email, 0) as n_email, coalesce(n_ip, 0) as n_ip, coalesce(n_card, 0) as n_card, coalesce(n_phone, 0) as n_phone,
       sha256(coalesce(spans, '')) as base_sha256 from d left join c using (r)
"""
