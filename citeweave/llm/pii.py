"""Personal data with offsets, disguised forms included.

Base patterns run on the text as it is. Transducers then rewrite it: look-alike characters to Latin ones (invisible ones vanish), spelled digits to digits, at/dot
disguises to signs. Each keeps, for every rewritten stretch, the source span it stands for, so what the base patterns find in the rewritten text maps back to source
characters. Such spans are added unless they equal or lie within a base span of their kind; longer ones
stand beside it, and redact() takes the union.

Defined results: null and empty texts hold nothing; every row is judged on its own; other columns are ignored by found() and kept by redacted(); an empty table gives an
empty table. All steps are linear in a text's length: no pattern is tried again over what an earlier try has passed.
Signs are rewritten in layers, so forms may mix within one address: entities, then brackets and dashes around at and dot, then words and spaced signs on what these leave. Where a bracket or a dash shows what is meant, or the name has a digit, a dot
or an underscore, any ending counts; the wholly plain form `name at host dot tld` counts for the endings in PLAIN_ENDS alone, as prose has such words too.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# an address ends where its run of digits does and starts where one does: no other start can match, so none is tried
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), kinds as in KINDS."""
    out = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-")):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((0, start, m.end()))
            end = m.end()
        else:
            end = max(end, at + 1)  # an @ is in no local part
        at = text.find("@", max(end, at + 1))
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:4] or 0) <= 255 for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append((3, m.start(), m.end()))
    return out


#: Letters of other scripts that look like Latin ones.
LOOK_ALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ο": "o", "ν": "v", "ι": "i", "ρ": "p", "τ": "t", "υ": "u", "κ": "k", "ϲ": "c", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɡ": "g", "ɑ": "a", "․": ".", "。": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", " ": " ", " ": " ", " ": " ",
}
#: Characters that show nothing.
INVISIBLE = "​‌‍⁠﻿­"
_FULL_WIDTH = {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
_STYLED = {chr(c + k): str(k) for c in (0x0660, 0x06F0, 0x0966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6) for k in range(10)}
#: Letters and digits in styles (bold, script, circled), by their compatibility form.
_STYLES = {c: n for a, b in ((0x1D400, 0x1D7CE), (0x24B6, 0x24EA), (0x2460, 0x2469), (0x2102, 0x2140)) for c, n in ((chr(k), unicodedata.normalize("NFKC", chr(k))) for k in range(a, b)) if len(n) == 1 and n.isascii() and n.isalnum()}
_CHARS = _STYLES | LOOK_ALIKES | _FULL_WIDTH | _STYLED | dict.fromkeys(INVISIBLE, "")
#: One that may be among them; those beyond the basic plane as a range, since a class tests such singles one by one.
_ANY_CHAR = re.compile("[" + re.escape("".join(c for c in _CHARS if c <= "\uffff")) + "\U0001d400-\U0001d7ff]")

#: Digits as words.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_WORD = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_TWO = re.compile(rf"\b(?:{_WORD})[\s,.-]{{1,3}}(?:{_WORD}|dot|punkt|punto|point|[0-9])", re.I)
_PART = re.compile(rf"(?<![^\W_])(?:{_WORD}|plus|double|triple)(?![^\W_])|\+?[0-9]+", re.I)
_JOIN = re.compile(r"[\s,()-]{1,3}\Z")

#: Last labels with which the plain form (name at host dot com) counts, none a frequent word of prose; how at and dot are spelled.
PLAIN_ENDS = "com org net edu gov mil info biz pro dev app cloud mail email online site shop store tech blog xyz io co ai tv cc eu uk ie de fr es nl ch lu li pt pl cz sk hu ro bg gr tr ru ua lt lv dk fi ca mx br ar cl pe au nz jp cn kr tw hk sg th vn ph pk lk np za eg ng ke".split()
_ENDS = frozenset(PLAIN_ENDS)
_AT_WORD, _DOT_WORD = r"(?:at|arroba)", r"(?:dot|punkt|punto|point)"
_ENTITY = re.compile(r"&(?:#0*(?P<at>64)|#x0*(?P<at2>40)|(?P<at3>commat)|#0*46|#x0*2e|period);", re.I)
_BRACKETED = re.compile(rf"[\[({{<]\s*+(?:(?P<at>{_AT_WORD}|@)|{_DOT_WORD}|\.)\s*+[\])}}>]", re.I)
_DASHED = re.compile(rf"(?<=[A-Za-z0-9])([-_])(?:(?P<at>{_AT_WORD})|{_DOT_WORD})\1(?=[A-Za-z0-9])", re.I)
#: A chain of names with spelled or spaced dots between them, and what follows it if that makes it an address; a chain is passed as a whole, so each is read twice at most.
_DOT = rf"(?:\s{{1,3}}{_DOT_WORD}\s{{1,3}}|\s{{1,3}}\.\s{{1,3}})"
_CHAIN = re.compile(
    rf"(?<![A-Za-z0-9._%+-])(?P<name>[A-Za-z0-9._%+-]++(?:{_DOT}[A-Za-z0-9._%+-]++)*+)(?:(?P<at>\s{{1,3}}{_AT_WORD}\s{{1,3}}|\s{{0,3}}@\s{{0,3}})(?P<domain>[A-Za-z0-9-]++(?:(?:{_DOT}|\.)[A-Za-z0-9-]++)++))?+", re.I
)
_LABEL_GAP = re.compile(rf"{_DOT}|\.", re.I)
_SPACED_DOT = re.compile(_DOT, re.I)
_PLAIN_IP = re.compile(rf"(?<![0-9])[0-9]++(?:(?:{_DOT}|\.)[0-9]++){{3}}", re.I)
_NEAR_DOT = re.compile(rf"{_DOT_WORD}\s0|0\s{_DOT_WORD}\s", re.I)
_DOTS = ("dot", "punkt", "punto", "point", " .", " @", "@ ")


class Rewritten:
    """A text and, for every place in it, the source span it came from. Edits are few, so they are kept as a list of stretches."""

    def __init__(self, source: str):
        self.text = source
        self.layers: list[tuple[list[int], list[int], list[tuple[int, int]]]] = []

    def apply(self, edits: list[tuple[int, int, str]]) -> None:
        """Replaces [start, end) of the present text; edits are in order and don't overlap."""
        if not edits:
            return
        parts, at, length = [], 0, 0
        begins, olds, spans = [], [], []  # new place of each stretch, old place, old span if replaced
        for start, end, new in edits:
            if start > at:
                parts.append(self.text[at:start])
                begins.append(length)
                olds.append(at)
                spans.append((-1, -1))
                length += start - at
            parts.append(new)
            begins.append(length)
            olds.append(start)
            spans.append((start, end))
            length += len(new)
            at = end
        parts.append(self.text[at:])
        begins.append(length)
        olds.append(at)
        spans.append((-1, -1))
        self.layers.append((begins, olds, spans))
        self.text = "".join(parts)

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The source span of [start, end) of the present text."""
        for begins, olds, spans in reversed(self.layers):
            k = bisect_right(begins, start) - 1
            first = spans[k][0] if spans[k][0] >= 0 else olds[k] + start - begins[k]
            k = bisect_right(begins, end - 1) - 1
            last = spans[k][1] if spans[k][0] >= 0 else olds[k] + end - begins[k]
            start, end = first, last
        return start, end


def look_alike_edits(text: str) -> list[tuple[int, int, str]]:
    return [] if text.isascii() else [(m.start(), m.end(), _CHARS[m[0]]) for m in _ANY_CHAR.finditer(text) if m[0] in _CHARS]


def spelled_edits(text: str, least: int = 2) -> list[tuple[int, int, str]]:
    """Runs of digit words (digits may stand among them) as digits; what only separates them goes."""
    low = text.lower()
    if not any(w in low for w in DIGIT_WORDS) or not _TWO.search(text):
        return []
    edits: list[tuple[int, int, str]] = []
    chain: list[tuple[int, int, str]] = []
    spelled = 0

    def close():
        nonlocal chain, spelled
        if spelled >= least or spelled and (len(chain) > 1 or _NEAR_DOT.search(text[max(0, chain[0][0] - 7) : chain[0][0]] + "0" + text[chain[0][1] : chain[0][1] + 7])):
            for k, (s, e, new) in enumerate(chain):
                edits.append((chain[k - 1][1] if k else s, e, new))
        chain, spelled = [], 0

    times = 1
    for m in _PART.finditer(text):
        word = m[0].lower()
        if chain and not _JOIN.match(text[chain[-1][1] : m.start()] if m.start() - chain[-1][1] <= 3 else "!"):
            close()
            times = 1
        if word in ("plus", "double", "triple"):
            if word == "plus":
                close()
                chain.append((m.start(), m.end(), "+"))
            else:
                times = 2 if word == "double" else 3
                chain.append((m.start(), m.end(), ""))
            continue
        digit = DIGIT_WORDS.get(word)
        spelled += digit is not None
        chain.append((m.start(), m.end(), (digit or word) * (times if digit else 1)))
        times = 1
    close()
    return [(s, e, n) for s, e, n in edits if s < e]


def marked_edits(text: str) -> list[tuple[int, int, str]]:
    """&#64;, [at], (dot), -at-, _dot_ and the like, brackets with the blanks around them. Dashes count beside a sign of the other kind, in whatever form."""
    edits = [(m.start(), m.end(), "@" if m["at"] or m["at2"] or m["at3"] else ".") for m in _ENTITY.finditer(text)] if "&" in text else []
    if any(c in text for c in "[({<"):
        done = 0
        for m in _BRACKETED.finditer(text):
            start, end = m.start(), m.end()
            while start > done and text[start - 1].isspace():
                start -= 1
            while end < len(text) and text[end].isspace():
                end += 1
            edits.append((start, end, "@" if m["at"] else "."))
            done = end
    dashed = [(m.start(), m.end(), "@" if m["at"] else ".") for m in _DASHED.finditer(text)] if "-" in text or "_" in text else []
    signs, loose = sorted(edits + dashed), set(dashed)
    for k, e in enumerate(signs):
        if e in loose:  # its neighbours within an address's length
            beside = [f for f in signs[max(0, k - 4) : k + 5] if f[2] != e[2] and abs(f[0] - e[0]) <= 80]
            joined = e[2] == "@" and (_REAL_DOMAIN.match(text, e[1]) or _SPELLED_DOMAIN.match(text, e[1])) or e[2] == "." and re.search(r"@[A-Za-z0-9.-]*\Z", text[max(0, e[0] - 80) : e[0]])
            if beside or joined:
                edits.append(e)
    return _in_order(edits)


_SPELLED_DOMAIN = re.compile(rf"[A-Za-z0-9]++{_DOT}[A-Za-z]{{2}}", re.I)
_REAL_DOMAIN = re.compile(rf"[A-Za-z0-9]++(?:\.[A-Za-z0-9]++)*?\.(?:{'|'.join(PLAIN_ENDS)})(?![A-Za-z0-9])", re.I)


def _in_order(edits: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Edits that overlap none before them."""
    out, end = [], 0
    for e in sorted(set(edits)):
        if e[0] >= end:
            out.append(e)
            end = e[1]
    return out


def _named(m: re.Match, shown: list[int]) -> list[tuple[int, int, str]]:
    """Edits that make an address of a chain, none if it isn't one. shown: places where brackets or dashes stood."""
    start, end = m.span("domain")
    gaps = [g.span() for g in _LABEL_GAP.finditer(m.string, start, end)]
    k = bisect_right(shown, m.start("at") - 1)
    strong = k < len(shown) and shown[k] < end or any(c in "0123456789_" or c == "." for c in m["name"].strip("."))
    stops = [*(a for a, _ in gaps[1:]), end]
    last = lambda n: m.string[gaps[n][1] : stops[n]].lower()
    fits = [n for n in range(len(gaps)) if last(n) in _ENDS or strong and len(last(n)) > 1 and last(n).isalpha()]
    if not fits:
        return []
    at, used = m["at"], gaps[: fits[-1] + 1]
    spelled = [g for g in used if m.string[g[0] : g[1]] != "."]
    if not spelled and (at == "@" or at.strip() != "@" and not (k < len(shown) and shown[k] < end)):
        return []  # nothing is disguised, or a word before a plain domain
    return [*((*d.span(), ".") for d in _SPACED_DOT.finditer(m.string, *m.span("name"))), (*m.span("at"), "@"), *((*g, ".") for g in spelled)]


def plain_edits(text: str, shown: list[int] = ()) -> list[tuple[int, int, str]]:
    """`name at host dot tld`, `name @ host . tld`, `1 dot 2 dot 3 dot 4`."""
    low, edits = text.lower(), []
    if not shown and not any(w in low for w in _DOTS):
        return []
    for m in _CHAIN.finditer(text):
        if m["at"]:
            edits += _named(m, shown)
    for m in _PLAIN_IP.finditer(text):
        edits += [(*d.span(), ".") for d in _SPACED_DOT.finditer(text, m.start(), m.end())]
    return _in_order(edits)


def _places(edits: list[tuple[int, int, str]]) -> list[int]:
    """Where the edits' new texts start in the text that they make."""
    out, moved = [], 0
    for start, end, new in edits:
        out.append(start + moved)
        moved += len(new) - (end - start)
    return out


def spans(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and those that only the rewritten text shows, or shows longer."""
    text = text or ""
    base = base_spans(text)
    new = Rewritten(text)
    new.apply(look_alike_edits(text))
    new.apply(spelled_edits(new.text))
    marked = marked_edits(new.text)
    new.apply(marked)
    new.apply(plain_edits(new.text, _places(marked)))
    if not new.layers:
        return base, []
    held = [[(s, e) for k, s, e in base if k == kind] for kind in range(len(KINDS))]  # in order, none overlap
    more = set()
    for kind, s, e in base_spans(new.text):
        s, e = new.source(s, e)
        k = bisect_right(held[kind], s, key=lambda x: x[0])
        if not k or held[kind][k - 1][1] < e:
            more.add((kind, s, e))
    return base, sorted(more)


def found(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, spans: array of (kind, start, end, base) by kind and start; ends are exclusive, both are code points."""
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])

    def find(batches):
        for batch in batches:
            out = []
            for x in batch.column(1):
                base, more = spans(x.as_py())
                both = sorted([(*s, True) for s in base] + [(*s, False) for s in more])
                out.append([{"kind": KINDS[k], "start": s, "end": e, "base": b} for k, s, e, b in both])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(item))], names=["doc_id", "spans"])

    schema = "doc_id long, spans array<struct<kind: string, start: long, end: long, base: boolean>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(find, schema)


def redact(text: str | None) -> str | None:
    """Every span as its kind in brackets; spans that overlap become one, named after the first."""
    if text is None:
        return None
    base, more = spans(text)
    out, at, end = [], 0, -1
    for s, e, kind in sorted((s, e, k) for k, s, e in base + more):
        if s < end:
            at = end = max(end, e)
            continue
        out += [text[at:s], f"[{KINDS[kind].upper()}]"]
        at = end = e
    return "".join(out) + text[at:]


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs, each text with its personal data replaced; the other columns as they are (counts of characters too, which then are those of the source).

    Null texts stay null; repeated rows are each redacted; very long texts are read whole; columns of any name pass through; an empty table gives an empty table.
    """
    place = docs.columns.index(text)

    def replace(batches):
        for batch in batches:
            columns = list(batch.columns)
            columns[place] = pa.array([redact(x.as_py()) for x in columns[place]], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.withColumn(text, F.col(text).cast("string")).mapInArrow(replace, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = found(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long")
    counts = [count(k).alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *counts, F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))
