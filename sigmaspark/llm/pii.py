"""Personal data in whole texts, with disguises undone and every span given in source characters.

Two passes over a text. The base pass finds e-mail addresses, IP addresses, card numbers and
phone numbers in the text as it stands. The second pass runs transducers that rewrite
homoglyphs, spelled digits and at/dot disguises; they give a normalised text and, piece by
piece, which source characters each part came from. The same detectors then run over the
normalised text, and what they find through a rewritten piece is mapped back to the source. A
span of the second pass that touches a base span of its kind is left out, so base spans stay.

A text with nothing to rewrite skips the second pass; the trigger patterns match wherever a
transducer could act.

Defined results: a null text is empty and has no spans; offsets are code points, ends
exclusive; repeated rows each get their own result; extra columns don't matter.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can only begin where a run of digits does, as one before it takes its last run whole; so runs are read once.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile("[^0-9]+")


def luhn(digits: str) -> bool:
    total = sum(int(d) if i % 2 == 0 else (2 * int(d)) % 10 + (d > "4") for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def detect(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of each identifier: per kind the leftmost ones that don't overlap, failing ones dropped."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            done = m.end()
            out.append((start, done, "email"))
        at = text.find("@", max(at + 1, done))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((*m.span(), "ip"))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := DIGITS.sub("", m[0])) <= 19 and luhn(d):
            out.append((*m.span(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(DIGITS.sub("", m[0])) <= 15:
                out.append((*m.span(), "phone"))
    return out


# Number words of four languages, and Greek and Cyrillic letters that look like Latin ones.
DIGIT_WORDS = {
    "0": "zero oh null cero zéro", "1": "one un une eins uno", "2": "two deux zwei zwo dos", "3": "three trois drei tres",
    "4": "four quatre vier cuatro", "5": "five cinq fünf cinco", "6": "six sechs seis", "7": "seven sept sieben siete",
    "8": "eight huit acht ocho", "9": "nine neuf neun nueve",
}
LOOKALIKES = dict(zip("АВЕЅІЈКМНОРСТУХаеѕіјорсухһԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧονρіı", "ABESIJKMHOPCTYXaesijopcyxhdqwABEZHIKMNOPTYXovpii"))
HIDDEN = "­​‌‍⁠﻿"

WORD_DIGIT = {w: d for d, ws in DIGIT_WORDS.items() for w in ws.split()}
FOLDED = {0x17F: "s", 0x307: None}  # long s and the dot of a capital dotted i, which re.I takes for s and i


def _glyphs() -> dict[str, str]:
    """What each look-alike character stands for: one plain ASCII character, or nothing if it is hidden."""
    out = {c: "" for c in HIDDEN} | LOOKALIKES | {c: "-" for c in "‐‑‒–—−"}
    for lo, hi in ((0x660, 0x66A), (0x6F0, 0x6FA), (0x966, 0x970), (0x2000, 0x200B), (0x202F, 0x2030), (0x2024, 0x2025), (0x2070, 0x208A), (0x2460, 0x2474), (0x24B6, 0x24EA), (0xFE52, 0xFE53), (0xFE62, 0xFE6C), (0xFF01, 0xFF5F), (0x1D400, 0x1D800), (0xA0, 0xA1), (0x3002, 0x3003), (0xFF61, 0xFF62)):
        for c in map(chr, range(lo, hi)):
            plain = unicodedata.normalize("NFKC", c)
            d = unicodedata.digit(c, None)
            if c in "。｡":
                plain = "."
            elif d is not None:
                plain = str(d)
            if len(plain) == 1 and plain.isascii():
                out[c] = plain
    return out


GLYPHS = _glyphs()
GLYPH = re.compile("[" + "".join(map(re.escape, GLYPHS)) + "]")
_W = "|".join(sorted(WORD_DIGIT, key=len, reverse=True))
RUN = re.compile(rf"(?<!\w)(?:plus[ -]+)?(?:{_W}|[0-9]+)(?:[ ,-]+(?:(?:dot|point|punkt)[ ]+)?(?:{_W}|[0-9]+))+(?!\w)", re.I)
RUN_WORD = re.compile(rf"({_W})|[0-9]+|(plus)|(dot|point|punkt)", re.I)
# Endings that make "name at host dot ending" an address.
ENDINGS = "com|org|net|edu|gov|info|biz|example|test|invalid|io|ai|app|dev|co|uk|us|ca|eu|de|fr|es|it|nl|ch|at|be|pl|pt|mx|ar|br|in|jp|cn|ru|me|tv"
_SEP = r"(?:\s{1,4}dot\s{1,4}|\s{0,4}[\[({<]\s{0,4}(?:dot|punkt|punto|point|\.)\s{0,4}[\])}>]\s{0,4})"
AT = re.compile(
    r"\s{0,4}[\[({<]\s{0,4}(?:at|@|arroba|arobase|chez|ät)\s{0,4}[\])}>]\s{0,4}|(?<=\w)(?:_at_|-at-)(?=\w)"
    rf"|(?<=\w)\s{{1,4}}at\s{{1,4}}(?=[a-z0-9-]+(?:(?:{_SEP}|\.)[a-z0-9-]+)*{_SEP}(?:{ENDINGS})(?!\w))"
    r"|&#64;|&commat;|%40|(?<=\w)\s{1,4}@\s{0,4}(?=\w)|(?<=\w)@\s{1,4}(?=\w)",
    re.I,
)
DOT = re.compile(r"\s{0,4}[\[({<]\s{0,4}(?:dot|punkt|punto|point|\.)\s{0,4}[\])}>]\s{0,4}|(?<=\w)(?:_dot_|-dot-)(?=\w)|(?<=\w)\s{1,4}dot\s{1,4}(?=\w)|&#46;", re.I)
ZERO_ONE = re.compile(r"(?<=[0-9])[OoIl|]+(?=[0-9])")
class Mapped:
    """A text together with the source place of its pieces; each transducer rewrites it once."""

    def __init__(self, text: str):
        self.text = text
        self.starts, self.source, self.changed = [0], [(0, len(text))], [False]

    def back(self, start: int, end: int) -> tuple[int, int, bool]:
        """Source span of [start, end), and whether a rewritten piece takes part in it."""
        i, j = bisect_right(self.starts, start) - 1, bisect_right(self.starts, end - 1) - 1
        a = self.source[i][0] + (0 if self.changed[i] else start - self.starts[i])
        b = self.source[j][1] if self.changed[j] else self.source[j][0] + end - self.starts[j]
        return a, b, any(self.changed[i : j + 1])

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace spans of the current text, given in order and apart from each other."""
        if not edits:
            return
        text, starts, source, changed, size, at = [], [], [], [], 0, 0

        def keep(a: int, b: int) -> None:
            nonlocal size
            i = bisect_right(self.starts, a) - 1
            while a < b:
                stop = min(b, self.starts[i + 1] if i + 1 < len(self.starts) else len(self.text))
                if stop > a:
                    whole = self.changed[i]
                    src = self.source[i] if whole else (self.source[i][0] + a - self.starts[i], self.source[i][0] + stop - self.starts[i])
                    starts.append(size), source.append(src), changed.append(whole)
                    text.append(self.text[a:stop])
                    size += stop - a
                a, i = stop, i + 1

        for a, b, new in edits:
            keep(at, a)
            if new:
                s, e, _ = self.back(a, b)
                starts.append(size), source.append((s, e)), changed.append(True)
                text.append(new)
                size += len(new)
            elif changed and source and size:  # a dropped character marks the piece before it
                pass
            at = b
        keep(at, len(self.text))
        self.text, self.starts, self.source, self.changed = "".join(text), starts or [0], source or [(0, 0)], changed or [False]


def spelled(m: re.Match) -> str | None:
    """A run of number words as digits; None if fewer than three of its words are spelled."""
    out, words = [], 0
    for w in RUN_WORD.finditer(m[0]):
        words += w[1] is not None
        out.append(WORD_DIGIT[w[1].lower().translate(FOLDED)] if w[1] else "+" if w[2] else "." if w[3] else w[0])
    return "".join(out) if words >= 3 else None


def normalised(text: str) -> Mapped:
    t = Mapped(text)
    glyphs = [(m.start(), m.end(), GLYPHS[m[0]]) for m in GLYPH.finditer(t.text)]
    t.rewrite(glyphs)
    t.rewrite([(*m.span(), new) for m in RUN.finditer(t.text) if (new := spelled(m)) is not None])
    t.rewrite([(*m.span(), "@") for m in AT.finditer(t.text)])
    t.rewrite([(*m.span(), ".") for m in DOT.finditer(t.text)])
    t.rewrite([(*m.span(), "".join("0" if c in "Oo" else "1" for c in m[0])) for m in ZERO_ONE.finditer(t.text)])
    return t


BRACKETED = re.compile(r"[\[({<]\s{0,4}(?:at|@|arroba|arobase|chez|ät|dot|punkt|punto|point|\.)\s{0,4}[\])}>]", re.I)
SPACED_AT = re.compile(r"\s@|@\s")
MIXED = re.compile(r"[0-9][OoIl|]")
MARKS = ("_at_", "-at-", "_dot_", "-dot-", " dot ", "\ndot ", " dot\n", "&#64;", "&#46;", "&commat;", "%40")
GLYPH_SET = frozenset(GLYPHS)
# Of three number words in a run one stands between blanks, commas or hyphens alone.
BETWEEN = str.maketrans(",-", "  ") | FOLDED
SPELLED = frozenset(WORD_DIGIT)


def hinted(text: str) -> bool:
    """Whether any transducer could act: cheap tests that hold wherever one of the patterns matches."""
    low = text.lower()
    return (
        (not text.isascii() and not GLYPH_SET.isdisjoint(text))
        or any(m in low for m in MARKS)
        or ("dot" in low and re.search(r"\sdot\s", low) is not None)
        or (any(c in text for c in "[({<") and BRACKETED.search(text) is not None)
        or ("@" in text and SPACED_AT.search(text) is not None)
        or MIXED.search(text) is not None
        or (not SPELLED.isdisjoint(low.translate(BETWEEN).split(" ")) and any(spelled(m) is not None for m in RUN.finditer(text)))
    )


def spans(text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans and added spans of a text."""
    if not text:
        return [], []
    base = detect(text)
    if not hinted(text):
        return base, []
    t, added = normalised(text), []
    taken = {k: sorted((a, b) for a, b, x in base if x == k) for k in KINDS}
    for a, b, kind in detect(t.text):
        s, e, changed = t.back(a, b)
        if not changed:  # a hidden character may have been dropped inside
            changed = e - s != b - a
        near = taken[kind]
        i = bisect_right(near, (s, e))
        if changed and not (i and near[i - 1][1] > s) and not (i < len(near) and near[i][0] < e):
            added.append((s, e, kind))
    return base, added


SPAN = "array<struct<kind:string,start:int,end:int>>"


def find(df: DataFrame, text: str = "text") -> DataFrame:
    """doc_id with ``base`` and ``added``: arrays of (kind, start, end), by start and then kind."""
    kind_no = {k: i for i, k in enumerate(KINDS)}

    def run(batches):
        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            got = [spans(x) for x in b.column(1).to_pylist()]
            rows = [[[{"kind": k, "start": s, "end": e} for s, e, k in sorted(x, key=lambda y: (y[0], kind_no[y[2]]))] for x in side] for side in zip(*got)] if got else [[], []]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows[0], span), pa.array(rows[1], span)], names=["doc_id", "base", "added"])

    return small_batches(df).select("doc_id", F.col(text)).mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, base {SPAN}, added {SPAN}")


def _joined(col: Column) -> Column:
    return F.array_join(F.transform(col, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("every", lambda x: x["kind"] == kind))


def report(df: DataFrame) -> DataFrame:
    """Counts per kind, the digest of the base spans and the list of all spans; one row per document."""
    found = find(df)
    every = F.array_sort(
        F.concat("base", "added"),
        lambda x, y: F.when(x["start"] != y["start"], F.when(x["start"] < y["start"], -1).otherwise(1)).otherwise(
            F.array_position(F.lit(list(KINDS)), x["kind"]).cast("int") - F.array_position(F.lit(list(KINDS)), y["kind"]).cast("int")
        ),
    )
    every = F.when(F.size("added") == 0, F.col("base")).otherwise(every)
    found = found.withColumn("every", every)
    return found.select(
        "doc_id",
        *(_count(k).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("every")).alias("spans"),
    )
