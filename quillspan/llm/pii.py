"""Operator 1, personal data with offset-preserving deobfuscation.

The base detectors run over the text as it is. Beside them, transducers rewrite disguises and keep, for every character
that they put out, the source range it came from:

1. homoglyphs: look-alike letters, digits, points and at signs of other scripts become ASCII, invisible characters go;
2. separators: "(at)", " at ", "[dot]", " dot " and their like become "@" and ".", in addresses and between numerals;
3. spelled digits: runs of digit words ("plus", "double" and "dot" among them) become digits.

The same detectors run over what the transducers put out; a find that covers at least one rewritten character is mapped
back to source characters and added. Base spans always stay.

Defined cases: a null or empty text has no spans (digest of the empty string); repeated rows each get their row; other
columns are ignored; an empty table gives no rows; texts are never cut.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._common import join_spans, sha256_hex, table, texts

KINDS = {"email": 0, "ip": 1, "card": 2, "phone": 3}
Span = tuple[str, int, int]

LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# Possessive runs give the same matches as plain ones here and stay linear on long digit runs.
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def detect(text: str) -> list[Span]:
    """The base detectors: leftmost, non-overlapping per kind; a failing match is dropped and not tried again."""
    out: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if DIGITS.search(text):
        for m in IP.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x[-9:]) <= 255 for x in m.groups()):
                out.append(("ip", m.start(), m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                    out.append(("phone", m.start(), m.end()))
    return out


# Look-alikes by the ASCII character they stand for. Full-width and mathematical forms follow from their
# compatibility decomposition, other scripts' digits from their digit value.
LOOK_ALIKES = {
    "a": "аα", "b": "Ьв", "c": "сϲ", "d": "ԁ", "e": "еҽ", "g": "ɡ", "h": "һ", "i": "іıι", "j": "јϳ", "k": "кκ", "l": "ӏ", "m": "м", "n": "пη",
    "o": "оοօ", "p": "рρ", "q": "ԛ", "r": "г", "s": "ѕ", "t": "тτ", "u": "υս", "v": "νѵ", "w": "ԝѡ", "x": "хχ", "y": "уү", "z": "ᴢ",
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "J": "Ј", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ",
    "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "ҮΥ", "Z": "Ζ", ".": "。․‧｡", "-": "‐‑‒–—−", "@": "﹫", "+": "﹢",
}
INVISIBLE = "­​‌‍⁠﻿᠎"
SPACES = "             　"


def look_alike_map() -> dict[str, str]:
    out = {c: plain for plain, many in LOOK_ALIKES.items() for c in many} | dict.fromkeys(INVISIBLE, "") | dict.fromkeys(SPACES, " ")
    for first, last in ((0x2070, 0x209C), (0x2460, 0x24E9), (0xFF01, 0xFF5E), (0x1D400, 0x1D7FF)):
        for c in map(chr, range(first, last + 1)):
            if len(n := unicodedata.normalize("NFKC", c)) == 1:
                out.setdefault(c, n if n.isascii() else out.get(n, c))
    for c in map(chr, range(0x660, 0x11000)):
        if unicodedata.decimal(c, None) is not None:
            out.setdefault(c, str(unicodedata.decimal(c)))
    return {c: n for c, n in out.items() if c != n and n.isascii()}


PLAIN = look_alike_map()
LOOKS = frozenset(PLAIN)


class Tape:
    """Text with the source range of every character, and which characters are rewritten."""

    def __init__(self, text: str, starts: array, ends: array, changed: bytearray):
        self.text, self.starts, self.ends, self.changed = text, starts, ends, changed

    @classmethod
    def of(cls, text: str, start: int, end: int) -> Tape:
        return cls(text[start:end], array("q", range(start, end)), array("q", range(start + 1, end + 1)), bytearray(end - start))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Tape:
        """Replace ranges (in order, apart); what is put in stands for the whole range."""
        parts, starts, ends, changed, at = [], array("q"), array("q"), bytearray(), 0
        for a, b, new in [*edits, (len(self.text), len(self.text), "")]:
            parts += [self.text[at:a], new]
            starts += self.starts[at:a]
            ends += self.ends[at:a]
            changed += self.changed[at:a]
            if new:
                starts += array("q", [self.starts[a]]) * len(new)
                ends += array("q", [self.ends[b - 1]]) * len(new)
                changed += b"\1" * len(new)
            if not new and b > a and changed:
                changed[-1] = 1  # something invisible went after this character
            at = b
        return Tape("".join(parts), starts, ends, changed)

    def spans(self) -> list[Span]:
        return [(k, self.starts[a], self.ends[b - 1]) for k, a, b in detect(self.text) if any(self.changed[a:b])]


def plain_looks(tape: Tape) -> Tape:
    """The first transducer."""
    there = re.compile("[" + "".join(map(re.escape, LOOKS & set(tape.text))) + "]")
    return tape.rewrite([(m.start(), m.end(), PLAIN[m.group()]) for m in there.finditer(tape.text)])


# Endings that a spoken address is believed with; one with both separators in brackets may have any.
ENDINGS = "com|org|net|edu|gov|mil|int|info|biz|io|co|ai|app|dev|me|tv|test|example|invalid|local|uk|us|ca|au|de|fr|es|it|nl|eu|ch|at|be|se|no|dk|fi|pl|pt|ru|jp|cn|in|br|mx|ie|nz"
BRACKET_DOT = r"\s*[\[({<]\s*(?:dot|punkt|punto|point|\.)\s*[\])}>]\s*"
STRONG_DOT = rf"(?:{BRACKET_DOT}|\s+(?:dot|punkt|punto|point)\s+|[-_](?:dot)[-_])"
DOT = rf"(?:{STRONG_DOT}|\.|\x20\.\x20)"
LABEL = r"[a-z0-9](?:[a-z0-9]|-(?!dot-|at-))*"
HOST = re.compile(rf"{LABEL}(?:{DOT}{LABEL})*{DOT}(?:{ENDINGS})(?![a-z0-9@-])", re.I | re.A)
ANY_HOST = re.compile(rf"{LABEL}(?:(?:{BRACKET_DOT}|\.){LABEL})*{BRACKET_DOT}[a-z]{{2,63}}(?![a-z0-9@-])", re.I | re.A)
#: A local part read from its end: pieces apart by dots that are no characters of a piece, the farthest one with plain dots too.
OHW = re.compile(r"(?:[a-z0-9_%+-]++(?:\s*[\])}>]\s*(?:tod|tknup|otnup|tniop|\.)\s*[\[({<]\s*|\s+(?:tod|tknup|otnup|tniop)\s+))*[a-z0-9._%+-]++", re.I | re.A)
DOTS = re.compile(DOT, re.I | re.A)
STRONG_DOTS = re.compile(STRONG_DOT, re.I | re.A)
NUMERAL_DOTS = re.compile(rf"(?<=[0-9]){STRONG_DOT}(?=[0-9])", re.I | re.A)
BRACKET_AT = re.compile(r"[\[({<]\s*(?:at|@|arroba|arobase|a|ät)\s*[\])}>]", re.I)
SPOKEN_AT = re.compile(r"at(?=\s)|(?<=[-_])at(?=[-_])|arroba(?=\s)|arobase(?=\s)|&\#0*64;|&commat;|%40|@", re.I)
#: Where a spoken at can begin: a literal to look for, and how far into it the word starts.
AT_HINTS = ((" at ", 1), ("\nat ", 1), ("\tat ", 1), (" at\n", 1), ("-at-", 1), ("_at_", 1), (" arroba", 1), (" arobase", 1), ("&#", 0), ("&commat;", 0), ("%40", 0), ("@", 0))


def at_marks(text: str, low: str) -> list[tuple[int, int, str, re.Match]]:
    """Disguised (and plain) at signs that a host follows: range with the space around, the word, the host's match."""
    cores = [m.span() for m in BRACKET_AT.finditer(text)] if any(c in text for c in "[({<") else []
    if len(low) == len(text):
        for hint, inside in AT_HINTS:
            k = low.find(hint)
            while k >= 0:
                if m := SPOKEN_AT.match(text, k + inside):
                    cores.append(m.span())
                k = low.find(hint, k + 1)
    else:
        cores += [m.span() for m in SPOKEN_AT.finditer(text)]
    out = []
    for a, b in cores:
        core = text[a:b].lower()
        end = b
        if core in ("at",) and text[b] in "-_":
            a, end = a - 1, b + 1
        else:
            while end < len(text) and text[end].isspace():
                end += 1
        host = HOST.match(text, end)
        if text[a] in "[({<" and (whole := ANY_HOST.match(text, end)) and (not host or whole.end() > host.end()):
            host = whole
        if host:
            while a > 0 and text[a - 1].isspace():
                a -= 1
            out.append((a, end, core, host))
    return sorted(out, key=lambda x: (x[0], -x[1]))


def local_part(text: str, low: int, end: int) -> tuple[int, str] | None:
    """Start and text of the local part that ends at ``end``; more text is taken while it may go on."""
    size = 400
    while True:
        left = max(low, end - size)
        who = OHW.match(text[left:end][::-1])
        if not who or left == low or who.end() < size // 2:
            return (end - who.end(), text[end - who.end() : end]) if who else None
        size *= 2


def numeral_dots(tape: Tape) -> Tape | None:
    """The second transducer on numerals: rewrite the disguised dots between digits; None where there is none."""
    edits = [(m.start(), m.end(), ".") for m in NUMERAL_DOTS.finditer(tape.text)]
    return tape.rewrite(edits) if edits else None


def separators(tape: Tape, marks: list[tuple[int, int, str, re.Match]]) -> Tape | None:
    """The second transducer: rewrite the at and the dots of disguised addresses; None where there is none."""
    text = tape.text
    edits: list[tuple[int, int, str]] = []
    done = 0
    for a, b, core, host in marks:
        if a < done or not (found := local_part(text, done, a)):
            continue
        begun, who = found
        dots = [(b + d.start(), b + d.end(), ".") for d in DOTS.finditer(host.group())]
        inner = [(begun + d.start(), begun + d.end(), ".") for d in STRONG_DOTS.finditer(who)]
        if not inner and all(d[1] - d[0] == 1 for d in dots):
            if b - a == 1 and core == "@":
                continue  # no disguise
            if core in ("at", "arroba", "arobase") and not re.search(r"[0-9._+-]", who):
                continue  # "look at example.com" is prose
        edits += [*inner, (a, b, "@"), *(d for d in dots if d[1] - d[0] > 1)]
        done = host.end()
    return tape.rewrite(edits) if edits else None


# Digit words.
WORDS = {
    "zero": "0", "oh": "0", "nought": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
}
SIGNS = {"plus": "+", "dot": ".", "point": ".", "punkt": ".", "punto": ".", "dash": "-", "hyphen": "-", "minus": "-", "space": " "}
TIMES = {"double": 2, "triple": 3}
UNIT = "|".join(sorted([*WORDS, *SIGNS, *TIMES], key=len, reverse=True))
RUN = re.compile(rf"(?<!\w)\+?(?:(?:{UNIT}|[0-9]+)(?:[\s,;()./+-]+|(?!\w)|(?<=[0-9])(?![0-9]))){{4,}}", re.I)
UNITS = re.compile(rf"(?<!\w)(?:{UNIT})(?!\w)", re.I)
GAP = re.compile(r"[\s,;]+")
NEXT = re.compile(rf"[\W_]++(?:{UNIT}|[0-9]+)(?![^\W_])")


def digit_words(low: str) -> bool:
    """Whether a digit word stands before another one or a digit, in a lower-cased text."""
    for word in WORDS:
        k = low.find(word)
        while k >= 0:
            if NEXT.match(low, k + len(word)):
                return True
            k = low.find(word, k + 1)
    return False


def spelled(tape: Tape) -> list[Tape]:
    """The third transducer: every run of digit words, rewritten."""
    if not digit_words(tape.text.lower()):
        return []
    out = []
    for run in RUN.finditer(tape.text):
        units = list(UNITS.finditer(run.group()))
        if sum(u.group().lower() in WORDS for u in units) < 3:
            continue
        a, b = run.start(), run.end()
        piece = Tape(tape.text[a:b], tape.starts[a:b], tape.ends[a:b], tape.changed[a:b])
        edits, times = [], 1
        for u in units:
            word = u.group().lower()
            if word in TIMES:
                times = TIMES[word]
                edits.append((u.start(), u.end(), ""))
            else:
                edits.append((u.start(), u.end(), WORDS[word] * times if word in WORDS else SIGNS[word]))
                times = 1
        piece = piece.rewrite(edits)
        # Between digits of one number the gaps go; a sign's own gaps go with it.
        out.append(piece.rewrite([(m.start(), m.end(), "") for m in GAP.finditer(piece.text) if m.end() < len(piece.text)]))
    return out


def find(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and the spans that the transducers add."""
    base = detect(text)
    looks = not text.isascii() and not LOOKS.isdisjoint(text)
    low = text.lower()
    marks = [] if looks else at_marks(text, low)
    if not looks and all(m[2] == "@" and m[1] - m[0] == 1 and not STRONG_DOTS.search(m[3].group()) and text[m[0] - 1] not in ")]}> " for m in marks) and not (digit_words(low) and RUN.search(text)) and not NUMERAL_DOTS.search(text):
        return base, []
    tape = Tape.of(text, 0, len(text))
    found: list[Span] = []
    if looks:
        tape = plain_looks(tape)
        found += tape.spans()
        marks = at_marks(tape.text, tape.text.lower())
    if (rewritten := separators(tape, marks)) is not None:
        found += rewritten.spans()
    if (rewritten := numeral_dots(tape)) is not None:
        found += rewritten.spans()
    for piece in spelled(tape):
        found += piece.spans()
    known = set(base)
    by_kind: dict[str, list[Span]] = {}
    added = []
    for span in sorted(set(found), key=lambda s: (KINDS[s[0]], s[1], -s[2])):
        # A find inside one that is known says nothing new; spans of a kind come in order, so the last one decides.
        last = by_kind.get(span[0])
        if span in known or last and last[1] <= span[1] and span[2] <= last[2]:
            continue
        by_kind[span[0]] = span
        added.append(span)
    return base, added


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id``, base counts, ``base_spans`` and ``spans`` of every whole text."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: list[list[int]] = [[], [], [], []]
            base_text, all_text = [], []
            for text in b.column("text").to_pylist():
                base, added = find(text)
                n = [0, 0, 0, 0]
                for kind, _, _ in base:
                    n[KINDS[kind]] += 1
                for column, x in zip(counts, n):
                    column.append(x)
                base_text.append(join_spans(base, KINDS))
                all_text.append(join_spans(base + added, KINDS) if added else base_text[-1])
            yield pa.record_batch([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(base_text, pa.string()), pa.array(map(sha256_hex, base_text), pa.string()), pa.array(all_text, pa.string())], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_spans", "base_sha256", "spans"])

    return texts(docs).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_spans string, base_sha256 string, spans string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("base_spans")
