"""Personal data with offset-preserving deobfuscation.

Identifiers are detected in the text as it is (base spans), and again in a normalised text.  The normalised text comes
from a chain of transducers that replace look-alike characters, spelled digits and disguised "at" and "dot"; each
keeps, for every character it writes, the range of source characters that it stands for.  Spans found in the
normalised text that rest on a replaced character are mapped back and added.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import query, table

KINDS = ("email", "ip", "card", "phone")

_EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
_DOTTED = re.compile(r"[0-9][0-9.]*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[str, int, int]


def emails(text: str) -> list[Span]:
    """Leftmost non-overlapping addresses: the characters before each @ that may belong to one, and a domain after it."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in _EMAIL_LOCAL:
            begin -= 1
        domain = _EMAIL_DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            out.append(("email", begin, domain.end()))
            free = domain.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, free))
    return out


def addresses(text: str) -> list[Span]:
    """Four dotted numbers; those with a number over 255 are dropped."""
    out = []
    for run in _DOTTED.finditer(text):
        if run.group().count(".") < 3:
            continue
        at, parts = run.start(), []
        for part in run.group().split("."):
            parts.append((part, at, at + len(part)))
            at += len(part) + 1
        i = 0
        while i + 3 < len(parts):
            four = parts[i : i + 4]
            if all(p for p, _, _ in four):
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p, _, _ in four):
                    out.append(("ip", four[0][1], four[3][2]))
                i += 4
            else:
                i += 1
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def cards(text: str) -> list[Span]:
    out = []
    for m in _CARD.finditer(text):
        digits = _digits(m.group()) if len(m.group()) <= 40 else ""
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    return out


def phones(text: str) -> list[Span]:
    return [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]


def detect(text: str) -> list[Span]:
    """Spans by kind as listed, then start."""
    spans = emails(text) if "@" in text else []
    if _DIGIT.search(text):
        spans += addresses(text) + cards(text) + phones(text)
    return spans


#: Look-alikes of Latin letters: each character of the first string stands for the one below it.
_LOOKALIKES = str.maketrans(
    "АВЕЅІЈКМНОРСТХУаеіјорсухѕһԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧοιαυνκρβѵոսօɑɡı",
    "ABESIJKMHOPCTXYaeijopcyxshdqwABEZHIKMNOPTYXoiauvkpbvnuoagi",
)
_ZERO_WIDTH = "­​‌‍‎‏⁠﻿"
_DASHES = "‐‑‒–—−"
_SPACES = "      　"
_DOTS = "․。．·•"
#: Zero digits of other scripts; nine more follow each.
_ZEROS = "٠۰०০๐０\U0001d7ce\U0001d7d8\U0001d7e2\U0001d7ec\U0001d7f6"
#: Spelled digits in four languages, 0 to 9.
_SPELLED = {
    w: str(i)
    for words in (
        "zero one two three four five six seven eight nine", "null eins zwei drei vier fünf sechs sieben acht neun",
        "zéro un deux trois quatre cinq six sept huit neuf", "cero uno dos tres cuatro cinco seis siete ocho nueve",
    )
    for i, w in enumerate(words.split())
} | {"oh": "0", "ein": "1", "zwo": "2"}


def _character_table() -> dict[int, str]:
    out = {k: chr(v) for k, v in _LOOKALIKES.items()}
    out |= {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
    out |= {ord(c): "" for c in _ZERO_WIDTH} | {ord(c): "-" for c in _DASHES} | {ord(c): " " for c in _SPACES} | {ord(c): "." for c in _DOTS}
    out |= {ord(z) + i: str(i) for z in _ZEROS for i in range(10)}
    for first, letter in ((0x1D400, "A"), (0x1D41A, "a")):  # letters of thirteen mathematical alphabets, 52 apart
        out |= {first + 52 * style + i: chr(ord(letter) + i) for style in range(13) for i in range(26)}
    return out


_CHARACTERS = _character_table()
#: Characters that may be in the table; most letters of Latin scripts are not, so most texts are passed over quickly.
_ODD = re.compile("[\xa0\xad\xb7\u0131\u0251\u0261\u0300-\U0010ffff]")
_WORD_DIGIT = "(?:" + "|".join(sorted(_SPELLED, key=len, reverse=True)) + ")"
#: Spelled digits, possibly among written ones; "plus" before them counts.
_SPELLED_RUN = re.compile(
    rf"(?<!\w)(?:plus[\s-]+)?(?:(?:{_WORD_DIGIT}|[0-9]+|dot|point)(?!\w)[\s,-]*)+", re.IGNORECASE)
_HAS_SPELLED = re.compile(rf"(?<!\w){_WORD_DIGIT}(?!\w)", re.IGNORECASE)
#: From so many spelled digits on, all numbers of a run are read as one.
_ONE_NUMBER = 4
#: Marks without the space before them, which is found backwards from the mark.
_AT = r"(?:\[\s*(?:at|@|arroba|ät)\s*\]|\(\s*(?:at|@|arroba|ät)\s*\)|\{\s*(?:at|@|arroba|ät)\s*\}|<\s*(?:at|arroba|ät)\s*>)\s*"
_DOT = r"(?:\[\s*(?:dot|\.|punkt|point|punto)\s*\]|\(\s*(?:dot|\.|punkt|point|punto)\s*\)|\{\s*(?:dot|\.|punkt|point|punto)\s*\})\s*"
_MARKED_AT, _MARKED_DOT = re.compile(_AT, re.IGNORECASE), re.compile(_DOT, re.IGNORECASE)
_HAS_MARK = re.compile(r"[\[({<]\s*(?:at|@|arroba|ät|dot|\.|punkt|point|punto)\s*[\])}>]", re.IGNORECASE)
_LABEL = r"[A-Za-z0-9_%+-]+"
_DOT_WORD = r"(?:\x20dot\x20|\x20punkt\x20|\x20punto\x20|\x20point\x20)"
#: After a written dot only a well-known end is taken for a host, since "at" and "dot" are words as well.
_ENDS = "(?:com|org|net|edu|gov|mil|int|info|biz|name|dev|app|io|co|ai|me|tv|eu|us|uk|ca|au|nz|in|de|at|ch|fr|be|es|pt|it|nl|pl|ru|br|mx|jp|cn|kr|example|test)"
#: After a word for the dot any two letters or more are, but for words that often follow the noun and are no ends of hosts.
_NO_ENDS = "(?:and|or|the|that|this|of|on|with|was|were|und|oder|der|die|das|et|ou|les|los|las)"
#: What can stand between name and host; a search from each of them outwards reads every word at most twice.
_AT_WORD = re.compile(r"(?=(\x20at\x20|\x20arroba\x20|@))", re.IGNORECASE)
#: at host dot end, with bare words
_HOST = re.compile(
    rf"(?:\x20at\x20|\x20arroba\x20|@)(?:{_LABEL}(?:{_DOT_WORD}|\.))*{_LABEL}"
    rf"(?:{_DOT_WORD}(?!{_NO_ENDS}(?![\w-]))[A-Za-z]{{2,}}|(?:{_DOT_WORD}|\.){_ENDS})(?![\w-])", re.IGNORECASE)
_DOT_WORDS = (" dot ", " punkt ", " punto ", " point ")
_LABEL_CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_%+-")
#: dotted numbers with a word for the dot
_NUMBER_DOT = re.compile(rf"(?<=[0-9]){_DOT_WORD}(?=[0-9])", re.IGNORECASE)
#: a word for the dot, or one for the at before a host with a written dot: every edit of bare words has one
_HAS_BARE = re.compile(rf"\x20(?:(?:dot|punkt|punto|point)\x20|(?:at|arroba)\x20{_LABEL}\.)", re.IGNORECASE)
_BARE_AT, _BARE_DOT = re.compile(r"\x20(?:at|arroba)\x20", re.IGNORECASE), re.compile(_DOT_WORD, re.IGNORECASE)
_WORD_BEFORE = re.compile(r"(?<!\w)(?:at|arroba|dot|punkt|punto|point)$", re.IGNORECASE)
_WORD_AFTER = re.compile(r"(?:at|arroba|dot|punkt|punto|point)(?!\w)", re.IGNORECASE)
_LETTER_DIGIT = re.compile(r"(?<=[0-9])[OoIl|]+(?=[0-9])")


@dataclass
class Normalised:
    """A text and, for each of its characters, the range of source characters it stands for."""

    text: str
    starts: list[int]
    ends: list[int]
    changed: list[bool]

    @staticmethod
    def of(text: str) -> Normalised:
        return Normalised(text, list(range(len(text))), list(range(1, len(text) + 1)), [False] * len(text))

    def rewritten(self, edits: list[tuple[int, int, str]]) -> Normalised:
        """The text with ranges replaced; every written character stands for the whole range that it replaces."""
        if not edits:
            return self
        text, starts, ends, changed, at = [], [], [], [], 0
        for a, b, new in edits:
            text.append(self.text[at:a])
            starts += self.starts[at:a]
            ends += self.ends[at:a]
            changed += self.changed[at:a]
            if new:
                text.append(new)
                starts += [self.starts[a]] * len(new)
                ends += [self.ends[b - 1]] * len(new)
                changed += [True] * len(new)
            elif changed:
                # a removed character belongs to the one before it, if that is read at all
                changed[-1] = True
            at = b
        return Normalised("".join([*text, self.text[at:]]), starts + self.starts[at:], ends + self.ends[at:], changed + self.changed[at:])

    def source(self, begin: int, end: int) -> tuple[int, int]:
        return min(self.starts[begin:end]), max(self.ends[begin:end])


def _alone(text: str, begin: int, end: int) -> bool:
    """Whether nothing beside a run can belong to the same identifier: no digit, sign, at or dot after the space."""
    while begin and (text[begin - 1].isspace() or text[begin - 1] == ","):
        begin -= 1
    while end < len(text) and (text[end].isspace() or text[end] == ","):
        end += 1
    near = text[begin - 1 : begin] + text[end : end + 1]
    return not any(c in "0123456789.@+()_%|-" for c in near) and not _WORD_BEFORE.search(text, max(0, begin - 8), begin) and not _WORD_AFTER.match(text, end)


def _spelled_edits(text: str, least: int = 1) -> list[tuple[int, int, str]]:
    """Digits for the words of each run with ``least`` spelled digits; under four, space between written numbers stays."""
    edits = []
    for run in _SPELLED_RUN.finditer(text):
        words = [(m.group().lower(), run.start() + m.start(), run.start() + m.end()) for m in re.finditer(r"\w+", run.group())]
        if sum(word in _SPELLED for word, _, _ in words) < least:
            continue
        # an identifier has four digits at least
        if sum(len(_SPELLED.get(word, word)) for word, _, _ in words if word in _SPELLED or word[0] in "0123456789") < 4 and _alone(text, words[0][1], words[-1][2]):
            continue
        previous = None
        for word, a, b in words:
            new = _SPELLED.get(word, {"plus": "+", "dot": ".", "point": "."}.get(word))
            if previous is not None and previous[0] < a and (least >= _ONE_NUMBER or new is not None or previous[1]):
                edits.append((previous[0], a, ""))
            if new is not None:
                edits.append((a, b, new))
            previous = b, new is not None
    return edits


def _name_start(text: str, end: int, least: int) -> int:
    """Where the name that ends at ``end`` begins, not before ``least``, or -1: labels with dots of either kind between them.

    It begins as early as it can after something that is neither a letter, a digit nor a dot.
    """
    best, at = -1, end
    while True:
        stop = at
        while at > least and text[at - 1] in _LABEL_CHARACTERS:
            at -= 1
        if at == stop:
            return best
        for i in range(at, stop):
            if not i or not (text[i - 1].isalnum() or text[i - 1] in "_."):
                best = i
                break
        if at > least and text[at - 1] == ".":
            at -= 1
            continue
        for word in _DOT_WORDS:
            if at - len(word) >= least and text[at - len(word) : at].lower() == word:
                at -= len(word)
                break
        else:
            return best


def _bare_names(text: str):
    """(begin, end) of names at hosts with bare words, from left to right without overlaps."""
    done = 0
    for m in _AT_WORD.finditer(text):
        a = m.start()
        if a <= done or text[a - 1] not in _LABEL_CHARACTERS:
            continue
        host = _HOST.match(text, a)
        begin = _name_start(text, a, done) if host else -1
        if begin >= 0:
            done = host.end()
            yield begin, done


def _bare_edits(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for begin, end in _bare_names(text):
        found = text[begin:end]
        inner = [(x.start(), x.end(), "@") for x in _BARE_AT.finditer(found)] + [(x.start(), x.end(), ".") for x in _BARE_DOT.finditer(found)]
        if sum(new == "@" for _, _, new in inner) + found.count("@") == 1:
            edits += [(begin + a, begin + b, new) for a, b, new in inner]
    taken = {a for a, _, _ in edits}
    edits += [(m.start(), m.end(), ".") for m in _NUMBER_DOT.finditer(text) if m.start() not in taken]
    return sorted(edits)


def _character_edits(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), _CHARACTERS[ord(m.group())]) for m in _ODD.finditer(text) if ord(m.group()) in _CHARACTERS]


def _marked_edits(text: str) -> list[tuple[int, int, str]]:
    edits = [(m.start(), m.end(), "@") for m in _MARKED_AT.finditer(text)] + [(m.start(), m.end(), ".") for m in _MARKED_DOT.finditer(text)]
    last, apart = 0, []
    for begin, end, new in sorted(edits):
        while begin > last and text[begin - 1].isspace():
            begin -= 1
        apart.append((begin, end, new))
        last = end
    return apart


def _letter_edits(text: str) -> list[tuple[int, int, str]]:
    swap = str.maketrans("OoIl|", "00111")
    return [(m.start(), m.end(), m.group().translate(swap)) for m in _LETTER_DIGIT.finditer(text)]


#: The transducers in order, each with a test that holds for every text in which it has something to replace.
_CHAIN = (
    (_ODD, _character_edits), (_HAS_MARK, _marked_edits), (_HAS_SPELLED, _spelled_edits), (_HAS_BARE, _bare_edits),
    (_LETTER_DIGIT, _letter_edits),
)


def _transduced(n: Normalised | None, text: str, chain) -> tuple[Normalised | None, str]:
    for test, edits in chain:
        if test.search(text):
            found = edits(text)
            if found:
                n = (n or Normalised.of(text)).rewritten(found)
                text = n.text
    return n, text


def normalise(text: str) -> list[Normalised]:
    """The normalised texts, none where no transducer has anything to replace.

    A spelled digit beside a number may belong to it or not, so there are up to three readings: no spelled digits,
    those of runs that hold at least four, and all.
    """
    begun, text = _transduced(None, text, _CHAIN[:2])
    readings = [[]]
    if _HAS_SPELLED.search(text):
        every = _spelled_edits(text)
        for found in [every, _spelled_edits(text, _ONE_NUMBER)] if every else []:
            if found not in readings:
                readings.append(found)
    out = []
    for found in readings:
        n = (begun or Normalised.of(text)).rewritten(found) if found else begun
        n, _ = _transduced(n, n.text if n else text, _CHAIN[3:])
        if n:
            out.append(n)
    return out


def find_spans(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans and all spans, each by kind as listed, then start; offsets count code points, ends are exclusive."""
    if not text:
        return [], []
    base = detect(text)
    known = {k: [(a, b) for kind, a, b in base if kind == k] for k in KINDS}
    more = set()
    for n in normalise(text):
        for kind, a, b in detect(n.text):
            if not any(n.changed[a:b]):
                continue
            begin, end = n.source(a, b)
            if not any(x <= begin and end <= y for x, y in known[kind]):
                more.add((kind, begin, end))
    every = sorted({*base, *more}, key=lambda s: (KINDS.index(s[0]), s[1], s[2])) if more else base
    return base, every


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


_FOUND = "struct<" + ",".join(f"n_{k}:bigint" for k in KINDS) + ",base_sha256:string,spans:string,n_added:bigint>"


def personal_data(text: Column) -> Column:
    """Struct: base spans per kind, digest of the base spans, all spans as text, number of spans added."""

    @F.pandas_udf(_FOUND)
    def find(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            base, every = find_spans(t)
            counts = [sum(s[0] == k for s in base) for k in KINDS]
            rows.append((*counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every), len(every) - len(base)))
        return pd.DataFrame(rows, columns=[*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    return find(text)


def mask(docs: DataFrame, text_col: str = "text", label: str = "<{kind}>") -> DataFrame:
    """``docs`` with every span (of overlapping ones, the union) replaced by a label of its first kind."""

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            merged: list[list] = []
            for kind, a, b in sorted(find_spans(t)[1], key=lambda s: (s[1], s[2])):
                if merged and a < merged[-1][2]:
                    merged[-1][2] = max(b, merged[-1][2])
                else:
                    merged.append([kind, a, b])
            for kind, a, b in reversed(merged):
                t = t[:a] + label.format(kind=kind) + t[b:]
            out.append(t)
        return pd.Series(out, dtype=object)

    return docs.withColumn(text_col, masked(F.col(text_col)))


@query("op6_personal_data")
def op6(spark, d):
    """Personal data in every document."""
    docs = table(spark, d, "documents").select("doc_id", personal_data(F.col("text")).alias("found"))
    return docs.select("doc_id", *(f"found.n_{k}" for k in KINDS), "found.base_sha256", "found.spans", "found.n_added")
