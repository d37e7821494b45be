"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, URL schemes and the
cue words of identifiers. At each anchor a local parser looks only at the characters around it: it
expands to the boundaries of an email, a number, an address or an account, and validates what
it found (parts of an IP address, digit counts, check digits). Text without an anchor is never
looked at again, and every parser moves on from where its last find ended, so a text is read
in time linear in its length, however many anchors it holds.

A find is a span ``(kind, start, stop)`` in code points, end exclusive. Base kinds are the leftmost
non-overlapping matches of the contract's patterns that pass their check:

- ``email``, ``ip``, ``card`` (Luhn), ``phone``.

Further kinds need a scheme or a cue word before them, so that plain numbers and words stay:

- ``login``: a URL with user info (``scheme://user:word@host``),
- ``iban``: after ``iban``; mod-97 check digits,
- ``account``: 8 to 17 digits after ``account`` or ``acct`` and a colon or ``#``,
- ``ssn``: after ``ssn`` or ``social security``; areas and groups that are never given out do not count.

Defined cases: null or empty text has no finds; repeated rows and equal texts get equal finds;
finds of different kinds may overlap and are all reported; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonality.llm.common import arrow_map, texts, worker_state

SPANS = "array<struct<start:int,rank:int,kind:string,stop:int>>"
DIGITS = "0123456789"
# Fixed value: characters of the part of an email before the at-sign.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# Right-hand expansions. Possessive, as no shorter piece of a run could be followed by what comes next.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
NUMBER = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
USER = re.compile(r"[A-Za-z0-9._~%!$&'()*+,;=:-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+")
AFTER_IBAN = re.compile(r"[\x20:#]{0,3}([A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?))\b", re.ASCII)
AFTER_ACCOUNT = re.compile(r"(?:\x20(?:number|no\.?|nr\.?))?\x20*+[:#]\x20*+([0-9](?:[\x20-]?[0-9])++)")
AFTER_SSN = re.compile(r"(?:\x20number)?[\x20:#]{0,3}([0-9]{3}-[0-9]{2}-[0-9]{4})\b", re.ASCII)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        if i % 2:
            x = 2 * x - 9 * (x > 4)
        total += x
    return total % 10 == 0


def digits_of(found: str) -> str:
    return "".join(c for c in found if c in DIGITS)


def is_card(found: str) -> bool:
    digits = digits_of(found) if len(found) <= 37 else ""  # 19 digits and a separator between any two
    return 14 <= len(digits) <= 19 and luhn(digits)


def is_phone(found: str) -> bool:
    return 10 <= sum(c in DIGITS for c in found) <= 15


def is_ip_part(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def is_iban(found: str) -> bool:
    code = found.replace(" ", "")
    if not 15 <= len(code) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def is_account(found: str) -> bool:
    return 8 <= sum(c in DIGITS for c in found) <= 17


def is_ssn(found: str) -> bool:
    area, group, serial = found.split("-")
    return area not in ("000", "666") and area[0] != "9" and group != "00" and serial != "0000"


# A parser takes the text, the start and the end of the anchor and where its kind's last match ended, and
# gives spans that pass the check and the new end (of the last match, also of one that failed).
Found = tuple[list[tuple[int, int]], int]


def email(text: str, start: int, stop: int, done: int) -> Found:
    left = start
    while left > done and text[left - 1] in LOCAL:
        left -= 1
    if left == start or not (m := DOMAIN.match(text, stop)):
        return [], done
    return [(left, m.end())], m.end()


def ip(text: str, start: int, stop: int, done: int) -> Found:
    """The first digit of a dotted run: its parts in fours."""
    end = DOTTED.match(text, start).end()
    out, at, parts = [], start, text[start:end].split(".")
    for i in range(0, len(parts) - 3, 4):
        four = parts[i:i + 4]
        size = sum(map(len, four)) + 3
        if all(map(is_ip_part, four)):
            out.append((at, at + size))
        at += size + 1
    return out, end


def number_of(check: Callable[[str], bool], pattern: re.Pattern) -> Callable[..., Found]:
    """The pattern matches at the anchor itself."""
    def parse(text: str, start: int, stop: int, done: int) -> Found:
        m = pattern.match(text, start)
        if not m:
            return [], done
        return ([m.span()] if check(m.group()) else []), m.end()
    return parse


def after_cue(check: Callable[[str], bool], pattern: re.Pattern) -> Callable[..., Found]:
    """The first group of a pattern that matches behind the anchor."""
    def parse(text: str, start: int, stop: int, done: int) -> Found:
        m = pattern.match(text, stop)
        if not m:
            return [], done
        return ([m.span(1)] if check(m.group(1)) else []), m.end()
    return parse


def login(text: str, start: int, stop: int, done: int) -> Found:
    m = USER.match(text, stop)
    return ([(start, m.end())], m.end()) if m else ([], done)


@dataclass(frozen=True)
class Kind:
    """``anchors`` are plain lower-case strings, found in the text with A-Z lower-cased."""

    name: str
    anchors: tuple[str, ...]
    parse: Callable[..., Found]


# The contract's four kinds, in its order.
BASE = (
    Kind("email", ("@",), email),
    Kind("ip", tuple(DIGITS), ip),
    Kind("card", tuple(DIGITS), number_of(is_card, NUMBER)),
    Kind("phone", ("+",), number_of(is_phone, PHONE)),
)
MORE = (
    Kind("login", ("http://", "https://", "ftp://", "sftp://", "ssh://"), login),
    Kind("iban", ("iban",), after_cue(is_iban, AFTER_IBAN)),
    Kind("account", ("account", "acct"), after_cue(is_account, AFTER_ACCOUNT)),
    Kind("ssn", ("ssn", "social security"), after_cue(is_ssn, AFTER_SSN)),
)
KINDS = BASE + MORE


class Scanner:
    """The automaton of all anchors; ``spans(text)`` runs the parsers at its hits."""

    def __init__(self, kinds: tuple[Kind, ...]) -> None:
        import ahocorasick

        self.kinds = kinds
        ranks: dict[str, list[int]] = {}
        for rank, kind in enumerate(kinds):
            for anchor in kind.anchors:
                ranks.setdefault(anchor, []).append(rank)
        self.automaton = ahocorasick.Automaton()
        for anchor, of in ranks.items():
            self.automaton.add_word(anchor, (len(anchor), tuple(of)))
        if ranks:
            self.automaton.make_automaton()
        self.any = bool(ranks)

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """``(start, rank, stop)`` of all finds, in order."""
        if not self.any or not text:
            return []
        out = []
        done = [0] * len(self.kinds)
        lowered = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
        for last, (size, ranks) in self.automaton.iter(lowered):
            start = last + 1 - size
            for rank in ranks:
                if start >= done[rank]:  # else the anchor lies within the last match
                    found, done[rank] = self.kinds[rank].parse(text, start, last + 1, done[rank])
                    out += [(a, rank, b) for a, b in found]
        return sorted(out)


def find(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """``doc_id`` and ``spans`` (start, rank, kind, stop; by start, then in the order of ``kinds``) of every row."""
    src = texts(docs)
    id_type = src.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scanner = worker_state(("pii", tuple(k.name for k in kinds)), lambda: Scanner(kinds))
        sizes, flat = [0], []
        for text in _each(batch.column("text")):
            flat += scanner.spans(text)
            sizes.append(len(flat))
        start, rank, stop = zip(*flat) if flat else ((), (), ())
        parts = [pa.array(start, pa.int32()), pa.array(rank, pa.int32()), pa.array([kinds[r].name for r in rank], pa.string()),
                 pa.array(stop, pa.int32())]
        spans = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()),
                                         pa.StructArray.from_arrays(parts, names=["start", "rank", "kind", "stop"]))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), spans], names=["doc_id", "spans"])
    return arrow_map(src, run, f"doc_id {id_type}, spans {SPANS}")


def _each(column: pa.Array) -> Iterator[str]:
    """The texts of a column one after the other; null is empty."""
    for value in column:
        yield value.as_py() or ""


def listed(spans: Column) -> Column:
    """``kind:start:stop`` of spans in order, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
