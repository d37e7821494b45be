"""Quality rules as a short-circuit cascade.

Each rule is a predicate that rejects a text. On a random sample of about ``sample_rows`` rows the
cost and the rejections of every rule are measured, and the rules run in the order of rejection per cost: cheap rules that reject much come first, and a text that one
rule rejects is not shown to the next. The verdict is the conjunction of all rules, so the order
decides the time spent, never the result. Counts are taken over whole texts.

Rules and thresholds are parameters. The default rules only reject what no prose does: their
limits lie well outside the range of running text in any language.

Defined cases: null or blank text has no words, all counts 0, and fails the base rule; a tie in
the order goes to the rule listed first; an empty sample keeps the listed order; repeated rows
get equal results; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonality.llm.common import arrow_map, column_bytes, texts

SYMBOLS = b"#*$%&|<>"  # fixed value
NO_SPACE = bytes(range(128, 192)) + b" \t\n\v\f\r"  # continuation bytes and separators: what is left are code points of words


@dataclass
class Text:
    """A text with the counts the rules need, each computed when first asked for."""

    data: bytes
    words: list[bytes] = field(init=False)

    def __post_init__(self) -> None:
        self.words = self.data.split()

    @property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.data.translate(None, NO_SPACE))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.data) - len(self.data.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.data.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside a 3-word window that occurs twice or more in the text."""
        n = len(self.words) - 2
        if n < 2:
            return 0
        number: dict[bytes, int] = {}
        code = np.fromiter((number.setdefault(w, len(number)) for w in self.words), np.int64, n + 2)
        if len(number) < 1 << 20:
            key = (code[:-2] * len(number) + code[1:-1]) * len(number) + code[2:]
        else:  # three codes would not fit in 64 bits: number the pairs first
            pair = np.unique(code[:-1] * len(number) + code[1:], return_inverse=True)[1]
            key = pair[:-1] * len(number) + code[2:]
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(n, bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        covered = np.zeros(n + 2, bool)
        for j in range(3):
            covered[j:n + j] |= twice
        return int(covered.sum())

    @cached_property
    def top_word_share(self) -> float:
        """Share of the most frequent word."""
        if not self.words:
            return 0.0
        counts: dict[bytes, int] = {}
        for w in self.words:
            counts[w] = counts.get(w, 0) + 1
        return max(counts.values()) / len(self.words)


@dataclass(frozen=True)
class Rule:
    """``rejects(text)``: the text fails the rule."""

    name: str
    rejects: Callable[[Text], bool]


def default_rules(max_symbols: float = 0.3, max_dup_lines: float = 0.5, word_length: tuple[float, float] = (2.0, 25.0),
                  max_top_word: float = 0.4, max_exclamations: float = 0.3) -> list[Rule]:
    """Rejection limits, each a share of words, lines or code points."""
    return [
        Rule("word_length", lambda t: not word_length[0] <= t.word_chars / max(t.n_words, 1) <= word_length[1]),
        Rule("symbols", lambda t: t.n_symbols > max_symbols * t.n_words),
        Rule("exclamations", lambda t: t.data.count(b"!") > max_exclamations * t.n_words),
        Rule("dup_lines", lambda t: t.n_dup_lines > max_dup_lines * len(t.lines)),
        Rule("top_word", lambda t: t.top_word_share > max_top_word),
    ]


def base_failed(t: Text) -> bool:
    return t.n_words < 50 or 100 * t.n_repeat_words > 50 * t.n_words


def measure(sample: list[bytes], rules: list[Rule]) -> list[tuple[float, int]]:
    """Seconds and rejections of each rule, on fresh texts (so each pays for its own counts)."""
    out = []
    for rule in rules:
        rows = [Text(s) for s in sample]
        began = time.perf_counter()
        rejected = sum(rule.rejects(t) for t in rows)
        out.append((time.perf_counter() - began, rejected))
    return out


def order_rules(docs: DataFrame, rules: list[Rule], sample_rows: int = 1000, seed: int = 1) -> list[Rule]:
    """The rules by rejection per cost, measured in tasks on a random sample of about ``sample_rows`` rows."""
    rows = docs.count()
    sample = texts(docs).select("text").sample(min(1.0, sample_rows / max(rows, 1)), seed)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        seconds, rejected = zip(*measure([t or b"" for t in column_bytes(batch, "text")], rules))
        return pa.RecordBatch.from_arrays([pa.array(range(len(rules)), pa.int32()), pa.array(seconds, pa.float64()),
                                           pa.array(rejected, pa.int64())], names=["rule", "seconds", "rejected"])
    sums = arrow_map(sample, run, "rule int, seconds double, rejected long").groupBy("rule").agg(F.sum("seconds"), F.sum("rejected"))
    gain = {r[0]: r[2] / max(r[1], 1e-9) for r in sums.collect()}
    return [rules[i] for i in sorted(range(len(rules)), key=lambda i: -gain.get(i, 0.0))]


def cascade(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = 1000) -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``kept`` and ``rejected_by`` (the first rule that rejected) per row."""
    ordered = order_rules(docs, default_rules() if rules is None else rules, sample_rows)
    src = texts(docs)
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, failed, rejected = [], [], []
        for data in column_bytes(batch, "text"):
            t = Text(data or b"")
            counts.append((t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words))
            failed.append(base_failed(t))
            rejected.append(None if failed[-1] else next((r.name for r in ordered if r.rejects(t)), None))
        kept = [not f and r is None for f, r in zip(failed, rejected)]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in zip(*counts)), pa.array(failed), pa.array(kept),
             pa.array(rejected, pa.string())], names=NAMES)
    return arrow_map(src, run, f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                               "n_repeat_words long, base_failed boolean, kept boolean, rejected_by string")


NAMES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by"]
