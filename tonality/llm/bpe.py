"""BPE encoding and decoding by speculate and verify.

Works on a word-level BPE file of the tokenizers library: NFC, white space to one space, lower
case; a split pattern; byte symbols with an end-of-word suffix. For every distinct word

1. greedy longest match proposes tokens,
2. every adjacent pair of proposed tokens is checked at once (a sorted table of known pairs;
   new pairs are decided by merging just the two tokens' symbols): a word all of whose adjacent
   pairs are compatible is encoded as proposed,
3. only words with a failing pair are merged exactly, by rank.

Each task remembers words and pairs in bounded tables, so a frequent word costs one look-up;
ids never leave the task unless they are asked for.

Defined cases: null text is empty; an empty text has no tokens and the digests of the empty
string; the strings of special tokens in a text become their ids, as in the library; texts are
encoded whole, words of any length too; repeated rows get equal results; an empty table gives an
empty result; extra columns are carried.
"""

from __future__ import annotations

import hashlib
import heapq
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

from tonality.llm.common import arrow_map, worker_state

WORDS = 200_000  # words remembered per worker before the table starts anew
CHUNKS = 400_000  # the same for what stands between white space
PAIRS = 1_000_000
SHORT = 40  # bytes; shorter words are worked on together as rows of a matrix, longer ones one by one
BASE = np.uint64(0x9E3779B97F4A7C15)  # of the polynomial hashes of byte runs
NONE = 1 << 30
ROWS = 1 << 14  # of a matrix
# Texts of these characters only need no normalising but lower case: no combining marks, no odd white space.
PLAIN = regex.compile(r"[\t\n\r -~\u00A1-\u00AC\u00AE-\u012F\u0131-\u024F]*+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself, or the next free one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def padded(runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Byte runs as the rows of a matrix, and their lengths."""
    size = np.fromiter(map(len, runs), np.int64, len(runs))
    width = int(size.max())
    return np.frombuffer(b"".join([r.ljust(width, b"\0") for r in runs]), np.uint8).reshape(len(runs), width), size


class WordBpe:
    """One tokenizer file: encoding by speculate and verify, and decoding."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"]
        self.rank = {tuple(m if isinstance(m, list) else m.split(" ")): r for r, m in enumerate(model["merges"])}
        self.symbol = byte_symbols()
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")") if self.specials else None
        library = Tokenizer.from_file(path)
        self.normalize = library.normalizer.normalize_str  # Unicode tables as the library has them
        self.split_any = library.pre_tokenizer.pre_tokenize_str
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        table = {b: s for b, s in enumerate(self.symbol) if chr(b) != s}
        self.shown = lambda word: word.encode().decode("latin-1").translate(table)
        self.names = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.specials.items()}
        self.words: dict[str, str] = {}  # ids as text, by word
        self.chunks: dict[str, str] = {}  # and by what stands between white space
        self.names_by_text: dict[str, str] = {}
        self.id_text = {i: str(i) for i in self.names}
        self._tables()
        self.good, self.bad = np.zeros(0, np.int64), np.zeros(0, np.int64)  # known pairs, sorted

    # ------------------------------------------------------------------ words of a text

    def pieces(self, text: str) -> list[str]:
        """The words of any text without special tokens, split by the library's own rules."""
        back = {s: b for b, s in enumerate(self.symbol)}
        return [bytes(back[c] for c in piece).decode() for piece, _ in self.split_any(self.normalize(text))]

    def symbols(self, word: str) -> list[str]:
        out = list(self.shown(word))
        out[-1] += self.suffix
        return out

    def _tables(self) -> None:
        """The vocabulary as sorted arrays: byte runs by hash, merges by pair of ids."""
        back = {s: b for b, s in enumerate(self.symbol)}
        self.first_id = np.array([self.vocab[s] for s in self.symbol])  # of each byte
        self.last_id = np.array([self.vocab[s + self.suffix] for s in self.symbol])  # of each byte that ends a word
        self.run: dict[int, tuple[bytes, bool]] = {}  # of each token: its bytes, and whether it ends a word
        hashes, ids, self.longest = [], [], np.ones(1 << 16, np.int64)  # longest token by its first two bytes
        for name, i in self.vocab.items():
            last = name.endswith(self.suffix) and len(name) > len(self.suffix)
            run = bytes(back[c] for c in (name[:-len(self.suffix)] if last else name))
            self.run[i] = run, last
            h = 0
            for b in run:
                h = (h * int(BASE) + b + 1) % (1 << 64)
            hashes.append(h << 1 & (1 << 64) - 1 | last)
            ids.append(i)
            if len(run) > 1:
                at = run[0] << 8 | run[1]
                self.longest[at] = max(self.longest[at], len(run))
        order = np.argsort(np.array(hashes, np.uint64))
        self.run_hash, self.run_id = np.array(hashes, np.uint64)[order], np.array(ids)[order]
        pairs = np.array([self.vocab[a] << 32 | self.vocab[b] for a, b in self.rank])
        order = np.argsort(pairs)
        self.pair_key, self.pair_rank = pairs[order], order  # ranks are places in the file
        self.pair_id = np.array([self.vocab[a + b] for a, b in self.rank])[order]

    # ------------------------------------------------------------------ speculate

    def propose(self, data: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Greedy longest match: one row of token ids (then -1) for each row of ``size`` bytes of ``data``."""
        rows, width = data.shape
        power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(width, BASE)]))
        run = np.zeros((rows, width + 1), np.uint64)
        for k in range(width):
            run[:, k + 1] = run[:, k] * BASE + data[:, k] + np.uint64(1)
        out = np.full((rows, width), -1, np.int64)
        at, row, step = np.zeros(rows, np.int64), np.arange(rows), 0
        while len(row):
            left = size[row] - at[row]
            second = np.where(left > 1, data[row, np.minimum(at[row] + 1, width - 1)], 0).astype(np.int64)
            most = np.where(left > 1, np.minimum(self.longest[data[row, at[row]].astype(np.int64) << 8 | second], left), 1)
            token, used = np.full(len(row), -1, np.int64), np.zeros(len(row), np.int64)
            for n in range(int(most.max()), 0, -1):
                open_ = np.flatnonzero((token < 0) & (most >= n))
                r, start = row[open_], at[row[open_]]
                h = (run[r, start + n] - run[r, start] * power[n]) << np.uint64(1) | (n == left[open_])
                found = np.searchsorted(self.run_hash, h)
                found[found == len(self.run_hash)] = 0
                ok = self.run_hash[found] == h
                token[open_[ok]], used[open_[ok]] = self.run_id[found[ok]], n
            out[row, step] = token
            at[row] += used
            row, step = row[at[row] < size[row]], step + 1
        return out

    # ------------------------------------------------------------------ verify

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether the symbols of each two tokens, merged together, give just these two tokens."""
        pairs = left.astype(np.int64) << 32 | right
        wanted = np.unique(pairs)
        new = wanted[~(np.isin(wanted, self.good, assume_unique=True) | np.isin(wanted, self.bad, assume_unique=True))]
        if len(new):
            if len(self.good) + len(self.bad) > PAIRS:
                self.good = self.bad = np.zeros(0, np.int64)
                new = wanted
            ok = np.concatenate([self.merges_to(new[a:a + ROWS]) for a in range(0, len(new), ROWS)])
            self.good, self.bad = np.union1d(self.good, new[ok]), np.union1d(self.bad, new[~ok])
        at = np.searchsorted(self.good, pairs)
        at[at == len(self.good)] = 0
        return self.good[at] == pairs if len(self.good) else np.zeros(len(pairs), bool)

    def merges_to(self, pairs: np.ndarray) -> np.ndarray:
        """Whether the bytes of each pair of tokens merge to just this pair."""
        runs = [self.run[p >> 32][0] + self.run[p & 0xFFFFFFFF][0] for p in pairs.tolist()]
        closed = np.array([self.run[p & 0xFFFFFFFF][1] for p in pairs.tolist()])
        got = self.merge(*padded(runs), closed)
        both = (got >= 0).sum(axis=1) == 2
        first = got[:, 0]
        second = got[:, 1:].max(axis=1)  # the only other part, where there are two
        return both & (first == pairs >> 32) & (second == pairs & 0xFFFFFFFF)

    def merge(self, data: np.ndarray, size: np.ndarray, closed: np.ndarray | None = None) -> np.ndarray:
        """Exact merging by rank, then place, of all rows at once; -1 where no token starts.

        ``closed``: whether a row's last byte ends a word (all do if it is not given).
        """
        rows, width = data.shape
        token = self.first_id[data]
        last = np.arange(rows) if closed is None else np.flatnonzero(closed)
        token[last, size[last] - 1] = self.last_id[data[last, size[last] - 1]]
        place = np.arange(width)
        token[place >= size[:, None]] = -1
        after = np.where(place + 1 < size[:, None], place + 1, width)  # linked list of the parts of each row
        before = np.broadcast_to(place - 1, (rows, width)).copy()
        token = np.concatenate([token, np.full((rows, 1), -1)], axis=1)  # what stands after the last part
        rank, merged = np.full((rows, width), NONE), np.zeros((rows, width), np.int64)

        def rate(r: np.ndarray, i: np.ndarray) -> None:
            right = token[r, after[r, i]]
            key = token[r, i] << 32 | right
            found = np.searchsorted(self.pair_key, key)
            found[found == len(self.pair_key)] = 0
            ok = (self.pair_key[found] == key) & (right >= 0)
            rank[r, i] = np.where(ok, self.pair_rank[found], NONE)
            merged[r, i] = self.pair_id[found]

        r, i = np.nonzero(place + 1 < size[:, None])
        rate(r, i)
        row = np.arange(rows)
        while len(row):
            i = rank[row].argmin(axis=1)
            go = rank[row, i] < NONE
            row, i = row[go], i[go]
            j = after[row, i]
            token[row, i] = merged[row, i]
            token[row, j], rank[row, j] = -1, NONE
            after[row, i] = after[row, j]
            inner = after[row, i] < width
            before[row[inner], after[row, i][inner]] = i[inner]
            rate(row, i)
            back = before[row, i] >= 0
            rate(row[back], before[row, i][back])
        return token[:, :width]

    def merge_long(self, symbols: list[str]) -> list[int]:
        """The same for one row of symbols, with a heap over a linked list: n log n for n symbols."""
        n = len(symbols)
        part, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, part[i], part[i + 1]) for i in range(n - 1) if (r := self.rank.get((part[i], part[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if part[i] != a or j >= n or part[j] != b:
                continue  # one of the two has been merged meanwhile
            part[i], part[j] = a + b, ""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := self.rank.get((part[x], part[y]))) is not None:
                    heapq.heappush(heap, (r, x, part[x], part[y]))
        return [self.vocab[p] for p in part if p]

    # ------------------------------------------------------------------ whole texts

    def learn(self, words: set[str]) -> None:
        """Encode distinct words and remember them."""
        if len(self.words) + len(words) > WORDS:
            self.words.clear()
        words = [w for w in words if w not in self.words]
        if not words:
            return
        data = [w.encode() for w in words]
        for a in range(0, len(words), ROWS):
            short = [k for k in range(a, min(a + ROWS, len(words))) if len(data[k]) <= SHORT]
            if short:
                self.words.update(zip([words[k] for k in short], self.encode_rows([data[k] for k in short])))
        for w, d in zip(words, data):
            if len(d) > SHORT:
                self.words[w] = " ".join(map(str, self.merge_long(self.symbols(w))))

    def encode_rows(self, data: list[bytes]) -> list[str]:
        """Ids as text of short words: speculate, verify, merge the rest."""
        bytes_, size = padded(data)
        guess = self.propose(bytes_, size)
        r, c = np.nonzero(guess[:, 1:] >= 0)
        fails = np.zeros(len(data), bool)
        fails[r[~self.compatible(guess[r, c], guess[r, c + 1])]] = True
        if fails.any():
            guess[fails] = self.merge(bytes_[fails], size[fails])
        real = guess >= 0
        ids = list(map(self.id_text.__getitem__, guess[real].tolist()))
        stop = np.cumsum(real.sum(axis=1)).tolist()
        return [" ".join(ids[x:y]) for x, y in zip([0, *stop], stop)]

    def encode_plain(self, texts: list[str]) -> list[str]:
        """Ids as text of PLAIN texts: they are looked up by what stands between white space."""
        split = [t.lower().split() for t in texts]
        new = {c for cs in split for c in cs}
        if len(self.chunks) + len(new) > CHUNKS:
            self.chunks.clear()
        new = [c for c in new if c not in self.chunks]
        pieces = [self.pattern.findall(c) for c in new]
        self.learn({p for ps in pieces for p in ps})
        for c, ps in zip(new, pieces):
            self.chunks[c] = " ".join([self.words[p] for p in ps])
        return [" ".join(map(self.chunks.__getitem__, cs)) for cs in split]

    def encode_any(self, texts: list[str]) -> list[str]:
        """Ids as text of any texts, special tokens included."""
        parts = [[p for p in (self.special_split.split(t) if self.special_split else [t]) if p] for t in texts]
        words = [[[p] if p in self.specials else self.pieces(p) for p in ps] for ps in parts]
        self.learn({w for ws in words for group in ws for w in group if w not in self.specials})
        special = {s: str(i) for s, i in self.specials.items()}
        return [" ".join([special.get(w) or self.words[w] for group in ws for w in group]) for ws in words]

    def encode(self, texts: list[str | None]) -> list[str]:
        """The ids of each text, as decimal numbers joined by one space."""
        plain = [bool(t) and PLAIN.fullmatch(t) is not None and not any(s in t for s in self.specials) for t in texts]
        fast = iter(self.encode_plain([t for t, p in zip(texts, plain) if p]))
        odd = iter(self.encode_any([t or "" for t, p in zip(texts, plain) if not p]))
        return [next(fast if p else odd) for p in plain]

    def decode(self, ids: list[int]) -> str:
        """As the library decodes without a decoder: the tokens' names, joined by one space."""
        return " ".join(map(self.names.__getitem__, ids))

    def decode_text(self, ids: str) -> str:
        """The same from ids as text."""
        if not self.names_by_text:
            self.names_by_text = {str(i): s for i, s in self.names.items()}
        return " ".join(map(self.names_by_text.__getitem__, ids.split()))


def tokenizer(path: str) -> WordBpe:
    """The worker's own copy, with its tables, kept from batch to batch."""
    return worker_state(("bpe", path), lambda: WordBpe(path))


# What an output column holds, by name: its type, and its value from the tokenizer and the ids as text.
OUTPUTS = {
    "n_tokens": (LongType(), lambda t, ids: ids.count(" ") + bool(ids)),
    "ids": (ArrayType(IntegerType()), lambda t, ids: np.fromiter(map(int, ids.split()), np.int32)),
    "decoded": (StringType(), lambda t, ids: t.decode_text(ids)),
    "ids_sha256": (StringType(), lambda t, ids: hashlib.sha256(ids.encode()).hexdigest()),
    "decoded_sha256": (StringType(), lambda t, ids: hashlib.sha256(t.decode_text(ids).encode()).hexdigest()),
}
CHUNK = 1 << 20  # characters encoded at a time


def encode_texts(docs: DataFrame, path: str, outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded")) -> DataFrame:
    """``row`` (all columns of ``docs``) and the ``outputs`` of each whole text; one narrow pass."""
    src = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("_text"))
    schema = StructType(src.select("row").schema.fields)
    for o in outputs:
        schema = schema.add(o, OUTPUTS[o][0])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe, values, group, size = tokenizer(path), {o: [] for o in outputs}, [], 0

        def flush() -> None:
            nonlocal group, size
            for ids in bpe.encode(group):
                for o in outputs:
                    values[o].append(OUTPUTS[o][1](bpe, ids))
            group, size = [], 0

        for t in batch.column("_text").to_pylist():
            group.append(t)
            size += len(t or "")
            if size > CHUNK:
                flush()
        flush()
        kinds = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32())}
        return pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array(values[o], kinds.get(o, pa.string())) for o in outputs)],
                                          names=["row", *outputs])
    return arrow_map(src, run, schema)
