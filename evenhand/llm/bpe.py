"""Operator 7: byte-pair encoding and decoding by batched numpy merge rounds.

The symbols of many distinct words lie in one flat array. Every round looks all adjacent pairs up in the sorted
pair keys by binary search, takes the lowest rank of each word, and merges that pair wherever it stands in the
word, leftmost first. Words without a known pair leave the array; what is left goes into the next round.

Null and empty texts have no tokens. Special strings in a text become their own ids, as the library does it.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenhand.llm.common import Rolling, flat_bytes, slices, spread

NO_RANK = np.iinfo(np.int64).max
# Characters whose class, case and normal form Python and the tokenizer file agree on; other texts are split by the library.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-įĲ-ſ"
RARE = re.compile("[^\\x00-\\x1b\\x20-±´-¸º»¿-įĲ-ſ]")
WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^\\s0-9{LETTERS}]+")
MOST_WORDS = 250_000  # of the words a worker remembers; then it starts anew
SLOTS = 1 << 20  # of an empty table; it doubles when more than half of them would be taken
# Classes of lower-case bytes: blank, letter, digit, other. The bytes of two-byte letters count as letters.
BLANK, LETTER, DIGIT, OTHER = range(4)
CLASS = np.full(256, OTHER, np.uint8)
CLASS[[9, 10, 11, 12, 13, 32]] = BLANK
CLASS[48:58] = DIGIT
CLASS[97:123] = LETTER
CLASS[128:] = LETTER
U = np.uint64


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(moved)) for b in range(256)]


def plain_bytes(body: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lower-case bytes, and whether each text has only characters whose words can be told from bytes (to U+00FF, without U+0080 to U+00BF)."""
    low = body.copy()
    low[(body > 64) & (body < 91)] += 32
    before = np.zeros(len(body), np.uint8)
    before[1:] = body[:-1]
    after = before == 0xC3
    low[after & (body >= 0x80) & (body <= 0x9E) & (body != 0x97)] += 32
    odd = ((body > 127) & (body != 0xC3) & ~after) | ((body > 27) & (body < 32)) | ((before == 60) & (body == 124))
    total = np.r_[0, np.cumsum(odd)]
    return low, total[off[1:]] == total[off[:-1]]


def byte_words(low: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and stop of every word: a contraction, a run of letters, a digit, or a run of anything else but blanks."""
    n = len(low)
    kind = CLASS[low]
    sign = np.flatnonzero((low[1:] == 0x97) | (low[1:] == 0xB7)) + 1
    sign = sign[low[sign - 1] == 0xC3]
    kind[sign] = kind[sign - 1] = OTHER
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    head = edge[:n].copy()
    head[1:] |= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    mark = np.r_[head | (kind == BLANK), True]
    tick = np.flatnonzero((low == 39) & head)
    if len(tick):
        pad = np.r_[low, np.zeros(3, np.uint8)]
        x, y = pad[tick + 1], pad[tick + 2]
        room, more = ~edge[np.minimum(tick + 1, n)], ~edge[np.minimum(tick + 2, n)]
        short = room & np.isin(x, np.frombuffer(b"stmd", np.uint8))
        long = room & more & (((x == 114) & (y == 101)) | ((x == 118) & (y == 101)) | ((x == 108) & (y == 108)))
        at, size = np.r_[tick[short], tick[long]], np.r_[np.full(short.sum(), 2), np.full(long.sum(), 3)]
        for d in (1, 2):
            inside = at[size > d] + d
            head[inside] = mark[inside] = False
        end = at + size
        mark[end] = True
        end = end[end < n]
        end = end[kind[end] != BLANK]
        head[end] = True
    start = np.flatnonzero(head & (kind != BLANK))
    marks = np.flatnonzero(mark)
    return start, marks[np.searchsorted(marks, start) + 1]


class Encoder:
    """Of one tokenizer file (JSON, BPE with an end-of-word suffix)."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        model = spec["model"]
        vocab = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = dict(zip(vocab.values(), vocab)) | {i: s for s, i in special.items()}
        self.special = special
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        chars = byte_symbols()
        self.to_byte = {c: b for b, c in enumerate(chars)}
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.last = np.array([vocab[c + suffix] for c in chars], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        # A pair's key holds both ids; 32 bits do for small vocabularies.
        self.shift, kind = (16, np.uint32) if max(self.names) < 1 << 16 else (32, np.int64)
        keys = [vocab[a] << self.shift | vocab[b] for a, b in merges]
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        first: dict[int, int] = {}
        for rank, key in enumerate(keys):
            first.setdefault(key, rank)
        self.ranks = np.array([first[k] for k in sorted(first)], np.int64)
        self.keys = np.array(sorted(first), kind)
        self.raw = raw
        self.library = None
        self.forget()

    def forget(self) -> None:
        self.slot_code, self.slot_word = np.zeros(SLOTS, U), np.full(SLOTS, -1, np.int64)
        self.flat = np.zeros(1 << 16, np.int64)
        self.starts, self.counts = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used = self.words = 0
        self.id_text: list[str] = []
        self.name_text: list[str] = []
        for s, i in self.special.items():
            self.store(self.codes_of([self.token_bytes(s)]), np.array([i]), np.array([1]))

    @staticmethod
    def token_bytes(special: str) -> bytes:
        """What stands for a special string among words; no text holds these bytes."""
        return b"\xff" + special.encode()

    @staticmethod
    def codes_of(words: list[bytes]) -> np.ndarray:
        ends = np.cumsum([len(w) for w in words])
        return Rolling(np.frombuffer(b"".join(words), np.uint8)).of(np.r_[0, ends[:-1]], ends)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a << self.shift | b).astype(self.keys.dtype)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

    def merge_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the number of ids of each (non-empty) word."""
        lengths = np.array([len(w) for w in words], np.int64)
        body = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.inner[body]
        ends = np.cumsum(lengths)
        symbols[ends - 1] = self.last[body[ends - 1]]
        word = np.repeat(np.arange(len(words)), lengths)
        rank = np.full(len(symbols), NO_RANK)
        rank[:-1] = self.pair_ranks(symbols[:-1], symbols[1:])
        rank[ends - 1] = NO_RANK
        done_ids, done_words = [], []
        while len(symbols):
            head = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            sizes = np.diff(np.r_[head, len(word)])
            least = np.minimum.reduceat(rank, head)
            stay = np.repeat(least < NO_RANK, sizes)
            if not stay.all():
                done_ids.append(symbols[~stay])
                done_words.append(word[~stay])
                symbols, word, rank, sizes, least = symbols[stay], word[stay], rank[stay], sizes[least < NO_RANK], least[least < NO_RANK]
                if not len(symbols):
                    break
            where = np.flatnonzero(rank == np.repeat(least, sizes))
            # Of overlapping hits (one symbol with itself) every second one counts, from the left.
            step = np.diff(where) == 1
            if step.any():
                run = np.flatnonzero(np.r_[True, ~step])
                offset = np.arange(len(where)) - np.repeat(run, np.diff(np.r_[run, len(where)]))
                where = where[offset % 2 == 0]
            symbols[where] = self.made[rank[where]]
            stay = np.ones(len(symbols), bool)
            stay[where + 1] = False
            at = where - np.arange(len(where))  # of the merged symbols once their right halves are gone
            symbols, word, rank = symbols[stay], word[stay], rank[stay]
            touched = np.zeros(len(word), bool)
            touched[at] = touched[np.maximum(at - 1, 0)] = True
            fresh = np.flatnonzero(touched)
            new = np.full(len(fresh), NO_RANK)
            inside = fresh + 1 < len(word)
            inside[inside] = word[fresh[inside]] == word[fresh[inside] + 1]
            own = fresh[inside]
            new[inside] = self.pair_ranks(symbols[own], symbols[own + 1])
            rank[fresh] = new
        if not done_ids:
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        ids, owner = np.concatenate(done_ids), np.concatenate(done_words)
        order = np.argsort(owner, kind="stable")
        return ids[order], np.bincount(owner, minlength=len(words))

    def store(self, codes: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Remembers words by their (new, distinct) codes."""
        n, k = self.words, self.used
        while len(self.flat) < k + len(ids):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while len(self.starts) < n + len(codes):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])
        self.flat[k: k + len(ids)] = ids
        self.starts[n: n + len(codes)] = k + np.cumsum(counts) - counts
        self.counts[n: n + len(codes)] = counts
        self.used, self.words = k + len(ids), n + len(codes)
        slots = len(self.slot_word)
        if 2 * self.words > slots:
            known = np.flatnonzero(self.slot_word >= 0)
            codes, words = np.concatenate([self.slot_code[known], codes]), np.concatenate([self.slot_word[known], np.arange(n, self.words)])
            while 2 * self.words > slots:
                slots *= 2
            self.slot_code, self.slot_word = np.zeros(slots, U), np.full(slots, -1, np.int64)
            self.place(codes, words)
        else:
            self.place(codes, np.arange(n, self.words))

    def place(self, codes: np.ndarray, words: np.ndarray) -> None:
        """Gives words of codes that the table lacks their slots."""
        slots = len(self.slot_word)
        left, slot = np.arange(len(codes)), (codes & U(slots - 1)).astype(np.int64)
        while len(left):
            free = self.slot_word[slot] < 0
            taken, first = np.unique(slot[free], return_index=True)
            own = left[free][first]
            self.slot_code[taken], self.slot_word[taken] = codes[own], words[own]
            rest = np.ones(len(left), bool)
            rest[np.flatnonzero(free)[first]] = False
            left, slot = left[rest], (slot[rest] + 1) % slots

    def find(self, codes: np.ndarray) -> np.ndarray:
        """The remembered word of each code, or -1."""
        slots = len(self.slot_word)
        slot = (codes & U(slots - 1)).astype(np.int64)
        out = self.slot_word[slot]
        other = np.flatnonzero((out >= 0) & (self.slot_code[slot] != codes))
        while len(other):
            slot[other] = (slot[other] + 1) % slots
            out[other] = self.slot_word[slot[other]]
            other = other[(out[other] >= 0) & (self.slot_code[slot[other]] != codes[other])]
        return out

    def texts_of_words(self) -> tuple[list[str], list[str]]:
        """Per remembered word its ids and its tokens as text."""
        for w in range(len(self.id_text), self.words):
            own = self.flat[self.starts[w]: self.starts[w] + self.counts[w]].tolist()
            self.id_text.append(" ".join(map(str, own)))
            self.name_text.append(" ".join([self.names[i] for i in own]))
        return self.id_text, self.name_text

    def words_of(self, text: str) -> list[bytes]:
        """The words of any text in order; special strings stand for themselves."""
        if self.split is not None and "<|" in text:
            parts = self.split.split(text)
            if len(parts) > 1:
                out = []
                for i, part in enumerate(parts):
                    out += [self.token_bytes(part)] if i % 2 else self.plain_words(part)
                return out
        return self.plain_words(text)

    def plain_words(self, text: str) -> list[bytes]:
        if RARE.search(text) is None:
            return [w.encode() for w in WORDS.findall(text.lower())]
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.raw.decode())
        pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(map(self.to_byte.__getitem__, p)) for p, _ in pieces]

    def words_in(self, column) -> tuple[np.ndarray, np.ndarray]:
        """Remembered words of all texts of a string column in order, and how many each text has."""
        if self.words > MOST_WORDS:
            self.forget()
        body, off = flat_bytes(column)
        low, plain = plain_bytes(body, off)
        start, stop = byte_words(low, off)
        codes = Rolling(low).of(start, stop)
        edge = np.searchsorted(start, off)
        sizes = np.diff(edge)
        pieces, source = [codes], None
        if not plain.all():
            source, pieces = [], []
            for d in range(len(sizes)):
                if plain[d]:
                    pieces.append(codes[edge[d]: edge[d + 1]])
                    source.append((edge[d], None))
                else:
                    words = self.words_of(column[d].as_py() or "")
                    pieces.append(self.codes_of(words) if words else np.zeros(0, U))
                    source.append((0, words))
            sizes = np.array([len(p) for p in pieces], np.int64)
        codes = np.concatenate(pieces) if pieces else np.zeros(0, U)
        out = self.find(codes)
        lost = np.flatnonzero(out < 0)
        if len(lost):
            fresh, first = np.unique(codes[lost], return_index=True)
            at = lost[first]
            if source is None:
                words = [low[a:b].tobytes() for a, b in zip(start[at].tolist(), stop[at].tolist())]
            else:
                ends = np.cumsum(sizes)
                words = []
                for w, d in zip(at.tolist(), np.searchsorted(ends, at, "right").tolist()):
                    base, own = source[d]
                    i = w - int(ends[d] - sizes[d])
                    words.append(own[i] if own is not None else low[start[base + i]: stop[base + i]].tobytes())
            ids, counts = self.merge_words(words)
            self.store(fresh, ids, counts)
            out[lost] = self.find(codes[lost])
        return out, sizes

    def ids(self, column) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts of a string column and their numbers."""
        words, sizes = self.words_in(column)
        counts = self.counts[words]
        total = np.r_[0, np.cumsum(counts)]
        ends = np.cumsum(sizes)
        return self.flat[spread(self.starts[words], counts)], total[ends] - total[ends - sizes]


ENCODERS: dict[str, Encoder] = {}


def encoder(raw: bytes) -> Encoder:
    """The encoder of a file's content, kept by the worker."""
    name = hashlib.sha256(raw).hexdigest()
    if name not in ENCODERS:
        ENCODERS[name] = Encoder(raw)
    return ENCODERS[name]


def encode_texts(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, tokens): the ids of every row's text."""
    raw = df.sparkSession.sparkContext.broadcast(open(path, "rb").read())

    def run(batches):
        enc = encoder(raw.value)
        for batch in batches:
            for part in slices(batch, "_text"):
                flat, counts = enc.ids(part.column("_text"))
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("_key"), lists], names=["_key", "tokens"])

    src = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return src.mapInArrow(run, f"_key {src.schema['_key'].dataType.simpleString()}, tokens array<int>").withColumnRenamed("_key", key)


def decode_tokens(df: DataFrame, path: str, key: str = "doc_id", tokens: str = "tokens") -> DataFrame:
    """(key, decoded): what the library's decode gives for the ids, special tokens kept. Null ids give an empty text."""
    raw = df.sparkSession.sparkContext.broadcast(open(path, "rb").read())

    def run(batches):
        names = encoder(raw.value).names
        for batch in batches:
            made = [" ".join([names[i] for i in x or () if i in names]) for x in batch.column("_tokens").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_key"), pa.array(made, pa.string())], names=["_key", "decoded"])

    src = df.select(F.col(key).alias("_key"), F.col(tokens).alias("_tokens"))
    return src.mapInArrow(run, f"_key {src.schema['_key'].dataType.simpleString()}, decoded string").withColumnRenamed("_key", key)


def encode_decode_digests(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): ids and their decoded text in one pass, kept as digests.

    One row per input row, repeated keys included; a null or empty text has no tokens and the digests of the empty string.
    """
    raw = df.sparkSession.sparkContext.broadcast(open(path, "rb").read())

    def run(batches):
        enc = encoder(raw.value)
        for batch in batches:
            for part in slices(batch, "_text"):
                words, sizes = enc.words_in(part.column("_text"))
                (ids, names), listed, at = enc.texts_of_words(), words.tolist(), 0
                total, ends = np.r_[0, np.cumsum(enc.counts[words])], np.cumsum(sizes)
                out = ((total[ends] - total[ends - sizes]).tolist(), [], [])
                for n in sizes.tolist():
                    c, at = listed[at: at + n], at + n
                    out[1].append(hashlib.sha256(" ".join([ids[x] for x in c]).encode()).hexdigest())
                    out[2].append(hashlib.sha256(" ".join([names[x] for x in c]).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("_key"), pa.array(out[0], pa.int64()), pa.array(out[1]), pa.array(out[2])],
                                                 names=["_key", "n_tokens", "ids_sha256", "decoded_sha256"])

    src = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    kind = src.schema["_key"].dataType.simpleString()
    return src.mapInArrow(run, f"_key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("_key", key)
