"""Operator 8: token counts from a finite-state transducer.

The tokenizer is compiled, as texts need it, into a deterministic transducer over bytes. A state stands for all that
later bytes can ask of what was read; a transition carries the change in the number of tokens. The state is the
longest suffix that may still grow into a longer piece and, for every place in it, the token that ends there and the
number of tokens since. A longer token may replace the ones after such a place exactly if it and the token before the
place are also neighbours when merged on their own, which is what merging by rank amounts to.

Blanks that follow other characters always lead to one and the same state. So a text is cut into chunks at such
places, each chunk's state map is constant, all chunks of a slice are run side by side, one byte a step, and a prefix
sum over the chunks composes their counts into those of whole texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenhand.llm.common import flat_bytes, slices

BLANK = "▁"
CHUNK = 192
SLICE = 4 << 20
MOST_STATES = 200_000  # of a worker; then the table starts anew
PERIOD = 16
LIMIT = 4096


class Transducer:
    """Of one piece model: merges by score, byte fallback, identity normalisation with one blank before the text."""

    def __init__(self, raw: bytes):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=raw)
        n = model.get_piece_size()
        odd = lambda i: model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
        pieces = {model.id_to_piece(i): model.get_score(i) for i in range(n) if not odd(i)}
        self.score = {p: s for p, s in pieces.items() if set(p) != {BLANK} or p == BLANK}
        if any(BLANK in p[1:] for p in self.score):
            raise ValueError("pieces with a blank inside are not supported")
        self.prefixes = {p[:i] for p in self.score for i in range(1, len(p))}
        # Tokens of a run of blanks; runs merge among themselves after everything else.
        runs = [0] + [len(model.encode(BLANK * (k - 1))) if k > 1 else 1 for k in range(1, 4 * PERIOD + 1)]
        if any(runs[k] != runs[k - PERIOD] + 1 for k in range(PERIOD, 4 * PERIOD + 1)):
            raise ValueError("runs of blanks of another period")
        self.runs = runs
        self.pairs: dict[tuple[str, str], bool] = {}
        self.alone: dict[str, bool] = {}
        self.forget()

    def forget(self) -> None:
        self.keys: list = []
        self.number: dict = {}
        self.column = np.full(256, -1, np.int16)  # of each byte that has come up
        self.bytes: list[int] = []
        self.next = np.full((1024, 128), -1, np.int32)
        self.delta = np.zeros((1024, 128), np.int8)
        self.run_state = [self.state(("run", k)) for k in range(1, PERIOD + 1)]

    def state(self, key) -> int:
        at = self.number.get(key)
        if at is None:
            at = self.number[key] = len(self.keys)
            self.keys.append(key)
            if at == len(self.next):
                more = (at // 2, self.next.shape[1])
                self.next = np.concatenate([self.next, np.full(more, -1, np.int32)])
                self.delta = np.concatenate([self.delta, np.zeros(more, np.int8)])
        return at

    def merged(self, text: str) -> list[str]:
        parts = list(text)
        while len(parts) > 1:
            best = max(range(len(parts) - 1), key=lambda i: (self.score.get(parts[i] + parts[i + 1], -np.inf), -i))
            if parts[best] + parts[best + 1] not in self.score:
                break
            parts[best: best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def fits(self, before, piece: str) -> bool:
        """Whether ``piece`` stands as a token after ``before``; None and numbers have no say in it."""
        if not isinstance(before, str):
            ok = self.alone.get(piece)
            if ok is None:
                ok = self.alone[piece] = self.merged(piece) == [piece]
            return ok
        ok = self.pairs.get((before, piece))
        if ok is None:
            if len(self.pairs) > 500_000:
                self.pairs.clear()
            ok = self.pairs[before, piece] = self.merged(before + piece) == [before, piece]
        return ok

    def cost(self, piece: str) -> int:
        return 1 if piece in self.score else len(piece.encode())

    def step(self, key, char: str):
        """State key and change in tokens after one more character."""
        if char in (" ", BLANK):
            if key[0] == "run":
                k = key[1]
                return ("run", k % PERIOD + 1), self.runs[k + 1] - self.runs[k]
            return ("run", 1), 1
        if key[0] == "run":
            # The blank before a word is its first character; left alone it is counted with its run.
            k = key[1]
            own = self.runs[k] - self.runs[k - 1]
            entries = ((1, own, own), (0, BLANK, 0))
            tail = BLANK
        else:
            _, tail, entries = key
        for length, before, since in entries:
            piece = tail[len(tail) - length:] + char
            if (piece in self.score or length == 0) and self.fits(before, piece):
                change = self.cost(piece) - since
                break
        else:
            raise ValueError(f"no token ends at {tail + char!r}")
        kept = tuple((length + 1, before, since + change) for length, before, since in entries
                     if tail[len(tail) - length:] + char in self.prefixes)
        kept += ((0, piece if piece in self.score else None, 0),)
        return ("in", (tail + char)[len(tail) + 1 - kept[0][0]:], kept), change

    def columns(self, body: np.ndarray) -> np.ndarray:
        """The table columns of the bytes; new bytes get a column."""
        for byte in np.flatnonzero(np.bincount(body, minlength=256)).tolist():
            if self.column[byte] < 0:
                self.column[byte] = len(self.bytes)
                self.bytes.append(byte)
        if len(self.bytes) > self.next.shape[1]:
            more = (len(self.next), 256 - self.next.shape[1])
            self.next = np.concatenate([self.next, np.full(more, -1, np.int32)], axis=1)
            self.delta = np.concatenate([self.delta, np.zeros(more, np.int8)], axis=1)
        return self.column[body]

    def compile(self, at: int, column: int) -> None:
        key, byte = self.keys[at], self.bytes[column]
        part = b""
        if key[0] == "part":
            _, base, part = key
            key = self.keys[base]
        else:
            base = at
        part += bytes([byte])
        lead = part[0]
        need = 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        if len(part) < need:
            to, change = self.state(("part", base, part)), 0
        else:
            after, change = self.step(key, part.decode("utf-8", "replace")[:1])
            to = self.state(after)
        self.next[at, column], self.delta[at, column] = to, change

    def counts(self, body: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Tokens of each text of a slice."""
        if len(self.keys) > MOST_STATES:
            self.forget()
        size = np.diff(off)
        total = (size > 0).astype(np.int64)  # the blank before each text
        if not len(body):
            return total
        calm = np.ones(len(body), bool)
        calm[1:] = (body[:-1] != 0x20) & (body[:-1] != 0x81)
        calm[off[:-1][size > 0]] = False
        resets = np.flatnonzero(calm & (body == 0x20))
        cut = resets[np.minimum(np.searchsorted(resets, np.arange(CHUNK, len(body), CHUNK)), len(resets) - 1)] if len(resets) else resets
        heads = off[:-1][size > 0]
        start = np.union1d(heads, cut + 1)
        start = start[start < len(body)]
        stop = np.r_[start[1:], len(body)]
        # A chunk never runs over the end of its text: every text's head is a start.
        columns = self.columns(body)
        counts = np.zeros(len(start), np.int64)
        order = np.argsort(start - stop, kind="stable")
        length = (stop - start)[order]
        at, state = start[order].copy(), np.full(len(start), self.run_state[0], np.int64)
        sums = np.zeros(len(start), np.int64)
        active = len(order)
        for t in range(int(length[0])):
            while length[active - 1] <= t:
                active -= 1
            s, b = state[:active], columns[at[:active]]
            to = self.next[s, b]
            if to.min() < 0:
                for x, y in sorted(set(zip(s[to < 0].tolist(), b[to < 0].tolist()))):
                    self.compile(x, y)
                to = self.next[s, b]
            sums[:active] += self.delta[s, b]
            state[:active] = to
            at[:active] += 1
        counts[order] = sums
        running = np.r_[0, np.cumsum(counts)]
        first, last = np.searchsorted(start, off[:-1]), np.searchsorted(start, off[1:])
        return total + np.where(size > 0, running[last] - running[first], 0)


TRANSDUCERS: dict[str, Transducer] = {}


def transducer(raw: bytes) -> Transducer:
    name = hashlib.sha256(raw).hexdigest()
    if name not in TRANSDUCERS:
        TRANSDUCERS[name] = Transducer(raw)
    return TRANSDUCERS[name]


def token_counts(df: DataFrame, path: str, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit), one row per input row; null and empty texts have zero bytes and tokens."""
    raw = df.sparkSession.sparkContext.broadcast(open(path, "rb").read())

    def run(batches):
        machine = transducer(raw.value)
        for batch in batches:
            for part in slices(batch, "_text", SLICE):
                body, off = flat_bytes(part.column("_text"))
                n = machine.counts(body, off)
                yield pa.RecordBatch.from_arrays([part.column("_key"), pa.array(np.diff(off)), pa.array(n), pa.array(n > limit)],
                                                 names=["_key", "n_bytes", "n_tokens", "over_limit"])

    src = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    kind = src.schema["_key"].dataType.simpleString()
    return src.mapInArrow(run, f"_key {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("_key", key)
