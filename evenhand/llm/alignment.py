"""Operator 11: alignment of two tokenizers by exact-text deduplication.

Texts are shuffled by their full text, so each distinct one is tokenised and aligned once. Where a token of A and one of B end at
the same byte they are linked, and a text keeps its links as distinct id pairs with their counts. Tasks add those up, weighted by
the copies of the text, into one vector over all pairs there can be: of two tokens that end together in equal bytes, one is a
suffix of the other, so the pairs are bounded by the vocabularies (some 300,000), whatever the corpus. The totals, of that
bounded size, go back to the tasks, and the measures of a text are joined to the ids of its copies.

A reads a space and the text, B the text alone and adds the space itself. Null and empty texts, and texts of which either tokenizer
does not give back the bytes, have no tokens: zeros and an empty digest. One row per input row, repeated keys and texts included.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenhand.llm.bpe import byte_symbols
from evenhand.llm.common import flat_bytes, slices, spread
from evenhand.llm.hot import attach, numbered
from evenhand.session import cut_lineage

# Fixed value: the split of the byte-level vocabulary, as its library has it.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN = 0x20000  # below it both splitters know the same letters, digits and blanks; texts beyond are left to the file's own library
IDS = 1 << 20  # more than either vocabulary has


class Tokens:
    """Bytes of every id of a vocabulary, in one flat array."""

    def __init__(self, entries: dict[int, bytes]):
        n = max(entries) + 1
        if n > IDS or not all(entries.values()):
            raise ValueError("a vocabulary with an empty entry or too many ids")
        self.entries = entries
        self.sizes = np.zeros(n, np.int64)
        self.sizes[list(entries)] = [len(b) for b in entries.values()]
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(entries[i] for i in range(n) if i in entries), np.uint8)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        return self.flat[spread(self.starts[ids], self.sizes[ids])]


def decimal_table(n: int) -> Tokens:
    """Ids written out, each followed by a comma."""
    return Tokens({i: b"%d," % i for i in range(n)})


class Aligner:
    """Both tokenizers, the table of possible pairs, and the alignment of slices of texts."""

    def __init__(self, raw_a: bytes, raw_b: bytes):
        import sentencepiece

        self.raw_a = raw_a
        spec = json.loads(raw_a)
        code = {c: b for b, c in enumerate(byte_symbols())}
        byte_level = spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} and spec["normalizer"] is None
        vocab = {i: bytes(map(code.__getitem__, p)) for p, i in spec["model"]["vocab"].items() if all(c in code for c in p)}
        vocab |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        self.a = Tokens(vocab)
        self.library = self.fast = None
        special = {t["id"] for t in spec["added_tokens"]}
        merged = [x if isinstance(x, str) else " ".join(x) for x in spec["model"]["merges"]]
        ranks = [spec["model"]["vocab"].get(m.replace(" ", "", 1)) for m in merged]
        if byte_level and ranks == list(range(256, 256 + len(ranks))):  # ids in order of merging: the id is the rank
            import tiktoken

            self.fast = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks={b: i for i, b in vocab.items() if i not in special}, special_tokens={})
        self.model = sentencepiece.SentencePieceProcessor(model_proto=raw_b)
        pieces = {}
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            pieces[i] = bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()
        self.b = Tokens(pieces)
        self.digits = decimal_table(max(len(self.a.sizes), len(self.b.sizes)))
        self.pairs = self.suffix_pairs()

    def suffix_pairs(self) -> np.ndarray:
        """All pairs, as a * IDS + b, of which one token's bytes are a suffix of the other's; sorted."""
        found = set()
        for one, other, flip in ((self.a, self.b, False), (self.b, self.a, True)):
            where: dict[bytes, list[int]] = {}
            for i, b in other.entries.items():
                where.setdefault(b, []).append(i)
            for i, b in one.entries.items():
                for k in range(len(b)):
                    for j in where.get(b[k:], ()):
                        found.add(j * IDS + i if flip else i * IDS + j)
        return np.array(sorted(found), np.int64)

    def encode_a(self, text: str) -> list[int]:
        if self.fast is not None and (text.isascii() or max(text) < chr(PLAIN)):
            return self.fast.encode_ordinary(text)
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.raw_a.decode())
            self.library.encode_special_tokens = True
        return self.library.encode(text, add_special_tokens=False).ids

    def align(self, texts: pa.Array) -> dict[str, np.ndarray | list]:
        """Per text n_a, n_b, n_groups, the digest of its groups and its links (sorted distinct pairs, then their counts)."""
        words = texts.to_pylist()
        a = [self.encode_a(" " + t) for t in words]
        b = self.model.encode(words, num_threads=1)
        na, nb = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
        a, b = _flat(a), _flat(b)
        good = self.gives_back(texts, a, na, b, nb)
        a, b = a[np.repeat(good, na)], b[np.repeat(good, nb)]
        na, nb = np.where(good, na, 0), np.where(good, nb, 0)
        end_a, end_b = np.cumsum(self.a.sizes[a]), np.cumsum(self.b.sizes[b])
        # tokens that end together: both lists of ends rise, and both end where a text does
        at = np.full(int(end_a[-1]) + 1 if len(end_a) else 1, -1, np.int64)
        at[end_a] = np.arange(len(a))
        last_b = np.flatnonzero(at[end_b] >= 0) if len(end_b) else np.zeros(0, np.int64)
        last_a = at[end_b[last_b]]
        text_of = np.repeat(np.arange(len(words)), na)[last_a]
        groups = np.bincount(text_of, minlength=len(words))
        pair = np.searchsorted(self.pairs, a[last_a] * IDS + b[last_b])
        links = _counted(text_of, pair, len(words))
        return {"n_a": na, "n_b": nb, "n_groups": groups, "groups_sha256": self.digests(a, last_a, na, b, last_b, nb, good), "links": links}

    def gives_back(self, texts: pa.Array, a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> np.ndarray:
        """Whether both token lists of a text spell a space and the text."""
        body, off = flat_bytes(texts)
        size = np.diff(off) + 1
        ends = np.cumsum(size)
        want = np.full(int(ends[-1]) if len(ends) else 0, 32, np.uint8)
        want[spread(ends - size + 1, size - 1)] = body
        good = size > 1
        for table, ids, n in ((self.a, a, na), (self.b, b, nb)):
            length = _sums(table.sizes[ids], n)
            good &= length == size
            same, got = np.repeat(good, size), np.repeat(np.repeat(good, n), table.sizes[ids])
            wrong = np.zeros(len(want), bool)
            wrong[same] = want[same] != table.bytes_of(ids)[got]
            good &= _sums(wrong, size) == 0
        return good

    def digests(self, a, last_a, na, b, last_b, nb, good) -> list[str]:
        """Hashes of the groups written out: ids of A and of B by commas, ``|`` between the two and ``;`` between groups."""
        total = len(a) + len(b)
        group_a = np.searchsorted(last_a, np.arange(len(a)))  # groups that end before the token
        group_b = np.searchsorted(last_b, np.arange(len(b)))
        before_a = np.r_[0, last_b + 1] if len(last_b) else np.zeros(1, np.int64)
        place_a = np.arange(len(a)) + before_a[group_a]
        place_b = np.arange(len(b)) + (last_a[group_b] + 1 if len(b) else 0)
        ids = np.empty(total, np.int64)
        ids[place_a], ids[place_b] = a, b
        out = self.digits.bytes_of(ids)
        ends = np.cumsum(self.digits.sizes[ids])
        out[ends[place_a[last_a]] - 1] = ord("|")
        out[ends[place_b[last_b]] - 1] = ord(";")
        stop = np.r_[0, ends][np.cumsum(na + nb)]
        start = np.r_[0, stop[:-1]]
        flat = out.tobytes()
        return [hashlib.sha256(flat[s: e - 1]).hexdigest() if g else "" for s, e, g in zip(start.tolist(), stop.tolist(), good.tolist())]


def _flat(lists: list[list[int]]) -> np.ndarray:
    return np.concatenate([np.array(x, np.int64) for x in lists]) if lists else np.zeros(0, np.int64)


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches."""
    total, ends = np.r_[0, np.cumsum(values, dtype=np.int64)], np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def _counted(owner: np.ndarray, pair: np.ndarray, n: int) -> list[bytes]:
    """Per owner its distinct pairs in order and their counts, as little-endian unsigned 32-bit integers."""
    keys, counts = np.unique(owner * IDS + pair, return_counts=True)
    pair, counts = (keys % IDS).astype("<u4"), counts.astype("<u4")
    edge = np.searchsorted(keys // IDS, np.arange(n + 1)).tolist()
    return [pair[s:e].tobytes() + counts[s:e].tobytes() for s, e in zip(edge, edge[1:])]


def _decoded(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs and counts of all rows and how many pairs a row has."""
    column = column.cast(pa.large_binary())
    _, edges, data = column.buffers()
    off = np.frombuffer(edges, np.int64)[column.offset: column.offset + len(column) + 1]
    words = np.frombuffer(data, "<u4")[off[0] // 4: off[-1] // 4].astype(np.int64) if data is not None else np.zeros(0, np.int64)
    off = off - off[0]
    at, n = off[:-1] // 4, np.diff(off) // 8
    return words[spread(at, n)], words[spread(at + n, n)], n


ALIGNERS: dict[str, Aligner] = {}


def aligner(raw_a: bytes, raw_b: bytes) -> Aligner:
    """The aligner of two files' content, kept by the worker."""
    name = hashlib.sha256(raw_a).hexdigest() + hashlib.sha256(raw_b).hexdigest()
    if name not in ALIGNERS:
        ALIGNERS[name] = Aligner(raw_a, raw_b)
    return ALIGNERS[name]


def aligned_texts(docs: DataFrame, path_a: str, path_b: str, text: str = "text") -> DataFrame:
    """(digest, copies, n_a, n_b, n_groups, groups_sha256, links): each distinct text that is not empty, aligned once."""
    sc = docs.sparkSession.sparkContext
    raw = sc.broadcast((open(path_a, "rb").read(), open(path_b, "rb").read()))

    def run(batches):
        machine = aligner(*raw.value)
        for batch in batches:
            for part in slices(batch, "_text"):
                made = machine.align(part.column("_text"))
                yield pa.RecordBatch.from_arrays([part.column("digest"), part.column("copies"), *[pa.array(made[c]) for c in ("n_a", "n_b", "n_groups", "groups_sha256")],
                                                  pa.array(made["links"], pa.binary())],
                                                 names=["digest", "copies", "n_a", "n_b", "n_groups", "groups_sha256", "links"])

    texts = docs.select(F.col(text).alias("_text")).where(F.length("_text") > 0).groupBy("_text").agg(F.count(F.lit(1)).alias("copies"))
    texts = texts.select("_text", "copies", text_digest("_text").alias("digest"))
    return cut_lineage(texts.mapInArrow(run, "digest binary, copies long, n_a long, n_b long, n_groups long, groups_sha256 string, links binary"))


def text_digest(text: str):
    return F.unhex(F.sha2(F.col(text).cast("binary"), 256))


def pair_counts(aligned: DataFrame, n_pairs: int) -> DataFrame:
    """(pair, n): how many links of the corpus hold each pair, copies counted; pairs are numbers below ``n_pairs``."""

    def add(batches):
        total = np.zeros(n_pairs, np.int64)
        for batch in batches:
            pair, n, sizes = _decoded(batch.column("links"))
            np.add.at(total, pair, n * np.repeat(batch.column("copies").to_numpy(), sizes))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["pair", "n"])

    return aligned.select("copies", "links").mapInArrow(add, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row per row of ``docs``.

    n_best counts the links whose pair is the most frequent one of its B id, ties included; count_sum adds up the counts of the pairs.
    """
    spark = docs.sparkSession
    machine = Aligner(open(path_a, "rb").read(), open(path_b, "rb").read())
    ids = numbered(docs.select(F.col(key).alias("_key"), F.when(F.length(text) > 0, text_digest(text)).alias("digest")))
    aligned = aligned_texts(docs, path_a, path_b, text)
    counts = np.zeros(len(machine.pairs), np.int64)
    found = pair_counts(aligned, len(counts)).toPandas()  # bounded by the vocabularies
    counts[found["pair"].to_numpy()] = found["n"].to_numpy()
    most = np.zeros(IDS, np.int64)
    np.maximum.at(most, machine.pairs % IDS, counts)
    shared = spark.sparkContext.broadcast((counts, counts == most[machine.pairs % IDS]))

    def measure(batches):
        total, best = shared.value
        for batch in batches:
            pair, n, sizes = _decoded(batch.column("links"))
            made = [_sums(n, sizes), _sums(n * best[pair], sizes), _sums(n * total[pair], sizes)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("digest", "n_a", "n_b", "n_groups")] + [pa.array(x) for x in made] + [batch.column("groups_sha256")],
                                             names=["digest", *MEASURES])

    kinds = "digest binary, " + ", ".join(f"{c} long" for c in MEASURES[:-1]) + f", {MEASURES[-1]} string"
    out = attach(ids, aligned.drop("copies").mapInArrow(measure, kinds), ["digest"])
    return out.select(F.col("_key").alias(key), *[F.coalesce(c, F.lit("" if c == MEASURES[-1] else 0)).alias(c) for c in MEASURES])


MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
