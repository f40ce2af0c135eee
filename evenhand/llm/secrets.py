"""Operator 4: secrets by patterns and by a battery of randomness tests.

Patterns find assignments, access keys and long hexadecimal runs. Beyond them, every run of 16 or more code characters is
tested, and so are its pieces of that length between any choice of the separators / + _ and -. The encoding of each is the smallest alphabet that holds it; within that, three tests ask whether it may be random: chi-squared
of the symbols against equal shares, the number of runs above and below the middle, and the correlation of neighbours. A run that none
of them rejects is weighed against ordinary text: the ratio of its probability under equal shares and under the character
shares of the whole corpus has mean one for ordinary text, so its inverse is a valid p-value. Per class of length (powers of
two) the Benjamini-Hochberg rule, with all tested runs and pieces of that class counted, sets the limit at a false-discovery rate of
FDR. Of overlapping ones that pass, the one of the least p-value is the span.

Null and empty texts have no spans. Runs and pieces that overlap a pattern's span are left to it, and what no alphabet holds is not tested. One row per input row.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenhand.llm.common import flat_bytes, slices
from evenhand.session import cut_lineage

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{32,}")
LEAST, ACCESS_LEAST = 8, 16
RUN = 16
FDR = 0.01
REJECT = 0.001
STEPS = 10  # p-values are kept as this many steps per power of ten, rounded up
ALPHABETS = [("decimal", "0123456789"), ("hex", "0123456789abcdef"), ("hex", "0123456789ABCDEF"), ("lower", "abcdefghijklmnopqrstuvwxyz"), ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
             ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"), ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
             ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_")]
SEPARATORS = "/+_-"
CODE = np.zeros(256, bool)
CODE[[ord(c) for c in dict(ALPHABETS)["base62"] + SEPARATORS]] = True
CUTS = [re.compile("[A-Za-z0-9" + "".join(kept) + "]{" + str(RUN) + ",}") for n in range(len(SEPARATORS) + 1) for kept in combinations(SEPARATORS, n)]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the patterns' matches, by start and then as the kinds are listed."""
    found = []
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def pieces_of(run: str) -> list[tuple[int, int]]:
    """(start, end) of a run and of its pieces between separators, each once."""
    return sorted({m.span() for cut in CUTS for m in cut.finditer(run)}) if any(c in run for c in SEPARATORS) else [(0, len(run))]


def best_of(spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Of (start, end, steps) those that overlap none of more steps that stays, by start; the longer first at a tie."""
    kept: list[tuple[int, int]] = []
    for s, e, _ in sorted(spans, key=lambda x: (-x[2], x[0] - x[1], x[0])):
        at = bisect(kept, (s, e))
        if (at == 0 or kept[at - 1][1] <= s) and (at == len(kept) or e <= kept[at][0]):
            kept.insert(at, (s, e))
    return kept


def tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(value: str) -> tuple[str | None, float]:
    """The encoding of a run, and the least p-value of the three tests of randomness; None if no alphabet holds it."""
    name, letters = next(((n, a) for n, a in ALPHABETS if set(value) <= set(a)), (None, ""))
    if name is None:
        return None, 0.0
    k, n = len(letters), len(value)
    v = np.array([letters.index(c) for c in value], np.float64)
    counts = np.bincount(v.astype(int), minlength=k)
    chi = float(((counts - n / k) ** 2).sum() * k / n)
    uniform = tail((chi - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n))
    above = v >= k / 2
    a, b = int(above.sum()), int((~above).sum())
    if a == 0 or b == 0:
        return name, 0.0
    runs = 1 + int((above[1:] != above[:-1]).sum())
    mean = 1 + 2 * a * b / n
    spread = math.sqrt(max((mean - 1) * (mean - 2) / (n - 1), 1e-9))
    in_runs = 2 * tail(abs(runs - mean) / spread)
    c = v - (k - 1) / 2
    serial = 2 * tail(abs(float((c[1:] * c[:-1]).sum())) / ((k * k - 1) / 12 * math.sqrt(n - 1)))
    return name, min(uniform, in_runs, serial)


def first_pass(docs: DataFrame) -> DataFrame:
    """Per row its pattern spans and the runs that may be random; one more row per task with counts of characters and runs."""

    def run(batches):
        shares, lengths = np.zeros(256, np.int64), np.zeros(64, np.int64)
        for batch in batches:
            for part in slices(batch, "_text"):
                body, off = flat_bytes(part.column("_text"))
                code = CODE[body]
                edge = np.zeros(len(body) + 1, bool)
                edge[off] = True
                start, stop = code.copy(), code.copy()
                start[1:] &= ~code[:-1] | edge[1:-1]
                stop[:-1] &= ~code[1:] | edge[1:-1]
                a, b = np.flatnonzero(start), np.flatnonzero(stop) + 1
                shares += np.bincount(body[code], minlength=256)
                long = b - a >= RUN
                a, b = a[long], b[long]
                owner = np.searchsorted(off, a, "right") - 1
                by_doc: dict[int, list[tuple[int, int]]] = {}
                for d, s, e in zip(owner.tolist(), a.tolist(), b.tolist()):
                    by_doc.setdefault(d, []).append((s, e))
                rows = []
                for d, (key, text) in enumerate(zip(part.column("_key").to_pylist(), part.column("_text").to_pylist())):
                    spans = base_spans(text or "")
                    runs = []
                    if d in by_doc:
                        own = body[off[d]: off[d + 1]]
                        point = np.r_[0, np.cumsum((own & 0xC0) != 0x80)]
                        for s, e in by_doc[d]:
                            base, run_ = int(point[s - off[d]]), bytes(body[s:e]).decode()
                            for i, j in pieces_of(run_):
                                x, y = base + i, base + j
                                if any(p < y and x < q for p, q, _ in spans):
                                    continue
                                kind, p = battery(run_[i:j])
                                if kind is not None:
                                    lengths[np.frexp(j - i)[1]] += 1
                                    if p > REJECT:
                                        runs.append({"s": x, "e": y, "value": run_[i:j]})
                    of = [sum(k == kind for _, _, k in spans) for kind in KINDS[:3]]
                    digest = hashlib.sha256(",".join(f"{k}:{x}:{y}" for x, y, k in spans).encode()).hexdigest()
                    rows.append({"key": key, "n_assign": of[0], "n_access": of[1], "n_hex": of[2], "base_sha256": digest,
                                 "base": [{"s": x, "o": KINDS.index(k), "e": y} for x, y, k in spans], "runs": runs, "shares": None, "lengths": None})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
        yield pa.RecordBatch.from_pylist([{"shares": shares.tolist(), "lengths": lengths.tolist()}], schema=schema)

    span = pa.struct([("s", pa.int64()), ("o", pa.int32()), ("e", pa.int64())])
    schema = pa.schema([("key", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("base", pa.list_(span)),
                        ("runs", pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64()), ("value", pa.string())]))), ("shares", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64()))])
    return docs.mapInArrow(run, "key long, n_assign long, n_access long, n_hex long, base_sha256 string, base array<struct<s:long,o:int,e:long>>, "
                                "runs array<struct<s:long,e:long,value:string>>, shares array<long>, lengths array<long>")


def text_p(value: str, log_share: np.ndarray) -> float:
    """Minus the decimal logarithm of the p-value of a run under the character shares of the corpus, zero at least."""
    letters = next(a for _, a in ALPHABETS if set(value) <= set(a))
    bytes_ = np.frombuffer(value.encode(), np.uint8)
    return max(0.0, float(-len(bytes_) * math.log10(len(letters)) - log_share[bytes_].sum()))


def limits(counts: list[tuple[int, int, int]], tested: list[int]) -> dict[int, int]:
    """Per class of length the least number of steps that the Benjamini-Hochberg rule lets pass. counts: (class, steps, runs)."""
    out = {}
    for c in {c for c, _, _ in counts}:
        total = 0
        for steps, n in sorted(((s, n) for x, s, n in counts if x == c), reverse=True):
            total += n
            if tested[c] * 10 ** (-steps / STEPS) <= FDR * total:
                out[c] = steps
    return out


def secret_spans(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_assign, n_access, n_hex, base_sha256, spans, n_random), one row per input row."""
    first = cut_lineage(first_pass(df.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text"))))
    told = first.where("shares is not null")
    sums = lambda c: [r["n"] for r in told.select(F.posexplode(c).alias("i", "v")).groupBy("i").agg(F.sum("v").alias("n")).orderBy("i").collect()] or [0] * 256
    shares, tested = np.array(sums("shares"), np.float64), sums("lengths")
    letters = np.flatnonzero(CODE)
    log_share = np.zeros(256)
    log_share[letters] = np.log10((shares[letters] + 1) / (shares[letters].sum() + len(letters)))

    def weigh(batches):
        for batch in batches:
            out = [[{"s": r["s"], "e": r["e"], "c": int(np.frexp(r["e"] - r["s"])[1]), "steps": int(STEPS * text_p(r["value"], log_share))} for r in rows or ()]
                   for rows in batch.column("runs").to_pylist()]
            kind = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64()), ("c", pa.int32()), ("steps", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, kind)], names=[*batch.schema.names[:-1], "runs"])

    columns = ["key", "n_assign", "n_access", "n_hex", "base_sha256", "base"]
    rows = first.where("shares is null").select(*columns, "runs")
    schema = "key long, n_assign long, n_access long, n_hex long, base_sha256 string, base array<struct<s:long,o:int,e:long>>, runs array<struct<s:long,e:long,c:int,steps:int>>"
    weighed = cut_lineage(rows.mapInArrow(weigh, schema))
    bins = weighed.select(F.explode("runs").alias("r")).groupBy("r.c", "r.steps").count().collect()  # some thousands of bins at most
    least = limits([tuple(b) for b in bins], tested)

    def choose(batches):
        for batch in batches:
            out = [[{"s": s, "o": 3, "e": e} for s, e in best_of([(r["s"], r["e"], r["steps"]) for r in rows if r["c"] in least and r["steps"] >= least[r["c"]]])]
                   for rows in batch.column("runs").to_pylist()]
            kind = pa.list_(pa.struct([("s", pa.int64()), ("o", pa.int32()), ("e", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, kind)], names=batch.schema.names)

    weighed = weighed.mapInArrow(choose, schema.replace("runs array<struct<s:long,e:long,c:int,steps:int>>", "runs array<struct<s:long,o:int,e:long>>"))
    random = F.col("runs")
    named = lambda x: F.concat(F.element_at(F.array(*map(F.lit, KINDS)), x["o"] + 1), F.lit(":"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string"))
    every = F.array_join(F.transform(F.array_sort(F.concat("base", random)), named), ",")
    return weighed.select(F.col("key").alias(key), *columns[1:5], every.alias("spans"), F.size(random).cast("long").alias("n_random"))
