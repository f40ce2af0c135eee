"""Alignment, mixing and the Merkle manifest against plain Python."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest

from pyspark.sql import functions as F

from evenhand.llm import alignment, merkle, mixing
from evenhand.llm.queries import BYTE_BPE, PIECE_BPE
from tests.llm.samples import SF, frame, texts

import public_tokenizers

A, B = public_tokenizers.path(BYTE_BPE), public_tokenizers.path(PIECE_BPE)


def rows_of(df, *cols):
    return Counter(tuple(r) for r in df.select(*cols).collect())


# ---- alignment ----------------------------------------------------------------------------------------------
def plain_alignment(rows):
    import json

    import sentencepiece
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(A)
    lib.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=B)
    spec = json.load(open(A))
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    code, extra = {chr(b): b for b in printable}, 256
    for b in range(256):
        if b not in printable:
            code[chr(extra)] = b
            extra += 1
    name = {i: p for p, i in spec["model"]["vocab"].items()}
    bytes_a = lambda i: bytes(code[c] for c in name[i])
    bytes_b = lambda i: bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()

    def ends(ids, of):
        at, out = 0, []
        for i in ids:
            at += len(of(i))
            out.append(at)
        return out

    made, totals = [], Counter()
    for key, text in rows:
        a, b = (lib.encode(" " + text, add_special_tokens=False).ids, model.encode(text)) if text else ([], [])
        want = (" " + (text or "")).encode()
        if b"".join(map(bytes_a, a)) != want or b"".join(map(bytes_b, b)) != want:
            a, b = [], []
        ea, eb = ends(a, bytes_a), ends(b, bytes_b)
        both = sorted(set(ea) & set(eb))
        links = [(a[ea.index(e)], b[eb.index(e)]) for e in both]
        groups, low = [], 0
        for e in both:
            groups.append(",".join(str(i) for i, x in zip(a, ea) if low < x <= e) + "|" + ",".join(str(i) for i, x in zip(b, eb) if low < x <= e))
            low = e
        totals.update(links)
        made.append((key, a, b, groups, links))
    top = defaultdict(int)
    for (_, j), n in totals.items():
        top[j] = max(top[j], n)
    return Counter((key, len(a), len(b), len(groups), len(links), sum(totals[x] == top[x[1]] for x in links), sum(totals[x] for x in links),
                    hashlib.sha256(";".join(groups).encode()).hexdigest() if a else "") for key, a, b, groups, links in made)


ODD = [(9300, "▁x y"), (9301, "<|endoftext|> <s> <unk> <0x41>"), (9302, "a\x00b\r\n\t  c "), (9303, "𠀀𠀁 word 𠮷"), (9304, "  \u0085x y"), (9305, " " * 90 + "x" + " " * 7),
       (9306, "xy" * 9000), (9307, "🙂‍🙃 é ﬁ Ⅷ ٣"), (None, "same"), (9308, "same"), (9308, None)]


def test_alignment_against_brute_force(spark):
    rows = [(i, t) for i, t in texts(spark, 25) if t is None or len(t) < 6000] + ODD
    got = rows_of(alignment.align_tokenizers(frame(spark, rows), A, B), "doc_id", *alignment.MEASURES)
    assert got == plain_alignment(rows)


def test_alignment_of_nothing_and_of_texts_without_tokens(spark):
    df = frame(spark, [(1, None), (2, ""), (2, "")])
    assert rows_of(alignment.align_tokenizers(df, A, B), "doc_id", *alignment.MEASURES) == Counter({(1, 0, 0, 0, 0, 0, 0, ""): 1, (2, 0, 0, 0, 0, 0, 0, ""): 2})
    assert alignment.align_tokenizers(df.where("doc_id = 3"), A, B).count() == 0


def test_every_character_is_split_as_the_library_does():
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(A)
    lib.encode_special_tokens = True
    machine = alignment.Aligner(open(A, "rb").read(), open(B, "rb").read())
    assert machine.fast is not None and len(machine.pairs) < 1_000_000
    some = [f" a{chr(c)}b {chr(c)}1{chr(c)}.{chr(c)}{chr(c)}  {chr(c)} '{chr(c)} \n{chr(c)}" for c in range(0, alignment.PLAIN, 7) if not 0xD800 <= c < 0xE000]
    assert [machine.encode_a(t) for t in some] == [e.ids for e in lib.encode_batch(some, add_special_tokens=False)]


# ---- mixing -------------------------------------------------------------------------------------------------
def water(sizes, weights, share, epochs):
    """Targets by the rounds as they are told: clamp, deal again."""
    total, out, free = share * sum(sizes.values()), {}, dict(weights)
    while free:
        rest = total - sum(out.values())
        over = [s for s in free if rest * free[s] / sum(free.values()) > epochs * sizes[s]]
        if not over:
            return out | {s: rest * w / sum(free.values()) for s, w in free.items()}
        for s in over:
            out[s] = epochs * sizes[s]
            del free[s]
    return out


def sourced(spark, rows, parts=3):
    return spark.createDataFrame(rows, "doc_id long, source string, text string, size long, _row long, target string, _key int").repartition(parts)


ROWS = [(i, ["web", "a", None, "", "Zoo", "ä"][i % 6] if i % 3 else "web", None if i % 17 == 0 else "w " * (i * 7919 % 60), 0, 0, "t", 1) for i in range(300)]
ROWS += [(1, "web", "x y z", 0, 0, "t", 1)] * 40 + [(None, None, "long " * 3000, 0, 0, "t", 1), (None, "one", "x", 0, 0, "t", 1)]


@pytest.mark.parametrize("share", [0.3, 1.5, 2.0, 5.0])
def test_mix_against_rounds(spark, share):
    got = mixing.mixture_report(sourced(spark, ROWS), share=share).join(spark.createDataFrame([(1,)], "one int"), how="cross").drop("one").collect()
    sizes = defaultdict(int)
    for r in ROWS:
        sizes[r[1]] += len((r[2] or "").split())
    names = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    want = water(sizes, weights, share, 2.0)
    by_size = {(s, n): t for (s, n), t in zip(((s, sizes[s]) for s in names), (want[s] for s in names))}
    assert len(got) == len(ROWS)
    seen = Counter()
    for r in got:
        assert any(n == r["source_size"] and abs(t - r["target"]) < 1e-6 * max(t, 1) for (_, n), t in by_size.items())
        assert r["taken"] <= 2 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        seen[r["source_size"], round(r["target"], 6)] += r["taken"]
    longest = {s: max(len((r[2] or "").split()) for r in ROWS if r[1] == s) for s in names}
    for s in names:
        assert abs(seen[sizes[s], round(want[s], 6)] - want[s]) <= longest[s] / 2 + 1e-6, s


def test_reruns_of_the_mix_agree_and_the_mix_holds_what_the_report_says(spark):
    cols = ("doc_id", "size", "source_size", "target", "taken")
    first = rows_of(mixing.mixture_report(sourced(spark, ROWS)), *cols)
    assert first == rows_of(mixing.mixture_report(sourced(spark, ROWS[::-1], 7)), *cols)
    assert first != rows_of(mixing.mixture_report(sourced(spark, ROWS), seed=2), *cols)
    mix = mixing.mixture(sourced(spark, ROWS))
    assert mix.columns == ["doc_id", "source", "text", "size", "_row", "target", "_key"]
    assert sum(len((r["text"] or "").split()) for r in mix.collect()) == sum(r[4] * n for r, n in first.items())
    assert set(map(tuple, mix.collect())) <= set(ROWS)


def test_mix_of_nothing_and_of_no_words(spark):
    assert mixing.mixture_report(sourced(spark, ROWS).where("doc_id < 0")).count() == 0
    got = mixing.mixture_report(sourced(spark, [(1, "a", None, 0, 0, "t", 1), (2, None, " ", 0, 0, "t", 1)])).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


# ---- Merkle manifest ----------------------------------------------------------------------------------------
def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def climb(nodes, i, other):
    """Root, siblings of node i, and the root with ``other`` in its place."""
    siblings = []
    while len(nodes) > 1:
        pair = [k for k in (i // 2 * 2, i // 2 * 2 + 1) if k < len(nodes)]
        siblings += [nodes[k] for k in pair if k != i]
        other = h(*[other if k == i else nodes[k] for k in pair])
        nodes = [h(*nodes[k:k + 2]) for k in range(0, len(nodes), 2)]
        i //= 2
    return nodes[0], siblings, other


def plain_manifest(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[2]].append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: sorted(((r[0] is not None, r[0] or 0, leaf_of(r), r) for r in by[x]), key=lambda t: t[:3]) for x in langs}
    subroots = [climb([t[2] for t in trees[x]], 0, "")[0] for x in langs]
    out = Counter()
    for g, x in enumerate(langs):
        leaves = [t[2] for t in trees[x]]
        for i, (_, _, leaf, r) in enumerate(trees[x]):
            changed = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            other = leaf_of((*r[:3], r[3] + 1, r[4])) if changed else leaf
            subroot, low, folded = climb(leaves, i, other)
            root, high, folded = climb(subroots, g, folded)
            out[r[0], leaf, subroot, root, h(*low, *high), folded, folded == root] += 1
    return out


MANIFEST = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def leaves(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, node string, at int").repartition(parts)


@pytest.mark.parametrize("levels", [1, 2, 10])
def test_manifest_against_a_plain_tree(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    langs = ["en", "en", "en", None, "", "é", "z", "𠀀", "￮"]
    rows = [(i * 37 % 101, "s" if i % 5 else None, langs[i % 9] if i < 90 else "en", None if i % 11 == 0 else i, "é" * (i % 4) if i % 13 else None) for i in range(131)]
    rows += [(7, "s", "en", 3, "t")] * 9 + [(None, None, None, None, None), (None, "", "en", 0, ""), (2**62, "s", "alone", 1, "x" * 200_000)]
    assert rows_of(merkle.tamper_check(leaves(spark, rows)), *MANIFEST) == plain_manifest(rows)


@pytest.mark.parametrize("rows", [[], [(7, "s", "en", 3, "t")], [(1, "s", "en", 3, "t"), (2, "s", "fr", 3, "t")]])
def test_small_manifests(spark, rows):
    assert rows_of(merkle.tamper_check(leaves(spark, rows)), *MANIFEST) == plain_manifest(rows)


def test_manifest_of_the_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = merkle.tamper_check(docs)
    assert rows_of(got, *MANIFEST) == plain_manifest(rows)
    assert 0 < got.where(~F.col("verified")).count() < docs.count()
