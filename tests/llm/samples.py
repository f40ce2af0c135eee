"""Small texts for the operators: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

SF = "/root/testdata/sf0.001"


def texts(spark, n: int = 60) -> list[tuple[int | None, str | None]]:
    """Some given documents and the odd cases, as (doc_id, text)."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(n).collect()]
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    base = [rnd.choice(words) for _ in range(120)]
    near = list(base)
    near[60] = "changed"
    far = [w if i % 5 else "other" for i, w in enumerate(base)]
    return rows + [(9001, None), (9002, ""), (9003, " \n\t "), (9004, "a b"), (9005, "A  B"), (9006, "ab" * 700), (9007, " ".join(base)), (9008, " ".join(near)), (9009, " ".join(far)),
                   (9010, rows[0][1]), (9010, rows[0][1]), (9011, "é ÀÖ× ñ 漢字 🙂 'tis it's <|endoftext|> x"), (9012, "The " * 400), (9013, "x\n\n" + " ".join(base) + "\n" + " ".join(near)), (None, " ".join(base[:70]))]


def frame(spark, rows, parts: int = 3):
    """The rows with columns that share names used inside the operators."""
    schema = "doc_id long, text string, _text string, cls long, n int, _key string"
    return spark.createDataFrame([(i, t, "x", 7, 1, "y") for i, t in rows], schema).repartition(parts)
