"""Row-multiset comparison of two results, columns sorted by name."""

from __future__ import annotations

import datetime
import decimal
from collections import Counter

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def kind(v):
    if isinstance(v, bool):
        return "bool"
    if isinstance(v, int):
        return "int"
    if isinstance(v, (float, decimal.Decimal)):
        return type(v).__name__
    return type(v).__name__


def norm(v):
    if isinstance(v, float):
        return repr(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return f"{kind(v)}:{v}" if isinstance(v, bool) else str(v)


def compare(cols_a, rows_a, cols_b, rows_b):
    if sorted(cols_a) != sorted(cols_b):
        return f"columns {sorted(cols_a)} vs {sorted(cols_b)}"
    ia = [cols_a.index(c) for c in sorted(cols_a)]
    ib = [cols_b.index(c) for c in sorted(cols_b)]
    a = [tuple(r[i] for i in ia) for r in rows_a]
    b = [tuple(r[i] for i in ib) for r in rows_b]
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    ka = [{kind(r[i]) for r in a if r[i] is not None} for i in range(len(ia))]
    kb = [{kind(r[i]) for r in b if r[i] is not None} for i in range(len(ia))]
    for c, x, y in zip(sorted(cols_a), ka, kb):
        if x != y:
            return f"type of {c}: {x} vs {y}"
    ca, cb = Counter(tuple(map(norm, r)) for r in a), Counter(tuple(map(norm, r)) for r in b)
    if ca != cb:
        return f"values: {sum((ca - cb).values())} of {len(a)} differ, spark {sorted((ca - cb))[:3]} sql {sorted((cb - ca))[:3]}"
    return None
