"""Column expressions: parsing, mapping, scaling. All stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts read as true, and texts read as missing.
TRUE_TEXTS = ("true", "1", "yes", "t")
MISSING_TEXTS = ("", "nan", "none", "na", "unknown")


def col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def finite(c) -> Column:
    """NaN and infinities become NULL, so aggregates skip them."""
    v = col(c).cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v)


def to_number(c, first_of: str | None = None) -> Column:
    """Number or NULL; with ``first_of`` only the first token of a separated list counts."""
    text = col(c).cast("string")
    if first_of is not None:
        text = F.split(text, "\\Q" + first_of + "\\E").getItem(0)
    return F.trim(text).try_cast("double")


def parse_bool(c) -> Column:
    return F.lower(F.trim(col(c))).isin(*TRUE_TEXTS)


def normalise_category(c) -> Column:
    t = F.trim(col(c))
    return F.when(F.lower(t).isin(*MISSING_TEXTS), None).otherwise(t)


def entity_key(site, local_id) -> Column:
    return F.concat_ws("::", col(site).cast("string"), col(local_id).cast("string"))


def map_label(c, mapping: dict) -> Column:
    """Mapped value, NULL when the text is not in the mapping."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), F.trim(col(c)))


def map_label_codes(c, positive, negative) -> Column:
    return F.when(col(c).isin(*positive), 1).when(col(c).isin(*negative), 0)


def map_label_rules(c, rules) -> Column:
    """Text rules in order; a later rule that matches overrides an earlier one.

    Each rule is ``(kind, text, label)`` or ``(kind, text, label, unless)``, kind being
    contains, equals or startswith; ``unless`` is a text that must be absent.
    """
    text = F.lower(F.trim(F.replace(col(c), F.lit(" "), F.lit(" "))))
    out = F.lit(None).cast("int")
    for rule in rules:
        kind, word, label = rule[:3]
        hit = {"contains": text.contains, "equals": text.__eq__, "startswith": text.startswith}[kind](word)
        if len(rule) > 3:
            hit = hit & ~text.contains(rule[3])
        out = F.when(hit, label).otherwise(out)
    return out


def extract_token(c, how: str, arg=None) -> Column:
    """``site`` (before ``::``), ``dash`` (nth dash token), ``digits``, ``letter``, ``slice``."""
    t = col(c)
    if how == "site":
        return F.split(t, "::").getItem(0)
    if how == "dash":
        return F.split(t, "-").getItem(1 if arg is None else arg)
    if how == "digits":
        return F.nullif(F.regexp_extract(t, r"(\d+)", 1), F.lit("")).try_cast("bigint")
    if how == "letter":
        return F.nullif(F.regexp_extract(t, r"([A-Za-z])", 1), F.lit(""))
    if how == "slice":
        return F.substring(t, arg[0] + 1, arg[1] - arg[0])
    raise ValueError(how)


def parse_age(c) -> Column:
    return F.substring(col(c), 1, 3).try_cast("int").cast("double")


def slugify(c) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(col(c), r"[^A-Za-z0-9_-]", "_"), r"^_+|_+$", ""))


def name_family(c, sep: str = "_") -> Column:
    """``<image>_<family>_<name>`` to a struct of image type and family."""
    parts = F.split(col(c), sep)
    image = F.when(parts.getItem(0).startswith("wavelet"), "wavelet").otherwise(parts.getItem(0))
    return F.struct(image.alias("image_type"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("family"))


def clip(c, lo, hi) -> Column:
    return F.greatest(F.least(col(c), F.lit(hi)), F.lit(lo))


def logit(c, eps: float = 1e-6) -> Column:
    p = clip(c, eps, 1 - eps)
    return F.log(p / (1 - p))


def sigmoid(c) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col(c)))


def hash_order(seed, *keys) -> Column:
    """60-bit number from md5, the order used for every seeded split and draw."""
    digest = F.md5(F.concat_ws("|", col(seed).cast("string") if isinstance(seed, Column) else F.lit(str(seed)),
                               *[col(k).cast("string") for k in keys]))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def ratio(a, b) -> Column:
    """a / b, NULL where b is zero."""
    d = col(b)
    return F.when(d != 0, col(a) / d)


def first_rule(rules, default: str = "included") -> Column:
    """Name of the first failing rule; ``rules`` is an ordered list of (name, failing condition)."""
    return F.coalesce(*[F.when(cond, F.lit(name)) for name, cond in rules], F.lit(default))


def all_of(conds) -> Column:
    return reduce(lambda a, b: a & b, conds)
