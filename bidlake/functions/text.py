"""Text functions (FN-4…6, FN-8, FN-12…15, FN-18, FN-20, FN-21, FN-25, FIL-12)."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Units with their spellings, conversions to base units, terms and words left out.
UNITS = {
    "nos": ("no", "nos", "number", "numbers", "pc", "pcs", "piece", "pieces", "qty", "ea", "each", "unit", "units", "नग", "नंग"),
    "kg": ("kg", "kgs", "kilo", "kilos", "kilogram", "kilograms", "किलो", "किग्रा"),
    "g": ("g", "gm", "gms", "gram", "grams", "ग्राम"),
    "ton": ("ton", "tons", "tonne", "tonnes", "mt"),
    "l": ("l", "lt", "ltr", "ltrs", "litre", "litres", "liter", "liters", "लीटर"),
    "ml": ("ml", "mls", "millilitre", "millilitres", "milliliter"),
    "m": ("m", "mtr", "mtrs", "meter", "meters", "metre", "metres", "मीटर"),
    "mm": ("mm", "millimeter", "millimetre"),
    "cm": ("cm", "centimeter", "centimetre"),
    "ft": ("ft", "feet", "foot", "फुट"),
    "inch": ("in", "inch", "inches", '"', "इंच", "इन्च"),
    "sqm": ("sqm", "sq m", "sq.m", "square meter", "square metre", "m2"),
    "sqft": ("sqft", "sq ft", "sq.ft", "square feet", "square foot", "ft2"),
    "box": ("box", "boxes", "bx", "carton", "cartons", "बॉक्स"),
    "bottle": ("bottle", "bottles", "btl", "btls", "बोतल"),
    "bag": ("bag", "bags", "बैग"),
    "roll": ("roll", "rolls"),
    "packet": ("packet", "packets", "pkt", "pkts", "pack", "packs"),
    "set": ("set", "sets"),
    "pair": ("pair", "pairs"),
    "dozen": ("dozen", "dozens", "dz"),
    "coil": ("coil", "coils"),
    "bundle": ("bundle", "bundles", "bdl"),
}
BASE_UNITS = {
    "g": ("kg", 0.001), "kg": ("kg", 1.0), "ton": ("kg", 1000.0), "ml": ("l", 0.001), "l": ("l", 1.0), "mm": ("m", 0.001),
    "cm": ("m", 0.01), "m": ("m", 1.0), "ft": ("m", 0.3048), "inch": ("m", 0.0254), "dozen": ("nos", 12.0), "pair": ("nos", 2.0), "nos": ("nos", 1.0),
}
TERMS = {
    "पाइप": "pipe", "पाईप": "pipe", "पइप": "pipe", "नल": "pipe", "कोहनी": "elbow", "सीमेंट": "cement", "टेप": "tape", "पीवीसी": "pvc",
    "pvcpipe": "pvc pipe", "gi": "galvanised iron", "ms": "mild steel", "ss": "stainless steel", "cpvc": "cpvc", "upvc": "upvc",
    "dia": "diameter", "thk": "thickness", "qty": "quantity", "approx": "approximate", "asst": "assorted", "hex": "hexagonal",
    "sq": "square", "galv": "galvanised", "galvanized": "galvanised", "grey": "gray", "colour": "color", "metre": "meter",
    "litre": "liter", "cls": "class",
}
STOPWORDS = frozenset("of the a an for with and or in to make brand quality std standard type".split())
SCRIPTS = {"hi": "ऀ-ॿ", "gu": "઀-૿", "ta": "஀-௿", "te": "ఀ-౿", "bn": "ঀ-৿"}
EXOTIC_SPACES = "               　"
INVISIBLE = "\u200b\ufeff"
QUOTATION_WORDS = ("quotation", "quote", "proforma", "estimate", "rate list", "price list", "कोटेशन", "दर")

_SPELLING = {s: unit for unit, spellings in UNITS.items() for s in (unit, *spellings)}


def _literal_map(entries: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


def normalize_unit(c: Column) -> Column:
    """FN-6: canonical unit, tried again without a plural s; null if unknown."""
    known = _literal_map(_SPELLING)
    s = F.regexp_replace(F.lower(F.trim(c)), r"\.+$", "")
    return F.coalesce(F.try_element_at(known, c), F.try_element_at(known, s), F.try_element_at(known, F.regexp_replace(s, "s+$", "")))


def base_quantity(quantity: Column, unit: Column) -> Column:
    """FN-7: quantity in the base unit, to six places; as it is where the unit has no base."""
    return in_base(quantity, normalize_unit(unit))


def in_base(quantity: Column, canonical: Column) -> Column:
    """``base_quantity`` where the unit is canonical already."""
    factor = F.try_element_at(_literal_map({u: f for u, (_, f) in BASE_UNITS.items()}), canonical)
    return F.when(factor.isNotNull(), F.round(quantity * factor, 6)).otherwise(quantity)


def base_unit(unit: Column) -> Column:
    canonical = normalize_unit(unit)
    return F.coalesce(F.try_element_at(_literal_map({u: b for u, (b, _) in BASE_UNITS.items()}), canonical), canonical)


#: Of ASCII, letters and digits stay.
_PLAIN = {i: " " for i in range(128) if not chr(i).isalnum()}


def fold_text(text: str | None) -> str:
    """FN-4 on one text: compatibility form, lower case, inches and dashes spelled out, other punctuation
    dropped, digits and letters apart, terms and units in one spelling, stop words left out."""
    if not text:
        return ""
    s = (text if text.isascii() else unicodedata.normalize("NFKC", text)).lower()
    s = re.sub(r'(\d)\s*["”″]', r"\1 inch ", s)
    s = s.replace("×", "x")
    s = s.translate(_PLAIN) if s.isascii() else "".join(" " if c in "/-.–—‒―" or unicodedata.category(c)[0] == "Z" or c in "\t\n" else c if unicodedata.category(c)[0] in "LNM" else " " for c in s)
    s = re.sub(r"(?<=\d)(?=[^\W\d_])|(?<=[^\W\d_])(?=\d)", " ", s)
    words = []
    for token in s.split():
        for part in TERMS.get(token, token).split():
            unit = _SPELLING.get(part) or (_SPELLING.get(part.rstrip("s")) if part.endswith("s") else None)
            words.append(unit or part)
    return " ".join(w for w in words if w not in STOPWORDS)


def _fold(texts: pd.Series) -> pd.Series:
    return texts.map(fold_text, na_action=None)


def normalize_text(c: Column | str) -> Column:
    """FN-4: NFKC and Unicode categories have no built-in."""
    return F.pandas_udf(_fold, T.StringType())(c)


def normalize_tokens(normalized: Column) -> Column:
    """FN-5: the sorted set of words of an FN-4 text, as a signature."""
    return F.array_sort(F.array_distinct(F.filter(F.split(normalized, " "), lambda t: t != "")))


def ascii_signature(c: Column) -> Column:
    """FN-5 over plain ASCII text with built-ins alone: lower case, other characters to spaces."""
    return normalize_tokens(F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")))


def sizes(text: str) -> dict[str, float]:
    """FN-8: first size of each base unit in a folded text."""
    out: dict[str, float] = {}
    for number, unit in re.findall(r"(\d+(?:\.\d+)?)\s+([^\W\d_]+)", text):
        if unit in BASE_UNITS:
            base, factor = BASE_UNITS[unit]
            out.setdefault(base, round(float(number) * factor, 6))
    return out


def size_attributes(c: Column) -> Column:
    """FN-8: first size per base unit, with built-ins."""
    s = F.lower(c)
    pattern = r"(\d+(?:\.\d+)?)\s*(" + "|".join(sorted(BASE_UNITS, key=len, reverse=True)) + r")\b"
    pairs = F.arrays_zip(F.regexp_extract_all(s, F.lit(pattern), F.lit(1)).alias("n"), F.regexp_extract_all(s, F.lit(pattern), F.lit(2)).alias("u"))
    entries = F.transform(pairs, lambda p: F.struct(base_unit(p["u"]).alias("key"), F.round(p["n"].cast("double") * _literal_map({u: f for u, (_, f) in BASE_UNITS.items()})[p["u"]], 6).alias("value")))
    first = F.filter(entries, lambda e, i: F.coalesce(F.array_position(F.transform(F.slice(entries, F.lit(1), F.greatest(i, F.lit(1))), lambda x: x["key"]), e["key"]) == 0, F.lit(True)) | (i == 0))
    return F.map_from_entries(first)


# FN-25: indel similarity, 1 - (inserts + deletes) / (both lengths), by bit-parallel longest common subsequence.
def _lcs(a: str, b: str) -> int:
    masks: dict[str, int] = {}
    for k, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & masks.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    return 2 * _lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    both, only_x, only_y = sorted(x & y), sorted(x - y), sorted(y - x)
    if both and (not only_x or not only_y):
        return 1.0
    base = " ".join(both)
    left, right = " ".join([*both, *only_x]), " ".join([*both, *only_y])
    return max(ratio(left, right), *([ratio(base, left), ratio(base, right)] if both else [0.0]))


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter text against windows of the longer one, cut at its ends too."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 0.0
    n = len(short)
    return max(ratio(short, long[max(0, k) : k + n]) for k in range(1 - n, len(long)) if long[max(0, k) : k + n])


def similarity_of(a: str | None, b: str | None) -> float:
    """FN-25: blended score of two descriptions, with sizes that agree or contradict."""
    return folded_similarity(fold_text(a), fold_text(b))


@lru_cache(1 << 16)
def folded_similarity(x: str, y: str) -> float:
    """The same of two folded texts."""
    if not x or not y:
        return 0.0
    if x == y:
        return 1.0
    score = 0.6 * max(token_sort_ratio(x, y), token_set_ratio(x, y)) + 0.2 * partial_ratio(x, y) + 0.2 * ratio(x, y)
    sx, sy = sizes(x), sizes(y)
    shared = sx.keys() & sy.keys()
    if shared:
        score = min(1.0, score + 0.05) if all(sx[k] == sy[k] for k in shared) else score * 0.45
    return round(score, 4)


#: Bins that characters are counted in for bounds; characters that share one only raise a bound.
BINS = 64


def _bag(x: str) -> np.ndarray:
    return np.bincount(np.frombuffer(x.encode("utf-32-le"), dtype=np.uint32) % BINS, minlength=BINS)


def similarity_bounds(xs: list[str], ys: list[str]) -> np.ndarray:
    """For pairs of folded texts, numbers that ``folded_similarity`` does not pass, without aligning any: from
    lengths, characters in common, tokens in common and sizes. Texts of one kind are counted once."""
    names = {n: k for k, n in enumerate(dict.fromkeys([*xs, *ys]))}
    bags = np.array([_bag(n) for n in names]).reshape(len(names), BINS)
    length = np.array([len(n) for n in names])
    tokens = [n.split() for n in names]
    unique = [set(t) for t in tokens]
    i, j = np.array([names[x] for x in xs], dtype=np.int64), np.array([names[y] for y in ys], dtype=np.int64)
    common = np.zeros(len(i), dtype=np.int64)
    for lo in range(0, len(i), 65536):
        part = slice(lo, lo + 65536)
        common[part] = np.minimum(bags[i[part]], bags[j[part]]).sum(1)
    both = length[i] + length[j]
    ratios = 2 * common / np.maximum(both, 1)
    partial = 2 * common / np.maximum(np.minimum(length[i], length[j]) + common, 1)
    out = np.empty(len(i))
    for k, (p, q) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        if not length[p] or not length[q]:
            out[k] = 0.0
            continue
        if p == q:
            out[k] = 1.0
            continue
        u, v = unique[p], unique[q]
        shared = u & v
        best = ratios[k]
        if shared and (len(shared) == len(u) or len(shared) == len(v)):
            best = 1.0
        else:
            left, right = (sum(map(len, t)) + len(t) - 1 for t in (u, v))
            # repeated tokens count once here, so the texts may be shorter than before
            best = max(best, min(1.0, 2 * min(int(common[k]), left, right) / (left + right)))
            if shared:
                base = sum(map(len, shared)) + len(shared) - 1
                best = max(best, 2 * base / (base + left), 2 * base / (base + right))
        score = 0.6 * best + 0.2 * min(1.0, partial[k]) + 0.2 * ratios[k]
        sx, sy = sizes(xs[k]), sizes(ys[k])
        sizes_shared = sx.keys() & sy.keys()
        if sizes_shared:
            score = min(1.0, score + 0.05) if all(sx[z] == sy[z] for z in sizes_shared) else score * 0.45
        out[k] = round(score + 1e-9, 4)
    return out


def _bounded(x: pd.Series, y: pd.Series) -> pd.Series:
    return pd.Series(similarity_bounds([a or "" for a in x], [b or "" for b in y]), dtype="float64")


def similarity_bound(x: Column | str, y: Column | str) -> Column:
    """FN-25: an upper bound of ``similarity_folded``, at a fraction of its cost."""
    return F.pandas_udf(_bounded, T.DoubleType())(x, y)


def _similar(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similarity_of(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def similarity(a: Column | str, b: Column | str) -> Column:
    return F.pandas_udf(_similar, T.DoubleType())(a, b)


def _similar_folded(x: pd.Series, y: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else folded_similarity(a, b) for a, b in zip(x, y, strict=True)], dtype="float64")


def similarity_folded(x: Column | str, y: Column | str) -> Column:
    return F.pandas_udf(_similar_folded, T.DoubleType())(x, y)


def detect_language(c: Column) -> Column:
    """FN-14: hint at the script of a text."""
    counts = {k: F.length(F.regexp_replace(c, f"[^{r}]", "")) for k, r in SCRIPTS.items()}
    latin = F.length(F.regexp_replace(c, "[^A-Za-z]", ""))
    other = sum(counts.values(), F.lit(0))
    most = F.greatest(*counts.values())
    script = F.coalesce(*[F.when(n == most, F.lit(k)) for k, n in counts.items()])
    mixed = (other >= 8) | ((other > 0) & (other >= 0.05 * F.greatest(latin, F.lit(1))))
    return (
        F.when(c.isNull() | (c == "") | ((latin == 0) & (other == 0)), "unknown")
        .when(mixed & (latin > 0), F.concat(script, F.lit("+en")))
        .when(mixed | (latin == 0), script)
        .otherwise("en")
    )


def normalize_spaces(c: Column) -> Column:
    """FN-15: exotic spaces to plain ones; zero-width spaces and byte-order marks go. Texts without any, which most are, stay as they are."""
    plain = F.translate(c, EXOTIC_SPACES + INVISIBLE, " " * len(EXOTIC_SPACES))
    return F.when((F.octet_length(c) > F.length(c)) & c.rlike(r"[\u00a0\u1680\u2000-\u200b\u202f\u205f\u3000\ufeff]"), plain).otherwise(c)


def lower_in_place(c: Column) -> Column:
    """Lower case with every character where it was: the one that becomes two, İ, is another single letter instead."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.lower(F.replace(c, F.lit("İ"), F.lit("ı"))))


def validity_days(c: Column) -> Column:
    """FN-12: days that an offer stands."""
    return F.regexp_extract(c, r"(?i)(\d{1,3})\s*(?:days?|दिन)", 1).try_cast("int")


def advance_percent(c: Column) -> Column:
    """FN-12: share to be paid in advance."""
    return F.regexp_extract(c, r"(?i)(\d{1,3})\s*%\s*(?:advance|adv)", 1).try_cast("double")


def incoterm(c: Column) -> Column:
    """FN-12: delivery term."""
    term = F.lower(F.regexp_extract(c, r"(?i)\b(ex[\s-]?works|ex[\s-]?godown|fob|cif|cfr|dap|ddp|exw|free\s+delivery|door\s+delivery)\b", 1))
    return F.when(term != "", term)


def phone_digits(c: Column) -> Column:
    """FN-13."""
    s = F.regexp_replace(c, r"\D", "")
    return F.when(s != "", s)


def email_key(c: Column) -> Column:
    """FIL-6, FN-13."""
    return F.lower(F.trim(c))


def looks_like_quotation(c: Column) -> Column:
    """FIL-12: any keyword in the text."""
    low = F.lower(c)
    found = F.lit(False)
    for word in QUOTATION_WORDS:
        found = found | low.contains(word)
    return F.coalesce(found, F.lit(False))


def model_json(c: Column, schema: str) -> Column:
    """FN-21: tolerant parse of a model's answer: code fences dropped, outermost braces taken."""
    return F.from_json(F.regexp_extract(c, r"(?s)\{.*\}", 0), schema, {"mode": "PERMISSIVE"})


def amounts_in(c: Column) -> Column:
    """FN-20: amounts that a text states."""
    found = F.regexp_extract_all(c, F.lit(r"\d[\d,]*(?:\.\d+)?"), F.lit(0))
    return F.transform(found, lambda n: F.replace(n, F.lit(","), F.lit("")).try_cast("double"))


def register(spark: SparkSession) -> None:
    """Named SQL functions."""
    spark.udf.register("normalize_text", F.pandas_udf(_fold, T.StringType()))
    spark.udf.register("similarity", F.pandas_udf(_similar, T.DoubleType()))
