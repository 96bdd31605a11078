"""Numeric functions of metrics and rewards, and vectors as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays of equal length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def unit(a: Column) -> Column:
    """The vector at length one; unchanged if it is all zeros."""
    n = F.sqrt(dot(a, a))
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a)


def map_cosine(a: Column, b: Column) -> Column:
    """Cosine of two sparse vectors given as maps; 0 if one has no length."""
    inner = F.aggregate(F.map_entries(a), F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(F.try_element_at(b, e["key"]), F.lit(0)).cast("double"))
    square = lambda m: F.aggregate(F.map_values(m), F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    n = F.sqrt(square(a)) * F.sqrt(square(b))
    return F.when(n > 0, inner / n).otherwise(F.lit(0.0))


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 where the whole is 0."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def gaussian_score(x: Column, mean: Column, std: Column, overall_std: Column, floor: float = 0.5) -> Column:
    """exp(-z*z/2), z taken against a deviation of at least floor times the overall one."""
    z = (x - mean) / F.greatest(std, floor * overall_std, F.lit(1e-6))
    return F.exp(-z * z / 2)


def one_sided_score(x: Column, mean: Column, std: Column) -> Column:
    """1 from the mean upwards, Gaussian below."""
    z = (x - mean) / F.greatest(std, F.lit(1e-6))
    return F.when(x >= mean, F.lit(1.0)).otherwise(F.exp(-z * z / 2))


def rescaled(x: Column, baseline: Column | float) -> Column:
    """How far x lies between a baseline and 1, from 0 to 1."""
    b = F.lit(baseline) if isinstance(baseline, (int, float)) else baseline
    return F.least(F.greatest((x - b) / (1 - b), F.lit(0.0)), F.lit(1.0))


def fit(delta: Column, target: Column, floor: float) -> Column:
    """1 at no deviation from a target, falling with the deviation relative to it."""
    return 1 / (1 + F.abs(delta) / F.greatest(target, F.lit(floor)))


def mean_of_known(*xs: Column) -> Column:
    """Mean of the arguments that are not null; null if all are."""
    known = sum((F.when(x.isNotNull(), 1).otherwise(0) for x in xs), F.lit(0))
    total = sum((F.coalesce(x, F.lit(0.0)) for x in xs), F.lit(0.0))
    return F.when(known > 0, total / known)


def jaccard(a: Column, b: Column) -> Column:
    """Share of common items among all different ones; 0 for two empty arrays."""
    return share(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def percentile(x: Column, q: float) -> Column:
    """Exact percentile with linear interpolation, as an aggregate."""
    return F.percentile(x, F.lit(q))


#: Offset and prime of the 32-bit hash, and increment of the small generator.
HASH_START, HASH_PRIME, STEP = 2166136261, 16777619, 1831565813
_LOW = 4294967295


def small_hash_sql(text: str, duck: bool = False) -> str:
    """SQL of the 32-bit hash of a text's code points, each taken in whole."""
    if duck:
        return f"list_reduce(list_prepend({HASH_START}::BIGINT, [unicode(c)::BIGINT for c in regexp_extract_all({text}, '(?s).')]), lambda h, c: (xor(h, c) * {HASH_PRIME}) & {_LOW})"
    return f"aggregate(regexp_extract_all({text}, '(?s).', 0), {HASH_START}L, (h, c) -> ((h ^ ascii(c)) * {HASH_PRIME}L) & {_LOW}L)"


def first_draw_sql(seed: str, duck: bool = False) -> str:
    """SQL of the first number in [0, 1) that the small generator draws from a seed of 32 bits."""
    xor = (lambda a, b: f"xor({a}, {b})") if duck else (lambda a, b: f"(({a}) ^ ({b}))")
    right = (lambda a, n: f"(({a}) >> {n})") if duck else (lambda a, n: f"shiftright({a}, {n})")
    left = (lambda a, n: f"(({a}) << {n})") if duck else (lambda a, n: f"shiftleft({a}, {n})")
    # products of two numbers of 32 bits, of which 32 bits are kept, in steps that never exceed 63
    times = lambda a, b: f"(((({a}) & 65535) * ({b}) + {left(f'({right(a, 16)} * ({b})) & 65535', 16)}) & {_LOW})"
    a = f"((({seed}) + {STEP}) & {_LOW})"
    t = times(xor(a, right(a, 15)), f"(({a}) | 1)")
    u = xor(t, f"(({t}) + {times(xor(t, right(t, 7)), f'(({t}) | 61)')}) & {_LOW}")
    return f"({xor(u, right(u, 14))} / {'4294967296::DOUBLE' if duck else '4294967296D'})"
