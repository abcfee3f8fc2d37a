"""Scalar expressions: cleaning, scores, probabilities. All are plain column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low: float, high: float) -> Column:
    """``x`` held between two bounds; NULL stays NULL."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def rounded(x: Column, digits: int) -> Column:
    """``x`` rounded half away from zero, in doubles: for pairs, of which there are many, while ``F.round`` makes a decimal of each. ``x`` times ten to the
    ``digits`` has to stay below 2**62; NULL and NaN stay."""
    unit = float(10**digits)
    return F.signum(x) * F.floor(F.abs(x) * unit + 0.5) / F.lit(unit) + 0.0


# Coefficients of Acklam's published rational approximation of the normal quantile.
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)


def _poly(coefficients, x, last=None):
    out = reduce(lambda acc, c: acc * x + F.lit(c), coefficients[1:], F.lit(coefficients[0]))
    return out if last is None else out * x + F.lit(last)


def normal_quantile(p: Column) -> Column:
    """Inverse of the standard normal distribution function, relative error near 1e-9."""
    q = p - 0.5
    return _quantile(p, q, q * q, _tail(p))


def _tail(p: Column) -> Column:
    return F.sqrt(-2 * F.log(F.when(p < 0.5, p).otherwise(1 - p)))


def _quantile(p: Column, q: Column, r: Column, tail: Column) -> Column:
    low = 0.02425
    outer = _poly(_C, tail) / _poly(_D, tail, 1.0)
    return F.when(p < low, outer).when(p > 1 - low, -outer).otherwise(_poly(_A, r) * q / _poly(_B, r, 1.0))


def with_score(df, p: Column, out: str):
    """P30 as a step by step addition of columns, so that no expression is written out many times."""
    df = df.withColumn("_p", clip(p, 1e-6, 1 - 1e-6)).withColumns({"_q": F.col("_p") - 0.5, "_t": _tail(F.col("_p"))}).withColumn("_r", F.col("_q") * F.col("_q"))
    df = df.withColumn("_z", _quantile(F.col("_p"), F.col("_q"), F.col("_r"), F.col("_t")))
    return df.withColumn(out, clip(50 + 20 * F.col("_z"), 10.0, 90.0)).drop("_p", "_q", "_t", "_r", "_z")


def percentile_to_score(p: Column) -> Column:
    """50 + 20 standard normal quantiles, held between 10 and 90."""
    return clip(50 + 20 * normal_quantile(clip(p, 1e-6, 1 - 1e-6)), 10.0, 90.0)


def safe_cast(x: Column, kind: str) -> Column:
    """Bad text and NaN become NULL."""
    got = x.cast("string").try_cast(kind)
    return F.when(~F.isnan(got), got) if kind in ("double", "float") else got


def canonical_name(x: Column, aliases: dict[str, str]) -> Column:
    """The alias of a name, else the name."""
    return F.coalesce(F.create_map(*[F.lit(v) for kv in aliases.items() for v in kv])[x], x)


def height_to_inches(x: Column) -> Column:
    """P03: '6-3' or '75' to inches."""
    part = F.split(x, "-")
    return F.when(x.contains("-"), F.get(part, F.lit(0)).try_cast("int") * 12 + F.get(part, F.lit(1)).try_cast("int")).otherwise(x.try_cast("int"))


def infer_position(role: Column, height: Column, roles: dict[str, str], default: str = "SF") -> Column:
    """A role label's position, else bins of height, else a default."""
    known = F.create_map(*[F.lit(v) for kv in roles.items() for v in kv])[role]
    bins = F.when(height <= 73, "PG").when(height <= 76, "SG").when(height <= 79, "SF").when(height <= 82, "PF").when(height > 82, "C")
    return F.coalesce(known, bins, F.lit(default))


def share_of_total(parts: list[Column], digits: int = 4) -> list[Column]:
    """Shares of a total, NULL below one attempt."""
    total = reduce(lambda a, b: a + b, parts)
    return [F.when(total >= 1, F.round(p / total, digits)) for p in parts]


def parse_record(x: Column) -> tuple[Column, Column]:
    """Wins and losses of '12-6'."""
    part = F.split(x, "-")
    return F.get(part, F.lit(0)).try_cast("int"), F.get(part, F.lit(1)).try_cast("int")


def season_label(year: Column) -> Column:
    """2025 to '2024-25'."""
    return F.concat((year - 1).cast("string"), F.lit("-"), F.lpad((year % 100).cast("string"), 2, "0"))


def parse_season(x: Column) -> Column:
    """P07: '2025/26' or '2025-26' to 2026."""
    return F.substring(x, 1, 4).try_cast("int") + 1


def swap_last_first(x: Column) -> Column:
    """P08: 'Last, First' to 'First Last'."""
    part = F.split(x, ", ", 2)
    return F.when(F.size(part) == 2, F.concat_ws(" ", part[1], part[0])).otherwise(x)


_ACCENTS = ("áàâäãåéèêëíìîïóòôöõúùûüýÿñçÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÝÑÇ", "aaaaaaeeeeiiiiooooouuuuyyncAAAAAAEEEEIIIIOOOOOUUUUYNC")


def normalize_name(x: Column) -> Column:
    """No accents, lower case, one generational suffix dropped, single spaces."""
    plain = F.lower(F.trim(F.translate(x, *_ACCENTS)))
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"[ ,]+(jr|sr|ii|iii|iv|v)\.?$", ""), r"\s+", " "))


def first_last(x: Column) -> tuple[Column, Column]:
    """P10: first and last token of a normal form."""
    part = F.split(normalize_name(x), " ")
    return F.get(part, F.lit(0)), F.element_at(part, -1)


def initials(x: Column) -> Column:
    """P10: first letters of the first and last token."""
    first, last = first_last(x)
    return F.concat(F.left(first, F.lit(1)), F.left(last, F.lit(1)))


def stable_id(key: Column) -> Column:
    """The first eight bytes of SHA-256, without the sign bit, as a bigint."""
    word = F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return (word % F.lit("9223372036854775808").cast("decimal(20,0)")).cast("bigint")


def minutes_from_share(pct: Column, stored: Column, game: float = 40.0) -> Column:
    """Minutes a game from a percentage, floored at 0; the stored value only where the percentage is NULL."""
    return F.when(pct.isNotNull(), F.greatest(pct / 100, F.lit(0.0)) * game).otherwise(stored)


def zone_bucket(x: Column, y: Column) -> Column:
    """Five zones by distance from the rim at (41.75, 0), after folding the courts."""
    d = F.sqrt((F.abs(x) - 41.75) ** 2 + y * y)
    return F.when(d <= 6, "rim").when(d <= 20.75, "mid").when(F.abs(y) >= 22, "corner3").when(F.abs(y) < 8, "straight3").otherwise("wing3")


def piecewise_linear(x: Column, points: list[tuple[float, float]]) -> Column:
    """Interpolation over break points, flat outside."""
    out = F.when(x <= points[0][0], F.lit(points[0][1]))
    for (x0, y0), (x1, y1) in zip(points, points[1:]):
        out = out.when(x <= x1, y0 + (x - x0) * ((y1 - y0) / (x1 - x0)))
    return out.when(x > points[-1][0], F.lit(points[-1][1]))


def clip_deltas(parts: list[Column], caps: list[float], total: float) -> list[Column]:
    """Caps per component, then one factor that holds their sum within the total cap."""
    held = [clip(p, -c, c) for p, c in zip(parts, caps)]
    whole = reduce(lambda a, b: a + b, held)
    factor = F.when(F.abs(whole) > total, total / F.abs(whole)).otherwise(1.0)
    return [h * factor for h in held]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine_score(a: Column, b: Column) -> Column:
    """P25: cosine as 0-100, a neutral 50 for a zero vector."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, clip(dot(a, b) / norm * 100, 0.0, 100.0)).otherwise(F.lit(50.0))


def cosine_contributions(a: Column, b: Column) -> Column:
    """The cosine's additive parts, one per dimension."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.zip_with(a, b, lambda x, y: F.when(norm > 0, 100 * x * y / norm).otherwise(0.0))


def range_match(p: Column, t: Column, width: Column, floor: float) -> Column:
    """Linear fall from 100 over the range of values."""
    return F.greatest(F.lit(0.0), 1 - F.abs(p - t) / F.greatest(width, F.lit(floor))) * 100


def pace_match(p: Column, t: Column, width: Column, default: float = 50.0) -> Column:
    """As ``range_match`` with a default for missing values and a floor of one."""
    return F.coalesce(range_match(p, t, width, 1.0), F.lit(default))


def logit(p: Column) -> Column:
    """P29, with p held off 0 and 1."""
    q = clip(p, 1e-6, 1 - 1e-6)
    return F.log(q / (1 - q))


def sigmoid(x: Column) -> Column:
    """P29, stable on both sides."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def shrink_weight(prior: Column, observed: Column) -> Column:
    """Observed / (prior + observed), 0 where both are 0."""
    return F.when(prior + observed > 0, observed / (prior + observed)).otherwise(0.0)


def normalize_weights(weights: dict[str, float], present: list[str], fixed: tuple[str, float] | None = None) -> dict[str, float]:
    """Non-negative weights of present columns that add up to one; one component may hold a fixed share."""
    kept = {c: max(0.0, w) for c, w in weights.items() if c in present and (fixed is None or c != fixed[0])}
    share = 1.0 - (fixed[1] if fixed and fixed[0] in present else 0.0)
    total = sum(kept.values())
    kept = {c: share * (w / total if total else 1 / len(kept)) for c, w in kept.items()}
    return kept | ({fixed[0]: fixed[1]} if fixed and fixed[0] in present else {})


def impact_fit(delta: Column, cap: float = 5.0) -> Column:
    """A delta within the cap as 0-100."""
    return (clip(delta, -cap, cap) + cap) / (2 * cap) * 100


def position_lookup(values: Column, position: Column, group: Column) -> Column:
    """A map's value of the position, its group, the total, else the mean."""
    mean = F.aggregate(F.map_values(values), F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(values), F.lit(0))
    return F.coalesce(values[position], values[group], values[F.lit("total")], mean)


def map_difference(total: Column, less: Column) -> Column:
    """Total minus less, key by key."""
    return F.map_zip_with(total, less, lambda k, a, b: F.coalesce(a, F.lit(0.0)) - F.coalesce(b, F.lit(0.0)))


def calibrate_to_baseline(raw: Column, reliability: Column, baseline: float = 15.0) -> Column:
    """P41."""
    return reliability * raw + (1 - reliability) * baseline


def interval_probability(mean: Column, threshold: float, half_width: Column) -> Column:
    """Logistic of the distance to a threshold in half widths; a step for an empty interval."""
    return F.when(half_width > 0, sigmoid((mean - threshold) / half_width)).otherwise(F.when(mean >= threshold, 1.0).otherwise(0.0))


def soft_memberships(distances: Column, n: int = 3) -> Column:
    """Softmax of negative distances over their scale, the n largest as (cluster, weight)."""
    least = F.array_min(distances)
    scale = F.greatest(F.aggregate(distances, F.lit(0.0), lambda a, x: a + x) / F.size(distances), F.lit(1e-9))
    raw = F.transform(distances, lambda d: F.exp(-(d - least) / scale))
    total = F.aggregate(raw, F.lit(0.0), lambda a, x: a + x)
    pairs = F.transform(raw, lambda w, i: F.struct((-w / total).alias("minus"), i.alias("cluster")))
    return F.transform(F.slice(F.array_sort(pairs), 1, n), lambda p: F.struct(p["cluster"].alias("cluster"), (-p["minus"]).alias("weight")))


def cluster_confidence(distances: Column) -> Column:
    """1 - nearest / second nearest distance."""
    s = F.array_sort(distances)
    return F.when(s[1] > 0, 1 - s[0] / s[1]).otherwise(0.0)


def tier_cut(x: Column, cuts: list[float]) -> Column:
    """1 for values under the first cut, one more for each cut reached."""
    return reduce(lambda a, b: a + b, [F.when(x >= c, 1).otherwise(0) for c in cuts], F.lit(1))


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """Similarity of two strings, 1 for equal ones."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))
