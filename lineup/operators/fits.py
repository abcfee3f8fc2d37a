"""All-pairs fits of players and schools: style cosine and roster gaps. Vectors are scaled and normed once per row before the join, so a pair costs
products and sums of columns; the join is on the season and the schools of a season are few, so their side is broadcast after a check of its size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lineup.functions.fit import _or, clip
from lineup.functions.playing import POSITIONS, depth_score
from lineup.functions.scalars import calibrate_to_baseline, pace_match, range_match, rounded
from lineup.operators.aggregates import median_impute
from lineup.operators.joins import small
from lineup.operators.order import few_rows
from lineup.operators.windows import _by
from lineup.sources.io import stage

# Weights of the raw overall score with neutral stubs of 50, floors of a range, the gap score's baseline.
RAW_WEIGHTS, STUB = {"scheme": 0.30, "gap": 0.20}, 0.50
RANGE_FLOOR, GAP_BASELINE = 0.10, 15.0
MIX = ("three", "rim", "mid")


def _add(xs) -> Column:
    return reduce(lambda a, b: a + b, xs)


def _held(x: Column) -> Column:
    """A score that is there, between 0 and 100."""
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(100.0))


def unit(xs: list[Column]) -> list[Column]:
    """The vector of length one; a zero vector stays zero."""
    norm = F.sqrt(_add([x * x for x in xs]))
    return [F.when(norm > 0, x / norm).otherwise(0.0) for x in xs]


def _ranges(players: DataFrame, teams: DataFrame, names: list[str], season: str) -> DataFrame:
    """Per season the range of each column over players and teams."""
    both = players.select(season, *names).unionByName(teams.select(season, *names))
    return both.groupBy(season).agg(*[(F.max(c) - F.min(c)).alias(f"_w_{c}") for c in names])


def scheme_fit(players: DataFrame, teams: DataFrame, season: str = "season", style: int = 0, tempo_default: float = 68.0, digits: tuple[int, int, int] = (2, 1, 6)) -> DataFrame:
    """Every player (``player, season, three, rim, mid, tempo``) with every team (``team, ...``) of its season.

    Cosine of the shot mix 0-100, matches by the season's ranges, tempo match, additive contributions, raw overall score. Mixes are held between
    0 and 1 and players without any are left out. ``style``: length of an array ``style`` on both sides; a second cosine where both are covered.
    ``digits``: of scores, matches and contributions.
    """
    score, match, part = digits
    held = players.withColumns({c: clip(F.col(c), 0.0, 1.0) for c in MIX}).where(_add([_or(F.col(c), 0) for c in MIX]) > 0)
    names = [*MIX, *(f"style_{k}" for k in range(style))]
    flat = lambda df: df.withColumns({f"style_{k}": F.get("style", F.lit(k)) for k in range(style)}) if style else df
    held, teams = flat(held), flat(teams)
    width = _ranges(held, teams, names, season)
    pace = teams.groupBy(season).agg((F.max(_or(F.col("tempo"), tempo_default)) - F.min(_or(F.col("tempo"), tempo_default))).alias("_w_tempo"))

    def prepared(df: DataFrame, prefix: str) -> DataFrame:
        out = {f"{prefix}{c}": F.col(c) for c in names} | {f"{prefix}tempo": _or(F.col("tempo"), tempo_default)}
        kept, groups = [season, "player" if prefix == "p_" else "team", *out], [MIX, *([names[3:]] if style else [])]
        if style:
            kept.append(f"{prefix}covered")
            out[f"{prefix}covered"] = _add([F.col(c).isNull().cast("int") for c in names[3:]]) == 0
        # norms are columns of their own, so that each is made once a row
        df = df.select(*kept[:2], *[v.alias(k) for k, v in out.items()])
        df = df.withColumns({f"_norm{i}": F.sqrt(_add([_or(F.col(f"{prefix}{c}"), 0) * _or(F.col(f"{prefix}{c}"), 0) for c in g])) for i, g in enumerate(groups)})
        units = {f"{prefix}u_{c}": F.when(F.col(f"_norm{i}") > 0, _or(F.col(f"{prefix}{c}"), 0) / F.col(f"_norm{i}")).otherwise(0.0) for i, g in enumerate(groups) for c in g}
        return df.withColumns(units).select(*kept, *units)

    t = few_rows(prepared(teams, "t_").join(small(width), season).join(small(pace), season))
    pairs = stage(prepared(held, "p_"), "scheme-players").join(t, season)
    # the code of a pair has to stay small, or the JVM does not compile it: players are prepared by a stage of their own, products and rounded values are layers
    both = lambda c: F.col(f"p_u_{c}") * F.col(f"t_u_{c}")
    covered = F.col("p_covered") & F.col("t_covered") if style else None
    made = {f"_part_{c}": both(c) for c in MIX} | {f"_match_{c}": range_match(F.col(f"p_{c}"), F.col(f"t_{c}"), F.col(f"_w_{c}"), RANGE_FLOOR) for c in names}
    made["_pace"] = pace_match(F.col("p_tempo"), F.col("t_tempo"), F.col("_w_tempo"))
    if style:
        made |= {"_style": _add([both(c) for c in names[3:]]), "_covered": covered}
    pairs = pairs.select("player", "team", season, *[v.alias(k) for k, v in made.items()])
    pairs = pairs.select("*", rounded(_held(_add([F.col(f"_part_{c}") for c in MIX]) * 100), score).alias("scheme_fit"), *[rounded(F.col(f"_part_{c}") * 100, part).alias(f"{c}_part") for c in MIX])
    return pairs.select(
        "player",
        "team",
        season,
        "scheme_fit",
        *[rounded(F.col(f"_match_{c}"), match).alias(f"{c}_match") for c in MIX],
        rounded(F.col("_pace"), match).alias("pace_match"),
        *[f"{c}_part" for c in MIX],
        # made of rounded values, so that decimal ties are common: these need decimals
        F.round(F.col("scheme_fit") - _add([F.col(f"{c}_part") for c in MIX]), part).alias("adjustment"),
        F.round(RAW_WEIGHTS["scheme"] * F.col("scheme_fit") + (1 - RAW_WEIGHTS["scheme"]) * 50, 2 if score < 6 else score).alias("overall"),
        *([F.when(F.col("_covered"), rounded(_held(F.col("_style") * 100), match)).alias("style_fit")] if style else []),
        *[F.when(F.col("_covered"), rounded(F.col(f"_match_{c}"), match)).alias(f"{c}_match") for c in names[3:]],
    )


def archetype_deficits(df: DataFrame, season: str, school: str, label: str, n: int = 2) -> DataFrame:
    """Per season and school the ``n`` labels by which it falls furthest short of the season's distribution, as an array; none that it does not lack."""
    known = df.where(F.col(label).isNotNull())
    league = known.groupBy(season, label).agg(F.count("*").alias("_l"))
    league = league.withColumn("_l", F.col("_l") / F.sum("_l").over(Window.partitionBy(season)))
    own = known.groupBy(season, school, label).agg(F.count("*").alias("_o"))
    own = own.withColumn("_o", F.col("_o") / F.sum("_o").over(Window.partitionBy(season, school)))
    grid = df.select(season, school).distinct().join(small(league), season).join(own, [season, school, label], "left")
    grid = grid.withColumn("_gap", F.col("_l") - _or(F.col("_o"), 0)).where("_gap > 0")
    listed = F.array_sort(F.collect_list(F.struct((-F.col("_gap")).alias("g"), F.col(label).alias("l"))))
    return grid.groupBy(season, school).agg(F.transform(F.slice(listed, 1, n), lambda s: s["l"]).alias("deficit"))


def gap_match(df: DataFrame, features: list[str], season: str = "season", school: str = "school", player: str = "player", top: int = 3, digits: tuple[int, int] = (2, 6), noise: int = 6) -> DataFrame:
    """How well each player covers what each school of the season lacks, by soft positions.

    ``df``: ``player, season, school``, features (missing ones become medians), ``weights`` (an array, one per position), ``reliability`` (position
    source), ``games, min_pct, archetype``. Per position a school's gap is the season's weighted mean less its own, at least 0; a player's scaled
    features meet each scaled gap by cosine, weighted by position, and the score is drawn to the baseline as reliability falls. Scaled features and gaps are held to ``noise``
    decimals: what the order of additions leaves of two equal means is no gap, though its direction would count in full.
    """
    n, m = len(features), len(POSITIONS)
    # missing features and sample size, as reliability
    d = median_impute(df, season, features)
    games, pct = F.least(F.greatest(_or(F.col("games"), 0), F.lit(0.0)) / 20, F.lit(1.0)), F.least(F.greatest(_or(F.col("min_pct"), 0), F.lit(0.0)) / 50, F.lit(1.0))
    held = lambda x, low=0.0: F.least(F.greatest(x, F.lit(low)), F.lit(1.0))
    d = d.withColumn("_rel", held(_or(F.col("reliability"), 0.4) * held(games * F.sqrt(pct)) * held(1 - 0.5 * F.col("missing_count") / n, 0.5)))
    w = [F.get("weights", F.lit(p)) for p in range(m)]
    sums = [F.sum(w[p]).alias(f"_w{p}") for p in range(m)] + [F.sum(w[p] * F.col(f)).alias(f"_s{p}_{k}") for p in range(m) for k, f in enumerate(features)]
    league = d.groupBy(season).agg(*sums, *[F.avg(f).alias(f"_m{k}") for k, f in enumerate(features)])
    league = league.select(season, *[F.when(F.col(f"_w{p}") > 0, F.col(f"_s{p}_{k}") / F.col(f"_w{p}")).otherwise(F.col(f"_m{k}")).alias(f"_b{p}_{k}") for p in range(m) for k in range(n)])
    roster = d.groupBy(season, school).agg(*sums).join(small(league), season)
    scale = d.agg(*[F.avg(f).alias(f"_c{k}") for k, f in enumerate(features)], *[F.coalesce(F.nullif(F.stddev_pop(f), F.lit(0.0)), F.lit(1.0)).alias(f"_d{k}") for k, f in enumerate(features)]).first()
    centre, spread = ([scale[f"_{x}{k}"] for k in range(n)] for x in "cd")
    own = lambda p, k: F.when(F.col(f"_w{p}") > 0, F.col(f"_s{p}_{k}") / F.col(f"_w{p}")).otherwise(0.0)
    gaps = [[F.greatest(F.lit(0.0), F.col(f"_b{p}_{k}") - own(p, k)) for k in range(n)] for p in range(m)]
    schools = roster.select(season, school, F.array(*[g for row in gaps for g in row]).alias("_gap"), F.array(*[depth_score(F.coalesce(f"_w{p}", F.lit(0.0))) for p in range(m)]).alias("_depth"))
    at = lambda c, p, k: F.get(c, F.lit(p * n + k))
    units = F.array(*[u for p in range(m) for u in unit([F.round(at("_gap", p, k) / float(spread[k]), noise) for k in range(n)])])
    schools = schools.withColumn("_unit", units).join(archetype_deficits(df, season, school, "archetype"), [season, school], "left")
    # a pair reads plain columns: what concerns one side only is unpacked before the join
    flat = {f"_{c[1]}{p}_{k}": at(c, p, k) for c in ("_unit", "_gap") for p in range(m) for k in range(n)} | {f"_e{p}": F.get("_depth", F.lit(p)) for p in range(m)}
    schools = few_rows(schools.select(season, F.col(school).alias("to_school"), "deficit", *[_or(v, 0).alias(c) for c, v in flat.items()]))
    known = reduce(lambda a, b: a & b, [x.isNotNull() for x in w])
    plain = [F.col("_rel").alias("_rel"), F.round("_rel", digits[1]).alias("reliability"), "archetype", known.alias("_known"), *[_or(w[p], 0).alias(f"_v{p}") for p in range(m)]]
    people = d.select(player, season, *plain, *[_or(F.round((F.col(f) - float(centre[k])) / float(spread[k]), noise), 0).alias(f"_z{k}") for k, f in enumerate(features)])
    people = people.withColumn("_norm", F.sqrt(_add([F.col(f"_z{k}") * F.col(f"_z{k}") for k in range(n)])))
    people = people.withColumns({f"_p{k}": F.when(F.col("_norm") > 0, F.col(f"_z{k}") / F.col("_norm") * 100).otherwise(0.0) for k in range(n)}).drop("_norm", *[f"_z{k}" for k in range(n)])
    pairs = people.join(schools, season)
    meet = lambda c, k: _add([F.col(f"_v{p}") * F.col(f"_{c}{p}_{k}") for p in range(m)])
    pairs = pairs.select("*", *[(F.col(f"_p{k}") * meet("u", k)).alias(f"_x{k}") for k in range(n)])
    pairs = pairs.select("*", _held(_add([F.col(f"_x{k}") for k in range(n)])).alias("_raw"))
    drawn, deep = calibrate_to_baseline(F.col("_raw"), F.col("_rel"), GAP_BASELINE), _add([F.col(f"_v{p}") * F.col(f"_e{p}") for p in range(m)])
    said = lambda x, k, name: F.when(F.col("_known"), rounded(x, k)).alias(name)
    ranked = F.filter(F.array_sort(F.array(*[F.struct((-meet("g", k)).alias("minus"), F.lit(f).alias("f")) for k, f in enumerate(features)])), lambda s: s["minus"] < -1e-9)
    return pairs.select(
        player,
        "to_school",
        season,
        said(F.col("_raw"), digits[0], "raw_gap"),
        said(_held(drawn), digits[0], "gap"),
        "reliability",
        said(deep, digits[1], "depth"),
        F.coalesce(F.array_contains("deficit", F.col("archetype")), F.lit(False)).alias("archetype_needed"),
        F.array_join(F.transform(F.slice(ranked, 1, top), lambda s: s["f"]), ",").alias("top_gaps"),
        *[said(F.col(f"_x{k}"), digits[1], f"part_{f}") for k, f in enumerate(features)],
    )


def raw_overall(gap: Column, scheme: Column) -> Column:
    """The raw overall score of a pair with neutral stubs; a missing scheme fit counts as 0."""
    return RAW_WEIGHTS["gap"] * gap + RAW_WEIGHTS["scheme"] * _or(scheme, 0) + STUB * 50


def all_pairs(a: DataFrame, b: DataFrame, on) -> DataFrame:
    """Every row of ``a`` with every row of ``b`` that has the same key; ``b`` is broadcast after a check of its size."""
    return a.join(small(b), _by(on))
