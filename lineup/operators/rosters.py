"""Rosters: baselines of open slots, roster vectors, counterfactuals and their intervals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lineup.functions.fit import _or, clip
from lineup.functions.playing import POSITIONS, Z80
from lineup.operators.joins import small
from lineup.operators.windows import _by, cascade_reduce

# A roster's features in order; what is taken where nothing is known of a slot.
ROSTER_FEATURES = ("weighted_off", "weighted_def", "top1_off", "top2_off", "bench_off", "three_coverage", "rim_protection", "pg_creation", "rebounding", "usage_hhi", "returning_share", "n_known", "tier", "tempo")
SLOT_DEFAULTS = {"off": 0.0, "deff": 0.0, "three": 0.30, "oreb": 0.25, "usage": 20.0}
BENCH_FROM, FRONTCOURT, GUARDS = 8, ("PF", "C"), ("PG",)
# A newcomer's offensive and defensive part, minutes of a team, what each unknown newcomer adds to the variance.
OFF_PART, DEF_PART, TEAM_MINUTES, FRESHMAN_VARIANCE = 0.55, 0.45, 200.0, 0.4


def slot_baselines(players: DataFrame, tier: str = "tier", position: str = "position") -> DataFrame:
    """Mean profile (``SLOT_DEFAULTS`` columns) by tier and position of players with both impacts known."""
    known = players.where(F.col("off").isNotNull() & F.col("deff").isNotNull() & F.col(tier).isNotNull() & F.col(position).isNotNull())
    return known.groupBy(tier, position).agg(*[F.avg(F.coalesce(c, F.lit(v)) if c in ("three", "oreb", "usage") else F.col(c)).alias(c) for c, v in SLOT_DEFAULTS.items()])


def slot_fill(rows: DataFrame, baselines: DataFrame, tier: str = "tier", position: str = "position") -> DataFrame:
    """Missing profile values of ``rows`` from the slot of the tier and position, else the position's best tier, else the mean of all slots."""
    b = baselines.select(F.col(tier).alias("_t"), F.col(position).alias("_p"), F.struct(*SLOT_DEFAULTS).alias("_slot"))
    best = b.groupBy("_p").agg(F.min_by("_slot", "_t").alias("_best"))
    every = baselines.agg(F.struct(*[F.coalesce(F.avg(c), F.lit(v)).alias(c) for c, v in SLOT_DEFAULTS.items()]).alias("_mean"))
    out = rows.join(small(b), (rows[tier] == F.col("_t")) & (rows[position] == F.col("_p")), "left").drop("_t", "_p")
    out = out.join(small(best), out[position] == F.col("_p"), "left").drop("_p").crossJoin(F.broadcast(every))
    fill = F.coalesce("_slot", "_best", "_mean")
    return out.withColumns({c: F.coalesce(F.col(c), fill[c]) for c in SLOT_DEFAULTS}).drop("_slot", "_best", "_mean")


def roster_vector(rows: DataFrame, key, order=("member",)) -> DataFrame:
    """The roster features of each key, from members with ``min_pct, position, off, deff, three, oreb, usage, known`` (filled), and per key
    ``returning_share, tier, tempo``. Members are ranked by minutes, ties by ``order``; shares sum to 1."""
    k = _by(key)
    pct = F.greatest(_or(F.col("min_pct"), 0), F.lit(0.0))
    everyone, ranked = Window.partitionBy(*k), Window.partitionBy(*k).orderBy(F.desc("_pct"), *order)
    rows = rows.withColumn("_pct", pct).withColumns({"_total": F.sum("_pct").over(everyone), "_rank": F.row_number().over(ranked)})
    rows = rows.withColumn("_share", F.when(F.col("_total") > 0, F.col("_pct") / F.col("_total")).otherwise(F.col("_pct")))
    rows = rows.withColumn("_use", F.col("usage") * F.col("_share"))
    weigh = lambda c, when=F.lit(True): F.coalesce(F.sum(F.when(when, F.col(c) * F.col("_share"))), F.lit(0.0))
    at = lambda n: F.max(F.when(F.col("_rank") == n, F.col("off")))
    aggregates = {
        "weighted_off": weigh("off"),
        "weighted_def": weigh("deff"),
        "top1_off": F.coalesce(at(1), F.lit(0.0)),
        "top2_off": F.coalesce(at(2), at(1), F.lit(0.0)),
        "bench_off": weigh("off", F.col("_rank") >= BENCH_FROM),
        "three_coverage": weigh("three"),
        "rim_protection": weigh("deff", F.col("position").isin(*FRONTCOURT)),
        "pg_creation": weigh("off", F.col("position").isin(*GUARDS)),
        "rebounding": weigh("oreb"),
        "usage_hhi": F.coalesce(F.sum(F.col("_use") * F.col("_use")) / F.nullif(F.sum("_use") * F.sum("_use"), F.lit(0.0)), F.lit(0.0)),
        "returning_share": F.first("returning_share"),
        "n_known": F.count_if(F.coalesce("known", F.lit(False))).cast("double"),
        "tier": F.first("tier").cast("double"),
        "tempo": F.coalesce(F.first("tempo"), F.lit(68.0)),
    }
    return rows.groupBy(*k).agg(*[aggregates[f].cast("double").alias(f) for f in ROSTER_FEATURES])


def freshman_rows(schools: DataFrame, baselines: DataFrame, base: dict[int, float], discount: dict[int, float], cap: float = 60.0, scale: float = 40.0, low: float = 0.5, high: float = 1.5, boost: float = 1.25, discount_boost: float = 0.1) -> DataFrame:
    """``freshmen`` prior rows of each school (``school, tier, freshmen, elite, open_minutes map``), positions by open minutes in turn.

    The share of minutes goes by tier (``base``), more for elite schools, capped over all of a school, and by how open the position is; the
    impact is the slot's mean times ``discount``.
    """
    of = lambda table: F.coalesce(F.create_map(*[x for t, v in table.items() for x in (F.lit(t), F.lit(float(v)))])[F.col("tier")], F.lit(float(table[2])))
    open_ = F.filter(F.map_entries(F.coalesce("open_minutes", F.create_map().cast("map<string,double>"))), lambda e: e["key"].isin(*POSITIONS) & (e["value"] > 0))
    listed = F.transform(F.array_sort(F.transform(open_, lambda e: F.struct((-e["value"]).alias("minus"), F.array_position(F.array(*[F.lit(p) for p in POSITIONS]), e["key"]).alias("k"), e["key"].alias("p")))), lambda s: s["p"])
    ranked = F.when(F.size(listed) > 0, listed).otherwise(F.array(*[F.lit(p) for p in POSITIONS]))
    elite = F.coalesce("elite", F.lit(False))
    each = F.least(of(base) * F.when(elite, boost).otherwise(1.0), F.lit(cap))
    less = F.when(elite, F.least(of(discount) + discount_boost, F.lit(0.90))).otherwise(of(discount))
    rows = schools.where("freshmen > 0").select("school", "tier", "freshmen", "open_minutes", ranked.alias("_ranked"), (F.least(F.col("freshmen") * each, F.lit(cap)) / F.col("freshmen")).alias("_pct"), less.alias("_less"))
    rows = rows.withColumn("idx", F.explode(F.sequence(F.lit(0), F.col("freshmen").cast("int") - 1)))
    rows = rows.withColumn("position", F.element_at("_ranked", (F.pmod(F.col("idx"), F.size("_ranked")) + 1).cast("int")))
    opening = clip(F.greatest(_or(F.col("open_minutes")[F.col("position")], 0), F.lit(0.0)) / scale, low, high)
    rows = rows.select("school", "tier", "idx", "position", (F.col("_pct") * opening).alias("min_pct"), "_less", *[F.lit(None).cast("double").alias(c) for c in SLOT_DEFAULTS])
    filled = slot_fill(rows, baselines)
    return filled.withColumns({"off": F.col("off") * F.col("_less"), "deff": F.col("deff") * F.col("_less")}).drop("_less")


def candidate_rosters(pairs: DataFrame, rosters: DataFrame, school: str = "school") -> DataFrame:
    """For each pair (``pair, school, minutes, cand_*``) the school's members after the smallest shares gave way to the candidate, and the candidate.

    ``rosters``: ``school, member, min_pct, position, off, deff, three, oreb, usage, known``; ``pairs`` also carry ``displaced`` (minutes), ``value``, ``cand_position, cand_three, cand_oreb, cand_usage``.
    Rosters are short, so the pairs join them; each pair's rows meet in one group.
    """
    columns = ("member", "min_pct", "position", "off", "deff", "three", "oreb", "usage", "known")
    own = pairs.join(rosters, school).select("pair", school, *columns, (F.col("displaced") / TEAM_MINUTES * 100).alias("_give"))
    own = cascade_reduce(own, "pair", "min_pct", F.col("_give"), [F.col("min_pct"), F.col("member")], "_less")
    own = own.withColumn("min_pct", F.col("min_pct") - F.col("_less")).drop("_less", "_give")
    new = pairs.select(
        "pair",
        school,
        F.lit(-1).cast("bigint").alias("member"),
        (F.col("minutes") / TEAM_MINUTES * 100).alias("min_pct"),
        F.coalesce("cand_position", F.lit("SG")).alias("position"),
        (_or(F.col("value"), 0) * OFF_PART).alias("off"),
        (_or(F.col("value"), 0) * DEF_PART).alias("deff"),
        _or(F.col("cand_three"), 0.35).alias("three"),
        _or(F.col("cand_oreb"), 0.25).alias("oreb"),
        _or(F.col("cand_usage"), 20).alias("usage"),
        F.lit(True).alias("known"),
    )
    return own.unionByName(new)


#: What is summed over a roster, weighted by minutes: the value of a member or candidate.
_SUMS = {
    "off": lambda m: m["off"],
    "deff": lambda m: m["deff"],
    "three": lambda m: m["three"],
    "rim": lambda m: F.when(m["position"].isin(*FRONTCOURT), m["deff"]),
    "guard": lambda m: F.when(m["position"].isin(*GUARDS), m["off"]),
    "oreb": lambda m: m["oreb"],
    "usage": lambda m: m["usage"],
}


def displacement_index(rosters: DataFrame, school: str = "school") -> DataFrame:
    """A row a school for ``after_displacement``: ``_m``, its members by minutes (smallest first, ties by ``member``) with running sums: ``taken``, the
    minutes up to the member, and ``rest_*``, the weighted sums from it on. A roster is short, so it is a row's array.
    """
    order = Window.partitionBy(school).orderBy("pct", "member")
    until, since = order.rowsBetween(Window.unboundedPreceding, Window.currentRow), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = rosters.select(school, F.greatest(_or(F.col("min_pct"), 0), F.lit(0.0)).alias("pct"), "member", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("off", "deff", "three", "oreb", "usage")], "position", "known")
    one = F.struct(*[F.col(c) for c in ("off", "deff", "three", "oreb", "usage", "position")])
    weighted = {n: F.col("pct") * F.coalesce(of(one), F.lit(0.0)) for n, of in _SUMS.items()} | {"pct": F.col("pct"), "square": F.pow(F.col("pct") * F.col("usage"), 2)}
    rows = rows.select("*", F.sum("pct").over(until).alias("taken"), *[F.sum(x).over(since).alias(f"rest_{n}") for n, x in weighted.items()])
    held = F.struct(*[c for c in rows.columns if c not in (school, "known")])
    return rows.groupBy(school).agg(F.array_sort(F.collect_list(held)).alias("_m"), F.count_if(F.coalesce("known", F.lit(False))).cast("double").alias("_known"))


def after_displacement(pairs: DataFrame, index: DataFrame, context: DataFrame, school: str = "school") -> DataFrame:
    """The roster features of each pair's school after the smallest shares gave way and the candidate came, a row a pair.

    The members that give all of their minutes are found in the running minutes, one gives a part, the sums over the others are looked up. Only the best two
    and the bench need an order, which is that of the row's own array.
    """
    df = pairs.join(index, school).join(small(context.select(school, "returning_share", "tier", "tempo")), school)
    give = F.col("displaced") / TEAM_MINUTES * 100
    df = df.withColumns({"_give": F.greatest(give, F.lit(0.0)), "_pct": F.greatest(_or(F.col("minutes"), 0), F.lit(0.0)) / TEAM_MINUTES * 100})
    df = df.withColumn("_k", F.size(F.filter("_m", lambda m: m["taken"] <= F.col("_give"))))
    value = _or(F.col("value"), 0)
    own = F.struct(
        F.col("_pct").alias("pct"),
        F.lit(-1).cast("bigint").alias("member"),
        (value * OFF_PART).alias("off"),
        (value * DEF_PART).alias("deff"),
        _or(F.col("cand_three"), 0.35).alias("three"),
        _or(F.col("cand_oreb"), 0.25).alias("oreb"),
        _or(F.col("cand_usage"), 20).alias("usage"),
        F.coalesce("cand_position", F.lit("SG")).alias("position"),
    )
    df = df.withColumns({"_own": own, "_part": F.get("_m", F.col("_k")), "_rest": F.get("_m", F.col("_k") + 1)})
    given = F.greatest(F.lit(0.0), F.col("_give") - (F.col("_part.taken") - F.col("_part.pct")))
    df = df.withColumn("_left", F.coalesce(F.col("_part.pct") - given, F.lit(0.0)))
    rest = lambda n: F.coalesce(F.col(f"_rest.rest_{n}"), F.lit(0.0))
    square = lambda x: x * x
    kept = F.transform("_m", lambda m, i: F.struct((-F.when(i < F.col("_k"), 0.0).when(i == F.col("_k"), F.col("_left")).otherwise(m["pct"])).alias("minus"), m["member"].alias("member"), m["off"].alias("off")))
    df = df.withColumns({
        "_total": rest("pct") + F.col("_left") + F.col("_pct"),
        "_square": rest("square") + square(F.col("_left") * F.coalesce("_part.usage", F.lit(0.0))) + square(F.col("_pct") * F.col("_own.usage")),
        "_ranked": F.array_sort(F.concat(kept, F.array(F.struct((-F.col("_pct")).alias("minus"), F.col("_own.member").alias("member"), F.col("_own.off").alias("off"))))),
        **{f"_s_{n}": rest(n) + F.col("_left") * F.coalesce(of(F.col("_part")), F.lit(0.0)) + F.col("_pct") * F.coalesce(of(F.col("_own")), F.lit(0.0)) for n, of in _SUMS.items()},
    })
    share = lambda x: F.when(F.col("_total") > 0, x / F.col("_total")).otherwise(x)
    bench = F.aggregate(F.slice("_ranked", BENCH_FROM, 1 << 30), F.lit(0.0), lambda n, m: n - m["minus"] * m["off"])
    features = {
        "weighted_off": share(F.col("_s_off")),
        "weighted_def": share(F.col("_s_deff")),
        "top1_off": F.get("_ranked", F.lit(0))["off"],
        "top2_off": F.coalesce(F.get("_ranked", F.lit(1))["off"], F.get("_ranked", F.lit(0))["off"]),
        "bench_off": share(bench),
        "three_coverage": share(F.col("_s_three")),
        "rim_protection": share(F.col("_s_rim")),
        "pg_creation": share(F.col("_s_guard")),
        "rebounding": share(F.col("_s_oreb")),
        "usage_hhi": F.coalesce(F.col("_square") / F.nullif(square(F.col("_s_usage")), F.lit(0.0)), F.lit(0.0)),
        "returning_share": F.col("returning_share"),
        "n_known": F.col("_known") + 1,
        "tier": F.col("tier"),
        "tempo": F.coalesce("tempo", F.lit(68.0)),
    }
    return df.select("pair", school, *[features[f].cast("double").alias(f) for f in ROSTER_FEATURES])


def rating(model: dict, prefix: str = "") -> Column:
    """A linear model's prediction from the roster features with a prefix."""
    return reduce(lambda a, b: a + b, [F.col(prefix + f) * float(c) for f, c in zip(model["features"], model["coef"], strict=True)], F.lit(float(model["intercept"])))


def counterfactual(pairs: DataFrame, rosters: DataFrame, context: DataFrame, off: dict, deff: dict, school: str = "school") -> DataFrame:
    """Per pair the ratings of the school without and with the candidate, their differences (defence: less is better, the sign is turned) and
    what talent, spacing, rim, rebounding, depth and continuity add. ``context``: ``school, returning_share, tier, tempo``. A pair costs look-ups in its school's
    running sums, no roster is built for it."""
    base = roster_vector(rosters.join(small(context), school), school)
    base = base.select(school, *[F.col(f).alias(f"b_{f}") for f in ROSTER_FEATURES])
    after = after_displacement(pairs, displacement_index(rosters, school), context, school)
    both = after.join(base, school)
    change = lambda model, fs: reduce(lambda a, b: a + b, [(F.col(f) - F.col(f"b_{f}")) * float(dict(zip(model["features"], model["coef"], strict=True)).get(f, 0.0)) for f in fs], F.lit(0.0))
    o0, o1, d0, d1 = rating(off, "b_"), rating(off), rating(deff, "b_"), rating(deff)
    talent = ["weighted_off", "weighted_def", "top1_off", "top2_off"]
    parts = {"talent_off": change(off, talent), "talent_def": -change(deff, talent), "spacing": change(off, ["three_coverage", "pg_creation"]), "rim": -change(deff, ["rim_protection"]), "rebounds": change(off, ["rebounding"]), "depth": change(off, ["bench_off", "usage_hhi"]), "continuity": change(off, ["returning_share"])}
    return both.select("pair", school, o0.alias("base_o"), d0.alias("base_d"), (o1 - o0).alias("delta_o"), (d0 - d1).alias("delta_d"), ((o1 - d1) - (o0 - d0)).alias("delta_em"), *[c.alias(n) for n, c in parts.items()])


def analytic_interval(delta: Column, off_std: float, def_std: float, freshmen: Column, value: Column, value_std: Column, minutes: Column, minutes_std: Column) -> tuple[Column, Column]:
    """The 80 % interval of a rating difference from its parts' variances."""
    var = 2 * (off_std**2 + def_std**2) + _or(freshmen, 0) * FRESHMAN_VARIANCE
    var = var + (F.greatest(_or(value_std, 0), F.lit(0.0)) * F.greatest(_or(minutes, 0), F.lit(0.0)) / 40) ** 2 + (F.greatest(_or(minutes_std, 0), F.lit(0.0)) * F.abs(_or(value, 0)) / 40) ** 2
    half = Z80 * F.sqrt(var)
    return delta - half, delta + half


def hashed_normal(seed: int, *keys: Column) -> Column:
    """A standard normal draw that depends on the keys only (Box-Muller on two hashes), so a repeated task draws the same."""
    u = [(F.pmod(F.xxhash64(F.lit(seed + k), *keys), F.lit(1 << 40)) + 0.5) / float(1 << 40) for k in (0, 1)]
    return F.sqrt(-2 * F.log(u[0])) * F.cos(2 * 3.141592653589793 * u[1])


def bootstrap_interval(pairs: DataFrame, rosters: DataFrame, context: DataFrame, off: dict, deff: dict, off_std: float, n: int = 200, seed: int = 42, school: str = "school") -> DataFrame:
    """10th and 90th percentile of each pair's rating difference over ``n`` replicates with perturbed impacts. Replicates are rows: each
    is a pair of its own to ``counterfactual``."""
    spread = max(off_std, 0.5) * 0.3
    numbers = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_n")
    many = pairs.select("*", numbers).withColumns({"_pair": F.col("pair"), "pair": F.struct("pair", "_n"), "value": _or(F.col("value"), 0) + hashed_normal(seed, F.col("pair"), F.col("_n")) * spread})
    noise = hashed_normal(seed + 7, F.col(school), F.col("member"), F.col("_n")) * spread
    noisy = rosters.select("*", numbers).withColumns({"off": F.col("off") + noise, "deff": F.col("deff") + noise * 0.5})
    keyed = lambda df: df.withColumn(school, F.struct(school, "_n")).drop("_n")
    wide = context.select("*", numbers)
    got = counterfactual(keyed(many).drop("_pair"), keyed(noisy), keyed(wide), off, deff, school)
    return got.groupBy(F.col("pair.pair").alias("pair")).agg(F.percentile("delta_em", [0.1, 0.9]).alias("_q")).select("pair", F.col("_q")[0].alias("low"), F.col("_q")[1].alias("high"))


def remap_owner(features: DataFrame, moves: DataFrame, player: str, school: str, target: str) -> DataFrame:
    """Features under the target school of those who move, the school that they come from kept as ``source``."""
    to = moves.select(player, F.col(target).alias("_to"))
    return features.join(to, player).withColumnRenamed(school, "source").withColumnRenamed("_to", school)
