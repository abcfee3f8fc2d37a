"""State-space queries: users' events by type are game series, customers' years are seasons."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lineup.operators import models as M
from lineup.operators import states as T
from lineup.plans.base import Registry, r6, table
from lineup.sources.io import stage

R = Registry()
_SERIES = """e AS (SELECT user_id, event_type, CASE WHEN event_id % 7 > 0 THEN value END AS y, 4.0 + event_id % 3 AS r, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events)"""


def _series(spark, d):
    """One series per user and type of event: bounded by a user's season; some observations are missing."""
    e = table(spark, d, "events")
    o = F.struct("ts", "event_id", F.when(F.col("event_id") % 7 > 0, F.col("value")).alias("y"), (4.0 + F.col("event_id") % 3).alias("r"))
    return e.groupBy("user_id", "event_type").agg(F.array_sort(F.collect_list(o)).alias("o")).withColumns({"prior_mean": F.lit(10.0), "prior_var": F.lit(100.0)})


@R("M08b_kalman_smoother", f"""WITH RECURSIVE {_SERIES},
f AS (SELECT user_id, event_type, 0::BIGINT AS k, 10.0::DOUBLE AS m, 100.0::DOUBLE AS v FROM (SELECT DISTINCT user_id, event_type FROM e)
 UNION ALL SELECT f.user_id, f.event_type, e.k, CASE WHEN e.y IS NULL THEN f.m ELSE f.m + (f.v + 0.5) / (f.v + 0.5 + e.r) * (e.y - f.m) END, CASE WHEN e.y IS NULL THEN f.v + 0.5 ELSE (1 - (f.v + 0.5) / (f.v + 0.5 + e.r)) * (f.v + 0.5) END
  FROM f JOIN e ON e.user_id = f.user_id AND e.event_type = f.event_type AND e.k = f.k + 1),
n AS (SELECT user_id, event_type, max(k) AS n FROM f GROUP BY 1, 2),
s AS (SELECT f.* FROM f JOIN n ON n.user_id = f.user_id AND n.event_type = f.event_type AND k = n
 UNION ALL SELECT f.user_id, f.event_type, f.k, f.m + f.v / (f.v + 0.5) * (s.m - f.m), f.v + (f.v / (f.v + 0.5)) ** 2 * (s.v - f.v - 0.5) FROM s JOIN f ON f.user_id = s.user_id AND f.event_type = s.event_type AND f.k = s.k - 1 AND f.k > 0)
SELECT user_id, event_type, k::INT AS place, round(m, 6) AS mean, round(v, 6) AS variance FROM s""")
def m08b(spark, d):
    s = _series(spark, d).select("user_id", "event_type", F.posexplode(M.kalman_smoother(F.col("o"), 0.5, F.col("prior_mean"), 100.0)).alias("place", "s"))
    return s.select("user_id", "event_type", (F.col("place") + 1).alias("place"), r6("s.m", "mean"), r6("s.v", "variance"))


_GRID = [0.01, 0.1, 1.0, 10.0]


@R("M09_fit_process_noise", f"""WITH RECURSIVE {_SERIES}, g AS (SELECT unnest({_GRID})::DOUBLE AS q),
f AS (SELECT user_id, event_type, q, 0::BIGINT AS k, 10.0::DOUBLE AS m, 100.0::DOUBLE AS v, 0.0::DOUBLE AS nll FROM (SELECT DISTINCT user_id, event_type FROM e), g
 UNION ALL SELECT f.user_id, f.event_type, q, e.k, CASE WHEN e.y IS NULL THEN f.m ELSE f.m + (f.v + q) / (f.v + q + e.r) * (e.y - f.m) END, CASE WHEN e.y IS NULL THEN f.v + q ELSE (1 - (f.v + q) / (f.v + q + e.r)) * (f.v + q) END,
  nll + CASE WHEN e.y IS NULL THEN 0 ELSE 0.5 * (ln(2 * pi() * (f.v + q + e.r)) + (e.y - f.m) ** 2 / (f.v + q + e.r)) END FROM f JOIN e ON e.user_id = f.user_id AND e.event_type = f.event_type AND e.k = f.k + 1),
t AS (SELECT q, sum(nll::DECIMAL(28, 9))::DOUBLE AS nll FROM (SELECT user_id, event_type, q, arg_max(nll, k) AS nll FROM f GROUP BY 1, 2, 3) GROUP BY 1)
SELECT q, round(nll, 4) AS nll, nll = min(nll) OVER () AS best FROM t""")
def m09(spark, d):
    """The pooled loss of each noise of a grid; ``fit_process_noise`` refines around the best."""
    got = T.noise_grid(_series(spark, d), _GRID)
    least = got.agg(F.min("nll").alias("least"))  # a row per noise of the grid
    return got.join(F.broadcast(least)).select("q", F.round("nll", 4).alias("nll"), (F.col("nll") == F.col("least")).alias("best"))


_SEASONS = """y AS (SELECT o_custkey, year(o_orderdate) AS season, avg(o_totalprice) / 100000 AS y, 0.5 / count(*) AS r, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS f, count(*) AS n FROM orders GROUP BY 1, 2),
c AS (SELECT *, row_number() OVER w AS x, coalesce((f > 0 AND lag(f) OVER w = 0)::INT, 0) AS moved, coalesce(sign(n - lag(n) OVER w), 0)::INT AS tier FROM y WINDOW w AS (PARTITION BY o_custkey ORDER BY season))"""
_BETAS, _RHO, _Q = (0.5, 0.02, -0.003, 0.1, -0.05), 0.6, 0.3
_MU = "({} + {} * x + {} * x * x + {} * moved + {} * tier)".format(*_BETAS)


def _seasons(spark, d):
    y = table(spark, d, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("season")).agg((F.avg("o_totalprice") / 100000).alias("y"), (0.5 / F.count("*")).alias("r"), F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("f"), F.count("*").alias("n"))
    w = Window.partitionBy("o_custkey").orderBy("season")
    moved = F.coalesce(((F.col("f") > 0) & (F.lag("f").over(w) == 0)).cast("int"), F.lit(0))
    return y.withColumns({"x": F.row_number().over(w), "moved": moved, "tier": F.coalesce(F.signum(F.col("n") - F.lag("n").over(w)).cast("int"), F.lit(0))})


_STATES = f"""o AS (SELECT *, x AS k FROM c), f AS (SELECT o_custkey, 0::BIGINT AS k, 0::BIGINT AS season, 2.5::DOUBLE AS m, 4.0::DOUBLE AS v, NULL::DOUBLE AS residual FROM (SELECT DISTINCT o_custkey FROM c)
 UNION ALL SELECT f.o_custkey, o.k, o.season, {_RHO} * f.m + {_MU} + ({_RHO * _RHO} * f.v + {_Q}) / ({_RHO * _RHO} * f.v + {_Q} + o.r) * (o.y - {_RHO} * f.m - {_MU}), (1 - ({_RHO * _RHO} * f.v + {_Q}) / ({_RHO * _RHO} * f.v + {_Q} + o.r)) * ({_RHO * _RHO} * f.v + {_Q}),
  (o.y - {_RHO} * f.m - {_MU}) / sqrt({_RHO * _RHO} * f.v + {_Q} + o.r) FROM f JOIN o ON o.o_custkey = f.o_custkey AND o.k = f.k + 1)"""
_NAMES = ("x", "moved", "tier")


def _states(spark, d):
    return T.season_states(_seasons(spark, d), "o_custkey", "season", "y", "r", _NAMES, _RHO, _BETAS, _Q, (2.5, 4.0))


@R("M10_kalman_drift", f"WITH RECURSIVE {_SEASONS}, {_STATES} SELECT o_custkey, season::INT AS season, round(m, 6) AS mean, round(v, 6) AS var, round(residual, 6) AS residual FROM f WHERE k > 0")
def m10(spark, d):
    return _states(spark, d).select("o_custkey", "season", r6("mean"), r6("var"), r6("residual"))


@R("M10b_persistence", f"WITH {_SEASONS}, p AS (SELECT y, lead(y) OVER (PARTITION BY o_custkey ORDER BY season) AS nxt FROM y) SELECT round(least(greatest(corr(y, nxt), 0.2), 0.95), 6) AS rho FROM p WHERE nxt IS NOT NULL")
def m10b(spark, d):
    y = _seasons(spark, d)
    return spark.range(1).select(F.round(F.lit(T.persistence(y, "o_custkey", "season", "y")), 6).alias("rho"))


@R("M12_forecast_next", f"""WITH RECURSIVE {_SEASONS}, {_STATES}
SELECT f.o_custkey, f.season::INT AS source_season, (f.season + 1)::INT AS season, round({_RHO} * m + {_MU.replace('x', 'coalesce(t.x, s.x + 1)').replace('moved', 'coalesce(t.moved, 0)').replace('tier', 'coalesce(t.tier, 0)')}, 6) AS mean, round({_RHO * _RHO} * v + {_Q}, 6) AS var
FROM f JOIN c s ON s.o_custkey = f.o_custkey AND s.season = f.season LEFT JOIN c t ON t.o_custkey = f.o_custkey AND t.season = f.season + 1 WHERE k > 0""")
def m12(spark, d):
    got = T.forecast_next(_states(spark, d), _seasons(spark, d).select("o_custkey", "season", *_NAMES), "o_custkey", "season", _NAMES, _RHO, _BETAS, _Q)
    return got.select("o_custkey", "source_season", "season", r6("mean"), r6("var"))


_SKILLS = ("price", "tax", "discount")
_BLOCK = "s AS (SELECT l_suppkey, avg(l_extendedprice) / 10000 AS price, avg(l_tax) * 10 AS tax, avg(l_discount) * 10 AS discount, var_pop(l_quantity) / 100 AS v, avg(l_quantity) / 25 - 1 AS price_residual, avg(l_quantity * l_tax) - 1 AS tax_residual, avg(l_linenumber * l_discount) AS discount_residual FROM lineitem GROUP BY 1), k AS (SELECT corr(price_residual, tax_residual) AS pt, corr(price_residual, discount_residual) AS pd, corr(tax_residual, discount_residual) AS td FROM s)"


@R("M14_blend_blocks", f"""WITH {_BLOCK} SELECT l_suppkey, round(price + CASE WHEN abs(pt) >= abs(pd) THEN pt * tax_residual ELSE pd * discount_residual END * sqrt(v), 6) AS price_blended, round(tax + CASE WHEN abs(pt) >= abs(td) THEN pt * price_residual ELSE td * discount_residual END * sqrt(v), 6) AS tax_blended,
 round(discount + CASE WHEN abs(pd) >= abs(td) THEN pd * price_residual ELSE td * tax_residual END * sqrt(v), 6) AS discount_blended FROM s, k""")
def m14(spark, d):
    q = F.col("l_quantity")
    s = table(spark, d, "lineitem").groupBy("l_suppkey").agg(
        (F.avg("l_extendedprice") / 10000).alias("price"), (F.avg("l_tax") * 10).alias("tax"), (F.avg("l_discount") * 10).alias("discount"), (F.var_pop(q) / 100).alias("v"),
        (F.avg(q) / 25 - 1).alias("price_residual"), (F.avg(q * F.col("l_tax")) - 1).alias("tax_residual"), F.avg(F.col("l_linenumber") * F.col("l_discount")).alias("discount_residual"),
    )
    got = T.blend_blocks(s.withColumns({f"{k}_var": F.col("v") for k in _SKILLS}), list(_SKILLS))
    return got.select("l_suppkey", *[r6(f"{k}_blended") for k in _SKILLS])


@R("M15_project_rates", """WITH s AS (SELECT l_suppkey, avg(l_quantity) AS attempts, avg(l_discount) * 10 AS shot, avg(l_extendedprice) / 1000 AS skill, avg(l_tax) AS assist, CASE WHEN l_suppkey % 5 > 0 THEN 60.0 + l_suppkey % 15 END AS pace FROM lineitem GROUP BY 1),
m AS (SELECT covar_pop(attempts, skill) * count(*) / (var_pop(skill) * (count(*) + 5)) AS b, avg(attempts) AS my, avg(skill) AS mx FROM s), p AS (SELECT s.*, greatest(my + b * (skill - mx), 0) AS rate, coalesce(pace, 68) AS pc FROM s, m)
SELECT l_suppkey, round(rate, 6) AS rate, round(rate * least(shot, 1), 6) AS rate_make, round(rate * (1 - least(shot, 1)), 6) AS rate_miss, round(assist, 6) AS ast, round(rate / (pc / 100), 6) AS rate_per100, round(assist / (pc / 100), 6) AS ast_per100 FROM p""")
def m15(spark, d):
    s = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.avg("l_quantity").alias("attempts"), (F.avg("l_discount") * 10).alias("shot"), (F.avg("l_extendedprice") / 1000).alias("skill"), F.avg("l_tax").alias("assist"))
    s = s.withColumn("pace", F.when(F.col("l_suppkey") % 5 > 0, 60.0 + F.col("l_suppkey") % 15))
    got = T.project_rates(s, {"rate": M.ridge_fit(s, "attempts", ["skill"], alpha=5.0)}, {"rate": "shot"}, {"ast": "assist"}, "pace")
    return got.select("l_suppkey", *[r6(c) for c in ("rate", "rate_make", "rate_miss", "ast", "rate_per100", "ast_per100")])


@R("C07_player_projection")
def c07(spark, d):
    """Season states by a fitted drift, one-step forecasts, an offence and a defence model on them, and the difference with its 80 % interval."""
    y = stage(_seasons(spark, d), "seasons")
    fit = T.fit_drift(y, "o_custkey", "season", "y", "r", _NAMES)
    states = T.season_states(y, "o_custkey", "season", "y", "r", _NAMES, fit["rho"], fit["betas"], fit["q"], fit["prior"])
    ahead = stage(T.forecast_next(states, y.select("o_custkey", "season", *_NAMES), "o_custkey", "season", _NAMES, fit["rho"], fit["betas"], fit["q"]), "ahead")
    labels = y.select("o_custkey", "season", F.col("y").alias("off"), (F.col("f") / F.col("n")).alias("deff"))
    train = ahead.join(labels, ["o_custkey", "season"])
    off, deff = M.ridge_fit(train, "off", ["mean"], alpha=5.0, weight=None), M.ridge_fit(train, "deff", ["mean"], alpha=5.0)
    both = {"features": ["mean"], "coef": [off["coef"][0] - deff["coef"][0]], "intercept": off["intercept"] - deff["intercept"], "residual_std": (off["residual_std"] ** 2 + deff["residual_std"] ** 2) ** 0.5}
    value, low, high = M.predict_interval(both, {"mean": F.col("var")}, 1.2816)
    return ahead.select("o_custkey", "season", r6("mean"), r6("var"), r6(value, "value"), r6(low, "low"), r6(high, "high"))
