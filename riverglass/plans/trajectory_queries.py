"""Trajectories, rewards, federated averages (family I, first part)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import trajectory as T
from .registry import query

EP, ORD = ["agent", "episode"], ["tm", "step"]
ORDERED = "o AS (SELECT agent, episode, step, reward, value, terminal, row_number() OVER (PARTITION BY agent, episode ORDER BY tm DESC, step DESC) AS rn FROM trajectory)"


@query("i1_discounted_return", f"WITH RECURSIVE {ORDERED}, f(agent, episode, step, rn, ret) AS (SELECT agent, episode, step, rn, reward FROM o WHERE rn = 1 UNION ALL SELECT o.agent, o.episode, o.step, o.rn, o.reward + 0.99::DOUBLE * f.ret FROM f JOIN o ON o.agent = f.agent AND o.episode = f.episode AND o.rn = f.rn + 1) SELECT step, round(ret, 6) AS ret FROM f")
def i1(d):
    return T.discounted(d.trajectory, EP, ORD).select("step", F.round("ret", 6).alias("ret"))


@query("i2_gae", f"WITH RECURSIVE {ORDERED}, f(agent, episode, step, rn, value, gae) AS (SELECT agent, episode, step, rn, value, reward - value FROM o WHERE rn = 1 UNION ALL SELECT o.agent, o.episode, o.step, o.rn, o.value, o.reward + 0.99::DOUBLE * f.value - o.value + 0.9405::DOUBLE * f.gae FROM f JOIN o ON o.agent = f.agent AND o.episode = f.episode AND o.rn = f.rn + 1) SELECT step, round(gae, 6) AS gae FROM f")
def i2(d):
    return T.advantages(d.trajectory, EP, ORD).select("step", F.round("gae", 6).alias("gae"))


@query("i3_masked_gae", f"WITH RECURSIVE {ORDERED}, f(agent, episode, step, rn, value, gae) AS (SELECT agent, episode, step, rn, value, reward + 0.99::DOUBLE * value * CASE WHEN terminal THEN 0 ELSE 1 END - value FROM o WHERE rn = 1 UNION ALL SELECT o.agent, o.episode, o.step, o.rn, o.value, o.reward + 0.99::DOUBLE * f.value * CASE WHEN o.terminal THEN 0 ELSE 1 END - o.value + 0.9405::DOUBLE * CASE WHEN o.terminal THEN 0 ELSE 1 END * f.gae FROM f JOIN o ON o.agent = f.agent AND o.episode = f.episode AND o.rn = f.rn + 1) SELECT step, round(gae, 6) AS gae, round(gae + value, 6) AS ret FROM f")
def i3(d):
    return T.masked_advantages(d.trajectory, EP, ORD).select("step", F.round("gae", 6).alias("gae"), F.round("ret", 6).alias("ret"))


@query("i4_normalised_advantage", "SELECT step, round((reward - avg(reward) OVER w) / (stddev_samp(reward) OVER w + 1e-8), 6) AS advantage FROM trajectory WINDOW w AS (PARTITION BY agent, episode)")
def i4(d):
    return T.normalised(d.trajectory, EP, "reward", "advantage").select("step", F.round("advantage", 6).alias("advantage"))


def _measures(d):
    f = lambda c: c.cast("double")
    v, e = F.col("v"), F.col("event_id")
    return d.request.select("event_id", (f(v % 100) / 50).alias("thr"), (f(v % 37) / 10 + 0.1).alias("lat"), f(e % 3).alias("over"), (f(e % 11) / 4).alias("mem"))


M_SQL = "m AS (SELECT event_id, CAST(v % 100 AS DOUBLE) / 50 AS thr, CAST(v % 37 AS DOUBLE) / 10 + 0.1::DOUBLE AS lat, CAST(event_id % 3 AS DOUBLE) AS ov, CAST(event_id % 11 AS DOUBLE) / 4 AS mem FROM request)"


@query("i5_reward_weighted", f"WITH {M_SQL}, r AS (SELECT event_id, least(1, greatest(-1, thr * 1.1::DOUBLE - lat * 0.5::DOUBLE - ov * 0.1::DOUBLE - mem * 0.1::DOUBLE / 3)) AS r FROM m) SELECT event_id, round(r, 6) AS reward, round(CASE WHEN r < 0 THEN r * 1.1::DOUBLE ELSE r * -0.9::DOUBLE END, 6) AS penalty FROM r")
def i5(d):
    args = [F.col(c) for c in ("thr", "lat", "over", "mem")]
    return _measures(d).select("event_id", F.round(T.reward_weighted(*args, F.lit(2.0)), 6).alias("reward"), F.round(T.reward_weighted(*args, F.lit(2.0), penalty=True), 6).alias("penalty"))


@query("i6_reward_log", f"WITH {M_SQL} SELECT event_id, round(least(25, greatest(-25, CASE WHEN lat <= 2 AND mem <= 1.5 THEN CASE WHEN thr = 0 THEN 0 ELSE ln(thr / (lat / 2)) END ELSE exp(-lat * mem) END)) / 25, 6) AS reward FROM m")
def i6(d):
    m = _measures(d)
    return m.select("event_id", F.round(F.when((F.col("thr") == 0) & (F.col("lat") <= 2) & (F.col("mem") <= 1.5), 0.0).otherwise(T.reward_log(F.col("thr"), F.col("lat"), F.lit(2.0), F.col("mem"), F.lit(1.5))), 6).alias("reward"))


@query("i7_reward_accuracy", f"WITH {M_SQL} SELECT event_id, round(ov * -0.05::DOUBLE + thr * (0.9::DOUBLE - lat * 0.5::DOUBLE * 1000), 4) AS reward FROM m")
def i7(d):
    return _measures(d).select("event_id", F.round(T.reward_accuracy(F.col("thr"), F.col("over"), F.col("lat")), 4).alias("reward"))


@query("i8_reward_ratios", f"WITH {M_SQL} SELECT event_id, round(CASE WHEN thr > 0 THEN ((2 / lat - 1) + (thr / 1.5 - 1) + (3 / (mem + 3) - 1)) / 3 ELSE 0 END, 6) AS reward FROM m")
def i8(d):
    c = F.col
    return _measures(d).select("event_id", F.round(T.reward_ratios(c("thr"), c("lat"), c("mem"), F.lit(2.0), F.lit(1.5), F.lit(3.0)), 6).alias("reward"))


@query("i9_state_features", f"WITH {M_SQL} SELECT event_id, [thr / 2, lat / 4, mem / 3] AS state FROM m")
def i9(d):
    return _measures(d).select("event_id", F.array(F.col("thr") / 2, F.col("lat") / 4, F.col("mem") / 3).alias("state"))


@query("i10_clipped_surrogate", f"WITH {M_SQL}, l AS (SELECT event_id % 5 AS agent, -least(thr * (lat - 2), least(1.2, greatest(0.8, thr)) * (lat - 2)) AS loss FROM m) SELECT agent, round(avg(loss), 6) AS loss FROM l GROUP BY agent")
def i10(d):
    m = _measures(d).withColumn("loss", T.surrogate(F.col("thr"), F.col("lat") - 2))
    return m.groupBy((F.col("event_id") % 5).alias("agent")).agg(F.round(F.avg("loss"), 6).alias("loss"))


@query("i10_rewarded_surrogate", f"WITH {M_SQL}, c AS (SELECT *, thr + 0.1 AS ratio, least(1.2, greatest(0.8, thr + 0.1)) AS cut FROM m), l AS (SELECT event_id % 5 AS agent, -least(ratio * (lat - 2), cut * (lat - 2)) + least(10 / ratio, 10 / cut) * exp(-mem) AS loss FROM c) SELECT agent, round(10 * avg(loss), 6) AS loss FROM l GROUP BY agent")
def i10_rewarded(d):
    m = _measures(d).withColumn("loss", T.rewarded_surrogate(F.col("thr") + 0.1, F.col("lat") - 2, F.col("mem")))
    return m.groupBy((F.col("event_id") % 5).alias("agent")).agg(F.round(F.avg("loss"), 6).alias("loss"))


@query("i11_value_loss", "SELECT agent, round(avg((value - reward) * (value - reward)), 6) AS loss FROM trajectory GROUP BY agent")
def i11(d):
    return d.trajectory.groupBy("agent").agg(F.round(F.avg(F.pow(F.col("value") - F.col("reward"), 2)), 6).alias("loss"))


@query("i12_episode_summary", "WITH e AS (SELECT agent, episode, sum(reward) AS total, avg(reward) AS mean FROM trajectory GROUP BY ALL) SELECT agent, episode, round(total, 6) AS total, round(mean, 6) AS mean, mean > greatest(coalesce(max(mean) OVER (PARTITION BY agent ORDER BY episode ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS is_best FROM e")
def i12(d):
    out = T.episodes(d.trajectory, ["agent"], "episode")
    return out.select("agent", "episode", F.round("total", 6).alias("total"), F.round("mean", 6).alias("mean"), "is_best")


PAR = "par AS (SELECT cluster, layer, client, latest_loss, unnest(range(0, len(weights))) AS idx, CAST(unnest(weights) AS DOUBLE) AS w FROM fl_updates)"


@query("i13_fed_avg", f"WITH {PAR}, g AS (SELECT cluster, layer, idx, CAST(idx AS DOUBLE) / 100 AS g FROM (SELECT DISTINCT cluster, layer, idx FROM par)), s AS (SELECT cluster, layer, idx, sum(w) AS s, count(*) AS n FROM par GROUP BY ALL) SELECT cluster, layer, idx, round((g + s) / (n + 1), 6) AS w FROM g JOIN s USING (cluster, layer, idx)")
def i13(d):
    keys = ["cluster", "layer"]
    globals_ = T.parameters(d.fl_updates, keys).select(*keys, "idx").distinct().withColumn("g", F.col("idx").cast("double") / 100)
    return T.fed_avg(d.fl_updates, globals_, keys).select(*keys, F.col("idx").cast("long").alias("idx"), F.round("w", 6).alias("w"))


@query("i14_head_average", "WITH g AS (SELECT *, latest_loss - lag(latest_loss) OVER w AS gap, row_number() OVER w AS rn FROM fl_updates WINDOW w AS (PARTITION BY cluster, layer ORDER BY client)), p AS (SELECT cluster, layer, CASE WHEN rn = 1 THEN 1 WHEN abs(gap) < 1e-6 THEN 1000000 ELSE 1 / gap END AS weight, unnest(range(0, len(weights))) AS idx, CAST(unnest(weights) AS DOUBLE) AS w FROM g) SELECT cluster, layer, idx, round(sum(w * weight), 3) AS w FROM p GROUP BY ALL")
def i14(d):
    return T.head_average(d.fl_updates, ["cluster", "layer"], "client").select("cluster", "layer", F.col("idx").cast("long").alias("idx"), F.round("w", 3).alias("w"))


@query("i15_soft_update", f"WITH {PAR} SELECT client, idx, round(0.995::DOUBLE * w + 0.005::DOUBLE * (w + 1), 9) AS w FROM par")
def i15(d):
    old = T.parameters(d.fl_updates, ["client"])
    out = T.soft_update(old, old.withColumn("w", F.col("w") + 1), ["client", "idx"])
    return out.select("client", F.col("idx").cast("long").alias("idx"), F.round("w", 9).alias("w"))


@query("i16_participation", "SELECT cluster AS round, count(DISTINCT client) AS n FROM fl_updates GROUP BY 1 HAVING count(DISTINCT client) >= 50")
def i16(d):
    """A cluster stands for a round; those with too few clients are not told."""
    return T.participation(d.fl_updates.withColumnRenamed("cluster", "round"), "round", "client", 100)
