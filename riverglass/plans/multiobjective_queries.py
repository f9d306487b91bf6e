"""Comparison of agents by their fronts (family I, second part)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import multiobjective as M
from .registry import query

O = ["obj1", "obj2", "obj3"]
DOM = "o.obj1 >= p.obj1 AND o.obj2 >= p.obj2 AND o.obj3 >= p.obj3 AND (o.obj1 > p.obj1 OR o.obj2 > p.obj2 OR o.obj3 > p.obj3)"
FRONT = f"fr AS (SELECT * FROM rollouts p WHERE NOT EXISTS (SELECT 1 FROM rollouts o WHERE o.agent = p.agent AND {DOM}))"
DIST = "sqrt((a.obj1 - b.obj1) ** 2 + (a.obj2 - b.obj2) ** 2 + (a.obj3 - b.obj3) ** 2)"
PAIRS = f"{FRONT}, near AS (SELECT a.agent AS a, b.agent AS b, a.rollout_id AS i, min({DIST}) AS d FROM fr a, fr b GROUP BY ALL), one AS (SELECT a, b, max(d) AS far, avg(d) AS avg_min FROM near GROUP BY ALL)"


def _front(d):
    return M.swept_pareto(d.rollouts, "agent", O)


@query("i17_pareto_front", f"WITH {FRONT} SELECT agent, rollout_id FROM fr")
def i17(d):
    return _front(d).select("agent", "rollout_id")


@query("i18_reference_point", "SELECT " + ", ".join(f"round(min({o}) - 0.05 * (max({o}) - min({o}) + 1e-12), 9) AS {o}" for o in O) + " FROM rollouts")
def i18(d):
    return M.reference_point(d.rollouts, O).select(*[F.round(o, 9).alias(o) for o in O])


@query("i19_hypervolume_2d", "WITH r AS (SELECT DISTINCT agent, obj1 AS x, obj2 AS y FROM rollouts WHERE obj1 > -1 AND obj2 > -1), s AS (SELECT agent, (x + 1) * greatest(y - coalesce(max(y) OVER (PARTITION BY agent ORDER BY x DESC, y DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1), 0) AS strip FROM r) SELECT agent, round(sum(strip), 6) AS hypervolume FROM s GROUP BY agent")
def i19(d):
    return M.hypervolume_2d(d.rollouts, "agent", "obj1", "obj2", (-1.0, -1.0)).select("agent", F.round("hypervolume", 6).alias("hypervolume"))


VOLUME = f"""WITH {FRONT}, ins AS (SELECT * FROM fr WHERE obj1 > -1 AND obj2 > -1 AND obj3 > -1),
sl AS (SELECT agent, z, z - coalesce(lag(z) OVER (PARTITION BY agent ORDER BY z), -1) AS thick FROM (SELECT DISTINCT agent, obj3 AS z FROM ins)),
pt AS (SELECT DISTINCT sl.agent, z, thick, obj1 AS x, obj2 AS y FROM sl JOIN ins ON ins.agent = sl.agent AND obj3 >= z),
st AS (SELECT agent, thick, (x + 1) * greatest(y - coalesce(max(y) OVER (PARTITION BY agent, z ORDER BY x DESC, y DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1), 0) AS strip FROM pt)
SELECT agent, round(sum(strip * thick), 6) AS hypervolume FROM st GROUP BY agent"""


@query("i19_hypervolume_3d", VOLUME)
def i19_3d(d):
    return M.hypervolume_3d(_front(d), "agent", O, [-1.0, -1.0, -1.0]).select("agent", F.round("hypervolume", 6).alias("hypervolume"))


SAMPLE = "sm AS (SELECT id, " + ", ".join(f"-1 + ((id + 1) * {step} % 4294967296) / 4294967296.0::DOUBLE * 2 AS r{i}" for i, step in enumerate(M.spread(3))) + " FROM (SELECT unnest(range(20000)) AS id))"


@query("i20_hypervolume_sampled", f"WITH {FRONT}, {SAMPLE} SELECT agent, round(count(DISTINCT id) / 20000.0::DOUBLE * 8, 9) AS hypervolume FROM fr JOIN sm ON obj1 >= r0 AND obj2 >= r1 AND obj3 >= r2 GROUP BY agent")
def i20(d):
    return M.hypervolume_sampled(_front(d), "agent", O, [-1.0] * 3, [1.0] * 3).withColumn("hypervolume", F.round("hypervolume", 9))


@query("i21_sparsity", f"WITH {FRONT}, m AS (SELECT a.agent AS agent, avg({DIST}) AS s FROM fr a JOIN fr b ON a.agent = b.agent AND a.rollout_id < b.rollout_id GROUP BY 1) SELECT DISTINCT fr.agent, round(coalesce(s, 0), 6) AS sparsity FROM fr LEFT JOIN m ON fr.agent = m.agent")
def i21(d):
    return M.sparsity(_front(d), "agent", O).select("agent", F.round("sparsity", 6).alias("sparsity"))


def _distances(d):
    return M.front_distances(_front(d), "agent", O)


@query("i22_hausdorff", f"WITH {PAIRS} SELECT x.a, x.b, round(greatest(x.far, y.far), 6) AS hausdorff FROM one x JOIN one y ON x.a = y.b AND x.b = y.a")
def i22(d):
    return _distances(d).select("a", "b", F.round("hausdorff", 6).alias("hausdorff"))


@query("i23_avg_min", f"WITH {PAIRS} SELECT a, b, round(avg_min, 6) AS avg_min FROM one")
def i23(d):
    return _distances(d).select("a", "b", F.round("avg_min", 6).alias("avg_min"))


@query("i24_centroid", f"WITH {FRONT}, c AS (SELECT agent, avg(obj1) AS obj1, avg(obj2) AS obj2, avg(obj3) AS obj3 FROM fr GROUP BY agent) SELECT a.agent AS a, b.agent AS b, round({DIST}, 6) AS centroid FROM c a, c b")
def i24(d):
    return _distances(d).select("a", "b", F.round("centroid", 6).alias("centroid"))


WASS = "lg AS (" + " UNION ALL ".join(f"SELECT agent, '{o}' AS o, {o} AS x FROM rollouts" for o in O) + "), wt AS (SELECT agent, o, x, 1.0::DOUBLE / count(*) OVER (PARTITION BY agent, o) AS w FROM lg), st AS (SELECT p.a, p.b, o, x, sum(CASE WHEN wt.agent = p.a THEN w ELSE -w END) AS w FROM (SELECT DISTINCT x.agent AS a, y.agent AS b FROM rollouts x, rollouts y WHERE x.agent < y.agent) p JOIN wt ON wt.agent = p.a OR wt.agent = p.b GROUP BY ALL), gp AS (SELECT a, b, o, abs(sum(w) OVER v) * (lead(x) OVER v - x) AS area FROM st WINDOW v AS (PARTITION BY a, b, o ORDER BY x)), ws AS (SELECT a, b, avg(d) AS wasserstein FROM (SELECT a, b, o, sum(area) AS d FROM gp GROUP BY ALL) GROUP BY ALL)"


@query("i25_wasserstein", f"WITH {WASS} SELECT a, b, round(wasserstein, 6) AS wasserstein FROM ws")
def i25(d):
    return M.wasserstein(d.rollouts, "agent", O).select("a", "b", F.round("wasserstein", 6).alias("wasserstein"))


@query("i26_specialization", f"WITH {PAIRS}, s AS (SELECT avg(coalesce(v, 0)) AS s FROM (SELECT DISTINCT agent FROM fr) k LEFT JOIN (SELECT a.agent AS agent, avg({DIST}) AS v FROM fr a JOIN fr b ON a.agent = b.agent AND a.rollout_id < b.rollout_id GROUP BY 1) m ON k.agent = m.agent), c AS (SELECT avg((x.avg_min + y.avg_min) / 2) AS c FROM one x JOIN one y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b) SELECT round(c / (s + 1e-12), 6) AS specialization FROM c, s")
def i26(d):
    one = _distances(d)
    back = one.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("avg_min").alias("back"))
    apart = one.join(back, ["a", "b"]).where("a < b").agg(F.avg((F.col("avg_min") + F.col("back")) / 2).alias("c"))
    spread = M.sparsity(_front(d), "agent", O).agg(F.avg("sparsity").alias("s"))
    return apart.crossJoin(spread).select(F.round(F.col("c") / (F.col("s") + 1e-12), 6).alias("specialization"))


def _matrix_sql(source: str, value: str) -> str:
    """One column per agent: embeddings carry ten labels."""
    return "SELECT a, " + ", ".join(f"max(round({value}, 6)) FILTER (b = {k}) AS \"{k}\"" for k in range(10)) + f" FROM {source} GROUP BY a"


def _agents(d) -> list:
    return [r.agent for r in d.rollouts.select("agent").distinct().orderBy("agent").collect()]  # the columns of the result


@query("i27_distance_matrix", f"WITH {PAIRS} {_matrix_sql('one', 'avg_min')}")
def i27(d):
    return M.matrix(_distances(d), "avg_min", _agents(d))


@query("i27_hausdorff_matrix", f"WITH {PAIRS}, hd AS (SELECT x.a, x.b, greatest(x.far, y.far) AS hausdorff FROM one x JOIN one y ON x.a = y.b AND x.b = y.a) {_matrix_sql('hd', 'hausdorff')}")
def i27_hausdorff(d):
    return M.matrix(_distances(d), "hausdorff", _agents(d))


@query("i27_centroid_matrix", f"WITH {FRONT}, c AS (SELECT agent, avg(obj1) AS obj1, avg(obj2) AS obj2, avg(obj3) AS obj3 FROM fr GROUP BY agent), cd AS (SELECT a.agent AS a, b.agent AS b, {DIST} AS centroid FROM c a, c b) {_matrix_sql('cd', 'centroid')}")
def i27_centroid(d):
    return M.matrix(_distances(d), "centroid", _agents(d))


@query("i27_wasserstein_matrix", f"WITH {WASS}, sym AS (SELECT a, b, wasserstein FROM ws UNION ALL SELECT b, a, wasserstein FROM ws) {_matrix_sql('sym', 'wasserstein')}")
def i27_wasserstein(d):
    one = M.wasserstein(d.rollouts, "agent", O)
    return M.matrix(one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "wasserstein")), "wasserstein", _agents(d))
