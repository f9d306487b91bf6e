"""Capacity analytics over profile and pipeline tables: queueing, critical paths, replicas, batch sizes, placement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored


def queueing_us(rate: Column, service: Column, variant: str = "guarded") -> Column:
    """Mean wait in microseconds from arrival and service rates per second: rho^2 / (1 - rho) / rate.

    ``guarded``: no arrivals count as one, overload gives 999999999; ``zero``: no arrivals give 0; ``plain``: no guards but for rho = 1.
    """
    r = F.when(rate == 0, F.lit(1.0)).otherwise(rate) if variant == "guarded" else rate
    rho = r / service
    wait = F.try_divide(rho * rho, 1 - rho) / r * 1e6
    if variant == "guarded":
        return F.when(rho >= 1, F.lit(999999999.0)).otherwise(wait)
    if variant == "zero":
        return F.when(rate == 0, F.lit(0.0)).when(rho == 1, F.lit(None)).otherwise(wait)
    return F.when((rate == 0) | (rho == 1), F.lit(None)).otherwise(wait)


def stage_latency(df: DataFrame, is_end: Column | None = None) -> DataFrame:
    """Adds avg_latency, max_latency and cost of a stage from prep, infer, post, batch_size and transfer; sources and sinks (``is_end``) take no time."""
    p, i, o, b = (F.col(c) for c in ("prep", "infer", "post", "batch_size"))
    stage = lambda x: x if is_end is None else F.when(is_end, F.lit(0)).otherwise(x)
    return df.withColumns({"avg_latency": stage(p + i * b + o), "max_latency": stage((p + i + o) * b), "cost": stage(p + i + o + F.col("transfer"))})


def by_level(nodes: DataFrame, edges: DataFrame, start: str, step: Column, total: str, combine: Callable[[Column], Column] = F.max, own: Column | None = None) -> DataFrame:
    """``total`` of every node of a DAG of any depth: ``start`` at sources, else ``own`` (default 0) plus ``step`` over its upstreams, combined (largest or sum).

    ``step`` may use the edge's columns and the upstream's as u_*, ``total`` among them. One join per level, written down; it ends when
    no total changes. A pipeline with a cycle is refused.
    """
    names = [*nodes.columns, total]
    state = stored(nodes.withColumn(total, F.col(start)), "levels")
    most = state.groupBy("pipeline").count().agg(F.max("count")).first()[0] or 0
    reached = F.col("next_") if own is None else F.col("next_") + own
    for _ in range(most + 1):
        up = state.select(*[F.col(c).alias(f"u_{c}") for c in names])
        into = edges.join(up, (F.col("u_pipeline") == F.col("pipeline")) & (F.col("u_node") == F.col("src"))).groupBy("pipeline", F.col("dst").alias("node")).agg(combine(step).alias("next_"))
        both = state.withColumnRenamed(total, "before_").join(into, ["pipeline", "node"], "left").withColumn(total, F.coalesce(reached, F.col(start)))
        after = stored(both.select(*names, (~F.col(total).eqNullSafe(F.col("before_"))).alias("moved_")), "levels")
        state = after.drop("moved_")
        if after.where("moved_").isEmpty():
            return state
    raise ValueError("the edges of a pipeline form a cycle")


def start_to_here(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds start2here, the longest way from the source through a node (0 at sources): its own processing, transfer and queueing after the slowest upstream's."""
    own = F.col("max_proc") + F.col("transfer") + F.col("queue")
    return by_level(nodes.withColumn("zero_", F.lit(0.0)), edges, "zero_", F.col("u_start2here"), "start2here", own=own).drop("zero_")


def start_to_here_cost(nodes: DataFrame, edges: DataFrame, cost: str) -> DataFrame:
    """Adds start2here_cost: a node's own ``cost`` plus that of all its upstreams, each with its own (0 at sources)."""
    return by_level(nodes.withColumn("zero_", F.lit(0.0)), edges, "zero_", F.col("u_start2here_cost"), "start2here_cost", F.sum, F.col(cost)).drop("zero_")


def stage_timing(nodes: DataFrame, edges: DataFrame, source: str = "datasource", sink: str = "sink") -> DataFrame:
    """Adds start_time, end_time and duty_cycle of every stage, which depend on the device that each runs on.

    ``reach`` is the processing time on the way here since the way last changed devices (a sink is always reached). A stage starts at its ``reach`` or at the end of an upstream
    on its own device, whichever is later, and ends ``max_proc`` later; source and sink take no time. Backwards: a sink's duty cycle is the last end of its upstreams;
    a stage's is the largest of those of its downstreams on its device, and of its own ``reach`` plus ``max_proc`` where one is on another device.
    """
    away = nodes.select("pipeline", F.col("node").alias("dst"), F.col("device").alias("to_device"))
    edges = stored(edges.join(away, ["pipeline", "dst"]), "edges")
    zero, last = F.lit(0.0), F.col("dst") == sink
    far = (F.col("u_device") != F.col("to_device")) & ~last
    rows = by_level(nodes.withColumn("zero_", zero), edges, "zero_", F.when(far, zero).otherwise(F.col("u_reach") + F.col("u_max_proc")), "reach")
    until = F.when(F.col("u_node") == source, zero).otherwise(F.greatest("u_reach", "u_begun") + F.col("u_max_proc"))
    rows = by_level(rows, edges, "zero_", F.when(F.col("u_device") == F.col("to_device"), until).otherwise(zero), "begun")
    ends = F.col("node").isin(source, sink)
    rows = rows.withColumn("start_time", F.when(ends, zero).otherwise(F.greatest("reach", "begun")))
    rows = stored(rows.withColumn("end_time", F.when(ends, zero).otherwise(F.col("start_time") + F.col("max_proc"))), "timing")
    into_sink = edges.where(last).join(rows.select("pipeline", F.col("node").alias("src"), "end_time"), ["pipeline", "src"]).groupBy("pipeline", F.col("dst").alias("node")).agg(F.max("end_time").alias("last_"))
    rows = rows.join(into_sink, ["pipeline", "node"], "left").withColumn("last_", F.coalesce("last_", zero))
    own = rows.select("pipeline", F.col("node").alias("src"), F.col("device").alias("from_device"), (F.col("reach") + F.col("max_proc")).alias("passed"))
    back = edges.join(own, ["pipeline", "src"]).select("pipeline", F.col("dst").alias("src"), F.col("src").alias("dst"), "passed", ((F.col("from_device") != F.col("to_device")) & ~last).alias("far"))
    out = by_level(rows, stored(back, "edges"), "last_", F.when(F.col("far"), F.col("passed")).otherwise(F.col("u_duty_cycle")), "duty_cycle")
    return out.drop("zero_", "reach", "begun", "last_")


def time_left(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds time_left: 0 at sinks, else 1.2 times the largest child's plus 1.2 times the node's own queueing and processing."""
    back = edges.select("pipeline", F.col("dst").alias("src"), F.col("src").alias("dst"))
    own = F.lit(1.2) * (F.col("queue") + F.col("max_proc"))
    rows = nodes.withColumn("own_", own).join(edges.select("pipeline", F.col("src").alias("node"), F.lit(True).alias("inner_")).distinct(), ["pipeline", "node"], "left")
    rows = rows.withColumn("zero_", F.lit(0.0)).withColumn("own_", F.when(F.col("inner_"), F.col("own_")).otherwise(0.0)).drop("inner_")
    out = by_level(rows, back, "zero_", F.col("u_below_") * 1.2 + F.col("u_own_"), "below_")
    return out.withColumn("time_left", F.col("below_") * F.when(F.col("own_") > 0, 1.2).otherwise(1.0) + F.col("own_")).drop("below_", "own_", "zero_")


def replicas_up(current: Column, rate: Column, process_rate: Column, prep_rate: Column, most: int = 4) -> Column:
    """Smallest count, up to ``most``, that takes the rate at 80 % of the processing and 95 % of the preprocessing rate."""
    need = F.greatest(current, F.ceil(rate / (process_rate * 0.8)), F.ceil(rate / (prep_rate * 0.95)))
    return F.least(F.lit(most).cast("long"), need).cast("long")


def replicas_down(current: Column, rate: Column, process_rate: Column, prep_rate: Column) -> Column:
    need = F.greatest(F.lit(1).cast("long"), F.ceil(rate / (process_rate * 0.7)), F.ceil(rate / (prep_rate * 0.9)))
    return F.least(current, need).cast("long")


def queue_sizes(rate: Column, prep: Column, infer: Column, post: Column, batch: Column, least: int = 30) -> dict[str, Column]:
    """Queue sizes before preprocessing, inference (in batches), postprocessing and sending, and the stages' throughput, from latencies in microseconds.

    Each queue holds ceil(rho^2 / (2 (1 - rho))), ``least`` at least, where every stage is fed by what the one before lets through; overload counts as the least.
    """

    def size(rho: Column) -> Column:
        waiting = F.ceil(F.try_divide(rho * rho, 2 * (1 - rho)))
        return F.greatest(F.lit(least).cast("long"), F.when(rho < 1, waiting).otherwise(F.lit(least)).cast("long"))

    prep_rate, infer_rate, post_rate = 1e6 / prep, 1e6 / (infer * batch), 1e6 / post
    prepared = F.least(prep_rate, rate)
    inferred = F.least(infer_rate, prepared / batch)
    last = size(inferred * batch / post_rate)
    return {
        "prep_queue": size(rate / prep_rate), "infer_queue": size(prepared / batch / infer_rate), "post_queue": last,
        "send_queue": last * batch.cast("long"), "throughput": F.least(post_rate, inferred * batch),
    }


def merged_profile(df: DataFrame, keys: list[str], largest: tuple[str, ...] = ("cpu", "mem")) -> DataFrame:
    """Rate-weighted mean stage times, largest resources and package sizes (``largest``) and summed rates over the streams of a group."""
    mean = lambda c: (F.sum(F.col(c) * F.col("rate")) / F.sum("rate")).alias(c)
    return df.groupBy(*keys).agg(mean("prep"), mean("infer"), mean("post"), *[F.max(c).alias(c) for c in largest], F.sum("rate").alias("rate"))


def shift_candidates(nodes: DataFrame, edges: DataFrame, slo: Column, source: str = "datasource", sink: str = "sink") -> DataFrame:
    """Stages worth moving to the edge, one at a time: they shrink their input enough, are allowed there, and the pipeline's way to its sink,
    with the stage's figures on the edge (edge_proc, edge_transfer), stays within ``slo``. Every candidate is tried in a copy of its pipeline.
    """
    worth = (F.col("input_size") * 0.6 > F.col("output_size")) & F.col("allowed") & ~F.col("node").isin(source, sink)
    fit = nodes.where(worth).select("pipeline", F.col("node").alias("moved"))
    here = F.col("node") == F.col("moved")
    tried = nodes.join(fit, "pipeline").withColumns({"max_proc": F.when(here, F.col("edge_proc")).otherwise(F.col("max_proc")), "transfer": F.when(here, F.col("edge_transfer")).otherwise(F.col("transfer"))})
    copy = F.concat_ws("\u0001", F.col("pipeline"), "moved")
    copies = tried.select(copy.alias("pipeline"), F.col("pipeline").alias("of"), "moved", "node", "max_proc", "transfer", "queue")
    ways = edges.join(fit, "pipeline").select(copy.alias("pipeline"), "src", "dst")
    done = start_to_here(copies, stored(ways, "ways")).where(F.col("node") == sink)
    return done.select(F.col("of").alias("pipeline"), F.col("moved").alias("node"), F.col("start2here").alias("latency")).where(F.col("latency") <= slo)


def cheapest_batch(candidates: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Per model the power-of-two batch size up to ``most`` with the lowest cost whose latency is below its SLO."""
    b = F.col("batch_size")
    fit = candidates.where((b <= most) & (F.bit_count(b) == 1) & (F.col("latency") < F.col("slo")))
    return fit.groupBy(*keys).agg(F.min_by("batch_size", F.struct("cost", "batch_size")).alias("batch_size"), F.min("cost").alias("cost"))


def side_throughput(df: DataFrame, edge_batch: int = 8, server_batch: int = 16) -> DataFrame:
    """Items per second of edge and server from inference latency at each side's batch size, and their load as a whole number."""
    chosen = F.col("batch_size") == F.when(F.col("is_edge"), edge_batch).otherwise(server_batch)
    rate = F.when(chosen & (F.col("infer") > 0), F.lit(1e6) / F.col("infer")).otherwise(0.0)
    return df.groupBy("is_edge").agg(F.sum(rate).alias("throughput"), F.floor(F.sum("rate")).cast("long").alias("load"))


def split_decision(sides: DataFrame, base: float = 0.5) -> DataFrame:
    """Where to cut between edge and server: the base point nudged by the throughput ratio, offset by the load imbalance; move when out of bounds."""
    row = sides.agg(
        F.max(F.when(F.col("is_edge"), F.col("throughput"))).alias("edge"),
        F.max(F.when(~F.col("is_edge"), F.col("throughput"))).alias("server"),
        F.max(F.when(F.col("is_edge"), F.col("load"))).alias("edge_load"),
        F.max(F.when(~F.col("is_edge"), F.col("load"))).alias("server_load"),
    )
    ratio = F.try_divide(F.col("edge"), F.col("server"))
    nudge = F.when(ratio > 2, 0.006).when(ratio > 1.5, 0.003).when(ratio > 1, 0.001).when(ratio < 0.5, -0.006).when(ratio < 0.67, -0.003).otherwise(-0.001)
    point = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(base) + nudge))
    mean = (F.col("edge_load") + F.col("server_load")) / 2
    offset = (mean - F.col("edge_load")) / F.greatest("edge_load", "server_load")
    out = row.select(point.alias("point"), offset.alias("offset"))
    return out.withColumn("move", F.when(F.col("offset") > 0.1, "to_edge").when(F.col("offset") < -0.1, "to_server").otherwise("stay"))


def rounded_throughput(batch: Column, latency_us: Column) -> Column:
    """Items per second, cut down to a multiple of 10."""
    return (F.floor(F.floor(batch / (latency_us * 1e-6)) / 10) * 10).cast("long")


def pick_batch(profiles: DataFrame, selected: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First batch size above 1, in order, whose throughput exceeds the summed ``req_rate`` of the clients selected for the model; else 1."""
    demand = selected.groupBy(*keys).agg(F.sum("req_rate").alias("demand"))
    df = profiles.join(demand, keys, "left")
    good = (F.col("throughput") > F.coalesce("demand", F.lit(0))) & (F.col("batch_size") > 1)
    best = F.min_by(F.when(good, F.col("batch_size")), F.when(good, F.struct(*order)))
    return df.groupBy(*keys).agg(F.coalesce(best, F.lit(1).cast("long")).alias("batch_size"))


def pipeline_utilisation(df: DataFrame, most: float = 1.0) -> DataFrame:
    """Per device the best-filled subgraph that fits: sum of wanted rate over attainable rate."""
    use = df.groupBy("device", "subgraph").agg(F.sum(F.col("fps") / F.round(F.lit(1e6) / F.col("latency"))).alias("utilisation")).where(F.col("utilisation") <= most)
    w = Window.partitionBy("device").orderBy(F.desc("utilisation"), "subgraph")
    return use.withColumn("rn_", F.row_number().over(w)).where("rn_ = 1").drop("rn_")


def downward_paths(edges: DataFrame, most: int = 3, sink: str = "sink") -> DataFrame:
    """Every downward path of 1 to ``most`` nodes without the sink, as text."""
    e = edges.where(F.col("dst") != sink).select("pipeline", "src", "dst")
    first = e.select("pipeline", F.col("src").alias("last")).union(e.select("pipeline", "dst")).union(edges.select("pipeline", "src")).distinct().withColumn("path", F.col("last"))
    out, now = first, first
    for _ in range(most - 1):
        now = now.join(e.withColumnRenamed("src", "last"), ["pipeline", "last"]).select("pipeline", F.col("dst").alias("last"), F.concat_ws(">", "path", "dst").alias("path"))
        out = out.unionByName(now)
    return out.select("pipeline", "path")


def sibling_pairs(edges: DataFrame, sink: str = "sink") -> DataFrame:
    e = edges.where(F.col("dst") != sink)
    a, b = e.select("pipeline", "src", F.col("dst").alias("a")), e.select("pipeline", "src", F.col("dst").alias("b"))
    return a.join(b, ["pipeline", "src"]).where("a < b")


def largest_gap(devices: DataFrame, needs: DataFrame, spare: int = 500) -> DataFrame:
    """Per model the device with the most memory left after placing it, at least ``spare``. Devices and models are dimensions."""
    gap = F.col("free") - F.col("need")
    w = Window.partitionBy("model").orderBy(F.desc("gap"), "device")
    return needs.crossJoin(devices).withColumn("gap", gap).where(F.col("gap") >= spare).withColumn("rn_", F.row_number().over(w)).where("rn_ = 1").drop("rn_")


def largest_batch(clients: DataFrame, models: DataFrame, most: int, default: int = 2) -> DataFrame:
    """Per client the largest batch up to ``most`` with twice its latency inside budget less transmission; else ``default``."""
    fit = clients.join(models, "model").where((2 * F.col("latency") < F.col("budget") - F.col("transmission")) & (F.col("batch_size") <= most))
    best = fit.groupBy("client").agg(F.max("batch_size").alias("batch_size"))
    return clients.select("client").join(best, "client", "left").withColumn("batch_size", F.coalesce("batch_size", F.lit(default).cast("long")))
