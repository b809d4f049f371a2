"""Job graphs as tables of edges (src, dst): reachability, levels, components, invalidation.

Every loop joins a frontier and stores each round's new rows alone, so that what is written grows with the nodes and not with
rounds times nodes; the rounds found so far are read together, and merged into one table when there are many. A lost executor
costs nothing that was finished.

A broadcast goes through the driver, and in a loop it does so every round: the joins here shuffle both sides, and only a
frontier of at most FEW rows, counted when it was stored, is broadcast.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stored(df: DataFrame) -> DataFrame:
    """df's rows in the folder that the cluster names in spark.checkpoint.dir (one of our own where it is unset, in local mode)."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        wanted = sc.getConf().get("spark.checkpoint.dir")
        if not wanted and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(wanted or tempfile.mkdtemp(prefix="rillflow-"))
    return df.checkpoint()


#: Rows that a round may broadcast.
FEW = 5_000


def meet(a: DataFrame, b: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """a joined with b by shuffling both, however small the planner takes one to be."""
    return a.join(b.hint("merge"), on, how)


def few(rows: DataFrame, size: int) -> DataFrame:
    """rows to join with: broadcast if there are few of them, else shuffled."""
    return F.broadcast(rows) if size <= FEW else rows.hint("merge")


class Rounds:
    """The rows that a loop has found, a stored table for each round; every `most` rounds become one."""

    def __init__(self, first: DataFrame, most: int = 12):
        self.parts, self.most = [first], most

    def add(self, rows: DataFrame) -> None:
        self.parts.append(rows)
        if len(self.parts) > self.most:
            self.parts = [stored(self.all())]

    def all(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.parts)


def closure(edges: DataFrame, start: DataFrame, stop: DataFrame | None = None) -> DataFrame:
    """(node, depth): what is reachable from start (node), start included, at its least depth. Nodes of stop are neither returned nor passed."""
    step = edges.select(F.col("src").alias("node"), "dst")
    if stop is not None:
        start = meet(start, stop, "node", "left_anti")
    frontier, depth = stored(start.select("node").distinct().withColumn("depth", F.lit(0))), 0
    seen, size = Rounds(frontier), frontier.count()
    while size:
        depth += 1
        new = meet(step.join(few(frontier, size), "node").select(F.col("dst").alias("node")).distinct(), seen.all(), "node", "left_anti")
        if stop is not None:
            new = meet(new, stop, "node", "left_anti")
        frontier = stored(new.withColumn("depth", F.lit(depth)))
        if size := frontier.count():
            seen.add(frontier)
    return seen.all()


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def levels(edges: DataFrame) -> DataFrame:
    """(node, level): the longest way from a node without predecessors. An error if a cycle leaves nodes without a level.

    A round touches only the edges out of the level before it: they are counted at their ends, and a node gets its level when
    as many have come as it has predecessors.
    """
    edges = stored(edges.select("src", "dst").distinct())
    waits = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("waits"))
    nodes = stored(edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().transform(meet, waits, "node", "left").select("node", F.coalesce("waits", F.lit(0)).alias("waits")))
    last, level = stored(nodes.where("waits = 0").select("node", F.lit(0).alias("level"))), 0
    size = found = last.count()
    done = Rounds(last)
    came = None  # nodes that wait for more, and how many of their edges have come
    while True:
        level += 1
        new = edges.join(few(last.select(F.col("node").alias("src")), size), "src").groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n"))
        came = new if came is None else came.unionByName(new).groupBy("node").agg(F.sum("n").alias("n"))
        came = stored(meet(came, nodes, "node").select("node", "n", (F.col("n") == F.col("waits")).alias("full")))
        last = stored(came.where("full").select("node", F.lit(level).alias("level")))
        came = came.where("not full").select("node", "n")
        if not (size := last.count()):
            if found != nodes.count():
                raise ValueError("the graph has a cycle")
            return done.all()
        found += size
        done.add(last)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that is connected, whatever the direction; labels jump along as they spread."""
    both = stored(edges.unionByName(reverse(edges)).distinct())
    label = stored(both.select(F.col("src").alias("node")).distinct().withColumn("component", F.col("node")))
    while True:
        near = meet(both, label, F.col("dst") == F.col("node")).groupBy("src").agg(F.min("component").alias("near"))
        least = meet(label, near, F.col("node") == F.col("src")).select("node", F.least("component", "near").alias("component"))
        jump = least.select(F.col("node").alias("component"), F.col("component").alias("further"))
        new = stored(meet(least, jump, "component").select("node", F.least("component", "further").alias("component")))
        if meet(new, label.withColumnRenamed("component", "old"), "node").where("component <> old").isEmpty():
            return new
        label = new


def needs_run(edges: DataFrame, own: DataFrame, missing: DataFrame | None = None) -> DataFrame:
    """Nodes to run: seeds (own reason, and no ancestor with one), all downstream of them over edges that are not ancient, and upstream where a needed output is missing.

    edges: src, dst and, if given, ancient; own and missing: node. What was found is never searched again: a round starts from
    the nodes that the one before it added.
    """
    if "ancient" not in edges.columns:
        edges = edges.withColumn("ancient", F.lit(False))
    plain = edges.select("src", "dst")
    below = closure(plain, meet(plain, own.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node")))
    start = stored(meet(own.select("node").distinct(), below, "node", "left_anti"))
    open_ = edges.where("not ancient").select("src", "dst")
    found = None
    while True:
        new = closure(open_, start, None if found is None else found.all()).select("node")
        if found is None:
            found = Rounds(stored(new))
        else:
            found.add(stored(new))
        if missing is None:
            return found.all()
        up = meet(plain, new.withColumnRenamed("node", "dst"), "dst").select(F.col("src").alias("node")).distinct()
        start = stored(meet(meet(up, missing, "node", "left_semi"), found.all(), "node", "left_anti"))
        if start.isEmpty():
            return found.all()


#: Own reasons in the order in which they are looked for.
REASONS = ("forced", "missing output", "updated input", "code changed", "input changed", "params changed")


def run_reasons(edges: DataFrame, jobs: DataFrame) -> DataFrame:
    """(node, reason) of every node that runs, with the first reason that holds.

    edges: src, dst and, if given, ancient. jobs: node and booleans: missing (an output is not there), needed (a target: its
    outputs are asked for), forced, updated, code, inputs, params (null is false). A job runs by its own reason (a missing
    output is one where the job is a target); by 'missing output' if a job that runs takes an output that isn't there; and by
    'input comes anew' if a job that it takes from, not as ancient, runs.
    """
    is_ = lambda c: F.coalesce(F.col(c), F.lit(False))
    own = (is_("forced"), is_("missing") & is_("needed"), is_("updated"), is_("code"), is_("inputs"), is_("params"))
    reason = F.coalesce(*(F.when(c, F.lit(r)) for c, r in zip(own, REASONS, strict=True)))
    jobs = stored(jobs.select("node", is_("missing").alias("missing"), reason.alias("own")))
    edges = edges if "ancient" in edges.columns else edges.withColumn("ancient", F.lit(False))
    down = edges.where("not ancient").select("src", "dst")
    up = meet(edges, jobs.where("missing").select(F.col("node").alias("src")), "src", "left_semi").select("src", "dst")
    step = stored(down.unionByName(reverse(up)).distinct())
    runs = stored(closure(step, jobs.where("own is not null").select("node")).select("node"))
    taken = meet(up, runs.withColumnRenamed("node", "dst"), "dst", "left_semi").select(F.col("src").alias("node"), F.lit("missing output").alias("taken")).distinct()
    met = meet(meet(runs, jobs, "node", "left"), taken, "node", "left")
    return met.select("node", F.coalesce("own", "taken", F.lit("input comes anew")).alias("reason"))


def replan(start: DataFrame, expand: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Jobs (node) of a plan that results change: expand() gives the jobs that follow from the results of new ones, until none is new.

    What expand() gets says itself, by a hint, how it is to be joined.
    """
    frontier = stored(start.select("node").distinct())
    found, size = Rounds(frontier), frontier.count()
    while size:
        frontier = stored(meet(expand(few(frontier, size)).select("node").distinct(), found.all(), "node", "left_anti"))
        if size := frontier.count():
            found.add(frontier)
    return found.all()
