"""Operators over tables of jobs: groups, readiness, incomplete outputs, resources, caches and inherited rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import Rounds, few, meet, stored


def first_choice(rows: DataFrame, by: str, order: Column, ok: Column, value: str) -> DataFrame:
    """Per `by` the first value, in order, for which a condition holds; null if for none."""
    return rows.groupBy(by).agg(F.min_by(value, F.when(ok, order)).alias("choice"))


def too_old(outputs: DataFrame, inputs: DataFrame) -> DataFrame:
    """Jobs (job, mtime on both sides) with an output older than the newest input."""
    newest = inputs.groupBy("job").agg(F.max("mtime").alias("newest"))
    return outputs.groupBy("job").agg(F.min("mtime").alias("oldest")).join(newest, "job").where("oldest < newest")


def shorten_ids(rows: DataFrame, column: str, n: int = 16) -> DataFrame:
    """rows with `short`, the first n characters; an error where two different ids begin alike."""
    begin = F.left(F.col(column), F.lit(n))
    kinds = rows.groupBy(begin.alias("__short")).agg(F.countDistinct(column).alias("__kinds"))
    met = rows.withColumn("__begin", begin).join(kinds, F.col("__begin") == F.col("__short"))
    short = F.when(F.col("__kinds") > 1, F.raise_error(F.concat(F.lit("two ids begin with "), F.col("__begin")))).otherwise(F.col("__begin"))
    return met.withColumn("short", short).drop("__begin", "__short", "__kinds")


def external_job(markers: DataFrame, by: str, column: str) -> DataFrame:
    """Per `by` the one external id of its incomplete outputs: null without one, an error if there are several."""
    found = markers.groupBy(by).agg(F.countDistinct(column).alias("__n"), F.max(column).alias("__id"))
    one = F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("several external ids: "), F.col(by).cast("string")))).otherwise(F.col("__id"))
    return found.select(by, one.alias(column))


def incomplete(outputs: DataFrame, marked: DataFrame, running: DataFrame) -> DataFrame:
    """Outputs (job, path) that exist and are marked incomplete, of jobs that would not run."""
    return outputs.join(marked.select("path").distinct(), "path", "left_semi").join(running.select("job").distinct(), "job", "left_anti")


def merged_wildcards(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """rows: by, name, value. The first value of each name, in order, in each group of jobs."""
    return rows.groupBy(by, "name").agg(F.min_by("value", F.struct(*order)).alias("value"))


def group_edges(edges: DataFrame, group: DataFrame) -> DataFrame:
    """edges (src, dst) with src_group and dst_group. group: node, group."""
    a = group.select(F.col("node").alias("src"), F.col("group").alias("src_group"))
    b = group.select(F.col("node").alias("dst"), F.col("group").alias("dst_group"))
    return edges.join(a, "src").join(b, "dst")


def group_inputs(edges: DataFrame, group: DataFrame) -> DataFrame:
    """(group, node): what a group's jobs take from outside it."""
    return group_edges(edges, group).where("src_group <> dst_group").select(F.col("dst_group").alias("group"), F.col("src").alias("node")).distinct()


def group_outputs(edges: DataFrame, group: DataFrame) -> DataFrame:
    """(group, node): jobs of a group whose results no other job of it takes."""
    inner = group_edges(edges, group).where("src_group = dst_group").select(F.col("src").alias("node")).distinct()
    return group.join(inner, "node", "left_anti").select("group", "node")


def ready_groups(edges: DataFrame, group: DataFrame, unfinished: DataFrame) -> DataFrame:
    """Groups of which no job waits for an unfinished one outside its group."""
    waiting = group_inputs(edges, group).join(unfinished.select("node").distinct(), "node", "left_semi").select("group").distinct()
    return group.select("group").distinct().join(waiting, "group", "left_anti")


def finish(edges: DataFrame, finished: DataFrame, now: DataFrame) -> DataFrame:
    """Jobs that become ready when `now` is finished beside what was: all they wait for is done, and one of it only now."""
    done = finished.select("node").unionByName(now.select("node")).distinct()
    touched = edges.join(now.select(F.col("node").alias("src")).distinct(), "src", "left_semi").select("dst").distinct()
    open_ = edges.join(touched, "dst", "left_semi").join(done.withColumnRenamed("node", "src"), "src", "left_anti").select("dst").distinct()
    return touched.join(open_, "dst", "left_anti").select(F.col("dst").alias("node")).join(done, "node", "left_anti")


def delete_jobs(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """All nodes that go with `gone` (node): upstream ones whose dependents are all gone, again and again. A round for each level."""
    gone = frontier = stored(gone.select("node").distinct())
    while True:
        touched = meet(edges, frontier.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src").distinct()
        kept = meet(meet(edges, touched, "src", "left_semi"), gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src").distinct()
        frontier = stored(meet(meet(touched, kept, "src", "left_anti").select(F.col("src").alias("node")), gone, "node", "left_anti"))
        if frontier.isEmpty():
            return gone
        gone = stored(gone.unionByName(frontier))


def constrain(value: Column, most: Column) -> Column:
    """At most the general value, where there is one."""
    return F.when(most.isNull(), value).otherwise(F.least(value, most))


def expand_resources(jobs: DataFrame, rules: DataFrame, most: dict[str, int], override: DataFrame | None = None) -> DataFrame:
    """jobs (job, rule, attempt, input_mb) with mem_mb, mem_mib and runtime. rules: rule, mem_base, mem_per_input, runtime.

    Memory is (base + per input megabyte) times the attempt; an override (rule, mem_mb) goes before it; `most` bounds each resource.
    """
    met = jobs.join(rules, "rule", "left")
    mem = F.ceil((F.coalesce("mem_base", F.lit(1000)) + F.coalesce("mem_per_input", F.lit(0)) * F.col("input_mb")) * F.col("attempt"))
    if override is not None:
        met = met.join(override.select("rule", F.col("mem_mb").alias("__own")), "rule", "left")
        mem = F.coalesce("__own", mem)
    bound = lambda c, k: F.least(c, F.lit(most[k])) if k in most else c
    mem = bound(mem, "mem_mb").cast("long")
    return met.select("job", mem.alias("mem_mb"), F.ceil(mem * 1_000_000 / 1_048_576.0).cast("long").alias("mem_mib"), bound(F.coalesce("runtime", F.lit(60)), "runtime").cast("long").alias("runtime"))


def scoped(resources: Column, scopes: dict[str, str], scope: str) -> Column:
    """The resources of a scope (global unless said otherwise); excluded ones are in none."""
    known = F.create_map(*(F.lit(x) for kv in (scopes or {"": ""}).items() for x in kv))
    return F.map_filter(resources, lambda k, _: F.coalesce(F.element_at(known, k), F.lit("global")) == scope)


def string_resource(rows: DataFrame, by: str, column: str) -> DataFrame:
    """Per `by` the one text that all jobs name; an error if they differ."""
    found = rows.groupBy(by).agg(F.countDistinct(column).alias("__n"), F.max(column).alias("__v"))
    return found.select(by, F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("values differ: "), F.col(by).cast("string")))).otherwise(F.col("__v")).alias(column))


def available(total: dict[str, int], running: DataFrame) -> DataFrame:
    """resource, free: what is left beside running jobs (one column for each resource)."""
    sums = running.agg(*(F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in total)).first()
    return running.sparkSession.createDataFrame([(k, int(v - sums[k])) for k, v in total.items()], "resource string, free long")


def provenance(edges: DataFrame, own: DataFrame) -> DataFrame:
    """(node, hash): sha256 of a job's own text and its predecessors' hashes in order, so it covers all ancestors. own: node, text.

    A round for each level; a round reads the hashes of the one before it and those found earlier only of the nodes it needs.
    """
    waits = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("waits"))
    left = stored(meet(own, waits, "node", "left").select("node", "text", F.coalesce("waits", F.lit(0)).alias("waits")))
    last = stored(left.where("waits = 0").select("node", F.sha2("text", 256).alias("hash")))
    open_ = stored(edges)
    done, size, came = Rounds(last), last.count(), None
    while size:
        new = open_.join(few(last.withColumnRenamed("node", "src"), size), "src").select(F.col("dst").alias("node"), "hash")
        came = stored(new if came is None else came.unionByName(new))
        full = came.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_list("hash")), "").alias("before"))
        last = stored(left.join(few(full, came.count()), "node").where("n = waits").select("node", F.sha2(F.concat("text", "before"), 256).alias("hash")))
        if size := last.count():
            came = stored(meet(came, last, "node", "left_anti"))
            done.add(last)
    return done.all()


def fetch(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """wanted (node, hash) with the path of the cached output of that hash, null where there is none."""
    return meet(wanted, cache.groupBy("hash").agg(F.min("path").alias("cached")), "hash", "left").select("node", "hash", "cached")


def inherit(rules: DataFrame, over: DataFrame, exclude: list[str] | None = None, rename: str = "{}", prefix: str = "") -> DataFrame:
    """Rules of a module as others use them. rules and over: rule, output, threads, params (a map).

    Fields that `over` states replace the module's, params are merged by name; names are changed as `rename` says, outputs
    get the prefix unless they were replaced.
    """
    o = over.select("rule", F.col("output").alias("__output"), F.col("threads").alias("__threads"), F.col("params").alias("__params"))
    met = rules.where(~F.col("rule").isin(exclude or [])).join(o, "rule", "left")
    before, after = rename.split("{}")
    new = F.coalesce("__params", F.create_map().cast("map<string,string>"))
    return met.select(
        F.concat(F.lit(before), "rule", F.lit(after)).alias("rule"), F.coalesce("__output", F.concat(F.lit(prefix), "output")).alias("output"), F.coalesce("__threads", "threads").alias("threads"),
        F.map_concat(F.map_filter("params", lambda k, _: ~F.map_contains_key(new, k)), new).alias("params"),
    )


def consumers(edges: DataFrame, pipes: DataFrame) -> DataFrame:
    """Pipes (node) that don't have exactly one consumer: node, consumers."""
    n = edges.groupBy(F.col("src").alias("node")).agg(F.countDistinct("dst").alias("n"))
    return pipes.join(n, "node", "left").select("node", F.coalesce("n", F.lit(0)).alias("consumers")).where("consumers <> 1")


def stack_hash(*parts: Column) -> Column:
    """md5 of what a job's software is made of; nulls count as empty."""
    return F.md5(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)).cast("binary"))
