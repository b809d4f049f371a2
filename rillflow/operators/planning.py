"""What jobs do next: change detection, ranking, batches, rates and resources, over tables of jobs and files."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def input_changed(now: Column, then: Column) -> Column:
    """Lists differ as multisets; nothing recorded is no change."""
    return F.coalesce(F.sort_array(now) != F.sort_array(then), F.lit(False))


def params_changed(now: Column, then: Column) -> Column:
    """Either side has something the other lacks, however often."""
    return F.coalesce((F.size(F.array_except(now, then)) > 0) | (F.size(F.array_except(then, now)) > 0), F.lit(False))


def value_changed(now: Column, then: Column, version: Column, since: int) -> Column:
    """Recorded by a version that knows this value, and different."""
    return (version >= since) & then.isNotNull() & ~now.eqNullSafe(then)


def batch(rows: DataFrame, item: str, n: int) -> DataFrame:
    """The batch, 1 to n, of every item in the order of its text: sizes differ by one at most, larger ones first.

    Ranks come from counts over ranges of items, so no task sees more than a range.
    """
    ordered = rows.select(F.col(item).cast("string").alias("item")).distinct()
    split = ordered.repartitionByRange("item").withColumn("__p", F.spark_partition_id())
    from .graph import stored

    split = stored(split)
    sizes = split.groupBy("__p").count()
    before = sizes.select("__p", F.coalesce(F.sum("count").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))  # one row for each partition
    total = sizes.agg(F.sum("count").alias("total"))
    ranked = split.join(F.broadcast(before), "__p").crossJoin(F.broadcast(total)).withColumn("rank", F.row_number().over(W.partitionBy("__p").orderBy("item")) + F.col("__before") - 1)
    small, extra = F.floor(F.col("total") / n), F.pmod("total", F.lit(n))
    edge = extra * (small + 1)
    number = F.when(F.col("rank") < edge, F.floor(F.col("rank") / (small + 1))).otherwise(extra + F.floor((F.col("rank") - edge) / F.greatest(small, F.lit(1))))
    return ranked.select("item", (number + 1).cast("long").alias("batch"))


def rate_free(events: DataFrame, time: str, seconds: int, most: int, by: str) -> DataFrame:
    """How many more may start at each event: most minus those within the trailing span, per `by`."""
    span = W.partitionBy(by).orderBy(F.col(time).cast("timestamp").cast("double")).rangeBetween(-seconds, 0)
    return events.withColumn("free", (F.lit(most) - F.count(F.lit(1)).over(span)).cast("long"))


def merge_resources(rows: DataFrame) -> DataFrame:
    """rows: group, level, layer, runtime, mem. Within a layer the runtime is the longest and memory adds up; across layers of a level, and across levels, runtimes add up and memory is the largest."""
    layer = rows.groupBy("group", "level", "layer").agg(F.max("runtime").alias("runtime"), F.sum("mem").alias("mem"))
    level = layer.groupBy("group", "level").agg(F.sum("runtime").alias("runtime"), F.max("mem").alias("mem"))
    return level.groupBy("group").agg(F.sum("runtime").alias("runtime"), F.max("mem").alias("mem"))


def numbered(rows: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    """rows with their place, from 1, in the order given, within the columns `by` (none: of all rows).

    Rows are dealt out by ranges of (by, order), equal ones too, so no task sees more than a range, however large a group is.
    A group that goes on from one range into the next is the last of the one and the first of the other: only such groups
    are counted, to give their rows in later ranges an offset.
    """
    from .graph import stored

    tied = rows.withColumn("__tie", F.monotonically_increasing_id())
    split = stored(tied.repartitionByRange(*by, *order, "__tie").withColumn("__p", F.spark_partition_id()))
    same = [F.col(c) for c in by]
    at_ends = split
    if by:
        ends = split.groupBy("__p").agg(F.min(F.struct(*same)).alias("a"), F.max(F.struct(*same)).alias("z")).select(F.explode(F.array("a", "z")).alias("k"))
        ends = ends.select(*(F.col("k")[c].alias(f"__{k}") for k, c in enumerate(by))).distinct()  # two for each range at most
        at_ends = split.join(F.broadcast(ends), reduce(and_, (F.col(c).eqNullSafe(F.col(f"__{k}")) for k, c in enumerate(by))), "left_semi")
    sizes = at_ends.groupBy(*by, "__p").count()
    before = F.coalesce(F.sum("count").over(W.partitionBy(*same).orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = stored(sizes.select(*(F.col(c).alias(f"__{k}") for k, c in enumerate(by)), F.col("__p").alias("__q"), before.alias("__before")).where("__before > 0"))  # one row for each range at most
    match = F.col("__p") == F.col("__q")
    for k, c in enumerate(by):
        match = match & F.col(c).eqNullSafe(F.col(f"__{k}"))
    ranked = split.withColumn(name, F.row_number().over(W.partitionBy(*same, "__p").orderBy(*order, "__tie"))).join(F.broadcast(offsets), match, "left")
    return ranked.select(*rows.columns, (F.col(name) + F.coalesce("__before", F.lit(0))).cast("long").alias(name))


def fit_counts(counts: list[tuple[int, int]], room: int) -> list[tuple[int, int, int, int, int]]:
    """counts: (mem, jobs), largest mem first -> (mem, first rank, rank after the last, first layer, jobs in each layer), ranks from 0.

    Jobs of the same mem fill layer after layer, so layers with the same room left are held as one run.
    """
    runs: list[tuple[int, int, int]] = []  # first layer, layers, room left in each
    layers, out = 0, []
    for mem, jobs in counts:
        rank, new = 0, []
        for first, n, left in runs:
            todo = jobs - rank
            each = 0 if left < mem or not todo else left // mem if mem > 0 else todo
            if not each:
                new.append((first, n, left))
                continue
            full = min(n, todo // each)
            some = min(todo - full * each, each) if full < n else 0
            out.append((mem, rank, rank + full * each + some, first, each))
            rank += full * each + some
            new += [x for x in ((first, full, left - each * mem), (first + full, 1 if some else 0, left - some * mem), (first + full + bool(some), n - full - bool(some), left)) if x[1]]
        runs = new
        if (todo := jobs - rank) > 0:
            each = max(1, room // mem) if mem > 0 else todo
            full, some = divmod(todo, each)
            out.append((mem, rank, jobs, layers, each))
            runs += [x for x in ((layers, full, room - each * mem), (layers + full, 1 if some else 0, room - some * mem)) if x[1]]
            layers += full + bool(some)
    return out


def first_fit(rows: DataFrame, room: int) -> DataFrame:
    """rows: group, job, mem, runtime -> layer of each job: largest share first, into the first layer with room.

    Of a group only the counts of its jobs by mem are together, as one row, where they are fitted; jobs find their layer by their rank.
    """

    @F.udf("array<struct<mem:bigint,fit:array<struct<low:bigint,high:bigint,first:bigint,each:bigint>>>>", useArrow=False)
    def fit(mems: list, counts: list) -> list:
        found: dict[int, list] = {}
        for mem, *run in fit_counts(list(zip(mems, counts, strict=True)), room):
            found.setdefault(mem, []).append(tuple(run))
        return list(found.items())

    counts = F.sort_array(F.collect_list(F.struct(F.col("mem").cast("long").alias("mem"), "count")), asc=False).alias("c")
    fitted = rows.groupBy("group", "mem").count().groupBy("group").agg(counts).select("group", F.inline(fit("c.mem", "c.count"))).withColumnRenamed("fit", "__fit")
    ranked = numbered(rows.select("group", "job", "mem", "runtime"), ["group", "mem"], [F.desc("runtime"), F.col("job")], "__rank")
    fitted = fitted.select(F.col("group").alias("__g"), F.col("mem").alias("__m"), "__fit")
    ranked = ranked.join(fitted.hint("merge"), F.col("group").eqNullSafe(F.col("__g")) & (F.col("mem") == F.col("__m"))).withColumn("__rank", F.col("__rank") - 1)
    own = F.filter("__fit", lambda x: (x["low"] <= F.col("__rank")) & (F.col("__rank") < x["high"]))[0]
    return ranked.select("group", "job", (own["first"] + F.floor((F.col("__rank") - own["low"]) / own["each"])).cast("long").alias("layer"))


def summary_status(missing: Column, updated: Column, code: Column, inputs: Column, params: Column) -> Column:
    return F.when(missing, "missing").when(updated, "updated input files").when(code, "code has changed").when(inputs, "set of input files has changed").when(params, "params have changed").otherwise("ok")


def distinct_neighbours(rows: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the one before, in order, per `by`."""
    before = F.lag(value).over(W.partitionBy(by).orderBy(*order))
    return rows.withColumn("__b", before).where(~F.col(value).eqNullSafe(F.col("__b")) | F.col("__b").isNull()).drop("__b")


def shown_rules(rule: str, most: int = 50) -> Column:
    """The sorted, comma-joined set of rules; beyond `most` of them '...' stands for the rest."""
    rules = F.sort_array(F.collect_set(rule))
    return F.array_join(F.when(F.size(rules) > most, F.concat(F.slice(rules, 1, most), F.array(F.lit("...")))).otherwise(rules), ",")


def last_producer(files: DataFrame, path: str, time: str, job: str, makes: str) -> DataFrame:
    """files with `src`, the job that last wrote the path before (of those at one time the largest); rows without one are left out.

    One window for each path. No producer meets every consumer, so the work grows with the files.
    """
    before = W.partitionBy(path).orderBy(F.col(time).cast("timestamp").cast("double")).rangeBetween(W.unboundedPreceding, -1)
    return files.withColumn("src", F.max_by(job, F.when(F.col(makes), F.struct(time, job))).over(before)).where("src IS NOT NULL")
