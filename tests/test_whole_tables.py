"""Queries over whole tables against brute force, where SQL is too slow or hides a part of the table."""

import random

from rillflow.functions import patterns
from rillflow.operators import graph, planning
from rillflow.plans.queries import QUERIES


def united(edges: list) -> dict:
    """node -> the smallest node that it is connected with."""
    label = {n: n for e in edges for n in e}
    while True:
        new = dict(label)
        for a, b in edges:
            new[a] = new[b] = min(new[a], new[b])
        if new == label:
            return label
        label = new


def test_components_equal_brute_force(spark):
    r = random.Random(4)
    edges = [(r.randrange(k * 100, k * 100 + 40), r.randrange(k * 100, k * 100 + 40)) for k in range(5) for _ in range(30)] + [(900 + i, 901 + i) for i in range(30)] + [(7, 7)]
    got = {x.node: x.component for x in graph.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == united(edges) and len(set(got.values())) > 5


def test_components_all_takes_every_edge(spark, tmp_path):
    spark.createDataFrame([(k,) for k in (2, 3, 5, 6, 9, 40, 80, 81)], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    got = {x.node: x.component for x in QUERIES["components_all"](spark, str(tmp_path)).collect()}
    assert got == united([(k // 2, k) for k in (2, 3, 5, 6, 9, 40, 80, 81)])


def test_first_fit_equals_brute_force(spark):
    r = random.Random(2)
    rows = [(r.choice([1, 1, 2, 3]), j, r.choice([1, 5, 9, 30, 64, 100, 140]), r.randrange(3)) for j in range(500)]
    want = {}
    for g in {x[0] for x in rows}:
        free: list = []
        for _, job, mem, _ in sorted((x for x in rows if x[0] == g), key=lambda x: (-x[2], -x[3], x[1])):
            at = next((k for k, left in enumerate(free) if left >= mem), len(free))
            free += [128] * (at == len(free))
            free[at] -= mem
            want[g, job] = at
    got = planning.first_fit(spark.createDataFrame(rows, "group long, job long, mem long, runtime long"), 128).collect()
    assert {(x.group, x.job): x.layer for x in got} == want and len(got) == len(rows)
    assert len(planning.fit_counts([(30, 10**9), (5, 10**9)], 128)) < 5  # by runs of layers, not by jobs


def test_zip_sorts_no_table_in_one_task(spark):
    out = patterns.expand("{a}-{b}", {"a": spark.range(300).selectExpr("id % 7 AS a"), "b": spark.range(500).selectExpr("id AS b")}, how="zip")
    assert "SinglePartition" not in out._jdf.queryExecution().toString()
    want = [f"{a}-{b}" for a, b in zip(sorted(i % 7 for i in range(300)), range(300))]
    assert sorted(x.path for x in out.collect()) == sorted(want)


def test_numbered_counts_only_what_goes_on_into_another_range(spark, monkeypatch):
    kept, keep = [], graph.stored

    def spy(df):
        kept.append(keep(df))
        return kept[-1]

    monkeypatch.setattr(graph, "stored", spy)
    r = random.Random(5)
    rows = [(r.choice([None, 1, 2, *range(10, 200)]), r.randrange(50), j) for j in range(400)] + [(7, 3, 400 + j) for j in range(900)]
    df = spark.createDataFrame(rows, "g long, v long, j long")
    for by in (["g"], []):
        kept.clear()
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several ranges
        try:
            got = planning.numbered(df, by, [df.v.desc(), df.j], "place").collect()
        finally:
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        want, seen = {}, {}
        for g, _, j in sorted(rows, key=lambda x: (-x[1], x[2])):
            key = g if by else 0
            want[j] = seen[key] = seen.get(key, 0) + 1
        assert {x.j: x.place for x in got} == want
        assert 1 <= kept[-1].count() < kept[0].rdd.getNumPartitions()  # offsets


def test_edges_of_files_have_no_shuffle_of_the_edges(spark):
    """Edges are several times the files: they are distinct as they come and are not shuffled again."""
    from rillflow.plans.queries import io_edges

    f = spark.createDataFrame([(1, "a", 1, True), (2, "a", 2, True), (3, "a", 3, False), (3, "b", 1, False), (None, "a", 2, True)], "job long, path string, mtime long, temp boolean")
    out = io_edges(f)
    assert sorted(map(str, out.collect())) == sorted(f"Row(dst={d}, src={s}, path='a')" for d, s in ((2, 1), (3, 1), (3, 2), (None, 1), (3, None)))
    assert "HashAggregate" not in out._jdf.queryExecution().executedPlan().toString()
