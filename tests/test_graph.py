"""Graph and queue operators against brute force on small fixtures."""

import random

import pytest

from rillflow.operators import graph, jobs
from rillflow.streaming import queue


def dag(r, n, m):
    return list({(a, b) for a, b in ((r.randrange(n), r.randrange(n)) for _ in range(m)) if a < b})


def test_levels_and_closure_equal_brute_force(spark):
    r = random.Random(1)
    edges = dag(r, 40, 70) + [(100 + k, 101 + k) for k in range(16)]  # more rounds than stay apart
    df = spark.createDataFrame(edges, "src long, dst long")
    level = {n: 0 for e in edges for n in e}
    for _ in range(60):
        for a, b in edges:
            level[b] = max(level[b], level[a] + 1)
    assert {x.node: x.level for x in graph.levels(df).collect()} == level
    start = edges[0][0]
    depth, frontier = {start: 0, 100: 0}, [start, 100]
    while frontier:
        frontier = [b for a, b in edges if a in frontier and b not in depth]
        depth |= {b: 1 + max(depth.values()) for b in frontier}
    got = {x.node: x.depth for x in graph.closure(df, spark.createDataFrame([(start,), (100,)], "node long")).collect()}
    assert set(got) == set(depth) and got[116] == 16
    with pytest.raises(ValueError):
        graph.levels(spark.createDataFrame(edges + [(116, 108)], "src long, dst long"))


def test_run_reasons_and_needs_run_equal_brute_force(spark):
    r = random.Random(2)
    edges = [(a, b, r.random() < 0.2) for a, b in dag(r, 30, 45)]
    names = ("missing", "needed", "forced", "updated", "code", "inputs", "params")
    rows = [(n, r.random() < 0.3, n > 25, *(r.choice([None, False, False, False, False, True]) if r.random() < 0.2 else False for _ in range(5))) for n in range(30)]
    state = {x[0]: dict(zip(names, x[1:])) for x in rows}
    own = {}
    for n, s in state.items():
        own[n] = next((reason for ok, reason in zip((s["forced"], s["missing"] and s["needed"], s["updated"], s["code"], s["inputs"], s["params"]), graph.REASONS) if ok), None)
    run = {n for n in own if own[n]}
    while True:
        more = {b for a, b, old in edges if a in run and not old} | {a for a, b, _ in edges if b in run and state[a]["missing"]}
        if more <= run:
            break
        run |= more
    want = {n: own[n] or ("missing output" if state[n]["missing"] and any(a == n and b in run for a, b, _ in edges) else "input comes anew") for n in run}
    e = spark.createDataFrame(edges, "src long, dst long, ancient boolean")
    got = {x.node: x.reason for x in graph.run_reasons(e, spark.createDataFrame(rows, "node long, " + ", ".join(f"{c} boolean" for c in names))).collect()}
    assert got == want and len(set(want.values())) > 2

    seeds, gone = {n for n in own if own[n]}, {n for n in own if state[n]["missing"]}
    below: set = set()
    while True:
        more = {b for a, b, _ in edges if a in seeds | below}
        if more <= below:
            break
        below |= more
    run = seeds - below
    while True:
        more = {b for a, b, old in edges if a in run and not old} | {a for a, b, _ in edges if b in run and a in gone}
        if more <= run:
            break
        run |= more
    nodes = lambda x: spark.createDataFrame([(n,) for n in x], "node long")
    assert {x.node for x in graph.needs_run(e, nodes(seeds), nodes(gone)).collect()} == run


def test_delete_and_provenance_equal_brute_force(spark):
    import hashlib

    r = random.Random(3)
    edges = dag(r, 25, 35)
    e = spark.createDataFrame(edges, "src long, dst long")
    gone = {24, 23, 20}
    want = set(gone)
    while True:
        more = {a for a, _ in edges if all(b in want for x, b in edges if x == a)} - want
        more = {a for a in more if any(x == a and b in want for x, b in edges)}
        if not more:
            break
        want |= more
    assert {x.node for x in jobs.delete_jobs(e, spark.createDataFrame([(n,) for n in gone], "node long")).collect()} == want
    sha, known = lambda t: hashlib.sha256(t.encode()).hexdigest(), {}
    for n in range(25):
        known[n] = sha(f"t{n}" + "".join(sorted(known[a] for a, b in edges if b == n)))
    own = spark.createDataFrame([(n, f"t{n}") for n in range(25)], "node long, text string")
    assert {x.node: x.hash for x in jobs.provenance(e, own).collect()} == known


def test_queue_goes_on_and_ends(spark, tmp_path):
    """Several micro-batches, a restart that takes only what is new, and the sentinel from the stored state of an earlier call."""
    folder, home = str(tmp_path / "in"), str(tmp_path / "home")
    add = lambda *keys: spark.createDataFrame([(k,) for k in keys], "key long").coalesce(1).write.mode("append").parquet(folder)
    take = lambda: sorted(x.key for x in queue.accumulate(spark, folder, "key", "key = 99", home=home).collect())
    add(1, 2)
    add(2, 3)
    assert take() == [1, 2, 3] and queue.ended(spark, home) is None
    assert take() == [1, 2, 3]
    add(4, 99)
    assert take() == [1, 2, 3, 4]
    end = queue.ended(spark, home)
    assert end is not None
    add(5)
    assert take() == [1, 2, 3, 4] and queue.ended(spark, home) == end
    assert sorted(x.key for x in queue.accumulate(spark, folder, "key").collect()) == [1, 2, 3, 4, 5, 99]


def test_rounds_send_no_table_through_the_driver(spark, monkeypatch):
    """No round broadcasts more than FEW rows (none here), however small its tables are."""
    plans, keep = [], graph.stored

    def spy(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df)

    monkeypatch.setattr(graph, "stored", spy)
    monkeypatch.setattr(jobs, "stored", spy)
    monkeypatch.setattr(graph, "FEW", -1, raising=False)
    pairs = [(k // 2, k) for k in range(2, 14)]
    e, nodes = spark.createDataFrame(pairs, "src long, dst long"), spark.range(1, 14).withColumnRenamed("id", "node")
    one = nodes.where("node = 1")
    state = nodes.selectExpr("node", "node % 3 = 0 AS missing", "node > 6 AS needed", "node = 2 AS forced", *(f"false AS {c}" for c in ("updated", "code", "inputs", "params")))
    outs = [
        graph.closure(e, one, nodes.where("node = 5")), graph.levels(e), graph.components(e), graph.needs_run(e, one, nodes.where("node = 2")), graph.run_reasons(e, state),
        graph.replan(one, lambda new: e.join(new.withColumnRenamed("node", "src"), "src").selectExpr("dst AS node")), jobs.provenance(e, nodes.selectExpr("node", "'t' AS text")), jobs.delete_jobs(e, nodes.where("node > 11")),
    ]
    assert [x.count() for x in outs] == [10, 13, 13, 13, 12, 13, 13, 3]
    assert len(plans) > 20 and not [p for p in plans if "Broadcast" in p]
