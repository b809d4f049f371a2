"""Registered queries, each with DuckDB SQL for the same rows where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rillflow.functions import helpers as H
from rillflow.functions import patterns as P
from rillflow.functions import tables as T
from rillflow.operators import graph as G
from rillflow.operators import planning as L
from rillflow.sources.tables import edges, files, jobs, table
from rillflow.streaming import queue

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


FILES = "(SELECT l_orderkey AS job, 'part/' || l_partkey AS path, CAST(sum(floor(l_extendedprice)) AS BIGINT) AS size, max(l_shipdate) AS mtime, max(l_returnflag = 'R') AS temp FROM lineitem GROUP BY 1, 2)"
JOBS = "(SELECT o_orderkey AS job, o_orderpriority AS rule, CAST(substr(o_orderpriority, 1, 1) AS INT) AS priority, o_orderdate AS start FROM orders)"
EDGES = "(SELECT CAST(floor(p_partkey / 2) AS BIGINT) AS src, p_partkey AS dst FROM part WHERE p_partkey > 1)"


# Patterns


@query("SELECT 'r/' || r_name || '/n/' || n_name || '.txt' AS path FROM region CROSS JOIN nation")
def expand_product(spark, sf):
    return P.expand("r/{r}/n/{n}.txt", {"r": table(spark, sf, "region").select("r_name"), "n": table(spark, sf, "nation").select("n_name")})


@query("SELECT a.v || '-' || b.v AS path FROM (SELECT r_name AS v, row_number() OVER (ORDER BY r_name) AS n FROM region) a JOIN (SELECT n_name AS v, row_number() OVER (ORDER BY n_name) AS n FROM nation) b USING (n)")
def expand_zip(spark, sf):
    return P.expand("{r}-{n}", {"r": table(spark, sf, "region").select("r_name"), "n": table(spark, sf, "nation").select("n_name")}, how="zip")


@query("SELECT r_name || '_{b}.out' AS path FROM region")
def expand_allow_missing(spark, sf):
    return P.expand("{a}_{b}.out", {"a": table(spark, sf, "region").select("r_name")}, allow_missing=True)


@query("SELECT 'stats/' || c_custkey || '.parquet' AS path FROM customer WHERE c_acctbal > 5000")
def collect_lookup(spark, sf):
    return P.expand("stats/{c}.parquet", {"c": H.lookup(table(spark, sf, "customer"), "c_acctbal > 5000", ["c_custkey"])})


@query("SELECT n_name || e AS path FROM nation CROSS JOIN (VALUES ('.bam'), ('.bai'), ('.log')) t(e)")
def multiext(spark, sf):
    return table(spark, sf, "nation").select(P.multiext(F.col("n_name"), ".bam", ".bai", ".log").alias("path"))


@query("SELECT n_name || '.txt' AS path, n_name AS n FROM nation WHERE n_name IN ('FRANCE', 'GERMANY', 'NATION_1', 'NATION_2')")
def limit_alternation(spark, sf):
    paths = table(spark, sf, "nation").select(F.concat("n_name", F.lit(".txt")).alias("p"))
    return P.glob_wildcards(paths, "p", P.limit("{n}.txt", n=["FRANCE", "GERMANY", "NATION_1", "NATION_2"]))


@query(r"SELECT regexp_replace('out/{a,' || r_name || '}/{b, \d+}.txt', '\{\s*(\w+)\s*,[^{}]*\}', '{\1}', 'g') AS pattern FROM region")
def strip_constraints(spark, sf):
    pattern = F.concat(F.lit("out/{a,"), "r_name", F.lit(r"}/{b, \d+}.txt"))
    return table(spark, sf, "region").select(P.strip_constraints(pattern).alias("pattern"))


@query("SELECT r_name || '/{x}/' || r_regionkey AS pattern, r_name || '/' AS prefix, '/' || r_regionkey AS suffix FROM region")
def constant_prefix_suffix(spark, sf):
    pattern = F.concat("r_name", F.lit("/{x}/"), "r_regionkey")
    return table(spark, sf, "region").select(pattern.alias("pattern"), F.regexp_extract(pattern, r"^([^{]*)", 1).alias("prefix"), F.regexp_extract(pattern, r"([^}]*)$", 1).alias("suffix"))


@query(r"SELECT url AS path, regexp_extract(url, '^https://(.+)/en/([0-9]+)$', 1) AS host, regexp_extract(url, '^https://(.+)/en/([0-9]+)$', 2) AS page FROM pages WHERE regexp_matches(url, '^https://(.+)/en/([0-9]+)$')")
def glob_wildcards(spark, sf):
    return P.glob_wildcards(table(spark, sf, "pages"), "url", "https://{host}/en/{page,[0-9]+}")


@query(r"SELECT url AS path, regexp_extract(url, '^(.+)://(.+)/([a-z]+)/([0-9]+)(.*)$', 1) AS scheme, regexp_extract(url, '^(.+)://(.+)/([a-z]+)/([0-9]+)(.*)$', 2) AS host, 'fr' AS lang, regexp_extract(url, '^(.+)://(.+)/([a-z]+)/([0-9]+)(.*)$', 4) AS page, regexp_extract(url, '^(.+)://(.+)/([a-z]+)/([0-9]+)(.*)$', 5) AS rest FROM pages WHERE regexp_extract(url, '^(.+)://(.+)/([a-z]+)/([0-9]+)(.*)$', 3) = 'fr'")
def listfiles_restricted(spark, sf):
    return P.glob_wildcards(table(spark, sf, "pages"), "url", "{scheme}://{host}/{lang,[a-z]+}/{page,[0-9]+}{rest,.*}", {"lang": "fr"})


@query("SELECT DISTINCT url, prefix, v FROM pages JOIN (VALUES ('h', 0), ('http', 1), ('http:', 2), ('https://m.', 3)) k(prefix, v) ON starts_with(url, prefix)")
def prefix_lookup(spark, sf):
    keys = spark.createDataFrame([("h", 0), ("http", 1), ("http:", 2), ("https://m.", 3)], "prefix string, v int")
    return P.prefix_lookup(table(spark, sf, "pages").select("url"), "url", keys).select("url", "prefix", "v")


RULES = {"any": "{scheme}://{rest}", "english": "https://{host}/en/{page}", "number": "https://{host}/{lang,[a-z]+}/{page,[0-9]+}"}
_PRODUCERS = r"""(SELECT url AS path, 'any' AS rule, 0 AS place, CAST(length(url) - 3 AS INT) AS wildcard_length FROM pages WHERE regexp_matches(url, '^(.+)://(.+)$')
UNION ALL SELECT url, 'english', 1, CAST(length(url) - 12 AS INT) FROM pages WHERE regexp_matches(url, '^https://(.+)/en/(.+)$')
UNION ALL SELECT url, 'number', 2, CAST(length(url) - 10 AS INT) FROM pages WHERE regexp_matches(url, '^https://(.+)/([a-z]+)/([0-9]+)$'))"""


@query(f"SELECT path, rule, wildcard_length FROM {_PRODUCERS}")
def match_producers(spark, sf):
    return P.producers(table(spark, sf, "pages").select("url"), "url", RULES).select("path", "rule", "wildcard_length")


@query(f"SELECT path, rule FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY wildcard_length, place) AS n FROM {_PRODUCERS}) WHERE n = 1")
def wildcards_best_match(spark, sf):
    pages = table(spark, sf, "pages").select("url")
    return P.producers(pages, "url", RULES).where("rank = 1").select("path", "rule")


@query(f"SELECT path, count(*) AS producers FROM {_PRODUCERS} GROUP BY path HAVING count(*) > 1")
def ambiguity(spark, sf):
    return P.producers(table(spark, sf, "pages").select("url"), "url", RULES).groupBy("path").agg(F.count(F.lit(1)).alias("producers")).where("producers > 1")


@query("SELECT p_partkey, regexp_matches(right(repeat('ab', p_size) || p_brand, 40), '^(ab){20,}$') OR regexp_matches(repeat('ab', p_size), '(ab){20,}$') AS periodic FROM part")
def periodic_wildcard(spark, sf):
    value = F.expr("repeat('ab', p_size)")
    return table(spark, sf, "part").select("p_partkey", value.rlike(r"(.{1,20}?)\1{19,}$").alias("periodic"))


# Paths, arrays, conditions, units


@query("SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS name FROM pages")
def subpath_basename(spark, sf):
    return table(spark, sf, "pages").select("page_id", H.basename(F.col("url")).alias("name"))


@query("SELECT page_id, array_to_string(string_split(url, '/')[1:len(string_split(url, '/')) - 1], '/') AS parent FROM pages")
def subpath_parent(spark, sf):
    return table(spark, sf, "pages").select("page_id", H.ancestor(F.col("url")).alias("parent"))


@query("SELECT page_id, CASE WHEN len(string_split(url, '/')) <= 4 THEN '.' ELSE array_to_string(string_split(url, '/')[1:len(string_split(url, '/')) - 4], '/') END AS ancestor FROM pages")
def subpath_ancestor(spark, sf):
    return table(spark, sf, "pages").select("page_id", H.ancestor(F.col("url"), 4).alias("ancestor"))


@query("SELECT n_nationkey, n_name AS stripped, n_name || '.bai' AS changed FROM nation")
def subpath_suffix(spark, sf):
    path = F.concat("n_name", F.lit(".bam"))
    return table(spark, sf, "nation").select("n_nationkey", H.strip_suffix(path, ".bam").alias("stripped"), H.with_suffix(path, ".bai").alias("changed"))


@query("SELECT n_regionkey, string_agg('-i ' || n_name, ' ' ORDER BY n_name) AS args FROM nation GROUP BY 1")
def prepend_param(spark, sf):
    return table(spark, sf, "nation").groupBy("n_regionkey").agg(H.prepend("-i", F.sort_array(F.collect_list("n_name"))).alias("args"))


@query("SELECT n_regionkey, string_agg(v, ',' ORDER BY v) AS flat FROM (SELECT n_regionkey, n_name AS v FROM nation UNION ALL SELECT n_regionkey, CAST(n_nationkey AS VARCHAR) FROM nation) GROUP BY 1")
def flatten_nested(spark, sf):
    nested = F.collect_list(F.array(F.col("n_name"), F.col("n_nationkey").cast("string")))
    return table(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.flatten(nested)), ",").alias("flat"))


@query("SELECT event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NULL OR b <> event_type")
def unique_justseen(spark, sf):
    return L.distinct_neighbours(table(spark, sf, "events"), "user_id", ["ts", "event_id"], "event_type").select("event_id", "event_type")


@query("SELECT o_orderkey, CAST(floor((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) / 4) AS BIGINT) AS chunk FROM orders")
def group_into_chunks(spark, sf):
    n = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    return table(spark, sf, "orders").select("o_orderkey", F.floor((n - 1) / 4).alias("chunk"))


@query("SELECT * FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0")
def lookup_rows(spark, sf):
    return H.lookup(table(spark, sf, "customer"), "c_mktsegment = 'BUILDING' AND c_acctbal > 0")


@query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 3")
def lookup_cols(spark, sf):
    return H.lookup(table(spark, sf, "customer"), "c_nationkey = 3", ["c_custkey", "c_name"])


@query("SELECT count(*) FILTER (WHERE n_regionkey = 1) = 5 AS holds FROM nation")
def lookup_is_nrows(spark, sf):
    return H.has_rows(table(spark, sf, "nation"), "n_regionkey = 1", 5)


@query("SELECT -1 AS n_nationkey, 'none' AS n_name")
def lookup_default(spark, sf):
    return H.lookup(table(spark, sf, "nation"), "n_nationkey > 1000", ["n_nationkey", "n_name"], {"n_nationkey": -1, "n_name": "none"})


@query(f"SELECT job, count(c_custkey) AS found FROM (SELECT o_orderkey AS job, o_custkey FROM orders) LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 1000 GROUP BY job")
def lookup_correlated(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer").where("c_acctbal > 1000")
    return o.join(c, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy(F.col("o_orderkey").alias("job")).agg(F.count("c_custkey").alias("found"))


@query("SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS k FROM events")
def lookup_dpath(spark, sf):
    return table(spark, sf, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.k").try_cast("long"), F.lit(-1)).alias("k"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'large' ELSE 'small' END AS kind FROM orders")
def branch_then(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", H.branch(F.col("o_totalprice") > 100000, {True: "large", False: "small"}).alias("kind"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END AS kind FROM orders")
def branch_cases(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", H.branch(F.col("o_orderstatus"), {"F": "done", "O": "open"}, "other").alias("kind"))


@query("SELECT o_orderkey, o_orderkey % 7 + length(o_orderpriority) AS v FROM orders")
def evaluate_expr(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.expr("o_orderkey % 7 + length(o_orderpriority)").alias("v"))


@query("SELECT p_partkey, greatest(1, CAST(ceil(p_size * 1.073741824 * 1000 - 1e-9) AS BIGINT)) AS mb FROM part")
def human_size_mb(spark, sf):
    return table(spark, sf, "part").select("p_partkey", H.human_units(F.concat("p_size", F.lit(" GiB")), H.TO_MB).alias("mb"))


@query("SELECT p_partkey, CAST(p_size * 60 AS BIGINT) AS minutes FROM part")
def human_runtime_min(spark, sf):
    return table(spark, sf, "part").select("p_partkey", H.human_units(F.concat("p_size", F.lit("h")), H.TO_MINUTES).alias("minutes"))


@query("SELECT p_partkey, round(p_size * 1000000 / 1048576.0, 6) AS mib FROM part")
def mb_to_mib(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.round(F.col("p_size") * 1000000 / F.lit(1048576.0), 6).alias("mib"))


@query("SELECT o_orderkey, CASE WHEN d = 0 THEN '' WHEN d = 1 THEN '1 day, ' ELSE d || ' days, ' END || (s % 86400 // 3600) || ':' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS span FROM (SELECT o_orderkey, o_orderkey * 37 AS s, o_orderkey * 37 // 86400 AS d FROM orders)")
def timedelta_str(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", H.clock(F.col("o_orderkey") * 37).alias("span"))


@query(f"SELECT job, least(greatest(round(2 * sum(size) / 1024, 3), 1000.0), 8000.0) AS mem FROM {FILES} GROUP BY job")
def default_mem(spark, sf):
    sums = files(spark, sf).groupBy("job").agg(F.sum("size").alias("s"))
    return sums.select("job", F.least(F.greatest(F.round(2 * F.col("s") / 1024, 3), F.lit(1000.0)), F.lit(8000.0)).alias("mem"))


@query("SELECT k, coalesce(b, a) AS v FROM (VALUES ('x', 1), ('y', 2)) l(k, a) FULL JOIN (VALUES ('y', 5), ('z', 6)) r(k, b) USING (k)")
def config_merge(spark, sf):
    return spark.createDataFrame(sorted(H.merge_config({"x": 1, "y": 2}, {"y": 5, "z": 6}).items()), "k string, v int")


# Parameter tables and validation


def _params(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size"), F.regexp_replace("p_brand", "[^A-Za-z0-9]", "-").alias("brand"))


@query("SELECT 'id~' || p_partkey || '/size~' || p_size || '/brand~' || regexp_replace(p_brand, '[^A-Za-z0-9]', '-', 'g') AS path FROM part")
def paramspace_encode(spark, sf):
    return T.Paramspace(_params(spark, sf)).instances()


@query("SELECT 'id~' || p_partkey || '/brand~' || regexp_replace(p_brand, '[^A-Za-z0-9]', '-', 'g') || '_size~' || p_size AS path FROM part")
def paramspace_filename(spark, sf):
    return T.Paramspace(_params(spark, sf), ("brand", "size")).instances()


@query("SELECT p_partkey AS id, p_size AS size, regexp_replace(p_brand, '[^A-Za-z0-9]', '-', 'g') AS brand FROM part")
def paramspace_decode(spark, sf):
    space = T.Paramspace(_params(spark, sf))
    return space.decode(space.instances())


SCHEMA = {"required": ["c_name"], "properties": {"c_mktsegment": {"enum": ["BUILDING", "MACHINERY"]}, "c_acctbal": {"minimum": 0, "maximum": 9000}, "c_name": {"pattern": "[02468]$"}}}


@query("""SELECT c_custkey, problem FROM (SELECT c_custkey, unnest(list_filter([CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN 'c_mktsegment: enum' END, CASE WHEN c_acctbal < 0 THEN 'c_acctbal: minimum' END,
CASE WHEN c_acctbal > 9000 THEN 'c_acctbal: maximum' END, CASE WHEN NOT regexp_matches(c_name, '[02468]$') THEN 'c_name: pattern' END, CASE WHEN c_name IS NULL THEN 'c_name: required' END], lambda x: x IS NOT NULL)) AS problem FROM customer)""")
def validate_violations(spark, sf):
    return T.violations(table(spark, sf, "customer"), SCHEMA, "c_custkey")


@query("SELECT event_id, coalesce(nullif(event_type, 'error'), 'view') AS event_type, 0 AS retries FROM events")
def validate_defaults(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.nullif("event_type", F.lit("error")).alias("event_type"))
    return T.with_defaults(rows, {"properties": {"event_type": {"default": "view"}, "retries": {"default": 0}}})


# Joins over files and jobs


@query(f"SELECT job AS dst, src, path FROM (SELECT path, job, mtime, arg_max(job, (mtime, job)) FILTER (WHERE temp) OVER (PARTITION BY path ORDER BY mtime RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING) AS src FROM {FILES}) WHERE src IS NOT NULL")
def edges_from_io(spark, sf):
    """Every job's edge to the producer of each file that it takes: the last job that had written the path before."""
    return L.last_producer(files(spark, sf), "path", "mtime", "job", "temp").select(F.col("job").alias("dst"), "src", "path")


@query(f"SELECT DISTINCT a.job AS dst, b.job AS src, a.path FROM {FILES} a JOIN {FILES} b ON a.path = b.path AND b.mtime < a.mtime AND b.temp")
def edges_from_io_all(spark, sf):
    """All producers that came before, as many as there are: the result itself is producers times consumers of a path."""
    return io_edges(files(spark, sf))


def io_edges(f):
    """f: a row for each job and path at most, so that no edge comes twice."""
    made = f.where("temp").select(F.col("job").alias("src"), "path", F.col("mtime").alias("made"))
    return f.join(made, "path").where("made < mtime").select(F.col("job").alias("dst"), "src", "path")


@query("SELECT o_orderkey AS job FROM orders ANTI JOIN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'N') l ON l_orderkey = o_orderkey")
def missing_output(spark, sf):
    done = table(spark, sf, "lineitem").where("l_returnflag = 'N'")
    return table(spark, sf, "orders").join(done, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select(F.col("o_orderkey").alias("job"))


@query("SELECT 'part/' || p_partkey AS path FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)")
def untracked(spark, sf):
    used = table(spark, sf, "lineitem").where("l_returnflag = 'R' AND l_quantity > 45").select(F.concat(F.lit("part/"), "l_partkey").alias("path"))
    return table(spark, sf, "part").select(F.concat(F.lit("part/"), "p_partkey").alias("path")).join(used, "path", "left_anti")


@query(f"SELECT DISTINCT src FROM {EDGES} WHERE src NOT IN (SELECT dst FROM {EDGES})")
def external_input(spark, sf):
    e = edges(spark, sf)
    return e.select("src").distinct().join(e.select(F.col("dst").alias("src")), "src", "left_anti")


# Graphs


@query(f"WITH RECURSIVE r(node, depth) AS (SELECT CAST(3 AS BIGINT), 0 UNION SELECT e.dst, depth + 1 FROM r JOIN {EDGES} e ON e.src = r.node) SELECT node, depth FROM r")
def dag_bfs(spark, sf):
    return G.closure(edges(spark, sf), spark.createDataFrame([(3,)], "node long"))


@query(f"WITH RECURSIVE r(node, level) AS (SELECT CAST(1 AS BIGINT), 0 UNION SELECT e.dst, level + 1 FROM r JOIN {EDGES} e ON e.src = r.node) SELECT node, max(level) AS level FROM r GROUP BY node")
def dag_levels(spark, sf):
    return G.levels(edges(spark, sf))


@query(f"WITH RECURSIVE r(node) AS (SELECT CAST(100 AS BIGINT) UNION SELECT e.src FROM r JOIN {EDGES} e ON e.dst = r.node) SELECT node FROM r")
def dag_until(spark, sf):
    return G.closure(G.reverse(edges(spark, sf)), spark.createDataFrame([(100,)], "node long")).select("node")


@query(f"WITH RECURSIVE r(node) AS (SELECT CAST(5 AS BIGINT) UNION SELECT e.dst FROM r JOIN {EDGES} e ON e.src = r.node) SELECT p_partkey AS node FROM part WHERE p_partkey NOT IN (SELECT node FROM r)")
def dag_omit_from(spark, sf):
    gone = G.closure(edges(spark, sf), spark.createDataFrame([(5,)], "node long"))
    return G.meet(table(spark, sf, "part").select(F.col("p_partkey").alias("node")), gone, "node", "left_anti")


@query(f"WITH RECURSIVE r(node) AS (SELECT p_partkey FROM part WHERE p_size = 50 UNION SELECT e.src FROM r JOIN {EDGES} e ON e.dst = r.node) SELECT p_partkey AS node, CASE WHEN p_partkey IN (SELECT node FROM r) THEN 1000 ELSE p_size END AS priority FROM part")
def priority_closure(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("node"), "p_size")
    high = G.closure(G.reverse(edges(spark, sf)), p.where("p_size = 50").select("node")).select("node", F.lit(1000).alias("high"))
    return G.meet(p, high, "node", "left").select("node", F.coalesce("high", "p_size").alias("priority"))


@query(f"WITH RECURSIVE e AS (SELECT src, dst FROM {EDGES}), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), r(node, other) AS (SELECT src, src FROM b UNION SELECT r.node, b.dst FROM r JOIN b ON b.src = r.other) SELECT node, min(other) AS component FROM r GROUP BY node")
def components(spark, sf):
    return G.components(edges(spark, sf))


@query()
def components_all(spark, sf):
    """All edges. No SQL: its all-pairs recursion is too large on the whole graph; a test holds the operator to brute force."""
    return G.components(edges(spark, sf))


_OWN = "p_size = 7"


@query(f"""WITH RECURSIVE own AS (SELECT p_partkey AS node FROM part WHERE {_OWN}), d(node) AS (SELECT e.dst FROM own JOIN {EDGES} e ON e.src = own.node UNION SELECT e.dst FROM d JOIN {EDGES} e ON e.src = d.node),
r(node) AS (SELECT node FROM own WHERE node NOT IN (SELECT node FROM d) UNION SELECT e.dst FROM r JOIN {EDGES} e ON e.src = r.node WHERE e.dst % 5 <> 0) SELECT node FROM r""")
def needrun_closure(spark, sf):
    own = table(spark, sf, "part").where(_OWN).select(F.col("p_partkey").alias("node"))
    return G.needs_run(edges(spark, sf).withColumn("ancient", F.col("dst") % 5 == 0), own)


@query(f"SELECT dst AS node, count(*) AS waiting FROM {EDGES} JOIN part ON p_partkey = src WHERE p_size < 25 GROUP BY dst")
def n_until_ready(spark, sf):
    open_ = table(spark, sf, "part").where("p_size < 25").select(F.col("p_partkey").alias("src"))
    return edges(spark, sf).join(open_, "src").groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("waiting"))


@query(f"SELECT p_partkey AS node FROM part WHERE p_partkey NOT IN (SELECT dst FROM {EDGES} JOIN part ON p_partkey = src WHERE p_size < 25)")
def ready_jobs(spark, sf):
    p = table(spark, sf, "part")
    open_ = p.where("p_size < 25").select(F.col("p_partkey").alias("src"))
    waiting = edges(spark, sf).join(open_, "src").select(F.col("dst").alias("node"))
    return p.select(F.col("p_partkey").alias("node")).join(waiting, "node", "left_anti")


@query(f"SELECT DISTINCT a.p_brand AS src_rule, b.p_brand AS dst_rule FROM {EDGES} e JOIN part a ON a.p_partkey = e.src JOIN part b ON b.p_partkey = e.dst")
def rule_graph(spark, sf):
    p = table(spark, sf, "part")
    a = p.select(F.col("p_partkey").alias("src"), F.col("p_brand").alias("src_rule"))
    b = p.select(F.col("p_partkey").alias("dst"), F.col("p_brand").alias("dst_rule"))
    return edges(spark, sf).join(a, "src").join(b, "dst").select("src_rule", "dst_rule").distinct()


@query(f"SELECT '{{\"u\":' || src || ',\"v\":' || dst || '}}' AS edge FROM {EDGES}")
def d3_edges(spark, sf):
    return edges(spark, sf).select(F.to_json(F.struct(F.col("src").alias("u"), F.col("dst").alias("v"))).alias("edge"))


@query(f"SELECT e.dst AS node FROM {EDGES} e JOIN part a ON a.p_partkey = e.src JOIN part b ON b.p_partkey = e.dst WHERE a.p_brand <> b.p_brand")
def new_wildcards(spark, sf):
    p = table(spark, sf, "part")
    a, b = p.select(F.col("p_partkey").alias("src"), F.col("p_brand").alias("x")), p.select(F.col("p_partkey").alias("dst"), F.col("p_brand").alias("y"))
    return edges(spark, sf).join(a, "src").join(b, "dst").where("x <> y").select(F.col("dst").alias("node"))


# Ranking, windows, resources


@query("SELECT c_name AS item, ntile(7) OVER (ORDER BY c_name) AS batch FROM (SELECT DISTINCT c_name FROM customer)")
def batch_ntile(spark, sf):
    return L.batch(table(spark, sf, "customer"), "c_name", 7)


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS n FROM orders) WHERE n = 1")
def ruleorder_rank(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderpriority", "o_orderkey")).alias("o_orderkey"))


@query(f"SELECT path, count(DISTINCT job) AS jobs FROM {FILES} GROUP BY path HAVING count(DISTINCT job) > 1")
def duplicate_output(spark, sf):
    return files(spark, sf).groupBy("path").agg(F.countDistinct("job").alias("jobs")).where("jobs > 1")


@query("SELECT event_id, 5 - count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts) RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS free FROM events")
def rate_limiter(spark, sf):
    return L.rate_free(table(spark, sf, "events"), "ts", 3600, 5, "user_id").select("event_id", "free")


@query(f"SELECT job, path, CAST(sum(size) OVER (PARTITION BY job ORDER BY path ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM {FILES}")
def running_total_resources(spark, sf):
    run = W.partitionBy("job").orderBy("path").rowsBetween(W.unboundedPreceding, 0)
    return files(spark, sf).select("job", "path", F.sum("size").over(run).alias("running"))


@query(f"SELECT rule, job, row_number() OVER (PARTITION BY rule ORDER BY priority DESC, temp_size DESC, size DESC, job) AS place FROM {JOBS} j JOIN (SELECT job, CAST(sum(CASE WHEN temp THEN size ELSE 0 END) AS BIGINT) AS temp_size, CAST(sum(size) AS BIGINT) AS size FROM {FILES} GROUP BY job) s USING (job)")
def greedy_priority_order(spark, sf):
    sizes = files(spark, sf).groupBy("job").agg(F.sum(F.when(F.col("temp"), F.col("size")).otherwise(0)).alias("temp_size"), F.sum("size").alias("size"))
    order = [F.desc("priority"), F.desc("temp_size"), F.desc("size"), F.col("job")]
    return L.numbered(jobs(spark, sf).join(sizes, "job"), ["rule"], order, "place").select("rule", "job", "place")


@query("SELECT o_custkey AS grp, CAST(sum(runtime) AS BIGINT) AS runtime, CAST(max(mem) AS BIGINT) AS mem FROM (SELECT o_custkey, level, sum(runtime) AS runtime, max(mem) AS mem FROM (SELECT o_custkey, o_orderstatus AS level, o_orderpriority AS layer, max(o_orderkey % 100) AS runtime, sum(o_orderkey % 64) AS mem FROM orders GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY 1")
def group_resources_merge(spark, sf):
    o = table(spark, sf, "orders")
    rows = o.select(F.col("o_custkey").alias("group"), F.col("o_orderstatus").alias("level"), F.col("o_orderpriority").alias("layer"), (F.col("o_orderkey") % 100).alias("runtime"), (F.col("o_orderkey") % 64).alias("mem"))
    return L.merge_resources(rows).select(F.col("group").alias("grp"), "runtime", "mem")


@query("""WITH RECURSIVE j AS (SELECT o_custkey AS grp, o_orderkey AS job, o_orderkey % 64 + 1 AS mem, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 64 + 1 DESC, o_orderkey % 100 DESC, o_orderkey) AS n FROM orders),
r(grp, n, free, job, layer) AS (SELECT DISTINCT grp, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM j
UNION ALL SELECT grp, n, CASE WHEN place IS NULL THEN list_append(free, 128 - mem) ELSE list_concat(free[1:place - 1], [free[place] - mem], free[place + 1:]) END, job, coalesce(place, len(free) + 1) - 1
FROM (SELECT r.grp, j.n, r.free, j.job, j.mem, nullif(list_position(list_transform(r.free, lambda x: x >= j.mem), true), 0) AS place FROM r JOIN j ON j.grp = r.grp AND j.n = r.n + 1))
SELECT grp AS "group", job, layer FROM r WHERE n > 0""")
def group_layers_firstfit(spark, sf):
    o = table(spark, sf, "orders")
    return L.first_fit(o.select(F.col("o_custkey").alias("group"), F.col("o_orderkey").alias("job"), (F.col("o_orderkey") % 64 + 1).alias("mem"), (F.col("o_orderkey") % 100).alias("runtime")), 128)


# Change detection, provenance, reports


@query(f"SELECT f.job, f.path FROM {FILES} f JOIN {JOBS} j USING (job) WHERE f.mtime > j.start AND NOT f.temp")
def updated_input(spark, sf):
    return files(spark, sf).join(jobs(spark, sf), "job").where("mtime > start AND NOT temp").select("job", "path")


@query("SELECT o_orderkey AS job, o_orderkey % 7 >= 3 AND o_orderpriority <> o_orderstatus || '-x' AND o_orderkey % 5 = 0 AS code, o_orderkey % 7 >= 5 AND o_orderkey % 3 = 1 AS software FROM orders")
def value_changes(spark, sf):
    k, version = F.col("o_orderkey"), F.col("o_orderkey") % 7
    code = L.value_changed(F.lit("a"), F.when(k % 5 == 0, F.lit("b")).otherwise(F.lit("a")), version, 3)
    software = L.value_changed(k % 3, F.when(k % 3 == 1, F.lit(0)).otherwise(k % 3), version, 5)
    return table(spark, sf, "orders").select(k.alias("job"), code.alias("code"), software.alias("software"))


@query(f"SELECT o_custkey, list_sort(list(o_orderpriority)) <> list_sort(list(DISTINCT o_orderpriority)) AS inputs, false AS params FROM orders GROUP BY 1")
def set_changes(spark, sf):
    g = table(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderpriority").alias("now"), F.collect_set("o_orderpriority").alias("then"))
    return g.select("o_custkey", L.input_changed(F.col("now"), F.col("then")).alias("inputs"), L.params_changed(F.col("now"), F.col("then")).alias("params"))


@query("SELECT o_orderkey AS job, CASE WHEN o_orderkey % 11 = 0 THEN 'missing' WHEN o_orderkey % 7 = 0 THEN 'updated input files' WHEN o_orderkey % 5 = 0 THEN 'code has changed' WHEN o_orderkey % 3 = 0 THEN 'set of input files has changed' WHEN o_orderkey % 2 = 0 THEN 'params have changed' ELSE 'ok' END AS status FROM orders")
def summary_status(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(k.alias("job"), L.summary_status(*(k % n == 0 for n in (11, 7, 5, 3, 2))).alias("status"))


@query(f"SELECT coalesce(rule, 'total') AS rule, count(*) AS n FROM {JOBS} GROUP BY ROLLUP (rule)")
def job_stats_total(spark, sf):
    return jobs(spark, sf).rollup("rule").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("rule", F.lit("total")).alias("rule"), "n")


@query("SELECT o_orderstatus AS reason, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS rules FROM orders GROUP BY 1")
def reasons_by_rule(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("reason")).agg(L.shown_rules("o_orderpriority").alias("rules"))


@query(f"SELECT job, min(mtime) AS started, max(mtime) AS ended, string_agg(path, ',' ORDER BY path) AS outputs FROM {FILES} GROUP BY job")
def report_job_records(spark, sf):
    return files(spark, sf).groupBy("job").agg(F.min("mtime").alias("started"), F.max("mtime").alias("ended"), F.array_join(F.sort_array(F.collect_list("path")), ",").alias("outputs"))


@query(f"SELECT rule, count(*) AS n_jobs, min(job) AS first_job FROM {JOBS} GROUP BY rule")
def report_rule_records(spark, sf):
    return jobs(spark, sf).groupBy("rule").agg(F.count(F.lit(1)).alias("n_jobs"), F.min("job").alias("first_job"))


@query(f"SELECT rule, job, epoch(max(mtime)) - epoch(start) AS runtime FROM {JOBS} JOIN {FILES} USING (job) GROUP BY rule, job, start")
def report_runtimes(spark, sf):
    ends = files(spark, sf).groupBy("job").agg(F.max("mtime").alias("end"))
    sec = lambda c: F.col(c).cast("timestamp").cast("double")
    return jobs(spark, sf).join(ends, "job").select("rule", "job", (sec("end") - sec("start")).alias("runtime"))


@query(f"SELECT rule, job, start, max(mtime) AS ended FROM {JOBS} JOIN {FILES} USING (job) GROUP BY rule, job, start")
def report_timeline(spark, sf):
    ends = files(spark, sf).groupBy("job").agg(F.max("mtime").alias("ended"))
    return jobs(spark, sf).join(ends, "job").select("rule", "job", "start", "ended")


@query("SELECT lang AS category, source AS subcategory, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1, 2")
def report_categories(spark, sf):
    return table(spark, sf, "documents").groupBy(F.col("lang").alias("category"), F.col("source").alias("subcategory")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))


@query(f"SELECT job, CAST(sum(size) AS BIGINT) AS size, round(sum(size) / 1024, 6) AS size_kb, CAST(sum(CASE WHEN temp THEN size ELSE 0 END) AS BIGINT) AS temp_size_bytes FROM {FILES} GROUP BY job")
def input_sizes(spark, sf):
    s = files(spark, sf).groupBy("job").agg(F.sum("size").alias("size"), F.sum(F.when(F.col("temp"), F.col("size")).otherwise(0)).alias("temp_size_bytes"))
    return s.select("job", "size", F.round(F.col("size") / 1024, 6).alias("size_kb"), "temp_size_bytes")


@query(f"SELECT job, min(mtime) AS oldest FROM {FILES} GROUP BY job")
def output_mintime(spark, sf):
    return files(spark, sf).groupBy("job").agg(F.min("mtime").alias("oldest"))


@query("SELECT user_id, max(floor(value)) AS max_rss, round(sum(floor(value)) / count(*), 6) AS mean_load FROM events GROUP BY 1")
def benchmark_mean_load(spark, sf):
    v = F.floor("value").cast("double")
    return table(spark, sf, "events").groupBy("user_id").agg(F.max(v).alias("max_rss"), F.round(F.sum(v) / F.count(F.lit(1)), 6).alias("mean_load"))


@query(f"SELECT DISTINCT path FROM {FILES} f WHERE temp AND NOT EXISTS (SELECT 1 FROM {FILES} g WHERE g.path = f.path AND NOT g.temp)")
def temp_unneeded(spark, sf):
    f = files(spark, sf)
    return f.where("temp").select("path").distinct().join(f.where("NOT temp"), "path", "left_anti")


@query("SELECT doc_id, CASE WHEN strlen(text) <= 1000000 THEN 'sha256:' || sha256(text) END AS checksum FROM documents")
def checksum_sha256(spark, sf):
    return table(spark, sf, "documents").select("doc_id", H.checksum(F.col("text")).alias("checksum"))


@query("SELECT a.doc_id, count(*) - 1 AS same FROM documents a JOIN (SELECT sha256(text) AS h FROM documents) b ON sha256(a.text) = b.h GROUP BY 1")
def checksum_same(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return d.join(d.groupBy("h").agg((F.count(F.lit(1)) - 1).alias("same")), "h").select("doc_id", "same")


@query("SELECT doc_id FROM documents WHERE text IS NULL OR strlen(trim(text)) < 200")
def ensure_nonempty(spark, sf):
    return table(spark, sf, "documents").where(F.col("text").isNull() | (F.octet_length(F.trim("text")) < 200)).select("doc_id")


@query(f"SELECT o.o_orderkey AS job, sha256(o_orderpriority || coalesce(h, '')) AS hash FROM orders o LEFT JOIN (SELECT job, string_agg(sha256(path), '' ORDER BY sha256(path)) AS h FROM {FILES} GROUP BY job) f ON f.job = o.o_orderkey")
def provenance_merkle(spark, sf):
    h = files(spark, sf).groupBy("job").agg(F.array_join(F.sort_array(F.collect_list(F.sha2("path", 256))), "").alias("h"))
    return jobs(spark, sf).join(h, "job", "left").select("job", F.sha2(F.concat("rule", F.coalesce("h", F.lit(""))), 256).alias("hash"))


@query("SELECT range || '-of-8' AS item FROM range(1, 9)")
def scatter_names(spark, sf):
    return spark.range(1, 9).select(F.concat("id", F.lit("-of-8")).alias("item"))


@query("SELECT o_orderpriority, count(*) AS n, CAST(sum(floor(o_totalprice)) AS BIGINT) AS total FROM orders GROUP BY 1")
def scatter_gather_roundtrip(spark, sf):
    o = table(spark, sf, "orders").withColumn("part", F.pmod(F.xxhash64("o_orderkey"), F.lit(4)))
    parts = o.groupBy("part", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor("o_totalprice")).alias("total"))
    return parts.groupBy("o_orderpriority").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


@query("SELECT n_nationkey AS job, unnest(range(1, n_nationkey % 3 + 2)) AS attempt FROM nation")
def retry_attempts(spark, sf):
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("job"), F.explode(F.sequence(F.lit(1).cast("long"), (F.col("n_nationkey") % 3 + 1).cast("long"))).alias("attempt"))


@query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderpriority IN (SELECT o_orderpriority FROM orders GROUP BY 1 HAVING count(*) > (SELECT count(*) / 5.0 FROM orders)) GROUP BY 1")
def checkpoint_two_phase(spark, sf):
    o = table(spark, sf, "orders")
    counts = G.stored(o.groupBy("o_orderpriority").count())  # the first phase; what follows depends on its content
    least = counts.agg(F.sum("count") / 5.0).first()[0]
    return counts.where(F.col("count") > least).select("o_orderpriority", F.col("count").alias("n"))


@query("SELECT event_id, event_type FROM events")
def queue_accumulate(spark, sf):
    return queue.accumulate(spark, sf, "event_id", pattern="events.parquet").select("event_id", "event_type")


from rillflow.plans import jobs as _jobs  # noqa: E402, F401  registers its queries
