"""Queries over files, flags and tables of jobs, beside those of the main module, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillflow.functions import files as V
from rillflow.functions import helpers as H
from rillflow.functions import patterns as P
from rillflow.functions import tables as T
from rillflow.operators import graph as G
from rillflow.operators import jobs as J
from rillflow.operators import planning as L
from rillflow.plans.queries import EDGES, FILES, JOBS, query
from rillflow.sources.tables import edges, files, jobs, table
from rillflow.streaming import queue


def _lines(column: str) -> str:
    return f"(length({column}) - length(replace({column}, chr(10), '')) + CASE WHEN {column} <> '' AND NOT ends_with({column}, chr(10)) THEN 1 ELSE 0 END)"


@query(f"SELECT doc_id, CAST({_lines('text')} AS BIGINT) AS lines FROM documents")
def line_count(spark, sf):
    return table(spark, sf, "documents").select("doc_id", V.line_count(F.col("text")).alias("lines"))


@query("SELECT p_partkey, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45) AS \"exists\" FROM part")
def path_exists(spark, sf):
    made = table(spark, sf, "lineitem").where("l_returnflag = 'R' AND l_quantity > 45").select(F.concat(F.lit("part/"), "l_partkey").alias("path"))
    return V.exists(table(spark, sf, "part").select("p_partkey", F.concat(F.lit("part/"), "p_partkey").alias("path")), made).select("p_partkey", "exists")


@query("SELECT doc_id, doc_id % 3 = 0 AS same FROM documents")
def checksum_known(spark, sf):
    """Checksums that are right, of another algorithm, or not there."""
    k = F.col("doc_id") % 3
    known = F.when(k == 0, F.concat(F.lit("sha256:"), F.sha2("text", 256))).when(k == 1, F.concat(F.lit("md5:"), F.md5(F.col("text").cast("binary"))))
    return table(spark, sf, "documents").select("doc_id", H.is_same_checksum(F.col("text"), known).alias("same"))


@query("SELECT event_id, upper(event_type) || ':' || coalesce(json_extract_string(props, '$.k'), '') AS parsed FROM events")
def parse_input(spark, sf):
    lines = table(spark, sf, "events").select("event_id", F.concat_ws("\t", "event_type", "props").alias("line"))
    parser = lambda c: F.concat(F.upper(F.substring_index(c, "\t", 1)), F.lit(":"), F.coalesce(F.get_json_object(F.substring_index(c, "\t", -1), "$.k"), F.lit("")))
    return V.parse_input(lines, "line", parser, "parsed").select("event_id", "parsed")


@query("SELECT doc_id, sha256(text) AS checksum FROM documents WHERE doc_id % 2 = 0")
def extract_checksum(spark, sf):
    """Lines that state './docs/k' for every document, asked for 'docs/k' and for names that only begin alike."""
    d = table(spark, sf, "documents")
    lines = d.select(F.concat(F.sha2("text", 256), F.lit("  ./docs/"), "doc_id").alias("value"))
    wanted = d.where("doc_id % 2 = 0").select("doc_id", F.concat(F.lit("docs/"), "doc_id").alias("path")).unionByName(d.select("doc_id", F.concat(F.lit("docs/x"), "doc_id").alias("path")))
    return V.extract_checksum(lines, wanted).select("doc_id", "checksum")


@query("""SELECT o_orderkey, o_orderstatus <> 'O' AS is_temp, false AS is_pipe,
CASE WHEN o_orderpriority = '1-URGENT' THEN 'sequential' ELSE 'random' END AS access FROM orders""")
def flag_algebra(spark, sf):
    o = table(spark, sf, "orders")
    base = F.when(F.col("o_orderpriority") == "1-URGENT", F.create_map(F.lit("access"), F.lit("sequential"))).otherwise(F.create_map().cast("map<string,string>"))
    flags = V.flag(V.flag(base, "pipe", F.lit("true")), "temp", F.lit("true"))
    flags = V.remove_flag(V.flag(flags, "temp", F.when(F.col("o_orderstatus") == "O", "false").otherwise("true")), "pipe")
    flags = V.default_flags(flags, {"access": "random"})
    return o.select("o_orderkey", flags.alias("f")).select("o_orderkey", V.is_flagged(F.col("f"), "temp").alias("is_temp"), V.is_flagged(F.col("f"), "pipe").alias("is_pipe"), F.col("f")["access"].alias("access"))


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN '../' || n_name ELSE '/data/' || n_regionkey || '/' || n_name END AS path FROM nation")
def simplify_path(spark, sf):
    n = table(spark, sf, "nation")
    return n.select("n_nationkey", V.simplify_path(F.concat(F.lit("/data/"), "n_regionkey", F.lit("/"), "n_name"), "/data/1/logs").alias("path"))


@query("""SELECT n_regionkey, string_agg(CASE WHEN regexp_matches(t, '^[A-Za-z0-9_@%+=:,./-]+$') THEN t ELSE '''' || replace(t, '''', '''"''"''') || '''' END, ' ' ORDER BY t) AS args
FROM (SELECT n_regionkey, n_name || CASE n_nationkey % 3 WHEN 0 THEN '' WHEN 1 THEN ' it''s' ELSE '.txt' END AS t FROM nation) GROUP BY 1""")
def shell_quote(spark, sf):
    n = table(spark, sf, "nation")
    k = F.col("n_nationkey") % 3
    t = F.concat("n_name", F.when(k == 0, "").when(k == 1, " it's").otherwise(".txt"))
    return n.groupBy("n_regionkey").agg(V.format_sequence(F.sort_array(F.collect_list(t)), quote=True).alias("args"))


_SETTING = "CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN CAST(p_size AS VARCHAR) WHEN 2 THEN p_size || '.5' WHEN 3 THEN 'True' ELSE p_brand END"


@query(f"SELECT p_partkey, CASE p_partkey % 5 WHEN 1 THEN 'int' WHEN 2 THEN 'float' WHEN 3 THEN 'bool' WHEN 4 THEN 'str' END AS kind, nullif({_SETTING}, '') AS value FROM part")
def parse_config(spark, sf):
    k = F.col("p_partkey") % 5
    text = F.when(k == 0, "").when(k == 1, F.col("p_size").cast("string")).when(k == 2, F.concat("p_size", F.lit(".5"))).when(k == 3, "True").otherwise(F.col("p_brand"))
    return table(spark, sf, "part").select("p_partkey", V.sniffed(text).alias("s")).select("p_partkey", "s.kind", "s.value")


@query("SELECT p_partkey, p_size * 1000000 / 1048576.0 AS mib, p_size * 1000000 / 1000000.0 AS mb FROM part")
def bytes_to(spark, sf):
    size = F.col("p_size") * 1_000_000
    return table(spark, sf, "part").select("p_partkey", V.bytes_to(size, "m").alias("mib"), V.bytes_to(size, "m", 1000).alias("mb"))


@query("SELECT page_id, split_part(url, '://', 1) AS scheme, substr(url, length(split_part(url, '://', 1)) + 4) AS path FROM pages")
def parse_uri(spark, sf):
    return table(spark, sf, "pages").select("page_id", V.parse_uri(F.col("url")).alias("u")).select("page_id", "u.scheme", "u.path")


@query("SELECT n_nationkey, '/work/out/' || n_name || '/logs' AS path FROM nation")
def pathvars(spark, sf):
    values = V.resolve_pathvars({"base": "/work"}, {"base": "/never", "results": "<base>/out"}, {"kind": "logs"})
    return table(spark, sf, "nation").select("n_nationkey", V.apply_pathvars(F.concat(F.lit("<results>/"), "n_name", F.lit("/<kind>")), values).alias("path"))


@query("SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN '/abs/' || n_name WHEN 1 THEN 'mod/raw/' || n_name ELSE 'mod/other/' || n_name END AS prefixed, CASE n_regionkey WHEN 0 THEN '/abs/' || n_name WHEN 1 THEN 'cooked/' || n_name ELSE 'other/' || n_name END AS replaced FROM nation")
def path_modifier(spark, sf):
    path = F.concat(F.when(F.col("n_regionkey") == 0, "/abs/").when(F.col("n_regionkey") == 1, "raw/").otherwise("other/"), F.col("n_name"))
    return table(spark, sf, "nation").select("n_nationkey", V.modify_path(path, "mod/").alias("prefixed"), V.modify_path(path, replace_prefix={"raw/": "cooked/", "done/": "x/"}).alias("replaced"))


@query("SELECT n_nationkey, 'region,name,region2' AS names, CASE WHEN n_regionkey = 2 THEN '' ELSE 'region2' END AS missing FROM nation")
def check_wildcards(spark, sf):
    pattern = F.lit(r"{region}/{name,[a-z]+}/{region}_{ region2 }.txt")
    values = F.create_map(F.lit("region"), F.lit("a"), F.lit("name"), F.col("n_name"), F.when(F.col("n_regionkey") == 2, "region2").otherwise("else"), F.lit("b"))
    return table(spark, sf, "nation").select("n_nationkey", F.array_join(V.wildcard_names(pattern), ",").alias("names"), F.array_join(V.unresolved(pattern, values), ",").alias("missing"))


@query(r"SELECT url AS path, regexp_extract(url, '^https://(.+)/([a-z]{2})/([0-9]+)$', 1) AS host, regexp_extract(url, '^https://(.+)/([a-z]{2})/([0-9]+)$', 2) AS lang, regexp_extract(url, '^https://(.+)/([a-z]{2})/([0-9]+)$', 3) AS page FROM pages WHERE regexp_matches(url, '^https://(.+)/([a-z]{2})/([0-9]+)$')")
def wildcard_constraints(spark, sf):
    pattern = V.constrain_wildcards("https://{host}/{lang}/{page,[0-9]+}", {"lang": "[a-z]{2}", "page": "x"}, {"lang": "never", "host": ".+"})
    return P.glob_wildcards(table(spark, sf, "pages"), "url", pattern)


@query("SELECT o_orderkey, CASE WHEN done = 0 THEN '0%' WHEN done = 1000 THEN '100%' WHEN round(done / 10.0) NOT IN (0, 100) THEN format('{:.0f}%', done / 10.0) ELSE format('{:.1f}%', done / 10.0) END AS share FROM (SELECT o_orderkey, o_orderkey * 7 % 1001 AS done FROM orders) WHERE done % 10 <> 5")
def percentage(spark, sf):
    """Halves are left out: how they round is up to the formatting of each system."""
    done = F.col("o_orderkey") * 7 % 1001
    return table(spark, sf, "orders").where(done % 10 != 5).select("o_orderkey", V.format_percentage(done, F.lit(1000)).alias("share"))


@query("SELECT n_nationkey, n_name AS first, n_name || ',' || n_regionkey AS both FROM nation")
def named_items(spark, sf):
    items = F.array(*(F.struct(F.lit(k).alias("name"), v.cast("string").alias("value")) for k, v in (("a", F.col("n_name")), ("b", F.lit("x")), ("a", F.col("n_regionkey")))))
    return table(spark, sf, "nation").select("n_nationkey", V.named_item(items, "a")[0].alias("first"), F.array_join(V.named_item(items, "a"), ",").alias("both"))


# Jobs


@query(f"SELECT job, min(path) FILTER (WHERE temp) AS choice FROM {FILES} GROUP BY job")
def choose_file(spark, sf):
    return J.first_choice(files(spark, sf), "job", F.col("path"), F.col("temp"), "path")


@query(f"SELECT job, min(mtime) FILTER (WHERE temp) AS oldest, max(mtime) FILTER (WHERE NOT temp) AS newest FROM {FILES} GROUP BY job HAVING min(mtime) FILTER (WHERE temp) < max(mtime) FILTER (WHERE NOT temp)")
def output_mtime_check(spark, sf):
    f = files(spark, sf)
    return J.too_old(f.where("temp"), f.where("NOT temp"))


@query("SELECT doc_id, substr(sha256(CAST(doc_id AS VARCHAR)), 1, 16) AS short FROM documents")
def shorten_ids(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.sha2(F.col("doc_id").cast("string"), 256).alias("id"))
    return J.shorten_ids(d, "id").select("doc_id", "short")


@query(f"SELECT job, CASE WHEN max(temp) THEN 'x' || job END AS external FROM {FILES} GROUP BY job")
def incomplete_external_job(spark, sf):
    markers = files(spark, sf).select("job", F.when(F.col("temp"), F.concat(F.lit("x"), "job")).alias("external"))
    return J.external_job(markers, "job", "external")


@query(f"SELECT job, path FROM {FILES} WHERE path IN (SELECT 'part/' || p_partkey FROM part WHERE p_size < 5) AND job NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')")
def check_incomplete(spark, sf):
    marked = table(spark, sf, "part").where("p_size < 5").select(F.concat(F.lit("part/"), "p_partkey").alias("path"))
    running = table(spark, sf, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("job"))
    return J.incomplete(files(spark, sf).select("job", "path"), marked, running)


@query("SELECT o_custkey, name, value FROM (SELECT o_custkey, o_orderstatus AS name, o_orderpriority AS value, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS n FROM orders) WHERE n = 1")
def merged_wildcards(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", F.col("o_orderstatus").alias("name"), F.col("o_orderpriority").alias("value"), "o_orderkey")
    return J.merged_wildcards(o, "o_custkey", ["o_orderkey"])


def _groups(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("node"), (F.col("p_partkey") % 10).alias("group"))


@query(f"SELECT DISTINCT dst % 10 AS \"group\", src AS node FROM {EDGES} WHERE src % 10 <> dst % 10")
def group_inputs(spark, sf):
    return J.group_inputs(edges(spark, sf), _groups(spark, sf))


@query(f"SELECT p_partkey % 10 AS \"group\", p_partkey AS node FROM part WHERE p_partkey NOT IN (SELECT src FROM {EDGES} WHERE src % 10 = dst % 10)")
def group_outputs(spark, sf):
    return J.group_outputs(edges(spark, sf), _groups(spark, sf))


@query(f"SELECT DISTINCT p_partkey // 20 AS \"group\" FROM part WHERE p_partkey // 20 NOT IN (SELECT dst // 20 FROM {EDGES} JOIN part ON p_partkey = src WHERE src // 20 <> dst // 20 AND p_size < 4)")
def ready_groups(spark, sf):
    p = table(spark, sf, "part")
    group = p.select(F.col("p_partkey").alias("node"), F.floor(F.col("p_partkey") / 20).alias("group"))
    return J.ready_groups(edges(spark, sf), group, p.where("p_size < 4").select(F.col("p_partkey").alias("node")))


@query(f"SELECT dst AS node FROM {EDGES} JOIN part s ON s.p_partkey = src JOIN part d ON d.p_partkey = dst WHERE s.p_size BETWEEN 20 AND 30 AND d.p_size > 30")
def finish_jobs(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("node"), "p_size")
    return J.finish(edges(spark, sf), p.where("p_size < 20"), p.where("p_size BETWEEN 20 AND 30"))


@query(f"""WITH RECURSIVE kept(node) AS (SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT src FROM {EDGES}) AND p_partkey % 7 <> 0 UNION SELECT e.src FROM kept JOIN {EDGES} e ON e.dst = kept.node)
SELECT p_partkey AS node FROM part WHERE p_partkey NOT IN (SELECT node FROM kept)""")
def delete_jobs(spark, sf):
    """Targets (nodes that nothing waits for) with a key that 7 divides go, with all that was for them alone."""
    e = edges(spark, sf)
    targets = table(spark, sf, "part").select(F.col("p_partkey").alias("node")).join(e.select(F.col("src").alias("node")), "node", "left_anti")
    return J.delete_jobs(e, targets.where("node % 7 = 0"))


@query(f"""SELECT job, mem AS mem_mb, CAST(ceil(mem * 1000000 / 1048576.0) AS BIGINT) AS mem_mib, runtime FROM (SELECT job, CAST(least(20000, coalesce(CASE WHEN rule = '5-LOW' THEN 123 END,
ceil((CASE WHEN rule = '1-URGENT' THEN 500 WHEN rule = '2-HIGH' THEN 4000 ELSE 1000 END + CASE WHEN rule = '1-URGENT' THEN 2 ELSE 0 END * input_mb) * attempt))) AS BIGINT) AS mem,
CAST(least(90, CASE WHEN rule = '2-HIGH' THEN 120 ELSE 60 END) AS BIGINT) AS runtime FROM (SELECT job, rule, job % 3 + 1 AS attempt, job % 100 AS input_mb FROM {JOBS}))""")
def expand_resources(spark, sf):
    j = jobs(spark, sf).select("job", "rule", (F.col("job") % 3 + 1).alias("attempt"), (F.col("job") % 100).alias("input_mb"))
    rules = spark.createDataFrame([("1-URGENT", 500, 2, None), ("2-HIGH", 4000, None, 120)], "rule string, mem_base int, mem_per_input int, runtime int")
    return J.expand_resources(j, rules, {"mem_mb": 20_000, "runtime": 90}, spark.createDataFrame([("5-LOW", 123)], "rule string, mem_mb int"))


@query("SELECT o_orderkey, 'mem=' || o_orderkey % 9 AS global, 'disk=' || o_orderkey % 5 AS local FROM orders")
def resource_scopes(spark, sf):
    k = F.col("o_orderkey")
    r = F.create_map(F.lit("mem"), k % 9, F.lit("disk"), k % 5, F.lit("gpu"), k)
    shown = lambda scope: F.array_join(F.transform(F.map_entries(J.scoped(r, {"disk": "local", "gpu": "excluded"}, scope)), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",")
    return table(spark, sf, "orders").select("o_orderkey", shown("global").alias("global"), shown("local").alias("local"))


@query("SELECT o_custkey, 'pool' || o_custkey % 4 AS pool FROM orders GROUP BY o_custkey")
def string_resources(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", F.concat(F.lit("pool"), F.col("o_custkey") % 4).alias("pool"))
    return J.string_resource(o, "o_custkey", "pool")


@query("SELECT 'mem' AS resource, CAST(10000000 - sum(o_orderkey % 64) AS BIGINT) AS free FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 'slots', CAST(1000000 - count(*) AS BIGINT) FROM orders WHERE o_orderstatus = 'O'")
def free_resources(spark, sf):
    running = table(spark, sf, "orders").where("o_orderstatus = 'O'").select((F.col("o_orderkey") % 64).alias("mem"), F.lit(1).alias("slots"))
    return J.available({"mem": 10_000_000, "slots": 1_000_000}, running)


_HASHES = f"WITH RECURSIVE r(node, hash) AS (SELECT p_partkey, sha256('job ' || p_brand) FROM part WHERE p_partkey NOT IN (SELECT dst FROM {EDGES}) UNION ALL SELECT e.dst, sha256('job ' || p_brand || r.hash) FROM r JOIN {EDGES} e ON e.src = r.node JOIN part ON p_partkey = e.dst)"


def _provenance(spark, sf):
    return J.provenance(edges(spark, sf), table(spark, sf, "part").select(F.col("p_partkey").alias("node"), F.concat(F.lit("job "), "p_brand").alias("text")))


@query(f"{_HASHES} SELECT node, hash FROM r")
def provenance_recursive(spark, sf):
    return _provenance(spark, sf)


@query(f"{_HASHES} SELECT node, hash, CASE WHEN hash IN (SELECT hash FROM r WHERE node % 3 = 0) THEN 'cache/' || hash END AS cached FROM r")
def output_cache(spark, sf):
    h = G.stored(_provenance(spark, sf))
    return J.fetch(h, h.where("node % 3 = 0").select("hash", F.concat(F.lit("cache/"), "hash").alias("path")))


@query("""SELECT 'mod_' || n_name AS rule, CASE WHEN n_regionkey = 1 THEN 'own/' || n_name ELSE 'pre/' || n_name || '.txt' END AS output, CASE WHEN n_regionkey = 2 THEN 8 ELSE 1 END AS threads,
CASE WHEN n_regionkey = 1 THEN 'a=2,b=1,c=3' ELSE 'a=1,b=1' END AS params FROM nation WHERE n_name NOT IN ('FRANCE', 'NATION_3')""")
def rule_inheritance(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_name").alias("rule"), "n_regionkey")
    text = "map<string,string>"
    rules = n.select("rule", F.concat("rule", F.lit(".txt")).alias("output"), F.lit(1).alias("threads"), F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("1")).alias("params"))
    over = n.where("n_regionkey IN (1, 2)").select(
        "rule", F.when(F.col("n_regionkey") == 1, F.concat(F.lit("own/"), "rule")).alias("output"), F.when(F.col("n_regionkey") == 2, 8).alias("threads"),
        F.when(F.col("n_regionkey") == 1, F.create_map(F.lit("a"), F.lit("2"), F.lit("c"), F.lit("3"))).cast(text).alias("params"),
    )
    out = J.inherit(rules, over, ["FRANCE", "NATION_3"], "mod_{}", "pre/")
    shown = F.array_join(F.array_sort(F.transform(F.map_entries("params"), lambda x: F.concat(x["key"], F.lit("="), x["value"]))), ",")
    return out.select("rule", "output", "threads", shown.alias("params"))


@query(f"SELECT p_partkey AS node, count(dst) AS consumers FROM part LEFT JOIN {EDGES} ON src = p_partkey WHERE p_size = 3 GROUP BY p_partkey HAVING count(dst) <> 1")
def pipe_consumers(spark, sf):
    return J.consumers(edges(spark, sf), table(spark, sf, "part").where("p_size = 3").select(F.col("p_partkey").alias("node")))


@query("SELECT o_orderkey, md5(o_orderpriority || '|' || CASE WHEN o_orderstatus = 'F' THEN 'img:' || o_custkey ELSE '' END) AS hash FROM orders")
def software_stack_hash(spark, sf):
    image = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("img:"), "o_custkey"))
    return table(spark, sf, "orders").select("o_orderkey", J.stack_hash(F.col("o_orderpriority"), image).alias("hash"))


@query(f"SELECT DISTINCT path FROM {FILES} WHERE job IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '3-MEDIUM') UNION SELECT '/log/' || o_orderkey FROM orders WHERE o_orderpriority = '3-MEDIUM'")
def job_products(spark, sf):
    o = jobs(spark, sf).where("rule = '3-MEDIUM'").select("job")
    outputs = files(spark, sf).join(o, "job", "left_semi").select("path")
    return outputs.unionByName(o.select(F.concat(F.lit("/log/"), "job").alias("path"))).distinct()


# What must run, and plans that results change


_STATE = """(SELECT p_partkey AS node, p_size % 6 = 0 AS missing, p_partkey NOT IN (SELECT src FROM {edges}) AS needed, p_partkey % 211 = 3 AS forced, p_retailprice % 97 < 2 AS updated,
p_brand = 'Brand#13' AND p_size > 45 AS code, p_size = 11 AND p_partkey % 4 = 0 AS inputs, CASE WHEN p_size = 9 THEN p_partkey % 5 = 0 END AS params FROM part)""".format(edges=EDGES)
_OWN = "CASE WHEN forced THEN 'forced' WHEN missing AND needed THEN 'missing output' WHEN updated THEN 'updated input' WHEN code THEN 'code changed' WHEN inputs THEN 'input changed' WHEN params THEN 'params changed' END"


@query(f"""WITH RECURSIVE s AS (SELECT node, missing, {_OWN} AS own FROM {_STATE}), e AS (SELECT src, dst FROM {EDGES}),
step AS (SELECT src AS a, dst AS b FROM e WHERE dst % 5 <> 0 UNION ALL SELECT dst, src FROM e JOIN s ON s.node = src WHERE missing),
r(node) AS (SELECT node FROM s WHERE own IS NOT NULL UNION SELECT b FROM r JOIN step ON a = r.node)
SELECT r.node, coalesce(own, CASE WHEN missing AND r.node IN (SELECT src FROM e JOIN r ON r.node = dst) THEN 'missing output' END, 'input comes anew') AS reason FROM r JOIN s ON s.node = r.node""")
def needrun_reasons(spark, sf):
    """Missing outputs of targets and of jobs in between, forced jobs, changes, and inputs taken as ancient."""
    p, e = table(spark, sf, "part"), edges(spark, sf)
    taken = e.select(F.col("src").alias("p_partkey"), F.lit(False).alias("needed")).distinct()
    state = G.meet(p, taken, "p_partkey", "left").select(
        F.col("p_partkey").alias("node"), (F.col("p_size") % 6 == 0).alias("missing"), F.coalesce("needed", F.lit(True)).alias("needed"), (F.col("p_partkey") % 211 == 3).alias("forced"),
        (F.col("p_retailprice") % 97 < 2).alias("updated"), ((F.col("p_brand") == "Brand#13") & (F.col("p_size") > 45)).alias("code"), ((F.col("p_size") == 11) & (F.col("p_partkey") % 4 == 0)).alias("inputs"),
        F.when(F.col("p_size") == 9, F.col("p_partkey") % 5 == 0).alias("params"),
    )
    return G.run_reasons(e.withColumn("ancient", F.col("dst") % 5 == 0), state)


@query("WITH RECURSIVE r(node) AS (SELECT CAST(1 AS BIGINT) UNION SELECT c.p_partkey FROM r JOIN part p ON p.p_partkey = r.node JOIN part c ON c.p_partkey = 2 * r.node OR (p.p_size >= 25 AND c.p_partkey = 2 * r.node + 1)) SELECT node FROM r")
def checkpoint_replan(spark, sf):
    """What a finished job's size turns out to be decides whether it has one follower or two."""
    p = table(spark, sf, "part")

    def expand(new):
        results = p.join(new.withColumnRenamed("node", "p_partkey"), "p_partkey")
        two = F.when(F.col("p_size") >= 25, F.array(F.col("p_partkey") * 2, F.col("p_partkey") * 2 + 1)).otherwise(F.array(F.col("p_partkey") * 2))
        return G.meet(results.select(F.explode(two).alias("p_partkey")), p.select("p_partkey"), "p_partkey").select(F.col("p_partkey").alias("node"))

    return G.replan(p.where("p_partkey = 1").select(F.col("p_partkey").alias("node")), expand)


@query("SELECT event_id, event_type FROM events WHERE event_id <> (SELECT max(event_id) FROM events)")
def queue_sentinel(spark, sf):
    """The last event ends the queue and is no item of it; all stand in one batch, or come later than it."""
    last = table(spark, sf, "events").agg(F.max("event_id")).first()[0]
    return queue.accumulate(spark, sf, "event_id", f"event_id = {last}", pattern="events.parquet").select("event_id", "event_type")


@query(f"SELECT DISTINCT f.path FROM {FILES} f WHERE f.temp AND NOT EXISTS (SELECT 1 FROM {FILES} g WHERE g.path = f.path AND NOT g.temp AND g.mtime > f.mtime AND g.job % 4 = 0)")
def temp_without_consumer(spark, sf):
    """Temporary files that no later job (of those that still run) takes."""
    f = files(spark, sf)
    made = f.where("temp").groupBy("path").agg(F.max("mtime").alias("first"))
    used = f.where("NOT temp AND job % 4 = 0").groupBy("path").agg(F.max("mtime").alias("last"))
    return made.join(used, "path", "left").where("last IS NULL OR first >= last").select("path")


@query("SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) <> list_sort(list(DISTINCT CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE o_orderpriority END)) AS params FROM orders GROUP BY 1")
def params_changes(spark, sf):
    """Two sets of parameters of which either may have what the other lacks."""
    then = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus")).otherwise(F.col("o_orderpriority"))
    g = table(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderpriority").alias("now"), F.collect_list(then).alias("then"))
    return g.select("o_custkey", L.params_changed(F.col("now"), F.col("then")).alias("params"))


@query(f"""SELECT j.job, CASE WHEN f.job IS NULL THEN 'missing' WHEN newest > start THEN 'updated input files' WHEN j.job % 13 = 0 THEN 'code has changed' WHEN inputs THEN 'set of input files has changed' WHEN j.job % 17 = 0 THEN 'params have changed' ELSE 'ok' END AS status
FROM {JOBS} j LEFT JOIN (SELECT job, max(mtime) FILTER (WHERE size < 20000) AS newest, bool_or(temp) AND NOT bool_and(temp) AS inputs FROM {FILES} GROUP BY job) f USING (job)""")
def summary_of_changes(spark, sf):
    """The status of each job from its files and from recorded code, inputs and parameters."""
    f = files(spark, sf).groupBy("job").agg(F.max(F.when(F.col("size") < 20_000, F.col("mtime"))).alias("newest"), F.collect_list("path").alias("now"), F.collect_list(F.when(F.col("temp"), F.col("path"))).alias("kept"), F.max("temp").alias("any"))
    met = jobs(spark, sf).join(f, "job", "left")
    k = F.col("job")
    code = L.value_changed(F.lit("v2"), F.when(k % 13 == 0, "v1").otherwise("v2"), F.lit(6), 3)
    then = F.when(F.size("kept") > 0, F.col("kept")).otherwise(F.col("now"))
    params = L.params_changed(F.array(F.lit("a")), F.when(k % 17 == 0, F.array(F.lit("b"))).otherwise(F.array(F.lit("a"))))
    status = L.summary_status(F.col("now").isNull(), F.coalesce(F.col("newest") > F.col("start"), F.lit(False)), code, L.input_changed(F.col("now"), then), params)
    return met.select("job", status.alias("status"))


@query(f"SELECT path FROM {FILES} WHERE job % 13 = 0 AND temp")
def outputs_with_changes(spark, sf):
    changed = L.value_changed(F.lit("v2"), F.when(F.col("job") % 13 == 0, "v1").otherwise("v2"), F.lit(6), 3)
    return files(spark, sf).where("temp").where(changed).select("path")


# Validation of nested rows, with references


def _accounts(spark, sf):
    account = F.struct(F.col("c_nationkey").alias("nation"), F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"), F.col("c_acctbal").alias("balance"))
    return table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 > 0, account).alias("account"))


ACCOUNTS = {
    "required": ["account"],
    "properties": {"account": {"$ref": "#/$defs/account"}},
    "$defs": {
        "account": {
            "type": "object",
            "required": ["segment"],
            "properties": {
                "nation": {"type": "integer", "allOf": [{"minimum": 3}, {"$ref": "limits#/nations"}]},
                "balance": {"type": "string", "anyOf": [{"maximum": 0}, {"minimum": 5000, "exclusiveMaximum": 9000}]},
                "segment": {"type": ["string", "null"], "not": {"pattern": "^M"}, "default": "NONE"},
                "tier": {"default": 1},
            },
        }
    },
}
LIMITS = {"limits": {"nations": {"maximum": 20}}}


@query("""WITH t AS (SELECT c_custkey, c_custkey % 7 = 0 AS none, c_nationkey AS n, c_acctbal AS b, c_mktsegment AS s FROM customer)
SELECT c_custkey, unnest(list_filter(CASE WHEN none THEN ['account: required'] ELSE [CASE WHEN s = 'BUILDING' THEN 'account.segment: required' END, CASE WHEN n < 3 THEN 'account.nation: minimum' END,
CASE WHEN n > 20 THEN 'account.nation: maximum' END, CASE WHEN b > 0 AND (b < 5000 OR b >= 9000) THEN 'account.balance: anyOf' END, 'account.balance: type',
CASE WHEN s LIKE 'M%' THEN 'account.segment: not' END] END, lambda x: x IS NOT NULL)) AS problem FROM t""")
def validate_nested(spark, sf):
    """References within the schema and into another one, parts that hold together, alternatives, nested objects."""
    return T.violations(_accounts(spark, sf), ACCOUNTS, "c_custkey", LIMITS)


@query("""SELECT c_custkey, CASE WHEN c_custkey % 7 > 0 THEN coalesce(nullif(c_mktsegment, 'BUILDING'), 'NONE') END AS segment, CASE WHEN c_custkey % 7 > 0 THEN '1' END AS tier FROM customer""")
def validate_nested_defaults(spark, sf):
    return T.with_defaults(_accounts(spark, sf), ACCOUNTS, LIMITS).select("c_custkey", "account.segment", F.col("account.tier").cast("string").alias("tier"))


@query("""SELECT event_id, unnest(list_filter([CASE WHEN value <> floor(value) THEN 'value: type' END, CASE WHEN length(event_type) > 5 THEN 'event_type: maxLength' END,
CASE WHEN user_id % 3 <> 0 THEN 'user_id: multipleOf' END, CASE WHEN user_id <= 10 THEN 'user_id: exclusiveMinimum' END, 'host: required'], lambda x: x IS NOT NULL)) AS problem FROM events""")
def validate_types(spark, sf):
    schema = {
        "required": ["event_type", "host"],
        "properties": {"value": {"type": "integer"}, "event_type": {"type": "string", "maxLength": 5}, "user_id": {"type": "number", "multipleOf": 3, "exclusiveMinimum": 10}},
    }
    return T.violations(table(spark, sf, "events"), schema, "event_id")
