"""Queries of reports, states, JSON texts and searches in words, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import json_text
from tessera.operators import code, cycles, diffs, merging, quality, reports, trees
from tessera.plans.catalog_queries import query
from tessera.plans.code_queries import entities
from tessera.sources.storage import materialize, new_dir, table


@query("""SELECT event_id, event_id % 7 <> 0 AS valid, CASE WHEN event_id % 7 <> 0 THEN json_extract_string(props, '$.k') END AS k FROM events""")
def json_valid_value(spark, d):
    text = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("x"), "props")).otherwise(F.col("props"))
    rows = table(spark, d, "events").select("event_id", text.alias("t"))
    ok = json_text.valid(F.col("t"))
    return rows.select("event_id", ok.alias("valid"), F.when(ok, json_text.value_at(F.col("t"), "$.k")).alias("k"))


@query("""SELECT p_partkey AS key, '$' || unnest(['.a', '.a.b', '.a.b[]', '.a.b[].c', '.n', '.s']) AS path FROM part
    UNION ALL SELECT p_partkey, '$.a' || repeat('.d', x::INT) FROM (SELECT p_partkey, unnest(range(1, 2 + p_size % 12)) AS x FROM part)""")
def json_paths(spark, d):
    """Objects down to 13 steps, and a string that holds JSON."""
    deep = F.concat(F.repeat(F.lit('{"d": '), F.col("p_size") % 12), F.lit('{"d": 0}'), F.repeat(F.lit("}"), F.col("p_size") % 12))
    inner = F.concat(F.lit('{"b": [{"c": '), "p_size", F.lit("}, 2], "), F.substring(deep, 2, 10_000))
    text = F.concat(F.lit('{"a": '), inner, F.lit(', "n": null, "s": "{\\"t\\": [1]}"}'))
    return json_text.paths(table(spark, d, "part").select(F.col("p_partkey").alias("key"), text.alias("t")), "key", "t")


@query("""SELECT p_partkey AS key, l.line, l.kind, CASE l.line WHEN 1 THEN 'f' || p_size WHEN 3 THEN 'C' || p_partkey ELSE 'v' END AS name FROM part, (VALUES (1, 'function'), (3, 'class'), (4, 'const')) AS l(line, kind)""")
def text_index(spark, d):
    text = F.concat(F.lit("function f"), "p_size", F.lit("(a) {\n  return a }\nexport class C"), "p_partkey", F.lit(" {}\n  const v = 1\nx = 2"))
    return reports.text_index(table(spark, d, "part").select("p_partkey", text.alias("t")), "p_partkey", "t")


@query("""SELECT p_partkey, round((p_size + 1) * CASE WHEN p_partkey % 2 = 0 THEN 1.5 ELSE 1.0 END, 2) AS score FROM part WHERE NOT contains(lower(p_name), 'old') AND p_size > 5""")
def search_in_words(spark, d):
    asked = reports.parse_query("find functions for tax without old in src/big")
    assert asked == {"target": "function", "keywords": ["tax"], "negations": ["old"], "path": "src/big"}
    rows = table(spark, d, "part").select(
        "p_partkey", "p_name", (F.col("p_size") + 1).cast("double").alias("score"), F.when(F.col("p_partkey") % 2 == 0, "function").otherwise("class").alias("kind"), F.when(F.col("p_size") > 5, "src/big/x").otherwise("src/small").alias("path")
    )
    return reports.query_filter(rows, asked, "p_name", "path", "kind", "score").select("p_partkey", F.round("score", 2).alias("score"))


@query("""WITH a AS (SELECT *, count(*) OVER (PARTITION BY event_type, user_id % 5) AS n, count(*) OVER (PARTITION BY event_type, user_id % 5, value > 50) AS m FROM events),
    l AS (SELECT * FROM a ORDER BY event_id DESC LIMIT 50) SELECT count(*) AS n_rated, round(coalesce(avg(m / n), 0.0), 4) AS consistency FROM l WHERE n >= 3""")
def decision_consistency(spark, d):
    rows = table(spark, d, "events").select("event_type", (F.col("user_id") % 5).alias("u"), (F.col("value") > 50).alias("choice"), "event_id")
    return reports.consistency(rows, ["event_type", "u"], "choice", "event_id")


@query("""SELECT event_type, count(*) AS total, count(*) FILTER (event_id % 4 <> 0) AS succeeded, round(avg(CASE WHEN event_id % 4 <> 0 THEN 1.0 ELSE 0.0 END), 4) AS success_rate, round(avg(nullif((event_id % 10)::DOUBLE, 0)), 4) AS mean_duration FROM events GROUP BY 1""")
def delivery_stats(spark, d):
    rows = table(spark, d, "events").withColumn("took", (F.col("event_id") % 10).cast("double"))
    return reports.delivery_stats(rows, "event_type", F.col("event_id") % 4 != 0, "took")


@query("SELECT event_id, ts FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 100")
def delivery_history(spark, d):
    return reports.delivery_history(table(spark, d, "events"), "ts", "event_id", F.col("event_type") == "error").select("event_id", "ts")


BASE = """(SELECT o_custkey, base, score FROM (SELECT o_custkey, o_orderkey AS base, 10 * n + 15 * r + q + m AS score, row_number() OVER (PARTITION BY o_custkey ORDER BY 10 * n + 15 * r + q + m DESC, o_orderkey) AS k
    FROM orders JOIN (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS r, sum(l_quantity)::BIGINT AS q, max(l_linenumber) AS m FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey) WHERE k = 1)"""


def bases(spark, d):
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count("*").alias("n"), F.sum((F.col("l_returnflag") == "R").cast("long")).alias("r"), F.sum("l_quantity").cast("long").alias("q"), F.max("l_linenumber").alias("m")
    )
    return reports.fusion_base(table(spark, d, "orders").select("o_custkey", "o_orderkey").join(lines, "o_orderkey"), "o_custkey", "o_orderkey", "n", "r", "q", "m")


@query(f"SELECT * FROM {BASE}")
def fusion_base(spark, d):
    return bases(spark, d)


@query(f"""SELECT o_custkey, pos, line FROM (SELECT b.o_custkey, base, count(o_orderkey) AS n, count(o_orderkey) FILTER (o_orderstatus = 'P') AS p FROM {BASE} b LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'F') o ON o.o_custkey = b.o_custkey GROUP BY 1, 2),
    LATERAL (VALUES (0, 'Base: ' || base), (1, 'Conflicts: ' || n), (2, 'Pending: ' || p)) AS t(pos, line)""")
def fusion_report(spark, d):
    conflicts = table(spark, d, "orders").filter("o_orderstatus <> 'F'").select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") == "P", "manual").otherwise("keep_all").alias("strategy"))
    return reports.fusion_report(bases(spark, d), reports.conflict_status(conflicts, F.col("strategy")), "o_custkey")


@query("""SELECT 'C' || n_nationkey AS name, 0 AS part, 'class C' || n_nationkey AS line FROM nation UNION ALL SELECT 'C' || n_nationkey, 1, 'R' || n_regionkey || ' <|-- C' || n_nationkey FROM nation""")
def class_diagram(spark, d):
    n = table(spark, d, "nation").select(F.concat(F.lit("C"), "n_nationkey").alias("name"), F.array(F.concat(F.lit("R"), "n_regionkey")).alias("bases"))
    return reports.class_diagram(n)


@query("SELECT '<tr><td>' || s_suppkey || '</td><td>' || s_name || ' &lt;b&gt; &amp;</td></tr>' AS html FROM supplier")
def html_table_rows(spark, d):
    rows = table(spark, d, "supplier").select("s_suppkey", F.concat("s_name", F.lit(" <b> &")).alias("name"))
    return rows.select(reports.html_rows(rows, ["s_suppkey", "name"]).alias("html"))


@query("""SELECT folder, count(*)::INT AS n_files, '{"folder":"' || folder || '","files":["' || string_agg(path, '","' ORDER BY path) || '"]}' AS entry FROM (SELECT 'b' || (p_partkey % 3) AS folder, 'm' || p_partkey || '.py' AS path FROM part) GROUP BY 1""")
def structure_entries(spark, d):
    files = table(spark, d, "part").select(F.concat(F.lit("m"), "p_partkey", F.lit(".py")).alias("path"), "p_partkey")
    return reports.layout(files, F.concat(F.lit("b"), F.col("p_partkey") % 3), "path")


@query("""SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey % 2, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1""")
def state_import(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.struct("o_orderdate", (F.col("o_orderkey") % 2).alias("s"), F.col("o_orderkey").alias("k")).alias("at"))
    return reports.merged_states(rows.filter("o_orderkey % 2 = 1"), rows.filter("o_orderkey % 2 = 0"), "o_custkey", "at").select("o_custkey", "o_orderkey")


@query("""SELECT s_suppkey AS name, 'level=' || CASE WHEN s_suppkey % 2 = 0 THEN 'high' ELSE 'low' END || ';mode=' || CASE WHEN s_suppkey % 3 = 0 THEN 'fast' ELSE 'safe' END AS settings FROM supplier""")
def rule_settings(spark, d):
    k = F.col("s_suppkey")
    base = table(spark, d, "supplier").select(k.alias("name"), F.create_map(F.lit("level"), F.lit("low"), F.lit("mode"), F.lit("safe")).alias("settings"))
    given = F.map_filter(F.create_map(F.lit("level"), F.when(k % 2 == 0, "high"), F.lit("mode"), F.when(k % 3 == 0, "fast")), lambda _, v: v.isNotNull())
    out = reports.updated_settings(base, table(spark, d, "supplier").filter("s_suppkey % 2 = 0 or s_suppkey % 3 = 0").select(k.alias("name"), given.alias("settings")))
    text = F.array_join(F.array_sort(F.transform(F.map_entries("settings"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return out.select("name", text.alias("settings"))


@query("""SELECT count(*) AS processed, count(*) FILTER (o_orderstatus = 'P') AS failed, sum(o_shippriority_) FILTER (o_orderstatus <> 'P')::BIGINT AS total_n FROM (SELECT *, o_orderkey % 10 AS o_shippriority_ FROM orders)""")
def phase_summary(spark, d):
    rows = table(spark, d, "orders").withColumn("n", F.col("o_orderkey") % 10)
    return reports.phase_summary(rows, F.col("o_orderstatus") == "P", ["n"])


@query("""SELECT 'type1' AS type, count(*) AS n_pairs, sum(p_size)::BIGINT AS duplicated_lines FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'A'
    UNION ALL SELECT 'type2', count(*), sum(p_size)::BIGINT FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag <> 'A'""")
def clone_statistics(spark, d):
    links = table(spark, d, "lineitem").select(F.col("l_partkey").alias("a"), F.when(F.col("l_returnflag") == "A", "type1").otherwise("type2").alias("type"))
    return quality.clone_statistics(links, table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("n_lines")))


@query("""SELECT 'src/part_' || p_partkey || '.py' AS path, CASE WHEN p_size > 10 THEN 'i,price,range,' ELSE 'price,' END || CASE WHEN p_size < 20 THEN 'tax,' ELSE '' END || 'total' AS variables,
    substr(md5(array_to_string(list_transform(list_filter([CASE WHEN p_size > 10 THEN 'i|WRITE,READ,READ' END, 'price|READ' || CASE WHEN p_size < 20 THEN ',READ' ELSE '' END, CASE WHEN p_size > 10 THEN 'range|READ' END,
    CASE WHEN p_size < 20 THEN 'tax|READ,READ' END, 'total|WRITE' || CASE WHEN p_size < 20 THEN ',READ,WRITE' ELSE '' END || CASE WHEN p_size > 10 THEN ',WRITE' ELSE '' END || ',READ'], lambda x: x IS NOT NULL),
    lambda x: 'price_' || regexp_replace(lower(p_brand), '[^a-z0-9]', '_', 'g') || '|' || x), chr(10))), 1, 16) AS fingerprint FROM part""")
def dna_digest(spark, d):
    out = code.fingerprints(code.data_flow(entities(spark, d, *code.READS["data_flow"])))
    return out.select("path", F.array_join("variables", ",").alias("variables"), "fingerprint")


@query("""SELECT count(*) AS n FROM part""")
def semantic_members(spark, d):
    """All functions of one name part end in one group: the links of `semantic_pairs` connect what a comparison of all pairs would."""
    from tessera.operators.components import components

    links = materialize(code.semantic_pairs(entities(spark, d, *code.READS["semantic_pairs"])), "links")
    members = components(links.select("a", "b"))
    named = members.filter(F.contains("node", F.lit(":name_")))
    return named.agg(F.count("*").alias("n"))


@query("""WITH n AS (SELECT count(*) AS n FROM supplier), e AS (
    SELECT s_suppkey AS src, (s_suppkey * 7 + 3) % n + 1 AS dst FROM supplier, n UNION SELECT s_suppkey, s_suppkey + 1 FROM supplier, n WHERE s_suppkey % 4 <> 0 UNION SELECT s_suppkey, s_suppkey - 3 FROM supplier WHERE s_suppkey % 8 = 4),
    r AS (WITH RECURSIVE c(a, b) AS (SELECT src, dst FROM e WHERE src <> dst UNION SELECT a, dst FROM c JOIN e ON b = src WHERE src <> dst) SELECT a, b FROM c),
    g AS (SELECT x.a AS node, least(x.a, min(x.b)) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.a)
    SELECT node, component, count(*) OVER (PARTITION BY component) AS size FROM g""")
def import_cycles(spark, d):
    """Cycles of any length among suppliers that point at others."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("src"))
    n = s.agg(F.count("*").alias("n"))
    far = s.crossJoin(F.broadcast(n)).select("src", ((F.col("src") * 7 + 3) % F.col("n") + 1).alias("dst"))
    near = s.filter("src % 4 <> 0").select("src", (F.col("src") + 1).alias("dst")).union(s.filter("src % 8 = 4").select("src", (F.col("src") - 3).alias("dst")))
    return cycles.strong_components(far.union(near))


@query("""WITH p AS (SELECT p_partkey AS key, p_size % 20 + 1 AS k FROM part), h AS (SELECT key, k, greatest(k - 3, 1) AS s, least(k + 3, 20) AS t FROM p)
    SELECT key, 1 AS hunk, '@@ -' || s || ',' || (t - s + 1) || ' +' || s || ',' || (t - s + 2) || ' @@' AS header, t - s + 3 AS n_lines FROM h""")
def unified_diff(spark, d):
    """One line of twenty becomes two."""
    line = lambda i: F.concat(F.lit("row "), i.cast("string"))
    at = F.col("p_size") % 20 + 1
    numbers = F.sequence(F.lit(1), F.lit(20))
    old = F.array_join(F.transform(numbers, line), "\n")
    new = F.array_join(F.transform(numbers, lambda i: F.when(i == at, F.concat(F.lit("new "), F.col("p_name"), F.lit("\nmore"))).otherwise(line(i))), "\n")
    pairs = table(spark, d, "part").select(F.col("p_partkey").alias("key"), old.alias("a"), new.alias("b"))
    return diffs.unified(pairs, "key", "a", "b").select("key", "hunk", diffs.header().alias("header"), F.size("lines").alias("n_lines"))


@query("""WITH p AS (SELECT p_partkey AS key, p_size % 20 + 1 AS x, p_partkey % 20 + 1 AS y, 'ours ' || p_name AS a, 'theirs ' || p_brand AS b FROM part),
    q AS (SELECT *, abs(x - y) <= 1 AS bad, least(x, y) AS lo, greatest(x, y) AS hi, list_transform(range(1, 21), lambda i: 'row ' || i) AS base,
        list_transform(range(1, 21), lambda i: CASE WHEN i = x THEN a ELSE 'row ' || i END) AS ours, list_transform(range(1, 21), lambda i: CASE WHEN i = y THEN b ELSE 'row ' || i END) AS theirs FROM p)
    SELECT key, bad::INT AS n_conflicts, CASE WHEN bad THEN 1 ELSE 2 END AS n_changes, array_to_string(CASE WHEN bad THEN base[1:lo - 1] || ['<<<<<<< ours'] || ours[lo:hi] || ['======='] || theirs[lo:hi] || ['>>>>>>> theirs'] || base[hi + 1:20]
        ELSE list_transform(range(1, 21), lambda i: CASE WHEN i = x THEN a WHEN i = y THEN b ELSE 'row ' || i END) END, chr(10)) AS text FROM q""")
def three_way_merge(spark, d):
    """Both sides change one line of twenty; equal or adjacent lines are in conflict."""
    numbers, row = F.sequence(F.lit(1), F.lit(20)), lambda i: F.concat(F.lit("row "), i.cast("string"))
    text = lambda at, new: F.array_join(F.transform(numbers, lambda i: F.when(i == at, new).otherwise(row(i))), "\n")
    ours = text(F.col("p_size") % 20 + 1, F.concat(F.lit("ours "), "p_name"))
    theirs = text(F.col("p_partkey") % 20 + 1, F.concat(F.lit("theirs "), "p_brand"))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.array_join(F.transform(numbers, row), "\n").alias("base"), ours.alias("ours"), theirs.alias("theirs"))
    return merging.merged(merging.three_way(rows, "key", "base", "ours", "theirs"))


@query("""SELECT path, syntax_valid, CASE WHEN syntax_valid THEN NULL ELSE 3 END AS error_line, CASE WHEN syntax_valid THEN 2 + n ELSE 0 END AS n_imports, CASE WHEN syntax_valid THEN d ELSE '' END AS duplicates, syntax_valid AND d = '' AS success
    FROM (SELECT 'src/part_' || p_partkey || '.py' AS path, p_size % 5 <> 0 AS syntax_valid, (p_size % 2 = 0)::INT + (p_size % 3 = 0)::INT AS n, concat_ws(',', CASE WHEN p_size % 3 = 0 THEN 'json' END, CASE WHEN p_size % 2 = 0 THEN 'os' END) AS d FROM part)""")
def merge_checks(spark, d):
    """Sources with repeated imports and broken ones."""
    size = F.col("p_size")
    text = F.concat_ws("\n", F.lit("import os\nfrom json import loads"), F.when(size % 5 == 0, "def broken(:"), F.when(size % 2 == 0, "import os"), F.when(size % 3 == 0, "from .json import dumps"), F.lit("x = 1"))
    files = table(spark, d, "part").select(F.concat(F.lit("src/part_"), "p_partkey", F.lit(".py")).alias("path"), text.alias("text"))
    return merging.checks(files).withColumn("duplicates", F.array_join("duplicates", ","))


def snapshot(spark, d, later: bool):
    """(path, digest, size): parts as files two or three folders deep; the later snapshot lost some, gained some and changed some."""
    k = F.col("p_partkey")
    folder = F.concat(F.lit("m"), k % 5, F.lit("/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("/b"))))
    path = F.concat(folder, F.lit("/f"), k, F.when(F.lit(later) & (k % 50 == 7), "_moved").otherwise(""), F.lit(".py"))
    changed = F.lit(later) & (k % 70 == 3) & F.col("p_brand").isin("Brand#11", "Brand#42")
    rows = table(spark, d, "part").select(path.alias("path"), F.md5(F.concat("p_name", F.when(changed, "!").otherwise(""))).alias("digest"), F.col("p_size").cast("long").alias("size"), k.alias("k"))
    return rows.filter("k % 90 <> 11") if later else rows


FILES = "SELECT p_partkey AS k, 'm' || (p_partkey % 5) || '/' || lower(replace(p_brand, '#', '/b')) AS folder, p_name, p_brand, p_size FROM part"


@query(f"""WITH a AS (SELECT folder || '/f' || k || '.py' AS path, p_name AS c FROM ({FILES})),
    b AS (SELECT folder || '/f' || k || CASE WHEN k % 50 = 7 THEN '_moved' ELSE '' END || '.py' AS path, p_name || CASE WHEN k % 70 = 3 AND p_brand IN ('Brand#11', 'Brand#42') THEN '!' ELSE '' END AS c FROM ({FILES}) WHERE k % 90 <> 11)
    SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'created' WHEN b.path IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM a FULL JOIN b ON a.path = b.path WHERE a.c IS DISTINCT FROM b.c""")
def tree_changes(spark, d):
    """Changes between two snapshots that are stored as trees."""
    old, new = (trees.store(snapshot(spark, d, later), new_dir(spark, "tree")) for later in (False, True))
    return trees.changes(old, new)


@query(f"""WITH f AS (SELECT string_split(folder, '/') AS p, p_size FROM ({FILES})), e AS (SELECT array_to_string(p[1:i], '/') AS folder, i AS level, i = 3 AS own, p_size FROM f, (SELECT unnest(range(0, 4)) AS i))
    SELECT folder, level::INT AS level, count(*) AS n_files, count(*) FILTER (own) AS n_own, sum(p_size)::BIGINT AS bytes FROM e GROUP BY 1, 2""")
def snapshot_tree(spark, d):
    return trees.folders(snapshot(spark, d, False)).select("folder", "level", "n_files", "n_own", "bytes")
