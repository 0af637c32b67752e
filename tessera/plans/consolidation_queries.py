"""Queries of consolidation, impact, quality, comparison and catalog writes, with their SQL.

Line items stand for pairs of a sibling group (order) with an affinity, parts for files and functions, consecutive
parts of an order for imports.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import compare, consolidation, impact, quality
from tessera.plans.catalog_queries import query
from tessera.sources import catalog_writes
from tessera.sources.storage import materialize, table

PAIRS = "(SELECT l_orderkey AS group_id, least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b, l_linenumber AS n, 1 - l_discount * 4 AS affinity FROM lineitem)"


def pairs(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_orderkey").alias("group_id"), F.least("l_partkey", "l_suppkey").alias("a"), F.greatest("l_partkey", "l_suppkey").alias("b"), F.col("l_linenumber").alias("n"), (1 - F.col("l_discount") * 4).alias("affinity"))


GROUPS = """(SELECT o_orderkey AS group_id, 'src/' || CASE WHEN o_orderkey % 5 = 0 THEN 'Backup/' ELSE 'app/' END || 'f' || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN '.py' ELSE '.js' END AS master,
    (o_orderkey % 101) / 100.0 AS confidence FROM orders)"""


def groups(spark, d):
    k = F.col("o_orderkey")
    master = F.concat(F.lit("src/"), F.when(k % 5 == 0, "Backup/").otherwise("app/"), F.lit("f"), k, F.when(k % 2 == 0, ".py").otherwise(".js"))
    return table(spark, d, "orders").select(k.alias("group_id"), master.alias("master"), ((k % 101) / 100.0).alias("confidence"))


REPORT = f"(SELECT group_id, count(*) AS n_pairs, round(avg(affinity), 4) AS avg_affinity, max(affinity) AS best, min(affinity) AS worst FROM {PAIRS} GROUP BY 1)"


@query("""SELECT c_custkey, coalesce(n, 0) AS n_orders, coalesce(total, 0.0) AS total FROM customer LEFT JOIN
    (SELECT o_custkey, count(*) AS n, round(max(o_totalprice), 2) AS total FROM orders GROUP BY 1) ON c_custkey = o_custkey""")
def lookup_join(spark, d):
    found = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_orders"), F.round(F.max("o_totalprice"), 2).alias("total"))
    return consolidation.with_lookup(table(spark, d, "customer").select("c_custkey"), found.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", {"n_orders": 0, "total": 0.0})


@query(f"""WITH p AS (SELECT a, b, max(affinity) AS v FROM {PAIRS} GROUP BY 1, 2), s AS (SELECT ps AS b, p_partkey AS a FROM part, (SELECT unnest(range(1, 6)) AS ps))
    SELECT s.a, s.b, coalesce(v, 0.0) AS affinity, CASE WHEN v IS NULL THEN 'minimal' WHEN v >= 1 THEN 'identical' WHEN v >= 0.9 THEN 'very_high' WHEN v >= 0.7 THEN 'high' WHEN v >= 0.5 THEN 'medium'
    WHEN v >= 0.3 THEN 'low' ELSE 'minimal' END AS level FROM s LEFT JOIN p ON least(s.a, s.b) = p.a AND greatest(s.a, s.b) = p.b""")
def sibling_pair_lookup(spark, d):
    s = table(spark, d, "part").select(F.col("p_partkey").alias("a"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(5).cast("long"))).alias("b"))
    return consolidation.pair_lookup(s, pairs(spark, d), "a", "b", "affinity")


@query(f"SELECT * FROM {REPORT}")
def group_averages(spark, d):
    return consolidation.group_report(pairs(spark, d), "group_id", "affinity")


JOINED = f"(SELECT g.group_id, master, confidence, n_pairs, avg_affinity FROM {GROUPS} g JOIN {REPORT} r ON g.group_id = r.group_id)"


def joined(spark, d):
    report = consolidation.group_report(pairs(spark, d), "group_id", "affinity")
    return groups(spark, d).join(report.select("group_id", "n_pairs", "avg_affinity"), "group_id")


@query(f"""SELECT *, count(*) OVER () AS total FROM {JOINED} WHERE avg_affinity >= 0.8 AND suffix(master, '.py') AND contains(lower(master), 'backup')
    ORDER BY avg_affinity DESC, n_pairs DESC, master LIMIT 20 OFFSET 10""")
def sibling_group_page(spark, d):
    sort = [F.desc("avg_affinity"), F.desc("n_pairs")]
    return consolidation.sibling_groups(joined(spark, d), "master", ".py", "BACKUP", 0.8, sort, limit=20, offset=10)


@query(f"SELECT group_id, confidence FROM {GROUPS} WHERE confidence >= 0.9")
def confident_proposals(spark, d):
    return groups(spark, d).filter(F.col("confidence") >= 0.9).select("group_id", "confidence")


@query(f"SELECT group_id, n, affinity FROM {PAIRS} WHERE affinity >= 0.9")
def high_affinity_pairs(spark, d):
    return consolidation.in_band(pairs(spark, d), "affinity", 0.9).select("group_id", "n", "affinity")


@query(f"SELECT group_id, n, affinity FROM {PAIRS} WHERE affinity >= 0.7 AND affinity < 0.95")
def affinity_band(spark, d):
    return consolidation.in_band(pairs(spark, d), "affinity", 0.7, 0.95).select("group_id", "n", "affinity")


@query(f"SELECT g.*, n_siblings FROM {GROUPS} g JOIN (SELECT group_id, count(*) AS n_siblings FROM {PAIRS} WHERE affinity >= 0.95 GROUP BY 1) s ON g.group_id = s.group_id")
def identical_siblings(spark, d):
    return consolidation.proposals_with_siblings(groups(spark, d), pairs(spark, d), "group_id", "affinity", 0.95)


@query(f"""SELECT *, CASE WHEN contains(lower(master), 'backup/') THEN 'ignore' WHEN avg_affinity >= 0.95 THEN 'keep_master' WHEN avg_affinity >= 0.7 THEN 'merge' ELSE 'ignore' END AS suggested_action
    FROM {JOINED} WHERE confidence >= 0.7""")
def batch_suggestions(spark, d):
    return consolidation.batch_actions(joined(spark, d), "master", ["Backup/"])


@query("""WITH a AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'merge' WHEN o_orderkey % 3 = 1 THEN 'keep_master' ELSE 'ignore' END AS action FROM orders),
    r AS (SELECT l_partkey, l_quantity, action, l_linenumber = 1 AS m FROM lineitem JOIN a ON l_orderkey = o_orderkey)
    SELECT (SELECT count(*) FROM orders) AS total_groups, count(*) FILTER (action = 'merge') AS files_to_merge, count(*) FILTER (action = 'keep_master' AND NOT m) AS files_to_delete,
    coalesce(sum(l_quantity) FILTER (action = 'keep_master' AND NOT m), 0) AS bytes_to_recover, count(DISTINCT l_partkey) FILTER (action = 'merge' OR (action = 'keep_master' AND NOT m)) AS affected_files,
    2 * count(DISTINCT l_partkey) FILTER (action = 'merge' OR (action = 'keep_master' AND NOT m)) AS imports_to_update FROM r""")
def batch_dry_run(spark, d):
    k = F.col("o_orderkey")
    actions = table(spark, d, "orders").select(k.alias("l_orderkey"), F.when(k % 3 == 0, "merge").when(k % 3 == 1, "keep_master").otherwise("ignore").alias("action"))
    members = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", (F.col("l_linenumber") == 1).alias("is_master"))
    return consolidation.batch_impact(actions, members, "l_orderkey", "l_partkey", "l_quantity", "is_master")


@query("""WITH one AS (SELECT p_name, p_brand, max(p_type) AS h FROM part GROUP BY 1, 2) SELECT p_name, count(*)::INT AS n_projects, count(DISTINCT h) AS n_versions,
    string_agg(p_brand || '=' || h, ';' ORDER BY p_brand) AS versions FROM one GROUP BY 1 HAVING count(*) > 1 AND count(DISTINCT h) > 1""")
def version_pivot(spark, d):
    out = consolidation.version_pivot(table(spark, d, "part"), "p_name", "p_brand", "p_type")
    text = F.array_join(F.transform(F.map_entries("versions"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return out.select("p_name", "n_projects", "n_versions", text.alias("versions"))


@query("""SELECT p_name AS name, path AS keeper, n_files, bytes - p_size AS bytes_saved FROM (SELECT *, count(*) OVER (PARTITION BY p_name) AS n_files, sum(p_size) OVER (PARTITION BY p_name) AS bytes,
    row_number() OVER (PARTITION BY p_name ORDER BY p_partkey % 3 = 0, p_size DESC, length(path), path) AS r FROM (SELECT *, 'src/' || p_partkey || '.py' AS path FROM part)) WHERE r = 1""")
def duplicate_keepers(spark, d):
    files = table(spark, d, "part").select(F.col("p_name").alias("name"), F.concat(F.lit("src/"), "p_partkey", F.lit(".py")).alias("path"), F.col("p_size").cast("long").alias("size"), (F.col("p_partkey") % 3 == 0).alias("copy"))
    return consolidation.keepers(files, "name", "path", "size", F.col("copy")).select("name", "keeper", "n_files", "bytes_saved")


@query("""SELECT p_partkey, p_size, best FROM part JOIN (SELECT p_brand AS b, max(l_quantity * 20) AS best FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) ON b = p_brand WHERE best > 500 AND p_size < 0.01 * best""")
def best_replacements(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    found = table(spark, d, "lineitem").join(part.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey").select("p_brand", (F.col("l_quantity") * 20).alias("p_size"))
    return consolidation.replacements(part, found, "p_brand", "p_size", 500, 0.01).select("p_partkey", "p_size", "best")


TREE = "(SELECT CASE WHEN p_partkey % 4 = 0 THEN 'src/tests/test_m' || (p_partkey - 1) WHEN p_partkey % 4 = 2 THEN 'src/m' || (p_partkey - 1) || '_test' ELSE 'src/m' || p_partkey END || '.py' AS path FROM part)"


def tree(spark, d):
    k = F.col("p_partkey")
    name = F.when(k % 4 == 0, F.concat(F.lit("src/tests/test_m"), k - 1)).when(k % 4 == 2, F.concat(F.lit("src/m"), k - 1, F.lit("_test"))).otherwise(F.concat(F.lit("src/m"), k))
    return table(spark, d, "part").select(F.concat(name, F.lit(".py")).alias("path"))


@query(f"""WITH t AS {TREE} SELECT path, regexp_matches(path, '(^|/)test_[^/]*$') OR regexp_matches(path, '_test\\.py$') OR EXISTS (SELECT 1 FROM t u WHERE
    u.path IN (regexp_replace(t.path, 'src/(m\\d+)\\.py', 'src/tests/test_\\1.py'), regexp_replace(t.path, 'src/(m\\d+)\\.py', 'src/\\1_test.py')) AND u.path <> t.path) AS has_tests FROM t""")
def files_with_tests(spark, d):
    return consolidation.test_presence(tree(spark, d), "path")


@query(f"SELECT part, count(*) AS n FROM (SELECT unnest(string_split(path, '/')[:-2]) AS part FROM {TREE}) GROUP BY 1")
def folder_patterns(spark, d):
    return consolidation.folder_patterns(tree(spark, d), "path")


@query("""SELECT folder, count(*) AS n FROM (SELECT CASE WHEN contains(lower(p_type), 'steel') OR contains(lower(p_type), 'tin') THEN 'metal' WHEN contains(lower(p_type), 'large') THEN 'big' ELSE 'misc' END AS folder FROM part) GROUP BY 1""")
def category_folders(spark, d):
    return table(spark, d, "part").groupBy(consolidation.category(F.col("p_type"), [(["steel", "tin"], "metal"), (["large"], "big")], "misc").alias("folder")).agg(F.count("*").alias("n"))


@query("""SELECT p_brand, p_partkey, score, position::INT AS position, CASE WHEN position = 1 THEN coalesce(round(least(0.5 + (score - nxt) / 50, 1.0), 2), 0.8) END AS confidence FROM
    (SELECT p_brand, p_partkey, p_size * 1.0::DOUBLE AS score, row_number() OVER w AS position, lead(p_size * 1.0::DOUBLE) OVER w AS nxt FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey))""")
def quality_ranking(spark, d):
    out = consolidation.version_ranks(table(spark, d, "part").select("p_brand", "p_partkey", "p_size"), "p_brand", F.col("p_size").cast("double"), "p_partkey")
    return out.select("p_brand", "p_partkey", "score", "position", "confidence")


EDGES = "(SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst, l_linenumber AS lineno FROM lineitem QUALIFY dst IS NOT NULL AND dst <> src)"


def edges(spark, d):
    after = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), after.alias("dst"), F.col("l_linenumber").alias("lineno")).filter("dst is not null and dst <> src")


@query(f"""WITH e AS (SELECT DISTINCT src, dst FROM {EDGES}), f AS (SELECT p_partkey AS file FROM part WHERE p_size <= 5), c AS (SELECT dst, count(*) FILTER (src IN (SELECT file FROM f)) AS i,
    count(*) FILTER (src NOT IN (SELECT file FROM f)) AS x FROM e GROUP BY 1) SELECT file, coalesce(i, 0) AS internal, coalesce(x, 0) AS external, coalesce(i, 0) * 10 + coalesce(x, 0) AS score FROM f LEFT JOIN c ON dst = file""")
def deletion_order(spark, d):
    return impact.deletion_order(edges(spark, d), table(spark, d, "part").filter("p_size <= 5").select(F.col("p_partkey").alias("file")), "file")


@query(f"SELECT dst, src, array_to_string(list_sort(list(DISTINCT lineno)), ',') AS lines FROM {EDGES} WHERE dst IN (SELECT p_partkey FROM part WHERE p_size = 1) GROUP BY 1, 2")
def import_lines(spark, d):
    out = impact.import_lines(edges(spark, d), table(spark, d, "part").filter("p_size = 1"), "p_partkey")
    return out.select("dst", "src", F.array_join(F.col("lines").cast("array<string>"), ",").alias("lines"))


@query(f"""WITH g AS (SELECT p_brand AS group_id, p_partkey AS file, p_partkey = min(p_partkey) OVER (PARTITION BY p_brand) AS is_master FROM part), u AS (SELECT g.group_id, e.src, g.is_master FROM {EDGES} e JOIN g ON e.dst = g.file
    WHERE NOT EXISTS (SELECT 1 FROM g h WHERE h.group_id = g.group_id AND h.file = e.src)), c AS (SELECT group_id, count(DISTINCT src) AS n_affected, count(*) FILTER (NOT is_master) AS n_changes FROM u GROUP BY 1)
    SELECT s.group_id, n_files, coalesce(n_affected, 0) AS n_affected, coalesce(n_changes, 0) AS n_changes, coalesce(n_changes, 0) <= 10 AS safe FROM (SELECT group_id, count(*) AS n_files FROM g GROUP BY 1) s LEFT JOIN c ON s.group_id = c.group_id""")
def group_impact(spark, d):
    part = table(spark, d, "part").select(F.col("p_brand").alias("group_id"), F.col("p_partkey").alias("file"))
    first = part.groupBy("group_id").agg(F.min("file").alias("m"))
    return impact.group_impact(edges(spark, d), part.join(first, "group_id").select("group_id", "file", (F.col("file") == F.col("m")).alias("is_master")))


@query(f"SELECT src, count(*) AS n_rewrites FROM {EDGES} WHERE dst IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#11') AND src NOT IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#11') GROUP BY 1")
def merge_impact(spark, d):
    return impact.merge_impact(edges(spark, d), table(spark, d, "part").filter("p_brand = 'Brand#11'"), "p_partkey")


MODULES = "(SELECT p_partkey AS id, 'lib/' || CASE WHEN p_size % 2 = 0 THEN 'a/' ELSE 'b/' END || 'm' || p_size || '.py' AS path, 'lib.' || CASE WHEN p_partkey % 3 = 0 THEN 'a' ELSE 'b' END || '.m' || (p_size % 20) AS module FROM part)"


def module_table(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    path = F.concat(F.lit("lib/"), F.when(size % 2 == 0, "a/").otherwise("b/"), F.lit("m"), size, F.lit(".py"))
    module = F.concat(F.lit("lib."), F.when(k % 3 == 0, "a").otherwise("b"), F.lit(".m"), size % 20)
    return table(spark, d, "part").select(k.alias("id"), path.alias("path"), module.alias("module"))


@query(f"WITH m AS {MODULES} SELECT DISTINCT a.path AS src, b.path AS dst FROM m a JOIN m b ON regexp_extract(a.module, '[^.]*$') = regexp_extract(b.path, '([^/]*)\\.py$', 1) WHERE a.path <> b.path")
def stem_edges(spark, d):
    m = module_table(spark, d)
    return impact.stem_edges(m.select("path", "module").distinct(), m.select("path").distinct())


@query(f"WITH m AS {MODULES} SELECT a.id, a.module, (SELECT arg_min(b.path, b.id) FROM m b WHERE b.path = replace(a.module, '.', '/') || '.py') AS dst FROM m a WHERE dst IS NOT NULL")
def module_first_match(spark, d):
    m = module_table(spark, d)
    return impact.first_path_match(m.select(F.col("id").alias("path"), "module"), m.select("id", "path")).select(F.col("path").alias("id"), "module", "dst")


@query(f"SELECT DISTINCT path FROM {MODULES} WHERE contains(module, 'a.m1') AND path <> 'lib/b/m1.py'")
def dependents_like(spark, d):
    m = module_table(spark, d).withColumn("names", F.array().cast("array<string>"))
    return impact.dependents_by_name(m, "a.m1", F.col("path") == "lib/b/m1.py")


@query("""WITH i AS (SELECT s_suppkey AS id, unnest(['./util', './a/../util', '../lib/core', '@/x/../app', 'react', './gone']) AS module FROM supplier) SELECT 'src/p' || id || '/main.js' AS path, module,
    CASE WHEN module = 'react' THEN 'third_party' ELSE 'local' END AS kind, CASE WHEN module LIKE './%util' THEN 'src/p' || id || '/util.ts' WHEN module = '../lib/core' THEN 'src/lib/core/index.js' WHEN module = '@/x/../app' THEN 'src/app.jsx' END AS resolved FROM i""")
def js_imports(spark, d):
    folder = F.concat(F.lit("src/p"), "s_suppkey")
    s = table(spark, d, "supplier").select(F.concat(folder, F.lit("/main.js")).alias("path"), F.concat(folder, F.lit("/util.ts")).alias("util"))
    imports = s.select("path", F.explode(F.array(*[F.lit(x) for x in ("./util", "./a/../util", "../lib/core", "@/x/../app", "react", "./gone")])).alias("module"))
    fixed = spark.createDataFrame([("src/lib/core/index.js",), ("src/app.jsx",)], "path string")
    return impact.resolve_js(imports, s.select("path").union(s.select("util")).union(fixed))


INDEX = "round(least(100.0, greatest(0.0, least(100.0, 171 - 0.23 * greatest(p_size / 5.0, 1.0) * (p_partkey % 7) - 16.2 * ln(greatest(p_size * 20, 1)))) + CASE WHEN p_size > 40 THEN 5 ELSE 0 END + CASE WHEN p_size % 2 = 0 THEN 5 ELSE 0 END + CASE WHEN p_size % 3 = 0 THEN 2 ELSE 0 END + CASE WHEN p_size % 5 = 0 THEN 5 ELSE 0 END), 2)"


def indexed(spark, d):
    size = F.col("p_size")
    share = F.when(size > 40, 0.9).otherwise(0.1)
    i = quality.maintainability(size * 20, size / 5.0, F.col("p_partkey") % 7, share, F.when(size % 2 == 0, 0.6).otherwise(0.5), size % 3 == 0, size % 5 == 0)
    return table(spark, d, "part").select("p_partkey", "p_size", i.alias("mi"))


@query(f"SELECT p_partkey, {INDEX} AS mi FROM part")
def quality_index(spark, d):
    return indexed(spark, d).select("p_partkey", "mi")


@query(f"SELECT bucket, count(*) AS n, round(avg(mi), 4) AS mean_index FROM (SELECT mi, CASE WHEN mi >= 80 THEN 'excellent' WHEN mi >= 60 THEN 'good' WHEN mi >= 40 THEN 'moderate' WHEN mi >= 20 THEN 'poor' ELSE 'critical' END AS bucket FROM (SELECT {INDEX} AS mi FROM part)) GROUP BY 1")
def maintainability_buckets(spark, d):
    return quality.buckets(indexed(spark, d), "mi")


@query(f"""SELECT p_partkey, round(score, 2) AS score, round(score / 100 * 0.2, 6) AS factor FROM (SELECT p_partkey, round(0.25 * (30 + 50 * 0.5 + least(p_size, 20)) + 0.15 * least(p_size * 3, 100) + 0.25 * greatest(0, 100 - 10 * (p_size % 4) - greatest(5 * (p_size / 5.0 - 5), 0.0)
    - CASE WHEN p_size > 45 THEN 20 ELSE 0 END) + 0.15 * (CASE WHEN p_size % 5 = 0 THEN 50 ELSE 0 END + least(5 * (p_size % 13), 50)) + 0.1 * least(20 * (p_size % 7), 100) + 0.1 * {INDEX}, 2) AS score FROM part)""")
def weighted_quality(spark, d):
    size = F.col("p_size")
    docs = quality.documentation(F.lit(True), F.lit(0.5), size / 100)
    inner = quality.structure(size % 4, size / 5.0, F.when(size > 45, 120).otherwise(10))
    score = quality.quality_score(docs, size * 3.0, inner, quality.testing(size % 5 == 0, size % 13), (size % 7) * 20.0, F.col("mi"))
    out = indexed(spark, d).select("p_partkey", score.alias("score"))
    return out.withColumn("factor", F.round(quality.master_factor(F.col("score")), 6))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 10")
def hotspots(spark, d):
    return quality.hotspots(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), "l_extendedprice", ["l_orderkey", "l_linenumber"])


SUGGESTIONS = """(SELECT o_custkey AS file, o_orderkey AS id, 'rule' || (o_orderkey % 4) AS rule, CASE WHEN o_orderpriority[1] = '1' THEN 'high' WHEN o_orderpriority[1] IN ('2', '3') THEN 'medium' ELSE 'low' END AS severity,
    CASE WHEN o_orderstatus = 'F' THEN 'high' WHEN o_orderstatus = 'O' THEN 'medium' ELSE 'low' END AS impact, CASE WHEN o_orderkey % 2 = 0 THEN 'low' ELSE 'high' END AS effort FROM orders)"""


def suggestions(spark, d):
    k, p = F.col("o_orderkey"), F.substring("o_orderpriority", 1, 1)
    return table(spark, d, "orders").select(
        F.col("o_custkey").alias("file"), k.alias("id"), F.concat(F.lit("rule"), k % 4).alias("rule"), F.when(p == "1", "high").when(p.isin("2", "3"), "medium").otherwise("low").alias("severity"),
        F.when(F.col("o_orderstatus") == "F", "high").when(F.col("o_orderstatus") == "O", "medium").otherwise("low").alias("impact"), F.when(k % 2 == 0, "low").otherwise("high").alias("effort"),
    )


@query(f"SELECT rule, severity, count(*) AS n FROM {SUGGESTIONS} GROUP BY 1, 2")
def suggestion_counts(spark, d):
    return quality.suggestion_counts(suggestions(spark, d))


@query(f"SELECT * FROM {SUGGESTIONS} ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, CASE impact WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, id LIMIT 10")
def priority_suggestions(spark, d):
    return quality.priorities(suggestions(spark, d), ["id"])


@query(f"SELECT id FROM {SUGGESTIONS} WHERE effort = 'low' AND impact IN ('medium', 'high')")
def quick_wins(spark, d):
    return quality.quick_wins(suggestions(spark, d)).select("id")


@query(f"""SELECT c_custkey AS file, CASE WHEN n = 0 THEN 100.0 ELSE round(greatest(0.0, least(100.0, b * CASE WHEN least(n / 100, 5.0) > 1 THEN 1 + (least(n / 100, 5.0) - 1) * 0.1 ELSE 1 END)), 4) END AS score
    FROM (SELECT c_custkey, (c_custkey % 700)::DOUBLE AS n, 100 - coalesce(cost, 0.0) AS b FROM customer LEFT JOIN (SELECT file, sum(CASE severity WHEN 'high' THEN 5.0 WHEN 'medium' THEN 2.0 ELSE 0.5 END)::DOUBLE AS cost FROM {SUGGESTIONS} GROUP BY 1) ON c_custkey = file)""")
def refactoring_scores(spark, d):
    files = table(spark, d, "customer").select(F.col("c_custkey").alias("file"), (F.col("c_custkey") % 700).alias("lines"))
    return quality.refactoring_score(suggestions(spark, d), files, "file", "lines")


@query("SELECT l_partkey AS path, count(*) AS n_dead, sum(l_quantity)::BIGINT AS lines_saved FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1")
def dead_savings(spark, d):
    dead = table(spark, d, "lineitem").filter("l_returnflag = 'R'").withColumnRenamed("l_partkey", "path")
    return quality.savings(dead, "path", F.col("l_quantity").cast("long"))


@query("""WITH v AS (SELECT user_id AS path, CASE event_id % 9 WHEN 0 THEN 'LIMIT' WHEN 1 THEN 'logger' WHEN 2 THEN '__all__' ELSE 'v' || (event_id % 40) END AS name, event_type FROM events),
    w AS (SELECT DISTINCT path, name FROM v WHERE event_type <> 'view' AND name NOT IN ('LIMIT', 'logger', '__all__')) SELECT path, name, 0.8 AS confidence FROM w WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.path = w.path AND v.name = w.name AND event_type = 'view')""")
def dead_variables(spark, d):
    k = F.col("event_id")
    name = F.when(k % 9 == 0, "LIMIT").when(k % 9 == 1, "logger").when(k % 9 == 2, "__all__").otherwise(F.concat(F.lit("v"), k % 40))
    v = table(spark, d, "events").select(F.col("user_id").alias("path"), name.alias("name"), "event_type")
    return quality.dead_variables(v.filter("event_type <> 'view'").select("path", "name").distinct(), v.filter("event_type = 'view'"))


@query("SELECT p_partkey, p_size FROM part WHERE p_size > 10 AND p_partkey % 3 <> 0")
def magic_numbers(spark, d):
    rows = table(spark, d, "part").withColumn("name", F.when(F.col("p_partkey") % 3 == 0, "LIMIT").otherwise("limit"))
    return quality.magic_numbers(rows, "p_size").select("p_partkey", "p_size")


@query("""WITH x AS (SELECT o_custkey, o_orderkey, o_orderstatus || o_orderpriority AS s FROM orders) SELECT x.o_custkey AS file, first, o_orderkey AS other FROM x JOIN (SELECT o_custkey, s, min(o_orderkey) AS first FROM x GROUP BY 1, 2) y
    ON x.o_custkey = y.o_custkey AND x.s = y.s WHERE o_orderkey > first""")
def same_shape(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("file"), "o_orderkey", F.array("o_orderstatus", "o_orderpriority", F.lit("x"), F.lit("y")).alias("shape"))
    return quality.same_shape(rows, "file", "shape", "o_orderkey")


@query("""WITH t AS (SELECT doc_id, source, string_split(text, chr(10)) AS l, text FROM documents WHERE text IS NOT NULL), a AS (SELECT * FROM t WHERE doc_id % 2 = 0), b AS (SELECT * FROM t WHERE doc_id % 2 = 1)
    SELECT a.doc_id AS a, b.doc_id AS b, len(list_distinct(list_intersect(a.l, b.l)))::INT AS common_lines FROM a JOIN b ON a.doc_id + 1 = b.doc_id""")
def common_lines(spark, d):
    t = table(spark, d, "documents").filter("text is not null").select("doc_id", "text")
    x, y = t.filter("doc_id % 2 = 0").alias("x"), t.filter("doc_id % 2 = 1").alias("y")
    return x.join(y, F.col("x.doc_id") + 1 == F.col("y.doc_id")).select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"), compare.common_lines(F.col("x.text"), F.col("y.text")).alias("common_lines"))


@query("""SELECT o_orderkey, '- ' || o_orderstatus || chr(10) || '+ x' AS differences FROM orders""")
def line_differences(spark, d):
    a, b = F.concat(F.lit("same\n"), "o_orderstatus"), F.lit("x\nsame")
    return table(spark, d, "orders").select("o_orderkey", F.array_join(compare.line_differences(a, b), "\n").alias("differences"))


@query("""WITH f AS (SELECT p_name AS name, p_partkey AS path, p_type AS hash, list_sort([p_brand, p_type]) AS args, p_size AS lines FROM part), s AS (SELECT x.name, x.path AS a, y.path AS b, CASE WHEN x.hash = y.hash THEN 1.0 ELSE
    (len(list_intersect(x.args, y.args)) / len(list_distinct(list_concat(x.args, y.args))) + 1 - abs(x.lines - y.lines) / greatest(x.lines, y.lines, 1)) / 2 END AS score FROM f x JOIN f y ON x.name = y.name WHERE x.path % 2 = 0 AND y.path % 2 = 1)
    SELECT name, a, b, round(score, 4) AS score FROM s WHERE round(score, 4) >= 0.5""")
def function_matches(spark, d):
    f = table(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("path"), F.col("p_type").alias("hash"), F.array("p_brand", "p_type").alias("args"), F.col("p_size").alias("lines"))
    return compare.function_matches(f.filter("path % 2 = 0"), f.filter("path % 2 = 1"), 0.5)


@query("""WITH t AS (SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey <= 100) SELECT * FROM t UNION ALL SELECT (SELECT max(id) FROM t) + row_number() OVER (ORDER BY s_name, s_suppkey), s_name FROM supplier""")
def catalog_insert(spark, d):
    old = table(spark, d, "customer").filter("c_custkey <= 100").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    new = materialize(table(spark, d, "supplier").select(F.col("s_name").alias("name"), "s_suppkey"), "new")
    return catalog_writes.insert(old, new, "id", ["name", "s_suppkey"])


@query("""SELECT 'nation' AS t, count(*) AS n FROM nation WHERE n_regionkey <> 1 UNION ALL SELECT 'customer', count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 1
    UNION ALL SELECT 'orders', count(*) FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 1 UNION ALL SELECT 'region', count(*) FROM region WHERE r_regionkey <> 1""")
def catalog_cascade(spark, d):
    keys = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "orders": "o_orderkey"}
    tables = {t: table(spark, d, t).withColumn("id", F.col(k)) for t, k in keys.items()}
    parents = {"nation": ("region", "n_regionkey"), "customer": ("nation", "c_nationkey"), "orders": ("customer", "o_custkey")}
    out = catalog_writes.cascade(tables, parents, "region", tables["region"].filter("id = 1"), "id")
    counts = [rows.agg(F.lit(t).alias("t"), F.count("*").alias("n")).select("t", "n") for t, rows in out.items()]
    return counts[0].union(counts[1]).union(counts[2]).union(counts[3])


@query("""WITH l AS (SELECT user_id, ts, CASE event_type WHEN 'error' THEN 'remove' WHEN 'signup' THEN 'toggle' ELSE 'open' END AS action FROM events), c AS (SELECT user_id, max(ts) FILTER (action = 'remove') AS cut FROM l GROUP BY 1)
    SELECT l.user_id, count(*) FILTER (action = 'open') AS use_count, max(ts) AS last_used, count(*) FILTER (action = 'toggle') % 2 = 1 AS favourite FROM l JOIN c ON l.user_id = c.user_id WHERE cut IS NULL OR ts > cut
    GROUP BY 1 HAVING count(*) FILTER (action = 'open') > 0""")
def open_history(spark, d):
    action = F.when(F.col("event_type") == "error", "remove").when(F.col("event_type") == "signup", "toggle").otherwise("open")
    return catalog_writes.history(table(spark, d, "events").select("user_id", "ts", action.alias("action")), "user_id", "ts", "action")


@query("""SELECT o_orderkey, count(l_linenumber) FILTER (l_linenumber <> 1) AS sibling_count FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def proposal_rows(spark, d):
    g = table(spark, d, "orders").select("o_orderkey", F.lit(1).alias("master"))
    members = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_discount")
    return catalog_writes.proposals(g, members, "o_orderkey", "l_linenumber", "master", F.col("l_discount"))[0].select("o_orderkey", "sibling_count")
