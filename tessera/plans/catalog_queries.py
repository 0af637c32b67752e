"""Queries of the catalog and corpus operators over the Parquet tables, with their SQL.

The tables stand in for a catalog: documents are files (source: project, lang: type), orders and line
items are entities, consecutive parts of an order are an import graph, events are reads and writes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import catalog, dedup
from tessera.sources.storage import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def content_hash():
    return F.sha2("text", 256)


def money(c: str):
    """Exact sums of amounts of two places."""
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("double")


@query("""SELECT sha256(text) AS hash, count(*) AS n_files, min(doc_id) AS original_id, max(n_chars) AS file_chars,
    (count(*) - 1) * max(n_chars) AS wasted_chars FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1""")
def dedup_groups(spark, d):
    return dedup.hash_groups(table(spark, d, "documents"), content_hash(), "n_chars", "doc_id")


@query("""SELECT CAST(sum(n) AS BIGINT) AS total_files, count(*) AS unique_files, CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS duplicate_groups,
    CAST(sum(n - 1) AS BIGINT) AS duplicate_files, CAST(sum((n - 1) * size) AS BIGINT) AS wasted_chars, max(n) AS largest_group
    FROM (SELECT text, count(*) AS n, max(n_chars) AS size FROM documents GROUP BY text)""")
def dedup_summary(spark, d):
    return dedup.summary(table(spark, d, "documents"), content_hash(), "n_chars", "doc_id")


@query("""SELECT doc_id, original FROM (SELECT doc_id, first_value(doc_id) OVER (PARTITION BY text ORDER BY length(source), doc_id) AS original,
    row_number() OVER (PARTITION BY text ORDER BY length(source), doc_id) AS rn FROM documents WHERE text IS NOT NULL) WHERE rn > 1""")
def dedup_original_map(spark, d):
    return dedup.original_map(table(spark, d, "documents"), content_hash(), [F.length("source").alias("len")], "doc_id")


@query("""SELECT sha256(text) AS hash, count(*) AS n_files, (count(*) - 1) * max(n_chars) AS wasted_chars FROM documents
    GROUP BY 1 HAVING count(*) > 1 ORDER BY wasted_chars DESC, hash LIMIT 10""")
def dedup_wasted_top(spark, d):
    groups = dedup.hash_groups(table(spark, d, "documents"), content_hash(), "n_chars", "doc_id")
    return groups.select("hash", "n_files", "wasted_chars").orderBy(F.col("wasted_chars").desc(), "hash").limit(10)


@query("""SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents d WHERE NOT EXISTS
    (SELECT 1 FROM documents e WHERE e.text = d.text AND (length(e.source) < length(d.source) OR (length(e.source) = length(d.source) AND e.doc_id < d.doc_id))) GROUP BY lang""")
def files_without_duplicates(spark, d):
    docs = table(spark, d, "documents")
    twice = dedup.original_map(docs, content_hash(), [F.length("source").alias("len")], "doc_id")
    return dedup.without_duplicates(docs, twice, "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def files_by_type(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"))


@query("""SELECT source, count(*) AS n_files, count(DISTINCT lang) AS n_types, sum(n_chars)::BIGINT AS chars, max(n_chars) AS largest,
    round(avg(n_chars), 2) AS mean_chars FROM documents GROUP BY source""")
def project_stats(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(
        F.count("*").alias("n_files"), F.count_distinct("lang").alias("n_types"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("largest"), F.round(F.avg("n_chars"), 2).alias("mean_chars")
    )


@query("""SELECT c_custkey, c_name, count(o_orderkey) AS n_children FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL""")
def projects_with_counts(spark, d):
    return catalog.parents_with_counts(table(spark, d, "customer"), table(spark, d, "orders"), "c_custkey", "o_custkey", ["c_custkey", "c_name"])


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in TABLES))
def global_counts(spark, d):
    return catalog.counts({t: table(spark, d, t) for t in TABLES})


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%RING%'")
def search_ilike(spark, d):
    return catalog.search(table(spark, d, "part"), "p_name", "RING").select("p_partkey", "p_name")


@query("SELECT p_partkey, p_name, p_size FROM part WHERE p_name ILIKE '%e%' ORDER BY p_name, p_partkey LIMIT 25 OFFSET 50")
def search_paged(spark, d):
    hits = catalog.search(table(spark, d, "part"), "p_name", "e").select("p_partkey", "p_name", "p_size")
    return catalog.page(hits, [F.col("p_name"), F.col("p_partkey")], 25, 50)


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_name ILIKE '%00%' AND contains(lower(c_mktsegment), 'mach') AND c_acctbal >= 0")
def search_scope(spark, d):
    hits = catalog.search(table(spark, d, "customer"), "c_name", "00")
    return catalog.search(hits, "c_mktsegment", "Mach", literal=True).filter("c_acctbal >= 0").select("c_custkey", "c_name", "c_mktsegment")


@query(" UNION ALL ".join(
    f"SELECT * FROM (SELECT '{k}' AS kind, CAST({i} AS BIGINT) AS id, {n} AS name FROM {t} WHERE {n} ILIKE '%r%' ORDER BY {n}, {i} LIMIT 20)"
    for k, t, i, n in (("customer", "customer", "c_custkey", "c_name"), ("supplier", "supplier", "s_suppkey", "s_name"), ("part", "part", "p_partkey", "p_name"))
))
def search_all_kinds(spark, d):
    kinds = {"customer": ("c_custkey", "c_name"), "supplier": ("s_suppkey", "s_name"), "part": ("p_partkey", "p_name")}
    return catalog.search_kinds({t: (table(spark, d, t), *c) for t, c in kinds.items()}, "r", 20)


@query("""SELECT l_orderkey, l_linenumber, o_orderstatus, c_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    WHERE c_mktsegment = 'BUILDING' AND l_quantity > 45""")
def entity_three_way(spark, d):
    line = table(spark, d, "lineitem").filter("l_quantity > 45").select("l_orderkey", "l_linenumber")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    customers = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name")
    return line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey")).select("l_orderkey", "l_linenumber", "o_orderstatus", "c_name")


@query("SELECT event_id, event_type, value FROM events WHERE user_id = 7 ORDER BY ts, event_id")
def data_flow_filter(spark, d):
    return table(spark, d, "events").filter("user_id = 7").orderBy("ts", "event_id").select("event_id", "event_type", "value")


@query("SELECT * FROM orders WHERE o_orderkey = 77")
def point_lookup(spark, d):
    return table(spark, d, "orders").filter("o_orderkey = 77")


@query("""SELECT l_suppkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS users, count(DISTINCT l_returnflag) AS n_users FROM lineitem GROUP BY l_suppkey""")
def module_usage(spark, d):
    return catalog.users_of(table(spark, d, "lineitem"), "l_suppkey", "l_returnflag")


@query("SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 15")
def top_modules(spark, d):
    return catalog.top_values(table(spark, d, "lineitem"), "l_partkey", 15)


@query("""SELECT l_returnflag, count(*) AS n, sum(CASE WHEN l_discount >= 0.08 THEN 1 ELSE 0 END)::BIGINT AS high, sum(CASE WHEN l_discount >= 0.03 AND l_discount < 0.08 THEN 1 ELSE 0 END)::BIGINT AS middle,
    sum(CAST(l_extendedprice AS DECIMAL(18,2)))::DOUBLE AS price, sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS finished FROM lineitem GROUP BY 1""")
def cond_sums(spark, d):
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    x = F.col("l_discount")
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(
        F.count("*").alias("n"), n(x >= 0.08).alias("high"), n((x >= 0.03) & (x < 0.08)).alias("middle"), money("l_extendedprice").alias("price"), n(F.col("l_linestatus") == "F").alias("finished")
    )


@query("""SELECT CASE WHEN v >= 1.0 THEN 'identical' WHEN v >= 0.9 THEN 'very_high' WHEN v >= 0.7 THEN 'high' WHEN v >= 0.5 THEN 'medium' WHEN v >= 0.3 THEN 'low' ELSE 'minimal' END AS label,
    count(*) AS n FROM (SELECT (l_quantity - 1) / 49 AS v FROM lineitem) GROUP BY 1""")
def affinity_histogram(spark, d):
    from tessera.functions.text import affinity_level

    return catalog.histogram(table(spark, d, "lineitem"), affinity_level((F.col("l_quantity") - 1) / 49))


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_unused(spark, d):
    return catalog.used(table(spark, d, "customer"), table(spark, d, "orders"), "c_custkey", "o_custkey", unused=True).select("c_custkey", "c_name")


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity = 50)")
def semi_used(spark, d):
    return catalog.used(table(spark, d, "supplier"), table(spark, d, "lineitem").filter("l_quantity = 50"), "s_suppkey", "l_suppkey").select("s_suppkey", "s_name")


@query("""SELECT lang AS element, count(DISTINCT source) AS n_versions, CASE WHEN count(DISTINCT source) = (SELECT count(DISTINCT source) FROM documents) THEN 'common'
    WHEN count(DISTINCT source) = 1 THEN 'unique' ELSE 'shared' END AS place FROM documents GROUP BY lang""")
def unique_common_elements(spark, d):
    return catalog.unique_and_common(table(spark, d, "documents"), "lang", "source").withColumnRenamed("lang", "element")


@query("SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' UNION SELECT c_custkey FROM customer WHERE c_acctbal > 9000")
def set_union(spark, d):
    a = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"))
    return a.union(table(spark, d, "customer").filter("c_acctbal > 9000").select("c_custkey")).distinct()


@query("SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 9000")
def set_intersect(spark, d):
    a = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"))
    return a.intersect(table(spark, d, "customer").filter("c_acctbal > 9000").select("c_custkey"))


@query("SELECT c_custkey AS k FROM customer WHERE c_acctbal > 9000 EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def set_except(spark, d):
    a = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"))
    return table(spark, d, "customer").filter("c_acctbal > 9000").select(F.col("c_custkey").alias("k")).exceptAll(a.distinct()).distinct()


@query("""SELECT user_id, count(*) FILTER (event_type IN ('view', 'click')) AS n_reads, max(event_id) FILTER (event_type IN ('view', 'click')) AS last_reads,
    count(*) FILTER (event_type NOT IN ('view', 'click')) AS n_writes, max(event_id) FILTER (event_type NOT IN ('view', 'click')) AS last_writes FROM events GROUP BY user_id""")
def data_flow_pivot(spark, d):
    kind = F.when(F.col("event_type").isin("view", "click"), "reads").otherwise("writes")
    return catalog.pivot_by(table(spark, d, "events"), "user_id", kind, "event_id", ["reads", "writes"])


@query("""SELECT user_id, min(ts) FILTER (event_type NOT IN ('view', 'click')) AS first_write, max(ts) FILTER (event_type IN ('view', 'click')) AS last_read, count(*) AS n FROM events GROUP BY user_id""")
def dna_first_write_last_read(spark, d):
    read = F.col("event_type").isin("view", "click")
    return table(spark, d, "events").groupBy("user_id").agg(F.min(F.when(~read, F.col("ts"))).alias("first_write"), F.max(F.when(read, F.col("ts"))).alias("last_read"), F.count("*").alias("n"))


@query("SELECT conv_id, count(*) AS n_messages, sum(length(text))::BIGINT AS chars, max(turn) AS last_turn FROM conversations GROUP BY conv_id")
def conversation_list(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_messages"), F.sum(F.length("text")).alias("chars"), F.max("turn").alias("last_turn"))


@query("SELECT event_type, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS total, max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS top FROM events GROUP BY event_type")
def json_values(spark, d):
    k = F.from_json("props", "k long")["k"]
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("total"), F.max(k).alias("top"))


@query("""SELECT hash, n_files, n_projects FROM (SELECT sha256(text) AS hash, count(*) AS n_files, count(DISTINCT source) AS n_projects FROM documents GROUP BY 1) WHERE n_projects > 1""")
def cross_project_same_hash(spark, d):
    rows = table(spark, d, "documents").select(content_hash().alias("hash"), "source")
    return rows.groupBy("hash").agg(F.count("*").alias("n_files"), F.count_distinct("source").alias("n_projects")).filter("n_projects > 1")


@query("""SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages""")
def page_links(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("href"))
