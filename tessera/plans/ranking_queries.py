"""Queries of windows, similarity, graph, search, learning and event operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as fn
from tessera.operators import catalog, dedup, evolution, graph, learn, search, similarity
from tessera.operators.components import components
from tessera.plans.catalog_queries import query
from tessera.sources.storage import table
from tessera.streaming import changes


@query("""SELECT * FROM (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3""")
def top_per_group(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return catalog.top_per_group(rows, ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3)


SCORE = "0.1 * p_size + p_retailprice / 1000 - CASE WHEN contains(p_name, 'old') THEN 10 ELSE 0 END"


@query(f"""SELECT p_brand, p_partkey, round(score, 4) AS score, confidence FROM (SELECT p_brand, p_partkey, score, rank, CASE WHEN score > 0 THEN
    round(least(1.0, 0.5 + 0.5 * (score - coalesce(nxt, 0.0)) / score), 4) ELSE 0.5 END AS confidence FROM (SELECT *, row_number() OVER w AS rank, lead(score) OVER w AS nxt
    FROM (SELECT *, {SCORE} AS score FROM part) WINDOW w AS (PARTITION BY p_brand ORDER BY score DESC, p_partkey))) WHERE rank = 1""")
def master_election(spark, d):
    score = 0.1 * F.col("p_size") + F.col("p_retailprice") / 1000 - F.when(F.contains("p_name", F.lit("old")), 10).otherwise(0)
    ranked = dedup.elect(table(spark, d, "part"), ["p_brand"], score, "p_partkey").filter("rank = 1")
    return ranked.select("p_brand", "p_partkey", F.round("score", 4).alias("score"), "confidence")


@query("""SELECT o_custkey, o_orderkey, row_number() OVER w AS pos, CAST(epoch(o_orderdate) - epoch(first_value(o_orderdate) OVER w) AS BIGINT) AS seconds_from_first,
    round(o_totalprice - first_value(o_totalprice) OVER w, 2) AS price_delta FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def timeline_deltas(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", F.col("o_totalprice").alias("price"))
    out = evolution.timeline(rows, "o_custkey", "o_orderdate", "o_orderkey", ["price"])
    return out.select("o_custkey", "o_orderkey", "pos", "seconds_from_first", F.round("price_delta", 2).alias("price_delta"))


@query("""SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS oldest, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS newest, count(*) AS n_versions FROM orders GROUP BY o_custkey""")
def oldest_newest(spark, d):
    return evolution.first_and_last(table(spark, d, "orders"), "o_custkey", "o_orderdate", "o_orderkey")


PATH = "('/' || CASE WHEN event_id % 7 = 0 THEN 'backup/' WHEN event_id % 5 = 0 THEN 'src/core/' ELSE 'app/' END || event_id)"


@query(f"""WITH v AS (SELECT user_id, ts, {PATH} AS path FROM events), s AS (SELECT user_id, path, CASE WHEN ts = min(ts) OVER (PARTITION BY user_id) THEN 30 ELSE 0 END
    + CASE WHEN len(string_split(path, '/')) = min(len(string_split(path, '/'))) OVER (PARTITION BY user_id) THEN 15 ELSE 0 END
    + CASE WHEN contains(path, 'src/') OR contains(path, 'lib/') OR contains(path, 'core/') THEN 10 ELSE 0 END - CASE WHEN contains(path, 'backup') THEN 20 ELSE 0 END AS score FROM v)
    SELECT user_id, path, score FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, path) AS rn FROM s) WHERE rn = 1""")
def likely_original(spark, d):
    e = table(spark, d, "events")
    folder = F.when(F.col("event_id") % 7 == 0, "backup/").when(F.col("event_id") % 5 == 0, "src/core/").otherwise("app/")
    return evolution.likely_original(e.select("user_id", "ts", F.concat(F.lit("/"), folder, "event_id").alias("path")), "user_id", "path", "ts")


@query("""SELECT p_type, p_brand, n_variants, versions FROM (SELECT p_type, p_brand, count(DISTINCT p_size) AS n_variants, list_sort(list(DISTINCT p_name)) AS versions FROM part GROUP BY 1, 2) WHERE n_variants > 1""")
def conflicts(spark, d):
    return evolution.conflicts(table(spark, d, "part"), ["p_type", "p_brand"], "p_size", "p_name")


@query("SELECT p_brand, arg_max(p_partkey, (p_size, -p_partkey)) AS p_partkey FROM part GROUP BY p_brand")
def best_per_name(spark, d):
    return evolution.best_per_name(table(spark, d, "part"), ["p_brand"], [F.col("p_size"), (-F.col("p_partkey")).alias("k")], "p_partkey")


MASTER_SQL = "SELECT p_brand AS g, min(p_partkey) AS m FROM part GROUP BY 1"


@query(f"""WITH m AS ({MASTER_SQL}), p AS (SELECT p_partkey, p_brand, list_distinct(string_split(p_name, ' ') || [p_type]) AS words FROM part)
    SELECT a.p_partkey AS sibling, m.m AS master, round(len(list_intersect(a.words, b.words)) / len(list_distinct(list_concat(a.words, b.words))), 6) AS jaccard
    FROM p a JOIN m ON a.p_brand = m.g JOIN p b ON b.p_partkey = m.m WHERE a.p_partkey <> m.m""")
def jaccard_to_master(spark, d):
    """Every sibling against its group's master: one pair per row, no pairs among siblings."""
    rows = table(spark, d, "part").select("p_partkey", "p_brand", F.array_union(F.split("p_name", " "), F.array("p_type")).alias("words"))
    pairs = similarity.master_pairs(rows, "p_brand", "p_partkey")
    return pairs.select(F.col("x.p_partkey").alias("sibling"), F.col("m.p_partkey").alias("master"), F.round(fn.jaccard(F.col("x.words"), F.col("m.words")), 6).alias("jaccard"))


@query("""SELECT q, id, cosine, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY cosine DESC, id) AS rank FROM (SELECT a.vec_id AS q, b.vec_id AS id,
    round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)) WHERE rank <= 5""")
def cosine_search(spark, d):
    """The five nearest vectors of the same label for the query vectors, the ids divisible by 20."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("e"), "label")
    return search.nearest(rows, rows.filter("id % 20 = 0").withColumnRenamed("id", "q"), 5, by="label")


@query("""SELECT q, id, cosine, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY cosine DESC, id) AS rank FROM (SELECT a.vec_id AS q, b.vec_id AS id,
    round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)) WHERE rank <= 5""")
def cosine_search_all(spark, d):
    """The five nearest vectors of any label for the query vectors, the ids divisible by 20."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("e"))
    return search.nearest(rows, rows.filter("id % 20 = 0").withColumnRenamed("id", "q"), 5)


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS i FROM lineitem)
    SELECT a.l_orderkey AS g, count(*) AS n FROM r a JOIN r b ON a.l_orderkey = b.l_orderkey AND a.i < b.i AND b.i * (b.i - 1) / 2 + a.i < 500 GROUP BY 1""")
def sibling_pairs_capped(spark, d):
    """The stated number of compared pairs per group is this operator's own limit."""
    rows = table(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("k"))
    pairs = similarity.group_pairs(rows, "l_orderkey", "k", cap=500)
    return pairs.groupBy(F.col("x.l_orderkey").alias("g")).agg(F.count("*").alias("n"))


def _index(x: str) -> str:
    return f"least(100.0, greatest(0.0, (171 - 5.2 * ln({x} * log2({x} + 1) + 1) - 0.23 * p_size - 16.2 * ln({x} + 1) + 50 * 0.1) * 100 / 171))"


@query(f"SELECT p_partkey, round({_index('p_retailprice')}, 2) AS mi, CASE WHEN p_size >= 21 THEN 'very_high' WHEN p_size >= 11 THEN 'high' WHEN p_size >= 6 THEN 'moderate' ELSE 'low' END AS risk FROM part")
def maintainability_index(spark, d):
    return table(spark, d, "part").select("p_partkey", fn.maintainability(F.col("p_retailprice"), F.col("p_size"), F.lit(0.1)).alias("mi"), fn.risk_level(F.col("p_size")).alias("risk"))


EDGE_SQL = """e AS (SELECT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS dst FROM lineitem) WHERE dst IS NOT NULL)"""


def edges(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"))
    return rows.filter("dst is not null")


START = "(SELECT min(src) FROM e)"


@query(f"""WITH RECURSIVE {EDGE_SQL}, r(node) AS (SELECT {START} UNION SELECT dst FROM r JOIN e ON src = node) SELECT node FROM r""")
def reachability(spark, d):
    e = edges(spark, d)
    return graph.reachable(e, e.agg(F.min("src").alias("node"))).select("node")


@query(f"""WITH RECURSIVE {EDGE_SQL}, r(node) AS (SELECT (SELECT max(dst) FROM e) UNION SELECT src FROM r JOIN e ON dst = node) SELECT node FROM r""")
def impact_transitive(spark, d):
    e = edges(spark, d)
    return graph.impact(e, e.agg(F.max("dst").alias("node"))).select("node")


@query(f"WITH {EDGE_SQL} SELECT dst AS node, list_sort(list(DISTINCT src)) AS dependents, count(*) AS n_imports FROM e GROUP BY dst")
def reverse_edges(spark, d):
    return graph.reversed_edges(edges(spark, d))


@query(f"WITH {EDGE_SQL} SELECT DISTINCT a.src AS a, a.dst AS b FROM e a JOIN e b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst")
def two_cycles(spark, d):
    return graph.two_cycles(edges(spark, d))


@query(f"""WITH {EDGE_SQL}, u AS (SELECT DISTINCT src, dst FROM e), o AS (SELECT src AS node, count(*) AS n FROM u GROUP BY 1), i AS (SELECT dst AS node, count(*) AS n FROM u GROUP BY 1)
    SELECT coalesce(o.node, i.node) AS node, coalesce(o.n, 0) AS efferent, coalesce(i.n, 0) AS afferent, round(coalesce(o.n, 0) / (coalesce(o.n, 0) + coalesce(i.n, 0)), 4) AS instability FROM o FULL JOIN i ON o.node = i.node""")
def coupling(spark, d):
    return graph.coupling(edges(spark, d))


@query(f"""WITH RECURSIVE {EDGE_SQL}, u AS (SELECT src AS a, dst AS b FROM e WHERE src <> dst UNION SELECT dst, src FROM e WHERE src <> dst),
    r(node, c) AS (SELECT a, a FROM u UNION SELECT u.b, r.c FROM r JOIN u ON r.node = u.a AND u.b > r.c) SELECT node, min(c) AS component FROM r GROUP BY 1""")
def component_labels(spark, d):
    return components(edges(spark, d).filter("src <> dst"), "src", "dst").select("node", "component")


@query(f"""WITH {EDGE_SQL}, n AS (SELECT p_partkey AS node FROM part), u AS (SELECT DISTINCT src, dst FROM e)
    SELECT n.node, 2 * ca + ce AS score, CASE WHEN ca = 0 AND ce = 0 THEN 'isolated' WHEN ca = 0 THEN 'entry' WHEN ca >= 5 THEN 'core' ELSE 'inner' END AS role
    FROM (SELECT node, (SELECT count(*) FROM u WHERE dst = node) AS ca, (SELECT count(*) FROM u WHERE src = node) AS ce FROM n) n""")
def importance(spark, d):
    return graph.importance(table(spark, d, "part").select(F.col("p_partkey").alias("node")), edges(spark, d))


@query(f"""WITH {EDGE_SQL} SELECT (SELECT count(*) FROM part) AS n_nodes, (SELECT count(*) FROM e) AS n_edges,
    (SELECT count(*) FROM part WHERE p_partkey NOT IN (SELECT src FROM e UNION SELECT dst FROM e)) AS isolated, round((SELECT count(*) FROM e) / (SELECT count(*) FROM part), 4) AS mean_degree""")
def graph_stats(spark, d):
    return graph.graph_stats(table(spark, d, "part").select(F.col("p_partkey").alias("node")), edges(spark, d))


@query(f"""WITH RECURSIVE {EDGE_SQL}, r(node, depth) AS (SELECT {START}, 0 UNION SELECT dst, depth + 1 FROM r JOIN e ON src = node WHERE depth < 12)
    SELECT node, min(depth) AS depth FROM r GROUP BY node HAVING min(depth) <= 3""")
def chain_depths(spark, d):
    e = edges(spark, d)
    return graph.reachable(e, e.agg(F.min("src").alias("node")), max_depth=3)


TOKENS = r"regexp_extract_all(lower(text), '([a-z]{2,})', 1)"


@query("""SELECT token, count(DISTINCT doc_id) AS n_entries FROM (SELECT doc_id, unnest(regexp_extract_all(' ' || regexp_replace(lower(text), '[^a-z0-9_]', '  ', 'g') || ' ', ' ([a-z]{2,}) ', 1)) AS token FROM documents) GROUP BY 1""")
def token_counts(spark, d):
    return search.document_frequency(search.build(table(spark, d, "documents"), "doc_id", None, "text"))


@query("""WITH t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(' ' || regexp_replace(lower(text), '[^a-z0-9_]', '  ', 'g') || ' ', ' ([a-z]{2,}) ', 1)) AS token FROM documents)
    SELECT doc_id AS id, 5.0 * count(*) AS score FROM t WHERE token IN ('the', 'license', 'idiot', 'reserved') GROUP BY 1 ORDER BY score DESC, id LIMIT 50""")
def index_search_topk(spark, d):
    index = search.build(table(spark, d, "documents"), "doc_id", None, "text")
    return search.score(index, ["the", "license", "idiot", "reserved"]).orderBy(F.col("score").desc(), "id").limit(50)


@query("SELECT p_partkey, string_split(p_name, ' ') AS parts FROM part")
def name_split(spark, d):
    return table(spark, d, "part").select("p_partkey", fn.split_name(F.col("p_name")).alias("parts"))


@query("""WITH v AS (SELECT o_custkey, o_orderpriority, o_totalprice, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders),
    s AS (SELECT o_custkey, o_orderpriority, sum(o_totalprice) AS w FROM v WHERE rn <= 10 GROUP BY 1, 2), r AS (SELECT *, sum(w) OVER (PARTITION BY o_custkey) AS total, row_number() OVER (PARTITION BY o_custkey ORDER BY w DESC) AS rn FROM s)
    SELECT o_custkey, o_orderpriority, round(w, 2) AS weight, round(w / total, 3) AS confidence FROM r WHERE rn = 1""")
def weighted_vote(spark, d):
    out = learn.weighted_vote(table(spark, d, "orders"), "o_custkey", "o_orderpriority", "o_totalprice", "o_orderkey")
    return out.select("o_custkey", "o_orderpriority", F.round("weight", 2).alias("weight"), F.round("confidence", 3).alias("confidence"))


@query("""SELECT lang, source, n, share, rank FROM (SELECT lang, source, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY lang), 4) AS share,
    row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, source) AS rank FROM documents GROUP BY 1, 2) WHERE rank <= 3""")
def common_patterns_top3(spark, d):
    return learn.common_choices(table(spark, d, "documents"), "lang", "source")


@query("SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_tumbling(spark, d):
    return changes.windows(table(spark, d, "events"), "ts", "event_type", "15 minutes")


@query("""SELECT time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 15 MINUTE * k AS start, event_type, count(*) AS n FROM events CROSS JOIN (SELECT unnest([0, 1]) AS k) GROUP BY 1, 2""")
def event_sliding(spark, d):
    return changes.windows(table(spark, d, "events"), "ts", "event_type", "30 minutes", "15 minutes")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, sid""")
def event_session(spark, d):
    return changes.debounced(table(spark, d, "events"), "user_id", "ts", "30 minutes")


@query("""WITH a AS (SELECT user_id AS k, count(*)::VARCHAR AS h FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1), b AS (SELECT user_id AS k, count(*)::VARCHAR AS h FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1)
    SELECT coalesce(a.k, b.k) AS path, CASE WHEN a.k IS NULL THEN 'created' WHEN b.k IS NULL THEN 'deleted' ELSE 'modified' END AS change, a.h AS old_hash, b.h AS new_hash FROM a FULL JOIN b ON a.k = b.k WHERE a.h IS DISTINCT FROM b.h""")
def change_feed(spark, d):
    """Each user's activity before and after the middle of the month, as two snapshots."""
    early = F.col("ts") < F.lit("2024-01-15").cast("timestamp")
    state = lambda when: table(spark, d, "events").filter(when).groupBy(F.col("user_id").alias("path")).agg(F.count("*").cast("string").alias("hash"))
    return changes.snapshot_diff(state(early), state(~early))


@query("""WITH u AS (SELECT user_id, max(ts) AS ts FROM events GROUP BY 1) SELECT e.user_id, e.event_id FROM events e JOIN u ON e.user_id = u.user_id AND e.ts = u.ts""")
def incremental_upsert(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", "ts")
    half = F.col("ts") < F.lit("2024-01-15").cast("timestamp")
    old = changes.upsert(rows.filter(half), rows.limit(0), "user_id", "ts")
    new = changes.upsert(rows.filter(~half), rows.limit(0), "user_id", "ts")
    late = new.join(old.select(F.col("user_id").alias("u"), F.col("ts").alias("t")), F.col("user_id") == F.col("u"), "left").filter("t is null or ts > t").select(rows.columns)
    return changes.upsert(late, old, "user_id", "ts").select("user_id", "event_id")


@query()
def ratio_to_master(spark, d):
    """Matching-blocks ratio of every part's name and its brand's master's name."""
    pairs = similarity.master_pairs(table(spark, d, "part").select("p_partkey", "p_brand", "p_name"), "p_brand", "p_partkey")
    return pairs.select(F.col("x.p_partkey").alias("sibling"), F.col("m.p_partkey").alias("master"), F.round(similarity.sequence_ratio(F.col("x.p_name"), F.col("m.p_name")), 4).alias("ratio"))


SHINGLES = "SELECT DISTINCT k, unnest([array_to_string(w[i:i + 7], ' ') for i in range(1, len(w) - 6)]) AS g FROM (SELECT {0} AS k, list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM {1}) WHERE len(w) >= 8"


@query(f"""WITH d AS ({SHINGLES.format('doc_id', 'documents')}), q AS ({SHINGLES.format('item_id', 'benchmark')}), n AS (SELECT k, count(*) AS n FROM q GROUP BY 1)
    SELECT d.k AS row_key, q.k AS query_key, round(count(*) / any_value(n.n), 4) AS share FROM d JOIN q ON d.g = q.g JOIN n ON q.k = n.k GROUP BY 1, 2""")
def origin_matches(spark, d):
    """Share of each benchmark item that is found in a document."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("key"), "text")
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("key"), F.col("text").alias("item_text"))
    return similarity.contained_in(docs, "text", items, "item_text")
