"""Graph queries over the interactions of authors and over threads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmuration.operators import graph as G
from murmuration.operators import modularity as Q
from murmuration.plans.registry import query
from murmuration.sources.tables import posts, table, with_views

LEAST = 0.6
EDGES = f"""{with_views("posts")}, refs AS (SELECT author_id AS src, tox AS own, 'reply' AS kind, parent_id AS ref FROM posts UNION ALL SELECT author_id, tox, 'quote', quoted_id FROM posts UNION ALL SELECT author_id, tox, 'retweet', retweeted_id FROM posts),
 met AS (SELECT r.src, p.author_id AS dst, r.kind, CASE WHEN r.kind = 'reply' THEN r.own ELSE p.tox END AS toxicity FROM refs r JOIN posts p ON p.post_id = r.ref WHERE r.src <> p.author_id),
 edges AS (SELECT src, dst, count(*) AS weight, max(toxicity) AS toxicity, count(*) FILTER (WHERE kind = 'quote') AS n_quote, count(*) FILTER (WHERE kind = 'reply') AS n_reply, count(*) FILTER (WHERE kind = 'retweet') AS n_retweet FROM met WHERE toxicity >= {LEAST} GROUP BY src, dst)"""


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return G.interactions(posts(spark, d), LEAST)


def _pagerank_sql(steps: int) -> str:
    """The iteration written out, one table for each step."""
    parts = [f"""{EDGES}, outs AS (SELECT src, sum(weight)::DOUBLE AS total FROM edges GROUP BY src), shares AS (SELECT e.src, e.dst, weight / total AS p FROM edges e JOIN outs o ON o.src = e.src),
 ids AS MATERIALIZED (SELECT v.id, o.src IS NOT NULL AS linked, count(*) OVER () AS n FROM (SELECT src AS id FROM edges UNION SELECT dst FROM edges) v LEFT JOIN outs o ON o.src = v.id), r0 AS MATERIALIZED (SELECT id, linked, n, 1.0::DOUBLE / n AS rank FROM ids)"""]
    for i in range(1, steps + 1):
        parts.append(f"""r{i} AS MATERIALIZED (SELECT i.id, i.linked, i.n, 0.15::DOUBLE / i.n + 0.85::DOUBLE * (coalesce(g.got, 0) + (SELECT coalesce(sum(rank) FILTER (WHERE NOT linked), 0) FROM r{i - 1}) / i.n) AS rank
 FROM ids i LEFT JOIN (SELECT s.dst AS id, sum(s.p * r.rank) AS got FROM shares s JOIN r{i - 1} r ON r.id = s.src GROUP BY s.dst) g ON g.id = i.id)""")
    return ", ".join(parts)


@query(f"{EDGES} SELECT src, dst, weight, round(toxicity, 4) AS toxicity, n_quote, n_reply, n_retweet FROM edges")
def interaction_edges(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).withColumn("toxicity", F.round("toxicity", 4))


@query(f"{_pagerank_sql(20)} SELECT id, round(rank, 6) AS rank FROM r20")
def pagerank(spark: SparkSession, d: str) -> DataFrame:
    return G.pagerank(G.saved(_edges(spark, d))).select("id", F.round("rank", 6).alias("rank"))


@query(f"{EDGES} SELECT id, CAST(sum(i) AS BIGINT) AS in_weight, CAST(sum(o) AS BIGINT) AS out_weight FROM (SELECT dst AS id, weight AS i, 0 AS o FROM edges UNION ALL SELECT src, 0, weight FROM edges) x GROUP BY id")
def weighted_degree(spark: SparkSession, d: str) -> DataFrame:
    return G.degrees(_edges(spark, d))


def _by_place(spark: SparkSession, d: str) -> DataFrame:
    """Authors grouped by a fixed rule, for statistics that an oracle can follow."""
    return table(spark, d, "events").select(F.col("user_id").alias("id")).distinct().withColumn("community", F.col("id") % 9)


@query(f"{EDGES} SELECT count(*) AS n_edges, round(avg(CASE WHEN src % 9 = dst % 9 THEN 1.0::DOUBLE ELSE 0 END), 4) AS intra_ratio FROM edges")
def intra_ratio(spark: SparkSession, d: str) -> DataFrame:
    return G.intra_ratio(_edges(spark, d), _by_place(spark, d))


@query(f"{_pagerank_sql(20)}, top AS (SELECT id FROM r20 ORDER BY round(rank, 7) DESC, id LIMIT 40) SELECT src, dst, weight FROM edges WHERE src IN (SELECT id FROM top) AND dst IN (SELECT id FROM top)")
def topk_subgraph(spark: SparkSession, d: str) -> DataFrame:
    """The edges among the 40 authors of highest PageRank."""
    edges = G.saved(_edges(spark, d))
    rank = G.pagerank(edges).select("id", F.round("rank", 7).alias("rank"))
    return G.top_subgraph(edges, rank, 40).select("src", "dst", "weight")


@query(f"""{EDGES}, tox AS (SELECT author_id AS id, avg(tox) AS t FROM posts GROUP BY author_id), deg AS (SELECT id, sum(i) AS w FROM (SELECT dst AS id, weight AS i FROM edges UNION ALL SELECT src, 0 FROM edges) x GROUP BY id),
 j AS (SELECT d.id, d.id % 9 AS community, w, t, row_number() OVER (PARTITION BY d.id % 9 ORDER BY w DESC, d.id) AS rn FROM deg d JOIN tox ON tox.id = d.id)
 SELECT community, count(*) AS size, round(avg(t), 4) AS mean_toxicity, string_agg(CAST(id AS VARCHAR), ',' ORDER BY rn) FILTER (WHERE rn <= 5) AS top FROM j GROUP BY community""")
def community_stats(spark: SparkSession, d: str) -> DataFrame:
    rank = G.degrees(_edges(spark, d)).select("id", F.col("in_weight").alias("rank"))
    toxicity = posts(spark, d).groupBy(F.col("author_id").alias("id")).agg(F.avg("tox").alias("toxicity"))
    found = G.community_stats(_by_place(spark, d), rank, toxicity)
    return found.withColumn("top", F.array_join(F.transform("top", lambda x: x.cast("string")), ","))


@query()
def label_communities(spark: SparkSession, d: str) -> DataFrame:
    return G.communities(G.saved(_edges(spark, d)))


@query()
def modularity_communities(spark: SparkSession, d: str) -> DataFrame:
    """(id, community) by modularity; SQL has no such search, so its modularity is held against other partitions in tests."""
    return Q.communities(G.saved(_edges(spark, d)))


@query()
def community_report(spark: SparkSession, d: str) -> DataFrame:
    """Each community found: its size, mean toxicity, members of highest PageRank and the share of its edges that stay inside."""
    edges = G.saved(_edges(spark, d))
    members = G.saved(Q.communities(edges))
    toxicity = posts(spark, d).groupBy(F.col("author_id").alias("id")).agg(F.avg("tox").alias("toxicity"))
    stats = G.community_stats(members, G.pagerank(edges), toxicity)
    side = lambda c, name: members.select(F.col("id").alias(c), F.col("community").alias(name))
    inside = edges.join(side("src", "community"), "src").join(side("dst", "other"), "dst").groupBy("community").agg(F.round(F.avg((F.col("community") == F.col("other")).cast("double")), 4).alias("intra_ratio"))
    return stats.join(inside, "community", "left").withColumn("top", F.array_join(F.transform("top", lambda x: x.cast("string")), ","))


@query()
def sampled_betweenness(spark: SparkSession, d: str) -> DataFrame:
    return G.betweenness(G.saved(_edges(spark, d)))


@query("""WITH RECURSIVE t AS (SELECT conv_id, turn, 0 AS depth FROM conversations WHERE turn = 0 UNION ALL SELECT c.conv_id, c.turn, t.depth + 1 FROM conversations c JOIN t ON t.conv_id = c.conv_id AND t.turn = c.turn - 1)
 SELECT DISTINCT conv_id, turn, CAST(depth AS INTEGER) AS depth FROM t""")
def thread_depth(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").select("conv_id", "turn").distinct()
    at = lambda turn: F.struct("conv_id", turn.alias("turn"))
    keyed = turns.select(at(F.col("turn")).alias("key"), F.when(F.col("turn") > 0, at(F.col("turn") - 1)).alias("parent"))
    found = G.thread_depth(keyed, "key", "parent", most=None)
    return found.where("root.turn = 0").select("key.conv_id", "key.turn", F.col("depth").cast("int").alias("depth"))
