"""Cross-post, backbone and graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearsay.functions import scalar as S
from hearsay.operators import backbone as B
from hearsay.operators import crosspost as C
from hearsay.operators import graph as G
from hearsay.plans import views as V
from hearsay.plans.registry import query

SEEDS = [f"n{i}" for i in range(8)]
WINDOW = (800_000_000, 1_000_000_000)

PARENT_ROWS = """SELECT subreddit, parent_subreddit AS crosspost_parent, subreddit_subscribers,
    parent_subscribers AS crosspost_parent_subs, author, parent_num AS crosspost_parent_num
    FROM {seen} WHERE parent_subreddit IS NOT NULL AND parent_subreddit NOT LIKE 'u\\_%' ESCAPE '\\'
    AND subreddit NOT LIKE 'u\\_%' ESCAPE '\\'"""
CHILD_ROWS = """SELECT c.subreddit, p.subreddit AS crosspost_parent, c.subreddit_subscribers,
    p.subreddit_subscribers AS crosspost_parent_subs, p.author,
    p.num_crossposts AS crosspost_parent_num
    FROM discovery c JOIN discovery p ON substring(c.crosspost_parent, 4) = p.id
    WHERE c.num_crossposts = 0 AND p.num_crossposts > 0
    AND c.url IN (SELECT url FROM {seen} WHERE num_crossposts > 0)
    AND p.url IN (SELECT url FROM {seen} WHERE num_crossposts > 0)
    AND p.subreddit NOT LIKE 'u\\_%' ESCAPE '\\' AND c.subreddit NOT LIKE 'u\\_%' ESCAPE '\\'"""
PAIRS = """SELECT subreddit, crosspost_parent, subreddit_subscribers,
    crosspost_parent_subs, "count", crosspost_parent_num,
    CAST(sum("count") OVER (PARTITION BY crosspost_parent) AS BIGINT) AS total FROM
    (SELECT subreddit, crosspost_parent, round(avg(subreddit_subscribers), 6)
       AS subreddit_subscribers,
       CAST(trunc(coalesce(avg(crosspost_parent_subs), 0)) AS BIGINT) AS crosspost_parent_subs,
       count(author) AS "count", CAST(sum(crosspost_parent_num) AS BIGINT) AS crosspost_parent_num
     FROM ({rows}) GROUP BY 1, 2)"""


def _pairs(df):
    return r6(df, "subreddit_subscribers")


def r6(df, *cols):
    return df.select(*[F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns])


@query("crosspost_parents", "N01 A01 F04 P05 P06 J02 W01 D02", "discovery",
       PAIRS.format(rows=PARENT_ROWS.format(seen="discovery")))
def crosspost_parents(spark, d):
    return _pairs(C.parents(V.discovery(spark, d)))


@query("crosspost_children", "N02 A02 S04 P13 F06 J01", "discovery",
       PAIRS.format(rows=CHILD_ROWS.format(seen="discovery")))
def crosspost_children(spark, d):
    posts = V.discovery(spark, d)
    return _pairs(C.children(posts, posts))


@query("crossposted_urls", "A02", "discovery",
       "SELECT url, CAST(sum(num_crossposts) AS BIGINT) AS num_crossposts, max(id) AS id "
       "FROM discovery WHERE num_crossposts > 0 GROUP BY 1")
def crossposted_urls(spark, d):
    return C.crossposted_urls(V.discovery(spark, d))


@query("crosspost_ratio", "A03 D03", "discovery",
       "SELECT subreddit, count(crosspost_parent) AS crosspost_parent, "
       "count(CASE WHEN num_crossposts > 0 THEN 1 END) AS crosspost_child, "
       "count(subreddit_subscribers) AS total, "
       "round(count(crosspost_parent) / count(subreddit_subscribers)::DOUBLE, 9) "
       "AS crosspost_parent_share, round(count(CASE WHEN num_crossposts > 0 THEN 1 END) / "
       "count(subreddit_subscribers)::DOUBLE, 9) AS crosspost_child_share "
       "FROM discovery GROUP BY 1")
def crosspost_ratio(spark, d):
    out = C.ratio(V.discovery(spark, d))
    return out.select("subreddit", "crosspost_parent", "crosspost_child", "total", *[
        F.round(c, 9).alias(c) for c in ("crosspost_parent_share", "crosspost_child_share")])


@query("next_frontier", "U14 U04", "discovery",
       f"SELECT DISTINCT s AS subreddit FROM (SELECT subreddit AS s FROM ({PARENT_ROWS.format(seen='discovery')}) "
       f"UNION SELECT crosspost_parent FROM ({PARENT_ROWS.format(seen='discovery')})) "
       f"WHERE s NOT IN {tuple(SEEDS)}")
def next_frontier(spark, d):
    known = spark.createDataFrame([(s,) for s in SEEDS], "subreddit string")
    return C.frontier(C.parents(V.discovery(spark, d)), known)


def _seen(name, source):
    return f"""{name} AS (SELECT * FROM discovery
        WHERE created_utc BETWEEN {WINDOW[0]} AND {WINDOW[1]} AND subreddit IN {source})"""


EXPAND = f"""{_seen('seen1', tuple(SEEDS))},
    found1 AS (SELECT *, 1 AS round FROM ({PAIRS.format(rows=PARENT_ROWS.format(seen='seen1'))})
      UNION ALL SELECT *, 1 AS round FROM ({PAIRS.format(rows=CHILD_ROWS.format(seen='seen1'))})),
    front AS (SELECT subreddit FROM found1 UNION SELECT crosspost_parent FROM found1
      EXCEPT SELECT unnest({SEEDS!r})),
    {_seen('seen2', '(SELECT subreddit FROM front)')},
    found2 AS (SELECT *, 2 AS round FROM ({PAIRS.format(rows=PARENT_ROWS.format(seen='seen2'))})
      UNION ALL SELECT *, 2 AS round FROM ({PAIRS.format(rows=CHILD_ROWS.format(seen='seen2'))}))"""


@query("expand_network", "N03 U01 U14", "discovery",
       "SELECT * FROM found1 UNION ALL SELECT * FROM found2", EXPAND)
def expand_network(spark, d):
    seeds = spark.createDataFrame([(s,) for s in SEEDS], "subreddit string")
    found = C.expand(V.discovery(spark, d), seeds, *WINDOW, depth=3)
    return _pairs(found.edges)


# ---------------------------------------------------------------- backbones

def r9(df, *cols):
    return df.select(*[F.round(c, 9).alias(c) if c in cols else F.col(c) for c in df.columns])


NC = """nc0 AS (SELECT e.*, sum(nij) OVER (PARTITION BY src) AS s, sum(nij) OVER (PARTITION BY trg) AS t,
      (SELECT sum(nij) FROM edges) AS n FROM edges e),
    nc1 AS (SELECT *, s * t / n / n AS p, n / (s * t) AS kappa,
      s * t * (n - s) * (n - t) / (n * n * n * n * (n - 1)) AS v FROM nc0),
    nc2 AS (SELECT *, p * p / v * (1 - p) - p + nij AS a,
      n - nij + p / v * (1 - p * p) - (1 - p) AS b,
      1 / (s * t) - n * (s + t) / ((s * t) * (s * t)) AS d FROM nc1),
    nc AS (SELECT src, trg, nij, (kappa * nij - 1) / (kappa * nij + 1) AS score,
      sqrt(a / (a + b) * (1 - a / (a + b)) * n
        * pow(2 * (kappa + nij * d) / pow(kappa * nij + 1, 2), 2)) AS sdev_cij
      FROM nc2 WHERE src <> trg)"""
DF = """df0 AS (SELECT e.*, sum(nij) OVER (PARTITION BY src) AS s,
      CAST(count(*) OVER (PARTITION BY src) AS DOUBLE) AS k FROM {edges} e),
    df AS (SELECT src, trg, nij, 1 - pow(1 - nij / s, k - 1) AS score,
      k * k * ((20 + 4 * k) / ((k + 1) * (k + 2) * (k + 3)) - 4 / ((k + 1) * (k + 1))) AS variance
      FROM df0 WHERE src <> trg)"""
DFS = DF.format(edges="edges_wide")
DFE = DF.format(edges="edges")
DFB = DF.format(edges="edges_big")
ONE_WAY = "arg_min({col}, src * 1000000000 + trg)"


@query("edge_prepare", "N04 S12", "edges_wide",
       "SELECT src, trg, nij FROM (SELECT *, row_number() OVER (PARTITION BY src, trg ORDER BY g, nij) "
       "AS rn FROM (SELECT src, trg, nij, 0 AS g FROM edges_wide WHERE src <> trg UNION ALL "
       "SELECT trg, src, nij, 1 FROM edges_wide WHERE src <> trg)) WHERE rn = 1")
def edge_prepare(spark, d):
    return B.prepare(V.edges_wide(spark, d), self_loops=False, triangular=True)


@query("edge_counts", "N20 S12", "edges_wide",
       "SELECT (SELECT count(DISTINCT n) FROM (SELECT src AS n FROM edges_wide UNION SELECT trg "
       "FROM edges_wide)) AS n_nodes, CAST(count(*) AS DOUBLE) AS n_edges FROM edges_wide")
def edge_counts(spark, d):
    return G.size(V.edges_wide(spark, d))


@query("nc_score", "N09 J03 W01 W02 F22", "edges",
       "SELECT src, trg, nij, round(score, 9) AS score, round(sdev_cij, 9) AS sdev_cij FROM nc", NC)
def nc_score(spark, d):
    return r9(B.noise_corrected(V.edges(spark, d)), "score", "sdev_cij")


@query("nc_undirected", "N09", "edges",
       "SELECT src, trg, nij, round(score, 9) AS score, round(sdev_cij, 9) AS sdev_cij FROM nc "
       "WHERE src <= trg", NC)
def nc_undirected(spark, d):
    return r9(B.noise_corrected(V.edges(spark, d), undirected=True), "score", "sdev_cij")


@query("nc_big", "N09", "edges_big",
       "SELECT src, trg, nij, round(score, 9) AS score, round(sdev_cij, 9) AS sdev_cij FROM nc",
       NC.replace("FROM edges", "FROM edges_big"))
def nc_big(spark, d):
    return r9(B.noise_corrected(V.edges_big(spark, d)), "score", "sdev_cij")


PVALUE = """st AS (SELECT e.*, s, t, n AS total FROM edges e JOIN (SELECT src, sum(nij) AS s FROM edges GROUP BY 1) USING (src)
    JOIN (SELECT trg, sum(nij) AS t FROM edges GROUP BY 1) USING (trg), (SELECT sum(nij) AS n FROM edges)),
  pr AS (SELECT src, trg, nij, total AS n, (s * t / total) * (1 / total) AS p FROM st),
  terms AS (SELECT src, trg, j, -2 * n * atanh(p / (2 - p)) + coalesce(sum(CASE WHEN j > 0 THEN ln((n - j + 1) / j * p / (1 - p)) END)
      OVER (PARTITION BY src, trg ORDER BY j), 0) AS l FROM (SELECT *, unnest(range(0, CAST(nij AS BIGINT) + 1)) AS j FROM pr))"""


@query("nc_pvalue", "N10", "edges", "SELECT e.src, e.trg, e.nij, round(p, 8) AS score FROM edges e JOIN "
       "(SELECT src, trg, sum(exp(l)) AS p FROM terms GROUP BY 1, 2) USING (src, trg)", PVALUE)
def nc_pvalue(spark, d):
    scored = B.noise_corrected(V.edges(spark, d), p_value=True)
    return scored.withColumn("score", F.round("score", 8))


@query("disparity_table", "N12 J04", "edges_wide",
       "SELECT src, trg, nij, round(score, 9) AS score, round(variance, 9) AS variance FROM df", DFS)
def disparity_table(spark, d):
    return r9(B.disparity(V.edges_wide(spark, d)), "score", "variance")


@query("disparity_big", "N12", "edges_big",
       "SELECT src, trg, nij, round(score, 9) AS score, round(variance, 9) AS variance FROM df", DFB)
def disparity_big(spark, d):
    return r9(B.disparity(V.edges_big(spark, d)), "score", "variance")


@query("disparity_table_undirected", "N12 F28 D04 W06", "edges_wide",
       f"SELECT {ONE_WAY.format(col='src')} AS src, {ONE_WAY.format(col='trg')} AS trg, "
       f"{ONE_WAY.format(col='nij')} AS nij, round(max(score), 9) AS score, "
       "round(min(variance), 9) AS variance FROM df GROUP BY least(src, trg), greatest(src, trg)", DFS)
def disparity_table_undirected(spark, d):
    return r9(B.disparity(V.edges_wide(spark, d), undirected=True), "score", "variance")


@query("naive_directed", "N14", "edges_wide",
       "SELECT src, trg, nij, nij AS score FROM edges_wide WHERE src <> trg")
def naive_directed(spark, d):
    return B.naive(V.edges_wide(spark, d))


@query("naive_undirected", "N14 W06", "edges_wide",
       f"SELECT {ONE_WAY.format(col='src')} AS src, {ONE_WAY.format(col='trg')} AS trg, "
       f"{ONE_WAY.format(col='nij')} AS nij, sum(nij) / 2 AS score FROM edges_wide "
       "WHERE src <> trg GROUP BY least(src, trg), greatest(src, trg)")
def naive_undirected(spark, d):
    return B.naive(V.edges_wide(spark, d), undirected=True)


UND = """pair AS (SELECT least(src, trg) AS lo, greatest(src, trg) AS hi, max(nij) AS nij
      FROM edges_wide GROUP BY 1, 2),
    loc AS (SELECT node, sum(nij) AS s, count(*) AS k FROM (SELECT lo AS node, nij FROM pair
      UNION ALL SELECT hi, nij FROM pair WHERE lo <> hi) GROUP BY 1),
    au AS (SELECT lo AS src, hi AS trg, nij,
      least(CASE WHEN a.k > 1 THEN round(pow(1 - nij / a.s, a.k - 1), 4) END,
            CASE WHEN b.k > 1 THEN round(pow(1 - nij / b.s, b.k - 1), 4) END) AS alpha
      FROM pair JOIN loc a ON lo = a.node JOIN loc b ON hi = b.node)"""
DIR = """ad0 AS (SELECT e.*, sum(nij) OVER (PARTITION BY src) AS so, count(*) OVER (PARTITION BY src) AS ko,
      sum(nij) OVER (PARTITION BY trg) AS si, count(*) OVER (PARTITION BY trg) AS ki
      FROM edges_wide e),
    ad AS (SELECT src, trg, nij, CASE WHEN ko = 1 AND ki = 1 THEN 0.0::DOUBLE WHEN ko > 1 THEN
      round(pow(1 - nij / so, ko - 1), 4) END AS alpha_out, CASE WHEN ko = 1 AND ki = 1 THEN 0.0::DOUBLE
      WHEN ki > 1 THEN round(pow(1 - nij / si, ki - 1), 4) END AS alpha_in FROM ad0)"""


@query("alpha_undirected", "N17", "edges_wide", "SELECT * FROM au WHERE alpha IS NOT NULL", UND)
def alpha_undirected(spark, d):
    return B.alpha_undirected(V.edges_wide(spark, d))


@query("alpha_directed", "N18", "edges_wide", "SELECT * FROM ad", DIR)
def alpha_directed(spark, d):
    return B.alpha_directed(V.edges_wide(spark, d))


@query("alpha_cut_undirected", "N19", "edges_wide",
       "SELECT src, trg, nij FROM au WHERE coalesce(alpha, 1) < 0.4", UND)
def alpha_cut_undirected(spark, d):
    return B.alpha_cut(B.alpha_undirected(V.edges_wide(spark, d)), 0.4)


@query("alpha_cut_or", "N19", "edges_wide",
       "SELECT src, trg, nij FROM ad WHERE coalesce(alpha_in, 1) < 0.4 OR coalesce(alpha_out, 1) < 0.4",
       DIR)
def alpha_cut_or(spark, d):
    return B.alpha_cut(B.alpha_directed(V.edges_wide(spark, d)), 0.4, "or")


@query("alpha_cut_and", "N19", "edges_wide",
       "SELECT src, trg, nij FROM ad WHERE coalesce(alpha_in, 1) < 0.4 AND coalesce(alpha_out, 1) < 0.4",
       DIR)
def alpha_cut_and(spark, d):
    return B.alpha_cut(B.alpha_directed(V.edges_wide(spark, d)), 0.4, "and")


@query("threshold_score", "N05 L08", "edges_wide",
       "SELECT src, trg, nij, round(score, 9) AS score FROM df WHERE score > 0.5", DFS)
def threshold_score(spark, d):
    kept = B.threshold(B.disparity(V.edges_wide(spark, d)), 0.5)
    return r9(kept, "score").orderBy(F.desc("score"), "src", "trg")


@query("threshold_sdev", "N05", "edges",
       "SELECT src, trg, nij, round(score, 9) AS score FROM nc WHERE score - 1.0 * sdev_cij > 0", NC)
def threshold_sdev(spark, d):
    return r9(B.threshold(B.noise_corrected(V.edges(spark, d)), 1.0), "score")


@query("density_sweep", "N08 D07", "edges_wide",
       """SELECT threshold, nodes, round(100.0 * nodes / onodes, 6) AS pct_nodes, edges,
          round(100.0 * edges / oedges, 6) AS pct_edges,
          round(2.0 * edges / nullif(nodes, 0), 6) AS avg_degree,
          round((2.0 * edges / nullif(nodes, 0)) / (2.0 * oedges / onodes), 6) AS rel_degree FROM
          (SELECT t AS threshold, (SELECT count(*) FROM df WHERE score > t) AS edges,
            (SELECT count(DISTINCT n) FROM (SELECT src AS n, score FROM df UNION ALL
              SELECT trg, score FROM df) WHERE score > t) AS nodes FROM steps),
          (SELECT count(*) AS oedges FROM df), (SELECT count(DISTINCT n) AS onodes FROM
            (SELECT src AS n FROM df UNION ALL SELECT trg FROM df))""",
       DFS + ", steps AS (SELECT unnest([0.0, 0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875, 1.0]::DOUBLE[]) AS t)")
def density_sweep(spark, d):
    out = B.density_sweep(B.disparity(V.edges_wide(spark, d)), 0.0, 1.0, 0.125)
    six = ("pct_nodes", "pct_edges", "avg_degree", "rel_degree")
    return out.select(*[F.round(c, 6).alias(c) if c in six else F.col(c) for c in out.columns])


TWO = NC + ", " + DFE + """, one AS (SELECT src, trg, nij, score FROM nc WHERE score - sdev_cij > 0),
    two AS (SELECT src, trg, nij, score FROM df WHERE score > 0.5)"""


def _two(spark, d):
    return (B.threshold(B.noise_corrected(V.edges(spark, d)), 1.0),
            B.threshold(B.disparity(V.edges(spark, d)), 0.5))


@query("stability_jaccard", "N06 U05", "edges",
       "SELECT round((SELECT count(*) FROM (SELECT src, trg FROM one INTERSECT SELECT src, trg FROM two)) "
       "/ CAST((SELECT count(*) FROM (SELECT src, trg FROM one UNION SELECT src, trg FROM two)) "
       "AS DOUBLE), 9) AS jaccard", TWO)
def stability_jaccard(spark, d):
    return r9(B.stability_jaccard(*_two(spark, d)), "jaccard")


RANKS = """SELECT round(corr(rx, ry), 9) AS correlation FROM (SELECT
    rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx,
    rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM {pairs})"""


@query("stability_spearman", "N07 J05 J06", "edges",
       RANKS.format(pairs="(SELECT a.score AS x, b.score AS y FROM nc a JOIN df b USING (src, trg))"), TWO)
def stability_spearman(spark, d):
    return r9(B.stability_corr(B.noise_corrected(V.edges(spark, d)),
                               B.disparity(V.edges(spark, d)), what="score"), "correlation")


@query("stability_spearman_big", "N07", "edges_big",
       RANKS.format(pairs="(SELECT nij AS x, round(score, 6) AS y FROM df)"), DFB)
def stability_spearman_big(spark, d):
    edges = V.edges_big(spark, d)
    scored = B.disparity(edges).select("src", "trg", F.round("score", 6).alias("nij"))
    return r9(B.stability_corr(edges, scored), "correlation")


@query("stability_pearson_log", "N07 F22", "edges",
       "SELECT round(corr(ln(a.nij), ln(b.nij + b.src)), 9) AS correlation FROM nc a JOIN df b USING (src, trg)",
       TWO)
def stability_pearson_log(spark, d):
    other = B.disparity(V.edges(spark, d)).withColumn("nij", F.col("nij") + F.col("src"))
    return r9(B.stability_corr(B.noise_corrected(V.edges(spark, d)), other, "pearson", log=True),
              "correlation")


@query("weighted_degree", "N23", "edges_wide",
       "SELECT node, sum(nij) AS weighted_degree, count(*) AS degree FROM (SELECT src AS node, nij "
       "FROM edges_wide UNION ALL SELECT trg, nij FROM edges_wide) GROUP BY 1")
def weighted_degree(spark, d):
    return G.weighted_degree(V.edges_wide(spark, d))


@query("subgraph_top", "N22", "edges_big",
       "SELECT src, trg, nij FROM edges_big WHERE src IN (SELECT node FROM top) AND trg IN "
       "(SELECT node FROM top)",
       "top AS (SELECT node FROM (SELECT src AS node, nij FROM edges_big UNION ALL SELECT trg, nij "
       "FROM edges_big) GROUP BY 1 ORDER BY sum(nij) DESC, node LIMIT 300)")
def subgraph_top(spark, d):
    edges = V.edges_big(spark, d)
    return G.subgraph(edges, G.top_nodes(edges, 300))


@query("modularity", "N21", "edges",
       """SELECT round(sum(coalesce(w_in, 0) / m - pow(deg / (2 * m), 2)), 9) AS modularity FROM
          (SELECT lab, sum(nij) AS deg FROM (SELECT l1 AS lab, nij FROM lp UNION ALL
            SELECT l2, nij FROM lp) GROUP BY 1) LEFT JOIN
          (SELECT l1 AS lab, sum(nij) AS w_in FROM lp WHERE l1 = l2 GROUP BY 1) USING (lab),
          (SELECT sum(nij) AS m FROM lp)""",
       """lp AS (SELECT a.n_regionkey AS l1, b.n_regionkey AS l2, nij FROM edges
          JOIN nation a ON src = a.n_nationkey JOIN nation b ON trg = b.n_nationkey)""")
def modularity(spark, d):
    parts = V.table(spark, d, "nation").select(F.col("n_nationkey").alias("node"),
                                               F.col("n_regionkey").alias("label"))
    return r9(G.modularity(V.edges(spark, d), parts), "modularity")


# ---------------------------------------------------------------- iterative

CC = """sym AS MATERIALIZED (SELECT src AS a, trg AS b FROM {e} UNION SELECT trg, src FROM {e}),
    cc(node, component) USING KEY (node) AS (SELECT DISTINCT a AS node, a AS component FROM sym
      UNION SELECT sym.b AS node, min(cc.component) AS component FROM cc
      JOIN sym ON cc.node = sym.a JOIN recurring.cc AS r ON r.node = sym.b
      WHERE cc.component < r.component GROUP BY sym.b)"""


@query("components", "N16", "edges_big", "SELECT node, component FROM cc", CC.format(e="edges_big"))
def components(spark, d):
    return G.components(V.edges_big(spark, d))


@query("components_families", "N16", "discovery", "SELECT node, component FROM cc",
       "fam AS (SELECT DISTINCT id AS src, substring(crosspost_parent, 4) AS trg FROM discovery "
       "WHERE crosspost_parent IS NOT NULL), " + CC.format(e="fam"))
def components_families(spark, d):
    posts = V.discovery(spark, d).where("crosspost_parent IS NOT NULL")
    return G.components(posts.select(F.col("id").alias("src"),
                                     S.strip_id_prefix(F.col("crosspost_parent")).alias("trg")))


@query("mst", "N15 J06")
def mst(spark, d):
    return B.spanning_tree(V.edges_big(spark, d))


def _relax(n):
    return f"""d{n} AS (SELECT s, v, min(d) AS d FROM (SELECT s, v, d FROM d{n - 1} UNION ALL
        SELECT s, trg, d + 1 / nij FROM d{n - 1} JOIN edges ON v = src) GROUP BY 1, 2)"""


@query("hss", "N13", "edges",
       "SELECT e.src, e.trg, e.nij, round(coalesce(c, 0) / 25.0, 9) AS score FROM edges e LEFT JOIN "
       "(SELECT e.src, e.trg, count(*) AS c FROM edges e JOIN d4 a ON a.v = e.src JOIN d4 b ON "
       "b.s = a.s AND b.v = e.trg WHERE e.src <> e.trg AND abs(a.d + 1 / nij - b.d) <= 1e-12 * b.d "
       "GROUP BY 1, 2) u ON u.src = e.src AND u.trg = e.trg WHERE e.src <> e.trg",
       "d0 AS (SELECT DISTINCT src AS s, src AS v, 0.0::DOUBLE AS d FROM edges), "
       + ", ".join(_relax(n) for n in range(1, 5)))
def hss(spark, d):
    return r9(B.salience(V.edges(spark, d)), "score")


def closure(links: str, n: int) -> str:
    """Widest paths between all nodes by doubling: CTE ``b<n>`` (i, j, w)."""
    parts = [f"b0 AS MATERIALIZED (SELECT i, j, max(w) AS w FROM (SELECT lo AS i, hi AS j, w FROM {links} UNION ALL SELECT hi, lo, w FROM {links}) GROUP BY 1, 2)"]
    for k in range(n):
        parts.append(f"b{k + 1} AS MATERIALIZED (SELECT i, j, max(w) AS w FROM (SELECT * FROM b{k} UNION ALL "
                     f"SELECT x.i, y.j, least(x.w, y.w) FROM b{k} x JOIN b{k} y ON x.j = y.i WHERE x.i <> y.j) GROUP BY 1, 2)")
    return ", ".join(parts)


# an edge is in the tree when no path between its ends has better edges only
TREE = ("und AS (SELECT least(src, trg) AS lo, greatest(src, trg) AS hi, max(nij) AS nij FROM edges WHERE src <> trg GROUP BY 1, 2), "
        "links AS (SELECT *, row_number() OVER (ORDER BY nij, lo, hi) AS w FROM und), " + closure("links", 5))


@query("mst_nations", "N15 J06", "edges",
       "SELECT src, trg, nij, score FROM (SELECT e.src, e.trg, e.nij, l.nij AS score, row_number() OVER (PARTITION BY l.lo, l.hi "
       "ORDER BY e.src, e.trg) AS rn FROM links l JOIN b5 ON i = lo AND j = hi AND b5.w = l.w JOIN edges e ON "
       "least(e.src, e.trg) = lo AND greatest(e.src, e.trg) = hi WHERE l.nij > 0) WHERE rn = 1", TREE)
def mst_nations(spark, d):
    return B.spanning_tree(V.edges(spark, d))


def _scaled(rounds: int) -> str:
    """Row and column factors after so many scalings."""
    parts = ["dense AS MATERIALIZED (SELECT s.src, t.trg, coalesce(sum(nij), 0) + 0.001 AS a FROM (SELECT DISTINCT src FROM edges) s "
             "CROSS JOIN (SELECT DISTINCT trg FROM edges) t LEFT JOIN edges e ON e.src = s.src AND e.trg = t.trg GROUP BY 1, 2)",
             "c0 AS (SELECT DISTINCT trg, 1.0::DOUBLE AS c FROM edges)"]
    for k in range(rounds):
        parts.append(f"r{k + 1} AS MATERIALIZED (SELECT src, 1 / sum(a * c) AS r FROM dense JOIN c{k} USING (trg) GROUP BY 1)")
        parts.append(f"c{k + 1} AS MATERIALIZED (SELECT trg, 1 / sum(a * r) AS c FROM dense JOIN r{k + 1} USING (src) GROUP BY 1)")
    return ", ".join(parts)


SCALINGS = 60
DST = (_scaled(SCALINGS) + f", cells AS MATERIALIZED (SELECT src AS lo, trg AS hi, r * a * c AS w FROM dense JOIN r{SCALINGS} USING (src) "
       f"JOIN c{SCALINGS} USING (trg) WHERE src < trg), " + closure("cells", 5))


@query("dst", "N11", "edges",
       "SELECT e.src, e.trg, e.nij, round(w, 9) AS score FROM cells JOIN edges e ON e.src = lo AND e.trg = hi "
       "WHERE w >= (SELECT min(w) FROM b5)", DST)
def dst(spark, d):
    return r9(B.doubly_stochastic(V.edges(spark, d)), "score")


LABELS = """sums AS (SELECT least(src, trg) AS lo, greatest(src, trg) AS hi, sum(nij) AS nij FROM edges WHERE src <> trg GROUP BY 1, 2),
  ends AS MATERIALIZED (SELECT lo AS node, hi AS other, nij FROM sums UNION ALL SELECT hi, lo, nij FROM sums),
  st AS (SELECT 0 AS step, node, node AS label FROM (SELECT src AS node FROM edges UNION SELECT trg FROM edges)
    UNION ALL
    SELECT step + 1, node, label FROM (
      WITH votes AS (SELECT e.node, o.label, round(sum(e.nij), 9) AS w FROM ends e JOIN st o ON o.node = e.other GROUP BY 1, 2),
      best AS (SELECT v.node, max(w) AS w, arg_min(v.label, struct_pack(a := -w, b := v.label)) AS new,
          coalesce(max(CASE WHEN v.label = s.label THEN w END), 0) AS held FROM votes v JOIN st s ON s.node = v.node GROUP BY 1),
      wanting AS (SELECT node, new, struct_pack(h := md5(CAST(node AS VARCHAR)), n := node) AS turn FROM best WHERE w > held),
      movers AS (SELECT a.node, a.new FROM wanting a WHERE NOT EXISTS (SELECT 1 FROM ends e JOIN wanting b ON b.node = e.other
        WHERE e.node = a.node AND b.turn < a.turn))
      SELECT s.step, s.node, coalesce(m.new, s.label) AS label FROM st s LEFT JOIN movers m ON m.node = s.node
      WHERE EXISTS (SELECT 1 FROM movers)))"""


@query("label_propagation", "N21", "edges", "SELECT node, label FROM st WHERE step = (SELECT max(step) FROM st)", LABELS)
def label_propagation(spark, d):
    return G.propagate_labels(V.edges(spark, d))
