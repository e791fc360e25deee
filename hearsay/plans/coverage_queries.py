"""Slice, landing and scan queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearsay.functions import scalar as S
from hearsay.operators import coverage as C
from hearsay.plans import views as V
from hearsay.plans.registry import query
from hearsay.sources import posts as P

START, END, N = V.LAND_START, V.LAND_END, V.LAND_SLICES
STEP = (END - START) / N
GRID = f"""communities AS (SELECT DISTINCT subreddit FROM landed_comments),
    slices AS (SELECT CAST(floor({START}.0 + i * {STEP!r}) AS BIGINT) AS slice_start,
                      CAST(floor({START}.0 + (i + 1) * {STEP!r} - 1) AS BIGINT)
                      + CASE WHEN i = {N - 1} THEN 86400 ELSE 0 END AS slice_end
               FROM (SELECT unnest(range({N})) AS i)),
    grid AS (SELECT subreddit, slice_start, slice_end FROM communities, slices),
    landed AS (SELECT subreddit, slice_start, count(*) AS n_rows FROM landed_posts
               JOIN slices ON created_utc BETWEEN slice_start AND slice_end GROUP BY 1, 2),
    landed_c AS (SELECT subreddit, slice_start, count(*) AS n_rows FROM landed_comments
                 JOIN slices ON created_utc BETWEEN slice_start AND slice_end GROUP BY 1, 2)"""
BOTH = "landed_posts landed_comments"


def _communities(spark, d):
    return V.landed_comments(spark, d).select("subreddit").distinct()


def _landed(spark, d):
    return C.landed_slices(V.landed_posts(spark, d), START, END, N)


@query("time_slices", "F11", BOTH, "SELECT * FROM grid", GRID)
def time_slices(spark, d):
    return C.time_slices(_communities(spark, d), START, END, N)


@query("landed_slices", "F11", BOTH, "SELECT * FROM landed", GRID)
def landed_slices(spark, d):
    return _landed(spark, d)


@query("missing_slices", "J09", BOTH,
       "SELECT g.* FROM grid g WHERE NOT EXISTS (SELECT 1 FROM landed l WHERE "
       "l.subreddit = g.subreddit AND l.slice_start = g.slice_start)", GRID)
def missing_slices(spark, d):
    return C.missing_slices(C.time_slices(_communities(spark, d), START, END, N), _landed(spark, d))


@query("landed_anti", "J07", BOTH,
       "SELECT DISTINCT subreddit FROM landed_comments WHERE subreddit NOT IN "
       "(SELECT subreddit FROM landed_posts)")
def landed_anti(spark, d):
    return C.not_landed(_communities(spark, d), V.landed_posts(spark, d))


@query("landed_semi", "J08", BOTH,
       "SELECT DISTINCT subreddit FROM landed_comments WHERE subreddit IN "
       "(SELECT subreddit FROM landed_posts)")
def landed_semi(spark, d):
    return C.already_landed(_communities(spark, d), V.landed_posts(spark, d))


@query("slice_contiguity", "W03", BOTH,
       f"SELECT subreddit, bool_and(coalesce(abs(gap - {STEP!r}) <= 1.0, true)) AS contiguous, "
       "count(*) AS n_slices FROM (SELECT subreddit, lead(slice_start) OVER (PARTITION BY "
       "subreddit ORDER BY slice_start) - slice_start AS gap FROM landed) GROUP BY 1", GRID)
def slice_contiguity(spark, d):
    return C.contiguous(_landed(spark, d), STEP)


@query("slice_complete", "W05", BOTH,
       f"SELECT subreddit, count(DISTINCT slice_start) AS n_slices FROM landed_c GROUP BY 1 "
       f"HAVING count(DISTINCT slice_start) = {N}", GRID)
def slice_complete(spark, d):
    return C.complete(C.landed_slices(V.landed_comments(spark, d), START, END, N), N)


AGREE = """agree AS (SELECT subreddit, abs(ps - cs) <= 0.0004 * greatest(abs(ps), abs(cs)) AS start_ok,
    abs(pe - ce) <= 0.0004 * greatest(abs(pe), abs(ce)) AS end_ok FROM
    (SELECT subreddit, min(created_utc) AS ps, max(created_utc) AS pe FROM landed_posts GROUP BY 1)
    JOIN (SELECT subreddit, min(created_utc) AS cs, max(created_utc) AS ce FROM landed_comments
    GROUP BY 1) USING (subreddit))"""


@query("start_end_agreement", "W04", BOTH, "SELECT * FROM agree", AGREE)
def start_end_agreement(spark, d):
    return C.agrees(V.landed_posts(spark, d), V.landed_comments(spark, d))


@query("mergeable_communities", "W03 W04 W05", BOTH,
       f"SELECT subreddit FROM (SELECT subreddit, lead(slice_start) OVER (PARTITION BY subreddit "
       "ORDER BY slice_start) - slice_start AS gap FROM landed_c) GROUP BY 1 HAVING "
       f"bool_and(coalesce(abs(gap - {STEP!r}) <= 1.0, true)) AND subreddit IN "
       "(SELECT subreddit FROM agree WHERE start_ok AND end_ok)",
       GRID + ", " + AGREE.replace("0.0004", "0.01"))
def mergeable_communities(spark, d):
    return C.mergeable(V.landed_posts(spark, d), V.landed_comments(spark, d), START, END, N,
                       rel_tol=0.01)


@query("coverage_flags", "J10 P17", BOTH,
       "SELECT c.subreddit, CAST(c.subreddit IN (SELECT subreddit FROM landed_posts) AS INTEGER) "
       "AS submissions FROM (SELECT DISTINCT subreddit FROM landed_comments) c")
def coverage_flags(spark, d):
    return C.coverage_flags(_communities(spark, d), V.landed_posts(spark, d), "submissions")


@query("next_window", "F12", "landed_posts",
       'SELECT max(created_utc) AS start, max(created_utc) + 2678400 AS "end" FROM landed_posts')
def next_window(spark, d):
    return C.next_window(V.landed_posts(spark, d))


@query("slice_scan_posts", "S01 P01", "discovery",
       "SELECT author, title, selftext, url, id, subreddit, created_utc, score, num_comments "
       "FROM discovery WHERE subreddit = 'n3' AND created_utc BETWEEN 900000000 AND 950000000")
def slice_scan_posts(spark, d):
    return P.slice_scan(V.discovery(spark, d), "n3", 900_000_000, 950_000_000,
                        [c for c in P.POST_FIELDS if c != "permalink"])


@query("slice_scan_comments", "S02 P01", "comments",
       "SELECT author, body, id, subreddit, parent_id, created_utc, score FROM comments "
       "WHERE subreddit = 'c7' AND created_utc BETWEEN 1583020800 AND 1593020800")
def slice_scan_comments(spark, d):
    return P.slice_scan(V.comments(spark, d), "c7", 1_583_020_800, 1_593_020_800,
                        [c for c in P.COMMENT_FIELDS if c != "permalink"])


@query("latest_per_community", "S03", "discovery",
       "SELECT subreddit, id, url, created_utc, score FROM (SELECT *, row_number() OVER (PARTITION "
       "BY subreddit ORDER BY created_utc DESC, id, url, subreddit_subscribers, score) AS rn "
       "FROM discovery WHERE created_utc BETWEEN 800000000 AND 1000000000) WHERE rn <= 50")
def latest_per_community(spark, d):
    return P.latest_per_community(V.discovery(spark, d), 800_000_000, 1_000_000_000, 50).select(
        "subreddit", "id", "url", "created_utc", "score")


@query("lookup_urls", "S04", "discovery",
       "SELECT id, url, subreddit FROM discovery WHERE url IN (SELECT url FROM discovery WHERE "
       "num_crossposts > 0 AND subreddit = 'n5')")
def lookup_urls(spark, d):
    posts = V.discovery(spark, d)
    wanted = posts.where("num_crossposts > 0 AND subreddit = 'n5'").select("url")
    return P.lookup_urls(posts, wanted).select("id", "url", "subreddit")


@query("slice_file_names", "F07", "landed_posts",
       "SELECT subreddit, created_utc AS slice_start, count(*) AS n FROM landed_posts "
       "GROUP BY 1, 2")
def slice_file_names(spark, d):
    # epochs are padded to the ten digits of a slice file name
    path = F.concat(F.lit("/landing/"), "subreddit", F.lit("-"),
                    F.lpad(F.col("created_utc").cast("string"), 10, "0"), F.lit(".parquet"))
    named = V.landed_posts(spark, d).select(path.alias("path"))
    return (named.groupBy(S.slice_file_name(F.col("path")).alias("subreddit"),
                          S.slice_file_start(F.col("path")).alias("slice_start"))
            .agg(F.count(F.lit(1)).alias("n")))
