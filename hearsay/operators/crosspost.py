"""Discovery of related communities through cross-posts."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearsay.functions.scalar import is_profile, strip_id_prefix
from hearsay.operators.ordered import top_n_per_group
from hearsay.session import cut_lineage, release, shared_folder, shuffle_width
from hearsay.sources.posts import lookup_urls

EDGE_COLUMNS = ("subreddit", "crosspost_parent", "subreddit_subscribers",
                "crosspost_parent_subs", "count", "crosspost_parent_num", "total")


def drop_profiles(df: DataFrame, columns: Sequence[str] = ("crosspost_parent", "subreddit")) -> DataFrame:
    """Drop rows that name a user profile; rows with a missing name go too."""
    for c in columns:
        df = df.where(~is_profile(F.col(c)))
    return df


def aggregate_pairs(df: DataFrame) -> DataFrame:
    """One edge per (community, parent community) with means, counts and parent totals."""
    pairs = (
        df.where(F.col("subreddit").isNotNull() & F.col("crosspost_parent").isNotNull())
        .groupBy("subreddit", "crosspost_parent")
        .agg(F.avg("subreddit_subscribers").alias("subreddit_subscribers"),
             F.coalesce(F.avg("crosspost_parent_subs"), F.lit(0.0)).cast("long")
             .alias("crosspost_parent_subs"),
             F.count("author").alias("count"),
             F.sum("crosspost_parent_num").alias("crosspost_parent_num"))
    )
    # at most one row per community reaches a parent here
    total = F.sum("count").over(Window.partitionBy("crosspost_parent"))
    return pairs.withColumn("total", total).select(*EDGE_COLUMNS)


def parents(posts: DataFrame) -> DataFrame:
    """Edges from posts to the communities they were cross-posted from."""
    first = F.get("crosspost_parent_list", F.lit(0))
    found = (
        posts.where(F.col("crosspost_parent_list").isNotNull()
                    & (F.size("crosspost_parent_list") > 0))
        .select("subreddit", "author", "subreddit_subscribers",
                first["subreddit"].alias("crosspost_parent"),
                first["subreddit_subscribers"].alias("crosspost_parent_subs"),
                first["num_crossposts"].alias("crosspost_parent_num"))
    )
    return aggregate_pairs(drop_profiles(found))


def crossposted_urls(posts: DataFrame) -> DataFrame:
    """URLs that were cross-posted, with their count and greatest post id."""
    return (posts.where("num_crossposts > 0").groupBy("url")
            .agg(F.sum("num_crossposts").alias("num_crossposts"), F.max("id").alias("id")))


LANDED_COLUMNS = ("id", "url", "subreddit", "subreddit_subscribers", "num_crossposts", "crosspost_parent", "author")


def land_by_url(posts: DataFrame, buckets: int | None = None) -> DataFrame:
    """The columns that a look-up of cross-posts reads, landed in buckets of the URL and sorted
    in them: joins on the URL then shuffle the other side alone, round after round."""
    spark = posts.sparkSession
    name = f"hearsay_posts_{uuid.uuid4().hex}"
    n = buckets or shuffle_width(spark)
    (posts.where("url IS NOT NULL").select(*LANDED_COLUMNS).repartition(n, "url")
     .write.bucketBy(n, "url").sortBy("url").format("parquet")
     .option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name))
    return spark.table(name)


def children(observed: DataFrame, all_posts: DataFrame) -> DataFrame:
    """Edges from cross-posts of the observed posts to the observed communities.

    Posts with a cross-posted URL split into parents (cross-posted) and children
    (not cross-posted, but naming a parent id).
    """
    same_url = lookup_urls(all_posts, crossposted_urls(observed))
    parent = same_url.where("num_crossposts > 0").select(
        F.col("id").alias("_parent_id"), F.col("subreddit").alias("crosspost_parent"),
        F.col("subreddit_subscribers").alias("crosspost_parent_subs"),
        F.col("num_crossposts").alias("crosspost_parent_num"), "author")
    child = same_url.where((F.col("num_crossposts") == 0) & F.col("crosspost_parent").isNotNull()) \
        .select("subreddit", "subreddit_subscribers",
                strip_id_prefix(F.col("crosspost_parent")).alias("_parent_id"))
    return aggregate_pairs(drop_profiles(child.join(parent, "_parent_id")))


def ratio(posts: DataFrame, count_null: bool = False) -> DataFrame:
    """Share of posts with a parent and share of posts that were cross-posted.

    ``count_null`` also counts a missing number of cross-posts as cross-posted.
    """
    n = F.col("num_crossposts")
    crossposted = (n.isNull() | (n != 0)) if count_null else (n > 0)
    total = F.count("subreddit_subscribers")
    whole = F.nullif(F.col("total"), F.lit(0))
    return (
        posts.where(F.col("subreddit").isNotNull()).groupBy("subreddit")
        .agg(F.count("crosspost_parent").alias("crosspost_parent"),
             F.count_if(crossposted).alias("crosspost_child"), total.alias("total"))
        .withColumn("crosspost_parent_share", F.col("crosspost_parent") / whole)
        .withColumn("crosspost_child_share", F.col("crosspost_child") / whole)
    )


def frontier(edges: DataFrame, known: DataFrame) -> DataFrame:
    """Communities named by the edges that are not known yet."""
    named = edges.select("subreddit").union(edges.select("crosspost_parent")).distinct()
    return named.join(known.select("subreddit").distinct(), "subreddit", "left_anti")


def scan_windows(posts: DataFrame, communities: DataFrame, start: int, end: int,
                 limit: int | None = None, repeat: int = 1) -> DataFrame:
    """Posts of the communities in a window, each row once.

    Without a limit that is one uncapped scan.  With one, ``repeat`` pages of ``limit``
    posts follow each other, oldest first, with a cursor per community: the next page
    starts strictly after the last (time, id) of the one before, so the pages together
    are the first ``limit * repeat`` posts of each community.
    """
    asked = communities.select("subreddit").distinct()
    inside = posts.where(F.col("created_utc").between(start, end)).join(asked, "subreddit", "left_semi")
    if limit is None:
        return inside
    order = [F.col(c) for c in ("created_utc", "id", "url") if c in posts.columns]
    return top_n_per_group(inside, ["subreddit"], order, limit * repeat)


@dataclass
class Expansion:
    edges: DataFrame
    communities: DataFrame


def expand(posts: DataFrame, seeds: DataFrame, start: int, end: int, limit: int | None = None,
           repeat: int = 1, depth: int = 3, exclude: str = "visited") -> Expansion:
    """Follow cross-posts from seed communities for ``depth - 1`` rounds.

    ``exclude='frontier'`` removes only the communities of the current round from
    the next one, so earlier ones can come back; ``'visited'`` removes all.

    The posts are landed once by URL; a round scans the windows of its communities, joins
    its URLs with the landed posts without shuffling them, and writes its own edges only.
    """
    if exclude not in ("visited", "frontier"):
        raise ValueError(f"unknown exclude {exclude!r}")
    current = seeds.select("subreddit").distinct()
    visited = current
    edges = None
    landed = land_by_url(posts) if depth > 1 else None
    for step in range(1, depth):
        # written once, read by every branch
        seen = cut_lineage(scan_windows(posts, current, start, end, limit, repeat))
        found = cut_lineage(parents(seen).unionByName(children(seen, landed)).withColumn("round", F.lit(step)))
        release(seen)
        edges = found if edges is None else edges.unionByName(found)
        following = cut_lineage(frontier(edges, visited if exclude == "visited" else current))
        if following.isEmpty():
            break
        current = following
        visited = visited.unionByName(current).distinct()
    return Expansion(edges, visited)
