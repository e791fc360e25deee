"""Aggregation, ranking and daily-series queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearsay.functions import scalar as S
from hearsay.functions import text as X
from hearsay.operators import aggregates as A
from hearsay.operators import ordered as O
from hearsay.plans import views as V
from hearsay.plans.registry import query

WATCHED = ("u7", "u12", "u101", "u133", "[deleted]")
COUNTS = """
    SELECT author, count(CASE WHEN class_II = 0 THEN score END) AS n_anti,
           count(CASE WHEN class_II = 1 THEN score END) AS n_neutral,
           count(CASE WHEN class_II = 2 THEN score END) AS n_pro
    FROM posts WHERE class_I = 1 GROUP BY author"""
SHARES = f"""
    SELECT *, n_anti + n_neutral + n_pro AS total,
           n_anti / CAST(n_anti + n_neutral + n_pro AS DOUBLE) AS p_anti,
           n_neutral / CAST(n_anti + n_neutral + n_pro AS DOUBLE) AS p_neutral,
           n_pro / CAST(n_anti + n_neutral + n_pro AS DOUBLE) AS p_pro FROM ({COUNTS})"""
DAY = "CAST(make_timestamp(created_utc * 1000000) AS DATE)"
SERIES = f"""
    SELECT {DAY} AS date, count(CASE WHEN class_II = 0 THEN num_comments END) AS n_anti,
           count(CASE WHEN class_II = 1 THEN num_comments END) AS n_neutral,
           count(CASE WHEN class_II = 2 THEN num_comments END) AS n_pro,
           count(num_comments) AS total FROM posts"""


def _authors(spark, d):
    return A.class_db(V.posts(spark, d).where("class_I = 1"), ["author"])


def _shares(spark, d):
    return A.with_shares(_authors(spark, d))


@query("author_class_db", "A04 P03 S15", "posts", COUNTS)
def author_class_db(spark, d):
    return _authors(spark, d)


@query("author_shares", "P16 F21", "posts",
       f"SELECT author, n_anti, n_neutral, n_pro, total, round(p_anti, 9) AS p_anti, "
       f"round(p_neutral, 9) AS p_neutral, round(p_pro, 9) AS p_pro FROM ({SHARES})")
def author_shares(spark, d):
    shares = [F.round(c, 9).alias(c) for c in ("p_anti", "p_neutral", "p_pro")]
    return _shares(spark, d).select("author", "n_anti", "n_neutral", "n_pro", "total", *shares)


@query("top_authors_skip_deleted", "L02 A04 P03 P16", "posts",
       f"SELECT author, n_anti, total FROM ({SHARES}) ORDER BY n_anti DESC, author "
       "LIMIT 10 OFFSET 1")
def top_authors_skip_deleted(spark, d):
    return A.top_k(_shares(spark, d).select("author", "n_anti", "total"), "n_anti", 10,
                   ["author"], skip=1)


@query("top_authors", "L01", "posts",
       f"SELECT author, n_anti FROM ({COUNTS}) ORDER BY n_anti DESC, author LIMIT 11")
def top_authors(spark, d):
    return A.top_k(_authors(spark, d).select("author", "n_anti"), "n_anti", 11, ["author"])


@query("top_authors_by_share", "L03 P10", "posts",
       f"SELECT author, total, round(p_anti, 9) AS p_anti FROM ({SHARES}) WHERE total > 40 "
       "ORDER BY p_anti DESC, author LIMIT 10")
def top_authors_by_share(spark, d):
    best = A.top_k(_shares(spark, d), F.col("p_anti"), 10, ["author"], floor=F.col("total") > 40)
    return best.select("author", "total", F.round("p_anti", 9).alias("p_anti"))


@query("deleted_vs_rest", "A16 A17 P09", "posts",
       "SELECT " + ", ".join(
           f"round(max(CASE WHEN author = '[deleted]' THEN {p} END), 9) AS {p}_one, "
           f"round(avg(CASE WHEN author <> '[deleted]' THEN {p} END), 9) AS {p}_mean, "
           f"round(stddev_samp(CASE WHEN author <> '[deleted]' THEN {p} END), 9) AS {p}_std"
           for p in ("p_anti", "p_neutral", "p_pro")) + f" FROM ({SHARES})")
def deleted_vs_rest(spark, d):
    out = A.group_vs_rest(_shares(spark, d))
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


@query("daily_class_db", "A05 F08", "posts",
       f"SELECT {DAY} AS date, subreddit, class_II, count(score) AS n FROM posts "
       "WHERE class_I = 1 GROUP BY 1, 2, 3")
def daily_class_db(spark, d):
    return A.class_counts(A.with_date(V.posts(spark, d).where("class_I = 1")),
                          ["date", "subreddit"])


@query("daily_class_wide", "A05 F21", "posts",
       f"SELECT {DAY} AS date, " + ", ".join(
           f"""count(CASE WHEN subreddit = '{s}' AND class_II = {c} THEN score END) AS "{s}|{c}" """
           for s in ("click", "error", "purchase", "signup", "view") for c in (0, 1, 2))
       + " FROM posts WHERE class_I = 1 GROUP BY 1")
def daily_class_wide(spark, d):
    long = daily_class_db(spark, d)
    labels = [f"{s}|{c}" for s in ("click", "error", "purchase", "signup", "view")
              for c in (0, 1, 2)]
    return A.wide_by(long, "date", ["subreddit", "class_II"], labels)


@query("author_watch_db", "A06 P07", "posts",
       "SELECT author, subreddit, class_II, count(score) AS n FROM posts WHERE class_I = 1 "
       f"AND author IN {WATCHED} GROUP BY 1, 2, 3")
def author_watch_db(spark, d):
    on_topic = V.posts(spark, d).where((F.col("class_I") == 1) & F.col("author").isin(*WATCHED))
    return A.class_counts(on_topic, ["author", "subreddit"])


@query("c1_distribution", "A07", "posts",
       """SELECT subreddit, count(CASE WHEN class_I = 0 THEN score END) AS "Non-Covid",
          count(CASE WHEN class_I = 1 THEN score END) AS "Covid" FROM posts GROUP BY 1""")
def c1_distribution(spark, d):
    return A.class_db(V.posts(spark, d), ["subreddit"], "class_I", (0, 1), A.TOPIC_CLASSES)


@query("eda_stats_c1", "A08", "posts",
       """SELECT subreddit, count(*) AS posts, count(CASE WHEN class_I = 0 THEN 1 END)
          AS "Non-Covid", count(CASE WHEN class_I = 1 THEN 1 END) AS "Covid",
          count(DISTINCT author) AS authors FROM posts GROUP BY 1""")
def eda_stats_c1(spark, d):
    return A.community_stats(V.posts(spark, d), "c1")


@query("eda_stats_c2", "A09 P03", "posts",
       """SELECT subreddit, count(*) AS posts, count(CASE WHEN class_II = 0 THEN 1 END)
          AS posts_anti, count(CASE WHEN class_II = 1 THEN 1 END) AS posts_neutral,
          count(CASE WHEN class_II = 2 THEN 1 END) AS posts_pro,
          count(DISTINCT author) AS authors FROM posts WHERE class_I = 1 GROUP BY 1""")
def eda_stats_c2(spark, d):
    return A.community_stats(V.posts(spark, d), "c2")


@query("eda_stats_plain", "A10", "posts",
       "SELECT subreddit, count(*) AS posts, count(DISTINCT author) AS authors FROM posts "
       "GROUP BY 1")
def eda_stats_plain(spark, d):
    return A.community_stats(V.posts(spark, d), "none")


@query("daily_frequency", "A11 F08", "posts",
       f"SELECT {DAY} AS date, subreddit, count(*) AS n FROM posts GROUP BY 1, 2")
def daily_frequency(spark, d):
    return A.daily_counts(V.posts(spark, d))


@query("daily_frequency_local", "A11 F08", "posts",
       "SELECT CAST(timezone('Europe/Berlin', timezone('UTC', "
       "make_timestamp(created_utc * 1000000))) AS DATE) "
       "AS date, subreddit, count(*) AS n FROM posts GROUP BY 1, 2")
def daily_frequency_local(spark, d):
    return A.daily_counts(V.posts(spark, d), tz="Europe/Berlin")


@query("daily_class_series", "A12 P16", "posts",
       f"{SERIES} WHERE subreddit = 'click' GROUP BY 1")
def daily_class_series(spark, d):
    return A.daily_class_series(V.posts(spark, d), "click")


@query("peak_day", "A23", "posts",
       f"SELECT * FROM ({SERIES} GROUP BY 1) WHERE total = "
       f"(SELECT max(total) FROM ({SERIES} GROUP BY 1))")
def peak_day(spark, d):
    return A.peaks(A.daily_class_series(V.posts(spark, d)), "total")


@query("event_window_mean", "A22 P11", "posts",
       "SELECT round(avg(n_anti), 9) AS n_anti, round(avg(n_neutral), 9) AS n_neutral, "
       f"round(avg(n_pro), 9) AS n_pro, round(avg(total), 9) AS total FROM ({SERIES} GROUP BY 1) "
       "WHERE date > DATE '2024-01-05' AND date < DATE '2024-01-20'")
def event_window_mean(spark, d):
    cols = ["n_anti", "n_neutral", "n_pro", "total"]
    out = A.event_window_mean(A.daily_class_series(V.posts(spark, d)),
                              "2024-01-05", "2024-01-20", cols)
    return out.select(*[F.round(c, 9).alias(c) for c in cols])


@query("high_volume_days", "P12", "posts",
       f"SELECT * FROM ({SERIES} GROUP BY 1) WHERE total > 330")
def high_volume_days(spark, d):
    return A.daily_class_series(V.posts(spark, d)).where("total > 330")


@query("exclude_community_series", "J14", "posts",
       "SELECT a.date, a.n_anti - coalesce(b.n_anti, 0) AS n_anti, a.n_pro - coalesce(b.n_pro, 0) AS n_pro, "
       f"a.total - coalesce(b.total, 0) AS total FROM ({SERIES} GROUP BY 1) a "
       f"LEFT JOIN ({SERIES} WHERE subreddit = 'click' GROUP BY 1) b ON a.date = b.date")
def exclude_community_series(spark, d):
    posts = V.posts(spark, d)
    return A.exclude_series(A.daily_class_series(posts), A.daily_class_series(posts, "click"),
                            ["n_anti", "n_pro", "total"])


@query("date_spine", "U15 F09 F21", "daily",
       "SELECT CAST(s.date AS DATE) AS date, coalesce(new_cases, 0) AS new_cases FROM "
       "(SELECT unnest(generate_series((SELECT min(date) FROM daily)::TIMESTAMP, "
       "TIMESTAMP '2001-08-15', INTERVAL 1 DAY)) AS date) s "
       "LEFT JOIN daily ON daily.date = CAST(s.date AS DATE)")
def date_spine(spark, d):
    return A.date_spine(V.daily(spark, d).select("date", "new_cases"), ["new_cases"],
                        end="2001-08-15")


@query("join_daily_stats", "J13", "daily",
       "SELECT a.date, a.n, b.new_cases, b.amount FROM (SELECT CAST(l_shipdate AS DATE) AS date, "
       "count(*) AS n FROM lineitem GROUP BY 1) a LEFT JOIN daily b ON a.date = b.date")
def join_daily_stats(spark, d):
    shipped = V.discovery(spark, d)
    counts = A.daily_counts(shipped, keys=())
    return A.join_daily(counts, V.daily(spark, d))


@query("length_histogram", "A21 F20", "documents_view",
       "SELECT b.bin, round(lo + b.bin * (hi - lo) / 20.0, 6) AS bin_start, "
       "coalesce(n, 0) AS n FROM (SELECT min(v) AS lo, max(v) AS hi FROM lens) l, "
       "(SELECT CAST(unnest(range(20)) AS INTEGER) AS bin) b LEFT JOIN (SELECT CASE WHEN v = hi "
       "THEN 19 ELSE CAST(floor((v - lo) / ((hi - lo) / 20.0)) AS INTEGER) END AS bin, "
       "count(*) AS n FROM lens, (SELECT min(v) AS lo, max(v) AS hi FROM lens) GROUP BY 1) h "
       "ON h.bin = b.bin",
       ctes="lens AS (SELECT CAST(length(text) AS DOUBLE) AS v FROM documents)")
def length_histogram(spark, d):
    lens = V.table(spark, d, "documents").select(X.char_count(F.col("text")).alias("len"))
    return A.histogram(lens, "len", 20).withColumn("bin_start", F.round("bin_start", 6))


@query("summary_stats", "A15 A24", "posts",
       "SELECT count(score) AS count, round(avg(score), 6) AS mean, "
       "round(stddev_samp(score), 6) AS std, min(score) AS min, max(score) AS max, "
       "round(quantile_cont(score, 0.25), 6) AS q25, round(quantile_cont(score, 0.5), 6) AS q50, "
       "round(quantile_cont(score, 0.75), 6) AS q75 FROM posts")
def summary_stats(spark, d):
    out = A.summary(V.posts(spark, d), "score")
    return out.select("count", "min", "max", *[F.round(c, 6).alias(c) for c in
                                               ("mean", "std", "q25", "q50", "q75")])


@query("label_counts", "A13", "labels_view",
       "SELECT quality, count(*) AS n FROM labels GROUP BY 1")
def label_counts(spark, d):
    return A.label_counts(V.table(spark, d, "labels"), "quality")


@query("column_sums", "A14", "posts",
       f"SELECT CAST(sum(n_anti) AS BIGINT) AS n_anti, CAST(sum(n_neutral) AS BIGINT) AS n_neutral, "
       f"CAST(sum(n_pro) AS BIGINT) AS n_pro FROM ({COUNTS})")
def column_sums(spark, d):
    return A.column_sums(_authors(spark, d), ["n_anti", "n_neutral", "n_pro"])


@query("distinct_values", "A18 U04", "posts",
       "SELECT count(DISTINCT author) AS authors, count(DISTINCT subreddit) AS communities "
       "FROM posts")
def distinct_values(spark, d):
    posts = V.posts(spark, d)
    return posts.agg(F.count_distinct("author").alias("authors"),
                     F.count_distinct("subreddit").alias("communities"))


@query("row_column_count", "A19", "documents_view",
       "SELECT count(*) AS n_rows, CAST(5 AS BIGINT) AS n_columns FROM documents")
def row_column_count(spark, d):
    return A.shape(V.table(spark, d, "documents"))


@query("top_k_sum", "A20", "customer_view",
       "SELECT round(sum(c_acctbal), 2) AS sum_c_acctbal FROM (SELECT c_acctbal FROM customer "
       "ORDER BY c_acctbal DESC, c_custkey LIMIT 40)")
def top_k_sum(spark, d):
    return A.top_k_sum(V.table(spark, d, "customer").select("c_acctbal", "c_custkey"),
                       "c_acctbal", 40, ["c_custkey"]).select(
        F.round("sum_c_acctbal", 2).alias("sum_c_acctbal"))


@query("sums_by_flag", "A20 P17", "landed_posts landed_comments",
       "SELECT coalesce(f.flag, 0) AS comments_landed, CAST(sum(n) AS BIGINT) AS n FROM "
       "(SELECT subreddit, count(*) AS n FROM landed_comments GROUP BY 1) c LEFT JOIN "
       "(SELECT DISTINCT subreddit, 1 AS flag FROM landed_posts) f "
       "ON f.subreddit = c.subreddit GROUP BY 1")
def sums_by_flag(spark, d):
    from hearsay.operators import coverage as C
    sizes = V.landed_comments(spark, d).groupBy("subreddit").agg(F.count(F.lit(1)).alias("n"))
    flagged = C.coverage_flags(sizes, V.landed_posts(spark, d), "comments_landed")
    return A.sums_by_flag(flagged, "comments_landed", ["n"])


@query("min_max", "A24", "posts",
       "SELECT min(created_utc) AS first_post, max(created_utc) AS last_post FROM posts")
def min_max(spark, d):
    return V.posts(spark, d).agg(F.min("created_utc").alias("first_post"),
                                 F.max("created_utc").alias("last_post"))


@query("merge_partial_counts", "A27 J12 U01", "posts",
       "SELECT author, CAST(count(CASE WHEN class_II = 0 THEN score END) AS BIGINT) AS n_anti, "
       "count(CASE WHEN class_II = 1 THEN score END) AS n_neutral, "
       "count(CASE WHEN class_II = 2 THEN score END) AS n_pro FROM posts GROUP BY author")
def merge_partial_counts(spark, d):
    posts = V.posts(spark, d)
    parts = [A.class_db(posts.where(F.col("class_I") == c), ["author"]) for c in (0, 1)]
    return A.merge_counts(parts, ["author"], ["n_anti", "n_neutral", "n_pro"])


@query("head_tail", "L06 L05", "posts",
       "SELECT 'head' AS part, id, created_utc FROM (SELECT id, created_utc FROM posts "
       "ORDER BY created_utc, id LIMIT 5) UNION ALL SELECT 'tail' AS part, id, created_utc FROM "
       "(SELECT id, created_utc FROM posts ORDER BY created_utc DESC, id DESC LIMIT 5)")
def head_tail(spark, d):
    posts = V.posts(spark, d).select("id", "created_utc")
    head = posts.orderBy("created_utc", "id").limit(5)
    tail = posts.orderBy(F.desc("created_utc"), F.desc("id")).limit(5)
    return (head.withColumn("part", F.lit("head"))
            .unionByName(tail.withColumn("part", F.lit("tail"))))


@query("predicate_mix", "P02 P04 P05 P08 P09 P13", "discovery",
       "SELECT subreddit AS community, count(*) AS n FROM discovery WHERE (crosspost_parent IS NOT "
       "NULL OR num_crossposts > 0) AND author <> 'a7' GROUP BY 1")
def predicate_mix(spark, d):
    posts = V.discovery(spark, d)
    return (posts.where((F.col("crosspost_parent").isNotNull() | (F.col("num_crossposts") > 0))
                        & (F.col("author") != "a7"))
            .withColumnRenamed("subreddit", "community")
            .groupBy("community").agg(F.count(F.lit(1)).alias("n")))


@query("country_filter", "P14", "daily",
       "SELECT CAST(l_shipdate AS DATE) AS date, count(*) AS n FROM lineitem JOIN supplier "
       "ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey "
       "WHERE n_name = 'NATION_7' GROUP BY 1")
def country_filter(spark, d):
    nation = V.table(spark, d, "nation").where("n_name = 'NATION_7'").select("n_nationkey")
    supplier = V.table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    wanted = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey, "left_semi")
    line = V.table(spark, d, "lineitem").select("l_suppkey", "l_shipdate")
    return (line.join(wanted, line.l_suppkey == wanted.s_suppkey, "left_semi")
            .groupBy(F.to_date("l_shipdate").alias("date")).agg(F.count(F.lit(1)).alias("n")))


@query("token_length_stats", "A25 F20 F25", "documents_view",
       "SELECT max(n) AS max_words, round(avg(n), 6) AS mean_words FROM "
       "(SELECT len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f]+'), "
       "lambda x: x <> '')) AS n FROM documents)")
def token_length_stats(spark, d):
    n = X.word_count(F.col("text")).cast("long")
    return V.table(spark, d, "documents").select(n.alias("n")).agg(
        F.max("n").alias("max_words"), F.round(F.avg("n"), 6).alias("mean_words"))


@query("date_epoch_round_trip", "F08 F10", "posts",
       "SELECT count(*) AS n, CAST(sum(created_utc - epoch_us(CAST("
       f"{DAY} AS TIMESTAMP)) // 1000000) AS BIGINT) AS second_of_day FROM posts")
def date_epoch_round_trip(spark, d):
    posts = V.posts(spark, d).select("created_utc")
    back = S.epoch_of_date(S.date_of(F.col("created_utc")))
    return posts.agg(F.count(F.lit(1)).alias("n"),
                     F.sum(F.col("created_utc") - back).alias("second_of_day"))


@query("order_quantile", "W08", "posts",
       "SELECT score AS value FROM (SELECT score, row_number() OVER (ORDER BY score) AS rn, "
       "count(*) OVER () AS n FROM posts) WHERE rn = CAST(floor(n * 0.95) AS BIGINT) + 1")
def order_quantile(spark, d):
    return O.order_statistic(V.posts(spark, d), "score", 0.95)
