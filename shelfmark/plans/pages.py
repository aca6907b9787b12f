"""Whole pages: the plans behind search results and detail views, each one Spark plan.

Child rows are joined to the few rows of a page, never fetched one by one.
"""
from pyspark.sql import functions as F

from shelfmark.operators.boolsearch import array_term, matches
from shelfmark.operators.money import quantiles
from shelfmark.operators.search import Facets, position_decay, ranked, search
from shelfmark.operators.versions import latest_by
from shelfmark.plans.facets import location_closure, parts
from shelfmark.plans.registry import Plans
from shelfmark.sources.tables import table

PLANS = Plans()
named = PLANS.named


@named("""WITH v AS (SELECT * FROM part QUALIFY row_number() OVER (PARTITION BY p_name, p_brand ORDER BY p_partkey DESC) = 1),
s AS (SELECT p_partkey, p_name, (CASE WHEN split_part(p_name, ' ', 1) = 'bolt' THEN 5.0 WHEN contains(split_part(p_name, ' ', 1), 'bolt') THEN 2.0 ELSE 0 END
 + CASE WHEN split_part(p_name, ' ', 2) = 'bolt' THEN 2.5 WHEN contains(split_part(p_name, ' ', 2), 'bolt') THEN 1.0 ELSE 0 END
 + CASE WHEN p_size BETWEEN 10 AND 30 THEN 1.0 ELSE 0 END)::DOUBLE AS score FROM v WHERE p_type <> 'PROMO'),
p AS (SELECT *, row_number() OVER (ORDER BY score DESC, p_name, p_partkey) AS rk FROM s WHERE score > 0 QUALIFY rk BETWEEN 6 AND 25),
b AS (SELECT l_partkey, max(l_quantity) AS largest, count(*) AS options FROM lineitem GROUP BY 1)
SELECT p_partkey, p_name, score, rk, largest, coalesce(options, 0) AS options FROM p LEFT JOIN b ON l_partkey = p_partkey""")
def search_page(spark, d):
    """Newest version per slug, hard filters, a relevance score, one page, its options."""
    newest = latest_by(parts(spark, d), ["p_name", "p_brand"], ["p_partkey"])
    f = Facets().must(F.col("p_type") != "PROMO").wish(F.col("p_size").between(10, 30))
    hits = newest.where(f.hard[0]).withColumn("score", position_decay(F.col("notes"), "bolt") + f.score()).where("score > 0")
    page = ranked(hits.select("p_partkey", "p_name", "score"), [F.desc("score"), F.asc("p_name"), F.asc("p_partkey")], first=6, last=25)
    keys = page.select(F.col("p_partkey").alias("l_partkey"))
    # A page has a fixed number of rows.
    options = table(spark, d, "lineitem").join(F.broadcast(keys), "l_partkey", "left_semi").groupBy(F.col("l_partkey").alias("p_partkey"))
    options = options.agg(F.max("l_quantity").alias("largest"), F.count("*").alias("options"))
    return page.join(options, "p_partkey", "left").na.fill(0, ["options"])


@named("""WITH v AS (SELECT * FROM part WHERE p_type <> 'PROMO' AND p_name ILIKE '%bolt%' AND p_size BETWEEN 10 AND 30)
SELECT count(*) AS total, ceil(count(*) / 20.0)::BIGINT AS pages, count(*) > 20 AS has_next, count(DISTINCT p_brand) AS brands FROM v""")
def search_summary(spark, d):
    """Counts of a strict search."""
    f = Facets().must(F.col("p_type") != "PROMO").wish(matches("bolt", array_term(F.col("notes")))).wish(F.col("p_size").between(10, 30))
    n = F.count("*")
    return search(parts(spark, d), f, False, "p_name", "p_partkey").agg(
        n.alias("total"), F.ceil(n / 20.0).cast("long").alias("pages"), (n > 20).alias("has_next"), F.count_distinct("p_brand").alias("brands")
    )


_PATHS = ["small-ring", "red-bolt", "hot-gear", "no-such"]


@named("""WITH w AS (SELECT unnest(['small-ring', 'red-bolt', 'hot-gear', 'no-such']) AS slug, unnest([1, 2, 3, 4]) AS place)
SELECT slug, place, max(p_partkey) AS p_partkey, count(*) AS versions FROM w JOIN part ON replace(p_name, ' ', '-') = slug GROUP BY ALL""")
def search_by_paths(spark, d):
    """Rows for a supplied list of slugs, in its order; unknown ones are left out."""
    from shelfmark.functions.text import slug

    rows = table(spark, d, "part").select("p_partkey", slug(F.col("p_name")).alias("slug")).where(F.col("slug").isin(_PATHS))
    place = F.array_position(F.array(*[F.lit(p) for p in _PATHS]), F.col("slug")).cast("int")
    return rows.groupBy("slug").agg(F.max("p_partkey").alias("p_partkey"), F.count("*").alias("versions")).withColumn("place", place)


@named("""WITH up AS (SELECT n_name AS loc, n_nationkey AS nation FROM nation UNION ALL SELECT r_name, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey),
x AS (SELECT loc, s_suppkey, l_partkey, l_quantity FROM up JOIN supplier ON s_nationkey = nation JOIN lineitem ON l_suppkey = s_suppkey)
SELECT loc, count(DISTINCT s_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts, count(DISTINCT CASE WHEN l_quantity > 40 THEN l_partkey END) AS bulk, round(avg(l_quantity), 6) AS mean FROM x GROUP BY loc""")
def location_detail(spark, d):
    """Statistics of each location and all above it. Rows become one per nation and part,
    then one per location and part, so that no set of parts is held, and no row is copied
    for each thing that is counted."""
    sold = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_quantity")
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("nation"))
    closure = location_closure(spark, d)
    sums = lambda q, n, top: (F.sum(q).alias("q"), F.sum(n).alias("n"), F.max(top).alias("top"))
    own = sold.join(s, "l_suppkey").groupBy("nation", "l_partkey").agg(*sums("l_quantity", F.when(F.col("l_quantity").isNotNull(), 1).otherwise(0), "l_quantity"))
    of_part = own.join(closure, "nation").groupBy("loc", "l_partkey").agg(*sums("q", "n", "top"))
    known = F.col("l_partkey").isNotNull()
    stats = of_part.groupBy("loc").agg(F.count_if(known).alias("parts"), F.count_if(known & (F.col("top") > 40)).alias("bulk"), F.round(F.try_divide(F.sum("q"), F.sum("n")), 6).alias("mean"))
    active = sold.select("l_suppkey").distinct().join(s, "l_suppkey").join(closure, "nation").select("loc", "l_suppkey").distinct()
    return stats.join(active.groupBy("loc").agg(F.count("*").alias("suppliers")), "loc").select("loc", "suppliers", "parts", "bulk", "mean")


@named("""WITH x AS (SELECT n_name, coalesce(CASE WHEN p_size > 5 THEN p_brand END, 'unknown') AS bucket, p_partkey, p_type, p_size FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN part ON p_partkey = l_partkey),
d AS (SELECT DISTINCT * FROM x)
SELECT n_name, bucket, count(*) AS parts, round(median(p_size), 6) AS elevation, (SELECT p_type FROM d e WHERE e.n_name = d.n_name AND e.bucket = d.bucket GROUP BY 1 ORDER BY count(*) DESC, p_type LIMIT 1) AS common FROM d GROUP BY ALL""")
def region_detail(spark, d):
    """For all regions at once: distinct parts, median size, most common type, with a
    bucket for parts of unknown place."""
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), "n_name")
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.coalesce(F.when(F.col("p_size") > 5, F.col("p_brand")), F.lit("unknown")).alias("bucket"), "p_type", "p_size")
    pairs = table(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct().join(s, "l_suppkey").select("n_name", "l_partkey").distinct()
    rows = pairs.join(p, "l_partkey")
    stats = rows.groupBy("n_name", "bucket").agg(F.count("*").alias("parts"), F.mode("p_type", True).alias("common"))
    return stats.join(quantiles(rows, ["n_name", "bucket"], "p_size", [0.5]).select("n_name", "bucket", F.round(F.col("q")[0], 6).alias("elevation")), ["n_name", "bucket"])
