"""Joins: semi, anti, theta, range, nested and outer."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfmark.operators.substring import substring_join
from shelfmark.operators.versions import latest_by
from shelfmark.plans.registry import Plans
from shelfmark.sources.tables import table

PLANS = Plans()
named = PLANS.named


@named("""SELECT l_partkey, l_quantity, l_extendedprice FROM (SELECT DISTINCT l_partkey, l_quantity, l_extendedprice FROM lineitem WHERE l_extendedprice IS NOT NULL)
QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity DESC, l_extendedprice DESC) = 1""")
def largest_option_per_entity(spark, d):
    l = table(spark, d, "lineitem").select("l_partkey", "l_quantity", "l_extendedprice").where("l_extendedprice IS NOT NULL")
    return latest_by(l, ["l_partkey"], ["l_quantity", "l_extendedprice"])


@named("""WITH f AS (SELECT l_partkey, arg_min(l_suppkey, (l_orderkey, l_linenumber, l_suppkey)) AS s FROM lineitem GROUP BY 1)
SELECT p_partkey, s AS suppkey, n_name FROM part LEFT JOIN f ON l_partkey = p_partkey LEFT JOIN supplier ON s_suppkey = s LEFT JOIN nation ON n_nationkey = s_nationkey""")
def primary_child_join(spark, d):
    """Each part with its first child row and that one's country."""
    first = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min_by("l_suppkey", F.struct("l_orderkey", "l_linenumber", "l_suppkey")).alias("suppkey"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("suppkey"), F.col("s_nationkey").alias("n_nationkey"))
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    return table(spark, d, "part").select("p_partkey").join(first, "p_partkey", "left").join(s, "suppkey", "left").join(n, "n_nationkey", "left").select("p_partkey", "suppkey", "n_name")


@named("SELECT s_suppkey, n_name, r_name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = n_regionkey")
def dim_left_broadcast(spark, d):
    """Small dimensions; Spark broadcasts them by their size."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", "n_name", "r_name")


_MAP = "m(original, common) AS (VALUES ('RED', 'warm'), ('hot', 'warm'), ('Blue', 'cool'), ('old', 'worn'))"


def mapping(spark):
    return spark.createDataFrame([("RED", "warm"), ("hot", "warm"), ("Blue", "cool"), ("old", "worn")], "original string, common string")


@named(f"WITH {_MAP}, t AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS tok FROM part) SELECT p_partkey, tok, common FROM t LEFT JOIN m ON lower(original) = lower(tok)")
def explode_ci_mapping_join(spark, d):
    t = table(spark, d, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("tok"))
    m = mapping(spark).select(F.lower("original").alias("key"), "common")
    return t.withColumn("key", F.lower("tok")).join(m, "key", "left").drop("key")


@named(f"WITH {_MAP} SELECT p_partkey, coalesce(common, split_part(p_name, ' ', 1)) AS value FROM part LEFT JOIN m ON lower(original) = lower(split_part(p_name, ' ', 1))")
def map_values_case_insensitive(spark, d):
    first = F.split_part("p_name", F.lit(" "), F.lit(1))
    m = mapping(spark).select(F.lower("original").alias("key"), "common")
    return table(spark, d, "part").select("p_partkey", first.alias("v"), F.lower(first).alias("key")).join(m, "key", "left").select("p_partkey", F.coalesce("common", "v").alias("value"))


@named("""WITH m(k, v) AS (VALUES ('red', 'crimson'), ('old', NULL)) SELECT p_partkey, CASE WHEN k IS NOT NULL THEN v ELSE split_part(p_name, ' ', 1) END AS canonical
FROM part LEFT JOIN m ON k = split_part(p_name, ' ', 1)""")
def canonical_three_valued(spark, d):
    """A key mapped to null gives null; an unmapped one keeps its value."""
    m = spark.createDataFrame([("red", "crimson"), ("old", None)], "k string, v string").withColumn("mapped", F.lit(True))
    p = table(spark, d, "part").select("p_partkey", F.split_part("p_name", F.lit(" "), F.lit(1)).alias("k")).join(m, "k", "left")
    return p.select("p_partkey", F.when(F.col("mapped"), F.col("v")).otherwise(F.col("k")).alias("canonical"))


@named("SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = 'R' AND l_discount > 0.09)")
def semi_exists(spark, d):
    l = table(spark, d, "lineitem").where("l_returnflag = 'R' AND l_discount > 0.09")
    return table(spark, d, "supplier").join(l, F.col("l_suppkey") == F.col("s_suppkey"), "left_semi").select("s_suppkey")


@named("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def anti_not_exists(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'F'")
    return table(spark, d, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@named("SELECT n_name, count(s_suppkey) AS suppliers, count(DISTINCT CASE WHEN s_acctbal > 5000 THEN s_suppkey END) AS rich FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 2000 GROUP BY 1")
def left_keep_zero(spark, d):
    s = table(spark, d, "supplier").where("s_acctbal > 2000")
    joined = table(spark, d, "nation").join(s, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return joined.groupBy("n_name").agg(F.count("s_suppkey").alias("suppliers"), F.count_distinct(F.when(F.col("s_acctbal") > 5000, F.col("s_suppkey"))).alias("rich"))


@named("""WITH n(note) AS (VALUES ('re'), ('ring'), ('bol'), ('zz'), ('ear')) SELECT note, count(*) AS parts, round(avg(p_retailprice), 6) AS price FROM n JOIN part ON p_name LIKE '%' || note || '%' GROUP BY 1""")
def theta_contains_join(spark, d):
    """Substring join with a table of terms."""
    terms = spark.createDataFrame([("re",), ("ring",), ("bol",), ("zz",), ("ear",)], "note string")
    part = table(spark, d, "part")
    hits = substring_join(part, "p_partkey", "p_name", terms, "note").join(part.select("p_partkey", "p_retailprice"), "p_partkey")
    return hits.groupBy("note").agg(F.count("*").alias("parts"), F.round(F.avg("p_retailprice"), 6).alias("price"))


@named("""WITH s AS (SELECT user_id, epoch(ts)::BIGINT AS a, coalesce(lead(epoch(ts)::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id), epoch(ts)::BIGINT + 3600) AS b, event_id AS seg FROM events WHERE event_type = 'signup'),
c AS (SELECT user_id, event_id, epoch(ts)::BIGINT + 30 AS mid FROM events WHERE event_type <> 'signup')
SELECT seg, count(*) AS chunks, string_agg(c.event_id::VARCHAR, ' ' ORDER BY mid, c.event_id) AS stitched FROM s JOIN c ON s.user_id = c.user_id AND mid >= a AND mid < b GROUP BY seg""")
def range_midpoint_join(spark, d):
    """Chunks belong to the segment in which their middle lies. Segments of a key follow
    each other, so the one that may hold a chunk is the last that began before it: one
    ordered pass instead of a range join."""
    e = table(spark, d, "events").where("user_id IS NOT NULL")
    # Whole seconds as a cast to BIGINT has them: the nearest, halves to the even one.
    at = F.rint(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("long")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    seg = e.where("event_type = 'signup'").select("user_id", at.alias("a"), F.coalesce(F.lead(at).over(w), at + 3600).alias("b"), F.col("event_id").alias("seg"))
    # A lead over whole seconds; segments of no length hold nothing.
    seg = seg.where("a < b").select("user_id", F.col("a").alias("x"), F.lit(0).alias("kind"), F.struct("seg", "b").alias("s"), F.lit(None).cast("long").alias("event_id"))
    chunk = e.where("event_type <> 'signup'").select("user_id", (at + 30).alias("x"), F.lit(1).alias("kind"), F.lit(None).cast("struct<seg:bigint,b:bigint>").alias("s"), "event_id")
    order = Window.partitionBy("user_id").orderBy("x", "kind", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    held = seg.unionByName(chunk).withColumn("last", F.last("s", ignorenulls=True).over(order)).where("kind = 1 AND x < last.b")
    g = held.groupBy(F.col("last.seg").alias("seg")).agg(F.count("*").alias("chunks"), F.sort_array(F.collect_list(F.struct("x", "event_id"))).alias("l"))
    return g.select("seg", "chunks", F.array_join(F.transform("l", lambda c: c["event_id"].cast("string")), " ").alias("stitched"))


@named("SELECT o_orderkey, (SELECT max(l_extendedprice) FROM lineitem WHERE l_orderkey = o_orderkey) AS top FROM orders")
def scalar_lookup(spark, d):
    top = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_extendedprice").alias("top"))
    return table(spark, d, "orders").select("o_orderkey").join(top, "o_orderkey", "left")


@named("""WITH a AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderkey % 5 <> 0), b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS v FROM orders WHERE o_orderkey % 4 <> 0)
SELECT k, CASE WHEN a.k IS NULL THEN 'only right' WHEN b.k IS NULL THEN 'only left' WHEN a.v <> b.v THEN 'differs' ELSE 'same' END AS verdict FROM a FULL JOIN b USING (k)""")
def full_outer_reconcile(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    a, b = o.where("k % 5 <> 0"), o.where("k % 4 <> 0").select("k", F.when(F.col("k") % 7 == 0, F.col("v") + 1).otherwise(F.col("v")).alias("w"))
    verdict = F.when(F.col("v").isNull(), "only right").when(F.col("w").isNull(), "only left").when(F.col("v") != F.col("w"), "differs").otherwise("same")
    return a.join(b, "k", "full_outer").select("k", verdict.alias("verdict"))


@named("""SELECT p_brand, string_agg(q::VARCHAR || 'x' || n::VARCHAR, ';' ORDER BY q) AS options FROM (
SELECT p_brand, l_quantity::INTEGER AS q, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL) GROUP BY 1""")
def nested_child_list(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    c = table(spark, d, "lineitem").join(p, "l_partkey").groupBy("p_brand", F.col("l_quantity").cast("int").alias("q")).agg(F.count("*").alias("n"))
    g = c.groupBy("p_brand").agg(F.sort_array(F.collect_list(F.struct("q", "n"))).alias("l"))
    return g.select("p_brand", F.array_join(F.transform("l", lambda x: F.concat_ws("x", x["q"].cast("string"), x["n"].cast("string"))), ";").alias("options"))
