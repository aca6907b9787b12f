"""Set operations, duplicates and list–detail consistency."""
from pyspark.sql import functions as F

from shelfmark.plans.registry import Plans
from shelfmark.sources.tables import table

PLANS = Plans()
named = PLANS.named


@named("""SELECT l_suppkey AS owner, max(day)::VARCHAR AS latest FROM (SELECT l_suppkey, l_shipdate::DATE AS day FROM lineitem UNION ALL SELECT o_custkey, o_orderdate::DATE FROM orders) GROUP BY 1""")
def union_all_max(spark, d):
    a = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("owner"), F.to_date("l_shipdate").alias("day"))
    b = table(spark, d, "orders").select(F.col("o_custkey").alias("owner"), F.to_date("o_orderdate").alias("day"))
    return a.unionByName(b).groupBy("owner").agg(F.max("day").cast("string").alias("latest"))


@named("SELECT DISTINCT p_brand, p_type FROM part")
def distinct_rows(spark, d):
    return table(spark, d, "part").select("p_brand", "p_type").distinct()


_CASED = "(SELECT CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS k, p_type AS v FROM part)"


@named(f"SELECT lower(k) AS key, count(DISTINCT k) AS spellings, count(DISTINCT v) > 1 AS conflict FROM {_CASED} GROUP BY 1 HAVING count(DISTINCT k) > 1")
def case_dup_conflicts(spark, d):
    p = table(spark, d, "part").select(F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("k"), F.col("p_type").alias("v"))
    g = p.groupBy(F.lower("k").alias("key")).agg(F.count_distinct("k").alias("spellings"), (F.count_distinct("v") > 1).alias("conflict"))
    return g.where("spellings > 1")


@named("""SELECT p_brand AS target, count(DISTINCT lower(regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g'))) AS stems FROM part WHERE NOT contains(p_name, 'gear') GROUP BY 1 HAVING count(DISTINCT lower(regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g'))) > 40""")
def suspicious_merges(spark, d):
    stem = F.lower(F.regexp_replace("p_name", r"[^\p{Alnum}]", ""))
    p = table(spark, d, "part").where(~F.col("p_name").contains("gear"))
    return p.groupBy(F.col("p_brand").alias("target")).agg(F.count_distinct(stem).alias("stems")).where("stems > 40")


@named("SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def set_difference(spark, d):
    o = table(spark, d, "orders")
    return o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")).distinct().join(o.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k")), "k", "left_anti")


@named("SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def set_intersection(spark, d):
    o = table(spark, d, "orders")
    return o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")).intersect(o.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k")))


@named("""SELECT a.p_partkey FROM part a WHERE a.p_size > 40 AND EXISTS (SELECT 1 FROM part b WHERE b.p_brand = 'Brand#5' AND abs(a.p_retailprice - b.p_retailprice - 0.00005) < 0.0001)""")
def selection_intersection_tolerance(spark, d):
    """Prices equal within a tolerance. Prices are cut into cells as wide as twice the
    tolerance, and each is tried against its own and the next cells, an equi-join."""
    p = table(spark, d, "part")
    width = 0.0002
    cell = lambda c: F.floor(F.col(c) / width)
    b = p.where("p_brand = 'Brand#5'").select((F.col("p_retailprice") + 0.00005).alias("v")).withColumn("cell", F.explode(F.array(cell("v") - 1, cell("v"), cell("v") + 1)))
    a = p.where("p_size > 40").withColumn("cell", cell("p_retailprice"))
    return a.join(b, (a["cell"] == b["cell"]) & (F.abs(F.col("p_retailprice") - F.col("v")) < 0.0001), "left_semi").select("p_partkey")


@named("""SELECT DISTINCT trim(v) AS v FROM (SELECT unnest([p_name, p_brand, split_part(p_name, ' ', 1) || ' ']) AS v FROM part WHERE p_size > 30) WHERE trim(v) NOT IN (SELECT p_name FROM part WHERE p_size = 1)""")
def flatten_columns_unique(spark, d):
    p = table(spark, d, "part")
    flat = p.where("p_size > 30").select(F.explode(F.array("p_name", "p_brand", F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit(" ")))).alias("v"))
    done = p.where("p_size = 1").select(F.col("p_name").alias("v"))
    return flat.select(F.btrim("v").alias("v")).distinct().join(done, "v", "left_anti")


@named("""SELECT n_name, l.n AS listed, coalesce(d.n, 0) AS detail, l.n = coalesce(d.n, 0) AS consistent FROM (SELECT n_nationkey, n_name, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL) l
LEFT JOIN (SELECT s_nationkey, count(DISTINCT s_suppkey) AS n FROM supplier GROUP BY 1) d ON s_nationkey = n_nationkey""")
def list_detail_consistency(spark, d):
    n, s = table(spark, d, "nation"), table(spark, d, "supplier")
    listed = n.join(s, F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy("n_nationkey", "n_name").agg(F.count("s_suppkey").alias("listed"))
    detail = s.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count_distinct("s_suppkey").alias("detail"))
    both = listed.join(detail, "n_nationkey", "left").na.fill(0, ["detail"])
    return both.select("n_name", "listed", "detail", (F.col("listed") == F.col("detail")).alias("consistent"))


@named("""SELECT DISTINCT p_name FROM part WHERE p_brand = 'Brand#7' AND p_name NOT IN (SELECT p_name FROM part WHERE p_brand = 'Brand#8')""")
def unmapped_check(spark, d):
    p = table(spark, d, "part")
    saved = p.where("p_brand = 'Brand#8'").select("p_name")
    return p.where("p_brand = 'Brand#7'").select("p_name").distinct().join(saved, "p_name", "left_anti")
