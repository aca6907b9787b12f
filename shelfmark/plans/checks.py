"""Data-quality gates."""
from pyspark.sql import functions as F

from shelfmark.operators import quality as Q
from shelfmark.operators.postings import Index, kept
from shelfmark.plans.registry import Plans
from shelfmark.shared import new_folder
from shelfmark.sources.tables import table

PLANS = Plans()
named = PLANS.named


@named("""SELECT 'nulls in ' || c AS check_name, n::DOUBLE AS actual, 0.0::DOUBLE AS threshold, n = 0 AS passed FROM (
SELECT unnest(['p_name', 'p_brand', 'p_type']) AS c, unnest([count(*) FILTER (p_name IS NULL), count(*) FILTER (p_brand IS NULL), count(*) FILTER (p_type IS NULL)]) AS n FROM part)""")
def dq_required_fields(spark, d):
    return Q.required(table(spark, d, "part"), ["p_name", "p_brand", "p_type"])


@named("""SELECT 'items without order' AS check_name, count(*)::DOUBLE AS actual, 0.0::DOUBLE AS threshold, count(*) <= 0 AS passed FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders))
UNION ALL SELECT 'customers without order', count(*), 25, count(*) <= 25 FROM (SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders))""")
def dq_referential(spark, d):
    o = table(spark, d, "orders")
    return Q.union([
        Q.orphans(table(spark, d, "lineitem"), "l_orderkey", o, "o_orderkey", "items without order"),
        Q.orphans(table(spark, d, "customer"), "c_custkey", o, "o_custkey", "customers without order", 25),
    ])


_DRIFT = "WITH b AS (SELECT o_orderpriority, count(*) AS before FROM orders GROUP BY 1), n AS (SELECT o_orderpriority, count(*) AS now FROM orders WHERE o_orderstatus <> 'P' OR o_orderpriority <> '1-URGENT' GROUP BY 1) "


@named(_DRIFT + "SELECT o_orderpriority, before, coalesce(now, 0) AS now, coalesce(now, 0) >= before * (1 - 0.02::DOUBLE) AS passed FROM b LEFT JOIN n USING (o_orderpriority)")
def dq_volume_drift(spark, d):
    o = table(spark, d, "orders")
    counts = lambda df: df.groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    return Q.drift(counts(o.where("o_orderstatus <> 'P' OR o_orderpriority <> '1-URGENT'")), counts(o), ["o_orderpriority"], "n", 0.02)


@named("SELECT 'fresh rows' AS check_name, count(*)::DOUBLE AS actual, 1.0::DOUBLE AS threshold, count(*) >= 1 AS passed FROM events WHERE ts >= (SELECT max(ts) - INTERVAL 1 DAY FROM events)")
def dq_freshness(spark, d):
    e = table(spark, d, "events").select("ts")
    newest = e.agg((F.max("ts") - F.expr("INTERVAL 1 DAY")).alias("since"))
    return Q.verdict(e.join(F.broadcast(newest), e["ts"] >= newest["since"]), "fresh rows", F.count("*"), 1, at_most=False)


@named("""SELECT (SELECT count(DISTINCT CASE o_custkey % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'GBP' ELSE 'JPY' END) FROM orders) AS currencies, 3::BIGINT AS rates,
(SELECT count(DISTINCT CASE o_custkey % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'GBP' ELSE 'JPY' END) FROM orders) <= 3 AS passed""")
def dq_normalisation(spark, d):
    from shelfmark.operators.money import latest_rates
    from shelfmark.plans.money import priced, rates

    used = priced(spark, d).agg(F.count_distinct("currency").alias("currencies"))
    known = latest_rates(rates(spark)).agg(F.count("*").alias("rates"))
    return used.join(F.broadcast(known)).withColumn("passed", F.col("currencies") <= F.col("rates"))


@named("""WITH g AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS bad, count(*) - count(DISTINCT value) AS dup, max(ts) AS newest FROM events GROUP BY 1),
i AS (SELECT user_id, 'stale' AS issue, 0 AS pri FROM g WHERE newest < (SELECT max(ts) FROM events) - INTERVAL 8 HOURS UNION ALL
SELECT user_id, 'errors', 1 FROM g WHERE bad >= n * 0.3 UNION ALL SELECT user_id, 'duplicates', 2 FROM g WHERE dup >= n * 0.1)
SELECT user_id, 'P' || min(pri)::VARCHAR AS priority, string_agg(issue, ',' ORDER BY pri) AS issues FROM i GROUP BY 1""")
def dq_issue_priority(spark, d):
    e = table(spark, d, "events")
    newest = e.agg((F.max("ts") - F.expr("INTERVAL 8 HOURS")).alias("since"))
    g = e.groupBy("user_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("bad"), (F.count("*") - F.count_distinct("value")).alias("dup"), F.max("ts").alias("newest")
    ).join(F.broadcast(newest))
    found = [("stale", F.col("newest") < F.col("since")), ("errors", F.col("bad") >= F.col("n") * 0.3), ("duplicates", F.col("dup") >= F.col("n") * 0.1)]
    issues = F.filter(F.array(*[F.when(hit, F.struct(F.lit(i).alias("pri"), F.lit(k).alias("issue"))) for i, (k, hit) in enumerate(found)]), lambda x: x.isNotNull())
    g = g.withColumn("i", issues).where(F.size("i") > 0)
    return g.select("user_id", F.concat(F.lit("P"), F.array_min("i")["pri"].cast("string")).alias("priority"), F.array_join(F.transform("i", lambda x: x["issue"]), ",").alias("issues"))


@named("""WITH s AS (SELECT event_type, count(*) AS n, count(*) FILTER (value > 1) AS ok FROM events GROUP BY 1) SELECT count(*) FILTER (ok * 2 < n) AS failed, count(*) AS total, count(*) FILTER (ok * 2 < n) * 2 < count(*) AS passed FROM s""")
def dq_batch_health(spark, d):
    """A batch fails when half of its members or more failed."""
    s = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 1).alias("ok"))
    failed = F.count_if(F.col("ok") * 2 < F.col("n"))
    return s.agg(failed.alias("failed"), F.count("*").alias("total"), (failed * 2 < F.count("*")).alias("passed"))


@named("""SELECT p_partkey, concat_ws(',', CASE WHEN p_size < 5 THEN 'size' END, CASE WHEN p_retailprice NOT BETWEEN 901 AND 1500 THEN 'price' END, CASE WHEN p_type = 'PROMO' AND p_brand = 'Brand#1' THEN 'promo' END) AS violations FROM part""")
def row_validators(spark, d):
    rules = [("size", F.col("p_size") >= 5), ("price", F.col("p_retailprice").between(901, 1500)), ("promo", ~((F.col("p_type") == "PROMO") & (F.col("p_brand") == "Brand#1")))]
    return table(spark, d, "part").select("p_partkey", F.array_join(Q.violations(rules), ",").alias("violations"))


@named("""WITH t AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '')) AS w FROM documents)
SELECT count(DISTINCT doc_id) AS docs, count(DISTINCT w) AS terms, count(DISTINCT CASE WHEN w = 'the' THEN doc_id END) AS hits, (SELECT count(*) FROM documents) - count(DISTINCT doc_id) <= 200 AS passed FROM t""")
def dq_search_index(spark, d):
    """Counts of the stored index, against the table."""
    docs = table(spark, d, "documents")
    index = kept(docs, docs, "doc_id", ["text"], "documents")
    n = index.forward().agg(F.count_if(F.col("len") > 0).alias("docs"))
    terms = spark.read.parquet(*[f"{s['home']}/blocks" for s in index.segments]).agg(F.count_distinct("term").alias("terms"))
    hits = F.lit(index.statistics(["the"])[2]["the"]).cast("long").alias("hits")
    all_ = docs.agg(F.count("*").alias("all"))
    return n.join(F.broadcast(terms)).join(F.broadcast(all_)).select("docs", "terms", hits, (F.col("all") - F.col("docs") <= 200).alias("passed"))


@named("""SELECT count(*) FILTER (doc_id % 13 <> 5)::BIGINT AS docs, coalesce(sum(len(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z]+'), lambda x: x <> ''))) FILTER (doc_id % 13 <> 5), 0)::BIGINT AS words,
count(*) FILTER (doc_id % 13 <> 5) AS listed, count(*) FILTER (doc_id % 13 = 5 AND doc_id % 17 <> 2) AS missing, count(*) FILTER (doc_id % 13 <> 5 AND doc_id % 17 = 2) AS extra FROM documents""")
def dq_index_divergence(spark, d):
    """An index that has not seen some new documents, nor that others are gone."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    index = Index(spark, new_folder(spark, "index-behind"), "doc_id", ["text"]).build(docs.where("doc_id % 13 <> 5"))
    return index.compared(docs.where("doc_id % 17 <> 2"))
