"""Prices, rates, robust statistics and anomaly scores."""
from pyspark.sql import functions as F

from shelfmark.operators import money as M
from shelfmark.plans.registry import Plans
from shelfmark.shared import checkpoint
from shelfmark.sources.tables import table

PLANS = Plans()
named = PLANS.named

_RATES = "rates AS (SELECT currency, max_by(rate, seen) AS rate FROM (VALUES ('EUR', 0.9::DOUBLE, 1), ('EUR', 0.8, 2), ('GBP', 0.75, 1), ('USD', 1.0, 2)) v(currency, rate, seen) GROUP BY currency)"
_PRICED = f"WITH {_RATES}, o AS (SELECT o_orderkey, o_totalprice, CASE o_custkey % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'GBP' ELSE 'JPY' END AS currency FROM orders) "


def rates(spark):
    return spark.createDataFrame([("EUR", 0.9, 1), ("EUR", 0.8, 2), ("GBP", 0.75, 1), ("USD", 1.0, 2)], "currency string, rate double, fetched_at int")


def priced(spark, d):
    code = F.col("o_custkey") % 4
    currency = F.when(code == 0, "USD").when(code == 1, "EUR").when(code == 2, "GBP").otherwise("JPY")
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice", currency.alias("currency"))


@named(_PRICED + "SELECT o_orderkey, CASE WHEN o_totalprice IS NULL OR o_totalprice = 0 THEN NULL WHEN currency = 'USD' THEN o_totalprice ELSE o_totalprice / coalesce(rate, 1.0) END AS usd FROM o LEFT JOIN rates USING (currency)")
def usd_price_latest_rate(spark, d):
    rows = M.with_rate(priced(spark, d), rates(spark), "currency")
    return rows.select("o_orderkey", M.to_base_for_load(F.col("o_totalprice"), F.col("currency"), F.col("rate")).alias("usd"))


@named(_PRICED + "SELECT o_orderkey, CASE WHEN currency = 'GBP' OR o_totalprice = 0 THEN o_totalprice ELSE o_totalprice / rate * (SELECT rate FROM rates WHERE currency = 'GBP') END AS gbp FROM o LEFT JOIN rates USING (currency)")
def convert_via_base(spark, d):
    rows = M.with_rate(priced(spark, d).withColumn("target", F.lit("GBP")), rates(spark), "currency", "from_rate")
    rows = M.with_rate(rows, rates(spark), "target", "to_rate")
    return rows.select("o_orderkey", M.convert(F.col("o_totalprice"), F.col("currency"), F.col("target"), F.col("from_rate"), F.col("to_rate")).alias("gbp"))


@named(_PRICED + "SELECT o_orderkey FROM o LEFT JOIN rates USING (currency) WHERE o_totalprice / rate BETWEEN 50000 / 0.8 AND 100000 / 0.8")
def price_filter_converted(spark, d):
    """Bounds are converted once, on the driver, by the newest rate (one number)."""
    rate = M.latest_rates(rates(spark)).where("currency = 'EUR'").first()["rate"]
    rows = M.with_rate(priced(spark, d), rates(spark), "currency")
    return rows.where((F.col("o_totalprice") / F.col("rate")).between(50000 / rate, 100000 / rate)).select("o_orderkey")


@named(_PRICED + "SELECT o_orderkey, o_totalprice / coalesce(rate, 1.0) * 0.75 AS shown FROM o LEFT JOIN rates USING (currency)")
def display_price(spark, d):
    rows = M.with_rate(priced(spark, d), rates(spark), "currency")
    return rows.select("o_orderkey", (F.col("o_totalprice") / F.coalesce("rate", F.lit(1.0)) * 0.75).alias("shown"))


@named("SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice / (l_quantity / 1000.0) AS per_kg, l_extendedprice / l_quantity * 250 AS per_250 FROM lineitem WHERE l_quantity > 0")
def unit_price_per_kg(spark, d):
    l = table(spark, d, "lineitem").where("l_quantity > 0")
    return l.select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_extendedprice") / (F.col("l_quantity") / 1000.0)).alias("per_kg"), (F.col("l_extendedprice") / F.col("l_quantity") * 250).alias("per_250"))


@named("SELECT l_partkey, min(struct_pack(a := abs(l_quantity - 20), q := l_quantity, p := l_extendedprice)).q AS quantity FROM lineitem GROUP BY l_partkey")
def closest_to_target(spark, d):
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(F.min(F.struct(F.abs(F.col("l_quantity") - 20), "l_quantity", "l_extendedprice"))["l_quantity"].alias("quantity"))


@named("SELECT p_partkey, p_retailprice / (p_size * 10) AS per_gram, p_retailprice / (p_size * 10) NOT BETWEEN 0.01 AND 2.5 AS suspicious FROM part WHERE p_size > 0")
def price_bounds_flag(spark, d):
    per = F.col("p_retailprice") / (F.col("p_size") * 10)
    return table(spark, d, "part").where("p_size > 0").select("p_partkey", per.alias("per_gram"), (~per.between(0.01, 2.5)).alias("suspicious"))


@named("""SELECT p_partkey, CASE WHEN a > b AND a > 0 AND b > 0 THEN b ELSE a END AS low, CASE WHEN a > b AND a > 0 AND b > 0 THEN a ELSE b END AS high,
CASE WHEN least(a, b) = greatest(a, b) THEN a::VARCHAR ELSE least(a, b)::VARCHAR || '-' || greatest(a, b)::VARCHAR END AS label
FROM (SELECT p_partkey, p_size AS a, (p_partkey % 50)::INTEGER AS b FROM part)""")
def swap_reversed_bounds(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").alias("a"), (F.col("p_partkey") % 50).cast("int").alias("b"))
    swap = (F.col("a") > F.col("b")) & (F.col("a") > 0) & (F.col("b") > 0)
    low, high = F.least("a", "b"), F.greatest("a", "b")
    label = F.when(low == high, F.col("a").cast("string")).otherwise(F.concat_ws("-", low.cast("string"), high.cast("string")))
    return p.select("p_partkey", F.when(swap, F.col("b")).otherwise(F.col("a")).alias("low"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("high"), label.alias("label"))


_BANDS = """WITH x AS (SELECT p_brand, l_extendedprice / l_quantity AS v FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity > 0),
g AS (SELECT quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.5) AS b, quantile_cont(v, 0.75) AS c FROM x),
o AS (SELECT p_brand, count(*) AS n, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.5) AS b, quantile_cont(v, 0.75) AS c FROM x GROUP BY 1 HAVING count(*) >= 3)
"""


@named(_BANDS + "SELECT p_brand, n, round(CASE WHEN n < 2400 THEN g.a ELSE o.a END, 6) AS p25, round(CASE WHEN n < 2400 THEN g.b ELSE o.b END, 6) AS p50, round(CASE WHEN n < 2400 THEN g.c ELSE o.c END, 6) AS p75 FROM o, g")
def quantile_bands_with_fallback(spark, d):
    """Quartiles per brand; brands with few rows take those of all rows."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    x = table(spark, d, "lineitem").where("l_quantity > 0").join(p, "l_partkey").select("p_brand", (F.col("l_extendedprice") / F.col("l_quantity")).alias("v"))
    counted = M.value_counts(x, ["p_brand"], "v")
    own = M.quantiles(counted, ["p_brand"], "v", [0.25, 0.5, 0.75]).where("n >= 3")
    bands = own.join(F.broadcast(M.quantiles(counted, [], "v", [0.25, 0.5, 0.75]).select(F.col("q").alias("g"))))
    pick = lambda i: F.round(F.when(F.col("n") < 2400, F.col("g")[i]).otherwise(F.col("q")[i]), 6)
    return bands.select("p_brand", "n", pick(0).alias("p25"), pick(1).alias("p50"), pick(2).alias("p75"))


_RATIO = """WITH x AS (SELECT p_partkey, p_brand, p_type, p_retailprice / p_size AS v FROM part WHERE p_size > 0),
m AS (SELECT p_brand, p_type, count(*) AS n, CASE WHEN count(*) >= 15 THEN median(v) ELSE (SELECT median(v) FROM x) END AS med FROM x GROUP BY ALL)
"""


def _unit(spark, d):
    return table(spark, d, "part").where("p_size > 0").select("p_partkey", "p_brand", "p_type", (F.col("p_retailprice") / F.col("p_size")).alias("v"))


@named(_RATIO + "SELECT p_brand, p_type, n, round(med, 6) AS med FROM m")
def shrunk_group_median(spark, d):
    return M.shrunk_median(_unit(spark, d), ["p_brand", "p_type"], "v", 15, "med").withColumn("med", F.round("med", 6))


@named(_RATIO + """, r AS (SELECT p_partkey, ln(v / med + 1e-4) AS ratio FROM x JOIN m USING (p_brand, p_type)), q AS (SELECT quantile_cont(ratio, 0.25) AS a, median(ratio) AS b, quantile_cont(ratio, 0.75) AS c FROM r)
SELECT p_partkey, round((ratio - b) / CASE WHEN c - a = 0 THEN 1.0 ELSE c - a END, 5) AS scaled FROM r, q""")
def robust_scale_log_ratio(spark, d):
    return log_ratio(spark, d, ["p_brand", "p_type"], 15, "scaled")


def log_ratio(spark, d, groups, least, out):
    x = _unit(spark, d)
    rows = x.join(M.shrunk_median(x, groups, "v", least, "med"), groups)
    ratio = rows.select("p_partkey", F.log(F.col("v") / F.col("med") + 1e-4).alias(out))
    return M.robust_scale(ratio, [out]).withColumn(out, F.round(out, 5))


_ENSEMBLE = """WITH x AS (SELECT p_partkey, p_name, p_size, p_brand, p_type, p_retailprice / p_size AS v FROM part WHERE p_size > 0),
a AS (SELECT p_brand, CASE WHEN count(*) >= 5 THEN median(v) ELSE (SELECT median(v) FROM x) END AS ma FROM x GROUP BY 1),
b AS (SELECT p_type, CASE WHEN count(*) >= 5 THEN median(v) ELSE (SELECT median(v) FROM x) END AS mb FROM x GROUP BY 1),
r AS (SELECT p_partkey, p_name, p_size, abs(ln(v / ma + 1e-4)) AS f, abs(ln(v / mb + 1e-4)) AS g FROM x JOIN a USING (p_brand) JOIN b USING (p_type)),
s AS (SELECT *, (f - min(f) OVER ()) / (max(f) OVER () - min(f) OVER ()) AS sf, (g - min(g) OVER ()) / (max(g) OVER () - min(g) OVER ()) AS sg FROM r),
t AS (SELECT *, 0.5 * sf + 0.5 * sg AS score FROM s)
"""


def ensemble(spark, d):
    """Two detectors (distance from the brand's and the type's median), each scaled to
    0..1, and their mean."""
    x = table(spark, d, "part").where("p_size > 0").select("p_partkey", "p_name", "p_size", "p_brand", "p_type", (F.col("p_retailprice") / F.col("p_size")).alias("v"))
    counted = M.value_counts(x, ["p_brand", "p_type"], "v")
    rows = x.join(M.shrunk_median(counted, ["p_brand"], "v", 5, "ma").drop("n"), "p_brand").join(M.shrunk_median(counted, ["p_type"], "v", 5, "mb").drop("n"), "p_type")
    far = lambda m: F.abs(F.log(F.col("v") / F.col(m) + 1e-4))
    scaled = M.min_max(checkpoint(rows.select("p_partkey", "p_name", "p_size", far("ma").alias("sf"), far("mb").alias("sg"))), ["sf", "sg"])
    return scaled.withColumn("score", F.col("sf") * 0.5 + F.col("sg") * 0.5)


@named(_ENSEMBLE + "SELECT p_partkey, round(score, 6) AS score FROM t")
def anomaly_ensemble(spark, d):
    return ensemble(spark, d).select("p_partkey", F.round("score", 6).alias("score"))


@named(_ENSEMBLE + "SELECT p_partkey, round(CASE WHEN p_size <= 12 AND regexp_matches(p_name, 'ring|gear') THEN score * 0.75 ELSE score END, 6) AS damped, (CASE WHEN p_size <= 12 AND regexp_matches(p_name, 'ring|gear') THEN score * 0.75 ELSE score END) > 0.5 AS flagged FROM t")
def premium_damping(spark, d):
    damped = F.when((F.col("p_size") <= 12) & F.col("p_name").rlike("ring|gear"), F.col("score") * 0.75).otherwise(F.col("score"))
    return ensemble(spark, d).select("p_partkey", F.round(damped, 6).alias("damped"), (damped > 0.5).alias("flagged"))


_CLASSED = """WITH x AS (SELECT l.doc_id, l.quality, length(regexp_replace(text, '[^#*$%&|<>!]', '', 'g'))::DOUBLE / (length(text) + 1) AS s FROM labels l JOIN documents USING (doc_id)) """


def classed(spark, d):
    """Labelled documents with the share of odd marks as a score, which is made before the
    join, so that no text moves."""
    share = F.length(F.regexp_replace("text", "[^#*$%&|<>!]", "")).cast("double") / (F.length("text") + 1)
    docs = table(spark, d, "documents").select("doc_id", share.alias("s"))
    return table(spark, d, "labels").select("doc_id", "quality").join(docs, "doc_id").select("doc_id", "quality", "s")


@named(_CLASSED + """, t AS (SELECT i / 100.0::DOUBLE AS th FROM range(101) r(i)), c AS (SELECT th, count(*) FILTER (s >= th AND quality = 0) AS tp, count(*) FILTER (s >= th AND quality = 1) AS fp, count(*) FILTER (s < th AND quality = 0) AS fn FROM t, x GROUP BY th)
SELECT th, tp, fp, fn, CASE WHEN tp + fp = 0 THEN 1.0 ELSE round(tp / (tp + fp), 6) END AS precision, round(tp / (tp + fn), 6) AS recall FROM c""")
def precision_recall_curve(spark, d):
    """101 thresholds; without predicted positives precision counts as 1. Rows are put
    into 101 bins once and summed from the top, instead of being met with each threshold."""
    from pyspark.sql import Window

    th = spark.range(101).select((F.col("id") / F.lit(100.0)).alias("th"), F.col("id").alias("bin"))
    binned = classed(spark, d).select("quality", F.floor(F.col("s") * 100 + 1e-9).alias("bin"))
    counts = binned.groupBy(F.least("bin", F.lit(100)).alias("bin")).agg(F.count_if(F.col("quality") == 0).alias("p"), F.count_if(F.col("quality") == 1).alias("n"))
    rows = th.join(counts, "bin", "left").na.fill(0, ["p", "n"])
    down = Window.orderBy(F.desc("bin"))
    all_ = Window.partitionBy()
    rows = rows.select("th", F.sum("p").over(down).alias("tp"), F.sum("n").over(down).alias("fp"), F.sum("p").over(all_).alias("_p"))
    rows = rows.withColumn("fn", F.col("_p") - F.col("tp"))
    precision = F.when(F.col("tp") + F.col("fp") == 0, 1.0).otherwise(F.round(F.col("tp") / (F.col("tp") + F.col("fp")), 6))
    return rows.select("th", "tp", "fp", "fn", precision.alias("precision"), F.round(F.col("tp") / F.col("_p"), 6).alias("recall"))


@named(_CLASSED + """, r AS (SELECT quality, (rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0) AS rk FROM x)
SELECT round((sum(rk) FILTER (quality = 0) - count(*) FILTER (quality = 0) * (count(*) FILTER (quality = 0) + 1) / 2.0) / (count(*) FILTER (quality = 0) * count(*) FILTER (quality = 1)), 6)::DOUBLE AS auc FROM r""")
def roc_auc(spark, d):
    """Rank sum over distinct scores: pairs won plus half of the pairs tied. Scores are
    range-partitioned; the pairs between partitions come from one sum for each."""
    from pyspark.sql import Window

    by = classed(spark, d).groupBy("s").agg(F.count_if(F.col("quality") == 0).alias("p"), F.count_if(F.col("quality") == 1).alias("n"))
    parted = by.repartitionByRange("s").withColumn("_part", F.spark_partition_id())
    below = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = parted.select("_part", "p", "n", (F.col("p") * (below(Window.partitionBy("_part").orderBy("s")) + F.col("n") / 2.0)).alias("w"))
    # One row per partition.
    sums = inside.groupBy("_part").agg(*[F.sum(c).alias(c) for c in ("p", "n", "w")])
    won = sums.select("p", "n", (F.col("w") + F.col("p") * below(Window.orderBy("_part"))).alias("w"))
    return won.agg(F.round(F.sum("w") / (F.sum("p") * F.sum("n")), 6).alias("auc"))
