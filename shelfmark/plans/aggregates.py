"""Grouping, conditional and robust aggregates, shares, taxonomies and reports."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfmark.operators import reports as R
from shelfmark.operators.money import quantiles
from shelfmark.plans.registry import Plans
from shelfmark.sources.tables import table

PLANS = Plans()
named = PLANS.named


@named("""SELECT count(*) AS rows, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers, count(l_shipdate) AS shipped FROM lineitem""")
def distinct_counts_stats(spark, d):
    return table(spark, d, "lineitem").agg(
        F.count("*").alias("rows"), F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"), F.count("l_shipdate").alias("shipped")
    )


@named("""SELECT l_returnflag, count(*) FILTER (l_quantity > 25) AS big, count(DISTINCT CASE WHEN l_discount > 0.05 THEN l_partkey END) AS discounted, sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END)::BIGINT AS open FROM lineitem GROUP BY 1""")
def conditional_counts(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(
        F.count_if(F.col("l_quantity") > 25).alias("big"),
        F.count_distinct(F.when(F.col("l_discount") > 0.05, F.col("l_partkey"))).alias("discounted"),
        F.sum(F.when(F.col("l_linestatus") == "O", 1).otherwise(0)).alias("open"),
    )


@named("""SELECT p_brand, round(avg(nullif(p_size, 1)), 6) AS avg_size, min(nullif(p_size, 1)) AS low, max(p_size) AS high, round(avg((nullif(p_size, 1) + nullif(p_partkey % 7, 0)) / 2.0), 6)::DOUBLE AS mid FROM part GROUP BY 1""")
def null_guarded_avg_min_max(spark, d):
    size, other = F.nullif("p_size", F.lit(1)), F.nullif(F.col("p_partkey") % 7, F.lit(0))
    return table(spark, d, "part").groupBy("p_brand").agg(
        F.round(F.avg(size), 6).alias("avg_size"), F.min(size).alias("low"), F.max("p_size").alias("high"), F.round(F.avg((size + other) / F.lit(2.0)), 6).alias("mid")
    )


@named("SELECT l_returnflag, round(median(l_extendedprice / l_quantity * 100), 6) AS med, round_even(median(l_quantity), 0)::INTEGER AS whole FROM lineitem WHERE l_quantity > 0 GROUP BY 1")
def median_unit_price(spark, d):
    l = table(spark, d, "lineitem").where("l_quantity > 0").withColumn("v", F.col("l_extendedprice") / F.col("l_quantity") * 100)
    of = lambda c: quantiles(l, ["l_returnflag"], c, [0.5]).select("l_returnflag", F.col("q")[0].alias("q"))
    med, whole = of("v").select("l_returnflag", F.round("q", 6).alias("med")), of("l_quantity").select("l_returnflag", F.rint("q").cast("int").alias("whole"))
    return med.join(whole, "l_returnflag")


@named("""WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part WHERE p_type <> 'PROMO' GROUP BY ALL)
SELECT p_brand, p_type AS mode FROM c QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) = 1""")
def mode_per_group(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.mode(F.when(F.col("p_type") != "PROMO", F.col("p_type")), True).alias("mode"))


@named("SELECT p_brand, arg_max(p_name, (length(p_name), p_name)) AS display, min(p_name) AS any_name, arg_min(p_name, p_partkey) AS first_name FROM part GROUP BY 1")
def max_by_display_name(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(
        F.max_by("p_name", F.struct(F.length("p_name"), "p_name")).alias("display"), F.min("p_name").alias("any_name"), F.min_by("p_name", "p_partkey").alias("first_name")
    )


@named("SELECT l_orderkey, bool_or(l_returnflag = 'R') AS returned, bool_and(l_linestatus = 'F') AS done FROM lineitem GROUP BY 1")
def bool_or_flag(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("returned"), F.bool_and(F.col("l_linestatus") == "F").alias("done"))


@named("SELECT p_brand, string_agg(DISTINCT p_type, ' ' ORDER BY p_type) AS types FROM part GROUP BY 1")
def ordered_string_agg(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("p_type")), " ").alias("types"))


@named("SELECT r_name, string_agg(n_name || ':' || n_nationkey::VARCHAR, ',' ORDER BY n_nationkey) AS nations FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def ordered_struct_list(spark, d):
    n = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("l"))
    shown = F.transform("l", lambda x: F.concat_ws(":", x["n_name"], x["n_nationkey"].cast("string")))
    return table(spark, d, "region").join(n, "r_regionkey").select("r_name", F.array_join(shown, ",").alias("nations"))


@named("SELECT coalesce(CASE WHEN p_size > 10 THEN p_type END, p_brand) AS place, count(*) AS n FROM part GROUP BY 1")
def group_by_coalesce_expr(spark, d):
    place = F.coalesce(F.when(F.col("p_size") > 10, F.col("p_type")), F.col("p_brand"))
    return table(spark, d, "part").groupBy(place.alias("place")).agg(F.count("*").alias("n"))


@named("SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING n > 600")
def having_alias(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n")).where("n > 600")


@named("SELECT p_type, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM part GROUP BY 1")
def share_of_total(spark, d):
    counted = table(spark, d, "part").groupBy("p_type").agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.round(F.col("n") * F.lit(100.0) / F.sum("n").over(Window.partitionBy()), 6))


@named("SELECT p_brand, p_type, p_size, count(*) AS n FROM part GROUP BY ALL")
def group_all_multi(spark, d):
    return table(spark, d, "part").groupBy("p_brand", "p_type", "p_size").agg(F.count("*").alias("n"))


_TAX = """WITH t(token, top, sub) AS (VALUES ('red', 'look', 'colour'), ('blue', 'look', 'colour'), ('old', 'look', 'age'), ('bolt', 'thing', 'fixing'), ('ring', 'thing', 'fixing'), ('gear', 'thing', 'drive'), ('hot', 'feel', NULL)),
n AS (SELECT token, count(DISTINCT p_partkey) AS n FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS token FROM part) GROUP BY token)
"""


def taxonomy(spark, d):
    """token, top, sub, n: notes with their two levels and number of parts."""
    tax = spark.createDataFrame(
        [("red", "look", "colour"), ("blue", "look", "colour"), ("old", "look", "age"), ("bolt", "thing", "fixing"), ("ring", "thing", "fixing"), ("gear", "thing", "drive"), ("hot", "feel", None)],
        "token string, top string, sub string",
    )
    tokens = table(spark, d, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("token"))
    return tax.join(tokens.groupBy("token").agg(F.count_distinct("p_partkey").alias("n")), "token")


@named(_TAX + "SELECT top, coalesce(sub, '') AS sub, string_agg(token || ':' || n::VARCHAR, ',' ORDER BY n DESC, token) AS notes, sum(n)::BIGINT AS total FROM t JOIN n USING (token) GROUP BY ALL")
def two_level_taxonomy(spark, d):
    g = taxonomy(spark, d).groupBy("top", F.coalesce("sub", F.lit("")).alias("sub")).agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "token"))).alias("l"), F.sum("n").alias("total"))
    shown = F.transform("l", lambda x: F.concat_ws(":", x["token"], (-x["m"]).cast("string")))
    return g.select("top", "sub", F.array_join(shown, ",").alias("notes"), "total")


@named(_TAX + """, r AS (SELECT top, coalesce(sub, 'General') AS sub, n, token, row_number() OVER (PARTITION BY top ORDER BY n DESC, token) AS rk, count(*) OVER (PARTITION BY top) AS k FROM t JOIN n USING (token))
SELECT top, CASE WHEN rk <= 2 OR k - 2 < 2 THEN token ELSE 'Other' END AS node, sum(n)::BIGINT AS total FROM r GROUP BY ALL""")
def category_tree_other_bucket(spark, d):
    """The first two notes of each node; the rest as one, if they are two or more."""
    return R.top_with_other(taxonomy(spark, d), "top", "token", "n", 2, "node", "total")


@named("""SELECT c_mktsegment AS bucket, count(*) AS n FROM customer WHERE c_acctbal >= 0 GROUP BY 1 UNION ALL SELECT 'unknown', count(*) FROM customer WHERE c_acctbal < 0""")
def unknown_bucket_union(spark, d):
    c = table(spark, d, "customer")
    known = c.where("c_acctbal >= 0").groupBy(F.col("c_mktsegment").alias("bucket")).agg(F.count("*").alias("n"))
    return known.unionByName(c.where("c_acctbal < 0").agg(F.lit("unknown").alias("bucket"), F.count("*").alias("n")))


@named("SELECT c_mktsegment, count(DISTINCT coalesce(CASE WHEN c_acctbal > 5000 THEN c_nationkey::VARCHAR END, 'unknown-' || c_custkey::VARCHAR)) AS farms FROM customer GROUP BY 1")
def null_as_distinct_key(spark, d):
    key = F.coalesce(F.when(F.col("c_acctbal") > 5000, F.col("c_nationkey").cast("string")), F.concat(F.lit("unknown-"), F.col("c_custkey").cast("string")))
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count_distinct(key).alias("farms"))


_RULES = [("fixing", "bolt|ring"), ("drive", "gear|gizmo"), ("small", "^small"), ("thermal", "hot|cold")]


@named("""SELECT CASE WHEN regexp_matches(lower(p_name), 'bolt|ring') THEN 'fixing' WHEN regexp_matches(lower(p_name), 'gear|gizmo') THEN 'drive' WHEN regexp_matches(lower(p_name), '^small') THEN 'small'
WHEN regexp_matches(lower(p_name), 'hot|cold') THEN 'thermal' ELSE 'other' END AS class, count(*) AS n, count(DISTINCT p_brand) AS brands FROM part GROUP BY 1""")
def keyword_classifier_rollup(spark, d):
    return table(spark, d, "part").groupBy(R.first_rule(F.lower("p_name"), _RULES, "other").alias("class")).agg(F.count("*").alias("n"), F.count_distinct("p_brand").alias("brands"))


@named("""SELECT url, regexp_matches(url, 'https?://[^/]+/.*(1|2)') AND NOT regexp_matches(lower(url), '\\.(png|jpg)$') AS wanted FROM pages""")
def url_classifier(spark, d):
    path = F.coalesce(F.regexp_extract("url", "https?://[^/]+(/.*)", 1), F.lit(""))
    return table(spark, d, "pages").select("url", (path.rlike("1|2") & ~F.lower("url").rlike(r"\.(png|jpg)$")).alias("wanted"))


@named("""WITH s AS (SELECT o_custkey, list_sort(list_distinct(list(o_orderstatus))) AS st FROM orders GROUP BY 1)
SELECT o_custkey, CASE WHEN st = ['F'] THEN 'only F' WHEN list_contains(st, 'F') AND list_contains(st, 'O') THEN 'mixed' ELSE 'other' END AS profile FROM s""")
def set_profile_classification(spark, d):
    s = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderstatus")).alias("st"))
    st = F.col("st")
    profile = F.when(st == F.array(F.lit("F")), "only F").when(F.array_contains(st, "F") & F.array_contains(st, "O"), "mixed").otherwise("other")
    return s.select("o_custkey", profile.alias("profile"))


_GRID = """WITH x AS (SELECT c_mktsegment AS g, o_orderpriority AS v, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus <> 'P' OR c_mktsegment <> 'BUILDING' GROUP BY ALL),
grid AS (SELECT g, v FROM (SELECT DISTINCT g FROM x), (SELECT DISTINCT v FROM x)),
s AS (SELECT g, v, coalesce(n, 0) AS n, coalesce(n, 0) * 100.0::DOUBLE / sum(coalesce(n, 0)) OVER (PARTITION BY g) AS share FROM grid LEFT JOIN x USING (g, v))
"""


@named(_GRID + "SELECT v, round(max(share) FILTER (g = 'BUILDING') - max(share) FILTER (g = 'MACHINERY'), 6) AS delta FROM s GROUP BY v")
def group_share_delta_grid(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("g"))
    x = table(spark, d, "orders").join(c, "o_custkey").where("o_orderstatus <> 'P' OR g <> 'BUILDING'").select("g", F.col("o_orderpriority").alias("v"))
    s = R.share_grid(x, "g", "v")
    of = lambda g: F.max(F.when(F.col("g") == g, F.col("share")))
    return s.groupBy("v").agg(F.round(of("BUILDING") - of("MACHINERY"), 6).alias("delta"))


@named("""SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'X') AS x FROM orders GROUP BY 1""")
def crosstab_pivot(spark, d):
    p = table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "X"]).count().na.fill(0)
    return p.select("o_orderpriority", F.col("F").alias("f"), F.col("O").alias("o"), F.col("X").alias("x"))


@named("SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL")
def month_status_trend(spark, d):
    return table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_orderstatus").agg(F.count("*").alias("n"))


_OVER = """WITH x AS (SELECT s_name AS own, p_type AS cat FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey),
c AS (SELECT own, cat, count(*) AS n FROM x GROUP BY ALL),
s AS (SELECT own, cat, n, n::DOUBLE / sum(n) OVER (PARTITION BY own) AS share, sum(n) OVER (PARTITION BY cat)::DOUBLE / sum(n) OVER () AS everywhere, sum(n) OVER (PARTITION BY own) AS total FROM c),
p AS (SELECT *, share - everywhere AS lift, (rank() OVER (PARTITION BY cat ORDER BY share) - 1) * 100.0::DOUBLE / count(*) OVER (PARTITION BY cat) AS pct FROM s),
k AS (SELECT * FROM p WHERE n >= 3 AND share >= greatest(0.1, 3.0 / total) AND lift > 0.02 AND pct > 60)
"""


def over_index(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("cat"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("own"))
    rows = table(spark, d, "lineitem").select("l_partkey", "l_suppkey").join(p, "l_partkey").join(s, "l_suppkey")
    return R.over_index(rows, "own", "cat")


@named(_OVER + "SELECT own, cat, n, round(share, 6) AS share, round(lift, 6) AS lift, round(pct, 6) AS pct FROM k")
def over_index_report(spark, d):
    return over_index(spark, d).select("own", "cat", "n", *[F.round(c, 6).alias(c) for c in ("share", "lift", "pct")])


@named(_OVER + "SELECT own, cat, round(lift, 6) AS lift FROM k QUALIFY row_number() OVER (PARTITION BY own ORDER BY pct DESC, lift DESC, cat) = 1")
def over_index_best_overall(spark, d):
    from shelfmark.operators.versions import distinct_on

    best = distinct_on(over_index(spark, d), ["own"], [F.desc("pct"), F.desc("lift"), F.asc("cat")])
    return best.select("own", "cat", F.round("lift", 6).alias("lift"))


@named("""SELECT l_orderkey, l_linenumber, l_partkey, first_value(l_partkey) OVER w AS first_part FROM lineitem
WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_partkey, l_linenumber)""")
def first_value_window(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_quantity"), "l_partkey", "l_linenumber")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.first("l_partkey").over(w).alias("first_part"))


@named("SELECT p_brand, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM part GROUP BY 1")
def grand_total_share(spark, d):
    c = table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"))
    return c.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@named("SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn, role) AS id FROM conversations")
def natural_order_numbering(spark, d):
    from shelfmark.operators.versions import surrogate_ids

    return surrogate_ids(table(spark, d, "conversations").select("conv_id", "turn", "role"), ["conv_id", "turn", "role"]).drop("role")


@named("SELECT p_partkey, round(median(p_retailprice) OVER (PARTITION BY p_brand), 6) AS med, count(*) OVER (PARTITION BY p_brand) AS n FROM part")
def group_stat_back_to_rows(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_retailprice")
    g = quantiles(p, ["p_brand"], "p_retailprice", [0.5]).select("p_brand", F.round(F.col("q")[0], 6).alias("med"), "n")
    return p.join(g, "p_brand").select("p_partkey", "med", "n")


@named("""WITH t AS (SELECT doc_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: length(x) > 7))) AS w FROM documents)
SELECT w, count(*) AS n FROM t WHERE w NOT IN (SELECT lower(p_name) FROM part) GROUP BY w HAVING count(*) >= 25""")
def frequency_promotion(spark, d):
    """Terms that many documents have and the lexicon lacks."""
    from shelfmark.operators.search import words

    t = table(spark, d, "documents").select(F.explode(F.array_distinct(words(F.col("text")))).alias("w")).where(F.length("w") > 7)
    lexicon = table(spark, d, "part").select(F.lower("p_name").alias("w"))
    return t.groupBy("w").agg(F.count("*").alias("n")).where("n >= 25").join(lexicon, "w", "left_anti")


@named("""WITH c AS (SELECT note, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS note FROM part) GROUP BY 1),
u AS (SELECT note, n FROM c UNION ALL SELECT f, 0 FROM (VALUES ('fresh'), ('sweet'), ('round'), ('dry')) v(f) WHERE f NOT IN (SELECT note FROM c))
SELECT note, n, row_number() OVER (ORDER BY n DESC, note) AS rk FROM u QUALIFY rk <= 40""")
def count_merge_pad(spark, d):
    """Counts, filled up with defaults."""
    from shelfmark.operators.search import ranked

    p = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("note"))
    c = p.groupBy("note").agg(F.count("*").alias("n"))
    pad = spark.createDataFrame([("fresh",), ("sweet",), ("round",), ("dry",)], "note string").join(c, "note", "left_anti").withColumn("n", F.lit(0).cast("long"))
    return ranked(c.unionByName(pad), [F.desc("n"), F.asc("note")], last=40)


@named("SELECT conv_id, count(*) FILTER (role = 'user') AS users, count(*) FILTER (role = 'assistant') AS assistants, string_agg(role, ',' ORDER BY turn, role) AS roles FROM conversations GROUP BY 1")
def entity_match_counts(spark, d):
    of = lambda r: F.count_if(F.col("role") == r)
    g = table(spark, d, "conversations").groupBy("conv_id").agg(of("user").alias("users"), of("assistant").alias("assistants"), F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("l"))
    return g.select("conv_id", "users", "assistants", F.array_join(F.transform("l", lambda x: x["role"]), ",").alias("roles"))


@named("""SELECT p_type, p_brand, count(*) AS n, round(quantile_cont(p_retailprice, 0.25), 6) AS p25, round(median(p_retailprice), 6) AS p50 FROM part WHERE p_type IN ('ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL') GROUP BY ALL HAVING count(*) >= 5""")
def min_sample_class_stats(spark, d):
    """Quartile and median per brand of the classes of a fixed list, where a sample is large enough."""
    classes = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL")
    found = quantiles(table(spark, d, "part").where(F.col("p_type").isin(*classes)), ["p_type", "p_brand"], "p_retailprice", [0.25, 0.5])
    return found.where("n >= 5").select("p_type", "p_brand", "n", F.round(F.col("q")[0], 6).alias("p25"), F.round(F.col("q")[1], 6).alias("p50"))
