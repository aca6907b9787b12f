"""Facet filters and the boolean search language, over parts and their line items."""
from pyspark.sql import functions as F

from shelfmark.operators import boolsearch as B
from shelfmark.operators.search import Facets, search
from shelfmark.plans.registry import Plans
from shelfmark.sources.tables import table

PLANS = Plans()
named = PLANS.named


def parts(spark, d):
    """Parts with their name split into notes."""
    p = table(spark, d, "part")
    return p.withColumn("notes", F.split("p_name", " "))


@named("SELECT p_partkey, p_brand FROM part WHERE p_brand IN ('Brand#11', 'Brand#4')")
def facet_in_filter(spark, d):
    return table(spark, d, "part").where(F.col("p_brand").isin("Brand#11", "Brand#4")).select("p_partkey", "p_brand")


@named("SELECT p_partkey FROM part p WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND upper(l_returnflag) IN ('R') AND l_quantity > 45)")
def facet_exists_child(spark, d):
    child = table(spark, d, "lineitem").where((F.upper("l_returnflag") == "R") & (F.col("l_quantity") > 45))
    return table(spark, d, "part").join(child, F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_partkey")


@named("SELECT p_partkey, p_size FROM part WHERE p_size >= 10 AND p_size <= 20 AND p_retailprice > 0")
def facet_range(spark, d):
    return table(spark, d, "part").where(F.col("p_size").between(10, 20) & (F.col("p_retailprice") > 0)).select("p_partkey", "p_size")


@named("""SELECT p_partkey, peak FROM part JOIN (SELECT l_partkey, max(l_quantity) FILTER (l_quantity > 0) AS peak FROM lineitem GROUP BY 1) ON l_partkey = p_partkey
WHERE peak BETWEEN 40 AND 49""")
def facet_peak_range(spark, d):
    peak = table(spark, d, "lineitem").where("l_quantity > 0").groupBy("l_partkey").agg(F.max("l_quantity").alias("peak"))
    return table(spark, d, "part").join(peak.where("peak BETWEEN 40 AND 49"), F.col("p_partkey") == F.col("l_partkey")).select("p_partkey", "peak")


@named("""SELECT p_partkey, (CASE WHEN p_brand = 'Brand#3' THEN 2.0 ELSE 0 END + CASE WHEN p_size >= 40 THEN 1.0 ELSE 0 END)::DOUBLE AS score
FROM part WHERE p_type <> 'PROMO' AND (p_brand = 'Brand#3' OR p_size >= 40)""")
def facet_hard_soft(spark, d):
    f = Facets().must(F.col("p_type") != "PROMO").wish(F.col("p_brand") == "Brand#3", 2).wish(F.col("p_size") >= 40)
    return search(table(spark, d, "part"), f, True, "p_name", "p_partkey").select("p_partkey", "score")


@named("SELECT p_partkey FROM part WHERE p_type <> 'PROMO' AND p_brand = 'Brand#3' AND p_size >= 40")
def facet_strict_mode(spark, d):
    f = Facets().must(F.col("p_type") != "PROMO").wish(F.col("p_brand") == "Brand#3", 2).wish(F.col("p_size") >= 40)
    return search(table(spark, d, "part"), f, False, "p_name", "p_partkey").select("p_partkey")


def _language(name, query, sql, array=False):
    def run(spark, d):
        test = B.array_term(F.col("notes")) if array else B.scalar_term(F.col("p_name"))
        return parts(spark, d).where(B.matches(query, test)).select("p_partkey", "p_name")

    run.__doc__ = f"Parts that match {query}"
    PLANS.named(f"SELECT p_partkey, p_name FROM part WHERE {sql}", name)(run)


_language("bool_or_terms", "red | bolt", "p_name ILIKE '%red%' OR p_name ILIKE '%bolt%'")
_language("bool_and_not", "bolt & NOT red", "p_name ILIKE '%bolt%' AND NOT p_name ILIKE '%red%'")
_language("bool_parens", "(red | blue) & !bolt", "(p_name ILIKE '%red%' OR p_name ILIKE '%blue%') AND NOT p_name ILIKE '%bolt%'")
_language("bool_precedence", "red | blue & gear", "p_name ILIKE '%red%' OR (p_name ILIKE '%blue%' AND p_name ILIKE '%gear%')")
_language("wildcard_prefix", "sma*", "p_name ILIKE 'sma%'")
_language("wildcard_single", "?ed *t", "p_name ILIKE '_ed %t'")
_language("exact_scalar", '"red bolt"', "lower(p_name) = 'red bolt'")
_language("exact_element", '"bolt"', "len(list_filter(string_split(p_name, ' '), lambda x: lower(x) = 'bolt')) > 0", True)
_language("phrase_span_array", "ed bol", "array_to_string(string_split(p_name, ' '), ' ') ILIKE '%ed bol%'", True)


@named("SELECT p_partkey FROM part p WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND NOT (l_returnflag ILIKE '%n%'))")
def not_inside_exists(spark, d):
    """A negated child facet: some child does not match, not: no child matches."""
    child = table(spark, d, "lineitem").where(B.matches("!n", B.scalar_term(F.col("l_returnflag"))))
    return table(spark, d, "part").join(child, F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_partkey")


_UP = """WITH up AS (SELECT n_name AS loc, n_nationkey AS nation FROM nation
UNION ALL SELECT r_name, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey) """


def location_closure(spark, d):
    """(location, nation) with each nation below itself and its region."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    own = n.select(F.col("n_name").alias("loc"), F.col("n_nationkey").alias("nation"))
    above = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("loc"), F.col("n_nationkey").alias("nation"))
    return own.unionByName(above)


@named(_UP + "SELECT loc, count(DISTINCT s_suppkey) AS suppliers FROM up LEFT JOIN supplier ON s_nationkey = nation GROUP BY loc")
def location_rollup_counts(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"))
    return location_closure(spark, d).join(s, "nation", "left").groupBy("loc").agg(F.count_distinct("s_suppkey").alias("suppliers"))


@named(_UP + "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT nation FROM up WHERE loc IN ('ASIA', 'NATION_3'))")
def location_facet(spark, d):
    below = location_closure(spark, d).where(F.col("loc").isin("ASIA", "NATION_3"))
    return table(spark, d, "supplier").join(below, F.col("s_nationkey") == F.col("nation"), "left_semi").select("s_suppkey")


@named("SELECT p_partkey, contains(lower(p_name), 'bolt') AS hit FROM part WHERE contains(lower(strip_accents(p_name)), 'e')")
def folded_contains(spark, d):
    from shelfmark.functions.text import fold

    return table(spark, d, "part").where(F.lower(fold(F.col("p_name"))).contains("e")).select("p_partkey", F.lower("p_name").contains("bolt").alias("hit"))


@named("SELECT p_partkey, 'simple' AS kind FROM part WHERE p_name = 'red bolt' UNION ALL SELECT p_partkey, 'complex' FROM part WHERE p_name ILIKE 'red b%'")
def simple_vs_complex_match(spark, d):
    """Text without operators matches the slug; text with them is a query."""
    from shelfmark.functions.text import slug

    p = table(spark, d, "part")
    simple = p.where(slug(F.col("p_name")) == "red-bolt").select("p_partkey", F.lit("simple").alias("kind"))
    complex_ = p.where(B.matches("red b*", B.scalar_term(F.col("p_name")))).select("p_partkey", F.lit("complex").alias("kind"))
    return simple.unionByName(complex_)


@named("SELECT p_partkey FROM part WHERE p_type ILIKE '%econ%' OR p_brand ILIKE '%econ%' OR p_name ILIKE '%hot%'")
def either_column_match(spark, d):
    hit = B.matches("econ", B.scalar_term(F.col("p_type"))) | B.matches("econ", B.scalar_term(F.col("p_brand")))
    return table(spark, d, "part").where(hit | B.matches("hot", B.scalar_term(F.col("p_name")))).select("p_partkey")


@named("SELECT p_partkey FROM part WHERE p_type ILIKE 'sm%' OR len(list_filter(string_split(p_name, ' '), lambda x: x ILIKE 'sm%')) > 0")
def column_or_element_match(spark, d):
    in_column = B.matches("sm*", B.scalar_term(F.col("p_type")))
    return parts(spark, d).where(in_column | F.exists("notes", B.scalar_term_of("sm*"))).select("p_partkey")


@named("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semi_key_filter(spark, d):
    c = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(c, "o_custkey", "left_semi").select("o_orderkey")


@named("SELECT p_partkey FROM part WHERE len(list_filter(string_split(p_name, ' '), lambda x: length(x) > 5 OR contains(x, 'dg'))) > 0")
def any_element_heuristic(spark, d):
    return parts(spark, d).where(F.exists("notes", lambda x: (F.length(x) > 5) | x.contains("dg"))).select("p_partkey")


@named("SELECT p_partkey, p_type FROM part WHERE p_type IS NOT NULL AND lower(p_type) NOT IN ('promo', 'none', 'no match')")
def sentinel_exclusion(spark, d):
    p = table(spark, d, "part")
    return p.where(F.col("p_type").isNotNull() & ~F.lower("p_type").isin("promo", "none", "no match")).select("p_partkey", "p_type")


def optional(column, value):
    """The predicate ``value is null or column = value``, decided when the plan is made."""
    return F.lit(True) if value is None else F.col(column) == value


@named("SELECT p_partkey FROM part WHERE p_size = 7")
def optional_param(spark, d):
    return table(spark, d, "part").where(optional("p_brand", None) & optional("p_size", 7)).select("p_partkey")


@named("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000.0")
def named_params(spark, d):
    o = table(spark, d, "orders")
    return spark.sql(
        "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_orderstatus = :status AND o_totalprice > :least",
        args={"status": "F", "least": 100000.0},
        orders=o,
    )


@named("""SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS DOUBLE), -1.0) AS k, coalesce(value, 0.0) AS value,
coalesce(round_even(try_cast(value AS DOUBLE), 0)::INTEGER, 0) AS whole FROM events""")
def default_fill_safe_cast(spark, d):
    k = F.get_json_object("props", "$.k").try_cast("double")
    whole = F.rint("value").cast("int")
    return table(spark, d, "events").select(
        "event_id", F.coalesce(k, F.lit(-1.0)).alias("k"), F.coalesce("value", F.lit(0.0)).alias("value"), F.coalesce(whole, F.lit(0)).alias("whole")
    )


@named("SELECT p_partkey, coalesce(nullif(CASE WHEN p_size % 2 = 0 THEN '' ELSE p_type END, ''), nullif(p_brand, 'Brand#4'), 'Unknown') AS label FROM part")
def empty_as_null_chain(spark, d):
    first = F.when(F.col("p_size") % 2 == 0, "").otherwise(F.col("p_type"))
    label = F.coalesce(F.nullif(first, F.lit("")), F.nullif(F.col("p_brand"), F.lit("Brand#4")), F.lit("Unknown"))
    return table(spark, d, "part").select("p_partkey", label.alias("label"))
