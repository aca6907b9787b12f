"""Arrays, structs and JSON."""
from pyspark.sql import functions as F

from shelfmark.plans.registry import Plans
from shelfmark.sources.tables import table

PLANS = Plans()
named = PLANS.named

_N = "(SELECT p_partkey, p_type, p_size, string_split(p_name || ' ' || lower(p_type), ' ') AS n FROM part)"


def notes(spark, d):
    p = table(spark, d, "part")
    return p.withColumn("notes", F.split(F.concat_ws(" ", "p_name", F.lower("p_type")), " "))


@named(f"SELECT note, count(DISTINCT p_partkey) AS parts, row_number() OVER (ORDER BY count(DISTINCT p_partkey) DESC, note) AS rk FROM (SELECT p_partkey, unnest(n) AS note FROM {_N}) GROUP BY note QUALIFY rk <= 10")
def explode_topn(spark, d):
    from shelfmark.operators.search import ranked

    counted = notes(spark, d).select("p_partkey", F.explode("notes").alias("note")).groupBy("note").agg(F.count_distinct("p_partkey").alias("parts"))
    return ranked(counted, [F.desc("parts"), F.asc("note")], last=10)


@named(f"SELECT v, count(*) AS rows FROM (SELECT unnest(CASE WHEN len(list_filter(n, lambda x: length(x) > 5)) > 0 THEN list_filter(n, lambda x: length(x) > 5) ELSE [p_type] END) AS v FROM {_N}) GROUP BY v")
def explode_or_fallback(spark, d):
    long = F.filter("notes", lambda x: F.length(x) > 5)
    return notes(spark, d).select(F.explode(F.when(F.size(long) > 0, long).otherwise(F.array("p_type"))).alias("v")).groupBy("v").agg(F.count("*").alias("rows"))


@named(f"SELECT p_partkey, unnest(n) AS note, unnest(list_transform(n, lambda x: length(x))) AS size FROM {_N}")
def zip_explode(spark, d):
    p = notes(spark, d).withColumn("sizes", F.transform("notes", lambda x: F.length(x).cast("long")))
    return p.select("p_partkey", F.inline(F.arrays_zip(F.col("notes").alias("note"), F.col("sizes").alias("size"))))


@named(f"SELECT p_partkey, array_to_string(list_transform(n, lambda x: upper(x) || '!'), '|') AS shouted FROM {_N}")
def array_transform(spark, d):
    return notes(spark, d).select("p_partkey", F.array_join(F.transform("notes", lambda x: F.concat(F.upper(x), F.lit("!"))), "|").alias("shouted"))


@named(f"SELECT p_partkey, list_contains(n, 'bolt') AS has, nullif(list_position(n, 'bolt'), 0)::BIGINT AS place, len(n)::BIGINT AS size, n[1] AS head, n[-1] AS last, n[1] IN ('red', 'hot') AS any_of FROM {_N}")
def array_predicates(spark, d):
    n = F.col("notes")
    return notes(spark, d).select(
        "p_partkey",
        F.array_contains(n, "bolt").alias("has"),
        F.nullif(F.array_position(n, "bolt"), F.lit(0)).alias("place"),
        F.size(n).cast("long").alias("size"),
        F.element_at(n, 1).alias("head"),
        F.element_at(n, -1).alias("last"),
        F.element_at(n, 1).isin("red", "hot").alias("any_of"),
    )


@named("SELECT p_partkey, p_brand || '/' || p_size::VARCHAR AS label, p_size > 25 AS big FROM part")
def struct_access(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size")).alias("s"))
    return p.select("p_partkey", F.concat_ws("/", "s.brand", F.col("s.size").cast("string")).alias("label"), (F.col("s.size") > 25).alias("big"))


_CATEGORIES = [("red", "colour"), ("blue", "colour"), ("hot", "heat"), ("bolt", "hardware"), ("ring", "hardware"), ("gear", "hardware")]
_CATS = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in _CATEGORIES) + "}"


def category_map():
    return F.create_map(*[F.lit(x) for pair in _CATEGORIES for x in pair])


@named(f"SELECT p_partkey, array_to_string(list_transform(n, lambda x: x || '=' || coalesce({_CATS}[x], '?')), ',') AS enriched FROM {_N}")
def enrich_array_with_map(spark, d):
    """Each note with its category, in the order of the notes."""
    enriched = F.transform("notes", lambda x: F.concat(x, F.lit("="), F.coalesce(F.try_element_at(category_map(), x), F.lit("?"))))
    return notes(spark, d).select("p_partkey", F.array_join(enriched, ",").alias("enriched"))


@named(f"SELECT p_partkey, array_to_string(list_concat(list_filter(n, lambda x: {_CATS}[x] IS NOT NULL), list_filter(n, lambda x: {_CATS}[x] IS NULL)), ',') AS ordered FROM {_N}")
def categorised_first(spark, d):
    """A stable reorder: notes that have a category come first."""
    known = lambda x: F.map_contains_key(category_map(), x)
    ordered = F.concat(F.filter("notes", known), F.filter("notes", lambda x: ~known(x)))
    return notes(spark, d).select("p_partkey", F.array_join(ordered, ",").alias("ordered"))


@named("SELECT p_partkey, 0::BIGINT AS n, '' AS joined FROM part WHERE p_size = 3")
def typed_empty_array(spark, d):
    p = table(spark, d, "part").where("p_size = 3").withColumn("tags", F.array().cast("array<string>"))
    return p.select("p_partkey", F.size("tags").cast("long").alias("n"), F.array_join("tags", ",").alias("joined"))


@named(f"SELECT p_partkey, array_to_string(list_distinct_ordered, ',') AS uniq FROM (SELECT p_partkey, list_filter(m, lambda x, i: list_position(m, x) = i) AS list_distinct_ordered FROM (SELECT p_partkey, list_concat(n, n, [lower(p_type)]) AS m FROM {_N}))")
def ordered_distinct_list(spark, d):
    doubled = F.concat("notes", "notes", F.array(F.lower("p_type")))
    return notes(spark, d).select("p_partkey", F.array_join(F.array_distinct(doubled), ",").alias("uniq"))


@named("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, json_extract_string(props, '$.none') AS none FROM events")
def json_field_extract(spark, d):
    parsed = F.from_json("props", "k bigint, none string")
    return table(spark, d, "events").select("event_id", parsed["k"].alias("k"), parsed["none"].alias("none"))


@named("""SELECT conv_id, turn, i AS sentence, conv_id::VARCHAR || '_' || turn::VARCHAR || '_' || i::VARCHAR AS id FROM (
SELECT conv_id, turn, unnest(range(len(string_split(text, chr(10))))) AS i FROM conversations)""")
def posexplode_ids(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    i = F.col("i").cast("long")
    return rows.select("conv_id", "turn", i.alias("sentence"), F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string"), i.cast("string")).alias("id"))


@named("SELECT l_orderkey, bool_or(l_quantity > 30) AS in_stock FROM lineitem GROUP BY l_orderkey")
def any_variant_available(spark, d):
    variants = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct((F.col("l_quantity") > 30).alias("available"))).alias("v"))
    return variants.select("l_orderkey", F.exists("v", lambda v: v["available"]).alias("in_stock"))


@named("""SELECT l_orderkey, string_agg(q::VARCHAR, ',' ORDER BY q) AS options FROM (SELECT DISTINCT l_orderkey, l_quantity::INTEGER AS q FROM lineitem) GROUP BY l_orderkey""")
def distinct_struct_list(spark, d):
    """Options of an order without repeats: a set of structs, ordered."""
    o = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.struct(F.col("l_quantity").cast("int").alias("q"))).alias("o"))
    return o.select("l_orderkey", F.array_join(F.transform(F.array_sort("o"), lambda x: x["q"].cast("string")), ",").alias("options"))
