"""Scalar text functions: paths, slugs, parsed prices and weights, digests."""
from pyspark.sql import functions as F

from shelfmark.functions import text as T
from shelfmark.plans.registry import Plans
from shelfmark.sources.tables import table

PLANS = Plans()
named = PLANS.named


@named("SELECT page_id, split_part(url, '/', -1) AS leaf, split_part(url, '/', -2) AS folder, regexp_extract(url, 'https?://([^/]+)', 1) AS host FROM pages")
def path_parse(spark, d):
    return table(spark, d, "pages").select(
        "page_id",
        F.split_part("url", F.lit("/"), F.lit(-1)).alias("leaf"),
        F.split_part("url", F.lit("/"), F.lit(-2)).alias("folder"),
        F.regexp_extract("url", "https?://([^/]+)", 1).alias("host"),
    )


@named("SELECT page_id, url_decode(replace(url, 'e', '%65')) = url AS same FROM pages")
def url_decode_match(spark, d):
    return table(spark, d, "pages").select("page_id", (F.url_decode(F.replace("url", F.lit("e"), F.lit("%65"))) == F.col("url")).alias("same"))


@named("""WITH x AS (SELECT p_partkey, p_size::VARCHAR || CASE p_partkey % 4 WHEN 0 THEN ' g' WHEN 1 THEN 'kg' WHEN 2 THEN ' oz' ELSE ' lb' END AS w, 'from $1,' || (100 + p_size)::VARCHAR || '.50' AS c FROM part)
SELECT p_partkey, trunc(regexp_extract(w, '[0-9]+')::DOUBLE * CASE p_partkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 1000.0 WHEN 2 THEN 28.35 ELSE 453.59 END::DOUBLE)::INTEGER AS grams, regexp_extract(replace(c, ',', ''), '[0-9]+(\\.[0-9]+)?')::DOUBLE AS price FROM x""")
def weight_price_parse(spark, d):
    p = table(spark, d, "part")
    code = F.col("p_partkey") % 4
    unit = F.when(code == 0, " g").when(code == 1, "kg").when(code == 2, " oz").otherwise(" lb")
    shown = F.concat(F.lit("from $1,"), (F.col("p_size") + 100).cast("string"), F.lit(".50"))
    return p.select("p_partkey", T.grams(F.concat(F.col("p_size").cast("string"), unit)).alias("grams"), T.price(shown).alias("price"))


@named("""SELECT doc_id, regexp_replace(trim(regexp_replace(regexp_replace(lower(strip_accents(text)), '[^\\x00-\\x7F]', '', 'g'), '[^a-z0-9\\s-]', '', 'g')), '[\\s-]+', '-', 'g') AS slug FROM documents""")
def slugify(spark, d):
    return table(spark, d, "documents").select("doc_id", T.slug(F.col("text")).alias("slug"))


@named("SELECT s_suppkey, regexp_replace(replace(lower(s_name), ' ', '_'), '[^a-z0-9&_''-]', '_', 'g') AS slug FROM supplier", "roaster_slug")
def owner_slugs(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", T.owner_slug(F.col("s_name")).alias("slug"))


@named("SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(p_name || ' and Farm ' || p_type), '[a-z]{3,}'), lambda x: x NOT IN ('and', 'family', 'families', 'brothers', 'sisters', 'smallholder', 'smallholders', 'farmers', 'producers', 'various', 'regional', 'lot', 'collective', 'community', 'cooperative', 'coop', 'coffee', 'farm', 'finca', 'proyecto', 'project', 'small', 'farming')))), ',') AS names FROM part")
def surname_tokens(spark, d):
    full = F.concat_ws(" ", "p_name", F.lit("and Farm"), "p_type")
    return table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(T.surnames(full)), ",").alias("names"))


@named("SELECT c_custkey, sha256(trim(regexp_replace(lower('  ' || c_name || '   X '), '\\s+', ' ', 'g'))) AS query_hash, left(sha256(c_name), 8) AS short FROM customer")
def sha_key(spark, d):
    padded = F.concat(F.lit("  "), "c_name", F.lit("   X "))
    return table(spark, d, "customer").select("c_custkey", T.query_hash(padded).alias("query_hash"), F.left(F.sha2("c_name", 256), F.lit(8)).alias("short"))


@named("""SELECT page_id, regexp_replace(regexp_replace(split_part(url, '/', -1), '\\.[a-z]+$', ''), '_[0-9]{6}$', '') AS slug FROM pages""")
def slug_from_path(spark, d):
    leaf = F.split_part("url", F.lit("/"), F.lit(-1))
    return table(spark, d, "pages").select("page_id", F.regexp_replace(F.regexp_replace(leaf, r"\.[a-z]+$", ""), "_[0-9]{6}$", "").alias("slug"))


@named("SELECT page_id, array_to_string(list_distinct_o, ' ') AS links FROM (SELECT page_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS list_distinct_o FROM (SELECT page_id, regexp_extract_all(html, 'href=\"([^\"]+)\"', 1) AS l FROM pages))")
def page_links(spark, d):
    """Links of a page, each once, in order."""
    return table(spark, d, "pages").select("page_id", F.array_join(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))), " ").alias("links"))


@named("""SELECT s_suppkey, trim(regexp_replace(regexp_replace(lower(CASE s_suppkey % 3 WHEN 0 THEN 'Finca ' WHEN 1 THEN 'Fazenda Hacienda ' ELSE '' END || s_name
  || CASE s_suppkey % 4 WHEN 0 THEN ' Coffee Farm' WHEN 1 THEN ' Washing Station' WHEN 2 THEN ' Village Coffee' ELSE ' Estate' END),
  '^(finca|hacienda|fazenda) ', ''), ' (coffee processing center|coffee farm|washing station|drying station|community farmers|coffee|station|farm|village)$', '')) AS bare FROM supplier""")
def farm_name_normaliser(spark, d):
    key = F.col("s_suppkey")
    before = F.when(key % 3 == 0, "Finca ").when(key % 3 == 1, "Fazenda Hacienda ").otherwise("")
    after = F.when(key % 4 == 0, " Coffee Farm").when(key % 4 == 1, " Washing Station").when(key % 4 == 2, " Village Coffee").otherwise(" Estate")
    return table(spark, d, "supplier").select("s_suppkey", T.bare_name(F.concat(before, "s_name", after)).alias("bare"))


@named("SELECT o_orderkey, coalesce(strftime(o_orderdate, '%B %Y'), 'Earlier') AS label FROM orders")
def month_label(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.coalesce(F.date_format("o_orderdate", "MMMM yyyy"), F.lit("Earlier")).alias("label"))


@named("SELECT p_partkey, trim(left(trim(regexp_replace(regexp_replace(p_name || '?? ' || p_brand, '[^A-Za-z0-9_-]', '_', 'g'), '_+', '_', 'g'), '_'), 100)) || '_' || left(sha256(p_name), 8) AS uid FROM part")
def uid_slug(spark, d):
    name = F.concat("p_name", F.lit("?? "), "p_brand")
    return table(spark, d, "part").select("p_partkey", F.concat_ws("_", T.file_slug(name), F.left(F.sha2("p_name", 256), F.lit(8))).alias("uid"))
