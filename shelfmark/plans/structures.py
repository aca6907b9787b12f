"""Joins by substrings and intervals, scans over large keys, trees, migrations, detectors."""
from pyspark.sql import functions as F

from shelfmark.operators import detectors, hierarchy, intervals, migrate, scans, substring
from shelfmark.plans.registry import Plans
from shelfmark.shared import checkpoint
from shelfmark.sources.tables import table

PLANS = Plans()
named = PLANS.named


@named("""WITH t AS (SELECT DISTINCT w AS term FROM (SELECT unnest(string_split_regex(lower(text), '[^a-z]+')) AS w FROM documents) WHERE w <> '')
SELECT item_id, count(*) AS terms, sum(length(term))::BIGINT AS letters, max(CASE WHEN length(term) > 6 THEN term END) AS last_long FROM benchmark JOIN t ON lower(text) LIKE '%' || term || '%' GROUP BY item_id""")
def substring_terms(spark, d):
    """Which words of any document stand in an item, within words or not."""
    from shelfmark.operators.search import words

    t = table(spark, d, "documents").select(F.explode(F.array_distinct(words(F.col("text")))).alias("term"))
    items = table(spark, d, "benchmark").select("item_id", F.lower("text").alias("low"))
    hits = substring.substring_join(items, "item_id", "low", t, "term")
    return hits.groupBy("item_id").agg(F.count("*").alias("terms"), F.sum(F.length("term")).alias("letters"), F.max(F.when(F.length("term") > 6, F.col("term"))).alias("last_long"))


@named("""WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) // 1000000 AS sec FROM events),
i AS (SELECT event_id AS interval_id, user_id, sec AS a, sec + (event_id % 7) * 3600 * (1 + (event_id % 3) * 12) AS b FROM e WHERE event_type = 'purchase')
SELECT interval_id, count(*) AS points, min(event_id) AS first, sum(event_id)::BIGINT AS total FROM e JOIN i ON i.user_id = e.user_id AND sec >= a AND sec < b GROUP BY interval_id""")
def interval_points(spark, d):
    """Events within intervals of their user that overlap and lie within each other."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("at"))
    i = F.col("event_id")
    long_ = (i % 7) * 3600 * ((i % 3) * 12 + 1)
    held = e.where("event_type = 'purchase'").select(i.alias("interval_id"), "user_id", F.col("at").alias("a"), (F.col("at") + long_).alias("b"))
    hits = intervals.interval_join(e.select("event_id", "user_id", "at"), "at", held, "a", "b", ["user_id"])
    return hits.groupBy("interval_id").agg(F.count("*").alias("points"), F.min("event_id").alias("first"), F.sum("event_id").alias("total"))


@named("""SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS header FROM events""")
def carry_forward_whole(spark, d):
    """The last signup before each event of the whole log: one key, many tasks."""
    e = table(spark, d, "events").select(F.lit(0).alias("log"), "event_id", "event_type", "ts")
    header = F.when(F.col("event_type") == "signup", F.col("event_id"))
    return scans.last_seen(e, ["log"], ["ts", "event_id"], header, "header").select("event_id", "header")


@named("""SELECT event_id, event_type, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW) AS in_window FROM events""")
def rolling_by_type(spark, d):
    """A rolling count over five keys that hold all events."""
    e = table(spark, d, "events").select("event_id", "event_type", "ts")
    return scans.rolling_count(e, "event_type", "ts", "event_id", 86_400)


@named("""WITH RECURSIVE e AS (SELECT p_partkey AS node, CASE WHEN p_partkey = 0 THEN NULL ELSE (p_partkey - 1) // 2 END AS parent FROM part),
u AS (SELECT node, node AS ancestor, 0 AS distance FROM e UNION ALL SELECT u.node, e.parent, u.distance + 1 FROM u JOIN e ON e.node = u.ancestor WHERE e.parent IS NOT NULL)
SELECT u.ancestor AS node, max(d.depth) AS depth, count(*) AS below, sum(p_size)::BIGINT AS size, max(p_retailprice) AS price
FROM u JOIN part ON p_partkey = u.node JOIN (SELECT node, max(distance) AS depth FROM u GROUP BY node) d ON d.node = u.ancestor GROUP BY u.ancestor""")
def tree_rollup(spark, d):
    """Sums of each part and all below it, in a tree of some ten levels over all parts."""
    p = table(spark, d, "part")
    key = F.col("p_partkey")
    edges = p.select(key.alias("node"), F.when(key > 0, F.floor((key - 1) / 2)).alias("parent"))
    sums = (F.count("*").alias("below"), F.sum("p_size").alias("size"), F.max("p_retailprice").alias("price"))
    return hierarchy.rolled_up(edges, "node", "parent", p.select("p_partkey", "p_size", "p_retailprice"), "p_partkey", *sums)


@named("""SELECT p_partkey, (p_partkey % 3)::INTEGER AS shape, p_name AS name, CASE WHEN p_partkey % 4 = 0 THEN 'Medium' WHEN p_partkey % 4 = 1 THEN 'Dark' END AS roast_level, p_brand AS country,
CASE WHEN p_partkey % 3 < 2 THEN greatest(p_size - 5, 0) ELSE p_size END AS low, CASE WHEN p_partkey % 3 < 2 THEN greatest(p_size - 5, 0) ELSE p_size + 100 END AS high,
CASE WHEN p_partkey % 3 <> 1 THEN p_type END AS process, 'GBP' AS currency, p_retailprice AS price, CASE WHEN p_partkey % 3 = 0 AND p_size > 10 THEN '2023-05-01T00:00:00' END AS harvest FROM part""")
def migrate_records(spark, d):
    """JSON records of three shapes in one column, as one shape."""
    k = F.col("p_partkey")
    level = F.when(k % 4 == 0, "Espresso").when(k % 4 == 1, "Dark").when(k % 4 == 2, "Burnt")
    same = [F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"), level.alias("roast_level")]
    old = (F.col("p_size") - 5).alias("elevation")
    harvest = F.when(F.col("p_size") > 10, "2023-05-01").otherwise("2019-05-01")
    zero = F.struct(*same, F.struct(F.col("p_brand").alias("country"), old).alias("origin"), F.col("p_type").alias("process"), harvest.alias("harvest_date"))
    one = F.struct(*same, F.array(F.struct(F.col("p_brand").alias("country"), old)).alias("origins"))
    two = F.struct(*same, F.array(F.struct(F.col("p_brand").alias("country"), F.col("p_size").alias("elevation_min"), (F.col("p_size") + 100).alias("elevation_max"), F.col("p_type").alias("process"))).alias("origins"))
    record = F.when(k % 3 == 0, F.to_json(zero)).when(k % 3 == 1, F.to_json(one)).otherwise(F.to_json(two))
    rows = migrate.migrated(table(spark, d, "part").select("p_partkey", record.alias("record")), "record")
    o = F.col("bean.origins")[0]
    return rows.select("p_partkey", "shape", "bean.name", "bean.roast_level", o["country"].alias("country"), o["elevation_min"].alias("low"), o["elevation_max"].alias("high"), o["process"].alias("process"), "bean.currency", "bean.price", o["harvest_date"].alias("harvest"))


@named()
def detector_consensus(spark, d):
    """Odd documents by three detectors over length, words and marks, weighted by how well
    each tells the labelled bad ones; the forest's sample is beyond SQL, tests hold it."""
    t = F.coalesce("text", F.lit(""))
    size = F.length(t).cast("double")
    share = lambda others: F.length(F.regexp_replace(t, others, "")) / (size + 1)
    features = [F.log1p(size).alias("x"), share(r"[^ \n\t]+").alias("y"), share("[^#*$%&|<>!]+").alias("z")]
    labels = table(spark, d, "labels").groupBy("doc_id").agg((1 - F.max("quality")).alias("odd"))
    # All that follows reads numbers; texts are read once.
    rows = checkpoint(table(spark, d, "documents").select("doc_id", *features)).join(labels, "doc_id", "left")
    scored, _ = detectors.consensus(rows, ["x", "y", "z"], "doc_id", "odd")
    return scored.select("doc_id", *[F.round(c, 6).alias(c) for c in ("s_forest", "s_grid", "s_distance", "score")])
