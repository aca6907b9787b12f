"""Versions, patches, stock, merges and ledgers, over events, orders and customers."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfmark.operators import versions as V
from shelfmark.plans.registry import Plans
from shelfmark.sources.tables import table

PLANS = Plans()
named = PLANS.named


@named("SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_version_per_key(spark, d):
    return V.latest_by(table(spark, d, "events"), ["user_id"], ["ts", "event_id"])


@named("""SELECT user_id, event_id, ts::DATE::VARCHAR AS day FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts::DATE DESC, value DESC, event_id DESC) = 1""")
def latest_two_key_order(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.to_date("ts").alias("day"), "value")
    return V.latest_by(e, ["user_id"], ["day", "value", "event_id"]).select("user_id", "event_id", F.col("day").cast("string").alias("day"))


@named("""WITH s AS (SELECT event_type, user_id, min(ts) AS first_seen, max(ts) AS last_seen, max(ts::DATE) AS dd FROM events GROUP BY ALL),
l AS (SELECT event_type, max(ts::DATE) AS latest FROM events GROUP BY ALL)
SELECT event_type, user_id, first_seen, last_seen, dd = latest AS in_stock FROM s JOIN l USING (event_type)""")
def stock_status_from_latest_snapshot(spark, d):
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    return V.stock_status(e, "event_type", "user_id", "day", "ts")


_PATCHED = """WITH b AS (SELECT c_custkey AS user_id, c_name AS name, c_acctbal AS value, NULL::BIGINT AS k FROM customer),
p AS (SELECT user_id, ts, event_id, CASE WHEN event_type <> 'error' THEN value END AS value,
  CASE WHEN event_type IN ('click', 'purchase') THEN json_extract_string(props, '$.k')::BIGINT END AS k FROM events WHERE value >= 1),
l AS (SELECT user_id, max_by(value, (ts, event_id)) FILTER (value IS NOT NULL) AS value, max_by(k, (ts, event_id)) FILTER (k IS NOT NULL) AS k FROM p GROUP BY ALL)
SELECT user_id, name, coalesce(l.value, b.value) AS value, coalesce(l.k, b.k) AS k FROM b LEFT JOIN l USING (user_id)"""


def patches(events):
    return events.select(
        "user_id",
        "ts",
        "event_id",
        F.when(F.col("event_type") != "error", F.col("value")).alias("value"),
        F.when(F.col("event_type").isin("click", "purchase"), F.get_json_object("props", "$.k").cast("long")).alias("k"),
        F.col("value").alias("raw"),
    )


@named(_PATCHED)
def apply_patches_in_order(spark, d):
    base = table(spark, d, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("value"), F.lit(None).cast("long").alias("k")
    )
    return V.apply_patches(base, patches(table(spark, d, "events")), "user_id", "ts", ["value", "k"], "event_id", F.col("raw") >= 1)


@named("""SELECT user_id, event_id, ts, event_type, value FROM (
SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) WHERE event_type <> 'error'""")
def lww_merge_tombstones(spark, d):
    e = table(spark, d, "events").drop("props")
    return V.lww_merge(e, "user_id", ["ts", "event_id"], F.col("event_type") == "error")


@named("""SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW) AS in_window,
count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW) < 3 AS allowed FROM events""")
def rolling_24h_count(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts")
    return V.rolling_count(e, "user_id", "ts", 86_400).withColumn("allowed", F.col("in_window") < 3).drop("ts")


@named("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def ledger_anti_join(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    ledger = o.where("o_orderstatus = 'F'").select("o_orderkey")
    return o.join(ledger, "o_orderkey", "left_anti").drop("o_orderstatus")


_SLICES = """WITH o AS (SELECT o_orderkey AS k, o_totalprice AS price, o_orderpriority AS pri FROM orders WHERE o_orderkey % 3 < 2),
n AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice + 1 END AS price, CASE WHEN o_orderkey % 5 = 0 THEN 'NEW' END AS pri FROM orders WHERE o_orderkey % 3 > 0)
"""


def _slices(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    old = o.where(k % 3 < 2).select(k.alias("k"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("pri"))
    new = o.where(k % 3 > 0).select(k.alias("k"), F.when(k % 2 == 0, F.col("o_totalprice") + 1).alias("price"), F.when(k % 5 == 0, "NEW").alias("pri"))
    return old, new


@named(_SLICES + "SELECT k, coalesce(n.price, o.price) AS price, coalesce(n.pri, o.pri) AS pri FROM o FULL JOIN n USING (k)")
def upsert_coalesce(spark, d):
    return V.upsert(*_slices(spark, d), ["k"], coalesce=True)


@named(_SLICES + "SELECT * FROM n UNION ALL SELECT * FROM o WHERE k NOT IN (SELECT k FROM n)")
def upsert_replace(spark, d):
    return V.upsert(*_slices(spark, d), ["k"])


_DIGEST = """SELECT c_mktsegment, sum(n)::BIGINT AS n_rows, sha256(string_agg(leaf, '|' ORDER BY r)) AS digest FROM (
SELECT c_mktsegment, c_custkey // 1024 AS r, count(*) AS n, sha256(string_agg(c_custkey::VARCHAR || ':' || c_nationkey::VARCHAR, '|' ORDER BY c_custkey)) AS leaf
FROM @TABLE GROUP BY ALL) GROUP BY c_mktsegment"""


@named(_DIGEST.replace("@TABLE", "customer"))
def replica_digest(spark, d):
    return V.replica_digest(table(spark, d, "customer"), "c_mktsegment", "c_custkey", "c_nationkey")


_REPLICA = """(SELECT c_mktsegment, c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' AND c_custkey % 31 = 3 THEN c_nationkey + 1 ELSE c_nationkey END AS c_nationkey
FROM customer WHERE NOT (c_mktsegment = 'BUILDING' AND c_custkey % 29 = 5))"""


@named(f"""WITH a AS ({_DIGEST.replace("@TABLE", "customer")}), b AS ({_DIGEST.replace("@TABLE", _REPLICA)})
SELECT c_mktsegment, CASE WHEN a.n_rows IS DISTINCT FROM b.n_rows THEN 'count' WHEN a.digest <> b.digest THEN 'content' ELSE 'same' END AS verdict FROM a FULL JOIN b USING (c_mktsegment)""")
def replica_verify(spark, d):
    """The table against a replica that lacks rows of one segment and has others of
    another changed."""
    c = table(spark, d, "customer")
    lost = (F.col("c_mktsegment") == "BUILDING") & (F.col("c_custkey") % 29 == 5)
    changed = (F.col("c_mktsegment") == "MACHINERY") & (F.col("c_custkey") % 31 == 3)
    other = c.where(~lost).withColumn("c_nationkey", F.col("c_nationkey") + F.when(changed, 1).otherwise(0))
    a, b = (V.replica_digest(x, "c_mktsegment", "c_custkey", "c_nationkey") for x in (c, other))
    b = b.select("c_mktsegment", F.col("n_rows").alias("n2"), F.col("digest").alias("d2"))
    verdict = F.when(~F.col("n_rows").eqNullSafe(F.col("n2")), "count").when(F.col("digest") != F.col("d2"), "content").otherwise("same")
    return a.join(b, "c_mktsegment", "full_outer").select("c_mktsegment", verdict.alias("verdict"))


@named("SELECT s_suppkey, s_name, row_number() OVER (ORDER BY s_name, s_suppkey) + 1000 AS id FROM supplier")
def surrogate_keys(spark, d):
    return V.surrogate_ids(table(spark, d, "supplier").select("s_suppkey", "s_name"), ["s_name", "s_suppkey"], after=1000)


@named("SELECT * FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def cascade_delete_anti(spark, d):
    gone = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, d, "lineitem").join(gone, "l_orderkey", "left_anti")


@named("SELECT event_id, ts FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAYS")
def retention_filter(spark, d):
    e = table(spark, d, "events").select("event_id", "ts")
    newest = e.agg((F.max("ts") - F.expr("INTERVAL 7 DAYS")).alias("since"))
    return e.join(F.broadcast(newest), e["ts"] >= newest["since"]).drop("since")


@named("""SELECT user_id, count(*) FILTER (event_type = 'view') AS hits, max(ts) AS last_accessed,
count(*) FILTER (event_type = 'purchase') - count(*) FILTER (event_type = 'error') AS votes FROM events GROUP BY user_id""")
def event_counter_fold(spark, d):
    of = lambda t: F.count_if(F.col("event_type") == t)
    return table(spark, d, "events").groupBy("user_id").agg(
        of("view").alias("hits"), F.max("ts").alias("last_accessed"), (of("purchase") - of("error")).alias("votes")
    )


@named("""WITH v AS (SELECT event_type, user_id, max(ts) AS ts FROM events GROUP BY ALL)
SELECT event_type, count(*) AS votes, max(ts) AS latest, row_number() OVER (ORDER BY count(*) DESC, max(ts) DESC, event_type) AS rk FROM v GROUP BY event_type""")
def one_vote_ranking(spark, d):
    votes = table(spark, d, "events").groupBy("event_type", "user_id").agg(F.max("ts").alias("ts"))
    ranked = votes.groupBy("event_type").agg(F.count("*").alias("votes"), F.max("ts").alias("latest"))
    return ranked.withColumn("rk", F.row_number().over(Window.orderBy(F.desc("votes"), F.desc("latest"), "event_type")))


@named("""WITH l AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT user_id, event_type AS decision FROM l WHERE user_id NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def idempotent_latest_decision(spark, d):
    latest = V.latest_by(table(spark, d, "events"), ["user_id"], ["ts", "event_id"])
    done = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("user_id"))
    return latest.join(done, "user_id", "left_anti").select("user_id", F.col("event_type").alias("decision"))


@named("""WITH hit AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error')
SELECT user_id, arg_max(value, (ts, event_id)) AS value, count(*) AS replayed FROM events WHERE user_id IN (SELECT user_id FROM hit) AND event_type <> 'error' GROUP BY user_id""")
def replay_on_change(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "value", "ts", "event_id")
    hit = e.where("event_type = 'error'").select("user_id").distinct()
    log = e.where("event_type <> 'error'").join(hit, "user_id", "left_semi")
    return log.groupBy("user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.count("*").alias("replayed"))


@named("""WITH known AS (SELECT DISTINCT user_id FROM events), cur AS (SELECT DISTINCT user_id FROM events WHERE ts >= (SELECT max(ts) - INTERVAL 1 DAYS FROM events))
SELECT user_id, FALSE AS in_stock FROM known WHERE user_id NOT IN (SELECT user_id FROM cur) AND (SELECT count(*) FROM cur) > 0""")
def missing_member_patches(spark, d):
    """Patches that take absent members out of stock; none at all if the current set is empty."""
    e = table(spark, d, "events").select("user_id", "ts")
    newest = e.agg((F.max("ts") - F.expr("INTERVAL 1 DAYS")).alias("since"))
    current = e.join(F.broadcast(newest), e["ts"] >= newest["since"]).select("user_id").distinct()
    guard = current.agg((F.count("*") > 0).alias("some"))
    gone = e.select("user_id").distinct().join(current, "user_id", "left_anti")
    return gone.join(F.broadcast(guard), F.col("some")).select("user_id", F.lit(False).alias("in_stock"))


@named("""SELECT user_id, ts::DATE::VARCHAR AS day, count(*) AS n, bool_and(event_type IN ('error', 'view')) AS bogus FROM events GROUP BY ALL""")
def all_negative_group_flag(spark, d):
    e = table(spark, d, "events").groupBy("user_id", F.to_date("ts").cast("string").alias("day"))
    return e.agg(F.count("*").alias("n"), F.bool_and(F.col("event_type").isin("error", "view")).alias("bogus"))


@named("""WITH v AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version, event_type FROM events),
l AS (SELECT user_id, max(version) AS version, arg_max(event_id, version) AS entry, count(*) FILTER (event_type = 'error') AS downvotes FROM v GROUP BY user_id)
SELECT user_id, version, entry, downvotes >= 3 AS bypass, CASE WHEN downvotes >= 3 THEN version + 1 ELSE version END AS serve FROM l""")
def versioned_cache_threshold(spark, d):
    e = table(spark, d, "events")
    latest = e.groupBy("user_id").agg(
        F.count("*").alias("version"), F.max_by("event_id", F.struct("ts", "event_id")).alias("entry"), F.count_if(F.col("event_type") == "error").alias("down")
    )
    bypass = F.col("down") >= 3
    return latest.select("user_id", "version", "entry", bypass.alias("bypass"), F.when(bypass, F.col("version") + 1).otherwise(F.col("version")).alias("serve"))


@named("""SELECT user_id, sha256(string_agg(event_id::VARCHAR, ',' ORDER BY ts, event_id)) AS results_hash FROM events GROUP BY user_id""")
def result_set_hash(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id"))).alias("r"))
    ids = F.transform("r", lambda x: x["event_id"].cast("string"))
    return e.select("user_id", F.sha2(F.array_join(ids, ","), 256).alias("results_hash"))


@named("""WITH known AS (SELECT DISTINCT l_partkey AS k FROM lineitem), listed AS (SELECT p_partkey AS k, bool_or(p_size > 10) AS available FROM part GROUP BY 1),
ok AS (SELECT (SELECT count(*) FROM listed JOIN known USING (k)) > 0 AS pass)
SELECT k, coalesce(available, FALSE) AS in_stock FROM known LEFT JOIN listed USING (k), ok WHERE pass""")
def guarded_stock_feed(spark, d):
    known = table(spark, d, "lineitem").select(F.col("l_partkey").alias("k")).distinct()
    listed = table(spark, d, "part").groupBy(F.col("p_partkey").alias("k")).agg(F.bool_or(F.col("p_size") > 10).alias("available"))
    joined = known.join(listed, "k", "left")
    guard = joined.agg((F.count("available") > 0).alias("pass"))
    return joined.join(F.broadcast(guard), F.col("pass")).select("k", F.coalesce("available", F.lit(False)).alias("in_stock"))


@named("""SELECT user_id, event_id, ts = max(ts) OVER (PARTITION BY user_id) AS newest FROM events""")
def is_newest_flag(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "ts")
    return e.select("user_id", "event_id", (F.col("ts") == F.max("ts").over(Window.partitionBy("user_id"))).alias("newest"))


@named("""SELECT event_id, user_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER
(PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS header FROM events""")
def carry_forward_header(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    header = F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), ignorenulls=True).over(w)
    return table(spark, d, "events").select("event_id", "user_id", header.alias("header"))


@named("SELECT * EXCLUDE (props) FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def streaming_latest_per_key(spark, d):
    from shelfmark.streaming.feeds import latest_per_key_stream

    return latest_per_key_stream(spark, f"{d}/events.parquet", ["user_id"], ["ts", "event_id"]).drop("props")


@named("SELECT event_type, ts::DATE::VARCHAR AS day, count(*) AS n FROM events GROUP BY ALL")
def streaming_incremental_counts(spark, d):
    from shelfmark.streaming.feeds import counts_stream

    return counts_stream(spark, f"{d}/events.parquet", "ts", "event_type").withColumn("day", F.col("day").cast("string"))


@named("""SELECT user_id, event_id, epoch_us(ts) AS at_us, event_type, value FROM (
SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) WHERE event_type <> 'error'""")
def lww_stream(spark, d):
    """Upserts and tombstones as a stream with state per key."""
    from shelfmark.streaming.state import lww_stream

    rows = lww_stream(spark, f"{d}/events.parquet", "user_id", "ts", "event_id", "event_type = 'error'")
    return rows.select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"), "event_type", "value")


@named("""WITH c AS (SELECT event_id, user_id, ts, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW) AS in_window FROM events)
SELECT event_id, user_id, in_window, in_window < 3 AS allowed FROM c WHERE epoch_ms(ts) < (SELECT max(epoch_ms(ts)) - 3600000 FROM events)""")
def rate_limit_stream(spark, d):
    """Rolling counts of a day per user, as the stream gives them out behind its watermark."""
    from shelfmark.streaming.state import rolling_counts_stream

    rows = rolling_counts_stream(spark, f"{d}/events.parquet", "user_id", "ts", "event_id", 86_400)
    return rows.select("event_id", "user_id", "in_window", (F.col("in_window") < 3).alias("allowed"))


@named("""WITH w AS (SELECT event_type, unnest(range(0, 4)) AS i, epoch_us(ts) AS t FROM events), x AS (SELECT event_type, (t // 21600000000 - i) * 21600000000 AS start FROM w)
SELECT event_type, start, count(*) AS n FROM x WHERE start + 86400000000 <= ((SELECT max(epoch_ms(ts)) FROM events) - 3600000) * 1000 GROUP BY ALL""")
def sliding_windows_stream(spark, d):
    """Counts of closed windows of a day that begin every six hours."""
    from shelfmark.streaming.state import window_counts_stream

    return window_counts_stream(spark, f"{d}/events.parquet", "event_type", "ts", "24 hours", "6 hours")
