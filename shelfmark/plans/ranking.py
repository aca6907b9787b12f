"""Search and ranking queries. Where a rank is a column, its order is total."""
from pyspark.sql import functions as F

from shelfmark.operators.postings import Index, kept
from shelfmark.operators.search import bm25, diversified, ordinal_closeness, position_decay, ranked
from shelfmark.plans.registry import Plans
from shelfmark.shared import new_folder
from shelfmark.sources.tables import table

PLANS = Plans()
named = PLANS.named


@named("""WITH s AS (SELECT p_partkey, p_name,
    CASE WHEN contains(lower(p_name), 'small') THEN 3.0::DOUBLE ELSE 0 END
    + CASE WHEN p_brand = 'Brand#11' THEN 1.0::DOUBLE ELSE 0 END
    + CASE WHEN p_size >= 25 THEN 0.5::DOUBLE ELSE 0 END AS score FROM part)
SELECT * FROM s WHERE score > 0 ORDER BY score DESC, p_name, p_partkey LIMIT 25""")
def relevance_score_topk(spark, sf_dir):
    """Additive relevance over parts: each facet that holds adds its weight; the best 25."""
    part = table(spark, sf_dir, "part")
    score = (
        F.when(F.lower("p_name").contains("small"), 3.0).otherwise(0.0)
        + F.when(F.col("p_brand") == "Brand#11", 1.0).otherwise(0.0)
        + F.when(F.col("p_size") >= 25, 0.5).otherwise(0.0)
    )
    return (
        part.select("p_partkey", "p_name", score.alias("score"))
        .where("score > 0")
        .orderBy(F.desc("score"), F.asc("p_name"), F.asc("p_partkey"))
        .limit(25)
    )



@named("""SELECT p_partkey, list_sum(list_transform(range(1, len(n) + 1), lambda i:
  ((CASE WHEN n[i] = 'bolt' THEN 1.0 WHEN contains(n[i], 'bolt') THEN 0.4 ELSE 0 END) + (CASE WHEN starts_with(n[i], 're') THEN 0.7 ELSE 0 END)
   + (CASE WHEN n[i] = 'hot' THEN 1.0 ELSE 0 END))::DOUBLE * 5.0 / i)) AS score FROM (SELECT p_partkey, string_split(p_name, ' ') AS n FROM part)""")
def position_decay_score(spark, d):
    p = table(spark, d, "part").withColumn("notes", F.split("p_name", " "))
    return p.select("p_partkey", position_decay(F.col("notes"), 'bolt | re* | "hot"').alias("score"))


_SCALE = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@named("""SELECT o_orderkey, CASE abs(CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '4-NOT SPECIFIED' THEN 3 WHEN '5-LOW' THEN 4 END - 1)
WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 WHEN 2 THEN 0.2 ELSE 0 END::DOUBLE AS closeness FROM orders""", "ordinal_closeness")
def ordinal_closeness_score(spark, d):
    return table(spark, d, "orders").select("o_orderkey", ordinal_closeness(F.col("o_orderpriority"), _SCALE, "2-HIGH").alias("closeness"))


_SIMILAR = """WITH t AS (SELECT * FROM part WHERE p_partkey = 7), c AS (
SELECT p.p_partkey, p.p_name, p.p_brand, (CASE WHEN split_part(p.p_name, ' ', 1) = split_part(t.p_name, ' ', 1) THEN 3.0 ELSE 0 END
 + CASE WHEN split_part(p.p_name, ' ', 2) = split_part(t.p_name, ' ', 2) THEN 3.0 ELSE 0 END + CASE WHEN p.p_type = t.p_type THEN 0.5 ELSE 0 END
 + CASE WHEN p.p_brand <> t.p_brand THEN 0.25 ELSE 0 END)::DOUBLE AS score FROM part p, t WHERE p.p_partkey <> t.p_partkey AND p.p_size > 1)
"""


def similar_parts(spark, d, key=7):
    """Item to item: facets of one part against all others, each with its own score."""
    p = table(spark, d, "part")
    word = lambda c, i: F.split_part(c, F.lit(" "), F.lit(i))
    # One row.
    t = F.broadcast(p.where(F.col("p_partkey") == key).limit(1).select(*[F.col(c).alias(f"t_{c}") for c in ("p_partkey", "p_name", "p_brand", "p_type")]))
    same = lambda a, w: F.when(a, w).otherwise(0.0)
    score = (
        same(word(F.col("p_name"), 1) == word(F.col("t_p_name"), 1), 3.0)
        + same(word(F.col("p_name"), 2) == word(F.col("t_p_name"), 2), 3.0)
        + same(F.col("p_type") == F.col("t_p_type"), 0.5)
        + same(F.col("p_brand") != F.col("t_p_brand"), 0.25)
    )
    others = p.join(t, F.col("p_partkey") != F.col("t_p_partkey")).where("p_size > 1")
    return others.select("p_partkey", "p_name", "p_brand", score.alias("score"))


_BY_SCORE = [F.desc, "score"], [F.asc, "p_name"], [F.asc, "p_partkey"]


def by_score():
    return [f(c) for f, c in _BY_SCORE]


@named(_SIMILAR + "SELECT *, row_number() OVER (ORDER BY score DESC, p_name, p_partkey) AS rk FROM c QUALIFY rk <= 10")
def recommend_similar(spark, d):
    return ranked(similar_parts(spark, d), by_score(), last=10)


@named(_SIMILAR + """, s AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, p_name, p_partkey) <= 2 THEN 0 ELSE 1 END AS st FROM c)
SELECT * EXCLUDE (st), row_number() OVER (ORDER BY st, score DESC, p_name, p_partkey) AS rk FROM s QUALIFY rk <= 30""")
def diversified_topk(spark, d):
    return diversified(similar_parts(spark, d), "p_brand", by_score(), 2, 30)


_TOK = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z]+'), lambda x: x <> '')"
_BM25 = """WITH t AS (SELECT @KEY AS k, @TOK AS t FROM @TABLE), st AS (SELECT count(*) AS n, avg(len(t)::DOUBLE) AS mean FROM t),
h AS (SELECT k, len(t) AS len, q, len(list_filter(t, lambda x: x = q)) AS tf FROM t, (VALUES @TERMS) v(q)),
f AS (SELECT q, count(*) AS df FROM h WHERE tf > 0 GROUP BY q),
s AS (SELECT k, sum(ln(1.0 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean)))) AS score
 FROM h JOIN f USING (q), st WHERE tf > 0 GROUP BY k)
""".replace("@TOK", _TOK)


def _bm25_sql(key, name, terms):
    return _BM25.replace("@KEY", key).replace("@TABLE", name).replace("@TERMS", ", ".join(f"('{t}')" for t in terms))


@named(_bm25_sql("doc_id", "documents", ["erha", "thble", "stti"]) + """SELECT k AS doc_id, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 6) DESC, k) AS rk FROM s QUALIFY rk <= 20""")
def bm25_topk(spark, d):
    """From stored postings: blocks of the terms' buckets, and of these what may be among the best."""
    docs = table(spark, d, "documents")
    scored = kept(docs, docs, "doc_id", ["text"], "documents").top(["erha", "thble", "stti"], 20).select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))
    return ranked(scored, [F.desc("score"), F.asc("doc_id")], last=20)


@named(_bm25_sql("doc_id", "documents", ["erha", "thble", "stti"]) + """SELECT k AS doc_id, round(score, 6) AS score FROM s""")
def bm25_scan(spark, d):
    """All scores by one scan of the texts, without an index."""
    return bm25(table(spark, d, "documents"), "doc_id", "text", ["erha", "thble", "stti"]).withColumn("score", F.round("score", 6))


_CHANGED = "(SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN concat(text, ' erha stti') ELSE text END AS text FROM documents WHERE doc_id % 7 <> 3)"


@named(_bm25_sql("doc_id", _CHANGED, ["erha", "thble", "stti"]) + """SELECT k AS doc_id, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 6) DESC, k) AS rk FROM s QUALIFY rk <= 20""")
def fts_refreshed_topk(spark, d):
    """An index over older texts, brought up to date by what has changed, come and gone."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    i = F.col("doc_id")
    now = docs.where(i % 7 != 3).withColumn("text", F.when(i % 5 == 0, F.concat("text", F.lit(" erha stti"))).otherwise(F.col("text")))
    index = Index(spark, new_folder(spark, "index-refreshed"), "doc_id", ["text"]).build(docs.where(i % 11 != 4))
    index.update(now.where((i % 5 == 0) | (i % 11 == 4)), docs.where(i % 7 == 3))
    scored = index.top(["erha", "thble", "stti"], 20).select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))
    return ranked(scored, [F.desc("score"), F.asc("doc_id")], last=20)


_FIELDS = ["p_name", "p_brand", "p_type", "nations", "regions", "suppliers", "flags", "priorities", "statuses", "segments"]
_CORPUS = """(SELECT p_partkey, concat_ws(' ', p_name, p_brand, p_type, nations, regions, suppliers, flags, priorities, statuses, segments) AS text FROM part LEFT JOIN (
SELECT l_partkey, string_agg(DISTINCT n_name, ' ') AS nations, string_agg(DISTINCT r_name, ' ') AS regions, string_agg(DISTINCT s_name, ' ') AS suppliers, string_agg(DISTINCT l_returnflag, ' ') AS flags,
 string_agg(DISTINCT o_orderpriority, ' ') AS priorities, string_agg(DISTINCT o_orderstatus, ' ') AS statuses, string_agg(DISTINCT c_mktsegment, ' ') AS segments
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
GROUP BY l_partkey) ON l_partkey = p_partkey)"""


@named(_bm25_sql("p_partkey", _CORPUS, ["gear", "urgent", "machinery", "small"]) + """SELECT k AS p_partkey, round(score, 5) AS score, row_number() OVER (ORDER BY round(score, 5) DESC, k) AS rk FROM s QUALIFY rk <= 25""")
def fts_ten_fields_topk(spark, d):
    """One document per part of ten fields: its own, and those of its lines' dimensions."""
    t = lambda n: table(spark, d, n)
    lines = (
        t("lineitem").join(t("supplier"), F.col("s_suppkey") == F.col("l_suppkey")).join(t("nation"), F.col("n_nationkey") == F.col("s_nationkey")).join(t("region"), F.col("r_regionkey") == F.col("n_regionkey"))
        .join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(t("customer"), F.col("c_custkey") == F.col("o_custkey"))
    )
    columns = ("n_name", "r_name", "s_name", "l_returnflag", "o_orderpriority", "o_orderstatus", "c_mktsegment")
    sets = lines.groupBy(F.col("l_partkey").alias("p_partkey")).agg(*[F.collect_set(c).alias(f) for c, f in zip(columns, _FIELDS[3:])])
    docs = t("part").join(sets, "p_partkey", "left").select("p_partkey", *_FIELDS)
    index = kept(t("lineitem"), docs, "p_partkey", _FIELDS, "parts")
    scored = index.top(["gear", "urgent", "machinery", "small"], 25, slack=1e-5).select(F.col("key").alias("p_partkey"), F.round("score", 5).alias("score"))
    return ranked(scored, [F.desc("score"), F.asc("p_partkey")], last=25)


_SEGMENTS = _bm25_sql("(conv_id, turn)", "conversations", ["erha", "thble"]) + """, r AS (
SELECT c.conv_id, c.turn, round(coalesce(s.score, 0) + CASE WHEN c.role = 'user' AND contains(lower(c.text), 'thble') THEN 10 ELSE 0 END
 + CASE WHEN contains(lower(c.text), 'stti') THEN 5 ELSE 0 END + CASE WHEN c.role = 'system' THEN 20 ELSE 0 END, 6) AS relevance
FROM conversations c LEFT JOIN s ON s.k = (c.conv_id, c.turn) WHERE s.score IS NOT NULL OR c.role = 'system')
"""


def segment_relevance(spark, d):
    """BM25 plus fixed boosts; a segment needs a text hit or an entity match."""
    turns = table(spark, d, "conversations")
    c = turns.withColumn("k", F.struct("conv_id", "turn"))
    scored = kept(turns, c, "k", ["text"], "conversations").scores(["erha", "thble"]).withColumnRenamed("key", "k")
    low = F.lower("text")
    boost = (
        F.when((F.col("role") == "user") & low.contains("thble"), 10).otherwise(0)
        + F.when(low.contains("stti"), 5).otherwise(0)
        + F.when(F.col("role") == "system", 20).otherwise(0)
    )
    rows = c.join(scored, "k", "left").where(F.col("score").isNotNull() | (F.col("role") == "system"))
    return rows.select("conv_id", "turn", F.round(F.coalesce("score", F.lit(0.0)) + boost, 6).alias("relevance"))


@named(_SEGMENTS + "SELECT * FROM r")
def hybrid_segment_rank(spark, d):
    return segment_relevance(spark, d)


@named(_SEGMENTS + "SELECT conv_id, round(sum(relevance), 4) AS total, count(*) AS hits, count(*) > 1 AS recommended FROM r GROUP BY conv_id")
def group_hits_by_parent(spark, d):
    grouped = segment_relevance(spark, d).groupBy("conv_id").agg(F.round(F.sum("relevance"), 4).alias("total"), F.count("*").alias("hits"))
    return grouped.withColumn("recommended", F.col("hits") > 1)


@named("""SELECT p_partkey, score FROM (SELECT p_partkey, (CASE WHEN starts_with(lower(p_name), 're') THEN 15.0 WHEN contains(lower(p_name), 're') THEN 10.0 ELSE 0 END
 + CASE WHEN starts_with(lower(p_type), 'me') THEN 12.0 WHEN contains(lower(p_type), 'me') THEN 8.0 ELSE 0 END
 + CASE WHEN len(list_filter(string_split(p_name, ' '), lambda x: contains(x, 'ring'))) > 0 THEN 5.0 ELSE 0 END)::DOUBLE AS score FROM part) WHERE score > 0""")
def weighted_keyword_search(spark, d):
    def field(c, term, w):
        return F.when(F.lower(c).startswith(term), w * 1.5).when(F.lower(c).contains(term), w).otherwise(0.0)

    element = F.when(F.exists(F.split("p_name", " "), lambda x: x.contains("ring")), 5.0).otherwise(0.0)
    score = field("p_name", "re", 10.0) + field("p_type", "me", 8.0) + element
    return table(spark, d, "part").select("p_partkey", score.alias("score")).where("score > 0")


@named("""WITH q AS (SELECT unnest(['small ring', 'ring', 'hot gear', 'gear']) AS g), n AS (SELECT DISTINCT p_name FROM part)
SELECT p_name, score, row_number() OVER (ORDER BY score DESC, p_name) AS rk FROM (
SELECT p_name, max(length(g)) AS score FROM n JOIN q ON contains(p_name, g) GROUP BY p_name) QUALIFY rk <= 20""")
def ngram_context_match(spark, d):
    """Names by the longest n-gram of a request that they contain."""
    request = "small ring or hot gear".split()
    stop = {"or", "and", "the"}
    grams = {" ".join(request[i : i + n]) for n in (2, 3, 4) for i in range(len(request) - n + 1)}
    grams = {g for g in grams if not stop & set(g.split())} | {w for w in request if len(w) >= 4 and w not in stop and w not in ("small",)}
    names = table(spark, d, "part").select("p_name").distinct()
    best = F.greatest(F.lit(0), *[F.when(F.col("p_name").contains(g), len(g)) for g in sorted(grams)])
    return ranked(names.withColumn("score", best).where("score > 0"), [F.desc("score"), F.asc("p_name")], last=20)


@named("""SELECT p_partkey, (CASE WHEN contains(p_name, 'bolt') THEN 1.5 ELSE 0 END + CASE WHEN contains(lower(p_type), 'bolt') OR contains(lower(p_type), 'promo') THEN 0.5 ELSE 0 END)::DOUBLE AS score FROM part""")
def name_description_boost(spark, d):
    about = F.lower("p_type")
    score = F.when(F.col("p_name").contains("bolt"), 1.5).otherwise(0.0) + F.when(about.contains("bolt") | about.contains("promo"), 0.5).otherwise(0.0)
    return table(spark, d, "part").select("p_partkey", score.alias("score"))


@named("SELECT conv_id, turn FROM conversations WHERE role = 'system' OR contains(lower(text), 'thble')")
def hard_gate_entity_or_text(spark, d):
    return table(spark, d, "conversations").where((F.col("role") == "system") | F.lower("text").contains("thble")).select("conv_id", "turn")


@named()
def daily_stable_shuffle(spark, d):
    """An order that is stable within a day and new on the next; rows only, the digest is Spark's."""
    p = table(spark, d, "part").select("p_partkey", F.xxhash64(F.concat_ws("|", "p_name", F.col("p_partkey").cast("string"), F.current_date().cast("string"))).alias("h"))
    return ranked(p, [F.asc("h"), F.asc("p_partkey")], last=50).drop("h")


@named("SELECT p_partkey, p_retailprice, row_number() OVER (ORDER BY p_retailprice DESC NULLS LAST, p_partkey) AS rk FROM part QUALIFY rk <= 40")
def top_n_tiebreak(spark, d):
    return ranked(table(spark, d, "part").select("p_partkey", "p_retailprice"), [F.desc_nulls_last("p_retailprice"), F.asc("p_partkey")], last=40)


@named("""SELECT p_partkey, row_number() OVER (ORDER BY p_name, p_partkey) AS rk, (SELECT count(*) FROM part) AS total, ceil((SELECT count(*) FROM part) / 25.0)::BIGINT AS pages FROM part QUALIFY rk BETWEEN 51 AND 75""")
def page_offset(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name")
    page = ranked(p, [F.asc("p_name"), F.asc("p_partkey")], first=51, last=75).drop("p_name")
    total = p.agg(F.count("*").alias("total"), F.ceil(F.count("*") / 25.0).cast("long").alias("pages"))
    return page.join(F.broadcast(total))


@named("SELECT n_name, list_position(['NATION_9', 'NATION_2', 'NATION_17'], n_name)::BIGINT AS rk FROM nation WHERE n_name IN ('NATION_9', 'NATION_2', 'NATION_17')")
def order_by_list_position(spark, d):
    wanted = F.array(*[F.lit(x) for x in ("NATION_9", "NATION_2", "NATION_17")])
    return table(spark, d, "nation").select("n_name", F.array_position(wanted, F.col("n_name")).alias("rk")).where("rk > 0")


@named("SELECT p_partkey, row_number() OVER (ORDER BY lower(CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END), p_partkey) AS rk FROM part")
def nocase_sort(spark, d):
    from shelfmark.operators.versions import surrogate_ids

    shown = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    p = table(spark, d, "part").select("p_partkey", F.lower(shown).alias("low"))
    return surrogate_ids(p, ["low", "p_partkey"], "rk").drop("low")


@named("""SELECT kind, label, n, row_number() OVER (ORDER BY n DESC, kind, label) AS rk FROM (
SELECT 'brand' AS kind, p_brand AS label, count(*) AS n FROM part GROUP BY 2 UNION ALL SELECT 'type', p_type, count(*) FROM part GROUP BY 2
UNION ALL SELECT 'name', p_name, count(*) FROM part GROUP BY 2) QUALIFY rk <= 15""")
def merge_ranked_lists(spark, d):
    p = table(spark, d, "part")
    lists = [p.groupBy(F.col(c).alias("label")).agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "label", "n") for k, c in (("brand", "p_brand"), ("type", "p_type"), ("name", "p_name"))]
    return ranked(lists[0].unionByName(lists[1]).unionByName(lists[2]), [F.desc("n"), F.asc("kind"), F.asc("label")], last=15)


@named("""SELECT s_suppkey, (row_number() OVER (ORDER BY md5('2024-01-01' || s_name), s_suppkey) - 1) % 4 AS part FROM supplier""")
def seeded_split(spark, d):
    """A seeded shuffle dealt round robin into four."""
    from shelfmark.operators.versions import surrogate_ids

    s = table(spark, d, "supplier").select("s_suppkey", F.md5(F.concat(F.lit("2024-01-01"), "s_name")).alias("h"))
    return surrogate_ids(s, ["h", "s_suppkey"], "n").select("s_suppkey", ((F.col("n") - 1) % 4).alias("part"))


@named("SELECT p_partkey, ((row_number() OVER (ORDER BY p_partkey) - 1) // 500)::BIGINT AS part FROM part")
def part_planner(spark, d):
    """Rows dealt in order into parts of a fixed capacity."""
    from shelfmark.operators.versions import surrogate_ids

    n = surrogate_ids(table(spark, d, "part").select("p_partkey"), ["p_partkey"], "n")
    return n.select("p_partkey", F.floor((F.col("n") - 1) / 500).alias("part"))


@named("""SELECT count(*) AS total, ceil(count(*) / 20.0)::BIGINT AS pages, round(avg(p_retailprice), 2) AS avg_price, trunc(avg(p_size))::INTEGER AS whole FROM part""")
def rounding_page_math(spark, d):
    return table(spark, d, "part").agg(
        F.count("*").alias("total"), F.ceil(F.count("*") / 20.0).cast("long").alias("pages"), F.round(F.avg("p_retailprice"), 2).alias("avg_price"), F.avg("p_size").cast("int").alias("whole")
    )
