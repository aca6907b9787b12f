"""Entity resolution over part names within brands."""
from pyspark.sql import functions as F

from shelfmark.functions.text import NOT_SURNAMES, bare_name, surnames
from shelfmark.operators import entity as E
from shelfmark.plans.registry import Plans
from shelfmark.sources.tables import table

PLANS = Plans()
named = PLANS.named

_LCS = "CASE WHEN length(@X) = 0 OR length(@Y) = 0 THEN 0 ELSE list_reduce(string_split(@X, ''), lambda line, ch: list_reduce(range(1, length(@Y) + 1), lambda acc, j: list_append(acc, CASE WHEN (@Y)[j] = ch THEN line[j] + 1 ELSE greatest(line[j + 1], acc[-1]) END), [0::BIGINT]), list_resize([0::BIGINT], length(@Y) + 1, 0))[-1] END"
#: Token-set ratio of all pairs of a block, by the table of the longest common subsequence.
_RATIO = """t AS (SELECT *, list_sort(list_distinct(list_filter(string_split(name, ' '), lambda x: x <> ''))) AS toks FROM n),
q AS (SELECT block, a.name AS a, b.name AS b, array_to_string(list_sort(list_intersect(a.toks, b.toks)), ' ') AS s, array_to_string(list_filter(a.toks, lambda x: NOT list_contains(b.toks, x)), ' ') AS l,
 array_to_string(list_filter(b.toks, lambda x: NOT list_contains(a.toks, x)), ' ') AS r FROM t a JOIN t b USING (block) WHERE a.name < b.name AND len(a.toks) > 0 AND len(b.toks) > 0),
k AS (SELECT *, length(trim(s || ' ' || l)) AS la, length(trim(s || ' ' || r)) AS lb, @LCS AS c FROM q),
y AS (SELECT block, a, b, CASE WHEN s <> '' AND (l = '' OR r = '') THEN 1.0::DOUBLE ELSE greatest(1 - (length(l) + length(r) - 2 * c)::DOUBLE / (la + lb),
 CASE WHEN s = '' THEN 0 ELSE greatest(2.0::DOUBLE * length(s) / (length(s) + la), 2.0::DOUBLE * length(s) / (length(s) + lb)) END) END AS sim FROM k)""".replace("@LCS", _LCS.replace("@X", "l").replace("@Y", "r"))
_NAMES = """WITH n AS (SELECT p_type AS block, p_name || CASE WHEN p_partkey % 3 = 0 THEN 's' ELSE '' END AS name, count(*) AS n FROM part GROUP BY ALL),
w AS (SELECT block, name, list_distinct(list_filter(regexp_extract_all(lower(name), '[a-z]{3,}'), lambda x: x NOT IN (@STOP))) AS words FROM n),
@RATIO,
x AS (SELECT y.*, len(list_intersect(u.words, v.words))::INTEGER AS shared, len(u.words) = 0 OR len(v.words) = 0 AS bare FROM y JOIN w u ON u.block = y.block AND u.name = a JOIN w v ON v.block = y.block AND v.name = b),
p AS (SELECT *, CASE WHEN shared >= 1 AND sim >= 0.9 THEN (sim + least(shared / 2.0, 1.0)) / 2 ELSE sim * 0.8 END AS confidence FROM x WHERE shared >= 1 AND sim >= 0.9 OR bare AND sim >= 0.99)
""".replace("@STOP", ", ".join(f"'{x}'" for x in NOT_SURNAMES)).replace("@RATIO", _RATIO)


def names(spark, d):
    shown = F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, "s").otherwise(""))
    return table(spark, d, "part").groupBy(F.col("p_type").alias("block"), shown.alias("name")).agg(F.count("*").alias("n"))


def merges(spark, d):
    """Pairs of a block that are close, with the decision to merge them."""
    pairs = E.token_set_pairs(names(spark, d).withColumn("key", F.col("name")), "block", "key", "name")
    a, b = surnames(F.col("name_a")), surnames(F.col("name_b"))
    bare = (F.size(a) == 0) | (F.size(b) == 0)
    return E.decide(pairs, F.col("ratio"), F.size(F.array_intersect(a, b)), bare)


@named(_NAMES + "SELECT block, a, b, round(confidence, 6)::DOUBLE AS confidence FROM p")
def pair_decisions(spark, d):
    return merges(spark, d).where("merge").select("block", "a", "b", F.round("confidence", 6).alias("confidence"))


_CLUSTERS = _NAMES.replace("WITH n AS", "WITH RECURSIVE n AS") + """, e AS (SELECT block, a AS u, b AS v FROM p UNION SELECT block, b, a FROM p),
r AS (SELECT block, name AS u, name AS v FROM n UNION SELECT r.block, r.u, e.v FROM r JOIN e ON e.block = r.block AND e.u = r.v),
c AS (SELECT block, u AS name, min(v) AS cluster FROM r GROUP BY ALL)
"""


def clusters(spark, d):
    """Every name with its cluster; names that merge with none are clusters of their own."""
    edges = merges(spark, d).where("merge").select(F.concat_ws("|", "block", "a").alias("a"), F.concat_ws("|", "block", "b").alias("b"))
    found = E.connected_components(edges, "a", "b")
    keyed = names(spark, d).withColumn("node", F.concat_ws("|", "block", "name"))
    joined = keyed.join(found, "node", "left")
    cluster = F.coalesce(F.substring_index("component", "|", -1), F.col("name"))
    return joined.select("block", "name", "n", cluster.alias("cluster"))


@named(_CLUSTERS + "SELECT block, name, cluster FROM c")
def connected_components(spark, d):
    return clusters(spark, d).drop("n")


@named(_CLUSTERS + "SELECT block || '|' || cluster AS cluster, arg_max(name, (n, length(name), name)) AS canonical, count(*) AS members, sum(n)::BIGINT AS total FROM c JOIN n USING (block, name) GROUP BY 1")
def canonical_of_cluster(spark, d):
    c = clusters(spark, d).withColumn("cluster", F.concat_ws("|", "block", "cluster"))
    return E.canonical(c, "cluster", "name", "n")


@named(_CLUSTERS + "SELECT block, cluster, count(*) AS members, CASE WHEN count(*) > 1 AND sum(n) < 60 THEN 'review' ELSE 'approved' END AS state FROM c JOIN n USING (block, name) GROUP BY ALL")
def confidence_split(spark, d):
    g = clusters(spark, d).groupBy("block", "cluster").agg(F.count("*").alias("members"), F.sum("n").alias("total"))
    state = F.when((F.col("members") > 1) & (F.col("total") < 60), "review").otherwise("approved")
    return g.select("block", "cluster", "members", state.alias("state"))


@named(_CLUSTERS + """, e2 AS (SELECT p.block, c.cluster, avg(p.confidence) AS confidence FROM p JOIN c ON c.block = p.block AND c.name = p.a GROUP BY ALL)
SELECT block, cluster, count(*) AS members, sum(n)::BIGINT AS total, coalesce(round(max(confidence), 6), 1.0)::DOUBLE AS confidence FROM c JOIN n USING (block, name) LEFT JOIN e2 USING (block, cluster) GROUP BY ALL""")
def cluster_summary(spark, d):
    """Members and rows of each cluster with the mean confidence of its merges; a name on
    its own has 1."""
    c = clusters(spark, d)
    edges = merges(spark, d).where("merge").select("block", F.col("a").alias("name"), "confidence").join(c.select("block", "name", "cluster"), ["block", "name"])
    mean = edges.groupBy("block", "cluster").agg(F.avg("confidence").alias("confidence"))
    g = c.groupBy("block", "cluster").agg(F.count("*").alias("members"), F.sum("n").alias("total"))
    return g.join(mean, ["block", "cluster"], "left").withColumn("confidence", F.coalesce(F.round("confidence", 6), F.lit(1.0)))


@named("""WITH x AS (SELECT *, lower(p_name) AS alias FROM part), k AS (SELECT alias, p_brand, count(*) AS n FROM x GROUP BY ALL), m AS (SELECT alias, p_brand AS producer FROM k QUALIFY row_number() OVER (PARTITION BY alias ORDER BY n DESC, p_brand) = 1)
SELECT alias, arg_max(p_name, (length(p_name), p_name)) AS display, count(DISTINCT p_partkey) AS beans, round(avg(p_size), 6) AS elevation, any_value(producer) AS producer FROM x JOIN m USING (alias) GROUP BY alias""")
def alias_group_profile(spark, d):
    g = table(spark, d, "part").groupBy(bare_name(F.col("p_name")).alias("alias"))
    return g.agg(F.max_by("p_name", F.struct(F.length("p_name"), "p_name")).alias("display"), F.count_distinct("p_partkey").alias("beans"), F.round(F.avg("p_size"), 6).alias("elevation"), F.mode("p_brand", True).alias("producer"))


@named("""WITH saved(name, cluster) AS (VALUES ('red bolt', 'bolts'), ('blue bolt', 'bolts'), ('gone', 'none')) SELECT coalesce(cluster, p_name) AS cluster, count(DISTINCT p_name) AS members, count(*) AS n FROM part LEFT JOIN saved ON name = p_name GROUP BY 1""")
def rehydrate_clusters(spark, d):
    saved = spark.createDataFrame([("red bolt", "bolts"), ("blue bolt", "bolts"), ("gone", "none")], "p_name string, cluster string")
    joined = table(spark, d, "part").join(saved, "p_name", "left")
    return joined.groupBy(F.coalesce("cluster", "p_name").alias("cluster")).agg(F.count_distinct("p_name").alias("members"), F.count("*").alias("n"))


@named("SELECT c_custkey, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_name END, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END, c_nationkey::VARCHAR) AS place FROM customer")
def first_present_field(spark, d):
    c = F.col("c_custkey")
    s = F.struct(F.when(c % 2 == 0, F.col("c_name")).alias("state"), F.when(c % 3 == 0, F.col("c_mktsegment")).alias("district"), F.col("c_nationkey").cast("string").alias("county"))
    return table(spark, d, "customer").withColumn("s", s).select("c_custkey", F.coalesce("s.state", "s.district", "s.county").alias("place"))


@named("""WITH r AS (SELECT p_brand AS region, lower(p_name) AS key, count(*) AS n, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey) AS members FROM part GROUP BY ALL) SELECT region, key, n, members FROM r WHERE n > 1""")
def representative_expand(spark, d):
    """One representative per normalised name, expanded again to its members."""
    r = table(spark, d, "part").groupBy(F.col("p_brand").alias("region"), F.lower("p_name").alias("key")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("p_partkey")).alias("m")).where("n > 1")
    return r.select("region", "key", "n", F.array_join(F.transform("m", lambda x: x.cast("string")), ",").alias("members"))


@named(f"""WITH n AS (SELECT DISTINCT p_type AS block, p_name || CASE WHEN p_partkey % 3 = 0 THEN 's' ELSE '' END AS name FROM part), {_RATIO}
SELECT block, a, b, round(sim, 6)::DOUBLE AS ratio FROM y WHERE sim >= 0.8 - 1e-12""")
def token_set_pairs(spark, d):
    """Names of a type that are alike as sets of words."""
    n = names(spark, d).withColumn("key", F.col("name"))
    return E.token_set_pairs(n, "block", "key", "name", 0.8).select("block", "a", "b", F.round("ratio", 6).alias("ratio"))


@named("""WITH n AS (SELECT n_nationkey % 2 AS block, n_name AS name FROM nation)
SELECT block, a.name AS a, b.name AS b FROM n a JOIN n b USING (block) WHERE a.name < b.name AND levenshtein(a.name, b.name) * 8 <= greatest(length(a.name), length(b.name))""")
def close_names(spark, d):
    """Names within an edit distance of an eighth of the longer."""
    n = table(spark, d, "nation").select((F.col("n_nationkey") % 2).alias("block"), F.col("n_name").alias("key"), F.col("n_name").alias("name"))
    return E.close_pairs(n, "block", "key", "name", 8).select("block", "a", "b")
