"""Queries over relations, hierarchies, events, ratings and places."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import activity, evaluation, joins, ranks, rules, tree
from .registry import query


@query("dim_star_join", "SELECT r_name, n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def dim_star_join(t):
    """Facts with their dimensions."""
    o = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return o.groupBy("r_name", "n_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("left_outer_fill", "SELECT d.doc_id, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def left_outer_fill(t):
    """Missing rows get a default."""
    return t("documents").select("doc_id").join(t("labels"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"))


@query("semi_anti", "SELECT count(*) FILTER (WHERE c_custkey IN (SELECT o_custkey FROM orders)) AS with_orders, count(*) FILTER (WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) AS without_orders FROM customer")
def semi_anti(t):
    """Rows that have a partner, and rows that have none."""
    kept, rest = rules.closed_list(t("customer"), t("orders").withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"])
    return kept.agg(F.count("*").alias("with_orders")).join(rest.agg(F.count("*").alias("without_orders")), how="cross")


@query("append_resume", "SELECT count(*) AS n FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber > 3)")
def append_resume(t):
    """What a resumed run still has to do."""
    done = t("lineitem").filter("l_linenumber > 3").select(F.col("l_orderkey").alias("o_orderkey"))
    return t("orders").join(done, "o_orderkey", "left_anti").agg(F.count("*").alias("n"))


@query("relational_division", "SELECT s FROM (SELECT l_suppkey AS s, count(DISTINCT p_brand) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) WHERE n = (SELECT count(DISTINCT p_brand) FROM part)")
def relational_division(t):
    """Suppliers that have sold every brand."""
    rows = t("lineitem").join(t("part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey").select(F.col("l_suppkey").alias("s"), "p_brand")
    return joins.division(rows, t("part"), "s", "p_brand")


@query("segment_range_join", "WITH seg AS (SELECT n_nationkey AS seg, n_nationkey * 600 AS lo, (n_nationkey + 1) * 600 - 1 AS hi FROM nation) SELECT seg, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN seg ON o_orderkey BETWEEN lo AND hi GROUP BY seg")
def segment_range_join(t):
    """Points in ranges, by buckets instead of a nested loop."""
    seg = t("nation").select(F.col("n_nationkey").alias("seg"), (F.col("n_nationkey") * 600).alias("lo"), ((F.col("n_nationkey") + 1) * 600 - 1).alias("hi"))
    hit = joins.range_join(t("orders"), seg, F.col("o_orderkey"), F.col("lo"), F.col("hi"), 600, [F.col("seg"), F.col("o_totalprice")])
    return hit.groupBy("seg").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("segments_lead", "SELECT o_custkey, o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS last FROM orders")
def segments_lead(t):
    """A segment ends before the next one starts."""
    return joins.segments(t("orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey", "last")


@query("as_of_join", "SELECT v.event_id, c.event_id AS click_id FROM (SELECT * FROM events WHERE event_type = 'view') v ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON v.user_id = c.user_id AND v.ts >= c.ts")
def as_of_join(t):
    """Each view with the user's last click before it."""
    e = t("events")
    clicks = e.filter("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("click_id"))
    return joins.as_of(e.filter("event_type = 'view'").select("user_id", "ts", "event_id"), clicks, ["user_id"], "ts", ["click_id"]).select("event_id", "click_id")


@query("neighbour_rows", "SELECT conv_id, turn, role, lag(role) OVER w AS role_before_1, lead(role) OVER w AS role_after_1 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def neighbour_rows(t):
    """The rows around each row of its group."""
    return joins.neighbours(t("conversations").select("conv_id", "turn", "role"), ["conv_id"], "turn", ["role"])


@query("range_expand", "SELECT c_custkey, unnest(range(0, CAST(c_custkey % 4 AS BIGINT) + 1)) AS step FROM customer")
def range_expand(t):
    """Intervals unfolded to rows."""
    return t("customer").select("c_custkey", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("c_custkey") % 4).cast("long"))).alias("step"))


@query("paired_differences", "SELECT a.doc_id AS a, b.doc_id AS b, a.quality - b.quality AS diff FROM labels a JOIN labels b ON b.doc_id = a.doc_id + 1")
def paired_differences(t):
    """Two runs on the same questions."""
    a = t("labels").select(F.col("doc_id").alias("a"), F.col("quality").alias("qa"))
    b = t("labels").select(F.col("doc_id").alias("b"), F.col("quality").alias("qb"))
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", (F.col("qa") - F.col("qb")).alias("diff"))


_TREE = "nodes AS (SELECT p_partkey AS id, CASE WHEN p_partkey > 1 THEN p_partkey // 3 END AS parent FROM part)"


@query("subtree_sizes", f"WITH RECURSIVE {_TREE}, up AS (SELECT id, id AS root, 0 AS depth FROM nodes UNION ALL SELECT up.id, n.parent, up.depth + 1 FROM up JOIN nodes n ON n.id = up.root WHERE n.parent IS NOT NULL AND n.parent > 0) SELECT root AS id, count(*) AS size, CAST(max(depth) AS INT) AS height FROM up GROUP BY root")
def subtree_sizes(t):
    """Sizes and heights of all subtrees."""
    nodes = t("part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") > 1, F.floor(F.col("p_partkey") / 3)).alias("parent"))
    found = tree.subtrees(nodes.withColumn("parent", F.when(F.col("parent") > 0, F.col("parent"))))
    return found.select("id", "size", F.col("height").cast("int").alias("height"))


@query("ancestor_path", f"WITH RECURSIVE {_TREE}, up AS (SELECT id, id AS at, CAST(id AS VARCHAR) AS path FROM nodes UNION ALL SELECT up.id, n.parent, CAST(n.parent AS VARCHAR) || '/' || up.path FROM up JOIN nodes n ON n.id = up.at WHERE n.parent IS NOT NULL AND n.parent > 0) SELECT id, max_by(path, length(path)) AS path FROM up GROUP BY id")
def ancestor_path(t):
    """The path from the root."""
    nodes = t("part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") > 3, F.floor(F.col("p_partkey") / 3)).when(F.col("p_partkey").isin(3), F.lit(1)).alias("parent"))
    return tree.paths(nodes)


@query("prefix_sums", "SELECT p_brand, n, CAST(coalesce(sum(n) OVER (ORDER BY p_brand ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY 1)")
def prefix_sums(t):
    """Where each group starts."""
    n = t("part").groupBy("p_brand").agg(F.count("*").alias("n"))
    return n.withColumn("first", F.coalesce(F.sum("n").over(Window.orderBy("p_brand").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


@query("streaks", "WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events), i AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INT) AS island FROM d) SELECT user_id, max(n) AS longest, count(*) AS runs FROM (SELECT user_id, island, count(*) AS n FROM i GROUP BY ALL) GROUP BY user_id")
def streaks(t):
    """Runs of active days."""
    runs = activity.islands(activity.daily(t("events")), ["user_id"], F.col("day"))
    return runs.groupBy("user_id").agg(F.max("length").alias("longest"), F.count("*").alias("runs"))


@query("current_streak", "WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events), i AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INT) AS island FROM d WHERE day <= DATE '2024-01-20'), r AS (SELECT user_id, count(*) AS n, max(day) AS last FROM i GROUP BY user_id, island) SELECT user_id, coalesce(max(CASE WHEN last >= DATE '2024-01-19' THEN n END), 0) AS streak FROM r GROUP BY user_id")
def current_streak(t):
    """The streak alive on a day, or from the day before."""
    return activity.streak(activity.daily(t("events")), ["user_id"], F.to_date(F.lit("2024-01-20")))


@query("rolling7", "WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, day, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY day RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW) AS BIGINT) AS week FROM d")
def rolling7(t):
    """Sums over the last seven days."""
    d = activity.daily(t("events"))
    return d.select("user_id", "day", activity.rolling(d, ["user_id"], "n", 7).alias("week"))


@query("engagement28", "WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (WHERE event_type = 'purchase') AS p FROM events WHERE ts >= TIMESTAMP '2024-01-03' GROUP BY ALL), s AS (SELECT user_id, count(*) * 2 + sum(n) / 10.0 + 10 * sum(p) AS points FROM d GROUP BY user_id) SELECT user_id, round(CAST(points AS DOUBLE), 4) AS points, CASE WHEN points >= 90 THEN 'high' WHEN points >= 30 THEN 'mid' ELSE 'low' END AS level FROM s")
def engagement28(t):
    """Points of the last 28 days and their level."""
    e = t("events").filter("ts >= timestamp'2024-01-03'")
    d = e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "purchase").alias("p"))
    s = d.groupBy("user_id").agg((F.count("*") * 2 + F.sum("n") / 10.0 + 10 * F.sum("p")).alias("points"))
    return s.select("user_id", F.round("points", 4).alias("points"), rules.first_match([(F.col("points") >= 90, "high"), (F.col("points") >= 30, "mid")], "low").alias("level"))


@query("monthly_rollover", "SELECT user_id, date_trunc('month', CAST(ts AS DATE))::DATE AS month, count(*) AS n, count(DISTINCT CAST(ts AS DATE)) AS days FROM events GROUP BY ALL")
def monthly_rollover(t):
    """Counters that start anew each month."""
    return t("events").groupBy("user_id", F.trunc(F.to_date("ts"), "month").alias("month")).agg(F.count("*").alias("n"), F.count_distinct(F.to_date("ts")).alias("days"))


@query("sessions", "WITH e AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w > 86400000000 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM e) SELECT user_id, session, min(event_id) AS first_event, count(*) AS n FROM s GROUP BY user_id, session")
def sessions(t):
    """Events less than a gap apart."""
    s = activity.sessions(t("events"), ["user_id"], "ts", "event_id", 86400)
    return s.select("user_id", "session", "first_event", "n")


@query("daily_ceiling", "SELECT user_id, CAST(ts AS DATE) AS day, count(*) FILTER (WHERE n > 2) AS rejected FROM (SELECT *, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS n FROM events) GROUP BY ALL")
def daily_ceiling(t):
    """U4: calls beyond a daily ceiling."""
    n = F.row_number().over(Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id"))
    return t("events").withColumn("n", n).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count_if(F.col("n") > 2).alias("rejected"))


@query("plan_portions", "WITH c AS (SELECT l_orderkey, l_linenumber, l_quantity, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS UNBOUNDED PRECEDING) AS upto FROM lineitem) SELECT l_orderkey, l_linenumber, CAST(floor(greatest(0.0, upto - l_quantity / 2) / 60.0) AS BIGINT) AS portion FROM c")
def plan_portions(t):
    """Units cut into portions by the running sum of their weights."""
    return t("lineitem").select("l_orderkey", "l_linenumber", activity.portions(t("lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], "l_quantity", 60.0).alias("portion"))


@query("even_split", "SELECT p_partkey, ntile(4) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS slot FROM part")
def even_split(t):
    """Even slots, the remainder first."""
    return ranks.slots(t("part").select("p_brand", "p_partkey"), ["p_brand"], ["p_partkey"], 4).select("p_partkey", "slot")


@query("first_seen", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def first_seen(t):
    """First of each key, in order."""
    return rules.first_seen(t("events"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id")


@query("pivot_votes", "SELECT o_orderpriority AS route, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
def pivot_votes(t):
    """Conditional counts by group."""
    n = lambda s: F.count_if(F.col("o_orderstatus") == s)
    return t("orders").groupBy(F.col("o_orderpriority").alias("route")).agg(n("F").alias("f"), n("O").alias("o"), n("P").alias("p"))


@query("weighted_cost", "SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS cost, round(avg(l_quantity), 4) AS mean, count(*) AS n FROM lineitem GROUP BY ALL")
def weighted_cost(t):
    """A2: weighted sums and means."""
    return t("lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))), 2).alias("cost"), F.round(F.avg("l_quantity"), 4).alias("mean"), F.count("*").alias("n"))


@query("systematic_sample", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS n FROM orders) WHERE n % 7 = 0")
def systematic_sample(t):
    """K8: every seventh row of each group; sampling is the feature."""
    return ranks.before(t("orders").select("o_orderpriority", "o_orderkey"), ["o_orderpriority"], ["o_orderkey"]).filter("before % 7 = 0").select("o_orderkey")


@query("floor_percentile", "SELECT event_type, value AS p95 FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE i = floor(0.95 * n) + 1")
def floor_percentile(t):
    """K7: the element at floor(p n)."""
    return evaluation.floor_percentile(t("events"), ["event_type"], "value", 0.95)


@query("priority_pick", "SELECT c_nationkey, c_mktsegment, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 999 END, c_custkey) AS n FROM customer) WHERE n = 1")
def priority_pick(t):
    """K5: best by a list of priorities."""
    at = F.array_position(F.array(F.lit("BUILDING"), F.lit("MACHINERY")), F.col("c_mktsegment"))
    return rules.first_seen(t("customer"), ["c_nationkey"], [F.when(at > 0, at).otherwise(999), F.col("c_custkey")]).select("c_nationkey", "c_mktsegment", "c_custkey")


@query("set_operations", "SELECT 'both' AS kind, count(*) AS n FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'customer only', count(*) FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier)")
def set_operations(t):
    """Intersection and difference."""
    c, s = t("customer").select("c_nationkey"), t("supplier").select("s_nationkey")
    one = lambda df, kind: df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
    return one(c.intersect(s), "both").union(one(c.subtract(s), "customer only"))


@query("coverage_share", "SELECT n_nationkey, round(count(o_custkey) / count(*), 6) AS share FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN (SELECT DISTINCT o_custkey FROM orders) ON o_custkey = c_custkey GROUP BY 1")
def coverage_share(t):
    """Share of each group that is covered."""
    done = t("orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("done", F.lit(1))
    x = t("nation").join(t("customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(done, "c_custkey", "left")
    return x.groupBy("n_nationkey").agg(F.round(F.count("done") / F.count("*"), 6).alias("share"))


_RUN = "run AS (SELECT o_custkey AS q, o_orderkey AS d, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders), qrel AS (SELECT o_custkey AS q, o_orderkey AS d FROM orders WHERE o_orderkey % 3 = 0)"


def _run(t):
    o = t("orders").select(F.col("o_custkey").alias("q"), F.col("o_orderkey").alias("d"), "o_totalprice")
    return o.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("o_totalprice"), "d"))), o.filter("d % 3 = 0").select("q", "d")


@query("rank_metrics", f"WITH {_RUN}, h AS (SELECT r.q, r.rank, row_number() OVER (PARTITION BY r.q ORDER BY r.rank) / r.rank AS p FROM run r JOIN qrel USING (q, d) WHERE r.rank <= 10), a AS (SELECT q, count(*) AS n, min(rank) AS f, sum(p) AS s FROM h GROUP BY q), t AS (SELECT q, count(*) AS total FROM qrel GROUP BY q) SELECT t.q, CAST(coalesce(n, 0) > 0 AS INT) AS hit, round(coalesce(n, 0) / total, 6) AS recall, round(coalesce(1 / f, 0.0), 6) AS reciprocal_rank, round(coalesce(s / total, 0.0), 6) AS average_precision FROM t LEFT JOIN a USING (q)")
def rank_metrics(t):
    """Hit, recall, reciprocal rank and average precision at ten."""
    run, judged = _run(t)
    return evaluation.rank_metrics(run, judged, "q", "d")


@query("ndcg5", f"WITH {_RUN}, g AS (SELECT *, d % 3 AS grade FROM run WHERE rank <= 5), i AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY grade DESC, rank) AS ideal FROM g), s AS (SELECT q, sum((pow(2.0, grade) - 1) / log2(rank + 1)) AS got, sum((pow(2.0, grade) - 1) / log2(ideal + 1)) AS best, avg(CASE WHEN grade > 0 THEN 1.0 ELSE 0.0 END) AS p FROM i GROUP BY q) SELECT q, round(CASE WHEN best > 0 THEN got / best ELSE 0.0 END, 6) AS ndcg, round(p, 6) AS precision FROM s")
def ndcg5(t):
    """M3: graded gain of the first five."""
    run, _ = _run(t)
    return evaluation.ndcg(run.withColumn("grade", F.col("d") % 3), "q", "grade", "rank")


@query("wilson", "WITH s AS (SELECT l_shipdate::DATE AS day, count(*) FILTER (WHERE l_returnflag = 'R') AS good, count(*) AS n FROM lineitem GROUP BY 1), p AS (SELECT *, good / n AS p, 1.959964::DOUBLE AS z FROM s) SELECT day, round((p + z*z/(2*n)) / (1 + z*z/n) - sqrt(p*(1-p)/n + z*z/(4*n*n)) * z / (1 + z*z/n), 6) AS low, round((p + z*z/(2*n)) / (1 + z*z/n) + sqrt(p*(1-p)/n + z*z/(4*n*n)) * z / (1 + z*z/n), 6) AS high FROM p")
def wilson(t):
    """M6: interval of a share."""
    s = t("lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.count_if(F.col("l_returnflag") == "R").alias("good"), F.count("*").alias("n"))
    low, high = evaluation.wilson(F.col("good"), F.col("n"))
    return s.select("day", low.alias("low"), high.alias("high"))


@query("kappa", "WITH n AS (SELECT count(*) AS n, avg(CASE WHEN quality = 1 - toxic THEN 1.0 ELSE 0.0 END) AS po FROM labels), a AS (SELECT quality AS x, count(*) AS a FROM labels GROUP BY 1), b AS (SELECT 1 - toxic AS x, count(*) AS b FROM labels GROUP BY 1), e AS (SELECT sum(a * b) / (SELECT n * n FROM n) AS pe FROM a JOIN b USING (x)) SELECT n, round(po, 6) AS agreement, round(CASE WHEN pe = 1 THEN 1.0 ELSE (po - pe) / (1 - pe) END, 6) AS kappa FROM n, e")
def kappa(t):
    """M7: agreement of two raters beyond chance."""
    return evaluation.kappa(t("labels").select("quality", (1 - F.col("toxic")).alias("other")), "quality", "other")


_EDGES = " + ".join(f"CASE WHEN u >= {e} THEN 1 ELSE 0 END" for e in evaluation.POISSON)


@query("bootstrap_ci", f"WITH v AS (SELECT doc_id, quality, unnest(range(1, 201)) AS round FROM labels), u AS (SELECT *, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':' || CAST((round - 1) // 4 AS VARCHAR)), CAST((round - 1) % 4 * 8 + 1 AS INT), 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM v), w AS (SELECT *, {_EDGES} AS w FROM u) SELECT CAST(round AS INT) AS round, round(sum(w * quality) / sum(w), 6) AS mean FROM w GROUP BY round")
def bootstrap_ci(t):
    """Means of resamples, drawn by a digest."""
    return evaluation.bootstrap(t("labels"), "doc_id", "quality")


_AT = "(SELECT {k} AS id, ({k} * 37 % 140) - 70.0::DOUBLE AS lat, ({k} * 91 % 360) - 180.0::DOUBLE AS lon FROM {t})"
_HAV = "2 * 6371.0088::DOUBLE * asin(least(1.0, sqrt(pow(sin(radians(s.lat - c.lat) / 2), 2) + cos(radians(c.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - c.lon) / 2), 2))))"


@query("nearest_place", f"WITH c AS {_AT.format(k='c_custkey', t='customer')}, s AS {_AT.format(k='n_nationkey', t='nation')}, d AS (SELECT c.id, s.id AS place, round({_HAV}, 4) AS km FROM c CROSS JOIN s) SELECT id, place, km FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY km, place) AS n FROM d) WHERE n = 1")
def nearest_place(t):
    """The nearest of a fixed list of places (a nation table has 25 rows, which are broadcast)."""
    at = lambda df, k, p: df.select(F.col(k).alias(f"{p}id"), ((F.col(k) * 37 % 140) - 70.0).alias(f"{p}lat"), ((F.col(k) * 91 % 360) - 180.0).alias(f"{p}lon"))
    places = at(t("nation"), "n_nationkey", "p")
    listed = F.broadcast(places.agg(F.collect_list(F.struct("pid", "plat", "plon")).alias("places")))
    c = at(t("customer"), "c_custkey", "").join(listed, how="cross")
    near = F.array_min(F.transform("places", lambda p: F.struct(F.round(geo.haversine(F.col("lat"), F.col("lon"), p.plat, p.plon), 4).alias("km"), p.pid.alias("place"))))
    return c.withColumn("near", near).select("id", "near.place", "near.km")


@query("bearing", f"WITH c AS {_AT.format(k='c_custkey', t='customer')} SELECT id, round((degrees(atan2(sin(radians(10.0 - lon)) * cos(radians(50.0)), cos(radians(lat)) * sin(radians(50.0)) - sin(radians(lat)) * cos(radians(50.0)) * cos(radians(10.0 - lon)))) + 720) % 360, 4) AS bearing FROM c")
def bearing(t):
    """Initial bearing to a place."""
    k = F.col("c_custkey")
    return t("customer").select(k.alias("id"), F.round(geo.bearing((k * 37 % 140) - 70.0, (k * 91 % 360) - 180.0, F.lit(50.0), F.lit(10.0)), 4).alias("bearing"))


@query("lunar_dates", "WITH n AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 2440588 - 1948440 AS n FROM orders), c AS (SELECT *, n // 10631 AS cycle, n % 10631 AS rest FROM n), y AS (SELECT *, CAST(floor((rest + 0.1335::DOUBLE) / (10631.0::DOUBLE / 30)) AS BIGINT) AS y0 FROM c), z AS (SELECT *, y0 + CASE WHEN rest - (11 * y0 + 3) // 30 - 354 * y0 < 0 THEN -1 ELSE 0 END AS y FROM y), d AS (SELECT *, rest - (11 * y + 3) // 30 - 354 * y AS i FROM z), m AS (SELECT *, CAST(least(11, floor((i + 0.99::DOUBLE) / 29.5::DOUBLE)) AS BIGINT) AS m FROM d) SELECT day, cycle * 30 + y + 1 AS year, m + 1 AS month, CAST(i - floor(29.5::DOUBLE * m + 0.5) + 1 AS BIGINT) AS day_of_month FROM m")
def lunar_dates(t):
    """A tabular lunar calendar."""
    year, month, day = geo.lunar(F.col("day"))
    return t("orders").select(F.to_date("o_orderdate").alias("day")).distinct().select("day", year.alias("year"), month.alias("month"), day.alias("day_of_month"))


@query("reminders", "SELECT c_custkey, unnest(range(0, 31, CAST(c_custkey % 5 + 3 AS BIGINT))) AS day_no FROM customer")
def reminders(t):
    """Schedules unfolded over a span of days."""
    return t("customer").select("c_custkey", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(30).cast("long"), (F.col("c_custkey") % 5 + 3).cast("long"))).alias("day_no"))


@query("check_failures", "SELECT o_orderkey, list_filter([CASE WHEN NOT (o_totalprice > 1000) THEN 'price' END, CASE WHEN NOT (o_orderstatus IN ('F', 'O')) THEN 'status' END], lambda x: x IS NOT NULL) AS failed FROM orders")
def check_failures(t):
    """The checks that a row fails."""
    return t("orders").select("o_orderkey", rules.failures([(F.col("o_totalprice") > 1000, "price"), (F.col("o_orderstatus").isin("F", "O"), "status")]).alias("failed"))


@query("caps_per_group", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 3")
def caps_per_group(t):
    """K6: at most so many of each group."""
    return rules.capped(t("orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey")


@query("stream_daily", "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_daily(t):
    """Extension: daily counts by Structured Streaming over the events, run until all input is read."""
    from ..streaming.events import daily_counts

    return daily_counts(t("events"))
