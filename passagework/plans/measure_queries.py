"""Queries of evaluation, activity, plans, places and hierarchies that build on whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import activity, evaluation, rules, tree
from .registry import query

_EDGES = " + ".join(f"CASE WHEN u >= {e} THEN 1 ELSE 0 END" for e in evaluation.POISSON)


def _boot(value: str, rows: str) -> str:
    return f"""WITH l AS ({rows}), v AS (SELECT doc_id, {value} AS x, unnest(range(1, 2001)) AS round FROM l), u AS (SELECT *, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':' || CAST((round - 1) // 4 AS VARCHAR)), CAST((round - 1) % 4 * 8 + 1 AS INT), 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM v),
w AS (SELECT *, {_EDGES} AS w FROM u), m AS (SELECT round, round(sum(w * x) / sum(w), 6) AS mean FROM w GROUP BY round), s AS (SELECT mean, row_number() OVER (ORDER BY mean, round) - 1 AS i FROM m)
SELECT round((SELECT avg({value}) FROM l), 6) AS mean, max(CASE WHEN i = 50 THEN mean END) AS low, max(CASE WHEN i = 1950 THEN mean END) AS high, avg(CASE WHEN mean <= 0 THEN 1.0 ELSE 0.0 END) AS not_above FROM s"""


@query("bootstrap_interval", _boot("quality", "SELECT doc_id, quality FROM labels"))
def bootstrap_interval(t):
    """M4: mean and the elements 50 and 1950 of 2,000 sorted resample means."""
    return evaluation.interval(t("labels"), "doc_id", "quality")


@query("paired_bootstrap", _boot("d", "SELECT doc_id, quality - (1 - toxic) AS d FROM labels"))
def paired_bootstrap(t):
    """Interval of the difference of two runs on the same questions."""
    return evaluation.interval(t("labels").select("doc_id", (F.col("quality") - (1 - F.col("toxic"))).alias("d")), "doc_id", "d")


@query("no_answer_metrics", "WITH run AS (SELECT o_custkey AS q, CASE WHEN o_orderkey % 5 = 0 THEN -1 ELSE o_orderkey END AS d, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders), rel AS (SELECT o_custkey AS q, o_orderkey AS d FROM orders WHERE o_orderkey % 3 = 0 AND o_custkey % 4 <> 0), h AS (SELECT r.q, rank, row_number() OVER (PARTITION BY r.q ORDER BY rank) / rank AS p FROM run r JOIN rel USING (q, d) WHERE rank <= 10), s AS (SELECT q, sum(p) AS p, min(rank) AS f FROM h GROUP BY q), n AS (SELECT q, count(*) AS n, max(CASE WHEN d = -1 AND rank = 1 THEN 1 ELSE 0 END) AS abstains FROM run GROUP BY q), a AS (SELECT q, count(*) AS total FROM rel GROUP BY q) SELECT n.q, round(CASE WHEN total IS NULL THEN CASE WHEN n = 1 AND abstains = 1 THEN 1.0 ELSE 0.0 END ELSE coalesce(p, 0.0) / total END, 6) AS ap, round(CASE WHEN total IS NULL THEN CASE WHEN n = 1 AND abstains = 1 THEN 1.0 ELSE 0.0 END ELSE coalesce(1.0 / f, 0.0) END, 6) AS rr FROM n LEFT JOIN s ON s.q = n.q LEFT JOIN a ON a.q = n.q")
def no_answer_metrics(t):
    """M2: average precision and reciprocal rank; a question without an answer scores 1 only for a single row -1."""
    o = t("orders").select(F.col("o_custkey").alias("q"), "o_orderkey", "o_totalprice")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    run = o.select("q", F.when(F.col("o_orderkey") % 5 == 0, -1).otherwise(F.col("o_orderkey")).alias("d"), rank.alias("rank"))
    judged = o.filter("o_orderkey % 3 = 0 and q % 4 <> 0").select("q", F.col("o_orderkey").alias("d"))
    return evaluation.with_abstention(run, judged, "q", "d", -1)


@query("usability_score", "WITH i AS (SELECT o_custkey, o_orderkey, unnest(range(1, 11)) AS item FROM orders), v AS (SELECT o_custkey, o_orderkey, item, (o_orderkey * 7 + item * 3) % 5 + 1 AS v FROM i) SELECT o_custkey, round(avg(s), 4) AS sus, count(*) AS n FROM (SELECT o_custkey, o_orderkey, 2.5::DOUBLE * CAST(sum(CASE WHEN item % 2 = 1 THEN v - 1 ELSE 5 - v END) AS BIGINT) AS s FROM v GROUP BY ALL) GROUP BY o_custkey")
def usability_score(t):
    """M8: the usability score of ten items: odd ones v - 1, even ones 5 - v, times 2.5."""
    v = lambda i: (F.col("o_orderkey") * 7 + i * 3) % 5 + 1
    one = lambda i: F.when(i % 2 == 1, v(i) - 1).otherwise(5 - v(i))
    s = 2.5 * F.aggregate(F.sequence(F.lit(1), F.lit(10)), F.lit(0).cast("long"), lambda acc, i: acc + one(i))
    return t("orders").select("o_custkey", s.alias("s")).groupBy("o_custkey").agg(F.round(F.avg("s"), 4).alias("sus"), F.count("*").alias("n"))


@query("run_stability", "WITH r AS (SELECT c_custkey AS q, unnest([0, 1, 2]) AS run FROM customer), l AS (SELECT q, run, [q % 5, (q + CASE WHEN q % 9 = 0 THEN run ELSE 0 END) % 7, q % 3] AS ids FROM r) SELECT count(*) FILTER (WHERE n = 1) AS stable, count(*) AS questions FROM (SELECT q, count(DISTINCT ids) AS n FROM l GROUP BY q)")
def run_stability(t):
    """M9: questions whose lists are identical in three runs."""
    q = F.col("c_custkey")
    l = t("customer").select(q.alias("q"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("run")).select("q", F.array(F.col("q") % 5, (F.col("q") + F.when(F.col("q") % 9 == 0, F.col("run")).otherwise(0)) % 7, F.col("q") % 3).alias("ids"))
    return l.groupBy("q").agg(F.count_distinct(F.sha2(F.to_json("ids"), 256)).alias("n")).agg(F.count_if(F.col("n") == 1).alias("stable"), F.count("*").alias("questions"))


@query("expectation_checks", "WITH e AS (SELECT p_partkey, list_filter([CASE WHEN NOT (p_size > 5) THEN 'size' END, CASE WHEN NOT regexp_matches(p_name, 'red|blue|small|large') THEN 'name' END, CASE WHEN NOT (p_brand IN ('Brand#2', 'Brand#4', 'Brand#17')) THEN 'brand' END], lambda x: x IS NOT NULL) AS failed, p_brand IN ('Brand#2', 'Brand#4') OR regexp_matches(p_name, 'bolt') AS relevant FROM part) SELECT p_partkey, failed, len(failed) = 0 AS passed, relevant FROM e")
def expectation_checks(t):
    """The expectations that a row fails; relevant if it is listed or matches a pattern."""
    failed = rules.failures([(F.col("p_size") > 5, "size"), (F.col("p_name").rlike("red|blue|small|large"), "name"), (F.col("p_brand").isin("Brand#2", "Brand#4", "Brand#17"), "brand")])
    return t("part").select("p_partkey", failed.alias("failed"), (F.size(failed) == 0).alias("passed"), (F.col("p_brand").isin("Brand#2", "Brand#4") | F.col("p_name").rlike("bolt")).alias("relevant"))


_SEED = "CAST('0x' || substr(md5('fix:' || doc_id), 1, 6) AS BIGINT)"


@query("quote_fixtures", f"WITH w AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' '), lambda x: x <> '') AS ws, {_SEED} AS seed FROM documents), s AS (SELECT doc_id, ws, seed % (len(ws) - 6) AS k0, seed % 3 AS kind FROM w WHERE len(ws) >= 8) SELECT doc_id, CASE kind WHEN 0 THEN 'exact' WHEN 1 THEN 'misquote' ELSE 'merged' END AS kind, array_to_string(CASE kind WHEN 0 THEN ws[k0 + 1:k0 + 6] WHEN 1 THEN list_concat(ws[k0 + 1:k0 + 3], list_concat(['changed'], ws[k0 + 5:k0 + 6])) ELSE list_concat(ws[1:3], ws[len(ws) - 2:len(ws)]) END, ' ') AS quote FROM s")
def quote_fixtures(t):
    """Quotations made from texts by a digest of their key: exact, with one word changed, or two parts joined."""
    ws = F.filter(F.split(F.regexp_replace("text", "\\s+", " "), " "), lambda x: x != "")
    seed = F.conv(F.substring(F.md5(F.concat(F.lit("fix:"), F.col("doc_id").cast("string")).cast("binary")), 1, 6), 16, 10).cast("long")
    s = t("documents").select("doc_id", ws.alias("ws"), seed.alias("seed")).filter(F.size("ws") >= 8)
    at = (F.col("seed") % (F.size("ws") - 6)).cast("int")
    exact, part = F.slice("ws", at + 1, 6), lambda a, n: F.slice("ws", a, n)
    miss = F.concat(part(at + 1, 3), F.array(F.lit("changed")), part(at + 5, 2))
    merged = F.concat(part(F.lit(1), 3), part(F.size("ws") - 2, 3))
    kind = F.col("seed") % 3
    return s.select("doc_id", F.when(kind == 0, "exact").when(kind == 1, "misquote").otherwise("merged").alias("kind"), F.array_join(F.when(kind == 0, exact).when(kind == 1, miss).otherwise(merged), " ").alias("quote"))


@query("blinded_pairs", "SELECT o_orderkey, CASE WHEN CAST('0x' || substr(md5('blind:' || o_orderkey), 1, 4) AS INT) % 2 = 0 THEN 'A' ELSE 'B' END AS side FROM orders")
def blinded_pairs(t):
    """Sides dealt by a seeded digest."""
    odd = F.conv(F.substring(F.md5(F.concat(F.lit("blind:"), F.col("o_orderkey").cast("string")).cast("binary")), 1, 4), 16, 10).cast("long") % 2
    return t("orders").select("o_orderkey", F.when(odd == 0, "A").otherwise("B").alias("side"))


@query("unblinded_ratings", "WITH k AS (SELECT o_orderkey AS row, CASE WHEN CAST('0x' || substr(md5('blind:' || o_orderkey), 1, 4) AS INT) % 2 = 0 THEN 'A' ELSE 'B' END AS ours FROM orders), r AS (SELECT o_orderkey AS row, o_orderkey % 5 AS a, o_orderkey % 7 % 5 AS b FROM orders) SELECT ours, count(*) AS n, round(avg(CASE ours WHEN 'A' THEN a ELSE b END), 6) AS mine, round(avg(CASE ours WHEN 'A' THEN b ELSE a END), 6) AS other, count(*) FILTER (WHERE CASE ours WHEN 'A' THEN a > b ELSE b > a END) AS better FROM k JOIN r USING (row) GROUP BY ours")
def unblinded_ratings(t):
    """A rating sheet with its key, the sides turned back to systems."""
    k = blinded_pairs(t).withColumnRenamed("side", "ours")
    r = t("orders").select("o_orderkey", (F.col("o_orderkey") % 5).alias("a"), (F.col("o_orderkey") % 7 % 5).alias("b"))
    mine, other = F.when(F.col("ours") == "A", F.col("a")).otherwise(F.col("b")), F.when(F.col("ours") == "A", F.col("b")).otherwise(F.col("a"))
    return k.join(r, "o_orderkey").groupBy("ours").agg(F.count("*").alias("n"), F.round(F.avg(mine), 6).alias("mine"), F.round(F.avg(other), 6).alias("other"), F.count_if(mine > other).alias("better"))


@query("micro_macro", "WITH s AS (SELECT l_orderkey AS q, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS hit, sum(l_quantity * 3 + l_tax * 5) / 1e6 AS cost FROM lineitem GROUP BY 1) SELECT round(sum(hit) / sum(n), 6) AS micro, round(avg(hit / n), 6) AS macro, round(avg(CASE WHEN hit > 0 THEN n / hit END), 6) AS nullable_mean, round(avg(cost), 9) AS cost_per_question FROM s")
def micro_macro(t):
    """Precision over all rows and as a mean of questions, a mean that skips nulls, and cost a question."""
    s = t("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("hit"), (F.sum(F.col("l_quantity") * 3 + F.col("l_tax") * 5) / 1e6).alias("cost"))
    return s.agg(F.round(F.sum("hit") / F.sum("n"), 6).alias("micro"), F.round(F.avg(F.col("hit") / F.col("n")), 6).alias("macro"), F.round(F.avg(F.when(F.col("hit") > 0, F.col("n") / F.col("hit"))), 6).alias("nullable_mean"), F.round(F.avg("cost"), 9).alias("cost_per_question"))


_DAYS = "d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (WHERE event_type = 'purchase') AS p FROM events GROUP BY ALL)"


@query("dense_points", f"WITH {_DAYS}, c AS (SELECT DISTINCT user_id, unnest(generate_series(DATE '2024-01-03', DATE '2024-01-30', INTERVAL 1 DAY))::DATE AS day FROM events), f AS (SELECT c.user_id, c.day, coalesce(n, 0) AS n, coalesce(p, 0) AS p FROM c LEFT JOIN d USING (user_id, day)), s AS (SELECT user_id, CAST(sum(CASE WHEN n > 0 THEN 2 ELSE 0 END + least(n, 20) + 5 * p) AS BIGINT) AS points, count(*) FILTER (WHERE n > 0) AS days FROM f GROUP BY user_id) SELECT user_id, points, days, CASE WHEN points >= 300 THEN 3 WHEN points >= 150 THEN 2 ELSE 1 END AS level, round(CASE WHEN points >= 300 THEN 1.0 WHEN points >= 150 THEN (points - 150) / 150.0 ELSE points / 150.0 END, 6) AS inside FROM s")
def dense_points(t):
    """Points of 28 days from a dense calendar, daily counts capped, the level and the share of it reached."""
    d = t("events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "purchase").alias("p"))
    calendar = t("events").select("user_id").distinct().withColumn("day", F.explode(F.sequence(F.to_date(F.lit("2024-01-03")), F.to_date(F.lit("2024-01-30")))))
    f = calendar.join(d, ["user_id", "day"], "left").fillna(0, ["n", "p"])
    points = F.sum(F.when(F.col("n") > 0, 2).otherwise(0) + F.least(F.col("n"), F.lit(20)) + 5 * F.col("p"))
    s = f.groupBy("user_id").agg(points.alias("points"), F.count_if(F.col("n") > 0).alias("days"))
    p = F.col("points")
    return s.select("user_id", "points", "days", F.when(p >= 300, 3).when(p >= 150, 2).otherwise(1).alias("level"), F.round(F.when(p >= 300, 1.0).when(p >= 150, (p - 150) / 150.0).otherwise(p / 150.0), 6).alias("inside"))


@query("reward_score", f"WITH {_DAYS}, s AS (SELECT user_id, sum(p) / 20.0 AS p, count(*) / 30.0 AS t, sum(n) / 400.0 AS r, max(n) / 30.0 AS e FROM d GROUP BY user_id) SELECT user_id, round(greatest(7.0, least(10.0, 7 + 3 * (0.3 * least(1.0, p) + 0.25 * least(1.0, t) + 0.2 * least(1.0, r) + 0.25 * least(1.0, e))))::DOUBLE, 1) AS reward FROM s")
def reward_score(t):
    """A weighted score between 7 and 10, each part capped at 1."""
    d = t("events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "purchase").alias("p"))
    s = d.groupBy("user_id").agg((F.sum("p") / 20.0).alias("p"), (F.count("*") / 30.0).alias("t"), (F.sum("n") / 400.0).alias("r"), (F.max("n") / 30.0).alias("e"))
    one = lambda c: F.least(F.lit(1.0), F.col(c))
    total = 7 + 3 * (0.3 * one("p") + 0.25 * one("t") + 0.2 * one("r") + 0.25 * one("e"))
    return s.select("user_id", F.round(F.greatest(F.lit(7.0), F.least(F.lit(10.0), total)), 1).alias("reward"))


@query("kept_days", f"WITH {_DAYS} SELECT user_id, day, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day DESC) AS i FROM d) WHERE i <= 12")
def kept_days(t):
    """The last days of each user stay (12 here, 120 by default)."""
    return activity.last_days(activity.daily(t("events")), ["user_id"], 12).select("user_id", "day", "n")


@query("timing_length", "SELECT user_id, event_type, CAST((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0 AS DOUBLE) AS seconds, greatest(2.0::DOUBLE, round(0.7 * CAST((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0 AS DOUBLE), 3)) AS least_repeat FROM events GROUP BY ALL")
def timing_length(t):
    """Time from the first to the last mark, and the least time of a repeat: 2 s or 70 %."""
    s = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1000000.0
    return t("events").groupBy("user_id", "event_type").agg(s.alias("seconds"), F.greatest(F.lit(2.0), F.round(0.7 * s, 3)).alias("least_repeat"))


@query("gap_interpolation", "WITH r AS (SELECT user_id, event_id AS pos, CASE WHEN event_id % 4 = 0 THEN value END AS v FROM events), f AS (SELECT *, last(CASE WHEN v IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS p0, last(v IGNORE NULLS) OVER b AS v0, first(CASE WHEN v IS NOT NULL THEN pos END IGNORE NULLS) OVER a AS p1, first(v IGNORE NULLS) OVER a AS v1 FROM r WINDOW b AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT user_id, pos, round(CASE WHEN v IS NOT NULL THEN v WHEN v0 IS NULL THEN v1 WHEN v1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (pos - p0) / (p1 - p0) END + 0.000001::DOUBLE, 4) AS filled FROM f")
def gap_interpolation(t):
    """Gaps between known points filled on a line, at the ends by the nearest."""
    r = t("events").select("user_id", F.col("event_id").alias("pos"), F.when(F.col("event_id") % 4 == 0, F.col("value")).alias("v"))
    return activity.interpolated(r, ["user_id"], "pos", "v").select("user_id", "pos", F.round(F.col("v") + 0.000001, 4).alias("filled"))


@query("part_at_count", "WITH l AS (SELECT l_orderkey, l_linenumber, sum(l_quantity) OVER w AS upto, l_quantity FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS UNBOUNDED PRECEDING)) SELECT l_orderkey, l_linenumber AS part, CAST(45 - (upto - l_quantity) AS BIGINT) AS inside FROM l WHERE upto - l_quantity <= 45 AND 45 < upto")
def part_at_count(t):
    """The part in which a running count lies, by cumulative lengths."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").rowsBetween(Window.unboundedPreceding, 0)
    l = t("lineitem").withColumn("upto", F.sum("l_quantity").over(w))
    return l.filter("upto - l_quantity <= 45 and 45 < upto").select("l_orderkey", F.col("l_linenumber").alias("part"), (45 - (F.col("upto") - F.col("l_quantity"))).cast("long").alias("inside"))


@query("repeat_queue", "WITH x AS (SELECT n_regionkey AS g, n_nationkey AS item, n_nationkey % 3 + 1 AS reps FROM nation), q AS (SELECT g, item, 0 AS pass, unnest(range(1, CAST(reps AS BIGINT) + 1)) AS rep FROM x UNION ALL SELECT g, item, 1, 1 FROM x) SELECT g, item, CAST(row_number() OVER (PARTITION BY g ORDER BY pass, item, rep) AS INT) AS place FROM q")
def repeat_queue(t):
    """Each item as often as it is to be repeated, then all once."""
    x = t("nation").select(F.col("n_regionkey").alias("g"), F.col("n_nationkey").alias("item"), (F.col("n_nationkey") % 3 + 1).alias("reps"))
    q = x.select("g", "item", F.lit(0).alias("pass"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("reps").cast("long"))).alias("rep")).union(x.select("g", "item", F.lit(1), F.lit(1).cast("long")))
    return q.select("g", "item", F.row_number().over(Window.partitionBy("g").orderBy("pass", "item", "rep")).alias("place"))


_D = "SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders"


@query("decimal_years", f"SELECT day, round(year(day) + (dayofyear(day) - 1) / CASE WHEN (year(day) % 4 = 0 AND year(day) % 100 <> 0) OR year(day) % 400 = 0 THEN 366.0::DOUBLE ELSE 365.0::DOUBLE END, 6) AS decimal_year, ['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'][CAST(floor(((dayofyear(day) * 7 % 360) + 22.5) / 45) AS INT) % 8 + 1] AS zone FROM ({_D})")
def decimal_years(t):
    """A date as a decimal year, and the compass zone of an angle."""
    d = t("orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return d.select("day", F.round(geo.decimal_year(F.col("day")), 6).alias("decimal_year"), geo.zone(F.dayofyear("day") * 7 % 360).alias("zone"))


@query("upcoming_events", f"WITH d AS ({_D}), y AS (SELECT DISTINCT make_date(CAST(year(day) + k AS INT), m, 15) AS at, 'fair ' || m AS name FROM d, (VALUES (0), (1)) k(k), (VALUES (3), (9)) m(m)) SELECT d.day, y.name, y.at, date_diff('day', d.day, y.at) AS days FROM d ASOF JOIN y ON d.day <= y.at")
def upcoming_events(t):
    """The next yearly event on or after each day."""
    d = t("orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    near = lambda k: F.struct(*[F.make_date(F.year("day") + k, F.lit(m), F.lit(15)).alias(f"m{m}") for m in (3, 9)])
    dates = F.flatten(F.array(*[F.array(*[F.struct(near(k)[f"m{m}"].alias("at"), F.lit(f"fair {m}").alias("name")) for m in (3, 9)]) for k in (0, 1)]))
    nxt = F.array_min(F.filter(dates, lambda e: e["at"] >= F.col("day")))
    return d.select("day", nxt["name"].alias("name"), nxt["at"].alias("at"), F.date_diff(nxt["at"], "day").cast("long").alias("days"))


@query("radius_places", """WITH c AS (SELECT c_custkey AS id, c_mktsegment AS name, (c_custkey * 37 % 1400) / 1000.0::DOUBLE AS lat, (c_custkey * 91 % 3600) / 3000.0::DOUBLE AS lon FROM customer), k AS (SELECT id, name, lat, lon, round(2 * 6371.0088::DOUBLE * asin(least(1.0, sqrt(pow(sin(radians(0.5 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(0.5)) * pow(sin(radians(0.5 - lon) / 2), 2)))), 4) AS km FROM c),
n AS (SELECT * FROM k WHERE km <= 40), b AS (SELECT a.id FROM n a JOIN n e ON e.name = a.name AND (e.km < a.km OR (e.km = a.km AND e.id < a.id)) AND 2 * 6371.0088::DOUBLE * asin(least(1.0, sqrt(pow(sin(radians(e.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(e.lat)) * pow(sin(radians(e.lon - a.lon) / 2), 2)))) <= 0.8) SELECT id, name, km FROM n WHERE id NOT IN (SELECT id FROM b)""")
def radius_places(t):
    """Places within a radius by distance; a nearer one of the same name close by stands for both."""
    c = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("name"), ((F.col("c_custkey") * 37 % 1400) / 1000.0).alias("lat"), ((F.col("c_custkey") * 91 % 3600) / 3000.0).alias("lon"))
    return geo.within(c, 0.5, 0.5, 40.0, 0.8).select("id", "name", "km")


@query("portion_plan", "WITH p AS (SELECT c_custkey, 604 AS pages, c_custkey % 300 AS done, 30 AS days, c_custkey % 29 AS passed FROM customer) SELECT c_custkey, CAST(ceil((pages - done) / CAST(days - passed AS DOUBLE) - 1e-9::DOUBLE) AS BIGINT) AS portion, done < pages * passed / CAST(days AS DOUBLE) AS behind, CAST(ceil((pages - done) / greatest(1.0, done / CAST(greatest(1, passed) AS DOUBLE)) - 1e-9::DOUBLE) AS BIGINT) AS suggested_days, abs(done / CAST(greatest(1, passed) AS DOUBLE) - 20.0) <= 2.0 AS on_pace FROM p")
def portion_plan(t):
    """Pages a day that are left, whether one is behind, the days that the pace asks for, 10 % tolerance."""
    k = F.col("c_custkey")
    p = t("customer").select(k, (k % 300).alias("done"), (k % 29).alias("passed"))
    pace = F.col("done") / F.greatest(F.lit(1), F.col("passed"))
    return p.select("c_custkey", F.ceil((604 - F.col("done")) / (30 - F.col("passed")) - 1e-9).alias("portion"), (F.col("done") < 604 * F.col("passed") / 30.0).alias("behind"), F.ceil((604 - F.col("done")) / F.greatest(F.lit(1.0), pace) - 1e-9).alias("suggested_days"), (F.abs(pace - 20.0) <= 2.0).alias("on_pace"))


@query("interval_weights", "WITH g AS (SELECT n_nationkey AS g, n_nationkey * 37 AS lo, n_nationkey * 37 + 50 AS hi FROM nation), p AS (SELECT s_suppkey AS page, s_suppkey * 15 AS lo, s_suppkey * 15 + 14 AS hi FROM supplier) SELECT g, page, round((least(g.hi, p.hi) - greatest(g.lo, p.lo) + 1) / 15.0, 6) AS w FROM g JOIN p ON g.lo <= p.hi AND p.lo <= g.hi")
def interval_weights(t):
    """Pages that each group overlaps, weighed by the share of the page. Intervals meet in buckets of one page."""
    g = t("nation").select(F.col("n_nationkey").alias("g"), (F.col("n_nationkey") * 37).alias("lo"), (F.col("n_nationkey") * 37 + 50).alias("hi"))
    p = t("supplier").select(F.col("s_suppkey").alias("page"), (F.col("s_suppkey") * 15).alias("plo"), (F.col("s_suppkey") * 15 + 14).alias("phi"), F.col("s_suppkey").cast("long").alias("bucket"))
    x = g.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("lo") / 15), F.floor(F.col("hi") / 15)))).join(p, "bucket")
    return x.select("g", "page", F.round((F.least("hi", "phi") - F.greatest("lo", "plo") + 1) / 15.0, 6).alias("w"))


@query("reminder_calendar", "WITH s AS (SELECT c_custkey, c_custkey % 4 AS kind, DATE '2024-01-01' + CAST(c_custkey % 10 AS INT) AS first FROM customer), d AS (SELECT c_custkey, kind, first, unnest(generate_series(DATE '2024-01-06', DATE '2024-02-05', INTERVAL 1 DAY))::DATE AS day FROM s) SELECT c_custkey, day FROM d WHERE day >= first AND CASE kind WHEN 0 THEN true WHEN 1 THEN isodow(day) = 5 WHEN 2 THEN date_diff('day', first, day) % 3 = 0 ELSE day(day) IN (13, 14, 15) END")
def reminder_calendar(t):
    """Reminders in a span of days by four schedules: daily, weekly, every third day, certain days of the month."""
    s = t("customer").select("c_custkey", (F.col("c_custkey") % 4).alias("kind"), F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("c_custkey") % 10).cast("int")).alias("first"))
    d = s.withColumn("day", F.explode(F.sequence(F.to_date(F.lit("2024-01-06")), F.to_date(F.lit("2024-02-05"))))).filter("day >= first")
    due = F.when(F.col("kind") == 0, True).when(F.col("kind") == 1, F.weekday("day") == 4).when(F.col("kind") == 2, F.date_diff("day", "first") % 3 == 0).otherwise(F.dayofmonth("day").isin(13, 14, 15))
    return d.filter(due).select("c_custkey", "day")


@query("group_orders", "WITH g AS (SELECT p_brand AS g, count(*) AS n, CAST(sum(length(p_name)) AS BIGINT) AS letters, min(p_partkey) AS first, avg(length(p_name)) AS mean FROM part GROUP BY 1) SELECT g, CAST(row_number() OVER (ORDER BY g) AS INT) AS canonical, CAST(row_number() OVER (ORDER BY first, g) AS INT) AS chronological, CAST(row_number() OVER (ORDER BY letters DESC, g) AS INT) AS by_letters, CAST(row_number() OVER (ORDER BY n DESC, g) AS INT) AS by_count, CAST(row_number() OVER (ORDER BY mean DESC, g) AS INT) AS by_mean FROM g")
def group_orders(t):
    """K3: the same groups in several orders. One row a brand takes part in the windows."""
    g = t("part").groupBy(F.col("p_brand").alias("g")).agg(F.count("*").alias("n"), F.sum(F.length("p_name")).alias("letters"), F.min("p_partkey").alias("first"), F.avg(F.length("p_name")).alias("mean"))
    at = lambda *order: F.row_number().over(Window.orderBy(*order, "g"))
    return g.select("g", at().alias("canonical"), at("first").alias("chronological"), at(F.desc("letters")).alias("by_letters"), at(F.desc("n")).alias("by_count"), at(F.desc("mean")).alias("by_mean"))


@query("place_quota", "WITH d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey, lower(c_name) ORDER BY c_custkey) AS dup FROM customer) WHERE dup = 1), r AS (SELECT *, c_mktsegment = 'BUILDING' AS regional, row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE 1 END, c_acctbal DESC, c_custkey) AS n FROM d) SELECT c_nationkey, c_custkey, CAST(n AS INT) AS place FROM r WHERE regional OR n <= 12")
def place_quota(t):
    """K4: regional rows first and all of them, others by size up to a quota; names once whatever their case."""
    d = t("customer").withColumn("dup", F.row_number().over(Window.partitionBy("c_nationkey", F.lower("c_name")).orderBy("c_custkey"))).filter("dup = 1")
    regional = F.col("c_mktsegment") == "BUILDING"
    n = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.when(regional, 0).otherwise(1), F.desc("c_acctbal"), "c_custkey"))
    return d.withColumn("place", n).filter(regional | (F.col("place") <= 12)).select("c_nationkey", "c_custkey", "place")


@query("marked_units", "WITH e AS (SELECT user_id, event_id % 40 AS unit, event_type, row_number() OVER (PARTITION BY user_id, event_id % 40 ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type IN ('view', 'click', 'error')), m AS (SELECT user_id, unit FROM e WHERE n = 1 AND event_type <> 'error'), s AS (SELECT user_id, unit // 10 AS page, count(*) AS n FROM m GROUP BY ALL), u AS (SELECT DISTINCT user_id FROM events), a AS (SELECT user_id, unnest([0, 1, 2, 3]) AS page FROM u) SELECT a.user_id, count(*) FILTER (WHERE coalesce(n, 0) = 10) AS full_pages, min(CASE WHEN coalesce(n, 0) < 10 THEN a.page END) AS first_open, CAST(coalesce(sum(n), 0) AS BIGINT) AS marked FROM a LEFT JOIN s ON s.user_id = a.user_id AND s.page = a.page GROUP BY a.user_id")
def marked_units(t):
    """Units marked and unmarked, the latest event counts; pages fully covered, the first that is not."""
    e = t("events").filter(F.col("event_type").isin("view", "click", "error")).select("user_id", (F.col("event_id") % 40).alias("unit"), "event_type", "ts", "event_id")
    last = e.groupBy("user_id", "unit").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("kind")).filter("kind <> 'error'")
    s = last.groupBy("user_id", F.floor(F.col("unit") / 10).cast("int").alias("page")).agg(F.count("*").alias("n"))
    a = t("events").select("user_id").distinct().withColumn("page", F.explode(F.array(*map(F.lit, range(4)))))
    n = F.coalesce("n", F.lit(0))
    return a.join(s, ["user_id", "page"], "left").groupBy("user_id").agg(F.count_if(n == 10).alias("full_pages"), F.min(F.when(n < 10, F.col("page"))).alias("first_open"), F.sum(n).alias("marked"))


_NODES = "nodes AS (SELECT p_partkey AS id, CASE WHEN p_partkey > 2 THEN p_partkey // 3 END AS parent FROM part WHERE p_partkey > 0)"


@query("group_assignment", f"""WITH RECURSIVE {_NODES}, roots AS (SELECT p_partkey % 3 AS walk, p_partkey AS id, row_number() OVER (PARTITION BY p_partkey % 3 ORDER BY p_size DESC, p_partkey) AS place FROM part WHERE p_partkey BETWEEN 4 AND 11),
w AS (SELECT walk, id, [place] AS path FROM roots UNION ALL SELECT w.walk, n.id, list_append(path, n.id) FROM w JOIN nodes n ON n.parent = w.id WHERE len(path) <= 5),
m AS (SELECT DISTINCT l_partkey AS id, l_suppkey AS member FROM lineitem), met AS (SELECT walk, member, min(path) AS path FROM w JOIN m USING (id) GROUP BY walk, member),
g AS (SELECT walk, path, count(*) AS n, len(path) = 1 AS own FROM met GROUP BY walk, path),
o AS (SELECT *, row_number() OVER (PARTITION BY walk ORDER BY own DESC, n DESC, path) AS place, sum(n) OVER (PARTITION BY walk ORDER BY own DESC, n DESC, path) - n AS before FROM g),
f AS (SELECT o.*, met.member, row_number() OVER (PARTITION BY walk, path ORDER BY member) AS r FROM met JOIN o USING (walk, path))
SELECT f.walk, w.id, own, n, CAST(place AS INT) AS place, member FROM f JOIN w ON w.walk = f.walk AND w.path = f.path WHERE before + r <= 60""")
def group_assignment(t):
    """G1: walks from three lists of roots, five levels down; each supplier goes to the first part that reaches it, groups of
    the roots first and then by size, sixty suppliers at most."""
    p = F.col("p_partkey")
    nodes = t("part").filter(p > 0).select(p.alias("id"), F.when(p > 2, F.floor(p / 3)).alias("parent"))
    place = F.row_number().over(Window.partitionBy("walk").orderBy(F.desc("p_size"), "id"))
    roots = t("part").filter(p.between(4, 11)).select((p % 3).alias("walk"), p.alias("id"), "p_size").select("walk", "id", place.alias("place"))
    members = t("lineitem").select(F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("member"))
    return tree.first_reach(tree.walked(nodes, roots, "walk", 5), members, "walk", 60)


@query("children_lists", """WITH n AS (SELECT p_partkey AS id, p_partkey // 3 AS parent, 'of ' || (SELECT any_value(q.p_name) FROM part q WHERE q.p_partkey = CASE WHEN p.p_partkey % 11 = 0 THEN p.p_partkey // 3 + 1 ELSE p.p_partkey // 3 END) AS crumb FROM part p WHERE p_partkey > 2)
SELECT c.parent, p.p_name AS parent_name, list(c.id ORDER BY c.id)[:2] AS children, count(*) AS n, count(*) FILTER (WHERE c.crumb IS DISTINCT FROM 'of ' || p.p_name) AS strayed, coalesce(bool_and(c.crumb = 'of ' || p.p_name), false) AS linked FROM n c LEFT JOIN part p ON p.p_partkey = c.parent GROUP BY c.parent, p.p_name""")
def children_lists(t):
    """The first children of each node, and whether the breadcrumb that each child records names this parent; here
    every eleventh child names another one. Children of a node that is not there stay, and are not linked."""
    c = t("part").filter("p_partkey > 2").select(F.col("p_partkey").alias("id"), F.floor(F.col("p_partkey") / 3).alias("parent"))
    names = t("part").select(F.col("p_partkey").alias("named"), F.concat(F.lit("of "), "p_name").alias("crumb"))
    recorded = c.withColumn("named", F.col("parent") + F.when(F.col("id") % 11 == 0, 1).otherwise(0)).join(names, "named", "left").drop("named")
    p = t("part").select(F.col("p_partkey").alias("parent"), F.col("p_name").alias("parent_name"))
    return tree.children(recorded, p, "parent", "id", F.coalesce(F.col("crumb") == F.concat(F.lit("of "), F.col("parent_name")), F.lit(False)), 2).select("parent", "parent_name", "children", "n", "strayed", "linked")


@query("bearing_check", "WITH a AS (SELECT n_nationkey, (n_nationkey * 53 % 360)::DOUBLE AS x, (n_nationkey * 53 % 360 + n_nationkey % 5 + 357) % 360 AS y, [n_nationkey, n_nationkey + 3, n_nationkey + 2 + n_nationkey % 3, n_nationkey + 9] AS times FROM nation) SELECT n_nationkey, abs((x - y + 540) % 360 - 180) AS off, len(list_filter(range(1, 4), lambda i: times[i] >= times[i + 1])) = 0 AS rising FROM a")
def bearing_check(t):
    """How far two bearings are apart on the circle, and whether daily times rise strictly."""
    k = F.col("n_nationkey")
    x, y, times = (k * 53 % 360).cast("double"), (k * 53 % 360 + k % 5 + 357) % 360, F.array(k, k + 3, k + 2 + k % 3, k + 9)
    rising = F.forall(F.arrays_zip(F.slice(times, 1, 3).alias("a"), F.slice(times, 2, 3).alias("b")), lambda z: z["a"] < z["b"])
    return t("nation").select("n_nationkey", F.abs((x - y + 540) % 360 - 180).alias("off"), rising.alias("rising"))


@query("palette_groups", "WITH f AS (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS first FROM orders GROUP BY ALL), o AS (SELECT *, dense_rank() OVER (PARTITION BY o_custkey ORDER BY first) - 1 AS ord FROM f) SELECT o_custkey, o_orderpriority, CAST(ord % 3 AS INT) AS colour FROM o WHERE ord < 10")
def palette_groups(t):
    """Groups numbered by first appearance, coloured in turn, ten at most."""
    f = t("orders").groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderkey").alias("first"))
    o = f.withColumn("ord", F.dense_rank().over(Window.partitionBy("o_custkey").orderBy("first")) - 1).filter("ord < 10")
    return o.select("o_custkey", "o_orderpriority", (F.col("ord") % 3).cast("int").alias("colour"))


@query("rule_at_word", "WITH w AS (SELECT o_custkey AS p, o_orderkey AS at, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS word FROM orders), a AS (SELECT c_custkey AS p, c_custkey * 10 + c_nationkey * 500 AS at, c_mktsegment AS rule FROM customer) SELECT a.p, a.rule, CAST(w.word AS INT) AS word FROM a ASOF JOIN w ON a.p = w.p AND a.at >= w.at")
def rule_at_word(t):
    """The word in which an annotation starts: the one of largest offset at or before it."""
    from ..operators import joins

    w = t("orders").select(F.col("o_custkey").alias("p"), F.col("o_orderkey").alias("at"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("word"))
    a = t("customer").select(F.col("c_custkey").alias("p"), (F.col("c_custkey") * 10 + F.col("c_nationkey") * 500).alias("at"), F.col("c_mktsegment").alias("rule"))
    return joins.as_of(a, w, ["p"], "at", ["word"]).filter("word is not null").select("p", "rule", "word")


@query("shared_units", "SELECT conv_id, turn, coalesce(lag(k) OVER w = k, false) OR coalesce(lead(k) OVER w = k, false) AS shared FROM (SELECT conv_id, turn, substr(role, 1, 1) || CASE WHEN length(text) > 120 THEN 'l' ELSE 's' END AS k FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def shared_units(t):
    """Whether a unit equals that of the row before or after."""
    c = t("conversations").select("conv_id", "turn", F.concat(F.substring("role", 1, 1), F.when(F.length("text") > 120, "l").otherwise("s")).alias("k"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    same = lambda x: F.coalesce(x == F.col("k"), F.lit(False))
    return c.select("conv_id", "turn", (same(F.lag("k").over(w)) | same(F.lead("k").over(w))).alias("shared"))


_BREAKER = "WITH e AS (SELECT user_id, event_id, ts, event_type = 'error' AS failed, row_number() OVER w AS i FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), r AS (SELECT *, i - row_number() OVER (PARTITION BY user_id, failed ORDER BY i) AS run FROM e), f AS (SELECT *, CASE WHEN failed THEN row_number() OVER (PARTITION BY user_id, failed, run ORDER BY i) ELSE 0 END AS streak FROM r), o AS (SELECT *, max(CASE WHEN streak = 3 THEN epoch_us(ts) END) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS opened FROM f) SELECT user_id, count(*) FILTER (WHERE streak = 3) AS opens, count(*) FILTER (WHERE opened IS NOT NULL AND epoch_us(ts) < opened + 43200000000) AS refused FROM o GROUP BY user_id"


@query("circuit_breaker", _BREAKER)
def circuit_breaker(t):
    """Three failures in a row open the breaker for a time; calls refused meanwhile."""
    return activity.breaker(t("events"), ["user_id"], "ts", "event_id", F.col("event_type") == "error", 3, 43_200)


_WINDOW_LIMIT = "WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) // 1000000 AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), w AS (SELECT user_id, i, s, s AS began, 1 AS n FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.i, e.s, CASE WHEN e.s - w.began >= 86400 THEN e.s ELSE w.began END, CASE WHEN e.s - w.began >= 86400 THEN 1 ELSE w.n + 1 END FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1) SELECT user_id, count(*) AS n, count(*) FILTER (WHERE n > 3) AS rejected FROM w GROUP BY user_id"


@query("window_limit", _WINDOW_LIMIT)
def window_limit(t):
    """Calls beyond a limit in a window that starts with its first call and restarts when it is over."""
    return activity.window_limit(t("events"), ["user_id"], "ts", "event_id", 86_400, 3)


@query("content_cache", "SELECT sha256(coalesce(text, '')) AS key, count(*) AS n, min(doc_id) AS kept FROM documents GROUP BY 1")
def content_cache(t):
    """One answer for each content, by its digest."""
    return t("documents").groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("key")).agg(F.count("*").alias("n"), F.min("doc_id").alias("kept"))


@query("fact_counts", "SELECT source, count(*) AS docs, count(*) FILTER (WHERE starts_with(text, 'The')) AS the, max(n_chars) AS longest, count(DISTINCT lang) AS langs, count(*) FILTER (WHERE n_chars < 100) AS short, min_by(doc_id, n_chars * 1000000 + doc_id) AS shortest FROM documents GROUP BY source")
def fact_counts(t):
    """Counts by prefix and bound, extremes, and distinct kinds of each group."""
    c = F.col
    return t("documents").groupBy("source").agg(F.count("*").alias("docs"), F.count_if(c("text").startswith("The")).alias("the"), F.max("n_chars").alias("longest"), F.count_distinct("lang").alias("langs"), F.count_if(c("n_chars") < 100).alias("short"), F.min_by("doc_id", c("n_chars") * 1000000 + c("doc_id")).alias("shortest"))


@query("form_positions", "WITH w AS (SELECT conv_id, turn, unnest(string_split(lower(text), ' ')) AS w, generate_subscripts(string_split(lower(text), ' '), 1) AS i FROM conversations) SELECT conv_id, turn, i AS pos, w AS word, CAST(row_number() OVER (PARTITION BY conv_id, w ORDER BY turn, i) AS INT) AS nth, count(*) OVER (PARTITION BY conv_id, w) AS n FROM w")
def form_positions(t):
    """Of each word its place, which occurrence in its group it is, and how many there are."""
    d = t("conversations").select("conv_id", "turn", F.posexplode(F.split(F.lower("text"), " ")).alias("p", "word"))
    w = Window.partitionBy("conv_id", "word")
    return d.select("conv_id", "turn", (F.col("p") + 1).cast("long").alias("pos"), "word", F.row_number().over(w.orderBy("turn", "p")).alias("nth"), F.count("*").over(w).alias("n"))


@query("window_limit_stream", _WINDOW_LIMIT)
def window_limit_stream(t):
    """U3 as a stream: the same answer as window_limit's, of calls that arrive late, out of order and twice."""
    from ..streaming import guards

    said = guards.replayed(t("events"), F.lit(False), guards.limit(3, 86_400))
    return said.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("value").alias("rejected"))


@query("circuit_breaker_stream", _BREAKER)
def circuit_breaker_stream(t):
    """U5 as a stream: the same answer as circuit_breaker's, of calls that arrive late, out of order and twice."""
    from ..streaming import guards

    said = guards.replayed(t("events"), F.col("event_type") == "error", guards.breaker(3, 43_200))
    return said.groupBy("user_id").agg(F.sum(F.when(F.col("value") >= 2, 1).otherwise(0)).alias("opens"), F.sum(F.col("value") % 2).alias("refused"))
