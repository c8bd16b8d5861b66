"""The library's queries over the standard tables, each beside the SQL that it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import joins, windows
from .plans import decide
from .sources.tables import events, hosts, table
from .streaming.windows import check_ins

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Shared relations of the SQL side.
EV = """ev AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) / 1e6 AS t, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
 CAST(floor(epoch_us(ts) / 1e6 / 86400) AS BIGINT) AS day, CAST(floor(epoch_us(ts) / 1e6 / 3600) AS BIGINT) % 24 AS hour FROM events)"""
HO = r"ho AS (SELECT page_id, url, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host FROM pages)"
DAILY = """daily AS (SELECT user_id, day, count(*) AS n, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) / count(*) AS error_ratio, count(DISTINCT k) AS targets,
 sum(value) AS total, max(value) AS top FROM ev GROUP BY 1, 2)"""


def query(sql: str = "", *parts: str):
    """Register a query under its function's name, with its SQL after the shared relations."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = ("WITH " + ", ".join(parts) + " " if parts else "") + sql
        return f

    return add


def n(c="*"):
    return F.count(c)


def when_n(cond):
    return F.sum(F.when(cond, 1).otherwise(0))


# --- scans, projections, predicates


@query("SELECT event_id, user_id, event_type FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 200")
def scan_incremental(s, d):
    return table(s, d, "events").where("event_id > 500").orderBy("event_id").limit(200).select("event_id", "user_id", "event_type")


@query("SELECT event_id, user_id FROM events WHERE user_id NOT IN (1, 2, 3) AND event_type NOT LIKE '%ew%'")
def scan_exclusions(s, d):
    return table(s, d, "events").where(~F.col("user_id").isin(1, 2, 3) & ~F.col("event_type").contains("ew")).select("event_id", "user_id")


@query("SELECT event_id, ('0x' || substr(md5(event_id::VARCHAR), 1, 7))::BIGINT AS h FROM events WHERE ('0x' || substr(md5(event_id::VARCHAR), 1, 7))::BIGINT % 50 = 0")
def scan_sampled(s, d):
    h = F.conv(F.substring(F.md5(F.col("event_id").cast("string")), 1, 7), 16, 10).cast("long")
    return table(s, d, "events").select("event_id", h.alias("h")).where("h % 50 = 0")


@query("SELECT user_id, event_id, epoch_us(ts) AS at FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def upsert_latest(s, d):
    e = events(s, d).withColumn("us", F.round(F.col("t") * 1e6).cast("long"))
    return e.groupBy("user_id").agg(F.max_by("event_id", F.struct("us", "event_id")).alias("event_id"), F.max("us").alias("at"))


@query("SELECT DISTINCT user_id, substr(md5(user_id::VARCHAR), 1, 12) AS device FROM events")
def stable_id(s, d):
    return table(s, d, "events").select("user_id").distinct().withColumn("device", F.substring(F.md5(F.col("user_id").cast("string")), 1, 12))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'blocked' WHEN k IS NULL THEN 'unknown' WHEN k % 10 = 0 THEN 'nxdomain' ELSE 'answered' END AS status FROM ev", EV)
def status_class(s, d):
    c = F.when(F.col("event_type") == "error", "blocked").when(F.col("k").isNull(), "unknown").when(F.col("k") % 10 == 0, "nxdomain").otherwise("answered")
    return events(s, d).select("event_id", c.alias("status"))


@query("SELECT user_id, round(sum(CASE WHEN event_type IN ('signup', 'purchase') THEN 1 ELSE 0 END) / count(*), 6) AS ratio FROM events GROUP BY user_id")
def qtype_ratio(s, d):
    return table(s, d, "events").groupBy("user_id").agg(F.round(when_n(F.col("event_type").isin("signup", "purchase")) / n(), 6).alias("ratio"))


IP = "concat_ws('.', CASE k % 6 WHEN 0 THEN 10 WHEN 1 THEN 127 WHEN 2 THEN 192 WHEN 3 THEN 224 WHEN 4 THEN 169 ELSE 8 END, CASE k % 6 WHEN 2 THEN 168 WHEN 4 THEN 254 ELSE k END, user_id % 256, event_id % 256)"


@query(f"""SELECT ip, CASE WHEN starts_with(ip, '127.') THEN 'loopback' WHEN starts_with(ip, '10.') OR starts_with(ip, '192.168.') THEN 'private' WHEN starts_with(ip, '169.254.') THEN 'link-local'
 WHEN starts_with(ip, '224.') THEN 'multicast' ELSE 'public' END AS class FROM (SELECT DISTINCT {IP} AS ip FROM ev WHERE k IS NOT NULL)""", EV)
def ip_class(s, d):
    return events(s, d).where("k IS NOT NULL").select(F.expr(IP).alias("ip")).distinct().withColumn("class", S.ip_class(S.ipv4(F.col("ip"))))


@query("SELECT event_id, CASE WHEN value >= 400 THEN 'large' WHEN value >= 100 THEN 'medium' WHEN value >= 0 THEN 'small' ELSE 'none' END AS band FROM events")
def band_label(s, d):
    v = F.col("value")
    return table(s, d, "events").select("event_id", F.when(v >= 400, "large").when(v >= 100, "medium").when(v >= 0, "small").otherwise("none").alias("band"))


@query("SELECT page_id, CASE WHEN host LIKE 'm.%' THEN 'mobile' WHEN host LIKE 'blog.%' THEN 'blog' WHEN host LIKE 'www.%' THEN 'web' ELSE 'other' END AS device_type FROM ho", HO)
def type_infer(s, d):
    h = F.col("host")
    return hosts(s, d).select("page_id", F.when(h.rlike(r"^m\."), "mobile").when(h.rlike(r"^blog\."), "blog").when(h.rlike(r"^www\."), "web").otherwise("other").alias("device_type"))


@query("SELECT event_id, round(greatest(0, 1 - age / 600), 6) AS freshness FROM (SELECT event_id, max(t) OVER () - t AS age FROM ev) WHERE age < 600", EV)
def evidence_freshness(s, d):
    e = events(s, d)
    e = e.join(F.broadcast(e.agg(F.max("t").alias("now"))))  # one row
    return e.withColumn("age", F.col("now") - F.col("t")).where("age < 600").select("event_id", F.round(S.freshness(F.col("age"), 600.0), 6).alias("freshness"))


@query("SELECT user_id, k, round(coalesce(least(1.0, greatest(0.0, (60 - k) / 46.0)), 1.0), 6) AS weight FROM ev", EV)
def staleness_decay(s, d):
    return events(s, d).select("user_id", "k", F.round(S.staleness(F.col("k")), 6).alias("weight"))


@query("SELECT event_id, round(least(10.0, greatest(0.0, value / 490 * 10)), 6) AS risk FROM events")
def risk_scale(s, d):
    return table(s, d, "events").select("event_id", S.risk_scale(F.col("value") / 490).alias("risk"))


@query("SELECT k, CASE WHEN max(o) = 2 THEN 'hit' WHEN min(o) = 1 THEN 'clean' ELSE 'not checked' END AS status FROM (SELECT k, CASE event_type WHEN 'error' THEN CASE WHEN value > 480 THEN 2 ELSE 1 END WHEN 'signup' THEN 0 ELSE 1 END AS o FROM ev) GROUP BY k", EV)
def tri_state(s, d):
    o = F.when(F.col("event_type") == "error", F.when(F.col("value") > 480, 2).otherwise(1)).when(F.col("event_type") == "signup", 0).otherwise(1)
    g = events(s, d).groupBy("k").agg(F.max(o).alias("hi"), F.min(o).alias("lo"))
    return g.select("k", F.when(F.col("hi") == 2, "hit").when(F.col("lo") == 1, "clean").otherwise("not checked").alias("status"))


# --- names


@query(r"""SELECT DISTINCT host, len(string_split(host, '.')) AS depth, string_split(host, '.')[-1] AS tld, list_max(list_transform(string_split(host, '.'), lambda x: length(x))) AS longest,
 array_to_string(string_split(host, '.')[-2:], '.') AS base FROM ho""", HO)
def domain_parts(s, d):
    labels = F.split("host", r"\.")
    return hosts(s, d).select("host").distinct().select("host", F.size(labels).cast("long").alias("depth"), F.element_at(labels, -1).alias("tld"), F.array_max(F.transform(labels, lambda x: F.length(x))).cast("long").alias("longest"), S.base_domain(F.col("host")).alias("base"))


@query("""SELECT label, round(-sum(p * log2(p)), 6) + 0 AS entropy FROM (SELECT label, c, count(*) / max(length(label)) AS p FROM (SELECT label, unnest(string_split(label, '')) AS c
 FROM (SELECT DISTINCT string_split(host, '.')[1] AS label FROM ho)) GROUP BY label, c) GROUP BY label""", HO)
def entropy(s, d):
    labels = hosts(s, d).select(F.substring_index("host", ".", 1).alias("label")).distinct()
    return labels.select("label", (F.round(S.entropy(F.col("label")), 6) + 0).alias("entropy"))


@query("SELECT DISTINCT host, round(length(regexp_replace(host, '[^aeiou]', '', 'g')) / length(host), 6) AS vowels, round(length(regexp_replace(host, '[^0-9]', '', 'g')) / length(host), 6) AS digits FROM ho WHERE host <> ''", HO)
def char_ratios(s, d):
    h = hosts(s, d).where("host <> ''").select("host").distinct()
    return h.select("host", F.round(S.share_of(F.col("host"), "[aeiou]"), 6).alias("vowels"), F.round(S.share_of(F.col("host"), "[0-9]"), 6).alias("digits"))


@query("""SELECT DISTINCT host, length(string_split(host, '.')[1]) || ':' || string_split(host, '.')[-1] || ':' || CASE WHEN regexp_full_match(string_split(host, '.')[1], '[a-z]+') THEN 'alpha'
 WHEN regexp_full_match(string_split(host, '.')[1], '[0-9]+') THEN 'digit' WHEN regexp_full_match(string_split(host, '.')[1], '[a-z0-9]+') THEN 'alnum' ELSE 'mixed' END AS shape FROM ho""", HO)
def shape_key(s, d):
    return hosts(s, d).select("host").distinct().select("host", S.shape_key(F.col("host")).alias("shape"))


@query(r"SELECT page_id, host, regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) AS path, regexp_extract(url, '\?([^#]*)', 1) AS query FROM ho", HO)
def url_parts(s, d):
    return hosts(s, d).select("page_id", "host", F.regexp_extract("url", r"^[a-z]+://[^/]+(/[^?#]*)", 1).alias("path"), F.regexp_extract("url", r"\?([^#]*)", 1).alias("query"))


SUFFIXES = [("example.net", "network"), ("example.com", "company"), ("tionsh.example.net", "listed"), ("www.thering.example.org", "exact")]


@query(f"""SELECT host, arg_max(suffix, length(suffix)) AS suffix, arg_max(note, length(suffix)) AS note, max(length(suffix)) < any_value(length(host)) AS matched_parent
 FROM (SELECT DISTINCT host FROM ho) h JOIN (VALUES {", ".join(f"('{a}', '{b}')" for a, b in SUFFIXES)}) v(suffix, note) ON host = suffix OR host LIKE '%.' || suffix GROUP BY host""", HO)
def suffix_match(s, d):
    return joins.longest_suffix(hosts(s, d), F.broadcast(s.createDataFrame(SUFFIXES, "suffix string, note string")))  # as large as SUFFIXES


# --- joins


@query("SELECT c_custkey, c_name, o_orderkey FROM customer LEFT JOIN (SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) ON c_custkey = o_custkey")
def latest_decision(s, d):
    last = table(s, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))
    return table(s, d, "customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_name", "o_orderkey")


@query("SELECT event_id FROM ev a WHERE day >= 19740 AND EXISTS (SELECT 1 FROM ev b WHERE b.user_id = a.user_id AND b.k = a.k AND b.day < 19740)", EV)
def seen_before(s, d):
    e = events(s, d)
    return e.where("day >= 19740").join(e.where("day < 19740").select("user_id", "k").distinct(), ["user_id", "k"], "left_semi").select("event_id")


@query("SELECT user_id, k, min(t) AS first FROM ev GROUP BY 1, 2 HAVING min(day) >= 19740", EV)
def first_contact(s, d):
    return events(s, d).groupBy("user_id", "k").agg(F.min("t").alias("first"), F.min("day").alias("m")).where("m >= 19740").drop("m")


@query("SELECT event_id FROM ev WHERE value < 50 AND user_id NOT IN (SELECT user_id FROM ev WHERE event_type = 'purchase' AND value > 480)", EV)
def prune_evidence(s, d):
    e = events(s, d)
    cited = e.where("event_type = 'purchase' AND value > 480").select("user_id").distinct()
    return e.where("value < 50").join(cited, "user_id", "left_anti").select("event_id")


@query("SELECT k, day, count(DISTINCT user_id) AS devices FROM ev WHERE event_type = 'error' GROUP BY 1, 2 HAVING count(DISTINCT user_id) >= 2", EV)
def coordinated_targeting(s, d):
    return events(s, d).where("event_type = 'error'").groupBy("k", "day").agg(F.countDistinct("user_id").alias("devices")).where("devices >= 2")


@query("SELECT k, count(DISTINCT user_id) AS devices, round(count(DISTINCT user_id) / (SELECT count(DISTINCT user_id) FROM ev), 6) AS share FROM ev GROUP BY k HAVING count(DISTINCT user_id) >= 2 AND share >= 0.4", EV)
def shared_infra(s, d):
    e = events(s, d)
    fleet = e.agg(F.countDistinct("user_id").alias("fleet"))  # one row
    return e.groupBy("k").agg(F.countDistinct("user_id").alias("devices")).join(F.broadcast(fleet)).select("k", "devices", F.round(F.col("devices") / F.col("fleet"), 6).alias("share")).where("devices >= 2 AND share >= 0.4")


RANGES = "SELECT i * 40.0 AS lo, i * 40.0 + 30.0 AS hi, 'band' || i AS label FROM range(0, 12) t(i)"


@query(f"SELECT event_id, label FROM events JOIN ({RANGES}) ON value BETWEEN lo AND hi")
def range_asn(s, d):
    r = s.range(12).select((F.col("id") * 40.0).alias("lo"), (F.col("id") * 40.0 + 30.0).alias("hi"), F.concat(F.lit("band"), F.col("id").cast("string")).alias("label"))
    return joins.in_range(table(s, d, "events"), F.broadcast(r), "value", 64.0).select("event_id", "label")  # twelve ranges


@query("SELECT e.event_id AS id, (SELECT arg_max(b.k, b.t * 1000000 + b.event_id) FROM ev b WHERE b.user_id = e.user_id AND b.event_type = 'signup' AND b.t <= e.t) AS k FROM ev e WHERE e.event_type = 'purchase'", EV)
def asof_identity(s, d):
    e = events(s, d)
    return joins.asof(e.where("event_type = 'purchase'").select(F.col("event_id").alias("id"), "user_id", "t"), e.where("event_type = 'signup'").select("user_id", "t", "k"), "user_id", "k").select("id", "k")


@query("""SELECT e.event_id, o.o_orderkey FROM ev e JOIN (SELECT o_custkey, o_orderkey, epoch_us(o_orderdate) / 1e6 AS a, lead(epoch_us(o_orderdate) / 1e6) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b FROM orders) o
 ON e.user_id = o.o_custkey AND e.t >= o.a AND (o.b IS NULL OR e.t < o.b)""", EV)
def interval_identity(s, d):
    from .sources.tables import epoch

    o = table(s, d, "orders").select("o_custkey", "o_orderkey", epoch("o_orderdate").alias("a"))
    o = o.withColumn("b", F.lead("a").over(W.partitionBy("o_custkey").orderBy("a", "o_orderkey")))
    e = events(s, d)
    return e.join(o, (e.user_id == o.o_custkey) & (e.t >= o.a) & (o.b.isNull() | (e.t < o.b))).select("event_id", "o_orderkey")


@query("SELECT a.event_id, b.event_id AS near FROM ev a JOIN ev b ON a.user_id = b.user_id AND b.t BETWEEN a.t - 7200 AND a.t + 7200 WHERE a.event_type = 'purchase' AND b.event_type = 'error'", EV)
def interval_near(s, d):
    e = events(s, d)
    a = e.where("event_type = 'purchase'").select("event_id", "user_id", "t", F.floor(F.col("t") / 7200).alias("slot"))
    b = e.where("event_type = 'error'").select(F.col("event_id").alias("near"), "user_id", F.col("t").alias("u"), F.explode(F.expr("sequence(floor(t / 7200) - 1, floor(t / 7200) + 1)")).alias("slot"))
    return a.join(b, ["user_id", "slot"]).where(F.abs(F.col("t") - F.col("u")) <= 7200).select("event_id", "near")  # each pair shares one slot of a


@query("SELECT coalesce(a.user_id, b.user_id) AS user_id, CASE WHEN b.user_id IS NULL THEN 'missing right' WHEN a.user_id IS NULL THEN 'missing left' WHEN a.n <> b.n THEN 'diverged' ELSE 'equal' END AS status FROM (SELECT user_id, count(*) AS n FROM ev WHERE event_type = 'view' GROUP BY 1) a FULL JOIN (SELECT user_id, count(*) AS n FROM ev WHERE event_type = 'click' GROUP BY 1) b ON a.user_id = b.user_id", EV)
def merge_check(s, d):
    e = events(s, d)
    a = e.where("event_type = 'view'").groupBy("user_id").agg(n().alias("a"))
    b = e.where("event_type = 'click'").groupBy("user_id").agg(n().alias("b"))
    return a.join(b, "user_id", "full").select("user_id", F.when(F.col("b").isNull(), "missing right").when(F.col("a").isNull(), "missing left").when(F.col("a") != F.col("b"), "diverged").otherwise("equal").alias("status"))


# --- aggregations


@query("SELECT user_id, day, count(*) AS n, round(count(*) / 1440, 6) AS per_minute FROM ev GROUP BY 1, 2", EV)
def dns_rate(s, d):
    return events(s, d).groupBy("user_id", "day").agg(n().alias("n"), F.round(n() / 1440, 6).alias("per_minute"))


@query("SELECT user_id, round(least(1.0, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) / count(*)), 6) AS blocked FROM ev GROUP BY 1", EV)
def blocked_nx_ratio(s, d):
    return events(s, d).groupBy("user_id").agg(F.round(F.least(F.lit(1.0), when_n(F.col("event_type") == "error") / n()), 6).alias("blocked"))


@query("SELECT base, count(DISTINCT host) AS children FROM (SELECT host, array_to_string(string_split(host, '.')[-2:], '.') AS base FROM ho) GROUP BY base", HO)
def subdomain_fanout(s, d):
    return hosts(s, d).groupBy(S.base_domain(F.col("host")).alias("base")).agg(F.countDistinct("host").alias("children"))


@query("SELECT user_id, round(var_pop(n), 6) AS variance FROM (SELECT user_id, k, count(*) AS n FROM ev GROUP BY 1, 2) GROUP BY 1", EV)
def query_variance(s, d):
    return events(s, d).groupBy("user_id", "k").agg(n().alias("n")).groupBy("user_id").agg(F.round(F.var_pop("n"), 6).alias("variance"))


@query("""SELECT user_id, k, round(w / total, 6) AS share FROM (SELECT *, sum(w) OVER (PARTITION BY user_id) AS total, row_number() OVER (PARTITION BY user_id ORDER BY w DESC, k) AS place
 FROM (SELECT user_id, k, round(sum(pow(0.5, (last - day) / 7.0)), 9) AS w FROM ev, (SELECT max(day) AS last FROM ev) GROUP BY 1, 2)) WHERE place = 1""", EV)
def decayed_top(s, d):
    """The destination with the highest weight, halved each week before the last day of the data; of equal weights the smaller."""
    e = events(s, d)
    last = e.agg(F.max("day").alias("last"))
    w = e.join(F.broadcast(last)).groupBy("user_id", "k").agg(F.round(F.sum(F.pow(F.lit(0.5), (F.col("last") - F.col("day")) / 7.0)), 9).alias("w"))  # one row
    return w.groupBy("user_id").agg(F.max_by("k", F.struct("w", -F.col("k"))).alias("k"), F.round(F.max("w") / F.sum("w"), 6).alias("share"))


@query("SELECT user_id, count(*) AS n, count(DISTINCT k) AS targets, count(DISTINCT CASE WHEN event_type = 'error' THEN k END) AS rejected, round(max(value), 4) AS longest, round(sum(value), 4) AS bytes, array_to_string(list_sort(list(DISTINCT k))[1:5], ',') AS examples FROM ev GROUP BY 1", EV)
def conn_features(s, d):
    """Through (device, destination) first: no expansion for the distinct counts, and only the five smallest destinations are printed."""
    e = events(s, d).groupBy("user_id", "k").agg(n().alias("n"), when_n(F.col("event_type") == "error").alias("errors"), F.max("value").alias("longest"), F.sum("value").alias("bytes"))
    e = e.withColumn("place", F.row_number().over(W.partitionBy("user_id").orderBy(F.asc_nulls_last("k"))))
    first = F.sort_array(F.collect_list(F.when(F.col("place") <= 5, F.col("k"))))
    return e.groupBy("user_id").agg(
        F.sum("n").alias("n"), F.count("k").alias("targets"), when_n((F.col("errors") > 0) & F.col("k").isNotNull()).alias("rejected"), F.round(F.max("longest"), 4).alias("longest"),
        F.round(F.sum("bytes"), 4).alias("bytes"), F.array_join(first, ",").alias("examples"))


@query("""SELECT user_id, CASE WHEN n * 2 >= total THEN event_type ELSE 'unknown' END AS dominant FROM (SELECT user_id, event_type, count(*) AS n, sum(count(*)) OVER (PARTITION BY user_id) AS total,
 row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type DESC) AS place FROM ev GROUP BY 1, 2) WHERE place = 1""", EV)
def dominant_dest(s, d):
    c = events(s, d).groupBy("user_id", "event_type").agg(n().alias("n"))
    return c.groupBy("user_id").agg(F.when(F.max("n") / F.sum("n") >= 0.5, F.max_by("event_type", F.struct("n", "event_type"))).otherwise("unknown").alias("dominant"))


@query("SELECT user_id, k, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, k) AS rank FROM (SELECT user_id, k, count(*) AS n FROM ev GROUP BY 1, 2)) WHERE rank <= 10", EV)
def top_domains(s, d):
    c = events(s, d).groupBy("user_id", "k").agg(n().alias("n"))
    return c.withColumn("rank", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("n"), "k")).cast("long")).where("rank <= 10")


@query("SELECT day, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'purchase') AS purchases FROM ev GROUP BY day", EV)
def alerts_by_day(s, d):
    return events(s, d).groupBy("day").agg(n().alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("event_type") == "purchase").alias("purchases"))


@query("SELECT l_suppkey, count(*) AS edges FROM lineitem GROUP BY 1")
def edge_counts(s, d):
    return table(s, d, "lineitem").groupBy("l_suppkey").agg(n().alias("edges"))


@query("SELECT user_id, event_type, k, round(max(value), 4) AS best, max(t) AS newest, count(*) AS n FROM ev GROUP BY 1, 2, 3", EV)
def evidence_groups(s, d):
    return events(s, d).groupBy("user_id", "event_type", "k").agg(F.round(F.max("value"), 4).alias("best"), F.max("t").alias("newest"), n().alias("n"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT k) AS targets FROM ev WHERE day BETWEEN 19730 AND 19736 GROUP BY 1", EV)
def window_counts(s, d):
    return events(s, d).where("day BETWEEN 19730 AND 19736").groupBy("event_type").agg(n().alias("n"), F.countDistinct("k").alias("targets"))


@query("SELECT user_id, count(DISTINCT k) AS dests FROM ev WHERE day >= (SELECT max(day) FROM ev) - 6 AND k >= 10 GROUP BY 1", EV)
def distinct_dests(s, d):
    e = events(s, d)
    return e.join(F.broadcast(e.agg(F.max("day").alias("last")))).where("day >= last - 6 AND k >= 10").groupBy("user_id").agg(F.countDistinct("k").alias("dests"))


@query("SELECT user_id, cohort, n, round((sum(n) OVER w - n) / nullif(count(*) OVER w - 1, 0), 6) AS peers FROM (SELECT user_id, user_id % 5 AS cohort, count(*) AS n FROM ev GROUP BY 1) WINDOW w AS (PARTITION BY cohort)", EV)
def peer_deviation(s, d):
    c = events(s, d).groupBy("user_id").agg(n().alias("n")).withColumn("cohort", F.col("user_id") % 5)
    whole = c.groupBy("cohort").agg(F.sum("n").alias("all"), n().alias("members"))
    peers = F.when(F.col("members") > 1, (F.col("all") - F.col("n")) / (F.col("members") - 1))
    return c.join(whole, "cohort").select("user_id", "cohort", "n", F.round(peers, 6).alias("peers"))


@query("SELECT k, devices, days, devices >= 3 AND days >= 7 AS established, row_number() OVER (ORDER BY devices DESC, days DESC, k) AS rank FROM (SELECT k, count(DISTINCT user_id) AS devices, count(DISTINCT day) AS days FROM ev GROUP BY 1)", EV)
def popularity_rank(s, d):
    c = events(s, d).groupBy("k").agg(F.countDistinct("user_id").alias("devices"), F.countDistinct("day").alias("days"))
    c = windows.ranked(c, [F.desc("devices"), F.desc("days")], ["devices", "days"], F.asc("k"))
    return c.select("k", "devices", "days", ((F.col("devices") >= 3) & (F.col("days") >= 7)).alias("established"), "rank")


@query("SELECT user_id, k, count(DISTINCT day) AS days, count(DISTINCT day) >= 3 AS adopted FROM ev GROUP BY 1, 2", EV)
def novelty(s, d):
    return events(s, d).groupBy("user_id", "k").agg(F.countDistinct("day").alias("days")).withColumn("adopted", F.col("days") >= 3)


@query("SELECT user_id, round(greatest(least(1.0, count(*) / 50), least(1.0, count(DISTINCT k) / 40), least(1.0, count(DISTINCT day) / 20)), 6) AS familiarity FROM ev GROUP BY 1", EV)
def familiarity(s, d):
    one = F.lit(1.0)
    return events(s, d).groupBy("user_id").agg(F.round(F.greatest(F.least(one, n() / 50), F.least(one, F.countDistinct("k") / 40), F.least(one, F.countDistinct("day") / 20)), 6).alias("familiarity"))


@query("SELECT user_id, count(DISTINCT day) AS days, bit_count(bit_or(1::BIGINT << hour)) AS hours FROM ev GROUP BY 1", EV)
def active_hours(s, d):
    return events(s, d).groupBy("user_id").agg(F.countDistinct("day").alias("days"), F.bit_count(F.bit_or(F.expr("shiftleft(1L, int(hour))"))).cast("int").alias("hours"))


@query("SELECT user_id, day, families - greatest(0, sensor - 1) AS sources FROM (SELECT user_id, day, count(DISTINCT event_type) AS families, count(DISTINCT CASE WHEN event_type IN ('view', 'click') THEN event_type END) AS sensor FROM ev GROUP BY 1, 2)", EV)
def independent_families(s, d):
    g = events(s, d).groupBy("user_id", "day").agg(F.countDistinct("event_type").alias("f"), F.countDistinct(F.when(F.col("event_type").isin("view", "click"), F.col("event_type"))).alias("z"))
    return g.select("user_id", "day", (F.col("f") - F.greatest(F.lit(0), F.col("z") - 1)).alias("sources"))


@query("SELECT k, event_type AS feed, round(value, 4) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY value DESC, event_type DESC, event_id) AS r FROM ev) WHERE r = 1", EV)
def feed_merge(s, d):
    best = F.max_by(F.struct("event_type", "value"), F.struct("value", "event_type", -F.col("event_id")))
    return events(s, d).groupBy("k").agg(best.alias("b")).select("k", F.col("b.event_type").alias("feed"), F.round("b.value", 4).alias("confidence"))


@query("""SELECT cls, n, hits, round((p + 3.8416 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS lower
 FROM (SELECT k % 7 AS cls, count(*) AS n, count(*) FILTER (event_type <> 'error') AS hits, count(*) FILTER (event_type <> 'error') / count(*) AS p FROM ev GROUP BY 1)""", EV)
def wilson_gate(s, d):
    g = events(s, d).groupBy((F.col("k") % 7).alias("cls")).agg(n().alias("n"), F.count_if(F.col("event_type") != "error").alias("hits"))
    return g.select("cls", "n", "hits", F.round(S.wilson_lower(F.col("hits"), F.col("n")), 6).alias("lower"))


@query("SELECT round((count(*) FILTER (toxic = 1 AND quality = 0) / nullif(count(*) FILTER (toxic = 1), 0) + count(*) FILTER (toxic = 0 AND quality = 1) / nullif(count(*) FILTER (toxic = 0), 0)) / 2, 6) AS accuracy FROM labels")
def balanced_accuracy(s, d):
    a = table(s, d, "labels").agg(F.count_if(F.expr("toxic = 1 AND quality = 0")).alias("a"), F.count_if(F.expr("toxic = 1")).alias("b"), F.count_if(F.expr("toxic = 0 AND quality = 1")).alias("c"), F.count_if(F.expr("toxic = 0")).alias("e"))
    return a.select(F.round((F.expr("try_divide(a, b)") + F.expr("try_divide(c, e)")) / 2, 6).alias("accuracy"))


@query("SELECT cohort, hour, count(*) AS devices, round(avg(m), 6) AS mean, round(var_pop(m), 6) AS between_, round(avg(v), 6) AS within FROM (SELECT user_id, user_id % 5 AS cohort, hour, avg(value) AS m, var_pop(value) AS v FROM ev GROUP BY 1, 2, 3) GROUP BY 1, 2", EV)
def pool_gaussian(s, d):
    per = events(s, d).groupBy("user_id", (F.col("user_id") % 5).alias("cohort"), "hour").agg(F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    return per.groupBy("cohort", "hour").agg(n().alias("devices"), F.round(F.avg("m"), 6).alias("mean"), F.round(F.var_pop("m"), 6).alias("between_"), F.round(F.avg("v"), 6).alias("within"))


@query("SELECT user_id, n, CAST(floor((row_number() OVER (ORDER BY n, user_id) - 1) * 3 / count(*) OVER ()) AS BIGINT) AS tertile FROM (SELECT user_id, count(*) AS n FROM ev GROUP BY 1)", EV)
def cohort_tertiles(s, d):
    c = events(s, d).groupBy("user_id").agg(n().alias("n"))
    c = windows.ranked(c, [F.asc("n")], ["n"], F.asc("user_id"))
    return c.join(F.broadcast(c.agg(n().alias("all")))).select("user_id", "n", F.floor((F.col("rank") - 1) * 3 / F.col("all")).cast("long").alias("tertile"))  # one row


# --- windows


@query("SELECT event_id, user_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, event_id DESC) AS rank FROM ev) WHERE rank <= 15", EV)
def edges_capped(s, d):
    return windows.newest(events(s, d), "user_id", 15).select("event_id", "user_id", F.col("rank").cast("long").alias("rank"))


@query("SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY t DESC, event_id DESC) AS r FROM ev) WHERE r <= 40", EV)
def cap_per_type(s, d):
    return windows.newest(events(s, d), "event_type", 40).select("event_id", "event_type")


GAPS = "gaps AS (SELECT user_id, t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS gap FROM ev)"


@query("SELECT user_id, count(gap) AS gaps, round(avg(gap), 4) AS mean_gap, round(stddev_pop(gap) / avg(gap), 6) AS cv FROM gaps WHERE gap IS NOT NULL GROUP BY 1 HAVING count(gap) >= 5", EV, GAPS)
def beacon_jitter(s, d):
    return windows.inter_arrival(events(s, d), "user_id", 5)


@query("SELECT event_id, user_id, count(*) OVER w AS n, round(sum(value) OVER w, 4) AS total FROM (SELECT *, CAST(floor(t) AS BIGINT) AS s FROM ev) WINDOW w AS (PARTITION BY user_id ORDER BY s RANGE BETWEEN 604800 PRECEDING AND CURRENT ROW)", EV)
def sliding_counts(s, d):
    return windows.sliding(events(s, d), "user_id", 604800)


@query("SELECT user_id, CAST(floor(t / 60) AS BIGINT) AS minute, round(sum(value), 4) AS bytes FROM ev GROUP BY 1, 2", EV)
def minute_buckets(s, d):
    return events(s, d).groupBy("user_id", F.floor(F.col("t") / 60).cast("long").alias("minute")).agg(F.round(F.sum("value"), 4).alias("bytes"))


@query("SELECT user_id, session, count(*) AS n, min(t) AS first, max(t) AS last FROM (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) <= 86400 THEN 0 ELSE 1 END AS new FROM ev)) GROUP BY 1, 2", EV)
def incident_sessions(s, d):
    return windows.sessions(events(s, d), "user_id", 86400)


@query("SELECT a, b, n, round(n / sum(n) OVER (PARTITION BY a), 6) AS p, round(-ln((n + 0.5) / (sum(n) OVER (PARTITION BY a) + 2.5)), 6) AS surprise FROM (SELECT a, b, count(*) AS n FROM (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY t, event_id) AS a, event_type AS b FROM ev) WHERE a IS NOT NULL GROUP BY 1, 2)", EV)
def markov_probs(s, d):
    w = W.partitionBy("user_id").orderBy("t", "event_id")
    c = events(s, d).select(F.lag("event_type").over(w).alias("a"), F.col("event_type").alias("b")).where("a IS NOT NULL").groupBy("a", "b").agg(n().alias("n"))
    c = c.join(c.groupBy("a").agg(F.sum("n").alias("all")), "a")
    return c.select("a", "b", "n", F.round(F.col("n") / F.col("all"), 6).alias("p"), F.round(-F.log((F.col("n") + 0.5) / (F.col("all") + 2.5)), 6).alias("surprise"))


# --- sorts, sets, scalars


@query("SELECT event_id, user_id FROM ev ORDER BY t DESC, event_id DESC LIMIT 50", EV)
def recent_n(s, d):
    return events(s, d).orderBy(F.desc("t"), F.desc("event_id")).limit(50).select("event_id", "user_id")


@query("SELECT event_id, user_id FROM ev WHERE event_type = 'error' ORDER BY t DESC, event_id LIMIT 20 OFFSET 40", EV)
def paged(s, d):
    return events(s, d).where("event_type = 'error'").orderBy(F.desc("t"), "event_id").offset(40).limit(20).select("event_id", "user_id")


@query("SELECT user_id, k FROM ev WHERE event_type = 'view' UNION SELECT user_id, k FROM ev WHERE event_type = 'click' UNION SELECT user_id, k FROM ev WHERE event_type = 'error'", EV)
def pairs_union(s, d):
    e = events(s, d)
    return e.where("event_type IN ('view', 'click', 'error')").select("user_id", "k").distinct()


@query("SELECT user_id, k FROM ev WHERE event_type = 'view' EXCEPT SELECT user_id, k FROM ev WHERE event_type = 'click'", EV)
def set_except(s, d):
    e = events(s, d)
    return e.where("event_type = 'view'").select("user_id", "k").subtract(e.where("event_type = 'click'").select("user_id", "k"))


@query("SELECT user_id, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS jaccard FROM (SELECT user_id, list(DISTINCT k) FILTER (event_type = 'view') AS a, list(DISTINCT k) FILTER (event_type = 'click') AS b FROM ev WHERE k IS NOT NULL GROUP BY 1) WHERE len(a) > 0 AND len(b) > 0", EV)
def jaccard(s, d):
    g = events(s, d).groupBy("user_id").agg(F.collect_set(F.when(F.col("event_type") == "view", F.col("k"))).alias("a"), F.collect_set(F.when(F.col("event_type") == "click", F.col("k"))).alias("b"))
    return g.where("size(a) > 0 AND size(b) > 0").select("user_id", F.round(F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b")), 6).alias("jaccard"))


@query("SELECT user_id, k, arg_max(event_id, t * 1000000 + event_id) AS event_id FROM ev GROUP BY 1, 2", EV)
def merge_fresh(s, d):
    return events(s, d).groupBy("user_id", "k").agg(F.max_by("event_id", F.struct("t", "event_id")).alias("event_id"))


@query("SELECT event_id, round(sin(2 * pi() * m / 1440), 6) + 0 AS s, round(cos(2 * pi() * m / 1440), 6) + 0 AS c FROM (SELECT event_id, CAST(floor(t / 60) AS BIGINT) % 1440 AS m FROM ev)", EV)
def time_cyclic(s, d):
    import math

    a = (F.floor(F.col("t") / 60).cast("long") % 1440) * (2 * math.pi) / 1440
    return events(s, d).select("event_id", (F.round(F.sin(a), 6) + 0).alias("s"), (F.round(F.cos(a), 6) + 0).alias("c"))


@query("SELECT user_id, n, round((0.01 * 250 + n * m) / (0.01 + n), 6) AS mean, 1 + n / 2 AS alpha, round(1 + 0.5 * n * v + 0.01 * n * pow(m - 250, 2) / (2 * (0.01 + n)), 4) AS beta FROM (SELECT user_id, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM ev GROUP BY 1)", EV)
def nig_posterior(s, d):
    g = events(s, d).groupBy("user_id").agg(n().alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    c, m, v = F.col("n"), F.col("m"), F.col("v")
    return g.select("user_id", "n", F.round((2.5 + c * m) / (0.01 + c), 6).alias("mean"), (1 + c / 2).alias("alpha"), F.round(1 + 0.5 * c * v + 0.01 * c * F.pow(m - 250, F.lit(2)) / (2 * (0.01 + c)), 4).alias("beta"))


@query("SELECT user_id, 1.0 + e AS a, 1.0 + n - e AS b, round((1.0 + e) / (2.0 + n), 6) AS mean FROM (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS e FROM ev GROUP BY 1)", EV)
def beta_posterior(s, d):
    g = events(s, d).groupBy("user_id").agg(n().alias("n"), F.count_if(F.col("event_type") == "error").cast("double").alias("e"))
    return g.select("user_id", (F.lit(1.0) + F.col("e")).alias("a"), (F.lit(1.0) + F.col("n") - F.col("e")).alias("b"), F.round((1 + F.col("e")) / (2 + F.col("n")), 6).alias("mean"))


@query("SELECT event_id, k FROM ev WHERE k IS NOT NULL", EV)
def json_extract(s, d):
    return events(s, d).where("k IS NOT NULL").select("event_id", "k")


@query("SELECT event_id, user_id || '|' || k || '|' || regexp_replace(event_type, '(up|e)$', '') AS incident FROM ev WHERE k IS NOT NULL", EV)
def incident_key(s, d):
    return events(s, d).where("k IS NOT NULL").select("event_id", F.concat_ws("|", F.col("user_id").cast("string"), F.col("k").cast("string"), F.regexp_replace("event_type", "(up|e)$", "")).alias("incident"))


@query("SELECT b.vec_id, rank FROM (SELECT vec_id, row_number() OVER (ORDER BY round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 9) DESC, vec_id) AS rank FROM embeddings WHERE vec_id <> 0) b WHERE rank <= 20")
def vector_search(s, d):
    e = table(s, d, "embeddings")
    q = F.broadcast(e.where("vec_id = 0").select(F.col("embedding").alias("q")))  # one row
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)
    c = e.where("vec_id <> 0").join(q).select("vec_id", F.round(dot("embedding", "q") / F.sqrt(dot("embedding", "embedding") * dot("q", "q")), 9).alias("cosine"))
    top = c.orderBy(F.desc("cosine"), "vec_id").limit(20)
    return top.select("vec_id", F.row_number().over(W.orderBy(F.desc("cosine"), "vec_id")).cast("long").alias("rank"))


# --- detection and decision

ZED = """zed AS (SELECT *, CASE WHEN count(total) OVER b >= 3 THEN round(greatest(0.0, (total - avg(total) OVER b) / greatest(stddev_pop(total) OVER b, 1.0)), 6) ELSE 0.0 END AS z FROM daily
 WINDOW b AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
DET = """det AS (SELECT user_id, day, n, z, CASE WHEN n >= 4 THEN round(least(1.0, n / 8.0), 6) ELSE 0.0 END::DOUBLE AS c_rate, CASE WHEN error_ratio >= 0.5 AND n >= 2 THEN round(least(1.0, error_ratio), 6) ELSE 0.0 END::DOUBLE AS c_abuse,
 CASE WHEN targets >= 4 THEN round(least(1.0, 0.4 + 0.08 * targets), 6) ELSE 0.0 END::DOUBLE AS c_scan, CASE WHEN z >= 2.0 AND total >= 900 THEN round(least(1.0, 0.5 + z / 20), 6) ELSE 0.0 END::DOUBLE AS c_exfil FROM zed)"""
DEC = """src AS (SELECT *, CAST((CASE WHEN greatest(c_rate, c_scan) > 0 THEN 1 ELSE 0 END) + (CASE WHEN c_abuse > 0 THEN 1 ELSE 0 END) + (CASE WHEN c_exfil > 0 THEN 1 ELSE 0 END) AS BIGINT) AS sources, greatest(c_rate, c_abuse, c_scan, c_exfil) AS confidence FROM det),
 pth AS (SELECT *, CASE WHEN c_exfil >= 0.85 AND sources >= 2 THEN 'exfil_confirmed' WHEN sources >= 3 THEN 'independent_sources' WHEN sources >= 2 AND confidence >= 0.6 THEN 'two_sources' WHEN confidence >= 0.6 THEN 'single_strong' WHEN confidence > 0 THEN 'single_weak' ELSE 'quiet' END AS decision_path FROM src),
 dec AS (SELECT user_id, day, n, sources, confidence, CASE decision_path WHEN 'exfil_confirmed' THEN 'CRITICAL' WHEN 'independent_sources' THEN 'HIGH' WHEN 'two_sources' THEN 'SUSPICIOUS' WHEN 'quiet' THEN 'BENIGN' ELSE 'ANOMALOUS' END AS state, decision_path FROM pth)"""


def detections(s, d):
    return decide.detected(decide.with_surprise(decide.daily(events(s, d))))


@query("SELECT user_id, day, n, c_rate AS confidence FROM det WHERE c_rate > 0", EV, DAILY, ZED, DET)
def det_rate(s, d):
    return detections(s, d).where("c_rate > 0").select("user_id", "day", "n", F.col("c_rate").alias("confidence"))


@query("SELECT user_id, day, c_scan AS confidence FROM det WHERE c_scan > 0", EV, DAILY, ZED, DET)
def det_sweep(s, d):
    return detections(s, d).where("c_scan > 0").select("user_id", "day", F.col("c_scan").alias("confidence"))


@query("SELECT * FROM dec", EV, DAILY, ZED, DET, DEC)
def decide_states(s, d):
    return decide.decided(detections(s, d))


@query("SELECT decision_path, state, count(*) AS n FROM dec GROUP BY 1, 2", EV, DAILY, ZED, DET, DEC)
def decide_paths(s, d):
    return decide.decided(detections(s, d)).groupBy("decision_path", "state").agg(n().alias("n"))


@query("SELECT user_id, day, state, decision_path FROM (SELECT *, lag(state || decision_path) OVER (PARTITION BY user_id ORDER BY day) AS p FROM dec) WHERE p IS DISTINCT FROM state || decision_path", EV, DAILY, ZED, DET, DEC)
def state_changes(s, d):
    return decide.state_changes(decide.decided(detections(s, d))).select("user_id", "day", "state", "decision_path")


@query()
def beacon_fold(s, d):
    return check_ins(events(s, d))
