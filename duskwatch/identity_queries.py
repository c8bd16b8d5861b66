"""Queries of indicators, identity, campaigns, baselines and tuning, each beside the SQL that it must equal."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import graph
from .queries import EV, HO, n, query, when_n
from .sources.tables import events, hosts, table

# --- predicates and scalars


@query("SELECT event_id, CASE WHEN event_type = 'error' AND value >= 400 THEN 'deterministic' WHEN event_type = 'error' THEN 'strong' WHEN event_type = 'view' THEN 'weak' ELSE 'medium' END AS tier FROM events")
def notice_tier(s, d):
    t = F.col("event_type")
    tier = F.when((t == "error") & (F.col("value") >= 400), "deterministic").when(t == "error", "strong").when(t == "view", "weak").otherwise("medium")
    return table(s, d, "events").select("event_id", tier.alias("tier"))


@query("SELECT c_custkey, substr(md5(c_custkey::VARCHAR), 1, 12) AS mac, (('0x' || substr(md5(c_custkey::VARCHAR), 1, 2))::BIGINT & 2) <> 0 AS local FROM customer")
def mac_bits(s, d):
    mac = F.substring(F.md5(F.col("c_custkey").cast("string")), 1, 12)
    return table(s, d, "customer").select("c_custkey", mac.alias("mac"), S.locally_administered(mac).alias("local"))


@query("SELECT event_id, value / 490 >= 0.5 AND event_type <> 'view' AS strong FROM events")
def intel_strength(s, d):
    return table(s, d, "events").select("event_id", ((F.col("value") / 490 >= 0.5) & (F.col("event_type") != "view")).alias("strong"))


@query("SELECT event_id, k, CASE WHEN k < 5 THEN 'multicast' WHEN k < 8 THEN 'loopback' WHEN k < 30 THEN 'private' WHEN k < 40 THEN 'telemetry' WHEN k < 60 THEN 'cdn' ELSE 'public' END AS class FROM ev WHERE k IS NOT NULL", EV)
def dest_class(s, d):
    k = F.col("k")
    c = F.when(k < 5, "multicast").when(k < 8, "loopback").when(k < 30, "private").when(k < 40, "telemetry").when(k < 60, "cdn").otherwise("public")
    return events(s, d).where("k IS NOT NULL").select("event_id", "k", c.alias("class"))


@query("SELECT k, n, errors, CASE WHEN errors * 2 > n THEN 0 WHEN errors * 3 > n THEN 1 WHEN devices < 2 THEN 2 WHEN devices < 10 THEN 3 WHEN days < 7 THEN 4 ELSE 5 END AS tier FROM (SELECT k, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, count(DISTINCT user_id) AS devices, count(DISTINCT day) AS days FROM ev GROUP BY k)", EV)
def reputation_tier(s, d):
    """The floor (tiers 0 to 2) is decided before anything that speaks for a destination."""
    g = events(s, d).groupBy("k").agg(n().alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.countDistinct("user_id").alias("devices"), F.countDistinct("day").alias("days"))
    e, m = F.col("errors"), F.col("n")
    tier = F.when(e * 2 > m, 0).when(e * 3 > m, 1).when(F.col("devices") < 2, 2).when(F.col("devices") < 10, 3).when(F.col("days") < 7, 4).otherwise(5)
    return g.select("k", "n", "errors", tier.alias("tier"))


@query(r"""SELECT DISTINCT host, length(label) >= 12 AND vowels / length(label) < 0.3 OR length(label) BETWEEN 6 AND 11 AND vowels / length(label) < 0.2 AS algorithmic
 FROM (SELECT host, string_split(host, '.')[1] AS label, length(regexp_replace(string_split(host, '.')[1], '[^aeiou]', '', 'g')) AS vowels FROM ho WHERE host <> '')""", HO)
def dga_flag(s, d):
    label = F.substring_index("host", ".", 1)
    size, share = F.length(label), S.share_of(label, "[aeiou]")
    return hosts(s, d).where("host <> ''").select("host").distinct().select("host", (((size >= 12) & (share < 0.3)) | (size.between(6, 11) & (share < 0.2))).alias("algorithmic"))


@query("SELECT DISTINCT host, array_to_string(string_split(host, '.')[-2:], '.') AS registered FROM ho", HO)
def etld1(s, d):
    """The last two labels; a table of public suffixes would refine it."""
    return hosts(s, d).select("host").distinct().select("host", S.base_domain(F.col("host")).alias("registered"))


@query("SELECT user_id, n, n_err, round((1.0 + n_err) / (1.0 + days), 6) AS rate FROM (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS n_err, count(DISTINCT day) AS days FROM ev GROUP BY 1)", EV)
def gamma_posterior(s, d):
    """Mean of a Gamma(1, 1) prior's posterior for errors a day."""
    g = events(s, d).groupBy("user_id").agg(n().alias("n"), F.count_if(F.col("event_type") == "error").alias("n_err"), F.countDistinct("day").alias("days"))
    return g.select("user_id", "n", "n_err", F.round((F.lit(1.0) + F.col("n_err")) / (F.lit(1.0) + F.col("days")), 6).alias("rate"))


@query("SELECT doc_id, round(CASE WHEN quality IS NULL THEN 0.5 ELSE 0.45 * quality + 0.55 * (1 - toxic) END, 6)::DOUBLE AS score FROM documents LEFT JOIN labels USING (doc_id)")
def score_blend(s, d):
    both = table(s, d, "documents").select("doc_id").join(table(s, d, "labels"), "doc_id", "left")
    return both.select("doc_id", F.round(F.when(F.col("quality").isNull(), 0.5).otherwise(0.45 * F.col("quality") + 0.55 * (1 - F.col("toxic"))), 6).alias("score"))


@query("SELECT user_id, k, round(greatest(0.0, 1.0 - 0.05 * (19753 - max(day))), 6) AS trust FROM ev GROUP BY 1, 2", EV)
def trust_decay(s, d):
    return events(s, d).groupBy("user_id", "k").agg(F.round(F.greatest(F.lit(0.0), F.lit(1.0) - 0.05 * (F.lit(19753) - F.max("day"))), 6).alias("trust"))


# --- indicators

INDICATORS = "SELECT host AS name, min(page_id) AS feed FROM ho WHERE page_id % 10 = 0 AND host <> '' GROUP BY host"
PARENTS = """par AS (SELECT DISTINCT host, array_to_string(string_split(host, '.')[i:], '.') AS parent, i FROM (SELECT DISTINCT host FROM ho) h, range(1, 20) r(i) WHERE i < len(string_split(host, '.')))"""


@query(f"SELECT host, arg_min(parent, i) AS indicator, min(i) > 1 AS matched_parent FROM par JOIN (SELECT DISTINCT array_to_string(string_split(name, '.')[-2:], '.') AS name FROM ({INDICATORS}) WHERE feed % 20 = 0 UNION SELECT name FROM ({INDICATORS})) v ON parent = v.name GROUP BY host", HO, PARENTS)
def ioc_domain(s, d):
    """Each host with its nearest listed name: itself or a parent of two labels or more."""
    h = hosts(s, d)
    some = h.where("page_id % 10 = 0 AND host <> ''").groupBy("host").agg(F.min("page_id").alias("feed"))
    listed = some.where("feed % 20 = 0").select(S.base_domain(F.col("host")).alias("parent")).union(some.select("host")).distinct()
    labels = F.split("host", r"\.")
    last = F.size(labels) - 1
    steps = F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    parents = F.transform(steps, lambda i: F.struct(F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("parent"), i.alias("i")))
    names = h.select("host").distinct().select("host", F.inline(parents))
    hit = names.join(listed, "parent").groupBy("host").agg(F.min_by("parent", "i").alias("indicator"), F.min("i").alias("i"))
    return hit.select("host", "indicator", (F.col("i") > 1).alias("matched_parent"))


@query("SELECT p.page_id, i.page_id AS indicator FROM (SELECT page_id, host || regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) AS u FROM ho) p JOIN (SELECT min(page_id) AS page_id, host || regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) AS u FROM ho WHERE page_id % 7 = 0 GROUP BY u) i USING (u)", HO)
def ioc_url(s, d):
    u = F.concat("host", F.regexp_extract("url", r"^[a-z]+://[^/]+(/[^?#]*)", 1))
    pages = hosts(s, d).select("page_id", u.alias("u"))
    listed = pages.where("page_id % 7 = 0").groupBy("u").agg(F.min("page_id").alias("indicator"))
    return pages.join(listed, "u").select("page_id", "indicator")


CIDRS = [(32, 17, "exact"), (30, 16, "narrow"), (28, 16, "wide"), (26, 64, "widest")]


@query(f"SELECT k, arg_max(note, bits) AS note, max(bits) AS bits FROM (SELECT DISTINCT k FROM ev WHERE k IS NOT NULL) e JOIN (VALUES {', '.join(map(str, CIDRS))}) v(bits, net, note) ON k BETWEEN net AND net + (1 << (32 - bits)) - 1 GROUP BY k", EV)
def ioc_cidr(s, d):
    """Networks by prefix length: one equality join for each length in use, the longest match wins."""
    nets = s.createDataFrame(CIDRS, "bits int, net int, note string")
    keys = events(s, d).where("k IS NOT NULL").select("k").distinct()
    lengths = F.array(*[F.lit(b) for b in sorted({b for b, _, _ in CIDRS})])
    at = keys.select("k", F.explode(lengths).alias("bits")).withColumn("net", F.expr("shiftleft(shiftright(k, 32 - bits), 32 - bits)"))
    hit = at.join(F.broadcast(nets), ["bits", "net"])  # as large as CIDRS
    return hit.groupBy("k").agg(F.max_by("note", "bits").alias("note"), F.max("bits").alias("bits"))


@query("SELECT DISTINCT a.user_id, a.k FROM ev a JOIN (SELECT k FROM ev WHERE event_type = 'error' GROUP BY k HAVING max(value) > 485) c ON a.k = c.k WHERE NOT EXISTS (SELECT 1 FROM ev b WHERE b.user_id = a.user_id AND b.k = a.k AND b.event_type = 'purchase')", EV)
def retro_hunt(s, d):
    """Devices that touched a destination confirmed later, less the pairs already reported."""
    e = events(s, d)
    bad = e.where("event_type = 'error'").groupBy("k").agg(F.max("value").alias("m")).where("m > 485").select("k")
    told = e.where("event_type = 'purchase'").select("user_id", "k").distinct()
    return e.select("user_id", "k").distinct().join(bad, "k", "left_semi").join(told, ["user_id", "k"], "left_anti").select("user_id", "k")


@query("SELECT DISTINCT a.user_id, a.k FROM ev a JOIN (SELECT DISTINCT k FROM ev WHERE event_type = 'error' AND value > 470) c ON a.k = c.k WHERE a.event_type = 'click' AND NOT EXISTS (SELECT 1 FROM ev b WHERE b.event_type = 'error' AND b.value > 470 AND b.user_id = a.user_id AND b.k = a.k)", EV)
def confirmed_match(s, d):
    e = events(s, d)
    found = e.where("event_type = 'error' AND value > 470").select("user_id", "k").distinct()
    other = e.where("event_type = 'click'").select("user_id", "k").distinct().join(found.select("k").distinct(), "k", "left_semi")
    return other.join(found, ["user_id", "k"], "left_anti").select("user_id", "k")


@query("SELECT event_id FROM ev WHERE k NOT IN (SELECT k FROM ev WHERE event_type = 'purchase' AND k IS NOT NULL AND value > 450)", EV)
def prune_orphans(s, d):
    e = events(s, d)
    return e.where("k IS NOT NULL").join(e.where("event_type = 'purchase' AND value > 450").select("k").distinct(), "k", "left_anti").select("event_id")


# --- campaigns and graph


@query("SELECT k, event_type, count(DISTINCT user_id) AS devices FROM ev WHERE k IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT user_id) >= 3", EV)
def fingerprint_campaign(s, d):
    return events(s, d).where("k IS NOT NULL").groupBy("k", "event_type").agg(F.countDistinct("user_id").alias("devices")).where("devices >= 3")


@query(r"""SELECT shape, count(DISTINCT host) AS hosts FROM (SELECT host, length(string_split(host, '.')[1]) || ':' || string_split(host, '.')[-1] AS shape FROM ho) GROUP BY shape HAVING count(DISTINCT host) >= 2""", HO)
def shape_campaign(s, d):
    shape = F.concat_ws(":", F.length(F.substring_index("host", ".", 1)).cast("string"), F.substring_index("host", ".", -1))
    return hosts(s, d).groupBy(shape.alias("shape")).agg(F.countDistinct("host").alias("hosts")).where("hosts >= 2")


@query("SELECT c.c_custkey, count(DISTINCT l.l_suppkey) AS suppliers, count(*) AS edges FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY 1")
def graph_expand(s, d):
    o = table(s, d, "orders").select("o_custkey", "o_orderkey")
    edges = o.join(table(s, d, "lineitem").select("l_orderkey", "l_suppkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    known = edges.join(table(s, d, "customer").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    return known.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.countDistinct("l_suppkey").alias("suppliers"), n().alias("edges"))


REDIRECTS = "red AS (SELECT c_custkey AS id, c_custkey - 1 - c_custkey % 3 AS into_ FROM customer WHERE c_custkey % 4 <> 0 AND c_custkey - 1 - c_custkey % 3 > 0)"


@query("SELECT id, arg_max(place, depth) AS canonical FROM walk GROUP BY id", "RECURSIVE " + REDIRECTS, "walk AS (SELECT id, into_ AS place, 1 AS depth FROM red UNION ALL SELECT w.id, r.into_, depth + 1 FROM walk w JOIN red r ON w.place = r.id)")
def canonical_ids(s, d):
    c = F.col("c_custkey")
    red = table(s, d, "customer").where("c_custkey % 4 <> 0").select(c.alias("id"), (c - 1 - c % 3).alias("into")).where("into > 0")
    return graph.canonical(red, "id", "into").select("id", "canonical")


# --- features and statistics


@query("""SELECT user_id, round(count(*) FILTER (event_type IN ('signup', 'error')) / count(*), 6) AS txt FROM ev GROUP BY 1""", EV)
def txt_ratio(s, d):
    return events(s, d).groupBy("user_id").agg(F.round(when_n(F.col("event_type").isin("signup", "error")) / n(), 6).alias("txt"))


@query("SELECT k, nx, round(top / nx, 6) AS share FROM (SELECT k, sum(c)::BIGINT AS nx, max(c) AS top FROM (SELECT k, user_id % 7 AS tld, count(*) AS c FROM ev WHERE event_type = 'error' GROUP BY 1, 2) GROUP BY k) WHERE nx >= 5", EV)
def nx_tld_concentration(s, d):
    c = events(s, d).where("event_type = 'error'").groupBy("k", (F.col("user_id") % 7).alias("tld")).agg(n().alias("c"))
    return c.groupBy("k").agg(F.sum("c").alias("nx"), F.max("c").alias("top")).where("nx >= 5").select("k", "nx", F.round(F.col("top") / F.col("nx"), 6).alias("share"))


@query("SELECT base, n, hosts, round(hosts / n, 6) AS ratio FROM (SELECT array_to_string(string_split(host, '.')[-2:], '.') AS base, count(*) AS n, count(DISTINCT host) AS hosts FROM ho GROUP BY 1) WHERE n >= 3", HO)
def unique_subdomain_ratio(s, d):
    g = hosts(s, d).groupBy(S.base_domain(F.col("host")).alias("base")).agg(n().alias("n"), F.countDistinct("host").alias("hosts")).where("n >= 3")
    return g.select("base", "n", "hosts", F.round(F.col("hosts") / F.col("n"), 6).alias("ratio"))


@query("SELECT user_id, arg_max(event_type, t * 1000000 + event_id) AS event_type, arg_max(k, t * 1000000 + event_id) AS k FROM ev WHERE k IS NOT NULL GROUP BY 1", EV)
def latest_meta(s, d):
    g = events(s, d).where("k IS NOT NULL").groupBy("user_id").agg(F.max_by(F.struct("event_type", "k"), F.struct("t", "event_id")).alias("m"))
    return g.select("user_id", "m.event_type", "m.k")


@query("SELECT user_id, day, round(avg(m), 6) AS weight FROM (SELECT user_id, day, event_type, max(value) / 490 AS m FROM ev GROUP BY 1, 2, 3) WHERE m >= 0.3 GROUP BY 1, 2", EV)
def hypothesis_weight(s, d):
    m = events(s, d).groupBy("user_id", "day", "event_type").agg((F.max("value") / 490).alias("m")).where("m >= 0.3")
    return m.groupBy("user_id", "day").agg(F.round(F.avg("m"), 6).alias("weight"))


@query("SELECT user_id, day, least(4.0, round(max(value) / 100, 6))::DOUBLE AS risk, arg_max(event_type, value * 1000 - event_id / 1000000) AS source FROM ev GROUP BY 1, 2", EV)
def risk_max(s, d):
    g = events(s, d).groupBy("user_id", "day").agg(F.least(F.lit(4.0), F.round(F.max("value") / 100, 6)).alias("risk"), F.max_by("event_type", F.col("value") * 1000 - F.col("event_id") / 1000000).alias("source"))
    return g.select("user_id", "day", "risk", "source")


@query("SELECT cohort, hour, count(*) AS devices, round(avg(1.0 + e), 6) AS a, round(avg(1.0 + n - e), 6) AS b, round(avg((1.0 + e) / (2.0 + n)), 6) AS mean FROM (SELECT user_id % 5 AS cohort, hour, user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS e FROM ev GROUP BY 1, 2, 3) GROUP BY 1, 2", EV)
def pool_beta(s, d):
    p = events(s, d).groupBy("user_id", (F.col("user_id") % 5).alias("cohort"), "hour").agg(n().alias("n"), F.count_if(F.col("event_type") == "error").alias("e"))
    a, b = F.lit(1.0) + F.col("e"), F.lit(1.0) + F.col("n") - F.col("e")
    return p.groupBy("cohort", "hour").agg(n().alias("devices"), F.round(F.avg(a), 6).alias("a"), F.round(F.avg(b), 6).alias("b"), F.round(F.avg(a / (a + b)), 6).alias("mean"))


@query("SELECT cohort, count(*) AS devices, round(avg((1.0 + n) / (1.0 + days)), 6) AS rate FROM (SELECT user_id % 5 AS cohort, user_id, count(*) AS n, count(DISTINCT day) AS days FROM ev GROUP BY 1, 2) GROUP BY 1", EV)
def pool_poisson(s, d):
    p = events(s, d).groupBy("user_id", (F.col("user_id") % 5).alias("cohort")).agg(n().alias("n"), F.countDistinct("day").alias("days"))
    return p.groupBy("cohort").agg(n().alias("devices"), F.round(F.avg((F.lit(1.0) + F.col("n")) / (F.lit(1.0) + F.col("days"))), 6).alias("rate"))


@query("SELECT user_id, count(*) FILTER (best >= 300) AS qualifying, count(*) AS families FROM (SELECT user_id, event_type, max(value * pow(0.95, 19753 - day)) AS best FROM ev GROUP BY 1, 2) GROUP BY 1 HAVING count(*) FILTER (best >= 300) >= 2", EV)
def trust_patterns(s, d):
    f = events(s, d).groupBy("user_id", "event_type").agg(F.max(F.col("value") * F.pow(F.lit(0.95), F.lit(19753) - F.col("day"))).alias("best"))
    return f.groupBy("user_id").agg(F.count_if(F.col("best") >= 300).alias("qualifying"), n().alias("families")).where("qualifying >= 2")


@query("SELECT day, n, round(sum(n) OVER (ORDER BY day DESC) / sum(n) OVER (), 6) AS held, sum(n) OVER (ORDER BY day DESC) <= 0.5 * sum(n) OVER () AS kept FROM (SELECT day, count(*) AS n FROM ev GROUP BY day)", EV)
def retention_cutoff(s, d):
    """Newest days that fit into half of all rows. The ordered window has one row for each day."""
    c = events(s, d).groupBy("day").agg(n().alias("n"))
    c = c.join(F.broadcast(c.agg(F.sum("n").alias("all")))).withColumn("held", F.sum("n").over(W.orderBy(F.desc("day"))))
    return c.select("day", "n", F.round(F.col("held") / F.col("all"), 6).alias("held"), (F.col("held") <= 0.5 * F.col("all")).alias("kept"))


@query("SELECT day, count(*) AS n, day < (SELECT max(day) FROM ev) - 13 AS archived FROM ev GROUP BY day", EV)
def archive_split(s, d):
    c = events(s, d).groupBy("day").agg(n().alias("n"))
    return c.join(F.broadcast(c.agg(F.max("day").alias("last")))).select("day", "n", (F.col("day") < F.col("last") - 13).alias("archived"))


@query("SELECT event_type, day, count(*) AS n, count(DISTINCT user_id) AS devices, round(avg(value), 6) AS mean FROM ev GROUP BY 1, 2", EV)
def export_summary(s, d):
    return events(s, d).groupBy("event_type", "day").agg(n().alias("n"), F.countDistinct("user_id").alias("devices"), F.round(F.avg("value"), 6).alias("mean"))


@query("SELECT k, event_id FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t DESC, event_id DESC) AS r FROM ev WHERE k IS NOT NULL) WHERE r > 20", EV)
def lru_prune(s, d):
    """What a cap of twenty newest rows for each destination would remove."""
    w = W.partitionBy("k").orderBy(F.desc("t"), F.desc("event_id"))
    return events(s, d).where("k IS NOT NULL").withColumn("r", F.row_number().over(w)).where("r > 20").select("k", "event_id")


# --- order and sequence


@query("SELECT user_id, island, min(t) AS first, max(t) AS last, count(*) AS n FROM (SELECT *, CAST(sum(c) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY t, event_id) IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS c FROM ev)) GROUP BY 1, 2 HAVING max(t) - min(t) >= 600", EV)
def persistence_islands(s, d):
    w = W.partitionBy("user_id").orderBy("t", "event_id")
    e = events(s, d).withColumn("c", F.when(F.lag("event_type").over(w).eqNullSafe(F.col("event_type")), 0).otherwise(1))
    e = e.withColumn("island", F.sum("c").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return e.groupBy("user_id", "island").agg(F.min("t").alias("first"), F.max("t").alias("last"), n().alias("n")).where("last - first >= 600")


@query("SELECT user_id, max(t) FILTER (event_type = 'error') AS incident, min(t) FILTER (t > e) AS after FROM (SELECT *, max(CASE WHEN event_type = 'error' THEN t END) OVER (PARTITION BY user_id) AS e FROM ev) GROUP BY user_id", EV)
def incident_status(s, d):
    """A device's last incident and the first row after it: two grouped passes, no window over all rows of a device."""
    e = events(s, d).select("user_id", "event_type", "t")
    last = e.groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "error", F.col("t"))).alias("incident"))
    return e.join(last, "user_id").groupBy("user_id", "incident").agg(F.min(F.when(F.col("t") > F.col("incident"), F.col("t"))).alias("after"))


@query("SELECT user_id, bool_and(v > p) AS rising, count(*) AS steps FROM (SELECT user_id, v, lag(v) OVER (PARTITION BY user_id ORDER BY day) AS p FROM (SELECT user_id, day, max(value) AS v FROM ev WHERE event_type = 'purchase' GROUP BY 1, 2)) WHERE p IS NOT NULL GROUP BY 1 HAVING count(*) >= 2", EV)
def monotone_drift(s, d):
    v = events(s, d).where("event_type = 'purchase'").groupBy("user_id", "day").agg(F.max("value").alias("v"))
    v = v.withColumn("p", F.lag("v").over(W.partitionBy("user_id").orderBy("day"))).where("p IS NOT NULL")
    return v.groupBy("user_id").agg(F.bool_and(F.col("v") > F.col("p")).alias("rising"), n().alias("steps")).where("steps >= 2")


@query("""SELECT u.user_id, coalesce(a.v, b.v, 250.0) AS threshold, CASE WHEN a.v IS NOT NULL THEN 'device' WHEN b.v IS NOT NULL THEN 'type' ELSE 'default' END AS scope FROM (SELECT DISTINCT user_id FROM ev) u
 LEFT JOIN (SELECT user_id, arg_max(value, t * 1000000 + event_id) AS v FROM ev WHERE event_type = 'signup' AND value > 450 GROUP BY 1) a ON a.user_id = u.user_id
 LEFT JOIN (SELECT user_id % 50 AS type, arg_max(value, t * 1000000 + event_id) AS v FROM ev WHERE event_type = 'purchase' AND value > 485 GROUP BY 1) b ON b.type = u.user_id % 50""", EV)
def scoped_value(s, d):
    """The newest promoted value of a device, else of its type, else the default."""
    e, at = events(s, d), F.struct("t", "event_id")
    own = e.where("event_type = 'signup' AND value > 450").groupBy("user_id").agg(F.max_by("value", at).alias("a"))
    of_type = e.where("event_type = 'purchase' AND value > 485").groupBy((F.col("user_id") % 50).alias("type")).agg(F.max_by("value", at).alias("b"))
    u = e.select("user_id").distinct().withColumn("type", F.col("user_id") % 50).join(own, "user_id", "left").join(of_type, "type", "left")
    scope = F.when(F.col("a").isNotNull(), "device").when(F.col("b").isNotNull(), "type").otherwise("default")
    return u.select("user_id", F.coalesce("a", "b", F.lit(250.0)).alias("threshold"), scope.alias("scope"))


@query("SELECT user_id, hour, arg_max(value, t * 1000000 + event_id) AS value, max(day) AS regime FROM ev GROUP BY 1, 2", EV)
def latest_regime(s, d):
    return events(s, d).groupBy("user_id", "hour").agg(F.max_by("value", F.struct("t", "event_id")).alias("value"), F.max("day").alias("regime"))


@query("SELECT user_id, day, phase, coalesce(lag(phase) OVER (PARTITION BY user_id ORDER BY day), 'NORMAL') AS before FROM (SELECT user_id, day, CASE WHEN sum(value) >= 1200 THEN 'EXFIL' WHEN count(*) FILTER (event_type = 'error') >= 2 THEN 'C2' WHEN count(DISTINCT k) >= 4 THEN 'LATERAL' WHEN count(*) >= 3 THEN 'RECON' ELSE 'NORMAL' END AS phase FROM ev GROUP BY 1, 2)", EV)
def killchain(s, d):
    c = F.when(F.sum("value") >= 1200, "EXFIL").when(F.count_if(F.col("event_type") == "error") >= 2, "C2").when(F.countDistinct("k") >= 4, "LATERAL").when(n() >= 3, "RECON").otherwise("NORMAL")
    g = events(s, d).groupBy("user_id", "day").agg(c.alias("phase"))
    return g.withColumn("before", F.coalesce(F.lag("phase").over(W.partitionBy("user_id").orderBy("day")), F.lit("NORMAL")))


@query("SELECT event_id FROM ev a WHERE NOT EXISTS (SELECT 1 FROM ev b WHERE b.user_id = a.user_id AND b.event_type = 'error' AND b.value >= 400 AND a.t BETWEEN b.t AND b.t + 86400)", EV)
def learning_pause(s, d):
    """Rows that may be learned from: none within a day after a serious error of their device. The newest such error decides."""
    w = W.partitionBy("user_id").orderBy("t").rangeBetween(W.unboundedPreceding, 0)
    e = events(s, d).withColumn("paused", F.max(F.when((F.col("event_type") == "error") & (F.col("value") >= 400), F.col("t"))).over(w))
    return e.where("paused IS NULL OR t - paused > 86400").select("event_id")


@query("SELECT user_id, count(DISTINCT day) AS days, count(DISTINCT day * 24 + hour) AS hours, count(DISTINCT day) >= 7 AND count(DISTINCT day * 24 + hour) >= 24 AS learned FROM ev GROUP BY 1", EV)
def learning_gate(s, d):
    g = events(s, d).groupBy("user_id").agg(F.countDistinct("day").alias("days"), F.countDistinct(F.col("day") * 24 + F.col("hour")).alias("hours"))
    return g.withColumn("learned", (F.col("days") >= 7) & (F.col("hours") >= 24))


@query("SELECT k, user_id, min(t) AS first FROM ev WHERE k IS NOT NULL GROUP BY 1, 2 HAVING min(t) > (SELECT min(t) FROM ev) + 259200", EV)
def first_source(s, d):
    e = events(s, d)
    pairs = e.where("k IS NOT NULL").groupBy("k", "user_id").agg(F.min("t").alias("first"))
    return pairs.join(F.broadcast(e.agg(F.min("t").alias("begin")))).where("first > begin + 259200").select("k", "user_id", "first")


@query("SELECT user_id, n, unexplained, round(unexplained / n, 6) AS ratio, least(1.0, round(0.3 + 0.4 * unexplained / n, 6))::DOUBLE AS confidence FROM (SELECT user_id, count(*) AS n, count(*) FILTER (NOT EXISTS (SELECT 1 FROM ev b WHERE b.event_type = 'view' AND b.user_id = c.user_id AND b.k = c.k)) AS unexplained FROM (SELECT DISTINCT user_id, k FROM ev WHERE event_type <> 'view' AND k IS NOT NULL) c GROUP BY 1) WHERE unexplained >= 2", EV)
def dns_evasion(s, d):
    """Destinations contacted without a lookup that explains them."""
    e = events(s, d).where("k IS NOT NULL")
    g = e.groupBy("user_id", "k").agg(F.bool_or(F.col("event_type") == "view").alias("known"), F.bool_or(F.col("event_type") != "view").alias("contacted")).where("contacted")
    g = g.groupBy("user_id").agg(n().alias("n"), F.count_if(~F.col("known")).alias("unexplained")).where("unexplained >= 2")
    r = F.col("unexplained") / F.col("n")
    return g.select("user_id", "n", "unexplained", F.round(r, 6).alias("ratio"), F.least(F.lit(1.0), F.round(0.3 + 0.4 * r, 6)).alias("confidence"))


@query("SELECT k, day, user_id, flips FROM (SELECT k, day, user_id, count(*) OVER (PARTITION BY k ORDER BY day RANGE BETWEEN 3 PRECEDING AND CURRENT ROW) AS flips FROM (SELECT k, user_id, min(day) AS day FROM ev WHERE k IS NOT NULL GROUP BY 1, 2)) WHERE flips >= 2", EV)
def mac_flips(s, d):
    """Holders new to an address within four days of each other."""
    new = events(s, d).where("k IS NOT NULL").groupBy("k", "user_id").agg(F.min("day").alias("day"))
    w = W.partitionBy("k").orderBy("day").rangeBetween(-3, 0)
    return new.withColumn("flips", n().over(w)).where("flips >= 2").select("k", "day", "user_id", "flips")
