"""Queries of what happens to identities, parameters and stored rows over time, each beside the SQL that it must equal."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from .cycle_oracle import decision_sql
from .cycle_queries import DEC, decisions, evidence
from .operators import identity
from .operators.stored import shared_dir, written
from .plans import cycles, explain, retention, synthetic, tuning
from .queries import EV, HO, query
from .sources import feeds, ranges
from .sources.tables import epoch, events, hosts, table

# --- identities merged and split

#: Identities: a customer's orders give its times, counters by status and addresses with the time each was first seen.
PROFILES = """pro AS (SELECT c_custkey AS id, coalesce(min(epoch_us(o_orderdate) / 1e6), 0) AS first_seen, coalesce(max(epoch_us(o_orderdate) / 1e6), 0) AS last_seen,
   CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'mac-' || (c_custkey * 7 % 1301) END AS mac, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE 'host-' || (c_custkey * 11 % 907) END AS host, c_mktsegment AS kind
   FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_mktsegment),
 cnt AS (SELECT o_custkey AS id, o_orderstatus AS name, count(*) AS n FROM orders GROUP BY 1, 2),
 adr AS (SELECT o_custkey AS id, 'a' || (o_orderkey % 40) AS address, min(epoch_us(o_orderdate) / 1e6) AS since FROM orders GROUP BY 1, 2),
 grp AS (SELECT id, min(id) OVER (PARTITION BY c_nationkey, c_custkey % 20) AS canonical FROM pro JOIN customer ON c_custkey = id)"""
#: Profiles of the groups in ``g`` (id, canonical), lists as text.
UNITED = f"""SELECT canonical AS id, min(first_seen) AS first_seen, max(last_seen) AS last_seen, arg_min(mac, (first_seen, id)) FILTER (mac <> '') AS mac, arg_min(host, (first_seen, id)) FILTER (host <> '') AS host,
 arg_max(kind, (last_seen, -id)) AS kind, coalesce((SELECT string_agg(name || '=' || n, ';' ORDER BY name) FROM (SELECT name, sum(n) AS n FROM cnt JOIN g x USING (id) WHERE x.canonical = g.canonical GROUP BY name)), '') AS counters,
 coalesce((SELECT string_agg(address, ',' ORDER BY since DESC, address) FROM (SELECT address, min(since) AS since FROM adr JOIN g x USING (id) WHERE x.canonical = g.canonical GROUP BY address ORDER BY since DESC, address LIMIT {identity.MOST_ADDRESSES})), '') AS addresses
 FROM g JOIN pro USING (id) GROUP BY canonical"""


def profiles(s, d):
    at = epoch("o_orderdate")
    c, o = table(s, d, "customer"), table(s, d, "orders")
    times = o.groupBy("o_custkey").agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"))
    counted = o.groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("n")).groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderstatus", "n"))).alias("counters"))
    seen = o.groupBy("o_custkey", F.concat(F.lit("a"), (F.col("o_orderkey") % 40).cast("string")).alias("address")).agg(F.min(at).alias("since"))
    seen = seen.groupBy("o_custkey").agg(F.collect_list(F.struct("since", "address")).alias("addresses"))
    rows = c.withColumnRenamed("c_custkey", "o_custkey").join(times, "o_custkey", "left").join(counted, "o_custkey", "left").join(seen, "o_custkey", "left")
    k = F.col("o_custkey")
    mac = F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("mac-"), (k * 7 % 1301).cast("string")))
    host = F.when(k % 6 != 0, F.concat(F.lit("host-"), (k * 11 % 907).cast("string")))
    zero = F.lit(0.0)
    return rows.select(k.alias("id"), F.coalesce("first_seen", zero).alias("first_seen"), F.coalesce("last_seen", zero).alias("last_seen"), mac.alias("mac"), host.alias("host"), F.col("c_mktsegment").alias("kind"), "counters", "addresses")


def groups(s, d):
    c = table(s, d, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey", (F.col("c_custkey") % 20).alias("part"))
    return c.join(c.groupBy("c_nationkey", "part").agg(F.min("id").alias("canonical")), ["c_nationkey", "part"]).select("id", "canonical")


def as_text(rows):
    """Profiles with counters and addresses as text."""
    counters = F.array_join(F.transform(F.array_sort(F.map_entries("counters")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";")
    addresses = F.array_join(F.transform("addresses", lambda a: a["address"]), ",")
    return rows.select("id", "first_seen", "last_seen", "mac", "host", "kind", F.coalesce(counters, F.lit("")).alias("counters"), F.coalesce(addresses, F.lit("")).alias("addresses"))


@query(UNITED, PROFILES, "g AS (SELECT * FROM grp)")
def merge_metadata(s, d):
    """Profiles of merged identities: ordered, capped and typed merges of their columns."""
    return as_text(identity.merge_metadata(profiles(s, d).join(groups(s, d), "id"), "canonical"))


@query(UNITED, PROFILES, "g AS (SELECT id, CASE WHEN canonical % 9 = 0 OR id % 9 = 0 THEN id ELSE canonical END AS canonical FROM grp)")
def split_profiles(s, d):
    """Profiles after identities were merged and every ninth merge was found wrong and undone."""
    start = profiles(s, d)
    now, log = identity.merge(start, identity.empty_log(start), groups(s, d), 1)
    back = identity.split(now, log, start.where("id % 9 = 0").select("id"), 2)[0]
    return as_text(identity.merge_metadata(back.withColumn("own", F.col("id")), "own"))  # those that stayed alone get their lists cut and put in order too


# --- candidates against pinned decisions, proposals

CASES = "(n >= 12 OR decoys > 0 OR tier = 5)"
CANDIDATE_ROWS = [("current", None, None, None, None), ("keen", 0.8, 0.5, None, None), ("calm", 0.95, None, None, None), ("deaf", None, None, 3.0, None), ("lenient", None, 0.7, None, 3.4)]
BOUNDS = "CASE WHEN decoys > 0 AND user_id % 10 <> 7 THEN 'CRITICAL' WHEN tier = 5 THEN 'SUSPICIOUS' END"
MOST = "CASE WHEN tier <= 2 AND attack < 2 AND decoys = 0 AND flips = 0 AND geo < 2 AND alerts < 2 THEN 'SUSPICIOUS' END"
_deciding = ", ".join(
    decision_sql("cases", f"c_{name}", **{k: f"{v}e0" for k, v in zip(("strong", "partial", "sources", "risk"), values) if v is not None}) for name, *values in CANDIDATE_ROWS)
GUARDED = " UNION ALL ".join(f"SELECT '{name}' AS candidate, state, decision_path, at_least, at_most, pinned FROM c_{name}" for name, *_ in CANDIDATE_ROWS)
RANK = "list_position(['BENIGN', 'ANOMALOUS', 'SUSPICIOUS', 'HIGH', 'CRITICAL'], {})"


def golden_cases(s, d):
    """Evidence of busy, decoyed and listed cycles with the bounds that hold under any parameters, and today's path as the pin of every fourth device."""
    now = decisions(s, d).where(CASES)
    pins = now.select("user_id", "week", F.expr(BOUNDS).alias("at_least"), F.expr(MOST).alias("at_most"), F.when(F.col("user_id") % 4 == 0, F.col("decision_path")).alias("pinned"))
    return evidence(s, d).join(pins, ["user_id", "week"])


@query(f"""SELECT candidate, count(*) AS cases, count(*) FILTER ({RANK.format('state')} < {RANK.format('at_least')}) AS missed, count(*) FILTER ({RANK.format('state')} > {RANK.format('at_most')}) AS over,
 count(*) FILTER (decision_path <> pinned) AS flipped, count(*) FILTER ({RANK.format('state')} < {RANK.format('at_least')} OR {RANK.format('state')} > {RANK.format('at_most')} OR decision_path <> pinned) > 0 AS blocked
 FROM ({GUARDED}) GROUP BY 1""", EV, HO, DEC, f"pins AS (SELECT user_id, week, {BOUNDS} AS at_least, {MOST} AS at_most, CASE WHEN user_id % 4 = 0 THEN decision_path END AS pinned FROM dc WHERE {CASES})",
       "cases AS (SELECT * FROM de JOIN pins USING (user_id, week))", _deciding)
def candidate_guard(s, d):
    """Candidates of decision parameters against pinned decisions and bounds, all in one pass over the cases."""
    fields = "candidate string, p_strong double, p_partial double, p_sources double, p_risk double"
    return tuning.guard(golden_cases(s, d), s.createDataFrame(CANDIDATE_ROWS, fields))


LOOSE = "loose AS (SELECT 100 + user_id AS change_id, user_id, 0.7 AS parent, 0.97 AS value FROM (SELECT DISTINCT user_id FROM ev) WHERE user_id % 3 = 0)"


@query("""SELECT change_id, count(*) AS misses FROM loose JOIN de USING (user_id) WHERE c_signature >= parent AND c_signature < value
 AND EXISTS (SELECT 1 FROM dc WHERE dc.user_id = de.user_id AND dc.state = 'CRITICAL' AND abs(dc.week - de.week) * 604800 <= 1209600) GROUP BY 1""", EV, HO, DEC, LOOSE)
def circuit_breaker(s, d):
    """Loosened bars of a signature's confidence under which a threat was missed that a decision within two weeks confirmed: they are rolled back at once."""
    scopes = events(s, d).where("user_id % 3 = 0").select((F.col("user_id") + 100).alias("change_id"), "user_id", F.lit(0.7).alias("parent"), F.lit(0.97).alias("value")).distinct()
    at = F.col("week").cast("double") * 604_800
    found = evidence(s, d).select("user_id", at.alias("t"), F.col("c_signature").alias("confidence"))
    return tuning.confirmed_misses(scopes, found, decisions(s, d).where("state = 'CRITICAL'").select("user_id", at.alias("t")), 1_209_600.0)


PROPOSALS = """prop AS (SELECT event_id AS proposal_id, event_type AS parameter, user_id % 5 AS scope, t, round(0.3 + (value - floor(value)) * 0.6, 6) AS wanted, event_id % 7 <> 0 AS backtest, event_id % 3 <> 0 AS night FROM ev),
 turns AS (SELECT *, row_number() OVER (PARTITION BY parameter, scope ORDER BY t, proposal_id) AS turn FROM prop),
 fold AS (SELECT parameter, scope, 0::BIGINT AS turn, NULL::BIGINT AS proposal_id, NULL::DOUBLE AS t, 0.5e0 AS active, 0.5e0 AS value, '' AS outcome, NULL::DOUBLE AS waiting, NULL::DOUBLE AS confirm, false AS passes, -1e18 AS last FROM turns WHERE turn = 1
  UNION ALL SELECT parameter, scope, turn, proposal_id, t, active, value, outcome, if(outcome IN ('promoted', 'rolled_back'), value, held), if(outcome IN ('promoted', 'rolled_back'), ceil((t + 21600) / 86400) * 86400, until),
    if(outcome IN ('promoted', 'rolled_back'), night, passes), if(outcome IN ('promoted', 'rolled_back'), t, last)
  FROM (SELECT *, CASE WHEN t - last < 3600 THEN 'cooldown' WHEN held IS NOT NULL THEN 'pending' WHEN NOT backtest THEN 'no_backtest' WHEN value > active AND value - 0.5e0 > 0.1e0 + 1e-9 THEN 'radius' WHEN night THEN 'promoted' ELSE 'rolled_back' END AS outcome
   FROM (SELECT *, greatest(0.1e0, least(0.9e0, active + greatest(-0.05e0, least(0.05e0, wanted - active)))) AS value
    FROM (SELECT n.*, if(f.confirm <= n.t AND f.passes, f.waiting, f.active) AS active, if(f.confirm <= n.t, NULL, f.waiting) AS held, if(f.confirm <= n.t, NULL, f.confirm) AS until, f.passes, f.last
     FROM fold f JOIN turns n ON n.parameter = f.parameter AND n.scope = f.scope AND n.turn = f.turn + 1))))"""


@query("SELECT parameter, scope, proposal_id, t, round(active, 6) AS active, round(value, 6) AS value, outcome FROM fold WHERE turn > 0", "RECURSIVE " + EV, PROPOSALS)
def proposal_states(s, d):
    """The life of each proposed change: refused, promoted by the first nightly run after its canary, or rolled back by it."""
    i = F.col("event_id")
    rows = events(s, d).select(i.alias("proposal_id"), F.col("event_type").alias("parameter"), (F.col("user_id") % 5).alias("scope"), "t", F.round(F.lit(0.3) + (F.col("value") - F.floor("value")) * 0.6, 6).alias("wanted"), (i % 7 != 0).alias("backtest"), (i % 3 != 0).alias("night_passes"))
    return tuning.proposal_states(rows).withColumn("active", F.round("active", 6)).withColumn("value", F.round("value", 6))


# --- retention

#: Orders stand for decisions, their lines for evidence that the decision cites, parts for destinations; alerts, actions and containments hang on decisions.
STORE = """decisions AS (SELECT o_orderkey AS id, o_custkey AS device, epoch_us(o_orderdate) / 1e6 AS t FROM orders),
 alerts AS (SELECT o_orderkey AS id, o_orderkey AS decision, o_custkey AS incident FROM orders WHERE o_orderstatus = 'F'), actions AS (SELECT o_orderkey AS id, o_orderkey AS alert FROM orders WHERE o_orderpriority LIKE '1%'),
 containments AS (SELECT o_orderkey AS id, o_orderkey AS decision FROM orders WHERE o_orderpriority LIKE '2%'), incidents AS (SELECT DISTINCT o_custkey AS id FROM orders),
 evidence AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS decision, l_partkey AS destination, l_returnflag = 'R' AS weak, epoch_us(l_shipdate) / 1e6 AS t FROM lineitem),
 destinations AS (SELECT p_partkey AS id, 0e0 AS t FROM part), baselines AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 1 THEN c_custkey - 1 END AS merged FROM customer),
 clock AS (SELECT max(epoch_us(o_orderdate) / 1e6) AS now FROM orders)"""
ALIVE = """d1 AS (SELECT decisions.* FROM decisions, clock WHERE t >= now - 365 * 86400), a1 AS (SELECT * FROM alerts a WHERE EXISTS (SELECT 1 FROM d1 WHERE d1.id = a.decision)),
 x1 AS (SELECT * FROM actions x WHERE EXISTS (SELECT 1 FROM a1 WHERE a1.id = x.alert)), i1 AS (SELECT * FROM incidents i WHERE EXISTS (SELECT 1 FROM a1 WHERE a1.incident = i.id)),
 e0 AS (SELECT e.*, EXISTS (SELECT 1 FROM d1, clock WHERE d1.id = e.decision AND d1.t >= now - 90 * 86400) AS cited FROM evidence e),
 e1 AS (SELECT e0.* FROM e0, clock WHERE cited OR t >= now - if(weak, 0.5, 90) * 86400), p1 AS (SELECT * FROM destinations p WHERE id % 50 = 3 OR EXISTS (SELECT 1 FROM e1 WHERE e1.destination = p.id))"""


def stored(s, d):
    """The store's tables and the time of its newest decision."""
    o, line = table(s, d, "orders"), table(s, d, "lineitem")
    key = F.col("o_orderkey")
    at = epoch("o_orderdate")
    tables = {
        "decisions": o.select(key.alias("id"), F.col("o_custkey").alias("device"), at.alias("t")),
        "alerts": o.where("o_orderstatus = 'F'").select(key.alias("id"), key.alias("decision"), F.col("o_custkey").alias("incident")),
        "actions": o.where("o_orderpriority LIKE '1%'").select(key.alias("id"), key.alias("alert")),
        "containments": o.where("o_orderpriority LIKE '2%'").select(key.alias("id"), key.alias("decision")),
        "incidents": o.select(F.col("o_custkey").alias("id")).distinct(),
        "evidence": line.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("decision"), F.col("l_partkey").alias("destination"), (F.col("l_returnflag") == "R").alias("weak"), epoch("l_shipdate").alias("t")),
        "destinations": table(s, d, "part").select(F.col("p_partkey").alias("id"), F.lit(0.0).alias("t")),
        "baselines": table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 4 == 1, F.col("c_custkey") - 1).alias("merged"), F.lit(0.0).alias("t")),
    }
    return tables, o.agg(F.max(at)).first()[0]


def policies(now):
    """Decisions live a year with what hangs on them, containments stay without them, evidence 90 days or while a decision of the last 90 cites it (weak notices half a day), destinations while
    evidence names them or a verdict is cached, baselines until their device is merged away."""
    return [
        retention.Policy("decisions", "id", 365), retention.Policy("alerts", "id", parents=[("decision", "decisions")]), retention.Policy("actions", "id", parents=[("alert", "alerts")]),
        retention.Policy("containments", "id", detached=[("decision", "decisions")]), retention.Policy("incidents", "id", cited_by=[("alerts", "incident")], only_cited=True),
        retention.Policy("evidence", "id", 90, cited_by=[("citations", "evidence")]), retention.Policy("evidence", "id", 0.5, cited_by=[("citations", "evidence")], where="weak"),
        retention.Policy("destinations", "id", 90, cited_by=[("evidence", "destination")], where="id % 50 <> 3"), retention.Policy("baselines", "id", 0, where="merged IS NOT NULL"),
    ]


@query("""SELECT 'decisions' AS "table", id, NULL::BIGINT AS ref FROM d1 UNION ALL SELECT 'alerts', id, decision FROM a1 UNION ALL SELECT 'actions', id, alert FROM x1
 UNION ALL SELECT 'containments', id, (SELECT d1.id FROM d1 WHERE d1.id = containments.decision) FROM containments UNION ALL SELECT 'incidents', id, NULL FROM i1 UNION ALL SELECT 'evidence', id, decision FROM e1
 UNION ALL SELECT 'destinations', id, NULL FROM p1 UNION ALL SELECT 'baselines', id, NULL FROM baselines WHERE merged IS NULL""", STORE, ALIVE)
def retention_survivors(s, d):
    """What stays of every table after one pass of the retention rules."""
    tables, now = stored(s, d)
    tables["citations"] = tables["evidence"].join(tables["decisions"].where(F.col("t") >= now - 90 * 86_400).select(F.col("id").alias("decision")), "decision", "left_semi").select(F.col("id").alias("evidence"))
    kept = retention.survivors(tables, policies(now), now)
    refs = {"alerts": "decision", "actions": "alert", "containments": "decision", "evidence": "decision"}
    parts = [kept[k].select(F.lit(k).alias("table"), "id", F.col(refs[k]) if k in refs else F.lit(None).cast("long")).toDF("table", "id", "ref") for k in tables if k != "citations"]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


BYTES = "stored AS (SELECT event_id AS id, floor(t / 86400) * 86400 AS t, 40 + length(props) + (event_id % 97) AS bytes FROM ev JOIN (SELECT event_id, props FROM events) USING (event_id))"


@query("SELECT t, id, total, freed FROM (SELECT t, id, sum(bytes) OVER (ORDER BY t, id)::DOUBLE AS freed, sum(bytes) OVER ()::DOUBLE AS total FROM stored) WHERE freed >= total - 0.4 * total ORDER BY t, id LIMIT 1", EV, BYTES)
def size_governor(s, d):
    """The newest row that must go for the rest to fit 40 % of the table's bytes, with the bytes in all and those that go."""
    extra = table(s, d, "events").select("event_id", (F.length("props") + 40 + F.col("event_id") % 97).alias("bytes"))
    rows = events(s, d).join(extra, "event_id").select(F.col("event_id").alias("id"), (F.floor(F.col("t") / 86_400) * 86_400).cast("double").alias("t"), "bytes")
    total = rows.agg(F.sum("bytes").cast("double")).first()[0]
    t, i = retention.size_cut(rows, 0.4 * total)
    freed = F.sum(F.when((F.col("t") < t) | ((F.col("t") == t) & (F.col("id") <= i)), F.col("bytes"))).cast("double")
    return rows.agg(freed.alias("freed")).select(F.lit(t).alias("t"), F.lit(i).cast("long").alias("id"), F.lit(total).alias("total"), "freed")


# --- synthetic episodes, explanations

_S = synthetic
_lehmer = "({}) % 2147483647 * 48271 % 2147483647 * 48271 % 2147483647"
_of = lambda at, kind: "CASE c " + " ".join(f"WHEN {n} THEN CAST({x[at]} AS {kind})" for n, x in enumerate(_S.CLASSES)) + " END"
EPISODES = f"""lastw AS (SELECT user_id AS device, max(CAST(floor(day / 7.0) AS BIGINT)) AS week FROM ev0 GROUP BY 1),
 epi AS (SELECT device, week, c, attack, m, 1000000000 + (device * {len(_S.CLASSES)} + c) * 90 + device % 5 AS user_id FROM lastw, (VALUES {", ".join(f"({n}, '{x[0]}', {x[1]})" for n, x in enumerate(_S.CLASSES))}) v(c, attack, m)),
 shots AS (SELECT *, {_lehmer.format("15485863 + device * 7919 + c * 104729")} AS q, {_lehmer.format("2 * 15485863 + device * 7919 + c * 104729 + i * 1299709")} AS r FROM (SELECT *, unnest(range(0, m)) AS i FROM epi)),
 shot AS (SELECT -1 - i AS event_id, user_id, {_of(2, "VARCHAR")} AS event_type, {_of(4, "DOUBLE")} AS value, week * 604800 + ({_of(5, "DOUBLE")}) % 604800 AS t, {_of(3, "INTEGER")} AS k FROM shots),
 ev AS (SELECT event_id, epi.user_id, event_type, value, t, k, day, hour FROM ev0 JOIN epi ON epi.device = ev0.user_id
  UNION ALL SELECT event_id, user_id, event_type, value, t, k, day, hour FROM ev0
  UNION ALL SELECT event_id, user_id, event_type, value, t, k, CAST(floor(t / 86400) AS BIGINT), CAST(floor(t / 3600) AS BIGINT) % 24 FROM shot)"""


@query("""SELECT epi.attack, count(*) AS episodes, count(*) FILTER (state IN ('SUSPICIOUS', 'HIGH', 'CRITICAL')) AS noticed, count(*) FILTER (state IN ('HIGH', 'CRITICAL')) AS alarmed, count(*) FILTER (list_position(['BENIGN', 'ANOMALOUS', 'SUSPICIOUS', 'HIGH', 'CRITICAL'], state) > list_position(['BENIGN', 'ANOMALOUS', 'SUSPICIOUS', 'HIGH', 'CRITICAL'], own)) AS raised
 FROM epi JOIN dc USING (user_id, week) JOIN (SELECT user_id AS device, week, state AS own FROM dc) o ON o.device = epi.device AND o.week = epi.week GROUP BY 1""", EV.replace("ev AS", "ev0 AS", 1), EPISODES, HO, DEC)
def episode_recall(s, d):
    """Seven classes of synthetic attacks and benign drift through the whole plan, by class: clones that are noticed, that raise an alarm, and whose state outranks their device's own that week."""
    real = events(s, d)
    _, cases = synthetic.episodes(real, last_week=True)
    last = cases.select("device", "week").distinct()
    # decisions follow from their row alone, so only those of the episodes' weeks are made, once
    seen = cycles.features(synthetic.counted(real), hosts(s, d)).join(last, ["device", "week"], "left_semi")
    done = written(cycles.decided(cycles.detected(seen)).select("user_id", "week", "state"))
    own = done.select(F.col("user_id").alias("device"), "week", F.col("state").alias("own"))
    rows = done.join(cases, ["user_id", "week"]).join(own, ["device", "week"])
    found = {"noticed": F.col("state").isin("SUSPICIOUS", "HIGH", "CRITICAL"), "alarmed": F.col("state").isin("HIGH", "CRITICAL"), "raised": tuning.rank("state") > tuning.rank("own")}
    return rows.groupBy("attack").agg(F.count("*").alias("episodes"), *[F.sum(c.cast("long")).alias(k) for k, c in found.items()])


def _filled_sql(template: str) -> str:
    text = template.replace("'", "''")
    for c in re.findall(r"\{(\w+)\}", template):
        text = text.replace("{" + c + "}", f"' || coalesce({c}::VARCHAR, '?') || '")
    return f"'{text}'"


_evidence = ", ".join(f"{{'low': -c_{k}, 'kind': '{k}', 'text': {_filled_sql(t)}}}" for k, t in explain.EVIDENCE_TEXTS.items())
_texts = lambda rules: "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {_filled_sql(t)} END" for c, t in rules) + "], lambda x: x IS NOT NULL)"


@query(f"""SELECT user_id, week, state || ': device ' || user_id || ', ' || CASE decision_path {" ".join(f"WHEN '{p}' THEN {_filled_sql(t)}" for p, t in explain.PATH_TEXTS.items())} END AS headline,
 array_to_string(list_transform(list_sort(list_filter([{_evidence}], lambda e: e.low < 0))[:3], lambda e: e.text || ' (' || round(-e.low * 100)::INTEGER || ' %)'), '; ') AS reasons, array_to_string({_texts(explain.BENIGN_TEXTS)}, '; ') AS harmless
 FROM dc WHERE state <> 'BENIGN'""", EV, HO, DEC)  # fmt: skip
def explanations(s, d):
    """Every decision other than a benign one in plain words: headline, the strongest evidence, and harmless explanations."""
    return explain.explained(decisions(s, d)).select("user_id", "week", "headline", "reasons", "harmless")


@query(f"SELECT user_id, week, state, array_to_string(({_texts(explain.ACTIONS)})[:3], '; ') AS actions FROM dc WHERE state <> 'BENIGN'", EV, HO, DEC)
def next_actions(s, d):
    return explain.explained(decisions(s, d)).select("user_id", "week", "state", "actions")


# --- files of ranges and feeds

RANGES = """rng AS (SELECT p_partkey * 97 AS lo, p_partkey * 97 + p_size * 40 AS hi, p_partkey % 61 AS asn, substr(p_brand, 1, 8) AS country FROM part),
 cuts AS (SELECT x, lead(x) OVER (ORDER BY x) - 1 AS "to" FROM (SELECT lo AS x FROM rng UNION SELECT hi + 1 FROM rng)),
 said AS (SELECT x, "to", arg_min(asn, (hi - lo, lo, asn)) AS asn, arg_min(country, (hi - lo, lo, asn)) AS country FROM cuts JOIN rng ON lo <= x AND hi >= "to" WHERE "to" IS NOT NULL GROUP BY 1, 2),
 runs AS (SELECT *, sum(new) OVER (PARTITION BY asn, country ORDER BY x) AS run FROM (SELECT *, CASE WHEN x - 1 = lag("to") OVER (PARTITION BY asn, country ORDER BY x) THEN 0 ELSE 1 END AS new FROM said))"""


def _file(rows, name):
    """Rows as gzip text of one column, in the shared folder; the folder's path."""
    path = f"{shared_dir(rows.sparkSession)}/files/{name}-{uuid.uuid4().hex}"
    rows.write.option("compression", "gzip").text(path)
    return path


@query('SELECT min(x) AS lo, max("to") AS hi, asn, country FROM runs GROUP BY asn, country, run', RANGES)
def range_load(s, d):
    """A tab-separated range list, written from the parts with overlaps, read back as disjoint ranges."""
    k = F.col("p_partkey")
    line = F.concat_ws("\t", (k * 97).cast("string"), (k * 97 + F.col("p_size") * 40).cast("string"), F.concat(F.lit("AS"), (k % 61).cast("string")), F.substring("p_brand", 1, 8), F.lit("org"))
    return ranges.load_ranges(s, _file(table(s, d, "part").select(line.alias("value")), "ranges")).select("lo", "hi", "asn", "country")


@query("""SELECT DISTINCT kind, value, 0.8::DOUBLE AS confidence, kind || '-feed' AS feed FROM (SELECT 'domain' AS kind, host AS value FROM ho WHERE host LIKE '%.%' UNION ALL SELECT 'url', regexp_replace(lower(url), '^[a-z]+://|[?#].*$', '', 'g') FROM ho WHERE url LIKE '%.%'
 UNION ALL SELECT 'ip', '10.' || page_id % 200 || '.3.4' FROM ho)""", HO)
def feed_parse(s, d):
    """Three shapes of indicator feeds, written from the pages with comments between their lines, read back as indicators."""
    h = hosts(s, d)
    lines = {"hostfile": F.concat(F.lit("0.0.0.0 "), F.upper("host")), "url_csv": F.concat(F.lit('"1","2026","'), F.col("url"), F.lit('"')), "ip_csv": F.concat(F.lit("10."), (F.col("page_id") % 200).cast("string"), F.lit(".3.4"))}
    out = None
    for shape, line in lines.items():
        text = h.select(F.explode(F.array(F.lit("# comment"), line, F.lit(""))).alias("value")).where("value IS NOT NULL")
        kind = {"hostfile": "domain", "url_csv": "url", "ip_csv": "ip"}[shape]
        part = feeds.feed(s, _file(text, shape), shape, f"{kind}-feed")
        out = part if out is None else out.unionByName(part)
    return out


# --- small operators over identities, payloads and baselines

#: Verdicts as they were stored with an alert, with the stage that gave them.
STORED = "CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'FALSE_POSITIVE' WHEN 2 THEN 'UNCERTAIN' ELSE 'CONFIRMED_THREAT' END"
STAGE = "CASE WHEN k % 3 = 0 THEN 'STAGE_3_COMBINED' WHEN k % 3 = 1 THEN 'STAGE_1_HARD_STOP' END"


def canonical_verdict(verdict, stage):
    """A stored verdict in today's words: a threat confirmed by the combined score alone is only likely real; none stays none."""
    return F.when((verdict == "CONFIRMED_THREAT") & (stage == "STAGE_3_COMBINED"), "LIKELY_REAL").otherwise(verdict)


@query("SELECT event_id, if(event_id % 5 > 2 AND k % 3 = 0, 'LIKELY_REAL', ['FALSE_POSITIVE', 'UNCERTAIN', 'CONFIRMED_THREAT', 'CONFIRMED_THREAT'][event_id % 5]) AS verdict, event_id % 5 > 2 AND NOT coalesce(k % 3 = 0, false) AS confirmed FROM ev", EV)
def verdict_canonical(s, d):
    """Stored verdicts in today's words, and which of them are independent confirmations."""
    verdict = canonical_verdict(F.expr(STORED), F.expr(STAGE))
    return events(s, d).select("event_id", verdict.alias("verdict"), F.coalesce(verdict == "CONFIRMED_THREAT", F.lit(False)).alias("confirmed"))


GENERIC = r"^(|unknown|localhost|none|n/a|device|host-\d{1,2}|\d+(\.\d+){3}|([0-9a-f]{2}[:-]?){6}|[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12})$"


@query("SELECT id, host, host IS NULL OR host = '' OR regexp_full_match(host, 'host-[0-9][0-9]?') AS generic FROM pro", PROFILES)
def generic_hostname(s, d):
    """Whether a device's name says nothing: empty, a placeholder, an address, a hardware address, a random identifier, or a number given by the router."""
    host = F.lower(F.trim(F.coalesce("host", F.lit(""))))
    return profiles(s, d).select("id", "host", host.rlike(GENERIC).alias("generic"))


@query("""SELECT o_custkey AS client, arg_max('name-' || o_orderkey % 300, (o_orderdate, o_orderkey)) AS host, max(epoch_us(o_orderdate) / 1e6) AS refreshed FROM orders WHERE o_orderkey % 300 > 9 GROUP BY 1""")
def hostname_refresh(s, d):
    """The dimension of names: each client's newest name that is no placeholder, of equal times the one of the larger row."""
    o = table(s, d, "orders")
    name = F.concat(F.lit("name-"), (F.col("o_orderkey") % 300).cast("string"))
    rows = o.where(F.col("o_orderkey") % 300 > 9).select(F.col("o_custkey").alias("client"), name.alias("host"), epoch("o_orderdate").alias("t"), "o_orderkey")
    return rows.groupBy("client").agg(F.max_by("host", F.struct("t", "o_orderkey")).alias("host"), F.max("t").alias("refreshed"))


@query("""SELECT CASE event_type WHEN 'view' THEN 'dns' WHEN 'click' THEN 'http' WHEN 'purchase' THEN 'conn' WHEN 'error' THEN 'notice' ELSE 'other' END AS kind, day, count(*) AS n, count(k) AS with_destination, round(sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END), 4) AS bytes
 FROM ev GROUP BY 1, 2""", EV)
def event_dispatch(s, d):
    """Events dealt to typed streams in one pass: what each stream's day holds, with the columns that only its type has."""
    kind = F.col("event_type")
    to = F.when(kind == "view", "dns").when(kind == "click", "http").when(kind == "purchase", "conn").when(kind == "error", "notice").otherwise("other")
    return events(s, d).groupBy(to.alias("kind"), "day").agg(F.count("*").alias("n"), F.count("k").alias("with_destination"), F.round(F.sum(F.when(kind == "purchase", F.col("value")).otherwise(0.0)), 4).alias("bytes"))


@query("""SELECT user_id, string_agg(event_type || '=' || v, ';' ORDER BY event_type) AS payload FROM (SELECT user_id, event_type, arg_max(coalesce(k, -1), (t, event_id)) AS v FROM ev GROUP BY 1, 2) GROUP BY 1""", EV)
def payload_patch(s, d):
    """A decision's payload after its patches: of each field the newest value wins, of equal times the later row's."""
    newest = events(s, d).groupBy("user_id", "event_type").agg(F.max_by(F.coalesce("k", F.lit(-1)), F.struct("t", "event_id")).alias("v"))
    field = F.struct("event_type", F.concat_ws("=", "event_type", F.col("v").cast("string")).alias("text"))
    return newest.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(field)), lambda x: x["text"]), ";").alias("payload"))


REGIMES = "reg AS (SELECT user_id, event_type AS metric, floor(day / 10)::BIGINT AS regime, max(t) AS t FROM ev GROUP BY 1, 2, 3)"


@query("SELECT user_id, metric, regime FROM reg WHERE regime = (SELECT max(regime) FROM reg r WHERE r.user_id = reg.user_id AND r.metric = reg.metric) OR t >= (SELECT max(t) FROM reg) - 30 * 86400", EV, REGIMES)
def stale_regimes(s, d):
    """Baselines that stay: each device and metric's current regime, and superseded ones while younger than thirty days."""
    rows = events(s, d).groupBy("user_id", F.col("event_type").alias("metric"), F.floor(F.col("day") / 10).cast("long").alias("regime")).agg(F.max("t").alias("t"))
    now = rows.groupBy("user_id", "metric").agg(F.max("regime").alias("current"))
    last = rows.agg((F.max("t") - 30 * 86_400).alias("least"))
    return rows.join(now, ["user_id", "metric"]).join(F.broadcast(last)).where("regime = current OR t >= least").select("user_id", "metric", "regime")  # one row


@query("""SELECT g.canonical AS id, arg_max(m.id, (trained, m.id)) AS model_of, max(trained) AS trained, count(*) - 1 AS dropped FROM (SELECT id, last_seen AS trained FROM pro) m JOIN grp g USING (id) GROUP BY 1""", PROFILES)
def model_rekey(s, d):
    """Models of merged devices under the canonical id: the one trained last moves there, the others go."""
    rows = profiles(s, d).select("id", F.col("last_seen").alias("trained")).join(groups(s, d), "id")
    best = F.struct("trained", "id")
    return rows.groupBy("canonical").agg(F.max_by("id", best).alias("model_of"), F.max("trained").alias("trained"), (F.count("*") - 1).alias("dropped")).withColumnRenamed("canonical", "id")
