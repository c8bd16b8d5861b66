"""Queries of device cycles: features, detectors, hypotheses, the decision and what follows from it, each beside the SQL that it must equal.

The SQL side is written by hand, apart from the plan's rule tables: features here, detectors, hypotheses and the decision in ``cycle_oracle``.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .cycle_oracle import decision_sql, detector_sql
from .plans import cycles as C
from .queries import EV, HO, QUERIES, SQL, query, when_n
from .sources.tables import events, hosts

#: The features in SQL, from events and hosts.
FEATURES = """wk AS (SELECT *, CAST(floor(day / 7.0) AS BIGINT) AS week FROM ev),
 lab AS (SELECT page_id AS k, string_split(host, '.')[1] AS label FROM ho),
 letters AS (SELECT label, c, count(*) AS m FROM (SELECT label, unnest(string_split(label, '')) AS c FROM (SELECT DISTINCT label FROM lab)) GROUP BY 1, 2),
 ent AS (SELECT label, -sum(m / length(label) * log2(m / length(label))) + 0 AS h FROM letters GROUP BY label),
 pairs AS (SELECT DISTINCT user_id, week, k FROM wk),
 spread AS (SELECT user_id, week, count(k) AS targets, coalesce(round(avg(h), 6), 0.0) AS entropy, coalesce(max(length(label)), 0) AS longest FROM pairs LEFT JOIN lab USING (k) LEFT JOIN ent USING (label) GROUP BY 1, 2),
 main AS (SELECT user_id, week, k AS top_k, m AS most_n FROM (SELECT user_id, week, k, count(*) AS m FROM wk GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY user_id, week ORDER BY m DESC, k) = 1),
 gaps AS (SELECT user_id, week, coalesce(round(avg(g), 3), 0.0) AS gap_mean, coalesce(round(stddev_pop(g) / avg(g), 6), 9.0) AS gap_cv
   FROM (SELECT user_id, week, t - lag(t) OVER (PARTITION BY user_id, week ORDER BY t, event_id) AS g FROM wk) GROUP BY 1, 2),
 sums AS (SELECT user_id, week, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'click') AS clicks,
   count(*) FILTER (event_type = 'purchase') AS buys, count(*) FILTER (event_type = 'signup') AS signups, count(DISTINCT k) FILTER (event_type = 'error') AS rejected, round(sum(value), 4) AS total, max(value) AS top,
   count(DISTINCT k) FILTER (event_type = 'purchase' AND k BETWEEN 20 AND 39) AS moves, count(*) FILTER (k = 13) AS decoys, count(*) FILTER (k % 25 = 3) AS geo, count(*) FILTER (k % 17 = 0 AND k > 0) AS tls,
   count(*) FILTER (k % 11 = 4 AND event_type = 'error') AS alerts, count(*) FILTER (k >= 70) AS unexplained,
   coalesce(nullif(count(DISTINCT event_type) FILTER (k = 57), 0) - 1, 0) AS flips, max(t) - max(t) FILTER (k % 25 = 3) AS geo_age, max(t) - max(t) FILTER (k % 11 = 4 AND event_type = 'error') AS alert_age, max(t) - max(t) FILTER (k = 57) AS spoof_age FROM wk GROUP BY 1, 2),
 born AS (SELECT k AS top_k, min(week) AS week FROM wk WHERE k IS NOT NULL GROUP BY 1),
 touch AS (SELECT k AS top_k, week, count(DISTINCT user_id) - 1 AS others FROM wk GROUP BY 1, 2),
 fe AS (SELECT *, user_id % 5 AS kind, round(most_n / n, 6) AS share, coalesce(top_k % 6, 3) AS tier, coalesce(top_k % 12 = 5, false) AS verified, round(coalesce(top_k % 7, 0) / 7.0 * 4, 6) AS risk,
   round(CASE WHEN count(*) OVER past >= 2 THEN greatest(0.0, (total - avg(total) OVER past) / greatest(stddev_pop(total) OVER past, 1.0)) ELSE 0.0 END, 6) AS z,
   round(least(1.0, (count(*) OVER past) / 4), 6) AS familiarity, count(*) OVER (PARTITION BY user_id % 5, week) - 1 AS peers,
   round((sum(n) OVER (PARTITION BY user_id % 5, week) - n) / nullif(count(*) OVER (PARTITION BY user_id % 5, week) - 1, 0), 6) AS peer_mean
   FROM (SELECT sums.*, spread.* EXCLUDE (user_id, week), main.* EXCLUDE (user_id, week), gaps.* EXCLUDE (user_id, week), coalesce(others, 0) AS others, coalesce(born.week = sums.week, false) AS young
     FROM sums JOIN spread USING (user_id, week) JOIN main USING (user_id, week) JOIN gaps USING (user_id, week) LEFT JOIN touch ON touch.top_k = main.top_k AND touch.week = sums.week LEFT JOIN born ON born.top_k = main.top_k)
   WINDOW past AS (PARTITION BY user_id ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


DET = ", ".join([FEATURES, detector_sql("fe", "de")])
DEC = ", ".join([DET, decision_sql("de", "dc")])


def cycles(s, d):
    return C.features(events(s, d), hosts(s, d))


def evidence(s, d):
    return C.detected(cycles(s, d))


def decisions(s, d):
    return C.decided(evidence(s, d))


FEATURE_COLUMNS = ["n", "errors", "views", "clicks", "buys", "signups", "targets", "rejected", "total", "top", "entropy", "longest", "top_k", "share", "gap_mean", "gap_cv", "z", "peers", "peer_mean", "familiarity", "others", "flips", "geo_age", "alert_age", "spoof_age", "young"]


@query(f"SELECT user_id, week, {', '.join(FEATURE_COLUMNS)} FROM fe", EV, HO, FEATURES)
def cycle_features(s, d):
    return cycles(s, d).select("user_id", "week", *FEATURE_COLUMNS)


#: One query for each detector: its confidence where it fires, with the columns that explain it.
FIRINGS = {
    "cycle_rate": ("c_rate", "n"), "det_entropy": ("c_entropy", "entropy"), "det_unique": ("c_unique", "targets"), "det_dga": ("c_dga", "errors"), "det_tunnel": ("c_tunnel", "t_encoded", "t_fanout", "t_txt", "t_tld"),
    "det_exfil": ("c_exfil", "z", "total"), "det_beacon": ("c_beacon", "beacon_tag"), "det_conn_abuse": ("c_abuse", "rejected"), "cycle_sweep": ("c_sweep", "targets"), "det_long": ("c_long", "top"), "det_tls": ("c_tls", "tls"),
    "det_decoy": ("c_decoy", "decoys"), "det_spoof": ("c_spoof", "flips"), "det_lateral": ("c_lateral", "moves"), "det_discovery": ("c_discovery", "signups"), "det_geofence": ("c_geofence", "geo"), "sig_attribution": ("c_signature", "alerts"), "det_evasion": ("c_evasion", "unexplained"),
    "det_peer": ("c_peer", "peer_mean"), "det_coordinated": ("c_coordinated", "others"),
}


def _firing(name: str, conf: str, *shown: str):
    def run(s, d):
        return evidence(s, d).where(F.col(conf) > 0).select("user_id", "week", F.col(conf).alias("confidence"), *shown)

    run.__name__ = name
    run.__doc__ = f"Cycles in which {conf[2:]} fires, with its confidence."
    query(f"SELECT user_id, week, {conf} AS confidence, {', '.join(shown)} FROM de WHERE {conf} > 0", EV, HO, DET)(run)


for _name, _rest in FIRINGS.items():
    _firing(_name, *_rest)


HYPOTHESES = {**C.ATTACKS, **C.BENIGN}


@query(f"SELECT user_id, week, {', '.join(f'CAST(h_{k} AS DOUBLE) AS {k}' for k in HYPOTHESES)}, attack_name, benign_name FROM dc", EV, HO, DEC)
def hyp_scores(s, d):
    """Score of every hypothesis in every cycle and the winners."""
    return decisions(s, d).select("user_id", "week", *[F.col(f"h_{k}").cast("double").alias(k) for k in HYPOTHESES], "attack_name", "benign_name")


@query("SELECT user_id, week, attack, benign, attack_name, sources, state, decision_path, confidence FROM dc", EV, HO, DEC)
def decide(s, d):
    return decisions(s, d).select("user_id", "week", "attack", "benign", "attack_name", F.col("sources").cast("int").alias("sources"), "state", "decision_path", "confidence")


@query("SELECT decision_path AS path, state, count(*) AS n, round(avg(attack), 6) AS attack FROM dc GROUP BY 1, 2", EV, HO, DEC)
def decide_cycle_paths(s, d):
    return decisions(s, d).groupBy(F.col("decision_path").alias("path"), "state").agg(F.count("*").alias("n"), F.round(F.avg("attack"), 6).alias("attack"))


@query("SELECT user_id, week, x.hypothesis, x.score, x.won FROM (SELECT user_id, week, unnest([{'hypothesis': attack_name, 'score': attack, 'won': attack > benign}, {'hypothesis': benign_name, 'score': benign, 'won': attack <= benign}]) AS x FROM dc)", EV, HO, DEC)
def hyp_edges(s, d):
    """Both hypotheses of a decision as edges with their score and whether they won."""
    c = decisions(s, d)
    both = F.array(F.struct(F.col("attack_name").alias("hypothesis"), F.col("attack").alias("score"), (F.col("attack") > F.col("benign")).alias("won")), F.struct(F.col("benign_name").alias("hypothesis"), F.col("benign").alias("score"), (F.col("attack") <= F.col("benign")).alias("won")))
    return c.select("user_id", "week", F.inline(both))


# --- evidence as rows, alert views

CONFIDENCES = [c for c in [*C.DETECTORS, *C.COMPOSED] if c.startswith("c_")]
FAMILY_OF = {"rate": "dns", "entropy": "dns", "unique": "dns", "dga": "dns", "tunnel": "dns", "evasion": "dns", "exfil": "traffic", "beacon": "traffic", "abuse": "traffic", "sweep": "traffic", "long": "traffic", "scan": "traffic", "tls": "sensor", "lateral": "sensor", "signature": "sensor", "reputation": "intel", "decoy": "decoy", "spoof": "sensor", "geofence": "policy", "peer": "context", "coordinated": "context", "discovery": "context"}
FAMILY_SQL = "CASE " + " ".join(f"WHEN kind = '{k}' THEN '{v}'" for k, v in FAMILY_OF.items()) + " END"
EVI = f"""evi AS (SELECT user_id, week, top_k, x.kind AS kind, x.confidence AS confidence, {FAMILY_SQL.replace("kind", "x.kind")} AS family FROM (SELECT user_id, week, top_k, unnest([{", ".join(f"{{'kind': '{c[2:]}', 'confidence': {c}}}" for c in CONFIDENCES)}]) AS x FROM de) WHERE x.confidence > 0)"""


def evidence_rows(s, d):
    """One row for each firing: device, week, destination, kind, family, confidence."""
    rows = evidence(s, d).select("user_id", "week", "top_k", F.inline(F.array(*[F.struct(F.lit(c[2:]).alias("kind"), F.col(c).alias("confidence")) for c in CONFIDENCES])))
    return rows.where("confidence > 0").withColumn("family", F.expr(FAMILY_SQL))


@query("SELECT user_id, week, kind, family, confidence, CASE WHEN top_k IS NULL THEN 'none' ELSE 'dest-' || top_k END AS destination FROM evi", EV, HO, DET, EVI)
def evidence_convert(s, d):
    return evidence_rows(s, d).select("user_id", "week", "kind", "family", "confidence", F.coalesce(F.concat(F.lit("dest-"), F.col("top_k").cast("string")), F.lit("none")).alias("destination"))


@query("SELECT user_id, week, CASE WHEN family = 'context' THEN 'context' ELSE 'shown' END AS bucket, count(*) AS n, count(DISTINCT family) AS families, max(confidence) AS best FROM evi GROUP BY 1, 2, 3", EV, HO, DET, EVI)
def alert_buckets(s, d):
    b = F.when(F.col("family") == "context", "context").otherwise("shown")
    return evidence_rows(s, d).groupBy("user_id", "week", b.alias("bucket")).agg(F.count("*").alias("n"), F.size(F.collect_set("family")).cast("long").alias("families"), F.max("confidence").alias("best"))


@query("SELECT user_id, week, kind, confidence FROM evi WHERE NOT (user_id % 10 = 7 AND kind IN ('rate', 'unique', 'discovery', 'peer'))", EV, HO, DET, EVI)
def safe_dampen(s, d):
    """Listed kinds of evidence do not count for devices marked safe."""
    return evidence_rows(s, d).where("NOT (user_id % 10 = 7 AND kind IN ('rate', 'unique', 'discovery', 'peer'))").select("user_id", "week", "kind", "confidence")


@query("SELECT user_id, week, sha256(array_to_string(list_sort(list(kind || ':' || family)), ',')) AS fingerprint, count(*) AS n FROM evi GROUP BY 1, 2", EV, HO, DET, EVI)
def ev_fingerprint(s, d):
    """A cache key of a cycle's evidence that does not depend on its order."""
    return evidence_rows(s, d).groupBy("user_id", "week").agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "kind", "family"))), ","), 256).alias("fingerprint"), F.count("*").alias("n"))


@query("SELECT user_id, week, CASE WHEN c_sweep > 0 OR c_lateral > 0 THEN 'several' WHEN c_exfil > 0 OR c_beacon > 0 OR c_reputation > 0 THEN 'dest-' || top_k ELSE 'none' END AS target FROM dc WHERE state <> 'BENIGN'", EV, HO, DEC)
def alert_target(s, d):
    """What an alert names: the destination of firing traffic evidence; scans name a set."""
    target = F.when((F.col("c_sweep") > 0) | (F.col("c_lateral") > 0), "several").when((F.col("c_exfil") > 0) | (F.col("c_beacon") > 0) | (F.col("c_reputation") > 0), F.concat(F.lit("dest-"), F.col("top_k").cast("string"))).otherwise("none")
    return decisions(s, d).where("state <> 'BENIGN'").select("user_id", "week", target.alias("target"))


PLAN = "CASE WHEN state NOT IN ('CRITICAL', 'HIGH') THEN 'none' WHEN NOT (decision_path IN ('hard_decoy', 'listed_verified') OR sources >= 2) THEN 'withheld' WHEN user_id % 13 = 0 THEN 'operator' WHEN kind IN (0, 3) THEN 'approval' WHEN risk >= 3.0 OR c_lateral > 0 THEN 'router_isolation' ELSE 'name_block' END"


@query(f"SELECT user_id, week, state, {C.doubles(PLAN)} AS recommendation FROM dc", EV, HO, DEC)
def containment_plan(s, d):
    """A recommendation only: nothing acts on it. Authorisation first, then critical kinds of device by approval, then the rung."""
    return decisions(s, d).select("user_id", "week", "state", F.expr(C.doubles(PLAN)).alias("recommendation"))


@query("SELECT user_id, week, state, sources, row_number() OVER (ORDER BY CASE state WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'SUSPICIOUS' THEN 2 ELSE 3 END, sources DESC, week, user_id) AS place FROM dc WHERE state <> 'BENIGN' QUALIFY place <= 50", EV, HO, DEC)
def review_queue(s, d):
    """The fifty decisions to review first: severity, then sources, then the oldest."""
    rank = F.when(F.col("state") == "CRITICAL", 0).when(F.col("state") == "HIGH", 1).when(F.col("state") == "SUSPICIOUS", 2).otherwise(3)
    top = decisions(s, d).where("state <> 'BENIGN'").select("user_id", "week", "state", F.col("sources").cast("int").alias("sources"), rank.alias("r")).orderBy("r", F.desc("sources"), "week", "user_id").limit(50)
    return top.withColumn("place", F.row_number().over(W.orderBy("r", F.desc("sources"), "week", "user_id"))).drop("r")  # fifty rows


@query("SELECT user_id, week, CASE WHEN attack_name = 'UNKNOWN_BENIGN' OR sources = 0 THEN 'reject' WHEN benign >= attack THEN 'downgrade' WHEN state = 'CRITICAL' AND sources < 2 THEN 'needs_human' ELSE 'uphold' END AS verdict FROM dc WHERE state <> 'BENIGN'", EV, HO, DEC)
def review_validator(s, d):
    v = F.when((F.col("attack_name") == "UNKNOWN_BENIGN") | (F.col("sources") == 0), "reject").when(F.col("benign") >= F.col("attack"), "downgrade").when((F.col("state") == "CRITICAL") & (F.col("sources") < 2), "needs_human").otherwise("uphold")
    return decisions(s, d).where("state <> 'BENIGN'").select("user_id", "week", v.alias("verdict"))


# --- replay and tuning: the same plan under candidate parameters

CANDIDATES = [("current", 1.0), ("tighter", 0.8), ("looser", 1.25)]
_scaled = {c: f"CASE WHEN {c} * factor >= 1.0 THEN 1.0 ELSE {c} * factor END" for c in ("c_exfil", "c_beacon", "c_scan", "c_dga")}
REPLAY = f"""cand AS (SELECT de.* EXCLUDE ({", ".join(_scaled)}), p.name AS candidate, {", ".join(f"round({C.doubles(e).replace('factor', 'p.factor')}, 6) AS {c}" for c, e in _scaled.items())} FROM de, (VALUES {", ".join(f"('{a}', {b}e0)" for a, b in CANDIDATES)}) p(name, factor)), """ + decision_sql("cand", "rp")


def replayed(s, d):
    """Every cycle decided under each candidate: confidences scaled by the candidate's factor. Three rows of parameters, exploded from literals."""
    e = evidence(s, d).withColumn("p", F.explode(F.array(*[F.struct(F.lit(a).alias("name"), F.lit(b).alias("factor")) for a, b in CANDIDATES])))
    e = e.withColumn("candidate", F.col("p.name")).withColumn("factor", F.col("p.factor"))
    for c, x in _scaled.items():
        e = e.withColumn(c, F.round(F.expr(C.doubles(x)), 6))
    return C.decided(e.drop("p", "factor"))


@query("SELECT candidate, count(*) AS n, count(*) FILTER (rp.state = dc.state) AS agree, round(count(*) FILTER (rp.state = dc.state) / count(*), 6) AS share FROM rp JOIN dc USING (user_id, week) GROUP BY 1", EV, HO, DEC, REPLAY)
def shadow_agreement(s, d):
    """How often each candidate decides as the current parameters do."""
    r = replayed(s, d).select("user_id", "week", "candidate", "state")
    now = F.max(F.when(F.col("candidate") == "current", F.col("state"))).over(W.partitionBy("user_id", "week"))
    r = r.withColumn("same", F.when(now == F.col("state"), 1).otherwise(0))
    return r.groupBy("candidate").agg(F.count("*").alias("n"), F.sum("same").alias("agree"), F.round(F.sum("same") / F.count("*"), 6).alias("share"))


@query("SELECT user_id, week, candidate, dc.state AS before, rp.state AS after FROM rp JOIN dc USING (user_id, week) WHERE rp.state <> dc.state", EV, HO, DEC, REPLAY)
def replay_diff(s, d):
    r = replayed(s, d).select("user_id", "week", "candidate", "state")
    now = F.max(F.when(F.col("candidate") == "current", F.col("state"))).over(W.partitionBy("user_id", "week"))
    return r.withColumn("before", now).where("before <> state").select("user_id", "week", "candidate", "before", F.col("state").alias("after"))


TUNE = "CASE WHEN candidate = 'current' THEN 'keep' WHEN caught < base_caught THEN 'reject_recall' WHEN alarms > base_alarms THEN 'reject_noise' WHEN alarms < base_alarms THEN 'propose' ELSE 'no_gain' END"


@query(f"SELECT candidate, caught, alarms, {TUNE} AS verdict FROM (SELECT *, max(CASE WHEN candidate = 'current' THEN caught END) OVER () AS base_caught, max(CASE WHEN candidate = 'current' THEN alarms END) OVER () AS base_alarms FROM (SELECT candidate, count(*) FILTER (state IN ('CRITICAL', 'HIGH') AND decoys > 0) AS caught, count(*) FILTER (state IN ('CRITICAL', 'HIGH') AND decoys = 0) AS alarms FROM rp GROUP BY 1))", EV, HO, DEC, REPLAY)
def tune_decision(s, d):
    """A candidate is proposed if it catches no less and alarms less."""
    r = replayed(s, d).groupBy("candidate").agg(when_n(F.col("state").isin("CRITICAL", "HIGH") & (F.col("decoys") > 0)).alias("caught"), when_n(F.col("state").isin("CRITICAL", "HIGH") & (F.col("decoys") == 0)).alias("alarms"))
    base = r.where("candidate = 'current'").select(F.col("caught").alias("base_caught"), F.col("alarms").alias("base_alarms"))
    return r.join(F.broadcast(base), how="left").select("candidate", "caught", "alarms", F.expr(TUNE).alias("verdict"))  # one row


@query("SELECT candidate, CASE WHEN share < 0.9 THEN 'rolled_back' WHEN hours < 6 THEN 'canary' ELSE 'promoted' END AS state FROM (SELECT candidate, count(*) FILTER (rp.state = dc.state) / count(*) AS share, CASE candidate WHEN 'current' THEN 12 WHEN 'tighter' THEN 4 ELSE 8 END AS hours FROM rp JOIN dc USING (user_id, week) GROUP BY 1)", EV, HO, DEC, REPLAY)
def canary_state(s, d):
    hours = F.when(F.col("candidate") == "current", 12).when(F.col("candidate") == "tighter", 4).otherwise(8)
    return shadow_agreement(s, d).select("candidate", F.when(F.col("agree") / F.col("n") < 0.9, "rolled_back").when(hours < 6, "canary").otherwise("promoted").alias("state"))


# --- false-positive engine

TRUST = """trust AS (SELECT user_id, attack_name, max(week) AS last_week, count(*) AS uses FROM dc WHERE state = 'BENIGN' GROUP BY 1, 2),
 fp AS (SELECT dc.*, trust.last_week IS NOT NULL AND trust.last_week < dc.week AND dc.week - trust.last_week <= 3 AS cached FROM dc LEFT JOIN trust USING (user_id, attack_name) WHERE dc.state <> 'BENIGN')"""
STOPS = {"decoy": "c_decoy >= 1.0", "signature": "c_signature >= 0.98", "geofence": "c_geofence >= 0.95", "lateral": "c_lateral > 0", "listed": "tier = 5", "exfil": "c_exfil >= 0.85", "many_sources": "sources >= 3"}
PROB = "round(least(1.0, greatest(0.0, 0.92 - 0.2 * sources - 0.1 * attack + 0.1 * benign + 0.2 * familiarity)), 6)"


def judged(s, d):
    """Alerts with the trust that earlier quiet weeks of the same device and hypothesis have left; trust lasts three weeks. Decisions are made once, for trust and alerts alike."""
    same, quiet = W.partitionBy("user_id", "attack_name"), F.col("state") == "BENIGN"
    last = F.max(F.when(quiet & F.col("user_id").isNotNull(), F.col("week"))).over(same)
    rows = decisions(s, d).withColumn("last_week", last).where("state <> 'BENIGN'")
    return rows.withColumn("cached", F.col("last_week").isNotNull() & (F.col("last_week") < F.col("week")) & (F.col("week") - F.col("last_week") <= 3))


@query("SELECT user_id, week, attack_name, cached FROM fp", EV, HO, DEC, TRUST)
def trust_cache(s, d):
    return judged(s, d).select("user_id", "week", "attack_name", F.coalesce("cached", F.lit(False)).alias("cached"))


STOP_LIST = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {e} THEN '{k}' END" for k, e in STOPS.items()) + "], lambda x: x IS NOT NULL), ',')"


@query(f"SELECT user_id, week, {C.doubles(STOP_LIST)} AS stops FROM fp", EV, HO, DEC, TRUST)
def fp_stage1(s, d):
    """Names of the hard stops that forbid calling an alert a false positive."""
    found = F.array_compact(F.array(*[F.when(F.expr(C.doubles(e)), k) for k, e in STOPS.items()]))
    return judged(s, d).select("user_id", "week", F.array_join(found, ",").alias("stops"))


@query(f"SELECT user_id, week, {C.doubles(PROB)} AS probability FROM fp", EV, HO, DEC, TRUST)
def fp_fallback(s, d):
    return judged(s, d).select("user_id", "week", F.expr(C.doubles(PROB)).alias("probability"))


_any = " OR ".join(f"({e})" for e in STOPS.values())
VERDICT = f"CASE WHEN ({_any}) AND tier = 5 AND sources < 2 THEN 'PREVIOUSLY_FLAGGED' WHEN {_any} THEN 'CONFIRMED_THREAT' WHEN cached THEN 'FALSE_POSITIVE' WHEN {PROB} >= 0.8 AND sources < 2 THEN 'FALSE_POSITIVE' WHEN {PROB} >= 0.55 THEN 'UNCERTAIN' ELSE 'LIKELY_REAL' END"


@query(f"SELECT user_id, week, {C.doubles(VERDICT)} AS verdict FROM fp", EV, HO, DEC, TRUST)
def fp_verdict(s, d):
    """Hard stops override trust; then trust, then the probability unless several sources bar it."""
    return judged(s, d).select("user_id", "week", F.expr(C.doubles(VERDICT)).alias("verdict"))


@query(f"SELECT verdict, count(*) AS n FROM (SELECT {C.doubles(VERDICT)} AS verdict FROM fp) GROUP BY 1", EV, HO, DEC, TRUST)
def verdict_counts(s, d):
    return fp_verdict(s, d).groupBy("verdict").agg(F.count("*").alias("n"))


@query("SELECT user_id, round(aggregate_shift, 6) AS shift FROM (SELECT user_id, list_reduce(list_prepend(0.0, list(CASE WHEN state = 'BENIGN' THEN -0.05 ELSE 0.15 END ORDER BY week)), lambda a, x: greatest(-0.3, least(0.3, a + x))) AS aggregate_shift FROM dc GROUP BY 1)", EV, HO, DEC)
def sigma_fold(s, d):
    """Sensitivity of a device: quiet weeks lower it, alerts raise it, clamped after every step."""
    steps = decisions(s, d).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("week", F.when(F.col("state") == "BENIGN", -0.05).otherwise(0.15).alias("x")))).alias("w"))
    return steps.select("user_id", F.round(F.aggregate("w", F.lit(0.0), lambda a, x: F.greatest(F.lit(-0.3), F.least(F.lit(0.3), a + x["x"]))), 6).alias("shift"))


@query("SELECT top_k AS k, count(DISTINCT user_id) AS devices, max(week) AS week, array_to_string(list_sort(list(DISTINCT decision_path)), ',') AS sources FROM dc WHERE state IN ('CRITICAL', 'HIGH') AND top_k IS NOT NULL GROUP BY 1 HAVING max(week) >= (SELECT max(week) - 3 FROM dc)", EV, HO, DEC)
def confirmed_store(s, d):
    """Destinations of confirmed threats with their sources, while younger than three weeks."""
    c = decisions(s, d)
    last = c.agg((F.max("week") - 3).alias("least"))
    rows = c.where("state IN ('CRITICAL', 'HIGH') AND top_k IS NOT NULL").groupBy(F.col("top_k").alias("k")).agg(F.countDistinct("user_id").alias("devices"), F.max("week").alias("week"), F.array_join(F.sort_array(F.collect_set("decision_path")), ",").alias("sources"))
    return rows.join(F.broadcast(last)).where("week >= least").drop("least")  # one row


@query("SELECT top_k AS k, count(*) AS confirmed, top_k BETWEEN 40 AND 59 AS protected FROM dc WHERE state = 'CRITICAL' AND top_k IS NOT NULL GROUP BY 1, 3", EV, HO, DEC)
def confirmed_counts(s, d):
    return decisions(s, d).where("state = 'CRITICAL' AND top_k IS NOT NULL").groupBy(F.col("top_k").alias("k"), F.col("top_k").between(40, 59).alias("protected")).agg(F.count("*").alias("confirmed"))


FIX = "CASE WHEN c_signature >= 0.98 OR c_decoy >= 1.0 THEN 'refused' WHEN attack_name = 'connection_abuse' THEN 'raise_threshold' WHEN top_k IS NULL THEN 'shift_only' WHEN top_k < 60 THEN 'trust_name' ELSE 'trust_address' END"


@query(f"SELECT user_id, week, {C.doubles(FIX)} AS action FROM fp", EV, HO, DEC, TRUST)
def fp_correction(s, d):
    """What a correction of an alert would do."""
    return judged(s, d).select("user_id", "week", F.expr(C.doubles(FIX)).alias("action"))


VECTOR = ["n", "errors", "targets", "entropy", "share", "gap_cv", "z", "familiarity", "risk", "attack", "sources"]


@query(f"SELECT user_id, week, {', '.join(f'round(CAST({c} AS DOUBLE), 6) AS f_{c}' for c in VECTOR)} FROM fp", EV, HO, DEC, TRUST)
def fp_vector(s, d):
    """The eleven inputs of the classifier."""
    return judged(s, d).select("user_id", "week", *[F.round(F.col(c).cast("double"), 6).alias(f"f_{c}") for c in VECTOR])


@query(f"SELECT user_id, week, {C.doubles(VERDICT)} AS label, CASE WHEN user_id % 4 = 0 THEN 'held_out' ELSE 'train' END AS part FROM fp WHERE NOT (user_id % 10 = 7) QUALIFY row_number() OVER (PARTITION BY user_id, attack_name ORDER BY week DESC) = 1", EV, HO, DEC, TRUST)
def train_set(s, d):
    """Newest alert of each device and hypothesis, safe devices left out, with its label and part."""
    rows = judged(s, d).where("user_id % 10 <> 7").withColumn("label", F.expr(C.doubles(VERDICT)))
    best = rows.groupBy("user_id", "attack_name").agg(F.max_by(F.struct("week", "label"), "week").alias("x"))
    return best.select("user_id", "x.week", "x.label", F.when(F.col("user_id") % 4 == 0, "held_out").otherwise("train").alias("part"))


@query("SELECT kind, count(*) AS n, round(quantile_cont(attack, 0.5), 6) AS median_attack, round(avg(CASE WHEN state IN ('CRITICAL', 'HIGH') THEN 1.0 ELSE 0.0 END), 6) AS alarm_rate FROM dc GROUP BY 1", EV, HO, DEC)
def calibrate(s, d):
    """Alarm rate and median attack score by kind of device, from which thresholds are set."""
    return decisions(s, d).groupBy("kind").agg(F.count("*").alias("n"), F.round(F.expr("percentile(attack, 0.5)"), 6).alias("median_attack"), F.round(F.avg(F.when(F.col("state").isin("CRITICAL", "HIGH"), 1.0).otherwise(0.0)), 6).alias("alarm_rate"))


@query("SELECT state, count(*) AS hits, count(*) FILTER (risk >= 2.0) AS recalled, round(count(*) FILTER (risk >= 2.0) / count(*), 6) AS recall FROM dc GROUP BY 1", EV, HO, DEC)
def recall_counts(s, d):
    hit = when_n(F.col("risk") >= 2.0)
    return decisions(s, d).groupBy("state").agg(F.count("*").alias("hits"), hit.alias("recalled"), F.round(hit / F.count("*"), 6).alias("recall"))


# --- hunting over decisions


@query("SELECT DISTINCT wk.k, dc.user_id, dc.state FROM wk JOIN dc ON wk.user_id = dc.user_id AND wk.week = dc.week WHERE wk.k IN (13, 28, 34) AND dc.state <> 'BENIGN'", EV, HO, DEC)
def hunt_touching(s, d):
    """Devices that touched one of three destinations in a week with an alert."""
    e = C.with_week(events(s, d)).where(F.col("k").isin(13, 28, 34)).select("k", "user_id", "week").distinct()
    return e.join(decisions(s, d).where("state <> 'BENIGN'").select("user_id", "week", "state"), ["user_id", "week"]).select("k", "user_id", "state").distinct()


@query("SELECT user_id, week, state, decision_path, lag(state) OVER (PARTITION BY user_id ORDER BY week) AS before FROM dc", EV, HO, DEC)
def hunt_history(s, d):
    return decisions(s, d).select("user_id", "week", "state", "decision_path", F.lag("state").over(W.partitionBy("user_id").orderBy("week")).alias("before"))


@query("SELECT user_id, week, 'decision' AS what, state AS detail FROM dc UNION ALL SELECT user_id, week, 'evidence', kind FROM evi", EV, HO, DEC, EVI)
def hunt_timeline(s, d):
    a = decisions(s, d).select("user_id", "week", F.lit("decision").alias("what"), F.col("state").alias("detail"))
    return a.unionByName(evidence_rows(s, d).select("user_id", "week", F.lit("evidence").alias("what"), F.col("kind").alias("detail")))


@query("SELECT user_id, week, state FROM dc WHERE week >= 2819 AND week < 2822 AND state IN ('HIGH', 'CRITICAL')", EV, HO, DEC)
def decisions_range(s, d):
    """Decisions in a half-open range of weeks, of two states."""
    return decisions(s, d).where("week >= 2819 AND week < 2822 AND state IN ('HIGH', 'CRITICAL')").select("user_id", "week", "state")


@query("SELECT top_k, attack_name, count(*) AS alerts, min(week) AS first_week, max(week) AS last_week FROM dc WHERE state <> 'BENIGN' AND top_k IS NOT NULL GROUP BY 1, 2", EV, HO, DEC)
def incident_rollup(s, d):
    return decisions(s, d).where("state <> 'BENIGN' AND top_k IS NOT NULL").groupBy("top_k", "attack_name").agg(F.count("*").alias("alerts"), F.min("week").alias("first_week"), F.max("week").alias("last_week"))


@query("SELECT kind, state, count(*) AS decisions, count(DISTINCT user_id) AS devices FROM dc GROUP BY 1, 2", EV, HO, DEC)
def autonomy_summary(s, d):
    return decisions(s, d).groupBy("kind", "state").agg(F.count("*").alias("decisions"), F.countDistinct("user_id").alias("devices"))


@query("SELECT user_id, week, CASE WHEN week < (SELECT min(week) + 1 FROM dc) AND state IN ('CRITICAL', 'HIGH') THEN 'alert_only' ELSE state END AS shown FROM dc", EV, HO, DEC)
def grace_gate(s, d):
    """In the first week alerts are shown but nothing is recommended."""
    c = decisions(s, d)
    first = c.agg((F.min("week") + 1).alias("until"))
    return c.join(F.broadcast(first)).select("user_id", "week", F.when((F.col("week") < F.col("until")) & F.col("state").isin("CRITICAL", "HIGH"), "alert_only").otherwise(F.col("state")).alias("shown"))  # one row


@query("SELECT user_id, week, risk >= 2.8 OR state IN ('CRITICAL', 'HIGH') AS frozen FROM dc", EV, HO, DEC)
def poison_gate(s, d):
    """Weeks whose risk freezes learning."""
    return decisions(s, d).select("user_id", "week", ((F.col("risk") >= 2.8) | F.col("state").isin("CRITICAL", "HIGH")).alias("frozen"))


@query("SELECT a.user_id, count(*) AS erased FROM evi a SEMI JOIN (SELECT DISTINCT user_id FROM dc WHERE state = 'CRITICAL') b USING (user_id) GROUP BY 1", EV, HO, DEC, EVI)
def blast_radius(s, d):
    """Evidence rows that a reset of devices with a critical decision would take away."""
    bad = decisions(s, d).where("state = 'CRITICAL'").select("user_id").distinct()
    return evidence_rows(s, d).join(bad, "user_id", "left_semi").groupBy("user_id").agg(F.count("*").alias("erased"))


@query("SELECT user_id, week, kind FROM evi a ANTI JOIN (SELECT DISTINCT user_id FROM dc WHERE state = 'CRITICAL') b USING (user_id)", EV, HO, DEC, EVI)
def purge_device(s, d):
    bad = decisions(s, d).where("state = 'CRITICAL'").select("user_id").distinct()
    return evidence_rows(s, d).join(bad, "user_id", "left_anti").select("user_id", "week", "kind")


@query("SELECT top_k AS k, count(*) AS notes, max(week) AS week FROM dc WHERE tier = 5 AND top_k IS NOT NULL GROUP BY 1 HAVING max(week) >= (SELECT max(week) - 1 FROM dc)", EV, HO, DEC)
def rep_propagation(s, d):
    """Listed destinations seen lately, to be given out as evidence again."""
    c = decisions(s, d)
    last = c.agg((F.max("week") - 1).alias("least"))
    return c.where("tier = 5 AND top_k IS NOT NULL").groupBy(F.col("top_k").alias("k")).agg(F.count("*").alias("notes"), F.max("week").alias("week")).join(F.broadcast(last)).where("week >= least").drop("least")  # one row


@query("SELECT user_id, arg_max(state, week) AS state, max(week) AS week, max(week) FILTER (state IN ('CRITICAL', 'HIGH')) AS last_action FROM dc GROUP BY 1", EV, HO, DEC)
def active_actions(s, d):
    return decisions(s, d).groupBy("user_id").agg(F.max_by("state", "week").alias("state"), F.max("week").alias("week"), F.max(F.when(F.col("state").isin("CRITICAL", "HIGH"), F.col("week"))).alias("last_action"))


@query("SELECT user_id, week, 'recommend' AS action, week + 2 AS expires FROM dc WHERE state = 'CRITICAL' AND week + 2 > (SELECT max(week) FROM dc) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY week DESC) = 1", EV, HO, DEC)
def ledger_live(s, d):
    """Recommendations that have not run out: the newest of each device."""
    c = decisions(s, d)
    last = c.agg(F.max("week").alias("now"))
    live = c.where("state = 'CRITICAL'").join(F.broadcast(last)).where("week + 2 > now")  # one row
    return live.groupBy("user_id").agg(F.max("week").alias("week")).select("user_id", "week", F.lit("recommend").alias("action"), (F.col("week") + 2).alias("expires"))


assert {"decide", "hyp_scores"} <= set(QUERIES) and set(FIRINGS) <= set(SQL)
