"""Feeds, rulesets, sinks, change points and forests on small files."""

import gzip
import json

import numpy as np

from duskwatch.plans import cycles
from duskwatch.sources import feeds
from duskwatch.streaming import anomaly, changepoints


def test_feed_shapes(spark, tmp_path):
    files = {
        "ip_csv": "# list\n8.8.8.8,0.9\n8.8.4.4\nnot an address\n8.8.8.8,0.9\n", "hostfile": "127.0.0.1 localhost\n0.0.0.0 Bad.example.com\n# x\n",
        "url_csv": '"1","2024","http://Bad.example/x?y=1"\n', "typed_csv": "domain,Evil.example,0.7\ncolour,red,1\nip,9.9.9.9,oops\n",
    }
    got = {}
    for shape, text in files.items():
        (tmp_path / shape).write_text(text)
        got[shape] = sorted((r["kind"], r["value"], r["confidence"]) for r in feeds.feed(spark, str(tmp_path / shape), shape, "f").collect())
    assert got == {
        "ip_csv": [("ip", "8.8.4.4", 0.8), ("ip", "8.8.8.8", 0.9)], "hostfile": [("domain", "bad.example.com", 0.8)],
        "url_csv": [("url", "bad.example/x", 0.8)], "typed_csv": [("domain", "evil.example", 0.7), ("ip", "9.9.9.9", 0.8)],
    }
    fresh, last = (feeds.feed(spark, str(tmp_path / x), x, "f") for x in ("hostfile", "ip_csv"))
    assert feeds.valid_or_last(fresh, last, 2) is last and feeds.valid_or_last(last, fresh, 2) is last


def test_rules(spark):
    rules = ['alert tcp any any -> 8.8.8.8 80 (content:"ev|69 6c|.example.com"; classtype:trojan-activity;)', "alert ip 10.0.0.1 any -> 192.168.1.1 any (classtype:x;)", "# alert 9.9.9.9", ""]
    got = sorted(tuple(r) for r in feeds.rule_indicators(spark.createDataFrame([(r,) for r in rules], "value string")).collect())
    assert got == [("domain", "evil.example.com", "trojan-activity"), ("ip", "8.8.8.8", "trojan-activity")]


def test_streams_sinks_and_archive(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    row = lambda i, day: json.dumps({"id": i % 3, "ts": f"2024-01-{day:02d}T10:00:00", "v": i})
    (folder / "a.json").write_text("\n".join(row(i, 1 + i) for i in range(4)))
    schema = "id long, ts timestamp, v long, missing string"

    def drain():
        for q in (feeds.alert_sink(feeds.log_stream(spark, str(folder), schema), str(tmp_path / "out"), str(tmp_path / "c1")), feeds.upsert(feeds.log_stream(spark, str(folder), schema), str(tmp_path / "state"), "id", str(tmp_path / "c2"))):
            q.awaitTermination()

    drain()
    (folder / "b.json").write_text(row(10, 9))
    drain()
    assert spark.read.json(str(tmp_path / "out")).count() == 5
    assert sorted(r["v"] for r in feeds.newest_alerts(spark, str(tmp_path / "out"), 6).collect()) == [3, 10]
    assert sorted((r["id"], r["v"]) for r in spark.read.parquet(str(tmp_path / "state" / "version=1")).collect()) == [(0, 3), (1, 10), (2, 2)]
    stay = feeds.archive(spark.read.schema(schema).json(str(folder)), str(tmp_path / "old"), "2024-01-03 00:00:00")
    assert stay.count() == 3 and sum(len(gzip.open(f).read().splitlines()) for f in (tmp_path / "old").glob("*.gz")) == 2


def test_change_points_and_forest(spark):
    rng = np.random.default_rng(2)
    rows = [(u, d, float(rng.normal(10, 1) + (40 if u == 1 and d >= 30 else 0))) for u in (1, 2) for d in range(60)]
    hit = changepoints.change_points(spark.createDataFrame(rows, "user_id long, day long, total double")).collect()
    assert {r["user_id"] for r in hit} == {1} and min(r["day"] for r in hit) in (30, 31)
    points = [(i, 0, float(rng.normal()), float(rng.normal())) for i in range(400)] + [(999, 0, 9.0, -9.0), (1000, 0, None, 1.0)]
    df = spark.createDataFrame(points, "id long, g long, x double, y double")
    got = {r["id"]: r["score"] for r in anomaly.group_scores(df, "g", ["x", "y"], ["id"]).collect()}
    assert max((v, k) for k, v in got.items() if v is not None and v == v)[1] == 999 and (got[1000] is None or got[1000] != got[1000])
    assert all(0 < v < 1 for k, v in got.items() if k != 1000)


def test_decision_paths_by_hand(spark):
    """Worked cases of every path of the decision, each a quiet cycle with what the case names."""
    base = dict(user_id=1, week=0, n=10, errors=0, views=1, clicks=1, buys=0, signups=0, targets=5, rejected=0, total=100.0, top=50.0, entropy=1.0, longest=5, top_k=45, most_n=2, moves=0, decoys=0, geo=0, tls=0, alerts=0,
                unexplained=0, gap_mean=100.0, gap_cv=2.0, others=1, kind=2, z=0.0, share=0.2, peers=5, peer_mean=10.0, familiarity=0.0, tier=3, verified=False, risk=0.0, flips=0, geo_age=None, alert_age=None, spoof_age=None, young=False)
    cases = [
        ("hard_decoy", dict(decoys=1)), ("hard_decoy", dict(decoys=1, tier=5, verified=True)), ("quiet", dict(decoys=1, user_id=7)), ("hard_spoof", dict(flips=1, spoof_age=0.0)), ("quiet", dict(flips=1, spoof_age=250_000.0)),
        ("hard_geofence", dict(geo=2, geo_age=0.0, moves=3)), ("geofence_alone", dict(geo=2, geo_age=10.0)), ("quiet", dict(geo=2, geo_age=300_000.0)),
        ("hard_signature", dict(alerts=2, alert_age=0.0, total=700.0, z=1.5)), ("hard_signature", dict(alerts=2, alert_age=0.0, moves=3)), ("signature_alone", dict(alerts=2, alert_age=0.0)),
        ("listed_verified", dict(tier=5, verified=True)), ("listed_two_sources", dict(tier=5, moves=3, total=700.0, z=1.5)), ("listed", dict(tier=5, moves=3)), ("listed", dict(tier=5)),
        ("independent_sources", dict(moves=3, total=700.0, z=1.5)), ("one_source", dict(moves=3)), ("one_source", dict(tier=1, moves=3)), ("suspect_destination", dict(tier=4, risk=2.0)), ("quiet", dict(tier=4, risk=1.0)),
        ("anomaly_only", dict(n=20, peer_mean=12.0, views=0, clicks=0, c="peer")), ("quiet", {}),
    ]
    rows = [{**base, **{k: v for k, v in case.items() if k != "c"}, "week": k} for k, (_, case) in enumerate(cases)]
    kinds = {int: "long", float: "double", bool: "boolean"}
    schema = ", ".join(f"{k} {'double' if v is None else kinds[type(v)]}" for k, v in base.items())
    frame = spark.createDataFrame([tuple(r[k] for k in base) for r in rows], schema)
    got = {r["week"]: r["decision_path"] for r in cycles.decided(cycles.detected(frame)).collect()}
    assert [(k, got[k]) for k in got if got[k] != cases[k][0]] == []


def test_scores_follow_the_ladders(spark):
    """Hand-worked scores: what lifts a hypothesis from 2 to 3 and to 4, and what keeps it down."""
    zero = {c: 0.0 for c in [*cycles.DETECTORS, *cycles.COMPOSED] if c[:2] in ("c_", "b_")}
    base = {**zero, "user_id": 1, "n": 10, "tier": 3, "tags": 0, "beacon_tag": "none", "others": 1, "unexplained": 0, "entropy": 1.0, "kind": 1, "familiarity": 0.0, "risk": 0.0, "verified": False, "young": False,
            "attack_shaped": False, "geo_age": 0.0, "alert_age": 0.0, "spoof_age": 0.0}
    single = dict(beacon_tag="single_target")
    cases = [
        ("beaconing", dict(c_beacon=0.9, **single), 2), ("beaconing", dict(c_beacon=0.9, c_dga=0.9, **single), 2), ("beaconing", dict(c_beacon=0.7, c_tls=0.95, **single), 3), ("beaconing", dict(c_beacon=0.9, c_exfil=0.5, **single), 4),
        ("beaconing", dict(c_beacon=0.9, c_exfil=0.5, beacon_tag="slow"), 2), ("beaconing", dict(c_beacon=0.9, c_exfil=0.5, tier=2, **single), 2),
        ("dga_botnet", dict(c_dga=0.5), 2), ("dga_botnet", dict(c_dga=0.7, n=30), 3), ("dga_botnet", dict(c_dga=0.9, n=18), 3), ("dga_botnet", dict(c_dga=0.85, n=19), 4), ("dga_botnet", dict(c_dga=0.9, n=30, tier=0), 2),
        ("exfiltration", dict(c_exfil=0.5), 2), ("exfiltration", dict(c_exfil=0.3, c_beacon=0.3), 3), ("exfiltration", dict(c_exfil=0.6, c_reputation=0.8), 3), ("exfiltration", dict(c_exfil=0.85), 4), ("exfiltration", dict(c_exfil=0.9, tier=1), 2),
    ]
    kinds = {int: "int", float: "double", bool: "boolean", str: "string"}
    frame = spark.createDataFrame([tuple({**base, **case}[k] for k in base) + (k,) for k, (_, case, _) in enumerate(cases)], ", ".join(f"{k} {kinds[type(v)]}" for k, v in base.items()) + ", week int")
    got = {r["week"]: r.asDict() for r in cycles.decided(frame).collect()}
    assert [(cases[k], r[f"h_{cases[k][0]}"]) for k, r in got.items() if r[f"h_{cases[k][0]}"] != cases[k][2]] == []
