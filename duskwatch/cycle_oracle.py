"""The DuckDB side of the device cycles, written by hand and apart from the plan's rule tables: detectors, hypotheses and the decision."""

from __future__ import annotations


def detector_sql(source: str, out: str) -> str:
    """CTEs that give every detector's confidence for the features in ``source``."""
    return f"""{out}_a AS (SELECT *,
   round(targets / n::DOUBLE, 6) AS unique_ratio,
   (longest > 8 AND entropy > 1.6e0)::INTEGER AS t_encoded, (targets > 13)::INTEGER AS t_fanout, (10 * views > 3 * n)::INTEGER AS t_txt, (100 * clicks > 35 * n)::INTEGER AS t_tld,
   round(if(n < 15, 0e0, if(n >= 30, 1e0, n / 30e0)), 6) AS c_rate,
   round(if(entropy <= 1.6e0, 0e0, least(1e0, (entropy - 1.6e0) / 0.6e0)), 6) AS c_entropy,
   round(if(n > 4 AND 10 * targets > 9 * n, targets / n::DOUBLE, 0e0), 6) AS c_unique,
   round(if(errors > 4, least(1e0, 0.6e0 + errors / 20e0), if(errors > 2 AND entropy > 1.5e0, 0.6e0, if(10 * errors > 4 * n AND user_id % 5 <> 0, errors / n::DOUBLE, 0e0))), 6) AS c_dga,
   if(top_k IS NOT NULL AND top_k >= 20 AND top_k < 40, 0e0, if(z > 2e0 AND total > 900e0, if(user_id % 5 = 1, 0.5e0, 0.9e0), if(z > 1e0 AND total > 600e0, if(user_id % 5 = 1, 0.35e0, 0.6e0),
     if(z > 0e0 AND total > 1000e0, if(user_id % 5 = 1, 0.25e0, 0.55e0), 0e0)))) AS c_exfil,
   if(n > 3 AND gap_cv < 0.6e0 AND gap_mean > 20000e0, 0.7e0, 0e0) AS b_slow,
   round(if(n > 5 AND share > 0.25e0, least(1e0, share * 2.5e0) * if(user_id % 5 = 0, 0.1e0, 1e0), 0e0), 6) AS b_single,
   if(n > 4 AND gap_cv < 0.8e0, if(user_id % 5 = 1, 0.3e0, 0.55e0), 0e0) AS b_jitter,
   round(if(rejected >= 4 AND targets >= 6, if(errors >= 6, 0.9e0, 0.6e0) / if(errors >= 2 * rejected AND 2 * errors >= n, 2e0, 1e0), 0e0), 6) AS c_abuse,
   round(if(targets < 15, 0e0, least(1e0, 0.5e0 + 0.05e0 * (targets - 15))), 6) AS c_sweep,
   if(top > 300e0, 0.85e0, if(top > 200e0, 0.5e0, 0e0)) AS c_long, if(tls >= 1, 0.95e0, 0e0) AS c_tls, if(decoys >= 1 AND user_id % 10 <> 7, 1e0, 0e0) AS c_decoy,
   if(flips >= 1, 1e0, 0e0) AS c_spoof, if(moves > 1, 0.9e0, 0e0) AS c_lateral, if(signups > 4, 0.7e0, 0e0) AS c_discovery,
   if(user_id % 9 = 0 OR geo < 2, 0e0, if(geo = 2, 0.7e0, 0.95e0)) AS c_geofence, if(alerts = 0, 0e0, if(alerts = 1, 0.75e0, 0.98e0)) AS c_signature,
   if(risk >= 3.4e0, 0.95e0, if(risk >= 2.8e0, 0.8e0, 0e0)) AS c_reputation,
   round(if(5 * unexplained > n, least(1e0, 0.3e0 + 0.4e0 * unexplained / n + if(errors = 0, 0.2e0, 0e0) + if(risk >= 2.8e0, 0.3e0, 0e0) - 0.5e0 * familiarity * 0.2e0), 0e0), 6) AS c_evasion,
   round(if(n > 4 AND peers > 2 AND n >= 1.4e0 * peer_mean, least(1e0, n / (3e0 * peer_mean)), 0e0), 6) AS c_peer,
   round(if(others > 5 AND share > 0.15e0, least(0.95e0, 0.4e0 + 0.05e0 * others), 0e0), 6) AS c_coordinated FROM {source}),
 {out} AS (SELECT *, t_encoded + t_fanout + t_txt + t_tld AS tags, round(if(t_encoded + t_fanout + t_txt + t_tld = 0, 0e0, least(0.95e0, 0.3e0 + 0.2e0 * (t_encoded + t_fanout + t_txt + t_tld))), 6) AS c_tunnel,
   greatest(b_slow, b_single, b_jitter) AS c_beacon,
   if(greatest(b_slow, b_single, b_jitter) = 0, 'none', if(b_single = greatest(b_slow, b_single, b_jitter), 'single_target', if(b_slow >= b_jitter, 'slow', 'jitter'))) AS beacon_tag,
   greatest(c_abuse, c_sweep, c_long) AS c_scan, c_dga > 0 OR c_exfil > 0.5e0 OR c_abuse > 0 OR b_single > 0.6e0 OR c_lateral > 0 AS attack_shaped FROM {out}_a)"""


def decision_sql(source: str, out: str, strong: str = "0.85e0", partial: str = "0.6e0", hard: str = "0.9e0", sources: str = "2", risk: str = "1.5e0") -> str:
    """CTEs that decide the evidence in ``source``: scores by bands (nothing, gate only, third rung, fourth rung), winners, the young destination's lift, and the ladder of paths."""
    good = "tier IN (0, 1, 2)"
    return f"""{out}_h AS (SELECT *,
   if(c_rate = 0 OR c_entropy = 0, 0, if({good} OR c_unique = 0, 2, if(tier = 4, 4, 3))) AS h_dns_tunnelling,
   if(c_lateral = 0 AND c_tls = 0, 0, if({good}, 2, if(c_lateral > 0 AND c_discovery = 0, 4, if(c_tls > 0, 3, 2)))) AS h_intrusion,
   if(c_dga = 0, 0, if({good} OR c_dga < {partial}, 2, if(c_dga >= {strong} AND n >= 19, 4, 3))) AS h_dga_botnet,
   if(c_exfil = 0, 0, if({good}, 2, if(c_exfil >= {strong}, 4, if(c_exfil >= {partial} OR c_beacon > 0 OR c_reputation > 0, 3, 2)))) AS h_exfiltration,
   if(c_beacon = 0, 0, if({good} OR beacon_tag <> 'single_target' OR c_exfil + c_reputation + c_tls = 0, 2, if(c_beacon >= {strong}, 4, 3))) AS h_beaconing,
   if(c_tunnel = 0, 0, if(c_tunnel >= {strong} AND tier IN (3, 4), 4, if(tags > 1 AND NOT {good}, 3, 2))) AS h_covert_tunnelling,
   if(c_coordinated = 0, 0, if({good} OR c_coordinated < {partial}, 2, if(c_coordinated >= {strong} AND others > 2, 4, 3))) AS h_coordinated_targeting,
   if(c_scan = 0, 0, if({good} OR c_scan < {partial}, 2, if(c_scan >= {strong}, 4, 3))) AS h_connection_abuse,
   if(c_evasion = 0, 0, if({good} OR 2 * unexplained < n OR c_evasion < 0.5e0, 2, if(c_beacon + c_exfil + c_reputation > 0, 4, 3))) AS h_dns_evasion,
   if(c_signature = 0, 0, if({good}, 2, if(c_signature >= {strong}, 4, 3))) AS h_signature_match,
   if(c_peer = 0 OR NOT attack_shaped, 0, if({good} OR c_peer < 0.5e0, 2, 3)) AS h_peer_deviation,
   if(n > 10 AND tier = 2, if(entropy > 1.4e0, 3, 4), 0) AS h_advertising_burst, if(c_discovery > 0, 2.5e0, 0e0) AS h_local_discovery,
   if(user_id % 5 IN (2, 3) AND n > 8 AND NOT attack_shaped AND ({good} OR familiarity >= 0.6e0), if(familiarity >= 0.6e0, 3e0, 2.5e0), 0e0) AS h_device_profile,
   (greatest(c_rate, c_entropy, c_dga, c_tunnel, c_evasion) >= 0.6e0)::INTEGER + (greatest(c_exfil, c_beacon, c_scan) >= 0.6e0)::INTEGER + (greatest(c_lateral, c_tls, c_signature) >= 0.6e0)::INTEGER
     + (c_reputation >= 0.6e0)::INTEGER + (c_decoy >= 0.6e0)::INTEGER AS sources FROM {source}),
 {out}_w AS (SELECT *, list_max([h_dns_tunnelling, h_intrusion, h_dga_botnet, h_exfiltration, h_beaconing, h_covert_tunnelling, h_coordinated_targeting, h_connection_abuse, h_dns_evasion, h_signature_match, h_peer_deviation])::DOUBLE AS top_attack,
   greatest(h_advertising_burst, h_local_discovery, h_device_profile)::DOUBLE AS benign FROM {out}_h),
 {out}_n AS (SELECT *, top_attack + if(young AND sources >= 2 AND top_attack >= 2 AND top_attack > benign, 1e0, 0e0) AS attack,
   if(top_attack = 0, 'DIRECT_IOC_HIT', ['dns_tunnelling', 'intrusion', 'dga_botnet', 'exfiltration', 'beaconing', 'covert_tunnelling', 'coordinated_targeting', 'connection_abuse', 'dns_evasion', 'signature_match', 'peer_deviation'][
     list_position([h_dns_tunnelling, h_intrusion, h_dga_botnet, h_exfiltration, h_beaconing, h_covert_tunnelling, h_coordinated_targeting, h_connection_abuse, h_dns_evasion, h_signature_match, h_peer_deviation], top_attack::INTEGER)]) AS attack_name,
   if(benign = 0, 'UNKNOWN_BENIGN', if(h_advertising_burst = benign, 'advertising_burst', if(h_local_discovery = benign, 'local_discovery', 'device_profile'))) AS benign_name FROM {out}_w),
 {out}_p AS (SELECT *, if(c_decoy = 1, 'hard_decoy', if(flips > 0 AND coalesce(spoof_age, 1e9) <= 241920, 'hard_spoof',
   if(c_geofence > 0 AND geo_age <= 241920, if(sources > 0 AND attack > benign, 'hard_geofence', 'geofence_alone'),
   if(c_signature >= {hard} AND alert_age <= 241920, if(sources - (greatest(c_lateral, c_tls) < 0.6e0)::INTEGER > 0 AND attack > benign, 'hard_signature', 'signature_alone'),
   if(tier = 5, if(verified, 'listed_verified', if(sources >= {sources} AND attack > benign, 'listed_two_sources', 'listed')),
   if(attack > benign AND attack >= 2, if(attack >= 3 AND sources >= {sources}, 'independent_sources', 'one_source'),
   if(tier = 4 AND risk >= {risk}, 'suspect_destination', if(c_peer > 0.45e0, 'anomaly_only', 'quiet')))))))) AS decision_path FROM {out}_n),
 {out}_v AS (SELECT * FROM (VALUES ('hard_decoy', 'CRITICAL', 1e0), ('hard_spoof', 'CRITICAL', 1e0), ('hard_geofence', 'CRITICAL', 0.95e0), ('geofence_alone', 'HIGH', 0.7e0), ('hard_signature', 'CRITICAL', 0.98e0), ('signature_alone', 'HIGH', 0.75e0),
   ('listed_verified', 'CRITICAL', 0.99e0), ('listed_two_sources', 'CRITICAL', 0.85e0), ('listed', 'SUSPICIOUS', 0.45e0), ('independent_sources', 'HIGH', 0.85e0), ('one_source', 'SUSPICIOUS', 0.4e0), ('suspect_destination', 'SUSPICIOUS', 0.45e0),
   ('anomaly_only', 'ANOMALOUS', 0.1e0), ('quiet', 'BENIGN', 0e0)) v(decision_path, state, confidence)),
 {out} AS (SELECT * FROM {out}_p JOIN {out}_v USING (decision_path))"""
