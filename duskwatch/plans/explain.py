"""Plain words for a decision: what speaks for it, what could explain it away, and what to do next. Texts are tables of conditions and templates with slots in braces."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cycles import doubles

#: A sentence for each path of the decision.
PATH_TEXTS = {
    "hard_decoy": "it reached a decoy that nothing has reason to use", "hard_spoof": "another machine answered for the gateway", "hard_geofence": "it contacted a barred country and other evidence agrees",
    "geofence_alone": "it contacted a barred country", "hard_signature": "a known exploit was seen and other evidence agrees", "signature_alone": "a known exploit was seen once, with nothing beside it",
    "listed_verified": "its main destination {top_k} is on a verified list", "listed_two_sources": "its main destination {top_k} is listed and {sources} sources agree", "listed": "its main destination {top_k} is listed, unconfirmed",
    "independent_sources": "{sources} independent sources point to {attack_name}", "one_source": "the traffic looks like {attack_name}, unconfirmed", "suspect_destination": "its main destination {top_k} has a poor reputation",
    "anomaly_only": "it behaves unlike its peers", "quiet": "nothing stands out",
}
#: What each kind of evidence says.
EVIDENCE_TEXTS = {
    "rate": "{n} requests in a week", "entropy": "names that look random", "unique": "hardly a destination seen twice", "dga": "{errors} failed lookups", "tunnel": "signs of data in names", "evasion": "{unexplained} contacts without a lookup",
    "exfil": "an unusual volume sent", "beacon": "contacts at even intervals", "abuse": "{rejected} destinations that refused it", "sweep": "{targets} destinations touched", "long": "a very long connection", "scan": "scanning",
    "tls": "a client print of known malware", "lateral": "{moves} machines of the own network touched", "signature": "{alerts} signature alerts", "reputation": "a destination of bad repute", "decoy": "a decoy touched",
    "spoof": "the gateway's address changed", "geofence": "{geo} contacts to barred countries", "peer": "more traffic than its peers", "coordinated": "{others} other devices at the same destination", "discovery": "{signups} discovery messages",
}
#: Harmless explanations that are checked, in this order.
BENIGN_TEXTS = [
    ("kind IN (2, 3) AND familiarity >= 0.6", "the device often talks to this destination"), ("top_k BETWEEN 40 AND 59", "the destination belongs to a large provider"), ("signups >= 5", "local discovery is noisy"),
    ("tier <= 2", "the destination has a good reputation"), ("peers >= 3 AND n <= peer_mean", "its peers are as busy"),
]
#: Next steps in order of urgency.
ACTIONS = [
    ("state = 'CRITICAL'", "take device {user_id} off the network until it is checked"), ("c_lateral > 0 OR c_sweep > 0", "check the machines that it touched"), ("c_spoof > 0", "compare the gateway's hardware address with its label"),
    ("c_exfil >= 0.6", "find out what was sent to {top_k}"), ("c_reputation > 0 OR tier = 5", "look {top_k} up in another list"), ("state = 'HIGH' AND sources < 2", "wait for a second source before acting"),
    ("state = 'HIGH'", "ask who uses device {user_id} and for what"), ("state = 'SUSPICIOUS'", "watch the device for another week"), ("state = 'ANOMALOUS'", "nothing to do unless it lasts"),
]
#: Pieces of evidence and steps that are named at most.
MOST = 3


def filled(template: str) -> Column:
    """A template's text with the row's columns in its slots; an unknown value reads ``?``."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.lit(p) if k % 2 == 0 else F.coalesce(F.col(p).cast("string"), F.lit("?")) for k, p in enumerate(parts) if p or k % 2])


def texts(rules: list[tuple[str, str]]) -> Column:
    return F.array_compact(F.array(*[F.when(F.expr(doubles(c)), filled(t)) for c, t in rules]))


def explained(decisions: DataFrame) -> DataFrame:
    """``decisions`` other than benign ones with headline, reasons, benign and actions as text.

    Reasons are the MOST kinds of evidence with the highest confidence (of equal ones the first by name), each with its percentage; harmless explanations are all that hold; steps the MOST most
    urgent ones. Everything is a function of the row."""
    found = F.array(*[F.struct((-F.col(f"c_{k}")).alias("low"), F.lit(k).alias("kind"), filled(t).alias("text")) for k, t in EVIDENCE_TEXTS.items()])
    ranked = F.slice(F.array_sort(F.filter(found, lambda e: e["low"] < 0)), 1, MOST)
    reasons = F.transform(ranked, lambda e: F.concat(e["text"], F.lit(" ("), F.round(-e["low"] * 100).cast("int").cast("string"), F.lit(" %)")))
    path = F.coalesce(*[F.when(F.col("decision_path") == p, filled(t)) for p, t in PATH_TEXTS.items()], F.lit("nothing is known"))
    headline = F.concat(F.col("state"), F.lit(": device "), F.col("user_id").cast("string"), F.lit(", "), path)
    rows = decisions.where("state <> 'BENIGN'")
    return rows.select("*", headline.alias("headline"), F.array_join(reasons, "; ").alias("reasons"), F.array_join(texts(BENIGN_TEXTS), "; ").alias("harmless"), F.array_join(F.slice(texts(ACTIONS), 1, MOST), "; ").alias("actions"))
