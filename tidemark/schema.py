"""Spark types of the engine's tables and messages."""

from __future__ import annotations

from pyspark.sql import types as T

#: An observation as captured. ``observed_at`` keeps its text beside the parsed time; ``ingest_seq`` is the arrival order.
EVENT = "source string, event_id string, visit_id string, site string, site_epoch long, capture_epoch long, observed_at timestamp, kind string, title string, query string, secs long, ingest_seq long"
POLICY = "source string, consent boolean, paused boolean, recall_enabled boolean, selected_only boolean, selected_sites array<string>, excluded_sites array<string>, capture_epoch long"
SITE_RULE = "source string, rule string, epoch long, excluded boolean"
FEEDBACK = "seq long, atom string, action string, text string, time timestamp"
VECTOR = "atom string, model string, vector array<float>"
SPAN = "struct<kind:string,normalized:string,start:int,end:int,raw:string>"
ATOM_TOPIC = "atom string, topic string, mass double"
PACKET = "request_id string, position int, atom string, site string, text string, bytes int, status string, gap boolean"

ACTIONS = ("confirm_constraint", "wrong_topic", "not_about_me", "do_not_use", "temporary_research")
SCOPES = ("projects", "research", "confirmed_preferences")


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
