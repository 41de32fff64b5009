"""Column names of the raw exports and of our tables."""

from __future__ import annotations

import re

from pyspark.sql import types as T

# Raw headers.
RAW_USERS = {
    "Id": ("id", "bigint"),
    "Date Joined": ("date_joined", "string"),
    "Levels Completed": ("levels_completed", "int"),
    "Signed Up": ("signed_up", "boolean"),
    "Paid Subscription": ("paid_subscription", "boolean"),
    "Country": ("country", "string"),
    "How old are you?": ("age", "string"),
}
RAW_LEVELS = {
    "User Id": ("user_id", "bigint"),
    "Created": ("created", "string"),
    "Level": ("level", "string"),
    "Date Completed": ("date_completed", "string"),
    "Playtime (s)": ("playtime", "bigint"),
    "Code Language": ("code_language", "string"),
    "Practice": ("practice", "boolean"),
}
RAW_CAMPAIGNS = {"Campaign": ("campaign", "string"), "Level": ("level", "string")}
# Columns whose text is a time; they stay text until cleaning.
TIMES = ("date_joined", "created", "date_completed")
INDEX_RESIDUE = "Unnamed: 0"
CORRUPT = "_corrupt_record"
# Event lines have no header of their own; their typed columns by our names.
RAW_EVENTS = {"created": ("created", "string"), "user_id": ("user_id", "bigint")}


def event_schema(payload: int = 4) -> T.StructType:
    """Positional event columns: four used ones and the payload."""
    names = ["created", "user_id", "event_name", "level"]
    names += [f"raw_event{i + 1}" for i in range(payload)]
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def survey_name(header: str) -> str:
    """Column name of a survey answer."""
    return "survey_" + re.sub(r"[^a-z0-9]+", "_", header.lower()).strip("_")
