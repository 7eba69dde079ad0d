"""Declared table schemas and the fixed value domains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

S, I, B, D = T.StringType(), T.IntegerType(), T.BooleanType(), T.DoubleType()
NTZ, TS = T.TimestampNTZType(), T.TimestampType()
VECTOR = T.ArrayType(T.FloatType())


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


TABLES: dict[str, T.StructType] = {
    "communities": _struct(
        community_id=S, community_name=S, category=S, city=S, timezone=S, member_count=I,
        description=S, is_active=B, created_at=NTZ),
    "community_members": _struct(user_id=S, community_id=S, joined_at=NTZ, auto_joined=B),
    "community_activity": _struct(message_id=S, community_id=S, user_id=S, created_at=NTZ),
    "users": _struct(
        user_id=S, username=S, bio=S, created_at=NTZ, email=S, first_name=S, last_name=S,
        public_metadata=S, is_active=B, inbox_shield_threshold=I),
    "karma_ledger": _struct(
        id=S, user_id=S, point_delta=I, action_type=S, reference_id=S, created_at=TS),
    "user_preferences": _struct(
        user_id=S, location=S, recharge_method=S, natural_rhythm=S, ideal_group_size=S,
        weekend_trip=S, weekend_env=S, background_vibe=S, onboarding_complete=B,
        created_at=TS, updated_at=TS),
    "community_vectors": _struct(community_id=S, vector=VECTOR),
    "cached_vectors": _struct(id=S, vector=VECTOR, cached_at=TS),
}

PROFILE = _struct(user_id=S, bio=S, interest_tags=T.ArrayType(S), city=S, timezone=S)

USER_PAYLOAD = _struct(
    id=S,
    email_addresses=T.ArrayType(_struct(email_address=S, id=S)),
    first_name=S,
    last_name=S,
    public_metadata=T.VariantType(),
)

# Award actions, and which of them take points away.
KARMA_ACTIONS = [
    "SIGNUP_EMAIL_VERIFY",
    "SIGNUP_PROFILE_PHOTO",
    "SIGNUP_VIBE_QUESTIONS",
    "SIGNUP_CLAIM_ID",
    "EVENT_RSVP",
    "GPS_CHECKIN",
    "EVENT_PHOTO_POST",
    "PEER_ENDORSEMENT",
    "HOST_EVENT",
    "NO_SHOW_PENALTY",
    "HOST_CANCEL_PENALTY",
    "NEGATIVE_REVIEW_PENALTY",
    "ADMIN_ADJUSTMENT",
]
PENALTY_ACTIONS = ["NO_SHOW_PENALTY", "HOST_CANCEL_PENALTY", "NEGATIVE_REVIEW_PENALTY"]
ADMIN_ACTION = "ADMIN_ADJUSTMENT"

# Tier name, label, lowest score, level.
KARMA_TIERS = [
    ("beginner", "Beginner", 100, 1),
    ("pathfinder", "Pathfinder", 300, 2),
    ("explorer", "Explorer", 500, 3),
    ("conqueror", "Conqueror", 1000, 4),
]

# Level at which a feature unlocks; the names are our own.
TIER_UNLOCKS = [
    (1, "dm_peers"),
    (1, "rsvp_events"),
    (1, "claim_id"),
    (2, "private_group_chats"),
    (3, "host_public_events"),
    (3, "advanced_networking"),
    (4, "premium_ui"),
    (4, "custom_id_colors"),
    (4, "algo_boost"),
]

# Documented points per action, the cap, and what the cap counts within
# ("once" = ever, "day" = calendar day, "reference" = one event; None = uncapped).
AWARD_RULES = [
    ("SIGNUP_EMAIL_VERIFY", 20, 1, "once"),
    ("SIGNUP_PROFILE_PHOTO", 30, 1, "once"),
    ("SIGNUP_VIBE_QUESTIONS", 30, 1, "once"),
    ("SIGNUP_CLAIM_ID", 20, 1, "once"),
    ("EVENT_RSVP", 10, 3, "day"),
    ("GPS_CHECKIN", 25, 1, "reference"),
    ("EVENT_PHOTO_POST", 15, 2, "reference"),
    ("PEER_ENDORSEMENT", 20, None, None),
]

# Preference fields and the choices of each.
PREFERENCE_CHOICES = {
    "recharge_method": [
        "Hitting the town",
        "Quiet evening at home",
        "Small dinner with close friends",
        "Getting outdoors",
    ],
    "natural_rhythm": ["Early bird", "Night owl", "Comfortably in between"],
    "ideal_group_size": [
        "The more the merrier",
        "3-4 close friends",
        "Just me and one other",
        "Riding solo",
    ],
    "weekend_trip": ["Detailed itinerary", "Completely spontaneous", "Loose framework"],
    "weekend_env": [
        "City streets and nightlife",
        "Quiet cabin in the woods",
        "Sunny beach or poolside",
        "Cozy coffee shop",
    ],
    "background_vibe": ["Loud music and high energy", "Soft background chatter", "Absolute silence"],
}
PREFERENCE_FIELDS = ["location", *PREFERENCE_CHOICES]

# Match tiers and thresholds.
SOULMATE, EXPLORER, FALLBACK = "soulmate", "explorer", "fallback"
SOULMATE_ABOVE = 0.87
EXPLORER_FROM = 0.55
TOXICITY_LIMIT = 0.75
INTRO_MAX_CHARS = 300
# Candidates of a location that are scored at all; the rest are dropped by popularity before scoring.
CANDIDATE_CAP = 1000
TOP_K = 20
PAGE_LIMIT = 100
# Values of a vector of the index.
VECTOR_DIM = 1536
EMIT_EXPLORER = 5
POPULAR_K = 5
INTRO_MEMBERS = 5
ACTIVITY_DAYS = 7

# Cache lifetimes in seconds.
USER_VECTOR_TTL = 604800
GROUP_VECTOR_TTL = 86400
QUERY_RESULT_TTL = 900

CHANNEL_PREFIX = "match_updates_"


def tier_unlocks(spark: SparkSession) -> DataFrame:
    """The unlocks as an inline relation."""
    values = ", ".join(f"({level}, '{feature}')" for level, feature in TIER_UNLOCKS)
    return spark.sql(f"SELECT * FROM VALUES {values} AS unlocks(level, feature)")
