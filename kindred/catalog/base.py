"""Query registry and the input views over the given tables (Spark and SQL forms side by side)."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kindred.schemas import PREFERENCE_CHOICES, PREFERENCE_FIELDS

AS_OF = "2024-01-31 00:00:00"
# Values of a vector of the given table.
DIM = 64


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


@dataclass
class Query:
    run: Callable[[Views], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}

# Schemas read from the files once, until a file or folder changes, so that building a query starts no job for them.
_SCHEMAS: dict[tuple[str, int], StructType] = {}


def query(name: str, sql: str | None = None, **views: str):
    """Register ``run(views)``; ``sql`` may use the view names below, which become CTEs; ``views`` stand for some of them."""
    def register(run: Callable[[Views], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(run, with_views(sql, views) if sql else None)
        return run
    return register


class Views:
    """The model's tables, derived from the given ones; see the SQL twins in ``VIEWS_SQL``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        path = f"{self.dir}/{name}.parquet"
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        files = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        known = path, files.getFileStatus(where).getModificationTime()
        if known not in _SCHEMAS:
            _SCHEMAS[known] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(_SCHEMAS[known]).parquet(path)

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events")

    @cached_property
    def activity(self) -> DataFrame:
        return self.events.select(
            F.col("event_id").alias("message_id"), k().alias("community_id"), "user_id",
            F.col("ts").alias("created_at"))

    @cached_property
    def members(self) -> DataFrame:
        return self.activity.select("user_id", "community_id").distinct()

    @cached_property
    def places(self) -> DataFrame:
        return (self.table("nation").join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
                .select("n_nationkey", F.col("n_name").alias("city"), F.col("r_name").alias("timezone")))

    @cached_property
    def communities(self) -> DataFrame:
        v = F.col("vec_id")
        return (self.table("embeddings").join(self.places, F.col("n_nationkey") == v % 25)
                .select(v.alias("community_id"),
                        F.concat(F.lit("Community#"), v).alias("community_name"),
                        F.concat(F.lit("cat"), F.col("label")).alias("category"),
                        "city", "timezone", ((v * 37) % 50).cast("int").alias("member_count"),
                        F.when(v % 4 != 0, F.concat(F.lit("About topic "), F.col("label"))).alias("description"),
                        (v % 10 != 9).alias("is_active")))

    @cached_property
    def index(self) -> DataFrame:
        """The community vector index."""
        return self.table("embeddings").select(
            F.col("vec_id").alias("community_id"), F.col("embedding").alias("vector"))

    @cached_property
    def users(self) -> DataFrame:
        u = F.col("c_custkey")
        return (self.table("customer").join(self.places, F.col("n_nationkey") == F.col("c_nationkey"))
                .select(u.alias("user_id"), F.col("c_name").alias("username"), "city", "timezone",
                        (u % 11 != 3).alias("is_active"), F.col("c_nationkey").alias("place")))

    @cached_property
    def n_vectors(self) -> int:
        return self.table("embeddings").count()

    @cached_property
    def user_vectors(self) -> DataFrame:
        u = F.col("user_id")
        emb = self.table("embeddings").select("vec_id", "embedding")
        a = emb.select(F.col("vec_id").alias("_a"), F.col("embedding").alias("_va"))
        b = emb.select(F.col("vec_id").alias("_b"), F.col("embedding").alias("_vb"))
        w = F.when(u % 3 == 0, 1.0).when(u % 3 == 1, 0.5).otherwise(0.2)
        return (self.users.join(a, F.col("_a") == F.col("place") + 25 * (u % F.lit(self.n_vectors // 25)))
                .join(b, F.col("_b") == (u * 7 + 3) % self.n_vectors)
                .withColumn("_w", w)
                .select("user_id", "username", "city", "timezone",
                        F.zip_with("_va", "_vb", lambda x, y: F.col("_w") * x.cast("double")
                                   + (1 - F.col("_w")) * y.cast("double")).alias("vector")))

    @cached_property
    def ledger(self) -> DataFrame:
        """Every event is an award; from a day that depends on the user on it brings no points, so scores differ."""
        kind = F.col("event_type")
        start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
        counts = F.col("ts") < start + F.make_dt_interval(days=(1 + F.col("user_id") % 30).cast("int"))
        return self.events.select(
            F.col("event_id").alias("id"), "user_id", action_of(kind).alias("action_type"),
            F.when(counts, delta_of(kind)).otherwise(0).alias("point_delta"), k().alias("reference_id"),
            F.col("ts").alias("created_at"))

    @cached_property
    def shield(self) -> DataFrame:
        u = F.col("c_custkey")
        return self.table("customer").select(
            u.alias("user_id"), ((u % 5) * 100).cast("int").alias("threshold"))

    @cached_property
    def pref_patches(self) -> DataFrame:
        e = F.col("event_id")
        columns = []
        for i, field in enumerate(PREFERENCE_FIELDS):
            if field == "location":
                value = F.concat(F.lit("City"), F.col("user_id") % 10)
            else:
                choices = PREFERENCE_CHOICES[field]
                value = F.array(*[F.lit(c) for c in choices])[
                    (F.floor(e / 7) % len(choices)).cast("int")]
            columns.append(F.when(e % 7 == i, value).alias(field))
        return self.events.select(e.alias("seq"), "user_id", F.col("ts").alias("created_at"), *columns)

    @cached_property
    def change_events(self) -> DataFrame:
        kind, e = F.col("event_type"), F.col("event_id")
        return self.events.select(
            e, "ts", "user_id",
            F.when(kind == "signup", "user.created").when(kind.isin("view", "purchase"), "user.updated")
            .when(kind == "error", "user.deleted").otherwise("session.started").alias("type"),
            F.when(e % 5 != 0, F.concat(F.lit("u"), "user_id", F.lit("."), e, F.lit("@example.com"))).alias("email"),
            F.concat(F.lit("F"), e % 50).alias("first_name"),
            F.when(e % 3 != 0, F.concat(F.lit("L"), e % 40)).alias("last_name"),
            F.concat(F.lit('{"plan":"p'), k(), F.lit('"}')).alias("public_metadata"))

    @cached_property
    def change_messages(self) -> DataFrame:
        """The change events as JSON envelopes; every 97th message is cut in half."""
        c = self.change_events.withColumn("email_addresses", F.when(
            F.col("email").isNotNull(),
            F.array(F.struct(F.col("email").alias("email_address"), F.lit("e1").alias("id"))),
        ).otherwise(F.array().cast("array<struct<email_address:string,id:string>>")))
        data = F.struct(F.col("user_id").cast("string").alias("id"), "email_addresses", "first_name",
                        "last_name", F.parse_json("public_metadata").alias("public_metadata"))
        text = F.to_json(F.struct("type", data.alias("data")))
        return c.select("event_id", "ts", F.when(
            F.col("event_id") % 97 == 5, F.substring(text, 1, 40)).otherwise(text).alias("value"))

    @cached_property
    def profiles(self) -> DataFrame:
        return self.table("documents").select(
            F.col("doc_id").alias("user_id"), F.col("text").alias("bio"),
            F.array(F.concat(F.lit(" "), F.upper("lang"), F.lit(" ")), "lang", "source", F.lit(""))
            .alias("interest_tags"))

    @cached_property
    def toxicity(self) -> DataFrame:
        return self.table("labels").select(
            F.col("doc_id").alias("user_id"), F.when(F.col("toxic") == 1, 0.9).otherwise(0.1).alias("score"))

    @cached_property
    def connections(self) -> DataFrame:
        return self.events.select(
            "user_id", F.concat("user_id", F.lit("-"), k()).alias("sid"),
            (F.col("event_type") != "error").alias("connected"), "ts", "event_id")

    @cached_property
    def pairs(self) -> DataFrame:
        """Message attempts: every event's user writes to the user its ``k`` names, some unknown."""
        return self.events.select(
            F.col("event_id").alias("pair_id"), F.col("user_id").alias("sender_id"),
            F.when(k() >= 97, k() + 1_000_000_000).otherwise(k()).alias("target_id"))

    @cached_property
    def award_requests(self) -> DataFrame:
        """Awards with some bad rows: flipped signs, an unknown action, unknown users."""
        e = F.col("id")
        return self.ledger.select(
            "id", F.when(e % 53 == 1, F.col("user_id") + 1_000_000_000).otherwise(F.col("user_id")).alias("user_id"),
            F.when(e % 41 == 2, "BONUS").when(e % 43 == 3, "ADMIN_ADJUSTMENT")
            .otherwise(F.col("action_type")).alias("action_type"),
            F.when(e % 37 == 4, -F.col("point_delta")).when(e % 47 == 6, 0)
            .otherwise(F.col("point_delta")).cast("int").alias("point_delta"),
            "reference_id", "created_at")

    @cached_property
    def patch_requests(self) -> DataFrame:
        """Patches with some bad rows: foreign requester, bad choice, short location, empty."""
        e = F.col("seq")
        fields = [F.when(e % 61 == 7, F.lit(None)).otherwise(F.col(f)).alias(f) for f in PREFERENCE_FIELDS]
        base = self.pref_patches.select(
            "seq", F.when(e % 31 == 1, F.col("user_id") + 1).otherwise(F.col("user_id")).alias("requester_id"),
            "user_id", "created_at", *fields)
        return (base
                .withColumn("natural_rhythm", F.when(
                    F.col("natural_rhythm").isNotNull() & (e % 4 == 1), F.lit("Party all night"))
                    .otherwise(F.col("natural_rhythm")))
                .withColumn("location", F.when(
                    F.col("location").isNotNull() & (e % 5 == 2), F.lit(" A "))
                    .when(F.col("location").isNotNull() & (e % 5 == 3),
                          F.concat(F.lit("  "), "location", F.lit("\t")))
                    .otherwise(F.col("location"))))

    @cached_property
    def cache_events(self) -> DataFrame:
        kind, e = F.col("event_type"), F.col("event_id")
        return self.events.select(
            F.when(e % 3 == 0, "user").when(e % 3 == 1, "group").otherwise("query").alias("kind"),
            F.when(e % 3 == 1, k()).otherwise(F.col("user_id")).cast("string").alias("key"),
            F.when((kind == "error") & (e % 3 == 0), "invalidate").otherwise("set").alias("op"),
            "ts", F.col("event_id").alias("seq"), "value")


def k() -> Column:
    return F.get_json_object("props", "$.k").cast("long")


# Which award an event type stands for, and its points.
EVENT_AWARDS = [
    ("signup", "SIGNUP_EMAIL_VERIFY", 20),
    ("click", "EVENT_RSVP", 10),
    ("view", "GPS_CHECKIN", 25),
    ("purchase", "PEER_ENDORSEMENT", 20),
    ("error", "NO_SHOW_PENALTY", -10),
]


def action_of(kind: Column) -> Column:
    expr = F.lit(None).cast("string")
    for event, action, _ in EVENT_AWARDS:
        expr = F.when(kind == event, F.lit(action)).otherwise(expr)
    return expr


def delta_of(kind: Column) -> Column:
    expr = F.lit(None).cast("int")
    for event, _, points in EVENT_AWARDS:
        expr = F.when(kind == event, F.lit(points)).otherwise(expr)
    return expr


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _patch_columns() -> str:
    parts = []
    for i, field in enumerate(PREFERENCE_FIELDS):
        if field == "location":
            value = "'City' || (user_id % 10)"
        else:
            values = PREFERENCE_CHOICES[field]
            options = "[" + ", ".join(_text(v) for v in values) + "]"
            value = f"{options}[1 + (event_id // 7) % {len(values)}]"
        parts.append(f"CASE WHEN event_id % 7 = {i} THEN {value} END AS {field}")
    return ",\n  ".join(parts)


SINCE = f"TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY"
K_SQL = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
POPULARITY_SQL = "member_count DESC NULLS FIRST, message_count DESC NULLS FIRST, community_id"
WHITESPACE_SQL = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(28)||chr(29)||chr(30)||chr(31)||' '||chr(133)||chr(160)||chr(8195)||chr(12288)"
ALL_FIELDS_SQL = " AND ".join(f"{f} IS NOT NULL" for f in PREFERENCE_FIELDS)
LATEST_FIELDS_SQL = ", ".join(f"arg_max({f}, seq) AS {f}" for f in PREFERENCE_FIELDS)


def strip_sql(expr: str) -> str:
    return f"trim({expr}, {WHITESPACE_SQL})"


def tier_sql(s: str) -> str:
    return (f"CASE WHEN {s} >= 1000 THEN 'conqueror' WHEN {s} >= 500 THEN 'explorer' "
            f"WHEN {s} >= 300 THEN 'pathfinder' WHEN {s} >= 100 THEN 'beginner' END")


def label_sql(s: str) -> str:
    return (f"CASE WHEN {s} >= 1000 THEN 'Conqueror' WHEN {s} >= 500 THEN 'Explorer' "
            f"WHEN {s} >= 300 THEN 'Pathfinder' WHEN {s} >= 100 THEN 'Beginner' END")


def level_sql(s: str) -> str:
    return (f"CAST(CASE WHEN {s} >= 1000 THEN 4 WHEN {s} >= 500 THEN 3 "
            f"WHEN {s} >= 300 THEN 2 WHEN {s} >= 100 THEN 1 ELSE 0 END AS INTEGER)")


def next_sql(s: str) -> str:
    return (f"CAST(CASE WHEN {s} < 100 THEN 100 WHEN {s} < 300 THEN 300 WHEN {s} < 500 THEN 500 "
            f"WHEN {s} < 1000 THEN 1000 END AS INTEGER)")


VIEWS_SQL = {
    "profiles": """
        SELECT doc_id AS user_id, text AS bio, [' ' || upper(lang) || ' ', lang, source, ''] AS interest_tags
        FROM documents""",
    "activity": f"SELECT event_id AS message_id, {K_SQL} AS community_id, user_id, ts AS created_at FROM events",
    "members": "SELECT DISTINCT user_id, community_id FROM activity",
    "places": "SELECT n_nationkey, n_name AS city, r_name AS timezone FROM nation JOIN region ON n_regionkey = r_regionkey",
    "communities": """
        SELECT vec_id AS community_id, 'Community#' || vec_id AS community_name, 'cat' || label AS category,
               city, timezone, CAST((vec_id * 37) % 50 AS INTEGER) AS member_count,
               CASE WHEN vec_id % 4 <> 0 THEN 'About topic ' || label END AS description,
               vec_id % 10 <> 9 AS is_active, embedding AS vector
        FROM embeddings JOIN places ON n_nationkey = vec_id % 25""",
    "users": """
        SELECT c_custkey AS user_id, c_name AS username, city, timezone, c_custkey % 11 <> 3 AS is_active,
               c_nationkey AS place
        FROM customer JOIN places ON n_nationkey = c_nationkey""",
    "user_vectors": """
        SELECT user_id, username, city, timezone,
               list_transform(list_zip(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])),
                              lambda x: CAST(w AS DOUBLE) * x[1] + (1 - CAST(w AS DOUBLE)) * x[2]) AS vector
        FROM (SELECT *, CAST(CASE user_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.2 END AS DOUBLE) AS w FROM users) u
        JOIN embeddings a ON a.vec_id = u.place + 25 * (u.user_id % ((SELECT count(*) FROM embeddings) // 25))
        JOIN embeddings b ON b.vec_id = (u.user_id * 7 + 3) % (SELECT count(*) FROM embeddings)""",
    "ledger": f"""
        SELECT event_id AS id, user_id,
               CASE event_type {" ".join(f"WHEN '{e}' THEN '{a}'" for e, a, _ in EVENT_AWARDS)} END AS action_type,
               CAST(CASE WHEN ts < TIMESTAMP '2024-01-01' + to_days(CAST(1 + user_id % 30 AS INTEGER)) THEN
                 CASE event_type {" ".join(f"WHEN '{e}' THEN {p}" for e, _, p in EVENT_AWARDS)} END ELSE 0 END AS INTEGER) AS point_delta,
               {K_SQL} AS reference_id, ts AS created_at
        FROM events""",
    "shield": "SELECT c_custkey AS user_id, CAST((c_custkey % 5) * 100 AS INTEGER) AS threshold FROM customer",
    "karma": """
        SELECT u.user_id, CAST(coalesce(s, 0) AS BIGINT) AS karma_score
        FROM users u LEFT JOIN (SELECT user_id, sum(point_delta) AS s FROM ledger GROUP BY 1) t USING (user_id)""",
    "pref_patches": f"SELECT event_id AS seq, user_id, ts AS created_at, {_patch_columns()} FROM events",
    "change_events": f"""
        SELECT event_id, ts, user_id,
               CASE WHEN event_type = 'signup' THEN 'user.created' WHEN event_type IN ('view', 'purchase') THEN 'user.updated'
                    WHEN event_type = 'error' THEN 'user.deleted' ELSE 'session.started' END AS type,
               CASE WHEN event_id % 5 <> 0 THEN 'u' || user_id || '.' || event_id || '@example.com' END AS email,
               'F' || (event_id % 50) AS first_name,
               CASE WHEN event_id % 3 <> 0 THEN 'L' || (event_id % 40) END AS last_name,
               '{{"plan":"p' || {K_SQL} || '"}}' AS public_metadata
        FROM events""",
    "toxicity": "SELECT doc_id AS user_id, CASE WHEN toxic = 1 THEN 0.9::DOUBLE ELSE 0.1::DOUBLE END AS score FROM labels",
    "connections": f"""
        SELECT user_id, user_id || '-' || {K_SQL} AS sid, event_type <> 'error' AS connected, ts, event_id FROM events""",
    "live": """
        SELECT user_id, sid FROM (
          SELECT *, row_number() OVER (PARTITION BY user_id, sid ORDER BY ts DESC, event_id DESC) AS rn FROM connections)
        WHERE rn = 1 AND connected""",
    "pairs": f"""
        SELECT event_id AS pair_id, user_id AS sender_id,
               CASE WHEN {K_SQL} >= 97 THEN {K_SQL} + 1000000000 ELSE {K_SQL} END AS target_id FROM events""",
    "award_requests": """
        SELECT id, CASE WHEN id % 53 = 1 THEN user_id + 1000000000 ELSE user_id END AS user_id,
               CASE WHEN id % 41 = 2 THEN 'BONUS' WHEN id % 43 = 3 THEN 'ADMIN_ADJUSTMENT' ELSE action_type END AS action_type,
               CAST(CASE WHEN id % 37 = 4 THEN -point_delta WHEN id % 47 = 6 THEN 0 ELSE point_delta END AS INTEGER) AS point_delta,
               reference_id, created_at
        FROM ledger""",
    "checked_awards": """
        SELECT r.*, CASE WHEN action_type = 'BONUS' THEN 'unknown action'
            WHEN action_type = 'NO_SHOW_PENALTY' AND point_delta > 0 THEN 'penalty must be negative'
            WHEN action_type NOT IN ('NO_SHOW_PENALTY', 'ADMIN_ADJUSTMENT') AND point_delta < 0 THEN 'reward must be positive'
            WHEN u.user_id IS NULL THEN 'unknown user' END AS reason
        FROM award_requests r LEFT JOIN users u USING (user_id)""",
    "patch_requests": f"""
        SELECT seq, CASE WHEN seq % 31 = 1 THEN user_id + 1 ELSE user_id END AS requester_id, user_id, created_at,
          CASE WHEN seq % 61 = 7 OR location IS NULL THEN NULL WHEN seq % 5 = 2 THEN ' A '
               WHEN seq % 5 = 3 THEN '  ' || location || chr(9) ELSE location END AS location,
          CASE WHEN seq % 61 = 7 OR natural_rhythm IS NULL THEN NULL WHEN seq % 4 = 1 THEN 'Party all night'
               ELSE natural_rhythm END AS natural_rhythm,
          {", ".join(f"CASE WHEN seq % 61 = 7 THEN NULL ELSE {f} END AS {f}" for f in PREFERENCE_FIELDS if f not in ("location", "natural_rhythm"))}
        FROM pref_patches""",
    "checked_patches": f"""
        SELECT r.* REPLACE ({strip_sql("location")} AS location),
          CASE WHEN length({strip_sql("location")}) NOT BETWEEN 2 AND 100 THEN 'location length'
               WHEN natural_rhythm = 'Party all night' THEN 'natural_rhythm not a choice'
               WHEN coalesce({", ".join(PREFERENCE_FIELDS)}) IS NULL THEN 'empty patch'
               WHEN requester_id <> r.user_id THEN 'forbidden'
               WHEN u.user_id IS NULL THEN 'not found' END AS reason
        FROM patch_requests r LEFT JOIN (SELECT user_id FROM users WHERE is_active) u USING (user_id)""",
    "cache_events": f"""
        SELECT CASE event_id % 3 WHEN 0 THEN 'user' WHEN 1 THEN 'group' ELSE 'query' END AS kind,
               CAST(CASE WHEN event_id % 3 = 1 THEN {K_SQL} ELSE user_id END AS VARCHAR) AS key,
               CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'invalidate' ELSE 'set' END AS op,
               ts, event_id AS seq, value
        FROM events""",
    "recent": f"SELECT community_id, count(*) AS message_count FROM activity WHERE created_at >= {SINCE} GROUP BY 1",
    "scored_communities": """
        SELECT c.*, r.message_count, coalesce(r.message_count, 0) AS recent_activity
        FROM communities c LEFT JOIN recent r USING (community_id)""",
    "popular": f"""
        SELECT *, row_number() OVER (ORDER BY {POPULARITY_SQL}) AS pos FROM scored_communities WHERE is_active
        QUALIFY pos <= 5""",
    "candidates": f"""
        SELECT *, row_number() OVER (PARTITION BY city, timezone ORDER BY {POPULARITY_SQL}) AS candidate_rank
        FROM scored_communities WHERE is_active QUALIFY candidate_rank <= 1000""",
    "sims": """
        SELECT u.user_id, c.community_id, c.community_name, c.category, c.member_count, c.recent_activity,
               round(list_cosine_similarity(u.vector, CAST(c.vector AS DOUBLE[])), 12) AS score
        FROM user_vectors u JOIN candidates c USING (city, timezone)""",
    "ranked": """
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, community_id) AS rn
        FROM sims QUALIFY rn <= 20""",
    "flagged": """
        SELECT r.*, h.head, h.n, h.mixed, h.first_other
        FROM ranked r JOIN (
          SELECT user_id, max(head) AS head, count(*) AS n, bool_or(rn <= 3 AND category <> head) AS mixed,
                 min(CASE WHEN rn >= 4 AND category <> head THEN rn END) AS first_other
          FROM (SELECT *, first_value(category) OVER (PARTITION BY user_id ORDER BY rn) AS head FROM ranked)
          GROUP BY user_id) h USING (user_id)""",
    "reranked": """
        SELECT *, CAST(CASE WHEN n >= 4 AND NOT mixed AND first_other IS NOT NULL AND rn = first_other THEN 3
                       WHEN n >= 4 AND NOT mixed AND first_other IS NOT NULL AND rn >= 3 AND rn < first_other THEN rn + 1
                       ELSE rn END AS INTEGER) AS new_rank
        FROM flagged""",
    "tiers": """
        SELECT u.user_id, CASE WHEN score > 0.87 THEN 'soulmate' WHEN score >= 0.55 THEN 'explorer' ELSE 'fallback' END AS tier,
               CASE WHEN score > 0.87 THEN community_id END AS auto_joined_community
        FROM user_vectors u LEFT JOIN (SELECT * FROM reranked WHERE new_rank = 1) t USING (user_id)""",
    "emitted": """
        SELECT t.user_id, t.tier, r.new_rank AS position, r.community_id, r.category, r.member_count,
               r.recent_activity, round(greatest(0.0, least(1.0, r.score)), 6) AS match_score
        FROM tiers t JOIN reranked r USING (user_id)
        WHERE (tier = 'soulmate' AND new_rank = 1) OR (tier = 'explorer' AND new_rank <= 5)
        UNION ALL
        SELECT t.user_id, t.tier, CAST(p.pos AS INTEGER), p.community_id, p.category, p.member_count,
               p.recent_activity, CAST(0 AS DOUBLE)
        FROM tiers t JOIN popular p ON t.tier = 'fallback'""",
    "results": """
        SELECT t.user_id, t.tier, t.auto_joined_community,
               t.tier = 'soulmate' AND m.user_id IS NULL AND coalesce(x.score, 0) < 0.75 AS ai_intro_generated,
               t.tier = 'fallback' AS requires_profile_update
        FROM tiers t
        LEFT JOIN members m ON m.user_id = t.user_id AND m.community_id = t.auto_joined_community
        LEFT JOIN toxicity x ON x.user_id = t.user_id""",
}
_ORDER = list(VIEWS_SQL)
# Views that others name several times and that are dear to compute: computed once.
_ONCE = {"user_vectors", "scored_communities", "candidates", "sims", "ranked", "flagged", "reranked", "tiers", "emitted", "results"}


def with_views(body: str, instead: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with the CTEs of the views it names, directly or through other views."""
    views = {**VIEWS_SQL, **(instead or {})}
    needed: set[str] = set()
    pending = [body]
    while pending:
        text = pending.pop()
        for name in _ORDER:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                pending.append(views[name])
    ctes = ",\n".join(f"{name} AS {'MATERIALIZED ' if name in _ONCE else ''}({views[name].strip()})"
                      for name in _ORDER if name in needed)
    if not ctes:
        return body.strip()
    body = body.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
