"""Scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from kindred.catalog.base import (
    DIM, SINCE, as_of, label_sql, level_sql, next_sql, query, strip_sql, tier_sql)
from kindred.functions import karma as K
from kindred.functions import matching as M
from kindred.functions import text as X
from kindred.functions.vectors import cosine
from kindred.operators import phrases
from kindred.plans import ledger, matching
from kindred.schemas import INTRO_MAX_CHARS, TIER_UNLOCKS, tier_unlocks
from kindred.sources import messages

EMAIL_SQL = r"'\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b', '[email removed]', 'g'"
PHONE_SQL = r"'\b\d{3}[-.]?\d{3}[-.]?\d{4}\b', '[phone removed]', 'g'"
TOKEN_BREAK_SQL = r"[\t\n\x0b\f\r !-/:-@\[-`{-~]+"
BIO_SQL = "CASE WHEN user_id % 7 = 0 THEN bio || ' 555-123-4567' ELSE bio END"
MASKED_SQL = f"regexp_replace(regexp_replace({BIO_SQL}, {EMAIL_SQL}), {PHONE_SQL})"


def bios(v):
    """The texts; every seventh ends in a phone number."""
    return v.profiles.withColumn("bio", F.when(
        F.col("user_id") % 7 == 0, F.concat("bio", F.lit(" 555-123-4567"))).otherwise(F.col("bio")))


@query("x01_mask_emails", f"SELECT user_id, regexp_replace(bio, {EMAIL_SQL}) AS bio FROM profiles")
def x01(v):
    return v.profiles.select("user_id", X.mask_emails(F.col("bio")).alias("bio"))


@query("x02_mask_phones", f"SELECT user_id, {MASKED_SQL} AS bio FROM profiles")
def x02(v):
    return bios(v).select("user_id", X.mask_pii(F.col("bio")).alias("bio"))


@query("x03_pii_found", f"SELECT user_id, {MASKED_SQL} <> {BIO_SQL} AS pii_removed FROM profiles")
def x03(v):
    return bios(v).select("user_id", (X.mask_pii(F.col("bio")) != F.col("bio")).alias("pii_removed"))


TAGS_SQL = f"list_sort(list_distinct(list_filter(list_transform(interest_tags, lambda t: lower({strip_sql('t')})), lambda t: length(t) > 0)))"


@query("x04_normalize_tags", f"SELECT user_id, array_to_string({TAGS_SQL}, ',') AS tags FROM profiles")
def x04(v):
    return v.profiles.select("user_id", F.array_join(X.normalize_tags(F.col("interest_tags")), ",").alias("tags"))


ENRICHED_SQL = f"""list_sort(list_distinct(list_concat({TAGS_SQL}, list_filter([
    {", ".join(f"CASE WHEN list_contains(regexp_split_to_array(lower(bio), '[^a-z0-9]+'), '{w}') THEN '{t}' END" for w, t in X.TAG_RULES)}
  ], lambda t: t IS NOT NULL))))"""


@query("x05_enrich_tags", f"SELECT user_id, array_to_string({ENRICHED_SQL}, ',') AS tags FROM profiles")
def x05(v):
    tags = X.enrich_tags(F.col("bio"), X.normalize_tags(F.col("interest_tags")))
    return v.profiles.select("user_id", F.array_join(tags, ",").alias("tags"))


# A rule of one to three words from every text: those from its second word on.
PHRASE_RULES_SQL = """
    SELECT DISTINCT array_to_string(w[2:2 + user_id % 3], ' ') AS phrase, CAST(1 + user_id % 3 AS INTEGER) AS n,
           'topic' || (user_id % 40) AS tag
    FROM (SELECT user_id, list_filter(regexp_split_to_array(lower(bio), '[^a-z0-9]+'), lambda t: t <> '') AS w FROM profiles)
    WHERE len(w) >= 2 + user_id % 3"""


def phrase_rules(v):
    n = (F.col("user_id") % 3).cast("int")
    words = v.profiles.select("user_id", phrases.words_of(F.col("bio")).alias("w")).filter(F.size("w") >= 2 + n)
    # Written as a user may write them: in capitals, with other marks between the words.
    return words.select(F.upper(F.array_join(F.slice("w", F.lit(2), 1 + n), " - ")).alias("phrase"),
                        F.concat(F.lit("topic"), F.col("user_id") % 40).alias("tag"))


@query("x05_phrase_tags", f"""
    WITH rules AS MATERIALIZED ({PHRASE_RULES_SQL}),
    w AS MATERIALIZED (SELECT user_id, {TAGS_SQL} AS own,
                         list_filter(regexp_split_to_array(lower(bio), '[^a-z0-9]+'), lambda t: t <> '') AS w FROM profiles),
    placed AS (SELECT user_id, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM w),
    following AS (SELECT user_id, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM placed WINDOW o AS (PARTITION BY user_id ORDER BY i)),
    grams AS MATERIALIZED (
      SELECT DISTINCT user_id, 1 AS n, a AS phrase FROM following
      UNION ALL SELECT DISTINCT user_id, 2, a || ' ' || b FROM following WHERE b IS NOT NULL
      UNION ALL SELECT DISTINCT user_id, 3, a || ' ' || b || ' ' || c FROM following WHERE c IS NOT NULL),
    found AS (SELECT g.user_id, list(DISTINCT tag) AS tags FROM grams g JOIN rules r ON r.n = g.n AND r.phrase = g.phrase GROUP BY 1)
    SELECT w.user_id, array_to_string(list_sort(list_distinct(list_concat(own, coalesce(tags, [])))), ',') AS tags
    FROM w LEFT JOIN found USING (user_id)""")
def x05_phrases(v):
    """Phrases of one to three words, as many rules as there are texts."""
    tagged = v.profiles.withColumn("interest_tags", X.normalize_tags(F.col("interest_tags")))
    return phrases.enrich(tagged, phrase_rules(v)).select("user_id", F.array_join("enriched_tags", ",").alias("tags"))


@query("x06_embedding_text", f"""
    SELECT user_id, 'Bio: ' || bio || chr(10) || 'Interests: ' || array_to_string({TAGS_SQL}, ', ') AS embedding_text FROM profiles""")
def x06(v):
    return v.profiles.select("user_id", X.embedding_text(
        F.col("bio"), X.normalize_tags(F.col("interest_tags"))).alias("embedding_text"))


@query("x07_cosine", """
    SELECT u.user_id, round(list_cosine_similarity(u.vector, CAST(c.embedding AS DOUBLE[])), 6) AS similarity
    FROM user_vectors u JOIN embeddings c ON c.vec_id = u.user_id % (SELECT count(*) FROM embeddings)""")
def x07(v):
    index = v.index.withColumnRenamed("vector", "other")
    pairs = v.user_vectors.join(index, F.col("community_id") == F.col("user_id") % v.n_vectors)
    return pairs.select("user_id", F.round(cosine(F.col("vector"), F.col("other")), 6).alias("similarity"))


@query("x08_match_tier", """
    SELECT event_id, score, CASE WHEN score > 0.87 THEN 'soulmate' WHEN score >= 0.55 THEN 'explorer' ELSE 'fallback' END AS tier
    FROM (SELECT event_id, (event_id % 101) / 100.0::DOUBLE AS score FROM events)""")
def x08(v):
    score = F.col("event_id") % 101 / 100.0
    return v.events.select("event_id", score.alias("score"), M.match_tier(score).alias("tier"))


@query("x09_karma_tier", f"SELECT user_id, karma_score, {tier_sql('karma_score')} AS tier FROM karma")
def x09(v):
    return ledger.scores(v.users, v.ledger).withColumn("tier", K.tier(F.col("karma_score")))


@query("x10_next_threshold", f"SELECT user_id, {next_sql('karma_score')} AS next_tier_threshold FROM karma")
def x10(v):
    return ledger.scores(v.users, v.ledger).select(
        "user_id", K.next_threshold(F.col("karma_score")).alias("next_tier_threshold"))


@query("x11_level_label", f"SELECT user_id, {level_sql('karma_score')} AS tier_level, {label_sql('karma_score')} AS tier_label FROM karma")
def x11(v):
    s = F.col("karma_score")
    return ledger.scores(v.users, v.ledger).select(
        "user_id", K.tier_level(s).alias("tier_level"), K.tier_label(s).alias("tier_label"))


@query("x12_unlocked_features", f"""
    SELECT user_id, feature FROM karma JOIN (VALUES {", ".join(f"({lv}, '{ft}')" for lv, ft in TIER_UNLOCKS)}) f(lvl, feature)
    ON lvl <= {level_sql('karma_score')}""")
def x12(v):
    profile = ledger.with_tier(ledger.scores(v.users, v.ledger))
    return ledger.unlocks(profile, tier_unlocks(v.spark)).select("user_id", "feature")


ELIGIBLE_SQL = """
    SELECT pair_id, s >= t AND s >= h AS allowed, CAST(s AS BIGINT) AS sender_score, CAST(t AS BIGINT) AS target_score,
           CAST(h AS INTEGER) AS target_inbox_shield,
           CASE WHEN s < t THEN 'Your karma (' || s || ') is below the recipient''s karma (' || t || '). You can only message users with equal or lower karma.'
                WHEN s < h THEN 'The recipient''s inbox shield requires a minimum karma of ' || h || '. Your karma is ' || s || '.' END AS reason
    FROM (SELECT pair_id, coalesce(a.karma_score, 0) AS s, coalesce(b.karma_score, 0) AS t, coalesce(x.threshold, 0) AS h
          FROM pairs p LEFT JOIN karma a ON a.user_id = p.sender_id LEFT JOIN karma b ON b.user_id = p.target_id
          LEFT JOIN shield x ON x.user_id = p.target_id)"""


@query("x13_eligibility_reason", f"SELECT pair_id, allowed, reason FROM ({ELIGIBLE_SQL})")
def x13(v):
    return ledger.eligibility(v.pairs, ledger.scores(v.users, v.ledger), v.shield).select("pair_id", "allowed", "reason")


@query("x14_channel_name", "SELECT user_id, 'match_updates_' || user_id AS channel, CAST(user_id AS VARCHAR) AS back FROM users")
def x14(v):
    named = v.users.select("user_id", messages.channel(F.col("user_id")).alias("channel"))
    return named.withColumn("back", messages.channel_user(F.col("channel")))


@query("x15_json_round_trip", """
    SELECT event_id, user_id, event_type AS tier FROM events""")
def x15(v):
    text = v.events.select("event_id", F.to_json(F.struct("user_id", F.col("event_type").alias("tier"))).alias("j"))
    return text.select("event_id", F.from_json("j", "user_id long, tier string").alias("r")).select("event_id", "r.*")


@query("x16_primary_email", "SELECT event_id, email FROM change_events WHERE event_id % 97 <> 5")
def x16(v):
    return messages.parse_change_events(v.change_messages).select("event_id", "email")


@query("x17_default_intro", """
    SELECT community_id, 'Welcome to ' || community_name || '! We''re excited to have you here.' AS intro_text,
           length('Welcome to ' || community_name || '! We''re excited to have you here.') <= 300 AS fits FROM communities""")
def x17(v):
    intro = X.default_introduction(F.col("community_name"))
    return v.communities.select("community_id", intro.alias("intro_text"),
                                (F.length(intro) <= INTRO_MAX_CHARS).alias("fits"))


@query("x18_member_to_mention", f"""
    SELECT c.community_id, m.username AS mentioned_member FROM communities c LEFT JOIN (
      SELECT community_id, username FROM (
        SELECT m.community_id, u.username, u.user_id, count(a.message_id) AS n FROM users u JOIN members m USING (user_id)
        LEFT JOIN activity a ON a.user_id = u.user_id AND a.community_id = m.community_id AND a.created_at >= {SINCE} GROUP BY 1, 2, 3)
      QUALIFY row_number() OVER (PARTITION BY community_id ORDER BY n DESC, user_id) = 1) m USING (community_id)""")
def x18(v):
    first = matching.active_members(v.users, v.members, v.activity, as_of(), k=1)
    return v.communities.join(first, "community_id", "left").select(
        "community_id", F.col("username").alias("mentioned_member"))


@query("x19_display", """
    SELECT user_id, position, printf('%.0f%%', match_score * 100) AS percent,
           upper(tier[1]) || tier[2:] AS tier, format('{:,}', member_count * 997) AS members FROM emitted""")
def x19(v):
    """Match results as shown: whole percent, capitalised tier, member count with separators."""
    candidates = matching.location_candidates(v.communities, v.activity, as_of())
    popular = matching.popular_communities(v.communities, v.activity, as_of())
    results = matching.decide(matching.top_matches(v.user_vectors, candidates, v.index, dim=DIM, population=v.users), popular)
    return matching.explode_matches(results, "user_id", "tier").select(
        "user_id", "position", X.percent(F.col("match_score")).alias("percent"), F.initcap("tier").alias("tier"),
        X.with_separators(F.col("member_count") * 997).alias("members"))


@query("x20_null_default", """
    SELECT event_id, CAST(coalesce(CASE WHEN event_id % 5 <> 1 THEN user_id END, 0) AS BIGINT) AS user_or_zero,
           coalesce(CASE WHEN event_id % 3 = 2 THEN value END, 0) AS value_or_zero FROM events""")
def x20(v):
    e = F.col("event_id")
    return v.events.select(
        "event_id", F.coalesce(F.when(e % 5 != 1, F.col("user_id")), F.lit(0)).cast("long").alias("user_or_zero"),
        F.coalesce(F.when(e % 3 == 2, F.col("value")), F.lit(0.0)).alias("value_or_zero"))


@query("x21_score_default", """
    SELECT c.community_id, coalesce(CASE WHEN c.community_id % 3 = 0 THEN 0.25::DOUBLE END,
           CASE WHEN c.community_id % 3 = 1 THEN c.member_count / 100 END, 0.0::DOUBLE) AS match_score, recent_activity
    FROM scored_communities c""")
def x21(v):
    c = F.col("community_id")
    scored = (matching.with_recent_activity(v.communities, v.activity, as_of())
              .withColumn("given", F.when(c % 3 == 0, F.lit(0.25)))
              .withColumn("match_score", F.when(c % 3 == 1, F.col("member_count") / 100)))
    return scored.select("community_id", M.score_or_default(F.col("given"), F.col("match_score")).alias("match_score"),
                         "recent_activity")
