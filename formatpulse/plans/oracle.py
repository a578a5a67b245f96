"""The same bindings as ANSI SQL: named CTEs and a helper that chains the needed ones."""

from __future__ import annotations

import math

from formatpulse.functions.text import DEFAULT_FORMAT, FORMAT_RULES, STOPWORDS, UNINFORMATIVE
from formatpulse.operators import scoring as SC
from formatpulse.plans.bindings import (
    COUNTRIES, EVENTS_NOW, LANGUAGES, LEVELS, NICHES, ORDER_PLATFORMS, ORDERS_NOW, PHRASES, TYPES,
)

E_NOW = f"TIMESTAMP '{EVENTS_NOW}'"
T_NOW = f"TIMESTAMP '{ORDERS_NOW}'"


def nth(values: tuple[str, ...], index: str) -> str:
    cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"(CASE {index} {cases} END)"


def clamp(x: str) -> str:
    return f"greatest(0.0, least(1.0, {x}))"


def log_scale(x: str, m: float) -> str:
    return (f"(CASE WHEN {x} <= 0 THEN 0.0 ELSE "
            f"{clamp(f'ln(1.0::DOUBLE + {x}) / {2 * math.log1p(m)!r}::DOUBLE')} END)")


def log_ratio(x: str, m: float, decades: float = 1.5) -> str:
    inner = clamp(f"0.5 + log10({x} / {float(m)!r}::DOUBLE) / {2 * decades!r}::DOUBLE")
    return f"(CASE WHEN {x} <= 0 THEN 0.0 ELSE {inner} END)"


def logistic(x: str, m: float, k: float) -> str:
    return f"(1.0::DOUBLE / (1.0 + exp({-k!r}::DOUBLE * ({x} - {m!r}::DOUBLE))))"


def hours(a: str, b: str) -> str:
    return f"((epoch_us({b}) - epoch_us({a})) / 3600000000.0::DOUBLE)"


def rnd(x: str, digits: int) -> str:
    """Nearest multiple of 10^-digits of the exact binary value, exact halves to even."""
    x, scale = f"(({x})::DOUBLE)", f"{float(10**digits)!r}::DOUBLE"
    y, split = f"({x} * {scale})", f"({x} * 134217729.0::DOUBLE)"
    high = f"({split} - ({split} - {x}))"
    error = f"(({high} * {scale} - {y}) + ({x} - {high}) * {scale})"
    return (f"(CASE WHEN {y} - floor({y}) = 0.5 AND {error} > 0 THEN floor({y}) + 1"
            f" WHEN {y} - floor({y}) = 0.5 AND {error} < 0 THEN floor({y})"
            f" WHEN {y} - floor({y}) = 0.5 THEN 2 * round({y} / 2) ELSE round({y}) END"
            f" / {scale} + 0.0::DOUBLE)")


def pick(x: str, table: dict[str, float], default: float) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {v!r}::DOUBLE" for k, v in table.items())
    return f"(CASE {x} {cases} ELSE {default!r}::DOUBLE END)"


def ranked_list(attr: str) -> str:
    return f"""COALESCE((SELECT list(value ORDER BY n DESC, s, i) FROM ranked r
        WHERE r.trend_id = b.trend_id AND r.attr = '{attr}'), []::VARCHAR[])"""


_TREND = {
    "view_velocity": log_scale("median_velocity", 2500),
    "growth_rate": logistic("growth_7d", 0.25, 2.6),
    "engagement_rate": clamp("avg_engagement_rate / (base * 2)"),
    "conversation": clamp("median_conversation / 0.06::DOUBLE"),
    "creator_normalized": logistic("median_creator_lift", 1.8, 1.1),
    "creator_adoption": log_scale("creator_count", 30),
    "cross_platform": clamp("len(platforms) / 3.0::DOUBLE"),
    "recency": "pow(0.5::DOUBLE, greatest(0.0, median_age_hours) / 96.0::DOUBLE)",
    "consistency": "lift_consistency",
}
_CHANCE = {
    "growth": "s_growth_rate", "engagement": "s_engagement_rate",
    "low_competition": "(1.0 - sat)", "recency": "s_recency",
    "cross_platform": "s_cross_platform",
    "adaptability": pick("adaptability", SC.ADAPTABILITY_SCORE, 0.25),
    "ease_of_production": pick("production_difficulty", SC.EASE, 0.6),
}


def _sum(parts: dict[str, str], weights: dict[str, float]) -> str:
    return "100.0::DOUBLE * (" + " + ".join(
        f"{w!r}::DOUBLE * {parts[k]}" for k, w in weights.items()) + ")"


def _rules() -> tuple[str, str]:
    label, beats = "CASE", "CASE"
    for pattern, name, steps in FORMAT_RULES:
        quoted = pattern.replace("'", "''")
        label += f" WHEN regexp_matches(haystack, '{quoted}') THEN '{name}'"
        beats += f" WHEN regexp_matches(haystack, '{quoted}') THEN '{'|'.join(steps)}'"
    name, steps = DEFAULT_FORMAT
    return label + f" ELSE '{name}' END", beats + f" ELSE '{'|'.join(steps)}' END"


def useful(x: str) -> str:
    words = ", ".join(f"'{w}'" for w in UNINFORMATIVE)
    return f"(CASE WHEN {x} IS NULL OR lower(trim({x})) IN ({words}) THEN '' ELSE {x} END)"


STOP_SQL = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"
VEC = "embedding::DOUBLE[]"
_LABEL, _BEATS = _rules()
_PLATFORM = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ORDER_PLATFORMS.items())

# name -> (CTEs it reads, body)
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "ev": ((), """SELECT event_id, ts, user_id, event_type, value,
        CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
        CAST(round(value * 1000) AS BIGINT) AS views FROM events"""),
    "members": (("ev",), f"""SELECT event_type || '#' || CAST(k % 10 AS VARCHAR) AS trend_id,
        event_id AS item_id, user_id AS creator_id,
        CASE event_type WHEN 'click' THEN 'tiktok'
          WHEN 'view' THEN {nth(('tiktok', 'youtube'), 'user_id % 2')}
          WHEN 'error' THEN 'youtube' WHEN 'signup' THEN 'instagram'
          ELSE {nth(('tiktok', 'youtube', 'instagram'), 'user_id % 3')} END AS platform,
        {nth(NICHES, 'user_id % (k % 5 + 1)')} AS niche,
        {nth(COUNTRIES, 'user_id % 3')} AS country,
        {nth(LANGUAGES, 'user_id % (k % 3 + 1)')} AS language,
        {nth(TYPES, 'event_id % 3')} AS content_type,
        ts AS published_at, 5.0::DOUBLE + event_id % 120 AS duration_sec,
        user_id * 10000 + 1000 AS followers,
        CASE WHEN user_id % 2 = 0 THEN user_id * 100 + 20000 ELSE 0 END AS baseline,
        views, views * (k % 10) // 100 AS likes, views * (user_id % 5) // 200 AS comments,
        views * (k % 7) // 300 AS shares, views * (event_id % 4) // 400 AS saves,
        {nth(LEVELS, '(event_id + k) % 4')} AS production_difficulty,
        (event_id * 37 % 1000) / 1000.0::DOUBLE AS similarity FROM ev"""),
    "metrics": (("members",), f"""
        SELECT item_id, {E_NOW} AS captured_at, views FROM members
        UNION ALL SELECT item_id, {E_NOW} - INTERVAL 24 HOUR, views * (75 + item_id % 40) // 100
          FROM members WHERE item_id % 7 <> 0
        UNION ALL SELECT item_id, {E_NOW} - INTERVAL 48 HOUR, views * (55 + item_id % 20) // 100
          FROM members WHERE item_id % 7 <> 0 AND item_id % 5 <> 0"""),
    "points": (("metrics",), """SELECT item_id,
        max(CASE WHEN r = 1 THEN t END) AS t2, max(CASE WHEN r = 1 THEN v END) AS v2,
        max(CASE WHEN r = 2 THEN t END) AS t1, max(CASE WHEN r = 2 THEN v END) AS v1,
        max(CASE WHEN r = 3 THEN t END) AS t0, max(CASE WHEN r = 3 THEN v END) AS v0
        FROM (SELECT item_id, captured_at AS t, views AS v, row_number() OVER (
          PARTITION BY item_id ORDER BY captured_at DESC, views DESC) AS r FROM metrics)
        WHERE r <= 3 GROUP BY item_id"""),
    "signals": (("members", "points"), f"""SELECT m.*,
        CASE WHEN t2 > t1 THEN greatest(0.0, (v2 - v1) / {hours('t1', 't2')})
          ELSE views / greatest(1.0, {hours('published_at', E_NOW)}) END AS velocity,
        CASE WHEN t2 > t1 AND t1 > t0 THEN greatest(0.0, (v1 - v0) / {hours('t0', 't1')}) END AS prior_rate,
        CASE WHEN t2 > t1 AND t1 > t0 THEN greatest(0.0, (v2 - v1) / {hours('t1', 't2')}) END AS recent_rate,
        CASE WHEN views = 0 THEN 0.0 ELSE (likes + comments + shares + saves) / views::DOUBLE END AS engagement,
        CASE WHEN views = 0 THEN 0.0 ELSE (3 * shares + 2 * comments + 2 * saves) / views::DOUBLE END AS conversation,
        views / COALESCE(NULLIF(baseline, 0), greatest(1, CAST(floor(followers * 0.08::DOUBLE) AS BIGINT)))::DOUBLE AS lift,
        {hours('published_at', E_NOW)} AS age_hours
        FROM members m LEFT JOIN points p USING (item_id)"""),
    "ranked": (("members",), " UNION ALL ".join(
        f"""SELECT trend_id, '{name}' AS attr, {col} AS value, count(*) AS n,
        min(struct_pack(s := -similarity, i := item_id)).s AS s,
        min(struct_pack(s := -similarity, i := item_id)).i AS i
        FROM members WHERE COALESCE({col}, '') <> '' GROUP BY trend_id, {col}"""
        for col, name in (("platform", "platforms"), ("niche", "niches"), ("country", "countries"),
                          ("language", "languages"), ("content_type", "content_types")))),
    "difficulty": (("members",), """SELECT trend_id, arg_min(production_difficulty, o) AS d FROM (
        SELECT trend_id, production_difficulty, -count(*) * 10 + CASE production_difficulty
          WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 ELSE 3 END AS o
        FROM members WHERE COALESCE(production_difficulty, '') <> ''
        GROUP BY trend_id, production_difficulty) GROUP BY trend_id"""),
    "base": (("signals",), f"""SELECT trend_id, count(*) AS video_count,
        count(DISTINCT creator_id) AS creator_count, CAST(sum(views) AS BIGINT) AS total_views,
        CAST(sum(views) AS BIGINT) // count(*) AS avg_views,
        avg(engagement) AS avg_engagement_rate,
        CAST(floor(median(views)) AS BIGINT) AS median_views, median(velocity) AS median_velocity,
        median(lift) AS median_creator_lift, median(conversation) AS median_conversation,
        median(duration_sec) AS median_duration_sec, median(age_hours) AS median_age_hours,
        CAST(floor(median(followers)) AS BIGINT) AS median_followers,
        count(*) FILTER ({hours('published_at', E_NOW)} <= 168) AS recent,
        count(*) FILTER ({hours('published_at', E_NOW)} > 168 AND {hours('published_at', E_NOW)} <= 336) AS prior,
        COALESCE(sum(recent_rate), 0.0) AS rr, COALESCE(sum(prior_rate), 0.0) AS pr,
        avg(lift) AS mean_lift, stddev_pop(lift) AS spread, min(published_at) AS first_published_at
        FROM signals GROUP BY trend_id"""),
    "aggs": (("base", "ranked", "difficulty"), f"""SELECT b.*,
        CASE WHEN prior = 0 THEN CASE WHEN recent >= 3 THEN 2.0 WHEN recent >= 1 THEN 1.0 ELSE 0.0 END
          ELSE (recent - prior) / prior::DOUBLE END AS growth_7d,
        CASE WHEN pr <= 0 THEN CASE WHEN rr > 0 THEN 1.0 ELSE 0.0 END
          ELSE greatest(-0.95, least(3.0, (rr - pr) / pr)) END AS growth_24h,
        CASE WHEN video_count < 3 THEN 0.5 ELSE {clamp('1.0 - spread / greatest(0.1, mean_lift) / 2.0')} END AS lift_consistency,
        {ranked_list('platforms')} AS platforms, {ranked_list('niches')} AS niches,
        {ranked_list('countries')} AS countries, {ranked_list('languages')} AS languages,
        {ranked_list('content_types')} AS content_types,
        CASE WHEN d.d IS NULL OR (d.d = 'low' AND median_duration_sec > 75) THEN 'medium' ELSE d.d END AS production_difficulty
        FROM base b LEFT JOIN difficulty d USING (trend_id)"""),
    "sig": (("aggs",), f"""SELECT *, {', '.join(f'{v} AS s_{k}' for k, v in _TREND.items())} FROM (
        SELECT *, {pick("CASE WHEN len(platforms) > 0 THEN platforms[1] ELSE 'tiktok' END", SC.ENGAGEMENT_BASELINE, SC.OTHER_ENGAGEMENT_BASELINE)} AS base,
        {clamp(f"0.55::DOUBLE * {log_scale('creator_count', 20)} + 0.2::DOUBLE * {log_ratio('median_followers', 500000)} + 0.25::DOUBLE * {log_scale('video_count', 60)}")} AS sat,
        CASE WHEN len(niches) >= 4 AND lift_consistency > 0.4 THEN 'high' WHEN len(niches) >= 2 THEN 'medium' ELSE 'low' END AS adaptability
        FROM aggs)"""),
    "raw": (("sig",), f"""SELECT *, {_sum({k: f's_{k}' for k in _TREND}, SC.TREND_WEIGHTS)} AS raw_score,
        {_sum(_CHANCE, SC.OPPORTUNITY_WEIGHTS)} AS raw_chance,
        {log_scale('median_views', 400000)} AS reach,
        (creator_count >= 20 AND video_count >= 20) AS broad,
        {', '.join(f'{v} AS o_{k}' for k, v in _CHANCE.items())} FROM sig"""),
    "trends": (("raw",), f"""SELECT * EXCLUDE (raw_chance), {rnd('raw_score', 1)} AS trend_score,
        {rnd('least(100.0, chance)', 1)} AS opportunity_score,
        CASE WHEN sat < 0.38 THEN 'low' WHEN sat < 0.56 THEN 'medium' ELSE 'high' END AS competition_level,
        upper(kind[1]) || kind[2:] || ' format ' || digit AS name,
        kind || '-format-' || digit AS slug,
        kind || ' X ' || digit AS format_pattern, status || ' format of ' || kind AS summary,
        first_published_at AS first_seen_at
        FROM (SELECT *, CASE WHEN status = 'declining' THEN raw_chance * 0.65::DOUBLE ELSE raw_chance END AS chance
        FROM (SELECT *, split_part(trend_id, '#', 1) AS kind, split_part(trend_id, '#', 2) AS digit,
          CASE WHEN growth_7d < -0.15 OR (growth_24h < -0.45 AND growth_7d < 0.05) THEN 'declining'
          WHEN reach >= 0.5 AND broad THEN 'viral'
          WHEN creator_count < 15 AND growth_7d > 0 THEN 'emerging'
          WHEN growth_7d >= 0.15 OR (growth_7d > 0.05 AND raw_score >= 55) THEN 'growing'
          WHEN broad AND reach >= 0.35 THEN 'viral' WHEN broad THEN 'declining'
          ELSE 'emerging' END AS status FROM raw))"""),
    "snapshots": (("members",), """SELECT trend_id, date_trunc('day', published_at) AS captured_at,
        count(*) AS video_count, count(DISTINCT creator_id) AS creator_count,
        CAST(sum(views) AS BIGINT) AS total_views FROM members GROUP BY 1, 2"""),
    "upoints": ((), """SELECT item_id,
        max(CASE WHEN r = 1 THEN t END) AS t2, max(CASE WHEN r = 1 THEN v END) AS v2,
        max(CASE WHEN r = 2 THEN t END) AS t1, max(CASE WHEN r = 2 THEN v END) AS v1,
        max(CASE WHEN r = 3 THEN t END) AS t0, max(CASE WHEN r = 3 THEN v END) AS v0
        FROM (SELECT user_id AS item_id, ts AS t, value AS v, row_number() OVER (
          PARTITION BY user_id ORDER BY ts DESC, value DESC) AS r FROM events)
        WHERE r <= 3 GROUP BY item_id"""),
    "items": ((), f"""SELECT o_orderkey AS item_id, o_custkey AS creator_id,
        o_orderpriority AS trend_id, CASE o_orderstatus {_PLATFORM} END AS platform,
        o_orderdate AS published_at, CAST(floor(o_totalprice) AS BIGINT) AS views,
        5.0::DOUBLE + o_orderkey % 120 AS duration_sec FROM orders"""),
    "creators": ((), """SELECT c_custkey AS creator_id, c_name AS handle,
        greatest(0, CAST(floor(c_acctbal * 100) AS BIGINT)) AS followers,
        CASE WHEN c_custkey % 3 = 0 THEN CAST(floor(abs(c_acctbal)) AS BIGINT) * 10 ELSE 0 END AS baseline,
        lower(c_mktsegment) AS niche, n_name AS country
        FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey"""),
    "feats": ((), """SELECT l_orderkey AS item_id, CAST(sum(l_quantity) AS BIGINT) AS quantity,
        count(*) AS lines, max(l_returnflag) AS flag,
        count(*) FILTER (l_returnflag = 'R') > 0 AS is_fallback FROM lineitem GROUP BY 1"""),
    "omembers": (("items",), """SELECT trend_id, item_id, views / 1000000.0::DOUBLE AS similarity,
        creator_id, platform, views, published_at FROM items"""),
    "profiles": ((), f"""SELECT c_custkey AS user_id,
        {nth(('ai', 'technology', 'fitness', 'food', 'travel', 'finance', 'knitting', ''), 'c_custkey % 8')} AS niche,
        CASE c_custkey % 4 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['tiktok'] WHEN 2 THEN ['youtube', 'tiktok']
          ELSE ['instagram'] END AS platforms,
        CASE WHEN c_custkey % 3 = 0 THEN [{nth(TYPES, 'c_custkey % 2')}] ELSE []::VARCHAR[] END AS content_types,
        CASE WHEN c_custkey % 5 = 0 THEN []::VARCHAR[] ELSE [{nth(LANGUAGES, 'c_nationkey % 4')}] END AS languages,
        {nth(('brand_growth', 'audience_growth', 'sales', 'authority', 'community', 'none'), 'c_custkey % 6')} AS goal,
        {nth(('low', 'medium', 'high', ''), 'c_nationkey % 4')} AS capacity FROM customer"""),
    "docs": ((), f"""SELECT *, {_LABEL} AS content_format, {_BEATS} AS beats,
        substr(regexp_replace(regexp_extract(text, '^[^.!?\\n]*'), '^\\s+|\\s+$', '', 'g'), 1, 180) AS hook180,
        substr(regexp_replace(regexp_extract(text, '^[^.!?\\n]*'), '^\\s+|\\s+$', '', 'g'), 1, 240) AS hook240
        FROM (SELECT doc_id AS item_id, text AS caption, text, source AS niche, lang, n_chars,
          n_chars / 50.0::DOUBLE AS duration_sec,
          lower(text) || ' ' || {nth(PHRASES, 'CAST(substr(source, 4) AS BIGINT) % 8')} AS haystack FROM documents)"""),
    "tokens": ((), f"""SELECT doc_id, lang, list_filter(
        regexp_extract_all(lower(text), '[a-z0-9'']+'),
        lambda t: length(t) > 1 AND NOT list_contains({STOP_SQL}, t)) AS toks FROM documents"""),
    "convs": ((), """SELECT (list(role ORDER BY turn))[1] || '-' || CAST(count(*) % 3 AS VARCHAR) AS trend_id,
        conv_id AS item_id, list(role ORDER BY turn) AS beats,
        arg_min(text, turn) FILTER (role = 'user') AS hook, count(*) AS turns,
        count(*) * 7.0::DOUBLE AS duration_sec FROM conversations GROUP BY conv_id"""),
    "vecs": ((), f"""SELECT vec_id, label, list_transform(e, lambda x: x / n) AS v FROM (
        SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM (SELECT vec_id, label, {VEC} AS e FROM embeddings))"""),
    "cents": (("vecs",), """SELECT label, list(x ORDER BY pos) AS c FROM (
        SELECT label, pos, avg(x) AS x FROM (
          SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM vecs)
        GROUP BY label, pos) GROUP BY label"""),
}


def sql(select: str, *needs: str, recursive: bool = False) -> str:
    """``select`` behind the WITH chain of the CTEs it needs."""
    order: list[str] = []

    def add(name: str) -> None:
        for dep in CTES[name][0]:
            add(dep)
        if name not in order:
            order.append(name)

    for name in needs:
        add(name)
    if not order:
        return select
    chain = ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order)
    return f"WITH {'RECURSIVE ' if recursive else ''}{chain}\n{select}"
