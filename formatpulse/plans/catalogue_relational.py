"""Queries over orders, customers and line items: joins, upserts, profiles and feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from formatpulse.functions import curves as C
from formatpulse.functions.arrays import overlap
from formatpulse.operators import aggregates as A
from formatpulse.operators import filters as P
from formatpulse.operators import personal as N
from formatpulse.operators import ranking as R
from formatpulse.operators import reports as Q
from formatpulse.operators import signals as G
from formatpulse.operators import upserts as U
from formatpulse.plans import bindings as B
from formatpulse.plans.catalogue_scores import day, r6
from formatpulse.plans.oracle import T_NOW, hours, rnd, sql

NOW = B.ORDERS_NOW
# Corpus window and gate of the order binding: dates, prices and rates of that table.
CUTOFF = "1996-01-01 00:00:00"
EXEMPLARS = 24


def corpus_join(spark, sf):
    rows = G.corpus(
        B.order_items(spark, sf), B.line_features(spark, sf), B.customers(spark, sf),
        C.as_instant(CUTOFF))
    return rows.select("item_id", "creator_id", "niche", "country", "followers", "quantity", "lines")


def pending_items(spark, sf):
    docs = B.table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), "lang", "n_chars")
    labels = B.table(spark, sf, "labels").select(F.col("doc_id").alias("item_id"))
    return U.pending(docs, labels)


def upgrade_queue(spark, sf):
    """Orders whose line features are fallbacks, exemplars of their trend first."""
    every = B.order_members(spark, sf).select("trend_id", "item_id", "similarity")
    best = R.top_k(every, ["trend_id"], [F.col("similarity").desc(), F.col("item_id")], 4)
    members = every.join(
        best.select("trend_id", "item_id", F.lit(True).alias("is_exemplar")), ["trend_id", "item_id"], "left"
    ).withColumn("is_exemplar", F.coalesce("is_exemplar", F.lit(False)))
    return U.upgrade_queue(
        B.order_items(spark, sf), B.line_features(spark, sf), members, 100
    ).select("item_id", "is_exemplar", "is_member", day("published_at").alias("published_at"))


def history_semi_join(spark, sf):
    """Line items of orders whose customer sits in the building segment."""
    chosen = B.order_items(spark, sf).join(
        B.customers(spark, sf).filter("niche = 'building'").select("creator_id"), "creator_id",
        "left_semi")
    lines = B.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("item_id"), F.floor("l_extendedprice").alias("views"))
    return G.history_for(chosen, lines).groupBy("item_id").agg(
        F.count(F.lit(1)).alias("snapshots"), F.sum("views").alias("views"))


def creator_baseline(spark, sf):
    return A.creator_baseline(B.order_items(spark, sf), B.customers(spark, sf))


def creator_lift(spark, sf):
    creators = B.customers(spark, sf).select("creator_id", "baseline_median_views", "followers")
    return B.order_items(spark, sf).join(creators, "creator_id").select(
        "item_id",
        F.round(C.creator_lift(F.col("views"), F.col("baseline_median_views"), F.col("followers")), 6)
        .alias("lift"))


def ranked_distinct_platforms(spark, sf):
    ranked = A.ranked_distinct(B.order_members(spark, sf), {"platform": "platforms"})
    return ranked.select("trend_id", F.array_join("platforms", ",").alias("platforms"))


def trend_exemplars_topk(spark, sf):
    trends = B.order_items(spark, sf).select("trend_id").distinct()
    detail = R.members_detail(
        trends, B.order_members(spark, sf).select("trend_id", "item_id", "similarity"),
        B.order_items(spark, sf).select("item_id", "creator_id", "views"), EXEMPLARS)
    creators = B.customers(spark, sf).select("creator_id", "handle")
    return detail.join(creators, "creator_id").select(
        "trend_id", "rank", "item_id", "views", "handle")


def saved_rows(spark, sf):
    """Orders as saved entities: a trend, a plan or an item by their status."""
    orders = B.table(spark, sf, "orders")
    kind = F.when(F.col("o_orderstatus") == "O", "trend").when(
        F.col("o_orderstatus") == "F", "scenario").otherwise("video")
    ref = F.when(kind == "trend", F.col("o_orderpriority")).otherwise(
        F.col("o_orderkey").cast("string"))
    return orders.select(
        F.col("o_custkey").alias("user_id"), kind.alias("entity_type"), ref.alias("entity_id"),
        F.col("o_orderkey").alias("saved_id"), F.col("o_orderdate").alias("created_at"))


def saved_resolved(spark, sf):
    trends = B.table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("trend_id")).distinct().withColumn(
        "name", F.lower("trend_id"))
    plans = B.table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("plan_id"), F.col("p_name").alias("title"))
    return U.saved_resolved(saved_rows(spark, sf), trends, plans).select(
        "saved_id", "entity_type", "trend_name", "plan_title")


def recent_by_user(spark, sf):
    return R.top_k(
        saved_rows(spark, sf), ["user_id"],
        [F.col("created_at").desc(), F.col("saved_id")], 6).select("user_id", "rank", "saved_id")


def latest_per_key(spark, sf):
    """Newest order of every customer."""
    return R.latest_per_key(
        B.order_items(spark, sf).select("creator_id", "item_id", "views", "published_at"),
        ["creator_id"], [F.col("published_at"), F.col("item_id")]).select("creator_id", "item_id", "views")


def platform_overlap(spark, sf):
    """Case-insensitive overlap of each profile's platforms with those its orders use."""
    used = B.order_items(spark, sf).groupBy(F.col("creator_id").alias("user_id")).agg(
        F.collect_set("platform").alias("used"))
    return B.customer_profiles(spark, sf).join(used, "user_id").select(
        "user_id", F.array_join(overlap(F.col("platforms"), F.col("used")), ",").alias("shared"))


def upsert_batch(spark, sf):
    """Events as collected rows of the items (event type, user)."""
    return B.table(spark, sf, "events").select(
        F.col("event_type").alias("platform"), F.col("user_id").alias("external_id"),
        F.floor(F.col("value") * 100).alias("views"), (F.col("event_id") % 50).alias("likes"),
        F.lit(0).cast("bigint").alias("comments"), F.lit(0).cast("bigint").alias("shares"),
        F.lit(0).cast("bigint").alias("saves"),
        F.date_format("ts", "yyyy-MM-dd").alias("caption"), F.col("event_id").alias("seq"))


def stored_items(spark, sf):
    zero = F.lit(0).cast("bigint")
    return B.table(spark, sf, "customer").select(
        F.lit("click").alias("platform"), F.col("c_custkey").alias("external_id"),
        F.floor(F.abs("c_acctbal")).alias("views"), zero.alias("likes"), zero.alias("comments"),
        zero.alias("shares"), zero.alias("saves"), F.col("c_mktsegment").alias("caption"),
        F.lit(None).cast("timestamp").alias("collected_at"))


def upsert_items(spark, sf):
    out = U.upsert_items(stored_items(spark, sf), upsert_batch(spark, sf), C.as_instant(B.EVENTS_NOW))
    return out.select("platform", "external_id", "views", "likes", "caption",
                      day("collected_at").alias("collected_at"), "change", "batch_rows")


def upsert_counts(spark, sf):
    return U.upsert_counts(
        U.upsert_items(stored_items(spark, sf), upsert_batch(spark, sf), C.as_instant(B.EVENTS_NOW)))


def upsert_creators(spark, sf):
    """Suppliers as stored creators; orders as a batch about creators with the same key."""
    stored = B.table(spark, sf, "supplier").select(
        F.lit("shop").alias("platform"), F.col("s_suppkey").alias("handle"),
        F.col("s_name").alias("display_name"), F.floor(F.abs("s_acctbal")).alias("followers"),
        F.lit(0).cast("bigint").alias("baseline_median_views"), F.lit("stored").alias("niche"))
    price = F.floor("o_totalprice")
    batch = B.table(spark, sf, "orders").select(
        F.lit("shop").alias("platform"), F.col("o_custkey").alias("handle"),
        F.when(F.col("o_orderstatus") == "O", "").otherwise(F.col("o_orderpriority")).alias("display_name"),
        F.when(price % 2 == 0, 0).otherwise(price).alias("followers"),
        F.when(price % 5 == 0, price).otherwise(F.lit(0)).alias("baseline_median_views"),
        F.col("o_orderpriority").alias("niche"), F.col("o_orderkey").alias("seq"))
    return U.upsert_creators(stored, batch)


def apply_changes(spark, sf):
    stored = B.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("user_id"), F.lit("trend").alias("entity_type"),
        (F.col("c_nationkey") % 10).cast("string").alias("entity_id"),
        F.col("c_mktsegment").alias("note"), F.lit("2023-01-01 00:00:00").cast("timestamp").alias("created_at"))
    k = F.get_json_object("props", "$.k").cast("bigint")
    kind = F.col("event_type")
    log = B.table(spark, sf, "events").select(
        "user_id", F.when(kind.isin("click", "error"), "trend").otherwise("scenario").alias("entity_type"),
        (k % 10).cast("string").alias("entity_id"),
        F.when(kind == "view", "").otherwise(kind).alias("note"),
        F.col("ts").cast("timestamp").alias("created_at"),
        F.when(kind.isin("error", "signup"), "delete").otherwise("save").alias("op"),
        F.col("event_id").alias("seq"))
    return U.apply_changes(stored, log).select(
        "user_id", "entity_type", "entity_id", "note", day("created_at").alias("created_at"))


def filter_items(spark, sf):
    items = B.order_items(spark, sf).withColumn("niche", F.col("trend_id"))
    return P.filter_items(items, "tiktok", "1-URGENT", 40, 20).select(
        "item_id", "views", day("published_at").alias("published_at"))


def plan_rows(spark, sf):
    return B.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("plan_id"), F.col("o_custkey").alias("user_id"),
        F.col("o_orderpriority").alias("trend_id"), F.col("o_orderstatus").alias("kind"),
        F.col("o_orderdate").alias("created_at"))


def plan_trends(spark, sf):
    return B.table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("trend_id")).distinct().withColumn(
        "name", F.concat(F.lit("format "), F.lower("trend_id")))


def filter_plans(spark, sf):
    page, total = P.filter_plans(plan_rows(spark, sf), plan_trends(spark, sf), 7, kind="O", limit=5)
    return page.select("plan_id", "trend_name", day("created_at").alias("created_at")).withColumn(
        "total", total.scalar())


def plans_with_trend(spark, sf):
    return P.plans_with_trend(plan_rows(spark, sf), plan_trends(spark, sf)).select(
        "plan_id", "user_id", "trend_name")


def items_by_platform(spark, sf):
    return Q.items_by_platform(B.order_items(spark, sf))


def adoption_growth_90d(spark, sf):
    return A.adoption_growth(B.order_items(spark, sf), NOW, 90).select(
        "trend_id", "recent", "prior", r6("growth"))


def quality_gate(spark, sf):
    kept = P.quality_gate(
        B.order_items(spark, sf), NOW, since="1997-01-01 00:00:00", min_views=250_000,
        min_views_per_hour=6.0)
    return kept.select("item_id", "views", "duration_sec")


def append_metrics(spark, sf):
    """Line items as collected rows, each with two points of provider history."""
    price, seen = F.floor("l_extendedprice"), F.col("l_shipdate").cast("timestamp")
    one = F.lit(1).cast("bigint")
    batch = B.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("item_id"), F.floor("l_quantity").alias("views"),
        one.alias("likes"), one.alias("comments"), one.alias("shares"),
        F.array(
            F.struct(seen.alias("captured_at"), price.alias("views")),
            F.struct((seen + F.expr("interval 1 day")).alias("captured_at"), (price + 1).alias("views")),
        ).alias("view_history"))
    rows = U.append_metrics(batch, C.as_instant(NOW))
    return rows.groupBy("item_id").agg(
        F.count(F.lit(1)).alias("snapshots"), F.sum("views").alias("views"),
        F.sum("likes").alias("likes"), day(F.min("captured_at")).alias("oldest"))


def union_history(spark, sf):
    current = B.order_items(spark, sf).select(
        "item_id", C.as_instant(NOW).alias("captured_at"), "views", F.lit(2).alias("likes"))
    past = B.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("item_id"), F.col("l_shipdate").cast("timestamp").alias("captured_at"),
        F.floor("l_extendedprice").alias("views"))
    rows = U.union_history(current, past)
    return rows.groupBy(F.date_format("captured_at", "yyyy").alias("year")).agg(
        F.count(F.lit(1)).alias("snapshots"), F.sum("views").alias("views"),
        F.sum("likes").alias("likes"))


def touched_creators(spark, sf):
    return U.touched_creators(B.order_items(spark, sf))


def feed_for_profiles(spark, sf):
    ranked = N.feed(B.customer_profiles(spark, sf), B.event_trends(spark, sf), 24)
    return ranked.select("user_id", "rank", "trend_id", "feed_score", "relevance_score",
                         F.array_join("relevance_reasons", " | ").alias("reasons"))


def best_trend_for_profile(spark, sf):
    return N.best_trend_for(B.customer_profiles(spark, sf), B.event_trends(spark, sf)).select(
        "user_id", "trend_id", "feed_score")


def in_niche(spark, sf):
    return N.in_niche(B.customer_profiles(spark, sf), B.event_trends(spark, sf)).select(
        "user_id", "rank", "trend_id", "feed_score")


def ensure_profile(spark, sf):
    """Customers who ordered have a stored profile; everyone else gets an empty one."""
    buyers = B.table(spark, sf, "orders").select(F.col("o_custkey").alias("user_id")).distinct()
    stored = B.customer_profiles(spark, sf).join(buyers, "user_id", "left_semi")
    users = B.table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))
    return U.ensure_profiles(stored, users).select(
        "user_id", "niche", F.array_join("languages", ",").alias("languages"), "production_capacity")


def update_profile(spark, sf):
    """Every order patches its customer's profile: the goal, the capacity or both."""
    price = F.floor("o_totalprice")
    patches = B.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("seq"),
        F.when(F.col("o_orderstatus") == "O", F.array(F.lit("goal")))
        .when(F.col("o_orderstatus") == "F", F.array(F.lit("production_capacity")))
        .otherwise(F.array(F.lit("goal"), F.lit("production_capacity"))).alias("fields"),
        F.when(price % 4 != 0, F.lower("o_orderpriority")).alias("goal"),
        F.when(price % 3 == 0, "low").otherwise("high").alias("production_capacity"))
    return U.update_profiles(B.customer_profiles(spark, sf), patches).select(
        "user_id", "niche", "goal", "production_capacity")


def merge_profile(spark, sf):
    """Suppliers as requests of the user with the same key."""
    key = F.col("s_nationkey")
    asked = B.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("user_id"), B.nth(("", "beauty", "travel"), key % 3).alias("niche"),
        B.nth(("", "tiktok"), key % 2).alias("platform"),
        B.nth(("sales", ""), key % 2).alias("goal"),
        F.when(key % 4 == 0, F.array(F.lit("es"))).otherwise(F.array().cast("array<string>")).alias("languages"))
    return U.merge_profile(B.customer_profiles(spark, sf), asked).select(
        "user_id", "niche", "goal", "platform", F.array_join("platforms", ",").alias("platforms"),
        F.array_join("languages", ",").alias("languages"), "production_capacity")


def relevance_sql() -> str:
    """Every profile against the trends as SQL: relevance, reasons and feed score."""
    adjacency = " UNION ALL ".join(
        f"SELECT '{k}' AS niche, {list(v)!r} AS near" for k, v in N.ADJACENT_NICHES.items())
    goal = " ".join(
        f"WHEN '{g}' THEN {w!r}::DOUBLE * {rnd(f'o_{s}', 3)}" for g, (s, w) in N.GOALS.items())
    effort = lambda c: f"(CASE {c} WHEN 'low' THEN 0 WHEN 'high' THEN 2 ELSE 1 END)"
    return f"""pairs AS (
      SELECT p.user_id, p.niche, t.trend_id, t.opportunity_score, t.adaptability, t.pool_rank,
        p.goal, list_contains(t.niches, p.niche) AND p.niche <> '' AS exact,
        list_min(list_intersect(COALESCE(a.near, []), t.niches)) AS adj,
        list_sort(list_intersect(p.platforms, t.platforms)) AS shared,
        len(p.languages) = 0 AS any_lang, len(list_intersect(p.languages, t.languages)) > 0 AS lang,
        len(t.languages) > 0 AS has_lang,
        list_min(list_intersect(p.content_types, t.content_types)) AS kind,
        {effort('t.production_difficulty')} AS effort, {effort('p.capacity')} AS cap,
        CASE p.goal {goal} ELSE 0.0 END AS goal_part
      FROM profiles p LEFT JOIN ({adjacency}) a ON a.niche = p.niche
      CROSS JOIN (SELECT *, row_number() OVER (ORDER BY opportunity_score DESC, trend_id) AS pool_rank FROM trends) t),
    total AS (SELECT *, least(1.0,
        CASE WHEN exact THEN 0.40::DOUBLE WHEN adj IS NOT NULL THEN 0.26 WHEN adaptability = 'high' THEN 0.16 ELSE 0.0 END
        + CASE WHEN len(shared) > 1 THEN 0.22::DOUBLE WHEN len(shared) = 1 THEN 0.17 ELSE 0.0 END
        + CASE WHEN any_lang OR lang THEN 0.12::DOUBLE ELSE 0.0 END
        + CASE WHEN kind IS NOT NULL THEN 0.12::DOUBLE ELSE 0.0 END
        + CASE WHEN effort <= cap THEN 0.14::DOUBLE ELSE 0.04 END + goal_part) AS total FROM pairs),
    rel AS (SELECT *, {rnd('total', 3)} AS relevance_score,
      array_to_string(list_filter([
        CASE WHEN exact THEN 'Already working in ' || niche
          WHEN adj IS NOT NULL THEN 'Working in ' || adj || ', which shares formats with ' || niche
          WHEN adaptability = 'high' THEN 'Travels well across niches' END,
        CASE WHEN len(shared) > 0 THEN 'Live on ' || array_to_string(shared, ', ') END,
        CASE WHEN NOT (any_lang OR lang) AND has_lang THEN 'Mostly in a language you do not publish in' END,
        CASE WHEN kind IS NOT NULL THEN 'Matches your ' || kind || ' content' END,
        CASE WHEN effort > cap THEN 'Needs more production than you usually do'
          WHEN effort = 0 THEN 'Low production effort' END], lambda x: x IS NOT NULL)[1:3], ' | ') AS reasons
      FROM total),
    fed AS (SELECT *, {rnd('(0.6::DOUBLE * relevance_score + 0.4::DOUBLE * (opportunity_score / 100.0::DOUBLE)) * 100', 1)} AS feed_score FROM rel)"""


def _fed(select: str) -> str:
    head = sql("", "trends", "profiles").rstrip()
    return f"{head},\n{relevance_sql()}\n{select}"


_RANK = "row_number() OVER (PARTITION BY user_id ORDER BY feed_score DESC, opportunity_score DESC, trend_id)"
_LINES = "CAST(floor(l_extendedprice) AS BIGINT)"
_GATE_AGE = f"greatest(1.0, {hours('published_at', T_NOW)})"
_SAVED = """SELECT o_custkey AS user_id, o_orderkey AS saved_id, o_orderdate AS created_at,
  CASE o_orderstatus WHEN 'O' THEN 'trend' WHEN 'F' THEN 'scenario' ELSE 'video' END AS entity_type,
  CASE o_orderstatus WHEN 'O' THEN o_orderpriority ELSE CAST(o_orderkey AS VARCHAR) END AS entity_id FROM orders"""
_UPSERT = """stored AS (SELECT 'click' AS platform, c_custkey AS external_id, CAST(floor(abs(c_acctbal)) AS BIGINT) AS views,
    c_mktsegment AS caption FROM customer),
  batch AS (SELECT event_type AS platform, user_id AS external_id, count(*) AS batch_rows,
    CAST(floor(arg_max(value, event_id) * 100) AS BIGINT) AS views, max(event_id) % 50 AS likes,
    strftime(arg_min(ts, event_id), '%Y-%m-%d') AS caption FROM events GROUP BY 1, 2),
  merged AS (SELECT COALESCE(s.platform, b.platform) AS platform, COALESCE(s.external_id, b.external_id) AS external_id,
    COALESCE(b.views, s.views) AS views, COALESCE(b.likes, 0) AS likes, COALESCE(s.caption, b.caption) AS caption,
    CASE WHEN b.platform IS NOT NULL THEN '2024-01-31 00:00:00' END AS collected_at,
    CASE WHEN b.platform IS NULL THEN 'kept' WHEN s.platform IS NULL THEN 'inserted' ELSE 'updated' END AS change,
    COALESCE(batch_rows, 0) AS batch_rows
    FROM stored s FULL JOIN batch b ON s.platform = b.platform AND s.external_id = b.external_id)"""
_CREATORS = """SELECT 'shop' AS platform, COALESCE(s.s_suppkey, b.o_custkey) AS handle,
  COALESCE(b.dn, s.s_name, b.dn1) AS display_name, COALESCE(b.fo, CAST(floor(abs(s.s_acctbal)) AS BIGINT), b.fo1) AS followers,
  COALESCE(b.bm, CASE WHEN s.s_suppkey IS NOT NULL THEN 0 END, b.bm1) AS baseline_median_views,
  CASE WHEN s.s_suppkey IS NOT NULL THEN 'stored' ELSE b.niche END AS niche
  FROM supplier s FULL JOIN (SELECT o_custkey,
    arg_max(o_orderpriority, o_orderkey) FILTER (o_orderstatus <> 'O') AS dn,
    arg_max(p, o_orderkey) FILTER (p % 2 <> 0) AS fo,
    arg_max(p, o_orderkey) FILTER (p % 5 = 0 AND p <> 0) AS bm,
    arg_min(CASE WHEN o_orderstatus = 'O' THEN '' ELSE o_orderpriority END, o_orderkey) AS dn1,
    arg_min(CASE WHEN p % 2 = 0 THEN 0 ELSE p END, o_orderkey) AS fo1,
    arg_min(CASE WHEN p % 5 = 0 THEN p ELSE 0 END, o_orderkey) AS bm1,
    arg_min(o_orderpriority, o_orderkey) AS niche
    FROM (SELECT *, CAST(floor(o_totalprice) AS BIGINT) AS p FROM orders) GROUP BY o_custkey) b
  ON s.s_suppkey = b.o_custkey"""
_CHANGES = """WITH log AS (
    SELECT c_custkey AS user_id, 'trend' AS entity_type, CAST(c_nationkey % 10 AS VARCHAR) AS entity_id,
      c_mktsegment AS note, TIMESTAMP '2023-01-01 00:00:00' AS created_at, 'save' AS op, -1 AS seq FROM customer
    UNION ALL SELECT user_id, CASE WHEN event_type IN ('click', 'error') THEN 'trend' ELSE 'scenario' END,
      CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 10 AS VARCHAR),
      CASE event_type WHEN 'view' THEN '' ELSE event_type END, ts,
      CASE WHEN event_type IN ('error', 'signup') THEN 'delete' ELSE 'save' END, event_id FROM events),
  alive AS (SELECT * FROM (SELECT *, max(seq) FILTER (op = 'delete') OVER (PARTITION BY user_id, entity_type, entity_id) AS wiped FROM log)
    WHERE op = 'save' AND (wiped IS NULL OR seq > wiped))
  SELECT user_id, entity_type, entity_id, arg_max(note, seq) FILTER (note <> '') AS note,
    strftime(arg_min(created_at, seq), '%Y-%m-%d %H:%M:%S') AS created_at FROM alive GROUP BY 1, 2, 3"""

QUERIES = {
    "corpus_join": (corpus_join, sql(
        f"""SELECT item_id, creator_id, c.niche, c.country, followers, quantity, lines
        FROM items JOIN feats USING (item_id) JOIN creators c USING (creator_id)
        WHERE published_at >= TIMESTAMP '{CUTOFF}'""", "items", "feats", "creators")),
    "pending_items": (pending_items, """SELECT doc_id AS item_id, lang, n_chars FROM documents d
        WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)"""),
    "upgrade_queue": (upgrade_queue, sql(
        """SELECT item_id, COALESCE(r <= 4, false) AS is_exemplar, r IS NOT NULL AS is_member,
        strftime(i.published_at, '%Y-%m-%d %H:%M:%S') AS published_at
        FROM items i JOIN feats f USING (item_id) LEFT JOIN (SELECT item_id, r FROM (
          SELECT item_id, row_number() OVER (PARTITION BY trend_id ORDER BY similarity DESC, item_id) AS r
          FROM omembers) ) m USING (item_id)
        WHERE is_fallback ORDER BY is_exemplar DESC, is_member DESC, i.published_at DESC, item_id LIMIT 100""",
        "items", "feats", "omembers")),
    "history_semi_join": (history_semi_join, sql(
        f"""SELECT l_orderkey AS item_id, count(*) AS snapshots, CAST(sum({_LINES}) AS BIGINT) AS views FROM lineitem
        WHERE l_orderkey IN (SELECT item_id FROM items JOIN creators USING (creator_id) WHERE niche = 'building')
        GROUP BY 1""", "items", "creators")),
    "creator_baseline": (creator_baseline, sql(
        """SELECT creator_id, CAST(floor(median(views)) AS BIGINT) AS baseline_median_views FROM (
        SELECT creator_id, views, row_number() OVER (PARTITION BY creator_id ORDER BY published_at DESC, item_id) AS r
        FROM items WHERE creator_id IN (SELECT creator_id FROM creators WHERE baseline = 0))
        WHERE r <= 30 GROUP BY creator_id HAVING count(*) >= 3""", "items", "creators")),
    "creator_lift": (creator_lift, sql(
        """SELECT item_id, round(views / COALESCE(NULLIF(baseline, 0),
        greatest(1, CAST(floor(followers * 0.08::DOUBLE) AS BIGINT)))::DOUBLE, 6) AS lift
        FROM items JOIN creators USING (creator_id)""", "items", "creators")),
    "ranked_distinct_platforms": (ranked_distinct_platforms, sql(
        """SELECT trend_id, string_agg(platform, ',' ORDER BY n DESC, s, i) AS platforms FROM (
        SELECT trend_id, platform, count(*) AS n, min(-similarity) AS s, arg_min(item_id, (-similarity, item_id)) AS i
        FROM omembers GROUP BY 1, 2) GROUP BY trend_id""", "omembers")),
    "trend_exemplars_topk": (trend_exemplars_topk, sql(
        f"""SELECT trend_id, rank, item_id, views, handle FROM (SELECT *, row_number() OVER (
        PARTITION BY trend_id ORDER BY similarity DESC, item_id) AS rank FROM omembers)
        JOIN creators USING (creator_id) WHERE rank <= {EXEMPLARS}""", "omembers", "creators")),
    "saved_resolved": (saved_resolved, f"""SELECT saved_id, entity_type, t.name AS trend_name, p.p_name AS plan_title
        FROM ({_SAVED}) s LEFT JOIN (SELECT DISTINCT o_orderpriority AS id, lower(o_orderpriority) AS name FROM orders) t
        ON s.entity_type = 'trend' AND s.entity_id = t.id
        LEFT JOIN part p ON s.entity_type = 'scenario' AND s.entity_id = CAST(p.p_partkey AS VARCHAR)"""),
    "recent_by_user": (recent_by_user, f"""SELECT user_id, rank, saved_id FROM (SELECT *, row_number() OVER (
        PARTITION BY user_id ORDER BY created_at DESC, saved_id) AS rank FROM ({_SAVED})) WHERE rank <= 6"""),
    "latest_per_key": (latest_per_key, sql(
        """SELECT creator_id, item_id, views FROM (SELECT *, row_number() OVER (
        PARTITION BY creator_id ORDER BY published_at DESC, item_id DESC) AS r FROM items) WHERE r = 1""", "items")),
    "platform_overlap": (platform_overlap, sql(
        """SELECT user_id, array_to_string(list_sort(list_intersect(platforms, used)), ',') AS shared FROM profiles
        JOIN (SELECT creator_id, list(DISTINCT platform) AS used FROM items GROUP BY 1) ON creator_id = user_id""",
        "profiles", "items")),
    "upsert_items": (upsert_items, f"WITH {_UPSERT} SELECT * FROM merged"),
    "upsert_counts": (upsert_counts, f"""WITH {_UPSERT} SELECT count(*) FILTER (change = 'inserted') AS ingested,
        CAST(sum(batch_rows) AS BIGINT) - count(*) FILTER (change = 'inserted') AS updated FROM merged"""),
    "upsert_creators": (upsert_creators, _CREATORS),
    "apply_changes": (apply_changes, _CHANGES),
    "filter_items": (filter_items, sql(
        """SELECT item_id, views, strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published_at FROM items
        WHERE platform = 'tiktok' AND trend_id = '1-URGENT'
        ORDER BY items.published_at DESC, item_id LIMIT 40 OFFSET 20""", "items")),
    "filter_plans": (filter_plans, """SELECT o_orderkey AS plan_id, 'format ' || lower(o_orderpriority) AS trend_name,
        strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS created_at,
        (SELECT count(*) FROM orders WHERE o_custkey = 7 AND o_orderstatus = 'O') AS total
        FROM orders WHERE o_custkey = 7 AND o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey LIMIT 5"""),
    "plans_with_trend": (plans_with_trend, """SELECT o_orderkey AS plan_id, o_custkey AS user_id,
        'format ' || lower(o_orderpriority) AS trend_name FROM orders"""),
    "items_by_platform": (items_by_platform, sql(
        "SELECT platform, count(*) AS videos, CAST(sum(views) AS BIGINT) AS views FROM items GROUP BY 1", "items")),
    "adoption_growth_90d": (adoption_growth_90d, sql(
        f"""SELECT trend_id, recent, prior, round(CASE WHEN prior = 0 THEN CASE WHEN recent >= 3 THEN 2.0
        WHEN recent >= 1 THEN 1.0 ELSE 0.0 END ELSE (recent - prior) / prior::DOUBLE END, 6) AS growth FROM (
        SELECT trend_id, count(*) FILTER ({hours('published_at', T_NOW)} <= 2160) AS recent,
        count(*) FILTER ({hours('published_at', T_NOW)} > 2160 AND {hours('published_at', T_NOW)} <= 4320) AS prior
        FROM items GROUP BY trend_id)""", "items")),
    "quality_gate": (quality_gate, sql(
        f"""SELECT item_id, views, duration_sec FROM items WHERE duration_sec BETWEEN 8 AND 90
        AND published_at >= TIMESTAMP '1997-01-01' AND (views >= 250000 OR views / {_GATE_AGE} >= 6.0)""", "items")),
    "append_metrics": (append_metrics, f"""SELECT item_id, count(*) AS snapshots, CAST(sum(views) AS BIGINT) AS views,
        CAST(sum(likes) AS BIGINT) AS likes, strftime(min(seen), '%Y-%m-%d %H:%M:%S') AS oldest FROM (
        SELECT l_orderkey AS item_id, CAST(floor(l_quantity) AS BIGINT) AS views, 1 AS likes, {T_NOW} AS seen FROM lineitem
        UNION ALL SELECT l_orderkey, {_LINES}, 0, l_shipdate FROM lineitem
        UNION ALL SELECT l_orderkey, {_LINES} + 1, 0, l_shipdate + INTERVAL 1 DAY FROM lineitem) GROUP BY item_id"""),
    "union_history": (union_history, sql(
        f"""SELECT strftime(seen, '%Y') AS year, count(*) AS snapshots, CAST(sum(views) AS BIGINT) AS views,
        CAST(sum(likes) AS BIGINT) AS likes FROM (SELECT views, 2 AS likes, {T_NOW} AS seen FROM items
        UNION ALL SELECT {_LINES}, 0, l_shipdate FROM lineitem) GROUP BY 1""", "items")),
    "touched_creators": (touched_creators, "SELECT DISTINCT o_custkey AS creator_id FROM orders"),
    "feed_for_profiles": (feed_for_profiles, _fed(
        f"""SELECT user_id, rank, trend_id, feed_score, relevance_score, reasons FROM (
        SELECT *, {_RANK} AS rank FROM fed WHERE pool_rank <= {N.FEED_POOL}) WHERE rank <= 24""")),
    "best_trend_for_profile": (best_trend_for_profile, _fed(
        f"""SELECT user_id, trend_id, feed_score FROM (
        SELECT *, {_RANK} AS rank FROM fed WHERE pool_rank <= {N.PICK_POOL}) WHERE rank = 1""")),
    "in_niche": (in_niche, _fed(
        f"""SELECT user_id, rank, trend_id, feed_score FROM (SELECT *, {_RANK} AS rank FROM (
        SELECT *, bool_or(exact) OVER (PARTITION BY user_id) AS any_exact FROM fed) WHERE exact OR NOT any_exact)
        WHERE rank <= 6""")),
    "ensure_profile": (ensure_profile, sql(
        """SELECT c_custkey AS user_id, p.niche,
        CASE WHEN p.user_id IS NULL OR len(p.languages) = 0 THEN 'en' ELSE array_to_string(p.languages, ',') END AS languages,
        COALESCE(NULLIF(p.capacity, ''), 'medium') AS production_capacity
        FROM customer LEFT JOIN (SELECT * FROM profiles WHERE user_id IN (SELECT o_custkey FROM orders)) p
        ON p.user_id = c_custkey""", "profiles")),
    "update_profile": (update_profile, sql(
        """SELECT p.user_id, p.niche, CASE WHEN g.k IS NULL THEN p.goal WHEN g.price % 4 <> 0 THEN g.pri END AS goal,
        CASE WHEN c.k IS NULL THEN p.capacity WHEN c.price % 3 = 0 THEN 'low' ELSE 'high' END AS production_capacity
        FROM profiles p
        LEFT JOIN (SELECT o_custkey AS k, arg_max(lower(o_orderpriority), o_orderkey) AS pri,
          CAST(floor(arg_max(o_totalprice, o_orderkey)) AS BIGINT) AS price FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1) g ON g.k = p.user_id
        LEFT JOIN (SELECT o_custkey AS k, CAST(floor(arg_max(o_totalprice, o_orderkey)) AS BIGINT) AS price
          FROM orders WHERE o_orderstatus <> 'O' GROUP BY 1) c ON c.k = p.user_id""", "profiles")),
    "merge_profile": (merge_profile, sql(
        """SELECT p.user_id, CASE WHEN s.s_nationkey % 3 = 1 THEN 'beauty' WHEN s.s_nationkey % 3 = 2 THEN 'travel' ELSE p.niche END AS niche,
        CASE WHEN s.s_nationkey % 2 = 0 THEN 'sales' ELSE p.goal END AS goal,
        CASE WHEN s.s_nationkey % 2 = 1 THEN 'tiktok' ELSE pl[1] END AS platform,
        CASE WHEN s.s_nationkey % 2 = 1 THEN 'tiktok' ELSE array_to_string(pl, ',') END AS platforms,
        CASE WHEN s.s_nationkey % 4 = 0 THEN 'es' WHEN len(p.languages) = 0 THEN 'en' ELSE array_to_string(p.languages, ',') END AS languages,
        COALESCE(NULLIF(p.capacity, ''), 'medium') AS production_capacity
        FROM (SELECT *, CASE WHEN user_id % 4 = 1 THEN ['TikTok'] ELSE platforms END AS pl FROM profiles) p
        LEFT JOIN supplier s ON s.s_suppkey = p.user_id""", "profiles")),
}
