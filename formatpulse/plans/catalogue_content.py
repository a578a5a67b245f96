"""Queries over documents, conversations, pages and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from formatpulse.functions import text as X
from formatpulse.functions import vectors as V
from formatpulse.functions.quantiles import group_medians
from formatpulse.operators import aggregates as A
from formatpulse.operators import clustering as K
from formatpulse.operators import enrich as E
from formatpulse.operators import filters as P
from formatpulse.operators import narrative as N
from formatpulse.operators import ranking as R
from formatpulse.operators import reports as Q
from formatpulse.operators import similarity as S
from formatpulse.operators import upserts as U
from formatpulse.operators.components import connected_components
from formatpulse.operators import sparse as SP
from formatpulse.operators.slugs import slug_dedupe
from formatpulse.plans import bindings as B
from formatpulse.plans.oracle import VEC, rnd, sql, useful
from formatpulse.session import spread, work_dir

# The test vectors have almost no label structure, so cuts sit in their own range.
PAIR_CUT = 0.35
GRAPH_CUT = 0.38
CLUSTER_CUT = 0.30
ASSIGN_CUT = 0.25
SPARSE_DIMS, SPARSE_CUT = 768, 0.95
SWEEP = [0.3, 0.62, 0.99]


def tokens(spark, sf):
    docs = spread(B.table(spark, sf, "documents"))
    return docs.select("doc_id", "lang", X.tokenize(F.col("text")).alias("tokens"))


def token_counts(spark, sf):
    return X.term_counts(spread(B.table(spark, sf, "documents")), "lang", "text", 1, "token")


def bigram_counts(spark, sf):
    return X.term_counts(spread(B.table(spark, sf, "documents")), "lang", "text", 2, "pair")


def top_terms(spark, sf):
    return N.top_elements(tokens(spark, sf), "tokens", F.col("doc_id"), 4, "lang").select(
        "lang", "element", "n", "rank")


def search_text(spark, sf):
    return P.search_text(B.table(spark, sf, "documents"), "THE_TH%ON", ["text"]).select("doc_id", "lang")


def heuristics(spark, sf):
    return X.heuristic_features(B.documents(spark, sf))


def format_classes(spark, sf):
    return heuristics(spark, sf).groupBy(
        "content_format", F.array_join("narrative_structure", "|").alias("beats")).agg(
        F.count(F.lit(1)).alias("n"))


def heuristic_features(spark, sf):
    return heuristics(spark, sf).select(
        "item_id", "hook", "topic", "content_format",
        F.array_join("narrative_structure", "|").alias("beats"), "main_message",
        "target_audience", "audio_style", "production_difficulty")


def first_sentence(spark, sf):
    return B.table(spark, sf, "documents").select(
        "doc_id", X.first_sentence(F.col("text"), 180).alias("hook"))


def format_signature(spark, sf):
    """Even lengths have craft fields, odd ones only the caption."""
    rows = heuristics(spark, sf)
    crafted = F.col("n_chars") % 2 == 0
    return rows.select(
        "item_id",
        X.format_signature(
            F.col("content_format"), F.col("narrative_structure"),
            F.when(crafted, F.array(F.lit("jump cuts"), F.col("language"))).otherwise(F.col("editing_patterns")),
            F.col("visual_style"), F.col("speaking_style"), F.col("emotional_tone"), F.col("hook"),
            F.col("main_message"), F.col("topic"), F.col("caption"),
            F.array(F.concat(F.lit("#"), F.col("language")))).alias("signature"))


def hosted(rows):
    """A tier that knows nothing of texts whose length ends in 0, and fails where a batch holds an empty one."""
    if any(not r["text"] for r in rows):
        raise ValueError("empty text")
    return [None if r["n_chars"] % 10 == 0 else {"topic": "hosted " + r["lang"]} for r in rows]


def enriched_tiers(spark, sf):
    """Two runs over the documents of one language each, with a hosted quota of 300 rows for both: run, tier, reason, rows."""
    docs = B.table(spark, sf, "documents").where("text <> ''").select("doc_id", "text", "lang", "n_chars")
    tiers = [E.BatchTier("hosted", hosted, 300), E.BatchTier("local", lambda rows: [{"topic": "local"} for _ in rows])]
    path, out = work_dir(spark, "ledger"), None
    for run, lang in enumerate(("de", "fr"), 1):
        done, waiting = E.enrich_batches(docs.where(F.col("lang") == lang), tiers, "topic string",
                                         E.Ledger(spark, path, "day", run), [F.col("doc_id")], "doc_id")
        part = done.select(F.lit(run).alias("run"), "tier", "fallback_reason").unionByName(
            waiting.select(F.lit(run).alias("run"), F.lit(None).cast("string").alias("tier"), "fallback_reason"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("run", "tier", "fallback_reason").agg(F.count("*").alias("n"))


def hash_embed(spark, sf):
    docs = spread(B.table(spark, sf, "documents"))
    vecs = docs.select("doc_id", X.hash_embed_text(F.col("text")).alias("embedding"))
    return vecs.select(
        "doc_id", F.size("embedding").cast("bigint").alias("dim"),
        F.size(F.filter("embedding", lambda x: x != 0)).cast("bigint").alias("filled"),
        F.round(V.norm(F.col("embedding")), 4).alias("norm"))


def fallback_count(spark, sf):
    labels = B.table(spark, sf, "labels").select("doc_id", F.lit(True).alias("labelled"))
    docs = B.table(spark, sf, "documents").join(labels, "doc_id", "left")
    return Q.fallback_count(docs.withColumn("is_fallback", F.col("labelled").isNull()))


def upgrade_features(spark, sf):
    old = B.table(spark, sf, "documents").select(
        F.col("doc_id").alias("item_id"), F.lit("heuristic").alias("extraction_model"),
        F.col("source").alias("topic"), F.lit(True).alias("is_fallback"))
    new = B.table(spark, sf, "labels").select(
        F.col("doc_id").alias("item_id"), F.lit("hosted").alias("extraction_model"),
        F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("topic"),
        (F.col("toxic") == 1).alias("is_fallback"))
    return U.upgrade_features(old, new)


def item():
    return F.col("item_id")


def modal_sequence(spark, sf):
    rows = B.conversation_rows(spark, sf)
    return N.modal_sequence(rows, "beats", item(), length=F.col("turns")).select(
        "trend_id", F.array_join("beats", ">").alias("beats"))


def common_opening(spark, sf):
    """Openings of page markup by URL scheme: the shared first three words."""
    rows = B.table(spark, sf, "pages").select(
        F.substring_index("url", ":", 1).alias("trend_id"), F.col("page_id").alias("item_id"),
        F.col("html").alias("hook"))
    return N.common_opening(rows, "hook", item()).select("trend_id", "n", "hits", "format_pattern")


def mode_label(spark, sf):
    return A.mode_of(B.conversation_rows(spark, sf), "trend_id", "last", item(), "none")


def top_elements(spark, sf):
    """The most frequent roles per turn parity, straight from the turns."""
    turns = B.table(spark, sf, "conversations").select(
        (F.col("turn") % 3).cast("string").alias("trend_id"), F.array("role").alias("roles"),
        F.struct("conv_id", "turn").alias("at"))
    return N.top_elements(turns, "roles", F.col("at"), 2).select("trend_id", "element", "n", "rank")


def timed_structure(spark, sf):
    """The usual beats of each format laid over its median duration."""
    rows = B.conversation_rows(spark, sf)
    beats = N.modal_sequence(rows, "beats", item(), length=F.col("turns"))
    length = group_medians(rows, ["trend_id"], ["duration_sec"])
    timeline = N.timed_structure(F.col("beats"), F.col("duration_sec"))
    return beats.join(length, "trend_id").select(
        "trend_id", F.posexplode(timeline).alias("pos", "s")).select(
        "trend_id", F.col("pos").cast("bigint").alias("pos"), "s.start", "s.end", "s.label", "s.detail")


def conversation_members(spark, sf):
    return B.conversation_rows(spark, sf).select(
        "trend_id", "item_id", (F.col("turns") / 10.0).alias("similarity"), "hook",
        F.col("beats").alias("narrative_structure"), F.col("roles").alias("editing_patterns"),
        F.col("last").alias("content_format"),
        F.when(F.col("turns") > 7, "Shock").alias("emotional_tone"), "duration_sec", "turns")


def example_hooks(spark, sf):
    members = conversation_members(spark, sf)
    hooks = R.example_hooks(
        members.select("trend_id").distinct(), members.select("trend_id", "item_id", "similarity"),
        members.select("item_id", "hook"))
    return hooks.select("trend_id", F.posexplode("example_hooks").alias("pos", "hook")).select(
        "trend_id", F.col("pos").cast("bigint").alias("pos"), "hook")


def describe_trend(spark, sf):
    members = conversation_members(spark, sf)
    stats = group_medians(members, ["trend_id"], ["duration_sec"], others=[
        F.sort_array(F.collect_set(F.col("turns").cast("string"))).alias("niches"),
        F.lit("low").alias("production_difficulty"),
        ((F.count(F.lit(1)) - 10) / 10.0).alias("growth_7d"),
    ]).withColumnRenamed("duration_sec", "median_duration_sec")
    return N.describe_clusters(members, stats).select(
        "trend_id", "name", "format_pattern", "summary",
        F.array_join("common_elements", " | ").alias("common_elements"),
        F.array_join("mechanisms", ",").alias("mechanisms"))


def slugs(spark, sf):
    return slug_dedupe(B.page_names(spark, sf), "name", ["page_id"]).select("page_id", "slug")


def l2_normalized(spark, sf):
    vec = V.l2_normalize(F.transform("embedding", lambda x: x * F.col("vec_id")))
    return B.embeddings(spark, sf).select("vec_id", vec.alias("v")).select(
        "vec_id", F.round(V.norm(F.col("v")), 6).alias("norm"), F.round(F.col("v")[0], 6).alias("first"))


def cosine_pairs(spark, sf):
    """Each vector with the next one of its label."""
    vecs = B.embeddings(spark, sf)
    nxt = vecs.groupBy("label", (F.col("vec_id") - 1).alias("vec_id")).agg(
        F.any_value("embedding").alias("other"))
    return vecs.join(nxt, ["label", "vec_id"]).select(
        "vec_id", F.round(V.cosine(F.col("embedding"), F.col("other")), 6).alias("similarity"))


def label_centers(spark, sf):
    rows = S.unit_vectors(B.embeddings(spark, sf)).join(
        B.embeddings(spark, sf).select(F.col("vec_id").alias("id"), "label"), "id")
    return K.centroids(rows, "label")


def label_centroids(spark, sf):
    return label_centers(spark, sf).select("label", F.posexplode("centroid").alias("pos", "x")).select(
        "label", F.col("pos").cast("bigint").alias("pos"), F.round("x", 6).alias("x"))


def nearest_centroid(spark, sf):
    found = S.assign_to_existing(B.embeddings(spark, sf), label_centers(spark, sf), ASSIGN_CUT, key="label")
    return found.select("vec_id", "label", F.round("similarity", 6).alias("similarity"))


def prototypicality(spark, sf):
    rows = S.unit_vectors(B.embeddings(spark, sf)).join(
        B.embeddings(spark, sf).select(F.col("vec_id").alias("id"), F.col("label").alias("trend_id")), "id")
    centers = label_centers(spark, sf).withColumnRenamed("label", "trend_id")
    return K.prototypicality(rows, centers).select("trend_id", F.col("id").alias("vec_id"), "similarity")


def exemplars_by_similarity(spark, sf):
    return R.member_rank(
        prototypicality(spark, sf).withColumnRenamed("vec_id", "item_id")).filter("is_exemplar").select(
        "trend_id", "item_id", "rank", "similarity")


def pairs_above(spark, sf):
    return S.similarity_pairs(B.embeddings(spark, sf), PAIR_CUT).select(
        "id_a", "id_b", F.round("similarity", 4).alias("similarity"))


def components(spark, sf):
    edges = S.block_search(S.unit_vectors(B.embeddings(spark, sf)), GRAPH_CUT, "forest")
    return connected_components(edges)


def sparse_pairs(spark, sf):
    """Documents as hashed word counts; pairs by the inverted index."""
    entries = SP.term_entries(B.table(spark, sf, "documents"), "doc_id", "text", SPARSE_DIMS)
    return SP.sparse_pairs(entries, SPARSE_CUT).select("id_a", "id_b", F.round("similarity", 6).alias("similarity"))


def planted(spark, sf):
    """The vectors at half length, each with a one in the place of its label: the labels are the clusters."""
    vec = F.transform("embedding", lambda x, i: x * 0.5 + (i == F.col("label")).cast("double"))
    return B.embeddings(spark, sf).select("vec_id", "label", vec.alias("embedding"))


def format_clusters(spark, sf):
    members, groups = K.cluster_embeddings(planted(spark, sf), K.THRESHOLD, 3, ident="vec_id")
    return members.join(groups.select("trend_id", "size"), "trend_id")


def cluster_purity(spark, sf):
    """Every seventh vector claims the label after its own."""
    members, _ = K.cluster_embeddings(planted(spark, sf), K.THRESHOLD, 3, ident="vec_id")
    truth = B.embeddings(spark, sf).select("vec_id", F.when(F.col("vec_id") % 7 == 0, F.col("label") + 1).otherwise(
        F.col("label")).alias("label"))
    return K.purity(members, truth, "vec_id").select("trend_id", "size", "majority", F.round("purity", 6).alias("purity"))


def leader_clusters(spark, sf):
    return K.greedy_cluster(B.embeddings(spark, sf), CLUSTER_CUT, ident="vec_id")


def cluster_precheck(spark, sf):
    return K.cluster_precheck(B.embeddings(spark, sf))


def similarity_quantiles(spark, sf):
    return S.similarity_quantiles(S.sampled_similarities(B.embeddings(spark, sf)))


def threshold_sweep(spark, sf):
    return K.threshold_sweep(planted(spark, sf), SWEEP).select(
        "threshold", "trends", "covered", "largest", F.round("coverage", 6).alias("coverage"), "verdict", "suggested")


_SIG = f"""SELECT item_id, array_to_string(list_filter(CASE WHEN n_chars % 2 = 0 THEN
  [content_format, content_format, replace(beats, '|', ' '), replace(beats, '|', ' '), {useful('hook')}, 'jump cuts ' || lang, {useful('hook240')}, niche || ' content']
  ELSE [{useful('hook')}, {useful('hook240')}, substr(caption, 1, 400), lang, lang, niche || ' content', content_format] END,
  lambda x: x <> ''), ' ') AS signature FROM (SELECT *, COALESCE(NULLIF(hook180, ''), '(hook not recoverable from metadata)') AS hook FROM docs)"""
_TITLE = "upper(role[1]) || role[2:]"
_TIMED = f"""SELECT trend_id, i - 1 AS pos, CASE WHEN i = 1 THEN 0.0 ELSE {rnd('h + (d - h) * (before / total)', 1)} END AS start,
  CASE WHEN i = 1 THEN {rnd('h', 1)} ELSE {rnd('least(d, h + (d - h) * ((before + w) / total))', 1)} END AS "end",
  {_TITLE} AS label, CASE WHEN i = 1 THEN 'The promise is made before anything is explained.' ELSE '' END AS detail
  FROM (SELECT *, least(3.0::DOUBLE, d * 0.12::DOUBLE) AS h,
    COALESCE(sum(w) OVER (PARTITION BY trend_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS before,
    sum(w) OVER (PARTITION BY trend_id) AS total
  FROM (SELECT trend_id, role, i, greatest(12.0::DOUBLE, duration_sec) AS d,
    CASE WHEN i = 1 THEN 0.0 WHEN i = n THEN 0.7 WHEN n - 1 >= 2 AND i - 2 = (n - 1) // 2 THEN 1.8 ELSE 1.0 END::DOUBLE AS w
  FROM (SELECT trend_id, duration_sec, len(beat_list) AS n, unnest(beat_list) AS role, generate_subscripts(beat_list, 1) AS i
    FROM modal JOIN (SELECT trend_id AS q, median(duration_sec) AS duration_sec FROM convs GROUP BY 1) ON q = trend_id)))"""
_MODAL = """modal AS (SELECT trend_id, string_agg(role, '>' ORDER BY i) AS beats, list(role ORDER BY i) AS beat_list FROM (
  SELECT trend_id, i, role, row_number() OVER (PARTITION BY trend_id, i ORDER BY count(*) DESC, min(item_id), role) AS r
  FROM (SELECT trend_id, item_id, unnest(beats) AS role, generate_subscripts(beats, 1) AS i FROM convs) GROUP BY trend_id, i, role) x
  JOIN (SELECT trend_id AS t, least(6, greatest(3, floor(median(len(beats))))) AS n FROM convs GROUP BY 1) y ON t = trend_id
  WHERE r = 1 AND i <= n GROUP BY trend_id)"""
_MODAL_SIM = _MODAL.replace("modal AS", "modals AS").replace("min(item_id)", "min((-turns, item_id))").replace(
    "SELECT trend_id, item_id, unnest", "SELECT trend_id, item_id, turns, unnest")
_OPEN = """SELECT trend_id, n, hits, upper(opening[1]) || opening[2:] || ' X …' AS format_pattern FROM (
  SELECT trend_id, opening, count(*) AS hits, CAST(sum(count(*)) OVER (PARTITION BY trend_id) AS BIGINT) AS n,
    row_number() OVER (PARTITION BY trend_id ORDER BY count(*) DESC, min(item_id)) AS r FROM (
    SELECT split_part(url, ':', 1) AS trend_id, page_id AS item_id,
    lower(array_to_string(string_split_regex(trim(html, e' \\n\\t'), '\\s+')[1:3], ' ')) AS opening FROM pages WHERE html <> '')
  GROUP BY trend_id, opening) WHERE r = 1 AND n >= 3 AND hits >= greatest(2, n // 3)"""
_DESCRIBE = f""", {_MODAL_SIM},
  m AS (SELECT *, beats[-1] AS fmt FROM convs),
  fmt AS (SELECT trend_id, fmt FROM (SELECT trend_id, fmt, row_number() OVER (PARTITION BY trend_id ORDER BY count(*) DESC, min((-turns, item_id))) AS r
    FROM m GROUP BY 1, 2) WHERE r = 1),
  opens AS (SELECT trend_id, upper(o[1]) || o[2:] || ' X …' AS pat FROM (SELECT trend_id, o, count(*) AS c,
    sum(count(*)) OVER (PARTITION BY trend_id) AS n, row_number() OVER (PARTITION BY trend_id ORDER BY count(*) DESC, min((-turns, item_id))) AS r
    FROM (SELECT trend_id, turns, item_id, lower(array_to_string(string_split_regex(trim(hook, e' \\n\\t'), '\\s+')[1:3], ' ')) AS o FROM m WHERE hook <> '') GROUP BY 1, 2)
    WHERE r = 1 AND n >= 3 AND c >= greatest(2, floor(n / 3))),
  edits AS (SELECT trend_id, string_agg(role || ' (' || CAST(c AS VARCHAR) || ' of ' || CAST(n AS VARCHAR) || ' videos)', ' | ' ORDER BY r) AS e FROM (
    SELECT trend_id, role, count(*) AS c, row_number() OVER (PARTITION BY trend_id ORDER BY count(*) DESC, min((-turns, item_id, i)), role) AS r
    FROM (SELECT trend_id, turns, item_id, unnest(beats) AS role, generate_subscripts(beats, 1) AS i FROM m) GROUP BY 1, 2)
    JOIN (SELECT trend_id AS t, count(*) AS n FROM m GROUP BY 1) ON t = trend_id WHERE r <= 4 GROUP BY trend_id),
  st AS (SELECT trend_id, median(duration_sec) AS d, count(DISTINCT turns) AS niches, (count(*) - 10) / 10.0::DOUBLE AS g,
    bool_or(turns > 7) AS payoff FROM m GROUP BY 1)
  SELECT st.trend_id, upper(fmt[1]) || fmt[2:] AS name, COALESCE(pat, fmt) AS format_pattern,
    upper(fmt[1]) || fmt[2:] || ' running about ' || CAST(CAST(floor(d) AS BIGINT) AS VARCHAR) || ' seconds, structured as '
    || array_to_string(beat_list, ' → ') || '. Adoption is ' || CASE WHEN {rnd('g * 100', 1)} > 0 THEN 'growing' ELSE 'cooling' END || ' ('
    || CASE WHEN {rnd('g * 100', 0)} >= 0 THEN '+' ELSE '' END || CAST(CAST({rnd('g * 100', 0)} AS BIGINT) AS VARCHAR) || '% week over week) across '
    || CAST(niches AS VARCHAR) || ' niche(s).' AS summary,
    'Structure: ' || array_to_string(beat_list, ' → ') || ' | Median duration: ' || CAST(CAST(floor(d) AS BIGINT) AS VARCHAR) || 's | ' || e AS common_elements,
    'curiosity_gap,concrete_promise,low_production_cost' || CASE WHEN niches >= 3 THEN ',topic_portable' ELSE '' END
    || CASE WHEN payoff THEN ',visible_payoff' ELSE '' END AS mechanisms
  FROM st JOIN fmt USING (trend_id) JOIN modals USING (trend_id) JOIN edits USING (trend_id) LEFT JOIN opens USING (trend_id)"""
_SLUGS = """SELECT page_id, CASE WHEN r = 1 THEN base ELSE base || '-' || CAST(r AS VARCHAR) END AS slug FROM (
  SELECT page_id, base, row_number() OVER (PARTITION BY base ORDER BY page_id) AS r FROM (
  SELECT page_id, COALESCE(NULLIF(substr(trim(regexp_replace(lower(regexp_extract(url, '^https?://[^/]+/(.*)$', 1)), '[^a-z0-9]+', '-', 'g'), '-'), 1, 150), ''), 'trend') AS base
  FROM pages))"""
_UNIT = "list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)))"
_PLANTED = """planted AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS u FROM (
  SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x, i: x * 0.5 + CASE WHEN i - 1 = label THEN 1.0 ELSE 0.0 END) AS e FROM embeddings))"""
_CENT = "list_transform(c, lambda x: x / sqrt(list_dot_product(c, c)))"
_EDGES = f"""edges AS (SELECT a.vec_id AS a, b.vec_id AS b FROM vecs a JOIN vecs b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= {GRAPH_CUT})"""

QUERIES = {
    "token_counts": (token_counts, sql(
        "SELECT lang, t AS token, count(*) AS n FROM (SELECT lang, unnest(toks) AS t FROM tokens) GROUP BY 1, 2", "tokens")),
    "bigram_counts": (bigram_counts, sql(
        """SELECT lang, p AS pair, count(*) AS n FROM (SELECT lang,
        unnest(list_transform(range(1, len(toks)), lambda i: toks[i] || '_' || toks[i + 1])) AS p FROM tokens WHERE len(toks) > 1) GROUP BY 1, 2""", "tokens")),
    "top_terms": (top_terms, sql(
        """SELECT lang, element, n, rank FROM (SELECT lang, element, count(*) AS n, row_number() OVER (
        PARTITION BY lang ORDER BY count(*) DESC, min((doc_id, i)), element) AS rank FROM (
        SELECT lang, doc_id, unnest(toks) AS element, generate_subscripts(toks, 1) AS i FROM tokens) GROUP BY lang, element)
        WHERE rank <= 4""", "tokens")),
    "search_text": (search_text, "SELECT doc_id, lang FROM documents WHERE text ILIKE '%THE_TH%ON%'"),
    "format_classes": (format_classes, sql(
        "SELECT content_format, beats, count(*) AS n FROM docs GROUP BY 1, 2", "docs")),
    "heuristic_features": (heuristic_features, sql(
        """SELECT item_id, COALESCE(NULLIF(hook180, ''), '(hook not recoverable from metadata)') AS hook,
        niche || ' content' AS topic, content_format, beats, hook240 AS main_message, niche AS target_audience,
        'original audio' AS audio_style, CASE WHEN duration_sec <= 45 THEN 'low' ELSE 'medium' END AS production_difficulty
        FROM docs""", "docs")),
    "first_sentence": (first_sentence, sql("SELECT item_id AS doc_id, hook180 AS hook FROM docs", "docs")),
    "format_signature": (format_signature, sql(_SIG, "docs")),
    "hash_embed": (hash_embed, None),
    "enriched_tiers": (enriched_tiers, """WITH d AS (SELECT CASE lang WHEN 'de' THEN 1 ELSE 2 END AS run, n_chars,
          row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r, count(*) OVER (PARTITION BY lang) AS size FROM documents
          WHERE text <> '' AND lang IN ('de', 'fr')),
        room AS (SELECT 1 AS run, 300 AS most UNION ALL SELECT 2, greatest(0, 300 - (SELECT count(*) FROM d WHERE run = 1)))
        SELECT run, CASE WHEN r > most THEN NULL WHEN n_chars % 10 = 0 THEN 'local' ELSE 'hosted' END AS tier,
          CASE WHEN r > most THEN 'quota' WHEN n_chars % 10 = 0 THEN 'error' END AS fallback_reason, count(*) AS n
        FROM d JOIN room USING (run) GROUP BY 1, 2, 3"""),
    "fallback_count": (fallback_count, """SELECT count(*) AS fallbacks FROM documents
        WHERE doc_id NOT IN (SELECT doc_id FROM labels)"""),
    "upgrade_features": (upgrade_features, """SELECT d.doc_id AS item_id,
        CASE WHEN l.doc_id IS NULL THEN 'heuristic' ELSE 'hosted' END AS extraction_model,
        CASE WHEN l.doc_id IS NULL THEN source ELSE 'quality ' || CAST(quality AS VARCHAR) END AS topic,
        l.doc_id IS NULL AS is_fallback
        FROM documents d LEFT JOIN (SELECT * FROM labels WHERE toxic = 0) l ON l.doc_id = d.doc_id"""),
    "modal_sequence": (modal_sequence, sql("", "convs").rstrip() + f", {_MODAL} SELECT trend_id, beats FROM modal"),
    "common_opening": (common_opening, _OPEN),
    "mode_label": (mode_label, sql(
        """SELECT trend_id, last FROM (SELECT trend_id, beats[-1] AS last, row_number() OVER (
        PARTITION BY trend_id ORDER BY count(*) DESC, min(item_id)) AS r FROM convs GROUP BY 1, 2) WHERE r = 1""", "convs")),
    "top_elements": (top_elements, """SELECT trend_id, element, n, rank FROM (
        SELECT CAST(turn % 3 AS VARCHAR) AS trend_id, role AS element, count(*) AS n, row_number() OVER (
        PARTITION BY turn % 3 ORDER BY count(*) DESC, min((conv_id, turn)), role) AS rank
        FROM conversations GROUP BY turn % 3, role) WHERE rank <= 2"""),
    "timed_structure": (timed_structure, sql("", "convs").rstrip() + f", {_MODAL} {_TIMED}"),
    "example_hooks": (example_hooks, sql(
        """SELECT trend_id, q - 1 AS pos, hook FROM (SELECT trend_id, hook, row_number() OVER (PARTITION BY trend_id ORDER BY r) AS q FROM (
        SELECT trend_id, hook, row_number() OVER (PARTITION BY trend_id ORDER BY turns DESC, item_id) AS r FROM convs)
        WHERE r <= 8 AND COALESCE(hook, '') <> '') WHERE q <= 5""", "convs")),
    "describe_trend": (describe_trend, sql("", "convs").rstrip() + _DESCRIBE),
    "slugs": (slugs, _SLUGS),
    "l2_normalized": (l2_normalized, f"""SELECT vec_id, CASE WHEN vec_id = 0 THEN 0.0 ELSE round(sqrt(list_dot_product(u, u)), 6) END AS norm,
        CASE WHEN vec_id = 0 THEN 0.0 ELSE round(u[1], 6) END AS first FROM (SELECT vec_id,
        list_transform(v, lambda x: x * vec_id / (vec_id * sqrt(list_dot_product(v, v)))) AS u
        FROM (SELECT vec_id, {VEC} AS v FROM embeddings))"""),
    "cosine_pairs": (cosine_pairs, sql(
        """SELECT a.vec_id, round(list_cosine_similarity(a.v, b.v), 6) AS similarity
        FROM vecs a JOIN vecs b ON a.label = b.label AND b.vec_id = a.vec_id + 1""", "vecs")),
    "label_centroids": (label_centroids, sql(
        f"""SELECT label, generate_subscripts(u, 1) - 1 AS pos, round(unnest(u), 6) AS x
        FROM (SELECT label, {_CENT} AS u FROM cents)""", "cents")),
    "nearest_centroid": (nearest_centroid, sql(
        f"""SELECT vec_id, CASE WHEN s >= {ASSIGN_CUT} THEN label END AS label, round(greatest(0.0, s), 6) AS similarity FROM (
        SELECT vec_id, max(s) AS s, arg_max(label, s) AS label FROM (
        SELECT v.vec_id, c.label, list_cosine_similarity(v.v, c.c) AS s FROM vecs v, cents c) GROUP BY vec_id)""", "cents")),
    "prototypicality": (prototypicality, sql(
        """SELECT v.label AS trend_id, vec_id, round(list_cosine_similarity(v.v, c.c), 4) AS similarity
        FROM vecs v JOIN cents c ON c.label = v.label""", "cents")),
    "exemplars_by_similarity": (exemplars_by_similarity, sql(
        """SELECT trend_id, item_id, rank, similarity FROM (SELECT *, row_number() OVER (
        PARTITION BY trend_id ORDER BY similarity DESC, item_id) AS rank FROM (
        SELECT v.label AS trend_id, vec_id AS item_id, round(list_cosine_similarity(v.v, c.c), 4) AS similarity
        FROM vecs v JOIN cents c ON c.label = v.label)) WHERE rank <= 4""", "cents")),
    "pairs_above": (pairs_above, sql(
        f"""SELECT a.vec_id AS id_a, b.vec_id AS id_b, round(list_cosine_similarity(a.v, b.v), 4) AS similarity
        FROM vecs a JOIN vecs b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= {PAIR_CUT}""", "vecs")),
    "components": (components, sql("", "vecs", recursive=True).rstrip() + f""",
        {_EDGES}, reach AS (SELECT a AS id, a AS other FROM edges UNION SELECT r.id, e.b FROM reach r JOIN edges e ON e.a = r.other)
        SELECT id, min(other) AS component FROM reach GROUP BY id"""),
    "cluster_precheck": (cluster_precheck, """SELECT count(*) AS rows, count(*) FILTER (COALESCE(len(embedding), 0) = 0) AS missing,
        CASE WHEN count(*) = 0 THEN 'no analysed items in window'
        WHEN count(*) FILTER (COALESCE(len(embedding), 0) = 0) > 0 THEN 'some analyses are missing embeddings'
        WHEN count(*) < 4 THEN 'no cluster met the minimum size' END AS reason FROM embeddings"""),
    "sparse_pairs": (sparse_pairs, f"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS word FROM documents),
        e AS (SELECT doc_id, CAST('0x' || md5(word)[1:8] AS BIGINT) % {SPARSE_DIMS} AS d, count(*)::DOUBLE AS n FROM w GROUP BY 1, 2),
        u AS (SELECT doc_id, d, n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)) AS x FROM e)
        SELECT a.doc_id AS id_a, b.doc_id AS id_b, round(sum(a.x * b.x), 6) AS similarity FROM u a JOIN u b ON a.d = b.d AND a.doc_id < b.doc_id
        GROUP BY 1, 2 HAVING sum(a.x * b.x) >= {SPARSE_CUT}"""),
    "format_clusters": (format_clusters, f"""WITH {_PLANTED}, sized AS (SELECT label, min(vec_id) AS trend_id, count(*) AS size FROM planted GROUP BY label),
        mean AS (SELECT label, list(x ORDER BY pos) AS c FROM (SELECT label, pos, avg(x) AS x FROM (
          SELECT label, unnest(u) AS x, generate_subscripts(u, 1) AS pos FROM planted) GROUP BY label, pos) GROUP BY label)
        SELECT trend_id, vec_id, {rnd("list_cosine_similarity(u, c)", 4)} AS similarity, size FROM planted JOIN sized USING (label) JOIN mean USING (label)
        WHERE size >= 3"""),
    "cluster_purity": (cluster_purity, f"""WITH {_PLANTED}, sized AS (SELECT label, min(vec_id) AS trend_id, count(*) AS size FROM planted GROUP BY label),
        said AS (SELECT label, CASE WHEN vec_id % 7 = 0 THEN label + 1 ELSE label END AS truth, count(*) AS n FROM planted GROUP BY 1, 2)
        SELECT trend_id, any_value(size) AS size, arg_min(truth, (-n, truth)) AS majority, round(max(n) / any_value(size)::DOUBLE, 6) AS purity
        FROM said JOIN sized USING (label) WHERE size >= 3 GROUP BY trend_id"""),
    "leader_clusters": (leader_clusters, sql(f"""SELECT vec_id, coalesce((SELECT arg_min(l.vec_id, (-list_cosine_similarity(l.v, o.v), l.vec_id))
          FROM ordered l WHERE list_contains(n.leaders, l.vec_id) AND list_cosine_similarity(l.v, o.v) >= {CLUSTER_CUT}
          AND NOT list_contains(n.leaders, o.vec_id)), vec_id) AS trend_id
        FROM ordered o, (SELECT leaders FROM elected ORDER BY k DESC LIMIT 1) n""", "vecs").replace("WITH ", "WITH RECURSIVE ", 1).replace(
        "SELECT vec_id, coalesce", f""", ordered AS (SELECT vec_id, v, row_number() OVER (ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id) AS k FROM vecs),
        near AS (SELECT b.k, list(a.vec_id) AS ids FROM ordered a JOIN ordered b ON a.k < b.k AND list_cosine_similarity(a.v, b.v) >= {CLUSTER_CUT} GROUP BY b.k),
        elected(k, leaders) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL
          SELECT o.k, CASE WHEN list_has_any(e.leaders, coalesce(near.ids, [])) THEN e.leaders ELSE list_append(e.leaders, o.vec_id) END
          FROM elected e JOIN ordered o ON o.k = e.k + 1 LEFT JOIN near ON near.k = o.k)
        SELECT vec_id, coalesce""", 1)),
    "similarity_quantiles": (similarity_quantiles, None),
    # at the two lower cuts the clusters are the labels, at the highest one nothing meets
    "threshold_sweep": (threshold_sweep, f"""WITH sized AS (SELECT count(*) AS n FROM embeddings GROUP BY label), whole AS (
          SELECT count(*) FILTER (n >= {K.MIN_SIZE}) AS trends, coalesce(sum(n) FILTER (n >= {K.MIN_SIZE}), 0)::BIGINT AS covered,
          coalesce(max(n) FILTER (n >= {K.MIN_SIZE}), 0) AS largest, sum(n) AS total FROM sized),
        cuts AS (SELECT unnest([{", ".join(f"{c}::DOUBLE" for c in SWEEP)}]) AS threshold),
        judged AS (SELECT threshold, CASE WHEN threshold < 0.99 THEN trends ELSE 0 END AS trends, CASE WHEN threshold < 0.99 THEN covered ELSE 0 END AS covered,
          CASE WHEN threshold < 0.99 THEN largest ELSE 0 END AS largest, total FROM cuts, whole),
        said AS (SELECT *, CASE WHEN trends = 0 THEN 'nothing clusters' WHEN trends = 1 OR largest / greatest(1, covered)::DOUBLE > 0.6 THEN 'over-merged'
          WHEN covered / total::DOUBLE < 0.15 THEN 'too strict' WHEN trends > total / 6.0 THEN 'fragmented' ELSE 'usable' END AS verdict FROM judged)
        SELECT threshold, trends, covered, largest, round(covered / total::DOUBLE, 6) AS coverage, verdict,
          coalesce(threshold = (SELECT arg_min(threshold, (-covered, threshold)) FROM said WHERE verdict = 'usable'), false) AS suggested FROM said"""),
}
