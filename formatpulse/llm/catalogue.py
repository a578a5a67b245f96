"""The registered queries and their SQL, where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formatpulse.llm import (
    decontam, fim, licenses, linededup, merkle, mixing, orderminhash, quality, repeats, tokens, toxicity, urls, vectordedup,
)
from formatpulse.llm.common import WORD, table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "source", "lang", "topic", "n_tokens", "probability", "weight", "kept")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"))


def op4_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orderminhash.classes(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_removed", "n_runs", "n_chars",
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify_documents(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.fill_in_middle(table(spark, sf_dir, "documents"))


def op13_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectordedup.near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_mix_sources": op2_mix_sources,
    "op3_token_counts": op3_token_counts,
    "op4_repeated_bytes": op4_repeated_bytes,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_quality_rules": op6_quality_rules,
    "op7_toxicity": op7_toxicity,
    "op8_url_filter": op8_url_filter,
    "op9_line_dedup": op9_line_dedup,
    "op10_decontaminate": op10_decontaminate,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_near_vectors": op13_near_vectors,
}

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "'" + WORD + "'"


def _values(rows) -> str:
    quoted = [", ".join(str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'" for v in r) for r in rows]
    return "(VALUES " + ", ".join(f"({r})" for r in quoted) + ")"


_PHRASES = _values([(p, p.count(" ") + 1, label) for p, label in licenses.PHRASES.items()])
_TEMPLATES = _values([
    (label, k, len(licenses.template_words(t)), w) for label, texts in licenses.TEMPLATES.items()
    for k, t in enumerate(texts) for w in licenses.template_words(t)])


def _leaf(text: str) -> str:
    parts = [f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
             for c in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(parts)})"


#: Steps of the cyclic redundancy check of an id, one for each bit, lowest first.
_CRC_STEP = "xor(x >> 1, 3988292384 * (x & 1))"
_CRC_EVEN = f"""(xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(
    range(8 * length(CAST(doc_id AS VARCHAR))), lambda i: i::UBIGINT)), lambda acc, i: list_transform([CASE WHEN i % 8 = 0
    THEN xor(acc, ascii(substr(CAST(doc_id AS VARCHAR), (i // 8)::BIGINT + 1, 1))::UBIGINT) ELSE acc END],
    lambda x: {_CRC_STEP})[1]), 4294967295) % 2 = 0)"""

SQL = {
    # trees level by level, then every leaf's siblings, then the fold of every leaf along them
    "op11_merkle_manifest": f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {_leaf('text')} AS leaf,
          {_leaf("(CASE WHEN " + _CRC_EVEN + " THEN replace(text, chr(10), '') ELSE text END)")} AS other,
          dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s FROM documents),
        e AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
          count(*) OVER (PARTITION BY s) AS n FROM d),
        low(l, s, i, h, n) AS (SELECT 0, s, i, leaf, n FROM e UNION ALL
          SELECT l + 1, s, i // 3, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 2) // 3)
          FROM low WHERE n > 1 GROUP BY l, s, i // 3),
        sub AS (SELECT s, h, l FROM low WHERE n = 1),
        high(l, i, h, n) AS (SELECT 0, s, h, (SELECT count(*) FROM sub) FROM sub UNION ALL
          SELECT l + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 2) // 3)
          FROM high WHERE n > 1 GROUP BY l, i // 3),
        steps AS (SELECT e.r, k.l, (e.i // pow(3, k.l)::BIGINT) AS i, e.s, e.s AS of FROM e JOIN sub USING (s), LATERAL (SELECT unnest(range(sub.l)) AS l) k),
        below AS (SELECT p.r, p.l, coalesce(string_agg(q.h, '' ORDER BY q.i) FILTER (q.i < p.i), '') AS a,
          coalesce(string_agg(q.h, '' ORDER BY q.i) FILTER (q.i > p.i), '') AS b FROM steps p
          JOIN low q ON q.s = p.s AND q.l = p.l AND q.i // 3 = p.i // 3 GROUP BY p.r, p.l),
        tops AS (SELECT sub.s, k.l, sub.s // pow(3, k.l)::BIGINT AS i FROM sub, LATERAL (SELECT unnest(range((SELECT max(l) FROM high))) AS l) k),
        above AS (SELECT p.s, p.l, coalesce(string_agg(q.h, '' ORDER BY q.i) FILTER (q.i < p.i), '') AS a,
          coalesce(string_agg(q.h, '' ORDER BY q.i) FILTER (q.i > p.i), '') AS b FROM tops p
          JOIN high q ON q.l = p.l AND q.i // 3 = p.i // 3 GROUP BY p.s, p.l),
        paths AS (SELECT r, l, a, b FROM below UNION ALL SELECT e.r, 1000 + above.l, a, b FROM e JOIN above USING (s)),
        ordered AS (SELECT r, row_number() OVER (PARTITION BY r ORDER BY l) AS k, a, b FROM paths),
        proofs AS (SELECT r, sha256(string_agg(a || b, '' ORDER BY k)) AS proof, count(*) AS size FROM ordered GROUP BY r),
        folds(r, k, h) AS (SELECT r, 0::BIGINT, other FROM e UNION ALL
          SELECT f.r, f.k + 1, sha256(o.a || f.h || o.b) FROM folds f JOIN ordered o ON o.r = f.r AND o.k = f.k + 1),
        root AS (SELECT h FROM high WHERE n = 1)
        SELECT e.doc_id, e.leaf, sub.h AS subroot, root.h AS root, coalesce(p.proof, sha256('')) AS proof_sha256,
          f.h AS folded_root, f.h = root.h AS verified
        FROM e JOIN sub USING (s) CROSS JOIN root LEFT JOIN proofs p USING (r)
        JOIN folds f ON f.r = e.r AND f.k = coalesce(p.size, 0)""",
    "op12_fill_in_middle": """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
        u AS (SELECT *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS w FROM d),
        g AS (SELECT *, len(w)::BIGINT AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
          CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM u),
        f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
          CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
            WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
        c AS (SELECT *, array_to_string(w[1:lo], '') AS p, array_to_string(w[lo + 1:hi], '') AS m, array_to_string(w[hi + 1:], '') AS s FROM f)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
          CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
          sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
            ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM c""",
    # all pairs, then the least id that a walk along links reaches
    "op13_near_vectors": """WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        u AS (SELECT r, vec_id, e FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
          AND len(list_filter(e, lambda x: x <> 0)) > 0),
        links AS (SELECT a.r AS x, b.r AS y FROM u a JOIN u b ON a.r <> b.r AND len(a.e) = len(b.e)
          WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
        reach(x, y) AS (SELECT r, r FROM v UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y),
        parts AS (SELECT reach.x AS r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.y GROUP BY reach.x),
        n AS (SELECT x AS r, count(*) AS n_links FROM links GROUP BY x)
        SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
        FROM v JOIN parts USING (r) LEFT JOIN n USING (r)""",
    # the pruned join returns what this plain one does: containment over all blocks and templates
    "op1_license_scan": f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_FOLD} AS t FROM documents),
        w AS (SELECT r, doc_id, regexp_extract_all(t, {_WORDS}) AS w, string_split(t, chr(10)) AS ls FROM d),
        places AS (SELECT r, i - 1 AS place, label FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM w),
          {_PHRASES} p(phrase, size, label) WHERE array_to_string(w[i:i + size - 1], ' ') = phrase),
        b AS (SELECT r, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word,
          list_sort(list(DISTINCT label)) AS base FROM places GROUP BY r),
        lines AS (SELECT r, ls, unnest(range(1, len(ls) + 1)) AS i FROM w),
        tokens AS (SELECT DISTINCT r, i, unnest(regexp_extract_all(ls[i], {_WORDS})) AS word FROM lines),
        wanted AS (SELECT DISTINCT r, i, word FROM tokens JOIN (SELECT DISTINCT word FROM {_TEMPLATES} t(label, k, size, word)) USING (word)),
        runs AS (SELECT DISTINCT r, b, word FROM (SELECT r, word, unnest(range(greatest(1, i - {licenses.RUN_LINES} + 1), i + 1)) AS b FROM wanted)),
        hits AS (SELECT r, b, label, k, count(*) / any_value(size)::DOUBLE AS share FROM runs
          JOIN {_TEMPLATES} t(label, k, size, word) USING (word) GROUP BY r, b, label, k
          HAVING count(*) / any_value(size)::DOUBLE >= 0.8),
        m AS (SELECT h.r, list(DISTINCT h.label) AS more, max(h.share) AS best, count(DISTINCT h.b) FILTER (o.b IS NULL) AS n_blocks
          FROM hits h LEFT JOIN hits o ON o.r = h.r AND o.label = h.label AND o.k = h.k AND o.b = h.b + 1 GROUP BY h.r)
        SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
          coalesce(array_to_string(base, ','), '') AS base_labels,
          coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(more, [])))), ','), '') AS labels,
          CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0) END AS score, coalesce(n_blocks, 0) AS n_blocks
        FROM w LEFT JOIN b USING (r) LEFT JOIN m USING (r)""",
    # a shortest qualifying run has at most min_words lines, so runs of more lines add nothing
    "op9_line_dedup": f"""WITH d AS (SELECT doc_id, n_chars, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        l AS (SELECT doc_id, i, ls[i] AS line, len(regexp_extract_all(ls[i], '[^\\x20\\x09-\\x0D]+')) AS n
          FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
        q AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS s FROM l WHERE n > 0),
        runs AS (SELECT a.doc_id, a.s, k, string_agg(b.line, chr(10) ORDER BY b.s) AS body
          FROM q a CROSS JOIN (SELECT unnest(range(1, {linededup.MIN_WORDS} + 1)) AS k)
          JOIN q b ON b.doc_id = a.doc_id AND b.s >= a.s AND b.s < a.s + k
          GROUP BY a.doc_id, a.s, k HAVING count(*) = k AND sum(b.n) >= {linededup.MIN_WORDS}),
        f AS (SELECT *, min((doc_id, s)) OVER (PARTITION BY body) AS original FROM runs),
        g AS (SELECT DISTINCT q.doc_id, q.i FROM f JOIN q ON q.doc_id = f.doc_id AND q.s >= f.s AND q.s < f.s + f.k
          WHERE (f.doc_id, f.s) > f.original),
        c AS (SELECT g.doc_id, count(*) AS n_removed, count(*) FILTER (p.i IS NULL) AS n_runs, list(g.i) AS gone
          FROM g LEFT JOIN g p ON p.doc_id = g.doc_id AND p.i = g.i - 1 GROUP BY g.doc_id),
        k AS (SELECT d.doc_id, n_chars, len(ls) AS n_lines, n_removed, n_runs, CASE WHEN gone IS NULL THEN t
          ELSE array_to_string(list_filter(ls, lambda x, i: NOT list_contains(gone, i)), chr(10)) END AS kept
          FROM d LEFT JOIN c USING (doc_id))
        SELECT doc_id, n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_runs, 0) AS n_runs,
          CASE WHEN n_removed > 0 THEN length(kept) ELSE n_chars END AS n_chars, sha256(kept) AS kept_sha256 FROM k""",
    # exact containment of all items in all documents
    "op10_decontaminate": f"""WITH d AS (SELECT doc_id, regexp_extract_all({_FOLD}, {_WORDS}) AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all({_FOLD}, {_WORDS}) AS w FROM benchmark),
        bs AS (SELECT DISTINCT item_id, least(len(w), 5) AS k, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS s
          FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM b)),
        ds AS (SELECT DISTINCT doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i
          FROM d, (SELECT DISTINCT k FROM bs))),
        n AS (SELECT item_id, count(*) AS n FROM bs GROUP BY item_id)
        SELECT doc_id, item_id, count(*) AS n_shared, any_value(n) AS n_shingles, count(*) / any_value(n)::DOUBLE AS containment
        FROM ds JOIN bs USING (k, s) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING count(*) / any_value(n)::DOUBLE >= 0.8""",
}
