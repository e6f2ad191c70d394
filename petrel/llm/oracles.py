"""DuckDB SQL for the operators whose rows SQL can express; each runs over whole tables."""

from __future__ import annotations

from . import chat_parts, warc

WORD = r"[^\x20\x09-\x0D]+"

_COMPONENTS = """
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a),
component AS (SELECT a, least(a, min(b)) AS c FROM reach GROUP BY a)
"""

#: op6: shingle sets, their overlaps, and the closure of the links.
JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(words) < 5 THEN words ELSE words[i:i+4] END AS g FROM w, unnest(range(1, greatest(len(words) - 3, 2))) t(i) WHERE len(words) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * o >= 80 * (p.n + q.n - o)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
{_COMPONENTS}
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c, w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN component ON component.a = w.doc_id
"""

#: op8: every pair of a label by its cosine.
EMBEDDINGS = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
both_ways AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.93),
{_COMPONENTS}
SELECT vec_id, (SELECT count(*) FROM both_ways WHERE a = vec_id) AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN component ON component.a = vec_id
"""

#: op10: all windows with the first document of each, and the words that the later ones cover.
SUBSTRINGS = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents),
p AS (SELECT doc_id, i, words[i:i+12] AS win FROM w, unnest(range(1, greatest(len(words) - 11, 1))) t(i)),
f AS (SELECT win, min(doc_id) AS first FROM p GROUP BY win),
c AS (SELECT DISTINCT doc_id, i + k AS pos FROM p JOIN f USING (win), range(13) r(k) WHERE first < doc_id),
k AS (SELECT w.doc_id, string_agg(words[i], ' ' ORDER BY i) AS kept FROM w, unnest(range(1, len(words) + 1)) t(i) WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = w.doc_id AND c.pos = i) GROUP BY w.doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, (SELECT count(*) FROM c WHERE c.doc_id = w.doc_id) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON k.doc_id = w.doc_id
"""

ORACLES = {
    "op2_warc_normaliser": warc.ORACLE,
    "op3_chat_parts": chat_parts.ORACLE,
    "op6_ngram_jaccard_join": JACCARD,
    "op8_hyperplane_near_duplicates": EMBEDDINGS,
    "op10_fixed_block_anchors": SUBSTRINGS,
}
