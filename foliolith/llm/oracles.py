"""DuckDB SQL for the queries that SQL expresses, written apart from their Spark form."""

from __future__ import annotations

from foliolith.llm.quality import STOP_WORDS

_WS = r"[\x20\x09-\x0D]"
_STOP = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))

OP2 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '{_WS}+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 7), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS c FROM rep, range(0, 8) g(k) GROUP BY 1),
m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '{_WS}+', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls, coalesce(c, 0)::BIGINT AS n_repeat_words,
  len(list_filter(w, lambda x: lower(x) IN ({_STOP}))) AS n_stop, len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_letter FROM d LEFT JOIN cov USING (doc_id)),
f AS (SELECT *, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_words >= 20 AND word_chars >= 2.0 * n_words AND word_chars <= 20.0 * n_words AND n_symbols <= 0.3 * n_words AND n_stop >= 0.02 * n_words
  AND n_dup_lines <= 0.5 * len(ls) AND n_letter >= 0.5 * n_words
  AND len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…){_WS}*$'))) <= 0.5 * len(ls) AND len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09]*[•*-]'))) <= 0.9 * len(ls) AS kept FROM f
"""

OP3 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^$', ''), '{_WS}+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""

OP8 = r"""
WITH t AS (SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
x AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS body,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
  sum(length('<|im_start|>') + length(role) + 1 + length(regexp_replace(text, '([<\[])(\\*)(\|[A-Za-z0-9_]*\|>|/?s>|/?SYS>>|/?INST\])', '\1\\\2\3', 'g')) + length('<|im_end|>') + 1) AS n FROM t GROUP BY 1)
SELECT conv_id, n_turns, sha256(body) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, n::BIGINT AS formatted_chars FROM x
"""

_WORDS9 = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
OP9 = rf"""
WITH d AS (SELECT doc_id, {_WORDS9} AS w FROM documents), b AS (SELECT item_id, {_WORDS9} AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
o AS (SELECT doc_id, item_id, i, n FROM dw JOIN bw USING (n, s)),
h AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM o, range(0, 10) g(k) WHERE k < n GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM o) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""

OP10 = """
WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), a AS (SELECT sum(n) AS an, sum(sqrt(n)) AS all_t FROM c),
r AS (SELECT source, sqrt(n) / all_t * an / n AS m FROM c, a),
p AS (SELECT source, k, sum(exp(-m + k * ln(m) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf FROM r, range(0, 80) g(k)),
q AS (SELECT source, list(cdf ORDER BY k) AS cdf FROM p GROUP BY 1),
x AS (SELECT d.*, len(list_filter(cdf, lambda v: v <= ('0x' || substr(md5('mix-1|' || doc_id || '|1'), 1, 13))::BIGINT / 4503599627370496.0)) AS times FROM documents d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
y AS (SELECT doc_id, text, lang, source, n_chars, unnest(range(0, times))::INT AS copy_no FROM x)
SELECT *, md5('mix-1|' || doc_id || '|s|' || copy_no) AS shuffle_key FROM y
"""

SQL = {"op2_quality": OP2, "op3_neardup": OP3, "op8_chat": OP8, "op9_decontaminate": OP9, "op10_mixing": OP10}
