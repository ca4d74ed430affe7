"""The same results in DuckDB SQL, where SQL can express them on whole tables."""

from __future__ import annotations

from barloom.llm import chat

SQL: dict[str, str] = {}

SQL["op1_warc_archive"] = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS payload FROM pages),
d AS (SELECT *, sha256(payload) AS digest FROM p),
f AS (SELECT digest, min(page_id) AS first_id FROM d GROUP BY digest)
SELECT page_id, strlen(payload) AS payload_bytes, digest AS payload_digest,
  CASE WHEN strlen(payload) >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN strlen(payload) >= 100 AND page_id > first_id THEN first_id END AS refers_to, url AS target_uri
FROM d JOIN f USING (digest)"""

_labels = " ".join(f"WHEN '{role}' THEN {len(label)}" for role, label in chat.LABELS.items())
_around = len(chat.MARK) + len(chat.LABEL_END) + len(chat.TURN_END) + len(chat.LINE_END)
SQL["op2_chat_format"] = rf"""
WITH t AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
b AS (
  SELECT *, CASE WHEN contains(text, '###') OR contains(text, '</turn>') OR regexp_replace(text, '\\(.)', '\1', 'gs') <> text
    THEN regexp_replace(text, '([\\#/])', '\\\1', 'g') ELSE text END AS body
  FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({_around} + CASE role {_labels} END + length(body))::BIGINT AS formatted_chars
FROM b GROUP BY conv_id"""


_lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_words = rf"regexp_extract_all(coalesce({_lower}, ''), '[^\x20\x09-\x0D]+')"


def shingles_cte(name: str, table: str, key: str, width: int) -> str:
    """Distinct word shingles (``key``, s) of a table's texts; a shorter text is one shingle."""
    run = f"list_transform(range(1, greatest(len(w) - {width - 1}, 1) + 1), lambda i: list_aggregate(w[i:i + {width - 1}], 'string_agg', ' '))"
    return f"""
{name} AS (
  SELECT DISTINCT {key}, unnest({run}) AS s FROM (SELECT {key}, {_words} AS w FROM {table}) WHERE len(w) > 0)"""


def components_cte(nodes: str, links: str) -> str:
    """(node, component) from ``nodes`` (node) and symmetric ``links`` (x, y)."""
    return f"""
reach(a, b) AS (
  SELECT node, node FROM {nodes} UNION SELECT r.a, l.y FROM reach r JOIN {links} l ON r.b = l.x),
comp AS (SELECT a AS node, min(b) AS component FROM reach GROUP BY a)"""


SQL["op4_ngram_jaccard_join"] = f"""
WITH RECURSIVE {shingles_cte("s", "documents", "doc_id", 3)},
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT x, y FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL)
  JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * o >= 90 * (nx.n + ny.n - o)),
nodes AS (SELECT doc_id AS node FROM documents), {components_cte("nodes", "links")}
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN comp ON comp.node = d.doc_id"""

SQL["op6_embedding_near_dedup"] = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND list_aggregate(list_transform(embedding, lambda x: abs(x)), 'max') > 0),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
nodes AS (SELECT vec_id AS node FROM embeddings), {components_cte("nodes", "links")},
n AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, component AS component_id, vec_id = component AS kept
FROM embeddings JOIN comp ON node = vec_id LEFT JOIN n ON x = vec_id"""

SQL["op7_benchmark_decontamination"] = f"""
WITH {shingles_cte("whole", "documents", "doc_id", 5)}, {shingles_cte("i", "benchmark", "item_id", 5)},
widths AS (SELECT DISTINCT len({_words}) AS k FROM benchmark WHERE len({_words}) BETWEEN 1 AND 4),
d AS (
  SELECT doc_id, s FROM whole
  UNION SELECT doc_id, unnest(list_transform(range(1, len(w) - k + 2), lambda i: list_aggregate(w[i:i + k - 1], 'string_agg', ' ')))
  FROM (SELECT doc_id, {_words} AS w FROM documents), widths WHERE len(w) >= k),
n AS (SELECT item_id, count(*) AS n FROM i GROUP BY item_id)
SELECT doc_id, item_id, n AS item_shingles, o AS shared_shingles
FROM (SELECT doc_id, item_id, count(*) AS o FROM d JOIN i USING (s) GROUP BY ALL) JOIN n USING (item_id) WHERE 100 * o >= 80 * n"""

_gram = "(SELECT {key}, count(*) AS c FROM w WHERE {key} IS NOT NULL GROUP BY 1)"
_own = "(SELECT doc_id, {key}, count(*) AS c FROM w WHERE {key} IS NOT NULL GROUP BY 1, 2)"


def _elsewhere(k: int) -> str:
    key = f"g{k}"
    return f"""
e{k} AS (SELECT o.doc_id, o.{key}, a.c - o.c AS e FROM {_own.format(key=key)} o JOIN {_gram.format(key=key)} a ON o.{key} = a.{key})"""


SQL["op9_lm_scores"] = rf"""
WITH raw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (
  SELECT doc_id, i, ws[i] AS g1, CASE WHEN i > 1 THEN ws[i - 1] || ' ' || ws[i] END AS g2,
         CASE WHEN i > 2 THEN ws[i - 2] || ' ' || ws[i - 1] || ' ' || ws[i] END AS g3,
         CASE WHEN i > 1 THEN ws[i - 1] END AS h1, CASE WHEN i > 2 THEN ws[i - 2] || ' ' || ws[i - 1] END AS h2
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM raw)),
{_elsewhere(1)}, {_elsewhere(2)}, {_elsewhere(3)},
n AS (SELECT doc_id, len(ws) AS n_words, greatest(1, sum(len(ws)) OVER () - len(ws))::DOUBLE AS rest FROM raw),
scored AS (
  SELECT w.doc_id,
    CASE WHEN c3.e > 0 THEN 3 WHEN c2.e > 0 THEN 2 WHEN c1.e > 0 THEN 1 ELSE 0 END AS k,
    CASE WHEN c3.e > 0 THEN ln(c3.e) - ln(p2.e) WHEN c2.e > 0 THEN ln(c2.e) - ln(p1.e)
         WHEN c1.e > 0 THEN ln(c1.e) - ln(rest) ELSE -ln(rest + 1) END + ln(0.4::DOUBLE) * (least(i, 3) - k) AS score
  FROM w JOIN n ON n.doc_id = w.doc_id
  LEFT JOIN e3 c3 ON c3.doc_id = w.doc_id AND c3.g3 = w.g3 LEFT JOIN e2 c2 ON c2.doc_id = w.doc_id AND c2.g2 = w.g2
  LEFT JOIN e1 c1 ON c1.doc_id = w.doc_id AND c1.g1 = w.g1 LEFT JOIN e2 p2 ON p2.doc_id = w.doc_id AND p2.g2 = w.h2
  LEFT JOIN e1 p1 ON p1.doc_id = w.doc_id AND p1.g1 = w.h1)
SELECT n.doc_id, n_words, round(coalesce(sum(score), 0), 4) + 0.0::DOUBLE AS log_score,
  CASE WHEN n_words > 0 THEN round(sum(score) / n_words, 4) + 0.0::DOUBLE END AS mean_log_score,
  count(*) FILTER (k = 0) AS order_0, count(*) FILTER (k = 1) AS order_1, count(*) FILTER (k = 2) AS order_2, count(*) FILTER (k = 3) AS order_3
FROM n LEFT JOIN scored USING (doc_id) GROUP BY n.doc_id, n_words"""


def _crc_steps() -> str:
    """The 16 values by which the low four bits of a register change it, for polynomial 0xEDB88320."""
    values = []
    for x in range(16):
        for _ in range(4):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        values.append(f"{x}::BIGINT")
    return f"[{', '.join(values)}]"


_LOWERED = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: crc32 goes through a text's bytes in two steps of four bits, the low ones first.
_nibbles = "flatten(list_transform(range(1, strlen(f) + 1), lambda i: [('0x' || hex(f)[2*i:2*i])::BIGINT, ('0x' || hex(f)[2*i-1:2*i-1])::BIGINT]))"
_crc = f"xor(list_reduce({_nibbles}, lambda a, x: xor(a >> 4, steps[(xor(a, x) & 15) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)"
SQL["op12_importance_resampling"] = rf"""
WITH raw AS (
  SELECT true AS ours, doc_id AS id, text FROM documents UNION ALL SELECT false, item_id, text FROM benchmark),
w AS (SELECT ours, id, regexp_extract_all({_LOWERED.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM raw),
g AS (SELECT ours, id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM w),
c AS (SELECT f, {_crc} % 10000 AS b FROM (SELECT DISTINCT f, {_crc_steps()} AS steps FROM g)),
h AS (SELECT b, count(*) FILTER (ours) AS s, count(*) FILTER (NOT ours) AS t FROM g JOIN c USING (f) GROUP BY b),
n AS (SELECT sum(s)::DOUBLE AS s_all, sum(t)::DOUBLE AS t_all FROM h),
gain AS (SELECT b, floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000) / ((s + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS gain FROM h, n),
d AS (SELECT id, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight
      FROM g JOIN c USING (f) JOIN gain USING (b) WHERE ours GROUP BY id),
z AS (
  SELECT id AS doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, len(w) >= 20 AS fit,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('7:' || id)[:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM w LEFT JOIN d USING (id) WHERE ours),
r AS (SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id) AS place, count(*) FILTER (fit) OVER () AS n FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= 25 * n // 100 THEN place END AS rank FROM r"""

SQL["op11_phrase_collocations"] = rf"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWERED.format("text")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, range(1, 6) t(k)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (
  SELECT f.lang, f.phrase, f.a, cut, l.a AS l, r.a AS r, n,
    (1000::HUGEINT * f.a * n // (l.a::HUGEINT * r.a))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut, string_split(phrase, ' ') AS ws FROM f WHERE k > 1) f
  JOIN f l ON l.lang = f.lang AND l.phrase = array_to_string(ws[:cut], ' ')
  JOIN f r ON r.lang = f.lang AND r.phrase = array_to_string(ws[cut + 1:], ' ') JOIN n ON n.lang = f.lang),
low AS (SELECT lang, phrase, a, n, arg_min(l, (score, cut)) AS l, arg_min(r, (score, cut)) AS r, min(score) AS score FROM c GROUP BY ALL),
kept AS (
  SELECT * FROM low WHERE NOT EXISTS (
    SELECT 1 FROM f x WHERE x.lang = low.lang AND x.a = low.a AND len(x.phrase) > len(low.phrase) AND contains(' ' || x.phrase || ' ', ' ' || low.phrase || ' '))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000"""
