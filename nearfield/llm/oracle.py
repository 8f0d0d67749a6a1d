"""The queries that SQL can express, as DuckDB SQL over whole tables."""

from __future__ import annotations

WORDS = r"[^\x20\x09-\x0D]+"


def _level(nodes: str, parents: str, name: str) -> str:
    """Nodes (cap, weight, budget of the parent) with their own budget, ``own``."""
    family = f"PARTITION BY {parents}" if parents else ""
    order = f"{family} ORDER BY CASE WHEN weight > 0 THEN cap / weight ELSE 'inf'::DOUBLE END, {name}"
    return f"""
    SELECT *, CASE WHEN fits THEN cap WHEN open_weight = 0 THEN 0 ELSE (budget - taken) * weight // open_weight END AS own
    FROM (
      SELECT *, sum(CASE WHEN fits THEN cap ELSE 0 END) OVER ({family}) AS taken,
        sum(CASE WHEN fits THEN 0 ELSE weight END) OVER ({family}) AS open_weight
      FROM (
        SELECT *, cap * sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) <= weight * (budget
          - coalesce(sum(cap) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS fits
        FROM ({nodes})))"""


_DOMAINS = """
  SELECT domain, sum(cap) AS cap, (SELECT sum(tokens) FROM leaves) AS budget,
    CASE domain WHEN 'web' THEN 4 WHEN 'books' THEN 3 WHEN 'forums' THEN 2 ELSE 1 END AS weight
  FROM leaves GROUP BY domain"""
_LANGS = """
  SELECT domain, lang, l.cap, own AS budget, CASE lang WHEN 'en' THEN 6 WHEN 'fr' THEN 2 WHEN 'de' THEN 2 ELSE 1 END AS weight
  FROM (SELECT domain, lang, sum(cap) AS cap FROM leaves GROUP BY ALL) l JOIN (SELECT domain, own FROM domains) USING (domain)"""
_SOURCES = """
  SELECT domain, lang, source, l.cap, tokens, own AS budget, 1 AS weight
  FROM leaves l JOIN (SELECT domain, lang, own FROM langs) USING (domain, lang)"""

MIXING = f"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    len(regexp_extract_all(coalesce(text, ''), '{WORDS}')) AS tokens,
    CASE TRY_CAST(regexp_extract(source, '^src([0-9]+)$', 1) AS INT) // 5
      WHEN 0 THEN 'web' WHEN 1 THEN 'books' WHEN 2 THEN 'forums' WHEN 3 THEN 'news' ELSE 'other' END AS domain
  FROM documents),
leaves AS (SELECT domain, lang, source, sum(tokens) AS tokens, 2 * sum(tokens) AS cap FROM d GROUP BY ALL),
domains AS ({_level(_DOMAINS, "", "domain")}),
langs AS ({_level(_LANGS, "domain", "lang")}),
sources AS ({_level(_SOURCES, "domain, lang", "source")}),
passes AS (SELECT domain, lang, source, own, tokens AS supply, CASE WHEN tokens > 0 THEN (own // tokens)::BIGINT ELSE 0 END AS passes FROM sources),
placed AS (
  SELECT doc_id, domain, lang, source, passes, own - passes * supply AS room,
    sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('1:' || passes || ':' || coalesce(doc_id::VARCHAR, 'null'))) AS upto
  FROM d JOIN passes USING (domain, lang, source))
SELECT doc_id, domain, lang, source, (passes + CASE WHEN upto <= room AND (room > 0 OR passes = 0) THEN 1 ELSE 0 END)::INT AS epochs
FROM placed WHERE passes + CASE WHEN upto <= room AND (room > 0 OR passes = 0) THEN 1 ELSE 0 END > 0
"""

CHAT = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
c AS (SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY turn, role, text) AS turns FROM t GROUP BY conv_id)
SELECT conv_id, len(turns) AS n_turns,
  array_to_string(list_transform(turns, lambda x: '<|im_start|>' || replace(x.role, '<|', '< |') || chr(10)
    || replace(x.text, '<|', '< |') || '<|im_end|>' || chr(10)), '') AS text
FROM c WHERE NOT EXISTS (
  SELECT 1 FROM c AS o
  WHERE (len(o.turns) > len(c.turns) AND o.turns[1:len(c.turns)] = c.turns) OR (o.turns = c.turns AND o.conv_id < c.conv_id))
"""

SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS w FROM documents),
windows AS (SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS k FROM d, unnest(range(1, len(w) - 18)) AS u(s)),
late AS (SELECT doc_id, s FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS nth FROM windows) WHERE nth > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM late),
words AS (SELECT doc_id, p, w[p] AS word FROM d, unnest(range(1, len(w) + 1)) AS u(p)),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n
  FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

SQL: dict[str, str] = {
    "op2_mixing_sources": MIXING,
    "op3_chat_formatting": CHAT,
    "op4_substring_dedup": SUBSTRINGS,
}
