"""The same queries as SQL over the same tables, for an independent engine to check."""

from __future__ import annotations

from nearfield.plans.queries import NEGATIVE_IDS, POSITIVE_IDS

SQL: dict[str, str] = {}

# Fixed values, stated here again so that a wrong one in the functions shows.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
PUNCTUATION_PATTERN = r"[^\p{L}\p{N}_\t-\r\x1c-\x20\x85\p{Z}]"
MULTIPLE_SPACES_PATTERN = r"[\t-\r\x1c-\x20\x85\p{Z}]+"
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in",
    "is", "it", "its", "of", "on", "that", "the", "to", "was", "will", "with", "this",
    "but", "they", "have",
)
NUMERIC_LABELS = {"0": "negative", "1": "neutral", "2": "positive"}


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(p for p in parts if p) + "\n"


def _dot(a: str, b: str) -> str:
    return f"list_dot_product({a}::DOUBLE[], {b}::DOUBLE[])"


def _cosine(a: str, b: str) -> str:
    return f"({_dot(a, b)} / nullif(sqrt({_dot(a, a)}) * sqrt({_dot(b, b)}), 0))"


def _euclid(a: str, b: str) -> str:
    return f"list_distance({a}::DOUBLE[], {b}::DOUBLE[])"


def _clean(text: str) -> str:
    bare = f"regexp_replace(lower({text}), '{PUNCTUATION_PATTERN}', '', 'g')"
    return f"trim(regexp_replace({bare}, '{MULTIPLE_SPACES_PATTERN}', ' ', 'g'))"


def _strip(text: str) -> str:
    return f"trim({text}, '{BLANKS}')"


POINTS = "p AS (SELECT vec_id AS id, embedding AS dense, label::VARCHAR AS label FROM embeddings)"
CENTRES = """
    x AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
    m AS (SELECT label, i, avg(x) AS x FROM x GROUP BY label, i),
    q AS (SELECT label::BIGINT AS query_id, list(x ORDER BY i) AS dense FROM m GROUP BY label)"""
PAYLOADS = """
    d AS (SELECT doc_id AS id, quality::VARCHAR AS label, lang, source, n_chars
          FROM documents LEFT JOIN labels USING (doc_id)),
    f AS (SELECT id, label, 'lang' AS key, lang AS value FROM d
          UNION ALL SELECT id, label, 'source', source FROM d
          UNION ALL SELECT id, label, 'n_chars', n_chars::VARCHAR FROM d)"""


def _ranked(
    score: str,
    k: str = "10",
    where: str = "true",
    worse: str = "DESC",
    threshold: str = "true",
    text: bool = False,
) -> str:
    """Best k points of p for every query of q."""
    shown = ", text" if text else ""
    kept = ", p.text" if text else ""
    return f"""
    s AS (SELECT q.query_id, p.id, p.label{kept}, {k} AS k, round({score}, 6) + 0 AS score
          FROM q, p WHERE {where}),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score {worse} NULLS LAST, id) AS place
          FROM s WHERE {threshold})
    SELECT query_id, place::INT AS rank, id, score, coalesce(label, 'unknown') AS label{shown}
    FROM r WHERE place <= k"""


def _centre_search(**options) -> str:
    return _with(POINTS, CENTRES.strip()) .rstrip() + ",\n" + _ranked(**options).strip()


SQL["dense_topk_cosine"] = _centre_search(score=_cosine("p.dense", "q.dense"))
SQL["dense_topk_dot"] = _centre_search(score=_dot("p.dense", "q.dense"))
SQL["dense_topk_euclid"] = _centre_search(score=_euclid("p.dense", "q.dense"), worse="ASC")
SQL["dense_topk_filtered"] = _centre_search(
    score=_cosine("p.dense", "q.dense"), where="p.label = q.query_id::VARCHAR"
)
SQL["dense_topk_condition"] = _centre_search(
    score=_cosine("p.dense", "q.dense"), where="p.label IN ('1', '3', '5') OR p.id < 100"
)
SQL["dense_topk_threshold"] = _centre_search(
    score=_cosine("p.dense", "q.dense"), k="1000", threshold="score >= 0.2"
)
SQL["dense_topk_batch"] = (
    _with(POINTS, "q AS (SELECT id AS query_id, dense FROM p)").rstrip()
    + ","
    + _ranked(_cosine("p.dense", "q.dense"), k="5")
)
SQL["dense_topk_many"] = (
    _with(
        POINTS,
        "q AS (SELECT id * 10 + j AS query_id, list_concat(dense[j + 1:], dense[1:j]) AS dense FROM p, range(10) a(j))",
    ).rstrip()
    + ","
    + _ranked(_cosine("p.dense", "q.dense"), k="5")
)
SQL["distances"] = _with(POINTS, CENTRES.strip()) + f"""
SELECT p.id, round({_cosine("p.dense", "q.dense")}, 6) + 0 AS cosine,
       round({_euclid("p.dense", "q.dense")}, 6) + 0 AS euclid,
       round({_dot("p.dense", "q.dense")}, 6) + 0 AS dot
FROM p JOIN q ON p.label = q.query_id::VARCHAR"""


# -- encoders ---------------------------------------------------------------------


def _words(name: str, source: str) -> str:
    """``name``: (id, code) of every word of ``source``, which has id and text."""
    return f"""
    {name}_w AS (SELECT id, unnest(string_split({_clean("text")}, ' ')) AS word FROM {source}),
    {name}_c AS (SELECT word, ('0x' || substr(md5(word), 1, 9))::BIGINT AS code
                 FROM (SELECT DISTINCT word FROM {name}_w WHERE word <> '')),
    {name} AS (SELECT id, code FROM {name}_w JOIN {name}_c USING (word))""".strip()


def _hashed(name: str, words: str, source: str, dim: int = 64, normalise: bool = True) -> str:
    """``name``: (id, i, x) cells of the hashed vectors."""
    value = "(x / CASE WHEN n > 0 THEN n ELSE 1 END)" if normalise else "x"
    return f"""
    {name}_b AS (SELECT id, (code >> 4) % {dim} AS i, sum(CASE WHEN code & 15 < 8 THEN 1 ELSE -1 END)::DOUBLE AS x
                 FROM {words} GROUP BY ALL),
    {name}_n AS (SELECT id, sqrt(sum(x * x)) AS n FROM {name}_b GROUP BY id),
    {name}_g AS (SELECT id, unnest(range({dim})) AS i FROM {source}),
    {name} AS (SELECT g.id, g.i, coalesce({value}, 0)::FLOAT AS x
               FROM {name}_g g LEFT JOIN {name}_b b ON b.id = g.id AND b.i = g.i
               LEFT JOIN {name}_n n ON n.id = g.id)""".strip()


def _vectors(name: str, cells: str) -> str:
    return f"{name} AS (SELECT id, list(x ORDER BY i) AS dense FROM {cells} GROUP BY id)"


def _bm25(name: str, words: str, source: str) -> str:
    """``name``: (id, word, weight) of the documents."""
    return f"""
    {name}_l AS (SELECT id, count(code) AS l FROM {source} LEFT JOIN {words} USING (id) GROUP BY id),
    {name}_a AS (SELECT avg(l) AS a FROM {name}_l),
    {name}_t AS (SELECT id, (code >> 4) & 2147483647 AS word, count(*) AS tf FROM {words} GROUP BY ALL),
    {name} AS (SELECT id, word, (tf * 2.2::DOUBLE /
                      (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * (l / a))))::FLOAT AS weight
               FROM {name}_t JOIN {name}_l USING (id), {name}_a)""".strip()


def _idf(name: str, words: str, documents: str, source: str) -> str:
    """``name``: (id, word, weight) of the queries."""
    return f"""
    {name}_f AS (SELECT word, count(*) AS df FROM {documents} GROUP BY word),
    {name}_q AS (SELECT DISTINCT id, (code >> 4) & 2147483647 AS word FROM {words}),
    {name} AS (SELECT id, word,
                      ln(1 + ((SELECT count(*) FROM {source}) - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))::FLOAT AS weight
               FROM {name}_q JOIN {name}_f USING (word))""".strip()


DOCS = "d AS (SELECT doc_id AS id, text, lang AS label FROM documents)"
ASKED = "a AS (SELECT item_id AS id, text FROM benchmark)"
DOC_DENSE = [_words("dw", "d"), _hashed("dh", "dw", "d"), _vectors("dv", "dh")]
DOC_POINTS = "p AS (SELECT d.id, d.text, d.label, dv.dense FROM d JOIN dv USING (id))"
ASK_DENSE = [_words("aw", "a"), _hashed("ah", "aw", "a"), _vectors("av", "ah")]

SQL["dense_encode_hash"] = _with(DOCS, *DOC_DENSE[:2]) + (
    "SELECT id, i::INT AS i, round(x::DOUBLE, 6) + 0 AS x FROM dh"
)
SQL["dense_encode_raw"] = (
    _with(
        "d AS (SELECT conv_id * 1000 + turn AS id, text FROM conversations)",
        _words("dw", "d"),
        _hashed("dh", "dw", "d", 32, False),
    )
    + "SELECT id, i::INT AS i, round(x::DOUBLE, 6) + 0 AS x FROM dh"
)
SQL["sparse_encode"] = _with(DOCS, _words("dw", "d"), _bm25("ds", "dw", "d")) + (
    "SELECT id, word::INT AS word, round(weight::DOUBLE, 6) AS weight FROM ds"
)
SQL["l2_normalise"] = (
    _with(
        "v AS (SELECT vec_id AS id, unnest(embedding)::DOUBLE * (vec_id % 5) AS x,"
        " generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)",
        "n AS (SELECT id, sqrt(sum(x * x)) AS n FROM v GROUP BY id)",
    )
    + "SELECT id, i::INT AS i, round(CASE WHEN n > 0 THEN x / n ELSE 0 END, 6) + 0 AS x FROM v JOIN n USING (id)"
)
SQL["text_clean"] = f"SELECT doc_id AS id, {_clean('text')} AS clean FROM documents"
_STOPPED = ", ".join(f"'{w}'" for w in ("", *STOP_WORDS))
SQL["text_clean_stopwords"] = f"""
WITH w AS (SELECT doc_id AS id, list_filter(string_split({_clean("text")}, ' '), lambda w: w NOT IN ({_STOPPED})) AS words
           FROM documents)
SELECT id, len(words)::INT AS words_left, array_to_string(words, ' ') AS clean FROM w"""


# -- text search ------------------------------------------------------------------

SQL["text_search_dense"] = (
    _with(DOCS, *DOC_DENSE, DOC_POINTS, ASKED, *ASK_DENSE, "q AS (SELECT id AS query_id, dense FROM av)").rstrip()
    + ","
    + _ranked(_cosine("p.dense", "q.dense"), text=True)
)

OPTIONS = f"""
    o AS (SELECT item_id AS query_id, CASE WHEN item_id % 7 = 3 THEN '   ' ELSE '  ' || text END AS raw,
                 CASE item_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' END AS label,
                 (item_id % 12) / 10.0::DOUBLE AS threshold, (item_id % 6)::INT AS k FROM benchmark),
    c AS (SELECT query_id, {_strip("raw")} AS text, label, threshold, k,
                 CASE WHEN {_strip("raw")} = '' THEN 'query text is blank'
                      WHEN threshold NOT BETWEEN 0 AND 1 THEN 'threshold is not between 0 and 1'
                      WHEN k NOT BETWEEN 1 AND 1000 THEN 'limit is not between 1 and 1000' END AS reason FROM o)""".strip()
SQL["query_validation"] = _with(OPTIONS) + "SELECT query_id, text, label, threshold, k, reason FROM c"
SQL["search_with_options"] = (
    _with(
        DOCS,
        *DOC_DENSE,
        DOC_POINTS,
        OPTIONS,
        "a AS (SELECT query_id AS id, text FROM c WHERE reason IS NULL)",
        *ASK_DENSE,
        "q AS (SELECT query_id, dense, c.label, threshold, k FROM c JOIN av ON av.id = query_id)",
    ).rstrip()
    + ","
    + _ranked(
        _cosine("p.dense", "q.dense"),
        k="q.k",
        where="(q.label IS NULL OR p.label = q.label)",
        threshold="score >= (SELECT threshold FROM q WHERE q.query_id = s.query_id)",
        text=True,
    )
)

SPARSE = [_bm25("ds", "dw", "d"), _idf("ai", "aw", "ds", "d")]
MATCHED = """
    m AS (SELECT ai.id AS query_id, ds.id, round(sum(ai.weight::DOUBLE * ds.weight::DOUBLE), 6) AS score
          FROM ai JOIN ds USING (word) GROUP BY ALL)""".strip()
SQL["sparse_topk_bm25"] = (
    _with(DOCS, ASKED, _words("dw", "d"), _words("aw", "a"), *SPARSE, MATCHED)
    + """
SELECT query_id, place::INT AS rank, id, score, label, text
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM m) JOIN d USING (id)
WHERE place <= 10"""
)


def _hybrid(allowed: str) -> str:
    parts = _with(
        DOCS, ASKED, *DOC_DENSE, DOC_POINTS, *ASK_DENSE, *SPARSE, MATCHED,
        "q AS (SELECT id AS query_id, dense, ['en', 'fr', 'de', 'es'][id % 4 + 1] AS label FROM av)",
    )
    return parts.rstrip() + f""",
    one AS (SELECT q.query_id, p.id, round({_cosine("p.dense", "q.dense")}, 6) + 0 AS score FROM q, p WHERE {allowed}),
    two AS (SELECT m.query_id, m.id, m.score FROM m JOIN q USING (query_id) JOIN p ON p.id = m.id WHERE {allowed}),
    each AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC NULLS LAST, id) - 1 AS place
             FROM (SELECT 1 AS source, * FROM one UNION ALL SELECT 2, * FROM two)),
    fused AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (2 + place)), 6) AS score
              FROM each WHERE place < 20 GROUP BY ALL),
    best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM fused)
    SELECT query_id, place::INT AS rank, id, score, label, text FROM best JOIN d USING (id) WHERE place <= 10"""


SQL["hybrid_rrf"] = _hybrid("true")
SQL["hybrid_rrf_filtered"] = _hybrid("p.label = q.label")


# -- recommendation ---------------------------------------------------------------


def _recommended(examples: str, where: str = "true", threshold: str = "true") -> str:
    """``examples``: body of e, (query_id, id, positive)."""
    return (
        _with(
            POINTS,
            f"e AS ({examples})",
            """
    x AS (SELECT query_id, positive, generate_subscripts(dense, 1) AS i,
                 unnest(dense)::DOUBLE / sqrt(list_dot_product(dense::DOUBLE[], dense::DOUBLE[])) AS x
          FROM e JOIN p USING (id)),
    m AS (SELECT query_id, i, avg(x) FILTER (positive) AS pos, avg(x) FILTER (NOT positive) AS neg
          FROM x GROUP BY query_id, i),
    q AS (SELECT query_id, list(CASE WHEN neg IS NULL THEN pos ELSE pos + (pos - neg) END ORDER BY i) AS dense
          FROM m WHERE pos IS NOT NULL GROUP BY query_id)""".strip(),
        ).rstrip()
        + ","
        + _ranked(
            _cosine("p.dense", "q.dense"),
            where=f"({where}) AND (q.query_id, p.id) NOT IN (SELECT query_id, id FROM e)",
            threshold=threshold,
        )
    )


_POSITIVE = ", ".join(map(str, POSITIVE_IDS))
_NEGATIVE = ", ".join(map(str, NEGATIVE_IDS))
_BOTH = f"SELECT 0::BIGINT AS query_id, id, id IN ({_POSITIVE}) AS positive FROM p WHERE id IN ({_POSITIVE}, {_NEGATIVE})"
SQL["recommend_ids"] = _recommended(_BOTH)
SQL["recommend_ids_positive_only"] = _recommended(
    f"SELECT 0::BIGINT AS query_id, id, true AS positive FROM p WHERE id IN ({_POSITIVE})"
)
SQL["recommend_filtered"] = _recommended(_BOTH, where="p.label = '3'", threshold="score >= 0.01")
SQL["recommend_by_quality"] = _recommended(
    "SELECT label::BIGINT AS query_id, vec_id AS id, quality = 1 AND toxic = 0 AS positive"
    " FROM embeddings JOIN labels l(doc_id, quality, toxic) ON doc_id = vec_id"
)
SQL["recommend_by_label"] = _recommended(
    """WITH h AS (SELECT id, label::BIGINT AS label FROM
                  (SELECT *, row_number() OVER (PARTITION BY label ORDER BY id) AS place FROM p) WHERE place <= 5),
            l AS (SELECT DISTINCT label::BIGINT AS label FROM p)
       SELECT l.label AS query_id, h.id, true AS positive FROM l JOIN h ON h.label = l.label
       UNION ALL SELECT l.label, h.id, false FROM l JOIN h ON h.label = (l.label + 1) % 10"""
)


SQL["label_request_reasons"] = """
SELECT vec_id AS query_id, CASE WHEN vec_id % 7 = 0 THEN 'no points found with positive label: x' || label
                                WHEN vec_id % 3 = 0 THEN 'no points found with negative label: none' END AS reason
FROM embeddings"""

# Signs of 6 fixed hyperplanes; of all 64 ways to turn them, the 46 that cost least.
SQL["approx_topk"] = _with(
    POINTS,
    """
    h AS (SELECT h, list(CASE WHEN ('0x' || substr(md5(h || '_' || i), 1, 1))::INT < 8 THEN 1.0::DOUBLE
                              ELSE -1.0::DOUBLE END ORDER BY i) AS w
          FROM range(6) a(h), range(64) b(i) GROUP BY h),
    g AS (SELECT id, h, list_dot_product(dense::DOUBLE[], w) AS shadow FROM p, h),
    c AS (SELECT id, sum(CASE WHEN shadow >= 0 THEN 1 << h ELSE 0 END) AS code FROM g GROUP BY id),
    t AS (SELECT id, t, sum(CASE WHEN (t >> h) & 1 = 1 THEN shadow * shadow ELSE 0 END) AS cost
          FROM g, range(64) a(t) WHERE id % 20 = 0 GROUP BY id, t),
    b AS (SELECT id, t FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cost, t) AS nth FROM t) WHERE nth <= 46),
    k AS (SELECT b.id AS query_id, o.id FROM b JOIN c USING (id) JOIN c o ON o.code = xor(c.code::BIGINT, b.t::BIGINT)),
    q AS (SELECT id AS query_id, dense FROM p WHERE id % 20 = 0)""".strip(),
    _ranked(_cosine("q.dense", "p.dense"), where="(q.query_id, p.id) IN (SELECT query_id, id FROM k)").strip(),
)


# -- similar pairs ----------------------------------------------------------------


def _pairs(condition: str = "true") -> str:
    return f"""
    s AS (SELECT a.id AS id_a, b.id AS id_b, round({_cosine("a.dense", "b.dense")}, 6) + 0 AS score
          FROM p a JOIN p b ON a.id < b.id WHERE {condition}),
    r AS (SELECT row_number() OVER (ORDER BY score DESC, id_a, id_b) AS place, * FROM s WHERE score IS NOT NULL)
    SELECT place::INT AS rank, id_a, id_b, score FROM r WHERE place <= 50"""


SQL["similar_pairs"] = _with(POINTS).rstrip() + "," + _pairs()
SQL["similar_document_pairs"] = _with(DOCS, *DOC_DENSE, DOC_POINTS).rstrip() + "," + _pairs()
SQL["approx_similar_pairs"] = (
    _with(
        POINTS,
        """
    h AS (SELECT h, list(CASE WHEN ('0x' || substr(md5(h || '_' || i), 1, 1))::INT < 8 THEN 1.0::DOUBLE
                              ELSE -1.0::DOUBLE END ORDER BY i) AS w
          FROM range(7 * 64) a(h), range(64) b(i) GROUP BY h),
    c AS (SELECT id, h // 7 AS band, sum(CASE WHEN list_dot_product(dense::DOUBLE[], w) >= 0
                                              THEN 1 << (h % 7) ELSE 0 END) AS code
          FROM p, h GROUP BY ALL),
    k AS (SELECT DISTINCT a.id AS one, b.id AS two FROM c a JOIN c b USING (band, code) WHERE a.id < b.id)""".strip(),
    ).rstrip()
    + ","
    + _pairs("(a.id, b.id) IN (SELECT one, two FROM k)")
)


# -- sources ----------------------------------------------------------------------

SQL["scenario_projection"] = (
    "SELECT doc_id, text, lang AS label, source, n_chars::VARCHAR AS n_chars FROM documents"
)
SQL["payload_assembly"] = """
WITH d AS (SELECT doc_id AS id, text, quality, lang, toxic FROM documents LEFT JOIN labels USING (doc_id))
SELECT id, 'text' AS key, text AS value FROM d
UNION ALL SELECT id, 'label', quality::VARCHAR FROM d WHERE quality IS NOT NULL
UNION ALL SELECT id, 'lang', lang FROM d
UNION ALL SELECT id, 'toxic', toxic::VARCHAR FROM d WHERE toxic IS NOT NULL"""
_NAMES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in NUMERIC_LABELS.items())
RECORDS = f"""
    r AS (SELECT doc_id, text, source, quality FROM documents LEFT JOIN labels USING (doc_id)
          UNION ALL SELECT doc_id + 1000000, ' ', source, quality FROM documents LEFT JOIN labels USING (doc_id)),
    d AS (SELECT doc_id, {_strip("text")} AS text,
                 CASE WHEN doc_id % 4 = 0 THEN '  ' || upper(source) ELSE quality::VARCHAR END AS raw FROM r),
    v AS (SELECT doc_id, text, {_strip("lower(raw)")} AS l, text <> '' AS valid FROM d)""".strip()
SQL["validated_records"] = _with(RECORDS) + (
    f"SELECT doc_id, text, CASE l {_NAMES} ELSE l END AS label FROM v WHERE valid"
)
SQL["record_validity_counts"] = _with(RECORDS) + (
    "SELECT count(*) FILTER (valid) AS valid, count(*) FILTER (NOT valid) AS invalid FROM v"
)
SQL["row_ids"] = "SELECT row_number() OVER (ORDER BY doc_id) + 99 AS id, doc_id FROM documents"
SQL["point_validation"] = """
WITH v AS (SELECT vec_id - 10 AS id,
                  len(list_filter(embedding, lambda x: x::DOUBLE > label * 0.04::DOUBLE))::INT AS size FROM embeddings)
SELECT id, size, CASE WHEN id < 0 THEN 'id is missing or negative'
                      WHEN size = 0 THEN 'vector is missing or empty'
                      WHEN size <> 20 THEN 'vector has another size' END AS reason FROM v"""
SQL["search_gaps"] = """
SELECT CASE WHEN vec_id % 50 = 0 THEN 'id is missing' WHEN vec_id % 11 = 0 THEN 'vector has another size'
            ELSE 'vector is missing' END AS reason, count(*) AS points
FROM embeddings WHERE vec_id % 50 = 0 OR vec_id % 11 = 0 OR vec_id % 7 = 0 GROUP BY reason"""
SQL["row_counts"] = "SELECT count(*) AS rows FROM documents"


# -- points by id, filter and page ------------------------------------------------

_DOC = "SELECT doc_id AS id, text, lang AS label, source, n_chars FROM documents"
SQL["points_by_ids"] = f"{_DOC} WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)"
SQL["point_by_id"] = f"{_DOC} WHERE doc_id = 42"
SQL["points_with_vectors"] = """
SELECT vec_id AS id, (generate_subscripts(embedding, 1) - 1)::INT AS i, round(unnest(embedding)::DOUBLE, 6) + 0 AS x
FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels)"""
SQL["general_filter"] = _with(PAYLOADS.strip()) + """
SELECT id, label FROM d
WHERE lang IN ('en', 'de', 'es') AND n_chars >= 500 AND n_chars < 5000
  AND source <> 'src1' AND (label IS NULL OR label <> '0')"""
SQL["scroll_page"] = f"{_DOC} WHERE doc_id >= 50 ORDER BY doc_id LIMIT 100"
SQL["scroll_filtered"] = f"{_DOC} WHERE doc_id >= 20 AND lang = 'en' ORDER BY doc_id LIMIT 100"
SQL["scroll_pages"] = (
    "SELECT doc_id AS id, (row_number() OVER (ORDER BY doc_id) - 1) // 100 AS page FROM documents"
)
SQL["scroll_pages_filtered"] = SQL["scroll_pages"] + " WHERE lang = 'en'"


# -- statistics and reports -------------------------------------------------------

SQL["label_distribution"] = """
SELECT quality::VARCHAR AS label, count(*) AS points,
       round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS percent
FROM documents JOIN labels USING (doc_id) GROUP BY quality"""
SQL["collection_stats"] = f"""
SELECT count(*) AS points, count(embedding) AS vectors, count(label) AS labelled,
       min(len(embedding))::INT AS min_size, max(len(embedding))::INT AS max_size,
       round(avg(sqrt({_dot("embedding", "embedding")})), 6) AS mean_norm FROM embeddings"""
SQL["result_stats"] = f"""
SELECT query_id, count(*) AS hits, round(avg(score), 9) AS average_score, max(score) AS top_score
FROM ({SQL["dense_topk_cosine"]}) GROUP BY query_id"""
SQL["result_labels"] = f"""
SELECT query_id, label, count(*) AS hits,
       round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY query_id), 6) AS percent
FROM ({SQL["dense_topk_cosine"]}) GROUP BY query_id, label"""
SQL["result_report"] = f"""
SELECT query_id, rank, score::DECIMAL(18, 6)::DECIMAL(18, 4)::VARCHAR AS score_text, label,
       CASE WHEN length(text) > 200 THEN left(text, 197) || '...' ELSE text END AS text_shown,
       CASE WHEN length(text) > 0 THEN left(text, 50) || '...' END AS preview
FROM ({SQL["text_search_dense"]})"""


# -- changes ----------------------------------------------------------------------

SQL["upsert_points"] = """
WITH w AS (
    SELECT vec_id AS id, 'kept' AS label, embedding AS v FROM embeddings WHERE false
    UNION ALL SELECT vec_id, label::VARCHAR, embedding FROM embeddings WHERE label % 2 = 1
    UNION ALL SELECT vec_id, 'first', list_reverse(embedding) FROM embeddings WHERE label % 2 = 0 AND vec_id % 3 <> 0
    UNION ALL SELECT vec_id, 'second', embedding FROM embeddings WHERE label % 2 = 0 AND vec_id % 3 = 0
    UNION ALL SELECT vec_id + 1000000, 'new', embedding FROM embeddings WHERE label % 2 = 0)
SELECT id, label, (generate_subscripts(v, 1) - 1)::INT AS i, round(unnest(v)::DOUBLE, 6) + 0 AS x FROM w"""
SQL["collection_changes"] = """
WITH w AS (SELECT vec_id AS id, CASE WHEN label % 2 = 1 THEN 'turned' ELSE label::VARCHAR END AS label,
                  CASE WHEN vec_id % 5 = 0 THEN 'yes' END AS checked,
                  CASE WHEN label % 2 = 1 THEN list_reverse(embedding) ELSE embedding END AS v
           FROM embeddings WHERE vec_id % 11 <> 0)
SELECT id, label, checked, (generate_subscripts(v, 1) - 1)::INT AS i, round(unnest(v)::DOUBLE, 6) + 0 AS x FROM w"""
SQL["delete_ids"] = (
    "SELECT doc_id AS id, lang AS label FROM documents"
    " WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"
)
SQL["delete_filter"] = _with(PAYLOADS.strip()) + "SELECT id, label FROM d WHERE label IS NULL OR label <> '0'"
SQL["payload_merge"] = _with(PAYLOADS.strip()) + """
SELECT f.id, key, CASE WHEN key = 'lang' AND value = 'fr' THEN 'français' ELSE value END AS value FROM f
UNION ALL SELECT id, 'checked', 'yes' FROM d WHERE lang = 'fr'"""
SQL["payload_set_field"] = _with(PAYLOADS.strip()) + """
SELECT id, key, value FROM f UNION ALL SELECT id, 'checked', 'yes' FROM d WHERE id = 7"""
SQL["payload_lookup"] = "SELECT doc_id AS id, lang, 'unknown' AS tone FROM documents"
SQL["payload_merge_batch"] = _with(PAYLOADS.strip()) + """
SELECT f.id, key, CASE WHEN key = 'source' AND toxic IS NOT NULL THEN 'rated ' || toxic ELSE value END AS value
FROM f LEFT JOIN labels l ON l.doc_id = f.id
UNION ALL SELECT doc_id, 'quality', CASE quality WHEN 1 THEN 'good' ELSE quality::VARCHAR END
FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)"""
SQL["payload_drop_fields"] = _with(PAYLOADS.strip()) + """
SELECT f.id, key, value FROM f JOIN d USING (id) WHERE d.lang <> 'de' OR key = 'lang'"""


# -- collections and streams ------------------------------------------------------

SQL["ingest_collection"] = (
    _with(DOCS, _words("dw", "d"), _hashed("dh", "dw", "d"), _bm25("ds", "dw", "d"))
    + """
SELECT doc_id AS id, 'text' AS part, NULL::VARCHAR AS key, NULL::DOUBLE AS number, text AS value FROM documents
UNION ALL SELECT doc_id, 'label', NULL, NULL, lang FROM documents
UNION ALL SELECT id, 'dense', i::INT::VARCHAR, round(x::DOUBLE, 6) + 0, NULL FROM dh
UNION ALL SELECT id, 'sparse', word::INT::VARCHAR, round(weight::DOUBLE, 6) + 0, NULL FROM ds
UNION ALL SELECT doc_id, 'payload', key, NULL, value
FROM (SELECT doc_id, unnest(['text', 'label', 'source', 'n_chars']) AS key,
             unnest([text, lang, source, n_chars::VARCHAR]) AS value FROM documents) WHERE value IS NOT NULL"""
)
SQL["ingest_counters"] = SQL["record_validity_counts"]
SQL["collection_search_euclid"] = SQL["dense_topk_euclid"]
SQL["collection_search_dot"] = SQL["dense_topk_dot"]
SQL["named_vector_search"] = SQL["dense_topk_cosine"]
SQL["user_model_encode"] = """
WITH n AS (SELECT doc_id AS id, coalesce(text, '') AS text FROM documents)
SELECT id, unnest([0, 1, 2])::INT AS i,
       unnest([length(text), length(text) - length(replace(text, 'e', '')),
               length(text) - length(replace(text, ' ', ''))])::DOUBLE AS x FROM n"""
SQL["user_sparse_encode"] = """
SELECT id, index::INT AS index, weight::DOUBLE AS weight FROM (
    SELECT doc_id AS id, unnest([0, 4, 8, 14, 20]) AS index,
           unnest([length(text) - length(replace(text, 'a', '')), length(text) - length(replace(text, 'e', '')),
                   length(text) - length(replace(text, 'i', '')), length(text) - length(replace(text, 'o', '')),
                   length(text) - length(replace(text, 'u', ''))]) AS weight FROM documents)
WHERE weight > 0"""
SQL["geo_filter"] = """
WITH g AS (SELECT vec_id AS id, label::VARCHAR AS label,
                  vec_id * 37 % 360 - 180 AS lon, vec_id * 17 % 180 - 90 AS lat FROM embeddings)
SELECT id, label FROM g
WHERE 2 * 6371008.8 * asin(sqrt(least(1, pow(sin(radians(lat - 50) / 2), 2)
          + cos(radians(50)) * cos(radians(lat)) * pow(sin(radians(lon - 10) / 2), 2)))) <= 3000000
   OR (lat BETWEEN -30 AND 30 AND (lon >= 160 OR lon <= -160))"""
SQL["shard_search"] = _centre_search(score=_cosine("p.dense", "q.dense"), where="p.label = '3'")
SQL["described_collection"] = f"""
SELECT 2 * count(*) AS points, 2 * count(embedding) AS vectors, count(label) AS labelled,
       min(len(embedding))::INT AS min_size, max(len(embedding))::INT AS max_size,
       round(avg(sqrt({_dot("embedding", "embedding")})), 6) AS mean_norm,
       64::INT AS declared_size, 'Dot' AS distance FROM embeddings"""
SQL["typed_field_filter"] = (
    "SELECT doc_id AS id, lang, n_chars FROM documents WHERE lang = 'en' AND n_chars >= 2000"
)
SQL["incremental_ingest"] = """
WITH w AS (
    SELECT vec_id AS id, label::VARCHAR AS label, embedding AS v FROM embeddings WHERE label % 2 = 1
    UNION ALL SELECT vec_id, 'first', list_reverse(embedding) FROM embeddings WHERE label % 2 = 0 AND vec_id % 3 <> 0
    UNION ALL SELECT vec_id, 'second', embedding FROM embeddings WHERE label % 2 = 0 AND vec_id % 3 = 0)
SELECT id, label, (generate_subscripts(v, 1) - 1)::INT AS i, round(unnest(v)::DOUBLE, 6) + 0 AS x FROM w"""
SQL["incremental_ingest_numbered"] = (
    "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS id, doc_id, lang, n_chars FROM documents"
)
SQL["stream_collection"] = """
WITH w AS (
    SELECT vec_id AS id, label::VARCHAR AS label, embedding AS v FROM embeddings
    WHERE label % 2 = 1 OR (vec_id % 4 = 0 AND vec_id % 3 <> 0)
    UNION ALL SELECT vec_id, 'first', list_reverse(embedding) FROM embeddings WHERE label % 2 = 0 AND vec_id % 4 <> 0 AND vec_id % 3 <> 0
    UNION ALL SELECT vec_id, 'second', embedding FROM embeddings WHERE label % 2 = 0 AND vec_id % 3 = 0),
n AS (SELECT count(*) + count(*) FILTER (WHERE label % 2 = 0 AND vec_id % 4 <> 0)
             + count(*) FILTER (WHERE label % 2 = 0 AND vec_id % 3 = 0) AS total FROM embeddings)
SELECT id, label, (generate_subscripts(v, 1) - 1)::INT AS i, round(unnest(v)::DOUBLE, 6) + 0 AS x, NULL::VARCHAR AS reason, total FROM w, n
UNION ALL SELECT vec_id, NULL, 20, NULL, 'vector has another size', total FROM embeddings, n WHERE label % 2 = 0 AND vec_id % 4 = 0"""
