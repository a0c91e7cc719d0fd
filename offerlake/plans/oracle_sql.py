"""DuckDB statements that state, independently of Spark, what each query key must return.

They are written from the rules, with constants of their own, so that a wrong constant in the library shows; they
run on the driver's pre-registered views of the test tables. Only the stop-word list is shared.
"""

from __future__ import annotations

from offerlake.functions.stopwords import FRENCH_STOPWORDS

# Fixed values, stated a second time.
TOP_K, RRF_K, TITLE_WEIGHT = 100, 60, 3.0
ZETA2, DEFAULT_WEIGHT_D = 1.64493406685, 0.1
FTS_WEIGHTS = {"A": 1.0, "B": 0.6, "C": 0.3}
WORD = r"\p{L}\p{N}_"
WS = r"\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
HTML_TAG_OR_ENTITY = r"<[^\n]*?>|&([a-zA-Z0-9]+|#[0-9]{1,6}|#x[0-9a-fA-F]{1,6});"
ENCODED_DIM = 64

AS_OF = "2024-01-30"
BASE_URL = "https://offers.example.org/detail/"
SCORE_MAX = (2.0 + TITLE_WEIGHT) / (RRF_K + 1)
_STOP = "[" + ", ".join("'" + w + "'" for w in FRENCH_STOPWORDS) + "]"


def trim_ws(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def split_ws(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '[{WS}]+'), lambda w: w <> '')"


def html_clean(x: str) -> str:
    t = f"regexp_replace({x}, '{HTML_TAG_OR_ENTITY}', '', 'g')"
    t = f"translate({t}, chr(10) || chr(13) || chr(9), '   ')"
    t = f"regexp_replace({t}, ' +', ' ', 'g')"
    return f"coalesce({trim_ws(t)}, '')"


def tokens(x: str) -> str:
    return f"coalesce(regexp_extract_all(lower({x}), '[{WORD}]+'), [])"


def first_line(x: str) -> str:
    return f"split_part({x}, chr(10), 1)"


def ordered_distinct(lst: str) -> str:
    return f"list_filter({lst}, lambda x, i: list_position({lst}, x) = i)"


def fts_terms_ctes(src: str, id_expr: str, text_expr: str, name: str) -> str:
    """CTEs ending in ``{name}(cv_id, terms)``: the cleaned CV words."""
    return f"""
{name}_0 AS (SELECT {id_expr} AS cv_id, {trim_ws(f"coalesce({text_expr}, '')")} AS t FROM {src}),
{name}_1 AS (SELECT cv_id, CASE WHEN length(regexp_replace(t, '[{WS}]', '', 'g')) / greatest(len({split_ws('t')}), 1) < 1.5
    THEN replace(replace(regexp_replace(lower(t), '  +', chr(10), 'g'), ' ', ''), chr(10), ' ')
    ELSE lower(regexp_replace(t, '[{WS}]+', ' ', 'g')) END AS t FROM {name}_0),
{name}_2 AS (SELECT cv_id, regexp_replace(t, '[^{WORD}{WS}+#\\-]', ' ', 'g') AS t FROM {name}_1),
{name} AS (SELECT cv_id, list_filter({split_ws('t')}, lambda w: length(w) > 1 AND NOT list_contains({_STOP}, w)) AS terms FROM {name}_2)"""


def h2(n: str) -> str:
    return f"coalesce(list_sum(list_transform(range(1, ({n}) + 1), lambda j: 1.0::DOUBLE / (j::DOUBLE * j::DOUBLE))), 0.0::DOUBLE)"


def lexeme_weight(a: str, b: str, c: str) -> str:
    wa, wb, wc = (repr(float(FTS_WEIGHTS[k])) for k in "ABC")
    ha, hab, habc = h2(a), h2(f"{a} + {b}"), h2(f"{a} + {b} + {c}")
    return f"(({wa}::DOUBLE * {ha} + {wb}::DOUBLE * ({hab} - {ha}) + {wc}::DOUBLE * ({habc} - {hab})) / {ZETA2!r}::DOUBLE)"


def title_weight(a: str) -> str:
    return f"({float(DEFAULT_WEIGHT_D)!r}::DOUBLE * {h2(a)} / {ZETA2!r}::DOUBLE)"


DOCS = f"""docs AS (SELECT doc_id AS job_id, {first_line('text')} AS title, text AS description, source AS skills,
    source, lang, text FROM documents)"""

INDEX = f"""
idx_w AS (SELECT job_id, unnest({tokens('title')}) AS lexeme, 'A' AS label FROM docs
    UNION ALL SELECT job_id, unnest({tokens('description')}), 'B' FROM docs
    UNION ALL SELECT job_id, unnest({tokens('skills')}), 'C' FROM docs),
idx_c AS (SELECT job_id, lexeme,
    CAST(count(*) FILTER (WHERE label = 'A') AS INTEGER) AS n_a,
    CAST(count(*) FILTER (WHERE label = 'B') AS INTEGER) AS n_b,
    CAST(count(*) FILTER (WHERE label = 'C') AS INTEGER) AS n_c FROM idx_w GROUP BY job_id, lexeme),
idx AS (SELECT c.job_id, c.lexeme, c.n_a, c.n_b, c.n_c, CAST(len({tokens('d.title')}) AS INTEGER) AS title_len,
    {lexeme_weight('c.n_a', 'c.n_b', 'c.n_c')} AS w_f, {title_weight('c.n_a')} AS w_t
    FROM idx_c c JOIN docs d ON d.job_id = c.job_id)"""

CVS = """cvq AS (SELECT b.item_id AS cv_id, b.text AS cv_text, e.embedding AS q
    FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id)"""


def text_score_ctes(cv_src: str, cv_id: str, cv_text: str) -> str:
    return f"""{fts_terms_ctes(cv_src, cv_id, cv_text, 'qterms')},
qn AS (SELECT cv_id, list_distinct(flatten(list_transform(terms, lambda t: {tokens('t')}))) AS terms FROM qterms),
qn2 AS (SELECT cv_id, terms, len(terms) AS n_terms FROM qn),
qt AS (SELECT cv_id, n_terms, unnest(terms) AS lexeme FROM qn2),
hits AS (SELECT qt.cv_id, idx.job_id, qt.n_terms, idx.title_len, idx.w_f, idx.w_t
    FROM qt JOIN idx ON idx.lexeme = qt.lexeme),
ts AS (SELECT cv_id, job_id, sum(w_f) / any_value(n_terms) AS fts_score,
    CASE WHEN any_value(title_len) > 0 THEN sum(w_t) / any_value(n_terms) / any_value(title_len) ELSE 0.0 END AS title_score
    FROM hits GROUP BY cv_id, job_id)"""


def encoded_ctes(name: str, src: str, key: str, text: str, dim: int = ENCODED_DIM) -> str:
    """CTEs ending in ``{name}(id, embedding)``: signed hashing of the words by digits of their md5, then unit length."""
    return f"""
{name}_w AS (SELECT {key} AS id, unnest({tokens(text)}) AS w FROM {src}),
{name}_h AS (SELECT id, CAST(CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % {dim} AS INTEGER) AS b,
    CAST(sum(CASE WHEN substr(md5(w), 9, 1) >= '8' THEN -1 ELSE 1 END) AS DOUBLE) AS v FROM {name}_w GROUP BY 1, 2),
{name}_n AS (SELECT id, sqrt(sum(v * v)) AS n FROM {name}_h GROUP BY id),
{name}_all AS (SELECT DISTINCT {key} AS id FROM {src}),
{name} AS (SELECT a.id, list(CAST(coalesce(h.v / nullif(n.n, 0), 0) AS FLOAT) ORDER BY r.i) AS embedding
    FROM {name}_all a CROSS JOIN (SELECT CAST(range AS INTEGER) AS i FROM range({dim})) r
    LEFT JOIN {name}_h h ON h.id = a.id AND h.b = r.i LEFT JOIN {name}_n n ON n.id = a.id GROUP BY a.id)"""


CORPUS = """corpus AS (SELECT d.job_id, e.embedding FROM docs d JOIN embeddings e ON e.vec_id = d.job_id
    WHERE e.embedding IS NOT NULL)"""


def rrf_ctes(cvs: str, corpus: str) -> str:
    return f"""WITH {DOCS}, {INDEX}, {cvs}, {text_score_ctes('cvq', 'cv_id', 'cv_text')},
{corpus},
pairs AS (SELECT c.cv_id, k.job_id,
    round(1 - list_distance(k.embedding::DOUBLE[], c.q::DOUBLE[]), 9) AS embedding_score,
    round(coalesce(ts.fts_score, 0.0), 9) AS fts_score, round(coalesce(ts.title_score, 0.0), 9) AS title_score
    FROM cvq c CROSS JOIN corpus k LEFT JOIN ts ON ts.cv_id = c.cv_id AND ts.job_id = k.job_id),
ranked AS (SELECT *,
    row_number() OVER (PARTITION BY cv_id ORDER BY embedding_score DESC, job_id) AS embed_rank,
    row_number() OVER (PARTITION BY cv_id ORDER BY fts_score DESC, job_id) AS fts_rank,
    row_number() OVER (PARTITION BY cv_id ORDER BY title_score DESC, job_id) AS title_rank FROM pairs),
fused AS (SELECT *, 1.0::DOUBLE / ({float(RRF_K)!r}::DOUBLE + embed_rank) + 1.0::DOUBLE / ({float(RRF_K)!r}::DOUBLE + fts_rank)
    + {float(TITLE_WEIGHT)!r}::DOUBLE / ({float(RRF_K)!r}::DOUBLE + title_rank) AS combined_score FROM ranked),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cv_id ORDER BY combined_score DESC, job_id) AS rank
    FROM fused) WHERE rank <= {TOP_K}),
last_event AS (SELECT user_id AS job_id, event_type FROM (SELECT user_id, event_type,
    row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1),
status AS (SELECT job_id, CASE event_type WHEN 'error' THEN 'timeout' WHEN 'purchase' THEN '404'
    WHEN 'signup' THEN 'exception' ELSE '200' END AS status FROM last_event)"""


RRF_CTES = rrf_ctes(CVS, CORPUS)

STATUS_CTES = RRF_CTES  # the status CTEs ride along; DuckDB drops unused CTEs


def _batch_name(ts: str) -> str:
    return f"'jobs_raw_' || strftime({ts}, '%Y%m%d') || '_' || strftime({ts}, '%H') || '0000'"


def _stamp(name: str) -> str:
    return f"try_strptime(regexp_extract({name}, '(\\d{{8}}_\\d{{6}})', 1), '%Y%m%d_%H%M%S')"


ORACLE: dict[str, str] = {}

ORACLE["html_clean"] = f"SELECT page_id, {html_clean('html')} AS text FROM pages"

ORACLE["vector_text"] = f"""SELECT doc_id AS job_id, concat_ws(' ', coalesce({first_line('text')}, ''), {html_clean('text')},
    coalesce(nullif(source, ''), ''), coalesce(nullif(lang, ''), ''), '') AS vector_text_input FROM documents"""

ORACLE["nested_text"] = """SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: x <> ''), ' ') AS skills_text,
    array_to_string(list_filter(string_split(text, chr(10)), lambda x: x <> ''), ' ') AS skills_text_json,
    array_to_string(list_filter(string_split(text, chr(10)), lambda x: x <> ''), ' ') AS skills_strings,
    coalesce(text, '') AS skills_object, coalesce('[CDI] ' || text, '') AS skills_plain FROM documents"""

ORACLE["dedup_first"] = """SELECT doc_id, text, lang, source, n_chars FROM (
    SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1"""

ORACLE["top_groups"] = """SELECT source, count(*) AS cnt FROM documents GROUP BY source
    ORDER BY cnt DESC, source ASC NULLS LAST LIMIT 10"""

ORACLE["top_groups_events"] = """SELECT event_type, count(*) AS cnt FROM events GROUP BY event_type
    ORDER BY cnt DESC, event_type ASC NULLS LAST LIMIT 10"""

ORACLE["total_count"] = "SELECT count(*) AS total FROM documents"

ORACLE["distinct_count"] = "SELECT count(DISTINCT vec_id) AS jobs_with_embeddings FROM embeddings"

ORACLE["count_per_day"] = f"""SELECT CAST(ts AS DATE) AS ingestion_date, count(*) AS cnt FROM events
    WHERE CAST(ts AS DATE) >= DATE '{AS_OF}' - INTERVAL 14 DAY GROUP BY 1 ORDER BY 1 DESC"""

ORACLE["unprocessed"] = """SELECT doc_id, n_chars FROM documents d
    WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)"""

ORACLE["merge_insert_only"] = """WITH target AS (SELECT doc_id, text FROM documents d
        WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)),
    source AS (SELECT doc_id, text || ' [v2]' AS text FROM documents)
    SELECT doc_id, text FROM target
    UNION ALL SELECT s.doc_id, s.text FROM source s WHERE s.doc_id IS NOT NULL
        AND NOT EXISTS (SELECT 1 FROM target t WHERE t.doc_id = s.doc_id)"""

ORACLE["retention"] = f"""SELECT event_id, CAST(ts AS DATE) AS ingestion_date FROM events
    WHERE ts IS NULL OR CAST(ts AS DATE) >= DATE '{AS_OF}' - INTERVAL 14 DAY"""

ORACLE["retention_report"] = f"""SELECT
    count(*) FILTER (WHERE ts IS NULL OR CAST(ts AS DATE) >= DATE '{AS_OF}' - INTERVAL 14 DAY) AS kept,
    count(*) FILTER (WHERE CAST(ts AS DATE) < DATE '{AS_OF}' - INTERVAL 14 DAY) AS deleted,
    count(*) FILTER (WHERE ts IS NULL) AS null_dates FROM events"""

ORACLE["export_latest"] = """SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS ingestion_date, event_type,
    '{"k":' || coalesce(json_extract_string(props, '$.k'), 'null') || ',"note":null}' AS props FROM events
    WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events)"""

ORACLE["cascade_delete"] = """SELECT l_orderkey, l_linenumber FROM lineitem l
    WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderstatus <> 'F')"""

ORACLE["fk_orphans"] = """SELECT l_orderkey, l_linenumber FROM lineitem l
    WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderstatus <> 'F')"""

ORACLE["schema_align"] = """SELECT CAST(c_custkey AS VARCHAR) AS key, c_name AS name, c_nationkey AS nation,
    c_acctbal AS balance, c_mktsegment AS segment, CAST(NULL AS VARCHAR) AS comment,
    CASE WHEN c_acctbal < 0 THEN NULL ELSE CAST(c_nationkey AS INTEGER) END AS phone,
    '{"segment":"' || c_mktsegment || '","nation":' || CAST(c_nationkey AS VARCHAR) || '}' AS info,
    CAST(c_nationkey AS BIGINT) AS place_nation, CAST(NULL AS VARCHAR) AS place_city FROM customer"""

ORACLE["union_relaxed"] = """SELECT c_custkey AS key, c_name AS name, CAST(c_nationkey AS BIGINT) AS nation,
        c_acctbal AS balance, c_mktsegment AS segment,
        '{"segment":"' || c_mktsegment || '","nation":' || CAST(c_nationkey AS VARCHAR) || '}' AS info,
        CAST(NULL AS VARCHAR) AS kind FROM customer
    UNION ALL SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT), CAST(CAST(s_acctbal AS FLOAT) AS DOUBLE), NULL,
        s_name, 'supplier' FROM supplier"""

ORACLE["json_field"] = "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events"

ORACLE["json_parse"] = "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events"

ORACLE["json_serialize"] = """SELECT n.n_nationkey,
    to_json({'n_name': n.n_name, 'region': r.r_name, 'n_regionkey': n.n_regionkey})::VARCHAR AS payload,
    n.n_name AS name_back, r.r_name AS region_back
    FROM nation n LEFT JOIN region r ON r.r_regionkey = n.n_regionkey"""

ORACLE["land_records"] = """SELECT event_id, CASE WHEN event_type = 'error' THEN NULL
    ELSE CAST(json_extract(props, '$.k') AS INTEGER) END AS k, user_id, event_type IN ('error', 'signup') AS no_detail,
    CASE WHEN event_type IN ('error', 'signup', 'purchase') THEN NULL ELSE event_type END AS v FROM events"""

ORACLE["vector_sanitize"] = """SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x < -0.25 THEN NULL ELSE x END) AS embedding,
    len(list_filter(embedding, lambda x: x < -0.25)) AS n_null FROM embeddings"""

ORACLE["vector_parse"] = "SELECT vec_id, embedding FROM embeddings"

ORACLE["vector_topk"] = f"""WITH {CVS},
    s AS (SELECT c.cv_id, e.vec_id AS job_id, round(1 - list_distance(e.embedding::DOUBLE[], c.q::DOUBLE[]), 9) AS score
        FROM cvq c CROSS JOIN embeddings e WHERE e.embedding IS NOT NULL)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cv_id ORDER BY score DESC, job_id) AS rank FROM s)
    WHERE rank <= {TOP_K}"""

ORACLE["global_rank"] = """SELECT l_orderkey, l_linenumber,
    row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rnk FROM lineitem"""

ORACLE["fts_clean"] = f"""WITH {fts_terms_ctes('documents', 'doc_id', 'text', 'c')}
    SELECT cv_id AS doc_id, array_to_string(terms, ' ') AS cleaned FROM c"""

ORACLE["fts_index"] = f"""WITH {DOCS}, {INDEX} SELECT job_id, lexeme, n_a, n_b, n_c, title_len,
    round(w_f, 9) AS w_f, round(w_t, 9) AS w_t FROM idx"""

ORACLE["fts_rank"] = f"""WITH {DOCS}, {INDEX}, {text_score_ctes('benchmark', 'item_id', 'text')}
    SELECT cv_id, job_id, round(fts_score, 9) AS fts_score FROM ts"""

ORACLE["title_rank"] = f"""WITH {DOCS}, {INDEX}, {text_score_ctes('benchmark', 'item_id', 'text')}
    SELECT cv_id, job_id, round(title_score, 9) AS title_score FROM ts WHERE title_score > 0"""

ORACLE["rrf_search"] = f"""{RRF_CTES}
    SELECT cv_id, rank, job_id, embedding_score, fts_score, title_score, round(combined_score, 9) AS combined_score,
        embed_rank, fts_rank, title_rank FROM top"""

ORACLE["rrf_candidates"] = ORACLE["rrf_search"]

ORACLE["score_map"] = f"""{RRF_CTES}
    SELECT cv_id, job_id, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE,
        0.0::DOUBLE + (1.0::DOUBLE - 0.0::DOUBLE) * (combined_score - 0.0::DOUBLE) / ({SCORE_MAX!r}::DOUBLE - 0.0::DOUBLE))), 2)
        AS similarity_score FROM top"""

_SEARCH_TEXT = "concat_ws(' ', d.title, d.text, d.source)"
_MATCHED = f"list_filter({tokens(_SEARCH_TEXT)}, lambda x: list_contains(q.terms, x) AND length(x) > 2)"

ORACLE["search_results"] = f"""{RRF_CTES},
    res AS (SELECT t.*, d.title, d.source, d.lang, {_MATCHED} AS matched
        FROM top t JOIN docs d ON d.job_id = t.job_id JOIN qn2 q ON q.cv_id = t.cv_id)
    SELECT cv_id, rank, CAST(job_id AS VARCHAR) AS job_id,
        round(least(1.0::DOUBLE, greatest(0.0::DOUBLE,
            0.0::DOUBLE + (1.0::DOUBLE - 0.0::DOUBLE) * (combined_score - 0.0::DOUBLE) / ({SCORE_MAX!r}::DOUBLE - 0.0::DOUBLE))), 2)
            AS similarity_score,
        round(embedding_score, 4) AS embedding_score, round(fts_score, 4) AS fts_score,
        round(combined_score, 4) AS combined_score,
        coalesce(title, '') AS intitule, coalesce(source, '') AS entreprise, coalesce(lang, '') AS lieu,
        '' AS type_contrat, '' AS date_creation,
        list_slice({ordered_distinct('matched')}, 1, 10) AS matching_terms
    FROM res"""

_SNIPPETS = f"""snippet_text AS (SELECT t.cv_id, t.rank, t.job_id, q.terms, {split_ws(_SEARCH_TEXT)} AS words
        FROM top t JOIN docs d ON d.job_id = t.job_id JOIN qn2 q ON q.cv_id = t.cv_id),
    snippet_word AS (SELECT cv_id, job_id, terms, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM snippet_text),
    hit AS (SELECT DISTINCT cv_id, job_id, pos, lexeme FROM (
        SELECT cv_id, job_id, pos, unnest(list_filter({tokens('word')}, lambda x: list_contains(terms, x))) AS lexeme FROM snippet_word)),
    hit_before AS (SELECT *, coalesce(lag(pos) OVER (PARTITION BY cv_id, job_id, lexeme ORDER BY pos), 0) AS past FROM hit),
    covered AS (  -- a hit counts for the windows that begin behind the one before it, and hold it
        SELECT a.cv_id, a.job_id, a.pos, count(*) AS n FROM (SELECT DISTINCT cv_id, job_id, pos FROM hit) a
        JOIN hit_before b ON b.cv_id = a.cv_id AND b.job_id = a.job_id AND b.pos BETWEEN a.pos AND a.pos + 99 AND b.past < a.pos GROUP BY ALL),
    snippet_start AS (SELECT cv_id, job_id, arg_max(pos, n * 1000000000 - pos) AS pos FROM covered GROUP BY ALL),
    snippet_words AS (SELECT t.cv_id, t.rank, t.job_id, t.terms,
        CASE WHEN s.pos IS NULL THEN list_slice(words, 1, 50) ELSE list_slice(words, s.pos, s.pos + 99) END AS words
        FROM snippet_text t LEFT JOIN snippet_start s ON s.cv_id = t.cv_id AND s.job_id = t.job_id),
    snippet AS (SELECT cv_id, rank, job_id, array_to_string(list_transform(words, lambda x: array_to_string(list_transform(
        regexp_extract_all(x, '[{WORD}]+|[^{WORD}]+'), lambda p: CASE WHEN list_contains(terms, lower(p))
            THEN '<b>' || p || '</b>' ELSE p END), '')), ' ') AS headline FROM snippet_words)"""

ORACLE["headline"] = f"{RRF_CTES}, {_SNIPPETS} SELECT cv_id, rank, job_id, headline FROM snippet"

_CV_TEXTS = "cv_texts AS (SELECT item_id AS cv_id, text AS cv_text FROM benchmark)"
ORACLE["hybrid_search_text"] = rrf_ctes(
    f"""{_CV_TEXTS}, {encoded_ctes('cv_vec', 'cv_texts', 'cv_id', 'cv_text')},
    cvq AS (SELECT c.cv_id, c.cv_text, v.embedding AS q FROM cv_texts c JOIN cv_vec v ON v.id = c.cv_id)""",
    f"{encoded_ctes('doc_vec', 'docs', 'job_id', 'text')}, corpus AS (SELECT id AS job_id, embedding FROM doc_vec)") + """
    SELECT cv_id, rank, job_id, embedding_score, fts_score, title_score, round(combined_score, 9) AS combined_score FROM top"""

ORACLE["fts_rank_stored"] = ORACLE["fts_rank"]

_MARKED = "regexp_replace(text, '([^.\\n<>]+)', '<b>\\1</b>', 'g')"


def strip_punct(x: str) -> str:
    return f"regexp_replace(lower({trim_ws(x)}), '[^{WORD}{WS}]', '', 'g')"


_KW_CLEAN = f"array_to_string(list_filter({split_ws(strip_punct('m'))}, lambda w: length(w) > 2), ' ')"
_KW_TERMS = (f"list_filter(list_transform(regexp_extract_all({_MARKED}, '<b>([^<]+)</b>', 1), lambda m: {_KW_CLEAN}), "
             "lambda t: t <> '')")
ORACLE["matching_terms"] = f"""WITH kw AS (SELECT doc_id, {_KW_TERMS} AS kw FROM documents)
    SELECT doc_id, list_slice({ordered_distinct('kw')}, 1, 10) AS keywords FROM kw"""

ORACLE["snippet_keywords"] = f"""{RRF_CTES}, {_SNIPPETS},
    kw AS (SELECT cv_id, rank, job_id, {_KW_TERMS.replace(_MARKED, 'headline')} AS kw FROM snippet)
    SELECT cv_id, rank, job_id, list_slice({ordered_distinct('kw')}, 1, 10) AS keywords FROM kw"""

ORACLE["link_classify"] = f"""{STATUS_CTES}
    SELECT job_id, status, status IN ('200', 'timeout', 'error', 'exception') AS alive FROM status"""

ORACLE["dead_offer_filter"] = f"""{RRF_CTES}
    SELECT cv_id, rank, job_id FROM top t WHERE NOT EXISTS (
        SELECT 1 FROM status s WHERE s.job_id = t.job_id AND s.status NOT IN ('200', 'timeout', 'error'))"""

ORACLE["dead_offer_delete"] = f"""{STATUS_CTES},
    dead AS (SELECT job_id FROM status WHERE status NOT IN ('200', 'timeout', 'error', 'exception')),
    silver AS (SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM dead WHERE dead.job_id = d.doc_id))
    SELECT 'silver' AS tbl, doc_id AS id FROM silver
    UNION ALL SELECT 'gold', vec_id FROM embeddings e WHERE EXISTS (SELECT 1 FROM silver s WHERE s.doc_id = e.vec_id)"""

ORACLE["result_card"] = f"""SELECT event_id, '{BASE_URL}' || CAST(event_id AS VARCHAR) AS url,
    CASE WHEN event_type = 'error' OR ts IS NULL THEN 'N/A' ELSE strftime(ts, '%Y-%m-%d') END AS date_display,
    CAST(trunc(least(value / 500.0::DOUBLE, 1.0::DOUBLE) * 100) AS INTEGER) AS pct FROM events"""

_TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"
ORACLE["silver_build"] = f"""SELECT CAST(page_id AS VARCHAR) AS job_id, {_TITLE} AS intitule, {html_clean('html')} AS description,
    concat_ws(' ', coalesce({_TITLE}, ''), {html_clean('html')}, '', '', '') AS vector_text_input,
    DATE '{AS_OF}' AS ingestion_date FROM pages WHERE page_id IS NOT NULL"""

ORACLE["gold_build"] = f"""WITH todo AS (SELECT doc_id AS job_id, concat_ws(' ', {first_line('text')}, text) AS t FROM documents d
        WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)), {encoded_ctes('v', 'todo', 'job_id', 't')}
    SELECT id AS job_id, embedding, DATE '{AS_OF}' - CAST(id % 5 AS INTEGER) AS ingestion_date FROM v"""

ORACLE["batch_end_to_end"] = f"""WITH page AS (SELECT CAST(page_id AS VARCHAR) AS job_id, page_id, {_TITLE} AS title,
        concat_ws(' ', coalesce({_TITLE}, ''), {html_clean('html')}, '', '', '') AS t FROM pages WHERE page_id IS NOT NULL),
    stored AS (SELECT job_id, title, 'stored ' || title AS t, DATE '{AS_OF}' - CAST(page_id % 90 AS INTEGER) AS d, toxic
        FROM page JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id) l ON l.doc_id = page_id),
    alive AS (SELECT * FROM stored WHERE d >= DATE '{AS_OF}' - 60),
    silver AS (SELECT job_id, t, d FROM alive UNION ALL SELECT job_id, t, DATE '{AS_OF}' FROM page p
        WHERE NOT EXISTS (SELECT 1 FROM alive a WHERE a.job_id = p.job_id)),
    encoded_text AS (SELECT s.job_id, coalesce(g.t, s.t) AS t FROM silver s
        LEFT JOIN (SELECT job_id, 'gold ' || title AS t FROM alive WHERE toxic = 0) g ON g.job_id = s.job_id),
    {encoded_ctes('v', 'encoded_text', 'job_id', 't')},
    gold AS (SELECT s.job_id, s.d, v.embedding FROM silver s JOIN v ON v.id = s.job_id),
    latest AS (SELECT max(d) AS d FROM silver)
    SELECT 'silver' AS tbl, job_id, CAST(d AS VARCHAR) AS ingestion_date, t AS vector_text_input, CAST(NULL AS FLOAT[]) AS embedding FROM silver
    UNION ALL SELECT 'export_silver', job_id, CAST(d AS VARCHAR), t, NULL FROM silver WHERE d = (SELECT d FROM latest)
    UNION ALL SELECT 'gold', job_id, CAST(d AS VARCHAR), NULL, embedding FROM gold
    UNION ALL SELECT 'export_gold', job_id, CAST(d AS VARCHAR), NULL, embedding FROM gold WHERE d = (SELECT d FROM latest)"""

ORACLE["rebuild_days"] = f"""WITH landed AS (
        SELECT CAST(page_id AS VARCHAR) AS job_id, {_TITLE} AS title, 'first day' AS d, CAST(NULL AS INTEGER) AS batch_no FROM pages
        WHERE page_id IN (SELECT doc_id FROM labels)
        UNION ALL SELECT CAST(page_id AS VARCHAR), {_TITLE}, {html_clean('html')}, 2 FROM pages
        WHERE page_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL))
    SELECT job_id, title AS intitule, d AS description, concat_ws(' ', coalesce(title, ''), d, '', '', '') AS vector_text_input, batch_no
    FROM landed"""

ORACLE["serving_load"] = f"""WITH served AS (SELECT doc_id AS id, 'served ' || source AS text, DATE '{AS_OF}' - CAST(doc_id % 60 AS INTEGER) AS d
        FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)),
    silver AS (SELECT id, text, d FROM served UNION ALL SELECT doc_id, text, DATE '{AS_OF}' FROM documents
        WHERE doc_id IS NOT NULL AND doc_id NOT IN (SELECT id FROM served)),
    kept AS (SELECT * FROM silver WHERE d >= DATE '{AS_OF}' - 30)
    SELECT 'silver' AS tbl, id, d AS ingestion_date, text, CAST(NULL AS FLOAT[]) AS embedding FROM kept
    UNION ALL SELECT 'gold', k.id, k.d, NULL, CASE WHEN k.id IN (SELECT id FROM served) THEN list_reverse(e.embedding)
        ELSE e.embedding END FROM kept k JOIN embeddings e ON e.vec_id = k.id"""

ORACLE["backfill_union"] = """SELECT user_id, event_id, ts, event_type, value FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM (
        SELECT event_id, ts, CAST(user_id AS BIGINT) AS user_id, CAST(NULL AS VARCHAR) AS event_type, value
            FROM events WHERE ts < TIMESTAMP '2024-01-15 00:00:00'
        UNION ALL SELECT event_id, ts, user_id, event_type, CAST(CAST(value AS FLOAT) AS DOUBLE)
            FROM events WHERE ts >= TIMESTAMP '2024-01-15 00:00:00') u) WHERE rn = 1"""

ORACLE["backfill_coverage"] = """WITH span AS (SELECT CAST(min(o_orderdate) AS DATE) - 20 AS s, CAST(max(o_orderdate) AS DATE) + 45 AS e FROM orders),
    months AS (SELECT CAST(m AS DATE) AS month, s, e FROM span,
        unnest(generate_series(CAST(date_trunc('month', s) AS TIMESTAMP), CAST(e AS TIMESTAMP), INTERVAL 1 MONTH)) AS g(m)),
    counts AS (SELECT CAST(date_trunc('month', CAST(o_orderdate AS DATE)) AS DATE) AS month, count(*) AS n FROM orders, span
        WHERE CAST(o_orderdate AS DATE) BETWEEN s AND e GROUP BY 1)
    SELECT greatest(m.month, m.s) AS chunk_start, least(last_day(m.month), m.e) AS chunk_end,
        coalesce(c.n, 0) AS n_rows, c.n IS NULL AS empty FROM months m LEFT JOIN counts c ON c.month = m.month"""

ORACLE["latest_batch"] = f"""WITH b AS (SELECT event_id, {_batch_name('ts')} AS batch FROM events)
    SELECT event_id, batch FROM b WHERE batch = (SELECT max(batch) FROM b)"""

ORACLE["recent_batches"] = f"""WITH b AS (SELECT event_id, {_batch_name('ts')} AS batch FROM events)
    SELECT event_id, batch FROM b WHERE {_stamp('batch')} >= TIMESTAMP '{AS_OF} 00:00:00' - INTERVAL 2 DAY"""

ORACLE["latest_day"] = f"""WITH b AS (SELECT event_id, {_batch_name('ts')} AS batch FROM events)
    SELECT event_id, batch FROM b WHERE CAST({_stamp('batch')} AS DATE) = (SELECT max(CAST({_stamp('batch')} AS DATE)) FROM b)"""

ORACLE["batch_complete"] = """SELECT d AS ingestion_date, count(*) - count(*) FILTER (WHERE g) AS n_silver, count(*) FILTER (WHERE g) AS n_gold,
    count(*) FILTER (WHERE g) BETWEEN 1 AND count(*) - 1 AS complete FROM (
        SELECT CAST(ts AS DATE) AS d, coalesce(event_type = 'purchase' AND value > 400, false) AS g FROM events) GROUP BY d"""

ORACLE["run_metrics"] = """SELECT count(*) AS rows_in, count(*) - count(DISTINCT text) AS duplicate_texts,
    count(*) FILTER (WHERE doc_id IS NULL) AS null_keys,
    count(*) FILTER (WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)) AS already_processed,
    count(*) FILTER (WHERE n_chars < 100) AS short_texts FROM documents d"""

ORACLE["stream_file_ingest"] = "SELECT DISTINCT event_id FROM events"

ORACLE["retention_partitions"] = ORACLE["retention"]

ORACLE["index_after_delete"] = f"""{STATUS_CTES},
    left_over AS (SELECT doc_id FROM documents d WHERE lang <> 'de' AND NOT EXISTS (
        SELECT 1 FROM status s WHERE s.job_id = d.doc_id AND s.status NOT IN ('200', 'timeout', 'error', 'exception'))),
    scores AS ({ORACLE["fts_rank"]})
    SELECT * FROM scores WHERE job_id IN (SELECT doc_id FROM left_over)"""

ORACLE["union_files"] = """SELECT CASE WHEN event_id % 3 = 2 THEN 'e' ELSE '' END || CAST(event_id AS VARCHAR) AS id,
    CASE event_id % 3 WHEN 0 THEN CAST(CAST(value AS DECIMAL(12, 2)) AS DOUBLE) WHEN 1 THEN value END AS value,
    CASE WHEN event_id % 3 = 1 THEN event_type END AS event_type, CASE WHEN event_id % 3 = 2 THEN user_id END AS "user" FROM events"""

ORACLE["run_counters"] = f"""WITH p AS (SELECT page_id AS id FROM pages),
    stored AS (SELECT id, toxic FROM p JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id) l ON l.doc_id = id
        WHERE DATE '{AS_OF}' - CAST(id % 90 AS INTEGER) >= DATE '{AS_OF}' - 60),
    n(counter, n) AS (
        SELECT 'rows_in', (SELECT count(*) + count(*) FILTER (id % 5 = 0) + count(*) FILTER (id % 7 = 0) FROM p)
        UNION ALL SELECT 'null_ids', (SELECT count(*) FILTER (id % 7 = 0) FROM p)
        UNION ALL SELECT 'repeated_ids', (SELECT count(*) FILTER (id % 5 = 0) FROM p)
        UNION ALL SELECT 'inserted', (SELECT count(*) FROM p WHERE id NOT IN (SELECT id FROM stored))
        UNION ALL SELECT 'embedded', (SELECT count(*) FROM p WHERE id NOT IN (SELECT id FROM stored WHERE toxic = 0)))
    SELECT 'r1' AS run_id, counter, n FROM n"""
