"""The registered queries in SQL, written over relations rather than by the operators' expressions."""

from __future__ import annotations

from themeloom.functions.dates import MONTHS_WIDE
from themeloom.operators.keywords import STOP_WORDS
from themeloom.plans.views import wording_sql

WORD = r"[\p{L}\p{N}_]+"
ITEM = r"[0-9]+|\p{L}+|[<>]=|=>|[^\x09-\x0d\x1c-\x20\x{85}\p{Z}]"
DATED = r"[0-9]{4}-[0-9]{2}-[0-9]{2}|" + WORD + r"|[^\x09-\x0d\x1c-\x20\x{85}\p{Z}]"
BLANK = r"[\x09-\x0d\x1c-\x20\x{85}\p{Z}]"
WIDE = "CASE {0} " + " ".join(f"WHEN '{name}' THEN {n}" for name, n in MONTHS_WIDE.items()) + " END"


def wide(x: str) -> str:
    return WIDE.format(x)


def narrow(x: str) -> str:
    return f"CASE WHEN {x} <> 'sept' THEN {wide(x)} END"


_TEXT, _INTENT = wording_sql()

REVIEWS = """planted AS (SELECT vec_id AS doc_id, label, list_transform(embedding, lambda x, i:
    CAST(x AS DOUBLE) + CASE WHEN i - 1 = label THEN 2.0 ELSE 0.0 END) AS vector FROM embeddings),
reviews AS (SELECT d.doc_id, d.text, d.lang, d.source, CAST(o.o_orderdate AS DATE) AS ts,
    CAST(substr(o.o_orderpriority, 1, 1) AS INT) AS score, p.vector
    FROM documents d JOIN orders o ON o.o_orderkey = d.doc_id LEFT JOIN planted p ON p.doc_id = d.doc_id)"""

GIVEN = """planted AS (SELECT vec_id AS doc_id, label, list_transform(embedding, lambda x, i:
    CAST(x AS DOUBLE) + CASE WHEN i - 1 = label THEN 2.0 ELSE 0.0 END) AS z FROM embeddings),
given AS (SELECT CAST(substr(o.o_orderpriority, 1, 1) AS BIGINT) AS set_id, p.doc_id, p.z,
    CAST(CASE WHEN p.z[1] < -0.15 THEN -1 ELSE p.label END AS BIGINT) AS cluster_id
    FROM planted p JOIN orders o ON o.o_orderkey = p.doc_id)"""

QUESTIONS = f"""raw AS (SELECT o_orderkey AS query_id, CAST(o_orderdate AS DATE) AS as_of, o_orderstatus AS st,
    CAST(substr(o_orderpriority, 1, 1) AS INT) AS pr FROM orders),
pieces AS (SELECT *, strftime(as_of, '%b') AS p_mon, strftime(as_of, '%B') AS p_month, strftime(as_of, '%Y') AS p_y,
    strftime(as_of + INTERVAL 1 MONTH, '%b') AS p_mon2, strftime(as_of + INTERVAL 1 MONTH, '%Y') AS p_y2,
    CAST(day(as_of) AS VARCHAR) AS p_day, strftime(as_of, '%Y-%m-%d') AS p_iso,
    strftime(as_of + 30, '%Y-%m-%d') AS p_iso2, CAST(pr AS VARCHAR) AS p_s FROM raw),
questions AS (SELECT query_id, {_TEXT} AS query, as_of, {_INTENT} AS intent FROM pieces)"""

# Words with their tag, then dates and rating from tags, from text, and merged.
ENTS = QUESTIONS + f""",
wordsq AS (SELECT query_id, regexp_extract_all(query, '{WORD}') AS ws FROM questions),
tokens AS (SELECT query_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM wordsq),
ents AS (SELECT query_id, CAST(pos AS INT) AS pos, word, CASE WHEN {wide('lower(word)')} IS NOT NULL THEN 'MONTH'
    WHEN regexp_full_match(word, '[0-9]{{4}}') THEN 'YEAR' WHEN regexp_full_match(word, '[0-9]') THEN 'SCORE' END
    AS entity_group FROM tokens)"""

META = ENTS + f""",
months AS (SELECT query_id, list(m ORDER BY pos) AS ms FROM (SELECT query_id, pos, {narrow('lower(word)')} AS m FROM ents
    WHERE entity_group = 'MONTH') WHERE m IS NOT NULL GROUP BY query_id),
years AS (SELECT query_id, max_by(CAST(word AS INT), pos) AS y FROM ents WHERE entity_group = 'YEAR' GROUP BY query_id),
scores AS (SELECT query_id, max_by(CAST(word AS INT), pos) AS s, max(CAST(word AS INT)) AS top FROM ents
    WHERE entity_group = 'SCORE' GROUP BY query_id),
tagged AS (SELECT q.query_id, q.query, q.as_of, q.intent, make_date(y, ms[1], 1) AS start_date,
    last_day(make_date(y, coalesce(ms[2], ms[1]), 1)) AS end_date, s AS rating_gte, s AS rating_lte, top
    FROM questions q LEFT JOIN months USING (query_id) LEFT JOIN years USING (query_id) LEFT JOIN scores USING (query_id)),
items AS (SELECT query_id, unnest(ws) AS w, unnest(range(len(ws))) AS pos FROM
    (SELECT query_id, regexp_extract_all(lower(query), '{ITEM}') AS ws FROM questions)),
walk AS (SELECT query_id, pos, w, lag(w, 2) OVER k AS w_2, lag(w) OVER k AS w_1, lead(w) OVER k AS w1, lead(w, 2) OVER k AS w2,
    lead(w, 3) OVER k AS w3 FROM items WINDOW k AS (PARTITION BY query_id ORDER BY pos)),
kinds AS (SELECT *, regexp_full_match(w, '[a-z]{{3,9}}') AS name, regexp_full_match(w2, '[a-z]{{3,9}}') AND regexp_full_match(w3, '[0-9]{{4}}') AS name_year,
    regexp_full_match(w1, '[0-9]{{4}}') AS year_next, w BETWEEN '0' AND '5' AND length(w) = 1 AS mark, w2 BETWEEN '0' AND '5' AND length(w2) = 1 AS mark2,
    w1 BETWEEN '0' AND '9' AND length(w1) = 1 AS digit_next, regexp_full_match(w, '[0-9]+') AS number FROM walk),
heard AS (SELECT query_id, min_by(w, pos) FILTER (name AND w1 = 'to' AND name_year) AS ra, min_by(w2, pos) FILTER (name AND w1 = 'to' AND name_year) AS rb,
    min_by(w3, pos) FILTER (name AND w1 = 'to' AND name_year) AS ry, min_by(w, pos) FILTER (name AND year_next) AS om, min_by(w1, pos) FILTER (name AND year_next) AS oy,
    min_by(w1, pos) FILTER (w = 'score' AND digit_next) AS said, count(*) FILTER ((w = '5' AND w1 = 'score') OR (w = 'score' AND w1 = '5')) > 0 AS five,
    min_by(w[1], pos) FILTER (number AND (w_1 IN ('>=', '=>', 'above') OR (w_2 = 'greater' AND w_1 = 'than'))) AS lim,
    coalesce(min_by([w, w2], pos) FILTER (mark AND mark2 AND w1 IN ('and', 'to', '-') AND w_1 = 'between'),
        min_by([w, w2], pos) FILTER (mark AND mark2 AND w1 IN ('to', '-'))) AS ends,
    min_by(w, pos) FILTER (mark AND (w_1 IN ('above', '>', '=>') OR (w_2 = 'greater' AND w_1 = 'than'))) AS over,
    min_by(w, pos) FILTER (mark AND (w_1 = '>=' OR (w_2 = 'at' AND w_1 = 'least'))) AS least,
    count(*) FILTER (w = '>=' OR (w = 'or' AND w1 = 'above') OR (w = 'at' AND w1 = 'least')) > 0 AS up,
    count(*) FILTER (w = '<=' OR (w = 'or' AND w1 = 'below')) > 0 AS down, count(*) FILTER (w IN ('-', 'to')) > 0 AS until
    FROM kinds GROUP BY query_id),
nums AS (SELECT query_id, five, said, lim, {narrow('ra')} AS ra, {narrow('rb')} AS rb, TRY_CAST(ry AS INT) AS ry,
    {narrow('om')} AS om, TRY_CAST(oy AS INT) AS oy FROM questions LEFT JOIN heard USING (query_id)),
textual AS (SELECT query_id, CASE WHEN ra IS NOT NULL AND rb IS NOT NULL THEN make_date(ry, ra, 1) ELSE make_date(oy, om, 1) END AS start_date,
    CASE WHEN ra IS NOT NULL AND rb IS NOT NULL THEN last_day(make_date(ry, rb, 1)) ELSE last_day(make_date(oy, om, 1)) END AS end_date,
    CASE WHEN ra IS NULL OR rb IS NULL THEN NULL WHEN five THEN 5
        WHEN said <> '' THEN CAST(said AS INT) WHEN lim <> '' THEN CAST(lim AS INT) END AS rating_gte,
    CASE WHEN ra IS NULL OR rb IS NULL THEN NULL WHEN five THEN 5
        WHEN said <> '' THEN CAST(said AS INT) END AS rating_lte FROM nums),
merged AS (SELECT t.query_id, t.query, t.as_of, t.intent, t.top, coalesce(t.start_date, x.start_date) AS start_date,
    coalesce(t.end_date, x.end_date) AS end_date,
    CASE WHEN t.start_date IS NULL AND (x.rating_gte IS NOT NULL OR x.rating_lte IS NOT NULL) THEN x.rating_gte ELSE t.rating_gte END AS rating_gte,
    CASE WHEN t.start_date IS NULL AND (x.rating_gte IS NOT NULL OR x.rating_lte IS NOT NULL) THEN x.rating_lte ELSE t.rating_lte END AS rating_lte
    FROM tagged t JOIN textual x USING (query_id))"""

TERMS = """CASE WHEN contains(lower({0}), 'electronics') THEN ['nicht', 'sich', 'von'] ELSE CAST([] AS VARCHAR[]) END ||
    CASE WHEN contains(lower({0}), 'food') THEN ['avec', 'dans', 'und', 'une'] ELSE CAST([] AS VARCHAR[]) END"""

SETS = META + f""", {REVIEWS},
asked AS (SELECT *, {TERMS.format('query')} AS terms FROM merged),
sets AS (SELECT DISTINCT start_date, end_date, rating_gte, rating_lte, terms FROM asked),
docwords AS (SELECT *, list_distinct(regexp_extract_all(lower(text), '{WORD}')) AS ws FROM reviews)"""

# The same over all questions and a broad one for every year.
ALL_SETS = SETS.replace("questions AS (SELECT query_id,", "questions AS (SELECT CAST(-y AS BIGINT) AS query_id, "
                        "'subjects of the whole of jan to dec ' || CAST(y AS VARCHAR) AS query, as_of, 'trend_analysis' AS intent "
                        "FROM (SELECT year(as_of) AS y, max(as_of) AS as_of FROM raw GROUP BY 1) UNION ALL SELECT query_id,", 1)

MATCH = """r.ts BETWEEN s.start_date AND s.end_date AND (len(s.terms) = 0 OR list_has_any(r.ws, s.terms))"""
RATED = """(s.rating_gte IS NULL AND s.rating_lte IS NULL OR r.score BETWEEN
    least(coalesce(s.rating_gte, 0), coalesce(s.rating_lte, 5)) AND greatest(coalesce(s.rating_gte, 0), coalesce(s.rating_lte, 5)))"""
SAME = """s.start_date IS NOT DISTINCT FROM a.start_date AND s.end_date IS NOT DISTINCT FROM a.end_date
    AND s.rating_gte IS NOT DISTINCT FROM a.rating_gte AND s.rating_lte IS NOT DISTINCT FROM a.rating_lte AND s.terms = a.terms"""

PHRASE = """CASE WHEN regexp_full_match({t}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN TRY_CAST({t} AS DATE)
    WHEN regexp_full_match({t}, '[0-9]{{1,2}}\\s+[a-z]+\\.?\\s+[0-9]{{4}}') AND {mon} IS NOT NULL THEN
        TRY_CAST(regexp_extract({t}, '([0-9]{{4}})$', 1) || '-' || lpad(CAST({mon} AS VARCHAR), 2, '0') || '-' || lpad(regexp_extract({t}, '^([0-9]+)', 1), 2, '0') AS DATE)
    WHEN regexp_full_match({t}, '[a-z]+\\.?\\s+[0-9]{{4}}') THEN make_date(CAST(regexp_extract({t}, '([0-9]{{4}})$', 1) AS INT), {mon}, 1)
    WHEN regexp_full_match({t}, '[a-z]+\\.?') THEN make_date(year(as_of), {mon}, 1)
    WHEN regexp_full_match({t}, '[0-9]{{4}}') THEN make_date(CAST({t} AS INT), month(as_of), 1) END"""


def phrase(t: str) -> str:
    return PHRASE.format(t=t, mon="(" + wide(f"regexp_extract({t}, '([a-z]+)', 1)") + ")")


TAGGED = QUESTIONS + f""",
bw AS (SELECT query_id, regexp_split_to_array(trim(query), '\\s+') AS ws FROM questions),
tk AS (SELECT query_id, unnest(ws) AS word, CAST(unnest(range(len(ws))) AS INT) AS pos FROM bw),
gu AS (SELECT *, CASE WHEN {wide("lower(trim(word, '.'))")} IS NOT NULL THEN 'MONTH' WHEN regexp_full_match(word, '[0-9]{{4}}') THEN 'YEAR'
    WHEN regexp_full_match(word, '[0-9]') THEN 'SCORE' END AS g FROM tk),
li AS (SELECT *, coalesce(word = 'to' AND lag(g) OVER w = 'MONTH' AND lead(g) OVER w = 'MONTH', false) AS link FROM gu
    WINDOW w AS (PARTITION BY query_id ORDER BY pos)),
tags AS (SELECT query_id, pos, word, g, CASE WHEN link OR coalesce(lag(link) OVER (PARTITION BY query_id ORDER BY pos), false) THEN 'I-MONTH'
    WHEN g IS NULL THEN 'O' ELSE 'B-' || g END AS tag FROM li)"""

SPANS = """flags{n} AS (SELECT query_id, pos, word, {tag} AS tag, regexp_replace({tag}, '^[BI]-', '') AS kind FROM tags),
runs{n} AS (SELECT *, CASE WHEN starts_with(tag, 'B-') OR tag = 'O' OR coalesce(lag(kind) OVER w, '') <> kind THEN 1 ELSE 0 END AS fresh
    FROM flags{n} WINDOW w AS (PARTITION BY query_id ORDER BY pos)),
cum{n} AS (SELECT *, sum(fresh) OVER (PARTITION BY query_id ORDER BY pos) AS span FROM runs{n}),
spans{n} AS (SELECT query_id, kind AS entity_group, min(pos) AS "start", max(pos) AS "end", string_agg(word, ' ' ORDER BY pos) AS text
    FROM cum{n} WHERE tag <> 'O' GROUP BY query_id, span, kind)"""

PAIRS = """planted AS (SELECT vec_id AS doc_id, label, list_transform(embedding, lambda x, i:
    CAST(x AS DOUBLE) + CASE WHEN i - 1 = label THEN 2.0 ELSE 0.0 END) AS v FROM embeddings),
pairs AS (SELECT a.doc_id, b.doc_id AS nbr_doc, {dist} AS d FROM planted a JOIN planted b ON a.doc_id <> b.doc_id),
near AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY round(d, 9), nbr_doc) AS INT) AS rank FROM pairs),
knn AS (SELECT * FROM near WHERE rank <= 10)"""
EUCLID = "sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))"
COSINE = "1 - list_cosine_similarity(a.v, b.v)"
REACH = PAIRS.format(dist=EUCLID) + """,
core AS (SELECT doc_id, max(d) AS core FROM knn GROUP BY doc_id),
reach AS (SELECT least(k.doc_id, k.nbr_doc) AS a, greatest(k.doc_id, k.nbr_doc) AS b, min(greatest(k.d, x.core, y.core)) AS w
    FROM knn k JOIN core x ON x.doc_id = k.doc_id JOIN core y ON y.doc_id = k.nbr_doc GROUP BY 1, 2)"""

CENTRES = GIVEN + """,
longer AS (SELECT set_id, cluster_id, doc_id, unnest(z) AS x, CAST(unnest(range(len(z))) AS INT) AS dim FROM given WHERE cluster_id <> -1),
centre AS (SELECT set_id, cluster_id, dim, avg(x) AS m FROM longer GROUP BY ALL),
dists AS (SELECT set_id, cluster_id, doc_id, sqrt(sum((x - m) * (x - m))) AS d FROM longer JOIN centre USING (set_id, cluster_id, dim) GROUP BY ALL),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY set_id, cluster_id ORDER BY round(d, 9), doc_id) AS INT) AS rank FROM dists)"""

DESCRIBED = GIVEN + """,
described AS (SELECT set_id, cluster_id, count(*) AS size, concat_ws(', ', min(lang), max(source)) AS label,
    min(doc_id) AS lo, max(doc_id) AS hi FROM given JOIN documents USING (doc_id) WHERE cluster_id <> -1 GROUP BY 1, 2)"""

BM25 = f"""fields AS (SELECT doc_id, lang, f, regexp_extract_all(lower(CASE f WHEN 0 THEN text ELSE source END), '{WORD}') AS ws
    FROM documents, (VALUES @fields) t(f)),
stats AS (SELECT f, count(*) AS n, avg(len(ws)) AS avgdl FROM fields WHERE len(ws) > 0 GROUP BY f),
tf AS (SELECT doc_id, f, len(ws) AS dl, term, count(*) AS tf FROM (SELECT doc_id, f, ws, unnest(ws) AS term FROM fields)
    WHERE term IN ('nicht', 'sich', 'von', 'avec', 'dans', 'und', 'une') GROUP BY ALL),
df AS (SELECT f, term, count(*) AS df FROM tf GROUP BY ALL),
gain AS (SELECT doc_id, f, term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl)) AS g
    FROM tf JOIN df USING (f, term) JOIN stats USING (f)),
asked AS (SELECT DISTINCT lang, unnest(CASE WHEN lang = 'de' THEN ['nicht', 'sich', 'von'] ELSE CAST([] AS VARCHAR[]) END
    || ['avec', 'dans', 'und', 'une']) AS term FROM documents),
rel AS (SELECT lang, doc_id, max(s) AS s FROM (SELECT a.lang, doc_id, f, sum(g) AS s FROM gain JOIN asked a USING (term) GROUP BY ALL) GROUP BY ALL)"""

STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_WORDS)
COLS = "query_id, start_date, end_date, CAST(rating_gte AS INT) AS rating_gte, CAST(rating_lte AS INT) AS rating_lte"
MONTH_NAMES = "|".join(MONTHS_WIDE)

ORACLES: dict[str, str] = {
    "document_source": "SELECT doc_id, CAST(length(text) AS INT) AS chars, CAST(CAST(n_chars AS FLOAT) AS DOUBLE) AS score FROM documents",
    "vector_only_scan": f"WITH {REVIEWS} SELECT doc_id, CAST(len(vector) AS INT) AS dim, round(vector[1], 6) AS v0 FROM reviews WHERE vector IS NOT NULL",
    "doc_filter_date_score": f"""WITH {REVIEWS} SELECT doc_id, CAST(len(vector) AS INT) AS dim FROM reviews
        WHERE ts BETWEEN DATE '1996-01-01' AND DATE '1997-12-31' AND score >= 4 AND lang <> 'es' AND vector IS NOT NULL""",
    "equality_filter_cap": f"WITH {REVIEWS} SELECT doc_id FROM reviews WHERE lang = 'en' AND vector IS NOT NULL ORDER BY doc_id LIMIT 100",
    "lookup_by_ids": "SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "profile_fields": """SELECT o_orderkey AS doc_id, CAST(o_orderdate AS DATE) AS day, o_totalprice AS score, o_orderpriority AS text_0,
        o_orderstatus AS text_1, o_orderstatus AS category FROM orders""",
    "first_text": """SELECT d.doc_id, md5(coalesce(nullif(b.text, ''), nullif(d.text, ''), '')) AS text_md5
        FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id""",
    "clean_docs": f"""SELECT conv_id, turn, md5(c) AS clean_md5 FROM (SELECT conv_id, turn,
        regexp_replace(text, '^{BLANK}+|{BLANK}+$', '', 'g') AS c FROM conversations) WHERE length(c) >= 5""",
    "month_bounds": """SELECT o_orderkey, CAST(month(d) AS INT) AS m_full, CAST(month(d) AS INT) AS m_short, 9 AS m_wide, CAST(NULL AS INT) AS m_sept,
        CAST(date_trunc('month', d) AS DATE) AS first_day, last_day(d) AS last_day, make_date(year(d), 1, 1) AS year_first,
        make_date(year(d), 12, 31) AS year_last, strftime(last_day(d), '%Y-%m-%d') AS iso
        FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""",
    "tag_and_digits": """SELECT p_partkey, CASE WHEN p_size >= 15 AND p_size < 30 THEN '' ELSE p_type END AS grp,
        TRY_CAST(regexp_replace(p_brand, '[^0-9]', '', 'g') AS INT) AS brand_no,
        TRY_CAST(regexp_replace(p_name, '[^0-9]', '', 'g') AS INT) AS name_no FROM part""",
    "token_counts": f"""SELECT doc_id, CAST(len(w) AS INT) AS n_words, CAST(len(list_distinct(w)) AS INT) AS n_distinct,
        CAST(len(regexp_extract_all(text, '[^\\x09-\\x0d\\x1c-\\x20\\x{{85}}\\p{{Z}}]+')) AS INT) AS n_tokens
        FROM (SELECT doc_id, text, regexp_extract_all(lower(text), '{WORD}') AS w FROM documents)""",
    "score_terms_filter": f"""WITH {REVIEWS} SELECT doc_id, score IN (4, 5) AS kw_from_4, score IN (3, 4, 5) AS kw_swapped,
        score IN (0, 1, 2) AS text_to_2, score >= 2 AS num_from_2, true AS num_all FROM reviews""",
    "topic_must_match": f"""SELECT doc_id, lang FROM (SELECT doc_id, lang, regexp_extract_all(lower(text), '{WORD}') AS ws FROM documents)
        WHERE list_has_any(ws, ['avec', 'dans', 'und', 'une']) OR lang = 'de' AND list_has_any(ws, ['nicht', 'sich', 'von'])""",
    "synonym_union": f"WITH {QUESTIONS} SELECT query_id, array_to_string({TERMS.format('query')}, ' ') AS terms FROM questions",
    "category_from_query": f"""WITH {QUESTIONS} SELECT query_id, CASE WHEN query ILIKE '%electronics%' THEN 'electronics'
        WHEN query ILIKE '%food%' OR query ILIKE '%grocery%' THEN 'foods' END AS category FROM questions""",
    "keyword_filter": f"""SELECT conv_id, turn, CAST(len(list_filter(w, lambda x: length(x) > 11)) AS INT) AS n_keywords,
        list_has_any(w, ['und', 'les']) AS hit, true AS own_hit
        FROM (SELECT conv_id, turn, regexp_extract_all(lower(text), '{WORD}') AS w FROM conversations)""",
    "gazetteer_tags": f"WITH {ENTS} SELECT query_id, pos, word, entity_group FROM ents WHERE entity_group IS NOT NULL",
    "query_meta_entities": f"WITH {META} SELECT {COLS} FROM tagged",
    "query_meta_fallback": f"WITH {META} SELECT {COLS} FROM textual",
    "query_meta_merged": f"WITH {META} SELECT {COLS} FROM merged",
    "rating_comparators": f"""WITH {META}, n AS (SELECT m.*, CAST(ends[1] AS INT) AS a, CAST(ends[2] AS INT) AS b, over AS ov, least AS al
        FROM merged m LEFT JOIN heard USING (query_id))
        SELECT query_id, CAST(CASE WHEN a IS NOT NULL THEN least(a, b) WHEN ov IS NOT NULL THEN least(5, CAST(ov AS INT) + 1)
            WHEN al IS NOT NULL THEN CAST(al AS INT) WHEN top IS NOT NULL THEN top ELSE rating_gte END AS INT) AS rating_gte,
        CAST(CASE WHEN a IS NOT NULL THEN greatest(a, b) WHEN ov IS NOT NULL OR al IS NOT NULL THEN NULL
            WHEN top IS NOT NULL THEN top ELSE rating_lte END AS INT) AS rating_lte FROM n""",
    "date_range_iso_relative": f"""WITH {QUESTIONS}, x AS (SELECT query_id, as_of, lower(trim(query)) AS t,
        regexp_split_to_array(trim(lower(query)), '\\s+') AS ws FROM questions),
        toks AS (SELECT query_id, unnest(ts) AS w, unnest(range(len(ts))) AS pos FROM (SELECT query_id,
            regexp_extract_all(lower(query), '{DATED}') AS ts FROM questions)),
        near AS (SELECT *, lag(w) OVER k AS w_1, lead(w) OVER k AS w1, lead(w, 2) OVER k AS w2 FROM toks WINDOW k AS (PARTITION BY query_id ORDER BY pos)),
        sort AS (SELECT *, regexp_full_match(w, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AS iso, regexp_full_match(w2, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AS iso2,
            regexp_full_match(w, '[0-9]{{1,2}}') AS few, coalesce(regexp_full_match(w_1, '[0-9]{{1,2}}'), false) AS few_1,
            coalesce(regexp_full_match(w_1, '{WORD}'), false) AS plain_1, regexp_full_match(w, '{WORD}') AS word,
            regexp_full_match(w1, '{WORD}') AS word1, regexp_full_match(w1, '[0-9]{{4}}') AS four1, regexp_full_match(w2, '[0-9]{{4}}') AS four2 FROM near),
        told AS (SELECT query_id, CASE WHEN iso AND NOT plain_1 THEN w WHEN few AND word1 AND four2 THEN w || ' ' || w1 || ' ' || w2
            WHEN word AND four1 AND NOT few_1 THEN w || ' ' || w1 END AS s FROM sort),
        ends AS (SELECT query_id, min_by([w, w2], pos) FILTER (iso AND iso2 AND w1 IN ('to', 'through', '–', '-')) AS iso FROM sort GROUP BY query_id),
        opened AS (SELECT query_id, ws, list_position(list_transform(ws, lambda v: v IN ('from', 'between')), true) AS o FROM x),
        turned AS (SELECT *, list_filter(range(1, len(ws)), lambda v: v > o + 1 AND ws[v] IN ('to', 'and'))[1] AS u FROM opened),
        side AS (SELECT query_id, CASE WHEN o > 0 AND u IS NOT NULL THEN array_to_string(ws[o + 1:u - 1], ' ') ELSE '' END AS a,
            CASE WHEN o > 0 AND u IS NOT NULL THEN array_to_string(ws[u + 1:], ' ') ELSE '' END AS b FROM turned),
        m AS (SELECT query_id, min(d) AS lo, max(d) AS hi FROM (SELECT query_id, {phrase('s')} AS d FROM (SELECT query_id, as_of, s FROM told JOIN x USING (query_id) WHERE s IS NOT NULL)) GROUP BY query_id),
        y AS (SELECT x.*, lo, hi, TRY_CAST(iso[1] AS DATE) AS ia, TRY_CAST(iso[2] AS DATE) AS ib, sa, sb, w FROM x LEFT JOIN m USING (query_id) LEFT JOIN ends USING (query_id)
            JOIN (SELECT query_id, {phrase('sidea')} AS sa, {phrase('sideb')} AS sb, {phrase('t')} AS w FROM (SELECT query_id, as_of, t, a AS sidea, b AS sideb FROM x JOIN side USING (query_id))) USING (query_id)),
        z AS (SELECT query_id, CASE WHEN ia IS NOT NULL AND ib IS NOT NULL THEN [ia, ib] WHEN sa IS NOT NULL AND sb IS NOT NULL THEN [sa, sb]
            WHEN regexp_matches(t, '(last|past|previous) 7 days|last week') THEN [as_of - 7, as_of]
            WHEN contains(t, 'last month') THEN [CAST(date_trunc('month', as_of) - INTERVAL 1 MONTH AS DATE), last_day(CAST(date_trunc('month', as_of) - INTERVAL 1 MONTH AS DATE))]
            WHEN contains(t, 'yesterday') THEN [as_of - 1, as_of - 1]
            WHEN contains(t, 'today') THEN [as_of, as_of]
            WHEN w IS NOT NULL AND regexp_matches(t, '\\b({MONTH_NAMES})\\b') THEN [CAST(date_trunc('month', w) AS DATE), last_day(w)]
            WHEN w IS NOT NULL AND regexp_full_match(t, '[0-9]{{4}}') THEN [make_date(year(w), 1, 1), make_date(year(w), 12, 31)]
            ELSE [lo, hi] END AS r FROM y)
        SELECT query_id, least(r[1], r[2]) AS start_date, greatest(r[1], r[2]) AS end_date FROM z""",
    "span_months_rating": f"""WITH {META}, mo AS (SELECT query_id, min_by(m, pos) AS m1, max_by(m, pos) AS m2 FROM
            (SELECT query_id, pos, {wide('lower(word)')} AS m FROM tokens) WHERE m IS NOT NULL GROUP BY query_id),
        yr AS (SELECT query_id, CAST(y[1] AS INT) AS y1, CAST(y[len(y)] AS INT) AS y2 FROM (SELECT query_id, regexp_extract_all(query, '\\b((?:19|20)[0-9]{{2}})\\b') AS y FROM questions) WHERE len(y) > 0),
        sc AS (SELECT query_id, list(CAST(word AS INT)) AS ns FROM ents WHERE entity_group = 'SCORE' AND word BETWEEN '0' AND '5' GROUP BY query_id),
        al AS (SELECT q.query_id, up, down, until, ns, list_min(ns) AS lo, list_max(ns) AS hi, make_date(y1, m1, 1) AS a, last_day(make_date(y2, m2, 1)) AS b
            FROM questions q LEFT JOIN mo USING (query_id) LEFT JOIN yr USING (query_id) LEFT JOIN sc USING (query_id) LEFT JOIN heard USING (query_id)),
        ru AS (SELECT *, CASE WHEN hi IS NULL THEN 'none' WHEN up THEN 'ge'
            WHEN down THEN 'le' WHEN len(ns) = 2 AND until THEN 'range' ELSE 'eq' END AS rule FROM al)
        SELECT query_id, least(a, b) AS start_date, greatest(a, b) AS end_date,
            CAST(CASE rule WHEN 'ge' THEN hi WHEN 'range' THEN lo WHEN 'eq' THEN hi END AS INT) AS rating_gte,
            CAST(CASE rule WHEN 'le' THEN lo WHEN 'range' THEN hi WHEN 'eq' THEN hi END AS INT) AS rating_lte FROM ru""",
    "months_in_span": """SELECT o_orderkey, CAST(month(o_orderdate) AS VARCHAR) || ',' || CAST(month(o_orderdate + INTERVAL 2 MONTH) AS VARCHAR) AS months FROM orders""",
    "normalised_bounds": f"""WITH {META} SELECT query_id, CAST(CASE WHEN rating_gte IS NOT NULL THEN rating_gte WHEN month(start_date) > 6 THEN 1 ELSE day(start_date) END AS INT) AS gte,
        CAST(CASE WHEN rating_gte IS NOT NULL THEN rating_lte WHEN month(start_date) > 6 THEN month(start_date) ELSE day(start_date) END AS INT) AS lte FROM textual""",
    "span_collapse": f"""WITH {TAGGED}, {SPANS.format(n='', tag='tag')} SELECT query_id, entity_group, "start", "end", text FROM spans""",
    "query_doc_range_join": f"""WITH {SETS}, found AS (SELECT s.start_date, s.end_date, s.rating_gte, s.rating_lte, s.terms, count(*) AS n_docs, min(doc_id) AS first_doc, max(doc_id) AS last_doc
        FROM sets s JOIN docwords r ON {MATCH} AND {RATED} GROUP BY ALL)
        SELECT a.query_id, n_docs, first_doc, last_doc FROM asked a JOIN found s ON {SAME}""",
    "candidate_status": f"""WITH {SETS}, found AS (SELECT s.start_date, s.end_date, s.rating_gte, s.rating_lte, s.terms, count(*) AS n
        FROM sets s JOIN docwords r ON {MATCH} AND {RATED} AND r.vector IS NOT NULL GROUP BY ALL),
        st AS (SELECT a.query_id, a.intent, CASE WHEN EXISTS (SELECT 1 FROM asked b WHERE b.intent = 'trend_analysis' AND b.start_date IS NOT DISTINCT FROM a.start_date AND
            b.end_date IS NOT DISTINCT FROM a.end_date AND b.rating_gte IS NOT DISTINCT FROM a.rating_gte AND b.rating_lte IS NOT DISTINCT FROM a.rating_lte AND b.terms = a.terms)
            THEN coalesce(n, 0) ELSE 0 END AS n, a.start_date FROM asked a LEFT JOIN found s ON {SAME}),
        g AS (SELECT query_id, CAST(n AS BIGINT) AS n_candidates, CASE WHEN intent <> 'trend_analysis' THEN 'not_trend' WHEN start_date IS NULL THEN 'no_date_range'
            WHEN n < 20 THEN 'too_few' ELSE 'ok' END AS status FROM st)
        SELECT *, CASE status WHEN 'not_trend' THEN 'I can only analyze trends right now. Please ask about ''top trends''.'
            WHEN 'no_date_range' THEN 'Could not determine a date range from your query.'
            WHEN 'too_few' THEN 'Not enough reviews (' || n_candidates || ') with the specified filters.' END AS message FROM g""",
    "analyze_totals": f"""WITH {ALL_SETS}, found AS (SELECT s.start_date, s.end_date, s.rating_gte, s.rating_lte, s.terms, count(*) AS n
        FROM (SELECT DISTINCT start_date, end_date, rating_gte, rating_lte, terms FROM asked WHERE intent = 'trend_analysis') s
        JOIN docwords r ON {MATCH} AND {RATED} AND r.vector IS NOT NULL GROUP BY ALL),
        st AS (SELECT a.query_id, a.intent, a.start_date, coalesce(n, 0) AS n FROM asked a LEFT JOIN found s ON {SAME}),
        g AS (SELECT query_id, CAST(n AS BIGINT) AS n_candidates, CASE WHEN intent <> 'trend_analysis' THEN 'not_trend' WHEN start_date IS NULL THEN 'no_date_range'
            WHEN n < 20 THEN 'too_few' ELSE 'ok' END AS gate FROM st)
        SELECT query_id, gate, n_candidates, CASE WHEN gate = 'ok' THEN n_candidates END AS held FROM g""",
    "score_violation_probe": f"""WITH {SETS}, found AS (SELECT s.start_date, s.end_date, s.rating_gte, s.rating_lte, s.terms, count(*) AS n_candidates,
        count(*) FILTER (WHERE NOT {RATED}) AS n_violations FROM sets s JOIN docwords r ON {MATCH} GROUP BY ALL)
        SELECT a.query_id, n_candidates, n_violations FROM asked a JOIN found s ON {SAME}""",
    "bm25_topk": f"""WITH {BM25.replace('@fields', '(0), (1)')}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang ORDER BY round(s, 9) DESC, doc_id) AS INT) AS rank FROM rel)
        SELECT lang, doc_id, rank, round(s, 6) AS relevance FROM r WHERE rank <= 20""",
    "relevance_cap": f"""WITH {BM25.replace('@fields', '(0)')}, r AS (SELECT d.lang, d.doc_id, row_number() OVER (PARTITION BY d.lang ORDER BY round(coalesce(s, 0), 9) DESC, d.doc_id) AS rank
        FROM documents d LEFT JOIN rel ON rel.lang = d.lang AND rel.doc_id = d.doc_id) SELECT lang, doc_id FROM r WHERE rank <= 50""",
    "knn_cosine_exact": f"WITH {PAIRS.format(dist=COSINE)} SELECT doc_id, nbr_doc, rank, round(d, 6) AS dist FROM knn",
    "knn_euclidean_pivots": f"WITH {PAIRS.format(dist=EUCLID)} SELECT doc_id, nbr_doc, rank, round(d, 6) AS dist FROM knn",
    "core_distance": f"WITH {REACH} SELECT doc_id AS point_id, round(core, 6) AS core FROM core",
    "mutual_reach_edges": f"WITH {REACH} SELECT a, b, round(w, 6) AS w FROM reach",
    "components_at_level": f"""WITH RECURSIVE {REACH}, links AS MATERIALIZED (SELECT a AS x, b AS y FROM reach WHERE w <= 1.5 UNION SELECT b, a FROM reach WHERE w <= 1.5),
        walk(x, c) AS (SELECT doc_id, doc_id FROM planted UNION SELECT l.y, walk.c FROM walk JOIN links l ON l.x = walk.x WHERE walk.c < l.y)
        SELECT x AS point_id, min(c) AS comp FROM walk GROUP BY x""",
    # Grown point by point: ``best`` holds the lightest edge from every point to the tree, infinite for points in it.
    "exact_forest_weights": f"""WITH RECURSIVE {REACH}, dense AS MATERIALIZED (SELECT row_number() OVER (ORDER BY p.doc_id) AS i, list(coalesce(w, 'inf') ORDER BY q.doc_id) AS row
            FROM planted p CROSS JOIN planted q LEFT JOIN (SELECT d.doc_id, d.nbr_doc, greatest(d.d, x.core, y.core) AS w FROM pairs d JOIN core x USING (doc_id)
                JOIN core y ON y.doc_id = d.nbr_doc) e ON e.doc_id = p.doc_id AND e.nbr_doc = q.doc_id GROUP BY p.doc_id),
        grown(step, last, best, w) AS (SELECT 0, CAST(1 AS BIGINT), row, CAST(0 AS DOUBLE) FROM dense WHERE i = 1
            UNION ALL SELECT step + 1, n.i, list_transform(list_zip(best, n.row), lambda p, k: CASE WHEN p[1] = 'inf' OR k = n.i THEN CAST('inf' AS DOUBLE) ELSE least(p[1], p[2]) END), list_min(best)
            FROM grown g JOIN dense n ON n.i = list_position(g.best, list_min(g.best)) WHERE list_min(best) < 'inf')
        SELECT CAST(count(*) - 1 AS BIGINT) AS n_edges, round(sum(w), 4) AS total, round(max(w), 6) AS heaviest FROM grown""",
    "adaptive_params": f"""WITH {REVIEWS}, c AS (SELECT year(ts) AS y, score, count(*) AS n FROM reviews GROUP BY ALL)
        SELECT CAST(y AS INT) AS y, score, n, CAST(greatest(2, least(30, greatest(2, n - 1))) AS INT) AS neighbours, CAST(least(20, greatest(2, n)) AS INT) AS components,
        CAST(greatest(5, least(25, greatest(5, n // 10))) AS INT) AS min_size FROM c""",
    "density_planted": "SELECT vec_id AS doc_id, min(vec_id) OVER (PARTITION BY label) AS cluster FROM embeddings",
    "cluster_sizes": f"WITH {GIVEN} SELECT set_id, cluster_id, count(*) AS size FROM given WHERE cluster_id <> -1 GROUP BY ALL",
    "noise_counts": f"""WITH {GIVEN} SELECT set_id, count(*) AS total_vectors, count(*) FILTER (WHERE cluster_id = -1) AS noise_points,
        count(DISTINCT cluster_id) FILTER (WHERE cluster_id <> -1) AS n_clusters FROM given GROUP BY set_id""",
    "distinct_clusters": f"WITH {GIVEN} SELECT DISTINCT set_id, cluster_id FROM given WHERE cluster_id <> -1",
    "centroids": f"WITH {CENTRES} SELECT set_id, cluster_id, dim, round(m, 6) AS value FROM centre",
    "exemplars_topk": f"WITH {CENTRES} SELECT set_id, cluster_id, doc_id, rank, round(d, 6) AS dist FROM ranked WHERE rank <= 5",
    "tfidf_labels": f"""WITH {CENTRES},
        used AS (SELECT set_id, cluster_id, r.doc_id, regexp_replace(text, '^{BLANK}+|{BLANK}+$', '', 'g') AS t FROM ranked r JOIN documents d ON d.doc_id = r.doc_id WHERE rank <= 50),
        kept AS (SELECT set_id, cluster_id, doc_id, list_filter(regexp_extract_all(lower(t), '{WORD}'), lambda w: w NOT IN ({STOP})) AS w FROM used WHERE length(t) >= 5),
        grams AS (SELECT set_id, cluster_id, doc_id, unnest(w) AS term FROM kept UNION ALL
            SELECT set_id, cluster_id, doc_id, unnest(list_transform(list_zip(w[:-2], w[2:]), lambda p: p[1] || ' ' || p[2])) FROM kept WHERE len(w) > 1),
        tf AS (SELECT set_id, cluster_id, doc_id, term, count(*) AS tf FROM grams GROUP BY ALL),
        voc AS (SELECT set_id, cluster_id, term, sum(tf) AS total, count(*) AS df FROM tf GROUP BY ALL),
        top AS (SELECT *, row_number() OVER (PARTITION BY set_id, cluster_id ORDER BY total DESC, term) AS place FROM voc),
        n AS (SELECT set_id, cluster_id, count(*) AS n FROM kept GROUP BY ALL),
        g AS (SELECT tf.*, tf.tf * (ln((1 + n) / (1 + df)) + 1) AS gain FROM tf JOIN top USING (set_id, cluster_id, term) JOIN n USING (set_id, cluster_id) WHERE place <= 2000),
        l AS (SELECT *, sqrt(sum(gain * gain) OVER (PARTITION BY set_id, cluster_id, doc_id)) AS len FROM g),
        ws AS (SELECT set_id, cluster_id, term, sum(gain / len) AS weight FROM l GROUP BY ALL),
        rk AS (SELECT *, row_number() OVER (PARTITION BY set_id, cluster_id ORDER BY round(weight, 9) DESC, term) AS r FROM ws),
        lab AS (SELECT set_id, cluster_id, string_agg(term, ', ' ORDER BY r) AS label FROM rk WHERE r <= 5 GROUP BY ALL),
        have AS (SELECT set_id, cluster_id, count(*) FILTER (WHERE length(t) >= 5) AS n FROM used GROUP BY ALL)
        SELECT set_id, cluster_id, CASE WHEN n = 0 THEN '(no text)' ELSE coalesce(label, '(no vocabulary)') END AS label FROM have LEFT JOIN lab USING (set_id, cluster_id)""",
    "summary_lines": f"""WITH {DESCRIBED} SELECT set_id, string_agg('- Cluster ' || cluster_id || ' (n=' || size || '): ' || label, chr(10) ORDER BY cluster_id) AS summary
        FROM described GROUP BY set_id""",
    "report_struct_long": f"""WITH {DESCRIBED} SELECT set_id, CAST(row_number() OVER (PARTITION BY set_id ORDER BY size DESC, cluster_id) - 1 AS INT) AS place, cluster_id, size, label,
        lo || ',' || hi AS exemplars FROM described""",
    "prompt_column": f"""WITH {DESCRIBED}, ex AS (SELECT set_id, text, row_number() OVER (PARTITION BY set_id ORDER BY cluster_id) AS i FROM described JOIN documents ON doc_id = lo),
        p AS (SELECT set_id, string_agg('Trend Example ' || i || ': "' || text || '"', chr(10) ORDER BY i) AS prompt FROM ex GROUP BY set_id)
        SELECT s.set_id, md5(coalesce(prompt, 'No representative texts to summarize.')) AS prompt_md5 FROM (SELECT DISTINCT set_id FROM given) s LEFT JOIN p ON p.set_id = s.set_id""",
    "title_extract": f"""WITH {DESCRIBED}, n AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY cluster_id) AS i FROM described),
        t AS (SELECT set_id, 'About ' || label AS said, row_number() OVER (PARTITION BY set_id ORDER BY cluster_id) AS i FROM described WHERE cluster_id < 6),
        u AS (SELECT n.set_id, cluster_id, size, label, coalesce(said, upper(label[1]) || lower(regexp_replace(label[2:], ' (.)', ' ~\\1'))) AS raw FROM n LEFT JOIN t ON t.set_id = n.set_id AND t.i = n.i),
        v AS (SELECT *, CASE WHEN contains(raw, '~') THEN split_part(raw, '~', 1) || upper(split_part(raw, '~', 2)[1]) || split_part(raw, '~', 2)[2:] ELSE raw END AS title FROM u)
        SELECT set_id, cluster_id, title, '- **' || title || '** (n=' || size || ') — ' || label AS line FROM v""",
    "token_alignment": f"""WITH {QUESTIONS}, c AS (SELECT query_id, CAST(len(regexp_split_to_array(trim(query), '\\s+')) AS INT) AS n_tokens,
        CAST(len(regexp_extract_all(query, '{WORD}')) AS INT) AS n_labels FROM questions) SELECT *, n_tokens = n_labels AS aligned FROM c""",
    "label_vocabulary": f"""WITH {ENTS}, ok AS (SELECT query_id FROM questions WHERE len(regexp_split_to_array(trim(query), '\\s+')) = len(regexp_extract_all(query, '{WORD}'))),
        c AS (SELECT coalesce('B-' || entity_group, 'O') AS tag, count(*) AS n FROM ents JOIN ok USING (query_id) GROUP BY 1)
        SELECT tag, n, CAST(row_number() OVER (ORDER BY tag) - 1 AS INT) AS label_id FROM c""",
    "first_piece_labels": f"""WITH {TAGGED} SELECT query_id, word_index, CAST(piece AS INT) AS piece, CAST(CASE WHEN piece = 1 THEN n ELSE -100 END AS INT) AS label_id
        FROM (SELECT query_id, pos AS word_index, length(tag) AS n, unnest(range(1, CAST(ceil(length(word) / 4.0) AS INT) + 1)) AS piece FROM tags)""",
    "ratio_split_sizes": """SELECT 'train' AS split, CAST(floor(count(*) * 0.8) AS BIGINT) AS n FROM documents UNION ALL
        SELECT 'eval', count(*) - CAST(floor(count(*) * 0.8) AS BIGINT) FROM documents""",
    "stratified_split_sizes": """WITH c AS (SELECT lang AS label, count(*) AS n, sum(count(*)) OVER () AS a FROM documents GROUP BY lang),
        e AS (SELECT *, a - ceil(a * 0.2) AS want, n * (a - ceil(a * 0.2)) / a AS x FROM c),
        r AS (SELECT *, row_number() OVER (ORDER BY x - floor(x) DESC, label) AS i, want - sum(floor(x)) OVER () AS spare FROM e),
        k AS (SELECT label, n, CAST(floor(x) + CASE WHEN i <= spare THEN 1 ELSE 0 END AS BIGINT) AS t FROM r)
        SELECT label, 'train' AS split, t AS n FROM k UNION ALL SELECT label, 'eval', n - t FROM k""",
    "argmax_label": """WITH s AS (SELECT l_orderkey, l_quantity / 50 AS q, l_discount * 10 AS d, l_tax * 12 AS t FROM lineitem)
        SELECT CASE WHEN d >= q AND d >= t THEN 'discount' WHEN q >= t THEN 'quantity' ELSE 'tax' END AS best,
        CASE WHEN d >= t THEN 'discount' ELSE 'tax' END AS best_of_two, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS key_sum FROM s GROUP BY ALL""",
    "accuracy": "SELECT count(*) AS n, round(avg(CASE WHEN 1 - toxic = quality THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM labels",
    "entity_f1": f"""WITH {TAGGED}, {SPANS.format(n='', tag='tag')}, {SPANS.format(n='2', tag="coalesce('B-' || g, 'O')")},
        j AS (SELECT g.query_id AS gq, p.query_id AS pq FROM spans g FULL JOIN spans2 p ON g.query_id = p.query_id AND g."start" = p."start" AND g."end" = p."end" AND g.entity_group = p.entity_group),
        k AS (SELECT count(*) FILTER (WHERE gq IS NOT NULL AND pq IS NOT NULL) AS tp, count(*) FILTER (WHERE gq IS NULL) AS fp, count(*) FILTER (WHERE pq IS NULL) AS fn FROM j)
        SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM k""",
}

ORACLES["tfidf_labels_all"] = ORACLES["tfidf_labels"].replace("WHERE rank <= 50", "").replace("WHERE place <= 2000", "")
