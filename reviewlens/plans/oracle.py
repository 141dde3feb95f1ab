"""DuckDB oracle SQL for every deterministic query.

DuckDB only has the raw tables, so fixture views are inlined as CTEs.
Written independently of the Spark code path (plain SQL over the raw
tables), rounded to 6 places where Spark and DuckDB could differ in the
last bits of a double.
"""

from __future__ import annotations

from ..constants import CLASSES

# ---- fixture CTE bodies ----
FX_META = """SELECT 'src' || CAST(s_suppkey AS VARCHAR) AS gmap_id, s_name AS name, n_name AS address,
  CASE WHEN s_suppkey % 7 = 3 THEN NULL WHEN s_suppkey % 7 = 5 THEN ' None ' ELSE 'Trades in ' || n_name END AS description,
  CASE WHEN s_suppkey % 3 = 0 THEN '["Pizza", "Bar"]' WHEN s_suppkey % 3 = 1 THEN 'Hair salon' ELSE '["Cafe"]' END AS category,
  CAST(10 + s_suppkey % 41 AS DOUBLE) / 10 AS avg_rating, CAST(s_suppkey % 90 AS BIGINT) AS num_of_reviews,
  CASE WHEN s_suppkey % 4 = 0 THEN 'Open' END AS state
FROM supplier JOIN nation ON s_nationkey = n_nationkey"""

FX_REVIEW = """SELECT doc_id AS review_id,
  CASE WHEN doc_id % 29 = 3 THEN NULL WHEN doc_id % 31 = 5 THEN '' WHEN doc_id % 17 = 2 THEN 'closed' ELSE source END AS gmap_id,
  CASE WHEN doc_id % 11 = 4 THEN NULL WHEN doc_id % 13 = 6 THEN 'null' ELSE text END AS text,
  'user' || CAST(doc_id % 50 AS VARCHAR) AS name,
  CASE WHEN doc_id % 9 <> 2 THEN 1 + n_chars % 5 END AS rating, doc_id * 1000 AS time,
  CASE WHEN doc_id % 6 = 0 THEN '{"time": 5, "text": "Thanks"}' WHEN doc_id % 6 = 1 THEN 'plain reply'
       WHEN doc_id % 6 = 2 THEN '{"time": 5, "text": null}' END AS resp
FROM documents"""

FX_GT = """SELECT doc_id AS review_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'valid'
  WHEN quality = 0 AND toxic = 0 THEN 'advertisement' WHEN quality = 1 THEN 'irrelevant'
  ELSE 'rants without visit' END AS label FROM labels"""


def _pred_case(thr: str) -> str:
    return f"""CASE WHEN g.review_id % 37 = 0 THEN 'ERROR: timeout' WHEN g.review_id % 41 = 0 THEN 'no idea'
  WHEN d.n_chars % 10 < {thr} THEN g.label WHEN d.n_chars % 3 = 0 THEN 'valid'
  WHEN d.n_chars % 3 = 1 THEN 'advertisement' ELSE 'irrelevant' END"""


FX_PRED = f"""SELECT g.review_id, {_pred_case('7')} AS label
FROM fx_gt g JOIN documents d ON g.review_id = d.doc_id"""

FX_PRED_TPL = f"""SELECT t.template, g.review_id, g.label AS y_true, {_pred_case('t.thr')} AS y_pred
FROM fx_gt g JOIN documents d ON g.review_id = d.doc_id
CROSS JOIN (VALUES ('zero_shot', 5), ('few_shot', 6), ('few_shot_cot', 7), ('cot_rag', 8)) AS t(template, thr)"""

FX_RESPONSE = """SELECT review_id, CASE review_id % 8
  WHEN 0 THEN 'Reasoning: ok.' || chr(10) || 'Classification: ' || label
  WHEN 1 THEN 'CLASSIFICATION:  ' || upper(label) || ' '
  WHEN 2 THEN 'Classification: ' || label || chr(10) || 'Reasoning: because'
  WHEN 3 THEN 'this is invalid' WHEN 4 THEN label || '.'
  WHEN 5 THEN 'I say ' || label || chr(10) || 'done' WHEN 6 THEN '  ' || label || chr(10)
  ELSE 'no idea' END AS response FROM fx_gt"""

# h = first 32 bits of md5(key || ':' || seed)
def h32(expr: str, seed: int = 42) -> str:
    return f"CAST(('0x' || substr(md5(CAST({expr} AS VARCHAR) || ':{seed}'), 1, 8)) AS BIGINT)"


VEC_THR = int(0.1 * 2 ** 32)
CLASS_OF = "(['valid', 'advertisement', 'irrelevant', 'rants without visit'])[(label % 4) + 1]"
FX_CORPUS = f"""SELECT vec_id, embedding, {CLASS_OF} AS label FROM embeddings WHERE {h32('vec_id')} >= {VEC_THR}"""
FX_QUERY = f"""SELECT vec_id AS query_id, embedding FROM embeddings WHERE {h32('vec_id')} < {VEC_THR}"""

# joined meta x review (JOIN-1) and composed reviews (FN-7/8 + PRED-3)
FX_JOINED = """SELECT m.name AS meta_name, m.address AS meta_address, m.description AS meta_description,
  m.category AS meta_category, m.avg_rating AS meta_avg_rating, m.num_of_reviews AS meta_num_of_reviews,
  m.state AS meta_state, r.text AS review_text, r.name AS review_name, r.rating AS review_rating,
  r.time AS review_time, r.resp AS review_resp, r.review_id, r.gmap_id
FROM fx_review r JOIN fx_meta m ON r.gmap_id = m.gmap_id
WHERE r.gmap_id IS NOT NULL AND r.gmap_id <> '' """

_WS = ("[ \\t\\n\\r\\x0b\\x0c\\x1c-\\x1f\\x85\\xa0\\x{1680}\\x{2000}-\\x{200a}"
       "\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]")


def py_strip(e: str) -> str:
    return f"regexp_replace({e}, '^{_WS}+|{_WS}+$', '', 'g')"


def empty_or_null(e: str) -> str:
    return f"({e} IS NULL OR lower({py_strip(e)}) IN ('', 'null', 'none', 'nan'))"


_JCAT = "(CASE WHEN meta_category LIKE '[%' AND json_valid(meta_category) THEN meta_category END)"
CAT_TEXT = f"""CASE WHEN json_type({_JCAT}) = 'ARRAY'
   AND coalesce(list_bool_and(list_transform(json_extract({_JCAT}, '$[*]'), lambda e: json_type(e) = 'VARCHAR')), true)
  THEN array_to_string(CAST(json_extract_string({_JCAT}, '$[*]') AS VARCHAR[]), ', ') ELSE meta_category END"""

RESP_TEXT = """CASE WHEN review_resp IS NULL OR review_resp IN ('null', '') THEN NULL
  WHEN NOT json_valid(review_resp) THEN review_resp
  WHEN json_type(review_resp) = 'OBJECT' THEN nullif(json_extract_string(review_resp, '$.text'), '')
  ELSE nullif(json_extract_string(review_resp, '$'), '') END"""

FX_COMPOSED = f"""SELECT review_id, gmap_id,
  concat_ws(' | ', 'Store Name: ' || meta_name, 'Address: ' || meta_address, 'Description: ' || meta_description,
    'Category: ' || ({CAT_TEXT}), 'Average Rating: ' || CAST(meta_avg_rating AS VARCHAR),
    'Number of Reviews: ' || CAST(meta_num_of_reviews AS VARCHAR), 'Status: ' || meta_state) AS store_info,
  concat_ws(' | ', 'Review: ' || nullif(review_text, ''), 'Reviewer: ' || review_name,
    'Rating: ' || CAST(review_rating AS VARCHAR), 'Store Response: ' || ({RESP_TEXT})) AS text_info
FROM fx_joined
WHERE NOT {empty_or_null('meta_description')} AND NOT {empty_or_null('review_text')}"""

# composed reviews with a truth label where one exists (profile input)
FX_LABELLED = """SELECT c.review_id, c.gmap_id, c.store_info, c.text_info, g.label AS ai_classification
FROM fx_composed c LEFT JOIN fx_gt g ON c.review_id = g.review_id"""

FX_SPLIT = f"""SELECT *, CASE WHEN {h32('review_id')} < {int(0.1 * 2 ** 32)} THEN 'test' ELSE 'train' END AS split
FROM fx_labelled"""

CTES = {
    "fx_meta": FX_META, "fx_review": FX_REVIEW, "fx_gt": FX_GT, "fx_pred": FX_PRED,
    "fx_pred_tpl": FX_PRED_TPL, "fx_response": FX_RESPONSE, "fx_corpus": FX_CORPUS,
    "fx_query": FX_QUERY, "fx_joined": FX_JOINED, "fx_composed": FX_COMPOSED,
    "fx_labelled": FX_LABELLED, "fx_split": FX_SPLIT,
}
_DEPS = {
    "fx_pred": ["fx_gt"], "fx_pred_tpl": ["fx_gt"], "fx_response": ["fx_gt"],
    "fx_joined": ["fx_review", "fx_meta"], "fx_composed": ["fx_joined"],
    "fx_labelled": ["fx_composed", "fx_gt"], "fx_split": ["fx_labelled"],
}


def with_ctes(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the named fixture CTEs (and what they need)."""
    order: list[str] = []

    def add(n):
        for d in _DEPS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)
    for n in names:
        add(n)
    body = sql.strip()
    if not order:
        return body
    if body.upper().startswith("WITH "):
        body = body[5:]
        return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in order) + ",\n" + body
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in order) + "\n" + body


def class_list_sql() -> str:
    return "(" + ", ".join(f"'{c}'" for c in CLASSES) + ")"
