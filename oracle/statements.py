"""One statement per catalogue query that SQL can express; patterns and constants are those of the operators."""

from __future__ import annotations

WS = (
    r"[\t-\r \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
TOKEN = r"[\p{L}\p{N}_]{2,}"
TEXT = ["subject", "description", "error_logs", "stack_trace"]

# ---- the tables seen as tickets ---------------------------------------------------------------

DOCUMENTS = """
doc_tickets AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS ticket_id, lang AS category,
    CASE quality WHEN 1 THEN 'good' WHEN 0 THEN 'poor' END AS subcategory, source AS product,
    split_part(text, chr(10), 1) AS subject, text AS description,
    CASE toxic WHEN 1 THEN ' ERROR_' || source || ' ' || chr(10) WHEN 0 THEN ' ' END AS error_logs,
    CASE quality WHEN 0 THEN 'at' || chr(13) || chr(10) || chr(9) || source END AS stack_trace,
    nullif(source, 'src3') AS customer_tier, lang || ' ' || source AS tags,
    CASE quality WHEN 1 THEN lang || ' ' || source ELSE CASE WHEN toxic IS NOT NULL THEN source END END AS articles,
    CASE quality WHEN 1 THEN 'FIXED' END AS resolution_code,
    CASE quality WHEN 1 THEN 'see ' || source END AS resolution,
    quality = 1 AS resolution_helpful, n_chars AS ticket_text_length
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

EVENTS = """
event_tickets AS (
  SELECT CAST(event_id AS VARCHAR) AS ticket_id, ts AS created_at, nullif(event_type, 'view') AS category,
    CASE event_type WHEN 'error' THEN 'Very Frustrated' WHEN 'click' THEN 'calm' WHEN 'signup' THEN 'Happy user'
      WHEN 'purchase' THEN 'dissatisfied' END AS customer_sentiment,
    CASE event_type WHEN 'error' THEN 'negative' WHEN 'click' THEN 'neutral' WHEN 'signup' THEN 'positive'
      WHEN 'purchase' THEN 'positive' ELSE 'unknown' END AS sentiment_norm,
    event_type AS subject,
    CASE event_type WHEN 'purchase' THEN 'URGENT order ' || props WHEN 'click' THEN 'Crash on ' || props END AS description,
    CASE event_type WHEN 'error' THEN 'ERROR_' || user_id END AS error_logs,
    CASE WHEN event_type = 'signup' THEN '' WHEN event_type <> 'view' THEN event_type END AS product,
    CASE WHEN value > 40 THEN 'gold' END AS customer_tier,
    CASE WHEN event_type = 'error' THEN value > 50 END AS contains_error_code,
    CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS n_helpful,
    CASE WHEN event_type = 'purchase' OR (event_type = 'signup' AND value > 30) THEN 1 ELSE 0 END AS success
  FROM events)"""

ORDERS = """
order_tickets AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS ticket_id,
    CASE WHEN NOT (o_orderpriority = '1-URGENT' AND o_orderstatus = 'P') THEN o_orderdate END AS created_at,
    o_orderpriority AS category, nullif(o_orderstatus, 'O') AS subcategory,
    CASE o_orderstatus WHEN 'F' THEN 'negative' WHEN 'O' THEN 'positive' ELSE 'unknown' END AS sentiment_norm,
    CASE WHEN o_totalprice > 50000 OR o_orderstatus = 'O' THEN 1 ELSE 0 END AS success
  FROM orders)"""

RAW_ORDERS = """
raw_tickets AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS ticket_id,
    CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' THEN 'nope'
      WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'O' THEN NULL ELSE 'ok' END AS created_state,
    o_orderdate, nullif(o_orderstatus, 'F') AS subject, o_orderpriority AS description,
    CAST(floor(c_acctbal) AS BIGINT) AS previous_tickets,
    CAST(floor(o_totalprice / 100000) AS BIGINT) AS satisfaction_score,
    c_acctbal, c_mktsegment
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

SHIPMENTS = """
shipments AS (
  SELECT l_orderkey || '-' || l_linenumber AS ticket_id, o_orderdate AS created_at, l_shipdate AS updated_at,
    CASE WHEN l_linestatus = 'F' THEN l_shipdate END AS resolved_at,
    nullif(l_returnflag, 'R') AS subject, l_linestatus AS description,
    CAST(floor(l_quantity / 10) AS BIGINT) AS satisfaction_score
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

REGISTRY = """
log AS (
  SELECT event_id AS seq, event_type IN ('signup', 'click') AS is_register, 'm' || user_id AS name,
    'v' || CAST(floor(CAST(json_extract_string(props, '$.k') AS INT) / 20.0) AS BIGINT) AS version,
    CASE WHEN event_type IN ('purchase', 'click') THEN 'Production' WHEN event_type = 'view' THEN 'Staging' ELSE 'None' END AS stage,
    strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS created_at
  FROM events)"""

RUNS = """
runs AS (
  SELECT CASE WHEN event_type <> 'signup' THEN 'r' || event_id ELSE 'old' || event_id END AS run_id,
    strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS "when", event_type AS component,
    CASE WHEN event_type = 'error' THEN 'failed' ELSE 'finished' END AS status,
    CASE WHEN event_type <> 'error' THEN '0.' || json_extract_string(props, '$.k') END AS val_f1_weighted,
    json_extract_string(props, '$.k') AS max_depth, CAST(user_id AS VARCHAR) AS epochs
  FROM events)"""


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def blank(c: str) -> str:
    return f"coalesce({c}, '')"


def digest(c: str) -> str:
    return f"md5({c}) AS text_md5, length({c}) AS text_chars"


FINGERPRINT = "md5(" + " || '||' || ".join(blank(c) for c in TEXT) + ")"


def bucket(key: str, seed: str) -> str:
    return f"CAST('0x' || substr(md5('{seed}|' || {key}), 1, 8) AS BIGINT) / 4294967296.0::double"


def split_case(key: str, seed: str = "42") -> str:
    u = bucket(key, seed)
    return f"CASE WHEN {u} < 0.7::double THEN 'train' WHEN {u} < 0.7::double + 0.15::double THEN 'val' ELSE 'test' END"


SPLIT_DOCUMENTS = DOCUMENTS + f""",
hashed AS (SELECT *, {FINGERPRINT} AS text_hash FROM doc_tickets),
split_docs AS (SELECT *, {split_case('text_hash')} AS split FROM hashed)"""

S: dict[str, str] = {}

# ---- sources and sinks ------------------------------------------------------------------------

S["read_project_tickets"] = f"""WITH {DOCUMENTS}
SELECT ticket_id, category, product, 'unknown' AS severity, false AS escalated, 0.0::double AS satisfaction_score,
  coalesce(customer_tier, 'unknown') AS customer_tier, length(description) AS n_description FROM doc_tickets"""

S["complete_nullable_tickets"] = f"""WITH {DOCUMENTS}
SELECT ticket_id, NULL::VARCHAR AS region, false AS weekend_ticket, resolution_helpful,
  true AS no_experience FROM doc_tickets"""

S["ticket_json_roundtrip"] = f"""WITH {DOCUMENTS}
SELECT ticket_id, category, resolution_helpful, ticket_text_length, tags, {digest('description')} FROM doc_tickets"""

ORDER_LINES = """
lines AS (
  SELECT *, '{"ticket_id":"' || o_orderkey || '","created_at":"' || strftime(o_orderdate, '%Y-%m-%d') || 'T23:30:00-05:00","subject":'
    || CASE o_orderstatus WHEN 'O' THEN CAST(o_custkey AS VARCHAR) ELSE '"finished"' END || ',"description":"d","tags":'
    || CASE o_orderpriority WHEN '1-URGENT' THEN '"urgent"' ELSE '["calm"]' END || '}' AS line
  FROM orders)"""
S["ingest_wall_clock_day"] = """
SELECT strftime(o_orderdate, '%Y-%m-%d') AS created_date, count(*) AS count FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1"""
S["ingest_rejects"] = f"WITH {ORDER_LINES} SELECT substr(line, 1, 40) AS record FROM lines WHERE o_orderstatus = 'P'"
S["ingest_violations"] = """
WITH read AS (SELECT CAST(o_orderkey AS VARCHAR) AS ticket_id, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus <> 'P')
SELECT ticket_id, 'subject' AS field, 'type' AS rule FROM read WHERE o_orderstatus = 'O'
UNION ALL SELECT ticket_id, 'tags', 'type' FROM read WHERE o_orderpriority = '1-URGENT'"""
S["ticket_array_layout"] = """
SELECT CAST(c_custkey AS VARCHAR) AS ticket_id, c_name AS subject, c_mktsegment AS category, c_mktsegment AS tags FROM customer"""

S["json_props_extract"] = """
SELECT event_type, count(k) AS n, CAST(sum(k) AS BIGINT) AS sum_k, round(avg(k), 6) AS avg_k
FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events) GROUP BY event_type"""

S["union_splits"] = f"""
SELECT CASE WHEN role IN ('system', 'user', 'assistant') THEN role ELSE 'other' END AS split, conv_id,
  CASE WHEN role IS DISTINCT FROM 'system' THEN turn END AS turn, {digest('text')} FROM conversations"""

S["sample_ticket"] = f"""WITH {DOCUMENTS}
SELECT ticket_id, category, {digest('description')} FROM doc_tickets WHERE category = 'en'
ORDER BY ticket_id LIMIT 1 OFFSET 5"""

S["sample_ticket_random"] = f"""WITH {DOCUMENTS}
SELECT ticket_id, category FROM doc_tickets WHERE category = 'de' ORDER BY md5('7|' || ticket_id), ticket_id LIMIT 1"""

S["splits_roundtrip"] = f"WITH {SPLIT_DOCUMENTS} SELECT ticket_id, text_hash, split FROM split_docs"

S["metric_tables_roundtrip"] = """
WITH d AS (SELECT CAST(ts AS DATE) AS day, nullif(event_type, 'view') AS category,
  CASE event_type WHEN 'error' THEN 'n' WHEN 'click' THEN 'u' WHEN 'view' THEN 'x' ELSE 'p' END AS mood FROM events),
sizes AS (SELECT 'daily_total' AS "table", (SELECT count(*) FROM (SELECT DISTINCT day FROM d)) AS n_rows
  UNION ALL SELECT 'daily_by_category', (SELECT count(*) FROM (SELECT DISTINCT day, category FROM d))
  UNION ALL SELECT 'daily_sentiment', (SELECT count(*) FROM (SELECT DISTINCT day, mood FROM d))
  UNION ALL SELECT 'retrieval_daily', (SELECT count(*) FROM (SELECT DISTINCT day FROM d)))
SELECT "table", n_rows, (SELECT count(*) FROM events) AS tickets FROM sizes"""

S["csv_category_counts"] = f"""WITH {SPLIT_DOCUMENTS}
SELECT 'split' AS scope, split, category, count(*) AS n FROM split_docs GROUP BY split, category
UNION ALL SELECT 'all_splits', NULL, category, count(*) FROM split_docs GROUP BY category
UNION ALL SELECT 'split_total', split, NULL, count(*) FROM split_docs GROUP BY split"""

# ---- projections ------------------------------------------------------------------------------


def concat_statement(expression: str) -> str:
    return f"WITH {DOCUMENTS} SELECT ticket_id, {digest('t')} FROM (SELECT ticket_id, {expression} AS t FROM doc_tickets)"


def collapsed(c: str) -> str:
    return f"trim(regexp_replace({blank(c)}, '{WS}+', ' ', 'g'))"


S["text_concat_train"] = concat_statement(" || ' ' || ".join(blank(c) for c in TEXT))
S["text_concat_compact"] = concat_statement("concat_ws(' ', " + ", ".join(f"nullif({strip(blank(c))}, '')" for c in TEXT) + ")")
S["text_concat_separated"] = concat_statement(" || ' ' || chr(10) || ' ' || ".join(strip(blank(c)) for c in TEXT))
S["text_concat_normalized"] = concat_statement("concat_ws(' ', " + ", ".join(f"nullif({collapsed(c)}, '')" for c in TEXT) + ")")

S["content_fingerprint"] = f"WITH {DOCUMENTS} SELECT ticket_id, {FINGERPRINT} AS text_hash FROM doc_tickets"


def online_statement(binding: str, source: str, parts: list[str]) -> str:
    joined = " || chr(10) || ".join(parts)
    return f"""WITH {binding}, o AS (SELECT ticket_id, coalesce(nullif(product, ''), 'unknown') AS product,
  coalesce(nullif(customer_tier, ''), 'unknown') AS tier, {joined} AS t FROM {source})
SELECT ticket_id, product, tier, contains(t, 'ERROR_') OR contains(lower(t), ' error ') AS has_error_code,
  md5(t) AS text_hash FROM o"""


S["online_features"] = online_statement(DOCUMENTS, "doc_tickets", [blank(c) for c in TEXT])
S["online_features_events"] = online_statement(
    EVENTS, "event_tickets", ["subject", blank("description"), blank("error_logs"), "''"]
)
S["stream_online_features"] = S["online_features_events"]

S["sentiment_normalize"] = f"WITH {EVENTS} SELECT ticket_id, sentiment_norm FROM event_tickets"

S["sentiment_normalize_text"] = """
SELECT doc_id, CASE WHEN text IS NULL THEN 'unknown'
  WHEN contains(lower(text), 'frustrat') OR contains(lower(text), 'angry') OR contains(lower(text), 'upset')
    OR contains(lower(text), 'unhappy') THEN 'negative'
  WHEN contains(lower(text), 'happy') OR contains(lower(text), 'satisf') OR contains(lower(text), 'great')
    OR contains(lower(text), 'good') THEN 'positive' ELSE 'neutral' END AS sentiment_norm FROM documents"""


def any_word(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(h, '{w}')" for w in words) + ")"


HEADLINE = EVENTS + """, headline AS (
  SELECT ticket_id, contains_error_code, lower(subject || ' ' || coalesce(description, '')) AS h FROM event_tickets)"""

S["heuristic_tags_structured"] = f"""WITH {HEADLINE}
SELECT ticket_id, CASE WHEN {any_word(['error', 'fail', 'issue', 'crash', 'broken'])} THEN 'frustrated' ELSE 'neutral' END AS sentiment,
  CASE WHEN coalesce(contains_error_code, false) THEN 'high' ELSE 'medium' END AS priority FROM headline"""

S["heuristic_tags_text"] = f"""WITH {HEADLINE}
SELECT ticket_id, CASE WHEN {any_word(['error', 'fail', 'failing', 'issue', 'bug'])} THEN 'frustrated' ELSE 'neutral' END AS sentiment,
  CASE WHEN {any_word(['p0', 'critical', 'urgent', 'severe'])} THEN 'high' ELSE 'medium' END AS priority FROM headline"""

S["bool_num_coerce"] = f"""WITH {RAW_ORDERS}
SELECT ticket_id, CASE WHEN c_mktsegment = 'BUILDING' THEN 1.0::double END AS flag_or_null,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 1.0::double ELSE 0.0::double END AS flag,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN 0.0::double ELSE c_acctbal END AS hours FROM raw_tickets"""

S["timestamp_coerce_day"] = f"""WITH {RAW_ORDERS}
SELECT ticket_id, CASE WHEN created_state = 'ok' THEN strftime(o_orderdate, '%Y-%m-%d') END AS created_date,
  CASE WHEN created_state = 'ok' THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS created_at FROM raw_tickets"""

S["flatten_nested"] = "SELECT event_id, user_id, event_type, value FROM events"

S["retrieval_success_flag"] = f"WITH {EVENTS} SELECT ticket_id, n_helpful, 1 AS n_viewed, success FROM event_tickets"

KB = DOCUMENTS + f""",
kb AS (
  SELECT ticket_id AS doc_id, product, category, {blank('subcategory')} AS subcategory, {blank('resolution_code')} AS resolution_code,
    CASE WHEN resolution_helpful THEN 1.0::double ELSE 0.0::double END AS quality,
    {strip("subject || ' ' || product || ' ' || category || ' ' || " + blank('subcategory') + " || ' ' || tags || ' ' || "
           + blank('resolution_code') + " || ' ' || " + blank('articles') + " || ' ' || " + blank('resolution')
           + " || ' ' || description")} AS text
  FROM doc_tickets WHERE ticket_id <> '')"""

PREVIEW = """'[TITLE] ' || doc_id || chr(10) || '[PRODUCT] ' || product || chr(10) || '[CATEGORY] ' || category || '::'
  || subcategory || chr(10) || '[RES_CODE] ' || resolution_code"""
BLOCK = f"""'[DOC ' || doc_id || ']' || chr(10) || 'product=' || product || ' category=' || category || '::' || subcategory
  || chr(10) || 'resolution_code=' || resolution_code || ' quality=' || CASE quality WHEN 1.0 THEN '1.0' ELSE '0.0' END
  || chr(10) || '---' || chr(10) || {strip(PREVIEW)}"""

S["kb_project"] = f"WITH {KB} SELECT doc_id, product, category, subcategory, resolution_code, quality, {digest('text')} FROM kb"

S["query_text"] = f"""WITH {DOCUMENTS}, q AS (SELECT ticket_id, {strip(
    strip('subject') + " || ' ' || " + strip('product')
    + " || ' ' || CASE WHEN category <> 'en' THEN 'lang-' || category ELSE category END || ' ' || tags || ' ' || "
    + strip('description'))} AS t FROM doc_tickets) SELECT ticket_id, {digest('t')} FROM q"""

S["preview_text"] = f"WITH {KB} SELECT doc_id, {PREVIEW} AS preview FROM kb"
S["context_block"] = f"WITH {KB} SELECT doc_id, {BLOCK} AS block FROM kb"
S["solve_summary"] = f"""WITH {KB}
SELECT doc_id, CASE WHEN quality = 1.0 THEN 'Closest historical case: ' || doc_id || ' (' || category || '::' || subcategory
  || ') Resolution code: ' || resolution_code || ' Suggested next step: apply the known fix or verify the steps from the '
  || 'matched case; if it diverges, re-run retrieval with broader filters.'
  ELSE 'No close matches found; try broadening filters or escalate.' END AS summary FROM kb"""

S["category_normalize"] = """
SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN '<MISSING>' ELSE event_type END AS category FROM events"""

# ---- validation -------------------------------------------------------------------------------

S["schema_violations"] = f"""WITH {RAW_ORDERS}
SELECT ticket_id, 'subject' AS field, 'required' AS rule FROM raw_tickets WHERE subject IS NULL
UNION ALL SELECT ticket_id, 'created_at', 'required' FROM raw_tickets WHERE created_state IS NULL
UNION ALL SELECT ticket_id, 'created_at', 'type' FROM raw_tickets WHERE created_state = 'nope'
UNION ALL SELECT ticket_id, 'previous_tickets', 'min' FROM raw_tickets WHERE previous_tickets < 0
UNION ALL SELECT ticket_id, 'satisfaction_score', 'min' FROM raw_tickets WHERE satisfaction_score < 1
UNION ALL SELECT ticket_id, 'satisfaction_score', 'max' FROM raw_tickets WHERE satisfaction_score > 5
UNION ALL SELECT ticket_id, 'resolution_time_hours', 'type' FROM raw_tickets WHERE c_mktsegment = 'MACHINERY'
UNION ALL SELECT ticket_id, 'escalated', 'type' FROM raw_tickets WHERE c_mktsegment = 'FURNITURE'"""

SHIPMENT_CHECKS = SHIPMENTS + """,
checks AS (
  SELECT 'non_null:subject' AS "check", count(*) FILTER (subject IS NULL) AS bad_rows FROM shipments
  UNION ALL SELECT 'non_null:description', count(*) FILTER (description IS NULL) FROM shipments
  UNION ALL SELECT 'non_null:created_at', count(*) FILTER (created_at IS NULL) FROM shipments
  UNION ALL SELECT 'non_null:ticket_id', count(*) FILTER (ticket_id IS NULL) FROM shipments
  UNION ALL SELECT 'time_order:created_at<=updated_at', count(*) FILTER (created_at > updated_at) FROM shipments
  UNION ALL SELECT 'time_order:created_at<=resolved_at', count(*) FILTER (created_at > resolved_at) FROM shipments
  UNION ALL SELECT 'range:satisfaction_score_1_to_5', count(*) FILTER (satisfaction_score NOT BETWEEN 1 AND 5) FROM shipments)"""

S["dq_checks"] = f"""WITH {SHIPMENT_CHECKS}
SELECT "check", bad_rows, bad_rows = 0 AS passed, NULL::VARCHAR AS error FROM checks"""

S["dq_checks_missing_column"] = f"""WITH {ORDERS}
SELECT 'non_null:subject' AS "check", NULL::BIGINT AS bad_rows, false AS passed, 'missing_column' AS error
UNION ALL SELECT 'non_null:description', NULL, false, 'missing_column'
UNION ALL SELECT 'non_null:created_at', count(*) FILTER (created_at IS NULL), count(*) FILTER (created_at IS NULL) = 0, NULL
  FROM order_tickets
UNION ALL SELECT 'non_null:ticket_id', count(*) FILTER (ticket_id IS NULL), count(*) FILTER (ticket_id IS NULL) = 0, NULL
  FROM order_tickets"""

S["dq_report"] = f"""WITH {SHIPMENT_CHECKS}
SELECT bool_and(bad_rows = 0) AS success, (SELECT count(*) FROM shipments) AS row_count, count(*) AS n_checks FROM checks"""

S["quality_gate"] = f"SELECT *, NOT success AS stopped FROM ({S['dq_report']})"

_PROFILE_NULLABLE = ["subcategory", "error_logs", "stack_trace", "customer_tier", "resolution_code", "resolution", "resolution_helpful"]
S["split_profile"] = f"""WITH {SPLIT_DOCUMENTS},
profile AS (
  SELECT split, 'n_rows' AS metric, '' AS name, count(*) AS value FROM split_docs GROUP BY split
  UNION ALL SELECT split, 'n_cols', '', 17 FROM split_docs GROUP BY split
  UNION ALL SELECT split, 'missing_column', 'created_at', 1 FROM split_docs GROUP BY split
  UNION ALL SELECT split, 'null_count', 'kb_articles_viewed', count(*) FILTER (stack_trace IS NULL AND resolution_code IS NULL AND error_logs IS NULL) FROM split_docs GROUP BY split
  UNION ALL SELECT split, 'null_count', 'kb_articles_helpful', count(*) FILTER (subcategory IS NULL) FROM split_docs GROUP BY split
  {' '.join(f"UNION ALL SELECT split, 'null_count', '{c}', count(*) FILTER ({c} IS NULL) FROM split_docs GROUP BY split" for c in _PROFILE_NULLABLE)})
SELECT * FROM profile WHERE metric <> 'null_count' OR value > 0"""

S["category_frequency"] = f"""WITH {SPLIT_DOCUMENTS}
SELECT split, subcategory, count(*) AS n FROM split_docs WHERE subcategory IS NOT NULL GROUP BY split, subcategory"""

# ---- aggregations -----------------------------------------------------------------------------

DAY = "CAST(CAST(created_at AS DATE) AS VARCHAR) AS created_date"

S["daily_total"] = f"WITH {ORDERS} SELECT {DAY}, count(*) AS count FROM order_tickets GROUP BY 1"
S["daily_by_category"] = f"WITH {EVENTS} SELECT {DAY}, category, count(*) AS count FROM event_tickets GROUP BY 1, 2"
S["stream_daily_counts"] = """
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS created_date, event_type AS category, count(*) AS count FROM events GROUP BY 1, 2"""
S["stream_closing_days"] = """
SELECT CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(CAST(ts AS DATE) AS VARCHAR) END AS created_date, event_type AS category,
  count(*) AS count FROM events GROUP BY 1, 2"""
S["daily_sentiment"] = f"WITH {EVENTS} SELECT {DAY}, sentiment_norm, count(*) AS count FROM event_tickets GROUP BY 1, 2"
S["retrieval_daily"] = f"""WITH {EVENTS}
SELECT {DAY}, count(*) AS total, CAST(sum(success) AS BIGINT) AS success, CAST(count(*) - sum(success) AS BIGINT) AS failure,
  round((count(*) - sum(success))::double / count(*), 6) AS failure_rate FROM event_tickets GROUP BY 1"""

COUNTS = ORDERS + """,
by_split AS (SELECT coalesce(subcategory, 'none') AS split, category, count(*) AS n FROM order_tickets GROUP BY 1, 2),
levels AS (
  SELECT 'split' AS scope, split, category, n FROM by_split
  UNION ALL SELECT 'all_splits', NULL, category, CAST(sum(n) AS BIGINT) FROM by_split GROUP BY category
  UNION ALL SELECT 'split_total', split, NULL, CAST(sum(n) AS BIGINT) FROM by_split GROUP BY split)"""
S["category_counts"] = f"WITH {COUNTS} SELECT * FROM levels"
S["category_counts_top"] = f"""WITH {COUNTS}
SELECT * FROM levels QUALIFY row_number() OVER (PARTITION BY scope, split ORDER BY n DESC, category) <= 2"""

S["class_weights"] = """
WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label)
SELECT CAST(label AS BIGINT) AS label, n, round((1.0::double / n) / (SELECT avg(1.0::double / n) FROM c), 6) AS weight FROM c"""
S["class_weights_per_row"] = f"""WITH {EVENTS}, c AS (SELECT category, count(*) AS n FROM event_tickets GROUP BY category)
SELECT t.ticket_id, t.category, round((1.0::double / n) / (SELECT avg(1.0::double / n) FROM c), 6) AS weight
FROM event_tickets t JOIN c ON t.category IS NOT DISTINCT FROM c.category"""


def overlap(scheme: str, key: str) -> str:
    return f"""SELECT '{scheme}' AS scheme,
  {', '.join(f"(SELECT count(DISTINCT text_hash) FROM {scheme} WHERE split = '{s}') AS n_{s}" for s in ('train', 'val', 'test'))},
  {', '.join(f"(SELECT count(*) FROM (SELECT text_hash FROM {scheme} WHERE split = '{a}' INTERSECT SELECT text_hash FROM {scheme} WHERE split = '{b}')) AS {a}_{b}" for a, b in (('train', 'val'), ('train', 'test'), ('val', 'test')))}"""


S["leakage_overlap"] = f"""WITH {DOCUMENTS},
hashed AS (SELECT *, {FINGERPRINT} AS text_hash FROM doc_tickets),
by_id AS (SELECT text_hash, {split_case('ticket_id')} AS split FROM hashed),
by_content AS (SELECT text_hash, {split_case('text_hash')} AS split FROM hashed)
{overlap('by_id', 'ticket_id')} UNION ALL {overlap('by_content', 'text_hash')}"""

S["split_sizes"] = f"WITH {SPLIT_DOCUMENTS} SELECT split, count(*) AS n FROM split_docs GROUP BY split"

GUESSES = """
g AS (SELECT l_returnflag AS y, CASE WHEN l_quantity < 20 THEN 'A' WHEN l_quantity < 35 THEN 'N' ELSE 'X' END AS guess FROM lineitem)"""
S["confusion_matrix"] = f"WITH {GUESSES} SELECT y AS actual, guess AS predicted, count(*) AS n FROM g GROUP BY 1, 2"
S["confusion_matrix_dense"] = f"""WITH {GUESSES}
SELECT y AS actual, {', '.join(f"count(*) FILTER (guess = '{c}') AS {c!s}".replace(f"AS {c}", f'AS "{c}"') for c in 'ANRX')} FROM g GROUP BY 1"""

SCORES = GUESSES + """,
labels_seen AS (SELECT y AS label FROM g UNION SELECT guess FROM g),
per_class AS (
  SELECT label, (SELECT count(*) FROM g WHERE y = label) AS support, (SELECT count(*) FROM g WHERE guess = label) AS chosen,
    (SELECT count(*) FROM g WHERE y = label AND guess = label) AS hits FROM labels_seen),
rates AS (
  SELECT label, support, coalesce(hits / nullif(chosen, 0)::double, 0) AS p, coalesce(hits / nullif(support, 0)::double, 0) AS r,
    hits FROM per_class),
scored AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f FROM rates),
acc AS (SELECT sum(hits) / sum(support)::double AS a, CAST(sum(support) AS BIGINT) AS n FROM rates)"""
S["classification_report"] = f"""WITH {SCORES}
SELECT label, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, support FROM scored
UNION ALL SELECT 'accuracy', round(a, 6), round(a, 6), round(a, 6), n FROM acc
UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), CAST(sum(support) AS BIGINT) FROM scored
UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6),
  round(sum(f * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM scored"""
S["f1_weighted"] = f"""WITH {SCORES}
SELECT round(sum(f * support) / sum(support), 6) AS f1_weighted, round((SELECT a FROM acc), 6) AS accuracy FROM scored"""

# ---- time series ------------------------------------------------------------------------------


def series(prefix: str, daily: str) -> str:
    """CTEs: daily (key, day, value) filled up to a daily grid per key."""
    return f"""
{prefix}_daily AS ({daily}),
{prefix}_grid AS (
  SELECT key, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day
  FROM {prefix}_daily WHERE day IS NOT NULL GROUP BY key),
{prefix}_series AS (
  SELECT g.key, g.day, CASE WHEN d.day IS NULL THEN 0.0::double ELSE d.value END AS value
  FROM {prefix}_grid g LEFT JOIN {prefix}_daily d ON g.key IS NOT DISTINCT FROM d.key AND g.day = d.day)"""


def scored(prefix: str, z: float, window: int = 14) -> str:
    return f"""
{prefix}_stats AS (
  SELECT key, day, value, count(value) OVER w AS n, avg(value) OVER w AS m, nullif(stddev_pop(value) OVER w, 0) AS s
  FROM {prefix}_series WINDOW w AS (PARTITION BY key ORDER BY day ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW)),
{prefix}_scored AS (
  SELECT key, day, value, CASE WHEN n >= {max(3, window // 2)} THEN m END AS rolling_mean,
    CASE WHEN n >= {max(3, window // 2)} THEN s END AS rolling_std,
    CASE WHEN n >= {max(3, window // 2)} THEN (value - m) / s END AS zscore,
    coalesce(CASE WHEN n >= {max(3, window // 2)} THEN (value - m) / s END > {z}, false) AS is_anomaly FROM {prefix}_stats)"""


def daily_of(source: str, key: str, value: str = "count(*)::double") -> str:
    return f"SELECT {key} AS key, CAST(created_at AS DATE) AS day, {value} AS value FROM {source} GROUP BY 1, 2"


RATE = "(count(*) - sum(success))::double / count(*)"
SHOWN = """CAST(day AS VARCHAR) AS date, {value} AS value, round(rolling_mean, 6) AS rolling_mean,
  round(rolling_std, 6) AS rolling_std, round(zscore, 6) AS zscore, is_anomaly"""


def spike_statement(binding: str, source: str, key: str, z: float, window: int = 14, name: str | None = None) -> str:
    columns = (f"key AS {name}, " if name else "") + SHOWN.format(value="value")
    return f"WITH {binding}, {series('x', daily_of(source, key))}, {scored('x', z, window)} SELECT {columns} FROM x_scored"


S["densify_daily"] = f"""WITH {ORDERS}, {series('x', daily_of('order_tickets', 'category'))}
SELECT key AS category, CAST(day AS VARCHAR) AS date, value FROM x_series"""
S["volume_spikes"] = spike_statement(ORDERS, "order_tickets", "1", 2.0)
S["category_spikes"] = spike_statement(EVENTS, "event_tickets", "category", 2.0, 14, "category")
S["sentiment_shift"] = spike_statement(EVENTS, "event_tickets", "sentiment_norm", 2.0, 7, "sentiment_norm")

S["retrieval_failure"] = f"""WITH {EVENTS}, {series('x', daily_of('event_tickets', '1', RATE))}, {scored('x', 3.0)}
SELECT CAST(day AS VARCHAR) AS date, round(value, 6) AS failure_rate, round(rolling_mean, 6) AS rolling_mean,
  round(zscore, 6) AS zscore, value >= 0.6 AS hard_flag, is_anomaly AS soft_flag, value >= 0.6 OR is_anomaly AS is_anomaly
FROM x_scored"""

S["json_report_roundtrip"] = f"""WITH {EVENTS}, {series('x', daily_of('event_tickets', '1'))}, {scored('x', 2.0)}
SELECT CAST(day AS VARCHAR) AS date, value, round(rolling_mean, 6) AS rolling_mean,
  CASE WHEN zscore > 0 THEN round(zscore, 6) END AS zscore, is_anomaly FROM x_scored"""


def scan_statement(binding: str, source: str, z: float, rate: float) -> str:
    parts = {"v": ("1", "count(*)::double"), "c": ("category", "count(*)::double"), "s": ("sentiment_norm", "count(*)::double"),
             "r": ("1", RATE)}
    ctes = ", ".join(
        f"{series(p, daily_of(source, key, value))}, {scored(p, 3.0 if p == 'r' else z)}" for p, (key, value) in parts.items()
    )
    shown = SHOWN.format(value="round(value, 6)")
    return f"""WITH {binding}, {ctes}
SELECT 'volume_spikes' AS scan, NULL AS key, {shown} FROM v_scored
UNION ALL SELECT 'category_spikes', key, {shown} FROM c_scored
UNION ALL SELECT 'sentiment_shift', key, {shown} FROM s_scored
UNION ALL SELECT 'retrieval_failure', NULL, CAST(day AS VARCHAR), round(value, 6), round(rolling_mean, 6), NULL,
  round(zscore, 6), value >= {rate} OR is_anomaly FROM r_scored"""


S["anomaly_scan"] = scan_statement(EVENTS, "event_tickets", 2.0, 0.1)
S["anomaly_report"] = f"""
SELECT scan AS section, key, date, value, rolling_mean, rolling_std, zscore, is_anomaly, CAST(NULL AS BIGINT) AS "window",
  NULL::double AS z_threshold, NULL::double AS failure_threshold FROM ({S["anomaly_scan"]})
UNION ALL SELECT 'params', NULL, NULL, NULL, NULL, NULL, NULL, NULL, 14, 2.0::double, 0.1::double"""
S["anomaly_scan_defaults"] = scan_statement(ORDERS, "order_tickets", 3.0, 0.1)

# ---- splits -----------------------------------------------------------------------------------

S["grouped_split"] = f"WITH {SPLIT_DOCUMENTS} SELECT ticket_id, text_hash, split FROM split_docs"

S["grouped_split_exact"] = f"""WITH {DOCUMENTS}, hashed AS (SELECT ticket_id, {FINGERPRINT} AS text_hash FROM doc_tickets),
g AS (SELECT DISTINCT text_hash FROM hashed),
first_draw AS (SELECT text_hash, row_number() OVER (ORDER BY md5('42|' || text_hash)) AS r, count(*) OVER () AS n FROM g),
rest AS (SELECT text_hash, row_number() OVER (ORDER BY md5('43|' || text_hash)) AS r, count(*) OVER () AS n FROM first_draw
  WHERE r > floor(n * 0.7::double)),
assigned AS (
  SELECT text_hash, 'train' AS split FROM first_draw WHERE r <= floor(n * 0.7::double)
  UNION ALL SELECT text_hash, CASE WHEN r <= floor(n * 0.5::double) THEN 'val' ELSE 'test' END FROM rest)
SELECT ticket_id, text_hash, split FROM hashed JOIN assigned USING (text_hash)"""

S["stratified_temporal_split"] = f"""WITH {ORDERS}, placed AS (
  SELECT *, row_number() OVER (PARTITION BY category, subcategory
      ORDER BY created_at ASC NULLS FIRST, substr(md5(ticket_id), 1, 8), ticket_id) AS r,
    count(*) OVER (PARTITION BY category, subcategory) AS n FROM order_tickets)
SELECT ticket_id, category, subcategory, CASE WHEN r <= floor(n * 0.7::double) THEN 'train'
  WHEN r <= floor(n * 0.7::double) + floor(n * 0.15::double) THEN 'val' ELSE 'test' END AS split FROM placed"""

S["sample_train_cap"] = f"""WITH {DOCUMENTS}
SELECT ticket_id, category FROM doc_tickets ORDER BY md5('42|' || ticket_id), ticket_id LIMIT 200"""
S["head_train_cap"] = f"WITH {DOCUMENTS} SELECT ticket_id, category FROM doc_tickets ORDER BY ticket_id LIMIT 200"

S["label_shuffle"] = """
WITH takers AS (SELECT vec_id, label, row_number() OVER (ORDER BY md5('42-to|' || vec_id)) AS r FROM embeddings),
givers AS (SELECT label AS shuffled, row_number() OVER (ORDER BY md5('42-from|' || vec_id)) AS r FROM embeddings)
SELECT vec_id, CAST(label AS BIGINT) AS label, CAST(shuffled AS BIGINT) AS shuffled FROM takers JOIN givers USING (r)"""

# ---- features ---------------------------------------------------------------------------------


def words(source: str, key: str) -> str:
    return f"words AS (SELECT {key} AS id, regexp_extract_all(lower(text), '{TOKEN}') AS w FROM {source})"


TERMS = """
terms AS (
  SELECT id, unnest(w) AS term FROM words
  UNION ALL SELECT id, unnest(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) FROM words
    WHERE len(w) > 1),
tf AS (SELECT id, term, count(*) AS tf FROM terms GROUP BY id, term)"""


def vocab(min_df: int, max_features: int) -> str:
    return f"""
vocab AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total FROM tf GROUP BY term HAVING count(*) >= {min_df}
  ORDER BY total DESC, term LIMIT {max_features})"""


def idf(source: str) -> str:
    return f"ln((1.0::double + (SELECT count(*) FROM {source})) / (1.0::double + df)) + 1.0::double"


def weights(source: str, sublinear: bool) -> str:
    tf = "(1.0::double + ln(tf))" if sublinear else "tf"
    return f"""
raw AS (SELECT id, term, {tf} * ({idf(source)}) AS x FROM tf JOIN vocab USING (term)),
weights AS (SELECT id, term, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS weight FROM raw)"""


S["tokenize"] = f"""WITH {words('documents', 'doc_id')}
SELECT id AS doc_id, len(w) AS n_tokens, md5(coalesce(array_to_string(w, ' '), '')) AS tokens_md5 FROM words"""
S["ngrams"] = f"""WITH {words('documents', 'doc_id')}, g AS (
  SELECT id, list_concat(w, CASE WHEN len(w) > 1 THEN list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])
    ELSE [] END) AS t FROM words)
SELECT id AS doc_id, len(t) AS n_terms, md5(coalesce(array_to_string(t, '|'), '')) AS terms_md5 FROM g"""
S["vocabulary"] = f"WITH {words('documents', 'doc_id')}, {TERMS}, {vocab(2, 20000)} SELECT term, df, total FROM vocab"
S["idf"] = f"""WITH {words('documents', 'doc_id')}, {TERMS}, {vocab(2, 20000)}
SELECT term, df, round({idf('documents')}, 6) AS idf FROM vocab"""


def tfidf_statement(min_df: int, max_features: int, sublinear: bool) -> str:
    return f"""WITH {words('documents', 'doc_id')}, {TERMS}, {vocab(min_df, max_features)}, {weights('documents', sublinear)}
SELECT id AS doc_id, term, round(weight, 6) AS weight FROM weights"""


S["tfidf"] = tfidf_statement(2, 20000, False)
S["tfidf_sublinear"] = tfidf_statement(3, 120000, True)
S["tfidf_network"] = tfidf_statement(2, 50000, False)

TRAIN_TEXT = " || ' ' || ".join(blank(c) for c in TEXT)
S["assembled_features"] = f"""WITH {SPLIT_DOCUMENTS},
train AS (SELECT * FROM split_docs WHERE split = 'train'), joined AS (SELECT ticket_id, split, {TRAIN_TEXT} AS t FROM split_docs),
words AS (SELECT ticket_id AS id, split = 'train' AS fits, regexp_extract_all(lower(t), '{TOKEN}') AS w FROM joined),
terms AS (
  SELECT id, fits, unnest(w) AS term FROM words
  UNION ALL SELECT id, fits, unnest(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) FROM words
    WHERE len(w) > 1),
every_tf AS (SELECT id, fits, term, count(*) AS tf FROM terms GROUP BY ALL),
vocab AS (SELECT term, count(*) AS df, sum(tf) AS total FROM every_tf WHERE fits GROUP BY term HAVING count(*) >= 3
  ORDER BY total DESC, term LIMIT 120000),
tf AS (SELECT id, term, tf FROM every_tf), {weights('train', True).split('vocab AS')[0].strip()},
per_text AS (SELECT id, count(*) AS n, sum(weight) AS x FROM weights GROUP BY id),
deviation AS (SELECT stddev_pop(ticket_text_length) AS s FROM train),
rest AS (SELECT ticket_id, coalesce(ticket_text_length / CASE WHEN s > 0 THEN s ELSE 1 END, 0.0::double) AS size,
  CASE WHEN coalesce(product, '<null>') IN (SELECT coalesce(product, '<null>') FROM train) THEN 1 ELSE 0 END
  + CASE WHEN coalesce(customer_tier, '<null>') IN (SELECT coalesce(customer_tier, '<null>') FROM train) THEN 1 ELSE 0 END AS hot
  FROM split_docs, deviation)
SELECT ticket_id, CAST(coalesce(n, 0) + hot + CASE WHEN size <> 0 THEN 1 ELSE 0 END AS BIGINT) AS n_set,
  round(coalesce(x, 0) + hot + size, 6) AS total FROM rest LEFT JOIN per_text ON id = ticket_id"""
S["stored_model_scores"] = f"WITH {DOCUMENTS} SELECT ticket_id, true AS same FROM doc_tickets"
S["retrieval_envelope"] = f"""WITH {DOCUMENTS}
SELECT ticket_id, true AS known, true AS confident, CAST(5 AS BIGINT) AS n_results, true AS ranked, true AS of_category FROM doc_tickets"""

_HOT = ["product", "category", "customer_tier", "subcategory"]
S["one_hot_long"] = f"""WITH {SPLIT_DOCUMENTS}, train AS (SELECT * FROM split_docs WHERE split = 'train' AND product <> 'src7'),
{', '.join(f"seen_{c} AS (SELECT DISTINCT {c} AS v FROM train)" for c in _HOT)}
{' UNION ALL '.join(f"SELECT ticket_id, '{c}=' || coalesce({c}, '<null>') AS feature, 1.0::double AS value FROM split_docs JOIN seen_{c} ON {c} IS NOT DISTINCT FROM v" for c in _HOT)}"""

S["scale_numeric"] = """
WITH o AS (SELECT o_orderkey, o_totalprice, nullif(o_custkey, 1) AS o_custkey FROM orders),
d AS (SELECT stddev_pop(o_totalprice) AS a, stddev_pop(o_custkey) AS b FROM o)
SELECT o_orderkey, round(o_totalprice / a, 6) AS o_totalprice, round(o_custkey / b, 6) AS o_custkey, 3.0::double AS constant FROM o, d"""

S["label_encode"] = f"""WITH {SPLIT_DOCUMENTS},
cat AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS code FROM (SELECT DISTINCT coalesce(category, 'unknown') AS c FROM split_docs WHERE split = 'train')),
sub AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS code FROM (SELECT DISTINCT coalesce(subcategory, 'unknown') AS c FROM split_docs WHERE split = 'train'))
SELECT ticket_id, cat.code AS category_code, sub.code AS subcategory_code, cat.c AS decoded FROM split_docs
JOIN cat ON coalesce(category, 'unknown') = cat.c JOIN sub ON coalesce(subcategory, 'unknown') = sub.c"""

_CODES = ", ".join(
    f"{t} AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS code FROM (SELECT DISTINCT coalesce({c}, 'unknown') AS c FROM split_docs WHERE split = 'train'))"
    for t, c in (("cat", "category"), ("sub", "subcategory"))
)
S["feature_tables"] = f"""WITH {SPLIT_DOCUMENTS}, {_CODES}
SELECT split, cat.code AS y_category, sub.code AS y_subcategory, count(*) AS n FROM split_docs
JOIN cat ON coalesce(category, 'unknown') = cat.c JOIN sub ON coalesce(subcategory, 'unknown') = sub.c GROUP BY ALL"""

S["feature_metadata"] = f"""WITH {SPLIT_DOCUMENTS}
SELECT split, count(*) AS n_rows, count(DISTINCT coalesce(category, 'unknown')) AS n_category,
  count(DISTINCT coalesce(subcategory, 'unknown')) AS n_subcategory FROM split_docs GROUP BY split"""

S["center_scale"] = """
WITH long AS (SELECT vec_id, unnest(embedding)::double AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings),
stats AS (SELECT pos, avg(x) AS m, stddev_pop(x) AS s FROM long GROUP BY pos)
SELECT vec_id, pos, round((x - m) / CASE WHEN s = 0 THEN 1 ELSE s END, 5) AS x FROM long JOIN stats USING (pos)"""

# ---- knowledge base ---------------------------------------------------------------------------

KB_INDEX = f"{KB}, {words('kb', 'doc_id')}, {TERMS}, {vocab(2, 20000)}, {weights('kb', False)}"
QUERIES = f"""
q AS (
  SELECT 'b' || item_id AS query_id, 'en' AS category, text FROM benchmark
  UNION ALL SELECT 'c-' || conv_id || '-' || turn, CASE role WHEN 'user' THEN 'fr' WHEN 'assistant' THEN 'de' ELSE 'none' END, text
  FROM conversations),
qwords AS (SELECT query_id AS id, regexp_extract_all(lower(text), '{TOKEN}') AS w FROM q),
{TERMS.replace('FROM words', 'FROM qwords').replace('terms AS', 'qterms AS').replace('FROM terms', 'FROM qterms').replace('tf AS (', 'qtf AS (')},
qraw AS (SELECT id, term, tf * ({idf('kb')}) AS x FROM qtf JOIN vocab USING (term)),
qweights AS (SELECT id, term, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS weight FROM qraw)"""

RANKED = f"""{KB_INDEX}, {QUERIES},
dots AS (SELECT qw.id AS query_id, dw.id AS doc_id, sum(qw.weight * dw.weight) AS score
  FROM qweights qw JOIN weights dw USING (term) GROUP BY 1, 2),
candidates AS (
  SELECT query_id, doc_id FROM q JOIN kb ON kb.category = q.category
  UNION ALL SELECT query_id, doc_id FROM q, kb WHERE q.category NOT IN (SELECT category FROM kb)),
ranked AS (
  SELECT query_id, doc_id, coalesce(score, 0) AS score,
    row_number() OVER (PARTITION BY query_id ORDER BY round(coalesce(score, 0), 9) DESC, doc_id) AS rank
  FROM candidates LEFT JOIN dots USING (query_id, doc_id))"""

S["kb_index"] = f"WITH {KB_INDEX} SELECT id AS doc_id, term, round(weight, 6) AS weight FROM weights"
S["query_vectors"] = f"WITH {KB_INDEX}, {QUERIES} SELECT id AS query_id, term, round(weight, 6) AS weight FROM qweights"
S["retrieve_topk"] = f"""WITH {RANKED}
SELECT query_id, rank, doc_id, round(score, 6) AS score, kb.category, product, quality, {PREVIEW} AS preview
FROM ranked JOIN kb USING (doc_id) WHERE rank <= 5"""
S["retrieval_context"] = f"""WITH {RANKED}, blocks AS (SELECT query_id, rank, {BLOCK} AS block FROM ranked JOIN kb USING (doc_id) WHERE rank <= 3)
SELECT query_id, string_agg(block, chr(10) || chr(10) ORDER BY rank) AS context FROM blocks GROUP BY query_id"""

_NODES = [("PRODUCT", "product"), ("CATEGORY", "category"), ("SUBCATEGORY", "subcategory"), ("RESCODE", "resolution_code"), ("DOC", "doc_id")]
PARTS = """
part_docs AS (
  SELECT CAST(p_partkey AS VARCHAR) AS doc_id, p_brand AS product, p_type AS category,
    coalesce(nullif(CAST(p_size AS VARCHAR), '1'), '') AS subcategory, coalesce(nullif(l_returnflag, 'N'), '') AS resolution_code
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
S["graph_nodes"] = f"WITH {PARTS} " + " UNION ".join(f"SELECT '{k}::' || {c} AS node, '{k}' AS kind FROM part_docs" for k, c in _NODES)
S["graph_edges"] = f"""WITH {PARTS}
SELECT 'PRODUCT::' || product AS src, 'CATEGORY::' || category AS dst FROM part_docs
UNION SELECT 'CATEGORY::' || category, 'SUBCATEGORY::' || subcategory FROM part_docs
UNION SELECT 'DOC::' || doc_id, 'SUBCATEGORY::' || subcategory FROM part_docs
UNION SELECT 'DOC::' || doc_id, 'RESCODE::' || resolution_code FROM part_docs
UNION SELECT 'DOC::' || doc_id, 'PRODUCT::' || product FROM part_docs"""

# ---- run log and registry ---------------------------------------------------------------------

S["run_summary"] = f"""WITH {RUNS}
SELECT run_id, "when", component, status, val_f1_weighted, NULL::VARCHAR AS test_f1_weighted, max_depth, epochs FROM runs"""
S["run_log_append"] = S["run_summary"]
S["recent_runs"] = f"""WITH {RUNS}
SELECT run_id, "when", component, val_f1_weighted FROM runs ORDER BY "when" DESC, run_id LIMIT 10"""
S["run_log_roundtrip"] = f"""WITH {RUNS}
SELECT run_id, "when", component, status, val_f1_weighted, max_depth, epochs FROM runs WHERE status <> 'failed'
UNION ALL SELECT NULL, NULL, NULL, 'malformed', NULL, NULL, NULL FROM runs WHERE status = 'failed'"""


def state(archiving: str) -> str:
    return f"""{REGISTRY}, entries AS (SELECT * FROM log WHERE is_register),
relevant AS (
  SELECT e.seq AS entry, e.name, e.version, e.created_at, e.seq AS moment, e.stage AS stage, true AS own FROM entries e
  UNION ALL SELECT e.seq, e.name, e.version, e.created_at, p.seq, p.stage, p.version = e.version
  FROM entries e JOIN log p ON p.name = e.name AND NOT p.is_register AND p.seq > e.seq
  WHERE p.version = e.version OR {archiving}),
last_own AS (SELECT entry, name, version, created_at, max(moment) AS moment, arg_max(stage, moment) AS stage FROM relevant WHERE own GROUP BY ALL),
state AS (
  SELECT o.name, o.version, o.created_at, CASE WHEN o.stage = 'Production' AND EXISTS (
    SELECT 1 FROM relevant r WHERE r.entry = o.entry AND NOT r.own AND r.moment > o.moment) THEN 'Archived' ELSE o.stage END AS stage
  FROM last_own o)"""


PRODUCTION_ONLY = "p.stage = 'Production'"
S["registry_state"] = f"WITH {state(PRODUCTION_ONLY)} SELECT name, version, created_at, stage FROM state"
S["registry_state_archive_any"] = f"WITH {state('true')} SELECT name, version, created_at, stage FROM state"
S["latest_production"] = f"""WITH {state(PRODUCTION_ONLY)}
SELECT name, version, created_at FROM state WHERE stage = 'Production'
QUALIFY row_number() OVER (PARTITION BY name ORDER BY created_at DESC, version DESC) = 1"""
S["registry_pointer"] = f"""WITH {REGISTRY}
SELECT name, version FROM log WHERE name IN (SELECT name FROM log WHERE is_register)
QUALIFY row_number() OVER (PARTITION BY name ORDER BY seq DESC) = 1"""

STATEMENTS = S
