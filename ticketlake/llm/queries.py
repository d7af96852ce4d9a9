"""The corpus operators over the test tables, and their reference SQL for DuckDB where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ticketlake.llm import (
    collocations, decontamination, embeddings, html_text, licences, minhash, packing, prefix_trie, quality, residual_packing,
    secret_scan, toxicity, warc,
)
from ticketlake.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
STATEMENTS: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_minhash_dedup(spark, sf):
    return minhash.near_duplicates(table(spark, sf, "documents"))


STATEMENTS["op1_minhash_dedup"] = r"""
WITH RECURSIVE lists AS (
    SELECT doc_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
    FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, unnest(CASE
        WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
    FROM lists
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
    FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
    SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)
), steps AS (SELECT a AS u, b AS v FROM links UNION ALL SELECT b, a FROM links
), walk AS (
    SELECT u, v FROM steps UNION SELECT walk.u, steps.v FROM walk JOIN steps ON walk.v = steps.u
), least AS (SELECT u, min(v) AS v FROM walk GROUP BY u)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(v, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(v, d.doc_id)) AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN least ON u = d.doc_id
"""


@query
def op7_warc(spark, sf):
    read = warc.archive_round_trip(spark, table(spark, sf, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


STATEMENTS["op7_warc"] = r"""
WITH hashed AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), bits AS (
    SELECT *, list_reduce(list_prepend('', list_transform(range(1, 41), lambda i:
        lpad(bin(instr('0123456789abcdef', substr(hex, i, 1)) - 1), 4, '0'))), lambda a, b: a || b) AS b FROM hashed
), coded AS (
    SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * substr(b, 5 * i + 1, 1)::INT + 8 * substr(b, 5 * i + 2, 1)::INT
            + 4 * substr(b, 5 * i + 3, 1)::INT + 2 * substr(b, 5 * i + 4, 1)::INT + substr(b, 5 * i + 5, 1)::INT, 1)), '') AS payload_digest
    FROM bits
), firsts AS (SELECT payload_digest, min(page_id) AS first FROM coded GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM coded JOIN firsts USING (payload_digest)
"""


@query
def op8_embedding_dedup(spark, sf):
    return embeddings.near_vectors(table(spark, sf, "embeddings"))


STATEMENTS["op8_embedding_dedup"] = """
WITH RECURSIVE usable AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), steps AS (
    SELECT a.vec_id AS u, b.vec_id AS v FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    WHERE list_cosine_similarity(a.v, b.v) >= 0.98
), walk AS (SELECT u, v FROM steps UNION SELECT walk.u, steps.v FROM walk JOIN steps ON walk.v = steps.u
), least AS (SELECT u, min(v) AS v FROM walk GROUP BY u
), counts AS (SELECT u, count(*) AS n FROM steps GROUP BY u)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(least.v, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(least.v, vec_id)) AS kept
FROM embeddings LEFT JOIN least ON least.u = vec_id LEFT JOIN counts ON counts.u = vec_id
"""


@query
def op3_packing(spark, sf):
    pieces = packing.pack_documents(table(spark, sf, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op5_license_scan(spark, sf):
    return licences.scan_licences(table(spark, sf, "documents"))


@query
def op9_decontamination(spark, sf):
    return decontamination.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query
def op4_toxicity(spark, sf):
    scored = toxicity.score_toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted", "nearest", "matched")


@query
def op6_quality(spark, sf):
    scored = quality.score_quality(table(spark, sf, "documents"), table(spark, sf, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


@query
def op2_html_extraction(spark, sf):
    return html_text.extract_text(table(spark, sf, "pages"))


@query
def op10_secret_scan(spark, sf):
    found = secret_scan.scan_secrets(table(spark, sf, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "learned")
    many = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(
        "doc_id", many("assign"), many("access"), many("hex"), F.sha2(secret_scan.joined(base), 256).alias("base_sha256"),
        secret_scan.joined("spans").alias("spans"),
    )


@query
def op11_residual_packing(spark, sf):
    pieces = residual_packing.pack_best_fit(table(spark, sf, "documents"))
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


@query
def op12_prefix_trie(spark, sf):
    return prefix_trie.prefix_trie(table(spark, sf, "conversations"))


# DuckDB has no crc32: it is built bit by bit from its polynomial.
STATEMENTS["op12_prefix_trie"] = r"""
WITH RECURSIVE turns AS (
    SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
               sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS i
    FROM conversations WHERE conv_id IS NOT NULL
), crc AS (
    SELECT DISTINCT c, c::VARCHAR AS s, 1 AS pos, 0 AS bit, xor(4294967295, ascii(substr(c::VARCHAR, 1, 1))::BIGINT) AS v FROM turns
    UNION ALL
    SELECT c, s, CASE WHEN bit = 7 THEN pos + 1 ELSE pos END, (bit + 1) % 8,
           xor(xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END),
               CASE WHEN bit = 7 AND pos < length(s) THEN ascii(substr(s, pos + 1, 1))::BIGINT ELSE 0 END)
    FROM crc WHERE pos <= length(s)
), heads AS (SELECT c, xor(v, 4294967295) % 9 AS h FROM crc WHERE pos > length(s)
), rebuilt AS (
    SELECT heads.c, 0 AS own, t.i, role, text FROM heads JOIN turns t ON t.c = heads.c - heads.c % 5 AND t.i < h
    UNION ALL SELECT heads.c, 1, t.i, role, text FROM heads JOIN turns t ON t.c = heads.c AND t.i >= h
), paths AS (
    SELECT heads.c, coalesce(list({'role': role, 'text': text} ORDER BY own, i) FILTER (i IS NOT NULL), []) AS p
    FROM heads LEFT JOIN rebuilt ON rebuilt.c = heads.c GROUP BY heads.c
), steps AS (SELECT c, p, unnest(range(0, len(p) + 1)) AS depth FROM paths
), nodes AS (
    SELECT p[1:depth] AS k, depth, min(c) AS conv_id, count(*) AS n_convs,
           sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len(p) = depth), '')) AS ends_sha256
    FROM steps GROUP BY 1, 2
), kids AS (SELECT k[1:depth - 1] AS k, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1
), sized AS (
    SELECT nodes.*, coalesce(kids.n, 0) AS n_children, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * octet_length(encode(k[depth].text)) END AS saving
    FROM nodes LEFT JOIN kids USING (k)
), up AS (SELECT k, unnest(range(0, depth + 1)) AS d, n_children, saving FROM sized
), sums AS (SELECT k[1:d] AS k, count(*) FILTER (n_children = 0) AS n_leaves, sum(saving)::BIGINT AS saved_tokens FROM up GROUP BY 1)
SELECT s.conv_id, s.depth, parent.conv_id AS parent_conv_id, s.n_convs, s.n_children, n_leaves, saved_tokens, s.ends_sha256
FROM sized s JOIN sums USING (k) LEFT JOIN nodes parent ON s.depth > 0 AND parent.k = s.k[1:s.depth - 1]
"""


@query
def op13_collocations(spark, sf):
    return collocations.mine_phrases(table(spark, sf, "documents"))


STATEMENTS["op13_collocations"] = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS s
    FROM documents
), words AS (SELECT lang, list_filter(regexp_split_to_array(s, '[ 	]+'), lambda w: w <> '') AS w FROM pieces
), grams AS (
    SELECT lang, k, unnest(list_transform(range(1, greatest(len(w) - k + 2, 1)), lambda i: w[i:i + k - 1])) AS p
    FROM words, (SELECT unnest([1, 2, 3, 4]) AS k)
), f AS (SELECT lang, p, k, count(*) AS a FROM grams GROUP BY ALL
), totals AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
), candidates AS (SELECT * FROM f WHERE k >= 2 AND a >= 30
), inner_phrases AS (
    SELECT lang, a, p[i:i + size - 1] AS p FROM candidates, (VALUES (1, 2), (2, 2), (3, 2), (1, 3), (2, 3)) AS t(i, size)
    WHERE size < k AND i + size - 1 <= k
), dropped AS (
    SELECT DISTINCT c.lang, c.p FROM candidates c JOIN inner_phrases i ON i.lang = c.lang AND i.p = c.p WHERE 100 * i.a >= 80 * c.a
), cuts AS (
    SELECT c.lang, c.p, c.a, c.k, unnest(range(1, c.k)) AS cut FROM candidates c ANTI JOIN dropped d ON d.lang = c.lang AND d.p = c.p
), scored AS (
    SELECT cuts.lang, cuts.p, cuts.a, cut, x.a AS l, y.a AS r, (2000000::HUGEINT * cuts.a // (x.a + y.a))::BIGINT AS score
    FROM cuts JOIN f x ON x.lang = cuts.lang AND x.p = cuts.p[1:cut] JOIN f y ON y.lang = cuts.lang AND y.p = cuts.p[cut + 1:]
), best AS (SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) AS o FROM scored
), ranked AS (
    SELECT *, array_to_string(p, ' ') AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank
    FROM best WHERE o = 1
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
