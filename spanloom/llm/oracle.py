"""The same queries in SQL, where SQL can say it."""

ORACLE: dict[str, str] = {
    "op2_chat": r"""
        WITH rows AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
        ), escaped AS (
            SELECT *, replace(replace(replace(text, '\', '\\'), '#', '\#'), '</', '<\/') AS written,
                   replace(replace(replace(replace(role, '\', '\\'), '#', '\#'), '</', '<\/'), ':', '\:')
                       AS written_role FROM rows
        )
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), ''))
                   AS loss_sha256,
               CAST(sum(length(written) + length(written_role) + 14) AS BIGINT) AS formatted_chars
        FROM escaped GROUP BY conv_id
    """,
    "op10_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS payload FROM pages
        ), d AS (
            SELECT page_id, strlen(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM p
        ), f AS (
            SELECT *, CASE WHEN payload_bytes >= 100
                THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id FROM d
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id > first_id THEN first_id END AS refers_to
        FROM f
    """,
    "op11_lexical_search": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
        ), t AS (
            SELECT doc_id, unnest(terms) AS term FROM d
        ), tf AS (
            SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term
        ), size AS (
            SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id
        ), total AS (
            SELECT count(*)::BIGINT AS n, sum(n)::BIGINT AS length FROM size
        ), df AS (
            SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term
        ), i AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
        ), scored AS (
            SELECT item_id, doc_id, sum(
                CAST(floor(1000 * ln((2.0::DOUBLE * total.n + 2) / (2.0::DOUBLE * df + 1))) AS BIGINT)
                * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * size.n * total.n) // length)))
            )::BIGINT AS score
            FROM i JOIN tf USING (term) JOIN df USING (term) JOIN size USING (doc_id), total GROUP BY item_id, doc_id
        )
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
        FROM scored WHERE score > 0 QUALIFY rank <= 10
    """,
    "op12_hard_negatives": """
        WITH e AS (
            SELECT vec_id AS id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, [CAST(floor(256 * x::DOUBLE) AS BIGINT) FOR x IN embedding] AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND label IS NOT NULL AND coalesce(list_bool_and([coalesce(isfinite(x), false) FOR x IN embedding]), true)
        ), s AS (
            SELECT a.id AS anchor_id, a.label = c.label AS same, c.id,
                   CAST(list_inner_product(a.v::DOUBLE[], c.v::DOUBLE[]) AS BIGINT) AS score
            FROM e a JOIN e c ON a.id <> c.id WHERE a.id % 100 = 0
        ), p AS (
            SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
        )
        SELECT anchor_id, positive_id,
               CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
               id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id)
        WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
        QUALIFY rank <= 5
    """,
    "op13_vector_search": """
        WITH e AS (
            SELECT vec_id AS id, [CAST(floor(64 * x::DOUBLE) AS BIGINT) FOR x IN embedding] AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND coalesce(list_bool_and([coalesce(isfinite(x), false) FOR x IN embedding]), true)
        )
        SELECT q.id AS query_id,
               CAST(row_number() OVER (PARTITION BY q.id ORDER BY list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[]) DESC, c.id) AS INTEGER) AS rank,
               c.id AS vec_id, CAST(list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[]) AS BIGINT) AS score
        FROM e q JOIN e c ON q.id <> c.id WHERE q.id % 20 = 0
        QUALIFY rank <= 20
    """,
}
