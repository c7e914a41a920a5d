"""The registered queries of this subpackage and SQL for the same rows where SQL can express them."""

from __future__ import annotations

from trainlake.llm.bloom_lm import op10_lm_scoring
from trainlake.llm.exact_dedup import op9_exact_dedup
from trainlake.llm.line_chunks import op4_line_dedup
from trainlake.llm.ngram_join import op3_ngram_jaccard_join
from trainlake.llm.periodic_runs import op13_periodic_runs
from trainlake.llm.pfair_mixing import op8_mixing
from trainlake.llm.piece_lattice import op6_sentencepiece
from trainlake.llm.secret_forest import op5_secret_scans
from trainlake.llm.site_quality import op1_quality_classifier
from trainlake.llm.toxicity import op11_toxicity
from trainlake.llm.turn_repair import op12_conversation_repair
from trainlake.llm.voronoi_knn import op7_exact_top_k
from trainlake.llm.warc import op2_warc_derivatives

QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_classifier,
        op2_warc_derivatives,
        op3_ngram_jaccard_join,
        op4_line_dedup,
        op5_secret_scans,
        op6_sentencepiece,
        op7_exact_top_k,
        op8_mixing,
        op9_exact_dedup,
        op10_lm_scoring,
        op11_toxicity,
        op12_conversation_repair,
        op13_periodic_runs,
    )
}

ORACLE = {
    "op4_line_dedup": """
        WITH l AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
            FROM documents
        ), h AS (
            SELECT *, length(line) - length(replace(line, ' ', '')) >= 49 AS long,
                md5(md5(line) || md5(lead(line) OVER d)) AS gap
            FROM l WINDOW d AS (PARTITION BY doc_id ORDER BY i)
        ), c AS (
            SELECT *, lag(i) OVER d IS NULL OR lag(long) OVER d OR long
                OR (coalesce(lag(gap) OVER d < lag(gap, 2) OVER d, true) AND coalesce(lag(gap) OVER d <= gap, true)) AS starts
            FROM h WINDOW d AS (PARTITION BY doc_id ORDER BY i)
        ), n AS (
            SELECT *, sum(CAST(starts AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS pos FROM c
        ), k AS (
            SELECT doc_id, pos, string_agg(line, chr(10) ORDER BY i) AS chunk, count(*) > 1 OR bool_or(long) AS eligible
            FROM n GROUP BY doc_id, pos
        ), r AS (
            SELECT *, eligible AND trim(chunk, ' ' || chr(9) || chr(13) || chr(10)) <> ''
                AND row_number() OVER (PARTITION BY chunk, eligible ORDER BY doc_id, pos) > 1 AS gone
            FROM k
        ), t AS (
            SELECT doc_id, count(*) AS chunks, count(*) FILTER (gone) AS removed,
                coalesce(string_agg(chunk, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text
            FROM r GROUP BY doc_id
        )
        SELECT doc_id, chunks, removed, length(text) AS n_left, md5(text) AS text_md5 FROM t
    """,
    "op7_exact_top_k": """
        WITH v AS (
            SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS vec
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, x.vec_id, CAST(list_inner_product(q.vec::DOUBLE[], x.vec::DOUBLE[]) AS BIGINT) AS score
            FROM v q JOIN v x ON q.vec_id <> x.vec_id AND len(q.vec) = len(x.vec)
            WHERE q.vec_id % 50 = 0
        ), r AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op9_exact_dedup": """
        WITH t AS (
            SELECT doc_id, coalesce(text, '') AS whole, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS bare
            FROM documents
        ), g AS (
            SELECT *, count(*) OVER (PARTITION BY bare) AS group_size,
                first_value(doc_id) OVER (PARTITION BY bare ORDER BY length(whole) DESC, doc_id) AS keep_id
            FROM t
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(bare) AS text_sha256 FROM g
    """,
}
