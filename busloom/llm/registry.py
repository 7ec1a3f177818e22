"""Queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from busloom.llm import bytepair, convtrie, fim, jaccard, kneserney, mixing, rans, sharding, tokencount, topk, toxicity, triebpe, vectorlinks


def queries():
    return {
        "op1_toxicity_fm": toxicity.op1,
        "op2_topk_cover_tree": topk.op2,
        "op3_sharding": sharding.op3,
        "op4_embedding_links": vectorlinks.op4,
        "op5_byte_bpe": bytepair.op5,
        "op6_token_counts": tokencount.op6,
        "op7_rans_files": rans.op7,
        "op8_kneser_ney": kneserney.op8,
        "op9_poisson_mix": mixing.op9,
        "op10_jaccard_join": jaccard.op10,
        "op11_fill_in_middle": fim.op11,
        "op12_trie_bpe": triebpe.op12,
        "op13_conversation_trie": convtrie.op13,
    }


_TOP_K = """WITH v AS (SELECT vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding]::DOUBLE[] AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.e, d.e)::BIGINT AS score FROM v q JOIN v d ON q.vec_id % 20 = 0 AND d.vec_id <> q.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""

_LINKS = """WITH RECURSIVE u AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e) * list_inner_product(b.e, b.e)) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM u UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a), n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)"""

_MIX = """WITH h AS (SELECT doc_id, source, md5(coalesce(text, '')) AS text_md5, ('0x' || substr(md5('mix-1|' || doc_id), 1, 15))::BIGINT / 1152921504606846976e0 AS u FROM documents),
n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
r AS (SELECT source, (n::DOUBLE ** 0.7e0) / (SELECT sum(n::DOUBLE ** 0.7e0) FROM n) * (SELECT sum(n)::BIGINT FROM n) / n AS rate FROM n),
p AS (SELECT source, k, exp(-rate + k * ln(rate) - sum(ln(greatest(k, 1)::DOUBLE)) OVER (PARTITION BY source ORDER BY k)) AS p FROM r, range(0, 60) t(k)),
f AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS f FROM p),
c AS (SELECT doc_id, h.source, text_md5, count(*) AS copies FROM h JOIN f ON h.source = f.source AND f.f <= h.u GROUP BY doc_id, h.source, text_md5),
e AS (SELECT doc_id, source, text_md5, copies, unnest(range(copies)) AS copy FROM c)
SELECT doc_id, source, text_md5, copies::INT AS copies, copy::INT AS copy, row_number() OVER (ORDER BY substr(md5('mix-1-order|' || doc_id || '|' || copy), 1, 15), doc_id, copy) - 1 AS position FROM e"""

_JACCARD = """WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\x0b\\x0c]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, greatest(len(w) - 4, 1) + 1)]) AS s FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE common / (x.n + y.n - common)::DOUBLE >= 0.8e0),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY a), k AS (SELECT a AS doc_id, count(*) AS n_links FROM l GROUP BY a)
SELECT doc_id, coalesce(n_links, 0)::BIGINT AS n_links, class_id, doc_id = class_id AS kept FROM c LEFT JOIN k USING (doc_id)"""

_MIDDLE = r"""WITH u AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
h AS (SELECT *, len(u) AS n, [('0x' || substr(d, 8 * k + 1, 8))::BIGINT FOR k IN range(4)] AS h FROM u),
f AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b, CASE WHEN n = 0 OR regexp_matches(text, '<[PSM]>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
c AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM c"""


def oracle_sql():
    """DuckDB SQL of those that it can express: DuckDB has no crc32, no tokenizers and no fitted models."""
    return {"op2_topk_cover_tree": _TOP_K, "op4_embedding_links": _LINKS, "op9_poisson_mix": _MIX, "op10_jaccard_join": _JACCARD, "op11_fill_in_middle": _MIDDLE}
