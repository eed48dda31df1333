"""The registered queries opN_<name>: each operator over its whole table."""

from __future__ import annotations

from . import collocations, decontamination, divergence, embedding_lsh, mixing, packing, passages, quality, simhash, suffix_dedup, token_files, toxicity, url_rules
from .common import read


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(read(spark, sf_dir, "documents")).drop("kept")


def op2_token_output(spark, sf_dir):
    return token_files.write_and_read(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=2)


def op3_best_fit_packing(spark, sf_dir):
    return packing.best_fit_pack(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=1, size=4096)


def op4_url_filter(spark, sf_dir):
    return url_rules.judge(read(spark, sf_dir, "pages"))


def op5_decontamination(spark, sf_dir):
    return decontamination.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6_substring_dedup(spark, sf_dir):
    return passages.find(read(spark, sf_dir, "documents")).drop("digest")


def op7_simhash(spark, sf_dir):
    return simhash.link(read(spark, sf_dir, "documents"), k=3, radius=3)


def op8_quality(spark, sf_dir):
    return quality.scores(read(spark, sf_dir, "documents"))


def op9_toxicity(spark, sf_dir):
    return toxicity.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_embedding_near_dedup(spark, sf_dir):
    return embedding_lsh.link(read(spark, sf_dir, "embeddings"))


def op11_source_divergence(spark, sf_dir):
    return divergence.audit(read(spark, sf_dir, "documents"))


def op12_phrase_collocations(spark, sf_dir):
    return collocations.mine(read(spark, sf_dir, "documents"))


def op13_source_mix(spark, sf_dir):
    return mixing.mix(read(spark, sf_dir, "documents")).drop("source", "uses")


def queries():
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = {
    "op11_source_divergence": rf"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents), t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
 k AS (SELECT lang, term FROM t GROUP BY 1, 2 HAVING count(DISTINCT r) >= 3), c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY 1, 2, 3), g AS (SELECT DISTINCT lang, source FROM d),
 every AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
 p AS (SELECT *, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source))::HUGEINT AS p FROM every),
 q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (m + 1)) // (sum(m) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang))::HUGEINT AS q FROM (SELECT lang, term, sum(n)::HUGEINT AS m FROM every GROUP BY 1, 2)),
 pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY 1, 2, 3),
 terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
 SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pairs UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM terms QUALIFY rank <= 200""",
    "op12_phrase_collocations": rf"""WITH p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
 s AS (SELECT lang, unnest(w) AS a, unnest(w[2:]) AS b, unnest(w[3:]) AS c FROM p), g AS (SELECT lang, a AS phrase, 1 AS words, count(*) AS f FROM s WHERE a IS NOT NULL GROUP BY 1, 2 UNION ALL SELECT lang, a || ' ' || b, 2, count(*) FROM s WHERE b IS NOT NULL GROUP BY 1, 2 UNION ALL SELECT lang, a || ' ' || b || ' ' || c, 3, count(*) FROM s WHERE c IS NOT NULL GROUP BY 1, 2),
 c AS (SELECT lang, phrase, words, f AS a, string_split(phrase, ' ') AS w FROM g WHERE words > 1 AND f >= 10), cuts AS (SELECT *, unnest(range(1, words)) AS k FROM c),
 sc AS (SELECT cuts.*, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS score FROM cuts JOIN g x ON x.lang = cuts.lang AND x.phrase = array_to_string(w[1:k], ' ') JOIN g y ON y.lang = cuts.lang AND y.phrase = array_to_string(w[k + 1:], ' ')),
 best AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
 kept AS (SELECT * FROM best WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = best.lang AND c.words = 3 AND best.words = 2 AND best.phrase IN (array_to_string(c.w[1:2], ' '), array_to_string(c.w[2:3], ' ')) AND 100 * c.a >= 50 * best.a))
 SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, (SELECT sum(f) FROM g WHERE g.lang = kept.lang AND words = 1)::BIGINT AS n, score::BIGINT AS score FROM kept QUALIFY rank <= 2000""",
    "op5_decontamination": r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents), i AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM benchmark),
 ds AS (SELECT r, doc_id, list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda k: array_to_string(w[k : k + 4], ' ')) AS s FROM d WHERE len(w) > 0), ib AS (SELECT item_id, list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda k: array_to_string(w[k : k + 4], ' ')) AS s FROM i WHERE len(w) > 0),
 dp AS (SELECT r, unnest(s) AS g, unnest(range(len(s))) AS p FROM ds), ip AS (SELECT item_id, len(s) AS size, unnest(s) AS g, unnest(range(len(s))) AS q FROM ib),
 st AS (SELECT DISTINCT dp.r, item_id, greatest(0, least(p - q, len(ds.s) - size)) AS start FROM dp JOIN ip USING (g) JOIN ds ON ds.r = dp.r),
 win AS (SELECT doc_id, st.item_id, start, ds.s[start + 1 : start + len(ib.s)] AS a, ib.s AS b FROM st JOIN ds USING (r) JOIN ib ON ib.item_id = st.item_id),
 shared AS (SELECT doc_id, item_id, start, len(a) + len(b) AS n, list_sum(list_transform(list_distinct(b), lambda x: least(len(list_filter(a, lambda y: y = x)), len(list_filter(b, lambda z: z = x))))) AS common FROM win),
 sim AS (SELECT doc_id, item_id, start, common / (n - common) AS similarity FROM shared WHERE common / (n - common) >= 0.8)
 SELECT doc_id, item_id, start::INTEGER AS start_word, similarity FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) AS k FROM sim) WHERE k = 1""",
    "op10_embedding_near_dedup": """WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
 l AS (SELECT a.r AS a, b.r AS b, a.vec_id AS va, b.vec_id AS vb FROM v a JOIN v b ON a.r <> b.r AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.95),
 reach(r, x) AS (SELECT r, r FROM v UNION SELECT reach.r, l.b FROM reach JOIN l ON reach.x = l.a),
 c AS (SELECT reach.r, min(v.vec_id) AS component_id FROM reach JOIN v ON reach.x = v.r GROUP BY reach.r), n AS (SELECT a AS r, count(*) AS n_links FROM l GROUP BY a)
 SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept FROM v JOIN c USING (r) LEFT JOIN n USING (r)
 UNION ALL SELECT vec_id, 0, vec_id, vec_id IS NOT NULL FROM embeddings WHERE NOT coalesce(len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false)""",
}


def oracle_sql():
    """What SQL can express on whole tables; the other queries are tested against
    brute force or held-out accuracy."""
    return dict(SQL)
