"""SQL that DuckDB runs for the operators that SQL can express."""

from __future__ import annotations

OP8 = r"""
WITH parts AS (
    SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), named AS (
    SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS authority, rest FROM parts
), urls AS (
    SELECT page_id, translate(coalesce(authority, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        coalesce(regexp_extract(substr(rest, length(authority) + 1), '^[^?#]*'), '') AS path
    FROM named
), rules(rule_host, rule_path, verdict) AS (
    VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
        ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), fitting AS (
    SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
        arg_max(verdict, length(rule_host || rule_path)) AS verdict
    FROM urls JOIN rules ON starts_with(path, rule_path) AND (host = rule_host OR ends_with(host, '.' || rule_host))
    GROUP BY page_id
)
SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM urls u LEFT JOIN fitting f USING (page_id)
"""

WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP10 = rf"""
WITH items AS (
    SELECT item_id, words, least(10, len(words)) AS width FROM (SELECT item_id, {WORDS} AS words FROM benchmark) WHERE len(words) > 0
), windows AS (
    SELECT DISTINCT item_id, width, array_to_string(words[i:i + width - 1], ' ') AS phrase
    FROM (SELECT item_id, words, width, unnest(generate_series(1, len(words) - width + 1)) AS i FROM items)
), widths AS (SELECT DISTINCT width FROM windows),
docs AS (SELECT doc_id, coalesce({WORDS}, []) AS words FROM documents),
places AS (SELECT doc_id, words, unnest(generate_series(1, len(words))) AS i FROM docs),
found AS (
    SELECT doc_id, i, w.width, item_id
    FROM (SELECT doc_id, i, width, array_to_string(words[i:i + width - 1], ' ') AS phrase FROM places, widths WHERE i + width - 1 <= len(words)) p
    JOIN windows w ON p.width = w.width AND p.phrase = w.phrase
), hits AS (
    SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + width - 1)) AS spot FROM found) GROUP BY doc_id
), named AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id
)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(n.n_items, 0) AS n_items,
    sha256(coalesce(n.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hits h USING (doc_id) LEFT JOIN named n USING (doc_id)
"""


OP11 = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
starts AS (SELECT r, words, unnest(range(1, len(words) - 33)) AS i FROM docs WHERE len(words) >= 35),
windows AS (SELECT r, i, array_to_string(words[i:i + 34], ' ') AS phrase FROM starts),
twice AS (SELECT phrase FROM windows GROUP BY phrase HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, spot FROM (SELECT r, unnest(range(i, i + 35)) AS spot FROM windows SEMI JOIN twice USING (phrase))),
placed AS (SELECT r, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS spot FROM docs),
kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY spot) AS words FROM placed ANTI JOIN gone USING (r, spot) GROUP BY r)
SELECT doc_id, len(docs.words)::BIGINT AS n_words, (len(docs.words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.words, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (r)
"""

OP2 = """
WITH RECURSIVE usable AS (
    SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
    WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.r AS ra, a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.r <> b.r AND len(a.v) = len(b.v)
    WHERE list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v) * list_inner_product(b.v, b.v)) >= 0.93
), reached(a, b) AS (
    SELECT vec_id, vec_id FROM usable
    UNION
    SELECT reached.a, links.b FROM reached JOIN links ON reached.b = links.a
), named AS (SELECT a AS vec_id, min(b) AS component FROM reached GROUP BY a),
counted AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(component, vec_id) AS component_id, vec_id = coalesce(component, vec_id) AS kept
FROM embeddings LEFT JOIN named USING (vec_id) LEFT JOIN counted USING (vec_id)
"""

OP12 = """
WITH taken AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
    FROM taken a JOIN taken b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), positives AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM pairs WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INTEGER AS rank,
    other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""

OP13 = rf"""
WITH docs AS (
    SELECT doc_id, {WORDS} AS terms
    FROM documents WHERE text IS NOT NULL
), held AS (SELECT doc_id, terms, len(terms)::BIGINT AS n FROM docs WHERE len(terms) > 0),
totals AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM held),
asked AS (
    SELECT item_id, term, count(*)::BIGINT AS repeats FROM (
        SELECT item_id, unnest({WORDS}) AS term
        FROM benchmark)
    GROUP BY item_id, term
), postings AS (
    SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, n, unnest(terms) AS term FROM held)
    WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, n, term
), weights AS (
    SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
    FROM (SELECT term, count(*)::BIGINT AS df FROM postings GROUP BY term), totals
), scored AS (
    SELECT item_id, doc_id, sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * big_n) // big_l))))::BIGINT AS score
    FROM postings JOIN weights USING (term) JOIN asked USING (term), totals GROUP BY item_id, doc_id
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 10
"""


def statements() -> dict[str, str]:
    return {"op2_embeddings": OP2, "op8_urls": OP8, "op10_decontamination": OP10, "op11_phrases": OP11, "op12_negatives": OP12, "op13_search": OP13}
