"""SQL of the operators that SQL can express, for another engine to run on the same tables."""

#: Words of a text: A-Z as a-z, cut at white space.
_WORDS = r"list_filter(string_split_regex(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
 s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS g FROM d),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
 e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
 l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
 walk(id, root) AS (SELECT DISTINCT a, a FROM l UNION SELECT l.b, walk.root FROM walk JOIN l ON l.a = walk.id),
 r AS (SELECT id, min(root) AS root FROM walk GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(r.root, d.doc_id) AS component_id, d.doc_id = coalesce(r.root, d.doc_id) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN r ON r.id = d.doc_id
"""

LINE_DEDUP = f"""
WITH RECURSIVE t AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
 x AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS k FROM t),
 w AS (SELECT doc_id, k, {_WORDS.format("line")} AS w FROM x),
 f AS (SELECT doc_id, k, w, array_to_string(list_sort(w), ' ') AS s, row_number() OVER (ORDER BY doc_id, k) AS pos FROM w WHERE len(w) >= 5 OR list_sum(list_transform(w, lambda v: strlen(v))) >= 16),
 c AS (SELECT s, min(pos) AS first, any_value(len(w)) AS n, count(*) AS times FROM f GROUP BY s),
 m AS (SELECT first, n, unnest(string_split(s, ' ')) AS token FROM c),
 g AS (SELECT first, n, token, count(*) AS times FROM m GROUP BY ALL),
 p AS (SELECT a.first AS a, b.first AS b, a.n AS na, b.n AS nb, sum(least(a.times, b.times)) AS i FROM g a JOIN g b ON a.token = b.token AND a.first > b.first
        AND 4 * b.n >= 3 * a.n AND 4 * a.n >= 3 * b.n GROUP BY 1, 2, 3, 4),
 e AS (SELECT a, b FROM p WHERE 4 * i >= 3 * (na + nb - i)),
 l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
 y AS (SELECT a, count(*) AS links, bool_or(b < a) AS gone FROM l GROUP BY a),
 walk(id, root) AS (SELECT a, a FROM y UNION SELECT l.b, walk.root FROM walk JOIN l ON l.a = walk.id),
 r AS (SELECT id, min(root) AS root FROM walk GROUP BY id),
 o AS (SELECT f.doc_id, f.k, coalesce(y.gone, false) AS near, coalesce(y.gone, false) OR f.pos <> c.first AS cut, coalesce(links, 0) AS links, links IS NOT NULL OR times > 1 AS told, h.doc_id || ':' || h.k AS root
        FROM f JOIN c ON c.s = f.s LEFT JOIN y ON y.a = c.first LEFT JOIN r ON r.id = c.first JOIN f h ON h.pos = coalesce(r.root, c.first)),
 q AS (SELECT doc_id, count(*) FILTER (WHERE cut) AS n_removed, count(*) FILTER (WHERE near) AS n_near, sum(links)::BIGINT AS n_links, string_agg(cast(k AS varchar), ',' ORDER BY k) FILTER (WHERE cut) AS removed,
        string_agg(k || '=' || root, ',' ORDER BY k) FILTER (WHERE told) AS class_ids FROM o GROUP BY doc_id),
 z AS (SELECT doc_id, count(*) AS n_short FROM w WHERE len(w) BETWEEN 1 AND 4 AND list_sum(list_transform(w, lambda v: strlen(v))) < 16 GROUP BY doc_id)
SELECT t.doc_id, coalesce(len(ls), 0) AS n_lines, coalesce(n_short, 0) AS n_short, coalesce(n_removed, 0) AS n_removed, coalesce(n_near, 0) AS n_near, coalesce(n_links, 0) AS n_links, coalesce(removed, '') AS removed, coalesce(class_ids, '') AS class_ids
FROM t LEFT JOIN q ON q.doc_id = t.doc_id LEFT JOIN z ON z.doc_id = t.doc_id
"""

#: Terms of a text: runs of ASCII letters and digits and of characters beyond ASCII, A-Z as a-z.
_TERMS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

RANKED = f"""
WITH d AS (SELECT doc_id, {_TERMS.format("text")} AS w FROM documents WHERE text IS NOT NULL),
 s AS (SELECT count(*) AS big_n, sum(len(w))::BIGINT AS big_l FROM d WHERE len(w) > 0),
 u AS (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d),
 p AS (SELECT doc_id, n, term, count(*) AS tf FROM u GROUP BY ALL),
 f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
 q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS.format("text")}) AS term FROM benchmark) GROUP BY ALL),
 r AS (SELECT item_id, q.term, times * floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM q JOIN f ON f.term = q.term, s),
 x AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l))))::BIGINT AS score FROM r JOIN p ON p.term = r.term, s GROUP BY ALL),
 o AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM x WHERE score > 0)
SELECT * FROM o WHERE rank <= 20
"""

CONTAMINATION = f"""
WITH i AS (SELECT item_id, {_TERMS.format("text")} AS w FROM benchmark),
 g AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda k: array_to_string(list_slice(w, k, k + least(len(w), 10) - 1), ' '))) AS gram FROM i WHERE len(w) > 0),
 d AS (SELECT doc_id, coalesce({_TERMS.format("text")}, []) AS w FROM documents),
 z AS (SELECT DISTINCT n FROM g),
 r AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS k, w FROM d, z WHERE len(w) >= n),
 h AS (SELECT doc_id, r.n, k, item_id FROM r JOIN g ON g.n = r.n AND g.gram = array_to_string(list_slice(w, k, k + r.n - 1), ' ')),
 c AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS k FROM h) GROUP BY doc_id),
 e AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN e ON e.doc_id = d.doc_id
"""


def _assigned(n: int) -> str:
    """The nearest entry of codebook n to each part."""
    return f"""a{n} AS (SELECT vec_id, label, part, vec, arg_min(entry, (distance, entry)) AS entry, min(distance) AS distance
      FROM (SELECT p.vec_id, p.label, p.part, p.vec, b.entry, list_sum(list_transform(list_zip(p.vec, b.vec), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS distance FROM p JOIN b{n} b ON b.part = p.part) GROUP BY ALL)"""


def _moved(n: int) -> str:
    """Codebook n + 1: the means of the parts that each entry of codebook n is nearest to."""
    return f"""u{n} AS (SELECT part, entry, place, sum(x)::BIGINT AS s, count(*) AS c FROM (SELECT part, entry, unnest(vec) AS x, generate_subscripts(vec, 1) AS place FROM a{n}) GROUP BY ALL),
 m{n} AS (SELECT part, entry, list((s - ((s % c) + c) % c) // c ORDER BY place) AS vec FROM u{n} GROUP BY ALL),
 b{n + 1} AS (SELECT b.part, b.entry, coalesce(m.vec, b.vec) AS vec FROM b{n} b LEFT JOIN m{n} m ON m.part = b.part AND m.entry = b.entry)"""


VECTOR_CODES = f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS vec FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 p AS (SELECT vec_id, label, part, list_slice(vec, part * (len(vec) // 16) + 1, (part + 1) * (len(vec) // 16)) AS vec FROM v, range(16) t(part)),
 b0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, vec FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 64)),
 {_assigned(0)}, {_moved(0)}, {_assigned(1)}, {_moved(1)}, {_assigned(2)},
 s AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, place)) AS digest FROM (SELECT part, entry, unnest(vec) AS x, generate_subscripts(vec, 1) AS place FROM b2)),
 c AS (SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(distance)::BIGINT AS error FROM a2 GROUP BY vec_id, label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, digest AS codebooks_sha256 FROM c, s
"""
