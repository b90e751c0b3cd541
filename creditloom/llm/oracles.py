"""DuckDB twins of the operators that SQL can express."""

from __future__ import annotations

DECONTAMINATION = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w
  FROM documents
), b AS (
  SELECT cast(item_id AS varchar) AS item, regexp_extract_all(translate(text,
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), patterns AS (
  SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS run
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), lengths AS (SELECT DISTINCT n FROM patterns),
starts AS (
  SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n
), found AS (
  SELECT s.r, s.i, s.n, p.item FROM starts s
  JOIN patterns p ON p.n = s.n AND p.run = array_to_string(s.w[s.i : s.i + s.n - 1], ' ')
), hit AS (
  SELECT r, count(DISTINCT k) AS n_hit FROM
    (SELECT DISTINCT r, unnest(range(i, i + n)) AS k FROM found) GROUP BY r
), items AS (
  SELECT r, count(DISTINCT item) AS n_items,
    array_to_string(list_sort(list(DISTINCT item)), ',') AS names FROM found GROUP BY r
)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""

WARC = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(encode(coalesce(html, ''))) AS digest,
    max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages
)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to
FROM p
"""

RESAMPLING = r"""
WITH crc_table AS (
  SELECT list(list_reduce(list_prepend(n, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t
  FROM range(256) AS _(n)
), d AS (
  SELECT doc_id, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w
  FROM documents
), b AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w
  FROM benchmark
), source AS (SELECT r, word, count(*) AS n FROM (SELECT r, unnest(w) AS word FROM d) GROUP BY r, word),
target AS (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM b) GROUP BY word),
words AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM source UNION SELECT word FROM target)),
buckets AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(h) + 1, 2),
      lambda i: ('0x' || substr(h, i, 2))::BIGINT)),
    lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) % 10000 AS bucket
  FROM words, crc_table
), s AS (SELECT bucket, sum(n) AS s FROM source JOIN buckets USING (word) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS t FROM target JOIN buckets USING (word) GROUP BY bucket),
total AS (SELECT (SELECT coalesce(sum(s), 0) FROM s)::DOUBLE AS s_all, (SELECT coalesce(sum(t), 0) FROM t)::DOUBLE AS t_all),
gain AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (s_all + 10000)
    / ((coalesce(s, 0)::DOUBLE + 1) * (t_all + 10000))))::BIGINT AS g
  FROM s FULL JOIN t USING (bucket), total
), weighed AS (
  SELECT r, sum(n)::BIGINT AS n, sum(n * g)::BIGINT AS g
  FROM source JOIN buckets USING (word) JOIN gain USING (bucket) GROUP BY r
), scored AS (
  SELECT doc_id, r, coalesce(n, 0) AS n,
    CASE WHEN n IS NULL THEN 0 ELSE (g - ((g % n) + n) % n) // n END AS weight,
    ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT::DOUBLE AS h
  FROM d LEFT JOIN weighed USING (r)
), numbered AS (
  SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0)))::BIGINT AS score FROM scored
), placed AS (
  SELECT *, row_number() OVER (ORDER BY n >= 20 DESC, score DESC, doc_id NULLS LAST) AS place,
    count(*) FILTER (n >= 20) OVER () * 10 // 100 AS drawn
  FROM numbered
)
SELECT doc_id, n AS n_features, weight, score, CASE WHEN n >= 20 AND place <= drawn THEN place END AS rank FROM placed
"""


def vector_codes(rounds: int = 2) -> str:
    """Product codes by brute force; each round is a pair of steps, so the text has as many."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS (
  SELECT r, p, x, min(struct_pack(d := list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e := e)) AS m
  FROM parts JOIN c{k} USING (p) GROUP BY r, p, x
)""")
        if k < rounds:
            steps.append(f"""c{k + 1} AS (
  SELECT p, e, coalesce(list(v ORDER BY i) FILTER (v IS NOT NULL), any_value(c)) AS c FROM (
    SELECT c{k}.p, c{k}.e, c, i, v FROM c{k} LEFT JOIN (
      SELECT p, e, i, floor(sum(v)::DOUBLE / count(*))::BIGINT AS v FROM (
        SELECT p, m.e AS e, unnest(x) AS v, unnest(range(len(x))) AS i FROM a{k}
      ) GROUP BY p, e, i
    ) AS means ON means.p = c{k}.p AND means.e = c{k}.e
  ) GROUP BY p, e
)""")
    return f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), parts AS (
  SELECT r, p, v[p * len(v) // 16 + 1 : (p + 1) * len(v) // 16] AS x FROM kept, range(16) AS _(p)
), c0 AS (SELECT p, r - 1 AS e, x AS c FROM parts WHERE r <= 64),
{", ".join(steps)},
books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS h FROM c{rounds}),
coded AS (
  SELECT r, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM a{rounds} GROUP BY r
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, h AS codebooks_sha256
FROM kept JOIN coded USING (r), books
"""


VECTOR_DUPLICATES = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.98
), reached AS (
  SELECT vec_id AS a, vec_id AS b FROM v
  UNION SELECT reached.a, links.b FROM reached JOIN links ON reached.b = links.a
), facts AS (
  SELECT a, min(b) AS component FROM reached GROUP BY a
), counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component, vec_id) AS component_id,
  vec_id = coalesce(component, vec_id) AS kept
FROM embeddings LEFT JOIN facts ON facts.a = vec_id LEFT JOIN counts ON counts.a = vec_id
"""

ORACLES: dict[str, str] = {
    "op9_decontamination": DECONTAMINATION,
    "op10_warc": WARC,
    "op11_resampling": RESAMPLING,
    "op12_vector_codes": vector_codes(),
    "op13_vector_duplicates": VECTOR_DUPLICATES,
}
