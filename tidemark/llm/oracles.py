"""SQL that gives the rows of queries whose results are exact."""

#: Lines of five sites or more.
LINE_SPREAD = r"""WITH d AS (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS raw FROM documents),
l AS (SELECT doc_id, source, unnest(raw) AS r, generate_subscripts(raw, 1) AS pos FROM d),
t AS (SELECT *, trim(r, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM l),
bad AS (SELECT line FROM t WHERE line <> '' GROUP BY line HAVING count(DISTINCT coalesce(source, chr(1))) >= 5),
s AS (SELECT t.doc_id, t.pos, t.r, bad.line IS NOT NULL AS gone FROM t LEFT JOIN bad USING (line)),
k AS (SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(r, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept FROM s GROUP BY doc_id)
SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE n END AS n_lines, n_removed, sha256(kept) AS kept_sha256 FROM documents JOIN k USING (doc_id)"""

#: Words under windows of 35 that start anywhere else too.
REPEATED_PHRASES = r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM d),
g AS (SELECT doc_id, unnest(range(1, len(words) - 33)) AS pos, words FROM d WHERE len(words) >= 35),
h AS (SELECT doc_id, pos, sha256(array_to_string(words[pos:pos + 34], ' ')) AS gram FROM g),
dup AS (SELECT doc_id, pos FROM h QUALIFY count(*) OVER (PARTITION BY gram) > 1),
m AS (SELECT w.doc_id, w.pos, w.word, coalesce(max(dup.pos) OVER (PARTITION BY w.doc_id ORDER BY w.pos), -99) > w.pos - 35 AS gone FROM w LEFT JOIN dup USING (doc_id, pos)),
k AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""

#: Components of 85 % of three-word shingles; one text of each set goes into the pairs.
NEAR_DUPLICATES = r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
  ELSE list_sort(list_distinct(list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i + 2], ' ')))) END AS grams FROM d),
c AS (SELECT doc_id, len(grams) AS n, CASE WHEN len(grams) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY md5(array_to_string(grams, chr(10)))) END AS rep, grams FROM s),
g AS (SELECT rep, n, unnest(grams) AS gram FROM c WHERE rep = doc_id),
p AS (SELECT x.rep AS a, y.rep AS b FROM g x JOIN g y ON x.gram = y.gram AND x.rep < y.rep GROUP BY x.rep, y.rep, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r AS (SELECT a AS rep, a AS near FROM e UNION SELECT r.rep, e.b FROM r JOIN e ON r.near = e.a),
m AS (SELECT rep, min(near) AS component FROM r GROUP BY rep)
SELECT doc_id, n AS n_shingles, coalesce(component, rep) AS component_id, doc_id = coalesce(component, rep) AS kept FROM c LEFT JOIN m USING (rep)"""
