"""DuckDB SQL of the numbered operators that SQL can express."""

ORACLE = {}

ORACLE["op1_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.w, c.w) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.w) = len(c.w))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 10
"""

ORACLE["op12_hard_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS vec_id, a.label = c.label AS same, CAST(list_inner_product(a.w, c.w) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id AND len(a.w) = len(c.w)),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score
  FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT same
     AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""

ORACLE["op6_decontamination"] = r"""
WITH item_words AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
item_windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n,
         unnest(list_transform(range(1, len(w) - least(13, len(w)) + 2), lambda i: array_to_string(w[i : i + least(13, len(w)) - 1], ' '))) AS g
  FROM item_words WHERE len(w) > 0),
doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
sizes AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (
  SELECT doc_id, n, unnest(range(1, greatest(len(w) - n, -1) + 2)) AS i,
         unnest(list_transform(range(1, greatest(len(w) - n, -1) + 2), lambda i: array_to_string(w[i : i + n - 1], ' '))) AS g
  FROM doc_words, sizes),
found AS (SELECT doc_id, i, n, item_id FROM doc_windows JOIN item_windows USING (n, g)),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(id) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc_words d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

ORACLE["op8_warc_fixity"] = r"""
WITH files AS (SELECT greatest(1, (count(*) + 999) // 1000) AS n FROM pages),
named AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html,
         md5(concat(coalesce(CAST(page_id AS VARCHAR), ''), '|', coalesce(url, ''), '|', coalesce(html, ''))) AS record_id
  FROM pages),
written AS (
  SELECT CAST(('0x' || substr(record_id, 1, 8)) AS BIGINT) % n AS file, named.* FROM named, files),
replicas AS (
  SELECT 0 AS side, * FROM written
  UNION ALL
  SELECT 1, file, page_id, url,
         CASE WHEN coalesce(page_id, 0) % 997 = 7 THEN left(html, length(html) // 2)
              WHEN coalesce(page_id, 0) % 211 = 5 THEN '!' || substr(html, 2) ELSE html END, record_id
  FROM written WHERE coalesce(page_id, 0) % 1499 <> 11),
stored AS (
  SELECT side, file, record_id,
         concat('WARC/1.1', chr(13), chr(10), 'WARC-Type: resource', chr(13), chr(10), 'WARC-Target-URI: ', url, chr(13), chr(10),
                'WARC-Record-ID: <urn:md5:', record_id, '>', chr(13), chr(10), 'Content-Type: text/html', chr(13), chr(10),
                'Content-Length: ', strlen(html), chr(13), chr(10), chr(13), chr(10), html, chr(13), chr(10), chr(13), chr(10)) AS b
  FROM replicas),
entries AS (
  SELECT side, file, record_id, CAST(strlen(b) AS BIGINT) AS length, sha256(b) AS digest, count(*) AS copies
  FROM stored GROUP BY ALL),
placed AS (
  SELECT *, CAST(coalesce(sum(length * copies) OVER (PARTITION BY side, file ORDER BY record_id, digest
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offs
  FROM entries),
pairs AS (
  SELECT file, record_id, a.offs AS a_offs, b.offs AS b_offs, a.copies AS a_n, b.copies AS b_n, coalesce(a.length, b.length) AS length,
         coalesce(a.length * a.copies, 0) AS a_size, coalesce(b.length * b.copies, 0) AS b_size
  FROM (SELECT * FROM placed WHERE side = 0) a FULL JOIN (SELECT * FROM placed WHERE side = 1) b USING (file, record_id, digest)),
records AS (
  SELECT file, record_id, bool_or(b_offs IS NULL) AS lost, bool_or(a_offs IS NULL) AS gained, bool_or(a_n <> b_n) AS recounted, bool_or(a_offs <> b_offs) AS moved,
         min(a_offs) AS expected_offset, min(b_offs) AS found_offset, min(length) AS length, sum(a_size) AS a_size, sum(b_size) AS b_size
  FROM pairs GROUP BY file, record_id),
sizes AS (SELECT file, CAST(sum(a_size) AS BIGINT) AS a_all, CAST(sum(b_size) AS BIGINT) AS b_all FROM records GROUP BY file),
first AS (
  SELECT file, record_id, coalesce(expected_offset, found_offset) AS start, a_size, b_size FROM records
  WHERE a_size <> b_size QUALIFY row_number() OVER (PARTITION BY file ORDER BY record_id) = 1)
SELECT file, record_id,
       CASE WHEN lost AND gained THEN 'corrupt' WHEN lost THEN 'missing' WHEN gained THEN 'extra'
            WHEN recounted THEN 'copies' ELSE 'moved' END AS status,
       coalesce(expected_offset, -1) AS expected_offset, coalesce(found_offset, -1) AS found_offset, length
FROM records WHERE lost OR gained OR recounted OR moved
UNION ALL
SELECT file, record_id, 'shifted', CAST(start + a_size AS BIGINT), CAST(start + b_size AS BIGINT), b_all - a_all FROM first JOIN sizes USING (file)
"""

# -- fixed values: known licences by identifier, number of words and SHA-256 of the canonical text
LICENSES = """
  ('0BSD', 98, '25a274d52b3014d9bd64e0f3362fd279ac1655f163d5c518f6b9f6c43354802c'),
  ('Apache-2.0', 6, 'eff9e05c9de2ebaf67a47336fef7135676ea38a388048f3f843195d9ee4d2e77'),
  ('Apache-2.0', 8, '28de6b6f31af692f3276f4c7d7f809bc7d39d3206a71fe090d61d943447aabc6'),
  ('Apache-2.0', 86, '7a46cf4a5d56898d746584f4fe57bdf571d600a8f39d21063431d88929f803c7'),
  ('Apache-2.0', 1426, 'cb0c3bd3124478210522e8c821ca588654ce01e22f49f7da61cfbc25668b8487'),
  ('Apache-2.0', 1431, '408d79782772308fe7ec4aeb2f0b2f9a28dcf9246ddcf0755c43e4d3fb4efa11'),
  ('Apache-2.0', 1602, 'b86cc8f4ca3b78dc6187c66567d6089a5911bbe4537e1fa0d5d9c38ce1b3749e'),
  ('Artistic-1.0-Perl', 983, '08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702'),
  ('BSD-2-Clause', 186, 'a56fee4b2f66331ed54da4950ef9c9391453fd1490b4d8ea202bc29683bcbd30'),
  ('BSD-2-Clause', 190, '447686a56472ea2e9713ca89034ee666e6646bd1a33eba38690cb875708663e2'),
  ('BSD-3-Clause', 214, '21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651'),
  ('BSD-3-Clause', 217, '9b83d3dee0616d07b82a272dd9bf5134a9f402b750f5ee6188458073b0a32ff2'),
  ('BSD-3-Clause', 221, 'cc65957a28f15bbcef5b0c23770aae3bd8462cb25904250f77a812ab3b2efe15'),
  ('CC-BY-4.0', 6, '5aee400278b51606c2353a854f7d936ffffe555bf9c67e56d5db376a76b63bb2'),
  ('CC-BY-4.0', 13, '739882eadb4a6a8bfe4c4ac5022cc12964ed5b53809877f195f3eb84af6b55ab'),
  ('CC-BY-NC-4.0', 7, 'e34399ae0e957e9bb9b4a0e3f615d05722861801f4e0718f35cefc762c349a16'),
  ('CC0-1.0', 1088, '96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f'),
  ('GFDL-1.2', 3315, '94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60'),
  ('GFDL-1.3', 3732, 'a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826'),
  ('GPL-1.0', 1636, '89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70'),
  ('GPL-1.0', 1641, '6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc'),
  ('GPL-1.0', 2067, '490a17f9c44b8e7737e6d5b52eebf4c3610f67ee98c4ad515329fa012eebe42d'),
  ('GPL-2.0', 2499, '6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808'),
  ('GPL-2.0', 2504, 'e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34'),
  ('GPL-2.0', 2975, '2d0b5e012e036a2690fe078a56f4c6dabcb7e2c352ef799e5e2074dab15ef4ae'),
  ('GPL-3.0', 12, '37d45dc3b9135ed58bd277e14112dfea95629cda77a8d62cdb6bcd862e7b5bf5'),
  ('GPL-3.0', 5236, '092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191'),
  ('GPL-3.0', 5241, 'ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636'),
  ('GPL-3.0', 5684, 'd83c17395c9a12cd395b7344eeb0d7e93e4ce5c7e6565e5590ba6d2df2f9e9e1'),
  ('GPL-3.0-or-later', 8, '3f5f817483efbffb26e869e09a7c038be5cfefaee344419606b463e6909d08da'),
  ('ISC', 114, 'f172f90a892d869d5d840d5f4363218a9b21bdb1bd3925ba9c752d1660134fee'),
  ('LGPL-2.0', 3860, '430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2'),
  ('LGPL-2.0', 3865, '504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260'),
  ('LGPL-2.0', 4200, '61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908'),
  ('LGPL-2.1', 4060, 'bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df'),
  ('LGPL-2.1', 4065, '48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4'),
  ('LGPL-2.1', 4401, '4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891'),
  ('LGPL-3.0', 1231, 'aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be'),
  ('MIT', 4, '6574b7ebe0cb585e9b2f2c05d1e04a3181922d9bf36edf6c9f6a3cba7bac1564'),
  ('MIT', 5, '00217f00b903e5911b513ea1f36a2aeb7b8999ee6622cd67b2e675f98285e541'),
  ('MIT', 5, '123a3b9fdc300d1b6f077f74b288de15d7f2c5b0b3b11e89fd799b48bfad5940'),
  ('MIT', 163, '0cf21bdfd1964a97a8615e128534845826afbc887edc95aa5c925cbf64386b5c'),
  ('MIT', 165, '35a446201226de6b27cfb7106d0f6c697f63bfeac2913dcf89024911e66ef164'),
  ('MIT', 166, '6ad3654379e72bbdf8478d5c90fb1e2525aba033fbe675e0ef2248aac67c0f6f'),
  ('MIT', 167, '6c833965e9ca4cf8095655005226f24fe8bf7b1605dbe513204837a7371fa127'),
  ('MPL-1.1', 3786, '546c591b5dec7c5c257fd6b4f386c65b8965d9beb247dec35bc0dbe0a9053bee'),
  ('MPL-2.0', 2426, '4cabe7a78fd77da2d52b1a2929bf10219e45cfc14279d76a49774370a74b3d17'),
  ('Unlicense', 190, 'f507d73d343a3d7b0b7ecd39319f6c349b515eeed80b814918af61cdac69e4a5'),
  ('Unlicense', 199, 'e2380bdfe57ca73b01d0b1848a4ee630998d729b260e63082b9267100b4a7229'),
  ('Zlib', 133, '1b8c5cd52eceb19ab0bc3cb40be110b1c0e7fa2671a3fe5866e59dd1502e69c7')
"""

#: A line's canonical words: marks, letters and digits, spellings.
LICENSE_WORDS = r"replace(replace(lower(x), '©', ' copyright '), '(c)', ' copyright ')"
LICENSE_WORDS = rf"regexp_replace({LICENSE_WORDS}, '[^\p{{L}}\p{{N}}]+', ' ', 'g')"
for _spelling, _usual in (
    ("licence", "license"), ("sub license", "sublicense"), ("non commercial", "noncommercial"), ("copyright owner", "copyright holder"),
    ("organisation", "organization"), ("favour", "favor"), ("judgement", "judgment"), ("per cent", "percent"), ("https ", "http "),
):
    LICENSE_WORDS = f"replace({LICENSE_WORDS}, '{_spelling}', '{_usual}')"

ORACLE["op10_licenses"] = rf"""
WITH known(license_id, words, digest) AS (VALUES {LICENSES}),
raw AS (SELECT row_number() OVER () AS r, doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
split AS (SELECT r, doc_id, len(l) AS n, unnest(range(1, len(l) + 1)) AS pos, unnest(l) AS x FROM raw),
cut AS (
  SELECT r, doc_id, n, pos, trim({LICENSE_WORDS}, ' ') AS t
  FROM split
  WHERE NOT (regexp_matches(x, '^[^\p{{L}}\p{{N}}(©]*[Cc][Oo][Pp][Yy][Rr][Ii][Gg][Hh][Tt][\s:]+(\([cC]\)|©|[0-9]{{4}}|<?(yyyy|year))')
          AND NOT regexp_matches(x, '(?i)^[^\p{{L}}\p{{N}}]*copyright\s+(holder|owner|notice|licen[sc]e|law|statement|interest|protection|act\b|and\b|or\b)'))
    AND NOT (regexp_matches(x, '^[^\p{{L}}\p{{N}}(©]*(Copyright|COPYRIGHT)[\s:]+(by |[A-Z<\[{{])')
          AND NOT regexp_matches(x, '(?i)^[^\p{{L}}\p{{N}}]*copyright\s+(holder|owner|notice|licen[sc]e|law|statement|interest|protection|act\b|and\b|or\b)'))
    AND NOT regexp_matches(x, '^[^\p{{L}}\p{{N}}(©]*©') AND NOT regexp_matches(x, '^[^\p{{L}}\p{{N}}(©]*\([cC]\)\s+.*[0-9]{{4}}')
    AND NOT regexp_matches(x, '(?i)^[^\p{{L}}\p{{N}}]*all rights reserved[^\p{{L}}\p{{N}}]*$')),
kept AS (
  SELECT r, doc_id, n, pos, t, w, row_number() OVER (PARTITION BY r ORDER BY pos) AS k, sum(w) OVER (PARTITION BY r ORDER BY pos) AS c
  FROM (SELECT *, len(string_split(t, ' ')) AS w FROM cut WHERE t <> '')),
whole AS (SELECT r, any_value(doc_id) AS doc_id, any_value(n) AS n, list(t ORDER BY pos) AS ts FROM kept GROUP BY r),
runs AS (
  SELECT a.r, a.pos AS line, b.pos - a.pos + 1 AS n_lines, a.k AS i, b.k AS j
  FROM kept a, (SELECT DISTINCT words FROM known) s JOIN kept b ON b.r = a.r AND b.c = a.c - a.w + s.words),
units AS (
  SELECT doc_id, 0 AS line, n AS n_lines, array_to_string(ts, ' ') AS t FROM whole
  UNION ALL
  SELECT doc_id, line, n_lines, array_to_string(ts[i : j], ' ') FROM runs JOIN whole USING (r))
SELECT doc_id, CAST(line AS BIGINT) AS line, CAST(n_lines AS BIGINT) AS n_lines, license_id, digest
FROM (SELECT doc_id, line, n_lines, sha256(t) AS digest FROM units) JOIN (SELECT DISTINCT license_id, digest FROM known) USING (digest)
"""
