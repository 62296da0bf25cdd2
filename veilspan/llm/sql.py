"""DuckDB equivalents of the queries that SQL can express."""

MIXING = """
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS source, row_number() OVER (PARTITION BY coalesce(source, '')
    ORDER BY md5(coalesce(doc_id::VARCHAR, ''))) - 1 AS n FROM documents),
u AS (SELECT source, CASE source {cases} ELSE {default} END::BIGINT AS units FROM (SELECT DISTINCT source FROM d)),
m AS (SELECT *, row_number() OVER (PARTITION BY units ORDER BY source) - 1 AS turn, count(*) OVER (PARTITION BY units) AS members FROM u),
c AS (SELECT units, (count(*) * units)::BIGINT AS total FROM u WHERE units > 0 GROUP BY units),
s AS (SELECT list(units ORDER BY units) AS names, list(total ORDER BY units) AS us, sum(total)::BIGINT AS h FROM c),
edf AS (
  SELECT 0::BIGINT AS t, list_transform(us, lambda x: 0::BIGINT) AS done, 0::BIGINT AS p, names, us, h FROM s
  UNION ALL
  SELECT t + 1, list_transform(done, lambda x, i: CASE WHEN i = q THEN x + 1 ELSE x END), q, names, us, h FROM (
    SELECT *, (list_sort(list_filter(list_transform(done, lambda x, i: [CASE WHEN x < us[i] AND (x * h) // us[i] <= t THEN 0 ELSE 1 END,
       ((x + 1) * h + us[i] - 1) // us[i], CASE WHEN (x + 1) * h % us[i] = 0 THEN 1 ELSE 0 END, i]), lambda c: c[1] = 0))[1])[4] AS q
    FROM edf WHERE t < h)),
plan AS (SELECT names[p] AS units, us[p] AS total, h, t - 1 AS at, row_number() OVER (PARTITION BY names[p] ORDER BY t) - 1 AS idx FROM edf WHERE p > 0),
heads AS (SELECT DISTINCT units, total, h FROM plan),
b AS (SELECT d.*, n // {block} AS block, m.units, m.turn, m.members, (n // {block}) * members + turn AS own, total, h FROM d JOIN m USING (source) LEFT JOIN heads ON heads.units = m.units)
SELECT b.doc_id, b.source, b.n AS n_in_source, b.block AS block, (own // b.total) * b.h + plan.at AS slot,
  b.block * b.h // b.units AS release, ((b.block + 1) * b.h + b.units - 1) // b.units AS deadline
FROM b LEFT JOIN plan ON plan.units = b.units AND plan.idx = b.own % b.total
"""


def mixing(units: dict[str, int], default: int, block: int) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in units.items())
    return MIXING.format(cases=cases, default=default, block=block)


# words of the whole text; firsts: the smallest document of each 50-word window
SUBSTRING = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 49 + 1, 1))) AS i FROM w)),
firsts AS (SELECT k, min(doc_id) AS f FROM win GROUP BY k),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT win.doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN firsts USING (k) WHERE f < win.doc_id) GROUP BY doc_id),
o AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
g AS (SELECT doc_id, unnest(ps) AS p FROM gone),
k AS (SELECT o.doc_id, string_agg(word, ' ' ORDER BY o.p) AS kept, count(*) AS n FROM o LEFT JOIN g ON o.doc_id = g.doc_id AND o.p = g.p WHERE g.p IS NULL GROUP BY o.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON w.doc_id = k.doc_id
"""

# the template: <turn ROLE>, newline, escaped text, </turn>, newline
CHAT = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(replace(replace(text, '\', '\b'), '<turn', '\lturn'), '</turn', '\l/turn'), '###', '\h') AS esc FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(role) + length(esc) + 16)::BIGINT AS formatted_chars FROM e GROUP BY conv_id
"""

# words of whole texts; a line counts once for each distinct text of its host
QUALITY = r"""
WITH d AS (SELECT doc_id, coalesce('=' || source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (SELECT doc_id, i, md5(ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT doc_id, k FROM g GROUP BY doc_id, k HAVING count(*) > 1),
rw AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT g.doc_id, unnest([i, i + 1, i + 2]) AS p FROM g JOIN r ON g.doc_id = r.doc_id AND g.k = r.k) GROUP BY doc_id),
l AS (SELECT doc_id, host, md5(t) AS tk, unnest(string_split(t, chr(10))) AS line FROM d),
n AS (SELECT *, array_to_string(regexp_extract_all(lower(line), '[^\x20\x09-\x0D]+'), ' ') AS norm, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words
  FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dl AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM n GROUP BY doc_id),
hosts AS (SELECT host, count(DISTINCT t) AS docs FROM d GROUP BY host),
often AS (SELECT n.host, norm FROM n GROUP BY n.host, norm HAVING count(DISTINCT tk) > {line_docs}
  AND count(DISTINCT tk) > {line_share} * (SELECT docs FROM hosts WHERE hosts.host = n.host)),
gone AS (SELECT doc_id, sum(words) AS n FROM n JOIN often ON n.host = often.host AND n.norm = often.norm GROUP BY doc_id),
c AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  coalesce(rw.n, 0)::BIGINT AS n_repeat_words, coalesce(dl.n, 0)::BIGINT AS n_dup_lines, coalesce(gone.n, 0)::BIGINT AS n_removed_words
  FROM w LEFT JOIN rw ON rw.doc_id = w.doc_id LEFT JOIN dl ON dl.doc_id = w.doc_id LEFT JOIN gone ON gone.doc_id = w.doc_id)
SELECT d.doc_id, n_words, word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, n_dup_lines, n_repeat_words,
  n_words < {min_words} OR 100 * n_repeat_words > {max_repeat} * n_words AS base_failed,
  NOT (n_words < {min_words} OR 100 * n_repeat_words > {max_repeat} * n_words) AND n_words - n_removed_words >= {depleted} * n_words AS kept, n_removed_words
FROM d JOIN c ON c.doc_id = d.doc_id
"""

# unsigned crc32 of UTF-8: one table step per byte; the table follows from the polynomial
CRC = r"""
powers AS (SELECT list(t ORDER BY i) AS crc FROM (SELECT i, list_reduce(list_concat([i::UBIGINT], range(8)::UBIGINT[]), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END) AS t
  FROM (SELECT unnest(range(256)) AS i)))
"""
_CRC_OF = r"""xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(range(octet_length(encode({s}))), lambda b: ('0x' || substr(hex(encode({s})), 2 * b::INT + 1, 2))::UBIGINT)),
  lambda c, b: xor(c // 256, crc[(xor(c, b) % 256)::INT + 1])), 4294967295::UBIGINT)"""
_FIELD = "coalesce(octet_length(encode({v}::VARCHAR)) || ':' || {v}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(v=v) for v in ("doc_id", "source", "lang", "{chars}", "text")) + ")"

# trees level by level (of languages, then of their roots), and each leaf's way up
MERKLE = f"""
WITH RECURSIVE {CRC},
d AS (SELECT doc_id, lang, coalesce('=' || lang, '') AS tree, {_LEAF.format(chars='n_chars')} AS leaf,
  CASE WHEN n_chars IS NOT NULL AND {_CRC_OF.format(s='doc_id::VARCHAR')} % 7 = 0 THEN {_LEAF.format(chars='(n_chars + 1)')} END AS changed FROM documents, powers),
l AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM d),
up AS (SELECT tree, 0 AS level, idx, n, leaf AS digest, lead(leaf) OVER (PARTITION BY tree ORDER BY idx) AS after FROM l UNION ALL
  SELECT tree, level + 1, idx // 2, (n + 1) // 2, sha256(digest || CASE WHEN idx + 1 < n THEN after ELSE '' END),
    lead(sha256(digest || CASE WHEN idx + 1 < n THEN after ELSE '' END)) OVER (PARTITION BY tree ORDER BY idx) FROM (SELECT * FROM up WHERE n > 1 AND idx % 2 = 0)),
roots AS (SELECT tree, digest, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (SELECT 0 AS level, idx, n, digest, lead(digest) OVER (ORDER BY idx) AS after FROM roots UNION ALL
  SELECT level + 1, idx // 2, (n + 1) // 2, sha256(digest || CASE WHEN idx + 1 < n THEN after ELSE '' END),
    lead(sha256(digest || CASE WHEN idx + 1 < n THEN after ELSE '' END)) OVER (ORDER BY idx) FROM (SELECT * FROM top WHERE n > 1 AND idx % 2 = 0)),
way AS (SELECT doc_id, tree, leaf, 0 AS level, idx AS place, '' AS path, coalesce(changed, leaf) AS folded FROM l UNION ALL
  SELECT way.doc_id, way.tree, leaf, way.level + 1, place // 2, path || coalesce(s.digest, ''), sha256(CASE WHEN place % 2 = 1 THEN s.digest || folded ELSE folded || coalesce(s.digest, '') END)
  FROM way JOIN (SELECT DISTINCT tree, level, n FROM up WHERE n > 1) h ON h.tree = way.tree AND h.level = way.level LEFT JOIN up s ON s.tree = way.tree AND s.level = way.level AND s.idx = xor(place, 1)),
low AS (SELECT way.* FROM way JOIN up ON up.tree = way.tree AND up.n = 1 AND up.level = way.level),
far AS (SELECT low.doc_id, low.tree, leaf, roots.digest AS subroot, 0 AS level, roots.idx AS place, path, folded FROM low JOIN roots ON roots.tree = low.tree UNION ALL
  SELECT far.doc_id, far.tree, leaf, subroot, far.level + 1, place // 2, path || coalesce(s.digest, ''), sha256(CASE WHEN place % 2 = 1 THEN s.digest || folded ELSE folded || coalesce(s.digest, '') END)
  FROM far JOIN (SELECT DISTINCT level, n FROM top WHERE n > 1) h ON h.level = far.level LEFT JOIN top s ON s.level = far.level AND s.idx = xor(place, 1))
SELECT far.doc_id, leaf, subroot, top.digest AS root, sha256(path) AS proof_sha256, folded AS folded_root, folded = top.digest AS verified
FROM far JOIN top ON top.n = 1 AND top.level = far.level
"""

# near words meet by one code point left out (replaced: at the same place)
SPELLING = f"""
WITH RECURSIVE {CRC},
d AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]{{6,}}')) AS run FROM documents),
c AS (SELECT id || ':' || run AS s, run, count(*) AS k FROM d GROUP BY 1, 2),
h AS (SELECT run, k, {_CRC_OF.format(s='s')} AS h FROM c, powers),
r AS (SELECT CASE WHEN h % 199 = 0 THEN substring(run, 1, (h % length(run))::INT) || substring(run, (h % length(run))::INT + 2) ELSE run END AS word, k FROM h),
w AS (SELECT word, sum(k)::BIGINT AS n FROM r WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
v AS (SELECT word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT a.word, b.word AS near, b.n AS k FROM v a JOIN v b ON a.less = b.less AND a.i = b.i AND length(a.word) = length(b.word) AND a.word <> b.word
  UNION SELECT v.word, w.word, w.n FROM v JOIN w ON v.less = w.word UNION SELECT w.word, v.word, v.n FROM v JOIN w ON v.less = w.word),
b AS (SELECT word, count(*) AS n_near, max(k) AS k, arg_min(near, (-k, near)) AS near FROM p GROUP BY word),
f AS (SELECT w.word, CASE WHEN b.k >= 5 * w.n THEN b.near END AS form, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN b.k >= 5 * w.n THEN b.k END AS form_n FROM w LEFT JOIN b ON b.word = w.word),
roots AS (SELECT word, word AS root, form FROM f UNION ALL SELECT roots.word, f.word, f.form FROM roots JOIN f ON roots.form = f.word)
SELECT f.word, f.form, roots.root, n, n_near, form_n FROM f JOIN roots ON roots.word = f.word AND roots.form IS NULL
"""

WARC = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id) AS k, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
h AS (SELECT *, sha1(html) AS s FROM p)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(s, (5 * (i // 4) + 1)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN first END AS refers_to, true AS intact FROM h
"""
