"""DuckDB SQL for the queries that it can express. Ids are taken as unique."""

from platewise.llm.quality import PHRASES

WORD = r"[^\x20\x09-\x0D]+"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = f"w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents)"


def windows(width: int, name: str = "g") -> str:
    """Positions, counted from 1, that lie in windows found twice or more; within texts if grouped by doc_id."""
    return f"""{name} AS (SELECT doc_id, i, array_to_string(ws[i:i + {width - 1}], ' ') AS gram FROM w, unnest(range(1, len(ws) - {width - 2})) AS t(i) WHERE len(ws) >= {width})"""


def covered(width: int, key: str) -> str:
    return f"""twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY {key}) AS n FROM g) WHERE n > 1),
hit AS (SELECT DISTINCT doc_id, i + k AS i FROM twice, unnest(range({width})) AS t(k))"""


SPACE = r"[ \t\x0b\f\r]"
STOP = "[.!?…。！？؟।]"
SEPARATORS = "('|', '>', '<', '/', chr(92), '-', '*', '•', '·', '»', '«', '›', '–')"

QUALITY = rf"""WITH {WORDS}, {windows(5)}, {covered(5, "doc_id, gram")},
again AS (SELECT doc_id, count(*) AS n_repeat_words FROM hit GROUP BY 1),
l AS (SELECT doc_id, line, regexp_extract_all(line, '{WORD}') AS lw FROM documents, unnest(string_split(coalesce(text, ''), chr(10))) AS t(line) WHERE regexp_matches(line, '{WORD}')),
f AS (SELECT *, regexp_matches({LOWER.format("line")}, '{"|".join(PHRASES)}')
  OR len(list_filter(lw, lambda x: x IN {SEPARATORS})) = len(lw) OR (len(lw) >= 3 AND 4 * len(list_filter(lw, lambda x: x IN {SEPARATORS})) >= len(lw))
  OR 4 * len(regexp_extract_all(line, '[#*$%&|<>](?:{SPACE}|$)')) >= len(lw)
  OR NOT (regexp_matches(line, '{STOP}["''”’»)\]\x20\t\x0b\f\r]*$') OR regexp_matches(line, '{STOP}["'')\]”’»]*(?:{SPACE}|$)')) AS failed FROM l),
s AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dup, count_if(failed) AS failed, coalesce(sum(len(lw)) FILTER (NOT failed), 0) AS words_left FROM f GROUP BY 1),
d AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
  coalesce(failed, 0)::BIGINT AS n_failed_lines, (len(ws) - coalesce(words_left, 0))::BIGINT AS n_lost_words
  FROM w JOIN documents USING (doc_id) LEFT JOIN s USING (doc_id) LEFT JOIN again USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 2 * n_lost_words <= n_words AND n_words - n_lost_words >= 10 AS kept FROM d"""

URLS = """WITH rule_list(h, p, v) AS (VALUES {rules}),
u AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') = 0 THEN '' ELSE regexp_extract(substr(url, instr(url, '://') + 3), '^[^?#]*') END AS hp FROM pages),
x AS (SELECT page_id, {lower} AS host, substr(hp, length(regexp_extract(hp, '^[^/]*')) + 1) AS path FROM u),
m AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict FROM x JOIN rule_list ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY 1)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM x LEFT JOIN m USING (page_id)"""


def urls(rules: list[tuple[str, str, str]]) -> str:
    return URLS.format(rules=", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules), lower=LOWER.format("regexp_extract(hp, '^[^/]*')"))


PASSAGES = f"""WITH {WORDS}, {windows(35)}, {covered(35, "gram")},
e AS (SELECT doc_id, i, ws[i] AS word FROM w, unnest(range(1, len(ws) + 1)) AS t(i)),
k AS (SELECT e.doc_id, count(hit.i) AS gone, string_agg(word, ' ' ORDER BY e.i) FILTER (hit.i IS NULL) AS kept FROM e LEFT JOIN hit USING (doc_id, i) GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)"""

NEAR = f"""WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{WORD}') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS gram FROM w, unnest(range(1, greatest(len(ws) - 3, 2))) AS t(i) WHERE len(ws) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a AS doc_id, least(a, min(b)) AS low FROM r GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(low, doc_id) AS component_id, coalesce(low, doc_id) = doc_id AS kept FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""

NEGATIVES = """WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS a, c.vec_id AS c, a.label = c.label AS same, list_dot_product(a.q, c.q)::BIGINT AS score FROM v a, v c WHERE a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT a, c, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, c) <= 5),
n AS (SELECT p.a AS anchor_id, p.c AS positive_id, row_number() OVER (PARTITION BY p.a, p.c ORDER BY s.score DESC, s.c)::INTEGER AS rank, s.c AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON p.a = s.a AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT * FROM n WHERE rank <= 10"""


# Unsigned CRC-32 of a text of single-byte characters, bit by bit.
CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({}, ''), lambda s: ascii(s)::BIGINT)),
  lambda crc, byte: list_reduce([xor(crc, byte), 1, 1, 1, 1, 1, 1, 1, 1], lambda x, _: xor(x >> 1, 3988292384 * (x & 1)))))"""

TRIE = f"""WITH w AS MATERIALIZED (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS p FROM conversations WHERE conv_id IS NOT NULL),
own AS MATERIALIZED (SELECT c, count(*) AS n, c - c % 5 AS base, {CRC32.format("c::VARCHAR")} % 9 AS h FROM w GROUP BY c),
k AS MATERIALIZED (SELECT a.c, a.h, a.base, least(a.h, coalesce(b.n, 0)) AS opens FROM own a LEFT JOIN own b ON b.c = a.base),
r AS (SELECT w.c, p - h + opens AS d, role, text FROM w JOIN k ON k.c = w.c WHERE p > h UNION ALL SELECT k.c, p, role, text FROM k JOIN w ON w.c = k.base AND p <= opens),
x AS MATERIALIZED (SELECT c, d, octet_length(encode(text)) AS size, string_agg(md5(role) || md5(text), '') OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING) AS key FROM r UNION ALL SELECT c, 0, 0, '' FROM k),
z AS (SELECT c, max(d) AS length FROM x GROUP BY c),
n AS MATERIALIZED (SELECT d AS depth, key, min(c) AS conv_id, count(*) AS n_convs, any_value(size) AS size, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (d = length), '') AS ends FROM x JOIN z USING (c) GROUP BY 1, 2),
e AS (SELECT depth - 1 AS depth, left(key, length(key) - 64) AS key, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1, 2),
s AS MATERIALIZED (SELECT n.*, coalesce(n_children, 0)::BIGINT AS n_children FROM n LEFT JOIN e USING (depth, key)),
t AS (SELECT a.key, count_if(b.n_children = 0)::BIGINT AS n_leaves, sum((b.n_convs - 1) * b.size)::BIGINT AS saved_tokens FROM s a JOIN s b ON starts_with(b.key, a.key) GROUP BY 1)
SELECT s.conv_id, s.depth, p.conv_id AS parent_conv_id, s.n_convs, s.n_children, n_leaves, saved_tokens, sha256(s.ends) AS ends_sha256
FROM s JOIN t USING (key) LEFT JOIN n p ON p.depth = s.depth - 1 AND p.key = left(s.key, length(s.key) - 64)"""
