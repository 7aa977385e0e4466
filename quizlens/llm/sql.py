"""DuckDB SQL for the queries that SQL can express."""

from quizlens.llm.common import LOWER, UPPER
from quizlens.llm.quality import STOP_WORDS
from quizlens.llm.urls import HOST_RULES, PATTERN_RULES

SHARD_BYTES = 16 * 2**20
WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"
_stop = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
_rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in HOST_RULES)
_patterns = " OR ".join(f"regexp_matches(host || path, '{p}')" for p, _ in PATTERN_RULES)

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
MERKLE_LEVELS = 7       # 8 ** 7 rows of one language


def _merkle_sql():
    def leaf(names):
        parts = (f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in names)
        return f"sha256({' || '.join(parts)})"

    def levels(prefix, tree):
        """Per level: each node with its run's other digests and the node above it."""
        for k in range(MERKLE_LEVELS):
            yield f"""{prefix}_run{k} AS (
  SELECT *, coalesce(string_agg(h, '') OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(h, '') OVER (r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS g,
    count(*) OVER (PARTITION BY {tree}) > 1 AS more
  FROM {prefix}{k} WINDOW r AS (PARTITION BY {tree}, pos // 8 ORDER BY pos)
), {prefix}{k + 1} AS (
  SELECT {tree}, up AS pos, CASE WHEN any_value(more) THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE any_value(h) END AS h
  FROM (SELECT {tree}, pos, h, more, CASE WHEN more THEN pos // 8 ELSE pos END AS up FROM {prefix}_run{k}) GROUP BY {tree}, up
)"""

    def climb(prefix, tree, start):
        """The rows of ``start`` (with ``pos``, ``cur``, ``proof``) carried up all levels."""
        for k in range(MERKLE_LEVELS):
            yield f"""{prefix}_up{k + 1} AS (
  SELECT f.* REPLACE (CASE WHEN more THEN f.pos // 8 ELSE f.pos END AS pos,
    CASE WHEN more THEN sha256(l || cur || g) ELSE cur END AS cur, proof || CASE WHEN more THEN l || g ELSE '' END AS proof)
  FROM {start if k == 0 else f'{prefix}_up{k}'} f JOIN {prefix}_run{k} n ON n.{tree} IS NOT DISTINCT FROM f.{tree} AND n.pos = f.pos
)"""

    tampered = f"CASE WHEN {_crc('doc_id')} % 3 = 0 THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END"
    return f"""
WITH leaves AS (
  SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, {leaf(FIELDS)} AS h,
    {leaf((*FIELDS[:4], f'({tampered})'))} AS given FROM documents
), a0 AS (SELECT lang, pos, h FROM leaves), {', '.join(levels('a', 'lang'))},
b0 AS (SELECT 0 AS one, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, h, lang FROM a{MERKLE_LEVELS}),
{', '.join(levels('b', 'one'))},
start AS (SELECT doc_id, lang, pos, h AS leaf, given AS cur, '' AS proof FROM leaves),
{', '.join(climb('a', 'lang', 'start'))},
inner_done AS (
  SELECT f.doc_id, f.leaf, b0.h AS subroot, 0 AS one, b0.pos, f.cur, f.proof
  FROM a_up{MERKLE_LEVELS} f JOIN b0 ON b0.lang IS NOT DISTINCT FROM f.lang
), {', '.join(climb('b', 'one', 'inner_done'))}
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = h AS verified
FROM b_up{MERKLE_LEVELS} CROSS JOIN (SELECT h FROM b{MERKLE_LEVELS})
"""


def _crc(value):
    """crc32 of an ASCII text, bit by bit: each sign is taken in, then eight shifts (-1) follow."""
    signs = f"flatten(list_transform(string_split({value}::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    step = "CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {signs}), lambda c, x: {step}), 4294967295)"


ORACLE_SQL = {
    "op2_sharding": f"""
WITH sized AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents
), levels AS (
  SELECT d, h >> (60 - d)::INTEGER AS prefix, sum(n_bytes)::BIGINT AS bytes,
         sum(n_bytes) > {SHARD_BYTES} AND count(*) > 1 AS over
  FROM sized, (SELECT unnest(range(0, 31))::INTEGER AS d) GROUP BY ALL
), placed AS (
  SELECT doc_id, n_bytes, h, min(d) AS depth FROM sized JOIN levels ON prefix = h >> (60 - d)::INTEGER AND NOT over
  GROUP BY ALL
)
SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), depth, '0') END AS shard, depth,
       bytes AS shard_bytes
FROM placed JOIN levels ON d = depth AND prefix = h >> (60 - depth)::INTEGER
""",
    "op3_near_dedup": f"""
WITH RECURSIVE worded AS (
  SELECT doc_id, {WORDS.format(f"translate(text, '{UPPER}', '{LOWER}')")} AS w FROM documents
), shingled AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM worded
), sizes AS (SELECT doc_id, count(*) AS n FROM shingled GROUP BY ALL),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM shingled a JOIN shingled b ON a.s = b.s AND a.doc_id < b.doc_id
  GROUP BY ALL
), links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * k >= 75 * (p.n + q.n - k)
), both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x
), low AS (SELECT x, min(y) AS component_id FROM reach GROUP BY ALL)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN low ON x = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
""",
    "op4_url_filters": f"""
WITH parsed AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages
), rules(verdict, h, p) AS (VALUES {_rules}),
found AS (
  SELECT host, path, arg_max(h || p, len(h || p)) AS rule, arg_max(verdict, len(h || p)) AS verdict
  FROM (SELECT DISTINCT host, path FROM parsed) JOIN rules
    ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY ALL
)
SELECT page_id, host, path, rule,
       coalesce(verdict, CASE WHEN {_patterns} THEN 'block' ELSE 'allow' END) AS verdict
FROM parsed LEFT JOIN found USING (host, path)
""",
    "op8_quality_rules": rf"""
WITH worded AS (
  SELECT doc_id, coalesce(text, '') AS t, {WORDS.format('text')} AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), windows AS (
  SELECT doc_id, i, w[i:i + 2] AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM worded)
), twice AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY ALL
), base AS (
  SELECT worded.doc_id, t, w, lines, len(w)::BIGINT AS n_words, len(array_to_string(w, ''))::BIGINT AS word_chars,
    (len(t) - len(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
    CASE WHEN regexp_matches(t, '[A-Z\x{{C0}}-\x{{DE}}]{{2}}')
      THEN len(list_filter(w, lambda x: len(x) > 1 AND regexp_matches(x, '^[^\p{{Ll}}]*\p{{Lu}}[^\p{{Ll}}]*$'))) ELSE 0 END AS capitals,
    len(list_filter(w, lambda x: lower(rtrim(x, '.,;:!?')) IN ({_stop}))) AS stops,
    len(list_filter(lines, lambda x: substr(ltrim(x, ' '), 1, 1) IN ('-', '*', '•', '|'))) AS bullets,
    len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) AS cuts
  FROM worded LEFT JOIN covered ON covered.doc_id = worded.doc_id
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, len(lines) AS n_lines FROM base
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (word_chars < 2.5 * n_words OR word_chars > 12 * n_words OR n_symbols > 0.1 * n_words
    OR capitals > 0.5 * n_words OR stops < 0.02 * n_words OR n_dup_lines > 0.4 * n_lines
    OR bullets > 0.9 * n_lines OR cuts > 0.3 * n_lines) AS kept
FROM judged
""",
    "op11_mixing": rf"""
WITH sized AS (
  SELECT doc_id, source, len({WORDS.format('text')})::BIGINT AS size,
    md5(concat_ws(chr(31), coalesce(doc_id::VARCHAR, '-'), coalesce(source, '-'), coalesce(text, '-'))) AS h FROM documents
), weighed AS (
  SELECT source, source_size::HUGEINT AS source_size,
    [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::HUGEINT AS w
  FROM (SELECT source, sum(size) AS source_size FROM sized GROUP BY source)
), filled AS (
  SELECT sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER before, 0) AS rest,
    sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS open_, source_size, w FROM weighed
  WINDOW before AS (ORDER BY source_size::DOUBLE / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), share AS (
  SELECT rest, open_ FROM filled WHERE 3 * source_size * open_ >= w * rest ORDER BY open_ DESC LIMIT 1
), rates AS (
  SELECT source, source_size, w * rest > 3 * source_size * open_ AS full_, CASE WHEN full_ THEN 3 ELSE w * rest END::HUGEINT AS num,
    CASE WHEN full_ THEN 1 ELSE source_size * open_ END::HUGEINT AS den,
    CASE WHEN full_ THEN (3 * source_size)::DOUBLE ELSE (w * rest)::DOUBLE / open_::DOUBLE END AS target,
    ('0x' || substr(md5('mix' || coalesce('=' || source, '')), 1, 15))::BIGINT::HUGEINT AS drawn
  FROM weighed, share
), placed AS (
  SELECT doc_id, size, r.*, (row_number() OVER (
    PARTITION BY s.source ORDER BY CASE WHEN h < '8' THEN size ELSE 1099511627776 - size END, h) - 1)::HUGEINT AS i
  FROM sized s JOIN rates r ON r.source IS NOT DISTINCT FROM s.source
)
SELECT doc_id, size, source_size::BIGINT AS source_size, target,
  (CASE WHEN source_size = 0 THEN 0 ELSE size * (((i + 1) * num + drawn % den) // den - (i * num + drawn % den) // den) END)::BIGINT AS taken
FROM placed
""",
    "op12_merkle_manifest": _merkle_sql(),
    "op13_phrases": rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM (
    SELECT lang, unnest(regexp_split_to_array(translate(text, '{UPPER}', '{LOWER}'), '[.,;:!?
-
]')) AS piece FROM documents)
), counted AS (
  SELECT lang, words, array_to_string(w[i:i + words - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, words, unnest(range(1, len(w) - words + 2)) AS i FROM pieces, (SELECT unnest([1, 2, 3]) AS words))
  GROUP BY ALL
), totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counted WHERE words = 1 GROUP BY lang),
candidates AS (SELECT *, string_split(phrase, ' ') AS w FROM counted WHERE words > 1 AND f >= 10),
covered AS (
  SELECT lang, phrase, max(f) AS longer FROM (
    SELECT lang, f, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM candidates WHERE words = 3)
  GROUP BY ALL
), cuts AS (
  SELECT c.*, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail
  FROM candidates c LEFT JOIN covered v ON v.lang = c.lang AND v.phrase = c.phrase, (SELECT unnest([1, 2]) AS k)
  WHERE k < words AND (longer IS NULL OR 100 * longer < 50 * c.f)
), scored AS (
  SELECT c.lang, c.phrase, c.f AS a, x.f AS l, y.f AS r, n,
    ((1000000::HUGEINT * c.f * c.f) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN counted x ON x.lang = c.lang AND x.phrase = head JOIN counted y ON y.lang = c.lang AND y.phrase = tail
    JOIN totals t ON t.lang = c.lang
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM scored QUALIFY rank <= 2000
""",
}
