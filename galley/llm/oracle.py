"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from galley.llm.license_rules import CONFIDENCE, rule_rows

ORACLE: dict[str, str] = {}


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _license_sql() -> str:
    """The license scan. The list of rules is the operator's own; what is done with it is not.

    Every word stands between two spaces of its own, so that a pattern may take the edges of its
    words along: these regular expressions cannot look around.
    """
    rules = ",\n".join(
        f"({k}, {base}, {priority}, {_text(label)}, {_text(keyword)}, {_text(' (?:' + pattern.replace(' ', '  ') + ') ')})"
        for k, base, priority, label, keyword, pattern, _ in rule_rows()
    )
    sure = " ".join(f"WHEN {level} THEN {value}" for level, value in CONFIDENCE.items())
    return rf"""
WITH rules(rule, base, priority, label, keyword, pattern) AS (VALUES {rules}),
docs AS (
  SELECT row_number() OVER () AS k, doc_id,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words
  FROM documents
), spaced AS (
  SELECT k, ' ' || array_to_string(words, '  ') || ' ' AS held, array_to_string(words, ' ') AS plain FROM docs
), found AS (
  SELECT k, rule, base, priority, label, regexp_extract_all(held, pattern) AS hits, string_split_regex(held, pattern) AS gaps
  FROM (SELECT * FROM spaced WHERE regexp_matches(plain, 'licen|spdx| under ')) JOIN rules ON contains(plain, keyword)
), numbered AS (
  SELECT k, rule, base, priority, label, unnest(hits) AS hit, unnest(gaps[1:len(hits)]) AS gap,
         unnest(range(1, len(hits) + 1)) AS pos
  FROM found WHERE len(hits) > 0
), counted AS (
  SELECT *, (length(hit) - length(replace(hit, ' ', ''))) // 2 AS n_hit,
         (length(gap) - length(replace(gap, ' ', ''))) // 2 AS n_gap
  FROM numbered
), places AS (
  SELECT *, head + n_hit - 1 AS tail FROM (
    SELECT *, CAST(sum(n_gap + n_hit) OVER (PARTITION BY k, rule ORDER BY pos) - n_hit AS BIGINT) AS head FROM counted)
), kept AS (
  SELECT * FROM places p WHERE NOT EXISTS (
    SELECT 1 FROM places o WHERE o.k = p.k AND o.head <= p.head AND o.tail >= p.tail AND o.priority >= p.priority
      AND (o.rule <> p.rule OR o.pos <> p.pos)
      AND (o.priority > p.priority OR o.tail - o.head > p.tail - p.head OR o.rule < p.rule))
), base AS (
  SELECT k, count(*) AS n_base, min(head) AS first_word, max(head) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
  FROM places WHERE base GROUP BY k
), labels AS (
  SELECT k, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT k, label FROM kept UNION SELECT k, label FROM places WHERE base) GROUP BY k
), scores AS (SELECT k, max(CASE priority {sure} END) AS score FROM kept GROUP BY k)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM docs LEFT JOIN base USING (k) LEFT JOIN labels USING (k) LEFT JOIN scores USING (k)
"""


ORACLE["op7_license_rules"] = _license_sql()

# The checksum of the decimal id is worked out bit by bit; 3988292384 is the polynomial of crc32.
ORACLE["op11_prefix_trie"] = r"""
WITH turns AS (
  SELECT conv_id, turn, octet_length(encode(coalesce(text, ''))) AS bytes,
         md5(CAST(octet_length(encode(coalesce(role, ''))) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS mark
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list(mark ORDER BY turn NULLS FIRST, mark) AS own FROM turns GROUP BY conv_id
), steps AS (
  SELECT conv_id, own, list_concat([4294967295], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
    lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1]))) AS steps
  FROM own
), lengths AS (
  SELECT conv_id, own, CAST(xor(CAST(list_reduce(steps, lambda a, x:
    CASE WHEN x >= 0 THEN xor(CAST(a AS BIGINT), CAST(x AS BIGINT)) ELSE xor(CAST(a AS BIGINT) >> 1, 3988292384 * (CAST(a AS BIGINT) & 1)) END)
    AS BIGINT), 4294967295) % 9 AS BIGINT) AS h
  FROM steps
), paths AS (
  SELECT l.conv_id, list_concat(coalesce(r.own, [])[1:h], l.own[h + 1:]) AS path
  FROM lengths l LEFT JOIN own r ON r.conv_id = l.conv_id - l.conv_id % 5
), members AS (
  SELECT conv_id, len(path) AS n, unnest(range(0, len(path) + 1)) AS depth, path FROM paths
), nodes AS (
  SELECT path[1:depth] AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
  FROM members GROUP BY ALL
), sizes AS (SELECT mark, max(bytes) AS bytes FROM turns GROUP BY mark),
parents AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
valued AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * coalesce(bytes, 0) AS saved
  FROM nodes n LEFT JOIN parents p ON p.path = n.path LEFT JOIN sizes s ON s.mark = n.path[len(n.path)]
), above AS (
  SELECT path[1:a] AS path, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT path, n_children, saved, unnest(range(0, depth + 1)) AS a FROM valued) GROUP BY ALL
)
SELECT v.conv_id, v.depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, v.ends_sha256
FROM valued v JOIN above a ON a.path = v.path LEFT JOIN nodes p ON v.depth > 0 AND p.path = v.path[1:v.depth - 1]
"""

ORACLE["op12_norm_buckets"] = r"""
WITH vectors AS (
  SELECT row_number() OVER () AS k, vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v) AS score,
         row_number() OVER (PARTITION BY q.k ORDER BY list_dot_product(q.v, c.v) DESC, c.vec_id, c.k) AS rank
  FROM vectors q JOIN vectors c ON q.k <> c.k WHERE q.vec_id % 50 = 0
) WHERE rank <= 5
"""
