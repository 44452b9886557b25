"""DuckDB SQL of the queries that SQL can express."""

WORDS = "list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"

OP5 = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN url IS NOT NULL AND strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), urls AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
), rules(v, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), best AS (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict
  FROM urls JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM urls LEFT JOIN best USING (page_id)
"""

OP7 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), esc AS (
  SELECT *, length(regexp_replace(r || chr(0) || t, '((?:<s|</s|\[INST|\[/INST|<<SYS>|<</SYS>|<\|(?:turn|body|image|audio|document|other)\|)\\*)([>\]])', '\1\\\2', 'g')) - 1 AS n FROM turns
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn, r, t)) AS turns_sha256,
  CAST(coalesce(sum(length(t)) FILTER (r = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn, r, t) FILTER (r = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(n + 8 + 8 + 4) AS BIGINT) AS formatted_chars, CAST(0 AS BIGINT) AS expanded_tokens
FROM esc GROUP BY conv_id
"""

OP9 = r"""
WITH norm AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM norm WINDOW w AS (PARTITION BY t)
"""

OP10 = rf"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t, {WORDS} AS ws FROM documents
), m AS (
  SELECT doc_id, host, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w
), g AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n
  FROM (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w))
), rep AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM g, (VALUES (0), (1), (2)) o(k) WHERE n > 1 GROUP BY doc_id
), d AS (
  SELECT doc_id, host, n_words, word_chars, n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, len(ls) AS n_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM m LEFT JOIN rep USING (doc_id)
), j AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 50 * n_words OR 100 * n_dup_lines > 50 * n_lines AS failed FROM d
), h AS (SELECT host, count(*) AS n, count(*) FILTER (failed) AS k FROM j GROUP BY host
), prior AS (SELECT avg(k / n) AS mu, var_pop(k / n) AS v FROM h
), weight AS (SELECT mu, least(greatest(CASE WHEN v > 0 THEN mu * (1 - mu) / v - 1 ELSE 1000 END, 1), 1000) AS wt FROM prior
), rates AS (SELECT host, (k + mu * wt) / (n + wt) AS fail_rate FROM h, weight)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND fail_rate <= 0.5 AS kept, host, fail_rate
FROM j JOIN rates USING (host)
"""



#: The given pages mark their one article and end its blocks with h1 and p tags.
OP11 = r"""
WITH a AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|$)', 1) AS inner_html FROM pages
), b AS (
  SELECT page_id, url, list_transform(string_split_regex(inner_html, '</?(?:h1|p)>'), lambda x: regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '<[^>]*>', '', 'g')) AS raw FROM a
), c AS (
  SELECT page_id, url, list_transform(raw, lambda x: replace(replace(replace(replace(regexp_replace(regexp_replace(x,
    '&quot;?', '"', 'g'), '&#x27;', chr(39), 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '&amp', '&')) AS read FROM b
), d AS (
  SELECT page_id, url, list_filter(list_transform(read, lambda x: trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'))), lambda x: x <> '') AS blocks FROM c
)
SELECT page_id, url, array_to_string(blocks, chr(10) || chr(10)) AS text, CAST(length(array_to_string(blocks, chr(10) || chr(10))) AS BIGINT) AS n_chars FROM d
"""


def _lloyd(dim: int = 64, scale: int = 256, k: int = 40, rounds: int = 5, seed: int = 2) -> str:
    """Plain Lloyd rounds: every vector against every centroid."""
    parts = [
        f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda c: CAST(floor({scale} * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(CAST(c AS DOUBLE)))) = {dim}
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')), x) - 1 AS c, x AS y FROM v
  QUALIFY c < {k}
)"""
    ]
    for r in range(rounds + 1):
        parts.append(
            f"""a{r} AS MATERIALIZED (
  SELECT i, any_value(vec_id) AS vec_id, any_value(x) AS x, arg_min(c, d * 1000 + c) AS c, min(d) AS d
  FROM (SELECT i, vec_id, x, c, CAST(list_inner_product(w, w) - 2 * list_inner_product(w, u) + list_inner_product(u, u) AS BIGINT) AS d
    FROM (SELECT *, CAST(x AS DOUBLE[]) AS w FROM v), (SELECT c, CAST(y AS DOUBLE[]) AS u FROM c{r})) GROUP BY i
)"""
        )
        if r < rounds:
            parts.append(
                f"""c{r + 1} AS MATERIALIZED (
  SELECT c, coalesce(z, y) AS y FROM c{r} LEFT JOIN (
    SELECT c, list((s - (((s % n) + n) % n)) // n ORDER BY p) AS z FROM (
      SELECT c, p, CAST(sum(e) AS BIGINT) AS s, count(*) AS n FROM (SELECT c, unnest(x) AS e, generate_subscripts(x, 1) AS p FROM a{r}) GROUP BY c, p
    ) GROUP BY c
  ) USING (c)
)"""
            )
    return "WITH " + ", ".join(parts) + (
        f"\nSELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,"
        f" CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(y, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (c)"
    )


OP12 = _lloyd()

#: The crc32 is computed byte by byte from its table; near words share what is
#: left when one letter is taken out of both, or out of the longer one.
OP13 = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS i, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]{7,}')) AS w FROM documents
), each_run AS (SELECT i, w, count(*) AS n FROM runs GROUP BY i, w
), bytes AS (
  SELECT w, n, flatten(list_transform(list_transform(string_split(i || ':' || w, ''), lambda c: ord(c)),
    lambda c: CASE WHEN c < 128 THEN [c] ELSE [192 + (c >> 6), 128 + (c & 63)] END)) AS b FROM each_run
), hashed AS (
  SELECT w, n, xor(list_reduce(list_prepend(4294967295, list_transform(b, lambda x: CAST(x AS BIGINT))), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) AS h
  FROM bytes, crc
), made AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, CAST(h % length(w) AS INTEGER)) || substr(w, CAST(h % length(w) AS INTEGER) + 2) ELSE w END AS word, n FROM hashed
), words AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM made WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), holes AS MATERIALIZED (
  SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
), near AS MATERIALIZED (
  SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS other_n FROM holes a JOIN holes b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT h.word, h.n, w.word, w.n FROM holes h JOIN words w ON w.word = h.rest
  UNION SELECT w.word, w.n, h.word, h.n FROM holes h JOIN words w ON w.word = h.rest
), best AS (
  SELECT word, n, other, other_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS k FROM near
), judged AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * w.n THEN other END AS form, CASE WHEN other_n >= 10 * w.n THEN other_n END AS form_n
  FROM words w LEFT JOIN (SELECT * FROM best WHERE k = 1) b ON w.word = b.word
), chain AS (
  SELECT word, form AS reached, 1 AS step FROM judged WHERE form IS NOT NULL
  UNION ALL SELECT c.word, j.form, step + 1 FROM chain c JOIN judged j ON j.word = c.reached WHERE j.form IS NOT NULL
), ends AS (SELECT word, arg_max(reached, step) AS root FROM chain GROUP BY word)
SELECT j.word, form, coalesce(root, j.word) AS root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM judged j LEFT JOIN ends e ON e.word = j.word
""".replace("\\u00C0-\\u00FF", "\u00C0-\u00FF")

SQL = {"op13_spelling_kd": OP13, "op11_max_subsequence": OP11, "op12_drift_clusters": OP12, "op5_bloom_cascade": OP5, "op7_chat_parts": OP7, "op9_chunk_recipes": OP9, "op10_host_rules": OP10}
