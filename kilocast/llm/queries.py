"""The operators' registered queries and the SQL that they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kilocast.llm.chat import op1_chat_format
from kilocast.llm.decontaminate import op3_decontamination
from kilocast.llm.jaccard import op4_ngram_jaccard_join
from kilocast.llm.minhash import op12_minhash_duplicates
from kilocast.llm.mixing import op2_mixing
from kilocast.llm.periods import op13_periodic_runs
from kilocast.llm.ppm import op7_ppm_scores
from kilocast.llm.spelling import op11_spelling_variants
from kilocast.llm.spotsigs import op6_fingerprints
from kilocast.llm.substrings import op10_substring_dedup
from kilocast.llm.tokens import op9_token_files
from kilocast.llm.toxicity import op8_toxicity
from kilocast.llm.warc import op5_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat_format": op1_chat_format,
        "op2_mixing": op2_mixing,
        "op3_decontamination": op3_decontamination,
        "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
        "op5_warc": op5_warc,
        "op6_fingerprints": op6_fingerprints,
        "op7_ppm_scores": op7_ppm_scores,
        "op8_toxicity": op8_toxicity,
        "op9_token_files": op9_token_files,
        "op10_substring_dedup": op10_substring_dedup,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_minhash_duplicates": op12_minhash_duplicates,
        "op13_periodic_runs": op13_periodic_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat_format": CHAT,
        "op4_ngram_jaccard_join": JOINED,
        "op5_warc": WARC,
        "op10_substring_dedup": REPEATED,
        "op11_spelling_variants": VARIANTS,
        "op12_minhash_duplicates": DUPLICATES,
        "op13_periodic_runs": RUNS,
    }


CHAT = """
WITH m AS (
  SELECT *, CASE WHEN role = 'assistant' THEN
      CASE WHEN turn % 8 = 1 THEN turn + 2 WHEN turn % 8 <> 3 THEN turn - 2 END END AS other,
    CASE WHEN role = 'assistant' THEN
      CASE WHEN turn % 5 = 4 THEN 'browse' WHEN turn % 3 = 0 THEN 'compute' ELSE 'search' END END AS tool,
    CASE WHEN role = 'assistant' THEN 'c' || conv_id || '-' || turn END AS call_id
  FROM conversations),
l AS (
  SELECT m.*, o.turn IS NOT NULL AS other_found, a.text AS answer,
    CASE WHEN m.role = 'assistant' AND m.turn % 8 = 1 AND o.turn IS NOT NULL THEN 1
         WHEN m.role = 'user' AND p.turn % 8 = 1 AND po.turn IS NOT NULL THEN 1 ELSE 0 END AS level
  FROM m
  LEFT JOIN m o ON o.conv_id = m.conv_id AND o.turn = m.other AND o.role = 'assistant'
  LEFT JOIN m a ON a.conv_id = m.conv_id AND a.turn = m.turn + 1 AND a.role = 'user' AND m.role = 'assistant'
  LEFT JOIN m p ON p.conv_id = m.conv_id AND p.turn = m.turn - 1 AND p.role = 'assistant'
  LEFT JOIN m po ON po.conv_id = p.conv_id AND po.turn = p.turn + 2 AND po.role = 'assistant'),
e AS (
  SELECT *, CASE WHEN tool IS NOT NULL THEN array_to_string(list_filter([
      CASE WHEN tool = 'compute' THEN 'missing precise' END,
      CASE WHEN tool = 'compute' AND other IS NOT NULL THEN 'unknown after' END,
      CASE WHEN other >= 0 AND NOT other_found THEN 'unknown reference c' || conv_id || '-' || other END,
      CASE WHEN tool = 'browse' THEN 'unknown tool' END], lambda x: x IS NOT NULL), '; ') END AS errors
  FROM l)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY level, turn) - 1 AS step, turn, role, call_id, tool,
  tool IS NOT NULL AND answer IS NOT NULL AS linked, errors,
  '{' || CASE WHEN tool IS NOT NULL THEN '"call":{"arguments":{'
      || CASE WHEN other IS NOT NULL THEN '"after":"c' || conv_id || '-' || other || '",' ELSE '' END
      || '"limit":' || len(string_split(text, ' ')) || ',"query":'
      || CAST(to_json(array_to_string(string_split(text, ' ')[1:4], ' ')) AS VARCHAR) || '},"id":"' || call_id || '","name":"' || tool || '"'
      || CASE WHEN answer IS NOT NULL THEN ',"result":' || CAST(to_json(answer) AS VARCHAR) ELSE '' END
      || ',"valid":' || CASE WHEN errors = '' THEN 'true' ELSE 'false' END || '},' ELSE '' END
    || '"content":' || CAST(to_json(text) AS VARCHAR) || ',"role":"' || role || '"}' AS json
FROM e
"""

WARC = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (
  SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS digest FROM p),
b AS (
  SELECT *, max(page_id) OVER (PARTITION BY digest) AS last, CAST(CAST(unhex(digest) AS BIT) AS VARCHAR) AS bits FROM d)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1
    + 16 * CAST(bits[5 * i + 1] AS INTEGER) + 8 * CAST(bits[5 * i + 2] AS INTEGER) + 4 * CAST(bits[5 * i + 3] AS INTEGER)
    + 2 * CAST(bits[5 * i + 4] AS INTEGER) + CAST(bits[5 * i + 5] AS INTEGER), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to
FROM b
"""

REPEATED = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
v AS (
  SELECT doc_id, unnest(range(1, len(words) - 11)) AS pos, words FROM w),
k AS (
  SELECT doc_id, pos, array_to_string(words[pos:pos + 12], ' ') AS seq FROM v),
f AS (
  SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY seq) AS first FROM k),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(pos, pos + 13)) AS pos FROM f WHERE first < doc_id),
g AS (
  SELECT doc_id, list(pos) AS gone FROM gone GROUP BY doc_id),
t AS (
  SELECT w.doc_id, words, coalesce(gone, []) AS gone FROM w LEFT JOIN g USING (doc_id))
SELECT doc_id, len(words) AS n_words, len(gone) AS n_removed,
  sha256(array_to_string(list_filter(words, lambda x, i: NOT list_contains(gone, i)), ' ')) AS kept_sha256
FROM t
"""


def _crc32(blob: str) -> str:
    """SQL for the unsigned crc32 of a blob, by the table ``crc``(codes) that ``CRC`` defines."""
    return (
        f"xor(list_reduce(list_concat([4294967295], list_transform(range(octet_length({blob})), "
        f"lambda i: CAST('0x' || substr(hex({blob}), 2 * i + 1, 2) AS BIGINT))), "
        "lambda c, b: xor(c >> 8, codes[(xor(c, b) & 255) + 1])), 4294967295)"
    )


CRC = """crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS codes)"""

RUNS = rf"""
WITH {CRC},
w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    {_crc32("encode(CAST(doc_id AS VARCHAR))")} AS h
  FROM documents, crc),
n AS (
  SELECT *, len(words) AS n, h // 10 AS g, (h // 10) % greatest(len(words), 1) AS a FROM w),
e AS (
  SELECT doc_id, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i:
      words[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE words END AS words
  FROM n),
t AS (
  SELECT doc_id, len(words) AS n, unnest(words) AS word, unnest(range(len(words))) AS i FROM e),
q AS (
  SELECT x.doc_id, y.i - x.i AS p, x.i, x.i - row_number() OVER (PARTITION BY x.doc_id, y.i - x.i ORDER BY x.i) AS island
  FROM t x JOIN t y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
s AS (
  SELECT doc_id, p, min(i) AS start, count(*) + p AS length FROM q GROUP BY doc_id, p, island),
r AS (
  SELECT doc_id, start, length, min(p) AS period FROM s WHERE length >= greatest(6, 4 * p) GROUP BY doc_id, start, length),
l AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
  FROM r GROUP BY doc_id),
b AS (
  SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / period DESC, start, period) = 1),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
k AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM t ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT e.doc_id, coalesce(n_runs, 0) AS n_runs, b.start, b.length, b.period, 1000 * b.length // b.period AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM e LEFT JOIN l USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN k USING (doc_id)
"""

VARIANTS = rf"""
WITH RECURSIVE {CRC},
w AS (
  SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents),
f AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k FROM w GROUP BY ALL),
h AS (
  SELECT *, {_crc32("encode(doc_id || ':' || run)")} AS h FROM f, crc),
d AS (
  SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM h),
v AS (
  SELECT word, CAST(sum(k) AS BIGINT) AS n FROM d WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
o AS (
  SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
near AS (
  SELECT a.word, b.word AS other, b.n FROM o a JOIN o b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT o.word, v.word, v.n FROM o JOIN v ON v.word = o.rest
  UNION SELECT v.word, o.word, o.n FROM o JOIN v ON v.word = o.rest),
best AS (
  SELECT word, other, n AS other_n, count(*) OVER (PARTITION BY word) AS n_near FROM near
  QUALIFY row_number() OVER (PARTITION BY word ORDER BY n DESC, other) = 1),
x AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * v.n THEN other END AS form,
    CASE WHEN other_n >= 2 * v.n THEN other_n END AS form_n
  FROM v LEFT JOIN best USING (word)),
chain AS (
  SELECT word, word AS root FROM x
  UNION ALL SELECT chain.word, x.form FROM chain JOIN x ON x.word = chain.root WHERE x.form IS NOT NULL)
SELECT x.word, x.form, e.root, x.n, x.n_near, x.form_n
FROM x JOIN (SELECT chain.word, chain.root FROM chain JOIN x ON x.word = chain.root WHERE x.form IS NULL) e USING (word)
"""


def _linked(n: int, percent: int) -> str:
    """SQL tables ``sizes`` (doc_id, n_shingles) and ``comps`` (doc_id, component_id) of linked documents."""
    return rf"""
w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + {n - 1}], ' ') AS shingle
  FROM (SELECT *, unnest(range(1, greatest(len(words) - {n - 2}, 2))) AS i FROM w WHERE len(words) > 0)),
sizes AS (
  SELECT w.doc_id, count(shingle) AS n_shingles FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
  FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * shared >= {percent} * (x.n_shingles + y.n_shingles - shared)),
reach AS (
  SELECT a AS doc_id, a AS other FROM links
  UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other),
low AS (
  SELECT doc_id, min(other) AS other FROM reach GROUP BY doc_id),
comps AS (
  SELECT sizes.doc_id, n_shingles, coalesce(other, sizes.doc_id) AS component_id FROM sizes LEFT JOIN low USING (doc_id))"""


JOINED = f"""
WITH RECURSIVE {_linked(3, 90)}
SELECT doc_id, n_shingles, component_id FROM comps
"""

DUPLICATES = f"""
WITH RECURSIVE {_linked(4, 80)}
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM comps
"""
