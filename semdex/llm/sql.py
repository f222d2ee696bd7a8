"""DuckDB SQL for the queries that SQL can express."""

from .mixing import offset_of

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

OP1 = f"""
WITH docs AS (SELECT doc_id, source, coalesce(len({_WORDS.format("text")}), 0)::BIGINT AS size FROM documents),
by_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w, 3 * source_size AS cap FROM by_source),
summed AS (
  SELECT *, sum(source_size) OVER () AS everything,
    coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(w) OVER (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS from_here
  FROM weighed),
cut AS (SELECT *, (everything - before)::DOUBLE * w > cap::DOUBLE * from_here AS is_cut FROM summed),
level AS (SELECT *, (everything - coalesce(sum(CASE WHEN is_cut THEN cap END) OVER (), 0))::DOUBLE / sum(CASE WHEN NOT is_cut THEN w END) OVER () AS lam FROM cut),
targets AS (SELECT source, source_size, CASE WHEN is_cut THEN cap::DOUBLE ELSE lam * w END AS target FROM level),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, doc_id NULLS FIRST) - 1 AS k FROM docs),
each AS (SELECT r.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS r FROM ranked r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, ((floor((k + 1) * r + {offset_of(16)!r}::DOUBLE) - floor(k * r + {offset_of(16)!r}::DOUBLE)) * size)::BIGINT AS taken FROM each
"""



def _crc_table() -> list[int]:
    """The table of CRC-32, from its polynomial."""
    rows = list(range(256))
    for _ in range(8):
        rows = [x >> 1 ^ 0xEDB88320 * (x & 1) for x in rows]
    return rows


_HEX = "0123456789ABCDEF"
OP4 = f"""
WITH crc AS (SELECT {_crc_table()}::UBIGINT[] AS t),
texts AS (SELECT x, hex(encode(x)) AS h FROM (SELECT DISTINCT coalesce(text, '') AS x FROM documents)),
bytes AS (SELECT x, list_transform(range(len(h) // 2), lambda i: ((instr('{_HEX}', h[2 * i + 1]) - 1) * 16 + instr('{_HEX}', h[2 * i + 2]) - 1)::UBIGINT) AS b FROM texts),
sums AS (SELECT x, xor(list_reduce(list_prepend(4294967295::UBIGINT, b), lambda a, y: xor(a >> 8, t[((xor(a, y) & 255) + 1)::INT])), 4294967295::UBIGINT)::BIGINT AS text_crc32 FROM bytes, crc),
docs AS (SELECT doc_id, source, strlen(x) + 1 AS size, text_crc32, md5('1 ' || x) AS shuffle FROM (SELECT *, coalesce(text, '') AS x FROM documents) JOIN sums USING (x)),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY shuffle, text_crc32, doc_id NULLS FIRST) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY source) AS fraction, count(*) OVER () AS n FROM docs),
placed AS (SELECT *, row_number() OVER (ORDER BY fraction, source NULLS FIRST, doc_id NULLS FIRST, text_crc32) - 1 AS k FROM ranked)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'rows' AS law, (k * 8 // n)::INT AS shard, (k - (k * 8 // n * n + 7) // 8)::BIGINT AS slot, NULL::INT AS grown_shard FROM placed
"""

OP6 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce({_WORDS.format("text")}, []) AS w FROM documents),
windows AS (SELECT r, i, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM (SELECT r, w, unnest(generate_series(1, len(w) - 4)) AS i FROM d WHERE len(w) >= 5)),
twice AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
covered AS (SELECT r, count(DISTINCT place)::BIGINT AS n FROM (SELECT r, unnest(generate_series(i, i + 4)) AS place FROM twice) GROUP BY r),
lines AS (SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
base AS (
  SELECT d.r, doc_id, text, w, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: len(x))), 0)::BIGINT AS word_chars,
    (len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM d JOIN lines USING (r) LEFT JOIN covered c USING (r)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 25 * n_words OR 10 * n_dup_lines > 3 * len(string_split(text, chr(10)))
    OR 10 * len(list_filter(w, lambda x: len(x) > 1 AND x = upper(x) AND x <> lower(x))) > 5 * n_words
    OR 10 * len(list_filter(w, lambda x: regexp_matches(x, '\\p{{L}}'))) < 6 * n_words OR 10 * len(list_filter(w, lambda x: ends_with(x, '!!'))) > 3 * n_words) AS kept
FROM judged
"""

_REACHED = """
reached AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS b FROM reached GROUP BY a), degree AS (SELECT a, count(*)::BIGINT AS n FROM links GROUP BY a)"""

OP7 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents WHERE doc_id IS NOT NULL),
g AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 5 * c >= 4 * (x.n + y.n - c)),{_REACHED}
SELECT doc_id, least(doc_id, coalesce(least.b, doc_id)) AS class_id, coalesce(degree.n, 0) AS n_links FROM documents LEFT JOIN least ON least.a = doc_id LEFT JOIN degree ON degree.a = doc_id
"""

OP10 = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),{_REACHED}
SELECT vec_id, coalesce(degree.n, 0) AS n_links, least(vec_id, coalesce(least.b, vec_id)) AS component_id, vec_id <= coalesce(least.b, vec_id) AS kept
FROM embeddings LEFT JOIN least ON least.a = vec_id LEFT JOIN degree ON degree.a = vec_id
"""

_NEAR = "SELECT vec_id + {} AS vec_id, list_transform(range(1, len(embedding) + 1), lambda i: (embedding[i]::DOUBLE + {} * embedding[CASE WHEN i = len(embedding) THEN 1 ELSE i + 1 END]::DOUBLE)::FLOAT) AS embedding, label FROM embeddings"
PLANTED = OP10.replace("embeddings", "planted").replace(" AS kept\n", " AS kept, true AS audited\n")
PLANTED = PLANTED.replace("WITH RECURSIVE", f"WITH RECURSIVE planted AS (SELECT vec_id, embedding, label FROM embeddings UNION ALL {_NEAR.format(1_000_000_000, 0.1)} UNION ALL {_NEAR.format(2_000_000_000, 0.3)}),")

ORACLES = {"op1_mix_systematic": OP1, "op4_shard_interleave": OP4, "op6_quality_cascade": OP6, "op7_ngram_jaccard_join": OP7, "op10_vector_graph": OP10, "vector_graph_planted": PLANTED}
