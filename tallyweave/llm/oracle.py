"""DuckDB SQL twins of the corpus queries that SQL can express."""

_H = "('0x' || substr(md5({}), 1, 8))::BIGINT"

OP1 = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
b AS (
  SELECT *, CASE WHEN size < 1024 THEN size // 16 WHEN size < 16384 THEN 64 + size // 256
            ELSE 128 + least(size // 4096, 896) END AS bin,
         coalesce({_H.format("'mix:' || doc_id::VARCHAR")} % 16, 0) AS salt FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM b GROUP BY source),
w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM s),
r AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS ratio,
             (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total, sum(weight) OVER () AS all_weight FROM w),
c AS (SELECT *, ratio <= (total - (sum(cap) OVER o - cap)) / (all_weight - (sum(weight) OVER o - weight)) AS capped
      FROM r WINDOW o AS (ORDER BY ratio, source NULLS LAST)),
t AS (SELECT source, source_size, CASE WHEN capped THEN cap ELSE
        (total - sum(CASE WHEN capped THEN cap ELSE 0.0 END) OVER ()) / sum(CASE WHEN capped THEN 0.0 ELSE weight END) OVER () * weight END AS target
      FROM c),
p AS (SELECT doc_id, size, source_size, target,
        row_number() OVER (PARTITION BY b.source ORDER BY bin, salt, size, doc_id NULLS FIRST) AS place,
        CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
        {_H.format("'mix:source:' || coalesce(b.source, '')")} / 4294967296.0::DOUBLE AS u
      FROM b JOIN t ON b.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, (floor(u + rate * place) - floor(u + rate * (place - 1)))::BIGINT AS copies FROM p)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM q
"""

OP11 = """
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
s AS MATERIALIZED (SELECT row, doc_id, i, sha256(array_to_string(w[i:i + 12], ' ')) AS h FROM (
  SELECT row, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
m AS (SELECT h, min(doc_id) AS first FROM s GROUP BY h HAVING min(doc_id) < max(doc_id)),
g AS (SELECT DISTINCT row, i + k AS i FROM (SELECT row, i, unnest(range(13)) AS k FROM s JOIN m USING (h) WHERE doc_id > first)),
r AS (SELECT row, list(i) AS gone FROM g GROUP BY row),
x AS (SELECT doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN r USING (row))
SELECT doc_id, len(w)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN gone = [] THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i)), lambda i: w[i]) END, ' ')) AS kept_sha256
FROM x
"""

OP13 = """
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         unnest(list_concat([NULL], regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+'))) AS item FROM documents),
groups AS (SELECT DISTINCT lang, source FROM d),
kept AS (SELECT lang, item, count(*) AS total FROM d WHERE item IS NOT NULL GROUP BY lang, item HAVING count(DISTINCT id) >= 3),
c AS (SELECT lang, source, item, count(*) AS n FROM d JOIN kept USING (lang, item) GROUP BY lang, source, item),
v AS (SELECT lang, count(*) AS v, sum(total) AS lang_n FROM kept GROUP BY lang),
s AS (SELECT groups.lang, groups.source, coalesce(v, 0) AS v, coalesce(lang_n, 0) AS lang_n, coalesce(sum(n), 0) AS n
      FROM groups LEFT JOIN v ON v.lang = groups.lang LEFT JOIN c ON c.lang = groups.lang AND c.source = groups.source
      GROUP BY groups.lang, groups.source, v, lang_n),
p AS (SELECT s.lang, s.source, kept.item, coalesce(c.n, 0) AS n,
        1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (s.n + s.v) AS p,
        1 + 1000000000::HUGEINT * (kept.total + 1) // (s.lang_n + s.v) AS q
      FROM s JOIN kept ON kept.lang = s.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.item = kept.item),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
          FROM p a JOIN p b ON a.lang = b.lang AND a.item = b.item AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
every AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value
          FROM s a JOIN s b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source),
terms AS (SELECT lang, source, item, (p - q) * (p - q) // q AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT 'pair' AS part, *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM every
      UNION ALL
      SELECT 'term', *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= 200
"""



def _codes(rounds: int = 6) -> str:
    """SQL of op12: an assignment and an update for each round, chained."""
    near = "SELECT p.row, p.part, min(list_sum(list_transform(range(1, len(p.v) + 1), lambda i: (p.v[i] - c.v[i]) * (p.v[i] - c.v[i])))::HUGEINT * 16 + c.entry) AS best FROM p JOIN c{0} c USING (part) GROUP BY p.row, p.part"
    chain = "".join(
        f""",
a{r} AS MATERIALIZED ({near.format(r - 1)}),
u{r} AS (SELECT part, entry, i, sum(v[i]) AS s, count(*) AS n FROM (
  SELECT part, best % 16 AS entry, v, unnest(range(1, len(v) + 1)) AS i FROM p JOIN a{r} USING (row, part)) GROUP BY part, entry, i),
n{r} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM u{r} GROUP BY part, entry),
c{r} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(n.v, c.v)::BIGINT[] AS v FROM c{r - 1} c LEFT JOIN n{r} n ON n.part = c.part AND n.entry = c.entry)"""
        for r in range(1, rounds + 1)
    )
    return f"""
WITH k AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT row, part, v[part * (len(v) // 8) + 1:(part + 1) * (len(v) // 8)] AS v FROM (SELECT row, v, unnest(range(8)) AS part FROM k)),
c0 AS MATERIALIZED (SELECT part, row - 1 AS entry, v FROM p WHERE row <= 16){chain},
f AS MATERIALIZED ({near.format(rounds)}),
e AS (SELECT row, string_agg(format('{{:02x}}', (best % 16)::INTEGER), '' ORDER BY part) AS code, sum(best // 16)::BIGINT AS error FROM f GROUP BY row),
h AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, i)) AS codebooks_sha256
      FROM (SELECT part, entry, unnest(v) AS x, unnest(range(len(v))) AS i FROM c{rounds}))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM k JOIN e USING (row), h
"""


ORACLE = {"op1_source_mix": OP1, "op11_substring_dedup": OP11, "op12_vector_codes": _codes(), "op13_source_divergence": OP13}
