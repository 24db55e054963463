"""Queries over report texts and passages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports as R
from ..operators import views as V
from .registry import query
from .subgroups_queries import rounded

_REPORT = "(SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Findings: ' || text || chr(10) || 'Impression: ' || source WHEN 1 THEN '**FINDINGS:** ' || text || chr(10) || '__Impression__: ' || source ELSE text END AS report FROM documents)"
_PAT = R.SECTIONS.replace("'", "''")
_CUES = {"first": ["idiot", "scum"], "second": ["keit "], "third": ["ción"], "fourth": ["the "]}
_LABELS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
_MEASURES = {"hr": ("Heart rate", "bpm"), "pr": ("PR interval", "ms"), "qrs": ("QRS duration", "ms"), "qt": ("QT interval", "ms")}


def _docs(spark, sf):
    return V.table(spark, sf, "documents").withColumn("id", F.col("doc_id"))


@query("T04_split_report", f"""SELECT doc_id, md5(CASE WHEN f THEN regexp_extract(report, '{_PAT}', 1) ELSE '' END) AS findings, md5(CASE WHEN f THEN regexp_extract(report, '{_PAT}', 2) ELSE coalesce(report, '') END) AS impression, f AS formed
    FROM (SELECT *, coalesce(regexp_matches(report, '{_PAT}'), false) AS f FROM {_REPORT})""")
def sections(spark, sf):
    k = F.col("doc_id") % 3
    one, two = F.concat(F.lit("Findings: "), "text", F.lit("\nImpression: "), "source"), F.concat(F.lit("**FINDINGS:** "), "text", F.lit("\n__Impression__: "), "source")
    findings, impression, formed = R.split_report(F.col("report"))
    d = _docs(spark, sf).withColumn("report", F.when(k == 0, one).when(k == 1, two).otherwise(F.col("text")))
    return d.select("doc_id", F.md5(findings).alias("findings"), F.md5(impression).alias("impression"), formed.alias("formed"))


@query("T12_rouge_l")
def rouge_l(spark, sf):
    return rounded(R.rouge_l(V.texts(spark, sf)))


@query("T13_corpus_score")
def corpus_score(spark, sf):
    return rounded(R.corpus_score(V.texts(spark, sf)))


_TAGS = "list_filter([" + ", ".join(f"CASE WHEN {' OR '.join(f'contains(t, {w!r})' for w in words)} THEN '{c}' END" for c, words in sorted(_CUES.items())) + "], lambda x: x IS NOT NULL)"


@query("T14_cue_tags", f"""SELECT id, tags, CASE WHEN len(truth) = 0 THEN 1.0 ELSE round(len(list_intersect(tags, truth))::DOUBLE / len(truth), 6) END::DOUBLE AS recall FROM (SELECT doc_id AS id, {_TAGS} AS tags,
    CASE lang WHEN 'en' THEN ['fourth', 'first'] WHEN 'de' THEN ['second'] WHEN 'es' THEN ['third'] ELSE [] END AS truth FROM (SELECT *, lower(coalesce(text, '')) AS t FROM documents))""")
def cues(spark, sf):
    words = lambda *w: F.array(*map(F.lit, w))
    truth = F.when(F.col("lang") == "en", words("fourth", "first")).when(F.col("lang") == "de", words("second")).when(F.col("lang") == "es", words("third")).otherwise(F.array().cast("array<string>"))
    return rounded(R.cue_tags(_docs(spark, sf).withColumn("truth", truth), _CUES, "truth"))


_SCORE = ", ".join(f"""CASE WHEN (o_orderkey + {k}) % 5 <> 0 THEN round(least((o_orderkey * 7 + {k}) % 13 + 0.5::DOUBLE, 10.0) / 10, 6) END::DOUBLE AS "{c}" """ for k, c in enumerate(_LABELS))


@query("T15_recovered_scores", f"SELECT o_orderkey AS id, {_SCORE}, 0.8::DOUBLE AS compliance, CASE o_orderkey % 3 WHEN 0 THEN 'reads ' || o_orderkey::VARCHAR WHEN 1 THEN 'the longest line' ELSE '' END AS interpretation FROM orders")
def recovered(spark, sf):
    key = F.col("o_orderkey")
    named = lambda c, k: (f"{c}: ", f"**{c}**: ", f"- {c} — ", f"{c} = ")[k % 4]
    scores = [F.when((key + k) % 5 == 0, "").otherwise(F.concat(F.lit(named(c, k)), ((key * 7 + k) % 13).cast("string"), F.lit(".5/10\n"))) for k, c in enumerate(_LABELS)]
    prose = F.when(key % 3 == 0, F.concat(F.lit("Interpretation — reads "), key.cast("string"), F.lit("\nand a much longer line than that"))).when(key % 3 == 1, "short one\nthe longest line").otherwise("")
    reply = F.concat(*scores, prose)
    return rounded(R.recovered_scores(V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), reply.alias("reply")), _LABELS))


_LINES = " || chr(10) || ".join(f"'{n}: ' || coalesce(round({c}, 0)::BIGINT::VARCHAR || ' {u}', 'not measurable')" for c, (n, u) in _MEASURES.items())


@query("T16_measure_block", f"SELECT record_id, {_LINES} AS block FROM v_obs")
def block(spark, sf):
    return R.measure_block(V.observations(spark, sf), _MEASURES)


@query("K01_dictionary_passages", """SELECT 'code:' || code AS id, code AS title, concat_ws('. ', code, 'Category: ' || CASE WHEN diagnostic THEN 'diagnostic' WHEN rhythm THEN 'rhythm' END, 'Group: ' || superclass) AS text FROM v_dict""")
def passages(spark, sf):
    return R.dictionary_passages(V.dictionary(spark, sf))


@query("K02_sections", """SELECT doc_id AS id, 0::BIGINT AS section_no, 'Summary' AS section, md5(trim(split_part(text, chr(10), 1))) AS body FROM documents WHERE trim(split_part(text, chr(10), 1)) <> ''
    UNION ALL SELECT doc_id, 1, 'Body', md5(trim(array_to_string(string_split(text, chr(10))[2:], chr(10)))) FROM documents WHERE trim(array_to_string(string_split(text, chr(10))[2:], chr(10))) <> ''""")
def headed(spark, sf):
    lines = F.split("text", "\n")
    rest = F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), "\n")
    text = F.concat(F.element_at(lines, 1), F.lit("\n== Body ==\n"), rest, F.lit("\n=== References ===\nnone"))
    return R.section_rows(_docs(spark, sf).where("text is not null").select("id", text.alias("text"))).withColumn("body", F.md5("body"))


@query("K03_chunks")
def chunks(spark, sf):
    return R.chunk_rows(_docs(spark, sf).select("id", "text"))


_CT = """(SELECT id, term, sum(n) AS tf FROM (SELECT id, n, unnest(list_concat(list_concat(list_transform(range(1, greatest(len(p) - 1, 1)), lambda i: substr(p, i, 3)), list_transform(range(1, greatest(len(p) - 2, 1)), lambda i: substr(p, i, 4))), list_transform(range(1, greatest(len(p) - 3, 1)), lambda i: substr(p, i, 5)))) AS term
    FROM (SELECT id, ' ' || word || ' ' AS p, count(*) AS n FROM (SELECT item_id AS id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+')) AS word FROM benchmark) GROUP BY ALL)) GROUP BY ALL)"""


@query("K06_character_weights", f"""SELECT id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 6) AS w FROM (SELECT id, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM benchmark))::DOUBLE / (1 + df)) + 1) AS w FROM {_CT}
    JOIN (SELECT term, count(*) AS df FROM {_CT} GROUP BY term HAVING count(*) >= 2) USING (term))""")
def characters(spark, sf):
    return rounded(R.character_weights(V.table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")))


@query("K11_context_block", """SELECT conv_id AS id, md5(string_agg('[' || turn::VARCHAR || '] ' || role || ': ' || CASE WHEN length(text) <= 700 THEN text ELSE regexp_replace(substr(text, 1, 700), '\\s+\\S*$', '') || ' ...' END, chr(10) ORDER BY turn)) AS context
    FROM conversations WHERE text IS NOT NULL GROUP BY conv_id""")
def context(spark, sf):
    c = V.table(spark, sf, "conversations").where("text is not null").select(F.col("conv_id").alias("id"), F.col("turn").alias("rank"), F.col("role").alias("title"), "text")
    return R.context_block(c).withColumn("context", F.md5("context"))
