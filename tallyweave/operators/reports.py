"""Report texts: sections, passages, chunks, cues, recovered scores, measure blocks, longest common subsequences."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .retrieval import text_scores, tokens



def sections_pattern(findings: str, impression: str) -> str:
    """Pattern of a report with two headers, with mark-up around them."""
    return rf"(?is)^\s*[*_]*{findings}[*_]*\s*:[*_]*\s*(.*?)\s*[*_]*{impression}[*_]*\s*:[*_]*\s*(.*)$"


SECTIONS = sections_pattern("findings", "impression")
#: Headers with and without their accents.
_SECTIONS = {"en": SECTIONS, "es": sections_pattern("hallazgos", "impresi[oóÓ]n")}


def split_report(text: Column, lang: str = "en") -> tuple[Column, Column, Column]:
    """Findings, impression and whether the report is well formed; a malformed one is all impression."""
    pattern = _SECTIONS[lang]
    formed = F.coalesce(text.rlike(pattern), F.lit(False))
    part = lambda k: F.regexp_extract(text, pattern, k)
    return F.when(formed, part(1)).otherwise(F.lit("")), F.when(formed, part(2)).otherwise(F.coalesce(text, F.lit(""))), formed


def _common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a bit of an integer for each word of ``a``."""
    where: dict[str, int] = {}
    for k, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << k
    row = every = (1 << len(a)) - 1
    for w in b:
        met = row & where.get(w, 0)
        row = ((row + met) | (row - met)) & every
    return len(a) - row.bit_count()


@F.pandas_udf(DoubleType())
def _rouge_l(hypothesis: pd.Series, reference: pd.Series) -> pd.Series:
    f1 = [2 * _common_subsequence(list(h), list(r)) / (len(h) + len(r)) if len(h) + len(r) else 0.0 for h, r in zip(hypothesis, reference, strict=True)]
    return pd.Series(f1, dtype="float64")


def rouge_l(df: DataFrame) -> DataFrame:
    """F1 of the longest common subsequence of words for (id, hypothesis, reference); 0 for two empty texts."""
    return df.select("id", _rouge_l(tokens(F.col("hypothesis")), tokens(F.col("reference"))).alias("rouge_l"))


def corpus_score(df: DataFrame) -> DataFrame:
    """Means of the four scores, each rounded to four digits first."""
    j = text_scores(df).join(rouge_l(df), "id")
    return j.agg(*[F.avg(F.round(c, 4)).alias(c) for c in ("bleu", "rouge_1", "rouge_2", "rouge_l")], F.count("*").alias("n"))


def cue_tags(df: DataFrame, cues: dict[str, list[str]], truth: str) -> DataFrame:
    """Sorted classes of which a cue stands in (id, text), and their recall of the array ``truth`` (1 without truth)."""
    low = F.lower(F.coalesce("text", F.lit("")))
    hit = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    tags = F.array_compact(F.array(*[F.when(hit(words), c) for c, words in sorted(cues.items())]))
    tagged = df.withColumn("tags", tags)
    share = F.size(F.array_intersect("tags", truth)) / F.size(truth)
    return tagged.select("id", "tags", F.when(F.size(truth) == 0, 1.0).otherwise(share).alias("recall"))


def recovered_scores(df: DataFrame, labels: list[str]) -> DataFrame:
    """For (id, reply) a score from 0 to 1 for each label, the share of labels with one, and the interpretation.

    A label's number (0 to 10, clipped) follows its name, which may be set in
    bold, after a colon, an equals sign, a dash or a long dash. The
    interpretation is the rest of the line after that word, else the longest
    line that gives no score (the first of equals), else empty.
    """
    number = lambda c: F.regexp_extract("reply", rf"(?i)\b{c}[*\s]*[:=—-]\s*(\d+(?:\.\d+)?)", 1)
    score = lambda c: F.least(F.greatest(F.expr("0.0D"), F.nullif(number(c), F.lit("")).cast("double")), F.lit(10.0)) / 10
    said = F.trim(F.regexp_extract("reply", r"(?i)interpretation\s*[:—-]\s*([^\n]+)", 1))
    scored = rf"(?i)^[*\s-]*(?:{'|'.join(labels)})[*\s]*[:=—-]"
    lines = F.filter(F.transform(F.split(F.coalesce("reply", F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike(scored))
    longest = F.array_max(F.transform(lines, lambda x, i: F.struct(F.length(x).alias("n"), (-i).alias("i"), x.alias("line"))))["line"]
    found = df.select("id", *[F.when(number(c) != "", score(c)).alias(c) for c in labels], F.coalesce(F.nullif(said, F.lit("")), longest, F.lit("")).alias("interpretation"))
    answered = sum((F.col(c).isNotNull().cast("int") for c in labels), F.lit(0))
    return found.withColumn("compliance", answered / len(labels))


def measure_block(df: DataFrame, names: dict[str, tuple[str, str]]) -> DataFrame:
    """record_id and one line for each measure (column: name, unit), "not measurable" for null."""
    line = lambda c, name, unit: F.concat(F.lit(f"{name}: "), F.coalesce(F.concat(F.round(c, 0).cast("long").cast("string"), F.lit(f" {unit}")), F.lit("not measurable")))
    return df.select("record_id", F.concat_ws("\n", *[line(c, *v) for c, v in names.items()]).alias("block"))


def dictionary_passages(d: DataFrame) -> DataFrame:
    """A passage for each code from its category and superclass; codes without text are left out."""
    category = F.when(F.col("diagnostic"), "diagnostic").when(F.col("rhythm"), "rhythm")
    text = F.concat_ws(". ", F.col("code"), F.concat(F.lit("Category: "), category), F.concat(F.lit("Group: "), "superclass"))
    return d.select(F.concat(F.lit("code:"), "code").alias("id"), F.col("code").alias("title"), text.alias("text")).where("text <> ''")


def section_rows(df: DataFrame, dropped: tuple[str, ...] = ("references", "external links", "see also")) -> DataFrame:
    """(id, section_no, section, body) of texts with "== heading ==" lines; text before the first is "Summary"; boilerplate sections go."""
    lines = df.select("id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    heading = F.regexp_extract("line", r"^\s*==+\s*(.*?)\s*==+\s*$", 1)
    order = W.partitionBy("id").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    marked = lines.withColumn("heading", heading).withColumn("section_no", F.sum((F.col("heading") != "").cast("int")).over(order))
    body = F.array_sort(F.collect_list(F.when(F.col("heading") == "", F.struct("line_no", "line"))))
    g = marked.groupBy("id", "section_no").agg(F.coalesce(F.max(F.nullif("heading", F.lit(""))), F.lit("Summary")).alias("section"), body.alias("lines"))
    text = F.trim(F.array_join(F.transform("lines", lambda x: x["line"]), "\n"))
    return g.select("id", "section_no", "section", text.alias("body")).where((F.col("body") != "") & ~F.lower("section").isin(*dropped))


def chunks(text: Column, most: int = 900, least: int = 120) -> Column:
    """The paragraphs of a text as chunks of at most ``most`` characters.

    Runs of space become one. A longer paragraph is packed from its sentences
    (one that is longer still stays whole); a chunk of under ``least``
    characters joins the one before it if both fit. Null and blank texts have none.
    """
    fold = lambda parts, joins: F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda done, s: F.when((F.size(done) > 0) & joins(F.element_at(done, -1), s), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat(F.element_at(done, -1), F.lit(" "), s)))).otherwise(F.concat(done, F.array(s))),
    )
    fit = lambda a, b: F.length(a) + 1 + F.length(b) <= most
    paragraphs = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\n{2,}"), lambda p: F.trim(F.regexp_replace(p, r"(?U)\s+", " "))), lambda p: p != "")
    packed = F.flatten(F.transform(paragraphs, lambda p: F.when(F.length(p) <= most, F.array(p)).otherwise(fold(F.split(p, r"(?<=[.!?])\s+"), fit))))
    return fold(packed, lambda a, b: (F.length(b) < least) & fit(a, b))


def chunk_rows(df: DataFrame, most: int = 900, least: int = 120) -> DataFrame:
    """(id, chunk_no, chunk) of (id, text)."""
    return df.select("id", F.posexplode(chunks(F.col("text"), most, least)).alias("chunk_no", "chunk"))


def character_weights(docs: DataFrame, least_df: int = 2) -> DataFrame:
    """Postings (id, term, w) of the 3- to 5-character pieces of words padded by a space, as K05; pieces in under ``least_df`` documents go."""
    word = F.explode(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z0-9_]+"), F.lit(0)))
    words = docs.select("id", word.alias("word")).groupBy("id", "word").agg(F.count("*").alias("n"))
    padded = F.concat(F.lit(" "), "word", F.lit(" "))
    starts = lambda n: F.when(F.length(padded) >= n, F.sequence(F.lit(1), F.length(padded) - n + 1)).otherwise(F.array().cast("array<int>"))
    cut = lambda n: F.transform(starts(n), lambda i: F.substring(padded, i, F.lit(n)))
    pieces = F.concat(cut(3), cut(4), cut(5))
    tf = words.select("id", "n", F.explode(pieces).alias("term")).groupBy("id", "term").agg(F.sum("n").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= least_df)
    n = docs.agg(F.count("*").alias("docs"))
    w = tf.join(df, "term").crossJoin(F.broadcast(n)).withColumn("w", (1 + F.log("tf")) * (F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1))
    return w.select("id", "term", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("id")))).alias("w"))


def context_block(df: DataFrame, most: int = 700) -> DataFrame:
    """(id, context): the passages (id, rank, title, text) of an id, numbered and titled, cut at ``most`` characters on a word boundary.

    The cut is made at the last space of the part, be it its last character. Null for an id none of whose passages has a line.
    """
    cut = F.when(F.length("text") <= most, F.col("text")).otherwise(F.concat(F.regexp_replace(F.substring("text", 1, most), r"[\t\n\f\r ]+[^\t\n\f\r ]*\z", ""), F.lit(" ...")))
    item = F.struct("rank", F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), "title", F.lit(": "), cut).alias("line"))
    lines = F.array_compact(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["line"]))
    return df.groupBy("id").agg(F.when(F.size(lines) > 0, F.array_join(lines, "\n")).alias("context"))
