"""Source divergence audit: how far the term shares of a source lie from those of other sources of its language.

Terms are shuffled as 64-bit digests. A term's text leaves a task once, stays
in the written table and is read again only for digests that are kept; where
the smallest and largest text of a digest differ, the digest stands for
several terms and these are counted anew by their texts.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from .common import Staging

_SCALE = 1_000_000_000
#: Bytes as terms see them: A-Z lower-cased, other ASCII apart from a-z a separator, all bytes of longer characters kept.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: What a task holds at most before it passes its counts on: entries, and bytes of text.
_ENTRIES, _BYTES = 400_000, 64 << 20
_TILE, _CELLS = 256, 1 << 17


def _pieces(raw: bytes, most: int = 1 << 20) -> Iterator[bytes]:
    """A text in pieces of about ``most`` bytes, cut between terms."""
    start = 0
    while start < len(raw):
        end = start + most
        if end < len(raw):
            end = raw.find(b" ", end)
            end = len(raw) if end < 0 else end
        yield raw[start:end]
        start = end


def _cells(docs: DataFrame, bits: int, always: bool = False) -> DataFrame:
    """Counts of each task: lang, source, digest, n (occurrences), docs (documents), term.

    ``term`` stands where a task meets a text first (everywhere with
    ``always``). Each group that a task meets gives one row without a digest.
    """
    names = ["lang", "source", "digest", "n", "docs", "term"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def run(batches):
        told: set[bytes] = set()
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flushed():
            digests: dict[bytes, bytes] = {}
            for (lang, source), (n, docs) in groups.items():
                keys, texts = [], []
                for term in n:
                    d = digests.get(term) or digests.setdefault(term, hashlib.blake2b(term, digest_size=16).digest())
                    keys.append(int.from_bytes(d[:8], "little", signed=True) >> (64 - bits))
                    texts.append(term.decode() if always or d not in told else None)
                    told.add(d)
                cols = ([lang] * (len(keys) + 1), [source] * (len(keys) + 1), [*keys, None], [*n.values(), 0], [*map(docs.__getitem__, n), 0], [*texts, None])
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)
            groups.clear()
            if len(told) > _ENTRIES:
                told.clear()

        size = 0
        for batch in batches:
            for text, lang, source in zip(*(batch.column(c).to_pylist() for c in ("text", "lang", "source")), strict=True):
                n, docs = groups.setdefault((lang, source), (Counter(), Counter()))
                seen: set[bytes] = set()
                for piece in _pieces(text.translate(_LETTERS)):
                    found = piece.split()
                    n.update(found)
                    seen.update(found)
                docs.update(seen)
                size += len(text) + 64
                if size >= _BYTES:
                    yield from flushed()
                    size = 0
            if sum(len(n) for n, _ in groups.values()) >= _ENTRIES:
                yield from flushed()
                size = 0
        yield from flushed()

    return docs.mapInArrow(run, "lang string, source string, digest long, n long, docs long, term string")


def _share(count, whole):
    """1 + floor(10**9 * (count + 1) / whole) of integer arrays, without a product that passes 64 bits (whole < 2.8e14)."""
    first, rest = np.divmod(count + 1, whole)
    second, rest = np.divmod(rest * 31_250, whole)
    return 1 + first * _SCALE + second * 32_000 + rest * 32_000 // whole


def _share_column(count: str, whole: str) -> Column:
    """``_share`` as an expression of long columns."""
    rest = f"(({count} + 1) % ({whole}))"
    return F.expr(f"1 + (({count} + 1) div ({whole})) * {_SCALE}L + (({rest} * 31250L) div ({whole})) * 32000L + ((({rest} * 31250L) % ({whole})) * 32000L) div ({whole})")


def _gap(p, q):
    return (p - q) * (p - q) // q


def _pair_sums(terms: pa.Table, groups: pa.Table) -> pa.Table:
    """Sums of the gaps between the sources of one tile and all sources of the language, over one block of terms.

    Terms that neither source holds give one value each, so that only terms
    that one of the two holds are gone through.
    """
    names = groups.column("source").combine_chunks()
    own = np.flatnonzero(groups.column("own").to_numpy(zero_copy_only=False))
    whole = groups.column("n").to_numpy() + groups.column("v").to_numpy()
    value = np.zeros((len(own), len(names)), np.int64)
    if terms.num_rows:
        lists = terms.column("cells").combine_chunks()
        flat = lists.flatten()
        at = pc.index_in(flat.field("source"), value_set=names).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(terms.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        share = _share(flat.field("n").to_numpy(), whole[at])
        base = _share(np.zeros(len(names), np.int64), whole)
        step = max(1, (1 << 20) // len(names))
        for k in range(0, terms.num_rows, step):
            a, b = np.searchsorted(row, [k, k + step])
            p = np.repeat(base[:, None], min(step, terms.num_rows - k), axis=1)
            held = np.zeros(p.shape, bool)
            p[at[a:b], row[a:b] - k] = share[a:b]
            held[at[a:b], row[a:b] - k] = True
            both = held[own].astype(np.int64) @ held.astype(np.int64).T
            neither = p.shape[1] - held[own].sum(1)[:, None] - held.sum(1)[None, :] + both
            value += neither * _gap(base[own][:, None], base[None, :])
            for i, g in enumerate(own):
                mine = held[g]
                value[i] += _gap(p[g, mine][None, :], p[:, mine]).sum(1)
            for h in range(len(names)):
                theirs = held[h]
                value[:, h] += np.where(held[own][:, theirs], 0, _gap(base[own][:, None], p[h, theirs][None, :])).sum(1)
    mine, other = (x.ravel() for x in np.meshgrid(own, np.arange(len(names)), indexing="ij"))
    keep = mine != other
    lang = pa.array([groups.column("lang")[0].as_py()] * int(keep.sum()), pa.string())
    return pa.Table.from_arrays([lang, names.take(pa.array(mine[keep])), names.take(pa.array(other[keep])), pa.array(value.ravel()[keep])], names=["lang", "source", "item", "value"])


def source_divergence(docs: DataFrame, *, min_docs: int = 3, top: int = 200, digest_bits: int = 64, staging: Staging | None = None) -> DataFrame:
    """lang, source, part, item, value, rank for the sources of each language of (text, lang, source).

    A language keeps the terms that at least ``min_docs`` of its rows hold.
    With p = 1 + floor(10**9 * (count + 1) / (all counts + kept terms)), of a
    source and of its language, and gap(p, q) = floor((p - q)**2 / q): part
    ``pair`` has a row for each other source of the language, its gap summed
    over all kept terms; part ``term`` has the ``top`` kept terms of the
    source with p above that of the language. Rows are ranked by falling
    value, then by item in UTF-8. All numbers are exact integers; a language
    may count up to 2.8e14 terms.

    Tasks pre-aggregate, so a source, a language or a term of any share of the
    rows spreads over tasks; pairs of sources are summed per block of terms
    inside tasks and only the sums are shuffled. Null text, lang and source
    read as ''. Each row is a document, repeated rows too. A language without
    kept terms has pairs of value 0; a lone source has no pair; an empty table
    gives no rows. Other columns are not looked at.
    """
    spark = docs.sparkSession
    staging = staging or Staging(spark, "divergence")
    rows = docs.select(
        F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
    )
    cells = staging.save(_cells(rows, digest_bits), "cells", "zstd")
    blank = F.lit(None).cast("string")

    def kept(counts: DataFrame, *key: str) -> DataFrame:
        """One row for each term of a language in enough documents; counts come dealt by (lang, digest)."""
        each = counts.groupBy("lang", "source", *key).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        terms = each.groupBy("lang", *key).agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("cells"))
        return terms.where(F.col("docs") >= min_docs).drop("docs")

    counted = cells.where("digest is not null").select("lang", "source", "digest", "n", "docs").repartition("lang", "digest")
    terms = staging.save(kept(counted, "digest").withColumn("term", blank).select("lang", "digest", "term", "total", "cells"), "terms")
    texts = cells.where("term is not null").select("digest", "term").join(terms.select("digest").distinct(), "digest", "left_semi")
    names = staging.save(texts.groupBy("digest").agg(F.min("term").alias("low"), F.max("term").alias("high")), "names")
    split = names.where("low < high").select("digest")
    if not split.isEmpty():
        anew = _cells(rows, digest_bits, always=True).where("digest is not null").join(split, "digest", "left_semi").repartition("lang", "digest")
        exact = kept(anew, "digest", "term").select("lang", "digest", "term", "total", "cells")
        terms = staging.save(terms.join(split, "digest", "left_anti").select("lang", "digest", "term", "total", "cells").unionByName(exact), "terms-exact")

    each = terms.select("lang", "digest", "term", "total", F.explode("cells").alias("cell")).select("lang", "digest", "term", "total", "cell.source", "cell.n")
    sizes = each.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    of_lang = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("lang_n"))
    groups = cells.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(of_lang, "lang", "left").fillna(0, ["n", "v", "lang_n"])
    groups = groups.withColumn("place", F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1)
    groups = staging.save(groups, "groups")

    total, most = terms.agg(F.coalesce(F.sum(F.size("cells")), F.lit(0))).first()[0], groups.agg(F.max("place")).first()[0] or 0
    blocks = max(1, -(-total // _CELLS))
    tiles = F.explode(F.sequence(F.lit(0), F.lit(most // _TILE)))
    left = terms.select("lang", F.pmod(F.xxhash64("digest"), F.lit(blocks)).cast("int").alias("block"), tiles.alias("tile"), "cells")
    right = groups.select("lang", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "source", "n", "v", "place")
    right = right.select("*", tiles.alias("tile")).withColumn("own", F.expr(f"place div {_TILE} = tile")).drop("place")
    sums = left.groupBy("lang", "block", "tile").cogroup(right.groupBy("lang", "block", "tile")).applyInArrow(
        lambda terms, groups: _pair_sums(terms, groups), "lang string, source string, item string, value long"
    )
    best = W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(best))

    shares = each.join(groups.select("lang", "source", F.col("n").alias("source_n"), "v", "lang_n"), ["lang", "source"])
    shares = shares.withColumn("p", _share_column("n", "source_n + v")).withColumn("q", _share_column("total", "lang_n + v")).where("p > q")
    shares = shares.withColumn("value", F.expr("((p - q) * (p - q)) div q"))
    first = shares.withColumn("near", F.rank().over(W.partitionBy("lang", "source").orderBy(F.col("value").desc()))).where(F.col("near") <= top)
    named = first.select("lang", "source", "digest", "term", "value").join(names.select("digest", "low"), "digest")
    ranked = named.select("lang", "source", F.coalesce("term", "low").alias("item"), "value").withColumn("rank", F.row_number().over(best))
    return (
        pairs.withColumn("part", F.lit("pair"))
        .unionByName(ranked.where(F.col("rank") <= top).withColumn("part", F.lit("term")))
        .select("lang", "source", "part", "item", "value", "rank")
    )
