"""The pipeline from end to end on a small corpus with nulls, repeats, copies and toxic documents."""

import random

import pytest

import corpus_pipeline

from .helpers import documents, words

TOXIC = "idiot moron scum vermin filth hateful loser trash stupid disgusting".split()


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rnd = random.Random(12)
    calm = [f"{a}{b}" for a in ("ba", "ko", "mi", "tu", "re", "la") for b in ("lo", "sen", "tra", "vi", "dor", "nak")]
    rows, labels = [], []
    for i in range(240):
        bad = i % 8 == 0
        w = [rnd.choice(TOXIC if bad and rnd.random() < 0.5 else calm) for _ in range(rnd.choice([30, 60, 120]))]
        rows.append((i, "\n".join(" ".join(w[k : k + 20]) for k in range(0, len(w), 20)), "en", rnd.choice(["a", "a", "a", "b", None])))
        labels.append((i, 1, int(bad)))
    copy = next(r for r in rows if r[0] % 8 == 1)
    rows += [(1000 + k, copy[1], "en", "a") for k in range(12)] + [(2000, None, None, None), (2001, "", "en", "b"), (None, "no id here at all", "en", "a"), (2002, " \n ", None, "a"), (2003, "x " * 3000, "en", "b"), copy, (2000, None, None, None)]
    sf = str(tmp_path_factory.mktemp("sf"))
    documents(spark, rows).repartition(4).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([*labels, (5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    return sf, rows, copy


def test_stages_keep_their_contracts(spark, corpus):
    sf, rows, copy = corpus
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == columns
        out.write.parquet(path := f"{sf}/{k}-{name}")
        docs = spark.read.parquet(path)
        seen[name] = docs.collect()
    bad = {r[0] for r in rows if any(w in TOXIC for w in words(r[1]))}
    after = {r.doc_id for r in seen["toxicity"]}
    assert len(bad & after) <= 0.1 * len(bad)
    assert {2000, 2001, 2002, None} <= after
    assert len({r[0] for r in rows} - bad - after) <= 3
    assert len(seen["line_dedup"]) == len(seen["toxicity"]) and len(seen["near_dedup"]) <= len(seen["line_dedup"])
    lines = [x.strip().lower() for t in {(r.doc_id, r.text) for r in seen["line_dedup"]} for x in (t[1] or "").split("\n") if x.strip()]
    assert len(lines) == len(set(lines))
    texts = {r.doc_id: r.text for r in seen["mixing"]}
    encoded = seen["bpe"]
    assert len(encoded) == len(seen["mixing"]) and all((len(r.token_ids) > 0) == bool(texts[r.doc_id]) for r in encoded)


def test_run_gives_the_same_rows_again_and_none_for_an_empty_table(spark, corpus, tmp_path):
    sf, _, _ = corpus
    one = sorted(map(str, corpus_pipeline.run(spark, sf).collect()))
    assert one and one == sorted(map(str, corpus_pipeline.run(spark, sf).collect()))
    empty = str(tmp_path)
    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(f"{empty}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").limit(0).write.parquet(f"{empty}/labels.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0
