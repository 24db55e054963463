import numpy as np

from tallyweave.llm import mixing, ordering
from tallyweave.llm.queries import tokenizer_file

from .helpers import documents, words


def test_targets_reshare_excess(spark):
    rows = spark.createDataFrame([("a", 10), ("b", 100), (None, 1000)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(rows).collect()}
    assert got["a"] == 20.0 and got["b"] == 200.0 and got[None] == 1665.0 - 220.0


def test_mix_takes_near_target_and_at_most_twice(spark):
    rows = [(i, "w " * (i % 37), "en", None if i % 3 == 0 else f"s{i % 4}") for i in range(600)] + [(None, None), (7, "again"), (7, "again")]
    got = mixing.mix_sources(documents(spark, rows)).collect()
    assert len(got) == len(rows) and "node" in got[0].asDict()
    by = {}
    for r in got:
        assert r["size"] == len(words(r["text"])) and 0 <= r["taken"] <= 2 * r["size"]
        t = by.setdefault(r["source"], [0, r["target"], 0, r["source_size"]])
        t[0] += r["taken"]
        t[2] += r["size"]
    for taken, target, size, stated in by.values():
        assert size == stated and abs(taken - target) <= 80
    again = mixing.mix_sources(documents(spark, rows).repartition(7)).collect()
    key = lambda r: (str(r["doc_id"]), r["text"] or "", r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_mixed_rows_and_empty_table(spark):
    docs = documents(spark, [(i, f"a b c {i}") for i in range(50)])
    mixed = mixing.mixed_documents(docs)
    taken = {r["doc_id"]: r["copies"] for r in mixing.mix_sources(docs).collect()}
    counts = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert mixed.columns == docs.columns and counts == {d: c for d, c in taken.items() if c}
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_feistel_is_a_bijection():
    for n in (1, 2, 3, 17, 1000, 4097):
        for key in (0, 5, 2**70):
            assert sorted(ordering.feistel_slots(np.arange(n), n, key).tolist()) == list(range(n))
    assert ordering.feistel_slots(np.arange(1000), 1000, 1).tolist() != ordering.feistel_slots(np.arange(1000), 1000, 2).tolist()


def test_shards_hold_every_sequence_at_its_slot(spark, tmp_path):
    import base64

    import tiktoken

    path = tokenizer_file("byte_bpe_50k.tiktoken")
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    plain = tiktoken.Encoding("t", pat_str=ordering.PIECES, mergeable_ranks=table, special_tokens={})
    rows = [(i, f"text number {i} " * (i % 40)) for i in range(60)] + [(None, None), (3, "same"), (3, "same"), (77, "long text " * 20_000)]
    docs = documents(spark, rows)
    docs.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    out = f"file://{tmp_path}/shards"
    got = ordering.training_order(docs, path, out, length=16, shard_sequences=10).collect()
    n = len({r.slot for r in got})
    assert {r.slot for r in got} == set(range(n))
    found = ordering.read_slots(out, 0, n, length=16, shard_sequences=10)
    assert len(found) == n and sum((row == 65535).any() for row in found) <= 4
    whole = {}
    for r in sorted(got, key=lambda r: r.piece_no):
        at = r.byte_offset % 32 // 2
        assert r.byte_offset // 32 == r.slot % 10 and r.shard == r.slot // 10
        whole.setdefault(r.doc_id, []).append(found[r.slot][at : at + r.n_tokens].tolist())
    for i, text in rows[:60]:
        if i != 3:
            assert sum(whole[i], []) == [*plain.encode_ordinary(text), 50256]
    assert sum(r.n_tokens for r in got) == int((found != 65535).sum())
    assert (ordering.read_slots(out, 7, 9, length=16, shard_sequences=10) == found[7:16]).all()
    assert ordering.shard_table(spark, out).count() == -(-n // 10)
    other = {(r.doc_id, r.piece_no, r.slot) for r in ordering.training_order(docs, path, f"{out}2", length=16, shard_sequences=10).collect()}
    assert other == {(r.doc_id, r.piece_no, r.slot) for r in got}
    assert ordering.training_order(docs.limit(0), path, f"{out}3").count() == 0


def test_only_tokens_and_slots_are_shuffled(spark, tmp_path, monkeypatch):
    docs = documents(spark, [(i, f"text number {i} " * (i % 9)) for i in range(40)])
    dealt, deal = [], type(docs).repartitionById

    def noted(df, *args):
        dealt.append(df.columns)
        return deal(df, *args)

    monkeypatch.setattr(type(docs), "repartitionById", noted)
    got = ordering.training_order(docs, tokenizer_file("byte_bpe_50k.tiktoken"), f"file://{tmp_path}/shards", length=16, shard_sequences=10)
    assert got.count() and dealt == [["tokens", "slot"]]
