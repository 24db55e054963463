import hashlib
import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

import corpus_pipeline
from tallyweave.llm import bpe
from tallyweave.llm.queries import tokenizer_file

from .helpers import documents

PATH = tokenizer_file("byte_bpe_50k.json")


def test_ids_equal_the_library():
    own, library = bpe.ByteBPE(open(PATH).read()), Tokenizer.from_file(PATH)
    parts = "a aa th e   \n \t \r\n 's 'LL 1 23 é ß 中文 😀 !! ... <|endoftext|>   　 \x1c \x85 \x00 the ing aaaa ==== ​".split(" ") + [" ", "  "]
    rnd = random.Random(4)
    texts = ["", " ", "a" * 3000, " " * 1000, "=" * 999, "<|endoftext|>", "x <|endoftext|> y"]
    texts += ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(3000)]
    texts += ["".join(rnd.choice("abetinghosrl ") for _ in range(60)) for _ in range(1000)]
    texts += ["".join(chr(c) + "a " for c in range(k, k + 64) if not 0xD800 <= c < 0xE000) for k in range(0, 0x3000, 64)]
    for t in texts:
        ids = np.frombuffer(own.encode(t), np.int32).tolist()
        want = library.encode(t, add_special_tokens=False).ids
        assert ids == want, repr(t[:60])
        assert own.decode(ids) == library.decode(want, skip_special_tokens=False)
    assert own.decode([-1, 10**9]) == ""


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "_CACHE", 20)
    own, library = bpe.ByteBPE(open(PATH).read()), Tokenizer.from_file(PATH)
    rnd = random.Random(5)
    for _ in range(200):
        t = " ".join("".join(rnd.choice("abcde") for _ in range(rnd.randint(1, 6))) for _ in range(20))
        assert np.frombuffer(own.encode(t), np.int32).tolist() == library.encode(t, add_special_tokens=False).ids
    assert len(own.words.now) <= 20 and len(own.words.before) <= 20


def test_round_trip_of_rows(spark):
    rows = [(1, "Hello  world\n"), (2, None), (3, ""), (3, ""), (None, "x y"), (4, "long " * 20000)]
    docs = documents(spark, rows).withColumnRenamed("node", "token_ids")
    coded = bpe.encode_documents(docs, PATH)
    assert coded.columns.count("token_ids") == 1
    back = bpe.decode_documents(coded, PATH).collect()
    assert sorted((r["text"] or "", r["decoded"]) for r in back) == sorted((t or "", t or "") for _, t in rows)
    digests = {r["doc_id"]: r for r in bpe.token_digests(docs, PATH).collect()}
    ids = Tokenizer.from_file(PATH).encode("Hello  world\n", add_special_tokens=False).ids
    assert digests[1]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert digests[2]["n_tokens"] == 0 and digests[2]["decoded_sha256"] == hashlib.sha256(b"").hexdigest()
    assert bpe.encode_documents(docs.limit(0), PATH).count() == 0


def test_a_lean_task_lets_go_of_the_encoder(monkeypatch):
    made, shared = [], SimpleNamespace(value=(1, open(PATH).read()))
    monkeypatch.setattr(bpe, "ByteBPE", lambda *a, own=bpe.ByteBPE: made.append(own(*a)) or made[-1])
    texts = ["Hello  world\n", None, "", "x y " * 900]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4)), pa.array(texts)], names=["doc_id", "text"])
    plain, lean = ([b.to_pylist() for b in bpe._encoded([batch], shared, "text", ["doc_id"], "ids", k)] for k in (False, True))
    assert plain == lean
    assert not bpe._LOADED
    bpe._LOADED.clear()
    [*bpe._encoded([batch], shared, "text", ["doc_id"], "ids", True)]
    assert not bpe._LOADED and made[-1].known.most == bpe._CACHE // 4


def test_the_pipeline_encodes_lean(spark, monkeypatch):
    asked = {}
    monkeypatch.setattr(corpus_pipeline.bpe, "encode_documents", lambda df, path, **options: asked.update(options) or df)
    corpus_pipeline.encode(spark, documents(spark, [(1, "a")]), "")
    assert asked["lean"]
