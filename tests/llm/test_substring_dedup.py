import random
from collections import Counter

import numpy as np

from tallyweave.llm import substring_dedup

from .helpers import documents, words


def brute(rows, window=13):
    first = {}
    for i, t, *_ in rows:
        w = words(t)
        for k in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[k : k + window])
                first[key] = min(first.get(key, i), i)
    gone_of = {}
    for i, t, *_ in rows:
        w = words(t)
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone_of.setdefault((i, tuple(w)), set()).update(range(k, k + window))
    out = []
    for i, t, *_ in rows:
        w = words(t)
        gone = gone_of.get((i, tuple(w)), set())
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return Counter(out)


def corpus(seed, n=150):
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(90)] + ["Ünder", "ünder", "x\x00y", "語"]
    passages = [[rnd.choice(vocabulary) for _ in range(rnd.choice([12, 13, 14, 20, 60]))] for _ in range(6)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rnd.randrange(5)):
            parts += rnd.choice(passages) if rnd.random() < 0.5 else [rnd.choice(vocabulary) for _ in range(rnd.randrange(25))]
        if rows and rnd.random() < 0.2:
            parts = words(rnd.choice(rows)[1])[rnd.randrange(3) :]
        rows.append((i * 7 % 151, rnd.choice([" ", "\n", "\t ", "  "]).join(parts)))
    return rows


def got(spark, rows, parts=3, **options):
    frame = documents(spark, rows).repartition(parts)
    return Counter(tuple(r) for r in substring_dedup.remove_repeated_passages(frame, **options).collect())


def test_equals_brute_force_over_partitions(spark):
    rows = corpus(1)
    for parts in (1, 3, 17):
        assert got(spark, rows, parts) == brute(rows)


def test_nulls_repeated_rows_and_edges(spark):
    rows = corpus(2, 40)
    passage = " ".join(f"p{k}" for k in range(13))
    rows += [(1000, None), (1001, ""), (1002, " \n"), (None, passage), (None, None), (1003, passage), (1004, passage + " z"), (1004, passage + " z")]
    rows += [(1005, "p0 " + passage), (1006, passage.upper()), (1007, " ".join(passage.split()[:12])), (-5, "a b " * 30), (1008, "a b " * 20)]
    assert got(spark, rows, 5) == brute(rows)
    assert got(spark, []) == Counter()


def test_other_windows(spark):
    rows = corpus(3, 60)
    for window in (1, 2, 5, 8):
        assert got(spark, rows, 2, window=window) == brute(rows, window)


def test_long_words_and_texts(spark):
    rnd = random.Random(4)
    long = " ".join("v" * rnd.choice([3, 300, 2000]) + str(rnd.randrange(50)) for _ in range(4000))
    rows = [(1, long), (2, "start " + long[-200_000:]), (3, "x" * 2_000_000), (4, "x" * 2_000_000 + " " + "y " * 14)]
    assert got(spark, rows) == brute(rows)


def test_covers_reach_every_difference():
    for window in range(1, 40):
        period, cover, width = substring_dedup.cover_for(window)
        for i in range(period):
            for j in range(period):
                assert any((i + s) % period in cover and (j + s) % period in cover for s in range(window - width + 1))


def test_only_windows_near_shared_anchors_are_compared():
    rnd = np.random.default_rng(1)
    shared = rnd.integers(0, 1 << 60, 20).astype(np.uint64)
    a = np.concatenate([rnd.integers(0, 1 << 60, 33).astype(np.uint64), shared, rnd.integers(0, 1 << 60, 50).astype(np.uint64)])
    b = np.concatenate([rnd.integers(0, 1 << 60, 40).astype(np.uint64), shared])
    known = np.intersect1d(substring_dedup._anchors(a, 13)[1], substring_dedup._anchors(b, 13)[1])
    near = substring_dedup._near_anchors(a, known, 13)
    assert set(range(33, 41)) <= set(near.tolist()) and len(near) < 30
