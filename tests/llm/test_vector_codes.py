import hashlib
import math
import random

import numpy as np
import pytest

from tallyweave.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, key string, error long"


def brute(rows, parts=8, entries=16, rounds=6):
    """Every output row from plain Python integers."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    if not kept:
        return []
    vectors = [[math.floor(4096 * float(np.float32(x))) for x in r[1]] for r in kept]
    m = len(vectors[0]) // parts
    cut = [[v[k * m : (k + 1) * m] for k in range(parts)] for v in vectors]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))[:entries]
    books = [[cut[i][k] for i in order] for k in range(parts)]
    near = lambda p, b: min((sum((x - y) ** 2 for x, y in zip(p, e, strict=True)), j) for j, e in enumerate(b))
    for _ in range(rounds):
        for k in range(parts):
            owner = [near(c[k], books[k])[1] for c in cut]
            for j in range(len(order)):
                mine = [c[k] for c, o in zip(cut, owner, strict=True) if o == j]
                if mine:
                    books[k][j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    done = [[near(c[k], books[k]) for k in range(parts)] for c in cut]
    errors = [sum(d for d, _ in x) for x in done]
    by = {}
    for r, e in zip(kept, errors, strict=True):
        by[r[2]] = by.get(r[2], 0) + e
    return sorted(((r[0], "".join(f"{j:02x}" for _, j in x), e, by[r[2]], sha) for r, x, e in zip(kept, done, errors, strict=True)), key=str)


def got(spark, rows, partitions=3, **options):
    frame = spark.createDataFrame([(*r, "c", "k", 7) for r in rows], SCHEMA).repartition(partitions)
    return sorted((tuple(r) for r in vector_codes.compress_vectors(frame, **options).collect()), key=str)


def clustered(seed, n, dims=16):
    rnd = random.Random(seed)
    centres = [[rnd.uniform(-1, 1) for _ in range(dims)] for _ in range(9)]
    return [(i, [x + rnd.gauss(0, 0.05) for x in rnd.choice(centres)], rnd.choice([1, 2, None])) for i in range(n)]


def test_equals_brute_force_with_ties_repeats_and_unfit_vectors(spark):
    rows = clustered(1, 300)
    rows += rows[:20] + [(3, [0.0] * 16, 1), (None, [0.25] * 16, None), (None, [0.25] * 16, 2)]
    rows += [(900 + k, [k % 3 / 8.0] * 16, 5) for k in range(30)]
    rows += [(800, None, 1), (801, [None] * 16, 1), (802, [float("nan")] + [0.0] * 15, 1), (803, [float("-inf")] * 16, 2)]
    want = brute(rows)
    assert got(spark, rows) == want and got(spark, rows, 7) == want


def test_few_rows_and_none(spark):
    rows = clustered(2, 5, 8)
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == [] == got(spark, [(1, None, 2)])


def test_components_that_pass_machine_integers(spark):
    rows = [(i, [v[0] * 3e4, *v[1:]], c) for i, v, c in clustered(3, 60, 8)]
    assert got(spark, rows, rounds=3) == brute(rows, rounds=3)
    huge = vector_codes.integers(np.array([[1e30, -1e30, 0.5]]), 4096)
    assert huge[0].tolist() == [math.floor(4096 * 1e30), math.floor(-4096 * 1e30), 2048]


def test_unequal_lengths_raise(spark):
    with pytest.raises(ValueError):
        got(spark, [(1, [0.0] * 8, 1), (2, [0.0] * 16, 1)])
    with pytest.raises(ValueError):
        got(spark, [(1, [0.0] * 9, 1)])


def test_nodes_are_assigned_whole_where_boxes_allow():
    points = np.array([[int(4096 * x) for x in v] for _, v, _ in clustered(4, 4000, 8)])
    tree = vector_codes.build_tree(points, 32)
    book = np.array([points[tree["at"][k * 450]] for k in range(8)])
    code, sums, counts, settled = vector_codes.walk(tree, book)
    real = tree["at"] >= 0
    want = vector_codes._exact(tree["points"][real], book).argmin(1)
    assert (code[real] == want).all() and counts.tolist() == np.bincount(want, minlength=8).tolist()
    assert all((sums[k] == tree["points"][real][want == k].sum(0)).all() for k in range(8))
    assert settled["whole"] > 2000 and settled["pruned"] > 0 and settled["whole"] + settled["single"] == 4000
