import random
import re
from collections import Counter

import numpy as np

from tallyweave.llm import divergence

from .helpers import documents

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, top=200):
    """Every row from plain Python integers."""
    docs = [("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""), lang or "", source or "") for _, t, lang, source in rows]
    out = set()
    for lang in {x[1] for x in docs}:
        mine = [(TERM.findall(t), source) for t, other, source in docs if other == lang]
        seen = Counter(w for t, _ in mine for w in set(t))
        kept = sorted(w for w, k in seen.items() if k >= 3)
        sources = sorted({s for _, s in mine})
        counts = {s: Counter(w for t, x in mine if x == s for w in t if seen[w] >= 3) for s in sources}
        whole = sum(counts.values(), Counter())

        def share(c):
            n = sum(c.values())
            return {w: 1 + 1_000_000_000 * (c[w] + 1) // (n + len(kept)) for w in kept}

        p = {s: share(counts[s]) for s in sources}
        q = share(whole)
        gap = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(sum(gap(p[s][w], p[o][w]) for w in kept), o) for o in sources if o != s]
            terms = [(gap(p[s][w], q[w]), w) for w in kept if counts[s][w] and p[s][w] > q[w]]
            for part, items in (("pair", pairs), ("term", terms)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, w, v, k + 1) for k, (v, w) in enumerate(ranked) if part == "pair" or k < top}
    return out


def corpus(seed, n=120):
    rnd = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("Ab", "cé", "Zz", "語", "x", "qu") for b in ("a", "B", "ö", "yy", "E", "io", "u", "NN")]
    return [
        (i, " ".join(rnd.choice(vocabulary[: rnd.choice([6, 20, 48])]) + rnd.choice(["", ",", "1", "_"]) for _ in range(rnd.randrange(40))),
         rnd.choice(["en", "en", "de", None, ""]), rnd.choice(["a", "a", "a", "b", "é", None, "Z"]))
        for i in range(n)
    ]


def got(spark, rows, parts=3, **options):
    found = divergence.source_divergence(documents(spark, rows).repartition(parts), **options).collect()
    assert len(set(found)) == len(found)
    return {tuple(r) for r in found}


def test_equals_brute_force_on_nulls_ties_and_repeats(spark):
    rows = corpus(5)
    rows += rows[:9] + [(900, None, None, None), (901, "", "fr", "only"), (902, "lone", "it", "s"), (903, None, "it", "t")]
    assert got(spark, rows) == brute(rows)
    assert got(spark, rows, parts=11, top=3) == brute(rows, 3)


def test_terms_of_one_digest_are_counted_apart(spark):
    rows = corpus(6, 80)
    assert got(spark, rows, digest_bits=3) == brute(rows)
    assert got(spark, rows, digest_bits=1, parts=7) == brute(rows)


def test_no_rows(spark):
    assert got(spark, []) == set()


def test_long_texts_are_cut_between_terms(spark):
    text = "Aé b" * 500_000 + "x" * 3_000_000 + " tail,tail"
    raw = text.encode().translate(divergence._LETTERS)
    pieces = list(divergence._pieces(raw))
    assert b"".join(pieces) == raw and sum((p.split() for p in pieces), []) == raw.split() and len(pieces) >= 2
    rows = corpus(7, 60) + [(500 + k, text, "en", "a") for k in range(3)]
    assert got(spark, rows, parts=2) == brute(rows)


def test_sources_in_tiles_and_terms_in_blocks():
    import pyarrow as pa

    rnd = np.random.default_rng(3)
    names = [f"s{k:03}" for k in range(9)]
    cells = [[{"source": s, "n": int(rnd.integers(1, 9))} for s in names if rnd.random() < 0.4] for _ in range(50)]
    n = [sum(c["n"] for t in cells for c in t if c["source"] == s) for s in names]
    terms = pa.table({"cells": pa.array(cells, pa.list_(pa.struct([("source", pa.string()), ("n", pa.int64())])))})

    def sums(own, rows):
        groups = pa.table({"lang": ["l"] * 9, "source": names, "n": n, "v": [50] * 9, "own": own})
        return {(r["source"], r["item"]): r["value"] for r in divergence._pair_sums(rows, groups).to_pylist()}

    whole = sums([True] * 9, terms)
    parts = [sums([k < 4 for k in range(9)], terms), sums([k >= 4 for k in range(9)], terms)]
    assert parts[0] | parts[1] == whole and len(whole) == 72
    halves = sums([True] * 9, terms.slice(0, 20)), sums([True] * 9, terms.slice(20))
    assert {k: halves[0][k] + halves[1][k] for k in whole} == whole


def test_shares_are_exact_for_large_counts():
    rnd = random.Random(1)
    for _ in range(300):
        whole = rnd.randrange(1, 2 * 10**14)
        count = rnd.randrange(0, whole)
        assert int(divergence._share(np.array([count]), np.array([whole]))[0]) == 1 + 10**9 * (count + 1) // whole
