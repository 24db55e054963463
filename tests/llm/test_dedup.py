import math
import random
import tracemalloc

import corpus_pipeline
from tallyweave.llm import line_dedup, near_dedup, similarity
from tallyweave.llm.common import Staging
from tallyweave.llm.components import connected_components

from .helpers import components, documents, words


def shingles(text, k):
    w = words("".join(c.lower() if c < "\x80" else c for c in text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def corpus(seed, n):
    rnd = random.Random(seed)
    vocabulary = [f"w{k}é" if k % 9 == 0 else f"w{k}" for k in range(400)]
    rows = []
    for i in range(n):
        if rows and rnd.random() < 0.7:
            w = words(rnd.choice(rows)[1])
            for _ in range(rnd.choice([0, 1, 1, 2, 4, 8])):
                w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
            w = w[: rnd.choice([len(w)] * 4 + [len(w) - 9])]
        else:
            w = [rnd.choice(vocabulary) for _ in range(rnd.choice([40, 90, 200]))]
        rows.append((i * 3 + 1, " ".join(w)))
    return rows


def test_components_of_chain_star_and_loop(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 500)] + [(7, 7), (None, 3), (5000, 4000)]
    got = connected_components(spark.createDataFrame(edges, "a long, b long").repartition(13), Staging(spark, "t"), "c").collect()
    want = {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(500)} | {5000: 4000, 4000: 4000}
    assert {r.node: r.component for r in got} == want and len(got) == len(want)
    none = connected_components(spark.createDataFrame([], "a long, b long"), Staging(spark, "t"), "d")
    assert none.count() == 0


def test_near_duplicates_equal_brute_force(spark):
    rows = corpus(3, 260)
    rows += [(5000, None), (5001, ""), (5002, " \n "), (5003, "one two"), (5004, "ONE two"), (5005, "one"), (5006, "Ünder ÜNDER x"), (5007, "ünder x x")]
    got = near_dedup.near_duplicates(documents(spark, rows), shingle_words=3, num=85, den=100).collect()
    sets = {d: shingles(t, 3) for d, t in rows}
    want = components(sets, lambda a, b: bool(sets[a]) and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]))
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == {d: len(s) for d, s in sets.items()}
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_dense_group_needs_rounds(spark):
    rnd = random.Random(1)
    base = [f"b{k}" for k in range(120)]
    rows = []
    for i in range(300):
        w = list(base)
        for k in rnd.sample(range(120), rnd.choice([2, 3, 4, 6])):
            w[k] = f"x{i}-{k}"
        rows.append((i, " ".join(w)))
    got = near_dedup.near_duplicates(documents(spark, rows), shingle_words=3, num=85, den=100, window=16).collect()
    sets = {d: shingles(t, 3) for d, t in rows}
    want = components(sets, lambda a, b: 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]))
    wrong = sum(want[r.doc_id] != r.component_id for r in got)
    assert wrong == 0


def test_near_edge_cases(spark):
    docs = documents(spark, [(None, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (1, "a b c d e f")])
    got = sorted((r.doc_id or -1, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect())
    assert got == [(-1, None, True), (1, 1, True), (2, 1, False), (2, 1, False)]
    assert near_dedup.keep_one_of_each(docs).columns and near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_rows_that_repeat_a_doc_id_are_documents_of_their_own(spark):
    rnd = random.Random(31)
    texts = [" ".join(rnd.choice("abcdefghijklmnop") + str(rnd.randrange(99)) for _ in range(60)) for _ in range(8)]
    near = lambda t: t.rsplit(" ", 1)[0] + " other"
    rows = [(5, texts[0]), (5, texts[1]), (7, near(texts[0])), (9, near(texts[1])), (5, texts[1]), (3, near(texts[1]) + " more"), (20, texts[2]), (20, near(texts[2])), (21, texts[3]), (22, texts[3]), (21, texts[4])]
    sets = [shingles(t, 3) for _, t in rows]
    part = components(range(len(rows)), lambda a, b: 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]))
    least = {}
    for k, p in part.items():
        least[p] = min(least.get(p, 1 << 60), rows[k][0])
    want = sorted((rows[k][0], len(sets[k]), least[p], rows[k][0] == least[p]) for k, p in part.items())
    for parts in (1, 2, 3, 29):
        docs = documents(spark, rows).repartition(parts)
        assert sorted(tuple(r) for r in near_dedup.near_duplicates(docs, shingle_words=3, num=85, den=100).collect()) == want
    kept = near_dedup.keep_one_of_each(documents(spark, rows).withColumnRenamed("size", "row"), shingle_words=3, num=85, den=100)
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted(rows[k] for k, p in part.items() if rows[k][0] == least[p])


def test_line_dedup_with_clashing_columns(spark):
    rows = [(1, "a line that is long enough\nother words stand here"), (2, "a line that is long enough!"), (3, None)]
    docs = documents(spark, rows).withColumnsRenamed({"size": "_gone", "node": "gone", "lang": "owner", "source": "which", "n_chars": "row"})
    cut = line_dedup.drop_repeated_lines(docs)
    assert cut.columns == docs.columns and {(r.doc_id, r.text, r._gone, r.gone) for r in cut.collect()} == {(1, rows[0][1], "x", "y"), (2, "", "x", "y"), (3, None, "x", "y")}


def brute_lines(rows):
    places = {}
    for d, t in rows:
        for k, raw in enumerate((t or "").split("\n")):
            if line_dedup.normal_form(raw) and d is not None:
                places.setdefault(line_dedup.normal_form(raw), []).append((d, k))
    sets = {n: frozenset(n[i : i + 8] for i in range(max(1, len(n) - 7))) for n in places}
    parts = components(sets, lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    groups = {}
    for n, p in parts.items():
        groups.setdefault(p, []).extend(places[n])
    return {x for g in groups.values() for x in sorted(set(g))[1:]}


def test_lines_equal_brute_force(spark):
    rnd = random.Random(8)
    pool = [" ".join(f"{rnd.choice('abcdefgh')}{rnd.randrange(90)}z" for _ in range(rnd.choice([3, 12, 60]))) for _ in range(60)]
    rows = []
    for i in range(80):
        lines = []
        for _ in range(rnd.randint(0, 6)):
            x = rnd.choice(pool)
            if rnd.random() < 0.5:
                k = rnd.randrange(len(x))
                x = x[:k] + rnd.choice(["Q", "", "xyz"]) + x[k + 1 :]
            lines.append(rnd.choice(["", " "]) + x.upper() if rnd.random() < 0.2 else x)
        rows.append((i, "\n".join(lines)))
    rows += [(500, None), (501, ""), (502, "ab\nAB\n\n ab "), (503, "\n\n")]
    docs = documents(spark, [*rows, (None, "ab")])
    got = {(r.doc_id, n) for r in line_dedup.line_decisions(docs).collect() for n in r.removed}
    assert got == brute_lines(rows)
    cut = {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(docs).collect()}
    assert set(cut) == {d for d, _ in rows} | {None} and cut[500] is None and cut[None] == "ab"
    for d, t in rows:
        if t is not None:
            assert cut[d] == "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in got)
    assert line_dedup.line_decisions(docs.limit(0)).count() == 0


def star_of_lines(n):
    """Rows of a frequent line and of ``n`` variants, each alike to it and not to one another."""
    rnd = random.Random(21)
    hub = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(400))
    variants = []
    for _ in range(n):
        line = list(hub)
        for k in rnd.sample(range(400), 4):
            line[k] = rnd.choice("0123456789")
        variants.append("".join(line))
    return [(i, f"{v}\n{hub}" if i % 3 == 0 else v) for i, v in enumerate(variants)]


def test_lines_of_a_crowded_bucket_equal_brute_force(spark):
    rows = star_of_lines(300)
    got = {(r.doc_id, n) for r in line_dedup.line_decisions(documents(spark, rows).repartition(16)).collect() for n in r.removed}
    assert got == brute_lines(rows)


def test_lines_of_a_bucket_in_several_blocks(spark):
    lines = dict(enumerate(x for _, t in star_of_lines(60)[1:] for x in t.split("\n")))
    sets = {i: set(line_dedup.shingle_sets([t], 8)[0].tolist()) for i, t in lines.items()}
    alike = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    texts = spark.createDataFrame(list(lines.items()), "node long, text string")
    rows = texts.selectExpr("cast(5 as bigint) as key", "node")
    links = similarity.crowded_links(rows, texts, lambda t: line_dedup.shingle_sets(t, 8), num=80, den=100, block=20).collect()
    pairs = {(r.a, r.b) for r in links}
    assert all(alike(a, b) for a, b in pairs)
    assert components(lines, lambda a, b: (a, b) in pairs or (b, a) in pairs) == components(lines, alike)


def test_documents_of_a_crowded_region_equal_brute_force(spark):
    rnd = random.Random(4)
    base = [f"b{k}" for k in range(400)]
    rows = [(0, " ".join(base))]
    for i in range(1, 500):
        w = list(base)
        for k in rnd.sample(range(400), 9):
            w[k] = f"x{i}-{k}"
        rows.append((i, " ".join(w)))
    got = near_dedup.near_duplicates(documents(spark, rows), shingle_words=3, num=85, den=100, window=8).collect()
    sets = {d: shingles(t, 3) for d, t in rows}
    want = components(sets, lambda a, b: 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]))
    assert {r.doc_id: r.component_id for r in got} == want


def test_estimate_loses_less_than_1e_5_at_the_threshold(spark):
    for t in (0.8, 0.85):
        c = round(near_dedup.estimate_floor(t) * 192)
        assert abs(near_dedup.estimate_floor(t) * 192 - c) < 1e-9
        assert sum(math.comb(192, k) * t**k * (1 - t) ** (192 - k) for k in range(c)) < 1e-5
        assert near_dedup.estimate_floor(t) < t - 0.1


def test_pipeline_near_stage_equals_brute_force(spark):
    rows = corpus(5, 200)
    got = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, documents(spark, rows), "").collect()}
    sets = {d: shingles(t, 5) for d, t in rows}
    want = components(sets, lambda a, b: bool(sets[a]) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    assert got == set(want.values())


def thue_morse(n, flip):
    return "".join("ab"[(bin(k).count("1") + flip) % 2] for k in range(n))


def test_texts_that_collide_in_running_sums_stay_apart(spark):
    rows = [(1, thue_morse(4096, 0)), (2, thue_morse(4096, 1)), (3, f"x y {thue_morse(4096, 0)} z"), (4, f"x y {thue_morse(4096, 1)} z")]
    docs = documents(spark, rows)
    assert {r.component_id for r in near_dedup.near_duplicates(docs, shingle_words=3, num=85, den=100).collect()} == {1, 2, 3, 4}
    got = {(r.doc_id, n) for r in line_dedup.line_decisions(docs).collect() for n in r.removed}
    assert got == brute_lines(rows)


def test_results_do_not_depend_on_the_number_of_partitions(spark):
    rnd = random.Random(9)
    base = [f"b{k}" for k in range(400)]
    rows = [(i, " ".join(base[:i] + [f"x{i}"] + base[i + 1 :])) for i in range(0, 24, 3)] + [(100 + d, t) for d, t in corpus(6, 60)]
    lines = star_of_lines(40) + [(500 + k, " ".join(rnd.choice(base) for _ in range(30))) for k in range(40)]
    sets = {d: shingles(t, 3) for d, t in rows}
    want = components(sets, lambda a, b: 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]))
    try:
        for n in (1, 29):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            got = near_dedup.near_duplicates(documents(spark, rows), shingle_words=3, num=85, den=100).collect()
            assert {r.doc_id: r.component_id for r in got} == want
            gone = {(r.doc_id, k) for r in line_dedup.line_decisions(documents(spark, lines).repartition(5)).collect() for k in r.removed}
            assert gone == brute_lines(lines)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_rows_that_repeat_a_doc_id(spark):
    rows = [(1, "a first line of text\nanother line here"), (1, "only this one\n\nanother line here"), (1, "only this one\n\nanother line here"), (2, "another line here")]
    cut = sorted((r.doc_id, r.text) for r in line_dedup.drop_repeated_lines(documents(spark, rows)).collect())
    assert len(cut) == 4 and [d for d, _ in cut] == [1, 1, 1, 2] and cut[3] == (2, "")
    assert sum(t.count("another line here") for _, t in {x for x in cut}) == 1
    assert sum("only this one" in t for _, t in cut) == 2


def test_component_of_a_hub_beyond_the_broadcast_bound(spark):
    edges = [(7, 100 + i) for i in range(12_000)] + [(100 + i, 100_000 + i) for i in range(500)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long").repartition(9), Staging(spark, "t"), "hub").collect()}
    assert len(got) == 12_501 and set(got.values()) == {7}


def test_few_edges_take_three_jobs_and_many_the_same_rounds(spark):
    rnd = random.Random(15)
    edges = [(rnd.randrange(900), rnd.randrange(900)) for _ in range(500)] + [(1000, 1000 + i) for i in range(9_000)] + [(None, 3), (5, 5)]
    frame = spark.createDataFrame(edges, "a long, b long").repartition(9).checkpoint()
    sc, got = spark.sparkContext, {}
    for few in (0, 500_000):
        sc.setJobGroup(group := f"components-{few}", "")
        got[few] = sorted(map(tuple, connected_components(frame, Staging(spark, "t"), "few", few=few).collect()))
        jobs = len(sc.statusTracker().getJobIdsForGroup(group))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert got[0] == got[500_000] and len(got[0]) == len({n for n, _ in got[0]})
    up = components({n: n for e in edges[:500] for n in e if e[0] != e[1]}, lambda a, b: (a, b) in held or (b, a) in held) if (held := set(edges[:500])) else {}
    assert {n: c for n, c in got[0] if n < 1000} == up
    assert jobs <= 6  # forest, count, last task and the reading here; one round alone took more


def test_candidates_of_a_crowded_region_grow_with_its_rows(spark, monkeypatch):
    rnd = random.Random(14)
    base = [f"b{k}" for k in range(300)]
    rows = []
    for i in range(700):  # any two alike by signature, few linked
        w = list(base)
        for k in rnd.sample(range(300), 8 if i % 10 else 1):
            w[k] = f"x{i}-{k}"
        rows.append((i, " ".join(w)))
    listed, verified = [], near_dedup.verified_links

    def counted(pairs, *args, **options):
        listed.append(pairs.count())
        return verified(pairs, *args, **options)

    monkeypatch.setattr(near_dedup, "verified_links", counted)
    got = near_dedup.near_duplicates(documents(spark, rows), shingle_words=3, num=85, den=100, window=8).collect()
    sets = {d: shingles(t, 3) for d, t in rows}
    want = components(sets, lambda a, b: 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]))
    assert {r.doc_id: r.component_id for r in got} == want
    assert sum(listed) <= 24 * len(rows)


def test_no_task_of_line_dedup_feeds_two_python_workers(spark, monkeypatch):
    plans, own = [], line_dedup.connected_components
    monkeypatch.setattr(line_dedup, "connected_components", lambda links, *a: plans.append(links._jdf.queryExecution().toString()) or own(links, *a))
    docs = documents(spark, [(1, "a line that is long enough"), (2, "a line that is long enough!"), (3, "a line of its own")])
    assert {r.doc_id: r.n_removed for r in line_dedup.line_decisions(docs).collect()} == {1: 0, 2: 1, 3: 0}
    assert plans and not any("MapInArrow" in p for p in plans)


def test_a_portion_of_shingles_takes_bounded_memory():
    rnd = random.Random(21)
    texts = [" ".join(f"w{rnd.randrange(5000)}" for _ in range(400)) for _ in range(1000)]
    tracemalloc.start()
    sets = [len(x) for x in near_dedup.shingle_sets(texts, 5)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sets == [len(shingles(t, 5)) for t in texts]
    assert peak < 24 << 20
