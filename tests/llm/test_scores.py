import math
import random
import tracemalloc
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tallyweave.llm import language, quality, toxicity
from tallyweave.llm.common import in_fold

from .helpers import documents, words

SYLLABLES = {"aa": "an on er th ing re ed".split(), "bb": "der ung sch ein keit lich".split(), "cc": "ño ción ar os ue llo".split()}


def prose(rnd, lang, n):
    return " ".join("".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randint(1, 3))) for _ in range(n))


def test_language_on_held_out_rows(spark):
    rnd = random.Random(2)
    rows = [(i, prose(rnd, lang, rnd.randint(3, 60)), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 60)]
    rows += [(900, None, "aa"), (901, "", "bb"), (902, "12 ½² ① Ⅷ .. 3!", "aa"), (903, prose(rnd, "bb", 9000), None), (904, "x", None)]
    docs = documents(spark, rows).withColumnRenamed("size", "score").withColumnRenamed("node", "lang_pred")
    model = language.fit_language_model(docs)
    got = language.predict_language(docs, model).withColumn("held", in_fold(F.col("doc_id"))).collect()
    assert len(got) == len(rows) and model.languages == ["aa", "bb", "cc"]
    for r in got:
        if r["doc_id"] < 900:
            assert r["lang_pred"] == r["lang"] and 0 <= r["score"] <= 1
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and by[903]["lang_pred"] == "bb"
    assert by[900]["rejected"] and by[904]["lang_pred"] in model.languages
    none = language.fit_language_model(docs.limit(0))
    assert {r["lang_pred"] for r in language.predict_language(docs, none).collect()} == {"und"}


def toxic_rows(rnd, n):
    rows, labels = [], []
    for i in range(n):
        w = words(prose(rnd, "aa", 60))
        bad = rnd.random() < 0.2
        for _ in range(rnd.randint(1, 4) if bad else 0):
            w[rnd.randrange(60)] = rnd.choice(["idiot", "scum,", "Loser"])
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = toxic_rows(random.Random(3), 500)
    rows += [(9000, None), (9001, ""), (9002, "IDIOT scum"), (9002, "IDIOT scum")]
    docs = documents(spark, rows).withColumnRenamed("node", "toxicity")
    known = spark.createDataFrame([*labels, (None, 0, 1), (9000, 0, None)], "doc_id long, quality int, toxic int")
    index = toxicity.fit_toxicity(docs, known)
    got = toxicity.score_toxicity(docs, index).withColumn("held", in_fold(F.col("doc_id"))).collect()
    truth = {i: t for i, _, t in labels}
    held = [r for r in got if r["held"] and r["doc_id"] in truth]
    assert len(held) > 60 and sum(r["toxic_predicted"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    by = {r["doc_id"]: r for r in got}
    assert by[9000]["toxic_predicted"] == 0 and by[9000]["evidence"] == [] and by[9002]["toxic_predicted"] == 1
    assert len(by[9002]["evidence"]) == 5 and len(got) == len(rows)
    none = toxicity.fit_toxicity(docs, known.limit(0))
    assert {r["toxic_predicted"] for r in toxicity.score_toxicity(docs, none).collect()} == {0}


def test_nearest_examples_equal_brute_force(spark):
    rows, labels = toxic_rows(random.Random(5), 500)
    rows += [(600, rows[0][1]), (601, "only unseen zzzz"), (602, None)]
    index = toxicity.fit_toxicity(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), frequent=20)
    assert set(index.labels.tolist()) == {0.0, 1.0}
    counts = {d: Counter(toxicity.terms_of(t)) for d, t in rows}
    learned = set().union(*(counts[int(i)] for i in index.ids))
    assert set(index.terms) == learned and len(learned) > 200
    df = Counter(t for c in counts.values() for t in c)
    plain = {t: math.log((1 + len(rows)) / (1 + df[t])) + 1 for t in learned}
    assert all(index.idf[k] >= plain[t] - 1e-9 for t, k in index.terms.items())
    assert index.idf[index.terms["idiot"]] > 3 * plain["idiot"]

    def dense(c):
        v = np.zeros(len(index.terms) + 1)
        for t, n in c.items():
            k = index.terms.get(t)
            v[-1 if k is None else k] = math.hypot(v[-1], (1 + math.log(n)) * index.unknown) if k is None else (1 + math.log(n)) * index.idf[k]
        return v / (np.linalg.norm(v) or 1)

    examples = np.stack([dense(counts[int(i)]) for i in index.ids])
    examples[:, -1] = 0
    some = [*range(60), 600, 601, 602]
    for d, (at, cosine) in zip(some, index.nearest([counts[d] for d in some]), strict=True):
        s = examples @ dense(counts[d])
        want = np.sort(s[s > 0])[::-1][:25]
        assert len(at) == len(want) and np.allclose(cosine, np.minimum(want, 1), atol=1e-5)
        assert np.allclose(s[at], want, atol=1e-5)


def peak_of(run):
    tracemalloc.start()
    out = run()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out, peak


def test_telling_factor_holds_few_copies_of_the_uses():
    rng, n, size = np.random.default_rng(7), 400_000, 3_000
    owner = np.sort(rng.integers(0, 900, n)).astype(np.int32)
    entries, after = rng.integers(0, size, n).astype(np.int32), rng.integers(-(1 << 31), 1 << 31, n).astype(np.int32) >> 20
    toxic = (owner % 3 == 0).astype(np.int8)
    got, peak = peak_of(lambda: toxicity.telling_factor(entries, after, toxic, owner, size, 10.0))
    ratios = []
    for key, totals in ((owner, [len({*owner[toxic == y].tolist()}) for y in (1, 0)]), (after, None)):
        uses = {*zip(entries.tolist(), key.tolist(), toxic.tolist(), strict=True)}
        own, other = (np.bincount([t for t, _, z in uses if z == y], minlength=size).astype(float) for y in (1, 0))
        ratios.append(toxicity._ratio(own, other, *(totals or [sum(z == y for *_, z in uses) for y in (1, 0)])))
    assert np.allclose(got, 1 + np.minimum(*ratios) / 10.0)
    assert peak < 45 * n  # bytes; it was 56 a use
    assert len(toxicity.telling_factor(entries[:0], after[:0], toxic[:0], owner[:0], 0, 10.0)) == 0


def test_scoring_many_postings_takes_bounded_memory():
    rng, n, terms, each = np.random.default_rng(8), 1_024, 400, 256
    post_at = np.arange(terms + 1) * each
    places = np.concatenate([np.sort(rng.choice(n, each, replace=False)) for _ in range(terms)]).astype(np.int32)
    index = toxicity.LabelledIndex(
        {str(t): t for t in range(terms)}, np.ones(terms), 1.0, np.arange(n), np.zeros(n), np.ones(n), post_at, places,
        rng.random(terms * each).astype(np.float32), np.full(terms, -1), np.zeros((n, 1), np.float32), np.zeros((1, n // 64), np.float32), 5, 0.1,
    )
    texts = [{str(t): 1 for t in rng.choice(terms, 200, replace=False).tolist()} for _ in range(64)]
    found, peak = peak_of(lambda: index.nearest(texts))
    for text, (at, cosine) in zip(texts, found, strict=True):
        score = np.zeros(n)
        for t in map(int, text):
            own = slice(post_at[t], post_at[t + 1])
            score[places[own]] += index.weights[own].astype(float) / math.sqrt(200)
        best = np.argsort(-score, kind="stable")[:5]
        assert at.tolist() == best.tolist() and np.allclose(cosine, np.minimum(score[best], 1))
    assert peak < 40e6  # 3.3 million postings; it was 93 MB


def base_measures(text):
    w = words(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often, marked, seen, dup = Counter(windows), set(), set(), 0
    for i, x in enumerate(windows):
        if often[x] > 1:
            marked |= {i, i + 1, i + 2}
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(marked)


def test_quality_measures_equal_brute_force(spark):
    rnd = random.Random(6)
    rows = [(i, prose(rnd, lang, 120), lang) for i, lang in enumerate(["aa", "bb"] * 40)]
    rows += [(100, None), (101, ""), (102, "a b c a b c a b"), (103, "x\x1cy é#\n\nx\x1cy é#\n x\n x"), (104, "a b c " * 40), (105, "\t\n \r")]
    rows += [(106, " ".join("".join(chr(rnd.randrange(0x100, 0x2000)) for _ in range(6)) for _ in range(90)), "aa"), (107, prose(rnd, "aa", 30000), None)]
    docs = documents(spark, rows).withColumnRenamed("node", "lower")
    got = {r["doc_id"]: r for r in quality.quality_verdicts(docs).collect()}
    assert len(got) == len(rows)
    for r in rows:
        g, want = got[r[0]], base_measures(r[1])
        assert (g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"]) == want, r[0]
        assert g["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (g["base_failed"] and g["kept"])
    assert all(got[i]["kept"] for i in range(80)) and got[107]["kept"] and not got[106]["kept"]
    assert quality.quality_verdicts(docs.limit(0)).count() == 0


def test_kneser_ney_sums_to_one_and_equals_plain_code(spark):
    rnd = random.Random(7)
    texts = [prose(rnd, "aa", 40) for _ in range(30)] + ["zq", None, ""]
    model = quality.fit_kneser_ney(documents(spark, list(enumerate(texts))))
    grams = Counter()
    for t in texts:
        s = "   " + (t or "")
        grams.update(s[i : i + 4] for i in range(len(s) - 3))
    symbol = {c: int(model.table[ord(c)]) for c in set("".join(filter(None, texts)))}
    levels = [grams]
    while len(levels) < 4:
        levels.append(Counter(g[1:] for g in levels[-1]))

    def discount(level, c):
        n = [max(1, sum(v == k for v in level.values())) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        d = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]][min(c, 3) - 1]
        return min(max(d, 0.05), [0.95, 1.9, 2.8][min(c, 3) - 1])

    def probability(gram):
        if not gram:
            return 1 / 64
        level = levels[4 - len(gram)]
        same = {g: c for g, c in level.items() if g[:-1] == gram[:-1]}
        total = sum(same.values())
        if not total:
            return probability(gram[1:])
        c = level.get(gram, 0)
        left = sum(discount(level, x) for x in same.values()) / total
        return (c - discount(level, c) if c else 0) / total + left * probability(gram[1:])

    for gram in [*list(grams)[:40], "anzq", "zzzz", "thq ", "qqan"]:
        key = np.array([sum(symbol[x] << 6 * (3 - k) for k, x in enumerate(gram))], np.uint32)
        assert math.isclose(float(model._look_up(key, 4)[0]), math.log(probability(gram)), rel_tol=1e-4), gram
    for context in ("   ", "ant", "zzz", "zq "):
        keys = np.array([sum(symbol[x] << 6 * (3 - k) for k, x in enumerate(context)) + s for s in range(64)], np.uint32)
        assert math.isclose(np.exp(model._look_up(keys, 4)).sum(), 1, rel_tol=1e-4)


def test_characters_beyond_the_alphabet_keep_their_own_probability(spark):
    rnd = random.Random(12)
    common = "".join(chr(0x61 + k) for k in range(26)) + "".join(chr(0x3B1 + k) for k in range(17)) + "".join(chr(0x430 + k) for k in range(32))
    han = [chr(0x4E00 + k) for k in range(200)] + ["\U00020000", "\U0001F600"]
    texts = ["".join(rnd.choices(common, k=3000)) for _ in range(8)] + ["".join(rnd.choices(han, range(202, 0, -1), k=600)), None, ""]
    model = quality.fit_kneser_ney(documents(spark, list(enumerate(texts))))
    n = Counter("".join(filter(None, texts)))
    others = sorted(n, key=lambda c: (-n[c], c))[62:]
    assert set(han) & set(n) <= set(others) and {int(model.table[ord(c)]) for c in others} == {63}
    total = sum(n[c] + 1 for c in others) + 1
    assert all(math.isclose(model.within[ord(c)], math.log((n[c] + 1) / total), rel_tol=1e-5) for c in others)
    assert math.isclose(model.within[0x9FFF], -math.log(total), rel_tol=1e-5) and model.within[ord(" ")] == 0
    usual, rare = max(others, key=n.get), min(others, key=n.get)
    a, b = model.mean_log([usual * 40, rare * 40])
    assert math.isclose(b - a, math.log((n[usual] + 1) / (n[rare] + 1)), rel_tol=1e-4)


def test_prose_of_a_script_beyond_the_alphabet_is_kept(spark):
    rnd = random.Random(13)
    pool = [chr(0x4E00 + 3 * k) for k in range(60)]
    script = lambda signs, n: " ".join("".join(rnd.choices(signs, range(len(signs), 0, -1), k=2)) for _ in range(n))
    wide = "".join(chr(0x430 + k) for k in range(32)) + "".join(chr(0x3B1 + k) for k in range(17)) + "abcdefghijklmnopqrs"
    rows = [(i, " ".join("".join(rnd.choices(wide, k=5)) for _ in range(400)), "aa") for i in range(40)]
    rows += [(100 + i, script(pool, 200), "hh") for i in range(12)]
    rows += [(200, script([chr(0x8000 + 7 * k) for k in range(400)], 200), "hh")]
    got = {r["doc_id"]: r["kept"] for r in quality.quality_verdicts(documents(spark, rows).withColumnRenamed("node", "lower")).collect()}
    assert all(got[100 + i] for i in range(12)) and not got[200]
