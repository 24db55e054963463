import base64
import hashlib

import numpy as np

from tallyweave.llm import ann, warc
from tallyweave.llm.common import Staging

SCHEMA = "vec_id long, embedding array<float>, label int, c1 string, id int"


def exact(rows, query, k):
    ids = np.array([i for i, _ in rows if i != query[0]])
    x = np.array([v for i, v in rows if i != query[0]], np.float32).astype(float)
    s = (x * np.array(query[1], np.float32).astype(float)).sum(1)
    at = np.lexsort((ids, -s))[:k]
    return ids[at].tolist(), s[at]


def test_exact_when_all_are_candidates_with_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(1)
    good = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(90)]
    good += [(100 + i, good[0][1]) for i in range(30)]
    bad = [(200, None), (220, [0.0] * 8), (240, [float("nan")] * 8), (260, [1.0] * 7), (280, [None] * 8), (None, [1.0] * 8), (300, [float("inf")] * 8)]
    df = spark.createDataFrame([(i, v, 0, "x", 1) for i, v in good + bad], SCHEMA)
    df = df.unionByName(df.where("vec_id in (3, 20)"))  # repeated rows count once
    got = ann.nearest_neighbours(df, df.where("vec_id % 20 = 0"), centroids=4, recall=1.0)
    by = {}
    for r in got.orderBy("query_id", "rank").collect():
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(by) == {0, 20, 40, 60, 80, 100, 120}
    for q, rows in by.items():
        ids, scores = exact(good, dict_row(good, q), 20)
        assert [r[1] for r in rows] == ids and [r[0] for r in rows] == list(range(1, 21))
        assert np.allclose([r[2] for r in rows], scores, rtol=0, atol=1e-12)
    few = df.where("vec_id in (0, 20, 40)")
    assert ann.nearest_neighbours(few, few).count() == 6
    assert ann.nearest_neighbours(df.limit(0), df).count() == 0


def dict_row(rows, q):
    return next(r for r in rows if r[0] == q)


def test_recall_holds_as_the_table_grows(spark):
    rng = np.random.default_rng(2)
    for n in (400, 2_000, 10_000):
        x = rng.normal(size=(n, 24)).astype(np.float32)
        df = spark.createDataFrame([(i, v.tolist(), 0, "x", 1) for i, v in enumerate(x)], SCHEMA)
        got = ann.nearest_neighbours(df, df.where("vec_id % 20 = 0"), centroids=16)
        by = {}
        for r in got.collect():
            by.setdefault(r.query_id, set()).add(r.vec_id)
        y = x.astype(float)
        hits = 0
        for q, found in by.items():
            s = y @ y[q]
            s[q] = -np.inf
            hits += len(found & set(np.argsort(-s)[:20].tolist()))
        assert len(by) == n // 20 and hits >= 0.93 * 20 * len(by), n


def test_probe_order_is_by_falling_sum():
    rng = np.random.default_rng(3)
    books = ann.Codebooks(rng.normal(size=(7, 3)), rng.normal(size=(5, 3)))
    q, counts = rng.normal(size=6), np.ones((7, 5), int)
    got = ann.probe_order(q, books, counts, 34)
    value = lambda c: books.first[c[0]] @ q[:3] + books.second[c[1]] @ q[3:]
    assert len(set(got)) == 34
    assert all(value(a) >= value(b) - 1e-12 for a, b in zip(got, got[1:], strict=False))


PAGES = "page_id long, url string, html string, digest string, first int"


def test_archives_round_trip(spark):
    html = {1: "<p>é</p>", 2: "<p>é</p>", 3: None, 4: "", 5: "WARC/1.1\r\n\r\n" * 30, 6: "x" * 5000, 7: "x" * 5000, 8: "ü\r\n0\r\n\r\n" * 700, 9: "中" * 3000}
    rows = [(i, None if i == 9 else f"http://a/{i} x\r\n", h) for i, h in html.items()]
    rows += [(None, "u", "h"), (None, "u", "<p>é</p>"), (None, "v", "h"), (20, "u", "y" * 40_000), (20, "u", "y" * 40_000), (20, "u", "z")]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], PAGES)
    staging = Staging(spark, "t")
    warc.write_archives(pages, staging.path("a"), staging, segment_chars=700, chunk_chars=100, records_per_file=5)
    records = warc.read_archives(spark, staging.path("a"))
    assert {r.type for r in records.select("type").collect()} == {"response", "revisit", "continuation"}
    whole = warc.reassemble(records).collect()
    assert all(r.valid for r in whole) and len(whole) == len(rows) == len({r.id for r in whole})
    held = {int(r.id.split(":")[2]): r for r in whole if r.type == "response" and not r.id.startswith(("<urn:page::", "<urn:page:20:"))}
    assert set(held) == {1, 3, 5, 6, 8, 9} and all(bytes(r.payload) == (html[i] or "").encode() for i, r in held.items())
    every = warc.archive_round_trip(pages, segment_chars=700, chunk_chars=100).collect()
    got = {r.page_id: r for r in every}
    first = {2: 1, 4: 3, 7: 6}
    for i, h in html.items():
        p, r = (h or "").encode(), got[i]
        assert r.payload_bytes == len(p) and r.payload_digest == base64.b32encode(hashlib.sha1(p).digest()).decode()
        assert (r.record_type, r.refers_to) == (("revisit", first[i]) if i in first else ("response", None))
    assert sorted((r.payload_bytes, r.record_type, r.refers_to) for r in every if r.page_id == 20) == [(1, "response", None), (40000, "response", None), (40000, "revisit", 20)]
    assert sorted((r.payload_bytes, r.record_type, r.refers_to or 0) for r in every if r.page_id is None) == [(1, "response", 0), (1, "revisit", 0), (9, "revisit", 1)]
    kept = {r.page_id: r.record_type for r in warc.archive_round_trip(pages, min_dedup_bytes=9).collect()}
    assert kept[4] == "response" and kept[2] == "revisit"
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_header_lines_in_any_form():
    data = b"WARC/1.0\r\nwarc-type:response\r\nno colon here\r\nWARC-RECORD-ID: <a:b>\r\nContent-length:3\r\n\r\nabc\r\n\r\n"
    (record,) = warc.parse_records(data)
    assert record[0] == "<a:b>" and record[1] == "response" and record[-1] == b"abc"


def test_broken_segments_are_told(spark):
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n3;x=1\r\nabc\r\n0\r\n\r\n"
    digest = warc.payload_digest(b"abc")
    cut = lambda name, total, numbers: [
        (name if n == 1 else f"{name}-{n}", "response" if n == 1 else "continuation", None if n == 1 else name, n, total if n == 3 else None, digest if n == 1 else None, None, "u", block[a:b])
        for n, a, b in [(1, 0, 20), (2, 20, 50), (3, 50, len(block))] if n in numbers
    ]
    rows = cut("whole", len(block), {1, 2, 3}) + cut("gap", len(block), {1, 3}) + cut("short", 999, {1, 2, 3}) + cut("orphan", len(block), {2, 3})
    rows.append(("bad", "response", None, None, None, digest, None, "u", block[:-5]))
    got = {r.id: r for r in warc.reassemble(spark.createDataFrame(rows[::-1], warc._RECORD)).collect()}
    assert bytes(got["whole"].payload) == b"abc" and got["whole"].valid
    assert not any(got[x].valid for x in ("gap", "short", "orphan", "bad"))
