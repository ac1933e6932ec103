"""URL filters and WARC archives."""

import os
import random
import time

import pyarrow as pa
import pytest
import zstandard

from tidepool.llm import warc
from tidepool.llm.shared import Scratch
from tidepool.llm.urls import build_filter, filter_urls, split_url

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("WWW.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/es", "allow"), ("x", None, "block")]


def plain_verdict(url):
    host, path = split_url(url)
    fits = [(len(h) + len(p), h.lower() + p, v) for h, p, v in RULES if p and host and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
    return (host, path, *((max(fits)[1:]) if fits else (None, "allow")))


def test_url_verdicts(spark):
    rng = random.Random(1)
    parts = ["example", "www", "com", "net", "a", "com.example", ""]
    urls = [f"{rng.choice(['http://', 'HTTPS://', '', '://'])}{'.'.join(rng.choices(parts, k=rng.randrange(1, 5))).upper() if rng.random() < 0.2 else '.'.join(rng.choices(parts, k=3))}{rng.choice(['', '/', '/en/1', '/es/x?y=/en/', '/es', '?/en/', '#a', '/en', '/EN/'])}" for _ in range(400)]
    urls += [None, "", "://", "http://com", "http://com/", "http://www.example.com/en/#x", "http://é.com/ü"]
    df = spark.createDataFrame([(i % 350, u, 1) for i, u in enumerate(urls)], "page_id long, url string, rule int")
    got = sorted(map(tuple, filter_urls(df, spark.createDataFrame(RULES, "host string, path string, verdict string")).collect()), key=str)
    assert got == sorted(((i % 350, *plain_verdict(u)) for i, u in enumerate(urls)), key=str)
    assert filter_urls(df.limit(0), spark.createDataFrame(RULES, "host string, path string, verdict string")).collect() == []
    none = filter_urls(df, spark.createDataFrame([], "host string, path string, verdict string"), otherwise="block").collect()
    assert {r.verdict for r in none} == {"block"} and len(none) == len(urls)


def test_very_long_hosts_and_paths(spark):
    urls = ["http://" + "a." * 20_000 + "example.com/en/x", "http://" + "a." * 20_000 + "www.example.com/en/" + "/en" * 200_000, "http://" + "n" * 1_000_000 + ".net/es/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    began = time.time()
    got = {r.page_id: (r.rule, r.verdict) for r in filter_urls(df, spark.createDataFrame(RULES, "host string, path string, verdict string")).collect()}
    assert got == {0: ("example.com/en/", "block"), 1: ("www.example.com/en/", "allow"), 2: ("net/es/", "block")} and time.time() - began < 60


def test_bloom_has_no_false_negatives(spark):
    names = [f"host{i}.com\n/p" for i in range(3000)]
    bloom = build_filter(spark.createDataFrame([(n,) for n in names], "rule string"), len(names), 16, 64_000_000)
    assert bloom.passes(names).all()
    assert bloom.passes([n + "x" for n in names]).mean() < 0.05
    tiny = build_filter(spark.createDataFrame([(n,) for n in names], "rule string"), len(names), 16, 64)
    assert tiny.words.shape == (1, 8) and tiny.passes(names).all()


def test_round_trip(spark):
    pages = [(1, "http://a/é \n", "x" * 500), (2, None, "x" * 500), (3, "http://b", None), (4, "http://c", ""), (5, "u", "héé\r\n\r\nWARC/1.1"), (6, "v", "x" * 500), (6, "v", "x" * 500), (None, "w", "x" * 500), (None, "z", "alone")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 as payload_digest")
    got = sorted(map(tuple, warc.archive_round_trip(df).collect()), key=str)
    latest = {}
    for i, _, h in pages:
        if i is not None:
            latest[h or ""] = max(i, latest.get(h or "", i))
    want = []
    for i, _, h in pages:
        data, top = (h or "").encode(), latest.get(h or "")
        visits = top is not None and (i is None or i < top)
        want.append((i, len(data), warc.digest32(data), "revisit" if visits else "response", top if visits else None, None))
    assert got == sorted(want, key=str)
    assert warc.archive_round_trip(df.limit(0)).collect() == []


def test_small_payloads_are_not_revisits(spark):
    df = spark.createDataFrame([(1, "a", "abc"), (2, "b", "abc"), (3, "c", "abcdef"), (4, "d", "abcdef")], "page_id long, url string, html string")
    got = warc.read_archives(spark, warc.write_archives(df, Scratch(spark, "t"), least_bytes=5, archive_bytes=300))
    assert {r.page_id: r.refers_to for r in got.collect()} == {1: None, 2: None, 3: 4, 4: None}


def test_attempts_do_not_mix(spark):
    """A partition that is written twice in another order of rows: each record is read once."""
    scratch = Scratch(spark, "t")
    folder = f"{scratch.root}/archives"
    os.makedirs(folder)
    rows = [{"page_id": k, "url": "u", "html": str(k) * (50 if k % 2 else 400), "refers_to": None} for k in range(9)]
    write = warc._writer(folder, 700, 500, "2025-01-01T00:00:00Z")
    first, second = (pa.RecordBatch.from_pylist(x) for x in (rows, rows[::-1]))
    lost = [r for b in write(iter([first])) for r in b.to_pylist()]
    kept = [r for b in write(iter([second])) for r in b.to_pylist()]
    assert len({r["archive"] for r in lost + kept}) == len(lost) + len(kept) == len(os.listdir(folder)) > 3
    scratch.save(spark.createDataFrame(kept, "archive string, records long"), "manifest")
    got = warc.read_archives(spark, f"{scratch.root}/manifest").collect()
    assert sorted(r.page_id for r in got) == list(range(9)) and all(r.problem is None for r in got)
    short = warc.records_of(spark.createDataFrame([(kept[0]["archive"], 77)], "archive string, records long")).where("problem is not null").collect()
    assert [r.problem for r in short] == [f"bad archive: {kept[0]['records']} of 77 records"]


def test_common_pages_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(warc, "CROWD", 5)
    pages = [(k, "u", "same") for k in range(40)] + [(100 + k, "u", f"p{k // 2}") for k in range(10)] + [(None, "u", "same"), (300, "u", "x" * 2_000_000)]
    got = {r.page_id: r.refers_to for r in warc.archive_round_trip(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    want = {k: 39 for k in range(39)} | {39: None, None: 39, 300: None} | {100 + k: 101 + k if k % 2 == 0 else None for k in range(10)}
    assert got == want


def test_archives_are_validated():
    good = [warc.record(i, "u", b"payload %d" % i, None, "2025-01-01T00:00:00Z") for i in range(50)]
    data = warc.archive(good, warc.train(good, 1000))
    assert list(warc.read_archive(data)) == good
    assert all(warc.parse_record(r)["problem"] is None for r in good)
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(warc.read_archive(data[:-5]))
    with pytest.raises(ValueError):
        list(warc.read_archive(b"\x00" * 20))
    bad = [good[0][:-1], good[0].replace(b"payload", b"pAyload"), good[0].replace(b"WARC/1.1", b"WARC/9"), good[0].replace(b"Content-Length: ", b"Content-Length: 9"), b"", b"WARC/1.1\r\n\r\n"]
    assert all(warc.parse_record(r)["problem"] for r in bad)
