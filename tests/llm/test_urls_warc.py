import hashlib
import random

import duckdb
import pyarrow.fs as pafs
import zstandard
from immunospark.llm import url_filters as uf
from immunospark.llm import warc
from immunospark.llm.shared import new_path

PAGES = "page_id BIGINT, url STRING, html STRING, digest STRING, host STRING"


def rule_brute(url):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    best = None
    for action, text in uf.RULES:
        h, _, p = text.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(text) > len(best[1])):
            best = (action, text)
    return host, path, best


URLS = [None, "", "no scheme", "http://", "http://NET/", "https://a.example.net/en/x", "https://a.example.net/de/x", "http://notexample.com/de/", "x://example.com/de/?q",
        "http://b.example.com/de", "http://q.org/fr/1#f", "http://q.org?x=/fr/", "http://a.net#/", "http://É.net/", "http://u:p@a.org:80/fr/", "a://b://c/d", "http://a.b.co.uk/x"]


def test_rules_match_brute_force(spark):
    pages = spark.createDataFrame([(i, u, None, "x", "y") for i, u in enumerate(URLS)], PAGES)
    got = uf.judged(pages, spark.createDataFrame([], "page_id BIGINT, bad INT")).collect()
    assert len(got) == len(URLS)
    for r in got:
        host, path, best = rule_brute(URLS[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, best and best[1]), URLS[r.page_id]
        assert r.verdict == (best[0] if best else "allow")


def test_reputation_blocks_bad_hosts_and_spares_thin_evidence(spark):
    rows = [(i, f"http://bad.evil.com/{i}", None, None, None) for i in range(200)] + [(1000 + i, f"http://good{i % 50}.fine.com/{i}", None, None, None) for i in range(400)]
    rows += [(5000, "http://new.fine.com/", None, None, None), (5001, "http://once.fine.com/", None, None, None), (5002, None, None, None, None)]
    outcomes = [(i, 1) for i in range(200)] + [(1000 + i, 0) for i in range(400)] + [(5001, 1), (None, 1), (5, None)]
    got = {r.page_id: r.verdict for r in uf.judged(spark.createDataFrame(rows, PAGES), spark.createDataFrame(outcomes, "page_id BIGINT, bad INT")).collect()}
    assert {got[i] for i in range(200)} == {"block"}
    assert {v for i, v in got.items() if i >= 200} == {"allow"}


def test_urls_empty(spark):
    assert uf.judged(spark.createDataFrame([], PAGES), spark.createDataFrame([], "page_id BIGINT, bad INT")).count() == 0


def test_sql_agrees(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for f, sql in ((uf.op6_url_filters, uf.ORACLE), (warc.op4_warc, warc.ORACLE)):
        got = f(spark, sf)
        want = con.execute(f"select {', '.join(got.columns)} from ({sql})").fetchall()
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def pages_of(n=400):
    rng = random.Random(3)
    out = []
    for i in range(n):
        body = " ".join(rng.choice(["alpha", "beta", "<p>", "</p>", "näive", "x" * 9]) for _ in range(rng.choice([3, 100, 600])))
        out.append((i, f"http://h{i % 7}.org/ü {i}\r\nX: 1", body))
    big = "z" * 400_000
    out += [(2000, "u", big), (2001, None, big), (2001, None, big), (None, "u", big), (2002, "u", None), (2003, "u", ""), (2004, "u", "short"), (2005, "u", "short"), (2006, "u", "é" * 500), (2007, "u", "é" * 500), (2008, "u", "é" * 499 + "x")]
    return out


def test_archives_round_trip(spark):
    rows = pages_of()
    df = spark.createDataFrame([(i, u, h, "clash", "clash") for i, u, h in rows], PAGES)
    manifest = warc.written(df, new_path(spark, "warc"))
    got = sorted(map(tuple, warc.read(manifest).collect()), key=str)
    groups = {}
    for i, _, h in rows:
        data = (h or "").encode()
        if len(data) >= 1000 and i is not None:
            groups[data] = max(groups.get(data, -1), i)
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        top = groups.get(data, i) if i is not None else i
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "response" if top == i else "revisit", None if top == i else top))
    assert got == sorted(want, key=str)
    # the archives themselves: a leading dictionary, then frames that a plain decoder can read one by one
    path = manifest.first()["path"]
    fs, name = pafs.FileSystem.from_uri(path)
    data = fs.open_input_stream(name).read()
    assert int.from_bytes(data[:4], "little") == warc.DICT_MAGIC
    fields = [f for f, _ in warc.records(path, chunk=777)]
    assert fields[0]["WARC-Type"] == "warcinfo" and len(fields) == 1 + len([1 for _ in warc.records(path)][1:])
    assert all("\n" not in v for f in fields for v in f.values())


def test_archive_rolls_over_and_detects_damage(tmp_path):
    out = warc.Writer(f"file://{tmp_path}", "t", None, archive_bytes=2000)
    for i in range(40):
        out.add(warc.record(i, "http://a/", (f"{i}" * 300).encode(), hashlib.sha1((f"{i}" * 300).encode()).hexdigest(), None))
    done = out.close()
    assert len(done) > 1 and sum(n for _, n, _ in done) == 40
    fields, block = list(warc.records(done[0][0]))[1]
    assert warc.parsed(fields, block)[0] == 0
    try:
        warc.parsed(fields, block[:-1] + b"!")
        raise AssertionError("damage went unnoticed")
    except ValueError:
        pass


def test_warc_empty_and_dictionary(spark):
    assert warc.read(warc.written(spark.createDataFrame([], PAGES), new_path(spark, "warc"))).count() == 0
    assert warc.trained([]) is None
    held = warc.trained([warc.record(i, "http://a/", f"<html>{i} common words here</html>".encode() * 5, "00" * 20, None) for i in range(300)])
    assert zstandard.ZstdCompressionDict(held).dict_id()


def test_dictionary_sample_is_bounded_and_of_distinct_payloads(spark, monkeypatch):
    """A payload that most rows share is drawn once, and no record is longer than its bound allows."""
    monkeypatch.setattr(warc, "SAMPLE_RECORDS", 50)
    rows = [(i, "http://a/", "same " * 9000) for i in range(2000)] + [(5000 + i, "http://b/", f"page {i} " * 40) for i in range(400)] + [(7, "http://a/", "same " * 9000)] * 50
    pages = spark.createDataFrame(rows, "page_id BIGINT, url STRING, payload STRING").selectExpr("page_id", "url", "cast(payload AS BINARY) AS payload")
    got = warc.sampled(pages, warc.digests(pages))
    assert 20 <= len(got) <= 50 and max(map(len, got)) < warc.SAMPLE_BYTES + 1000 and len(set(got)) == len(got)
