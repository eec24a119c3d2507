import base64
import datetime
import gzip
import hashlib
import random

import pytest

from stratacube.llm import warc


def brute(rows, least=0):
    first = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= least:
            first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        f = first.get(h or "")
        again = f is not None and i != f and sum((x or "") == (h or "") for *_, x in rows) > 1
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", f if again else None))
    return sorted(out, key=str)


ROWS = [
    *[(i, f"http://www.example{i % 3}.com:80/P{i % 7}?q={i}", f"<p>{i % 11}</p>") for i in range(60)],
    (100, None, None), (101, "", ""), (102, "bad\r\nHeader: x y", "é日本\r\n\r\nWARC/1.1"), (103, "http://[broken", "\x00\x01"), (None, "http://a.b/", "<p>3</p>"), (104, "http://a.b/é", "z" * 200_000), (3, "http://again/", "<p>3</p>"), (-1, "http://minus/", "<p>5</p>"),
]


@pytest.mark.parametrize("least,records,fan", [(0, warc.FILE_RECORDS, 256), (9, 5, 256), (0, 3, 4)])
def test_round_trip(spark, tmp_path, monkeypatch, least, records, fan):
    monkeypatch.setattr(warc, "FILE_RECORDS", records)
    monkeypatch.setattr(warc, "FAN_IN", fan)  # with 4, the runs are merged in several passes
    pages = spark.createDataFrame([(*r, "c") for r in ROWS], "page_id long, url string, html string, digest string").repartition(4)
    got = warc.archive(pages, least, folder=f"file://{tmp_path}/w").collect()
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=str) == brute(ROWS, least)
    assert [warc.order(tuple(r)) for r in got] == sorted(warc.order(tuple(r)) for r in got)
    for r in got[::7]:
        with open(r.file.removeprefix("file://"), "rb") as f:
            f.seek(r.offset)
            headers, _, payload = warc.parsed(gzip.decompress(f.read(r.length)))
        assert warc.page_of(headers["warc-record-id"]) == r.page_id and (r.record_type == "revisit" or len(payload) == r.payload_bytes)


def test_histories_are_in_the_order_of_time(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_RECORDS", 7)
    monkeypatch.setattr(warc, "BATCH_ROWS", 4)
    r = random.Random(4)
    start = datetime.datetime(2020, 1, 1, tzinfo=datetime.UTC)
    rows = [(i, f"http://h{i % 3}.org/", f"v{r.randrange(9)}", start + datetime.timedelta(microseconds=r.randrange(10**13)) if i % 10 else None, "x") for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, at timestamp, date string").repartition(6)
    got = warc.archive(pages, folder=f"file://{tmp_path}/w", date_col="at").collect()
    when = lambda at: warc.UNDATED if at is None else at.strftime("%Y-%m-%dT%H:%M:%S.%fZ")
    assert [(x.url_key, x.captured, x.page_id) for x in got] == sorted((warc.url_key(u), when(at), i) for i, u, _, at, _ in rows)


def test_damage_is_noticed(tmp_path):
    whole = gzip.compress(warc.record(1, "http://a/", b"abc", "X" * 32, None))
    (tmp_path / "x.warc.gz").write_bytes(whole)
    with pytest.raises(ValueError, match="digest"):
        warc.captures(f"file://{tmp_path}/x.warc.gz")
    (tmp_path / "y.warc.gz").write_bytes(whole[:-9])
    with pytest.raises(ValueError, match="complete"):
        warc.captures(f"file://{tmp_path}/y.warc.gz")


def test_loser_tree():
    r = random.Random(1)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted(r.choices(range(50), k=r.randrange(30))) for _ in range(k)]
        assert list(warc.LoserTree([iter(x) for x in runs], lambda x: x)) == sorted(x for run in runs for x in run)


def test_url_keys():
    assert warc.url_key("HTTPS://www.Example.com:443/A/b?X=1#f") == "com,example)/a/b?x=1"
    assert warc.url_key("http://m.example.com:8080") == "com,example,m:8080)/" and warc.url_key(None) == ")"


def test_empty(spark):
    assert warc.archive(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
