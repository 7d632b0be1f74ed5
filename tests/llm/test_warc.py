import gzip
import hashlib
from pathlib import Path

import pytest

from logquarry.llm import warc


def pages():
    hot = "<p>hot</p>" * 30
    rows = [(i, f"http://a.example/{i}", hot if i % 3 == 0 else f"<p>{i % 40}</p>" * (i % 25)) for i in range(5, 400)]
    return rows + [(400, "http://x/ y\r\nz", None), (401, None, "É" * 60), (402, None, "É" * 60), (None, "u", "É" * 60), (403, "t", hot), (403, "t", hot), (404, "l", "long" * 200_000)]


def brute(rows):
    out = []
    for i, _, t in rows:
        raw = (t or "").encode()
        same = [j for j, _, u in rows if (u or "") == (t or "") and j is not None] if len(raw) >= 100 else []
        first = min(same, default=None)
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "response" if first in (None, i) else "revisit", None if first in (None, i) else first))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(*r, "z") for r in pages()], "page_id long, url string, html string, digest string")


def test_round_trip_and_same_bytes_twice(spark, frame, tmp_path):
    for k in (1, 2):
        warc.write_warc(frame.repartition(3 * k), f"file://{tmp_path}/{k}", shard_bytes=20_000, file_bytes=4_000)
        got = warc.read_warc(spark, f"file://{tmp_path}/{k}", payloads=True).collect()
        assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == brute(pages())
        html = {r.page_id: r.html for r in got if r.record_type == "response"}
        assert all(html[i] == (t or "") for i, _, t in pages() if i in html)
    one, two = ({p.name: p.read_bytes() for p in (tmp_path / str(k) / "data").iterdir()} for k in (1, 2))
    assert one == two and len(one) > 10
    assert not (tmp_path / "1/_parts").exists()
    assert gzip.decompress(next(iter(one.values()))).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")


def test_a_changed_file_and_a_stray_file_are_found_out(spark, frame, tmp_path):
    uri = f"file://{tmp_path}/w"
    warc.write_warc(frame, uri, shard_bytes=20_000)
    files = sorted((Path(tmp_path) / "w/data").iterdir())
    (files[0].parent / "shard-999999-0000.warc.gz").write_bytes(b"left over")
    assert warc.read_warc(spark, uri).count() == len(pages())
    files[0].write_bytes(files[1].read_bytes())
    with pytest.raises(Exception, match="differs from the manifest"):
        warc.read_warc(spark, uri).count()


@pytest.mark.parametrize("kind", ["outlier", "one id", "null id", "alike", "edges"])
def test_shards_are_bounded_whatever_the_ids(spark, tmp_path, kind):
    """20,000 pages of 2 KB in shards of a megabyte: each has at most twice that, in several files."""
    ids = {"outlier": lambda i: i, "one id": lambda i: 7, "null id": lambda i: None, "alike": lambda i: 7, "edges": lambda i: (1 << 63) - 1 - i if i % 2 else -(1 << 63) + i}[kind]
    url = (lambda i: "u") if kind == "alike" else (lambda i: f"http://a.example/{i}")
    body = (lambda i: "x" * 2000) if kind == "alike" else (lambda i: hashlib.shake_256(str(i).encode()).hexdigest(1000))
    rows = [(ids(i), url(i), body(i)) for i in range(20_000)] + [(1 << 50, "u", "far")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    uri = f"file://{tmp_path}/w"
    warc.write_warc(df, uri, shard_bytes=1 << 20, file_bytes=200_000 if kind != "alike" else 3_000)
    shards = {}
    for r in spark.read.parquet(f"{uri}/manifest").collect():
        shards.setdefault(r.file.split("-")[1], []).append(r.records)
    assert 24 <= len(shards) <= 60 and max(map(sum, shards.values())) * 2400 < 2.1 * (1 << 20)
    assert sum(len(x) > 1 for x in shards.values()) > 20
    got = warc.read_warc(spark, uri)
    assert got.count() == 20_001
    if kind == "edges":
        assert {r.page_id for r in got.select("page_id").collect()} == {r[0] for r in rows}


def test_sort_keys_sort_as_ids_and_hashes_do():
    edge = [None, -(1 << 63), -256, -1, 0, 1, 255, 256, (1 << 63) - 1]
    pairs = [(i, h) for i in edge for h in edge[1:]]
    keys = warc._sort_keys(warc.pa.array([i for i, _ in pairs], warc.pa.int64()), warc.pa.array([h for _, h in pairs], warc.pa.int64()))
    assert (keys[1:] > keys[:-1]).all()


def test_empty_table(spark, frame, tmp_path):
    warc.write_warc(frame.limit(0), f"file://{tmp_path}/e")
    assert warc.read_warc(spark, f"file://{tmp_path}/e").count() == 0
