import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from logquarry.sources import chunkfile as c
from logquarry.sources.bytetail import TailReader

ENTRIES = [(1_700_000_000_000_000_000, b"/var/log/app.log", [("env", "prod"), ("host", "web-01")], b"connection refused"), (-5, b"", [], "É".encode()), (7, b"s", [("a", "x=y")], b"")]


def test_round_trips():
    for compressed in (False, True):
        assert list(c.decode_chunk(c.encode_chunk(ENTRIES, compressed))) == ENTRIES
    # a compressed flag without the finalized one: the payload is still raw
    raw = c.encode_chunk(ENTRIES, True, finalized=False)
    assert list(c.decode_chunk(raw)) == ENTRIES and len(raw) == 32 + sum(16 + len(s) + len(",".join(f"{k}={v}" for k, v in l)) + len(m) for _, s, l, m in ENTRIES)


def test_labels_with_commas_split_as_the_format_does():
    data = c.encode_chunk([(1, b"s", [("a", "x,b=2"), ("k", "p,q")], b"m")])
    assert next(iter(c.decode_chunk(data)))[2] == [("a", "x"), ("b", "2"), ("k", "p")]


def test_broken_files(spark, tmp_path):
    (tmp_path / "2024").mkdir()
    (tmp_path / "2024/a.chunk").write_bytes(c.encode_chunk(ENTRIES, True))
    (tmp_path / "2024/b.chunk").write_bytes(c.encode_chunk(ENTRIES)[:-1])
    (tmp_path / "c.chunk").write_bytes(b"nothing of the kind")
    rows = c.read_chunks(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r.ts_ns, r.message) for r in rows] == [(t, m.decode()) for t, _, _, m in ENTRIES] + [(t, m.decode()) for t, _, _, m in ENTRIES[:2]] + ([(7, "")] if len(rows) == 6 else [])
    assert [(x.key, x.value) for x in rows[0].labels] == [("env", "prod"), ("host", "web-01")]
    with pytest.raises(Exception, match="ChunkError"):
        c.read_chunks(spark, str(tmp_path), ignore_corrupt=False).collect()


def test_journal_stops_at_the_first_broken_frame(spark, tmp_path):
    data = b"".join(c.encode_entry(*e) for e in ENTRIES[:2])
    (tmp_path / "w.log").write_bytes(data + data[:9])
    assert c.read_chunks(spark, str(tmp_path), journal=True).count() == 2


def batch(reader, start):
    end = reader.latestOffset()
    return [row for p in reader.partitions(start, end) for row in reader.read(p)], end


def test_tail_reader(tmp_path):
    path = tmp_path / "a.log"
    path.write_bytes(b"old\nhal")
    r = TailReader({"paths": f"{tmp_path}/*.log", "positions": str(tmp_path / "p.json")})
    at = r.initialOffset()
    assert at == {str(path): 4}
    path.write_bytes(b"old\nnew\r\n\nhalf")
    rows, end = batch(r, at)
    assert rows == [(str(path), "new", 4)] and end == {str(path): 10}
    r.commit(end)
    assert TailReader({"paths": str(path), "positions": str(tmp_path / "p.json")}).initialOffset() == end
    path.write_bytes(b"cut\n")
    assert [x for p in r.partitions(at, end) for x in r.read(p)] == []  # a replay finds the bytes gone
    rows, after = batch(r, end)
    assert rows == [(str(path), "cut", 0)] and after == {str(path): 4}
    (tmp_path / "b.log").write_bytes(b"second file\n")
    assert [x[1] for x in batch(r, after)[0]] == ["second file"]
    assert batch(r, batch(r, after)[1])[0] == []
    assert TailReader({"paths": "/missing", "startingOffset": "earliest"}).initialOffset() == {"/missing": 0}


@given(st.lists(st.binary(max_size=9).map(lambda b: b.replace(b"\n", b"")), max_size=30), st.integers(1, 12))
@settings(max_examples=200, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_ranges_share_out_the_lines(tmp_path, texts, size):
    path = tmp_path / "x.log"
    path.write_bytes(b"".join(t + b"\n" for t in texts) + b"open")
    r = TailReader({"paths": str(path), "startingOffset": "earliest", "rangeBytes": str(size)})
    rows, _ = batch(r, r.initialOffset())
    assert [x[1] for x in rows] == [t.removesuffix(b"\r").decode("utf-8", "replace") for t in texts if t.removesuffix(b"\r")]


def test_a_file_that_is_away_for_a_while_goes_on_where_it_was(tmp_path):
    path, other = tmp_path / "a.log", tmp_path / "b.log"
    path.write_bytes(b"one\ntwo\n")
    options = {"paths": str(path), "startingOffset": "earliest", "positions": str(tmp_path / "p.json")}
    for restart in (False, True):
        r = TailReader(options)
        rows, at = batch(r, {str(path): 4})
        path.rename(other)
        r = TailReader(options) if restart else r
        rows, gone = batch(r, at)
        assert rows == []
        other.rename(path)
        with path.open("ab") as f:
            f.write(b"three\n")
        assert [x[1] for x in batch(r, gone)[0]] == ["three"]
        path.write_bytes(b"one\ntwo\n")
    (tmp_path / "p.json").write_text("{no json")
    assert TailReader(options).initialOffset() == {str(path): 0}


def test_chunk_files_are_numbered_in_name_order(spark, tmp_path):
    for i in range(40):
        (tmp_path / f"{i:02d}.chunk").write_bytes(c.encode_chunk(ENTRIES[:2]))
    rows = c.read_chunks(spark, str(tmp_path)).orderBy("seq").collect()
    assert len({r.seq for r in rows}) == 80 and all(0 <= r.seq < 1 << 62 for r in rows)
    assert [r.ts_ns for r in rows] == [e[0] for e in ENTRIES[:2]] * 40


def test_a_backlog_comes_in_bounded_batches_of_whole_lines(tmp_path):
    path = tmp_path / "a.log"
    texts = [f"line {i} " + "x" * (i % 13) for i in range(200)] + ["y" * 500, "end"]
    path.write_text("\n".join(texts) + "\n")
    r = TailReader({"paths": str(path), "startingOffset": "earliest", "maxBytesPerBatch": "100"})
    at, got, sizes = r.initialOffset(), [], []
    while True:
        rows, end = batch(r, at)
        if end == at:
            break
        got += [x[1] for x in rows]
        sizes.append(end[str(path)] - at[str(path)])
        at = end
    assert got == texts and sorted(sizes)[-2] <= 100 and max(sizes) == 501


def test_workers_hold_little_at_once(spark, tmp_path, monkeypatch):
    """However many files a task has, and entries a file."""
    noted, plain = tmp_path / "noted", type(spark.range(0)).mapInArrow

    def spied(df, run, schema):
        def note(batches, way):
            for b in batches:
                with open(noted, "a") as f:
                    f.write(f"{way} {b.num_rows} {b.nbytes}\n")
                yield b

        return plain(df, lambda batches: note(run(note(batches, "in")), "out"), schema)

    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", spied)
    for journal in (True, False):
        noted.write_text("")
        entries = [(i, b"s%d" % i, [("k", str(i))] * (i % 3), b"%d" % i * 300) for i in range(8000)]
        data = b"".join(c.encode_entry(*e) for e in entries) if journal else c.encode_chunk(entries, True)
        files = spark.createDataFrame([(f"f{i}", data) for i in range(3)] + [("none", b"")], "path string, content binary").coalesce(1)
        rows = c.decoded(files, journal=journal).toPandas()
        assert [(p, t, s, m.encode()) for p, t, s, m in zip(rows.path, rows.ts_ns, rows.source, rows.message)] == [(f"f{i}", t, s.decode(), m) for i in range(3) for t, s, _, m in entries]
        assert list(rows["at"]) == list(range(8000)) * 3 and [[(x["key"], x["value"]) for x in l] for l in rows.labels] == [l for _, _, l, _ in entries] * 3
        seen = [line.split() for line in noted.read_text().splitlines()]
        assert max(int(n) for way, _, n in seen if way == "in") < 4 << 20 and max(int(n) for way, _, n in seen if way == "out") < 6 << 20


def test_a_chunk_ends_when_it_is_full(spark):
    """Labels of slices of a batch, also empty ones, stay with their entries."""
    df = spark.range(0, 7000, 1, 1).selectExpr("id AS seq", "id AS ts_ns", "concat('s', id) AS source", "repeat(id, 600) AS message", "transform(array_repeat(id, cast(id % 3 AS int)), x -> struct('k' AS key, string(x) AS value)) AS labels")
    files = c.encoded(df, compressed=False).collect()
    found = [e for f in files for e in c.decode_chunk(f.content)]
    assert found == [(i, b"s%d" % i, [("k", str(i))] * (i % 3), b"%d" % i * 600) for i in range(7000)]
    assert len({f.path for f in files}) == len(files) > 1 and max(len(f.content) for f in files) < (10 << 20) + 4096
