import base64
import hashlib
import os

import duckdb
import pytest

from featstab.llm import warc
from featstab.llm.common import shared_dir, table

PAGES = "page_id long, url string, html string"
ROWS = [(1, "http://a.example/ö b\r\n", "<p>same</p>"), (2, None, "<p>same</p>"), (3, "http://c.example/", None), (4, "u", ""), (5, "u", "é" * 100_000), (6, "u", "once"), (6, "u", "once"), (None, "u", "null id"), (None, "v", "null id"), (None, "w", "<p>same</p>"), (7, "u", "x\r\n\r\ny"), (8, "u", "twice one id"), (8, "u", "another")]


def brute(rows):
    payloads = [(p, (h or "").encode()) for p, _, h in rows]
    out, seen = [], set()
    for p, raw in sorted(payloads, key=lambda r: (r[0] is not None, r[0] or 0)):
        group = [q for q, other in payloads if other == raw]
        most = max((q for q in group if q is not None), default=None)
        first = p == most and (p, raw) not in seen
        seen.add((p, raw))
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out.append((p, len(raw), digest, "response" if first else "revisit", None if first else most))
    return sorted(map(str, out))


def found(df):
    return sorted(str(tuple(r)) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())


def files(folder):
    path = folder.removeprefix("file://")
    return {f: open(f"{path}/{f}", "rb").read() for f in sorted(os.listdir(path))}


def test_query_equals_sql_and_brute_force(spark, sf):
    got = found(warc.op7_sharded_warc(spark, sf))
    assert got == brute([(r.page_id, r.url, r.html) for r in table(spark, sf, "pages").collect()])
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{sf}/pages.parquet')")
        assert got == sorted(map(str, con.execute(warc.OP7_SQL).fetchall()))


@pytest.mark.parametrize("layout", [warc.Layout(), warc.Layout(roll=300, shard=2000, small=500)])
def test_awkward_rows_round_trip(spark, layout):
    df = spark.createDataFrame([(*r, 1, 2) for r in ROWS], PAGES + ", shard int, digest int")
    folder = shared_dir(spark, "test")
    manifest = warc.write(df, folder, layout)
    back = warc.read(spark, folder)
    assert found(back) == brute(ROWS)
    texts = {r.payload_digest: bytes(r.payload) for r in back.where("record_type = 'response'").collect()}
    assert texts == {base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(): (h or "").encode() for _, _, h in ROWS}
    assert sorted(files(folder)) == sorted([*(f["name"] for f in manifest["files"]), "manifest.json"])
    assert all(hashlib.sha256(files(folder)[f["name"]]).hexdigest() == f["sha256"] for f in manifest["files"])


def test_files_do_not_depend_on_partitions_or_order(spark):
    rows = [(i, f"http://h{i % 7}.example/{i}", f"<p>{i % 50}</p>" * (1 + i % 9)) for i in range(300)]
    layout, out = warc.Layout(roll=2000, shard=1500, small=500), []
    for order, n in ((rows, 1), (rows[::-1], 5)):
        folder = shared_dir(spark, "test")
        warc.write(spark.createDataFrame(order, PAGES).repartition(n), folder, layout)
        out.append({k: v for k, v in files(folder).items() if k != "manifest.json"})
    assert out[0] == out[1] and len(out[0]) > 4


def test_least_bytes_and_empty_table(spark):
    folder = shared_dir(spark, "test")
    warc.write(spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], PAGES), folder, warc.Layout(least=3))
    assert {r.page_id: r.refers_to for r in warc.read(spark, folder).collect()} == {1: None, 2: None, 3: 4, 4: None}
    folder = shared_dir(spark, "test")
    assert warc.write(spark.createDataFrame([], PAGES), folder)["files"] == [] and warc.read(spark, folder).count() == 0


def test_broken_archives_are_noticed(spark):
    folder = shared_dir(spark, "test")
    name = warc.write(spark.createDataFrame(ROWS, PAGES), folder)["files"][0]["name"]
    path = folder.removeprefix("file://") + "/" + name
    raw = open(path, "rb").read()
    open(path, "wb").write(raw[: len(raw) // 2])
    with pytest.raises(Exception, match="ends within|has .* records"):
        warc.read(spark, folder).collect()


def test_many_shards_of_even_size(spark, monkeypatch):
    rows = [(None if i % 50 == 0 else 7 if i % 3 == 0 else i, "u", f"{i}-" * (1 + i % 5)) for i in range(1500)]  # a hot id, and null ids
    layout = warc.Layout(shard=1, small=1)
    folder = shared_dir(spark, "test")
    manifest = warc.write(spark.createDataFrame(rows, PAGES).repartition(7), folder, layout)
    assert len(manifest["files"]) == 1500 and all(f["records"] == 1 for f in manifest["files"])  # a shard a record
    assert found(warc.read(spark, folder)) == brute(rows)
    shown = {}
    for most, literal in ((0, 0), (1 << 20, 0), (0, 1 << 20)):  # looked up by a join, a broadcast, and in the plan
        monkeypatch.setattr(warc, "MOST", most)
        monkeypatch.setattr(warc, "LITERAL", literal)
        folder = shared_dir(spark, "test")
        warc.write(spark.createDataFrame(rows[:600], PAGES), folder, warc.Layout(shard=100, small=100, shards=10_000))
        shown[most, literal] = {k: v for k, v in files(folder).items() if k != "manifest.json"}
    first, *rest = shown.values()
    assert len(first) > 40 and all(first == other for other in rest)


def test_bounds_are_by_bytes(spark):
    ids = spark.createDataFrame([(i, "d", 1000 if i < 10 else 1) for i in range(2000)], "page_id long, digest string, n int")
    got = warc.with_shard(ids, warc.bounds_of(ids, 2000)).groupBy("shard").sum("n").orderBy("shard").collect()
    assert [r["sum(n)"] for r in got] == [2000] * 5 + [1990]
