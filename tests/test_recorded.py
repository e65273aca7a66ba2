"""Recorded responses, keyed hashes, and links by year."""

import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from jobloom.functions.hashing import client_hash, hmac_sha256
from jobloom.sources import recorded, store


def load(spark, path, **options):
    recorded.register(spark)
    return spark.read.format("recorded").options(**options).load(str(path))


def test_guards(spark, tmp_path):
    ok = {"source_id": 1, "url": "https://x.org/a", "status": 200, "content_type": "text/html", "body": "é" * 10}
    lines = [
        ok, {**ok, "status": 404}, {**ok, "final_url": "https://www.evil.org/a"}, {**ok, "final_url": "/b"}, {**ok, "final_url": "https://X.org/c", "content_type": None}, {**ok, "body": "é" * 30},
        {**ok, "body": None, "last_modified": "Tue, 03 Mar 2026 10:00:00 GMT"}, {**ok, "last_modified": "soon"}, {"url": None}, [], "text", {**ok, "content_type": "application/ld+JSON"},
    ]
    (tmp_path / "a").mkdir()
    (tmp_path / "a/one.json").write_text("\n".join(json.dumps(x) for x in lines) + "\n\n{broken\n")
    (tmp_path / "_ignored").write_text("x")
    (tmp_path / "empty").write_text("")
    rows = load(spark, tmp_path, largest=40).collect()
    got = [(r.error, r.payload, str(r.last_modified), r.redirect) for r in rows]
    assert sorted(got, key=repr) == sorted([
        (None, "é" * 10, "None", None), ("HTTP 404", None, "None", None), ("redirected to another host", None, "None", "https://www.evil.org/a"), (None, "é" * 10, "None", "https://x.org/b"),
        ("unusable content", None, "None", "https://X.org/c"), ("larger than 40 bytes", None, "None", None), (None, "", "2026-03-03", None), (None, "é" * 10, "None", None), ("HTTP 0", None, "None", None),
        ("no record", None, "None", None), ("no record", None, "None", None), (None, "é" * 10, "None", None), ("no record", None, "None", None),
    ], key=repr)


def test_files_are_partitions_and_batches_are_cut(spark, tmp_path):
    for k in range(5):
        (tmp_path / f"{k}.json").write_text("\n".join(json.dumps({"source_id": k, "url": "https://x.org", "status": 200, "content_type": "text", "body": "x" * 3000}) for _ in range(700)))
    df = load(spark, tmp_path, batchbytes=100_000)
    assert df.rdd.getNumPartitions() == 5 and df.count() == 3500 and df.groupBy("source_id").count().where("count != 700").count() == 0
    (tmp_path / "none").mkdir()
    assert load(spark, tmp_path / "none").collect() == []


@pytest.mark.parametrize("key", [b"", b"key", b"\x0b" * 20, bytes(range(64)), b"\xaa" * 131])
def test_hmac(spark, key):
    texts = ["", "Hi There", "what do ya want for nothing?", "é😀" * 100]
    got = [r.h for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(9, None)], "k int, t string").orderBy("k").select(hmac_sha256(key, F.col("t")).alias("h")).collect()]
    assert got == [hmac.new(key, t.encode(), hashlib.sha256).hexdigest() for t in texts] + [None]


def test_client_hashes_of_uses_differ(spark):
    r = spark.createDataFrame([("1.2.3.4", None)], "a string, b string").select(client_hash(b"s", "report", F.col("a")).alias("a"), client_hash(b"s", "view", F.col("a")).alias("v"), client_hash(b"s", "report", F.col("b")).alias("n")).first()
    assert len({r.a, r.v, r.n}) == 3 and None not in (r.a, r.v, r.n)


def test_links_of_a_year_open_no_other(spark, tmp_path):
    rows = [(k, f"https://x.org/{y}/{k % 12 + 1}/job") for k, y in enumerate([2024, 2025, 2026] * 4)] + [(50, "https://x.org/job"), (51, "https://x.org/2025/job"), (52, None)]
    store.write_links(spark.createDataFrame(rows, "id int, url string"), str(tmp_path / "links"))
    df = store.links_of(spark, str(tmp_path / "links"), 2026)
    assert sorted(r.id for r in df.collect()) == [2, 5, 8, 11, 50, 51, 52]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [((year" in plan and "= 2026" in plan
    opened = {f for f in df.select(F.input_file_name().alias("f")).distinct().toPandas()["f"]}
    assert all("year=2026" in f or "year=__HIVE" in f for f in opened)
