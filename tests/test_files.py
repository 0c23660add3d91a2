import gzip
import json
import random

from pyspark.sql import functions as F

from bridgewell.sources import files as S
from bridgewell.sources.heads import file_heads, reachable
from bridgewell.streaming.append import append_batch, append_stream, new_rows, touched


def lines(path, *rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) for r in rows))
    return str(path)


def test_json_reading(spark, tmp_path):
    p = lines(tmp_path / "a.jsonl", {"a": 1, "b": "x"}, {"a": 2, "b": "y"}, '{"a": broken')
    assert S.read_json(spark, p, "a int, b string", drop_malformed=True).collect().__len__() == 2
    assert S.malformed_count(spark, p, "a int, b string") == 1
    good = lines(tmp_path / "b.jsonl", {"a": 1})
    assert S.read_json(spark, [good]).dtypes == [("a", "bigint")]
    assert S.read_json(spark, good, sampling=0.9).count() == 1
    with gzip.open(tmp_path / "c.jsonl.gz", "wt") as f:
        f.write('{"a": 7}\n')
    assert S.read_json(spark, str(tmp_path / "*.jsonl.gz"), "a int").first().a == 7


def test_csv_and_counts(spark, tmp_path):
    df = spark.createDataFrame([("é", 1), ("b", 2)], "k string, n int")
    S.write_csv(df, f"{tmp_path}/csv")
    assert S.read_csv(spark, f"{tmp_path}/csv", "k string, n int").count() == 2
    S.write_json(df, f"{tmp_path}/json")
    assert "é" in "".join(p.read_text() for p in (tmp_path / "json").glob("*.json"))
    assert S.write_and_count(df, f"{tmp_path}/pq", 1) == 2
    S.write_parquet(df, f"{tmp_path}/pq", 2, shuffle=True)
    assert len(list((tmp_path / "pq").glob("*.parquet"))) == 2
    assert S.read_parquet(spark, f"{tmp_path}/pq", "n").columns == ["n"]
    with S.kept(df) as k:
        assert k.is_cached
    assert not df.is_cached


def test_kinds(spark, tmp_path):
    heads = {"vn_review": {"rating": 1, "fullName": "x"}, "amz_review": {"rating": 1}, "vn_item": {"average_rating": 1, "specifications": []}, "amz_item": {"average_rating": 1, "features": []}, "unknown": {"z": 1}}
    for k, v in heads.items():
        lines(tmp_path / f"{k}.jsonl", v, v)
    got = {r.path.rsplit("/", 1)[1][:-6]: r.kind for r in S.classify(spark, str(tmp_path)).collect()}
    assert got == {k: k for k in heads}
    assert {r.kind: r.n_files for r in S.inventory(spark, str(tmp_path)).collect()} == {k: 1 for k in heads}
    (tmp_path / "more").mkdir()
    (tmp_path / "more" / "empty.jsonl").write_text("")
    lines(tmp_path / "more" / "second.jsonl", {"z": 1}, {"rating": 1})  # the keys stand in the second line
    lines(tmp_path / "more" / "late.jsonl", *[{"z": "x" * 500}] * 5, {"rating": 1})  # beyond the first 2,048 characters
    got = {r.path.rsplit("/", 1)[1][:-6]: r.kind for r in S.classify(spark, str(tmp_path / "more")).collect()}
    assert got == {"empty": "unknown", "second": "amz_review", "late": "unknown"}


def test_profile(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/meta_x")
    got = {r.name: r for r in S.profile(spark, {"x": f"{tmp_path}/meta_x", "y": f"{tmp_path}/none"}).collect()}
    assert got["x"].n_rows == 3 and got["x"].is_meta and got["y"].error


def test_append_new_keys(spark, tmp_path):
    path = f"{tmp_path}/t"
    b = spark.createDataFrame([("a", 2), ("a", 1), ("", 3), (None, 4)], "k string, n int")
    assert [tuple(r) for r in new_rows(b, None, "k").collect()] == [("a", 1)]
    append_batch(spark, b, path, "k")
    append_batch(spark, spark.createDataFrame([("a", 9), ("b", 5)], "k string, n int"), path, "k")
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("k", "n").collect()) == [("a", 1), ("b", 5)]


def test_append_reads_touched_buckets_and_takes_batches_again(spark, tmp_path):
    path = f"{tmp_path}/t"
    frame = lambda ks: spark.createDataFrame([(f"k{k}", k) for k in ks], "k string, n int")
    append_batch(spark, frame(range(200)), path, "k", 32)
    small = frame([3, 500, 501])
    files = lambda d: {r[0] for r in d.select(F.input_file_name()).distinct().collect()}
    read, every = files(touched(spark, small, path, "k", 32)), files(spark.read.parquet(path))
    assert len(every) >= 30 and 1 <= len(read) <= 3
    for _ in range(2):  # the second time as a batch that is tried again
        append_batch(spark, small, path, "k", 32)
    append_batch(spark, small.limit(0), path, "k", 32)
    got = sorted(r.n for r in spark.read.parquet(path).collect())
    assert got == [*range(200), 500, 501]
    flat = f"{tmp_path}/flat"
    frame([1, 2]).write.parquet(flat)  # a table without buckets
    append_batch(spark, frame([2, 3]), flat, "k")
    assert sorted(r.n for r in spark.read.parquet(flat).collect()) == [1, 2, 3] and "_bucket" not in spark.read.parquet(flat).columns


def test_heads_read_few_bytes(spark, tmp_path):
    text = json.dumps({"rating": 1, "fullName": "é" * 500_000})
    (tmp_path / "a.json").write_text(text, encoding="utf-8")
    rng = random.Random(1)
    long = json.dumps({"features": [], "z": "".join(rng.choice("abcdefghij") for _ in range(400_000))})
    with gzip.open(tmp_path / "b.json.gz", "wt") as f:
        f.write(long)
    (tmp_path / "c.json").write_bytes(b"")
    (tmp_path / "d.json").write_bytes(b"\xff\xfe{")
    got = {r.path.rsplit("/", 1)[1]: r for r in file_heads(spark, [f"file://{tmp_path}/{n}" for n in ("a.json", "b.json.gz", "c.json", "d.json")], 2048).collect()}
    assert got["a.json"].head == text[:2048] and got["b.json.gz"].head == long[:2048]
    assert all(r.read <= 4 * 2048 for r in got.values()) and (got["c.json"].head, got["c.json"].read) == ("", 0) and got["d.json"].head.endswith("{")
    kinds = {r.path.rsplit("/", 1)[1]: r.kind for r in S.classify(spark, str(tmp_path)).collect()}
    assert kinds == {"a.json": "vn_review", "b.json.gz": "amz_item", "c.json": "unknown", "d.json": "unknown"}
    assert not reachable("viewfs://store/in/x") and reachable("/tmp/x") and reachable("hdfs://n/x")


def test_append_stream(spark, tmp_path):
    src, path = tmp_path / "src", f"{tmp_path}/t"
    src.mkdir()
    for i in range(2):
        lines(src / f"{i}.jsonl", {"k": "a", "n": i}, {"k": f"b{i}", "n": i})
        stream = spark.readStream.schema("k string, n int").json(str(src))
        append_stream(stream, path, "k", f"{tmp_path}/cp").awaitTermination(60)
    assert sorted(r.k for r in spark.read.parquet(path).collect()) == ["a", "b0", "b1"]
    assert spark.read.parquet(path).where(F.col("k") == "a").count() == 1


def test_write_and_report_takes_one_job(spark, tmp_path):
    df = spark.range(100).select(F.col("id"), F.lit("abc").alias("t"))
    spark.sparkContext.setJobGroup("report", "one write")
    got = S.write_and_report(df, str(tmp_path / "o"))
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("report")
    spark.sparkContext.setJobGroup("", "")
    assert got["rows"] == 100 == spark.read.parquet(str(tmp_path / "o")).count() and len(jobs) == 1
    assert got["bytes"] == sum(len(f'{{"id":{i},"t":"abc"}}') for i in range(100)) and got["estimated_bytes"] > 0
    assert S.write_and_report(df.limit(0), str(tmp_path / "e"))["rows"] == 0
