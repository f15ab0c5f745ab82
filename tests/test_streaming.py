from datetime import datetime, timedelta

from pyspark.sql import functions as F

from newsloom.operators.incremental import first_per_key
from newsloom.streaming import dedupe

START = datetime(2024, 1, 1)
SCHEMA = "article_hash string, n int, ts timestamp_ntz"


def files(spark, path):
    """Three arrivals files; key 'a' returns after 60 hours."""
    batches = [
        [("a", 0, 0), ("b", 1, 1), ("a", 2, 2)],
        [("c", 3, 30), ("b", 4, 31)],
        [("a", 5, 60), ("d", 6, 61), ("d", 7, 61)],
    ]
    for i, rows in enumerate(batches):
        data = [(k, n, START + timedelta(hours=h)) for k, n, h in rows]
        spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/f{i}")
    return [r for batch in batches for r in batch]


def test_stream_load_equals_batch(spark, tmp_path):
    src, table = str(tmp_path / "in"), str(tmp_path / "table")
    files(spark, src)
    for _ in range(2):  # a second run finds nothing new
        stream = dedupe.read_arrivals(spark, f"{src}/*", spark.createDataFrame([], SCHEMA).schema, 1)
        dedupe.load_new(stream, table, str(tmp_path / "log"), ["n"]).awaitTermination()
    batch = first_per_key(spark.read.parquet(f"{src}/*"), "article_hash", ["n"])
    got = spark.read.parquet(table)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))
    # the same files under a new log: the table itself rejects them
    stream = dedupe.read_arrivals(spark, f"{src}/*", got.schema)
    dedupe.load_new(stream, table, str(tmp_path / "log2"), ["n"]).awaitTermination()
    assert spark.read.parquet(table).count() == 4


def test_watermark_drops_repeats_inside_the_window(spark, tmp_path):
    src, table = str(tmp_path / "in"), str(tmp_path / "out")
    files(spark, src)
    stream = dedupe.read_arrivals(spark, f"{src}/*", spark.createDataFrame([], SCHEMA).schema)
    rows = dedupe.drop_seen(stream, "ts").select("article_hash")
    dedupe.append_stream(rows, table, str(tmp_path / "log")).awaitTermination()
    got = sorted(r.article_hash for r in spark.read.parquet(table).collect())
    assert sorted(set(got)) == ["a", "b", "c", "d"]
    assert spark.read.parquet(table).groupBy("article_hash").agg(F.count("*").alias("n")).filter(
        "n > 1 and article_hash <> 'a'"
    ).isEmpty()


def test_keys_return_after_the_window(spark, tmp_path):
    src, table, log = (str(tmp_path / x) for x in ("in", "out", "log"))
    batches = files(spark, src)
    schema = spark.createDataFrame([], SCHEMA).schema
    jobs = dedupe.with_state_store(spark)

    def run():
        stream = dedupe.read_arrivals(jobs, f"{src}/*", schema)
        passed = dedupe.after_absence(stream, "ts", ["n"])
        dedupe.append_stream(passed, table, log).awaitTermination()
        return sorted((r.article_hash, r.n) for r in spark.read.schema(schema).parquet(table).collect())

    # All in one delivery: 'a' is back after 58 hours, 'b' after 30, and of equal moments one passes.
    first = run()
    assert len(batches) == 8 and first == [("a", 0), ("a", 5), ("b", 1), ("c", 3), ("d", 6)]
    assert run() == first  # a restart without new files changes nothing
    later = [("b", 8, START + timedelta(hours=31 + 48)), ("a", 9, START + timedelta(hours=107)), ("a", 10, START + timedelta(hours=155)), ("x", 11, None)]
    spark.createDataFrame(later, SCHEMA).coalesce(1).write.parquet(f"{src}/f3")
    assert run() == sorted([*first, ("b", 8), ("a", 10)])  # 47 hours are too few, 48 are enough
    spark.createDataFrame([("e", 12, START + timedelta(hours=400))], SCHEMA).coalesce(1).write.parquet(f"{src}/f4")
    run()
    spark.createDataFrame([("f", 13, START + timedelta(hours=401))], SCHEMA).coalesce(1).write.parquet(f"{src}/f5")
    assert ("f", 13) in run()
    # Timers have cleared the keys that stayed away.
    held = jobs.read.format("statestore").option("stateVarName", "seen").load(log)
    assert sorted(r.key[0] for r in held.collect()) == ["e", "f"]
