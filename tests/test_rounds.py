"""Frozen sets, and rounds of extraction."""

import glob
import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import extraction
from quillspark.sources import frozen


def test_two_freezes_have_one_manifest(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i if i % 9 else None, rng.choice(["é\n", "b", None, 'quo"te']), rng.random()) for i in range(300)] + [(5, "b", 0.5)] * 3
    schema = "k long, t string, v double"
    one = spark.createDataFrame(rows, schema).repartition(3)
    rng.shuffle(rows)
    other = spark.createDataFrame(rows, schema).select("v", "k", "t").repartition(7)
    a = frozen.freeze(one, str(tmp_path / "a"), ["k"], 5).collect()
    b = frozen.freeze(other, str(tmp_path / "b"), ["k"], 5).collect()
    assert a == b and sum(r["rows"] for r in a) == len(rows)
    text = lambda p: {int(f.split("part=")[1].split("/")[0]): open(f, "rb").read() for f in glob.glob(f"{tmp_path}/{p}/data/part=*/*.txt")}
    assert text("a") == text("b")
    assert frozen.problems(spark, str(tmp_path / "a")).count() == 0
    assert sorted(map(str, frozen.thawed(spark, str(tmp_path / "a"), schema).collect())) == sorted(map(str, one.collect()))
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        frozen.freeze(one, str(tmp_path / "a"), ["k"], 5)
    assert frozen.freeze(one.limit(0), str(tmp_path / "c"), ["k"], 5).count() == 0


def test_a_changed_byte_is_named(spark, tmp_path):
    frozen.freeze(spark.range(100).withColumn("t", F.lit("text")), str(tmp_path / "a"), ["id"], 4)

    def edit(part, change):
        (name,) = glob.glob(f"{tmp_path}/a/data/part={part}/*.txt")
        data = open(name, "rb").read()
        open(name, "wb").write(change(data))
        crc = name.rpartition("/")[0] + "/." + name.rpartition("/")[2] + ".crc"
        for c in glob.glob(crc):  # the file system's own sum would stop the reader first
            __import__("os").remove(c)

    edit(2, lambda d: d.replace(b"text", b"tezt", 1))
    edit(0, lambda d: d + d.splitlines(keepends=True)[0])
    assert sorted(map(tuple, frozen.problems(spark, str(tmp_path / "a")).collect())) == [(0, "ROWS"), (2, "CONTENT")]
    with pytest.raises(ValueError, match="part 0 ROWS, part 2 CONTENT"):
        frozen.thawed(spark, str(tmp_path / "a"), "id long, t string")


def test_rounds_pass_feedback_on_and_end(spark):
    seen = []

    def ask(asked):
        seen.append(sorted((r.chunk_id, r.attempt, r.feedback) for r in asked.collect()))
        ok = (F.col("chunk_id") == 1) | ((F.col("chunk_id") == 2) & (F.col("feedback") == "BAD"))
        return asked.where("chunk_id <> 9").select("chunk_id", F.lit("{}").alias("output"), F.lit(True).alias("finished"), F.when(ok, F.array(F.lit("good"))).otherwise(F.array(F.lit("bad"))).alias("facts"))

    extraction.register_extractor("by_feedback", ask)
    with pytest.raises(ValueError):
        extraction.register_extractor("by_feedback", ask)
    work = spark.createDataFrame([(1, "a", 1), (2, None, 1), (3, "c", 1), (9, "d", 1)], "chunk_id long, content string, epoch int")
    out = extraction.extract(work, "by_feedback", F.when(F.array_contains("facts", "bad"), "BAD"), F.array().cast("array<string>"), work.select("chunk_id", "epoch").where("chunk_id <> 1"))
    got = {r.chunk_id: (r.outcome, r.attempts, r.code, r.facts) for r in out.collect()}
    assert got == {1: ("FENCED", 1, None, None), 2: ("DONE", 2, None, ["good"]), 3: ("FAILED", 3, "BAD", None), 9: ("FAILED", 3, "OUTPUT_EMPTY", None)}
    assert [len(s) for s in seen] == [4, 3, 2] and seen[1] == [(2, 2, "BAD"), (3, 2, "BAD"), (9, 2, "OUTPUT_EMPTY")]
    assert extraction.extract(work.limit(0), "by_feedback", F.lit(None).cast("string"), F.array().cast("array<string>")).count() == 0
