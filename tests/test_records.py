"""CSV with quoted line feeds in splits of any size, and the encoder hook."""

import csv
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventlens.operators import vectors as V
from eventlens.sources import records as R

SCHEMA = "id INT, m STRING, t STRING"


@pytest.fixture
def small_splits(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")

    def use(size):
        for k, v in zip(keys, (size, "1")):
            spark.conf.set(k, v)

    yield use
    for k in keys:
        spark.conf.unset(k)


def write(path, rows, end):
    with open(path, "w", newline="") as f:
        w = csv.writer(f, lineterminator=end)
        w.writerow(["id", "m", "t"])
        w.writerows(rows)


@pytest.mark.parametrize("size", ["64k", "3k", "700"])
def test_one_file_of_many_splits_gives_the_same_rows(spark, small_splits, tmp_path, size):
    rng = random.Random(1)
    texts = ["plain", 'with "quotes" here', "two\nlines", 'a,b\n"x"\n\nend', "", "é x", '"', '""\n', "\n"]
    rows = [(i, rng.choice(texts + ["long " + "word\n" * rng.randrange(300)]), rng.choice(["x", "y z", ""])) for i in range(500)]
    write(tmp_path / "a.csv", rows[:400], "\n")
    write(tmp_path / "b.csv", rows[400:], "\r\n")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "header.csv").write_text("id,m,t\n")
    small_splits(size)
    df = R.read_quoted_csv(spark, str(tmp_path), SCHEMA)
    got = sorted(map(tuple, df.collect()), key=repr)
    assert got == sorted([(i, m or None, t or None) for i, m, t in rows], key=repr)
    assert size == "64k" or R._lines(spark, str(tmp_path)).select(F.spark_partition_id()).distinct().count() > 10


def test_a_record_over_many_splits_and_no_last_line_feed(spark, small_splits, tmp_path):
    text = "line of text\n" * 2000
    (tmp_path / "a.csv").write_text(f'id,m,t\n1,"{text}",x\n2,b,"y\nz"')
    small_splits("900")
    got = sorted(map(tuple, R.read_quoted_csv(spark, str(tmp_path), SCHEMA).collect()))
    assert got == [(1, text, "x"), (2, "b", "y\nz")]
    assert sorted(map(tuple, R.read_quoted_csv(spark, str(tmp_path), SCHEMA, header=False).collect()), key=repr)[-1] == (None, "m", "t")


def test_a_model_is_loaded_once_and_sees_bounded_batches(spark, tmp_path):
    log = str(tmp_path / "log")

    def load():
        with open(log, "a") as f:
            f.write("load\n")

        def encode(texts):
            with open(log, "a") as f:
                f.write(f"{len(texts)}\n")
            return np.array([[len(t), 1.0, 0.0] if t else [0.0, 0.0, 0.0] for t in texts])

        return encode

    df = spark.createDataFrame([(i, "x" * (i % 4)) for i in range(1000)] + [(1000, None)], "id int, m string").coalesce(1)
    out = V.vectorise(df, "m", encoder=V.model_encoder("test-lengths", load, rows=64)).collect()
    lines = open(log).read().split()
    assert lines.count("load") == 1 and max(int(x) for x in lines if x != "load") == 64
    for r in out:
        n = r.id % 4 if r.m is not None else 0
        want = np.array([n, 1, 0]) / np.hypot(n, 1) if n else np.zeros(3)
        assert np.allclose(r.vector, want, atol=1e-6)
