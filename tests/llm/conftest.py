import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

TEXTS = {
    1: None, 2: "", 3: "   \n ", 4: "one two", 5: "One  TWO", 6: "!!! 123 ...",
    7: " ".join(f"w{i}" for i in range(80)), 8: " ".join(f"w{i}" for i in range(80)), 9: " ".join(f"w{i}" for i in range(78)) + " x y",
    10: " ".join(f"w{i % 7}" for i in range(6000)), 11: "é" * 40 + " secret = abcdef123 AKIA" + "A" * 20 + " " + "0a" * 20, 12: "api_key: 'abc' password=hunter22 ghp_" + "Ab1" * 13,
    13: " ".join(f"w{i}" for i in range(30, 110)),
}


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def small(spark, tmp_path_factory):
    """A folder with a few hard rows under extra and clashing column names."""
    d = str(tmp_path_factory.mktemp("small"))
    rows = [(k, t, "en" if k % 3 else None, "src0", len(t or ""), k, 0.5) for k, t in TEXTS.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node long, score double").write.parquet(f"{d}/documents.parquet")
    bench = [(1, " ".join(f"w{i}" for i in range(40, 55))), (2, "one two"), (3, None), (4, "!!!")]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(7, 1, 0), (9, 0, 0), (99, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    vectors(spark, f"{d}/embeddings.parquet")
    return d


def vectors(spark, path):
    """Vectors with hard rows: null, null and non-finite entries, another length, repeated rows, null and repeated ids, a clashing column."""
    import numpy as np

    r = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in r.normal(0, 0.1 * (1 + i % 3), 12)]) for i in range(60)]
    rows += [rows[0], (None, rows[1][1]), (3, rows[4][1]), (70, None), (71, [None, *rows[2][1][1:]]), (72, [float("nan"), *rows[2][1][1:]]), (73, [float("inf"), *rows[2][1][1:]]), (74, [1.0, 2.0]), (75, []), (76, [1e30, *rows[2][1][1:]])]
    spark.createDataFrame([(k, v, 1, 2, 3.0) for k, v in rows], "vec_id long, embedding array<float>, label int, component int, vector double").coalesce(1).write.parquet(path)
    return rows


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory, small):
    d = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "benchmark", "labels", "embeddings"):
        spark.read.parquet(f"{small}/{t}.parquet").limit(0).write.parquet(f"{d}/{t}.parquet")
    return d


@pytest.fixture(scope="session", params=["small", "sf"])
def folder(request, small):
    return small if request.param == "small" else "/root/testdata/sf0.001"
