"""Every query on one table of hard rows: repeated and null ids, ids above 2**53, a long text, ties, and columns named like internal ones."""

from collections import Counter

import pytest

from tidemark.llm import queries

BIG = 2**53
EXTRA = "node label cell key part h row n name segment salt at stretch lent bucket rank place block lang_pred redacted spans score x hit_words items".split()


@pytest.fixture(scope="module")
def hard(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("hard"))
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    long = " ".join(f"w{i * i % 7919}" for i in range(200_000))
    rows = [(BIG + 1, a), (BIG + 3, b), (None, a), (None, None), (5, a), (5, a), (5, b), (6, long), (7, ""), (8, "one two"), (8, "one two"), (9, "!!! 12")]
    extra = ", ".join(f"{c} string" for c in EXTRA)
    frame = spark.createDataFrame([(d_, t, "en", "s", None if t is None else len(t), *["?"] * len(EXTRA)) for d_, t in rows], f"doc_id long, text string, lang string, source string, n_chars long, {extra}")
    frame.coalesce(1).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, "one two"), (1, "one two"), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(5, 1, 0), (5, 0, 0), (8, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, Counter(d_ for d_, _ in rows)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - {"op11_whitening"}))  # which reads no documents
def test_every_row_keeps_its_id(spark, hard, name):
    folder, want = hard
    got = queries.QUERIES[name](spark, folder)
    if name == "op1_packing":
        got = got.filter("piece = 0")
    assert Counter(r["doc_id"] for r in got.collect()) == want
