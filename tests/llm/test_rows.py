"""Every row gets its own result: repeated rows, null ids and one id with several texts."""

from collections import Counter

from tidemark.llm import decontamination


def test_decontamination_does_not_depend_on_the_number_of_automata(spark):
    long = " ".join(f"w{i}" for i in range(30))
    docs = [(1, "one two"), (1, "one two"), (1, "six ten"), (None, "one two"), (None, "six ten"), (2, None), (2, ""), (3, long), (3, long.upper()), (4, "one two three")]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(1, "one two"), (2, " ".join(f"w{i}" for i in range(5, 17))), (3, "three"), (4, " ".join(f"w{i}" for i in range(15, 27))), (5, None)], "item_id long, text string")
    one, many = ([(r["doc_id"], r["n_words"], *map(tuple, (r["hit_words"], r["items"], r["spans"]))) for r in decontamination.scan(docs, bench, most=m).collect()] for m in (1000, 5))
    assert Counter(one) == Counter(many) and len(many) == 10
    hits = Counter((r[0], len(r[2])) for r in many)
    assert hits == {(1, 2): 2, (1, 0): 1, (None, 2): 1, (None, 0): 1, (2, 0): 2, (3, 22): 2, (4, 3): 1}
    assert all(len(r[4]) == 1 for r in many if r[2])
    left = Counter((r["doc_id"], r["text"]) for r in decontamination.clean(docs, bench, most=5).collect())
    assert left == {(1, "six ten"): 1, (None, "six ten"): 1, (2, None): 1, (2, ""): 1}
