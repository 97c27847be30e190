"""The pipeline's stages on null ids, repeated rows and ids with several texts: every row is judged by its own text."""

import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline as p  # noqa: E402

A, B, C = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
KEY = "my key is AKIA" + "A" * 16 + " here"
LEAK = "some " + " ".join(f"q{i}" for i in range(12))


@pytest.fixture(scope="module")
def bench(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("bench"))
    spark.createDataFrame([(1, " ".join(f"q{i}" for i in range(12)))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def after(spark, stage, folder, rows):
    docs = spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = stage(spark, docs, folder)
    assert out.columns == docs.columns
    return Counter((r["doc_id"], r["text"], r["n_chars"]) for r in out.collect())


def want(*rows):
    return Counter((d, t, None if t is None else len(t)) for d, t in rows)


def test_language_keeps_null_ids_and_drops_only_the_row_without_letters(spark, bench):
    rows = [(None, A), (None, "123"), (1, B), (1, "!!!"), (1, B), (2, None), (3, A), (4, C)]
    assert after(spark, p.identify_language, bench, rows) == want((None, A), (1, B), (1, B), (3, A), (4, C))


def test_one_row_of_each_group_stays(spark, bench):
    rows = [(None, A), (5, A), (5, A), (6, A + " z"), (5, B), (None, C), (None, C), (7, None), (7, None), (None, "")]
    assert after(spark, p.drop_near_duplicates, bench, rows) == want((5, A), (5, B), (None, C), (7, None), (7, None), (None, ""))


def test_decontamination_judges_each_row(spark, bench):
    rows = [(None, A), (None, LEAK), (1, B), (1, LEAK), (1, B), (2, None)]
    assert after(spark, p.decontaminate, bench, rows) == want((None, A), (1, B), (1, B), (2, None))


def test_redaction_keeps_each_row_its_own_text(spark, bench):
    got = after(spark, p.redact_secrets, bench, [(None, A), (None, KEY), (1, B), (1, KEY), (2, None)])
    clean = {(d, t): n for (d, t, _), n in got.items() if t is None or "[" not in t}
    assert clean == {(None, A): 1, (1, B): 1, (2, None): 1}
    hidden = [(d, t, n) for d, t, n in got if t and "[" in t]
    assert {d for d, _, _ in hidden} == {None, 1} and all("AKIA" not in t and n == len(t) for _, t, n in hidden)


CLASH = "repeated chosen_id chosen_row row n words label least _i _r _n __i __r __n lang_pred score spans redacted hit_words items n_words contaminated".split()


@pytest.mark.parametrize("stage", [s for n, s in p.STAGES if n != "packing"])
def test_columns_named_like_helpers_are_kept(spark, bench, stage):
    rows = [(None, A), (5, A), (5, A), (6, B), (7, LEAK + " and on it goes"), (8, KEY), (9, C)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t), *[str(d)] * len(CLASH)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH))
    out = stage(spark, docs, bench)
    assert out.columns == docs.columns
    got = out.collect()
    assert {r["doc_id"] for r in got} >= {6, 8, 9} and all(r[c] == str(r["doc_id"]) for r in got for c in CLASH)


@pytest.mark.parametrize("stage", [s for _, s in p.STAGES])
def test_empty_tables_stay_empty(spark, bench, stage):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert stage(spark, docs, bench).count() == 0
