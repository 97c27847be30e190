"""The pipeline against its operators applied one after another to plain rows."""

import sys
import zlib
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline as p  # noqa: E402

from tests_brute import brute_components, brute_set  # noqa: E402


def test_stages_and_result(spark, small):
    from tokenizers import Tokenizer

    from tidemark.llm import decontamination, packing, secrets

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    docs = {d: t for d, t in docs.items() if t and any(c.isalpha() for c in t)}
    least = brute_components({d: brute_set(t) for d, t in docs.items()})
    docs = {d: t for d, t in docs.items() if least[d] == d}
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    windows = decontamination.patterns(bench)
    docs = {d: t for d, t in docs.items() if not any(w in f" {b' '.join(decontamination.normalised(t)).decode()} " for w in windows)}
    docs = {d: secrets.redact(t, secrets.Scanner().scan([t])[0]) for d, t in docs.items()}
    model, want = Tokenizer.from_file(packing.vocabulary()), {}
    for d, t in docs.items():
        ids = np.array([*model.encode(t, add_special_tokens=False).ids, 0], "<u4")
        for k, at in enumerate(range(0, len(ids), 2048)):
            want[d, k] = zlib.crc32(ids[at : at + 2048].tobytes())
    got = p.run(spark, small).collect()
    assert {(r["doc_id"], r["piece"]): r["ids_crc32"] for r in got} == want and len(got) == len(want)


def test_all_but_the_last_stage_keep_the_columns(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for _, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, small)
        assert docs.columns == spark.read.parquet(f"{small}/documents.parquet").columns


def test_empty(spark, empty):
    assert p.run(spark, empty).count() == 0
