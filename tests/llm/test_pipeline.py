"""The pipeline on planted rows, each stage against a plain version of it."""

import random

import pytest

import corpus_pipeline
from palimpsest.llm import bpe
from tests.llm.test_operators import EMAIL, brute_classes, brute_contamination

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, high int, domain string"


def planted():
    rng = random.Random(17)
    words = {"en": [f"the{k}th" for k in range(60)], "de": [f"und{k}sch" for k in range(60)]}
    rows = [(i, " ".join(rng.choices(words[k], k=rng.randint(20, 60))), k) for i, k in enumerate(["en", "de"] * 40)]
    passage = " ".join(rng.choices(words["en"], k=14))
    base = rows[3][1]
    rows += [
        (200, base, "de"),  # a copy
        (201, base + " mehr", "de"),  # a near copy
        (202, f"{rows[4][1]} {passage.upper()} and more", "en"),  # a benchmark passage
        (203, f"write to {rows[6][1]} or a.b@c.org now", "en"),
        (204, "", "en"),
        (205, None, "de"),
        (206, "12 34 !!", "en"),
        (207, " ".join(rng.choices(words["de"], k=4_000)), "de"),
        (208, f"reach bob [at] mail [dot] org {rows[8][1]}", "en"),
    ]
    return [(i, t, k, f"src{i % 3}", len(t) if t is not None else None, 1, "x") for i, t, k in rows], passage


@pytest.fixture
def folder(spark, tmp_path):
    def write(rows, items):
        where = str(tmp_path / "data")
        spark.createDataFrame(rows, SCHEMA).repartition(3).write.mode("overwrite").parquet(f"{where}/documents.parquet")
        spark.createDataFrame(items, "item_id bigint, text string").write.mode("overwrite").parquet(f"{where}/benchmark.parquet")
        return where

    return write


def test_pipeline(spark, folder):
    import tiktoken

    rows, passage = planted()
    items = [(1, passage), (2, "nothing of this occurs anywhere in the documents at all"), (3, None)]
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder(rows + [rows[0]], items)).collect()}
    kept = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    _, classes = brute_classes([r[1] for r in kept], [r[0] for r in kept])
    kept = [r for r, c in zip(kept, classes, strict=True) if r[0] == c]
    kept = [r for r, w in zip(kept, brute_contamination([r[1] for r in kept], items), strict=True) if not w[1]]
    want = {r[0]: EMAIL.sub("<EMAIL>", r[1]).replace("bob [at] mail [dot] org", "<EMAIL>") for r in kept}
    assert {200, 201, 202, 204, 205, 206}.isdisjoint(want) and {203, 207, 208} <= set(want)
    assert {i: r["text"] for i, r in got.items()} == want
    ranks, pattern = bpe.public_ranks()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    assert all(r["ids"] == library.encode_ordinary(want[i]) and r["n_tokens"] == len(r["ids"]) for i, r in got.items())


def test_stages_keep_the_columns_of_documents(spark, folder):
    rows, passage = planted()
    where = folder(rows, [(1, passage)])
    docs = spark.read.parquet(f"{where}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, where).columns == docs.columns, name


def test_pipeline_of_nothing(spark, folder):
    assert corpus_pipeline.run(spark, folder([], [])).count() == 0
