from collections import Counter

import pytest

import corpus_pipeline
from casegrain.llm import toxicity
from tests.llm.test_exact_dedup import expected as equal_groups
from tests.llm.test_mixing import check as check_mix
from tests.llm.test_packing import check as check_packing
from tests.llm.test_packing import padding
from tests.llm.test_simhash import expected as near_classes


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "text", "source").collect()]


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "mixing", "packing"]


@pytest.fixture(scope="module")
def stages(spark, data, tmp_path_factory):
    """Every stage's output, written and read again like the pipeline does."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], data).write.parquet(str(folder / str(i)))
        out.append(spark.read.parquet(str(folder / str(i))))
    return out


def test_each_stage_equals_brute_force_on_its_input(spark, data, stages):
    docs, clean, unique, apart, mixed, packed = stages
    assert all(s.columns == docs.columns for s in stages[1:5])
    labels = spark.read.parquet(f"{data}/labels.parquet")
    scores = toxicity.scored(docs, toxicity.train(docs, labels)).collect()
    assert {r[0] for r in rows_of(clean)} == {r["doc_id"] for r in scores if r["predicted"] == 0}
    plain = [r[:2] for r in rows_of(clean)]
    assert {r[0] for r in rows_of(unique)} == {r[0] for r in equal_groups(plain) if r[3]}
    plain = [r[:2] for r in rows_of(unique)]
    assert {r[0] for r in rows_of(apart)} == {c for _, _, c in near_classes(plain)}
    from casegrain.llm import mixing
    mix = mixing.mixture(apart).collect()
    check_mix(rows_of(apart), mix)
    copies = Counter(r[0] for r in rows_of(mixed))
    assert copies == Counter({r["doc_id"]: r["copies"] for r in mix if r["copies"]})
    sequences = check_packing(packed.collect(), [r[:2] for r in rows_of(mixed)])
    assert padding(sequences) < 0.05


def test_run_gives_the_last_stage(spark, data, stages):
    key = lambda df: sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in df.collect())
    got = corpus_pipeline.run(spark, data)
    assert got.columns == stages[-1].columns
    total = lambda rows: sum(n for _, _, n, _ in rows)
    assert total(key(got)) == total(key(stages[-1]))


def test_empty_and_null_documents(spark, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for i, rows in enumerate(([], [(1, None, None, None, None), (None, "a b", "en", "s", 3), (2, "", "en", "s", 0)])):
        folder = str(tmp_path / f"docs{i}")
        spark.createDataFrame(rows, schema).write.parquet(folder)
        docs = spark.read.parquet(folder)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, str(tmp_path)).write.parquet(f"{folder}-{k}")
            docs = spark.read.parquet(f"{folder}-{k}")
        assert docs.count() <= 4 and "sequence_id" in docs.columns
