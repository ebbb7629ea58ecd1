import os

import pytest

import corpus_pipeline as pipeline
from duotide.llm import rules, secrets
from llm_rows import words

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = " ".join(words(150, 5))
    texts = [base + " " + " ".join(words(80, 100 + i)) for i in range(40)]
    texts += [texts[0], texts[1], base, " ".join(words(150, 77)) + " token = 'abcdefgh12345'", " ".join(w + "###" for w in words(120, 9)), " ".join(w + "%%%" for w in words(90, 8)), "short", None, ""]
    texts += [texts[i].replace(texts[i].split()[200], "changed", 1) for i in (5, 6)]  # near copies
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    out = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{out}/documents.parquet")
    labels = [(i, int("###" not in (t or "") and "%%%" not in (t or "")), 0) for i, t in enumerate(texts) if t]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return out, rows


def test_stages(spark, folder, tmp_path):
    out, rows = folder
    docs = spark.read.parquet(f"{out}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in pipeline.STAGES[:-1]:
        stage(spark, docs, out).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == columns
        seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert not {44, 45} & set(seen["quality_classifier"]) and set(range(40)) <= set(seen["quality_classifier"])
    plain = {i for i, t in seen["quality_classifier"].items() if not rules.base_failed(d := rules.Doc((t or "").encode())) and not any(r.rejects(d) for r in rules.RULES)}
    assert set(seen["quality_rules"]) == plain and not {46, 47, 48} & plain
    assert {0, 1} <= set(seen["near_duplicates"]) and not {40, 41, 49, 50} & set(seen["near_duplicates"])
    assert {49, 50} <= set(seen["quality_rules"])
    assert set(seen["secret_scan"]) == set(seen["near_duplicates"])
    assert "[secret]" in seen["secret_scan"][43] and not any(secrets.scan([t.encode() for t in seen["secret_scan"].values()]))
    packed = pipeline.STAGES[-1][1](spark, docs, out).collect()
    assert {r["doc_id"] for r in packed} == set(seen["secret_scan"])


def test_run(spark, folder):
    out, _ = folder
    rows = pipeline.run(spark, out).collect()
    assert sum(r["length"] for r in rows) == sum({r["doc_id"]: r["doc_tokens"] for r in rows}.values())


def test_empty(spark, folder, tmp_path):
    out, _ = folder
    docs = spark.createDataFrame([], COLUMNS)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, out).count() == 0
    assert os.path.isdir(out)
