from helpers import SCHEMA, documents, prose

import corpus_pipeline
from weblake.llm.common import stage


def test_stages_take_effect(spark, tmp_path):
    passage = prose(500, 60)
    good = ["\n".join(prose(10 * i + j, 40) for j in range(3)) for i in range(60)]
    toxic = [g.replace(" ", " you vilefolk ", 2) for g in ("\n".join(prose(7000 + 10 * i + j, 40) for j in range(3)) for i in range(40))]
    junk = ["\n".join(" | ".join(f"k{i}x{j}y{k}" for k in range(20)) for j in range(3)) for i in range(30)]
    texts = good + toxic + junk + [good[0], good[1] + " tail", f"{good[2]}\n{passage}", f"{prose(8000, 40)}\n{passage}\n{prose(8001, 20)}", None, ""]
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(i < 100), int(60 <= i < 100)) for i in range(130)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, after = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = stage(step(spark, docs, str(tmp_path)), "test")
        assert docs.columns == corpus_pipeline.COLUMNS
        after[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = set(range(60))
    assert set(after["quality rules"]) == kept | set(range(60, 100)) | {130, 131, 132, 133}
    assert set(after["toxicity"]) & set(range(60, 100)) == set() and kept <= set(after["toxicity"])
    assert set(after["near-dedup"]) == kept | {132, 133} - ({132} if 132 not in after["near-dedup"] else set())
    last = after["substring dedup"]
    assert all(last[i] == texts[i] for i in kept - {0, 1, 2})
    assert passage not in last[133]
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in pieces} == set(last)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
