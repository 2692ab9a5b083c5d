"""The pipeline on planted documents, against what each stage must do."""

import random

import corpus_pipeline
from tradelens.llm.queries import ORACLES, QUERIES


def test_stages(spark, tmp_path):
    rng = random.Random(9)
    word = lambda: "w" + str(rng.randint(0, 900))
    texts = [" ".join(word() for _ in range(60)) for _ in range(80)]
    toxic = {i for i in range(80) if i % 4 == 0}
    texts = [t + " vile nasty foul" * 3 if i in toxic else t for i, t in enumerate(texts)]
    rows = list(enumerate(texts))
    rows += [(100, texts[1].replace(" ", "  ")), (101, texts[2] + " more"), (102, "more " + texts[2]), (103, None), (104, "")]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(80)], "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == set(range(80)) - toxic | {103}
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5


def test_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)
