"""The toxicity classifier on planted words, and its defined results for odd input."""

import random
import zlib

from pyspark.sql import functions as F

from tradelens.llm.toxicity import fit, toxicity


def planted(spark, n=400):
    rng = random.Random(4)
    clean = [f"word{i}" for i in range(200)]
    docs, labels = [], []
    for i in range(n):
        toxic = int(i % 5 == 0)
        ws = [rng.choice(clean) for _ in range(rng.randint(5, 60))]
        for _ in range(3 * toxic):
            ws[rng.randrange(len(ws))] = rng.choice(["vile", "nasty", "foul"])
        docs.append((i, " ".join(ws), "x"))
        labels.append((i, 1, toxic))
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out(spark):
    docs, labels = planted(spark)
    rows = toxicity(docs, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    right = sum((r.predicted == 1) == (r.doc_id % 5 == 0) for r in held)
    assert right / len(held) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_odd_input(spark):
    docs, labels = planted(spark, 60)
    odd = spark.createDataFrame([(1, None), (1, None), (None, ""), (3, "w " * 50_000)], "doc_id long, text string")
    assert toxicity(odd, labels).count() == 4
    assert toxicity(docs.limit(0), labels).count() == 0
    assert {r.predicted for r in toxicity(docs, labels.limit(0)).collect()} == {0}
    assert {r.predicted for r in toxicity(docs, labels.withColumn("toxic", F.lit(None).cast("int"))).collect()} == {0}
    assert fit(docs, labels, max_train=10) is not None
