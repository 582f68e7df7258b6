"""Streaming scoring equals batch scoring of the same documents."""

import os
import tempfile

from pyspark.sql import functions as F

from newsprism.operators import models as md
from newsprism.streaming.scoring import start_scoring


def test_stream_scores_like_batch(spark):
    rows = []
    for i in range(40):
        fake = i % 2 == 0
        rows.append((i, ("fake rumor\nclickbait text " if fake else "verified report\nofficial text ") + f"w{i % 5}",
                     0 if fake else 1))
    train = spark.createDataFrame(rows, "row_id long, text string, label int").withColumn(
        "content", F.regexp_replace("text", "\n", " "))
    model = md.build_pipeline((1, 1), max_iter=50).fit(train)
    base = tempfile.mkdtemp(prefix="np-stream-")
    src, sink, ckpt = (os.path.join(base, d) for d in ("src", "sink", "ckpt"))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t, _ in rows],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(src)
    q = start_scoring(spark, model, src, sink, ckpt, available_now=True)
    q.awaitTermination(120)
    out = spark.read.parquet(sink)
    assert out.count() == 40
    batch = md.predict(model, train, keep=("row_id",)).select("row_id", F.col("p").alias("pb"))
    diff = out.join(batch, "row_id").filter(F.abs(F.col("p") - F.col("pb")) > 1e-9).count()
    assert diff == 0
