import corpus_pipeline
from litsieve.llm.common import written

from .test_operators import DOCS, prose


def test_stages(spark, tmp_path):
    bench = prose(700, 40)
    texts = [prose(i, 60) for i in range(30)]
    near = texts[0].split()
    near[20] = "other"
    texts += [texts[1], " ".join(near), prose(90, 30) + "\n" + bench + "\n" + prose(91, 30), None, ""]
    frame = spark.createDataFrame([(i, t, "en", b"x", 0.5) for i, t in enumerate(texts)] + [(5, texts[5], "en", b"x", 0.5)], DOCS)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 0) for i in range(20)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, str(tmp_path)), "stage")
        assert docs.columns == frame.columns
        kept.append(sorted(r["doc_id"] for r in docs.select("doc_id").collect()))
    assert kept[0] == sorted([*range(35), 5])
    assert kept[1] == [i for i in range(35) if i not in (1, 33)]
    assert kept[2] == [i for i in kept[1] if i != 31]
    assert kept[3] == [i for i in kept[2] if i != 32]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert packed.select("doc_id").distinct().count() == len(kept[3])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == packed.count()


def test_stages_tell_rows_of_one_id_apart(spark, tmp_path):
    """A doc_id that comes with two texts loses only the near copy; columns may be called like the stages' own, or hold a dot."""
    a, b = prose(801, 60), prose(802, 60)
    rows = [(1, a, "x", 1, "y"), (2, a.replace(a.split()[9], "other", 1), "x", 2, "y"), (2, b, "x", 3, "y"), (None, prose(803, 60), "x", 4, "y"), (7, None, "x", 5, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _gone string, _id int, `a.b` string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = written(stage(spark, docs, str(tmp_path)), "stage")
        assert docs.columns == frame.columns
    assert sorted(r["_id"] for r in docs.collect()) == [1, 3, 4, 5]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 4
