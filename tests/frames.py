"""Frames that several test modules build."""


def doc_frame(spark, *texts):
    from bomspark.sources.documents import typed

    return typed(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "bom_id string, content string"))
