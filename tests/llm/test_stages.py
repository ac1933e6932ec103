"""The pipeline's stages on odd tables."""

from pyspark.sql import functions as F

import corpus_pipeline
from tidepool.llm.shared import Scratch

DATA = "/root/testdata/sf0.001"


def odd(spark):
    """Documents with columns whose names the stages use themselves; two copies, a null and an empty text, a null source."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    text = "one two three four five six seven eight nine ten"
    rows = [(1, "a", text), (2, "a", text), (3, "b", None), (4, "b", ""), (5, None, "nothing like the others, a text of its own with words enough")]
    made = spark.createDataFrame(rows, "doc_id long, source string, text string")
    kinds = {f.name: f.dataType for f in docs.schema}
    made = made.select(*[(F.col(c) if c in made.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])
    return made.withColumns({c: F.lit(7) for c in ("kept_doc", "Node", "weight", "size", "_root")})


def test_empty_tables_pass_all_stages(spark):
    docs, scratch = odd(spark).limit(0), Scratch(spark, "stages")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = scratch.save(stage(spark, docs, DATA), f"s{k}")
        assert out.count() == 0, name
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
            docs = out


def test_stages_without_a_model_on_nulls_copies_and_clashing_columns(spark):
    docs = Scratch(spark, "stages").save(odd(spark), "docs")
    for stage, want in ((corpus_pipeline.near_duplicates, [1, 3, 4, 5]), (corpus_pipeline.decontamination, [1, 2, 3, 4, 5])):
        out = stage(spark, docs, DATA)
        assert sorted(r.doc_id for r in out.collect()) == want and out.columns == docs.columns
    mixed = {r.doc_id: (r.source, r.size) for r in corpus_pipeline.mixing(spark, docs, DATA).collect()}
    assert mixed.keys() <= {1, 2, 5} and mixed[5] == (None, 12) and {1, 2} & mixed.keys()
