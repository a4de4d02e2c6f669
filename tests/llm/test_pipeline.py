from helpers import sample

import corpus_pipeline
from meterlake.llm import decontam_template, pack_pow2, quality_cnn
from meterlake.llm.common import doc_keys
from meterlake.llm.queries import QUERIES, table, tokenizer_path

SF = "/root/testdata/sf0.01"


def test_stages_follow_one_another(spark):
    docs = table(spark, SF, "documents")
    columns, seen = docs.columns, [{r[0] for r in sample()}]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.cut(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == columns
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= seen[-1]
        seen.append(set(ids))
    full, good, lined, alone, clean = seen
    assert good == {r.doc_id for r in QUERIES["op7_quality_cnn"](spark, SF).where("predicted = 1").collect()} and 0.7 * len(full) < len(good) < len(full)
    assert lined == good and len(alone) < len(lined) and len(clean) <= len(alone)
    whole = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    got = {r.doc_id: r.n for r in whole.groupBy("doc_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()}
    own = pack_pow2.WordTokenizer(tokenizer_path())
    assert got == {r.doc_id: len(own.encode(r.text)) // 4 + 1 for r in docs.collect()}
    left = docs.select("*", *doc_keys(docs))
    assert decontam_template.matches(left, table(spark, SF, "benchmark")).count() == 0
    assert corpus_pipeline.run(spark, SF).count() == whole.count() and corpus_pipeline.ORACLE_SQL is None


def test_quality_stage_keeps_clean_documents(spark):
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    kept = {r.doc_id for r in quality_cnn.keep_good(table(spark, SF, "documents"), table(spark, SF, "labels")).collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in good) > 0.97 * len(good)
