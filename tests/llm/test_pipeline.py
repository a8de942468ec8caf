from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from stridegraph.llm import classifier, mixing, pii
from stridegraph.llm.common import Scratch, table

from .test_ngram_join import brute


def test_each_stage_against_its_own_input(spark, sf_dir):
    scratch = Scratch(spark, "t")
    docs = table(spark, sf_dir, "documents")
    stages = dict(corpus_pipeline.STAGES)
    names = list(stages)
    step = lambda i, d: scratch.keep(stages[names[i]](spark, d, sf_dir))
    one = step(0, docs)
    kept = {r.doc_id for r in classifier.scored(docs, classifier.fitted(docs, table(spark, sf_dir, "labels"))).where("kept").collect()}
    assert {r.doc_id for r in one.collect()} == kept and one.columns == docs.columns
    two = step(1, one)
    rows = [(r.doc_id, r.text) for r in one.collect()]
    assert {r.doc_id for r in two.collect()} == {c for c, _ in brute(rows)}
    three = step(2, two)
    assert three.columns == docs.columns and three.count() == two.count()
    left = pii.digests(three).agg(F.sum(F.col("n_email") + F.col("n_ip") + F.col("n_card") + F.col("n_phone"))).first()[0]
    assert left == 0 and three.where("text like '%<EMAIL>%'").count() > 0
    four = step(3, three)
    copies = {r.doc_id: r.copies for r in mixing.mix(three).collect() if r.copies}
    assert Counter(r.doc_id for r in four.collect()) == copies
    five = step(4, four)
    assert Counter(r.doc_id for r in five.where("piece = 0").collect()) == copies
    assert five.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
    assert corpus_pipeline.run(spark, sf_dir).count() == five.count()
