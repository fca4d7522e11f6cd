"""The stages of the pipeline over a given small table, each held against what it should do to its own input."""

from __future__ import annotations

import corpus_pipeline
from marketbars.llm import common, decontaminate, pii_bootstrap, quality_rules

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = common.table(spark, SF, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5
    a = common.keep(stages["quality rules"](spark, docs, SF), "a")
    verdict = {r.doc_id for r in quality_rules.op7(docs).where("kept").collect()}
    assert {r.doc_id for r in a.collect()} == verdict and 0 < len(verdict) < docs.count()
    b = common.keep(stages["SimHash near-dedup"](spark, a, SF), "b")
    texts = [r.text for r in b.collect()]
    assert len(set(texts)) == len(texts) and {r.text for r in a.collect()} >= set(texts)
    c = common.keep(stages["benchmark decontamination"](spark, b, SF), "c")
    assert decontaminate.op9(c, common.table(spark, SF, "benchmark")).count() == 0
    d = common.keep(stages["PII"](spark, c, SF), "d")
    assert d.count() == c.count() and not d.where("text LIKE '%@mail%'").count()
    for x in (a, b, c, d):
        assert x.columns == docs.columns
    kept, tokens = ({r.doc_id: r for r in x.collect()} for x in (c, d))
    for i, r in kept.items():  # what base patterns and confirmed contexts mark is replaced, the rest stays
        spans = pii_bootstrap.base_spans(r.text)
        assert (tokens[i].text == r.text) <= (not spans) and tokens[i].n_chars == len(tokens[i].text)
        assert not [x for x in pii_bootstrap.base_spans(tokens[i].text) if x[0] < 2]
    e = stages["SentencePiece encoding"](spark, d, SF)
    assert e.count() == d.count()
    assert sorted(r.ids_sha256 for r in e.collect()) == sorted(r.ids_sha256 for r in corpus_pipeline.run(spark, SF).collect())
