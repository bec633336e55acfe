"""The pipeline's stages against the operators they call and brute force."""

import corpus_pipeline as P
from outagelens.llm import queries

from test_operators import SF, brute_jaccard, llm  # noqa: F401 - a fixture


def test_stages(llm):
    docs = llm.read.parquet(f"{SF}/documents.parquet").cache()
    kept = docs
    for name, stage in P.STAGES[:-1]:
        before, kept = kept, stage(llm, kept, SF).cache()
        assert kept.columns == docs.columns
        assert kept.select("doc_id").exceptAll(before.select("doc_id")).count() == 0
        if name == "quality_rules":
            good = {r.doc_id for r in queries.QUERIES["op4_perplexity_bands"](llm, SF).where("kept").collect()}
            assert {r.doc_id for r in kept.collect()} == good
        elif name == "ngram_jaccard":
            own = brute_jaccard([(r.doc_id, r.text or "") for r in before.collect()])
            assert {r.doc_id for r in kept.collect()} == {i for i, _, c in own if i == c}
        elif name == "secret_scans":
            assert kept.count() == before.count()
            assert kept.where("text rlike 'token = .?[0-9a-f]{24}'").count() == 0
    packed = P.STAGES[-1][1](llm, kept, SF)
    assert packed.select("doc_id").distinct().count() == kept.count()
    assert P.run(llm, SF).groupBy().sum("length").first()[0] == packed.groupBy().sum("length").first()[0]
