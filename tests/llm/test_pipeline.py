"""The pipeline against its stages' decisions, taken one by one on the smallest data."""

import corpus_pipeline
from voxelloom.llm import decontaminate, exact_dedup, quality, simhash
from voxelloom.llm.common import table

FOLDER = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = table(spark, FOLDER, "documents")
    rows = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    bad = {r["doc_id"] for r in quality.classify(docs, table(spark, FOLDER, "labels")).where("predicted = 0").collect()}
    left = {d: t for d, t in rows.items() if d not in bad}
    last = {t: max(d for d, u in left.items() if u == t) for t in set(left.values())}
    left = {d: t for d, t in left.items() if last[t] == d}
    now = docs.where(docs["doc_id"].isin(*left))
    near = {r["doc_id"] for r in simhash.near_dedup(now).where("component_id = doc_id").collect()}
    leaks = {r["doc_id"] for r in decontaminate.contaminated(now, table(spark, FOLDER, "benchmark")).collect()}
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert got == near - leaks and 0 < len(got) < len(rows)


def test_stages_return_document_columns(spark):
    docs = table(spark, FOLDER, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES][-1] == "byte-level BPE"
    for _, step in corpus_pipeline.STAGES[1:4]:
        assert step(spark, docs, FOLDER).columns == docs.columns
    assert exact_dedup.deduplicated(docs).count() < docs.count()
