"""The pipeline against plain versions of its stages."""

import brute
import corpus_pipeline
from bidlake.llm import quality_rules as rules
from bidlake.llm import queries as q
from bidlake.llm.common import WordHash


def test_pipeline(spark, small):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    hashes = WordHash()
    docs = {i: rules.clean(t.encode())[0].decode() for i, t in docs.items() if rules.measure(i, (t or "").encode(), hashes)[7]}
    gone = brute.repeated_runs(list(docs.items()), 50)
    for i, hit in gone.items():
        lines = brute.lines_of(docs[i])
        left = [x for k, x in enumerate(lines) if k not in hit]
        docs[i] = None if not left else [docs[i][a:b] for _, a, b in left]
    docs = {i: t for i, t in docs.items() if t is not None}
    flat = {i: "\n".join(t) if isinstance(t, list) else t for i, t in docs.items()}
    classes = brute.classes(list(flat.items()), 5, 80)
    flat = {i: t for i, t in flat.items() if classes[i][1] == i}
    found = brute.windows(items)
    flat = {i: t for i, t in flat.items() if not brute.contamination(t, found)[3]}
    got = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, small).collect()}
    assert set(got) == set(flat)
    lib = brute.codec().library
    same = [i for i, t in flat.items() if i not in gone and not brute.contamination(t, found)[1]]
    assert same and all(got[i] == len(lib.encode(flat[i])) for i in same)


def test_stages_keep_columns(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(30), small).columns == docs.columns


def test_registered():
    import __spark_entry__

    assert {"pipeline", *q.queries()} <= set(__spark_entry__.queries())
