import corpus_pipeline
from ordix.llm import decontaminate, jaccard_join, quality, queries


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert set(queries.ORACLES) <= set(queries.QUERIES)


def test_stages_one_by_one(spark, sf_dir, docs):
    """Each stage does to its own input what its operator says, and nothing else."""
    from ordix.llm._dist import Kept

    at, seen = docs, []
    for name, stage in corpus_pipeline.STAGES:
        after = Kept(stage(spark, at, sf_dir)).df
        seen.append((name, at, after))
        if name != "packing":
            assert after.columns == docs.columns
        at = after
    by = {n: (a, b) for n, a, b in seen}
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())

    a, b = by["quality_rules"]
    kept = quality.score(a, quality.fit(a, quality.trusted_ids(spark.read.parquet(f"{sf_dir}/labels.parquet")))).where("kept")
    assert ids(b) == ids(kept) and len(ids(b)) > 0.6 * docs.count()
    a, b = by["line_dedup"]
    assert ids(a) == ids(b)
    lines = [x for r in b.collect() for x in r.text.split("\n") if x.strip()]
    assert len(lines) == len(set(lines))
    a, b = by["near_duplicates"]
    c = jaccard_join.components_of(a, 5, 80).collect()
    assert ids(b) == sorted({r.component_id for r in c})
    a, b = by["benchmark_decontamination"]
    bad = decontaminate.report(a, decontaminate.blocks(spark.read.parquet(f"{sf_dir}/benchmark.parquet"))).where("contaminated")
    assert sorted(ids(b) + ids(bad)) == ids(a) and ids(bad)
    a, b = by["packing"]
    assert ids(a) == ids(b)


def test_run_gives_the_stages_result(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "bucket", "batch"} <= set(out.columns) and out.count() > 0


def test_stages_on_an_empty_table_and_on_messy_rows(spark, sf_dir, docs, messy):
    """Every stage takes an empty table, and nulls, empty and very long texts and repeated rows."""
    from ordix.llm._dist import Kept

    for start, some in ((docs.limit(0), False), (messy.select(docs.columns).unionByName(docs.limit(40)), True)):
        at = start
        for name, stage in corpus_pipeline.STAGES:
            at = Kept(stage(spark, at, sf_dir)).df
            assert name == "packing" or at.columns == docs.columns
        assert (at.count() > 0) == some
