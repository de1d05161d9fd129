import corpus_pipeline
from quarry.llm import decontaminate, queries, toxicity

from .test_ngram_join import brute as near_copies

SF = "/root/testdata/sf0.001"


def test_stages_decide_and_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", "1 AS n", "'x' AS token")
    extra = spark.createDataFrame([(10 ** 6, None), (10 ** 6 + 1, ""), (None, "no id"), (10 ** 6 + 2, "token=abcdefgh")], "doc_id long, text string")
    docs = docs.unionByName(extra, allowMissingColumns=True)
    seen = {}
    for name, fn in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.stage(fn(spark, docs, SF), name)
        seen[name] = (before, docs)
        if name != "packing":
            assert docs.columns == before.columns, name
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    before, after = seen["toxicity"]
    model = toxicity.train(before, spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids(after) == ids(before) - ids(toxicity.score(before, model).where("predicted = 1"))
    before, after = seen["ngram_jaccard_join"]
    rows = [(r.doc_id, r.text) for r in before.collect() if r.doc_id is not None]
    assert ids(after) - {None} == {d for d, _, low in near_copies(rows) if d == low} and None in ids(after)
    before, after = seen["decontamination"]
    assert ids(after) == ids(before) - ids(decontaminate.find_leaks(before, spark.read.parquet(f"{SF}/benchmark.parquet")))
    before, after = seen["secret_scans"]
    assert ids(after) == ids(before)
    assert after.where(f"doc_id = {10 ** 6 + 2}").first().text == "[secret]"
    before, after = seen["packing"]
    assert ids(after) == ids(before) - {None}


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "decontamination", "secret_scans", "packing"]
    assert sorted(int(n.split("_")[0][2:]) for n in queries.QUERIES) == list(range(1, 11))


def test_stages_on_an_empty_table_and_big_ids(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    big = spark.createDataFrame([(2 ** 60 + 1, "one two three four"), (None, "no id here")], "doc_id long, text string")
    for name, fn in corpus_pipeline.STAGES:
        assert fn(spark, docs.limit(0), SF).collect() == [], name
        kept = {r.doc_id for r in fn(spark, big, SF).select("doc_id").collect()}
        assert kept == ({2 ** 60 + 1} if name == "packing" else {2 ** 60 + 1, None}), name


def test_rows_without_an_id_are_left_out(spark):
    from quarry.llm import ngram_join, packing, quality_cnn, secret_scan, token_counts, token_files
    from quarry.llm.common import vocabulary
    df = spark.createDataFrame([(2 ** 60 + 1, "a token=abcdefgh"), (None, "no id")], "doc_id long, text string")
    path = vocabulary()
    for out in (ngram_join.near_duplicates(df), packing.pack(df, path), quality_cnn.score(df, quality_cnn.new_net()), secret_scan.find_secrets(df),
                token_counts.count_tokens(df, path), token_files.token_output(df, path), toxicity.score(df, toxicity.Model([], toxicity.np.zeros(0)))):
        assert {r.doc_id for r in out.collect()} == {2 ** 60 + 1}
