import hashlib
from collections import Counter

import brute
from pyspark.sql import functions as F

import corpus_pipeline
from edgeloom.llm import bpe, langid, mixing

SF = "/root/testdata/sf0.001"


def by_lists(spark):
    """The stages over lists."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    filters = langid.learn(docs)
    rows = [r.asDict() for r in docs.collect()]
    rows = [r for r in rows if (p := filters.decide(r["text"] or ""))[0] != "und" and p[1] >= corpus_pipeline.LEAST_SCORE]
    kept = set(brute.near_kept([(r["doc_id"], r["text"]) for r in rows]))
    rows = [r for r in rows if (r["doc_id"], r["text"]) in kept]
    for r, (_, t, _) in zip(rows, brute.cut([(r["doc_id"], r["text"]) for r in rows]), strict=True):
        r["text"] = t
    plan = {r["doc_id"]: r["copies"] for r in mixing.mix(spark.createDataFrame(rows, docs.schema), plan_only=True).collect()}
    v = bpe.Vocabulary(bpe.default_path("byte_bpe_50k.tiktoken"), bpe.default_pattern())
    out = Counter()
    for r in rows:
        ids = v.encode(r["text"])
        out[r["doc_id"], len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest()] += plan[r["doc_id"]]
    return +out


def test_pipeline_is_its_stages(spark):
    got = Counter(tuple(r) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == by_lists(spark)


def test_stages_keep_columns_and_stand_odd_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0)], docs.schema)
    for df in (docs.where("false"), odd, docs.limit(20).unionByName(odd)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            df = stage(spark, df, SF)
            assert df.columns == docs.columns
        assert corpus_pipeline.STAGES[-1][1](spark, df, SF).count() == df.count()


def test_extra_columns_change_nothing(spark):
    plain = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    names = ["__text", "__kept", "__KEPT_", "__removed", "__lang", "__score", "__rate", "__rate_of", "__doc", "__doch", "__units", "fp", "size", "target", "component_id"]
    wide = plain.select("*", *(F.lit(n).alias(n) for n in names))
    ends = []
    for df in (plain, wide):
        columns = df.columns
        for _, stage in corpus_pipeline.STAGES[:-1]:
            df = stage(spark, df, SF)
            assert df.columns == columns
        if len(columns) > len(plain.columns):
            assert df.where(" or ".join(f"`{n}` <> '{n}'" for n in names)).isEmpty()
        ends.append(Counter(tuple(r) for r in corpus_pipeline.tokenise(spark, df, SF).collect()))
    assert ends[0] == ends[1] and ends[0]
