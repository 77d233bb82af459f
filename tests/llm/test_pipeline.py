"""The stages beside brute force, each over what the stage before kept."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from plumbline.llm import mixing, quality
from tests.llm import test_contamination, test_jaccard, test_mixing, test_tokens

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "labels", "benchmark")


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in p.STAGES:
        done = stage(spark, docs, SF).persist()
        out.append((name, docs, done))
        docs = done
    return {name: (given, done) for name, given, done in out}


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_columns(steps):
    for name, (given, done) in list(steps.items())[:-1]:
        assert given.dtypes == done.dtypes, name


def test_quality_drops_what_it_rejects(spark, steps):
    given, done = steps["quality"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = {r["doc_id"] for r in quality.quality(given, labels).where("predicted = 1").collect()}
    assert rows(done) == [r for r in rows(given) if r[0] in kept]
    bad = {r["doc_id"] for r in labels.where("quality = 0").collect()}
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    left = {r["doc_id"] for r in done.collect()}
    assert len(left & bad) <= 0.1 * len(bad) and len(good - left) <= 0.02 * len(good)


def test_one_of_each_group_stays(steps):
    given, done = steps["near_duplicates"]
    groups = test_jaccard.brute([(r["doc_id"], r["text"]) for r in given.collect()], 5, 0.8)
    assert {r[0] for r in rows(done)} == {c for _, _, c in groups} and done.count() == len({c for _, _, c in groups}) < given.count()


def test_contaminated_documents_go(spark, steps):
    given, done = steps["contamination"]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = {r[0] for r in test_contamination.brute([(r["doc_id"], r["text"]) for r in given.collect()], items) if r[5]}
    assert hit and rows(done) == [r for r in rows(given) if r[0] not in hit]


def test_copies_follow_the_rates(steps):
    given, done = steps["mixture"]
    mass = Counter()
    for r in given.collect():
        mass[r["source"]] += len(r["text"])
    weight = {s: m**mixing.FLATTEN for s, m in mass.items()}
    want = Counter()
    for r in given.collect():
        rate = weight[r["source"]] / sum(weight.values()) * sum(mass.values()) / mass[r["source"]]
        parts = max(1, math.ceil(rate / mixing.PART))
        want[r["doc_id"]] = sum(test_mixing.inverse(rate / parts, test_mixing.unit(f"{mixing.SEED}|{r['doc_id']}|{j}")) for j in range(parts))
    assert Counter(r["doc_id"] for r in done.collect()) == Counter({k: v for k, v in want.items() if v})


def test_the_mixture_keeps_a_callers_columns(spark):
    docs = spark.createDataFrame([(i, "word " * 20, f"s{i % 3}", f"c{i}", 2 * i) for i in range(200)], "doc_id bigint, text string, source string, copy string, place int")
    done = p.mixture(spark, docs, SF)
    assert done.dtypes == docs.dtypes and done.count() > 100 and all(r["copy"] == f"c{r['doc_id']}" and r["place"] == 2 * r["doc_id"] for r in done.collect())


def test_ids_of_what_is_left(steps):
    given, done = steps["tokens"]
    want = test_tokens.brute(sorted((r["doc_id"], r["text"]) for r in given.collect()))
    assert sorted(map(tuple, done.collect())) == sorted(want)


def test_run_is_the_chain(spark, steps):
    assert rows(p.run(spark, SF)) == rows(steps["tokens"][1])


def test_odd_rows_pass(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    odd = [(10**6, None, None, None, None), (10**6 + 1, "", "en", "src0", 0), (None, "no id at all", "en", None, 3), (10**6 + 2, "word " * 30_000, "en", "src0", 1)]
    docs = docs.union(spark.createDataFrame(odd, docs.schema)).union(docs.limit(2)).withColumn("score", F.lit("x")).withColumn("copy", F.lit(1))
    for table, df in (("documents", docs), *((t, spark.read.parquet(f"{SF}/{t}.parquet")) for t in TABLES[1:])):
        df.write.parquet(f"{tmp_path}/{table}.parquet")
    assert p.run(spark, str(tmp_path)).count() > 20
    for table in TABLES:
        spark.read.parquet(f"{tmp_path}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{table}.parquet")
    assert p.run(spark, f"{tmp_path}/none").count() == 0
