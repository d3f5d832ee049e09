"""Versioned tables, keyed lookups and the persistent search index."""

import pytest
from pyspark.sql import functions as F

from vitrine.functions import constants as K
from vitrine.operators import search
from vitrine.operators.inverted import SearchIndex
from vitrine.plans import catalogue
from vitrine.sources import files, versions
from vitrine.sources.keyed import KeyedTable
from vitrine.sources.versions import Conflict, Versions
from vitrine.streaming import jobs


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_broken_write_leaves_the_old_version(spark, tmp_path):
    v = Versions(spark, f"{tmp_path}/t")
    assert v.manifest().version == 0
    with pytest.raises(KeyError):
        v.read("rows")
    v.replace("rows", spark.range(5), {"who": "first"})
    broken = spark.range(100).select(F.when(F.col("id") == 77, F.raise_error(F.lit("torn")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="torn"):
        v.replace("rows", broken)
    assert v.manifest().version == 1 and v.read("rows").count() == 5 and v.manifest().facts == {"who": "first"}
    # a manifest that is only half there doesn't count
    v.store.create("_manifests/0000000002.json", '{"version": 2, "tab')
    assert v.manifest().version == 1 and v.read("rows").count() == 5
    with pytest.raises(Conflict):
        v.replace("rows", spark.range(2))
    assert v.vacuum() == 2 and v.read("rows").count() == 5
    assert v.replace("rows", spark.range(2)).version == 2


def test_versions(spark, tmp_path):
    v = Versions(spark, f"{tmp_path}/t")
    base = v.replace("rows", spark.range(3))
    v.append("rows", spark.range(3, 5))
    assert sorted(r.id for r in v.read("rows").collect()) == [0, 1, 2, 3, 4] and v.read("rows", 1).count() == 3
    with pytest.raises(Conflict):
        v.commit(base, {"rows": v.write("rows", spark.range(1))})
    with pytest.raises(ValueError):
        v.append("rows", spark.range(3).withColumnRenamed("id", "other"))
    open_reader = v.read("rows")
    v.replace("rows", v.read("rows").where("id > 1").drop("part"))
    assert open_reader.count() == 5 and v.read("rows").count() == 3 and v.manifest().version == 3
    assert v.vacuum(keep=1) > 0 and v.read("rows").count() == 3
    with pytest.raises(KeyError):
        v.read("rows", 1)


def test_stamp(spark, tmp_path):
    p = tmp_path / "words.json"
    assert versions.stamp(spark, str(p)) == versions.stamp(spark, str(p))
    before = versions.stamp(spark, str(p))
    p.write_text("[]")
    assert (one := versions.stamp(spark, str(p))) != before and one == versions.stamp(spark, str(p))
    p.write_text("[1]")
    assert versions.stamp(spark, str(p)) != one


def test_keyed_lookup_opens_one_bucket(spark, tmp_path):
    t = KeyedTable(spark, f"{tmp_path}/t", "id", buckets=16)
    t.write(spark.range(2000).select(F.concat(F.lit("k"), "id").alias("id"), (F.col("id") * 2).alias("v"), F.lit("x").alias("part_of")))
    got = t.lookup(["k7", "k1999", "none", "k7", None])
    assert {r["id"]: r["v"] for r in got.collect()} == {"k7": 14, "k1999": 3998, "none": None, None: None}
    one = t.lookup(["k7"])
    one.collect()
    plan = plan_of(one)
    scan = next(line for line in plan.splitlines() if "FileScan parquet" in line)
    assert "bucket" in scan.split("PartitionFilters")[1].split("]")[0] and "EqualTo(id,k7)" in scan
    read = t.versions.read("rows").where("bucket = 3")
    assert 0 < read.count() < 2000 / 4
    # put replaces and adds; another object finds the same buckets
    t.put(spark.createDataFrame([("k7", 0, "y"), ("new", 1, "y")], "id string, v long, part_of string"))
    again = KeyedTable(spark, f"{tmp_path}/t", "id", buckets=5)
    assert again.buckets == 16 and {r["id"]: r["v"] for r in again.lookup(["k7", "new", "k8"]).collect()} == {"k7": 0, "new": 1, "k8": 16}
    assert again.lookup([]).count() == 0 and again.rows().count() == 2001


FIELDS = {"title": 3.0, "tags": 1.0, "description": 0.5}
ROWS = [
    (1, "Red ring", ["gold", "rings"], "a red thing"),
    (2, "Blue ring", None, None),
    (3, None, [], ""),
    (4, "the and", ["of"], "stop words"),
    (5, "Red red RED", ["red"], "x " * 200),
    (6, "scarves", ["scarf"], "red scarf"),
]
COLUMNS = "id long, title string, tags array<string>, description string"


def scores(index, *tokens):
    return {r["id"]: round(r["text_score"], 9) for r in index.search(tokens).collect()}


def plain(df, *tokens):
    out = search.bm25(search.postings(df, "id", FIELDS), "id", list(tokens), df.agg(F.count("*").alias("n")))
    return {r["id"]: round(r["text_score"], 9) for r in out.collect()}


def test_index_is_the_plain_score(spark, tmp_path):
    df = spark.createDataFrame(ROWS, COLUMNS)
    index = SearchIndex(spark, f"{tmp_path}/i", "id", FIELDS, buckets=4)
    index.build(df)
    for q in (["red"], ["red", "ring", "red"], ["scarf"], ["nothing"], ["the"], []):
        assert scores(index, *q) == plain(df, *q)
    assert index.facts["n"] == 6 and len(scores(index, "red", "ring")) == 4
    # lengths by hand: title x3, tags x1, description x0.5
    dl = {r["id"]: r["dl"] for r in index.versions.read("lengths").collect()}
    assert dl == {1: 9.0, 2: 6.0, 3: 0.0, 4: 1.0, 5: 85.0, 6: 5.0} and index.facts["total"] == sum(dl.values())


def test_merges_equal_a_rebuild(spark, tmp_path):
    df = spark.createDataFrame(ROWS, COLUMNS)
    index = SearchIndex(spark, f"{tmp_path}/i", "id", FIELDS, buckets=4)
    index.build(df.where("id < 4"))
    index.merge(df.where("id >= 4"))
    assert scores(index, "red", "ring") == plain(df, "red", "ring")
    # 1 comes again with other words, 7 is new, 5 and an unknown id go
    more = spark.createDataFrame([(1, "green ring", None, None), (7, "red scarf", None, None)], COLUMNS)
    index.merge(more)
    index.delete(spark.createDataFrame([(5,), (99,)], "id long"))
    index.merge(more.where("id = 1").withColumn("title", F.lit("Red green")))
    live = df.where("id NOT IN (1, 5)").unionByName(more.where("id = 7")).unionByName(more.where("id = 1").withColumn("title", F.lit("Red green")))
    want = {q: plain(live, *q) for q in (("red",), ("ring", "green"), ("gold",))}
    assert {q: scores(index, *q) for q in want} == want
    f = index.facts
    assert f["n"] == 6 and f["dead"] == 3
    # a deleted document may come back
    index.merge(df.where("id = 5"))
    assert scores(index, "red") == plain(live.unionByName(df.where("id = 5")), "red")
    index.delete(df.where("id = 5").select("id"))
    assert index.compact(dead_share=1.0, max_parts=16) is False and index.compact() is True and index.compact() is False
    assert index.facts["dead"] == 0 and {q: scores(index, *q) for q in want} == want
    index.merge(df.where("id = 5"))
    assert index.facts["n"] == 7 and scores(index, "red") == plain(live.unionByName(df.where("id = 5")), "red")


def test_empty_index(spark, tmp_path):
    index = SearchIndex(spark, f"{tmp_path}/i", "id", FIELDS)
    index.build(spark.createDataFrame([], COLUMNS))
    assert scores(index, "red") == {}
    index.merge(spark.createDataFrame(ROWS, COLUMNS))
    assert scores(index, "red") == plain(spark.createDataFrame(ROWS, COLUMNS), "red")


def test_searches_read_the_buckets_of_their_tokens(spark, sf):
    for name in ("bm25_topk", "hybrid_search_page0"):
        df = catalogue.queries()[name](spark, sf)
        df.collect()
        plan = plan_of(df)
        assert "regexp_extract_all(lower(coalesce(text" not in plan
        index = next(line for line in plan.splitlines() if "FileScan" in line and "postings" in line)
        assert "PartitionFilters: [bucket" in index.replace("isnotnull(bucket", "[bucket") and "token" in index.split("PushedFilters")[1]
    # the index stays until a table changes
    index = catalogue._documents_index(spark, sf)
    before = index.versions.manifest().version
    assert catalogue._documents_index(spark, sf).versions.manifest().version == before
    assert K.FIELD_WEIGHTS and files.shared(spark)


def test_an_index_that_grows_as_documents_arrive(spark, tmp_path):
    df = spark.createDataFrame(ROWS, COLUMNS)
    src, ck = f"{tmp_path}/src", f"{tmp_path}/ck"
    index = SearchIndex(spark, f"{tmp_path}/i", "id", FIELDS, buckets=2)

    def run():
        jobs.search_index(spark.readStream.schema(df.schema).parquet(src), index, ck).awaitTermination()

    df.where("id < 4").write.parquet(src)
    run()
    first = index.versions.manifest().version
    run()  # nothing new
    assert index.versions.manifest().version == first and index.facts["n"] == 3
    changed = df.where("id = 1").withColumn("title", F.lit("red scarf"))
    df.where("id >= 4").unionByName(changed).unionByName(changed).write.mode("append").parquet(src)
    run()
    live = df.where("id <> 1").unionByName(changed)
    assert index.facts["n"] == 6 and scores(index, "red", "scarf") == plain(live, "red", "scarf")


def test_postings_are_shuffled_once(spark, tmp_path, monkeypatch):
    """Tokens are counted where their document stands; lengths are read from one bucket and shuffled no more."""
    plans, write = [], Versions.write
    monkeypatch.setattr(Versions, "write", lambda self, table, df, *by: (plans.append((table, plan_of(df))), write(self, table, df, *by))[1])
    index = SearchIndex(spark, f"{tmp_path}/i", "id", FIELDS, buckets=4)
    index.build(spark.createDataFrame(ROWS, COLUMNS))
    shuffles = {table: plan.split("== Initial Plan ==")[0].count("Exchange") for table, plan in plans}
    assert shuffles == {"postings": 1, "lengths": 0}
    assert index.versions.read("lengths").count() == 6 and index.versions.read("postings").where("token IS NULL").count() == 6


def test_a_large_language_arrives_in_several_tasks(spark, sf, tmp_path, monkeypatch):
    """No task takes a whole language, and more files don't make more batches."""
    spark.read.parquet(f"{sf}/documents.parquet").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    made, batches, merge = [], [], SearchIndex.merge
    monkeypatch.setattr(files, "scratch", lambda s, name: made.append(f"{tmp_path}/{name}") or made[-1])
    monkeypatch.setattr(SearchIndex, "merge", lambda self, *a: (batches.append(1), merge(self, *a))[1])
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200000")
    try:
        assert catalogue.index_stream_search(spark, str(tmp_path)).count() == 20
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    parts = spark.read.parquet(made[0]).select("lang", F.input_file_name().alias("f")).distinct().groupBy("lang").count().collect()
    assert max(r["count"] for r in parts) > 1 and len(batches) <= 3
