"""Operators that send counted tables to all executors give the same where the tables are beyond the bound, also with a hot text."""

import pytest
from pyspark.sql import functions as F

from packlens.llm import common, ngram_join, quality, suffix_dedup, url_filter
from packlens.llm.queries import URL_RULES


@pytest.fixture
def beyond(spark, monkeypatch):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")

    def go():
        monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")

    yield go
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.fixture(scope="module")
def hot(spark, odd):
    """A third of the rows have one text."""
    line = "all rights reserved by everyone here\n"
    rows = odd.withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(line), "text")).otherwise(F.col("text")))
    copies = rows.where("doc_id = 3").withColumn("doc_id", F.explode(F.sequence(F.lit(1000), F.lit(1030))))
    return rows.unionByName(copies).repartition(4).cache()


def same(beyond, run):
    first = sorted(map(repr, run().collect()))
    beyond()
    df = run()
    assert sorted(map(repr, df.collect())) == first and first


def test_quality(beyond, hot):
    same(beyond, lambda: quality.judge(hot, quality.Limits(5, 8)).drop("_q_gone"))


def test_repeats(beyond, hot):
    same(beyond, lambda: suffix_dedup.remove(hot.select("doc_id", "text"), batches=2))


def test_near_copies(beyond, hot):
    same(beyond, lambda: ngram_join.keep_one(hot))


def test_urls(spark, beyond):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    urls = spark.createDataFrame([(i, f"http://a{i % 3}.example.com/en/{i % 5}") for i in range(40)] + [(99, None)], "page_id int, url string")
    same(beyond, lambda: url_filter.filter_urls(urls, rules))


def test_a_cluster_must_name_its_folder(spark, monkeypatch):
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda *a: None)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session)
