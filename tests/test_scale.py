"""Plans and partitions that must hold on large tables, seen on small ones."""

from pyspark.sql import functions as F

from tidemark.catalog import model_queries, source_queries
from tidemark.operators import joins
from tidemark.plans import compare, model, social
from tidemark.views import Views


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def customers(spark, path, rows):
    made = spark.range(rows).select(
        F.col("id").alias("c_custkey"), (F.col("id") % 25).cast("int").alias("c_nationkey"),
        F.lit("BUILDING").alias("c_mktsegment"), (F.col("id") % 7 - 3).cast("double").alias("c_acctbal"),
    )
    made.coalesce(1).write.parquet(f"{path}/customer.parquet")
    events = spark.range(rows).select(F.col("id").alias("event_id"), (F.col("id") % 50).alias("user_id"))
    events.coalesce(1).write.parquet(f"{path}/events.parquet")
    return Views(spark, str(path))


def test_documents_and_fixes_of_one_row_group_come_in_several_tasks(spark, tmp_path):
    v = customers(spark, tmp_path, 2_000)
    assert model_queries.documents_json(v).rdd.getNumPartitions() > 1
    assert model_queries.fixes(v).rdd.getNumPartitions() > 1
    assert model_queries.documents_json(v).select("model_id").distinct().count() == 2_000


def test_documents_are_not_parsed_ahead_of_their_spread(spark, tmp_path):
    v = customers(spark, tmp_path, 2_000)
    plan = plan_of(model.explode_model(model_queries.documents(v))["tables"])
    assert "RoundRobinPartitioning" in plan and "from_json" not in plan.split("RoundRobinPartitioning")[1]


def test_documents_are_not_broadcast(spark, tmp_path):
    v = customers(spark, tmp_path, 30)
    docs = model_queries.stored_documents(v)
    relations, report = model.apply_plan(docs, model_queries.fixes(v))
    written = model.to_documents(relations, docs)
    for df in (written, report, model_queries.l01_round_trip(v), model_queries.l01_text_round_trip(v)):
        assert "BroadcastHashJoin" not in plan_of(df)
    assert model_queries.l01_round_trip(v).filter("same").count() == 30


def test_facts_are_not_sorted_by_a_key_of_few_values(spark):
    review = spark.range(100).select(
        (F.col("id") % 3).alias("app_id"), (F.col("id") % 2 == 0).alias("voted_up"), F.col("id").alias("votes_up"),
        F.lit(0.5).alias("weighted_vote_score"),
    )
    apps = joins.literal_dim(spark, "app_id bigint", [(0,), (1,)])
    mix = social.review_sentiment(review, apps)
    assert "SortMergeJoin" not in plan_of(mix) and "BroadcastHashJoin" in plan_of(mix)
    assert {r.sentiment: r.review_count for r in mix.collect()} == {"positive": 33, "negative": 34}


def test_literal_rows_keep_types_nulls_and_may_be_none(spark):
    df = joins.literal_dim(spark, "a bigint, b string", [(1, "x"), (None, None), (1, "x")])
    assert df.dtypes == [("a", "bigint"), ("b", "string")]
    assert sorted(map(tuple, df.collect()), key=str) == [(1, "x"), (1, "x"), (None, None)]
    assert joins.literal_dim(spark, "a bigint", []).collect() == []


def test_met_rows_do_not_travel_through_the_other_grids(spark):
    rows = spark.createDataFrame(
        [("p", bytes([g]), b"k", b"t", 1.0 * g, 1, 0) for g in range(9)] + [("p", bytes([g]), b"l", b"t", 1.0 * g, 0, 1) for g in range(8)],
        "pair_id string, k0 binary, k1 binary, text_key binary, v0 double, e bigint, a bigint",
    )
    left = compare._met_on(rows, "pair_id", "k0", ["k0", "k1"], ["text_key", "v0"])
    assert [(r.e, r.a, r.v0) for r in left.collect()] == [(1, 0, 8.0)]
    assert [(r.pair_id, r.unmet) for r in compare._met_near(left, "pair_id", ["v0"], compare.Leniency()).collect()] == [("p", 1)]


def test_texts_of_a_kind_are_cut_into_bounded_files(spark, tmp_path):
    part = spark.range(5_000).select(
        F.col("id").alias("p_partkey"), F.lit("TIN").alias("p_type"), F.lit("a b").alias("p_name"), F.lit("Brand#1").alias("p_brand"),
        (F.col("id") % 50).cast("int").alias("p_size"),
    )
    part.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    counted = source_queries.a03(Views(spark, str(tmp_path)))
    assert len(counted.inputFiles()) >= 3
    assert [tuple(r) for r in counted.collect()] == [("TIN", 10_000)]
