from pyspark.sql import functions as F

from plotweave.operators import adjacency as A


def test_tables_by_one_key_meet_without_a_shuffle(spark):
    edges = spark.createDataFrame([(f"e{k}", f"n{k % 7}", "knows", f"n{k % 5}") for k in range(60)], "edge_id string, subject_id string, predicate string, object_id string")
    events = spark.range(50).select(F.col("id").cast("string").alias("event_id"), F.array(F.struct(F.concat(F.lit("n"), F.col("id") % 6).alias("entity_id"), F.lit("actor").alias("role"))).alias("participants"))
    ends, taking_part = A.adjacency(edges, buckets=4), A.roster(events, buckets=4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        both = A.activity(ends, taking_part)
        plan = both._jdf.queryExecution().executedPlan().toString()
        rows = {r["entity_id"]: (r["edges"], r["events"]) for r in both.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in plan
    want = {f"n{k}": sum((i % 7 == k) + (i % 5 == k and i % 7 != i % 5) for i in range(60)) for k in range(6)}
    assert rows == {k: (n, sum(i % 6 == int(k[1:]) for i in range(50))) for k, n in want.items()}
    one = A.neighbors_of(ends, spark.createDataFrame([("n6",)], "entity_id string")).collect()
    assert len(one) == sum(i % 7 == 6 for i in range(60)) and {r["direction"] for r in one} == {"outgoing"}
