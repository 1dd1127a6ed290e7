"""Tables of a relational catalogue through a JDBC driver: the database that Spark itself brings, in memory."""

from pyspark.sql import functions as F

from weftline.operators import catalog
from weftline.sources import readers

DRIVER = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


def _written(spark, name, rows):
    url = "jdbc:derby:memory:weftline;create=true"
    kinds = ", ".join(f"{f.name} VARCHAR(20)" for f in rows.schema.fields if f.dataType.typeName() == "string")
    made = {"createTableColumnTypes": kinds} if kinds else {}
    rows.write.format("jdbc").options(url=url, dbtable=name, **made, **DRIVER).mode("overwrite").save()
    return url


def test_ranges_filters_and_columns_reach_the_database(spark):
    rows = spark.range(1, 1001).selectExpr("id AS QUEUE_ID", "id % 7 AS DATASET_ID", "CASE WHEN id % 3 = 0 THEN 'pending' ELSE 'done' END AS STATUS", "CASE WHEN id % 5 > 0 THEN id END AS PARENT")
    url = _written(spark, "QUEUE", rows)
    table = readers.catalogue(spark, url, "QUEUE", "QUEUE_ID", 1, 1000, partitions=5, **DRIVER)
    assert table.rdd.getNumPartitions() == 5
    assert sorted(map(tuple, table.collect())) == sorted(map(tuple, rows.collect()))
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    try:
        found = table.where("STATUS = 'pending' AND PARENT IS NULL AND QUEUE_ID > 500").select("QUEUE_ID")
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    for part in ("*EqualTo(STATUS,pending)", "*IsNull(PARENT)", "*GreaterThan(QUEUE_ID,500)"):
        assert part in plan, plan
    # All is done by the database: Spark filters nothing again, and other columns stay there.
    assert "Filter" not in plan.replace("PushedFilters", "") and "DATASET_ID" not in plan
    assert sorted(r[0] for r in found.collect()) == [i for i in range(501, 1001) if i % 3 == 0 and i % 5 == 0]


def test_rows_outside_the_bounds_and_without_a_key_are_read(spark):
    rows = spark.range(50).selectExpr("CASE WHEN id % 10 > 0 THEN id END AS K", "id AS V")
    url = _written(spark, "LOOSE", rows)
    got = readers.catalogue(spark, url, "LOOSE", "K", 20, 30, partitions=3, **DRIVER)
    assert sorted(r["V"] for r in got.collect()) == list(range(50))


def test_reports_run_on_such_a_table(spark):
    rows = spark.range(1, 301).selectExpr("id AS QUEUE_ID", "id % 11 AS DATASET_ID", "CASE WHEN id % 4 = 0 THEN 'pending' ELSE 'done' END AS STATUS")
    url = _written(spark, "TODO", rows)
    table = readers.catalogue(spark, url, "TODO", "QUEUE_ID", 1, 300, **DRIVER).select(*(F.col(c).alias(c.lower()) for c in ("QUEUE_ID", "DATASET_ID", "STATUS")))
    assert [r[0] for r in catalog.next_datasets(table, "pending", 5).collect()] == [0, 1, 2, 3, 4]


def test_requests_for_a_refresh(spark):
    datasets = spark.createDataFrame([(1, "u1", False, "k1", True), (2, "u1", True, "k2", True), (3, "u2", None, None, True), (4, None, False, "k4", None)], "dataset_id long, user_id string, is_frozen boolean, ping_key string, nightly boolean")
    users = spark.createDataFrame([("u1", "starter"), ("u2", "free")], "user_id string, plan string")
    asked = spark.createDataFrame([(1, "u1", 1), (2, "u2", 1), (3, "u1", 2), (4, "u1", 9), (5, "u1", None), (6, None, 4), (7, "u1", 1)], "request_id long, user_id string, dataset_id long")
    got = {r["request_id"]: (r["status"], r["error"]) for r in catalog.asked_by_users(asked, datasets).collect()}
    queued, refused = ("queued", None), lambda why: ("error", why)
    assert got == {1: queued, 2: refused("forbidden"), 3: refused("dataset is frozen"), 4: refused("not found"), 5: refused("not found"), 6: queued, 7: queued}
    pings = spark.createDataFrame([(1, "k1"), (2, "k2"), (3, None), (4, "k4"), (5, "x")], "request_id long, ping_key string")
    got = {r["request_id"]: (r["dataset_id"], r["error"]) for r in catalog.pinged(pings, datasets, users).collect()}
    assert got == {1: (1, None), 2: (None, "dataset is frozen"), 3: (None, "invalid ping key"), 4: (None, "plan"), 5: (None, "invalid ping key")}
    assert sorted(r[0] for r in catalog.nightly(datasets).collect()) == [1, 3]
    empty = datasets.limit(0)
    assert catalog.asked_by_users(asked, empty).where("status = 'queued'").count() == 0 and catalog.nightly(empty).count() == 0
