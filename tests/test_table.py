"""Keyed table work, sessions and streams."""

import pytest
from pyspark.sql import functions as F

from stayrate import session
from stayrate.operators import scoring, table
from stayrate.schema import ACCOUNT_COLUMNS
from stayrate.sources import files
from stayrate.sources.accounts import load_accounts
from stayrate.streaming import accounts as streams

SCHEMA = "customerID string, Contract string, tenure int, arrival int"


@pytest.fixture
def incoming(spark):
    return spark.createDataFrame(
        [
            ("a", "One year", 1, 2),
            ("a", "Two year", 9, 1),
            ("b", "One year", 2, 3),
            (None, "One year", 3, 4),
        ],
        SCHEMA,
    )


def test_ingest_counts_and_first_row_wins(spark, incoming, tmp_path):
    path = str(tmp_path / "accounts")
    assert table.ingest_accounts(incoming, path, "arrival") == (2, 2)
    assert table.ingest_accounts(incoming, path, "arrival") == (0, 4)
    more = spark.createDataFrame([("b", "x", 1, 1), ("c", "x", 1, 1)], SCHEMA)
    assert table.ingest_accounts(more, path, "arrival") == (1, 1)
    rows = {r["customerID"]: r for r in files.scan_all(spark, path).collect()}
    assert set(rows) == {"a", "b", "c"}
    assert rows["a"]["Contract"] == "Two year" and rows["a"]["created_at"] is not None


def test_ingest_counts_row(spark, incoming):
    row = table.ingest_counts(incoming, incoming.where("customerID = 'b'"), "arrival").first()
    assert (row["inserted"], row["failed"]) == (1, 3)


def test_small_and_large_ingests_agree(spark, incoming):
    stored = incoming.where("customerID = 'b'")
    few = table.new_accounts(incoming, stored, "arrival").collect()
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert table.new_accounts(incoming, stored, "arrival").collect() == few
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_ingest_counts_only_its_own_rows(spark, incoming, tmp_path, monkeypatch):
    path = str(tmp_path / "accounts")
    table.ingest_accounts(incoming, path, "arrival")
    other = spark.createDataFrame([("z", "x", 1, 1)], SCHEMA)
    stored = table.stored_accounts

    def meanwhile(session, at):
        found = stored(session, at)
        table.with_stamps(other.drop("arrival")).write.mode("append").parquet(at)
        return found

    monkeypatch.setattr(table, "stored_accounts", meanwhile)
    more = spark.createDataFrame([("b", "x", 1, 1), ("c", "x", 1, 1)], SCHEMA)
    assert table.ingest_accounts(more, path, "arrival") == (1, 1)
    assert spark.read.parquet(path).count() == 4


def test_update_sets_fields_to_null(spark):
    df = spark.createDataFrame(
        [("a", "x", 1), ("b", "y", 2), ("c", "z", 3)], "customerID string, Contract string, tenure int"
    )
    updates = spark.createDataFrame(
        [
            ("a", 1, "new", None, ["Contract"]),
            ("a", 2, None, 7, ["Contract", "tenure"]),
            ("b", 1, None, None, ["tenure"]),
            ("b", 2, "kept out", 9, []),
            ("c", 1, None, 5, None),
        ],
        "customerID string, at int, Contract string, tenure int, given array<string>",
    )
    found = table.update_accounts(df, updates, "at", supplied="given").orderBy("customerID")
    assert [tuple(r) for r in found.collect()] == [("a", None, 7), ("b", "y", None), ("c", "z", 3)]


def test_lookup(incoming):
    assert table.lookup_account(incoming, "b").count() == 1
    assert table.lookup_account(incoming, "zz").count() == 0


def test_filter(incoming):
    assert table.filter_accounts(incoming, {"Contract": "One year", "tenure": 2}).count() == 1
    assert table.filter_accounts(incoming, {"customerID": None}).count() == 0
    with pytest.raises(ValueError, match="nothing"):
        table.filter_accounts(incoming, {"nothing": 1})


def test_updates(spark):
    stored = table.with_stamps(
        spark.createDataFrame(
            [("a", "x", 1), ("b", "y", 2)], "customerID string, Contract string, tenure int"
        ),
        F.lit("2020-01-01").cast("timestamp"),
    )
    updates = spark.createDataFrame(
        [("a", "new", None, 2), ("a", "old", 7, 1), ("zz", "x", 1, 1)],
        "customerID string, Contract string, tenure int, seq int",
    )
    rows = {r["customerID"]: r for r in table.update_accounts(stored, updates, "seq").collect()}
    assert (rows["a"]["Contract"], rows["a"]["tenure"]) == ("new", 7)
    assert rows["a"]["updated_at"] > rows["a"]["created_at"]
    assert rows["b"]["updated_at"] == rows["b"]["created_at"] and rows["b"]["Contract"] == "y"
    assert [r[0] for r in table.unknown_keys(stored, updates).collect()] == ["zz"]


def test_delete(spark, incoming):
    keys = spark.createDataFrame([("a",), ("a",), ("zz",)], "customerID string")
    left = table.delete_accounts(incoming, keys)
    assert sorted(str(r["customerID"]) for r in left.collect()) == ["None", "b"]


def test_export(spark, incoming, tmp_path):
    path = tmp_path / "none"
    assert not table.export_csv(incoming, str(path), {"Contract": "absent"})
    assert not path.exists()
    assert table.export_csv(incoming, str(path), {"Contract": "One year"})
    assert spark.read.option("header", True).csv(str(path)).count() == 3


def test_parameters_of_free_sql(spark, incoming):
    query = "SELECT customerID FROM t WHERE tenure > ? AND Contract = ?"
    rows = files.run_sql(spark, query, [1, "One year"], {"t": incoming})
    assert sorted(str(r[0]) for r in rows.collect()) == ["None", "b"]


def test_latest_prediction(spark):
    rows = spark.createDataFrame(
        [("a", 0.1, "2024-01-01"), ("a", 0.9, "2024-03-01"), ("b", 0.5, "2024-02-01")],
        "customer_id string, churn_probability double, ts string",
    ).select("customer_id", "churn_probability", F.col("ts").cast("timestamp").alias("timestamp"))
    latest = scoring.latest_prediction(rows)
    assert {r[0]: r[1] for r in latest.collect()} == {"a": 0.9, "b": 0.5}


def test_predictions_append(spark, small, tmp_path):
    path = str(tmp_path / "predictions")
    predictions = scoring.score_batch(load_accounts(spark, small), scoring.scorecard)
    files.append_predictions(predictions, path)
    files.append_predictions(predictions, path)
    stored = spark.read.parquet(path)
    assert stored.count() == 300
    assert scoring.latest_prediction(stored).count() == 150


def test_shared_dir_follows_the_session(spark, monkeypatch):
    class Conf:
        @staticmethod
        def get(name, default=None):
            return "/shared/place/" if name == "spark.checkpoint.dir" else default

    class Session:
        conf = Conf()
        sparkContext = spark.sparkContext

    assert session.shared_dir(Session()).startswith("/shared/place/")
    assert session.shared_dir(spark) != session.shared_dir(spark)


def test_shared_dir_must_be_set_on_a_cluster():
    class Context:
        master = "yarn"

        @staticmethod
        def getConf():
            return {}

    class Session:
        conf = {}
        sparkContext = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())


# --- streams --------------------------------------------------------------


def _source(df, path):
    files.write_csv(df.repartition(5), path)
    return path


def test_streamed_scores_equal_batch_scores(spark, small, tmp_path):
    accounts = load_accounts(spark, small)
    text = accounts.select(*[F.col(c).cast("string") for c in ACCOUNT_COLUMNS])
    bad = text.limit(3).withColumn("MonthlyCharges", F.lit("abc"))
    source = _source(text.unionByName(bad), str(tmp_path / "in"))
    target, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    query = streams.stream_score(
        streams.read_accounts(spark, source, 2), scoring.scorecard, target, checkpoint
    )
    query.awaitTermination()
    streamed = spark.read.parquet(target)
    assert streamed.select("batch").distinct().count() == 3
    wanted = scoring.score_batch(accounts, scoring.scorecard)
    assert sorted(streamed.drop("timestamp", "batch").collect()) == sorted(wanted.collect())
    rejected = spark.read.parquet(f"{target}_rejected")
    assert rejected.count() == 3 and "customerID" in rejected.columns
    # A fresh checkpoint adds to the target and replaces nothing there.
    streams.stream_score(
        streams.read_accounts(spark, source), scoring.scorecard, target, f"{checkpoint}-2"
    ).awaitTermination()
    assert spark.read.parquet(target).count() == 2 * wanted.count()


def test_streamed_inserts_are_unique_and_replayable(spark, small, tmp_path):
    accounts = load_accounts(spark, small).withColumn("arrival", F.lit(1))
    source = str(tmp_path / "in")
    accounts.unionByName(accounts).repartition(6).write.parquet(source)
    target = str(tmp_path / "out")
    reader = spark.readStream.schema(accounts.schema).option("maxFilesPerTrigger", 2)
    arriving = reader.parquet(source)
    for run in ("one", "two"):
        # A second run from a fresh checkpoint repeats the batch numbers.
        streams.stream_ingest(arriving, "arrival", target, str(tmp_path / run)).awaitTermination()
        stored = spark.read.parquet(target)
        assert stored.count() == stored.select("customerID").distinct().count() == 150


def test_streamed_inserts_join_an_ingested_table(spark, small, tmp_path):
    accounts = load_accounts(spark, small).withColumn("arrival", F.lit(1))
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    accounts.write.parquet(source)
    table.ingest_accounts(accounts.limit(40), target, "arrival")
    arriving = spark.readStream.schema(accounts.schema).parquet(source)
    streams.stream_ingest(arriving, "arrival", target, str(tmp_path / "c")).awaitTermination()
    stored = spark.read.parquet(target)
    assert stored.count() == stored.select("customerID").distinct().count() == 150
    with pytest.raises(ValueError, match="tenure"):
        table.ingest_accounts(
            accounts.withColumn("tenure", F.lit("x")), target, "arrival"
        )


def test_csv_columns_are_taken_by_name(spark, small, tmp_path):
    accounts = load_accounts(spark, small)
    turned = accounts.select(F.lit("more").alias("extra"), *reversed(ACCOUNT_COLUMNS))
    path = files.write_csv(turned, str(tmp_path / "turned"))
    assert sorted(files.scan_csv(spark, path).collect()) == sorted(accounts.collect())
    streamed = streams.read_accounts(spark, path)
    assert streamed.columns == list(ACCOUNT_COLUMNS)
    short = files.write_csv(accounts.drop("tenure"), str(tmp_path / "short"))
    with pytest.raises(ValueError, match="tenure"):
        files.scan_csv(spark, short)
