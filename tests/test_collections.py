"""Collections in keyed state: what is held, when it expires, and that a restart forgets nothing."""

import tempfile

import pytest

from facetry.streaming.collections import held_collections

SCHEMA = "collection string, reference string, at timestamp"


@pytest.fixture
def store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def test_collections_expire(spark, store):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    told = []

    def upload(*rows):
        spark.createDataFrame(rows, "collection string, reference string, at string").selectExpr("collection", "reference", "timestamp(at) at").coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = held_collections(spark.readStream.schema(SCHEMA).parquet(f"{root}/in"), 60, "0 seconds")
        # Each upload is a run of its own: the state comes back from the checkpoint.
        query = stream.writeStream.foreachBatch(lambda df, _: told.extend(map(tuple, df.select("collection", "loaded", "members").collect()))).option("checkpointLocation", f"{root}/c").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(180)
        out = sorted(told)
        told.clear()
        return out

    day = "2024-01-01 00:"
    assert upload(("mine", "a", day + "00:00"), ("mine", "b", day + "00:10"), ("mine", "a", day + "00:20"), ("other", None, day + "00:05"), (None, "x", day + "00:05")) == [("mine", True, 2), ("other", True, 0)]
    # Within the minute since its last upload, mine lives on; other's minute has passed.
    assert upload(("mine", "c", day + "01:10")) == [("mine", True, 3), ("other", False, 0)]
    assert upload(("third", "z", day + "05:00")) == [("mine", False, 3), ("third", True, 1)]
    # Begun anew after it has expired.
    assert upload(("mine", "c", day + "05:10")) == [("mine", True, 1)]
