import tempfile

import pytest
from pyspark.sql import types as T

from threadline.schemas import coded_schema
from threadline.session import checkpoint_root
from threadline.sources import posts as P


def coded(spark, text):
    path = tempfile.mkdtemp(prefix="threadline-coded-") + "/coded.csv"
    with open(path, "w") as f:
        f.write(text)
    return P.read_coded(spark, [path], coded_schema(["index", "text", "sentiment", "political"]))[0]


def test_coded_files_with_decimals(spark):
    rows = coded(spark, 'index,text,sentiment,political\n12.0,"a ""b"",\nc",-1.0,\n,x,1,0.0\n1.2345678E7,y, ,1\n')
    assert [tuple(r) for r in rows.collect()] == [(12, 'a "b",\nc', -1, None), (None, "x", 1, 0), (12345678, "y", None, 1)]
    assert rows.schema["sentiment"].dataType == T.IntegerType()


@pytest.mark.parametrize("cell", ["1.5", "yes"])
def test_coded_files_with_other_values_raise(spark, cell):
    with pytest.raises(Exception, match="no whole number"):
        coded(spark, f"index,text,sentiment,political\n1,x,{cell},0\n").collect()


def test_predictions_are_stored_by_target(spark):
    path = tempfile.mkdtemp(prefix="threadline-pred-") + "/p"
    df = spark.createDataFrame([("k", "a", 1), ("k", "b", 0)], "row_key string, target string, pred int")
    P.write_predictions(df, path)
    assert [r.pred for r in P.read_predictions(spark, path, "b").collect()] == [0]
    assert P.read_predictions(spark, path).count() == 2


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}
    with pytest.raises(RuntimeError):
        checkpoint_root(Session())
