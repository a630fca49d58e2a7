"""Address functions on nulls and edges, and the scratch folder."""

import pytest
from pyspark.sql import functions as F

from netlattice.functions import ip
from netlattice.sources import scratch
from netlattice.sources.sinks import with_witness


def test_null_addresses_stay_null(spark):
    rows = spark.createDataFrame([(0, 0), (None, 8), ((1 << 32) - 1, None)], "ip long, width int")
    found = rows.select(ip.long_to_ip(F.col("ip")), ip.prefix_text(F.col("ip"), F.col("width"))).collect()
    assert [tuple(r) for r in found] == [("0.0.0.0", "0.0.0.0/0"), (None, None), ("255.255.255.255", None)]


def test_witness_of_unsat_is_null(spark):
    rows = spark.createDataFrame([("unsat", None), ("sat", 167772161)], "verdict string, witness_lo long")
    assert [r["witness"] for r in with_witness(rows).collect()] == [None, "10.0.0.1"]


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Session:
        conf = type("Conf", (), {"get": staticmethod(lambda *_: None), "set": staticmethod(lambda *_: None)})
        sparkContext = type("Context", (), {"master": "spark://somewhere:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.scratch_root(Session)
    Session.sparkContext.master = "local[2]"
    assert scratch.scratch_root(Session).startswith("file:///")
