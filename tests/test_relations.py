"""Evidence of relations whose articles arrived at one time."""
import datetime as dt

from tests.compare import connect, differences
from tidewire.plans import catalog

DAY = dt.datetime(1995, 1, 1)


def test_of_equal_arrivals_the_later_article_is_evidence(spark, tmp_path):
    # article 2 has the larger id, article 1 the larger line number
    spark.createDataFrame([(1, 7, DAY), (2, 7, DAY)], "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz").write.parquet(f"{tmp_path}/orders.parquet")
    lines = "l_orderkey long, l_linenumber int, l_suppkey long, l_returnflag string"
    spark.createDataFrame([(1, 4, 3, "R"), (2, 1, 3, "R")], lines).write.parquet(f"{tmp_path}/lineitem.parquet")
    supplier = "s_suppkey long, s_name string, s_nationkey int"
    spark.createDataFrame([(3, "Supplier 3", 1)], supplier).write.parquet(f"{tmp_path}/supplier.parquet")
    con = connect(str(tmp_path))
    for name in ("relation_rollup", "relation_ends"):
        assert [r["evidence_article_id"] for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()] == [2]
        assert differences(spark, con, catalog.QUERIES[name], catalog.SQL[name], str(tmp_path))[-1]
