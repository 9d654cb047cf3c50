"""Tables of a ledger before their first row."""
from tidewire.streaming import tick
from tidewire.streaming.ledger import Ledger


def test_a_table_without_rows_needs_no_python_tasks(spark, tmp_path):
    tables = tick.tables()
    ledger = Ledger(spark, f"file://{tmp_path}", tables)
    for name, spec in tables.items():
        empty = ledger.table(name)
        assert empty.schema == spark.createDataFrame([], spec.schema).schema and empty.collect() == []
        assert "ExistingRDD" not in empty._jdf.queryExecution().toString()
