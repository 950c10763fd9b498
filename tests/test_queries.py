"""Every query with SQL equals it on the smallest scale; all others return rows."""

import check
import pytest
from conftest import SMALL

import __spark_entry__ as registry


@pytest.fixture(scope="module")
def duck():
    return check.connect(SMALL)


@pytest.mark.parametrize("name", registry.queries())
def test_query(spark, duck, name):
    status, rows, _, detail = check.compare(spark, duck, name, SMALL)
    assert status in ("ok", "rows"), f"{status}: {detail}"
    if name not in ("a02_scan_panelists", "k09_drift_stream"):
        assert rows > 0


def test_direction_of_a_household_without_purchases(spark, tmp_path):
    import os

    import pyarrow as pa
    import pyarrow.parquet as pq

    for name in os.listdir(SMALL):
        os.symlink(f"{SMALL}/{name}", tmp_path / name)
    rows = pq.read_table(f"{SMALL}/customer.parquet")
    extra = rows.slice(0, 1).set_column(
        rows.schema.get_field_index("c_custkey"), rows.schema.field("c_custkey"), [[10_000_000]]
    )
    os.unlink(tmp_path / "customer.parquet")
    pq.write_table(pa.concat_tables([rows, extra]), tmp_path / "customer.parquet")
    status, _, _, detail = check.compare(spark, check.connect(str(tmp_path)), "m04_l2_normalize", str(tmp_path))
    assert status == "ok", detail


def test_sql_only_for_known_queries():
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert registry.entry.__doc__
