import pytest

from lagwise.session import session


@pytest.fixture(scope="session")
def spark():
    s = session("tests", spark_master="local[4]", spark_sql_shuffle_partitions="4", spark_ui_enabled="false", spark_driver_memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    from lagwise.session import ship_code

    ship_code(s)
    return s
