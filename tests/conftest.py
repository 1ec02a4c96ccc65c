import pytest

from quotaflow.session import local_session

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, **{"spark.sql.streaming.stateStore.providerClass": ROCKSDB})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
