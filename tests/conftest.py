import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tallymark.session import build_session

    root = tmp_path_factory.mktemp("spark")
    session = build_session(
        "tests", "local[8]", spark__sql__shuffle__partitions="2", spark__default__parallelism="2",
        spark__ui__enabled="false", spark__driver__memory="6g",
        spark__sql__warehouse__dir=str(root / "warehouse"), spark__checkpoint__dir=str(root / "shared"),
    )
    session.sparkContext.setLogLevel("ERROR")
    # Tiny tables: compiling each stage would take longer than running it. The query tests turn it on.
    session.conf.set("spark.sql.codegen.wholeStage", "false")
    session.conf.set("spark.sql.codegen.factoryMode", "NO_CODEGEN")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return FOLDER
