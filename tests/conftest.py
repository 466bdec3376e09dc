import os
import shutil
import tempfile

import pytest


@pytest.fixture(scope="session")
def spark():
    from lotwise.session import session

    folder = tempfile.mkdtemp(prefix="spark-")
    s = session(f"local[{os.environ.get('TEST_CPUS', '8')}]", 8, spark__ui__enabled="false", spark__driver__memory="4g", spark__checkpoint__dir=folder, spark__ui__showConsoleProgress="false")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
    shutil.rmtree(folder, ignore_errors=True)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
