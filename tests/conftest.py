import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from eventlab.session import build_session

    s = build_session("eventlab-tests", "*", shuffle_partitions=8)
    if not (s.conf.get("spark.checkpoint.dir", None) or s.sparkContext.getCheckpointDir()):
        path = tempfile.mkdtemp(prefix="eventlab-test-ckpt-")
        s.sparkContext.setCheckpointDir(path)
        s.conf.set("spark.checkpoint.dir", path)
    yield s
    s.stop()
