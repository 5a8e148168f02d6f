import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerlake import schemas as S  # noqa: E402
from ledgerlake.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    ckpt = tempfile.mkdtemp(prefix="ledgerlake-test-ckpt-")
    s = build_session("local[4]", shuffle_partitions=4, extra={"spark.checkpoint.dir": ckpt})
    yield s
    s.stop()


def make(spark, table, rows):
    """A table frame from dicts (missing columns null)."""
    schema = S.TABLES[table]
    data = [tuple(r.get(f.name) for f in schema.fields) for r in rows]
    return spark.createDataFrame(data, schema)


def changes(spark, table, rows):
    """A change set from (seq, op, id, payload-dict) tuples."""
    schema = S.change_schema(table)
    pfields = S.payload_schema(table).fields
    data = [(seq, op, id_, None if p is None else tuple(p.get(f.name) for f in pfields)) for seq, op, id_, p in rows]
    return spark.createDataFrame(data, schema)
