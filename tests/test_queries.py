import pytest
from oracle import compare, database

from lodestone.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return database(SF)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, db, name):
    frame = registry.QUERIES[name](spark, SF)
    if name in registry.SQL:
        compare(frame, db, registry.SQL[name])
    else:
        rows, again = (sorted(map(repr, f.collect())) for f in (frame, registry.QUERIES[name](spark, SF)))
        assert rows and rows == again  # its operators have tests of their own
