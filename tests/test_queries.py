"""Every registered query gives rows, and those of its SQL where it has any."""

import pytest

from folium.plans.catalogue import FLAGSHIP, QUERIES, SQL

from .conftest import rows_of

#: May be empty on the smallest tables.
SPARSE = {"p04_by_two_keys", "k33_retention"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, duck):
    got = QUERIES[name](spark, sf_dir).toPandas()
    if name in SQL:
        assert rows_of(got) == rows_of(duck(SQL[name], sf_dir))
    assert len(got) or name in SPARSE


def test_flagship_is_registered():
    assert FLAGSHIP in QUERIES and FLAGSHIP in SQL
