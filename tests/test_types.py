"""Column types of every registered query equal those of its DuckDB SQL.

The value comparison canonicalises numbers, so an int/bigint drift (for
example a schema that depends on the data) would pass it; this test does not
let it.
"""

import pytest

from conftest import SF_SMALL
from oracle_compare import duck
from runlens.plans.oracle import ORACLE
from runlens.plans.registry import QUERIES

SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "smallint": "SMALLINT", "string": "VARCHAR",
                 "double": "DOUBLE", "float": "FLOAT", "boolean": "BOOLEAN", "date": "DATE",
                 "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE"}


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_types_match_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    rel = con.sql(ORACLE[name])
    duck_types = dict(zip(rel.columns, (str(t) for t in rel.types)))
    for col, t in df.dtypes:
        assert SPARK_TO_DUCK.get(t, t.upper()) == duck_types[col], f"{name}.{col}: {t} vs {duck_types[col]}"
    spark.catalog.clearCache()
