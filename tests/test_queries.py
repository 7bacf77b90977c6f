"""Every registered query against DuckDB on the same tables."""

import math

import duckdb
import pytest

from palimpsest.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return db


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value.isoformat() if hasattr(value, "isoformat") else value


def tidy(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, oracle, name):
    found = registry.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in found.collect()]
    if name not in registry.ORACLES:
        assert rows
        return
    cursor = oracle.execute(registry.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(found.columns)
    assert tidy(rows, found.columns) == tidy(cursor.fetchall(), columns)


def test_flagship(spark):
    assert registry.flagship(spark, SF).count() > 0


def test_fixture_has_the_measured_sizes(spark):
    from palimpsest.operators import diff, log, merge

    made = log.fixture(spark, SF)
    assert made.members.filter("commit_id <> 'X13'").count() == 805
    kinds = {r[0]: r[1] for r in diff.diff(made, "M10", "M13").groupBy("diff_type").count().collect()}
    assert kinds == {"added": 1, "modified": 32, "removed": 5}
    actions = {r[0]: r[1] for r in merge.merge_plan(made, "M10", "M13", "D13").groupBy("action").count().collect()}
    assert actions == {"pick": 22, "conflict": 22, "keep": 16}


def test_pruning_changes_nothing(spark):
    from palimpsest.operators import diff, log

    made = log.fixture(spark, SF)
    for a, b in (("M10", "M13"), ("D13", "M20")):
        assert sorted(diff.diff(made, a, b).collect(), key=repr) == sorted(diff.diff(made, a, b, prune=False).collect(), key=repr)
