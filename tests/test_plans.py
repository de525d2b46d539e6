"""Queries of the core against their SQL on the smallest driver tables."""

import math
from pathlib import Path

import pytest

from orbita.plans import archive, certplans, graphs, liftplans, moreplans, rollupplans, searchplans, sinkplans, wordplans

SF = Path("/root/testdata/sf0.001")


def _plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6)
    return tuple(map(_plain, x)) if isinstance(x, (list, tuple)) else x


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in SF.glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


MODULES = (archive, rollupplans, wordplans, sinkplans, certplans)
SOME = {graphs: ("features_4_2", "rules_4_1", "spread_sample_5_2"), liftplans: ("lift_witnesses_3_2", "slack_profile_3_2"), searchplans: ("probe_set_4_2", "screen_4_2", "certify_4_2"), moreplans: ("bounded_searches_4_2", "tree_boxes", "clause_domains_5", "next_islands")}
NAMES = [(m, n) for m in MODULES for n in sorted(m.SQL)] + [(m, n) for m, names in SOME.items() for n in names]


@pytest.mark.skipif(not SF.exists(), reason="no driver tables here")
@pytest.mark.parametrize("module,name", NAMES, ids=[n for _, n in NAMES])
def test_plan_equals_sql(spark, duck, module, name):
    df = module.QUERIES[name](spark, str(SF))
    want = duck.execute(module.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert _rows(df.columns, df.collect()) == _rows(names, want.fetchall())
