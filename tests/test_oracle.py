"""Every registered query against its SQL, on the smallest tables."""

import glob
import math
import os
from pathlib import Path

import duckdb
import pytest

from tidemark.plans import queries


def plain(v):
    if v is None or type(v).__name__ in ("NAType", "NaTType"):
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v + 0.0:.9g}"
    return str(v)


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        where = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{where}'")
    return con


#: Queries that SQL can't state, or not on whole tables in time, and the test that holds the whole result against a plain computation.
NAMED = {
    "rec_state_machine": "test_whole_jobs.py::test_positions_of_the_state_machine_by_plain_loops",
    "slv_blend": "test_forward.py::test_blend_steps_hold_the_weights_of_the_batch",
    "rsm_monte_carlo": "test_whole_jobs.py::test_monte_carlo_has_5000_paths",
    "stm_forward_blend": "test_forward.py::test_blend_steps_hold_the_weights_of_the_batch",
    "stm_forward_coins": "test_forward.py::test_core_of_coins_by_plain_loops",
    "vld_gauntlet_whole": "test_gauntlet.py::test_stages_are_kept_and_later_ones_read_survivors_only",
    "pip_admission": "test_versions_and_batches.py::test_admission_in_order_as_by_plain_arithmetic",
}


def test_every_query_has_sql_or_a_test_of_its_own():
    assert set(queries.QUERIES) - set(queries.ORACLE_SQL) == set(NAMED)
    for where in NAMED.values():
        file, name = where.split("::")
        assert f"def {name}(" in (Path(__file__).parent / file).read_text()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf_dir, duck, name):
    got = queries.QUERIES[name](spark, sf_dir).toPandas()
    if name not in queries.ORACLE_SQL:
        assert len(got)
        return
    want = duck.sql(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    rows = lambda df: sorted(([plain(v) for v in row] for row in df[columns].itertuples(index=False)), key=str)
    assert rows(got) == rows(want)


def test_flagship_has_a_query():
    assert queries.FLAGSHIP in queries.QUERIES
