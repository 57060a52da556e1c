"""Every registered query against its DuckDB oracle on sf0.001."""

import pytest

import __spark_entry__ as E
from tools.oracle_check import check, duck

SF = "/root/testdata/sf0.001"
NAMES = sorted(n for n in E.queries() if n in E.oracle_sql() and not n.startswith("op"))  # those of llm are run in tests/llm


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["context_id", "chunk_no", "tokens", "file_tokens", "n_files", "is_last", "text", "chars"]
    assert df.where("text is null or chars <> length(text)").count() == 0 and df.count() > 20


def test_every_query_has_oracle_or_reason():
    qs, sq = E.queries(), E.oracle_sql()
    assert set(sq) <= set(qs)
    without = {n for n in qs if n not in sq}
    assert all(n == "pipeline" or n.startswith("op") for n in without), without


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    r = check(spark, con, name, E.queries()[name], E.oracle_sql().get(name), SF)
    assert r["status"] in ("ok", "no-oracle"), r
