import pytest
from oracle import compare, connect

import __spark_entry__

SF = "/root/testdata/sf0.001"
QUERIES, SQL = __spark_entry__.queries(), __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def db():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, db, name):
    assert compare(QUERIES[name](spark, SF), db, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in SQL and not n.startswith(("op", "pipeline"))))
def test_query_without_sql_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns
    df.write.format("noop").mode("overwrite").save()


def test_entry_gives_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["c03_context_block", "c05_game_context", "c08_starter_decisions", "c09_basketball_set", "c10_shot_profile", "e01_normalize_name", "e02_match_unique", "p02_safe_casts", "p13_text_flags", "s04_flatten_json", "s11_new_only", "w18_topk_available", "w24_drawdown", "x07_settle"])
def test_inputs_tell_results_apart(db, name):
    """Every column of the result takes two values at least."""
    found = db.execute(SQL[name]).fetchdf()
    assert len(found) > 1 and (found.nunique(dropna=False) > 1).all()
