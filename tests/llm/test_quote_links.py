import duckdb

from propspark.llm.queries import ORACLE_SQL
from propspark.llm.quote_links import link_quotes

COLUMNS = ["conv_id", "thread", "depth", "turn", "reply_to", "n_quoted", "n_linked", "role", "text"]
ROWS = [
    (1, 0, "a", "Shall we meet on Monday?\nOr later?", 0),
    (1, 1, "b", "Ann wrote:\n> shall we  meet on MONDAY?\n\nYes, Monday.", 0),
    (1, 2, "c", "> Or later?\nLater is better.\n>", 0),
    (1, 3, "a", "Bob wrote:\n> > Shall we meet on Monday?\n> Yes, Monday.\nFine.", 0),
    (1, 4, "b", ">> Yes, Monday.\n> Fine.\n  \nThen\nMonday it is.\n\n", 0),
    (1, 5, "b", "> never said\n---\n> ---", 0),
    (2, 0, "a", "Fine.", 0),
    (2, 1, "a", "> Yes, Monday.\nWhat?", 0),
    (2, 1, "a", "> Yes, Monday.\nWhat?", 0),
    (3, 0, "a", None, 0),
    (3, 1, "a", "", 0),
    (None, 4, "a", "> Fine.", 0),
    (4, None, "a", "> Fine.\nx", 0),
]
SCHEMA = "conv_id long, turn long, role string, text string, thread int"


def test_threads_by_hand(spark):
    out = [tuple(r) for r in link_quotes(spark.createDataFrame(ROWS, SCHEMA)).collect()]
    by = {(r[0], r[3]): r for r in out}
    assert len(out) == len(ROWS)
    assert by[1, 1] == (1, 0, 1, 1, 0, 1, 1, "b", "Yes, Monday.")
    assert by[1, 2] == (1, 0, 1, 2, 0, 2, 1, "c", "Later is better.")
    assert by[1, 3] == (1, 0, 2, 3, 1, 2, 2, "a", "Fine.")
    assert by[1, 4] == (1, 0, 3, 4, 3, 2, 2, "b", "Then\nMonday it is.")
    assert by[1, 5] == (1, 5, 0, 5, None, 2, 0, "b", "---")
    assert by[2, 1] == (2, 1, 0, 1, None, 1, 0, "a", "What?") and by[3, 0][8] == ""
    assert by[None, 4][:2] == (None, 4) and by[4, None][1] is None
    at = {(r[0], r[3]): i for i, r in enumerate(out)}
    assert all(at[r[0], r[4]] < at[r[0], r[3]] for r in out if r[4] is not None)


def test_sql_gives_the_same(spark, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(f"{tmp_path}/c.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/c.parquet/*.parquet'")
    want = db.execute(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLE_SQL['op8_quote_links']})").fetchall()
    got = [tuple(r) for r in link_quotes(spark.createDataFrame(ROWS, SCHEMA)).collect()]
    assert sorted(want, key=repr) == sorted(got, key=repr)


def test_deep_chain_and_empty_table(spark):
    rows = [(9, i, "u", f"> line {i - 1}\nline {i}" if i else "line 0") for i in range(70)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert [(r.thread, r.depth) for r in link_quotes(df).collect()] == [(0, i) for i in range(70)]
    assert link_quotes(df.limit(0)).count() == 0
