"""A query against its SQL in DuckDB, on one folder of tables."""

from tests.compare import connect, rows_of


def compare(spark, folder, name):
    from foliant.llm.queries import ORACLE_SQL, QUERIES

    mine = QUERIES[name](spark, folder).toArrow()
    theirs = connect(folder).execute(ORACLE_SQL[name]).to_arrow_table()
    assert sorted(mine.column_names) == sorted(theirs.column_names)
    assert rows_of(mine, mine.column_names) == rows_of(theirs, mine.column_names)
    return mine.num_rows
