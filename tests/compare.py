"""Run registered queries against their SQL in DuckDB: python tests/compare.py [folder] [name ...]"""

import glob
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(folder):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def rows_of(table, columns):
    def key(row):
        return tuple((v is None, str(v)) for v in row)

    data = table.select(sorted(columns)).to_pydict()
    return sorted(zip(*[data[c] for c in sorted(columns)]), key=key)


def compare(spark, con, folder, name, query):
    """(ok, message, rows)"""
    mine = query.build(spark, folder).toArrow()
    if query.sql is None:
        return mine.num_rows > 0, "rows only", mine.num_rows
    theirs = con.execute(query.sql).to_arrow_table()
    if sorted(mine.column_names) != sorted(theirs.column_names):
        return False, f"columns {mine.column_names} / {theirs.column_names}", mine.num_rows
    a, b = rows_of(mine, mine.column_names), rows_of(theirs, mine.column_names)
    if a != b:
        sa, sb = set(a), set(b)
        only_a, only_b = [r for r in a if r not in sb][:3], [r for r in b if r not in sa][:3]
        return False, f"{len(a)} / {len(b)} rows; {sorted(mine.column_names)}\n  spark {only_a}\n  sql   {only_b}", mine.num_rows
    return True, "match", mine.num_rows


def main():
    from __spark_entry__ import load_catalog
    from foliant.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session(master="local[8]", partitions=8, memory="12g")
    spark.sparkContext.setLogLevel("OFF")
    con, catalog = connect(folder), load_catalog()
    names = [n for n in catalog if not sys.argv[2:] or any(n.startswith(p) for p in sys.argv[2:])]
    bad = 0
    for name in names:
        start = time.time()
        try:
            ok, message, n = compare(spark, con, folder, name, catalog[name])
        except Exception as e:
            ok, message, n = False, f"{type(e).__name__}: {str(e)[:700]}", 0
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:34} {n:7} rows {time.time() - start:6.1f}s  {message}", flush=True)
    print(f"{len(names) - bad}/{len(names)} good")


if __name__ == "__main__":
    main()
