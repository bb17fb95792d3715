"""CSV files written with doubled quotes are landed and counted as written."""

from sparkdesk.sources import files as Fi
from sparkdesk.streaming.landing import land_csv

ROWS = [(1, 'say "hi", \\ there'), (2, '"'), (3, "ends in \\"), (4, '\\"a", "b\\'), (5, "plain"), (6, 'two\n"lines", \\"')]


def landed(spark, path, rows, **options):
    Fi.write_csv(spark.createDataFrame(rows, "id long, text string").coalesce(1), f"{path}/inbox")
    land_csv(spark, f"{path}/inbox", "id long, text string", f"{path}/table", f"{path}/ckpt", **options)
    got = spark.read.parquet(f"{path}/table").orderBy("id").collect()
    assert all(r.source_file.startswith("part-") and r.source_file.endswith(".csv") for r in got)
    return [(r.id, r.text) for r in got]


def test_landing_reads_what_write_csv_writes(spark, tmp_path):
    assert landed(spark, tmp_path, ROWS[:5]) == ROWS[:5]


def test_landing_of_line_breaks(spark, tmp_path):
    assert landed(spark, tmp_path, ROWS, multiline=True) == ROWS


def test_dispatch_counts_quoted_rows(spark, tmp_path):
    rows = [(f'{t}\n"x"', i) for i, t in ROWS] + [('\\"\n', 7), ("a\\", 8), ('b\n"', 9)]
    Fi.write_csv(spark.createDataFrame(rows, "text string, id long").coalesce(1), f"{tmp_path}/in")
    assert [r.rows for r in Fi.dispatch(spark, f"{tmp_path}/in").collect() if r.kind == "csv"] == [len(rows)]
