"""Export of what one user may read."""

import datetime as dt

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from hearthmark.plans import export

AT = dt.datetime(2024, 5, 6, 7, 8, 9, 123456)


@pytest.fixture
def tables(spark):
    def table(rows, schema):
        return spark.createDataFrame(rows, schema)

    return {
        "searches": table([(1, 1, False), (2, 2, True), (3, 2, False), (4, 3, False)], "search_id int, user_id int, is_public boolean"),
        "shares": table([(3, 2, 1), (4, 3, 9)], "search_id int, owner_id int, shared_with int"),
        "listings": table([(10, 1, 1, AT), (20, 2, 2, None), (30, 2, 3, AT), (40, 3, 4, AT), (50, 3, None, AT)], "id int, user_id int, search_id int, at timestamp_ntz"),
        "price_points": table([(10, 1, 5.5), (20, 2, None), (30, 2, 7.0), (40, 3, 8.0)], "listing_id int, user_id int, price double"),
        "edges": table([(10, 20, 1), (20, 30, 2), (30, 10, 2)], "a int, b int, user_id int"),
        "versions": table([(10, "a\n\"é"), (20, "b")], "listing_id int, body string"),
        "notifications": table([(1, 1), (2, 2)], "id int, user_id int"),
    }


def test_whole_export(tables, tmp_path, spark):
    export.export_tenant(tables, F.lit(1), str(tmp_path / "one"))
    found = export.read_export(spark, str(tmp_path / "one"))
    rows = {n: sorted(map(tuple, df.collect()), key=str) for n, df in found.items()}
    assert {n: df.columns for n, df in found.items()} == {n: df.columns for n, df in tables.items()}
    assert rows == {
        "searches": [(1, 1, False), (2, 2, True), (3, 2, False)],
        "shares": [(3, 2, 1)],
        "listings": [(10, 1, 1, AT), (20, 2, 2, None), (30, 2, 3, AT)],
        "price_points": [(10, 1, 5.5), (20, 2, None)],
        "edges": [(10, 20, 1), (20, 30, 2)],
        "versions": [(10, 'a\n"é')],
        "notifications": [(1, 1)],
    }


def test_nothing_readable(tables, tmp_path, spark):
    hidden = {n: df.where("search_id <> 2") if n == "searches" else df for n, df in tables.items()}
    export.export_tenant(hidden, F.lit(77), str(tmp_path / "none"))
    found = export.read_export(spark, str(tmp_path / "none"))
    assert sorted(found) == sorted(tables) and all(df.collect() == [] and df.dtypes == tables[n].dtypes for n, df in found.items())


def test_a_table_without_rule_is_refused(tables, spark):
    with pytest.raises(ValueError, match="secrets"):
        export.readable_tables({**tables, "secrets": spark.range(1)}, F.lit(1))


def test_rows_of_a_task_are_written_without_a_sort(tables, tmp_path, spark, monkeypatch):
    """The folders are written as rows come; the setting that allows it holds for that write only."""
    seen, before = [], spark.conf.get(export.WRITERS)
    text = DataFrameWriter.text
    monkeypatch.setattr(DataFrameWriter, "text", lambda self, path: (seen.append(int(spark.conf.get(export.WRITERS))), text(self, path))[1])
    export.export_tenant(tables, F.lit(1), str(tmp_path / "flat"))
    assert seen == [len(tables) + 1] and spark.conf.get(export.WRITERS) == before
    lines = sorted(p.parent.name for p in (tmp_path / "flat").glob("v=1/*/part-*"))
    assert set(lines) == {f"table={n}" for n in [*tables, export.CONTENTS]}
    assert export.read_export(spark, str(tmp_path / "flat"))["listings"].count() == 3
