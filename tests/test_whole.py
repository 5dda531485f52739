"""Queries over tables that reach beyond those of the test data."""

import pytest

from tidewright import catalog


@pytest.fixture
def run(spark, tmp_path):
    def go(name, table, rows, schema):
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/{table}.parquet")
        return sorted(tuple(r) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect())

    return go


def test_silences_after_the_usual_total(run):
    got = run("w17_complement_of_silences", "events", [(1, 10), (1, 300000), (1, 300001)], "user_id long, event_id long")
    assert got == [(1, 0.0, 100.5), (1, 103.5, 3000000.5), (1, 3000003.5, 3000010.5), (1, 3000013.5, 3000014.0)]


def test_times_of_100_hours_and_more(run):
    got = run("d01_subtitle_times", "events", [(1, 2.5), (400000, 0.25), (7, None)], "event_id long, value double")
    assert got == [(1, "00:00:03,500"), (400000, "111:06:40,250")]


def test_units_of_titles_with_grouped_digits(run):
    got = run("n04_visible_units", "aihot_24h", [(1, "1,000 cats"), (2, "two cats"), (3, None)], "api_index long, title string")
    assert got == [(1, 8), (2, 7)]
