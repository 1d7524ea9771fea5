from datetime import date

from pyspark.sql import functions as F

from factlens.functions import extract


def test_numbers_in_names_are_no_years(spark):
    """A part's, a lot's or a customer's number isn't a year; a year after a month, a quarter or by itself is one."""
    said = {
        "The Customer-1999 requires the Part-1907 Lot-3-1950 effective 1995-08-03 until 1997-05-28.": ["1995-08-03", "1997-05-28"],
        "Since Mid-2019 and Q3-2020, not Jan-2021; 2022-2023.": ["2019-01-01", "2020-01-01", "2021-01-01", "2022-01-01", "2023-01-01"],
    }
    rows = spark.createDataFrame([(x,) for x in said], "text string").select("text", extract.find_dates("text").alias("d"), extract.chunk_window("text").alias("w"))
    got = {r.text: r for r in rows.collect()}
    for text, days in said.items():
        assert [str(x.day) for x in got[text].d] == days
        assert (str(got[text].w.start), str(got[text].w.end)) == (days[0], days[-1])
    frames = extract.relation_frames(rows.select("text", F.lit(1).alias("id")), ["id"]).where("predicate = 'requires'").collect()
    assert [(r.valid_from, r.valid_until) for r in frames] == [(date(1995, 8, 3), date(1997, 5, 28))]
