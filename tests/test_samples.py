"""Two sample flows end to end: school ratings from CSV, population from a workbook."""

from pyspark.sql import functions as F

from layerkit.operators.project import case
from layerkit.operators.recipe import run_recipe
from layerkit.sources.readers import read_csv, read_csv_skip
from layerkit.sources.workbooks import read_workbooks
from tests.workbook import write_workbook


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


def test_school_ratings(spark, tmp_path):
    (tmp_path / "schools.csv").write_text(
        "URN,SCHNAME,TOWN,POSTCODE,PHASE\n100,Abbey,Leeds,L1,P\n101,Beech,Leeds,L2,S\n102,Cedar,York,Y1,P\n"
        "103,Dale,York,Y2,S\nbad,Elm,Hull,H1,P\n104,Fern,Hull,H2,S\n"
    )
    (tmp_path / "ratings.csv").write_text(
        "URN,Rating\n100,Outstanding\n101,Good\n102,Requires improvement\n103,Closed\n104,\n104,Good\nzz,Good\n"
    )
    text = lambda name: read_csv_skip(spark, str(tmp_path), 0, glob=name)
    rating = F.col("Rating Name")
    out = run_recipe(
        text("schools.csv"),
        [
            ("rename", {"pairs": {"URN": "School ID", "SCHNAME": "School Name"}}),
            ("change_types", {"types": {"School ID": "Int64.Type", "School Name": "type text"}, "on_error": "null"}),
            ("join", {"right": text("ratings.csv"), "left_keys": "School ID", "right_keys": "URN",
                      "kind": "JoinKind.LeftOuter", "expand": {"Rating": "Rating Name"}, "key_type": "bigint"}),
            ("add_column", {"name": "Rank", "value": case([
                (rating == "Outstanding", 1), (rating == "Good", 2), (rating == "Requires improvement", 3)])}),
            ("select_columns", {"names": ["School ID", "School Name", "Rating Name", "Rank"]}),
        ],
    )
    assert rows(out) == sorted([
        (100, "Abbey", "Outstanding", 1), (101, "Beech", "Good", 2), (102, "Cedar", "Requires improvement", 3),
        (103, "Dale", "Closed", None), (None, "Elm", None, None), (104, "Fern", None, None), (104, "Fern", "Good", 2),
    ], key=repr)


def test_population(spark, tmp_path):
    write_workbook(tmp_path / "population_2020.xlsx", {"Mid-2020 Persons": [
        ["Title"], [], ["Source"], [],
        ["LSOA Code", "LA Name", "0-15", "16-64"], ["E1", "Leeds", 10, 20], ["E2", "Hull", None, 5],
    ]})
    sheet = read_workbooks(spark, str(tmp_path), "Mid-2020 Persons", skip=4).drop("_source_file")
    estimates = run_recipe(sheet, [
        ("unpivot_other", {"keep": ["LSOA Code", "LA Name"], "name": "Age Group", "value": "Population"}),
        ("change_types", {"types": {"Population": "Int64.Type"}}),
    ])
    assert rows(estimates) == sorted([
        ("E1", "Leeds", "0-15", 10), ("E1", "Leeds", "16-64", 20), ("E2", "Hull", "0-15", None), ("E2", "Hull", "16-64", 5),
    ], key=repr)

    (tmp_path / "trend.csv").write_text("LSOA Code,LA Name,2019,2020\nE1,Leeds,29,30\n")
    trend = run_recipe(read_csv(spark, str(tmp_path / "trend.csv")), [
        ("unpivot_other", {"keep": ["LSOA Code", "LA Name"], "name": "Year", "value": "Value"}),
        ("rename", {"pairs": {"Value": "Population Count"}}),
    ])
    assert trend.columns == ["LSOA Code", "LA Name", "Year", "Population Count"]
    assert rows(trend) == [("E1", "Leeds", "2019", 29), ("E1", "Leeds", "2020", 30)]
