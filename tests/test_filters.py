from pyspark.sql import functions as F

from harborline.functions import software as S
from harborline.operators.filters import ListFilters, any_type


def test_parameters():
    assert ListFilters.of("") == ListFilters() and ListFilters.of("?mode=x&salary=1&closing=8&listing=regular&degree=&stage=boss") == ListFilters()
    got = ListFilters.of("?search=a%20b&mode=Remote&mode=Hybrid&mode=Remote&salary=75000&closing=-1&added=7&sort=newest&company=A&company=&language=French&stage=senior&degree=student&student=1&vehicle=1&listing=inventory")
    assert got == ListFilters("a b", "", 75000, ("Remote", "Hybrid"), ("French",), True, -1, "inventory", True, False, False, ("A",), ("student",), "", ("senior",))
    assert ListFilters.of("added=7&sort=newest") == ListFilters(newly_added=True) and ListFilters.of("sort=newest") == ListFilters(newest_first=True) and ListFilters.of("closing=0").deadline_days == 0


def test_rows(spark):
    rows = [(1, "On-site", '["English"]', 60000.0, 1, "senior", '["PhD in Art"]'), (2, "Remote", '["Bilingual"]', 80000.0, 0, "student", "[]"), (3, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "id int, work_model string, language_requirements string, salary_min double, vehicle_required int, career_stage string, education_requirements string")
    kept = lambda address: [r["id"] for r in ListFilters.of(address).apply(df).orderBy("id").collect()]
    assert kept("") == [1, 2, 3] and kept("mode=In-person") == [1] and kept("language=English&language=French") == [2] and kept("salary=75000") == [2]
    assert kept("vehicle=1") == [1] and kept("stage=senior&stage=student") == [1, 2] and kept("degree=doctorate&degree=masters&field=ART") == [1]


def test_types(spark):
    rows, types = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "company string"), spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z"), (None, "x")], "name string, type string")
    assert [r[0] for r in any_type("company", ["x", "y"], types, rows).collect()] == ["a"] and any_type("company", [], types, rows).count() == 4


def test_software(spark):
    names = [(["MS Word", "Word", "microsoft office suite applications", "Adobe Pro", "SAP.", "", None], ["Word", "Microsoft Office", "Adobe Acrobat", "SAP"]), ([], []), (None, None)]
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(names)], "i int, v array<string>")
    assert [r[1] for r in df.select("i", S.software_names(F.col("v"))).orderBy("i").collect()] == [w for _, w in names]
    df = spark.createDataFrame([(["Microsoft Word", "Writing", "SAP reports"], ["Word", "SAP"]), (["Excel"], None), (None, ["Word"])], "k array<string>, s array<string>")
    assert [r[0] for r in df.select(S.skills_beside(F.col("k"), F.col("s"))).collect()] == [["Writing"], ["Excel"], None]
