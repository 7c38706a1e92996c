from harborline.operators import places as P

PLACES = [
    ("Guelph", "Guelph, ON"), ("Montreal", "Montreal, QC"), ("Yellowknife", "Yellowknife, NT"), ("toronto, on", "Toronto, ON"), ("Toronto, Ontario, Canada", "Toronto, ON"), ("Edmonton, AB, Canada", "Edmonton, AB"),
    ("Calgary (AB); Halifax (NS); Montreal (QC)", "Calgary, AB; Halifax, NS; Montreal, QC"), ("Calgary (ab), Halifax (ns), Vancouver, BC", "Calgary, AB; Halifax, NS; Vancouver, BC"), ("Calgary (ab), BC; Vancouver, BC", "Calgary, AB; Vancouver, BC"),
    ("Bagotville (québec), YT", "Bagotville, QC"), ("Guelph; Toronto; guelph", "Guelph, ON; Toronto, ON"), ("Kelowna / Penticton / Salmon Arm / Vernon", "Kelowna, BC; Penticton, BC; Salmon Arm, BC; Vernon, BC"), ("Edmonton or Calgary", "Edmonton, AB; Calgary, AB"),
    ("New Westminster/Coquitlam", "New Westminster, BC; Coquitlam, BC"), ("Delta, Langley, Surrey", "Delta, BC; Langley, BC; Surrey, BC"), ("Keele Campus", "Toronto, ON"), ("Keele Campus, Ontario, Canada", "Toronto, ON"), ("St. George (Downtown Toronto)", "Toronto, ON"),
    ("University of Toronto Mississauga", "Mississauga, ON"), ("St. Catharines, Main Campus", "St. Catharines, ON"), ("City of Hamilton", "Hamilton, ON"), ("fort mcmurray, ab", "Fort McMurray, AB"), ("Various locations", None), ("Nowhereville", None), ("Multiple, ON", None), ("Ontario", None), ("", None), (None, None),
]
LABELLED = [
    ("Location: North Bay Department: Parks", "North Bay, ON"), ("Job Location: Fort Frances, ON Salary: $5", "Fort Frances, ON"), ("Location: Various Primary City: Thunder Bay", "Thunder Bay, ON"), ("Locations Toronto, ON; Vancouver", "Toronto, ON"),
    ("A nice location in Guelph", None), ("location: King City hall", "King City, ON"), ("Locations: none", None), ("Locations Barrie and job location: Sudbury", "Sudbury, ON"), ("Allocations Toronto", None), ("", None), (None, None),
]


def found(spark, cases, f, known=None):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "id int, t string")
    got = {r[0]: r[1] for r in f(df, "id", "t", known or P.gazetteer(spark)).collect()}
    return [(c[0], got.get(i)) for i, c in enumerate(cases)]


def test_places(spark, monkeypatch):
    assert found(spark, PLACES, P.places) == PLACES
    monkeypatch.setattr(P, "BROADCAST", 1)  # looked up by a shuffle
    assert found(spark, PLACES, P.places) == PLACES


def test_labelled_places(spark):
    assert found(spark, LABELLED, P.labelled_places) == LABELLED


def test_empty_tables(spark):
    none = spark.createDataFrame([], P.SCHEMA)
    assert found(spark, [], P.places) == [] and found(spark, [("Guelph", None), ("Toronto, ON", "Toronto, ON")], P.places, none) == [("Guelph", None), ("Toronto, ON", "Toronto, ON")]
