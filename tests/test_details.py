from pyspark.sql import functions as F

from harborline.functions import details as T

EXPERIENCES = [
    ("Minimum of three years of planning", "3+ years of planning"), ("two to four years", "2–4 years"), ("5 years", "5+ years"), ("two years part-time or one year full-time", "2 years part-time or one year full-time"), ("3+ years — planning", "3+ years — planning"),
    ("Experience with reports", "Experience with reports"), ("Experience in the field.", "Field"), ("experience: lab work;", "Lab work"), ("Recent experience is defined as two years or more within the past five (5) years", "Recent (within past 5 years)"),
    ("Experience is defined as two (2) years or more", "2+ years"), ("Significant is defined as depth", ""), ("  ", ""), (None, None),
]
FIELDS = [
    ("course", "Course code: BIO 101", "BIO 101"), ("course", "Fall 2026", None), ("course", "Project - Rivers", "Rivers"), ("workload", "Workload: 10 hrs/wk", "10 hours per week"), ("workload", "0.5fte", "0.5 FTE"), ("workload", "part time", None), ("workload", " N/A ", None),
    ("office_hours", "lab hours", None), ("office_hours", "Consultation hours: 2 hrs per wk", "2 hours per week"), ("supervisor", "PI: Dr. Ng", "Dr. Ng"), ("appointment_type", "appointment: tenure track", "Tenure-track"), ("appointment_type", "Casual", None), ("schedule", "Mon – Wed", "Mon - Wed"), ("schedule", None, None), ("supervisor", "", None),
]
UNIONS = [(1, "CUPE 3902??", "CUPE 3902"), (1, "Union", "Unionized"), (1, "Non-Union?", None), (1, "n/a", None), (0, "USW", None), (None, "USW", None), (1, None, None), (1, " ", None)]


def test_experiences(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(EXPERIENCES)], "i int, t string")
    assert [r[1] for r in df.select("i", T.experience_label(F.col("t"))).orderBy("i").collect()] == [w for _, w in EXPERIENCES]


def test_first_span_leads(spark):
    cases = [(["Lab work", "5 years", "Reports", "2 to 4 years"], "5+ years; Lab work; Reports"), (["Lab work"], "Lab work"), (["a is defined as two years or more", "9 years"], "2+ years"), ([], None), ([""], None), (None, None)]
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(cases)], "i int, v array<string>")
    assert [r[1] for r in df.select("i", T.experiences(F.col("v"))).orderBy("i").collect()] == [w for _, w in cases]


def test_academic_fields(spark):
    df = spark.createDataFrame([(i, f, t) for i, (f, t, _) in enumerate(FIELDS)], "i int, f string, t string")
    value = F.coalesce(*(F.when(F.col("f") == f, T.academic(F.col("t"), f)) for f in T.LABELS))
    assert [r[1] for r in df.select("i", value).orderBy("i").collect()] == [w for _, _, w in FIELDS]


def test_roles_and_unions(spark):
    df = spark.createDataFrame([(0, "faculty", "Tutor"), (1, None, "Post-Doc Fellow"), (2, "other", "Lead Marker"), (3, None, "Clerk"), (4, None, None)], "i int, r string, t string")
    assert [r[1] for r in df.select("i", T.academic_role(F.col("r"), F.col("t"))).orderBy("i").collect()] == ["Faculty", "Postdoctoral", "Teaching assistant", None, None]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(UNIONS)], "i int, m int, n string, w string")
    assert df.select("i", T.union_label(F.col("m"), F.col("n")).alias("got"), "w").filter("NOT got <=> w").collect() == []


def test_whole_struct_and_an_empty_row(spark):
    texts = ("salary_period work_model employment_type duration start_date hours availability academic_role_type job_title academic_course academic_workload academic_office_hours academic_supervisor academic_appointment_type academic_schedule union_name listing_type "
             "experience_requirements education_requirements license_requirements language_requirements certification_requirements software_requirements medical_requirements required_skills benefits description").split()  # fmt: skip
    schema = ", ".join([f"{x} string" for x in texts] + [f"{x} int" for x in "is_unionized is_inventory is_student vehicle_required security_check_required salary_min salary_max".split()])
    row = dict.fromkeys([*texts, "is_unionized", "is_inventory", "is_student", "vehicle_required", "security_check_required", "salary_min", "salary_max"])
    full = row | {"salary_period": "yearly", "salary_min": 60000, "salary_max": 80000, "education_requirements": '["Grade 12", "bachelor degree in Art"]', "language_requirements": '["English", "French"]', "security_check_required": 1, "start_date": "2026-08-04T10:00", "hours": "12 hrs/week", "description": "FUTURE requirements"}
    got = spark.createDataFrame([list(full.values()), list(row.values())], schema).select(T.details().alias("d")).collect()
    d = got[0]["d"].asDict(recursive=True)
    assert (d["salary"], d["start_date"], d["future"], d["academic"]["workload"]) == ("$60K – $80K / yr", "Aug 4, 2026", "Eligible for future requirements", "12 hours per week")
    assert (d["requirements"]["education"], d["requirements"]["languages"], d["requirements"]["security"], d["requirements"]["vehicle"]) == ("High school diploma, Bachelor's degree in Art", "English, French", "Required", None)
    empty = got[1]["d"].asDict(recursive=True)
    assert all(v is None for k, v in empty.items() if k not in ("academic", "requirements")) and all(v is None for k in ("academic", "requirements") for v in empty[k].values())
