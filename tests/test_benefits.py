from pyspark.sql import functions as F

from harborline.functions import benefits as B

BENEFITS = [
    (["Vacation Credit", "OMERS Pension", "Pension", "Life", "Accidental Death And Dismemberment", "EFAP", "Fitness Membership Discount", "Discounted Transit Passes", "Bus Pass", "Remote Work Programs", "Training and mentorship"],
     ["Vacation", "OMERS", "Life Insurance", "AD&D Insurance", "Employee Assistance Program", "Fitness Membership", "Transit Pass", "Employee Bus Pass"]),
    (["Wellness And Employee Assistance Programs", "Complimentary Fitness Centre Membership", "Access To BCIT Flexible Learning Courses"], ["Wellness", "Employee Assistance Program", "Fitness Membership"]),
    (["Pension", "Public Service Pension Plan"], ["Public Service Pension Plan"]),
    (["Incentive", "Incentive Plan", "EAP", "Extended Health Care", "Dental Care", "Health & Dental Benefits", "Flexible Work Program", "Flexible Workplace Options", "Advancement Opportunities"], ["Performance Bonuses", "Employee Assistance Program", "Health Insurance", "Dental Insurance"]),
    (["3 weeks vacation", "vacation pay in lieu", "tool/boot allowance.", "RRSP matching"], ["3 Weeks Vacation", "Vacation Pay In Lieu", "Tool/Boot Allowance", "RRSP Matching"]), (["", None, " ; "], []), ([], []), (None, None),
]
CERTIFICATES = [
    (["First Aid", "First Aid with CPR-C", 'Current Standard First Aid, CPR "C" and AED certification.', "Current certifications in Standard First Aid OR Intermediate First Aid with CPR C and AED.", "AED certification within 3 months of hire", "Standard First Aid OR Intermediate First Aid with CPR C or AED", "Food Handlers certification",
      "WHMIS training", "HIGH FIVE Certificate.", "Food Safety Certification course (Food Handlers Training) or willingness to complete within 30 days of hire", "Supervisor Health and Safety Awareness Training Certificate from the Ministry of Labour (may be obtained post offer)"],
     ["First Aid", "First Aid with CPR-C", "Standard First Aid with CPR-C/AED", "Standard or Intermediate First Aid with CPR-C/AED", "AED", "Standard or Intermediate First Aid with CPR-C or AED", "Food Handler", "WHMIS", "HIGH FIVE Certificate", "Supervisor Health and Safety Awareness training"]),
    (["Vulnerable Sector Police Check", "CSA approved safety footwear", "Mandatory legislated training", "Active member of a professional governing body", "PMP certification is considered an asset", "Certification in Asset Management is required", "Proof of immunity for Hepatitis B", "WHMIS"], ["Certification in Asset Management is required", "WHMIS"]),
    (["Completion of St. John's Ambulance First Aid 1 within three months", "Mental Health First Aid and/or Psychological First Aid training", "Current CPR or Basic Cardiac Life Support certification"],
     ["Completion of St. John's Ambulance First Aid 1 within three months", "Mental Health First Aid and/or Psychological First Aid training", "Current CPR or Basic Cardiac Life Support certification"]),
    (["whmis", "WHMIS ", None, "", "Lifeguard (asset)"], ["WHMIS"]), ([], []), (None, None),
]


def _equal(spark, cases, function):
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(cases)], "i int, v array<string>")
    assert [r[1] for r in df.select("i", function(F.col("v"))).orderBy("i").collect()] == [w for _, w in cases]


def test_benefits(spark):
    _equal(spark, BENEFITS, B.benefits)


def test_certificates(spark):
    _equal(spark, CERTIFICATES, B.certificates)


def test_one_label_on_first_aid(spark):
    _equal(spark, [(["First Aid", "WHMIS", "CPR", "First Aid with CPR"], ["WHMIS", "First Aid with CPR"]), (["CPR-A", "CPR-B", "CPR-A"], ["CPR-A"]), (["WHMIS"], ["WHMIS"]), ([], [])], B.one_first_aid)


def test_lines(spark):
    rows = [("benefits", "OMERS pension plan and the CAAT plan", ["OMERS", "CAAT Pension Plan"], []), ("required", "Administer OMERS pension plans; WHMIS", [], ["WHMIS"]), ("optional", "WHMIS", [], []), ("other", "Smart Serve and Standard First Aid", [], ["Standard First Aid", "Smart Serve"]), ("other", "WHMIS is an asset", [], []), ("other", None, [], [])]
    df = spark.createDataFrame([(i, *r[:2]) for i, r in enumerate(rows)], "i int, s string, t string")
    got = df.select("i", B.named_benefits(F.col("s"), F.col("t")).alias("b"), B.line_certificates(F.col("s"), F.col("t")).alias("c")).orderBy("i").collect()
    assert [(r["b"], r["c"]) for r in got] == [r[2:] for r in rows]
