import json

from pyspark.sql import functions as F

from harborline.functions import pay, sections
from harborline.sources import feeds


def payload(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "payload_id int, payload string")


def test_rss(spark):
    xml = "<rss><item><link> https://x/y?JOBID=A1&z=2 </link></item><item><link>https://x/y</link></item><item>none</item></rss>"
    assert [tuple(r) for r in feeds.rss_items(payload(spark, xml, None, ""), "s").collect()] == [(0, 0, "s_a1", "https://x/y?JOBID=A1&z=2")]


def test_xml_jobs(spark):
    job = lambda ref, title: f"<job><referencenumber>{ref}</referencenumber><title><![CDATA[{title}]]></title><url>u{ref}</url><description>&lt;p&gt;A&lt;/p&gt;&lt;li&gt;B&lt;/li&gt;</description></job>"
    got = feeds.xml_jobs(payload(spark, job(1, "T &amp; U") + job(1, "again") + job(2, "") + job(3, "V")), "p").orderBy("id").collect()
    assert [(r["id"], r["title"], r["text"]) for r in got] == [("p_1", "T & U", "T & U\n\nA\n- B"), ("p_3", "V", "V\n\nA\n- B")]


def test_json_postings(spark):
    data = json.dumps([{"id": "a", "text": "Clerk", "c": {"d": "HR"}}, {"id": "a", "text": "Again"}, {"id": "b"}, {"text": "no id"}, {"id": 7, "name": "Other", "c": {"d": ""}}])
    fields = {"id": ["$.id"], "title": ["$.text", "$.name"], "department": ["$.c.d"]}
    got = feeds.json_postings(payload(spark, data, '{"id": 1}', "broken", None), "l", fields).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(0, "l_7", "Other", None), (0, "l_a", "Clerk", "HR")]


def test_enrich_and_json_ld(spark):
    listing = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, title string, place string")
    detail = spark.createDataFrame([(1, "", "z"), (3, "c", "w")], "id int, title string, place string")
    assert sorted(map(tuple, feeds.enrich(listing, detail, "id").collect())) == [(1, "a", "z"), (2, "b", "y")]
    page = '<script type="application/ld+json">{"a":1}</script><script type="application/ld+json">{"datePosted":"2026-01-02"}</script>'
    assert payload(spark, page, "").select(feeds.json_ld_date(F.col("payload")).alias("d")).collect() == [("2026-01-02",), (None,)]


def test_sections(spark):
    text = "intro\n# Qualifications\n- Five years of office work\n- office work\n**Benefits:**\n* Dental plan\n* dental  plan!\n\nABOUT US\nWe are"
    df = spark.createDataFrame([(1, text), (2, None)], "id int, t string")
    got = sections.lines(df, "id", "t").orderBy("line").collect()
    assert [(r["text"], r["section"]) for r in got if not r["is_heading"]] == [("intro", "other"), ("Five years of office work", "required"), ("office work", "required"), ("Dental plan", "benefits"), ("dental plan!", "benefits"), ("We are", "other")]
    assert sorted(r["line"] for r in sections.narrower_bullets(df, "id", "t").collect()) == [3, 6]
    kept = df.select(sections.without_repeats(F.col("t")).alias("t")).first()["t"]
    assert "dental  plan!" not in kept and kept.count("\n") == text.count("\n") - 1


def test_languages_and_pay(spark):
    df = spark.createDataFrame([(["Bilingual", "French", " English", "Cree", "French"],)], "l array<string>")
    assert df.select(sections.languages(F.col("l")).alias("l")).first()["l"] == ["English", "French", "Cree", "Bilingual"]
    rows = spark.createDataFrame([("$80,000.50 - $90,000",), ("$20",), ("none",), (None,)], "t string").select(pay.pay_range(F.col("t")).alias("p")).collect()
    assert [tuple(r["p"]) for r in rows] == [(80000.5, 90000.0), (20.0, 20.0), (None, None), (None, None)]
    shown = spark.createDataFrame([(60000.0, 80000.0, "yearly"), (21.5, 21.5, "hourly"), (None, 2500.0, "flat"), (None, None, "yearly"), (4000.0, None, "monthly")], "a double, b double, p string")
    assert [r[0] for r in shown.select(pay.shown(F.col("a"), F.col("b"), F.col("p"))).collect()] == ["$60K – $80K / yr", "$21.5/hr", "$2,500 flat", None, "$4K / mo"]
