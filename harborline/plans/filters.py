"""Filters by address on what descriptions require, software beside skills, companies by type."""
from pyspark.sql import functions as F

from harborline.functions import software as S
from harborline.functions.requirements import SOFTWARE
from harborline.functions.text import string_list
from harborline.operators.filters import ListFilters, any_type
from harborline.plans import education as E
from harborline.plans.registry import query
from harborline.plans.sql import flat, has_phrase, plain, quote
from harborline.sources.tables import table

ADDRESS = "?degree=bachelors&degree=none&degree=masters&degree=bachelors&field=%20Planning&mode=Anywhere&closing=8&added=7&sort=newest&salary=1"


@query("filtered_by_address", f"WITH {E.FOUND}, shown AS (SELECT doc_id, string_agg(label, ' ' ORDER BY line) AS t FROM kept GROUP BY doc_id) SELECT doc_id FROM shown WHERE regexp_matches(lower(t), 'bachelor|baccalaureate|undergraduate degree|master|graduate degree') AND contains(lower(t), 'planning')")
def filtered_by_address(spark, sf_dir):
    rows = E.required(E.descriptions(spark, sf_dir)).select("doc_id", F.to_json("labels").alias("education_requirements"))
    return ListFilters.of(ADDRESS).apply(rows).select("doc_id")


@query("companies_of_types", "SELECT s_suppkey AS supplier FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE'))")
def companies_of_types(spark, sf_dir):
    """Suppliers stand for companies, regions for their types."""
    types = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("name"), F.col("r_name").alias("type"))
    return any_type("s_nationkey", ["ASIA", "EUROPE", "OTHER"], types, table(spark, sf_dir, "supplier")).select(F.col("s_suppkey").alias("supplier"))


BLOCKS = (
    "software: MS Word applications; Microsoft Office Suite.; Word, SAP\nskills: Microsoft Word; Writing; SAP reports", "software: adobe pro, Acrobat Pro, Photoshop, , ArcGIS.\nskills: QGIS; Adobe Acrobat; arcgis; Planning", "software: M365; Custom  Tool.\nskills: custom tool; Excel", "skills: Excel; Teams",
)
_parts = lambda name: rf"(SELECT doc_id, i, trim(ps[i]) AS v FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT doc_id, string_split_regex(regexp_extract(description, '(?m)^{name}: (.*)$', 1), '[,;]') AS ps FROM d)) WHERE trim(ps[i]) <> '')"
_words = lambda c: rf"(' ' || trim(regexp_replace(regexp_replace(regexp_replace(lower({c}), '[,;:()/]', ' , ', 'g'), '\.([^a-z]|$)', ' , \1', 'g'), '[^\p{{L}}\p{{N}},#.]+', ' ', 'g')) || ' , ')"
_names = " ".join(f"WHEN trim({plain('t')}) IN ({', '.join(map(quote, spelt))}) THEN {quote(name)}" for name, spelt in S.PRODUCTS)
_key = lambda c: f"CASE {' '.join(f'WHEN {has_phrase(chr(119), phrases)} THEN {quote(name.lower())}' for name, phrases in SOFTWARE)} ELSE trim({plain(c)}) END"


@query(
    "software_beside_skills",
    f"""WITH d AS ({E.described(BLOCKS)}), sw AS (SELECT doc_id, i, CASE {_names} ELSE t END AS name FROM (SELECT doc_id, i, trim(regexp_replace({flat('v')}, '\\.$', '')) AS t FROM {_parts('software')})),
        once AS (SELECT doc_id, name, min(i) AS i FROM sw WHERE name <> '' GROUP BY doc_id, name), keyed AS (SELECT doc_id, {_key('name')} AS k FROM (SELECT *, {_words('name')} AS w FROM once)),
        sk AS (SELECT doc_id, i, v, {_key('v')} AS k FROM (SELECT *, {_words('v')} AS w FROM {_parts('skills')})),
        left_over AS (SELECT doc_id, string_agg(v, '; ' ORDER BY i) AS skills FROM sk WHERE NOT EXISTS (SELECT 1 FROM keyed WHERE keyed.doc_id = sk.doc_id AND keyed.k = sk.k) GROUP BY doc_id),
        listed AS (SELECT doc_id, string_agg(name, '; ' ORDER BY i) AS software FROM once GROUP BY doc_id)
        SELECT doc_id, coalesce(software, '') AS software, coalesce(skills, '') AS skills FROM d LEFT JOIN listed USING (doc_id) LEFT JOIN left_over USING (doc_id)""",
)
def software_beside_skills(spark, sf_dir):
    field = lambda name: string_list(F.regexp_extract("description", f"(?m)^{name}: (.*)$", 1))
    rows = E.descriptions(spark, sf_dir, BLOCKS).select("doc_id", S.software_names(field("software")).alias("software"), field("skills").alias("skills"))
    return rows.select("doc_id", F.array_join("software", "; ").alias("software"), F.array_join(S.skills_beside(F.col("skills"), F.col("software")), "; ").alias("skills"))
