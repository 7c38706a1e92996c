"""Benefits and certificates: each document's text, behind it a block with sections and with lists as JSON in turn."""
from pyspark.sql import functions as F

from harborline.functions import benefits as B
from harborline.functions import requirements as R
from harborline.functions.requirements import requirement_lines
from harborline.functions.text import json_strings
from harborline.functions.text import mentions, once
from harborline.plans import descriptions as D
from harborline.plans.education import described, descriptions
from harborline.plans.registry import query
from harborline.plans.sql import flat, has_phrase, plain, quote

BLOCKS = (
    '## Benefits\n- OMERS pension plan\n- HOOPP or the CAAT plan\n\n## Qualifications\n- Standard First Aid with CPR C or AED; WHMIS\n- First aid\nbenefits: ["Vacation Credit", "OMERS Pension", "Pension", "Life", "3 weeks vacation", "Training and mentorship"]\ncertificates: ["WHMIS training", "whmis", "Vulnerable Sector Police Check"]',
    '## Qualifications\n- Administer OMERS pension plans\n- Smart Serve is an asset\n- Nonviolent Crisis Intervention and food handlers\nbenefits: ["Wellness And Employee Assistance Programs", "Health & Dental Benefits", "tool/boot allowance.", "RRSP matching", "EAP", 7]\ncertificates: ["Food Safety Certification course (Food Handlers Training) or so", "Current Standard First Aid, CPR “C” and AED certification."]',
    '## Perks\n- Municipal Pension Plan; Public Service Pension Plan\n\n## Nice to Have\n- Smart Serve\n\n## Requirements\n- CPR-B\n- CPR-C\n- Emergency First Aid\nbenefits: ["Pension", "Remote Work Programs", "Pension Plan", "up to 3 days", " ; "]\ncertificates: ["PMP certification is considered an asset", "Certification in Asset Management is required.", "Lifeguard (asset)"]',
    'Whmis required\nbenefits: ["Incentive", "Incentive Plan", "Extended Health Care", "Dental Care", "Flexible Work Program", "Advancement Opportunities", "PTO"]\ncertificates: ["Worker health and safety awareness", "Active member of a body", "HIGH FIVE Certificate.", "St. John\'s Ambulance First Aid 1"]',
    "benefits: none\ncertificates: [",
)

_MINE = described(BLOCKS)
_d = f"d AS ({_MINE})"
_strings = lambda name: rf"(SELECT doc_id, CASE WHEN json_valid(j) THEN CASE WHEN json_type(j) = 'ARRAY' THEN list_transform(list_filter(CAST(j AS JSON[]), lambda x: json_type(x) = 'VARCHAR'), lambda x: x->>'$') END END AS vs FROM (SELECT doc_id, regexp_extract(description, '(?m)^{name}: (.*)$', 1) AS j FROM d))"
_in = lambda c, values: f"{c} IN ({', '.join(map(quote, values))})"
_array = lambda values: "[" + ", ".join(map(quote, values)) + "]"
_known = "CASE " + " ".join(f"WHEN {_in('k', phrases)} THEN {_array(labels)}" for labels, phrases in B.LABELS) + " END"
_core = "regexp_matches(regexp_replace(t, '^[^A-Za-z0-9]+|[^A-Za-z0-9]+$', '', 'g'), '^[A-Z0-9]{2,}$')"
_cased = f"array_to_string(list_transform(regexp_extract_all(v, '[^ /&]+|[ /&]'), lambda t: CASE WHEN {_core} THEN t ELSE upper(t[1:1]) || lower(t[2:]) END), '')"
_BENEFITS = f"""WITH {_d}, vals AS (SELECT doc_id, i, regexp_replace({flat('vs[i]')}, '[ .;,:]+$', '') AS v FROM (SELECT doc_id, vs, unnest(range(1, len(vs) + 1)) AS i FROM {_strings('benefits')})),
 keys AS (SELECT *, {plain('v')} AS w, trim({plain('v')}) AS k FROM vals),
 labels AS (SELECT doc_id, i, coalesce(CASE WHEN NOT regexp_matches(v, '[0-9]') AND NOT {has_phrase('w', B.DETAIL_PHRASES)} THEN {_known} END, [{_cased}]) AS ls FROM keys WHERE k <> '' AND NOT {_in('k', B.NO_BENEFIT)} AND NOT {has_phrase('w', B.NO_BENEFIT_WORDS)}),
 one AS (SELECT doc_id, label, min(i * 10 + j) AS place FROM (SELECT doc_id, i, unnest(ls) AS label, unnest(range(len(ls))) AS j FROM labels) GROUP BY doc_id, label),
 named AS (SELECT DISTINCT doc_id FROM one WHERE {_in('label', [n for n, _ in B.PENSIONS])})
SELECT doc_id, coalesce(string_agg(label, '; ' ORDER BY place), '') AS benefits FROM d LEFT JOIN (SELECT * FROM one WHERE label <> 'Pension' OR doc_id NOT IN (SELECT doc_id FROM named)) USING (doc_id) GROUP BY doc_id"""


def _stored(spark, sf_dir, name):
    return descriptions(spark, sf_dir, BLOCKS).select("doc_id", json_strings(F.regexp_extract("description", f"(?m)^{name}: (.*)$", 1)).alias("v"))


@query("benefits_labelled", _BENEFITS)
def benefits_labelled(spark, sf_dir):
    return _stored(spark, sf_dir, "benefits").select("doc_id", F.array_join(B.benefits(F.col("v")), "; ").alias("benefits"))


_first_aid = f"""CASE WHEN ({D._AID} OR {D._CPR} OR {D._AED}) AND NOT {D._any(R.OPTIONAL)} AND NOT ({D._AID} AND {D._any(R.OTHER_FIRST_AID)}) AND NOT ({D._any(('basic cardiac life support', 'bls'))} AND contains(words, ' or '))
 AND NOT ({D._any([f'ability to {x} first aid' for x in ('provide', 'perform', 'administer')])} AND NOT {D._CPR} AND NOT contains(words, 'certif') AND NOT {D._any([f'{x.lower()} first aid' for x in R.FIRST_AID_LEVELS])}) THEN
 list_transform([{{'lv': {D._LEVEL}, 'gr': {D._GRADE}, 'aed': {D._AED}, 'alt': {D._any(R.EITHER_AED)}}}], lambda x: CASE WHEN x.lv IS NULL AND x.gr IS NULL AND x.aed THEN 'AED' WHEN x.lv IS NULL THEN x.gr || CASE WHEN x.aed THEN '/AED' ELSE '' END
  WHEN x.gr IS NOT NULL THEN x.lv || ' with ' || x.gr || CASE WHEN x.aed AND x.alt THEN ' or AED' WHEN x.aed THEN '/AED' ELSE '' END WHEN x.aed THEN x.lv || ' with AED' ELSE x.lv END)[1] END"""
_words = r"' ' || trim(regexp_replace(regexp_replace(regexp_replace(lower(v), '[,;:()/]', ' , ', 'g'), '\.([^a-z]|$)', ' , \1', 'g'), '[^\p{L}\p{N},#.]+', ' ', 'g')) || ' , '"
_exact = "CASE " + " ".join(f"WHEN {_in('trim(w)', phrases)} THEN {quote(n)}" for n, phrases in B.CERTIFICATES) + " END"
_within = "CASE " + " ".join(f"WHEN {has_phrase('w', phrases)} THEN {quote(n)}" for n, phrases in B.CERTIFICATES_WITHIN) + " END"
_quotes = "regexp_replace(regexp_replace(vs[i], '[“”]', '\"', 'g'), '[‘’]', '''', 'g')"
_CERTIFICATES = f"""WITH {_d}, vals AS (SELECT doc_id, i, regexp_replace({flat(_quotes)}, '\\.$', '') AS v FROM (SELECT doc_id, vs, unnest(range(1, len(vs) + 1)) AS i FROM {_strings('certificates')})),
 keys AS (SELECT *, {plain('v')} AS w, {_words} AS words FROM vals WHERE v <> ''),
 labels AS (SELECT doc_id, i, coalesce({_first_aid}, {_exact}, {_within}, v) AS label FROM keys WHERE NOT {has_phrase('w', (*B.WISHED, *B.NO_CERTIFICATE))} AND NOT ({' OR '.join(f"starts_with(w, {quote(f' {p} ')})" for p in B.NO_CERTIFICATE_STARTS)}) AND NOT regexp_matches(lower(v), '\\( ?asset ?\\)'))
SELECT doc_id, coalesce(string_agg(label, '; ' ORDER BY i), '') AS certificates FROM d LEFT JOIN (SELECT * FROM labels QUALIFY row_number() OVER (PARTITION BY doc_id, lower(label) ORDER BY i) = 1) USING (doc_id) GROUP BY doc_id"""


@query("certificates_labelled", _CERTIFICATES)
def certificates_labelled(spark, sf_dir):
    return _stored(spark, sf_dir, "certificates").select("doc_id", F.array_join(B.certificates(F.col("v")), "; ").alias("certificates"))


_plans = " UNION ALL ".join(f"SELECT doc_id, line, {i} AS i, 'benefit' AS kind, {quote(n)} AS label FROM needs WHERE section = 'benefits' AND {has_phrase(plain('text'), phrases)}" for i, (n, phrases) in enumerate(B.PENSIONS))
_wanted = f"section NOT IN ('optional', 'benefits') AND NOT {D._any(R.OPTIONAL)}"
_papers = " UNION ALL ".join(f"SELECT doc_id, line, {i} AS i, 'certificate' AS kind, {quote(n)} AS label FROM needs WHERE {_wanted} AND {has_phrase('words', phrases)}" for i, (n, phrases) in enumerate(B.NAMED_CERTIFICATES, 1))


@query(
    "benefits_and_certificates_named",
    f"""WITH {D._LINES.replace(D._DESCRIPTIONS, _MINE)}, found AS ({_plans} UNION ALL {_papers} UNION ALL SELECT * FROM (SELECT doc_id, line, 0 AS i, 'certificate' AS kind, {_first_aid} AS label FROM needs WHERE {_wanted}) WHERE label IS NOT NULL),
        once AS (SELECT doc_id, kind, label, min(line * 100 + i) AS place FROM found GROUP BY doc_id, kind, label),
        kept AS (SELECT *, regexp_matches(lower(label), '\\bfirst aid\\b|\\bcpr\\b') AS aid FROM once QUALIFY kind = 'benefit' OR NOT aid OR row_number() OVER (PARTITION BY doc_id, kind, aid ORDER BY length(label) DESC, place) = 1)
        SELECT doc_id, coalesce(string_agg(label, '; ' ORDER BY place) FILTER (WHERE kind = 'benefit'), '') AS benefits, coalesce(string_agg(label, '; ' ORDER BY aid, place) FILTER (WHERE kind = 'certificate'), '') AS certificates FROM kept GROUP BY doc_id""",
)
def benefits_and_certificates_named(spark, sf_dir):
    """What the lines of each description name: pension plans among the benefits, certificates among what is required."""
    lines = requirement_lines(descriptions(spark, sf_dir, BLOCKS), "doc_id", "description")
    section, text = F.col("section"), F.col("text")
    lines = lines.filter(mentions(text, (*B.PENSION_STEMS, *B.CERTIFICATE_STEMS)))
    found = lines.select("doc_id", "line", once(F.struct(B.named_benefits(section, text).alias("b"), B.line_certificates(section, text).alias("c"))).alias("x")).select("doc_id", "line", "x.*").filter("size(b) + size(c) > 0")
    rows = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line", "b", "c"))).alias("rows"))
    labels = lambda name: F.flatten(F.transform("rows", lambda r: r[name]))
    return rows.select("doc_id", F.array_join(F.array_distinct(labels("b")), "; ").alias("benefits"), F.array_join(B.one_first_aid(labels("c")), "; ").alias("certificates"))
