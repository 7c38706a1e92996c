"""Licences: each document's text, and behind it a block of requirements in turn."""
from pyspark.sql import functions as F

from harborline.functions import licences as L
from harborline.functions.requirements import OPTIONAL, requirement_lines
from harborline.functions.text import mentions, once
from harborline.plans import descriptions as D
from harborline.plans.registry import query
from harborline.plans.sql import has_phrase, quote
from harborline.sources.tables import table

BLOCKS = (
    "## Requirements\n- Must have a valid Ontario Class \"G\" driver's licence; must be a member (in good standing; no conditions) of the College of Nurses of Ontario\n- Valid driver's license",
    "## Qualifications\n- Registration as a Registered Nurse (RN) with the College of Nurses of Ontario\n- Registered Nurse",
    "## Requirements\n- Class D licence with Z endorsement and must be able to obtain a Class C licence\n- Class G/2 class licence or equivalent",
    "## Requirements\n- P.Eng. designation or eligible for registration with Professional Engineers Ontario\n- Software licence management is required",
    "## Nice to Have\n- Valid driver's licence\n\n## Duties\n- Licence plates\n- Must hold an air brake endorsement, class 3 licence in BC",
    "## Requirements\n- Driver's licence is an asset\n- Registered as a full-time student\n- Licensed Practical Nurse (LPN). Membership with OACETT is required",
    "## Licence\n- Ability to obtain a B.C. driver's licence\n- DZ driver license\n- Member of the Law Society of Ontario [formerly; Upper Canada",
)

_MINE = f"SELECT doc_id, coalesce(text, '') || chr(10) || list_extract([{', '.join(map(quote, BLOCKS))}], CAST(doc_id % {len(BLOCKS)} + 1 AS INTEGER)) AS description FROM documents"
_words = r"' ' || trim(regexp_replace(regexp_replace(regexp_replace(lower(c), '[,;:()/]', ' , ', 'g'), '\.([^a-z]|$)', ' , \1', 'g'), '[^\p{L}\p{N},#.]+', ' ', 'g')) || ' , '"
_first = lambda names: "CASE " + " ".join(f"WHEN {has_phrase('w', phrases)} THEN {quote(name)}" for name, phrases in names) + " END"
_sep = quote(L.SEPARATOR)
_z = "regexp_matches(w, ' z endorsement | endorsement z ')"
_classes = "list_filter(list_transform(" + " || ".join(f"regexp_extract_all(c, {quote(p)}, 1)" for p in L.CLASS_FORMS) + f", lambda x: upper(x)), lambda x: x IN ({', '.join(map(quote, L.CLASSES))}))"
_SQL = f"""WITH {D._LINES.replace(D._DESCRIPTIONS, _MINE)},
 nn AS (SELECT doc_id, line, section, regexp_replace(text, {quote(L.SENTENCE)}, '.' || chr(1) || '\\1', 'g') AS t FROM needs WHERE section NOT IN ('optional', 'benefits')),
 n0 AS (SELECT doc_id, line, section, t, regexp_extract_all(t, {_sep}) AS ms, regexp_split_to_array(t, {_sep}) AS gs FROM nn),
 n1 AS (SELECT *, ms[k] AS m, gs[k] AS g, CASE WHEN ms[k] IN ('(', '[') THEN 1 WHEN ms[k] IN (')', ']') THEN -1 ELSE 0 END AS turn FROM (SELECT *, unnest(range(1, len(gs) + 1)) AS k FROM n0)),
 n2 AS (SELECT *, sum(turn) OVER w - least(min(0) OVER w, 0) AS level FROM n1 WINDOW w AS (PARTITION BY doc_id, line ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
 n3 AS (SELECT *, coalesce(sum(CASE WHEN turn = 0 AND level = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, line ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS clause FROM n2),
 cs AS (SELECT doc_id, line, section, clause, trim(replace(string_agg(g || CASE WHEN turn = 0 AND level = 0 THEN '' ELSE coalesce(m, '') END, '' ORDER BY k), chr(1), ' ')) AS c FROM n3 GROUP BY doc_id, line, section, clause),
 ws AS (SELECT *, {_words} AS w FROM cs WHERE c <> ''),
 asked AS (SELECT doc_id, c, w, {_first(L.ROLES)} AS role, {_first(L.BODIES)} AS body, {_classes} AS raw, {_first(L.PROVINCES)} AS province FROM ws
   WHERE (section = 'required' OR {has_phrase('w', L.CUES)}) AND ({has_phrase('w', (*L.TERMS, *L.DRIVER))} OR contains(w, ' endorsement ')) AND NOT {has_phrase('w', (*OPTIONAL, *L.OTHER))}),
 once AS (SELECT *, list_filter(raw, lambda x, i: list_position(raw, x) = i) AS found FROM asked),
 classed AS (SELECT * EXCLUDE (found), CASE WHEN len(found) > 1 THEN list_filter(found, lambda x: x <> 'A') ELSE found END AS cl FROM once),
 folded AS (SELECT * EXCLUDE (cl), CASE WHEN {_z} AND len(list_filter(cl, lambda x: ends_with(x, 'Z'))) = 0 THEN list_transform(cl, lambda x: CASE x WHEN 'D' THEN 'DZ' ELSE x END) ELSE cl END AS cl FROM classed),
 labels AS (SELECT doc_id, CASE
   WHEN role IS NOT NULL OR body IS NOT NULL THEN CASE WHEN role IS NULL THEN body WHEN body IS NULL THEN role ELSE coalesce(nullif(regexp_extract(role, '\\(([A-Z-]+)\\)$', 1), ''), role) || ' (' || body || ')' END || CASE WHEN {has_phrase('w', L.ELIGIBLE)} THEN ' or eligible' ELSE '' END
   WHEN {has_phrase('w', L.DRIVER)} OR regexp_matches(w, ' licen[cs]e | endorsement ') THEN CASE WHEN len(cl) > 0 THEN coalesce(province || ' ', '') || 'Class ' || array_to_string(cl, '/') || CASE WHEN {_z} AND len(list_filter(cl, lambda x: ends_with(x, 'Z'))) = 0 THEN ' with Z endorsement' WHEN regexp_matches(w, ' air ?brakes? ') THEN ' with air brake endorsement' ELSE '' END
     WHEN {has_phrase('w', L.DRIVER)} THEN CASE WHEN province IS NULL THEN 'Driver''s licence' ELSE province || ' driver''s licence' END END || CASE WHEN {has_phrase('w', L.EQUIVALENT)} THEN ' or equivalent' ELSE '' END || CASE WHEN {has_phrase('w', L.OBTAIN)} THEN ' (able to obtain)' ELSE '' END END AS label FROM folded),
 keyed AS (SELECT DISTINCT doc_id, label, list_filter(string_split(regexp_replace(lower(label), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x NOT IN ('', 'or', 'able', 'to', 'obtain', 'equivalent', 'eligible', 'with', 's')) AS k FROM labels WHERE label IS NOT NULL)
SELECT doc_id, string_agg(label, '; ' ORDER BY label) AS licences FROM keyed x WHERE NOT EXISTS (SELECT 1 FROM keyed y WHERE y.doc_id = x.doc_id AND ((x.label ILIKE '%driver''s licence%' AND y.label LIKE '%Class %') OR (list_has_all(y.k, x.k) AND len(list_distinct(y.k)) > len(list_distinct(x.k))))) GROUP BY doc_id"""


@query("licences_required", _SQL)
def licences_required(spark, sf_dir):
    """The licences that each document's lines require, without those that another one says more of."""
    block = F.element_at(F.array(*map(F.lit, BLOCKS)), (F.col("doc_id") % len(BLOCKS) + 1).cast("int"))
    texts = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), block).alias("description"))
    lines = requirement_lines(texts, "doc_id", "description").filter(mentions(F.col("text"), L.STEMS))
    found = lines.select("doc_id", once(L.licence_labels(F.col("section"), F.col("text"))).alias("labels")).filter(F.size("labels") > 0)
    return found.groupBy("doc_id").agg(L.without_weaker(F.flatten(F.collect_list("labels"))).alias("labels")).select("doc_id", F.array_join("labels", "; ").alias("licences"))
