"""Boilerplate of sources: each document with an end of its source behind it."""
from pyspark.sql import functions as F

from harborline.operators.boilerplate import LEAST, by_rules, without_ends
from harborline.plans.registry import query
from harborline.sources.tables import table

ENDS = ("About {source}\nWe thank all applicants; only those selected will be contacted.\nApply online.", "Apply online.", "\nHow to apply at {source}:\nSend a letter.\n")
RULES = ((None, "line", "apply online"), ("src1", "tail", "we thank all applicants"))
_CASE = "CASE CAST(doc_id % 3 AS INTEGER) " + " ".join("WHEN {} THEN '{}'".format(i, e.replace("\n", "\\n")) for i, e in enumerate(ENDS)) + " END"
_TEXT = f"coalesce(text, '') || chr(10) || replace(replace({_CASE}, '\\n', chr(10)), '{{source}}', coalesce(source, ''))"
_key = lambda x: f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"
_LINES = f"d AS (SELECT doc_id, source, list_filter(regexp_split_to_array({_TEXT}, '\\r?\\n'), lambda x: trim(x) <> '') AS p FROM documents)"


def _descriptions(spark, sf_dir):
    end = F.element_at(F.array(*map(F.lit, ENDS)), (F.col("doc_id") % 3 + 1).cast("int"))
    text = F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), F.replace(end, F.lit("{source}"), F.coalesce("source", F.lit(""))))
    return table(spark, sf_dir, "documents").select("doc_id", "source", text.alias("text"))


@query(
    "source_ends_gone",
    f"""WITH {_LINES}, h AS (SELECT *, list_transform(p, lambda x: {_key('x')}) AS k FROM d),
        e AS (SELECT doc_id, source, n, md5(array_to_string(k[len(k) - n + 1:], chr(10))) AS tail, k[len(k) - n] AS before FROM (SELECT *, unnest(range(1, len(k))) AS n FROM h)),
        learnt AS (SELECT source, tail FROM e GROUP BY source, tail HAVING count(DISTINCT before) >= {LEAST}),
        c AS (SELECT e.doc_id, max(n) AS cut FROM e JOIN learnt l ON e.tail = l.tail AND e.source IS NOT DISTINCT FROM l.source GROUP BY e.doc_id)
        SELECT d.doc_id, CAST(coalesce(cut, 0) AS INTEGER) AS cut, md5(array_to_string(p[1:len(p) - coalesce(cut, 0)], chr(10))) AS text_md5 FROM d LEFT JOIN c ON d.doc_id = c.doc_id""",
)
def source_ends_gone(spark, sf_dir):
    """Each document without the longest end that its source puts behind different texts."""
    return without_ends(_descriptions(spark, sf_dir), "doc_id", "source", "text").select("doc_id", "cut", F.md5("text").alias("text_md5"))


_hit = lambda x, kind: "(" + " OR ".join(f"(contains(' ' || {_key(x)} || ' ', ' {phrase} ')" + (f" AND source = '{s}'" if s else "") + ")" for s, k, phrase in RULES if k in kind) + ")"


@query(
    "source_rules_applied",
    f"""WITH {_LINES}, l AS (SELECT doc_id, source, i, p[i] AS x FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM d)),
        m AS (SELECT *, coalesce({_hit('x', ('line', 'tail'))}, FALSE) AS hit, max(CASE WHEN {_hit('x', ('tail',))} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS behind FROM l)
        SELECT d.doc_id, md5(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (WHERE NOT hit AND behind = 0), '')) AS text_md5 FROM d LEFT JOIN m ON d.doc_id = m.doc_id GROUP BY d.doc_id""",
)
def source_rules_applied(spark, sf_dir):
    """Each document without the lines and ends that the table of rules names for its source."""
    rules = spark.createDataFrame(list(RULES), "source string, kind string, phrase string")
    return by_rules(_descriptions(spark, sf_dir), "doc_id", "source", "text", rules).select("doc_id", F.md5("text").alias("text_md5"))
