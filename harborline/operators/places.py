"""Places of free text by a gazetteer: ``City, XX``, several joined by semicolons.

A text falls into places, a place into names under which it may be known, in the order in which they decide. Names of all
texts are looked up by one join with the gazetteer, which is sent to all executors below a stated size only. For a
labelled place, whose end is often not told, the names are its first words, the longest first.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harborline.functions.deadlines import matches
from harborline.functions.text import collapse, let

SCHEMA = "name string, city string, province string, alias boolean"
#: Rows of a gazetteer up to which it is sent to all executors.
BROADCAST = 100_000
#: Words of a labelled place, at most.
WORDS = 6
# Provinces by name, the most common cities by province, campuses and areas by the place they stand for.
PROVINCES = {
    "AB": ("alberta", "ab."), "BC": ("british columbia", "bc."), "MB": ("manitoba", "mb."), "NB": ("new brunswick", "nb."), "NL": ("newfoundland and labrador", "newfoundland", "labrador", "nl."), "NS": ("nova scotia", "ns."), "NT": ("northwest territories", "n.w.t.", "nwt"),
    "NU": ("nunavut",), "ON": ("ontario", "on."), "PE": ("prince edward island", "pei", "pe."), "QC": ("quebec", "québec", "qc."), "SK": ("saskatchewan", "sk."), "YT": ("yukon", "yukon territory"),
}
CITIES = {
    "ON": "Ajax, Aurora, Barrie, Belleville, Brampton, Brantford, Burlington, Cambridge, Cornwall, Etobicoke, Guelph, Hamilton, King City, Kingston, Kitchener, London, Markham, Milton, Mississauga, Newmarket, Niagara Falls, North Bay, North York, Oakville, Oshawa, Ottawa, Owen Sound, Peterborough, Pickering, Richmond Hill, Sarnia, Scarborough, Sudbury, St. Catharines, Thunder Bay, Toronto, Vaughan, Waterloo, Whitby, Windsor",
    "BC": "Abbotsford, Burnaby, Coquitlam, Delta, Kamloops, Kelowna, Langley, Nanaimo, New Westminster, Penticton, Prince George, Richmond, Salmon Arm, Surrey, Vancouver, Vernon, Victoria, White Rock",
    "AB": "Banff, Calgary, Cold Lake, Edmonton, Fort McMurray, Lethbridge, Medicine Hat, Red Deer", "SK": "Moose Jaw, Prince Albert, Regina, Saskatoon, Swift Current", "MB": "Brandon, Winnipeg", "QC": "Gatineau, Laval, Montreal, Quebec City, Sherbrooke",
    "NB": "Fredericton, Moncton, Saint John", "NS": "Halifax, Sydney", "PE": "Charlottetown", "NL": "Corner Brook, St. John's", "NT": "Yellowknife", "NU": "Iqaluit", "YT": "Whitehorse",
}
ALIASES = {
    "keele campus": "Toronto", "glendon campus": "Toronto", "st. george (downtown toronto)": "Toronto", "university of toronto mississauga": "Mississauga", "university of toronto scarborough": "Scarborough", "downtown toronto": "Toronto",
    "st catharines": "St. Catharines", "montréal": "Montreal", "st. johns": "St. John's", "ottawa-gatineau": "Ottawa",
}
JUNK = ("", "various", "multiple", "multiple locations", "various locations", "remote", "hybrid", "on-site", "onsite", "canada", "ontario", "tbd", "n/a", "main campus", "head office", "city-wide", "work from home", "virtual")
JUNK_START = ("multiple ", "various ", "remote ", "to be ", "see ")
LABELS = ("job location:", "location:", "primary city:", "job location", "locations")
ENDS = ("department", "employment", "job type", "job category", "job requisition", "close date", "closing date", "posting", "salary", "compensation", "work model", "full/part time", "primary category", "other locations", "time type", "posted on", "remote type", "date posted")
_PROVINCE = "(?:" + "|".join(sorted((x.replace(".", r"\.") for code, names in PROVINCES.items() for x in (code.lower(), *names)), key=len, reverse=True)) + ")"
CANADA, CAMPUS = r"(?i),?\s*canada\.?$", r"(?i),?\s*main campus$"
BRACKETS = rf"(?i)^(.+?)\s*\(({_PROVINCE})\)\s*(?:,\s*[a-z.]{{2,}})?$"
COMMA = rf"(?i)^(.+),\s*({_PROVINCE})\s*(?:,[^,]*)*$"
TAKEN = rf"(?i),\s*({_PROVINCE})\s*(,|$)"
LABEL = "(?i)" + "|".join(rf"\b{x}" for x in LABELS)


def gazetteer(spark: SparkSession) -> DataFrame:
    """The fixed cities and aliases as a table of ``SCHEMA``; a larger one may take its place."""
    known = {c: code for code, names in CITIES.items() for c in names.split(", ")}
    rows = [(c.lower(), c, p, False) for c, p in known.items()] + [(a, c, known[c], True) for a, c in ALIASES.items()]
    return spark.createDataFrame(rows, SCHEMA)


def _code(name: Column) -> Column:
    codes = {n: code for code, names in PROVINCES.items() for n in (code.lower(), *names)}
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in codes.items() for x in pair)), F.lower(F.trim(name)))


def split_places(c: Column) -> Column:
    """The places of a text: between semicolons, else slashes, else ``or``, else commas, where provinces stay with their city."""
    t = collapse(F.coalesce(c, F.lit("")))
    commas = F.transform(F.split(F.regexp_replace(t, TAKEN, "\u0001$1$2"), ","), lambda p: F.replace(p, F.lit("\u0001"), F.lit(", ")))
    parts = F.when(t.contains(";"), F.split(t, ";")).when(t.contains("/"), F.split(t, r"\s*/\s*")).when(t.rlike(r"(?i)\sor\s"), F.split(t, r"(?i)\s+or\s+")).otherwise(commas)
    return F.filter(F.transform(parts, F.trim), lambda p: p != "")


def _junk(name: Column) -> Column:
    return name.isin(*JUNK) | F.exists(F.array(*map(F.lit, JUNK_START)), lambda p: F.startswith(name, p))


def names_of(place: Column) -> Column:
    """array<struct<rank, name, city, province>>: what a place may be known by; a name with a province stands for itself."""

    def parsed(s: Column) -> Column:
        inside, after = s.rlike(BRACKETS), s.rlike(COMMA)
        city = F.when(inside, F.regexp_extract(s, BRACKETS, 1)).when(after, F.regexp_extract(s, COMMA, 1))
        province = F.when(inside, _code(F.regexp_extract(s, BRACKETS, 2))).when(after, _code(F.regexp_extract(s, COMMA, 2)))
        city = F.trim(F.regexp_replace(city, CAMPUS, ""))
        bare = F.regexp_replace(F.lower(F.trim(F.regexp_replace(s, CAMPUS, ""))), "^city of ", "")
        one = lambda rank, name, city, province: F.struct(F.lit(rank).alias("rank"), name.alias("name"), city.cast("string").alias("city"), province.cast("string").alias("province"))
        some = F.array(one(0, F.lower(s), F.lit(None), F.lit(None)), one(1, F.lower(city), city, province), one(2, bare, F.lit(None), F.lit(None)))
        return F.when(_junk(F.lower(s)), F.slice(some, 1, 0)).otherwise(F.filter(some, lambda x: x["name"].isNotNull() & ~_junk(x["name"])))

    return let(F.trim(F.regexp_replace(collapse(place), CANADA, "")), parsed)


def _resolved(names: DataFrame, by: list[str], known: DataFrame) -> DataFrame:
    """``by`` and place of each group's first name that is known or has a province."""
    small = known.limit(BROADCAST + 1).count() <= BROADCAST
    table = known.select("name", F.col("city").alias("known_city"), F.col("province").alias("known_province"), "alias")
    found = names.join(F.broadcast(table) if small else table, "name", "left")
    own = F.concat(F.coalesce(F.when(~F.col("alias"), F.col("known_city")), F.initcap(F.lower("city"))), F.lit(", "), "province")
    place = F.when(F.col("province").isNull() | F.coalesce("alias", F.lit(False)), F.concat("known_city", F.lit(", "), "known_province")).otherwise(own)
    return found.withColumn("place", place).filter("place IS NOT NULL").groupBy(*by).agg(F.min_by("place", F.struct("rank", "place")).alias("place"))


def places(df: DataFrame, key: str, text: str, known: DataFrame) -> DataFrame:
    """(key, places) of each row of ``df`` whose ``text`` names a place: its distinct places in order, joined by semicolons.

    ``known`` is a table of ``gazetteer``'s columns. A place with a province stands as written, any other must be
    known. Null and empty texts and texts without a place have no row; rows with one key count as one text.
    """
    rows = df.select(key, F.posexplode(split_places(F.col(text))).alias("n", "part")).select(key, "n", F.explode(names_of(F.col("part"))).alias("x")).select(key, "n", "x.*")
    each = _resolved(rows, [key, "n"], known).groupBy(key, F.lower("place").alias("same")).agg(F.min(F.struct("n", "place")).alias("first"))
    listed = each.groupBy(key).agg(F.array_sort(F.collect_list("first")).alias("all"))  # the places of one text
    return listed.select(key, F.array_join(F.transform("all", lambda x: x["place"]), "; ").alias("places"))


def labelled_places(df: DataFrame, key: str, text: str, known: DataFrame) -> DataFrame:
    """(key, place): what stands behind the first label that leads to a place, by the order of ``LABELS``, then in the text.

    The value ends before another field's name and after ``WORDS`` words; the longest run of its first words that is
    known, or ends in a province, counts. Texts without one have no row.
    """
    t = collapse(F.coalesce(F.col(text), F.lit("")))
    found = df.select(key, t.alias("t")).select(key, "t", F.explode(matches(F.col("t"), LABEL)).alias("m"))
    rank = F.array_position(F.array(*map(F.lit, LABELS)), F.lower("m.text")).cast("int")
    after = F.ltrim(F.substring(F.col("t"), F.col("m.end") + 1, F.lit(160)))
    value = F.regexp_replace(after, r"(?i)\s*\b(?:" + "|".join(ENDS) + r")\b.*$|\s*\((?:on-site|hybrid|remote)\).*$", "")
    words = F.slice(F.split(value, " "), 1, WORDS)
    rows = found.select(key, rank.alias("label"), F.col("m.start").alias("start"), words.alias("words")).filter("words[0] <> ''")
    runs = rows.select(key, "label", "start", F.explode(F.transform(F.sequence(F.lit(1), F.size("words")), lambda n: F.struct((-n).alias("fewer"), F.regexp_replace(F.array_join(F.slice("words", F.lit(1), n), " "), r"[,;.:]+$", "").alias("run")))).alias("r"))
    names = runs.select(key, "label", "start", "r.fewer", F.explode(names_of(F.col("r.run"))).alias("x"))
    ranked = names.select(key, F.struct("label", "start", "fewer", "x.rank").alias("rank"), "x.name", "x.city", "x.province")
    return _resolved(ranked, [key], known)
