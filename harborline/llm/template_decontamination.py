"""Documents that hold benchmark items, also with other numbers, names or units filled in.

Everything is column expressions. Words become template words: numbers, names (a capital and small
letters within a sentence) and units turn into typed placeholders. A passage counts from ``run`` words in a
row on, so it is enough to hash every ``stride``-th window of ``run - stride + 1`` words of a document and
all windows of the items: each long enough passage holds such a window. A window is hashed by its literal
words, whatever their case, and if it has enough words that are no placeholders also by its template. Where
hashes meet, the words around are compared on that diagonal: words match as they are or as template words,
and what fills the placeholders of a run must map one to one between item and document. A run in which it
doesn't counts only the words that are equal as they are, in its longest consistent part.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harborline.llm.common import documents, stored
from harborline.llm.registry import query

UNITS = (
    "mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles", "mg", "g", "kg", "lb", "lbs", "ton", "tons",
    "ml", "l", "litre", "litres", "liter", "liters", "gallon", "gallons", "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days",
    "week", "weeks", "month", "months", "year", "years", "dollar", "dollars", "euro", "euros", "cent", "cents", "percent", "degree", "degrees",
)
EDGE = ".,;:!?\"'()[]{}$€£%#+-"


@dataclass(frozen=True)
class Settings:
    """``run`` template words in a row are a match (an item with fewer: all of it); with ``stride`` every
    so-manieth window of a document is hashed; windows with fewer than ``plain`` words that are no placeholders
    are hashed by their literal words alone;
    a benchmark of up to ``broadcast`` windows goes to all tasks, a larger one is joined by a shuffle."""

    run: int = 13
    stride: int = 4
    plain: int = 4
    broadcast: int = 500_000


def _words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _let(value: Column, use) -> Column:
    """``use(value)``, with ``value`` computed once a row wherever ``use`` reads it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _template(raw: Column, cores: Column) -> Column:
    def canonical(core: Column, i: Column) -> Column:
        before = F.substring(F.get(raw, i - 1), -1, 1)
        rest = core.substr(F.lit(2), F.length(core))
        name = (core >= "A") & (core < "[") & (rest != "") & (rest == F.lower(rest)) & ~F.coalesce(before.isin(".", "!", "?", ":"), F.lit(True))
        low = F.lower(core)
        return F.when((core >= "0") & (core < ":"), F.lit("<number>")).when(name, F.lit("<name>")).when(low.isin(*UNITS), F.lit("<unit>")).otherwise(low)

    return F.transform(cores, canonical)


def _parts(text: Column, use) -> Column:
    """``use(cores, template)``: the words of ``text`` without marks at their edges, and as template words."""
    return _let(_words(text), lambda raw: _let(F.transform(raw, lambda w: F.btrim(w, F.lit(EDGE))), lambda cores: _let(_template(raw, cores), lambda template: use(cores, template))))


def _windows(df: DataFrame, key: str, at: str, size: int, stride: int, plain: int) -> DataFrame:
    """(key, at, hash) of every ``stride``-th window of ``size`` words: by literal words, and by template."""

    def hashes(cores: Column, t: Column) -> Column:
        def both(low: Column) -> Column:
            def one(i: Column) -> Column:
                window = F.slice(t, i + 1, F.lit(size))
                enough = F.size(F.filter(window, lambda w: ~w.startswith("<"))) >= plain
                return F.array(F.xxhash64(F.slice(low, i + 1, F.lit(size))), F.when(enough, F.xxhash64(F.lit("template"), window)))

            return F.flatten(F.transform(F.sequence(F.lit(0), F.size(t) - size, F.lit(stride)), one))

        return F.when(F.size(t) >= size, _let(F.transform(cores, F.lower), both))

    out = df.select(key, F.posexplode(_parts(F.col("text"), hashes)).alias("__i", "hash"))
    return out.filter("hash IS NOT NULL").select(key, (F.floor(F.col("__i") / 2) * stride).cast("int").alias(at), "hash")


def find_leaks(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, item_id, run): the items that a document holds, with how many words the longest run counts.

    A null or empty text and a document without a match have no row. Equal documents have equal rows, rows with one id count as one document, a null id is
    reported as null. Empty tables give no rows; texts are read whole; other columns are ignored.
    """
    s = settings
    columns = lambda cores, template: F.struct(cores.alias("cores"), template.alias("template"))
    items = stored(benchmark.select("item_id", "text", _parts(F.col("text"), columns).alias("parts")), "items").select("item_id", "text", "parts.*").filter("size(template) > 0")
    source = docs.select("doc_id", "text")
    short = [r[0] for r in items.filter(F.size("template") < s.run).select(F.size("template")).distinct().collect()]  # fewer than ``run`` rows
    hits = None
    for size, stride, part in [(s.run - s.stride + 1, s.stride, items.filter(F.size("template") >= s.run)), *((k, 1, items.filter(F.size("template") == k)) for k in sorted(short))]:
        wanted = stored(_windows(part, "item_id", "j", size, 1, min(s.plain, size)), "windows")
        n = wanted.count()
        if n:
            found = _windows(source, "doc_id", "i", size, stride, min(s.plain, size)).join(F.broadcast(wanted) if n <= s.broadcast else wanted, "hash").select("doc_id", "item_id", (F.col("i") - F.col("j")).alias("shift")).distinct()
            hits = found if hits is None else hits.union(found)
    if hits is None:
        return docs.sparkSession.createDataFrame([], T.StructType([docs.schema["doc_id"], benchmark.schema["item_id"], T.StructField("run", T.LongType())]))
    by_doc = stored(hits, "hits").distinct().groupBy(F.col("doc_id").alias("__id")).agg(F.collect_list(F.struct("item_id", "shift")).alias("hits"))  # bounded by the document
    met = source.join(by_doc.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("__id")))
    met = stored(met.select("doc_id", "hits", _parts(F.col("text"), columns).alias("d")), "met").select("doc_id", "d", F.explode("hits").alias("hit"))
    both = met.join(items.drop("text"), F.col("hit.item_id") == F.col("item_id"))
    shift = F.col("hit.shift")
    from_, off = F.greatest(shift, F.lit(0)), F.greatest(-shift, F.lit(0))
    n = F.greatest(F.least(F.size("d.template") - from_, F.size("template") - off), F.lit(0))
    part = lambda column, at: F.slice(column, at + 1, n)
    pairs = F.arrays_zip(part("d.template", from_).alias("d"), part("template", off).alias("b"), part("d.cores", from_).alias("dc"), part("cores", off).alias("bc"))

    slot = "struct<at:int,d:string,b:string,literal:int>"

    def value(acc: Column) -> Column:
        """What the run that ends here counts."""
        return F.when(acc["clean"], acc["at"] - acc["first"]).otherwise(acc["most"])

    def step(acc: Column, p: Column) -> Column:
        """first, start: where the run and its consistent part began; literal, before: words that are equal as they
        are, in all and before the consistent part; most: in the best of the run's parts."""
        d, b = F.lower(p["dc"]), F.lower(p["bc"])
        met, filled = (p["d"] == p["b"]) | (d == b), p["d"].startswith("<") | p["b"].startswith("<")
        clash = F.filter(acc["slots"], lambda x: (x["at"] >= acc["start"]) & ((x["d"] == d) != (x["b"] == b)))
        last = F.when(met & filled, F.element_at(F.when(F.size(clash) > 0, clash), -1))
        literal = acc["literal"] + (met & (d == b)).cast("int")
        before = F.when(~met, literal).otherwise(F.coalesce(last["literal"], acc["before"]))
        here = F.struct(acc["at"].alias("at"), d.alias("d"), b.alias("b"), literal.alias("literal"))
        return F.struct(
            (acc["at"] + 1).alias("at"), F.when(met, acc["first"]).otherwise(acc["at"] + 1).alias("first"), F.when(~met, acc["at"] + 1).otherwise(F.coalesce(last["at"] + 1, acc["start"])).alias("start"),
            (~met | (acc["clean"] & last.isNull())).alias("clean"), literal.alias("literal"), before.alias("before"), F.when(met, F.greatest(acc["most"], literal - before)).otherwise(0).alias("most"),
            F.when(met, acc["best"]).otherwise(F.greatest(acc["best"], value(acc))).alias("best"), F.when(met & filled, F.concat(acc["slots"], F.array(here))).otherwise(acc["slots"]).alias("slots"),
        )

    zeros = {c: F.lit(0).alias(c) for c in ("at", "first", "start", "clean", "literal", "before", "most", "best")} | {"clean": F.lit(True).alias("clean")}
    begin = F.struct(*zeros.values(), F.expr(f"CAST(array() AS array<{slot}>)").alias("slots"))
    judged = both.select("doc_id", "item_id", F.size("template").alias("n_item"), F.aggregate(pairs, begin, step, lambda acc: F.greatest(acc["best"], value(acc))).alias("run"))
    return judged.filter(F.col("run") >= F.least(F.lit(s.run), "n_item")).groupBy("doc_id", "item_id").agg(F.max("run").cast("long").alias("run"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; columns and other rows stay."""
    leaks = find_leaks(docs, benchmark, settings).select("doc_id").distinct().alias("leaks")
    return docs.alias("docs").join(leaks, F.col("docs.doc_id").eqNullSafe(F.col("leaks.doc_id")), "left_anti")


@query("op1_template_decontamination")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
