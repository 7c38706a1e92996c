"""Secrets in texts: three fixed patterns, and windows of high entropy.

Everything is column expressions. A pattern's matches and what lies between them alternate, so running
lengths of both give positions in code points. Candidate strings for the entropy scan are runs of token
characters; a window slides over each, and its integer sum of c * log2(c) changes by the counts of the character
that comes in and of the one that goes out, so results don't depend on rounding. The bits that a window needs
follow from the classes of its characters. Time grows in proportion to the text, whatever its runs are like.
"""
from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harborline.llm.common import documents, free_name
from harborline.llm.registry import query

# Fixed patterns of the base kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # 16 characters or more
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "entropy")
SCALE = 1_000_000


@dataclass(frozen=True)
class Entropy:
    """Candidates have ``window`` characters or more. A window counts as secret from so many bits of entropy per
    character on: by whether it has digits only, hexadecimal digits only, two of lower case, upper case and
    digits, or letters of one case. What base spans leave of a secret span counts from ``least`` characters on."""

    window: int = 20
    least: int = 8
    digit_bits: float = 3.1
    hex_bits: float = 3.0
    mixed_bits: float = 3.75
    letter_bits: float = 4.1


#: What never counts. A window counts only if it touches a part between separators that isn't plain: a word, words in
#: camel case, capitals, a short number. Whole candidates: UUIDs, and embedded images of 100 characters or more.
SEPARATOR = "[/_+=-]"
PLAIN = r"^(?:[A-Za-z][a-z]{0,18}[0-9]{0,2}|[a-z]{0,19}(?:[A-Z][a-z]{1,18}){0,8}[0-9]{0,2}|[A-Z]{1,19}|[0-9]{1,4})$"
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
IMAGE = r"^(?:iVBORw0KGgo|R0lGOD|/9j/)"
IMAGE_LENGTH = 100
#: Elements that one step of a running fold copies.
BLOCK = 1024
#: What the entropy scan carries from character to character, besides the first and last hit.
FIELDS = ("window", "sum", "lower", "upper", "digit", "hex", "odd")


def _let(value: Column, use) -> Column:
    """``use`` of ``value``, which is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(values: Column, combine) -> Column:
    """For each of ``values`` (array<int>) the fold of all before it, from 0 on: within blocks, and over the blocks."""

    def fold(some: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<int>)").alias("before"))
        return F.aggregate(some, start, lambda acc, x: F.struct(combine(acc["at"], x).alias("at"), F.concat(acc["before"], F.array(acc["at"])).alias("before")))

    def blocks(all_values: Column) -> Column:
        n = F.floor((F.size(all_values) - 1) / BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), n), lambda k: fold(F.slice(all_values, k * BLOCK + 1, F.lit(BLOCK))))

    def joined(parts: Column) -> Column:
        heads = fold(F.transform(parts, lambda b: b["at"]))["before"]
        return F.flatten(F.zip_with(parts, heads, lambda b, head: F.transform(b["before"], lambda x: combine(head, x))))

    return _let(values, lambda v: F.when(F.size(v) > 0, _let(blocks(v), joined)).otherwise(F.expr("CAST(array() AS array<int>)")))


def _spans(text: Column, pattern: str, kind: str, found: Column) -> Column:
    """array<struct<start, rank, end, kind, body>> of the matches of ``pattern`` in ``text`` where ``found`` holds."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    item = "array<struct<start:int,rank:int,end:int,kind:string,body:string>>"

    def placed(both: Column) -> Column:
        sizes = F.zip_with(both["m"], F.slice(both["g"], F.lit(1), F.size(both["m"])), lambda m, g: F.length(m) + g)

        def span(m: Column, i: Column, before: Column) -> Column:
            begin = F.get(before, i) + F.get(both["g"], i)
            return F.struct(begin.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), (begin + F.length(m)).alias("end"), F.lit(kind).alias("kind"), m.alias("body"))

        return _let(_running(sizes, lambda a, b: a + b), lambda before: F.transform(both["m"], lambda m, i: span(m, i, before)))

    return F.when(found, _let(F.struct(matches.alias("m"), gaps.alias("g")), placed)).otherwise(F.expr(f"CAST(array() AS {item})"))


def _odd(body: Column) -> Column:
    """1 for each character of a part that isn't plain, 0 for all others and for the end."""
    part = lambda p: F.concat(F.array_repeat(F.when(p.rlike(PLAIN), F.lit(0)).otherwise(F.lit(1)), F.length(p)), F.array(F.lit(0)))
    return F.flatten(F.transform(F.split(body, SEPARATOR, -1), part))


def _dense(body: Column, settings: Entropy) -> Column:
    """struct<first, last> of the windows of ``body`` with enough entropy (first: -1 if none)."""
    w = settings.window
    f = [round(SCALE * c * math.log2(c)) if c else 0 for c in range(w + 1)]
    growth = F.array(*(F.lit(z - a) for a, z in zip(f, f[1:])))  # of the sum, when a character with that count comes in

    def most(bits: float) -> Column:  # sum of c * log2(c) up to which the entropy is at least bits
        return F.lit(math.floor(SCALE * w * (math.log2(w) - bits)))

    def scan(v: Column) -> Column:
        codes, odd, grow = v["codes"], v["odd"], v["growth"]

        def counted(acc: Column, i: Column, x: Column) -> Column:
            """The sum, the window's codes and the counts by class after code ``x.come`` came in and ``x.go`` went out."""
            times = lambda code: F.size(F.filter(x["stay"], lambda y: y == code))
            total = acc["sum"] + F.get(grow, times(x["come"])) - F.when(i >= w, F.get(grow, times(x["go"]))).otherwise(F.lit(0))
            within = lambda c, a, z: c.between(ord(a), ord(z))
            kinds = {
                "lower": lambda c: within(c, "a", "z"), "upper": lambda c: within(c, "A", "Z"), "digit": lambda c: within(c, "0", "9"),
                "hex": lambda c: within(c, "0", "9") | within(c, "a", "f") | within(c, "A", "F"),
            }
            n = [(acc[k] + has(x["come"]).cast("int") - has(x["go"]).cast("int")).alias(k) for k, has in kinds.items()]
            odds = acc["odd"] + F.get(odd, i) - F.when(i >= w, F.get(odd, i - w)).otherwise(F.lit(0))
            return F.struct(F.concat(x["stay"], F.array(x["come"])).alias("window"), total.alias("sum"), *n, odds.alias("odd"))

        def judged(acc: Column, i: Column, n: Column) -> Column:
            several = sum(((n[k] > 0).cast("int") for k in ("lower", "upper", "digit")), F.lit(0)) >= 2
            limit = F.when(n["digit"] == w, most(settings.digit_bits)).when(n["hex"] == w, most(settings.hex_bits)).when(several, most(settings.mixed_bits)).otherwise(most(settings.letter_bits))
            hit = (i >= w - 1) & (n["odd"] > 0) & (n["sum"] <= limit)
            at = F.when(~hit, F.struct(acc["first"].alias("first"), acc["last"].alias("last"))).otherwise(F.struct(F.when(acc["first"] < 0, i - (w - 1)).otherwise(acc["first"]).alias("first"), (i + 1).alias("last")))
            return _let(at, lambda x: F.struct(*(n[k].alias(k) for k in FIELDS), x["first"].alias("first"), x["last"].alias("last")))

        def step(acc: Column, i: Column) -> Column:
            stay = F.when(i >= w, F.slice(acc["window"], 2, w - 1)).otherwise(acc["window"])  # slicing codes would copy all of them
            moved = F.struct(stay.alias("stay"), F.get(codes, i).alias("come"), F.when(i >= w, F.get(codes, i - w)).otherwise(F.lit(-1)).alias("go"))
            return _let(_let(moved, lambda x: counted(acc, i, x)), lambda n: judged(acc, i, n))

        zero = F.lit(0)
        state = F.struct(F.expr("CAST(array() AS array<int>)").alias("window"), *(zero.alias(k) for k in FIELDS[1:]), F.lit(-1).alias("first"), F.lit(-1).alias("last"))
        return F.aggregate(F.sequence(zero, F.size(codes) - 1), state, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))

    codes = F.transform(F.split(body, ""), lambda c: F.ascii(c))
    nothing = F.struct(F.lit(-1).alias("first"), F.lit(-1).alias("last"))
    return _let(_odd(body), lambda odd: F.when(F.array_contains(odd, 1), _let(F.struct(codes.alias("codes"), odd.alias("odd"), growth.alias("growth")), scan)).otherwise(nothing))


def _candidate(body: Column) -> Column:
    return ~body.rlike(UUID) & ~(body.rlike(IMAGE) & (F.length(body) >= IMAGE_LENGTH))


def find_secrets(docs: DataFrame, settings: Entropy = Entropy(), column: str = "secrets") -> DataFrame:
    """``docs`` with ``column``: array<struct<start, rank, end, kind>> by start, then kind.

    Base kinds are leftmost and don't overlap within a kind; spans count code points, ends exclusive. An
    entropy span reaches from the first to the last dense window of a candidate; base spans are cut out of it,
    and what is left counts from ``least`` characters on. A null or empty text has none; equal rows get equal spans; an empty table gives
    no rows; texts are read whole; a column that ``docs`` has by the name ``column`` gives way.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = F.struct
    assign = _spans(text, ASSIGN, "assign", (text.contains(":") | text.contains("=")) & text.rlike(ASSIGN))
    assign = F.filter(assign, lambda s: F.length(F.regexp_extract(s["body"], ASSIGN, 2)) >= 8)
    access = _spans(text, ACCESS, "access", text.contains("AKIA"))
    hexes = _spans(text, HEX, "hex", text.rlike(HEX))
    run = f"[A-Za-z0-9+/_-]{{{settings.window},}}={{0,2}}"
    candidates = F.filter(_spans(text, run, "entropy", text.rlike(run)), lambda s: _candidate(s["body"]))
    dense = F.transform(candidates, lambda s: plain(s["start"].alias("at"), _dense(s["body"], settings).alias("w")))
    dense = F.transform(F.filter(dense, lambda s: s["w"]["first"] >= 0), lambda s: plain((s["at"] + s["w"]["first"]).alias("start"), F.lit(3).alias("rank"), (s["at"] + s["w"]["last"]).alias("end"), F.lit("entropy").alias("kind")))
    drop_body = lambda spans: F.transform(spans, lambda s: plain(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    base = F.array_sort(F.concat(drop_body(assign), drop_body(access), drop_body(hexes)))

    def rest(d: Column, base: Column) -> Column:
        """What base spans leave of a dense span."""
        inner = F.filter(base, lambda b: (b["start"] < d["end"]) & (d["start"] < b["end"]))
        begins = F.concat(F.array(d["start"]), F.transform(inner, lambda b, i: F.array_max(F.transform(F.slice(inner, F.lit(1), i + 1), lambda x: x["end"]))))
        ends = F.concat(F.transform(inner, lambda b: b["start"]), F.array(d["end"]))
        cut = F.zip_with(begins, ends, lambda x, y: plain(x.alias("start"), F.lit(3).alias("rank"), y.alias("end"), F.lit("entropy").alias("kind")))
        return F.filter(cut, lambda x: (x["end"] - x["start"] >= settings.least) | ((x["start"] == d["start"]) & (x["end"] == d["end"])))

    both = F.transform(F.array(plain(base.alias("base"), dense.alias("dense"))), lambda x: F.array_sort(F.concat(x["base"], F.flatten(F.transform(x["dense"], lambda d: rest(d, x["base"]))))))
    return docs.withColumn(column, F.get(both, F.lit(0)))


def redact(docs: DataFrame, settings: Entropy = Entropy(), mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret span of ``text`` replaced by ``mark``; overlapping spans become one mark.

    Columns and rows stay; a null text stays null; texts are read whole, however long; an empty table stays empty.
    """
    name = free_name(docs, "secrets")
    found = find_secrets(docs, settings, name)

    def pieces(before: Column) -> Column:
        """What lies before each span and its mark; spans that begin inside an earlier one give nothing."""
        at = lambda i: F.get(before, i)
        return F.transform(F.col(name), lambda s, i: F.when(s["start"] < at(i), F.lit("")).otherwise(F.concat(F.substring(F.col("text"), at(i) + 1, s["start"] - at(i)), F.lit(mark))))

    ends = F.transform(F.col(name), lambda s: s["end"])
    rebuilt = F.concat(F.array_join(_let(_running(ends, F.greatest), pieces), ""), F.substring(F.col("text"), F.array_max(ends) + 1, F.length("text")))
    return found.withColumn("text", F.when(F.size(name) > 0, rebuilt).otherwise(F.col("text"))).select(*docs.columns)


def _joined(spans) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


@query("op9_secret_scans")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "secrets")

    def count(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("secrets", lambda s: s["kind"] != "entropy")
    return found.select("doc_id", *(count(k) for k in KINDS[:3]), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("secrets")).alias("spans"))
