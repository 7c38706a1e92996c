"""Amounts of pay: from text, and as shown to readers."""
from pyspark.sql import Column
from pyspark.sql import functions as F


def pay_range(text: Column) -> Column:
    """struct<low, high> of the first and the last dollar amount; one amount is both, none is null."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"\$(\d{1,3}(?:,\d{3})*(?:\.\d{1,4})?)"), F.lit(1)), lambda x: F.regexp_replace(x, ",", "").try_cast("double"))
    return F.struct(F.get(found, F.lit(0)).alias("low"), F.get(found, F.size(found) - 1).alias("high"))


def shown(low: Column, high: Column, period: Column) -> Column:
    """``$60K – $80K / yr`` and the like: hourly amounts in full, flat ones whole, others in thousands."""
    plain = lambda x: F.regexp_replace(F.format_string("%.2f", x.cast("double")), r"\.?0+$", "")
    one = lambda x: F.when(period == "hourly", F.concat(F.lit("$"), plain(x), F.lit("/hr"))).when(period == "flat", F.concat(F.lit("$"), F.format_number(F.round(x), 0))).otherwise(F.concat(F.lit("$"), F.round(x / 1000).cast("int").cast("string"), F.lit("K")))
    unit = F.when(period == "hourly", "").when(period == "monthly", " / mo").when(period == "flat", " flat").otherwise(" / yr")
    a, b = F.nullif(low.cast("double"), F.lit(0.0)), F.nullif(high.cast("double"), F.lit(0.0))
    span = F.when(a.isNull() | b.isNull() | (a == b), one(F.coalesce(a, b))).otherwise(F.concat(one(a), F.lit(" – "), one(b)))
    return F.when(a.isNotNull() | b.isNotNull(), F.concat(span, unit))
