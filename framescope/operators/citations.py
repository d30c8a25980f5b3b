"""Evidence against what it cites: does the quoted text stand in the cited row, and in how many rows of its source does it stand."""

from __future__ import annotations

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framescope.functions.scalars import squeezed


def verify_citations(evidence: DataFrame, rows: DataFrame, least: int = 12, most_places: int = 3, part_rows: int = 20_000) -> DataFrame:
    """evidence (bundle_id, source, ref, quote, auto) with eligible, valid, places and ambiguous.

    rows: (bundle_id, source, ref, text). A quote is eligible with `least` non-blank characters, valid if a row that it refers to holds it (white space
    squeezed), ambiguous if it isn't automatic and more than most_places rows of its source hold it. The row referred to is met by equality alone.
    Places are counted by one automaton of a source's quotes in one pass over its rows, which are dealt into parts of about part_rows; each part
    gives a count for each quote that it holds.
    """
    cited = evidence.withColumn("_q", squeezed(F.col("quote")))
    texts = rows.where(F.col("text").isNotNull()).select("bundle_id", "source", F.col("ref").alias("_ref"), squeezed(F.col("text")).alias("_t"))
    quotes = cited.where("_q <> ''").select("bundle_id", "source", "_q").distinct()
    key = ["bundle_id", "source"]
    sizes = texts.groupBy(*key).agg(F.ceil(F.count("*") / part_rows).cast("int").alias("_parts"))
    dealt = texts.join(sizes, key).select(*(F.col(c).alias(f"_t_{c}") for c in key), "_t", F.pmod(F.xxhash64("_ref", "_t"), F.col("_parts")).cast("int").alias("_part"))
    asked = quotes.join(sizes, key).select(*(F.col(c).alias(f"_q_{c}") for c in key), "_q", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in key)

    def count(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found: dict[str, int] = {}
        automaton = ahocorasick.Automaton()
        for quote in right["_q"]:
            automaton.add_word(quote, quote)
        automaton.make_automaton()
        for text in left["_t"] if len(automaton) else ():
            for quote in {q for _, q in automaton.iter(text)}:
                found[quote] = found.get(quote, 0) + 1
        out = pd.DataFrame({"_q": list(found), "_n": list(found.values())})
        for c in key:
            out[c] = left[f"_t_{c}"].iloc[0] if len(found) else None
        return out[[*key, "_q", "_n"]]

    counted = dealt.groupBy(*(f"_t_{c}" for c in key), "_part").cogroup(asked.groupBy(*(f"_q_{c}" for c in key), "_part")).applyInPandas(count, f"{kinds}, _q string, _n long")
    places = counted.groupBy(*key, "_q").agg(F.sum("_n").alias("places"))
    pointed = cited.where("_q <> ''").select(*key, "ref", "_q").distinct()
    at = pointed.join(texts.withColumnRenamed("_ref", "ref"), [*key, "ref"]).where(F.contains("_t", "_q")).select(*key, "ref", "_q", F.lit(True).alias("_hit")).distinct()
    out = cited.join(places, [*key, "_q"], "left").join(at, [*key, "_q", "ref"], "left")
    eligible = F.length(F.regexp_replace("quote", r"\s", "")) >= least
    out = out.withColumns({"eligible": F.coalesce(eligible, F.lit(False)), "places": F.coalesce("places", F.lit(0))})
    return out.select(*evidence.columns, "eligible", (F.col("eligible") & F.coalesce("_hit", F.lit(False))).alias("valid"), "places", (~F.col("auto") & (F.col("places") > most_places)).alias("ambiguous"))


def citation_counts(verified: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: valid, invalid, ambiguous, eligible and automatic citations, and whether all are valid (false without any)."""
    found = verified.groupBy(*keys).agg(F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("invalid"), F.count_if("ambiguous").alias("ambiguous"), F.count_if("eligible").alias("eligible"), F.count_if("auto").alias("automatic"))
    return found.withColumn("all_valid", (F.col("invalid") == 0) & (F.col("valid") > 0))
