"""Substring search for a table of patterns, as equi-joins on character grams.

A LIKE between two tables would be a nested loop over all pairs. Here a pattern is looked up through
one gram of its literal text, the one that the searched rows contain least often among the longest it
has; the LIKE itself then decides on the rows that share this gram. The result equals the nested loop: a
row that matches a pattern contains every gram of the pattern's literal text. Long grams keep the rows
that share one few when rows and patterns grow together. Patterns without two literal characters in a
row use the empty gram, which every row has. Terms with the same pattern share its rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from wardline.functions.ordering import top_per, up
from wardline.functions.text import plain_pattern, strip
from wardline.sources.staging import cut
from wardline.sources.tables import Hospital


def _grams(text: Column, size: int) -> Column:
    starts = F.sequence(F.lit(1), F.length(text) - (size - 1))
    cut = F.transform(starts, lambda i: F.substr(text, i, F.lit(size)))
    return F.when(F.length(text) >= size, F.array_distinct(cut)).otherwise(F.array().cast("array<string>"))


# Up to so many patterns go to every task; beyond that both sides are shuffled by gram.
BROADCAST_PATTERNS = 200_000

# Lengths of grams, the longest first: the shorter ones are for patterns without longer literal text.
_SIZES = (8, 5, 3, 2)


def _row_grams(text: Column) -> Column:
    return F.concat(*(_grams(text, size) for size in _SIZES), F.array(F.lit("")))


def _pattern_grams(pattern: Column) -> Column:
    runs = F.split(pattern, r"[%_\\]")

    def grams(size: int) -> Column:
        return F.array_distinct(F.flatten(F.transform(runs, lambda r: _grams(r, size))))

    chosen = F.array(F.lit(""))
    for size in reversed(_SIZES):
        chosen = F.when(F.size(grams(size)) > 0, grams(size)).otherwise(chosen)
    return chosen


def like_pairs(
    rows: DataFrame, text: str, patterns: DataFrame, pattern: str, *, order: Sequence[Column] = (), n: int | None = None
) -> DataFrame:
    """Inner join of rows and patterns on `text LIKE pattern`; both sides keep their columns.

    With n, only the first n rows of a pattern by `order` are joined, before patterns that occur more than once are.
    """
    wanted = patterns.filter(F.col(pattern).isNotNull())
    asked = wanted.select(pattern).distinct().withColumn("_gram", F.explode(_pattern_grams(F.col(pattern))))
    # a few files of short rows become many grams: they are dealt out first
    carried = rows.filter(F.col(text).isNotNull()).repartition(text).withColumn("_gram", F.explode(_row_grams(F.col(text))))
    relevant = carried.select("_gram").join(asked.select("_gram").distinct(), "_gram", "left_semi")
    often = relevant.groupBy("_gram").agg(F.count("*").alias("_often"))
    key = cut(
        asked.join(often, "_gram", "left")
        .groupBy(pattern)
        .agg(F.min_by("_gram", F.struct(F.coalesce("_often", F.lit(0)), F.col("_gram"))).alias("_gram"))
    )
    # Spark takes the grams for as small as the rows that they come from, and would broadcast them.
    side = "broadcast" if key.count() <= BROADCAST_PATTERNS else "merge"
    found = carried.join(key.hint(side), "_gram").filter(F.expr(f"`{text}` like `{pattern}`")).drop("_gram")
    if n is not None:
        found = top_per(found, pattern, order, n).drop("rank")
    return found.join(wanted, pattern)


def search_patients(
    h: Hospital, terms: DataFrame, *, n: int | None = 10, min_chars: int = 2, match_id: bool = True
) -> DataFrame:
    """terms: term_id, term. Patients whose name or phone contains the term or, with match_id, whose id is
    the term; the first n by name for each term (None: all of them, unranked)."""
    asked = terms.filter(F.length(strip("term")) >= min_chars)
    by_name = asked.select("term_id", F.lower(plain_pattern(F.col("term"))).alias("_pattern"))
    by_phone = asked.select("term_id", plain_pattern(F.col("term")).alias("_pattern"))
    by_id = asked.select("term_id", strip("term").alias("_id"))
    base = h.patients.select("patient_id", "full_name", "phone")
    keep = ["term_id", "patient_id", "full_name"]
    order = [up("full_name"), up("patient_id")]

    def first(found: DataFrame) -> DataFrame:
        # the first n of all are among the first n of each way of finding them
        return found.select(*keep) if n is None else top_per(found.select(*keep), "term_id", order, n).drop("rank")

    def found(text: Column, patterns: DataFrame) -> DataFrame:
        # a term has one pattern, so the first n of the pattern are the first n of the term
        pairs = like_pairs(base.withColumn("_text", text), "_text", patterns, "_pattern", order=order, n=n)
        return pairs.select(*keep)

    hits = found(F.lower("full_name"), by_name).unionByName(found(F.col("phone"), by_phone))
    if match_id:
        hits = hits.unionByName(first(base.withColumn("_id", F.col("patient_id").cast("string")).join(by_id, "_id")))
    hits = hits.distinct()
    if n is not None:
        hits = top_per(hits, "term_id", order, n)
    shown = ("full_name", "phone", "date_of_birth", "blood_group", "gender", "status", "email", "address", "emergency_contact",
             "registration_date", "insurance_id")
    details = h.patients.select("patient_id", *[c for c in shown if c in h.patients.columns])
    policies = h.insurance.select("insurance_id", "provider_name", "policy_number", "coverage_amount", "expiry_date")
    return hits.drop("full_name").join(details, "patient_id").join(policies, "insurance_id", "left").drop("insurance_id")


def link_users_to_doctors(h: Hospital) -> DataFrame:
    """The doctor a user account stands for: its staff reference if that doctor exists, else the doctor
    whose name contains the account's name part (the lowest id if several do)."""
    users = h.users.select("user_id", "username", "staff_ref_id")
    direct = users.join(
        h.doctors.select(F.col("doctor_id").alias("staff_ref_id"), F.col("doctor_id").alias("_direct")), "staff_ref_id", "left"
    )
    part = F.lower("username")
    for old, new in (("dr_", ""), ("dr.", ""), ("_", " ")):
        part = F.replace(part, F.lit(old), F.lit(new))
    named = direct.withColumn("_part", F.when(F.length(strip(part)) > 0, strip(part)))
    patterns = (
        named.filter(F.col("_direct").isNull() & F.col("_part").isNotNull())
        .select("_part", F.lower(plain_pattern(F.col("_part"))).alias("_pattern"))
        .distinct()
    )
    names = h.doctors.select("doctor_id", F.lower("full_name").alias("_text"))
    resolved = like_pairs(names, "_text", patterns, "_pattern").groupBy("_part").agg(F.min("doctor_id").alias("_named"))
    return named.join(resolved, "_part", "left").select(
        "user_id", "username", F.coalesce("_direct", "_named").alias("doctor_id")
    )
