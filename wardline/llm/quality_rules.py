"""Quality rules: a table of thresholds compiled into one Spark projection.

Everything is built-in column functions over a single row: no user function, no shuffle. Values that are
used more than once inside a row are bound with a one-element `transform`, so that they are computed once.

Words are runs of anything but ASCII white space. The measures:

  n_words, word_chars   words, and code points in them
  n_symbols             characters of the symbol set
  n_dup_lines           lines with a word that equal an earlier line
  n_repeat_words        words inside five-word windows that occur twice or more, the first included
  n_stop_words          words of the stop list, with or without a capital
  n_lines, n_mark_lines lines with a word, and those that end in a full stop, question or exclamation mark
  n_upper               upper-case letters

A rule is a ratio of two measures with a lower and an upper bound, applied where the denominator reaches a
least size. A text is kept if it passes the base rules (ten words, at most a fifth repeated words) and the
rules of the table. A null text counts as empty; an empty text has zero measures and fails the base rules.
Windows are told apart by a 64-bit hash within one text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

WINDOW = 5

# Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "au dans de des du elle en est et il la le les ou par pour que qui sur un une "
    "als auch auf das dem den der die ein eine ist mit nicht sie und von zu "
    "como con del el las lo los no para por se su una y"
).split()

#: Forms counted: as listed, and with a capital.
STOP_FORMS = sorted({f for w in STOP_WORDS for f in (w, w.capitalize())})

SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """part / whole has to lie in [low, high] where whole is at least `since`."""

    name: str
    part: str
    whole: str
    low: float | None = None
    high: float | None = None
    since: int = 1


#: The threshold table.
RULES = (
    Rule("word_length", "word_chars", "n_words", 2.0, 12.0),
    Rule("symbols", "n_symbols", "n_words", None, 0.1),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 0.3),
    Rule("stop_words", "n_stop_words", "n_words", 0.06, None),
    Rule("closed_lines", "n_mark_lines", "n_lines", 0.1, None),
    Rule("upper_case", "n_upper", "word_chars", None, 0.3),
)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once per row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words covered by windows that occur at least twice in the list."""

    def covered(places: Column) -> Column:
        # places: sorted starts of repeated windows; each covers up to the next start, at most a window
        steps = F.zip_with(
            places,
            F.slice(places, 2, F.size(places)),
            lambda here, after: F.least(F.coalesce(after - here, F.lit(window)), F.lit(window)),
        )
        return F.aggregate(steps, F.lit(0), lambda total, step: total + step)

    def starts(ordered: Column) -> Column:
        same = lambda i, j: F.get(ordered, i)["h"] == F.get(ordered, j)["h"]
        marked = F.transform(
            ordered,
            lambda x, i: F.when(F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)), x["i"]),
        )
        return F.array_sort(F.array_compact(marked))

    def of_hashes(hashes: Column) -> Column:
        pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
            bound(F.sort_array(pairs), lambda ordered: bound(starts(ordered), covered))
        )

    def of_words(hashed: Column) -> Column:
        windows = F.transform(
            F.slice(hashed, 1, F.size(hashed) - F.lit(window - 1)),
            lambda x, i: F.xxhash64(x, *(F.get(hashed, i + k) for k in range(1, window))),
        )
        return bound(windows, of_hashes)

    return F.when(F.size(words) < window + 1, F.lit(0)).otherwise(
        bound(F.transform(words, lambda w: F.xxhash64(w)), of_words)
    )


def measures(text: Column) -> Column:
    """One struct with all measures of a text."""

    def of_words(t: Column, words: Column) -> Column:
        return bound(
            F.filter(F.split(t, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")),
            lambda lines: F.struct(
                F.size(words).cast("long").alias("n_words"),
                F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
                F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
                (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
                repeated_words(words).cast("long").alias("n_repeat_words"),
                F.size(F.filter(words, lambda w: w.isin(*STOP_FORMS))).cast("long").alias("n_stop_words"),
                F.size(lines).cast("long").alias("n_lines"),
                F.size(F.filter(lines, lambda x: x.rlike(r"[.!?][\x20\x09-\x0D]*\z"))).cast("long").alias("n_mark_lines"),
                F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
            ),
        )

    return bound(
        F.coalesce(text, F.lit("")),
        lambda t: bound(F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != ""), lambda words: of_words(t, words)),
    )


def passes(rule: Rule, m: Callable[[str], Column]) -> Column:
    """The rule as a column; measures of too small a text pass."""
    part, whole = m(rule.part).cast("double"), m(rule.whole).cast("double")
    good = F.lit(True)
    if rule.low is not None:
        good = good & (part >= F.lit(rule.low) * whole)
    if rule.high is not None:
        good = good & (part <= F.lit(rule.high) * whole)
    return (m(rule.whole) < rule.since) | good


def apply_rules(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, into: str = "quality") -> DataFrame:
    """Add a struct: all measures, base_failed, the names of the failed rules, kept."""
    measured = df.withColumn(into, measures(F.col(f"`{text}`")))
    m = lambda name: F.col(f"`{into}`.{name}")
    base_failed = (m("n_words") < 10) | (100 * m("n_repeat_words") > 20 * m("n_words"))
    failed = F.array_compact(F.array(*(F.when(~passes(r, m), F.lit(r.name)) for r in rules)))
    return (
        measured.withColumn(into, F.col(f"`{into}`").withField("base_failed", base_failed))
        .withColumn(into, F.col(f"`{into}`").withField("failed_rules", failed))
        .withColumn(into, F.col(f"`{into}`").withField("kept", ~m("base_failed") & (F.size(m("failed_rules")) == 0)))
    )


MEASURES = "n_words word_chars n_symbols n_dup_lines n_repeat_words n_stop_words n_lines n_mark_lines n_upper".split()


def verdicts(docs: DataFrame) -> DataFrame:
    """Per document: the measures, whether the base rules fail, whether it is kept."""
    judged = apply_rules(docs.select("doc_id", "text"))
    return judged.select(
        "doc_id", *(f"quality.{n}" for n in MEASURES), "quality.base_failed", "quality.kept"
    )


def check_sql() -> str:
    """The same verdicts in DuckDB SQL, from the same tables of words, symbols and thresholds."""
    stop = ", ".join(f"'{w}'" for w in STOP_FORMS)
    failed = []
    for rule in RULES:
        bounds = [f"{rule.part} >= {rule.low!r} * {rule.whole}"] if rule.low is not None else []
        bounds += [f"{rule.part} <= {rule.high!r} * {rule.whole}"] if rule.high is not None else []
        failed.append(f"({rule.whole} >= {rule.since} and not ({' and '.join(bounds)}))")
    blank = r"[\x20\x09-\x0D]"
    return rf"""
with texts as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
words as (
  select r, doc_id, t,
    list_filter(string_split_regex(t, '{blank}+'), lambda w: w <> '') as ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls
  from texts
),
windows as (
  select r, i, array_to_string(ws[i : i + {WINDOW - 1}], ' ') as v
  from (select r, ws, unnest(range(1, len(ws) - {WINDOW - 2})) as i from words)
),
twice as (select r, i from (select r, i, count(*) over (partition by r, v) as n from windows) where n > 1),
covered as (select r, count(distinct i + k) as n from twice, (select unnest(range(0, {WINDOW})) as k) group by r),
measured as (
  select r, doc_id, len(ws)::bigint as n_words,
    coalesce(length(array_to_string(ws, '')), 0)::bigint as word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
    (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
    coalesce(c.n, 0)::bigint as n_repeat_words,
    len(list_filter(ws, lambda w: list_contains([{stop}], w)))::bigint as n_stop_words,
    len(ls)::bigint as n_lines,
    len(list_filter(ls, lambda x: regexp_matches(x, '[.!?]{blank}*\z')))::bigint as n_mark_lines,
    length(regexp_replace(t, '\P{{Lu}}', '', 'g'))::bigint as n_upper
  from words left join covered c using (r)
),
based as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from measured)
select doc_id, {", ".join(MEASURES)}, base_failed, not base_failed and not ({" or ".join(failed)}) as kept from based
"""
