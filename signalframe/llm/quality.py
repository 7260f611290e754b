"""Quality rules as a short-circuit cascade.

Each rule's cost and share of rejections are measured on a bounded sample; rules
then run in the order of rejections per second, and a document that one rule
rejects is hidden from all later ones (its words become null, on which Spark's
array functions return at once). The order changes the cost, never the verdict.
Only DataFrame functions are used.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP, keep, text_of, words_of

SYMBOLS = r"[#*$%&|<>]"
#: Rows of the sample that costs and selectivities are estimated on.
SAMPLE_ROWS = 4000


def _n_words(df):
    return df.withColumn("__n_words", F.size("__words").cast("long"))


def _word_chars(df):
    return df.withColumn("__word_chars", F.length(F.array_join("__words", "")).cast("long"))


def _n_symbols(df):
    return df.withColumn("__n_symbols", F.regexp_count("__text", F.lit(SYMBOLS)).cast("long"))


def _n_upper(df):
    return df.withColumn("__n_upper", F.regexp_count("__text", F.lit(r"\p{Lu}")).cast("long"))


def _n_dup_lines(df):
    df = df.withColumn("__lines", F.filter(F.split("__text", "\n"), lambda line: F.length(F.regexp_replace(line, GAP, "")) > 0))
    df = df.withColumn("__n_lines", F.size("__lines").cast("long"))
    return df.withColumn("__n_dup_lines", F.col("__n_lines") - F.size(F.array_distinct("__lines"))).drop("__lines")


def _n_repeat_words(df):
    """Words lying in a three-word window whose words occur again as a window.

    The windows are sorted with their positions; equal neighbours mark repeats.
    Sorting compares the words themselves, no hash decides.
    """
    n = F.size("__words")
    part = lambda at: F.slice("__words", at, n - 2)
    windows = F.arrays_zip(part(1).alias("a"), part(2).alias("b"), part(3).alias("c"), F.sequence(F.lit(1), n - 2).alias("at"))
    df = df.withColumn("__sorted", F.when(n >= 4, F.sort_array(windows)))
    m = F.size("__sorted")
    df = df.withColumn("__pairs", F.arrays_zip(F.slice("__sorted", 1, m - 1).alias("x"), F.slice("__sorted", 2, m - 1).alias("y")))
    same = lambda z: (z.x.a == z.y.a) & (z.x.b == z.y.b) & (z.x.c == z.y.c)
    both = F.transform(F.filter("__pairs", same), lambda z: F.array(z.x["at"], z.y["at"]))
    df = df.withColumn("__at", F.sort_array(F.array_distinct(F.flatten(both))))
    k = F.size("__at")
    steps = F.zip_with(F.slice("__at", 1, k - 1), F.slice("__at", 2, k - 1), lambda a, b: F.least(F.lit(3), b - a))
    covered = F.when(k > 0, 3 + F.aggregate(steps, F.lit(0), lambda s, d: s + d)).otherwise(F.when(n >= 0, 0))
    return df.withColumn("__n_repeat_words", covered.cast("long")).drop("__sorted", "__pairs", "__at")


#: Feature -> the step that adds its column.
FEATURES = {
    "n_words": _n_words,
    "word_chars": _word_chars,
    "n_symbols": _n_symbols,
    "n_upper": _n_upper,
    "n_dup_lines": _n_dup_lines,
    "n_repeat_words": _n_repeat_words,
}


@dataclass(frozen=True)
class Rule:
    """``rejects`` is a condition over the ``__``-columns of the features in ``needs``."""

    name: str
    needs: tuple[str, ...]
    rejects: Column


def default_rules() -> list[Rule]:
    c = F.col
    n, chars, symbols = c("__n_words"), c("__word_chars"), c("__n_symbols")
    return [
        Rule("few_words", ("n_words",), n < 50),
        Rule("word_length", ("n_words", "word_chars"), (chars < 3 * n) | (chars > 12 * n)),
        Rule("symbols", ("n_words", "n_symbols"), 100 * symbols > 10 * n),
        Rule("capitals", ("word_chars", "n_upper"), 100 * c("__n_upper") > 50 * chars),
        Rule("repeated_lines", ("n_dup_lines",), 100 * c("__n_dup_lines") > 40 * c("__n_lines")),
        Rule("repeated_words", ("n_words", "n_repeat_words"), 100 * c("__n_repeat_words") > 50 * n),
    ]


def _prepared(docs: DataFrame) -> DataFrame:
    df = docs.withColumn("__text", text_of())
    return df.withColumn("__words", words_of(F.col("__text")))


def measure(docs: DataFrame, features=tuple(FEATURES)) -> DataFrame:
    """``docs`` with one ``__``-column per feature, for every row."""
    df = _prepared(docs)
    for f in features:
        df = FEATURES[f](df)
    return df


def sample_of(docs: DataFrame, rows: int = SAMPLE_ROWS, seed: int = 7) -> DataFrame:
    """About ``rows`` texts spread over the whole table, written to the shared folder."""
    total = docs.count()
    part = docs.select("text").sample(min(1.0, rows / max(total, 1)), seed)
    return keep(part, "quality-sample")


def rule_order(sample: DataFrame, rules: list[Rule]) -> list[dict]:
    """Rules by rejections per second on ``sample``, best first.

    The cost of a rule is the time of a job that evaluates it over the sample,
    less the time of a job that only cuts the words. Ties go by the given order.
    """

    def seconds(df, *cols):
        start = time.perf_counter()
        row = df.agg(F.count(F.lit(1)), *cols).collect()[0]
        return time.perf_counter() - start, row

    cut = F.sum(F.size("__words"))
    seconds(_prepared(sample), cut)
    base, (n, _) = seconds(_prepared(sample), cut)
    found = []
    for place, rule in enumerate(rules):
        took, (_, _, rejected) = seconds(measure(sample, rule.needs), cut, F.count_if(rule.rejects))
        cost = max(took - base, 1e-3)
        found.append({"rule": rule, "cost": cost, "rejected": rejected / n if n else 0.0, "place": place})
    return sorted(found, key=lambda r: (-r["rejected"] / r["cost"], r["place"]))


def cascade(docs: DataFrame, rules: list[Rule] | None = None, order: list[dict] | None = None, features: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` plus ``kept`` and ``rejected_by`` (the first rule of the order that rejects).

    A null text is an empty one. Columns of the same names are replaced, all
    others stay; rows that repeat get equal verdicts; an empty table stays empty.
    Each of ``features`` is measured for every row and returned as a ``__``-column;
    all others are measured only for rows that no earlier rule has rejected.
    """
    rules = default_rules() if rules is None else rules
    order = rule_order(sample_of(docs), rules) if order is None else order
    own = [c for c in docs.columns if c not in ("kept", "rejected_by")]
    df = measure(docs.select(*own), features)
    df = df.withColumn("__by", F.lit(None).cast("string"))
    done = set(features)
    for entry in order:
        rule = entry["rule"]
        for f in rule.needs:
            if f not in done:
                df = FEATURES[f](df)
                done.add(f)
        hit = F.when(F.col("__by").isNull() & F.coalesce(rule.rejects, F.lit(False)), F.lit(rule.name))
        df = df.withColumn("__by", F.coalesce("__by", hit))
        live = F.col("__by").isNull()
        df = df.withColumns({"__text": F.when(live, F.col("__text")), "__words": F.when(live, F.col("__words"))})
    more = [f"__{f}" for f in features]
    # A filter on the verdict would be pushed down through every step, each copying
    # the ones before it; it stops at a generator, which makes one row of each row here.
    verdict = F.explode(F.array(F.struct(F.col("__by").isNull().alias("kept"), F.col("__by").alias("by"))))
    df = df.select(*own, *more, verdict.alias("__verdict"))
    return df.select(*own, F.col("__verdict.kept").alias("kept"), F.col("__verdict.by").alias("rejected_by"), *more)
