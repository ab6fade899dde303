"""Matching a table of questions against a catalog: which metric or tool answers each.

Here are the rules. `match_synonym` and `match_column` apply them to a column by trying each entry of a short list; whole logs of
questions go through `question_index`, which looks the entries up.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.functions.text import let, stem, trim_blanks, words
from tallyward.operators.profile import TableProfile
from tallyward.plans.catalog import MetricDefinition

# ---- Fixed values: word lists and intent patterns -------------------------------------------------------
MONEY_COLUMNS = ("sales", "revenue", "amount", "price", "income")
MONEY_QUESTION = r"\b(revenue|sales|amount|price)\b"
PRODUCT_QUESTION = r"\bproducts?\b"
PRODUCT_COLUMNS = ("product", "products")
DESCRIBE_QUESTION = r"\b(describe|profile|summary of the data|what columns|schema)\b"
ROW_COUNT_QUESTION = r"\b(how many rows|row count|number of rows|number of records|how many records)\b"
OUTLIER_QUESTION = r"\b(outlier|outliers|anomal|anomaly)\b"
TOTAL_QUESTION = r"\b(total|sum|overall)\b"
TOTAL_SUBJECT = r"\b(revenue|sales|amount)\b"
EXTREME_QUESTION = r"\b(highest|lowest|top|best|max|min)\b"
BY_WORD = r"\bby\s+(\w+)\b"
AVERAGE_WORDS = ("average", "avg", "mean")
OUTLIER_WORDS = ("outlier", "outliers", "anomaly", "anomalies", "extreme", "unusual")
OVERVIEW_WORDS = (
    "takeaway", "takeaways", "strategic", "recommendation", "recommendations", "management", "action", "summary",
    "insights", "overview",
)
GROUP_WORDS = (
    "by", "per", "each", "highest", "lowest", "top", "best", "breakdown", "compare", "vs", "versus", "between",
    "difference",
)
FALLBACK_THRESHOLD = 1.5
# ---------------------------------------------------------------------------------------------------------

NO_MATCH, TOOL_PLAN, METRIC_PLAN = "no_match", "stats_tool", "single_metric"


def _lowered(question: Column) -> Column:
    return F.lower(F.coalesce(question, F.lit("")))


def _has_any(text: Column, parts: Sequence[str]) -> Column:
    hit = F.lit(False)
    for part in parts:
        hit = hit | text.contains(part)
    return hit


# ---- metrics --------------------------------------------------------------------------------------------


def match_synonym(question: Column, metrics: Sequence[MetricDefinition]) -> Column:
    """Name of the first metric, in catalog order, whose name in words or any synonym is inside the question."""
    phrases = [{"name": m.name, "phrase": s} for m in metrics for s in (m.name.replace("_", " "), *m.synonyms)]
    table = _table(phrases, "name: string, phrase: string")
    return let(_lowered(question), lambda text: F.get(F.filter(table, lambda p: F.contains(text, p["phrase"])), F.lit(0))["name"])


def _table(rows: Sequence[Mapping[str, object]], fields: str) -> Column:
    """Metadata as a literal array of structs."""
    return F.from_json(F.lit(json.dumps(list(rows))), f"array<struct<{fields}>>")


def pick_sum_metric(question: Column, metrics: Sequence[MetricDefinition]) -> Column:
    """Name of the best sum metric for a total question; null when there is none.

    A money column scores 10 and money synonyms 5; identifiers never count, and a question about money takes
    no metric without a score. Of equal scores the last name wins. The score does not depend on the question,
    so the choice is between two names.
    """
    best, money = sum_choices(metrics)
    return chosen_sum(_lowered(question), F.lit(best).cast("string"), F.lit(money).cast("string"))


def sum_choices(metrics: Sequence[MetricDefinition]) -> tuple[str | None, str | None]:
    """The best sum metric of a catalog, for any question and for one about money."""
    scored = []
    for m in metrics:
        low = m.column.strip().lower()
        if m.agg != "sum" or low == "id" or low.endswith("_id"):
            continue
        money = 10 if m.column.lower() in MONEY_COLUMNS else 0
        synonyms = " ".join(m.synonyms).lower()
        scored.append((money + (5 if any(w in synonyms for w in MONEY_COLUMNS) else 0), m.name))
    return max(scored, default=(0, None))[1], max((s for s in scored if s[0] > 0), default=(0, None))[1]


def chosen_sum(text: Column, best: Column, best_money: Column) -> Column:
    """Which of the two a lowered question takes."""
    return F.when(text.rlike(MONEY_QUESTION), best_money).otherwise(best)


# ---- columns --------------------------------------------------------------------------------------------


def _names_column(word: Column, singular: Column, column: Column) -> Column:
    """Does one word of a question name a column: itself, its singular, one of its parts, or a piece of it?"""
    exact = F.array_contains(column["words"], word) | F.array_contains(column["singulars"], singular)
    low = column["low"]
    piece = F.contains(low, word) | F.contains(word, low) | F.contains(column["singular"], singular)
    example = F.array_contains(column["examples"], word) | F.array_contains(column["examples"], singular)
    return exact | ((F.length(word) >= 3) & piece) | example


def match_column(question: Column, columns: Sequence[str], examples: Mapping[str, Sequence[str]] | None = None) -> Column:
    """The first column, in table order, that a word of the question names; null when none is.

    `examples` lets a word that is one of a column's example values name the column too.
    """
    rows = []
    for column in columns:
        low = column.lower()
        parts = low.split("_")
        rows.append(
            {
                "name": column, "low": low, "singular": low.rstrip("s"), "words": [low, *parts],
                "singulars": [low.rstrip("s"), *[p.rstrip("s") for p in parts]],
                "examples": [str(v).lower() for v in (examples or {}).get(column, ())],
            }
        )
    fields = "name: string, low: string, singular: string, words: array<string>, singulars: array<string>, examples: array<string>"
    table = _table(rows, fields)
    spoken = F.transform(words(F.coalesce(question, F.lit(""))), lambda w: F.struct(w.alias("word"), stem(w).alias("stem")))
    named = lambda said: F.filter(table, lambda c: F.exists(said, lambda w: _names_column(w["word"], w["stem"], c)))
    return let(spoken, lambda said: F.get(named(said), F.lit(0))["name"])


def _breakdown(text: Column, profile: TableProfile) -> tuple[Column, str | None]:
    """(group column or null, value column) of a 'by <column>' question."""
    spoken = F.regexp_extract_all(text, F.lit("(?U)" + BY_WORD), F.lit(1))
    last = F.when(F.size(spoken) > 0, F.element_at(spoken, -1))
    group = F.lit(None).cast("string")
    by_name = {c.lower(): c for c in profile.categorical}
    for low, name in reversed(by_name.items()):
        # The word itself is tried first, its singular only when no column is called by the word.
        group = F.when((last == low) | (~last.isin(*by_name) & (stem(last) == low)), F.lit(name)).otherwise(group)
    value = value_column(profile)
    return (group if value else F.lit(None).cast("string")), value


def value_column(profile: TableProfile) -> str | None:
    """The column a breakdown sums up: the first about money, else the first that is no identifier."""
    numbers = [n for n in profile.numeric if not _plain_id(n)]
    return next((n for n in numbers if n.lower() in MONEY_COLUMNS), numbers[0] if numbers else None)


def has_product(profile: TableProfile) -> bool:
    """Is there a column of products?"""
    return any(c.name.lower() in PRODUCT_COLUMNS for c in profile.columns)


def _plain_id(name: str) -> bool:
    return name.lower() == "id" or name.lower().endswith("_id")


# ---- whole questions ------------------------------------------------------------------------------------

RESOLUTION = "plan_type string, target string, value_col string, group_col string, agg string, route string, threshold double, columns array<string>"


def _resolution(
    plan: str,
    target: Column | None,
    route: str,
    value: Column | None = None,
    group: Column | None = None,
    agg: Column | None = None,
    threshold: float | None = None,
    columns: Column | None = None,
) -> Column:
    null = F.lit(None).cast("string")
    of = lambda c: null if c is None else c
    listed = F.lit(None) if columns is None else columns
    return F.struct(
        F.lit(plan).alias("plan_type"), of(target).alias("target"), of(value).alias("value_col"),
        of(group).alias("group_col"), of(agg).alias("agg"), F.lit(route).alias("route"),
        F.lit(threshold).cast("double").alias("threshold"), listed.cast("array<string>").alias("columns"),
    )


def intent(question: Column, profile: TableProfile, metrics: Sequence[MetricDefinition]) -> Column:
    """The fixed intent rules as a struct (plan_type, target, value_col, group_col, agg, route); null when none applies."""
    return let(trim_blanks(_lowered(question)), lambda text: _rules(text, profile, metrics))


def _rules(text: Column, profile: TableProfile, metrics: Sequence[MetricDefinition]) -> Column:
    group, value = _breakdown(text, profile)
    return ruled(text, group, F.lit(value).cast("string"), pick_sum_metric(text, metrics), F.lit(has_product(profile)))


def ruled(text: Column, group: Column, value: Column, pick: Column, products: Column) -> Column:
    """The fixed rules in order, given what the catalog has for each: the column to group by, the one to sum up, the sum metric."""
    asks = lambda pattern: text.rlike("(?U)" + pattern)
    total = asks(TOTAL_QUESTION) & asks(TOTAL_SUBJECT) & ~asks(EXTREME_QUESTION)
    rules = F.when(text == "", F.lit(None).cast(f"struct<{_typed()}>"))
    return (
        rules.when(~products & asks(PRODUCT_QUESTION), _resolution(NO_MATCH, None, "product"))
        .when(asks(DESCRIBE_QUESTION), _resolution(TOOL_PLAN, F.lit("describe"), "describe"))
        .when(asks(ROW_COUNT_QUESTION), _resolution(TOOL_PLAN, F.lit("describe"), "row_count"))
        .when(asks(OUTLIER_QUESTION), _resolution(TOOL_PLAN, F.lit("anomaly_detect"), "outliers"))
        .when(total & pick.isNotNull(), _resolution(METRIC_PLAN, pick, "total"))
        .when(group.isNotNull(), _resolution(TOOL_PLAN, F.lit("group_compare"), "breakdown", value, group, F.lit("sum")))
    )


def nothing() -> Column:
    """The answer to a question that nothing matches."""
    return _resolution(NO_MATCH, None, "none")


def _typed() -> str:
    return ", ".join(f"{part.split()[0]}: {part.split()[1]}" for part in RESOLUTION.split(", "))


def asks_average(text: Column) -> Column:
    """Is a lowered question about a mean?"""
    return _has_any(text, AVERAGE_WORDS)


def grouped_name(average: Column, number: Column, group: Column) -> Column:
    """The name a grouped metric of two columns has in a catalog."""
    return F.concat(F.when(average, F.lit("avg_")).otherwise(F.lit("")), number, F.lit("_by_"), group)


def schema_plan(
    text: Column, number: Column, group: Column, synonym: Column, pair_known: Column, average_known: Column, numeric: Column
) -> Column:
    """Schema matching for lowered questions no rule answers, given what they name and whether the catalog has the grouped metric
    and the mean of it: a struct like `intent`'s, null when nothing matches."""
    average = asks_average(text)
    # 'compare', 'vs' and 'between' are group words already, so a matched group adds nothing to the test.
    wants_group = _has_any(text, GROUP_WORDS) & number.isNotNull() & group.isNotNull()
    compare = _resolution(
        TOOL_PLAN, F.lit("group_compare"), "grouped", number, group, F.when(average, F.lit("mean")).otherwise(F.lit("sum"))
    )
    wants_outliers = _has_any(text, OUTLIER_WORDS) & number.isNotNull()
    return (
        F.when(wants_outliers, _resolution(TOOL_PLAN, F.lit("anomaly_detect"), "outliers", number, threshold=FALLBACK_THRESHOLD))
        .when(_has_any(text, OVERVIEW_WORDS), _resolution(TOOL_PLAN, F.lit("describe"), "overview", columns=numeric))
        .when(wants_group & pair_known, _resolution(METRIC_PLAN, grouped_name(average, number, group), "grouped"))
        .when(wants_group, compare)
        .when(average & number.isNotNull() & average_known, _resolution(METRIC_PLAN, F.concat(F.lit("avg_"), number), "average"))
        .when(synonym.isNotNull(), _resolution(METRIC_PLAN, synonym, "synonym"))
    )


def resolve_questions(questions: DataFrame, question_col: str, profile: TableProfile, metrics: Mapping[str, MetricDefinition]) -> DataFrame:
    """Adds plan_type, target, value_col, group_col, agg, route, threshold and columns to every question; see question_index."""
    from tallyward.operators import question_index

    return question_index.resolve(questions, question_col, {"": question_index.Catalog(profile, metrics)})


def coverage(resolved: DataFrame, expected_col: str) -> DataFrame:
    """(expected, n, answered_as_expected, share): an expected refusal must be refused, anything else answered."""
    refused = F.col("plan_type") == NO_MATCH
    success = F.when(F.col(expected_col) == NO_MATCH, refused).otherwise(~refused)
    counts = resolved.groupBy(F.col(expected_col).alias("expected")).agg(
        F.count("*").alias("n"), F.count_if(success).alias("answered_as_expected")
    )
    return counts.withColumn("share", F.round(F.col("answered_as_expected") / F.col("n"), 4))
