"""Questions against catalogs by an inverted index: which column, phrase or rule of a catalog each question meets.

The catalogs of all datasets become one table of entries, each under the pieces of text that lead to it; a question is broken into
such pieces, which are joined to the entries by equality. No question is held against every phrase or every column:

* A phrase is entered under its rarest run of characters, a question has all its runs of those lengths. What meets is checked.
* A column is entered under its words, their singulars, its examples, and all pieces of its name, by which the rule of at least
  three common characters becomes an equality too. A question has its words, their singulars, and pieces of its words as long as
  some column's name.

Equal questions are matched once. The entries are a table like any other: Spark broadcasts a small one and shuffles a large one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.functions.text import stem, words
from tallyward.operators import matching
from tallyward.operators.profile import TableProfile
from tallyward.plans.catalog import MetricDefinition

#: Lengths of the runs that phrases are entered under; a phrase has the largest that it is as long as.
RUNS = (8, 4, 1, 0)
#: A word of so many characters at least names a column by a common piece.
PIECE = 3

_TEXT, _DATASET = "_asked", "_asked_of"
_KINDS = ("number", "category", "synonym", "by")


@dataclass(frozen=True)
class Catalog:
    """What questions about a dataset are matched against. `examples` lets a categorical column's example values name it."""

    profile: TableProfile
    metrics: Mapping[str, MetricDefinition]
    examples: bool = True


def entries(dataset: str, catalog: Catalog) -> Iterator[tuple]:
    """(dataset, how, piece, kind, place, phrase) of a catalog. The smallest place wins among what a question meets: the number of a
    column or metric; for a column to group by, singulars come after all words."""
    found = catalog.profile
    examples = {c.name: c.examples for c in found.columns if c.is_categorical} if catalog.examples else {}
    for kind, columns in (("number", found.numeric), ("category", found.categorical)):
        for place, column in enumerate(columns):
            own = [str(v).lower() for v in examples.get(column, ())] if kind == "category" else []
            for how, piece in sorted(set(_column_pieces(column.lower(), own))):
                yield dataset, how, piece, kind, place, None
    by_name = {c.lower(): place for place, c in enumerate(found.categorical)}
    for low, place in by_name.items():
        yield dataset, "by", low, "by", place, None
        yield dataset, "by_stem", low, "by", len(found.categorical) + place, None
    phrases = [(place, p) for place, m in enumerate(catalog.metrics.values()) for p in (m.name.replace("_", " "), *m.synonyms)]
    runs = [(place, phrase, _runs(phrase)) for place, phrase in phrases]
    shared = Counter(run for *_, own in runs for run in own)
    for place, phrase, own in runs:
        yield dataset, "run", min(own, key=lambda run: (shared[run], run)), "synonym", place, phrase


def _runs(phrase: str) -> set[str]:
    size = next(n for n in RUNS if n <= len(phrase))
    return {phrase[i : i + size] for i in range(len(phrase) - size + 1)}


def _column_pieces(low: str, examples: list[str]) -> Iterator[tuple[str, str]]:
    parts, singular = low.split("_"), low.rstrip("s")
    yield from (("word", w) for w in (low, *parts, *examples))
    yield from (("stem", w) for w in (singular, *[p.rstrip("s") for p in parts], *examples))
    yield from (("within", low[i:j]) for i in range(len(low)) for j in range(i + PIECE, len(low) + 1))
    yield from (("stem_within", singular[i:j]) for i in range(len(singular) + 1) for j in range(i, len(singular) + 1))
    yield "around", low


_ENTRY = pa.schema([("dataset", pa.string()), ("how", pa.string()), ("piece", pa.string()), ("kind", pa.string()), ("place", pa.int32()), ("phrase", pa.string())])


def index_frame(spark: SparkSession, catalogs: Mapping[str, Catalog]) -> DataFrame:
    """The entries of all catalogs."""
    rows = [entry for dataset, catalog in catalogs.items() for entry in entries(dataset, catalog)]
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), _ENTRY)], schema=_ENTRY) if rows else _ENTRY.empty_table())


def _key(how: str | Column, piece: Column) -> Column:
    """What entries and probes are joined by. Hashes, as there are many probes; what meets is compared again."""
    return F.xxhash64(F.col(_DATASET), F.lit(how), piece).alias("key")


def _word_probes(texts: DataFrame, lengths: list[int]) -> DataFrame:
    """(dataset, text, key, piece): the words of a question in all forms that a column is entered under."""
    own, word, long = [F.col(_DATASET), F.col(_TEXT)], F.col("word"), F.length("word") >= PIECE
    spoken = texts.select(*own, F.explode(F.array_distinct(words(F.col(_TEXT)))).alias("word")).withColumn("stem", stem(word))
    probe = lambda how, piece: F.struct(_key(how, piece), piece.alias("piece"))
    said, stemmed = [probe("word", word), probe("stem", F.col("stem"))], [probe("within", word), probe("stem_within", F.col("stem"))]
    found = spoken.select(*own, F.inline(F.when(long, F.array(*said, *stemmed)).otherwise(F.array(*said))))
    # What is asked by; the conditions are in the lists, not filters, so that all parts read the same distinct texts.
    last = F.try_element_at(F.regexp_extract_all(_TEXT, F.lit("(?U)" + matching.BY_WORD), F.lit(1)), F.lit(-1))
    by = texts.select(*own, F.explode(F.when(F.col(_TEXT).contains("by"), F.array(last))).alias("word"))
    found = found.union(by.select(*own, F.inline(F.when(word.isNotNull(), F.array(probe("by", word), probe("by_stem", stem(word)))))))
    if not lengths:
        return found
    sizes = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("word"))
    inside = spoken.select(*own, "word", F.explode(F.when(long, sizes)).alias("size"))
    inside = inside.select(*own, "word", "size", F.explode(F.expr("sequence(0, length(word) - size)")).alias("at"))
    piece = F.expr("substring(word, at + 1, size)")
    return found.union(inside.select(*own, _key("around", piece), piece.alias("piece")))


def _run_probes(texts: DataFrame, sizes: list[int]) -> DataFrame:
    """(dataset, text, key, piece): all runs of characters of a question, of the lengths that phrases are entered under."""
    own, parts = [F.col(_DATASET), F.col(_TEXT)], []
    for size in sizes:
        places = f"CASE WHEN length({_TEXT}) >= {size} THEN sequence(0, length({_TEXT}) - {size}) END" if size else "array(0)"
        piece = F.expr(f"substring({_TEXT}, at + 1, {size})")
        parts.append(texts.select(*own, F.explode(F.expr(places)).alias("at")).select(*own, _key("run", piece), piece.alias("piece")))
    return reduce(DataFrame.union, parts)


def matched(texts: DataFrame, catalogs: Mapping[str, Catalog]) -> DataFrame:
    """(dataset, text, number, category, synonym, by) of distinct texts: the place of the first of each kind that a text meets."""
    index = index_frame(texts.sparkSession, catalogs).withColumnRenamed("dataset", _DATASET)
    index = index.select(F.xxhash64(_DATASET, "how", "piece").alias("key"), F.col("piece").alias("own_piece"), "kind", "place", "phrase")
    columns = sorted({len(c) for k in catalogs.values() for c in (*k.profile.numeric, *k.profile.categorical)})
    runs = sorted({next(n for n in RUNS if n <= len(p)) for k in catalogs.values() for m in k.metrics.values() for p in (m.name, *m.synonyms)})
    probed = reduce(DataFrame.union, [_word_probes(texts, columns), *([_run_probes(texts, runs)] if runs else [])])
    met = probed.join(index, "key").where((F.col("piece") == F.col("own_piece")) & (F.col("phrase").isNull() | F.contains(F.col(_TEXT), F.col("phrase"))))
    return met.groupBy(_DATASET, _TEXT).agg(*[F.min(F.when(F.col("kind") == kind, F.col("place"))).alias(kind) for kind in _KINDS])


def _named(found: DataFrame, catalogs: Mapping[str, Catalog]) -> DataFrame:
    """Places as names, and what the rules need of the catalog of a text's dataset."""
    name = lambda names, place: F.get(names, F.col(place))
    known = found.join(_facts(found.sparkSession, catalogs), _DATASET)
    by = F.get("categorical", F.pmod(F.col("by"), F.greatest(F.size("categorical"), F.lit(1))))
    return known.withColumns({"number": name("numeric", "number"), "category": name("categorical", "category"), "synonym": name("metrics", "synonym"), "by": by})


def _asked(questions: DataFrame, question_col: str, dataset: Column | None) -> DataFrame:
    # The matching rules see the question lowered, and a null one as empty.
    text = F.lower(F.coalesce(F.col(question_col), F.lit("")))
    return questions.withColumns({_TEXT: text, _DATASET: F.lit("") if dataset is None else F.coalesce(dataset, F.lit(""))})


def match_questions(questions: DataFrame, question_col: str, catalogs: Mapping[str, Catalog], dataset: Column | None = None) -> DataFrame:
    """The questions with `number`, `category` and `synonym`: the first numeric column, categorical column and metric of the catalog
    of their dataset that they name. Without `dataset` there is one catalog, under the empty name."""
    asked = _asked(questions, question_col, dataset)
    found = _named(matched(asked.select(_DATASET, _TEXT).distinct(), catalogs), catalogs)
    return asked.join(found.select(_DATASET, _TEXT, "number", "category", "synonym"), [_DATASET, _TEXT], "left").drop(_DATASET, _TEXT)


def _facts(spark: SparkSession, catalogs: Mapping[str, Catalog]) -> DataFrame:
    """What the names and rules need of each catalog, a row each."""
    rows = []
    for dataset, catalog in catalogs.items():
        best, money = matching.sum_choices(list(catalog.metrics.values()))
        rows.append((dataset, matching.has_product(catalog.profile), best, money, matching.value_column(catalog.profile),
                     list(catalog.profile.numeric), list(catalog.profile.categorical), list(catalog.metrics)))
    many = pa.list_(pa.string())
    kinds = [("dataset", pa.string()), ("has_product", pa.bool_()), ("best", pa.string()), ("best_money", pa.string()), ("value_col", pa.string()),
             ("numeric", many), ("categorical", many), ("metrics", many)]
    table = pa.table([pa.array(c, k) for c, (_, k) in zip(zip(*rows), kinds)], names=[n for n, _ in kinds]) if rows else pa.schema(kinds).empty_table()
    return spark.createDataFrame(table).withColumnRenamed("dataset", _DATASET)


def resolve(questions: DataFrame, question_col: str, catalogs: Mapping[str, Catalog], dataset: Column | None = None) -> DataFrame:
    """Adds plan_type, target, value_col, group_col, agg, route, threshold and columns to every question.

    The fixed rules come first; where they give nothing or a refusal, the catalog decides, else it is no_match. A question about a
    dataset without a catalog is no_match.
    """
    spark = questions.sparkSession
    asked = _asked(questions, question_col, dataset)
    texts = asked.select(_DATASET, _TEXT).distinct()
    known = _named(texts.join(matched(texts, catalogs), [_DATASET, _TEXT], "left"), catalogs)
    text, number, average = F.col(_TEXT), F.col("number"), matching.asks_average(F.col(_TEXT))
    known = known.withColumns({"_pair": matching.grouped_name(average, number, F.col("category")), "_single": F.concat(F.lit("avg_"), number)})
    listed = lambda name: F.coalesce(F.array_contains("metrics", F.col(name)), F.lit(False))
    pick = matching.chosen_sum(text, F.col("best"), F.col("best_money"))
    group = F.when(F.col("value_col").isNotNull(), F.col("by"))
    rule = matching.ruled(matching.trim_blanks(text), group, F.col("value_col"), pick, F.col("has_product"))
    fall = matching.schema_plan(text, number, F.col("category"), F.col("synonym"), listed("_pair"), listed("_single"), F.col("numeric"))
    decided = known.withColumn("_rule", rule)
    answer = F.when(F.col("_rule.plan_type") != matching.NO_MATCH, F.col("_rule")).otherwise(F.coalesce(fall, F.col("_rule")))
    answers = decided.select(_DATASET, _TEXT, answer.alias("_answer"))
    resolved = asked.join(answers, [_DATASET, _TEXT], "left").withColumn("_answer", F.coalesce("_answer", matching.nothing()))
    fields = [part.split()[0] for part in matching.RESOLUTION.split(", ")]
    return resolved.withColumns({f: F.col(f"_answer.{f}") for f in fields}).drop("_answer", _DATASET, _TEXT)
