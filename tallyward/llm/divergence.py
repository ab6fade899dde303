"""How far the sources of a language differ in their words, and by which words.

Every (lang, source) group has a column of counts over the language's kept terms. All columns of a language share one order of the
terms, in which equal counts lie together: terms with the same counts in all groups are one stretch, stretches are sorted by the
counts of the groups, those with the fewest terms first. A column is then a list of runs of equal counts; two columns are compared
by the intersections of their runs, so that each difference is found once and multiplied by the run's length.

Terms of a language are dealt to blocks and, where a language has many sources, pairs of groups to tiles; a block's part of every
pair's sum is found by itself, so that neither a language nor a source is the work of one task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyward.llm.common import documents, held, slices, text_bytes
from tallyward.operators.topn import first_per_key

MIN_DOCUMENTS = 30
MAX_TERMS = 50
#: Added to a count, and what a share of one is.
PRIOR = 5
ONE = 1_000_000_000
#: Stretches of terms in a block, and sources in a tile, about.
BLOCK = 8192
TILE = 256
#: Terms counted by a task before they are sent on.
GATHERED = 200_000

_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def words(text: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The terms of a text in parts of bounded size: runs of letters and of all beyond ASCII, A to Z as a to z."""
    folded, start = text.translate(_FOLD), 0
    while start < len(folded):
        stop = folded.find(b" ", start + size)
        stop = len(folded) if stop < 0 else stop
        yield folded[start:stop].split()
        start = stop


_COUNTS = "lang string, source string, term string, n long, df long"


def _count_step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, source, text) to occurrences and documents by term, summed up within the task."""
    found: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def sent() -> Iterator[pa.RecordBatch]:
        for (lang, source), (occurrences, holders) in found.items():
            terms, counts = list(occurrences), list(occurrences.values())
            columns = [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.binary()).cast(pa.string()),
                       pa.array(counts, pa.int64()), pa.array([holders[t] for t in terms], pa.int64())]
            yield pa.record_batch(columns, ["lang", "source", "term", "n", "df"])

    size = 0
    for batch in slices(batches, 256, 2):
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2))):
            if (lang, source) not in found:
                found[lang, source] = Counter(), Counter()
            occurrences, holders = found[lang, source]
            before, own = len(occurrences), set()
            for part in words(text):
                occurrences.update(part)
                own.update(part)
            holders.update(own)
            size += len(occurrences) - before
        if size >= GATHERED:
            yield from sent()
            found, size = {}, 0
    yield from sent()


def term_counts(frame: DataFrame, least: int = MIN_DOCUMENTS) -> DataFrame:
    """(lang, term, counts): the terms in at least so many documents of their language, with `counts`, sorted (source, n) pairs of
    the sources that hold them. `frame` is (lang, source, text) without nulls."""
    counted = frame.mapInArrow(_count_step, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    # A term's list is no longer than the language has sources.
    by_term = counted.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("counts"))
    return by_term.where(F.col("df") >= least).select("lang", "term", "counts")


def group_sizes(frame: DataFrame, terms: DataFrame) -> DataFrame:
    """(lang, source, total, lang_total, vocabulary) of every group: occurrences of kept terms in it and in its language, and the
    number of kept terms."""
    groups = frame.select("lang", "source").distinct()
    sums = terms.select("lang", F.inline("counts")).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    each = terms.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda t, x: t + x["n"]).alias("n"))
    langs = each.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count("*").alias("vocabulary"))
    sized = groups.join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    return sized.select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "lang_total", "vocabulary")])


def shares(counts: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(ONE * counts / total) for counts up to total, by long division in base 1000, so that nothing overflows."""
    out, rest = np.zeros(len(counts), np.int64), counts.astype(np.int64)
    out += rest // total
    rest = rest % total
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def clustered(matrix: np.ndarray) -> np.ndarray:
    """An order of the rows in which equal counts lie together: sorted by all columns, those with the fewest counts first."""
    if not matrix.shape[1]:
        return np.arange(len(matrix))
    by_width = np.argsort((matrix != 0).sum(axis=0), kind="stable")
    return np.lexsort(matrix[:, by_width[::-1]].T)


def run_lengths(column: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, starts) of the runs of a column whose entries begin at the places."""
    first = np.flatnonzero(np.append(True, column[1:] != column[:-1]))
    return column[first], places[first]


def run_distance(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], end: int) -> int:
    """The sum of the differences of two run-length columns: one for each intersection of runs, times its length."""
    cuts = np.union1d(a[1], b[1])
    left = a[0][np.searchsorted(a[1], cuts, side="right") - 1]
    right = b[0][np.searchsorted(b[1], cuts, side="right") - 1]
    return int((np.abs(left - right) * np.diff(cuts, append=end)).sum())


_PAIRS = "lang string, a string, b string, value long"


def _block_step(key: tuple, table: pa.Table) -> pa.Table:
    """A block of a language's terms and a tile of its pairs: groups (source, tile, total, vocabulary) and stretches of terms
    (counts, length) to each pair's part of the sum."""
    _, _, one, other = (k.as_py() for k in key)
    groups, stretches = table.filter(pc.is_valid(table["source"])), table.filter(pc.is_valid(table["counts"]))
    groups = groups.sort_by("source")
    names, tiles = groups["source"].to_pylist(), groups["tile"].to_pylist()
    matrix = np.zeros((stretches.num_rows, len(names)), np.int64)
    counts = stretches["counts"].combine_chunks()
    if stretches.num_rows:
        pairs = counts.flatten()
        owners = np.repeat(np.arange(len(counts)), counts.value_lengths().to_numpy(zero_copy_only=False))
        if len(owners):
            sources = pc.index_in(pairs.field("source"), pa.array(names, pa.string())).to_numpy(zero_copy_only=False)
            matrix[owners, sources] = pairs.field("n").to_numpy(zero_copy_only=False)
    order = clustered(matrix)
    lengths = stretches["length"].to_numpy()[order] if stretches.num_rows else np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    columns = []
    for i, (total, vocabulary) in enumerate(zip(groups["total"].to_pylist(), groups["vocabulary"].to_pylist())):
        if len(order):
            values, starts = run_lengths(matrix[order, i], ends - lengths)
            columns.append((shares(values + PRIOR, total + PRIOR * vocabulary), starts))
    found = []
    for i in range(len(names)):
        for j in range(i + 1, len(names)):
            if {tiles[i], tiles[j]} == {one, other}:
                found.append((key[0].as_py(), names[i], names[j], run_distance(columns[i], columns[j], int(ends[-1])) if columns else 0))
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64()]
    return pa.table([pa.array([f[k] for f in found], t) for k, t in enumerate(kinds)], ["lang", "a", "b", "value"])


def pair_values(terms: DataFrame, groups: DataFrame, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """(lang, a, b, value) of each two sources a < b of a language: their differences summed over all kept terms."""
    stretches = terms.groupBy("lang", "counts").agg(F.count("*").alias("length"))
    size = stretches.groupBy("lang").agg(F.count("*").alias("n"))
    layout = groups.groupBy("lang").agg(F.count("*").alias("sources")).join(size, "lang", "left").select(
        "lang", F.greatest(F.ceil(F.coalesce("n", F.lit(0)) / block), F.lit(1)).cast("int").alias("blocks"), F.ceil(F.col("sources") / tile).cast("int").alias("tiles")
    )
    layout = held(layout, "layout")  # a row for each language, whose size Spark then knows

    def tile_of(source: Column) -> Column:
        return F.pmod(F.xxhash64(source), F.col("tiles")).cast("int")

    up_to = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    own = groups.join(layout, "lang").withColumn("tile", tile_of(F.col("source"))).withColumn("block", F.explode(up_to("blocks")))
    own = own.withColumn("with", F.explode(up_to("tiles"))).select(
        "lang", "block", F.least("tile", "with").alias("one"), F.greatest("tile", "with").alias("other"), "source", "tile", "total", "vocabulary",
        F.lit(None).cast(terms.schema["counts"].dataType).alias("counts"), F.lit(None).cast("long").alias("length"),
    )
    dealt = stretches.join(layout, "lang").withColumn("block", F.pmod(F.xxhash64("counts"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("one", F.explode(up_to("tiles"))).withColumn("other", F.explode(F.sequence(F.col("one"), F.col("tiles") - 1)))
    within = F.filter("counts", lambda x: tile_of(x["source"]).isin(F.col("one"), F.col("other")))
    nothing = lambda kind: F.lit(None).cast(kind)
    dealt = dealt.select(
        "lang", "block", "one", "other", nothing("string").alias("source"), nothing("int").alias("tile"), nothing("long").alias("total"),
        nothing("long").alias("vocabulary"), F.when(F.col("tiles") == 1, F.col("counts")).otherwise(within).alias("counts"), "length",
    )
    parts = own.unionByName(dealt).groupBy("lang", "block", "one", "other").applyInArrow(_block_step, _PAIRS)
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def _share(count: str, total: str) -> Column:
    return F.expr(f"1 + (CAST({ONE} AS DECIMAL(10,0)) * CAST({count} + {PRIOR} AS DECIMAL(20,0))) div CAST({total} + {PRIOR} * vocabulary AS DECIMAL(20,0))")


def term_values(terms: DataFrame, groups: DataFrame, limit: int = MAX_TERMS) -> DataFrame:
    """(lang, source, item, value, rank) of the terms whose share in a group is above that in the language, the largest first."""
    each = terms.withColumn("all", F.aggregate("counts", F.lit(0).cast("long"), lambda t, x: t + x["n"])).select("lang", "term", "all", F.inline("counts"))
    value = _share("n", "total") - _share("all", "lang_total")
    above = each.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), value.cast("long").alias("value")).where("value > 0")
    return first_per_key(above, ["lang", "source"], [F.desc("value"), F.col("item")], limit, "rank")


def audit(frame: DataFrame, lang_column: str = "lang", source_column: str = "source", text_column: str = "text",
          least: int = MIN_DOCUMENTS, limit: int = MAX_TERMS, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """(lang, source, part, item, value, rank): for every source of a language, `pair` rows with each other source and the sum of
    differences, and `term` rows with the terms it uses more than the language does.

    Null texts, languages and sources are empty ones, and an empty language or source is one like any other. A group without terms
    has its pairs; so has one of a language that keeps no term, with value 0. Repeated rows are documents each. Ties are ranked by
    item. Other columns are ignored. An empty table gives no rows.
    """
    columns = {"lang": lang_column, "source": source_column, "text": text_column}
    rows = frame.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(name) for name, c in columns.items()])
    terms = held(term_counts(rows, least), "terms")
    groups = held(group_sizes(rows, terms), "groups")
    values = pair_values(terms, groups, block, tile)
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    sided = values.select("lang", both.alias("side"), "value").select("lang", "side.source", "side.item", "value")
    # A source's pairs are fewer than the language's sources.
    pairs = sided.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.col("item"))))
    shape = lambda found, part: found.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return shape(pairs, "pair").unionByName(shape(term_values(terms, groups, limit), "term"))


def report(frame: DataFrame) -> DataFrame:
    """The audit of all documents."""
    return audit(documents(frame, "lang", "source", "text"))


#: The same as SQL.
ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
n AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
c AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN n USING (lang, source, term)),
p AS (
  SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p,
         1 + (1000000000::HUGEINT * (sum(n) OVER (PARTITION BY lang, term) + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q
  FROM c JOIN v USING (lang)
), f AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
), found AS (
  SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM found QUALIFY part = 'pair' OR rank <= 50
"""
