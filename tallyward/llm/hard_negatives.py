"""Hard negatives for training pairs: rows of another label that score nearly as high against an anchor as a positive does.

Scores are exact integers, found by matrix products in a residue number system: the integer components are reduced modulo several
small primes, centred around zero, so small that a float32 product of a chunk of components is an exact integer; the residues of
the scores then give the signed scores by Chinese remaindering, digit by digit.

Anchors meet all rows in a grid of cells: blocks of anchors times slices of rows. A cell's task holds its anchors and the best
rows found so far, while the rows stream past, so that neither has to fit in memory and any anchor or row may be hot. A first
pass over rows of the anchor's label finds the positives, a second one over the other rows selects, for each positive, within the
window of scores it sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.llm.common import documents, slices
from tallyward.operators.topn import first_per_key

SCALE = 256
POSITIVES = 5
NEGATIVES = 5
#: Components multiplied at once, and with it the largest prime: 64 * 511 ** 2 < 2 ** 24, up to where float32 holds every integer.
CHUNK = 64
#: Anchors of a cell, and rows of a cell from which on there are more slices than tasks.
MAX_ANCHORS = 1 << 14
MAX_ROWS = 1 << 20
#: Anchors and rows scored at once.
TILE = (256, 4096)
#: Scores are held in 64 bits, with room to compare five times a score.
MAX_SCORE = 1 << 60

_NONE = np.iinfo(np.int64).min


def primes(bound: int, chunk: int = CHUNK) -> list[int]:
    """The largest primes p with chunk * ((p - 1) / 2) ** 2 < 2 ** 24, as many as tell integers from -bound to bound apart."""
    found, product, candidate = [], 1, 2 * math.isqrt(((1 << 24) - 1) // chunk) + 1
    while product <= 2 * bound:
        if candidate < 3:
            raise ValueError("no primes left")
        if candidate % 2 and all(candidate % d for d in range(3, int(candidate**0.5) + 1, 2)):
            found.append(candidate)
            product *= candidate
        candidate -= 1
    return found


def residues(components: np.ndarray, moduli: Sequence[int]) -> list[np.ndarray]:
    """Whole components modulo each prime, centred around zero, in float32. fmod is exact for doubles of any size."""
    out = []
    for p in moduli:
        rest = np.fmod(components, p)
        rest[rest > p // 2] -= p
        rest[rest < -(p // 2)] += p
        out.append(rest.astype(np.float32))
    return out


def scores(left: list[np.ndarray], right: list[np.ndarray], moduli: Sequence[int], chunk: int = CHUNK) -> np.ndarray:
    """The exact inner products of all rows on the left with all on the right, from their residues."""
    total, weight = None, 1
    for a, b, p in zip(left, right, moduli):
        rest = np.zeros((len(a), len(b)), np.int64)
        for at in range(0, a.shape[1], chunk):
            rest += (a[:, at : at + chunk] @ b[:, at : at + chunk].T).astype(np.int64)
        # The next digit in mixed radix, between -p/2 and p/2: the value that makes the sum so far right modulo p.
        digit = rest if total is None else (rest - total % p) * pow(weight, -1, p)
        digit %= p
        digit[digit > p // 2] -= p
        total = digit if total is None else total + digit * np.int64(weight)
        weight *= p
    return total


class Cell:
    """The anchors of a cell with the best rows met so far for each of their targets; without targets, one for each anchor."""

    def __init__(self, ids: np.ndarray, tags: np.ndarray, labels: np.ndarray, components: np.ndarray, targets: list[list[int]] | None,
                 moduli: Sequence[int], bound: int, keep: int) -> None:
        self.ids, self.tags, self.labels, self.moduli, self.keep = ids, tags, labels, moduli, keep
        self.same, self.residues = targets is None, residues(components, moduli)
        width = 1 if targets is None else max([1, *map(len, targets)])
        self.wanted = np.ones((len(ids), width), bool)
        self.targets = np.zeros((len(ids), width), np.int64)
        for i, own in enumerate(targets or ()):
            self.wanted[i, len(own) :] = False
            self.targets[i, : len(own)] = own
        self.scores = np.full((len(ids), width, keep), _NONE)
        self.found = np.zeros((len(ids), width, keep), np.int64)
        # Score and place within a tile are compared as one number.
        self.tile = max(1, min(TILE[1], (1 << 62) // (bound + 1)))

    def meet(self, ids: np.ndarray, labels: np.ndarray, components: np.ndarray) -> None:
        """Rows pass the anchors."""
        order = np.argsort(ids, kind="stable")
        for at in range(0, len(order), self.tile):
            part = order[at : at + self.tile]
            right = residues(components[part], self.moduli)
            for start in range(0, len(self.ids), TILE[0]):
                self._tile(slice(start, start + TILE[0]), ids[part], labels[part], right)

    def _tile(self, own: slice, ids: np.ndarray, labels: np.ndarray, right: list[np.ndarray]) -> None:
        same = self.labels[own, None] == labels[None, :]
        fits = same & (self.ids[own, None] != ids[None, :]) if self.same else ~same
        found = scores([r[own] for r in self.residues], right, self.moduli)
        n = len(ids)
        if not self.same:  # no target of the anchor is as high or as low
            most = np.where(self.wanted[own], self.targets[own], _NONE).max(axis=1)
            least = np.where(self.wanted[own], self.targets[own], MAX_SCORE).min(axis=1)
            fits &= (found <= most[:, None]) & (5 * found >= 4 * least[:, None])
        some = np.flatnonzero(fits.any(axis=1))
        if not len(some):
            return
        fits, found = fits[some], found[some]
        rank = found * n + (n - 1 - np.arange(n))
        for t in range(self.targets.shape[1]):
            target = self.targets[own][some, t, None]
            inside = fits if self.same else fits & self.wanted[own][some, t, None] & (found <= target) & (5 * found >= 4 * target)
            keep = min(self.keep, n)
            best = np.where(inside, rank, _NONE)
            best = np.partition(best, n - keep, axis=1)[:, n - keep :]
            places = n - 1 - best % n
            none = best == _NONE
            at = np.arange(len(self.ids))[own][some]
            all_scores = np.concatenate([self.scores[at, t], np.where(none, _NONE, best // n)], axis=1)
            all_ids = np.concatenate([self.found[at, t], np.where(none, 0, ids[np.where(none, 0, places)])], axis=1)
            order = np.lexsort((all_ids, -1 - all_scores), axis=1)[:, : self.keep]
            self.scores[at, t] = np.take_along_axis(all_scores, order, axis=1)
            self.found[at, t] = np.take_along_axis(all_ids, order, axis=1)

    def result(self) -> pa.RecordBatch:
        """(anchor, tag, target, id, score) of the rows kept."""
        at = np.nonzero(self.scores != _NONE)
        columns = [self.ids[at[0]], self.tags[at[0]], at[1].astype(np.int64), self.found[at], self.scores[at]]
        return pa.record_batch([pa.array(c) for c in columns], ["anchor", "tag", "target", "id", "score"])


_RESULT = "anchor long, tag long, target long, id long, score long"


def components(column: pa.ListArray, dims: int) -> np.ndarray:
    """Vectors as rows of whole components; a shorter vector is filled up with zeros."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), dims))
    out[np.arange(dims)[None, :] < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return np.floor(SCALE * out)


def _cell_step(moduli: Sequence[int], bound: int, dims: int, keep: int, targeted: bool):
    """Rows that come sorted by (part, block, slice, kind), anchors first in each cell, to the best rows for each anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, anchors, cell = None, [], None

        def start() -> Cell:
            ids, tags, labels, vectors, targets = zip(*anchors)
            own = [t for part in targets for t in part] if targeted else None
            return Cell(np.concatenate(ids), np.concatenate(tags), np.concatenate(labels), np.concatenate(vectors), own, moduli, bound, keep)

        for batch in slices(batches, TILE[1]):
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)])
            cuts = np.flatnonzero((np.diff(keys) != 0).any(axis=0)) + 1
            for begin, end in zip([0, *cuts], [*cuts, batch.num_rows]):
                if tuple(keys[:3, begin]) != key:
                    if cell is not None:
                        yield cell.result()
                    key, anchors, cell = tuple(keys[:3, begin]), [], None
                part = batch.slice(begin, end - begin)
                ids, tags, labels = (part.column(i).to_numpy(zero_copy_only=False) for i in (4, 5, 6))
                vectors = components(part.column(7), dims)
                if keys[3, begin] == 0:
                    anchors.append((ids, tags, labels, vectors, part.column(8).to_pylist()))
                elif anchors:
                    cell = cell or start()
                    cell.meet(ids, labels, vectors)
        if cell is not None:
            yield cell.result()

    return run


def _met(anchors: DataFrame, rows: DataFrame, part: Column, blocks: int, cut: int, step) -> DataFrame:
    """Anchors (id, tag, label, vector, targets) and rows, each anchor with every row of its part, through the step."""
    own = [F.col(c) for c in ("id", "tag", "label", "vector")]
    left = anchors.select(
        part.alias("part"), F.pmod(F.xxhash64("id", "tag"), F.lit(blocks)).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(cut - 1))).alias("slice"), F.lit(0).alias("kind"), *own, "targets",
    )
    right = rows.select(
        part.alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
        F.pmod(F.xxhash64("id", F.lit(1)), F.lit(cut)).cast("int").alias("slice"), F.lit(1).alias("kind"), *own, F.lit(None).cast("array<long>").alias("targets"),
    )
    keys = ["part", "block", "slice"]
    return left.union(right).repartition(*keys).sortWithinPartitions(*keys, "kind").mapInArrow(step, _RESULT)


def mine(frame: DataFrame, anchors: Column | str, id_column: str = "vec_id", label_column: str = "label", vector_column: str = "embedding",
         positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor, a row that `anchors` selects,
    and each of its first `positives` other rows of the same label the first `negatives` rows of other labels whose score is at
    most the positive's and at least four fifths of it. Higher scores come first, ties by smaller id.

    A score is the exact inner product of the components times 256, rounded down; one that may be over 2 ** 60 raises. Rows with a
    null id, label or vector, or a null or non-finite component, take no part; a shorter vector counts as filled up with zeros.
    Repeated rows are candidates each, but one anchor; rows of the anchor's own id are never its positives. Other columns are
    ignored. Runs a job for the number of rows and the longest vector. An empty table, or one without anchors, gives no rows.
    """
    own, label, vector = (F.col(f"`{c}`") for c in (id_column, label_column, vector_column))
    chosen = F.expr(anchors) if isinstance(anchors, str) else anchors
    usable = frame.select(own.cast("long").alias("id"), label.cast("long").alias("label"), vector.alias("vector"), F.coalesce(chosen, F.lit(False)).alias("chosen"))
    usable = usable.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.forall("vector", lambda x: F.abs(x) < F.lit(float("inf"))))
    usable = usable.withColumn("tag", F.xxhash64("label", "vector"))
    square = F.aggregate("vector", F.lit(0.0), lambda total, x: total + F.pow(F.abs(x.cast("double")) * SCALE + 1, F.lit(2.0)))
    known = usable.agg(F.count("*").alias("rows"), F.count_if("chosen").alias("anchors"), F.max(F.size("vector")).alias("dims"), F.max(square).alias("square")).first()
    square = (known["square"] or 0.0) * (1 + 1e-9)  # a product of two vectors is no more than the longer one's square
    bound = int(min(square, 2.0 * MAX_SCORE)) + 1
    if bound > MAX_SCORE:
        raise ValueError("scores over 2 ** 60 are not held")
    moduli, dims = primes(bound), known["dims"] or 0
    blocks = max(1, -(-known["anchors"] // MAX_ANCHORS))
    tasks = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = max(1, -(-known["rows"] // MAX_ROWS), min(4 * tasks, known["rows"] // 512))

    wanted = usable.where("chosen").dropDuplicates(["id", "label", "vector"])
    nothing = F.lit(None).cast("array<long>").alias("targets")
    first = _met(wanted.withColumn("targets", nothing), usable, F.col("label"), blocks, cut, _cell_step(moduli, bound, dims, positives, False))
    order = [F.desc("score"), F.col("id")]
    ranked = first_per_key(first, ["anchor", "tag"], order, positives)
    by_anchor = ranked.groupBy("anchor", "tag").agg(F.sort_array(F.collect_list(F.struct("position", "id", "score"))).alias("positives"))
    targeted = wanted.join(by_anchor, (F.col("id") == F.col("anchor")) & (wanted["tag"] == by_anchor["tag"])).select(
        "id", wanted["tag"], "label", "vector", F.col("positives.score").alias("targets")
    )
    second = _met(targeted, usable, F.lit(0), blocks, cut, _cell_step(moduli, bound, dims, negatives, True))
    chosen = first_per_key(second, ["anchor", "tag", "target"], order, negatives, "rank")
    named = ranked.select(F.col("anchor").alias("anchor_id"), F.col("tag").alias("own"), (F.col("position") - 1).cast("long").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    both = chosen.join(named, (F.col("anchor") == F.col("anchor_id")) & (F.col("tag") == F.col("own")) & (F.col("target") == F.col("place")))
    return both.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def report(frame: DataFrame) -> DataFrame:
    """Hard negatives of every row whose id is divisible by 100; the labels of ids divisible by 7 are moved on by one first."""
    rows = documents(frame, "vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


#: The same as SQL.
ORACLE = """
WITH v AS (
  SELECT vec_id::BIGINT AS id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.id AS anchor_id, v.id, a.label = v.label AS same,
         coalesce(list_sum(list_transform(list_zip(a.e, v.e), lambda z: z[1] * z[2])), 0)::BIGINT AS score
  FROM v AS a, v WHERE a.id % 100 = 0
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same AND id <> anchor_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id))::INTEGER AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
"""
