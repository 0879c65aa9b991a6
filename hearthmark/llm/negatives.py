"""Operator 13: hard negatives, with segment summaries that bound the scores.

Vectors are kept as integers.  A group of them stores a summary of every
vector: for segments of falling width the mean and the deviation (root of the
summed squared differences from the mean).  In a segment of width ``w`` the
inner product of two vectors is ``w * mean * mean'`` plus or minus ``deviation
* deviation'`` at most, so a sum over segments bounds the score.  Wide segments
decide first; what they leave is bounded with narrower ones, and only the rest
is scored exactly.  The best exact scores so far are the floor for the next
rows.

Rows and anchors meet in a grid: rows are dealt into groups of about
``GROUP_ROWS`` by a hash of their id, anchors into blocks of about
``BLOCK_ANCHORS``, and every block meets every group in one task.  A task
returns the best few of its group per anchor, another step the best of all.

Rows without id, label or vector and rows with an absent or non-finite
component take no part.  An id that occurs several times is one row, the one
with the smallest label and vector.  Missing components of a shorter vector
count as zero; an empty vector scores zero.  Scores beyond 64 bits are cut to
that range.  An anchor without positives has no negatives, an empty table
gives no rows.  Only the three named columns are read, whatever else there is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthmark.session import checkpointed

#: Segment widths from wide to narrow; each is a multiple of the next.
WIDTHS = (64, 16, 4, 2)
GROUP_ROWS, BLOCK_ANCHORS = 32_768, 2_048
#: Anchors that are bounded and scored at once, and rows beside them.
SCORE_ANCHORS, SCORE_ROWS = 64, 2_048
#: Bounds are widened by this share of their terms and by one, more than rounding can change.
SLACK = 1e-9
MOST = (1 << 63) - 1
HUGE = float(np.finfo(np.float64).max)

_KINDS = (np.int16, np.int32, np.int64, np.float64)
VECTORS = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("label", T.StringType())]
    + [T.StructField("numbers", T.BinaryType())]
)


def _padded(rows: list[np.ndarray]) -> np.ndarray:
    """Rows of one matrix whose width is a multiple of the widest segment."""
    width = max([len(r) for r in rows] + [1])
    out = np.zeros((len(rows), -(-width // WIDTHS[0]) * WIDTHS[0]), rows[0].dtype if rows else np.float64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def summaries(matrix: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Mean and deviation of every segment, one pair of matrices per width."""
    found = []
    with np.errstate(over="ignore", invalid="ignore"):
        for width in WIDTHS:
            parts = matrix.reshape(len(matrix), -1, width)
            mean = parts.mean(axis=2)
            found.append((mean, np.sqrt(((parts - mean[:, :, None]) ** 2).sum(axis=2))))
    return found


def _packed(row: np.ndarray) -> bytes:
    """Integers in the narrowest type that holds them, after a byte that names it."""
    most = np.abs(row).max(initial=0)
    kind = 0 if most < 1 << 15 else 1 if most < 1 << 31 else 2 if most < 1 << 62 else 3
    return bytes([kind]) + row.astype(_KINDS[kind]).tobytes()


def _quantised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = batch.column("vector")
        flat, offsets = vectors.values.to_numpy(zero_copy_only=False), vectors.offsets.to_numpy()
        with np.errstate(over="ignore"):
            numbers = np.floor(np.clip(256.0 * flat, -HUGE, HUGE))
        packed = [_packed(numbers[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(packed, pa.binary())], names=VECTORS.names)


def _finite(vector: Column) -> Column:
    return F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))  # NaN is above all numbers


def prepared(df: DataFrame, key: str, vector: str, label: Column) -> DataFrame:
    """One row per id: label and integers."""
    values = F.transform(F.col(vector), lambda x: x.cast("double"))
    ready = df.select(F.col(key).cast("long").alias("id"), label.cast("string").alias("label"), values.alias("vector"))
    ready = ready.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & _finite(F.col("vector")))
    packed = ready.mapInArrow(_quantised, VECTORS)
    one = packed.groupBy("id").agg(F.min(F.struct("label", "numbers")).alias("x"))
    return one.select("id", "x.*")


class Vectors:
    """The rows of one group as arrays."""

    def __init__(self, table: pa.Table) -> None:
        order = np.argsort(table.column("id").to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        self.ids = table.column("id").to_numpy()
        self.labels = np.array(table.column("label").to_pylist(), dtype=str)
        rows = [np.frombuffer(x[1:], _KINDS[x[0]]) for x in table.column("numbers").to_pylist()]
        self.exact = _padded([r.astype(np.float64) for r in rows])
        self.most = float(np.abs(self.exact).max(initial=0))
        self.levels = summaries(self.exact)

    def __len__(self) -> int:
        return len(self.ids)

    def widened(self, width: int) -> Vectors:
        """All matrices with zeros up to ``width`` components."""
        more = width - self.exact.shape[1]
        if more > 0:
            self.exact = np.pad(self.exact, ((0, 0), (0, more)))
            self.levels = [tuple(np.pad(x, ((0, 0), (0, more // w))) for x in pair) for pair, w in zip(self.levels, WIDTHS, strict=True)]
        return self


def bounds(anchors: Vectors, a: np.ndarray, rows: Vectors, r: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores of anchors ``a`` with rows ``r`` from one segment width."""
    (mean_a, dev_a), (mean_r, dev_r) = anchors.levels[level], rows.levels[level]
    with np.errstate(over="ignore", invalid="ignore"):
        middle = WIDTHS[level] * (mean_a[a] @ mean_r[r].T)
        spread = dev_a[a] @ dev_r[r].T
        # the sizes of all terms bound what rounding may have changed
        spread += SLACK * (spread + WIDTHS[level] * (np.abs(mean_a[a]) @ np.abs(mean_r[r]).T)) + 1
        low, high = middle - spread, middle + spread
    # beyond the range of the summaries nothing is known
    return np.where(np.isnan(low), -np.inf, low), np.where(np.isnan(high), np.inf, high)


def scores(anchors: Vectors, a: np.ndarray, rows: Vectors, r: np.ndarray) -> np.ndarray:
    """Exact integer inner products."""
    left, right = anchors.exact[a], rows.exact[r]
    most = anchors.most * rows.most * left.shape[1]
    if most < 1 << 53:
        return (left @ right.T).astype(np.int64)
    if most < 1 << 63:
        return left.astype(np.int64) @ right.astype(np.int64).T
    whole = np.array([[int(x) for x in row] for row in left], dtype=object) @ np.array([[int(x) for x in row] for row in right], dtype=object).T
    return np.clip(whole, -MOST, MOST).astype(np.int64)


class Refined:
    """Pairs of some anchors with some rows that the bounds leave, level by level."""

    def __init__(self, anchors: Vectors, rows: Vectors) -> None:
        self.anchors, self.rows = anchors, rows.widened(anchors.exact.shape[1])
        anchors.widened(rows.exact.shape[1])
        codes = np.unique(np.concatenate([anchors.labels, rows.labels]), return_inverse=True)[1]
        self.anchor_codes, self.row_codes = codes[: len(anchors)], codes[len(anchors) :]
        self.met = self.scored = 0

    def pairs(self, a: np.ndarray, r: np.ndarray, open_pairs: np.ndarray, narrow) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchor positions, row positions and exact scores of what is left.

        ``narrow(low, high, open)`` says which of the open pairs their bounds cannot rule out.
        """
        self.met += int(open_pairs.sum())
        for level in range(len(WIDTHS)):
            used = open_pairs.any(axis=0)
            r, open_pairs = r[used], open_pairs[:, used]
            open_pairs = open_pairs & narrow(*bounds(self.anchors, a, self.rows, r, level), open_pairs)
        used = open_pairs.any(axis=0)
        r, open_pairs = r[used], open_pairs[:, used]
        at, column = np.nonzero(open_pairs)
        self.scored += len(at)
        return a[at], r[column], scores(self.anchors, a, self.rows, r)[at, column]


def _kth_largest(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest value of every row; minus infinity if there are fewer."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf)
    return np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k]


def _ranked(anchor: np.ndarray, row: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by anchor, falling score and row, and the place of every entry among those of its anchor."""
    order = np.lexsort((row, -score, anchor))
    ordered = anchor[order]
    return order, np.arange(len(order)) - np.searchsorted(ordered, ordered)


POSITIVES = T.StructType([T.StructField(c, T.LongType()) for c in ("anchor_id", "positive_id", "positive_score")])
NEGATIVES = T.StructType([T.StructField(c, T.LongType()) for c in ("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")])


def positives_of_group(anchors: Vectors, rows: Vectors, many: int, counted: list | None = None) -> pa.Table:
    """The best ``many`` rows of an anchor's own label, of one group of rows."""
    refined, out = Refined(anchors, rows), []
    for label in np.unique(refined.anchor_codes):
        members, same = np.flatnonzero(refined.anchor_codes == label), np.flatnonzero(refined.row_codes == label)
        for low in range(0, len(members), SCORE_ANCHORS):
            a = members[low : low + SCORE_ANCHORS]
            best = [np.zeros(0, np.int64)] * 3  # anchor, row and score of the best so far
            floor = np.full(len(a), -np.inf)
            for begin in range(0, len(same), SCORE_ROWS):
                r = same[begin : begin + SCORE_ROWS]

                def narrow(least: np.ndarray, most: np.ndarray, still: np.ndarray, floor: np.ndarray = floor) -> np.ndarray:
                    return most >= np.maximum(floor, _kth_largest(np.where(still, least, -np.inf), many))[:, None]

                found = refined.pairs(a, r, anchors.ids[a][:, None] != rows.ids[r][None, :], narrow)
                best = [np.concatenate(x) for x in zip(best, found, strict=True)]
                order, place = _ranked(*best)
                best, place = [x[order[place < many]] for x in best], place[place < many]
                full = place == many - 1
                floor[np.searchsorted(a, best[0][full])] = best[2][full]
            out.append((anchors.ids[best[0]], rows.ids[best[1]], best[2]))
    if counted is not None:
        counted.append((refined.met, refined.scored))
    return _table(out, POSITIVES)


def negatives_of_group(
    anchors: Vectors, positives: dict[int, list[tuple[int, int]]], rows: Vectors, many: int, band: tuple[int, int], counted: list | None = None
) -> pa.Table:
    """For every anchor and positive the best ``many`` rows of other labels within the band, of one group."""
    refined, out = Refined(anchors, rows), []
    wanted = np.array([i for i in range(len(anchors)) if positives.get(int(anchors.ids[i]))], dtype=np.int64)
    for low in range(0, len(wanted), SCORE_ANCHORS):
        a = wanted[low : low + SCORE_ANCHORS]
        lists = [positives[int(anchors.ids[i])] for i in a]
        widest = max(map(len, lists))
        # lowest and highest score of every anchor's bands, and the worst of its best so far
        floors = np.array([[-((-band[0] * s) // 100) for _, s in x] + [MOST] * (widest - len(x)) for x in lists], dtype=np.int64)
        tops = np.array([[band[1] * s // 100 for _, s in x] + [-MOST] * (widest - len(x)) for x in lists], dtype=np.int64)
        best = {(i, j): (np.zeros(0, np.int64), np.zeros(0, np.int64)) for i, x in enumerate(lists) for j in range(len(x))}
        for begin in range(0, len(rows), SCORE_ROWS):
            r = np.arange(begin, min(begin + SCORE_ROWS, len(rows)))
            other = refined.anchor_codes[a][:, None] != refined.row_codes[r][None, :]

            def narrow(least: np.ndarray, most: np.ndarray, still: np.ndarray, floors: np.ndarray = floors, tops: np.ndarray = tops) -> np.ndarray:
                left = np.zeros(still.shape, bool)
                for j in range(floors.shape[1]):
                    left |= (most >= floors[:, j, None]) & (least <= tops[:, j, None])
                return left

            at, row, score = refined.pairs(a, r, other, narrow)
            order, _ = _ranked(at, row, score)
            at, row, score = at[order], row[order], score[order]
            cuts = np.searchsorted(at, a), np.searchsorted(at, a, side="right")
            for i, (one, end) in enumerate(zip(*cuts, strict=True)):
                falling, own = -score[one:end], row[one:end]
                for j in range(len(lists[i]) if end > one else 0):
                    first = int(np.searchsorted(falling, -tops[i, j]))
                    last = min(int(np.searchsorted(falling, -floors[i, j], side="right")), first + many)
                    if last > first:
                        rows_so_far, scores_so_far = (np.concatenate(x) for x in zip(best[i, j], (own[first:last], -falling[first:last]), strict=True))
                        keep = np.lexsort((rows_so_far, -scores_so_far))[:many]
                        best[i, j] = rows_so_far[keep], scores_so_far[keep]
                        if len(keep) == many:
                            floors[i, j] = scores_so_far[keep[-1]]
        for (i, j), (row, score) in best.items():
            positive, p = lists[i][j]
            k = len(row)
            out.append((np.full(k, anchors.ids[a[i]]), np.full(k, positive), np.full(k, p), rows.ids[row], score))
    if counted is not None:
        counted.append((refined.met, refined.scored))
    return _table(out, NEGATIVES)


def _table(parts: list[tuple[np.ndarray, ...]], schema: T.StructType) -> pa.Table:
    columns = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * len(schema)
    return pa.table([pa.array(c.astype(np.int64)) for c in columns], names=schema.names)


def _best(df: DataFrame, keys: list[str], score: str, row: str, many: int) -> DataFrame:
    """The best ``many`` of every key with their rank."""
    order = Window.partitionBy(*keys).orderBy(F.desc(score), row)
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= many)


def _grid(rows: DataFrame, anchors: DataFrame, n_groups: int, n_blocks: int):
    """Every group of rows beside every block of anchors."""
    group, block = F.pmod(F.xxhash64("id"), F.lit(n_groups)), F.pmod(F.xxhash64("id"), F.lit(n_blocks))
    all_groups, all_blocks = F.sequence(F.lit(0), F.lit(n_groups - 1)), F.sequence(F.lit(0), F.lit(n_blocks - 1))
    dealt_rows = rows.withColumns({"group": group.cast("int")}).withColumn("block", F.explode(all_blocks))
    dealt_anchors = anchors.withColumns({"block": block.cast("int")}).withColumn("group", F.explode(all_groups))
    return dealt_rows.groupBy("group", "block"), dealt_anchors.groupBy("group", "block")


def hard_negatives(
    df: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: Column | None = None,
    anchor: Column | None = None,
    positives: int = 5,
    negatives: int = 10,
    band: tuple[int, int] = (30, 90),
    group_rows: int = GROUP_ROWS,
    block_anchors: int = BLOCK_ANCHORS,
) -> DataFrame:
    """The best negatives of every anchor and each of its best positives.

    ``anchor`` says of the column ``id`` which rows are anchors; a negative's
    score lies within ``band`` hundredths of the positive's.
    """
    rows = checkpointed(prepared(df, key, vector, F.col("label") if label is None else label))
    queries = rows.where(F.col("id") % 100 == 0 if anchor is None else anchor)
    n_groups = max(1, math.ceil(rows.count() / group_rows))
    n_blocks = max(1, math.ceil(queries.count() / block_anchors))
    # more, smaller groups where there would be fewer tasks than cores
    cores = df.sparkSession.sparkContext.defaultParallelism
    n_groups = max(n_groups, min(cores, math.ceil(rows.count() / 2_000)))

    def find_positives(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        if not anchors.num_rows or not rows.num_rows:
            return _table([], POSITIVES)
        return positives_of_group(Vectors(anchors), Vectors(rows), positives)

    met, asked = _grid(rows, queries, n_groups, n_blocks)
    near = met.cogroup(asked).applyInArrow(find_positives, POSITIVES)
    chosen = _best(near, ["anchor_id"], "positive_score", "positive_id", positives).drop("rank")
    chosen = chosen.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))
    with_positives = checkpointed(queries.join(chosen, "id"))

    def find_negatives(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        if not anchors.num_rows or not rows.num_rows:
            return _table([], NEGATIVES)
        lists = {
            i: [(p["positive_id"], p["positive_score"]) for p in x]
            for i, x in zip(anchors.column("id").to_pylist(), anchors.column("positives").to_pylist(), strict=True)
        }
        return negatives_of_group(Vectors(anchors), lists, Vectors(rows), negatives, band)

    met, asked = _grid(rows, with_positives, n_groups, n_blocks)
    far = met.cogroup(asked).applyInArrow(find_negatives, NEGATIVES)
    best = _best(far, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives)
    return best.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def mined(df: DataFrame) -> DataFrame:
    """Negatives for the vectors whose id is divisible by 100; a seventh of the labels is moved on by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(df, label=moved)
