"""Operator 9: shards by best-fit-decreasing bin packing.

Rows with equal texts form a group that is never split.  Every group is an
item of the packing, whatever its size.  Groups of equal size are alike to the
packing, so it works on (size, number of groups): the bin with the tightest
remaining capacity, which a balanced tree finds, stays the tightest while it
takes more items of that size, hence takes as many as fit at once.  The result
is that of best fit decreasing item by item.  There are at most
``sqrt(2 * bytes)`` different sizes, as their sum is at most the bytes of all
rows; only they reach the driver.  Groups get their bin by their rank among
the groups of their size.

A null text has no bytes and forms one group.  Texts may have any length, only
sizes and hashes of them are moved.  An empty table gives no rows.  Repeated
rows are rows of their own.  Input columns that have the name of an added
column are replaced, all others stay as they are.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearthmark.llm import textops
from hearthmark.session import checkpointed

ROW_BYTES = 8
PIECE_ROWS = 100_000
#: Groups with at least this part of all rows are placed by a broadcast table.
HOT_PARTS = 1000
#: Rows of 40 bytes up to which the table of runs is broadcast.
BROADCAST_RUNS = 1_000_000


class Run(NamedTuple):
    """Items ``first`` to ``first + count - 1`` of a size: ``each`` of them to a bin, from ``bin`` on."""

    size: int
    first: int
    count: int
    bin: int
    each: int


@dataclass(slots=True)
class _Node:
    key: tuple[int, int]
    height: int = 1
    left: _Node | None = None
    right: _Node | None = None


def _height(node: _Node | None) -> int:
    return node.height if node else 0


def _fixed(node: _Node) -> _Node:
    """The node after one rotation, if its sides differ by more than one level."""
    node.height = 1 + max(_height(node.left), _height(node.right))
    tilt = _height(node.left) - _height(node.right)
    if tilt > 1:
        if _height(node.left.left) < _height(node.left.right):
            node.left = _turned(node.left, "right", "left")
        return _turned(node, "left", "right")
    if tilt < -1:
        if _height(node.right.right) < _height(node.right.left):
            node.right = _turned(node.right, "left", "right")
        return _turned(node, "right", "left")
    return node


def _turned(node: _Node, up: str, down: str) -> _Node:
    top = getattr(node, up)
    setattr(node, up, getattr(top, down))
    setattr(top, down, node)
    for x in (node, top):
        x.height = 1 + max(_height(x.left), _height(x.right))
    return top


class Bins:
    """Open bins by (remaining capacity, number) in a height-balanced tree."""

    def __init__(self) -> None:
        self.root: _Node | None = None

    def add(self, key: tuple[int, int]) -> None:
        self.root = self._add(self.root, key)

    def _add(self, node: _Node | None, key: tuple[int, int]) -> _Node:
        if node is None:
            return _Node(key)
        if key < node.key:
            node.left = self._add(node.left, key)
        else:
            node.right = self._add(node.right, key)
        return _fixed(node)

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return the bin with the least remaining capacity of at least ``size``."""
        best, node = None, self.root
        while node:
            if node.key[0] >= size:
                best, node = node.key, node.left
            else:
                node = node.right
        if best is not None:
            self.root = self._drop(self.root, best)
        return best

    def _drop(self, node: _Node, key: tuple[int, int]) -> _Node | None:
        if key < node.key:
            node.left = self._drop(node.left, key)
        elif key > node.key:
            node.right = self._drop(node.right, key)
        elif node.left is None or node.right is None:
            return node.left or node.right
        else:
            least = node.right
            while least.left:
                least = least.left
            node.key = least.key
            node.right = self._drop(node.right, least.key)
        return _fixed(node)


def pack(classes: list[tuple[int, int]], capacity: int, most: int | None = None) -> list[Run] | None:
    """Runs of items for (size, count) pairs sorted by falling size; None if more than ``most`` bins are needed.

    An item larger than the capacity gets a bin of its own.
    """
    bins, used, runs = Bins(), 0, []
    for size, count in classes:
        first = 0
        while first < count:
            found = bins.take(size)
            if found is None:
                each = max(1, capacity // size)
                opened = -(-(count - first) // each)
                if most is not None and used + opened > most:
                    return None
                runs.append(Run(size, first, count - first, used, each))
                last = count - first - (opened - 1) * each
                for number in range(used, used + opened):
                    taken = last if number == used + opened - 1 else each
                    bins.add((max(capacity, size) - taken * size, number))
                used, first = used + opened, count
            else:
                taken = min(count - first, found[0] // size)
                runs.append(Run(size, first, taken, found[1], taken))
                bins.add((found[0] - taken * size, found[1]))
                first += taken
    return runs


def balanced(classes: list[tuple[int, int]], shards: int) -> list[Run]:
    """Runs in bins 0..shards-1 for (size, count) pairs sorted by falling size, under the least capacity that suffices.

    Items above the even share of what is left get a bin of their own first.
    """
    left, rest, alone = [], sum(size * count for size, count in classes), []
    for size, count in classes:
        own = 0
        while not left and own < count and len(alone) < shards - 1 and size * (shards - len(alone)) >= rest:
            rest -= size
            alone.append(Run(size, own, 1, len(alone), 1))
            own += 1
        if own < count:
            left.append((size, count - own, own))
    if not left:
        return alone
    items, bins = [(size, count) for size, count, _ in left], shards - len(alone)
    low = max(-(-rest // bins), items[0][0])
    high = 2 * low
    best = pack(items, high, bins)
    while best is None:
        high *= 2
        best = pack(items, high, bins)
    while low < high:
        middle = (low + high) // 2
        found = pack(items, middle, bins)
        if found is None:
            low = middle + 1
        else:
            best, high = found, middle
    # only the first class that is left can have lost items to bins of their own
    size, _, own = left[0]
    return alone + [
        Run(r.size, r.first + (own if r.size == size else 0), r.count, r.bin + len(alone), r.each) for r in best
    ]


def shard(df: DataFrame, shards: int = 24, capacity: int | None = None, text: str = "text", order: str = "doc_id") -> DataFrame:
    """Add ``size``, ``text_crc32``, ``shard`` and ``slot`` to every row.

    With ``capacity`` the number of shards is what best fit needs for shards of
    that many bytes; without, exactly ``shards`` near-equal shards are filled.
    Slots count the rows of a shard from 0, without gaps.
    """
    session = df.sparkSession
    given = df.drop("size", "text_crc32", "shard", "slot")
    group, piece = textops.free_names(given.columns, "group", "piece")
    body = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    sized = given.select(
        "*", (F.octet_length(body) + ROW_BYTES).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.xxhash64(text).alias(group)
    )
    # read again for the sizes, the ranks and the bins: three numbers per distinct text
    groups = checkpointed(sized.groupBy(F.col(group).alias("group")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")))
    classes = [(r.bytes, r.n) for r in groups.groupBy("bytes").agg(F.count(F.lit(1)).alias("n")).collect()]  # see the module text for their bound
    classes.sort(reverse=True)
    n_groups, n_rows = sum(n for _, n in classes), groups.agg(F.sum("rows")).first()[0] or 0
    runs = balanced(classes, shards) if capacity is None else pack(classes, capacity)
    table = session.createDataFrame(
        [(r.size, r.first, r.count, r.bin, r.each) for r in runs], "bytes long, first long, count long, bin long, each long"
    )
    ranked = _numbered(
        groups.withColumn("piece", F.pmod(F.xxhash64("group"), F.lit(max(8, -(-n_groups // PIECE_ROWS)))).cast("int")), "bytes", "piece", ["group"], "rank"
    )
    inside = (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("count"))
    small = len(runs) <= BROADCAST_RUNS
    placed = ranked.join(F.broadcast(table) if small else table, "bytes").where(inside)
    placed = placed.select(
        F.col("group").alias(group), (F.col("bin") + F.floor((F.col("rank") - F.col("first")) / F.col("each"))).cast("int").alias("shard"), "rows"
    )
    # at most HOT_PARTS groups can hold so many rows; theirs are placed without a shuffle by group
    hot = placed.where(F.col("rows") * HOT_PARTS >= n_rows).drop("rows")
    cold = placed.where(F.col("rows") * HOT_PARTS < n_rows).drop("rows")
    known = sized.join(F.broadcast(hot), group, "left")
    rows = known.where(F.col("shard").isNotNull()).unionByName(known.where(F.col("shard").isNull()).drop("shard").join(cold, group))
    pieces = max(8, -(-n_rows // (shards * PIECE_ROWS)))
    cutted = rows.withColumn(piece, F.pmod(F.xxhash64(order, group), F.lit(pieces)).cast("int"))
    return _numbered(cutted, "shard", piece, [order, group], "slot").drop(group, piece)


def _numbered(df: DataFrame, key: str, piece: str, order: list[str], name: str) -> DataFrame:
    """Rows of a key counted from 0 as ``name``: pieces are counted first, then numbered apart from each other."""
    n, before = textops.free_names([*df.columns, name], "n", "before")
    counts = df.groupBy(key, piece).agg(F.count(F.lit(1)).alias(n))
    earlier = Window.partitionBy(key).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(key, piece, F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(before))
    inside = Window.partitionBy(key, piece).orderBy(*order)
    return df.join(starts, [key, piece]).withColumn(name, (F.row_number().over(inside) - 1 + F.col(before)).cast("long")).drop(before)


def placement(df: DataFrame, shards: int = 24) -> DataFrame:
    """Shard and slot of every row of (doc_id, text) under the law of near-equal bytes."""
    done = shard(df.select("doc_id", "text"), shards)
    return done.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
