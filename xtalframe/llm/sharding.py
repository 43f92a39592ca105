"""Contiguous shards of near-equal bytes: minimax partition of ordered atoms."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from xtalframe.llm.common import texts, written

ATOM_BITS = 16
STEP_BITS = 4
CELLS = 2048
OVERHEAD = 16


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """The least capacity with which a greedy walk over ``sizes``, in order,
    needs at most ``shards`` shards."""
    prefix = [0, *accumulate(sizes)]

    def fits(capacity: int) -> bool:
        at = 0
        for _ in range(shards):
            at = bisect_right(prefix, prefix[at] + capacity) - 1
            if at == len(sizes):
                return True
        return False

    low, high = max([0, *sizes, -(-prefix[-1] // shards)]), prefix[-1]
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fits(middle) else (middle + 1, high)
    return low


def cut_points(sizes: list[int], shards: int) -> list[int]:
    """Ends (exclusive) of all shards but the last.

    No shard exceeds the smallest feasible capacity. Among such partitions each
    cut goes as near as it can to an equal share of what is left, so that the
    last shards are not the ones that stay empty.
    """
    prefix, n = [0, *accumulate(sizes)], len(sizes)
    capacity = smallest_capacity(sizes, shards)
    # earliest[j]: the first atom from which j shards still hold the rest
    earliest = [n]
    for _ in range(shards - 1):
        earliest.append(bisect_left(prefix, prefix[earliest[-1]] - capacity))
    cuts, at = [], 0
    for left in range(shards, 1, -1):
        share = prefix[at] + (prefix[n] - prefix[at]) / left
        end = bisect_left(prefix, share, lo=at)
        if end > at and share - prefix[end - 1] <= prefix[min(end, n)] - share:
            end -= 1
        most = bisect_right(prefix, prefix[at] + capacity) - 1
        at = min(max(end, earliest[left - 1], at), most)
        cuts.append(at)
    return cuts


class Atom(NamedTuple):
    """Neighbouring groups in hash order: all hashes that begin with ``prefix``,
    ``depth`` bits of it."""

    prefix: int
    depth: int
    size: int
    single: bool  # one group, or as many bits as there are

    @property
    def start(self) -> int:
        return self.prefix << 64 - self.depth


def relaxed_walk(atoms: list[Atom], prefix: list[int], capacity: int, shards: int) -> list[int]:
    """Where a greedy walk could get at best: atoms of several groups may be cut
    anywhere, single groups nowhere."""
    out, at = [], 0
    for _ in range(shards):
        end = min(at + capacity, prefix[-1])
        k = bisect_right(prefix, end) - 1
        if k < len(atoms) and prefix[k] < end and atoms[k].single:
            end = max(prefix[k], at)
        at = end
        out.append(at)
    return out


def unsettled(atoms: list[Atom], shards: int, coarse: int) -> list[Atom]:
    """Atoms whose inner cuts could matter: very large ones first; then those in
    which a shard's end may fall, whatever the final capacity, and those beside
    a cut."""
    open_ = [not a.single and a.size > 0 for a in atoms]
    large = [a for a, o in zip(atoms, open_) if o and a.size > coarse]
    if large:
        return large
    sizes = [a.size for a in atoms]
    prefix = [0, *accumulate(sizes)]
    upper, low = smallest_capacity(sizes, shards), max([0, -(-prefix[-1] // shards), *(a.size for a in atoms if a.single)])
    high = upper
    while low < high:  # the least capacity that some inner cuts might allow
        middle = (low + high) // 2
        low, high = (low, middle) if relaxed_walk(atoms, prefix, middle, shards)[-1] == prefix[-1] else (middle + 1, high)
    marked = {k for c in cut_points(sizes, shards) for k in (c - 1, c)}
    if low < upper:
        first = 0
        for best in relaxed_walk(atoms, prefix, upper, shards):
            first = max(bisect_right(prefix, prefix[first] + low) - 1, first)
            marked |= set(range(first, bisect_left(prefix, best) + 1))
    return [atoms[k] for k in sorted(marked) if 0 <= k < len(atoms) and open_[k]]


def refined(rows: DataFrame, shards: int, bits: int, step: int = STEP_BITS) -> list[Atom]:
    """Atoms in hash order, opened down to single groups wherever the smallest
    capacity or a cut depends on it. Each round is one aggregate over the atoms
    to open: at most 2**bits atoms come to the driver first, and 2**step for
    each opened one, of which there are some tens for each shard."""

    def read(part: DataFrame, depth: int) -> list[Atom]:
        prefix = F.shiftright("hash", 64 - depth)
        sums = part.groupBy(prefix.alias("p")).agg(F.sum("size").alias("n"), F.min("hash").alias("a"), F.max("hash").alias("b"))
        return [Atom(r["p"], depth, r["n"], r["a"] == r["b"] or depth == 64) for r in sums.collect()]

    atoms = sorted(read(rows, bits), key=lambda a: a.start)
    coarse = sum(a.size for a in atoms) >> max(0, bits - 2)
    while opened := unsettled(atoms, shards, coarse):
        kept = set(atoms) - set(opened)
        for depth in sorted({a.depth for a in opened}):
            asked = [(a.prefix,) for a in opened if a.depth == depth]
            these = rows.sparkSession.createDataFrame(asked, "p long")
            inside = rows.join(F.broadcast(these), F.shiftright("hash", 64 - depth) == F.col("p"), "left_semi")
            kept |= set(read(inside, min(64, depth + step)))
        atoms = sorted(kept, key=lambda a: a.start)
    return atoms


def minimax_shards(docs: DataFrame, shards: int = 40, atom_bits: int = ATOM_BITS, cells: int = CELLS) -> DataFrame:
    """Shard and slot of every row, law ``bytes``.

    Equal texts form a group; groups are ordered by a hash, and a range of
    hashes is an atom. The driver gets the sizes of at most 2**atom_bits atoms,
    finds the smallest capacity and the cuts by binary search over greedy walks,
    and has the atoms opened that these depend on, down to single groups
    (``refined``): capacity and cuts are those over all ordered group sizes.
    Rows then get their shard from an expression over the cuts, without a join.
    Slots count up from 0 in each shard: rows are dealt by doc_id into ``cells``
    cells a shard, the cells' counts give each its first slot, and only rows of
    one cell are ranked together, so neither a shard nor a huge group is ever in
    one task.

    Null text has no bytes and groups with empty text; null doc_ids are rows
    like others; repeated rows get slots of their own, in any order among equal
    ones; of cuts that are equally near to a fair share the earlier is taken. A
    very long text is one row of its size. Columns besides doc_id and text are
    not looked at. An empty table has no rows.
    """
    rows = written(
        texts(docs).select(
            "doc_id",
            (F.octet_length("text") + OVERHEAD).cast("long").alias("size"),
            F.crc32("text").alias("text_crc32"),
            F.xxhash64("text").alias("hash"),
            F.pmod(F.xxhash64("doc_id", "text"), F.lit(cells)).cast("int").alias("cell"),
        ),
        "shard-rows",
    )
    atoms = refined(rows, shards, atom_bits)
    ends = [atoms[c].start for c in cut_points([a.size for a in atoms], shards) if c < len(atoms)]
    shard = sum(((F.col("hash") >= F.lit(e)).cast("int") for e in ends), F.lit(0))
    rows = rows.withColumn("shard", shard)
    # at most shards x cells rows: safe to broadcast at any input size
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    firsts = (
        rows.groupBy("shard", "cell")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    )
    rank = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "size"))
    return rows.join(F.broadcast(firsts), ["shard", "cell"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("first") + rank - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
