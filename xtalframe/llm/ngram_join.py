"""Near-duplicate documents by exact Jaccard similarity of word shingles."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xtalframe.llm.common import Aside, text_key, texts, written
from xtalframe.llm.components import components
from xtalframe.llm.textbytes import mix, parts, word_hashes

BAND_RATIO = 1.25
BITMAP_BYTES = 256  # at least; more where a set has more elements than that has bits
LEVELS = 4
TILE = 2048
KEYS_A_SET = 64  # tiles that a set lies in, about
KEYS_A_BUCKET = 4_000_000
MEMBERS_A_TASK = 500


class Rule:
    """Shingles of ``words`` words; linked when 100 * both >= percent * either."""

    def __init__(self, words: int, percent: int, id_bits: int = 64):
        self.words, self.percent, self.id_bits = words, percent, id_bits
        edges = [1]
        while edges[-1] < 1 << 40:
            edges.append(max(edges[-1] + 1, int(edges[-1] * BAND_RATIO)))
        self.edges = np.array(edges)

    def linked(self, both: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return 100 * both >= self.percent * (a + b - both)

    def differences(self, band: int) -> int:
        """The most elements in which two linked sets of a band can differ."""
        size = 2 * (int(self.edges[band + 1]) - 1)
        return (100 - self.percent) * size // (100 + self.percent)

    def tiles(self, band: int) -> int:
        """More parts than differences, and some to spare for weak ones."""
        d = self.differences(band)
        return math.ceil(1.5 * (d + 1)) + 2 if d else 0


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of every row, by row and in order: two independent
    64-bit hashes, which together stand for the shingle, and its row. A text of
    fewer words is one shingle; one without words has none."""
    both = []
    for seed in (0, 1):
        words, rows = word_hashes(data, offsets, seed=seed)
        n = len(words)
        factors = mix(np.arange(1, k + 1, dtype=np.uint64))
        full = max(0, n - k + 1)
        h = np.full(full, k, np.uint64)
        for j in range(k):
            h += words[j : j + full] * factors[j]
        ok = rows[:full] == rows[k - 1 : k - 1 + full]
        out, at = mix(h[ok]), rows[:full][ok]
        counts = np.bincount(rows, minlength=len(offsets) - 1)
        short = (counts > 0) & (counts < k)
        if short.any():
            firsts = np.concatenate([[0], np.cumsum(counts)])[:-1]
            which = np.flatnonzero(short)
            sums = counts[which].astype(np.uint64)
            for j in range(k - 1):
                inside = counts[which] > j
                sums[inside] += words[firsts[which[inside]] + j] * factors[j]
            out, at = np.concatenate([out, mix(sums)]), np.concatenate([at, which])
        both.append(out)
    h, g = both
    order = np.lexsort((h, at))
    h, g, at = h[order], g[order], at[order]
    same = (h[1:] == h[:-1]) & (at[1:] == at[:-1])
    if (same & (g[1:] != g[:-1])).any():  # the first hash alone isn't enough
        order = np.lexsort((g, h, at))
        h, g, at = h[order], g[order], at[order]
        same = (h[1:] == h[:-1]) & (at[1:] == at[:-1])
    new = np.ones(len(h), bool)
    new[1:] = ~same | (g[1:] != g[:-1])
    return h[new], g[new], at[new]


def shared_count(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> int:
    """Shingles that two sets share, by both hashes."""
    (ha, ga), (hb, gb) = a, b
    if not len(ha) or not len(hb):
        return 0
    if (ha[1:] == ha[:-1]).any() or (hb[1:] == hb[:-1]).any():
        return len(set(zip(ha.tolist(), ga.tolist())) & set(zip(hb.tolist(), gb.tolist())))
    place = np.minimum(np.searchsorted(ha, hb), len(ha) - 1)
    return int(((ha[place] == hb) & (ga[place] == gb)).sum())


def set_ids(rule: Rule, h: np.ndarray, g: np.ndarray, at: np.ndarray, n: int, clashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size, id and check of every row's set; id and check together, 128 bits,
    stand for the set. Ids that other sets have too are in ``clashes``, one
    array for each time that they were looked for; such sets get new ones."""
    sizes = np.bincount(at, minlength=n)
    a, b = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    np.add.at(a, at, mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
    np.add.at(b, at, mix(g + np.uint64(0x632BE59BD9B4E019)))
    a, b = mix(a + sizes.astype(np.uint64)) >> np.uint64(64 - rule.id_bits), mix(b)
    for number, known in enumerate(clashes):
        hit = np.isin(a, known)
        a[hit] = mix(a[hit] ^ mix(b[hit] + np.uint64(number)))
    return sizes, a, b


def bitmaps(h: np.ndarray, at: np.ndarray, n: int) -> list[bytes]:
    """One bit for each hash, in a power of two of bits, no fewer than elements:
    in a fuller map the bits of two unlike sets would cover each other."""
    sizes = np.maximum(np.bincount(at, minlength=n), 8 * BITMAP_BYTES)
    bits = 1 << np.ceil(np.log2(sizes)).astype(np.int64)
    base = np.concatenate([[0], np.cumsum(bits // 8)])
    out = np.zeros(base[-1], np.uint8)
    place = (h & (bits[at] - 1).astype(np.uint64)).astype(np.int64)
    np.bitwise_or.at(out, base[at] + (place >> 3), np.uint8(1) << (place & 7).astype(np.uint8))
    return [out[a:b].tobytes() for a, b in zip(base[:-1], base[1:])]


def folded(bits: list[bytes]) -> np.ndarray:
    """Bitmaps at the width of the narrowest: halves of wider ones are joined."""
    width = min(map(len, bits)) // 8
    return np.array([np.bitwise_or.reduce(np.frombuffer(b, np.uint64).reshape(-1, width), 0) for b in bits])


def signatures(rule: Rule, h: np.ndarray, at: np.ndarray, sizes: np.ndarray, take: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Key and row of every tile that the rows in ``take`` lie in.

    A set belongs to its size band, and to the following ones as far as a linked
    set may be there. In a band, elements are dealt by hash into more parts than two linked
    sets can differ in, so one part at least is equal in both: (band, part,
    content) is the tile's key. Parts of few elements are equal by chance, above
    all where many texts share a passage, and empty ones always are. A set
    therefore keeps only its parts of L elements or more, L as large (up to
    ``LEVELS``) as leaves it more parts than differences. Of a linked pair, the
    set with the larger L has such a part that is equal in both, and the other
    set, with its smaller L, has kept it too.
    """
    band = np.searchsorted(rule.edges, np.maximum(sizes, 1), "right") - 1
    keys, owners = [], []
    furthest = np.searchsorted(rule.edges, np.maximum(sizes * 100 // rule.percent, 1), "right") - 1
    last = int((furthest - band)[take].max()) if take.any() else 0
    for step in range(max(last, 1) + 1):
        here = take & (sizes > 0) & (band + step <= furthest)
        target = band + step
        present = np.unique(target[here])
        n_parts = np.zeros(len(rule.edges), np.int64)
        spare = np.zeros(len(rule.edges), np.int64)
        for b in present:
            n_parts[b], spare[b] = rule.tiles(b), rule.differences(b)
        per_row = np.where(here, n_parts[target], 0)
        base = np.concatenate([[0], np.cumsum(per_row)])
        used = per_row[at] > 0
        ha, ra = h[used], at[used]
        part = (mix(ha) % per_row[ra].astype(np.uint64)).astype(np.int64)
        content = np.zeros(base[-1], np.uint64)
        np.add.at(content, base[ra] + part, mix(ha ^ np.uint64(0x5851F42D4C957F2D)))
        held = np.bincount(base[ra] + part, minlength=base[-1])
        owner = np.repeat(np.arange(len(sizes)), per_row)
        number = np.arange(base[-1]) - base[owner]
        level = np.zeros(len(sizes), np.int64)
        for at_least in range(1, LEVELS + 1):
            enough = np.bincount(owner[held >= at_least], minlength=len(sizes)) > spare[target]
            level[enough] = at_least
        filled = held >= level[owner]
        where = (target[owner] * (1 << 32) + number).astype(np.uint64)
        keys.append(mix(content + mix(where))[filled])
        owners.append(owner[filled])
    return np.concatenate(keys), np.concatenate(owners)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def document_sets(docs: DataFrame, rule: Rule, clashes: list[np.ndarray]) -> DataFrame:
    """doc_id, text_key, n, set_id, check of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in parts(batch, 2):
                h, g, at = shingles(data, offsets, rule.words)
                sizes, a, b = set_ids(rule, h, g, at, part.num_rows, clashes)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), part.column(1), _long(sizes), _long(a), _long(b)],
                    names=["doc_id", "text_key", "n", "set_id", "check"],
                )

    return docs.mapInArrow(run, "doc_id long, text_key long, n long, set_id long, check long")


def identified_sets(docs: DataFrame, rule: Rule) -> tuple[DataFrame, list[np.ndarray]]:
    """``document_sets``, stored, with an id of its own for every set, and the
    ids that had to be changed: of 10**10 sets some three pairs share 64 bits."""
    clashes: list[np.ndarray] = []
    while True:
        nodes = written(document_sets(docs, rule, clashes), "document-sets")
        twice = nodes.where("n > 0").groupBy("set_id").agg(F.min("check").alias("a"), F.max("check").alias("b")).where("a <> b")
        found = np.array([r[0] for r in twice.select("set_id").collect()], np.int64)  # a handful, if any
        if not len(found):
            return nodes, clashes
        clashes = [*clashes, found.view(np.uint64)]


def tile_rows(docs: DataFrame, rule: Rule, buckets: int, clashes: list[np.ndarray]) -> DataFrame:
    """bucket, rows: tile keys with the sets in them, packed.

    A set yields some tens of keys of twelve bytes; as rows of their own they
    would cost several times that. Every task signs each set once.
    """
    packed = np.dtype([("key", "<u4"), ("set", "<u8")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            for part, data, offsets in parts(batch, 2):
                h, g, at = shingles(data, offsets, rule.words)
                sizes, a, _ = set_ids(rule, h, g, at, part.num_rows, clashes)
                take = np.zeros(part.num_rows, bool)
                for k, s in enumerate(a.tolist()):
                    if s not in done:
                        done.add(s)
                        take[k] = True
                keys, owners = signatures(rule, h, at, sizes, take)
                bucket = (keys >> np.uint64(32)) % np.uint64(buckets)
                order = np.argsort(bucket, kind="stable")
                rows = np.empty(len(keys), packed)
                rows["key"], rows["set"] = keys[order].astype(np.uint32), a[owners[order]]
                ends = np.concatenate([[0], np.cumsum(np.bincount(bucket.astype(int), minlength=buckets))])
                cuts = [(b, rows[ends[b] : ends[b + 1]].tobytes()) for b in range(buckets) if ends[b + 1] > ends[b]]
                if cuts:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([b for b, _ in cuts], pa.int32()), pa.array([x for _, x in cuts], pa.binary())],
                        names=["bucket", "rows"],
                    )

    return docs.mapInArrow(run, "bucket int, rows binary")


def shared_tiles(packed: DataFrame, buckets: int) -> DataFrame:
    """tile, n, set_id: the sets of every tile that has two or more, and how
    many it has."""
    kind = np.dtype([("key", "<u4"), ("set", "<u8")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for b, rows in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.setdefault(b, []).append(np.frombuffer(rows.as_buffer(), kind))
        for b in list(held):
            rows = np.concatenate(held.pop(b))
            key, member = rows["key"], rows["set"].view(np.int64)
            order = np.lexsort((member, key))
            key, member = key[order], member[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (member[1:] != member[:-1])
            key, member = key[new], member[new]
            _, number, n = np.unique(key, return_inverse=True, return_counts=True)
            more = np.flatnonzero(n[number] > 1)
            for start in range(0, len(more), 50_000):
                at = more[start : start + 50_000]
                tile = key[at].astype(np.int64) * buckets + b
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tile), pa.array(n[number[at]]), pa.array(member[at])], names=["tile", "n", "set_id"]
                )

    return packed.repartitionById(buckets, F.col("bucket")).mapInArrow(run, "tile long, n long, set_id long")


def hub_pairs(tiles: DataFrame) -> DataFrame:
    """hub, set_id, c: every set beside the hubs of its tiles, with the number
    of tiles they share.

    A tile's hub is the set of most company over all its tiles. Of an original
    and its variants, the original keeps all the contents that most variants
    kept, so it is the hub, and variants that are near it but not each other
    still hang together after one comparison each.
    """
    weight = tiles.groupBy("set_id").agg(F.sum("n").alias("w"))
    weighed = tiles.join(weight, "set_id")
    hubs = weighed.groupBy("tile").agg(F.max(F.struct("w", "set_id")).alias("h")).select("tile", F.col("h.set_id").alias("hub"))
    pairs = tiles.join(hubs, "tile").where("hub <> set_id")
    return pairs.groupBy("hub", "set_id").agg(F.count(F.lit(1)).alias("c"))


def involved_sets(docs: DataFrame, wanted: DataFrame, rule: Rule) -> DataFrame:
    """set_id, n, bits, data: one text of every set in ``wanted`` (set_id,
    doc_id, text_key); a null doc_id finds its row too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in parts(batch, 1):
                h, _, at = shingles(data, offsets, rule.words)
                n = part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(np.bincount(at, minlength=n)),
                        pa.array(bitmaps(h, at, n), pa.binary()),
                        part.column(1),
                    ],
                    names=["set_id", "n", "bits", "data"],
                )

    asked = wanted.select("set_id", F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
    same = docs["doc_id"].eqNullSafe(asked["_id"]) & (docs["text_key"] == asked["_key"])
    found = docs.join(asked, same).select("set_id", "data")
    return found.mapInArrow(run, "set_id long, n long, bits binary, data binary")


def exact_links(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (low, set_id) whose sorted arrays intersect enough.

    Members go to their low set's tasks, ``MEMBERS_A_TASK`` to one, however many
    there are; the low set's text goes once to each of those tasks.
    """
    n = pairs.groupBy("low").agg(F.count(F.lit(1)).alias("members"))
    salted = pairs.join(n, "low").select(
        "low",
        "set_id",
        F.pmod(F.xxhash64("set_id"), F.ceil(F.col("members") / MEMBERS_A_TASK).cast("long")).alias("salt"),
    )
    wanted = salted.unionByName(salted.select("low", "salt").distinct().withColumn("set_id", F.col("low")))
    rows = (
        wanted.join(sets.select("set_id", "data"), "set_id")
        .select("low", "salt", (F.col("low") != F.col("set_id")).alias("member"), "set_id", "data")
        .repartition("low", "salt")
        .sortWithinPartitions("low", "salt", "member")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, whose = (np.zeros(0, np.uint64),) * 2, None
        for batch in batches:
            for part, data, offsets in parts(batch, 4):
                h, g, at = shingles(data, offsets, rule.words)
                ends = np.searchsorted(at, np.arange(part.num_rows + 1))
                lows, salts, members, ids = (part.column(c).to_pylist() for c in range(4))
                out: list[tuple[int, int]] = []
                for k in range(part.num_rows):
                    mine = h[ends[k] : ends[k + 1]], g[ends[k] : ends[k + 1]]
                    if not members[k]:
                        current, whose = mine, (lows[k], salts[k])
                        continue
                    if whose != (lows[k], salts[k]):
                        raise ValueError(f"set {lows[k]} has members to compare but no text")
                    both = shared_count(current, mine)
                    if both and rule.linked(both, len(current[0]), len(mine[0])):
                        out.append((lows[k], ids[k]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())],
                    names=["low", "set_id"],
                )

    return rows.mapInArrow(run, "low long, set_id long")


def cross_pairs(tiles: DataFrame, roots: DataFrame, sets: DataFrame, rule: Rule, every: bool) -> DataFrame:
    """Pairs of sets that share a tile, hang together by no link so far, and
    whose bitmaps allow enough overlap; for each two components in a part of a
    tile one pair, or ``every`` pair.

    Each bit that one bitmap has and the other lacks is an element that the
    other set lacks: bit counts bound the overlap from above. A tile is dealt
    into blocks of about ``TILE`` sets, and every two blocks are a part of their
    own: a tile of any size spreads over tasks, and none holds more than two
    blocks of it.
    """
    named = tiles.select("tile", "n", "set_id").join(roots.select(F.col("node").alias("set_id"), "root"), "set_id", "left").withColumn(
        "root", F.coalesce("root", "set_id")
    )
    mixed = named.groupBy("tile").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("tile")
    blocks = F.ceil(F.col("n") / TILE)
    other = F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)
    held = named.select("tile", "set_id", "root", blocks.alias("blocks"), F.pmod(F.xxhash64("set_id", F.lit(3)), blocks).alias("block"))
    rows = (
        held.join(mixed, "tile")
        .select("tile", "set_id", "root", "block", F.explode(other).alias("other"))
        .select("tile", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), (F.col("block") > F.col("other")).alias("right"), "set_id", "root")
        .join(sets.select("set_id", "n", "bits"), "set_id")
        .repartition("tile", "x", "y")
        .sortWithinPartitions("tile", "x", "y")
    )

    def compare(right: np.ndarray, within: bool, ids: np.ndarray, roots: np.ndarray, n: np.ndarray, bits: np.ndarray) -> list[tuple[int, int]]:
        found, best = [], {}
        left, other = (np.arange(len(ids)),) * 2 if within else (np.flatnonzero(~right), np.flatnonzero(right))
        for a in range(0, len(left), TILE):
            for b in range(0, len(other), TILE):
                x, y = left[a : a + TILE], other[b : b + TILE]
                i, j = np.nonzero(roots[x, None] != roots[None, y])
                i, j = x[i], y[j]
                if within:
                    keep = i < j
                    i, j = i[keep], j[keep]
                i, j = (np.concatenate(v) if v else np.zeros(0, int) for v in zip(*_bounded(i, j, n, bits)))
                found += list(zip(i.tolist(), j.tolist()))
        if every:
            return [tuple(sorted((int(ids[i]), int(ids[j])))) for i, j in found]
        for i, j in found:
            best.setdefault(tuple(sorted((roots[i], roots[j]))), tuple(sorted((int(ids[i]), int(ids[j])))))
        return list(best.values())

    def _bounded(i: np.ndarray, j: np.ndarray, n: np.ndarray, bits: np.ndarray) -> Iterator[tuple]:
        yield np.zeros(0, int), np.zeros(0, int)
        for start in range(0, len(i), 1 << 16):
            a, b = i[start : start + (1 << 16)], j[start : start + (1 << 16)]
            ok = 100 * np.minimum(n[a], n[b]) >= rule.percent * np.maximum(n[a], n[b])
            a, b = a[ok], b[ok]
            x, y = bits[a], bits[b]
            only_a = np.bitwise_count(x & ~y).sum(1, dtype=np.int64)
            only_b = np.bitwise_count(y & ~x).sum(1, dtype=np.int64)
            most = np.minimum(n[a] - only_a, n[b] - only_b)
            ok = rule.linked(most, n[a], n[b])
            yield a[ok], b[ok]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def key_of(t: pa.Table) -> np.ndarray:
            return np.stack([t.column(c).to_numpy() for c in ("tile", "x", "y")], 1)

        def whole_parts() -> Iterator[pa.Table]:
            rest = None
            for batch in batches:
                t = pa.Table.from_batches([batch])
                rest = t if rest is None else pa.concat_tables([rest, t])
                key = key_of(rest)
                if len(key) and (key[0] != key[-1]).any():
                    cut = len(key) - int((key[::-1] != key[-1]).any(1).argmax())
                    yield rest.slice(0, cut)
                    rest = rest.slice(cut)
            if rest is not None and rest.num_rows:
                yield rest

        for table in whole_parts():
            key = key_of(table)
            ids, roots_, n = (table.column(c).to_numpy() for c in ("set_id", "root", "n"))
            right = table.column("right").to_numpy(zero_copy_only=False)
            bits = table.column("bits").to_pylist()
            starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1)]))
            out: list[tuple[int, int]] = []
            for s, e in zip(starts, [*starts[1:], len(key)]):
                out += compare(right[s:e], key[s, 1] == key[s, 2], ids[s:e], roots_[s:e], n[s:e], folded(bits[s:e]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())],
                names=["low", "set_id"],
            )

    return rows.mapInArrow(run, "low long, set_id long").distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_bits: int = 64) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id and root (a set that names the
    component; null without words) of every row.

    Rows with one set are one node from the start, so copies cost nothing more.
    Sets meet in size-banded tiles (``signatures``); no linked pair can miss
    all of them. First each set is compared with the hub it shares most tiles
    with; then, for what hangs together by no link yet, one
    possible pair of every two components in a tile; then every such pair.
    Pairs inside a component need no test, which keeps thousands of near copies
    from being multiplied out. Every link is decided by exact intersection;
    shingles are told apart by 128 bits of two hashes, sets by 128 bits as well.

    Texts without words, null ones too, are linked with nothing, not even with
    each other: component_id is their own doc_id. Repeated rows fall together.
    Rows without doc_id never name a component that has another row. Very long
    texts take some hundred bytes for each word. Columns besides doc_id and text
    are not looked at. An empty table has no rows.
    """
    spark = docs.sparkSession
    rule = Rule(words, percent, id_bits)
    read = texts(docs).select("doc_id", text_key().alias("text_key"), F.col("text").cast("binary").alias("data"))
    nodes, clashes = identified_sets(read, rule)
    chosen = nodes.where("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"))

    # a bucket is held whole by a task: their number follows the data
    sets_read = nodes.agg(F.approx_count_distinct("set_id")).first()[0]
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), sets_read * KEYS_A_SET // KEYS_A_BUCKET)
    tiles = written(shared_tiles(tile_rows(read, rule, buckets, clashes), buckets), "shared-tiles")
    members = tiles.select("set_id").distinct()
    # a doc_id may come with several texts; one row of the set is enough
    wanted = (
        nodes.join(members, "set_id")
        .groupBy("set_id")
        .agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("d"))
        .select("set_id", "d.doc_id", "d.text_key")
    )
    sets = written(involved_sets(read, wanted, rule).dropDuplicates(["set_id"]), "involved-sets")

    pairs = written(hub_pairs(tiles), "hub-pairs")
    best = pairs.groupBy("set_id").agg(F.max(F.struct("c", "hub")).alias("b"))
    links = written(exact_links(best.select(F.col("b.hub").alias("low"), "set_id"), sets, rule), "links-hub")
    roots = components(links)
    for every in (False, True):
        more = written(cross_pairs(tiles, roots, sets, rule, every), "pairs-more")
        if more.isEmpty():  # then there is no pair left at all
            break
        links = written(links.unionByName(exact_links(more, sets, rule)), "links-more")
        roots = components(links)

    # the smallest doc_id of a component, over all rows of all its sets
    classes = chosen.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left")
    classes = classes.withColumn("root", F.coalesce("root", "set_id"))
    names = classes.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    by_set = classes.join(names, "root").select("set_id", "root", "component_id")
    out = nodes.join(by_set.withColumnRenamed("set_id", "_set"), (F.col("set_id") == F.col("_set")) & (F.col("n") > 0), "left")
    return out.select(
        "doc_id",
        "text_key",
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
        "root",
    )


def keep_first(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The document with the smallest doc_id of each component, all columns
    kept; texts without words stay. Equal rows are one document: they stay or
    go together."""
    rows = near_duplicates(docs, words, percent).where(F.col("root").isNotNull())
    rows = written(rows.select("root", "doc_id", "text_key").distinct(), "components")
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("f"))
    first = first.select("root", F.col("f.doc_id").alias("_id"), F.col("f.text_key").alias("_key"))
    others = (
        rows.join(first, "root")
        .where(~(F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))))
    )
    return Aside(docs).without(others)
