"""SimHash near-dedup against all pairs."""

import random
import re

import pytest
import xxhash

from tests.conftest import SF
from xtalframe.llm import simhash
from xtalframe.llm.common import ship, table
from xtalframe.llm.queries import queries


def plain_fingerprint(text, k):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, bits):
    """fps: doc_id -> fingerprint. Smallest doc_id reachable."""
    root = {d: d for d in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def test_whole_query(spark):
    docs = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    fps = {d: plain_fingerprint(t, 3) for d, t in docs.items()}
    want = plain_components(fps, 2)
    got = queries()["op11_simhash"](spark, SF).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {d: (f"{fps[d]:016x}", want[d]) for d in docs}
    assert len(got) == len(docs) and any(want[d] != d for d in docs)


def test_masks_let_no_pair_through():
    for blocks, bits in ((6, 2), (16, 2), (16, 3), (64, 1)):
        kept = simhash.masks(blocks, bits)
        for a in range(64):
            for b in range(a, 64, 7):
                assert any((m >> a & 1) == 0 and (m >> b & 1) == 0 for m in kept) or bits < 2


@pytest.mark.parametrize("bits", [1, 2, 3])
def test_clusters_of_close_fingerprints(spark, bits):
    """Clusters large enough to go through every level, and scattered pairs."""
    rng = random.Random(bits)
    fps = set()
    for size in (1, 2, 5, 60, 200):
        centre = rng.getrandbits(64)
        for _ in range(size):
            fps.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))))
    near = 1 << 63  # sign bit
    fps |= {near, near | 1, near | 7, 0, 3}
    want = {(a, b) for a in fps for b in fps if a != b and (a ^ b).bit_count() <= bits}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    got = simhash.close_pairs(df, bits, group=8).collect()
    pairs = {(r["low"] % (1 << 64), r["high"] % (1 << 64)) for r in got}
    assert pairs | {(b, a) for a, b in pairs} == want


def test_groups_of_the_last_level_are_bounded(spark):
    """All fingerprints within a byte of each other: no key holds more than its
    open bits allow, whatever the size of the cluster."""
    df = spark.range(4096).selectExpr("id as fp")
    assert simhash.close_pairs(df, 2, levels=(16,)).distinct().count() == 4096 * (12 + 66) // 2


def test_edges(spark):
    long = "w%d " * 1
    rows = [
        (1, "same words in this text"),
        (1, "same words in this text"),
        (2, "Same WORDS  in\tthis text"),
        (None, "same words in this text"),
        (3, None),
        (4, ""),
        (5, " \n"),
        (6, " ".join(long % k for k in range(100_000))),
        (None, "nobody else has these"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fp", "'x' as text_key", "2 as FP2")
    got = simhash.near_duplicates(docs, words=3, bits=0).collect()
    by = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["component_id"] or -1) for r in got)
    assert by == [(False, 1, 1), (False, 1, 1), (False, 2, 1), (False, 3, 3), (False, 4, 3), (False, 5, 3), (False, 6, 6), (True, 0, -1), (True, 0, 1)]
    assert {r["fingerprint"] for r in got if r["doc_id"] in (3, 4, 5)} == {"0" * 16}
    kept = simhash.keep_first(docs, words=3, bits=0)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "1", "3", "6", "None"]
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def test_half_is_no_majority():
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in ("a b c", "b c d")]
    assert simhash.fingerprint(b"a b c d", 3) == hashes[0] & hashes[1]
