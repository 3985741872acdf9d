"""Near duplicates by SimHash fingerprints, found with Golay-code fuzzy hashing.

Two 64-bit fingerprints that differ in at most three bits have a 32-bit half with at most one differing bit
(pigeonhole), and among the four bytes of the other half one that is equal. A half is cut into a 23-bit
segment and a 9-bit tail. The perfect (23,12) Golay code decodes a segment, and the segment with any one bit
flipped, to one to six nearby codewords; segments that differ in one bit share a codeword. So a pair shares
one of these keys: (half, codeword, tail, byte place, byte) if the differing bit lies in the segment, or
(half, segment, byte place, byte) if it lies in the tail. Fingerprints that share a key are joined and
verified by counting bits; links give components by star contraction.

Documents with equal fingerprints are collapsed before keys are made. A bucket emits a spanning forest of its
links, not all its pairs, so no link between different fingerprints is lost for the components. Beyond
PAIRWISE fingerprints a bucket is searched by flipping bits instead, with work in proportion to its size.

Null and empty texts have no word: fingerprint zero, linked like any other. Texts of any length are read whole, one at a
time. A bit that half of the hashes have, a tie, is 0. Repeated rows each give a row, of one component. A
null id is never the smallest unless it is alone. An empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import body, staged
from tessera.llm.graph import components

SHINGLE_WORDS, SEED, RADIUS = 3, 42, 3
#: Buckets up to this size are compared pair by pair.
PAIRWISE = 20_000
#: Generator polynomial of the binary Golay code (fixed value): x^11+x^10+x^6+x^5+x^4+x^2+1.
GOLAY = 0xC75


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS) -> bytes:
    """Eight bytes, most significant first: a bit is set if over half of the shingle hashes have it."""
    words = text.lower().split()
    if not words:
        return bytes(8)
    k = min(shingle_words, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - k + 1
    digest, seed = xxhash.xxh64_digest, SEED
    hashes = np.frombuffer(b"".join([digest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[k - 1 :].tolist(), strict=True)]), np.uint8).reshape(n, 8)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n).tobytes()


def _remainder(v: np.ndarray) -> np.ndarray:
    """v modulo the generator polynomial: the syndrome of 23-bit words."""
    v = v.copy()
    for bit in range(22, 10, -1):
        v ^= np.where((v >> bit) & 1, GOLAY << (bit - 11), 0)
    return v


@lru_cache(maxsize=1)
def nearby_offsets() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: what to flip in a segment to get each of its nearby codewords, and how many there are."""
    errors = np.array([sum(1 << b for b in bits) for w in range(4) for bits in combinations(range(23), w)], np.int64)
    leader = np.zeros(2048, np.int64)
    leader[_remainder(errors)] = errors  # perfect code: each syndrome has exactly one error of weight three or less
    flips = np.concatenate([[0], 1 << np.arange(23, dtype=np.int64)])
    tried = np.sort(leader[np.arange(2048)[:, None] ^ _remainder(flips)[None, :]] ^ flips, axis=1)
    fresh = np.concatenate([np.ones((2048, 1), bool), tried[:, 1:] != tried[:, :-1]], axis=1)
    n = fresh.sum(axis=1)
    table = np.full((2048, n.max()), -1, np.int64)
    for s in range(2048):
        table[s, : n[s]] = tried[s, fresh[s]]
    return table, n


def fuzzy_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the fingerprint, key) for every key of every fingerprint."""
    table, _ = nearby_offsets()
    where, keys = [], []
    for half in (0, 1):
        near = ((fp >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        far = ((fp >> np.uint64(32 * (1 - half))) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        segment, tail = near >> 9, near & 511
        offsets = table[_remainder(segment)]
        codes = ((segment[:, None] ^ offsets) >> 11) << 9 | tail[:, None]
        real = offsets >= 0
        for place in range(4):
            byte = (far >> (8 * place)) & 255
            head = (half << 3 | place) << 32 | byte << 24
            i, j = np.nonzero(real)
            where += [i, np.arange(len(fp))]
            keys += [head[i] | codes[i, j], head | 1 << 34 | segment]
    return np.concatenate(where), np.concatenate(keys)


def _forest(fp: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Index pairs that connect what links of at most radius bits connect among distinct fingerprints."""
    n = len(fp)
    if n == 2:
        return [(0, 1)] if int(fp[0] ^ fp[1]).bit_count() <= radius else []
    parent = list(range(n))
    out: list[tuple[int, int]] = []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def tie(a: int, b: int) -> None:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((a, b))

    if n <= PAIRWISE:
        step = max(1, (1 << 22) // n)
        for lo in range(0, n, step):
            close = np.bitwise_count(fp[lo : lo + step, None] ^ fp[None, :]) <= radius
            i, j = np.nonzero(close)
            up = j > i + lo
            for a, b in zip((i[up] + lo).tolist(), j[up].tolist(), strict=True):
                if parent[a] != parent[b]:
                    tie(a, b)
    else:
        order = np.argsort(fp)
        there = fp[order]
        for w in range(1, radius + 1):
            for bits in combinations(range(64), w):
                want = fp ^ np.uint64(sum(1 << b for b in bits))
                at = np.minimum(np.searchsorted(there, want), n - 1)
                hit = np.nonzero(there[at] == want)[0]
                for a, b in zip(hit.tolist(), order[at[hit]].tolist(), strict=True):
                    tie(a, b)
    return out


def _fingerprints(stream: Iterator[pa.RecordBatch], shingle_words: int = SHINGLE_WORDS) -> Iterator[pa.RecordBatch]:
    for batch in stream:
        prints = b"".join(fingerprint(x.as_py(), shingle_words) for x in batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.frombuffer(prints, ">u8").astype(np.uint64).view(np.int64)), batch.column(2)], names=["doc_id", "fp", "mark"])


def _keyed(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in stream:
        fp = batch.column(0).to_numpy()
        where, keys = fuzzy_keys(fp.view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[where])], names=["key", "fp"])


def _links(stream: Iterator[pa.RecordBatch], radius: int = RADIUS) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; the last key of a batch may go on in the next."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def of(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        cuts = np.concatenate([[0], np.nonzero(key[1:] != key[:-1])[0] + 1, [len(key)]])
        sizes = np.diff(cuts)
        a, b = [], []
        pairs = cuts[:-1][sizes == 2]  # the usual bucket
        near = pairs[np.bitwise_count((fp[pairs] ^ fp[pairs + 1]).view(np.uint64)) <= radius]
        a.append(fp[near])
        b.append(fp[near + 1])
        for i in np.nonzero(sizes > 2)[0].tolist():
            lo, hi = cuts[i], cuts[i + 1]
            found = _forest(fp[lo:hi].view(np.uint64), radius)
            if found:
                ij = np.array(found) + lo
                a.append(fp[ij[:, 0]])
                b.append(fp[ij[:, 1]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    for batch in stream:
        if not batch.num_rows:
            continue
        key, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        last = int(np.searchsorted(key, key[-1]))
        if held and held[0][0][0] != key[0]:
            yield of(*(np.concatenate(c) for c in zip(*held, strict=True)))
            held = []
        if not last:  # one key all through: its parts are put together once, when it ends
            held.append((key, fp))
            continue
        yield of(*(np.concatenate([*c, x[:last]]) for c, x in zip(zip(*held, strict=True) if held else ((), ()), (key, fp), strict=True)))
        held = [(key[last:], fp[last:])]
    if held:
        yield of(*(np.concatenate(c) for c in zip(*held, strict=True)))


def near_duplicates(docs: DataFrame, text: str = "text", shingle_words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest id that links reach), component (a fingerprint that names
    the component), mark (xxhash64 of the bytes, which tells texts with one id apart). Fingerprints are of shingles of
    shingle_words words; a link is at most radius bits, 3 at most: the keys find no pair beyond."""
    if shingle_words < 1 or not 0 <= radius <= 3:
        raise ValueError(f"shingles of {shingle_words} words, links of {radius} bits: one word or more, 0 to 3 bits")
    prints = staged(docs.select("doc_id", body(text).alias("body"), F.xxhash64(body(text)).alias("mark")).mapInArrow(partial(_fingerprints, shingle_words=shingle_words), "doc_id long, fp long, mark long"), "simhash")
    classes = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    keyed = classes.select("fp").mapInArrow(_keyed, "key long, fp long")
    links = keyed.repartition("key").sortWithinPartitions("key").mapInArrow(partial(_links, radius=radius), "a long, b long")
    # Fingerprints are the nodes, so two texts with one id are tied by their words only.
    rooted = classes.join(components(links), classes["fp"] == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    found = staged(rooted.join(least, "root").select("fp", "root", "component_id"), "simhash-components")
    shown = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    return prints.join(found, "fp", "left").select("doc_id", shown("fp").alias("fingerprint"), "component_id", shown("root").alias("component"), "mark")
