"""Repeated word windows, removed after their first occurrence: a count-min prefilter, then exact grouping.

Documents stand in blocks. Pass one: each block makes a count-min sketch of its windows, kept sparse (two
rows, the slots it touched, whether twice), and sends it to the shards of the slot space, where the sketches
of all blocks are merged by adding. Merged counts never underestimate, so a window whose smaller count
is one is unique; a block gets back one bit for each slot it sent. Pass two: only windows estimated to
repeat are grouped, by 128 bits: two independent 64-bit hashes of their words, each word hashed without linear
structure. Words are not moved to be compared: among n distinct windows two different ones meet with a probability
of about n^2 / 2^129. The owner is the first occurrence (smallest id, then smallest place), and blocks hear which of
their windows they own first. A wrong estimate costs a row in pass two, never a window. Nothing is broadcast; sketch
shards grow in number with the input, not in size, and a block sends each distinct window once, however often it has it.

Null texts have no words. A document with fewer words than a window keeps them all. Texts of any length are read
whole; one that is longer than a block makes a block of its own size. Rows of one id are ordered by their bytes;
the same id and text twice count as two documents. A null id comes before all others. An empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import TOLD, answers_of, block_count, exchange, in_blocks, settled, sha256_hex
from tessera.llm.vectors import R1, R2, U, mix, window_hashes, word_hashes

WINDOW = 20
#: Slots of a sketch row in one shard, and windows that a shard gets on average.
ROW_SLOTS, SHARD_WINDOWS = 1 << 22, 1 << 21
#: Text bytes in a block.
CMS_BLOCK_BYTES = 12 << 20
#: A window's worth of text, for the number of shards.
WINDOW_BYTES = 6
ROWS = 2
#: Where a slot's head block costs less than writing slots out.
FEW_SLOTS = 128
NO_ID = -(1 << 63)


class Windows:
    """The windows of a block: hashes, document and place, with documents in the order of their ids."""

    def __init__(self, docs: pa.Table, window: int) -> None:
        ids = docs.column("doc_id").to_pylist()
        bodies = docs.column("body")
        rank = lambda i: NO_ID if ids[i] is None else ids[i]
        twice = {x for x, n in Counter(ids).items() if n > 1}
        self.order = sorted(range(len(ids)), key=lambda i: (rank(i), bodies[i].as_py() if ids[i] in twice else b""))
        self.ids = np.array([rank(i) for i in self.order], np.int64)
        self.n_words, first, second = [], [], []
        for i in self.order:
            one, two = word_hashes(bodies[i].as_py())
            self.n_words.append(len(one))
            first.append(window_hashes(one, window, R1))
            second.append(window_hashes(two, window, R2))
        self.counts = np.array([len(x) for x in first], np.int64)
        self.first = np.concatenate([*first, np.zeros(0, U)])
        self.second = np.concatenate([*second, np.zeros(0, U)])
        self.doc = np.repeat(np.arange(len(first)), self.counts)


def _slots(h: np.ndarray, row: int) -> np.ndarray:
    """Slot in a row: 22 bits of the hash, other ones for each row."""
    return (h >> U(20 * row) & U(ROW_SLOTS - 1)).astype(np.int64)


def _by_shard(h: np.ndarray, n_shards: int) -> np.ndarray:
    return (mix(h + U(R2)) % U(n_shards)).astype(np.int64)


def _pack_row(slots: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Slots touched, sorted, then bits for 'more than once'. Few slots are written as they are; many by how many
    each 2^16 block has and their low 16 bits, so that a small message has no large head."""
    touched, n = np.unique(slots, return_counts=True)
    if len(touched) < FEW_SLOTS:
        slots_ = touched.astype("<u4").tobytes()
    else:
        slots_ = np.bincount(touched >> 16, minlength=ROW_SLOTS >> 16).astype("<u4").tobytes() + (touched & 0xFFFF).astype("<u2").tobytes()
    return np.array([len(touched)], "<u4").tobytes() + slots_ + np.packbits(n > 1).tobytes(), touched


def _unpack_row(data: bytes, at: int) -> tuple[np.ndarray, np.ndarray, int]:
    n = int(np.frombuffer(data, "<u4", 1, at)[0])
    at += 4
    if n < FEW_SLOTS:
        touched = np.frombuffer(data, "<u4", n, at).astype(np.int64)
        at += 4 * n
    else:
        head = np.frombuffer(data, "<u4", ROW_SLOTS >> 16, at)
        at += 4 * len(head)
        touched = np.repeat(np.arange(len(head)) << 16, head) | np.frombuffer(data, "<u2", n, at)
        at += 2 * n
    size = -(-n // 8)
    return touched, np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=n), at + size


def _shards_of(w: Windows, n_shards: int) -> list[tuple[int, np.ndarray]]:
    """For every shard, the places of its windows."""
    shard = _by_shard(w.first, n_shards)
    order = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(n_shards + 1))
    return [(s, order[cuts[s] : cuts[s + 1]]) for s in range(n_shards) if cuts[s] < cuts[s + 1]]


def _answers(block: list[int], shard: list[int], payload: list[bytes]) -> pa.Table:
    return pa.table({"block": pa.array(block, pa.int32()), "shard": pa.array(shard, pa.int32()), "payload": pa.array(payload, pa.binary())})


def merge_sketches(asked: pa.Table) -> pa.Table:
    """Adds the sketches of a shard (saturating at two) and tells each block which of its slots are at two."""
    shard, blocks = asked.column("shard")[0].as_py(), asked.column("block").to_pylist()
    sums = [np.zeros(ROW_SLOTS, np.uint8) for _ in range(ROWS)]
    for x in asked.column("payload"):
        data, at = x.as_py(), 0
        for row in range(ROWS):
            touched, more, at = _unpack_row(data, at)
            sums[row][touched] = np.minimum(sums[row][touched] + 1 + more, 2)
    replies = []
    for x in asked.column("payload"):
        data, at, bits = x.as_py(), 0, []
        for row in range(ROWS):
            touched, _, at = _unpack_row(data, at)
            bits.append(np.packbits(sums[row][touched] == 2).tobytes())
        replies.append(b"".join(bits))
    return _answers(blocks, [shard] * len(blocks), replies)


def merge_rows(payloads: list[bytes]) -> bytes:
    """The sketch of all the blocks' windows."""
    at, out = [0] * len(payloads), []
    for _ in range(ROWS):
        parts = []
        for i, data in enumerate(payloads):
            touched, more, at[i] = _unpack_row(data, at[i])
            parts.append(np.repeat(touched, 1 + more))
        out.append(_pack_row(np.concatenate(parts))[0])
    return b"".join(out)


def narrow_rows(payloads: list[bytes], reply: bytes) -> list[bytes]:
    """Each block's bits of what was said of the merged sketch."""
    at, begin, out = [0] * len(payloads), 0, [b""] * len(payloads)
    for _ in range(ROWS):
        own = []
        for i, data in enumerate(payloads):
            touched, _, at[i] = _unpack_row(data, at[i])
            own.append(touched)
        union = np.unique(np.concatenate(own))
        size = -(-len(union) // 8)
        bits = np.unpackbits(np.frombuffer(reply, np.uint8, size, begin), count=len(union))
        begin += size
        for i, touched in enumerate(own):
            out[i] += np.packbits(bits[np.searchsorted(union, touched)]).tobytes()
    return out


def estimated_repeated(w: Windows, n_shards: int, replies: dict[int, bytes]) -> np.ndarray:
    """For every window, whether both of its slots were seen more than once."""
    out = np.zeros(len(w.first), bool)
    for shard, at in _shards_of(w, n_shards):
        h, data, begin, both = w.first[at], replies[shard], 0, np.ones(len(at), bool)
        for row in range(ROWS):
            touched, back = np.unique(_slots(h, row), return_inverse=True)
            size = -(-len(touched) // 8)
            both &= np.unpackbits(np.frombuffer(data, np.uint8, size, begin), count=len(touched)).astype(bool)[back]
            begin += size
        out[at] = both
    return out


def _candidates(w: Windows, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of windows estimated to repeat, sorted by hashes and then by place; where a new one begins)."""
    at = np.nonzero(repeated)[0]
    at = at[np.lexsort((at, w.second[at], w.first[at]))]
    new = np.ones(len(at), bool)
    new[1:] = (w.first[at][1:] != w.first[at][:-1]) | (w.second[at][1:] != w.second[at][:-1])
    return at, new


def _pack_candidates(h: np.ndarray, h2: np.ndarray, ids: np.ndarray) -> bytes:
    base = int(ids.min())
    wide = int(ids.max()) - base >= 1 << 32
    tail = ids.astype("<i8") if wide else (ids - base).astype("<u4")
    return np.array([len(h), base], "<i8").tobytes() + bytes([wide]) + h.astype("<u8").tobytes() + h2.astype("<u8").tobytes() + tail.tobytes()


def _unpack_candidates(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, base = np.frombuffer(data, "<i8", 2).tolist()
    wide = data[16] == 1
    ids = np.frombuffer(data, "<i8" if wide else "<u4", n, 17 + 16 * n).astype(np.int64) + (0 if wide else base)
    return np.frombuffer(data, "<u8", n, 17), np.frombuffer(data, "<u8", n, 17 + 8 * n), ids


def _first_of_each(payloads: list[bytes]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, ids; their order by hashes, id and block; where a new window begins in it; cuts between blocks)."""
    parts = [_unpack_candidates(x) for x in payloads]
    h, h2, ids = (np.concatenate([p[i] for p in parts]) for i in range(3))
    sizes = [len(p[0]) for p in parts]
    order = np.lexsort((np.repeat(np.arange(len(parts)), sizes), ids, h2, h))
    new = np.ones(len(order), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (h2[order][1:] != h2[order][:-1])
    return [h, h2, ids], order, new, np.concatenate([[0], np.cumsum(sizes)])


def merge_candidates(payloads: list[bytes]) -> bytes:
    """Each window once, with its earliest document."""
    columns, order, new, _ = _first_of_each(payloads)
    return _pack_candidates(*(c[order[new]] for c in columns))


def narrow_candidates(payloads: list[bytes], reply: bytes) -> list[bytes]:
    """A block's window comes later if another block of the batch has it earlier, or another batch does."""
    _, order, new, cuts = _first_of_each(payloads)
    later = np.empty(len(order), bool)
    later[order] = ~new | np.unpackbits(np.frombuffer(reply, np.uint8), count=int(new.sum())).astype(bool)[np.cumsum(new) - 1]
    return [np.packbits(later[cuts[i] : cuts[i + 1]]).tobytes() for i in range(len(payloads))]


def _group_exactly(asked: pa.Table) -> pa.Table:
    """For each block's distinct windows: whether another block has the same one in an earlier document."""
    shard, blocks = asked.column("shard")[0].as_py(), asked.column("block").to_pylist()
    parts = [_unpack_candidates(x.as_py()) for x in asked.column("payload")]
    sizes = [len(p[0]) for p in parts]
    h, h2, ids = (np.concatenate([p[i] for p in parts]) for i in range(3))
    source = np.repeat(np.array(blocks), sizes)  # not the order of arrival: a task that runs again must answer alike
    order = np.lexsort((source, ids, h2, h))
    later = np.zeros(len(h), bool)
    same = (h[order][1:] == h[order][:-1]) & (h2[order][1:] == h2[order][:-1])
    later[order[1:][same]] = True
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    return _answers(blocks, [shard] * len(blocks), [np.packbits(later[cuts[i] : cuts[i + 1]]).tobytes() for i in range(len(parts))])


def remove_repeats(docs: DataFrame, text: str = "text", window: int = WINDOW, block_bytes: int | None = None) -> DataFrame:
    """Larger blocks mean fewer messages (blocks x shards) and more memory in a task. doc_id, n_words, n_removed, kept_sha256, kept (the words that stay, joined by one space)."""
    docs = settled(docs, text)
    n_blocks = block_count(docs, text, block_bytes or CMS_BLOCK_BYTES)
    sized = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    n_shards = max(1, -(-sized // (WINDOW_BYTES * SHARD_WINDOWS)))
    blocks = in_blocks(docs, n_blocks, text)

    def sketch(table: pa.Table) -> pa.Table:
        w, block = Windows(table, window), table.column("block")[0].as_py()
        shards, payloads = [], []
        for shard, at in _shards_of(w, n_shards):
            shards.append(shard)
            payloads.append(b"".join(_pack_row(_slots(w.first[at], row))[0] for row in range(ROWS)))
        return pa.table({"shard": pa.array(shards, pa.int32()), "block": pa.array([block] * len(shards), pa.int32()), "payload": pa.array(payloads, pa.binary())})

    def survivors(table: pa.Table, replies: pa.Table) -> pa.Table:
        shards, payloads = [], []
        if table.num_rows and replies.num_rows:
            w = Windows(table, window)
            at, new = _candidates(w, estimated_repeated(w, n_shards, answers_of(replies)))
            at = at[new]
            owner = _by_shard(w.first[at], n_shards)
            for s in range(n_shards):
                own = at[owner == s]
                if len(own):
                    ids = w.ids[w.doc[own]]
                    shards.append(s)
                    payloads.append(_pack_candidates(w.first[own], w.second[own], ids))
        block = table.column("block")[0].as_py() if table.num_rows else 0
        return pa.table({"shard": pa.array(shards, pa.int32()), "block": pa.array([block] * len(shards), pa.int32()), "payload": pa.array(payloads, pa.binary())})

    def finish(table: pa.Table, replies: pa.Table) -> pa.Table:
        rows: dict[str, list] = {"doc_id": [], "n_words": [], "n_removed": [], "kept_sha256": [], "kept": []}
        if table.num_rows:
            w = Windows(table, window)
            passes = replies.column("step").to_pylist()
            one, two = (replies.filter(pa.array([p == k for p in passes], pa.bool_())) for k in (1, 2))
            gone = np.zeros(len(w.first), bool)
            if one.num_rows:
                at, new = _candidates(w, estimated_repeated(w, n_shards, answers_of(one)))
                gone[at] = ~new  # in this block another occurrence comes first
                heads, told = at[new], answers_of(two)
                owner = _by_shard(w.first[heads], n_shards)
                for s in range(n_shards):
                    own = heads[owner == s]
                    if len(own):
                        gone[own] = np.unpackbits(np.frombuffer(told[s], np.uint8), count=len(own)).astype(bool)
            bodies, ids = table.column("body"), table.column("doc_id").to_pylist()
            begin = np.concatenate([[0], np.cumsum(w.counts)])
            for k, i in enumerate(w.order):
                words = bodies[i].as_py().split()
                cover = np.zeros(len(words) + 1, np.int64)
                starts = np.nonzero(gone[begin[k] : begin[k + 1]])[0]
                cover[starts] += 1
                np.subtract.at(cover, np.minimum(starts + window, len(words)), 1)
                covered = np.cumsum(cover[:-1]) > 0
                kept = b" ".join([x for x, c in zip(words, covered.tolist(), strict=True) if not c]) if len(starts) else b" ".join(words)
                rows["doc_id"].append(ids[i])
                rows["n_words"].append(len(words))
                rows["n_removed"].append(int(covered.sum()))
                rows["kept_sha256"].append(sha256_hex(kept))
                rows["kept"].append(kept.decode(errors="replace"))
        return pa.table({"doc_id": pa.array(rows["doc_id"], pa.int64()), "n_words": pa.array(rows["n_words"], pa.int64()), "n_removed": pa.array(rows["n_removed"], pa.int64()), "kept_sha256": pa.array(rows["kept_sha256"], pa.string()), "kept": pa.array(rows["kept"], pa.string())})

    by_block = blocks.groupBy("block")
    first = exchange(by_block.applyInArrow, sketch, lambda asked: asked.groupBy("shard").applyInArrow(merge_sketches, TOLD), merge_rows, narrow_rows, n_shards)
    second = exchange(by_block.cogroup(first.groupBy("block")).applyInArrow, survivors, lambda asked: asked.groupBy("shard").applyInArrow(_group_exactly, TOLD), merge_candidates, narrow_candidates, n_shards)
    both = first.withColumn("step", F.lit(1)).unionByName(second.withColumn("step", F.lit(2)))
    return by_block.cogroup(both.groupBy("block")).applyInArrow(finish, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
