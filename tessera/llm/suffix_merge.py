"""Repeated byte strings by a common-prefix-aware distributed merge sort of suffixes.

A string of LENGTH bytes is repeated if it starts at two places. Each start p has an anchor: the place of the
least hash of eight bytes among the SPAN places from p on (leftmost if equal). It depends on the string
alone, so equal strings have their anchors at the same distance, and it is enough to sort the suffixes at
anchors; starts that share an anchor are one stretch.

1. Blocks of documents send shards two digests of every anchor: of the bytes that all strings of its stretch
   have from the anchor on, and of all bytes the stretch needs. An anchor whose first digest is unique has no
   repeated string. If every anchor with this first digest has the same second one, all their strings repeat.
   These need no bytes to be moved: equality rests on 128-bit digests there, as it rests on bytes in the steps below.
2. For the rest (the borders of repeated passages, and one representative for each second digest) blocks sort
   the suffixes at the anchors and send them as runs, front-coded: the length of the prefix known from the
   suffix before, then what is new. A shard merges the runs of all blocks with a loser tree that compares
   lengths of known common prefixes first and characters only behind them, so no known prefix is compared again.
3. In the merged order, the common prefixes of suffixes and the common endings of what stands before their
   anchors give the repeated starts of each stretch; blocks turn them into removed bytes.

Matches never cross documents. Null texts are empty; texts shorter than LENGTH keep everything. Repeated rows
are documents of their own, so a text that stands twice is removed whole from LENGTH bytes on; there are no ties. Texts of
any length are read whole; one that is longer than a block makes a block of its own size. A null id gives a row. An empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import TOLD, answers_of, block_count, exchange, in_blocks, settled, sha256_hex
from tessera.llm.vectors import U, mix

LENGTH, SPAN, GRAM = 400, 256, 8
#: Text bytes for each shard.
SHARD_BYTES = 32 << 20
#: Text bytes in a block; several numbers for each of its bytes are in memory at once.
SUFFIX_BLOCK_BYTES = 8 << 20
PIECE = 1 << 19
PLACE = U((1 << 20) - 1)
UNIQUE, REPEATED, SENT_TOO, SENT = 0, 1, 2, 3


def anchor_of_starts(data: np.ndarray, span: int = SPAN) -> np.ndarray:
    """For every start, the place of its anchor; starts whose span runs out of the data have none."""
    n = len(data) - GRAM + 1 - span + 1
    out = np.zeros(max(0, n), np.int64)
    for lo in range(0, n, PIECE):
        part = data[lo : min(len(data), lo + PIECE + span - 1 + GRAM - 1)].astype(U)
        two = part[:-1] | part[1:] << U(8)
        four = two[:-2] | two[2:] << U(16)
        gram = mix(four[:-4] | four[4:] << U(32))
        m = len(gram) - span + 1
        key = np.full(-(-len(gram) // span) * span, ~U(0))
        key[: len(gram)] = (gram & ~PLACE) | np.arange(len(gram), dtype=U)
        rows = key.reshape(-1, span)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        out[lo : lo + m] = (np.minimum(back[:m], ahead[span - 1 : span - 1 + m]) & PLACE).astype(np.int64) + lo
    return out


class Stretches:
    """The stretches of a block: first start, last start and anchor of each, and both digests."""

    def __init__(self, docs: pa.Table, length: int, span: int) -> None:
        self.length, self.known = length, length - span + 1
        bodies = [x.as_py() for x in docs.column("body")]
        self.text = b"".join(bodies)
        self.ends = np.cumsum(np.fromiter(map(len, bodies), np.int64, len(bodies)))
        self.begins = np.concatenate([[0], self.ends[:-1]])
        data = np.frombuffer(self.text, np.uint8)
        anchor = anchor_of_starts(data, span)
        valid = np.zeros(len(data) + 1, np.int32)
        long = self.ends - self.begins >= length
        valid[self.begins[long]] += 1
        np.subtract.at(valid, self.ends[long] - length + 1, 1)
        starts = np.nonzero(np.cumsum(valid[: len(anchor)]) > 0)[0]
        anchor = anchor[starts]
        new = np.ones(len(starts), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
        at = np.nonzero(new)[0]
        self.lo, self.anchor = starts[at], anchor[at]
        self.hi = starts[np.concatenate([at[1:], [len(starts)]]) - 1] if len(at) else starts[:0]
        view, h, x = memoryview(self.text), xxhash.xxh3_64_intdigest, xxhash.xxh3_128_digest
        k = self.known
        self.first = np.fromiter((h(view[a : a + k]) for a in self.anchor.tolist()), U, len(at))
        whole = b"".join([x(view[lo : hi + length], a - lo) for lo, hi, a in zip(self.lo.tolist(), self.hi.tolist(), self.anchor.tolist(), strict=True)])
        self.whole = np.frombuffer(whole, "<u8").reshape(-1, 2)

    def kinds(self, n_shards: int) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """By shard: (shard, a stretch of each kind, kind of each stretch, stretches in it), kinds in order of their digests."""
        shard = (mix(self.first) % U(n_shards)).astype(np.int64)
        order = np.lexsort((self.whole[:, 1], self.whole[:, 0], self.first, shard))
        out = []
        cuts = np.searchsorted(shard[order], np.arange(n_shards + 1))
        for s in range(n_shards):
            own = order[cuts[s] : cuts[s + 1]]
            if len(own):
                new = np.ones(len(own), bool)
                new[1:] = (self.first[own][1:] != self.first[own][:-1]) | (self.whole[own][1:] != self.whole[own][:-1]).any(axis=1)
                out.append((s, own[new], np.cumsum(new) - 1, own))
        return out


def settle(asked: pa.Table) -> pa.Table:
    """For each kind that a block sent: UNIQUE, REPEATED, SENT_TOO (repeated, to be sent for others) or SENT."""
    shard, blocks = asked.column("shard")[0].as_py(), asked.column("block").to_pylist()
    parts = [np.frombuffer(x.as_py(), "<u8").reshape(4, -1) for x in asked.column("payload")]
    sizes = [p.shape[1] for p in parts]
    first, x0, x1, more = np.concatenate(parts, axis=1)
    source = np.repeat(np.array(blocks), sizes)  # not the order of arrival: a task that runs again must answer alike
    order = np.lexsort((source, x1, x0, first))
    f, a, b = first[order], x0[order], x1[order]
    new_first = np.concatenate([[True], f[1:] != f[:-1]])
    new_whole = new_first | np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    whole_id = np.cumsum(new_whole) - 1
    many = np.bincount(whole_id, 1 + more[order].astype(np.int64)) > 1
    alone = np.bincount(np.cumsum(new_first) - 1, new_whole)[np.cumsum(new_first) - 1] == 1
    repeated = many[whole_id]
    state = np.where(alone, np.where(repeated, REPEATED, UNIQUE), np.where(repeated, np.where(new_whole, SENT_TOO, REPEATED), SENT)).astype(np.uint8)
    back = np.empty(len(order), np.uint8)
    back[order] = state
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    return _told(blocks, shard, [back[cuts[i] : cuts[i + 1]].tobytes() for i in range(len(parts))])


def _same_kinds(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(all kinds, their order by digests and block, where a new one begins in it, cuts between blocks)."""
    parts = [np.frombuffer(x, "<u8").reshape(4, -1) for x in payloads]
    kinds, sizes = np.concatenate(parts, axis=1), [p.shape[1] for p in parts]
    order = np.lexsort((np.repeat(np.arange(len(parts)), sizes), kinds[2], kinds[1], kinds[0]))
    new = np.ones(len(order), bool)
    new[1:] = (kinds[:3, order[1:]] != kinds[:3, order[:-1]]).any(axis=0)
    return kinds, order, new, np.concatenate([[0], np.cumsum(sizes)])


def merge_kinds(payloads: list[bytes]) -> bytes:
    """Each kind once; more than one stretch if a block has more or several blocks have it."""
    kinds, order, new, _ = _same_kinds(payloads)
    out = kinds[:, order[new]].copy()
    which = np.cumsum(new) - 1
    out[3] = (np.bincount(which, 1 + kinds[3, order].astype(np.int64)) > 1).astype(np.uint64)
    return out.astype("<u8").tobytes()


def narrow_kinds(payloads: list[bytes], reply: bytes) -> list[bytes]:
    """What was said of a kind holds for each block; one of them sends what is to be sent for others."""
    _, order, new, cuts = _same_kinds(payloads)
    state = np.frombuffer(reply, np.uint8)[np.cumsum(new) - 1].copy()
    state[(state == SENT_TOO) & ~new] = REPEATED
    back = np.empty(len(order), np.uint8)
    back[order] = state
    return [back[cuts[i] : cuts[i + 1]].tobytes() for i in range(len(payloads))]


def join_runs(payloads: list[bytes]) -> bytes:
    """One run of several."""
    runs = [read_run(x) for x in payloads]
    return write_run([runs[r][i][:2] for r, i, _ in merge_runs(runs)])


def part_runs(payloads: list[bytes], reply: bytes) -> list[bytes]:
    """Distances found for entries of a joined run, for the runs it was made of."""
    order = merge_runs([read_run(x) for x in payloads])
    out: list[list[tuple[int, int, int]]] = [[] for _ in payloads]
    for at, a, b in np.frombuffer(reply, "<i4").reshape(-1, 3).tolist():
        run, place, _ = order[at]
        out[run].append((place, a, b))
    return [np.array(x, "<i4").tobytes() for x in out]


def _told(blocks: list[int], shard: int, payloads: list[bytes]) -> pa.Table:
    return pa.table({"block": pa.array(blocks, pa.int32()), "shard": pa.array([shard] * len(blocks), pa.int32()), "payload": pa.array(payloads, pa.binary())})


def _asked(block: int, shards: list[int], payloads: list[bytes]) -> pa.Table:
    return pa.table({"shard": pa.array(shards, pa.int32()), "block": pa.array([block] * len(shards), pa.int32()), "payload": pa.array(payloads, pa.binary())})


def common_prefix(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the common prefix, of which so many bytes are known already."""
    n = min(len(a), len(b))
    while at < n:
        step = min(n, at + 48)
        if a[at:step] == b[at:step]:
            at = step
            continue
        while a[at] == b[at]:
            at += 1
        return at
    return n


def write_run(suffixes: list[tuple[bytes, bytes]]) -> bytes:
    """A sorted run of (suffix from the anchor, what stands before it, backwards), front-coded."""
    tails, sizes, heads, before = [], [], [], []
    last = b""
    for suffix, left in suffixes:
        k = common_prefix(last, suffix)
        heads.append(k)
        sizes.append(len(suffix))
        tails.append(suffix[k:])
        before.append(left)
        last = suffix
    numbers = np.array([heads, sizes, [len(x) for x in before]], "<u2")
    return np.array([len(suffixes)], "<u4").tobytes() + numbers.tobytes() + b"".join(tails) + b"".join(before)


def read_run(data: bytes) -> list[tuple[bytes, bytes, int]]:
    """(suffix, what stands before, prefix known from the suffix before it) for every entry of a run."""
    n = int(np.frombuffer(data, "<u4", 1)[0])
    heads, sizes, lefts = np.frombuffer(data, "<u2", 3 * n, 4).reshape(3, n).astype(np.int64)
    at = 4 + 6 * n
    left_at = at + int((sizes - heads).sum())
    out, last = [], b""
    for k, size, m in zip(heads.tolist(), sizes.tolist(), lefts.tolist(), strict=True):
        last = last[:k] + data[at : at + size - k]
        at += size - k
        out.append((last, data[left_at : left_at + m], k))
        left_at += m
    return out


def merge_runs(runs: list[list[tuple[bytes, bytes, int]]]) -> list[tuple[int, int, int]]:
    """(run, place in it, common prefix with the entry before) in sorted order, by a loser tree.

    What plays in the tree is a run's next entry with the length of its common prefix with the last one that
    left the tree. The longer prefix wins; only when both are as long are characters compared, from there on,
    and the loser keeps the prefix it has in common with the winner."""
    k = 1 << max(0, (len(runs) - 1).bit_length())
    at = [0] * len(runs)
    heads: list[bytes] = [r[0][0] if r else b"" for r in runs] + [b""] * (k - len(runs))
    done = -1

    def play(s: int, h: int, t: int, g: int) -> tuple[int, int, int, int]:
        """Winner with its prefix, loser with its prefix."""
        if h > g:
            return s, h, t, g
        if h < g:
            return t, g, s, h
        if h == done:
            return s, h, t, g
        a, b = heads[s], heads[t]
        c = common_prefix(a, b, h)
        if c == len(a) or (c < len(b) and a[c] < b[c]):
            return s, h, t, c
        return t, g, s, c

    loser: list[tuple[int, int]] = [(0, done)] * k
    level = [(s, 0 if s < len(runs) and runs[s] else done) for s in range(k)]
    base = k
    while len(level) > 1:
        base //= 2
        up = []
        for i in range(0, len(level), 2):
            s, h, t, g = play(*level[i], *level[i + 1])
            loser[base + i // 2] = (t, g)
            up.append((s, h))
        level = up
    winner, prefix = level[0]
    out = []
    while prefix != done:
        out.append((winner, at[winner], prefix))
        at[winner] += 1
        run = runs[winner]
        if at[winner] < len(run):
            heads[winner], _, prefix = run[at[winner]]
        else:
            prefix = done
        node = (winner + k) // 2
        while node:
            t, g = loser[node]
            if prefix < g or prefix == g != done:
                winner, prefix, t, g = play(winner, prefix, t, g)
                loser[node] = (t, g)
            node //= 2
    return out


def _range_min(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least of values[lo:hi] for each pair lo < hi."""
    table = [values]
    while 1 << len(table) <= len(values):
        step = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-step], table[-1][step:]))
    level = np.frexp(hi - lo)[1] - 1
    out = np.empty(len(lo), values.dtype)
    for j in np.unique(level):
        at = level == j
        out[at] = np.minimum(table[j][lo[at]], table[j][hi[at] - (1 << j)])
    return out


def repeated_distances(prefixes: np.ndarray, lefts: list[bytes], length: int, span: int) -> list[list[tuple[int, int]]]:
    """For suffixes in sorted order with the common prefix of each with the one before: the distances (from,
    to) between start and anchor at which the string is repeated."""
    n = len(lefts)
    if n == 2:
        lo, hi = max(0, length - int(prefixes[1])), common_prefix(lefts[0], lefts[1])
        return [[(lo, hi)] if lo <= hi else [] for _ in (0, 1)]
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    order = sorted(range(n), key=lefts.__getitem__)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    ending = np.array([common_prefix(lefts[a], lefts[b]) for a, b in zip(order, order[1:], strict=False)], np.int64)
    capped = np.minimum(prefixes[1:], length)
    levels = np.unique(capped)[::-1]
    for i, v in enumerate(levels.tolist()):
        lo = length - v
        hi = length - int(levels[i + 1]) - 1 if i + 1 < len(levels) else span - 1
        group = np.concatenate([[0], np.cumsum(capped < v)])
        by = np.lexsort((rank, group))
        same = group[by][1:] == group[by][:-1]
        both = np.full(n - 1, -1, np.int64)
        if same.any():
            r = rank[by]
            both[same] = _range_min(ending, r[:-1][same], r[1:][same])
        best = np.maximum(np.concatenate([[-1], both]), np.concatenate([both, [-1]]))
        for j in np.nonzero(best >= lo)[0].tolist():
            out[by[j]].append((lo, min(hi, int(best[j]))))
    return out


def remove_repeated_strings(docs: DataFrame, text: str = "text", length: int = LENGTH, span: int = SPAN, block_bytes: int | None = None, shard_bytes: int | None = None) -> DataFrame:
    """Larger blocks and shards mean fewer messages (blocks x shards) and more memory in a task. doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes)."""
    docs = settled(docs, text)
    total = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    n_shards = max(1, -(-total // (shard_bytes or SHARD_BYTES)))
    blocks = in_blocks(docs, block_count(docs, text, block_bytes or SUFFIX_BLOCK_BYTES), text)
    known = length - span + 1

    def digests(table: pa.Table) -> pa.Table:
        s = Stretches(table, length, span)
        shards, payloads = [], []
        for shard, one, kind, _ in s.kinds(n_shards):
            more = (np.bincount(kind) > 1).astype("<u8")
            shards.append(shard)
            payloads.append(np.stack([s.first[one], s.whole[one, 0], s.whole[one, 1], more]).astype("<u8").tobytes())
        return _asked(table.column("block")[0].as_py(), shards, payloads)

    def runs_of(s: Stretches, told: dict[int, bytes]) -> list[tuple[int, list[int]]]:
        """By shard, the stretches to send, sorted by suffix."""
        out = []
        for shard, one, _, _ in s.kinds(n_shards):
            send = one[np.frombuffer(told[shard], np.uint8) >= SENT_TOO].tolist()
            if send:
                out.append((shard, sorted(send, key=lambda i: s.text[s.anchor[i] : s.hi[i] + length])))
        return out

    def send_runs(table: pa.Table, replies: pa.Table) -> pa.Table:
        shards, payloads = [], []
        if replies.num_rows:
            s = Stretches(table, length, span)
            for shard, send in runs_of(s, answers_of(replies)):
                shards.append(shard)
                payloads.append(write_run([(s.text[s.anchor[i] : s.hi[i] + length], s.text[s.lo[i] : s.anchor[i]][::-1]) for i in send]))
        return _asked(table.column("block")[0].as_py() if table.num_rows else 0, shards, payloads)

    def merge(asked: pa.Table) -> pa.Table:
        shard, blocks_ = asked.column("shard")[0].as_py(), asked.column("block").to_pylist()
        runs = [read_run(x.as_py()) for x in asked.column("payload")]
        merged = merge_runs(runs)
        found: list[list[tuple[int, int, int]]] = [[] for _ in runs]
        lo = 0
        for hi in range(1, len(merged) + 1):
            if hi == len(merged) or merged[hi][2] < known:
                if hi - lo > 1:
                    part = merged[lo:hi]
                    distances = repeated_distances(np.array([x[2] for x in part]), [runs[r][i][1] for r, i, _ in part], length, span)
                    for (r, i, _), ranges in zip(part, distances, strict=True):
                        found[r] += [(i, a, b) for a, b in ranges]
                lo = hi
        return _told(blocks_, shard, [np.array(x, "<i4").tobytes() for x in found])

    def finish(table: pa.Table, replies: pa.Table) -> pa.Table:
        rows: dict[str, list] = {"doc_id": [], "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
        if table.num_rows:
            s = Stretches(table, length, span)
            steps = np.array(replies.column("step").to_pylist(), np.int64)
            one, two = (answers_of(replies.filter(pa.array(steps == k))) for k in (1, 2))
            cover = np.zeros(len(s.text) + 1, np.int64)
            for shard, _, kind, own in s.kinds(n_shards):
                state = np.frombuffer(one[shard], np.uint8)[kind]
                gone = own[(state == REPEATED) | (state == SENT_TOO)]
                np.add.at(cover, s.lo[gone], 1)
                np.subtract.at(cover, s.hi[gone] + length, 1)
            for shard, send in runs_of(s, one) if one else []:
                found = np.frombuffer(two.get(shard, b""), "<i4").reshape(-1, 3).astype(np.int64)
                at = np.array(send, np.int64)[found[:, 0]]
                np.add.at(cover, s.anchor[at] - found[:, 2], 1)
                np.subtract.at(cover, s.anchor[at] - found[:, 1] + length, 1)
            covered = np.cumsum(cover[:-1]) > 0
            data = np.frombuffer(s.text, np.uint8)
            rows["doc_id"] = table.column("doc_id").to_pylist()
            for b, e in zip(s.begins.tolist(), s.ends.tolist(), strict=True):
                m = covered[b:e]
                n = int(np.count_nonzero(m))
                kept = data[b:e][~m].tobytes() if n else s.text[b:e]
                rows["n_bytes"].append(e - b)
                rows["n_removed"].append(n)
                rows["n_spans"].append(int(m[:1].sum()) + int(np.count_nonzero(m[1:] & ~m[:-1])) if n else 0)
                rows["kept_sha256"].append(sha256_hex(kept))
                rows["kept"].append(kept)
        kinds = {"kept_sha256": pa.string(), "kept": pa.binary()}
        return pa.table({k: pa.array(v, kinds.get(k, pa.int64())) for k, v in rows.items()})

    by_block = blocks.groupBy("block")
    first = exchange(by_block.applyInArrow, digests, lambda asked: asked.groupBy("shard").applyInArrow(settle, TOLD), merge_kinds, narrow_kinds, n_shards)
    second = exchange(by_block.cogroup(first.groupBy("block")).applyInArrow, send_runs, lambda asked: asked.groupBy("shard").applyInArrow(merge, TOLD), join_runs, part_runs, n_shards)
    both = first.withColumn("step", F.lit(1)).unionByName(second.withColumn("step", F.lit(2)))
    return by_block.cogroup(both.groupBy("block")).applyInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
