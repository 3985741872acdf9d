"""Language-model scores by context-tree weighting over bytes.

A text is lower-cased (A-Z) and ended by a byte that UTF-8 never has; each byte is coded as eight binary
decisions, so a node is a context of up to DEPTH preceding bytes and the decisions made so far within the byte.
A node's Krichevsky-Trofimov estimate and the estimates of all deeper contexts are mixed with the weights
that the training counts give them (half the estimate's probability over the weighted probability of the
node). Where a text leaves the contexts that were seen, the deepest seen one stands for the rest.

Training counts byte strings of DEPTH + 1 in every task and adds them up by shards; a shard has all strings whose
last three context bytes are its own, and so whole subtrees; a context of two bytes is spread over up to SPREAD
shards, so that a frequent one isn't one task. Contexts of two bytes are put together from their shards' sums and given back
to them. The levels above, at most 2^16 + 2^8 nodes, are sent to every task. For scoring, documents stand in blocks;
a block asks the shards once for each of its distinct strings and words, and gets their code lengths and
counts back. So no model of the corpus is held in one place or sent to all.

Null texts are empty: their score is that of the end alone. Texts of any length are read whole; one that is longer than a
block makes a block of its own size. Nothing depends on an order, so there are no ties. Repeated rows each count, in
training too. A null id is in training. With no training rows every binary decision has probability one half.
An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import TOLD, answers_of, block_count, block_number, body, exchange, held_out, messages, settled, staged
from tessera.llm.vectors import U, mix

DEPTH = 5
END = 0xFF
#: Shards that the strings of one two-byte context are dealt to.
SPREAD = 32
#: Training text for each shard of the model.
SHARD_BYTES = 32 << 20
#: Text bytes in a block; several arrays of a block's size are in memory at once.
CTW_BLOCK_BYTES = 12 << 20
#: Distinct strings and words a task holds before it sends what it has counted.
FLUSH_STRINGS, FLUSH_WORDS = 1 << 21, 300_000
CHUNK = 1 << 20
#: Places whose strings are sorted at a time; larger parts leave less to merge.
SORTED = 1 << 22
STRINGS, WORDS = 0, 1
#: Stands for the end among the words; no UTF-8 text has it.
END_WORD = bytes([END])
COUNTED = "kind int, shard int, payload binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


# --- packing of keys and words -------------------------------------------------------------------------------


def _planes(x: np.ndarray) -> bytes:
    """Bytes of integers, plane by plane: small differences leave planes of zeros."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _unplanes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").ravel().astype(U)


def pack_keys(keys: np.ndarray, counts: np.ndarray | None = None) -> bytes:
    """Sorted keys as differences, and counts; compressed."""
    steps = np.diff(keys, prepend=U(0))
    return zlib.compress(np.array([len(keys)], "<u8").tobytes() + _planes(steps) + (b"" if counts is None else _planes(counts)), 1)


def unpack_keys(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(data)
    n = int(np.frombuffer(raw, "<u8", 1)[0])
    keys = np.cumsum(_unplanes(raw[8 : 8 + 8 * n]), dtype=U)
    rest = raw[8 + 8 * n :]
    return keys, (_unplanes(rest).astype(np.int64) if rest else np.zeros(0, np.int64))


def pack_words(words: list[bytes], counts: list[int] | None = None) -> bytes:
    text = b" ".join(words)
    return zlib.compress(np.array([len(text)], "<u8").tobytes() + text + (b"" if counts is None else _planes(np.array(counts, np.int64))), 1)


def unpack_words(data: bytes) -> tuple[list[bytes], np.ndarray]:
    raw = zlib.decompress(data)
    n = int(np.frombuffer(raw, "<u8", 1)[0])
    rest = raw[8 + n :]
    return raw[8 : 8 + n].split(), (_unplanes(rest).astype(np.int64) if rest else np.zeros(0, np.int64))


# --- byte strings --------------------------------------------------------------------------------------------


def laid_out(bodies: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts with their ends and with empty contexts before them; where each begins and stops."""
    gap = bytes([END]) * depth
    sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
    begins = depth + np.concatenate([[0], np.cumsum(sizes + depth)[:-1]]) if len(bodies) else np.zeros(0, np.int64)
    return np.frombuffer(gap + gap.join(bodies) + gap, np.uint8), begins, begins + sizes + 1


def keys_at(data: np.ndarray, lo: int, hi: int, depth: int) -> np.ndarray:
    """For places lo..hi: the bytes before, the nearest first, and the byte itself, as one number."""
    key = np.zeros(hi - lo, U)
    for k in range(1, depth + 1):
        key = key << U(8) | data[lo - k : hi - k]
    return key << U(8) | data[lo:hi]


def coded_places(n: int, begins: np.ndarray, stops: np.ndarray) -> np.ndarray:
    edge = np.zeros(n + 1, np.int8)
    edge[begins] += 1
    edge[stops] -= 1
    return np.cumsum(edge[:-1], dtype=np.int8) > 0


def distinct_keys(data: np.ndarray, begins: np.ndarray, stops: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct strings that end at coded places, sorted, and how often each occurs."""
    coded = coded_places(len(data), begins, stops)
    keys, counts = np.zeros(0, U), np.zeros(0, np.int64)
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    for lo in range(depth, len(data), SORTED):
        hi = min(len(data), lo + SORTED)
        parts.append(np.unique(keys_at(data, lo, hi, depth)[coded[lo:hi]], return_counts=True))
        if len(parts) == 4:
            parts = [added(parts)]
    return added(parts) if parts else (keys, counts)


def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of counts by key."""
    keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order].astype(np.int64)
    if not len(keys):
        return keys, counts
    at = np.concatenate([[0], np.nonzero(keys[1:] != keys[:-1])[0] + 1])
    return keys[at], np.add.reduceat(counts, at)


def _first_shard(two: np.ndarray, n_shards: int) -> np.ndarray:
    """Where the strings of a two-byte context begin."""
    return (mix(two.astype(U)) % U(n_shards)).astype(np.int64)


def shard_of_keys(keys: np.ndarray, n_shards: int, depth: int) -> np.ndarray:
    """By the three bytes before the coded one: a two-byte context has up to SPREAD shards beside one another."""
    third = mix(keys >> U(8 * (depth - 2)) & U(255)) % U(min(n_shards, SPREAD))
    return (_first_shard(keys >> U(8 * (depth - 1)), n_shards) + third.astype(np.int64)) % n_shards


def _split_keys(keys: np.ndarray, n_shards: int, depth: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, places of its keys, still in order)."""
    shard = shard_of_keys(keys, n_shards, depth)
    order = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(n_shards + 1))
    for s in range(n_shards):
        if cuts[s] < cuts[s + 1]:
            yield s, order[cuts[s] : cuts[s + 1]]


def _split_words(words: list[bytes], n_shards: int) -> Iterator[tuple[int, list[bytes]]]:
    lists: dict[int, list[bytes]] = {}
    for w in words:
        lists.setdefault(zlib.crc32(w) % n_shards, []).append(w)
    yield from sorted(lists.items())


class KeyTable:
    """Values by key, looked up for many keys at a time (open addressing). No key is all ones."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(8, int(2 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, ~U(0), U)
        self.values = np.zeros(1 << self.bits)
        at = self._home(keys)
        while len(keys):
            free = self.keys[at] == ~U(0)
            self.keys[at[free]] = keys[free]  # of several for one slot the last stays
            won = self.keys[at] == keys
            self.values[at[won]] = values[won]
            keys, values, at = keys[~won], values[~won], (at[~won] + 1) & ((1 << self.bits) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys * U(0x9E3779B97F4A7C15) >> U(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """All keys must be there."""
        at = self._home(keys)
        wrong = np.nonzero(self.keys[at] != keys)[0]
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & ((1 << self.bits) - 1)
            wrong = wrong[self.keys[at[wrong]] != keys[wrong]]
        return self.values[at]


# --- the tree ------------------------------------------------------------------------------------------------


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Natural logarithm of the gamma function for x >= 1/2, by Stirling's series above 10."""
    x = x.astype(np.float64)
    shift = np.zeros_like(x)
    for _ in range(10):
        low = x < 10
        shift[low] += np.log(x[low])
        x = np.where(low, x + 1, x)
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - shift


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log probability that the KT estimator gives to a zeros and b ones."""
    return _log_gamma(a + 0.5) + _log_gamma(b + 0.5) - _log_gamma(a + b + 1.0) - math.log(math.pi)


class Level:
    """Nodes of one context length and one place in the byte: keys (context, decisions so far), counts, log
    weighted probability, weight of the own estimate."""

    def __init__(self, keys: np.ndarray, bits: np.ndarray, counts: np.ndarray) -> None:
        at = np.concatenate([[0], np.nonzero(keys[1:] != keys[:-1])[0] + 1]) if len(keys) else np.zeros(0, np.int64)
        self.keys = keys[at]
        self.zeros = np.add.reduceat(np.where(bits == 0, counts, 0), at) if len(at) else counts[:0]
        self.ones = np.add.reduceat(np.where(bits == 1, counts, 0), at) if len(at) else counts[:0]
        self.estimate = log_kt(self.zeros, self.ones)
        self.log_pw, self.weight = self.estimate, np.ones(len(at))

    def below(self, child: Level) -> None:
        """Mixes the own estimate with the product of the children's weighted probabilities."""
        up = (child.keys >> U(16)) << U(8) | (child.keys & U(255))
        inner = np.bincount(np.searchsorted(self.keys, up), child.log_pw, len(self.keys))
        self.log_pw = math.log(0.5) + np.logaddexp(self.estimate, inner)
        self.weight = np.exp(math.log(0.5) + self.estimate - self.log_pw)


def levels(keys: np.ndarray, counts: np.ndarray, depth: int, top: int) -> list[list[Level]]:
    """Levels of the context lengths depth, depth - 1, .. top, each with the eight places in a byte."""
    out: list[list[Level]] = []
    for d in range(depth, top - 1, -1):
        if d < depth:
            keys, counts = added([((keys >> U(16)) << U(8) | (keys & U(255)), counts)])
        context, symbol = keys >> U(8), (keys & U(255)).astype(np.int64)
        row = []
        for place in range(8):
            node = context << U(8) | ((1 << place) | (symbol >> (8 - place))).astype(U)
            level = Level(node, (symbol >> (7 - place)) & 1, counts)
            if out:
                level.below(out[-1][place])
            row.append(level)
        out.append(row)
    return out


class Top:
    """The root and the contexts of one byte: counts and weights by (context byte, decisions so far)."""

    def __init__(self, zeros: np.ndarray, ones: np.ndarray, inner: np.ndarray) -> None:
        self.zeros1, self.ones1 = zeros, ones
        estimate = log_kt(zeros, ones)
        log_pw = math.log(0.5) + np.logaddexp(estimate, inner)
        self.weight1 = np.exp(math.log(0.5) + estimate - log_pw)
        self.zeros0, self.ones0 = zeros.sum(axis=0), ones.sum(axis=0)
        estimate0 = log_kt(self.zeros0, self.ones0)
        seen = zeros + ones > 0
        log_pw0 = math.log(0.5) + np.logaddexp(estimate0, np.where(seen, log_pw, 0).sum(axis=0))
        self.weight0 = np.exp(math.log(0.5) + estimate0 - log_pw0)


class Second:
    """The contexts of two bytes that a shard may be asked for: keys (context, decisions so far), counts and weights."""

    def __init__(self, contexts: list[int], payloads: list[bytes]) -> None:
        order = sorted(range(len(contexts)), key=contexts.__getitem__)
        parts = [unpack_nodes(payloads[i]) for i in order]
        prefix = [(np.uint64(contexts[i]) << U(8)) | p[0].astype(U) for i, p in zip(order, parts, strict=True)]
        self.keys = np.concatenate([*prefix, np.zeros(0, U)])
        self.zeros, self.ones, self.weight = (np.concatenate([*(p[1][k] for p in parts), np.zeros(0)]) for k in range(3))


def pack_nodes(values: np.ndarray) -> bytes:
    """Three rows of values by decisions so far; those that were made."""
    seen = np.nonzero(values[:2].sum(axis=0))[0]
    return zlib.compress(seen.astype(np.uint8).tobytes() + values[:, seen].astype("<f8").tobytes(), 1)


def unpack_nodes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(data)
    n = len(raw) // 25
    return np.frombuffer(raw, np.uint8, n), np.frombuffer(raw, "<f8", 3 * n, n).reshape(3, n)


def dense_nodes(payloads: list[bytes]) -> np.ndarray:
    """Sum of packed nodes, in an order that does not depend on arrival."""
    table = np.zeros((3, 256))
    for x in sorted(payloads):
        at, values = unpack_nodes(x)
        table[:, at] += values
    return table


def code_lengths(asked: np.ndarray, tree: list[list[Level]], second: Second, top: Top, depth: int) -> np.ndarray:
    """log10 of the probability of each asked string's last byte after the others."""
    total = np.zeros(len(asked))
    symbol = (asked & U(255)).astype(np.int64)
    nearest = (asked >> U(8 * depth)).astype(np.int64)
    for place in range(8):
        bit, prefix = (symbol >> (7 - place)) & 1, (1 << place) | (symbol >> (8 - place))
        p, known = np.full(len(asked), 0.5), np.zeros(len(asked), bool)

        def mixed(there: np.ndarray, zeros: np.ndarray, ones: np.ndarray, weight: np.ndarray) -> None:
            own = (np.where(bit, ones, zeros) + 0.5) / (zeros + ones + 1.0)  # noqa: B023
            value = np.where(known, weight * own + (1 - weight) * p, own)  # noqa: B023
            p[there] = value[there]  # noqa: B023
            known[there] = True  # noqa: B023

        for i, row in enumerate(tree):
            level = row[place]
            if not len(level.keys):
                continue
            d = depth - i
            node = (asked >> U(8 * (depth - d + 1))) << U(8) | prefix.astype(U)
            at = np.minimum(np.searchsorted(level.keys, node), len(level.keys) - 1)
            mixed(level.keys[at] == node, level.zeros[at], level.ones[at], level.weight[at])
        if len(second.keys):
            node = (asked >> U(8 * (depth - 1))) << U(8) | prefix.astype(U)
            at = np.minimum(np.searchsorted(second.keys, node), len(second.keys) - 1)
            mixed(second.keys[at] == node, second.zeros[at], second.ones[at], second.weight[at])
        zeros, ones = top.zeros1[nearest, prefix], top.ones1[nearest, prefix]
        mixed(zeros + ones > 0, zeros, ones, top.weight1[nearest, prefix])
        zeros, ones = top.zeros0[prefix], top.ones0[prefix]
        mixed(zeros + ones > 0, zeros, ones, top.weight0[prefix])
        total += np.log10(p)
    return total


# --- the job -------------------------------------------------------------------------------------------------


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    kind, shard, payload = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(shard, pa.int32()), pa.array(payload, pa.binary())], names=["kind", "shard", "payload"])


def _reply(request: bytes, values: bytes) -> bytes:
    """What was asked, and the answer: the block needn't sort its strings once more."""
    return len(request).to_bytes(8, "little") + request + values


def _parts(reply: bytes) -> tuple[bytes, bytes]:
    n = int.from_bytes(reply[:8], "little") + 8
    return reply[8:n], reply[n:]


def merge_requests(requests: list[bytes]) -> bytes:
    """Strings or words of several blocks, each once."""
    if requests[0][0] == STRINGS:
        return bytes([STRINGS]) + pack_keys(np.unique(np.concatenate([unpack_keys(x[1:])[0] for x in requests])))
    return bytes([WORDS]) + pack_words(sorted(set().union(*(unpack_words(x[1:])[0] for x in requests))))


def narrow_replies(requests: list[bytes], reply: bytes) -> list[bytes]:
    """Each block's part of what was told of all."""
    asked, told = _parts(reply)
    if asked[0] == STRINGS:
        keys, values = unpack_keys(asked[1:])[0], np.frombuffer(told, "<f8")
        return [_reply(x, values[np.searchsorted(keys, unpack_keys(x[1:])[0])].tobytes()) for x in requests]
    counts = dict(zip(unpack_words(asked[1:])[0], _unplanes(zlib.decompress(told)).astype(np.int64).tolist(), strict=True))
    return [_reply(x, zlib.compress(_planes(np.array([counts[w] for w in unpack_words(x[1:])[0]], np.int64)), 1)) for x in requests]


def count_training(train: DataFrame, n_shards: int, depth: int) -> DataFrame:
    """(kind, shard, payload): what each task has counted, split by shard."""

    def count(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        words: Counter[bytes] = Counter()

        def strings_out() -> pa.RecordBatch:
            keys, counts = added(parts)
            parts.clear()
            return _rows([(STRINGS, s, pack_keys(keys[at], counts[at])) for s, at in _split_keys(keys, n_shards, depth)])

        def words_out() -> pa.RecordBatch:
            out = [(WORDS, s, pack_words(own, [words[w] for w in own])) for s, own in _split_words(sorted(words), n_shards)]
            words.clear()
            return _rows(out)

        for batch in stream:
            texts = [x.as_py().lower() for x in batch.column(0)]
            parts.append(distinct_keys(*laid_out(texts, depth), depth))
            if len(parts) == 8:
                parts[:] = [added(parts)]
            if sum(len(k) for k, _ in parts) > FLUSH_STRINGS:
                yield strings_out()
            for x in texts:
                words.update(x.split())
                if len(words) > FLUSH_WORDS:
                    yield words_out()
            words[END_WORD] += len(texts)
        if parts:
            yield strings_out()
        if words:
            yield words_out()

    return train.select("body").mapInArrow(count, COUNTED)


def add_up(counted: DataFrame) -> DataFrame:
    """One row for each kind and shard: all its strings or words with their counts; distinct and total for words."""

    def add(rows: pa.Table) -> pa.Table:
        kind, shard = rows.column("kind")[0].as_py(), rows.column("shard")[0].as_py()
        if kind == STRINGS:
            keys, counts = added([unpack_keys(x.as_py()) for x in rows.column("payload")])
            payload, distinct, total = pack_keys(keys, counts), 0, 0
        else:
            sums: Counter[bytes] = Counter()
            for x in rows.column("payload"):
                words, counts = unpack_words(x.as_py())
                for w, c in zip(words, counts.tolist(), strict=True):
                    sums[w] += c
            words = sorted(sums)
            payload, distinct, total = pack_words(words, [sums[w] for w in words]), len(words), sum(sums.values())
        return pa.table({"kind": pa.array([kind], pa.int32()), "shard": pa.array([shard], pa.int32()), "payload": pa.array([payload], pa.binary()), "distinct": pa.array([distinct], pa.int64()), "total": pa.array([total], pa.int64())})

    return counted.groupBy("kind", "shard").applyInArrow(add, "kind int, shard int, payload binary, distinct long, total long")


def second_level(model: DataFrame, depth: int) -> DataFrame:
    """(two, nodes, up): every context of two bytes, put together from the shards that have a part of it, with its counts
    and weights, and with its counts and log weighted probabilities for the level above."""

    def parts(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for x in batch.column(0):
                row = levels(*unpack_keys(x.as_py()), depth, 3)[-1]
                node = np.concatenate([(level.keys >> U(16)) << U(8) | level.keys & U(255) for level in row]).astype(np.int64)
                values = np.stack([np.concatenate([getattr(level, k) for level in row]).astype(np.float64) for k in ("zeros", "ones", "log_pw")])
                order = np.argsort(node >> 8, kind="stable")
                node, values = node[order], values[:, order]
                cuts = np.concatenate([[0], np.nonzero(np.diff(node >> 8))[0] + 1, [len(node)]]) if len(node) else np.zeros(1, np.int64)
                two, payloads = [], []
                for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    two.append(int(node[lo]) >> 8)
                    payloads.append(pack_nodes(np.stack([np.bincount(node[lo:hi] & 255, v[lo:hi], 256) for v in values])))
                yield pa.RecordBatch.from_arrays([pa.array(two, pa.int32()), pa.array(payloads, pa.binary())], names=["two", "part"])

    def join(rows: pa.Table) -> pa.Table:
        zeros, ones, inner = dense_nodes(rows.column("part").to_pylist())
        estimate = log_kt(zeros, ones)
        log_pw = math.log(0.5) + np.logaddexp(estimate, inner)
        weight = np.exp(math.log(0.5) + estimate - log_pw)
        nodes, up = pack_nodes(np.stack([zeros, ones, weight])), pack_nodes(np.stack([zeros, ones, log_pw]))
        return pa.table({"two": rows.column("two").slice(0, 1), "nodes": pa.array([nodes], pa.binary()), "up": pa.array([up], pa.binary())})

    strings = model.filter(F.col("kind") == STRINGS).select("payload")
    return strings.mapInArrow(parts, "two int, part binary").groupBy("two").applyInArrow(join, "two int, nodes binary, up binary")


def top_levels(second: DataFrame) -> Top:
    """Sums over the contexts of two bytes, by the nearest byte and decisions so far; 2^16 nodes."""

    def join(rows: pa.Table) -> pa.Table:
        return pa.table({"c": rows.column("c").slice(0, 1), "sums": pa.array([dense_nodes(rows.column("up").to_pylist()).tobytes()], pa.binary())})

    table = np.zeros((3, 256, 256))
    by_byte = second.select(F.shiftright("two", 8).alias("c"), "up").groupBy("c")  # 256 rows of at most 6 KB in a group
    for r in by_byte.applyInArrow(join, "c int, sums binary").collect():  # 256 rows at most
        table[:, r.c] = np.frombuffer(r.sums).reshape(3, 256)
    return Top(*table)


def to_shards(second: DataFrame, n_shards: int) -> DataFrame:
    """(kind, shard, two, payload): the nodes of a two-byte context for each shard that may be asked for it, SPREAD at most."""

    def deal(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            two, n = batch.column(0).to_numpy(), min(n_shards, SPREAD)
            shard = (_first_shard(two, n_shards)[:, None] + np.arange(n)) % n_shards
            rows = pa.array(np.repeat(np.arange(len(two)), n))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), STRINGS, np.int32)), pa.array(shard.ravel().astype(np.int32)), batch.column(0).take(rows), batch.column(1).take(rows)], names=["kind", "shard", "two", "payload"])

    return second.select("two", "nodes").mapInArrow(deal, "kind int, shard int, two int, payload binary")


def score(docs: DataFrame, text: str = "text", depth: int = DEPTH, block_bytes: int | None = None, shard_bytes: int | None = None) -> DataFrame:
    """Larger blocks and shards mean fewer messages (blocks x shards) and more memory in a task. doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probability of the text)."""
    if not 3 <= depth <= 7:
        raise ValueError("depth must be from 3 to 7")
    docs = settled(docs, text)
    total = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    n_shards = max(1, -(-total // (shard_bytes or SHARD_BYTES)))
    n_blocks = block_count(docs, text, block_bytes or CTW_BLOCK_BYTES)
    rows = docs.select("doc_id", body(text).alias("body"), held_out(5, 1).alias("held_out"))
    model = staged(add_up(count_training(rows.filter(~F.col("held_out")), n_shards, depth)), "ctw-model")
    sums = model.agg(F.sum("distinct"), F.sum("total")).first()
    distinct, train_tokens = sums[0] or 0, sums[1] or 0
    second = staged(second_level(model, depth), "ctw-second")
    top = top_levels(second)
    known_by_shard = model.select("kind", "shard", F.lit(-1).alias("two"), "payload").unionByName(to_shards(second, n_shards))
    blocks = docs.select("doc_id", body(text).alias("body"), held_out(5, 1).alias("held_out"), block_number(n_blocks, text).alias("block"))

    def words_of(texts: list[bytes]) -> list[bytes]:
        return sorted(set().union(*(x.split() for x in texts)))

    def ask(table: pa.Table) -> pa.Table:
        texts = [x.as_py().lower() for x in table.column("body")]
        keys, _ = distinct_keys(*laid_out(texts, depth), depth)
        out = [(2 * s + STRINGS, bytes([STRINGS]) + pack_keys(keys[at])) for s, at in _split_keys(keys, n_shards, depth)]
        out += [(2 * s + WORDS, bytes([WORDS]) + pack_words(own)) for s, own in _split_words([*words_of(texts), END_WORD], n_shards)]
        shards, payloads = zip(*out, strict=True)
        return messages(["shard", "block", "payload"], list(shards), [table.column("block")[0].as_py()] * len(out), list(payloads))

    def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
        payloads = []
        if asked.num_rows:
            requests = [x.as_py() for x in asked.column("payload")]
            if requests[0][0] == STRINGS:
                own = dict(zip(known.column("two").to_pylist(), (x.as_py() for x in known.column("payload")), strict=True))
                mine = own.pop(-1, None)
                tree = levels(*(unpack_keys(mine) if mine else (np.zeros(0, U), np.zeros(0, np.int64))), depth, 3)
                second_ = Second(list(own), list(own.values()))
                wanted = [unpack_keys(x[1:])[0] for x in requests]
                union = np.unique(np.concatenate(wanted))
                values = code_lengths(union, tree, second_, top, depth).astype("<f8")
                payloads = [_reply(x, values[np.searchsorted(union, k)].tobytes()) for x, k in zip(requests, wanted, strict=True)]
            else:
                words, counts = unpack_words(known.column("payload")[0].as_py()) if known.num_rows else ([], np.zeros(0, np.int64))
                have = dict(zip(words, counts.tolist(), strict=True))
                payloads = [_reply(x, zlib.compress(_planes(np.array([have.get(w, 0) for w in unpack_words(x[1:])[0]], np.int64)), 1)) for x in requests]
        return messages(["block", "shard", "payload"], asked.column("block").to_pylist(), asked.column("shard").to_pylist(), payloads)

    def finish(table: pa.Table, replies: pa.Table) -> pa.Table:
        n = table.num_rows
        ids, out = table.column("doc_id"), table.column("held_out")
        tokens, known, base, scores = [], [], [], np.zeros(n)
        if n:
            texts = [x.as_py().lower() for x in table.column("body")]
            counts: dict[bytes, int] = {}
            keys, values = [], []
            for payload in answers_of(replies).values():
                asked, told = _parts(payload)
                if asked[0] == STRINGS:
                    keys.append(unpack_keys(asked[1:])[0])
                    values.append(np.frombuffer(told, "<f8"))
                else:
                    counts.update(zip(unpack_words(asked[1:])[0], _unplanes(zlib.decompress(told)).astype(np.int64).tolist(), strict=True))
            look = KeyTable(np.concatenate(keys), np.concatenate(values))
            del keys, values
            below = train_tokens + 0.5 * (distinct + 1)
            for x in texts:
                c = np.fromiter(map(counts.__getitem__, [*x.split(), END_WORD]), np.float64)
                tokens.append(len(c))
                known.append(int(np.count_nonzero(c)))
                base.append(float(np.log10((c + 0.5) / below).sum()))
            data, begins, stops = laid_out(texts, depth)
            coded = coded_places(len(data), begins, stops)
            number = np.repeat(np.arange(n, dtype=np.int32), stops - begins)  # of the document, for every coded place
            seen = 0
            for lo in range(depth, len(data), CHUNK):
                hi = min(len(data), lo + CHUNK)
                at = np.nonzero(coded[lo:hi])[0]
                scores += np.bincount(number[seen : seen + len(at)], look(keys_at(data, lo, hi, depth)[at]), n)
                seen += len(at)
        return pa.table({"doc_id": ids, "held_out": out, "n_tokens": pa.array(tokens, pa.int64()), "n_known": pa.array(known, pa.int64()), "train_tokens": pa.array([train_tokens] * n, pa.int64()), "base_score": pa.array(base, pa.float64()), "score": pa.array(scores, pa.float64())})

    by_block = blocks.groupBy("block")
    known = known_by_shard.select((F.col("shard") * 2 + F.col("kind")).alias("key"), "two", "payload")
    replies = exchange(by_block.applyInArrow, ask, lambda asked: asked.groupBy("shard").cogroup(known.groupBy("key")).applyInArrow(answer, TOLD), merge_requests, narrow_replies, 2 * n_shards)
    return by_block.cogroup(replies.groupBy("block")).applyInArrow(finish, SCORES)
