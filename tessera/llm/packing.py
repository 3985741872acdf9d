"""Best-fit packing of token sequences by length patterns and non-negative least squares.

Texts are tokenised once; only lengths are counted. On the histogram of lengths (at most as many entries as a
sequence has tokens, whatever the input) the plan is made: patterns of a few documents, over bins of
lengths, that fill a sequence; non-negative least squares fits how often each pattern repeats so that the
patterns use up the histogram; counts are rounded down. A pattern's repeats are laid out with exact lengths: all
members but the last come from their bins, the last one is the longest document left that still fits. What
patterns leave over goes by best fit, longest first, into the gaps that are open or into new
sequences. The plan is a table of runs (length, ranks from .. to, first sequence, offset), which every task
looks up for its pieces; ranks within a length are counted per bucket and carried over.

Null and empty texts are the end token alone. Texts of any length are read whole, one at a time; a document longer than
a sequence is cut into full pieces and a last, shorter one. Pieces of equal length are alike to the plan and ranked by id
and piece, so ties don't matter. Repeated rows are packed each. A null id is packed like any other. An empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import body, staged

CAPACITY, END_ID = 4096, 1
VOCABULARY = "word_bpe_49k.json"
#: Bins of the patterns, and documents in a pattern at most.
PATTERN_BINS, PATTERN_DOCS = 64, 4
#: Stems whose ids a worker remembers, of so many bytes at most; beyond that it forgets all but the half that it met last.
CACHE_STEMS, CACHE_LENGTH = 250_000, 64
#: Text bytes that are split into words at a time.
PART_BYTES = 2 << 20
BUCKET_ROWS = 1 << 13
#: Letters and digits of ASCII.
SOLID = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", np.uint8))


def cells(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of an array of large strings or binaries."""
    _, offsets, data = a.buffers()
    return np.frombuffer(offsets, np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64), np.frombuffer(data or b"", np.uint8)


def from_cells(kind: pa.DataType, sizes: np.ndarray, data: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return pa.Array.from_buffers(kind, len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes. The vocabulary's words never span white
    space, so a text's ids are those of its words in turn. It folds case, and marks behind a letter or digit are words of
    their own, so a word's ids are those of its folded stem and of the marks at its end. Distinct words, their stems and
    the stems' ids are Arrow arrays; stems are encoded once as long as they are remembered.

    Folding comes after composition: h with a line below is one letter, H with it is two. So only words of Latin-1 are folded
    here, which compose with nothing. Fresh stems of small letters go through the model alone, many at a time; the ids that end a
    word tell where a stem's ids end. Others are encoded many at a time with a mark between them, whose id does; stems that
    could be mistaken for it are encoded alone, as they are."""

    BETWEEN = "\x01"
    #: Everything printable that is no letter or digit, but for the apostrophe, which may begin a word ('s).
    MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mark = self._ids(self.tokenizer, self.BETWEEN)
        with open(path) as f:
            made = json.load(f)
        vocabulary = made["model"]["vocab"]
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        # Words of small letters need no normalising and no splitting: the same model behind a cut at each space.
        made.update(normalizer=None, pre_tokenizer={"type": "CharDelimiterSplit", "delimiter": " "}, post_processor=None, added_tokens=[])
        self.bare = Tokenizer.from_str(json.dumps(made))
        shown = byte_letters()
        self.shown = np.array([32 if i == 32 else ord(shown[i]) for i in range(256)], "<u4")
        self.stems, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())
        self.met, self.turn = np.zeros(0, np.int64), 0

    @staticmethod
    def _ids(tokenizer, text: str) -> np.ndarray:  # noqa: ANN001
        return np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _together(self, words: list[bytes], bare: bool) -> tuple[np.ndarray, np.ndarray] | None:
        """Numbers of ids and ids of words that are encoded at once; none if they can't be told apart."""
        if bare:
            ids = self._ids(self.bare, self.shown[np.frombuffer(b" ".join(words), np.uint8)].tobytes().decode("utf-32-le"))
            cuts = np.nonzero(self.ends[ids])[0] + 1
            return (np.diff(cuts, prepend=0), ids) if len(cuts) == len(words) and cuts[-1] == len(ids) else None
        ids = self._ids(self.tokenizer, f" {self.BETWEEN} ".join(w.decode() for w in words))
        if len(self.mark) != 1:
            return None
        between = ids == self.mark[0]
        cuts = np.nonzero(between)[0]
        return (np.diff(cuts, prepend=-1, append=len(ids)) - 1, ids[~between]) if len(cuts) == len(words) - 1 else None

    def learn(self, stems: pa.Array) -> pa.Array:
        """Ids by stem."""
        at, data = cells(stems)
        sizes = np.diff(at)
        lead = data == 0xC3
        small = np.isin(data, np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8))
        second = np.concatenate([[False], lead[:-1]]) & (data >= 0x9F) & (data != 0xB7) if len(data) else lead
        fine = np.concatenate([[0], np.cumsum(small | second | np.concatenate([second[1:], [False]])[: len(data)])])
        latin = (fine[at[1:]] - fine[at[:-1]] == sizes) & (sizes > 0)
        bare, plain, odd = np.nonzero(latin)[0].tolist(), [], []
        words = stems.cast(pa.large_binary()).to_pylist()
        for i in np.nonzero(~latin)[0].tolist():
            x = words[i].decode()
            if x.isalpha() and x.islower() and unicodedata.is_normalized("NFC", x):
                bare.append(i)
            elif not x or "\x01" in x or "<|" in x:
                odd.append(i)
            else:
                plain.append(i)
        rows, counts, ids = [], [], []
        for kind, some in ((True, bare), (False, plain)):
            for k in range(0, len(some), 2000):
                part = some[k : k + 2000]
                if (made := self._together([words[i] for i in part], kind)) is None:
                    odd += part
                    continue
                rows += part
                counts.append(made[0])
                ids.append(made[1])
        for i in odd:
            made = self._ids(self.tokenizer, words[i].decode())
            rows.append(i)
            counts.append(np.array([len(made)]))
            ids.append(made)
        if not rows:
            return pa.array([], pa.large_binary())
        found = from_cells(pa.large_binary(), 4 * np.concatenate(counts), np.concatenate(ids).astype("<u4").view(np.uint8))
        return found.take(pa.array(np.argsort(rows)))

    def _known(self, stems: pa.Array) -> pa.Array:
        """Ids of distinct stems. Those that were met last stay, long ones never."""
        self.turn += 1
        at = pc.index_in(stems, value_set=self.stems)
        missing = at.is_null().to_numpy(zero_copy_only=False)
        at = at.fill_null(0).to_numpy().astype(np.int64)
        self.met[at[~missing]] = self.turn
        fresh = stems.filter(pa.array(missing))
        at[missing] = np.arange(len(self.stems), len(self.stems) + len(fresh))
        self.stems, self.ids = pa.concat_arrays([self.stems, fresh]), pa.concat_arrays([self.ids, self.learn(fresh)])
        self.met = np.concatenate([self.met, np.full(len(fresh), self.turn)])
        found = self.ids.take(pa.array(at))
        keep = np.diff(cells(self.stems)[0]) <= CACHE_LENGTH
        if keep.sum() > CACHE_STEMS:
            last = np.argsort(np.where(keep, -self.met, 1), kind="stable")
            keep[last[CACHE_STEMS // 2 :]] = False
        if not keep.all():
            self.stems, self.ids, self.met = self.stems.filter(pa.array(keep)), self.ids.filter(pa.array(keep)), self.met[keep]
        return found

    def _words(self, words: pa.Array) -> pa.Array:
        """Ids of distinct words."""
        odd = pc.or_(pc.match_substring(words, "<|"), pc.match_substring(words, self.BETWEEN)).to_numpy(zero_copy_only=False)
        at, data = cells(words)
        sizes = np.diff(at)
        # Capitals of Latin-1, in words of nothing else than ASCII and its letters.
        lead = np.concatenate([[False], data[:-1] == 0xC3])[: len(data)]
        other = np.concatenate([[0], np.cumsum((data > 0x7F) & (data != 0xC3) & ~lead)])
        folds = np.repeat((other[at[1:]] == other[at[:-1]]) & ~odd, sizes)
        capital = (data >= 0x41) & (data <= 0x5A) | lead & (data <= 0x9E) & (data != 0x97)
        data = data + (0x20 * (capital & folds)).astype(np.uint8)
        folded = from_cells(pa.large_string(), sizes, data)
        stems = pc.ascii_rtrim(folded, characters=self.MARKS)
        left = np.diff(cells(stems)[0])
        # Marks are words of their own only behind a letter or digit; else they go with what is before them.
        cut = (left < sizes) & (left > 0) & ~odd
        end = (at[:-1] + left - 1)[cut]
        cut[cut] = SOLID[data[end]] | lead[end] & (data[end] != 0x97) & (data[end] != 0xB7)
        tail = np.where(cut, sizes - left, 0)
        ends = np.cumsum(tail)
        tails = from_cells(pa.large_string(), tail, data[np.repeat(at[1:] - ends, tail) + np.arange(tail.sum())])
        parts = pa.concat_arrays([pc.if_else(pa.array(cut), stems, folded), tails]).dictionary_encode()
        ids = self._known(parts.dictionary)
        n = len(words)
        return pc.binary_join_element_wise(ids.take(parts.indices[:n]), ids.take(parts.indices[n:]), pa.scalar(b"", pa.large_binary()))

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).cast(pa.large_string()))
        met = split.values.dictionary_encode()
        ids = self._words(met.dictionary).take(met.indices) if len(met) else pa.array([], pa.large_binary())
        at, data = cells(ids)
        ends = at[split.offsets.to_numpy()].tolist()
        return [data[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)]


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the vocabulary: printable bytes for themselves, the others in turn from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker process, which serves many tasks."""
    return Encoder(path)


def in_parts(texts: list[bytes], size: int) -> Iterator[list[bytes]]:
    """Neighbouring texts of about so many bytes together."""
    part: list[bytes] = []
    held = 0
    for x in texts:
        part.append(x)
        held += len(x)
        if held >= size:
            yield part
            part, held = [], 0
    if part:
        yield part


def pieces(docs: DataFrame, text: str = "text", capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every document cut to the capacity."""
    path = path or public_tokenizers.path(VOCABULARY)
    end = np.array([END_ID], "<u4").tobytes()

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in stream:
            row, piece, start, length, crc = [], [], [], [], []
            texts = [x.as_py() for x in batch.column(1)]
            for i, ids in enumerate(ids for part in in_parts(texts, PART_BYTES) for ids in encode(part)):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    row.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )
            pa.default_memory_pool().release_unused()  # a worker lives on through other stages

    return docs.select("doc_id", body(text).alias("body")).mapInArrow(batches, "doc_id long, piece int, start long, length long, ids_crc32 long")


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """x >= 0 with the least |a x - b|, by the active-set method: columns enter while they lower the error."""
    n = a.shape[1]
    x, inside = np.zeros(n), np.zeros(n, bool)
    slack = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(rounds):
        pull = a.T @ (b - a @ x)
        pull[inside] = -np.inf
        if inside.all() or pull.max() <= slack:
            break
        inside[int(pull.argmax())] = True
        while True:
            at = np.nonzero(inside)[0]
            best = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (best > 0).all():
                x[:] = 0
                x[at] = best
                break
            low = best <= 0
            step = float(np.min(x[at][low] / np.maximum(x[at][low] - best[low], 1e-300)))
            x[at] += step * (best - x[at])
            inside[at[(x[at] <= 1e-12) & low]] = False
            x[~inside] = 0
    return x


def patterns(bins: int = PATTERN_BINS, docs: int = PATTERN_DOCS) -> list[tuple[int, ...]]:
    """Every choice of two to docs bins (from 1, with repeats, largest last) that add up to all bins."""
    out = []
    for n in range(2, docs + 1):
        for head in combinations_with_replacement(range(1, bins // 2 + 1), n - 1):
            last = bins - sum(head)
            if last >= head[-1]:
                out.append((*head, last))
    return out


class Plan:
    """Sequences as groups of equal make-up: (lengths, how many), kept by the gap that is left."""

    def __init__(self, histogram: np.ndarray, capacity: int) -> None:
        self.left, self.capacity = histogram.astype(np.int64).copy(), capacity
        self.open: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def put(self, lengths: tuple[int, ...], n: int) -> None:
        if n:
            self.open.setdefault(self.capacity - sum(lengths), []).append((lengths, n))

    def longest(self, most: int, least: int = 1) -> int:
        """The longest length left of at most this many tokens; 0 if there is none."""
        there = np.nonzero(self.left[least : most + 1])[0]
        return int(there[-1]) + least if len(there) else 0

    def by_patterns(self, bins: int, docs: int) -> None:
        width = self.capacity // bins
        if width * bins != self.capacity or not self.left.any():
            return
        shapes = patterns(bins, docs)
        usage = np.zeros((bins + 1, len(shapes)))
        for j, shape in enumerate(shapes):
            for b in shape:
                usage[b, j] += 1
        binned = np.bincount(-(-np.arange(len(self.left)) // width), self.left, bins + 1)
        binned[bins] = 0  # as long as a sequence, or nearly: no pattern has room for company
        repeats = np.floor(nnls(usage, binned)).astype(int)
        for j in np.argsort(-repeats, kind="stable"):
            n = int(repeats[j])
            while n > 0:
                chosen: list[int] = []
                for b in shapes[j][:0:-1]:  # the largest bins first; the smallest is found by best fit
                    self.left[chosen] -= 1
                    size = self.longest(b * width, (b - 1) * width + 1)
                    self.left[chosen] += 1
                    if size:
                        chosen.append(size)
                if len(chosen) < len(shapes[j]) - 1:
                    break
                np.subtract.at(self.left, chosen, 1)
                last = self.longest(self.capacity - sum(chosen))
                np.add.at(self.left, chosen, 1)
                if not last or self.capacity - sum(chosen) - last > width:
                    break
                chosen.append(last)
                uses = {size: chosen.count(size) for size in chosen}
                m = min(n, *(int(self.left[size]) // k for size, k in uses.items()))
                if m < 1:
                    break
                for size, k in uses.items():
                    self.left[size] -= m * k
                self.put(tuple(chosen), m)
                n -= m

    def by_best_fit(self) -> None:
        gaps = np.zeros(self.capacity + 1, np.int64)
        for gap, groups in self.open.items():
            gaps[gap] = sum(n for _, n in groups)
        for size in range(self.capacity, 0, -1):
            n = int(self.left[size])
            while n:
                fits = np.nonzero(gaps[size:])[0]
                if len(fits):
                    gap = int(fits[0]) + size
                    groups = self.open[gap]
                    lengths, have = groups.pop()
                    m = min(n, have)
                    if have > m:
                        groups.append((lengths, have - m))
                    gaps[gap] -= m
                    gaps[gap - size] += m
                    self.put((*lengths, size), m)
                    n -= m
                else:
                    each = self.capacity // size
                    full, rest = divmod(n, each)
                    for k, m in ((each, full), (rest, 1 if rest else 0)):
                        self.put((size,) * k, m)
                        gaps[self.capacity - k * size] += m if k else 0
                    n = 0
            self.left[size] = 0

    def runs(self) -> np.ndarray:
        """Rows (length, first rank, ranks, first sequence, offset), by length and rank."""
        used = np.zeros(self.capacity + 1, np.int64)
        out, sequence = [], 0
        for gap in sorted(self.open):
            for lengths, n in self.open[gap]:
                at = 0
                for size in lengths:
                    out.append((size, used[size], n, sequence, at))
                    used[size] += n
                    at += size
                sequence += n
        rows = np.array(out, np.int64).reshape(-1, 5)
        return rows[np.lexsort((rows[:, 1], rows[:, 0]))]


def plan_packing(histogram: np.ndarray, capacity: int = CAPACITY, bins: int = PATTERN_BINS, docs: int = PATTERN_DOCS) -> np.ndarray:
    """histogram[n]: pieces of n tokens. The runs of a packing of all of them."""
    plan = Plan(histogram, capacity)
    plan.by_patterns(bins, docs)
    plan.by_best_fit()
    return plan.runs()


def pack(docs: DataFrame, text: str = "text", capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = staged(pieces(docs, text, capacity, path), "pieces")
    histogram = np.zeros(capacity + 1, np.int64)
    for r in cut.groupBy("length").count().collect():  # as many rows as a sequence has tokens, at most
        histogram[r["length"]] = r["count"]
    runs = plan_packing(histogram, capacity)
    buckets = max(1, -(-int(histogram.sum()) // BUCKET_ROWS))
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("c"))
    carried = counts.select("length", "bucket", F.coalesce(F.sum("c").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("carried"))
    inside = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = dealt.withColumn("i", inside).join(carried, ["length", "bucket"]).withColumn("rank", F.col("carried") + F.col("i") - 1)

    def place(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = runs[:, 0] << 44 | runs[:, 1]
        for batch in stream:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, length << 44 | rank, side="right") - 1
            sequence = runs[at, 3] + rank - runs[at, 1]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(sequence), pa.array(runs[at, 4])], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
