"""Exact repeated passages: every byte covered by a `length`-byte string that starts twice.

Equal strings are brought together first. The least hash of all k-grams of a
string is the same wherever the string stands, so it names the string's group;
stretches of neighbouring starts with one group are cut out as pieces. Only
groups that occur twice are kept, equal pieces become one with a count, and
groups above HOT occurrences are split by further least hashes, which equal
strings share as well.

Each shard of groups is then solved by a Burrows-Wheeler transform of its
pieces, without those that are alone in their group but for copies: breadth-first backward extension of intervals finds common prefix
lengths in increasing order (Beller et al. 2011), and stops at `length`:
boundaries between neighbouring suffixes that have no value by then have that
much in common. Suffixes are sorted to that depth only, which is as far as the
intervals ever look.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import chunks, dropped, groups, partitions, release, small, written
from millrace.llm.tokens import mix

LENGTH, GRAM = 200, 32
BATCH_BYTES = 2 << 20
#: Bytes of pieces that one transform takes, and occurrences from which a group is split.
SHARD_BYTES, HOT = 3 << 19, 4000
#: Groups up to this number (48 MB) are broadcast; more are joined by a shuffle.
BROADCAST_GROUPS = 2_000_000


#: k-gram hashes are polynomials modulo 2^64, short enough for that modulus; equal ones only bring strings together that are then compared.
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_VALUE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Tables:
    up = _powers(0, _BASE)
    down = _powers(0, _INVERSE)


def _buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds) of a column of texts; null is empty."""
    texts = pa.compute.fill_null(texts.cast(pa.large_binary()), b"")
    bounds = np.frombuffer(texts.buffers()[1], "<i8")[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]] if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours, by minima of blocks from both ends."""
    blocks = -(-len(h) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(h)] = h
    table = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    back = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(h) - width + 1
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


class Starts:
    """The possible starts in a buffer of texts, with their groups."""

    def __init__(self, texts: pa.Array, length: int = LENGTH, gram: int = GRAM):
        self.data, bounds = _buffer(texts)
        self.length, self.width = length, length - gram + 1
        count = np.maximum(0, np.diff(bounds) - length + 1)
        self.doc = np.repeat(np.arange(len(count)), count)
        self.at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + bounds[:-1][self.doc]
        self.origin = bounds[:-1]
        if not len(self.at):
            self.hashes = self.group = np.zeros(0, np.uint64)
            return
        size = len(self.data)
        if size >= len(_Tables.up):
            _Tables.up, _Tables.down = _powers(size, _BASE), _powers(size, _INVERSE)
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(_VALUE[self.data] * _Tables.up[:size], out=sums[1:])
        self.hashes = mix((sums[gram:] - sums[:-gram]) * _Tables.down[: size - gram + 1])
        self.group = _least(self.hashes, self.width)[self.at]

    def runs(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, number of starts) of the stretches of one key in one text."""
        if not len(key):
            return np.zeros(0, "<i8"), np.zeros(0, "<i8")
        first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (self.doc[1:] != self.doc[:-1])]))
        return first, np.diff(np.append(first, len(key)))

    def times(self, first: np.ndarray, n: np.ndarray) -> np.ndarray:
        """How often each stretch's least k-gram starts in it, at least: a string can stand twice in one stretch only if that k-gram leaves the string's range before the stretch ends."""
        leaves = np.concatenate([[0], np.cumsum(self.hashes[self.at] == self.group)]) if len(first) else np.zeros(1, "<i8")
        return 1 + leaves[first + n - 1] - leaves[first]

    def split_keys(self, parts: np.ndarray) -> np.ndarray:
        """The groups, those with parts > 1 split by two more least hashes."""
        key = self.group.copy()
        hot = np.flatnonzero(parts > 1)
        if len(hot):
            more = [_least(mix(self.hashes ^ np.uint64(seed)), self.width)[self.at[hot]] for seed in (101, 202)]
            key[hot] = mix(key[hot] + np.uint64(1) + mix(more[0] + mix(more[1])) % parts[hot].astype(np.uint64))
        return key


def suffix_order(symbols: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """Positions by their first `depth` symbols or more, counting none after a 0, which ends a piece; ties in any order.

    Seven symbols at once, then prefix doubling over just the groups that are
    still open; `left` is the number of symbols to a position's 0, and with it.
    """
    n = len(symbols)
    key, alive = np.zeros(n, np.uint64), np.ones(n, bool)
    padded = np.append(symbols, np.zeros(7, symbols.dtype)).astype(np.uint64)
    for j in range(7):
        here = padded[j : j + n]
        key = key * np.uint64(512) + np.where(alive, here, np.uint64(0))
        alive &= here > 0
    order = np.argsort(key)
    key = key[order]
    starts = np.concatenate([[True], key[1:] != key[:-1]])
    group = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
    rank = np.empty(n, "<i8")
    rank[order] = group
    slots, reach = np.arange(n), 7
    while reach < depth:
        here = order[slots]
        single = starts[slots] & np.append(starts, True)[slots + 1]
        slots = slots[~single & (left[here] > reach)]
        if not len(slots):
            break
        here = order[slots]
        key = (rank[here] << 32) | (rank[here + reach] + 1)
        by = np.argsort(key)
        key, here = key[by], here[by]
        order[slots] = here
        change = np.concatenate([[True], key[1:] != key[:-1]])
        starts[slots] = change
        rank[here] = slots[np.maximum.accumulate(np.where(change, np.arange(len(slots)), 0))]
        reach *= 2
    return order


def repeated(pieces: list[bytes], length: int) -> list[np.ndarray]:
    """For each piece the starts whose `length`-byte string also starts elsewhere among the pieces."""
    joined = np.frombuffer(b"".join(p + b"\0" for p in pieces), np.uint8)
    symbols = joined.astype("<i2") + 1
    stops = np.cumsum([len(p) + 1 for p in pieces]) - 1
    symbols[stops] = 0
    n, m = len(symbols), len(pieces)
    if n == m:
        return [np.zeros(0, "<i8") for _ in pieces]
    left = np.repeat(stops, np.diff(stops, prepend=-1)) - np.arange(n) + 1
    order = suffix_order(symbols, left, length)
    before = symbols[order - 1]  # the transform; before the first symbol is the last end
    # LF: where the suffix one symbol longer stands.
    lf = np.empty(n, "<i8")
    lf[np.argsort(before, kind="stable")] = np.arange(n)
    first = symbols[order]
    # Intervals of single symbols; the ends of pieces, all alike, are one of them.
    lo = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
    hi = np.append(lo[1:], n)
    known = np.zeros(n + 1, bool)
    known[: m + 1] = True
    known[hi] = True
    for _ in range(1, length):
        if not len(lo):
            break
        sizes = hi - lo
        owner = np.repeat(np.arange(len(lo)), sizes)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + lo[owner]
        inside = before[place] > 0
        packed = np.sort((lf[place[inside]] << 32) | owner[inside])
        where, owner = packed >> 32, packed & 0xFFFFFFFF
        if not len(where):
            break
        change = np.flatnonzero((owner[1:] != owner[:-1]) | (first[where[1:]] != first[where[:-1]])) + 1
        lo, hi = where[np.concatenate([[0], change])], where[np.append(change - 1, len(where) - 1)] + 1
        fresh = ~known[hi]
        known[hi[fresh]] = True
        lo, hi = lo[fresh], hi[fresh]
    alike = ~known  # boundary i: suffixes i - 1 and i share `length` symbols, or all of them up to an end
    hit = np.zeros(n, bool)
    hit[order[alike[:n] | alike[1 : n + 1]]] = True
    hit &= left > length
    return [np.flatnonzero(hit[stop - len(p) : stop]) for p, stop in zip(pieces, stops, strict=True)]


def _ranges(starts: np.ndarray) -> list[tuple[int, int]]:
    """Sorted starts as (first, last) of their unbroken runs."""
    cut = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.concatenate([[0], cut + 1])].tolist(), starts[np.append(cut, len(starts) - 1)].tolist(), strict=True)) if len(starts) else []


def solved_pieces(keys: np.ndarray, pieces: list[bytes], copies: np.ndarray, length: int) -> list[list[tuple[int, int]]]:
    """For each piece of a shard the runs of starts that are repeated.

    A piece that occurs several times is repeated throughout. If it is its
    group's only one as well, no other piece holds a string of it, so the
    transform would tell nothing and goes without it.
    """
    _, group, size = np.unique(keys, return_inverse=True, return_counts=True)
    open_ = np.flatnonzero((size[group] > 1) | (copies == 1))
    out = [[(0, len(p) - length)] if c > 1 else [] for p, c in zip(pieces, copies.tolist(), strict=True)]
    if len(open_):
        for i, starts in zip(open_.tolist(), repeated([pieces[i] for i in open_], length), strict=True):
            if copies[i] == 1:
                out[i] = _ranges(starts)
    return out


def spans(docs: DataFrame, text_col: str = "text", length: int = LENGTH, hot: int = HOT, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(h, spans) for each text, by its MD5, that has repeated passages; spans are (first, last) starts in bytes."""
    spark = docs.sparkSession
    texts = docs.select(F.unhex(F.md5(text_col)).alias("h"), F.col(text_col).alias("text")).filter(F.octet_length("text") >= length)

    def find_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches if whole.num_rows for part in chunks(whole, 1, BATCH_BYTES)):
            starts = Starts(batch.column(1), length)
            first, n = starts.runs(starts.group)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(starts.doc[first])), pa.array(starts.group[first].view("<i8")), pa.array((n + length - 1).astype("<i4")), pa.array(starts.times(first, n))], ["h", "g", "bytes", "times"])

    found = written(texts.mapInArrow(find_groups, "h binary, g bigint, bytes int, times bigint"), "groups")
    twice = found.groupBy("g").agg(F.sum("times").alias("n"), F.sum("bytes").alias("bytes")).filter("n > 1")
    twice = written(twice.select("g", F.ceil(F.col("n") / hot).cast("int").alias("parts"), "bytes"), "repeated-groups")
    total = twice.agg(F.sum("bytes")).first()[0] or 0
    lists = written(found.join(small(twice.select("g", "parts"), BROADCAST_GROUPS), "g").groupBy("h").agg(F.collect_set(F.struct("g", "parts")).alias("wanted")), "lists")
    dropped(found, twice)
    wanted = texts.join(lists, "h")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches if whole.num_rows for part in chunks(whole, 1, BATCH_BYTES)):
            starts = Starts(batch.column(1), length)
            column = batch.column(2)
            counts = np.diff(column.offsets.to_numpy())
            doc = np.repeat(np.arange(batch.num_rows), counts).astype(np.uint64)
            fields = column.flatten()
            tag = mix(fields.field(0).to_numpy().view(np.uint64) ^ mix(doc))
            order = np.argsort(tag)
            tag, parts = tag[order], fields.field(1).to_numpy()[order]
            own = mix(starts.group ^ mix(starts.doc.astype(np.uint64)))
            spot = np.minimum(np.searchsorted(tag, own), len(tag) - 1)
            parts = np.where(tag[spot] == own, parts[spot], 0)
            keys = starts.split_keys(parts)
            first, n = starts.runs(keys)
            keep = parts[first] > 0
            first, n = first[keep], n[keep]
            key = keys[first]
            a = starts.at[first]
            data = starts.data.tobytes()
            pieces = [data[x : x + k + length - 1] for x, k in zip(a.tolist(), n.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(starts.doc[first])), pa.array((a - starts.origin[starts.doc[first]]).astype("<i4")), pa.array(key.view("<i8")), pa.array([hashlib.md5(p).digest() for p in pieces], pa.binary()), pa.array(pieces, pa.binary())], ["h", "at", "key", "piece_id", "piece"])

    occurrences = written(wanted.mapInArrow(cut, "h binary, at int, key bigint, piece_id binary, piece binary"), "pieces")
    del wanted  # else its shuffle files stay
    dropped(lists)
    shards = max(1, math.ceil(total / shard_bytes))
    distinct = occurrences.groupBy("key", "piece_id", "piece").agg(F.count("*").alias("n")).withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    dealt = distinct.select("shard", "key", "piece_id", "piece", "n").repartition(min(shards, max(partitions(spark), shards // 64)), "shard").sortWithinPartitions("shard")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ["shard"]):
            found = solved_pieces(group["key"].to_numpy(), group["piece"].to_pylist(), group["n"].to_numpy(), length)
            out = [(i, r) for i, r in zip(group["piece_id"].to_pylist(), found, strict=True) if r]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in out], pa.binary()), pa.array([[{"a": a, "b": b} for a, b in r] for _, r in out], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))], ["piece_id", "ranges"])

    solved = written(dealt.mapInArrow(solve, "piece_id binary, ranges array<struct<a:int,b:int>>"), "solved")
    del distinct, dealt
    release(spark)
    # Equal pieces have one key, so a piece has one answer.
    hits = occurrences.select("h", "at", "piece_id").distinct().join(solved, "piece_id").select("h", "at", F.explode("ranges").alias("r"))
    result = written(hits.groupBy("h").agg(F.collect_set(F.struct((F.col("at") + F.col("r.a")).alias("a"), (F.col("at") + F.col("r.b")).alias("b"))).alias("spans")), "spans")
    del hits
    dropped(occurrences, solved)
    return result


RESULT = "n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, digest: bool = False, hot: int = HOT, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept bytes) for each row, or with `digest` kept_sha256 in place of the bytes.

    The kept bytes need not be UTF-8: a repeat may begin or end inside a
    character. Null text: as empty. Repeated rows repeat each other, and lose
    all if they are long enough. Other columns are never read; an empty table
    gives no rows.
    """
    found = spans(docs, text_col, length, hot, shard_bytes)
    plain = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.unhex(F.md5(text_col)).alias("h"))
    joined = plain.join(found, "h", "left").select("_id", "_text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches if whole.num_rows for part in chunks(whole, 1, BATCH_BYTES)):
            out = []
            for text, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data, kept, at, n = (text or "").encode(), [], 0, 0
                for a, b in sorted((r["a"], r["b"] + length) for r in ranges or ()):
                    if n == 0 or a > at:
                        n += 1
                        kept.append(data[at:a])
                    at = max(at, b)
                kept = b"".join([*kept, data[at:]])
                out.append((len(data), len(data) - len(kept), n, hashlib.sha256(kept).hexdigest() if digest else kept))
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string() if digest else pa.binary())], ["id", "n_bytes", "n_removed", "n_spans", "kept"])

    out = joined.mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, " + (RESULT.replace("kept binary", "kept string") if digest else RESULT))
    return out.withColumnsRenamed({"id": id_col, "kept": "kept_sha256"} if digest else {"id": id_col})
