"""N-grams of whole corpora: blocks of documents, and numbers by n-gram that travel between blocks and shards.

Documents become blocks of about BLOCK_BYTES of text: a sorted dictionary of
word hashes and each token's number in it. A block merges its own n-grams, cuts
them by leading bits of their keys into shards, and sends each slice sorted and
packed. A shard meets one key's slices of all blocks and answers each block in
the order of what it sent, so answers carry no keys. A word or n-gram that fills
the corpus is one number for each block, and no task holds more than a shard.

An n-gram's key chains scrambles of its words' 64-bit hashes. With a billion
different words the expected number of equal hashes is 0.03; with ten billion
different n-grams that of equal keys is about three pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import chunks, groups, lean, partitions
from millrace.llm.tokens import mix, pack, pack_ints, unpack, unpack_ints, words

BLOCK_BYTES, CHUNK_BYTES = 4 << 20, 1 << 20
#: Tokens for each shard, about.
SHARD_TOKENS = 2 << 20
BEGIN, END = np.uint64(0x626567696E), np.uint64(0x656E64)


def pair_keys(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The key of an n-gram from that of the n-gram without its last word, and that word's hash."""
    return mix(mix(context + np.uint64(7)) * np.uint64(3) + word)


def salted(hashes: np.ndarray, salt: np.ndarray) -> np.ndarray:
    return mix(hashes + salt)


def in_order(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the places of keys in order of key, equal ones in order of place; the keys so ordered).

    Numbers sort much faster by themselves than places do by numbers. So each
    key gives its last bits to its place, after the leading bits that all share
    have gone; keys that are told apart only by bits lost are sorted the slow way.
    """
    n = len(keys)
    if n < 2:
        return np.arange(n), keys.copy()
    shared, bits = np.uint64(64 - (int(keys.min()) ^ int(keys.max())).bit_length()), np.uint64((n - 1).bit_length())
    if shared == 64:
        return np.arange(n), keys.copy()
    packed = keys << shared
    packed >>= bits
    packed <<= bits
    packed |= np.arange(n, dtype=np.uint64)
    packed.sort()
    packed &= np.uint64((1 << int(bits)) - 1)
    order = packed.view("<i8")
    held = keys[order]
    if (held[1:] < held[:-1]).any():
        order = np.argsort(keys, kind="stable")
        held = keys[order]
    return order, held


def changes(held: np.ndarray) -> np.ndarray:
    """Which of the ordered keys differ from the one before."""
    new = np.ones(len(held), bool)
    np.not_equal(held[1:], held[:-1], out=new[1:])
    return new


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct keys, the first place of each, number of each place's key)."""
    order, held = in_order(keys)
    new = changes(held)
    number = np.empty(len(keys), "<i8")
    number[order] = np.cumsum(new) - 1
    return held[new], order[new], number


class Grams:
    """The n-grams of a stream of numbered words by order, made when they are first read."""

    def __init__(self, vocabulary: np.ndarray, tokens: np.ndarray, before: np.ndarray):
        self.before = before
        self._ending, self._keys, self._number, self._place = {1: vocabulary[tokens]}, {1: vocabulary}, {1: tokens}, {}

    def ending(self, m: int) -> np.ndarray:
        if m not in self._ending:
            self._ending[m] = pair_keys(self.ending(m - 1)[self.before], self._ending[1])
        return self._ending[m]

    def keys(self, m: int) -> np.ndarray:
        if m not in self._keys:
            held = np.sort(self.ending(m))
            self._keys[m] = held[changes(held)]
        return self._keys[m]

    def _found(self, of: dict[int, np.ndarray], m: int) -> np.ndarray:
        if m not in of:
            keys, self._place[m], self._number[m] = distinct(self.ending(m))
            self._keys.setdefault(m, keys)
        return of[m]

    def number(self, m: int) -> np.ndarray:
        return self._found(self._number, m)

    def place(self, m: int) -> np.ndarray:
        return self._found(self._place, m)


class ByOrder:
    def __init__(self, of: Callable[[int], np.ndarray]):
        self.of = of

    def __getitem__(self, m: int) -> np.ndarray:
        return self.of(m)


class Block:
    """Documents as streams of BEGIN, words, END; for each order the distinct n-grams, a place of each, and which one ends at each token.

    The n-grams that end at BEGIN are of BEGINs alone; they are contexts only.
    Orders are made as they are read: sorted keys alone take no numbers, and
    longer keys don't need the shorter ones sorted.
    """

    def __init__(self, row: dict):
        lengths = unpack_ints(row["lengths"])
        self.marks = np.frombuffer(row["marks"], bool)
        vocabulary, tokens = unpack(row["vocabulary"]), unpack_ints(row["tokens"])
        self.doc = np.repeat(np.arange(len(lengths)), lengths)
        self.begins = np.cumsum(lengths) - lengths
        self.real = np.ones(len(tokens), bool)
        self.real[self.begins] = False
        self.before = np.arange(-1, len(tokens) - 1)
        self.before[self.begins] = self.begins
        # Nothing of these refers to the block, so that its arrays go with it at once.
        grams = Grams(vocabulary, tokens, self.before)
        #: ending: the key of the n-gram that ends at each token.
        self.ending, self.keys, self.number, self.place = ByOrder(grams.ending), ByOrder(grams.keys), ByOrder(grams.number), ByOrder(grams.place)

    def counts(self, m: int) -> np.ndarray:
        """How many words and ends each n-gram ends at."""
        held = np.sort(self.ending[m])
        first = np.flatnonzero(changes(held))
        out = np.diff(first, append=len(held))
        out[np.searchsorted(self.keys[m], self.ending[m][self.begins])] = 0
        return out

    def slices(self, level: int, bits: int, chosen: np.ndarray | None = None, part: int = 0, parts: int = 1) -> list[tuple[int, int, int]]:
        """(shard, from, to) of the sorted keys of a level, or of the chosen ones, by their leading bits; empty ones are left out. Of `parts` ranges of shards, one."""
        keys = self.keys[level] if chosen is None else self.keys[level][chosen]
        shards = np.arange((part << bits) // parts, (part + 1 << bits) // parts + 1, dtype=np.uint64)
        edge = np.searchsorted(keys >> np.uint64(64 - bits), shards)
        return [(int(s), int(a), int(b)) for s, a, b in zip(shards[:-1], edge[:-1], edge[1:], strict=True) if b > a]


def block_schema(carried: str) -> str:
    return f"block bigint, carried array<{carried}>, marks binary, lengths binary, vocabulary binary, tokens binary"


def make_blocks(batches: Iterator[pa.RecordBatch], block_bytes: int | None = None) -> Iterator[pa.RecordBatch]:
    """Blocks from (text, salt, mark, carried). Words, BEGIN and END are told apart by salt as well."""
    block_bytes = block_bytes or BLOCK_BYTES
    held: list[tuple] = []
    size = made = 0
    partition = TaskContext.get().partitionId()

    def flush() -> pa.RecordBatch:
        carried, marks, lengths, hashes = zip(*held, strict=True)
        vocabulary, _, tokens = distinct(np.concatenate(hashes))
        rows = pa.concat_arrays(carried)
        listed = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)
        return pa.RecordBatch.from_arrays([pa.array([partition << 24 | made], pa.int64()), listed, *[pa.array([x], pa.binary()) for x in (np.concatenate(marks).tobytes(), pack_ints(np.concatenate(lengths)), pack(vocabulary), pack_ints(tokens))]], ["block", "carried", "marks", "lengths", "vocabulary", "tokens"])

    for batch in (part for whole in lean(batches) if whole.num_rows for part in chunks(whole, 0, CHUNK_BYTES)):
        hashes, offsets = words(batch.column(0))
        n, docs = np.diff(offsets), np.arange(batch.num_rows)
        stream = np.empty(len(hashes) + 2 * len(docs), np.uint64)
        stream[offsets[:-1] + 2 * docs] = BEGIN
        stream[offsets[1:] + 2 * docs + 1] = END
        stream[np.arange(len(hashes)) + np.repeat(2 * docs + 1, n)] = hashes
        salt = batch.column(1).to_numpy().view(np.uint64)
        if salt.any():
            stream = salted(stream, np.repeat(salt, n + 2))
        held.append((batch.column(3), batch.column(2).to_numpy(zero_copy_only=False), n + 2, stream))
        size += pc.sum(pc.binary_length(batch.column(0))).as_py() or 0
        if size >= block_bytes:
            yield flush()
            held, size, made = [], 0, made + 1
    if held:
        yield flush()


def rows_of(batches: Iterator[pa.RecordBatch], arrow: tuple[str, ...] = ()) -> Iterator[dict]:
    """Rows as dictionaries; columns named in `arrow` stay Arrow values."""
    for batch in lean(batches):
        for i in range(batch.num_rows):
            yield {name: batch.column(name)[i] if name in arrow else batch.column(name)[i].as_py() for name in batch.schema.names}


SENT = "level int, shard int, block bigint, keys binary, data binary"
ANSWER = "level int, shard int, block bigint, data binary"


def sent_rows(block: int, level: int, keys: np.ndarray, cut: list[tuple[int, int, int]], data: Callable[[int, int], bytes | None]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "level": pa.array([level] * len(cut), pa.int32()), "shard": pa.array([s for s, _, _ in cut], pa.int32()), "block": pa.array([block] * len(cut), pa.int64()),
        "keys": pa.array([pack(keys[a:b]) for _, a, b in cut], pa.binary()), "data": pa.array([data(a, b) for _, a, b in cut], pa.binary()),
    })


def to_shards(sent: DataFrame) -> DataFrame:
    """Rows of (level, shard) together, in order of block; levels and shards are dealt to partitions in turn."""
    n = partitions(sent.sparkSession)
    return sent.repartitionById(n, F.pmod(F.col("shard") * 7 + F.col("level"), F.lit(n))).sortWithinPartitions("level", "shard", "block")


def shard_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    return groups(lean(batches), ["level", "shard"])


def with_answers(blocks: DataFrame, answers: DataFrame, name: str = "answers") -> DataFrame:
    """blocks, which are stored by block, with the list of each one's answers; only answers travel."""
    listed = answers.repartition(partitions(blocks.sparkSession), "block").groupBy("block").agg(F.collect_list(F.struct("level", "shard", "data")).alias(name))
    return blocks.join(listed, "block", "left")


def joined(answers: list[dict] | None, level: int) -> np.ndarray | None:
    """The answers of a level's shards, in order of keys, as numbers."""
    own = sorted((a for a in answers or () if a["level"] == level), key=lambda a: a["shard"])
    return np.concatenate([unpack_ints(a["data"]) for a in own]) if own else None


def shard_bits(tokens: int, each: int | None = None) -> int:
    """How many leading bits make shards of about that many tokens each."""
    return max(2, (int(tokens) // (each or SHARD_TOKENS)).bit_length())
