"""Katz backoff scoring: Good-Turing counts, exactly normalised weights, all of the corpus.

The model is of any order over words and an end token, with beginnings as the
first context. A seen n-gram has d(c) * c / (c(h) + HELD), where d is its
order's Good-Turing discount; any other has alpha(h) times the probability by
the shorter context, down to discounted unigrams, whose missing mass is that of
the one unknown word. alpha(h) is what the n-grams after h leave, over the
shorter context's mass of what was not seen after h, so each context's
probabilities add up to one. HELD keeps alpha above zero where all counts are
too high for a discount.

Blocks send their n-grams to shards (see ngrams), which add up the counts, store
them as tables partitioned by role and level, and answer each block with the
totals of what it sent. Orders go one after the other, and the longest in
PASSES ranges of keys, so that little is on the way at a time. Of a context,
blocks then send whole numbers only: how many n-grams after it were seen one to
DISCOUNTED times, and the same of their shorter n-grams. Each n-gram is told of
by one block, the first that trained on it. From their sums the shard makes the
backoff weight, stores it and answers the blocks that need it. Weights are made
for contexts that some held-out document holds: no other token backs off.
Blocks then score their own tokens, from the shortest context to the longest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import bucketed, dropped, release, rows_a_batch, written
from millrace.llm.ngrams import ANSWER, END, SENT, Block, block_schema, joined, make_blocks, rows_of, sent_rows, shard_bits, shard_groups, to_shards, with_answers
from millrace.llm.tokens import pack, pack_ints, unpack, unpack_ints

ORDER = 3
#: Ranges of keys that an order above the second is counted in, and that weights are made in.
PASSES = 2
#: Blocks, or slices of them, in an Arrow batch.
BLOCK_ROWS = 2
#: Counts up to this one are discounted.
DISCOUNTED = 5
HELD = 0.01

MODEL = "role string, level int, shard int, block bigint, keys binary, data binary, stats array<bigint>"
_SCHEMA = pa.schema([("role", pa.string()), ("level", pa.int32()), ("shard", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("data", pa.binary()), ("stats", pa.list_(pa.int64()))])


def discounts(n: list[int]) -> np.ndarray:
    """d(1) to d(DISCOUNTED) from counts of counts n[0] = n_1 and on; where Good-Turing gives none in (0, 1), (r - 1/2) / r."""
    k = DISCOUNTED
    out = []
    common = (k + 1) * n[k] / n[0] if n[0] else 1.0
    for r in range(1, k + 1):
        d = ((r + 1) * n[r] / (r * n[r - 1]) - common) / (1 - common) if n[r - 1] and common < 1 else 0.0
        out.append(d if 0 < d < 1 else (r - 0.5) / r)
    return np.array(out)


def discounted(d: np.ndarray, c: np.ndarray) -> np.ndarray:
    """d(c) * c."""
    return np.where(c <= DISCOUNTED, np.append(0.0, d)[np.minimum(c, DISCOUNTED)], 1.0) * c


class Unigrams:
    """P(w) by count; what the discounts free belongs to the unknown word."""

    def __init__(self, counts_of_counts: list[int], total: int):
        self.d = discounts(counts_of_counts)
        cut = sum(n * r * (1 - d) for r, (n, d) in enumerate(zip(counts_of_counts, self.d, strict=False), 1))
        freed = cut or 0.5
        self.total, self.unknown = total - cut + freed, freed / (total - cut + freed)

    def __call__(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, discounted(self.d, c) / self.total, self.unknown)


def _model_row(role: str, level: int, shard: int, block: int | None, keys: bytes | None, data: bytes, stats: list[int] | None = None) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(dict(zip(_SCHEMA.names, ([role], [level], [shard], [block], [keys], [data], [stats]), strict=True)), _SCHEMA)


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a shard: the count table, and to each block for each of its keys 4 times the total, plus 2 where a held-out document has it, plus 1 where the block is the first to train on it."""
    for group in shard_groups(batches):
        level, shard = group["level"][0].as_py(), group["shard"][0].as_py()
        parts = [unpack(k) for k in group["keys"].to_pylist()]
        ends = np.cumsum([len(p) for p in parts])
        keys = np.concatenate(parts)
        sent = np.concatenate([unpack_ints(c) for c in group["data"].to_pylist()])
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        new = np.ones(len(keys), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        first = np.flatnonzero(new)
        sent = sent[order]
        total = np.add.reduceat(sent >> 1, first)
        value = total * 4 + 2 * np.bitwise_or.reduceat(sent & 1, first)
        owner = np.minimum.reduceat(np.where(sent > 1, np.arange(len(keys)), len(keys)), first)
        answer = np.empty(len(keys), "<i8")
        answer[order] = np.repeat(value, np.diff(np.append(first, len(keys))))
        answer[order[owner[owner < len(keys)]]] += 1
        seen = total > 0
        stats = [*np.bincount(np.minimum(total[seen], DISCOUNTED + 2), minlength=DISCOUNTED + 3)[1 : DISCOUNTED + 2].tolist(), int(total.sum()), int(seen.sum())]
        yield _model_row("model", level, shard, None, pack(ordered[first][seen]), pack_ints(total[seen]), stats)
        for block, a, b in zip(group["block"].to_pylist(), np.append(0, ends[:-1]), ends, strict=True):
            yield _model_row("answer", level, shard, block, None, pack_ints(answer[a:b]))


class Counted(Block):
    """A block with the corpus's counts of its n-grams: for each order `count`, `own` and `held`."""

    def __init__(self, row: dict, order: int):
        super().__init__(row)
        answers = [joined(row["answers"], m) for m in range(1, order + 1)]
        self.count = [None, *[a >> 2 for a in answers]]
        self.own = [None, *[(a & 1) > 0 for a in answers]]
        self.held = [None, *[(a & 2) > 0 for a in answers]]
        # BEGIN comes as often as END; as an n-gram it was never sent as trained on.
        documents = self.count[1][np.searchsorted(self.keys[1], END)]
        for m in range(1, order):
            at = self.number[m][self.begins[0]]
            self.count[m][at], self.held[m][at] = documents, True

    def needed(self, m: int) -> np.ndarray:
        """The contexts of m words, seen in training, that some token here backs off from."""
        unseen = self.real & (self.count[m + 1][self.number[m + 1]] == 0)
        out = np.zeros(len(self.keys[m]), bool)
        out[self.number[m][self.before[unseen]]] = True
        return out & (self.count[m] > 0)

    def context_sums(self, m: int, lo: int, hi: int) -> np.ndarray:
        """A column for each context of m words from number lo to hi: numbers of its own n-grams by count 1 to DISCOUNTED, the same of their shorter n-grams' counts, the sum of those, and counts of the context and of its last m - 1 words."""
        n = hi - lo
        at = self.place[m + 1][self.own[m + 1]]
        context, c = self.number[m][self.before[at]] - lo, self.count[m + 1][self.own[m + 1]]
        here = (context >= 0) & (context < n)
        at, context, c = at[here], context[here], c[here]
        low = self.count[m][self.number[m][at]]
        rows = [np.bincount(context[x == r], minlength=n) for x in (c, low) for r in range(1, DISCOUNTED + 1)]
        rows.append(np.bincount(context, low, n).astype("<i8"))
        tells = self.own[m].copy()
        tells[self.number[m][self.begins[0]]] = True
        rows.append(np.where(tells, self.count[m], 0)[lo:hi])
        below = np.zeros(len(tells), "<i8")
        if m > 1:
            below[self.number[m]] = self.count[m - 1][self.number[m - 1]]
        rows.append(np.where(tells, below, 0)[lo:hi])
        return np.array(rows)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row.

    Documents whose CRC-32 of the id, as text, is 1 modulo 5 are held out of
    training; a null id's text is empty, so it trains. Ids may be of any type
    that casts to text. Null text: the end token only. Repeated rows count as
    often as they come. A very long text is a block of its own, which one task
    holds (some 200 bytes a word). Ties need no rule. Without any training
    document every word is unknown. An empty table gives no rows. Other columns
    are never read, so their names can't clash.
    """
    if order < 2:
        raise ValueError("the order is 2 or more")
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[id_col]
    held_out = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 1
    plain = docs.select(F.col(text_col).alias("text"), F.lit(0).cast("bigint").alias("salt"), held_out.alias("mark"), F.struct(F.col(id_col).alias("id")).alias("carried"))
    result = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    with rows_a_batch(spark, 1000):
        made = plain.mapInArrow(make_blocks, block_schema(f"struct<id:{kind}>"))
        with bucketed(made, "blocks", "block") as blocks:
            return _score(blocks, order, result).withColumnRenamed("doc_id", id_col)


def _score(blocks: DataFrame, order: int, result: str) -> DataFrame:
    spark = blocks.sparkSession
    tokens = blocks.select("lengths").mapInArrow(_sizes, "n bigint").agg(F.sum("n")).first()[0] or 0
    bits = shard_bits(tokens)

    def counting(levels: list[int], part: int, parts: int):
        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in rows_of(batches):
                block = Block(row)
                marks = block.marks[block.doc]
                for m in levels:
                    cut = block.slices(m, bits, None, part, parts)
                    sent = 2 * np.bincount(block.number[m][block.real & ~marks], minlength=len(block.keys[m]))
                    sent[block.number[m][marks]] |= 1
                    yield sent_rows(row["block"], m, block.keys[m], cut, lambda a, b: pack_ints(sent[a:b]))  # noqa: B023

        return send

    tables = []
    steps = [([1, 2], 0, 1)] + [([m], p, PASSES) for m in range(3, order + 1) for p in range(PASSES)]
    for levels, part, parts in steps:
        with rows_a_batch(spark, BLOCK_ROWS):
            sent = blocks.select("block", "marks", "lengths", "vocabulary", "tokens").mapInArrow(counting(levels, part, parts), SENT)
            counted = written(to_shards(sent).mapInArrow(_add_up, MODEL), "katz-counts", partition_by="role")
        tables.append(counted)
        del sent  # else its shuffle files stay
        release(spark)
    every = tables[0]
    for t in tables[1:]:
        every = every.union(t)
    stats = {r.level: [int(x) for x in r.s] for r in every.filter("role = 'model'").groupBy("level").agg(F.array(*[F.sum(F.col("stats")[i]) for i in range(DISCOUNTED + 3)]).alias("s")).collect()}
    zeros = [0] * (DISCOUNTED + 3)
    *ones, n_train, n_kinds = stats.get(1, zeros)
    unigrams = Unigrams(ones, n_train)
    d = [None, unigrams.d, *[discounts(stats.get(m, zeros)[: DISCOUNTED + 1]) for m in range(2, order + 1)]]

    answers = every.filter("role = 'answer'").select("level", "shard", "block", "data")
    answered = with_answers(blocks, answers)

    def weighing(part: int):
        def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in rows_of(batches):
                block = Counted(row, order)
                for m in range(1, order):
                    cut = block.slices(m, bits, None, part, PASSES)
                    if not cut:
                        continue
                    lo, hi = cut[0][1], cut[-1][2]
                    sums, needed = block.context_sums(m, lo, hi), block.needed(m)[lo:hi]
                    chosen = np.flatnonzero(needed | (block.held[m][lo:hi] & (sums != 0).any(axis=0)))
                    sums = np.vstack([sums, needed])[:, chosen]
                    yield sent_rows(row["block"], m, block.keys[m][lo:hi][chosen], block.slices(m, bits, lo + chosen, part, PASSES), lambda a, b: pack_ints(sums[:, a:b].ravel()))  # noqa: B023

        return weigh

    def back_off(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.arange(1, DISCOUNTED + 1)
        for group in shard_groups(batches):
            m, shard = group["level"][0].as_py(), group["shard"][0].as_py()
            parts = [unpack(k) for k in group["keys"].to_pylist()]
            sent = np.concatenate([unpack_ints(x).reshape(-1, len(p)) for x, p in zip(group["data"].to_pylist(), parts, strict=True)], axis=1)
            keys, place = np.unique(np.concatenate(parts), return_inverse=True)
            sums = [np.bincount(place, row, len(keys)) for row in sent[: 2 * DISCOUNTED + 1]]
            follows, below = np.zeros(len(keys), "<i8"), np.zeros(len(keys), "<i8")
            np.maximum.at(follows, place, sent[-3])
            np.maximum.at(below, place, sent[-2])
            left = r * (1 - d[m + 1]) @ np.array(sums[:DISCOUNTED])
            covered = sums[-1] - r * (1 - d[m]) @ np.array(sums[DISCOUNTED:-1])
            whole = unigrams.total if m == 1 else below + HELD
            alpha = (left + HELD) / (follows + HELD) * whole / (whole - covered)
            yield _model_row("model", m, shard, None, pack(keys), alpha.tobytes())
            ends = np.cumsum([len(p) for p in parts])
            for block, a, b in zip(group["block"].to_pylist(), np.append(0, ends[:-1]), ends, strict=True):
                wanted = place[a:b][sent[-1, a:b] > 0]
                if len(wanted):
                    yield _model_row("answer", m, shard, block, None, alpha[wanted].tobytes())

    # Levels of weights count on from those of counts, so that one list holds both.
    found = answers
    for part in range(PASSES):
        with rows_a_batch(spark, BLOCK_ROWS):
            weights = answered.select("block", "marks", "lengths", "vocabulary", "tokens", "answers").mapInArrow(weighing(part), SENT)
            tables.append(written(to_shards(weights).mapInArrow(back_off, MODEL), "katz-backoff", partition_by="role"))
        found = found.union(tables[-1].filter("role = 'answer'").select((F.col("level") + order).alias("level"), "shard", "block", "data"))
        del weights
        release(spark)

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor = n_train + 0.5 * (n_kinds + 1)
        for row in rows_of(batches, ("carried",)):
            block = Counted(row, order)
            at = np.flatnonzero(block.real)
            c = block.count[1][block.number[1][at]]
            p = unigrams(c)
            for m in range(2, order + 1):
                context = block.number[m - 1][block.before[at]]
                count = block.count[m][block.number[m][at]]
                alpha = np.ones(len(block.keys[m - 1]))
                own = sorted((a for a in row["answers"] if a["level"] == order + m - 1), key=lambda a: a["shard"])
                if own:
                    alpha[block.needed(m - 1)] = np.concatenate([np.frombuffer(a["data"]) for a in own])
                p = np.where(count > 0, discounted(d[m], count) / (block.count[m - 1][context] + HELD), alpha[context] * p)
            n, doc = len(block.marks), block.doc[at]
            sums = lambda x: np.bincount(doc, x, n)  # noqa: B023, E731
            columns = [row["carried"].values.flatten()[0], block.marks, sums(None), sums(c > 0).astype("<i8"), np.full(n, n_train), sums(np.log10((c + 0.5) / floor)), sums(np.log10(p))]
            yield pa.RecordBatch.from_arrays([pa.array(x) if isinstance(x, np.ndarray) else x for x in columns], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    with rows_a_batch(spark, BLOCK_ROWS):
        scored = written(with_answers(blocks, found).mapInArrow(evaluate, result), "katz-scores")
    dropped(*tables)
    return scored


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in rows_of(batches):
        yield pa.RecordBatch.from_pydict({"n": [int(unpack_ints(row["lengths"]).sum())]})
