"""Quality by an interpolated modified Kneser-Ney model of trusted text, one for each language.

Training takes all trusted documents of each language (`train_docs` bounds them,
in order of the hash of their id, where a caller asks for it). The longest order
has plain counts; a shorter n-gram counts the different words before it, except
after a beginning, before which nothing stands: there counts stay plain. The
model is a table by order and shard of the key space: an n-gram's count and, as
a context, its total and how many n-grams after it count one, two, and three or
more. Only discounts, a few numbers for each language, reach the driver.

Orders are counted from the longest down (see ngrams). Blocks of documents send
their n-grams' numbers; a shard adds them up, stores its part of the model, and
answers with the count of each n-gram to the first block that sent it. So each
n-gram is told of by one block, which adds it to the n-gram without its first
word and to the context without its last when the next order is sent.

Scoring joins counts shard by shard: blocks of documents send their n-grams'
keys, a shard's part of the model answers with whole numbers, and each block
makes its tokens' probabilities from the shortest order to the longest.
Documents go in WAVES by hash, the longest order apart from the others, so that
one wave's keys of one order and that order's model are on the way at a time.
Languages never meet: words are told apart by language as well.

Every fifth trusted document of a language, in order of the hash of its id, sets
its threshold instead of training: the quantile of all their perplexities. A
language with fewer than five trusted documents has no threshold;
`Model.unjudged` names those with some.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import _delete, bucketed, dropped, fresh, release, rows_a_batch, small, written
from millrace.llm.mixing import offsets
from millrace.llm.ngrams import ANSWER, BEGIN, SENT, Block, block_schema, changes, in_order, joined, make_blocks, rows_of, salted, sent_rows, shard_bits, shard_groups, to_shards, with_answers
from millrace.llm.tokens import pack, pack_ints, unpack, unpack_ints

ORDER = 3
#: Share of a language's held-out trusted documents whose perplexity is at the threshold or below; the threshold is the least of their perplexities for which it is reached.
QUANTILE = 0.995
WAVES = 6
#: Trusted documents that are ranked together, about.
RANKED = 2000
#: Training tokens for each shard of the stored model, about.
MODEL_TOKENS = 512 << 10
#: Bytes of text in a block, blocks or slices of them in an Arrow batch, and tokens that are scored at once.
BLOCK_BYTES, BLOCK_ROWS, PIECE = 3 << 19, 1, 1 << 17
#: Numbers of an n-gram of a shorter order: its count, and as a context its total and its n-grams that count 1, 2, 3 or more.
NUMBERS = 5
TABLE = "level int, shard int, block bigint, keys binary, data binary"
COUNTED = "role string, " + TABLE
STATS = "lang bigint, level int, n1 bigint, n2 bigint, n3 bigint, n4 bigint, total bigint, kinds bigint"


def lang_salt(lang: str | None) -> int:
    """What tells a language's words apart; null is a language of its own."""
    return int.from_bytes(hashlib.md5(("=" + lang if lang is not None else "").encode()).digest()[:8], "little") >> 1


def lang_key(lang: str | None) -> int:
    """The key of a language's beginning, by which its model is known."""
    return int(salted(np.array([BEGIN]), np.array([lang_salt(lang)], np.uint64))[0])


@dataclass
class Language:
    """discounts[m]: those of order m for counts 1, 2, and 3 or more. Of single words: total count, kinds, and kinds that count 1, 2, 3 or more."""

    discounts: list[list[float]]
    total: int
    kinds: int
    by_count: list[int]


@dataclass
class Model:
    """The stored table of each order, cut by the keys' leading `bits`, and each language's numbers by lang_key()."""

    order: int
    bits: int
    tables: dict[int, DataFrame]
    languages: dict[int, Language]
    #: Highest log10 perplexity that is kept.
    limits: dict[int, float] = field(default_factory=dict)
    #: Languages with trusted documents but no threshold, and how many were drawn: all their documents are kept.
    unjudged: dict[str | None, int] = field(default_factory=dict)

    def drop(self) -> None:
        dropped(*self.tables.values())


def kn_discounts(n: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts from the numbers of n-grams that count 1 to 4; where those give none in (0, count), half the count."""
    out = []
    for r in (1, 2, 3):
        d = r - (r + 1) * n[0] / (n[0] + 2 * n[1]) * n[r] / n[r - 1] if n[0] and n[r - 1] else 0.0
        out.append(d if 0 < d < r else 0.5 * r)
    return out


def _told(block: Block, answers: list[dict], m: int) -> tuple[np.ndarray, np.ndarray]:
    """(a place, the count) of each n-gram of order m that this block tells of."""
    c = joined(answers, m)
    own = np.flatnonzero(c)
    place = block.place[m]
    if m == 1:
        place = np.zeros(len(c), "<i8")
        place[block.number[1]] = np.arange(len(block.number[1]))
    return place[own], c[own]


def _numbers(block: Block, answers: list[dict] | None, m: int, order: int) -> np.ndarray:
    """A column for each n-gram of order m: of the longest its plain count here, of a shorter one NUMBERS from the longer ones that this block tells of."""
    if m == order:
        return block.counts(m).reshape(1, -1)
    n = len(block.keys[m])
    place, c = _told(block, answers, m + 1)
    starts = place - block.begins[block.doc[place]] < m  # its first word is a beginning
    context = block.number[m][block.before[place]]
    rows = [np.bincount(block.number[m][place], np.where(starts, c, 1), n), np.bincount(context, c, n)]
    return np.array([*rows, *[np.bincount(context[np.minimum(c, 3) == r], minlength=n) for r in (1, 2, 3)]]).astype("<i8")


def _add_up(order: int):
    """Of a shard: its part of the model, and to each block for each of its keys the count where that block is the first to have it, else 0."""

    def rows(role: str, level: int, shard: int, blocks: list[int], keys: bytes | None, data: list[bytes]) -> pa.RecordBatch:
        n = len(blocks)
        return pa.RecordBatch.from_pydict({"role": [role] * n, "level": pa.array([level] * n, pa.int32()), "shard": pa.array([shard] * n, pa.int32()), "block": pa.array(blocks, pa.int64()), "keys": pa.array([keys] * n, pa.binary()), "data": pa.array(data, pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in shard_groups(batches):
            level, shard = group["level"][0].as_py(), group["shard"][0].as_py()
            parts = [unpack(x) for x in group["keys"].to_pylist()]
            ends = np.cumsum([len(p) for p in parts])
            keys = np.concatenate(parts)
            sent = np.concatenate([unpack_ints(x).reshape(-1, len(p)) for x, p in zip(group["data"].to_pylist(), parts, strict=True)], axis=1)
            by, keys = in_order(keys)
            first = np.flatnonzero(changes(keys))
            sums = np.add.reduceat(sent[:, by], first, axis=1)
            answer = np.zeros(len(keys), "<i8")
            answer[by[first]] = sums[0]
            real = sums.any(axis=0)
            if real.any():
                numbers = np.zeros((NUMBERS, int(real.sum())), "<i8")
                numbers[: len(sums)] = sums[:, real]
                yield rows("model", level, shard, [-1], pack(keys[first][real]), [pack_ints(numbers.ravel())])
            yield rows("answer", level, shard, group["block"].to_pylist(), None, [pack_ints(answer[a:b]) for a, b in zip(np.append(0, ends[:-1]), ends, strict=True)])

    return run


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in rows_of(batches):
        yield pa.RecordBatch.from_pydict({"n": [int(unpack_ints(row["lengths"]).sum())]})


def _counted(trusted: DataFrame, order: int) -> Model:
    """The model of trusted's rows that aren't held out, which are deleted there; counted from the longest order down, without limits yet."""
    spark = trusted.sparkSession
    plain = _salted(trusted.filter("not held_out"), "text", "lang", F.lit(False).alias("mark"), F.struct(F.lit(None).cast("int").alias("none")).alias("carried"))
    columns = ["block", "marks", "lengths", "vocabulary", "tokens"]
    with rows_a_batch(spark, 1000):
        made = plain.mapInArrow(lambda batches: make_blocks(batches, BLOCK_BYTES), block_schema("struct<none:int>"))
        with bucketed(made, "kn_blocks", "block") as blocks, rows_a_batch(spark, BLOCK_ROWS):
            _delete(spark, f"{trusted.millrace_path}/held_out=false")
            bits = shard_bits(blocks.select("lengths").mapInArrow(_sizes, "n bigint").agg(F.sum("n")).first()[0] or 0, MODEL_TOKENS)

            def sending(m: int):
                def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                    for row in rows_of(batches):
                        block = Block(row)
                        numbers = _numbers(block, row.get("answers"), m, order)
                        yield sent_rows(row["block"], m, block.keys[m], block.slices(m, bits), lambda a, b: pack_ints(numbers[:, a:b].ravel()))  # noqa: B023

                return send

            def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for row in rows_of(batches):
                    block = Block(row)
                    for m in range(1, order + 1):
                        place, c = _told(block, row["answers"], m)
                        langs, lang = np.unique(block.keys[1][block.number[1][block.begins[block.doc[place]]]], return_inverse=True)
                        kinds = [np.bincount(lang[c == r], minlength=len(langs)) for r in (1, 2, 3, 4)]
                        found = [*kinds, np.bincount(lang, c, len(langs)).astype("<i8"), np.bincount(lang, minlength=len(langs))]
                        names = ["n1", "n2", "n3", "n4", "total", "kinds"]
                        yield pa.RecordBatch.from_pydict({"lang": langs.view("<i8"), "level": pa.array([m] * len(langs), pa.int32())} | dict(zip(names, found, strict=True)))

            tables: dict[int, DataFrame] = {}
            answer = lambda m: tables[m].filter("role = 'answer'").select("level", "shard", "block", "data")
            for m in range(order, 0, -1):
                source = blocks.select(*columns) if m == order else with_answers(blocks.select(*columns), answer(m + 1))
                sent = source.mapInArrow(sending(m), SENT)
                tables[m] = written(to_shards(sent).mapInArrow(_add_up(order), COUNTED), "kn-counts", partition_by="role")
                del source, sent
                release(spark)
            every = answer(1)
            for m in range(2, order + 1):
                every = every.union(answer(m))
            stats = with_answers(blocks.select(*columns), every).mapInArrow(count, STATS).groupBy("lang", "level")
            stats = stats.agg(*[F.sum(c).alias(c) for c in ("n1", "n2", "n3", "n4", "total", "kinds")]).collect()
            del every
    for table in tables.values():
        _delete(spark, f"{table.millrace_path}/role=answer")
    release(spark)
    numbers: dict[int, dict[int, tuple]] = {}
    for r in stats:
        numbers.setdefault(r.lang % (1 << 64), {})[r.level] = r
    four = lambda r: [r.n1, r.n2, r.n3, r.n4]
    languages = {k: Language([[0.0] * 3, *[kn_discounts(four(by[m])) for m in range(1, order + 1)]], by[1].total, by[1].kinds, [by[1].n1, by[1].n2, by[1].kinds - by[1].n1 - by[1].n2]) for k, by in numbers.items()}
    return Model(order, bits, tables, languages)


def _ranked(ids: DataFrame) -> DataFrame:
    """(_id, _lang, _rank) from different (_id, _lang): places in a language by hash of the id, from 1. Only ids that share a hash's first digits are sorted together."""
    ids = written(ids.withColumn("_key", F.md5(F.col("_id").cast("string"))), "trusted-ids")
    digits = max(1, math.ceil(math.log(max(1, ids.count() / RANKED), 16)))
    named = ids.withColumn("_place", F.coalesce(F.concat(F.lit("="), F.col("_lang")), F.lit(""))).withColumn("_range", F.substring("_key", 1, digits))
    cells = written(named.groupBy("_place", "_range").agg(F.count("*").alias("_cell")), "trusted-ranges")
    inside = F.row_number().over(Window.partitionBy("_place", "_range").orderBy("_key", "_id"))
    ranked = named.withColumn("_in", inside).join(offsets(cells, digits), ["_place", "_range"])
    ranked = written(ranked.select("_id", "_lang", (F.col("_offset") + F.col("_in")).alias("_rank")), "trusted-ranks")
    dropped(ids, cells)
    return ranked


def train(docs: DataFrame, labels: DataFrame, train_docs: int | None = None, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE) -> Model:
    """The models of all languages with trusted documents (quality 1).

    Null texts, null ids and labels without a document train nothing; a null
    language is one of its own. Repeated rows of an id all train. Very long
    texts train whole. With `train_docs`, only that many documents of a language
    are drawn, those that tie for the last place by id. Empty tables give a model
    that keeps everything. Other columns are never read.
    """
    good = labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("_good")).distinct()
    found = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("_lang")).filter("text is not null")
    there = found.join(good, found["_id"] == good["_good"]).select("_id", "_lang").distinct()
    ranks = _ranked(there)
    chosen = ranks if train_docs is None else ranks.filter(F.col("_rank") <= train_docs)
    chosen = chosen.select(F.col("_id").alias("_chosen"), F.col("_lang").alias("_l"), "_rank")
    trusted = found.join(small(chosen), (F.col("_id") == F.col("_chosen")) & F.col("_lang").eqNullSafe(F.col("_l")))
    trusted = written(trusted.select("text", F.col("_lang").alias("lang"), (F.col("_rank") % 5 == 0).alias("held_out")), "trusted", partition_by="held_out")
    drawn = trusted.groupBy("lang").count().collect()
    model = _counted(trusted, order)
    held = _scored(trusted.filter("held_out"), model, ["lang"], "text", "lang", waves=1)
    limits = held.filter("log10_p is not null").groupBy("lang").agg(F.expr(f"percentile_disc({float(quantile)!r}) within group (order by -log10_p / n_tokens)").alias("t")).collect()
    model.limits = {lang_key(r.lang): r.t for r in limits}
    model.unjudged = {r.lang: r["count"] for r in drawn if lang_key(r.lang) not in model.limits}
    dropped(ranks, trusted, held)
    return model


def _salted(docs: DataFrame, text_col: str, lang_col: str, *more) -> DataFrame:
    """(text, salt, ..): the salt is lang_salt() in SQL."""
    plain = F.coalesce(F.concat(F.lit("="), F.col(lang_col)), F.lit(""))
    low = [F.substring(F.md5(plain), 2 * i + 1, 2) for i in range(7, -1, -1)]  # little-endian bytes
    value = F.conv(F.concat(*low), 16, 10).cast("decimal(20,0)")
    salt = F.floor(value / 2).cast("bigint")
    return docs.select(F.col(text_col).alias("text"), salt.alias("salt"), *more)


class Scores:
    """log10 probabilities of a block's tokens from the answers to its keys."""

    def __init__(self, languages: dict[int, Language], order: int):
        self.order = order
        self.known = np.array(sorted(languages), np.uint64)
        own = [languages[int(k)] for k in self.known]
        self.discounts = np.array([[[0.0, *d] for d in x.discounts] for x in own]).reshape(-1, order + 1, 4)
        self.total = np.array([x.total for x in own], "f8")
        freed = np.array([np.dot(x.discounts[1], x.by_count) for x in own])
        self.unknown = freed / self.total / (np.array([x.kinds for x in own]) + 1) if own else freed

    def __call__(self, block: Block, numbers: list[np.ndarray | None]) -> tuple[np.ndarray, np.ndarray]:
        """(log10 probability, document) of each word and end; nan where the language has no model."""
        at = np.flatnonzero(block.real)
        doc = block.doc[at]
        out = np.full(len(at), np.nan)
        begin = block.keys[1][block.number[1][block.begins]]
        spot = np.minimum(np.searchsorted(self.known, begin), max(0, len(self.known) - 1))
        fits = self.known[spot] == begin if len(self.known) else np.zeros(len(begin), bool)
        for start in range(0, len(at), PIECE):
            piece = np.arange(start, min(len(at), start + PIECE))
            piece = piece[fits[doc[piece]]]
            out[piece] = np.log10(self._probability(block, numbers, at[piece], spot[doc[piece]]))
        return out, doc

    def _probability(self, block: Block, numbers: list[np.ndarray | None], at: np.ndarray, lang: np.ndarray) -> np.ndarray:
        c = numbers[1][0][block.number[1][at]]
        p = (c - self.discounts[lang, 1, np.minimum(c, 3)]) / self.total[lang] + self.unknown[lang]
        for m in range(2, self.order + 1):
            c = numbers[m][0][block.number[m][at]]
            total, *kinds = numbers[m - 1][1:, block.number[m - 1][block.before[at]]]
            freed = sum(self.discounts[lang, m, r] * k for r, k in enumerate(kinds, 1))
            p = np.where(total > 0, (c - self.discounts[lang, m, np.minimum(c, 3)] + freed * p) / np.maximum(total, 1), p)
        return p


def _scored(docs: DataFrame, model: Model, columns: list[str], text_col: str, lang_col: str, waves: int = WAVES) -> DataFrame:
    """The columns, n_tokens, log10_p, perplexity, threshold and kept of each row, as a stored table."""
    spark, kinds = docs.sparkSession, dict(docs.dtypes)
    carried = f"struct<{','.join(f'c{i}:{kinds[c]}' for i, c in enumerate(columns))}>"
    plain = _salted(docs, text_col, lang_col, F.lit(False).alias("mark"), F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)]).alias("carried"))
    result = ", ".join(f"c{i} {kinds[c]}" for i, c in enumerate(columns)) + ", n_tokens bigint, log10_p double, perplexity double, threshold double, kept boolean"
    limits, order = model.limits, model.order
    scores = Scores(model.languages, order)
    tables = []

    def lookup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in shard_groups(batches):
            level, shard = group["level"][0].as_py(), group["shard"][0].as_py()
            held, numbers, n = np.zeros(0, np.uint64), None, 1 if level == order else NUMBERS
            blocks, answers = [], []
            for block, keys, data in zip(group["block"].to_pylist(), group["keys"], group["data"], strict=True):
                keys = unpack(keys.as_py())
                if block < 0:
                    held, numbers = keys, unpack_ints(data.as_py()).reshape(NUMBERS, -1)[:n]
                    continue
                found = np.zeros((n, len(keys)), "<i8")
                if len(held):
                    spot = np.minimum(np.searchsorted(held, keys), len(held) - 1)
                    hit = held[spot] == keys
                    found[:, hit] = numbers[:, spot[hit]]
                blocks.append(block)
                answers.append(pack_ints(found.ravel()))
            yield pa.RecordBatch.from_pydict({"level": pa.array([level] * len(blocks), pa.int32()), "shard": pa.array([shard] * len(blocks), pa.int32()), "block": pa.array(blocks, pa.int64()), "data": pa.array(answers, pa.binary())})

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches, ("carried",)):
            block = Block(row)
            numbers = [None]
            for m in range(1, order + 1):
                own = sorted((a for a in row["answers"] if a["level"] == m), key=lambda a: a["shard"])
                numbers.append(np.concatenate([unpack_ints(a["data"]).reshape(1 if m == order else NUMBERS, -1) for a in own], axis=1))
            score, doc = scores(block, numbers)
            docs = len(block.marks)
            total, n = np.bincount(doc, score, docs), np.bincount(doc, minlength=docs)
            limit = np.array([limits.get(int(k), np.nan) for k in block.keys[1][block.number[1][block.begins]]])
            real = lambda v: pa.array(v, pa.float64(), mask=np.isnan(v))
            measured = [pa.array(n), real(total), real(10 ** np.minimum(300, -total / n)), real(10 ** np.minimum(300, limit)), pa.array(~(-total / n > limit))]
            yield pa.RecordBatch.from_arrays([*row["carried"].values.flatten(), *measured], [*[f"c{i}" for i in range(len(columns))], "n_tokens", "log10_p", "perplexity", "threshold", "kept"])

    for wave in range(waves):
        rows = plain if waves == 1 else plain.filter(F.pmod(F.xxhash64("text", "carried", F.lit(3)), F.lit(waves)) == wave)
        with rows_a_batch(spark, 1000):
            made = rows.mapInArrow(lambda batches: make_blocks(batches, BLOCK_BYTES), block_schema(carried))
            with bucketed(made, "kn_blocks", "block") as blocks:
                tokens = blocks.agg(F.sum(F.octet_length("tokens"))).first()[0] or 0
                bits = max(model.bits, shard_bits(tokens // 2))

                def sending(levels: list[int]):
                    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                        for row in rows_of(batches):
                            block = Block(row)
                            for m in levels:
                                yield sent_rows(row["block"], m, block.keys[m], block.slices(m, bits), lambda a, b: None)  # noqa: B023

                    return send

                def recut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                    for row in rows_of(batches):
                        keys, numbers = unpack(row["keys"]), unpack_ints(row["data"]).reshape(NUMBERS, -1)
                        edge = np.searchsorted(keys >> np.uint64(64 - bits), np.arange(row["shard"] << (bits - model_bits), ((row["shard"] + 1) << (bits - model_bits)) + 1, dtype=np.uint64))  # noqa: B023
                        cut = [((row["shard"] << (bits - model_bits)) + s, int(a), int(b)) for s, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if b > a]  # noqa: B023
                        yield sent_rows(-1, row["level"], keys, cut, lambda a, b: pack_ints(numbers[:, a:b].ravel()))  # noqa: B023

                model_bits = model.bits
                answers = []
                with rows_a_batch(spark, BLOCK_ROWS):
                    for levels in ([*range(1, order)], [order]):
                        both = blocks.select("block", "marks", "lengths", "vocabulary", "tokens").mapInArrow(sending(levels), SENT)
                        for m in levels:
                            part = model.tables[m].filter("role = 'model'").select("level", "shard", "block", "keys", "data")
                            both = both.union(part if bits == model_bits else part.mapInArrow(recut, SENT))
                        answers.append(written(to_shards(both).mapInArrow(lookup, ANSWER), "kn-answers"))
                        del both
                        release(spark)
                    tables.append(written(with_answers(blocks, answers[0].union(answers[1])).mapInArrow(evaluate, result), "kn-scores"))
                dropped(*answers)
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    out = out.withColumnsRenamed({f"c{i}": c for i, c in enumerate(columns)})
    if len(tables) == 1:
        out.millrace_path = tables[0].millrace_path
    return out


def judge(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, lang, n_tokens, log10_p, perplexity, threshold, kept), a row for each row.

    Null text: as empty, judged on its end token. A language without trusted
    text, null included unless trained: null scores, kept. A perplexity equal to
    the threshold is kept. Very long texts are judged whole, by one task.
    Repeats get equal rows; an empty table gives none. Other columns are never
    read, so their names can't clash.
    """
    return _scored(docs, model, list(dict.fromkeys([id_col, lang_col])), text_col, lang_col)


def accepted(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows that judge() keeps, with all their columns.

    A verdict depends on language and text alone, so the rejected ones' hashes
    tell which rows go, whatever their ids. Nulls, repeats, empty and very long
    texts: as in judge(). Extra columns of any name are carried.
    """
    hashed = F.concat(*[F.md5(F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit(""))) for c in (lang_col, text_col)])
    lean = docs.select(hashed.alias("h"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    name = fresh("rejected", docs.columns)
    gone = written(_scored(lean, model, ["h"], "text", "lang").filter("not kept").select(F.col("h").alias(name)).distinct(), "rejected")
    return docs.join(small(gone), hashed == F.col(name), "left_anti")
