"""Near-duplicate documents by Order MinHash and banded alignment.

A document is its sequence of words. Its k-mers (three words) are labelled with
their occurrence number, so a repeated k-mer counts as often as it occurs. Each
sketch takes the `picked` smallest k-mers under its own hash and keeps them in
text order; two documents agree on a sketch more often the smaller the edit
distance is, since both content and order must agree.

A pair of k-mers agrees with about the square of the k-mer similarity. At an
edit similarity of 0.8, with changes at random, that similarity is 0.34, and one
of 80 sketches agrees with probability 0.9999. Few words have few k-mers:
texts up to SHORT words take pairs of words instead, of which an edit ends two
at most, and texts so short that the threshold allows one edit have a key for
each word left out, which finds all their pairs.

Documents that agree on a sketch are candidates. A candidate pair links if its
edit similarity, 1 - distance / longer length over words, is `threshold` or
more, which a banded alignment decides: the band is as wide as the distance
that the threshold allows, so nothing outside it could pass.

Most alignments are spared:
1. Equal texts are one class from the start.
2. Each document is aligned with the least document of the bucket that it
   shares most often; a group of thousands of near copies costs one alignment
   each. Links make components.
3. Buckets with the same least document are one group, so that a document comes
   once into it, however many of them it is in; each pair of a bucket is one of
   that bucket's group. All pairs of a group that are still in different
   components, and whose lengths allow the threshold, are compared by their word
   counts in BINS bins. These bound the words in common from above, so that no
   pair which the threshold allows is lost. A passage that many documents share
   fills groups with unlike ones, which the counts tell apart without making a
   row for each pair. In ROUNDS rounds each document is aligned with just the one that it is
   nearest to by counts, and links make components, so that a large group is one
   before the last round aligns every pair that is still open. Of groups with
   the same members one is read, and later rounds read only members for which a
   round found a pair that the counts allow: links never add to those.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import chunks, components, dropped, groups, partitions, small, written
from millrace.llm.tokens import mix, words

K, PICKED, SKETCHES, THRESHOLD = 3, 2, 80, 0.8
#: Texts of up to this many words are sketched by pairs of words.
SHORT = 40
BATCH_BYTES = 2 << 20
#: K-mers, or those of one longer document, that are sketched at a time.
BLOCK = 1 << 16
#: Bins of the word counts that rule out pairs of a group, and how many of them are first compared as one.
BINS, FOLD = 1024, 4
#: Members of a group above which its pairs are dealt out in blocks, and the most blocks: each member goes to as many tasks at most, however large its group is.
COMMON, SPREAD = 4096, 16
#: Rounds in which each document is aligned with its nearest one of another component, before all pairs that are left.
ROUNDS = 2
#: Members that share one copy of their pivot's words.
GROUP = 64


def kmers(hashes: np.ndarray, offsets: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """(occurrence-labelled k-mer hashes, offsets by document). A document shorter than k has one k-mer, of all its words."""
    n = np.diff(offsets)
    count = np.where(n == 0, 0, np.maximum(1, n - k + 1))
    bounds = np.concatenate([[0], np.cumsum(count)]).astype("<i8")
    doc = np.repeat(np.arange(len(n)), count)
    first = offsets[:-1][doc] + np.arange(bounds[-1]) - bounds[:-1][doc]
    code = np.zeros(bounds[-1], np.uint64)
    for i in range(k):
        at = first + i
        there = at < offsets[1:][doc]
        code = np.where(there, mix(code * np.uint64(3) + hashes[np.minimum(at, max(0, len(hashes) - 1))]) if len(hashes) else code, code)
    # Only k-mers that may occur again in their document are ordered: by bits of those hashes that a sort finds twice.
    spot = mix(code ^ mix(np.arange(len(n), dtype=np.uint64))[doc])
    ordered = np.sort(spot)
    marks = np.zeros(1 << 20, bool)
    marks[(ordered[1:][ordered[1:] == ordered[:-1]] >> np.uint64(44)).astype("<i8")] = True
    again = np.flatnonzero(marks[(spot >> np.uint64(44)).astype("<i8")])
    again = again[np.argsort(spot[again], kind="stable")]
    same = np.zeros(len(again), bool)
    same[1:] = (code[again][1:] == code[again][:-1]) & (doc[again][1:] == doc[again][:-1])
    run = np.arange(len(again))
    code[again] += (run - np.maximum.accumulate(np.where(same, 0, run))).astype(np.uint64) * np.uint64(0xD1342543DE82EF95)
    return mix(code), bounds


def sketch(codes: np.ndarray, bounds: np.ndarray, sketches: int = SKETCHES, picked: int = PICKED, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(documents with k-mers, a row of sketch values for each). K-mers are ordered by 32-bit hashes of the lower half of their codes, equal ones by place."""
    has = np.flatnonzero(np.diff(bounds) > 0)
    starts, sizes = bounds[:-1][has], np.diff(bounds)[has]
    if not len(has):
        return has, np.zeros((0, sketches), np.uint64)
    seeds = mix(np.arange(1, sketches + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    flips, factors = seeds.astype(np.uint32), (seeds >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    top = np.iinfo(np.uint64).max
    places = np.full((sketches, len(has), picked), np.iinfo("<i8").max)
    # Some documents at a time, whose hashes fit into a core's cache.
    cuts = np.flatnonzero(np.diff(starts // BLOCK)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(has)], strict=True):
        first, last = starts[a], starts[b - 1] + sizes[b - 1]
        low, at = codes[first:last].astype(np.uint32), starts[a:b] - first
        value, shifted = np.empty_like(low), np.empty_like(low)
        # The hash in the upper half, the place in the lower.
        packed = np.arange(len(low), dtype="<u8")
        upper = packed.view("<u4")[1::2]
        rounds = min(picked, int(sizes[a:b].max()))
        for j in range(sketches):
            np.bitwise_xor(low, flips[j], out=value)
            np.multiply(value, factors[j], out=value)
            np.right_shift(value, np.uint32(16), out=shifted)
            np.bitwise_xor(value, shifted, out=value)
            np.multiply(value, np.uint32(0x846CA68B), out=value)
            upper[:] = value
            taken = []
            for p in range(rounds):
                least = np.minimum.reduceat(packed, at)
                there = least != top
                place = (least[there] & np.uint64(0xFFFFFFFF)).astype("<i8")
                places[j, a:b, p][there] = place + first
                packed[place] = top
                taken.append(place)
            for place in taken:
                packed[place] = place.astype(np.uint64)
    places.sort(axis=2)  # text order
    out = np.zeros((sketches, len(has)), np.uint64)
    for p in range(picked):
        held = places[:, :, p] < len(codes)
        out = np.where(held, mix(out * np.uint64(5) + codes[np.where(held, places[:, :, p], 0)]), out)
    return has, np.ascontiguousarray(out.T)


def banded_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Edit distance of two word sequences if it is `most` or less, else most + 1.

    The band of the alignment matrix around its diagonal is one integer's bits
    (Hyyrö 2003): a bit tells whether going down a row adds one. Each column
    moves the band down by one, and the distance is followed along the lower
    edge, then up the last column.
    """
    n = min(len(a), len(b))
    if abs(len(a) - len(b)) > most:
        return most + 1
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    if n:
        differ = np.flatnonzero(a[::-1][:n] != b[::-1][:n])
        tail = int(differ[0]) if len(differ) else n
        a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        return len(a) + len(b) if len(a) + len(b) <= most else most + 1
    if len(a) < len(b):
        a, b = b, a
    m, n = len(a), len(b)
    rows: dict[int, int] = {}
    for i, word in enumerate(a.tolist()):
        rows[word] = rows.get(word, 0) | 1 << i
    # In column j, bits 0..width-1 stand for rows j - most .. j + most; before it, column 0 has only additions below row 0.
    width = 2 * most + 1
    mask = (1 << width) - 1
    plus, minus = (mask >> most) << most, 0
    # The value at the band's lower edge of column 0, row `most`.
    edge = most
    top_bit = 1 << (width - 1)
    for j, word in enumerate(b.tolist(), 1):
        held = rows.get(word, 0)
        low = j - most - 1
        match = (held >> low if low >= 0 else held << -low) & mask
        # Rows above the first are walls that never match.
        zero = (((match & plus) + plus) ^ plus) | match | minus
        zero &= mask
        across_plus = (minus | ~(zero | plus)) & mask
        across_minus = zero & plus
        if not zero & top_bit:
            edge += 1
        down = zero >> 1
        plus = (across_minus | ~(down | across_plus)) & mask
        minus = across_plus & down
    # From row n + most of the last column up to row m.
    for i in range(n + most, m, -1):
        bit = 1 << (i - n - 1 + most)
        if plus & bit:
            edge -= 1
        elif minus & bit:
            edge += 1
    return edge if edge <= most else most + 1


def within(a: np.ndarray, b: np.ndarray, most: int) -> bool:
    """Whether the edit distance is `most` or less.

    A bound from above may spare the alignment: words side by side from the start
    up to some place, and from the end after it, with the longer one's rest between.
    """
    n, gap = min(len(a), len(b)), abs(len(a) - len(b))
    if gap > most:
        return False
    left, right = np.zeros(n + 1, "<i8"), np.zeros(n + 1, "<i8")
    np.cumsum(a[:n] != b[:n], out=left[1:])
    np.cumsum(a[::-1][:n] != b[::-1][:n], out=right[1:])
    return gap + int((left + right[::-1]).min()) <= most or banded_distance(a, b, most) <= most


def similar(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> bool:
    """Whether the edit similarity is the threshold or more. Both empty: alike."""
    longer = max(len(a), len(b))
    most = int((1 - threshold) * longer + 1e-9)
    if abs(len(a) - len(b)) > most:
        return False
    if longer <= 5000 or most < 64:
        common = sum((Counter(a.tolist()) & Counter(b.tolist())).values())
        if longer - common > most:  # the words that one lacks must each be edited
            return False
    return within(a, b, most)


def _tags(family: int, n: int) -> np.ndarray:
    return mix(np.arange(n, dtype=np.uint64) + np.uint64(family << 32))


def _only(hashes: np.ndarray, offsets: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words with all documents but the chosen ones emptied."""
    n = np.diff(offsets)
    return hashes[np.repeat(chosen, n)], np.concatenate([[0], np.cumsum(np.where(chosen, n, 0))]).astype("<i8")


def one_edit(threshold: float) -> int:
    """The most words, up to SHORT, for which the threshold allows one edit at most."""
    return max(n for n in range(SHORT + 1) if int((1 - threshold) * n + 1e-9) <= 1)


def left_out(hashes: np.ndarray) -> np.ndarray:
    """Keys of a word sequence, whole and with each word left out. Sequences at most one edit apart share one."""
    n = len(hashes)
    keys = []
    for skip in range(n + 1):
        key = np.zeros(1, np.uint64)
        for word in np.delete(hashes, skip) if skip < n else hashes:
            key = mix(key * np.uint64(5) + word)
        keys.append(key[0])
    return np.unique(np.array(keys, np.uint64))


def families(n: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By numbers of words: who has sketches of k-mers, of pairs of words, and keys with words left out. Two texts whose lengths allow the threshold have one in common at least."""
    tiny = one_edit(threshold)
    least = lambda longest: threshold * (longest + 1) - 1e-9  # words that the other text of a longer one has
    return n >= least(SHORT), (n <= SHORT) & (n >= least(tiny)), (n > 0) & (n <= tiny)


def bucket_keys(hashes: np.ndarray, offsets: np.ndarray, threshold: float = THRESHOLD, k: int = K, picked: int = PICKED, n_sketches: int = SKETCHES) -> list[np.ndarray]:
    """Each document's bucket keys: n_sketches for each of the first two families that it belongs to, in order, then those of the third."""
    n = np.diff(offsets)
    long, short, tiny = families(n, threshold)
    out: list[list[np.ndarray]] = [[] for _ in n]
    for family, size, chosen in ((1, k, long), (2, min(2, k), short)):
        has, rows = sketch(*kmers(*_only(hashes, offsets, chosen), size), n_sketches, picked)
        for i, row in zip(has, mix(rows ^ _tags(family, n_sketches)), strict=True):
            out[i].append(row)
    for i in np.flatnonzero(tiny):
        out[i].append(mix(left_out(hashes[offsets[i] : offsets[i + 1]]) ^ _tags(3, 1)))
    return [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in out]


def word_counts(hashes: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """For each document its words by bin, 255 at most, a byte each."""
    out = []
    for at in range(0, len(offsets) - 1, 512):
        bounds = offsets[at : at + 513]
        docs = len(bounds) - 1
        cell = np.repeat(np.arange(docs), np.diff(bounds)) * BINS + (hashes[bounds[0] : bounds[-1]] % np.uint64(BINS)).astype("<i8")
        rows = np.minimum(np.bincount(cell, minlength=docs * BINS), 255).astype(np.uint8).reshape(docs, BINS)
        out += [x.tobytes() for x in rows]
    return out


def sketches(docs: DataFrame, id_col: str, text_col: str, threshold: float, k: int, picked: int, n_sketches: int) -> DataFrame:
    """(id, h, n, keys, bins): hash of the text, number of words, bucket keys, word counts; the one pass that reads all texts for hashing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches if whole.num_rows for part in chunks(whole, 1, BATCH_BYTES)):
            hashes, offsets = words(batch.column(1), lower=False)
            keys = [x.view("<i8") for x in bucket_keys(hashes, offsets, threshold, k, picked, n_sketches)]
            bins = pa.array(word_counts(hashes, offsets), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.diff(offsets)), pa.array(keys, pa.list_(pa.int64())), bins], ["id", "h", "n", "keys", "bins"])

    plain = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), F.md5(text_col).alias("h")).filter("id is not null and text is not null")
    return written(plain.mapInArrow(run, "id bigint, h string, n bigint, keys array<bigint>, bins binary"), "sketches")


def beside(docs: DataFrame, pairs: DataFrame, id_col: str, text_col: str, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """Texts dealt so that each b meets its a's: (b, g, role, doc, text), role 0 for b itself, at most `group` a's or so in a (b, g).

    Those are one task's unit of work; a text travels once for each of them.
    """
    counts = pairs.groupBy("b").agg(F.ceil(F.count("*") / group).alias("c"))
    pairs = written(pairs.join(counts, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("c")).alias("g")), "dealt-pairs")
    needed = pairs.select(F.col("a").alias("doc"), "b", "g", F.lit(1).alias("role")).union(pairs.select(F.col("b").alias("doc"), "b", "g", F.lit(0).alias("role")).distinct())
    needed = written(needed, "needed")
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text")).filter("text is not null")
    dealt = texts.join(small(needed), "doc").select("b", "g", "role", "doc", "text")
    return dealt.repartition(partitions(docs.sparkSession), "b", "g").sortWithinPartitions("b", "g", "role", "doc"), needed


def verified(docs: DataFrame, pairs: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts' edit similarity is the threshold or more."""
    dealt, needed = beside(docs, pairs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches, ["b", "g"]):
            ids, role = rows["doc"].to_numpy(), rows["role"].to_numpy()
            hashes, offsets = words(rows["text"].combine_chunks(), lower=False)
            n = np.diff(offsets)
            labelled, _ = kmers(hashes, offsets, 1)
            good: set[int] = set()
            for p in np.flatnonzero(role == 0):
                # Words that one text lacks must each be edited, so too few in common rule a pair out.
                shared = np.concatenate([[0], np.cumsum(np.isin(labelled, labelled[offsets[p] : offsets[p + 1]]))])
                shared = shared[offsets[1:]] - shared[offsets[:-1]]
                longer = np.maximum(n, n[p])
                most = ((1 - threshold) * longer + 1e-9).astype("<i8")
                for i in np.flatnonzero((role == 1) & (longer - shared <= most)):
                    if within(hashes[offsets[i] : offsets[i + 1]], hashes[offsets[p] : offsets[p + 1]], int(most[i])):
                        good.add(int(ids[i]))
            if good:
                yield pa.RecordBatch.from_pydict({"a": np.array(sorted(good), "<i8"), "b": np.full(len(good), rows["b"][0].as_py(), "<i8")})

    links = written(dealt.mapInArrow(run, "a bigint, b bigint"), "links")
    dropped(needed)
    return links


def in_blocks(rows: DataFrame) -> DataFrame:
    """The rows of groups for each pair of blocks (i, j) that they belong to: c times each."""
    part = F.pmod(F.xxhash64("id"), F.col("c"))
    dealt = rows.select("*", part.alias("part"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("c") - 1)).alias("q"))
    return dealt.withColumns({"i": F.least("part", "q"), "j": F.greatest("part", "q")}).drop("c", "q")


def open_buckets(labelled: DataFrame) -> DataFrame:
    """(key, c) of the groups of (key, id, label) with several labels, and the blocks to deal them to; of those with the same members that with the least key."""
    members = [F.bit_xor(F.xxhash64("id", F.lit(seed))).alias(f"s{seed}") for seed in (1, 2)]
    mixed = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size"), *members).filter("low < high")
    return mixed.groupBy("s1", "s2", "size").agg(F.min("key").alias("key")).select("key", F.least(F.ceil(F.col("size") / COMMON), F.lit(SPREAD)).cast("bigint").alias("c"))


def candidates(rows: DataFrame, threshold: float, nearest: bool = False) -> DataFrame:
    """(key, n, a, b, score): the pairs of members of a group that differ in label and may reach the threshold by lengths and word counts; with `nearest` one for each member a of n words, that whose counts are nearest.

    rows has key, id, n, label, bins, and c, the blocks that the group's members
    are dealt to; each pair of blocks is a unit of work. Without `nearest` it has
    the id's pivots as well, which are the keys of all its groups: a pair that
    meets in several is told of in that of the least key.
    """
    dealt = in_blocks(rows)

    def passing(t: pa.Table) -> pa.RecordBatch:
        group = np.column_stack([t[c].to_numpy() for c in ("key", "i", "j")])
        part, n, ids, label = (t[c].to_numpy() for c in ("part", "n", "id", "label"))
        fine = np.frombuffer(b"".join(t["bins"].to_pylist()), np.uint8).reshape(-1, BINS)
        key = group[:, 0]
        lesser = [] if nearest else [{p for p in pivots if p < k} for pivots, k in zip(t["pivots"].to_pylist(), key.tolist(), strict=True)]
        coarse = fine.reshape(-1, FOLD, BINS // FOLD).sum(axis=1, dtype=np.uint16)
        new = np.ones(len(n), bool)
        new[1:] = np.any(group[1:] != group[:-1], axis=1)
        run = np.cumsum(new)
        best, other = np.full(len(n), np.inf), np.zeros(len(n), "<i8")
        # Rows of a group go by length: each is compared with the one s places on, until the lengths part.
        left, found, s = np.arange(len(n)), [np.zeros((0, 2), "<i8")], 0
        while len(left):
            s += 1
            left = left[left + s < len(n)]
            right = left + s
            go = (run[left] == run[right]) & (n[left] >= n[right] * threshold - 1e-9)
            left, right = left[go], right[go]
            test = (label[left] != label[right]) & ((group[left, 1] == group[left, 2]) | (part[left] != part[right]))
            x, y = left[test], right[test]
            for start in range(0, len(x), 8192):
                u, v = x[start : start + 8192], y[start : start + 8192]
                # Words in common: (n + n - apart) / 2 at most; the threshold needs the longer length less its edits.
                most = n[u] + n[v] - 2 * (n[v] - ((1 - threshold) * n[v] + 1e-9).astype("<i8"))
                for bins in (coarse, fine):
                    apart = (np.maximum(bins[u], bins[v]) - np.minimum(bins[u], bins[v])).sum(axis=1, dtype="<i8")
                    good = apart <= most
                    u, v, apart, most = u[good], v[good], apart[good], most[good]
                if not nearest:
                    good = np.array([lesser[p].isdisjoint(lesser[q]) for p, q in zip(u.tolist(), v.tolist(), strict=True)], bool)
                    found.append(np.column_stack([ids[u[good]], ids[v[good]]]))
                    continue
                score = apart / n[v]
                for p, q in ((u, v), (v, u)):
                    nearer = score < best[p]
                    best[p[nearer]], other[p[nearer]] = score[nearer], ids[q[nearer]]
        if nearest:
            has = np.isfinite(best)
            return pa.RecordBatch.from_pydict({"key": key[has], "n": n[has], "a": ids[has], "b": other[has], "score": best[has]})
        pairs = np.unique(np.sort(np.concatenate(found), axis=1), axis=0)
        none = pa.nulls(len(pairs), pa.int64())
        return pa.RecordBatch.from_pydict({"key": none, "n": none, "a": pairs[:, 1].copy(), "b": pairs[:, 0].copy(), "score": np.zeros(len(pairs))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.concat_tables([*([held] if held is not None else []), pa.Table.from_batches([batch])])
            # The last group may go on in the next batch.
            group = np.column_stack([t[c].to_numpy() for c in ("key", "i", "j")])
            other = np.flatnonzero(np.any(group != group[-1], axis=1))
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield passing(t.slice(0, cut))
            held = t.slice(cut)
        if held is not None:
            yield passing(held)

    dealt = dealt.repartition(partitions(rows.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j", "n")
    return dealt.mapInArrow(run, "key bigint, n bigint, a bigint, b bigint, score double")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, k: int = K, picked: int = PICKED, n_sketches: int = SKETCHES) -> DataFrame:
    """(doc_id, class_id, kept), a row for each document; class_id is the least id of its class, and that one is kept.

    Null text: alone in its class, kept. A text without words links with equal texts only. Rows
    that share an id are one document, with one row here. A null id: one row,
    class null, kept. Other columns are never read. An empty table gives no rows.
    """
    sk = sketches(docs, id_col, text_col, threshold, k, picked, n_sketches)
    # Stored, so that both sides of the joins by text are plain exchanges, which AQE splits where many rows share a text.
    classes = written(sk.groupBy("h").agg(F.min("id").alias("rep")), "classes")
    members = written(sk.select("id", "h").join(classes, "h").groupBy("id").agg(F.min("rep").alias("rep")), "members")
    reps = sk.join(classes.select("h", F.col("rep").alias("id")), ["h", "id"], "left_semi").groupBy("id").agg(F.min(F.struct("h", "n", "keys", "bins")).alias("s"))
    reps = written(reps.select("id", "s.n", "s.keys", "s.bins"), "reps")
    dropped(sk, classes)
    # One exchange by key serves the groups and the join.
    rows = reps.select(F.explode("keys").alias("key"), "id", "n").repartition("key")
    heads = rows.groupBy("key").agg(F.min(F.struct("id", "n")).alias("head"), F.count("*").alias("size")).filter("size > 1")
    # A row for each document and each pivot that it shares buckets with, the pivot among them.
    shared = rows.join(heads.select("key", F.col("head.id").alias("pivot"), F.col("head.n").alias("pivot_n")), "key")
    met = written(shared.groupBy("pivot", "id").agg(F.min("n").alias("n"), F.min("pivot_n").alias("pivot_n"), F.count("*").alias("votes")), "met")

    fits = lambda m, n: F.least(m, n) >= F.greatest(m, n) * F.lit(threshold) - F.lit(1e-9)
    votes = met.filter((F.col("id") != F.col("pivot")) & fits(F.col("n"), F.col("pivot_n")))
    first = written(votes.groupBy("id").agg(F.max(F.struct("votes", (-F.col("pivot")).alias("p"))).alias("best")).select(F.col("id").alias("a"), (-F.col("best.p")).alias("b")), "first-pairs")
    links = verified(docs, first, id_col, text_col, threshold)
    tried = first.select("a", "b")
    reached = written(components(links), "components")
    open_rows = met.select(F.col("pivot").alias("key"), "id", "n")
    for step in range(ROUNDS + 1):
        labels = small(reached.withColumnRenamed("node", "id"))
        labelled = open_rows.select("key", "id", "n").join(labels, "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component")
        here = labelled.join(small(written(open_buckets(labelled), "open-keys")), "key")
        if step == ROUNDS:
            here = here.join(met.groupBy("id").agg(F.collect_list("pivot").alias("pivots")), "id")
        told = written(candidates(here.join(reps.select("id", "bins"), "id"), threshold, step < ROUNDS), "told")
        if step < ROUNDS:
            # Labels only merge: a member without a pair here has none in a later round either.
            open_rows = told.select("key", F.col("a").alias("id"), "n").distinct()
            told = told.groupBy("a").agg(F.min(F.struct("score", "b")).alias("s")).select("a", "s.b")
        near = told.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        rest = written(near.join(tried, ["a", "b"], "left_anti"), "rest")
        if rest.limit(1).count():
            more = verified(docs, rest, id_col, text_col, threshold)
            tried = tried.union(rest)
            if more.limit(1).count():
                links = links.union(more)
                reached = written(components(links), "components")

    found = members.join(reached.withColumnRenamed("node", "rep"), "rep", "left").select("id", F.coalesce("component", "rep").alias("class_id"))
    ids = docs.select(F.col(id_col).cast("bigint").alias("doc_id")).distinct()
    full = ids.join(found, ids["doc_id"] == found["id"], "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    return full.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))
