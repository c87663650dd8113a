"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

encode: a score-ordered agenda of adjacent symbol pairs. All pairs whose join
is a piece wait on a heap, best score first, then leftmost. The top pair is
merged if both its symbols are still what they were, and the pairs that the
merge makes join the agenda. Characters that end up in no piece fall back to
their bytes.

A piece of the vocabulary that has the space mark anywhere but in its leading
run would let merges cross words. load() looks for such a piece; where there is
none (or none that allows a cut), no merge crosses from a non-mark to a mark, so
the stretches `mark+ rest` are independent, and the agenda runs once for each
distinct stretch: results are kept in a cache of bounded size. Where there is
such a piece the agenda runs over the whole text.

Each Arrow batch's new stretches are checked against the sentencepiece library,
and a column tells of any text that holds a stretch on which they differ.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.common import FORGET, chunks

MARK = "▁"
#: Stretches that a worker keeps in each of two turns; a stretch that a turn doesn't use goes.
CACHE = 200_000
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class Vocabulary:
    """What encoding and decoding need of a model file; read on the executor, once for each worker."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        pieces = [lib.id_to_piece(i) for i in range(n)]
        if any(lib.is_unused(i) for i in range(n)):
            raise ValueError("unused pieces are not supported")
        special = [lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) for i in range(n)]
        self.bos, self.eos, self.unk = lib.bos_id(), lib.eos_id(), lib.unk_id()
        self.ids = {p: i for i, p in enumerate(pieces) if not special[i]}
        scores = sorted({lib.get_score(i) for i in self.ids.values()}, reverse=True)
        level = {s: k for k, s in enumerate(scores)}
        self.rank = {p: level[lib.get_score(i)] for p, i in self.ids.items()}
        byte_ids = {int(pieces[i][3:5], 16): i for i in range(n) if lib.is_byte(i)}
        self.bytes = [byte_ids[b] for b in range(256)] if len(byte_ids) == 256 else None
        self.is_byte = np.array([lib.is_byte(i) for i in range(n)])
        self.text = [b"" if lib.is_control(i) else " ⁇ ".encode() if lib.is_unknown(i) else bytes([int(pieces[i][3:5], 16)]) if lib.is_byte(i) else pieces[i].replace(MARK, " ").encode() for i in range(n)]
        self.marked = np.array([p.startswith(MARK) and not x for p, x in zip(pieces, special, strict=True)])
        self.cuts = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids)
        self.stretch = re.compile(f"{MARK}+[^{MARK}]*") if self.cuts else re.compile("(?s).+")
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.wrong: set[str] = set()

    def agenda(self, text: str) -> list[int]:
        """The ids of a normalised text, by the agenda of adjacent pairs."""
        rank, symbols = self.rank, list(text)
        n = len(symbols)
        prev, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []
        for i in range(n - 1):
            joined = symbols[i] + symbols[i + 1]
            if (r := rank.get(joined)) is not None:
                heap.append((r, i, i + 1, joined))
        heapify(heap)
        while heap:
            _, left, right, joined = heappop(heap)
            a, b = symbols[left], symbols[right]
            if not a or not b or after[left] != right or len(a) + len(b) != len(joined):
                continue  # one of the two was merged meanwhile
            symbols[left], symbols[right] = joined, ""
            following = after[left] = after[right]
            if following < n:
                prev[following] = left
                wide = joined + symbols[following]
                if (r := rank.get(wide)) is not None:
                    heappush(heap, (r, left, following, wide))
            if (before := prev[left]) >= 0:
                wide = symbols[before] + joined
                if (r := rank.get(wide)) is not None:
                    heappush(heap, (r, before, left, wide))
        ids, out = self.ids, []
        for s in symbols:
            if s:
                if (i := ids.get(s)) is not None:
                    out.append(i)
                elif self.bytes:
                    out.extend(self.bytes[b] for b in s.encode())
                else:
                    out.append(self.unk)
        return out

    def encode(self, texts: list[str], check: bool = True) -> tuple[list[np.ndarray], list[bool]]:
        """For each text its ids with begin and end, and whether the library agrees on all of its stretches."""
        split = [self.stretch.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        new = {s for parts in split for s in parts if s not in self.cache}
        if len(self.cache) + len(new) > CACHE:
            # What was used since the last change stays one turn longer.
            self.old, self.cache = self.cache, {}
            self.wrong &= self.old.keys()
            new = {s for parts in split for s in parts}
        cache, old = self.cache, self.old
        cache.update((s, old[s]) for s in new if s in old)
        new = [s for s in new if s not in old]
        for at in range(0, len(new), 10_000):
            chunk = new[at : at + 10_000]
            own = [self.agenda(s) for s in chunk]
            if check:
                # The library puts the first mark in front by itself.
                theirs = self.library.encode([s[1:].replace(MARK, " ") for s in chunk], num_threads=1)
                self.wrong.update(s for s, a, b in zip(chunk, own, theirs, strict=True) if a != b and s != MARK)
            cache.update((s, np.array(a, "<u4").tobytes()) for s, a in zip(chunk, own, strict=True))
        begin, end, get = np.uint32(self.bos).tobytes(), np.uint32(self.eos).tobytes(), cache.__getitem__
        ids = [np.frombuffer(b"".join([begin, *map(get, parts), end]), "<u4") for parts in split]
        agrees = [not self.wrong or self.wrong.isdisjoint(parts) for parts in split]
        return ids, agrees

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: controls vanish, the first piece loses one leading space, bytes join into characters."""
        out = b"".join(map(self.text.__getitem__, ids.tolist()))
        strip = bool(self.marked[next((i for i in ids if self.text[i]), self.bos)])
        out = out[strip:]
        try:
            return out.decode()
        except UnicodeDecodeError:
            return self._decode_broken(ids, strip)

    def _decode_broken(self, ids: np.ndarray, strip: bool) -> str:
        """Byte runs that are no UTF-8: each stray byte becomes a replacement character, as in the library."""
        out, run = [], b""

        def flush(run: bytes) -> None:
            while run:
                for n in (1, 2, 3, 4):
                    try:
                        out.append(run[:n].decode())
                        run = run[n:]
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    run = run[1:]

        for i in ids.tolist():
            if self.is_byte[i]:
                run += self.text[i]
            else:
                flush(run)
                run = b""
                out.append(self.text[i].decode())
        flush(run)
        return "".join(out)[strip:]


_loaded: dict[str, Vocabulary] = {}
FORGET.append(_loaded.clear)


def load(path: str) -> Vocabulary:
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


RESULT = "ids array<int>, decoded string, matches_library boolean"
DIGEST = "n_tokens bigint, ids_sha256 string, decoded_sha256 string, matches_library boolean"
#: Text that is worked on at once; a longer text is worked on alone.
BATCH_BYTES = 1 << 20


def _run(path: str, digest: bool, check: bool):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load(path)
        for batch in (part for whole in batches if whole.num_rows for part in chunks(whole, 1, BATCH_BYTES)):
            ids, agrees = vocabulary.encode([t or "" for t in batch.column(1).to_pylist()], check)
            decoded = [vocabulary.decode(x) for x in ids]
            if digest:
                columns = {"n_tokens": pa.array([len(x) for x in ids], pa.int64()), "ids_sha256": [hashlib.sha256(x.tobytes()).hexdigest() for x in ids], "decoded_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in decoded]}
            else:
                columns = {"ids": pa.array([x.astype("<i4") for x in ids], pa.list_(pa.int32())), "decoded": decoded}
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), **columns, "matches_library": agrees})

    return encode


def tokenize(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, check: bool = True) -> DataFrame:
    """(id, ids, decoded, matches_library) for each row, or with `digest` lengths and SHA-256 of both.

    No shuffle: one Arrow pass over the two columns it reads. `model` is the
    path of the model file on the executors. Null and empty texts: begin and
    end only, decoded to the empty string. Repeated rows give repeated results;
    an empty table none.
    """
    kind = dict(docs.dtypes)[id_col]
    schema = f"id {kind}, {DIGEST if digest else RESULT}"
    out = docs.select(id_col, text_col).mapInArrow(_run(model, digest, check), schema)
    return out.withColumnRenamed("id", id_col)
