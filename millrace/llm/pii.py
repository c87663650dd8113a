"""Personal data: base patterns, and a semi-Markov conditional random field for the rest.

Base spans are those of four fixed patterns. Between them, a semi-Markov CRF
looks for what the patterns miss: a phone number without its plus sign, a mail
address written with "at" and "dot", a secret such as the value of a token or
password. A segment is a whole span of tokens, and
its features look at the whole of it (digits, check sum, brackets, the word
before), which no token-wise model can. Dynamic programming over segments of at
most MAX_TOKENS tokens, and over spelt addresses and unbroken runs of any length, chooses
boundaries and kinds jointly. Text without a
digit or another trigger nearby can only be outside, so the programme runs over
windows around triggers; the windows' results are those of the whole text.

The model is fitted on windows generated by rule (TRAIN_WINDOWS, fixed seed),
by exact gradients of the conditional likelihood, in a task of its own, once for
each session.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import math
import random
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from millrace.llm.common import chunks

KINDS = ("email", "ip", "card", "phone")
#: The model's kinds: those of the base patterns, and one more.
MODEL_KINDS = (*KINDS, "secret")

# --- base patterns -----------------------------------------------------------
# Possessive forms of the fixed patterns: the same matches, without backtracking over long runs.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile("[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) << (i & 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, by start, then kind as listed."""
    out = []
    at, end = text.find("@"), 0
    while at >= 0:
        if m := _DOMAIN.match(text, at):
            start = at
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                out.append((start, m.end(), "email"))
                end = m.end()
        at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            out.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _NOT_DIGIT.sub("", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


# --- the model ---------------------------------------------------------------
MAX_TOKENS = 14
#: Characters of context on each side of a trigger.
MARGIN = 48
TRAIN_WINDOWS, EPOCHS = 260, 30
LABELS = ("outside", *MODEL_KINDS)
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\s|.", re.S)
_TRIGGER = re.compile(r"[0-9]|@|[\[(] ?at ?[\])]|\sdot\s")
_OBFUSCATED = re.compile(r"[\w.%+-]+ ?[\[(] ?at ?[\])] ?[\w-]+(?:(?: ?[\[(] ?dot ?[\])] ?|\.)[\w-]+)+|[\w.%+-]+ at [\w-]+(?: dot [\w-]+)+")
_AT = re.compile(r" ?[\[(] ?at ?[\])] ?| at ")
_BRACKETED = re.compile(r"[\w-]++(?:(?: ?[\[(] ?dot ?[\])] ?|\.)[\w-]++)++")
_SPOKEN = re.compile(r"[\w-]++(?: dot [\w-]++)++")
_GOES_ON = re.compile(r"(?: ?[\[(] ?dot ?[\])] ?|\.| dot )\w")
_AREA = re.compile(r"\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}")
_GROUPS = re.compile(r"[0-9]{3}([ .-])[0-9]{3}\1[0-9]{4}")
_HINTS = {"phone": {"phone", "tel", "call", "fax", "mobile"}, "card": {"card", "visa", "credit", "mastercard"}, "email": {"mail", "email", "contact"}, "ip": {"ip", "host", "address", "server"}, "secret": {"token", "key", "secret", "password", "passwd", "pwd", "auth", "bearer", "apikey"}}
#: An unbroken run that may be a secret.
_RUN = re.compile(r"(?<![\w+/-])[A-Za-z0-9_+/-]{12,}={0,2}(?![\w+/=-])")
_ASSIGNED = re.compile(r"[=:]\s?[\"']?$")


def spelt(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """Spelt addresses of any length between a and b, each from its first letter or digit to its last; in one pass."""
    out, end = [], a
    for m in _AT.finditer(text, a, b):
        start = m.start()
        while start > end and (text[start - 1].isalnum() or text[start - 1] in "_.%+-"):
            start -= 1
        while start < m.start() and not text[start].isalnum():
            start += 1
        domain = (_SPOKEN if m.group() == " at " else _BRACKETED).match(text, m.end(), b)
        if start < m.start() and domain:
            stop = domain.end()
            while not text[stop - 1].isalnum():
                stop -= 1
            if _OBFUSCATED.fullmatch(text, start, stop):
                out.append((start, stop))
                end = stop
    return out


def whole_runs(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """Runs of any length between a and b that hold a letter and a digit."""
    found = [(m.start(), m.end()) for m in _RUN.finditer(text, a, b)]
    return [(x, y) for x, y in found if any(c.isdigit() for c in text[x:y]) and any(c.isalpha() for c in text[x:y])]


def features(text: str, a: int, b: int) -> list[str]:
    """What a segment is scored by: all of it, its neighbours and the word before."""
    s = text[a:b]
    digits = _NOT_DIGIT.sub("", s)
    before, after = text[a - 1 : a], text[b : b + 1]
    out = ["bias", f"digits{min(len(digits), 20)}"]
    if before and (before.isalnum() or before in "\"'#_.-+("):
        out.append("glued-left")
    if after and (after.isalnum() or after in "\"'_-@" or (after == "." and text[b + 1 : b + 2].isdigit())):
        out.append("glued-right")
    if _OBFUSCATED.fullmatch(s):
        out.append("spelt-address")
        if _GOES_ON.match(text, b):
            out.append("cut-right")
    if _AREA.fullmatch(s):
        out.append("area-code")
    elif _GROUPS.fullmatch(s):
        out.append("three-groups")
    if any(c.isalpha() for c in s):
        out.append("letters")
    if len(digits) == len(s):
        out.append("bare")
    if 14 <= len(digits) <= 19:
        out.append("sum-holds" if luhn(digits) else "sum-fails")
    if s.count(".") == 3:
        out.append("three-dots")
    if (m := _RUN.match(text, a)) and m.end() == b:
        out.append(f"run{min(len(s) // 8, 5)}")
        if _ASSIGNED.search(text, max(0, a - 4), a):
            out.append("assigned")
    words = re.findall(r"[a-z]+", text[max(0, a - 16) : a].lower())
    if words:
        out += [f"hint-{k}" for k, v in _HINTS.items() if words[-1] in v]
    return out


class Window:
    """Tokens and candidate segments of a stretch of text; bounds at base spans are hard."""

    def __init__(self, text: str, a: int, b: int):
        marks = [(m.start(), m.end()) for m in _TOKEN.finditer(text, a, b)]
        self.n = len(marks)
        self.segments: list[list[tuple[int, list[str], int, int]]] = [[] for _ in range(self.n + 1)]
        opens = [i for i, (x, y) in enumerate(marks) if text[x].isalnum() or text[x] in "(+"]
        closes = [text[y - 1].isalnum() for _, y in marks]
        for i in opens:
            for j in range(i + 1, min(self.n, i + MAX_TOKENS) + 1):
                if text[marks[j - 1][0]] == "\n":
                    break
                if closes[j - 1]:
                    x, y = marks[i][0], marks[j - 1][1]
                    f = features(text, x, y)
                    if f[1] not in ("digits0", "digits1", "digits2", "digits3", "digits4", "digits5", "digits6") or "spelt-address" in f:
                        self.segments[j].append((i, f, x, y))
        starts, ends = {x: i for i, (x, _) in enumerate(marks)}, {y: j for j, (_, y) in enumerate(marks, 1)}
        offered = {(x, y) for at in self.segments for _, _, x, y in at}
        for x, y in sorted({*spelt(text, a, b), *whole_runs(text, a, b)} - offered):
            i, j = starts.get(x), ends.get(y)
            if i is not None and j is not None:
                self.segments[j].append((i, features(text, x, y), x, y))

    def score(self, w: dict[tuple[str, str], float], f: list[str], kind: str) -> float:
        return sum(w.get((kind, x), 0.0) for x in f)

    def best(self, w: dict) -> list[tuple[int, int, str]]:
        """The best segmentation's spans: Viterbi over (end, kind of the last segment)."""
        alpha: list[dict[str, tuple[float, object]]] = [{"outside": (0.0, None)}]
        for j in range(1, self.n + 1):
            cell: dict[str, tuple[float, object]] = {}
            for y, (s, back) in alpha[j - 1].items():
                v = s + w.get(("follows", y + ">outside"), 0.0)
                if "outside" not in cell or v > cell["outside"][0]:
                    cell["outside"] = (v, back)
            for i, f, x, e in self.segments[j]:
                for kind in MODEL_KINDS:
                    own = self.score(w, f, kind)
                    for y, (s, back) in alpha[i].items():
                        v = s + own + w.get(("follows", f"{y}>{kind}"), 0.0)
                        if kind not in cell or v > cell[kind][0]:
                            cell[kind] = (v, (back, (x, e, kind)))
            alpha.append(cell)
        back, out = max(alpha[-1].values(), key=lambda c: c[0])[1], []
        while back:
            back, span = back
            out.append(span)
        return out[::-1]

    def gradient(self, w: dict, truth: set[tuple[int, int, str]]) -> tuple[float, dict]:
        """Log likelihood of the true spans and its exact gradient, by forward and backward sums."""
        arcs = []  # (i, j, kind, own score, features, true)
        inside = {(x, e): k for x, e, k in truth}
        covered = set()
        for j in range(1, self.n + 1):
            for i, f, x, e in self.segments[j]:
                if (x, e) in inside:
                    covered.update(range(i + 1, j + 1))
                arcs += [(i, j, k, self.score(w, f, k), f, inside.get((x, e)) == k) for k in MODEL_KINDS]
            arcs.append((j - 1, j, "outside", 0.0, [], False))
        arcs.sort(key=lambda t: t[1])
        follow = {(y, k): w.get(("follows", f"{y}>{k}"), 0.0) for y in LABELS for k in LABELS}

        def log_sum(v: list[float]) -> float:
            m = max(v)
            return m + math.log(sum(math.exp(x - m) for x in v))

        def forward(chosen: list) -> list[dict[str, float]]:
            cells: list[dict[str, list[float]]] = [{} for _ in range(self.n + 1)]
            done: list[dict[str, float]] = [{} for _ in range(self.n + 1)]
            done[0] = {"outside": 0.0}
            at = 0
            for i, j, k, s, _, _ in chosen:
                while at < j:
                    at += 1
                    if at > 1:
                        done[at - 1] = {y: log_sum(v) for y, v in cells[at - 1].items()}
                for y, v in done[i].items():
                    cells[j].setdefault(k, []).append(v + s + follow[y, k])
            done[self.n] = {y: log_sum(v) for y, v in cells[self.n].items()} if self.n else done[0]
            return done

        def expected(chosen: list, sign: float, into: dict) -> float:
            alpha = forward(chosen)
            z = log_sum(list(alpha[-1].values()))
            beta: list[dict[str, list[float]]] = [{} for _ in range(self.n + 1)]
            beta[self.n] = {y: [0.0] for y in LABELS}
            flat: list[dict[str, float]] = [{} for _ in range(self.n + 1)]
            at = self.n + 1
            for i, j, k, s, f, _ in reversed(chosen):
                while at > j:
                    at -= 1
                    flat[at] = {y: log_sum(v) for y, v in beta[at].items()}
                if k not in flat[j]:
                    continue
                for y, v in alpha[i].items():
                    b = s + follow[y, k] + flat[j][k]
                    beta[i].setdefault(y, []).append(b)
                    p = sign * math.exp(v + b - z)
                    into[("follows", f"{y}>{k}")] = into.get(("follows", f"{y}>{k}"), 0.0) + p
                    for x in f:
                        into[(k, x)] = into.get((k, x), 0.0) + p
            return z

        grad: dict = {}
        true = [a for a in arcs if a[5] or (a[2] == "outside" and a[1] not in covered)]
        good = expected(true, 1.0, grad)
        every = expected(arcs, -1.0, grad)
        return good - every, grad


def training_windows(n: int, seed: int) -> list[tuple[str, set[tuple[int, int, str]]]]:
    """Windows by rule: filler with one or two entities in the forms that patterns miss and that they know, and look-alikes that are none."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice(["th", "er", "an", "ing", "ou", "de", "la", "en", "st", "ion"]) for _ in range(r.randint(1, 4)))

    def card(good: bool) -> str:
        while luhn(s := digits(16)) != good:
            pass
        return s if r.random() < 0.6 else "-".join(s[i : i + 4] for i in range(0, 16, 4))

    def name() -> str:
        return r.choice([f"{word()}{digits(2)}", f"{word()}.{word()}", word()])

    def domain(dot: str) -> str:
        return dot.join([word() for _ in range(r.choice([1, 1, 2]))] + [r.choice(["com", "org", "net", f"co{dot}uk"])])

    def entity() -> tuple[str, str]:
        k = r.randrange(7)
        if k == 6:
            return r.choice([lambda: hashlib.sha1(digits(9).encode()).hexdigest()[: r.choice([32, 40])], lambda: "".join(r.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz0123456789") for _ in range(r.randint(16, 44))) + "7", lambda: f"{r.choice(['sk', 'pk', 'gh'])}_{hashlib.md5(digits(9).encode()).hexdigest()}"])(), "secret"
        if k == 0:
            return f"({digits(3)}) {digits(3)}-{digits(4)}", "phone"
        if k == 1:
            sep = r.choice("-. ")
            return f"{digits(3)}{sep}{digits(3)}{sep}{digits(4)}", "phone"
        if k == 2:
            return card(True), "card"
        if k == 3:
            return f"{name()} {r.choice(['[at]', '(at)'])} {domain(r.choice(['.', ' [dot] ', ' (dot) ']))}", "email"
        if k == 4:
            return f"{name()} at {domain(' dot ')}", "email"
        return ".".join(str(r.randrange(256)) for _ in range(4)), "ip"

    def other() -> str:
        return r.choice([lambda: card(False), lambda: card(False), lambda: digits(r.randint(7, 13)), lambda: f"{r.randint(1990, 2030)}-{digits(2)}-{digits(2)}", lambda: f"{digits(2)},{digits(3)},{digits(3)}", lambda: f'"{hashlib.md5(digits(9).encode()).hexdigest()}"', lambda: f"commit {hashlib.sha1(digits(9).encode()).hexdigest()}", lambda: f"/{word()}-{digits(4)}/{word()}-{digits(2)}", lambda: f"version {digits(1)}.{digits(1)}.{digits(1)}", lambda: f"{digits(2)} dot {word()}", lambda: f"{digits(3)} {digits(3)} {digits(2)}", lambda: digits(20)])()

    out = []
    for _ in range(n):
        parts, spans, at = [], set(), 0
        for k in r.choices(["word", "entity", "other"], [8, 2, 2], k=r.randint(4, 9)):
            hint = r.choice(sorted(set().union(*_HINTS.values()))) + r.choice([" ", ": "]) if r.random() < 0.1 else ""
            kind = None
            if k == "word":
                s = word() + r.choice(["", "", ",", "."])
            elif k == "entity":
                s, kind = entity()
            else:
                s = other()
            if kind:
                spans.add((at + len(hint), at + len(hint) + len(s), kind))
            tail = r.choice([" ", " ", ", ", ". ", "!! ", "\n"])
            if kind == "secret":
                # A secret is told by what it is assigned to; the same run without that is none.
                spans.discard((at + len(hint), at + len(hint) + len(s), kind))
                hint = r.choice(sorted(_HINTS["secret"])) + r.choice([" = ", ": ", "=", ":"])
                quote = r.choice(["", '"', "'"])
                hint, tail = hint + quote, quote + tail
                spans.add((at + len(hint), at + len(hint) + len(s), kind))
            parts.append(hint + s + tail)
            at += len(hint) + len(s) + len(tail)
        out.append(("".join(parts), spans))
    return out


@functools.lru_cache(1)
def trained() -> tuple[tuple[tuple[str, str], float], ...]:
    """The weights: adaptive steps up the regularised likelihood of the training windows, the same on every run."""
    w: dict[tuple[str, str], float] = {}
    square: dict[tuple[str, str], float] = {}
    examples = [(Window(t, 0, len(t)), spans) for t, spans in training_windows(TRAIN_WINDOWS, 7)]
    r = random.Random(3)
    for _ in range(EPOCHS):
        r.shuffle(examples)
        for at in range(0, len(examples), 20):
            total: dict = {}
            for window, spans in examples[at : at + 20]:
                for k, v in window.gradient(w, spans)[1].items():
                    total[k] = total.get(k, 0.0) + v
            # Stays zero: a weight for each token outside would count against long segments.
            total.pop(("follows", "outside>outside"), None)
            for k, v in total.items():
                v -= 0.01 * w.get(k, 0.0)
                square[k] = square.get(k, 0.0) + v * v
                w[k] = w.get(k, 0.0) + 0.5 * v / math.sqrt(square[k] + 1e-8)
    return tuple(sorted(w.items()))


_fitted: dict[tuple[str, str], float] = {}


def fitted(spark: SparkSession) -> dict[tuple[str, str], float]:
    """The weights of trained(), made by one task and kept; some hundred numbers come to the driver."""
    if not _fitted:

        def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _ in batches:
                weights = trained()
                yield pa.RecordBatch.from_pydict({"kind": [k for (k, _), _ in weights], "feature": [f for (_, f), _ in weights], "weight": [w for _, w in weights]})

        rows = spark.range(0, 1, 1, 1).mapInArrow(fit, "kind string, feature string, weight double").collect()
        _fitted.update({(r.kind, r.feature): r.weight for r in rows})
    return dict(_fitted)


def added_spans(text: str, base: list[tuple[int, int, str]], w: dict) -> list[tuple[int, int, str]]:
    """Spans that the model finds between base spans."""
    walls, end = [], 0
    for a, b, _ in sorted(base):
        if a > end:
            walls.append((end, a))
        end = max(end, b)
    walls.append((end, len(text)))
    out = []
    for a, b in walls:
        at = a
        whole = sorted(spelt(text, a, b)) if _TRIGGER.search(text, a, b) else []
        starts = [x for x, _ in whole]
        while m := _TRIGGER.search(text, at, b):
            lo, hi = max(a, m.start() - MARGIN), min(b, m.end() + MARGIN)
            # The window grows while another trigger is in its margin or a spelt address passes its edge, so that no entity is cut.
            while True:
                k = bisect.bisect_left(starts, hi) - 1
                if (more := _TRIGGER.search(text, m.end(), hi)) and more.end() > m.end():
                    m = more
                    hi = max(hi, min(b, m.end() + MARGIN))
                elif k >= 0 and whole[k][1] > hi:
                    hi = whole[k][1]
                else:
                    break
            k = bisect.bisect_right(starts, lo) - 1
            if k >= 0 and whole[k][1] > lo:
                lo = whole[k][0]
            while lo > a and not text[lo - 1].isspace():
                lo -= 1
            while hi < b and not text[hi].isspace():
                hi += 1
            out += Window(text, lo, hi).best(w)
            at = hi
    return out


def all_spans(text: str, w: dict) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans), both by start, then kind."""
    base = base_spans(text)
    added = added_spans(text, base, w) if _TRIGGER.search(text) else []
    return base, sorted(base + added, key=lambda s: (s[0], MODEL_KINDS.index(s[2])))


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping spans by the first one's."""
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _label(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


COUNTS = "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, n_spans bigint, base_spans string, spans string, masked string"
BATCH_BYTES = 8 << 20


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] = ()) -> DataFrame:
    """Per row: counts of base spans and of all spans, base spans and all spans as kind:start:end lists, and the masked text.

    No shuffle: one Arrow pass over the columns it reads. The weights (some
    hundred numbers) go with the function. Null text: as empty, masked null.
    Very long texts are read whole, in windows around what may be personal.
    Spans that start together go by kind as listed; of segmentations that score
    alike the one with fewer segments so far stays. Repeated rows give repeated
    results, an empty table none. `keep` names further columns to carry, which
    must not have the names of results (ValueError); others are dropped.
    """
    weights = fitted(docs.sparkSession)
    columns = list(dict.fromkeys([id_col, *keep]))
    kinds = dict(docs.dtypes)
    results = [c.split()[0] for c in COUNTS.split(", ")]
    if {c.lower() for c in columns} & {*results}:
        raise ValueError("a kept column has the name of a result")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches if whole.num_rows for part in chunks(whole, 0, BATCH_BYTES)):
            texts = batch.column(0).to_pylist()
            found = [all_spans(t or "", weights) for t in texts]
            counts = {f"n_{k}": pa.array([sum(s[2] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS}
            more = {"n_spans": pa.array([len(x) for _, x in found], pa.int64()), "base_spans": [_label(b) for b, _ in found], "spans": [_label(s) for _, s in found], "masked": pa.array([None if t is None else masked(t, s) for t, (_, s) in zip(texts, found, strict=True)], pa.string())}
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *[v if isinstance(v, pa.Array) else pa.array(v) for v in (counts | more).values()]], [*columns, *counts, *more])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", " + COUNTS
    return docs.select(docs[text_col].alias("_text"), *columns).mapInArrow(run, schema)
