"""Secret scans: rule spans, and a character convolutional network over candidates in their context.

Rule spans (``assign``, ``access``, ``hex``) always stay. Candidates are maximal runs of 16 or more of
``[A-Za-z0-9+/_=-]``, of letters or digits alone too. The network reads the ``REACH`` bytes from
``BEFORE`` bytes before each candidate, with the candidate's own bytes marked; a candidate longer than
fits is read through overlapping windows, the last of which shows what follows it, and counts by the
highest. Candidates that no rule span touches and whose calibrated probability reaches the threshold
become spans of kind ``model``.

Labelled findings come from every row of the table: candidates inside rule spans are secrets and other
candidates are not; a long word, number, identifier or address of each text (one, at a place drawn by the
row's key) is not either. Each secret is also shown with its key word blotted out and with a random secret of
another make in its place, and so are words with made-up secrets and harmless strings, so that the network
learns more than the rules. Rows are dealt by a hash into blocks of about ``block_rows``; in each round every
block trains a copy of the network on all its findings, and the copies are averaged, in whole numbers, so that
the result depends neither on the order of sums nor on how the table is partitioned. A quarter of the rows is
not trained on: all its findings, counted by logits in steps of 1 / ``STEPS``, calibrate the probability and set the
threshold: the largest step that keeps ``recall`` of them, whatever its precision, which the network carries
along (``precision``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import chunks, utf8
from .checkpoints import durable
from .logistic import Adam, platt, sigmoid

# The rules' patterns and least lengths. Matching runs on lower-cased ASCII bytes for the
# first, whose letters are free in case; lower-casing keeps every byte in its place.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
WORD = re.compile(rb"(?<!\S)\S{5,}")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST, CANDIDATE_LEAST = 6, 20, 24, 16
KINDS = ("assign", "access", "hex", "model")

BEFORE, REACH, DEPTH, FILTERS, TAPS = 32, 96, 8, 16, 5
# Examples that a task holds at a time, and the fineness of averaged weights and of counted logits.
PIECE, FINE, STEPS = 8192, 1 << 24, 256


def _class(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


DIGITS, LETTERS = _class(b"0123456789"), _class(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
HEX, RUN = _class(b"0123456789abcdef"), DIGITS | LETTERS | _class(b"+/_=-")


def _runs(inside: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of ``inside`` of at least ``least`` bytes that stay in one text."""
    cut = np.zeros(len(inside) + 1, bool)
    cut[offsets] = True
    before = np.append(False, inside[:-1]) & ~cut[:-1]
    after = np.append(inside[1:], False) & ~cut[1:]
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    long = ends - starts >= least
    return starts[long], ends[long]


def find(data: np.ndarray, offsets: np.ndarray) -> tuple[list[list[tuple[int, int, int]]], np.ndarray, np.ndarray]:
    """For each text of a chunk its rule spans (byte start, byte end, kind), and all candidates' starts and ends."""
    raw = data.tobytes()
    low = raw.lower()
    spans: list[list[tuple[int, int, int]]] = [[] for _ in range(len(offsets) - 1)]
    text_of = lambda at: int(np.searchsorted(offsets, at, "right")) - 1
    for kind, pattern, whole, group, least in ((0, ASSIGN, low, 2, ASSIGN_LEAST), (1, ACCESS, raw, 0, ACCESS_LEAST)):
        at = 0
        while m := pattern.search(whole, at):
            i = text_of(m.start())
            end = int(offsets[i + 1])
            if m.end() > end:  # it ran into the next text
                m = pattern.search(whole, m.start(), end)
                if not m:
                    at = end
                    continue
            at = m.end()
            if m.end(group) - m.start(group) >= least:
                spans[i].append((m.start(), m.end(), kind))
    for s, e in zip(*_runs(HEX[data], offsets, HEX_LEAST)):
        spans[text_of(s)].append((int(s), int(e), 2))
    starts, ends = _runs(RUN[data], offsets, CANDIDATE_LEAST)
    return spans, starts, ends


def _places(start: int, end: int) -> range:
    """Where the windows of a candidate begin: one if it fits, otherwise half a window apart, up to the
    first that shows ``BEFORE`` bytes after the candidate."""
    inner = REACH - BEFORE
    return range(start, start + 1) if end - start <= inner else range(start, end - inner + BEFORE + inner // 2, inner // 2)


def _window(data: np.ndarray, lo: int, hi: int, start: int, end: int) -> np.ndarray:
    """REACH byte values, 0 outside the text, 256 added within the candidate."""
    out = np.zeros(REACH, np.int16)
    a, b = max(lo, start - BEFORE), min(hi, start - BEFORE + REACH)
    at = a - (start - BEFORE)
    out[at : at + b - a] = data[a:b]
    out[BEFORE : min(REACH, BEFORE + end - start)] += 256
    return out


@dataclass
class SecretNet:
    embed: np.ndarray
    conv: np.ndarray
    conv_bias: np.ndarray
    out: np.ndarray
    a: float = 1.0
    b: float = 0.0
    threshold: float = 2.0
    #: Share of secrets among the calibration findings that reach the threshold.
    precision: float = float("nan")

    @classmethod
    def fresh(cls, seed: int = 7) -> SecretNet:
        r = np.random.default_rng(seed)
        shapes = ((0.3, (512, DEPTH)), (0.2, (TAPS * DEPTH, 2 * FILTERS)), (0.0, 2 * FILTERS), (0.2, 4 * FILTERS + 1))
        return cls(*(r.normal(0, scale, shape).astype(np.float32) for scale, shape in shapes))

    def forward(self, x: np.ndarray):
        """Logits; and what a training step needs of the way there. Maximum and mean over the places."""
        e = self.embed[x]
        cols = np.lib.stride_tricks.sliding_window_view(e, TAPS, axis=1).transpose(0, 1, 3, 2).reshape(len(x), -1, TAPS * DEPTH)
        h = np.maximum(cols @ self.conv + self.conv_bias, 0)
        top = h.argmax(axis=1)
        pooled = np.concatenate([np.take_along_axis(h, top[:, None], 1)[:, 0], h.mean(axis=1)], axis=1)
        return pooled @ self.out[:-1] + self.out[-1], cols, h, top, pooled

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.conv, self.conv_bias, self.out]

    def copy(self) -> SecretNet:
        return SecretNet(*(part.copy() for part in self.parts()))

    def train(self, x: np.ndarray, y: np.ndarray, share: float, adam: Adam, r: np.random.Generator, batch: int = 64) -> None:
        """Adam steps over all of ``x`` in random order; ``share`` of all examples are secrets, and both classes weigh the same."""
        weight = np.where(y > 0, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9))
        order = r.permutation(len(y))
        for k in range(0, len(y), batch):
            i = order[k : k + batch]
            z, cols, h, top, pooled = self.forward(x[i])
            slope = (weight[i] * (sigmoid(z) - y[i]) / len(i)).astype(np.float32)
            back = slope[:, None] * self.out[None, :-1]
            grad_h = np.repeat(back[:, None, 2 * FILTERS :] / h.shape[1], h.shape[1], axis=1)
            np.put_along_axis(grad_h, top[:, None], np.take_along_axis(grad_h, top[:, None], 1) + back[:, None, : 2 * FILTERS], 1)
            grad_h *= h > 0
            grad_cols = (grad_h @ self.conv.T).reshape(len(i), -1, TAPS, DEPTH)
            grad_e = np.zeros((len(i), REACH, DEPTH), np.float32)
            for t in range(TAPS):
                grad_e[:, t : t + grad_cols.shape[1]] += grad_cols[:, :, t]
            cells = x[i].astype(np.int64).reshape(-1, 1) * DEPTH + np.arange(DEPTH)
            grad_embed = np.bincount(cells.ravel(), grad_e.ravel(), self.embed.size).reshape(self.embed.shape)
            grad_conv = cols.reshape(-1, TAPS * DEPTH).T @ grad_h.reshape(-1, 2 * FILTERS)
            adam.step([grad_embed.astype(np.float32), grad_conv, grad_h.sum((0, 1)), np.append(pooled.T @ slope, slope.sum())])

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.a * self.logits(x) + self.b)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(0), *(self.forward(x[k : k + 512])[0] for k in range(0, len(x), 512))])


def _swap(window: np.ndarray, value: bytes, size: int) -> np.ndarray:
    """The same place with ``value`` instead of the candidate of ``size`` bytes."""
    out, tail = np.zeros(REACH, np.int16), window[BEFORE + min(size, REACH - BEFORE) :]
    out[:BEFORE] = window[:BEFORE]
    own = np.frombuffer(value, np.uint8).astype(np.int16)[: REACH - BEFORE] + 256
    out[BEFORE : BEFORE + len(own)] = own
    rest = tail[: REACH - BEFORE - len(own)]
    out[BEFORE + len(own) : BEFORE + len(own) + len(rest)] = rest
    return out


LOW, UP, NUM = b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"


def _pick(r: np.random.Generator, chars: bytes, n: int) -> bytes:
    return np.frombuffer(chars, np.uint8)[r.integers(len(chars), size=n)].tobytes()


def _made(r: np.random.Generator, secret: bool) -> bytes:
    """A random secret, or a harmless string that looks like a candidate: joined words, paths, dates, and digits alone, which are numbers of cards, orders or accounts, no keys."""
    kind, n = int(r.integers(5 if secret else 6)), int(r.integers(16, 48))
    if secret:
        if kind == 2:
            return _pick(r, NUM + LOW + UP + b"+/", n) + b"="
        if kind == 3:
            return _pick(r, LOW, 3) + b"_" + _pick(r, NUM + LOW + UP, n)
        return _pick(r, {0: NUM + LOW[:6], 1: NUM + LOW + UP, 4: LOW + UP}[kind], n)
    word = lambda: _pick(r, LOW, int(r.integers(3, 9)))
    if kind == 0:
        return b"-".join([*(word() for _ in range(4)), _pick(r, NUM, 2)])
    if kind == 1:
        return b"_".join(word() for _ in range(3)) + _pick(r, NUM, 1)
    if kind == 2:
        return b"/" + b"/".join([*(word() for _ in range(3)), _pick(r, NUM, 4)])
    if kind == 3:
        d = _pick(r, NUM, 12)
        return d[:4] + b"-" + d[4:6] + b"-" + d[6:8] + b"T" + d[8:]
    return _pick(r, NUM, n) if kind == 4 else b"-".join(_pick(r, NUM, 4) for _ in range(5))


def _examples(seed: int):
    """From key and text to all examples of a text: key, nth, the window's bytes, how many are marked, and whether they are a secret."""
    schema = pa.schema([("key", pa.int64()), ("nth", pa.int32()), ("window", pa.binary()), ("marked", pa.int32()), ("y", pa.int32())])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    def shown(part: np.ndarray, lo: int, hi: int, own: list[tuple[int, int]], rules: list[tuple[int, int, int]], r: np.random.Generator) -> Iterator[tuple[np.ndarray, int]]:
        for s, e in own:
            for at in _places(s, e):
                w = _window(part, lo, hi, at, e)
                secret = any(at < y and x < min(e, at + REACH - BEFORE) for x, y, _ in rules)
                yield w, int(secret)
                if secret:
                    blank = w.copy()
                    blank[:BEFORE] = np.frombuffer(_pick(r, b"abcdefghij klmnop", BEFORE), np.uint8)
                    yield blank, 1
                    yield _swap(w, _made(r, True), e - at), 1
        text = part[lo:hi].tobytes()
        if word := WORD.search(text, int(r.integers(len(text)))) or WORD.search(text):
            s, e = word.span()
            w = _window(part, lo, hi, lo + s, lo + e)
            yield w, 0
            yield _swap(w, _made(r, True), e - s), 1
            yield _swap(w, _made(r, False), e - s), 0

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            offsets, data = utf8(batch.column(1))
            for lo, hi in chunks(offsets):
                part, o = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                spans, starts, ends = find(part, o)
                first = np.searchsorted(starts, o)
                for i, key in enumerate(batch.column(0).slice(lo, hi - lo).to_pylist()):
                    own = [(int(s), int(e)) for s, e in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]])]
                    for nth, (w, y) in enumerate(shown(part, int(o[i]), int(o[i + 1]), own, spans[i], np.random.default_rng([seed, key & (1 << 64) - 1]))):
                        rows.append((key, nth, w.astype(np.uint8).tobytes(), int((w > 255).sum()), y))
                        if len(rows) == PIECE:
                            yield batch_of(rows)
                            rows = []
        if rows:
            yield batch_of(rows)

    return examples


def _decoded(batch: pa.RecordBatch) -> np.ndarray:
    """The windows of a batch, 256 added where they are marked."""
    plain = np.frombuffer(b"".join(batch.column("window").to_pylist()), np.uint8).reshape(-1, REACH).astype(np.int16)
    at = np.arange(REACH) - BEFORE
    return plain + 256 * ((at >= 0) & (at < batch.column("marked").to_numpy()[:, None])).astype(np.int16)


def _round(dealt: DataFrame, net: SecretNet, share: float, seed: int) -> SecretNet:
    """The average of copies of ``net``, each trained once on all examples of a block, by the blocks' sizes."""
    shared = dealt.sparkSession.sparkContext.broadcast(net)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(sum(p.size for p in shared.value.parts()) + 1, np.int64)  # the weights in whole numbers, and the examples
        own, block, held = None, None, []

        def take(least: int) -> None:
            """Trains on held examples, PIECE at a time, while ``least`` or more are left: pieces don't depend on Arrow's batches."""
            while held and sum(len(y) for _, y in held) >= least:
                x, y = (np.concatenate(c) for c in zip(*held))
                own[0].train(x[:PIECE], y[:PIECE], share, own[1], own[2])
                own[3] += len(y[:PIECE])
                held[:] = [(x[PIECE:], y[PIECE:])] if len(y) > PIECE else []

        def end() -> None:
            take(1)
            if own:
                flat = np.concatenate([p.ravel() for p in own[0].parts()]).astype(np.float64)
                totals[:-1] += np.rint(flat * FINE).astype(np.int64) * own[3]
                totals[-1] += own[3]

        for batch in batches:
            x, y, blocks = _decoded(batch), batch.column("y").to_numpy(), batch.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1), len(blocks)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if blocks[lo] != block:
                    end()
                    block, mine = blocks[lo], shared.value.copy()
                    own = [mine, Adam(mine.parts(), 3e-3), np.random.default_rng([seed, int(block)]), 0]
                held.append((x[lo:hi], y[lo:hi]))
                take(PIECE)
        end()
        if totals[-1]:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(totals), dtype=np.int32)), pa.array(totals)], names=["at", "total"])

    trained = dealt.where("not back").select("block", "window", "marked", "y").mapInArrow(learn, "at int, total bigint")
    sums = trained.groupBy("at").agg(F.sum("total").alias("total")).orderBy("at").collect()  # one row a weight
    flat, out, at = np.array([r["total"] for r in sums], np.float64), [], 0
    for p in net.parts():
        out.append((flat[at : at + p.size] / flat[-1] / FINE).astype(np.float32).reshape(p.shape))
        at += p.size
    return SecretNet(*out)


def _counted(dealt: DataFrame, net: SecretNet) -> np.ndarray:
    """Logits of the examples that were not trained on, in whole steps, with the harmless ones and the secrets at each: as many rows as there are steps."""
    shared = dealt.sparkSession.sparkContext.broadcast(net)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = np.floor(np.clip(shared.value.logits(_decoded(batch)), -60, 60) * STEPS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(z), batch.column("y")], names=["z", "y"])

    scored = dealt.where("back").select("window", "marked", "y").mapInArrow(score, "z int, y int")
    rows = scored.groupBy("z").agg(F.count_if(F.col("y") == 0).alias("down"), F.count_if(F.col("y") == 1).alias("up")).orderBy("z").collect()
    return np.array([tuple(r) for r in rows], np.int64).reshape(-1, 3)


def fit_secrets(docs: DataFrame, text: str = "text", id_col: str = "doc_id", block_rows: int = 4000, rounds: int = 5, recall: float = 0.98, seed: int = 7) -> SecretNet:
    """A network from the findings of all rows: ``rounds`` over every block of about ``block_rows`` rows, threshold and calibration from all that were not
    trained on. No task holds more than PIECE examples. Without any secret in a rule's span only made-up ones are shown; without rows it adds no span."""
    net = SecretNet.fresh(seed)
    keyed = docs.select(F.xxhash64(F.col(id_col), F.col(text)).alias("key"), F.col(text).alias("text")).where(F.length("text") > 0)
    n_blocks = -(-docs.count() // block_rows)
    if not n_blocks:
        return net
    found = keyed.mapInArrow(_examples(seed), "key bigint, nth int, window binary, marked int, y int")
    found = found.select("*", F.pmod("key", F.lit(n_blocks)).cast("int").alias("block"), (F.shiftright("key", 40) % 4 == 0).alias("back"))
    order = ["block", F.xxhash64("key", "nth"), "window"]
    dealt = durable(found.repartition(n_blocks, "block").sortWithinPartitions(*order).drop("key", "nth"))
    counts = {(r["back"], r["y"]): r["count"] for r in dealt.groupBy("back", "y").count().collect()}
    down, up = counts.get((False, 0), 0), counts.get((False, 1), 0)
    if len({y for _, y in counts}) < 2 or len({b for b, _ in counts}) < 2:
        return net
    for k in range(rounds):
        net = _round(dealt, net, up / (down + up), seed + k)
    z, held = np.split(_counted(dealt, net), [1], axis=1)
    z = z[:, 0] / STEPS
    net.a, net.b = platt(z, held)
    if held[:, 1].any():
        least = int(np.searchsorted(np.cumsum(held[:, 1]), int((1 - recall) * held[:, 1].sum()), "right"))
        net.threshold = float(sigmoid(net.a * z[least] + net.b))
        net.precision = float(held[least:, 1].sum() / held[least:].sum())
    return net


def scan_secrets(docs: DataFrame, net: SecretNet, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id and ``found``, an array of (kind, start, end, score) by start and then kind, in code points with
    exclusive ends, of every row; rule spans have score 1.

    A null or empty text has none. Repeated rows give repeated results, a null id stays null, an empty
    table gives an empty table; other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, found array<struct<kind:string,start:bigint,end:bigint,score:double>>"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = utf8(batch.column(1))
            for lo, hi in chunks(offsets):
                part, o = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                spans, starts, ends = find(part, o)
                scored: list[list[tuple]] = [[(s, e, k, 1.0) for s, e, k in own] for own in spans]
                free, windows = [], []
                for s, e in zip(starts, ends):
                    i = int(np.searchsorted(o, s, "right")) - 1
                    if not any(s < y and x < e for x, y, _ in spans[i]):
                        free.append((i, int(s), int(e), len(windows)))
                        windows += [_window(part, o[i], o[i + 1], at, e) for at in _places(int(s), int(e))]
                if free:
                    best = np.maximum.reduceat(shared.value.probability(np.stack(windows)), [k for *_, k in free])
                    for (i, s, e, _), p in zip(free, best):
                        if p >= shared.value.threshold:
                            scored[i].append((s, e, 3, float(p)))
                points = np.append(0, np.cumsum((part & 0xC0) != 0x80)) if any(scored) else None
                out = []
                for i, own in enumerate(scored):
                    base = int(points[o[i]]) if own else 0
                    out.append([{"kind": KINDS[k], "start": int(points[s]) - base, "end": int(points[e]) - base, "score": p} for s, e, k, p in sorted(own, key=lambda x: (x[0], x[2]))])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(out, pa.list_(kind))], names=[id_col, "found"])

    return docs.select(F.col(id_col), F.col(text)).mapInArrow(scan, schema)
