"""LM scoring: a hidden Markov model over words.

Words are counted exactly over all training documents without a shuffle of words one by one: documents are
cut into blocks of about 8 MB, each sends its distinct words' hashes with their counts to buckets (a packed row
for each block and bucket), and each bucket sends back the totals.

Every word has emissions of its own. They are never gathered in one place: the expected counts by state of a word that
several blocks have belong to its bucket, those of a word that one block alone has stay with the block. In a round of
Baum-Welch each bucket adds up what the blocks expect of its words and answers each block with its words' sums (64-bit
counts of 1 / UNIT, so that they don't depend on the order of adding); each block runs the scaled forward and backward
recursions over its texts, all texts of a batch step by step together, and sends the new expected counts. The driver holds the steps between states and each state's total. A state's
emission of a word is (e + 1 / states) / (all of the state's e + 1 / states, and 1 / states for words never seen), so
that one state alone gives the base score.
Rounds go on until the training texts' log10 likelihood a token gains less than ``GAIN``.

A text of more than SEGMENT tokens is cut. The matrix of a segment's steps gives the forward vector at its start and the
backward vector at its end from those of its neighbours, exactly; the segments then run beside those of other texts, so
that neither the number of steps nor the memory of a batch depends on the longest text.
Scores are from the scaled forward recursion in double precision; training uses single precision, with each word's
emissions scaled by their sum, and adds up in whole numbers.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dealt_by, documents, drop_table, n_rows_bytes, pack, powers, unpack, written, written_apart
from .gsaca import _flat

FOLD, HELD = 7, 2
STATES, SEED = 8, 11
#: Expected counts are summed in whole parts of 1 / UNIT.
UNIT = 1 << 16
#: Training ends with the first round that gains less than this in log10 likelihood a token.
GAIN = 1e-3
#: Pseudo-steps in the transitions of each state.
STAY = 5.0
BLOCK_BYTES, BUCKET_BYTES, MOST_BUCKETS = 8 << 20, 8 << 20, 65_536
#: Tokens that a task runs through together, those of a segment, and steps from one scaling to the next.
BATCH_TOKENS, SEGMENT, EVERY = 450_000, 4096, 8
#: Tokens whose vectors stay in a core's cache over several steps.
NEAR = 4096
#: Bytes that are cut into words together.
PIECE = 1 << 20
END = b""
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint64) + np.uint64(1)
_LOWER[65:91] += np.uint64(32)


def tokens(raw: bytes) -> list[bytes]:
    """Words with A-Z lower-cased, and one end."""
    return [*raw.lower().split(), END]


def held_out(doc_id: int | None) -> bool:
    """Rows without an id are trained on."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLD == HELD


def token_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of all texts' tokens, one text after the other, and the number of each text's tokens."""
    raw = b" ".join(texts) + b" "
    starts = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
    hashes, at, cut = [], [], 0
    while cut < len(raw):
        stop = raw.rfind(b" ", cut, cut + PIECE) + 1 or raw.find(b" ", cut) + 1  # a piece ends after a space
        a = np.frombuffer(raw, np.uint8, stop - cut, cut)
        edge = np.flatnonzero(np.diff(_SPACE[a], prepend=True, append=True))
        first, end = edge[::2], edge[1::2]
        power, inverse = powers(len(a))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_LOWER[a] * power[: len(a)])))
        hashes.append(_mixed((sums[end] - sums[first]) * inverse[first]))
        at.append(first + cut)
        cut = stop
    words, at = np.concatenate(hashes), np.concatenate(at)
    of = np.searchsorted(starts, at, side="right") - 1
    n = np.bincount(of, minlength=len(texts)) + 1
    out = np.full(n.sum(), _mixed(np.zeros(1, np.uint64))[0])  # the end's, a word of no bytes
    out[np.arange(len(words)) + of] = words
    return out, n


_L, _I, _B = pa.int64(), pa.int32(), pa.binary()
#: kind 0: a block's n documents (data: their tokens by rank, order: the word number of each rank, extra: ids, mask: is there an id, sizes: tokens of each). kind 1: a block's n words in a bucket (data: hashes, extra: counts).
BLOCKS = pa.schema([("kind", _I), ("blk", _L), ("p", _L), ("n", _L), ("data", _B), ("order", _B), ("extra", _B), ("mask", _B), ("sizes", _B)])
#: A block's words of a bucket (n words, ids: their numbers in the bucket, -1 for those that no other block has, data: sums by word and state in 1 / UNIT, or before the first round counts). p -2: the sums of all words that the block alone has. p -1: rest has whole-number sums of a block or bucket, which Spark adds up.
SUMS = pa.schema([("blk", _L), ("p", _L), ("n", _I), ("ids", _B), ("data", _B), ("counts", _B), ("rest", pa.list_(_L))])
#: A block's n documents, all columns packed; words: how many the block has, shared: which of them other blocks have too.
TEXTS = pa.schema([("blk", _L), ("n", _L), ("words", _L), ("ids", _B), ("mask", _B), ("sizes", _B), ("known", _B), ("base", _B), ("data", _B), ("order", _B), ("shared", _B)])
SCORES = pa.schema([("doc_id", _L), ("n_tokens", _L), ("n_known", _L), ("base_score", pa.float64()), ("score", pa.float64())])


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'double' if f.type == pa.float64() else {_L: 'long', _I: 'int', _B: 'binary', pa.list_(_L): 'array<long>'}[f.type]}" for f in schema)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)


def pack_tokens(number: np.ndarray, words: int) -> tuple[bytes, bytes]:
    """Tokens as ranks of their words by frequency, least bytes of all first (the upper ones are mostly 0), and the word of each rank."""
    order = np.argsort(-np.bincount(number, minlength=words), kind="stable").astype(np.int32)
    rank = np.empty(words, np.int32)
    rank[order] = np.arange(words, dtype=np.int32)
    return pack_planes(rank[number]), pack_rising(order)


def unpack_tokens(data: bytes, order: bytes, n: int, words: int) -> np.ndarray:
    return unpack_rising(order, words)[unpack_planes(data, n)]


def pack_planes(a: np.ndarray) -> bytes:
    """32-bit numbers, least bytes of all first."""
    return pack(np.ascontiguousarray(a, np.int32).view(np.uint8).reshape(-1, 4).T)


def unpack_planes(b: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(unpack(b, 4 * n, np.uint8).reshape(4, -1).T).view(np.int32)[:, 0]


def pack_rising(a: np.ndarray) -> bytes:
    """32-bit numbers of which long runs rise, as steps from one to the next: most are small."""
    return pack_planes(np.diff(a.astype(np.int32), prepend=np.int32(0)))


def unpack_rising(b: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpack_planes(b, n), dtype=np.int32)


def encode_block(table: pa.Table, buckets: int) -> pa.Table:
    """A block's documents as local word numbers, and its words for each bucket; numbers go by bucket."""
    table = table.sort_by("doc_id")
    blk, ids = table.column("blk")[0].as_py(), table.column("doc_id")
    hashes, n = token_hashes([x or b"" for x in table.column("raw").to_pylist()])
    u, number = np.unique(hashes, return_inverse=True)
    p = (u % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(p, kind="stable")
    place = np.empty(len(u), np.int32)
    place[order] = np.arange(len(u))
    number, u, p = place[number], u[order], p[order]
    train = np.array([not held_out(i) for i in ids.to_pylist()])
    counts = np.bincount(number[np.repeat(train, n)], minlength=len(u))
    rows = [(0, blk, -1, len(n), *pack_tokens(number, len(u)), pack(ids.fill_null(0).to_numpy()), pack(ids.is_valid().to_numpy().astype(np.uint8)), pack(n))]
    for own in np.split(np.arange(len(u)), np.flatnonzero(np.diff(p)) + 1):
        rows.append((1, blk, int(p[own[0]]), len(own), u[own].tobytes(), b"", pack(counts[own]), b"", b""))
    return _table(rows, BLOCKS)


@dataclass
class Hmm:
    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray  # state, word

    @classmethod
    def fresh(cls, masses: np.ndarray, states: int = STATES, seed: int = SEED) -> Hmm:
        """States that stay, with random leanings; the seed fixes them."""
        rng = np.random.default_rng(seed)
        emit = masses * np.exp(rng.normal(0, 1, (states, len(masses))))
        return cls(np.full(states, 1 / states), first_steps(states), emit / emit.sum(1, keepdims=True))

    def run(self, seqs: list[np.ndarray], learn: bool = False, kind: type = np.float64):
        """log10 likelihood of each sequence (none is empty); with learn also the expected counts of starts, steps and emissions. kind: the recursions' precision."""
        k, parts = len(self.start), [s[i : i + SEGMENT] for s in seqs for i in range(0, len(s), SEGMENT)]
        owner = np.repeat(np.arange(len(seqs)), [-(-len(s) // SEGMENT) for s in seqs])
        first = np.diff(owner, prepend=-1) > 0
        before, end = np.tile(self.start.astype(kind), (len(parts), 1)), np.ones((len(parts), k), kind)
        sums = self.emit.T @ np.ones(k)
        scaled, logs = np.ascontiguousarray((self.emit / sums).T, kind), np.log10(sums)
        if len(parts) > len(seqs):
            self._ends(parts, owner, first, before, end, scaled)
        order = np.argsort([-len(s) for s in parts], kind="stable")
        size = np.array([len(parts[i]) for i in order])
        score = np.zeros(len(seqs))
        starts, steps, emits = np.zeros(k), np.zeros((k, k)), np.zeros((k, self.emit.shape[1]))
        for at in np.split(order, np.flatnonzero(np.diff(np.cumsum(size) // BATCH_TOKENS)) + 1):
            got, *counts = self._batch([parts[i] for i in at], before[at], first[at], end[at], emits if learn else None, scaled, logs)
            np.add.at(score, owner[at], got)
            if learn:
                starts += counts[0]
                steps += counts[1]
        return (score, starts, steps * self.step, emits) if learn else score

    def _layout(self, seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For sequences in descending length: how many are longer than t, where step t begins, the tokens at step 0, at step 1, ..., and those of one sequence after the other."""
        lengths = np.array([len(s) for s in seqs])
        alive = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
        off = np.concatenate(([0], np.cumsum(alive)))
        flat, words = np.empty(off[-1], np.int64), np.concatenate(seqs, dtype=np.int64)
        place = off.take(_flat(np.zeros(len(seqs), np.int64), lengths))
        place += np.repeat(np.arange(len(seqs)), lengths)
        flat[place] = words
        return alive, off, flat, words

    def _ends(self, parts: list[np.ndarray], owner: np.ndarray, first: np.ndarray, before: np.ndarray, end: np.ndarray, scaled: np.ndarray) -> None:
        """Fill in, for segments of cut sequences: forward vectors of the token before, and backward vectors of the last token."""
        cut = np.flatnonzero(np.bincount(owner)[owner] > 1)
        matrix, k = {}, len(self.start)
        order = cut[np.argsort([-len(parts[i]) for i in cut], kind="stable")]
        n = max(1, BATCH_TOKENS // SEGMENT)
        for i in range(0, len(order), n):
            at = order[i : i + n].tolist()
            alive, off, flat, _ = self._layout([parts[j] for j in at])
            b, step = scaled.take(flat, 0), self.step.astype(scaled.dtype)
            x = np.zeros((k, len(at), k), b.dtype)  # first state, segment, last state
            x[np.arange(k), :, np.arange(k)] = b[: len(at)].T
            moved, off = np.empty_like(x), off.tolist()
            for t, m in enumerate(alive.tolist()):
                if m < x.shape[1]:
                    matrix |= dict(zip(at[m:], x[:, m:].swapaxes(0, 1), strict=False))
                    at, x = at[:m], np.ascontiguousarray(x[:, :m])
                    moved = np.empty_like(x)
                if t:
                    np.dot(x.reshape(-1, k), step, out=moved.reshape(-1, k))
                    np.multiply(moved, b[off[t] : off[t] + m], out=x)
                if not t % EVERY:
                    x /= x.sum((0, 2))[:, None]
            matrix |= dict(zip(at, x.swapaxes(0, 1), strict=True))
        for i in cut.tolist():
            if not first[i]:
                v = (before[i - 1] if first[i - 1] else before[i - 1] @ self.step) @ matrix[i - 1]
                before[i] = v / v.sum()
        for i in cut[::-1].tolist():
            if not first[i]:
                v = self.step @ (matrix[i] @ end[i])
                end[i - 1] = v / v.sum()

    def _batch(self, seqs: list[np.ndarray], before: np.ndarray, first: np.ndarray, end: np.ndarray, emits: np.ndarray | None, scaled: np.ndarray, sums: np.ndarray):
        """As run, for segments in descending length; expected emissions, if wanted, are added to emits. before: the start's probabilities of a first segment, else the forward vector of the token before."""
        alive, off, flat, words = self._layout(seqs)
        n, k, lengths = len(seqs), len(self.start), np.array([len(s) for s in seqs])
        b, step = scaled.take(flat, 0), self.step.astype(scaled.dtype)
        a, scale, logs = np.empty_like(b), np.ones(len(flat), b.dtype), np.zeros(n)
        ones = np.ones(k, b.dtype)
        np.multiply(np.where(first[:, None], before, before @ step), b[:n], out=a[:n])
        alive, at, x = alive.tolist(), off.tolist(), a
        for t, m in enumerate(alive):
            last, x = x, a[at[t] : at[t + 1]]
            if t:
                np.dot(last[:m], step, out=x)
                x *= b[at[t] : at[t + 1]]
            if not t % EVERY:
                c = x @ ones
                scale[at[t] : at[t + 1]] = c
                x *= (1 / c)[:, None]
                logs[:m] += np.log10(c)
        score = logs + np.log10(a[off[lengths - 1] + np.arange(n)] @ ones) + np.add.reduceat(sums.take(words), np.cumsum(lengths) - lengths)
        if emits is None:
            return (score,)
        turned, later = np.ascontiguousarray(step.T), 0
        posterior = np.empty_like(a)
        for t in range(len(alive) - 1, -1, -1):
            m = alive[t]
            x = posterior[at[t] : at[t + 1]]
            if later < m:
                x[later:] = end[later:m]
            if later:
                np.dot(follows, turned, out=x[:later])
            if not t % EVERY:
                x *= (1 / (x @ ones))[:, None]
            follows = b[at[t] : at[t + 1]]
            follows *= x  # emission and what follows
            later = m
        for i in range(0, len(flat), NEAR):
            x, follows = posterior[i : i + NEAR], b[i : i + NEAR]
            x *= a[i : i + NEAR]
            total = x @ ones
            x *= (1 / total)[:, None]
            total *= scale[i : i + NEAR]
            follows *= (1 / total)[:, None]
        goes_on = np.ones(len(flat), bool)
        goes_on[off[lengths - 1] + np.arange(n)] = False
        goes_on = np.flatnonzero(goes_on)
        steps = before[~first].T @ b[:n][~first]
        for i in range(0, len(goes_on), NEAR):
            steps = steps + a.take(goes_on[i : i + NEAR], 0).T @ b[n + i : n + i + NEAR]
        for state, e in enumerate(emits):
            e += np.bincount(flat, posterior[:, state], len(e))
        return score, posterior[:n][first].sum(0), steps


def first_steps(states: int) -> np.ndarray:
    """Transitions before the first round: states that stay."""
    step = np.full((states, states), 0.05 / max(1, states - 1))
    np.fill_diagonal(step, 0.95 if states > 1 else 1.0)
    return step


def encoded_blocks(docs: DataFrame) -> tuple[DataFrame, int]:
    """Rows of BLOCKS, written, and the bytes of text in them."""
    _, total = n_rows_bytes(docs)
    blocks, buckets = max(1, -(-total // BLOCK_BYTES)), max(1, min(MOST_BUCKETS, -(-total // BUCKET_BYTES)))
    raw = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    dealt = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("blk"), F.col("doc_id").cast("long").alias("doc_id"), raw.alias("raw"))
    blocks_ = dealt_by(dealt, "blk", total).groupBy("blk")
    return written(blocks_.applyInArrow(lambda t: encode_block(t, buckets), _ddl(BLOCKS)), "encoded", packed=True), total


def pack_sums(a: np.ndarray) -> bytes:
    """64-bit sums (word, state), least bytes of all first: the upper ones are mostly 0."""
    a = np.ascontiguousarray(a, np.int64).ravel()
    planes = np.zeros((8, len(a)), np.uint8)
    wide = np.flatnonzero(a >> 32)
    planes[:4] = a.astype(np.uint32).view(np.uint8).reshape(-1, 4).T
    planes[4:, wide] = (a[wide] >> 32).astype(np.int32).view(np.uint8).reshape(-1, 4).T
    return pack(planes) if len(a) else b""


def unpack_sums(b: bytes, n: int, states: int) -> np.ndarray:
    planes = unpack(b, 8 * n * states, np.uint8).reshape(8, -1)
    out = np.ascontiguousarray(planes[:4].T).view(np.uint32)[:, 0].astype(np.int64)
    wide = np.flatnonzero(np.bitwise_or.reduce(planes[4:]))
    out[wide] |= np.ascontiguousarray(planes[4:, wide].T).view(np.int32)[:, 0].astype(np.int64) << 32
    return out.reshape(n, states)


def first_sums(blk: int, p: int, ids: np.ndarray, place: np.ndarray, counts: np.ndarray, states: int = STATES, seed: int = SEED) -> np.ndarray:
    """Words' sums before the first round: c + 1 with random leanings, which bucket and number fix, or for words with number -1 block, bucket and place in its row; 0 for unseen words."""
    key = _mixed(np.where(ids >= 0, ids, place).astype(np.uint64) + np.uint64((p << 32) + (seed << 52)))
    key = np.where(ids >= 0, key, _mixed(key + np.uint64(2 * blk + 1)))[:, None]
    draw = lambda k: (_mixed(key + np.arange(k * states + 1, (k + 1) * states + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)) * 2.0**-53
    lean = np.exp(np.sqrt(-2 * np.log1p(-draw(0))) * np.cos(2 * np.pi * draw(1)))
    return np.rint(np.where(counts[:, None] > 0, (counts[:, None] + 1.0) * lean, 0) * UNIT).astype(np.int64)


def block_sums(table: pa.Table, text: dict, states: int) -> np.ndarray:
    """The sums of all words of a block by rank, from its rows of SUMS (sorted by p) and its row of TEXTS."""
    rows, order = table.to_pylist(), unpack_rising(text["order"], text["words"])
    if any(r["counts"] for r in rows):  # before the first round
        return np.concatenate([first_sums(r["blk"], r["p"], unpack_rising(r["ids"], r["n"]), np.arange(r["n"]), unpack(r["counts"], r["n"], np.int64), states) for r in rows])[order]
    shared = unpack(text["shared"], text["words"], np.uint8).astype(bool)
    place = np.empty(len(shared), np.int32)
    place[np.concatenate((np.flatnonzero(~shared), np.flatnonzero(shared)))] = np.arange(len(shared))
    return np.concatenate([unpack_sums(r["data"], r["n"], states) for r in rows]).take(place[order], 0)  # p of the block's own words is -2, thus first


def _mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64"""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def start_bucket(table: pa.Table, states: int = STATES) -> pa.Table:
    """For each block its words' numbers and counts in all blocks, from which the first sums follow; and the bucket's tokens, known words and sums by state."""
    table = table.sort_by("blk")
    n, blks, p = table.column("n").to_pylist(), table.column("blk").to_pylist(), table.column("p")[0].as_py()
    hashes = np.concatenate([np.frombuffer(b, np.uint64) for b in table.column("data").to_pylist()])
    own = np.concatenate([unpack(b, k, np.int64) for b, k in zip(table.column("extra").to_pylist(), n, strict=True)])
    u, inverse, blocks = np.unique(hashes, return_inverse=True, return_counts=True)
    total = np.zeros(len(u), np.int64)
    np.add.at(total, inverse, own)
    several = blocks > 1
    number = np.where(several, np.cumsum(several) - 1, -1).astype(np.int32)
    sums = first_sums(0, p, number[several], number[several], total[several], states).sum(0)
    rows = []
    for blk, at in zip(blks, np.split(inverse, np.cumsum(n)[:-1]), strict=True):
        ids, counts = number[at], total[at]
        alone = np.flatnonzero(ids < 0)
        sums += first_sums(blk, p, ids[alone], alone, counts[alone], states).sum(0)
        rows.append((blk, p, len(at), pack_rising(ids), b"", pack(counts), None))
    return _table([*rows, (-1, -1, 0, b"", b"", b"", [int(total.sum()), int((total > 0).sum()), *sums.tolist()])], SUMS)


def sum_bucket(table: pa.Table, states: int = STATES) -> pa.Table:
    """For each block its words' sums over what all blocks expect."""
    rows = table.sort_by("blk").to_pylist()
    ids = [unpack_rising(r["ids"], r["n"]) for r in rows]
    flat = np.concatenate(ids)
    sums = np.zeros((flat.max() + 1, states), np.int64)
    for at, r in zip(ids, rows, strict=True):
        sums[at] += unpack_sums(r["data"], r["n"], states)  # a block has a word once
    return _table([(r["blk"], r["p"], r["n"], r["ids"], pack_sums(sums[at]), b"", None) for r, at in zip(rows, ids, strict=True)], SUMS)


def base_block(docs: pa.Table, sums: pa.Table, n_tokens: int, n_known: int) -> pa.Table:
    """A block's documents with the scores that don't depend on the model."""
    if not docs.num_rows:
        return TEXTS.empty_table()
    sums, row = sums.sort_by("p"), docs.to_pylist()[0]
    count = np.concatenate([unpack(b, k, np.int64) for b, k in zip(sums.column("counts").to_pylist(), sums.column("n").to_pylist(), strict=True)])
    base = np.log10((count + 1) / (n_tokens + n_known + 1))
    sizes = unpack(row["sizes"], row["n"], np.int64)
    at = unpack_tokens(row["data"], row["order"], int(sizes.sum()), len(count))
    ids = np.concatenate([unpack_rising(b, k) for b, k in zip(sums.column("ids").to_pylist(), sums.column("n").to_pylist(), strict=True)])
    own = np.split(base[at], np.cumsum(sizes)[:-1])
    known = np.add.reduceat((count[at] > 0).astype(np.int64), np.cumsum(sizes) - sizes)
    return _table([(row["blk"], row["n"], len(count), row["extra"], row["mask"], row["sizes"], pack(known), pack(np.array([math.fsum(x) for x in own])), row["data"], row["order"], pack((ids >= 0).astype(np.uint8)))], TEXTS)


@dataclass
class Words:
    """What the driver knows of a model whose emissions are in buckets: ``totals`` are the states' sums over all words, with 1 / states for each known one and the unseen."""

    start: np.ndarray
    step: np.ndarray
    totals: np.ndarray

    def block(self, sums: pa.Table, text: dict) -> Hmm:
        """The model of a block's words by rank; sums are sorted by p."""
        states = len(self.totals)
        emit = block_sums(sums, text, states) / UNIT
        emit += 1 / states
        emit /= self.totals
        return Hmm(self.start, self.step, emit.T)


def _texts(docs: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray], dict]:
    """A block's ids, which of them there are, tokens of each document, the ranks of their words (frequent ones are side by side in memory), and the row itself."""
    row = docs.to_pylist()[0]
    sizes = unpack(row["sizes"], row["n"], np.int64)
    ends = np.cumsum(sizes).tolist()
    ranks = unpack_planes(row["data"], ends[-1])
    return unpack(row["ids"], row["n"], np.int64), unpack(row["mask"], row["n"], np.uint8).astype(bool), sizes, [ranks[i:j] for i, j in zip([0, *ends], ends, strict=False)], row


def learn_block(docs: pa.Table, sums: pa.Table, words: Words) -> pa.Table:
    """What a block's training texts expect of each of its words; and of starts, steps and states, with their likelihood and tokens."""
    if not docs.num_rows:
        return SUMS.empty_table()
    sums, states = sums.sort_by("p"), len(words.totals)
    ids, there, _, seqs, row = _texts(docs)
    hmm = words.block(sums, row)
    seqs = [s for i, t, s in zip(ids.tolist(), there.tolist(), seqs, strict=True) if not held_out(i if t else None)]
    parts, rest = np.zeros((hmm.emit.shape[1], states), np.int64), np.zeros(2 * states + states**2 + 2, np.int64)
    if seqs:
        score, starts, steps, got = hmm.run(seqs, learn=True, kind=np.float32)
        got *= UNIT
        parts[unpack_rising(row["order"], row["words"])] = np.rint(got, out=got).T
        rest = np.concatenate((parts.sum(0), np.rint(np.concatenate((starts, steps.ravel(), (score.sum(),))) * UNIT).astype(np.int64), (sum(map(len, seqs)),)))
    shared = unpack(row["shared"], row["words"], np.uint8).astype(bool)
    ours, rows, at = parts[shared], [], 0
    for r in sums.to_pylist():
        if r["p"] >= 0:
            numbers = unpack_rising(r["ids"], r["n"])
            n = int((numbers >= 0).sum())
            if n:
                rows.append((row["blk"], r["p"], n, pack_rising(numbers[numbers >= 0]) if n < r["n"] else r["ids"], pack_sums(ours[at : at + n]), b"", None))
            at += n
    mine = parts[~shared]
    return _table([*rows, (row["blk"], -2, len(mine), b"", pack_sums(mine), b"", None), (row["blk"], -1, 0, b"", b"", b"", rest.tolist())], SUMS)


def score_block(docs: pa.Table, sums: pa.Table, words: Words) -> pa.Table:
    if not docs.num_rows:
        return SCORES.empty_table()
    ids, there, sizes, seqs, row = _texts(docs)
    score = words.block(sums.sort_by("p"), row).run(seqs)
    return pa.table({"doc_id": pa.array(ids, mask=~there), "n_tokens": sizes, "n_known": unpack(row["known"], row["n"], np.int64), "base_score": unpack(row["base"], row["n"], np.float64), "score": score}, schema=SCORES)


def added(table: DataFrame, n: int) -> np.ndarray:
    """The sums of the n numbers in rest over all blocks or buckets."""
    row = table.where("p = -1").agg(*[F.coalesce(F.sum(F.col("rest")[i]), F.lit(0)) for i in range(n)]).first()
    return np.array(row, np.int64)


def trained(docs: DataFrame, gain: float | None = None, states: int = STATES) -> tuple[DataFrame, DataFrame, Words, int, list[float]]:
    """Texts (see TEXTS), their words' sums by block and bucket, the model, training tokens, and log10 likelihood a token before each round."""
    gain = GAIN if gain is None else gain
    encoded, total_bytes = encoded_blocks(docs)
    by = lambda df, key: dealt_by(df, key, total_bytes).groupBy(key)
    table = written(by(encoded.where("kind = 1"), "p").applyInArrow(lambda t: start_bucket(t, states), _ddl(SUMS)), "sums", packed=True)
    n_tokens, n_known, *total = added(table, 2 + states).tolist()
    texts = written(by(encoded.where("kind = 0"), "blk").cogroup(table.where("p >= 0").groupBy("blk")).applyInArrow(lambda d, a: base_block(d, a, n_tokens, n_known), _ddl(TEXTS)), "texts", packed=True)
    drop_table(encoded)
    words, history = Words(np.full(states, 1 / states), first_steps(states), np.array(total) / UNIT + (n_known + 1) / states), []
    tables, sums = (table,), table.where("p >= 0")
    while n_tokens:
        now, old = words, tables
        learned = by(texts.drop("known", "base"), "blk").cogroup(sums.groupBy("blk")).applyInArrow(lambda d, a: learn_block(d, a, now), _ddl(SUMS))
        sent, own = written_apart(learned, "expected", "p >= 0", packed=True)
        drop_table(*old)
        *rest, n = added(own, 2 * states + states**2 + 2).tolist()
        totals, starts, steps, (score,) = np.split(np.array(rest) / UNIT, np.cumsum((states, states, states**2)))
        steps = steps.reshape(states, states) + STAY / states
        words = Words((starts + 1) / (starts + 1).sum(), steps / steps.sum(1, keepdims=True), totals + (n_known + 1) / states)
        answers = written(by(sent, "p").applyInArrow(lambda t: sum_bucket(t, states), _ddl(SUMS)), "sums", packed=True)
        drop_table(sent)
        tables, sums = (answers, own), answers.unionByName(own.where("p = -2"))
        history.append(score / n)
        if len(history) > 1 and history[-1] - history[-2] < gain:
            break
    return texts, sums, words, n_tokens, history


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per row of docs.

    A null text counts as empty: its one token is the end. Rows without an id are trained on.
    """
    texts, sums, words, n_tokens, _ = trained(docs)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLD == HELD, F.lit(False))
    scores = texts.groupBy("blk").cogroup(sums.groupBy("blk")).applyInArrow(lambda d, a: score_block(d, a, words), _ddl(SCORES))
    return scores.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op3_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir, "doc_id", "text"))
