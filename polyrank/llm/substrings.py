"""Suffix-array dedup: every byte covered by a 100-byte string that also starts earlier is removed.

Each 100-byte window has an anchor, the leftmost of its 24-byte grams with the smallest hash; equal windows have equal
anchors at the same place within them. Neighbouring windows of one anchor are cut into two runs: those that hold the
anchor and the 38 bytes before it, and those that hold it and the 38 bytes after it. The hash of these 62 bytes is
the run's key, so equal windows meet where their key's runs meet. A run has at most 39 windows, whatever the text, and
no two windows of a run are equal. Documents are dealt into blocks of about 8 MB by a hash; what one block sends to a
bucket of keys is one packed row.

1. Each block sends its keys and how many different runs each has; each bucket answers which keys others have too.
2. A key with more than HOT different runs, which a frequent line has, would put all of the line's surroundings into
   one bucket. Its runs fall apart into their windows: each block sends the windows' hashes, and each bucket answers
   which others have too. (Without such keys this step is left out.)
3. Each block sends the bytes of the runs, and of hot keys' windows, that others have too. Equal ones within a block
   are sent once; the later ones are repeats as a whole.
4. Each bucket builds suffix arrays (``gsaca``) over the different runs of each key and finds the windows that share
   their first 100 bytes with an earlier one. Equal runs go into the arrays once.
5. Each block joins the repeated stretches of its documents and removes them.

Hashes only decide what meets; bytes are compared before anything counts as a repeat. Positions are ordered by doc_id
(null last), rows of one doc_id by a hash of their text, whichever blocks they are in. Equal rows are two documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dealt_by, documents, drop_table, n_rows_bytes, pack, powers, unpack, written
from .gsaca import _flat, suffix_arrays

LENGTH, GRAM = 100, 24
#: Bytes beside the anchor that a run's windows share; windows start at most this many bytes before their anchor, or more.
SIDE = (LENGTH - GRAM) // 2
HOT = 512
BLOCK_BYTES, BUCKET_BYTES, MOST_BUCKETS = 8 << 20, 4 << 20, 65_536
#: Windows that a block looks at together.
CHUNK = 1 << 18
#: Symbols in the texts of one call of ``suffix_arrays``.
BATCH = 1_500_000
_W = LENGTH - GRAM + 1
_LAST = np.iinfo(np.int64).max


def gram_hashes(raw: bytes) -> np.ndarray:
    """A well-mixed 64-bit hash of the GRAM bytes at each place."""
    a = np.frombuffer(raw, np.uint8)
    h = (a.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    eight = None
    for m in (1, 2, 4, 8):
        h = h[:-m] * np.uint64(0x9E3779B97F4A7C15 + 2 * m) + h[m:]
        h ^= h >> np.uint64(29)
        eight = h if m == 4 else eight
    n = len(a) - GRAM + 1
    g = h[:n] * np.uint64(0xBF58476D1CE4E5B9) + eight[16 : 16 + n]
    g ^= g >> np.uint64(32)
    g *= np.uint64(0x94D049BB133111EB)
    return g ^ (g >> np.uint64(29))


def _mixed(*parts: np.ndarray) -> np.ndarray:
    x = parts[0]
    for y in parts[1:]:
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + y
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


def anchored(g: np.ndarray, low: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows first to last, whose smallest hash is the same, cut where their anchor changes: first, last, anchor."""
    key, view = low[first], np.lib.stride_tricks.sliding_window_view(g, _W)
    leftmost = first + (view[first] == key[:, None]).argmax(1)
    rightmost = last + _W - 1 - (view[last][:, ::-1] == key[:, None]).argmax(1)
    one = leftmost == rightmost
    out = [(first[one], last[one], leftmost[one])]
    for f, z, k in zip(first[~one].tolist(), last[~one].tolist(), key[~one], strict=True):  # the gram occurs again: a window's anchor is the next one
        at = f + np.flatnonzero(g[f : z + _W] == k)
        begin, end = np.concatenate(([f], at[:-1] + 1)), np.minimum(at, z)
        out.append((begin[begin <= end], end[begin <= end], at[begin <= end]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def runs(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Key, content hash, first and last window of the runs of texts joined in raw, and a function from windows to their hashes; a chunk at a time.

    Windows are numbered by where they start in raw. A run that goes on in the next chunk is two.
    """
    stop = len(raw) - LENGTH + 1
    for base in range(0, stop, CHUNK):
        n = min(CHUNK, stop - base)
        g = gram_hashes(raw[base : base + n + LENGTH - 1])
        low, w = g, 1
        while 2 * w <= _W:
            low, w = np.minimum(low[:-w], low[w:]), 2 * w
        if w < _W:
            low = np.minimum(low[: -(_W - w)], low[_W - w :])
        begin = starts[np.searchsorted(starts, base) : np.searchsorted(starts, base + n)] - base
        first = np.union1d(np.concatenate(([0], np.flatnonzero(low[1:] != low[:-1]) + 1)), begin)
        last = np.append(first[1:], n) - 1
        last = np.minimum(last, ends[np.searchsorted(starts, first + base, side="right") - 1] - LENGTH - base)
        whole = first <= last
        first, last, anchor = anchored(g, low, first[whole], last[whole])
        before, after = first <= anchor - SIDE, last > anchor - SIDE
        m, q = anchor[before], anchor[after]
        key = np.concatenate((_mixed(g[m - SIDE], g[m - SIDE + GRAM], g[m]), _mixed(g[q], g[q + GRAM], g[q + SIDE], np.uint64(1))))
        a = np.concatenate((first[before], np.maximum(first[after], q - SIDE + 1)))
        z = np.concatenate((np.minimum(last[before], m - SIDE), last[after]))
        power, inverse = powers(len(g))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(g * power[: len(g)])))
        content = (sums[z + _W] - sums[a]) * inverse[a]
        yield key, content, a + base, z + base, lambda w, g=g, base=base: _mixed(*(g[w - base + o] for o in (0, GRAM, 2 * GRAM, 3 * GRAM, LENGTH - GRAM)))


def in_order(table: pa.Table) -> np.ndarray:
    """Places of a block's rows ordered by id (null last), then the text's hash."""
    ids, th = doc_ids(table), table.column("th").to_numpy()
    return np.lexsort((th, ids))


def doc_ids(table: pa.Table) -> np.ndarray:
    return table.column("doc_id").fill_null(_LAST).to_numpy()  # long


def joined(table: pa.Table) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The texts of a block in order, joined, with starts and ends."""
    column = table.column("raw").to_pylist()
    texts = [column[i] for i in in_order(table).tolist()]
    ends = np.cumsum([len(t) for t in texts])
    return b"".join(texts), np.concatenate(([0], ends[:-1])).astype(np.int64), ends.astype(np.int64)


def by_bucket(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket and the places of its keys."""
    p = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(p, kind="stable")
    cut = np.flatnonzero(np.diff(p[order], prepend=-1))
    for part in np.split(order, cut[1:]) if len(order) else ():
        yield int(p[part[0]]), part


def key_rows(blk: int, keys: np.ndarray, counts: np.ndarray, buckets: int) -> pa.Table:
    rows = [(blk, p, len(at), keys[at].tobytes(), pack(counts[at])) for p, at in by_bucket(keys, buckets)]
    return pa.Table.from_pylist([dict(zip(KEYS.names, r, strict=True)) for r in rows], KEYS)


def send_keys(table: pa.Table, buckets: int) -> pa.Table:
    """Step 1 in a block: keys with their number of different runs."""
    raw, starts, ends = joined(table)
    found = [x[:2] for x in runs(np.frombuffer(raw, np.uint8), starts, ends)] if len(raw) >= LENGTH else []
    if not sum(len(k) for k, _ in found):
        return KEYS.empty_table()
    key, content = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((content, key))
    key, content = key[order], content[order]
    key = key[np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (content[1:] != content[:-1]))))]
    u, count = np.unique(key, return_counts=True)
    return key_rows(table.column("blk")[0].as_py(), u, np.minimum(count, 65_535).astype(np.uint16), buckets)


def answer_keys(table: pa.Table) -> pa.Table:
    """Steps 1 and 2 in a bucket: 0 for a key that has one run, 1 for one that has several, 2 for a hot one."""
    n = table.column("n").to_pylist()
    keys = np.concatenate([np.frombuffer(k, np.uint64) for k in table.column("keys").to_pylist()])
    counts = np.concatenate([unpack(c, m, np.uint16) for c, m in zip(table.column("counts").to_pylist(), n, strict=True)])
    _, inverse = np.unique(keys, return_inverse=True)
    total = np.bincount(inverse, counts)[inverse]
    flags = np.split(((total > 1) + (total > HOT).astype(np.uint8)).astype(np.uint8), np.cumsum(n)[:-1])
    hot = pa.array([int((f == 2).sum()) for f in flags], pa.int32())
    return pa.table({"blk": table.column("blk"), "p": table.column("p"), "n": table.column("n"), "flags": [pack(f) for f in flags], "hot": hot}, schema=FLAGS)


def flags_of(keys: np.ndarray, answers: dict[int, tuple[int, bytes]], buckets: int) -> np.ndarray:
    """What the buckets answered for each of the keys, which are all that the block asked for."""
    u, inverse = np.unique(keys, return_inverse=True)
    flag = np.zeros(len(u), np.uint8)
    for p, at in by_bucket(u, buckets):
        flag[at] = unpack(answers[p][1], answers[p][0], np.uint8)
    return flag[inverse]


def told(answers: pa.Table) -> dict[int, tuple[int, bytes]]:
    return {p: (n, f) for p, n, f in zip(*(answers.column(c).to_pylist() for c in ("p", "n", "flags")), strict=True)}


def found_runs(raw: bytes, starts: np.ndarray, ends: np.ndarray, answers: pa.Table, buckets: int) -> tuple[np.ndarray, ...] | None:
    """Key, content, first and last window and flag of a block's runs, then hash and start of the windows of hot ones; None without runs."""
    chunks = list(runs(np.frombuffer(raw, np.uint8), starts, ends)) if len(raw) >= LENGTH else []
    if not sum(len(c[0]) for c in chunks):
        return None
    flag = flags_of(np.concatenate([c[0] for c in chunks]), told(answers), buckets)
    hashes, windows = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for (_, _, a, z, hash_of), f in zip(chunks, np.split(flag, np.cumsum([len(c[0]) for c in chunks])[:-1]), strict=True):
        if (f == 2).any():
            windows.append(_flat(a[f == 2], (z - a + 1)[f == 2]))
            hashes.append(hash_of(windows[-1]))
    return (*(np.concatenate([c[i] for c in chunks]) for i in range(4)), flag, np.concatenate(hashes), np.concatenate(windows))


def send_windows(table: pa.Table, answers: pa.Table, buckets: int) -> pa.Table:
    """Step 2 in a block: the hashes of hot keys' windows."""
    if not table.num_rows:
        return KEYS.empty_table()
    found = found_runs(*joined(table), answers, buckets)
    if found is None or not len(found[5]):
        return KEYS.empty_table()
    u = np.unique(found[5])
    return key_rows(table.column("blk")[0].as_py(), u, np.ones(len(u), np.uint16), buckets)


def distinct(raw: bytes, key: np.ndarray, content: np.ndarray, a: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Of which of the strings raw[a:end] an earlier one of the same key has the same bytes; strings are in the corpus's order."""
    order = np.lexsort((a, content, key))
    maybe = np.flatnonzero((key[order[1:]] == key[order[:-1]]) & (content[order[1:]] == content[order[:-1]]))
    x, y = order[maybe], order[maybe + 1]
    same = [raw[p:q] == raw[r:s] for p, q, r, s in zip(a[x].tolist(), end[x].tolist(), a[y].tolist(), end[y].tolist(), strict=True)]
    again = np.zeros(len(key), bool)
    again[y[np.array(same, bool)]] = True
    return again


def send_runs(table: pa.Table, answers: pa.Table, windows: pa.Table | None, buckets: int) -> pa.Table:
    """Step 3 in a block. Rows of kind 2 have the repeats found within the block, which a bucket passes on."""
    if not table.num_rows:
        return RUNS.empty_table()
    raw, starts, ends = joined(table)
    found = found_runs(raw, starts, ends, answers, buckets)
    if found is None:
        return RUNS.empty_table()
    key, content, a, z, flag, hashes, at = found
    end, cold = z + LENGTH, flag < 2
    key, content, a, end, flag = key[cold], content[cold], a[cold], end[cold], flag[cold]
    if len(hashes):
        key, content = np.concatenate((key, hashes)), np.concatenate((content, hashes))
        a, end = np.concatenate((a, at)), np.concatenate((end, at + LENGTH))
        flag = np.concatenate((flag, flags_of(hashes, told(windows), buckets)))
    again = distinct(raw, key, content, a, end)
    blk, rows = table.column("blk")[0].as_py(), []
    order = in_order(table)
    ids, th = doc_ids(table)[order], table.column("th").to_numpy()[order]
    sent = np.flatnonzero((flag > 0) & ~again)
    for p, part in by_bucket(key[sent], buckets):
        i = sent[part]
        d = np.searchsorted(starts, a[i], side="right") - 1
        data = b"".join([raw[x:y] for x, y in zip(a[i].tolist(), end[i].tolist(), strict=True)])
        rows.append((blk, p, 0, len(i), key[i].tobytes(), pack(ids[d]), pack(th[d]), pack(a[i]), pack((end - a)[i].astype(np.int32)), len(data), pa.compress(data, codec="zstd", asbytes=True)))
    if again.any():
        x, y = merged(a[again], end[again], starts)
        rows.append((blk, blk % buckets, 2, len(x), b"", b"", b"", pack(x), pack(y), 0, b""))
    return pa.Table.from_pylist([dict(zip(RUNS.names, r, strict=True)) for r in rows], RUNS)


def split_at(starts: np.ndarray, ends: np.ndarray, a: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches cut where the texts with these starts and ends meet: text, start and end of each part."""
    i = np.searchsorted(ends, a, side="right")
    times = np.searchsorted(ends, end - 1, side="right") - i + 1
    at = _flat(i, times)
    a, end = np.maximum(np.repeat(a, times), starts[at]), np.minimum(np.repeat(end, times), ends[at])
    whole = a < end  # not of the empty texts between
    return at[whole], a[whole], end[whole]


def merged(a: np.ndarray, end: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches in order, those of one document that overlap or touch as one."""
    if not len(a):
        return a.astype(np.int64), end.astype(np.int64)
    order = np.argsort(a, kind="stable")
    a, end = a[order].astype(np.int64), np.maximum.accumulate(end[order]).astype(np.int64)  # no stretch ends beyond its document
    d = np.searchsorted(starts, a, side="right")
    new = np.flatnonzero(np.concatenate(([True], (a[1:] > end[:-1]) | (d[1:] != d[:-1]))))
    return a[new], np.append(end[new[1:] - 1], end[-1])


def repeated_windows(parts: list[bytes], group: np.ndarray, document: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each byte of the joined parts: is it in a window that an earlier window of the same group equals?

    document and start: each part's document, as a whole number in the corpus's order, and where it starts.
    Groups are whole numbers in ascending order.
    """
    sizes = np.array([len(p) for p in parts])
    of_group = np.flatnonzero(np.diff(group, prepend=-1))
    raw = np.frombuffer(b"".join(parts), np.uint8)
    # one symbol before all texts; after each part a 1, or a 0 after a group's last part
    at = 1 + np.cumsum(sizes + 1) - sizes - 1
    text = np.ones(1 + len(raw) + len(parts), np.int16)
    bytes_at = _flat(at, sizes)
    text[bytes_at] = raw.astype(np.int16) + 2
    ends = at + sizes
    text[ends[np.append(of_group[1:], len(parts)) - 1]] = 0
    sa = suffix_arrays(text, at[of_group])
    n_windows = np.maximum(0, sizes - LENGTH + 1)
    starts = np.zeros(len(text), bool)
    starts[_flat(at, n_windows)] = True
    s = sa[1:]
    s = s[starts[s]]
    part_of = np.zeros(len(text), np.int64)
    part_of[bytes_at] = np.repeat(np.arange(len(parts)), sizes)
    words = np.zeros(len(text) + 8, np.uint64)
    words[bytes_at] = raw
    for m in (1, 2, 4):
        words[:-m] |= words[m:] << np.uint64(8 * m)
    a, b = s[:-1], s[1:]
    same = np.flatnonzero(group[part_of[a]] == group[part_of[b]])
    for o in (*range(0, LENGTH - 7, 8), LENGTH - 8):
        same = same[words[a[same] + o] == words[b[same] + o]]
    starts_class = np.ones(len(s), bool)
    starts_class[same + 1] = False
    # in the corpus's order: a part's windows lie one after the other
    by_start = np.lexsort((s - at[part_of[s]] + start[part_of[s]], document[part_of[s]]))
    where = np.empty(len(s), np.int64)
    where[by_start] = np.arange(len(s))
    cut = np.flatnonzero(starts_class)
    covered = np.zeros(len(text) + LENGTH + 1, np.int64)
    if len(s):
        earliest = np.repeat(np.minimum.reduceat(where, cut), np.diff(np.append(cut, len(s))))
        late = s[where != earliest]
        np.add.at(covered, late, 1)
        np.add.at(covered, late + LENGTH, -1)
    return (np.cumsum(covered)[: len(text)] > 0)[bytes_at]


def find_repeats(table: pa.Table) -> pa.Table:
    """Step 4 in a bucket: repeated stretches, packed for each block."""
    col = {c: table.column(c).to_pylist() for c in RUNS.names}
    own = [i for i, k in enumerate(col["kind"]) if k == 0]
    blk_out, a_out, end_out = [], [], []
    for i, k in enumerate(col["kind"]):
        if k == 2:
            blk_out.append(np.full(col["n"][i], col["blk"][i]))
            a_out.append(unpack(col["starts"][i], col["n"][i], np.int64))
            end_out.append(unpack(col["sizes"][i], col["n"][i], np.int64))
    if own:
        n = [col["n"][i] for i in own]
        get = lambda c, dtype: np.concatenate([unpack(col[c][i], col["n"][i], dtype) for i in own])
        key = np.concatenate([np.frombuffer(col["keys"][i], np.uint64) for i in own])
        ids, th, a, size = get("ids", np.int64), get("hashes", np.int64), get("starts", np.int64), get("sizes", np.int32)
        blk = np.repeat([col["blk"][i] for i in own], n)
        data = b"".join(pa.decompress(col["data"][i], col["n_data"][i], codec="zstd", asbytes=True) for i in own)
        cut = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
        parts = [data[x:y] for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        del data
        # equal runs: all but the first are repeats as a whole
        by = np.lexsort((a, blk, th, ids, np.fromiter(map(hash, parts), np.int64, len(parts)), key))
        again = np.zeros(len(by), bool)
        same = np.flatnonzero(key[by[1:]] == key[by[:-1]])
        again[same + 1] = [parts[x] == parts[y] for x, y in zip(by[same].tolist(), by[same + 1].tolist(), strict=True)]
        late = by[again]
        blk_out.append(blk[late])
        a_out.append(a[late])
        end_out.append(a[late] + size[late])
        by = by[~again]
        # the corpus's order: a whole number for each block's document, then the place
        corpus = np.lexsort((a, blk, th, ids))
        place = np.empty(len(corpus), np.int64)
        place[corpus] = np.cumsum(np.concatenate(([0], (ids[corpus[1:]] != ids[corpus[:-1]]) | (th[corpus[1:]] != th[corpus[:-1]]) | (blk[corpus[1:]] != blk[corpus[:-1]]))))
        k = key[by]
        first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        count = np.diff(np.append(first, len(k)))
        total = np.add.reduceat(size[by] + 1, first)
        several = np.flatnonzero(count > 1)
        several = several[np.argsort(total[several], kind="stable")]  # texts of similar length in a batch
        for part in np.split(several, np.searchsorted(np.cumsum(total[several]), np.arange(BATCH, total[several].sum(), BATCH))) if len(several) else ():
            if not len(part):
                continue
            r = by[_flat(first[part], count[part])]
            hit = repeated_windows([parts[i] for i in r.tolist()], np.repeat(np.arange(len(part)), count[part]), place[r], a[r])
            edge = np.flatnonzero(np.diff(hit, prepend=False, append=False))
            ends = np.cumsum(size[r])
            i, x, y = split_at(ends - size[r], ends, edge[::2], edge[1::2])  # a stretch may go on in the next run of the batch
            begin = a[r][i] - (ends - size[r])[i]
            blk_out.append(blk[r][i])
            a_out.append(begin + x)
            end_out.append(begin + y)
    blk, a, end = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (blk_out, a_out, end_out))
    order = np.argsort(blk, kind="stable")
    rows = []
    for part in np.split(order, np.flatnonzero(np.diff(blk[order])) + 1) if len(order) else ():
        x, y = merged(a[part], end[part], np.empty(0, np.int64))
        rows.append({"blk": int(blk[part[0]]), "n": len(x), "starts": pack(x), "ends": pack(y)})
    return pa.Table.from_pylist(rows, STRETCHES)


def cut_out(table: pa.Table, stretches: pa.Table) -> tuple[list[bytes], list[bytes], np.ndarray]:
    """Step 5 in a block: each document's text, what is left of it, and the number of removed runs; in order."""
    raw, starts, ends = joined(table)
    get = lambda c: np.concatenate([np.empty(0, np.int64), *(unpack(b, n, np.int64) for b, n in zip(stretches.column(c).to_pylist(), stretches.column("n").to_pylist(), strict=True))])
    x, y = get("starts"), get("ends")
    _, x, y = split_at(starts, ends, x, y)  # those of neighbouring documents may have been joined
    x, y = merged(x, y, starts)
    spans = np.bincount(np.searchsorted(ends, x, side="right"), minlength=len(starts)) if len(x) else np.zeros(len(starts), np.int64)
    cut = np.concatenate(([0], np.cumsum(spans))).tolist()
    x, y = x.tolist(), y.tolist()
    texts, kept = [], []
    for k, (s, e) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        edges = [s, *(v for p in zip(x[cut[k] : cut[k + 1]], y[cut[k] : cut[k + 1]], strict=True) for v in p), e]
        texts.append(raw[s:e])
        kept.append(b"".join([raw[p:q] for p, q in zip(edges[::2], edges[1::2], strict=True)]))
    return texts, kept, spans


_L, _I, _B = pa.int64(), pa.int32(), pa.binary()
KEYS = pa.schema([("blk", _L), ("p", _L), ("n", _I), ("keys", _B), ("counts", _B)])
FLAGS = pa.schema([("blk", _L), ("p", _L), ("n", _I), ("flags", _B), ("hot", _I)])
RUNS = pa.schema([("blk", _L), ("p", _L), ("kind", _I), ("n", _I), ("keys", _B), ("ids", _B), ("hashes", _B), ("starts", _B), ("sizes", _B), ("n_data", _L), ("data", _B)])
STRETCHES = pa.schema([("blk", _L), ("n", _I), ("starts", _B), ("ends", _B)])
_SQL = {_L: "long", _I: "int", _B: "binary"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_SQL[f.type]}" for f in schema)


def find_stretches(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents in blocks (blk, doc_id, th, raw, and all columns in row), and the repeated stretches of each block."""
    _, total = n_rows_bytes(docs)
    blocks = max(1, -(-total // BLOCK_BYTES))
    buckets = max(1, min(MOST_BUCKETS, -(-total // BUCKET_BYTES)))
    raw = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    blk = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks))
    dealt = docs.select(blk.alias("blk"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), raw.alias("raw"), F.struct(*docs.columns).alias("row"))
    by_block = dealt_by(dealt.drop("row"), "blk", total).groupBy("blk")
    by_bucket_ = lambda df: dealt_by(df, "p", total).groupBy("p")
    keys = by_block.applyInArrow(lambda t: send_keys(t, buckets), _ddl(KEYS))
    flags = written(by_bucket_(keys).applyInArrow(answer_keys, _ddl(FLAGS)), "key-flags", packed=True)
    if flags.where("hot > 0").limit(1).count():
        asked = by_block.cogroup(flags.groupBy("blk")).applyInArrow(lambda t, f: send_windows(t, f, buckets), _ddl(KEYS))
        windows = written(by_bucket_(asked).applyInArrow(answer_keys, _ddl(FLAGS)), "window-flags", packed=True)
        both = flags.withColumn("hot", F.lit(0)).unionByName(windows.withColumn("hot", F.lit(1)))
        sent = by_block.cogroup(both.groupBy("blk")).applyInArrow(lambda t, f: send_runs(t, f.filter(pa.compute.equal(f.column("hot"), 0)), f.filter(pa.compute.equal(f.column("hot"), 1)), buckets), _ddl(RUNS))
    else:
        windows = None
        sent = by_block.cogroup(flags.groupBy("blk")).applyInArrow(lambda t, f: send_runs(t, f, None, buckets), _ddl(RUNS))
    stretches = written(by_bucket_(sent).applyInArrow(find_repeats, _ddl(STRETCHES)), "stretches", packed=True)
    drop_table(*(t for t in (flags, windows) if t is not None))
    return dealt_by(dealt, "blk", total), stretches


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (binary), one row per row of docs.

    Null texts count as empty. Texts of under 100 bytes stay whole.
    """
    dealt, stretches = find_stretches(docs.select("doc_id", "text"))

    def run(t: pa.Table, s: pa.Table) -> pa.Table:
        if not t.num_rows:
            return out.empty_table()
        texts, kept, spans = cut_out(t, s)
        sizes, left = np.array([len(x) for x in texts]), np.array([len(x) for x in kept])
        return pa.table({"doc_id": t.column("doc_id").take(in_order(t)), "n_bytes": sizes, "n_removed": sizes - left, "n_spans": spans, "kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept], "kept": kept}, schema=out)

    out = pa.schema([("doc_id", _L), ("n_bytes", _L), ("n_removed", _L), ("n_spans", _L), ("kept_sha256", pa.string()), ("kept", _B)])
    return dealt.drop("row").groupBy("blk").cogroup(stretches.groupBy("blk")).applyInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with the repeats cut out of text (bytes of characters cut in two go); n_chars is counted anew, other columns stay.

    Every document stays, if with an empty text; a null text stays null.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    dealt, stretches = find_stretches(docs)
    names, schema, empty = docs.columns, docs.schema, to_arrow_schema(docs.schema).empty_table()

    def run(t: pa.Table, s: pa.Table) -> pa.Table:
        if not t.num_rows:
            return empty
        row = t.column("row").combine_chunks().take(pa.array(in_order(t)))
        columns = {c: row.field(c) for c in names}
        kept = pa.array([k.decode("utf-8", "ignore") for k in cut_out(t, s)[1]], pa.string())
        columns["text"] = pa.compute.if_else(pa.compute.is_null(columns["text"]), None, kept)
        if "n_chars" in columns:
            columns["n_chars"] = pa.compute.utf8_length(columns["text"]).cast(columns["n_chars"].type)
        return pa.table(columns)

    return dealt.groupBy("blk").cogroup(stretches.groupBy("blk")).applyInArrow(run, schema)


def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(documents(spark, sf_dir, "doc_id", "text")).drop("kept")


OP1_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS i FROM d)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM w) WHERE k > 1),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM
  (SELECT doc_id, i, (i - lag(i, 1, -1000) OVER (PARTITION BY doc_id ORDER BY i) > 100)::INT AS new FROM late)) GROUP BY doc_id, run),
cut AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM runs),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS k, max(b) AS b, sum(b - a)::BIGINT AS gone, count(*) AS spans FROM cut JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k || substr(h, 2 * kept.b + 1), h))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
