"""A context-mixing range coder for token ids, many blocks at a time.

A file codes ids as ranks by frequency. It holds independent blocks of BLOCK ids; each starts with
fresh adaptive models and has a checksum, so with the file's tables any block decodes alone. An id is predicted by
what followed the last two ids in the block (order 2: one id with a confidence, adaptive), by a
distribution over what followed the last one in the file (order 1: frequent ids have contexts of their own, others
share one by octaves of ranks; ids seen too rarely there leave their share to an escape), and after an escape by a
distribution over all ids (order 0). Adaptive chances, one for each confidence, weigh order 2 against the others. One
coding step tells that order 2 is right, or else the id or the escape; a second step, after an escape only, tells the id.

GROUP blocks are coded in step: numpy handles position k of all of them at once, and memory is that of one
group beside the ids and the file's tables. The coder keeps a low and a width of 63 bits, and puts out 32 bits when the
width falls under 2^31; low has a bit more for a carry, which goes out with them and into the words before at the end.

File: magic, u32 ids, u32 blocks, u32 distinct ids, u32 bytes and u32 crc of the packed tables, the tables
(zlib of u32 ids by rank, u32 scaled counts, u32 own contexts and u32 all, then for each context u8 bits of its total and u32 successors, then the
successors, each less the one before, and the u16 shares, the escape's first); then for each block u32 ids, u32 words, u32 crc; then the words.
"""

from __future__ import annotations

import zlib

import numpy as np

MAGIC = b"TOKRC04\n"
BLOCK, GROUP = 4096, 2048
#: Bits of a block's order-2 table, and of a confidence in it.
SLOTS2, SURE = 12, 3
#: Most counters of pairs (contexts x distinct ids), and how often an id must come to have a context of its own.
PAIRS, FREQUENT = 1 << 24, 64
#: How often an id must follow a context to be listed there, and bits of the largest and the least total of a context.
LISTED, MOST_BITS, LEAST_BITS = 3, 12, 4
#: Bits of the weight of order 2 and of its adaptive chance, and how fast that moves.
WEIGHT, CHANCE, SPEED = 6, 16, 5
#: About what the scaled counts of all ids add up to, beside one for each id.
IDS_SCALE = 1 << 22
_U = np.uint64
_TOTAL = MOST_BITS + WEIGHT
_WORD, _LEAST, _ALL = 32, 1 << 31, (1 << 63) - 1
_DOWN, _REST = _U(31), _U((1 << 31) - 1)
#: Positions between looks at whether the words still have room; an id takes at most two words.
ROOM = 64
#: A start and a share in one number (and above them, in decoding, the rank and 1).
_SHARE, _START = MOST_BITS + 1, 2 * MOST_BITS + 1
_SHARES, _STARTS = (1 << _SHARE) - 1, (1 << MOST_BITS) - 1
_ESCAPE = np.int32(1 << _START)
#: What a chance gains, less its share of itself, where order 2 is right or wrong: so much that no weight becomes 0 or all.
_RIGHT, _WRONG = (1 << CHANCE - SPEED) - 1, 1 << CHANCE - WEIGHT - SPEED
#: What a confidence gains where order 2 is wrong, and where it is right; a wrong one of 1 or none makes room.
_SURER = np.array([-1] * (1 << SURE) + [1] * ((1 << SURE) - 1) + [0]).astype(np.uint32)


def _bucket_of(rank: np.ndarray) -> np.ndarray:
    """Ranks 0 to 3 have their own buckets, then each octave has four."""
    r = rank.astype(np.int64)
    k = np.maximum(np.frexp(np.maximum(r, 1).astype(np.float64))[1] - 3, 0)
    return np.where(r < 4, r, 4 * k + (r >> k))


class _Tables:
    """The file's distributions. Entries of all contexts lie in a row, the escape of each first; a context's shares add up to 1 << MOST_BITS."""

    def __init__(self, weights: np.ndarray, own: int, bits: np.ndarray, listed: np.ndarray, after: np.ndarray, share: np.ndarray):
        n, self.bits, self.share = max(len(weights), 1), bits.astype(np.int64), share.astype(np.int64)
        size = listed.astype(np.int64) + 1
        ends = np.cumsum(size)
        self.first = ends - size
        is_id = np.ones(len(share), bool)
        is_id[self.first] = False
        self.rank = np.full(len(share), -1, np.int64)
        self.rank[is_id] = after
        of = np.repeat(np.arange(len(size)), size)
        down = MOST_BITS - self.bits
        self.context = np.minimum(own + _bucket_of(np.arange(n)), len(size) - 1)
        self.context[:own] = np.arange(min(own, n))
        start = np.cumsum(self.share) - self.share
        self.lookup_at = start[self.first]  # of each context among all slots
        self.packed = (start - self.lookup_at[of]) << down[of] + _SHARE | self.share << down[of]
        self.below = np.concatenate([[0], np.cumsum(weights, dtype=np.int64)])


def _counted(ranks: np.ndarray, count: np.ndarray, block: int) -> tuple[_Tables, bytes, np.ndarray, np.ndarray]:
    """(tables, their bytes, where the pairs of each rank as a context are, start and share of each pair; those of an escape have a bit above)."""
    distinct = len(count)
    shared = int(_bucket_of(np.array([distinct]))[0]) + 1
    own = min(int((count >= FREQUENT).sum()), PAIRS // max(distinct, 1) - shared)
    if own < 0:
        own, shared = 0, 0  # too many ids to count pairs of them: one context, of an escape only
    weights = np.maximum((count * min(1.0, IDS_SCALE / max(len(ranks), 1))).astype(np.int64), 1)
    if shared:
        context = own + _bucket_of(np.arange(distinct))
        context[:own] = np.arange(own)
        rows, at = own + shared, context * distinct
        before = np.empty_like(ranks)
        before[1:] = ranks[:-1]
        before[::block] = 0  # a block begins as after rank 0
        pairs = at[before]
        pairs += ranks
        pairs = np.bincount(pairs, minlength=rows * distinct).astype(np.int32)
        pairs = pairs.reshape(rows, distinct)
        total = pairs.sum(1, dtype=np.int64)
    else:
        rows, at, pairs, total = 1, np.zeros(distinct, np.int64), np.zeros((1, 1), np.int32), np.zeros(1, np.int64)
    bits = np.clip(np.frexp(np.maximum(total, 1).astype(np.float64))[1], LEAST_BITS, MOST_BITS)
    of, after = np.nonzero(pairs >= np.maximum(LISTED, np.ceil(1.5 * total / (1 << bits)))[:, None])
    times = pairs[of, after].astype(np.int64)
    listed = np.bincount(of, minlength=rows)
    sums = np.cumsum(np.concatenate([[0], times]))
    last = np.cumsum(listed)
    seen = sums[last] - sums[last - listed]
    first = last - listed + np.arange(rows)
    own_count = np.zeros(len(of) + rows, np.int64)
    is_id = np.ones(len(own_count), bool)
    is_id[first] = False
    own_count[first], own_count[is_id] = np.maximum(total - seen, 0), times
    # ends of the shares: in proportion, with 1 more for each entry
    row = np.repeat(np.arange(rows), listed + 1)
    upto = np.cumsum(own_count)
    upto -= (upto[first] - own_count[first])[row]
    ends = upto * ((1 << bits) - listed - 1)[row] // np.maximum(total, 1)[row] + np.arange(len(row)) - first[row] + 1
    ends[last + np.arange(rows)] = 1 << bits
    share = np.diff(ends, prepend=0)
    share[first] = ends[first]
    step = np.diff(after, prepend=0)
    start = (last - listed)[listed > 0]
    step[start] = after[start]
    kind = "<u2" if distinct <= 1 << 16 else "<u4"
    packed = b"".join((weights.astype("<u4").tobytes(), np.array([own], "<u4").tobytes(), np.array([rows], "<u4").tobytes(), bits.astype(np.uint8).tobytes(), listed.astype("<u4").tobytes(), step.astype(kind).tobytes(), share.astype("<u2").tobytes()))
    tables = _Tables(weights, own, bits, listed, after, share)
    coded = tables.packed.astype(np.int32)
    if shared:
        coded_as = np.repeat(coded[first] | _ESCAPE, distinct)
        coded_as[of * distinct + after] = coded[is_id]
    else:
        coded_as = np.full(max(distinct, 1), coded[0] | _ESCAPE, np.int32)
    return tables, packed, at, coded_as


def _unpacked(raw: bytes, distinct: int) -> tuple[np.ndarray, _Tables]:
    """(ids by rank, tables)."""
    at = 0

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(raw, kind, n, at)
        at += out.nbytes
        return out

    table, weights, (own, rows) = take("<u4", distinct), take("<u4", distinct), take("<u4", 2).tolist()
    bits, listed = take("u1", rows), take("<u4", rows).astype(np.int64)
    step, share = take("<u2" if distinct <= 1 << 16 else "<u4", int(listed.sum())).astype(np.int64), take("<u2", int(listed.sum()) + rows)
    after = np.cumsum(step)
    ends = np.cumsum(listed)
    after -= np.repeat(np.concatenate([[0], after])[ends - listed], listed)
    return table, _Tables(weights, own, bits, listed, after, share)


class _Models:
    """What coder and decoder both know at a position; one lane a block."""

    def __init__(self, lanes: int, distinct: int):
        self.base = np.arange(lanes) << SLOTS2
        self.kind = np.uint16 if distinct <= 1 << 16 - SURE else np.uint32
        self.seen = np.zeros(lanes << SLOTS2, self.kind)  # rank << SURE | confidence; 0 is none
        self.at = np.arange(lanes) << SURE
        self.chance = np.tile((np.array([1, 14, 22, 28, 36, 44, 52, 58]) << CHANCE - WEIGHT).astype(np.int32), lanes)
        self.h1, self.h2 = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)

    def look(self, n: int) -> None:
        """Order 2's id and weight (of 1 << WEIGHT) in the first n lanes."""
        h = self.h1[:n] + self.h2[:n]
        h >>= np.uint32(32 - SLOTS2)
        self.slot = self.base[:n] + h
        self.entry = self.seen.take(self.slot).astype(np.uint32, copy=False)
        self.said = self.entry >> np.uint32(SURE)
        self.sure = self.entry & np.uint32((1 << SURE) - 1)
        self.row = self.at[:n] + self.sure
        self.now = self.chance.take(self.row)
        self.weight = (self.now >> np.int32(CHANCE - WEIGHT)).astype(np.int64)

    def learn(self, hit: np.ndarray, rank: np.ndarray) -> None:
        n, right = len(rank), hit.astype(np.int32)
        aim = right * np.int32(_RIGHT - _WRONG)
        aim += np.int32(_WRONG)
        aim += self.now
        aim -= self.now >> np.int32(SPEED)
        self.chance[self.row] = aim
        right <<= np.int32(SURE)
        right += self.sure.view(np.int32)
        new = rank << np.uint32(SURE)
        new += np.uint32(1)
        self.entry += _SURER.take(right)
        self.seen[self.slot] = np.where(right > 1, self.entry, new).astype(self.kind, copy=False)
        np.multiply(self.h1[:n], np.uint32(3266489917), out=self.h2[:n])
        np.multiply(rank, np.uint32(2654435761), out=self.h1[:n])


def _table(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids by falling count, their counts, the rank of each of ids)."""
    if len(ids) and int(ids.max()) < 1 << 20:
        times = np.bincount(ids)
        values = np.flatnonzero(times)
        count, inverse = times[values], None
    else:
        values, inverse, count = np.unique(ids, return_inverse=True, return_counts=True)
    order = np.lexsort((values, -count))
    rank_of = np.empty(len(values) if inverse is not None else int(values[-1]) + 1 if len(values) else 0, np.uint32)
    rank_of[order if inverse is not None else values[order]] = np.arange(len(order), dtype=np.uint32)
    return values[order].astype("<u4"), count[order], rank_of[ids if inverse is None else inverse.ravel()]


def encode(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """The file that holds ids (any unsigned 32-bit integers); decode() gives them back."""
    ids = np.ascontiguousarray(ids, np.uint32)
    table, count, ranks = _table(ids)
    tables, packed, at, coded = _counted(ranks, count, block)
    packed = zlib.compress(table.tobytes() + packed, 6)
    lanes = -(-len(ids) // block)
    head = np.array([len(ids), lanes, len(table), len(packed), zlib.crc32(packed)], "<u4")
    rows, parts = [], []
    for a in range(0, lanes, GROUP):
        part = ranks[a * block : (a + GROUP) * block]
        for k, words in enumerate(_encode(part, min(GROUP, lanes - a), block, tables, at, coded)):
            rows.append((min(block, len(part) - k * block), len(words) // 4, zlib.crc32(words)))
            parts.append(words)
    return b"".join([MAGIC, head.tobytes(), packed, np.array(rows, "<u4").reshape(-1, 3).tobytes(), *parts])


def _encode(ranks: np.ndarray, lanes: int, block: int, tables: _Tables, at: np.ndarray, coded: np.ndarray) -> list[bytes]:
    """The words of each block; all blocks but the last are full."""
    m = _Models(lanes, len(tables.context))
    low, width = np.zeros(lanes, np.uint64), np.full(lanes, _ALL)
    out = np.zeros((lanes, block // 4 + 3 * ROOM), np.int64)
    flat = out.ravel()
    to = np.arange(lanes) * out.shape[1]  # where each lane's next word goes in flat
    padded = np.zeros(lanes * block, np.uint32)
    padded[: len(ranks)] = ranks
    steps = np.ascontiguousarray(padded.reshape(lanes, block).T)
    del padded
    last = len(ranks) - (lanes - 1) * block  # ids in the last lane
    all_ids = int(tables.below[-1])

    def put(go: np.ndarray, now: np.ndarray) -> None:
        place = to.take(go)
        flat[place] = (now >> _DOWN).view(np.int64)
        to[go] = place + 1
        now &= _REST
        now <<= _U(_WORD)
        low[go] = now

    def settle(go: np.ndarray) -> None:
        if len(go):
            put(go, low.take(go))
            width[go] = width.take(go) << _WORD

    for i in range(block):
        n = lanes if i < last else lanes - 1
        if not n:
            break
        if i % ROOM == 0:
            used = to - np.arange(lanes) * out.shape[1]
            if int(used.max()) + 2 * ROOM + 4 > out.shape[1]:
                out = np.concatenate([out, np.zeros_like(out)], 1)
                flat = out.ravel()
                to = np.arange(lanes) * out.shape[1] + used
        rank = steps[i, :n]
        place = at.take(steps[i - 1, :n]) if i else np.full(n, at[0] if len(at) else 0)  # a block begins as after rank 0
        place += rank
        e = coded.take(place).astype(np.int64)
        m.look(n)
        hit = rank == m.said
        two = m.weight << MOST_BITS
        rest = (1 << WEIGHT) - m.weight
        r = width[:n] >> _TOTAL
        start = e >> _SHARE
        start &= _STARTS
        start *= rest
        start += two
        rest *= e & _SHARES
        right = hit.nonzero()[0]
        start[right] = 0
        rest[right] = two.take(right)
        start *= r
        low[:n] += start.view(np.uint64)
        r *= rest
        width[:n] = r
        settle((r < _LEAST).nonzero()[0])
        esc = ((e >= _ESCAPE) > hit).nonzero()[0]
        if len(esc):
            own = rank.take(esc)
            r = width.take(esc) // all_ids
            below = tables.below.take(own)
            low[esc] = low.take(esc) + (below * r).view(np.uint64)
            r *= tables.below.take(own + 1) - below
            width[esc] = r
            settle(esc[r < _LEAST])
        m.learn(hit, rank)
    for _ in range(2):  # the rest of low
        put(np.arange(lanes), low.copy())
    used = to - np.arange(lanes) * out.shape[1]
    columns = np.ascontiguousarray(out[:, : int(used.max())].T)
    for k in range(len(columns) - 1, 0, -1):  # carries go into the words before
        columns[k - 1] += columns[k] >> _WORD
    words = np.ascontiguousarray(columns.astype("<u4").T)
    return [words[k, :n].tobytes() for k, n in enumerate(used.tolist())]


def decode(data: bytes) -> np.ndarray:
    """The ids of a file. A damaged file raises ValueError."""
    if data[:8] != MAGIC:
        raise ValueError("not a token file")
    total, lanes, distinct, size, crc = np.frombuffer(data, "<u4", 5, 8).tolist()
    packed = data[28 : 28 + size]
    if zlib.crc32(packed) != crc:
        raise ValueError("the rank table is damaged")
    table, tables = _unpacked(zlib.decompress(packed), distinct)
    at = 28 + size
    rows = np.frombuffer(data, "<u4", 3 * lanes, at).reshape(-1, 3).astype(np.int64)
    at += 12 * lanes
    if int(rows[:, 0].sum()) != total:
        raise ValueError("the block lengths are damaged")
    ends = at + 4 * np.cumsum(rows[:, 1])
    for k, (a, b) in enumerate(zip((ends - 4 * rows[:, 1]).tolist(), ends.tolist(), strict=True)):
        if zlib.crc32(data[a:b]) != rows[k, 2]:
            raise ValueError(f"block {k} is damaged")
    out = np.empty(total, np.uint32)
    done = 0
    for a in range(0, lanes, GROUP):
        part = rows[a : a + GROUP]
        words = np.zeros((len(part), int(part[:, 1].max()) + 2), "<u4")
        for k, (end, n) in enumerate(zip(ends[a : a + GROUP].tolist(), part[:, 1].tolist(), strict=True)):
            words[k, :n] = np.frombuffer(data, "<u4", n, end - 4 * n)
        n = int(part[:, 0].sum())
        out[done : done + n] = table[_decode(words, part[:, 0], tables)]
        done += n
    return out


def _quotient(code: np.ndarray, r: np.ndarray) -> np.ndarray:
    """code // r, where it is under 2^31: by doubles, then mended where that is one off."""
    v = (code / r).astype(np.int64)
    left = code - v * r
    off = np.flatnonzero(left.view(np.uint64) >= r.view(np.uint64))
    if len(off):
        v[off] = code[off] // r[off]
    return v


def _decode(words: np.ndarray, lengths: np.ndarray, tables: _Tables) -> np.ndarray:
    """The ranks of blocks from their words."""
    lanes, block = len(words), int(lengths[0])
    m = _Models(lanes, len(tables.context))
    width = np.full(lanes, _ALL)
    code = words[:, 0].astype(np.int64) << 31 | words[:, 1] >> 1  # less low, so under width
    words = words[:, 1:-1] << 31 | words[:, 2:] >> 1  # the window is a bit short of two words
    read = np.arange(lanes) * words.shape[1]
    flat_words = words.astype(np.int64).ravel()
    steps = np.zeros((block, lanes), np.uint32)
    last = int(lengths[-1])
    lookup = np.repeat(np.arange(len(tables.share), dtype=np.int32), tables.share)
    entries = (tables.rank + 1) << _START | tables.packed
    slots = (tables.lookup_at << 4 | MOST_BITS - tables.bits).take(tables.context)
    row = np.full(lanes, slots[0])  # a block begins as after rank 0
    all_ids = int(tables.below[-1])

    def settle(go: np.ndarray) -> None:
        if len(go):
            at = read.take(go)
            code[go] = code.take(go) << _WORD | flat_words.take(at)
            read[go] = at + 1
            width[go] = width.take(go) << _WORD

    for i in range(block):
        n = lanes if i < last else lanes - 1
        if not n:
            break
        m.look(n)
        row = row[:n]
        two = m.weight << MOST_BITS
        rest = (1 << WEIGHT) - m.weight
        r = width[:n] >> _TOTAL
        v = _quotient(code[:n], r)
        v -= two
        hit = v < 0
        # small numbers: a double's quotient is exact
        slot = (np.maximum(v, 0) / rest).astype(np.int64)
        slot >>= row & 15
        row >>= 4
        slot += row
        e = entries.take(lookup.take(slot))
        start = e >> _SHARE
        start &= _STARTS
        start *= rest
        start += two
        rest *= e & _SHARES
        right = hit.nonzero()[0]
        start[right] = 0
        rest[right] = two.take(right)
        start *= r
        code[:n] -= start
        r *= rest
        width[:n] = r
        settle((r < _LEAST).nonzero()[0])
        rank = e >> _START
        rank -= 1
        rank[right] = m.said.take(right)
        esc = (rank < 0).nonzero()[0]
        if len(esc):
            left = code.take(esc)
            r = width.take(esc) // all_ids
            v = np.minimum(left // r, all_ids - 1)
            own = np.searchsorted(tables.below, v, side="right") - 1
            below = tables.below.take(own)
            code[esc] = left - below * r
            r *= tables.below.take(own + 1) - below
            width[esc] = r
            rank[esc] = own
            settle(esc[r < _LEAST])
        steps[i, :n] = rank
        m.learn(hit, rank.astype(np.uint32))
        row = slots.take(rank)
    flat = np.ascontiguousarray(steps.T)
    return np.concatenate([flat[:-1].ravel(), flat[-1, :last]])
