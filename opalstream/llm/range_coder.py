"""An adaptive context-mixing range coder for ids of up to 32 bits, many independent blocks at a time.

An id's probability is a mixture: w2 [id is the one last seen after the two before it] + w1 [... after the
one before it] + w0 p0(id).  p0, order 0, shares its part among the block's distinct ids by their counts so
far, brought up to date after 32, 128, 512 and then every REFRESH ids.  How often in a row orders 2 and 1
have been right and whether they agree choose the weights, which move towards the orders that are right.
The mixture's interval of an id is one piece: those of the two predicted ids come first, then the others' in
ascending order, which are order 0's without these two.

Every block starts from a reset model and stands alone: it begins with its distinct ids, sorted, as
Elias-Fano bits, and the models work on their places in that list.  A group of blocks is coded in step with
NumPy, a lane for each, in whole numbers.  The encoder knows all ids, so it finds what orders 2 and 1 predict
by sorting a block by context; the decoder follows them id by id.  Low and range have 48 bits, words of 16
bits go out, and carries run back through a block's words at its end.
"""

from __future__ import annotations

import struct

import numpy as np

TOTAL, CONTEXTS, REFRESH, RATE = 22, 11, 1024, 5  # log2 of the mixture's unit shares and of order 2's table; ids; a weight's step
LOW_MASK, SMALL = (1 << 48) - 1, 1 << 32
#: What both of two packed weights lose by a shift, without what falls from one into the other.
BOTH = (1 << 32 - RATE) - 1 << 32 | (1 << 32 - RATE) - 1
#: First weights by sureness (0: context not seen, 1: seen, 2 and 3: right once, or more often, since), of 65536: order 2 of all, order 1 of the rest.
FIRST2, FIRST1 = (1000, 20000, 33000, 46000), (1000, 10000, 20000, 33000)
HEAD = struct.Struct("<II")


# --- a block's distinct ids


def pack_sorted(u: np.ndarray) -> bytes:
    """Distinct ids in ascending order: how many, bits of the low parts, low parts, gaps of the high parts in unary."""
    n = len(u)
    low = max(0, int((int(u[-1]) // n)).bit_length() - 1)
    x = u.astype(np.int64)
    lows = (x[:, None] >> np.arange(low - 1, -1, -1) & 1).astype(np.uint8).ravel()
    high = x >> low
    unary = np.zeros(int(high[-1]) + n, np.uint8)
    unary[high + np.arange(n)] = 1
    bits = np.packbits(np.concatenate([lows, unary])).tobytes()
    return HEAD.pack(n << 6 | low, len(bits)) + bits


def unpack_sorted(code: bytes) -> tuple[np.ndarray, int]:
    """The ids and where they end."""
    head, size = HEAD.unpack_from(code)
    n, low = head >> 6, head & 63
    bits = np.unpackbits(np.frombuffer(code, np.uint8, size, HEAD.size))
    lows = bits[: n * low].reshape(n, low).astype(np.int64) @ (1 << np.arange(low - 1, -1, -1, dtype=np.int64)) if low else np.zeros(n, np.int64)
    return ((np.flatnonzero(bits[n * low :])[:n] - np.arange(n)) << low) + lows, HEAD.size + size


# --- models


def context(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Order 2's: the id before and the one before that."""
    return a + b * 0x9E5 & (1 << CONTEXTS) - 1


class Mixer:
    """What coder and decoder share for a group of blocks; distinct: how many ids each has, which are 0 to distinct - 1 here."""

    def __init__(self, distinct: np.ndarray):
        lanes, self.most = len(distinct), int(distinct.max())
        self.distinct, lane = distinct.astype(np.int64), np.arange(lanes)
        self.bits = np.frexp(distinct)[1].astype(np.int64) + np.where(distinct < 2048, 2, 1)  # log2 of a block's slots in order 0
        self.base, self.base_w = lane * (self.most + 1), lane * 32
        self.free = (1 << TOTAL) - (1 << self.bits)
        self.gain = (self.free >> RATE) - 4  # so that weights, rounded, never share out more than is free
        state = np.arange(32)
        w2 = np.array(FIRST2, np.int64)[state >> 2 & 3] * self.free[:, None] >> 16
        w1 = (np.array(FIRST1, np.int64)[state & 3] * (self.free[:, None] - w2) >> 16) * (state >= 16)  # below 16 both predict the same
        self.weights = (w2 << 32 | w1).ravel()  # order 2's and order 1's
        self.kind = np.int32 if self.bits.max() < 15 else np.int64  # that holds a first slot << 16 | slots
        self.counts = np.zeros((lanes, self.most + 1))  # whole numbers, as doubles
        self.slots = np.zeros(self.counts.shape, np.int64)
        self.span = np.zeros(self.counts.size, self.kind)

    def refresh(self, columns: np.ndarray) -> np.ndarray:
        """Adds ids (steps x blocks) to the counts and sets order 0 by them: the first slot << 16 | slots of each id."""
        span, width = self.span.reshape(self.counts.shape), self.most + 1
        for at in range(0, len(span), 32):  # some blocks at a time stay in the cache
            rows = slice(at, at + 32)
            counts, n, all_ = self.counts[rows], self.distinct[rows, None], (1 << self.bits[rows])[:, None]
            if len(columns):
                counts += np.bincount((columns[:, rows] + self.base[: len(n)]).ravel(), minlength=counts.size).reshape(counts.shape)
            place = np.minimum(np.arange(width), n)
            before = np.cumsum(counts, axis=1)
            seen = before[:, -1:].copy()
            before -= counts
            if seen[0, 0]:
                # one slot each, the others by counts: products of doubles, rounded alike everywhere, and exact at the end
                before *= (all_ - n) / seen
                before += 2**-10
                start = before.astype(self.kind)
                start += place.astype(self.kind)
            else:
                start = (place * all_ // n).astype(self.kind)
            slots = self.slots[rows]
            np.subtract(start[:, 1:], start[:, :-1], out=slots[:, :-1])
            start <<= 16
            start |= slots
            span[rows] = start
        return self.span


def refreshed(steps: int) -> list[int]:
    """Where order 0 is brought up to date, and the end."""
    return sorted({0, *(1 << k for k in range(5, REFRESH.bit_length(), 2)), *range(REFRESH, steps, REFRESH)} & set(range(steps))) + [steps]


# --- coder


def _places(ids: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Each block's sorted distinct ids, and all ids as places in their block's."""
    lists, out, top = [], np.empty(ids.shape, np.uint16 if ids.shape[1] <= 1 << 16 else np.uint32), int(ids.max(initial=0)) + 1
    if top > 1 << 18:
        for row, o in zip(ids, out):
            u, o[:] = np.unique(row, return_inverse=True)
            lists.append(u)
        return lists, out
    place = np.zeros(top, out.dtype)
    for row, o in zip(ids, out):
        there = np.zeros(top, bool)
        there[row] = True
        lists.append(u := np.flatnonzero(there))
        place[u] = np.arange(len(u))
        place.take(row, out=o)
    return lists, out


def _followers(x: np.ndarray, ctx: np.ndarray, kind: type) -> np.ndarray:
    """Per place of each block: what followed last after the same context << 2 | sureness; blocks x steps."""
    n = x.shape[1]
    order = np.argsort(ctx, axis=1, kind="stable")
    order += np.arange(0, x.size, n)[:, None]
    order = order.ravel()
    ctx, x = ctx.ravel().take(order), x.ravel().take(order)
    known = np.zeros(len(x), bool)
    np.equal(ctx[1:], ctx[:-1], out=known[1:])
    known[::n] = False
    hit = known.copy()
    hit[1:] &= x[1:] == x[:-1]
    sure = hit.astype(np.uint8)
    sure[1:] += sure[1:] & hit[:-1]
    out = np.zeros(len(x), kind)
    out[1:] = (x[:-1].astype(kind) << 2 | sure[:-1] + np.uint8(1)) * known[1:]
    back = np.empty_like(out)
    back[order] = out
    return back.reshape(-1, n)


def encode(ids: np.ndarray) -> list[bytes]:
    """ids: blocks x length, whole numbers below 2^32; each block's code."""
    lanes, steps = ids.shape
    lists, x = _places(ids)
    m, lane = Mixer(np.array([len(u) for u in lists])), np.arange(lanes)
    kind = np.uint16 if m.most < 1 << 14 else np.uint32
    c2, c1, columns = (np.empty((steps, lanes), kind) for _ in range(3))
    for at in range(0, lanes, 32):  # some blocks at a time stay in the cache
        y = x[at : at + 32]
        a = np.concatenate([np.zeros((len(y), 1), y.dtype), y[:, :-1]], axis=1)
        b = np.concatenate([np.zeros((len(y), 1), y.dtype), a[:, :-1]], axis=1).astype(np.int64)
        c2[:, at : at + 32], c1[:, at : at + 32] = _followers(y, context(a, b).astype(np.uint16), kind).T, _followers(y, a, kind).T
        columns[:, at : at + 32] = y.T
    out = np.zeros((2 * steps + 4, lanes), np.int32)
    flat, low, rng, at = out.reshape(-1), np.zeros(lanes, np.int64), np.full(lanes, LOW_MASK, np.int64), lane.copy()
    ends, done, gain = refreshed(steps), 0, m.gain
    for first, last in zip(ends, ends[1:]):
        span, done = m.refresh(columns[done:first]), first
        for t in range(first, last, 64):
            rows = slice(t, min(t + 64, last))
            k2, k1, y = c2[rows].astype(np.int64), c1[rows].astype(np.int64), columns[rows].astype(np.int64)
            g2, g1 = k2 >> 2, k1 >> 2
            differ = g2 != g1
            hit2, hit1 = g2 == y, (g1 == y) & differ
            state = m.base_w + ((k2 & 3) << 2 | k1 & 3) + differ * 16
            p, up = np.empty_like(y), hit2 * (gain << 32) + hit1 * gain
            for i in range(len(y)):
                s = state[i]
                p[i] = q = m.weights.take(s)
                q -= q >> RATE & BOTH
                q += up[i]
                m.weights[s] = q
            p2, p1 = p >> 32, p & 0xFFFFFFFF
            unit = (m.free - p2 - p1 >> m.bits) + 1
            e2, e1, e = span.take(m.base + g2), span.take(m.base + g1), span.take(m.base + y)
            n2, n1, s = e2 & 0xFFFF, (e1 & 0xFFFF) * differ, e >> 16
            end2 = (1 << TOTAL) - p1 - (unit << m.bits) + unit * n2  # what whole slots leave over goes to order 2
            end1 = end2 + p1 + unit * n1
            lo = np.where(hit1, end2, end1 + unit * (s - n2 * (s > e2 >> 16) - n1 * (s > e1 >> 16)))
            width = np.where(hit1, end1 - end2, unit * (e & 0xFFFF))
            lo, width = np.where(hit2, 0, lo), np.where(hit2, end2, width)
            for i in range(len(y)):
                r = rng >> TOTAL
                low += r * lo[i]  # below 2^49: a carry goes out with the next word
                rng = r * width[i]
                short = np.flatnonzero(rng < SMALL)
                while len(short):
                    x_low, place, x_rng = low.take(short), at.take(short), rng.take(short)
                    flat[place] = x_low >> 32
                    place += lanes
                    x_low &= SMALL - 1
                    x_low <<= 16
                    x_rng <<= 16
                    at[short], low[short], rng[short] = place, x_low, x_rng
                    short = short[x_rng < SMALL]
    for shift in (32, 16, 0):  # the whole of low
        flat[at] = low >> shift
        low &= (1 << shift) - 1
        at = at + lanes
    ends = (at - lane) // lanes
    out, carry = out[: ends.max()], np.zeros(lanes, np.int32)
    for row in out[::-1]:
        row += carry
        carry = row >> 16
        row &= 0xFFFF
    code = np.ascontiguousarray(out.T).astype("<u2")
    return [pack_sorted(u) + code[k, : ends[k]].tobytes() for k, u in enumerate(lists)]


# --- decoder


def decode(codes: list[bytes], steps: int) -> np.ndarray:
    """The blocks' ids (uint32), blocks x steps."""
    lanes = len(codes)
    if not lanes or not steps:
        return np.zeros((lanes, steps), np.uint32)
    lists, starts = zip(*map(unpack_sorted, codes))
    words = np.zeros((lanes, max(len(c) - e for c, e in zip(codes, starts)) // 2 + 4), np.uint16)
    for k, (c, e) in enumerate(zip(codes, starts)):
        words[k, : (len(c) - e) // 2] = np.frombuffer(c, "<u2", (len(c) - e) // 2, e)
    flat = np.ascontiguousarray(words.T).reshape(-1)
    m, lane = Mixer(np.array([len(u) for u in lists])), np.arange(lanes)
    base, base_w, base2, bits, top = m.base, m.base_w, lane << CONTEXTS, m.bits.astype(np.int32), (1 << m.bits) - 1
    base_s, free, slots = np.cumsum(top + 1) - top - 1, m.free.astype(np.int32), (top + 1).astype(np.int32)
    gains = np.concatenate([m.gain << 32, m.gain])
    kind = np.uint16 if m.most < 1 << 12 else np.int32  # small tables miss the cache less often
    seen = np.zeros((lanes << CONTEXTS) + lanes * (m.most + 1), kind)  # orders 2 and 1, by context: id << 4 | sureness, order 2's << 2
    base1, where = base + (lanes << CONTEXTS), np.empty((2, lanes), np.int64)
    where2, where1 = where
    new = np.empty((2, lanes), kind)
    new_flat, seen_once, surer = new.reshape(-1), np.array([[4], [1]], kind), np.repeat(np.array([4, 1], kind), lanes)
    places = np.tile(np.arange(m.most + 1, dtype=np.uint16 if m.most < 1 << 16 else np.int32), lanes)
    a, b = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    first3 = flat[: 3 * lanes].astype(np.int64).reshape(3, lanes)
    code = first3[0] << 32 | first3[1] << 16 | first3[2]
    rng, at, out = np.full(lanes, LOW_MASK, np.int64), lane + 3 * lanes, np.empty((steps, lanes), places.dtype)
    ends, done, whole = refreshed(steps), 0, np.int32(1 << TOTAL)
    for first, last in zip(ends, ends[1:]):
        span, done = m.refresh(out[done:first]), first
        slot = np.repeat(places, m.slots.ravel())
        for t in range(first, last):
            np.add(context(a, b), base2, out=where2)
            np.add(a, base1, out=where1)
            c2, c1 = c = seen.take(where)
            g2, g1 = g = c >> 4
            differ = g2 != g1
            state = c2 ^ c1  # both sure bits, and more where the ids differ
            state = np.minimum(state, state & 15 | 16) + base_w
            weight = m.weights.take(state)
            q2, q1 = (weight >> 32).astype(np.int32), weight.astype(np.int32)
            unit = (free - q2 - q1 >> bits) + 1
            e = span.take(g + base)
            (n2, n1), (s2, s1) = e & 0xFFFF, e >> 16
            n1 *= differ
            end2 = whole - q1 - unit * (slots - n2)
            end1 = end2 + q1 + unit * n1
            r = rng >> TOTAL
            rest = code - r * end1
            # the place among the slots without the two predicted ids', then among all; what hits give here is put right below
            q = (rest / (r * unit)).astype(m.kind)  # below 2^48: the quotient's floor is exact
            w = q + n1 * (q >= s1 - n2 * (s2 < s1))
            w += n2 * (w >= s2)
            x = slot.take(base_s + w, mode="clip")
            hit = np.flatnonzero(rest < 0)  # as order 2 or as order 1 says
            h2, h1 = end2.take(hit), end1.take(hit)
            one = code.take(hit) >= r.take(hit) * h2
            pick = one * lanes + hit
            x[hit] = g.take(pick)
            b, a = a, x.astype(np.int64)
            e = span.take(a + base)
            lo, width = end1 + unit * (q + (e >> 16) - w), unit * (e & 0xFFFF)
            lo[hit], width[hit] = h2 * one, np.where(one, h1 - h2, h2)
            weight -= weight >> RATE & BOTH
            weight[hit] += gains.take(pick)
            m.weights[state] = weight
            code -= r * lo
            rng = r * width
            short = np.flatnonzero(rng < SMALL)
            while len(short):
                place, x_code, x_rng = at.take(short), code.take(short), rng.take(short)
                x_code <<= 16
                x_code |= flat.take(place, mode="clip")
                place += lanes
                x_rng <<= 16
                at[short], code[short], rng[short] = place, x_code, x_rng
                if x_rng.min() >= SMALL:
                    break
                short = short[(x_rng < SMALL) & (x_rng > 0)]
            out[t] = x
            x = x.astype(kind, copy=False)
            np.add(x << 4, seen_once, out=new)
            right = np.flatnonzero(g == x)
            k, more = c.take(right), surer.take(right)
            new_flat[right] = np.minimum(k + more, k | more * 3)
            seen[where] = new
    ids = np.empty((lanes, steps), np.uint32)
    for u, places, row in zip(lists, np.ascontiguousarray(out.T), ids):
        u.astype(np.uint32).take(places, out=row, mode="clip")
    return ids
