"""The walk of ``compare`` over many chunks at once: the helper that ``chunked`` runs
in its tasks, on Arrow batches whose rows hold a span of either list.

Tokens become numbers (equal ones the same), the chunks of all rows of a batch are
entered at their guesses and walked side by side, a step of all of them being a few
numpy operations.  Nothing here knows more than its rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .compare import LOOKAHEAD, STOP_CONTEXT

#: Steps of the left index whose states a chunk notes: the longest move and one.
NOTED = 8
#: Tokens that a guess compares at every place it tries.
AGREE = 8
#: Left out when letters are counted: marks that tokenisers change or add.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Tokens of the rows that are walked together, unless one row has more.
TOGETHER = 1 << 20
#: Pairs that a walk compares at once behind the noted states.
WIDE = 16
#: Places between the lists of two rows, which equal nothing.
GAP = 2 * WIDE
#: Kind, cost and context width of an event by its number.
CASES = [*((kind, cost, width) for kind, _da, _db, _mi, _mj, cost, width in LOOKAHEAD), ("stop", 0, STOP_CONTEXT)]

STATE = pa.struct([("i", pa.int64()), ("j", pa.int64()), ("cost", pa.int64())])
CHUNK = pa.struct([("c", pa.int64()), ("i", pa.int64()), ("j", pa.int64()), ("cost", pa.int64()), ("ended", pa.bool_()), ("to", pa.int64())])


def around(size: int) -> int:
    """How far from its guess a chunk of ``size`` tokens looks for its entry: tokens of
    uneven length put the looked-up place off by about a root of the chunk's."""
    return 8 + 2 * math.isqrt(size)


def slack(span: int) -> int:
    """How far a place that was looked up among the letters of a whole span may be off."""
    return span // 8


def _tokens(column: pa.StructArray) -> tuple[pa.Array, np.ndarray]:
    """The tokens of all rows, one after the other, and how many each row has."""
    n, joined, lists = (pc.struct_field(column, [name]) for name in ("n", "joined", "list"))
    counts = pc.fill_null(n, 0).to_numpy(zero_copy_only=False).astype(np.int64)
    if lists.null_count == len(lists):
        return pc.split_pattern(joined.filter(pa.array(counts > 0)), "\n").flatten(), counts
    rows = [lists.slice(r, 1).flatten() if lists[r].is_valid else pc.split_pattern(joined.slice(r, 1), "\n").flatten() for r in np.flatnonzero(counts)]
    return pa.concat_arrays([pa.array([], joined.type), *rows]), counts


def _ink(tokens: pa.Array) -> np.ndarray:
    """Letters and digits before every token, and in all."""
    ends = np.frombuffer(tokens.buffers()[1], np.int32)[tokens.offset : tokens.offset + len(tokens) + 1] if len(tokens) else np.zeros(1, np.int32)
    counted = np.ones(256, np.int64)
    counted[[ord(m) for m in MARKS]] = 0
    counted[0x80:0xC0] = 0  # bytes inside a character
    text = np.frombuffer(tokens.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return np.concatenate([[0], np.cumsum(counted[text])])[ends - ends[0]]


class Side:
    """A list's tokens as numbers, row by row, with a gap in front of and behind each."""

    def __init__(self, tokens: pa.Array, codes: np.ndarray, counts: np.ndarray, at: np.ndarray, gap: int) -> None:
        self.tokens, self.counts, self.at = tokens, counts, at
        self.starts = np.cumsum(counts) - counts
        self.base = self.starts + GAP * np.arange(1, len(counts) + 1)
        self.codes = np.full(len(codes) + GAP * (len(counts) + 2), gap, np.int32)
        self.codes[np.arange(len(codes)) + np.repeat(self.base - self.starts, counts)] = np.where(codes < 0, gap, codes)
        #: What is added to a place in a row's list.
        self.shift = self.base - at
        self._ink = None

    @property
    def ink(self) -> np.ndarray:
        if self._ink is None:
            self._ink = _ink(self.tokens)
        return self._ink

    def nth(self, row: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The number among all tokens of places in rows' lists, within the row."""
        return self.starts[row] + np.clip(place - self.at[row], 0, self.counts[row])

    def contexts(self, row: np.ndarray, place: np.ndarray, width: np.ndarray) -> pa.Array:
        """Tokens ``place - 2`` to ``place + width - 3`` as one text each."""
        first, last = self.nth(row, np.maximum(place - 2, 0)), self.nth(row, place + width - 2)
        n = last - first
        nth = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
        if self.tokens.null_count:
            kept = pc.is_valid(self.tokens).to_numpy(zero_copy_only=False)[nth]
            n, nth = np.bincount(np.repeat(np.arange(len(n)), n)[kept], minlength=len(n)), nth[kept]
        ends = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
        return pc.binary_join(pa.ListArray.from_arrays(ends, self.tokens.take(pa.array(nth))), " ")


@dataclass
class Walked:
    """A walk a row: the state in which each is left, and what it passed."""

    i: np.ndarray
    j: np.ndarray
    cost: np.ndarray
    ended: np.ndarray
    noted: np.ndarray

    def passed(self, at: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether the walks ``at`` noted a state, and their costs up to it."""
        same = (self.noted[at, :, 0] == i[:, None]) & (self.noted[at, :, 1] == j[:, None])
        return same.any(1), np.where(same.any(1), self.noted[at, same.argmax(1), 2], 0)

    def put(self, at: np.ndarray, other: Walked) -> None:
        for name in ("i", "j", "cost", "ended", "noted"):
            getattr(self, name)[at] = getattr(other, name)


class Spans:
    """The rows of an Arrow batch: ``_s`` (number of the span), ``a_at``, ``a``,
    ``b_at``, ``b`` (packed tokens and the place of the first), ``len_a``, ``len_b``
    (of the whole lists), ``_e`` (known or guessed entries of chunks, or null) and maybe
    ``_around`` (how far from its guess a chunk looks for its entry)."""

    def __init__(self, batch: pa.RecordBatch, size: int, span: int) -> None:
        numbers = lambda name: pc.fill_null(batch.column(name), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.size, self.rows = size, batch.num_rows
        (ta, na), (tb, nb) = (_tokens(batch.column(name)) for name in "ab")
        codes = pc.fill_null(pa.concat_arrays([ta, tb]).dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
        self.a = Side(ta, codes[: len(ta)], na, numbers("a_at"), -1)
        self.b = Side(tb, codes[len(ta) :], nb, numbers("b_at"), -2)
        self.last = np.minimum(numbers("len_a"), numbers("len_b")) - 1
        self.s = numbers("_s")
        self.first = self.s * span
        self.around = int(numbers("_around").max(initial=0)) if "_around" in batch.schema.names else 0
        own = np.minimum(self.a.at + na, self.first + span) - self.first
        self.chunks = np.where(na > 0, -(-np.maximum(own, 0) // size), 0)
        entries = batch.column("_e")
        given = entries.flatten()
        self.given = np.repeat(np.arange(self.rows), pc.fill_null(pc.list_value_length(entries), 0).to_numpy(zero_copy_only=False))
        self.given_c, self.given_i, self.given_j = (pc.struct_field(given, [name]).to_numpy(zero_copy_only=False).astype(np.int64) for name in "cij")
        ink = pc.fill_null(pc.struct_field(given, ["ink"]), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        if (ink >= 0).any():
            self._look_up(ink, span)

    def _look_up(self, ink: np.ndarray, span: int) -> None:
        """Guesses that say how many letters and digits are before them in their span of
        the right list: the place itself, near where they are."""
        told = np.flatnonzero(ink >= 0)
        row, j = self.given[told], self.given_j[told]
        found = np.searchsorted(self.b.ink, self.b.ink[self.b.nth(row, j // span * span)] + ink[told])
        place = found - self.b.starts[row] + self.b.at[row]
        self.given_j[told] = np.clip(place, np.maximum(j - slack(span), 0), j + slack(span))

    def walk(self, row: np.ndarray, i: np.ndarray, j: np.ndarray, c: np.ndarray, events: list | None = None) -> Walked:
        """Walks entered at ``i``, ``j`` and left at the first state behind chunk
        ``c``, or at their end; ``events`` takes (walk, i, j, case)."""
        A, B = self.a.codes, self.b.codes
        i, j, cost = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        stopped = np.zeros(len(i), bool)
        noted, n_noted = np.full((len(i), NOTED, 3), -1, np.int64), np.zeros(len(i), np.int64)
        to_a, to_b, last, start = self.a.shift[row], self.b.shift[row], self.last[row], c * self.size
        limit = np.minimum(last, start + self.size)
        on, ahead = np.arange(len(i)), np.arange(WIDE)
        while True:
            on = on[(i[on] < limit[on]) & (j[on] < last[on]) & ~stopped[on]]
            if not len(on):
                break
            at_i, at_j = i[on], j[on]
            x, y = to_a[on] + at_i, to_b[on] + at_j
            near = at_i - start[on] < NOTED
            if near.any():
                w = on[near]
                noted[w, n_noted[w]] = np.stack([i[w], j[w], cost[w]], 1)
                n_noted[w] += 1
                run = (A[x] == B[y]).astype(np.int64)
                met = run == 0
            else:
                same = A[x[:, None] + ahead] == B[y[:, None] + ahead]
                most = np.minimum(limit[on] - at_i, last[on] - at_j)
                run = np.where(same.all(1), WIDE, same.argmin(1))
                met = (run < WIDE) & (run < most)
                run = np.minimum(run, most)
            i[on] += run
            j[on] += run
            w, x, y = on[met], (x + run)[met], (y + run)[met]
            for case, (_kind, da, db, mi, mj, more, _width) in enumerate(LOOKAHEAD):
                if not len(w):
                    break
                hit = A[x + da] == B[y + db]
                h = w[hit]
                if events is not None:
                    events.append((h, i[h], j[h], np.full(len(h), case)))
                i[h] += mi
                j[h] += mj
                cost[h] += more
                w, x, y = w[~hit], x[~hit], y[~hit]
            stopped[w] = True
            if events is not None:
                events.append((w, i[w], j[w], np.full(len(w), len(LOOKAHEAD))))
        return Walked(i, j, cost, stopped | (i >= last) | (j >= last), noted)

    def nudged(self, row: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Guesses moved to the nearby place where most of the next tokens agree."""
        moves = np.arange(-self.around, self.around + 1)
        x, y = self.a.shift[row] + i, (self.b.shift[row] + j)[:, None] + moves
        low, high = (self.b.base[row] - 1)[:, None], (self.b.base[row] + self.b.counts[row])[:, None]
        agree = np.zeros(y.shape, np.int64)
        for k in range(AGREE):
            agree += self.a.codes[x + k][:, None] == self.b.codes[np.clip(y + k, low, high)]
        best = np.argmax(agree * 4 * len(moves) - 2 * np.abs(moves) + (moves > 0), 1)
        found = agree[np.arange(len(i)), best] > 0
        return np.maximum(np.where(found, j + moves[best], j), self.b.at[row])

    def guesses(self, row: np.ndarray, c: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where every chunk looks for its entry: the place with as many letters and
        digits behind the entry of the row's first chunk, or what is given."""
        i = c * self.size
        first_j = np.zeros(self.rows, np.int64)
        own = self.given_c * self.size == self.first[self.given]
        first_j[self.given[own]] = self.given_j[own]
        ink = self.b.ink[self.b.nth(row, first_j[row])] + self.a.ink[self.a.nth(row, i)] - self.a.ink[self.a.nth(row, self.first[row])]
        found = np.searchsorted(self.b.ink, ink) - self.b.starts[row]
        j = self.b.at[row] + np.clip(found, 0, self.b.counts[row])
        j[c * self.size == self.first[row]] = first_j[row[c * self.size == self.first[row]]]
        nth = top[self.given] + self.given_c - self.first[self.given] // self.size
        inside = self.given_c - self.first[self.given] // self.size < self.chunks[self.given]
        i[nth[inside]], j[nth[inside]] = self.given_i[inside], self.given_j[inside]
        return i, j

    def link(self, exact: bool) -> tuple[np.ndarray, ...]:
        """All chunks walked apart from their guesses and linked; the first one of a row
        is entered where it is said to be (``exact``, or the list's begin) or guessed.
        Returns row, c, walk and entry of the chunks, whether each is of its row's walk,
        the cost from its entry, and the rounds of every row."""
        n, size = self.chunks, self.size
        top = np.cumsum(n) - n
        row = np.repeat(np.arange(self.rows), n)
        k = np.arange(len(row)) - top[row]
        c = self.first[row] // size + k
        i, j = self.guesses(row, c, top)
        known = (k == 0) & ((self.s[row] == 0) | exact)
        loose = ~known & (self.around > 0)
        j[loose] = self.nudged(row[loose], i[loose], j[loose])
        begins = (k == 0) & (self.s[row] == 0)
        i[begins] = j[begins] = 0
        walked = self.walk(row, i, j, c)
        rounds, span = np.ones(self.rows, np.int64), 1
        filled = np.flatnonzero(n > 0)
        head, far = top[filled], len(row)
        while True:
            pred = np.maximum(np.arange(len(row)) - 1, 0)
            inner = k > 0
            e_i, e_j = np.where(inner, walked.i[pred], i), np.where(inner, walked.j[pred], j)
            behind = inner & walked.ended[pred]
            passed, before = walked.passed(np.arange(len(row)), e_i, e_j)
            linked = ~inner | (passed & ~behind)
            cost = walked.cost - np.where(inner, before, 0)
            if not len(row):
                break
            bad = np.minimum.reduceat(np.where(linked, far, k), head)
            end = np.minimum.reduceat(np.where(linked & walked.ended, k, far), head)
            is_open = (bad < far) & (bad < end)
            stop = np.zeros(self.rows, np.int64)
            stop[filled] = np.minimum(end + 1, n[filled])
            if not is_open.any():
                break
            rounds[filled[is_open]] += 1
            first_bad = np.full(self.rows, -1)
            first_bad[filled[is_open]] = bad[is_open]
            again = np.flatnonzero(~linked & ~behind & (first_bad[row] >= 0))
            # One walk for each run of ``span`` chunks, from the first that is not linked.
            run = (k[again] - first_bad[row[again]]) // span
            _, firsts = np.unique(row[again] * (far + 1) + run, return_index=True)
            at = again[firsts]
            until = np.minimum(first_bad[row[at]] + (run[firsts] + 1) * span, n[row[at]])
            w_i, w_j = e_i[at], e_j[at]
            while len(at):
                done = self.walk(row[at], w_i, w_j, c[at])
                walked.put(at, done)
                on = (k[at] + 1 < until) & ~done.ended
                at, until, w_i, w_j = at[on] + 1, until[on], done.i[on], done.j[on]
            span *= 4
        chain = k < (stop[row] if len(row) else 0)
        return row, c, walked, e_i, e_j, chain, cost, rounds


def _lists(counts: np.ndarray, kind: pa.DataType, *columns: np.ndarray) -> pa.ListArray:
    items = pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip(columns, kind)], fields=list(kind))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), items)


def _groups(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of a batch with about ``TOGETHER`` tokens."""
    n = sum(pc.fill_null(pc.struct_field(batch.column(name), ["n"]), 0).to_numpy(zero_copy_only=False).astype(np.int64) for name in "ab")
    group = np.cumsum(n) // TOGETHER
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for at, to in zip(cuts, cuts[1:]):
        if to - at == batch.num_rows:
            yield batch
        elif to > at:
            yield batch.take(pa.array(np.arange(at, to)))  # a copy: not all of Arrow's functions take slices


def linked(keys: list[str], size: int, span: int, exact: bool, names: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(keys, _s, chunks, noted, i, j, ended, rounds)``: the linked chunks of every
    span, the states noted in its first one, and the state in which it is left."""
    for batch in (g for b in batches for g in _groups(b)):
        spans = Spans(batch, size, span)
        row, c, walked, i, j, chain, cost, rounds = spans.link(exact)
        n = np.bincount(row[chain], minlength=spans.rows)
        chunks = _lists(n, CHUNK, c[chain], i[chain], j[chain], cost[chain], walked.ended[chain], walked.i[chain])
        some = spans.chunks > 0
        head = (np.cumsum(spans.chunks) - spans.chunks)[some]
        states = walked.noted[head]
        real = states[:, :, 0] >= 0
        n_noted = np.zeros(spans.rows, np.int64)
        n_noted[some] = real.sum(1)
        noted = _lists(n_noted, STATE, *(states[:, :, x][real] for x in range(3)))
        left = np.zeros((3, spans.rows), np.int64)
        tail = np.zeros(spans.rows, np.int64)
        tail[row[chain]] = np.flatnonzero(chain)  # the last one of a row stays
        left[:, some] = walked.i[tail[some]], walked.j[tail[some]], walked.ended[tail[some]]
        own = [batch.column(name) for name in [*keys, "_s"]]
        yield pa.RecordBatch.from_arrays([*own, chunks, noted, pa.array(left[0]), pa.array(left[1]), pa.array(left[2] > 0), pa.array(rounds)], names=names)


def events(keys: list[str], size: int, span: int, known: bool, names: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(keys, _s, seq, i, j, kind, cost, a_context, b_context)``: the mismatches of the
    walk over every span, numbered in it.  ``known``: ``_e`` holds all true entries;
    otherwise the chunks are linked first."""
    for batch in (g for b in batches for g in _groups(b)):
        spans = Spans(batch, size, span)
        if known:
            row, c, i, j = spans.given, spans.given_c, spans.given_i, spans.given_j
        else:
            row, c, _walked, i, j, chain, _cost, _rounds = spans.link(False)
            row, c, i, j = row[chain], c[chain], i[chain], j[chain]
        found: list = []
        spans.walk(row, i, j, c, found)
        walk, i, j, case = (np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found) if found else ((),) * 4))
        if not len(walk):
            continue
        row = row[walk]
        order = np.lexsort((i, row))
        row, i, j, case = row[order], i[order], j[order], case[order]
        starts = np.concatenate([[0], np.flatnonzero(np.diff(row)) + 1])
        seq = np.arange(len(row)) - np.repeat(starts, np.diff([*starts, len(row)]))
        kinds, costs, widths = zip(*CASES)
        width = np.array(widths)[case]
        own = [batch.column(name).take(pa.array(row)) for name in [*keys, "_s"]]
        made = [seq, i, j, pa.array(kinds).take(pa.array(case)), np.array(costs)[case]]
        yield pa.RecordBatch.from_arrays([*own, *(x if isinstance(x, pa.Array) else pa.array(x) for x in made), spans.a.contexts(row, i, width), spans.b.contexts(row, j, width)], names=names)
