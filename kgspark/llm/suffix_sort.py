"""Suffix sorting by external, recursive induced sorting, with common prefixes, to a bounded depth.

Suffixes whose predecessor is larger and that begin a rise (LMS) are sorted first: their substrings are put in order by
one round of inducing and named. Where names repeat, the string of names is sorted by the same procedure, which gives back
its order and the common prefixes in names; the depth halves with each level, since a substring takes two characters at
least. The order of all other suffixes is induced from that of the LMS suffixes.

Inducing runs over priority queues of tuples. Over bytes there is a queue for each leading character: its order is the order
of insertion, so the least element of all queues is the head of the first that isn't empty. A tuple is a position and the
length of the common prefix with the tuple before it in its queue: one more than the least of the common prefixes between the
two suffixes that induced them. Names are too many for that, so neighbouring names share a queue as long as all their
suffixes fit in memory together, and a tuple names the suffix that induced it by its place in the order; the tuples of such a
queue, with those that they induce in it, are put in order at once. A frequent name has a queue of its own. Common prefixes
are read off the order so far by range minima.

Queues hold chunks and move them to a file when all queues together exceed their share of memory; text, types, marks, the
order so far and its minima are mapped files beyond that size. Work on a chunk is vectorised.

The order is exact for the first `depth` characters of every suffix at least; suffixes that agree so far are neighbours.
Common prefixes are exact below the depth, and count as the depth from there on.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np

#: Positions handled at once, bytes that a sort may hold in memory, and arrays that share them.
CHUNK, MEMORY, ARRAYS = 1 << 20, 96 << 20, 8
#: Bytes that a held chunk takes besides its items.
OVERHEAD = 128


class Growing:
    """Values appended one part after another; to a file beyond the memory of an array."""

    def __init__(self, disk: Disk, dtype: np.dtype) -> None:
        self.disk, self.dtype, self.n = disk, dtype, 0
        self.held, self.at = bytearray(), ""

    def add(self, values: np.ndarray) -> None:
        values = np.ascontiguousarray(values, self.dtype)
        self.n += len(values)
        self.held += memoryview(values).cast("B") if len(values) else b""
        if len(self.held) > self.disk.memory // ARRAYS:
            self._store()

    def _store(self) -> None:
        self.at = self.at or self.disk.path()
        with open(self.at, "ab") as f:
            f.write(self.held)
        self.held = bytearray()

    def done(self) -> np.ndarray:
        if not self.at:
            return np.frombuffer(self.held, self.dtype)
        self._store()
        return np.memmap(self.at, self.dtype, "r+", shape=(self.n,))


class Disk:
    """Arrays and queues of one sort, in memory as far as they fit, else in files that go with it."""

    def __init__(self, memory: int = MEMORY, chunk: int = CHUNK) -> None:
        self.memory, self.chunk = memory, chunk
        self.folder: tempfile.TemporaryDirectory | None = None
        self.files = 0

    def path(self) -> str:
        if self.folder is None:
            self.folder = tempfile.TemporaryDirectory(prefix="suffix-")
        self.files += 1
        return os.path.join(self.folder.name, str(self.files))

    def array(self, n: int, dtype) -> np.ndarray:
        """n zeros."""
        if n * np.dtype(dtype).itemsize <= self.memory // ARRAYS:
            return np.zeros(n, dtype)
        return np.memmap(self.path(), dtype, "w+", shape=(n,))

    def numbers(self, n: int) -> np.ndarray:
        """n zeros that can hold places of a text of n characters."""
        return self.array(n, np.int32 if n < 2**31 - 1 else np.int64)

    def pieces(self, n: int) -> Iterator[tuple[int, int]]:
        """Bounds of the chunks of n items."""
        for a in range(0, n, self.chunk):
            yield a, min(n, a + self.chunk)

    def growing(self, dtype) -> Growing:
        return Growing(self, np.dtype(dtype))

    def close(self) -> None:
        if self.folder is not None:
            self.folder.cleanup()
            self.folder = None


class Queues:
    """First-in-first-out queues by character; what exceeds the memory is appended to a file for each queue."""

    def __init__(self, disk: Disk, dtype) -> None:
        self.disk, self.dtype, self.held = disk, np.dtype(dtype), 0
        self.chunks: dict[int, list[np.ndarray]] = {}
        self.stored: dict[int, tuple[str, list[int]]] = {}  # file, lengths of its chunks
        self.read: dict[int, tuple[int, int]] = {}  # chunks taken from the file, and their bytes

    def push(self, c: int, items: np.ndarray) -> None:
        self.chunks.setdefault(c, []).append(items.copy())  # a view would keep all of its array
        self.held += items.nbytes + OVERHEAD
        if self.held > self.disk.memory:
            self._spill()

    def _spill(self) -> None:
        """All that is held goes to the files, longest first, until half of the memory is free."""
        for c in sorted(self.chunks, key=lambda c: -sum(x.nbytes for x in self.chunks[c])):
            if self.held <= self.disk.memory // 2:
                break
            path, lengths = self.stored.setdefault(c, (self.disk.path(), []))
            parts = self.chunks.pop(c)
            self.held -= sum(x.nbytes + OVERHEAD for x in parts)
            whole = np.concatenate(parts)  # few long chunks instead of many short ones
            step = 2 * self.disk.chunk  # even: pairs stay together
            lengths.extend(min(step, len(whole) - a) for a in range(0, len(whole), step))
            with open(path, "ab") as f:
                whole.tofile(f)

    def _load(self, c: int, offset: int, n: int) -> np.ndarray:
        return np.fromfile(self.stored[c][0], self.dtype, n, offset=offset)

    def pop(self, c: int) -> np.ndarray | None:
        """The next items: a stored chunk, or several held ones up to the chunk size."""
        if c in self.stored:
            k, offset = self.read.get(c, (0, 0))
            lengths = self.stored[c][1]
            if k < len(lengths):
                self.read[c] = k + 1, offset + lengths[k] * self.dtype.itemsize
                return self._load(c, offset, lengths[k])
        held = self.chunks.get(c)
        if not held:
            return None
        n = take = 0
        while take < len(held) and (take == 0 or n + len(held[take]) <= self.disk.chunk):
            n += len(held[take])
            take += 1
        out = held[0] if take == 1 else np.concatenate(held[:take])
        del held[:take]
        self.held -= out.nbytes + take * OVERHEAD
        return out

    def backwards(self, c: int) -> Iterator[np.ndarray]:
        """All items of a queue, the last first; it is empty afterwards."""
        for x in reversed(self.chunks.pop(c, [])):
            self.held -= x.nbytes + OVERHEAD
            yield x[::-1]
        if c in self.stored:
            path, lengths = self.stored.pop(c)
            end = sum(lengths) * self.dtype.itemsize
            for n in reversed(lengths):
                end -= n * self.dtype.itemsize
                yield np.fromfile(path, self.dtype, n, offset=end)[::-1]
            os.remove(path)


def types(text: np.ndarray, disk: Disk) -> np.ndarray:
    """True where a suffix is smaller than the next one. text ends with its one smallest character."""
    n = len(text)
    small = disk.array(n, np.bool_)
    small[n - 1] = True
    hi = n - 1
    while hi > 0:
        lo = max(0, hi - disk.chunk)
        now, after = np.asarray(text[lo:hi]), np.asarray(text[lo + 1 : hi + 1])
        m = hi - lo
        # equal to the next character: as the next suffix that differs from its successor
        where = np.where(now != after, np.arange(m), m)
        where = np.minimum.accumulate(where[::-1])[::-1]
        rises = np.append(now < after, small[hi])
        small[lo:hi] = rises[where]
        hi = lo
    return small


#: A tuple: position above, common prefix in the low bits.
PREFIX_BITS = 16
_LOW = (1 << PREFIX_BITS) - 1


class Least:
    """Minima over ranges of an array: a table of minima over 1, 2, 4, ... neighbours, as far as they are asked for."""

    def __init__(self, values: np.ndarray) -> None:
        self.rows = [values]

    def _row(self, k: int) -> np.ndarray:
        while len(self.rows) <= k:
            last, step = self.rows[-1], 1 << (len(self.rows) - 1)
            self.rows.append(np.minimum(last[:-step], last[step:]))
        return self.rows[k]

    def between(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """min(values[low : high + 1]) for arrays of bounds."""
        out = self.rows[0][low]
        wide = np.flatnonzero(high > low)
        if len(wide):
            low, high = low[wide], high[wide]
            level = (np.frexp((high - low + 1).astype(np.float32))[1] - 1).astype(np.uint8)
            order = np.argsort(level, kind="stable")
            count = np.bincount(level)
            for k, own in zip(np.flatnonzero(count).tolist(), np.split(order, np.cumsum(count[count > 0])[:-1]), strict=True):
                row = self._row(k)
                out[wide[own]] = np.minimum(row[low[own]], row[high[own] - (1 << k) + 1])
        return out


class Inducer:
    """Order of all suffixes, and their common prefixes, from those of the LMS suffixes."""

    def __init__(self, text: np.ndarray, small: np.ndarray, disk: Disk, depth: int) -> None:
        self.text, self.small, self.disk, self.depth = text, small, disk, min(depth, _LOW)

    def _spread(self, queues: Queues, pending: np.ndarray, items: np.ndarray, prefix: np.ndarray, kind: bool) -> None:
        """Predecessors of one type, to the queues of their characters, with their common prefixes.

        prefix: of each item with the one before it. pending: for each character the least of these since its queue got its
        last tuple; -1 while it has none.
        """
        if not self.carries:
            before = items[items > 0] - 1
            before = before[self.small[before] == kind]
            first = np.asarray(self.text[before])
            order = np.argsort(first, kind="stable")
            first, tuples = first[order], before[order] << PREFIX_BITS
            cut = [0, *(np.flatnonzero(first[1:] != first[:-1]) + 1).tolist(), len(first)] if len(first) else [0]
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                queues.push(int(first[a]), tuples[a:b])
            return
        ahead = np.minimum.accumulate(prefix)
        at = np.flatnonzero(items > 0)
        before = items[at] - 1
        fits = self.small[before] == kind
        at, before = at[fits], before[fits]
        if not len(at):
            np.minimum(pending, ahead[-1], out=pending)
            return
        first = np.asarray(self.text[before])
        order = np.argsort(first, kind="stable")
        first, before, at = first[order], before[order], at[order]
        head = np.concatenate(([True], first[1:] != first[:-1]))
        value = np.empty(len(at), np.int64)
        value[head] = np.minimum(pending[first[head]], ahead[at[head]])
        rest = np.flatnonzero(~head)
        if len(rest):
            value[rest] = Least(prefix.astype(np.uint16)).between(at[rest - 1] + 1, at[rest])
        back = np.append(np.minimum.accumulate(prefix[::-1])[::-1], self.depth)
        tail = np.append(head[1:], True)
        np.minimum(pending, ahead[-1], out=pending)
        pending[first[tail]] = back[at[tail] + 1]
        tuples = (before.astype(np.int64) << PREFIX_BITS) | np.minimum(value + 1, self.depth)
        cut = np.flatnonzero(head).tolist()
        for a, b in zip(cut, [*cut[1:], len(first)], strict=True):
            queues.push(int(first[a]), tuples[a:b])

    def _common(self, a: int, b: int) -> int:
        n = min(self.depth, len(self.text) - max(a, b))
        differ = np.flatnonzero(self.text[a : a + n] != self.text[b : b + n])
        return int(differ[0]) if len(differ) else n

    def run(self, lms: np.ndarray, prefix: np.ndarray | None, emit: Callable[[np.ndarray, np.ndarray], None]) -> None:
        """lms: LMS positions in order; prefix: of each with the one before (None: only the order is wanted). emit gets all
        suffixes, the largest first, in chunks: positions, and the common prefix of each with the suffix emitted before it."""
        self.carries = prefix is not None
        count = lambda places: sum((np.bincount(self.text[places[a:b]], minlength=256) for a, b in self.disk.pieces(len(places))), np.zeros(256, np.int64))
        present = sum((np.bincount(self.text[a:b], minlength=256) for a, b in self.disk.pieces(len(self.text))), np.zeros(256, np.int64))
        chars = np.flatnonzero(present).tolist()
        larger, done = Queues(self.disk, np.int64), Queues(self.disk, np.int64)
        high = np.cumsum(count(lms))[chars]
        low = np.concatenate(([0], high[:-1]))
        pending = np.full(256, -1, np.int64)
        for c, a, b in zip(chars, low.tolist(), high.tolist(), strict=True):
            last = None
            while (tuples := larger.pop(c)) is not None:
                done.push(c, tuples)
                items = tuples >> PREFIX_BITS
                self._spread(larger, pending, items, tuples & _LOW if last is not None else np.concatenate(([0], tuples[1:] & _LOW)), False)
                last = int(items[-1])
            for k in range(a, b, self.disk.chunk):
                items = np.asarray(lms[k : min(b, k + self.disk.chunk)]).astype(np.int64)
                own = np.asarray(prefix[k : k + len(items)]).astype(np.int64) if self.carries else np.zeros(len(items), np.int64)
                if k == a and self.carries:
                    own[0] = 0 if last is None else self._common(last, int(items[0]))
                self._spread(larger, pending, items, own, False)
        smaller = Queues(self.disk, np.int64)
        pending = np.full(256, -1, np.int64)
        for c in reversed(chars):
            last = None
            while (tuples := smaller.pop(c)) is not None:
                items, own = tuples >> PREFIX_BITS, tuples & _LOW
                if last is None:
                    own[0] = 0
                emit(items, own)
                self._spread(smaller, pending, items, own, True)
                last = int(items[-1])
            carried = None  # what the tuple visited last says of the one before it
            for tuples in done.backwards(c):
                items, said = tuples >> PREFIX_BITS, tuples & _LOW
                own = np.empty_like(said)
                own[1:] = said[:-1]
                own[0] = carried if carried is not None else 0 if last is None else self._common(last, int(items[0]))
                carried = int(said[-1])
                emit(items, own)
                self._spread(smaller, pending, items, own, True)
        emit(np.array([len(self.text) - 1]), np.zeros(1, np.int64))


#: Values of a block of range minima.
BLOCK = 64


class Minima:
    """Range minima of a growing sequence: running minima inside blocks in both directions, and minima over the 1, 2, 4, ...
    blocks before each."""

    def __init__(self, n: int, disk: Disk) -> None:
        self.n, size = 0, -(-n // BLOCK) * BLOCK
        self.values, self.ahead, self.back = (disk.array(size, np.uint16) for _ in range(3))
        blocks = size // BLOCK
        self.rows = [disk.array(blocks, np.uint16) for _ in range(max(1, blocks.bit_length()))]
        self.disk = disk

    def add(self, values: np.ndarray) -> None:
        for a, b in self.disk.pieces(len(values)):
            self._add(values[a:b])

    def _add(self, values: np.ndarray) -> None:
        first, n = self.n // BLOCK, self.n + len(values)
        self.values[self.n : n] = values
        last = -(-n // BLOCK)
        own = np.full((last - first) * BLOCK, 65535, np.uint16)
        own[: n - first * BLOCK] = self.values[first * BLOCK : n]
        own = own.reshape(-1, BLOCK)
        self.ahead[first * BLOCK : last * BLOCK] = np.minimum.accumulate(own, axis=1).ravel()
        self.back[first * BLOCK : last * BLOCK] = np.minimum.accumulate(own[:, ::-1], axis=1)[:, ::-1].ravel()
        self.rows[0][first:last] = own.min(axis=1)
        at = np.arange(first, last)
        for k in range(1, len(self.rows)):
            before = at - (1 << (k - 1))
            self.rows[k][first:last] = np.minimum(self.rows[k - 1][first:last], self.rows[k - 1][np.maximum(before, 0)])
        self.n = n

    def between(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """min(values[low : high + 1]) for arrays of bounds, low <= high."""
        a, b = low // BLOCK, high // BLOCK
        out = np.where(a < b, np.minimum(self.back[low], self.ahead[high]), 65535).astype(np.int64)
        wide = np.flatnonzero(b - a > 1)
        if len(wide):
            size = b[wide] - a[wide] - 1
            level = np.frexp(size.astype(np.float64))[1] - 1
            for k in np.unique(level).tolist():
                own = level == k
                at, row = wide[own], self.rows[k]
                out[at] = np.minimum(out[at], np.minimum(row[b[at] - 1], row[a[at] + (1 << k)]))
        left = np.flatnonzero(a == b)
        place = low[left].astype(np.int64)
        while len(left):
            out[left] = np.minimum(out[left], self.values[place])
            place = place + 1
            more = place <= high[left]
            left, place = left[more], place[more]
        return out


class Order:
    """The suffixes of a string of names, in order with their common prefixes, from those of its LMS suffixes."""

    def __init__(self, text: np.ndarray, small: np.ndarray, by_name: np.ndarray, disk: Disk, depth: int) -> None:
        self.text, self.small, self.disk, self.depth = text, small, disk, depth
        # Ranges of names by the number of their suffixes: a queue each.
        self.most = most = max(1, disk.chunk // 16)
        n, edge = len(text), [0]
        at = most
        while at < n:
            c = int(text[by_name[at]])
            edge += [c, c + 1] if int(text[by_name[at - most]]) == c else [c]
            at += most
        self.edge = np.unique(edge)

    def _range(self, chars: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edge, chars, side="right") - 1

    def sweep(self, kind: bool, seeds: np.ndarray, prefix: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None]:
        """Seeds and all suffixes of one type that they induce, in order (kind: from the largest), with the common prefix of
        each with the one before. prefix: the seeds' own."""
        disk = self.disk
        self.kind, self.carries, self.base = kind, prefix is not None, 0
        self.queues, self.out = Queues(disk, np.int64), disk.numbers(len(self.text))
        self.least = Minima(len(self.text), disk) if self.carries else None
        held = np.zeros(len(self.edge), np.int64)
        for a, b in disk.pieces(len(seeds)):
            held += np.bincount(self._range(self.text[seeds[a:b]]), minlength=len(held))
        ranges = np.arange(len(held))[:: -1 if kind else 1].tolist()
        at = 0
        for g in ranges:
            n = int(held[g])
            alone = g + 1 < len(self.edge) and self.edge[g + 1] - self.edge[g] == 1
            (self._stream if alone else self._batch)(g, seeds[at : at + n], prefix[at : at + n] if self.carries else None)
            at += n
        return self.out[: self.base], self.least.values[: self.base] if self.carries else None

    def _emit(self, items: np.ndarray, prefix: np.ndarray | None, g: int, inside: bool) -> None:
        """The next suffixes of the order; what they induce goes to the queues. inside: to that of range g as well."""
        first, self.base = self.base, self.base + len(items)
        self.out[first : self.base] = items
        if self.carries:
            self.least.add(prefix)
        at = np.flatnonzero(items > 0)
        before = items[at] - 1
        fits = self.small[before] == self.kind
        at, before = at[fits], before[fits]
        to = self._range(self.text[before])
        if not inside:
            apart = to != g
            at, before, to = at[apart], before[apart], to[apart]
        if not len(at):
            return
        order = np.argsort(to.astype(np.uint16) if len(self.edge) < 65536 else to, kind="stable")
        at, before, to = at[order], before[order], to[order]
        cut = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1]))).tolist()
        pairs = np.stack([before, at + first], axis=1).astype(np.int64)
        for a, b in zip(cut, [*cut[1:], len(to)], strict=True):
            self.queues.push(int(to[a]), pairs[a:b].ravel())

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefixes of an induced suffix and a seed of the same character: they differ after a run of it."""
        return _compared(self.text, a, b, np.ones(len(a), np.int64), self.depth)

    def _induced(self, now: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Common prefixes of suffixes of one character whose inducing suffixes stand at these places of the order."""
        return np.minimum(self.least.between(before + 1, now) + 1, self.depth)

    def _stream(self, g: int, seeds: np.ndarray, prefix: np.ndarray | None) -> None:
        """A range of one name: its queue in order, then its seeds, chunk by chunk."""
        last = None
        while (pairs := self.queues.pop(g)) is not None:
            items, by = pairs.reshape(-1, 2).T
            own = None
            if self.carries:
                own = np.zeros(len(items), np.int64)
                if last is None:
                    own[1:] = self._induced(by[1:], by[:-1])
                else:
                    own[:] = self._induced(by, np.concatenate(([last[1]], by[:-1])))
            last = int(items[-1]), int(by[-1])
            self._emit(items, own, g, True)
        for a, b in self.disk.pieces(len(seeds)):
            items, own = np.asarray(seeds[a:b]).astype(np.int64), None
            if self.carries:
                own = np.asarray(prefix[a:b]).astype(np.int64)
                if a == 0:
                    own[0] = 0 if last is None else self._common(np.array([last[0]]), items[:1])[0]
            self._emit(items, own, g, True)

    def _batch(self, g: int, seeds: np.ndarray, prefix: np.ndarray | None) -> None:
        """A range of several names, with all that its suffixes induce inside it, put in order at once."""
        got = []
        while (x := self.queues.pop(g)) is not None:
            got.append(x)
        come = np.concatenate(got).reshape(-1, 2) if got else np.zeros((0, 2), np.int64)
        come, by = come[:, 0], come[:, 1]
        low = int(self.edge[g])
        high = int(self.edge[g + 1]) if g + 1 < len(self.edge) else 2**62
        items, parents, n = [come, np.asarray(seeds).astype(np.int64)], [], len(come) + len(seeds)
        outer, front, number = n, np.concatenate(items), np.arange(n)
        while len(front):  # what is induced inside the range
            before = front - 1
            ok = front > 0
            ok[ok] = self.small[before[ok]] == self.kind
            c = self.text[before[ok]]
            ok[ok] = (c >= low) & (c < high)
            front, parent = before[ok], number[ok]
            items.append(front)
            parents.append(parent)
            number = np.arange(n, n + len(front))
            n += len(front)
        if not n:
            return
        items = np.concatenate(items)
        parent = np.concatenate(parents)
        c = np.asarray(self.text[items]).astype(np.int64)
        seed = np.zeros(n, bool)
        seed[len(come) : outer] = True
        head = (c.max() - c if self.kind else c - c.min()) * 2 + seed
        # Those that came first, in their order; then those induced here, as their inducers; seeds after all others of a character.
        # However the latter lie among each other, the places of all else are known.
        key = np.concatenate([np.arange(len(come)), np.arange(len(seeds))])
        order = np.argsort(head[:outer] * (outer + 1) + key)
        known, here = head[:outer][order], np.sort(head[outer:])
        rank = np.empty(n, np.int64)
        rank[:outer][order] = np.arange(outer) + np.searchsorted(here, known, side="left")
        place = np.searchsorted(known, here, side="right") + np.arange(n - outer)
        value, ahead = head[outer:], parent
        while n > outer:  # by characters, then by twice as many each round, until those that came first decide
            at = np.argsort(value)  # equal ones get one rank
            fresh = np.concatenate(([True], value[at[1:]] != value[at[:-1]]))
            rank[outer:][at] = np.maximum.accumulate(np.where(fresh, place, 0))
            if fresh.all():
                break
            value = rank[outer:] * (n + 1) + rank[ahead]
            ahead = np.where(ahead < outer, ahead, ahead[np.maximum(ahead - outer, 0)])
        order = np.empty(n, np.int64)
        order[rank] = np.arange(n)
        own = None
        if self.carries:
            own = np.zeros(n, np.int64)
            same = np.flatnonzero(c[order[1:]] == c[order[:-1]]) + 1
            a, b = order[same - 1], order[same]
            own[same] = 1  # an inducer from before, and one in the range: they begin differently
            both = seed[a] & seed[b]
            own[same[both]] = np.asarray(prefix)[b[both] - len(come)]
            edge = ~seed[a] & seed[b]
            own[same[edge]] = self._common(items[a[edge]], items[b[edge]])
            came = (a < len(come)) & (b < len(come))
            own[same[came]] = self._induced(by[b[came]], by[a[came]])
            here = np.flatnonzero((a >= outer) & (b >= outer))
            x, y = parent[a[here] - outer], parent[b[here] - outer]
            alike = c[x] == c[y]
            to, x, y = same[here[alike]], rank[x[alike]], rank[y[alike]]
            own[to], todo = self.depth, np.arange(len(to))
            while len(todo):  # each reads places before its own
                now = np.minimum(_least_between(own, x[todo] + 1, y[todo]) + 1, self.depth)
                less = now != own[to[todo]]
                moved = to[todo[less]]
                own[moved] = now[less]
                if not len(moved):
                    break
                first = np.searchsorted(moved, x + 1)
                todo = np.flatnonzero((first < len(moved)) & (moved[np.minimum(first, len(moved) - 1)] <= y))
        self._emit(items[order], own, g, False)

    def run(self, lms: np.ndarray, prefix: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None]:
        """All suffixes but the last, the largest first, and their common prefixes; lms and prefix as for an Inducer."""
        rising, own = self.sweep(False, lms, prefix)
        disk, seeds, said = self.disk, self.disk.growing(np.int64), self.disk.growing(np.int64)
        carried = 0
        for a, b in reversed(list(disk.pieces(len(rising)))):
            keep = np.flatnonzero(~self.small[rising[a:b]])[::-1]
            seeds.add(rising[a:b][keep])
            if self.carries and len(keep):
                some = np.asarray(own[a:b][keep]).astype(np.int64)
                said.add(np.concatenate(([carried], some[:-1])))
                carried = int(some[-1])
        return self.sweep(True, seeds.done(), said.done() if prefix is not None else None)


def _least_between(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """min(values[low : high + 1]); most ranges are short."""
    out, size = values[low], high - low
    long = np.flatnonzero(size >= BLOCK)
    if len(long):
        if int(size[long].sum()) + 1000 * len(long) > 16 * len(values):
            return Least(values).between(low, high)
        out[long] = [values[a : b + 1].min() for a, b in zip(low[long].tolist(), high[long].tolist(), strict=True)]
    left, at = np.flatnonzero((size > 0) & (size < BLOCK)), low
    while len(left):
        at = at + 1
        out[left] = np.minimum(out[left], values[at[left]])
        left = left[at[left] < high[left]]
    return out


def _equal(text: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether text[a : a + length] is text[b : b + length], for arrays of places."""
    same = np.ones(len(a), bool)
    left = np.arange(len(a))
    k = 0
    while len(left):
        left = left[length[left] > k]
        differ = text[a[left] + k] != text[b[left] + k]
        same[left[differ]] = False
        left = left[~differ]
        k += 1
    return same


def _compared(text: np.ndarray, a: np.ndarray, b: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Common prefixes of the suffixes at a and b, which are known to agree for `at` characters; bytes eight at a time."""
    n, at = len(text), np.minimum(at, depth)
    live = np.flatnonzero(at < depth)
    if text.dtype == np.uint8 and n > 7:
        words, ends = np.ndarray((n - 7,), "<u8", buffer=text, strides=(1,)), []
        while len(live):  # words while they agree; then the bytes below the first bit that differs
            x, y = a[live] + at[live], b[live] + at[live]
            inside = np.maximum(x, y) + 8 <= n
            ends.append(live[~inside])
            live, x, y = live[inside], x[inside], y[inside]
            differ = words[x] ^ words[y]
            at[live] += np.where(differ == 0, 8, np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)) >> 3)
            live = live[(differ == 0) & (at[live] < depth)]
        live = np.concatenate([*ends, np.zeros(0, np.int64)]).astype(np.int64)
    while len(live):
        x, y = a[live] + at[live], b[live] + at[live]
        inside = np.maximum(x, y) < n
        live, x, y = live[inside], x[inside], y[inside]
        live = live[text[x] == text[y]]
        at[live] += 1
        live = live[at[live] < depth]
    return np.minimum(at, depth)


def _lms_of(text: np.ndarray, small: np.ndarray, disk: Disk) -> np.ndarray:
    """Places of the LMS suffixes; the last character is one, unless it is the only one."""
    found = disk.growing(np.int32 if len(text) < 2**31 - 1 else np.int64)
    for a, b in disk.pieces(len(text) - 1):
        found.add(np.flatnonzero(small[a + 1 : b + 1] & ~small[a:b]) + a + 1)
    return found.done() if found.n else np.array([len(text) - 1], np.int32)


def _lms_order(text: np.ndarray, lms: np.ndarray, backwards: Iterator[np.ndarray], depth: int, disk: Disk) -> tuple[np.ndarray, np.ndarray]:
    """Places of the LMS suffixes in order, and the common prefix of each with the one before.

    backwards: suffixes in an order that has the LMS suffixes by their substrings, the largest first.
    """
    n, number = len(lms), disk.numbers(len(text))
    for a, b in disk.pieces(n):
        number[lms[a:b]] = np.arange(a, b) + 1
    place, end = disk.numbers(n), n
    for items in backwards:
        own = number[items]
        own = own[own > 0][::-1] - 1
        place[end - len(own) : end] = own
        end -= len(own)
    names, last = disk.numbers(n), 0
    size = lambda at: np.where(at + 1 < n, lms[np.minimum(at + 1, n - 1)].astype(np.int64) - lms[at] + 1, 1)
    for a, b in disk.pieces(n):
        here = np.asarray(place[a:b])
        before = np.concatenate((place[max(a - 1, 0) : max(a, 1)], here[:-1])).astype(np.int64)
        length, fresh = size(here), np.ones(b - a, np.int64)
        alike = np.flatnonzero(length == size(before))
        if a == 0:
            fresh[0], alike = 0, alike[alike > 0]
        fresh[alike[_equal(text, lms[here[alike]].astype(np.int64), lms[before[alike]].astype(np.int64), length[alike])]] = 0
        named = last + np.cumsum(fresh)
        names[here] = named
        last = int(named[-1])
    if last + 1 < n:
        # A substring takes two characters of the text at least.
        place, shared = _names_order(names, place, depth // 2 + 1, disk)
    else:
        shared = None
    out, prefix = disk.numbers(n), disk.array(n, np.uint16)
    for a, b in disk.pieces(n):
        here = np.asarray(place[a:b]).astype(np.int64)
        before = np.concatenate((place[max(a - 1, 0) : max(a, 1)], here[:-1])).astype(np.int64)
        out[a:b] = x = lms[here].astype(np.int64)
        y = lms[before].astype(np.int64)
        names_shared = np.asarray(shared[a:b]).astype(np.int64) if shared is not None else np.zeros(b - a, np.int64)
        skip = np.where(names_shared > depth // 2, depth, lms[np.minimum(here + names_shared, n - 1)].astype(np.int64) - x)
        own = _compared(text, x, y, skip, depth)
        if a == 0:
            own[0] = 0
        prefix[a:b] = own
    return out, prefix


def _names_order(names: np.ndarray, place: np.ndarray, depth: int, disk: Disk) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes of a string of names, with common prefixes in names, to that depth. place: by first name."""
    n = len(names)
    if depth <= 1:
        shared = disk.array(n, np.uint16)
        for a, b in disk.pieces(n - 1):
            own = names[place[a : b + 1]]
            shared[a + 1 : b + 1] = own[1:] == own[:-1]
        return place, shared
    small = types(names, disk)
    lms = _lms_of(names, small, disk)
    is_lms = disk.array(n, np.bool_)
    for a, b in disk.pieces(len(lms)):
        is_lms[lms[a:b]] = True
    order, seeds = Order(names, small, place, disk, depth), disk.growing(np.int64)
    for a, b in disk.pieces(n):
        here = np.asarray(place[a:b])
        seeds.add(here[is_lms[here]])
    found, _ = order.run(seeds.done(), None)
    backwards = chain((np.asarray(found[a:b]) for a, b in disk.pieces(len(found))), [np.array([n - 1])])
    lms, prefix = _lms_order(names, lms, backwards, depth, disk)
    found, shared = order.run(lms, prefix)
    out, own = disk.numbers(n), disk.array(n, np.uint16)
    out[0] = n - 1
    for a, b in disk.pieces(len(found)):
        out[n - b : n - a] = found[a:b][::-1]
        k = max(a, 1)  # the largest has none before it; what it said of that is the next one's word, in order
        own[n - b + 1 : n - k + 1] = shared[k:b][::-1]
    return out, own


def suffixes(text: np.ndarray, depth: int, emit: Callable[[np.ndarray, np.ndarray], None], disk: Disk) -> None:
    """Emit all suffixes of text, the largest first, in chunks: positions, and common prefixes with the suffix emitted before.

    text: bytes in one block of memory or one mapped file; its last character is its one smallest.
    """
    small = types(text, disk)
    lms = _lms_of(text, small, disk)
    inducer = Inducer(text, small, disk, depth)
    # The order of LMS substrings, by inducing from LMS positions that are ordered by their first characters only.
    first, seeds = Queues(disk, lms.dtype), disk.growing(lms.dtype)
    for a, b in disk.pieces(len(lms)):
        c = text[lms[a:b]]
        by_char = lms[a:b][np.argsort(c, kind="stable")]
        ends = np.cumsum(np.bincount(c, minlength=256))
        for k in np.unique(c).tolist():
            first.push(k, by_char[ends[k - 1] if k else 0 : ends[k]])
    for k in range(256):
        while (x := first.pop(k)) is not None:
            seeds.add(x)
    is_lms = disk.array(len(text), np.bool_)
    for a, b in disk.pieces(len(lms)):
        is_lms[lms[a:b]] = True
    found = disk.growing(lms.dtype)
    inducer.run(seeds.done(), None, lambda items, _: found.add(items[is_lms[items]]))
    got = found.done()
    order, prefix = _lms_order(text, lms, (np.asarray(got[a:b]) for a, b in disk.pieces(len(got))), inducer.depth, disk)
    inducer.run(order, prefix, emit)
