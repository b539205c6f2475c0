"""Repeated windows of a set of strings: Burrows-Wheeler transforms of shards, merged by refining their interleave.

A shard holds the sorted suffixes of some strings. Its transform is, in that order, what stands before each suffix: a
symbol of up to eight bytes, with the row of the suffix that begins with this symbol (the last-to-first step). The merge
reads nothing else; wider symbols, to ``STEP`` bytes, are composed from the transforms by two such steps. It begins with the shards' rows one after another, an interleave of depth 0, one block. A round takes the
rows in the interleave's order and deals them out by their symbols in a stable counting sort; each row is replaced by the
row that its last-to-first step gives. That order agrees with a symbol's bytes more than before, so suffixes are never
sorted or compared again. Rows whose symbols or whose former blocks differ part in that round, and the round is their
common prefix (to a symbol's bytes). Rows alone in their block stay alone however far they are carried on and drop out. After the
round that reaches the depth, a block of two rows or more is an interval of suffixes with a common prefix of that length:
a repeat.
"""

from __future__ import annotations

import numpy as np

#: Most bytes of a symbol. Wider ones mean fewer rounds and more work to number them.
STEP = 32


class Shard:
    """Sorted suffixes (to ``depth`` bytes) of strings laid end to end, each string followed by its empty suffix."""

    def __init__(self, parts: list[bytes], depth: int):
        sizes = np.array([len(p) for p in parts])
        ends = np.repeat(np.cumsum(sizes + 1), sizes + 1)
        self.text = np.frombuffer(b"".join(p + b"\0" for p in parts), dtype=np.uint8)
        self.left = ends - 1 - np.arange(len(self.text))  # bytes from a place to its string's end
        starts = np.repeat(np.cumsum(sizes + 1) - sizes - 1, sizes + 1)
        self.before = np.arange(len(self.text)) - starts  # bytes from its string's start to a place
        self.order = suffix_order(self.text, self.left, depth)
        self.row = np.empty(len(self.text), dtype=np.int32)
        self.row[self.order] = np.arange(len(self.text), dtype=np.int32)

    def transform(self, step: int) -> tuple[np.ndarray, np.ndarray]:
        """For each row the ``step`` bytes before it as a number, and the row they begin; -1 where the string begins earlier."""
        value = leading(self.text, step)
        at = self.order - step
        inside = self.before[self.order] >= step
        at = np.where(inside, at, 0)
        return value[at], np.where(inside, self.row[at], -1)


def leading(text: np.ndarray, step: int) -> np.ndarray:
    """The ``step`` bytes (eight at most) from each place on as a number, whatever lies there."""
    padded = np.concatenate([text, np.zeros(step, dtype=np.uint8)]).astype(np.uint64)
    out = np.zeros(len(text), dtype=np.uint64)
    for k in range(step):
        out = (out << np.uint64(8)) | padded[k : k + len(text)]
    return out


def first_bytes(text: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The first eight bytes of each suffix as a number, zeros beyond the string's end."""
    out = leading(text, 8)
    short = left < 8
    drop = (np.uint64(8) * (8 - left[short]).astype(np.uint64)) % np.uint64(64)
    out[short] = np.where(left[short] == 0, np.uint64(0), (out[short] >> drop) << drop)
    return out


def suffix_order(text: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """Places of one shard sorted by their first ``depth`` bytes (prefix doubling over those not yet alone); a suffix that
    ends sorts before one that goes on."""
    n = len(text)
    key, short = first_bytes(text, left), np.minimum(left, 8).astype(np.uint8)
    order = np.lexsort((short, key))
    k, m = key[order], short[order]
    fresh = np.concatenate([[True], (k[1:] != k[:-1]) | (m[1:] != m[:-1])]) if n else np.zeros(0, bool)
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    h = 8
    while h < depth:
        start = np.flatnonzero(fresh)
        size = np.diff(np.concatenate([start, [n]]))
        at = np.flatnonzero(np.repeat(size > 1, size))  # rows that share their block
        if not len(at):
            break
        places = order[at]
        ahead = np.where(left[places] > h, rank[np.minimum(places + h, n - 1)] + 1, 0)
        block = rank[places]
        by = np.argsort(block * (n + 1) + ahead, kind="stable")
        places, block, ahead = places[by], block[by], ahead[by]
        order[at] = places
        split = np.concatenate([[True], (block[1:] != block[:-1]) | (ahead[1:] != ahead[:-1])])
        fresh[at] = split
        rank[places] = at[np.flatnonzero(split)[np.cumsum(split) - 1]]
        h *= 2
    return order


def counting_order(symbols: np.ndarray) -> np.ndarray:
    """A stable order by symbols below 2 ** 32, by one or two counting passes over 16 bits each."""
    order = np.argsort((symbols & 0xFFFF).astype(np.uint16), kind="stable")
    if len(symbols) and int(symbols.max()) >> 16:
        order = order[np.argsort((symbols[order] >> 16).astype(np.uint16), kind="stable")]
    return order


def numbered(values: list[np.ndarray]) -> list[np.ndarray]:
    """The shards' symbols as numbers from 0 on that keep their order, the same for all shards."""
    whole = np.concatenate(values)
    order = np.argsort(whole, kind="stable")
    fresh = np.concatenate([[0], np.cumsum(whole[order][1:] != whole[order][:-1])]) if len(whole) else np.zeros(0, np.int64)
    out = np.empty(len(whole), dtype=np.uint32)
    out[order] = fresh
    return np.split(out, np.cumsum([len(v) for v in values])[:-1])


class Interleave:
    """The merged order of the shards' suffixes at some depth: rows that aren't alone, and where their blocks begin."""

    def __init__(self, shards: list[Shard]):
        self.offsets = np.concatenate([[0], np.cumsum([len(s.text) for s in shards])]).astype(np.int64)
        self.shards = shards
        self.rows = np.arange(self.offsets[-1], dtype=np.int32)
        self.starts = np.zeros(len(self.rows), dtype=bool)
        self.starts[:1] = True
        self.depth = 0

    def use(self, step: int) -> None:
        """Takes the shards' transforms of ``step`` bytes a symbol."""
        values, after = zip(*(s.transform(step) for s in self.shards))
        self.step = step
        self.symbols = np.concatenate(numbered(list(values)))
        self.last_to_first = np.concatenate([np.where(a >= 0, a + o, -1) for a, o in zip(after, self.offsets)]).astype(np.int32)

    def refine(self) -> None:
        """One round: the interleave agrees with ``step`` bytes more."""
        block = np.cumsum(self.starts, dtype=np.int32)
        after = self.last_to_first[self.rows]
        inside = np.flatnonzero(after >= 0)
        symbols = self.symbols[self.rows[inside]]
        order = counting_order(symbols)
        symbols, block, rows = symbols[order], block[inside[order]], after[inside[order]]
        parts = np.ones(len(rows), dtype=bool)
        parts[1:] = (symbols[1:] != symbols[:-1]) | (block[1:] != block[:-1])
        ends = np.ones(len(rows), dtype=bool)
        ends[:-1] = parts[1:]
        shared = ~(parts & ends)
        self.rows, self.starts = rows[shared], parts[shared]
        self.depth += self.step

    def compose(self) -> None:
        """Symbols of twice the bytes: each row's own, with that of the row its last-to-first step gives before it."""
        inside = np.flatnonzero(self.last_to_first >= 0)
        after = self.last_to_first[inside]
        pairs = (self.symbols[after].astype(np.uint64) << np.uint64(32)) | self.symbols[inside]
        wide = np.zeros_like(self.symbols)
        wide[inside] = numbered([pairs])[0]
        follow = np.full_like(self.last_to_first, -1)
        follow[inside] = self.last_to_first[after]
        self.symbols, self.last_to_first, self.step = wide, follow, 2 * self.step

    def to_depth(self, depth: int) -> None:
        if depth % 8:
            self.use(depth % 8)
            self.refine()
        if depth >= 8:
            self.use(8)
        while self.depth < depth and len(self.rows):
            if self.step < STEP and (depth - self.depth) % (2 * self.step) == 0:
                self.compose()
            else:
                self.refine()

    def intervals(self) -> list[np.ndarray]:
        """The rows of each interval of suffixes that agree to the depth."""
        return np.split(self.rows, np.flatnonzero(self.starts)[1:]) if len(self.rows) else []


def common_prefixes(shards: list[Shard], depth: int) -> dict[int, int]:
    """For each row of the shards laid end to end: the longest prefix, up to ``depth`` bytes, that it shares with another
    row. It is the last round, at one byte a symbol, in which the row has company."""
    merged = Interleave(shards)
    merged.use(1)
    out = dict.fromkeys(range(int(merged.offsets[-1])), 0)
    while merged.depth < depth and len(merged.rows):
        merged.refine()
        out.update(dict.fromkeys(merged.rows.tolist(), merged.depth))
    return out


def repeated_windows(strings: list[bytes], depth: int, shard_bytes: int = 1 << 18) -> list[np.ndarray]:
    """For each string, which of its windows of ``depth`` bytes occur at another place of any of the strings."""
    members: list[list[int]] = []
    size = shard_bytes + 1
    for k, s in enumerate(strings):
        if size + len(s) > shard_bytes:
            members.append([])
            size = 0
        members[-1].append(k)
        size += len(s)
    shards = [Shard([strings[k] for k in held], depth) for held in members]
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(strings)
    if not shards:
        return out
    merged = Interleave(shards)
    merged.to_depth(depth)
    found = np.zeros(merged.offsets[-1], dtype=bool)
    found[merged.rows] = True
    for shard, lo, hi, held in zip(shards, merged.offsets[:-1], merged.offsets[1:], members):
        repeats = np.zeros(len(shard.text), dtype=bool)
        repeats[shard.order[found[lo:hi]]] = True
        at = 0
        for k in held:
            n = len(strings[k])
            out[k] = repeats[at : at + max(0, n - depth + 1)]
            at += n + 1
    return out
