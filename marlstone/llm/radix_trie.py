"""A radix trie over byte strings whose leaves count by source."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from os.path import commonprefix

#: Keys below one branch that are kept as plain suffixes; beyond it they get branches of their own.
BURST = 512


class Leaf:
    __slots__ = ("counts", "docs")

    def __init__(self):
        self.counts: dict[str, int] | None = None
        self.docs = 0


class Branch:
    """Keys that share ``label``: the one that ends there, and those that go on, by their next byte. What is below a byte is
    a branch or, while there are few keys, their suffixes from that byte on."""

    __slots__ = ("label", "own", "below")

    def __init__(self, label: bytes):
        self.label, self.own = label, None
        self.below: dict[int, Branch | dict[bytes, Leaf]] = {}

    def put(self, suffix: bytes, leaf: Leaf) -> None:
        if suffix:
            self.below.setdefault(suffix[0], {})[suffix] = leaf
        else:
            self.own = leaf


def _branched(suffixes: dict[bytes, Leaf]) -> Branch:
    label = commonprefix([min(suffixes), max(suffixes)])
    out = Branch(label)
    for suffix, leaf in suffixes.items():
        out.put(suffix[len(label) :], leaf)
    return out


def _split(branch: Branch, at: int) -> Branch:
    """A branch of the first ``at`` bytes of the label, above the branch with the rest."""
    above = Branch(branch.label[:at])
    branch.label = branch.label[at:]
    above.below[branch.label[0]] = branch
    return above


class RadixTrie:
    """Keys are byte strings. Each holds counts by source and a number of documents; both add up when tries merge."""

    def __init__(self):
        self.root = Branch(b"")
        #: Keys, and counters over all keys.
        self.keys = self.counters = 0

    def leaf(self, key: bytes) -> Leaf:
        """The key's leaf; branches are split and made as needed."""
        branch, at = self.root, 0
        while at < len(key):
            first = key[at]
            below = branch.below.get(first)
            if type(below) is Branch:
                label = below.label
                if not key.startswith(label, at):
                    below = branch.below[first] = _split(below, len(commonprefix([label, key[at:]])))
                branch, at = below, at + len(below.label)
                continue
            if below is None:
                below = branch.below[first] = {}
            suffix = key[at:]
            leaf = below.get(suffix)
            if leaf is None:
                leaf = below[suffix] = Leaf()
                self.keys += 1
                if len(below) > BURST:
                    branch.below[first] = _branched(below)
            return leaf
        if branch.own is None:
            branch.own = Leaf()
            self.keys += 1
        return branch.own

    def add(self, key: bytes, sources: Iterable[str], counts: Iterable[int], docs: int) -> None:
        leaf = self.leaf(key)
        leaf.docs += docs
        held = leaf.counts
        if held is None:
            leaf.counts = held = dict(zip(sources, counts))
            self.counters += len(held)
            return
        before = len(held)
        for source, n in zip(sources, counts):
            held[source] = held.get(source, 0) + n
        self.counters += len(held) - before

    def merge(self, other: RadixTrie) -> None:
        for key, leaf in other.walk():
            self.add(key, leaf.counts, leaf.counts.values(), leaf.docs)

    def walk(self) -> Iterator[tuple[bytes, Leaf]]:
        """All keys with their leaves; the order of bytes is that of UTF-8."""
        waiting: list[tuple[bytes, Branch | dict[bytes, Leaf]]] = [(b"", self.root)]
        while waiting:
            prefix, below = waiting.pop()
            if type(below) is dict:
                for suffix in sorted(below):
                    yield prefix + suffix, below[suffix]
                continue
            prefix += below.label
            if below.own is not None:
                yield prefix, below.own
            waiting += [(prefix, below.below[first]) for first in sorted(below.below, reverse=True)]
