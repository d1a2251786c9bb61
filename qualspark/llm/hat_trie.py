"""A HAT-trie of word ids: a shallow trie whose leaves are hash containers that burst when they grow."""

from __future__ import annotations

from collections.abc import Iterable, Iterator


class Branch(dict):
    """A trie node: word id to Branch or container; `own` is the count of the sequence that ends here."""

    own = 0


class HatTrie:
    """Counts of sequences of word ids. A container is a dict from what follows its path (a tuple of ids) to a count."""

    def __init__(self, burst: int = 4096):
        self.root, self.burst, self.size = Branch(), burst, 0

    def add(self, sequences: Iterable[tuple], counts: Iterable[int]) -> None:
        """Add counts of sequences of one or more ids; containers that have grown too large burst."""
        root, grown = self.root, {}
        for sequence, n in zip(sequences, counts, strict=True):
            above, at, rest = root, sequence[0], sequence[1:]
            node = root.get(at)
            while type(node) is Branch and rest:
                above, at, rest = node, rest[0], rest[1:]
                node = above.get(at)
            if type(node) is Branch:
                self.size += not node.own
                node.own += n
                continue
            if node is None:
                node = above[at] = {}
            before = node.get(rest)
            if before is None:
                self.size += 1
                node[rest] = n
                if len(node) > self.burst:
                    grown[id(node)] = (above, at)
            else:
                node[rest] = before + n
        for above, at in grown.values():
            self._burst(above, at)

    def _burst(self, above: Branch, at: int) -> None:
        """Replace a container by a branch with a container for each id that comes next."""
        branch, container = Branch(), above[at]
        for rest, n in container.items():
            if rest:
                branch.setdefault(rest[0], {})[rest[1:]] = n
            else:
                branch.own = n
        above[at] = branch

    def _items(self, node, path: tuple) -> Iterator[tuple[tuple, int]]:
        if type(node) is not Branch:
            for rest, n in node.items():
                yield path + rest, n
            return
        if node.own:
            yield path, node.own
        for at, below in node.items():
            yield from self._items(below, (*path, at))

    def _held(self, node) -> int:
        return sum(map(self._held, node.values())) + (node.own > 0) if type(node) is Branch else len(node)

    def take(self, leave: int = 0) -> Iterator[tuple[tuple, int]]:
        """Remove whole subtrees below the root, the largest first, until at most `leave` sequences are held, and give them."""
        for held, at in sorted(((self._held(node), at) for at, node in self.root.items()), reverse=True):
            if self.size <= leave:
                return
            self.size -= held
            yield from self._items(self.root.pop(at), (at,))
