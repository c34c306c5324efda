"""Patricia trie over byte strings, with payloads at terminal nodes and eviction of whole subtrees."""

from __future__ import annotations

from collections.abc import Callable, Iterator

#: Bytes that a node takes besides its label, about.
NODE_BYTES = 200


def _shared(label: bytes, key: bytes, at: int) -> int:
    """How many bytes of label also start at key[at]; by halving, so each step is one memory comparison."""
    low, high = 1, min(len(label), len(key) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if key.startswith(label[:mid], at):
            low = mid
        else:
            high = mid - 1
    return low


class PatriciaTrie:
    """Maps byte strings to payloads; equal strings meet at one terminal node, where ``merge`` joins their payloads.

    A node is [label, children by first byte or None, payload or None]. ``size`` is what labels and nodes take."""

    def __init__(self, merge: Callable):
        self.merge, self.root, self.size, self.by_first = merge, [b"", {}, None], 0, {}

    def insert(self, key: bytes, payload) -> None:
        node, at, n, before = self.root, 0, len(key), self.size
        while True:
            if at == n:
                node[2] = payload if node[2] is None else self.merge(node[2], payload)
                break
            if node[1] is None:
                node[1] = {}
            child = node[1].get(key[at])
            if child is None:
                node[1][key[at]] = [key[at:], None, payload]
                self.size += n - at + NODE_BYTES
                break
            label = child[0]
            if not key.startswith(label, at):
                k = _shared(label, key, at)
                upper = [label[:k], {label[k]: child}, None]
                child[0] = label[k:]
                node[1][key[at]] = child = upper
                self.size += NODE_BYTES
            node, at = child, at + len(child[0])
        if n and self.size != before:
            self.by_first[key[0]] = self.by_first.get(key[0], 0) + self.size - before

    @staticmethod
    def _below(node, prefix: bytes) -> Iterator[tuple[bytes, object]]:
        stack = [(node, prefix)]
        while stack:
            node, prefix = stack.pop()
            if node[2] is not None:
                yield prefix, node[2]
            for child in (node[1] or {}).values():
                stack.append((child, prefix + child[0]))

    def items(self) -> Iterator[tuple[bytes, object]]:
        yield from self._below(self.root, b"")

    def evict(self) -> Iterator[tuple[bytes, object]]:
        """Takes the heaviest subtree below the root out of the trie and yields what it held."""
        first = max(self.by_first, key=self.by_first.get)
        self.size -= self.by_first.pop(first)
        child = self.root[1].pop(first)
        yield from self._below(child, child[0])
