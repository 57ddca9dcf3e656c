"""An adaptive radix tree over byte keys: path compression, and children in a layout that grows with their number."""

from __future__ import annotations

from bisect import bisect_left


class Few:
    """Up to ``room`` (4, then 16) children: their bytes in order beside them."""

    __slots__ = ("room", "bytes", "nodes")

    def __init__(self, room: int):
        self.room, self.bytes, self.nodes = room, bytearray(), []

    def get(self, byte: int):
        at = bisect_left(self.bytes, byte)
        return self.nodes[at] if at < len(self.bytes) and self.bytes[at] == byte else None

    def put(self, byte: int, node):
        """Set a child; the layout to use from now on."""
        at = bisect_left(self.bytes, byte)
        if at < len(self.bytes) and self.bytes[at] == byte:
            self.nodes[at] = node
            return self
        if len(self.nodes) == self.room:
            grown = Few(16) if self.room == 4 else Indexed()
            for b, n in self.children():
                grown.put(b, n)
            return grown.put(byte, node)
        self.bytes.insert(at, byte)
        self.nodes.insert(at, node)
        return self

    def children(self):
        return zip(self.bytes, self.nodes)


class Indexed:
    """Up to 48 children: the slot of each byte, 0 for none."""

    __slots__ = ("slots", "nodes")

    def __init__(self):
        self.slots, self.nodes = bytearray(256), []

    def get(self, byte: int):
        slot = self.slots[byte]
        return self.nodes[slot - 1] if slot else None

    def put(self, byte: int, node):
        if self.slots[byte]:
            self.nodes[self.slots[byte] - 1] = node
            return self
        if len(self.nodes) == 48:
            grown = Full()
            for b, n in self.children():
                grown.put(b, n)
            return grown.put(byte, node)
        self.nodes.append(node)
        self.slots[byte] = len(self.nodes)
        return self

    def children(self):
        return ((b, self.nodes[s - 1]) for b, s in enumerate(self.slots) if s)


class Full:
    """A child for every byte."""

    __slots__ = ("nodes",)

    def __init__(self):
        self.nodes = [None] * 256

    def get(self, byte: int):
        return self.nodes[byte]

    def put(self, byte: int, node):
        self.nodes[byte] = node
        return self

    def children(self):
        return ((b, n) for b, n in enumerate(self.nodes) if n is not None)


class Node:
    """``path`` are the bytes from the parent to here, the branching byte first; ``entry`` belongs to the key that ends here."""

    __slots__ = ("path", "entry", "layout")

    def __init__(self, path: bytes, entry=None):
        self.path, self.entry, self.layout = path, entry, None

    def get(self, byte: int):
        return self.layout.get(byte) if self.layout is not None else None

    def put(self, node: Node):
        self.layout = (self.layout if self.layout is not None else Few(4)).put(node.path[0], node)

    def children(self):
        return self.layout.children() if self.layout is not None else ()


def _shared(path: bytes, key: bytes, at: int) -> int:
    if key.startswith(path, at):
        return len(path)
    low, high = 0, min(len(path), len(key) - at)
    while low < high:  # the longest head of the path that the key has here
        middle = (low + high + 1) // 2
        low, high = (middle, high) if key.startswith(path[:middle], at) else (low, middle - 1)
    return low


class RadixTree:
    def __init__(self):
        self.root = Node(b"")

    def insert(self, key: bytes, entry) -> None:
        """Add a key; a key that is there gets the new entry."""
        above, node, at = None, self.root, 0
        while True:
            shared = _shared(node.path, key, at)
            at += shared
            if shared < len(node.path):
                upper = Node(node.path[:shared])
                node.path = node.path[shared:]
                upper.put(node)
                above.put(upper)
                node = upper
            if at == len(key):
                node.entry = entry
                return
            child = node.get(key[at])
            if child is None:
                node.put(Node(key[at:], entry))
                return
            above, node = node, child

    def route(self, key: bytes) -> list[Node]:
        """The nodes from the root to the end of a key that is there."""
        node, at, out = self.root, 0, [self.root]
        while at < len(key):
            node = node.get(key[at])
            at += len(node.path)
            out.append(node)
        return out

    def nodes(self):
        """Every node with the byte depth of its parent (-1 for the root) and its parent's place in this list; parents first."""
        out, stack = [], [(self.root, -1, -1)]
        while stack:
            node, above, parent = stack.pop()
            out.append((node, above, parent))
            depth, here = max(above, 0) + len(node.path), len(out) - 1
            stack.extend((child, depth, here) for _, child in node.children())
        return out
