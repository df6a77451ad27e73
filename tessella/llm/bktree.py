"""A tree over bit strings in which a child hangs below its parent at the key of their Hamming distance."""

from __future__ import annotations


class BKTree:
    """Values are distinct integers; nodes are numbered in the order of insertion."""

    __slots__ = ("values", "children")

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        me = len(self.values)
        if me:
            at = 0
            while True:
                key = (self.values[at] ^ value).bit_count()
                below = self.children[at].get(key)
                if below is None:
                    self.children[at][key] = me
                    break
                at = below
        self.values.append(value)
        self.children.append({})
        return me

    def within(self, value: int, radius: int) -> list[int]:
        """Nodes at most `radius` away: by the triangle inequality they lie below edges within `radius` of the parent's distance."""
        if not self.values:
            return []
        found, open_nodes = [], [0]
        values, children = self.values, self.children
        while open_nodes:
            at = open_nodes.pop()
            d = (values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            below = children[at]
            if below:
                if len(below) <= 2 * radius + 1:
                    open_nodes.extend(n for k, n in below.items() if d - radius <= k <= d + radius)
                else:
                    open_nodes.extend(below[k] for k in range(d - radius, d + radius + 1) if k in below)
        return found


class Groups:
    """Disjoint sets over 0..n-1."""

    __slots__ = ("up",)

    def __init__(self) -> None:
        self.up: list[int] = []

    def add(self) -> None:
        self.up.append(len(self.up))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
