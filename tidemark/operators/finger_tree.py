"""A finger B-tree of partial aggregates.

Keys are event-time slots, values are counts (any commutative monoid with ``+`` would do). The finger is the rightmost
leaf. Totals are kept at every node that isn't on the right spine; an insert near the end touches the finger leaf only,
a late one climbs from the finger to the first spine node that covers its key and corrects the totals on the way down,
so its cost is logarithmic in its distance from the end. ``evict`` cuts whole subtrees below a key; ``admit``
refuses what lies there from then on.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

WIDTH = 16


class _Node:
    __slots__ = ("keys", "kids", "vals", "total", "parent")

    def __init__(self, keys: list, vals: list | None, kids: list | None) -> None:
        self.keys, self.vals, self.kids, self.total, self.parent = keys, vals, kids, 0, None

    def settle(self) -> None:
        """Recompute the total from the level below."""
        self.total = sum(self.vals) if self.kids is None else sum(k.total for k in self.kids)


class FingerTree:
    def __init__(self) -> None:
        self.root = self.finger = _Node([], [], None)
        self.bound: int | None = None

    @property
    def empty(self) -> bool:
        return not self.finger.keys

    def first(self) -> int | None:
        """The smallest key."""
        n = self.root
        while n.kids is not None:
            n = n.kids[0]
        return n.keys[0] if n.keys else None

    def items(self):
        """(key, value) in order."""
        todo = [self.root]
        while todo:
            n = todo.pop()
            if n.kids is None:
                yield from zip(n.keys, n.vals)
            else:
                todo.extend(reversed(n.kids))

    def admit(self, key: int, value: int) -> bool:
        """Add, unless the key lies in the evicted part; whether it was added."""
        if self.bound is not None and key < self.bound:
            return False
        self.add(key, value)
        return True

    def add(self, key: int, value: int) -> None:
        n = self.finger
        if not n.keys or key >= n.keys[0] or n.parent is None:
            self._into(n, key, value)
            return
        n = n.parent
        while n.parent is not None and key < n.keys[0]:
            n = n.parent
        spine = True
        while n.kids is not None:
            at = max(0, bisect_right(n.keys, key) - 1)
            if key < n.keys[at]:
                n.keys[at] = key
            spine = spine and at == len(n.kids) - 1
            n = n.kids[at]
            if not spine:
                n.total += value
        self._into(n, key, value)
        # a key below all others lowers the separators above the node where the climb ended
        while n.parent is not None and n.parent.kids[0] is n and n.parent.keys[0] > n.keys[0]:
            n.parent.keys[0] = n.keys[0]
            n = n.parent

    def _into(self, leaf: _Node, key: int, value: int) -> None:
        at = bisect_left(leaf.keys, key)
        if at < len(leaf.keys) and leaf.keys[at] == key:
            leaf.vals[at] += value
            return
        leaf.keys.insert(at, key)
        leaf.vals.insert(at, value)
        if len(leaf.keys) > WIDTH:
            self._split(leaf)

    def _split(self, n: _Node) -> None:
        half = len(n.keys) // 2
        leaf = n.kids is None
        right = _Node(n.keys[half:], n.vals[half:] if leaf else None, None if leaf else n.kids[half:])
        del n.keys[half:]
        if leaf:
            del n.vals[half:]
        else:
            del n.kids[half:]
            for k in right.kids:
                k.parent = right
        if n is self.finger:
            self.finger = right
        n.settle()
        right.settle()
        up = n.parent
        if up is None:
            up = self.root = _Node([n.keys[0]], None, [n])
            n.parent = up
        at = up.kids.index(n) + 1
        up.kids.insert(at, right)
        up.keys.insert(at, right.keys[0])
        right.parent = up
        if len(up.kids) > WIDTH:
            self._split(up)

    def range_total(self, low: int, high: int) -> int:
        """The total of the keys from low up to but without high; inner subtrees answer with their kept totals."""

        def of(n: _Node, spine: bool, lo: int | None, hi: int | None) -> int:
            if lo is None and hi is None and not spine:
                return n.total
            if n.kids is None:
                a = 0 if lo is None else bisect_left(n.keys, lo)
                b = len(n.keys) if hi is None else bisect_left(n.keys, hi)
                return sum(n.vals[a:b])
            last = len(n.kids) - 1
            a = 0 if lo is None else max(0, bisect_right(n.keys, lo) - 1)
            b = last if hi is None else max(0, bisect_left(n.keys, hi) - 1)
            return sum(of(n.kids[i], spine and i == last, lo if i == a else None, hi if i == b else None) for i in range(a, b + 1))

        return of(self.root, True, low, high) if low < high else 0

    def evict(self, before: int) -> None:
        """Drop all keys below ``before``: whole subtrees at once, then one path is trimmed."""
        n, path = self.root, []
        self.bound = before if self.bound is None else max(self.bound, before)
        while n.kids is not None:
            at = max(0, bisect_right(n.keys, before) - 1)
            del n.kids[:at], n.keys[:at]
            path.append(n)
            n = n.kids[0]
        at = bisect_left(n.keys, before)
        del n.keys[:at], n.vals[:at]
        n.settle()
        while path:
            up = path.pop()
            if not up.kids[0].keys:
                if len(up.kids) > 1:
                    del up.kids[0], up.keys[0]
                else:
                    up.keys.clear()
            if up.keys:
                up.keys[0] = up.kids[0].keys[0]
            up.settle()
        if not self.finger.keys:
            self.root = self.finger = _Node([], [], None)
            return
        while self.root.kids is not None and len(self.root.kids) == 1:
            self.root = self.root.kids[0]
            self.root.parent = None
