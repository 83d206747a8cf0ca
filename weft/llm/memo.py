"""A bounded memo in two generations, for work done once per distinct word of a worker."""

from __future__ import annotations

from collections.abc import Callable, Iterable

#: Bytes of a generation, by estimate.
BUDGET = 48 << 20
#: Bytes that a key and its value have besides their characters, with their place in the table.
ENTRY = 200
#: Longer keys are worked out again in each chunk.
LONG = 200


class Memo:
    """Values (bytes) by key (text), in at most ``2 * budget`` bytes and one chunk's keys.

    A key in use outlives the turn of a generation. Keys over ``LONG`` characters, whole
    texts without a space maybe, are held for a chunk only.
    """

    def __init__(self, compute: Callable[[list], Iterable], budget: int = BUDGET):
        self.compute, self.budget = compute, budget
        self.young: dict = {}
        self.old: dict = {}
        self.used = 0

    def getter(self, lists: list[list]) -> Callable:
        """A lookup that holds every key of ``lists``."""
        young, old = self.young, self.old
        fresh = set().union(*lists).difference(young)
        todo, size, long = [], 0, False
        for k in fresh:
            if (v := old.get(k)) is None:
                todo.append(k)
            else:
                young[k] = v
                size += len(k) + len(v)
        for k, v in zip(todo, self.compute(todo)):
            young[k] = v
            if len(k) > LONG:
                long = True
            else:
                size += len(k) + len(v)
        self.used += size + ENTRY * len(fresh)
        if self.used > self.budget:
            self.old, self.young, self.used = young, {}, 0
        if long:
            # the chunk keeps its own table; the memo goes on without the long keys
            held = {k: v for k, v in young.items() if len(k) <= LONG}
            if self.young is young:
                self.young = held
            else:
                self.old = held
        return young.__getitem__

