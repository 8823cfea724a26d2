"""Minimal acyclic automata over sorted words, with perfect-hash word numbers and one-error completion."""

from __future__ import annotations

from collections.abc import Iterator, Sequence


class Automaton:
    """Accepts the given distinct words, in code-point order; a word's number is its place among them.

    A state is shared by all prefixes with the same continuations, so the number of states does not
    grow with the number of words alone. Each arc has the number of words that its state
    accepts before it; the sum of these along a word is the word's number.
    """

    def __init__(self, words: Sequence[str]):
        self.arcs: list[dict[str, int]] = []
        self.before: list[dict[str, int]] = []
        self.final: list[bool] = []
        self._size: list[int] = []
        known: dict[tuple, int] = {}
        path: list[tuple[list[bool], dict[str, int]]] = [([False], {})]  # of the last word: end mark and arcs
        last = ""

        def settle(down_to: int) -> None:
            """States below ``down_to`` get no more arcs: they become states that are known, or new ones."""
            while len(path) > down_to:
                (end,), arcs = path.pop()
                key = (end, *arcs.items())
                state = known.get(key)
                if state is None:
                    state = known[key] = self._add(end, arcs)
                if not path:
                    self.start = state
                    return
                path[-1][1][last[len(path) - 1]] = state

        for word in words:
            shared, most = 0, min(len(word), len(last))
            while shared < most and word[shared] == last[shared]:
                shared += 1
            settle(shared + 1)
            path.extend(([False], {}) for _ in range(len(word) - shared))
            path[-1][0][0] = True
            last = word
        settle(0)

    def _add(self, end: bool, arcs: dict[str, int]) -> int:
        before, total = {}, int(end)
        for c, to in arcs.items():
            before[c] = total
            total += self._size[to]
        self.arcs.append(arcs)
        self.before.append(before)
        self.final.append(end)
        self._size.append(total)
        return len(self.arcs) - 1

    def _rest(self, state: int, word: str, at: int) -> int:
        """The number, counted from ``state``, of the word that goes on with word[at:], or -1."""
        total = 0
        for c in word[at:]:
            to = self.arcs[state].get(c)
            if to is None:
                return -1
            total += self.before[state][c]
            state = to
        return total if self.final[state] else -1

    def number(self, word: str) -> int:
        return self._rest(self.start, word, 0)

    def near(self, word: str, exact: int) -> Iterator[int]:
        """The numbers of the words that begin with word[:exact] and differ from ``word`` by one code point inserted, deleted or replaced behind it.

        Each number comes once: within a run of one code point, only its end is where one more or one less is.
        """
        state, total = self.start, 0
        for c in word[:exact]:
            to = self.arcs[state].get(c)
            if to is None:
                return
            total += self.before[state][c]
            state = to
        size = len(word)
        for i in range(exact, size + 1):
            arcs, before = self.arcs[state], self.before[state]
            here, after = word[i] if i < size else None, word[i + 1] if i + 1 < size else None
            if here is not None and here != after and (k := self._rest(state, word, i + 1)) >= 0:
                yield total + k
            for c, to in arcs.items():
                if c == here:
                    continue
                onward = self.arcs[to]
                if here is None:
                    if self.final[to]:
                        yield total + before[c]
                    continue
                if (self.final[to] if after is None else after in onward) and (k := self._rest(to, word, i + 1)) >= 0:
                    yield total + before[c] + k
                if here in onward and (k := self._rest(to, word, i)) >= 0:
                    yield total + before[c] + k
            if here is None or here not in arcs:
                return
            total += before[here]
            state = arcs[here]
