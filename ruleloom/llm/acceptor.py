"""Minimised acyclic acceptors of word lists, and their composition with a one-edit transducer and themselves."""

from __future__ import annotations

from collections.abc import Iterable, Iterator


class Acceptor:
    """The minimal deterministic acceptor of sorted, different words. A state's successors have smaller numbers than itself."""

    def __init__(self, words: Iterable[str]):
        self.final: list[bool] = []
        self.next: list[dict[str, int]] = []
        known: dict[tuple, int] = {}
        # The states along the last word: whether they end a word, and their edges so far. Only these can still change.
        path: list[tuple[list[bool], dict[str, int]]] = [([False], {})]
        last = ""

        def close(length: int) -> None:
            while len(path) > length + 1:
                (final,), edges = path.pop()
                path[-1][1][last[len(path) - 1]] = self._state(known, final, edges)

        for word in words:
            shared = 0
            while shared < min(len(word), len(last)) and word[shared] == last[shared]:
                shared += 1
            close(shared)
            path.extend(([False], {}) for _ in range(len(word) - shared))
            path[-1][0][0] = True
            last = word
        close(0)
        self.start = self._state(known, path[0][0][0], path[0][1])

    def _state(self, known: dict[tuple, int], final: bool, edges: dict[str, int]) -> int:
        state = known.setdefault((final, *edges.items()), len(self.next))
        if state == len(self.next):
            self.final.append(final)
            self.next.append(edges)
        return state

    def words(self) -> Iterator[str]:
        yield from Composition(self).shared(self.start, self.start)


class Composition:
    """Acceptor, one-edit transducer and acceptor again, trimmed to the states from which a pair of words is accepted.

    Before the edit both sides are in one state, as they have read the same. The edit reads a symbol on the left for another
    one on the right, or for none; after it, both sides read the same again, from two states. Pairs are unordered: of a
    replacement the left symbol is the smaller, and a pair that differs in length has the longer word on the left. Of a run of
    equal symbols the last is the one that is left out, so every pair is accepted along one path.
    """

    def __init__(self, acceptor: Acceptor):
        self.of = acceptor
        self._meets: dict[tuple[int, int], bool] = {}

    def meets(self, p: int, q: int) -> bool:
        """Whether some string leads from both states to the end of a word."""
        final, after, known = self.of.final, self.of.next, self._meets
        stack = [(p, q) if p < q else (q, p)]
        while stack:
            pair = stack[-1]
            if pair not in known:
                a, b = pair
                if a == b or (final[a] and final[b]):
                    known[pair] = True
                else:
                    open_, met = [], False
                    for symbol, x in after[a].items():
                        y = after[b].get(symbol)
                        if y is not None:
                            below = (x, y) if x < y else (y, x)
                            met = met or known.get(below, False)
                            if below not in known:
                                open_.append(below)
                    if open_ and not met:
                        stack.append(open_[0])
                        continue
                    known[pair] = met
            stack.pop()
        return known[(p, q) if p < q else (q, p)]

    def shared(self, p: int, q: int, without: str = "") -> Iterator[str]:
        """The strings that lead from both states to the end of a word, but those that begin with `without`."""
        final, after = self.of.final, self.of.next
        path: list[str] = []
        stack = [(p, q, 0, "")]
        while stack:
            a, b, depth, symbol = stack.pop()
            del path[max(depth - 1, 0) :]
            path.append(symbol)
            if final[a] and final[b]:
                yield "".join(path)
            for symbol, x in after[a].items():
                y = after[b].get(symbol)
                if y is not None and (depth or symbol != without) and self.meets(x, y):
                    stack.append((x, y, depth + 1, symbol))
            if not depth:
                path.clear()

    def _edits(self, state: int) -> list[tuple[str, str, int, int, str]]:
        """(left symbol, right symbol, left state, right state, symbol that may not follow) of the edits possible in a state."""
        final, after = self.of.final, self.of.next
        edges = sorted(after[state].items())
        found = []
        for k, (c, x) in enumerate(edges):
            found.extend((c, d, x, y, "") for d, y in edges[k + 1 :] if self.meets(x, y))
            ends = final[x] and final[state]
            if ends or any(e != c and e in after[x] and self.meets(after[x][e], y) for e, y in edges):
                found.append((c, "", x, state, c))
        return found

    def pairs(self) -> Iterator[tuple[str, str]]:
        """Every pair of words one edit apart, once."""
        edits = [self._edits(state) for state in range(len(self.of.next))]
        live: list[bool] = []
        for state, own in enumerate(edits):
            live.append(bool(own) or any(live[x] for x in self.of.next[state].values()))
        path: list[str] = []
        stack = [(self.of.start, 0, "")]
        while stack:
            state, depth, symbol = stack.pop()
            del path[max(depth - 1, 0) :]
            path.append(symbol)
            if edits[state]:
                before = "".join(path)
                for c, d, x, y, without in edits[state]:
                    for rest in self.shared(x, y, without):
                        yield before + c + rest, before + d + rest
            stack.extend((x, depth + 1, c) for c, x in self.of.next[state].items() if live[x])
            if not depth:
                path.clear()
