"""Greedy matching of strings that hold each other, by automata instead of comparing everything with everything.

`held` finds, in one pass over a text, which of many strings stand in it. Predictions take gold rows in order, and a gold row
that is taken is never free again, so every list of gold rows is read once from front to back.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable

import ahocorasick

#: Comparisons of a group under which an automaton doesn't pay.
FEW = 2048


class Strings:
    """Distinct strings, and which of them stand in a text; an empty one stands in each."""

    def __init__(self, strings: Iterable[str]) -> None:
        self.own = set(strings)
        self.automaton = ahocorasick.Automaton()
        for s in self.own - {""}:
            self.automaton.add_word(s, s)
        if len(self.automaton):
            self.automaton.make_automaton()

    def held(self, text: str) -> set[str]:
        found = {s for _, s in self.automaton.iter(text)} if len(self.automaton) else set()
        return found | ({""} & self.own)


class Queue:
    """Places of gold rows in order; the first that is free."""

    def __init__(self, places: list[int]) -> None:
        self.places, self.at = places, 0

    def first(self, taken: list[bool]) -> int | None:
        while self.at < len(self.places) and taken[self.places[self.at]]:
            self.at += 1
        return self.places[self.at] if self.at < len(self.places) else None


class Within:
    """Gold strings by scope, asked for those that hold a prediction's string or are held by it."""

    def __init__(self, gold: list[tuple], asked: Iterable[tuple], skip_empty: bool) -> None:
        """gold, asked: (scope, string). skip_empty: an empty gold string fits nothing."""
        own: dict[tuple, list[int]] = defaultdict(list)
        for k, x in enumerate(gold):
            if x[1] or not skip_empty:
                own[x].append(k)
        by_scope, wanted = defaultdict(list), defaultdict(set)
        for scope, s in own:
            by_scope[scope].append(s)
        for scope, s in asked:
            wanted[scope].add(s)
        self.own = {x: Queue(p) for x, p in own.items()}
        self.strings = {scope: Strings(s) for scope, s in by_scope.items() if scope in wanted}
        holders: dict[tuple, list[int]] = defaultdict(list)
        for scope in self.strings:
            these = Strings(wanted[scope])
            for s in by_scope[scope]:
                for p in these.held(s) - {s}:
                    holders[scope, p].extend(own[scope, s])
        self.holders = {x: Queue(sorted(p)) for x, p in holders.items()}
        self.known: dict[tuple, list[Queue]] = {}

    def queues(self, scope: object, s: str) -> list[Queue]:
        """Lists of places that together are all fitting ones."""
        if (scope, s) not in self.known:
            inside = self.strings[scope].held(s) if scope in self.strings else ()
            more = self.holders.get((scope, s))
            self.known[scope, s] = [self.own[scope, g] for g in inside] + ([more] if more else [])
        return self.known[scope, s]

    def places(self, scope: object, s: str) -> list[int]:
        return sorted(k for q in self.queues(scope, s) for k in q.places)


def take_any(predicted: list[dict], gold: list[dict], fields: list[tuple[str, str, bool]], scope: Callable[[dict], object] = lambda r: None) -> list[int | None]:
    """For each prediction the first free gold row of its scope that fits in one of the fields, or None.

    fields: (the prediction's field, gold's field, whether an empty gold value fits nothing).
    """
    if len(predicted) * len(gold) <= FEW:
        fits = lambda p, g: scope(p) == scope(g) and any((g[b] or not skip) and (g[b] in p[a] or p[a] in g[b]) for a, b, skip in fields)
        return _one_by_one(predicted, gold, fits)
    index = [(a, Within([(scope(g), g[b]) for g in gold], ((scope(p), p[a]) for p in predicted), skip)) for a, b, skip in fields]
    taken, out = [False] * len(gold), []
    for p in predicted:
        found = [k for a, own in index for q in own.queues(scope(p), p[a]) if (k := q.first(taken)) is not None]
        out.append(min(found, default=None))
        if found:
            taken[out[-1]] = True
    return out


def take_all(predicted: list[dict], gold: list[dict], fields: list[tuple[str, str]]) -> list[int | None]:
    """As take_any, but a gold row has to fit in all of the fields: those that fit in the rarest are looked through."""
    fits = lambda p, g: all(g[b] in p[a] or p[a] in g[b] for a, b in fields)
    if len(predicted) * len(gold) <= FEW:
        return _one_by_one(predicted, gold, fits)
    index = [(a, Within([(None, g[b]) for g in gold], ((None, p[a]) for p in predicted), False)) for a, b in fields]
    taken, out, known = [False] * len(gold), [], {}
    for p in predicted:
        key = tuple(p[a] for a, _ in fields)
        if key not in known:
            few = min(((sum(len(q.places) for q in own.queues(None, p[a])), k) for k, (a, own) in enumerate(index)))[1]
            a, own = index[few]
            known[key] = Queue([k for k in own.places(None, p[a]) if fits(p, gold[k])])
        k = known[key].first(taken)
        out.append(k)
        if k is not None:
            taken[k] = True
    return out


def _one_by_one(predicted: list[dict], gold: list[dict], fits: Callable[[dict, dict], bool]) -> list[int | None]:
    free, out = list(range(len(gold))), []
    for p in predicted:
        n = next((n for n, k in enumerate(free) if fits(p, gold[k])), None)
        out.append(None if n is None else free.pop(n))
    return out
