"""Closure of a few triples in the driver, for ontologies whose rules are all local (see `rowwise`)."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

from ..terms import OWL, RDF
from .reasoner import MEMBER, Rule

TYPE = RDF + "type"
#: Triples and bindings of one round up to which the work is done here.
TRIPLES, BINDINGS = 200_000, 5_000_000


class TooMuch(Exception):
    """The triples are none for this module."""


def instance(pattern: tuple) -> bool:
    _, p, o = pattern
    return p[0] == "?" or p == TYPE and o[0] == "?"


def is_local(rule: Rule) -> bool:
    """Whether a rule derives from single subjects of tables, whatever their cells' values, nothing but triples of theirs."""
    about = [b for b in rule.body if instance(b)]
    if not about:
        return True
    subjects, objects = {b[0] for b in about}, [b[2] for b in about if b[1][0] == "?"]
    x = about[0][0]
    return len(subjects) == 1 and x not in objects and len(set(objects)) == len(objects) and rule.unequal is None and all(h[0] == x for h in rule.head)


class Triples:
    def __init__(self) -> None:
        self.all: set[tuple[str, str, str]] = set()
        self.of: dict = defaultdict(list)
        self.objects: dict = defaultdict(list)
        self.subjects: dict = defaultdict(list)

    def add(self, t: tuple[str, str, str]) -> None:
        if t not in self.all:
            self.all.add(t)
            s, p, o = t
            self.of[p].append((s, o))
            self.objects[s, p].append(o)
            self.subjects[p, o].append(s)

    def may(self, pattern: tuple) -> bool:
        _, p, o = pattern
        return (p, o) in self.subjects if p == TYPE and o[0] != "?" else p in self.of

    def active(self, rule: Rule) -> bool:
        """Whether there is what a rule wants of the vocabulary."""
        return all(self.may(b) for b in rule.body if not instance(b))

    def bindings(self, body: tuple, bound: dict) -> Iterator[dict]:
        if not body:
            yield bound
            return
        s, p, o = (bound.get(x, x) for x in body[0])
        if s[0] != "?" and o[0] != "?":
            found = [(s, o)] if (s, p, o) in self.all else []
        elif s[0] != "?":
            found = [(s, y) for y in self.objects.get((s, p), ())]
        elif o[0] != "?":
            found = [(x, o) for x in self.subjects.get((p, o), ())]
        else:
            found = self.of.get(p, ())
        for x, y in found:
            if s[0] != "?" or o[0] != "?" or s != o or x == y:
                yield from self.bindings(body[1:], bound | ({s: x} if s[0] == "?" else {}) | ({o: y} if o[0] == "?" else {}))

    def solutions(self, rule: Rule) -> Iterator[dict]:
        if any(x in ("ZERO", "ONE") for b in rule.body for x in b) or not self.active(rule):  # there are no numbers
            return
        for n, b in enumerate(self.bindings(rule.body, {})):
            if n > BINDINGS:
                raise TooMuch
            if rule.unequal is None or b[rule.unequal[0]] != b[rule.unequal[1]]:
                yield b

    def lists(self) -> dict[str, set[tuple[int, str]]]:
        """(position, member) of each list."""
        out = {}
        for head in {s for s, _ in self.of.get(RDF + "first", ())}:
            at, seen, k, rows = {head}, set(), 0, set()
            while at:
                if at & seen:
                    raise TooMuch  # a list that doesn't end
                seen |= at
                rows |= {(k, m) for n in at for m in self.objects.get((n, RDF + "first"), ())}
                at, k = {x for n in at for x in self.objects.get((n, RDF + "rest"), ())} - {RDF + "nil"}, k + 1
            out[head] = rows
        return out


def close(start: list[tuple[str, str, str]], rules: list[Rule], contradictions: list[Rule]) -> tuple[list[tuple[str, str, str]], list[str], int]:
    """(triples that the rules add, contradictions found, rounds); TooMuch if a rule is not local or there are too many triples."""
    t = Triples()
    for x in start:
        t.add(x)
    before, rounds = set(t.all), 0
    while True:
        size = len(t.all)
        if size > TRIPLES or any(OWL + p in t.of for p in ("hasKey", "propertyChainAxiom")):
            raise TooMuch
        lists = t.lists()
        for head, rows in lists.items():
            for _, m in rows:
                t.add((head, MEMBER, m))
        things = all(o == OWL + "Thing" for _, o in t.of.get(OWL + "someValuesFrom", ()))
        made: set[tuple[str, str, str]] = set()
        for r in rules + contradictions:
            if not is_local(r):
                if t.active(r) and not (r.name == "cls-svf1" and things):  # that adds nothing to cls-svf2 for owl:Thing
                    raise TooMuch
            elif r.head:
                for b in t.solutions(r):
                    made.update(tuple(b.get(x, x) for x in h) for h in r.head)
        for c, head in t.of.get(OWL + "intersectionOf", ()):
            rows = lists.get(head, set())
            have: dict[str, set[int]] = defaultdict(set)
            for k, m in rows:
                for x in t.subjects.get((TYPE, m), ()):
                    have[x].add(k)
            made.update((x, TYPE, c) for x, places in have.items() if len(places) == len(rows))
        for x in made:
            if not x[0].startswith('"') and not x[1].startswith(('"', "_:")):
                t.add(x)
        rounds += 1
        if len(t.all) == size:
            break
    found = [r.name for r in contradictions if is_local(r) and next(t.solutions(r), None) is not None]
    return sorted(x for x in t.all - before if x[1] != MEMBER), found, rounds
