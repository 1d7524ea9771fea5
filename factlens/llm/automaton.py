"""Small regular expressions over bytes, all compiled into one minimal deterministic automaton held as transition arrays.

Supported: literals, escapes (also \\xHH), classes with ranges, groups, alternation, `?`, `*`, `+`, `{m}`.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    """A rule fits `prefix` and then, if `run` is set, one or more bytes of that class; its run must have `least` bytes."""

    kind: str
    prefix: str
    run: str = ""
    least: int = 0
    any_case: bool = False  # letters of the prefix in either case


class Nfa:
    """Thompson's construction: edges[state] lists (byte set or None for a free move, next state)."""

    def __init__(self) -> None:
        self.edges: list[list[tuple[frozenset[int] | None, int]]] = []

    def state(self) -> int:
        self.edges.append([])
        return len(self.edges) - 1

    def closure(self, states: set[int]) -> frozenset[int]:
        stack, seen = list(states), set(states)
        while stack:
            for on, to in self.edges[stack.pop()]:
                if on is None and to not in seen:
                    seen.add(to)
                    stack.append(to)
        return frozenset(seen)


class _Parser:
    def __init__(self, nfa: Nfa, pattern: str, any_case: bool):
        self.nfa, self.text, self.at, self.any_case = nfa, pattern, 0, any_case

    def parse(self, start: int) -> int:
        end = self.choice(start)
        if self.at != len(self.text):
            raise ValueError(f"unexpected {self.text[self.at]!r} at {self.at} in {self.text!r}")
        return end

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def choice(self, start: int) -> int:
        end = self.nfa.state()
        while True:
            self.nfa.edges[self.sequence(start)].append((None, end))
            if self.peek() != "|":
                return end
            self.at += 1

    def sequence(self, start: int) -> int:
        while self.peek() not in ("", "|", ")"):
            start = self.repeated(start)
        return start

    def repeated(self, start: int) -> int:
        before, begin = self.at, self.nfa.state()
        self.nfa.edges[start].append((None, begin))
        end, out = self.atom(begin), self.nfa.state()
        sign = self.peek()
        if sign == "{":
            close = self.text.index("}", self.at)
            times, after = int(self.text[self.at + 1 : close]), close + 1
            for _ in range(times - 1):
                self.at = before
                end = self.atom(end)
            self.at = after
        elif sign in ("?", "*", "+") and sign:
            self.at += 1
            if sign in "?*":
                self.nfa.edges[begin].append((None, out))
            if sign in "*+":
                self.nfa.edges[end].append((None, begin))
        self.nfa.edges[end].append((None, out))
        return out

    def atom(self, start: int) -> int:
        if self.peek() == "(":
            self.at += 1
            end = self.choice(start)
            if self.peek() != ")":
                raise ValueError(f"no ) in {self.text!r}")
            self.at += 1
            return end
        found = self.charset() if self.peek() == "[" else {self.char()}
        if self.any_case:
            found |= {x ^ 32 for x in found if chr(x).isascii() and chr(x).isalpha()}
        end = self.nfa.state()
        self.nfa.edges[start].append((frozenset(found), end))
        return end

    def char(self) -> int:
        c = self.peek()
        self.at += 1
        if c != "\\":
            return ord(c)
        c = self.peek()
        self.at += 1
        if c != "x":
            return ord(c)
        self.at += 2
        return int(self.text[self.at - 2 : self.at], 16)

    def charset(self) -> set[int]:
        self.at += 1
        found: set[int] = set()
        while self.peek() != "]":
            low = high = self.char()
            if self.peek() == "-" and self.text[self.at + 1 : self.at + 2] != "]":
                self.at += 1
                high = self.char()
            found |= set(range(low, high + 1))
        self.at += 1
        return found


class _Compiled:
    """One rule's states: its own part of a combined state is a tuple of threads, the earliest start first.

    A thread is (states, hits, age): the states it may be in, whether it has matched (-1: no; a rule without an opening counts
    the bytes of its run, up to what it asks for, so that its many short runs need nothing done), and how many bytes ago it
    started (-1: the start is kept in the rule's register). A thread that has matched drops all later ones, since their
    starts lie inside its match.
    """

    def __init__(self, rule: Rule, number: int):
        self.number, self.rule = number, rule
        self.nfa = Nfa()
        start = self.nfa.state()
        end = _Parser(self.nfa, rule.prefix, rule.any_case).parse(start)
        # Hits that a match needs: runs behind an opening are measured when they end.
        self.least = max(1, rule.least) if rule.run and not rule.prefix else 0
        if rule.run:
            self.nfa.edges[end].append((frozenset(_Parser(self.nfa, rule.run, False).charset()), hit := self.nfa.state()))
            self.nfa.edges[hit].append((self.nfa.edges[end][-1][0], hit))
            end = hit
        self.end, self.fresh = end, self.nfa.closure({start})
        if end in self.fresh:
            raise ValueError(f"the rule {rule.kind} matches nothing at all")

    def _on(self, states: frozenset[int], byte: int) -> frozenset[int]:
        return self.nfa.closure({to for s in states for on, to in self.nfa.edges[s] if on is not None and byte in on})

    def step(self, threads: tuple, byte: int) -> tuple[tuple, list[tuple]]:
        """The threads after a byte, and what has to be done: ("end", number) before the byte, ("start", number, age) and ("run",
        number) after it."""
        todo: list[tuple] = []
        if threads and threads[0][1] >= 0:
            states, hits, age = threads[0]
            if on := self._on(states, byte):
                if self.end not in on:
                    raise ValueError(f"the rule {self.rule.kind} can go on after a match without matching")
                hits, age = min(hits + 1, self.least), age + (age >= 0)
                if hits == self.least and age >= 0:
                    todo.append(("start", self.number, age))
                    age = -1
                return ((on, hits, age),), todo
            if hits == self.least:
                todo.append(("end", self.number))
            threads = ()
        out, taken = [], frozenset()
        for states, _, age in [*threads, (self.fresh, -1, 0)]:
            on = self._on(states, byte) - taken
            if not on:
                continue
            taken |= on
            age += age >= 0
            if self.end in on:
                if out:
                    raise ValueError(f"the rule {self.rule.kind} can match inside an open match")
                hits = min(1, self.least)
                if age >= 0 and hits == self.least:
                    todo.append(("start", self.number, age))
                    age = -1
                return ((on, hits, age),), [*todo, ("run", self.number)] if self.rule.run and self.rule.prefix else todo
            if age > AGE:
                todo.append(("start", self.number, age))
                age = -1
            out.append((on, -1, age))
        if sum(age < 0 for _, _, age in out) > 1:
            raise ValueError(f"the rule {self.rule.kind} keeps two long openings at once")
        return tuple(out), todo

    def done(self, threads: tuple) -> list[tuple]:
        return [("end", self.number)] if threads and threads[0][1] == self.least else []


#: An opening's start is known from the state for so many bytes, and kept in a register beyond.
AGE = 32


@dataclass(frozen=True)
class Automaton:
    """All rules as one minimal deterministic automaton: moves[state + classes[byte]] is the next state, and where something
    has to be done, minus the number of an entry of `todo`: (next state, what to do). States are multiples of the number of
    classes, 0 the start; ends[state // width] is what to do at the end of a text."""

    classes: bytes
    width: int
    moves: list[int]
    todo: list[tuple[int, tuple]]
    ends: list[tuple]
    least: list[int]

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule number, end) of all matches with runs of the length asked for, in one pass over data: per rule
        leftmost, longest, not overlapping."""
        moves, todo, least, out, state = self.moves, self.todo, self.least, [], 0
        starts, runs = [0] * len(least), [0] * len(least)
        for i, c in enumerate(data.translate(self.classes)):
            state = moves[state + c]
            if state < 0:
                state, jobs = todo[-state]
                for job, r, *age in jobs:
                    if job == "start":
                        starts[r] = i + 1 - age[0]
                    elif job == "run":
                        runs[r] = i
                    elif i - runs[r] >= least[r]:
                        out.append((starts[r], r, i))
        return out + [(starts[r], r, len(data)) for _, r in self.ends[state // self.width] if len(data) - runs[r] >= least[r]]


def compile_rules(rules: tuple[Rule, ...]) -> Automaton:
    """The rules' combined automaton, by subset construction and minimisation."""
    own = [_Compiled(r, i) for i, r in enumerate(rules)]
    # Bytes that no edge of any rule tells apart share a class.
    sets = sorted({on for c in own for edges in c.nfa.edges for on, _ in edges if on is not None}, key=sorted)
    kinds: dict[tuple, int] = {}
    classes = bytes(kinds.setdefault(tuple(b in s for s in sets), len(kinds)) for b in range(256))
    example = {k: b for b, k in reversed(list(enumerate(classes)))}
    width = len(kinds)

    # Subset construction. A rule's own steps are few and recur in many combined states.
    known: dict[tuple, tuple] = {}
    first = tuple(() for _ in own)
    number, order, table = {first: 0}, [first], []
    for state in order:
        row = []
        for k in range(width):
            to, jobs = [], []
            for c, threads in zip(own, state, strict=True):
                key = (c.number, threads, k)
                if key not in known:
                    known[key] = c.step(threads, example[k])
                to.append(known[key][0])
                jobs += known[key][1]
            to = tuple(to)
            if to not in number:
                number[to] = len(order)
                order.append(to)
            # Ends come first: a new start must not overwrite the old one before.
            row.append((number[to], tuple(sorted(jobs, key=lambda j: j[0] != "end"))))
        table.append(row)
    ends = [tuple(x for c, threads in zip(own, state, strict=True) for x in c.done(threads)) for state in order]

    # Minimisation: blocks split until all states of a block do the same and lead to the same blocks.
    names: dict[tuple, int] = {}
    block = [names.setdefault((ends[i], *[jobs for _, jobs in row]), len(names)) for i, row in enumerate(table)]
    count = len(names)
    while True:
        names = {}
        block = [names.setdefault((block[i], *[block[t] for t, _ in row]), len(names)) for i, row in enumerate(table)]
        if len(names) == count:
            break
        count = len(names)
    found: dict[int, int] = {}
    for i, b in enumerate(block):
        found.setdefault(b, i)  # the start's block is the first
    place = {b: n for n, b in enumerate(found)}
    moves, todo, entry = [], [(0, ())], {}
    for i in found.values():
        for to, jobs in table[i]:
            at = place[block[to]] * width
            if jobs:
                if (at, jobs) not in entry:
                    entry[at, jobs] = len(todo)
                    todo.append((at, jobs))
                at = -entry[at, jobs]
            moves.append(at)
    return Automaton(classes, width, moves, todo, [ends[i] for i in found.values()], [r.least if r.prefix and r.run else 0 for r in rules])
