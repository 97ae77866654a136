"""Secret scans with one deterministic automaton for all rules.

The rules' expressions become one nondeterministic automaton, subset construction makes it deterministic, partition
refinement minimises it, and its transition array is walked once over a text's bytes. Where the walk reports the earliest
end of a rule's match, that rule's reversed automaton finds where the match starts and its own how far it reaches.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import SPANS, slices, with_fields

#: kind, expression, shortest match in characters. Expressions are over ASCII; case folding is written out by `either`.
#: A rule's match must not be able to hold another, earlier ending match of the same rule (all of these are of that kind).
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
VALUE = "[A-Za-z0-9+/_.=-]"
ASSIGN_VALUE_CHARS = 12


def either(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


RULES = (
    ("assign", f"({'|'.join(map(either, KEYWORDS))})[\"']?\\x20*[:=]\\x20*[\"']?{VALUE}+", 0),
    ("access", "AKIA[A-Z0-9]+", 18),
    ("hex", "[0-9a-f]{16,}", 16),
    ("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0),
    ("github", "gh[pousr]_[A-Za-z0-9]+", 40),
    ("slack", "xox[abprs]-[A-Za-z0-9-]+", 15),
    ("google", "AIza[A-Za-z0-9_-]+", 39),
    ("web_token", "eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+", 40),
)
BASE = ("assign", "access", "hex")


def parse(expression: str):
    """A tree of ("set", bytes), ("cat", trees), ("or", trees), ("repeat", tree, least, most or None)."""
    at = 0

    def char() -> int:
        nonlocal at
        c = expression[at]
        at += 1
        if c != "\\":
            return ord(c)
        c = expression[at]
        at += 1
        if c == "x":
            at += 2
            return int(expression[at - 2:at], 16)
        return ord(c)

    def choice():
        nonlocal at
        found = [sequence()]
        while at < len(expression) and expression[at] == "|":
            at += 1
            found.append(sequence())
        return found[0] if len(found) == 1 else ("or", found)

    def sequence():
        found = []
        while at < len(expression) and expression[at] not in "|)":
            found.append(repeated(atom()))
        return ("cat", found)

    def atom():
        nonlocal at
        if expression[at] == "(":
            at += 1
            inner = choice()
            at += 1
            return inner
        if expression[at] == "[":
            at += 1
            of: set[int] = set()
            while expression[at] != "]":
                low = char()
                if expression[at] == "-" and expression[at + 1] != "]":
                    at += 1
                    of |= set(range(low, char() + 1))
                else:
                    of.add(low)
            at += 1
            return ("set", frozenset(of))
        return ("set", frozenset([char()]))

    def repeated(tree):
        nonlocal at
        if at < len(expression) and expression[at] in "?*+":
            at += 1
            least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}[expression[at - 1]]
            return ("repeat", tree, least, most)
        if at < len(expression) and expression[at] == "{":
            stop = expression.index("}", at)
            least, _, most = expression[at + 1:stop].partition(",")
            most = (int(most) if most else None) if "," in expression[at:stop] else int(least)
            at = stop + 1
            return ("repeat", tree, int(least), most)
        return tree

    return choice()


def backwards(tree):
    if tree[0] == "cat":
        return ("cat", [backwards(x) for x in reversed(tree[1])])
    if tree[0] == "or":
        return ("or", [backwards(x) for x in tree[1]])
    return ("repeat", backwards(tree[1]), *tree[2:]) if tree[0] == "repeat" else tree


def shortest(tree):
    """The expression without what may follow the earliest end of a match."""
    if tree[0] == "cat":
        parts = list(tree[1])
        while parts and parts[-1][0] == "repeat" and parts[-1][2] == 0:
            parts.pop()
        return ("cat", [*parts[:-1], shortest(parts[-1])]) if parts else ("cat", [])
    if tree[0] == "or":
        return ("or", [shortest(x) for x in tree[1]])
    return ("repeat", tree[1], tree[2], tree[2]) if tree[0] == "repeat" else tree


class Automaton:
    """Deterministic and minimal. `classes` maps bytes to columns, `step[state + column]` is the next state, both states
    being multiples of `width`; state 0 is the first one. `accepts[state]` names the rules whose match may end there."""

    def __init__(self, trees: dict[str, tuple], anywhere: bool) -> None:
        moves: list[list[tuple[frozenset, int]]] = []
        free: list[list[int]] = []

        def state() -> int:
            moves.append([])
            free.append([])
            return len(moves) - 1

        def build(tree, start: int) -> int:
            if tree[0] == "set":
                end = state()
                moves[start].append((tree[1], end))
                return end
            if tree[0] == "cat":
                for x in tree[1]:
                    start = build(x, start)
                return start
            if tree[0] == "or":
                end = state()
                for x in tree[1]:
                    own = state()
                    free[start].append(own)
                    free[build(x, own)].append(end)
                return end
            _, x, least, most = tree
            for _ in range(least):
                start = build(x, start)
            end = state()
            if most is None:
                loop = state()
                free[start].append(loop)
                free[build(x, loop)].append(loop)
                free[loop].append(end)
            else:
                for _ in range(most - least):
                    free[start].append(end)
                    start = build(x, start)
                free[start].append(end)
            return end

        root = state()
        ends: dict[int, str] = {}
        for name, tree in trees.items():
            own = state()
            free[root].append(own)
            ends[build(tree, own)] = name

        def closure(states) -> frozenset:
            seen, left = set(states), list(states)
            while left:
                for x in free[left.pop()]:
                    if x not in seen:
                        seen.add(x)
                        left.append(x)
            return frozenset(seen)

        # Bytes that no set tells apart share a column.
        sets = list({s for m in moves for s, _ in m})
        by: dict[tuple, list[int]] = defaultdict(list)
        for b in range(256):
            by[tuple(b in s for s in sets)].append(b)
        columns = list(by.values())
        first = closure([root])
        number, left, rows = {first: 0}, [first], []
        while left:
            now = left.pop(0)
            row = []
            for column in columns:
                to = {x for s in now for of, x in moves[s] if column[0] in of}
                reached = closure(to | ({root} if anywhere else set()))
                if reached not in number:
                    number[reached] = len(number)
                    left.append(reached)
                row.append(number[reached])
            rows.append(row)
        names = [tuple(sorted(ends[s] for s in states if s in ends)) for states in number]
        # Minimise: states stay together while they accept the same and lead to the same groups.
        group = {}
        part = [group.setdefault(x, len(group)) for x in names]
        while True:
            group = {}
            finer = [group.setdefault((part[i], *(part[x] for x in rows[i])), len(group)) for i in range(len(rows))]
            if len(group) == len(set(part)):
                break
            part = finer
        # Accepting states get the highest numbers (state 0 never accepts: rules match at least one byte).
        kinds = {part[i]: names[i] for i in range(len(rows))}
        order = sorted(kinds, key=lambda p: (p != part[0], bool(kinds[p])))
        place = {p: i for i, p in enumerate(order)}
        self.width = len(columns)
        self.classes = bytes(next(i for i, column in enumerate(columns) if b in column) for b in range(256))
        sample = {part[i]: i for i in range(len(rows))}
        self.step = [place[part[x]] * self.width for p in order for x in rows[sample[p]]]
        self.accepts = {place[p] * self.width: k for p, k in kinds.items() if k}
        self.first_accepting = min(self.accepts)
        # A state that leads only to itself and accepts nothing ends an anchored walk.
        self.dead = next((s for s in range(0, len(self.step), self.width) if s not in self.accepts and set(self.step[s:s + self.width]) == {s}), -1)


class Scanner:
    def __init__(self, rules=RULES) -> None:
        trees = {kind: parse(e) for kind, e, _ in rules}
        self.least = {kind: n for kind, _, n in rules}
        self.rank = {kind: i for i, (kind, _, _) in enumerate(rules)}
        self.all = Automaton({k: shortest(t) for k, t in trees.items()}, anywhere=True)
        self.on = {k: Automaton({k: t}, anywhere=False) for k, t in trees.items()}
        self.back = {k: Automaton({k: backwards(t)}, anywhere=False) for k, t in trees.items()}

    @staticmethod
    def reach(machine: Automaton, data: bytes, at: int, stop: int, way: int) -> int:
        """How far a match from `at` goes at most, walking in steps of `way` up to `stop`; `at` itself if there is none."""
        step, classes, accepts, state, best = machine.step, machine.classes, machine.accepts, 0, at
        i = at
        while i != stop:
            state = step[state + classes[data[i if way > 0 else i - 1]]]
            if state == machine.dead:
                break
            i += way
            if state in accepts:
                best = i
        return best

    def raw(self, data: bytes) -> list[tuple[str, int, int]]:
        """Leftmost, longest, non-overlapping matches of each rule, in bytes."""
        machine = self.all
        step, limit, state, found = machine.step, machine.first_accepting, 0, []
        done: dict[str, int] = defaultdict(int)
        for i, column in enumerate(data.translate(machine.classes)):
            state = step[state + column]
            if state >= limit:
                for kind in machine.accepts[state]:
                    if i >= done[kind]:
                        start = self.reach(self.back[kind], data, i + 1, done[kind], -1)
                        if start <= i:
                            done[kind] = self.reach(self.on[kind], data, start, len(data), 1)
                            found.append((kind, start, done[kind]))
        return found

    def scan(self, text: str) -> list[dict]:
        """Spans in code points, by start and then by the order of the rules."""
        data = text.encode()
        kept = []
        for kind, start, end in self.raw(data):
            if end - start >= self.least[kind] and (kind != "assign" or len(value_of(data[start:end])) >= ASSIGN_VALUE_CHARS):
                kept.append((start, self.rank[kind], kind, end))
        kept.sort()
        if len(data) != len(text):
            marks = sorted({x for start, _, _, end in kept for x in (start, end)})
            place, before, points = {}, 0, 0
            for m in marks:
                points += len(data[before:m].decode())
                place[m] = before = m
                place[m] = points
            kept = [(place[s], r, k, place[e]) for s, r, k, e in kept]
        return [{"kind": k, "start": s, "end": e} for s, _, k, e in kept]


#: The worker's scanners by their rules: built once, used by all its tasks.
_scanners: dict[tuple, Scanner] = {}


def value_of(match: bytes) -> bytes:
    """What is assigned in a match of the rule `assign`."""
    low = match.lower()
    word = next(w for w in KEYWORDS if low.startswith(w.encode()))
    rest = match[len(word):].lstrip(b"\"'").lstrip(b" ")[1:].lstrip(b" ")
    return rest[1:] if rest[:1] in (b'"', b"'") else rest


def find_secrets(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """Add `spans`: array of (kind, start, end) in code points of the whole text, by start, then by the rules' order.

    Per rule the matches are leftmost, longest and do not overlap; those too short are dropped afterwards. Matches
    begin and end at ASCII characters, so working on bytes changes nothing. Null and empty texts have no spans.
    Repeated rows give repeated results, empty tables empty ones; a column named spans is replaced. No shuffle; the
    walk takes one step a byte, so a very long text takes time in proportion.
    """
    kept = [c for c in docs.columns if c != "spans"]
    schema = with_fields(docs.select(*kept), f"spans {SPANS}")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if rules not in _scanners:
            _scanners[rules] = Scanner(rules)
        scanner = _scanners[rules]
        for batch in slices(batches, text):
            spans = [scanner.scan(x or "") for x in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, kind)], names=[*kept, "spans"])

    return docs.select(*kept).mapInArrow(run, schema)
