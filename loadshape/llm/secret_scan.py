"""Secret scans: all rules in one minimised automaton that reads every byte once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadshape.llm.common import without


@dataclass(frozen=True)
class Rule:
    """A secret of ``kind``: ``head``, read as far as it matches, then ``value`` of ``least`` characters or more.

    Patterns know literals, escapes, classes, groups, ``|``, ``?``, ``*``, ``+`` and ``{n}``, ``{n,}``, ``{n,m}``,
    all ASCII.  Matches of one rule don't overlap and are found leftmost, then longest; one with a shorter
    value is dropped, yet has used up its text.
    """

    kind: str
    head: str
    value: str
    least: int
    any_case: bool = False


# fixed values
BASE_RULES = (
    Rule(
        "assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=-]+", 6,
        any_case=True,
    ),
    Rule("access", "", r"AKIA[A-Z0-9]+", 20),
    # runs under 24 drop anyway: to ask for 8 at once finds the same runs and flags hardly a word
    Rule("hex", "", r"[0-9a-f]{8,}", 24),
)
MORE_RULES = (
    Rule("pem", "", r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----", 27),
    Rule("github", "", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("jwt", "", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 30),
)
RULES = BASE_RULES + MORE_RULES

#: Ends a text; UTF-8 never has this byte, so every automaton starts anew after it.
END = 0xFF


class _Nfa:
    """Thompson's construction: ``steps[s]`` lists (byte set, target), ``free[s]`` targets that cost no byte."""

    def __init__(self) -> None:
        self.steps: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.steps.append([])
        self.free.append([])
        return len(self.steps) - 1

    def add(self, pattern: str, any_case: bool = False) -> tuple[int, int]:
        """First and last state of a pattern."""
        self.pattern, self.at, self.any_case = pattern, 0, any_case
        first, last = self._choice()
        if self.at < len(pattern):
            raise ValueError(f"unexpected {pattern[self.at]!r} in {pattern!r}")
        return first, last

    def closure(self, states: Iterable[int]) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)

    def _choice(self) -> tuple[int, int]:
        first, last = self.state(), self.state()
        while True:
            a, b = self._sequence()
            self.free[first].append(a)
            self.free[b].append(last)
            if self.at == len(self.pattern) or self.pattern[self.at] != "|":
                return first, last
            self.at += 1

    def _sequence(self) -> tuple[int, int]:
        first = last = self.state()
        while self.at < len(self.pattern) and self.pattern[self.at] not in "|)":
            begin = self.at
            a, b = self._item()
            low, high = self._times()
            after = self.at
            self.free[last].append(a)
            optional = [a] if low == 0 else []
            for n in range(2, max(low, high or low) + 1):  # a copy for each further time
                self.at = begin
                c, d = self._item()
                self.free[b].append(c)
                if n > low:
                    optional.append(c)
                b = d
            self.at = after
            last = self.state()
            self.free[b].append(last)
            if high is None:
                self.free[b].append(c if low > 1 else a)
            for s in optional:
                self.free[s].append(last)
        return first, last

    def _times(self) -> tuple[int, int | None]:
        rest = self.pattern[self.at :]
        if rest[:1] in ("?", "*", "+"):
            self.at += 1
            return {"?": (0, 1), "*": (0, None), "+": (1, None)}[rest[0]]
        if rest[:1] == "{":
            inside = rest[1 : rest.index("}")]
            self.at += len(inside) + 2
            low, comma, high = inside.partition(",")
            return int(low), (int(high) if high else None) if comma else int(low)
        return 1, 1

    def _item(self) -> tuple[int, int]:
        c = self.pattern[self.at]
        if c == "(":
            self.at += 1
            pair = self._choice()
            self.at += 1
            return pair
        if c == "[":
            end = self.pattern.index("]", self.at + 2)
            inside, allowed = self.pattern[self.at + 1 : end], set()
            while inside:
                if len(inside) > 2 and inside[1] == "-":
                    allowed |= set(range(ord(inside[0]), ord(inside[2]) + 1))
                    inside = inside[3:]
                else:
                    allowed.add(ord(inside[0]))
                    inside = inside[1:]
            self.at = end + 1
        elif c == "\\" and self.pattern[self.at + 1] == "x":
            allowed = {int(self.pattern[self.at + 2 : self.at + 4], 16)}
            self.at += 4
        else:
            self.at += 1 + (c == "\\")
            allowed = {ord(self.pattern[self.at - 1])}
        if self.any_case:
            allowed |= {ord(s) for x in allowed for s in (chr(x).lower(), chr(x).upper()) if s.isascii()}
        a, b = self.state(), self.state()
        self.steps[a].append((frozenset(allowed), b))
        return a, b


@dataclass(frozen=True)
class Automaton:
    """``to[state, class_of[byte]]`` is the next state; ``accepts[state]`` has a bit for each rule; state 0 starts."""

    class_of: np.ndarray
    to: np.ndarray
    accepts: np.ndarray


def determinise(nfa: _Nfa, starts: Sequence[int], ends: Sequence[int], search: bool) -> Automaton:
    """Subset construction, then minimisation by refining classes of states.

    ``search``: a match may begin at every byte; the start state then stays a class of its own, so that being
    there means that no match is under way.  Otherwise matches begin at the first byte only.
    """
    sets = sorted({allowed for steps in nfa.steps for allowed, _ in steps}, key=sorted)
    member = np.array([[b in s for s in sets] for b in range(256)], dtype=bool).reshape(256, len(sets))
    _, sample, class_of = np.unique(member, axis=0, return_index=True, return_inverse=True)
    class_of = class_of.reshape(-1)

    start = nfa.closure(starts)
    known, order, rows = {start: 0}, [start], []
    for states in order:  # grows while it is read
        row = []
        for byte in sample:
            reached = {t for s in states for allowed, t in nfa.steps[s] if int(byte) in allowed}
            target = nfa.closure(reached | set(start) if search else reached)
            if target not in known:
                known[target] = len(order)
                order.append(target)
            row.append(known[target])
        rows.append(row)
    to = np.array(rows)
    accepts = np.array([sum(1 << i for i, e in enumerate(ends) if e in states) for states in order])

    block = np.unique(np.stack([accepts, np.arange(len(order)) == 0], 1), axis=0, return_inverse=True)[1].reshape(-1)
    while True:
        finer = np.unique(np.column_stack([block, block[to]]), axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    block = np.where(block == block[0], 0, np.where(block < block[0], block + 1, block))  # the start becomes 0
    first = np.unique(block, return_index=True)[1]
    return Automaton(class_of.astype(np.uint8), block[to[first]], accepts[first])


def compile_rules(rules: Sequence[Rule]) -> Automaton:
    """One automaton that flags, at each byte, the rules of which some match ends there."""
    nfa, starts, ends = _Nfa(), [], []
    for rule in rules:
        (a, b), (c, d) = nfa.add(rule.head, rule.any_case), nfa.add(rule.value, False)
        nfa.free[b].append(c)
        starts.append(a)
        ends.append(d)
    return determinise(nfa, starts, ends, search=True)


class _Anchored:
    """Longest match from a given byte."""

    def __init__(self, pattern: str, any_case: bool) -> None:
        nfa = _Nfa()
        a, b = nfa.add(pattern, any_case)
        dfa = determinise(nfa, [a], [b], search=False)
        dead = [s for s in range(len(dfa.to)) if not dfa.accepts[s] and (dfa.to[s] == s).all()]
        self.to = [[-1 if t in dead else t for t in row] for row in dfa.to[:, dfa.class_of].tolist()]
        self.accepts = dfa.accepts.tolist()

    def end(self, data: bytes, at: int, stop: int) -> int:
        """Byte after the match, or -1."""
        state, found = 0, at if self.accepts[0] else -1
        while at < stop:
            state = self.to[state][data[at]]
            if state < 0:
                break
            at += 1
            if self.accepts[state]:
                found = at
        return found


#: Bytes of text scanned at a time, and bytes of one lane.
SLICE, LANE = 1 << 22, 512


class Scanner:
    """Scans byte buffers with the combined automaton, many lanes of the buffer side by side."""

    def __init__(self, rules: Sequence[Rule]) -> None:
        self.rules, dfa = tuple(rules), compile_rules(rules)
        self.width, self.class_of, self.accepts = dfa.to.shape[1], dfa.class_of, dfa.accepts
        self.to = (dfa.to * self.width).astype(np.int32).reshape(-1)  # states times width: one add per byte
        self.parts = [(_Anchored(r.head, r.any_case), _Anchored(r.value, False)) for r in rules]

    def trace(self, data: np.ndarray) -> np.ndarray:
        """The state after each byte.  Lanes are first run from the start state; a lane whose predecessor ended
        in another is run again from there, as far as the states differ."""
        lanes = max(1, -(-len(data) // LANE))
        codes = np.zeros(lanes * LANE, np.int32)
        codes[: len(data)] = self.class_of[data]
        codes = np.ascontiguousarray(codes.reshape(lanes, LANE).T)
        states = np.empty((LANE, lanes), np.int32)
        state = np.zeros(lanes, np.int32)
        for j in range(LANE):
            np.take(self.to, state + codes[j], out=states[j])
            state = states[j]
        entered = np.zeros(lanes, np.int32)
        while len(again := np.flatnonzero(entered[1:] != states[-1, :-1]) + 1):
            state = entered[again] = states[-1, again - 1]
            for j in range(LANE):
                state = self.to[state + codes[j, again]]
                differ = state != states[j, again]
                if not differ.any():
                    break
                states[j, again] = state
        return states.T.reshape(-1)[: len(data)] // self.width

    def _spans(self, data: bytes, rule: int, at: int, stop: int) -> Iterator[tuple[int, int]]:
        head, value = self.parts[rule]
        while at < stop:
            begin = head.end(data, at, stop)
            end = value.end(data, begin, stop) if begin >= 0 else -1
            if end <= at:
                at += 1
                continue
            if end - begin >= self.rules[rule].least:
                yield at, end
            at = end

    def texts(self, texts: Sequence[str | None]) -> list[list[tuple[str, int, int]]]:
        """Per text its (kind, start, end) by start, then by rule; offsets in code points."""
        found: list[list[tuple[str, int, int]]] = []
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        at = 0
        while at < len(raw):
            part, size = [], 0
            while at < len(raw) and (not part or size + len(raw[at]) < SLICE):
                part.append(raw[at])
                size += len(raw[at]) + 1
                at += 1
            found += self._slice(part)
        return found

    def _slice(self, raw: list[bytes]) -> list[list[tuple[str, int, int]]]:
        found: list[list[tuple[str, int, int]]] = [[] for _ in raw]
        data = bytes([END]).join(raw) + bytes([END])
        states = self.trace(np.frombuffer(data, np.uint8))
        flags = self.accepts[states]
        hits = np.flatnonzero(flags)
        if not len(hits):
            return found
        begins = np.cumsum([0] + [len(x) + 1 for x in raw])
        done: dict[int, int] = {}
        idle = np.flatnonzero(states == 0)  # no match is under way after these bytes
        near = np.searchsorted(idle, hits)
        lows = np.where(near > 0, idle[np.maximum(near - 1, 0)] + 1, 0)
        highs = idle[np.minimum(near, len(idle) - 1)]
        owner = np.searchsorted(begins, hits, side="right") - 1
        for hit, low, high, doc in zip(hits.tolist(), lows.tolist(), highs.tolist(), owner.tolist()):
            for rule in range(len(self.rules)):
                if flags[hit] >> rule & 1 and done.get(rule, -1) < low:
                    done[rule] = low
                    found[doc] += [(rule, a, b) for a, b in self._spans(data, rule, low, high + 1)]
        for doc, spans in enumerate(found):
            if not spans:
                continue
            text = np.frombuffer(raw[doc], np.uint8)
            points = np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80)]) - 0  # code points before each byte
            base = begins[doc]
            found[doc] = [
                (self.rules[rule].kind, int(points[a - base]), int(points[b - base]))
                for a, rule, b in sorted((a, rule, b) for rule, a, b in spans)
            ]
        return found


def scan(df: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, out: str = "spans") -> DataFrame:
    """``df`` with an array of (kind, start, end) of the secrets in ``text``.

    ``start`` and ``end`` (exclusive) count code points; spans are ordered by start, then by the order of the
    rules.  NULL and empty texts have none.  Each rule's matches are leftmost, longest and don't overlap; those of
    different rules may.  The automaton is built once and sent with the tasks (its size depends on the rules
    alone); every byte is read once, in slices of bounded
    size, and only stretches that it flags are looked at again to find where a match begins.
    """

    scanner = Scanner(rules)

    @F.pandas_udf("array<struct<kind:string,start:int,end:int>>")
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(
                [[{"kind": k, "start": a, "end": b} for k, a, b in x] for x in scanner.texts(texts.tolist())], dtype=object
            )

    return without(df, out).withColumn(out, spans(F.col(text)))
