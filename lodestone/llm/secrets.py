"""Secret scans by one combined deterministic automaton.

The rules' regular expressions become one nondeterministic automaton, then by subset
construction and minimisation a transition table over bytes. One pass over a text
follows a single state and notes where any rule can end; a small reversed automaton
per rule then finds the leftmost start of each longest end, and spans of a rule never
overlap.

Defined cases: a null or empty text has no spans; positions count code points, ends are
exclusive; repeated rows are scanned each; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import as_bytes, map_columns, table


@dataclass(frozen=True)
class Rule:
    """A rule of the scanner.

    ``scan`` is compiled into the automaton. ``exact``, if given, is matched against each
    span found; the span stays if ``group`` has ``least`` characters or more. Spans that
    fail still use up their text, as matches of an ordinary search do. A lower bound in
    ``scan`` itself saves work where a span that fails it cannot hide another one, but
    a bounded repeat whose class holds the rule's own beginning multiplies states.
    """

    kind: str
    scan: str
    exact: str = ""
    group: int = 0
    least: int = 0
    base: bool = False


# The kinds of the base rules, their patterns and lengths, in this order.
BASE_RULES = (
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=\-]+""",
         r"""(?is)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", r"(?s).*", 0, 20, True),
    Rule("hex", r"[0-9a-f]{24,}", base=True),
)
# Public formats of further credentials.
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", r"(?s).*", 0, 40),
    Rule("google", r"AIza[A-Za-z0-9_\-]+", r"(?s).*", 0, 39),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9\-]+", r"(?s).*", 0, 15),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)


class _Parser:
    """Regular expressions over bytes: classes, groups, ``|``, ``* + ?`` and ``{m,n}``."""

    def __init__(self, pattern: str) -> None:
        self.text, self.at = pattern, 0

    def parse(self):
        tree = self.either()
        if self.at != len(self.text):
            raise ValueError(f"unexpected {self.text[self.at]!r} at {self.at} in {self.text!r}")
        return tree

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self) -> str:
        char = self.peek()
        if not char:
            raise ValueError(f"{self.text!r} ends too early")
        self.at += 1
        return char

    def either(self):
        arms = [self.row()]
        while self.peek() == "|":
            self.at += 1
            arms.append(self.row())
        return arms[0] if len(arms) == 1 else ("or", arms)

    def row(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeated())
        return ("row", parts)

    def repeated(self):
        tree = self.atom()
        while (char := self.peek()) and char in "*+?{":
            self.at += 1
            if char == "{":
                end = self.text.index("}", self.at)
                low, comma, high = self.text[self.at : end].partition(",")
                self.at = end + 1
                least, most = int(low), (int(high) if high else None) if comma else int(low)
            else:
                least, most = {"*": (0, None), "+": (1, None), "?": (0, 1)}[char]
            tree = ("times", tree, least, most)
        return tree

    def escaped(self) -> int:
        char = self.take()
        if char == "x":
            self.at += 2
            return int(self.text[self.at - 2 : self.at], 16)
        return ord({"n": "\n", "t": "\t", "r": "\r"}.get(char, char))

    def atom(self):
        char = self.take()
        if char == "(":
            tree = self.either()
            if self.take() != ")":
                raise ValueError(f"an open group in {self.text!r}")
            return tree
        if char == "[":
            return ("set", self.members())
        if char == ".":
            return ("set", frozenset(range(256)) - {10})
        return ("set", frozenset([self.escaped() if char == "\\" else ord(char)]))

    def members(self) -> frozenset[int]:
        turned = self.peek() == "^"
        self.at += turned
        found: set[int] = set()
        while (char := self.take()) != "]":
            low = self.escaped() if char == "\\" else ord(char)
            high = low
            if self.peek() == "-" and self.text[self.at + 1 : self.at + 2] != "]":
                self.at += 1
                char = self.take()
                high = self.escaped() if char == "\\" else ord(char)
            found.update(range(low, high + 1))
        return frozenset(range(256)) - found if turned else frozenset(found)


def _turned(tree):
    """The tree of the reversed language."""
    if tree[0] == "row":
        return ("row", [_turned(x) for x in reversed(tree[1])])
    if tree[0] == "or":
        return ("or", [_turned(x) for x in tree[1]])
    if tree[0] == "times":
        return ("times", _turned(tree[1]), *tree[2:])
    return tree


class _Nfa:
    def __init__(self) -> None:
        self.free: list[list[int]] = []
        self.moves: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.free.append([])
        self.moves.append(None)
        return len(self.free) - 1

    def add(self, tree, start: int) -> int:
        """Add a tree that begins at ``start``; gives its end."""
        if tree[0] == "set":
            end = self.state()
            edge = self.state()
            self.free[start].append(edge)
            self.moves[edge] = (tree[1], end)
            return end
        if tree[0] == "row":
            for part in tree[1]:
                start = self.add(part, start)
            return start
        if tree[0] == "or":
            end = self.state()
            for arm in tree[1]:
                self.free[self.add(arm, start)].append(end)
            return end
        _, inner, least, most = tree
        for _ in range(least):
            start = self.add(inner, start)
        if most is None:
            loop, end = self.state(), self.state()
            self.free[start] += [loop, end]
            self.free[self.add(inner, loop)] += [loop, end]
            return end
        end = self.state()
        for _ in range(most - least):
            self.free[start].append(end)
            start = self.add(inner, start)
        self.free[start].append(end)
        return end

    def reach(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for after in self.free[todo.pop()]:
                if after not in seen:
                    seen.add(after)
                    todo.append(after)
        return frozenset(seen)


def automaton(patterns: list, *, anywhere: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """Transitions (states x 256), accepted-rule masks and the start of the least automaton.

    ``patterns`` are parsed trees. With ``anywhere`` a match may begin at any byte.
    """
    nfa = _Nfa()
    start, ends = nfa.state(), {}
    for i, tree in enumerate(patterns):
        first = nfa.state()
        nfa.free[start].append(first)
        ends[nfa.add(tree, first)] = 1 << i
    sets = {move[0] for move in nfa.moves if move}
    kinds: dict[tuple, list[int]] = {}
    for byte in range(256):
        kinds.setdefault(tuple(byte in s for s in sets), []).append(byte)
    blocks = list(kinds.values())
    first = nfa.reach([start])
    number, todo, rows = {first: 0}, [first], []
    while todo:
        held = todo.pop(0)
        row = []
        for block in blocks:
            moved = {m[1] for s in held if (m := nfa.moves[s]) and block[0] in m[0]}
            after = nfa.reach(moved | {start} if anywhere else moved)
            if after not in number:
                number[after] = len(number)
                todo.append(after)
            row.append(number[after])
        rows.append(row)
    step = np.array(rows)
    accepts = np.array([sum(ends.get(s, 0) for s in held) for held in number])
    group = np.unique(accepts, return_inverse=True)[1]
    while True:  # states stay together while all their moves lead to the same groups
        finer = np.unique(np.column_stack([group, group[step]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == group.max():
            break
        group = finer
    keep = np.unique(group, return_index=True)[1]
    table_ = np.empty((len(keep), 256), np.int32)
    for i, block in enumerate(blocks):
        table_[:, block] = group[step[keep, i]][:, None]
    return table_, accepts[keep], int(group[0])


def _linked(step: np.ndarray, accepts: np.ndarray) -> list[list]:
    """A row per state: the rows that follow each byte, the mask, whether no move leads out."""
    rows: list[list] = [[] for _ in step]
    for i, row in enumerate(rows):
        row += [rows[j] for j in step[i].tolist()]
        row += [int(accepts[i]), bool((step[i] == i).all())]
    return rows


def compiled(rules: tuple[Rule, ...]) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """The combined automaton of all rules, then the reversed automaton of each."""
    trees = [_Parser(r.scan).parse() for r in rules]
    return [automaton(trees, anywhere=True), *(automaton([_turned(x)], anywhere=False) for x in trees)]


class Scanner:
    """Finds the spans of all rules in one pass over a text's bytes."""

    def __init__(self, rules: tuple[Rule, ...], tables: list[tuple[np.ndarray, np.ndarray, int]] | None = None) -> None:
        self.rules = rules
        linked = [_linked(step, accepts)[start] for step, accepts, start in tables or compiled(rules)]
        self.start, self.back = linked[0], linked[1:]
        self.exact = [re.compile(r.exact.encode()) if r.exact else None for r in rules]

    def scan(self, data: bytes) -> list[tuple[int, int, int]]:
        """Spans (rule, start, end) in bytes, by start and rule."""
        row, ends = self.start, []
        for at, byte in enumerate(data, 1):
            row = row[byte]
            if row[256]:
                ends.append((at, row[256]))
        return self._spans(data, ends) if ends else []

    def _spans(self, data: bytes, ends: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        found = []
        for i, rule in enumerate(self.rules):
            at = [p for p, mask in ends if mask >> i & 1]
            used = 0
            for p, after in zip(at, at[1:] + [-1][: len(at)], strict=True):
                if after == p + 1:  # a longer match ends there
                    continue
                row, first = self.back[i], -1
                for s in range(p - 1, used - 1, -1):
                    row = row[data[s]]
                    if row[256]:
                        first = s
                    elif row[257]:
                        break
                if first < 0:
                    continue
                used = p
                if self.exact[i]:
                    match = self.exact[i].fullmatch(data, first, p)
                    if not match or len(match[rule.group]) < rule.least:
                        continue
                found.append((i, first, p))
        return sorted(found, key=lambda x: (x[1], x[0]))


def secret_scan(df: DataFrame, key: str, text: str, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES) -> DataFrame:
    """One row per row of ``df``: ``key`` and ``spans``, an array of (kind, start, end)."""
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    tables = df.sparkSession.sparkContext.broadcast(compiled(rules))

    def make():
        scanner = Scanner(rules, tables.value)
        kinds = [r.kind for r in rules]

        def places(data: bytes) -> list[dict]:
            spans = scanner.scan(data)
            if not spans:
                return []
            if data.isascii():
                return [{"kind": kinds[i], "start": a, "end": b} for i, a, b in spans]
            place, last, chars = {}, 0, 0
            for p in sorted({p for s in spans for p in s[1:]}):
                chars += len(data[last:p].decode("utf-8", "replace"))
                place[p], last = chars, p
            return [{"kind": kinds[i], "start": place[a], "end": place[b]} for i, a, b in spans]

        return lambda texts: [pa.array([places(x) for x in as_bytes(texts)], arrow)]

    return map_columns(df, [F.col(key)], [F.col(text)], make, T.StructType([T.StructField("spans", T.ArrayType(span))])).withColumnRenamed("c0", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan(table(spark, sf_dir, "documents"), "doc_id", "text")
    base = [r.kind for r in BASE_RULES]
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        "doc_id",
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(shown(of(*base)), 256).alias("base_sha256"),
        shown(F.col("spans")).alias("spans"),
    )


def brute_force(text: str | None) -> tuple[int, int, int, str]:
    """n_assign, n_access, n_hex and base_sha256 by ordinary searches; for tests."""
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in re.finditer(BASE_RULES[0].exact.replace("(?is)", "(?ai)"), text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    spans.sort()
    digest = hashlib.sha256(",".join(f"{BASE_RULES[k].kind}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()
    return (*(sum(s[1] == k for s in spans) for k in range(3)), digest)
