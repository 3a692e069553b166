"""The language-independent representation of a file, and the annotations that need a walk over its tree.

Front ends hand over a tree of `Node`s and a list of `Token`s; annotate() turns them into plain rows. It runs in linear
passes over the pre-order list, never by recursion: ladders of tens of thousands of arms must work. Levels and path counts
depend on unbounded ancestry, so they are annotations made here; everything else is counted by Spark.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass, field

NESTING = {"branch", "loop", "case", "catch"}
CODE_PUNCTUATION = set(",;()[]{}")


class ParseError(Exception):
    """A file that a front end can't read, with its place: line from 1, column in bytes from 0."""

    def __init__(self, line: int, column: int, message: str):
        super().__init__(message)
        self.line, self.column, self.message = line, column, message


@dataclass(slots=True)
class Token:
    kind: str
    text: str
    start: int
    end: int


@dataclass(slots=True)
class Param:
    name: str | None


@dataclass(slots=True)
class Node:
    kind: str
    start: int
    end: int
    children: list[Node] = field(default_factory=list)
    label: str | None = None
    # of functions only
    name: str | None = None
    params: list[Param] = field(default_factory=list)
    doc: tuple[int, int] | None = None  # offsets of a docstring
    doc_anchor: int | None = None  # where a preceding comment ends: the start of the topmost decorator


class Lines:
    """Line numbers (from 1) of byte offsets."""

    def __init__(self, source: bytes):
        self.starts = [0]
        at = source.find(b"\n")
        while at >= 0:
            self.starts.append(at + 1)
            at = source.find(b"\n", at + 1)

    def of(self, offset: int) -> int:
        return bisect.bisect_right(self.starts, offset)

    def column(self, offset: int) -> int:
        return offset - self.starts[self.of(offset) - 1]

    def last(self, start: int, end: int) -> int:
        """The last line of a range; one that ends at the front of a later line doesn't reach into it."""
        line = self.of(end)
        return line - 1 if end == self.starts[line - 1] and line > self.of(start) else line


def classify(text: str) -> str:
    """The kind of a token that is no identifier, literal or comment."""
    if any(c.isalpha() or c == "_" for c in text):
        return "keyword"
    return "punctuation" if text in CODE_PUNCTUATION else "operator"


def walk(root: Node) -> tuple[list[Node], list[int]]:
    """Nodes in pre-order, each one's parent's number (-1 for the root)."""
    nodes, parents, stack = [], [], [(root, -1)]
    while stack:
        node, parent = stack.pop()
        nodes.append(node)
        parents.append(parent)
        me = len(nodes) - 1
        stack.extend((c, me) for c in reversed(node.children))
    return nodes, parents


def path_counts(nodes: list[Node], parents: list[int]) -> list[float]:
    """Acyclic paths through each node, by one pass from the last node to the first.

    A sequence multiplies; runs of consecutive cases (or catches) are alternatives and add up, plus one for none of them;
    loops and conditionals add a way around; a branch adds its arms, plus one without a final else; a nested function is
    one step.
    """
    n = len(nodes)
    value = [1.0] * n
    arms = [0.0] * n  # of a branch: its chain's arms from here on
    closed = [False] * n  # of a branch: whether its chain ends in an else
    link = [-1] * n  # of an else: the branch that continues the chain in it
    product, run = [1.0] * n, [0.0] * n  # over a node's children from its last one: what is done, and the open run
    run_kind: list[str | None] = [None] * n
    for i in range(n - 1, -1, -1):  # all children of i come before it here
        kind = nodes[i].kind
        inside = product[i] * (run[i] + 1) if run_kind[i] else product[i]
        if kind == "branch":
            arms[i] += inside
            value[i] = arms[i] + (0 if closed[i] else 1)
        elif kind in ("loop", "conditional"):
            value[i] = inside + 1
        else:
            value[i] = inside
        p = parents[i]
        if p < 0:
            continue
        above = nodes[p].kind
        if above == "else" and kind == "branch":
            link[p] = i  # the first one, as children come from last to first
        if above == "branch" and kind in ("branch", "else"):
            on = i if kind == "branch" else link[i]
            arms[p] += arms[on] if on >= 0 else value[i]
            closed[p] = closed[p] or on < 0 or closed[on]
            continue
        alternative = kind if kind in ("case", "catch") else None
        if run_kind[p] and run_kind[p] != alternative:
            product[p], run[p], run_kind[p] = product[p] * (run[p] + 1), 0.0, None
        if alternative:
            run[p], run_kind[p] = run[p] + value[i], alternative
        elif kind != "function":
            product[p] *= value[i]
    return value


def annotate(root: Node, tokens: list[Token], source: bytes) -> dict:
    """Rows for the nodes, tokens and functions of a file (see schema.py)."""
    lines = Lines(source)
    nodes, parents = walk(root)
    n = len(nodes)
    end = list(range(1, n + 1))  # subtree_end: first number after the subtree
    for i in range(n - 1, 0, -1):
        end[parents[i]] = max(end[parents[i]], end[i])
    paths = path_counts(nodes, parents)
    level, cog, owner, around = [0] * n, [0] * n, [None] * n, [()] * n
    continues, previous, wraps = [False] * n, [None] * n, [False] * n
    last_child: dict[int, int] = {}
    fn_of: dict[int, int] = {}
    for i, node in enumerate(nodes):
        p = parents[i]
        if node.kind == "function":
            fn_of[i] = len(fn_of)
        if p < 0:
            continue
        parent = nodes[p]
        if p in last_child:
            previous[i] = nodes[last_child[p]].kind
        last_child[p] = i
        if parent.kind == "function":
            around[i], inner = (*around[p], fn_of[p]), fn_of[p]
            level[i] = cog[i] = 0
        else:
            around[i], inner = around[p], owner[p]
            level[i] = level[p] + (parent.kind in NESTING)
            cog[i] = cog[p] + (parent.kind in NESTING or parent.kind == "conditional")
        owner[i] = inner
        if node.kind == "branch" and parent.kind in ("else", "branch"):
            continues[i] = True
            head = parents[p] if parent.kind == "else" and parents[p] >= 0 else p
            level[i], cog[i] = level[head], cog[head]
            if parent.kind == "else":
                wraps[p] = True
    out_nodes = []
    for i, node in enumerate(nodes):
        p = parents[i]
        first = lines.of(node.start)
        out_nodes.append((i, p if p >= 0 else None, node.kind, node.label, first, lines.last(node.start, node.end), node.start, node.end, None if node.kind == "function" else owner[i], list(around[i]), level[i], cog[i], continues[i], nodes[p].kind if p >= 0 else None, nodes[p].label if p >= 0 else None, previous[i], wraps[i], end[i]))
    tokens = sorted(tokens, key=lambda t: t.start)
    fns = [(nodes[i].start, nodes[i].end, k) for i, k in fn_of.items()]
    out_tokens, open_fns, at = [], [], 0
    for pos, t in enumerate(tokens):
        while at < len(fns) and fns[at][0] <= t.start:
            open_fns.append(fns[at])
            at += 1
        open_fns = [f for f in open_fns if f[1] > t.start]
        out_tokens.append((pos, t.kind, t.text, lines.of(t.start), lines.last(t.start, t.end), t.start, t.end, [f[2] for f in open_fns if t.end <= f[1]]))
    comments = comment_blocks(tokens, lines)
    out_functions = []
    for i, k in fn_of.items():
        f = nodes[i]
        first, last = lines.of(f.start), lines.last(f.start, f.end)
        if f.doc:
            doc = lines.last(*f.doc) - lines.of(f.doc[0]) + 1
        else:
            anchor = lines.of(f.start if f.doc_anchor is None else f.doc_anchor)
            doc = comments(anchor, f.start if f.doc_anchor is None else f.doc_anchor)
        out_functions.append((k, f.name, [(p.name,) for p in f.params], i, first, last, f.start, f.end, doc, paths[i]))
    return {"nodes": out_nodes, "tokens": out_tokens, "functions": out_functions}


def comment_blocks(tokens: list[Token], lines: Lines):
    """A function that gives the lines of the comment block right above (or on) a line, before an offset; 0 if none."""
    starts = [t.start for t in tokens]

    def above(line: int, offset: int) -> int:
        i = bisect.bisect_left(starts, offset) - 1
        top, bottom, want = None, None, line
        while i >= 0 and tokens[i].kind == "comment":
            first, last = lines.of(tokens[i].start), lines.last(tokens[i].start, tokens[i].end)
            if last < want - 1:
                break
            if i and tokens[i - 1].kind != "comment" and lines.last(tokens[i - 1].start, tokens[i - 1].end) == first:
                break  # it trails code
            top, bottom, want = first, last if bottom is None else bottom, first
            i -= 1
        return bottom - top + 1 if top is not None else 0

    return above
