"""Python: structure from the standard library's syntax tree, tokens from its tokenizer.

What the syntax tree leaves out is recovered from the tokens: parentheses around expressions, elif against else-if, and
the shape of chained operators.
"""

from __future__ import annotations

import ast
import bisect
import io
import keyword
import tokenize

from .ir import Node, Param, ParseError, Token, classify

_SKIP = {tokenize.NL, tokenize.NEWLINE, tokenize.INDENT, tokenize.DEDENT, tokenize.ENDMARKER, tokenize.ENCODING}
_FSTRING = {tokenize.FSTRING_START, tokenize.FSTRING_MIDDLE, tokenize.FSTRING_END}
#: Statements that are one node with their expressions below.
_STATEMENTS = {ast.Expr: "statement", ast.Pass: "statement", ast.Assert: "statement", ast.Delete: "statement", ast.Global: "statement", ast.Nonlocal: "statement", ast.Return: "return", ast.Break: "jump", ast.Continue: "jump", ast.Raise: "jump", ast.Import: "import", ast.ImportFrom: "import"}
_EXPRESSIONS = {ast.Attribute: "expression", ast.Subscript: "expression", ast.BinOp: "binary", ast.Compare: "binary", ast.UnaryOp: "unary", ast.IfExp: "conditional", ast.Name: "identifier"}


#: Syntax nodes that stand for a sign or a use, not for a piece of the source.
_SIGNS = frozenset(x for base in (ast.expr_context, ast.operator, ast.unaryop, ast.cmpop, ast.boolop) for x in (base, *base.__subclasses__()))
_STRINGS = (str, bytes)


def _below(n) -> list:
    """The syntax nodes right below one, in order."""
    out = []
    for name in n._fields:
        x = getattr(n, name, None)
        if isinstance(x, list):
            out += [y for y in x if isinstance(y, ast.AST) and type(y) not in _SIGNS]
        elif isinstance(x, ast.AST) and type(x) not in _SIGNS:
            out.append(x)
    return out


def _every(tree) -> list:
    """All syntax nodes of a tree."""
    out, todo = [], [tree]
    while todo:
        n = todo.pop()
        out.append(n)
        todo += _below(n)
    return out


class _Reader:
    def __init__(self, text: str):
        self.lines = text.splitlines(keepends=True) if not any(c in text for c in "\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029") else io.StringIO(text, newline="").readlines()
        self.starts = [0]
        for line in self.lines:
            self.starts.append(self.starts[-1] + len(line.encode()))
        self.ascii = [line.isascii() for line in self.lines]
        self.soft: set[int] = set()  # offsets of match, case and type where they are keywords
        self.structural: set[int] = set()  # offsets of parentheses that belong to a call, tuple, signature ...

    def byte(self, row: int, col: int) -> int:
        """The offset of a place that counts characters."""
        if row > len(self.lines):
            return self.starts[-1]
        return self.starts[row - 1] + (col if self.ascii[row - 1] else len(self.lines[row - 1][:col].encode()))

    def tokenize(self, text: str) -> None:
        self.tokens: list[Token] = []
        pending: list[int] | None = None  # an f-string's text stretch: start, end
        try:
            for t in tokenize.generate_tokens(io.StringIO(text, newline="").readline):
                if t.type in _SKIP:
                    continue
                start, end = self.byte(*t.start), self.byte(*t.end)
                if t.type in _FSTRING:
                    if pending and start <= pending[1] + 1 and t.type != tokenize.FSTRING_START:
                        pending[1] = max(end, pending[1])
                    else:
                        self._stretch(pending)
                        pending = [start, end]
                    continue
                self._stretch(pending)
                pending = None
                if t.type == tokenize.COMMENT:
                    kind = "comment"
                elif t.type in (tokenize.NUMBER, tokenize.STRING):
                    kind = "literal"
                elif t.type == tokenize.NAME:
                    kind = "literal" if t.string in ("True", "False", "None") else "keyword" if keyword.iskeyword(t.string) else "identifier"
                else:
                    kind = classify(t.string)
                self.tokens.append(Token(kind, t.string, start, end))
            self._stretch(pending)
        except tokenize.TokenError as e:
            raise ParseError(e.args[1][0], 0, "unexpected syntax") from None
        self.at = {t.start: i for i, t in enumerate(self.tokens)}
        self.ends = {t.end: i for i, t in enumerate(self.tokens)}
        self.match: dict[int, int] = {}
        stack = []
        for i, t in enumerate(self.tokens):
            if t.kind == "punctuation" and t.text in "([{":
                stack.append(i)
            elif t.kind == "punctuation" and t.text in ")]}" and stack:
                j = stack.pop()
                self.match[i], self.match[j] = j, i

    def _stretch(self, pending):
        if pending and pending[1] > pending[0]:
            self.tokens.append(Token("literal", None, *pending))

    # -- places

    def span(self, node) -> tuple[int, int]:
        return self.starts[node.lineno - 1] + node.col_offset, self.starts[node.end_lineno - 1] + node.end_col_offset

    def next(self, offset: int) -> int:
        """The first token at or after an offset."""
        return bisect.bisect_left(self.order, offset)

    def own_parens(self, nodes: list) -> None:
        """Notes which parentheses aren't around an expression."""
        self.order = [t.start for t in self.tokens]
        for n in nodes:
            if type(n) in (ast.Name, ast.Constant, ast.Attribute):
                continue
            if isinstance(n, ast.Call):
                i = self.ends.get(self.span(n)[1])
                if i in self.match:
                    self.structural.add(self.match[i])
            elif isinstance(n, (ast.Tuple, ast.GeneratorExp)):
                i = self.at.get(self.span(n)[0])
                if i is not None and i in self.match and self.tokens[i].text == "(" and self.tokens[self.match[i]].end == self.span(n)[1]:
                    self.structural.add(i)
            elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                i = self.next(self.span(n)[0])
                while self.tokens[i].text not in ("(", ":"):
                    i = self.match[i] + 1 if self.tokens[i].text == "[" else i + 1
                if self.tokens[i].text == "(":
                    self.structural.add(i)
            elif isinstance(n, ast.ImportFrom):
                self.structural.update(i for i in range(self.next(self.span(n)[0]), self.next(self.span(n)[1])) if self.tokens[i].text == "(")
            elif isinstance(n, (ast.With, ast.AsyncWith)):
                i = self.next(self.span(n)[0]) + (2 if isinstance(n, ast.AsyncWith) else 1)
                if self.tokens[i].text == "(" and self.tokens[self.match.get(i, i)].end < len(self.source) and (len(n.items) > 1 or n.items[0].optional_vars is not None) and self.match[i] > self.next(self.span(n.items[-1].context_expr)[1]) - 1:
                    self.structural.add(i)
            elif isinstance(n, ast.Match):
                self.soft.add(self.span(n)[0])
                for c in n.cases:
                    i = self.next(self.span(c.pattern)[0]) - 1
                    while i > 0 and self.tokens[i].text != "case":
                        i -= 1
                    self.soft.add(self.tokens[i].start)
            elif hasattr(ast, "TypeAlias") and isinstance(n, ast.TypeAlias):
                self.soft.add(self.span(n)[0])

    # -- nodes

    def node(self, kind: str, n, children=(), **more) -> Node:
        a, b = n if isinstance(n, tuple) else self.span(n)
        return Node(kind, a, b, [c for c in children if c], **more)

    def wrapped(self, inner: Node, n) -> Node:
        """The expression within the parentheses that are written around it."""
        a, b = self.span(n)
        i, j = self.at.get(a), self.ends.get(b)
        if i is None or j is None:
            return inner
        while i > 0 and j + 1 < len(self.tokens) and self.match.get(i - 1) == j + 1 and self.tokens[i - 1].text == "(" and i - 1 not in self.structural:
            i, j = i - 1, j + 1
            inner = Node("expression", self.tokens[i].start, self.tokens[j].end, [inner])
        return inner

    def callee(self, n: ast.Call) -> str | None:
        """The last identifier in what is called."""
        close = self.ends.get(self.span(n)[1])
        i = (self.match.get(close, close) if close is not None else 0) - 1
        first = self.at.get(self.span(n)[0], 0)
        while i >= first:
            if self.tokens[i].kind == "identifier":
                return self.tokens[i].text
            i -= 1
        return None

    def run(self, tree) -> Node:
        """The tree of nodes, built without recursion: expressions can nest as deep as the parser allows."""
        top: list[Node] = []
        todo: list = [(tree, top, None)]
        while todo:
            n, into, _ = todo.pop()
            if isinstance(n, Node):
                into.append(n)
                continue
            if n is None:
                continue
            made, below = self.make(n)
            outer = self.wrapped(made, n) if isinstance(n, ast.expr) else made
            into.append(outer)
            for kids, target in reversed(below):
                todo.extend((k, target, None) for k in reversed(kids))
        return top[0]

    def make(self, n) -> tuple[Node, list]:
        """(the node, [(syntax nodes below, list that takes their nodes)])."""
        kind = type(n)
        if kind is ast.Name:
            return Node("identifier", *self.span(n)), []
        if kind is _Ready:
            return n.node, [(n.kids, n.node.children)]
        if kind is ast.Constant:
            return self.node("other" if n.value is Ellipsis else "literal", n), []
        if kind is ast.Attribute:
            node = Node("expression", *self.span(n))
            return node, [([n.value], node.children)]
        if isinstance(n, ast.Module):
            node = Node("other", 0, len(self.source))
            return node, [(n.body, node.children)]
        if kind in _STATEMENTS:
            node = self.node(_STATEMENTS[kind], n)
            return node, [(list(ast.iter_child_nodes(n)), node.children)]
        if isinstance(n, (ast.Assign, ast.AugAssign, ast.AnnAssign)):
            node = self.node("statement", n)
            inner = node
            below = []
            for t in n.targets if isinstance(n, ast.Assign) else [n.target]:
                a = Node("assignment", self.span(t)[0], self.span(n)[1])
                inner.children.append(a)
                below.append(([t], a.children))
                inner = a
            rest = [x for x in (getattr(n, "annotation", None), n.value) if x is not None]
            # an outer target's nodes must come before the assignment inside it
            order = [(kids, target) for kids, target in below]
            return node, self._chain(order, rest, inner)
        if isinstance(n, ast.If):
            node = self.node("branch", n)
            kids: list = [n.test, self.block(n.body)]
            rest = n.orelse
            end = self.span(n)[1]
            while len(rest) == 1 and isinstance(rest[0], ast.If) and self.tokens[self.at[self.span(rest[0])[0]]].text == "elif":
                e = rest[0]
                stop = self.span(e.body[-1])[1]
                arm = Node("branch", self.span(e)[0], stop)
                kids.append(_Ready(arm, [e.test, self.block(e.body)]))
                rest = e.orelse
            if rest:
                kids.append(self.otherwise(rest))
            node.end = end
            return node, [(kids, node.children)]
        if isinstance(n, (ast.For, ast.AsyncFor, ast.While)):
            node = self.node("loop", n)
            kids = [n.test] if isinstance(n, ast.While) else [n.target, n.iter]
            kids.append(self.block(n.body))
            if n.orelse:
                kids.append(self.otherwise(n.orelse))
            return node, [(kids, node.children)]
        if isinstance(n, (ast.Try, ast.TryStar)):
            node = self.node("other", n)
            kids = [self.block(n.body), *n.handlers]
            if n.orelse:
                kids.append(self.otherwise(n.orelse))
            if n.finalbody:
                kids.append(self.otherwise(n.finalbody, "other", "finally"))
            return node, [(kids, node.children)]
        if isinstance(n, ast.ExceptHandler):
            node = self.node("catch", n)
            return node, [([*([n.type] if n.type else []), self.block(n.body)], node.children)]
        if isinstance(n, (ast.With, ast.AsyncWith)):
            node = self.node("statement", n)
            return node, [([x for i in n.items for x in (i.context_expr, i.optional_vars) if x is not None] + [self.block(n.body)], node.children)]
        if isinstance(n, ast.Match):
            node = self.node("other", n)
            body = self.block(n.cases, (self.span(n.cases[0].pattern)[0], self.span(n)[1]), kind="block")
            return node, [([n.subject, body], node.children)]
        if isinstance(n, ast.match_case):
            i = self.next(self.span(n.pattern)[0]) - 1
            while i > 0 and self.tokens[i].text != "case":
                i -= 1
            node = Node("case", self.tokens[i].start, self.span(n.body[-1])[1])
            kids = []
            if n.guard is not None:
                kids.append(_Ready(Node("branch", *self.span(n.guard)), [n.guard]))
            return node, [([*kids, self.block(n.body)], node.children)]
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            node = self.function(n, n.name)
            kids = [*self.defaults(n.args), *([n.returns] if n.returns else []), self.block(n.body)]
            if not n.decorator_list:
                return node, [(kids, node.children)]
            outer = Node("other", self.tokens[self.next(self.span(n.decorator_list[0])[0]) - 1].start, node.end)
            node.doc_anchor = outer.start
            return outer, [([*n.decorator_list, _Ready(node, kids)], outer.children)]
        if isinstance(n, ast.ClassDef):
            node = self.node("other", n)
            return node, [([*n.decorator_list, *n.bases, *[k.value for k in n.keywords], self.block(n.body)], node.children)]
        if isinstance(n, ast.Lambda):
            node = self.function(n, None)
            return node, [([*self.defaults(n.args), n.body], node.children)]
        if isinstance(n, ast.Call):
            node = self.node("call", n, label=self.callee(n))
            inner = Node("other", *self.span(n))
            args = sorted([*n.args, *[k.value for k in n.keywords]], key=lambda x: self.span(x))
            return node, [([n.func, _Ready(inner, args)], node.children)]
        if isinstance(n, ast.BoolOp):
            op = "and" if isinstance(n.op, ast.And) else "or"
            inner: object = n.values[0]
            for v in n.values[1:-1]:
                inner = _Ready(Node("logical", self.span(n)[0], self.span(v)[1], label=op), [inner, v])
            node = self.node("logical", n, label=op)
            return node, [([inner, n.values[-1]], node.children)]
        if isinstance(n, (ast.ListComp, ast.SetComp, ast.GeneratorExp, ast.DictComp)):
            node = self.node("other", n)
            kids = [n.key, n.value] if isinstance(n, ast.DictComp) else [n.elt]
            for g in n.generators:
                kids.append(_Ready(Node("loop", self.span(g.target)[0], self.span(g.iter)[1]), [g.target, g.iter]))
                kids += [_Ready(Node("branch", *self.span(c)), [c]) for c in g.ifs]
            return node, [(kids, node.children)]
        if isinstance(n, ast.JoinedStr):
            node = self.node("literal", n)
            return node, [([v for v in n.values if not isinstance(v, ast.Constant)], node.children)]
        if isinstance(n, ast.expr_context | ast.operator | ast.unaryop | ast.cmpop | ast.boolop):
            return Node("other", 0, 0), []
        place = self.span(n) if hasattr(n, "lineno") else (0, 0)
        node = Node(_EXPRESSIONS.get(kind, "other"), *place)
        return node, [([c for c in _below(n) if type(c) is not ast.alias], node.children)]

    def _chain(self, order, rest, inner):
        below = []
        for kids, target in order:
            below.append((kids, _Front(target)))
        below.append((rest, inner.children))
        return below

    def block(self, body, place=None, kind="block") -> _Ready:
        a, b = place or (self.span(body[0])[0], self.span(body[-1])[1])
        return _Ready(Node(kind, a, b), body)

    def otherwise(self, body, kind="else", word="else") -> _Ready:
        i = self.next(self.span(body[0])[0]) - 1
        while i > 0 and self.tokens[i].text != word:
            i -= 1
        return _Ready(Node(kind, self.tokens[i].start, self.span(body[-1])[1]), [self.block(body)])

    def defaults(self, args: ast.arguments) -> list:
        out = [a.annotation for a in (*args.posonlyargs, *args.args, args.vararg, *args.kwonlyargs, args.kwarg) if a is not None and a.annotation is not None]
        return sorted([*out, *args.defaults, *[d for d in args.kw_defaults if d is not None]], key=lambda x: self.span(x))

    def function(self, n, name: str | None) -> Node:
        a = n.args
        every = [x for x in (*a.posonlyargs, *a.args, a.vararg, *a.kwonlyargs, a.kwarg) if x is not None]
        node = self.node("function", n, name=name, params=[Param(x.arg) for x in every])
        if name is not None and isinstance(n.body[0], ast.Expr):
            d = n.body[0].value
            if isinstance(d, ast.JoinedStr) or (isinstance(d, ast.Constant) and isinstance(d.value, str)):
                i = self.at.get(self.span(d)[0])
                if i is not None and self.span(d) == self.span(n.body[0]) and not self.concatenated(*self.span(d)):
                    node.doc = self.span(d)
        return node

    def concatenated(self, a: int, b: int) -> bool:
        return any(a == s and b == e for s, e in self.joined)


class _Front:
    """Takes nodes in front of what a list already holds (the assignment inside an assignment)."""

    def __init__(self, target: list):
        self.target = target

    def append(self, x) -> None:
        self.target.insert(0, x)


class _Ready:
    """A node that is made already, with syntax nodes below it."""

    def __init__(self, node: Node, kids: list):
        self.node, self.kids = node, kids


def parse(source: bytes) -> tuple[Node, list[Token]]:
    try:
        text = source.decode()
    except UnicodeDecodeError as e:
        raise ParseError(1, 0, "not UTF-8") from e
    if text.startswith("\ufeff"):
        text = text[1:]
        source = source[3:]
    try:
        tree = ast.parse(text)
    except SyntaxError as e:
        line = e.lineno or 1
        rows = text.split("\n")
        column = len(rows[line - 1][: max(0, (e.offset or 1) - 1)].encode()) if line <= len(rows) else 0
        raise ParseError(line, column, "unexpected syntax") from None
    except (ValueError, RecursionError, MemoryError):
        raise ParseError(1, 0, "unexpected syntax") from None
    r = _Reader(text)
    r.source = source
    r.tokenize(text)
    nodes = _every(tree)
    r.own_parens(nodes)
    # neighbouring strings are one literal
    r.joined = {r.span(n) for n in nodes if (type(n) is ast.JoinedStr or (type(n) is ast.Constant and isinstance(n.value, _STRINGS))) and _several(r, n)}
    root = r.run(tree)
    tokens: list[Token] = []
    for t in r.tokens:
        if t.text is None:
            t.text = source[t.start : t.end].decode()
        if t.start in r.soft:
            t.kind = "keyword"
        last = tokens[-1] if tokens else None
        if t.kind == "literal" and last and last.kind == "literal" and t.text[-1:] in "'\"" and any(a <= last.start and t.end <= b for a, b in r.joined if a <= t.start < b):
            last.end, last.text = t.end, source[last.start : t.end].decode()
            continue
        tokens.append(t)
    return root, tokens


def _several(r: _Reader, n) -> bool:
    """Whether a string is written as several strings side by side."""
    a, b = r.span(n)
    i, j = r.at.get(a), r.ends.get(b)
    if i is None or j is None or i == j:
        return False
    return all(r.tokens[k].kind in ("literal", "comment") for k in range(i, j + 1)) and sum(r.tokens[k].kind == "literal" for k in range(i, j + 1)) > 1
