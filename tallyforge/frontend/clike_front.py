"""C, C++, Go, Java, JavaScript, TypeScript and Rust: one recursive-descent parser with per-language branches.

It reads what the metrics need: functions, statements, expressions and their nesting. Types, generics and attributes are
skipped by balanced matching. Code that it can't read is a ParseError, never a partial result.
"""

from __future__ import annotations

import sys
import threading

from .ir import Node, Param, ParseError, Token
from .lexer import Lexeme, lex

_OPEN = {"(": ")", "[": "]", "{": "}"}
_ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", ">>>=", "**=", "&&=", "||=", "??=", "&^=", ":="}
#: Binding strengths of binary operators.
_BINARY = {"??": 1, "||": 1, "or": 1, "&&": 2, "and": 2, "|": 3, "^": 4, "&": 5, "==": 6, "!=": 6, "===": 6, "!==": 6, "<=>": 7, "<": 7, ">": 7, "<=": 7, ">=": 7, "instanceof": 7, "in": 7, "<<": 8, ">>": 8, ">>>": 8, "&^": 10, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10, "**": 11, "->*": 12, ".*": 12}
_PREFIX = {"!", "-", "+", "~", "++", "--", "*", "&", "&&", "<-", "typeof", "void", "delete", "not", "compl", "^"}
_C_TYPES = frozenset("char double float int long short signed unsigned void bool _Bool auto const volatile struct union enum static extern register inline typedef typename constexpr thread_local mutable virtual explicit friend consteval constinit restrict wchar_t size_t ssize_t int8_t int16_t int32_t int64_t uint8_t uint16_t uint32_t uint64_t decltype".split())
_JAVA_MODIFIERS = frozenset("public private protected static final abstract native synchronized transient volatile strictfp default sealed".split())
_TS_WORDS = frozenset("public private protected readonly abstract declare override static async get set accessor".split())


class Parser:
    def __init__(self, text: str, lang: str):
        self.text = text
        self.all, _ = lex(text, lang)
        self.lang = lang = "ts" if lang == "tsx" else lang
        self.directives = [t for t in self.all if t.inner and t.inner[0] in ("include",)]
        self.toks = [t for t in self.all if t.kind != "comment" and not (t.inner and isinstance(t.inner[0], str))]
        self.toks.append(Lexeme("end", "", len(text), len(text), True))
        self.i = 0
        self.pair: dict[int, int] = {}
        stack = []
        for k, t in enumerate(self.toks):
            if t.kind == "punctuation" and t.text in _OPEN or t.text == "${":
                stack.append(k)
            elif t.kind == "punctuation" and t.text in ")]}":
                if not stack or _OPEN.get(self.toks[stack[-1]].text, "}") != t.text:
                    self.fail(t)
                j = stack.pop()
                self.pair[j], self.pair[k] = k, j
        if stack:
            self.fail(self.toks[-1], _OPEN.get(self.toks[stack[-1]].text, "}"))
        self.c, self.js = lang in ("c", "cpp"), lang in ("js", "ts")
        self.no_struct = False

    # -- basics

    def fail(self, t: Lexeme, missing: str | None = None):
        line = self.text.count("\n", 0, t.start) + 1
        column = len(self.text[self.text.rfind("\n", 0, t.start) + 1 : t.start].encode())
        raise ParseError(line, column, f"missing `{missing}`" if missing else "unexpected syntax")

    @property
    def t(self) -> Lexeme:
        return self.toks[self.i]

    def peek(self, k: int = 1) -> Lexeme:
        return self.toks[min(self.i + k, len(self.toks) - 1)]

    def at(self, *texts: str) -> bool:
        t = self.toks[self.i]
        return t.text in texts and t.kind != "literal"

    def take(self) -> Lexeme:
        t = self.toks[self.i]
        if t.kind == "end":
            self.fail(t)
        self.i += 1
        return t

    def want(self, text: str) -> Lexeme:
        if not self.at(text):
            self.fail(self.t, text if self.t.kind == "end" else None)
        return self.take()

    def word(self, *texts: str) -> bool:
        """Takes a contextual keyword."""
        if self.t.text in texts and self.t.kind in ("identifier", "keyword"):
            self.t.kind = "keyword"
            self.i += 1
            return True
        return False

    def node(self, kind: str, first: int | Node, *children: Node | None, **more) -> Node:
        start = first.start if isinstance(first, Node) else self.toks[first].start
        return Node(kind, start, max(start, self.toks[self.i - 1].end), [c for c in children if c], **more)

    def close(self) -> None:
        """Skips to after the bracket that the current one opens."""
        self.i = self.pair[self.i] + 1

    def angles(self, i: int) -> int | None:
        """The place after a balanced <...> that starts at i, if it looks like type arguments."""
        depth, k = 0, i
        while k < len(self.toks) and k < i + 400:
            t = self.toks[k]
            if t.kind == "literal" and self.lang not in ("ts", "cpp", "rust"):
                return None
            if t.text == "<" and t.kind == "operator":
                depth += 1
            elif t.text in (">", ">>", ">>>") and t.kind == "operator":
                depth -= len(t.text)
                if depth <= 0:
                    return k + 1 if depth == 0 else None
            elif t.text in ("(", "[", "{"):
                if t.text == "{" and self.lang not in ("ts", "rust"):
                    return None
                k = self.pair[k]
            elif t.text in (";", ")", "]", "}", "&&", "||", "==", "!=", "+", "/", "%", "!") or t.kind == "end":
                return None
            k += 1
        return None

    # -- types, skipped

    def type_(self, stop: tuple[str, ...] = ()) -> None:
        """Skips a type (Go, Rust, TypeScript after a colon, Java, C++ new)."""
        if self.js:
            return self.ts_type(stop)
        if self.lang == "go":
            return self.go_type()
        if self.lang == "rust":
            return self.rust_type()
        while True:
            if self.t.kind in ("identifier", "keyword") or self.at("::", ".", "@") or (self.c and self.at("*", "&", "&&")):
                self.take()
            elif self.at("<") and (k := self.angles(self.i)):
                self.i = k
            elif self.at("[") and self.toks[self.pair[self.i]] is self.peek():
                self.close()
            else:
                return None

    def ts_type(self, stop=()) -> None:
        first = True
        while True:
            if self.at(*stop) if stop else False:
                return
            if self.at("|", "&") or (self.at("=>") and not first and "=>" not in stop):
                self.take()
                first = True
                continue
            if not first:
                if self.at("."):
                    self.take()
                    self.take()
                    continue
                if self.at("[") and not self.t.after_newline:
                    self.close()
                    continue
                if self.at("<") and (k := self.angles(self.i)):
                    self.i = k
                    continue
                if self.t.text in ("extends", "is") and self.t.kind in ("keyword", "identifier") and not self.t.after_newline:
                    self.word("extends", "is")
                    first = True
                    continue
                if self.at("?") and stop != ("?",):
                    self.take()
                    self.ts_type((":",))
                    self.want(":")
                    first = True
                    continue
                return
            if self.word("keyof", "typeof", "readonly", "unique", "infer", "asserts", "new", "abstract"):
                continue
            if self.at("<") and (k := self.angles(self.i)):
                self.i = k
                continue
            if self.at("(", "[", "{"):
                self.close()
            elif self.at("-"):
                self.take()
                self.take()
            elif self.t.kind in ("identifier", "keyword", "literal"):
                if self.t.kind == "literal" and self.t.inner:
                    end = self.t.inner[0]
                    while self.t.end < end:
                        self.take()
                self.take()
            else:
                self.fail(self.t)
            first = False

    def go_type(self) -> None:
        while self.at("*", "<-") or (self.at("[") and True):
            self.close() if self.at("[") else self.take()
        if self.word("chan"):
            if self.at("<-"):
                self.take()
            return self.go_type()
        if self.word("map"):
            self.close()
            return self.go_type()
        if self.word("func"):
            self.close()
            if not self.at("{", ",", ")", ";", "=", "]", ":="):
                self.go_result()
            return None
        if self.word("struct", "interface"):
            self.close()
            return None
        if self.at("("):
            self.close()
            return None
        if self.at("..."):
            self.take()
            return self.go_type()
        if self.t.kind != "identifier":
            self.fail(self.t)
        self.take()
        while self.at("."):
            self.take()
            self.take()
        if self.at("[") and not self.t.after_newline and self.toks[self.pair[self.i] + 1].text != ":":
            self.close()
        return None

    def go_result(self) -> None:
        if self.at("("):
            self.close()
        elif not self.at("{"):
            self.go_type()

    def rust_type(self) -> None:
        while True:
            if self.at("&", "&&", "*", "+", "!", "::", "->", "?"):
                self.take()
            elif self.word("dyn", "impl", "mut", "const", "fn", "for", "unsafe", "extern"):
                continue
            elif self.at("<"):
                k = self.rust_angles(self.i)
                self.i = k
            elif self.at("(", "["):
                self.close()
            elif self.t.kind in ("identifier", "keyword") and not self.at("where", "as", "in", "if", "else", "match"):
                self.take()
            elif self.t.kind == "literal" and self.toks[self.i - 1].text == "extern":
                self.take()
            else:
                return
            if not self.at("::", "<", "+", "->", "&") and self.toks[self.i - 1].kind in ("identifier", "keyword", "operator", "punctuation"):
                last = self.toks[self.i - 1]
                if last.text in ("&", "&&", "*", "+", "!", "::", "->", "?", "dyn", "impl", "mut", "const", "for", "unsafe", "extern") or last.text.startswith("'"):
                    continue
                if last.text == "fn" or (last.text == ")" and self.at("->")):
                    continue
                if last.text in (">", ">>") and self.toks[self.i - 1].start and self.at("(") is False and self.t.kind == "identifier" and self.toks[self.i - 2].text.startswith("'"):
                    continue
                if self.at("(") and last.text in ("Fn", "FnMut", "FnOnce"):
                    continue
                return

    def rust_angles(self, i: int) -> int:
        depth = 0
        while i < len(self.toks):
            s = self.toks[i].text
            if self.toks[i].kind == "operator":
                if s == "<":
                    depth += 1
                elif s == ">":
                    depth -= 1
                elif s == ">>":
                    depth -= 2
                elif s in (">=", ">>="):
                    break
                if depth <= 0 and s in (">", ">>"):
                    return i + 1
            if s in _OPEN:
                i = self.pair[i]
            i += 1
        self.fail(self.toks[min(i, len(self.toks) - 1)])

    # -- files

    def file(self) -> Node:
        root = Node("other", 0, len(self.text))
        while self.t.kind != "end":
            root.children += self.item("top")
        for t in self.directives:
            if t.kind == "keyword" or t.text[:1] in '<"':
                root.children.append(Node("import", t.start, t.end)) if t.kind == "literal" else None
        root.children.sort(key=lambda n: n.start)
        return root

    def block(self, kind: str = "block", scope: str = "body") -> Node:
        first = self.i
        self.want("{")
        kids: list[Node] = []
        while not self.at("}"):
            kids += self.item(scope)
        self.take()
        return self.node(kind, first, *kids)

    def item(self, scope: str) -> list[Node]:
        if self.at(";"):
            self.take()
            return []
        if self.js:
            return [self.js_statement()]
        if self.lang == "go":
            return self.go_item()
        if self.lang == "rust":
            return self.rust_item()
        if scope in ("top", "class"):
            return self.c_member(scope) if self.c else self.java_member()
        return [self.c_statement()]

    # -- functions

    def params(self) -> list[Param]:
        """The parameters in the parentheses (or bars) at hand; leaves the place after them."""
        end = self.pair[self.i]
        self.take()
        out: list[Param] = []
        parts: list[list[Lexeme]] = [[]]
        k = self.i
        while k < end:
            t = self.toks[k]
            if t.text == "," and t.kind == "punctuation":
                parts.append([])
            else:
                parts[-1].append(t)
                if t.text in _OPEN and t.kind == "punctuation":
                    parts[-1] += self.toks[k + 1 : self.pair[k] + 1]
                    k = self.pair[k]
                elif t.text == "<" and t.kind == "operator" and (j := self.angles(k)):
                    parts[-1] += self.toks[k + 1 : j]
                    k = j - 1
            k += 1
        parts = [p for p in parts if p]
        self.i = end + 1
        if self.lang == "go":
            return self.go_params(parts)
        for p in parts:
            texts = [t.text for t in p]
            if texts == ["void"]:
                continue
            out.append(Param(self.param_name(p, texts)))
        return out

    def go_params(self, parts) -> list[Param]:
        named = any(len(p) > 1 and p[0].kind == "identifier" and p[1].text not in (".", "[") or (len(p) > 2 and p[0].kind == "identifier" and p[1].text == "[") for p in parts)
        return [Param(p[0].text if named else None) for p in parts]

    def param_name(self, p: list[Lexeme], texts: list[str]) -> str | None:
        if self.js:
            while p and (p[0].text in ("...", "public", "private", "protected", "readonly", "override") or p[0].text == "@") and len(p) > 1:
                p = p[2:] if p[0].text == "@" else p[1:]
            return p[0].text if p and p[0].kind == "identifier" else "this" if p and p[0].text == "this" else None
        if self.lang == "rust":
            if "self" in texts:
                return None if ":" not in texts else "self"
            p = [t for t in p if t.text not in ("mut", "ref", "&")]
            return p[0].text if p and p[0].kind == "identifier" else None
        depth, name = 0, None
        for k, t in enumerate(p):
            if t.text == "=" and not depth:
                break
            if t.text in ("[", "{"):
                depth += 1
            elif t.text in ("]", "}"):
                depth -= 1
            elif t.text == "(" and name and not (k + 1 < len(p) and p[k + 1].text in ("*", "&", "^")):
                break
            elif not depth and t.kind == "identifier":
                name = t.text
                if k and p[k - 1].text in ("*",) and k + 1 < len(p) and p[k + 1].text == ")":
                    break
        known = [t for t in p if t.kind in ("identifier", "keyword")]
        if len(known) == 1 and known[0].text == name and self.lang != "java":
            return None  # a type alone
        return name

    def body_function(self, first: int, name: str | None, params: list[Param], *before: Node) -> Node:
        body = self.block()
        return self.node("function", first, *before, body, name=name, params=params)

    # -- C, C++, Java members

    def c_member(self, scope: str) -> list[Node]:
        first = self.i
        if self.at("#"):
            self.fail(self.t)
        if self.lang == "cpp":
            if self.at("public", "private", "protected") and self.peek().text == ":":
                self.take()
                self.take()
                return []
            while self.word("template"):
                if self.at("<"):
                    self.i = self.angles(self.i) or self.fail(self.t)
                if self.word("requires"):
                    while not (self.t.kind in ("identifier", "keyword") and self.toks[self.i - 1].text in (")", ">")):
                        self.close() if self.at("(") else self.take()
            if self.at("namespace") or (self.at("inline") and self.peek().text == "namespace"):
                while not self.at("{", ";", "="):
                    self.take()
                if self.at("{"):
                    return [self.block("other", "top")]
                return self.skip_to_semicolon()
            if self.at("using", "friend", "static_assert", "concept"):
                if not (self.at("friend") and self.function_ahead()):
                    return self.skip_to_semicolon()
        if self.at("extern") and self.peek().kind == "literal":
            self.take()
            self.take()
            if self.at("{"):
                return [self.block("other", "top")]
        while self.at("[") and self.peek().text == "[":
            self.close()
        head = self.function_ahead()
        if head is not None:
            return [self.c_function(first, head)]
        if scope == "class":
            return self.c_field()
        return [self.c_declaration()]

    def skip_to_semicolon(self) -> list[Node]:
        while not self.at(";"):
            if self.t.text in _OPEN and self.t.kind == "punctuation":
                self.close()
            else:
                self.take()
        self.take()
        return []

    def function_ahead(self) -> int | None:
        """The parenthesis of the parameters, if a function definition starts here."""
        k, paren, after = self.i, None, False
        while k < len(self.toks):
            t = self.toks[k]
            s = t.text
            if t.kind == "literal":
                return None
            if s == "(":
                name = self.toks[k - 1]
                close = self.pair[k]
                if (name.kind == "identifier" or name.text in (">", "operator") or self.toks[k - 2].text == "operator" or self.toks[k - 3].text == "operator") and not after:
                    if name.text not in ("__attribute__", "__declspec", "alignas", "decltype"):
                        if not (self.toks[close + 1].text == "(" and name.text == "operator"):
                            paren, after = k, True
                k = close + 1
                continue
            if s in ("class", "struct", "union", "enum") and not after and any(self.toks[j].text in ("{", ";") for j in (k + 1, k + 2)):
                if self.toks[k + 1].text == "{" or self.toks[k + 2].text == "{" or self.toks[k + 2].text == ";":
                    return None
            if s == "{":
                return paren if after else None
            if s == ":" and after and self.lang == "cpp":  # a constructor's initialisers
                k += 1
                while self.toks[k].text not in ("{",) or self.toks[k - 1].kind == "identifier" or self.toks[k - 1].text == ">":
                    if self.toks[k].text in _OPEN:
                        k = self.pair[k]
                    elif self.toks[k].kind == "end":
                        return None
                    k += 1
                return paren
            if s in (";", "=", "}") or (s == "," and not after) or t.kind == "end" or s == ":":
                return None
            if s == "<" and not after:
                j = self.angles(k)
                if j:
                    k = j
                    continue
            if s == "[":
                k = self.pair[k]
            k += 1
        return None

    def c_function(self, first: int, paren: int) -> Node:
        k = paren - 1
        name = self.toks[k].text if self.toks[k].kind == "identifier" else None
        for j in range(1, 5):
            if self.toks[paren - j].text == "operator":
                name = "operator" + "".join(t.text for t in self.toks[paren - j + 1 : paren])
        if name and self.toks[k - 1].text == "~":
            name = "~" + name
        self.i = paren
        params = self.params()
        while not self.at("{"):
            if self.at(":") :
                self.take()
                while True:
                    while not self.at("(", "{"):
                        self.i = self.angles(self.i) or self.i + 1 if self.at("<") else self.i + 1
                    self.close()
                    if self.at("..."):
                        self.take()
                    if not self.at(","):
                        break
                    self.take()
                break
            if self.at("("):
                self.close()
            elif self.at("try"):
                self.take()
            else:
                self.take()
        node = self.body_function(first, name, params)
        return node

    def c_field(self) -> list[Node]:
        return self.record_or(lambda: self.skip_field())

    def skip_field(self) -> list[Node]:
        kids: list[Node] = []
        while not self.at(";"):
            if self.at("=") or (self.at("{") and self.toks[self.i - 1].kind == "identifier"):
                if self.at("="):
                    self.take()
                if self.at("delete", "default"):
                    self.take()
                    continue
                kids.append(self.initialiser())
            elif self.t.text in _OPEN and self.t.kind == "punctuation":
                self.close()
            else:
                self.take()
        self.take()
        return kids

    def record_or(self, other) -> list[Node]:
        """A class, struct, union or enum with its members, or else what other() reads."""
        k = self.i
        while self.toks[k].text in ("typedef", "static", "const", "constexpr", "inline", "extern"):
            k += 1
        if self.toks[k].text in ("class", "struct", "union", "enum"):
            j = k + 1
            while self.toks[j].text not in ("{", ";", "=", "(", ")", "*", "&") and self.toks[j].kind != "end":
                if self.toks[j].text == "<":
                    j = (self.angles(j) or j + 1) - 1
                elif self.toks[j].text == "[":
                    j = self.pair[j]
                j += 1
            if self.toks[j].text == "{":
                kind, first = self.toks[k].text, self.i
                self.i = j
                if kind == "enum":
                    self.close()
                    made = self.node("other", first)
                else:
                    made = self.block("other", "class")
                while not self.at(";"):
                    if self.at("="):
                        self.take()
                        made.children.append(self.initialiser())
                    elif self.t.text in _OPEN and self.t.kind == "punctuation":
                        self.close()
                    else:
                        self.take()
                self.take()
                return [made]
        return other()

    def c_declaration(self) -> Node:
        """A declaration, with its declarators' initialisers."""
        first = self.i
        made = self.record_or(lambda: [])
        if made:
            if self.toks[first].text == "typedef" or self.toks[self.i - 2].text == "}":
                return made[0]
            return self.node("declaration", first, *made)
        typedef = self.at("typedef")
        kids: list[Node] = []
        while not self.at(";"):
            if self.at("="):
                self.take()
                kids.append(self.initialiser())
            elif self.at("{"):
                kids.append(self.initialiser())
            elif self.at("(") and self.toks[self.i - 1].kind == "identifier" and not self.parameters_at(self.i):
                self.take()
                kids += self.arguments(")")
            elif self.at("[") and not (self.peek().text == "]"):
                self.take()
                if self.at("["):
                    self.i -= 1
                    self.close()
                else:
                    kids.append(self.expression())
                    self.want("]")
            elif self.t.text in _OPEN and self.t.kind == "punctuation":
                self.close()
            elif self.at("<") and (k := self.angles(self.i)):
                self.i = k
            elif self.t.kind in ("identifier", "keyword") or self.at("*", "&", "&&", "::", ",", "...", ":", "~"):
                if self.at(":"):
                    self.take()
                    kids.append(self.expression(1))
                else:
                    self.take()
            elif self.t.kind == "literal" and self.toks[self.i - 1].text in ("extern", "asm"):
                self.take()
            else:
                self.fail(self.t)
        self.take()
        return self.node("other" if typedef else "declaration", first, *kids)

    def parameters_at(self, k: int) -> bool:
        """Whether the parentheses at k hold parameters (a prototype) and not a constructor's arguments."""
        if self.lang == "c":
            return True
        t, u = self.toks[k + 1], self.toks[k + 2]
        return t.text == ")" or t.text in _C_TYPES or (t.kind == "identifier" and (u.kind == "identifier" or u.text in ("&", "*", "&&") and self.toks[k + 3].kind == "identifier" and self.toks[k + 4].text in (",", ")")))

    def initialiser(self) -> Node:
        if self.at("{"):
            first = self.i
            self.take()
            kids = []
            while not self.at("}"):
                if self.at(".", "["):
                    while not self.at("="):
                        self.close() if self.at("[") else self.take()
                    self.take()
                if self.at(","):
                    self.take()
                    continue
                kids.append(self.initialiser())
            self.take()
            return self.node("other", first, *kids)
        return self.expression(1)

    def java_member(self) -> list[Node]:
        first = self.i
        if self.at("import"):
            while not self.at(";"):
                self.take()
            self.take()
            return [self.node("import", first)]
        if self.at("package"):
            return self.skip_to_semicolon()
        before = self.java_modifiers()
        if self.at("{"):
            return [*before, self.block()]
        if self.at("class", "interface", "enum") or (self.t.text == "record" and self.peek().kind == "identifier" and self.peek(2).text in ("(", "<")):
            kind = self.t.text
            self.t.kind = "keyword"
            while not self.at("{"):
                if self.at("("):
                    self.close()
                else:
                    self.take()
            if kind == "enum":
                return [self.java_enum(first, before)]
            made = self.block("other", "class")
            made.start = self.toks[first].start
            made.children[:0] = before
            return [made]
        if self.at("@") and self.peek().text == "interface":
            self.i += 2
            self.take()
            return [self.block("other", "class")]
        if self.at("<"):
            self.i = self.angles(self.i) or self.fail(self.t)
        k = self.i
        while self.toks[k].text not in ("(", "=", ";", "{", "}") and self.toks[k].kind != "end":
            k = self.angles(k) or k + 1 if self.toks[k].text == "<" else k + 1
        if self.toks[k].text == "(" or (self.toks[k].text == "{" and self.toks[k - 1].kind == "identifier"):
            name = self.toks[k - 1].text
            self.i = k
            params = self.params() if self.at("(") else []
            while not self.at("{", ";"):
                if self.at("(", "["):
                    self.close()
                else:
                    self.take()
            if self.at(";"):
                self.take()
                return before + [Node("function", self.toks[first].start, self.toks[self.i - 1].end, name=name, params=params)]
            return [self.body_function(first, name, params, *before)]
        kids = self.java_declarators(k)
        return [self.node("other", first, *before, *kids)]

    def java_modifiers(self) -> list[Node]:
        while True:
            if self.at("@") and self.peek().text != "interface":
                self.take()
                self.take()
                while self.at("."):
                    self.i += 2
                if self.at("("):
                    self.close()
            elif self.t.text in _JAVA_MODIFIERS and self.t.kind in ("keyword", "identifier") and not (self.at("default", "synchronized") and self.peek().text in (":", "->", "(")):
                self.word(self.t.text)
            elif self.t.text == "non" and self.peek().text == "-":
                self.i += 3
            else:
                return []

    def java_enum(self, first: int, before: list[Node]) -> Node:
        self.want("{")
        kids = list(before)
        while not self.at(";", "}"):
            self.java_modifiers()
            if self.at(","):
                self.take()
                continue
            self.take()
            if self.at("("):
                self.take()
                kids += self.arguments(")")
            if self.at("{"):
                kids.append(self.block("other", "class"))
        while not self.at("}"):
            kids += self.item("class")
        self.take()
        return self.node("other", first, *kids)

    def java_declarators(self, k: int) -> list[Node]:
        self.i = k
        kids = []
        while not self.at(";"):
            if self.at("="):
                self.take()
                kids.append(self.initialiser())
            elif self.at("[", "("):
                self.close()
            else:
                self.take()
        self.take()
        return kids

    # -- statements of C, C++ and Java

    def condition(self) -> Node | None:
        """What stands in the parentheses of an if, while or switch."""
        first = self.i
        self.want("(")
        kids = []
        if self.c and self.declares():
            kids.append(self.c_local(end=(")", ";")))
            if self.at(";"):
                self.take()
                kids.append(self.expression())
        else:
            kids.append(self.expression())
            if self.at(";"):
                self.take()
                kids.append(self.expression())
        self.want(")")
        return self.node("expression" if self.lang in ("c", "java", "js", "ts") else "other", first, *kids)

    def c_statement(self) -> Node:
        first, s = self.i, self.t.text
        if self.t.kind == "literal":
            s = ""
        if s == "{":
            return self.block()
        if s == "if":
            self.take()
            if self.at("constexpr"):
                self.take()
            cond, then = self.condition(), self.c_statement_or_empty()
            other = None
            if self.at("else"):
                e = self.i
                self.take()
                inner = self.c_statement_or_empty()
                if self.lang == "java":
                    other = inner if inner and inner.kind == "branch" else Node("else", inner.start, inner.end, inner.children) if inner else self.node("else", e)
                else:
                    other = self.node("else", e, inner)
            return self.node("branch", first, cond, then, other)
        if s in ("while", "switch"):
            self.take()
            cond = self.condition()
            if s == "while":
                return self.node("loop", first, cond, self.c_statement_or_empty())
            return self.switch(first, cond)
        if s == "do":
            self.take()
            body = self.c_statement_or_empty()
            self.want("while")
            cond = self.condition()
            self.want(";")
            return self.node("loop", first, body, cond)
        if s == "for":
            return self.c_for(first)
        if s == "return" or s == "co_return":
            self.take()
            value = None if self.at(";") else self.initialiser() if self.at("{") else self.expression()
            self.want(";")
            return self.node("return", first, value)
        if s in ("break", "continue", "goto") or (s == "throw" and self.t.kind == "keyword") or (s == "yield" and self.lang == "java" and self.peek().text not in ("=", ".", "(")):
            self.word(s)
            value = None
            if s in ("throw", "yield"):
                value = None if self.at(";") else self.expression()
            elif self.t.kind == "identifier":
                self.take()
            self.want(";")
            return self.node("jump", first, value)
        if s == "try":
            self.take()
            kids: list[Node] = []
            if self.at("("):
                end = self.pair[self.i]
                self.take()
                while self.i < end:
                    kids.append(self.c_local(end=(";", ")")) if self.declares() else self.expression())
                    if self.at(";"):
                        self.take()
                self.i = end + 1
            kids.append(self.block())
            while self.at("catch"):
                k = self.i
                self.take()
                self.close()
                kids.append(self._wrap("catch", k))
            if self.at("finally"):
                k = self.i
                self.take()
                kids.append(self._wrap("other", k))
            return self.node("other", first, *kids)
        if s == "synchronized" and self.peek().text == "(":
            self.take()
            self.want("(")
            lock = self.expression()
            self.want(")")
            return self.node("other", first, lock, self.block())
        if s == "assert" and self.lang == "java":
            self.take()
            kids = [self.expression()]
            if self.at(":"):
                self.take()
                kids.append(self.expression())
            self.want(";")
            return self.node("other", first, *kids)
        if s in ("case", "default") and self.c:
            return self.c_case()
        if self.t.kind == "identifier" and self.peek().text == ":" and self.peek(2).text != ":":
            self.i += 2
            return self.node("other", first, None if self.at("}") else self.c_statement())
        if self.lang == "java":
            if s in ("class", "interface", "enum", "abstract", "final", "@", "static") or (s == "record" and self.peek().kind == "identifier" and self.peek(2).text == "("):
                k = self.i
                self.java_modifiers()
                if self.at("class", "interface", "enum", "record"):
                    self.i = k
                    return self.java_member()[0]
        elif self.lang == "cpp" and s in ("using", "namespace", "static_assert", "template"):
            self.skip_to_semicolon()
            return self.node("other", first)
        if self.declares():
            if self.c and (made := self.record_or(lambda: [])):
                return made[0]
            n = self.c_local()
            self.want(";")
            n.end = self.toks[self.i - 1].end
            return n
        value = self.expression()
        self.want(";")
        return self.node("statement", first, value)

    def _wrap(self, kind: str, k: int) -> Node:
        body = self.block()
        return self.node(kind, k, body)

    def c_statement_or_empty(self) -> Node | None:
        if self.at(";"):
            first = self.i
            self.take()
            return self.node("statement", first) if self.c else None
        return self.c_statement()

    def c_for(self, first: int) -> Node:
        self.take()
        self.want("(")
        end = self.pair[self.i - 1]
        kids: list[Node | None] = []
        colon = self._colon(self.i, end)
        if colon is not None:  # for (T x : xs)
            if self.lang == "cpp" and any(self.toks[k].text == ";" for k in range(self.i, colon)):
                kids.append(self.c_local())
            self.i = colon + 1
            kids.append(self.initialiser())
        else:
            if not self.at(";"):
                kids.append(self.c_local() if self.declares() else self.expressions())
            self.want(";")
            kids.append(None if self.at(";") else self.expression())
            self.want(";")
            kids.append(None if self.at(")") else self.expressions())
        if self.i != end:
            self.fail(self.t)
        self.take()
        kids.append(self.c_statement_or_empty())
        return self.node("loop", first, *kids)

    def _colon(self, k: int, end: int) -> int | None:
        ternary = 0
        while k < end:
            s = self.toks[k].text
            if s == "?":
                ternary += 1
            elif s == ":" and self.toks[k].kind != "literal":
                if not ternary:
                    return k
                ternary -= 1
            k = self.pair[k] + 1 if s in _OPEN and self.toks[k].kind == "punctuation" else k + 1
        return None

    def expressions(self) -> Node:
        first = self.i
        kids = [self.expression(1)]
        while self.at(","):
            self.take()
            kids.append(self.expression(1))
        return kids[0] if len(kids) == 1 else self.node("other", first, *kids)

    def switch(self, first: int, cond: Node | None) -> Node:
        if self.c:
            return self.node("other", first, cond, self.block())
        k = self.i
        self.want("{")
        cases: list[Node] = []
        while not self.at("}"):
            cases.append(self.java_case())
        self.take()
        return self.node("other", first, cond, self.node("other", k, *cases))

    def c_case(self) -> Node:
        first, default = self.i, self.at("default")
        self.take()
        kids: list[Node] = []
        if not default:
            kids.append(self.expression(1))
            if self.at("..."):
                self.take()
                kids.append(self.expression(1))
        self.want(":")
        while not self.at("case", "default", "}"):
            if self.at(";"):
                self.take()
                continue
            kids.append(self.c_statement())
        return self.node("other" if default else "case", first, *kids)

    def java_case(self) -> Node:
        first, kids, default, arrow = self.i, [], self.at("default"), False
        while self.at("case", "default"):
            plain = self.at("default")
            self.take()
            while not self.at(":", "->"):
                if plain:
                    self.fail(self.t)
                if self.word("when"):
                    kids.append(self.expression(1))
                elif self.at(",") or self.at("default"):
                    self.take()
                elif self.t.kind == "identifier" and self.peek().kind == "identifier":
                    self.type_()
                    if self.t.kind == "identifier":
                        self.take()
                elif self.t.kind == "identifier" and self.peek().text == "(" and self.toks[self.pair[self.i + 1] + 1].text in ("->", ":", ",", "when"):
                    self.take()
                    self.close()
                else:
                    kids.append(self.expression(2 if self.lang == "java" else 1, True))
            arrow = self.at("->")
            self.take()
            if arrow:
                break
        if arrow:
            if self.at("{"):
                kids.append(self.block())
            elif self.at("throw"):
                kids.append(self.c_statement())
            else:
                k = self.i
                value = self.expression()
                self.want(";")
                kids.append(self.node("statement", k, value))
        else:
            while not self.at("case", "default", "}"):
                if self.at(";"):
                    self.take()
                    continue
                kids.append(self.c_statement())
        return self.node("other" if default else "case", first, *kids)

    def declares(self) -> bool:
        """Whether a local declaration starts here."""
        t = self.t
        if self.lang == "java":
            if t.text in ("final", "@", "int", "long", "double", "float", "boolean", "char", "byte", "short") and t.kind in ("keyword", "punctuation", "operator"):
                return self.peek().text not in (".", "(") and not (t.text != "final" and self.peek().text == "[" and self.peek(2).text == "]" and self.peek(3).text in (".", "::"))
        elif t.text in _C_TYPES and t.kind == "keyword":
            return not (self.lang == "cpp" and self.peek().text in ("(", "{") and t.text not in ("decltype", "auto"))
        elif t.text in _C_TYPES:
            return True
        if t.kind != "identifier" and t.text != "::":
            return False
        k = self.i
        while True:
            if self.toks[k].text == "::" and self.lang == "cpp":
                k += 1
                continue
            named = self.toks[k].text in _C_TYPES and self.toks[k - 1].text == "::"  # std::size_t
            if self.toks[k].kind != "identifier" and not named:
                return False
            k += 1
            if self.toks[k].text == "<" and self.lang != "c":
                j = self.angles(k)
                if j is None:
                    return False
                k = j
            if self.toks[k].text in ("::", ".") and self.toks[k].text == ("::" if self.c else "."):
                k += 1
                continue
            break
        star = False
        while self.toks[k].text in ("*", "&", "&&", "const", "...") and self.c:
            star, k = star or self.toks[k].text != "const", k + 1
        while self.lang == "java" and self.toks[k].text == "[" and self.toks[k + 1].text == "]":
            k += 2
        if self.lang == "cpp" and self.toks[k].text == "[" and star:
            return True
        if self.toks[k].kind != "identifier":
            return False
        after = self.toks[k + 1].text
        if star and after not in ("=", ";", ",", ")", "[", ":", "{"):
            return False
        return after in ("=", ";", ",", "[", ":", ")") or (self.lang == "cpp" and after in ("(", "{") and not star) or (self.lang == "java" and after in (":",))

    def c_local(self, end: tuple[str, ...] = (";",)) -> Node:
        first = self.i
        kids: list[Node] = []
        if self.lang == "java":
            self.java_modifiers()
            self.type_()
        while not self.at(*end):
            if self.at("="):
                self.take()
                kids.append(self.initialiser())
            elif self.at("{") and self.c:
                kids.append(self.initialiser())
            elif self.at("[") and self.peek().text != "]" and self.c and self.toks[self.i - 1].text not in ("auto", "&", "&&"):
                self.take()
                kids.append(self.expression())
                self.want("]")
            elif self.at("(") and self.lang == "cpp" and self.toks[self.i - 1].kind == "identifier" and not self.parameters_at(self.i):
                self.take()
                kids += self.arguments(")")
            elif self.t.text in _OPEN and self.t.kind == "punctuation":
                self.close()
            elif self.at("<") and (k := self.angles(self.i)):
                self.i = k
            elif self.t.kind in ("identifier", "keyword") or self.at("*", "&", "&&", "::", ",", "..."):
                self.take()
            else:
                self.fail(self.t)
        return self.node("declaration", first, *kids)

    # -- JavaScript and TypeScript

    def js_end(self) -> None:
        if self.at(";"):
            self.take()
        elif not (self.at("}") or self.t.kind == "end" or self.t.after_newline):
            self.fail(self.t)

    def js_statement(self) -> Node:
        first, s = self.i, self.t.text if self.t.kind != "literal" else ""
        nxt = self.peek()
        if s == "{":
            return self.block()
        if s in ("var", "const", "let") and not (s == "let" and nxt.text in ("=", ".", ";", "(")):
            if s == "const" and nxt.text == "enum":
                self.i += 3
                self.close()
                return self.node("other", first)
            n = self.js_variables()
            self.js_end()
            n.end = self.toks[self.i - 1].end
            return n
        if s == "function" or (s == "async" and nxt.text == "function" and not nxt.after_newline):
            return self.js_function()
        if s == "class" or (s == "abstract" and nxt.text == "class"):
            self.word("abstract")
            return self.js_class()
        if s == "if":
            self.take()
            cond, then, other = self.condition(), self.js_body(), None
            if self.at("else"):
                e = self.i
                self.take()
                other = self._else(e)
            return self.node("branch", first, cond, then, other)
        if s == "for":
            return self.js_for(first)
        if s == "while":
            self.take()
            cond = self.condition()
            return self.node("loop", first, cond, self.js_body())
        if s == "do":
            self.take()
            body = self.js_body()
            self.want("while")
            cond = self.condition()
            if self.at(";"):
                self.take()
            return self.node("loop", first, body, cond)
        if s in ("return", "throw"):
            self.take()
            value = None if self.at(";", "}") or self.t.after_newline or self.t.kind == "end" else self.expression()
            self.js_end()
            return self.node("return" if s == "return" else "jump", first, value)
        if s in ("break", "continue"):
            self.take()
            if self.t.kind == "identifier" and not self.t.after_newline:
                self.take()
            self.js_end()
            return self.node("jump", first)
        if s == "debugger":
            self.take()
            self.js_end()
            return self.node("other", first)
        if s == "switch":
            self.take()
            cond = self.condition()
            k = self.i
            self.want("{")
            cases = []
            while not self.at("}"):
                c, default, kids = self.i, self.at("default"), []
                if not self.at("case", "default"):
                    self.fail(self.t)
                self.take()
                if not default:
                    kids.append(self.expression())
                self.want(":")
                while not self.at("case", "default", "}"):
                    kids += self.item("body")
                cases.append(self.node("other" if default else "case", c, *kids))
            self.take()
            return self.node("other", first, cond, self.node("other", k, *cases))
        if s == "try":
            self.take()
            kids = [self.block()]
            if self.at("catch"):
                k = self.i
                self.take()
                if self.at("("):
                    self.close()
                kids.append(self._wrap("catch", k))
            if self.at("finally"):
                k = self.i
                self.take()
                kids.append(self._wrap("other", k))
            return self.node("other", first, *kids)
        if s == "import" and nxt.text not in ("(", "."):
            return self.js_import(first)
        if s == "export":
            return self.js_export(first)
        if s == "@":
            while self.at("@"):
                self.decorator()
            n = self.js_statement()
            for f in [n, *n.children]:
                if f.kind == "function" and f.doc_anchor is None:
                    f.doc_anchor = self.toks[first].start
            return self.node("other", first, n)
        if self.lang == "ts" and self.t.kind in ("identifier", "keyword") and not nxt.after_newline:
            if s in ("interface", "namespace", "module") and nxt.kind in ("identifier", "literal"):
                self.word(s)
                while not self.at("{"):
                    self.i = self.angles(self.i) or self.fail(self.t) if self.at("<") else self.i + 1
                if s == "interface":
                    self.close()
                    return self.node("other", first)
                return self.node("other", first, self.block())
            if s == "enum":
                self.i += 2
                self.close()
                return self.node("other", first)
            if s == "type" and nxt.kind == "identifier":
                self.word("type")
                self.take()
                if self.at("<"):
                    self.i = self.angles(self.i) or self.fail(self.t)
                self.want("=")
                self.ts_type()
                self.js_end()
                return self.node("other", first)
            if s == "declare" and nxt.kind in ("keyword", "identifier"):
                self.word("declare")
                if self.word("global"):
                    return self.node("other", first, self.block())
                return self.node("other", first, self.js_statement())
        if self.t.kind == "identifier" and nxt.text == ":":
            self.i += 2
            return self.node("other", first, self.js_statement())
        value = self.expression()
        self.js_end()
        return self.node("statement", first, value)

    def _else(self, e: int) -> Node:
        inner = self.js_body()
        return self.node("else", e, inner)

    def js_body(self) -> Node | None:
        if self.at(";"):
            first = self.i
            self.take()
            return self.node("other", first)
        return self.js_statement()

    def js_variables(self) -> Node:
        first = self.i
        self.take()
        kids: list[Node] = []
        while True:
            kids += self.pattern()
            if self.at("!"):
                self.take()
            if self.at(":"):
                self.take()
                self.ts_type()
            if self.at("="):
                self.take()
                kids.append(self.expression(1))
            if not self.at(","):
                return self.node("declaration", first, *kids)
            self.take()

    def pattern(self) -> list[Node]:
        """A binding: its defaults are the only expressions."""
        if self.at("{", "["):
            k = self.i
            n = self.primary()
            del k
            return [n]
        if self.at("..."):
            self.take()
        first = self.i
        if self.t.kind not in ("identifier", "keyword"):
            self.fail(self.t)
        self.take()
        return [self.node("identifier", first)]

    def js_for(self, first: int) -> Node:
        self.take()
        self.word("await")
        self.want("(")
        end = self.pair[self.i - 1]
        k, kind = self.i, None
        while k < end:
            s = self.toks[k].text
            if s == ";" or (s in ("of", "in") and self.toks[k].kind in ("keyword", "identifier") and k > self.i):
                kind = s
                break
            k = self.pair[k] + 1 if s in _OPEN and self.toks[k].kind == "punctuation" else k + 1
        kids: list[Node | None] = []
        if kind in ("of", "in"):
            if self.at("var", "let", "const"):
                self.take()
            kids += self.pattern() if self.i + 1 == k or self.at("{", "[") else [self.expression(12)]
            self.word("of", "in")
            kids.append(self.expression())
        else:
            if self.at("var", "let", "const"):
                kids.append(self.js_variables())
            elif not self.at(";"):
                kids.append(self.expression())
            self.want(";")
            kids.append(None if self.at(";") else self.expression())
            self.want(";")
            kids.append(None if self.at(")") else self.expression())
        if self.i != end:
            self.fail(self.t)
        self.take()
        return self.node("loop", first, *kids, self.js_body())

    def js_import(self, first: int) -> Node:
        self.take()
        while self.t.kind != "literal":
            if self.at("{"):
                self.close()
            elif self.at("="):  # import x = require("y")
                self.take()
                self.expression()
                break
            else:
                if self.t.text in ("from", "as", "type"):
                    self.t.kind = "keyword"
                self.take()
        if self.t.kind == "literal":
            self.take()
        if self.at("with", "assert") and self.peek().text == "{":
            self.take()
            self.close()
        self.js_end()
        return self.node("import", first)

    def js_export(self, first: int) -> Node:
        self.take()
        if self.word("default"):
            if self.at("function", "class", "async", "abstract") and not (self.at("async") and self.peek().text != "function"):
                return self.node("other", first, self._exported(self.js_statement()))
            value = self.expression(1)
            self.js_end()
            return self.node("other", first, value)
        if self.at("*") or self.at("{") or (self.t.text == "type" and self.peek().text == "{"):
            self.word("type")
            if self.at("{"):
                self.close()
            else:
                self.take()
                if self.word("as"):
                    self.take()
            if self.word("from"):
                self.take()
            self.js_end()
            return self.node("other", first)
        if self.at("="):
            self.take()
            value = self.expression()
            self.js_end()
            return self.node("other", first, value)
        return self.node("other", first, self._exported(self.js_statement()))

    def _exported(self, n: Node) -> Node:
        return n

    def decorator(self) -> None:
        self.want("@")
        self.take()
        while self.at("."):
            self.i += 2
        if self.at("("):
            self.close()

    def js_function(self) -> Node:
        first = self.i
        self.word("async")
        self.want("function")
        if self.at("*"):
            self.take()
        name = self.take().text if self.t.kind in ("identifier", "keyword") and not self.at("(") else None
        return self.js_rest(first, name)

    def js_rest(self, first: int, name: str | None, *before: Node) -> Node:
        """Parameters and body."""
        if self.at("<"):
            self.i = self.angles(self.i) or self.fail(self.t)
        if not self.at("("):
            self.fail(self.t)
        start = self.i
        params = self.params()
        kids = [*before, *self.param_defaults(start)]
        if self.at(":"):
            self.take()
            self.ts_type()
        if not self.at("{"):  # a declaration without a body (TypeScript)
            if self.lang != "ts":
                self.fail(self.t)
            self.js_end()
            return self.node("other", first)
        body = self.block()
        return self.node("function", first, *kids, body, name=name, params=params)

    def param_defaults(self, start: int) -> list[Node]:
        """The expressions of the parameters' defaults."""
        save, end, kids = self.i, self.pair[start], []
        k = start + 1
        while k < end:
            if self.toks[k].text == "=" and self.toks[k].kind == "operator":
                self.i = k + 1
                kids.append(self.expression(1))
                k = self.i
            else:
                k = self.pair[k] + 1 if self.toks[k].text in _OPEN and self.toks[k].kind == "punctuation" else k + 1
        self.i = save
        return kids

    def js_class(self) -> Node:
        first = self.i
        self.want("class")
        kids: list[Node] = []
        while not self.at("{"):
            if self.word("extends"):
                kids.append(self.expression(12))
                if self.at("<"):
                    self.i = self.angles(self.i) or self.fail(self.t)
            elif self.at("<"):
                self.i = self.angles(self.i) or self.fail(self.t)
            else:
                self.word("implements") or self.take()
        self.want("{")
        while not self.at("}"):
            if self.at(";"):
                self.take()
                continue
            kids += self.js_member()
        self.take()
        return self.node("other", first, *kids)

    def js_member(self) -> list[Node]:
        anchor = self.i
        while self.at("@"):
            self.decorator()
        first = self.i
        while self.t.text in _TS_WORDS and self.peek().text not in ("(", "=", ";", ":", "?", "!", "<", "}") and not (self.t.text in ("get", "set", "async", "static") and self.peek().after_newline and self.t.text != "static"):
            self.word(self.t.text)
        if self.at("{"):
            return [self.block()]
        if self.at("*"):
            self.take()
        before: list[Node] = []
        name = None
        if self.at("["):
            self.take()
            if self.lang == "ts" and self.peek().text == ":":
                self.i -= 1
                self.close()
                self.want(":")
                self.ts_type()
                self.js_end()
                return []
            before.append(self.expression())
            self.want("]")
        else:
            t = self.take()
            name = t.text if t.kind != "literal" else None
        if self.at("?", "!"):
            self.take()
        if self.at("(", "<"):
            n = self.js_rest(first, name, *before)
            if n.kind == "function" and anchor != first:
                n.doc_anchor = self.toks[anchor].start
            return [n]
        if self.at(":"):
            self.take()
            self.ts_type()
        if self.at("="):
            self.take()
            before.append(self.expression(1))
        self.js_end()
        return [self.node("other", first, *before)]

    # -- Go

    def go_end(self) -> None:
        if self.at(";"):
            self.take()
        elif not self.at("}", ")") and self.t.kind != "end":
            self.fail(self.t)

    def go_item(self) -> list[Node]:
        first, s = self.i, self.t.text if self.t.kind == "keyword" else ""
        if s == "package":
            self.take()
            self.take()
            self.go_end()
            return []
        if s == "import":
            self.take()
            specs = []
            if self.at("("):
                end = self.pair[self.i]
                self.take()
                while self.i < end:
                    if self.at(";"):
                        self.take()
                        continue
                    k = self.i
                    while self.t.kind != "literal":
                        self.take()
                    self.take()
                    specs.append(self.node("import", k))
                self.i = end + 1
            else:
                k = self.i
                while self.t.kind != "literal":
                    self.take()
                self.take()
                specs.append(self.node("import", k))
            self.go_end()
            return [self.node("other", first, *specs)]
        if s == "func" and self.peek().kind in ("identifier", "punctuation") and not (self.peek().text == "(" and self.toks[self.pair[self.i + 1] + 1].text in ("{", "(") and False):
            if self.peek().kind == "identifier" or self.toks[self.pair[self.i + 1] + 1].kind == "identifier" and self.toks[self.pair[self.i + 1] + 2].text in ("(", "["):
                n = self.go_function()
                self.go_end()
                return [n]
        if s == "type":
            self.take()
            if self.at("("):
                self.close()
            else:
                self.take()
                if self.at("[") and self.toks[self.i + 1].kind == "identifier" and self.toks[self.pair[self.i] + 1].text != ";":
                    self.close()
                if self.at("="):
                    self.take()
                self.go_type()
            self.go_end()
            return [self.node("other", first)]
        if s in ("var", "const"):
            self.take()
            kids: list[Node] = []
            group = self.pair[self.i] if self.at("(") else None
            if group:
                self.take()
            while True:
                while not self.at("=", ";", ")") and self.t.kind != "end":
                    if self.t.kind == "identifier" and not self.at(",") and self.peek().text in (",",):
                        self.i += 2
                    else:
                        self.take()
                        if not self.at("=", ";", ")"):
                            self.go_type()
                if self.at("="):
                    self.take()
                    kids.append(self.expressions())
                if group and self.i < group:
                    self.go_end()
                    if self.i < group:
                        continue
                break
            if group:
                self.want(")")
            self.go_end()
            return [self.node("declaration", first, *kids)]
        n = self.go_statement()
        self.go_end()
        return [n]

    def go_function(self) -> Node:
        first = self.i
        self.want("func")
        params = self.params() if self.at("(") else []
        name = self.take().text
        if self.at("["):
            self.close()
        params += self.params()
        if not self.at("{", ";"):
            self.go_result()
        if not self.at("{"):
            return self.node("function", first, name=name, params=params)
        return self.body_function(first, name, params)

    def go_statement(self) -> Node:
        first, s = self.i, self.t.text if self.t.kind in ("keyword", "punctuation") else ""
        if s == "{":
            return self.block()
        if s == "if":
            return self.go_if()
        if s == "for":
            self.take()
            kids, save = [], self.no_struct
            self.no_struct = True
            if not self.at("{"):
                if not self.at(";"):
                    if self.at("range"):
                        self.take()
                        kids.append(self.expression())
                    else:
                        kids.append(self.go_simple())
                if self.at(";"):
                    self.take()
                    if not self.at(";", "{"):
                        kids.append(self.expression())
                    if self.at(";"):
                        self.take()
                    if not self.at("{"):
                        kids.append(self.go_simple())
            self.no_struct = save
            return self.node("loop", first, *kids, self.block())
        if s in ("switch", "select"):
            self.take()
            kids, save = [], self.no_struct
            self.no_struct = True
            while not self.at("{"):
                if self.at(";"):
                    self.take()
                    continue
                kids.append(self.go_simple())
            self.no_struct = save
            self.want("{")
            while not self.at("}"):
                c, default, own = self.i, self.at("default"), []
                if not self.at("case", "default"):
                    self.fail(self.t)
                self.take()
                while not self.at(":"):
                    if self.at(","):
                        self.take()
                        continue
                    own.append(self.go_case_value())
                self.want(":")
                while not self.at("case", "default", "}"):
                    own += self.item("body")
                kids.append(self.node("other" if default else "case", c, *own))
            self.take()
            return self.node("other", first, *kids)
        if s == "return":
            self.take()
            value = None if self.at(";", "}") else self.expressions()
            return self.node("return", first, value)
        if s in ("break", "continue", "goto", "fallthrough"):
            self.take()
            if self.t.kind == "identifier":
                self.take()
            return self.node("jump", first)
        if s in ("go", "defer"):
            self.take()
            return self._statement(first)
        if self.t.kind == "identifier" and self.peek().text == ":":
            self.i += 2
            if self.at("}"):
                return self.node("other", first)
            if self.at(";"):
                self.take()
            return self._labelled(first)
        return self.go_simple()

    def _statement(self, first: int) -> Node:
        value = self.expression()
        return self.node("statement", first, value)

    def _labelled(self, first: int) -> Node:
        inner = self.go_statement()
        return self.node("other", first, inner)

    def go_case_value(self) -> Node:
        if self.at("*", "[", "map", "func", "chan", "struct", "interface") and self.t.kind != "literal":
            first = self.i
            self.go_type()
            return self.node("other", first)
        return self.go_simple(True)

    def go_simple(self, case: bool = False) -> Node:
        """A simple statement: an expression, an assignment, a short declaration, x++ or a send."""
        first = self.i
        kids = [self.expression(1)]
        while self.at(",") and not case:
            self.take()
            kids.append(self.expression(1))
        t = self.t.text
        if t in _ASSIGN and self.t.kind == "operator":
            self.take()
            if self.at("range"):
                self.take()
            kids.append(self.expressions())
            return self.node("declaration" if t == ":=" else "statement", first, *kids)
        if t in ("++", "--"):
            self.take()
            return self.node("statement", first, *kids)
        if t == "<-":
            self.take()
            kids.append(self.expression())
            return self.node("statement", first, *kids)
        if case or self.at("{"):
            return kids[0]
        return self.node("statement", first, *kids)

    def go_if(self) -> Node:
        first = self.i
        self.take()
        kids, save = [], self.no_struct
        self.no_struct = True
        if not self.at(";"):
            kids.append(self.go_simple())
        if self.at(";"):
            self.take()
            kids.append(self.expression())
        self.no_struct = save
        if kids and kids[-1].kind == "statement" and len(kids[-1].children) == 1:
            kids[-1] = kids[-1].children[0]
        kids.append(self.block())
        if self.at("else"):
            self.take()
            kids.append(self.go_if() if self.at("if") else self.block("else"))
        return self.node("branch", first, *kids)

    # -- Rust

    def rust_attributes(self) -> bool:
        found = False
        while self.at("#"):
            found = True
            self.take()
            if self.at("!"):
                self.take()
            self.close()
        return found

    def rust_item(self) -> list[Node]:
        anchor = self.i
        self.rust_attributes()
        if self.at("}") or self.t.kind == "end":
            return []
        first = self.i
        if self.at("pub"):
            self.take()
            if self.at("("):
                self.close()
        k = self.i
        while self.toks[k].text in ("const", "async", "unsafe", "extern", "default") or (self.toks[k].kind == "literal" and self.toks[k - 1].text == "extern"):
            k += 1
        s = self.t.text if self.t.kind in ("keyword", "identifier") else ""
        if self.toks[k].text == "fn":
            self.i = k
            n = self.rust_function(first)
            if anchor != first:
                n.doc_anchor = self.toks[anchor].start
            return [n]
        if s == "use" or (s == "extern" and self.peek().text == "crate"):
            self.skip_to_semicolon()
            return [self.node("import", first)]
        if s in ("mod", "impl", "trait", "extern") or (s == "unsafe" and self.peek().text in ("impl", "trait", "extern")):
            while not self.at("{", ";"):
                if self.at("<"):
                    self.i = self.rust_angles(self.i)
                elif self.at("(", "["):
                    self.close()
                else:
                    self.take()
            if self.at(";"):
                self.take()
                return [self.node("other", first)]
            return [self.block("other")]
        if s in ("struct", "enum") or (s == "union" and self.peek().kind == "identifier"):
            while not self.at("{", ";", "("):
                self.i = self.rust_angles(self.i) if self.at("<") else self.i + 1
            if self.at("("):
                self.close()
                self.skip_to_semicolon()
            elif self.at("{"):
                self.close()
            else:
                self.take()
            return [self.node("other", first)]
        if s == "type":
            self.skip_to_semicolon()
            return [self.node("other", first)]
        if s in ("const", "static") and self.peek().text not in ("{", "|"):
            while not self.at("=", ";"):
                self.i = self.rust_angles(self.i) if self.at("<") else self.pair[self.i] + 1 if self.at("(", "[") else self.i + 1
            kids = []
            if self.at("="):
                self.take()
                kids.append(self.expression())
            self.want(";")
            return [self.node("other", first, *kids)]
        if s == "macro_rules" and self.peek().text == "!":
            self.i += 3
            brace = self.at("{")
            self.close()
            if not brace:
                self.want(";")
            return [self.node("other", first)]
        if s == "let":
            return [self.rust_let()]
        self.ended = False
        value = self.expression(0, False)
        if self.at(";"):
            self.take()
        elif not self.ended:
            if self.at("}"):
                return [value]  # the block's value
            if self.toks[self.i - 1].text != "}":
                self.fail(self.t)
        return [self.node("statement", first, value)]

    def rust_function(self, first: int) -> Node:
        self.want("fn")
        name = self.take().text
        if self.at("<"):
            self.i = self.rust_angles(self.i)
        params = self.params()
        while not self.at("{", ";"):
            self.i = self.rust_angles(self.i) if self.at("<") else self.pair[self.i] + 1 if self.at("(", "[") else self.i + 1
        if self.at(";"):
            self.take()
            return self.node("other", first)
        return self.body_function(first, name, params)

    def rust_let(self) -> Node:
        first = self.i
        self.want("let")
        kids = [self.rust_pattern(("=", ";", ":"))]
        if self.at(":"):
            self.take()
            self.rust_type()
        if self.at("="):
            self.take()
            kids.append(self.expression())
            if self.at("else"):
                self.take()
                kids.append(self.block())
        self.want(";")
        return self.node("declaration", first, *kids)

    def rust_pattern(self, stop: tuple[str, ...]) -> Node:
        first = self.i
        while not self.at(*stop):
            if self.t.kind == "end":
                self.fail(self.t)
            if self.t.text in _OPEN and self.t.kind == "punctuation":
                self.close()
            elif self.at("::") and self.peek().text == "<":
                self.take()
                self.i = self.rust_angles(self.i)
            else:
                self.take()
        return self.node("other", first)

    def rust_condition(self) -> Node:
        save, self.no_struct = self.no_struct, True
        n = self.expression()
        self.no_struct = save
        return n

    def rust_if(self) -> Node:
        first = self.i
        self.want("if")
        kids = [self.rust_condition(), self.block()]
        if self.at("else"):
            e = self.i
            self.take()
            kids.append(self._rust_else(e))
        return self.node("branch", first, *kids)

    def _rust_else(self, e: int) -> Node:
        inner = self.rust_if() if self.at("if") else self.block()
        return self.node("else", e, inner)

    def rust_block_like(self) -> Node | None:
        """An expression that ends with its block."""
        first = self.i
        if self.t.kind == "identifier" and self.t.text.startswith("'") and self.peek().text == ":":
            self.i += 2
            return self.rust_block_like()
        s = self.t.text if self.t.kind in ("keyword", "punctuation") else ""
        if s == "{":
            return self.block()
        if s == "if":
            return self.rust_if()
        if s in ("unsafe", "async", "const") and self.peek().text in ("{", "move") and (self.peek().text == "{" or self.peek(2).text == "{"):
            self.take()
            if self.at("move"):
                self.take()
            return self._wrap("other", first)
        if s == "loop":
            self.take()
            return self._wrap("loop", first)
        if s == "while":
            self.take()
            cond = self.rust_condition()
            return self._loop(first, cond)
        if s == "for":
            self.take()
            p = self.rust_pattern(("in",))
            self.take()
            it = self.rust_condition()
            return self._loop(first, p, it)
        if s == "match":
            self.take()
            value = self.rust_condition()
            k = self.i
            self.want("{")
            arms = []
            while not self.at("}"):
                self.rust_attributes()
                a = self.i
                kids = [self.rust_pattern(("=>", "if"))]
                if self.at("if"):
                    self.take()
                    kids.append(self.expression())
                self.want("=>")
                body = self.expression()
                kids.append(body)
                if self.at(","):
                    self.take()
                elif not self.at("}") and self.toks[self.i - 1].text != "}":
                    self.fail(self.t)
                arms.append(self.node("case", a, *kids))
            self.take()
            return self.node("other", first, value, self.node("other", k, *arms))
        return None

    def _loop(self, first: int, *kids: Node) -> Node:
        body = self.block()
        return self.node("loop", first, *kids, body)

    # -- expressions

    def expression(self, level: int = 0, whole: bool = True) -> Node:
        """level 0 takes commas (JavaScript, C); from 1 on binary operators of at least that strength and assignments."""
        first = self.i
        if self.lang == "rust" and not whole:  # a statement: a block ends it
            n = self.rust_block_like()
            if n is not None and not self.at(".", "?"):
                self.ended = True
                return n
            self.ended = False
            left = n if n is not None else None
            left = self.postfix(left, first) if left is not None else self.operand()
        else:
            left = self.operand()
        left = self.binary(left, first, max(level, 1))
        while level == 0 and self.at(",") and (self.js or self.c):
            self.take()
            right = self.expression(1)
            left = self.node("other", first, left, right)
        return left

    def binary(self, left: Node, first: int, level: int) -> Node:
        while True:
            t = self.t
            s = t.text
            if t.kind not in ("operator", "keyword", "identifier") or t.virtual:
                return left
            if t.kind == "identifier" and s not in ("as", "satisfies"):
                return left
            if s in ("as", "satisfies") and level <= 10 and self.lang in ("ts", "rust", "js") and not (self.js and t.after_newline):
                if self.lang == "js":
                    return left
                self.word(s)
                self.type_()
                left = self.node("other", first, left)
                continue
            if s == "instanceof" and self.lang == "java" and level <= 7:
                self.take()
                self.java_modifiers()
                self.type_()
                if self.at("("):
                    self.close()
                left = self.node("other", first, left)
                continue
            if s == "?" and level <= 1 and self.lang not in ("go", "rust"):
                self.take()
                yes = self.expression(1)
                self.want(":")
                no = self.expression(1)
                left = self.node("conditional", first, left, yes, no)
                continue
            if s in _ASSIGN and t.kind == "operator" and level <= 1 and self.lang != "go":
                self.take()
                right = self.initialiser() if self.c and self.at("{") else self.expression(1)
                left = self.node("assignment", first, left, right)
                continue
            if self.lang == "rust" and s in ("..", "..=") and level <= 1:
                self.take()
                right = None if self.at(")", "]", "}", ",", ";", "=>") or (self.no_struct and self.at("{")) else self.expression(2)
                left = self.node("other", first, left, right)
                continue
            power = _BINARY.get(s)
            if power is None or power < level or (s == "in" and not self.js) or (s == "instanceof" and not self.js) or (s in ("and", "or") and self.lang != "cpp"):
                return left
            if s == ">" and self.lang == "java" and self.peek().text in (">",) and self.peek().start == t.end:
                pass
            self.take()
            k = self.i
            right = self.binary(self.operand(), k, power + (s != "**"))
            if s in ("&&", "||", "and", "or"):
                left = self.node("logical", first, left, right, label=s)
            else:
                left = self.node("binary", first, left, right)

    def operand(self) -> Node:
        first, t = self.i, self.t
        s = t.text if t.kind in ("operator", "keyword", "punctuation") else ""
        if s in _PREFIX and not (s in ("typeof", "void", "delete") and not self.js and not (s == "delete" and self.lang == "cpp")) and not (s in ("not", "compl") and self.lang != "cpp") and not (s == "^" and self.lang != "go"):
            self.take()
            if s == "delete" and self.at("[") and self.lang == "cpp":
                self.close()
            if self.lang == "rust" and s in ("&", "&&"):
                self.word("mut") or (self.at("raw") and self.word("raw"))
            if s == "<-" and self.at("chan"):
                self.i -= 1
                self.go_type()
                return self.postfix(self.node("other", first), first)
            inner = self.operand()
            if self.js and self.at("**"):
                inner = self.binary(inner, first, 11)
            return self.node("unary" if s != "delete" or self.js else "other", first, inner)
        if self.lang == "rust" and s in ("..", "..="):
            self.take()
            return self.node("other", first, None if self.at(")", "]", "}", ",", ";") else self.expression(2))
        if s in ("await", "co_await", "co_yield", "yield", "throw") and (self.js or self.lang == "cpp"):
            self.take()
            if s == "yield" and self.at("*"):
                self.take()
            if self.at(")", "]", "}", ",", ";", ":") or (t.after_newline is False and self.t.after_newline and s == "yield"):
                return self.node("other", first)
            inner = self.expression(1) if s in ("yield", "throw", "co_yield") else self.operand()
            return self.node("jump" if s == "throw" and False else "other", first, inner)
        if self.c and s == "sizeof" or s in ("alignof", "typeid"):
            self.take()
            if self.at("..."):
                self.take()
            if self.at("(") and self.c_type_in(self.i):
                self.close()
                return self.node("other", first)
            return self.node("other", first, self.operand())
        if self.lang in ("c", "cpp", "java") and s == "(" and self.cast_at(self.i):
            self.close()
            if self.at("{"):
                inner = self.initialiser()
                return self.postfix(self.node("other", first, inner), first)
            inner = self.operand()
            return self.node("expression", first, inner)
        return self.postfix(self.primary(), first)

    def c_type_in(self, k: int) -> bool:
        t = self.toks[k + 1]
        if t.text in _C_TYPES and t.kind in ("keyword", "identifier"):
            return True
        last = self.toks[self.pair[k] - 1].text
        return t.kind == "identifier" and (last in ("*", "&") or (self.pair[k] == k + 2 and t.text.endswith("_t")))

    def cast_at(self, k: int) -> bool:
        """Whether the parentheses at k are a cast."""
        end, nxt = self.pair[k], self.toks[self.pair[k] + 1]
        follows = nxt.kind in ("identifier", "literal") or nxt.text in ("(", "!", "~", "this", "new", "sizeof", "super", "switch") or (nxt.text in ("*", "&", "-", "+", "{", "++", "--") and nxt.kind != "literal")
        if not follows or end == k + 1:
            return False
        inner = self.toks[k + 1 : end]
        primitive = inner[0].text in (_C_TYPES if self.c else ("int", "long", "double", "float", "boolean", "char", "byte", "short")) and inner[0].kind in ("keyword", "identifier")
        if primitive:
            return all(t.kind in ("identifier", "keyword") or t.text in ("*", "&", "[", "]", "<", ">", ",", "::", "(", ")", "const") for t in inner) and not (self.lang == "cpp" and any(t.text == "(" for t in inner) and inner[-1].text == ")" and inner[1].text == "(" and False)
        if nxt.text in ("*", "&", "-", "+", "++", "--") and not (self.c and inner[-1].text == "*"):
            return False
        if nxt.text == "{" and not self.c:
            return False
        if not all(t.kind == "identifier" or t.text in ("*", "&", "[", "]", "<", ">", ">>", ",", "::", ".", "?", "const", "struct", "extends", "super") for t in inner):
            return False
        if inner[0].kind != "identifier" and inner[0].text not in ("const", "struct", "::"):
            return False
        if self.c and nxt.text == "(":
            return inner[-1].text == "*" or inner[0].text in ("const", "struct") or (len(inner) == 1 and inner[0].text.endswith("_t"))
        if inner[-1].text in (".", "<", ",", "::") or (self.c and any(t.text == "<" for t in inner) and inner[-1].text not in (">", "*", "&", ">>")):
            return False
        return True

    def arguments(self, close: str) -> list[Node]:
        """Expressions up to a closing bracket, which is taken."""
        kids: list[Node] = []
        save, self.no_struct = self.no_struct, False
        while not self.at(close):
            if self.at(","):
                self.take()
                continue
            if self.at("..."):
                self.take()
                continue
            if self.lang == "go" and self.at("[", "map", "chan", "struct", "interface", "*", "func"):
                save_i = self.i
                if self.at("*") or self.at("func"):
                    kids.append(self.expression(1))
                else:
                    self.go_type()
                    if self.at("{", "("):
                        self.i = save_i
                        kids.append(self.expression(1))
                    else:
                        kids.append(self.node("other", save_i))
                continue
            kids.append(self.initialiser() if self.c and self.at("{") else self.expression(1))
            if self.at(":") and self.lang == "go":
                self.take()
            if not self.at(",", close, "..."):
                self.fail(self.t)
        self.take()
        self.no_struct = save
        return kids

    def callee(self, first: int, end: int) -> str | None:
        """The last identifier lexeme in the callee."""
        for k in range(end - 1, first - 1, -1):
            if self.toks[k].kind == "identifier":
                return self.toks[k].text
        return None

    def postfix(self, n: Node, first: int) -> Node:
        while True:
            t = self.t
            s = t.text if t.kind in ("operator", "punctuation", "keyword") else ""
            if s in (".", "?.", "->", "::") and not (s == "->" and not self.c) and not (s == "::" and self.lang in ("go", "js", "ts")):
                self.take()
                if s == "?." and self.at("(", "["):
                    continue
                if self.lang == "go" and self.at("("):
                    self.close()
                    n = self.node("other", first, n)
                    continue
                if self.at("<") and s in (".", "::"):
                    self.i = (self.rust_angles(self.i) if self.lang == "rust" else self.angles(self.i)) or self.fail(self.t)
                    if self.lang == "rust":
                        continue
                if self.at("~", "*", "template"):
                    self.take()
                if self.lang == "java" and self.at("new"):
                    n = self.new(first, n)
                    continue
                if self.t.kind not in ("identifier", "keyword", "literal"):
                    self.fail(self.t)
                if self.lang == "rust" and self.at("await"):
                    self.take()
                    n = self.node("other", first, n)
                    continue
                self.take()
                n = self.node("expression" if s != "::" else "other", first, n)
            elif s == "(" and not (self.js and False):
                label = self.callee(first, self.i)
                start = self.i
                self.take()
                kids = self.arguments(")")
                if self.lang == "java" and n.kind == "expression" and n.children and self.toks[start - 1].kind == "identifier":
                    n = n.children[0]  # a method's name belongs to the call
                elif self.lang == "java" and n.kind == "identifier":
                    n = None
                n = self.node("call", first, n, Node("other", self.toks[start].start, self.toks[self.i - 1].end, kids), label=label)
            elif s == "[" and not (self.js and False):
                if self.lang == "java" and self.peek().text == "]":
                    self.close()
                    continue
                self.take()
                kids = []
                while not self.at("]"):
                    if self.at(":", ","):
                        self.take()
                        continue
                    if self.lang == "go" and self.at("[", "map", "*", "chan", "func", "struct", "interface"):
                        self.go_type()
                        continue
                    kids.append(self.expression())
                self.take()
                n = self.node("expression", first, n, *kids)
            elif s in ("++", "--") and not (self.js and t.after_newline) and self.lang not in ("go", "rust"):
                self.take()
                n = self.node("unary", first, n)
            elif s == "!" and self.lang == "ts" and not t.after_newline and self.peek().text != "=":
                self.take()
                n = self.node("other", first, n)
            elif s == "?" and self.lang == "rust":
                self.take()
                n = self.node("other", first, n)
            elif s == "!" and self.lang == "rust" and n.kind in ("identifier", "other") and self.peek().text in ("(", "[", "{"):
                label = self.callee(first, self.i)
                self.take()
                self.close()
                n = self.node("call", first, label=label)
            elif s == "<" and self.lang in ("cpp", "ts", "java") and n.kind in ("identifier", "expression", "other") and (k := self.angles(self.i)) and self.toks[k].text in ("(", "::", "{", "`") and self.toks[k].kind != "literal":
                self.i = k
                if self.at("{") and self.lang == "cpp":
                    n = self.node("other", first, n)
            elif self.js and t.kind == "literal" and t.text[0] == "`" and not t.after_newline:
                inner = self.template()
                n = self.node("call", first, n, inner, label=self.callee(first, first + 1))
            elif s == "{" and self.lang == "cpp" and n.kind in ("identifier", "other") and self.toks[self.i - 1].kind in ("identifier", "operator") and self.toks[self.i - 1].text not in ("=",) and not self.no_struct and self.brace_init():
                n = self.node("other", first, n, self.initialiser())
            elif s == "{" and not self.no_struct and ((self.lang == "rust" and self.rust_struct_ahead(n)) or (self.lang == "go" and self.go_literal_ahead(n))):
                n = self.node("other", first, n, *self.braces())
            elif s == "{" and self.lang == "go" and n.kind == "other" and not self.no_struct:
                n = self.node("other", first, n, *self.braces())
            else:
                return n

    def brace_init(self) -> bool:
        return self.toks[self.pair[self.i] + 1].text in (";", ",", ")", ".", "}", "]", "(")

    def rust_struct_ahead(self, n: Node) -> bool:
        if n.kind not in ("identifier", "other") or self.toks[self.i - 1].kind not in ("identifier", "keyword", "operator"):
            return False
        a, b = self.toks[self.i + 1], self.toks[self.i + 2]
        return a.text in ("}", "..") or (a.kind in ("identifier", "literal") and b.text in (":", ",", "}")) or a.text == "#"

    def go_literal_ahead(self, n: Node) -> bool:
        return n.kind in ("identifier", "expression") and self.toks[self.i - 1].kind == "identifier" or n.kind == "expression" and self.toks[self.i - 1].text == "]"

    def braces(self) -> list[Node]:
        """Elements of a composite or struct literal."""
        self.want("{")
        save, self.no_struct = self.no_struct, False
        kids: list[Node] = []
        while not self.at("}"):
            if self.at(",", ";", ":", ".."):
                self.take()
                continue
            if self.lang == "rust":
                self.rust_attributes()
            if self.lang == "go" and self.at("{"):
                k = self.i
                own = self.braces()
                kids.append(self.node("other", k, *own))
                continue
            kids.append(self.expression(1))
        self.take()
        self.no_struct = save
        return kids

    def template(self) -> Node:
        """A template literal with its code."""
        first = self.i
        t = self.take()
        kids: list[Node] = []
        if t.inner:
            while self.toks[self.i - 1].end < t.inner[0]:
                if self.t.text == "${":
                    self.take()
                    kids.append(self.expression())
                    self.want("}")
                else:
                    self.take()
        return self.node("literal", first, *kids)

    def new(self, first: int, outer: Node | None = None) -> Node:
        self.want("new")
        kids = [outer] if outer else []
        if self.js:
            if self.at("."):
                self.i += 2
                return self.node("other", first)
            k = self.i
            target = self.new(k) if self.at("new") else self.primary()
            while self.at(".", "["):
                if self.at("["):
                    self.take()
                    index = self.expression()
                    self.want("]")
                    target = self.node("expression", k, target, index)
                else:
                    self.i += 2
                    target = self.node("expression", k, target)
            if self.at("<") and (j := self.angles(self.i)):
                self.i = j
            label = self.callee(k, self.i)
            kids.append(target)
        else:
            while self.at("(") and self.c:
                self.close()
            k = self.i
            self.type_()
            label = self.callee(k, self.i)
        if self.at("["):
            while self.at("["):
                self.take()
                if not self.at("]"):
                    kids.append(self.expression())
                self.want("]")
            if self.at("{"):
                kids.append(self.initialiser_list())
            return self.node("other" if self.lang == "java" else "call", first, *kids, label=None if self.lang == "java" else label)
        if self.lang == "java" and self.at("{"):
            return self.node("other", first, *kids, self.initialiser_list())
        if self.at("("):
            self.take()
            kids += self.arguments(")")
        elif self.at("{") and self.c:
            kids.append(self.initialiser())
        if self.lang == "java" and self.at("{"):
            kids.append(self.block("other", "class"))
        return self.node("call", first, *kids, label=label)

    def initialiser_list(self) -> Node:
        first = self.i
        self.want("{")
        kids = []
        while not self.at("}"):
            if self.at(","):
                self.take()
                continue
            kids.append(self.initialiser_list() if self.at("{") else self.expression(1))
        self.take()
        return self.node("other", first, *kids)

    def arrow_ahead(self) -> bool:
        """Whether a parenthesis starts an arrow function's (or a Java lambda's) parameters."""
        k = self.pair[self.i] + 1
        t = self.toks[k]
        if t.text == ("->" if self.lang == "java" else "=>"):
            return True
        if self.lang == "ts" and t.text == ":":
            save = self.i
            self.i = k + 1
            try:
                self.ts_type(("=>",))
                return self.at("=>") and all(self.toks[j].text not in ("?",) for j in range(save, save))
            except ParseError:
                return False
            finally:
                self.i = save
        return False

    def lambda_(self, first: int, arrow: str) -> Node:
        kids: list[Node] = []
        if self.at("("):
            start = self.i
            params = self.params()
            if self.js:
                kids += self.param_defaults(start)
            if self.at(":"):
                self.take()
                self.ts_type(("=>",))
        else:
            params = [Param(self.take().text)]
        self.want(arrow)
        save, self.no_struct = self.no_struct, False
        kids.append(self.block() if self.at("{") else self.expression(1))
        self.no_struct = save
        return self.node("function", first, *kids, params=params)

    def jsx(self, end: int) -> Node:
        """A JSX element that ends at a place: its names, attribute strings and code, elements within it alike."""
        first, kids = self.i, []
        while self.t.start < end and self.t.kind != "end":
            k = self.i
            if self.at("<", "</") and not (self.at("<") and self.t.inner and kids):
                self.take()
                if self.t.kind == "identifier":
                    name = self.take()
                    n = self.node("identifier", self.i - 1)
                    while self.at(".", ":"):
                        self.i += 2
                        n = Node("expression" if self.toks[self.i - 2].text == "." else "other", name.start, self.toks[self.i - 1].end, [n])
                    kids.append(n)
            elif self.at("{"):
                self.take()
                inner = []
                while not self.at("}"):
                    if self.at("..."):
                        self.take()
                    inner.append(self.expression())
                self.take()
                kids.append(self.node("other", k, *inner))
            elif self.at("<"):
                kids.append(self.jsx(self.t.inner[0][1]))
            elif self.t.kind == "literal":
                self.take()
                kids.append(self.node("literal", k))
            else:
                self.take()
        return self.node("other", first, *kids)

    def primary(self) -> Node:
        first, t = self.i, self.t
        s = t.text
        if t.kind == "literal":
            if s[0] == "`" and self.js:
                return self.template()
            self.take()
            while self.t.kind == "literal" and self.c and s[-1:] == '"':  # neighbouring strings are one
                self.take()
            return self.node("literal", first)
        if self.js and s == "<" and t.inner:
            return self.jsx(t.inner[0][1])
        if t.kind == "identifier":
            if self.js and self.peek().text == "=>":
                return self.lambda_(first, "=>")
            if self.lang == "java" and self.peek().text == "->":
                return self.lambda_(first, "->")
            if self.lang == "rust" and s.startswith("'") and self.peek().text == ":":
                return self.rust_block_like()
            self.take()
            return self.node("identifier", first)
        if s == "(":
            if (self.js or self.lang == "java") and self.arrow_ahead():
                return self.lambda_(first, "->" if self.lang == "java" else "=>")
            self.take()
            save, self.no_struct = self.no_struct, False
            kids: list[Node] = []
            comma = False
            while not self.at(")"):
                if self.at(","):
                    comma = True
                    self.take()
                    continue
                if self.lang == "go" and self.at("*") and self.peek().kind == "identifier":
                    kids.append(self.expression())
                    continue
                if self.c and self.at("{"):
                    kids.append(self.block())  # a statement expression
                    continue
                kids.append(self.expression())
            self.take()
            self.no_struct = save
            return self.node("other" if self.lang == "rust" and (comma or not kids) else "expression", first, *kids)
        if s == "[" and self.lang == "cpp":
            return self.cpp_lambda(first)
        if s == "[":
            if self.lang == "go":
                self.go_type()
                return self.node("other", first)
            self.take()
            save, self.no_struct = self.no_struct, False
            kids = []
            while not self.at("]"):
                if self.at(",", ";", "..."):
                    self.take()
                    continue
                kids.append(self.expression(1))
            self.take()
            self.no_struct = save
            return self.node("other", first, *kids)
        if s == "{" and self.js:
            return self.js_object(first)
        if s == "{" and self.lang == "java":
            return self.initialiser_list()
        if self.lang == "rust":
            n = self.rust_block_like()
            if n is not None:
                return n
            if s in ("|", "||") or (s in ("move", "static", "async") and self.peek().text in ("|", "||", "move")):
                return self.rust_closure(first)
            if s == "return":
                self.take()
                value = None if self.at(";", "}", ",", ")", "=>") else self.expression()
                return self.node("return", first, value)
            if s in ("break", "continue"):
                self.take()
                if self.t.kind == "identifier" and self.t.text.startswith("'"):
                    self.take()
                value = None if s == "continue" or self.at(";", "}", ",", ")") else self.expression()
                return self.node("jump", first, value)
            if s == "let":
                self.take()
                p = self.rust_pattern(("=",))
                self.take()
                value = self.binary(self.operand(), self.i, 3)
                return self.node("other", first, p, value)
            if s == "<":
                self.i = self.rust_angles(self.i)
                return self.node("other", first)
            if s == "::":
                self.take()
                return self.primary()
        if self.lang == "go":
            if s == "func":
                self.take()
                params = self.params()
                if not self.at("{"):
                    self.go_result()
                save, self.no_struct = self.no_struct, False
                if not self.at("{"):
                    self.no_struct = save
                    return self.node("other", first)
                n = self.body_function(first, None, params)
                self.no_struct = save
                return n
            if s in ("map", "chan", "struct", "interface", "*"):
                self.go_type()
                return self.node("other", first)
        if self.js:
            if s == "function" or (s == "async" and self.peek().text == "function"):
                return self.js_function()
            if s == "async":
                if self.peek().text == "(" or self.peek().kind == "identifier":
                    self.take()
                    if self.at("(") and not self.arrow_ahead():
                        return self.node("identifier", first)
                    return self.lambda_(first, "=>")
                self.take()
                return self.node("identifier", first)
            if s == "class":
                return self.js_class()
            if s == "new":
                return self.new(first)
            if s in ("this", "super", "import", "let", "static", "of", "yield"):
                self.take()
                return self.node("other", first)
            if s == "<" and self.lang == "ts" and (k := self.angles(self.i)):
                self.i = k
                if self.at("(") and self.arrow_ahead():
                    return self.lambda_(first, "=>")
                return self.node("other", first, self.operand())
            if s == "@":
                while self.at("@"):
                    self.decorator()
                return self.js_class()
        if s == "new" and (self.lang in ("java", "cpp")):
            return self.new(first)
        if self.lang == "java":
            if s == "switch":
                self.take()
                return self.switch(first, self.condition())
            if t.kind == "keyword":
                self.take()
                while self.at("[") and self.peek().text == "]":
                    self.close()
                return self.node("other", first)
        if s == "::" and self.lang == "cpp":
            self.take()
            return self.primary()
        if self.c and t.kind == "keyword" and s in (_C_TYPES | {"this", "static_cast", "operator", "requires"} | {"const_cast"}):
            self.take()
            if self.at("<") and (k := self.angles(self.i)):
                self.i = k
            while self.t.text in _C_TYPES and self.t.kind == "keyword":
                self.take()
            return self.node("other", first)
        if self.lang == "rust" and t.kind == "keyword" and s in ("self", "super", "crate", "Self", "u8", "u16", "u32", "u64", "u128", "usize", "i8", "i16", "i32", "i64", "i128", "isize", "f32", "f64", "bool", "char", "str"):
            self.take()
            return self.node("other", first)
        self.fail(t)

    def cpp_lambda(self, first: int) -> Node:
        self.close()
        if self.at("<") and (k := self.angles(self.i)):
            self.i = k
        params = self.params() if self.at("(") else []
        while not self.at("{"):
            if self.at("("):
                self.close()
            elif self.at("<") and (k := self.angles(self.i)):
                self.i = k
            elif self.t.kind in ("identifier", "keyword") or self.at("->", "::", "*", "&", "&&"):
                self.take()
            else:
                self.fail(self.t)
        return self.body_function(first, None, params)

    def rust_closure(self, first: int) -> Node:
        self.word("static")
        self.word("async")
        self.word("move")
        params: list[Param] = []
        if self.at("||"):
            self.take()
        else:
            self.want("|")
            part: list[Lexeme] = []
            while not self.at("|") or not part and False:
                if self.at(","):
                    params.append(Param(self.param_name(part, [x.text for x in part])))
                    part = []
                    self.take()
                elif self.t.text in _OPEN and self.t.kind == "punctuation":
                    end = self.pair[self.i]
                    part += self.toks[self.i : end + 1]
                    self.i = end + 1
                elif self.at("<"):
                    self.i = self.rust_angles(self.i)
                else:
                    part.append(self.take())
            if part:
                params.append(Param(self.param_name(part, [x.text for x in part])))
            self.take()
        if self.at("->"):
            self.take()
            self.rust_type()
            return self.body_function(first, None, params)
        save, self.no_struct = self.no_struct, self.no_struct
        body = self.expression(1)
        self.no_struct = save
        return self.node("function", first, body, params=params)

    def js_object(self, first: int) -> Node:
        self.want("{")
        kids: list[Node] = []
        while not self.at("}"):
            if self.at(","):
                self.take()
                continue
            if self.at("..."):
                self.take()
                kids.append(self.expression(1))
                continue
            k = self.i
            while self.t.text in ("get", "set", "async") and self.t.kind in ("identifier", "keyword") and self.peek().text not in (",", ":", "(", "}", "="):
                self.word(self.t.text)
            if self.at("*"):
                self.take()
            before: list[Node] = []
            name = None
            if self.at("["):
                self.take()
                before.append(self.expression())
                self.want("]")
            elif self.t.kind in ("identifier", "keyword", "literal"):
                t = self.take()
                name = t.text if t.kind != "literal" else None
            else:
                self.fail(self.t)
            if self.at("(", "<"):
                kids.append(self.js_rest(k, name, *before))
            elif self.at(":"):
                self.take()
                kids += before
                kids.append(self.expression(1))
            elif self.at("="):
                self.take()
                kids.append(self.expression(1))
            else:
                kids += before
            if not self.at(",", "}"):
                self.fail(self.t)
        self.take()
        return self.node("other", first, *kids)


def _bytes_of(text: str):
    """A function from a character's place to its byte offset."""
    if text.isascii():
        return lambda i: i
    at, total = [0] * (len(text) + 1), 0
    for i, c in enumerate(text):
        total += len(c.encode())
        at[i + 1] = total
    return at.__getitem__


def _parse(text: str, lang: str) -> tuple[Node, list[Token]]:
    p = Parser(text, lang)
    root = p.file()
    place = _bytes_of(text)
    stack = [root]
    while stack:
        n = stack.pop()
        n.start, n.end = place(n.start), place(n.end)
        if n.doc_anchor is not None:
            n.doc_anchor = place(n.doc_anchor)
        stack.extend(n.children)
    tokens: list[Token] = []
    c = lang in ("c", "cpp")
    for t in p.all:
        if t.virtual:
            continue
        if c and t.kind == "literal" and tokens and tokens[-1].kind == "literal" and t.text[-1:] == '"' and tokens[-1].text[-1:] == '"' and not t.inner:
            last = tokens[-1]
            tokens[-1] = Token("literal", text.encode()[last.start : place(t.end)].decode(), last.start, place(t.end))
            continue
        tokens.append(Token(t.kind, t.text, place(t.start), place(t.end)))
    return root, tokens


def parse(source: bytes, lang: str) -> tuple[Node, list[Token]]:
    """The tree and tokens of a file. Deep nesting gets a thread with a large stack."""
    try:
        text = source.decode()
    except UnicodeDecodeError as e:
        raise ParseError(1, 0, "not UTF-8") from e
    out: list = []

    def run():
        try:
            out.append(_parse(text, lang))
        except ParseError as e:
            out.append(e)
        except (IndexError, KeyError, AttributeError, TypeError):
            out.append(ParseError(1, 0, "unexpected syntax"))
        except RecursionError:
            out.append(ParseError(1, 0, "nested too deeply"))

    limit, size = sys.getrecursionlimit(), threading.stack_size()
    sys.setrecursionlimit(max(limit, 400_000))
    threading.stack_size(1 << 29)
    try:
        worker = threading.Thread(target=run)
        worker.start()
        worker.join()
    finally:
        threading.stack_size(size)
        sys.setrecursionlimit(limit)
    if isinstance(out[0], ParseError):
        raise out[0]
    return out[0]
