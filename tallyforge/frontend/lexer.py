"""One table-driven lexer for the languages with C-like tokens."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .ir import ParseError, classify


@dataclass(slots=True)
class Lexeme:
    kind: str  # as in ir.Token
    text: str
    start: int  # in characters while parsing
    end: int
    after_newline: bool = False
    virtual: bool = False  # an inserted semicolon: not a token of the file
    inner: list | None = None  # code inside a template literal: lists of lexemes


#: Reserved words (and words for built-in types) of each language, which are keywords wherever they stand.
KEYWORDS = {
    "c": "auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch typedef union unsigned void volatile while _Bool _Static_assert size_t ssize_t int8_t int16_t int32_t int64_t uint8_t uint16_t uint32_t uint64_t bool",
    "cpp": "alignas alignof and auto bool break case catch char class co_await co_return co_yield concept const consteval constexpr continue decltype default delete do double else enum explicit extern float for friend goto if inline int long mutable namespace new noexcept not operator or private protected public requires return short signed sizeof static static_cast struct switch template this throw try typedef typename union unsigned using virtual void volatile while size_t int8_t int16_t int32_t int64_t uint8_t uint16_t uint32_t uint64_t static_assert",
    "go": "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var",
    "java": "abstract assert boolean break byte case catch char class continue default do double else enum extends final finally float for if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while",
    "js": "async await break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof let new return static super switch this throw try typeof var void while with yield",
    "rust": "as async await break const continue crate dyn else enum extern fn for if impl in let loop match mod move mut pub ref return self static struct super trait type unsafe use where while i8 i16 i32 i64 i128 isize u8 u16 u32 u64 u128 usize f32 f64 bool char str",
}
KEYWORDS["ts"] = KEYWORDS["tsx"] = KEYWORDS["js"]
KEYWORDS = {k: frozenset(v.split()) for k, v in KEYWORDS.items()}

#: Words that are literals.
WORD_LITERALS = {
    "c": "true false NULL", "cpp": "true false NULL nullptr", "go": "true false nil iota", "java": "true false null", "js": "true false null undefined", "ts": "true false null undefined", "rust": "true false",
}
WORD_LITERALS = {k: frozenset(v.split()) for k, v in WORD_LITERALS.items()}
WORD_LITERALS["tsx"] = WORD_LITERALS["ts"]

_OPERATORS = r"<<<=|>>>=|\.\.\.|<=>|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|===|!==|>>>|\.\.=|&\^=|->\*|\?\.(?!\d)|=>|->|::|\+\+|--|&&|\|\||\?\?|==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|&\^|:=|<-|\.\.|\.\*|[-+*/%=<>!&|^~?:;,.(){}\[\]@#$\\]"
_NUMBER = r"(?:0[xX][0-9a-fA-F_']+(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?\d+)?|0[bBoO][0-7_']+|(?:\d[\d_']*)?\.?\d[\d_']*(?:\.(?![.\w]))?(?:[eE][+-]?\d[\d_]*)?)\w*"
_RUST_NUMBER = r"(?:0[xX][0-9a-fA-F_]+|0[bBoO][0-7_]+|\d[\d_]*(?:\.(?![.\w])|\.\d[\d_]*)?(?:[eE][+-]?[\d_]+)?)\w*"
_STRING = r'"(?:[^"\\\n]|\\.)*"'
_CHAR = r"'(?:[^'\\\n]|\\.)+'"
_WORD = r"[^\W\d][\w$]*"

_TABLES = {
    "c": [("comment", r"//(?:[^\n\\]|\\.)*|/\*.*?\*/"), ("literal", rf"(?:u8|[uUL])?{_STRING}|[uUL]?{_CHAR}"), ("number", _NUMBER), ("word", _WORD), ("op", _OPERATORS)],
    "go": [("comment", r"//[^\n]*|/\*.*?\*/"), ("literal", rf"`[^`]*`|{_STRING}|{_CHAR}"), ("number", _NUMBER), ("word", _WORD), ("op", _OPERATORS)],
    "java": [("comment", r"//[^\n]*|/\*.*?\*/"), ("literal", rf'"""(?:[^\\]|\\.)*?"""|{_STRING}|{_CHAR}'), ("number", _NUMBER), ("word", r"[^\W\d]\w*|\$\w*"), ("op", _OPERATORS)],
    "js": [("comment", r"//[^\n]*|/\*.*?\*/|(?<![\s\S])#![^\n]*"), ("literal", rf"{_STRING}|'(?:[^'\\\n]|\\.)*'"), ("template", "`"), ("number", rf"{_NUMBER}"), ("word", r"#?(?:[^\W\d]|\$)[\w$]*"), ("op", _OPERATORS)],
    "rust": [("comment", r"//[^\n]*|/\*"), ("literal", r'(?:b|c)?"(?:[^"\\]|\\.)*"|(?:b|c)?r(?P<h>#*)"[\s\S]*?"(?P=h)|b?\'(?:[^\'\\\n]|\\[^\n]+?)\''), ("lifetime", r"'\w+"), ("number", _RUST_NUMBER), ("word", r"(?:r#)?[^\W\d]\w*"), ("op", _OPERATORS)],
}
_TABLES["cpp"] = [("literal", r'(?:u8|[uUL])?R"(?P<d>[^(\s]*)\([\s\S]*?\)(?P=d)"'), *_TABLES["c"]]
_TABLES["ts"] = _TABLES["tsx"] = _TABLES["js"]
_RE = {k: re.compile("|".join(f"(?P<{n}{i}>{p})" for i, (n, p) in enumerate(t)), re.DOTALL) for k, t in _TABLES.items()}
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_DIRECTIVE = re.compile(r"#[ \t]*(\w*)")
_GO_ENDS = {"break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"}


def _regex_may_follow(last: Lexeme | None) -> bool:
    if last is None:
        return True
    if last.kind in ("identifier", "literal"):
        return False
    return last.text not in (")", "]", "}", "this", "super")


def lex(text: str, lang: str, start: int = 0, until: str | None = None) -> tuple[list[Lexeme], int]:
    """(lexemes, where it ended). until: stops at this closing brace, at depth 0 (code inside a template literal)."""
    rx, kinds = _RE[lang], [n for n, _ in _TABLES[lang]]
    keywords, words = KEYWORDS[lang], WORD_LITERALS[lang]
    out: list[Lexeme] = []
    i, n, depth, fresh, code = start, len(text), 0, True, None
    while i < n:
        c = text[i]
        if c in " \t\r\n\x0b\x0c﻿\xa0":
            if c == "\n":
                fresh = True
                if lang == "go" and code and not code.virtual and (code.kind in ("identifier", "literal") or code.text in _GO_ENDS):
                    code = Lexeme("punctuation", ";", i, i, False, True)
                    out.append(code)
            i += 1
            continue
        if c == "\\" and lang in ("c", "cpp") and text[i : i + 2] in ("\\\n", "\\\r"):
            i += 2
            continue
        if c == "#" and fresh and lang in ("c", "cpp"):
            i = _directive(text, i, lang, out)
            continue
        if c == "<" and lang in ("js", "tsx") and _regex_may_follow(code) and (made := _jsx(text, i, lang, fresh)):
            out.extend(made)
            code = made[-1]
            i, fresh = code.end, False
            continue
        if c == "/" and lang in ("js", "ts", "tsx") and _regex_may_follow(code) and (m := _REGEX.match(text, i)):
            code = Lexeme("literal", m[0], i, m.end(), fresh)
            out.append(code)
            i, fresh = m.end(), False
            continue
        m = rx.match(text, i)
        if not m:
            raise _error(text, i)
        kind = next(k for j, k in enumerate(kinds) if m[f"{k}{j}"] is not None)
        end = m.end()
        if kind == "template":
            made, end = _template(text, i, lang, fresh)
            out.extend(made)
            code = made[-1]
            i, fresh = end, False
            continue
        s = m[0]
        if kind == "comment":
            if s == "/*" and lang == "rust":
                end = _nested_comment(text, i)
                s = text[i:end]
            if lang == "rust" and s.startswith("//") and s.endswith("\r"):
                s, end = s[:-1], end - 1
            if lang == "go" and "\n" in s and code and not code.virtual and (code.kind in ("identifier", "literal") or code.text in _GO_ENDS):
                code = Lexeme("punctuation", ";", i, i, False, True)
                out.append(code)
            out.append(Lexeme("comment", s.rstrip("\r"), i, i + len(s.rstrip("\r"))))
            i = end
            continue
        if kind == "word":
            kind = "literal" if s in words else "keyword" if s in keywords else "identifier"
        elif kind in ("number", "literal"):
            kind = "literal"
        elif kind == "lifetime":
            kind = "keyword" if s == "'" else "identifier"
        else:
            kind = classify(s)
            if until:
                if s == "{":
                    depth += 1
                elif s == "}":
                    if not depth:
                        return out, i
                    depth -= 1
        code = Lexeme(kind, s, i, end, fresh)
        out.append(code)
        i, fresh = end, False
    if until:
        raise _error(text, n)
    if lang == "go" and code and not code.virtual and (code.kind in ("identifier", "literal") or code.text in _GO_ENDS):
        out.append(Lexeme("punctuation", ";", n, n, False, True))
    return out, n


def _error(text: str, i: int) -> ParseError:
    line = text.count("\n", 0, i) + 1
    return ParseError(line, len(text[text.rfind("\n", 0, i) + 1 : i].encode()), "unexpected syntax")


def _nested_comment(text: str, i: int) -> int:
    depth = 0
    for m in re.compile(r"/\*|\*/").finditer(text, i):
        depth += 1 if m[0] == "/*" else -1
        if not depth:
            return m.end()
    raise _error(text, i)


def _directive(text: str, i: int, lang: str, out: list[Lexeme]) -> int:
    """A preprocessor line: its word is a keyword, what follows is lexed for includes and conditions, else one token."""
    end = i
    while True:
        end = text.find("\n", end)
        end = len(text) if end < 0 else end
        if end == len(text) or not text[i:end].rstrip("\r").endswith("\\"):
            break
        end += 1
    body = text[i:end]
    cut = re.search(r"//|/\*", body)
    stop = i + (cut.start() if cut and "include" not in body[:12] else len(body))
    m = _DIRECTIVE.match(text, i)
    out.append(Lexeme("keyword", m[0], i, m.end(), True, inner=[m[1]]))
    rest = m.end()
    while rest < stop and text[rest] in " \t\r\\\n":
        rest += 1
    tail = text[rest:stop].rstrip()
    if not tail:
        return stop
    if m[1] == "include":
        t = re.match(r"<[^>\n]*>|\"[^\"\n]*\"", tail)
        s = t[0] if t else tail
        out.append(Lexeme("literal", s, rest, rest + len(s), inner=["include"]))
        return stop if not t else rest + len(s)
    if m[1] == "define":
        name = re.match(r"\w+", tail)
        if name:
            out.append(Lexeme("identifier", name[0], rest, rest + len(name[0]), inner=["pp"]))
            more = tail[len(name[0]) :]
            lead = len(more) - len(more.lstrip())
            if more.strip():
                a = rest + len(name[0]) + lead
                out.append(Lexeme(classify(more.strip()), more.strip(), a, a + len(more.strip()), inner=["pp"]))
        return stop
    out.append(Lexeme("identifier" if re.fullmatch(r"\w+", tail) else classify(tail), tail, rest, rest + len(tail), inner=["pp"]))
    return stop


#: Names of elements and attributes, what may stand between them, and the signs that make `<T` a list of type parameters.
_JSX_NAME = re.compile(r"(?:[^\W\d]|[$])[\w$-]*")
_JSX_GAP = re.compile(r"(?:\s|//[^\n]*|/\*.*?\*/)*", re.DOTALL)
_JSX_NOT = re.compile(r"<\s*[\w$]+\s*(?:,|extends\b[^>]*>\s*\(|>\s*\()")


def _jsx(text: str, i: int, lang: str, fresh: bool) -> list[Lexeme] | None:
    """The lexemes of the JSX element at i, the first marked with where the element ends; None if there is none.

    Names are identifiers, attribute strings literals, text between the tags one token a stretch; code in braces is lexed
    as such."""
    if not re.match(r"<\s*(?:[^\W\d]|[$>])", text[i : i + 200]) or (lang == "tsx" and _JSX_NOT.match(text, i)):
        return None
    out: list[Lexeme] = []
    at, depth = i, 0

    def sign(s: str) -> bool:
        nonlocal at
        gap = _JSX_GAP.match(text, at).end()
        if not text.startswith(s, gap):
            return False
        for m in re.compile(r"//[^\n]*|/\*.*?\*/", re.DOTALL).finditer(text, at, gap):
            out.append(Lexeme("comment", m[0], m.start(), m.end()))
        out.append(Lexeme("punctuation" if s in "{}" else "operator", s, gap, gap + len(s), fresh and not out))
        at = gap + len(s)
        return True

    def name() -> bool:
        nonlocal at
        m = _JSX_NAME.match(text, _JSX_GAP.match(text, at).end())
        if m:
            out.append(Lexeme("identifier", m[0], m.start(), m.end()))
            at = m.end()
        return bool(m)

    def code() -> None:
        nonlocal at
        inner, at = lex(text, lang, at, "}")
        out.extend(inner)
        sign("}")

    def dotted() -> bool:
        if not name():
            return False
        while sign(".") or sign(":"):
            if not name():
                raise _error(text, at)
        return True

    while True:
        if sign("</"):
            dotted()
            if not sign(">"):
                raise _error(text, at)
            depth -= 1
        elif sign("<"):
            dotted()
            while not (sign("/>") or sign(">")):
                if sign("{"):
                    code()
                elif not name():
                    raise _error(text, at)
                else:
                    if sign(":") and not name():
                        raise _error(text, at)
                    if sign("="):
                        gap = _JSX_GAP.match(text, at).end()
                        quote = text[gap : gap + 1]
                        if quote and quote in "\"'":
                            end = text.find(quote, gap + 1) + 1
                            if not end:
                                raise _error(text, gap)
                            out.append(Lexeme("literal", text[gap:end], gap, end))
                            at = end
                        elif sign("{"):
                            code()
                        else:
                            made = _jsx(text, gap, lang, False)
                            if not made:
                                raise _error(text, gap)
                            out.extend(made)
                            at = made[-1].end
            depth += out[-1].text == ">"
        elif sign("{"):
            code()
        else:
            raise _error(text, at)
        if not depth:
            out[0].inner = [("jsx", out[-1].end)]
            return out
        end = re.compile(r"[<{]").search(text, at)
        if not end:
            raise _error(text, at)
        words = text[at : end.start()]
        if words.strip():
            a = at + len(words) - len(words.lstrip())
            out.append(Lexeme(classify(words.strip()), words.strip(), a, a + len(words.strip())))
        at = end.start()


def _template(text: str, i: int, lang: str, fresh: bool) -> tuple[list[Lexeme], int]:
    """A template literal: one literal, or a literal for each stretch of text with the code between them."""
    out: list[Lexeme] = []
    first = a = i
    i += 1
    while i < len(text):
        c = text[i]
        if c == "\\":
            i += 2
        elif c == "`":
            out.append(Lexeme("literal", text[a : i + 1], a, i + 1, fresh and a == first))
            if len(out) > 1:
                out[0].inner = [i + 1]  # where the literal ends
            return out, i + 1
        elif text.startswith("${", i):
            if i > a:
                out.append(Lexeme("literal", text[a:i], a, i, fresh and a == first))
            out.append(Lexeme("operator", "${", i, i + 2))
            inner, end = lex(text, lang, i + 2, "}")
            out.extend(inner)
            out.append(Lexeme("punctuation", "}", end, end + 1))
            a = i = end + 1
        else:
            i += 1
    raise _error(text, first)
