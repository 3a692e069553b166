"""Front ends: source text to the language-independent representation."""

from __future__ import annotations

from .ir import ParseError, annotate

#: Languages in lookup order, with their extensions and the version strings that results report.
LANGUAGES: list[tuple[str, tuple[str, ...], str]] = [
    ("c", ("c", "h"), "tallyforge-c 1"),
    ("cpp", ("cpp", "cc", "cxx", "hpp", "hh", "hxx"), "tallyforge-cpp 1"),
    ("go", ("go",), "tallyforge-go 1"),
    ("java", ("java",), "tallyforge-java 1"),
    ("javascript", ("js", "mjs", "cjs", "jsx"), "tallyforge-javascript 1"),
    ("typescript", ("ts", "mts", "cts"), "tallyforge-typescript 1"),
    ("tsx", ("tsx",), "tallyforge-typescript 1"),
    ("python", ("py",), "tallyforge-python 1"),
    ("rust", ("rs",), "tallyforge-rust 1"),
]
_GRAMMAR = {"javascript": "js", "typescript": "ts", "tsx": "tsx"}
PARSERS = {name: version for name, _, version in LANGUAGES}


def extensions() -> list[str]:
    return [e for _, own, _ in LANGUAGES for e in own]


def language_of(path: str) -> str | None:
    """By the last extension, case-sensitive; a dot-file's name is no extension."""
    name = path.rsplit("/", 1)[-1]
    stem, dot, ext = name.rpartition(".")
    return next((n for n, own, _ in LANGUAGES if ext in own), None) if dot and stem else None


def to_ir(language: str, source: bytes) -> dict:
    """Rows of nodes, tokens and functions; ParseError where the source can't be read."""
    if language == "python":
        from . import python_front

        root, tokens = python_front.parse(source)
    elif language == "text":
        from . import text_front

        root, tokens = text_front.parse(source)
    else:
        from . import clike_front

        root, tokens = clike_front.parse(source, _GRAMMAR.get(language, language))
    return annotate(root, tokens, source)


__all__ = ["LANGUAGES", "PARSERS", "ParseError", "extensions", "language_of", "to_ir"]
