"""Keys of program text under which renamed copies are equal.

A program's own name and every name that it binds become numbers in the order of their binding; free names,
literals and signs stay. White space, comments and header lines about its format do not count.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .python_text import python_udf

#: Words that declare a program, and words that bind the names that follow.
DECLARES = frozenset("def fn fun func function lemma method predicate task".split())
BINDS = frozenset("const exists for forall let val var".split())
#: Words that are no names.
WORDS = DECLARES | BINDS | frozenset("and assert bool decreases do else ensures false if implies in int invariant not or requires return returns seq string then true while".split())
#: Header lines that say which features a program uses, not what it does.
HEADERS = r"(?m)^[ \t]*(?:gates?|version)\b.*$"

_TOKEN = re.compile(r"""(?P<note>//[^\n]*|/\*.*?\*/)|(?P<text>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')|(?P<name>[^\W\d]\w*)|(?P<number>\d[\w.]*)|(?P<sign>:=|[<>=!]=|[^\w\s])""", re.S)
_OPEN, _SHUT = frozenset("([{"), frozenset(")]}")
_BLOCK = re.compile(r"^```[^\n]*\n(.*?)^```", re.S | re.M)


class _Scopes:
    """Names in force, innermost last. A program's scope holds its name, its parameters and its body."""

    def __init__(self):
        self.stack: list[dict[str, str]] = [{}]
        self.bound = 0

    def bind(self, name: str, at: int = -1) -> str:
        self.bound += 1
        self.stack[at][name] = f"%{self.bound}"
        return self.stack[at][name]

    def of(self, name: str) -> str:
        return next((s[name] for s in reversed(self.stack) if name in s), name)


def erased(text: str) -> str:
    """The program's tokens, one blank between them, with bound names as %1, %2, …"""
    parts = [(m.lastgroup, m.group()) for m in _TOKEN.finditer(re.sub(HEADERS, "", text)) if m.lastgroup != "note"]
    scopes, out = _Scopes(), []
    binding = declaring = False  # names that follow are bound; the next name is a program's own
    heads: list[int] = []  # depths at which a program's parameters may stand
    for i, (kind, token) in enumerate(parts):
        after = parts[i + 1][1] if i + 1 < len(parts) else ""
        if kind == "name" and token not in WORDS:
            if declaring:
                out.append(scopes.bind(token, 0))
                scopes.stack.append({})
                heads.append(len(scopes.stack))
            elif binding:
                out.append(scopes.bind(token))
            elif after == ":" and heads and len(scopes.stack) == heads[-1] + 1:
                out.append(scopes.bind(token, heads[-1] - 1))
            else:
                out.append(scopes.of(token))
            declaring = False
            binding = binding and after == ","
            continue
        if kind == "name":
            if token in DECLARES and len(scopes.stack) > 1 and heads and len(scopes.stack) == heads[-1]:
                scopes.stack.pop()  # the program before it ends
                heads.pop()
            declaring, binding = token in DECLARES, token in BINDS
        elif token in _OPEN:
            scopes.stack.append({})
        elif token in _SHUT and len(scopes.stack) > 1 and not (heads and len(scopes.stack) == heads[-1]):
            scopes.stack.pop()
        out.append(token)
    return " ".join(out)


def block(text: str) -> str | None:
    """The first fenced block of a reply; None without one."""
    m = _BLOCK.search(text)
    return m.group(1) if m else None


def without_body(program: str) -> str:
    """The program up to its body in braces."""
    return program.partition("{")[0]


def program_key(text: Column | str) -> Column:
    """sha256 of the program with its bound names erased."""
    return F.sha2(python_udf(erased, "string")(text), 256)


def keys(reply: Column | str) -> Column:
    """Struct of program, spec: the keys of the program in a reply and of what stands before its body; null without a program."""

    def both(text: str) -> tuple[str, str] | None:
        program = block(text)
        return None if program is None else (erased(program), erased(without_body(program)))

    found = python_udf(both, "struct<program:string,spec:string>")(reply)
    return F.when(found["program"].isNotNull(), F.struct(F.sha2(found["program"], 256).alias("program"), F.sha2(found["spec"], 256).alias("spec")))
