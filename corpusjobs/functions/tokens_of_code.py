"""Source lines of brace languages as tokens, and what a line of tokens defines.

Comments give no token and a string gives one, so braces and names within either are out of the way for whoever reads
tokens. A line is read from left to right by what its tokens are, with one table of words for all languages.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Token(NamedTuple):
    kind: str  # name, string (text is what is quoted), number or sign
    text: str
    start: int
    end: int


Line = list[Token]

#: Words that may stand before a definition, that start one, and that are no names of definitions.
MODIFIERS = set("export default async public private protected internal abstract static final sealed partial data open override suspend inline unsafe pub virtual unsigned".split())
CLASS_WORDS = set("class interface struct enum trait object record impl".split())
FUNCTION_WORDS = {"function": "*", "func": "(", "fun": "<", "fn": ""}  # with the sign that may come before the name
VARIABLE_WORDS = set("const let var".split())
NO_DEFINITIONS = set("if for while switch return else catch do new sizeof elif".split())
NOT_A_TYPE = set("return await new throw else case yield typeof delete void goto".split())
#: Names before a bracket that are no calls, and words before a method of a script.
NO_CALLS = NO_DEFINITIONS | set(
    "function typeof await super this constructor import require async with assert print not and or in is lambda yield def class".split()
)
METHOD_WORDS = set("static async get set public private protected readonly".split())
#: Signs that a type may hold, and what closes each bracket.
TYPE_SIGNS, CLOSES = set("<>[],:*&") | {"::"}, {"(": ")", "<": ">", "[": "]", "{": "}"}

_TOKEN = re.compile(
    r"""(?P<comment>//.*|/\*)|(?P<string>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|`(?:[^`\\]|\\.)*`)"""
    r"""|(?P<name>[A-Za-z_$][\w$]*)|(?P<number>\d[\w.]*)|(?P<sign>=>|\?\.|::|\S)"""
)


def tokens_of(lines: list[str]) -> list[Line]:
    """The tokens of each line; comments may go on over lines."""
    out, commented = [], False
    for line in lines:
        found, at = [], 0
        while at < len(line):
            if commented:
                close = line.find("*/", at)
                if close < 0:
                    break
                commented, at = False, close + 2
            elif not (m := _TOKEN.search(line, at)):
                break
            else:
                kind, text, start = m.lastgroup, m.group(), m.start()
                at = start + len(text)
                if kind == "string":
                    found.append(Token(kind, text[1:-1], start, at))
                elif kind == "comment":
                    commented = text == "/*"
                else:
                    found.append(Token(kind, text, start, at))
        out.append(found)
    return out


#: How a line starts that defines or imports something without a bracket or brace on it.
_STARTS = re.compile(
    rf"\s*(?:(?:{'|'.join(sorted(MODIFIERS))})\s+)*(?:{'|'.join(sorted({*CLASS_WORDS, *FUNCTION_WORDS, *VARIABLE_WORDS, 'import', 'export'}))})(?![\w$])"
).match


def telling(lines: list[str], ends: bool = True) -> list[str]:
    """The lines with those left empty that say nothing to readers of definitions, calls and imports that look at a line alone: they hold no
    bracket, brace or (where `ends` count) end of a statement, and do not start as a definition or import does. Comments over lines leave all as
    they are, and so do clauses of imports that may go on over lines."""
    if any("/*" in line for line in lines):
        return lines
    out = []
    for line in lines:
        starts = _STARTS(line)
        if starts and "{" in line and ("import" in line or "export" in line):
            return lines
        out.append(line if starts or "(" in line or "{" in line or "}" in line or ends and ";" in line else "")
    return out


def text_at(line: Line, n: int) -> str:
    """The text of token n; nothing beyond the end and for strings."""
    return line[n].text if 0 <= n < len(line) and line[n].kind != "string" else ""


def is_name(line: Line, n: int) -> bool:
    return 0 <= n < len(line) and line[n].kind == "name"


def after_group(line: Line, n: int) -> int:
    """The place after the bracket that closes the one at n; n itself if the line does not close it."""
    opening, depth = line[n].text, 0
    for k in range(n, len(line)):
        if line[k].kind == "sign":
            depth += (line[k].text == opening) - (line[k].text == CLOSES[opening])
            if not depth:
                return k + 1
    return n


def _function_value(line: Line, n: int) -> bool:
    """Is the value from token n on a function: `function`, `name =>` or `(...) =>`, async or not, with a result type or not?"""
    n += text_at(line, n) == "async"
    if text_at(line, n) == "function" or is_name(line, n) and text_at(line, n + 1) == "=>":
        return True
    if text_at(line, n) != "(" or (end := after_group(line, n)) == n:
        return False
    if text_at(line, end) == ":":
        end = next((k for k in range(end, len(line)) if text_at(line, k) in ("=>", "=")), end)
    return text_at(line, end) == "=>"


def _variable(line: Line, n: int) -> str | None:
    """The name that `const|let|var` at n binds to a function."""
    if not is_name(line, n + 1):
        return None
    equals = next((k for k in range(n + 2, len(line)) if text_at(line, k) == "="), None)
    typed = text_at(line, n + 2) in (":", "=")
    return line[n + 1].text if typed and equals is not None and _function_value(line, equals + 1) else None


def _typed(line: Line) -> str | None:
    """The name of `type name(`: names and signs of a type, then, after a space or a star, a name before a bracket; no
    statement ends on the line."""
    if not is_name(line, 0) or line[0].text in NOT_A_TYPE:
        return None
    for k in range(1, len(line)):
        token = line[k]
        if token.kind == "name" and text_at(line, k + 1) == "(":
            apart = token.start > line[k - 1].end or line[k - 1].text == "*"
            if apart and token.text not in NO_DEFINITIONS and not any(t.text == ";" for t in line[k + 1 :] if t.kind == "sign"):
                return token.text
            return None
        if token.kind not in ("name", "number") and token.text not in TYPE_SIGNS:
            return None
    return None


def defined_on(line: Line, typed: bool = True) -> tuple[str, bool] | None:
    """(name, is it a class?) of what the line starts to define. typed: `type name(` counts as well."""
    n = 0
    while text_at(line, n) in MODIFIERS and n + 1 < len(line):
        n += 1
        if text_at(line, n) == "(" and text_at(line, n - 1) == "pub":
            n = after_group(line, n)
    word = text_at(line, n)
    name = None
    if word in CLASS_WORDS and is_name(line, n + 1):
        return line[n + 1].text, True
    if word in FUNCTION_WORDS and n + 1 < len(line) and (word == "function" or line[n + 1].start > line[n].end):
        k = n + 1
        if text_at(line, k) == FUNCTION_WORDS[word] != "":
            k = after_group(line, k) if word != "function" else k + 1
        name = line[k].text if is_name(line, k) else None
    elif word in VARIABLE_WORDS:
        name = _variable(line, n)
    if name is None and typed:
        name = _typed(line)
    return (name, False) if name and name not in NO_DEFINITIONS else None


def depths(code: list[Line]) -> tuple[list[int], list[bool]]:
    """The depth of braces after each line (index 0: before the first), and whether the line opens one."""
    after, opens = [0], [False]
    for line in code:
        signs = [t.text for t in line if t.kind == "sign"]
        after.append(after[-1] + signs.count("{") - signs.count("}"))
        opens.append("{" in signs)
    return after, opens
