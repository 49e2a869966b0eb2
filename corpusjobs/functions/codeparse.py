"""Definitions, calls and imports of one source file: what has to be read in order within a file.

Python is read from its syntax tree, languages with braces from the tokens of `tokens_of_code`: one reader for each
form of import, one for calls, one for methods in scripts, and a sweep over the lines that knows what is open around
each. Calls are by name: there are no types to tell one `save` from another.
"""

from __future__ import annotations

import ast
import functools
import importlib.util
import posixpath
from collections.abc import Callable, Iterable, Iterator
from pathlib import PurePosixPath

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from corpusjobs.functions import shapes
from corpusjobs.functions.segments import BRACE_EXTENSIONS, lines_of
from corpusjobs.functions.tokens_of_code import METHOD_WORDS, NO_CALLS, Line, after_group, defined_on, depths, is_name, telling, text_at, tokens_of

#: Script extensions.
SCRIPT_EXTENSIONS = ".js .jsx .ts .tsx .mjs .cjs".split()
#: Lines that a body, an import clause and the search for an opening brace may take; longest written call.
BODY_LINES, CLAUSE_LINES, OPENING_LINES, WRITTEN = 5000, 200, 3, 120

#: (kind of row, line, end line, name, qualified name or caller or module, kind of definition or expression)
Row = tuple[str, int, int | None, str, str, str]
#: The imports of a line: (module, name) pairs; None if it has none. The lines are given with the number of the one to read.
Reader = Callable[[list[Line], int, str], list[tuple[str, str]] | None]


# Python: the syntax tree


def module_of(path: str) -> str:
    """The dotted name of a file; that of its folder for __init__.py."""
    file = PurePosixPath(path)
    return ".".join(file.parent.parts if file.stem == "__init__" else file.with_suffix("").parts)


@functools.lru_cache(4096)
def _absolute(module: str | None, level: int, package: str) -> str:
    """The module that a `from` names; one that leaves the tree is taken from its top."""
    try:
        return importlib.util.resolve_name("." * level + (module or ""), package)
    except ImportError:
        return module or ""


def _written(func: ast.expr, name: str) -> str:
    try:
        return ast.unparse(func)
    except RecursionError:
        return name


#: Nodes and values that hold nothing to look for, and the fields that hold only such.
_LEAVES = frozenset(
    [ast.Name, ast.Constant, ast.alias, ast.Pass, ast.Break, ast.Continue, ast.Global, ast.Nonlocal, str, int, type(None)]
    + [x for base in (ast.expr_context, ast.operator, ast.unaryop, ast.boolop, ast.cmpop) for x in base.__subclasses__()]
)
_NO_CODE = set("ctx op ops id attr name arg kind type_comment asname level module rest".split())


@functools.cache
def _fields(kind: type) -> tuple[str, ...]:
    """The fields of a kind of node that may hold something, the last one first."""
    return tuple(f for f in reversed(kind._fields) if f not in _NO_CODE)


def python_rows(content: str) -> list[Row] | None:
    """Rows of a Python file, as `finished` takes them: modules with their points, calls as they are written. None if it does not parse.
    Decorators are read inside what they decorate."""
    if shapes.no_python(content):
        return None
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError, MemoryError, RecursionError):  # the last two: nested too deeply
        return None
    rows: list[Row] = []
    # depth first with a stack of our own: trees can be deeper than calls may nest
    todo: list[tuple[ast.AST, str, bool]] = [(n, "", False) for n in reversed(tree.body)]
    while todo:
        node, scope, of_class = todo.pop()
        kind = type(node)
        if kind is ast.Call:
            func = node.func
            if type(func) is ast.Name:
                rows.append(("call", node.lineno, None, func.id, scope or "<module>", func.id))
            elif type(func) is ast.Attribute:
                rows.append(("call", node.lineno, None, func.attr, scope or "<module>", _written(func, func.attr)))
        elif kind is ast.FunctionDef or kind is ast.AsyncFunctionDef or kind is ast.ClassDef:
            scope = f"{scope}.{node.name}" if scope else node.name
            what = "class" if kind is ast.ClassDef else "method" if of_class else "function"
            first = min([node.lineno, *(n.lineno for n in node.decorator_list)])
            rows.append(("symbol", first, node.end_lineno, node.name, scope, what))
            of_class = kind is ast.ClassDef
        elif kind is ast.Import:
            rows.extend(("import", node.lineno, None, "", a.name, "") for a in node.names)
            continue
        elif kind is ast.ImportFrom:
            module = "." * node.level + (node.module or "")
            rows.extend(("import", node.lineno, None, "" if a.name == "*" else a.name, module, "") for a in node.names)
            continue
        for field in _fields(kind):
            value = getattr(node, field, None)
            if type(value) is list:
                todo += [(v, scope, of_class) for v in reversed(value) if type(v) not in _LEAVES]
            elif type(value) not in _LEAVES:
                todo.append((value, scope, of_class))
    return rows


# Imports of languages with braces: a reader for each form


def _beside(path: str, target: str) -> str:
    return posixpath.normpath(posixpath.join(posixpath.dirname(path), target))


@functools.lru_cache(4096)
def _script_module(target: str, path: str) -> str:
    if not target.startswith("."):
        return target
    stem, ext = posixpath.splitext(_beside(path, target))
    return "path:" + stem + (ext if ext not in SCRIPT_EXTENSIONS else "")


def _clause_names(clause: Line) -> list[str]:
    """The original names that an import clause binds: those in braces first, then `name` and `* as name`."""
    braced: list[str] = []
    plain: list[str] = []
    depth, part = 0, []

    def close(names: list[str]) -> None:
        words = [t for t in part if t not in ("type", "*", "as")] or [t for t in part if t == "type"]
        if words:
            names.append(words[0])
        part.clear()

    for token in clause:
        if token.kind == "sign" and token.text in "{},":
            close(braced if depth else plain)
            depth += (token.text == "{") - (token.text == "}")
        elif token.kind == "name" or token.text == "*":
            part.append(token.text)
    close(braced if depth else plain)
    return braced + plain


def script_imports(code: list[Line], n: int, path: str) -> list[tuple[str, str]] | None:
    """`import|export [type] clause from "x"`, over several lines if the clause opens a brace, and `import "x"`."""
    line = code[n]
    if text_at(line, 0) not in ("import", "export"):
        return None
    if text_at(line, 0) == "import" and len(line) > 1 and line[1].kind == "string":
        return [(line[1].text, "")]
    first = 1 + (text_at(line, 1) == "type" and text_at(line, 2) not in (",", "from"))
    clause: Line = []
    closed = False
    for k in range(n, min(len(code), n + CLAUSE_LINES)):
        tokens = code[k][first:] if k == n else code[k]
        for at, token in enumerate(tokens):
            if token.text == "from" and token.kind == "name" and at + 1 < len(tokens) and tokens[at + 1].kind == "string":
                return [(tokens[at + 1].text, name) for name in _clause_names(clause + tokens[:at]) or [""]]
        if text_at(line, first) != "{" or closed:
            return None
        clause = clause + tokens
        closed = any(t.text == "}" for t in tokens)
    return None


def required(line: Line) -> list[tuple[str, str]]:
    """`const clause = require("x")`; the line may hold more."""
    for at in range(3, len(line) - 2):
        if line[at].text == "require" and text_at(line, at) and text_at(line, at - 1) == "=" and text_at(line, at + 1) == "(" and line[at + 2].kind == "string":
            first = next((k for k in range(at) if text_at(line, k) in ("const", "let", "var")), None)
            if first is not None:
                return [(line[at + 2].text, name) for name in _clause_names(line[first + 1 : at - 1]) or [""]]
    return []


def _dotted(line: Line, n: int, joint: str) -> tuple[str, int]:
    """The names from token n on with the signs `joint` between them, and the place after them."""
    k = n
    while is_name(line, k) or text_at(line, k) == joint:
        k += 1
    return "".join(t.text for t in line[n:k]), k


def jvm_imports(code: list[Line], n: int, path: str) -> list[tuple[str, str]] | None:
    line = code[n]
    if text_at(line, 0) != "import":
        return None
    name, end = _dotted(line, 1 + (text_at(line, 1) == "static"), ".")
    end += text_at(line, end) == "*"
    return [(name.rstrip("."), "")] if name and all(t.text == ";" for t in line[end:]) else None


def c_imports(code: list[Line], n: int, path: str) -> list[tuple[str, str]] | None:
    line = code[n]
    if [text_at(line, k) for k in (0, 1)] == ["#", "include"] and len(line) > 2 and line[2].kind == "string":
        return [("file:" + _beside(path, line[2].text), "")]
    return None


def go_imports(code: list[Line], n: int, path: str) -> list[tuple[str, str]] | None:
    """`import [alias] "x"`, or such a line without the word in a block `import ( ... )`."""

    def rest(line: Line) -> Line:
        return line[1:] if line and line[0].kind in ("name", "sign") and line[0].text in ("import",) else line

    def spec(line: Line) -> bool:
        return [t.kind for t in line] in (["string"], ["name", "string"]) or [t.kind for t in line] == ["sign", "string"] and line[0].text == "."

    line = rest(code[n])
    if not spec(line):
        return None
    if len(line) == len(code[n]):
        above = n - 1
        while above >= 0 and (not code[above] or spec(code[above])):
            above -= 1
        if above < 0 or [t.text for t in code[above][:2]] != ["import", "("]:
            return None
    return [(line[-1].text, "")]


def rust_imports(code: list[Line], n: int, path: str) -> list[tuple[str, str]] | None:
    line = code[n]
    at = int(text_at(line, 0) == "pub")
    name, _ = _dotted(line, at + 1, "::")
    return [(name, "")] if text_at(line, at) == "use" and name else None


def cs_imports(code: list[Line], n: int, path: str) -> list[tuple[str, str]] | None:
    line = code[n]
    name, end = _dotted(line, 1 + (text_at(line, 1) == "static"), ".")
    spaced = any(is_name(line, k) and is_name(line, k + 1) for k in range(1 + (text_at(line, 1) == "static"), end))
    return [(name, "")] if text_at(line, 0) == "using" and name and not spaced and text_at(line, end) == ";" else None


READERS: dict[str, Reader] = (
    dict.fromkeys(SCRIPT_EXTENSIONS, script_imports) | dict.fromkeys((".java", ".kt"), jvm_imports) | dict.fromkeys((".c", ".cpp", ".h", ".hpp"), c_imports)
    | {".go": go_imports, ".rs": rust_imports, ".cs": cs_imports}
)


# Definitions and calls of languages with braces

#: Extensions whose readers find what they look for on lines that `telling` keeps; tags, includes and blocks of imports are elsewhere too.
_BY_LINE = frozenset({*SCRIPT_EXTENSIONS, ".java", ".kt"} - {".jsx", ".tsx"})


def calls_on(line: Line) -> list[tuple[str, str]]:
    """(name, as written with its receivers) of each name before a bracket; type arguments may stand between."""
    out = []
    for n, token in enumerate(line):
        if token.kind != "name" or token.text in NO_CALLS:
            continue
        k = n + 1
        if text_at(line, k) == "<" and (end := after_group(line, k)) > k and not any(t.text in "()" for t in line[k:end] if t.kind == "sign"):
            k = end
        if text_at(line, k) != "(":
            continue
        first = n
        while text_at(line, first - 1) in (".", "?.") and is_name(line, first - 2):
            first -= 2
        out.append((token.text, "".join(t.text for t in line[first : n + 1])))
    return out


def _method_on(line: Line) -> str | None:
    """The method that an indented line of a class body starts: words, a name, arguments and a brace at the end."""
    if not line or not line[0].start or text_at(line, len(line) - 1) != "{" or any(t.text == ";" for t in line):
        return None
    n = 0
    while text_at(line, n) in METHOD_WORDS and text_at(line, n + 1) not in ("(", "<"):
        n += 1
    n += text_at(line, n) == "*"
    n += text_at(line, n) == "#"
    k = n + 1
    if text_at(line, k) == "<":
        k = after_group(line, k)
    if not is_name(line, n) or line[n].text in NO_CALLS or text_at(line, k) != "(":
        return None
    end = after_group(line, k)
    body = end == len(line) - 1 or text_at(line, end) == ":" and not any(t.text == "=" for t in line[end:])
    return line[n].text if end > k and body else None


class Definition:
    """A definition, with its lines and, later, its full name."""

    def __init__(self, first: int, last: int, name: str, is_class: bool):
        self.first, self.last, self.name, self.is_class = first, last, name, is_class
        self.full, self.kind = name, "class" if is_class else "function"


def definitions(code: list[Line], script: bool) -> list[Definition]:
    """By first line. Methods without a word of their own are looked for in the classes of scripts only."""
    after, opens = depths(code)

    def last_line(first: int) -> int:
        """The line on which the braces opened from `first` on are closed; `first` where none opens soon."""
        for n in range(first, min(first + OPENING_LINES, len(code) + 1)):
            if opens[n]:
                ends = range(n, min(len(code), first + BODY_LINES - 1) + 1)
                return next((k for k in ends if after[k] <= after[first - 1]), first)
            if text_at(code[n - 1], len(code[n - 1]) - 1) == ";":
                return n
        return first

    found = {n: Definition(n, last_line(n), *what) for n, line in enumerate(code, 1) if (what := defined_on(line, not script))}
    if script:
        bodies = [range(d.first + 1, d.last) for d in found.values() if d.is_class]
        for n in sorted(set().union(*bodies) - found.keys()):
            if name := _method_on(code[n - 1]):
                found[n] = Definition(n, last_line(n), name, False)
    return [found[n] for n in sorted(found)]


def brace_rows(content: str, path: str, ext: str) -> Iterator[Row]:
    """Rows as `finished` takes them: modules of scripts and calls as they are written, calls on the line of a definition apart.

    One sweep over the lines. `around` holds the definitions that are open, the one that began last on top."""
    script = ext in SCRIPT_EXTENSIONS
    lines = lines_of(content)
    code = tokens_of(telling(lines) if ext in _BY_LINE else lines)
    starting = {d.first: d for d in definitions(code, script)}
    around: list[Definition] = []
    for n, line in enumerate(code, 1):
        while around and around[-1].last < n:
            around.pop()
        if new := starting.get(n):
            holder = next((d for d in reversed(around) if d.is_class and d.last >= new.last), None)
            if holder:
                new.full = f"{holder.name}.{new.name}"
                new.kind = new.kind if new.is_class else "method"
            around.append(new)
            yield "symbol", n, new.last, new.name, new.full, new.kind
        named = READERS[ext](code, n - 1, path) if ext in READERS else None
        if named is None and script:
            yield from (("import", n, None, name, module, "") for module, name in required(line))
        if named is not None:
            yield from (("import", n, None, name, module, "") for module, name in named)
            continue
        caller = around[-1].full if around else "<module>"
        for name, written in calls_on(line):
            yield "call beside" if new else "call", n, None, name, caller, written
        if ext in (".jsx", ".tsx"):
            for k in range(1, len(line)):
                tag = line[k]
                if text_at(line, k - 1) == "<" and tag.kind == "name" and tag.text[0].isupper() and k + 1 < len(line) and (line[k + 1].start > tag.end or line[k + 1].text in "/>"):
                    yield "call", n, None, tag.text, caller, f"<{tag.text}>"


def finished(rows: Iterable[Row], module: Callable[[str], str]) -> list[Row]:
    """Rows with the modules that are meant, and what is written of a call cut to its length. A name on the line that defines it is no call."""
    out: list[Row] = []
    meant: dict[str, str] = {}
    defined = ""
    for row in rows:
        kind = row[0]
        if kind == "import":
            of = row[4]
            if of not in meant:
                meant[of] = module(of)
            out.append(row if meant[of] == of else (kind, row[1], None, row[3], meant[of], ""))
        elif kind == "call beside":
            if row[3] != defined:
                out.append(("call", row[1], None, row[3], row[4], row[5][:WRITTEN]))
        elif kind == "call" and len(row[5]) > WRITTEN:
            out.append((*row[:5], row[5][:WRITTEN]))
        else:
            if kind == "symbol":
                defined = row[3]
            out.append(row)
    return out


_PYTHON = shapes.Shapes(shapes.python_pieces, shapes.PYTHON_NAMES, shapes.PYTHON_ODD, python_rows)
_SCRIPT = shapes.Shapes(
    shapes.script_pieces, shapes.SCRIPT_NAMES, shapes.SCRIPT_ODD, lambda text: shapes.stands_alone(text, lambda t: list(brace_rows(t, "", ".js")))
)


def _meaning(path: str, ext: str) -> Callable[[str], str]:
    """What a module that a file names means."""
    if ext == ".py":
        package = module_of(path) if PurePosixPath(path).stem == "__init__" else ".".join(PurePosixPath(path).parent.parts)
        return lambda of: _absolute(of.lstrip("."), len(of) - len(of.lstrip(".")), package) if of.startswith(".") else of
    return (lambda of: _script_module(of, path)) if ext in SCRIPT_EXTENSIONS else lambda of: of


def rows_of(content: str, path: str) -> list[Row]:
    """All rows of a file, from the shapes of its pieces where it can be cut into such."""
    ext = PurePosixPath(path).suffix.lower()
    of_language = _PYTHON if ext == ".py" else _SCRIPT if ext in SCRIPT_EXTENSIONS and ext not in (".jsx", ".tsx") else None
    rows = of_language.read(content) if of_language else None
    return rows_of_whole(content, path) if rows is None else finished(rows, _meaning(path, ext))


def rows_of_whole(content: str, path: str) -> list[Row]:
    """All rows of a file, read as a whole."""
    ext = PurePosixPath(path).suffix.lower()
    if ext == ".py":
        return finished(python_rows(content) or (), _meaning(path, ext))
    if ext in BRACE_EXTENSIONS or ext in SCRIPT_EXTENSIONS:
        return finished(brace_rows(content, path, ext), _meaning(path, ext))
    return []


#: Columns of rows: the number of the file, and what `Row` has.
TYPES = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string())


def _read_at_once(shapes_of: shapes.Shapes, numbers: list[int], contents: list[str], paths: list[str], kinds: list[str]) -> tuple[list[int], list[pa.Array]]:
    """Files of one language: numbers of those that are left, and columns of the others, finished as by `finished`."""
    whole, file, (kind, line, end, name, of, detail, defined) = shapes_of.columns([contents[n] for n in numbers], [*kinds, *(["call beside"] if "call" in kinds else [])])
    file = np.array(numbers, np.int64)[file]
    beside = pc.equal(kind, "call beside")
    keep = pc.invert(pc.and_(beside, pc.equal(name, defined)))
    file, beside = file[np.asarray(keep)], beside.filter(keep)
    kind, line, end, name, of, detail = (c.filter(keep) for c in (kind, line, end, name, of, detail))
    kind, detail = pc.if_else(beside, "call", kind), pc.utf8_slice_codeunits(detail, 0, WRITTEN)
    # modules beside the file: each is worked out once for a file
    near = pc.and_(pc.equal(kind, "import"), pc.starts_with(of, "."))
    named, of_file = of.filter(near).dictionary_encode(), file[np.asarray(near)]
    known = named.dictionary.to_pylist()
    pairs, which = np.unique(of_file * max(1, len(known)) + np.asarray(named.indices), return_inverse=True)
    meant = [_meaning(paths[n], PurePosixPath(paths[n]).suffix.lower())(known[k]) for n, k in (divmod(int(p), max(1, len(known))) for p in pairs)]
    of = pc.replace_with_mask(of, near, pa.array(meant, pa.string()).take(pa.array(which)))
    return [numbers[n] for n in whole], [pa.array(file), kind, line, end, name, of, detail]


def columns_of(contents: list[str], paths: list[str], kinds: list[str]) -> list[pa.Array]:
    """The rows of some kinds (symbol, call, import) of many files, as `rows_of` gives them, in columns `TYPES`. Files that are told by the shapes
    of their pieces are read all at once, others one by one."""
    ends = [PurePosixPath(p).suffix.lower() for p in paths]
    python = [n for n, e in enumerate(ends) if e == ".py"]
    script = [n for n, e in enumerate(ends) if e in SCRIPT_EXTENSIONS and e not in (".jsx", ".tsx")]
    whole = sorted(set(range(len(paths))) - {*python, *script})
    parts = []
    for of_language, numbers in ((_PYTHON, python), (_SCRIPT, script)):
        if numbers:
            left, columns = _read_at_once(of_language, numbers, contents, paths, kinds)
            whole += left
            parts.append(columns)
    rows = [(n, *r) for n in whole for r in rows_of_whole(contents[n], paths[n]) if r[0] in kinds]
    parts.append([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(TYPES), TYPES)])
    return [pa.concat_arrays([p[k] for p in parts]) for k in range(len(TYPES))]
