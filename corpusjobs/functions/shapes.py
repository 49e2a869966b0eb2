"""Rows of source code by the shape of its statements.

Source repeats itself up to names: `return f(x)` is read as `return g(y)` is. A file is cut where nothing is open, each piece is looked up by
what is left of it without its names, and only shapes not met before go through the parser; names are then filled in. Where a piece cannot be
told from its shape, or does not stand for itself, None is returned and the file is parsed as a whole.
"""

from __future__ import annotations

import ast
import keyword
import re
from collections.abc import Callable, Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from corpusjobs.functions.tokens_of_code import CLASS_WORDS, FUNCTION_WORDS, METHOD_WORDS, MODIFIERS, NO_CALLS, NOT_A_TYPE, VARIABLE_WORDS

Row = tuple[str, int, int | None, str, str, str]
#: Shapes that are kept; longer pieces than this are parsed as they are.
SHAPES, LONGEST = 20_000, 20_000
#: What stands for a name in a shape, a mark between fields that no source holds, and what stands for a name in the shapes of many files.
NAME, MARK, HOLE = "Q%dQ", "\x00", "\x01"
_PLACE = re.compile(r"Q(\d+)Q")


def names_but(words: Iterable[str], letters: str) -> re.Pattern:
    """Names of these letters that are none of the words. Digits and points before one are part of a number, or of the shape."""
    return re.compile(rf"(?<![{letters}0-9])(?!(?:{'|'.join(map(re.escape, sorted(words)))})(?![{letters}0-9]))([{letters}][{letters}0-9]*)")


class Shapes:
    """Pieces by shape. `rows` reads a piece, and gives None if what it reads may depend on what comes before or after it."""

    def __init__(self, pieces: Callable[[str], list[str]], names: re.Pattern, odd: list[re.Pattern], rows: Callable[[str], list[Row] | None]):
        self.pieces, self.names, self.odd, self.rows = pieces, names, odd, rows
        self.known: dict[tuple[str, ...], tuple | None] = {}
        self.forms: dict[str, tuple | None] = {}

    def _learn(self, shape: tuple[str, ...]) -> tuple | None:
        """(line, end line, kind) of each row, and a template of the rows' strings; None if the shape has to be read with its names."""
        parts = [shape[0]]
        for n, gap in enumerate(shape[1:]):
            parts += [NAME % n, gap]
        text = "".join(parts)
        found = None if len(_PLACE.findall(text)) != len(shape) - 1 else self.rows(text)
        if found is None:
            return None
        fixed, fields = [(r[0], r[1], r[2]) for r in found], MARK.join(f for r in found for f in r[3:])
        pieces = _PLACE.split(fields)
        return fixed, "%s".join(p.replace("%", "%%") for p in pieces[::2]), [int(n) for n in pieces[1::2]], pieces[::2]

    def _learnt(self, shape: tuple[str, ...]) -> tuple | None:
        if shape not in self.known:
            if len(self.known) >= SHAPES:
                self.known.clear()
            self.known[shape] = self._learn(shape)
        return self.known[shape]

    def _regular(self, content: str) -> bool:
        return content.isascii() and not any(odd.search(content) for odd in self.odd)

    def read(self, content: str) -> list[Row] | None:
        """The rows of a file, None if it cannot be read by pieces. Texts of fields are cut to no length here."""
        if not self._regular(content):
            return None
        out: list[Row] = []
        line = 0
        for piece in self.pieces(content):
            if not piece:
                continue
            if len(piece) > LONGEST:
                return None
            parts = self.names.split(piece)
            shape, names = tuple(parts[::2]), parts[1::2]
            learnt = self._learnt(shape)
            if learnt is None:
                return None
            fixed, template, places, _ = learnt
            if fixed:
                fields = (template % tuple([names[p] for p in places])).split(MARK)
                k = 0
                for kind, first, last in fixed:
                    out.append((kind, line + first, None if last is None else line + last, fields[k], fields[k + 1], fields[k + 2]))
                    k += 3
            line += piece.count("\n")
        return out

    def _form(self, shape: str) -> tuple | None:
        """A shape for `columns`: kinds, lines and end lines of its rows, and for each of their texts (name, of, detail, and the name that the
        row before it defines) the constants between names and the numbers of the names."""
        if shape not in self.forms:
            if len(self.forms) >= SHAPES:
                self.forms.clear()
            learnt = self._learnt(tuple(shape.split(HOLE)))
            if learnt is not None:
                fixed, _, places, constants = learnt
                texts: list[tuple[list[str], list[int]]] = [([""], [])]
                for n, constant in enumerate(constants):
                    if n:
                        texts[-1][0].append("")
                        texts[-1][1].append(places[n - 1])
                    first, *others = constant.split(MARK)
                    texts[-1][0][-1] += first
                    texts += [([other], []) for other in others]
                rows, defined = [], ([""], [])
                for k in range(len(fixed)):
                    defined = texts[3 * k] if fixed[k][0] == "symbol" else defined
                    rows.append([(tuple(c), p) for c, p in (*texts[3 * k : 3 * k + 3], defined)])
                learnt = fixed, rows
            self.forms[shape] = learnt
        return self.forms[shape]

    def columns(self, contents: list[str], kinds: Iterable[str]) -> tuple[list[int], np.ndarray, list[pa.Array]]:
        """The rows of some kinds of many files at once, as `read` gives them, without a step in Python for each row: numbers of the files that have to be read
        whole, the number of each row's file, and the columns kind, line, end line, name, of, detail and the name that the line defines."""
        whole = [n for n, c in enumerate(contents) if not self._regular(c) or HOLE in c]
        left = sorted(set(range(len(contents))) - set(whole))
        pieces = [self.pieces(contents[n]) for n in left]
        file_of = np.repeat(np.arange(len(left)), [len(p) for p in pieces])
        sizes = np.fromiter(map(len, chain.from_iterable(pieces)), np.int64, len(file_of))
        file_of, sizes = file_of[sizes > 0], sizes[sizes > 0]
        begins = np.concatenate([[0], np.cumsum(sizes)])
        text = np.frombuffer("".join(contents[n] for n in left).encode(), np.uint8)
        # runs of the characters of words; none goes over the border of two files
        letters = np.array([bool(self.names.fullmatch(chr(k) + "aa")) for k in range(128)])  # a letter by itself may be a word
        in_word = (letters | np.isin(np.arange(128), list(b"0123456789")))[text]
        edge = np.ones(len(text), bool)
        edge[1:] = in_word[1:] != in_word[:-1]
        edge[begins[:-1]] = True
        at = np.append(np.flatnonzero(edge), len(text))
        runs = _strings(at, text)
        words = runs.dictionary_encode()
        is_name = np.array([bool(self.names.fullmatch(w)) for w in words.dictionary.to_pylist()], bool)[np.asarray(words.indices)]
        names, first, last = runs.filter(pa.array(is_name)), at[:-1][is_name], at[1:][is_name]
        # the shapes of pieces: names shrink to one character
        inside = np.zeros(len(text) + 1, np.int8)
        inside[first + 1] += 1
        inside[last] -= 1
        holed = text.copy()
        holed[first] = ord(HOLE)
        names_before = np.searchsorted(first, begins)
        gone = np.concatenate([[0], np.cumsum(last - first - 1)])[names_before]
        shapes = _strings(begins - gone, holed[np.cumsum(inside[:-1], dtype=np.int8) == 0]).dictionary_encode()
        shape = np.asarray(shapes.indices)
        # to learn a shape costs several readings of it: one that comes once is read with its file
        often = np.bincount(shape, minlength=len(shapes.dictionary)) > 1
        forms = [self._form(s) if many or s in self.forms else None for s, many in zip(shapes.dictionary.to_pylist(), often)]
        unread = np.array([f is None for f in forms], bool)[shape] | (sizes > LONGEST)
        bad = np.zeros(len(left), bool)
        bad[file_of[unread]] = True
        # the rows of each form one after the other, and those of each piece
        kinds, templates, flat = list(kinds), {}, []
        size, places = [], []
        for form in forms:
            mine = [] if form is None else [(f, t) for f, t in zip(*form) if f[0] in kinds]
            size.append(len(mine))
            for (kind, line, end), texts in mine:
                flat.append([kinds.index(kind), line, -1 if end is None else end])
                for constants, numbers in texts:
                    flat[-1] += [templates.setdefault(constants, len(templates)), len(places)]
                    places += numbers
        size = np.array(size, np.int64)
        many = np.where(bad[file_of], 0, size[shape])
        piece = np.repeat(np.arange(len(shape)), many)
        nth = np.arange(len(piece)) - np.repeat(np.cumsum(many) - many, many)
        row = np.array(flat, np.int64).reshape(-1, 11)[(np.cumsum(size) - size)[shape[piece]] + nth]
        file_begins = np.concatenate([[0], np.cumsum([len(contents[n]) for n in left])])
        line_ends = np.flatnonzero(text == ord("\n"))
        above = (np.searchsorted(line_ends, begins[:-1]) - np.searchsorted(line_ends, file_begins)[file_of])[piece]
        name_at, places, constants = names_before[piece], np.array(places, np.int64), list(templates)

        def filled(template: np.ndarray, place: np.ndarray) -> pa.Array:
            found, order = [pa.array([], pa.string())], []
            for t in np.unique(template):
                these = np.flatnonzero(template == t)
                order.append(these)
                parts = [pa.scalar(constants[t][0])]
                for k, constant in enumerate(constants[t][1:]):
                    parts += [names.take(pa.array(name_at[these] + places[place[these] + k])), pa.scalar(constant)]
                parts = [p for p in parts if not isinstance(p, pa.Scalar) or p.as_py()]
                one = isinstance(parts[0], pa.Scalar) if parts else True
                if len(parts) > 1:
                    found.append(pc.binary_join_element_wise(*parts, ""))
                else:
                    found.append(pa.repeat(parts[0] if parts else pa.scalar(""), len(these)) if one else parts[0])
            return pa.concat_arrays(found).take(pa.array(np.argsort(np.concatenate([np.zeros(0, np.int64), *order]), kind="stable")))

        kind = pa.array(kinds, pa.string()).take(pa.array(row[:, 0]))
        end = pa.array((row[:, 2] + above).astype(np.int32), mask=row[:, 2] < 0)
        columns = [kind, pa.array((row[:, 1] + above).astype(np.int32)), end, *(filled(row[:, k], row[:, k + 1]) for k in (3, 5, 7, 9))]
        numbers = np.array(left, np.int64)
        return sorted([*whole, *numbers[bad].tolist()]), numbers[file_of[piece]], columns


def no_python(content: str) -> bool:
    """Whether the first line, a statement of its own whatever follows, does not parse: the parser would look through the rest of the file."""
    first = content.split("\n", 1)[0]
    if not first.isascii() or OPEN.search(first):
        return False
    try:
        ast.parse(first)
    except (SyntaxError, ValueError, MemoryError, RecursionError):
        return True
    return False


def _strings(borders: np.ndarray, text: np.ndarray) -> pa.Array:
    """The parts of a text between borders that follow each other."""
    return pa.StringArray.from_buffers(len(borders) - 1, pa.py_buffer(borders.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(text)))


#: What may go on after a line of Python.
OPEN = re.compile(r"""[(\[{"'\\@:\r\f\0]""")
#: Python: a line with the decorators above it, and all up to the next line that starts with a letter or `@` and is no further clause.
python_pieces = re.compile(r"(?:@[^\n]*\n)*[^\n]*(?:\n(?:(?![A-Za-z_@])|(?=(?:else|elif|except|finally)\b))[^\n]*)*\n?").findall
PYTHON_NAMES = names_but([*keyword.kwlist, *keyword.softkwlist], "A-Za-z_")
#: Strings and escapes may hold anything, a point after a digit is one of a number, \r and \f are ends of lines to some.
PYTHON_ODD = [re.compile(x) for x in (r"""["'\\\r\f\0]""", r"[0-9](?<![A-Za-z_0-9][0-9])[0-9_]*\.[A-Za-z_]", r"Q[0-9]+Q", "barry_as_FLUFL")]

#: Scripts: up to a line that ends a statement or block, and is followed by one that starts with a letter.
script_pieces = re.compile(r"(?<=[;}]\n)(?=[A-Za-z_$])").split
SCRIPT_WORDS = {*MODIFIERS, *CLASS_WORDS, *FUNCTION_WORDS, *VARIABLE_WORDS, *NO_CALLS, *NOT_A_TYPE, *METHOD_WORDS, *"export from as type require import".split()}
SCRIPT_NAMES = names_but(SCRIPT_WORDS, "A-Za-z_$")
#: Files with escapes, strings over lines or comments are read as a whole.
SCRIPT_ODD = [re.compile(x) for x in (r"[\\`\r\f\0]", r"[0-9](?<![A-Za-z_$0-9][0-9])[0-9A-Za-z_]*[.$]", r"/[/*]", r"Q[0-9]+Q")]

#: What may stand after a piece of a script, and change what a piece that is open in some way says.
AFTER = ("}" * 1000, "{ }", ";", 'from "x";')


def stands_alone(text: str, rows: Callable[[str], list[Row]]) -> list[Row] | None:
    """The rows of a piece of a script; None if they change with what comes after it, or change that."""
    text += "" if text.endswith("\n") else "\n"
    found, n = rows(text), text.count("\n")
    if any([r for r in rows(f"{text}{after}\n") if r[1] <= n] != found for after in AFTER):
        return None
    next_one = [("symbol", n + 1, n + 2, "probe", "probe", "function"), ("call beside", n + 1, None, "probe", "probe", "probe")]
    return found if rows(text + "function probe() {\n}\n") == found + next_one else None
