"""Facts from PHP source: tokens and units, by a lexer that runs over batches of files.

The lexer knows comments, strings, heredocs, attributes and inline HTML, and follows braces, so that each
token carries the class and the function or method that owns it, how deep control structures nest there,
and how many of them are loops. Texts are cut by one pattern, numbered, and all that follows from their order alone (neighbours,
open brackets, ends, counts) is computed by column over many files at once; only what may change a token's owner
is followed one by one. It is not a parser: facts that need types or expression trees are not derived here. A file that
ends inside a comment, string or block is reported with ``parse_error`` and still gives its tokens.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from brindle.session import ship

TOKENS = (
    "path string, n int, kind string, text string, line int, class_name string, unit string, unit_line int, nest int, loop int, "
    # what stands before and after it (the second and third with those sorts alone that are asked for them), brackets that are
    # open before it, statements' and blocks' ends and semicolons up to it
    "b1 string, b2 string, b3 string, a1 string, a2 string, a3 string, paren int, brace int, stops int, semis int, "
    # in a function's list of parameters: the place of its ``function``, the parameter's number, and brackets open within the list
    "params_of int, arg int, arg_depth int, "
    # names: that of a trait that a class uses; the place of the ``implements`` that lists it; first of its short name in the file
    "used boolean, heir int, fresh boolean, "
    # a catch: tokens of its block, and those of them that act
    "held int, held_acts int, "
    # a ternary's sign: its part of the brackets around, the bracket and what stands before it, and what follows the closing one
    "part int, opened string, opened_after string, closed_before string, "
    # semicolons of its unit; the first token of a unit has the unit's other measures
    "statements int, unit_end int, complexity int, deepest int, unit_tokens int, "
    # what may ask for it, by its place in SORTS, and whether a detector asks for it in a row of its own
    "sort int, asked boolean"
)

# signs that nothing longer begins with come early
_PATTERN = r"""\s+
    |[(){};,\[\]]
    |[A-Za-z_][\w\x80-\uffff]*(?:\\[A-Za-z_\x80-\uffff][\w\x80-\uffff]*)*
    |\$+\w+
    |\?>(?:.*?<\?(?:php\b|=)|.*)
    |//(?:(?!\?>)[^\n])*|\#(?!\[)(?:(?!\?>)[^\n])*|/\*.*?(?:\*/|\Z)
    HEREDOC
    |'(?:\\.|[^'\\])*(?:'|\Z)|"(?:\\.|[^"\\])*(?:"|\Z)|`(?:\\.|[^`\\])*(?:`|\Z)
    |\d[\w.]*
    |\\?[A-Za-z_\x80-\uffff][\w\x80-\uffff]*(?:\\[A-Za-z_\x80-\uffff][\w\x80-\uffff]*)*
    |\#\[|<=>|\*\*=|\.\.\.|\?\?=|\?->|<<=|>>=|===|!==|->|=>|::|\+\+|--|&&|\|\||\?\?|[-+*/%.&|^<>!=]=|<<|>>|."""
_HEREDOC = r"""|<<<[ \t]*(?P<q>["']?)(?P<tag>[A-Za-z_]\w*)(?P=q)\r?\n.*?\n?[ \t]*(?P=tag)\b"""
#: The texts of a source, space and inline HTML included; what a text is, it tells itself. Without groups, which only
#: sources with heredocs need, all of them come at once.
_TEXTS = re.compile(_PATTERN.replace("HEREDOC", ""), re.S | re.X)
_TEXTS_HEREDOC = re.compile(_PATTERN.replace("HEREDOC", _HEREDOC), re.S | re.X)
_OPEN = re.compile(r"<\?(?:php\b|=)")
# Words that open a control structure, and those that name a class-like declaration.
CONTROL = {"if", "elseif", "else", "for", "foreach", "while", "do", "switch", "match", "try", "catch", "finally"}
LOOPS = {"for", "foreach", "while", "do"}
CLASS_LIKE = {"class", "interface", "trait", "enum"}
BRANCHES = {"if", "elseif", "for", "foreach", "while", "case", "catch"}
#: Words before parentheses that call nothing.
NO_CALLS = {"if", "elseif", "while", "for", "foreach", "switch", "match", "catch", "array", "list", "isset", "unset", "empty", "function", "fn", "return", "echo", "print", "and", "or", "declare", "use"}
#: Words that detectors look up by their text.
WORDS = CLASS_LIKE | {
    "function", "use", "catch", "implements", "namespace", "private", "protected", "public", "readonly",
    "compact", "extract", "__call", "__callstatic", "schema", "foreignid", "foreignidfor", "constrained", "references",
}
#: Words of WORDS that matter by what they leave with others, but for those in a list of parameters.
_SIDES = {"use", "implements", "private", "protected", "public", "readonly"}
_NO_VALUES = {"return", "fn", "function", "static", "private", "protected", "public", "readonly"}
_VALUE, _IDENT = re.compile(r"[\w$'\")\]]|\?->", re.A), re.compile(r"\w+\Z", re.A)
_KINDS = ["space", "close", "comment", "heredoc", "string", "variable", "number", "name", "operator"]
SPACE, CLOSE, COMMENT, HEREDOC, STRING, VARIABLE, NUMBER, NAME, OPERATOR = range(9)
#: Kinds of tokens, with names and operators told apart by what may ask for them: words of WORDS, names before a
#: parenthesis, members, other names; first tokens of units, operators that a detector looks at by themselves, others.
SORTS = [*_KINDS[2:7], "word", "call", "member", "name", "unit", "mark", "sign"]
NAMES = ["word", "call", "member", "name"]


def sorts(*names: str) -> list[int]:
    return [SORTS.index(n) for n in names]


#: Statements of a unit that is no short one.
LONG = 8
#: Characters of files that leave a task together.
TOGETHER = 240_000
# What a text is to the state of the lexer, and other texts by number.
_CLASS, _FUNCTION, _CONTROL, _BEGIN, _END, _STOP = 1, 2, 3, 4, 5, 6
_BRANCH, _NO_CALL, _ACT, _WORD, _IS_VALUE, _IS_IDENT, _PATH, _SIDE = 1, 2, 4, 8, 16, 32, 64, 128


class _Texts(dict):
    """Numbers of texts, with the facts that a text tells by itself: kind, line breaks, steps of parentheses and braces,
    what it is to the lexer's state, marks, and the number of its short name."""

    def __init__(self):
        self.texts, self.facts, self.short = [], [], {}
        self[""]

    def __missing__(self, text: str) -> int:
        n = self[text] = len(self.texts)
        kind = _kind(text)
        if kind == STRING and text[0] == "\0":
            text = text[1]
        event = marks = 0
        if kind == NAME:
            word = text.lower()
            event = _FUNCTION if word == "function" else _CLASS if word in CLASS_LIKE else _CONTROL if word in CONTROL else 0
            marks = _BRANCH * (word in BRANCHES) | _NO_CALL * (word in NO_CALLS) | _ACT * (word in ("throw", "echo", "print")) | _WORD * (word in WORDS) | _PATH * ("\\" in text) | _SIDE * (word in _SIDES)
        elif kind == OPERATOR:
            event = {"{": _BEGIN, "}": _END, ";": _STOP}.get(text, 0)
            marks = _BRANCH * (text in ("&&", "||", "??", "?"))
        marks |= _IS_VALUE * bool(_VALUE.match(text) and text.lower() not in _NO_VALUES) | _IS_IDENT * bool(_IDENT.match(text))
        paren = (text in ("(", "[", "#[")) - (text in (")", "]"))
        short = self.short.setdefault(text.rsplit("\\", 1)[-1], len(self.short))
        self.texts.append(text)
        self.facts.append((kind, text.count("\n"), paren, (text == "{") - (text == "}"), event, marks, short))
        return n


def _kind(text: str) -> int:
    c = text[:1]
    if text.isspace():
        return SPACE
    if c == "?" and text[:2] == "?>":
        return CLOSE
    if c == "#" and text != "#[" or text[:2] in ("//", "/*"):
        return COMMENT
    if c == "<" and text[:3] == "<<<":
        return HEREDOC
    if c in ("'", '"', "`") and len(text) > 1 or c == "\0" and len(text) > 1:
        return STRING
    if c == "$" and len(text) > 1:
        return VARIABLE
    if c.isdecimal():
        return NUMBER
    return NAME if c and (c == "_" or "a" <= c.lower() <= "z" and c < "\x80" or "\x80" <= c <= "\uffff" or c == "\\" and len(text) > 1) else OPERATOR


class _States:
    """What owns a token: (class, unit, unit_line, nest, loop) by number, with the numbers of the unit and of the class's own level."""

    def __init__(self):
        self.rows, self.unit_of, self.level_of = [], [], []
        self.units: dict = {}
        self.levels: dict = {}

    def add(self, file: int, class_name, unit, unit_line: int, nest: int, loop: int) -> int:
        self.rows.append((class_name, unit, unit_line, nest, loop))
        self.unit_of.append(-1 if unit is None else self.units.setdefault((file, class_name, unit, unit_line), len(self.units)))
        self.level_of.append(-1 if unit is not None or class_name is None else self.levels.setdefault((file, class_name), len(self.levels)))
        return len(self.rows) - 1


def _follow(events, texts: list[str], states: _States, left: list[int]):
    """Changes of the state by what may change it: (token, event, is name, file, text, text before, line). A change is
    (2 token, state) where the token has the new state already, (2 token + 1, state) where only later ones have it.
    ``left`` gets the files with a block that does not end."""
    at, to = [], []
    state, waiting, blocks, now = 0, None, [], -1
    for i, event, name, file, text, last, here in events:
        if file != now:
            if blocks:
                left.append(now)
            state, waiting, blocks, now = states.add(file, None, None, 0, 0, 0), None, [], file
            at.append(2 * i), to.append(state)
        if name:
            if waiting and waiting[0] in ("class?", "function?"):
                waiting = (waiting[0][:-1], texts[text], waiting[2])  # what next opening brace begins
            elif not event or texts[last] in ("->", "?->", "::"):
                continue
            elif event == _CLASS:
                waiting = ("class", "class@anonymous", here) if texts[last] == "new" else ("class?", None, here)
            elif event == _FUNCTION:
                waiting = waiting if texts[last] == "use" else ("function?", None, here)
            elif not (waiting and waiting[0] == "class"):
                waiting = ("control", texts[text].lower(), here)
        elif event == _BEGIN:
            begins = waiting[0] if waiting else "block"
            blocks.append(state)
            class_name, unit, unit_line, nest, loop = states.rows[state]
            if begins == "class":
                state = states.add(file, waiting[1], None, 0, 0, 0)
            elif begins == "function":
                state = states.add(file, class_name, waiting[1], waiting[2], 0, 0)
            elif begins == "closure":
                state = states.add(file, class_name, unit, unit_line, 0, 0)
            elif begins == "control":
                state = states.add(file, class_name, unit, unit_line, nest + 1, loop + (waiting[1] in LOOPS))
            waiting = None
            at.append(2 * i), to.append(state)
        elif event == _END:
            if blocks:
                state = blocks.pop()
                at.append(2 * i + 1), to.append(state)
        elif event == _STOP:
            if waiting and waiting[0] == "function":  # an abstract method has no body
                at += [2 * i, 2 * i + 1]
                to += [states.add(file, states.rows[state][0], waiting[1], waiting[2], 0, 0), state]
            waiting = None
        elif texts[text] == "(" and waiting and waiting[0] == "function?":
            waiting = ("closure", None, here)
    if blocks:
        left.append(now)
    return at, to


def _first_after(at: np.ndarray, level: np.ndarray, file: np.ndarray, ends: np.ndarray, end_level: np.ndarray) -> np.ndarray:
    """For each of the tokens ``at``, the first of ``ends`` after it in its file and of its level, or -1."""
    if not len(at) or not len(ends):
        return np.full(len(at), -1)
    low = min(level.min(), end_level.min())
    width = len(file) + 1
    keys = (end_level - low).astype(np.int64) * width + ends
    order = np.argsort(keys, kind="stable")
    keys, ends, end_level = keys[order], ends[order], end_level[order]
    k = np.searchsorted(keys, (level - low).astype(np.int64) * width + at, "right")
    found = ends[np.minimum(k, len(ends) - 1)]
    right = (k < len(ends)) & (end_level[np.minimum(k, len(ends) - 1)] == level) & (file[found] == file[at])
    return np.where(right, found, -1)


def _since(marks: np.ndarray) -> np.ndarray:
    """For each place the last marked one up to it, or -1."""
    return np.maximum.accumulate(np.where(marks, np.arange(len(marks)), -1))


def _tokens_of(files: list[tuple[str, str | None]], whole: bool = True) -> tuple[pa.RecordBatch, list[int]]:
    """The rows of TOKENS of some files, by columns, or those of them that are asked for, and the files with a block that
    does not end."""
    texts, numbers, lengths, first_line = _Texts(), [], [], []
    get = texts.__getitem__
    for _, source in files:
        begin = _OPEN.search(source) if source else None
        found = [] if not begin else _TEXTS.findall(source, begin.end()) if "<<<" not in source else [m.group() for m in _TEXTS_HEREDOC.finditer(source, begin.end())]
        if found and found[-1] in ("'", '"', "`"):
            found[-1] = "\0" + found[-1]  # a string that ends with its file; elsewhere a lone quote is an operator
        numbers += map(get, found)
        lengths.append(len(found))
        first_line.append(source.count("\n", 0, begin.end()) + 1 if begin else 1)
    every = np.array(numbers, np.int64)
    kinds, breaks, parens, braces, events, marks, shorts = np.array(texts.facts, np.int64).T
    file = np.repeat(np.arange(len(files)), lengths)

    def running(steps: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Sums up to each place within its file."""
        total = np.cumsum(steps)
        starts = np.searchsorted(of, np.arange(len(files)))
        return total - np.concatenate([[0], total])[starts][of]

    line = running(breaks[every], file) - breaks[every] + np.array(first_line, np.int64)[file]
    keep = kinds[every] >= COMMENT
    w, file, line = every[keep], file[keep], line[keep]
    size, starts = len(w), np.searchsorted(file, np.arange(len(files)))
    n = np.arange(size) - starts[file]
    kind, event = kinds[w], events[w]

    # neighbours, among tokens without comments; ``c`` are their places, text 0 is the empty one
    c = np.flatnonzero(kind != COMMENT)
    cw, cf = w[c], file[c]
    m = len(c)
    near = {}
    for k in (1, 2, 3):
        before, after = np.zeros(m, np.int64), np.zeros(m, np.int64)
        if m > k:
            same = cf[k:] == cf[:-k]
            before[k:], after[:-k] = np.where(same, cw[:-k], 0), np.where(same, cw[k:], 0)
        near[f"b{k}"], near[f"a{k}"] = before, after
    b1, a1, a2 = near["b1"], near["a1"], near["a2"]
    number = lambda text: texts.get(text, -1)
    are = lambda x, *some: np.isin(x, [number(s) for s in some])
    ckind, cmarks = kinds[cw], marks[cw]
    is_name, is_sign = ckind == NAME, ckind == OPERATOR
    arrow = are(b1, "->", "?->", "::")
    step_p, step_b = np.where(is_sign, parens[cw], 0), np.where(is_sign, braces[cw], 0)
    paren, brace = running(step_p, cf) - step_p, running(step_b, cf) - step_b
    semi = are(cw, ";")
    stops, semis = running(semi | (step_b != 0), cf), running(semi, cf)
    low = {}
    for word in ("function", "catch", "implements", "use", "interface"):
        low[word] = np.array([t.lower() == word for t in texts.texts])

    # the state: only what may change it is followed one by one
    plain = np.where(are(cw, "#["), 0, step_p)
    open_ = running(plain, cf)
    wide = 2 * size + 2  # files lie apart, so that none sees another one's least sum
    open_ = open_ - np.minimum.accumulate(np.minimum(open_, 0) - wide * cf) - wide * cf
    heads = np.flatnonzero(is_name & np.isin(events[cw], (_CLASS, _FUNCTION)))
    names, rounds = np.flatnonzero(is_name), np.flatnonzero(are(cw, "("))
    turns = np.isin(events[cw], (_CLASS, _FUNCTION, _CONTROL, _BEGIN, _END)) | ((events[cw] == _STOP) & (open_ == 0))
    for others, of in ((names, heads), (rounds, heads)):
        k = np.searchsorted(others, of, "right")
        turns[others[k[k < len(others)]]] = True
    turns[np.flatnonzero(np.diff(cf, prepend=-1))] = True
    t = np.flatnonzero(turns)
    states, left = _States(), []
    rows = zip(c[t].tolist(), events[cw[t]].tolist(), is_name[t].tolist(), cf[t].tolist(), cw[t].tolist(), b1[t].tolist(), line[c[t]].tolist())
    at, to = _follow(rows, texts.texts, states, left)
    none = states.add(-1, None, None, 0, 0, 0)
    edges = np.flatnonzero(np.diff(file, prepend=-1))
    # comments before the first other token of a file have no owner
    at, to = np.concatenate([2 * edges, at]).astype(np.int64), np.concatenate([np.full(len(edges), none), to]).astype(np.int64)
    order = np.argsort(at, kind="stable")
    at, to = (at[order] + 1) // 2, to[order]
    state = np.repeat(to, np.diff(np.append(at, size))) if size else np.zeros(0, np.int64)
    owner = list(zip(*states.rows))
    nest = np.array(owner[3], np.int64)[state]

    # units: their first tokens carry their measures
    unit = np.array(states.unit_of, np.int64)[state][c]
    u = np.flatnonzero(unit >= 0)
    of_unit, total = unit[u], len(states.units)
    counted = lambda flag: np.bincount(of_unit, flag[u].astype(float), total).astype(np.int64)
    statements = counted(semi)
    opener, last, deepest = np.full(total, -1), np.zeros(total, np.int64), np.zeros(total, np.int64)
    opener[of_unit[::-1]] = u[::-1]
    last[of_unit] = u
    np.maximum.at(deepest, of_unit, nest[c][u])
    complexity = 1 + counted(((cmarks & _BRANCH) > 0) & (is_name | is_sign))
    opener_of = opener[opener >= 0]
    of_opener = unit[opener_of]

    # parameters: of the last function before that has a list, up to its end
    head = low["function"][cw] & ((marks[a1] & _IS_IDENT) > 0) & are(a2, "(") & ~are(b1, "->", "::", "use")
    closes = np.flatnonzero(is_sign & are(cw, ")"))
    tails = np.flatnonzero(is_sign & are(cw, "}"))

    def spans(heads: np.ndarray, depth: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each token the last head before it whose bracket closes, or -1, and whether it lies before that end."""
        h = np.flatnonzero(heads)
        end = np.full(m, -1)
        end[h] = _first_after(h, depth[h], cf, ends, depth[ends] - 1)
        own = _since(end >= 0)
        safe = np.maximum(own, 0)
        return own, (own >= 0) & (cf[safe] == cf) & (np.arange(m) > own) & (np.arange(m) < end[safe])

    own, inside = spans(head, paren, closes)
    own = np.maximum(own, 0)
    inside &= paren > paren[own]
    commas = np.cumsum(inside & is_sign & are(cw, ",") & (paren == paren[own] + 1))
    arg = commas - commas[own] if m else commas
    face, listed = spans(low["implements"][cw], brace, tails)
    face = np.maximum(face, 0)
    listed &= is_name & (brace == brace[face])

    # traits: names between a ``use`` of a class's own level and the end of the statement
    level = np.array(states.level_of, np.int64)[state][c]
    used = np.zeros(m, bool)
    uses = is_name & low["use"][cw]
    if (some := np.flatnonzero(np.isin(level, np.unique(level[uses & (level >= 0)])))).size:
        some = some[np.argsort(level[some], kind="stable")]
        mark = _since(uses[some] | are(cw[some], ";", "{", "}"))
        safe = np.maximum(mark, 0)
        used[some] = (mark >= 0) & (level[some][safe] == level[some]) & uses[some][safe]
    used &= is_name & ~uses
    fresh = np.zeros(m, bool)
    named = np.flatnonzero(is_name & ~low["interface"][b1])
    fresh[named[np.unique(cf[named] * len(texts.short) + shorts[cw[named]], return_index=True)[1]]] = True

    # catches: what their block holds is the difference of running counts at its ends
    acts = np.cumsum(is_name & (((cmarks & _ACT) > 0) | (are(a1, "(") & ((cmarks & _NO_CALL) == 0)) | (are(b1, "->", "::") & are(a1, "="))))
    caught = np.flatnonzero(is_name & low["catch"][cw] & are(a1, "("))
    begins = np.flatnonzero(is_sign & are(cw, "{"))
    begin, end = _first_after(caught, brace[caught], cf, begins, brace[begins]), _first_after(caught, brace[caught], cf, tails, brace[tails] - 1)
    ended = (begin >= 0) & (end >= 0)
    caught, begin, end = caught[ended], begin[ended], end[ended]

    # ternaries: the parts of the brackets around, in files that have some
    asks = is_sign & are(cw, "?") & ((marks[b1] & _IS_VALUE) > 0) & ~are(a1, ":")
    opens, shuts = is_sign & are(cw, "(", "["), is_sign & are(cw, ")", "]")
    cuts = opens | (is_sign & are(cw, ",", "=>", ";", "{", "}"))
    has = np.zeros(len(files), bool)
    has[cf[asks]] = True
    some = np.flatnonzero((asks | shuts | cuts) & has[cf])
    depth = paren[some] + opens[some]
    key = cf[some] * wide + depth + size
    order = np.argsort(key, kind="stable")
    some, key = some[order], key[order]
    part, opened = np.cumsum(cuts[some]), _since(opens[some])
    shut = len(some) - 1 - _since(shuts[some][::-1])[::-1]
    a = np.flatnonzero(asks[some])
    opened, shut = opened[a], shut[a]
    opened_ok = (opened >= 0) & (key[np.maximum(opened, 0)] == key[a])
    shut_ok = (shut < len(some)) & (key[np.minimum(shut, len(some) - 1)] == key[a])
    asked, opened, shut = some[a], some[np.maximum(opened, 0)], some[np.minimum(shut, len(some) - 1)]

    sort = np.select([(cmarks & _WORD > 0) & is_name, is_name & are(a1, "("), is_name & arrow, is_name], sorts(*NAMES), np.where(is_sign, SORTS.index("sign"), ckind - COMMENT))
    sort[is_sign & (asks | (are(a1, "::") & are(a2, "class")))] = SORTS.index("mark")
    sort[opener_of] = SORTS.index("unit")

    asked_by = lambda *names: np.isin(sort, sorts(*names))
    every_one, far = np.ones(m, bool), asked_by("word", "call")
    kept = {"b1": every_one, "b2": far | asked_by("member", "variable", "string"), "b3": far | asked_by("string"), "a1": every_one, "a2": far | are(a1, "::"), "a3": far}
    vocabulary = pa.array(texts.texts, pa.string())

    def column(values: np.ndarray, places: np.ndarray, kind: pa.DataType = pa.int32()) -> pa.Array:
        """Values at some places, null at others."""
        full, null = np.zeros(size, values.dtype), np.ones(size, bool)
        full[places], null[places] = values, False
        return pa.array(full[out], mask=null[out]).cast(kind)

    text_at = lambda values, places: vocabulary.take(column(values, places))
    by_state = lambda k, kind: pa.array(owner[k], kind).take(pa.array(state[out]))
    taken = lambda values, at: values.take(pa.array(at[out]))
    in_list, in_heir = inside, listed
    inside, listed, with_unit = np.flatnonzero(inside), np.flatnonzero(listed), np.flatnonzero(unit >= 0)
    all_sorts = np.zeros(size, np.int32)  # comments
    all_sorts[c] = sort
    # others than these stand in the columns of those; of long units all are compared
    aside = asked_by("sign", "name", "variable") | ((cmarks & _SIDE) > 0)
    near_call = asked_by("variable", "word") & (arrow | are(a1, "("))
    asked_for = np.ones(size, bool)
    asked_for[c] = ~aside | in_list | in_heir | used | fresh | near_call | are(a1, "::") | ((cmarks & _PATH) > 0)
    asked_for[c[with_unit]] |= statements[unit[with_unit]] >= LONG
    out = np.arange(size) if whole else np.flatnonzero(asked_for)
    arrays = [
        taken(pa.array([p for p, _ in files], pa.string()), file), pa.array(n[out]).cast(pa.int32()), taken(pa.array(_KINDS), kind), taken(vocabulary, w), pa.array(line[out]).cast(pa.int32()),
        by_state(0, pa.string()), by_state(1, pa.string()), by_state(2, pa.int32()), by_state(3, pa.int32()), by_state(4, pa.int32()),
        *[text_at(near[k][of], c[of]) for k, of in kept.items()], column(paren, c), column(brace, c), column(stops, c), column(semis, c),
        column(n[c[own[inside]]], c[inside]), column(arg[inside], c[inside]), column((paren - paren[own] - 1)[inside], c[inside]),
        column(used, c, pa.bool_()), column(n[c[face[listed]]], c[listed]), column(fresh, c, pa.bool_()),
        column(end - begin - 1, c[caught]), column(acts[end] - acts[begin], c[caught]),
        column(part[a], c[asked]), text_at(cw[opened[opened_ok]], c[asked[opened_ok]]), text_at(b1[opened[opened_ok]], c[asked[opened_ok]]), text_at(a1[shut[shut_ok]], c[asked[shut_ok]]),
        column(statements[unit[with_unit]], c[with_unit]), column(line[c[last[of_opener]]], c[opener_of]), column(complexity[of_opener], c[opener_of]), column(deepest[of_opener], c[opener_of]),
        column(counted(np.ones(m, bool))[of_opener], c[opener_of]), pa.array(all_sorts[out]), pa.array(asked_for[out]),
    ]
    return pa.RecordBatch.from_arrays(arrays, _COLUMNS), left


_COLUMNS = [c.split()[0] for c in TOKENS.split(", ")]


def lex(source: str) -> tuple[list[tuple], str | None]:
    """(kind, text, line, class, unit, unit_line, nest, loop) of each token that is not space, and an error."""
    rows, left = _tokens_of([("", source)])
    out = list(zip(*[rows.column(c).to_pylist() for c in ("kind", "text", "line", "class_name", "unit", "unit_line", "nest", "loop")]))
    torn = [r[2] for r in out if r[0] == "comment" and r[1].startswith("/*") and not r[1].endswith("*/")]
    return out, f"comment from line {torn[-1]} does not end" if torn else "a block does not end" if left else None


def tokens(files: DataFrame, whole: bool = True) -> DataFrame:
    """(path, source) -> one row a token. Each file is read once; a null source has no tokens. A path names one file. Unless
    all are wanted, tokens that matter only by what they leave with others (most signs) do not leave the lexer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some: list[tuple] = []
        held = 0
        for batch in batches:
            for path, source in zip(batch.column("path").to_pylist(), batch.column("source").to_pylist()):
                some.append((path, source))
                held += len(source or "")
                if held >= TOGETHER:
                    yield _tokens_of(some, whole)[0]
                    some, held = [], 0
        if some:
            yield _tokens_of(some, whole)[0]

    ship(files.sparkSession)
    return files.select("path", "source").mapInArrow(run, TOKENS)


def units(rows: DataFrame) -> DataFrame:
    """Functions and methods with their measures, which the lexer leaves at their first tokens.

    Complexity is 1 and one more for each branch, loop, case, catch and short circuit; statements are
    closed by a semicolon; nesting is the deepest control structure.
    """
    return rows.where(F.col("sort").isin(sorts("unit"))).select(
        "path", "class_name", "unit", "unit_line", F.col("unit_end").alias("end_line"), "complexity", "statements", F.col("deepest").alias("nesting"), F.col("unit_tokens").alias("n_tokens")
    )


def deep_nesting(measured: DataFrame, most: int = 4) -> DataFrame:
    """Units whose control structures nest deeper than allowed."""
    confidence = F.least(F.lit(95), 70 + 8 * (F.col("nesting") - most))
    return _finding(measured.where(F.col("nesting") > most), "SL103", "medium", confidence, F.concat(F.lit("nesting depth "), F.col("nesting").cast("string")))


def unexplained_suppressions(rows: DataFrame) -> DataFrame:
    """Suppression comments of analysers without a reason after the identifiers."""
    marks = r"@(?:phpstan-ignore(?:-line|-next-line)?|psalm-suppress|phpcs:ignore)|phpcs:ignore"
    text = F.regexp_replace(F.col("text"), r"^(//|#|/\*+)|\*/$", "")
    reason = F.regexp_replace(F.regexp_extract(text, rf"(?s)(?:{marks})(.*)", 1), r"[A-Za-z]+(?:\.[A-Za-z]+)+|[A-Z]\w+|[(),:*-]", " ")
    found = rows.where((F.col("kind") == "comment") & F.col("text").rlike(marks) & ~reason.rlike(r"\w"))
    return _finding(found.withColumn("unit_line", F.col("line")).withColumn("end_line", F.col("line")), "SL501", "medium", F.lit(90), F.lit("suppression without a reason"))


def _finding(rows: DataFrame, rule: str, severity: str, confidence, message) -> DataFrame:
    name = F.concat_ws("::", "class_name", "unit")
    return rows.select(
        F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), confidence.cast("int").alias("confidence"), "path",
        F.col("unit_line").cast("long").alias("line"), F.col("end_line").cast("long").alias("end_line"), message.alias("message"), name.alias("fingerprint"),
    )
