"""Tokens and top-level declarations of JavaScript and TypeScript sources, in plain Python.

One pass over the text keeps a stack of modes (code in braces, template strings, markup tags and markup children), so strings,
comments, regular expressions and nested templates never look like code. Markup is recognised only where an expression can
start. Within brackets, whose tokens no declaration needs, one pattern takes all tokens up to the next bracket at once. Known gaps: code that doesn't parse, and declarations inside namespaces (they aren't top-level).
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field
from typing import NamedTuple


class Token(NamedTuple):
    kind: str  # id, num, str, template, regex, punct, end
    text: str
    start: int
    end: int
    depth: int


@dataclass
class Symbol:
    name: str
    what: str  # function, class, interface, type, variable
    exported: bool
    start: int
    end: int
    base: str = ""
    init: str = "none"  # none, function, call, other
    callee: str = ""


@dataclass
class Module:
    symbols: list[Symbol] = field(default_factory=list)
    imports: list[tuple[str, int]] = field(default_factory=list)  # specifier, offset: static imports
    exports: list[tuple[str, int]] = field(default_factory=list)  # re-exports
    dynamic: list[tuple[str, int]] = field(default_factory=list)
    names: list[tuple[str, str]] = field(default_factory=list)  # local name, specifier
    tags: list[tuple[str, int]] = field(default_factory=list)  # markup tag, offset: opening ones, then self-closing ones


_SKIP = r"\s*+(?>(?>//[^\n]*+|/\*(?>(?s:.*?)\*/|(?s:.*))|\ufeff)\s*+)*+"  # blanks and comments
_WORD = r"[A-Za-z_$\u0080-\U0010ffff][\w$\u0080-\U0010ffff]*+|#[A-Za-z_$][\w$]*+"
_NUMBER = r"\d[\w.]*+|\.\d[\w.]*+"
_DOUBLE, _SINGLE = (rf"{q}((?>[^{q}\\\n]|\\(?s:.)?)*+)[{q}\n]?" for q in "\"'")
_SIGNS = ";,>+*%&|^!~?:=.@#-"
_OPERATOR = rf"[;,:](?![>=])|\.(?!\.\.)|\.\.\.|=(?:>|==?)?|>>>=|>>=|>=|!==?|[*]{{2}}=?|&&=?|[|]{{2}}=?|\?\?=?|\?\.(?!\d)|\+\+|--|[+*%-]=|[{_SIGNS}]"
_LESS = r"<<=|<=|<<|<"
_WORDS, _NUMBERS, _DOUBLES, _SINGLES, _OPERATORS, _OPEN, _CLOSE, _TICK, _SLASH, _LESSES = range(1, 11)
_ONE = re.compile(rf"{_SKIP}(?:({_WORD})|({_NUMBER})|{_DOUBLE}|{_SINGLE}|({_OPERATOR})|([({{\[])|([)}}\]])|(`)|(/=?)|({_LESS})|(?s:.))")
_QUOTED = "|".join(rf"{q}(?>[^{q}\\\n]|\\(?s:.)?)*+[{q}\n]?" for q in "\"'")


def _run(stops: str) -> re.Pattern:
    """Whatever starts no comment, regular expression, template or markup, with whole brackets of up to two levels in it. A
    bracket that may be an import's isn't taken."""
    plain = rf"[^\"'`/()\[\]{{}}{stops}]++|{_QUOTED}"
    opening = r"(?:[\[{]|(?<!import)(?<!import\s)(?<!\s\s)\()"
    inner = rf"{opening}(?>{plain})*+[)\]}}]"
    return re.compile(rf"(?>{plain}|{opening}(?>{plain}|{inner})*+[)\]}}])*+")


_RUN, _RUN_MARKUP = _run(""), _run("<")
_LAST_WORD = re.compile(r"[\w$\u0080-\U0010ffff]+\Z")
_IMPORT_LAST = re.compile(r"(?:^|[^\w$.]|\.\.\.)import\Z")
_COMMENT = re.compile(r"//[^\n]*+|/\*(?>(?s:.*?)\*/|(?s:.*))")
_CALLED = re.compile(rf"{_SKIP}\({_SKIP}(?:{_DOUBLE}|{_SINGLE})")
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
_TAG = re.compile(r"<\s*([A-Za-z_$][\w$]*(?:[.:-][A-Za-z_$][\w$-]*)*)")
_TYPE_ARGUMENTS = re.compile(r"\s*(,|extends\s|=[^=>]{0,60}>\s*\()")
_IN_TEMPLATE = re.compile(r"(?>[^\\`$]|\\(?s:.)?|\$(?!\{))*+")
_IN_CHILDREN, _IN_TAG = re.compile(r"[^{<]*+"), re.compile(r"(?>[^\"'{/><]|/(?!>))*+")
_VALUE_WORDS = frozenset("return case default typeof instanceof in of new delete void throw await yield do else extends".split())
_OPENS = frozenset("([{")


class Tokens(list):
    """The tokens outside all brackets, and those in the lists of names of imports and exports. What stands in other
    brackets is only read for its extent, its markup tags and its dynamic imports."""

    def __init__(self):
        super().__init__()
        self.closing: dict[int, int] = {}  # place of an opening bracket: place of the one that closes it
        self.opened: list[tuple[str, int]] = []  # markup tags
        self.closed: list[tuple[str, int]] = []  # those that close themselves
        self.dynamic: list[tuple[str, int]] = []


def _ending(passed: str) -> tuple[bool, str]:
    """(whether an operand has ended, the last word or sign) after a text that doesn't end in a blank."""
    c = passed[-1]
    if c in ")]\"'`":
        return True, ""
    if word := _LAST_WORD.search(passed[-11:]):  # as long as the longest of the words that matter, and one more
        return word[0] not in _VALUE_WORDS, word[0]
    return passed.endswith(("++", "--")) or (c == "." and passed[-2:-1].isdigit()), c


def tokenize(text: str, markup: bool) -> Tokens:
    out = Tokens()
    modes: list[list] = [["code", 0]]  # what, and for code the number of open braces
    brackets: list[int] = []  # places of the open ones, -1 if not kept
    run = _RUN_MARKUP if markup else _RUN
    n = len(text)
    i = max(text.find("\n"), 0) or n if text.startswith("#!") else 0
    kept = True  # whether tokens are kept here
    operand, last = False, ""  # whether an operand has just ended; the last word or sign

    def emit(kind: str, start: int, end: int, value: str) -> None:
        if kept:
            out.append(Token(kind, value, start, end, len(brackets)))

    def opens(p: str, at: int) -> None:
        nonlocal kept, operand, last
        brackets.append(len(out) if kept else -1)
        if kept:
            out.append(Token("punct", p, at, at + 1, len(brackets) - 1))
            kept = p == "{" and (len(brackets) > 1 or last in ("import", "export", "type", ","))
        operand, last = False, p

    def closes(p: str, at: int) -> None:
        nonlocal kept, operand, last
        place = brackets.pop() if brackets else -1
        kept = kept or place >= 0 or not brackets
        if place >= 0:
            out.closing[place] = len(out)
        emit("punct", at, at + 1, p)
        operand, last = p != "}", p

    def markup_ends(at: int) -> None:
        nonlocal operand, last
        if modes[-1][0] == "code":
            emit("num", at - 1, at, ")")
            operand, last = True, ""

    while i < n:
        mode = modes[-1]
        if mode[0] == "code":
            if not kept:
                at = run.match(text, i).end()
                c = text[at : at + 1]
                if c in ("/", "<", "("):
                    passed = text[i:at].rstrip()
                    if c == "(" and (_IMPORT_LAST.search(passed[-9:]) if passed else last == "import") and (called := _CALLED.match(text, at)):
                        out.dynamic.append((called[called.lastindex], text.rindex("import", 0, at)))
                    if passed:
                        operand, last = _ending(passed)
                    if comment := _COMMENT.match(text, at):
                        i = comment.end()
                        continue
                i = at
            m = _ONE.match(text, i)
            if m is None:
                break
            i, k = m.end(), m.lastindex
            if k is None:
                continue
            start, value = m.start(k), m[k]
            if k == _WORDS:
                if value == "import" and last != "." and (called := _CALLED.match(text, i)):
                    out.dynamic.append((called[called.lastindex], start))
                emit("id", start, i, value)
                operand, last = value not in _VALUE_WORDS, value
            elif k == _OPERATORS:
                emit("punct", start, i, value)
                operand, last = value in ("++", "--"), value
            elif k == _OPEN:
                mode[1] += value == "{"
                opens(value, start)
            elif k == _CLOSE:
                if value == "}" and mode[1] == 0 and len(mode) > 2:
                    modes.pop()
                elif value == "}":
                    mode[1] = max(0, mode[1] - 1)
                closes(value, start)
            elif k == _TICK:
                modes.append(["template", start])
            elif k == _SLASH and not operand and (m := _REGEX.match(text, start)):
                i = m.end()
                emit("regex", start, i, m[0])
                operand, last = True, ""
            elif k == _LESSES and markup and not operand and text.startswith("<>", start):
                modes.append(["children"])
                i = start + 2
            elif k == _LESSES and markup and not operand and (m := _TAG.match(text, start)) and not _TYPE_ARGUMENTS.match(text, m.end(), m.end() + 60):
                modes.append(["tag", m[1], start])
                i = m.end()
            elif k in (_SLASH, _LESSES):
                emit("punct", start, i, value)
                operand, last = False, value
            else:
                quoted = k != _NUMBERS
                emit("str" if quoted else "num", start - quoted, i, value)
                operand, last = True, ""
        elif mode[0] == "template":
            i = _IN_TEMPLATE.match(text, i).end()
            if text.startswith("`", i):
                modes.pop()
                emit("template", mode[1], i + 1, text[mode[1] : i + 1] if kept else "")
                operand, last = True, ""
                i += 1
            elif i < n:
                modes.append(["code", 0, "template"])
                opens("{", i + 1)
                i += 2
        elif mode[0] == "children":
            i = _IN_CHILDREN.match(text, i).end()
            if text.startswith("{", i):
                modes.append(["code", 0, "markup"])
                opens("{", i)
                i += 1
            elif text.startswith("</", i):
                end = text.find(">", i)
                i = n if end < 0 else end + 1
                modes.pop()
                markup_ends(i)
            elif m := _TAG.match(text, i):
                modes.append(["tag", m[1], i])
                i = m.end()
            elif text.startswith("<>", i):
                modes.append(["children"])
                i += 2
            else:
                i += 1
        else:
            i = _IN_TAG.match(text, i).end()
            c = text[i : i + 1]
            if c in ('"', "'"):
                end = text.find(c, i + 1)
                i = n if end < 0 else end + 1
            elif c == "{":
                modes.append(["code", 0, "markup"])
                opens("{", i)
                i += 1
            elif c == "/":
                modes.pop()
                out.closed.append((mode[1], mode[2]))
                i += 2
                markup_ends(i)
            elif c == ">":
                out.opened.append((mode[1], mode[2]))
                mode[:] = ["children"]
                i += 1
            elif c == "<":  # type arguments of a tag
                level = 0
                while i < n:
                    level += {"<": 1, ">": -1}.get(text[i], 0)
                    i += 1
                    if not level:
                        break
    if brackets:  # unclosed ones reach to the end
        end = len(text.rstrip())
        out.append(Token("end", "", end, end, len(brackets)))
    for tags in (out.opened, out.closed):
        tags.sort(key=lambda tag: tag[1])
    return out


def _close(ts: Tokens, i: int) -> int:
    """The place of the bracket that closes the one at i, or the last place."""
    return ts.closing.get(i, len(ts) - 1)


def _angle(ts: Tokens, i: int) -> int:
    """After the type arguments that start at i, if any do."""
    if i < len(ts) and ts[i].text == "<":
        level = 0
        for j in range(i, len(ts)):
            if ts[j].kind == "punct":
                level += {"<": 1, ">": -1}.get(ts[j].text, 0)
                if level <= 0:
                    return j + 1
    return i


def _body_end(ts: Tokens, i: int) -> int:
    """From a function's first parenthesis on: the place of its last token, with a body or without."""
    i = _close(ts, i) + 1
    if i < len(ts) and ts[i].text == ":":
        i += 1
        while i < len(ts):
            if ts[i].text == "{" and ts[i - 1].text not in (":", "|", "&", "=>", "<", ",", "is"):
                break
            if ts[i].text == ";":
                return i
            i = _close(ts, i) + 1 if ts[i].kind == "punct" and ts[i].text in _OPENS else i + 1
    if i < len(ts) and ts[i].text == "{":
        return _close(ts, i)
    return i if i < len(ts) and ts[i].text == ";" else i - 1


def _initializer(text: str, ts: Tokens, a: int, b: int) -> tuple[str, str]:
    """(init kind, callee) of the tokens a..b."""
    if a > b:
        return "none", ""
    i = a + 1 if ts[a].text == "async" and a < b and ts[a + 1].text != "=>" else a
    if ts[i].text == "function":
        return "function", ""
    j = _angle(ts, i)
    if j <= b and ts[j].text == "(":
        k = _close(ts, j) + 1
        if k <= b and ts[k].text == ":":
            while k <= b and ts[k].text != "=>":
                k = _close(ts, k) + 1 if ts[k].text in _OPENS and ts[k].kind == "punct" else k + 1
        if k <= b and ts[k].text == "=>":
            return "function", ""
    if i < b and ts[i].kind == "id" and ts[i + 1].text == "=>":
        return "function", ""
    if ts[b].text != ")" or ts[b].kind != "punct" or ts[i].text in ("new", "await", "typeof", "void", "delete"):
        return "other", ""
    opening, j = None, a
    while j <= b:  # a chain of names, members, indexes and calls
        t = ts[j]
        if t.kind == "punct" and t.text in ("(", "["):
            opening = j if t.text == "(" else opening
            j = _close(ts, j) + 1
        elif t.kind in ("id", "template") or t.text in (".", "?.", "!") or (t.kind == "str" and j == a):
            j += 1
        elif t.text == "<" and _angle(ts, j) <= b and ts[_angle(ts, j)].text == "(":
            j = _angle(ts, j)
        else:
            return "other", ""
    if opening is None or _close(ts, opening) != b:
        return "other", ""
    return "call", text[ts[a].start : ts[opening].start]


def _statement_end(ts: Tokens, i: int) -> int:
    """The place of the last token of the statement that holds i: before a semicolon, or where a new statement must start."""
    starts = {"async", "const", "let", "var", "function", "class", "interface", "export", "import", "if", "for", "while", "return", "enum", "declare", "namespace", "abstract", "type"}
    base = ts[i].depth
    j = i
    while j < len(ts):
        t = ts[j]
        if t.text == ";" and t.kind == "punct" and t.depth == base:
            return j - 1
        if j > i and t.depth == base and t.kind == "id" and t.text in starts and ts[j - 1].text not in ("=", "=>", ",", "|", "&", "(", ".", "?", ":", "async", "return", "<", "extends"):
            return j - 1
        j = _close(ts, j) + 1 if t.kind == "punct" and t.text in _OPENS else j + 1
    return len(ts) - 1


def _import_names(ts: Tokens, i: int, end: int, spec: str, module: Module) -> None:
    """Local names of the clause between import and from."""
    while i < end:
        t = ts[i]
        if t.text == "{":
            close = _close(ts, i)
            part: list[str] = []
            for x in ts[i + 1 : close + 1]:
                if x.text in (",", "}"):
                    part = part[1:] if len(part) > 1 and part[0] == "type" and part[1] != "as" else part
                    if part:
                        module.names.append((part[-1], spec))
                    part = []
                else:
                    part.append(x.text)
            i = close + 1
        elif t.text == "*" and i + 2 < end:
            module.names.append((ts[i + 2].text, spec))
            i += 3
        elif t.kind == "id" and t.text != "from" and not (t.text == "type" and i + 1 < end and ts[i + 1].text not in (",", "from")):
            module.names.append((t.text, spec))
            i += 1
        else:
            i += 1


def scan(text: str, markup: bool) -> Module:
    """Declarations, imports and tags of one source."""
    ts = tokenize(text, markup)
    module = Module(dynamic=ts.dynamic, tags=ts.opened + ts.closed)
    found: dict[str, list[Symbol]] = {k: [] for k in ("function", "class", "interface", "type", "variable")}
    listed: set[str] = set()

    def add(what: str, name: str, exported: bool, a: int, b: int, **more) -> None:
        found[what].append(Symbol(name, what, exported, ts[a].start, ts[min(b, len(ts) - 1)].end, **more))

    i = 0
    while i < len(ts):
        t = ts[i]
        if t.depth:
            i += 1
            continue
        first, exported = i, False
        while i < len(ts) and ts[i].kind == "id" and ts[i].text in ("export", "default", "declare", "abstract", "async") and not (ts[i].text == "async" and (i + 1 >= len(ts) or ts[i + 1].text != "function")):
            exported |= ts[i].text == "export"
            i += 1
        if i >= len(ts):
            break
        t = ts[i]
        nxt = ts[i + 1] if i + 1 < len(ts) else Token("punct", ";", len(text), len(text), 0)
        if exported and t.text in ("*", "{") or (exported and t.text == "type" and nxt.text in ("{", "*")):
            j = i + (t.text == "type")
            if ts[j].text == "{":
                close = _close(ts, j)
                names = [x.text for x in ts[j + 1 : close]]
                after = close + 1
            else:
                names, after = [], j + 1
                while after < len(ts) and ts[after].text not in ("from", ";"):
                    after += 1
            if after + 1 < len(ts) and ts[after].text == "from" and ts[after + 1].kind == "str":
                module.exports.append((ts[after + 1].text, ts[first].start))
                i = after + 2
            else:
                listed.update(n for k, n in enumerate(names) if k == 0 or names[k - 1] in (",", "type"))
                i = after
        elif t.text == "import" and nxt.text not in ("(", "."):
            j = i + 1
            while j < len(ts) and ts[j].kind != "str" and ts[j].text not in (";", "="):
                j = _close(ts, j) + 1 if ts[j].text == "{" else j + 1
            if j < len(ts) and ts[j].kind == "str":
                module.imports.append((ts[j].text, t.start))
                _import_names(ts, i + 1, j, ts[j].text, module)
            i = j + 1
        elif t.text == "function":
            j = i + 1 + (nxt.text == "*")
            name = ts[j].text if j < len(ts) and ts[j].kind == "id" else ""
            k = _angle(ts, j + bool(name))
            end = _body_end(ts, k) if k < len(ts) and ts[k].text == "(" else k
            if name:
                add("function", name, exported, first, end)
            i = end + 1
        elif t.text == "class" or (t.text == "interface" and nxt.kind == "id"):
            name = nxt.text if nxt.kind == "id" and nxt.text not in ("extends", "implements") else ""
            j, base_at, base_end = i + 1, None, None
            while j < len(ts) and ts[j].text != "{":
                if ts[j].text == "extends" and base_at is None:
                    base_at = j + 1
                if ts[j].text == "implements" and base_end is None:
                    base_end = j
                j = _close(ts, j) + 1 if ts[j].kind == "punct" and ts[j].text in _OPENS else j + 1
            end = _close(ts, j) if j < len(ts) else len(ts) - 1
            if name:
                stop = base_end if base_end is not None else j
                base = text[ts[base_at].start : ts[stop - 1].end] if base_at is not None and stop > base_at else ""
                add("class" if t.text == "class" else "interface", name, exported, first, end, base=base)
            i = end + 1
        elif t.text == "type" and nxt.kind == "id" and i + 2 < len(ts) and ts[i + 2].text in ("=", "<"):
            end = _statement_end(ts, i + 2)
            add("type", nxt.text, exported, first, end)
            i = end + 1
        elif t.text in ("const", "let", "var") and nxt.text != "enum" and i + 1 < len(ts):
            end = _statement_end(ts, i + 1)
            j = i + 1
            while j <= end:
                a = j
                if ts[j].text in ("{", "["):
                    close = _close(ts, j)
                    name = text[ts[j].start : ts[close].end]
                    j = close + 1
                else:
                    name = ts[j].text
                    j += 1
                while j <= end and ts[j].text not in ("=", ","):
                    j = max(_angle(ts, j), j + 1) if ts[j].text == "<" else _close(ts, j) + 1 if ts[j].kind == "punct" and ts[j].text in _OPENS else j + 1
                b = j
                if j <= end and ts[j].text == "=":
                    b = j + 1
                    while b <= end and not (ts[b].text == "," and ts[b].kind == "punct"):
                        after = _angle(ts, b) if ts[b].kind == "punct" else b
                        if b < after <= end and ts[after].text == "(":  # type arguments of a call or an arrow function
                            b = after
                        b = _close(ts, b) + 1 if ts[b].kind == "punct" and ts[b].text in _OPENS else b + 1
                init, callee = _initializer(text, ts, j + 1, b - 1) if j <= end and ts[j].text == "=" else ("none", "")
                add("variable", name, exported, a, b - 1, init=init, callee=callee)
                j = b + 1
            i = end + 1
        elif exported and ts[i - 1].text == "default" and t.kind == "id":
            listed.add(t.text)
            i = _statement_end(ts, i) + 1
        else:
            i = i + 1 if t.kind != "punct" or t.text not in _OPENS else _close(ts, i) + 1
    module.symbols = [s for what in found.values() for s in what]
    for s in module.symbols:
        s.exported = s.exported or s.name in listed
    return module


class Lines:
    """Line numbers of offsets."""

    def __init__(self, text: str):
        self.starts = [0] + [m.end() for m in re.finditer("\n", text)]

    def __call__(self, offset: int) -> int:
        return bisect_right(self.starts, offset)
