"""Declarations, imports and tags of sources: constructs by row, and files made of them at random."""

import random

import pytest

from tessera.operators.lexer import scan

BODY = [
    "return total / count / 2;",
    "if (/[)}\"'`]/.test(word)) { return /y{2}/gi; }",
    "send(`to/${box[`in-${place}`]}/${{ a: 1 }.a}`).then((reply) => ({ reply }));",
    'let k = n++ / 2, text = "a)b}" + \'c(\\\'{\';',
    '// say "no" ) }\n',
    "/* } ) ` */ const pick = yes ? left : (a, b) => { return a < b; };",
    "while (low < high) { for (const x of [[1], [2]]) { low += x } }",
]

# statement, then (kind, name, exported) of what it declares, imports, re-exports, dynamic imports, local names; BODY goes into {}
ROWS = [
    ('import Page, { row as line, type Cell } from "./grid";', [], ["./grid"], [], [], ["Page", "line", "Cell"]),
    ("import './paint.css';", [], ["./paint.css"], [], [], []),
    ('export { thing, other as more } from "../far";', [], [], ["../far"], [], []),
    ("export default function Panel<T extends object>(a: T = { x: [1] }): Array<T> { {} }", [("function", "Panel", True)], [], [], [], []),
    ("async function wait(n: number) { {} return import(\"./slow\"); }", [("function", "wait", False)], [], [], ["./slow"], []),
    ("export class Tree extends Plant<Leaf> implements Green { size = 1; grow() { {} } }", [("class", "Tree", True)], [], [], [], []),
    ("interface Shape extends Base { a: string; b?(x: number): void }", [("interface", "Shape", False)], [], [], [], []),
    ("export type Either<X> = X extends string ? { yes: 1 } : Array<{ no: 2 }>;", [("type", "Either", True)], [], [], [], []),
    ("const table = build<Map<string, number>>(() => { {} }, [a, b]), last = 5;", [("variable", "table", False), ("variable", "last", False)], [], [], [], []),
    ("export const run = async <T,>(a: T) => { {} };", [("variable", "run", True)], [], [], [], []),
    ("const note = `from ${ { a: [1] }.a } to ${`in ${deep}`}`, mark = /[/\"']+\\/{/g;", [("variable", "note", False), ("variable", "mark", False)], [], [], [], []),
    ("const { left, right: [first] } = pair;", [("variable", "{ left, right: [first] }", False)], [], [], [], []),
    ('const Soon = lazy(() => import(/* name: "x" */\n  "./soon"));', [("variable", "Soon", False)], [], [], ["./soon"], []),
    ("if (ready) { {} } else { {} }", [], [], [], [], []),
]
MARKUP = [
    ("const Card = () => <Frame kind={size}><Frame.Top {...rest}/> it's {{list.map((x) => <li key={x}>{x / 2}</li>)}} </Frame>;", [("variable", "Card", False)], ["Frame", "li"], ["Frame.Top"]),
    ("function Board() { if (a < b && c > d) { return <><Tile on={() => { {} }} /></>; } return wide ? <A/> : <B>{/* no } */}</B>; }", [("function", "Board", False)], ["B"], ["Tile", "A"]),
]
ORDER = ["function", "class", "interface", "type", "variable"]


def facts(m):
    return [(s.what, s.name, s.exported) for s in m.symbols], [x for x, _ in m.imports], [x for x, _ in m.exports], [x for x, _ in m.dynamic], [x for x, _ in m.names]


@pytest.mark.parametrize("row", ROWS, ids=[r[0][:24] for r in ROWS])
def test_each_construct(row):
    for body in BODY:
        assert facts(scan(row[0].replace("{}", body), False)) == tuple(row[1:])


@pytest.mark.parametrize("row", MARKUP, ids=["children", "fragment"])
def test_markup(row):
    text, declared, opened, closed = row
    for body in BODY:
        m = scan(text.replace("{}", body), True)
        assert facts(m)[0] == declared and [x for x, _ in m.tags] == opened + closed


def test_files_of_many_constructs():
    rnd = random.Random(7)
    for _ in range(300):
        markup = rnd.random() < 0.5
        parts, want, at = [], ([], [], [], [], []), 0
        places, tags = [], ([], [])
        for _ in range(rnd.randint(1, 12)):
            row = rnd.choice(ROWS + (MARKUP if markup else []))
            text = row[0].replace("{}", " ".join(rnd.choices(BODY, k=rnd.randint(0, 3))))
            for k, more in enumerate(row[1:] if len(row) == 6 else (row[1], [], [], [], [])):
                want[k].extend(more)
            if len(row) == 4:
                tags[0].extend(row[2])
                tags[1].extend(row[3])
            places += [(what, name, at, at + len(text)) for what, name, _ in row[1]]
            parts.append(text)
            at += len(text) + 1
        m = scan("\n".join(parts), markup)
        found = facts(m)
        assert found[0] == sorted(want[0], key=lambda s: ORDER.index(s[0])) and found[1:] == want[1:], "\n".join(parts)
        assert [x for x, _ in m.tags] == tags[0] + tags[1]
        for s, (what, name, start, end) in zip(m.symbols, sorted(places, key=lambda s: ORDER.index(s[0])), strict=True):
            assert (s.what, s.name) == (what, name) and start <= s.start < s.end <= end


def test_code_that_breaks_off():
    text = 'export class Half { grow() { return <p>{`a ${b}`} + "c'
    for n in range(len(text) + 1):
        for markup in (False, True):
            m = scan(text[:n], markup)
            assert [s.name for s in m.symbols] in ([], ["H"], ["Ha"], ["Hal"], ["Half"]) and all(s.end <= n for s in m.symbols)
    for odd in ("", "#!/bin/x", "﻿", "}})", "`", "/*", '"\\', "import(", "export", "const", "const a =", "import {", "import { a", "type", "<", "<>", "<a", "class {", "function", "import * as", "const a<b = c(d);"):
        scan(odd, False)
        scan(odd, True)
