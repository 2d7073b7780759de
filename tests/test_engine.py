"""Small source trees made up for these tests, and what an analysis must find in them."""

import json
import random

import pytest

from tessera.functions.scalars import fingerprint
from tessera.operators import architecture, graph, packages, resolve, retrieval, summary
from tessera.operators.lexer import scan
from tessera.plans import evaluate as ev
from tessera.plans.analysis import Options, Runs, narration_context, plan_query, run_analysis, tables
from tessera.plans.report import escape_html, markdown
from tessera.plans.store import Store
from tessera.streaming.events import node_states, progress_label, read_events, run_status
from tests.shared import Shelf

#: folder -> (files, expectations)
TREES = {
    "water": (
        {
            "tsconfig.json": '{"extends": "./etc/paths"} // the rest is there',
            "etc/paths.json": '{"compilerOptions": {"baseUrl": "..", "paths": {"~pump/*": ["plant/pump/*"], "~tank/*": ["plant/tank/*"],}}}',
            "plant/pump/motor.ts": 'import { level } from "~tank/gauge";\nexport const spin = () => level + 1;\n',
            "plant/tank/gauge.ts": 'import { open } from "./valve";\nexport const level = open ? 1 : 0;\n',
            "plant/tank/valve.ts": 'import { spin } from "~pump/motor";\nexport const open = spin() > 0;\n',
        },
        {"cycles": [["plant/tank/valve.ts", "plant/pump/motor.ts", "plant/tank/gauge.ts"]], "metrics": {"dimensionCount": 3}},
    ),
    "garden": (
        {
            "beds/index.ts": 'export * from "./seed";\nexport { grow } from "./grow";\n',
            "beds/seed.ts": 'import { grow } from ".";\nexport const seed = grow;\n',
            "beds/grow.ts": "export function grow() { return 2; }\n",
            "walk.ts": 'import { seed } from "./beds";\nexport const walk = seed;\n',
        },
        {"cycles": [["beds/index.ts", "beds/seed.ts"]], "edges": [{"from": "beds/seed.ts", "kind": "import", "to": "beds/index.ts"}, {"from": "walk.ts", "kind": "import", "to": "beds/index.ts"}]},
    ),
    "desk": (
        {"desk/Lamp.jsx": 'import { watts } from "./plug.js";\nexport function Lamp() { return <em>{watts}</em>; }\n', "desk/plug.js": 'export const watts = 9;\nexport const later = () => import("./Lamp");\n'},
        {"cycles": [["desk/Lamp.jsx", "desk/plug.js"]], "components": ["Lamp"]},
    ),
    "shapes": (
        {"kit/Round.tsx": 'import { Component, forwardRef } from "react";\nexport class Round extends Component<{}> {}\nexport const Square = forwardRef(() => <i/>);\nexport const useSide = () => 4;\nconst Plain = 3;\n'},
        {"components": ["Round", "Square"]},
    ),
    "stage": (
        {"Play.tsx": 'import * as Props from "./props";\nexport const Play = () => <main><Props.Chair/><Props.Table/></main>;\n', "props.tsx": "export const Chair = () => <b/>;\nexport const Table = () => <b/>;\n"},
        {"edges": [{"from": "Play.tsx", "kind": "render", "to": "props.tsx"}, {"from": "Play.tsx", "kind": "import", "to": "props.tsx"}], "components": ["Chair", "Play", "Table"]},
    ),
    "mill": (
        {
            "package.json": '{"dependencies": {"vue": "3.5"}, "devDependencies": {"vite": "6"}}',
            "components/Wheel.tsx": 'import { useFlow } from "../hooks/useFlow";\nexport const Wheel = () => <u>{useFlow()}</u>;\n',
            "hooks/useFlow.ts": 'import { grain } from "../services/grain";\nexport const useFlow = () => grain.length;\n',
            "pages/Mill.tsx": 'import { Wheel } from "../components/Wheel";\nimport { grain } from "../services/grain";\nexport function Mill() { return <p><Wheel/><Wheel/>{grain}</p>; }\n',
            "services/grain.ts": 'import { useFlow } from "../hooks/useFlow";\nimport type { Flow } from "../hooks/useFlow";\nexport const grain = [useFlow];\n',
        },
        {
            "cycles": [["services/grain.ts", "hooks/useFlow.ts"]],
            "narration": {"maxEstimatedTokens": 900, "modules": ["components", "hooks", "pages", "services"], "cycleCuts": [{"from": "hooks/useFlow.ts", "to": "services/grain.ts", "references": 1}]},
        },
    ),
    "bare": ({"notes.txt": "no sources"}, {"metrics": {"score": 0, "dimensionCount": 0}}),
    "rings": (
        {
            "x/east.ts": 'import "./west";\n', "x/west.ts": 'import "./east";\nimport "../tail";\n', "tail.ts": "export {};\n",
            "B/two.ts": 'import "./three";\nimport "./one";\n', "B/one.ts": 'import "./two";\n', "B/three.ts": 'import "./one";\n',
        },
        {"cycles": [["x/east.ts", "x/west.ts"], ["B/one.ts", "B/three.ts", "B/two.ts"]]},
    ),
}


def write(root, files):
    for path, text in files.items():
        p = root / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text if isinstance(text, bytes) else text.encode())
    return root


@pytest.fixture(scope="module")
def trees(tmp_path_factory):
    root = tmp_path_factory.mktemp("trees")
    for name, (files, expect) in TREES.items():
        write(root / name, files | {"expected.json": json.dumps({"status": "expected-pass", "expect": expect})})
    return root


@pytest.fixture(scope="module")
def mill(spark, trees):
    return tables(spark, str(trees / "mill"))


def test_all_trees_in_one_plan(spark, trees):
    found, done = ev.evaluate_all(spark, ev.folders(str(trees)))
    rows = {r["name"]: r["outcome"] for r in found.collect()}
    assert rows == dict.fromkeys(TREES, "PASS"), done.where("not ok").collect()
    n = {r["name"]: r["checks"] for r in found.collect()}
    assert n["mill"] == 7 and n["bare"] == 2 and n["rings"] == 2


def test_one_tree_and_a_missing_fact(spark, trees, tmp_path):
    assert ev.evaluate(spark, str(trees / "desk")) == ("PASS", [("component Lamp", True), ("cycle desk/Lamp.jsx | desk/plug.js", True)])
    write(tmp_path, {"a.ts": "1", "expected.json": json.dumps({"expect": {"components": ["Nobody"], "metrics": {"score": 1}}})})
    assert ev.evaluate(spark, str(tmp_path)) == ("REGRESSION", [("component Nobody", False), ("score", False)])


def test_components_are_in_reading_order(spark, trees):
    a = tables(spark, str(trees / "rings"))
    rows = [(list(r["files"]), list(r["loop"])) for r in a.cycles.orderBy("ordinal").collect()]
    assert rows == [(["B/one.ts", "B/three.ts", "B/two.ts"], ["B/one.ts", "B/two.ts", "B/one.ts"]), (["x/east.ts", "x/west.ts"], ["x/east.ts", "x/west.ts", "x/east.ts"])]
    found = a.findings.where("rule = 'import-cycle'").orderBy("ordinal").collect()
    assert [list(r["evidence"]) for r in found] == [["B/one.ts → B/two.ts → B/one.ts"], ["x/east.ts → x/west.ts → x/east.ts"]]
    assert a.score["dimensions"] == {"complexity": 95, "coupling": 88, "typing": 100}  # seven imports of six files


def test_edges_folders_and_layers(mill):
    wheel, flow, page, grain = "components/Wheel.tsx", "hooks/useFlow.ts", "pages/Mill.tsx", "services/grain.ts"
    edges = [(r["src_path"], r["kind"], r["dst_path"]) for r in architecture.edge_paths(mill.edges, mill.files).orderBy("ordinal").collect()]
    assert edges == [(wheel, "import", flow), (flow, "import", grain), (page, "import", wheel), (page, "import", grain), (page, "render", wheel), (grain, "import", flow), (grain, "import", flow)]
    assert {r["path"]: (r["inbound"], r["outbound"]) for r in mill.directories.collect()} == {"components": (2, 1), "hooks": (3, 1), "pages": (0, 3), "services": (2, 2)}
    assert {r["name"]: list(r["depends_on"]) for r in mill.layers.collect()} == {"pages": ["components", "services"], "components": ["hooks"], "hooks": ["services"], "services": ["hooks"]}
    assert [r["path"] for r in summary.hotspots(mill.files, mill.edges).orderBy("ordinal").collect()] == [flow, grain, wheel, page]
    assert [(r["src"], r["dst"]) for r in architecture.component_topology(mill.files, mill.symbols, mill.edges).collect()] == [(page, wheel)] * 2
    lines = [r["line"] for r in architecture.layer_mermaid(mill.layers).orderBy("line_no").collect()]
    assert lines[0] == "graph TD" and lines[-1] == "  services --> hooks" and '  hooks["hooks"]' in lines
    assert mill.stack["framework"] == "Vue" and mill.stack["buildTool"] == "Vite" and mill.stack["frameworkVersion"] == "3.5"


def test_summaries_are_bounded_and_say_what_they_leave_out(mill):
    whole = narration_context(mill)
    assert whole["scale"] == {"files": 4, "symbols": 4, "components": 2, "edges": 7} and set(whole["truncated"].values()) == {0}
    few = mill.contexts(summary.Limits(modules=1, hotspots=2, cycles=0, cycle_files=1)).first()["context"]
    assert few["truncated"].asDict() == {"modules": 3, "hotspots": 2, "cycles": 1, "findingRules": 0}
    assert [h["path"] for h in few["hotspots"]] == ["hooks/useFlow.ts", "services/grain.ts"] and few["cycles"] == []
    one = mill.contexts(summary.Limits(cycle_files=1)).first()["context"]["cycles"][0]
    assert list(one["files"]) == ["hooks/useFlow.ts"] and one["totalFiles"] == 2 and one["suggestedCut"]["references"] == 1


def test_retrieval_of_one_question(spark, mill):
    plan = plan_query(spark, "grain Hook", None)
    assert plan == {"concepts": ["grain", "hook"], "symbol_kinds": ["hook"], "relation_kinds": ["import", "call", "render", "uses-hook", "uses-store"], "terms": ["grain", "hook"]}
    found = [(r["path"], r["symbol"], r["score"]) for r in retrieval.retrieve(plan, mill.files, mill.symbols, mill.edges, mill.contents).collect()]
    assert found == [("services/grain.ts", None, 30), ("hooks/useFlow.ts", None, 25), ("pages/Mill.tsx", None, 25), ("components/Wheel.tsx", None, 15)]


def test_plans_of_questions(spark):
    p = plan_query(spark, "查找购物车组件 addItem", None)
    assert p["symbol_kinds"] == ["component"] and p["concepts"][:3] == ["cart", "basket", "shopping"] and "additem" in p["terms"] and "组件" not in p["terms"]
    assert plan_query(spark, "权限", lambda q: 1 / 0)["concepts"][0] == "permission"
    assert plan_query(spark, "x", lambda q: {"concepts": [q]}) == {"concepts": ["x"]}


def test_workspaces_resolve_by_links_and_exports(spark, tmp_path):
    root, far = tmp_path / "repo", tmp_path / "sibling"
    write(far, {"package.json": '{"name": "@lab/far", "exports": {"./*": "./*.ts"}}', "lens.ts": "export const lens = 1;\n"})
    write(root, {
        "tools/ink/package.json": '{"name": "@lab/ink", "exports": {".": {"node": "./no.js", "types": "./main.ts"}, "./pens/*": "./src/*.js", "./closed": null}, "imports": {"#wet/*": "./src/wet/*.ts"}}',
        "tools/ink/main.ts": 'export * from "#wet/drop";\n', "tools/ink/src/wet/drop.ts": "export const drop = 1;\n", "tools/ink/src/quill.ts": 'import "@lab/ink/pens/quill";\nexport const quill = 1;\n', "tools/ink/closed.ts": "export {};\n",
        "site/page.ts": 'import "@lab/ink";\nimport "@lab/ink/pens/quill";\nimport "@lab/ink/closed";\nimport "@lab/far/lens";\nimport "../../sibling/lens";\nimport "../../sibling/none";\nimport "react";\n',
    })
    (root / "node_modules/@lab").mkdir(parents=True)
    (root / "node_modules/@lab/ink").symlink_to(root / "tools/ink", target_is_directory=True)
    (root / "node_modules/@lab/far").symlink_to(far, target_is_directory=True)
    a = tables(spark, str(root))
    edges = sorted((r["src_path"], r["dst_path"]) for r in architecture.edge_paths(a.edges, a.files).collect())
    assert edges == [("site/page.ts", "tools/ink/main.ts"), ("site/page.ts", "tools/ink/src/quill.ts"), ("tools/ink/main.ts", "tools/ink/src/wet/drop.ts")]
    left = {r["spec"]: r["outside"] for r in a.unresolved.collect()}
    assert left == {"@lab/ink/closed": False, "@lab/far/lens": True, "../../sibling/lens": True, "../../sibling/none": False, "react": False}


def test_entries_of_packages():
    p = json.dumps({"exports": {".": ["bad", {"browser": "./b.js"}, "./ok.js"], "./a/*": {"import": {"node": "./n/*.js"}, "default": "./d/*.js"}, "./a/b/*": "./deep/*/*.ts", "./*.svg": None, "./*": "./all/*"}})
    ask = lambda r: packages.targets(p, "package", r)["files"]
    assert ask(".") == ["ok.js"] and ask("./a/x") == ["d/x.js"] and ask("./a/b/c") == ["deep/c/c.ts"] and ask("./z") == ["all/z"]
    assert ask("./q.svg") == []
    assert packages.targets('{"exports": "./one.ts"}', "package", ".")["files"] == ["one.ts"] and packages.targets('{"exports": "./one.ts"}', "package", "./x")["files"] == []
    assert packages.targets('{"main": "lib/x.js", "types": "t.d.ts"}', "package", ".")["loose"] == ["t.d.ts", "lib/x.js", ""]
    assert packages.targets(None, "package", "./sub")["loose"] == ["sub"] and packages.targets("[1]", "import", "#x") == {"files": [], "loose": [], "again": []}


def test_chains_of_configurations(spark):
    texts = {
        "a": {"jsconfig.json": '{"compilerOptions": {"baseUrl": "z"}}', "tsconfig.json": '{"extends": ["./one", "./two.json", "./gone"], "compilerOptions": {}}', "one.json": '{"compilerOptions": {"baseUrl": "b1", "paths": {"x": ["1"]}}}', "two.json": '{"extends": "./deep/three", "compilerOptions": {"paths": {"x": ["2"]}}}', "deep/three.json": '{"extends": "../tsconfig", "compilerOptions": {"baseUrl": "../b3", "paths": {"x": ["3"]}}}'},
        "b": {"jsconfig.json": '{"compilerOptions": {"paths": {"@/*": ["s/*"]}}}'}, "c": {"tsconfig.json": "{"}, "d": {"package.json": "{}"},
    }
    settings = spark.createDataFrame([(r, p, t) for r, fs in texts.items() for p, t in fs.items()], "repo_id string, path string, text string")
    none = resolve.Surroundings.none(spark)
    got = {r["repo_id"]: (r["base_url"], r["paths"], r["base"]) for r in packages.configurations(settings, none.links).collect()}
    assert got == {"a": ("b3", {"x": ["2"]}, "b3"), "b": (None, {"@/*": ["s/*"]}, ""), "c": (None, None, None)}
    assert packages.configurations(settings.where("false"), none.links).count() == 0


def test_candidates_of_specifiers():
    config = {"baseUrl": "", "paths": {"lib/*": ["src/*", "gen/*"], "lib/special": ["odd.ts"]}, "base": ""}
    assert resolve.candidates("lib/special", "q.ts", config)[0] == "odd.ts"
    assert [p for p in resolve.candidates("lib/k", "q.ts", config) if p.endswith("/k.ts")] == ["src/k.ts", "gen/k.ts", "lib/k.ts"]
    assert resolve.candidates("./w.jsx", "d/q.ts", {})[:2] == ["d/w.jsx", "d/w.tsx"]
    assert resolve.candidates("pkg", "q.vue", {}) == [] and "n/index.vue" in resolve.candidates("./n", "q.vue", {})
    assert resolve.candidates("../../w", "d/q.ts", {})[0] == "../w.ts"


def test_components_agree_on_both_routes(spark):
    rng = random.Random(11)
    files, rows, k = [], [], 0
    for r in range(5):
        names = [f"{rng.choice('pQr')}{i}.ts" for i in range(16)]
        files += [(f"r{r}", f"id{n}", n) for n in names]
        for _ in range(14 + 5 * r):
            k += 1
            rows.append((f"r{r}", f"id{rng.choice(names)}", f"id{rng.choice([*names, 'gone.ts'])}", "import", k))
    files, edges = spark.createDataFrame(files, "repo_id string, id string, path string"), spark.createDataFrame(rows, "repo_id string, src string, dst string, kind string, ordinal long").where("src <> dst")
    plain, joined, mixed = ([tuple(r) for r in graph.components(files, edges, most_edges=m).orderBy("repo_id", "ordinal").collect()] for m in (10_000, 0, 24))
    assert plain == joined == mixed and len({r[0] for r in plain}) >= 3 and max(r[1] for r in plain) >= 1
    for _, _, own, loop in plain:
        assert loop[0] == loop[-1] == own[0] and set(loop) <= set(own)
    assert graph.components(files.where("false"), edges.where("false"), most_edges=0).count() == 0


def test_deep_graphs_need_no_recursion():
    n = 30_000
    chain = {i: [i + 1] for i in range(n - 1)}
    assert graph.strong_components(list(range(n)), chain) == []
    whole = graph.strong_components(list(range(n)), chain | {n - 1: [0]})
    assert [len(g) for g in whole] == [n] and len(graph.shortest_loop(whole[0], chain | {n - 1: [0]})) == n + 1


def test_chains_of_a_graph_take_few_tables(spark, tmp_path):
    """A ring of 3,000 nodes with a way in and one out, two rings that share a node, and random graphs: in a round for a few steps it would take hundreds of tables."""
    n, rnd = 3000, random.Random(5)
    graphs = {"ring": [(k, (k + 1) % n) for k in range(n)] + [(-k - 1, -k) for k in range(40)] + [(7, n + 5), (n + 5, n + 6)], "two": [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 2), (4, 9)]}
    for g in range(25):
        m = rnd.randint(3, 40)
        graphs[f"r{g}"] = [(rnd.randrange(m), rnd.randrange(m)) for _ in range(int(m * rnd.uniform(0.8, 1.7)))]
    tables = []

    class Counting(Shelf):
        def put(self, df, name):
            tables.append(name)
            return super().put(df, name)

    edges = spark.createDataFrame([(r, a, b) for r, es in graphs.items() for a, b in es], "repo_id string, a long, b long")
    rows = graph.members_by_joins(edges, Counting(spark)).collect()
    found, want = {}, set()
    for r in rows:
        found.setdefault((r["repo_id"], r["component"]), []).append(r["node"])
    for r, es in graphs.items():
        out = {}
        for a, b in es:
            out.setdefault(a, []).append(b)
        want |= {(r, tuple(sorted(g))) for g in graph.strong_components(sorted(out), out)}
    assert {(r, tuple(sorted(g))) for (r, _), g in found.items()} == want and len(rows) == sum(len(g) for _, g in want)
    assert len(tables) < 150



def test_a_run_writes_its_reports_whatever_the_narrator_does(spark, trees, tmp_path):
    seen, out = [], tmp_path / "made"

    def broken(context):
        raise RuntimeError("silent")

    a = run_analysis(spark, str(trees / "mill"), Options(query="grain", narrator=broken, listener=seen.append, output=str(out), most_findings=0))
    assert seen[0]["node"] == "loadRepository" and seen[-1]["node"] == "render" and len({e["node"] for e in seen}) == 11
    assert any(e["node"] == "narrate" and e["detail"] == "skipped: silent" for e in seen)
    written = json.loads((out / "report.json").read_text())
    assert written["findings"] == [] and written["findingsLeftOut"] == 1 and written["narration"] is None and a.retrieval
    assert (out / "report.md").read_text().startswith("# ") and (out / "report.html").read_text().startswith("<!doctype html>")
    store = Store(spark, f"{out}/store")
    assert store.runs().count() == store.checkpoints().count() == 1 and store.files().count() == 4 and store.changed(a.files).count() == 0
    log = read_events(spark, f"{out}/events")
    assert run_status(log).first()["status"] == "completed" and progress_label(node_states(log)).first()["label"] == "11/11"


def test_runs_in_the_background(spark, trees, tmp_path):
    runs = Runs(spark)
    run = runs.submit(str(trees / "desk"), output=str(tmp_path / "o"))
    assert runs.result(run, 300).score["dimensions"]["typing"] == 0 and runs.status(run) == "completed"
    names = [name for name, _ in runs.frames(run)]
    assert names[-1] == "done" and set(names[:-1]) == {"progress"}
    with pytest.raises(NotADirectoryError):
        tables(spark, str(tmp_path / "nowhere"))
    assert not (tmp_path / "nowhere").exists()


def test_what_a_scan_takes_and_leaves(spark, tmp_path):
    write(tmp_path, {
        "routes/_layout.tsx": "x", "_private/y.ts": "a\r\nb\r\n", "[slug]/page.tsx": "", ".secret.ts": "x", "node_modules/p/q.ts": "x", "out/z.ts": "x", "vendor.min.js": "x", "UP.JS": b"\xff if(a)&&b", "data.json": "{}", ".git/y.ts": "",
        "view/Box.vue": "<script>import { t } from '../t'\nexport function show() {}\nconst n = 1</script>", "t.ts": "import Box from './view/Box.vue'\nexport const t = 1", "types/e.d.ts": "x",
    })
    a = tables(spark, str(tmp_path), "r")
    rows = {r["path"]: r for r in a.files.collect()}
    assert set(rows) == {"routes/_layout.tsx", "_private/y.ts", "[slug]/page.tsx", "UP.JS", "view/Box.vue", "t.ts", "types/e.d.ts"}
    assert rows["_private/y.ts"]["line_count"] == 3 and rows["[slug]/page.tsx"]["line_count"] == 1 and rows["UP.JS"]["size"] == 10 and rows["UP.JS"]["complexity"] == 3
    assert {(r["src_path"], r["dst_path"]) for r in architecture.edge_paths(a.edges, a.files).collect()} == {("view/Box.vue", "t.ts")}
    assert {r["name"]: r["kind"] for r in a.symbols.where(a.symbols["file_id"] == rows["view/Box.vue"]["id"]).collect()} == {"show": "component", "n": "variable"}


def test_lexer():
    m = scan(
        """import Main, { alpha as beta, type Gamma } from "pkg"; import * as all from './all'; import './effect';
export { d as e } from "./again"; export * from './star';
// import n from "comment"
const text = `import ${ 3 + `${4}` } from "quoted"`; const pattern = /export "x"/g;
export const Tile = ({p}: Q) => { const y = 2 < 3; return <div id="k">Don't <Tile.Edge f={() => <Dot/>}>z</Tile.Edge><Line/></div>; };
export default function Board(): { b: number } { return (<><Tile p={1}/></>); }
const Frame = memo(forwardRef((a, b) => null)), {u, v} = useGrid<Cell>();
class Piece extends React.PureComponent<P> implements R { render() { return null } }
interface Side { s: string }
type Kind = { k: 1 } | { l: 2 }
const soon = () => import("./Soon")
async function useMove<T>(x: T) { if (x < 5 && x > 4) { import(`./not`); import("./y" + z) } }
let last
export { last }
""",
        True,
    )
    assert [(s.what, s.name) for s in m.symbols] == [("function", "Board"), ("function", "useMove"), ("class", "Piece"), ("interface", "Side"), ("type", "Kind"), *(("variable", n) for n in ("text", "pattern", "Tile", "Frame", "{u, v}", "soon", "last"))]
    assert [s.name for s in m.symbols if s.exported] == ["Board", "Tile", "last"]
    assert [x for x, _ in m.imports] == ["pkg", "./all", "./effect"] and [x for x, _ in m.exports] == ["./again", "./star"] and [x for x, _ in m.dynamic][:1] == ["./Soon"]
    assert m.names == [("Main", "pkg"), ("beta", "pkg"), ("Gamma", "pkg"), ("all", "./all")] and [x for x, _ in m.tags] == ["div", "Tile.Edge", "Dot", "Line", "Tile"]


def test_options_from_the_environment():
    o = Options.from_environment({"TESSERA_PLANNER": "json:loads", "TESSERA_OUTPUT": "/x", "TESSERA_PERSIST": "0"}, query="q")
    assert o.planner is json.loads and o.narrator is None and (o.output, o.persist, o.query) == ("/x", False, "q")


def test_the_evaluation_of_a_folder(spark, tmp_path, capsys):
    two = {"m.ts": 'import "./n";\n', "n.ts": 'import "./m";\n'}
    for name, status, other in (("fine", "expected-pass", "n.ts"), ("worse", "expected-pass", "o.ts"), ("old", "known-failure", "o.ts")):
        write(tmp_path / name, two | {"expected.json": json.dumps({"status": status, "expect": {"cycles": [["m.ts", other]]}})})
    assert ev.main([str(tmp_path)]) == 1
    said = capsys.readouterr().out
    assert "REGRESSION  worse" in said and "missing: cycle m.ts | o.ts" in said and "KNOWN-FAIL  old" in said
    (tmp_path / "worse" / "expected.json").unlink()
    assert ev.main([str(tmp_path)]) == 0


def test_reports_escape_and_say_what_is_missing():
    assert escape_html("<i j='k'>&\"") == "&lt;i j=&#39;k&#39;&gt;&amp;&quot;"
    text = markdown({"generatedAt": "t", "stack": {"confidence": 0.25, "evidence": []}, "metrics": {"score": 0, "dimensions": {}}, "findings": [], "mermaid": "graph TD"})
    assert "未发现问题" in text and "未识别" in text


def test_outcomes_and_fingerprints(spark):
    rows = spark.createDataFrame([(s, p, ["b", "a"]) for s in ("expected-pass", "known-failure") for p in (True, False)], "s string, p boolean, xs array<string>")
    assert [r[0] for r in rows.select(ev.outcome(rows["s"], rows["p"])).collect()] == ["PASS", "REGRESSION", "FIXED", "KNOWN-FAIL"]
    assert rows.select(fingerprint(rows["xs"])).first()[0] == "a | b"


def test_loop_lengths_of_all_nodes():
    """Against one search a node; all nodes of a ring of 20,000 in one search (in one a node it would take 400 million steps)."""
    import time

    import numpy as np

    rnd, tried = random.Random(3), 0
    for g in range(60):
        m = rnd.randint(3, 200)
        out = {}
        for _ in range(int(m * rnd.uniform(1.1, 2))):
            a, b = rnd.randrange(m), rnd.randrange(m)
            if a != b:
                out.setdefault(a, set()).add(b)
        for group in graph.strong_components(sorted(out), out):
            at = {v: k for k, v in enumerate(sorted(group))}
            pairs = [(at[a], at[b]) for a in group for b in out[a] if b in at]
            src, dst = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
            want = {at[v]: len(graph.shortest_loop([v, *group], {a: [b for b in out[a] if b in at] for a in group})) - 1 for v in group}
            parts = rnd.randint(1, 3)
            rows = [r for p in range(parts) for r in zip(*(x.tolist() for x in graph.loop_lengths(src, dst, len(group), p, parts)), strict=True)]
            assert len(rows) == len(group) and dict(rows) == want
            tried += 1
    assert tried > 30
    n, begun = 20_000, time.monotonic()
    nodes, steps = graph.loop_lengths(np.arange(n), (np.arange(n) + 1) % n, n)
    assert len(nodes) == n and set(steps.tolist()) == {n} and time.monotonic() - begun < 30


def test_best_files_of_questions_are_kept_at_once():
    """The best of many files for 3,000 questions, as sorting gives them; a step a question and file would be 12 million."""
    import time

    import numpy as np

    from tessera.operators.questions import Best

    r, files, n, most = np.random.default_rng(4), 4000, 3000, 5
    scores, late, begun = r.integers(0, 40, (files, n)) * 5, r.random((files, n)) < 0.5, time.monotonic()
    best = Best(n, most)
    for place in r.permutation(files).tolist():
        best.add(scores[place], late[place], place, f"f{place}")
    took, rows = time.monotonic() - begun, best.rows("r", list(range(n)))
    assert took < 5 and len(rows) == n * most and list(rows["id"]) == [f"f{p}" for p in rows["place"]]
    for q in range(0, n, 300):
        want = sorted(range(files), key=lambda p: (-scores[p, q], late[p, q], p))[:most]
        own = rows[rows["key"] == q].sort_values(["score", "late", "place"], ascending=[False, True, True])
        assert list(own["place"]) == want and [int(x) for x in own["score"]] == [int(scores[p, q]) for p in want] and list(own["late"]) == [bool(late[p, q]) for p in want]


def test_loops_along_long_paths():
    """Each way of a small graph is a path of 3,000 nodes: a look at all ways for each step would take minutes."""
    import time

    import numpy as np

    rnd, n, far = random.Random(6), 80, 3000
    out = {k: {(k + 1) % n, rnd.randrange(n)} - {k} for k in range(n)}
    ways, names = [(a, b) for a in out for b in out[a]], n
    src, dst = [], []
    for a, b in ways:
        path = [a, *range(names, names + far - 1), b]
        names += far - 1
        src.append(path[:-1])
        dst.append(path[1:])
    begun = time.monotonic()
    nodes, steps = graph.loop_lengths(np.concatenate(src), np.concatenate(dst), names)
    assert time.monotonic() - begun < 5 and nodes.tolist() == list(range(names))
    want = [far * (len(graph.shortest_loop([k, *out], out)) - 1) for k in range(n)]
    assert steps[:n].tolist() == want
    back = {a: {b: len(graph.shortest_loop([n, *out], {**out, n: [b], a: [*out[a], n]})) - 2 for b in out[a]} for a in out}  # a way and the least way back
    assert all(set(steps[own[1:]].tolist()) == {far * back[a][b]} for (a, b), own in zip(ways, src, strict=True))


def test_loops_of_nodes_on_both_routes(spark):
    rnd, rows, want = random.Random(14), [], {}
    for r in range(4):
        m, out = rnd.randint(20, 40), {}
        for _ in range(int(m * 1.3)):
            a, b = rnd.sample(range(m), 2)
            rows.append((f"r{r}", f"n{a}", f"n{b}"))
            out.setdefault(a, set()).add(b)
        want |= {(f"r{r}", f"n{v}"): len(graph.shortest_loop([v, *group], out)) - 1 for group in graph.strong_components(sorted(out), out) for v in group}
    rows += [("alone", "a", "b"), ("ring", "a", "b"), ("ring", "b", "c"), ("ring", "c", "a"), ("ring", "c", "a")]
    want |= {("ring", x): 3 for x in "abc"}
    edges = spark.createDataFrame(rows, "repo_id string, src string, dst string")
    for most in (10_000, 30):
        found = graph.loops_of_nodes(edges, most).collect()
        assert len(found) == len(want) > 20 and {(x["repo_id"], x["id"]): x["hops"] for x in found} == want
