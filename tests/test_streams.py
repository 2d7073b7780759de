"""The event log as a stream, the state of runs, the store's commits, and questions by the table."""

import json
import random
import threading
import time

import pytest

from tessera.operators import questions, retrieval
from tessera.plans import store as stores
from tessera.schema import EVENTS
from tessera.streaming import log, states
from tessera.streaming.events import EventLog, node_states
from tests.shared import counted

COLUMNS = ["run_id", "node", "status", "duration_ms", "first_seq"]


def events(spark, rows):
    return spark.createDataFrame([(r, s, n, p, "t", s * 10, None) for r, s, n, p in rows], EVENTS)


def test_a_reader_that_is_stopped_loses_and_repeats_nothing(spark, tmp_path):
    folder, rows, mark = (str(tmp_path / x) for x in ("log", "rows", "mark"))
    first, second = EventLog(folder, "a/1"), EventLog(folder, "b")
    first.emit("scan", "start")
    first.emit("scan", "end", 3)
    states.written(log.stream(spark, folder), rows, mark)
    second.emit("scan", "start")
    first.emit("render", "start", detail="Ünï")
    query = log.stream(spark, folder).writeStream.format("parquet").option("path", rows).option("checkpointLocation", mark).trigger(processingTime="200 milliseconds").start()
    deadline = time.time() + 60
    while len(spark.read.schema(EVENTS).parquet(rows).collect()) < 4 and time.time() < deadline:
        time.sleep(0.3)
    query.stop()  # in the middle of its work
    second.emit("scan", "error", 5, "broken")
    states.written(log.stream(spark, folder), rows, mark)
    states.written(log.stream(spark, folder), rows, mark)
    got = sorted((r["run_id"], r["seq"], r["node"], r["phase"], r["detail"]) for r in spark.read.schema(EVENTS).parquet(rows).collect())
    assert got == [("a/1", 0, "scan", "start", None), ("a/1", 1, "scan", "end", None), ("a/1", 2, "render", "start", "Ünï"), ("b", 0, "scan", "start", None), ("b", 1, "scan", "error", "broken")]
    assert log.lengths(folder) == {"a/1": 3, "b": 2}
    states.written(log.stream(spark, folder, ["b"]), f"{rows}b", f"{mark}b")
    assert spark.read.schema(EVENTS).parquet(f"{rows}b").count() == 2
    log.forget(folder, ["a/1"])
    assert log.lengths(folder) == {"b": 2} and log.lengths(str(tmp_path / "none")) == {}


def test_states_are_bounded_and_survive_a_restart(spark, tmp_path):
    states.configure(spark)
    rng = random.Random(3)
    every = []
    for k in range(60):  # runs one after another; a few never end
        own = [(f"run{k:02d}", k * 10, "scan", "start"), (f"run{k:02d}", k * 10 + 1, "scan", "end"), (f"run{k:02d}", k * 10 + 2, "render", "start")]
        if k % 20 != 7:
            own.append((f"run{k:02d}", k * 10 + 3, "render", "error" if k % 5 == 0 else "end"))
        every.append(own)
    source, rows, mark = (str(tmp_path / x) for x in ("in", "rows", "mark"))
    for part in range(3):  # each part in an order of its own, and each by a query started anew
        batch = [e for own in every[part * 20 : part * 20 + 20] for e in own]
        rng.shuffle(batch)
        events(spark, batch).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(EVENTS).parquet(source)
        states.written(states.run_states(stream, most_finished=4, shards=2), rows, mark)
    found = spark.read.schema(states.ROWS).parquet(rows)
    final = {r["run_id"]: r["status"] for r in states.kept_runs(found).collect()}
    running = {r for r, s in final.items() if s == "running"}
    assert running == {"run07", "run27", "run47"} and len(final) <= 3 + 2 * 4
    newest = sorted(r for r, s in final.items() if s != "running")[-4:]
    assert newest == ["run56", "run57", "run58", "run59"]  # the newest of all are among those of each shard
    batch = node_states(events(spark, [e for own in every for e in own]))
    assert counted(states.last_nodes(found).collect(), COLUMNS) == counted(batch.collect(), COLUMNS)


def test_a_silent_run_fails(spark, tmp_path):
    states.configure(spark)
    source, rows, mark = (str(tmp_path / x) for x in ("in", "rows", "mark"))
    events(spark, [("r", 0, "scan", "start")]).write.parquet(source)
    stream = states.run_states(spark.readStream.schema(EVENTS).parquet(source), quiet_ms=1_500, shards=1)
    query = stream.writeStream.format("parquet").option("path", rows).option("checkpointLocation", mark).outputMode("append").trigger(processingTime="500 milliseconds").start()
    deadline, seen = time.time() + 60, set()
    while "failed" not in seen and time.time() < deadline:
        time.sleep(0.5)
        if (tmp_path / "rows" / "_spark_metadata").exists():
            seen = {r["run_status"] for r in spark.read.schema(states.ROWS).parquet(rows).collect()}
    query.stop()
    assert seen == {"running", "failed"}


def run_rows(spark, k):
    return spark.createDataFrame([(f"run{k}", "t", json.dumps({"k": k}), "repo")], stores.TABLES["runs"])


def file_rows(spark, k, repo="repo"):
    return spark.createDataFrame([(f"{i}.ts", f"h{k}", repo) for i in range(3)], "path string, content_hash string, repo_id string")


def test_writers_at_the_same_time_lose_nothing(spark, tmp_path):
    folder = str(tmp_path / "store")
    failed = []

    def write(k):
        try:
            stores.Store(spark, folder).commit(run_rows(spark, k), file_rows(spark, k), spark.createDataFrame([(f"run{k}", k, "u", f"s{k}")], stores.CHECKPOINTS))
        except Exception as e:  # told by the main thread
            failed.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    for th in threads:
        th.start()
    for th in threads:
        th.join()
    store = stores.Store(spark, folder)
    assert not failed and store.version() == 4
    assert {r["id"] for r in store.runs().collect()} == {r["run_id"] for r in store.checkpoints().collect()} == {f"run{k}" for k in range(4)}
    assert store.files().count() == 3 and store.files().select("content_hash").distinct().count() == 1  # one commit's index, whole
    store.replace_files(file_rows(spark, 9, "other"))
    assert store.files().count() == 6 and store.changed(file_rows(spark, 9, "other")).count() == 0 and store.changed(file_rows(spark, 8, "other")).count() == 3


def test_a_writer_that_fails_is_never_seen(spark, tmp_path):
    folder = str(tmp_path / "store")
    store = stores.Store(spark, folder)
    store.commit(run_rows(spark, 1), file_rows(spark, 1))
    bad = spark.range(4).selectExpr("concat('run', id) as id", "'t' as generated_at", "if(id = 3, raise_error('stop'), 'x') as payload", "'repo' as repo_id")
    with pytest.raises(Exception, match="stop"):
        store.commit(bad, file_rows(spark, 2))
    assert store.version() == 1 and [r["id"] for r in store.runs().collect()] == ["run1"] and {r["content_hash"] for r in store.files().collect()} == {"h1"}
    assert not stores.claim(folder, {"version": 1}) and stores.newest(folder)["version"] == 1


@pytest.mark.parametrize("block", [1, 20_000])
def test_a_table_of_questions_as_each_alone(spark, block, monkeypatch):
    monkeypatch.setattr(questions, "BLOCK", block)
    files = spark.createDataFrame([("r", f"id{p}", p) for p in ("a/cart.ts", "B/order.ts", "c/z.ts", "d/empty.ts")], "repo_id string, id string, path string")
    contents = spark.createDataFrame([("r", "a/cart.ts", "useCart checkout ORDER"), ("r", "B/order.ts", "hook cart"), ("r", "c/z.ts", "nothing basket"), ("r", "d/empty.ts", "")], "repo_id string, path string, content string")
    symbols = spark.createDataFrame([("r", "ida/cart.ts", "useCart", "hook", 1), ("r", "ida/cart.ts", "CartView", "component", 2), ("r", "idc/z.ts", "basketOf", "function", 3)], "repo_id string, file_id string, name string, kind string, ordinal long")
    edges = spark.createDataFrame([("r", "ida/cart.ts", "idB/order.ts", "import", 1), ("r", "ida/cart.ts", "idB/order.ts", "render", 2), ("r", "idc/z.ts", "gone", "import", 3)], "repo_id string, src string, dst string, kind string, ordinal long")
    asked = ["购物车 hook", "订单组件", "cart 调用", "zzz", ""]
    table = spark.createDataFrame(list(enumerate(asked)), "key long, q string").select("key", retrieval.query_plan("q").alias("plan"))
    got = {}
    for r in questions.retrieve_all(table, files, symbols, edges, contents).orderBy("key", "rank").collect():
        got.setdefault(r["key"], []).append((r["path"], r["score"]))
    for k, q in enumerate(asked):
        alone = retrieval.retrieve(retrieval.parse_query(spark, q), files, symbols, edges, contents)
        assert got.get(k, []) == [(r["path"], r["score"]) for r in alone.collect()]
    assert questions.retrieve_all(table.where("false"), files, symbols, edges, contents).count() == 0


def test_questions_against_many_files_by_brute_force(spark, monkeypatch):
    """Bounds leave out no file, and tasks pass on the result alone: no candidates are dealt again. Words go to several automata, questions to several blocks."""
    for name, value in (("WORDS", 40), ("FEW", 25), ("GROUP", 4096)):
        monkeypatch.setattr(questions, name, value)
    rnd = random.Random(8)
    parts = ["ka", "lo", "mi", "ren", "so", "tu", "va", "zek"]
    word = lambda most: "".join(rnd.choice(parts) for _ in range(rnd.randint(1, most)))
    kinds, relations = ("component", "hook", "function"), ("import", "render")
    files, contents, symbols, edges, facts = [], [], [], [], {}
    for k in range(400):
        repo, path = f"r{rnd.random() < 0.2:d}", f"d{k % 7}/{word(2)}{k}.ts"
        text = None if k % 50 == 0 else " ".join(word(4) for _ in range(int(rnd.paretovariate(0.6)) % 200))
        own = [(word(3).title(), rnd.choice(kinds)) for _ in range(rnd.choice((0, 0, 1, 3, len(text or "") // 20)))]
        files.append((repo, f"id{k}", path))
        contents += [(repo, path, text)] if k % 40 else []
        symbols += [(repo, f"id{k}", n, kind, j) for j, (n, kind) in enumerate(own)]
        facts[k] = (repo, path, f"{path}\n{text or ''}".lower() if k % 40 else f"{path}\n", own, [])
    for k in range(900):
        a, b, kind = rnd.randrange(400), rnd.randrange(400), rnd.choice(relations)
        edges.append((facts[a][0], f"id{a}", f"id{b}", kind, k))
        facts[a][4].extend([kind] if facts[a][0] == facts[b][0] else [])
    asked = [(q, (list({word(rnd.choice((1, 3))) for _ in range(rnd.choice((1, 2, 9, 30)))}), rnd.choice((["component"], ["hook"], list(kinds))), rnd.choice((["import"], list(relations))))) for q in range(150)]
    table = spark.createDataFrame(asked, "key long, plan struct<concepts: array<string>, symbol_kinds: array<string>, relation_kinds: array<string>>")
    of = lambda rows, names: spark.createDataFrame(rows, names)
    found = questions.retrieve_all(table, of(files, "repo_id string, id string, path string"), of(symbols, "repo_id string, file_id string, name string, kind string, ordinal long"), of(edges, "repo_id string, src string, dst string, kind string, ordinal long"), of(contents, "repo_id string, path string, content string"), 5)
    assert found._jdf.queryExecution().optimizedPlan().nodeName() == "MapInArrow"
    got = {}
    for r in found.collect():
        got.setdefault((r["repo_id"], r["key"]), []).append((r["rank"], r["path"], r["score"]))
    place = {r["path"]: r["place"] for r in questions.in_reading_order(of(files, "repo_id string, id string, path string")).collect()}
    want = {}
    for q, (words, some, ways) in asked:
        scored: dict = {}
        for repo, path, text, own, related in facts.values():
            hits = sum(w in text for w in words)
            base = 10 * hits + 25 * sum(kind in some and any(w in n.lower() for w in words) for n, kind in own)
            if base:
                scored.setdefault(repo, []).append((-base - 5 * min(5, sum(x in ways for x in related)), hits == 0, place[path], path))
        want |= {(repo, q): [(k + 1, x[3], -x[0]) for k, x in enumerate(sorted(xs)[:5])] for repo, xs in scored.items()}
    assert {k: sorted(v) for k, v in got.items()} == want and len(want) > 250
