from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from sievelight.operators import classifier
from sievelight.sources import csv_records, files, jsonl, sinks


def put(folder, name, data):
    p = folder / name
    p.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(p)


def test_train_csv(spark, tmp_path):
    good = put(tmp_path, "t.csv", '\ufeffid,question,answer\r\na,"x ""q""\r\ny",5\r\nb,２\u00a0+2,-3\r\n')
    rows = csv_records.require(csv_records.read_train(spark, good)).orderBy("ord").collect()
    assert [(r.id, r.question_raw, r.question_normalized, int(r.answer), r.row_number) for r in rows] == [("a", 'x "q"\r\ny', 'x "q"\ny', 5, 2), ("b", "２\u00a0+2", "2 +2", -3, 3)]
    bad = {
        "a,q,1.5": "noncanonical_answer", "a,q,01": "noncanonical_answer", "a,q,": "missing_answer", "a,q": "row_width", "a,q,1,2": "row_width", ",q,1": "missing_id", " a,q,1": "untrimmed_id", "a, ,1": "blank_question", 'a,"q,1': "csv_parse", "a\0,q,1": "nul", 'a,q"x",1\nb,"q"x,2': "csv_parse",
    }
    for i, (line, code) in enumerate(bad.items()):
        got = csv_records.read_train(spark, put(tmp_path, f"b{i}.csv", f"id,question,answer\n{line}\n"))
        assert code in {r.problem for r in got.collect()}, line
        with pytest.raises(ValueError):
            csv_records.require(got)
    for i, (data, code) in enumerate(((b"", "empty_file"), (b"id,answer,question\na,1,q\n", "header_schema"), (b"id,question,answer\na,\xff,1\n", "csv_parse"))):
        assert code in {r.problem for r in csv_records.read_train(spark, put(tmp_path, f"c{i}.csv", data)).collect()}
    with pytest.raises(ValueError, match="duplicate"):
        csv_records.require(csv_records.read_train(spark, put(tmp_path, "d.csv", "id,question,answer\na,q,1\na,r,2\n")))
    with pytest.raises(ValueError, match="fewer"):
        csv_records.require(csv_records.read_train(spark, put(tmp_path, "e.csv", "id,question,answer\n")))
    assert csv_records.read_fast(spark, good).count() == 2


def test_other_csv(spark, tmp_path):
    for i, head in enumerate(("id,question", "id,question,answer", "id,question, answer")):
        rows = csv_records.read_leaderboard(spark, put(tmp_path, f"l{i}.csv", f"{head}\nv1,what\n")).collect()
        assert [(r.id, r.question_raw, r.answer, r.problem) for r in rows] == [("v1", "what", None, None)], head
    assert csv_records.read_leaderboard(spark, put(tmp_path, "l9.csv", "id,question,answer\nv1,what,5\n")).first().problem == "unexpected_answer"
    assert [r.id for r in csv_records.read_exclusions(spark, put(tmp_path, "x.csv", "id,answer,question\na,1,q\n")).collect()] == ["a"]
    assert csv_records.read_exclusions(spark, put(tmp_path, "y.csv", "id\n")).count() == 0
    assert [(r.id, r.answer) for r in csv_records.read_submission(spark, put(tmp_path, "s.csv", "ID,answer\na,1\n")).collect()] == [("a", "1")]


def test_jsonl(spark, tmp_path):
    lines = ['{"problem_id":"train-000001","n":1}', '{"problem_id":"x","n":2}', "", '{"n":3}', "[1]", '{"problem_id":"train-000002","n":"q"}']
    rows = jsonl.read_jsonl(spark, put(tmp_path, "r.jsonl", "\n".join(lines)), "problem_id string, n int")
    assert [r.problem for r in rows.collect()] == [None, None, "blank_line", "key_set", "not_an_object", "types"]
    assert jsonl.unterminated(spark, put(tmp_path, "u.jsonl", "{}")).count() == 1 and jsonl.unterminated(spark, put(tmp_path, "w.jsonl", "{}\n")).count() == 0
    ids = rows.where("problem IS NULL").select("row.*")
    got = {tuple(r) for r in jsonl.coverage_issues(ids, spark.createDataFrame([("train-000001",), ("train-000009",)], "problem_id string")).collect()}
    assert got == {("x", "extra"), ("x", "id_form"), ("train-000009", "missing")}
    assert {tuple(r) for r in jsonl.read_prediction_map(spark, put(tmp_path, "p.json", '{"a":1,\n"b":-2}')).collect()} == {("a", "1"), ("b", "-2")}
    assert jsonl.load_manifest('{"a":1}', {"a"}) == {"a": 1}
    for text in ('{"a":1,"a":2}', '{"a":NaN}', "[]", '{"b":1}'):
        with pytest.raises(ValueError):
            jsonl.load_manifest(text, {"a"})


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "ü", None), (2, "b", 3)], "id int, b string, a int")
    out = str(tmp_path / "out")
    sinks.publish(df, out, {"note": 1})
    assert sinks.load_published(spark, out).count() == 2
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.publish(df, out)
    df.limit(1).write.mode("append").parquet(out)
    with pytest.raises(ValueError, match="manifest"):
        sinks.load_published(spark, out)
    sinks.write_jsonl(df.orderBy("id").coalesce(1), str(tmp_path / "j"))
    assert [r.value for r in spark.read.text(str(tmp_path / "j")).collect()] == ['{"a":null,"b":"ü","id":1}', '{"a":3,"b":"b","id":2}']
    payload = sinks.hashed({"a": 1})
    assert sinks.is_intact(payload) and not sinks.is_intact(payload | {"a": 2})
    sinks.write_json(spark, str(tmp_path / "m.json"), payload)
    assert json.loads((tmp_path / "m.json").read_text()) == payload
    with pytest.raises(FileExistsError):
        sinks.write_json(spark, str(tmp_path / "m.json"), payload)
    expected = spark.createDataFrame([(i, f"p{i}") for i in range(50)], "ord long, id string")
    sinks.write_submission(expected.select("id", F.col("ord").cast("string").alias("prediction")), expected, str(tmp_path / "s"))
    parts = sorted((tmp_path / "s").glob("part-*.csv"))
    lines = [x for p in parts for x in p.read_text().splitlines() if x != "ID,answer"]
    assert lines == [f"p{i},{i}" for i in range(50)]
    split = spark.createDataFrame([("1", "1", "cross_validation", 0), ("2", "2", "final_locked_holdout", None)], "record_id string, group_id string, partition string, fold int")
    sinks.cv_shard(split, spark.createDataFrame([("1", "q"), ("2", "r")], "id string, question_raw string"), str(tmp_path / "cv"))
    assert [r.record_id for r in sinks.load_published(spark, str(tmp_path / "cv")).collect()] == ["1"]


def test_file_manifest(spark, tmp_path):
    import hashlib

    (tmp_path / "a").mkdir()
    put(tmp_path / "a", "x.py", "1")
    put(tmp_path, "y.py", "22")
    put(tmp_path, "z.txt", "3")
    got = {r.path: (r.size_bytes, r.sha256) for r in files.file_manifest(spark, str(tmp_path), (".py",)).collect()}
    assert got == {"a/x.py": (1, hashlib.sha256(b"1").hexdigest()), "y.py": (2, hashlib.sha256(b"22").hexdigest())}
    assert files.file_manifest(spark, str(tmp_path), (".py",), ("a",)).count() == 1
    assert files.tree_sha256(files.file_manifest(spark, str(tmp_path))).first().n_files == 3


def event(kind, **more):
    return json.dumps({"type": kind, **more})


def test_classifier(spark):
    end = event("turn.completed", usage={"input_tokens": 1, "cached_input_tokens": 0, "output_tokens": 2})
    msg = lambda items: event("item.completed", item={"type": "agent_message", "text": items if isinstance(items, str) else json.dumps({"items": items})})
    item = lambda i, a=7: {"problem_id": i, "target_text": f"We add the two parts first.\nFinal answer: {a}"}
    ok = msg([item("p"), item("q")])
    cases = {
        ("success", "qualified"): [ok, end], ("event_json", "malformed_event_json"): ["{x", end], ("unsafe_error_event", "unsafe_event_type"): [event("odd"), end], ("unsafe_error_event", "error_event"): [event("turn.failed"), end],
        ("unsafe_error_event", "invalid_item_event"): [event("item.started"), end], ("unsafe_error_event", "unsafe_item"): [event("item.started", item={"type": "command"}), end], ("terminal_usage", "multiple_terminal_events"): [ok, end, end],
        ("terminal_usage", "invalid_usage"): [ok, event("turn.completed", usage={"input_tokens": -1})], ("terminal_usage", "missing_terminal_event"): [ok], ("terminal_usage", "terminal_not_final"): [end, ok], ("agent_json", "missing_agent_message"): [end], ("agent_json", "multiple_agent_messages"): [ok, ok, end],
        ("agent_json", "malformed_agent_json"): [msg("nope"), end], ("output_schema", "invalid_output_schema"): [msg('{"rows":[]}'), end], ("output_schema", "invalid_item_schema"): [msg([{"problem_id": "p"}]), end], ("output_structure", "cardinality_mismatch"): [msg([item("p")]), end],
        ("output_structure", "id_set_mismatch"): [msg([item("p"), item("z")]), end], ("output_structure", "order_mismatch"): [msg([item("q"), item("p")]), end], ("target_policy", "target_policy_invalid"): [msg([item("p"), {"problem_id": "q", "target_text": "7"}]), end], ("target_policy", "wrong_target"): [msg([item("p"), item("q", 8)]), end],
    }
    rows = [(f"{s}/{c}", 0, None, "\n".join(x), ["p", "q"], {"p": "7", "q": "7"}) for (s, c), x in cases.items()]
    rows += [("process/runner_exception", 0, "runner_exception", "", ["p"], None), ("timeout_spawn/timeout", 124, None, "", ["p"], None), ("timeout_spawn/spawn_failure", 127, None, "", ["p"], None), ("nonzero/command_nonzero", 1, None, "", ["p"], None)]
    tool, odd = event("item.started", item={"type": "command"}), event("odd", error=1)
    for want, x in (("unsafe_item", [tool, odd, end]), ("unsafe_event_type", [odd, tool, end]), ("error_event", [event("item.started", error=None, item={"type": "command"}), end])):
        rows.append((f"unsafe_error_event/{want}", 0, None, "\n".join(x), ["p"], None))
    for usage in ({}, None, {"a": 1.5}, {"a": True}, {"": 1}, {"a": 1, "b": "2"}, [1], {"a": {"b": 1}}):
        rows.append(("terminal_usage/invalid_usage", 0, None, "\n".join([ok, event("turn.completed", usage=usage)]), ["p", "q"], None))
    for usage in ({"any": 0}, {"a": 10**30, 'quo"te\\': 3}):
        rows.append(("success/qualified", 0, None, "\n".join([ok, event("turn.completed", usage=usage)]), ["p", "q"], None))
    df = spark.createDataFrame(rows, "want string, returncode int, failure_reason string, stdout string, expected array<string>, answers map<string,string>")
    for r in classifier.classify(df).collect():
        assert f"{r.stage}/{r.code}" == r.want


def test_stream(spark, sf):
    from sievelight.streaming import attempts

    first = attempts.first_attempts(spark, f"{sf}/events.parquet", ["user_id"])
    assert first.count() >= spark.read.parquet(f"{sf}/events.parquet").select("user_id").distinct().count()


def run_line(**own):
    kinds = {"string": "x", "long": 7, "double": 0.5, "boolean": False}
    fields = [x.strip().rsplit(" ", 1) for x in jsonl.RUN_RECORD.replace("\n", " ").split(",")]
    return json.dumps({n: kinds[t] for n, t in fields} | {"sample_index": 0, "parse": {"status": "ok", "value": 1}} | own)


def test_run_records_are_read_strictly(spark, tmp_path):
    good = [run_line(problem_id=f"train-{i:06d}", seed=i) for i in (4, 2, 3)]
    cases = {
        run_line(problem_id="train-000001").replace('"seed": 7', '"seed": 7, "seed": 8'): "repeated_key", run_line(problem_id="train-000001").replace('"value": 1', '"value": {"a": [1, {"b": 1, "b": 2}]}'): "repeated_key",
        run_line(problem_id="train-000001", more=1): "key_set", run_line(problem_id="train-000001", latency_ms=float("nan")): "constant", run_line(problem_id="train-000001") + "{}": "invalid_json", run_line(problem_id="train-000001")[:-1]: "invalid_json", "": "blank_line", " \t": "blank_line",
        run_line(problem_id="train-000001", sample_index=1): "sample_index", run_line(problem_id="train-000001", sample_index=True): "types", run_line(problem_id="train-000001", sample_index=0.0): "types", run_line(problem_id="train-000001", seed="7"): "types", "[1]": "not_an_object", "7": "not_an_object", "﻿{}": "invalid_json",
    }
    expected = spark.createDataFrame([(9, "train-000003"), (7, "train-000002"), (8, "train-000004")], "ord long, problem_id string")
    rows, issues = jsonl.load_run(spark, put(tmp_path, "good.jsonl", "\n".join(good) + "\n"), expected)
    assert issues.collect() == []
    assert [(r.problem_id, r.seed, r.parse) for r in rows.collect()] == [(f"train-{i:06d}", i, '{"status":"ok","value":1}') for i in (2, 4, 3)]
    for i, (line, code) in enumerate(cases.items()):
        rows, issues = jsonl.load_run(spark, put(tmp_path, f"bad{i}.jsonl", "\n".join([*good, line]) + "\n"), expected)
        assert [r.code for r in issues.collect()] == [code], line
    _, issues = jsonl.load_run(spark, put(tmp_path, "ends.jsonl", "\n".join(good)), expected)
    assert [r.code for r in issues.collect()] == ["final_lf"]
    _, issues = jsonl.load_run(spark, put(tmp_path, "ids.jsonl", "\n".join([good[0], good[0], run_line(problem_id="train-000009"), run_line(problem_id="x")]) + "\n"), expected)
    assert sorted(map(tuple, issues.collect())) == [("train-000002", "missing"), ("train-000003", "missing"), ("train-000004", "duplicate"), ("train-000009", "extra"), ("x", "extra"), ("x", "id_form")]
    _, issues = jsonl.load_run(spark, put(tmp_path, "bytes.jsonl", good[0].encode() + b"\n" + good[1].replace('"x"', '"\xff"').encode("latin-1") + b"\n"), expected.limit(0))
    assert "encoding" in {r.code for r in issues.collect()}
    _, issues = jsonl.load_run(spark, put(tmp_path, "none.jsonl", ""), expected.limit(0))
    assert issues.collect() == []


def test_source_bank_is_published_whole_or_not_at_all(spark, tmp_path):
    plan = spark.createDataFrame([(30 - i, f"train-{i:06d}", "q") for i in range(30)], "ord long, problem_id string, question_sha256 string")
    accepted = plan.select("problem_id", F.concat(F.lit("ü "), "problem_id").alias("target_text"), *(F.lit(c).alias(c) for c in ("provider", "model_id", "model_revision", "prompt_sha256", "execution_sha256", "agent_message_sha256")), F.lit(5).alias("seed"))
    at = str(tmp_path / "bank")
    manifest = sinks.write_source_bank(plan, accepted, at, {"plan": "p1"})
    assert manifest["rows"] == 30 and manifest["plan"] == "p1" and sorted(p.name for p in tmp_path.iterdir()) == ["bank"]
    rows = sinks.load_source_bank(spark, at, plan).collect()
    assert [(r.problem_id, r.teacher.sample_index, r.target_text) for r in rows] == [(f"train-{29 - i:06d}", i, f"ü train-{29 - i:06d}") for i in range(30)]
    line = json.loads(sorted((tmp_path / "bank").glob("part-*"))[0].read_text().splitlines()[0])
    assert list(line) == sorted(line) and list(line["teacher"]) == sorted(line["teacher"]) and line["verification"]["status"] == "accepted"
    with pytest.raises(FileExistsError):
        sinks.write_source_bank(plan, accepted, at)
    for bad in (accepted.where("problem_id <> 'train-000007'"), accepted.unionByName(accepted.limit(1))):  # a task fails midway
        with pytest.raises(Exception, match="not exactly one"):
            sinks.write_source_bank(plan, bad, str(tmp_path / "other"))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["bank"]
    part = sorted((tmp_path / "bank").glob("part-*"))[0]
    part.write_text(part.read_text().replace("ü", "u"))
    (tmp_path / "bank" / f".{part.name}.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError, match="manifest"):
        sinks.load_source_bank(spark, at, plan)
