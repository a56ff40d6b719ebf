import json
import random

import pytest

from conftest import rows
from spanledger.operators import transcripts
from spanledger.sources import transcripts as source


def _apply(lines):
    """Line-by-line restatement of the mutation log; returns requests and rejected lines."""
    names = {"modelId": "model", "copilotCredits": "credits", "sessionCopilotCredits": "session_credits"}

    def usage(v):
        out = dict.fromkeys(names.values())
        if isinstance(v, dict):
            if isinstance(v.get("modelId"), str) and len(v["modelId"]) <= 512:
                out["model"] = v["modelId"]
            for k in ("copilotCredits", "sessionCopilotCredits"):
                if isinstance(v.get(k), (int, float)) and not isinstance(v.get(k), bool) and v[k] >= 0:
                    out[names[k]] = float(v[k])
        return out

    requests, rejected = [], 0
    for line in lines:
        try:
            r = json.loads(line)
        except ValueError:
            rejected += 1
            continue
        kind, key, v = r.get("kind"), r.get("k") or [], r.get("v")
        if kind == 0:
            requests = [usage(x) for x in (v or {}).get("requests") or []]
        elif not key or key[0] != "requests":
            continue
        elif len(key) == 1:
            if kind == 2:
                start = r.get("i", len(requests))
                if start < 0 or start > len(requests):
                    rejected += 1
                    continue
                requests[start:] = [usage(x) for x in v] if isinstance(v, list) else []
            elif kind in (1, 3):
                requests = [usage(x) for x in v] if isinstance(v, list) and kind != 3 else []
        else:
            i = key[1]
            if i < 0 or i > len(requests):
                rejected += 1
                continue
            if len(key) == 2 or (len(key) == 3 and key[2] in names):
                if i == len(requests):
                    requests.append(usage({}))
                if len(key) == 2:
                    requests[i] = usage({} if kind == 3 else v)
                else:
                    requests[i] = {**requests[i], names[key[2]]: usage({key[2]: None if kind == 3 else v})[names[key[2]]]}
    return requests, rejected


def _random_log(rnd, n):
    def req():
        return {k: v for k, v in (("modelId", rnd.choice(["a", "b", 7])), ("copilotCredits", rnd.choice([1, 2.5, -1, "3"])), ("sessionCopilotCredits", rnd.randrange(9))) if rnd.random() < 0.7}

    out = [json.dumps({"kind": 0, "v": {"requests": [req() for _ in range(rnd.randrange(3))]}})]
    for _ in range(n):
        i = rnd.randrange(-1, 7)
        out.append(rnd.choice([
            lambda: json.dumps({"kind": 2, "k": ["requests"], "v": [req() for _ in range(rnd.randrange(3))]}),
            lambda: json.dumps({"kind": 2, "k": ["requests"], "i": i, "v": [req() for _ in range(rnd.randrange(3))]}),
            lambda: json.dumps({"kind": rnd.choice([1, 3]), "k": ["requests", i], "v": req()}),
            lambda: json.dumps({"kind": rnd.choice([1, 3]), "k": ["requests", i, rnd.choice(["copilotCredits", "modelId", "other"])], "v": rnd.choice([4, "m"])}),
            lambda: json.dumps({"kind": 1, "k": ["customTitle"], "v": "t"}),
            lambda: json.dumps({"kind": rnd.choice([1, 3]), "k": ["requests"], "v": [req()]}) if rnd.random() < 0.2 else "broken",
        ])())
    return out


@pytest.mark.parametrize("hot_rows", [5, 10**9])
def test_replay_matches_line_by_line(spark, hot_rows):
    rnd = random.Random(11)
    logs = {f"s{i}": _random_log(rnd, 25) for i in range(12)}
    lines = spark.createDataFrame([(s, i, line) for s, log in logs.items() for i, line in enumerate(log)], "file_id STRING, seq BIGINT, line STRING")
    ops, _ = source.parse_ops(lines)
    good = ops.where("op <> 'bad'")
    got = {(r.session_id, r.idx): (r.model, r.credits, r.session_credits) for r in transcripts.replay(good, hot_rows).collect()}
    want, rejected = {}, 0
    for s, log in logs.items():
        requests, bad = _apply(log)
        rejected += bad
        want |= {(s, i): (r["model"], r["credits"], r["session_credits"]) for i, r in enumerate(requests)}
    assert got == want
    kept = transcripts.accepted_ops(good, hot_rows).count()
    assert ops.count() - kept == rejected


def _cost(spark, log):
    lines = spark.createDataFrame([("s", i, json.dumps(x)) for i, x in enumerate(log)], "file_id STRING, seq BIGINT, line STRING")
    ops, headers = source.parse_ops(lines)
    return transcripts.session_cost(transcripts.replay(ops)).collect(), transcripts.session_fields(headers).collect()


def test_session_cost_and_title(spark):
    snapshot = {"kind": 0, "v": {"sessionId": "s", "customTitle": " A \n b ", "requests": [
        {"modelId": "m1", "copilotCredits": 30}, {"copilotCredits": 50}, {"modelId": "m2", "copilotCredits": 0, "sessionCopilotCredits": 293.2}]}}
    (cost,), (title,) = _cost(spark, [snapshot])
    assert (cost.credits, cost.model, title.title) == (293.2, "m2", "A b")
    (cost,), _ = _cost(spark, [snapshot, {"kind": 1, "k": ["requests", 1, "copilotCredits"], "v": 300}])
    assert cost.credits == 330


def test_splice_push_delete(spark):
    log = [{"kind": 0, "v": {"requests": [{"copilotCredits": 1}]}}, {"kind": 2, "k": ["requests"], "i": 0, "v": [{"copilotCredits": 7}]}]
    assert _cost(spark, log)[0][0].credits == 7
    log.append({"kind": 3, "k": ["requests", 0, "copilotCredits"]})
    assert _cost(spark, log)[0][0].credits is None
    log.append({"kind": 2, "k": ["requests"], "v": [{"copilotCredits": 2}]})
    assert _cost(spark, log)[0][0].credits == 2


def test_jsonl_wins_over_json_and_index_overrides(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"sessionId": "a", "requests": [{"copilotCredits": 9}]}))
    (tmp_path / "a.jsonl").write_text(json.dumps({"kind": 0, "v": {"requests": [{"copilotCredits": 4}]}}) + "\n")
    (tmp_path / "b.json").write_text(json.dumps({"sessionId": "b", "requests": [{"copilotCredits": 2}]}, indent=1))
    scanned = source.transcript_scan(spark, str(tmp_path))
    ops, _ = source.parse_ops(scanned)
    cost = transcripts.session_cost(transcripts.replay(ops))
    assert sorted((r.session_id.rsplit("/", 1)[1], r.credits) for r in cost.collect()) == [("a", 4.0), ("b", 2.0)]
    index = spark.createDataFrame([("x", "New", 50, 0), ("x", "Newer", 50, 1), ("y", None, 7, 0)], "session_id STRING, title STRING, updated_ms BIGINT, ord INT")
    files = spark.createDataFrame([("x", "Old", 90, 5.0, "m", 0), ("z", "File", 3, None, None, 1)], "session_id STRING, title STRING, updated_ms BIGINT, credits DOUBLE, model STRING, ord INT")
    got = rows(transcripts.index_transcript_merge(index, files), "session_id", "title", "updated_ms", "credits")
    assert got == [("x", "Newer", 50, 5.0), ("y", None, 7, None), ("z", "File", 3, None)]


def test_history_index(spark):
    blobs = spark.createDataFrame([
        ("a", '{"version":1,"entries":{"k1":{"sessionId":"s1","title":" T ","lastMessageDate":5},"k2":{"lastMessageDate":0},"k3":{"lastMessageDate":-1},"k4":null}}'),
        ("b", '{"version":2,"entries":{"k":{"lastMessageDate":5}}}'), ("c", "broken")], "source STRING, value STRING")
    assert rows(source.history_index_scan(blobs), "session_id", "title", "updated_ms") == [("k2", None, 0), ("s1", "T", 5)]
    assert rows(source.index_status(blobs), "source", "status") == [("a", "ok"), ("b", "unsupported"), ("c", "malformed")]


def test_growth_counts_only_beyond_first_sight(spark):
    schema = "session_id STRING, credits DOUBLE"
    previous = spark.createDataFrame([("a", 5.0), ("e", 0.0)], schema)
    now = spark.createDataFrame([("a", 8.0), ("new", 9.0), ("e", 3.0), ("empty", None)], schema)
    got = rows(transcripts.transcript_growth(previous, now, now), "session_id", "credits", "growth")
    assert got == [("a", 8.0, 3.0), ("e", 3.0, 3.0), ("empty", 0.0, 0.0), ("new", 9.0, 0.0)]
