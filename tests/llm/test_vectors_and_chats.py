"""Vector operators and chat formatting against brute force."""
import json
import math
import random

import numpy as np

from tidewire.llm import chat, vectors
from tidewire.llm.queries import TOOLS

SCHEMA = "vec_id long, embedding array<float>, label int, n long, v string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], SCHEMA)


def sample(seed, n=300, dims=16):
    draw = np.random.default_rng(seed)
    m = draw.normal(size=(n, dims)).astype(np.float32)
    for i in range(0, n, 3):
        m[i] = m[i // 2] + draw.normal(size=dims) * 0.05
    m[10] = m[11] = m[12]
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(m)]
    return rows + [(n, None), (n + 1, []), (n + 2, [1.0, None]), (n + 3, [math.nan, 1.0]), (n + 4, [math.inf]), (n + 5, [0.0] * dims), (None, rows[0][1])]


def test_top_k_is_exact(spark):
    rows = sample(1)
    good = {i: np.floor(np.array(v, float) * 256).astype(int) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    expected = set()
    for q in good:
        if q % 50 == 0:
            best = sorted((-int(good[q] @ good[c]), c) for c in good if c != q)[:5]
            expected |= {(q, k + 1, c, -s) for k, (s, c) in enumerate(best)}
    assert {tuple(r) for r in vectors.top_k(table(spark, rows)).collect()} == expected
    few = vectors.top_k(table(spark, rows[:3])).collect()
    assert len(few) == 2
    assert vectors.top_k(table(spark, rows[1:3])).count() == 0


def test_threshold_stops_early_and_keeps_ties():
    ids = np.arange(2000)
    matrix = np.zeros((2000, 2), dtype=np.int64)
    matrix[:, 0] = ids[::-1]
    lists = vectors.Lists(ids, matrix)
    assert lists.search(np.array([1, 0]), -1, 3, []) == [(-1999, 0), (-1998, 1), (-1997, 2)]
    tied = vectors.Lists(ids, np.ones((2000, 2), dtype=np.int64))
    assert tied.search(np.array([1, 1]), 0, 3, []) == [(-2, 1), (-2, 2), (-2, 3)]


def test_near_vectors(spark):
    rows = sample(2)
    good = {i: np.array(v, float) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    ids = sorted(good)
    m = np.array([good[i] / np.linalg.norm(good[i]) for i in ids])
    near = m @ m.T >= 0.9
    np.fill_diagonal(near, False)
    got = {r.vec_id: r for r in vectors.near_duplicates(table(spark, rows)).collect()}
    assert len(got) == len(rows)
    found = sum(got[i].n_links for i in ids)
    assert 0.97 * near.sum() <= found <= near.sum()
    label = dict(zip(ids, ids))
    for _ in range(len(ids)):
        for a, i in enumerate(ids):
            for b in np.flatnonzero(near[a]):
                label[i] = label[ids[b]] = min(label[i], label[ids[b]])
    assert sum(got[i].component_id != label[i] for i in ids) <= 3
    for i, v in rows:
        if i not in good:
            assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, i is not None)


def test_top_k_of_rows_that_share_an_id(spark):
    rows = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (1, [2.0, 0.0]), (1, [2.0, 0.0]), (100, [0.5])]
    got = vectors.top_k(table(spark, rows), k=9).collect()
    vector = lambda v: np.floor(256 * np.array(v + [0.0] * (2 - len(v)))).astype(int)
    expected = []
    for a, (i, v) in enumerate(rows):
        if i % 50 == 0:
            scores = sorted((-int(vector(v) @ vector(w)), j) for b, (j, w) in enumerate(rows) if a != b)
            expected += [(i, rank, j, -s) for rank, (s, j) in enumerate(scores, 1)]
    assert sorted(map(tuple, got)) == sorted(expected)
    assert vectors.top_k(table(spark, rows).limit(0)).count() == 0


def test_near_vectors_that_share_an_id(spark):
    rows = [(5, [1.0, 0.0]), (5, [0.0, 1.0]), (3, [1.0, 0.01]), (7, [0.0, 2.0]), (7, [0.0, 2.0]), (9, [-1.0, 0.0]), (9, None)]
    got = sorted(map(tuple, vectors.near_duplicates(table(spark, rows)).collect()))
    assert got == sorted([(5, 1, 3, False), (5, 2, 5, True), (3, 1, 3, True), (7, 2, 5, False), (7, 2, 5, False), (9, 0, 9, True), (9, 0, 9, True)])
    assert vectors.near_duplicates(table(spark, rows).limit(0)).count() == 0


def test_large_buckets_are_cut_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(vectors, "GROUP", 16)
    base = np.random.default_rng(3).normal(size=8)
    rows = [(i, [float(x) for x in base + 0.001 * i * np.eye(8)[i % 8]]) for i in range(70)]
    got = vectors.near_duplicates(table(spark, rows)).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(69, 0)}


def test_chats(spark):
    calls = {
        "tool_calls": [
            {"id": "a", "name": "search", "arguments": {"query": "x", "limit": 3}},
            {"id": "b", "name": "search", "arguments": '{"limit":"3","query":"q"}', "depends_on": ["a"]},
            {"id": "c", "name": "search", "arguments": {"limit": 3}, "depends_on": ["missing", "b"]},
            {"id": "d", "name": "unknown", "arguments": {}},
        ]
    }
    cycle = {"tool_calls": [{"id": "x", "name": "fetch", "arguments": {"url": "u", "headers": {"b": 1, "a": 2}}, "depends_on": ["y"]}, {"id": "y", "name": "calculate", "arguments": [1], "depends_on": ["x"]}]}
    rows = [
        (1, 0, "user", "hi ü", 1),
        (1, 1, "assistant", json.dumps(calls), 1),
        (1, 2, "tool", json.dumps({"tool_call_id": "a", "content": "r"}), 1),
        (2, 0, "assistant", json.dumps(cycle), 1),
        (2, 1, "assistant", "{not json", 1),
        (2, 1, "assistant", "{not json", 1),
        (None, None, None, None, 1),
        (3, 0, "assistant", None, 1),
        (3, 1, "user", "", 1),
    ]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, level int")
    schemas = spark.createDataFrame(TOOLS, "tool string, parameters string")
    got = chat.format_chats(messages, schemas).collect()
    assert len(got) == len(rows)
    by = {(r.conv_id, r.turn): r for r in got}
    assert tuple(by[1, 1])[3:7] == (4, 1, 1, 2)
    assert tuple(by[2, 0])[3:7] == (2, 0, 1, None)
    assert tuple(by[2, 1])[3:7] == (0, 0, 0, 0)
    assert by[1, 0].message == '{"content":"hi ü","role":"user"}'
    told = json.loads(by[1, 1].message)["tool_calls"]
    assert [(c["id"], c["level"], c["linked"], c["valid"]) for c in told] == [("a", 0, True, True), ("d", 0, False, False), ("b", 1, False, False), ("c", 2, False, False)]
    assert json.loads(by[2, 0].message)["tool_calls"][0]["arguments"] == '{"headers":{"a":2,"b":1},"url":"u"}'
    assert by[3, 0].message == '{"content":null,"role":"assistant"}' and by[None, None].message == '{"content":null,"role":null}'
    assert chat.format_chats(messages.limit(0), schemas).count() == 0


def fits(value, schema, top=True):
    """A plain reading of the keywords that are validated."""
    kinds = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list, "null": type(None)}
    types = [schema["type"]] if isinstance(schema.get("type"), str) else schema.get("type")
    if types is not None and not any(isinstance(value, kinds[t]) and not (isinstance(value, bool) and t in ("integer", "number")) for t in types):
        return False
    if "enum" in schema and value not in schema["enum"]:
        return False
    if isinstance(value, dict):
        known = schema.get("properties", {})
        closed = not schema["additionalProperties"] if "additionalProperties" in schema else top
        if set(schema.get("required", [])) - set(value) or (closed and set(value) - set(known)):
            return False
        return all(fits(v, known[k], False) for k, v in value.items() if k in known)
    if isinstance(value, list) and "items" in schema:
        return all(fits(v, schema["items"], False) for v in value)
    return True


DEEP = {
    "type": "object",
    "required": ["mode"],
    "properties": {
        "mode": {"enum": ["fast", "slow", 3]},
        "size": {"type": ["integer", "string"]},
        "where": {"type": "object", "required": ["lat"], "additionalProperties": False, "properties": {"lat": {"type": "number"}, "tags": {"type": "array", "items": {"type": "string"}}}},
        "any": {},
    },
}


def test_schemas_at_every_depth(spark):
    draw = random.Random(5)
    pick = lambda *c: draw.choice(c)
    rows, expected = [], {}
    for i in range(500):
        where = {"lat": pick(1, 2.5, "x"), **pick({}, {"tags": []}, {"tags": ["a", "b"]}, {"tags": ["a", 1]}, {"tags": 3}, {"other": 1})}
        if draw.random() < 0.2:
            where.pop("lat")
        args = {"mode": pick("fast", "slow", 3, "other"), **pick({}, {"size": 1}, {"size": "1"}, {"size": 1.5}, {"size": True}), **pick({}, {"where": where}, {"where": 1}), **pick({}, {"any": [1, {"z": 2}]}, {"extra": 0})}
        if draw.random() < 0.1:
            args.pop("mode")
        expected[i] = fits(args, DEEP)
        rows.append((i, 0, "assistant", json.dumps({"tool_calls": [{"id": "a", "name": "deep", "arguments": args}]})))
    schemas = spark.createDataFrame([("deep", json.dumps(DEEP))], "tool string, parameters string")
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), schemas).collect()
    assert {r.conv_id: r.n_valid == 1 for r in got} == expected
    assert 10 < sum(expected.values()) < 400


def test_random_call_graphs(spark):
    draw = random.Random(6)
    rows, expected = [], {}
    for conv in range(25):
        n = draw.randint(1, 7)
        needs = {i: [j for j in range(n + 1) if j != i and draw.random() < 0.2] for i in range(n)}
        level, changed = {}, True
        while changed:  # n itself isn't there and is left out
            changed = False
            for i in range(n):
                own = [j for j in needs[i] if j < n]
                if i not in level and all(j in level for j in own):
                    level[i], changed = 1 + max((level[j] for j in own), default=-1), True
        expected[conv] = [(f"t{i}", level.get(i)) for i in sorted(range(n), key=lambda i: (level.get(i, 99), i))]
        calls = [{"id": f"t{i}", "name": "x", "arguments": {}, "depends_on": [f"t{j}" for j in needs[i]]} for i in range(n)]
        rows.append((conv, 0, "assistant", json.dumps({"tool_calls": calls})))
    schemas = spark.createDataFrame(TOOLS, "tool string, parameters string")
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), schemas).collect()
    assert {r.conv_id: [(c["id"], c["level"]) for c in json.loads(r.message)["tool_calls"]] for r in got} == expected
    assert any(level is None for calls in expected.values() for _, level in calls)


def test_top_k_gathers_no_queries_in_the_driver_and_meets_all_shares(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 64)
    monkeypatch.setattr(vectors, "SHARE", 64 * 8 * 2)
    monkeypatch.setattr(vectors, "QUERIES", 8)
    monkeypatch.setattr(vectors, "TASKS", 16)
    draw = np.random.default_rng(5)
    for scale in (1.0, 1000.0, 1e7):
        m = draw.standard_normal((700, 8)) * scale
        df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)], "vec_id long, embedding array<double>")
        found = vectors.top_k(df, every=10)
        assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
        whole = np.floor(m * 256).astype(np.int64)
        expected = set()
        for q in range(0, 700, 10):
            scores = whole @ whole[q]
            order = sorted((-int(s), i) for i, s in enumerate(scores) if i != q)[:5]
            expected |= {(q, rank + 1, i, -s) for rank, (s, i) in enumerate(order)}
        assert {tuple(r) for r in found.collect()} == expected
