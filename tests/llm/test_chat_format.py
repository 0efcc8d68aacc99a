import json

from calorway.llm.chat_format import link_route_calls

ARGS = "struct<depart_iso:string,destination:string,max_alternatives:string,origin:string,profile:string,walk_speed_ms:string>"


def call(i, after, speed="1.35", depart="2026-07-01T12:00:00Z", most=None):
    return (i, after, (depart, "Bryant Park", most, "Grand Central", "standard", speed), "extra")


def test_links_order_validation_and_json(spark):
    calls = spark.createDataFrame([call("a", None), call("b", "a", "9"), call("c", "b", depart="soon", most="two"), call("x", "y"), call("y", "x"),
                                   call("z", "gone"), call(None, None)] + [call(f"k{n}", f"k{n - 1}" if n else None) for n in range(40)],
                                  f"request_id string, after string, arguments {ARGS}, status string")
    results = spark.createDataFrame([("a", 'ok "1"\n'), ("q", "lost"), (None, "none")], "request_id string, content string")
    got = {}
    for r in link_route_calls(calls, results).collect():
        got.setdefault(r["request_id"], []).append(r)
    assert got["a"][0]["status"] == "linked" and got["a"][0]["valid"] and got["a"][0]["depth"] == 0
    assert [got[k][0]["depth"] for k in "bcz"] == [1, 2, 0] and got["k39"][0]["depth"] == 39
    assert got["x"][0]["depth"] is None and got["y"][0]["depth"] is None
    assert got["b"][0]["errors"] == ["walk_speed_ms: above 3.0"]
    assert got["c"][0]["errors"] == ["depart_iso: not a timestamp", "max_alternatives: not a int"]
    assert got["q"][0]["status"] == "no_call" and sorted(r["status"] for r in got[None]) == ["no_call", "no_result"]
    text = got["a"][0]["record"]
    assert json.loads(text)["content"] == 'ok "1"\n' and text == json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"))


def test_empty_tables(spark):
    calls = spark.createDataFrame([], f"request_id string, after string, arguments {ARGS}")
    results = spark.createDataFrame([], "request_id string, content string")
    assert link_route_calls(calls, results).count() == 0


def _depths(waits):
    """Longest wait by plain recursion; None on or behind a circle."""
    parents = {}
    for i, after in waits:
        parents.setdefault(i, set()).add(after)

    def depth(i, seen):
        if i in seen:
            return None
        found = [depth(p, seen | {i}) for p in parents[i] if p in parents]
        return None if None in found else max([d + 1 for d in found], default=0)
    return {i: depth(i, frozenset()) for i in parents}


def test_longest_of_several_waits(spark):
    """A diamond with a long side, chains between, repeated rows, circles and what waits behind them, against recursion."""
    import random
    from calorway.llm.chat_format import request_depths
    waits = [("a", None), ("b", "a"), ("c", "b"), ("d", "a"), ("d", "c"), ("d", "c"), ("e", "d"), ("f", "e"), ("f", "a"), ("g", "gone"),
             ("x", "y"), ("y", "x"), ("z", "x"), ("z", "a"), ("w", "z"), ("s", "s"), ("t", "s")]
    got = {r["request_id"]: r["depth"] for r in request_depths(spark.createDataFrame(waits, "request_id string, after string")).collect()}
    assert got == _depths(waits) and got["d"] == 3 and got["f"] == 5 and got["w"] is None
    rng = random.Random(2)
    many = [(f"n{k:02d}", f"n{rng.randrange(k):02d}" if k else None) for k in range(60) for _ in range(rng.choice((1, 1, 1, 2)))]
    got = {r["request_id"]: r["depth"] for r in request_depths(spark.createDataFrame(many, "request_id string, after string")).collect()}
    assert got == _depths(many)


def test_query_keeps_turns_without_role_or_conversation(spark, tmp_path):
    from calorway.llm.queries import ORACLES, QUERIES
    rows = [(1, 0, "user", "hello"), (1, 1, None, "who?"), (1, 2, "user", None), (None, 0, "user", "lost"), (None, 1, "assistant", "too"),
            (None, None, None, None), (2, None, "user", "when"), (1, 1, "assistant", "again"), (1, 0, "user", "hello")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = sorted(map(str, (tuple(r[c] for c in sorted(r.asDict())) for r in QUERIES["op9_chat_format"](spark, str(tmp_path)).collect())))
    import duckdb
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    con.execute(ORACLES["op9_chat_format"])
    names = [d[0] for d in con.description]
    want = sorted(str(tuple(dict(zip(names, r))[c] for c in sorted(names))) for r in con.fetchall())
    assert sorted(set(got) ^ set(want)) == [] and got == want and len(got) == 9
