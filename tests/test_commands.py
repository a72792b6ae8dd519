"""The command language, and whole sessions against the Python model."""

import random

import pytest
from model import Model

from palimpsest.functions.commands import parse
from palimpsest.operators import commands

ARITY = "wrong number of arguments for '{}'"
CASES = [
    ("PING", ("PING", None, None, None, None)),
    ("ping anything", ("PING", None, None, None, None)),
    ("quit", ("QUIT", None, None, None, None)),
    ("GET foo", ("GET", "foo", None, None, None)),
    ("del foo", ("DEL", "foo", None, None, None)),
    ("SET foo bar baz", ("SET", "foo", "bar baz", 0, None)),
    ("SET foo bar baz EX 30", ("SET", "foo", "bar baz", 30, None)),
    ("SET foo EX 30", ("SET", "foo", "EX 30", 0, None)),
    ("SET foo  EX 30", ("SET", None, None, None, ARITY.format("SET"))),
    ("SET foo  bar", ("SET", "foo", " bar", 0, None)),
    ("SET k v EX 5 EX 10", ("SET", "k", "v EX 5", 10, None)),
    ("SET k v ex 10", ("SET", "k", "v ex 10", 0, None)),
    ("SET k v EX 0", ("SET", "k", "v", 0, None)),
    ("SET k v EX 99999999999999999999", ("SET", None, None, None, "invalid EX value")),
    ("SET k a\rb EX 5", ("SET", "k", "a\rb EX 5", 0, None)),
    ("GET a b", ("GET", None, None, None, ARITY.format("GET"))),
    ("GET", ("GET", None, None, None, ARITY.format("GET"))),
    ("DEL", ("DEL", None, None, None, ARITY.format("DEL"))),
    ("SET foo", ("SET", None, None, None, ARITY.format("SET"))),
    ("GET\ta", ("GET\tA", None, None, None, "unknown command 'GET\tA'")),
    ("FOO bar", ("FOO", None, None, None, "unknown command 'FOO'")),
    ("  \t ", ("", None, None, None, "empty command")),
    ("\t get  x  ", ("GET", "x", None, None, None)),
    ("SET clé ügen EX 7", ("SET", "clé", "ügen", 7, None)),
]


def test_truth_table(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, line string")
    got = {r.i: tuple(r.c) for r in df.select("i", parse(df["line"]).alias("c")).collect()}
    assert [got[i] for i in range(len(CASES))] == [c[1] for c in CASES]


def answers(spark, lines, block=commands.BLOCK):
    df = spark.createDataFrame(lines, "seq long, ts_ms long, conn long, line string")
    found = commands.evaluate(commands.until_quit(commands.parsed(df)), block)
    return {r.seq: r.response for r in found.collect()}


def test_session(spark):
    lines = ["PING", "SET greeting hello world", "GET greeting", "DEL greeting", "GET greeting", "DEL greeting", "NOSUCHCOMMAND", "", "PING", "QUIT", "PING"]
    got = answers(spark, [(i, i, 0, x) for i, x in enumerate(lines)])
    assert got == {0: "+PONG", 1: "+OK", 2: "$hello world", 3: ":1", 4: "$-1", 5: ":0", 6: "-ERR unknown command 'NOSUCHCOMMAND'", 8: "+PONG", 9: "+OK"}


def test_time_to_live(spark):
    lines = [(0, 0, "SET k v EX 5"), (1, 4000, "GET k"), (2, 5000, "GET k"), (3, 5001, "DEL k"), (4, 6000, "SET k v EX 5"), (5, 6001, "SET k w"), (6, 999_999_999, "GET k"), (7, 0, "SET m v EX 9223372036854775807")]
    got = answers(spark, [(s, t, 0, x) for s, t, x in lines])
    assert got == {0: "+OK", 1: "$v", 2: "$-1", 3: ":0", 4: "+OK", 5: "+OK", 6: "$w", 7: "-ERR invalid EX value"}


@pytest.mark.parametrize("block", [1, 7, 50, commands.BLOCK])
def test_random_sessions(spark, block):
    rnd, model, lines, expected, now = random.Random(block), Model(), [], {}, 0
    for seq in range(600):
        now += rnd.randrange(0, 900)
        key = "hot" if rnd.random() < 0.4 else f"k{rnd.randrange(12)}"
        kind = rnd.random()
        if kind < 0.35:
            ttl = rnd.choice([None, 0, 1, 3])
            lines.append((seq, now, 0, f"SET {key} v{seq}" + ("" if ttl is None else f" EX {ttl}")))
            model.put(key, f"v{seq}", now + 1000 * ttl if ttl else 0)
            expected[seq] = "+OK"
        elif kind < 0.6:
            lines.append((seq, now, 0, f"DEL {key}"))
            expected[seq] = f":{int(model.delete(key, now))}"
        else:
            lines.append((seq, now, 0, f"GET {key}"))
            expected[seq] = f"${v}" if (v := model.live(key, now)) is not None else "$-1"
    assert answers(spark, lines, block) == expected


def test_no_commands(spark):
    assert answers(spark, []) == {}
