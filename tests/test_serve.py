"""Command lines against a durable store."""

import io

from palimpsest.plans import serve
from palimpsest.plans.store import Store


def test_sessions_share_a_store(spark, tmp_path):
    clock = [0]
    store = Store(spark, str(tmp_path / "s"), clock=lambda: clock[0])
    got = serve.answers(store, "PING\r\nSET greeting hello world\nGET greeting\n\nBAD\nSET t v EX 5\nQUIT\nPING\n")
    assert got == "+PONG\r\n+OK\r\n$hello world\r\n-ERR unknown command 'BAD'\r\n+OK\r\n+OK\r\n"
    clock[0] = 5000
    again = io.StringIO()
    serve.repl(Store(spark, store.base, clock=store.clock), ["GET t\n", "DEL greeting\n", "DEL greeting\n", "GET greeting\n"], again)
    assert again.getvalue() == "$-1\r\n:1\r\n:0\r\n$-1\r\n"


def test_batches_see_the_store_and_each_other(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), flush_bytes=20, trigger=2, clock=lambda: 100)
    lines = lambda *xs: spark.createDataFrame([(i, 10 * i, i % 2, x) for i, x in enumerate(xs)], "seq long, ts_ms long, conn long, line string")
    run = lambda *xs: [r.response for r in sorted(serve.execute(store, lines(*xs)).collect())]
    assert run("SET a 1", "SET b 2", "GET a", "DEL b", "DEL b") == ["+OK", "+OK", "$1", ":1", ":0"]
    assert run("GET a", "GET b", "SET a 3", "QUIT", "GET a", "SET a lost") == ["$1", "$-1", "+OK", "+OK", "$3"]
    assert run("SET c " + "x" * 30, "DEL a") == ["+OK", ":1"]
    assert {bytes(r.key) for r in store.snapshot().collect()} == {b"c"}
    assert run() == []


def test_only_lf_ends_a_line_and_long_lines_are_errors(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), clock=lambda: 100)
    value, error = "a\x0bb\x0cc\x85d\u2028e\rf", "-ERR line exceeds maximum length of 1048576 bytes\r\n"
    most = "x" * ((1 << 20) - len("SET b "))
    got = serve.answers(store, f"SET a {value}\r\nGET a\nSET b {most}\nSET b {most}\r\nSET a {most}y\nGET a")
    assert got == f"+OK\r\n${value}\r\n+OK\r\n{error}{error}${value}\r\n"


def test_files_of_commands(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1").write_bytes(b"SET a x\x0by\r\n\nGET a\r\nQUIT\nGET a\n")
    (tmp_path / "in" / "2").write_bytes(b"GET a\nSET b " + b"z" * (1 << 20) + b"\nDEL a\nDEL a")
    store = Store(spark, str(tmp_path / "s"), clock=lambda: 100)
    got = [r.response for r in serve.execute_files(store, str(tmp_path / "in")).orderBy("seq").collect()]
    assert got == ["+OK", "$x\x0by", "+OK", "$x\x0by", "-ERR line exceeds maximum length of 1048576 bytes", ":1", ":0"]
    assert store.snapshot().count() == 0
