"""Staging from a local server: ranges, broken connections, tokens, redirects, refusals."""

import os
import re
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from carpalake.sources.remote import RangeReader, read_remote, stage_remote

BODY = os.urandom(300_000)


class Handler(BaseHTTPRequestHandler):
    protocol_version = "HTTP/1.1"

    def log_message(self, *_):
        pass

    def do_GET(self):
        state, span = self.server.state, re.fullmatch(r"bytes=(\d+)-(\d+)", self.headers.get("Range", ""))
        with state["lock"]:
            state["seen"].append((self.path, self.headers.get("Range"), self.headers.get("Authorization")))
            tries = sum(s[:2] == (self.path, self.headers.get("Range")) for s in state["seen"])
        kind = self.path.strip("/")
        if kind == "moved":
            self.send_response(302)
            self.send_header("Location", state["other"] + "/file")
            self.send_header("Content-Length", "0")
            return self.end_headers()
        if kind == "secret" and self.headers.get("Authorization") != "Bearer sesame":
            return self.refuse(403)
        if kind == "busy" and tries == 1:
            return self.refuse(503)
        body = b"" if kind == "empty" else BODY
        if kind == "changed" and self.headers.get("If-Match"):
            return self.refuse(412)
        if kind == "empty" and span:
            return self.refuse(416)
        part = body
        if span and kind != "plain":
            a, b = int(span[1]), min(int(span[2]), len(body) - 1)
            part = body[a : b + 1]
            self.send_response(206)
            self.send_header("Content-Range", f"bytes {a}-{b}/{len(body)}")
        else:
            self.send_response(200)
        if kind == "changed":
            self.send_header("ETag", '"1"')
        self.send_header("Content-Length", str(len(part)))
        self.end_headers()
        if kind == "broken" and len(part) > 1 and int(span[1]) % 70_000 == 0 and tries == 1 or kind == "dead" and len(part) > 1:
            self.wfile.write(part[: len(part) // 3])
            self.close_connection = True
            return None
        self.wfile.write(part)
        return None

    def refuse(self, code):
        self.send_response(code)
        self.send_header("Content-Length", "0")
        self.end_headers()


@pytest.fixture
def server():
    made = []
    for _ in range(2):
        one = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        one.state = {"lock": threading.Lock(), "seen": []}
        threading.Thread(target=one.serve_forever, daemon=True).start()
        made.append(one)
    made[0].state["other"] = f"http://127.0.0.1:{made[1].server_port}"
    made[0].url = f"http://127.0.0.1:{made[0].server_port}"
    made[0].other = made[1]
    yield made[0]
    for one in made:
        one.shutdown()
        one.server_close()


FAST = {"rangeBytes": 70_000, "waitSeconds": 0.01}


def test_ranges_are_partitions(spark, server, tmp_path):
    rows = read_remote(spark, f"{server.url}/file", **FAST)
    assert rows.rdd.getNumPartitions() == 5
    got = rows.orderBy("start").collect()
    assert b"".join(bytes(r.data) for r in got) == BODY and [(r.part, r.start, r.length) for r in got] == [(i, i * 70_000, min(70_000, 300_000 - i * 70_000)) for i in range(5)]
    steps, target = [], tmp_path / "model.bin"
    target.write_bytes(b"old")
    found = stage_remote(spark, f"{server.url}/file", str(target), progress=lambda at, total: steps.append((at, total)), **FAST)
    assert target.read_bytes() == BODY and steps[-1] == (300_000, 300_000) and len(steps) == 5
    assert sorted((r.start, r.retries) for r in found.collect()) == [(i * 70_000, 0) for i in range(5)]


def test_a_broken_range_is_taken_up(spark, server, tmp_path):
    found = stage_remote(spark, f"{server.url}/broken", str(tmp_path / "a"), **FAST).collect()
    assert (tmp_path / "a").read_bytes() == BODY and [r.retries for r in found] == [1] * 5
    asked = [s[1] for s in server.state["seen"]]
    assert f"bytes={70_000 // 3}-69999" in asked  # only the rest of the first range
    stage_remote(spark, f"{server.url}/busy", str(tmp_path / "b"), **FAST)
    assert (tmp_path / "b").read_bytes() == BODY


def test_a_server_without_ranges_is_one_partition(spark, server, tmp_path):
    stage_remote(spark, f"{server.url}/plain", str(tmp_path / "a"), **FAST)
    assert (tmp_path / "a").read_bytes() == BODY and read_remote(spark, f"{server.url}/plain").rdd.getNumPartitions() == 1
    stage_remote(spark, f"{server.url}/empty", str(tmp_path / "b"), least=0)
    assert (tmp_path / "b").read_bytes() == b""


def test_the_token_stays_with_its_host(spark, server, tmp_path):
    stage_remote(spark, f"{server.url}/secret", str(tmp_path / "a"), token="sesame", **FAST)
    stage_remote(spark, f"{server.url}/moved", str(tmp_path / "b"), token="sesame", **FAST)
    assert (tmp_path / "a").read_bytes() == (tmp_path / "b").read_bytes() == BODY
    assert {s[2] for s in server.state["seen"]} == {"Bearer sesame"} and {s[2] for s in server.other.state["seen"]} == {None}
    assert "sesame" not in read_remote(spark, f"{server.url}/secret", "sesame")._jdf.queryExecution().toString()


@pytest.mark.parametrize(("kind", "what"), [("secret", "403"), ("changed", "412"), ("dead", "ended early|IncompleteRead")])
def test_errors_leave_nothing(spark, server, tmp_path, kind, what):
    with pytest.raises(Exception, match=what):
        stage_remote(spark, f"{server.url}/{kind}", str(tmp_path / "a"), retries=1, **FAST)
    assert not list(tmp_path.iterdir())
    if kind == "secret":
        assert len(server.state["seen"]) <= 2  # refused at once, not tried again


def test_a_short_file_leaves_the_old_one(spark, server, tmp_path):
    (tmp_path / "a").write_bytes(b"old")
    with pytest.raises(ValueError, match="fewer than"):
        stage_remote(spark, f"{server.url}/file", str(tmp_path / "a"), least=300_001, **FAST)
    assert [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == ["a"] and (tmp_path / "a").read_bytes() == b"old"


def test_only_http():
    with pytest.raises(ValueError, match="http"):
        RangeReader({"url": "file:///etc/hostname"})
