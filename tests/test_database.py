"""Collections, documents, indexes, changes, joins and the command surface."""

import pytest

from pathquill.errors import CollectionExistsError, CollectionNotFoundError, IndexMismatchError, NotFoundError, ReadOnlyError, UniqueViolationError
from pathquill.sources.commands import Requests, Session
from pathquill.sources.database import Database


@pytest.fixture(scope="module")
def db(spark, tmp_path_factory):
    db = Database(spark, f"{tmp_path_factory.mktemp('db')}/one")
    db.put_all("nums", [{"f": {"b": i}, "n": i} for i in range(1, 11)])
    db.put_all("mixed", [{"v": 3}, {"v": "x"}, {"v": None}, {}, {"v": True}, {"v": 1.5}, {"v": [1, 2]}])
    artist = db.put("artists", {"name": "Ada", "years": [1901, 1950]})
    db.put_all("paintings", [{"name": "A", "ref": artist}, {"name": "B", "ref": 99}])
    return db


def ids(rows):
    return [i for i, _ in rows]


def test_documents(db):
    i = db.put("c", {"a": 1})
    assert db.get("c", i) == {"a": 1}
    db.put("c", {"a": 2}, 20)
    assert db.put("c", [1, 2]) == 21
    assert db.patch("c", 20, {"b": None, "a": 3}) == {"a": 3}
    assert db.merge_or_put("c", 40, {"z": 1}) == {"z": 1}
    db.delete("c", 40)
    for id in (40, 7):
        with pytest.raises(NotFoundError):
            db.get("c", id)
    with pytest.raises(CollectionNotFoundError):
        db.get("none", 1)
    assert db.list("@none/*") == []


def test_filters(db):
    assert ids(db.list("@nums/f/[b > 7] | asc /n")) == [8, 9, 10]
    assert ids(db.list("@nums/*/[b in [2,4]] | desc /n")) == [4, 2]
    assert ids(db.list("@nums/=[3,1,3]")) == [3, 1, 3]
    assert ids(db.list("@nums/* | limit 2")) == [10, 9]
    assert ids(db.list("@nums/* | inverse skip 1 limit 2")) == [2, 3]
    assert db.count("@nums/f/[b >= 3 and b < 6] | count") == 3
    assert ids(db.list("@mixed/* | asc /v")) [:3] == [4, 3, 5]
    assert sorted(ids(db.list("@mixed/[v < 5]"))) == [1, 3, 6]
    assert ids(db.list("@mixed/[v ni 2]")) == [7]


def test_join(db):
    got = dict(db.list("@paintings/* | /{name,ref<artists} + /ref/name"))
    assert got == {1: {"name": "A", "ref": {"name": "Ada"}}, 2: {"name": "B", "ref": 99}} or got[2] == {"name": "B"}


def test_changes(db):
    db.put_all("m", [{"k": i} for i in range(6)])
    assert db.count('@m/[k > 3] | apply {"big":true} | count') == 2
    assert sorted(ids(db.list("@m/[big = true]"))) == [5, 6]
    assert dict(db.list('@m/[k = 0] | apply [{"op":"increment","path":"/k","value":10}] | /k')) == {1: {"k": 10}}
    assert ids(db.list("@m/* | del | asc /k limit 2")) in ([2, 3], [3, 2])
    assert db.count("@m/* | count") == 4
    assert ids(db.list('@m/[u = 1] | upsert {"u":1}')) == [7]
    assert ids(db.list('@m/[u = 1] | upsert {"u":1,"w":2}')) == [7]
    assert db.get("m", 7) == {"u": 1, "w": 2}


def test_indexes(db):
    db.put_all("ix", [{"a": 1, "s": "x"}, {"a": 2, "s": "x"}, {"a": None}])
    db.ensure_index("ix", "/a", "integer", unique=True)
    db.ensure_index("ix", "/a", "integer", unique=True)
    with pytest.raises(IndexMismatchError):
        db.ensure_index("ix", "/a", "integer")
    with pytest.raises(UniqueViolationError):
        db.ensure_index("ix", "/s", "string", unique=True)
    with pytest.raises(UniqueViolationError):
        db.put("ix", {"a": 2})
    assert db.count("@ix/* | count") == 3
    assert "SELECTED UNIQUE|integer 3 /a EXPR1: 'a > 1'" in db.explain("@ix/[a > 1]")
    db.remove_index("ix", "/a", "integer")
    assert db.put("ix", {"a": 2}) == 4


def test_collections(db, tmp_path):
    db.put("old", {"a": 1})
    db.rename_collection("old", "new")
    assert db.get("new", 1) == {"a": 1}
    with pytest.raises(CollectionNotFoundError):
        db.rename_collection("old", "x")
    with pytest.raises(CollectionExistsError):
        db.rename_collection("new", "nums")
    db.remove_collection("new")
    db.remove_collection("new")
    assert db.backup(str(tmp_path / "copy")) > 0
    copy = Database(db.spark, str(tmp_path / "copy"), "r")
    assert copy.count("@nums/* | count") == 10
    with pytest.raises(ReadOnlyError):
        copy.put("nums", {})
    assert {c["name"] for c in copy.info()["collections"]} >= {"nums", "mixed"}


def test_visit(db):
    seen = []
    db.visit("@nums/* | asc /n limit 3", lambda i, d: seen.append(i) or (-1 if seen == [1] else 2 if len(seen) == 2 else None))
    assert seen == [1, 1, 3]


def test_commands(db):
    s = Session(db)
    assert s.command('k1 add cmd {"a":1}') == ["k1\t1"]
    assert s.command("k2 get cmd 1") == ['k2\t1\t{"a": 1}']
    assert s.command("k3 query cmd /[a = 1]") == ['k3\t1\t{"a":1}', "k3"]
    assert s.command("k4 @cmd/* | count") == ["k4\t1"]
    assert s.command("k5 get cmd 9")[0].startswith("k5 ERROR:")
    assert s.command("k6 query cmd a/b")[0].startswith("k6 ERROR:")


def test_requests(db):
    r = Requests(db, token="t", anonymous_read=True)
    own = {"X-Access-Token": "t"}
    assert r.handle("POST", "/web", '{"a":1}', own).body == "1"
    assert r.handle("PATCH", "/web/1", '{"b":2}', own).status == 200
    assert r.handle("GET", "/web/1").status == 200
    assert r.handle("GET", "/web/9").status == 404
    assert r.handle("POST", "/web", "{", own).status == 400
    assert r.handle("PUT", "/web/1", "{}").status == 401
    assert r.handle("PUT", "/web/1", "{}", {"X-Access-Token": "x"}).status == 403
    assert r.handle("POST", "/", "@web/* | del").status == 403
    assert r.handle("POST", "/", "@web/[a = 1]").body == '\r\n1\t{"a":1,"b":2}'
    assert r.handle("POST", "/", "@web/* | count", own).body == "1"
    assert r.handle("DELETE", "/web/1", "", own).status == 200


def test_server(db):
    """Documents by HTTP, a query's answer in chunks, and commands by WebSocket."""
    import base64
    import http.client
    import os
    import socket
    import threading

    from pathquill.sources import server

    db.put_all("served", [{"a": 1}, {"a": 2}])
    s = server.serve(db, token="t")
    threading.Thread(target=s.serve_forever, daemon=True).start()
    try:
        con = http.client.HTTPConnection(*s.server_address)

        def ask(method, path, body=None, token="t"):
            con.request(method, path, body, {"X-Access-Token": token} if token else {})
            got = con.getresponse()
            return got.status, got.read().decode()

        assert ask("GET", "/served/2") == (200, '{\n "a": 2\n}')
        assert ask("GET", "/served/2", token=None)[0] == 401
        assert ask("POST", "/", "@served/[a > 0] | asc /a") == (200, '\r\n1\t{"a":1}\r\n2\t{"a":2}')
        raw = socket.create_connection(s.server_address)
        key = base64.b64encode(os.urandom(16)).decode()
        raw.sendall(f"GET / HTTP/1.1\r\nHost: x\r\nUpgrade: websocket\r\nConnection: Upgrade\r\nX-Access-Token: t\r\nSec-WebSocket-Key: {key}\r\n\r\n".encode())
        stream = raw.makefile("rb")
        assert b"101" in stream.readline()
        headers = b"".join(iter(stream.readline, b"\r\n")).decode()
        assert server.accept_key(key) in headers
        for text, wanted in (("k1 get served 1", 'k1\t1\t{"a": 1}'), ("k2 @served/* | count", "k2\t2")):
            mask, data = b"\x01\x02\x03\x04", text.encode()
            raw.sendall(bytes([0x81, 0x80 | len(data)]) + mask + bytes(b ^ mask[i % 4] for i, b in enumerate(data)))
            assert server.read_message(stream.read, 1 << 20) == (server.TEXT, wanted.encode())
        raw.sendall(bytes([0x88, 0x80]) + bytes(4))
        assert server.read_message(stream.read, 1 << 20)[0] == server.CLOSE
    finally:
        s.shutdown()


def test_crashes_and_locks(db, spark, tmp_path, monkeypatch):
    """A change that fails, a torn catalog and a lock left behind leave the state before; old files go in the end."""
    from pathquill.sources import database

    one = Database(spark, str(tmp_path / "x"))
    one.put_all("c", [{"a": i} for i in range(3)])
    with pytest.raises(RuntimeError), one.change() as state:
        state["collections"].clear()
        raise RuntimeError
    assert one.count("@c/* | count") == 3
    version = one.catalog()["version"]
    (tmp_path / "x" / f"catalog-{version + 1:012d}.json").write_text('{"version": 9')
    assert one.count("@c/* | count") == 3
    (tmp_path / "x" / "writer.lock").write_text('{"owner": "gone", "until": 1}')
    assert one.put("c", {"a": 9}) == 4
    (tmp_path / "x" / "writer.lock").write_text('{"owner": "there", "until": 9e12}')
    monkeypatch.setattr(database, "WAIT", 0.2)
    with pytest.raises(database.EngineError):
        one.put("c", {"a": 9})
    (tmp_path / "x" / "writer.lock").unlink()
    monkeypatch.setattr(database, "DELTAS", 2)
    for i in range(4):
        one.put("c", {"a": 10 + i}, 2)
    one.delete("c", 1)
    assert dict(one.list("@c/* | /a")) == {2: {"a": 13}, 3: {"a": 2}, 4: {"a": 9}}
    assert one.info()["collections"][0]["rnum"] == 3
    kept = [p.name for p in (tmp_path / "x").iterdir()]
    assert len([n for n in kept if n.startswith("catalog-") and not n.endswith(".crc")]) == database.KEPT
