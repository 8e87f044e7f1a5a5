"""Texts from JSON lines, documents beside an index, and a paged endpoint served here."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from skarn.sources import absorb

LONG = "a text of more than ten letters"


@pytest.fixture(scope="module")
def endpoint():
    pages = {
        "/full": [[f"{LONG} {k}" for k in range(100)], {"documents": [{"preview": f"{LONG} p{k}"} for k in range(30)]}],
        "/keys": [{"results": [{"text": LONG}, {"content": LONG}, {"page_content": LONG}, {"text": "short"}, {"other": LONG}, 7, LONG, None]}],
        "/breaks": [[f"{LONG} {k}" for k in range(100)]],
        "/endless": [[f"{LONG} {k}" for k in range(100)]] * 60,
        "/none": [{}],
        "/odd": ["no list"],
    }

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            at = urlparse(self.path)
            number = int(parse_qs(at.query).get("page", ["0"])[0])
            own = pages.get(at.path, [])
            self.send_response(200 if number < len(own) else 500)
            self.end_headers()
            if number < len(own):
                self.wfile.write(json.dumps(own[number]).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_pages(spark, endpoint):
    rows = absorb.absorb(spark, f"{endpoint}/full").collect()
    assert len(rows) == 130 and {r.source for r in rows} == {"absorb:full"} and f"{LONG} p29" in {r.text for r in rows}
    assert [r.text for r in absorb.absorb(spark, f"{endpoint}/keys").collect()] == [LONG] * 4
    assert absorb.absorb(spark, f"{endpoint}/breaks").count() == 100  # the second page fails
    assert absorb.absorb(spark, f"{endpoint}/endless").count() == 5000  # fifty pages
    assert absorb.from_http(spark, f"{endpoint}/endless", pages=2).count() == 200
    assert absorb.absorb(spark, f"{endpoint}/none").count() == 0 and absorb.absorb(spark, f"{endpoint}/odd").count() == 0
    with pytest.raises(Exception, match="500"):
        absorb.absorb(spark, f"{endpoint}/missing").count()


def test_files(spark, tmp_path):
    lines = [json.dumps({"text": LONG, "source": "s"}), json.dumps({"text": "ten chars!"}), json.dumps({"text": " short "}), "no json", json.dumps({"other": LONG})]
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    path = str(tmp_path / "a.jsonl")
    want = [(LONG, "s"), ("ten chars!", "absorb:a.jsonl")]
    assert [tuple(r) for r in absorb.absorb(spark, path).collect()] == want == [tuple(r) for r in absorb.absorb(spark, "jsonl:" + path).collect()]
    with pytest.raises(ValueError, match="unknown source"):
        absorb.absorb(spark, str(tmp_path / "nothing.xyz"))


def test_index(spark, tmp_path):
    (tmp_path / "i.faiss").write_bytes(b"")
    index = str(tmp_path / "i.faiss")
    with pytest.raises(FileNotFoundError):
        absorb.absorb(spark, index)
    (tmp_path / "docstore.json").write_text(json.dumps({"x": LONG, "y": {"page_content": LONG + " y"}, "z": "ten chars!"}))
    assert {r.text for r in absorb.absorb(spark, index).collect()} == {LONG, LONG + " y"}
    (tmp_path / "i_metadata.json").write_text(json.dumps([{"text": LONG + " t"}, LONG]))
    assert {(r.text, r.source) for r in absorb.absorb(spark, "faiss:" + index).collect()} == {(LONG + " t", "absorb:i_metadata.json"), (LONG, "absorb:i_metadata.json")}
    (tmp_path / "i.jsonl").write_text(json.dumps({"text": LONG + " first"}))
    assert [r.text for r in absorb.absorb(spark, index).collect()] == [LONG + " first"]
    with pytest.raises(FileNotFoundError):
        absorb.absorb(spark, str(tmp_path / "none.index"))
