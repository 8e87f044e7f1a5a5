"""Pages of a workspace from a server that answers like the interface it stands for."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from skarn.core.durable import cut
from skarn.sources import workspace

rich = lambda t: {"rich_text": [{"plain_text": t[:2]}, {"plain_text": t[2:]}]}
BLOCKS = [("heading_1", "Top"), ("heading_2", "Under"), ("bulleted_list_item", "point"), ("numbered_list_item", "first"), ("code", "x = 1"), ("quote", "said"), ("paragraph", ""), ("paragraph", "plain")]


@pytest.fixture(scope="module")
def api():
    listed = [{"id": f"p{k}", "last_edited_time": f"2024-03-0{k + 1}T10:00:00Z", "properties": {"Name": {"type": "title", "title": [{"plain_text": f"Page {k}"}]}}} for k in range(5)]
    listed[4]["properties"] = {}
    blocks = {"p0": [{"type": t, t: rich(x)} for t, x in BLOCKS], "p1": [{"type": "paragraph", "paragraph": rich("w" * 150)}] * 250, "p2": [], "p4": [{"type": "image"}]}

    class Handler(BaseHTTPRequestHandler):
        def answer(self, found, cursor, size):
            start = int(cursor or 0)
            self.send_response(200)
            self.end_headers()
            more = start + size < len(found)
            self.wfile.write(json.dumps({"results": found[start : start + size], "has_more": more, "next_cursor": str(start + size) if more else None}).encode())

        def do_POST(self):
            ask = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            if self.headers["Authorization"] != "Bearer key":
                self.send_response(401)
                self.end_headers()
                return
            self.answer(listed, ask.get("start_cursor"), ask["page_size"])

        def do_GET(self):
            page = self.path.split("/")[2]
            if page not in blocks:
                self.send_response(404)
                self.end_headers()
                return
            cursor = self.path.partition("start_cursor=")[2]
            self.answer(blocks[page], cursor, 100)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_pull(spark, api):
    first = cut(workspace.pull(spark, "key", api=api, page_size=2, tasks=3))
    rows = {r.id: r for r in first.collect()}
    assert set(rows) == {f"p{k}" for k in range(5)}
    assert rows["p0"].text == "[notion 2024-03-01 Page 0]\n\n# Top\n\n## Under\n\n- point\n\n1. first\n\n```\nx = 1\n```\n\n> said\n\nplain"
    assert rows["p1"].text.endswith("w\n\n[truncated]") and len(rows["p1"].text) == 20_000 + len("\n\n[truncated]")
    assert rows["p2"].text == "[notion 2024-03-03 Page 2]" and rows["p4"].text == "[notion 2024-03-05 (untitled)]"
    assert rows["p3"].text is None and "404" in rows["p3"].error
    marks = cut(workspace.marks_of(first))
    assert {r.id for r in workspace.pull(spark, "key", marks, api=api).collect()} == {"p3"}  # unread ones again
    older = spark.createDataFrame([("p0", "2024-01-01T00:00:00Z"), ("p9", "2024-01-01T00:00:00Z")], "id string, edited string")
    assert {r.id for r in workspace.pull(spark, "key", older, api=api).collect()} == {f"p{k}" for k in range(5)}
    assert {(r.id, r.edited[:7]) for r in workspace.marks_of(first, older).collect()} == {("p0", "2024-03"), ("p1", "2024-03"), ("p2", "2024-03"), ("p4", "2024-03"), ("p9", "2024-01")}
    with pytest.raises(Exception, match="401"):
        workspace.pull(spark, "wrong", api=api)
