"""GET / for a page, POST /api/analyze {"filename", "source"} for one text's result. One session serves all requests."""

from __future__ import annotations

import json
import sys
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

PAGE = """<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>tallyforge</title></head><body>
<h1>tallyforge</h1><p><input id="f" value="example.py"></p><p><textarea id="s" rows="20" cols="80"></textarea></p>
<p><button onclick="go()">Analyze</button></p><pre id="o"></pre>
<script>async function go(){const r=await fetch("/api/analyze",{method:"POST",headers:{"Content-Type":"application/json"},
body:JSON.stringify({filename:f.value,source:s.value})});o.textContent=JSON.stringify(await r.json(),null,2)}</script></body></html>
"""


def handler(analyze):
    """analyze(filename, source): a result as a dictionary; ValueError where the text can't be analyzed."""

    class Handler(BaseHTTPRequestHandler):
        def send(self, code: int, body: str, kind: str = "application/json") -> None:
            data = body.encode()
            self.send_response(code)
            self.send_header("Content-Type", f"{kind}; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self):  # noqa: N802
            if self.path == "/":
                self.send(200, PAGE, "text/html")
            else:
                self.send(404, json.dumps({"error": "not found"}))

        def do_POST(self):  # noqa: N802
            if self.path != "/api/analyze":
                return self.send(404, json.dumps({"error": "not found"}))
            try:
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)))
                filename, source = body["filename"], body["source"]
                if not isinstance(filename, str) or not isinstance(source, str):
                    raise TypeError
            except (ValueError, KeyError, TypeError):
                return self.send(400, json.dumps({"error": "send a JSON object with the texts filename and source"}))
            try:
                return self.send(200, json.dumps(analyze(filename, source)))
            except ValueError as e:
                return self.send(400, json.dumps({"error": str(e)}))
            except Exception as e:
                return self.send(500, json.dumps({"error": str(e)}))

        def log_message(self, *args):
            pass

    return Handler


def server(spark, bind: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    from .plans.analyze import analyze_source
    from .sinks import output

    lock = threading.Lock()

    def analyze(filename: str, source: str) -> dict:
        with lock:
            with analyze_source(spark, filename, source) as result:
                return output.to_dict(result)

    return ThreadingHTTPServer((bind, port), handler(analyze))


def serve(bind: str, port: int) -> int:
    from .cli import session

    s = server(session(), bind, port)
    print(f"http://{s.server_address[0]}:{s.server_address[1]}/", file=sys.stderr, flush=True)
    s.serve_forever()
    return 0
