"""HTTP: POST /v1/query, GET /v1/tx, GET /v1/health. One engine thread owns the database."""

from __future__ import annotations

import json
import queue
import threading
import uuid
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from tidemark.database import Database
from tidemark.errors import TidemarkError

MAX_BODY, TIMEOUT = 1 << 20, 30.0


class Engine:
    def __init__(self, db: Database):
        self.db, self.jobs, self.late = db, queue.Queue(), set()
        threading.Thread(target=self._run, daemon=True).start()

    def _run(self) -> None:
        while True:
            group, job, out = self.jobs.get()
            if group in self.late:  # given up before it began
                self.late.discard(group)
                continue
            try:
                self.db.spark.sparkContext.setJobGroup(group, "a request", interruptOnCancel=True)
                out.put((200, job(self.db)))
            except TidemarkError as e:
                out.put((400, json.dumps({"error": str(e)})))
            except Exception as e:  # a fault of one request doesn't end the engine
                out.put((500, json.dumps({"error": f"{type(e).__name__}: {str(e)[:200]}"})))

    def ask(self, job, timeout: float = TIMEOUT) -> tuple[int, str]:
        """The answer of one job; after ``timeout`` its Spark jobs are cancelled, so that the next ones don't wait for them."""
        out: queue.Queue = queue.Queue()
        group = f"tidemark-{uuid.uuid4().hex}"
        self.jobs.put((group, job, out))
        try:
            return out.get(timeout=timeout)
        except queue.Empty:
            self.late.add(group)
            self.db.spark.sparkContext.cancelJobGroup(group)
            return 504, json.dumps({"error": "timeout"})


def make_server(db: Database, host: str = "127.0.0.1", port: int = 8080, timeout: float = TIMEOUT) -> ThreadingHTTPServer:
    engine = Engine(db)

    class Handler(BaseHTTPRequestHandler):
        def reply(self, status: int, body: str) -> None:
            data = body.encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            if self.path == "/v1/health":
                self.reply(200, json.dumps({"ok": True}))
            elif self.path == "/v1/tx":
                self.reply(*engine.ask(lambda d: json.dumps({"tx": d.current_tx()}), timeout))
            else:
                self.reply(404, json.dumps({"error": "not found"}))

        def do_POST(self) -> None:
            if self.path != "/v1/query":
                self.reply(404, json.dumps({"error": "not found"}))
                return
            length = int(self.headers.get("Content-Length") or 0)
            if length > MAX_BODY:
                self.reply(413, json.dumps({"error": "the body is too large"}))
                return
            try:
                body = json.loads(self.rfile.read(length))
                sql, params = body["sql"], body.get("params")
                if not isinstance(sql, str) or not (params is None or isinstance(params, list)):
                    raise TypeError("sql is a text, params a list")
            except (ValueError, KeyError, TypeError, AttributeError) as e:
                self.reply(400, json.dumps({"error": f"bad request: {e}"}))
                return
            self.reply(*engine.ask(lambda d: d.query(sql, params).to_json(), timeout))

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
