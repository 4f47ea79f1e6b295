"""A service over HTTP: JSON requests and answers, arrays and images as base64.

The five calls of ``service.Service`` are POSTs of their arguments to a path of their name;
errors are 404 (not found), 400 (wrong argument) and 500. ``RemoteClient`` reads them.
"""

from __future__ import annotations

import base64
import json
import threading
import urllib.error
import urllib.request
from collections.abc import Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import numpy as np

from trajspark.operators import training
from trajspark.service import Client, InvalidArgument, NotFound, Service, ServiceError

CALLS = ("server_info", "get_meta", "get_episode", "get_batch", "query")
_ERRORS = {404: NotFound, 400: InvalidArgument, 500: ServiceError}


def packed(value):
    """Plain JSON of a client's answer."""
    if isinstance(value, np.ndarray):
        return {"dtype": str(value.dtype), "shape": list(value.shape), "data": base64.b64encode(np.ascontiguousarray(value).tobytes()).decode()}
    if isinstance(value, dict):
        return {"fields": {k: packed(v) for k, v in value.items()}}
    return [packed(v) for v in value] if isinstance(value, (list, tuple)) else value


def unpacked(value):
    if isinstance(value, list):
        return [unpacked(v) for v in value]
    if isinstance(value, dict):
        if "fields" in value:
            return {k: unpacked(v) for k, v in value["fields"].items()}
        return np.frombuffer(base64.b64decode(value["data"]), value["dtype"]).reshape(value["shape"])
    return value


def serve(service: Service, port: int = 50051, bind: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server that runs in a thread of its own; ``shutdown`` ends it. Calls are answered one by one, so draws keep their order."""
    client, turn = Client(service), threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self) -> None:
            name = self.path.strip("/")
            try:
                if name not in CALLS:
                    raise NotFound(name)
                arguments = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
                with turn:
                    code, answer = 200, packed(getattr(client, name)(**arguments))
            except NotFound as e:
                code, answer = 404, str(e)
            except (InvalidArgument, TypeError, ValueError) as e:
                code, answer = 400, str(e)
            except Exception as e:  # the caller learns of it; the server goes on
                code, answer = 500, f"{type(e).__name__}: {e}"
            body = json.dumps(answer).encode()
            self.send_response(code)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args) -> None:
            pass

    server = ThreadingHTTPServer((bind, port), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server


class RemoteClient:
    """The calls of ``service.Client`` on a server's address (host:port)."""

    def __init__(self, address: str, timeout: float = 30.0):
        self.address, self.timeout = address, timeout

    def _call(self, name: str, **arguments):
        request = urllib.request.Request(f"http://{self.address}/{name}", json.dumps(arguments).encode(), {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                return unpacked(json.load(answer))
        except urllib.error.HTTPError as e:
            raise _ERRORS.get(e.code, ServiceError)(json.load(e)) from e

    def server_info(self) -> dict:
        return self._call("server_info")

    def get_meta(self, position: int) -> dict:
        return self._call("get_meta", position=position)

    def get_episode(self, position: int, include_images: bool = True) -> dict:
        return self._call("get_episode", position=position, include_images=include_images)

    def get_batch(self, batch_size: int, **options) -> list[dict]:
        return self._call("get_batch", batch_size=batch_size, **options)

    def query(self, kql: str, limit: int = 0) -> list[int]:
        return self._call("query", kql=kql, limit=limit)


class RemoteSamples:
    """Streams training samples from a server: as many random batches as cover its episodes."""

    def __init__(self, address: str, batch_size: int = 32, mode: str = "random", image_key: str | None = None, image_size: tuple[int, int] | None = None, to_tensor: bool = False):
        self.client, self.batch_size, self.mode, self.options = RemoteClient(address), batch_size, mode, (image_key, image_size, to_tensor)

    def __len__(self) -> int:
        return self.client.server_info()["num_episodes"]

    def __iter__(self) -> Iterator[dict]:
        draw = lambda n: self.client.get_batch(n, mode=self.mode)
        for episode in training.batches(draw, len(self), self.batch_size):
            yield training.sample(episode, *self.options)
