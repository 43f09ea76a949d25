from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from marlstone.operators.vectors import HashingEmbedder, HttpEmbedder, expected_dimension


@pytest.fixture
def service():
    """A provider that answers as told: a list of (status, body) for the requests to come."""

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            server.seen.append((self.path, body, dict(self.headers)))
            status, out = server.answers.pop(0)
            data = json.dumps(out).encode()
            self.send_response(status)
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    server.seen, server.answers = [], []
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield server
    server.shutdown()


def client(service, kind, **more):
    return HttpEmbedder(kind, f"http://127.0.0.1:{service.server_port}", "m", 3, "key", pause=0.01, **more)


def test_one_by_one(service):
    service.answers = [(200, {"embedding": [1, 2, 3]}), (200, {"embedding": [4, 5, 6]})]
    assert client(service, "ollama").embed(["a", "b"]) == [[1, 2, 3], [4, 5, 6]]
    assert [s[0] for s in service.seen] == ["/api/embeddings"] * 2 and service.seen[0][1] == {"model": "m", "prompt": "a"}


def test_batch_comes_in_any_order(service):
    service.answers = [(200, {"data": [{"index": 1, "embedding": [4, 5, 6]}, {"index": 0, "embedding": [1, 2, 3]}]})]
    assert client(service, "openai").embed(["a", "b"]) == [[1, 2, 3], [4, 5, 6]]
    assert service.seen[0][2]["Authorization"] == "Bearer key"


def test_nested_values(service):
    service.answers = [(200, {"embedding": {"values": [1, 2, 3]}})]
    assert client(service, "gemini").embed(["a"]) == [[1, 2, 3]]
    assert service.seen[0][0] == "/models/m:embedContent"


def test_busy_is_tried_again(service):
    service.answers = [(429, {}), (503, {}), (200, {"embedding": [1, 2, 3]})]
    assert client(service, "ollama").embed(["a"]) == [[1, 2, 3]]


@pytest.mark.parametrize("answer", [(400, {}), (200, {"embedding": [1, 2]}), (200, {"other": 1})])
def test_errors(service, answer):
    service.answers = [answer]
    with pytest.raises(Exception):
        client(service, "ollama").embed(["a"])
    assert len(service.seen) == 1


def test_missing_vectors_are_an_error(service):
    service.answers = [(200, {"data": [{"index": 0, "embedding": [1, 2, 3]}]})]
    with pytest.raises(ValueError, match="2 texts, 1 vectors"):
        client(service, "openai").embed(["a", "b"])


def test_hashing_is_stable():
    e = HashingEmbedder(16)
    a, b = e.embed(["load config", "load config"])
    assert a == b and abs(sum(x * x for x in a) - 1) < 1e-6 and e.embed([""]) == [[0.0] * 16]


def test_known_dimensions():
    assert expected_dimension("nomic-embed-text:latest") == 768 and expected_dimension("x") == 0
