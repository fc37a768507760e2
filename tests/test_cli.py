"""The command line: compile, parse, verify-pack."""

import io
import json
import sys

from siltline.__main__ import main
from siltline.operators import packs, signing


def test_compile_and_parse(tmp_path, capsys, monkeypatch):
    spec = tmp_path / "s.json"
    spec.write_text(json.dumps({"parse": {"op": "kv", "keys": {"a": {}}}}))
    assert main(["compile", str(spec)]) == 0 and capsys.readouterr().out.startswith("sha256:")
    monkeypatch.setattr(sys, "stdin", io.TextIOWrapper(io.BytesIO(b"a=1\r\nnothing\n")))
    assert main(["parse", str(spec)]) == 1
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert [x["status"] for x in lines] == ["ok", "failed"] and lines[0]["spans"][1]["text"] == "1"
    spec.write_text(json.dumps({"parse": {"op": "eval"}}))
    assert main(["compile", str(spec)]) == 1


def test_verify_pack(tmp_path, capsys):
    secret, path = b"\x01" * 32, tmp_path / "p.json"
    path.write_text(json.dumps(packs.signed({"id": "p", "families": [{"id": "f", "surface": "kv", "spec": {"parse": []}}]}, secret, "k")))
    assert main(["verify-pack", str(path), "k", signing.public_key(secret).hex()]) == 0
    assert main(["verify-pack", str(path), "k", signing.public_key(b"\x02" * 32).hex()]) == 1
    assert "refused" in capsys.readouterr().err
