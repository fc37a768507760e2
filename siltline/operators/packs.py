"""Packs: families, specifications and mappings as one signed document; loaded whole or refused.

The order of checks: signature, transparency log, contract, anchors, hashes. Whatever fails, the pack is not used.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from siltline.operators import provenance, signing
from siltline.operators.normalize import Mapping
from siltline.operators.parser import Program, SpecError
from siltline.operators.routing import Anchor, Family

TRANSFORMS = ("none", "int", "float", "lowercase", "epoch_ms", "lookup", "compose_datetime")
#: Keys that would state a numeric confidence, which no document of the engine may.
BANNED = ("confidence", "probability", "score", "likelihood")


class Refused(ValueError):
    """The document is not used."""


def canonical(document: object) -> bytes:
    return json.dumps(document, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()


def digest(document: object) -> str:
    return "sha256:" + hashlib.sha256(canonical(document)).hexdigest()


def no_confidence(document: object, where: str = "") -> None:
    """Refuses numbers under keys that would be a confidence, however deep."""
    if isinstance(document, dict):
        for k, v in document.items():
            if k.lower() in BANNED and isinstance(v, (int, float)) and not isinstance(v, bool):
                raise Refused(f"{where}/{k}: numeric confidence")
            no_confidence(v, f"{where}/{k}")
    elif isinstance(document, list):
        for n, v in enumerate(document):
            no_confidence(v, f"{where}/{n}")


@dataclass
class Log:
    """An append-only transparency log of document digests."""

    leaves: list[bytes] = field(default_factory=list)

    @staticmethod
    def leaf(document: object) -> bytes:
        return hashlib.sha256(b"\x00" + digest(document).encode()).digest()

    def append(self, document: object) -> int:
        self.leaves.append(self.leaf(document))
        return len(self.leaves) - 1

    def root(self) -> bytes:
        return provenance.root(self.leaves)

    def prove(self, index: int) -> list[tuple[str, bytes]]:
        return provenance.proof(self.leaves, index)


@dataclass
class Loaded:
    id: str
    families: list[Family]
    programs: dict[str, Program]
    mappings: dict[str, list[Mapping]]
    digest: str


def signed(document: dict, secret: bytes, key: str) -> dict:
    return {"document": document, "key": key, "signature": signing.sign(secret, canonical(document)).hex()}


def load(envelope: dict, trusted: dict[str, bytes], log_root: bytes | None = None, proof: list[tuple[str, bytes]] | None = None) -> Loaded:
    document, key = envelope["document"], trusted.get(envelope.get("key", ""))
    if key is None or not signing.verify(key, canonical(document), bytes.fromhex(envelope["signature"])):
        raise Refused("signature")
    if log_root is not None and (proof is None or not provenance.verify(Log.leaf(document), proof, log_root)):
        raise Refused("not in the log")
    no_confidence(document)
    families, programs, mappings, seen = [], {}, {}, {}
    for f in document.get("families", ()):
        if {"id", "surface", "spec"} - set(f):
            raise Refused(f"family {f.get('id')}: incomplete")
        if f["id"] in programs:
            raise Refused(f"family {f['id']}: twice")
        try:
            program = Program(f["spec"])
        except (SpecError, KeyError, TypeError) as e:
            raise Refused(f"family {f['id']}: {e}") from e
        if "parser_hash" in f and f["parser_hash"] != program.parser_hash:
            raise Refused(f"family {f['id']}: not the parser that was signed for")
        anchors = []
        for a in f.get("anchors", ()):
            if not a.get("values") or a.get("kind") not in ("key", "slot", "pattern", "envelope"):
                raise Refused(f"anchor {a.get('id')}")
            for v in a["values"]:
                if seen.setdefault((a["kind"], a["at"], f["surface"], v), f["id"]) != f["id"]:
                    raise Refused(f"anchor {a['id']}: {v} belongs to two families")
            anchors.append(Anchor(a["id"], a["kind"], a["at"], tuple(a["values"]), bool(a.get("retired"))))
        own = []
        for m in f.get("mapping", ()):
            if m.get("transform", "none") not in TRANSFORMS or "attribute" not in m:
                raise Refused(f"family {f['id']}: mapping {m}")
            own.append(Mapping(m["attribute"], m.get("path"), m.get("constant"), m.get("envelope"), m.get("transform", "none"), tuple(map(tuple, m.get("table", ()))), m.get("default"), tuple(m.get("parts", ()))))
        if len({m.attribute for m in own}) < len(own):
            raise Refused(f"family {f['id']}: an attribute is mapped twice")
        families.append(Family(f["id"], document["id"], f.get("envelope", "raw"), f["surface"], tuple(anchors), tuple(f["arity"]) if "arity" in f else None, tuple(f.get("classes", ()))))
        programs[f["id"]], mappings[f["id"]] = program, own
    if not families:
        raise Refused("no families")
    return Loaded(document["id"], families, programs, mappings, digest(document))


def bundle(segment: str, records: list[dict], index: int, secret: bytes, key: str) -> dict:
    """One record with the proof that it is in its segment's tree, and the signed root."""
    leaves = [leaf_of(segment, r) for r in records]
    root = provenance.root(leaves)
    return {"segment": segment, "record": records[index], "proof": [[side, h.hex()] for side, h in provenance.proof(leaves, index)], "root": root.hex(), "key": key, "signature": signing.sign(secret, root).hex()}


def leaf_of(segment: str, record: dict, label: str = "siltline-leaf-v1") -> bytes:
    raw = bytes.fromhex(record["raw_hash"].removeprefix("sha256:"))
    return hashlib.sha256(b"\x00" + label.encode() + segment.encode() + record["offset"].to_bytes(8, "big") + record["length"].to_bytes(4, "big") + raw).digest()


def verify_bundle(b: dict, trusted: dict[str, bytes], raw: bytes | None = None) -> str | None:
    """Why a bundle is not to be trusted; None if it is."""
    root = bytes.fromhex(b["root"])
    if b["key"] not in trusted or not signing.verify(trusted[b["key"]], root, bytes.fromhex(b["signature"])):
        return "signature"
    if not provenance.verify(leaf_of(b["segment"], b["record"]), [(side, bytes.fromhex(h)) for side, h in b["proof"]], root):
        return "proof"
    if raw is not None and "sha256:" + hashlib.sha256(raw).hexdigest() != b["record"]["raw_hash"]:
        return "raw bytes"
    return None
