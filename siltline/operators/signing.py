"""Ed25519 (RFC 8032) in plain Python, for signing packs, checkpoints and bundles on the driver. Not constant-time."""

from __future__ import annotations

import hashlib

P = 2**255 - 19
L = 2**252 + 27742317777372353535851937790883648493
D = -121665 * pow(121666, -1, P) % P
ROOT = pow(2, (P - 1) // 4, P)
Point = tuple[int, int, int, int]


def _add(a: Point, b: Point) -> Point:
    """Twisted Edwards addition in extended coordinates."""
    e, f = (a[1] - a[0]) * (b[1] - b[0]) % P, (a[1] + a[0]) * (b[1] + b[0]) % P
    c, d = 2 * a[3] * b[3] * D % P, 2 * a[2] * b[2] % P
    w, x, y, z = f - e, d - c, d + c, f + e
    return w * x % P, y * z % P, x * y % P, w * z % P


def _times(n: int, p: Point) -> Point:
    out: Point = (0, 1, 1, 0)
    while n:
        if n & 1:
            out = _add(out, p)
        p, n = _add(p, p), n >> 1
    return out


def _x(y: int, odd: int) -> int | None:
    square = (y * y - 1) * pow(D * y * y + 1, -1, P) % P
    x = pow(square, (P + 3) // 8, P)
    if (x * x - square) % P:
        x = x * ROOT % P
    if (x * x - square) % P or y >= P or (x == 0 and odd):
        return None
    return P - x if x & 1 != odd else x


_Y = 4 * pow(5, -1, P) % P
_X = _x(_Y, 0)
BASE: Point = (_X, _Y, 1, _X * _Y % P)


def _pack(p: Point) -> bytes:
    z = pow(p[2], -1, P)
    x, y = p[0] * z % P, p[1] * z % P
    return (y | (x & 1) << 255).to_bytes(32, "little")


def _unpack(raw: bytes) -> Point | None:
    n = int.from_bytes(raw, "little")
    y = n & (1 << 255) - 1
    x = _x(y, n >> 255)
    return None if x is None else (x, y, 1, x * y % P)


def _hash(*parts: bytes) -> int:
    return int.from_bytes(hashlib.sha512(b"".join(parts)).digest(), "little")


def _expand(secret: bytes) -> tuple[int, bytes]:
    h = hashlib.sha512(secret).digest()
    return int.from_bytes(h[:32], "little") & (1 << 254) - 8 | 1 << 254, h[32:]


def public_key(secret: bytes) -> bytes:
    return _pack(_times(_expand(secret)[0], BASE))


def sign(secret: bytes, message: bytes) -> bytes:
    a, prefix = _expand(secret)
    public, r = _pack(_times(a, BASE)), _hash(prefix, message) % L
    point = _pack(_times(r, BASE))
    return point + ((r + _hash(point, public, message) * a) % L).to_bytes(32, "little")


def verify(public: bytes, message: bytes, signature: bytes) -> bool:
    if len(public) != 32 or len(signature) != 64:
        return False
    a, r, s = _unpack(public), _unpack(signature[:32]), int.from_bytes(signature[32:], "little")
    if a is None or r is None or s >= L:
        return False
    left, right = _times(s, BASE), _add(r, _times(_hash(signature[:32], public, message) % L, a))
    return (left[0] * right[2] - right[0] * left[2]) % P == 0 and (left[1] * right[2] - right[1] * left[2]) % P == 0
