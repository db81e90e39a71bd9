"""Bearer tokens: signed JSON Web Tokens, verified against a key set.

Only asymmetric algorithms are known, so whoever can verify can't sign; a token of another
one (``none`` and the HMACs among them) is refused before any key is looked up. Signatures
are verified here in plain integer arithmetic, as RFC 7518 and RFC 8017 define them: all of
its inputs are public, so its timing tells nothing.

The key set comes from ``jwks_uri`` (http, https or a file), is kept, and is fetched again
for an unknown key id, at most once in ``REFETCH`` seconds.
"""

from __future__ import annotations

import base64
import hashlib
import json
import time
import urllib.request
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from ..errors import StrataError
from ..operators.governance import Principal

#: The accepted algorithms; the digits name the SHA-2 digest.
ALGORITHMS = ("RS256", "RS384", "RS512", "ES256", "ES384", "ES512", "PS256", "PS384", "PS512")
TIMEOUT, REFETCH = 10, 60
NEEDED = ("iss", "aud", "exp", "sub")
#: Curves by the algorithm's digest: name, p, b (a is -3), order, generator.
CURVES = {
    "256": (
        "P-256",
        0xFFFFFFFF00000001000000000000000000000000FFFFFFFFFFFFFFFFFFFFFFFF,
        0x5AC635D8AA3A93E7B3EBBD55769886BC651D06B0CC53B0F63BCE3C3E27D2604B,
        0xFFFFFFFF00000000FFFFFFFFFFFFFFFFBCE6FAADA7179E84F3B9CAC2FC632551,
        (0x6B17D1F2E12C4247F8BCE6E563A440F277037D812DEB33A0F4A13945D898C296, 0x4FE342E2FE1A7F9B8EE7EB4A7C0F9E162BCE33576B315ECECBB6406837BF51F5),
    ),
    "384": (
        "P-384",
        2**384 - 2**128 - 2**96 + 2**32 - 1,
        0xB3312FA7E23EE7E4988E056BE3F82D19181D9C6EFE8141120314088F5013875AC656398D8A2ED19D2A85C8EDD3EC2AEF,
        0xFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFC7634D81F4372DDF581A0DB248B0A77AECEC196ACCC52973,
        (
            0xAA87CA22BE8B05378EB1C71EF320AD746E1D3B628BA79B9859F741E082542A385502F25DBF55296C3A545E3872760AB7,
            0x3617DE4A96262C6F5D9E98BF9292DC29F8F41DBD289A147CE9DA3113B5F0B8C00A60B1CE1D7E819D7A431D7C90EA0E5F,
        ),
    ),
    "512": (
        "P-521",
        2**521 - 1,
        0x0051953EB9618E1C9A1F929A21A0B68540EEA2DA725B99B315F3B8B489918EF109E156193951EC7E937B1652C0BD3BB1BF073573DF883D2C34F1EF451FD46B503F00,
        0x01FFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFA51868783BF2F966B7FCC0148F709A5D03BB5C9B8899C47AEBB6FB71E91386409,
        (
            0x00C6858E06B70404E9CD9E3ECB662395B4429C648139053FB521F828AF606B4D3DBAA14B5E77EFE75928FE1DC127A2FFA8DE3348B3C1856A429BF97E7E31C2E5BD66,
            0x011839296A789A3BC0045C8A5FB42C7D1BD998F54449579B446817AFBD17273E662C97EE72995EF42640C550B9013FAD0761353C7086A272C24088BE94769FD16650,
        ),
    ),
}
#: The DER heads of PKCS #1 v1.5 digests.
DIGEST_INFO = {
    "256": bytes.fromhex("3031300d060960864801650304020105000420"),
    "384": bytes.fromhex("3041300d060960864801650304020205000430"),
    "512": bytes.fromhex("3051300d060960864801650304020305000440"),
}


class AuthError(StrataError):
    """A token that names nobody."""


def decoded(text: str) -> bytes:
    return base64.urlsafe_b64decode(text + "=" * (-len(text) % 4))


def number(text: str) -> int:
    return int.from_bytes(decoded(text), "big")


def _rsa(key: Mapping[str, Any], signature: bytes) -> bytes:
    """The padded message that a signature stands for."""
    n, size = number(key["n"]), (number(key["n"]).bit_length() + 7) // 8
    s = int.from_bytes(signature, "big")
    if len(signature) != size or s >= n:
        raise AuthError("the signature is of another size")
    return pow(s, number(key["e"]), n).to_bytes(size, "big")


def _pkcs1(key: Mapping[str, Any], digest: str, message: bytes, signature: bytes) -> bool:
    padded = _rsa(key, signature)
    tail = DIGEST_INFO[digest] + hashlib.new(f"sha{digest}", message).digest()
    return padded == b"\x00\x01" + b"\xff" * (len(padded) - len(tail) - 3) + b"\x00" + tail


def _pss(key: Mapping[str, Any], digest: str, message: bytes, signature: bytes) -> bool:
    make = lambda x: hashlib.new(f"sha{digest}", x).digest()
    size, bits = hashlib.new(f"sha{digest}").digest_size, number(key["n"]).bit_length() - 1
    padded = _rsa(key, signature)[-((bits + 7) // 8) :]
    masked, h, end = padded[: -size - 1], padded[-size - 1 : -1], padded[-1]
    if end != 0xBC or len(masked) < size + 1:
        return False
    mask = b"".join(make(h + i.to_bytes(4, "big")) for i in range(len(masked) // size + 1))[: len(masked)]
    plain = bytearray(a ^ b for a, b in zip(masked, mask, strict=True))
    plain[0] &= 0xFF >> (8 * len(masked) - bits + 8 * (size + 1)) if bits % 8 else 0xFF
    salt = bytes(plain[-size:])
    return bytes(plain) == bytes(len(plain) - size - 1) + b"\x01" + salt and make(bytes(8) + make(message) + salt) == h


def _ecdsa(key: Mapping[str, Any], digest: str, message: bytes, signature: bytes) -> bool:
    name, p, b, n, g = CURVES[digest]
    size = (p.bit_length() + 7) // 8
    x, y = number(key["x"]), number(key["y"])
    r, s = int.from_bytes(signature[:size], "big"), int.from_bytes(signature[size:], "big")
    if key.get("crv") != name or len(signature) != 2 * size or not (0 < r < n and 0 < s < n) or (y * y - x**3 + 3 * x - b) % p:
        return False

    def add(u: tuple[int, int] | None, v: tuple[int, int] | None) -> tuple[int, int] | None:
        if u is None or v is None:
            return v if u is None else u
        if u[0] == v[0] and (u[1] + v[1]) % p == 0:
            return None
        slope = (3 * u[0] * u[0] - 3) * pow(2 * u[1], -1, p) if u == v else (v[1] - u[1]) * pow(v[0] - u[0], -1, p)
        w = (slope * slope - u[0] - v[0]) % p
        return w, (slope * (u[0] - w) - u[1]) % p

    def times(k: int, u: tuple[int, int] | None) -> tuple[int, int] | None:
        out = None
        while k:
            out = add(out, u) if k & 1 else out
            u, k = add(u, u), k >> 1
        return out

    e = int.from_bytes(hashlib.new(f"sha{digest}", message).digest(), "big")
    e >>= max(0, 8 * hashlib.new(f"sha{digest}").digest_size - n.bit_length())
    inverse = pow(s, -1, n)
    point = add(times(e * inverse % n, g), times(r * inverse % n, (x, y)))
    return point is not None and point[0] % n == r


VERIFY: dict[str, tuple[str, Callable[..., bool]]] = {"RS": ("RSA", _pkcs1), "PS": ("RSA", _pss), "ES": ("EC", _ecdsa)}


@dataclass
class KeySet:
    uri: str
    clock: Callable[[], float] = time.monotonic
    _keys: dict[str, dict] = field(default_factory=dict)
    _at: float | None = None

    def fetch(self) -> dict[str, Any]:
        with urllib.request.urlopen(self.uri if ":" in self.uri else f"file://{self.uri}", timeout=TIMEOUT) as r:
            return json.load(r)

    def key(self, kid: str | None) -> dict[str, Any]:
        if kid not in self._keys and (self._at is None or self.clock() - self._at >= REFETCH):
            self._at = self.clock()
            try:
                self._keys = {k.get("kid"): k for k in self.fetch()["keys"]}
            except (OSError, ValueError, KeyError, AttributeError) as e:
                raise AuthError(f"the key set can't be read: {e}") from e
        if kid not in self._keys:
            raise AuthError(f"no key has the id {kid!r}")
        return self._keys[kid]


@dataclass
class Verifier:
    issuer: str
    audience: str
    keys: KeySet
    claims: Mapping[str, str] = field(default_factory=dict)
    skew: float = 0.0
    clock: Callable[[], float] = time.time

    def verify(self, token: str) -> Principal:
        """The caller that a token names; AuthError where it names nobody."""
        try:
            head, body, mark = token.split(".")
            header, claims, signature = json.loads(decoded(head)), json.loads(decoded(body)), decoded(mark)
            algorithm, kid = header.get("alg"), header.get("kid")
        except (ValueError, AttributeError) as e:
            raise AuthError("not a signed token") from e
        if algorithm not in ALGORITHMS:
            raise AuthError(f"tokens signed with {algorithm!r} aren't accepted")
        key = self.keys.key(kid)
        kind, holds = VERIFY[algorithm[:2]]
        if key.get("kty") != kind or key.get("alg", algorithm) != algorithm or key.get("use", "sig") != "sig":
            raise AuthError("the key is for something else")
        try:
            good = holds(key, algorithm[2:], f"{head}.{body}".encode(), signature)
        except (KeyError, ValueError) as e:
            raise AuthError(f"the key is unusable: {e}") from e
        if not good:
            raise AuthError("the signature doesn't hold")
        return self._named(claims)

    def _named(self, claims: Any) -> Principal:
        if not isinstance(claims, dict) or any(c not in claims for c in NEEDED):
            raise AuthError(f"a token needs {', '.join(NEEDED)}")
        now = self.clock()
        aud = claims["aud"] if isinstance(claims["aud"], list) else [claims["aud"]]
        times = [claims["exp"], claims.get("nbf", 0), claims.get("iat", 0)]
        if not all(isinstance(t, (int, float)) and not isinstance(t, bool) for t in times):
            raise AuthError("its times aren't numbers")
        if times[0] + self.skew <= now:
            raise AuthError("it has expired")
        if max(times[1:]) - self.skew > now:
            raise AuthError("it isn't valid yet")
        if claims["iss"] != self.issuer or self.audience not in aud:
            raise AuthError("it is from or for someone else")
        if not isinstance(claims["sub"], str) or not claims["sub"]:
            raise AuthError("it names nobody")
        return Principal.of(claims, self.claims)
