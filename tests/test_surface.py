"""Tokens, and the tools over HTTP as each caller may use them."""

import base64
import hashlib
import json
import random
import threading
import urllib.error
import urllib.request

import pytest
import yaml

from strataview.operators.governance import bind
from strataview.plans.resolver import Resolver
from strataview.sources.catalog import ViewCatalog
from strataview.surface import auth, cli, config
from strataview.surface.server import http_server
from strataview.surface.tools import tools

from . import harbour

b64 = lambda raw: base64.urlsafe_b64encode(raw).rstrip(b"=").decode()
num = lambda n: b64(n.to_bytes((n.bit_length() + 7) // 8, "big"))


def prime(rng, bits):
    while True:
        n = rng.getrandbits(bits) | 1 << (bits - 1) | 1
        if all(n % q for q in (3, 5, 7, 11, 13, 17, 19)) and all(pow(a, n - 1, n) == 1 for a in (2, 3, 5)) and n % 65537 != 1:
            return n


def multiply(k, point, p):
    """k times a point, by the schoolbook, apart from the verifier's own."""
    out, x = None, point
    for bit in bin(k)[:1:-1]:
        if bit == "1":
            out = plus(out, x, p)
        x = plus(x, x, p)
        if bit == "b":
            break
    return out


def plus(a, b, p):
    if not a or not b:
        return a or b
    if a[0] == b[0] and (a[1] + b[1]) % p == 0:
        return None
    m = (3 * a[0] ** 2 - 3) * pow(2 * a[1], -1, p) if a == b else (b[1] - a[1]) * pow(b[0] - a[0], -1, p)
    x = (m * m - a[0] - b[0]) % p
    return x, (m * (a[0] - x) - a[1]) % p


@pytest.fixture(scope="module")
def keys():
    rng = random.Random(5)
    p, q = prime(rng, 768), prime(rng, 768)
    out = {"rsa": {"n": p * q, "e": 65537, "d": pow(65537, -1, (p - 1) * (q - 1))}}
    for d, (name, field, _, order, g) in auth.CURVES.items():
        secret = rng.randrange(1, order)
        out[d] = {"curve": name, "secret": secret, "point": multiply(secret, g, field)}
    return out


def jwks(keys):
    rsa = {"kty": "RSA", "kid": "r", "n": num(keys["rsa"]["n"]), "e": num(65537)}
    ec = []
    for d in auth.CURVES:
        size = (auth.CURVES[d][1].bit_length() + 7) // 8
        x, y = (b64(v.to_bytes(size, "big")) for v in keys[d]["point"])
        ec.append({"kty": "EC", "kid": f"e{d}", "crv": keys[d]["curve"], "x": x, "y": y})
    return {"keys": [rsa, *ec]}


def mgf(seed, size, digest):
    return b"".join(hashlib.new(digest, seed + i.to_bytes(4, "big")).digest() for i in range(size // 32 + 1))[:size]


def signed(keys, alg, claims, kid=None):
    digest = f"sha{alg[2:]}"
    kid = kid or ("r" if alg[0] in "RP" else f"e{alg[2:]}")
    text = ".".join(b64(json.dumps(x).encode()) for x in ({"alg": alg, "kid": kid}, claims))
    h = hashlib.new(digest, text.encode()).digest()
    if alg[0] in "RP":
        n, d = keys["rsa"]["n"], keys["rsa"]["d"]
        size = (n.bit_length() + 7) // 8
        if alg[0] == "R":
            tail = auth.DIGEST_INFO[alg[2:]] + h
            padded = b"\x00\x01" + b"\xff" * (size - len(tail) - 3) + b"\x00" + tail
        else:
            salt = b"s" * len(h)
            inner = hashlib.new(digest, bytes(8) + h + salt).digest()
            bits = n.bit_length() - 1
            long = (bits + 7) // 8
            block = bytes(long - 2 * len(h) - 2) + b"\x01" + salt
            masked = bytearray(a ^ b for a, b in zip(block, mgf(inner, len(block), digest), strict=True))
            masked[0] &= 0xFF >> (8 * long - bits)
            padded = bytes(masked) + inner + b"\xbc"
        return f"{text}.{b64(pow(int.from_bytes(padded, 'big'), d, n).to_bytes(size, 'big'))}"
    _, p, _, order, g = auth.CURVES[alg[2:]]
    e = int.from_bytes(h, "big") >> max(0, 8 * len(h) - order.bit_length())
    k = 123456789123456789
    r = multiply(k, g, p)[0] % order
    s = pow(k, -1, order) * (e + r * keys[alg[2:]]["secret"]) % order
    size = (p.bit_length() + 7) // 8
    return f"{text}.{b64(r.to_bytes(size, 'big') + s.to_bytes(size, 'big'))}"


CLAIMS = {"iss": "https://id", "aud": "port", "exp": 2000, "sub": "ada", "crew": ["north"], "rank": 3}


@pytest.fixture
def verifier(keys, tmp_path):
    path = tmp_path / "keys.json"
    path.write_text(json.dumps(jwks(keys)))
    return auth.Verifier("https://id", "port", auth.KeySet(str(path)), {"crew": "string[]", "rank": "string"}, 5, clock=lambda: 1000)


@pytest.mark.parametrize("alg", auth.ALGORITHMS)
def test_every_algorithm(keys, verifier, alg):
    token = signed(keys, alg, CLAIMS)
    assert dict(verifier.verify(token).claims) == {"iss": "https://id", "sub": "ada", "crew": ["north"]}  # rank isn't of its kind
    head, body, mark = token.split(".")
    other = b64(json.dumps({**CLAIMS, "sub": "eve"}).encode())
    broken = bytearray(auth.decoded(mark))
    broken[-3] ^= 4
    for bad in (f"{head}.{other}.{mark}", f"{head}.{body}.{b64(bytes(broken))}", f"{head}.{body}.", f"{head}.{body}.{b64(bytes(len(broken)))}"):
        with pytest.raises(auth.AuthError):
            verifier.verify(bad)


def test_a_published_example():
    """RFC 7515, appendix A.3."""
    key = {"kty": "EC", "crv": "P-256", "x": "f83OJ3D2xF1Bg8vub9tLe1gHMzV76e8Tus9uPHvRVEU", "y": "x_FEzRu9m36HLN_tue659LNpXW6pCyStikYjKIWI5a0"}
    text = b"eyJhbGciOiJFUzI1NiJ9.eyJpc3MiOiJqb2UiLA0KICJleHAiOjEzMDA4MTkzODAsDQogImh0dHA6Ly9leGFtcGxlLmNvbS9pc19yb290Ijp0cnVlfQ"
    mark = auth.decoded("DtEhU3ljbEg8L38VWAfUAqOyKAM6-Xx-F4GawxaepmXFCgfTjDxw5djxLa8ISlSApmWQxfKTUJqPP3-Kg6NU1Q")
    assert auth._ecdsa(key, "256", text, mark) and not auth._ecdsa(key, "256", text + b".", mark)


@pytest.mark.parametrize("change, says", [
    ({"exp": 995}, "expired"), ({"exp": 996}, None), ({"nbf": 1006}, "isn't valid yet"), ({"nbf": 1004}, None), ({"iss": "x"}, "someone else"), ({"aud": ["y"]}, "someone else"),
    ({"aud": ["y", "port"]}, None), ({"sub": ""}, "names nobody"), ({"sub": None}, "names nobody"), ({"exp": "soon"}, "times"), ({"exp": True}, "times"), ({"exp": KeyError}, "needs"), ({"sub": KeyError}, "needs"),
])
def test_claims(keys, verifier, change, says):
    claims = {k: v for k, v in {**CLAIMS, **change}.items() if v is not KeyError}
    if says is None:
        assert verifier.verify(signed(keys, "ES256", claims)).claims["sub"] == "ada"
    else:
        with pytest.raises(auth.AuthError, match=says):
            verifier.verify(signed(keys, "ES256", claims))


def test_other_algorithms_and_keys_are_refused(keys, verifier):
    token = signed(keys, "RS256", CLAIMS)
    _, body, mark = token.split(".")
    for alg in ("none", "HS256", None, "rs256"):
        head = b64(json.dumps({"alg": alg, "kid": "r"}).encode())
        with pytest.raises(auth.AuthError, match="aren't accepted"):
            verifier.verify(f"{head}.{body}.{mark}")
    for bad, says in ((signed(keys, "RS256", CLAIMS, "e256"), "something else"), (signed(keys, "RS256", CLAIMS, "zz"), "no key"), ("a.b", "not a signed"), ("", "not a signed"), ("[].e30.", "not a signed")):
        with pytest.raises(auth.AuthError, match=says):
            verifier.verify(bad)


def test_the_key_set_is_fetched_seldom(keys):
    now, fetched = [0.0], []
    held = auth.KeySet("unused", clock=lambda: now[0])
    held.fetch = lambda: fetched.append(now[0]) or jwks(keys)
    for t, kid in ((0, "r"), (1, "r"), (2, "x"), (59, "x"), (60, "x"), (61, "y"), (200, "r")):
        now[0] = t
        try:
            held.key(kid)
        except auth.AuthError:
            pass
    assert fetched == [0, 60]


@pytest.fixture
def port(spark, verifier):
    """A server on the loopback, whose policy depends on the caller."""
    o = harbour.ontology()
    tables = {"port.vessels": spark.createDataFrame(harbour.FLEET, harbour.VESSELS).cache(), "port.voyages": spark.createDataFrame(harbour.TRIPS, harbour.VOYAGES)}
    policies = [{"name": "north", "objectType": "Vessel", "rows": "object.state == 'sailing'", "when": "principal.crew contains 'north'"}]
    program = bind(policies, o, {"crew": "string[]"})
    servers = []

    def start(with_tokens=True):
        s = http_server("port", lambda caller: tools(o, Resolver(o, {"main": ViewCatalog(tables)}, program.select(caller))), "127.0.0.1", 0, verifier if with_tokens else None)
        threading.Thread(target=s.serve_forever, daemon=True).start()
        servers.append(s)
        return f"http://127.0.0.1:{s.server_port}"

    yield start
    for s in servers:
        s.shutdown()
        s.server_close()


def post(url, message, token=None, path="/mcp", method="POST"):
    headers = {"Content-Type": "application/json", **({"Authorization": f"Bearer {token}"} if token else {})}
    request = urllib.request.Request(url + path, json.dumps(message).encode() if message is not None else None, headers, method=method)
    try:
        with urllib.request.urlopen(request, timeout=60) as r:
            return r.status, json.loads(r.read() or "null")
    except urllib.error.HTTPError as e:
        return e.code, dict(e.headers)


def test_http_as_each_caller(keys, port):
    url = port()
    asked = {"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": "list_vessel", "arguments": {}}}
    seen = {}
    for who, crew in (("ada", ["north"]), ("bo", ["south"]), ("cy", None)):
        claims = {**CLAIMS, "sub": who, **({"crew": crew} if crew else {})}
        status, reply = post(url, asked, signed(keys, "ES256", claims if crew else {k: v for k, v in claims.items() if k != "crew"}))
        assert status == 200
        seen[who] = [x["vesselId"] for x in json.loads(reply["result"]["content"][0]["text"])["objects"]]
    assert seen == {"ada": ["v1", "v6"], "bo": [f"v{k}" for k in range(1, 8)], "cy": ["v1", "v6"]}  # a guard without an answer applies


def test_http_refusals(keys, port):
    url, ping = port(), {"jsonrpc": "2.0", "id": 1, "method": "ping"}
    good = signed(keys, "RS256", CLAIMS)
    status, headers = post(url, ping)
    assert status == 401 and headers["WWW-Authenticate"].startswith("Bearer")
    assert post(url, ping, good + "x")[0] == 401 and post(url, ping, good) == (200, {"jsonrpc": "2.0", "id": 1, "result": {}})
    assert post(url, ping, good, "/other")[0] == 404 and post(url, None, good, method="GET")[0] == 405
    assert post(url, {"jsonrpc": "2.0", "method": "notifications/initialized"}, good) == (202, None)
    both = post(url, [ping, {**ping, "id": 2}], good)[1]
    assert [x["id"] for x in both] == [1, 2]
    open_url = port(with_tokens=False)
    assert post(open_url, ping)[0] == 403  # the policy depends on the caller, and there is none


def test_serve_refuses_what_no_caller_can_decide(spark, tmp_path):
    root = tmp_path / "spec"
    root.mkdir()
    for i, d in enumerate(harbour.documents()):
        (root / f"{i}.yaml").write_text(yaml.safe_dump(d))
    store = harbour.store(spark, tmp_path / "tables")
    policy = {"name": "p", "objectType": "Vessel", "rows": "object.name == principal.sub"}
    for mcp in ({}, {"transport": "http", "port": 0}):
        cfg = tmp_path / "strataview.yaml"
        cfg.write_text(yaml.safe_dump({"catalogs": {"main": {"type": "store", "path": str(store.root)}}, "mcp": mcp, "governance": {"policies": [policy]}}))
        assert cli.main(["serve", str(root), "--config", str(cfg)], spark) == 1
    assert config.load(cfg).verifier() is None
