"""Secret and licence scans: each kind of structure, awkward texts, and time that grows with the length alone."""

import base64
import hashlib
import re
import time

import pytest

from quern.llm import licenses, secret_scan
from quern.llm.secret_scan import spans_of

LEGACY = base64.b64encode(bytes(range(256)) * 4).decode()
FIELD = lambda b: len(b).to_bytes(4, "big") + b
PUBLIC = FIELD(b"ssh-ed25519") + FIELD(bytes(range(32)))
OPENSSH = b"openssh-key-v1\0" + FIELD(b"aes256-ctr") + FIELD(b"bcrypt") + FIELD(b"salt and rounds") + (1).to_bytes(4, "big") + FIELD(PUBLIC) + FIELD(b"p" * 64)


def pem(name, data, head=""):
    body = base64.b64encode(data).decode()
    lines = "\n".join(body[i : i + 64] for i in range(0, len(body), 64))
    return f"-----BEGIN {name}-----\n{head}{lines}\n-----END {name}-----"


HEAD = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00112233445566778899AABBCCDDEEFF\n\n"


def kinds(text):
    return [k for k, *_ in spans_of(text) if k not in secret_scan.BASE]


@pytest.mark.parametrize("secret, want", [
    (pem("OPENSSH PRIVATE KEY", OPENSSH), True), (pem("OPENSSH PRIVATE KEY", OPENSSH[:-1]), False), (pem("OPENSSH PRIVATE KEY", b"openssh-key-v1\0" + b"x" * 80), False),
    (pem("RSA PRIVATE KEY", bytes(range(64)), HEAD), True), (pem("RSA PRIVATE KEY", bytes(range(60)), HEAD), False), (pem("RSA PRIVATE KEY", bytes(range(64)), HEAD.replace("0011", "")), False),
    (pem("ENCRYPTED PRIVATE KEY", bytes(range(64))), False), (pem("ENCRYPTED PRIVATE KEY", b"\x30\x3e" + bytes(62)), False),
    (pem("ENCRYPTED PRIVATE KEY", bytes.fromhex("301e300d06092a864886f70d0105010500040d") + bytes(13)), True),
    (pem("PRIVATE KEY", OPENSSH).replace("END PRIVATE", "END PUBLIC"), False), ("-----BEGIN A KEY-----\n" + pem("B KEY", OPENSSH), True),
])
def test_pem_is_parsed(secret, want):
    for text in (secret, "before " + secret.replace("\n", "\\n") + " after"):
        assert ("pem" in kinds(text)) == want


def der(tag, *parts):
    """An ASN.1 item with the shortest form of its length."""
    body = b"".join(parts)
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x80 | (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes([tag]) + size + body


ZERO, ONE, BIG, NAME = der(2, b"\0"), der(2, b"\1"), der(2, bytes(range(1, 40))), der(6, bytes.fromhex("2a864886f70d010101"))
PRIVATE = {
    "rsa": der(0x30, ZERO, *[BIG] * 8), "dsa": der(0x30, ZERO, *[BIG] * 5), "sec1": der(0x30, ONE, der(4, bytes(range(32)))), "pkcs8": der(0x30, ZERO, der(0x30, NAME), der(4, bytes(range(40)))),
    "encrypted": der(0x30, der(0x30, NAME), der(4, bytes(range(40)))), "many integers": der(0x30, ZERO, *[BIG] * 10_050), "deep": der(0x30, ZERO, der(0x30, NAME, der(0x30, *[der(5)] * 12_000)), der(4, bytes(40))),
}
OPEN = {
    "spki": der(0x30, der(0x30, NAME), der(3, bytes(range(40)))), "rsa public": der(0x30, BIG, ONE), "certificate": der(0x30, der(0x30, ZERO, der(0x30, NAME), BIG), der(0x30, NAME), der(3, bytes(range(40)))),
    "integers": der(0x30, *[BIG] * 9), "signature": der(0x30, BIG, BIG), "cut off": PRIVATE["rsa"][:-1], "ssh public": PUBLIC,
}


@pytest.mark.parametrize("name", PRIVATE)
def test_private_forms_are_found_whatever_their_length(name):
    shown, dump = base64.b64encode(PRIVATE[name]).decode(), PRIVATE[name].hex()
    assert spans_of(f"key: {shown} end") == [("der", 5, 5 + len(shown))]
    assert ("der", 7, 7 + len(dump)) in spans_of(f"key: 0x{dump};") and ("der", 2, 2 + len(dump)) in spans_of("0X" + dump.upper())
    assert kinds(pem("PRIVATE KEY", PRIVATE[name]).replace("PRIVATE KEY", "RSA PRIVATE KEY")).count("pem") == 1


@pytest.mark.parametrize("name", OPEN)
def test_public_forms_are_no_secrets(name):
    shown = base64.b64encode(OPEN[name]).decode()
    for text in (f"ssh-ed25519 {shown} user@host", f"key: {shown}", pem("PUBLIC KEY", OPEN[name]), pem("CERTIFICATE", OPEN[name]), "0x" + OPEN[name].hex()):
        assert kinds(text) == []
        assert shown not in text or secret_scan.redacted_text(text).count(shown) == 1


def test_ssh_files_of_many_keys():
    many = b"openssh-key-v1\0" + FIELD(b"none") * 2 + FIELD(b"") + (11_000).to_bytes(4, "big") + FIELD(PUBLIC) * 11_000 + FIELD(b"p" * 64)
    assert secret_scan.is_ssh(many) and not secret_scan.is_ssh(many[:-1]) and not secret_scan.is_ssh(PUBLIC)


M = 5_000_000
LONG = {
    "begin": "-----BEGIN RSA PRIVATE KEY-----\n" * (M // 32), "end": "a-----END KEY-----" * (M // 18), "slashes": "-----BEGIN KEY-----" + "\\" * M + "-----END KEY-----",
    "escaped": "\\/" * (M // 2) + "===", "run": "A" * M + "===", "dots": "eyJhb." * (M // 6), "basic": "basic " * (M // 6), "assign": "token   " * (M // 8), "hex": "0" * M,
    "access": "AKIA" * (M // 4), "spaces": " " * M, "der": "MIIE" * (M // 4), "equals": "a=" * (M // 2),
}


@pytest.mark.parametrize("name", LONG)
def test_long_texts_take_linear_time(name):
    begin = time.process_time()
    spans_of(LONG[name])
    assert time.process_time() - begin < 6


def test_op8_brute_force(spark, sf_dir):
    """The base spans again, by one pass over all alternatives, and the digests from them."""
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    patterns = (
        ("assign", r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=-]+)""", 12),
        ("access", r"(AKIA[A-Z0-9]+)", 18), ("hex", r"([0-9a-f]+)", 16),
    )
    got = secret_scan.op8_secret_scans(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    some = 0
    for r in got:
        found = [(m.start(), k, m.end(), name) for k, (name, p, least) in enumerate(patterns) for m in re.finditer(p, texts[r["doc_id"]]) if len(m[1]) >= least]
        base = [f"{name}:{a}:{b}" for a, _, b, name in sorted(found)]
        some += len(base)
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(f[3] == name for f in found) for name, *_ in patterns]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [s for s in r["spans"].split(",") if s.split(":")[0] in secret_scan.BASE] == base
    assert some


SCANNER = licenses.Scanner()


@pytest.mark.parametrize("label", licenses.TEMPLATES)
def test_whole_templates(label):
    text = " ".join(licenses.TEMPLATES[label])
    found = SCANNER.scan("some words before " + text.upper() + " and after")
    assert label in found.labels and found.score == 1.0
    words = text.split()
    for k in range(9, len(words), 10):  # a word in ten is another
        words[k] = "other"
    if len(words) > 40:
        assert label in SCANNER.scan(" ".join(words)).labels
    assert label not in SCANNER.scan(" ".join(sorted(set(text.split())))).labels


def test_spans_cover_their_template():
    mit = licenses.TEMPLATES["mit"][0]
    found = SCANNER.scan(f"x y z {mit} a b c")
    span = next(s for s in found.spans if s[0] == "mit")
    assert span[1:] == (3, 3 + len(licenses.words_of(mit)), 1.0)
    assert SCANNER.scan(None) == SCANNER.scan("") == licenses.Found(0, [], [])
    half = " ".join(mit.split()[: len(mit.split()) // 3])
    assert SCANNER.scan(half).labels == [] and SCANNER.scan(" ".join([half] * 9)).labels == []


@pytest.mark.parametrize("unit", [" ".join(licenses.TEMPLATES["mit"][0].split()[20:30]) + " ", "of the software " * 3 + "without restriction zz ", licenses.TEMPLATES["bsd"][0] + " ", "under the mit license "])
def test_repeated_passages_take_linear_time(unit):
    begin = time.process_time()
    SCANNER.scan(unit * (M // len(unit)))
    assert time.process_time() - begin < 20


def test_op10_base_brute_force(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    phrases = {("under", "the", "mit", "license"): "mit", ("apache", "license", "version", "2"): "apache-2", ("cc", "by", "nc"): "cc-by-nc"}
    got = licenses.op10_license_scans(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        words = "".join(c.lower() if c.isascii() and c.isalnum() else c if ord(c) > 127 else " " for c in texts[r["doc_id"]]).split(" ")
        words = [w for w in words if w]
        places = [(i, label) for p, label in phrases.items() for i in range(len(words)) if tuple(words[i : i + len(p)]) == p]
        starts = [i for i, _ in places]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(places), min(starts, default=None), max(starts, default=None))
        base = sorted({label for _, label in places})
        assert r["base_labels"] == ",".join(base) and set(base) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1
