import hashlib
import random
import re
import string

from panelweave.llm import secrets
from panelweave.llm.queries import QUERIES

WORDS = "password passwd secret token api_?key".split()
ANY_CASE = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in WORDS)
ASSIGN = re.compile(rf"""({ANY_CASE})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], secrets.BASE.index(s[0])))


def base(text):
    return [s for s in secrets.find_secrets(text) if s[0] in secrets.BASE]


def test_base_kinds_against_plain_search():
    rng = random.Random(1)
    parts = ["password", "Token", "SECRET", "api_key", "apiKey", "=", ":", " ", "'", '"', "AKIA", "A1B2C3D4E5F6G7H8", "0123456789abcdef", "é", "K", "ſecret", "İ", "\n", "abc", "x", "-----BEGIN"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert base(text) == brute(text), text


def test_checksums():
    body = "".join(random.Random(2).choices(string.ascii_letters + string.digits, k=30))
    good = "ghp_" + body + secrets.base62_crc(body)
    assert secrets.find_secrets(f"x {good} y")[0] == ("github", 2, 2 + len(good))
    wrong = good[:-1] + ("0" if good[-1] != "0" else "1")
    assert secrets.find_secrets(f"x {wrong} y") == []
    assert [s[0] for s in secrets.find_secrets("to GB82 WEST 1234 5698 7654 32 now")] == ["iban"]
    assert secrets.find_secrets("to GB83 WEST 1234 5698 7654 32 now") == []


def test_redaction_merges_overlaps():
    text = "a token = " + "0123456789abcdef" * 2 + " b"
    assert secrets.redact(text) == "a [SECRET] b"
    assert secrets.redact(None) is None and secrets.redact("") == ""


def test_query(spark):
    d = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = QUERIES["op8_secret_scan"](spark, d).collect()
    assert len(got) == len(texts)
    for r in got:
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(secrets.joined(want).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[0] == k for s in want) for k in secrets.BASE]
        assert set(secrets.joined(want).split(",")) <= set(r.spans.split(","))


def test_odd_rows(odd_documents, no_documents, clashing):
    assert secrets.scan_secrets(odd_documents).where("spans = ''").count() == odd_documents.count()
    assert secrets.scan_secrets(no_documents).count() == 0
    assert secrets.redacted(clashing).columns == clashing.columns


def kinds(text):
    return [(k, text[a:b]) for k, a, b in secrets.find_secrets(text) if k in ("iban", "private_key")]


def test_account_numbers_before_capitals_and_of_all_countries():
    spain, austria = "ES91 2100 0418 4502 0005 1332", "AT61 1904 3002 3457 3201"
    for number, after in [(spain, " BIC"), (spain, " EUR"), (austria, " IBAN"), (spain, "."), (spain, ""), (austria, " X 1")]:
        assert kinds(f"to {number}{after}") == [("iban", number)]
    for number in ["GR16 0110 1250 0000 0001 2300 695", "TR33 0006 1005 1978 6457 8413 26", "SA03 8000 0000 6080 1016 7519", "HU42 1177 3016 1111 1018 0000 0000", "NO93 8601 1117 947"]:
        assert kinds(f"{number} EUR") == [("iban", number)]
        assert kinds(number.replace(" ", "")) == [("iban", number.replace(" ", ""))]
        assert kinds(number[:-1] + str((int(number[-1]) + 1) % 10)) == []
    assert kinds(f"DE12 {spain} GB82 WEST 1234") == [("iban", spain)]


def test_encrypted_private_keys():
    key = "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0A1B\n\nMIIE+/=\n-----END RSA PRIVATE KEY-----"
    cut = "-----BEGIN RSA PRIVATE KEY-----\nMIIE"
    assert kinds(f"a {cut}\n{key}\n{key} b") == [("private_key", key)] * 2
    assert secrets.redact(f"a {key} b") == "a [SECRET] b"
    assert kinds(key.replace("END RSA", "END EC")) == []
