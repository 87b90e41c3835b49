"""Secret scans: a keyword automaton first, anchored patterns only at its hits, then checksums.

An Aho-Corasick automaton reads each whole text once and gives the places of all keywords. The
pattern of a keyword is tried only there, anchored. Token formats that carry a checksum are kept
only if it holds, so look-alikes do not count. Runs of hexadecimal digits have no keyword and
are found by one pattern of their own.

Kinds, in the order in which spans at one start are listed:

* `assign`: a password-like name, a sign, a value of 6 or more characters
* `access`: an access key id of 20 or more characters
* `hex`: 24 or more lower-case hexadecimal digits
* `github`, `npm`: prefixed tokens whose last six characters are the base-62 CRC-32 of the rest
* `iban`: account numbers of the registered countries, of their country's length, that satisfy the mod-97 check
* `private_key`: PEM private key blocks, header to footer

Defined cases: NULL text is empty text and has no spans; repeated rows are scanned each;
all columns but the id and the text are ignored. Spans count code points, the end is exclusive.
"""

from __future__ import annotations

import functools
import hashlib
import re
import zlib

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import by_batch, query, table

KINDS = ["assign", "access", "hex", "github", "npm", "iban", "private_key"]
BASE = KINDS[:3]

# Patterns and lengths of the base kinds. (Fixed values.)
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_CHARS, ACCESS_CHARS = 6, 20

GITHUB = re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9_])")
NPM = re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9_])")
PEM = re.compile(r"-----BEGIN ((?:[A-Z]+ )*PRIVATE KEY)-----")

# Lower-case keywords and the kind whose pattern is tried where they start. (Fixed values.)
KEYWORDS = {
    "password": "assign",
    "passwd": "assign",
    "secret": "assign",
    "token": "assign",
    "apikey": "assign",
    "api_key": "assign",
    "akia": "access",
    "ghp_": "github",
    "gho_": "github",
    "ghu_": "github",
    "ghs_": "github",
    "ghr_": "github",
    "npm_": "npm",
    "-----begin": "private_key",
}
# Length of the account numbers of each registered country. (Fixed values.)
IBAN_LENGTHS = {
    x[:2]: int(x[2:])
    for x in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 "
        "LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
    ).split()
}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62_crc(text: str) -> str:
    """CRC-32 of `text` as six base-62 digits."""
    n, out = zlib.crc32(text.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = BASE62[d] + out
    return out


def iban_ok(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


@functools.lru_cache(None)
def iban_pattern(country: str) -> re.Pattern:
    """Groups of four behind the check digits, then the rest; one blank before each at most."""
    groups, rest = divmod(IBAN_LENGTHS[country] - 4, 4)
    tail = rf"\x20?[A-Z0-9]{{{rest}}}" if rest else ""
    return re.compile(rf"{country}[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{{groups}}}{tail}(?![A-Za-z0-9])")


@functools.lru_cache(1)
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        a.add_word(word, (kind, len(word)))
    for country in IBAN_LENGTHS:  # an account number starts with the country and a check digit
        for digit in "0123456789":
            a.add_word(country.lower() + digit, ("iban", 3))
    a.make_automaton()
    return a


def _folded(text: str) -> str:
    """Lower case with every character at its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if c.isascii() else c for c in text)


def _assign(text, at):
    m = ASSIGN.match(text, at)
    return m and (m.end(), len(m[2]) >= ASSIGN_CHARS)


def _access(text, at):
    m = ACCESS.match(text, at)
    return m and (m.end(), m.end() - at >= ACCESS_CHARS)


def _checked(pattern):
    def at_hit(text, at):
        m = pattern.match(text, at)
        return m and (m.end(), base62_crc(m[1]) == m[2])

    return at_hit


def _iban(text, at):
    country = text[at : at + 2]
    if country not in IBAN_LENGTHS or at and text[at - 1].isalnum():
        return None
    m = iban_pattern(country).match(text, at)
    # a look-alike that fails uses up nothing, since a real number may start inside
    return m and iban_ok(m[0]) and (m.end(), True) or None


def _pem(text, at):
    """To the footer of the same label, before any other header; each character is looked at once."""
    if not (m := PEM.match(text, at)):
        return None
    other = text.find("-----BEGIN ", m.end())
    footer = f"-----END {m[1]}-----"
    end = text.find(footer, m.end(), len(text) if other < 0 else other)
    return (end + len(footer), True) if end >= 0 else None


_TRY = {"assign": _assign, "access": _access, "github": _checked(GITHUB), "npm": _checked(NPM), "iban": _iban, "private_key": _pem}


def find_secrets(text: str | None) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end), by start and then by kind as listed."""
    if not text:
        return []
    starts: dict[str, list[int]] = {}
    for last, (kind, n) in automaton().iter(_folded(text)):
        starts.setdefault(kind, []).append(last - n + 1)
    spans = [("hex", *m.span()) for m in HEX.finditer(text)]
    for kind, places in starts.items():
        done, attempt = 0, _TRY[kind]
        for at in sorted(places):
            if at >= done and (hit := attempt(text, at)):
                done = hit[0]  # a match that fails its check still uses up its characters
                if hit[1]:
                    spans.append((kind, at, done))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and `spans` ("kind:start:end" joined by commas) of every row."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return by_batch(
        rows, "doc_id bigint, spans string", lambda c: {"doc_id": c["doc_id"], "spans": [joined(find_secrets(t)) for t in c["text"]]}
    )


def redact(text: str | None, mask: str = "[SECRET]") -> str | None:
    """`text` with every span (overlapping ones together) replaced by `mask`."""
    spans = find_secrets(text)
    if not spans:
        return text
    out, done = [], 0
    for _, a, b in spans:
        if a >= done:
            out += [text[done:a], mask]
        done = max(done, b)
    return "".join([*out, text[done:]])


def redacted(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """`docs` with secrets replaced; rows and columns stay as they are."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def clean(texts):
        return texts.map(lambda t: redact(t, mask), na_action="ignore")

    return docs.withColumn(text_col, clean(F.col(f"`{text_col}`")))


@query("op8_secret_scan")
def op8_secret_scan(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "text")

    def digest(c):
        spans = [find_secrets(t) for t in c["text"]]
        base = [[s for s in x if s[0] in BASE] for x in spans]
        counts = {f"n_{k}": [sum(s[0] == k for s in x) for x in base] for k in BASE}
        sha = [hashlib.sha256(joined(x).encode()).hexdigest() for x in base]
        return {"doc_id": c["doc_id"], **counts, "base_sha256": sha, "spans": [joined(x) for x in spans]}

    schema = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"
    return by_batch(rows, schema, digest)
