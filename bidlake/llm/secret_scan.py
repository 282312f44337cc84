"""Operator 5: secrets by known forms and by token efficiency.

Known forms (assignments, access keys, long hex) are found by patterns. Beyond them, a
string that a byte-pair vocabulary packs badly, few characters to a token, is likely
random: such strings are reported unless they are known digests or identifiers.

Defined results: null and empty texts have no spans; spans count code points of the
whole text, in which bytes that are no UTF-8 are replacement characters; a very long run of
letters is one string; equal rows get equal results; empty input gives no rows. Only the id
and text columns are read, so extra columns never clash.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import partial

from pyspark.sql import DataFrame

from .common import id_and_bytes, map_rows, resident, schema_of, utf8

# The base patterns, the least lengths, and the order of kinds at one start.
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
LEAST_VALUE, LEAST_ACCESS = 6, 20
KINDS = ("assign", "access", "hex", "random")
#: What the token test looks at, and the digests and identifiers of known form that it leaves alone.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
KNOWN = re.compile(r"[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128}|[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")
#: Below this many characters a token a string counts as random (prose has 4 or more). Letters alone that
#: are no longer than a long word must be packed worse, as rare words of that length come close.
MAX_CHARS_PER_TOKEN, MAX_CHARS_PER_TOKEN_OF_WORD, LONG_WORD = 2.2, 1.8, 15

OUTPUT = schema_of(doc_id="long", n_assign="long", n_access="long", n_hex="long", base_sha256="string", spans="string", n_random="long")


def _encoding(ranks: bytes):
    import public_tokenizers
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks.splitlines() if x)}
    return tiktoken.Encoding("scan", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


def base_spans(text: str, body: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the known forms, leftmost and not overlapping within a kind."""
    low = body.lower()  # ASCII letters only
    out = []
    if any(k in low for k in KEYS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(1)) >= LEAST_VALUE]
    if b"AKIA" in body:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return out


def _scanner(shared):
    ranks = shared.value
    encoding = resident(("ranks", hashlib.sha256(ranks).digest()), lambda: _encoding(ranks))

    def row(doc_id, body):
        if not body:
            return doc_id, 0, 0, 0, hashlib.sha256(b"").hexdigest(), "", 0
        text = utf8(body)
        base = sorted(base_spans(text, body))
        spans = list(base)
        for m in CANDIDATE.finditer(text):
            s = m.group()
            if KNOWN.fullmatch(s):
                continue
            if any(a <= m.start() and m.end() <= b for a, _, b in base):
                continue
            most = MAX_CHARS_PER_TOKEN_OF_WORD if len(s) <= LONG_WORD and s.isalpha() else MAX_CHARS_PER_TOKEN
            if len(s) < most * len(encoding.encode_ordinary(s)):
                spans.append((m.start(), 3, m.end()))
        write = lambda xs: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(xs))
        n = [sum(k == i for _, k, _ in spans) for i in range(4)]
        return doc_id, n[0], n[1], n[2], hashlib.sha256(write(base).encode()).hexdigest(), write(spans), n[3]

    return row


def scan_secrets(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts of each known form, the digest of their spans, all spans
    as ``kind:start:end`` and the count of those that only the token test found. The vocabulary
    (a file of fixed size) is read on the driver and broadcast."""
    with open(ranks_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    return map_rows(id_and_bytes(docs, id_col, text_col), partial(_scanner, shared), OUTPUT)
