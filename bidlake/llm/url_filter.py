"""Operator 13: glob rules over URLs, all at once, by a bit-parallel wildcard automaton.

Every rule is a glob on the host and one on the path. The rules' positions are packed
into words of 64 bits; one Shift-And step per character moves all rules of all URLs of a
slice: ``D = ((D << 1) & B[c]) | (D & S[c])``, where B holds the positions that accept
the character's class and S those where a ``*`` may stay. A mark that no text holds ends
the host, so no wildcard of a host reaches into the path.

The host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, the path
what follows up to ``?``, ``#`` or the end; both rule lists see them in this form or, for
the globs of the method, in canonical form (without user, port and last dot; escapes of
plain characters decoded, dot segments resolved, slashes single).

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and gets
the default; null ids and equal rows get results of their own; URLs are read whole, one step a
character; an empty table gives no rows. Only the id and url columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import batch_of, begin, give_back, schema_of, slices

# Rules of the contract (verdict, host, path).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
# Globs (host, path) by which the method blocks URLs that no rule fits. A host glob starts at a label.
GLOBS = (
    ("spam-*", "*"), ("*casino*", "*"), ("*-pills*", "*"), ("*-bets*", "*"), ("adult-*", "*"), ("*porn*", "*"), ("*viagra*", "*"),
    ("ads-*", "*"), ("ads.*", "*"), ("tracker.*", "*"), ("*", "*/wp-login.php"), ("*", "*/affiliate/*"),
)

OUTPUT = schema_of(page_id="long", host="string", path="string", rule="string", verdict="string", canonical="string", blocked_by="string")

LOWER = {c: c + 32 for c in range(65, 91)}
PARTS = re.compile(r"[^/?#]*"), re.compile(r"[^?#]*")
PLAIN = re.compile(r"%([0-9A-Fa-f]{2})")
UNRESERVED = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~")
#: URLs left at which a slice goes on one by one.
FEW = 3


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path) as the contract has them."""
    at = (url or "").find("://")
    if at < 0:
        return "", ""
    host = PARTS[0].match(url, at + 3)
    return host[0].translate(LOWER), PARTS[1].match(url, host.end())[0]


def _decoded(m: re.Match) -> str:
    c = chr(int(m[1], 16))
    return c if c in UNRESERVED else m[0].upper()


def canonical(host: str, path: str) -> tuple[str, str]:
    """The host without user, port and last dots; the path with plain escapes decoded, dot segments
    resolved and slashes single."""
    host = re.sub(r":[0-9]*$", "", host.rpartition("@")[2]).rstrip(".")
    out: list[str] = []
    parts = [x for x in PLAIN.sub(_decoded, path).split("/") if x]
    for x in parts:
        if x == "..":
            del out[-1:]
        elif x != ".":
            out.append(x)
    ends = path.endswith("/") or (parts and parts[-1] in (".", ".."))
    return host, "/" + "/".join(out) + ("/" if ends and out else "") if path else ""


class Automaton:
    """The packed masks of globs on (host, path)."""

    def __init__(self, globs: Sequence[tuple[str, str]]):
        self.n = len(globs)
        every = [self._tokens(host, path) for host, path in globs]
        literals = sorted({t for tokens in every for t in tokens if isinstance(t, str) and len(t) == 1})
        self.mark = len(literals) + 1  # class 0 is every character that no rule names
        table = {c: k + 1 for k, c in enumerate(literals)}
        self.lut = np.zeros(max(map(ord, literals), default=0) + 2, dtype=np.intp)
        for c, k in table.items():
            self.lut[ord(c)] = k
        classes, bits = self.mark + 1, sum(1 + sum(t not in ("host*", "any*") for t in tokens) for tokens in every)
        take, stay, self.start, self.ends = [0] * classes, [0] * classes, 0, []
        at = 0
        for tokens in every:
            self.start |= 1 << at
            for t in tokens:
                if t in ("host*", "any*"):
                    for k in range(classes - 1):  # no wildcard passes the mark
                        stay[k] |= 1 << at
                    continue
                at += 1
                for k in range(classes - 1) if t == "one" else [self.mark if t == "mark" else table[t]]:
                    take[k] |= 1 << at
            self.ends.append(at)
            at += 1
        self.words = max(1, -(-bits // 64))
        self.take, self.stay = self._pack(take), self._pack(stay)
        self.take_int, self.stay_int = take, stay

    @staticmethod
    def _tokens(host: str, path: str) -> list[str]:
        """host* and a dot, the host's characters, the mark, the path's."""
        kind = {"*": "any*", "?": "one"}
        return ["host*", ".", *[kind.get(c, c) for c in host], "mark", *[kind.get(c, c) for c in path]]

    def _pack(self, masks: list[int]) -> np.ndarray:
        return np.frombuffer(b"".join(m.to_bytes(8 * self.words, "little") for m in masks), dtype="<u8").reshape(len(masks), self.words)

    def _classes(self, text: str) -> np.ndarray:
        return self.lut[np.minimum(np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4"), len(self.lut) - 1)]

    def match(self, urls: Sequence[tuple[str, str]]) -> np.ndarray:
        """For each (host, path) and glob, whether it fits the whole of both."""
        coded = [np.concatenate([self._classes("." + h), [self.mark], self._classes(p)]) for h, p in urls]
        sizes = np.array([len(c) for c in coded], dtype=np.int64)
        order = np.argsort(-sizes, kind="stable")
        flat = np.concatenate([coded[k] for k in order]) if len(urls) else np.zeros(0, dtype=np.intp)
        sizes = sizes[order]
        starts = np.cumsum(sizes) - sizes
        state = np.tile(self._pack([self.start]), (len(urls), 1))
        active, step = len(urls), 0
        falling = np.sort(sizes)
        while True:
            active = len(urls) - int(np.searchsorted(falling, step, side="right"))
            if active <= FEW:
                break
            c = flat[starts[:active] + step]
            d = state[:active]
            moved = d << np.uint64(1)
            moved[:, 1:] |= d[:, :-1] >> np.uint64(63)
            state[:active] = (moved & self.take[c]) | (d & self.stay[c])
            step += 1
        for k in range(active):  # the longest few, one by one in whole numbers
            d = int.from_bytes(state[k].astype("<u8").tobytes(), "little")
            for c in flat[starts[k] + step : starts[k] + sizes[k]].tolist():
                d = ((d << 1) & self.take_int[c]) | (d & self.stay_int[c])
                if not d:
                    break
            state[k] = self._pack([d])[0]
        out = np.zeros((len(urls), self.n), dtype=bool)
        for r, bit in enumerate(self.ends):
            out[order, r] = (state[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1) != 0
        return out


def judge_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, globs: Iterable[tuple[str, str]] = GLOBS, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of ``pages``: host, path, the longest of ``rules`` (verdict, host glob, path prefix) that fits the host or
    a parent domain and the path (the first listed of equal length), and the verdict: the rule's; without a rule ``block`` if one of ``globs``
    fits the canonical URL, else ``default``. Both lists are parameters, packed in the same masks; a task holds these alone."""
    rules, globs = list(rules), list(globs)
    named = [f"{host}{path}" for _, host, path in rules]
    longest = sorted(range(len(rules)), key=lambda k: -len(named[k]))
    arrow = to_arrow_schema(OUTPUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin()
        automaton = Automaton([(rules[k][1], rules[k][2] + "*") for k in longest] + globs)
        for rows in slices(batches):
            plain = [split_url(url) for _, url in rows]
            whole = [canonical(*x) for x in plain]
            again = [k for k, (a, b) in enumerate(zip(plain, whole, strict=True)) if a != b]
            fits = automaton.match(plain + [whole[k] for k in again])
            by_glob = fits[: len(rows), len(rules) :].copy()
            by_glob[again] = fits[len(rows) :, len(rules) :]
            out = []
            for k, (page, _) in enumerate(rows):
                host, path = plain[k]
                found = np.flatnonzero(fits[k, : len(rules)])
                hit = np.flatnonzero(by_glob[k])
                rule = longest[found[0]] if len(found) else None
                verdict = rules[rule][0] if rule is not None else "block" if len(hit) else default
                out.append((page, host, path, named[rule] if rule is not None else None, verdict, "".join(whole[k]), "".join(globs[hit[0]]) if len(hit) else None))
            yield batch_of(out, arrow)
        give_back()

    return pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url")).mapInArrow(run, OUTPUT)
