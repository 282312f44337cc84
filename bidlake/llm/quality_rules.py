"""Operator 10: line-first quality rules.

Each line is judged on its own: punctuation, navigation and boilerplate rules
name the lines that fail, those are removed, and a document that loses too much
of its text, or keeps too little, is rejected. Beside it stand whole-text counts and
two base rules (too few words, too many words in repeated 8-word windows).

Most rules look at the form of a line alone (separators, symbols, repetition, addresses, neighbouring
lines of few words without an end), whatever its language; the lists of navigation words and
boilerplate phrases beside them are English.

Defined results: null and empty texts have zero counts, fail the base rules and
keep nothing; lines are split at ``\\n``; rows without an id are judged too; equal rows get equal results;
texts of any length are worked through whole; empty input gives no rows. ``quality`` reads only the id and text
columns, so extra columns never clash; ``keep_good`` passes all of them on.
"""

from __future__ import annotations

import re
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHash, id_and_bytes, map_rows, mix64, schema_of

# What the line rules look for.
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\r\x0b\x0c"
ENDINGS = tuple(".!?…。！？।:;\"'”’»)]")
NAVIGATION = re.compile(r"(?:\S+\s*[|›»>•·]\s*){3,}\S*|(?:home|menu|login|log in|sign in|sign up|register|next|previous|back to top|skip to content|share|search)(?:\s+(?:home|menu|login|log in|sign in|sign up|register|next|previous|share|search))*\s*", re.I)
BOILERPLATE = ("javascript is disabled", "enable javascript", "accept cookies", "use of cookies", "uses cookies", "cookie policy", "privacy policy", "terms of use", "terms of service", "lorem ipsum", "subscribe to our newsletter", "click here to", "page not found")
#: Addresses, copyright marks, and neighbouring lines of at most so many words without an end that make a menu.
ADDRESS = re.compile(rb"(?:https?://|www\.)\S+|\S+@\S+\.\S+")
COPYRIGHT = re.compile(r"(?:©|\(c\)|copyright)\s*(?:©|\(c\))?\s*(?:19|20)\d\d", re.I)
MENU_LINES, MENU_WORDS = 4, 3
LINE_LIMITS = {"max_symbols_per_word": 0.3, "max_same_word": 0.5, "min_words_unpunctuated": 6}
MAX_LOST = 0.5  # share of the words that failed lines may hold
MIN_WORDS = 20
WINDOW, MAX_REPEATED = 8, 30  # words, per cent

OUTPUT = schema_of(
    doc_id="long", n_words="long", word_chars="long", n_symbols="long", n_dup_lines="long", n_repeat_words="long",
    base_failed="boolean", kept="boolean", n_failed_lines="long", n_words_lost="long",
)


def repeated_words(words: list[bytes], hashes: WordHash, window: int = WINDOW) -> int:
    """Words inside ``window``-word windows that occur twice or more, the first included."""
    n = len(words)
    if n <= window:
        return 0
    h = hashes.of(words)
    m = n - window + 1
    key = np.zeros(m, dtype=np.uint64)
    for k in range(window):
        key = mix64(key + h[k : k + m])
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(m, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = np.zeros(n + 1, dtype=np.int64)
    np.add.at(hit, np.flatnonzero(twice), 1)
    np.add.at(hit, np.flatnonzero(twice) + window, -1)
    return int((np.cumsum(hit[:n]) > 0).sum())


def line_fails(line: bytes, words: list[bytes], in_menu: bool = False) -> str:
    """The rule that a line with words breaks, or an empty string."""
    n = len(words)
    symbols = len(line) - len(line.translate(None, SYMBOLS))
    if symbols > LINE_LIMITS["max_symbols_per_word"] * n and symbols >= 2:
        return "navigation" if NAVIGATION.fullmatch(line.decode("utf-8", "replace").strip()) else "symbols"
    if n >= 4 and n - len(set(words)) >= n * LINE_LIMITS["max_same_word"] and n - len(set(words)) >= 4:
        # long prose lines repeat short words too; a failing line repeats a word next to itself
        runs = sum(a == b for a, b in zip(words, words[1:], strict=False))
        if runs >= n * 0.3:
            return "repetition"
    if in_menu:
        return "navigation"
    text = line.decode("utf-8", "replace").strip()
    if n <= 25:
        low = text.lower()
        if n <= 12 and NAVIGATION.fullmatch(low):
            return "navigation"
        if any(x in low for x in BOILERPLATE) or (n <= 12 and (COPYRIGHT.search(low) or 2 * len(ADDRESS.findall(line)) > n)):
            return "boilerplate"
    if n >= LINE_LIMITS["min_words_unpunctuated"] and not text.endswith(ENDINGS) and "." not in text:
        return "punctuation"
    return ""


def _menus(lines: list[bytes], words: list[list[bytes]]) -> set[int]:
    """Lines with words among ``MENU_LINES`` neighbours or more that are short and end in no sentence."""
    found: set[int] = set()
    run: list[int] = []
    for k, w in enumerate(words):
        if not w:
            continue
        if len(w) <= MENU_WORDS and not lines[k].decode("utf-8", "replace").rstrip().endswith(ENDINGS):
            run.append(k)
            continue
        if len(run) >= MENU_LINES:
            found.update(run)
        run = []
    return found.union(run) if len(run) >= MENU_LINES else found


def judge(body: bytes, lines: list[bytes], words: list[list[bytes]]) -> tuple[bytes, int, int]:
    """The text without its failing lines, how many failed and the words they held."""
    menu = _menus(lines, words)
    kept, failed, lost = [], 0, 0
    for k, (line, w) in enumerate(zip(lines, words, strict=True)):
        if w and line_fails(line, w, k in menu):
            failed += 1
            lost += len(w)
        else:
            kept.append(line)
    return b"\n".join(kept) if failed else body, failed, lost


def clean(body: bytes) -> tuple[bytes, int, int]:
    lines = body.split(b"\n")
    return judge(body, lines, [x.split() for x in lines])


def examine(doc_id, body, hashes: WordHash) -> tuple[tuple, bytes]:
    """A row of OUTPUT, and the text without its failing lines. The text is split once."""
    body = body or b""
    lines = body.split(b"\n")
    by_line = [x.split() for x in lines]
    words = [w for x in by_line for w in x]
    n = len(words)
    letters = len(body.translate(None, SPACES))
    points = letters if body.isascii() else len(body.translate(None, SPACES).decode("utf-8", "replace"))
    said = [x for x, w in zip(lines, by_line, strict=True) if w]
    again = repeated_words(words, hashes)
    base = n < MIN_WORDS or 100 * again > MAX_REPEATED * n
    text, failed, lost = judge(body, lines, by_line)
    kept = not base and lost <= MAX_LOST * n and n - lost >= MIN_WORDS
    symbols = len(body) - len(body.translate(None, SYMBOLS))
    return (doc_id, n, points, symbols, len(said) - len(set(said)), again, base, kept, failed, lost), text


def measure(doc_id, body, hashes: WordHash) -> tuple:
    return examine(doc_id, body, hashes)[0]


def _measure():
    return partial(measure, hashes=WordHash())


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the counts, ``base_failed``, ``kept``, and what the line rules took."""
    return map_rows(id_and_bytes(docs, id_col, text_col), _measure, OUTPUT)


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that pass, without their failing lines, with all columns of ``docs``.

    Rows are judged where they stand, in the batch that holds their other columns, so no join on
    the id is needed.
    """
    from .stages import rewrite_texts

    return rewrite_texts(docs, text_col, _judge_text)


def _judge_text():
    hashes = WordHash()

    def text(body):
        row, cleaned = examine(0, body, hashes)
        return cleaned if row[7] else None

    return text


def quality_digest(docs: DataFrame) -> DataFrame:
    """What the contract asks for, in its order, and the line rules' counts after it."""
    return quality(docs).select(*[F.col(f.name) for f in OUTPUT])
