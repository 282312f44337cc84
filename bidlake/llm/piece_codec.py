"""Operator 9: SentencePiece encoding and decoding with a prefix table.

For a merge-type (BPE) vocabulary the last token of every prefix of a word is
unique: it is the longest vocabulary token that ends there and whose pairing
with the last token of the shorter prefix survives merging. An Aho-Corasick
automaton over the pieces lists the tokens that end at each position, a memoised
pair test says which one fits, and the ids are read off backwards.

Words are encoded apart: but for pure runs of the space mark no piece holds
the mark after its first character, which is checked when the model is loaded, so
no merge crosses the place before a mark. Runs of marks have tied scores and
are merged by their own rule (:meth:`PieceCodec.marks`).

Defined results: null and empty texts give no ids and decode to an empty text;
characters that the vocabulary lacks become byte tokens; bytes that are no UTF-8 are read as
the replacement character; very long texts are worked through word by word; repeated rows are
encoded alike; empty input gives no rows. Only the id and text columns are read, so extra
columns never clash. A worker remembers words and token pairs up to a number of bytes.
"""

from __future__ import annotations

import hashlib
import heapq
from functools import partial
from itertools import chain

from pyspark.sql import DataFrame

from .common import id_and_bytes, map_rows, resident, schema_of, utf8

MARK = "▁"
OUTPUT = schema_of(doc_id="long", n_tokens="long", ids_sha256="string", decoded_sha256="string")
OUTPUT_IDS = schema_of(doc_id="long", ids="array<int>", decoded="string")
_NEVER = 1 << 60


class PieceCodec:
    """Encoder for one SentencePiece BPE model with an identity normaliser."""

    #: Token pairs that are remembered before their memory is emptied, and the bytes for words and for runs of marks.
    PAIRS, WORD_BYTES, RUN_BYTES = 250_000, 40_000_000, 1_000_000

    def __init__(self, model: bytes):
        import ahocorasick
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback:
            raise ValueError("the model must be of BPE type with byte fallback")
        if spec.name != "identity" or spec.remove_extra_whitespaces or not (spec.add_dummy_prefix and spec.escape_whitespaces):
            raise ValueError("the model must keep texts as they are but for the space mark")
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        normal = [(i, p) for i, p in enumerate(proto.pieces) if p.type == 1]
        if any(MARK in p.piece[1:] and p.piece.strip(MARK) for _, p in normal):
            raise ValueError("a piece holds the space mark inside")
        self.id = {p.piece: i for i, p in normal}
        self.piece = [p.piece for p in proto.pieces]
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        order = sorted(normal, key=lambda x: -x[1].score)
        self.rank = {i: r for r, (i, _) in enumerate(order)}
        self.parts: dict[int, tuple[int, int]] = {}
        self.automaton = ahocorasick.Automaton()
        for i, p in normal:
            text = p.piece
            if len(text) > 1 and text.strip(MARK):
                ids = self._merge(text, stop=i)
                if len(ids) != 2:  # merging never yields this piece
                    continue
                self.parts[i] = (ids[0], ids[1])
            self.automaton.add_word(text, (i, len(text)))
        self.automaton.make_automaton()
        #: Characters that end words, each with the pairs that some piece holds: in a text
        #: with none of those pairs no token reaches over the place before the character.
        self.stops = {c: sorted({t[k : k + 2] for t in self.id for k in range(len(t) - 1) if t[k + 1] == c}) for c in ".,\n"}
        self.pairs: dict[int, bool] = {}
        self.words = _Words(self.word, self.WORD_BYTES)
        self.size = [len(x) for x in self.piece]
        self.plain = {i: p.piece.replace(MARK, " ") for i, p in normal}
        self.plain |= {i: chr(b) for b, i in self.bytes.items() if b < 128 and b != 32}
        self.runs: dict[int, list[int]] = {0: []}
        self.run_bytes = 0

    def _merge(self, text: str, stop: int = -1) -> list[int]:
        """Plain BPE by rank, leftmost first; ends before it makes ``stop``."""
        ids = [self.id.get(c, -1) for c in text]
        while len(ids) > 1:
            best, at = _NEVER, -1
            for k in range(len(ids) - 1):
                made = self.id.get(self.piece[ids[k]] + self.piece[ids[k + 1]]) if ids[k] >= 0 <= ids[k + 1] else None
                if made is not None and (r := self.rank[made]) < best:
                    best, at, new = r, k, made
            if at < 0 or (new == stop and len(ids) == 2):
                break
            ids[at : at + 2] = [new]
        return ids

    def _spine(self, token: int, side: int) -> list[int]:
        """The token, its outer part on one side, that part's, ... down to one character."""
        out = [token]
        while token in self.parts:
            token = self.parts[token][side]
            out.append(token)
        return out

    def fits(self, left: int, right: int) -> bool:
        """Whether merging ``left``'s text followed by ``right``'s keeps this border.

        Both tokens grow from the border's two characters, each step at its own rank.
        The border goes if at some time what stands on either side can merge before
        the next step of either; at equal ranks the merge further left comes first.
        """
        a, b = self._spine(left, 1), self._spine(right, 0)
        i, j, ok = len(a) - 1, len(b) - 1, True
        while True:
            next_a = self.rank[a[i - 1]] if i else _NEVER
            next_b = self.rank[b[j - 1]] if j else _NEVER
            made = self.id.get(self.piece[a[i]] + self.piece[b[j]])
            if made is not None and (r := self.rank[made]) < next_a and r <= next_b:
                ok = False
                break
            if not i and not j:
                break
            if next_a <= next_b:
                i -= 1
            else:
                j -= 1
        if len(self.pairs) >= self.PAIRS:
            self.pairs.clear()
        self.pairs[left << 20 | right] = ok
        return ok

    def word(self, text: str) -> tuple[int, ...]:
        """Ids of a text without the mark but perhaps at its start.

        ``last[k]`` is the prefix table: the last token of the first ``k`` characters,
        or -1 where the last of them is in no piece and stands on its own as bytes.
        """
        n = len(text)
        last = [-1] * (n + 1)
        known = self.pairs.get
        for end, (token, length) in self.automaton.iter(text):
            end += 1
            if last[end] < 0:
                if end == length:
                    last[end] = token
                    continue
                before = last[end - length]
                if before < 0 or (ok := known(before << 20 | token)) or (ok is None and self.fits(before, token)):
                    last[end] = token
        out: list[int] = []
        at = n
        while at:
            token = last[at]
            if token < 0:
                out.extend(self.bytes[c] for c in reversed(text[at - 1].encode("utf-8")))
                at -= 1
            else:
                out.append(token)
                at -= self.size[token]
        out.reverse()
        return tuple(out)

    def marks(self, n: int) -> list[int]:
        """Ids of ``n`` marks in a row: the best score first and, as scores tie, the
        leftmost of the pairs; every merge puts its two new neighbours in the queue."""
        if n in self.runs:
            return self.runs[n]
        score = {i: self.library.get_score(self.id[t]) for t in self.id if not t.strip(MARK) for i in [len(t)]}
        size, nxt, prev = [1] * n, list(range(1, n + 1)), list(range(-1, n - 1))
        queue: list[tuple[float, int, int, int, int]] = []

        def offer(x: int, y: int) -> None:
            if 0 <= x and y < n and size[x] + size[y] in score:
                heapq.heappush(queue, (-score[size[x] + size[y]], x, y, size[x], size[y]))

        for k in range(n - 1):
            offer(k, k + 1)
        while queue:
            _, x, y, sx, sy = heapq.heappop(queue)
            if size[x] != sx or size[y] != sy or nxt[x] != y:
                continue
            size[x], size[y] = sx + sy, 0
            nxt[x] = nxt[y]
            if nxt[x] < n:
                prev[nxt[x]] = x
            offer(prev[x], x)
            offer(x, nxt[x])
        ids, k = [], 0
        while k < n:
            ids.append(self.id[MARK * size[k]])
            k = nxt[k]
        self.run_bytes += 8 * len(ids) + 200
        if self.run_bytes < self.RUN_BYTES:
            self.runs[n] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        text = MARK + text.replace(MARK, " ").replace(" ", " " + MARK)
        for stop, pairs in self.stops.items():
            if stop in text and not any(map(text.__contains__, pairs)):
                text = text.replace(stop, " " + stop)
        units = text.split(" ")
        words = self.words
        if MARK not in units:  # no two spaces meet and none ends the text
            return list(chain.from_iterable(map(words.__getitem__, units)))
        out: list[int] = []
        run, lone = 0, self.id[MARK]
        for unit in units:
            if unit == MARK:
                run += 1
                continue
            ids = words[unit]
            if not run:
                out.extend(ids)
            elif ids[0] == lone:  # the last mark of the run joined no letter
                out.extend(self.marks(run + 1))
                out.extend(ids[1:])
            else:
                out.extend(self.marks(run))
                out.extend(ids)
            run = 0
        out.extend(self.marks(run))
        return out

    def decode(self, ids: list[int]) -> str:
        """The library's ``decode(ids)``: the pieces one after another, marks as spaces
        but for the one in front of the text, bytes of ASCII as they are; the library
        itself puts other runs of byte tokens together."""
        try:
            text = "".join(map(self.plain.__getitem__, ids))
        except KeyError:
            return self.library.decode(ids)
        return text[1:] if text[:1] == " " else text


class _Words(dict):
    """word -> ids, worked out when first asked for; emptied when its words pass a number of bytes."""

    #: What an entry takes beside the characters and ids: text object, tuple, place in the table.
    EACH = 220

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.held = make, most, 0

    def __missing__(self, text: str) -> tuple[int, ...]:
        ids = self.make(text)
        size = 4 * len(text) + 8 * len(ids) + self.EACH
        if size <= self.most // 100:  # a very long word is not kept
            self.held += size
            if self.held > self.most:
                self.clear()
                self.held = size
            self[text] = ids
        return ids


def _codec(shared) -> PieceCodec:
    """One codec for a Python worker and model, kept between tasks of this operator."""
    model = shared.value
    return resident(("pieces", hashlib.sha256(model).digest()), lambda: PieceCodec(model))


def _digests(shared):
    codec = _codec(shared)
    decimal = [str(i) for i in range(len(codec.piece))].__getitem__

    def row(doc_id, body):
        ids = codec.encode(utf8(body)) if body else []
        decoded = codec.decode(ids) if ids else ""
        return (
            doc_id, len(ids), hashlib.sha256(",".join(map(decimal, ids)).encode()).hexdigest(),
            hashlib.sha256(decoded.encode("utf-8")).hexdigest(),
        )

    return row


def _ids(shared):
    codec = _codec(shared)

    def row(doc_id, body):
        ids = codec.encode(utf8(body)) if body else []
        return doc_id, ids, codec.decode(ids) if ids else ""

    return row


def _model(docs: DataFrame, model_path: str):
    with open(model_path, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encode_texts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array, decoded text of every row. The model (a vocabulary file of
    fixed size) is read on the driver and broadcast."""
    return map_rows(id_and_bytes(docs, id_col, text_col), partial(_ids, _model(docs, model_path)), OUTPUT_IDS)


def encode_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: :func:`encode_texts` with the
    digests taken beside the encoder, so that ids need not travel."""
    return map_rows(id_and_bytes(docs, id_col, text_col), partial(_digests, _model(docs, model_path)), OUTPUT)
