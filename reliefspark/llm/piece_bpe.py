"""SentencePiece encoding and decoding of merge-type models with byte fallback.

Exact encoding by backtracking: an Aho-Corasick automaton gives every piece that begins at a place, the longest is tried
first, two neighbours are compatible if merging their joined text anew gives the same two, and a bitfield remembers
places from which no encoding was found."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, values

SPACE = "▁"
#: Words whose ids a worker remembers; then it forgets all and begins anew.
MEMO_WORDS = 400_000
#: Longer words are encoded each time, so that the memory of a worker stays bounded.
MEMO_CHARS = 64
#: Pairs of pieces whose compatibility a worker remembers.
MEMO_PAIRS = 2_000_000


class _Memo(dict):
    def __init__(self, make, most: int):
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self.make(key)
        if not isinstance(key, str) or len(key) <= MEMO_CHARS:
            self[key] = value
        return value


class PieceBPE:
    """model_file: a SentencePiece model of type BPE with identity normalisation, a dummy prefix, all white space kept, and
    no piece in which a space mark follows another character (so that words are encoded each alone)."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.vocab_size()
        self.bos, self.eos = sp.bos_id(), sp.eos_id()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        byte = {i: int(self.pieces[i][3:5], 16) for i in range(n) if sp.is_byte(i)}
        self.byte_id = {b: i for i, b in byte.items()}
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        if len(self.byte_id) != 256 or any(re.search(f"[^{SPACE}]{SPACE}", self.pieces[i]) for i in plain):
            raise ValueError("not a model of the kind that this encoder is exact for")
        self.ids = {self.pieces[i]: i for i in plain}
        self.merge_score = {self.pieces[i]: sp.get_score(i) for i in plain if len(self.pieces[i]) > 1}
        self.output = [bytes([byte[i]]) if i in byte else b"" if sp.is_control(i) else " ⁇ ".encode() if sp.is_unknown(i) else self.pieces[i].replace(SPACE, " ").encode() for i in range(n)]
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        self.chars = {p for p in self.ids if len(p) == 1}
        self.compatible = _Memo(self._compatible, MEMO_PAIRS)
        self.word = _Memo(lambda w: np.array(self.segment(SPACE + w), "<u4").tobytes(), MEMO_WORDS)

    def merged(self, text: str) -> list[str]:
        """The definition: the best-scored neighbours whose joined text is a piece are merged, leftmost first, till none is left."""
        s, score = list(text), self.merge_score
        while True:
            best, at = None, -1
            for k in range(len(s) - 1):
                x = score.get(s[k] + s[k + 1])
                if x is not None and (best is None or x > best):
                    best, at = x, k
            if best is None:
                return s
            s[at : at + 2] = [s[at] + s[at + 1]]

    def _compatible(self, pair: int) -> bool:
        a, b = pair >> 32, pair & 0xFFFFFFFF
        left = [self.pieces[a - 1]] if a else []
        return self.merged("".join(left) + self.pieces[b]) == [*left, self.pieces[b]]

    def _known(self, s: str) -> list[int]:
        """Ids of a text whose characters are all pieces."""
        n = len(s)
        at: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, found in self.automaton.iter(s):
            at[end - found[1] + 1].append(found)  # of one start, in order of length
        out: list[int] = []
        tried: list[tuple[int, int]] = []
        pos, k, failed, ok = 0, len(at[0]) - 1, bytearray((n >> 3) + 1), self.compatible  # a bit for each place
        while pos < n:
            here = at[pos]
            before = (out[-1] + 1) << 32 if out else 0
            while k >= 0:
                i, size = here[k]
                end = pos + size
                if not failed[end >> 3] >> (end & 7) & 1 and ok[before | i]:
                    break
                k -= 1
            if k >= 0:
                out.append(i)
                tried.append((pos, k))
                pos += size
                k = len(at[pos]) - 1 if pos < n else 0
            else:
                failed[pos >> 3] |= 1 << (pos & 7)
                out.pop()
                pos, k = tried.pop()
                k -= 1
        return out

    def segment(self, s: str) -> list[int]:
        """Ids of a word with its space marks; characters that are no piece become their UTF-8 bytes."""
        if self.chars.issuperset(s):
            return self._known(s) if s else []
        out: list[int] = []
        begin = 0
        for k, c in enumerate(s):
            if c not in self.chars:
                if k > begin:
                    out += self._known(s[begin:k])
                out += [self.byte_id[b] for b in c.encode()]
                begin = k + 1
        return out + (self._known(s[begin:]) if begin < len(s) else [])

    def encode_bytes(self, text: str | None) -> bytes:
        """All ids, with begin and end, as little-endian unsigned 32-bit integers."""
        ends = (np.array([self.bos], "<u4").tobytes(), np.array([self.eos], "<u4").tobytes())
        if not text:
            return b"".join(ends)
        words = text.replace(SPACE, " ").split(" ")
        if "" not in words:
            return b"".join([ends[0], *map(self.word.__getitem__, words), ends[1]])
        parts, marks = [ends[0]], 0
        for w in words:
            marks += 1
            if not w:
                continue
            parts.append(self.word[w] if marks == 1 else self.word[SPACE * (marks - 1) + w])
            marks = 0
        if marks:
            parts.append(self.word[SPACE * (marks - 1)])
        return b"".join([*parts, ends[1]])

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode_bytes(self, ids: list[int]) -> bytes:
        """UTF-8 of the decoded text: pieces and bytes joined, space marks as spaces, less the dummy prefix."""
        out = b"".join(map(self.output.__getitem__, ids))
        first = next((self.pieces[i] for i in ids if self.output[i]), "")
        return out[1:] if first.startswith(SPACE) else out

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


_LOADED: dict[str, PieceBPE] = {}


def load(model_file: str | None = None) -> PieceBPE:
    """The encoder of a model file, once a process; None: the 32,000 pieces among the public tokenizers."""
    if model_file is None:
        import public_tokenizers

        model_file = public_tokenizers.path("piece_bpe_32k.model")
    if model_file not in _LOADED:
        _LOADED[model_file] = PieceBPE(str(model_file))
    return _LOADED[model_file]


def tokenize(docs: DataFrame, model_file: str | None = None, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256, and, if with_ids, ids array<int> and decoded.

    Null and empty texts have the begin and the end id, and decode to the empty text. Rows that repeat an id, and null
    ids, are encoded each. Other columns are not looked at."""
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(model_file)
        for b in batches:
            rows: list[tuple] = []
            for text in values(b.column(1)):
                data = bpe.encode_bytes(text)
                ids = np.frombuffer(data, "<u4").tolist()
                decoded = bpe.decode_bytes(ids)
                rows.append((len(ids), hashlib.sha256(data).hexdigest(), hashlib.sha256(decoded).hexdigest()) + ((ids, decoded.decode("utf-8", "replace")) if with_ids else ()))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()][: len(names) - 1]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    return small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, schema)
