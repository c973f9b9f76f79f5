"""SentencePiece encoding and decoding of whole texts, exactly as the library does for merge-type (BPE) models.

Encoding is by backtracking, not by a merge queue. A token sequence is the encoding of a text just if every two
neighbours are compatible: merging the characters of the two again gives the same two tokens. So an Aho-Corasick
automaton finds, for each place, the tokens that start there; the longest goes first; if it is not compatible with the
token before, the next shorter one is tried; a place at which nothing fits is marked in a bitfield as failed and never
tried again. Compatibility is found by re-merging and remembered for each pair.

No piece holds white space after another character, or a line feed, so texts fall into words that are encoded apart, and
frequent words are remembered in a table of bounded size. Characters without a piece become UTF-8 byte pieces.

Defined cases: a null text is like an empty one, which has no tokens but the end id; a text of any length is encoded
whole; rows that repeat are encoded each; columns beyond doc_id and text play no part.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import freed, only, slices

MARK = "▁"
#: Twice so many words are remembered by each Python worker, of so many characters at most, and so many token pairs: a bound on its memory.
CACHE_WORDS, CACHE_CHARS, PAIRS = 120_000, 32, 200_000


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceModel:
    """Pieces, scores and kinds of a merge-type model; encodes and decodes."""

    def __init__(self, path: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        self.end = lib.eos_id()
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.byte = [0] * 256
        self.surface: list[bytes] = []
        self.is_byte = [lib.is_byte(i) for i in range(n)]
        for i in range(n):
            piece = lib.id_to_piece(i)
            if self.is_byte[i]:
                value = int(piece[3:5], 16)
                self.byte[value] = i
                self.surface.append(bytes([value]))
            elif lib.is_control(i) or lib.is_unknown(i):
                self.surface.append(b"" if lib.is_control(i) else " ⁇ ".encode())
            else:
                if MARK in piece.lstrip(MARK) or "\n" in piece:
                    raise ValueError("pieces that cross words are not supported")
                self.id[piece], self.score[piece] = i, lib.get_score(i)
                self.surface.append(piece.replace(MARK, " ").encode())
        self.marked = [i < n and lib.id_to_piece(i).startswith(MARK) for i in range(n)]
        self.automaton = ahocorasick.Automaton()
        for piece in self.id:
            self.automaton.add_word(piece, (len(piece), self.id[piece]))
        self.automaton.make_automaton()
        self.piece = {i: piece for piece, i in self.id.items()}
        self.pairs: dict[int, bool] = {}
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def merged(self, text: str) -> list[str]:
        """Pieces by merging: the best-scoring neighbours first, the leftmost of equals."""
        parts: list[str | None] = list(text)
        left, right = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
        score = self.score
        heap = [(-score[p], i, p) for i in range(len(parts) - 1) if (p := parts[i] + parts[i + 1]) in score]
        heapify(heap)
        while heap:
            _, i, p = heappop(heap)
            if parts[i] is None or (j := right[i]) >= len(parts) or parts[i] + parts[j] != p:
                continue
            parts[i], parts[j] = p, None
            right[i] = right[j]
            if right[i] < len(parts):
                left[right[i]] = i
                if (q := p + parts[right[i]]) in score:
                    heappush(heap, (-score[q], i, q))
            if left[i] >= 0 and (q := parts[left[i]] + p) in score:
                heappush(heap, (-score[q], left[i], q))
        return [p for p in parts if p is not None]

    def compatible(self, a: int, b: int) -> bool:
        """Whether token b may follow a; a is -1 at the start and after a character without a piece."""
        pair = self.piece[b] if a < 0 else self.piece[a] + self.piece[b]
        known = self.merged(pair) == ([pair] if a < 0 else [self.piece[a], self.piece[b]])
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        self.pairs[a << 16 | b] = known
        return known

    def ids_of(self, text: str) -> list[int]:
        """The ids of a text without a line feed; characters without a piece become bytes."""
        n, pairs = len(text), self.pairs
        at: list[list[tuple[int, int]] | None] = [None] * n  # (length, id) of the tokens that start at a place, shorter ones first
        for last, token in self.automaton.iter(text):
            start = last + 1 - token[0]
            if at[start] is None:
                at[start] = [token]
            else:
                at[start].append(token)
        failed, any_failed = bytearray(n // 8 + 1), False
        out: list[int] = []
        trail: list[tuple[int, int]] = []  # of each step: its place, and which of the candidates it took (-1: bytes)
        place, k, before = 0, -1, -1
        while place < n:
            options = at[place]
            if options is None:
                out.append(-1 - ord(text[place]))
                trail.append((place, -1))
                place, k, before = place + 1, -1, -1
                continue
            k = len(options) - 1 if k < 0 else k - 1
            while k >= 0:
                size, token = options[k]
                if not any_failed or not failed[place + size >> 3] >> (place + size & 7) & 1:
                    fits = pairs.get(before << 16 | token)
                    if fits if fits is not None else self.compatible(before, token):
                        break
                k -= 1
            if k >= 0:
                out.append(token)
                trail.append((place, k))
                place, k, before = place + size, -1, token
            else:
                failed[place >> 3] |= 1 << (place & 7)
                any_failed = True
                out.pop()
                place, k = trail.pop()
                before = out[-1] if out and out[-1] >= 0 else -1
        if min(out, default=0) >= 0:
            return out
        return [i for x in out for i in ((x,) if x >= 0 else [self.byte[b] for b in chr(-1 - x).encode("utf-8", "surrogatepass")])]

    def encode(self, text: str | None) -> list[int]:
        """All ids of a whole text, with the end id."""
        out: list[int] = []
        if text:
            for n, line in enumerate((MARK + text.replace(" ", MARK)).split("\n")):
                if n:
                    out.append(self.byte[10])
                for word in SPLIT(line):
                    ids = self.young.get(word)
                    out += ids if ids is not None else self._missing(word)
        out.append(self.end)
        return out

    def _missing(self, word: str) -> tuple[int, ...]:
        """Ids of a word that is not among the young ones; words asked for again move from the old ones."""
        ids = self.old.get(word)
        if ids is None:
            ids = tuple(self.ids_of(word))
        if len(word) <= CACHE_CHARS:
            if len(self.young) >= CACHE_WORDS:
                self.old, self.young = self.young, {}
            self.young[word] = ids
        return ids

    def decode(self, ids: list[int]) -> str:
        """As the library's decode(ids): a leading space that the model added is taken off again."""
        raw = b"".join(map(self.surface.__getitem__, ids))
        first = next((i for i in ids if self.surface[i]), None)
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            text = self._broken(ids)
        return text[1:] if first is not None and self.marked[first] else text

    def _broken(self, ids: list[int]) -> str:
        """Bytes that are no UTF-8 become one replacement character each."""
        out, run = [], bytearray()

        def flush():
            i = 0
            while i < len(run):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[i : i + n]).decode())
                        i += n
                        break
                    except UnicodeDecodeError:
                        pass
                else:
                    out.append("�")
                    i += 1
            run.clear()

        for i in ids:
            if self.is_byte[i]:
                run += self.surface[i]
            else:
                flush()
                out.append(self.surface[i].decode())
        flush()
        return "".join(out)


SPLIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall
_models: dict[str, PieceModel] = {}


def model_at(path: str) -> PieceModel:
    """One model for each worker process."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded): token ids of each whole text, end id included, and the text they decode to."""
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_at(path)
        for batch in freed(batches):
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                ids = [model.encode(t.as_py()) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(map(model.decode, ids), pa.string())], ["doc_id", "ids", "decoded"])

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encoding each whole text and decoding it again."""
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_at(path)
        decimal = [str(i) for i in range(len(model.surface))]
        for batch in slices(freed(batches)):
            rows = []
            for t in batch.column(1):
                ids = model.encode(t.as_py())
                text = model.decode(ids)
                rows.append((len(ids), hashlib.sha256(" ".join(map(decimal.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()))
            n, a, b = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
