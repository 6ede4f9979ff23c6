"""SentencePiece BPE encoding by backtracking, and decoding.

A token sequence is the result of the merges exactly if each two adjacent
tokens are: merging their joint text again gives the same two. The encoder
takes the longest vocabulary match at each place (from an Aho-Corasick
automaton over the pieces), tests it against the token before, tries shorter
pieces, and steps back where none fits; a bit field remembers places from
which no valid ending exists, so no place is tried twice.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidewell.llm._shared import read_table
from tidewell.operators.batches import slices

SPACE = "▁"
CACHE_LIMIT = 200_000  # entries, some 250 bytes each


class PieceModel:
    """Vocabulary of a SentencePiece BPE model file, with its own encoder.

    Only the vocabulary (pieces, scores, kinds) is taken from the library. The
    model must have byte fallback, add a leading space, keep white space and
    leave characters unchanged; this is probed, and other models are refused.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        probe = " a  éﬁ\n\tb "
        if model.normalize(probe) != SPACE + probe.replace(" ", SPACE) or model.normalize(""):
            raise ValueError("only models that keep characters and white space are supported")
        self.rank: dict[str, float] = {}
        self.id_of: dict[str, int] = {}
        self.byte_id: list[int] = [-1] * 256
        self.raw: list[bytes] = []
        self.byte_ids: set[int] = set()
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_id[value] = i
                self.byte_ids.add(i)
                self.raw.append(bytes([value]))
            elif model.is_control(i):
                self.raw.append(b"")
            elif model.is_unknown(i):
                self.raw.append(" ⁇ ".encode())
            else:
                self.rank[piece], self.id_of[piece] = -model.get_score(i), i
                self.raw.append(piece.replace(SPACE, " ").encode())
        if -1 in self.byte_id:
            raise ValueError("a model with byte fallback is needed")
        self.digits = [str(i) for i in range(len(self.raw))]
        automaton = ahocorasick.Automaton()
        for piece in self.id_of:
            automaton.add_word(piece, len(piece))
        automaton.make_automaton()
        self.automaton = automaton
        self.prefix = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in self.id_of), None) for p in self.id_of}
        # Pieces have spaces at their start only, and characters that are no
        # piece end every match: texts fall apart there without change.
        if any(SPACE in p.lstrip(SPACE) for p in self.id_of):
            raise ValueError("pieces that cross words are not supported")
        hard = "" if any("\n" in p for p in self.id_of) else "\n"
        self.chunk = re.compile(f"{hard}|{SPACE}+[^{SPACE}{hard}]*|[^{SPACE}{hard}]+".lstrip("|"))
        self.characters = {p for p in self.id_of if len(p) == 1}
        self.foreign = re.compile("([^" + "".join(map(re.escape, sorted(self.characters))) + "]+)")
        self.fits: dict[tuple[str, str], bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}

    def merge(self, text: str) -> list[str]:
        """The plain rule, for short texts: join the adjacent pair that makes
        the best-ranked piece, the leftmost of equals, until none is left."""
        parts = list(text)
        while True:
            best = min(((r, k) for k in range(len(parts) - 1) if (r := self.rank.get(parts[k] + parts[k + 1])) is not None), default=None)
            if best is None:
                return parts
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def compatible(self, left: str, right: str) -> bool:
        """Whether merging the text of two tokens again gives the same two."""
        key = (left, right)
        found = self.fits.get(key)
        if found is None:
            found = self.merge(left + right) == [left, right]
            if len(self.fits) > CACHE_LIMIT:
                self.fits.clear()
            self.fits[key] = found
        return found

    def split(self, text: str) -> list[str]:
        """Pieces of a text without characters that are no piece."""
        size = len(text)
        longest = [0] * size
        for end, length in self.automaton.iter(text):
            if length > longest[end + 1 - length]:
                longest[end + 1 - length] = length
        failed = bytearray(size // 8 + 1)  # a bit for each place without an ending
        fits, prefix = self.fits, self.prefix
        tokens: list[str] = []
        at, last = 0, ""
        token: str | None = text[: longest[0]] if text else None
        while at < size:
            while token is not None:
                end = at + len(token)
                if not failed[end >> 3] >> (end & 7) & 1:
                    if not tokens:
                        break
                    fit = fits.get((last, token))
                    if fit or fit is None and self.compatible(last, token):
                        break
                token = prefix[token]
            if token is None:  # nothing fits here: never come back to this place
                failed[at >> 3] |= 1 << (at & 7)
                token = tokens.pop()
                at -= len(token)
                last = tokens[-1] if tokens else ""
                token = prefix[token]
            else:
                tokens.append(token)
                last, at = token, end
                token = text[at : at + longest[at]] if at < size else None
        return tokens

    def _encode_chunk(self, text: str) -> tuple[int, ...]:
        id_of = self.id_of
        if self.characters.issuperset(text):
            return tuple([id_of[p] for p in self.split(text)])
        ids: list[int] = []
        for run in self.foreign.split(text):
            if run and run[0] not in id_of:
                ids.extend(self.byte_id[b] for b in run.encode())
            else:
                ids.extend(id_of[p] for p in self.split(run))
        return tuple(ids)

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text; null and empty texts have none."""
        if not text:
            return []
        known = self.known
        chunks = self.chunk.findall(SPACE + text.replace(" ", SPACE))
        for c in chunks:
            if c not in known:
                known[c] = self._encode_chunk(c)
        ids = list(chain.from_iterable(map(known.__getitem__, chunks)))
        if len(known) > CACHE_LIMIT:
            known.clear()
        return ids

    def forget(self) -> None:
        """Drops what was learned from texts. Python workers live on from stage
        to stage, so it would take memory that later ones need."""
        self.known.clear()
        self.fits.clear()

    def decode(self, ids: list[int]) -> str:
        """Text of ids; the leading space that encoding adds is taken off, and
        bytes that are no UTF-8 become U+FFFD each."""
        data = b"".join(map(self.raw.__getitem__, ids))
        if ids and ids[0] not in self.byte_ids and data[:1] == b" ":
            data = data[1:]
        try:
            return data.decode()
        except UnicodeDecodeError:
            return self._decode_loose(data)

    @staticmethod
    def _decode_loose(data: bytes) -> str:
        out, at = [], 0
        while at < len(data):
            for n in (1, 2, 3, 4):
                try:
                    out.append(data[at : at + n].decode())
                    at += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


_models: dict[str, PieceModel] = {}


def piece_model(path: str) -> PieceModel:
    """The model, built once in a Python worker."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encode_pieces(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per row ``id_col, n_tokens, ids_sha256, decoded_sha256``, and ``ids``
    (array of int) if asked for.

    Null texts are empty; an empty text has no ids and decodes to itself. Ids
    may be null or repeated; other columns are not carried.
    """
    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_model(model)
        digits = pieces.digits
        try:
            for batch in (part for whole in batches for part in slices(whole)):
                counts, hashes, decoded, kept = [], [], [], []
                for text in batch.column(1).to_pylist():
                    ids = pieces.encode(text)
                    counts.append(len(ids))
                    hashes.append(hashlib.sha256(",".join(map(digits.__getitem__, ids)).encode()).hexdigest())
                    decoded.append(hashlib.sha256(pieces.decode(ids).encode()).hexdigest())
                    if with_ids:
                        kept.append(ids)
                columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.list_(pa.int32()))] * with_ids, names=names)
        finally:
            pieces.forget()

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(id_col, text_col).mapInArrow(encode, schema)


def default_model() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(read_table(spark, sf_dir, "documents"), default_model())
