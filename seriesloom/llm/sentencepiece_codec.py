"""Exact encoding for merge-type SentencePiece vocabularies by backtracking, and decoding.

Greedy longest matches come from one Aho-Corasick pass over a word. A token may follow another only if merging their
joint characters from scratch, best score first, ends in just these two tokens. Where no
prefix of the longest match fits, the position is marked in a bitfield as failed and the token before it is
shortened, so every position fails at most once.

No piece of such a vocabulary holds a space mark behind another character, so a text falls apart at its
spaces and each distinct word is encoded once and remembered by its worker, in two generations of bounded size: words seen
again move to the younger one, the older one goes when that is full.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.session import prepare, row_key

SPACE = "▁"
#: Words of a generation and pairs of pieces that a worker remembers, over all its tasks: about 300 bytes a word and 200 a
#: pair, 100 MB in all. Longer words (in characters) are not remembered.
WORDS, PAIRS, LONGEST = 100_000, 200_000, 200


def read_pieces(path: str) -> dict:
    """Pieces, scores and kinds of a model file."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.vocab_size()
    kinds = ["byte" if model.is_byte(i) else "none" if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else "text" for i in range(n)]
    return {"pieces": [model.id_to_piece(i) for i in range(n)], "scores": [model.get_score(i) for i in range(n)], "kinds": kinds}


def _parts(pieces: list[str]) -> str:
    """A pattern of the parts of a text that are encoded on their own.

    No token crosses two neighbouring characters that no piece holds side by side. So a text falls apart before space marks, around
    line ends and tabs that are in no longer piece, and between a letter and a sign that follows no letter in any piece.
    """
    inner = {c for p in pieces if len(p) > 1 for c in p}
    lone = "".join(re.escape(c) for c in "\n\t\r" if c not in inner)
    letters = {c for p in pieces for c in p if c.isalpha() and c < "\u0250"}
    behind = {b for p in pieces for a, b in zip(p, p[1:]) if a in letters}
    signs = "".join(re.escape(c) for c in string.punctuation if c not in behind)
    word = f"{SPACE}*+[{''.join(sorted(letters))}]++(?=[{signs}])|" if letters and signs else ""
    return (f"[{lone}]|" if lone else "") + f"{word}{SPACE}*[^{SPACE}{lone}]+|{SPACE}+"


class Codec:
    def __init__(self, vocabulary: dict) -> None:
        pieces, scores, kinds = vocabulary["pieces"], vocabulary["scores"], vocabulary["kinds"]
        self.pieces, self.kinds = pieces, kinds
        self.ids = {p: i for i, (p, k) in enumerate(zip(pieces, kinds)) if k == "text"}
        self.rank = {p: -scores[i] for p, i in self.ids.items()}
        self.byte = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(pieces, kinds)) if k == "byte"}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("This vocabulary has pieces with a space mark behind another character.")
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            self.automaton.add_word(p[::-1], len(p))
        self.automaton.make_automaton()
        self.fits: dict[tuple[str, str], bool] = {}
        self.parts = re.compile(_parts(list(self.ids)))
        self.known = _Known(self)

    def merged(self, text: str) -> list[str]:
        """The symbols left when the best-scored neighbours are merged first, the leftmost among equals."""
        symbols = list(text)
        rank, none = self.rank, float("inf")
        gain = [rank.get(a + b, none) for a, b in zip(symbols, symbols[1:])]
        while gain:
            best = min(gain)
            if best == none:
                break
            k = gain.index(best)
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
            del gain[k]
            if k > 0:
                gain[k - 1] = rank.get(symbols[k - 1] + symbols[k], none)
            if k < len(gain):
                gain[k] = rank.get(symbols[k] + symbols[k + 1], none)
        return symbols

    def follows(self, left: str, right: str) -> bool:
        """Whether ``right`` may stand behind ``left``: merging both from scratch gives them back."""
        pair = (left, right)
        found = self.fits.get(pair)
        if found is None:
            if len(self.fits) >= PAIRS:
                self.fits.clear()
            found = self.fits[pair] = self.merged(left + right) == [left, right]
        return found

    def tokens(self, word: str) -> list[str]:
        """The tokens of a word: pieces, or single characters that no piece covers."""
        n = len(word)
        longest = [1] * n
        for end, length in self.automaton.iter(word[::-1]):
            start = n - 1 - end
            if length > longest[start]:
                longest[start] = length
        failed = 0  # bitfield of positions from which no encoding goes on
        out: list[str] = []
        ids, follows = self.ids, self.follows
        at, length = 0, longest[0] if n else 0
        while at < n:
            end = at + length
            token = word[at:end]
            if not failed >> end & 1 and (token in ids or length == 1) and (not out or follows(out[-1], token)):
                out.append(token)
                at = end
                length = longest[at] if at < n else 0
            elif length > 1:
                length -= 1
            elif out:
                failed |= 1 << at
                length = len(out.pop())
                at -= length
            else:
                raise ValueError(f"no encoding of {word!r}")
        return out

    def encode(self, word: str) -> tuple[list[int], str]:
        """The ids of a word and what they decode to."""
        tokens = self.tokens(word)
        ids = [self.ids.get(t, -1) for t in tokens]
        if -1 not in ids:
            return ids, "".join(tokens).replace(SPACE, " ")  # as decode() has it for pieces of text
        ids = [i for t, known in zip(tokens, ids) for i in ([known] if known >= 0 else [self.byte[b] for b in t.encode()])]
        return ids, self.decode(ids)

    def decode(self, ids: list[int]) -> str:
        """Text of a sequence of ids, with the space that encoding puts in front still there."""
        out: list[str] = []
        pending = bytearray()
        for i in ids:
            if self.kinds[i] == "byte":
                pending.append(int(self.pieces[i][3:5], 16))
                continue
            if pending:
                out.append(pending.decode("utf-8", "replace"))
                pending.clear()
            if self.kinds[i] == "text":
                out.append(self.pieces[i].replace(SPACE, " "))
        return "".join(out) + pending.decode("utf-8", "replace")

    def words(self, text: str) -> list[str]:
        """Parts of a text that are encoded on their own; none for an empty text."""
        if not text:
            return []
        return self.parts.findall(SPACE + text.replace(" ", SPACE))

    def text(self, text: str) -> tuple[int, str, str]:
        """Number of tokens, the ids joined by commas, and the decoded text."""
        found = list(map(self.known.__getitem__, self.words(text)))
        decoded = "".join([f[2] for f in found])
        return sum([f[0] for f in found]), ",".join([f[1] for f in found]), decoded[1:]


class _Known(dict):
    """Words already encoded by this worker: number of tokens, ids, decoded text. The younger of two generations."""

    def __init__(self, codec: Codec) -> None:
        super().__init__()
        self.codec, self.older = codec, {}

    def __missing__(self, word: str) -> tuple[int, str, str]:
        found = self.older.get(word)
        if found is None:
            ids, decoded = self.codec.encode(word)
            found = len(ids), ",".join(map(str, ids)), decoded
        if len(word) <= LONGEST:
            if len(self) >= WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = found
        return found


_codecs: dict[int, Codec] = {}


def _codec(shared) -> Codec:
    if id(shared) not in _codecs:
        _codecs.clear()
        _codecs[id(shared)] = Codec(shared.value)
    return _codecs[id(shared)]


def encoded(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text and decode it again: id, ``n_tokens``, ``ids`` and ``decoded``.

    ids: decimal ids joined by commas. model: path of the model file, read on the driver and broadcast (as large as
    the vocabulary). A null or empty text has no ids and decodes to an empty text; one row per row of
    ``docs``, repeated ones too; null ids stay null; an empty table gives an empty table; further columns are not
    read. Texts of any length are encoded whole.
    """
    return _mapped(docs, model, id_col, text_col, digests=False)


def encoded_digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Like ``encoded``, but with SHA-256 digests of ids and decoded text, so that neither leaves the task."""
    return _mapped(docs, model, id_col, text_col, digests=True)


def _mapped(docs: DataFrame, model: str, id_col: str, text_col: str, digests: bool) -> DataFrame:
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(read_pieces(model))
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"]

    def sha(text: str) -> str:
        return hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):  # bounds what is held before it leaves
                part = batch.slice(i, 256)
                n, ids, decoded = [], [], []
                for text in part.column(3).to_pylist():
                    count, a, b = codec.text(text)
                    n.append(count)
                    ids.append(sha(a) if digests else a)
                    decoded.append(sha(b) if digests else b)
                columns = [pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *columns], ["id", "key_a", "key_b", "n_tokens", *names])

    keyed = docs.select(F.col(id_col).alias("id"), *row_key(id_col, text_col), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    schema = f"id {kind}, key_a long, key_b long, n_tokens long, {names[0]} string, {names[1]} string"
    return keyed.mapInArrow(run, schema).withColumnRenamed("id", id_col)
