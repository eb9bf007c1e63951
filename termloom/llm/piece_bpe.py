"""SentencePiece BPE encoding with a prefix table, and decoding.

A BPE encoding is stable under cutting: the pieces of any stretch of the result
are the encoding of that stretch. Hence every prefix of a word has exactly one
last piece, and a piece may follow another exactly if merging the two strings
alone gives those two pieces. ``encode_word`` walks once over the matches of an
Aho-Corasick automaton of all pieces, stores the last piece of each prefix (the
match whose start has a last piece that is compatible with it), and reads the
ids from the end backwards. The work is linear in the text,
for words of any length.

Merges never join a character to a following word start, because no piece has a
word start inside; texts are therefore cut at word starts, and between letters
and other characters where no piece of the model mixes the two (checked when the
model is read). Words and pair tests are remembered in tables of bounded size.

Defined results: a null or empty text has no ids and decodes to the empty text.
Ids are those of the ``sentencepiece`` library without begin or end ids and
without sampling. Characters outside the vocabulary become byte pieces. An empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as model_pb2

from termloom.llm.common import ready_workers, text_of

START = "▁"
WORDS = re.compile(f"{START}*[^{START}]+|{START}+")
LETTER = r"[^\W\d_\u00b2\u00b3\u00b9\u00bc-\u00be\u2070-\u218b\u2460-\u24ff]"
OTHER = rf"(?:(?!{LETTER})[^{START}])"
RUNS = re.compile(f"{START}*{LETTER}+|{START}*{OTHER}+|{START}+")
MIXED = re.compile(f"{LETTER}{OTHER}|{OTHER}{LETTER}")
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
# Words of one generation; the one before is kept, so frequent words stay known.
WORD_CACHE = 150_000
PAIR_CACHE = 2_000_000
LONGEST_CACHED = 64
ENCODED = "doc_id long, ids array<int>, decoded string"


class PieceEncoder:
    """Encoder for one BPE model with byte fallback and plain normalisation."""

    def __init__(self, model_file: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        model = model_pb2.ModelProto()
        with open(model_file, "rb") as source:
            model.ParseFromString(source.read())
        rule = model.normalizer_spec
        inner = any(START in p.piece.lstrip(START) for p in model.pieces if p.type == NORMAL)
        if (
            model.trainer_spec.model_type != model_pb2.TrainerSpec.BPE or not model.trainer_spec.byte_fallback
            or rule.precompiled_charsmap or rule.remove_extra_whitespaces or not rule.escape_whitespaces
            or not rule.add_dummy_prefix or inner or any(p.type not in (NORMAL, UNKNOWN, CONTROL, BYTE) for p in model.pieces)
        ):
            raise ValueError("only BPE models with byte fallback and plain normalisation are supported")
        self.pieces = [p.piece for p in model.pieces]
        self.score = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.number = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.byte_ids = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.real = len(self.pieces)
        # Characters that merges may use although they are no piece of their own.
        for char in sorted({c for p in self.score for c in p} - set(self.score)):
            self.number[char] = len(self.pieces)
            self.pieces.append(char)
        self.lengths = [len(p) for p in self.pieces]
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.number.items():
            if self.merge(piece) == [piece]:
                self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        # Cutting between letters and the rest is safe as well if no piece mixes them.
        mixes = any(MIXED.search(p) for p in self.score)
        self.cut = (WORDS if mixes else RUNS).findall

    def merge(self, text: str) -> list[str]:
        """Plain merging of a short string: best score first, then leftmost."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best = max(((score[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in score), default=None)
            if best is None:
                break
            i = -best[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        key = left << 20 | right
        known = self.pairs.get(key)
        if known is None:
            a, b = self.pieces[left], self.pieces[right]
            known = self.merge(a + b) == [a, b]
            if len(self.pairs) >= PAIR_CACHE:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def encode_word(self, word: str) -> tuple[int, ...]:
        last = [-1] * (len(word) + 1)
        known = self.pairs.get
        for end, (piece, length) in self.automaton.iter(word):
            end += 1
            if last[end] < 0:
                before = last[end - length]
                # A start without a last piece follows an unknown character or nothing.
                if before < 0 or (
                    self.compatible(before, piece) if (fit := known(before << 20 | piece)) is None else fit
                ):
                    last[end] = piece
        ids: list[int] = []
        place, lengths, real = len(word), self.lengths, self.real
        while place:
            piece = last[place]
            if 0 <= piece < real:
                ids.append(piece)
                place -= lengths[piece]
            else:
                place -= 1
                ids += [self.byte_ids[b] for b in reversed(word[place].encode())]
        ids.reverse()
        return tuple(ids)

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        words = self.cut(START + text.replace(" ", START))
        known = self.words
        out = [known.get(w) for w in words]
        if None in out:
            for i, ids in enumerate(out):
                if ids is None:
                    word = words[i]
                    ids = out[i] = known.get(word) or self.older.get(word) or self.encode_word(word)
                    if len(word) <= LONGEST_CACHED:
                        known[word] = ids
            if len(known) >= WORD_CACHE:
                self.words, self.older = {}, known
        return list(chain.from_iterable(out))

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids) if ids else ""


@lru_cache(maxsize=2)
def encoder(model_file: str) -> PieceEncoder:
    """One encoder per Python worker and model."""
    return PieceEncoder(model_file)


def encode_documents(docs: DataFrame, model_file: str) -> DataFrame:
    """``doc_id``, the ``ids`` of the whole text, and the text ``decoded`` from them."""
    ready_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(model_file)
        for batch in batches:
            ids = [codec.encode(text) for text in batch.column("text").to_pylist()]
            decoded = [codec.decode(x) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())],
                ["doc_id", "ids", "decoded"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(run, ENCODED)
