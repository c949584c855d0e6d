"""Token counts by the whole-token shortcut.

The piece vocabulary never holds a space mark after another character, so a merge never crosses
from a word into the space before the next one: the tokens of a text are those of its pre-tokens
(a run of spaces with the characters after it), each on its own. ``prove`` checks that premise
and lists the words that encode alone as one token; those are counted directly, and
only the remaining pre-tokens are merged by the library.

Null text counts as empty (no bytes, no tokens); texts are never cut; equal rows give equal rows. Where a text
can be cut into pieces in several ways, the merged one is the library's own choice. An empty table gives an empty result. Other
columns aren't read, whatever their names.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirewise.llm.common import text_chunks

MARK = "▁"
#: Pre-tokens that the memory of a worker holds besides the proven ones, and their longest length.
MEMO, MEMO_LENGTH = 400_000, 48
#: What a model that does more than mark spaces would change: compatibility characters, marks, case, and spaces of all kinds.
PROBES = ("a", "A b", " a", "a ", "a  b", "\ta\nb\r\n", "x\u00a0y\u3000z\u200b", "e\u0301", "\ufb01", "\u2460", "\uff21", "\u0130", "\U0001d518")
_RUNS = re.compile(" +[^ ]*")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@functools.lru_cache(maxsize=4)
def _library(model: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


def prove(model: str) -> frozenset[str]:
    """The words (without their space mark) that the library gives as exactly one token.

    Raises if the vocabulary could merge across a word's end, as counting by pre-token would then be wrong.
    """
    library, words = _library(model), set()
    for text in PROBES:
        if library.normalize(text) != (MARK + text).replace(" ", MARK):
            raise ValueError(f"the model normalises texts otherwise than by space marks: {text!r} to {library.normalize(text)!r}")
    for i in range(library.vocab_size()):
        piece = library.id_to_piece(i)
        if library.is_control(i) or library.is_unknown(i) or library.is_byte(i):
            continue
        if MARK in piece.lstrip(MARK):
            raise ValueError(f"piece {i} holds a space mark after another character: {piece!r}")
        word = piece[1:]
        if piece[0] == MARK and word and MARK not in word and library.encode(word) == [i]:
            words.add(word)
    return frozenset(words)


class _Counts(dict):
    """Tokens of a pre-token; the first spaces' mark is implied, as the library adds it."""

    def __init__(self, model: str, proven: frozenset[str]):
        super().__init__(dict.fromkeys(proven, 1))
        self.library, self.proven = _library(model), proven
        self.lone_mark = len(self.library.encode("a ")) - len(self.library.encode("a"))  # a space with nothing after it

    def __missing__(self, word: str) -> int:
        n = len(self.library.encode(word))
        if len(word) <= MEMO_LENGTH:
            if len(self) > MEMO + len(self.proven):
                self.clear()
                self.update(dict.fromkeys(self.proven, 1))
            self[word] = n
        return n

    def of(self, text: str) -> int:
        text = text.replace(MARK, " ")
        if "  " in text or text[:1] == " " or text[-1:] == " ":
            return sum(self[run[1:]] if len(run) > 1 else self.lone_mark for run in _RUNS.findall(f" {text}"))
        return sum(map(self.__getitem__, text.split(" ")))


def count_tokens(docs: DataFrame, model: str | None = None, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row; one pass, no shuffle."""
    model = model or default_model()
    proven = docs.sparkSession.sparkContext.broadcast(prove(model))  # at most the vocabulary
    id_type = docs.schema[id_col].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts(model, proven.value)
        for batch in text_chunks(batches):
            n = pa.array((counts.of(t) if t else 0 for t in batch.column(1).to_pylist()), pa.int64())
            size = pc.cast(pc.fill_null(pc.binary_length(batch.column(1)), 0), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, n, pc.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(count, f"doc_id {id_type}, n_bytes long, n_tokens long, over_limit boolean")
