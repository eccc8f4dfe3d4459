"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts are dealt into encoder calls by bytes, and a long text is split at places where the tokenizer's own
pre-tokenizer always splits, so the sum of the pieces' counts is the count of the whole text. Where the file's pre-tokenizer
splits before every blank behind a word, texts are split there, and a batch encodes each of its different words once.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A single blank between an ASCII letter or digit before it and one behind it. Byte-level and word-end BPE start a
#: pre-token there, and so does a piece model that doesn't merge across white space.
SAFE = r"(?<=[0-9A-Za-z])(?= [0-9A-Za-z])"
#: Before a blank that follows anything but white space: the byte-level pattern takes a blank only as the first character of a pre-token or
#: among white space. What Python calls white space includes all that the pattern does.
WORDS = r"(?<=\S)(?= )"
#: Characters of a word whose count is kept for later batches, and words that a task keeps.
WORD_CHARS, KEPT_WORDS = 32, 1 << 18
#: Where a run of letters or of digits ends: pre-tokenizers by the usual byte-level pattern always begin a pre-token there, in any script.
SAFE_BYTE_LEVEL = r"(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})"


def pieces(text: str, most: int, safe: regex.Pattern, drop_blank: bool = False, whole: tuple[str, ...] = ()) -> Iterator[str]:
    """text cut at safe places into pieces of about `most` bytes; a stretch without a safe place stays whole, and so does a string of `whole`.

    A cut is sought by characters, as many as `most` bytes hold at the text's average.
    """
    start, n, step = 0, len(text), max(1, most * len(text) // max(len(text.encode()), 1))
    while n - start > step:
        found = None
        for cut in safe.finditer(text, start + step):
            at = cut.start()
            if not any(text.find(w, max(at - len(w) + 1, 0), at + len(w) - 1) >= 0 for w in whole):
                found = at
                break
        if found is None:
            break
        yield text[start:found]
        start = found + drop_blank
    yield text[start:]


class Encoder:
    """The library that a tokenizer's file is for: token counts of texts, and where texts may be cut."""

    def __init__(self, path: str) -> None:
        self.whole: tuple[str, ...] = ()
        self.words: re.Pattern | None = None
        self.safe, self.drop_blank = regex.compile(SAFE), path.endswith(".model")
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.lengths = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            return
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self.lengths = lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        about = json.loads(tokenizer.to_str())
        before = about.get("pre_tokenizer") or {}
        if before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not about.get("normalizer"):
            self.safe = regex.compile(SAFE_BYTE_LEVEL)
            added = about.get("added_tokens") or ()
            self.whole = tuple(t["content"] for t in added)  # these are sought before any pre-token
            if not any(" " in t["content"] or t.get("lstrip") or t.get("rstrip") for t in added) and not about["model"].get("dropout"):
                self.words = re.compile(WORDS)


def word_counts(texts: list[str], encoder: Encoder, known: dict[str, int]) -> list[int]:
    """Tokens of each text, the sum of its words' counts. The words that known lacks are encoded, each once; known keeps the short ones."""
    split = [encoder.words.split(text) for text in texts]
    new = [*set().union(*split).difference(known)]
    known.update(zip(new, encoder.lengths(new) if new else (), strict=True))
    counts = [sum(map(known.__getitem__, words)) for words in split]
    for word in new:
        if len(word) > WORD_CHARS:
            del known[word]
    if len(known) > KEPT_WORDS:
        known.clear()
    return counts


def token_counts(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
    limit: int = 1024, piece_bytes: int = 16_384, batch_bytes: int = 1 << 20,
) -> DataFrame:
    """One row per row of docs: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    tokenizer is a local path that every executor has. A null text counts as empty: 0 bytes, 0 tokens. Repeated rows
    give repeated rows, an empty table gives none, other columns are not read. Special strings inside a text are
    handled as the library does by default; nothing is added, cut or padded. A stretch without a safe place is encoded
    whole however long it is.
    """
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        known: dict[str, int] = {}
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            total, load, owners, size = np.zeros(len(texts), np.int64), [], [], 0
            n_bytes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            sizes = n_bytes.to_numpy()

            def flush() -> None:
                if load:
                    np.add.at(total, owners, word_counts(load, encoder, known) if encoder.words else encoder.lengths(load))
                    load.clear()
                    owners.clear()

            for i, text in enumerate(texts):
                text = text.as_py()
                if not text:
                    continue
                n = int(sizes[i])
                for piece in pieces(text, piece_bytes, encoder.safe, encoder.drop_blank, encoder.whole) if n > piece_bytes else (text,):
                    load.append(piece)
                    owners.append(i)
                    size += n if piece is text else len(piece.encode())
                    if size >= batch_bytes:
                        flush()
                        size = 0
            flush()
            yield pa.RecordBatch.from_arrays([ids, n_bytes, pa.array(total)], [id_col, "n_bytes", "n_tokens"])

    counted = docs.select(F.col(id_col), F.col(text_col).cast("string").alias(text_col)).mapInArrow(count, schema)
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
