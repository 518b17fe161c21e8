"""Public tokenizer vocabularies, read on the driver and sent to the tasks: a vocabulary has a fixed size."""

from __future__ import annotations

import base64
import re
from pathlib import Path

from pyspark.sql import SparkSession

#: Where the vocabulary files are unless a caller says otherwise.
FOLDER = "/opt/tokenizers"

#: The split pattern of the 50k byte-level vocabulary, a published constant of that vocabulary.
BYTE_BPE_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: Characters of a text that a piece vocabulary encodes at once, so that a very long text takes bounded memory.
AT_ONCE = 1 << 18
#: A space between two words, at which a text can be cut: each part starts with a piece's leading space again.
BETWEEN = re.compile("(?<=[^ \u2581]) (?=[^ \u2581])")


def broadcast_file(spark: SparkSession, path: str):
    return spark.sparkContext.broadcast(Path(path).read_bytes())


def encoder(file: bytes, path: str):
    """A function from a text to its token ids, and for each id whether it is less than whole characters.

    Byte-level vocabularies have tokens that aren't UTF-8 by themselves; a piece vocabulary falls back to single bytes.
    """
    import numpy as np

    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_proto=file)
        return lambda text: encoded_in_parts(pieces.encode, text), np.array([pieces.is_byte(i) for i in range(pieces.vocab_size())])
    encoding = byte_bpe(file)
    part = np.zeros(encoding.n_vocab, bool)
    for token, rank in encoding._mergeable_ranks.items():
        part[rank] = not whole(token)
    return encoding.encode_ordinary, part


def encoded_in_parts(encode, text: str) -> list[int]:
    ids, start = [], 0
    while start + AT_ONCE < len(text) and (space := BETWEEN.search(text, start + AT_ONCE)):
        ids += encode(text[start : space.start()])
        start = space.end()
    return ids + encode(text[start:])


def whole(token: bytes) -> bool:
    try:
        token.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


def byte_bpe(ranks: bytes):
    import tiktoken

    mergeable = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
    return tiktoken.Encoding("byte_bpe", pat_str=BYTE_BPE_PATTERN, mergeable_ranks=mergeable, special_tokens={})


def runs(start, length):
    """The positions start[i] to start[i] + length[i] - 1 of all i, one after the other."""
    import numpy as np

    if not len(start):
        return np.zeros(0, np.int64)
    return np.repeat(start - np.cumsum(length) + length, length) + np.arange(int(length.sum()))
