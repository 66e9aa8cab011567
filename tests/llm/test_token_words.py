"""Words that the byte-level encoder puts together from letters, marks and line ends."""

import os

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from halyard.llm import token_files
from halyard.llm.token_files import ByteBPE

BYTES = public_tokenizers.path("byte_bpe_50k.json")


def test_words_around_a_line_end_are_put_together():
    fast, library = ByteBPE(BYTES), Tokenizer.from_file(BYTES)
    words = ["enteö.\nMit", "the\nend,", "a|.\nÜber!?", "x\n\ny", "one\n two", "a\n7", "don't\nDer", "end.\n", "ab\nŉʼn", "١\nb", "der\nd\ne"]
    texts = [f"To {a} and {b} x" for a in words for b in words] + words + [" ".join(words)]
    want = [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert list(fast.encode(texts)) == want
    assert {"ente", "the"} & fast.heads.keys()
    assert {"Mit", "end", "Über"} <= fast.bare.keys()  # not by a call of the library for the whole word


def test_a_task_encodes_with_one_thread():
    ByteBPE(BYTES)
    assert os.environ["TOKENIZERS_PARALLELISM"] == "false"


def test_texts_that_begin_alike_are_looked_up(monkeypatch):
    fast, library, calls = ByteBPE(BYTES), Tokenizer.from_file(BYTES), []
    whole = token_files.pack_whole
    monkeypatch.setattr(token_files, "pack_whole", lambda tok, text: calls.append(text) or whole(tok, text))
    monkeypatch.setattr(token_files, "CACHE_CHUNKS", 50)
    texts = [f"Über,\nalles in word{i % 90} and it's\nlast{i % 7}! one\n" for i in range(700)] + ["Über", "a  b", "<|endoftext|> x", "x <|endoftext|>"]
    want = [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert list(fast.encode(texts)) == want
    assert calls.count("Über,\nalles") == 0  # put together, once
    assert len(fast.known) < 50 + 64 * 20
