"""BPE encoding and decoding: a segment tree over the ranks of adjacent pairs picks each merge."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from halyard.llm.common import keep as kept
from halyard.llm.common import release, small_batches, tidy

_NONE = np.int64(1 << 62)
#: Bits of a place in a word: words of up to 2^40 bytes beside ranks of up to 2^22.
_POS = 40
#: Words whose ids a Python worker keeps; all others are encoded again when they come back.
CACHE_WORDS, KEPT_WORDS = 100_000, 30_000
#: Cells of the trees that are filled at once, but a longer word has its own: some 100 bytes each.
CELLS = 1 << 18
#: White space that Python's str.split knows and the tokenizer's \s does not.
_ODD_SPACE = re.compile("[\x1c-\x1f]")
_SPLIT = re.compile(r"[^\S\x1c-\x1f]+")


def byte_alphabet() -> list[str]:
    """The printable character for each byte of the byte-level vocabulary."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(kept)]
    return [chr(b) if b in set(kept) else chr(256 + rest.index(b)) for b in range(256)]


class SegmentTreeBPE:
    """Merges of a byte-level BPE vocabulary, run for many words at once.

    Each word is a row with a segment tree whose leaf i holds (rank, i) of the pair that starts at symbol i. The root is
    the leftmost pair of the lowest rank. A merge changes three leaves and so three paths to the root; a word is done
    when its root is empty. The rows are numpy arrays, so that one step serves all words that still have a merge.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, suffix = spec["model"]["vocab"], spec["model"].get("end_of_word_suffix") or ""
        self.suffix = suffix
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.token = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        letters = byte_alphabet()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + suffix] for c in letters], np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.width = np.int64(max(self.token) + 1)
        key = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank = key[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)

    def _leaf(self, a: np.ndarray, b: np.ndarray, pos: np.ndarray) -> np.ndarray:
        k = a * self.width + b
        i = np.minimum(np.searchsorted(self.key, k), len(self.key) - 1)
        return np.where(self.key[i] == k, (self.rank[i] << _POS) | pos, _NONE)

    def encode(self, words: list[bytes]) -> list[tuple[bytes, list[int]]]:
        """Ids of each word, as little-endian unsigned 32-bit integers and as a list."""
        out: list[tuple[bytes, list[int]]] = [(b"", [])] * len(words)
        size = np.array([len(w) for w in words], np.int64)
        order = np.argsort(size, kind="stable")
        order = order[np.searchsorted(size[order], 1) :]
        while len(order):
            wide = 1 << max(1, int(size[order[0]] - 1).bit_length())
            n = int(np.searchsorted(size[order], wide, "right"))
            n = max(1, min(n, CELLS // wide))
            rows, order = order[:n], order[n:]
            ids, counts = self._block([words[i] for i in rows], size[rows], wide)
            raw, flat, a = ids.tobytes(), ids.tolist(), 0
            for i, b in zip(rows.tolist(), np.cumsum(counts).tolist(), strict=True):
                out[i] = (raw[4 * a : 4 * b], flat[a:b])
                a = b
        return out

    def _block(self, words: list[bytes], size: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray]:
        n, flat = len(words), np.frombuffer(b"".join(words), np.uint8)
        alive = np.arange(wide)[None, :] < size[:, None]
        sym = np.zeros((n, wide + 1), np.int64)
        sym[:, :wide][alive] = self.inner[flat]
        ends = np.cumsum(size) - 1
        sym[np.arange(n), size - 1] = self.last[flat[ends]]
        tree = np.full((n, 2 * wide), _NONE, np.int64)
        pos = np.broadcast_to(np.arange(wide - 1), (n, wide - 1))
        tree[:, wide : 2 * wide - 1] = np.where(alive[:, 1:], self._leaf(sym[:, : wide - 1], sym[:, 1:wide], pos), _NONE)
        level = wide
        while level > 1:
            level //= 2
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        after = np.broadcast_to(np.arange(1, wide + 1), (n, wide)).copy()
        before = np.broadcast_to(np.arange(-1, wide), (n, wide + 1)).copy()
        rows = np.flatnonzero(tree[:, 1] < _NONE)
        while len(rows):
            root = tree[rows, 1]
            at = root & ((1 << _POS) - 1)
            gone = after[rows, at]
            new = self.merged[root >> _POS]
            sym[rows, at] = new
            alive[rows, gone] = False
            right, left = after[rows, gone], before[rows, at]
            after[rows, at] = right
            before[rows, right] = at
            tree[rows, wide + gone] = _NONE
            more = right < size[rows]
            tree[rows, wide + at] = np.where(more, self._leaf(new, sym[rows, right], at), _NONE)
            some = left >= 0
            tree[rows[some], wide + left[some]] = self._leaf(sym[rows[some], left[some]], new[some], left[some])
            nodes = np.stack([wide + gone, wide + at, wide + np.where(some, left, at)])
            level = wide
            while level > 1:
                level //= 2
                nodes = nodes >> 1
                tree[rows[None, :], nodes] = np.minimum(tree[rows[None, :], 2 * nodes], tree[rows[None, :], 2 * nodes + 1])
            rows = rows[tree[rows, 1] < _NONE]
        return sym[:, :wide][alive].astype("<u4"), alive.sum(1)


#: Characters that stand for any letter, digit, other character or white space, none of them part of a contraction.
_STANDS = {"L": "é", "N": "7", "O": "§", "S": " "}


#: Planes in which Unicode has assigned characters.
_PLANES = (*range(0x80, 0x40000), *range(0xE0000, 0xF0000))


def _normal(chunk: str) -> str:
    if chunk.isascii():
        return chunk.lower()
    return unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()


@lru_cache(maxsize=4)
def odd_points(path: str) -> tuple[tuple[tuple[int, str], ...], tuple[tuple[int, str], ...]]:
    """Where the library's tables of Unicode differ from those here: (code points that it takes for another kind, and that kind; those that it writes otherwise in lower case).

    The library tells: between two letters a letter makes one piece, between two marks another mark does, white space none.
    """
    from tokenizers import Tokenizer  # only the driver asks the library, and only here

    tok = Tokenizer.from_file(path)
    cut, normal = tok.pre_tokenizer.pre_tokenize_str, tok.normalizer.normalize_str
    kind = regex.compile(r"(\p{L})|(\p{N})|(\s)")
    kinds: list[tuple[int, str]] = []
    cases: list[tuple[int, str]] = []
    points = [i for i in _PLANES if not 0xD800 <= i < 0xE000]
    for at in range(0, len(points), 1 << 15):
        some = points[at : at + (1 << 15)]
        # three characters and a space for each
        letters = {a // 4 for _, (a, b) in cut(" ".join([f"a{chr(i)}a" for i in some])) if b - a == 3}
        rest = [k for k in range(len(some)) if k not in letters]
        beside = cut(" ".join([f"!{chr(some[k])}!" for k in rest]))
        marks = {rest[a // 4] for _, (a, b) in beside if b - a == 3}
        alone = {rest[a // 4] for _, (a, b) in beside if a % 4 == 1 and b - a == 1}
        lower = normal("!".join(map(chr, some))).split("!")
        for k, i in enumerate(some):
            is_now = "L" if k in letters else "O" if k in marks else "N" if k in alone else "S"
            m = kind.match(chr(i))
            if is_now != ("O" if m is None else "LNS"[m.lastindex - 1]):
                kinds.append((i, is_now))
            if is_now != "S" and lower[k] != _normal(chr(i)):
                cases.append((i, lower[k]))
    del tok, cut, normal
    release()
    return tuple(kinds), tuple(cases)


class WordBPE:
    """A tokenizer whose words end in a suffix: NFC, white space dropped, lower case, then BPE within each word."""

    PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

    def __init__(self, path: str, odd: tuple[tuple[tuple[int, str], ...], tuple[tuple[int, str], ...]] = ((), ())):
        self.bpe = SegmentTreeBPE(path)
        self.odd, self.cases = {i: _STANDS[k] for i, k in odd[0]}, dict(odd[1])
        if not self.bpe.suffix:
            raise ValueError(f"{path}: its tokens have no word ends, which this encoder needs")
        self.cut = re.compile("(" + "|".join(map(re.escape, self.bpe.special)) + ")") if self.bpe.special else None
        self.known: dict[str, tuple[bytes, str]] = {}
        self.before: dict[str, tuple[bytes, str]] = {}

    def forget(self) -> None:
        """Between tasks a worker keeps few words."""
        self.before = {}
        if len(self.known) > KEPT_WORDS:
            self.known = {}

    def _normal(self, chunk: str) -> str:
        return _normal(chunk if chunk.isascii() else chunk.translate(self.cases))

    def parts(self, chunk: str) -> list[str]:
        """The pieces of a normal chunk that are merged apart."""
        if not chunk.isascii() and self.odd:
            same = chunk.translate(self.odd)
            if same != chunk:
                return [chunk[m.start() : m.end()] for m in self.PARTS.finditer(same)]
        return self.PARTS.findall(chunk)

    def chunks(self, text: str) -> list[str]:
        """The text cut at white space, which no token crosses; special tokens stand alone."""
        if self.cut is not None and "<|" in text:
            return [c for part in self.cut.split(text) for c in ([part] if part in self.bpe.special else self._plain(part))]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if _ODD_SPACE.search(text):
            return [x for x in _SPLIT.split(text) if x]
        return text.split()

    def learn(self, chunks: set[str]) -> None:
        """Encodes the chunks that are not known yet, all at once. Chunks not met for long are forgotten."""
        if len(self.known) > CACHE_WORDS:
            self.known, self.before = {}, self.known
        new = chunks.difference(self.known)
        old = {c: self.before[c] for c in new if c in self.before}
        self.known.update(old)
        new = list(new.difference(old))
        parts = [self.parts(self._normal(c)) if c not in self.bpe.special else () for c in new]
        words = list({p for ps in parts for p in ps})
        token = self.bpe.token
        ids = {w: (raw, " ".join([token[i] for i in x])) for w, (raw, x) in zip(words, self.bpe.encode([w.encode() for w in words]), strict=True)}
        for c, ps in zip(new, parts, strict=True):
            if len(ps) == 1:
                self.known[c] = ids[ps[0]]
            elif c in self.bpe.special:
                self.known[c] = (self.bpe.special[c].to_bytes(4, "little"), c)
            else:
                got = [ids[p] for p in ps]
                self.known[c] = (b"".join([x[0] for x in got]), " ".join([x[1] for x in got]))

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        """For each text its ids, as little-endian unsigned 32-bit integers, and their decoding."""
        for i in range(0, len(texts), 256):
            cut = [self.chunks(t) for t in texts[i : i + 256]]
            self.learn(set().union(*map(set, cut)))
            for cs in cut:
                got = [self.known[c] for c in cs]
                yield b"".join([x[0] for x in got]), " ".join([x[1] for x in got if x[0]])

    def decode(self, ids: list[int]) -> str:
        """The vocabulary has no decoder, so its library joins the tokens with spaces."""
        return " ".join([self.bpe.token[i] for i in ids])


@lru_cache(maxsize=2)
def tokenizer(path: str, odd: tuple[tuple[tuple[int, str], ...], tuple[tuple[int, str], ...]] = ((), ())) -> WordBPE:
    return WordBPE(path, odd)


def encode(df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), tokens: bool = True) -> DataFrame:
    """BPE ids and their decoding for every text; one row per input row.

    df: any columns; `keep` pass through unchanged, others are ignored. Null texts count as empty: no ids, empty decoding.
    Texts of any length are whole; repeated rows give repeated results. An empty table gives an empty result.
    Returns keep..., ids array<int> and decoded string if `tokens`, n_tokens, ids_sha256, decoded_sha256.
    """
    schema = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep]
    schema += ["ids array<int>", "decoded string"] * tokens + ["n_tokens bigint", "ids_sha256 string", "decoded_sha256 string"]

    odd = odd_points(path)
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path, odd)
        kept("bpe", tokenizer.cache_clear)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                got = list(tok.encode([t or "" for t in b.column(text).to_pylist()]))
                cols = [b.column(c) for c in keep]
                if tokens:
                    cols += [pa.array([np.frombuffer(x, "<i4") for x, _ in got], pa.list_(pa.int32())), pa.array([d for _, d in got], pa.string())]
                cols += [pa.array([len(x) // 4 for x, _ in got], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x, _ in got], pa.string()), pa.array([hashlib.sha256(d.encode()).hexdigest() for _, d in got], pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, *["ids", "decoded"] * tokens, "n_tokens", "ids_sha256", "decoded_sha256"])
        tok.forget()

    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(tidy(run, "bpe"), ", ".join(schema))
