"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

Method: the leaves of a segment tree hold the merge rank of each adjacent pair of a word; the
root yields the leftmost pair of lowest rank. A merge changes at most three leaves, each a
logarithmic point update, and merging ends when no pair has a rank. A word of n symbols takes
O(n log n), so one very long word is no special case.

White space separates words for this family of tokenizers, so whole texts are split at it and
the pieces are encoded once each and remembered (a bounded table per worker).

Python's own tables of letters, numbers and lower case agree with the library's on all characters that Python knows as assigned.
Texts with others go by the library's normaliser, and by its classes, which are read off from it once per worker that meets such a text.

Defined results: a null text counts as empty and has no tokens; an empty table gives an empty result; repeated rows are encoded
alike and all returned; extra columns are ignored by the query and kept by ``encode_column``'s
caller; lone surrogates cannot occur in Spark strings.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dramatis.llm.common import ID, TEXT, give_back, slices, table

NO_RANK = 1 << 60
#: Remembered pieces per worker (about 200 bytes each), and the longest piece that is remembered.
REMEMBERED, LONGEST = 300_000, 48
#: str.split() takes these four for white space; the tokenizer does not.
SEPARATORS = "\x1c\x1d\x1e\x1f"
MARK_AFTER_LETTER = re.compile(r"([,.;:!?])(?<=[^\W\d_][,.;:!?])(?=\s)")


#: All code points that a string may hold.
EVERY = (*range(0xD800), *range(0xE000, 0x110000))


def ranges(points: Iterable[int]) -> str:
    """Ascending code points as the inside of a character class."""
    out: list[list[int]] = []
    for p in points:
        if out and out[-1][1] == p - 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


@cache
def suspects() -> re.Pattern:
    """Any character that Python's tables may not know: all beyond U+FFFF, so that the class is one bitmap and one range."""
    return re.compile(f"[{ranges(p for p in range(0x10000) if unicodedata.category(chr(p)) == 'Cn')}\U00010000-\U0010ffff]")


def has_unassigned(text: str) -> bool:
    """Whether Python's tables don't know some character of ``text``."""
    return not text.isascii() and suspects().search(text) is not None and any(unicodedata.category(c) == "Cn" for c in set(text))


def byte_letters() -> list[str]:
    """The printable stand-in of each byte: Latin-1 letters stand for themselves, the rest follow from U+0100."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


def merge_word(symbols: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Merge ``symbols`` to the end, in place. ``ranks`` maps a pair to (rank, merged symbol)."""
    n = len(symbols)
    if n < 2:
        return symbols
    get = ranks.get
    # A node holds rank << bits | position, so that the least value is the leftmost lowest rank.
    bits = n.bit_length()
    none = NO_RANK << bits
    size = 1 << (n - 2).bit_length() if n > 2 else 1
    tree = [none] * (2 * size)
    i = size
    for pair in zip(symbols, symbols[1:]):
        if found := get(pair):
            tree[i] = found[0] << bits | (i - size)
        i += 1
    for i in range(size - 1, 0, -1):
        left, right = tree[2 * i], tree[2 * i + 1]
        tree[i] = left if left < right else right
    following, before = [*range(1, n + 1)], [*range(-1, n - 1)]
    mask = (1 << bits) - 1
    while (root := tree[1]) < none:
        i = root & mask
        j = following[i]
        merged = symbols[i] = get((symbols[i], symbols[j]))[1]
        symbols[j] = -1
        after = following[i] = following[j]
        if after < n:
            before[after] = i
            found = get((merged, symbols[after]))
            updates = [(i, found[0] << bits | i if found else none), (j, none)]
        else:
            updates = [(i, none)]
        if (p := before[i]) >= 0:
            found = get((symbols[p], merged))
            updates.append((p, found[0] << bits | p if found else none))
        for leaf, value in updates:
            leaf += size
            if tree[leaf] == value:
                continue
            tree[leaf] = value
            while leaf > 1:  # up to the root, or to the first node that stays as it is
                other = tree[leaf ^ 1]
                leaf >>= 1
                least = value if value < other else other
                if tree[leaf] == least:
                    break
                tree[leaf] = value = least
    return [s for s in symbols if s >= 0]


class PairTable:
    """Merge rules in a hash table of arrays, for many words at a time."""

    def __init__(self, ranks: dict[tuple[int, int], tuple[int, int]]):
        self.size = 1 << (4 * len(ranks)).bit_length()
        self.keys = np.full(self.size, -1, np.int64)
        self.rank = np.zeros(self.size, np.int32)
        self.merged = np.zeros(max((r for r, _ in ranks.values()), default=0) + 1, np.int32)
        self.longest = 1
        for (a, b), (rank, symbol) in ranks.items():
            key = a << 20 | b
            at = int(self.slot(np.array([key]))[0])
            probes = 1
            while self.keys[at] >= 0:
                at = (at + 1) % self.size
                probes += 1
            self.keys[at], self.rank[at], self.merged[rank] = key, rank, symbol
            self.longest = max(self.longest, probes)

    def slot(self, key: np.ndarray) -> np.ndarray:
        return (np.asarray(key) * np.int64(0x2545F4914F6CDD1D) >> np.int64(40)) & np.int64(self.size - 1)

    def leaf(self, left: np.ndarray, right: np.ndarray, position: np.ndarray) -> np.ndarray:
        """rank << 6 | position of each pair, or BATCH_NONE where there is no rule or no right symbol."""
        key = left.astype(np.int64) << 20 | right
        at = self.slot(key)
        out = np.full(len(key), BATCH_NONE, np.int32)
        open_ = np.flatnonzero(right >= 0)
        for _ in range(self.longest):
            held = self.keys[at[open_]]
            hit = held == key[open_]
            found = open_[hit]
            out[found] = self.rank[at[found]] << 6 | (position[found] if position.ndim else position)
            open_ = open_[(held >= 0) & ~hit]
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & (self.size - 1)
        return out


#: Above any leaf of a batch; the most symbols of a word that goes into a batch; and words of a batch, which fit the cache.
BATCH_NONE, BATCH_SYMBOLS, BATCH_WORDS = 1 << 30, 33, 2048


def merge_words(flat: np.ndarray, pairs: PairTable) -> np.ndarray:
    """``merge_word`` for the columns of ``flat`` (symbols from the top, -1 below them): one segment tree a column, merged in step."""
    n, words = flat.shape
    size = 1 << max(0, (n - 2).bit_length())
    # Row size + 1 is always empty; it stands for "no neighbour".
    end = size + 1
    flat = np.concatenate([flat, np.full((end + 1 - n, words), -1, np.int32)])
    result, names = flat.copy(), np.arange(words)
    tree = np.full((2 * size, words), BATCH_NONE, np.int32)
    for i in range(n - 1):
        tree[size + i] = pairs.leaf(flat[i], flat[i + 1], np.asarray(i))
    for i in range(size - 1, 0, -1):
        np.minimum(tree[2 * i], tree[2 * i + 1], out=tree[i])
    following = np.repeat(np.minimum(np.arange(1, size + 3), end)[:, None], words, 1)
    before = np.repeat(np.where(np.arange(size + 2) > 0, np.arange(-1, size + 1), end)[:, None], words, 1)
    while True:
        live = np.flatnonzero(tree[1] < BATCH_NONE)
        if len(live) < len(names):
            result[:, names] = flat
            if not len(live):
                return result
            names = names[live]
            flat, tree, following, before = (x[:, live] for x in (flat, tree, following, before))
        column = np.arange(len(names))
        root = tree[1]
        i, merged = root & 63, pairs.merged[root >> 6]
        j = following[i, column]
        after, previous = following[j, column], before[i, column]
        flat[i, column], flat[j, column] = merged, -1
        following[i, column], before[after, column] = after, i
        before[end] = end
        flat[end] = -1
        leaves = [
            (j, np.full(len(names), BATCH_NONE, np.int32)),
            (i, pairs.leaf(merged, flat[after, column], i)),
            (previous, np.where(previous == end, BATCH_NONE, pairs.leaf(np.maximum(flat[previous, column], 0), merged, previous))),
        ]
        for position, value in leaves:
            inside = position < size
            rows, columns = position[inside] + size, column[inside]
            tree[rows, columns] = value[inside]
            while size > 1 and len(rows) and rows[0] > 1:  # all leaves are equally deep
                least = np.minimum(tree[rows, columns], tree[rows ^ 1, columns])
                rows >>= 1
                tree[rows, columns] = least


class WordBpe:
    """A tokenizer of lower-cased words with an end-of-word mark, from its public JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks.setdefault((self.vocab[a], self.vocab[b]), (rank, self.vocab[a + b]))
        self.pairs = PairTable(self.ranks)
        self.letters = byte_letters()
        self.ended = [self.vocab[x + self.suffix] for x in self.letters]
        self.inner = [self.vocab[x] for x in self.letters]
        self.ended_of, self.inner_of = np.array(self.ended), np.array(self.inner)
        self.tokens = {v: k for k, v in self.vocab.items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens |= {v: k for k, v in self.special.items()}
        self.path, self.split_by = path, spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.word = regex.compile(self.split_by, regex.V0)
        self.space = regex.compile(r"\s+")
        self.marks = re.compile("|".join(re.escape(x) for x in self.special)) if self.special else None

    @cached_property
    def exact_word(self) -> regex.Pattern:
        """``word`` by the library's own classes of letters and numbers."""
        from tokenizers import Regex, normalizers

        everything, pattern = "".join(map(chr, EVERY)), self.split_by
        for kind in (r"\p{L}", r"\p{N}"):
            pattern = pattern.replace(kind, ranges(map(ord, normalizers.Replace(Regex(f"[^{kind}]+"), "").normalize_str(everything))))
        return regex.compile(pattern, regex.V0)

    @cached_property
    def exact_normalizer(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path).normalizer

    def word_ids(self, word: str) -> list[int]:
        """Ids of one normalised word."""
        letters = word.encode("utf-8")
        symbols = [self.inner[b] for b in letters]
        symbols[-1] = self.ended[letters[-1]]
        return merge_word(symbols, self.ranks)

    def words_ids(self, words: list[str]) -> list[bytes]:
        """Ids of many normalised words, each as little-endian unsigned 32-bit numbers."""
        encoded = [w.encode("utf-8") for w in words]
        data = np.frombuffer(b"".join(encoded), np.uint8)
        size = np.fromiter(map(len, encoded), np.int64, len(words))
        start = np.cumsum(size) - size
        out: list[bytes] = [b""] * len(words)
        order = np.argsort(size, kind="stable")
        few = order[size[order] <= BATCH_SYMBOLS]
        for at in range(0, len(few), BATCH_WORDS):
            some = few[at : at + BATCH_WORDS]
            row, n = np.arange(int(size[some[-1]]))[:, None], size[some]
            letters = data[np.minimum(start[some] + row, len(data) - 1)]
            flat = np.where(row < n - 1, self.inner_of[letters], np.where(row == n - 1, self.ended_of[letters], -1)).astype(np.int32)
            if len(row) > 1:
                flat = merge_words(flat, self.pairs)
            held = flat.T >= 0
            ids, stops = flat.T[held].astype("<u4").tobytes(), (4 * np.cumsum(held.sum(1))).tolist()
            for k, a, b in zip(some.tolist(), [0, *stops[:-1]], stops, strict=True):
                out[k] = ids[a:b]
        for k in order[len(few) :].tolist():
            out[k] = array("I", self.word_ids(words[k])).tobytes()
        return out

    def lowered(self, text: str) -> str:
        """Normalised but for white space."""
        if not text.isascii():
            if has_unassigned(text):
                return self.exact_normalizer.normalize_str(text)
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:
                # Letter by letter: str.lower() of a whole string looks at the context of a final sigma.
                return "".join(map(str.lower, text))
        return text.lower()

    def words(self, piece: str) -> list[str]:
        """Words of a normalised piece of text without white space or special tokens."""
        if piece.isalpha():
            return [piece]
        return (self.exact_word if has_unassigned(piece) else self.word).findall(piece)

    def pieces(self, text: str) -> Iterator[tuple[str | None, int]]:
        """(text between special tokens, 0) and (None, id of a special token), in order."""
        at = 0
        for m in self.marks.finditer(text) if self.marks and "<|" in text else ():
            yield text[at : m.start()], 0
            yield None, self.special[m[0]]
            at = m.end()
        yield text[at:], 0

    def split(self, text: str) -> list[str]:
        """Normalised pieces without white space. A single mark at the end of a word is a word, and a piece, of its own."""
        text = MARK_AFTER_LETTER.sub(r" \1", self.lowered(text))
        return text.split() if not any(x in text for x in SEPARATORS) else [x for x in self.space.split(text) if x]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part, special in self.pieces(text):
            out += [special] if part is None else [i for piece in self.split(part) for word in self.words(piece) for i in self.word_ids(word)]
        return out

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder, so tokens are joined by spaces; special ones are kept."""
        return " ".join(self.tokens[i] for i in ids)


_loaded: dict[str, WordBpe] = {}


def tokenizer(path: str) -> WordBpe:
    """The tokenizer of this process."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


class Renderer:
    """Whole texts in a rendered form of their ids, which is put together from remembered pieces.

    ``render`` makes bytes of the ids of a word; ``joint`` stands between words.
    """

    def __init__(self, bpe: WordBpe, render: Callable[[bytes], bytes] | None = None, joint: bytes = b""):
        self.bpe, self.render, self.joint = bpe, render, joint
        self.known: dict[str, bytes] = {}

    def learn(self, pieces: set[str]) -> None:
        """Remember the values of pieces that are not known yet."""
        odd = {piece: self.bpe.words(piece) for piece in pieces if not piece.isalpha()}
        new = [*{w for words in odd.values() for w in words}.union(pieces.difference(odd)).difference(self.known)]
        ids = self.bpe.words_ids(new)
        self.known.update(zip(new, map(self.render, ids) if self.render else ids, strict=True))
        # A word that is a piece as well has been learnt by now, with the same value.
        self.known.update({piece: self.joint.join([self.known[w] for w in words]) for piece, words in odd.items()})

    def texts(self, texts: list[str]) -> list[bytes]:
        """Values of a block of whole texts. What is new to it is encoded at once; then all is looked up."""
        parts = [[(special, None if part is None else self.bpe.split(part)) for part, special in self.bpe.pieces(t)] for t in texts]
        seen = set().union(*(pieces for text in parts for _, pieces in text if pieces))
        if len(self.known) >= REMEMBERED:  # what this block has as well is likely to come again
            self.known = {p: self.known[p] for p in seen.intersection(self.known)}
        known, get = self.known, self.known.__getitem__
        unknown = seen.difference(known)
        self.learn(unknown)
        out = []
        for text in parts:
            values = map(get, text[0][1]) if len(text) == 1 else [x for special, own in text for x in ([self.special(special)] if own is None else map(get, own))]
            # Without a joint, pieces that hold no word are no matter.
            out.append(self.joint.join(filter(None, values) if self.joint else values))
        for piece in unknown:
            if len(piece) > LONGEST:
                del known[piece]
        return out

    def special(self, token: int) -> bytes:
        ids = array("I", [token]).tobytes()
        return self.render(ids) if self.render else ids


_renderers: dict[tuple[str, str], Renderer] = {}


def renderer(path: str, kind: str) -> Renderer:
    """This process's renderer: ids as little-endian 32-bit numbers, or "id token" pairs joined by line feeds."""
    if (path, kind) not in _renderers:
        bpe = tokenizer(path)
        of = {
            "bytes": lambda: Renderer(bpe),
            "both": lambda: Renderer(bpe, lambda ids: "\n".join([f"{i}\n{bpe.tokens[i]}" for i in array("I", ids)]).encode(), b"\n"),
        }
        _renderers[path, kind] = of[kind]()
    return _renderers[path, kind]


#: Characters of the texts that are encoded together.
BLOCK = 1_000_000


def blocks(texts: Iterable[str]) -> Iterator[list[str]]:
    """Runs of texts of about BLOCK characters."""
    run: list[str] = []
    held = 0
    for text in texts:
        run.append(text)
        held += len(text)
        if held >= BLOCK:
            yield run
            run, held = [], 0
            give_back()
    if run:
        yield run


def texts_of(column: pa.Array) -> Iterator[str]:
    """Texts of a column, a null as an empty one."""
    return (t or "" for part in slices(column) for t in part)


def id_bytes(path: str, texts: Iterable[str]) -> Iterator[bytes]:
    """The ids of each whole text as little-endian unsigned 32-bit numbers."""
    for run in blocks(texts):
        yield from renderer(path, "bytes").texts(run)


def encode_column(text: Column, path: str) -> Column:
    """Ids of whole texts as an array of ints; null counts as empty."""

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        bpe = tokenizer(path)
        return pa.array([bpe.encode(t or "") for t in texts.to_pylist()], pa.list_(pa.int32()))

    return ids(text)


def decode_column(ids: Column, path: str) -> Column:
    @F.arrow_udf("string")
    def text(rows: pa.Array) -> pa.Array:
        bpe = tokenizer(path)
        return pa.array([bpe.decode(r or []) for r in rows.to_pylist()], pa.string())

    return text(ids)


def digests(docs: DataFrame, path: str, id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """Per document: number of ids, and SHA-256 of the ids in decimal and of the decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = renderer(path, "both")
        for batch in batches:
            counts, shown, decoded = [], [], []
            for texts in blocks(texts_of(batch.column(1))):
                for both in store.texts(texts):
                    # Id, token, id, token ...: neither holds a line feed.
                    fields = both.split(b"\n") if both else []
                    counts.append(len(fields) // 2)
                    shown.append(hashlib.sha256(b" ".join(fields[::2])).hexdigest())
                    decoded.append(hashlib.sha256(b" ".join(fields[1::2])).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(shown, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), vocabulary())
