"""Byte-level BPE encoding and decoding with the tokenizers library."""

from __future__ import annotations

import base64
import gc
import hashlib
import json
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm._common import strings

#: Different pieces whose ids a worker remembers, and the most bytes of a piece that it remembers.
MEMO_PIECES, MEMO_LENGTH = 600_000, 48
#: Masks of the lowest 0 to 8 bytes of a 64-bit word, and an odd number for each word of a piece.
BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
ODD = np.random.default_rng(1).integers(1 << 63, size=MEMO_LENGTH // 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Characters of text that are encoded at once.
CHUNK = 1 << 19
#: Fixed value: the pattern of the vocabulary's pieces.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LETTER, NUMBER, BLANK = 1, 2, 3


@lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    """LETTER, NUMBER, BLANK or 0 for every code point, as the pattern's classes have them."""
    out = np.zeros(0x110000, np.uint8)
    everything = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)
    for kind, name in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\s+")):
        for m in regex.finditer(name, everything):
            out[np.frombuffer(m.group().encode("utf-32-le"), "<u4")] = kind
    return out


def piece_starts(code: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """Where PATTERN's pieces begin in the code points of texts that follow each other; opens marks their first ones.

    A run of letters, numbers or other signs is a piece, with the one U+0020 before it. Of a run of blanks, all but
    the last are a piece; the last one is too, unless it is that U+0020; at the end of a text the whole run is. An
    apostrophe that begins a piece takes s, t, m, d, re, ve or ll with it."""
    kind = character_classes()[code]
    n = len(code)
    blank = kind == BLANK
    begins = np.ones(n, bool)  # of runs
    begins[1:] = kind[1:] != kind[:-1]
    begins |= opens
    closes = np.append(opens[1:], True)
    last_blank = blank & ~closes
    last_blank[:-1] &= ~blank[1:]
    after_space = np.zeros(n, bool)
    after_space[1:] = code[:-1] == 32
    after_space &= ~opens & ~blank
    starts = (begins & ~after_space) | last_blank
    quote = np.flatnonzero((code == 39) & starts & ~closes)
    if len(quote):
        one = code[quote + 1]
        two = np.where(~closes[quote + 1], code[np.minimum(quote + 2, n - 1)], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = np.zeros(len(quote), bool)
        for a, b in ("re", "ve", "ll"):
            long |= (one == ord(a)) & (two == ord(b))
        hit = short | long
        quote, end = quote[hit], quote[hit] + np.where(short[hit], 2, 3)
        starts[quote + 1] = False
        starts[end[end < n]] = True
    return starts


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else one from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


class Vocabulary:
    """A byte-level BPE vocabulary, from a tiktoken file of ranks or from a tokenizers JSON file.

    Texts are cut into pieces by the pattern; every piece is encoded by the library's model on its own, once while the
    worker remembers it, which gives what the library gives for the whole text, as it never merges across pieces.
    What is remembered is found by a hash of a piece's bytes and compared with all of them, eight at a time; it is kept
    in arrays that are emptied when they hold `memory` pieces or 8 ids for each of them.

    A JSON file's added tokens are found in a text first, as the library finds them, and what stands between them is
    encoded on its own. A file of ranks has none.
    """

    def __init__(self, path: str, pattern: str, memory: int = MEMO_PIECES):
        from tokenizers import models

        chars, self.added, self.finder = byte_characters(), {}, None
        if path.endswith(".json"):
            with open(path, encoding="utf-8") as file:
                stored = json.load(file)
            vocab = stored["model"]["vocab"]
            merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in stored["model"]["merges"]]
            self.model = models.BPE(vocab=vocab, merges=merges, cache_capacity=0, ignore_merges=bool(stored["model"].get("ignore_merges")))
            for t in stored.get("added_tokens", []):
                if any(t.get(x) for x in ("single_word", "lstrip", "rstrip", "normalized")):
                    raise ValueError(f"added token {t['content']!r} is more than its text")
                self.added[t["content"]] = t["id"]
            if self.added:  # the longest of those that begin at a place
                self.finder = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")")
            vocab = vocab | self.added
        else:
            ranks = read_ranks(path)
            shown = {token: "".join(chars[b] for b in token) for token in ranks}
            merges = []
            for token in sorted(ranks, key=ranks.get):  # a merge for every way to make the token from two others
                cuts = [(token[:i], token[i:]) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
                merges += [(shown[a], shown[b]) for a, b in sorted(cuts, key=lambda x: (ranks[x[0]], ranks[x[1]]))]
            vocab = {shown[token]: rank for token, rank in ranks.items()}
            self.model = models.BPE(vocab=vocab, merges=merges, cache_capacity=0, ignore_merges=True)
        self.shown = str.maketrans({chr(b): c for b, c in chars.items()})
        back = {c: b for b, c in chars.items()}
        self.size = max(vocab.values()) + 1
        self.bytes = [b""] * self.size
        for shown_token, i in vocab.items():
            plain = shown_token in self.added or not all(c in back for c in shown_token)
            self.bytes[i] = shown_token.encode() if plain else bytes(back[c] for c in shown_token)
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.pattern = None if pattern == PATTERN else regex.compile(pattern)
        self.memory, self.width = memory, (3 * memory).bit_length()  # bits of a slot: several slots for each piece
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(1 << self.width, np.uint64)  # 0: nothing
        self.values = np.zeros(1 << self.width, np.int32)
        self.pool = array("I")
        self.begins, self.sizes = array("q"), array("i")
        self.spelled = array("Q", [0])  # the bytes of pieces, in words that are filled up with zeros
        self.spelled_at, self.spelled_size = array("q"), array("i")

    def _remember(self, pieces: list[bytes]) -> int:
        """Encodes different pieces; where the ids of the first one are kept, the others' follow."""
        first, tokenize = len(self.sizes), self.model.tokenize
        ids = [[t.id for t in tokenize(p.decode("latin-1").translate(self.shown))] for p in pieces]
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        self.begins.frombytes((len(self.pool) + np.cumsum(counts) - counts).tobytes())
        self.sizes.frombytes(counts.astype(np.int32).tobytes())
        self.pool.extend(chain.from_iterable(ids))
        kept = [p if len(p) <= MEMO_LENGTH else b"" for p in pieces]
        size = np.fromiter(map(len, kept), np.int64, len(kept))
        words = (size + 7) // 8
        self.spelled_at.frombytes(np.where(words > 0, len(self.spelled) + np.cumsum(words) - words, 0).tobytes())
        self.spelled_size.frombytes(size.astype(np.int32).tobytes())
        self.spelled.frombytes(b"".join([p.ljust(-(-len(p) // 8) * 8, b"\0") for p in kept]))
        return first

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The values of hashes, -1 for unknown ones."""
        slot = (h >> np.uint64(64 - self.width)).astype(np.int64)
        out = np.where(self.keys[slot] == h, self.values[slot], np.int32(-1))
        open_ = np.flatnonzero((out < 0) & (self.keys[slot] != 0))
        while len(open_):  # the slot was another's: go on to the next
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            key = self.keys[slot[open_]]
            same = key == h[open_]
            out[open_[same]] = self.values[slot[open_[same]]]
            open_ = open_[~same & (key != 0)]
        return out

    def _store(self, h: np.ndarray, values: np.ndarray) -> None:
        """Puts hashes into free slots; one that another piece has already is left out."""
        slot = (h >> np.uint64(64 - self.width)).astype(np.int64)
        while len(h):
            free = np.flatnonzero(self.keys[slot] == 0)
            self.keys[slot[free]], self.values[slot[free]] = h[free], values[free]
            other = self.keys[slot] != h
            h, values, slot = h[other], values[other], (slot[other] + 1) & (len(self.keys) - 1)

    def _starts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(begins, code): where pieces begin in the joined texts, and their code points."""
        code = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
        if self.pattern is None:
            opens = np.zeros(len(code), bool)
            opens[np.cumsum([0, *map(len, texts)])[:-1]] = True
            return np.flatnonzero(piece_starts(code, opens)), code
        sizes = [len(p) for t in texts for p in self.pattern.findall(t)]
        return np.cumsum([0, *sizes])[:-1].astype(np.int64), code

    def _encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of texts none of which is empty."""
        raw = "".join(texts).encode()
        begins, code = self._starts(texts)
        widths = 1 + (code >= 0x80).astype(np.int8) + (code >= 0x800) + (code >= 0x10000)
        at = np.cumsum(widths, dtype=np.int32 if len(raw) < 1 << 31 else np.int64) - widths if len(raw) > len(code) else np.arange(len(code))
        begins = at[begins].astype(np.int64, copy=False)
        sizes = np.diff(np.append(begins, len(raw)))
        # the eight bytes from each byte on
        eight = np.ndarray((len(raw) + MEMO_LENGTH,), "<u8", buffer=raw + bytes(MEMO_LENGTH + 8), strides=(1,))
        first = eight[begins] & BYTES[np.minimum(sizes, 8)]
        h = (sizes.astype(np.uint64) ^ first) * ODD[0]
        h ^= h >> np.uint64(31)
        words, of = [], np.flatnonzero(sizes > 8)
        for k in range(1, MEMO_LENGTH // 8):
            of = of[sizes[of] > 8 * k]
            if not len(of):
                break
            word = eight[begins[of] + 8 * k] & BYTES[np.minimum(sizes[of] - 8 * k, 8)]
            words.append((k, of, word))
            mixed = (h[of] ^ word) * ODD[k]
            h[of] = mixed ^ (mixed >> np.uint64(31))
        h *= ODD[0]
        h[h == 0] = 1
        if len(self.sizes) > self.memory or len(self.pool) > 8 * self.memory:
            self.forget()
        found = self._find(h)
        found[sizes > MEMO_LENGTH] = -1  # their hash is of their first bytes only
        if len(self.sizes):
            spelled, spelled_at = np.frombuffer(self.spelled, np.uint64), np.frombuffer(self.spelled_at, np.int64)
            found[np.frombuffer(self.spelled_size, np.int32)[found] != sizes] = -1
            found[spelled[spelled_at[found]] != first] = -1
            for k, of, word in words:
                known = found[of] >= 0
                of = of[known]
                found[of[spelled[spelled_at[found[of]] + k] != word[known]]] = -1
            del spelled, spelled_at
        missing = np.flatnonzero(found < 0)
        if len(missing):
            pieces = [raw[lo : lo + n] for lo, n in zip(begins[missing].tolist(), sizes[missing].tolist(), strict=True)]
            new = {p: i for i, p in enumerate(dict.fromkeys(pieces))}
            which = np.fromiter(map(new.__getitem__, pieces), np.int64, len(pieces))
            collecting = gc.isenabled()
            gc.disable()  # many small lists, and no cycles among them
            base = self._remember(list(new))
            if collecting:
                gc.enable()
            found[missing] = base + which
            once = missing[np.unique(which, return_index=True)[1]]
            short = sizes[once] <= MEMO_LENGTH
            self._store(h[once[short]], (base + np.flatnonzero(short)).astype(np.int32))
        counts = np.frombuffer(self.sizes, np.int32)[found].astype(np.int64)
        ends = np.cumsum(counts)
        source = np.repeat(np.frombuffer(self.begins, np.int64)[found] - (ends - counts), counts)
        source += np.arange(len(source))
        ids = np.frombuffer(self.pool, np.uint32)[source].astype("<u4", copy=False)
        where = np.cumsum([0, *map(len, texts)])
        edges = np.append(at[where[:-1]], len(raw))
        cut = np.append(0, ends)[np.searchsorted(begins, edges)].tolist()
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            yield ids[lo:hi].tobytes()

    def _parts(self, text: str) -> Iterator[str]:
        """A long text in parts that begin where pieces do: at a blank between letters or digits."""
        lo = 0
        while len(text) - lo > CHUNK:
            cut = lo + CHUNK
            while cut > lo and not (text[cut] == " " and text[cut - 1].isalnum() and text[cut + 1 : cut + 2].isalnum()):
                cut = text.rfind(" ", lo, cut)
            if cut <= lo:  # no such blank before: the next one behind
                cut = lo + CHUNK
                while 0 < cut < len(text) - 1 and not (text[cut] == " " and text[cut - 1].isalnum() and text[cut + 1].isalnum()):
                    cut = text.find(" ", cut + 1)
                if not 0 < cut < len(text) - 1:
                    break
            yield text[lo:cut]
            lo = cut
        yield text[lo:]

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers; about CHUNK characters at a time."""
        waiting: list[str] = []
        held = 0

        def flush() -> Iterator[bytes]:
            full = [t for t in waiting if t]
            found = iter(self._encode(full)) if full else iter(())
            yield from [next(found) if t else b"" for t in waiting]

        for text in texts:
            marked = self.finder is not None and any(t in text for t in self.added)
            if marked or len(text) > CHUNK:
                yield from flush()
                waiting, held = [], 0
                between = self.finder.split(text) if marked else [text]  # every other one is an added token
                out = []
                for k, plain in enumerate(between):
                    if k % 2:
                        out.append(self.added[plain].to_bytes(4, "little"))
                    elif plain:
                        out += [ids for part in ([plain] if self.pattern else self._parts(plain)) for ids in self._encode([part])]
                yield b"".join(out)
                continue
            waiting.append(text)
            held += len(text)
            if held > CHUNK:
                yield from flush()
                waiting, held = [], 0
        yield from flush()

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text]))

    def decode(self, ids: bytes) -> bytes:
        """The bytes that ids stand for. A character may be split over ids, so only the whole is UTF-8."""
        token = self.bytes
        return b"".join([token[i] for i in np.frombuffer(ids, "<u4").tolist()])

    def offsets(self, ids: bytes, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Of each id, the first character that it touches and the one after its last.

        A character that is split over ids belongs to each of them."""
        ends = np.cumsum(self.lengths[np.frombuffer(ids, "<u4")])
        begins = np.append(0, ends[:-1])[: len(ends)]
        leads = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
        seen = np.append(0, np.cumsum(leads))  # characters begun before each byte
        inside = np.append(~leads, False)
        return seen[begins] - inside[begins], seen[ends]


@lru_cache(maxsize=4)
def vocabulary(path: str, pattern: str, memory: int = MEMO_PIECES) -> Vocabulary:
    """One Vocabulary for each Python worker."""
    return Vocabulary(path, pattern, memory)


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _slim(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, ids, begins, ends): the ids of each whole text, and the characters that each id covers.

    A null text is encoded as the empty one, which has no ids. Added tokens of a JSON file are found in texts as the
    library finds them; with a file of ranks there are none, and such strings are ordinary text. Rows with a
    null or repeated doc_id are encoded like others; other columns are ignored; an empty table gives an empty result.
    A text is split a megabyte of characters at a time, so a very long one takes little more memory than its ids.
    """
    path, pattern = path or default_path("byte_bpe_50k.tiktoken"), pattern or default_pattern()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part, ids, begins, ends = batch.slice(lo, 256), [], [], []
                texts = strings(part.column(1))
                for t, encoded in zip(texts, v.encode_all(texts), strict=True):
                    ids.append(encoded)
                    b, e = v.offsets(ids[-1], t.encode())
                    begins.append(b.astype(np.int32))
                    ends.append(e.astype(np.int32))
                lists = lambda x: pa.array(x, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists([np.frombuffer(i, "<u4").astype(np.int32) for i in ids]), lists(begins), lists(ends)], names=["doc_id", "ids", "begins", "ends"])

    return _slim(docs, text, doc_id).mapInArrow(run, "doc_id long, ids array<int>, begins array<int>, ends array<int>")


def decode(encoded: DataFrame, path: str | None = None, pattern: str | None = None, ids: str = "ids", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, content): the bytes that each row's ids stand for; null ids give no bytes."""
    path, pattern = path or default_path("byte_bpe_50k.tiktoken"), pattern or default_pattern()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, pattern)
        for batch in batches:
            content = [v.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(content, pa.binary())], names=["doc_id", "content"])

    return encoded.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(run, "doc_id long, content binary")


def digests(docs: DataFrame, path: str | None = None, pattern: str | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode and decode in one pass, and what came of them.

    The ids stay in the worker, so that no array crosses to the JVM and back. Nulls and the like are as in encode.
    """
    path, pattern = path or default_path("byte_bpe_50k.tiktoken"), pattern or default_pattern()

    def sha(x: bytes) -> str:
        return hashlib.sha256(x).hexdigest()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, pattern)
        for batch in batches:
            rows = []
            for ids in v.encode_all(strings(batch.column(1))):
                rows.append((len(ids) // 4, sha(ids), sha(v.decode(ids))))
            n, a, b = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _slim(docs, text, doc_id).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def counted(docs: DataFrame, path: str | None = None, pattern: str | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens) of every document, without the ids."""
    path, pattern = path or default_path("byte_bpe_50k.json"), pattern or default_pattern()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, pattern)
        for batch in batches:
            n = [len(ids) // 4 for ids in v.encode_all(strings(batch.column(1)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return _slim(docs, text, doc_id).mapInArrow(run, "doc_id long, n_tokens long")
