"""Byte-pair encoding and decoding with a segment tree over adjacent pair ranks.

A pre-token is a row of symbols.  Leaf i of its tree holds the merge rank of the pair
that starts at symbol i (with i itself in the low bits), so the root yields the
leftmost pair of lowest rank.  A merge changes three leaves, each with one walk to the
root; encoding ends when the root shows no mergeable pair.  The trees of many words of
similar length are rows of one array, and every step advances all words that still
have a merge, so the work per merge is logarithmic in the word and done in numpy.

The vocabulary file is a parameter (a ``tokenizers`` JSON file with a BPE model, an
optional end-of-word suffix, byte-level symbols, a pattern split that drops what does
not match, and a normalizer of NFC, white space folding and lower-casing).  Encoding
equals the library's ``encode(add_special_tokens=False)`` without truncation and
padding; special tokens inside a text are recognised; decoding equals
``decode(ids, skip_special_tokens=False)`` of a file without a decoder.

White space never reaches a pre-token, so a text is cut at blanks and line ends first,
and what a piece encodes to is remembered for recent pieces.  Null and empty texts have
no ids and decode to the empty text; repeated rows are encoded one by one.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ohlcflow.llm.common import RecentWords, id_and_text, pieces_of, small_batches

NONE = np.int64(1) << 62  # a leaf without a mergeable pair
_LOW = np.int64((1 << 32) - 1)

#: Symbols that one numpy step may hold; longer lists of words are encoded in parts.
STEP_SYMBOLS = 1 << 19
#: Of words of at least so many symbols, the last so many go on without numpy, whose calls cost more there.
LONG_ROW, FEW_ROWS = 256, 4
#: Pieces of one of two generations that a worker remembers (about 400 bytes each): for
#: digests alone, and where ids are returned beside the memory of other steps.
RECENT, RECENT_WITH_IDS = 350_000, 100_000



def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + rest.index(b)) for b in range(256)]


@functools.lru_cache(maxsize=1)
def odd_characters() -> re.Pattern:
    """Characters that Python's and the regex module's Unicode tables class differently (letter,
    number or neither): those assigned between the two versions."""
    import regex

    every = "".join(map(chr, (*range(0x80, 0xD800), *range(0xE000, sys.maxunicode + 1))))
    own = "".join(c if (c := unicodedata.category(x)[0]) in "LN" else "-" for x in every)
    theirs = list("-" * len(every))
    for kind in "LN":
        for m in regex.finditer(rf"\p{{{kind}}}+", every):
            theirs[m.start():m.end()] = kind * (m.end() - m.start())
    odd = "".join("1" if a != b else "0" for a, b in zip(own, theirs, strict=True))
    ranges = [(every[m.start()], every[m.end() - 1]) for m in re.finditer("1+", odd)]
    return re.compile("[" + "".join(f"{re.escape(a)}-{re.escape(z)}" for a, z in ranges) + "]") if ranges \
        else re.compile(r"(?!)")


class Bpe:
    """Encoder of one vocabulary file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        normal = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or normal != ["NFC", "Replace", "Lowercase"] or spec["decoder"] is not None \
                or [p["type"] for p in pre] != ["Split", "ByteLevel"] or not pre[0]["invert"] \
                or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: a kind of tokenizer that this operator does not know")
        vocab: dict[str, int] = model["vocab"]
        end = model["end_of_word_suffix"] or ""
        self.path = path
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in [*vocab.items(), *self.special.items()]}
        self.pattern = regex.compile(pre[0]["pattern"]["Regex"])
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") \
            if self.special else None
        shown = byte_symbols()
        self.byte_of = {c: b for b, c in enumerate(shown)}
        self.inner = np.array([vocab[c] for c in shown], dtype=np.int64)
        self.final = np.array([vocab[c + end] for c in shown], dtype=np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.width = np.int64(max(vocab.values()) + 1)
        keys = np.array([vocab[a] * int(self.width) + vocab[b] for a, b in pairs], dtype=np.int64)
        merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks, self.merged = keys[order], order.astype(np.int64), merged

    def leaves(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Leaf values of the pairs (left, right) that start at symbols ``at``; a negative side: no pair."""
        key = left * self.width + right
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = (self.keys[place] == key) & (left >= 0) & (right >= 0)
        return np.where(found, (self.ranks[place] << 32) | at, NONE)

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of every pre-token, given as bytes (none empty)."""
        out: list = [None] * len(words)
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        for bits in range(int(sizes.max(initial=0)).bit_length() + 1):
            rows = np.flatnonzero((sizes <= 1 << bits) & ((sizes > 1 << bits >> 1) | (bits == 0)))
            step = max(1, STEP_SYMBOLS >> bits)
            for i in range(0, len(rows), step):
                part = rows[i:i + step]
                for r, ids in zip(part, self._encode_rows([words[r] for r in part], 1 << bits), strict=True):
                    out[r] = ids
        return out

    def _encode_rows(self, words: list[bytes], width: int) -> list[list[int]]:
        n = len(words)
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), dtype=np.uint8).reshape(n, width)
        place = np.arange(width, dtype=np.int64)
        inside = place < sizes[:, None]
        last = place == sizes[:, None] - 1
        symbols = np.where(inside, np.where(last, self.final[raw], self.inner[raw]), -1)
        nxt = np.where(inside & ~last, place + 1, -1)
        prev = np.where(inside & (place > 0), place - 1, -1)
        right = np.full((n, width), -1, dtype=np.int64)
        right[:, :-1] = symbols[:, 1:]
        tree = np.empty((n, 2 * width), dtype=np.int64)
        tree[:, width:] = self.leaves(symbols, right, np.broadcast_to(place, (n, width)))
        level = width
        while level > 1:
            half = level >> 1
            tree[:, half:level] = np.minimum(tree[:, level:2 * level:2], tree[:, level + 1:2 * level:2])
            level = half
        flat_sym, flat_next, flat_prev, flat_tree = (x.reshape(-1) for x in (symbols, nxt, prev, tree))
        live = np.arange(n, dtype=np.int64)
        while True:
            best = tree[live, 1]
            live, best = live[best < NONE], best[best < NONE]
            if not len(live):
                break
            if len(live) <= FEW_ROWS and width >= LONG_ROW:
                for r in live.tolist():
                    symbols[r] = self._finish_row(symbols[r].tolist(), nxt[r].tolist(), prev[r].tolist(), tree[r].tolist())
                break
            base, i = live * width, best & _LOW
            j = flat_next[base + i]
            k = flat_next[base + j]
            h = flat_prev[base + i]
            flat_sym[base + i] = self.merged[best >> 32]
            flat_sym[base + j] = -1
            flat_next[base + i] = k
            has_k, has_h = k >= 0, h >= 0
            flat_prev[(base + k)[has_k]] = i[has_k]
            own = flat_sym[base + i]
            after = np.where(has_k, flat_sym[base + np.maximum(k, 0)], -1)
            before = np.where(has_h, flat_sym[base + np.maximum(h, 0)], -1)
            tbase = live * (2 * width)
            flat_tree[tbase + width + j] = NONE
            flat_tree[tbase + width + i] = self.leaves(own, after, i)
            flat_tree[(tbase + width + h)[has_h]] = self.leaves(before, own, h)[has_h]
            node = np.concatenate([width + i, width + j, np.where(has_h, width + h, width + i)])
            tbase = np.concatenate([tbase, tbase, tbase])
            while width > 1 and node[0] > 1:
                node = node >> 1
                flat_tree[tbase + node] = np.minimum(flat_tree[tbase + 2 * node], flat_tree[tbase + 2 * node + 1])
        kept = symbols >= 0
        ids = symbols[kept].tolist()
        ends = np.cumsum(kept.sum(axis=1)).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    @functools.cached_property
    def pair(self) -> dict[int, tuple[int, int]]:
        """(rank << 32, merged symbol) of every mergeable pair, by left * width + right."""
        ranks = self.ranks.tolist()
        return dict(zip(self.keys.tolist(), zip([r << 32 for r in ranks], self.merged[self.ranks].tolist(), strict=True),
                        strict=True))

    def _finish_row(self, sym: list[int], nxt: list[int], prev: list[int], tree: list[int]) -> list[int]:
        """The merges that are left of one word, in the same tree but number by number."""
        width, leaf, scale = len(sym), self.pair.get, int(self.width)
        none, low_bits = int(NONE), int(_LOW)

        def put(at: int, value: int) -> None:
            node = width + at
            tree[node] = value
            while node > 1:
                node >>= 1
                a, b = tree[2 * node], tree[2 * node + 1]
                low = a if a < b else b
                if tree[node] == low:
                    break
                tree[node] = low

        def rank(left: int, at: int) -> int:
            """Leaf of the pair that starts with symbol ``left`` before place ``at`` (-1: none)."""
            found = leaf(left * scale + sym[at]) if at >= 0 else None
            return found[0] if found else none

        while (best := tree[1]) < none:
            i = best & low_bits
            j = nxt[i]
            k, h = nxt[j], prev[i]
            sym[i] = own = leaf(sym[i] * scale + sym[j])[1]
            sym[j] = -1
            nxt[i] = k
            if k >= 0:
                prev[k] = i
            put(j, none)
            put(i, r | i if (r := rank(own, k)) < none else r)
            if h >= 0:
                put(h, r | h if (r := rank(sym[h], i)) < none else r)
        return sym

    def folded(self, text: str) -> str:
        """The normalizer's NFC and lower-casing; the latter sees one character at a time,
        so a sigma at a word's end is like any other."""
        return text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def by_library(self, text: str) -> list[str]:
        """Pre-tokens by the library's own normalizer and splitter: for characters younger than
        one of the Unicode tables here."""
        from tokenizers import Tokenizer

        if not hasattr(self, "library"):
            self.library = Tokenizer.from_file(self.path)
        cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(self.byte_of[c] for c in w).decode("utf-8", "surrogatepass") for w, _ in cut]

    def pretokens(self, pieces: list[str]) -> list[list]:
        """Special token ids and pre-token texts of every piece, in order; no piece has a line end."""
        out: list[list] = []
        plain, together = self.pattern.findall, "\n".join(pieces)
        odd = not together.isascii() and odd_characters().search(together)
        if odd or self.cut and any(s in together for s in self.special):
            for p in pieces:
                parts = self.cut.split(p) if self.cut else [p]
                out.append([w for part in parts for w in (
                    [self.special[part]] if part in self.special else self.by_library(part)
                    if odd and odd_characters().search(part) else plain(self.folded(part)))])
            return out
        # one pass over all pieces; white space never matches the pattern, so line ends can part them
        return [plain(p) for p in self.folded(together).split("\n")] if pieces else []

    def encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        cut = self.pretokens(pieces)
        words = list({w for c in cut for w in c if type(w) is str})
        known: dict = dict(zip(words, self.encode_words([w.encode("utf-8", "surrogatepass") for w in words]),
                               strict=True))
        for i in self.special.values():
            known[i] = [i]
        return [known[c[0]] if len(c) == 1 else [i for w in c for i in known[w]] for c in cut]

    def encode(self, text: str) -> list[int]:
        return [i for ids in self.encode_pieces(pieces_of(text)) for i in ids]

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


@functools.lru_cache(maxsize=2)
def remembered(path: str, limit: int = RECENT) -> tuple[Bpe, RecentWords]:
    """The encoder of a file, and what recent pieces encode to: (count, ids, ids in decimal, tokens)."""
    bpe = Bpe(path)

    def compute(pieces: list[str]) -> list[tuple[int, bytes, str, str]]:
        return [(len(ids), array("i", ids).tobytes(), " ".join(map(str, ids)), bpe.decode(ids))
                for ids in bpe.encode_pieces(pieces)]

    return bpe, RecentWords(compute, limit=limit)


def _sha(parts) -> str:
    return hashlib.sha256(" ".join(parts).encode("utf-8", "surrogatepass")).hexdigest()


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """Every whole text encoded and decoded again: ``doc_id``, ``ids`` (array of int),
    ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by blanks), ``decoded_sha256``."""
    return _encode(docs, path, True)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """``encode_documents`` without ``ids``."""
    return _encode(docs, path, False)


def _encode(docs: DataFrame, path: str, with_ids: bool) -> DataFrame:
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = remembered(path, RECENT_WITH_IDS if with_ids else RECENT)[1]
        for b in batches:
            count, ids_sha, text_sha, raw = [], [], [], []
            for found in known.of([pieces_of(t) for t in b.column("text").to_pylist()]):
                numbers, ids, decimal, shown = zip(*found, strict=True) if found else ((),) * 4
                if 0 in numbers:  # pieces without a token
                    some = [f for f in found if f[0]]
                    numbers, ids, decimal, shown = zip(*some, strict=True) if some else ((),) * 4
                count.append(sum(numbers))
                ids_sha.append(_sha(decimal))
                text_sha.append(_sha(shown))
                raw += ids if with_ids else ()
            columns = {"doc_id": b.column("doc_id"), "n_tokens": pa.array(count, pa.int64()),
                       "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())}
            if with_ids:
                flat = pa.array(np.frombuffer(b"".join(raw), dtype=np.int32))
                columns["ids"] = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *count]), pa.int32()), flat)
            yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return id_and_text(docs).mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``text``: ids (array of int) decoded; null ids give the empty text."""
    small_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = remembered(path, RECENT_WITH_IDS)[0]
        for b in batches:
            texts = [bpe.decode(ids or []) for ids in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())],
                                             names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
