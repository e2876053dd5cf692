"""Byte-pair encoding and decoding of whole texts by batched numpy merge rounds.

The vocabulary is a file of the tokenizers library whose model is BPE with an end-of-word suffix, with NFC, white space to one space and
lower case before the split, and no decoder (decoding joins the token strings with a space).

Texts are cut at white space; each distinct run of characters in a task is split and merged once. The symbols of all new words of a
batch stand in one flat array. In each round every pair of neighbours is looked up by binary search over the sorted pair keys of the
merge list, each word merges the pair of its lowest rank wherever it occurs (from the left, without overlap), and words without a pair
leave. A round costs the length of what is left, and a long run of letters takes many rounds, so words of more than `LONG` bytes are merged
one pair at a time from a heap of (rank, place), which gives the same symbols.

Nulls: a null text counts as empty (no tokens, the digests of the empty string). Repeated rows are encoded each; an empty table
gives no rows; texts of any length are encoded whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from .common import id_and_text, id_back, table

#: The pre-tokenizer's pattern and white space as it counts it.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACE = "".join(map(chr, (*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


#: Words of more bytes than this are merged from a heap.
LONG = 1000


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where it is one, else the next from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b if b in own else extra))
        extra += b not in own
    return out


class WordBPE:
    """Tables of a vocabulary file, and a bounded memory of the words met so far."""

    def __init__(self, path: str, remember: int = 400_000):
        import json

        import numpy as np
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.added.values()])
        self.strings = [""] * size
        for s, i in [*vocab.items(), *self.added.items()]:
            self.strings[i] = s
        chars = byte_characters()
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.final = np.array([vocab[c + end] for c in chars], np.int64)
        self.base = size
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] * size + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)[order]
        self.words = regex.compile(WORDS)
        self.marks = regex.compile("|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.remember = remember
        self.pairs: dict[int, tuple[int, int]] = {}
        self.forget()

    def forget(self) -> None:
        import numpy as np

        self.known: dict[str, int] = {}
        self.ids, self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def merge_words(self, words: list[str]):
        """(flat ids, number of ids of each word)."""
        import numpy as np

        raw = [w.encode() for w in words]
        long = [i for i, w in enumerate(raw) if len(w) > LONG]
        if long:
            return self.with_long(raw, long)
        return self.in_rounds(raw)

    def with_long(self, raw: list[bytes], long: list[int]):
        """As in_rounds, with the words at the places `long` merged by heap."""
        import numpy as np

        apart = set(long)
        short = [i for i in range(len(raw)) if i not in apart]
        parts: list = [None] * len(raw)
        if short:
            ids, sizes = self.in_rounds([raw[i] for i in short])
            for i, part in zip(short, np.split(ids, np.cumsum(sizes)[:-1])):
                parts[i] = part
        for i in long:
            parts[i] = self.from_heap(raw[i])
        return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))

    def from_heap(self, word: bytes):
        """The word's symbols: always the pair of lowest rank is merged, the leftmost first, in a list whose places are linked."""
        import heapq

        import numpy as np

        if not self.pairs:
            self.pairs = dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.made.tolist())))
        flat = np.frombuffer(word, np.uint8)
        sym = self.inner[flat].tolist()
        sym[-1] = int(self.final[flat[-1]])
        n, base, find = len(sym), self.base, self.pairs.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(found[0], i, key) for i, key in enumerate(a * base + b for a, b in zip(sym, sym[1:])) if (found := find(key))]
        heapq.heapify(heap)
        while heap:
            _, i, key = heapq.heappop(heap)
            j = after[i]
            if sym[i] < 0 or j >= n or sym[i] * base + sym[j] != key:
                continue
            sym[i], sym[j] = find(key)[1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for a, b in ((before[i], i), (i, k)):
                if a >= 0 and b < n and (found := find(key := sym[a] * base + sym[b])):
                    heapq.heappush(heap, (found[0], a, key))
        return np.array([x for x in sym if x >= 0], np.int32)

    def in_rounds(self, raw: list[bytes]):
        import numpy as np

        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        flat = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(lengths) - 1
        sym = self.inner[flat]
        sym[ends] = self.final[flat[ends]]
        word = np.repeat(np.arange(len(raw)), lengths)
        done_sym, done_word = [], []
        none = np.int64(1) << 40
        while len(sym):
            key = np.empty(len(sym), np.int64)
            key[:-1] = sym[:-1] * self.base + sym[1:]
            at = np.searchsorted(self.keys, key)
            at[at == len(self.keys)] = 0
            hit = self.keys[at] == key
            hit[:-1] &= word[1:] == word[:-1]
            hit[-1] = False
            rank = np.where(hit, self.ranks[at], none)
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            count = np.diff(np.append(first, len(sym)))
            low = np.repeat(np.minimum.reduceat(rank, first), count)
            over = low == none
            done_sym.append(sym[over])
            done_word.append(word[over])
            pick = (rank == low) & ~over
            if (pick[1:] & pick[:-1]).any():  # aaa: every second one of a run, from its left
                place = np.arange(len(sym))
                begun = np.maximum.accumulate(np.where(pick & ~np.concatenate(([False], pick[:-1])), place, -1))
                pick &= (place - begun) % 2 == 0
            sym[pick] = self.made[at[pick]]
            keep = ~over
            keep[1:] &= ~pick[:-1]
            sym, word = sym[keep], word[keep]
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return sym[order].astype(np.int32), np.bincount(word, minlength=len(raw))

    def learn(self, chunks: list[str]) -> None:
        """Encodes runs of characters without white space that haven't been met."""
        import numpy as np

        split = [self.words.findall(c) for c in chunks]
        parts = [w for s in split for w in s]
        inner: dict[str, int] = {}
        place = np.fromiter((inner.setdefault(w, len(inner)) for w in parts), np.int64, len(parts))
        if inner:
            ids, sizes = self.merge_words(list(inner))
            starts = np.cumsum(sizes) - sizes
            flat, own = gather(ids, starts[place], sizes[place]), sizes[place]
        else:
            flat, own = np.zeros(0, np.int32), np.zeros(0, np.int64)
        per = np.zeros(len(chunks) + 1, np.int64)
        counts = np.fromiter(map(len, split), np.int64, len(split))
        total = np.concatenate(([0], np.cumsum(own)))
        per = total[np.cumsum(counts)] - total[np.cumsum(counts) - counts]
        self.starts = np.concatenate((self.starts, len(self.ids) + np.cumsum(per) - per))
        self.sizes = np.concatenate((self.sizes, per))
        self.ids = np.concatenate((self.ids, flat))
        for c in chunks:
            self.known[c] = len(self.known)

    def chunks(self, text: str) -> list[str]:
        """The text's runs of characters, each normalised. An added token is a run of its own, after a space, with which no other can start."""
        import unicodedata

        out: list[str] = []
        pieces = [(text, None)]
        if self.marks and "<|" in text:
            pieces, at = [], 0
            for m in self.marks.finditer(text):
                pieces += [(text[at : m.start()], None), ("", m[0])]
                at = m.end()
            pieces.append((text[at:], None))
        for part, mark in pieces:
            if mark:
                out.append(" " + mark)
                continue
            if not part.isascii():
                if not unicodedata.is_normalized("NFC", part):
                    part = unicodedata.normalize("NFC", part)
                part = part.replace("Σ", "σ")
            part = part.lower()
            if any(c in part for c in "\x1c\x1d\x1e\x1f"):
                for c in SPACE:
                    part = part.replace(c, " ")
                out += [x for x in part.split(" ") if x]
            else:
                out += part.split()
        return out

    def encode(self, texts: list[str]) -> list:
        """An int32 array of ids for each text."""
        import numpy as np

        runs = [self.chunks(t) for t in texts]
        if len(self.known) > self.remember:
            self.forget()
        new = dict.fromkeys(c for r in runs for c in r if c not in self.known)
        marks = [c for c in new if c[0] == " "]
        for c in marks:
            del new[c]
            self.starts = np.append(self.starts, len(self.ids))
            self.sizes = np.append(self.sizes, 1)
            self.ids = np.append(self.ids, np.int32(self.added[c[1:]]))
            self.known[c] = len(self.known)
        if new:
            self.learn(list(new))
        counts = np.fromiter(map(len, runs), np.int64, len(runs))
        known = self.known
        place = np.fromiter((known[c] for r in runs for c in r), np.int64, int(counts.sum()))
        sizes = self.sizes[place]
        flat = gather(self.ids, self.starts[place], sizes)
        ends = np.concatenate(([0], np.cumsum(sizes)))[np.cumsum(counts)]
        return np.split(flat, ends[:-1])

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.strings.__getitem__, ids))


def gather(flat, starts, sizes):
    """flat[s:s+n] for each start and size, in one array."""
    import numpy as np

    total = np.cumsum(sizes)
    n = int(total[-1]) if len(total) else 0
    return flat[np.arange(n) - np.repeat(total - sizes - starts, sizes)]


def encode_decode(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", keep_ids: bool = False, batch_chars: int = 1_500_000) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; with keep_ids also ids and decoded."""

    def mapped(batches: Iterator) -> Iterator:
        import pandas as pd
        import public_tokenizers as P

        bpe = WordBPE(P.path(vocabulary))

        def rows(docs, texts):
            out = []
            for doc, ids in zip(docs, bpe.encode(texts)):
                decoded = bpe.decode(ids.tolist())
                more = (ids.tolist(), decoded) if keep_ids else ()
                out.append((doc, len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), *more))
            return pd.DataFrame(out, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if keep_ids else [])])

        for pdf in batches:
            held, texts, chars = [], [], 0
            for doc, text in zip(pdf["doc_id"].array, pdf["text"].array):
                held.append(doc)
                texts.append(text or "")
                chars += len(texts[-1])
                if chars > batch_chars:
                    yield rows(held, texts)
                    held, texts, chars = [], [], 0
            if held:
                yield rows(held, texts)

    schema = "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if keep_ids else "")
    return id_back(id_and_text(docs).mapInPandas(mapped, schema))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"))
