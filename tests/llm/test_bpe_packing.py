import hashlib
import random
import time
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from numeriq.llm.bpe import WordBPE, encode_decode, op3_bpe
from numeriq.llm.packing import cut_pieces, op10_best_fit_packing, pack, pack_documents, plan_packing

ODD = [
    "", None, " \t\n ", "It's THE end, they'LL say 'tis I'd've", "aaaaaaaaaaaaaaaaaaaaaaaa bbbb aaaaa", "ÉTÉ ΣΟΦΟΣ İstanbul ǅ straße ﬁ Å Å",
    "a<|endoftext|>b <|STARTOFTEXT|> <|startoftext|><|startoftext|>", "12345 x2y ½ Ⅷ ²", "日本語のテキスト 😀😀 👩‍👩‍👧", "tab\x1cfile\x1fsep\x85nel line　wide",
    "!!!???...___--- #tag @name http://a.b/c?d=e&f", "x" * 3000, ("word " * 5000).strip(), "﻿bom \u0000 nul", "<| <|end|> |>",
]


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, length string")


def test_encoding_is_that_of_the_library(spark, sf_dir):
    exact = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    texts = ODD + [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    mine = WordBPE(P.path("word_bpe_49k.json")).encode([t or "" for t in texts])
    for t, ids in zip(texts, mine):
        want = exact.encode(t or "", add_special_tokens=False).ids
        assert ids.tolist() == want, t
    got = {r["doc_id"]: r for r in encode_decode(docs(spark, texts), keep_ids=True).collect()}
    for i, t in enumerate(texts):
        want = exact.encode(t or "", add_special_tokens=False).ids
        decoded = exact.decode(want, skip_special_tokens=False)
        r = got[i]
        assert (r["ids"], r["decoded"], r["n_tokens"]) == (want, decoded, len(want))
        assert r["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_memory_of_words_is_bounded():
    bpe = WordBPE(P.path("word_bpe_49k.json"), remember=10)
    a = [x.tolist() for x in bpe.encode(["one two three four five six seven eight nine ten eleven"] * 2)]
    bpe.encode(["twelve"])
    assert len(bpe.known) <= 12 and a[0] == a[1]


def check_packing(rows, lengths, size):
    by_seq = defaultdict(list)
    for r in rows:
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by_seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    assert len(rows) == len(lengths)
    return len(by_seq)


def test_packing(spark, sf_dir):
    exact = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = ODD + [r["text"] for r in table.select("text").collect()]
    rows = pack_documents(docs(spark, texts)).collect()
    per = defaultdict(list)
    for r in rows:
        per[r["doc_id"]].append(r)
    total = 0
    for i, t in enumerate(texts):
        ids = exact.encode(t or "", add_special_tokens=False).ids + [2]
        total += len(ids)
        pieces = sorted(per[i], key=lambda r: r["piece"])
        assert [p["piece"] for p in pieces] == list(range(-(-len(ids) // 1024)))
        at = 0
        for p in pieces:
            assert p["start"] == at and p["ids_crc32"] == zlib.crc32(np.array(ids[at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids) and all(p["length"] == 1024 for p in pieces[1:])
    n = check_packing(rows, rows, 1024)
    assert n <= 1.02 * -(-total // 1024) + 1
    assert op10_best_fit_packing(spark, sf_dir).count() >= table.count()


def test_plan_covers_every_piece_once():
    rng = np.random.default_rng(3)
    for size, n in ((16, 200), (1024, 3000), (10, 7), (5, 1)):
        lengths = rng.integers(1, size + 1, n)
        counts = dict(zip(*np.unique(lengths, return_counts=True)))
        used = defaultdict(int)
        fill = defaultdict(int)
        for length, lo, hi, first, per, at in plan_packing({int(k): int(v) for k, v in counts.items()}, size):
            assert lo == used[length]
            used[length] = hi
            for x in range(lo, hi):
                fill[first + (x - lo) // per] += length
        assert dict(used) == counts and max(fill.values()) <= size
        assert len(fill) <= max(-(-int(lengths.sum()) // size) * 1.1 + 1, (lengths > size // 2).sum() + 1)


def test_empty_and_repeated(spark):
    assert pack_documents(docs(spark, [])).count() == 0 and encode_decode(docs(spark, [])).count() == 0
    same = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    assert check_packing(pack(cut_pieces(same).persist()).collect(), [1] * 3, 1024) == 1
    assert encode_decode(same).count() == 3
    assert op3_bpe is not None


def test_long_runs_of_letters():
    """Words merged by heap equal those merged in rounds and the library's, in time that is nearly in proportion to their length."""
    path = P.path("word_bpe_49k.json")
    bpe, library = WordBPE(path), Tokenizer.from_file(path)
    rng = random.Random(3)
    texts = ["".join(rng.choice(kind) for _ in range(n)) for kind in ("abcdefghijklmnop", "aab", "a", "thein", "éüßa") for n in (1001, 2500, 5000)]
    texts += ["short " + texts[0] + " words, " + texts[4] + "'s end"]
    for text, ids in zip(texts, bpe.encode(texts)):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
        word = text.encode()
        if text.isalpha():
            assert bpe.from_heap(word).tolist() == bpe.in_rounds([word])[0].tolist()
    began = time.perf_counter()
    bpe.encode(["".join(rng.choice("etaoinshrdlu") for _ in range(100_000))])
    assert time.perf_counter() - began < 3


def test_the_second_vocabulary_is_loaded_with_the_first_text_that_needs_it(monkeypatch):
    import public_tokenizers as P
    import tokenizers

    from numeriq.llm.packing import added_tokens, byte_bpe

    path, loaded = P.path("byte_bpe_50k.json"), []

    class Watched:
        @staticmethod
        def from_file(name):
            loaded.append(name)
            return whole.from_file(name)

    whole = tokenizers.Tokenizer
    exact = whole.from_file(path)
    monkeypatch.setattr(tokenizers, "Tokenizer", Watched)
    encode = byte_bpe(path, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    marks = [t.content for t in exact.get_added_tokens_decoder().values()]
    for n, text in enumerate(["", "plain  text\n", "Ünï ☃ 123", f"a{marks[0]}b", marks[0] * 2]):
        assert encode(text) == exact.encode(text, add_special_tokens=False).ids and len(loaded) == (n > 2)
    with open(path, encoding="utf-8") as f:
        assert added_tokens(f.read()) == marks


def test_workers_give_arrow_memory_back():
    import pyarrow as pa

    from numeriq.llm.common import give_back

    released = []

    class Pool:
        def release_unused(self):
            released.append(1)

    usual = pa.default_memory_pool
    pa.default_memory_pool = Pool
    try:
        give_back()
    finally:
        pa.default_memory_pool = usual
    assert released == [1]
