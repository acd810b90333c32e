import random
import zlib

import numpy as np

from tessella.llm import packing
from tessella.llm.bpe import byte_level_ranks, tokenizer, vocabulary

PATH = vocabulary("byte_bpe_50k.json")


def ids_of(text):
    return tokenizer(PATH).encode(text or "", add_special_tokens=False).ids


def test_encoding_is_the_librarys():
    texts = [None, "", " ", "  a  b ", "a b", "x\n\ny z\n w", "I'm don't we'll", "ä ö\u00a0ü \u3000 z", "<|endoftext|> a<|endoftext|>b", "a \x1c b \x85 c \u180e d \u200b e \ufeff f", "日本 語 text 123 4567", "tab\t a \tb", "\u2028 a", "a  \n b", "😀 😀 a"]
    texts += ["".join(random.Random(i).choices(" \n\tab1.'é", k=60)) for i in range(200)]
    texts += [" " * 3000, "\n" * 600 + "x", "x" + "\u3000" * 700]
    assert [packing.encode_text(t, PATH).tolist() for t in texts] == [ids_of(t) for t in texts]
    assert byte_level_ranks(PATH)[0] is not None and byte_level_ranks(vocabulary("word_bpe_49k.json"))[0] is None


def test_every_character_is_encoded_as_by_the_library():
    around = "a{0}b {0}{0}  {0}1 {0}. {0}\n{0}'s"
    texts = ["".join(around.format(chr(c)) for c in range(k, k + 16) if not 0xD800 <= c < 0xE000) for k in range(0, 0x110000, 16)]
    made = tokenizer(PATH)
    for k in range(0, len(texts), 4096):
        some = texts[k : k + 4096]
        assert all(packing.encode_text(t, PATH).tolist() == got.ids for t, got in zip(some, made.encode_batch_fast(some, add_special_tokens=False)))


def test_long_texts_are_encoded_part_by_part(monkeypatch):
    rng = random.Random(9)
    text = "".join(rng.choices(["word ", "a", " ", "\n", "é ", "12", "<|endoftext|>", "... "], k=4000))
    want = ids_of(text)
    for size in (1, 7, 100):
        monkeypatch.setattr(packing, "LONG", size)
        assert packing.encode_text(text, PATH).tolist() == want


def check(rows, texts, size):
    ids = {i: ids_of(t) + [0] for i, t in texts.items()}
    by_doc, by_bin = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_bin.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(ids)
    for i, pieces in by_doc.items():
        pieces.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(len(pieces)))
        at = 0
        for r in pieces:
            assert r["start"] == at
            part = ids[i][at : at + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes()) and len(part) == r["length"]
            at += r["length"]
        assert at == len(ids[i]) and all(r["length"] == size for r in pieces[1:])
        assert len(pieces) == -(-len(ids[i]) // size)
    for pieces in by_bin.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= size
    return len(by_bin), -(-sum(map(len, ids.values())) // size)


def test_packs_whole_documents_tightly(spark, docs):
    rng = random.Random(3)
    texts = {i: " ".join(rng.choices("alpha beta gamma delta 12 x".split(), k=rng.choice([1, 5, 30, 90, 400]))) for i in range(150)} | {150: None, 151: ""}
    rows = packing.pack(docs(*texts.items()), size=64, bucket=10).collect()
    bins, least = check(rows, texts, 64)
    assert bins <= least + 1


def test_fullest_is_exhaustive():
    rng = random.Random(4)
    for _ in range(50):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(5)}
        items = [k for k, n in counts.items() for _ in range(n)]
        sums = {0}
        for x in items:
            sums |= {s + x for s in sums}
        room = rng.randint(1, 60)
        got = packing.fullest(counts, room)
        assert sum(got) == max(s for s in sums if s <= room)
        assert all(got.count(k) <= counts[k] for k in got)


def test_repeated_and_empty(spark, docs):
    assert packing.pack(docs().where("false")).collect() == []
    rows = packing.pack(docs((1, "a b"), (1, "a b"), (None, "a b"))).collect()
    assert len(rows) == 3 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 3
