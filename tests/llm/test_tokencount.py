import json
import random

from tessella.llm import bpe, tokencount
from tessella.llm.bpe import tokenizer, vocabulary

PATH = vocabulary("word_bpe_49k.json")
TEXTS = [None, "", " ", "Hello  World", "don't we'll 's x's", "É é é É ẛ̣", "<|endoftext|> a<|startoftext|>b <|endoftext|>", "a\x1cb \x85 c　d e", "ΑΣ ΑΣΑ Σ", "12 345 x1y2 #!? 日本語 😀😀 a", "tab\tnew\nline \n end", "İstanbul ŉ ǰ ﬁ"]


def plain(text):
    return len(tokenizer(PATH).encode(text or "", add_special_tokens=False).ids)


def random_texts(n, k):
    rng = random.Random(n)
    alphabet = ["a", "b", "é", "é", "1", "'s", "!", " ", " ", "\n", "the", "tion", "<|endoftext|>", " ", "Ü", "日"]
    return ["".join(rng.choices(alphabet, k=k)) for _ in range(n)]


def test_counts_are_the_librarys():
    texts = TEXTS + random_texts(300, 40)
    assert tokencount.count_tokens(texts, PATH) == [plain(t) for t in texts]


def test_spliced_ids_are_the_librarys():
    for t in random_texts(60, 400) + ["a" * 3000, "a b " * 900, "x" * 500 + " y " + "z" * 700]:
        want = tokenizer(PATH).encode(t, add_special_tokens=False).ids
        for chunk, overlap in ((64, 8), (50, 2), (200, 40)):
            got, seen = tokencount.encode_spliced(t, PATH, chunk, overlap)
            assert got == want
    assert seen["chunks"] > 1


def test_overlaps_widen_until_a_boundary_is_found():
    got, seen = tokencount.encode_spliced("one two three " + "x" * 300 + " four five " * 40, PATH, 100, 4)
    assert seen["widened"] > 0 and seen["spliced"] > 0
    assert len(got) == plain("one two three " + "x" * 300 + " four five " * 40)


def test_query_columns(spark, docs):
    got = {r["doc_id"]: r for r in tokencount.token_counts(docs(*TEXTS, "w " * 3000), chunk=1000, overlap=50).collect()}
    for i, t in enumerate([*TEXTS, "w " * 3000]):
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((t or "").encode()), plain(t), plain(t) > 2048)
    assert len(tokencount.token_counts(docs((1, "a"), (1, "a"), (None, "b"))).collect()) == 3
    assert tokencount.token_counts(docs().where("false")).collect() == []


def test_ranks_give_the_librarys_ids_and_places():
    """Latin text is encoded by ranks, without the library's normal forms and offsets, that took most of the time."""
    ranks, library = bpe.word_ends(PATH), tokenizer(PATH)
    rng = random.Random(4)
    chars = [c for c in map(chr, range(0x250)) if ranks.takes(c)]
    assert len(chars) > 300 and not any(ranks.takes(t) for t in ("İ", "a\x85", "a\xa0b", "日", "é", "<|endoftext|>", "\x00"))
    texts = ["", " \n", *chars, *("".join(rng.choices(chars, k=200)) for _ in range(300)), "I'll DON'T 's'S x'RE ''ve", "aaaa aaaaaaa ÀÉÎÕÜ\nſŉ 12½ ---"]
    for t in texts:
        want = library.encode(t, add_special_tokens=False)
        assert ranks.encode(t) == (want.ids, [a for a, _ in want.offsets])
    assert ranks.counts(texts) == list(map(plain, texts))
    assert ranks.encode("a" * 300) is None and ranks.counts(["b", "a" * 300]) is None


def test_every_entry_by_itself_is_one_token():
    """What bpe.WordEnds relies on."""
    from tokenizers import Tokenizer

    vocab = tokenizer(PATH).get_vocab(with_added_tokens=False)
    spec = json.loads(tokenizer(PATH).to_str()) | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}
    ended = [t for t in vocab if t.endswith("</w>") and len(t) > 4]
    got = Tokenizer.from_str(json.dumps(spec)).encode(" ".join(t[:-4] for t in ended)).ids
    assert got == [vocab[t] for t in ended]
    spec["model"]["end_of_word_suffix"] = None
    inner = [t for t in vocab if t not in ended and not t.startswith("<|")]
    assert Tokenizer.from_str(json.dumps(spec)).encode(" ".join(inner)).ids == [vocab[t] for t in inner]


def test_words_do_not_meet_the_library(monkeypatch):
    monkeypatch.setattr(tokencount, "_CACHES", {})
    monkeypatch.setattr(tokencount, "tokenizer", lambda path: 1 / 0)
    assert tokencount.count_tokens(["Two words, née", "x " * 9000], PATH) == [5, 9000]
