import hashlib
import random

from tessella.llm import edits


def plain_walk(text):
    """The walk step by step: at step j it stays or moves by the bit of (class, j)."""
    table = edits._walk_table()
    codes = edits._codes(text)
    where, i, j, stay = [], 0, 0, None
    for i, c in enumerate(edits._classes(codes)):
        stay = table[c][j % edits.PERIOD]
        where += [i] * stay
        j += stay
    return where


def plain_fingerprint(text):
    """The definition, step by step: a random bit for each class of character and step, a digit for each sampled step."""
    import numpy as np

    bits = np.random.default_rng(edits.SEED).integers(0, 2, (256, edits.PERIOD))
    rng = np.random.default_rng(edits.SEED + 1)
    steps, low = list(range(edits.SAMPLES)), edits.SAMPLES
    for _ in range(edits.OCTAVES - 5):
        steps += sorted(rng.integers(low, 2 * low, edits.SAMPLES).tolist())
        low *= 2
    codes = [ord(c) for c in text]
    out, at, j = [], 0, 0
    for step in steps:
        while at < len(codes) and j < step:
            kind = (codes[at] * 2654435761 & 0xFFFFFFFF) >> 24
            at += bits[kind][j % edits.PERIOD] == 1 or j % edits.PERIOD == edits.PERIOD - 1
            j += 1
        if at >= len(codes):
            break
        h = 0
        for k in range(edits.GRAM):
            h = ((h ^ (codes[at + k] if at + k < len(codes) else 0)) * 0x01000193 & 0xFFFFFFFF) + k & 0xFFFFFFFF
        h ^= h >> 15
        out.append("0123456789abcdef"[(h * 0x85EBCA6B & 0xFFFFFFFF) >> 28])
    return "".join(out)


def plain_likeness(a, b):
    if not a or not b:
        return 1.0 if a == b else 0.0
    weight = lambda i: 2 ** max(0, i // edits.SAMPLES - 1)
    agree = sum(weight(i) for i, (x, y) in enumerate(zip(a, b)) if x == y) / sum(map(weight, range(max(len(a), len(b)))))
    return max(0.0, (agree - 1 / 16) / (15 / 16))


def test_fingerprints_and_likeness_are_the_definition():
    rng = random.Random(5)
    texts = ["", "a", "ab", "é😀\n"] + ["".join(rng.choices("abcdef tion😀é", k=n)) for n in (10, 33, 64, 65, 500, 6000)]
    prints = [plain_fingerprint(t) for t in texts]
    assert [edits.fingerprint(t) for t in texts] == prints
    assert all(abs(edits.likeness(a, b) - plain_likeness(a, b)) < 1e-12 for a in prints for b in prints)


def test_recall_of_the_bands_against_all_pairs(spark):
    """Texts of all lengths with edits spread over them: of all pairs that are alike, most meet in a band."""
    rng = random.Random(13)
    prints = []
    for _ in range(120):
        n = rng.randrange(60, 6000)
        base = "".join(rng.choices("abcdefgh tionerlmk", k=n))
        for share in (0, 0.002, 0.01, 0.1):
            t = list(base)
            for _ in range(int(n * min(share, 0.02))):
                t[rng.randrange(len(t))] = "x"
            prints.append(edits.fingerprint("".join(t) + "".join(rng.choices("abcdefgh", k=int(n * share)))))
    bands = [set(edits.band_keys(p)) for p in prints]
    alike = [(i, j) for i in range(len(prints)) for j in range(i) if abs(i - j) < 4 and edits.likeness(prints[i], prints[j]) >= edits.NEAR]
    met = sum(bool(bands[i] & bands[j]) for i, j in alike)
    assert len(alike) > 100 and met / len(alike) > 0.97


def test_links_join_what_all_pairs_join():
    import numpy as np

    rng = random.Random(21)
    prints = []
    for n in (40, 300, 2500):
        base = "".join(rng.choices("abcdefgh tion", k=n))
        for _ in range(25):
            t = list(base)
            for _ in range(rng.choice([0, 1, n // 50, n // 8])):
                t[rng.randrange(n)] = rng.choice("xyz")
            prints.append(edits.fingerprint("".join(t)))
    rng.shuffle(prints)
    for block in (np.zeros(len(prints), int), np.array([rng.randrange(2) for _ in prints])):
        root, links = list(range(len(prints))), list(zip(*edits._links(prints, 0.8, block)))
        two = block.min() != block.max()
        pairs = [(i, j) for i in range(len(prints)) for j in range(i) if (not two or block[i] != block[j]) and edits.likeness(prints[i], prints[j]) >= 0.8]
        assert set(links) <= set(pairs) and len(links) < len(pairs)
        roots = []
        for edges in (links, pairs):
            root = list(range(len(prints)))
            for _ in prints:
                for i, j in edges:
                    root[i] = root[j] = min(root[i], root[j])
            roots.append(root)
        assert roots[0] == roots[1]


def test_samples_are_read_off_the_walk():
    text = "".join(random.Random(3).choices("abc de", k=500))
    where = plain_walk(text)
    samples = [s for s in edits._sample_steps().tolist() if s < len(where)]
    assert len(edits.fingerprint(text)) == len(samples)
    # equal grams under the pointer give equal digits
    seen = {}
    for digit, s in zip(edits.fingerprint(text), samples):
        gram = (text + "\0" * 4)[where[s] : where[s] + 4]
        assert seen.setdefault(gram, digit) == digit
    assert len(set(edits.fingerprint(text))) > 8


def test_small_edits_stay_near_and_others_far():
    rng = random.Random(4)
    near, far = [], []
    for n in (200, 2000, 20000):
        for _ in range(15):
            a = "".join(rng.choices("abcdefgh tioner", k=n))
            b = list(a)
            for _ in range(max(1, n // 1000)):
                i = rng.randrange(len(b))
                b[i : i + 1] = rng.choice([[], ["x"], ["x", "y"]])
            near.append(edits.likeness(edits.fingerprint(a), edits.fingerprint("".join(b))))
            far.append(edits.likeness(edits.fingerprint(a), edits.fingerprint("".join(rng.choices("abcdefgh tioner", k=n)))))
    assert sum(near) / len(near) > 0.6 > 0.2 > sum(far) / len(far)
    assert sum(a > b for a, b in zip(near, far)) >= len(near) - 1


def plain_rows(texts):
    order = sorted(texts, reverse=True)
    out = {}
    for n, i in enumerate(order):
        text, other = texts[i] or "", texts[order[(n + 1) % len(order)]] or ""
        k = len(text) // 3
        edited = text[: len(text) - k] + other[:k]
        a, b, c = map(edits.fingerprint, (text, edited, other))
        out[i] = (i, len(text), hashlib.sha256(edited.encode()).hexdigest(), a, b, edits.likeness(a, b), edits.likeness(a, c))
    return out


def test_neighbours_against_brute_force(spark, docs, monkeypatch):
    rng = random.Random(6)
    texts = {i * 3: "".join(rng.choices("abé 😀\n", k=rng.choice([0, 1, 2, 50, 400]))) for i in range(60)} | {181: None}
    for rows_a_range in (2000, 7, 1):
        monkeypatch.setattr(edits, "ROWS_A_RANGE", rows_a_range)
        got = {r["doc_id"]: tuple(r) for r in edits.neighbours(docs(*texts.items())).collect()}
        assert got == plain_rows(texts)


def test_single_empty_repeated(spark, docs):
    assert edits.neighbours(docs().where("false")).collect() == []
    one = edits.neighbours(docs((4, "abcdef"))).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and one["near_next"] == 1.0
    rows = edits.neighbours(docs((1, "abc"), (1, "abc"), (None, "xyz"), (2, "qqq"))).collect()
    assert len(rows) == 4 and rows[0]["doc_id"] is not None
    assert edits.likeness("", "") == 1.0 and edits.likeness("", "ab") == 0.0


def test_links_of_bands_against_all_pairs(spark):
    """A chain of edits: neighbours are alike, ends are not; and a group of copies in one band, in small blocks."""
    rng = random.Random(11)
    chain = ["".join(rng.choices("abcdefgh tionerlmk", k=2000))]
    for n in range(7):
        t = list(chain[-1])
        at = 200 + 230 * n
        t[at : at + 40] = rng.choices("xyzwv", k=40)
        chain.append("".join(t))
    prints = [edits.fingerprint(t) for t in chain]
    df = spark.createDataFrame(list(enumerate(prints)) + [(100, prints[0]), (None, prints[1]), (None, "")], "doc_id long, fingerprint string")
    bands = [set(edits.band_keys(p)) for p in prints]
    root = list(range(len(prints)))
    for _ in prints:
        for i in range(len(prints)):
            for j in range(i):
                if bands[i] & bands[j] and edits.likeness(prints[i], prints[j]) >= 0.8:
                    root[i] = root[j] = min(root[i], root[j])
    for block in (512, 2):
        got = edits.near_duplicates(df, block=block).collect()
        told = {r["doc_id"]: r["class_id"] for r in got if r["doc_id"] is not None}
        assert told == dict(enumerate(root)) | {100: 0}
        assert sorted(str(r["class_id"]) for r in got if r["doc_id"] is None) == sorted([str(root[1]), "None"])


def test_groups(spark, docs):
    rng = random.Random(8)
    texts = ["".join(rng.choices("abcdefgh tionerlmk", k=1500)) for _ in range(12)]
    copies = [t[:1400] + "changed here" + t[1410:] for t in texts[:6]] + texts[:3]
    rows = docs(*texts, *copies)
    prints = spark.createDataFrame([(r["doc_id"], edits.fingerprint(r["text"])) for r in rows.collect()], "doc_id long, fingerprint string")
    got = {r["doc_id"]: r["class_id"] for r in edits.near_duplicates(prints).collect()}
    want = {i: i for i in range(12)} | {12 + i: i for i in range(6)} | {18 + i: i for i in range(3)}
    assert got == want
