import hashlib
import re

from tessella.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": lambda: True,
                "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")),
                "card": lambda: 16 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0,
                "phone": lambda: 8 <= len(digits) <= 15,
            }[kind]()
            if ok:
                out.append((k, m.start(), m.end()))
    return out


def test_base_spans_by_definition():
    import random

    rng = random.Random(2)
    texts = ["a@b.c@d.e", "@b.c x@y", "a@b a@b.c. q@-.-", "1.2.3.4.5 256.1.1.1 01.002.3.4 1.2.3", "4111 1111-1111 1111", "4111111111111111 5500005555555559", "+1 (988) 555-2485 +49-30 123", "+1234567 +12345678+9999999999", "ä@b.de é a.b%c@x-y.z1"]
    texts += ["".join(rng.choices("a1.@+- (4", k=40)) for _ in range(3000)]
    texts += ["".join(rng.choices("0123456789 -", k=60)) for _ in range(500)]
    for t in texts:
        assert pii.base_spans(t) == plain(t), t


def test_long_runs_take_linear_time():
    for t in ("1" * 200_000, "1." * 100_000, "a" * 200_000 + "@", "@" * 200_000, "+1 " * 50_000, "a.b@" * 50_000):
        pii.base_spans(t)
        pii.loose_spans(t, [])


def test_written_out_forms_alone_in_a_text():
    forms = [f"jane{s}{o}{at}{c}{s}example{t}com" for at in ("at", "@", "AT", "At") for o, c in ("()", "[]", "{}") for s in ("", " ") for t in (".", " . ", "[.]", "(dot)", " DOT ")]
    forms += [f"jane {at} example{t}com" for at in ("at", "AT") for t in (" dot ", " DOT ", "(dot)", "[Dot]", "{dot}", " dot] ", "-dot ")]
    for f in forms:
        text = f"ask {f}"
        found = pii.loose_spans(text, pii.base_spans(text))
        assert [text[s:e] for k, s, e in found if k == 0] == [f], f


def rows(spark, docs, *texts, **how):
    return sorted(pii.find_personal_data(docs(*texts), **how).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"]))


def test_counts_and_digest(spark, docs):
    got = rows(spark, docs, "mail a@b.cd or 1.2.3.4", None, "", "nothing", "😀 a@b.cd")
    assert (got[0]["n_email"], got[0]["n_ip"], got[0]["n_card"], got[0]["n_phone"]) == (1, 1, 0, 0)
    assert got[0]["spans"] == "email:5:11,ip:15:22" and got[0]["base_sha256"] == hashlib.sha256(b"email:5:11,ip:15:22").hexdigest()
    assert got[1]["spans"] == got[2]["spans"] == got[3]["spans"] == "" and got[1]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[4]["spans"] == "email:2:8"


def test_contexts_discover_what_the_base_misses(spark, docs):
    seeds = [f"please call hotline +49 30 55501{i:02d} today" for i in range(12)]
    noise = [f"order number 030-555-{i:04d} shipped" for i in range(12)]
    got = rows(spark, docs, *seeds, "please call hotline 030-555-0199 today", *noise)
    assert got[12]["n_phone"] == 0 and got[12]["spans"].startswith("phone:20:") and got[12]["n_discovered"] == 1
    assert all(r["n_discovered"] == 0 for i, r in enumerate(got) if i != 12)
    masked = {r["doc_id"]: r["text"] for r in pii.redact(docs(*seeds, "please call hotline 030-555-0199 today", *noise)).collect()}
    assert masked[12] == masked[0] == "please call hotline <PHONE> today" and masked[13] == noise[0]


def test_unseen_candidates_are_no_counter_evidence(spark, docs):
    texts, unseen = [], set()
    for words, behind, n, more in (("please call hotline", "today", 12, 6), ("reach our desk", "", 12, 12), ("ring the office", "", 100, 12)):
        texts += [f"{words} +49 30 {len(words)}{i:05d} {behind or f'w{i}'}" for i in range(n)]
        unseen |= set(range(len(texts), len(texts) + more))
        texts += [f"{words} 030-{len(words)}5-{i:04d} {behind or f'v{i}'}" for i in range(more)]
    got = rows(spark, docs, *texts)
    assert {r["doc_id"] for r in got if r["n_discovered"]} == unseen


def test_instances_of_another_kind_contradict(spark, docs):
    texts = [f"my contact is a{i}@b.cd w{i}" for i in range(6)] + [f"my contact is +49 30 55501{i:02d} v{i}" for i in range(6)] + ["my contact is 030-555-0199 now"]
    assert rows(spark, docs, *texts)[12]["n_discovered"] == 0


def plain_discovery(texts, rounds=50, min_trust=0.9, min_support=5):
    """The graph of patterns and instances, scored with dictionaries until nothing changes: spans by text."""
    found = []  # (text, kind, start, end, base, instance, patterns)
    for n, text in enumerate(texts):
        base = plain(text)
        for is_base, spans in ((True, base), (False, pii.loose_spans(text, base))):
            for k, s, e in spans:
                name = text[s:e].lower() if k == 0 else re.sub("[^0-9]", "", text[s:e])
                before = re.findall(r"[^\W_]+", text[max(0, s - 48) : s].lower())[-2:]
                behind = re.findall(r"[^\W_]+", text[e : e + 48].lower())[:1]
                patterns = [" ".join([*before, "_"])] * (len(before) == 2) + [f"{before[-1]} _ {behind[0]}" for _ in range(1) if before and behind]
                found.append((n, k, s, e, is_base, name, patterns))
    edges = {(k, p, i) for _, k, _, _, _, i, ps in found for p in ps}
    seeds = {(k, i) for _, k, _, _, base, i, ps in found if base and ps}
    trust = {x: 1.0 for x in seeds}
    for _ in range(rounds):
        trust = {x: t for x, t in trust.items() if t >= min_trust}
        labelled, total, support = {}, {}, {}
        for k, p, i in edges:
            if (k, i) in trust:
                labelled[p] = labelled.get(p, 0) + 1
                total[k, p] = total.get((k, p), 0) + trust[k, i]
                support[k, p] = support.get((k, p), 0) + 1
        score = {(k, p): t / (labelled[p] + 0.1) for (k, p), t in total.items() if support[k, p] >= min_support}
        new = {x: 1.0 for x in seeds}
        doubt = {}
        for k, p, i in edges:
            if (k, p) in score:
                doubt[k, i] = doubt.get((k, i), 1.0) * (1 - score[k, p])
        for x, d in doubt.items():
            new[x] = max(new.get(x, 0), 1 - d)
        if {x: round(t, 9) for x, t in new.items() if t >= min_trust} == {x: round(t, 9) for x, t in trust.items()}:
            break
        trust = new
    good = {x for x, t in score.items() if t >= min_trust}
    out = {n: [] for n in range(len(texts))}
    for n, k, s, e, is_base, _, ps in found:
        if is_base or any((k, p) in good for p in ps):
            out[n].append((k, s, e))
    return [",".join(f"{list(PATTERNS)[k]}:{s}:{e}" for k, s, e in sorted(set(out[n]))) for n in range(len(texts))]


def test_discovery_equals_a_plain_graph_scorer(spark, docs):
    import random

    rng = random.Random(12)
    openings = ["please call hotline", "reach me under", "card on file", "paid with number", "server lives at", "mail goes to", "ask for it", "the of"]
    own = {o: rng.choice(["+phone", "card", "ip", "email"]) for o in openings}
    make = {
        "+phone": lambda: f"+49 30 {rng.randrange(10**7):07d}",
        "phone": lambda: f"030-{rng.randrange(10**3):03d}-{rng.randrange(10**4):04d}",
        "card": lambda: rng.choice(["4111 1111-1111 1111", "5500005555555559", "4012888888881881", "378282246310005000", "6011000990139424"]),
        "no card": lambda: f"{rng.randrange(10**15, 10**16)}",
        "ip": lambda: f"10.{rng.randrange(256)}.3.4",
        "email": lambda: f"u{rng.randrange(99)}@mail.example",
        "at": lambda: f"u{rng.randrange(99)} (at) mail dot example",
    }
    loose = {"+phone": "phone", "card": "no card", "ip": "ip", "email": "at"}
    texts = []
    for _ in range(260):
        o = rng.choice(openings)
        kind = own[o] if rng.random() < 0.6 else loose[own[o]] if rng.random() < 0.9 else rng.choice(list(make))
        texts.append(f"{rng.choice(['well', 'so'])} {o} {make[kind]()} {rng.choice(['today', 'now', 'w%d' % rng.randrange(50)])}")
    want = plain_discovery(texts)
    got = rows(spark, docs, *texts)
    assert [r["spans"] for r in got] == want
    assert sum(r["n_discovered"] for r in got) > 20


def test_very_long_text_and_many_marks(spark, docs):
    text = "call +49 30 5550199 now 030-555-0199 or 1234 5678 9012 3456, " * 20_000
    r = rows(spark, docs, text)[0]
    assert r["n_phone"] == 20_000 and r["spans"].count(",") >= 19_999


def test_redaction_keeps_rows_and_columns(spark, docs):
    df = docs((1, "a@b.cd x"), (1, "a@b.cd x"), (None, None), (2, "clean"))
    out = pii.redact(df)
    assert out.columns == df.columns
    assert sorted((str(r["doc_id"]), str(r["text"]), r["n_chars"]) for r in out.collect()) == [("1", "<EMAIL> x", 9), ("1", "<EMAIL> x", 9), ("2", "clean", 5), ("None", "None", None)]


def test_empty(spark, docs):
    assert pii.find_personal_data(docs().where("false")).collect() == []
    assert pii.redact(docs().where("false")).collect() == []
