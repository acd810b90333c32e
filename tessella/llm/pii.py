"""Personal data by bootstrapped contextual extraction.

Base patterns find emails, IPv4 addresses, payment cards and phone numbers. They are the seeds: the words around them
induce lexical patterns. Looser candidates (written-out addresses, numbers without the base form) share those
patterns. Spark scores the pattern-instance graph in rounds: a pattern's confidence for a kind is the trusted part of
its distinct instances that are labelled: trusted ones of the kind, or of another kind, which contradict it. Candidates
that no round has labelled yet are no evidence either way. An instance's confidence is 1 - prod(1 - confidence of its
patterns), and instances above a threshold are trusted in the next round. Patterns that end above a threshold with enough trusted instances turn the
candidates they surround into spans. Base spans always stay; new ones never overlap them.

Text is read once: one row a document with its spans and candidates is cut into the shared folder and everything
else works on that.

Defined cases: null text is empty text and has no spans (redact() leaves it null); repeated rows give repeated results;
offsets are code points. A text of any length is searched whole, in time that grows with its length; a span's context is
the words in the 48 characters before it and behind it. Of loose candidates that overlap, the first by kind, then place,
is one; a candidate in trusted contexts of its kind is a span. An empty table gives no rows. Other columns, whatever
their names, are not read, and redact() hands them on.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import cut, drop_cut, unpacked, whole_row

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 12  # at most; scoring ends earlier where a round trusts what the last one did
MIN_TRUST = 0.9  # of a pattern's distinct labelled instances, for it to extract; and of an instance, to be trusted
MIN_SUPPORT = 5  # distinct trusted instances

# Possessive repeats and the look-behind change no match; they keep long runs of letters or digits from taking quadratic time.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_DIGITS = re.compile(r"[^0-9]+")
#: Looser forms by kind; what they find counts only in a trusted context.
_LOOSE = (
    (0, re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[(\[{]?(?i:at|@)[)\]}]? ?[A-Za-z0-9-]{1,63} ?[(\[{]?(?i:dot|\.)[)\]}]? ?[A-Za-z]{2,24}\b"), re.compile(r"(?i)[(\[{](?:at|@)|\bat\b.*\bdot\b")),
    (1, re.compile(r"(?<![0-9A-Fa-f:.])[0-9A-Fa-f]{0,4}(?::{1,2}[0-9A-Fa-f]{1,4}){3,7}(?![0-9A-Fa-f:])"), None),
    (2, re.compile(r"(?<![0-9])[0-9](?:[\x20./-]?[0-9]){11,18}(?![0-9])"), None),
    (3, re.compile(r"(?<![0-9+])\(?[0-9]{2,5}\)?[\x20./-]?[0-9]{2,5}(?:[\x20./-]?[0-9]{2,5}){1,3}(?![0-9])"), None),
)
#: Each form that the first pattern accepts has one of these in lower case.
_WRITTEN_OUT = ("dot", "(at", "[at", "{at", "(@", "[@", "{@")
_AROUND = 48
_WORD = re.compile(r"[^\W_]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the base patterns: leftmost, non-overlapping within a kind."""
    out = []
    end = 0
    for m in _DOMAIN.finditer(text):
        # the pattern's start is the far end of the run of local-part characters before the @, or where the last match ended
        start = m.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            out.append((0, start, m.end()))
            end = m.end()
    if not _DIGIT.search(text):
        return out
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(n := p.lstrip("0")) <= 3 and int(n or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = _DIGITS.sub("", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_DIGITS.sub("", m[0])) <= 15]
    return out


def loose_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates of the looser forms that overlap no base span nor each other."""
    taken = bytearray(len(text))
    for _, s, e in base:
        taken[s:e] = b"\x01" * (e - s)
    out, lower = [], text.lower()
    for kind, pattern, needs in _LOOSE:
        if kind == 0 and not any(w in lower for w in _WRITTEN_OUT):
            continue
        if kind == 1 and text.count(":") < 3:
            continue
        for m in pattern.finditer(text):
            if needs is not None and not needs.search(m[0]):
                continue
            if kind == 3 and not 7 <= len(_DIGITS.sub("", m[0])) <= 15:
                continue
            s, e = m.span()
            if not any(taken[s:e]):
                out.append((kind, s, e))
                taken[s:e] = b"\x01" * (e - s)
    return out


def contexts(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns: the two words before; the word before and the word behind."""
    before = [w.lower() for w in _WORD.findall(text[max(0, start - _AROUND) : start])][-2:]
    behind = [w.lower() for w in _WORD.findall(text[end : end + _AROUND])][:1]
    found = []
    if len(before) == 2:
        found.append(f"{before[0]} {before[1]} _")
    if before and behind:
        found.append(f"{before[-1]} _ {behind[0]}")
    return found


def scan(docs: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """One row a document: uid, doc_id, content (a hash of the text), spans, and marks: every base or loose span with its patterns."""
    span = "struct<kind:int,begin:int,finish:int>"
    mark = "struct<kind:int,begin:int,finish:int,base:boolean,instance:string,patterns:array<string>>"

    @F.pandas_udf(f"base array<{span}>, marks array<{mark}>")
    def find(texts: pd.Series) -> pd.DataFrame:
        base_all, marks_all = [], []
        for text in texts:
            text = text or ""
            base = base_spans(text)
            loose = loose_spans(text, base)
            marks = []
            for is_base, spans in ((True, base), (False, loose)):
                for k, s, e in spans:
                    name = text[s:e].lower() if k == 0 else _DIGITS.sub("", text[s:e]) if k else text[s:e]
                    marks.append({"kind": k, "begin": s, "finish": e, "base": is_base, "instance": f"{k}:{name}", "patterns": contexts(text, s, e)})
            base_all.append([{"kind": k, "begin": s, "finish": e} for k, s, e in base])
            marks_all.append(marks)
        return pd.DataFrame({"base": base_all, "marks": marks_all})

    text = F.col(f"`{text_col}`")
    found = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(text).alias("content"), find(text).alias("f"))
    return cut(found.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "content", "f.base", "f.marks"), "pii-spans")


def trusted_patterns(scanned: DataFrame, *, rounds: int = ROUNDS, min_trust: float = MIN_TRUST, min_support: int = MIN_SUPPORT) -> DataFrame:
    """(kind, pattern) that extract, after at most `rounds` of scoring the graph of patterns and instances."""
    marks = scanned.where(F.size("marks") > 0).select(F.explode("marks").alias("m")).select("m.*")
    edges = cut(marks.select("kind", "base", "instance", F.explode("patterns").alias("pattern")).groupBy("kind", "pattern", "instance").agg(F.max("base").alias("base")), "pii-edges")
    trust = edges.groupBy("kind", "instance").agg(F.max("base").cast("double").alias("trust"))
    scored = state = None
    for _ in range(rounds):
        trust = cut(trust.where(F.col("trust") >= min_trust), "pii-trust")
        before, state = state, tuple(trust.agg(F.count("*"), F.round(F.sum("trust"), 6), F.bit_xor(F.xxhash64("kind", "instance"))).first())
        if state == before:
            drop_cut(trust)
            break
        known = edges.join(trust, ["kind", "instance"], "left").withColumn("trust", F.coalesce("trust", F.lit(0.0)))
        sums = known.groupBy("kind", "pattern").agg(F.sum("trust").alias("sum"), F.sum(F.when(F.col("trust") > 0, 1).otherwise(0)).alias("support"))
        # a tenth of a contradicting instance more than seen: a pattern met once proves nothing
        labelled = F.sum("support").over(Window.partitionBy("pattern"))  # a row a kind
        if scored is not None:
            drop_cut(scored)
        scored = cut(sums.select("kind", "pattern", (F.col("sum") / (labelled + 0.1)).alias("score"), "support"), "pii-patterns")
        drop_cut(trust)
        good = scored.where(F.col("support") >= min_support)
        doubt = F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-9))))
        reached = edges.join(good, ["kind", "pattern"]).groupBy("kind", "instance").agg((1 - F.exp(doubt)).alias("trust"))
        seeds = edges.where("base").select("kind", "instance", F.lit(1.0).alias("trust"))
        trust = reached.union(seeds).groupBy("kind", "instance").agg(F.max("trust").alias("trust"))
    return scored.where((F.col("score") >= min_trust) & (F.col("support") >= min_support)).select("kind", "pattern")


def discovered(scanned: DataFrame, patterns: DataFrame) -> DataFrame:
    """(uid, more): the candidates in a trusted context, as an array of spans."""
    loose = scanned.where(F.exists("marks", lambda m: ~m["base"])).select("uid", F.explode(F.filter("marks", lambda m: ~m["base"])).alias("m")).select("uid", "m.kind", "m.begin", "m.finish", F.explode("m.patterns").alias("pattern"))
    hit = loose.join(patterns, ["kind", "pattern"], "left_semi").select("uid", "kind", "begin", "finish").distinct()
    return hit.groupBy("uid").agg(F.collect_list(F.struct("kind", "begin", "finish")).alias("more"))


def _text_of(spans):
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["begin"].cast("string"), s["finish"].cast("string"))
    return F.array_join(F.transform(F.array_sort(spans), one), ",")


def find_personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row a document: doc_id, counts of base spans, their digest, and all spans as text."""
    scanned = scan(docs, id_col=id_col, text_col=text_col)
    more = discovered(scanned, trusted_patterns(scanned, **how))
    none = F.array().cast("array<struct<kind:int,begin:int,finish:int>>")
    every = scanned.select("uid", "doc_id", "base").join(more, "uid", "left").withColumn("more", F.coalesce("more", none))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return every.select("doc_id", *[count(k) for k in range(4)], F.sha2(_text_of(F.col("base")).cast("binary"), 256).alias("base_sha256"), _text_of(F.concat("base", "more")).alias("spans"), F.size("more").cast("long").alias("n_discovered"))


def mask(text: str | None, more) -> str | None:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one, named by the first."""
    if text is None:
        return None
    spans = base_spans(text) + [(m["kind"], m["begin"], m["finish"]) for m in (more if more is not None else ())]
    if not spans:
        return text
    out, at = [], 0
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2], x[0])):
        if s >= at:
            out += [text[at:s], f"<{KINDS[k].upper()}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with personal data replaced in the text; rows and all other columns stay, n_chars follows the text if docs has it."""
    scanned = scan(docs, id_col=id_col, text_col=text_col)
    more = cut(discovered(scanned, trusted_patterns(scanned, **how)), "pii-more")

    @F.pandas_udf("string")
    def masked(texts: pd.Series, extra: pd.Series) -> pd.Series:
        return pd.Series([mask(t, m) for t, m in zip(texts, extra)], dtype=object)

    @F.pandas_udf("string")
    def masked_base(texts: pd.Series) -> pd.Series:
        return pd.Series([mask(t, None) for t in texts], dtype=object)

    text = F.col(f"`{text_col}`")
    rows = docs.select(whole_row(docs), F.col(f"`{id_col}`").alias("id"), text.alias("text"), F.xxhash64(text).alias("hash"))
    if more.isEmpty():  # nothing was discovered: there is nothing to join
        done = rows.select("row", masked_base("text").alias("masked"))
    else:
        where = scanned.select("uid", "doc_id", "content").join(more, "uid").select("doc_id", "content", "more").dropDuplicates(["doc_id", "content"])
        joined = rows.join(where, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("content")), "left")
        done = joined.select("row", masked("text", "more").alias("masked"))
    instead = {"n_chars": F.length("masked").cast("long")} if "n_chars" in docs.columns else {}
    return unpacked(done, docs.columns, **{**instead, text_col: F.col("masked")})
