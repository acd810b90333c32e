"""Full-text search: web-search style queries, all terms required, ranked by cover density.

A query is alternatives (separated by `or`) of required terms, quoted phrases and terms or phrases that must not
occur (behind -). The rank adds, for every shortest span that holds all of an alternative's terms, 0.1 / (1 + words in
it that are no terms). Analysers lower-case words; those of a language drop its stop words and stem the others.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.sizes import small
from tessella.functions.stem import STEMMERS
from tessella.operators.search import check_policy, ranked

ANALYSERS = ("simple", "english", "portuguese")
WEIGHT = 0.1
# The words that the language's analyser leaves out.
STOP_WORDS = {
    "english": frozenset("""i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those
        am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below to from up
        down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now""".split()),
    "portuguese": frozenset("""de a o que e do da em um para com não uma os no se na por mais as dos como mas ao ele das à seu sua ou quando muito nos já eu também só pelo pela até isso ela entre depois sem mesmo aos seus
        quem nas me esse eles você essa num nem suas meu às minha numa pelos elas qual nós lhe deles essas esses pelas este dele tu te vocês vos lhes meus minhas teu tua teus tuas nosso nossa nossos nossas dela delas esta
        estes estas aquele aquela aqueles aquelas isto aquilo estou está estamos estão estive esteve estivemos estiveram estava estávamos estavam fui foi fomos foram era éramos eram seja sejamos sejam fosse fôssemos fossem
        for formos forem serei será seremos serão seria seríamos seriam tenho tem temos têm tinha tínhamos tinham tive teve tivemos tiveram tenha tenhamos tenham""".split()),
}
_WORD = re.compile(r"\w+(?:[-.]\w+)*")
_PART = re.compile(r'(-?)"([^"]*)"|(-?)(\S+)')


@lru_cache(8)
def stop_words(analyser: str) -> frozenset[str]:
    if analyser not in ANALYSERS:
        raise ValueError(f"analyser must be one of {', '.join(ANALYSERS)}")
    return STOP_WORDS.get(analyser, frozenset())


def lexemes(text: str, analyser: str) -> dict[str, list[int]]:
    """Positions of the lexemes of a text; stop words count as positions and are not kept."""
    stop, stem = stop_words(analyser), STEMMERS[analyser]
    found: dict[str, list[int]] = {}
    for n, w in enumerate(_WORD.findall(text.lower())):
        if w not in stop:
            found.setdefault(stem(w), []).append(n)
    return found


def parse_query(text: str, analyser: str) -> list[tuple[list[list[str]], list[list[str]]]]:
    """Alternatives of (required, forbidden) phrases; a term is a phrase of one word."""
    stop, stem = stop_words(analyser), STEMMERS[analyser]
    out: list[tuple[list[list[str]], list[list[str]]]] = [([], [])]
    for minus, phrase, minus_word, word in _PART.findall(text):
        if word.lower() == "or" and not minus_word:
            out.append(([], []))
            continue
        words = [stem(w) for w in _WORD.findall((phrase or word).lower()) if w not in stop]
        if words:
            out[-1][bool(minus or minus_word)].append(words)
    return [a for a in out if a[0]]


def _phrase_at(phrase: list[str], places: dict[str, list[int]]) -> list[int]:
    later = [set(places.get(w, ())) for w in phrase[1:]]
    return [p for p in places.get(phrase[0], ()) if all(p + k in s for k, s in enumerate(later, 1))]


def cover_density(places: list[list[int]]) -> float:
    """Of the positions of each required term; 0 if one has none."""
    events = sorted((p, t) for t, ps in enumerate(places) for p in ps)
    rank, start = 0.0, 0
    while start < len(events):
        seen: set[int] = set()
        end = next((i for i in range(start, len(events)) if seen.add(events[i][1]) or len(seen) == len(places)), None)
        if end is None:
            break
        seen, begin = set(), end
        while True:  # the latest start of a span that ends here
            seen.add(events[begin][1])
            if len(seen) == len(places):
                break
            begin -= 1
        noise = events[end][0] - events[begin][0] - (end - begin)
        rank += WEIGHT / (1 + max(0, noise))
        start = begin + 1
    return rank


def score(query: list[tuple[list[list[str]], list[list[str]]]], places: dict[str, list[int]]) -> float:
    best = 0.0
    for required, forbidden in query:
        if any(_phrase_at(p, places) for p in forbidden):
            continue
        at = [_phrase_at(p, places) for p in required]
        if all(at):
            words = {w for p in required for w in p}
            best += cover_density([places[w] for w in sorted(words)])
    return best


QUERY = "array<struct<required:array<array<string>>,forbidden:array<array<string>>,words:array<string>>>"


def _alternatives(questions: DataFrame, scope: list[str], analyser: str) -> DataFrame:
    """(question_id, scope, anchor, q): a row an alternative; the anchor is its longest word, as a rule the rarest."""

    @F.pandas_udf(QUERY)
    def parsed(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"required": r, "forbidden": f, "words": sorted({w for p in r for w in p})} for r, f in parse_query(t or "", analyser)] for t in texts])

    rows = questions.select("question_id", *scope, F.explode(parsed("content")).alias("q"))
    longest = F.element_at(F.array_sort(F.transform("q.words", lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))), -1)["w"]
    return rows.withColumn("anchor", longest)


def _lexemes(content: Column, analyser: str) -> Column:
    """The distinct lexemes of a text: an expression where words stand for themselves, batches where they are stemmed."""
    if analyser == "simple":
        return F.array_distinct(F.regexp_extract_all(F.lower(content), F.lit(r"(?U)\w+(?:[-.]\w+)*"), F.lit(0)))

    @F.pandas_udf("array<string>")
    def stems(texts: pd.Series) -> pd.Series:
        return pd.Series([list(lexemes(t or "", analyser)) for t in texts])

    return stems(content)


def fulltext_search(chunks: DataFrame, questions: DataFrame, *, limit: int = 20, analyser: str = "portuguese", carry: list[str] | None = None) -> DataFrame:
    """(question_id, chunk_id, lexical_score, distance, rank) of the chunks that match, best first, ties by chunk id.

    questions: question_id, content and any of tenant_id, collection, status, which must then be equal. Chunks meet
    alternatives by their anchor word; only chunks that have all words of an alternative are scored. Alternatives are
    sent to the chunks if they are counted as few, else joined by shuffle."""
    check_policy(limit, None)
    scope = [c for c in ("tenant_id", "collection", "status") if c in questions.columns and c in chunks.columns]
    names = list(dict.fromkeys([c for c in ["chunk_id", "document_id", *(carry or [])] if c in chunks.columns]))
    asked = small(_alternatives(questions, scope, analyser))
    held = chunks.select(*dict.fromkeys([*names, *scope]), "content", _lexemes(F.col("content"), analyser).alias("has"))
    met = held.select("*", F.explode("has").alias("anchor")).join(asked, [*scope, "anchor"]).where(F.size(F.array_except("q.words", "has")) == 0)

    @F.pandas_udf("double")
    def scored(texts: pd.Series, queries: pd.DataFrame) -> pd.Series:
        rows = zip(texts, queries["required"], queries["forbidden"])
        return pd.Series([score([([list(p) for p in r], [list(p) for p in f])], lexemes(t, analyser)) for t, r, f in rows], dtype=float)

    # an alternative with the same words as another still counts by itself
    each = met.select("question_id", *names, scored("content", "q").alias("score"))
    total = each.where("score > 0").groupBy("question_id", *names).agg(F.sum("score").alias("lexical_score")).withColumn("distance", 1 / (1 + F.col("lexical_score")))
    return ranked(total, ["question_id"], limit, F.desc(F.round("lexical_score", 9)), F.col("chunk_id"))
