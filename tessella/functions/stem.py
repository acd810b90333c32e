"""Stems of English and Portuguese words by the published Snowball algorithms, and which words are left out."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

# Fixed values of the English algorithm.
_EN_VOWELS = "aeiouy"
_EN_WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"} | {w: w for w in "sky news howe atlas cosmos bias andes".split()}
_EN_STOP_AT = "inning outing canning herring earring proceed exceed succeed".split()
_EN_DOUBLES = "bb dd ff gg mm nn pp rr tt".split()
_EN_STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful",
    "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
_EN_STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
_EN_STEP4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()

# Fixed values of the Portuguese algorithm.
_PT_VOWELS = "aeiouáéíóúâêô"
_PT_DELETE = "eza ezas ico ica icos icas ismo ismos ável ível ista istas oso osa osos osas amento amentos imento imentos adora ador aça~o adoras adores aço~es ante antes ância".split()
_PT_CHANGE = {"logia": "log", "logias": "log", "uça~o": "u", "uço~es": "u", "ência": "ente", "ências": "ente"}
_PT_OTHER = "amente mente idade idades iva ivo ivas ivos ira iras".split()
_PT_VERB = (
    "ada ida ia aria eria iria ará ara erá era irá ava asse esse isse aste este iste ei arei erei irei am iam ariam eriam iriam aram eram iram avam em arem erem irem assem essem issem ado ido ando endo indo ara~o era~o ira~o ar er ir "
    "as adas idas ias arias erias irias arás aras erás eras irás avas es ardes erdes irdes ares eres ires asses esses isses astes estes istes is ais eis íeis aríeis eríeis iríeis áreis areis éreis ereis íreis ireis ásseis ésseis ísseis áveis "
    "ados idos ámos amos íamos aríamos eríamos iríamos áramos éramos íramos ávamos emos aremos eremos iremos ássemos êssemos íssemos imos armos ermos irmos eu iu ou ira iras"
).split()


def _after(word: str, vowels: str, start: int) -> int:
    """Where the region behind the first non-vowel that follows a vowel begins."""
    for i in range(start + 1, len(word)):
        if word[i] not in vowels and word[i - 1] in vowels:
            return i + 1
    return len(word)


def _longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def english(word: str) -> str:
    if len(word) <= 2:
        return word
    word = word.removeprefix("'")
    if word in _EN_WHOLE:
        return _EN_WHOLE[word]
    word = "".join("Y" if c == "y" and (i == 0 or word[i - 1] in _EN_VOWELS) else c for i, c in enumerate(word))
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if word.startswith(p)), None)
    r1 = _after(word, _EN_VOWELS, 0) if r1 is None else r1
    r2 = _after(word, _EN_VOWELS, r1)
    vowel = lambda text: any(c in _EN_VOWELS for c in text)

    def short_end(w: str) -> bool:
        if len(w) == 2:
            return w[0] in _EN_VOWELS and w[1] not in _EN_VOWELS
        return len(w) > 2 and w[-3] not in _EN_VOWELS and w[-2] in _EN_VOWELS and w[-1] not in _EN_VOWELS + "wxY"

    word = word.removesuffix(_longest(word, ("'", "'s", "'s'")) or "")
    end = _longest(word, ("sses", "ied", "ies", "us", "ss", "s"))
    if end == "sses":
        word = word[:-2]
    elif end in ("ied", "ies"):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif end == "s" and vowel(word[:-2]):
        word = word[:-1]
    if word in _EN_STOP_AT:
        return word
    end = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end in ("eed", "eedly"):
        if len(word) - len(end) >= r1:
            word = word[: -len(end)] + "ee"
    elif end and vowel(word[: -len(end)]):
        word = word[: -len(end)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word[-2:] in _EN_DOUBLES:
            word = word[:-1]
        elif short_end(word) and r1 >= len(word):
            word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in _EN_VOWELS:
        word = word[:-1] + "i"
    end = _longest(word, _EN_STEP2)
    if end and len(word) - len(end) >= r1 and (end != "ogi" or word[-4:-3] == "l") and (end != "li" or word[-3] in "cdeghkmnrt"):
        word = word[: -len(end)] + _EN_STEP2[end]
    end = _longest(word, _EN_STEP3)
    if end and len(word) - len(end) >= (r2 if end == "ative" else r1):
        word = word[: -len(end)] + _EN_STEP3[end]
    end = _longest(word, _EN_STEP4)
    if end and len(word) - len(end) >= r2 and (end != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(end)]
    if word[-1:] == "e" and (len(word) - 1 >= r2 or len(word) - 1 >= r1 and not short_end(word[:-1])) or word[-2:] == "ll" and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")


def portuguese(word: str) -> str:
    word = word.replace("ã", "a~").replace("õ", "o~")
    v = _PT_VOWELS
    rv = len(word)
    if len(word) > 2:
        if word[1] not in v:
            rv = next((i + 1 for i in range(2, len(word)) if word[i] in v), len(word))
        elif word[0] in v:
            rv = next((i + 1 for i in range(2, len(word)) if word[i] not in v), len(word))
        else:
            rv = 3
    r1 = _after(word, v, 0)
    r2 = _after(word, v, r1)
    ends = lambda w, e, region: w.endswith(e) and len(w) - len(e) >= region

    def without(w: str, *inner: str) -> str:
        found = _longest(w, inner)
        return w[: -len(found)] if found and ends(w, found, r2) else w

    def standard(w: str) -> str:
        e = _longest(w, [*_PT_DELETE, *_PT_CHANGE, *_PT_OTHER])
        if e is None:
            return w
        cut = w[: -len(e)]
        if e in ("ira", "iras"):
            return cut + "ir" if ends(w, e, rv) and cut.endswith("e") else w
        if e == "amente":
            if not ends(w, e, r1):
                return w
            return without(without(cut, "iv"), "at") if ends(cut, "iv", r2) else without(cut, "os", "ic", "ad")
        if not ends(w, e, r2):
            return w
        if e in _PT_CHANGE:
            return cut + _PT_CHANGE[e]
        if e == "mente":
            return without(cut, "ante", "avel", "ível")
        if e in ("idade", "idades"):
            return without(cut, "abil", "ic", "iv")
        if e in ("iva", "ivo", "ivas", "ivos"):
            return without(cut, "at")
        return cut

    new = standard(word)
    if new == word:
        e = _longest(word[rv:], _PT_VERB)
        new = word[: -len(e)] if e else word
    if new != word:
        word = new[:-1] if ends(new, "i", rv) and new[:-1].endswith("c") else new
    else:
        e = _longest(word, ("os", "a", "i", "o", "á", "í", "ó"))
        word = word[: -len(e)] if e and ends(word, e, rv) else word
    if word[-1:] and word[-1] in "eéê" and len(word) - 1 >= rv:
        word = word[:-1]
        if word.endswith(("gu", "ci")) and len(word) - 1 >= rv:
            word = word[:-1]
    elif word.endswith("ç"):
        word = word[:-1] + "c"
    return word.replace("a~", "ã").replace("o~", "õ")


STEMMERS: dict[str, Callable[[str], str]] = {"simple": lambda w: w, "english": lru_cache(200_000)(english), "portuguese": lru_cache(200_000)(portuguese)}
