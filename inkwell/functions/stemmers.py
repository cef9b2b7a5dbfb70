"""Stemmers from their published descriptions, and light suffix rules for other languages."""

from __future__ import annotations

import re
from functools import lru_cache

VOWELS = "aeiouy"


# --- Porter (1980) -------------------------------------------------------------------------


def _shape(w: str) -> str:
    """c and v for each letter; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(w):
        out += "v" if ch in "aeiou" or (ch == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(w: str) -> int:
    return len(re.findall("v+c+", _shape(w)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c"


def _cvc(w: str) -> bool:
    return len(w) > 2 and _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


def _swap(w: str, rules: dict[str, str], least: int) -> str:
    for end in sorted(rules, key=len, reverse=True):
        if w.endswith(end):
            stem = w[: -len(end)]
            return stem + rules[end] if _measure(stem) > least else w
    return w


_P2 = dict(x.split(":") for x in (
    "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize "
    "ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
).split())
_P3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_P4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()


@lru_cache(100_000)
def porter(w: str) -> str:
    if len(w) < 3:
        return w
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]):
            w = w[:-1]
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and "v" in _shape(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")) or (_measure(w) == 1 and _cvc(w)):
                    w += "e"
                elif _double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _swap(_swap(w, _P2, 0), _P3, 0)
    for end in sorted([*_P4, "ion"], key=len, reverse=True):
        if w.endswith(end):
            stem = w[: -len(end)]
            if _measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    if _measure(w) > 1 and w.endswith("ll"):
        w = w[:-1]
    return w


# --- Snowball: English (Porter2) -----------------------------------------------------------

_EXACT = dict(x.split(":") for x in (
    "skis:ski skies:sky dying:die lying:lie tying:tie idly:idl gently:gentl ugly:ugli early:earli only:onli "
    "singly:singl sky:sky news:news howe:howe atlas:atlas cosmos:cosmos bias:bias andes:andes"
).split())
_WHOLE = set("inning outing canning herring earring proceed exceed succeed".split())


def region(w: str, vowels: str, start: int = 0) -> int:
    """Where the part after the first non-vowel that follows a vowel begins."""
    for i in range(start + 1, len(w)):
        if w[i] not in vowels and w[i - 1] in vowels:
            return i + 1
    return len(w)


def _short(w: str) -> bool:
    if len(w) == 2:
        return w[0] in VOWELS and w[1] not in VOWELS
    return len(w) > 2 and w[-1] not in VOWELS + "wxY" and w[-2] in VOWELS and w[-3] not in VOWELS


_E2 = dict(x.split(":") for x in (
    "tional:tion enci:ence anci:ance abli:able entli:ent izer:ize ization:ize ational:ate ation:ate ator:ate "
    "alism:al aliti:al alli:al fulness:ful ousli:ous ousness:ous iveness:ive iviti:ive biliti:ble bli:ble "
    "fulli:ful lessli:less ogi:og li:"
).split())
_E3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
_E4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()


def longest(w: str, ends) -> str | None:
    return max([e for e in ends if w.endswith(e)], key=len) if w.endswith(tuple(ends)) else None


@lru_cache(100_000)
def english(w: str) -> str:
    if len(w) < 3:
        return w
    if w in _EXACT:
        return _EXACT[w]
    w = w.replace("’", "'").lstrip("'") if w[0] in "'’" else w.replace("’", "'")
    w = re.sub(f"^y|(?<=[{VOWELS}])y", "Y", w)
    r1 = region(w, VOWELS)
    for p in ("gener", "commun", "arsen"):
        if w.startswith(p):
            r1 = len(p)
    r2 = region(w, VOWELS, r1)
    if e := longest(w, ("'", "'s", "'s'")):
        w = w[: -len(e)]
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(f"[{VOWELS}]", w[:-2]):
        w = w[:-1]
    if w in _WHOLE:
        return w
    e = longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if e in ("eed", "eedly"):
        if len(w) - len(e) >= r1:
            w = w[: -len(e)] + "ee"
    elif e and re.search(f"[{VOWELS}]", w[: -len(e)]):
        w = w[: -len(e)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w[-2:] in ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"):
            w = w[:-1]
        elif _short(w) and len(w) <= r1:
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    if (e := longest(w, _E2)) and len(w) - len(e) >= r1:
        stem = w[: -len(e)]
        if not (e == "ogi" and not stem.endswith("l")) and not (e == "li" and stem[-1:] not in tuple("cdeghkmnrt")):
            w = stem + _E2[e]
    if (e := longest(w, _E3)) and len(w) - len(e) >= r1 and (e != "ative" or len(w) - len(e) >= r2):
        w = w[: -len(e)] + _E3[e]
    if (e := longest(w, _E4)) and len(w) - len(e) >= r2 and (e != "ion" or w[:-3].endswith(("s", "t"))):
        w = w[: -len(e)]
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


# --- Snowball: Scandinavian ----------------------------------------------------------------


def _cut_in(w: str, r1: int, ends: str, s_after: str = "", s_end: str = "s") -> str:
    """Removes the longest ending that lies in the region; s only after some letters."""
    e = longest(w[r1:], ends.split() + ([s_end] if s_after else []))
    if not e:
        return w
    if e == s_end and s_after:
        return w[:-1] if w[-2:-1] and w[-2] in s_after else w
    return w[: -len(e)]


_NORDIC = "aeiouyæåøäö"


@lru_cache(50_000)
def swedish(w: str) -> str:
    r1 = max(3, region(w, "aeiouyäåö"))
    w = _cut_in(w, r1, "a arna erna heterna orna ad e ade ande arne are aste en anden aren heten ern ar er heter or as arnas ernas ornas es ades andes ens arens hetens erns at andet het ast", "bcdfghjklmnoprtvy")
    if longest(w[r1:], "dd gd nn dt gt kt tt".split()):
        w = w[:-1]
    e = longest(w[r1:], "lig ig els löst fullt".split())
    return w[: -len(e)] if e in ("lig", "ig", "els") else w[:-1] if e else w


@lru_cache(50_000)
def danish(w: str) -> str:
    r1 = max(3, region(w, "aeiouyæåø"))
    w = _cut_in(w, r1, "hed ethed ered e erede ende erende ene erne ere en heden eren er heder erer heds es endes erendes enes ernes eres ens hedens erens ers ets erets et eret", "abcdfghjklmnoprtvyzå")
    pair = lambda x: x[:-1] if longest(x[r1:], "gd dt gt kt".split()) else x
    w = pair(w)
    if w.endswith("igst"):
        w = w[:-2]
    e = longest(w[r1:], "ig lig elig els løst".split())
    w = w[:-1] if e == "løst" else pair(w[: -len(e)]) if e else w
    if len(w) > r1 and len(w) > 1 and w[-1] == w[-2] and w[-1] not in "aeiouyæåø":
        w = w[:-1]
    return w


@lru_cache(50_000)
def norwegian(w: str) -> str:
    r1 = max(3, region(w, "aeiouyæåø"))
    e = longest(w[r1:], "a e ede ande ende ane ene hetene en heten ar er heter as es edes endes enes hetenes ens hetens ers ets et het ast s erte ert".split())
    if e in ("erte", "ert"):
        w = w[: -len(e)] + "er"
    elif e == "s":
        w = w[:-1] if w[-2:-1] in tuple("bcdfghjlmnoprtvyz") or (w[-2:-1] == "k" and w[-3:-2] not in tuple(VOWELS)) else w
    elif e:
        w = w[: -len(e)]
    if longest(w[r1:], ("dt", "vt")):
        w = w[:-1]
    e = longest(w[r1:], "leg eleg ig eig lig elig els lov elov slov hetslov".split())
    return w[: -len(e)] if e else w


# --- Snowball: Russian and Dutch -----------------------------------------------------------

_RV = "аеиоуыэюя"
_RU = {
    "gerund1": "в вши вшись", "gerund2": "ив ивши ившись ыв ывши ывшись",
    "adj": "ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею",
    "part1": "ем нн вш ющ щ", "part2": "ивш ывш ующ", "reflex": "ся сь",
    "verb1": "ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно",
    "verb2": "ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю",
    "noun": "а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я",
}
_RU = {k: v.split() for k, v in _RU.items()}


@lru_cache(100_000)
def russian(w: str) -> str:
    w = w.replace("ё", "е")
    rv = next((i + 1 for i, c in enumerate(w) if c in _RV), len(w))
    r2 = region(w, _RV, region(w, _RV))

    def cut(w: str, plain: str, after_a: str = "") -> str | None:
        tail = w[rv:]
        ends = list(_RU[plain]) if plain else []
        if after_a:
            ends += [e for e in _RU[after_a] if tail[: -len(e)].endswith(("а", "я"))]
        e = longest(tail, ends)
        return w[: -len(e)] if e else None

    if (x := cut(w, "gerund2", "gerund1")) is not None:
        w = x
    else:
        w = cut(w, "reflex") or w
        if (x := cut(w, "adj")) is not None:
            w = cut(x, "part2", "part1") or x
        else:
            w = cut(w, "verb2", "verb1") or cut(w, "noun") or w
    if w[rv:].endswith("и"):
        w = w[:-1]
    if e := longest(w[r2:], ("ост", "ость")):
        w = w[: -len(e)]
    if w.endswith("нн"):
        return w[:-1]
    if e := longest(w, ("ейш", "ейше")):
        w = w[: -len(e)]
        return w[:-1] if w.endswith("нн") else w
    return w[:-1] if w.endswith("ь") else w


@lru_cache(100_000)
def dutch(w: str) -> str:
    v = "aeiouyè"
    w = w.translate(str.maketrans("äëïöüáéíóú", "aeiouaeiou"))
    w = re.sub(f"^y|(?<=[{v}])y", "Y", w)
    w = re.sub(f"(?<=[{v}])i(?=[{v}])", "I", w)
    r1 = region(w, v)
    r2 = region(w, v, r1)
    r1 = max(3, r1)

    def undouble(x: str) -> str:
        return x[:-1] if x[-2:] in ("kk", "dd", "tt") else x

    def en(x: str, e: str) -> str:
        stem = x[: -len(e)]
        ok = len(stem) >= r1 and stem and stem[-1] not in v and not stem.endswith("gem")
        return undouble(stem) if ok else x

    e = longest(w, ("heden", "ene", "en", "se", "s"))
    if e == "heden":
        w = w[:-5] + "heid" if len(w) - 5 >= r1 else w
    elif e in ("ene", "en"):
        w = en(w, e)
    elif e and len(w) - len(e) >= r1 and w[: -len(e)][-1:] not in tuple(v + "j"):
        w = w[: -len(e)]
    had_e = False
    if w.endswith("e") and len(w) - 1 >= r1 and w[-2] not in v:
        w, had_e = undouble(w[:-1]), True
    if w.endswith("heid") and len(w) - 4 >= r2 and w[-5:-4] != "c":
        w = w[:-4]
        if w.endswith("en"):
            w = en(w, "en")
    e = longest(w, ("end", "ing", "ig", "lijk", "baar", "bar"))
    if e and len(w) - len(e) >= r2:
        if e in ("end", "ing"):
            stem = w[:-3]
            w = stem[:-2] if stem.endswith("ig") and len(stem) - 2 >= r2 and stem[-3:-2] != "e" else undouble(stem)
        elif e == "ig":
            w = w[:-2] if w[-3:-2] != "e" else w
        elif e == "lijk":
            w = w[:-4]
            if w.endswith("e") and len(w) - 1 >= r1 and w[-2] not in v:
                w = undouble(w[:-1])
        elif e == "baar" or had_e:
            w = w[: -len(e)]
    if re.search(f"[^{v}I](aa|ee|oo|uu)[^{v}I]$", w):
        w = w[:-2] + w[-1]
    return w.replace("Y", "y").replace("I", "i")


# --- light stemmers ------------------------------------------------------------------------


def _plain(w: str) -> str:
    return w.translate(str.maketrans("àáâäèéêëìíîïòóôöùúûü", "aaaaeeeeiiiioooouuuu"))


@lru_cache(100_000)
def german_light(w: str) -> str:
    w = _plain(w)
    n = len(w)
    if n > 5 and w.endswith("ern"):
        w = w[:-3]
    elif n > 4 and w.endswith(("em", "en", "er", "es")):
        w = w[:-2]
    elif n > 3 and (w[-1] == "e" or (w[-1] == "s" and w[-2] in "bdfghklmnt")):
        w = w[:-1]
    n = len(w)
    if n > 5 and w.endswith("est"):
        return w[:-3]
    if n > 4 and (w.endswith(("er", "en")) or (w.endswith("st") and w[-3] in "bdfghklmnt")):
        return w[:-2]
    return w


@lru_cache(100_000)
def spanish_light(w: str) -> str:
    if len(w) < 5:
        return w
    w = w.translate(str.maketrans("àáâäòóôöèéêëùúûüìíîï", "aaaaooooeeeeuuuuiiii"))
    if w[-1] in "oae":
        return w[:-1]
    if w[-1] == "s":
        if w.endswith("eses"):
            return w[:-2]
        if w.endswith("ces"):
            return w[:-3] + "z"
        if w[-2] in "oae":
            return w[:-2]
    return w


@lru_cache(100_000)
def italian_light(w: str) -> str:
    if len(w) < 6:
        return w
    w = w.translate(str.maketrans("àáâäòóôöèéêëùúûüìíîï", "aaaaooooeeeeuuuuiiii"))
    if w[-1] in "ei":
        return w[:-2] if w[-2] in "ih" else w[:-1]
    if w[-1] in "ao":
        return w[:-2] if w[-2] == "i" else w[:-1]
    return w


@lru_cache(100_000)
def portuguese_light(w: str) -> str:
    if len(w) < 4:
        return w
    if w.endswith("es") and w[-3] in "rslz":
        w = w[:-2]
    elif w.endswith("ns"):
        w = w[:-2] + "m"
    elif len(w) > 4 and w.endswith(("eis", "éis")):
        w = w[:-3] + "el"
    elif len(w) > 4 and w.endswith("ais"):
        w = w[:-2] + "l"
    elif len(w) > 4 and w.endswith("óis"):
        w = w[:-3] + "ol"
    elif len(w) > 4 and w.endswith("is"):
        w = w[:-1] + "l"
    elif w.endswith(("ões", "ães")):
        w = w[:-3] + "ão"
    elif w.endswith("s") and len(w) > 3:
        w = w[:-1]
    if len(w) > 5 and w.endswith("mente"):
        w = w[:-5]
    if len(w) > 3 and w[-1] in "aeo":
        w = w[:-1]
    return _plain(w).replace("ç", "c").replace("ã", "a").replace("õ", "o")


_FR = {"issement": "ir", "atrice": "er", "ateur": "er", "ivement": "if", "euses": "eux", "euse": "eux", "trice": "teur",
       "ation": "er", "ition": "ir", "ements": "e", "ement": "e", "elles": "el", "elle": "el", "ives": "if", "ive": "if",
       "aux": "al", "eux": "eu", "ités": "", "ité": "", "ables": "", "able": "", "ismes": "", "isme": "", "istes": "",
       "iste": "", "ières": "ier", "ière": "ier"}


@lru_cache(100_000)
def french_light(w: str) -> str:
    if len(w) > 5:
        if e := longest(w, _FR):
            if len(w) - len(e) > 2:
                w = w[: -len(e)] + _FR[e]
    w = _plain(w).replace("ç", "c")
    if len(w) > 4 and w[-1] in "xs":
        w = w[:-1]
    for end in ("er", "e"):
        if len(w) > 4 and w.endswith(end):
            w = w[: -len(end)]
            break
    while len(w) > 4 and w[-1] == w[-2] and w[-1].isalpha():
        w = w[:-1]
    return w


@lru_cache(100_000)
def french_minimal(w: str) -> str:
    if len(w) < 6:
        return w
    if w[-1] == "x":
        return w[:-2] + "l" if w[-3:-1] == "au" else w
    for c in "sreé":
        if w.endswith(c):
            w = w[:-1]
    return w[:-1] if w[-1] == w[-2] else w


# --- normalisers and stemmers of other scripts ---------------------------------------------


def arabic_normalize(w: str) -> str:
    w = re.sub("[آأإ]", "ا", w).replace("ى", "ي").replace("ة", "ه")
    return re.sub("[ـً-ْ]", "", w)


def arabic_light(w: str) -> str:
    for p in ("ال", "وال", "بال", "كال", "فال", "لل", "و"):
        if w.startswith(p) and len(w) - len(p) >= (3 if p == "و" else 2):
            w = w[len(p) :]
            break
    for s in ("ها", "ان", "ات", "ون", "ين", "يه", "ية", "ه", "ة", "ي"):
        if w.endswith(s) and len(w) - len(s) >= 2:
            w = w[: -len(s)]
    return w


def persian_normalize(w: str) -> str:
    return w.translate(str.maketrans({"ی": "ي", "ے": "ي", "ک": "ك", "ۀ": "ه", "ہ": "ه", "ٔ": None}))


def sorani_normalize(w: str) -> str:
    w = w.replace("ي", "ی").replace("ى", "ی").replace("ك", "ک").replace("ه‌", "ە").replace("ة", "ە")
    w = re.sub("ه$", "ە", w)
    w = re.sub("^ر", "ڕ", w).replace("ھ", "ه")
    return re.sub("[ـً-ْ‌‍‎‏]", "", w)


def sorani_stem(w: str) -> str:
    for ends, least in ((("یش", "دا", "نا", "وە", "ەوە"), 5), (("م", "ت", "ی"), 5), (("ەکان", "ەکە", "ەکانی", "یەک", "ێک", "ان", "ە", "ی"), 4)):
        e = longest(w, ends)
        if e and len(w) - len(e) >= least - 2:
            w = w[: -len(e)]
    return w


def hindi_normalize(w: str) -> str:
    for a, b in (("न्", "ं"), ("ँ", "ं"), ("़", ""), ("‍", ""), ("‌", ""), ("्", ""),
                 ("ऍ", "ए"), ("ऎ", "ए"), ("ऑ", "ओ"), ("ऒ", "ओ"), ("आ", "अ"), ("ई", "इ"), ("ऊ", "उ"), ("ॠ", "ऋ"), ("ऐ", "ए"), ("औ", "ओ"),
                 ("ी", "ि"), ("ू", "ु"), ("ै", "े"), ("ौ", "ो")):
        w = w.replace(a, b)
    return w


_HI = "ाएंगी ाएंगे ाऊंगी ाऊंगा ाइयाँ ाइयों ाइयां ाएगी ाएगा ाओगी ाओगे एंगी ेंगी एंगे ेंगे ूंगी ूंगा ातीं नाओं नाएं ताओं ताएं ियाँ ियों ियां ाकर ाइए ाईं ाया ेगी ेगा ोगी ोगे ाने ाना ाते ाती ाता तीं ाओं ाएं ुओं ुएं ुआं कर ाओ िए ाई ाए ने नी ना ते ीं ती ता ाँ ां ों ें ो े ू ु ी ि ा".split()


def hindi_stem(w: str) -> str:
    e = next((e for e in _HI if w.endswith(e) and len(w) > len(e) + 1), None)
    return w[: -len(e)] if e else w


def indic_normalize(w: str) -> str:
    import unicodedata

    return unicodedata.normalize("NFC", w).replace("‍", "").replace("‌", "")


def german_normalize(w: str) -> str:
    w = re.sub("(?<![aeouq])ae", "a", w)
    w = re.sub("(?<![aeouq])oe", "o", w)
    w = re.sub("(?<![aeouq])ue", "u", w)
    return w.replace("ß", "ss").translate(str.maketrans("äöü", "aou"))
