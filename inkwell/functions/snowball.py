"""More Snowball stemmers, from their published descriptions."""

from __future__ import annotations

import re
from functools import lru_cache

from .stemmers import longest, region


def _cut(w: str, start: int, ends: str, by: str = "") -> str | None:
    """w without its longest ending of the list, if that lies beyond start; else None."""
    e = longest(w, ends.split())
    return w[: -len(e)] + by if e and len(w) - len(e) >= start else None


def _romance_rv(w: str, vowels: str) -> int:
    """After the next vowel, or consonant, or the third letter, as the first two letters say."""
    if len(w) < 3:
        return len(w)
    if w[1] not in vowels:
        return next((i + 1 for i in range(2, len(w)) if w[i] in vowels), len(w))
    if w[0] in vowels:
        return next((i + 1 for i in range(2, len(w)) if w[i] not in vowels), len(w))
    return 3


@lru_cache(100_000)
def german(w: str) -> str:
    v = "aeiouyäöü"
    w = w.replace("ß", "ss")
    w = re.sub(f"(?<=[{v}])[uy](?=[{v}])", lambda m: m[0].upper(), w)
    r1 = region(w, v)
    r2 = region(w, v, r1)
    r1 = max(3, r1)
    e = longest(w, "em ern er e en es s".split())
    if e and len(w) - len(e) >= r1:
        stem = w[: -len(e)]
        if e != "s":
            w = stem[:-1] if e in ("e", "en", "es") and stem.endswith("niss") else stem
        elif stem[-1:] in tuple("bdfghklmnrt"):
            w = stem
    e = longest(w, "en er est st".split())
    if e and len(w) - len(e) >= r1:
        stem = w[: -len(e)]
        if e != "st" or (stem[-1:] in tuple("bdfghklmnt") and len(stem) > 3):
            w = stem
    e = longest(w, "end ung ig ik isch lich heit keit".split())
    if e and len(w) - len(e) >= r2:
        stem = w[: -len(e)]
        if e in ("end", "ung"):
            w = stem
            if stem.endswith("ig") and len(stem) - 2 >= r2 and stem[-3:-2] != "e":
                w = stem[:-2]
        elif e in ("ig", "ik", "isch"):
            w = stem if not stem.endswith("e") else w
        elif e in ("lich", "heit"):
            w = _cut(stem, r1, "er en") or stem
        else:
            w = _cut(stem, r2, "lich ig") or stem
    return w.lower().translate(str.maketrans("äöü", "aou"))


_ES_VERB = (
    "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos "
    "eremos erá eré irían irías irán irás iríais iría iréis iríamos iremos irá iré aba ada ida ía ara iera ad ed id ase "
    "iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras "
    "ieras ases ieses ís áis abais íais arais ierais aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos "
    "iéramos iésemos ásemos"
)


@lru_cache(100_000)
def spanish(w: str) -> str:
    v = "aeiouáéíóúü"
    r1 = region(w, v)
    r2, rv = region(w, v, r1), _romance_rv(w, v)
    plain = str.maketrans("áéíóú", "aeiou")
    p = longest(w, "me se sela selo selas selos la le lo las les los nos".split())
    if p:
        stem = w[: -len(p)]
        e = longest(stem, "iéndo ándo ár ér ír ando iendo ar er ir yendo".split())
        if e and len(stem) - len(e) >= rv and (e != "yendo" or stem[:-5].endswith("u")):
            w = stem[: -len(e)] + e.translate(plain)
    before = w
    groups = (
        ("anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos", ""),
        ("adora ador ación adoras adores aciones ante antes ancia ancias", "ic"),
        ("logía logías", "log"), ("ución uciones", "u"), ("encia encias", "ente"),
        ("amente", "amente"), ("mente", "mente"), ("idad idades", "idad"), ("iva ivo ivas ivos", "iva"),
    )
    e = longest(w, " ".join(g for g, _ in groups).split())
    if e:
        kind = next(k for g, k in groups if e in g.split())
        stem = w[: -len(e)]
        if kind == "amente":
            if len(stem) >= r1:
                w = stem
                x = _cut(w, r2, "os ic ad")
                y = _cut(w, r2, "iv")
                w = (_cut(y, r2, "at") or y) if y is not None else x if x is not None else w
        elif len(stem) >= r2:
            w = stem + (kind if kind in ("log", "u", "ente") else "")
            more = {"ic": "ic", "mente": "ante able ible", "idad": "abil ic iv", "iva": "at"}.get(kind)
            if more:
                w = _cut(w, r2, more) or w
    if w == before:
        e = longest(w[rv:], "ya ye yan yen yeron yendo yo yó yas yes yais yamos".split())
        if e and w[: -len(e)].endswith("u"):
            w = w[: -len(e)]
        else:
            e = longest(w[rv:], [*_ES_VERB.split(), "en", "es", "éis", "emos"])
            if e:
                w = w[: -len(e)]
                if e in ("en", "es", "éis", "emos") and w.endswith("gu"):
                    w = w[:-1]
    e = longest(w[rv:], "os a o á í ó e é".split())
    if e:
        w = w[: -len(e)]
        if e in ("e", "é") and w.endswith("gu") and len(w) - 1 >= rv:
            w = w[:-1]
    return w.translate(plain)


@lru_cache(100_000)
def italian(w: str) -> str:
    w = w.translate(str.maketrans("áéíóú", "àèìòù"))
    v = "aeiouàèìòù"
    w = re.sub("(?<=q)u", "U", w)
    w = re.sub(f"(?<=[{v}])[ui](?=[{v}])", lambda m: m[0].upper(), w)
    r1 = region(w, v)
    r2, rv = region(w, v, r1), _romance_rv(w, v)
    p = longest(w[rv:], "ci gli la le li lo mi ne si ti vi sene gliela gliele glieli glielo gliene mela mele meli melo mene tela tele teli telo tene cela cele celi celo cene vela vele veli velo vene".split())
    if p:
        stem = w[: -len(p)]
        if stem[rv:].endswith(("ando", "endo")):
            w = stem
        elif stem[rv:].endswith(("ar", "er", "ir")):
            w = stem + "e"
    before = w
    groups = (
        ("anza anze ico ici ica ice iche ichi ismo ismi abile abili ibile ibili ista iste isti istà istè istì oso osi osa ose mente atrice atrici ante anti", ""),
        ("azione azioni atore atori", "ic"), ("logia logie", "log"), ("uzione uzioni usione usioni", "u"),
        ("enza enze", "ente"), ("amento amenti imento imenti", "rv"), ("amente", "amente"), ("ità", "ità"), ("ivo ivi iva ive", "ivo"),
    )
    e = longest(w, " ".join(g for g, _ in groups).split())
    if e:
        kind, stem = next(k for g, k in groups if e in g.split()), w[: -len(e)]
        start = rv if kind == "rv" else r1 if kind == "amente" else r2
        if len(stem) >= start:
            w = stem + (kind if kind in ("log", "u", "ente") else "")
            if kind == "amente":
                y = _cut(w, r2, "iv")
                w = (_cut(y, r2, "at") or y) if y is not None else _cut(w, r2, "os ic abil") or w
            elif kind == "ic":
                w = _cut(w, r2, "ic") or w
            elif kind == "ità":
                w = _cut(w, r2, "abil ic iv") or w
            elif kind == "ivo":
                y = _cut(w, r2, "at")
                w = (_cut(y, r2, "ic") or y) if y is not None else w
    if w == before:
        verbs = (
            "ammo ando ano are arono asse assero assi assimo ata ate ati ato ava avamo avano avate avi avo emmo enda ende endi "
            "endo erà erai eranno ere erebbe erebbero erei eremmo eremo ereste eresti erete erò erono essero ete eva evamo evano "
            "evate evi evo Yamo iamo immo irà irai iranno ire irebbe irebbero irei iremmo iremo ireste iresti irete irò irono isca "
            "iscano isce isci isco iscono issero ita ite iti ito iva ivamo ivano ivate ivi ivo ono uta ute uti uto ar ir"
        )
        e = longest(w[rv:], verbs.split())
        w = w[: -len(e)] if e else w
    e = longest(w[rv:], "a e i o à è ì ò".split())
    if e:
        w = w[:-1]
        if w[rv:].endswith("i"):
            w = w[:-1]
    if w[rv:].endswith(("ch", "gh")):
        w = w[:-1]
    return w.lower()


_FR_I = "îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant issante issantes issants isse issent isses issez issiez issions issons it"
_FR_V1 = "é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez"
_FR_V2 = "âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions"


@lru_cache(100_000)
def french(w: str) -> str:
    v = "aeiouyâàëéêèïîôûù"
    w = re.sub(f"(?<=[{v}])[ui](?=[{v}])|(?<=q)u", lambda m: m[0].upper(), w)
    w = re.sub(f"(?<=[{v}])y|y(?=[{v}])", "Y", w)
    if w[:3] in ("par", "col", "tap") or (len(w) > 2 and w[0] in v and w[1] in v):
        rv = 3
    else:
        rv = next((i + 1 for i in range(1, len(w)) if w[i] in v), len(w))
    r1 = region(w, v)
    r2 = region(w, v, r1)
    before, verb = w, False
    groups = (
        ("ance iqUe isme able iste eux ances iqUes ismes ables istes", "del"),
        ("atrice ateur ation atrices ateurs ations", "ic"), ("logie logies", "log"), ("usion ution usions utions", "u"),
        ("ence ences", "ent"), ("ement ements", "ement"), ("ité ités", "ité"), ("if ive ifs ives", "if"), ("eaux", "eau"),
        ("aux", "al"), ("euse euses", "euse"), ("issement issements", "iss"), ("amment", "ant"), ("emment", "ente"),
        ("ment ments", "ment"),
    )
    e = longest(w, " ".join(g for g, _ in groups).split())
    if e:
        kind, stem = next(k for g, k in groups if e in g.split()), w[: -len(e)]
        n = len(stem)

        def then(x: str, ends: str, by: str) -> str:
            c = _cut(x, r2, ends)
            return c if c is not None else x[: -len(ends)] + by if x.endswith(ends) and by else x

        if kind == "del" and n >= r2:
            w = stem
        elif kind == "ic" and n >= r2:
            w = then(stem, "ic", "iqU")
        elif kind in ("log", "u", "ent") and n >= r2:
            w = stem + kind
        elif kind == "ement" and n >= rv:
            w = stem
            if w.endswith("iv") and len(w) - 2 >= r2:
                w = _cut(w[:-2], r2, "at") or w[:-2]
            elif w.endswith("eus"):
                w = w[:-3] if len(w) - 3 >= r2 else w[:-1] + "x" if len(w) - 3 >= r1 else w
            elif x := _cut(w, r2, "abl iqU"):
                w = x
            elif w.endswith(("ièr", "Ièr")) and len(w) - 3 >= rv:
                w = w[:-3] + "i"
        elif kind == "ité" and n >= r2:
            w = stem
            if w.endswith("abil"):
                w = w[:-4] if len(w) - 4 >= r2 else w[:-4] + "abl"
            elif w.endswith("ic"):
                w = then(w, "ic", "iqU")
            else:
                w = _cut(w, r2, "iv") or w
        elif kind == "if" and n >= r2:
            w = stem
            if x := _cut(w, r2, "at"):
                w = then(x, "ic", "iqU")
        elif kind == "eau":
            w = w[:-1]
        elif kind == "al" and n >= r1:
            w = stem + "al"
        elif kind == "euse":
            w = stem if n >= r2 else stem + "eux" if n >= r1 else w
        elif kind == "iss" and n >= r1 and stem and stem[-1] not in v:
            w = stem
        elif kind in ("ant", "ente") and n >= rv:
            w, verb = stem + kind[:3], True
        elif kind == "ment" and n > rv and stem[-1] in v:
            w, verb = stem, True
    changed = w != before
    if not changed or verb:
        found = longest(w[rv:], _FR_I.split())
        stem = w[: -len(found)] if found else w
        if found and stem and stem[-1] not in v and len(stem) > rv - 1 and len(stem) >= rv:
            w, changed = stem, True
        else:
            x = longest(w[rv:], ["ions", *_FR_V1.split(), *_FR_V2.split()])
            if x == "ions":
                if len(w) - 4 >= r2:
                    w, changed = w[:-4], True
            elif x in _FR_V1.split():
                w, changed = w[: -len(x)], True
            elif x:
                w, changed = w[: -len(x)], True
                if w[rv:].endswith("e"):
                    w = w[:-1]
    if changed and w != before:
        if w.endswith("Y"):
            w = w[:-1] + "i"
        elif w.endswith("ç"):
            w = w[:-1] + "c"
    else:
        if w.endswith("s") and w[-2:-1] not in tuple("aiouès"):
            w = w[:-1]
        if w[rv:].endswith("ion") and len(w) - 3 >= r2 and w[-4:-3] in ("s", "t"):
            w = w[:-3]
        elif x := longest(w[rv:], "ier ière Ier Ière".split()):
            w = w[: -len(x)] + "i"
        elif w[rv:].endswith("e"):
            w = w[:-1]
    if w.endswith(("enn", "onn", "ett", "ell", "eill")):
        w = w[:-1]
    w = re.sub(f"[éè]([^{v}]+)$", r"e\1", w)
    return w.lower()


_HU_CASE = (
    "ban ben ba be ra re nak nek val vel tól től ról ről ból ből hoz hez höz nál nél ig at et ot öt ért képp képpen kor ul "
    "ül vá vé onként enként anként ként en on an ön n t"
)
_HU_DOUBLE = "bb cc ccs dd ff gg ggy jj kk ll lly mm nn nny pp rr ss ssz tt tty vv zz zzs".split()


@lru_cache(100_000)
def hungarian(w: str) -> str:
    v = "aeiouáéíóúöőüű"
    if w and w[0] in v:
        m = re.search(r"(cs|dzs|gy|ly|ny|sz|ty|zs|[^aeiouáéíóúöőüű])", w[1:])
        r1 = 1 + m.end() if m else len(w)
    else:
        r1 = next((i + 1 for i, c in enumerate(w) if c in v), len(w))

    def undouble(x: str) -> str | None:
        d = longest(x, _HU_DOUBLE)
        return (x[: -len(d)] + d[1:]) if d else None

    def short(x: str) -> str:
        return x[:-1] + {"á": "a", "é": "e"}[x[-1]] if x[-1:] in ("á", "é") and len(x) - 1 >= r1 else x

    for end in ("al", "el"):  # instrumental
        if w.endswith(end) and len(w) - 2 >= r1 and (x := undouble(w[:-2])):
            w = x
            break
    if (x := _cut(w, r1, _HU_CASE)) is not None:
        w = short(x)
    for ends, by in (("án ánként", "a"), ("én", "e")):
        if (x := _cut(w, r1, ends, by)) is not None:
            w = x
            break
    for ends, by in (("astul estül stul stül", ""), ("ástul", "a"), ("éstül", "e")):
        if (x := _cut(w, r1, ends, by)) is not None:
            w = x
            break
    if w[-1:] in ("á", "é") and len(w) - 1 >= r1 and (x := undouble(w[:-1])):
        w = x  # factive
    for ends, by in (("oké öké aké eké ké éi é", ""), ("áké áéi", "a"), ("éké ééi éé", "e")):
        if (x := _cut(w, r1, ends, by)) is not None:
            w = x
            break
    for ends, by in (
        ("ünk unk nk juk jük uk ük em om am m od ed ad öd d ja je a e o", ""),
        ("ánk ájuk ám ád á", "a"), ("énk éjük ém éd é", "e"),
    ):
        if (x := _cut(w, r1, ends, by)) is not None:
            w = x
            break
    for ends, by in (
        ("jaim jeim aim eim im jaid jeid aid eid id jai jei ai ei i jaink jeink eink aink ink jaitok jeitek aitok eitek itek jeik jaik aik eik ik", ""),
        ("áim áid ái áink áitok áik", "a"), ("éim éid éi éink éitek éik", "e"),
    ):
        if (x := _cut(w, r1, ends, by)) is not None:
            w = x
            break
    for ends, by in (("ök ok ek ak k", ""), ("ák", "a"), ("ék", "e")):
        if (x := _cut(w, r1, ends, by)) is not None:
            w = x
            break
    return w


@lru_cache(100_000)
def finnish(w: str) -> str:
    v, cons = "aeiouyäö", "bcdfghjklmnpqrstvwxz"
    r1 = region(w, v)
    r2 = region(w, v, r1)
    e = longest(w[r1:], "kin kaan kään ko kö han hän pa pä sti".split())
    if e:
        stem = w[: -len(e)]
        if e == "sti":
            w = stem if len(stem) >= r2 else w
        elif stem[-1:] in tuple(v + "nt"):
            w = stem
    e = longest(w[r1:], "si ni nsa nsä mme nne an än en".split())
    if e:
        stem = w[: -len(e)]
        if e == "si":
            w = stem if not stem.endswith("k") else w
        elif e == "ni":
            w = stem[:-3] + "ksi" if stem.endswith("kse") else stem
        elif e in ("nsa", "nsä", "mme", "nne"):
            w = stem
        elif e == "an" and stem.endswith(("ta", "ssa", "sta", "lla", "lta", "na")):
            w = stem
        elif e == "än" and stem.endswith(("tä", "ssä", "stä", "llä", "ltä", "nä")):
            w = stem
        elif e == "en" and stem.endswith(("lle", "ine")):
            w = stem
    removed = False
    e = longest(w[r1:], "han hen hin hon hän hön siin den tten seen n a ä tta ttä ta tä ssa ssä sta stä lla llä lta ltä lle na nä ksi ine".split())
    if e:
        stem, new = w[: -len(e)], None
        if e[0] == "h" and len(e) == 3:
            new = stem if stem.endswith(e[1]) else None
        elif e in ("siin", "den", "tten"):
            new = stem if re.search(f"[{v}]i$", stem) else None
        elif e == "seen":
            new = stem if re.search("(aa|ee|ii|oo|uu|ää|öö)$", stem) else None
        elif e in ("a", "ä"):
            new = stem if re.search(f"[{cons}][{v}]$", stem) else None
        elif e in ("tta", "ttä"):
            new = stem if stem.endswith("e") else None
        elif e == "n":
            new = stem[:-1] if re.search("(aa|ee|ii|oo|uu|ää|öö|ie)$", stem) and len(stem) - 1 >= r1 else stem
        else:
            new = stem
        if new is not None:
            w, removed = new, True
    e = longest(w[r2:], "mpi mpa mpä mmi mma mmä impi impa impä immi imma immä eja ejä".split())
    if e and (e not in ("mpi", "mpa", "mpä", "mmi", "mma", "mmä") or not w[: -len(e)].endswith("po")):
        w = w[: -len(e)]
    if removed:
        if w[r1:].endswith(("i", "j")):
            w = w[:-1]
    elif w[r1:].endswith("t") and w[-2:-1] in tuple(v):
        w = w[:-1]
        e = longest(w[r2:], ("imma", "mma"))
        if e and (e == "imma" or not w[:-3].endswith("po")):
            w = w[: -len(e)]
    if re.search("(aa|ee|ii|oo|uu|ää|öö)$", w) and len(w) - 1 >= r1:
        w = w[:-1]
    if re.search(f"[{cons}][aäei]$", w) and len(w) - 1 >= r1:
        w = w[:-1]
    if w[r1:].endswith(("oj", "uj")):
        w = w[:-1]
    if w[r1:].endswith("jo"):
        w = w[:-1]
    m = re.search(f"([{cons}])\\1([{v}]*)$", w)
    return w[: m.start()] + m[1] + m[2] if m else w
