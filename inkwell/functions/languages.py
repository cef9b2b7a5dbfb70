"""Stop words, and the analysers by name."""

from __future__ import annotations

from functools import cache

from . import snowball
from . import stemmers as S
from . import tokens as T

_STOP = {
    "en": "the of and to in a is that it for was on are as with be by at this i his he from have or not had but which you one we all were when there their an can if has will more who would no she do they what her so up out about than into them only some could these two its may then our any my now over did most me after also made many before must through such much your how where too very just those been being him himself herself itself theirs yours ours us am does doing because while against between during under again further once here why both each few other own same nor until above below off down should",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec ou son cette mais ses elle comme nous sa on aux même deux ont si leur être ces tout leurs sans vous notre fait était lui peut dont ils je moi toi tu te me mes tes ton ta y d l n s c j m t qu à été étaient avait avoir suis es sommes êtes ai as avons avez serait",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei hatte kann gegen vom können schon wenn habe seine mich dich ihn uns euch ihr ihre ihrem mein dein kein keine wir ich du was wer diese dieser dieses jener doch hier dort",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está mi porque qué sólo han yo hay vez puede todos así nos ni parte tiene él uno donde bien tiempo mismo ese ahora otro ellos ellas nosotros tu te ti les fueron estar estaba unos unas",
    "it": "di e il la che in a per un è del non sono le si con i da una della nel come dei al alla più ha anche lo gli ma su o se dalla questo delle ed quando ci era ai suo dal loro sua ne dello degli nella sul io tu lui lei noi voi mi ti vi questa quello quella c l d all dell nell sull dove chi cui essere avere aveva stato",
    "pt": "de a o que e do da em um para é com não uma os no se na por mais as dos como mas foi ao ele das tem à seu sua ou ser quando muito há nos já está eu também só pelo pela até isso ela entre era depois sem mesmo aos ter seus quem nas me esse eles estão você tinha foram essa num nem suas meu às minha têm numa pelos elas",
    "nl": "de van het een en in is dat op te zijn met voor die niet aan er om ook als dan maar bij nog uit door over ze wat tot je naar heeft hij hebben of zo wordt deze al haar hem had was worden kan onder mijn men dit zou ons zich wie u ik geen doen moet ben toch iets alles niets",
    "da": "og i at det er en til af på som for den med de han har ikke var et fra der men om hun sig jeg vi kan havde eller blev ved så også efter være nu over da under mod disse hvis sin mit os ud nogle hans hendes dem du min skal vil bliver noget denne end ind",
    "no": "og i det på som er en til å han av for at med var de ikke den har jeg om et men så seg hun hadde fra vi du kan da nå vil der skal ble meg mot ut opp eller etter sin bare ved være denne hva noe deg hans hennes oss ei ikkje eg frå vart kva",
    "sv": "och i att det som en på är av för med till den har de inte om ett han men var jag sig från vi så kan man när år under också efter eller nu sin där vid mot ska skulle hade hon ut bara vad sina här upp dem över denna alla mycket mig dig oss er min din",
    "fi": "ja on ei että se hän oli mutta olla kun ovat niin myös kuin joka mukaan sen jo tai mitä sitä vain nyt jos hänen sekä minä sinä me te he minun sinun tämä tuo nämä ne mikä kuka missä olen olet olemme olette eivät en et koska vaikka",
    "hu": "a az és hogy nem is egy ez van volt meg de csak már el mint még ha azt vagy ki lesz úgy fel ezt amely majd kell minden pedig mert én te ő mi ti ők nagyon között után lehet sem lett olyan így akkor ezek azok itt ott",
    "ro": "de și în a la cu pe care din nu că o un se pentru mai este este-i au fost sau sunt prin dar ca ce el ea lui sa său fi s-a am ai această acest aceasta după între cel cea cei toate tot doar când unde cum dacă noi voi ei ele îi îl",
    "ru": "и в не на я что он с как это по но из у за то все она так его а же от бы к о мы было для вы только мне был ее уже до меня если еще когда или ни была их нет быть чтобы этот ты во том где есть даже под надо со них тебя чем была сам без раз тоже себя будет кто",
    "tr": "ve bir bu da de için ile çok o ne gibi daha ki ama en kadar her var sonra mı mi olarak değil ya şey ben sen biz siz onlar olan olduğu ise diye hem hiç veya yok şu bana sana ona nasıl neden çünkü ancak göre üzere",
    "ar": "في من على أن إلى هذا التي الذي عن مع لا ما كان هو هذه قد بين كل بعد ذلك لم أو هي كما إن ثم عند و لكن حيث أي حتى منذ كانت غير إذا نحن أنا أنت هم هناك لها له به بها فيه فيها",
    "fa": "و در به از که این را با است برای آن یک تا خود بر هم نیز می شود شد بود باید ها دو اند اما او یا کرد هر وی بین پس پیش کند چه اگر همه دیگر آنها ما من تو شما",
    "ckb": "و لە بە کە بۆ ئەم ئەو لەگەڵ هەر دەکات بوو نە یان لەسەر تا وەک ئێمە من تۆ ئەوان پاش پێش هەموو چەند دوای بێ",
    "hi": "के में की है यह और से हैं को पर इस का ने कि जो एक लिए भी नहीं तो था हो कर गया वह थे थी अपने कुछ साथ होता या इन उस उन जब तक बाद हुए दिया ही सभी किया जा रहा कोई",
    "bg": "на и да се в за не от е с по че са това като до ще си но след тя той аз или при ги към беше един един още може само му те ни ми без който която които го ѝ между",
    "ca": "de la i el que a en els les un per una amb no és es del al se com més o va però ha són si seu també sense fins sobre entre molt aquest aquesta hi ho jo tu ell ella",
    "cs": "a se v na je že s z do o i to ve by ale k jako jsem si za po jsou byl od pro který co tak ze už před však jeho jen má aby nebo při být jak které jejich když tím která bylo",
    "el": "και το να του η της με που την από για είναι ο οι στο σε τα δεν τον στην θα ως τους αυτό τη αλλά ή μας έχει ένα μια όπως κατά μου αν στη των",
    "eu": "eta da ez du dira bat izan ere zuen bere edo baina den egin hau hori bai dute ziren zen beste gu ni zu haiek nola zer",
    "ga": "agus an na ar ag is a i le go do ní sé bhí tá sin gur mar sí nach faoi chun atá siad é iad mé tú roimh thar",
    "gl": "de a o que e do da en un para é con non unha os no se na por máis as dos como mais foi ao el das ten seu súa ou ser cando moito",
    "hy": "և է որ ի մի են այս որպես համար նաև իր այդ չի էր ես դու նա մենք դուք նրանք հետ մեջ բայց կամ թե",
    "id": "yang dan di itu dengan untuk tidak ini dari dalam akan pada juga saya ke karena tersebut bisa ada mereka lebih sudah atau saat oleh sebagai adalah apa kita kamu dia kami telah hanya para bahwa seperti menjadi antara tetapi",
}
ARTICLES = {
    "fr": "c d j l m n s t puisqu qu lorsqu jusqu quoiqu",
    "it": "un l d c all agl coll dell degl dall dagl gl nell negl pell sull sugl m s t v",
    "ca": "d l m n s t",
    "ga": "d m b",
}


@cache
def stop_words(lang: str) -> frozenset[str]:
    return frozenset(_STOP[lang].split())


def stop_filter(lang: str) -> T.Filter:
    return T.stop(stop_words(lang))


def elision_filter(lang: str) -> T.Filter:
    return T.elision(ARTICLES[lang].split())


LANGUAGES = tuple(_STOP)


@cache
def analyzer(name: str) -> T.Analyzer:
    """keyword, simple, whitespace, standard, web, or a language code."""
    words, low = T.unicode_words, T.lower
    plain = {
        "keyword": T.Analyzer(T.single),
        "simple": T.Analyzer(T.letters, (low,)),
        "whitespace": T.Analyzer(T.not_space),
        "standard": T.Analyzer(words, (low,)),
    }
    if name in plain:
        return plain[name]
    each, norm = T.each, S
    keep = {
        "web": lambda: T.Analyzer(T.web_words, (low, stop_filter("en"))),
        "cjk": lambda: T.Analyzer(words, (T.width, low, T.cjk_bigrams())),
        "en": lambda: T.Analyzer(words, (T.possessive, low, stop_filter("en"), each(S.english))),
        "fr": lambda: T.Analyzer(words, (low, elision_filter("fr"), stop_filter("fr"), each(S.french_light))),
        "it": lambda: T.Analyzer(words, (low, elision_filter("it"), stop_filter("it"), each(S.italian_light))),
        "de": lambda: T.Analyzer(words, (low, stop_filter("de"), each(S.german_normalize), each(S.german_light))),
        "es": lambda: T.Analyzer(words, (low, stop_filter("es"), each(S.spanish_light))),
        "pt": lambda: T.Analyzer(words, (low, stop_filter("pt"), each(S.portuguese_light))),
        "tr": lambda: T.Analyzer(words, (T.apostrophe, low, stop_filter("tr"))),
        "ar": lambda: T.Analyzer(
            words, (low, T.normalise("NFKC"), stop_filter("ar"), each(norm.arabic_normalize), each(norm.arabic_light))
        ),
        "fa": lambda: T.Analyzer(
            words,
            (low, each(norm.arabic_normalize), each(norm.persian_normalize), stop_filter("fa")),
            (T.split_joiners,),
        ),
        "ckb": lambda: T.Analyzer(words, (each(norm.sorani_normalize), low, stop_filter("ckb"), each(norm.sorani_stem))),
        "hi": lambda: T.Analyzer(
            words, (low, each(norm.indic_normalize), each(norm.hindi_normalize), stop_filter("hi"), each(norm.hindi_stem))
        ),
    }
    stems = {"da": S.danish, "no": S.norwegian, "sv": S.swedish, "nl": S.dutch, "ru": S.russian, "fi": snowball.finnish, "hu": snowball.hungarian}
    if name in keep:
        return keep[name]()
    if name in stems:
        return T.Analyzer(words, (low, stop_filter(name), each(stems[name])))
    # Snowball in place of the light stemmer.
    variant = {"de-snowball": snowball.german, "es-snowball": snowball.spanish, "it-snowball": snowball.italian, "fr-snowball": snowball.french}
    if name in variant:
        lang = name[:2]
        elide = (elision_filter(lang),) if lang in ARTICLES else ()
        return T.Analyzer(words, (low, *elide, stop_filter(lang), each(variant[name])))
    if name in ("ca", "ga"):
        return T.Analyzer(words, (low, elision_filter(name), stop_filter(name)))
    if name in _STOP:
        return T.Analyzer(words, (low, stop_filter(name)))
    raise ValueError(f"no analyser {name!r}")


@cache
def by_chunk(name: str) -> T.ByChunk:
    """analyzer(name) with what it found kept; for those that begin with words."""
    return T.ByChunk(analyzer(name))
