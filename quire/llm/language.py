"""Function words and letter frequencies of the languages the operators know."""

from __future__ import annotations

#: Function words by language, as lower-case words (fixed values).
FUNCTION_WORDS: dict[str, frozenset[str]] = {
    "en": frozenset("the a an of to in and or but not is was were are be been it its this that these those for with by on at from as if so no nor what which who whom whose how why when where once after before until while whether had has have does did do will would can could may might should must he she they we you i us them him her his their our my your one each every some any all both neither either than then there here only still yet never".split()),
    "de": frozenset("der die das den dem des ein eine einen einem einer eines und oder aber nicht kein keine ist war waren sind sein es er sie wir ihr ich dieser diese dieses für mit von vom zu zum zur auf an am im in aus bei nach vor über unter durch um als wie wenn weil dass ob was wer wo warum weder noch auch nur schon sich man hat haben hatte wird werden wurde kann muss seit ohne zwischen".split()),
    "fr": frozenset("le la les l un une des du de d et ou mais ne pas ni est était sont être il elle ils elles on nous vous je ce cet cette ces pour avec par sur dans en au aux sans sous chez vers entre depuis après avant comme si que qu qui quoi dont où pourquoi quand plus moins très se sa son ses leur leurs n c s y a ont avait peut faut".split()),
    "es": frozenset("el la los las un una unos unas de del y e o pero no ni es era son ser hay él ella ellos ellas lo le les se su sus este esta estos estas ese esa para por con sin sobre en al entre desde hasta tras como si que quien qué quién cuando donde por más menos muy ya también nada a ha han había puede".split()),
}
LANGUAGES = tuple(FUNCTION_WORDS)
ALL_FUNCTION_WORDS = frozenset().union(*FUNCTION_WORDS.values())


#: The languages, by their place, that each function word belongs to.
_OF = {w: tuple(i for i, lang in enumerate(LANGUAGES) if w in FUNCTION_WORDS[lang]) for w in ALL_FUNCTION_WORDS}


def detect(words: list[str]) -> str:
    """The language most of the lower-case words belong to by function words; ``en`` where none does."""
    n = [0] * len(LANGUAGES)
    for own in filter(None, map(_OF.get, words)):
        for i in own:
            n[i] += 1
    return LANGUAGES[n.index(max(n))] if any(n) else "en"
