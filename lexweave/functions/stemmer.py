"""The Spanish stemmer of the Snowball project, written from its published description."""

from __future__ import annotations

from functools import lru_cache

# The letter classes and ending lists of the published algorithm.
VOWELS = "aeiouáéíóúü"
PRONOUNS = "me se sela selo selas selos la le lo las les los nos".split()
AFTER_GERUND = "iéndo ándo ár ér ír ando iendo ar er ir".split()
DELETE = "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos".split()
DELETE_IC = "adora ador ación adoras adores aciones ante antes ancia ancias acion".split()
VERB_Y = "ya ye yan yen yeron yendo yo yó yas yes yais yamos".split()
VERB_PLAIN = "en es éis emos".split()
VERB = (
    "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré "
    "irían irías irán irás iríais iría iréis iríamos iremos irá iré aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran "
    "ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais ierais "
    "aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos"
).split()
RESIDUAL = "os a o á í ó".split()


def _regions(w: str) -> tuple[int, int, int]:
    """Where RV, R1 and R2 begin."""

    def after(start: int) -> int:
        for i in range(start + 1, len(w)):
            if w[i] not in VOWELS and w[i - 1] in VOWELS:
                return i + 1
        return len(w)

    r1 = after(0)
    r2 = after(r1)
    rv = len(w)
    if len(w) > 2:
        if w[1] not in VOWELS:
            rv = next((i + 1 for i in range(2, len(w)) if w[i] in VOWELS), len(w))
        elif w[0] in VOWELS:
            rv = next((i + 1 for i in range(2, len(w)) if w[i] not in VOWELS), len(w))
        else:
            rv = 3
    return rv, r1, r2


def _ending(w: str, endings: list[str], start: int) -> str:
    """The longest of ``endings`` that ``w`` ends with inside the region from ``start``."""
    return max((e for e in endings if w.endswith(e) and len(w) - len(e) >= start), key=len, default="")


def _plain(w: str) -> str:
    return w.translate(str.maketrans("áéíóú", "aeiou"))


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    w = word
    rv, r1, r2 = _regions(w)
    # Attached pronouns.
    if p := _ending(w, PRONOUNS, rv):
        rest = w[: -len(p)]
        g = _ending(rest, AFTER_GERUND, rv)
        if g or (rest.endswith("yendo") and len(rest) - 5 >= rv and rest[-6:-5] == "u"):
            w = rest[: len(rest) - len(g)] + _plain(g) if g in AFTER_GERUND[:5] else rest
    # Standard endings, else verb endings.
    before = w

    def drop(e: str, more: tuple[str, ...] = ()) -> None:
        nonlocal w
        w = w[: -len(e)]
        for m in more:
            if w.endswith(m) and len(w) - len(m) >= r2:
                w = w[: -len(m)]
                break

    lists = [DELETE, DELETE_IC, ["logía", "logías"], ["ución", "uciones"], ["encia", "encias"], ["amente"], ["mente"], ["idad", "idades"], ["iva", "ivo", "ivas", "ivos"]]
    e = max((x for group in lists for x in group if w.endswith(x)), key=len, default="")
    inside = len(w) - len(e) >= (r1 if e == "amente" else r2)
    if e and inside:
        kind = next(i for i, group in enumerate(lists) if e in group)
        if kind == 0:
            drop(e)
        elif kind == 1:
            drop(e, ("ic",))
        elif kind == 2:
            w = w[: -len(e)] + "log"
        elif kind == 3:
            w = w[: -len(e)] + "u"
        elif kind == 4:
            w = w[: -len(e)] + "ente"
        elif kind == 5:
            w = w[: -len(e)]
            if w.endswith("iv") and len(w) - 2 >= r2:
                w = w[:-2]
                if w.endswith("at") and len(w) - 2 >= r2:
                    w = w[:-2]
            elif m := _ending(w, ["os", "ic", "ad"], r2):
                w = w[: -len(m)]
        elif kind == 6:
            drop(e, ("ante", "able", "ible"))
        elif kind == 7:
            drop(e, ("abil", "ic", "iv"))
        else:
            drop(e, ("at",))
    if w == before:
        y = _ending(w, VERB_Y, rv)
        if y and w[: -len(y)].endswith("u"):
            w = w[: -len(y)]
        else:
            v = _ending(w, VERB + VERB_PLAIN, rv)
            if v in VERB_PLAIN and v:
                w = w[: -len(v)]
                if w.endswith("gu"):
                    w = w[:-1]
            elif v:
                w = w[: -len(v)]
    # What is left at the end.
    if r := _ending(w, RESIDUAL, rv):
        w = w[: -len(r)]
    elif r := _ending(w, ["e", "é"], rv):
        w = w[:-1]
        if w.endswith("gu") and len(w) - 1 >= rv:
            w = w[:-1]
    return _plain(w)
