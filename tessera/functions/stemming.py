"""English suffix stripping by the published second Porter algorithm, of single lower-case words."""

from __future__ import annotations

import re

# Fixed values of the algorithm, in its own order.
VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI_ENDINGS = "cdeghkmnrt"
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT_PLURALS = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
REGION_PREFIXES = ("gener", "commun", "arsen")
STEP_2 = {
    "ational": "ate", "fulness": "ful", "iveness": "ive", "ization": "ize", "ousness": "ous", "biliti": "ble", "lessli": "less", "tional": "tion", "alism": "al", "aliti": "al", "ation": "ate",
    "entli": "ent", "fulli": "ful", "iviti": "ive", "ousli": "ous", "abli": "able", "alli": "al", "anci": "ance", "ator": "ate", "enci": "ence", "izer": "ize", "bli": "ble", "ogi": "og", "li": "",
}
STEP_3 = {"ational": "ate", "tional": "tion", "alize": "al", "ative": "", "icate": "ic", "iciti": "ic", "ical": "ic", "ness": "", "ful": ""}
STEP_4 = ("ement", "able", "ance", "ence", "ible", "ment", "ant", "ate", "ent", "ion", "ism", "iti", "ive", "ize", "ous", "al", "er", "ic")
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that "
    "these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during "
    "before after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same "
    "so than too very s t can will just don should now"
).split()


def _regions(word: str) -> tuple[int, int]:
    """Where the two regions begin: after the first consonant that follows a vowel, and after the next such one."""
    after = lambda at: (m.end() + at) if (m := re.search(r"[aeiouy][^aeiouy]", word[at:])) else len(word)
    first = next((len(p) for p in REGION_PREFIXES if word.startswith(p)), None)
    first = after(0) if first is None else first
    return first, after(first)


def _ends_short(word: str) -> bool:
    """Whether the last syllable is short."""
    return bool(re.search(r"[^aeiouy][aeiouy][^aeiouywxY]$", word) or re.fullmatch(r"[aeiouy][^aeiouy]", word))


def _without_plural(word: str) -> str:
    if word.endswith("sses"):
        return word[:-2]
    if word.endswith(("ied", "ies")):
        return word[:-2] if len(word) > 4 else word[:-1]
    if word.endswith(("us", "ss")) or not word.endswith("s"):
        return word
    return word[:-1] if re.search(r"[aeiouy]", word[:-2]) else word


def _without_past(word: str, r1: int) -> str:
    for ending in ("eedly", "eed"):
        if word.endswith(ending):
            return word[: -len(ending)] + "ee" if len(word) - len(ending) >= r1 else word
    for ending in ("ingly", "edly", "ing", "ed"):
        if word.endswith(ending):
            stem = word[: -len(ending)]
            if not re.search(r"[aeiouy]", stem):
                return word
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if stem.endswith(DOUBLES):
                return stem[:-1]
            return stem + "e" if _ends_short(stem) and len(stem) <= r1 else stem
    return word


def _derived(word: str, r1: int, r2: int) -> str:
    """Steps 2 to 4: the longest ending of each, in its region."""
    for ending in sorted(STEP_2, key=len, reverse=True):
        if word.endswith(ending):
            stem = word[: -len(ending)]
            fits = stem.endswith("l") if ending == "ogi" else stem[-1:] in tuple(LI_ENDINGS) if ending == "li" else True
            if len(stem) >= r1 and fits:
                word = stem + STEP_2[ending]
            break
    for ending in sorted(STEP_3, key=len, reverse=True):
        if word.endswith(ending):
            stem = word[: -len(ending)]
            if len(stem) >= (r2 if ending == "ative" else r1):
                word = stem + STEP_3[ending]
            break
    for ending in STEP_4:
        if word.endswith(ending):
            stem = word[: -len(ending)]
            if len(stem) >= r2 and (ending != "ion" or stem.endswith(("s", "t"))):
                word = stem
            break
    return word


def stem(word: str) -> str:
    """The stem of a lower-case word; words of up to two letters and words of other scripts stay as they are."""
    if len(word) <= 2:
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    word = word.lstrip("'")
    word = re.sub(r"^y|(?<=[aeiouy])y", "Y", word)  # a consonant's y
    r1, r2 = _regions(word)
    word = re.sub(r"('s'|'s|')$", "", word)
    word = _without_plural(word)
    if word in KEPT_PLURALS:
        return word
    word = _without_past(word, r1)
    if re.search(r".[^aeiouy][yY]$", word):
        word = word[:-1] + "i"
    word = _derived(word, r1, r2)
    if word.endswith("e") and (len(word) - 1 >= r2 or (len(word) - 1 >= r1 and not _ends_short(word[:-1]))):
        word = word[:-1]
    elif word.endswith("l") and len(word) - 1 >= r2 and word[:-1].endswith("l"):
        word = word[:-1]
    return word.replace("Y", "y")
