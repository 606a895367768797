"""English stems: suffixes are stripped in steps, each within the regions of a word that follow its first syllables. Words without a step's suffix pass it unchanged."""

from __future__ import annotations

import re

#: English words that no text index holds.
STOP_WORDS = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that "
    "these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during "
    "before after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own "
    "same so than too very s t can will just don should now".split()
)
#: Words whose stems no rule gives, words that are left alone once their plural is cut, and beginnings that end the first region.
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT = frozenset("inning outing canning herring earring proceed exceed succeed".split())
BEGINNINGS = ("gener", "commun", "arsen")
#: Suffixes by step with what replaces them.
SECOND = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
THIRD = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
FOURTH = dict.fromkeys("al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split(), "")
#: What may stand before ``li`` where it is cut, and pairs of letters of which one is cut.
BEFORE_LI, DOUBLES = "cdeghkmnrt", ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")

_VOWEL = "aeiouy"
_REGION = re.compile(f"[{_VOWEL}][^{_VOWEL}]")
_SHORT = re.compile(f"(?:[^{_VOWEL}][{_VOWEL}][^{_VOWEL}wxY]|^[{_VOWEL}][^{_VOWEL}])$")


def _after(word: str, start: int) -> int:
    """Where the region begins that follows the first consonant behind a vowel from ``start`` on."""
    found = _REGION.search(word, start)
    return found.end() if found else len(word)


def _suffix(word: str, suffixes) -> str | None:
    """The longest of the suffixes that a word ends with."""
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _has_vowel(part: str) -> bool:
    return any(c in _VOWEL for c in part)


def _singular(word: str) -> str:
    end = _suffix(word, ("sses", "ied", "ies", "us", "ss", "s"))
    if end == "sses":
        return word[:-2]
    if end in ("ied", "ies"):
        return word[:-2] if len(word) > 4 else word[:-1]
    return word[:-1] if end == "s" and _has_vowel(word[:-2]) else word


def _without_ending(word: str, first: int) -> str:
    """Without -ed, -ing and what is made of them; the end is mended."""
    end = _suffix(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end is None:
        return word
    at = len(word) - len(end)
    if end.startswith("eed"):
        return word[: at + 2] if at >= first else word
    left = word[:at]
    if not _has_vowel(left):
        return word
    if left.endswith(("at", "bl", "iz")):
        return left + "e"
    if left.endswith(DOUBLES):
        return left[:-1]
    return left + "e" if first >= len(left) and _SHORT.search(left) else left


def _replaced(word: str, table: dict[str, str], first: int, second: int) -> str:
    """Steps two to four: the longest suffix is replaced if it lies in the step's region and what stands before it allows it."""
    end = _suffix(word, table)
    if end is None:
        return word
    at = len(word) - len(end)
    before = word[at - 1 : at]
    ok = at >= (second if table is FOURTH or end == "ative" else first)
    ok = ok and (end != "ogi" or before == "l") and (end != "li" or before in BEFORE_LI) and (end != "ion" or before in ("s", "t"))
    return word[:at] + table[end] if ok else word


def stem(word: str) -> str:
    """The stem of a word in small letters."""
    if len(word) <= 2:
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    # A y at the start or behind a vowel is a consonant, written Y meanwhile.
    word = re.sub(f"(?:^|(?<=[{_VOWEL}]))y", "Y", word)
    first = next((len(b) for b in BEGINNINGS if word.startswith(b)), None) or _after(word, 0)
    second = _after(word, first)
    word = _singular(word)
    if word in KEPT:
        return word
    word = _without_ending(word, first)
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in _VOWEL:
        word = word[:-1] + "i"
    for table in (SECOND, THIRD, FOURTH):
        word = _replaced(word, table, first, second)
    if word.endswith("e"):
        at = len(word) - 1
        if at >= second or at >= first and not _SHORT.search(word[:-1]):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= second:
        word = word[:-1]
    return word.replace("Y", "y")
