"""The English (Porter2) stemmer, as its published rules state it; a term at a time, for distinct terms."""

from __future__ import annotations

import functools
import re

# The rules' suffixes, exceptions and letter classes.
VOWEL = "aeiouy"
DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI_ENDING = "cdeghkmnrt"
R1_PREFIX = ("gener", "commun", "arsen")
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli",
    "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
AFTER_1A = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize",
    "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous",
    "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")


def _region(word: str, start: int) -> int:
    """Where the region after the first non-vowel that follows a vowel begins, from start on."""
    m = re.compile(f"[{VOWEL}][^{VOWEL}]").search(word, start)
    return m.end() if m else len(word)


def _short_end(word: str) -> bool:
    """Whether a word ends in a short syllable."""
    return bool(re.search(f"[^{VOWEL}][{VOWEL}][^{VOWEL}wxY]$", word) or re.fullmatch(f"[{VOWEL}][^{VOWEL}]", word))


def _longest(word: str, suffixes) -> str:
    return max((s for s in suffixes if word.endswith(s)), key=len, default="")


@functools.lru_cache(1 << 16)
def porter2(term: str) -> str:
    """The stem of a term, lower-cased first; terms with other than a-z and apostrophes stay as they are."""
    word = term.lower().replace("’", "'")
    if len(word) < 3 or not re.fullmatch("[a-z']+", word):
        return word
    word = word.removeprefix("'")
    if word in SPECIAL:
        return SPECIAL[word]
    word = re.sub(f"(^|(?<=[{VOWEL}]))y", "Y", word)
    prefix = next((p for p in R1_PREFIX if word.startswith(p)), "")
    r1 = len(prefix) if prefix else _region(word, 0)
    r2 = _region(word, r1)
    # 0: apostrophes; 1a: plurals.
    for end in ("'s'", "'s", "'"):
        if word.endswith(end):
            word = word[: -len(end)]
            break
    end = _longest(word, ("sses", "ied", "ies", "us", "ss", "s"))
    if end == "sses":
        word = word[:-2]
    elif end in ("ied", "ies"):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif end == "s" and re.search(f"[{VOWEL}].", word[:-1]):
        word = word[:-1]
    if word in AFTER_1A:
        return word
    # 1b: past and progressive.
    end = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end in ("eed", "eedly"):
        if len(word) - len(end) >= r1:
            word = word[: -len(end)] + "ee"
    elif end and re.search(f"[{VOWEL}]", word[: -len(end)]):
        word = word[: -len(end)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(DOUBLE):
            word = word[:-1]
        elif r1 >= len(word) and _short_end(word):
            word += "e"
    # 1c: y.
    if re.search(f".[^{VOWEL}][yY]$", word):
        word = word[:-1] + "i"
    # 2 and 3: derivations in R1.
    end = _longest(word, STEP_2)
    if end and len(word) - len(end) >= r1:
        stem = word[: -len(end)]
        if (end != "ogi" or stem.endswith("l")) and (end != "li" or stem[-1:] in tuple(LI_ENDING)):
            word = stem + STEP_2[end]
    end = _longest(word, STEP_3)
    if end and len(word) - len(end) >= (r2 if end == "ative" else r1):
        word = word[: -len(end)] + STEP_3[end]
    # 4 and 5: endings in R2.
    end = _longest(word, STEP_4)
    if end and len(word) - len(end) >= r2 and (end != "ion" or word[:-3].endswith(("s", "t"))):
        word = word[: -len(end)]
    if word.endswith("e") and (len(word) > r2 or len(word) > r1 and not _short_end(word[:-1])):
        word = word[:-1]
    elif word.endswith("ll") and len(word) > r2:
        word = word[:-1]
    return word.replace("Y", "y")
