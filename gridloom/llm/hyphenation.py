"""Syllables by hyphenation patterns: letters with levels between them, of which the highest counts and odd ones part."""

from __future__ import annotations

import regex

# Which vowels of a group are spoken apart (odd) or together (even). A dot is a word's end. Where no pattern speaks, a
# group of vowels is one syllable, or each one is its own in German but for the diphthongs.
_ENGLISH = """
    i1a i1o i1u e1o u1a u1o a1o a1e. y1i y1e e1um e1ing o1ing a1ic a1ism
    ci2a ti2a si2a ci3at ti3at gi2a .gi3ant ri2age ni2age di3am
    ci2o ti2o si2o gi2o xi2o ni2on li2on .li3on .bi3o di3o ri3o i3ol i3om
    sci3en cli3en qwi3et di3et oci3et ie1ty ri1en di1en ni1en pi1en bi1en li1en vi1en fri4end ri1er di1er ti1er li1er ni1er vi1er fi1er pi1er ki1er si1er i1est ri3et
    soldi2er .pi4er .ti4er ci2en ti2en si2en
    ide3a are3a kore3a cre3at the3at re3al re3act re3ass re3arr ide3al line3ar nucle3ar pre3am cre4atu ce2an re4alm
    pe2op ge2on ge2ou .ge3o the3o
    re3in. de3it .re3i .pre3e .re3e .re3u ve3hi
    o3as co3al po3em po3et co3ef co3ex co3op co3or .co3o .o3a
    gu2a qu4 su2a gu4e gu4i
    flu3en cru3el fu3el du3el flu3id ru3in nu3in tu3it nu3it gu5ity su3ici u3ing bu2oy
    na3iv a3ise
"""
_GERMAN = """
    a2i a2u a2y a2a ä2u e2e e2i e2u e2y i2e o2o o2i o2y
    e3um. e3ums. lä3um. lä3ums. e3us. mili3e fili3e lini3e lili3e udi3en ali3en edi3en eri3en ori3en ini3en ili3en ri3en. di3en. ide3en stri3e be3inh be3in. ge3imp ge3and be3urt be3ob ri4e. qu4
"""
_SPANISH_STRONG, _SPANISH_WEAK = "aeoáéó", "íú"


def _parse(patterns: list[str]) -> dict[str, tuple[int, ...]]:
    out = {}
    for p in patterns:
        letters, levels = "", [0]
        for c in p:
            if c.isdigit():
                levels[-1] = int(c)
            else:
                letters += c
                levels.append(0)
        out[letters] = tuple(levels)
    return out


_spanish = [f"{a}1{b}" for a in _SPANISH_STRONG for b in _SPANISH_STRONG + _SPANISH_WEAK] + [f"{b}1{a}" for a in _SPANISH_STRONG for b in _SPANISH_WEAK]
_PATTERNS = {"en": _parse(_ENGLISH.split()), "de": _parse(_GERMAN.split()), "es": _parse(_spanish)}
_VOWELS = {"en": set("aeiouyàâäéèêëîïôöùûü"), "de": set("aeiouyäöüéèàâ"), "es": set("aeiouáéíóúü")}
_LONGEST = {k: max(map(len, p)) for k, p in _PATTERNS.items()}
# An English e that isn't spoken: at the end, before an end's s or d, and before endings.
_SILENT = regex.compile(r"(?<=[^aeiouy])e(?=(?:s|d|ly|ment|ments|ness|ful|less|where|thing|times|how)?$)")
_ENDS_SPOKEN = regex.compile(r"(?:(?:[sxzcg]|ch|sh)es|[td]ed|[^aeiouyl]l(?:e|es|ed)|[^aeiou](?:le|re)ment[s]?)$")
_SYLLABIC = regex.compile(r"(?:th|s)ms?$")


def _levels(word: str, lang: str) -> list[int]:
    """The level before each letter of the word."""
    text, patterns, longest = f".{word}.", _PATTERNS[lang], _LONGEST[lang]
    out = [0] * (len(text) + 1)
    for i in range(len(text)):
        for j in range(i + 1, min(len(text), i + longest) + 1):
            for k, level in enumerate(patterns.get(text[i:j], ())):
                if level > out[i + k]:
                    out[i + k] = level
    return out[1:]


def _apart(lang: str) -> bool:
    return lang == "de"


def syllables(word: str, lang: str = "en") -> int:
    """Syllables of a word in English, German or Spanish (en, de, es); at least one."""
    w = word.lower()
    if lang == "en":
        # Letters that are no vowels here: y before one at a start, u after q; and an e that isn't spoken.
        w = regex.sub(r"^y(?=[aeiou])|(?<=[aeiou])y(?=[ao])", "j", w).replace("qu", "qw")
        w = regex.sub(r"gue(?=s?$)", "g", w).replace("busin", "busn").replace("every", "evry").replace("evening", "evning")
        if len(regex.findall(r"[aeiouy]+", w)) > 1:
            if not _ENDS_SPOKEN.search(w):
                w = _SILENT.sub("'", w)
    elif lang == "de":
        w = regex.sub(r"^y(?=[aeiou])", "j", w).replace("qu", "qw")
    else:
        w = regex.sub(r"(?<=[aeiouáéíóú])y$", "i", regex.sub(r"(?<=[qg])u(?=[eiéí])", "", w))
        w = "i" if w == "y" else w
    vowels, levels = _VOWELS[lang], _levels(w, lang)
    n, before = 0, False
    for i, c in enumerate(w):
        is_vowel = c in vowels
        if is_vowel and (not before or levels[i] % 2 or (_apart(lang) and not levels[i])):
            n += 1
        before = is_vowel
    return max(1, n + (lang == "en" and _SYLLABIC.search(w) is not None))
