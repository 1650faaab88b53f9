"""Sounds of letters: a table from code points to lower-case ASCII, made from short lists and rules.

Letters of Greek, Cyrillic, Arabic, Hebrew, Armenian and Georgian are listed. Indic letters and signs, Thai, Lao, kana and
syllabaries take their sound from their Unicode name, which there is a sound and not the name of a letter; an Indic
consonant gives its consonant alone. Digits give their value, compatibility forms and marked Latin letters what they
decompose into. Hangul syllables are computed (`HANGUL`), so they are not in the table. Nothing is cut by length.
"""

from __future__ import annotations

import unicodedata
from functools import cache

# Sounds of letters, each followed by its own; "-" is no sound.
GREEK = "α a β b γ g δ d ε e ζ z η e θ th ι i κ k λ l μ m ν n ξ x ο o π p ρ r σ s ς s τ t υ u φ ph χ kh ψ ps ω o"
CYRILLIC = (
    "а a б b в v г g д d е e ж zh з z и i й i к k л l м m н n о o п p р r с s т t у u ф f х kh ц ts ч ch ш sh щ shch ъ - ы y ь - э e ю iu я ia "
    "ѐ e ё io ђ dj ѓ gj є ie ѕ dz і i ї yi ј j љ lj њ nj ћ tsh ќ kj ѝ i ў u џ dzh ґ g ғ gh қ q ң ng ү u ұ u һ h ә a ө o ҳ h ҷ j ӣ i ӯ u"
)
ARABIC = (
    "ء - آ a أ a ؤ w إ i ئ y ا a ب b ة h ت t ث th ج j ح h خ kh د d ذ dh ر r ز z س s ش sh ص s ض d ط t ظ z ع - غ gh ف f ق q ك k ل l م m ن n ه h و w ى a ي y "
    "پ p چ ch ژ zh ک k گ g ی y ے e ٹ t ڈ d ڑ r ں n ہ h ھ h ۀ h ۂ h ۃ h ـ -"
)
HEBREW = "א - ב b ג g ד d ה h ו v ז z ח h ט t י y ך k כ k ל l ם m מ m ן n נ n ס s ע - ף p פ p ץ ts צ ts ק q ר r ש sh ת t"
ARMENIAN = "ա a բ b գ g դ d ե e զ z է e ը e թ t ժ zh ի i լ l խ kh ծ ts կ k հ h ձ dz ղ gh ճ ch մ m յ y ն n շ sh ո o չ ch պ p ջ j ռ r ս s վ v տ t ր r ց ts ւ w փ p ք k օ o ֆ f և ev"
GEORGIAN = "ა a ბ b გ g დ d ე e ვ v ზ z თ t ი i კ k ლ l მ m ნ n ო o პ p ჟ zh რ r ს s ტ t უ u ფ p ქ k ღ gh ყ q შ sh ჩ ch ც ts ძ dz წ ts ჭ ch ხ kh ჯ j ჰ h"
OTHER_LATIN = "ß ss æ ae œ oe ø o đ d ð d þ th ł l ħ h ı i ŋ ng ə a ɓ b ɗ d ɖ d ɛ e ƒ f ɣ g ɨ i ɔ o ʃ sh ʊ u ʒ zh"
KANA = {"si": "shi", "ti": "chi", "tu": "tsu", "hu": "fu", "zi": "ji", "di": "ji", "du": "zu"}
HANGUL = (
    "g kk n d tt r m b pp s ss - j jj ch k t p h".split(),
    "a ae ya yae eo e yeo ye o wa wae oe yo u wo we wi yu eu ui i".split(),
    "- g gg gs n nj nh d l lg lm lb ls lt lp lh m b bs s ss ng j ch k t p h".split(),
)
HANGUL_FIRST, HANGUL_LAST = "가", "힣"

_ABUGIDAS = {"DEVANAGARI", "BENGALI", "GURMUKHI", "GUJARATI", "ORIYA", "TAMIL", "TELUGU", "KANNADA", "MALAYALAM", "TIBETAN", "KHMER", "MYANMAR", "LAO"}


def _named(name: str) -> str | None:
    """The sound that a Unicode name tells, None if it tells none."""
    words = name.split()
    script, last = words[0], words[-1].lower()
    if script in _ABUGIDAS:
        if "VIRAMA" in words or "NUKTA" in words:
            return ""
        if last in ("anusvara", "candrabindu", "bindi", "tippi", "anusvaraya"):
            return "n"
        if last == "visarga":
            return "h"
        if "VOWEL" in words or "LETTER" in words and last[0] in "aeiou":
            return last if last.isalpha() else None
        if "LETTER" in words and last.isalpha() and last[-1] in "ao":
            return last[:-1]
        return None
    if script == "THAI" and "CHARACTER" in words:
        if words[2] == "SARA":
            return words[3].lower()
        return words[2][:-1].lower() if words[2].endswith("O") and len(words) > 3 and words[2] != "NIKHAHIT" else None
    if script in ("HIRAGANA", "KATAKANA") and "LETTER" in words:
        return KANA.get(last, last) if last.isalpha() else None
    if name.startswith(("ETHIOPIC SYLLABLE ", "CHEROKEE LETTER ", "CHEROKEE SMALL LETTER ", "YI SYLLABLE ")):
        return last if last.isalpha() else None
    return None


def _sound(c: str) -> str | None:
    digit = unicodedata.digit(c, None)
    if digit is not None:
        return str(digit)
    flat = "".join(x for x in unicodedata.normalize("NFKD", c) if x < "\x80").lower()
    if flat.strip():
        return flat
    base = unicodedata.normalize("NFKD", c)[0]
    listed = _listed()
    if c in listed or base in listed:
        return listed.get(c, listed.get(base))
    name = unicodedata.name(c, "")
    return _named(name) if name else None


@cache
def _listed() -> dict[str, str]:
    out = {}
    for words in (GREEK, CYRILLIC, ARABIC, HEBREW, ARMENIAN, GEORGIAN, OTHER_LATIN):
        parts = words.split()
        for c, sound in zip(parts[::2], parts[1::2], strict=True):
            out[c] = out[c.upper()] = sound.strip("-")
    return {c: s for c, s in out.items() if len(c) == 1}


@cache
def sounds() -> dict[str, str]:
    """Every code point with a sound, planes 0 and 1, but for ASCII, Hangul syllables and ideographs."""
    found = {}
    for code in (*range(0x80, 0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x10000), *range(0x10000, 0x20000)):
        c = chr(code)
        if 0xD800 <= code < 0xE000 or unicodedata.category(c) in ("Cn", "Cs", "Co", "Lo") and 0xF900 <= code < 0xFB00:
            continue
        sound = _sound(c)
        if sound is not None:
            found[c] = sound
    return found


@cache
def translation() -> tuple[str, tuple[str, ...]]:
    """(characters, their first letters, their second letters, ...): the longer the sound, the earlier a character stands, so that each string names those that have so many letters."""
    table = sorted(sounds().items(), key=lambda x: (-len(x[1]), x[0]))
    longest = len(table[0][1])
    return "".join(c for c, _ in table), tuple("".join(s[k] for _, s in table if len(s) > k) for k in range(longest))
