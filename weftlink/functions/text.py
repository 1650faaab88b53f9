"""Normalisation and tokenisation of names and addresses as column expressions (no Python at run time)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftlink.functions import scripts

# Words that carry no identity in business names.
LEGAL_SUFFIXES = [
    "pvt", "ltd", "limited", "private", "inc", "incorporated", "corp", "corporation",
    "llc", "llp", "sarl", "sas", "sasu", "sa", "eurl", "sci", "snc", "co", "company",
    "enterprises", "enterprise", "industries", "industry", "services", "service",
    "associates", "group", "holdings",
]

# Words that carry no identity in addresses.
GENERIC_ADDRESS_WORDS = [
    "road", "rd", "street", "st", "avenue", "ave", "lane", "ln",
    "drive", "dr", "block", "near", "opp", "floor", "unit", "apt",
    "suite", "building", "bldg", "rue", "boulevard", "blvd", "terrace",
    "court", "ct", "highway", "hwy", "parkway", "pkwy", "way", "place",
    "null", "none",
]

# Patterns that take parts of names and addresses away or find them.
LEGAL_PATTERN = r"\b(" + "|".join(LEGAL_SUFFIXES) + r")\b"
DOMAIN_PATTERN = r"\b(www\.|https?://|\.com|\.in|\.org|\.net|\.co|\.fr)\b"
COMPOUND_PATTERN = r"\b[A-Za-z0-9]+[-/][A-Za-z0-9/-]+\b"

_ACCENTS = [("àáâãäåāăą", "a"), ("çćĉċč", "c"), ("ďđ", "d"), ("èéêëēĕėęě", "e"), ("ĝğġģ", "g"), ("ĥħ", "h"), ("ìíîïĩīĭįı", "i"), ("ĵ", "j"), ("ķ", "k"), ("ĺļľŀł", "l"), ("ñńņň", "n"), ("òóôõöøōŏő", "o"), ("ŕŗř", "r"), ("śŝşš", "s"), ("ţťŧ", "t"), ("ùúûüũūŭůűų", "u"), ("ŵ", "w"), ("ýÿŷ", "y"), ("źżž", "z")]
_FROM = "".join(a + a.upper() for a, _ in _ACCENTS if len(a.upper()) == len(a))
_TO = "".join(b * 2 * len(a) for a, b in _ACCENTS if len(a.upper()) == len(a))


def is_missing(c: Column) -> Column:
    """Null, empty, or the literal words that missing values were written as."""
    return c.isNull() | c.isin("", "nan", "None")


def latin_ascii(c: Column) -> Column:
    """Latin letters without their marks, in lower case; other scripts stay."""
    c = F.translate(c, _FROM, _TO)
    for old, new in (("ß", "ss"), ("[œŒ]", "oe"), ("[æÆ]", "ae"), ("[þÞ]", "th"), ("[’‘]", "'")):
        c = F.regexp_replace(c, old, new)
    return F.lower(c)


def romanised(c: Column) -> Column:
    """Lower-case ASCII of any script, letter by letter, with built-in functions.

    Letters give their sounds (`scripts.translation`), Hangul syllables those of their parts, marks nothing, and other signs
    a space. An ideograph or a letter without a listed sound gives a word of its own, `u` and its code point, so names in
    such scripts keep their keys, though these don't equal those of a romanised name.
    """
    known, letters = scripts.translation()

    def hangul(x: Column) -> Column:
        at = F.ascii(x) - ord(scripts.HANGUL_FIRST)
        parts = [F.array(*(F.lit(p.strip("-")) for p in sounds)) for sounds in scripts.HANGUL]
        place = [F.floor(at / 588), F.floor(at % 588 / 28), at % 28]
        return F.concat(*(F.get(p, i.cast("int")) for p, i in zip(parts, place, strict=True)))

    def one(x: Column) -> Column:
        first = F.translate(x, known, letters[0])
        sound = F.concat(first, *(F.translate(x, known, more) for more in letters[1:]))
        other = F.when(x.rlike(r"[\p{M}\p{C}]"), "").when(x.rlike(r"[\p{P}\p{S}\p{Z}]"), " ").otherwise(F.concat(F.lit(" u"), F.ascii(x), F.lit(" ")))
        return F.when(x < "\x80", F.lower(x)).when(x.between(scripts.HANGUL_FIRST, scripts.HANGUL_LAST), hangul(x)).when(first != x, sound).otherwise(other)

    return F.array_join(F.transform(F.split(c, ""), one), "")


def any_ascii(c: Column) -> Column:
    """Text of any script in lower-case ASCII. ASCII is only lowered, Latin letters lose their marks, and other scripts are romanised; no row leaves the JVM."""
    latin = latin_ascii(c)
    return F.when(c.rlike(r"^[\x00-\x7F]*$"), F.lower(c)).when(latin.rlike(r"^[\x00-\x7F]*$"), latin).otherwise(romanised(latin))


def fold_acronyms(c: Column) -> Column:
    c = F.regexp_replace(c, r"\b([a-z])\.([a-z])\.([a-z])\b", "$1$2$3")
    return F.regexp_replace(c, r"\b([a-z])\.([a-z])\b", "$1$2")


def strip_domains(c: Column) -> Column:
    return F.regexp_replace(c, DOMAIN_PATTERN, " ")


def strip_legal(c: Column) -> Column:
    return F.regexp_replace(c, LEGAL_PATTERN, " ")


def collapse_letters(c: Column) -> Column:
    """Runs of one letter become that letter; digits keep theirs."""
    return F.regexp_replace(c, r"([a-z])\1+", "$1")


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[^a-z0-9\s]", " "), r"\s+", " "))


def normalize_text(c: Column, ascii_of=any_ascii) -> Column:
    """The steps' order matters: suffixes go before letters collapse."""
    out = squeeze(collapse_letters(strip_legal(strip_domains(fold_acronyms(ascii_of(c.cast("string")))))))
    return F.when(is_missing(c.cast("string")), F.lit("")).otherwise(out)


def all_tokens(clean: Column) -> Column:
    return F.filter(F.split(clean, " "), lambda t: t != "")


def name_tokens(clean: Column) -> Column:
    return F.filter(F.split(clean, " "), lambda t: F.length(t) >= 2)


def token_sorted(clean: Column) -> Column:
    return F.array_join(F.sort_array(all_tokens(clean)), " ")


def compressed(clean: Column) -> Column:
    return F.replace(clean, F.lit(" "), F.lit(""))


def prefix_shingles(tokens: Column, least: int = 3, most: int = 4) -> Column:
    """Per token its first `least` letters and, where it has them, its first `most`."""
    both = F.transform(
        F.filter(tokens, lambda t: F.length(t) >= least),
        lambda t: F.when(F.length(t) >= most, F.array(F.substring(t, 1, least), F.substring(t, 1, most))).otherwise(F.array(F.substring(t, 1, least))),
    )
    return F.array_distinct(F.flatten(both))


def compressed_shingles(clean: Column) -> Column:
    c = compressed(clean)
    return F.when(F.length(c) >= 5, F.array(F.substring(c, 1, 4), F.substring(c, 1, 5))).when(F.length(c) >= 4, F.array(F.substring(c, 1, 4))).otherwise(F.array().cast("array<string>"))


def soundex_keys(tokens: Column) -> Column:
    good = F.filter(tokens, lambda t: (F.length(t) >= 3) & ~t.rlike("^[0-9]+$"))
    return F.transform(good, lambda t: F.concat(F.lit("sx:"), F.soundex(t)))


# Philips' published rules (1990), the first that fits a letter, seen with the two before and the four behind it.
METAPHONE = [
    ("b", [(r"^.mb ", ""), (r"", "B")]),
    ("c", [(r"^.sch", "K"), (r"^..ch", "X"), (r"^..cia", "X"), (r"^.sc[eiy]", ""), (r"^..c[eiy]", "S"), (r"", "K")]),
    ("d", [(r"^..dg[eiy]", "J"), (r"", "T")]),
    ("g", [(r"^[^d]dg[eiy]", ""), (r"^..gh[^ aeiou]", ""), (r"^..gn(ed)? ", ""), (r"^..g[eiy]", "J"), (r"", "K")]),
    ("h", [(r"^.[^cgpst]h[aeiou]", "H"), (r"", "")]),
    ("k", [(r"^.ck", ""), (r"", "K")]),
    ("p", [(r"^..ph", "F"), (r"", "P")]),
    ("s", [(r"^..s(h|i[ao])", "X"), (r"", "S")]),
    ("t", [(r"^..th", "0"), (r"^..ti[ao]", "X"), (r"^..tch", ""), (r"", "T")]),
    ("w", [(r"^..w[aeiou]", "W"), (r"", "")]),
    ("y", [(r"^..y[aeiou]", "Y"), (r"", "")]),
]


def metaphone(word: Column) -> Column:
    """Metaphone code of a lower-case ASCII word; other characters are left out."""
    w = F.regexp_replace(word, "[^a-z]", "")
    for old, new in ((r"^(?:[kgp](?=n)|w(?=r)|a(?=e))", ""), ("^x", "s"), ("^wh", "w")):
        w = F.regexp_replace(w, old, new)

    def code(x: Column) -> Column:
        near, c, before = x["near"], x["c"], x["before"]
        out = F.when((c == before) & (c != "c"), "").when(c.isin(*"aeiou"), F.when(before == " ", F.upper(c)).otherwise(""))
        for letter, rules in METAPHONE:
            each = F
            for pattern, sound in rules:
                each = each.when(near.rlike(pattern), sound) if pattern else each.otherwise(sound)
            out = out.when(c == letter, each)
        return out.when(c == "q", "K").when(c == "v", "F").when(c == "x", "KS").when(c == "z", "S").otherwise(F.upper(c))

    def coded(w: Column) -> Column:
        seen = F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit("    ")), i, F.lit(7)))
        letters = F.transform(seen, lambda near: F.struct(near.alias("near"), F.substring(near, 3, 1).alias("c"), F.substring(near, 2, 1).alias("before")))
        return F.when(w == "", "").when(w.isNotNull(), F.array_join(F.transform(letters, code), ""))

    # what a lambda names by its argument is computed once, what it spells out is computed anew for each use and letter
    return F.get(F.transform(F.array(w), coded), F.lit(0))


def phonetic_keys(tokens: Column) -> Column:
    """Distinct Soundex and, from two letters on, Metaphone keys of the tokens that are words."""
    good = F.filter(tokens, lambda t: (F.length(t) >= 3) & ~t.rlike("^[0-9]+$"))
    codes = F.transform(good, lambda t: F.struct(t.alias("t"), metaphone(t).alias("m")))
    both = F.transform(codes, lambda x: F.when(F.length(x["m"]) >= 2, F.array(F.concat(F.lit("sx:"), F.soundex(x["t"])), F.concat(F.lit("mp:"), x["m"]))).otherwise(F.array(F.concat(F.lit("sx:"), F.soundex(x["t"])))))
    return F.array_distinct(F.flatten(both))


def postal_code(clean: Column) -> Column:
    return F.nullif(F.regexp_extract(clean, r"\b[0-9]{5,6}\b", 0), F.lit(""))


def address_numbers(raw: Column) -> Column:
    """The first three digit runs of up to six digits in the raw text, of any script."""
    found = F.filter(F.regexp_extract_all(F.coalesce(raw, F.lit("")), F.lit(r"\p{Nd}+"), F.lit(0)), lambda n: F.length(n) <= 6)
    return F.when(is_missing(raw), F.array().cast("array<string>")).otherwise(F.slice(found, 1, 3))


def address_tokens(clean: Column) -> Column:
    return F.filter(F.split(clean, " "), lambda t: (F.length(t) >= 3) & ~t.isin(GENERIC_ADDRESS_WORDS) & ~t.rlike("^[0-9]+$"))


def address_anchors(raw: Column) -> Column:
    clean = normalize_text(raw)
    return F.struct(address_numbers(raw).alias("numbers"), postal_code(clean).alias("postal_code"), address_tokens(clean).alias("clean_address_tokens"), is_missing(raw).alias("is_empty"))


def compound_numbers(raw: Column) -> Column:
    """Door and plot numbers such as 39-17-48/1."""
    found = F.transform(F.regexp_extract_all(F.coalesce(raw, F.lit("")), F.lit(COMPOUND_PATTERN), F.lit(0)), lambda m: F.trim(F.lower(m)))
    return F.when(raw == "nan", F.array().cast("array<string>")).otherwise(F.filter(found, lambda m: m.rlike("[0-9]")))
