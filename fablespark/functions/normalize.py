"""Text made speakable: links, dates, times, numbers and signs as words, in French or English.

Each pass is a column builder that replaces every match of a pattern by an expression of the match,
so rows never leave the JVM. `normalized` applies all passes in order, one column step each, so that
no pass repeats the ones before it.

Defined where a plain reading would fail: a date or number that is no number (day 00, more digits
than a long holds, digits parted by other white space than a space) stays as it is written, and an
amount before its currency sign is read like one after it.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import numbers as N
from . import text as T
from .text import col

# Months, abbreviations, signs, units and currencies as they are read out.
MONTHS = {
    "fr": "janvier fevrier mars avril mai juin juillet aout septembre octobre novembre decembre".split(),
    "en": "January February March April May June July August September October November December".split(),
}
ABBREVIATIONS = {
    "fr": {
        "M.": "Monsieur", "Mme": "Madame", "Mlle": "Mademoiselle", "Dr": "Docteur", "Dr.": "Docteur", "Pr": "Professeur", "Pr.": "Professeur", "Me": "Maitre", "St": "Saint", "Ste": "Sainte",
        "etc.": "et cetera", "cf.": "confer", "ex.": "exemple", "env.": "environ", "min.": "minutes", "max.": "maximum", "nb": "nombre", "n°": "numero", "No": "numero", "p.": "page",
        "pp.": "pages", "vol.": "volume", "chap.": "chapitre", "fig.": "figure", "tel.": "telephone", "fax": "fax",
    },
    "en": {
        "Mr.": "Mister", "Mrs.": "Missus", "Ms.": "Miz", "Dr.": "Doctor", "Prof.": "Professor", "St.": "Saint", "etc.": "et cetera", "e.g.": "for example", "i.e.": "that is", "vs.": "versus",
        "approx.": "approximately", "govt.": "government", "dept.": "department", "min.": "minutes", "max.": "maximum", "no.": "number", "p.": "page", "pp.": "pages", "vol.": "volume",
        "ch.": "chapter", "fig.": "figure", "tel.": "telephone",
    },
}
SYMBOLS = {
    "fr": {
        "&": " et ", "@": " arobase ", "#": " hashtag ", "~": " environ ", "+": " plus ", "=": " egale ", "<": " inferieur a ", ">": " superieur a ", "°": " degres ", "©": " copyright ",
        "®": " marque deposee ", "™": " trademark ", "§": " paragraphe ", "¶": " paragraphe ", "†": "", "‡": "", "•": "", "→": " fleche ", "←": " fleche ", "↑": " fleche ", "↓": " fleche ",
    },
    "en": {
        "&": " and ", "@": " at ", "#": " hashtag ", "~": " approximately ", "+": " plus ", "=": " equals ", "<": " less than ", ">": " greater than ", "°": " degrees ", "©": " copyright ",
        "®": " registered ", "™": " trademark ", "§": " section ", "¶": " paragraph ",
    },
}
UNITS = {
    "fr": {
        "km": "kilometres", "m": "metres", "cm": "centimetres", "mm": "millimetres", "kg": "kilogrammes", "g": "grammes", "mg": "milligrammes", "l": "litres", "ml": "millilitres",
        "h": "heures", "min": "minutes", "s": "secondes", "ms": "millisecondes", "km/h": "kilometres heure", "m/s": "metres par seconde",
    },
    "en": {
        "km": "kilometers", "m": "meters", "cm": "centimeters", "mm": "millimeters", "kg": "kilograms", "g": "grams", "mg": "milligrams", "l": "liters", "ml": "milliliters",
        "h": "hours", "min": "minutes", "s": "seconds", "ms": "milliseconds", "mph": "miles per hour", "ft": "feet", "in": "inches", "lb": "pounds", "oz": "ounces",
    },
}
CURRENCIES = {
    "fr": {"€": ("euros", "euro"), "$": ("dollars", "dollar"), "£": ("livres", "livres sterling"), "¥": ("yens", "yen")},
    "en": {"€": ("euros", "euro"), "$": ("dollars", "dollar"), "£": ("livres", "pounds"), "¥": ("yens", "yen")},
}
NUMBER = r"[0-9]+(?:[.,][0-9]+)?"
#: A number that something else has to follow: where that is missing, no shorter number is tried.
_BEFORE = r"(?<![0-9])[0-9]++(?:[.,][0-9]++)?+"


#: Parts a text at its matches. One character, at which a text is split without a pattern: Spark compiles a split's pattern for each row.
_CUT = "\0"


def replaced(text: Column | str, pattern: str, by: Callable[[Column], Column]) -> Column:
    """text with every match of a pattern replaced by an expression of the match."""

    def parts(t: Column) -> Column:
        """What lies between matches and the matches, in turn."""
        found = F.concat(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), F.array(F.lit("")))
        both = F.flatten(F.zip_with(F.split(t, pattern, -1), found, lambda gap, m: F.array(gap, m)))
        cut = F.split(F.regexp_replace(t, pattern, f"{_CUT}$0{_CUT}"), _CUT)
        return F.when(F.contains(t, F.lit(_CUT)), F.when(t.rlike(pattern), F.slice(both, 1, F.size(both) - 1)).otherwise(F.array(t))).otherwise(cut)

    read = lambda x, i: F.when(i % 2 == 0, x).otherwise(T.let(x, lambda m: F.coalesce(by(m), m)))
    return T.let(parts(col(text)), lambda p: F.when(F.size(p) > 1, F.array_join(F.transform(p, read), "")).otherwise(p[0]))


def _parts(text: Column, marks: str) -> Column:
    """Parts of a text at any of these marks."""
    return F.split(F.translate(text, marks, marks[0] * len(marks)), rf"\{marks[0]}")


def said(number: Column, lang: str) -> Column:
    """Digits in words, null where they are no long; zero is read without an accent."""
    return N.in_words(number.try_cast("long"), lang, zero="zero")


def pair(digits: Column, lang: str) -> Column:
    """One or two digits in words."""
    return F.get(F.split(F.lit("\n".join("zero" if n == 0 else N.small(n, lang) for n in range(100))), "\n"), digits.try_cast("int"))


def _groups(digits: Column, size: int, lang: str) -> Column:
    """Digits in groups of one or two, in words."""
    return F.array_join(F.transform(F.regexp_extract_all(digits, F.lit(f"[0-9]{{1,{size}}}"), F.lit(0)), lambda d: pair(d, lang)), " ")


def _decimal(number: Column, lang: str, fraction: Callable[[Column], Column] | None = None) -> Column:
    """A number with one mark before its fraction in words, digit by digit after the mark."""
    after = (lambda d: _groups(d, 1, lang)) if fraction is None else fraction
    mark = F.lit(" virgule " if lang == "fr" else " point ")
    return T.let(_parts(number, ".,"), lambda parts: F.concat(said(parts[0], lang), F.when(F.size(parts) > 1, F.concat(mark, after(parts[1]))).otherwise("")))


def urls(text: Column | str, lang: str = "fr") -> Column:
    return F.regexp_replace(col(text), r"(?U)https?://[^\s<>\"{}|\\^`\[\]]+", " lien internet " if lang == "fr" else " web link ")


def emails(text: Column | str, lang: str = "fr") -> Column:
    at = " arobase " if lang == "fr" else " at "
    return replaced(text, r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", lambda m: F.concat(F.substring_index(m, "@", 1), F.lit(at), F.replace(F.substring_index(m, "@", -1), F.lit("."), F.lit(" point "))))


def dates(text: Column | str, lang: str = "fr") -> Column:
    """Day, month and year of four digits; a month beyond 12 keeps its number."""
    names = F.array(*map(F.lit, MONTHS[lang]))

    def read(m: Column) -> Column:
        return T.let(_parts(m, "/-"), spelled)

    def spelled(parts: Column) -> Column:
        day = F.regexp_replace(parts[0], "^0+", "")
        number = parts[1].cast("int")
        month = F.when(number.between(1, 12), F.get(names, number - 1)).otherwise(parts[1])
        year = said(parts[2], lang)
        if lang == "fr":
            return F.concat(F.when(day == "1", "premier").otherwise(pair(day, lang)), F.lit(" "), month, F.lit(" "), year)
        return F.concat(month, F.lit(" "), pair(day, lang), F.lit(", "), year)

    return replaced(text, r"[0-9]{1,2}[/\-][0-9]{1,2}[/\-][0-9]{4}", read)


def times(text: Column | str, lang: str = "fr") -> Column:
    def read(m: Column) -> Column:
        return T.let(_parts(m, ":hH"), spelled)

    def spelled(parts: Column) -> Column:
        hour, minute = parts[0].cast("int"), parts[1].cast("int")
        if lang == "fr":
            head = F.concat(pair(parts[0], lang), F.when(hour <= 1, " heure").otherwise(" heures"))
            return F.when(minute == 0, head).otherwise(F.concat(head, F.lit(" "), pair(parts[1], lang)))
        return F.concat(pair(parts[0], lang), F.when(minute == 0, F.lit(" o'clock")).otherwise(F.concat(F.lit(" "), pair(parts[1], lang))))

    return replaced(text, r"[0-9]{1,2}[:hH][0-9]{2}", read)


def phones(text: Column | str, lang: str = "fr") -> Column:
    """Digits by twos. Any ten digits count as a number, then those after a plus sign."""
    pairs = lambda m: _groups(F.regexp_replace(m, "[^0-9]", ""), 2, lang)
    t = replaced(text, r"(?U)[0-9]{2}[\s.-]?[0-9]{2}[\s.-]?[0-9]{2}[\s.-]?[0-9]{2}[\s.-]?[0-9]{2}", pairs)
    return T.let(t, lambda x: replaced(x, r"(?U)\+[0-9]{1,3}[\s.-]?[0-9]{2,4}[\s.-]?[0-9]{2,4}[\s.-]?[0-9]{2,4}", pairs))


def romans(text: Column | str, lang: str = "fr") -> Column:
    """Roman numerals of two capitals or more, ordinals included; other words of such letters stay."""

    def read(m: Column) -> Column:
        numeral = F.regexp_extract(m, "^([IVXLCDMivxlcdm]+)(?:[eE][mM][eE]|[èÈ][mM][eE]|[eE])?$", 1)
        ordinal = F.length(m) > F.length(numeral)
        words = said(T.roman_value(numeral).cast("string"), lang)
        return F.when((F.length(numeral) < 2) | ~numeral.rlike("^[IVXLCDM]+$"), m).otherwise(F.concat(words, F.when(ordinal, "ieme" if lang == "fr" else "th").otherwise("")))

    return replaced(text, r"(?=[IVXLCDMivxlcdmİı])(?iuU)\b[IVXLCDM]+(?:e|eme|ème)?\b(?!')", read)


def measures(text: Column | str, lang: str = "fr") -> Column:
    """Numbers with a unit. Units are tried in their listed order; one in other letter case keeps its sign."""
    units = "|".join(UNITS[lang])
    names = F.create_map(*[F.lit(x) for kv in UNITS[lang].items() for x in kv])

    def read(m: Column) -> Column:
        unit = F.regexp_replace(m, rf"(?U)^{NUMBER}\s*", "")
        return F.concat(_decimal(F.regexp_extract(m, NUMBER, 0), lang), F.lit(" "), F.coalesce(F.try_element_at(names, unit), unit))

    return replaced(text, rf"(?U){_BEFORE}\s*+(?iu:{units})\b", read)


def percentages(text: Column | str, lang: str = "fr") -> Column:
    word = " pourcent" if lang == "fr" else " percent"
    return replaced(text, rf"(?U){_BEFORE}\s*+%", lambda m: F.concat(_decimal(F.regexp_extract(m, NUMBER, 0), lang, lambda d: d), F.lit(word)))


def currency(text: Column | str, lang: str = "fr") -> Column:
    """Amounts before or after a currency sign; two digits of the fraction are cents."""
    name = lambda sign, at: F.create_map(*[F.lit(x) for s, names in CURRENCIES[lang].items() for x in (s, names[at])])[sign]

    def read(m: Column) -> Column:
        return T.let(_parts(F.regexp_extract(m, NUMBER, 0), ".,"), lambda parts: spelled(F.regexp_extract(m, "[€$£¥]", 0), parts))

    def spelled(sign: Column, parts: Column) -> Column:
        whole, cents = said(parts[0], lang), F.substring(F.rpad(parts[1], 2, "0"), 1, 2)
        with_cents = F.concat(whole, F.lit(" "), name(sign, 0 if lang == "fr" else 1), F.lit(" et " if lang == "fr" else " and "), pair(cents, lang), F.lit(" centimes" if lang == "fr" else " cents"))
        one = (F.size(parts) == 1) & (parts[0].try_cast("long") == 1)
        return F.when((F.size(parts) > 1) & (cents != "00"), with_cents).otherwise(F.concat(whole, F.lit(" "), F.when(one, name(sign, 1)).otherwise(name(sign, 0))))

    return replaced(text, rf"(?U)[€$£¥]\s?{NUMBER}|{_BEFORE}\s?+[€$£¥]", read)


def ordinals(text: Column | str, lang: str = "fr") -> Column:
    def read(m: Column) -> Column:
        digits = F.regexp_extract(m, "[0-9]+", 0)
        n, words = digits.try_cast("long"), said(digits, lang)
        if lang == "fr":
            return F.when(n == 1, "premier").otherwise(F.concat(words, F.lit("ieme")))
        return F.when(n == 1, "first").when(n == 2, "second").when(n == 3, "third").otherwise(F.concat(words, F.lit("th")))

    return replaced(text, r"(?U)(?<![0-9])[0-9]++(?iu:er|ere|eme|ème|e)\b" if lang == "fr" else r"(?U)(?<![0-9])[0-9]++(?iu:st|nd|rd|th)\b", read)


def numbers(text: Column | str, lang: str = "fr") -> Column:
    """Remaining numbers, in runs of up to three digits where they have no separators; a comma or point starts a fraction."""

    def read(m: Column) -> Column:
        plain = F.replace(m, F.lit(" "), F.lit(""))
        return F.when(m.rlike(r"[^0-9., ]"), m).otherwise(_decimal(plain, lang))

    return replaced(text, r"(?U)[0-9]{1,3}(?:[\s,][0-9]{3})*(?:[.,][0-9]+)?|[0-9]+(?:[.,][0-9]+)?", read)


def abbreviations(text: Column | str, lang: str = "fr") -> Column:
    """Abbreviations before white space, a comma, a colon, a semicolon or the end, whatever their case, in listed order.

    No two of them can match at one place or overlap, and none is made by another, so one search finds all."""
    first = "".join(sorted({c for short in ABBREVIATIONS[lang] for c in (short[0].lower(), short[0].upper())}))
    one = lambda short: rf"\b\Q{short}\E(?=\s|$|[,;:])"
    # The first letter is looked at before the word edge, which is dear in Unicode; letters that are s, k or i in another case count.
    anyone = rf"(?=[{first}\u017f\u212a\u0130\u0131])(?iuU)\b(?:{'|'.join(map(re.escape, ABBREVIATIONS[lang]))})(?=\s|$|[,;:])"
    names = F.create_map(*[F.lit(x) for kv in {short.lower(): full for short, full in reversed(ABBREVIATIONS[lang].items())}.items() for x in kv])

    def read(m: Column) -> Column:
        slow = reduce(lambda t, kv: F.regexp_replace(t, f"(?iuU){one(kv[0])}", kv[1]), ABBREVIATIONS[lang].items(), m)
        return F.coalesce(F.try_element_at(names, F.lower(m)), slow)

    return replaced(text, anyone, read)


def symbols(text: Column | str, lang: str = "fr") -> Column:
    """Signs as words; header signs and the sign before a word vanish."""
    signs = list(SYMBOLS[lang])
    at = signs.index("#")

    def words(t: Column, some: list[str]) -> Column:
        # One table and one range of characters, which hold all of these signs, are looked for before each sign by itself.
        wide = [c for c in some if c > "\xff"]
        held = "".join(re.escape(c) for c in some if c <= "\xff") + (f"{min(wide)}-{max(wide)}" if wide else "")
        return F.when(t.rlike(f"[{held}]"), reduce(lambda x, c: F.replace(x, F.lit(c), F.lit(SYMBOLS[lang][c])), some, t)).otherwise(t)

    def headers(t: Column) -> Column:
        return F.when(F.contains(t, F.lit("#")), F.regexp_replace(F.regexp_replace(t, r"(?mU)^#+\s*", ""), r"(?U)#(\w)", "$1")).otherwise(t)

    return T.let(words(col(text), signs[:at]), lambda t: T.let(headers(t), lambda x: words(x, signs[at + 1 :])))


def _collapsed(text: Column) -> Column:
    """T.collapse; a text without white space but plain spaces meets no pattern in Unicode."""
    return T.strip(F.when(text.rlike(r"[\t-\r\x85\xa0\u1680-\u3000]"), F.regexp_replace(text, r"(?U)\s+", " ")).otherwise(F.regexp_replace(text, " {2,}", " ")))


#: All passes, in the order in which they are applied.
PASSES: tuple[Callable[[Column | str, str], Column], ...] = (urls, emails, dates, times, phones, romans, measures, percentages, currency, ordinals, numbers, abbreviations, symbols)


def normalized(df: DataFrame, column: str = "text", lang: str = "fr") -> DataFrame:
    """df with `column` made speakable."""
    for one in PASSES:
        df = df.withColumn(column, one(F.col(column), lang))
    return df.withColumn(column, _collapsed(F.col(column)))
